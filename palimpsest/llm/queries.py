"""The opN_ queries and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import clustering, embedding_dedup, exact_dedup, jaccard_join, langid, mixing, packing, piece_sampling, pii, repeats, secrets, suffix_tree_lm, whitening
from palimpsest.llm.common import table


def _over(name: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": _over("documents", packing.op1_query),
    "op2_language_id": _over("documents", langid.op2_query),
    "op3_embedding_near_dedup": _over("embeddings", embedding_dedup.op3_query),
    "op4_pii": _over("documents", pii.op4_query),
    "op5_secret_scan": _over("documents", secrets.op5_query),
    "op9_ngram_jaccard_join": _over("documents", jaccard_join.op9_query),
    "op10_suffix_array_dedup": _over("documents", repeats.op10_query),
    "op6_piece_sampling": _over("documents", piece_sampling.op6_query),
    "op7_suffix_tree_scores": _over("documents", suffix_tree_lm.op7_query),
    "op8_exact_dedup": _over("documents", exact_dedup.op8_query),
    "op11_source_mixing": _over("documents", mixing.op11_query),
    "op12_embedding_whitening": _over("embeddings", whitening.op12_query),
    "op13_centroid_clustering": _over("embeddings", clustering.op13_query),
}

ORACLES: dict[str, str] = {"op3_embedding_near_dedup": embedding_dedup.OP3_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op13_centroid_clustering": clustering.OP13_SQL}
