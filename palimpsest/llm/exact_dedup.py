"""Exact deduplication by skew-safe combining, DataFrame functions only.

Three combining steps, each of which compares whole contents (the text itself is a grouping key next to its digest):
1. locally: Spark's map-side partial aggregate merges equal texts inside each input partition before anything moves;
2. salted: (digest, text, salt) groups meet, so that the copies of one hot text are dealt to ``salts`` tasks;
3. globally: at most ``salts`` winners of each text are merged.
Rows find their group again through (digest, second hash, salt), never through the text, so the way back moves a few
dozen bytes a row and a hot group is again dealt by its salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, materialize, with_ids


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest id stays. Null text counts as
    empty. Null ids never win over others (a group of null ids only has keep_id null, and its rows are kept). Repeated
    rows with the winning id are all marked kept. An empty table gives an empty result; other columns are ignored.

    salts: as many as the session has shuffle partitions, 64 at least. A row's salt is that of its input partition, so copies
    with null or equal ids are dealt out too; no result depends on it."""
    salts = salts or max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(ascii_lower(F.col(text_col)), F.lit("")).alias("norm"))
    keyed = rows.select("doc_id", "norm", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("h2"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = keyed.groupBy("sha", "h2", "norm", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    winners = salted.groupBy("sha", "h2", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).drop("norm")
    back = materialize(keyed.drop("norm"))
    by_salt = back.select("sha", "h2", "salt").distinct().join(winners, ["sha", "h2"])
    return back.join(by_salt, ["sha", "h2", "salt"]).select(
        "doc_id", "keep_id", F.col("group_size").cast("long"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they came, whatever their names. Repeated rows of one winning id
    collapse into one. Of equal texts that have null ids only, the smallest by bytes stays (then the row with the smallest
    hash). Null text counts as empty; an empty table gives an
    empty result; texts are compared whole, however long."""
    groups = exact_groups(docs, id_col, text_col, salts)
    sha = "_" * (1 + max(map(len, docs.columns)))  # longer than any name, so nobody else's
    row = sha + "_"
    stay = with_ids(docs, groups.where("kept AND doc_id IS NOT NULL").select("doc_id"), id_col)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    nameless = docs.where(F.col(id_col).isNull()).groupBy(F.sha2(F.coalesce(ascii_lower(F.col(text_col)), F.lit("")), 256).alias(sha))
    nameless = nameless.agg(F.min_by(whole, F.struct(F.coalesce(text_col, F.lit("")), F.xxhash64(F.to_json(whole)))).alias(row)).select(sha, f"{row}.*")
    alone = groups.where("kept AND doc_id IS NULL").select(F.col("text_sha256").alias(sha))
    return stay.unionByName(nameless.join(alone, sha, "left_semi").drop(sha))


def op8_query(docs: DataFrame) -> DataFrame:
    """All documents; nulls, repeats and empty tables as in ``exact_groups``."""
    return exact_groups(docs)


OP8_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
