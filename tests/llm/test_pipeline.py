"""The pipeline against its stages done one after the other in plain Python."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import jaccard_join, langid, packing, pii
from palimpsest.llm.common import materialize

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {"en": "the of and that with from river stone house water light under morning garden".split(), "de": "der die und nicht mit einem wasser schloss straße morgen garten haus über schön".split()}


def corpus() -> list[tuple]:
    rng = random.Random(12)
    prose = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefg") for _ in range(n))
    rows = [(i, prose(lang, rng.randint(2, 90)), lang) for i in range(120) for lang in [("en", "de")[i % 4 == 0]]]
    base = rows[7][1] + " " + prose("en", 120)
    rows += [(200, base, "en"), (201, base.upper(), "en"), (202, base, None), (203, base + " and one more", "en"), (204, "an " + base, "en"), (205, base.replace("a ", "b ", 1), "en")]
    rows += [(300, "write to a.b@example.org or 192.0.2.7 " + prose("en", 30), "en"), (301, "qzxj vkqx zzqv xkjq " * 9, None), (302, None, "en"), (303, "", None), (304, "12 34", "en"), (305, prose("de", 6000), "de"), (306, "river", None), (306, "river", None)]
    return [(i, t, lang, "s" if i % 3 else None, None if t is None else len(t)) for i, t, lang in rows]


def by_hand(rows: list[tuple], model: langid.LanguageFilter) -> list[tuple[int, str]]:
    kept = []
    for i, t, *_ in rows:
        if t and langid.LETTER.search(t):
            n = int(langid.ngrams([t])[1][-1])
            best = model.scores([t])[0].max()
            if best > 0 and best >= corpus_pipeline.LEAST_LANGUAGE_SCORE * n:
                kept.append((i, t))
    low = {}
    for i, t in kept:
        low.setdefault("".join(c.lower() if c.isascii() else c for c in t), set()).add(i)
    first = {max(ids) for ids in low.values()}
    kept = list({i: (i, t) for i, t in kept if i in first}.values())
    groups = jaccard_join.brute_force(kept, 5, 80)
    return [(i, pii.redact_text(t)) for i, t in kept if groups[i][1] == i]


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(corpus(), SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/none/documents.parquet")
    return str(folder)


def test_pipeline(spark, tables):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    want = by_hand(corpus(), langid.fit(docs))
    assert 100 < len(want) < 125
    whole, expected = Tokenizer.from_file(packing.tokenizer_path()), {}
    for i, t in want:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        for at in range(0, len(ids), 2048):
            expected[i, at // 2048] = (at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))
    got = corpus_pipeline.run(spark, tables).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expected
    assert len(got) == len(expected)


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.dtypes == [tuple(c.split()) for c in SCHEMA.split(", ")]
    assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_no_documents(spark, tables):
    assert corpus_pipeline.run(spark, f"{tables}/none").count() == 0


CLASHING = ("__sha", "sha", "chunk", "bucket", "data", "kind", "norm", "salt", "h2", "keep_id", "group_size", "kept", "id", "node", "component", "component_id", "n_shingles", "token", "k", "n", "score", "lang_pred", "spans", "key")


def test_clashing_columns_and_odd_rows(spark):
    text = "the river and the stone house that lies under morning light with water from the garden "
    rows = [(None, None), (None, text), (None, text), (None, text.upper()), (1, text * 2), (2, text * 2), (2, text * 2), (3, ""), (4, None), (5, "17 4"), (6, "garden that lies with the light " * 4000), (7, "the house of the river a.b@example.org")]
    plain = spark.createDataFrame([(i, t, "en" if i else None, "s", len(t or "")) for i, t in rows], SCHEMA)
    wide = plain.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHING})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, old = materialize(stage(spark, plain, "")), wide
        wide = materialize(stage(spark, wide, ""))
        assert wide.dtypes == old.dtypes
        found = wide.collect()
        assert sorted((str(r.doc_id), r.text) for r in found) == sorted((str(r.doc_id), r.text) for r in plain.collect())
        assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for r in found for c in CLASHING)
    assert [r.text for r in found if r.doc_id is None] == [text.upper()]
    assert {r.doc_id for r in found} >= {6, 7} and 1 not in {r.doc_id for r in found}
    packed = corpus_pipeline.STAGES[-1][1](spark, wide, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in found}
