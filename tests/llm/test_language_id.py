"""Language ID: held-out accuracy on the given documents, small tables, samples."""

from __future__ import annotations

import os

import pytest

from palimpsest.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.op2_query(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND lang IS NOT NULL AND text RLIKE '[a-z]'").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 200 and right >= 0.97 * len(rows)


def test_a_language_of_rare_ngrams_is_learned(spark):
    docs = spark.createDataFrame([(1, "the river", "en"), (2, "wasser und", "de"), (3, "x1", None)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert (got[1], got[2]) == ("en", "de")


def test_a_language_without_ngrams_of_its_own_is_learned(spark):
    rows = [(i, "the river and the stone " * 3, "en") for i in range(30)] + [(100, "the river " + "qzx vkq wvz " * 40, "xx")]
    rows += [(200, "the river qzx", "yy")]
    assert langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).languages == ["en", "xx", "yy"]


def test_copies_of_one_text_are_sampled_each(spark):
    rows = [(i, "the river and the stone", "en") for i in range(4000)] + [(9000 + i, f"the morning garden{i % 7}", "en") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert 60 < _sampled(docs, 100) < 150


def _sampled(docs, bound):
    seen = {}

    def keep(labelled):
        seen["n"] = labelled.count()
        return old(labelled)

    old, langid.gram_counts = langid.gram_counts, keep
    try:
        langid.fit(docs, sample_docs=bound)
    finally:
        langid.gram_counts = old
    return seen["n"]


def test_ties_do_not_exceed_the_bound(spark, monkeypatch):
    kept, add = {}, langid.LanguageFilter.add
    monkeypatch.setattr(langid.LanguageFilter, "add", lambda m, lang, g: (kept.update({lang: len(g)}), add(m, lang, g))[1])
    words = lambda letters, n: " ".join("".join(letters[i // 6**k % 6] for k in range(5)) for i in range(n))
    rows = [(1, words("abcdef", 4000), "aa"), (2, words("uvwxyz", 30), "bb")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), max_grams=400)
    assert model.languages == ["aa", "bb"] and 300 < kept["aa"] < 500 and kept["bb"] > 0
