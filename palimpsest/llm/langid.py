"""Language identification with bit-sliced Bloom filters over byte n-grams.

One table of ``2**bits`` slots; each slot is a bitmask with one bit per language. An n-gram of a language sets that
language's bit in ``PROBES`` slots; the AND of an n-gram's slots names, in one lookup, all languages that contain it.
A text's score for a language is its number of n-grams with that language's bit, corrected for false positives with the
language's own fill rate.

A language contains an n-gram when the n-gram is about as frequent there as in the language where it is most frequent
(``min_share`` of the largest relative frequency) and was seen ``min_count`` times; n-grams common to several languages
so count for all of them and decide nothing.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import join_split, map_rows, materialize

N = 4
PROBES = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: ASCII characters that are no letters separate words.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """crc32(id as text) mod folds = fold; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text as numbers, one text after the other, and the number of n-grams up to each text.

    N-grams are N consecutive UTF-8 bytes of the lower-cased text with at most its ends outside of a word."""
    parts = [b" " + t.lower().encode("utf-8", "replace").translate(WORD_BYTES) + b" " for t in texts]
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    if len(raw) < N:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    wide, m = raw.astype(np.uint32), len(raw) - N + 1
    gram, inner = np.zeros(m, np.uint32), np.ones(m, bool)
    for i in range(N):
        gram = (gram << np.uint32(8)) | wide[i : i + m]
        if 0 < i < N - 1:
            inner &= raw[i : i + m] != 0x20
    for i in range(1, N):  # an n-gram never spans two texts
        over = ends[:-1] - i
        inner[over[(over >= 0) & (over < m)]] = False
    kept = np.concatenate(([0], np.cumsum(inner)))
    return gram[inner], kept[np.minimum(ends, m)]


def slots(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    mixed = grams ^ (grams >> np.uint32(15))
    return [(mixed * np.uint32(p)) >> np.uint32(32 - bits) for p in PROBES]


class LanguageFilter:
    """languages: sorted; table: uint64 masks, one row for each 64 languages; false_positive: rate for each language."""

    def __init__(self, languages: list[str], bits: int = 21):
        self.languages, self.bits = languages, bits
        self.table = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), np.uint64)
        self.false_positive = np.zeros(len(languages))

    def add(self, language: str, grams: np.ndarray) -> None:
        i = self.languages.index(language)
        row, bit = self.table[i // 64], np.uint64(1 << i % 64)
        for s in slots(grams.astype(np.uint32), self.bits):
            row[s] |= bit
        self.false_positive[i] = np.count_nonzero(row & bit) / len(row)
        self.false_positive[i] **= len(PROBES)

    def lookup(self, grams: np.ndarray) -> list[np.ndarray]:
        """The mask of the languages that contain each n-gram, 64 languages to an array."""
        at = slots(grams, self.bits)
        return [row[at[0]] & row[at[1]] & row[at[2]] for row in self.table]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Corrected number of n-grams of each text in each language."""
        grams, upto = ngrams(texts)
        total = np.diff(upto, prepend=0)
        out = np.zeros((len(texts), len(self.languages)))
        masks = self.lookup(grams)
        for i in range(len(self.languages)):
            hit = (masks[i // 64] >> np.uint64(i % 64)).astype(np.uint8) & np.uint8(1)
            summed = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))[upto]
            fp = self.false_positive[i]
            out[:, i] = (np.diff(summed, prepend=0) - fp * total) / (1 - fp) if fp < 1 else 0
        return np.maximum(out, 0)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over (lang, text)."""

    def run(cols: list) -> list:
        langs, texts = cols
        out = ([], [], [])
        for lang in sorted(set(langs)):
            g, n = np.unique(ngrams([t for x, t in zip(langs, texts, strict=True) if x == lang])[0], return_counts=True)
            for column, values in zip(out, ([lang] * len(g), g.tolist(), n.tolist()), strict=True):
                column += values
        return list(out)

    return map_rows(labelled, "lang string, gram bigint, n bigint", run).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, sample_docs: int = 20_000, max_grams: int = 50_000, min_count: int = 3, min_share: float = 0.5, bits: int = 21) -> LanguageFilter:
    """Learn from (lang, text, doc_id) rows; rows with a null in lang or text are left out. doc_id, which may be missing,
    only takes part in the choice of the sample.

    Fitted on a sample that is bounded for each language: all rows of a language that has at most ``sample_docs``, about
    so many of others, chosen by a hash of id and text. Each language keeps about ``max_grams`` of its most frequent
    n-grams at most, ties cut by a hash, so the model grows with the number of languages only. No language with an n-gram is lost: one whose
    n-grams are all rarer than ``min_count`` keeps these, one that has none of its own keeps all."""
    key = F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string") if "doc_id" in labelled.columns else F.lit(None), "text")
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(key, F.lit(1 << 30)).alias("key"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    n = labelled.count()
    chosen = F.col("key") < F.lit((1 << 30) * sample_docs) / F.col("rows")
    labelled = join_split(labelled, sizes.withColumn("c", F.col("rows")), ["lang"], "c", n).where(chosen).select("lang", "text")
    counted = materialize(gram_counts(labelled))
    rows = counted.count()
    of_lang = counted.groupBy("lang").agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.count("*").alias("c"))
    counted = join_split(counted, of_lang, ["lang"], "c", rows).withColumn("share", F.col("n") / F.col("all"))
    most = F.max("share").over(Window.partitionBy("gram"))  # of a gram, one row for each language
    own = (F.col("share") >= min_share * F.col("most")) & (F.col("n") >= F.least(F.lit(min_count), "top"))
    marked = materialize(counted.withColumn("most", most).select("lang", "gram", "n", own.alias("own")))
    # how many n-grams each language has of each count: from this, the least count that it keeps
    histogram = marked.groupBy("lang", "own", "n").agg(F.count("*").alias("c"))
    some = histogram.groupBy("lang").agg(F.max("own").alias("some"))
    ranked = histogram.join(some, "lang").where("own = some").withColumn("upto", F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("n"))))
    # of the count at which they become too many, n-grams with small hashes
    ranked = ranked.withColumn("part", F.least(F.lit(1.0), (F.lit(max_grams) - F.col("upto") + F.col("c")) / F.col("c")))
    taken = F.when(F.col("part") > 0, F.col("n"))
    least = ranked.groupBy("lang", "own").agg(F.min(taken).alias("least"), F.min_by("part", taken).alias("part"), F.sum("c").alias("c"))
    tie = F.pmod(F.xxhash64(F.lit("tie"), "gram"), F.lit(1 << 30)) < F.col("part") * F.lit(1 << 30)
    kept = join_split(marked, least, ["lang", "own"], "c", rows).where((F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & tie))
    grams: dict[str, list[int]] = {}
    for lang, gram in kept.select("lang", "gram").toLocalIterator():  # about max_grams for each language
        grams.setdefault(lang, []).append(gram)
    model = LanguageFilter(sorted(grams), bits)
    for lang, g in grams.items():
        model.add(lang, np.array(g, dtype=np.int64))
    return model


def predict(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, lang_pred, score). Ids may repeat or be null; texts are read whole, however long.
    Other columns are ignored, whatever their names; an empty table gives an empty result.

    ``und`` with score 0 for null texts and texts without a letter (or if nothing was learned); a text with letters but
    no known n-gram gets the first language with score 0. score: the winner's part of all languages' n-grams. Ties go to
    the language that comes first by name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(cols: list) -> list:
        ids, texts = cols
        m = shared.value
        known = [m.languages and t is not None and LETTER.search(t) is not None for t in texts]
        s = m.scores([t if k else "" for t, k in zip(texts, known, strict=True)])
        if not m.languages:
            return [ids, [UNKNOWN] * len(ids), [0.0] * len(ids)]
        best, total = s.argmax(axis=1), s.sum(axis=1)
        score = np.where(total > 0, s.max(axis=1) / np.where(total > 0, total, 1), 0.0)
        return [ids, [m.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(x) if k else 0.0 for x, k in zip(score, known, strict=True)]]

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), f"doc_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double", run)


def op2_query(docs: DataFrame) -> DataFrame:
    """The language of every document, learned from those that are not held out; nulls and ties as in ``predict``."""
    out = held_out("doc_id", 3, 1)
    model = fit(docs.where(~out).select("lang", "text", "doc_id"))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, min_score: float = 0.0, **fit_options) -> DataFrame:
    """The rows of ``docs`` whose language is known, all columns as they came.

    At least ``min_score`` of a text's n-grams are its best language's, more than none; n-grams that other languages have
    too count in full, so that the number of languages and how close they are do not matter. Null texts and those without
    a letter go; repeated rows are judged each for itself; an empty table gives an empty result."""
    model = fit(docs.select("lang", "text", *(c for c in docs.columns if c == "doc_id")), **fit_options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        m, keep = shared.value, []
        for at in range(0, len(texts), 256):
            part = [t or "" for t in texts.iloc[at : at + 256]]
            s, total = m.scores(part), np.diff(ngrams(part)[1], prepend=0)
            for t, row, n in zip(part, s, total.tolist(), strict=True):
                best = row.max() if len(row) else 0.0
                keep.append(bool(t and LETTER.search(t) and (not min_score or (best > 0 and best >= min_score * n))))
        return pd.Series(keep)

    return docs.where(known(F.col("text").cast("string")))
