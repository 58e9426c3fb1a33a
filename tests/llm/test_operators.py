"""Each operator against brute force, a round trip or held-out accuracy, and over awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import urllib.parse
import zlib
from base64 import b64encode
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import embedding_dedup, exact_dedup, jaccard_join, langid, packing, pii, piece_sampling, queries, repeats, secrets, suffix_tree_lm

WORDS = {
    "en": "the of and that with from river stone house water light under morning garden".split(),
    "de": "der die und nicht mit einem wasser schloss straße morgen garten haus über schön".split(),
}


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    return " ".join(rng.choice(WORDS[lang]) + (rng.choice(["", "", "ly", "ing", "er"]) if lang == "en" else rng.choice(["", "en", "e"])) for _ in range(n))


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with copies, near copies, shared passages, nulls, blanks and a long text."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(3, 120), "de" if i % 3 == 0 else "en"), "de" if i % 3 == 0 else "en") for i in range(90)]
    base = rows[10][1]
    passage = prose(rng, 60)
    rows += [(100 + i, base if i % 2 else base.upper(), "en") for i in range(6)]
    for i in range(8):
        words = rows[20][1].split() * 3
        words[rng.randrange(len(words))] = f"changed{i}"
        rows.append((200 + i, " ".join(words), "en"))
    rows += [(300 + i, prose(rng, 20) + " " + passage + " " + prose(rng, 15), "en") for i in range(6)]
    rows += [(400, None, "en"), (401, "", "en"), (402, "  \n\t ", None), (403, "12345 !!!", "en"), (404, prose(rng, 4000), None), (405, "é" * 70, "de"), (406, "é" * 70, "de"), (407, "one", "en"), (408, "ONE", "en"), (409, "a\x00b 日本 😀 ▁x", None)]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def small_chunks():
    """Several chunks even for a small table."""
    old = repeats.chunked, jaccard_join.chunked, suffix_tree_lm.chunked
    for m in (repeats, jaccard_join, suffix_tree_lm):
        m.chunked = lambda d, i, t, *_, f=old[0]: f(d, i, t, 8_000)
    yield
    repeats.chunked, jaccard_join.chunked, suffix_tree_lm.chunked = old


def test_packing(docs):
    from tokenizers import Tokenizer

    rows = packing.op1_query(docs).collect()
    whole = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for i, t, *_ in corpus():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 30, ("en", "de")[i % 2]), ("en", "de")[i % 2], "s", 1) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None, "en", "s", 1), (901, "123 .", "en", "s", 1), (902, "the river", None, "s", 1)], SCHEMA)
    got = {r.doc_id: r for r in langid.op2_query(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows if got[i].held_out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    assert got[900].lang_pred == got[901].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identified(df).where("doc_id IN (900, 901)").count() == 0


def test_rare_language_is_learned(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30), "en") for i in range(3000)] + [(5000 + i, prose(rng, 30, "de"), "de") for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs.select("lang", "text"), sample_docs=100)).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_close_languages_stay(spark):
    """Six languages of the same words; a rare one; short texts. Noise goes, texts without a letter too."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 30), f"en{i % 6}") for i in range(300)] + [(1000 + i, prose(rng, 30, "de"), "de") for i in range(15)]
    rows += [(2000, "the river", "en1"), (2001, "wasser und garten", None), (3000, "qzxj vkqx zzqv xkjq " * 5, None), (3001, "12 34", "en0"), (3002, None, "en0")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {i for i, *_ in rows if i < 3000}


def test_language_filter_false_positives():
    m = langid.LanguageFilter(["a", "b"], bits=12)
    grams = np.arange(1, 900, dtype=np.uint32) * np.uint32(2654435761)
    m.add("a", grams)
    hits = m.lookup(grams)[0]
    assert ((hits & np.uint64(1)) == 1).all()
    assert 0 < m.false_positive[0] < 0.2
    assert m.false_positive[1] == 0


def unit_rows():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in b], i % 3) for i, b in enumerate(base)]
    for i in range(60):
        v = base[i % 10] + rng.standard_normal(16) * 0.05 * np.linalg.norm(base[i % 10]) / 4
        rows.append((100 + i, [float(x) for x in v], (i % 10) % 3))
    rows += [(200 + i, [float(x) for x in base[3]], 0) for i in range(4)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [1.0, None], 0), (304, [1.0], 0), (305, [1.0] * 16, None), (306, [], 1), (307, [2.0], 0)]
    return rows


def test_embeddings_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    rows = unit_rows()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("component", F.lit(1)).withColumn("id", F.lit(2))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.op3_query(df).collect()}
    good = {i: (np.array(v), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: set() for i, _, _ in rows}
    for a, (x, la) in good.items():
        for b, (y, lb) in good.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a].add(b)
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[i] == (len(links[i]), min(seen), min(seen) == i)


PII_TEXT = "Mail a.b@c.de.uk, x@y or @z.de; ip 10.0.0.256 1.2.3.4.5 08.8.8.8; card 4111 1111 1111 1111 and 4111-1111-1111-1112; tel +49 (30) 123-456 78. 1234567890123456789012 é me@äx.de DE89 3704 0044 0532 0130 00 +1 2"


def reference_spans(text: str) -> list[tuple[int, str, int]]:
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(a, k, b) for a, _, k, b in sorted(out)]


def fuzzed(alphabet: list[str], n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_pii_spans():
    for t in [PII_TEXT, "", *fuzzed(["@", "a", ".", "-", "1", "23", "+", " ", "(", "4111111111111111", "é", "x.y", "255."], 4000, 2)]:
        assert [(a, k, b) for k, a, b, _, base in pii.find_spans(t) if base] == reference_spans(t)
    kinds = Counter(k for k, *_ in pii.find_spans(PII_TEXT))
    assert kinds["iban"] == 1
    assert "@c.de" not in pii.redact_text(PII_TEXT)
    assert "4111 1111 1111 1111" not in pii.redact_text(PII_TEXT)


def test_pii_is_linear():
    pii.find_spans("1" * 300_000 + " " + "a." * 150_000 + "@" * 100_000 + "+1" * 100_000)


def test_pii_query(spark):
    df = spark.createDataFrame([(1, PII_TEXT), (2, None), (3, "")], "doc_id bigint, text string").withColumn("spans", F.lit(0))
    got = {r.doc_id: r for r in pii.op4_query(df).collect()}
    want = ",".join(f"{k}:{a}:{b}" for a, k, b in reference_spans(PII_TEXT))
    assert got[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[2].spans == got[3].spans == ""
    assert (got[1].n_email, got[1].n_card) == (1, 1)


SECRET = "api_key = 'ABCDEFGHIJKL1234'"


def test_secrets_base_spans():
    alphabet = ["token", "SECRET", "=", ":", " ", "'", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP", "x", "passwd", "é", "%41", "\\u0041", "ſ"]
    for t in [SECRET, *fuzzed(alphabet, 3000, 3)]:
        want = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
        want += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [(a, k, b) for k, a, b, _, base in secrets.find_secrets_in(t) if base] == [(a, k, b) for a, _, k, b in sorted(want)]


@pytest.mark.parametrize("wrap", [lambda s: urllib.parse.quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: b64encode(s.encode()).decode(), lambda s: b64encode(zlib.compress(s.encode())).decode(), lambda s: b64encode(b64encode(urllib.parse.quote(s, safe="").encode())).decode()])
def test_secrets_in_layers(wrap):
    inner = wrap(SECRET)
    text = f"before {inner} after"
    found = [(k, a, b) for k, a, b, _, base in secrets.find_secrets_in(text) if not base]
    assert any(k.endswith(".assign") for k, _, _ in found)
    for _, a, b in found:
        assert 7 <= a < b <= 7 + len(inner)


@pytest.mark.parametrize("wrap", [lambda s: urllib.parse.quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: b64encode(b64encode(zlib.compress(s.encode()))).decode()])
def test_secrets_in_equal_layers(wrap):
    inner = wrap(SECRET)
    text = f"first {inner} then {inner} {inner}"
    found = {(a, b) for k, a, b, _, base in secrets.find_secrets_in(text) if k.endswith(".assign")}
    places = [m.start() for m in re.finditer(re.escape(inner), text)]
    assert len(places) == 3 and all(any(at <= a < b <= at + len(inner) for a, b in found) for at in places)


def test_secret_loops_end():
    assert isinstance(secrets.find_secrets_in("%2541" * 50 + " " + b64encode(b64encode(b"plain text here, nothing else")).decode()), list)


def test_piece_sampling(spark, docs):
    path = piece_sampling.model_path()
    coded = piece_sampling.encode(docs, path).cache()
    plain = dict((i, t) for i, t, *_ in corpus())
    back = {r.doc_id: r.text for r in coded.select("doc_id", piece_sampling.decoder(path)(F.col("ids")).alias("text")).collect()}
    assert back == plain
    again = {r.doc_id: r.ids for r in piece_sampling.encode(docs.repartition(1), path).collect()}
    assert again == {r.doc_id: r.ids for r in coded.collect()}
    other = {r.doc_id: r.ids for r in piece_sampling.encode(docs, path, seed=1).collect()}
    assert other[404] != again[404]


def test_piece_sampling_frequencies():
    m = piece_sampling.Lattice(piece_sampling.model_path(), 1.0)
    drawn = Counter(tuple(x.tolist()) for x in m.sample([" the"] * 20_000, list(range(20_000))))
    ways, pieces = [], {t.decode(): i for i, t in enumerate(m.text) if t and i > 258}
    text = " the"

    def split(at: int, so_far: tuple) -> None:
        if at == len(text):
            ways.append(so_far)
        for n in range(1, len(text) - at + 1):
            if (p := text[at : at + n]) in pieces:
                split(at + n, (*so_far, pieces[p]))

    split(0, ())
    weight = {w: math.exp(sum(m.weight[i] for i in w)) for w in ways}
    total = sum(weight.values())
    for w in ways:
        assert abs(drawn[w] / 20_000 - weight[w] / total) < 0.02


def test_scores(docs, small_chunks):
    got = {r.doc_id: r for r in suffix_tree_lm.op7_query(docs).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t, *_ in corpus()}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = c.total(), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_suffix_tree_is_a_distribution(spark):
    tree = suffix_tree_lm.fit(spark.createDataFrame([("a b a b a b c",)] * 40 + [("c c a",)] * 40, "text string"), min_count=5, min_gain=1.0)
    assert np.allclose((10.0 ** tree.logs.astype(float)).sum(axis=1), 1, atol=1e-5)
    assert tree.n_states > 1


def test_suffix_tree_grows_with_the_corpus(spark, small_chunks):
    """Hundreds of words are symbols and their contexts states; scores are those of the tree built in one place."""
    rng = random.Random(5)
    names = [f"word{i}" for i in range(400)]
    # a word tells the next one, and the last but one tells what follows "mid"
    texts = [(i, " ".join(w for _ in range(20) for k, r in [(rng.randrange(200), rng.randrange(5))] for w in (names[2 * k], names[2 * k + 1], rng.choice(["", "rare%d" % rng.randrange(900), "the"]), f"left{r}", "mid", f"right{r}"))) for i in range(400)]
    docs = spark.createDataFrame([*texts, (900, None), (901, "word0 word1 new")], "doc_id bigint, text string")
    options = {"min_count": 10, "min_gain": 5.0}
    got = {r.doc_id: r for r in suffix_tree_lm.score_texts(docs, **options).collect()}
    held = {i: r.held_out for i, r in got.items()}
    tree = suffix_tree_lm.fit(docs.where(~suffix_tree_lm.held_out("doc_id", 10, 0)).select("text"), **options)
    assert len(tree.symbol) > 350 and any(len(s) == 1 and s[0] > 127 for s in tree.state) and any(len(s) > 1 for s in tree.state)
    assert (tree.symbol[b"left0"], tree.symbol[b"mid"]) in tree.state
    rows = {r.doc_id: [*suffix_tree_lm.words_of([r.text])[0]] for r in docs.collect()}
    c = Counter(w for i, ws in rows.items() if not held[i] for w in ws)
    common, once = sum(n for w, n in c.items() if w not in tree.symbol), sum(n == 1 for n in c.values())
    for i, ws in rows.items():
        want = sum(p for _, p in tree.log_probs(ws))
        want += sum(math.log10((c[w] or once + 1) / (common + once + 1)) for w in ws if w not in tree.symbol)
        assert math.isclose(got[i].score, want, rel_tol=1e-6), i


def test_exact_dedup(spark, docs):
    got = {r.doc_id: r for r in exact_dedup.op8_query(docs).collect()}
    low = {i: (t or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}) for i, t, *_ in corpus()}
    for i, t in low.items():
        same = [j for j, u in low.items() if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    odd = spark.createDataFrame([(None, "x"), (None, "X"), (1, "y"), (1, "y"), (2, "É"), (3, "é")], "doc_id bigint, text string").withColumn("salt", F.lit(0)).withColumn("keep_id", F.lit(0))
    assert exact_dedup.exact_groups(odd).count() == 6
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.dedup(odd).collect())[1:] == [(1, "y"), (2, "É"), (3, "é")]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(docs, small_chunks, size, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs, size, percent).collect()}
    assert got == jaccard_join.brute_force([(i, t) for i, t, *_ in corpus()], size, percent)


@pytest.mark.parametrize(("hot", "block"), [(32, 256), (2, 4)])
def test_jaccard_links_between_components(spark, monkeypatch, hot, block):
    """Without the first pass every link must come from the prefix filters: by pairs, or by blocks of families."""
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "links_by_head", lambda nodes, percent: nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false"))
    rng = random.Random(11)
    base = [prose(rng, 80).split() for _ in range(4)]
    rows = []
    for i in range(40):
        w = list(base[i % 4])
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = f"w{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(df, 3, 90).collect()}
    assert got == jaccard_join.brute_force(rows, 3, 90)


def test_repeats(docs, small_chunks):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op10_query(docs).collect()}
    assert got == repeats.brute_force([(i, t) for i, t, *_ in corpus()])


def test_repeats_of_few_letters(spark, small_chunks):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["ab", "abc", "a", "ba"]) for _ in range(rng.randint(0, 200)))) for i in range(40)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op10_query(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == repeats.brute_force(rows)


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES))
def test_empty_and_odd_tables(spark, tmp_path, name):
    """No rows; then nulls in every column, repeated rows and columns whose names operators use themselves."""
    extra = {c: F.lit(1) for c in ("chunk", "norm", "salt", "length", "rank", "id", "node", "component", "n", "tokens", "held_out", "score", "kept", "sequence_id", "digest")}
    empty, odd = tmp_path / "empty", tmp_path / "odd"
    d = spark.createDataFrame([], SCHEMA)
    e = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    d.write.parquet(f"{empty}/documents.parquet")
    e.write.parquet(f"{empty}/embeddings.parquet")
    assert queries.QUERIES[name](spark, str(empty)).count() == 0
    text = "the river and the stone of the morning garden " * 3
    rows = [(None, None, None, None, None), (1, text, "en", None, None), (1, text, "en", None, None), (2, text, None, "s", 1), (None, text, "en", "s", 1), (None, None, None, None, None), (3, "", "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).withColumns(extra).write.parquet(f"{odd}/documents.parquet")
    vectors = [(None, None, None), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (3, [2.0, 4.0], 1)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").withColumns(extra).write.parquet(f"{odd}/embeddings.parquet")
    assert queries.QUERIES[name](spark, str(odd)).count() == (len(vectors) if "embedding" in name else len(rows))
