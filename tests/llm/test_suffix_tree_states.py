"""op7: what is written between steps."""

from __future__ import annotations

import numpy as np

from palimpsest.llm import suffix_tree_lm


def test_states_and_first_questions(spark, monkeypatch):
    """A chunk's symbols are numbered by how often it has them; texts are not kept beside states; the first questions are asked where states lie."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(words[min(299, int(299 * u**4))] for u in rng.random(200))) for i in range(200)], "doc_id bigint, text string")
    written, materialize = [], suffix_tree_lm.materialize

    def seen(df):
        made = materialize(df)
        tokens = []
        if "state" in df.columns:
            tokens = [suffix_tree_lm.unbundle(bytes(r.state), "<u8", "<i8", "<u4", "<i8", "|u1", "<i8")[2] for r in made.select("state").collect()]
        written.append((df._jdf.queryExecution().toString(), df.columns, tokens))
        return made

    monkeypatch.setattr(suffix_tree_lm, "materialize", seen)
    assert suffix_tree_lm.score_texts(docs, min_count=5, min_gain=1.0).count() == 200
    at = next(i for i, (_, columns, _) in enumerate(written) if "state" in columns)
    for tokens in written[at][2]:
        often = np.bincount(tokens)[1:]
        assert len(often) > 20 and (np.diff(often) <= 0).all()
    assert at == 1 and "hashpartitioning(bucket" not in written[at][0]
    assert "hashpartitioning(bucket" in written[at + 1][0] and "hashpartitioning(chunk" not in written[at + 1][0]


def test_places_are_numbered_and_only_distinct_grams_hashed(monkeypatch):
    """Each step reads the answers before anew, so what it does for every place must be little."""
    rng = np.random.default_rng(5)
    sizes = np.array([1, 2, 1, 500, 3, 493])
    tokens = rng.integers(1, 9, sizes.sum()).astype("<u4")
    tokens[np.cumsum(sizes) - 1] = suffix_tree_lm.END
    ids = np.arange(9, dtype="<u8") * 7
    state = suffix_tree_lm.bundle(ids, np.bincount(tokens, minlength=9), tokens, sizes, np.ones(len(sizes), np.uint8), np.array([len(tokens), 9]))
    hashed, mix = [], suffix_tree_lm.mix
    monkeypatch.setattr(suffix_tree_lm, "mix", lambda x: (hashed.append(len(x)), mix(x))[1])
    g = suffix_tree_lm.ChunkGrams(state, 1, 1, 8.0, np.uint64(0))
    padded = [[0, 0, 0, *tokens[e - n : e].tolist()] for n, e in zip(sizes, np.cumsum(sizes), strict=True)]
    for depth in (1, 2):
        at, hashes, gram = g.deepen()
        want = [tuple(t[i - depth : i + 1]) for t in padded for i in range(3, len(t))]
        assert at.tolist() == list(range(len(tokens)))
        # one number for each gram of symbols, and one gram for each number
        assert len(set(zip(want, gram.tolist(), strict=True))) == len(set(want)) == len(set(gram.tolist())) == len(hashes)
        assert (np.diff(hashes) > 0).all()
        _, contexts, number = g.possible()
        assert len(set(zip([w[:-1] for w in want], number.tolist(), strict=True))) == len(set(number.tolist())) == len(contexts)
        g.seen.append(g.own(at, gram, len(hashes))[gram])
        g.state.append(np.ones(len(tokens), bool))
    assert max(hashed) < len(tokens)


def test_numbers_of_keys_too_long_for_one_sort():
    keys = np.array([5, 1, 5, 9, 1, 0])
    for bound in (10, 1 << 62):
        first, number = suffix_tree_lm.numbered(keys, bound)
        assert first.tolist() == [5, 1, 0, 3] and number.tolist() == [2, 1, 2, 3, 1, 0]
    assert [len(x) for x in suffix_tree_lm.numbered(keys[:0], 10)] == [0, 0]
