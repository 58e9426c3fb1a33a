"""Language-model scoring with a probabilistic suffix tree over words.

A text is its words (A-Z lower-cased) and an end. The tree's symbols are all words that training has ``min_count`` times,
the end (which also fills the context before the first word) and one symbol for all other words. A context of up to
``DEPTH`` symbols becomes a state when its own suffix is one, the part before its last symbol was tested too, it was seen ``min_count`` times and its next-symbol distribution diverges from
that of its suffix: the code length that it saves must reach ``min_gain`` nats, where each next symbol is predicted from
all others (its own count is left out), so that a context does not pass by what it has seen once. Distributions are smoothed
with that of the next shorter state, and each symbol is predicted in the state of the longest retained suffix before it. A word
under the common symbol then has probability c / (n + m), c its training count, n that of all such words and m the number of words seen once, the
mass that Good and Turing leave to new words; any word that training does not have counts as one and the same new word,
as in the baseline. So the score is the log10 of a proper probability over the same events as the word-frequency
baseline beside it.

Neither symbols nor states are limited in number: the tree grows with the corpus and never meets in one place. Chunks of
documents ask for the counts of their own words, then, one symbol longer each time, for those of their own continuations of
contexts that may be states, and for the gain of these contexts (see exchange). Words are asked for by 64-bit hashes,
contexts by as many bits as make it improbable (one in a million) that one of the corpus's continuations shares its
hash with another, 64 at most.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, release
from palimpsest.llm.exchange import MESSAGE, PACKING, buckets, chunked, messages, mix
from palimpsest.llm.langid import held_out

DEPTH = 3
END, OTHER = 0, 1  # symbols; those of words follow
CHUNK_BYTES = 8 << 20
FLAT = 0.1  # added to each symbol's count where there is no context


def words_of(texts: list[str | None]) -> list[list[bytes]]:
    """Runs of anything but space and tab to carriage return; null: none."""
    return [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]


@dataclass
class SuffixTree:
    symbol: dict[bytes, int]  #: of the words that have their own
    state: dict[tuple[int, ...], int]  #: of each retained context, oldest symbol first
    logs: np.ndarray  #: log10 probability of each symbol in each state
    n_states: int

    def log_probs(self, words: list[bytes]) -> list[tuple[int, float]]:
        """Each word's and the end's symbol and its log10 probability."""
        ctx, out = (END,) * DEPTH, []
        for s in (*(self.symbol.get(w, OTHER) for w in words), END):
            row = next(self.state[ctx[i:]] for i in range(DEPTH + 1) if ctx[i:] in self.state)
            out.append((s, float(self.logs[row, s])))
            ctx = (*ctx[1:], s)
        return out


def fit(texts: DataFrame, min_count: int = 50, min_gain: float = 30.0, weight: float = 8.0) -> SuffixTree:
    """The tree of ``score_texts`` by brute force in one place, for small tables. ``texts``: one text column, null counts as empty."""
    split = words_of([r[0] for r in texts.collect()])
    symbol = {w: i for i, w in enumerate(sorted(w for w, n in Counter(w for ws in split for w in ws).items() if n >= min_count), 2)}
    counts: dict[tuple[int, ...], Counter[int]] = {(): Counter()}
    for ws in split:
        ctx = (END,) * DEPTH
        for s in (*(symbol.get(w, OTHER) for w in ws), END):
            for i in range(DEPTH + 1):
                counts.setdefault(ctx[i:], Counter())[s] += 1
            ctx = (*ctx[1:], s)
    kept, tested = {()}, {()}
    for ctx in sorted(counts, key=len):
        c = counts[ctx]
        if ctx and ctx[1:] in kept and ctx[:-1] in tested and (total := c.total()) >= min_count:
            tested.add(ctx)
            shorter, saved = counts[ctx[1:]], 0.0
            for s, n in c.items():
                q = shorter[s] / shorter.total()
                saved += n * (math.log((n - 1 + weight * q) / (total - 1 + weight)) - math.log(q))
            if saved >= min_gain:
                kept.add(ctx)
    state = {ctx: i for i, ctx in enumerate(sorted(kept, key=lambda c: (len(c), c)))}
    p = np.zeros((len(state), len(symbol) + 2))
    for ctx, i in state.items():
        c = np.array([counts[ctx][s] for s in range(p.shape[1])], float)
        shorter = next((p[state[ctx[k:]]] for k in range(1, len(ctx) + 1) if ctx[k:] in state), None)
        p[i] = (c + FLAT) / (c.sum() + FLAT * len(c)) if shorter is None else (c + weight * shorter) / (c.sum() + weight)
    return SuffixTree(symbol, state, np.log10(p), len(state))


END_WORD = b"\n"  # no word holds white space
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def bundle(*arrays: np.ndarray) -> bytes:
    """Arrays of known types in one compressed string, each with its first bytes before its second ones."""
    sizes = np.array([len(a) for a in arrays], "<u4").tobytes()
    raw = sizes + b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays)
    return len(raw).to_bytes(8, "little") + PACKING.compress(raw, asbytes=True)


def unbundle(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = PACKING.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)
    out, at = [], 4 * len(kinds)
    for size, kind in zip(np.frombuffer(raw, "<u4", len(kinds)).tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T).reshape(-1).view(kind))
        at += size * width
    return out


class ChunkWords:
    """The documents of a chunk as word numbers; distinct words in ascending order of their hashes. The end is a word."""

    def __init__(self, t: pa.Table):
        texts = [x.lower() for x in t["text"].cast(pa.large_binary()).to_pylist()]
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)  # each text ends in white space
        inner = ~SPACE[raw]
        edge = np.flatnonzero(np.diff(inner, prepend=False))  # where words begin and end, by turns
        before, cut = edge[::2], np.concatenate(([0], np.cumsum(edge[1::2] - edge[::2])))
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(before), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(raw[inner])])
        coded = flat.dictionary_encode()
        _, ends, letters = coded.dictionary.buffers()
        at, letters = np.frombuffer(ends, np.int64, len(coded.dictionary) + 1).tolist() if ends else [0], letters.to_pybytes() if letters else b""
        hashes = np.array([*(xxhash.xxh3_64_intdigest(letters[a:b]) for a, b in zip(at, at[1:], strict=False)), xxhash.xxh3_64_intdigest(END_WORD)], np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        upto = np.searchsorted(before, np.cumsum([len(x) + 1 for x in texts]))  # words up to the end of each text
        self.hashes, self.words = hashes[order], np.insert(rank[coded.indices.to_numpy()], upto, rank[-1])
        self.sizes = np.diff(upto, prepend=0) + 1
        self.starts = np.cumsum(self.sizes) - self.sizes


def asked(hashes: np.ndarray, values: np.ndarray, chunk: int, n: int) -> list[tuple[int, int, bytes]]:
    """One message to each bucket about ascending distinct hashes, a value for each."""
    return [(b, chunk, bundle(np.diff(hashes[s], prepend=np.uint64(0)), values[s])) for b, s in buckets(hashes, n)]


def received(t: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """What a bucket was sent, by chunk: number of each entry's hash, values, distinct hashes and where messages end."""
    sent = [unbundle(x, "<u8", kind) for x in t["data"].to_pylist()]
    hashes, at = np.unique(np.concatenate([np.cumsum(h, dtype=np.uint64) for h, _ in sent]), return_inverse=True)
    return at, np.concatenate([v for _, v in sent]), hashes, np.cumsum([len(v) for _, v in sent])[:-1].tolist()


def answers_to(asks: DataFrame, kind: str, step: int, resolve) -> DataFrame:
    """(step, bucket, chunk, data): for each message what resolve makes of its hashes' sums over all chunks and its own values."""

    def answer(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")  # sums of doubles do not depend on the order of arrival
        at, values, hashes, ends = received(t, kind)
        sums = np.zeros(len(hashes), "<f8" if kind == "<f4" else kind)
        np.add.at(sums, at, values)
        parts = [bundle(x) for x in np.split(resolve(sums[at], values), ends)]
        return pa.table([pa.array([step] * len(parts), pa.int32()), t["bucket"], t["chunk"], pa.array(parts, pa.binary())], names=["step", "bucket", "chunk", "data"])

    return materialize(asks.groupBy("bucket").applyInArrow(answer, "step int, bucket int, chunk int, data binary"))


def numbered(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key stands first, by ascending keys, and the number of each one's own. ``bound``: above all keys.

    One sort of keys with their places behind them, which takes a third of the time of a hash table or of an argsort."""
    bits = len(keys).bit_length()
    if bound << bits > 1 << 63:
        _, first, number = np.unique(keys, return_index=True, return_inverse=True)
        return first, number
    both = keys << bits
    both |= np.arange(len(keys))
    both.sort()
    at = both & ((1 << bits) - 1)
    both >>= bits
    new = np.diff(both, prepend=-1) != 0
    number = np.empty(len(keys), np.int64)
    number[at] = np.cumsum(new) - 1
    return at[new], number


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of values and the place of each in it."""
    order = np.argsort(values)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return order, rank


def by_frequency(tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of n symbols, the first one first and the others by how often tokens have them, and the tokens as places in it.

    So most tokens are small numbers, which take a fifth less when they are packed."""
    order = np.concatenate(([0], 1 + np.argsort(-np.bincount(tokens, minlength=n)[1:], kind="stable")))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place[tokens]


class ChunkGrams:
    """The symbols of a chunk's documents in their contexts, and what the answers so far tell of them.

    By depth, for the place of each symbol: ``total``, how often training has the context before it, 0 if that cannot be a
    state; ``seen``, how often it has the symbol there; ``state``, whether the context is one.

    A context and the symbol behind it are the context, one symbol longer, of the next place: so places are numbered once a
    depth, and only distinct contexts and grams are hashed and sorted. All steps read the answers before anew, so this counts."""

    def __init__(self, state: bytes, n: int, min_count: int, weight: float, short: np.uint64, back: pa.Table | None = None):
        self.ids, self.counts, self.tokens, sizes, train, self.totals = unbundle(state, "<u8", "<i8", "<u4", "<i8", "|u1", "<i8")
        self.n, self.min_count, self.weight, self.short = n, min_count, weight, short
        self.train = np.repeat(train.astype(bool), sizes)
        self.starts = np.cumsum(sizes) - sizes
        self.docs = int(self.counts[0])  # the end comes first among the symbols
        self.named = mix((self.ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        self.back: dict[int, dict[int, bytes]] = {}
        if back is not None:
            for step, b, data in zip(back["step"].to_pylist(), back["bucket"].to_pylist(), back["data"].to_pylist(), strict=True):
                self.back.setdefault(step, {})[b] = data
        self.seen, self.total, self.state = [self.counts[self.tokens]], [np.full(len(self.tokens), self.totals[0])], [np.ones(len(self.tokens), bool)]
        # what the next place's context is: a number and the hash of each number; of the first place, ends only
        self.behind, self.hashed, self.outset = self.tokens.astype(np.int64), mix(self.named + np.uint64(1)), END

    def answered(self, step: int, hashes: np.ndarray, kind: str) -> np.ndarray:
        out, got = np.zeros(len(hashes), kind), self.back.get(step, {})
        for b, s in buckets(hashes, self.n):
            (out[s],) = unbundle(got[b], kind)
        return out

    def deepen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts one symbol longer: the places whose context may be a state, their distinct grams' hashes, each place's gram."""
        self.context, self.contexts = np.empty_like(self.behind), self.hashed
        self.context[1:] = self.behind[:-1]
        self.context[self.starts] = self.outset
        total = np.empty_like(self.seen[-1])
        total[1:] = self.seen[-1][:-1]  # the gram that ends in the context's last symbol was asked for at the place before
        total[self.starts] = self.docs
        possible = (total >= self.min_count) & self.state[-1]
        total *= possible
        self.total.append(total)
        self.at = at = np.flatnonzero(possible)
        context, tokens = self.context[at], self.tokens[at]
        first, number = numbered(context * len(self.ids) + tokens, len(self.contexts) * len(self.ids))
        grams = mix(self.contexts[context[first]] * np.uint64(0xC2B2AE3D27D4EB4F) + self.named[tokens[first]])
        order, rank = ranked(grams)
        grams, number = grams[order], rank[number]
        self.behind = np.zeros_like(self.behind)
        self.behind[at] = number
        ends = mix(self.contexts[[self.outset]] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(len(self.total)))
        self.hashed, self.outset = np.concatenate((grams, ends)), len(grams)
        return at, grams >> self.short << self.short, number

    def own(self, at: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        """How often this chunk's training texts have each of n grams."""
        return np.bincount(gram[self.train[at]], minlength=n).astype("<i8", copy=False)

    def count(self) -> None:
        """The answer says what the other chunks have, mostly nothing: it is small, and every later step reads it again."""
        at, hashes, gram = self.deepen()
        seen = np.zeros(len(self.tokens), np.int64)
        seen[at] = (self.answered(2 * len(self.seen) - 1, hashes, "<i8") + self.own(at, gram, len(hashes)))[gram]
        self.seen.append(seen)

    def possible(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places whose deepest context may be a state, these distinct contexts' hashes, each place's."""
        context, there = self.context[self.at], np.zeros(len(self.contexts), bool)
        there[context] = True
        distinct = np.flatnonzero(there)
        hashes = self.contexts[distinct] >> self.short << self.short
        order, rank = ranked(hashes)
        number = np.zeros(len(there), np.int64)
        number[distinct] = rank
        return self.at, hashes[order], number[context]

    def judge(self) -> None:
        at, hashes, number = self.possible()
        state = np.zeros(len(self.tokens), bool)
        state[at] = self.answered(2 * (len(self.seen) - 1), hashes, "|u1").astype(bool)[number]
        self.state.append(state)

    def ask_counts(self, chunk: int) -> list[tuple[int, int, bytes]]:
        at, hashes, gram = self.deepen()
        return asked(hashes, self.own(at, gram, len(hashes)), chunk, self.n)

    def ask_gains(self, chunk: int) -> list[tuple[int, int, bytes]]:
        """Code length that each of the deepest contexts saves in this chunk's training texts."""
        at, hashes, number = self.possible()
        learnt = self.train[at]
        number, at = number[learnt], at[learnt]
        q = self.seen[-2][at] / self.total[-2][at]
        saved = np.log((self.seen[-1][at] - 1 + self.weight * q) / (self.total[-1][at] - 1 + self.weight)) - np.log(q)
        return asked(hashes, np.bincount(number, weights=saved, minlength=len(hashes)).astype("<f4"), chunk, self.n)

    def log_probs(self) -> np.ndarray:
        """Of each symbol, in the state of its longest retained context."""
        p = (self.seen[0] + FLAT) / (self.totals[0] + FLAT * self.totals[1])
        for seen, total, s in zip(self.seen[1:], self.total[1:], self.state[1:], strict=True):
            p[s] = (seen[s] + self.weight * p[s]) / (total[s] + self.weight)
        return np.log10(p)


def score_texts(docs: DataFrame, folds: int = 10, fold: int = 0, id_col: str = "doc_id", text_col: str = "text", add: float = 0.1, min_count: int = 50, min_gain: float = 30.0, weight: float = 8.0) -> DataFrame:
    """One row per input row: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from rows whose crc32(id as text) mod ``folds`` is not ``fold``; a null id counts as empty text. Null text is
    empty: one end. base_score is the add-``add`` word-frequency score, score the suffix tree's; both log10. Rows may
    repeat: each is counted and scored for itself. Texts are read whole, however long. Other columns are ignored, whatever
    their names; an empty table gives an empty result. weight: of the shorter state's distribution."""
    rows, n = chunked(docs, id_col, text_col, CHUNK_BYTES)
    # DEPTH continuations for each word at most, of two bytes with its space
    short = np.uint64(max(0, 44 - (n * CHUNK_BYTES * DEPTH // 2).bit_length()))
    by_chunk = rows.withColumn("held_out", held_out("doc_id", folds, fold)).groupBy("chunk")
    sums = ("tokens", "distinct", "once", "symbols", "common")
    schema = "bucket int, chunk int, data binary, " + ", ".join(f"{s} bigint" for s in sums)
    end_hash = np.uint64(xxhash.xxh3_64_intdigest(END_WORD))

    def ask(t: pa.Table) -> pa.Table:
        c = ChunkWords(t)
        train = np.repeat(~t["held_out"].to_numpy(zero_copy_only=False).astype(bool), c.sizes)
        return messages(asked(c.hashes, np.bincount(c.words[train], minlength=len(c.hashes)).astype("<i8"), t["chunk"][0].as_py(), n))

    def count(t: pa.Table) -> pa.Table:
        at, values, hashes, ends = received(t, "<i8")
        total = np.zeros(len(hashes), np.int64)
        np.add.at(total, at, values)
        is_end = hashes == end_hash
        frequent = (total >= min_count) & ~is_end
        # symbols are numbered within buckets, so that no two buckets give the same number
        symbol = np.where(is_end, END, OTHER).astype("<u8")
        symbol[frequent] = 2 + np.arange(np.count_nonzero(frequent)) * n + t["bucket"][0].as_py()
        parts = [bundle(total[i], symbol[i]) for i in np.split(at, ends)]
        # the sums of the bucket stand in its first row
        found = (total.sum(), np.count_nonzero(total), np.count_nonzero(total == 1), np.count_nonzero(frequent), total[symbol == OTHER].sum())
        own = [[int(x)] + [0] * (t.num_rows - 1) for x in found]
        return pa.table([t["bucket"], t["chunk"], pa.array(parts, pa.binary()), *(pa.array(x, pa.int64()) for x in own)], names=["bucket", "chunk", "data", *sums])

    # written, so that the questions are gone and the texts are dealt anew before states are written beside them
    counted = materialize(by_chunk.applyInArrow(ask, MESSAGE).groupBy("bucket").applyInArrow(count, schema))
    totals = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums])
    answers = counted.select("bucket", "chunk", "data", *[totals.select(c).scalar().alias(c) for c in sums])
    id_type = dict(rows.dtypes)["doc_id"]
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "within"]

    def number(t: pa.Table, back: pa.Table) -> pa.Table:
        c, got = ChunkWords(t), dict(zip(back["bucket"].to_pylist(), back["data"].to_pylist(), strict=True))
        total, distinct, once, symbols, common = (back[x][0].as_py() for x in sums)
        known, symbol = np.zeros(len(c.hashes), np.int64), np.zeros(len(c.hashes), np.uint64)
        for b, s in buckets(c.hashes, n):
            known[s], symbol[s] = unbundle(got[b], "<i8", "<u8")
        base = (np.log10(known + add) - np.log10(total + add * (distinct + 1)))[c.words]
        within = np.where(symbol == OTHER, np.log10(np.where(known > 0, known, once + 1)) - np.log10(common + once + 1), 0.0)
        ids, first, place = np.unique(symbol, return_index=True, return_inverse=True)
        counts = np.where(ids == OTHER, common, known[first])
        order, tokens = by_frequency(place[c.words], len(ids))
        train = ~t["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        state = bundle(ids[order], counts[order], tokens.astype("<u4"), c.sizes, train.astype(np.uint8), np.array([total, symbols + 2]))
        n_known, bases, withins = (np.add.reduceat(x, c.starts) for x in ((known > 0)[c.words].astype(np.int64), base, within[c.words]))
        made = [t["doc_id"].combine_chunks(), t["held_out"].combine_chunks(), pa.array(c.sizes), pa.array(n_known), pa.array(np.full(len(c.sizes), total)), pa.array(bases), pa.array(withins)]
        ends = pa.array([0, len(c.sizes)], pa.int32())
        return pa.table([t["chunk"][:1], pa.array([state], pa.binary()), *(pa.ListArray.from_arrays(ends, x) for x in made)], names=["chunk", "state", *columns])

    kinds = [id_type, "boolean", "bigint", "bigint", "bigint", "double", "double"]
    chunks = materialize(by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(number, "chunk int, state binary, " + ", ".join(f"{c} array<{k}>" for c, k in zip(columns, kinds, strict=True))))
    release(counted)
    states = chunks.select("chunk", "state")

    def grams(t: pa.Table, back: pa.Table, answers: int) -> ChunkGrams:
        g = ChunkGrams(t["state"][0].as_py(), n, min_count, weight, short, back)
        for step in range(1, answers + 1):
            g.count() if step % 2 else g.judge()
        return g

    def asks(known: DataFrame, answers: int, of) -> DataFrame:
        def run(t: pa.Table, back: pa.Table) -> pa.Table:
            return messages(of(grams(t, back, answers), t["chunk"][0].as_py()))

        return states.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, MESSAGE)

    def first_asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nothing is answered yet, so states are read where they lie."""
        for b in batches:
            for chunk, state in zip(b.column(0), b.column(1), strict=True):
                yield from messages(ChunkGrams(state.as_py(), n, min_count, weight, short).ask_counts(chunk.as_py())).to_batches()

    known = None
    for step in range(1, 2 * DEPTH, 2):
        questions = states.mapInArrow(first_asks, MESSAGE) if known is None else asks(known, step - 1, ChunkGrams.ask_counts)
        counts = answers_to(questions, "<i8", step, lambda total, own: total - own)
        known = counts if known is None else known.unionByName(counts)
        known = known.unionByName(answers_to(asks(known, step, ChunkGrams.ask_gains), "<f4", step + 1, lambda saved, own: (saved >= min_gain).astype("|u1")))

    def score(t: pa.Table, back: pa.Table) -> pa.Table:
        each = grams(t, back, 2 * DEPTH).log_probs()
        made = [t[c].combine_chunks().flatten() for c in columns]
        sizes = made[2].to_numpy()
        tree = np.add.reduceat(each, np.cumsum(sizes) - sizes) + made[-1].to_numpy()
        return pa.table([*made[:-1], pa.array(tree)], names=[*columns[:-1], "score"])

    result = f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, result)


def op7_query(docs: DataFrame) -> DataFrame:
    """All documents, those of fold 0 of 10 held out; nulls, repeats and empty tables as in ``score_texts``."""
    return score_texts(docs)
