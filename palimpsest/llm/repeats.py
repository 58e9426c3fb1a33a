"""Removal of repeated byte strings, by longest-previous-factor arrays over a sparse suffix order.

A byte goes when a ``min_len``-byte string that covers it also starts in a document with a smaller id. In terms of
suffixes: the suffix at the string's first byte has a previous factor of at least ``min_len`` bytes in an earlier
document. Only that bound matters, so suffixes are ordered by their first ``min_len`` bytes. Neighbours in the order with a
common prefix (LCP) of ``min_len`` form a run; the entries of a run stand in the order of their documents, so an entry's previous
smaller entry, if there is one, is in its run, its next smaller one never is, and the longest previous factor reaches
``min_len`` where the run began with an earlier document.

Putting all suffixes of a corpus in order would move some ``min_len`` bytes and an id for each of its bytes. Three steps, in one
query, avoid that:
1. anchors: the least-hashed ``GRAM``-byte strings of every ``min_len``-byte window. Equal windows have equal anchors, so a
   window whose anchor occurs in one document only has no previous factor. Chunks ask which anchors are shared.
2. around every shared anchor, the bytes that a window through it can reach are sent to the anchor's bucket (equal
   surroundings within a chunk once). There one order of the suffixes at the anchors and one of what stands before them,
   with their LCPs, give the runs of the suffixes that start 0, 1, ... bytes before the anchor. Windows through an anchor
   that more than ``HOT`` chunks have are sent themselves (equal ones within a chunk once), to buckets of their own, so
   that the many surroundings of a frequent line do not meet in one place; they are put in order there.
3. chunks get a bitmask for each anchor, or a bit for each window - which have a previous factor - and cut the bytes.

Hashes choose anchors and buckets; whether strings are equal is decided by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.exchange import MESSAGE, MESSAGE_SCHEMA, ask_shared, answered, buckets, chunked, messages, mix, packed, seen_by_others, unpacked

MIN_LEN = 50
GRAM = 32
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: An anchor that more chunks have sends its windows each to a bucket of its own.
HOT = 100
SHARED, ENTRIES, WINDOWS = 0, 1, 2
KINDS = MESSAGE_SCHEMA.append(pa.field("kind", pa.int32()))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best() of every ``width`` neighbours."""
    done, out = 1, x
    while done * 2 <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    return best(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


class Chunk:
    """The documents of a chunk by id, their bytes end to end, and their anchors."""

    def __init__(self, t: pa.Table, min_len: int, gram: int):
        ids, texts = t["doc_id"].to_pylist(), t["text"].to_pylist()
        raw = [x.encode("utf-8", "surrogatepass") for x in texts]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, raw[i]))
        self.ids = [ids[i] for i in order]
        self.raw = b"".join(raw[i] for i in order)
        self.bytes = np.frombuffer(self.raw, dtype=np.uint8)
        self.ends = np.cumsum([len(raw[i]) for i in order], dtype=np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1]))
        # a null id comes before all others
        self.rank = np.array([-(1 << 63) if i is None else i for i in self.ids], dtype=np.int64)
        self.reach, n = min_len - gram, len(self.raw)
        self.sums = np.zeros(n + 1, np.uint64)
        spread = powers(BASE, max(n, 1))[:n]
        spread *= byte_codes()[self.bytes]
        np.cumsum(spread, out=self.sums[1:])
        del spread
        self.back = powers(BASE_INVERSE, n + 1)
        self.at, self.hash, self.doc = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n >= min_len:
            h = self.sums[gram:] - self.sums[: n - gram + 1]
            h *= self.back[: n - gram + 1]
            h = mix(h)
            for i in range(1, gram):  # strings over the end of a document are no anchors
                over = self.ends - i
                h[over[(over >= 0) & (over < len(h))]] = NONE
            least = sliding(h, self.reach + 1, np.minimum)
            pad = np.zeros(self.reach, np.uint64)
            least = sliding(np.concatenate((pad, least, pad)), self.reach + 1, np.maximum)
            self.at = np.flatnonzero((least[: len(h)] == h) & (h != NONE))
            del least
            self.hash = mix(h[self.at])  # anchors are the least of their neighbours; mixed again they fill all buckets alike
            self.doc = np.searchsorted(self.ends, self.at, side="right")

    def hashes(self, at: np.ndarray, length) -> np.ndarray:
        """A hash of the ``length`` bytes from each place; the same wherever these bytes stand."""
        return (self.sums[at + length] - self.sums[at]) * self.back[at]

    def uniq(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distinct anchors; whether each is in several documents here."""
        if not len(self.hash):
            return self.hash, np.zeros(0, bool)
        order = np.lexsort((self.doc, self.hash))
        h, d = self.hash[order], self.doc[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        last = np.append(first[1:], len(h)) - 1
        return h[first], self.rank[d[last]] > self.rank[d[first]]

    def same(self, at: np.ndarray, length: int) -> np.ndarray:
        """Are the bytes from each place the same as from the one before it in ``at``?"""
        out = np.zeros(len(at), bool)
        for lo in range(0, len(at), 1 << 16):
            rows = self.bytes[at[max(0, lo - 1) : lo + (1 << 16), None] + np.arange(length)]
            out[max(1, lo) : lo + (1 << 16)] = (rows[1:] == rows[:-1]).all(axis=1)
        return out

    def shared(self, n: int, answers: dict[int, bytes], gram: int) -> None:
        """Keep the anchors that several documents have, and their surroundings: ``here`` numbers equal surroundings of
        an anchor, ``lead`` is their first place, in ascending order of the anchor, ``hot`` says if many chunks have the anchor."""
        uniq, several = self.uniq()
        often = answered(uniq, n, answers, 1) if len(uniq) else several
        several = several | answered(uniq, n, answers) if len(uniq) else several
        which = np.searchsorted(uniq, self.hash)
        keep = several[which]
        self.at, self.hash, self.doc, often = self.at[keep], self.hash[keep], self.doc[keep], often[which[keep]]
        self.left = np.minimum(self.at - self.starts[self.doc], self.reach)
        self.right = np.minimum(self.ends[self.doc] - self.at - gram, self.reach)
        around = mix(self.hashes(self.at - self.left, self.left + gram + self.right) ^ mix((self.left * 256 + self.right + 1).astype(np.uint64)))
        order = np.lexsort((self.at, around, self.hash))
        same = np.zeros(len(order), bool)
        whole = (self.left[order] == self.reach) & (self.right[order] == self.reach)
        same[whole] = self.same((self.at - self.reach)[order[whole]], gram + 2 * self.reach)  # others are few and sent each
        h, c = self.hash[order], around[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | ~same[1:] | ~whole[:-1]))[: len(h)]
        self.lead = order[new]
        self.here = np.empty(len(h), np.int64)
        self.here[order] = np.cumsum(new) - 1
        self.hot = often[self.lead]

    def windows(self, length: int) -> None:
        """The distinct windows through the hot leads, in ascending order of their hashes: ``own`` lists (lead, bytes
        before the anchor, number of the window) of all; a window has its place, hash and smallest document."""
        lead, before = [], []
        hot = np.flatnonzero(self.hot)
        left, right = self.left[self.lead[hot]], self.right[self.lead[hot]]
        for a in range(self.reach + 1):
            some = hot[(left >= a) & (right >= self.reach - a)]
            lead.append(some)
            before.append(np.full(len(some), a))
        lead, before = np.concatenate(lead), np.concatenate(before)
        at = self.at[self.lead[lead]] - before
        h, doc = mix(self.hashes(at, length)), self.rank[self.doc[self.lead[lead]]]
        order = np.lexsort((doc, h))
        new = np.concatenate(([True], h[order][1:] != h[order][:-1]))[: len(order)] | ~self.same(at[order], length)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        self.own, self.window_at, self.window_hash, self.window_doc = (lead, before, number), at[first], h[first], doc[first]


def entry_type(gram: int, reach: int) -> np.dtype:
    """An anchor with its surroundings: the bytes before it, its own and those after it; how many there are on either side."""
    return np.dtype([("doc", "<i8"), ("left", "u1"), ("right", "u1"), ("text", "u1", (gram + 2 * reach,))])


def window_type(length: int) -> np.dtype:
    return np.dtype([("doc", "<i8"), ("text", "u1", (length,))])


def in_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings of one length, and each one's common prefix with the one before it in that order."""
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(f"S{rows.shape[1]}")[:, 0], kind="stable")
    differ = rows[order[1:]] != rows[order[:-1]]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]) if len(order) else np.zeros(0, np.int64)
    return order, np.concatenate(([0], lcp))[: len(order)]


def run_numbers(order: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Number of each string's run of neighbours with common prefixes of at least ``least``."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < least) if least else np.zeros(len(order), np.int64)
    return out


def previous_factors(e: np.ndarray, reach: int) -> np.ndarray:
    """For each entry, bit a: has the suffix that starts a bytes before the anchor a previous factor of a whole window?"""
    n, masks = len(e), np.zeros(len(e), np.uint32)
    after, before = in_order(e["text"][:, reach:]), in_order(e["text"][:, :reach][:, ::-1])
    length = e["text"].shape[1] - reach
    by_doc = np.argsort(e["doc"], kind="stable")
    left, right = e["left"][by_doc], e["right"][by_doc]
    for a in range(reach + 1):
        fits = by_doc[(left >= a) & (right >= reach - a)]
        # equal before the anchor and behind it: a run of the order of these suffixes, by document
        run = run_numbers(*before, a)[fits] * n + run_numbers(*after, length - a)[fits]
        order = np.argsort(run, kind="stable")
        masks[fits[order[later_in_run(run[order], e["doc"][fits[order]])]]] |= np.uint32(1 << a)
    return masks


def later_in_run(run: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Did the run of neighbours with one number begin with an earlier document?"""
    new = np.concatenate(([True], run[1:] != run[:-1]))[: len(run)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return doc[first] < doc


def repeated_windows(w: np.ndarray) -> np.ndarray:
    """For each window: is it in an earlier document too?"""
    by_doc = np.argsort(w["doc"], kind="stable")
    order, lcp = in_order(w["text"][by_doc])
    out = np.zeros(len(w), bool)
    out[by_doc[order]] = later_in_run(np.cumsum(lcp < w["text"].shape[1]), w["doc"][by_doc[order]])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN, gram: int = GRAM) -> DataFrame:
    """One row per input row: (doc_id, n_bytes, n_removed, n_spans, kept binary).

    Texts are UTF-8 bytes, null: empty. Of equal strings the ones in the document with the smallest id stay, so all
    copies inside that document stay. Rows with one id are one document to each other: none removes bytes of another. A null id counts
    as smaller than all others. Texts shorter than ``min_len`` bytes come back whole, long ones are read whole. Ids are
    whole numbers. Other columns are ignored, whatever their names; an empty table gives an empty result."""
    reach = min_len - gram
    if not 0 < reach < 32:
        raise ValueError("min_len - gram must be between 1 and 31")
    rows, n = chunked(docs, id_col, text_col)
    by_chunk, kind, window = rows.groupBy("chunk"), entry_type(gram, reach), window_type(min_len)

    def ask(t: pa.Table) -> pa.Table:
        return messages(ask_shared(Chunk(t, min_len, gram).uniq()[0], t["chunk"][0].as_py(), n))

    answers = seen_by_others(by_chunk.applyInArrow(ask, MESSAGE), (1, HOT)).withColumn("kind", F.lit(SHARED))

    def split(t: pa.Table) -> tuple[dict[int, bytes], ...]:
        got: tuple[dict[int, bytes], ...] = ({}, {}, {})
        for b, x, k in zip(t["bucket"].to_pylist(), t["data"].to_pylist(), t["kind"].to_pylist(), strict=True):
            got[k][b] = x
        return got

    def surroundings(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return KINDS.empty_table()
        c = Chunk(t, min_len, gram)
        c.shared(n, split(back)[SHARED], gram)
        lead = c.lead[~c.hot]
        e, at = np.zeros(len(lead), kind), c.at[lead]
        e["doc"], e["left"], e["right"] = c.rank[c.doc[lead]], c.left[lead], c.right[lead]
        places = np.arange(-reach, gram + reach)
        inside = (places >= -c.left[lead][:, None]) & (places < gram + c.right[lead][:, None])
        e["text"] = np.where(inside, c.bytes[np.clip(at[:, None] + places, 0, max(0, len(c.bytes) - 1))], 0) if len(lead) else 0
        c.windows(min_len)
        w = np.zeros(len(c.window_at), window)
        w["doc"], w["text"] = c.window_doc, c.bytes[c.window_at[:, None] + np.arange(min_len)]
        own = t["chunk"][0].as_py()
        sent = [(b, own, packed(x[s]), k) for k, h, x in ((ENTRIES, c.hash[lead], e), (WINDOWS, c.window_hash, w)) for b, s in buckets(h, n)]
        return pa.Table.from_pylist([dict(zip(KINDS.names, m, strict=True)) for m in sent], schema=KINDS)

    def judge(t: pa.Table) -> pa.Table:
        out = []
        for k, of, decide in ((ENTRIES, kind, lambda e: previous_factors(e, reach)), (WINDOWS, window, repeated_windows)):
            some = t.filter(pa.compute.equal(t["kind"], k))
            if some.num_rows:
                sent = [unpacked(x, of) for x in some["data"].to_pylist()]
                made = np.split(decide(np.concatenate(sent)), np.cumsum([len(x) for x in sent])[:-1])
                out += [dict(bucket=b, chunk=c, data=m.tobytes(), kind=k) for b, c, m in zip(some["bucket"].to_pylist(), some["chunk"].to_pylist(), made, strict=True)]
        return pa.Table.from_pylist(out, schema=KINDS)

    sent = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(surroundings, f"{MESSAGE}, kind int")
    judged = sent.groupBy("bucket").applyInArrow(judge, f"{MESSAGE}, kind int")

    def cut(t: pa.Table, back: pa.Table) -> pa.Table:
        c = Chunk(t, min_len, gram)
        answers, masks, repeated = split(back)
        c.shared(n, answers, gram)
        total = len(c.raw)
        edges = np.zeros(total + 1, np.int32)
        if len(c.at):
            cold, mask = np.zeros(int((~c.hot).sum()), np.uint32), np.zeros(len(c.lead), np.uint32)
            for b, s in buckets(c.hash[c.lead[~c.hot]], n):
                cold[s] = np.frombuffer(masks[b], dtype="<u4")
            mask[~c.hot] = cold
            c.windows(min_len)
            earlier = np.zeros(len(c.window_at), bool)
            for b, s in buckets(c.window_hash, n):
                earlier[s] = np.frombuffer(repeated[b], dtype=bool)
            of, a, number = c.own
            gone = earlier[number] | (c.rank[c.doc[c.lead[of]]] > c.window_doc[number])
            np.bitwise_or.at(mask, of[gone], np.uint32(1) << a[gone].astype(np.uint32))
            lead = c.lead[c.here]
            later = c.rank[c.doc] > c.rank[c.doc[lead]]  # equal surroundings in an earlier document of this chunk
            mask = np.where(later, np.uint32((1 << reach + 1) - 1), mask[c.here])
            for a in range(reach + 1):
                first = c.at[(mask >> np.uint32(a) & 1 == 1) & (c.left >= a) & (c.right >= reach - a)] - a
                edges[first] += 1
                edges[first + min_len] -= 1
        gone = np.cumsum(edges[:total]) > 0
        starts_run = gone.copy()
        starts_run[1:] &= ~gone[:-1]
        starts_run[c.starts[c.starts < total]] = gone[c.starts[c.starts < total]]
        removed, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, starts_run))
        kept = [c.bytes[a:b][~gone[a:b]].tobytes() for a, b in zip(c.starts, c.ends, strict=True)]
        per_doc = [x[c.ends] - x[c.starts] for x in (removed, spans)]
        return pa.table([pa.array(c.ids, t.schema.field("doc_id").type), *map(pa.array, (c.ends - c.starts, *per_doc)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    back = answers.unionByName(judged).groupBy("chunk")
    return by_chunk.cogroup(back).applyInArrow(cut, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op10_query(docs: DataFrame) -> DataFrame:
    """Removed bytes and the digest of the rest; nulls, repeats and empty tables as in ``remove_repeats``."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], min_len: int = MIN_LEN) -> dict[int, tuple[int, int, int, str]]:
    """The contract, word by word, for small tests: distinct ids -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    raw = {d: (t or "").encode() for d, t in docs}
    first: dict[bytes, int] = {}
    for d in sorted(raw):
        for p in range(len(raw[d]) - min_len + 1):
            first.setdefault(raw[d][p : p + min_len], d)
    out = {}
    for d, x in raw.items():
        gone = bytearray(len(x))
        for p in range(len(x) - min_len + 1):
            if first[x[p : p + min_len]] < d:
                gone[p : p + min_len] = b"\1" * min_len
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest())
    return out
