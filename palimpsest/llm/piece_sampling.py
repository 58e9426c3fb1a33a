"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

All segmentations of a text into vocabulary pieces form a lattice; a path's weight is the product of its pieces'
weights. Forward filtering sums the weights of all paths into each place; backward sampling then draws the last
piece, the one before it, and so on, each with its share of that sum. The draws come from a counter-based generator keyed by
(seed, row key, place in the text), so a row's segmentation does not depend on partitions, batches or neighbours.

A space is the mark U+2581 in a piece and stands at its start only, or fills the piece. No piece crosses the border before
a run of spaces, so the lattice falls apart there into units. A worker filters a unit once and keeps its cumulative
shares in a table of bounded size, from which all later occurrences are drawn.
A character that no piece covers, and U+2581 itself, goes to byte pieces. Nothing is normalised, so decoding gives
back every text exactly.

The vocabulary's scores are ranks, not probabilities; a piece of rank r has the weight (r + 1) ** -theta.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_rows
from palimpsest.llm.exchange import mix

MARK = "▁"
#: Spaces and the word behind them.
UNITS = re.compile(r" *[^ ]+| +")
NEXT_UNIT = re.compile(r"(?<=[^ ])(?= )")
#: Characters of text that are drawn at once; characters of filtered units that a worker keeps, at about 60 bytes each.
BLOCK, TABLE_NODES = 1 << 20, 2 << 20
#: Characters of units that are filtered together: their edges, some four each, are arrays of 64-bit numbers meanwhile.
LEARNED = 1 << 18
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: log weight of a byte piece.
BYTE_WEIGHT = -12.0
STEP, ROW = 0x9E3779B97F4A7C15, np.uint64(0xD1B54A32D192ED03)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def portions(units: list[str], chars: int) -> Iterator[list[str]]:
    """The units in order, in lists of about ``chars`` characters, one unit at least."""
    start, held = 0, 0
    for i, unit in enumerate(units):
        if held and held + len(unit) > chars:
            yield units[start:i]
            start, held = i, 0
        held += len(unit)
    if units:
        yield units[start:]


class Growing:
    """An array that is added to."""

    def __init__(self, kind: str):
        self.data, self.size = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.data):
            data = np.zeros(2 * (self.size + len(values)), self.data.dtype)
            data[: self.size] = self.all
            self.data = data
        self.data[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.data[: self.size]


class Lattice:
    """The vocabulary, and a table of the units that this worker has filtered, which is emptied beyond a bound."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int32)
        found = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(BYTE_PIECE.fullmatch(piece)[1], 16)
                self.byte_ids[value] = i
                self.text.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                plain = piece.replace(MARK, " ")
                self.text.append(plain.encode())
                if plain.lstrip(" ").find(" ") < 0:
                    found.append((plain, i, -sp.get_score(i)))
        # pieces without a merge of their own have a very low score; they rank after all others
        order = np.argsort([s for _, _, s in found], kind="stable")
        rank = np.empty(len(found))
        rank[order] = np.arange(len(found))
        self.weight = np.full(len(self.text), BYTE_WEIGHT)
        for (_, i, _), r in zip(found, rank, strict=True):
            self.weight[i] = -theta * np.log(r + 1)
        self.plant(found)
        self.forget()

    def plant(self, found: list[tuple[str, int, float]]) -> None:
        """The pieces as a trie of numbered states, 0 first; ASCII steps in a table, others as sorted (state, character)."""
        states, piece, other, self.longest = {"": 0}, [-1], [], max(len(p) for p, _, _ in found)
        steps = []
        for p, i, _ in found:
            for n in range(1, len(p) + 1):
                if p[:n] not in states:
                    states[p[:n]] = len(states)
                    piece.append(-1)
                    (steps if p[n - 1].isascii() else other).append((states[p[: n - 1]], ord(p[n - 1]), states[p[:n]]))
            piece[states[p]] = i
        self.piece_of = np.array(piece, np.int32)
        self.ascii = np.full((len(states), 128), -1, np.int32)
        by, char, to = np.array(steps, np.int64).T
        self.ascii[by, char] = to
        by, char, to = np.array(sorted(other), np.int64).reshape(-1, 3).T
        self.other, self.other_to = by << 21 | char, to.astype(np.int32)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        out = self.ascii[state, np.minimum(code, 127)]
        if len(wide := np.flatnonzero(code >= 128)):
            out[wide] = -1
            if len(self.other):
                asked = state[wide].astype(np.int64) << 21 | code[wide]
                at = np.minimum(np.searchsorted(self.other, asked), len(self.other) - 1)
                out[wide] = np.where(self.other[at] == asked, self.other_to[at], -1)
        return out

    def edges(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, length, piece) of every piece in the units, by node, then length; node p is the place behind character
        p. room: characters from each place to its unit's end.

        A character without a piece has the negated number of its UTF-8 bytes instead of one."""
        live, state = np.arange(len(codes)), np.zeros(len(codes), np.int32)
        found, at_node = [], np.zeros(len(codes), np.int32)
        for n in range(1, self.longest + 1):
            inside = room[live] >= n
            live = live[inside]
            if not len(live):
                break
            state = self.step(state[inside], codes[live + n - 1])
            on = state >= 0
            live, state = live[on], state[on]
            piece = self.piece_of[state]
            hit = piece >= 0
            found.append((live[hit] + n - 1, n, piece[hit]))
            if n == 1:
                bare = np.ones(len(codes), bool)
                bare[live[hit]] = False
                bare = np.flatnonzero(bare)
                width = 1 + (codes[bare] >= 0x80) + (codes[bare] >= 0x800) + (codes[bare] >= 0x10000)
                found.append((bare, 1, -width.astype(np.int32)))
        # by counting: in each node edges come in order of their lengths
        ranks = []
        for node, _, _ in found:
            ranks.append(at_node[node])
            at_node[node] += 1
        start = np.cumsum(at_node) - at_node
        out = np.zeros((3, int(at_node.sum())), np.int32)
        for (node, n, piece), rank in zip(found, ranks, strict=True):
            at = start[node] + rank
            out[0, at], out[1, at], out[2, at] = node, n, piece
        return out[0], out[1], out[2]

    def learn(self, units: list[str]) -> None:
        """Forward filtering of units that are not in the table yet."""
        long = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(long)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
        unit_end, unit_begin = np.repeat(ends, long), np.repeat(ends - long, long)
        node, length, piece = self.edges(codes, unit_end - np.arange(len(codes)))
        level = (node - unit_begin[node]).astype(np.int32)
        # and by depth of the node, all units together
        by_depth = np.argsort(level.astype(np.uint16) if long.max() < 1 << 16 else level, kind="stable")
        weight = np.where(piece < 0, BYTE_WEIGHT * -piece, self.weight[np.maximum(piece, 0)])
        # forward: alpha[p] = log of the summed weights of all paths to node p
        alpha = np.zeros(len(codes) + 1)  # the last one stands before every unit and stays 0
        source = np.where(level >= length, node - length, len(codes))
        share = np.ones(len(node))
        bounds = np.searchsorted(level[by_depth], np.arange(long.max() + 1))
        for d in range(len(bounds) - 1):
            at = by_depth[bounds[d] : bounds[d + 1]]
            total, own = weight[at] + alpha[source[at]], node[at]
            start = np.flatnonzero(np.diff(own, prepend=-1))
            width = np.diff(np.append(start, len(at)))
            top = np.maximum.reduceat(total, start)
            part = np.exp(total - np.repeat(top, width))
            summed = np.add.reduceat(part, start)
            alpha[own[start]] = top + np.log(summed)
            # cumulative shares in each node, the last one full
            running = np.cumsum(part)
            running -= np.repeat(np.concatenate(([0.0], running[start[1:] - 1])), width)
            running /= np.repeat(summed, width)
            running[start + width - 1] = 1.0
            share[at] = np.minimum(running, 1.0)
        self.units.update(zip(units, range(len(self.units), len(self.units) + len(units)), strict=True))
        first_edge = np.flatnonzero(np.diff(node, prepend=-1)) + self.share.size  # every node has an edge
        cut = np.minimum(np.round(share * 2.0**32), 2.0**32 - 1)
        for column, values in ((self.last, ends - 1 + self.edge.size), (self.long, long), (self.edge, first_edge), (self.share, cut), (self.piece, piece), (self.length, length)):
            column.add(values)

    def forget(self) -> None:
        """An empty table: number of each unit, its last node and length; each node's first edge; each edge's cumulative
        share in its node, piece and length."""
        self.units: dict[str, int] = {}
        self.last, self.long, self.edge, self.share, self.piece, self.length = map(Growing, ("<i4", "<i4", "<i4", "<u4", "<i4", "<i4"))

    def draw(self, units: list[str], seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of a segmentation of each unit, one unit after the other, and their number for each."""
        if new := set(units).difference(self.units):
            if self.edge.size > TABLE_NODES:
                self.forget()
                new = set(units)
            for part in portions(sorted(new), LEARNED):
                self.learn(part)
        occ = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        edge, share, piece, length = self.edge.all, self.share.all, self.piece.all, self.length.all
        # backward: all units step together
        live = np.argsort(occ, kind="stable")  # neighbours in the table are looked up together
        at, left, seed = self.last.all[occ[live]], self.long.all[occ[live]], seed[live]
        taken, steps, n = np.zeros(len(occ), np.int32), [], 0
        while len(live):
            u = (mix(seed + np.uint64((n + 1) * STEP % (1 << 64))) >> np.uint64(32)).astype(np.uint32)
            u = np.minimum(u, np.uint32((1 << 32) - 2))
            e = edge[at]
            on = np.flatnonzero(share[e] <= u)
            while len(on):
                e[on] += 1
                on = on[share[e[on]] <= u[on]]
            steps.append((live, piece[e]))
            taken[live] += 1
            at, left = at - length[e], left - length[e]
            more = left > 0
            live, at, left, seed = live[more], at[more], left[more], seed[more]
            n += 1
        stop = np.cumsum(taken)
        out = np.zeros(stop[-1], np.int32)
        for k, (live, p) in enumerate(steps):
            out[stop[live] - 1 - k] = p  # drawn last to first
        return out, taken

    def sample(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """The ids of a segmentation of each text, drawn with its key."""
        out, units, rows, nths, held = [[] for _ in texts], [], [], [], 0

        def draw() -> None:
            row, nth = np.repeat(np.array(rows, np.int64), [len(x) for x in nths]), np.concatenate(nths)
            pieces, taken = self.draw(units, mix(np.array(keys, dtype=np.uint64)[row] + mix(nth.astype(np.uint64) * ROW)))
            ends = np.concatenate(([0], np.cumsum(taken)))[np.cumsum([len(x) for x in nths])]
            for r, part in zip(rows, np.split(pieces, ends[:-1]), strict=True):
                out[r].append(part)
            for x in (units, rows, nths):
                x.clear()

        for row, text in enumerate(texts):
            at = nth = 0
            while at < len(text):  # a long text in several parts, cut between units
                m = NEXT_UNIT.search(text, at + BLOCK)
                to = m.start() if m else len(text)
                new = UNITS.findall(text, at, to)
                units += new
                rows.append(row)
                nths.append(np.arange(nth, nth + len(new)))
                held, nth, at = held + to - at, nth + len(new), to
                if held >= BLOCK:
                    draw()
                    held = 0
        if units:
            draw()
        return [self.spell(np.concatenate([*p, np.zeros(0, np.int32)]), t) for p, t in zip(out, texts, strict=True)]

    def spell(self, ids: np.ndarray, text: str) -> np.ndarray:
        """A negative entry becomes the byte pieces of the character it stands for."""
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids
        width, size = np.ones(len(ids), np.int64), self.sizes[ids]
        width[bare] = size[bare] = -ids[bare]
        begin = np.cumsum(size) - size
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        full = np.repeat(ids, width)
        offset = np.arange(len(full)) - np.repeat(np.cumsum(width) - width, width)
        from_byte = np.repeat(begin, width) + offset
        escaped = full < 0
        full[escaped] = self.byte_ids[raw[from_byte[escaped]]]
        return full

    @property
    def sizes(self) -> np.ndarray:
        if not hasattr(self, "_sizes"):
            self._sizes = np.array([len(x) for x in self.text], dtype=np.int64)
        return self._sizes

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def lattice(path: str, theta: float) -> Lattice:
    return Lattice(path, theta)


def row_key(doc: object, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(str(doc).encode(), seed)


def drawn(docs: DataFrame, path: str, columns: str, made: Callable[[Lattice, list, list], list], theta: float, seed: int, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: doc_id and the columns that ``made`` has for the lattice, a slice's texts and their ids."""

    def run(cols: list) -> list:
        ids, texts = cols
        known = lattice(path, theta)
        return [ids, *made(known, texts, known.sample([t or "" for t in texts], [row_key(d, seed) for d in ids]))]

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), f"doc_id {dict(docs.dtypes)[id_col]}, {columns}", run, BLOCK)


def encode(docs: DataFrame, path: str, theta: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, ids array<int>). Null text: null, empty text: no ids. Rows with one id, null included,
    draw the same numbers. Texts are encoded whole, however long. Other columns are ignored, whatever their names; an empty table gives an
    empty result."""

    def lists(known: Lattice, texts: list, ids: list) -> list:
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        return [pa.ListArray.from_arrays(offsets, np.concatenate([*ids, np.zeros(0, np.int32)]), mask=pa.array([t is None for t in texts]))]

    return drawn(docs, path, "ids array<int>", lists, theta, seed, id_col, text_col)


def decoder(path: str, theta: float = 1.0):
    """A column function: ids -> text; null stays null."""

    @F.pandas_udf("string")
    def decode(ids):
        known = lattice(path, theta)
        return ids.map(lambda x: None if x is None else known.decode(x.tolist()))

    return decode


def op6_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (unsigned little-endian ids), text_sha256 of the decoded text (null: empty).

    A slice's ids are told where they are drawn, so that no second worker holds the vocabulary and batches of ids."""

    def told(known: Lattice, texts: list, ids: list) -> list:
        decoded = (known.decode(x.tolist()).encode("utf-8", "surrogatepass") for x in ids)
        return [[len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], [hashlib.sha256(t).hexdigest() for t in decoded]]

    return drawn(docs, model_path(), "n_pieces bigint, ids_crc32 bigint, text_sha256 string", told, 1.0, 0, "doc_id", "text")
