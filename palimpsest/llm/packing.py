"""Best-fit packing of tokenised documents into sequences, bulk-synchronous.

Pieces are placed in rounds, longest bands of lengths first (``BAND``: from each band to the next a factor). A round

1. range-sorts the band's pieces and the open gaps by size,
2. resolves conflicts by rank: pieces and gaps are dealt to tasks in the order of the sort, so that each task has its share
   of all sizes, and no two pieces in different tasks can want the same gap,
3. sweeps in each task: every piece, longest first, goes to its successor among the task's gaps, the smallest gap that fits;
   pieces of one length go to the first gaps in their rank. The gap is updated at once. A piece that no gap fits opens a
   new sequence, whose rest is a gap,
4. writes the placed pieces and the gaps that a piece still to come may fit.

Then the next round ranks all gaps anew. A task takes about ``SHARE`` rows; in a round of one task the result is exactly that of
best-fit decreasing, and with more of them each leaves one sequence at most that another's pieces might have filled.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_rows, materialize

CAPACITY = 2048
END_ID = 0
#: Pre-tokens whose ids a worker remembers; at about 200 bytes each.
CACHE_LIMIT = 700_000
#: Lengths from a band's longest down to this part of it are placed in one round.
BAND = 8
#: Rows that a task sweeps.
SHARE = 200_000
#: A new sequence's number: round, task, number in the task.
TASK_BITS, NUMBER_BITS = 27, 31


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Normaliser and byte step of the tokenizer files that ``Encoder`` can follow unit by unit.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
BYTE_STEP = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, the same as the tokenizer's own.

    Where the tokenizer's file has the normaliser and the steps known here, texts of Latin-1 characters are split by the
    file's own pattern, and the ids of each unit come from the tokenizer's model once and then from a bounded cache. Any
    other text, and every text with any other file, goes to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        steps = (known["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_units = known["normalizer"] == NORMALIZER and len(steps) == 2 and steps[1] == BYTE_STEP and {**steps[0], "pattern": None} == {"type": "Split", "pattern": None, "behavior": "Removed", "invert": True} and not known["post_processor"]
        if self.by_units:
            pattern = steps[0]["pattern"]["Regex"]
            for kind in "LN":  # letters and numbers among Latin-1 characters
                pattern = pattern.replace(rf"\p{{{kind}}}", "".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == kind))
            self.by_units = r"\p" not in pattern
            self.units = re.compile(pattern).findall if self.by_units else None
        # separators that the tokenizer's idea of white space leaves out, and tokens that are found before any splitting
        self.odd = [*map(chr, range(0x1C, 0x20)), *(t["content"] for t in known["added_tokens"])]
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.packed(self.whole.encode(text, add_special_tokens=False).ids)
        if not self.by_units or any(x in text for x in self.odd):
            return self.packed(self.whole.encode(text, add_special_tokens=False).ids)
        units, known = self.units(text.lower()), self.known
        if new := set(units).difference(known):
            if len(known) > CACHE_LIMIT:
                known.clear()
                new = set(units)
            for u in new:
                known[u] = self.packed([t.id for t in self.model.tokenize(u.encode().decode("latin-1").translate(self.letters))])
        return b"".join(map(known.__getitem__, units))

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and an end id, cut every ``capacity`` ids.

    Null text: empty, a lone end id. Texts are encoded whole, however long. Other columns are ignored."""

    def run(cols: list) -> list:
        encode, out = encoder(path), ([], [], [], [], [])
        end = END_ID.to_bytes(4, "little")
        for doc, text in zip(*cols, strict=True):
            ids = encode(text or "") + end
            for at in range(0, len(ids), 4 * capacity):
                part = ids[at : at + 4 * capacity]
                for column, value in zip(out, (doc, at // (4 * capacity), at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    column.append(value)
        return list(out)

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), schema, run)


class Gaps:
    """Open gaps of one task by size; sequences of equal gaps in the order they came."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}

    def add(self, size: int, sequence: int, offset: int) -> None:
        if size not in self.open:
            insort(self.sizes, size)
            self.open[size] = []
        self.open[size].append((sequence, offset))

    def successor(self, length: int) -> tuple[int, int, int] | None:
        """Takes the smallest gap that fits: (size, sequence, offset)."""
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        size = self.sizes[at]
        found = self.open[size].pop()
        if not self.open[size]:
            del self.open[size], self.sizes[at]
        return size, *found


def sweep(t: pa.Table, capacity: int, least: int, task: int) -> pa.Table:
    """Places the pieces of a task's rows (length, gap, sequence_id, offset, ...) and gives all that is left of the gaps.

    A piece has a length, a gap has a size of at least one. ``least``: smaller gaps are closed."""
    gaps, opened = Gaps(), task << NUMBER_BITS
    is_gap = pa.compute.is_valid(t["gap"])
    for size, sequence, offset in zip(*(t.filter(is_gap)[c].to_pylist() for c in ("gap", "sequence_id", "offset")), strict=True):
        gaps.add(size, sequence, offset)
    pieces = t.filter(pa.compute.invert(is_gap)).sort_by([("length", "descending"), ("rank", "ascending")])
    sequences, offsets = [], []
    for length in pieces["length"].to_pylist():
        found = gaps.successor(length)
        if found is None:
            found, opened = (capacity, opened, 0), opened + 1
        size, sequence, offset = found
        sequences.append(sequence)
        offsets.append(offset)
        if size - length >= least:
            gaps.add(size - length, sequence, offset + length)
    for name, values in (("sequence_id", sequences), ("offset", offsets)):
        pieces = pieces.set_column(pieces.schema.get_field_index(name), name, pa.array(values, pa.int64()))
    left = [(size, *x) for size in gaps.sizes for x in gaps.open[size]]
    names = [n for n in t.column_names if n not in ("rank", "task")]
    made = {n: pa.nulls(len(left), t.schema.field(n).type) for n in names}
    made |= {n: pa.array([x[i] for x in left], pa.int64()) for i, n in enumerate(("gap", "sequence_id", "offset"))}
    pieces = pieces.select(names).cast(pa.schema([pa.field(n, t.schema.field(n).type) for n in names]))
    return pa.concat_tables([pieces, pa.table(made, schema=pieces.schema)])


def sweeper(capacity: int, least: int, first: int) -> Callable[[pa.Table], pa.Table]:
    return lambda t: sweep(t, capacity, least, first + t["task"][0].as_py())


def pack(cut: DataFrame, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """Adds (sequence_id, offset) to rows of (doc_id, piece, start, length, ...) with 1 <= length <= capacity.

    Equal lengths and repeated rows are told apart by rank only; ids may be null; an empty table gives an empty result."""
    cut = materialize(cut)
    given = cut.columns
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    as_piece = ["*", *(F.lit(None).cast("long").alias(c) for c in ("gap", "sequence_id", "offset"))]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in cut.dtypes), "gap bigint", "sequence_id bigint", "offset bigint"])
    gaps, placed, top = None, [], capacity
    while lengths := [x for x in counts if x <= top]:
        top = max(lengths)
        band = [x for x in lengths if x * BAND > top]
        later = [x for x in lengths if x * BAND <= top]
        # a task's rest is of use as long as a piece of this band or a later one fits
        least, first = min(lengths), len(placed) << TASK_BITS
        rows = cut.where(F.col("length").between(min(band), top)).select(*as_piece)
        n = sum(counts[x] for x in band)
        if gaps is not None:
            rows, n = rows.unionByName(gaps), n + open_gaps
        tasks = -(-n // share)
        size = F.coalesce("gap", "length")
        order = [F.col("gap").isNull(), size, F.coalesce("sequence_id", F.lit(-1)), F.hash(*given)]
        ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id())
        dealt = ranked.withColumn("task", F.pmod("rank", F.lit(tasks)).cast("int"))

        done = materialize(dealt.groupBy("task").applyInArrow(sweeper(capacity, least, first), schema))
        placed.append(done.where("gap IS NULL").select(*given, "sequence_id", "offset"))
        if later:
            gaps = done.where("gap IS NOT NULL").select(*given, "gap", "sequence_id", "offset")
            open_gaps = gaps.count()
        top = min(band) - 1
    if not placed:
        return cut.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def op1_query(docs: DataFrame) -> DataFrame:
    """The pieces of all documents and their places. Null text: empty, a lone end id. Ids may be null or repeat: each row is
    packed for itself. Other columns are ignored, whatever their names; an empty table gives an empty result."""
    return pack(pieces(docs, tokenizer_path()))
