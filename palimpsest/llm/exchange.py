"""Asking all other documents about millions of fingerprints without a row for each.

Documents are dealt to *chunks* of a bounded amount of text. A chunk sends, to each *bucket* (a range of the hash
space), one row that holds all of its fingerprints there as a packed array; a bucket's group compares what all chunks
sent and sends each chunk one packed array back, in the order asked; the chunk's documents meet the answers in a
cogroup. Spark does all moving, by chunk and by bucket, and reuses the shuffle of the documents between the steps of one
query. Chunks are bounded by their text. A bucket gets as many fingerprints as a chunk sends, on average, since there are
as many buckets as chunks; a fingerprint that a third of all rows share is in it once for each chunk. With n chunks there
are at most n * n messages; beyond some 10,000 chunks (40 GB of text) a message holds few fingerprints, and in the end one,
as a plain shuffle of rows would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import partitions_for

CHUNK_BYTES = 4 << 20
PACKING = pa.Codec("zstd", compression_level=1)
MESSAGE = "bucket int, chunk int, data binary"
MESSAGE_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("data", pa.binary())])


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) and the number of chunks. Null text counts as empty. The id may be null or repeat; only rows
    that are equal in id and text always share a chunk."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = partitions_for(rows, "text", chunk_bytes)
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"), "doc_id", "text"), n


def bucket_width(n: int) -> int:
    """Of each of n buckets, in units of 2**32."""
    return -(-(1 << 32) // n)


def buckets(sorted_hashes: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of each non-empty bucket of ascending uint64 hashes; a bucket is a range of the upper 32 bits."""
    width = bucket_width(n)
    cuts = np.searchsorted(sorted_hashes, np.array([i * width << 32 for i in range(1, n) if i * width < 1 << 32], dtype=np.uint64))
    cuts = [0, *cuts.tolist(), len(sorted_hashes)]
    for i in range(len(cuts) - 1):
        if cuts[i] < cuts[i + 1]:
            yield i, slice(cuts[i], cuts[i + 1])


def packed(a: np.ndarray) -> bytes:
    """The array's bytes in column order, texts row by row, compressed, behind their number."""
    if a.dtype.names:
        raw = b"".join(np.ascontiguousarray(a[c] if c == "text" else a[c].T).tobytes() for c in a.dtype.names)
    else:
        raw = a.tobytes()
    return len(raw).to_bytes(8, "little") + PACKING.compress(raw, asbytes=True)


def unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = PACKING.decompress(data[8:], decompressed_size=size, asbytes=True)
    if not kind.names:
        return np.frombuffer(raw, dtype=kind)
    out, at = np.empty(size // kind.itemsize, kind), 0
    for c in kind.names:
        field = kind[c]
        part = np.frombuffer(raw, dtype=field.base, count=len(out) * (field.itemsize // field.base.itemsize), offset=at)
        out[c] = part.reshape(len(out), *field.shape) if c == "text" else part.reshape(*field.shape, len(out)).T if field.shape else part
        at += len(out) * field.itemsize
    return out


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    bucket, chunk, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(bucket, pa.int32()), pa.array(chunk, pa.int32()), pa.array(data, pa.binary())], schema=MESSAGE_SCHEMA)


def seen_by_others(asked: DataFrame, more_than: tuple[int, ...] = (1,)) -> DataFrame:
    """Messages of ascending uint32 fingerprints, distinct in each -> messages of bits, as many for each number in
    ``more_than``: do more than so many chunks have it?"""

    def resolve(t: pa.Table) -> pa.Table:
        sent = [np.cumsum(unpacked(x, np.dtype("<u4")), dtype=np.uint32) for x in t["data"].to_pylist()]
        _, inverse, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        counts, at, out = counts[inverse], 0, []
        for bucket, chunk, x in zip(t["bucket"].to_pylist(), t["chunk"].to_pylist(), sent, strict=True):
            out.append((bucket, chunk, b"".join(np.packbits(counts[at : at + len(x)] > limit).tobytes() for limit in more_than)))
            at += len(x)
        return messages(out)

    return asked.groupBy("bucket").applyInArrow(resolve, MESSAGE)


def ask_shared(uniq: np.ndarray, chunk: int, n: int) -> list[tuple[int, int, bytes]]:
    """The messages that ask about ascending distinct hashes: in each bucket their leading 32 bits there, as differences.

    Two hashes that agree in these bits may both be called shared; what is called unshared is."""
    width, out = bucket_width(n), []
    for b, s in buckets(uniq, n):
        key = ((uniq[s] - np.uint64(b * width << 32)) >> np.uint64(width.bit_length())).astype(np.uint32)
        out.append((b, chunk, packed(np.diff(key, prepend=np.uint32(0)))))
    return out


def answered(uniq: np.ndarray, n: int, answers: dict[int, bytes], question: int = 0) -> np.ndarray:
    """The bits that came back for the same hashes, to one of the questions of ``more_than``."""
    out = np.zeros(len(uniq), bool)
    for b, s in buckets(uniq, n):
        asked = s.stop - s.start
        out[s] = np.unpackbits(np.frombuffer(answers[b], dtype=np.uint8, count=-(-asked // 8), offset=question * -(-asked // 8)), count=asked)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
