"""Content deltas as rows. A fragment describes the edge base -> version: COMMON (rev_off, fwd_off, len), FORWARD (fwd_off,
data) and REVERSE (rev_off, data). Offsets count characters of string images, bytes of binary ones."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from palimpsest.functions.sizes import EMPTY_DELTA, dummy_common_size, encoded_size, in_time_frame
from palimpsest.operators.footprints import least_of_neighbours, rolling, units
from palimpsest.operators.trees import KEY, ROUNDS, chain_edges, first_hops
from palimpsest.schema import Catalog
from palimpsest.sources.tables import materialize, release

FOOTPRINT = 12
#: Neighbours on each side that a marked window's hash is compared with.
SPREAD = 32
#: Offsets are bucketed by this length where fragments are joined by overlap.
OVERLAP_BUCKET = 1 << 16


def piece(content: str, start: Column, length: Column) -> Column:
    """``length`` units from the 0-based ``start``."""
    return F.substring(F.col(content), (start + 1).cast("int"), length.cast("int"))


def longest_chain(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of (f, r) that goes up in both, by patience sorting."""
    ends: list[int] = []
    best: list[int] = []
    last: list[int] = []
    places = sorted(places, key=lambda p: (p[0], -p[1]))
    for i, (_, r) in enumerate(places):
        at = bisect_left(ends, r)
        ends[at : at + 1], best[at : at + 1] = [r], [i]
        last.append(best[at - 1] if at else -1)
    out, i = [], best[-1] if best else -1
    while i >= 0:
        out.append(places[i])
        i = last[i]
    return out[::-1]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        off = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(off):
            return at + int(off[0])
        at, step = at + step, step * 4
    return n


def common_runs(rev: np.ndarray, fwd: np.ndarray, chain: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """(r, f, n) of equal stretches of k units and more that go up on both sides: what the images begin and end with, and the places of
    the chain, each stretched to both sides as far as units are equal and no other stretch is."""
    first = shared(rev, fwd)
    first = first if first >= k else 0
    end_r, end_f = len(rev), len(fwd)
    last = shared(rev[first:][::-1], fwd[first:][::-1])
    last = last if last >= k else 0
    runs = [(0, 0, first)] if first else []
    r0, f0, r1, f1 = first, first, end_r - last, end_f - last
    inner = [(f, r) for f, r in chain if f >= f0 and r >= r0 and f + k <= f1 and r + k <= r1 and (rev[r : r + k] == fwd[f : f + k]).all()]
    for f, r in inner:
        if f < f0 or r < r0:
            continue  # already covered
        back = shared(rev[r0:r][::-1], fwd[f0:f][::-1])
        on = shared(rev[r + k : r1], fwd[f + k : f1])
        r, f, n = r - back, f - back, back + k + on
        if runs and runs[-1][0] + runs[-1][2] == r and runs[-1][1] + runs[-1][2] == f:
            r, f, n = runs[-1][0], runs[-1][1], runs[-1][2] + n
            runs.pop()
        runs.append((r, f, n))
        r0, f0 = r + n, f + n
    if last:
        if runs and (runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]) == (r1, f1):
            r, f, n = runs.pop()
            runs.append((r, f, n + last))
        else:
            runs.append((r1, f1, last))
    return runs


def matched(rev: np.ndarray, fwd: np.ndarray, k: int, spread: int) -> list[tuple[int, int]]:
    """Places (f, r) of the marks of both images with equal hashes, the nth of one side with the nth of the other."""

    def marks(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = rolling(u, k)
        at = least_of_neighbours(h, spread)
        order = np.argsort(h[at], kind="stable")
        return h[at][order], at[order]

    (hash_f, f), (hash_r, r) = marks(fwd), marks(rev)
    nth = np.arange(len(f)) - np.searchsorted(hash_f, hash_f)
    at = np.searchsorted(hash_r, hash_f) + nth
    met = np.flatnonzero(at < len(r))
    met = met[hash_r[at[met]] == hash_f[met]]
    return list(zip(f[met].tolist(), r[at[met]].tolist(), strict=True))


def diff_images(pairs: DataFrame, key: list[str], k: int = FOOTPRINT, spread: int = SPREAD) -> DataFrame:
    """(key, kind, rev_off, fwd_off, len, data) for rows (key, rev, fwd).

    Both images are marked at the windows of k units whose hash is the least of their neighbours, one in 2 * spread + 1, and at both ends; equal marks, the
    nth of one side with the nth of the other, are joined by hash, and of a pair's marks the longest chain that goes up on both sides is kept.
    Marks are then compared as text and stretched as far as it is equal (``common_runs``); what no stretch covers is directional. So COMMON fragments are at least k
    long and go forward on both sides, and the fragments tile both images. A pair's marks are met in its own row (``matched``): nothing is shuffled,
    neither marks nor texts. A null image is empty."""
    keys = [pairs.schema[c] for c in key]
    text = pairs.schema["fwd"].dataType
    schema = StructType([*keys, StructField("kind", StringType()), *(StructField(c, LongType()) for c in ("rev_off", "fwd_off", "len")), StructField("data", text)])
    arrow = to_arrow_schema(schema)
    empty = b"" if isinstance(text, BinaryType) else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rev, fwd = (empty if x is None else x for x in (b.column(len(key) + j)[i].as_py() for j in range(2)))
                u, v, rows, r0, f0 = units(rev), units(fwd), [], 0, 0
                for at_r, at_f, n in [*common_runs(u, v, longest_chain(matched(u, v, k, spread)), k), (len(rev), len(fwd), 0)]:
                    rows += [("FORWARD", None, f0, at_f - f0, fwd[f0:at_f])] if at_f > f0 else []
                    rows += [("REVERSE", r0, None, at_r - r0, rev[r0:at_r])] if at_r > r0 else []
                    rows += [("COMMON", at_r, at_f, n, None)] if n else []
                    r0, f0 = at_r + n, at_f + n
                same = pa.array(np.full(len(rows), i))
                own = [pa.array([x[j] for x in rows], t) for j, t in enumerate(arrow.types[len(key) :])]
                yield pa.RecordBatch.from_arrays([*(b.column(j).take(same) for j in range(len(key))), *own], schema=arrow)

    return pairs.select(*key, "rev", "fwd").mapInArrow(run, schema)


def fragment_size() -> Column:
    """Stored bytes of a fragment's fields and data."""
    fields = F.coalesce(encoded_size(F.col("rev_off")), F.lit(0)) * F.col("rev_off").isNotNull().cast("int") + encoded_size(F.col("fwd_off")) * F.col("fwd_off").isNotNull().cast("int") + encoded_size(F.col("len"))
    return fields + F.when(F.col("kind") == "COMMON", 0).otherwise(F.col("len"))


def diff_stats(fragments: DataFrame, key: list[str], sizes: DataFrame) -> DataFrame:
    """Per delta: fragments, data and stored size by kind, the total, and whether it reaches the larger image (aborted).

    ``sizes``: (key, rev_size, fwd_size) of every pair, also of pairs without fragments."""
    kinds = ("COMMON", "FORWARD", "REVERSE")
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, c)), F.lit(0)).cast("long")
    agg = sizes.hint("merge").join(fragments, key, "left").groupBy(*key, "rev_size", "fwd_size").agg(
        *[x for kind in kinds for x in (of(kind, F.lit(1)).alias(f"n_{kind.lower()}"), of(kind, F.col("len")).alias(f"data_{kind.lower()}"), (of(kind, fragment_size()) + EMPTY_DELTA).alias(f"size_{kind.lower()}"))]
    )
    total = F.col("size_common") + F.col("size_forward") + F.col("size_reverse")
    return agg.withColumn("total", total).withColumn("aborted", total >= F.greatest("rev_size", "fwd_size")).drop("rev_size", "fwd_size")


def dummy_delta(versions: DataFrame) -> DataFrame:
    """The "same content" delta of versions with a size: one COMMON fragment over all of it, none for an empty file."""
    n = lambda v: F.lit(v).cast("long")
    return versions.where("size > 0").select("file_id", "version_id", F.lit("COMMON").alias("kind"), n(0).alias("rev_off"), n(0).alias("fwd_off"), F.col("size").alias("len"), F.lit(None).cast("string").alias("data"))


def fragment_digests(fragments: DataFrame) -> DataFrame:
    """(file_id, version_id, n, fragments_digest): the number of a delta's fragments and a sum of their hashes, whatever their order."""
    h = F.xxhash64("kind", "rev_off", "fwd_off", "len", "data").cast("decimal(20,0)")
    return fragments.groupBy("file_id", "version_id").agg(F.count("*").alias("n"), F.sum(h).alias("fragments_digest"))


def content_changed(c: Catalog, fragments: DataFrame | None = None) -> DataFrame:
    """Versions that brought new content: no mark, and stored whole, or a root, or with deltas other than the dummy one of their base.

    Stored lengths are compared, and with ``fragments`` what they hold too: a delta may be as long as the dummy and say something else. Only versions
    whose lengths leave it open meet their fragments; the dummy's digest comes from the base's size."""
    base = c.versions.select("file_id", F.col("version_id").alias("base_version_id"), F.col("size").alias("base_size"))
    v = c.versions.hint("merge").join(base, ["file_id", "base_version_id"], "left")
    same = F.col("cdelta_len").eqNullSafe(dummy_common_size(F.col("base_size"))) & F.col("fdelta_len").eqNullSafe(F.lit(EMPTY_DELTA)) & F.col("rdelta_len").eqNullSafe(F.lit(EMPTY_DELTA))
    if fragments is not None:
        open_ = v.where(same & ~F.col("has_image")).select("file_id", "version_id")
        found = fragment_digests(fragments.hint("merge").join(open_, ["file_id", "version_id"], "left_semi"))
        zero, nothing = F.lit(0).cast("long"), F.lit(None).cast(fragments.schema["data"].dataType)
        dummy = F.when(F.col("base_size") > 0, F.xxhash64(F.lit("COMMON"), zero, zero, F.col("base_size"), nothing).cast("decimal(20,0)"))
        v = v.hint("merge").join(found, ["file_id", "version_id"], "left")
        same = same & F.coalesce("n", F.lit(0)).eqNullSafe((F.col("base_size") > 0).cast("long")) & F.col("fragments_digest").eqNullSafe(dummy)
    return v.where(F.col("size").isNotNull() & (F.col("has_image") | F.col("base_version_id").isNull() | ~same)).select("file_id", "version_id", "modified")


def changed_paths(c: Catalog, start: str, end: str, fragments: DataFrame | None = None) -> DataFrame:
    """Paths with a version in the frame that changed content, depth first."""
    hit = content_changed(c, fragments).where(in_time_frame(F.col("modified"), start, end)).select("file_id").distinct()
    return c.files.hint("merge").join(hit, "file_id", "left_semi").select("path").distinct().orderBy(F.split("path", "/"))


def compose_deltas(lower: DataFrame, upper: DataFrame, key: list[str], bucket: int = OVERLAP_BUCKET) -> DataFrame:
    """One delta base -> new from base -> middle (``lower``) and middle -> new (``upper``): COMMON and FORWARD fragments.

    A merge of two tilings of the middle image: the starts of both sides' fragments in one order, each meeting the fragment of the other side that
    lies there. Both are dealt to the buckets of offsets that they touch, so a long chain is as many tasks as it has buckets, and rows
    grow with the fragments of both sides and not with their pairs. A pair is made where it begins."""
    text = dict(lower.dtypes)["data"]
    touched = lambda at: F.explode(F.sequence(F.floor(at / bucket), F.floor((at + F.col("len") - 1) / bucket)))
    low = lower.where("kind <> 'REVERSE' AND len > 0").select(*key, touched(F.col("fwd_off")).alias("bucket"), F.struct("kind", "rev_off", F.col("fwd_off").alias("at"), "len", F.col("data").cast(text).alias("data")).alias("low"))
    top = upper.where("kind = 'COMMON' AND len > 0").select(*key, touched(F.col("rev_off")).alias("bucket"), F.struct(F.col("rev_off").alias("at"), F.col("fwd_off").alias("to"), "len").alias("top"))
    # where a fragment begins in its bucket
    begin = lambda side: F.greatest(F.col(f"{side}.at"), F.col("bucket") * bucket)
    both = low.withColumn("place", begin("low")).unionByName(top.withColumn("place", begin("top")), allowMissingColumns=True)
    w = Window.partitionBy(*key, "bucket").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("top").isNotNull()
    met = both.withColumn("own", own).withColumn("low", F.last("low", True).over(w)).withColumn("top", F.last("top", True).over(w))
    stop = F.least(F.col("low.at") + F.col("low.len"), F.col("top.at") + F.col("top.len"))
    first = F.greatest("low.at", "top.at")
    # a place where both begin is the row of the upper one
    met = met.withColumn("first", first).withColumn("stop", stop).where((F.col("place") == F.col("first")) & (F.col("first") < F.col("stop")) & (F.col("own") == (F.col("top.at") == F.col("first"))))
    n, skip, common = F.col("stop") - F.col("first"), F.col("first") - F.col("low.at"), F.col("low.kind") == "COMMON"
    cut = met.select(
        *key, F.col("low.kind").alias("kind"), F.when(common, F.col("low.rev_off") + skip).alias("rev_off"), (F.col("top.to") + F.col("first") - F.col("top.at")).alias("fwd_off"), n.alias("len"),
        F.when(~common, piece("low.data", skip, n)).cast(text).alias("data"),
    )
    return cut.unionByName(upper.where("kind = 'FORWARD' AND len > 0").select(*key, "kind", "rev_off", "fwd_off", "len", "data"))


def apply_delta(images: DataFrame, fragments: DataFrame, key: list[str], reverse: bool = False) -> DataFrame:
    """(key, content): the other image of each edge, from the base image or, in ``reverse``, from the derived one.

    An image meets the list of its fragments once; both are of one row of the result."""
    own, source, target = ("REVERSE", "fwd_off", "rev_off") if reverse else ("FORWARD", "rev_off", "fwd_off")
    part = F.struct(F.col(target).alias("at"), F.when(F.col("kind") == "COMMON", F.col(source)).alias("source"), "len", "data")
    rows = fragments.where(F.col("kind").isin("COMMON", own)).groupBy(*key).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = dict(images.dtypes)["content"] == "string"
    data = lambda p: F.when(p["source"].isNull(), p["data"]).otherwise(F.substring("content", (p["source"] + 1).cast("int"), p["len"].cast("int")))
    joined = F.array_join(F.transform("parts", data), "") if text else F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(data(p))), ""))
    return images.select(*key, "content").hint("merge").join(rows, key, "left").select(*key, F.coalesce(joined, F.lit("") if text else F.lit(b"")).alias("content"))


def validate_delta(fragments: DataFrame, key: list[str], sizes: DataFrame) -> DataFrame:
    """(key, side, problem) rows: gap, overlap, backwards, source too short, wrong length of data, wrong end."""
    out = None
    for side, own, off, other, size in (("forward", "FORWARD", "fwd_off", "rev_off", "fwd_size"), ("reverse", "REVERSE", "rev_off", "fwd_off", "rev_size")):
        w = Window.partitionBy(*key).orderBy(off)
        rows = fragments.where(F.col("kind").isin("COMMON", own)).hint("merge").join(sizes, key)
        nxt = F.lead(off).over(w)
        # the last COMMON before a fragment, for the order of their sources
        last = F.max(F.when(F.col("kind") == "COMMON", F.col(other))).over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("next", nxt).withColumn("end", F.col(off) + F.col("len")).withColumn("last", last).withColumn("nth", F.row_number().over(w))
        other_size = "rev_size" if side == "forward" else "fwd_size"
        problems = F.array_compact(
            F.array(
                F.when((F.col("nth") == 1) & (F.col(off) > 0), "gap"), F.when(F.col("next") > F.col("end"), "gap"), F.when(F.col("next") < F.col("end"), "overlap"),
                F.when((F.col("kind") == "COMMON") & (F.col(other) < F.col("last")), "backwards"), F.when((F.col("kind") == "COMMON") & (F.col(other) + F.col("len") > F.col(other_size)), "source too short"),
                F.when((F.col("kind") != "COMMON") & (F.length("data") != F.col("len")), "wrong length"), F.when(F.col("next").isNull() & (F.col("end") != F.col(size)), "wrong end"),
            )
        )
        found = rows.select(*key, F.lit(side).alias("side"), F.explode(problems).alias("problem"))
        out = found if out is None else out.unionByName(found)
    return out


def storage_policy(c: Catalog, chain_sizes: DataFrame, stats: DataFrame | None = None, max_share: float = 0.5, cumulative_limit: int | None = None) -> DataFrame:
    """How each derived version is stored: (file_id, version_id, new_chain, decision).

    DELTAS while its chain (its base's, plus its common and forward delta) is within ``max_share`` of its size and the limit; over it IMAGE if the
    base has an image, else DELTAS_AND_IMAGE; after an aborted diff IMAGE, or IMAGE_AND_BASE_IMAGE if the base has none."""
    base = c.versions.select("file_id", F.col("version_id").alias("base_version_id"), F.col("has_image").alias("base_image"))
    chains = chain_sizes.withColumnRenamed("version_id", "base_version_id")
    v = c.versions.where("size IS NOT NULL AND base_version_id IS NOT NULL AND cdelta_len IS NOT NULL").hint("merge").join(base, ["file_id", "base_version_id"]).hint("merge").join(chains, ["file_id", "base_version_id"], "left")
    v = v.hint("merge").join(stats.select("file_id", "version_id", "aborted"), ["file_id", "version_id"], "left") if stats is not None else v.withColumn("aborted", F.lit(False))
    chain = F.coalesce("chain_size", F.lit(0)) + F.col("cdelta_len") + F.col("fdelta_len")
    fits = chain <= max_share * F.col("size")
    fits = fits & (chain <= cumulative_limit) if cumulative_limit is not None else fits
    aborted = F.coalesce("aborted", F.lit(False))
    decision = F.when(aborted & F.col("base_image"), "IMAGE").when(aborted, "IMAGE_AND_BASE_IMAGE").when(fits, "DELTAS").when(F.col("base_image"), "IMAGE").otherwise("DELTAS_AND_IMAGE")
    return v.select("file_id", "version_id", chain.alias("new_chain"), decision.alias("decision"))


def turned(fragments: DataFrame, hops: DataFrame) -> DataFrame:
    """Fragments of the deltas that ``hops`` use, as deltas next -> version: COMMON and FORWARD, whichever way they were stored."""
    edges = hops.select("file_id", "version_id", "edge_version_id", "direction")
    used = fragments.withColumnRenamed("version_id", "edge_version_id").hint("merge").join(edges, ["file_id", "edge_version_id"])
    ahead = F.col("direction") == "FORWARD"
    kept = (F.col("kind") == "COMMON") | (F.col("kind") == F.col("direction"))
    common = F.col("kind") == "COMMON"
    source = F.when(common, F.when(ahead, F.col("rev_off")).otherwise(F.col("fwd_off")))
    target = F.when(ahead, F.col("fwd_off")).otherwise(F.col("rev_off"))
    return used.where(kept & (F.col("len") > 0)).select("file_id", "version_id", F.when(common, "COMMON").otherwise("FORWARD").alias("kind"), source.alias("rev_off"), target.alias("fwd_off"), "len", "data")


def rebuild_images(versions: DataFrame, images: DataFrame, fragments: DataFrame) -> DataFrame:
    """(file_id, version_id, content) of all versions that have a way to a stored image.

    Doubling: each version has the delta from a version on its way, first the next one. A round composes it with the delta that this
    one has, which doubles how far it reaches; versions whose delta begins at an image are done. So a chain of n versions takes
    log2(n) rounds, and each image is written once, from the stored one."""
    first = chain_edges(first_hops(versions), versions)
    hops = materialize(first.where("direction <> 'BROKEN'").select("file_id", F.col("source").alias("version_id"), F.col("next").alias("up"), "direction", "edge_version_id"))
    deltas = materialize(turned(fragments, hops))
    # a version without a row here has an image
    up = materialize(hops.select("file_id", "version_id", "up"))
    release(hops)
    for _ in range(ROUNDS):
        on = up.select("file_id", F.col("version_id").alias("up"), F.col("up").alias("higher"))
        open_ = materialize(up.hint("merge").join(on, ["file_id", "up"]).select("file_id", "version_id", "up", "higher"))
        if open_.isEmpty():
            release(open_)
            break
        lower = deltas.withColumnRenamed("version_id", "up").hint("merge").join(open_.select("file_id", "version_id", "up"), ["file_id", "up"]).drop("up")
        upper = deltas.hint("merge").join(open_.select("file_id", "version_id"), KEY, "left_semi")
        done = deltas.hint("merge").join(open_.select("file_id", "version_id"), KEY, "left_anti")
        fields = ["file_id", "version_id", "kind", "rev_off", "fwd_off", "len", "data"]
        new = materialize(done.select(*fields).unionByName(compose_deltas(lower, upper, KEY).select(*fields)))
        new_up = materialize(up.hint("merge").join(open_.select("file_id", "version_id", "higher"), KEY, "left").select("file_id", "version_id", F.coalesce("higher", "up").alias("up")))
        release(deltas, up, open_)
        deltas, up = new, new_up
    stored = images.hint("merge").join(versions.where("has_image").select(*KEY), KEY, "left_semi").select("file_id", "version_id", "content")
    sources = up.hint("merge").join(stored.withColumnRenamed("version_id", "up"), ["file_id", "up"]).select("file_id", "version_id", "content")
    return stored.unionByName(apply_delta(sources, deltas, KEY))
