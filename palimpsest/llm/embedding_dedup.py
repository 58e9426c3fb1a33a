"""Near-duplicate embeddings by sorted projection passes.

Every pass hashes each vector, less the mean of its label, to the signs of ``HASH_BITS`` random projections, concatenated, orders the vectors of a
label by that number (so, lexicographically by hash), and compares each with its predecessors in a window. Pairs that reach
the cosine are verified links; passes with other projections find what one pass left apart, and the union of all
passes' links gives the components. A pass keeps only links that join two groups of its task, so a dense cluster
gives a tree and not all its pairs. Windows go on across the borders of range partitions, so links do not depend on these.

The number of passes and the window follow from the data (``plan_passes``): for each vector of every label, pairs at exactly the least cosine are made
and hashed with it, and it is counted how often their first bits agree, and how often those of the vector and the others of its block do, into which
a hash deals the label. A pair
meets in a window when as many leading bits agree as thin its label out to half a window. As many passes are made as leave such
a pair apart with probability ``MISS`` at most. Vectors in a cone, as text embedders give, are spread by taking the mean away, and agree in
fewer bits than others at the same cosine, so they get more passes.

Windows are bounded, but counts of links must not be: the links of a vector all lie in its component, so they are
counted there, block against block, without a row for a pair. A block holds ``BLOCK`` vectors, so a component of m has each of its
vectors copied m / BLOCK times, less than the square root of m up to 16 million; counting m vectors that may all link takes m * m
comparisons in any case. Equal vectors of a label are one node, with their number.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import join_split, materialize, release
from palimpsest.llm.components import components

WINDOWS = (32, 128, 512, 2048)
#: What hashing and sorting a vector costs in a pass, in comparisons.
SORTING = 128
#: Vectors of a label that are compared with each other to plan its passes, and those of a group, which holds whole blocks.
PLANNED, PLANNED_GROUP = 256, 4096
HASH_BITS = 64
MISS = 1e-4
#: Vectors in a block of a component; a group compares two blocks at most.
BLOCK = 4096
SEED = 20_240_117


def planes(p: int, d: int) -> np.ndarray:
    return np.random.default_rng((SEED, p)).standard_normal((d, HASH_BITS))


def agreeing(x: np.ndarray, mean: np.ndarray, least: float, trials: int = 8, block: int = 0) -> np.ndarray:
    """Counts of one block of vectors x, which add up over blocks: of pairs made at the least cosine, in all and, for L = 0 to HASH_BITS, those that agree
    in their first L bits; of ordered pairs of the vectors, in all and those that agree in just L bits and are no such pair themselves."""
    m, d = x.shape
    rng = np.random.default_rng((SEED, block))
    u = rng.standard_normal((m, d))
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.maximum(np.sqrt((u * u).sum(axis=1, keepdims=True)), 1e-300)
    y = least * x + math.sqrt(max(0.0, 1 - least * least)) * u
    near, far = np.zeros(HASH_BITS + 1), np.zeros(HASH_BITS + 1)
    strangers = x @ x.T < least
    for _ in range(trials):
        plane = rng.standard_normal((d, HASH_BITS))
        a, b = (x - mean) @ plane > 0, (y - mean) @ plane > 0
        near += np.concatenate(([m], np.cumprod(a == b, axis=1).sum(axis=0)))
        key = np.packbits(a, axis=1).view(">u8")[:, 0].astype(np.uint64)
        for lo in range(0, m, 256):
            apart = key[lo : lo + 256, None] ^ key[None, :]
            shared = np.maximum(0, HASH_BITS - np.frexp(apart.astype(np.float64))[1])
            far += np.bincount(shared[strangers[lo : lo + 256]], minlength=HASH_BITS + 1)[: HASH_BITS + 1]
    return np.concatenate(([trials * m], near, [trials * m * (m - 1.0)], far))


def shares(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(near, far) of counts of ``agreeing``, for L = 0 to HASH_BITS: how often a pair at the least cosine agrees in its first L bits, and how often
    two vectors do that are no such pair.

    Where too few pairs agree to count, the decline of the last bits that can be counted goes on."""
    (made, *near), (pairs, *far) = np.split(counts, 2)
    near = np.array(near) / made
    far = np.cumsum(far[::-1])[::-1] / max(1.0, pairs)
    for seen, cases in ((near, made), (far, pairs)):
        if not len(known := np.flatnonzero(seen * cases >= 50)):
            continue
        last = int(known[-1])
        drop = (seen[last] / seen[max(0, last - 4)]) ** (1 / min(4, last)) if last else 0.5
        seen[last + 1 :] = seen[last] * np.cumprod(np.full(HASH_BITS - last, drop))
    return near, far


def agreement(x: np.ndarray, mean: np.ndarray, least: float, trials: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """``shares`` of one block."""
    return shares(agreeing(x, mean, least, trials))


def passes_for(n: int, near: np.ndarray, far: np.ndarray, miss: float = MISS) -> tuple[int, int]:
    """(passes, window) of least work for a label of n vectors; 4 passes at least."""
    best = None
    for window in WINDOWS:
        enough = np.flatnonzero(n * far <= window / 2)
        met = float(near[enough[0]]) if len(enough) else float(near[-1])
        passes = max(4, math.ceil(math.log(miss) / math.log1p(-met))) if 0 < met < 1 else 4
        work = passes * (SORTING + window) if len(enough) else math.inf
        if best is None or work < best[0]:
            best = work, passes, window
    return best[1:]


def label_means(nodes: DataFrame) -> DataFrame:
    """(label, mean, n): mean of the unit vectors of each label, as bytes. A task sums up the labels it reads; a label's sums meet once."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            rows = [(k, v.tobytes(), n) for k, (v, n) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["label", "mean", "n"])

        for b in batches:
            labels, data = b.column(0).to_pylist(), b.column(1).to_pylist()
            for label in set(labels):
                x = unit([v for v, k in zip(data, labels, strict=True) if k == label]) if labels.count(label) < len(labels) else unit(data)
                old = held.get(label)
                held[label] = [x.sum(axis=0) + (old[0] if old else 0), len(x) + (old[1] if old else 0)]
            if len(held) > 4096:
                yield out()
        yield out()

    def total(t: pa.Table) -> pa.Table:
        n = sum(t["n"].to_pylist())
        x = np.frombuffer(b"".join(t["mean"].to_pylist()), np.float64).reshape(t.num_rows, -1).sum(axis=0) / n
        return pa.table([t["label"][:1], pa.array([x.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["label", "mean", "n"])

    ddl = "label string, mean binary, n bigint"
    return nodes.select("label", "vector").mapInArrow(sums, ddl).groupBy("label").applyInArrow(total, ddl)


def plan_passes(centred: DataFrame, total: int, least: float) -> tuple[int, int]:
    """(passes, window) that the most demanding label needs, each planned by all of its own vectors; centred: ``total`` rows (label, vector, id, mean, n).

    A label that the smallest window covers needs none. A hash deals the others to blocks of about ``PLANNED`` vectors; a block's counts are added up by label."""
    wide = centred.where(F.col("n") > WINDOWS[0])
    block = F.pmod(F.xxhash64("vector", F.lit(SEED)), F.ceil(F.col("n") / PLANNED))
    dealt = wide.select("label", "vector", "id", "mean", "n", block.alias("block")).withColumn("part", F.pmod(F.xxhash64("label", "block"), F.lit(max(1, total // PLANNED_GROUP))))

    def count(t: pa.Table) -> pa.Table:
        t = t.sort_by([("label", "ascending"), ("block", "ascending"), ("id", "ascending")])
        labels, blocks, data = (t[c].to_pylist() for c in ("label", "block", "vector"))
        cuts = [0, *(i for i in range(1, len(labels)) if (labels[i], blocks[i]) != (labels[i - 1], blocks[i - 1])), len(labels)]
        held: dict[str, list] = {}
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            counts = agreeing(unit(data[lo:hi]), np.frombuffer(t["mean"][lo].as_py(), np.float64), least, block=blocks[lo])
            n, old = t["n"][lo].as_py(), held.get(labels[lo])
            held[labels[lo]] = [n, counts if old is None else old[1] + counts]
        rows = [(k, n, v.tobytes()) for k, (n, v) in held.items()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["label", "n", "counts"])

    def plan(t: pa.Table) -> pa.Table:
        counts = np.sum([np.frombuffer(x, np.float64) for x in t["counts"].to_pylist()], axis=0)
        passes, window = passes_for(t["n"][0].as_py(), *shares(counts))
        return pa.table([pa.array([passes], pa.int32()), pa.array([window], pa.int32())], names=["passes", "window"])

    plans = dealt.groupBy("part").applyInArrow(count, "label string, n bigint, counts binary").groupBy("label").applyInArrow(plan, "passes int, window int")
    most = plans.agg(F.max("passes"), F.max("window")).first()
    return most[0] or 4, most[1] or WINDOWS[0]


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector): label and dimension in one string, doubles as bytes; both null if it can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, vectors = [], []
            for v, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = None if v is None or label is None or not v or None in v else np.array(v, dtype=np.float64)
                if x is not None and (not np.isfinite(x).all() or not x.any()):
                    x = None
                labels.append(None if x is None else f"{len(x)}:{label}")
                vectors.append(None if x is None else (x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels, pa.string()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "vector"])

    chosen = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>"), F.col(label_col).cast("string"))
    return chosen.mapInArrow(run, "vec_id bigint, label string, vector binary")


def unit(data: list[bytes]) -> np.ndarray:
    """Rows of length 1. Scaled by the largest component first, so that no square over- or underflows."""
    x = np.frombuffer(b"".join(data), dtype=np.float64).reshape(len(data), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Groups:
    """Union-find over the places of one task's rows."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def top(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up.setdefault(y, y)
        return x


ORDERED = "pass int, label string, key bigint, id bigint, vector binary"
BORDER = f"part int, nth bigint, rows bigint, a bigint, b bigint, {ORDERED}"


def window_links(nodes: DataFrame, least: float, passes: int, window: int) -> DataFrame:
    """Verified (a, b) over nodes (id, label, vector, mean)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes: dict[int, list[int]] = {}
            data, means = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, d in enumerate(data):
                sizes.setdefault(len(d), []).append(i)
            for at in sizes.values():
                x, rows = unit([data[i] for i in at]), b.take(pa.array(at))
                x = x - np.frombuffer(b"".join(means[i] for i in at), np.float64).reshape(x.shape)
                for p in range(passes):
                    bits = np.packbits(x @ planes(p, x.shape[1]) > 0, axis=1).view(">u8")[:, 0]
                    key = (bits ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)  # signed order = order of the bits
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), rows.column(1), pa.array(key), rows.column(0), rows.column(2)], names=["pass", "label", "key", "id", "vector"])

    ordered = nodes.select("id", "label", "vector", "mean").mapInArrow(hashed, ORDERED)
    # the id is part of the order, so ranges also split a label, or a hash, that a third of all vectors have
    ordered = ordered.repartitionByRange("pass", "label", "key", "id").sortWithinPartitions("pass", "label", "key", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within a range; its first and last rows, numbered, and its number of rows."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, ids, x, groups, rows = None, np.zeros(0, np.int64), None, Groups(), 0
        tail: pa.Table | None = None
        for b in batches:
            found = []
            marks = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                own, new = unit(b.column(4).slice(lo, hi - lo).to_pylist()), b.column(3).slice(lo, hi - lo).to_numpy()
                if marks[lo] == last:
                    own, new = np.concatenate((x, own)), np.concatenate((ids, new))
                else:
                    groups = Groups()
                top = np.arange(len(new))
                for gap in range(1, min(window, len(new) - 1) + 1):
                    close = np.flatnonzero((np.einsum("ij,ij->i", own[gap:], own[:-gap]) >= least) & (top[gap:] != top[:-gap]))
                    found += [(a, c) for a, c in zip(new[close].tolist(), new[close + gap].tolist(), strict=True) if groups.join(a, c)]
                    if len(close) > 64:  # a dense cluster: what is joined already needs no look again
                        top = np.array([groups.top(i) for i in new.tolist()])
                last, ids, x = marks[lo], new[-window:], own[-window:]
            yield tagged(part, [None] * len(found), None, [f[0] for f in found], [f[1] for f in found], None)
            if rows < window:
                head = b.slice(0, window - rows)
                yield tagged(part, range(rows, rows + head.num_rows), None, None, None, head)
            rows += b.num_rows
            tail = pa.Table.from_batches([*(tail.to_batches() if tail else []), b])
            tail = tail.slice(max(0, tail.num_rows - window))
        if tail is not None:
            (tail,) = tail.combine_chunks().to_batches()
            first = rows - tail.num_rows
            beyond = tail.slice(max(0, window - first))  # not among the first rows already
            yield tagged(part, range(rows - beyond.num_rows, rows), None, None, None, beyond)
            yield tagged(part, [-1], [rows], None, None, None)

    def tagged(part, nth, count, a, b, rows) -> pa.RecordBatch:
        n, schema = len(nth), pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("rows", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("pass", pa.int32()), ("label", pa.string()), ("key", pa.int64()), ("id", pa.int64()), ("vector", pa.binary())])
        own = [[part] * n, list(nth), count or [None] * n, a or [None] * n, b or [None] * n]
        more = [rows.column(i).cast(schema.field(5 + i).type) if rows is not None else pa.nulls(n, schema.field(5 + i).type) for i in range(5)]
        return pa.RecordBatch.from_arrays([*(pa.array(x, schema.field(i).type) for i, x in enumerate(own)), *more], schema=schema)

    made = materialize(ordered.mapInArrow(compare, BORDER))
    # where each range starts among all rows; one number for each task
    sizes = sorted((r["part"], r["rows"]) for r in made.where("rows IS NOT NULL").select("part", "rows").collect())
    starts = {p: sum_ for (p, _), sum_ in zip(sizes, np.cumsum([0, *(n for _, n in sizes)])[:-1].tolist(), strict=True)}
    inner = sorted(starts.values())[1:]

    def at_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row once for each border that it is near to."""
        for b in batches:
            place = [starts[p] + n for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            near = [(i, border, p) for i, p in enumerate(place) for border in inner[bisect_left(inner, p - window + 1) : bisect_right(inner, p + window)]]
            some = b.select(["pass", "label", "id", "vector"]).take(pa.array([i for i, _, _ in near], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in near], pa.int64()), pa.array([x[2] for x in near], pa.int64()), *some.columns], names=["border", "place", *some.schema.names])

    def across(t: pa.Table) -> pa.Table:
        """Links over a border, as many as join what is before it with what is after."""
        t, found = t.sort_by("place"), []
        border, place = t["border"][0].as_py(), np.array(t["place"].to_pylist())
        marks, ids, data = list(zip(t["pass"].to_pylist(), t["label"].to_pylist(), strict=True)), t["id"].to_pylist(), t["vector"].to_pylist()
        cut = int(np.searchsorted(place, border))
        for mark in {*marks[:cut]} & {*marks[cut:]}:
            left, right = [i for i in range(cut) if marks[i] == mark], [j for j in range(cut, len(marks)) if marks[j] == mark]
            after, top = unit([data[j] for j in right]), np.arange(len(right))
            for i in left:
                near = np.flatnonzero((after @ unit([data[i]])[0] >= least) & (place[right] - place[i] <= window))
                groups, first = np.unique(top[near], return_index=True)
                found += [(ids[i], ids[right[j]]) for j in near[first].tolist()]
                if len(groups) > 1:
                    top[np.isin(top, groups)] = groups[0]
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    halo = made.where("nth >= 0").select("part", "nth", "pass", "label", "id", "vector").mapInArrow(at_borders, "border bigint, place bigint, pass int, label string, id bigint, vector binary")
    return made.where("a IS NOT NULL").select("a", "b").unionByName(halo.groupBy("border").applyInArrow(across, "a bigint, b bigint"))


def count_links(members: DataFrame, sizes: DataFrame, rows: int, least: float) -> DataFrame:
    """(id, links) over members (id, component, copies, vector): rows that each is linked with, other than its own copies.

    ``sizes``: (component, size); ``rows``: number of members."""
    blocks = join_split(members, sizes.withColumn("n", F.col("size")), ["component"], "n", rows)
    blocks = blocks.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # each block meets each block of its component once: as (i, j) with i <= j
    meets = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    # small components share groups of about BLOCK vectors
    many = F.when(F.col("blocks") > 1, F.xxhash64("component", "i", "j")).otherwise(F.pmod(F.xxhash64("component"), F.lit(max(1, rows // BLOCK))))
    dealt = meets.select(many.alias("part"), "component", "i", "j", "block", "id", "copies", "vector")

    def count(t: pa.Table) -> pa.Table:
        key = list(zip(*(t[c].to_pylist() for c in ("component", "i", "j")), strict=True))
        order = sorted(range(len(key)), key=key.__getitem__)
        block, ids, copies, data = (t[c].to_pylist() for c in ("block", "id", "copies", "vector"))
        out_ids, out_links, at = [], [], 0
        while at < len(order):
            stop = at
            while stop < len(order) and key[order[stop]] == key[order[at]]:
                stop += 1
            rows = order[at:stop]
            _, i, j = key[rows[0]]
            x, c, side = unit([data[r] for r in rows]), np.array([copies[r] for r in rows]), np.array([block[r] for r in rows])
            for lo in range(0, len(rows), 512):
                near = x[lo : lo + 512] @ x.T >= least
                if i == j:
                    near[np.arange(len(near)), lo + np.arange(len(near))] = False
                else:
                    near &= side[lo : lo + 512, None] != side[None, :]
                out_links += (near @ c).tolist()
            out_ids += [ids[r] for r in rows]
            at = stop
        return pa.table([pa.array(out_ids, pa.int64()), pa.array(out_links, pa.int64())], names=["id", "links"])

    return dealt.groupBy("part").applyInArrow(count, "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, least: float = 0.98, passes: int | None = None, window: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: (vec_id, n_links, component_id, kept).

    Rows link when their labels are equal and not null and their cosine is at least ``least``. Vectors that are null,
    empty, zero or hold a null or non-finite component link with nothing, nor do vectors of different lengths. Equal
    vectors of a label link with each other, rows with one id too; rows with one id and different vectors are told apart
    and have links of their own. component_id is the smallest id reachable; a null id is kept, its component is null.
    Other columns are ignored, whatever their names; an empty table gives an empty result. passes, window: by ``plan_passes``."""
    all_rows = materialize(usable(rows, id_col, vector_col, label_col).withColumn("digest", F.sha2("vector", 256)))
    distinct = all_rows.where("vector IS NOT NULL").groupBy("label", "digest", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # numbered as they are written, so that the numbers stay
    nodes = materialize(distinct.withColumn("id", F.monotonically_increasing_id()))
    means = materialize(label_means(nodes))
    total = means.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    centred = join_split(nodes, means.withColumn("size", F.col("n")), ["label"], "size", total)
    planned = plan_passes(centred, total, least) if passes is None or window is None else (passes, window)
    groups = materialize(components(window_links(centred, least, passes or planned[0], window or planned[1])))
    release(means)
    members = materialize(nodes.join(groups.withColumnRenamed("node", "id"), "id"))
    release(groups)
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), F.min("first").alias("smallest"))
    links = count_links(members.select("id", "component", "copies", "vector"), sizes.select("component", "size"), total, least)
    found = join_split(members.select("id", "component"), sizes, ["component"], "size", total).select("id", "smallest")
    known = nodes.select("label", "digest", "id", "first", "copies").join(found, "id", "left").join(links, "id", "left")
    per_node = known.select("label", "digest", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.least("smallest", "first").alias("component"))
    linked = join_split(all_rows.where("vector IS NOT NULL").drop("vector"), materialize(per_node), ["label", "digest"], "copies", total)
    alone = all_rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return linked.select("vec_id", "n_links", "component").unionByName(alone).select("vec_id", "n_links", component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op3_query(rows: DataFrame) -> DataFrame:
    """All rows of ``embeddings`` at cosine 0.98; nulls, repeats and empty tables as in ``near_duplicates``."""
    return near_duplicates(rows)


OP3_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT x.vec_id, (SELECT count(*) FROM links l WHERE l.a = x.vec_id) AS n_links,
       least(x.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = x.vec_id), x.vec_id)) AS component_id,
       x.vec_id = least(x.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = x.vec_id), x.vec_id)) AS kept
FROM embeddings x
"""
