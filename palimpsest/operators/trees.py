"""Directory trees and version trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.paths import prefixes
from palimpsest.sources.tables import materialize, release


def build_name_tree(paths: DataFrame) -> DataFrame:
    """(node_id, rdn, parent_id, path): a node for every prefix of every (path); ids are hashes of the whole path."""
    nodes = paths.select(F.explode(prefixes("path")).alias("path")).distinct()
    parts = F.split("path", "/", -1)
    parent = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))
    return nodes.select(F.xxhash64("path").alias("node_id"), F.element_at(parts, -1).alias("rdn"), F.when(parent.isNotNull(), F.xxhash64(parent)).alias("parent_id"), "path")


def resolve_names(nodes: DataFrame) -> DataFrame:
    """(node_id, path, depth) from (node_id, rdn, parent_id): level by level from the roots, one join a level."""
    n = nodes.select("node_id", "rdn", "parent_id")
    level = materialize(n.where("parent_id IS NULL").select("node_id", F.col("rdn").alias("path"), F.lit(1).alias("depth")))
    done = level
    while not level.isEmpty():
        above = level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("above"), "depth")
        level = materialize(n.hint("merge").join(above, "parent_id").select("node_id", F.concat_ws("/", "above", "rdn").alias("path"), (F.col("depth") + 1).alias("depth")))
        done = done.unionByName(level)
    return done


def subtree(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node_id, path): every node at or below each requested (root) path, by an equi join on exploded prefixes."""
    nodes = build_name_tree(paths).select("node_id", "path")
    return nodes.withColumn("root", F.explode(prefixes("path"))).hint("merge").join(roots.select("root").distinct(), "root").select("root", "node_id", "path")


KEY = ["file_id", "version_id"]
#: Rounds of doubling, more than any depth needs; a chain of bases that runs in a circle ends here too.
ROUNDS = 40


#: Versions of a file that are solved together in a task.
BLOCK = 4096
#: Longer than any way.
FAR = 1 << 40
LOCAL = "file_id bigint, version_id int, up int, reach bigint, amount bigint"


def _pointers_left(s: DataFrame) -> bool:
    return not s.where("up IS NOT NULL").isEmpty()


def _solve(file: np.ndarray, version: np.ndarray, up: np.ndarray, has_up: np.ndarray, amount: np.ndarray, what: str) -> tuple[np.ndarray, ...]:
    """(leaves, up, reach, amount) of whole blocks in order: the version outside of the block that a way leads to and in how many steps,
    and the amounts of the subtree (``sum``, ``nearest``) or the way (``way_sum``, ``way_nearest``) as far as they lie in the block."""
    n, block = len(version), version // BLOCK
    group = np.concatenate([[0], np.cumsum((file[1:] != file[:-1]) | (block[1:] != block[:-1]))])
    place, wanted = group * BLOCK + version - block * BLOCK, group * BLOCK + up - block * BLOCK
    inside = has_up & (up // BLOCK == block)
    at = np.minimum(np.searchsorted(place, wanted), n - 1)
    # the end of all ways is one more place, n
    to = np.append(np.where(inside & (place[at] == wanted), at, n), n)
    root, hops = np.where(to == n, np.arange(n + 1), to), (to != n).astype(np.int64)
    value = np.append(amount, FAR if "nearest" in what else 0)
    for k in range(BLOCK.bit_length()):
        if (to == n).all():
            break
        seen, from_ = value[to], np.flatnonzero(to != n)
        if what == "sum":
            value = value.copy()
            np.add.at(value, to[from_], value[from_].copy())
        elif what == "nearest":
            more = value[from_] + (1 << k)
            value = value.copy()
            np.minimum.at(value, to[from_], more)
        elif what == "way_sum":
            value = value + seen
        else:
            value = np.minimum(value, seen + (1 << k))
        hops, root, to = hops + hops[to], root[root], to[to]
    root, ended = root[:n], to[:n] == n
    leaves = ended & (has_up & ~inside)[root]
    return leaves, up[root], hops[:n] + 1, value[:n]


def _solver(what: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Solves a sorted stream of (file_id, version_id, up, amount, inflow) block by block; an inflow row adds to the version that follows it."""
    none = FAR if "nearest" in what else 0

    def solved(t: pa.Table) -> pa.RecordBatch:
        get = lambda c, null=0: t.column(c).combine_chunks().fill_null(null).to_numpy(zero_copy_only=False)
        file, version, up, amount, inflow = get("file_id"), get("version_id").astype(np.int64), get("up").astype(np.int64), get("amount", none), t.column("inflow").combine_chunks().to_numpy(zero_copy_only=False)
        has_up = ~np.asarray(t.column("up").combine_chunks().is_null().to_numpy(zero_copy_only=False))
        own = np.flatnonzero(~inflow)
        if len(own) < len(file):
            given = np.flatnonzero(inflow)
            amount = amount.copy()
            (np.minimum if what == "nearest" else np.add).at(amount, given + 1, amount[given])
            file, version, up, has_up, amount = (x[own] for x in (file, version, up, has_up, amount))
        leaves, to, reach, amount = _solve(file, version, up, has_up, amount, what)
        gone = amount >= FAR if "nearest" in what else np.zeros(len(amount), bool)
        columns = [pa.array(file), pa.array(version, pa.int32()), pa.array(to, pa.int32(), mask=~leaves), pa.array(reach, pa.int64(), mask=~leaves), pa.array(amount, pa.int64(), mask=gone)]
        return pa.RecordBatch.from_arrays(columns, names=["file_id", "version_id", "up", "reach", "amount"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            file, block = t.column("file_id").to_numpy(), t.column("version_id").to_numpy() // BLOCK
            cut = int(np.flatnonzero((file != file[-1]) | (block != block[-1]))[-1]) + 1 if (file[0] != file[-1] or block[0] != block[-1]) else 0
            if cut:
                yield solved(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield solved(held)

    return run


def _in_blocks(rows: DataFrame, what: str, inflow: DataFrame | None = None) -> DataFrame:
    """``rows`` (file_id, version_id, up, amount) after what can be solved inside blocks of versions: a shuffle by file and block, and a stream."""
    r = rows.where("file_id IS NOT NULL AND version_id IS NOT NULL").select(*KEY, F.col("up").cast("int").alias("up"), F.col("amount").cast("long").alias("amount"), F.lit(False).alias("inflow"))
    if inflow is not None:
        r = r.unionByName(inflow.select(*KEY, F.lit(None).cast("int").alias("up"), "amount", F.lit(True).alias("inflow")))
    dealt = r.repartition(F.col("file_id"), F.floor(F.col("version_id") / BLOCK)).sortWithinPartitions("file_id", "version_id", F.col("inflow").desc())
    return materialize(dealt.mapInArrow(_solver(what), LOCAL))


def _ports(local: DataFrame, what: str, amounts: DataFrame | None = None) -> DataFrame:
    """(file_id, version_id, amount) of the versions that ways from other blocks lead to, by doubling over these alone.

    ``amounts``: theirs, where they are not those of ``local``."""
    near = "nearest" in what
    asked = local.where("up IS NOT NULL").select("file_id", F.col("up").alias("version_id")).distinct()
    s = local.hint("merge").join(asked, KEY, "left_semi")
    s = materialize(s if amounts is None else s.drop("amount").hint("merge").join(amounts, KEY, "left"))
    for _ in range(ROUNDS):
        if not _pointers_left(s):
            break
        above = s.select("file_id", F.col("version_id").alias("up"), F.col("up").alias("__up"), F.col("reach").alias("__reach"), F.col("amount").alias("__amount"))
        new, more = s.hint("merge").join(above, ["file_id", "up"], "left"), F.col("__amount")
        if amounts is not None:
            below = s.where("up IS NOT NULL").groupBy("file_id", F.col("up").alias("version_id")).agg((F.min(F.col("amount") + F.col("reach")) if near else F.sum("amount")).alias("__more"))
            new, more = new.hint("merge").join(below, KEY, "left"), F.col("__more")
        elif near:
            more = more + F.col("reach")
        total = F.least("amount", more) if near else F.coalesce("amount", F.lit(0)) + F.coalesce(more, F.lit(0))
        out = materialize(new.select(*KEY, F.col("__up").alias("up"), (F.col("reach") + F.col("__reach")).alias("reach"), total.alias("amount")))
        release(s)
        s = out
    return s.select(*KEY, "amount")


def _over_subtrees(nodes: DataFrame, what: str) -> DataFrame:
    """(file_id, version_id, amount): the sum of the subtree of each of (file_id, version_id, up, amount), or the ``nearest``: the least of amounts plus steps.

    Blocks of a file's versions are solved in one task each. What leaves a block enters its ``up`` in another; these, few, are solved by doubling,
    and blocks are solved again with what enters them."""
    local = _in_blocks(nodes, what)
    if not _pointers_left(local):
        return local.select(*KEY, "amount")
    entering = local.where("reach = 1").groupBy("file_id", F.col("up").alias("version_id")).agg((F.min("amount") + 1 if what == "nearest" else F.sum("amount")).alias("amount"))
    given = _ports(local, what, entering).where("amount IS NOT NULL")
    out = _in_blocks(nodes, what, given).select(*KEY, "amount")
    release(local)
    return out


def _over_ways(nodes: DataFrame, what: str) -> DataFrame:
    """(file_id, version_id, amount): the sum along the way of each of (file_id, version_id, up, amount), itself included, or the least of amounts plus steps."""
    local = _in_blocks(nodes, what)
    if not _pointers_left(local):
        return local.select(*KEY, "amount")
    ports = _ports(local, what).select("file_id", F.col("version_id").alias("up"), F.col("amount").alias("__amount"))
    far = local.where("up IS NOT NULL").hint("merge").join(ports, ["file_id", "up"], "left")
    total = F.least("amount", F.col("__amount") + F.col("reach")) if what == "way_nearest" else F.col("amount") + F.coalesce("__amount", F.lit(0))
    return local.where("up IS NULL").select(*KEY, "amount").unionByName(far.select(*KEY, total.alias("amount")))


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(file_id, version_id, amount) summed over each version's subtree, itself included; from these and base_version_id."""
    return _over_subtrees(nodes.select(*KEY, F.col("base_version_id").alias("up"), "amount"), "sum")


#: Siblings and labels that are counted together.
LABELS = 256


def _sums_before(rows: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over the rows of the group with a smaller ``order``, in two levels: of blocks, and within a block."""
    before = lambda by, at: F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__block", F.floor(F.col(order) / LABELS))
    blocks = rows.groupBy(*group, "__block").agg(F.sum(value).alias(value)).select(*group, "__block", before(group, "__block").alias("__earlier"))
    inside = rows.withColumn("__inside", before([*group, "__block"], order)).hint("merge").join(blocks, [*group, "__block"])
    return inside.withColumn(name, F.col("__earlier") + F.col("__inside")).drop("__block", "__earlier", "__inside")


def version_labels(versions: DataFrame) -> DataFrame:
    """(file_id, version_id, first, last, depth): one row a version. A version is an ancestor of those of its file whose ``first`` lies from its
    own first to its last; itself is one of them.

    ``first`` is the place in preorder, children by id, from subtree sizes and their sums over elder siblings, summed up along the way
    to the root. A version whose base is not there is a root."""
    v = versions.select(*KEY, "base_version_id")
    there = v.select("file_id", F.col("version_id").alias("base_version_id"), F.lit(True).alias("__there"))
    tree = materialize(v.hint("merge").join(there, ["file_id", "base_version_id"], "left").select(*KEY, F.when(F.col("__there"), F.col("base_version_id")).alias("base_version_id")))
    sizes = subtree_sums(tree.withColumn("amount", F.lit(1)))
    rows = tree.hint("merge").join(sizes.withColumnRenamed("amount", "size"), KEY).withColumn("parent", F.coalesce("base_version_id", F.lit(-1)))
    rows = materialize(_sums_before(rows, ["file_id", "parent"], "version_id", "size", "elder"))
    # both sums of the way in one number: the place in the lower half, the versions on the way in the upper
    step = F.col("elder") + F.col("base_version_id").isNotNull().cast("long") + F.lit(1 << 32)
    ways = way_sums(rows.select(*KEY, F.col("base_version_id").alias("next"), step.alias("amount")))
    first = F.col("amount").bitwiseAND(F.lit((1 << 32) - 1))
    out = materialize(ways.hint("merge").join(rows.select(*KEY, "size"), KEY).select(*KEY, first.alias("first"), (first + F.col("size") - 1).alias("last"), (F.shiftright("amount", 32) - 1).cast("int").alias("depth")))
    release(tree, rows)
    return out


def descendants(labels: DataFrame, asked: DataFrame) -> DataFrame:
    """(file_id, ancestor, descendant, depth) for the asked (file_id, version_id), each with itself at depth 0.

    An interval is dealt to the blocks of places that it covers and meets their versions by file and block, so a file of very many
    versions is several tasks and rows grow with the answer."""
    own = labels.hint("merge").join(asked.select(*KEY).distinct(), KEY, "left_semi")
    block = lambda c: F.floor(F.col(c) / LABELS)
    above = own.select("file_id", F.col("version_id").alias("ancestor"), F.col("first").alias("from"), F.col("last").alias("to"), F.col("depth").alias("above"), F.explode(F.sequence(block("first"), block("last"))).alias("block"))
    below = labels.select("file_id", F.col("version_id").alias("descendant"), "first", F.col("depth").alias("below"), block("first").alias("block"))
    return above.hint("merge").join(below, ["file_id", "block"]).where("first BETWEEN from AND to").select("file_id", "ancestor", "descendant", (F.col("below") - F.col("above")).alias("depth"))


def is_ancestor(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file_id, ancestor, descendant) with ``related``: is the one above the other, or the same? False for versions that are not there."""
    a = labels.select("file_id", F.col("version_id").alias("ancestor"), F.col("first").alias("from"), F.col("last").alias("to"))
    d = labels.select("file_id", F.col("version_id").alias("descendant"), "first")
    joined = pairs.select("file_id", "ancestor", "descendant").hint("merge").join(a, ["file_id", "ancestor"], "left").hint("merge").join(d, ["file_id", "descendant"], "left")
    return joined.select("file_id", "ancestor", "descendant", F.coalesce(F.col("first").between(F.col("from"), F.col("to")), F.lit(False)).alias("related"))


def version_closure(versions: DataFrame) -> DataFrame:
    """(file_id, ancestor, descendant, depth) over base_version_id, each version with itself at depth 0: all pairs, from the labels."""
    labels = version_labels(versions)
    return descendants(labels, labels)


def image_distances(versions: DataFrame) -> DataFrame:
    """(file_id, version_id, next, far): edges to the nearest version with an image, in either direction of the tree, and
    the first version on the way; next is null at images (far 0), no row where there is no way.

    First the nearest image below each version, then that of its ancestors. Of equally near ways a version takes
    its base, then the child with the lowest id. Deletion marks have no content and lead nowhere."""
    v = versions.where("size IS NOT NULL").select(*KEY, "base_version_id", "has_image")
    there = v.select("file_id", F.col("version_id").alias("base_version_id"), F.lit(True).alias("__there"))
    tree = materialize(v.hint("merge").join(there, ["file_id", "base_version_id"], "left").select(*KEY, F.when(F.col("__there"), F.col("base_version_id")).alias("base"), F.when(F.col("has_image"), F.lit(0)).cast("long").alias("far")))
    up = tree.select(*KEY, F.col("base").alias("up"), F.col("far").alias("amount"))
    below = _over_subtrees(up, "nearest")
    s = _over_ways(below.hint("merge").join(up.drop("amount"), KEY), "way_nearest").withColumnRenamed("amount", "far")
    near = materialize(s.where("far IS NOT NULL").select(*KEY, "far").hint("merge").join(tree.select(*KEY, "base"), KEY))
    release(tree)
    over = near.select("file_id", F.col("version_id").alias("base"), F.col("far").alias("base_far"))
    both = near.hint("merge").join(over, ["file_id", "base"], "left")
    child = both.where("base_far = far + 1").groupBy("file_id", F.col("base").alias("version_id")).agg(F.min("version_id").alias("child"))
    step = F.when(F.col("base_far") == F.col("far") - 1, F.col("base")).otherwise(F.col("child"))
    return materialize(both.hint("merge").join(child, KEY, "left").select(*KEY, F.when(F.col("far") > 0, step).alias("next"), "far"))


def _along(hop: DataFrame) -> DataFrame:
    """The ways that begin at each ``at`` of (file_id, at, next, ...), hop by hop: (file_id, source, step, at, next, ...). They double in length with each join."""
    jump = hop.hint("merge").join(hop.select("file_id", F.col("at").alias("next")), ["file_id", "next"], "left_semi").select("file_id", "at", F.col("next").alias("to"))
    ways, jump, reach = hop.select("file_id", F.col("at").alias("source"), F.lit(0).alias("step"), "at"), materialize(jump), 1
    while not jump.isEmpty():
        more = ways.hint("merge").join(jump, ["file_id", "at"]).select("file_id", "source", (F.col("step") + reach).alias("step"), F.col("to").alias("at"))
        ways = materialize(ways.unionByName(more))
        last, jump = jump, materialize(jump.hint("merge").join(jump.select("file_id", F.col("at").alias("to"), F.col("to").alias("on")), ["file_id", "to"]).select("file_id", "at", F.col("on").alias("to")))
        release(last)
        reach *= 2
    return ways.hint("merge").join(hop, ["file_id", "at"]).select("file_id", "source", "step", *[c for c in hop.columns if c != "file_id"])


def nearest_image_path(versions: DataFrame) -> DataFrame:
    """(file_id, source, step, at, next): the way of ``image_distances`` hop by hop, for each version without an image (no marks).

    Versions with an image, and those without a way, have no rows."""
    return _along(materialize(image_distances(versions).where("next IS NOT NULL").select("file_id", F.col("version_id").alias("at"), "next")))


def nearest_image_edges(versions: DataFrame) -> DataFrame:
    """The same with ``chain_edges``, which are told once for each version and not for each way that leads over it."""
    return _along(materialize(chain_edges(first_hops(versions), versions).drop("source", "step")))


def way_sums(hops: DataFrame) -> DataFrame:
    """(file_id, version_id, amount): the amounts of (file_id, version_id, next, amount) summed along each version's way."""
    return _over_ways(hops.select(*KEY, F.col("next").alias("up"), "amount"), "way_sum")


def first_hops(versions: DataFrame) -> DataFrame:
    """(file_id, source, step, at, next, far): the first hop, step 0, of every way."""
    hop = image_distances(versions).where("next IS NOT NULL")
    return hop.select("file_id", F.col("version_id").alias("source"), F.lit(0).alias("step"), F.col("version_id").alias("at"), "next", "far")


def chain_edges(ways: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds to each hop ``direction`` and ``edge_version_id``, the version whose deltas it uses.

    From ``at`` to ``next``: FORWARD if next is at's base, REVERSE if at is next's base, BROKEN otherwise."""
    base = versions.select("file_id", F.col("version_id").alias("at"), F.col("base_version_id").alias("at_base"))
    back = versions.select("file_id", F.col("version_id").alias("next"), F.col("base_version_id").alias("next_base"))
    j = ways.hint("merge").join(base, ["file_id", "at"], "left").hint("merge").join(back, ["file_id", "next"], "left")
    direction = F.when(F.col("at_base") == F.col("next"), "FORWARD").when(F.col("next_base") == F.col("at"), "REVERSE").otherwise("BROKEN")
    edge = F.when(F.col("at_base") == F.col("next"), F.col("at")).when(F.col("next_base") == F.col("at"), F.col("next"))
    return j.select("file_id", "source", "step", "at", "next", direction.alias("direction"), edge.alias("edge_version_id"))


def delta_lengths(versions: DataFrame) -> DataFrame:
    """Stored length per delta type, 0 if absent."""
    return versions.select("file_id", "version_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("cdelta_len", "fdelta_len", "rdelta_len")])


def chain_size(versions: DataFrame) -> DataFrame:
    """(file_id, version_id, chain_size): common and directional deltas on the way to the nearest image; 0 where there is one."""
    hops = chain_edges(first_hops(versions), versions)
    d = delta_lengths(versions).withColumnRenamed("version_id", "edge_version_id")
    cost = F.col("cdelta_len") + F.when(F.col("direction") == "FORWARD", F.col("fdelta_len")).otherwise(F.col("rdelta_len"))
    sums = way_sums(hops.hint("merge").join(d, ["file_id", "edge_version_id"]).select("file_id", F.col("source").alias("version_id"), "next", cost.alias("amount")))
    stored = versions.where("has_image AND size IS NOT NULL").select("file_id", "version_id", F.lit(0).cast("long").alias("chain_size"))
    return stored.unionByName(sums.withColumnRenamed("amount", "chain_size"))
