"""Jaccard similarity join on word n-grams, by filtering under several global token orders.

A token is the 62-bit hash of a shingle behind two bits that say how many chunks have it. Under any global order of tokens, two sets of
similarity t share one of the first ``n - ceil(t n) + 1`` tokens of each; so candidates must share a prefix token under
every one of several orders, and only pairs that pass all of them are compared in full.

1. Rarest first. Chunks ask how many others have their tokens. Those that none has come first under this order and
   match nothing, so they are dropped from the set and from its prefix (the set keeps its size n). A document with fewer than
   ``ceil(t n)`` shared tokens cannot have a partner and leaves here with most others, before anything but packed fingerprints has moved.
2. Equal sets are one node from here on, whatever their number.
3. Links for the large groups: under each hashed order, sets with the same first token are sorted by their tokens in that
   order and compared with their predecessors. Every link is a verified one. This joins near copies into components.
4. The rest, exactly. Prefix tokens under the rarest-first order that span more than one component give the candidates:
   pairs of different components that fit in size must share prefix tokens under the hashed orders too, then are compared in full.
   A token of more than ``HOT`` sets does not give pairs but families: sets that are connected by such tokens and then, within a family, by
   prefix tokens under a hashed order. A family's similar sets share tokens under both orders, so none is lost; they are
   compared in full, block against block of similar size, in matrix products that give back a spanning tree of links, never
   pairs. Those of the family's largest component are not compared with each other, so its cost grows with the sets outside of that
   times the family.

Only which sets are connected is kept, which is all that components need; no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import join_split, materialize, release, slices, with_ids
from palimpsest.llm.components import components
from palimpsest.llm.exchange import MESSAGE, ask_shared, answered, chunked, messages, mix, seen_by_others

#: A token in more chunks than each of these is of a more frequent class.
CLASSES = (1, 4, 32)
#: Seeds of the hashed orders; the rarest-first order is that of the tokens as numbers.
RAREST = None
ORDERS = (0x1B873593, 0x38495AB5, 0x5BD1E995)
#: Predecessors under the same first token that a set is compared with in step 3.
NEIGHBOURS = 3
#: Tokens by which sets are dealt to ranges there.
LEAD = 32
#: Bytes of sets that are taken up at once.
SLICE = 4 << 20
#: A prefix token of more sets than this is frequent.
HOT = 32
#: Sets in a block of a family.
BLOCK = 256
SETS = "id bigint, n bigint, shared bigint, tokens binary"


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def token_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text.

    Words are runs of anything but space and tab to carriage return, with A-Z lower-cased. A text with fewer words than
    ``size`` has its whole sequence as its only shingle, one without words has none."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    h = word_hashes([w for ws in split for w in ws])
    full = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        full = mix(full * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(full)])
    out, at = [], 0
    for ws in split:
        n = len(ws)
        if n >= size:
            out.append(np.unique(full[at : at + n - size + 1]))
        elif n:
            x = np.full(1, n, np.uint64)
            for i in range(n):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[at + i : at + i + 1])
            out.append(x)
        else:
            out.append(full[:0])
        at += n
    return out


def least_overlap(n, percent: int):
    """ceil(percent n / 100): the least overlap that a set of n tokens has with any partner."""
    return -(-percent * n // 100)


def is_similar(a: np.ndarray, b: np.ndarray, n: int, m: int, percent: int) -> bool:
    """100 * intersection >= percent * union, for the ascending distinct shared tokens of sets of n and m."""
    if 100 * min(n, m) < percent * max(n, m) or (100 + percent) * min(len(a), len(b)) < percent * (n + m):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return (100 + percent) * common >= percent * (n + m)


def prefix(tokens: np.ndarray, n: int, percent: int, seed: int | None, most: int | None = None) -> np.ndarray:
    """The first tokens of a set of n under an order, of which any partner has one."""
    length = len(tokens) - int(least_overlap(n, percent)) + 1
    length = length if most is None else min(length, most)
    if length >= len(tokens):
        return tokens
    if seed is RAREST:
        return tokens[:length]
    return tokens[np.argpartition(mix(tokens ^ np.uint64(seed)), length - 1)[:length]]


def in_order(tokens: np.ndarray, seed: int) -> np.ndarray:
    """All tokens of a set under a hashed order."""
    return tokens[np.argsort(mix(tokens ^ np.uint64(seed)))]


def document_sets(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, shared, tokens) of every row; ``tokens``: the shared ones, of rows that can have a partner, else null."""
    rows, n_chunks = chunked(docs, id_col, text_col)
    by_chunk = rows.groupBy("chunk")

    def per_document(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        sets = token_sets(t["text"].to_pylist(), size)
        uniq, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0))
        return sets, uniq, counts > 1

    def ask(t: pa.Table) -> pa.Table:
        return messages(ask_shared(per_document(t)[1], t["chunk"][0].as_py(), n_chunks))

    def alive(t: pa.Table, back: pa.Table) -> pa.Table:
        sets, uniq, several = per_document(t)
        got = dict(zip(back["bucket"].to_pylist(), back["data"].to_pylist(), strict=True))
        several |= answered(uniq, n_chunks, got)
        kind = sum((answered(uniq, n_chunks, got, i).astype(np.uint64) for i in range(1, len(CLASSES))), np.zeros(len(uniq), np.uint64))
        named = kind << np.uint64(62) | uniq >> np.uint64(2)
        sizes, shared, tokens = [], [], []
        for s in sets:
            at = np.searchsorted(uniq, s)
            common = np.sort(named[at[several[at]]])
            sizes.append(len(s))
            shared.append(len(common))
            tokens.append(common.tobytes() if len(s) and len(common) >= least_overlap(len(s), percent) else None)
        return pa.table([t["doc_id"].cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), pa.array(tokens, pa.binary())], names=["id", "n", "shared", "tokens"])

    answers = seen_by_others(by_chunk.applyInArrow(ask, MESSAGE), CLASSES)
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(alive, SETS)


def prefix_tokens(nodes: DataFrame, percent: int, seeds: tuple[int | None, ...], most: int | None = None) -> DataFrame:
    """(k, token, id, n): the prefix of each set (id, n, tokens) under each order k, or its first ``most`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, SLICE, 2):
                found, rows, orders = [], [], []
                for row, (n, data) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    tokens = np.frombuffer(data, dtype="<u8")
                    found += [prefix(tokens, n, percent, seed, most) for seed in seeds]
                    rows += [row] * len(seeds)
                    orders += range(len(seeds))
                sizes = [len(f) for f in found]
                at = pa.array(np.repeat(np.array(rows, np.int64), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(orders, np.int32), sizes)), pa.array(np.concatenate(found).view(np.int64)), b.column(0).take(at), b.column(1).take(at)], names=["k", "token", "id", "n"])

    return nodes.select("id", "n", "tokens").mapInArrow(run, "k int, token bigint, id bigint, n bigint")


def links_by_head(nodes: DataFrame, percent: int) -> DataFrame:
    """Verified (a, b) between sets that have the same first token under an order, each with its predecessors by size."""
    heads = materialize(prefix_tokens(nodes, percent, ORDERS, 1))
    # only tokens that head several sets; the counts are combined map-side
    common = heads.groupBy("k", "token").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    near = heads.join(common, ["k", "token"]).join(nodes.select("id", "tokens"), "id").select("k", "token", "n", "id", "tokens")

    def put_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, SLICE, 4)):
            under = [in_order(np.frombuffer(x, dtype="<u8"), ORDERS[k]).tobytes() for k, x in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(under, pa.binary())], names=b.schema.names)

    near = near.mapInArrow(put_in_order, "k int, token bigint, n bigint, id bigint, tokens binary").withColumn("lead", F.substring("tokens", 1, 8 * LEAD))
    # ranges also split a token that heads a third of all sets; neighbours have the longest beginnings in common
    near = near.repartitionByRange("k", "token", "lead", "id").sortWithinPartitions("k", "token", "tokens", "id").drop("lead")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, before = None, []
        for b in (x for batch in batches for x in slices(batch, SLICE, 4)):
            found = []
            for k, token, n, node, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k, token) != group:
                    group, before = (k, token), []
                mine = np.frombuffer(data, dtype="<u8")
                found += [(other, node) for other, m, theirs in before if is_similar(theirs, mine, m, n, percent)]
                before = [*before[-(NEIGHBOURS - 1) :], (node, n, mine)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return near.mapInArrow(compare, "a bigint, b bigint")


def rare_links(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Verified (a, b) of different components that share one of the prefix tokens in rows (token, id, n, component)."""
    right = rows.select("token", F.col("id").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"))
    pairs = rows.withColumnRenamed("id", "a").join(right, "token").where(f"a < b AND component <> other AND 100 * least(n, m) >= {percent} * greatest(n, m)").select("a", "b").distinct()
    sets = nodes.select("id", "n", "tokens")
    full = pairs.join(sets.select(F.col("id").alias("a"), "n", F.col("tokens").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y", "n", "m")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, SLICE, 2)):
            yes = []
            for x, y, n, m in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                p, q = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                passed = all(np.isin(prefix(p, n, percent, seed), prefix(q, m, percent, seed)).any() for seed in ORDERS)
                yes.append(passed and is_similar(p, q, n, m, percent))
            yield b.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return full.mapInArrow(verify, "a bigint, b bigint")


def families(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(id, family) of the sets that share frequent prefix tokens, rows (token, id), and prefix tokens of the first hashed order."""

    def joined(tokens: DataFrame) -> DataFrame:
        tokens = materialize(tokens)
        first = tokens.groupBy("token").agg(F.min("id").alias("lead"), F.count("*").alias("c"))
        stars = join_split(tokens, first, ["token"], "c", tokens.count()).select(F.col("id").alias("a"), F.col("lead").alias("b"))
        made = materialize(components(stars).withColumnRenamed("node", "id").withColumnRenamed("component", "family"))
        release(tokens)
        return made

    rare = joined(rows.select("token", "id"))
    again = prefix_tokens(nodes.join(rare, "id", "left_semi"), percent, ORDERS[:1]).join(rare, "id")
    return joined(again.select(F.xxhash64("family", "token").alias("token"), "id"))


def family_links(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links that join all similar sets among those that share frequent prefix tokens, rows (token, id, n, component)."""
    member = families(rows, nodes, percent).join(rows.select("id", "component").distinct(), "id")
    largest = member.groupBy("family", "component").agg(F.count("*").alias("c")).groupBy("family").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("c"))
    # similar sets lie in one size class or in neighbouring ones
    sized = materialize(
        join_split(member, largest, ["family"], "c", member.count())
        .join(nodes.select("id", "n"), "id")
        .select("id", "family", F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent))).cast("int").alias("class"), (F.col("component") == F.col("main")).alias("joined"))
    )
    total, of = sized.count(), ["family", "class"]
    # the blocks of each class: first those of the largest component, then the others
    of_main = F.ceil(F.count_if("joined") / BLOCK).cast("int")
    blocks = materialize(sized.groupBy(*of).agg(F.count("*").alias("c"), of_main.alias("split"), (of_main + F.ceil(F.count_if(~F.col("joined")) / BLOCK)).cast("int").alias("blocks")))
    place = lambda n: F.pmod(F.xxhash64("id"), n)
    own = materialize(join_split(sized, blocks, of, "c", total).withColumn("block", F.when(F.col("joined"), place(F.col("split"))).otherwise(F.col("split") + place(F.col("blocks") - F.col("split"))).cast("int")))

    def against(rows: DataFrame, split: str, last: str) -> DataFrame:
        """Each row with the blocks that it is compared with: those of the largest component with others only."""
        first = F.when(F.col("joined"), F.col(split)).otherwise(0)
        return rows.withColumn("other", F.explode(F.when(first < F.col(last), F.sequence(first, F.col(last) - 1))))

    neighbour = lambda step: blocks.select("family", (F.col("class") - step).alias("class"), F.col("split").alias("s"), F.col("blocks").alias("b")).join(blocks.drop("blocks", "split"), of)
    beside = lambda step: against(join_split(own, neighbour(step), of, "c", total), "s", "b")
    inner = against(own, "split", "blocks").select("family", F.col("class").alias("c1"), F.least("block", "other").alias("i"), F.col("class").alias("c2"), F.greatest("block", "other").alias("j"), "id")
    low = beside(1).select("family", F.col("class").alias("c1"), F.col("block").alias("i"), (F.col("class") + 1).alias("c2"), F.col("other").alias("j"), "id")
    high = beside(-1).select("family", (F.col("class") - 1).alias("c1"), F.col("other").alias("i"), F.col("class").alias("c2"), F.col("block").alias("j"), "id")
    dealt = inner.unionByName(low).unionByName(high).join(nodes.select("id", "n", "tokens"), "id")

    def compare(t: pa.Table) -> pa.Table:
        ids, n = t["id"].to_pylist(), t["n"].to_numpy()
        sets = [np.frombuffer(x, dtype="<u8") for x in t["tokens"].to_pylist()]
        uniq, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(counts > 1) - 1
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        shared = (counts > 1)[at]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = 1 << 14
        for lo in range(0, int(column[-1]) + 1, width):  # of the tokens that occur twice here, so many at once
            inside = shared & (column[at] >= lo) & (column[at] < lo + width)
            m = np.zeros((len(sets), min(width, int(column[-1]) + 1 - lo)), np.float32)
            m[row[inside], column[at[inside]] - lo] = 1
            common += m @ m.T
        near = (100 + percent) * common.astype(np.int64) >= percent * (n[:, None] + n[None, :])
        np.fill_diagonal(near, False)
        # a spanning tree of what is connected here
        left, found = set(range(len(ids))), []
        while left:
            todo = [left.pop()]
            while todo:
                x = todo.pop()
                for y in np.flatnonzero(near[x]).tolist():
                    if y in left:
                        left.discard(y)
                        todo.append(y)
                        found.append((ids[x], ids[y]))
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.groupBy("family", "c1", "i", "c2", "j").applyInArrow(compare, "a bigint, b bigint")


def links_between(nodes: DataFrame, component_of: DataFrame, percent: int) -> DataFrame:
    """Links that join all similar sets of different components."""
    placed = nodes.select("id").join(component_of.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    tokens = materialize(prefix_tokens(nodes, percent, (RAREST,)).drop("k").join(placed, "id"))
    # min, max and count are combined map-side: the tokens of a large component disappear without meeting in a task
    spanning = tokens.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("sets")).where("lo <> hi").drop("lo", "hi")
    rows = materialize(join_split(tokens, spanning.withColumn("c", F.col("sets")), ["token"], "c", tokens.count()))
    release(tokens)
    rare = rare_links(rows.where(F.col("sets") <= HOT).drop("sets"), nodes, percent)
    frequent = rows.where(F.col("sets") > HOT).drop("sets")
    return rare if frequent.isEmpty() else rare.unionByName(family_links(frequent, nodes, percent))


def similar_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id).

    Sets link when 100 * intersection >= percent * union; component_id is the smallest id reachable by links, itself
    included. Null, empty and blank texts have no shingles and link with nothing. A null id is its own component; rows
    with one id are one node, which has all their links. Ids are whole numbers. Texts are read whole, however long;
    repeated rows are counted each. Other columns are ignored, whatever their names; an empty table gives an empty result.
    Shingles are compared by 62-bit hashes."""
    all_rows = materialize(document_sets(docs, size, percent, id_col, text_col))
    alive = all_rows.where("tokens IS NOT NULL AND id IS NOT NULL")
    # a set with tokens that no other has equals none, though its shared ones may be another's too
    alone = F.when(F.col("shared") < F.col("n"), F.col("id").cast("string")).otherwise("")
    same = alive.withColumn("digest", F.concat_ws(":", F.sha2("tokens", 256), alone))
    nodes = materialize(same.groupBy("digest").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min_by("tokens", "id").alias("tokens"), F.count("*").alias("c")))
    total = nodes.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    equal = join_split(same.select(F.col("id").alias("a"), "digest"), nodes.select("digest", F.col("id").alias("b"), "c"), ["digest"], "c", total).where("a <> b").select("a", "b")
    # a repeated id may stand for different sets: nodes of one id are one node
    sets = nodes.select("id", "n", "tokens")
    near = materialize(links_by_head(sets, percent))
    rest = materialize(links_between(sets, components(near), percent))
    groups = components(near.unionByName(rest).unionByName(equal))
    joined = all_rows.join(groups, all_rows["id"] == groups["node"], "left")
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The row with the smallest id of each group of similar documents, all columns as they came. Rows of one id collapse;
    rows with a null id stay. Null, blank and empty texts stay; an empty table gives an empty result."""
    first = similar_components(docs, size, percent).where("doc_id = component_id").select("doc_id")
    return with_ids(docs, first).unionByName(docs.where("doc_id IS NULL"))


def op9_query(docs: DataFrame) -> DataFrame:
    """Three words, 90 %; nulls, repeats and empty tables as in ``similar_components``."""
    return similar_components(docs, 3, 90)


def brute_force(docs: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """id -> (n_shingles, component_id), all pairs, for small tests."""
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            least, most = sorted((len(x), len(y)))
            if least and 100 * least >= percent * most and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(s), find(d)) for d, s in sets.items()}
