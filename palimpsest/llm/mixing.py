"""Mixing sources to target weights by budget fitting.

Documents are counted by source and exact size. A source's target is whole passes over it and a remaining budget, to be met by documents
that are taken once more: a subset-sum problem over the counts. The bulk of the budget is shared out over all sizes in proportion, from
the longest down, each size taking what the longer ones left over; the last ``RESERVE`` words and what is left are fitted by a
bounded-knapsack program over the documents that remain. Which documents of a size are taken follows from hashes of their ids:
those with the smallest, found by counts of hash ranges, so no task ranks a size's documents as a whole.

Rows of an input partition that are equal in id, source and size are one unit with a count, and come out again as that many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import join_split, materialize, release
from palimpsest.operators.numbering import numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a budget that are fitted exactly and not in proportion.
RESERVE = 1 << 13
#: The part of a small budget that is fitted so.
RESERVE_SHARE = 8
#: Units in a range of hashes, and ranges that are counted together.
RANGE, RANGES = 64, 1024
UNIT = ["src", "size"]


def water_level(sources: DataFrame, budget: float) -> float:
    """Words for each unit of weight when ``budget`` is shared by weight and no source gets more than its ``most``.

    Sources above their limit are cut to it and the excess goes to the others, until none is above: one aggregate a round."""
    level, held = 0.0, -1
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        r = sources.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("most"))).alias("kept"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if not r.weight or r.n == held:
            return level
        level, held = (budget - (r.kept or 0)) / r.weight, r.n


def targets(counts: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(src, source_size, target) of (src, size, n): sources by code point, null last, weigh ``weights`` in turn."""
    sizes = counts.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    # src is 'n' for null and '=' before a name, so its order has null last
    placed = numbered(sizes, [F.col("src").asc()], "__nth")
    turn = (F.pmod("__nth", F.lit(len(weights))) + 1).cast("int")
    sources = materialize(placed.select("src", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn).alias("weight"), (F.col("source_size") * most).alias("most")))
    release(placed)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, share * total)
    return sources.select("src", "source_size", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def fitted(lengths: list[int], left: list[int], budget: int) -> dict[int, int]:
    """How many documents of each length, at most ``left`` of it, have a sum as near to ``budget`` as can be (the smaller of two).

    Bounded knapsack over reachable sums, which are the bits of one number: each length adds itself 1, 2, 4, ... times. ``step`` keeps by
    which step a sum was first reached, so a way back to 0 never uses a step twice. Sums above twice the budget are further from it
    than 0 is."""
    ways = sorted(((v, c) for v, c in zip(lengths, left, strict=True) if c and v), reverse=True)
    if budget <= 0 or not ways:
        return {}
    top = 2 * budget
    steps = []
    for length, count in ways:
        most, times = min(count, top // length), 1
        while most:
            times = min(times, most)
            steps.append((length, times))
            most, times = most - times, times * 2
    # one document of each length first, so that no length is used up before others
    steps.sort(key=lambda s: (s[1], -s[0]))
    mask, reach, step = (1 << (top + 1)) - 1, 1, {}
    for n, (length, times) in enumerate(steps):
        new = (reach << (length * times)) & mask & ~reach
        reach |= new
        for s in _bits(new):
            step[s] = n
        if reach >> budget & 1:
            break
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    best = below
    if above and (above & -above).bit_length() < budget - below:
        best = budget + (above & -above).bit_length()
    out: dict[int, int] = {}
    while best:
        length, times = steps[step[best]]
        out[length] = out.get(length, 0) + times
        best -= length * times
    return out


def _bits(n: int) -> Iterator[int]:
    data = n.to_bytes((n.bit_length() + 7) // 8, "little")
    for at, byte in enumerate(data):
        while byte:
            low = byte & -byte
            yield at * 8 + low.bit_length() - 1
            byte ^= low


def chosen_counts(sizes: list[int], counts: list[int], budget: int, reserve: int = RESERVE) -> list[int]:
    """Documents of each size whose words sum up to ``budget`` or as near as the last ``reserve`` words can be fitted."""
    total, goal = sum(s * n for s, n in zip(sizes, counts, strict=True)), budget - min(reserve, budget // RESERVE_SHARE)
    order, taken, seen, used = sorted(range(len(sizes)), key=lambda i: -sizes[i]), [0] * len(sizes), 0, 0
    for i in order:
        if not sizes[i]:
            continue
        seen += sizes[i] * counts[i]
        # what is due up to this size, in proportion, and not taken by longer ones
        taken[i] = min(counts[i], max(0, goal * seen // total - used) // sizes[i])
        used += taken[i] * sizes[i]
    for length, more in fitted(sizes, [c - t for c, t in zip(counts, taken, strict=True)], budget - used).items():
        taken[sizes.index(length)] += more
    return taken


def plan(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """(src, size, n, source_size, target, passes, more): ``more`` of the n documents of a size are taken once more than ``passes``.

    One group is the distinct sizes of one source: fewer than the square root of twice its words."""

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("size").reset_index(drop=True)
        whole, size = int(own.target.iloc[0] + 0.5), int(own.source_size.iloc[0])
        passes = whole // size if size else 0
        more = chosen_counts(own["size"].tolist(), own["n"].tolist(), whole - passes * size)
        return own.assign(passes=passes, more=more)[["src", "size", "n", "source_size", "target", "passes", "more"]]

    return counts.join(goals, "src").groupBy("src").applyInPandas(fit, "src string, size bigint, n bigint, source_size bigint, target double, passes bigint, more bigint")


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: str) -> DataFrame:
    """(doc_id, src, size, salt) of each row, and ``more`` of its columns under names of their own."""
    source = F.col(source_col).cast("string")
    src = F.when(source.isNull(), "n").otherwise(F.concat(F.lit("="), source))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), src.alias("src"), size.alias("size"), F.spark_partition_id().alias("salt"), *[F.col(c).alias(f"__{c}") for c in more])


def picked(units: DataFrame, made: DataFrame, rows: int, seed: int) -> DataFrame:
    """Units (doc_id, src, size, salt, n) with the plan of their size, and ``again``: how many of their rows are taken once more.

    Taken are the rows with the smallest hashes of their ids. A size's rows fall into ranges of about ``RANGE`` by hash; ranges are
    counted, their counts summed up in two levels, and rows are ranked within a range only."""
    small = made.select(*UNIT, "source_size", "target", "passes", "more", F.ceil(F.col("n") / RANGE).alias("ranges"), F.col("n").alias("docs"))
    at = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) * F.lit(2.0**-53)
    u = join_split(units, small, UNIT, "docs", rows).withColumn("at", at)
    u = materialize(u.withColumn("range", F.floor(F.col("at") * F.col("ranges"))))
    key, above = [*UNIT, "range"], [*UNIT, "block"]

    def before(by: list[str], *order: str, of: str = "rows") -> Column:
        return F.coalesce(F.sum(of).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    each = u.groupBy(*key).agg(F.sum("n").alias("rows")).withColumn("block", F.floor(F.col("range") / RANGES))
    blocks = each.groupBy(*above).agg(F.sum("rows").alias("rows")).select(*above, before(UNIT, "block").alias("earlier"))
    first = each.withColumn("inside", before(above, "range")).join(blocks, above).select(*key, (F.col("earlier") + F.col("inside")).alias("first"))
    ranked = u.join(first, key).withColumn("place", F.col("first") + before(key, "at", "doc_id", "salt", of="n"))
    again = F.least(F.col("n"), F.greatest(F.lit(0), F.col("more") - F.col("place")))
    return ranked.select("doc_id", "src", "size", "salt", "n", "source_size", "target", F.col("passes").alias("copies"), again.alias("again"))


def mix(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 11) -> DataFrame:
    """(doc_id, src, size, salt, n, source_size, target, copies, again) of ``keyed`` rows: a unit is n rows, each taken ``copies`` times, and
    ``again`` of them once more.

    A row's size is its number of words, 0 for a null or blank text. All sources share ``share`` times all words by weight; none gets more
    than ``most`` times its own. Each source's words come as near to its target as documents allow: exactly where a sum of sizes does.
    The result follows from ids, sources, sizes and the seed, not from the order or partitions of rows. Rows of null or repeated ids
    count each for itself; which of those with equal sizes is taken shows in nothing. Rows of size 0 are never taken once more, and a
    source that has only such has target 0. An empty table gives an empty result."""
    units = materialize(rows.groupBy("doc_id", "src", "size", "salt").agg(F.count("*").alias("n")))
    counts = materialize(units.groupBy(*UNIT).agg(F.sum("n").cast("long").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    made = materialize(plan(counts, targets(counts, weights, share, most)))
    return picked(units, made, total, seed)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, all columns as they came.

    Rows of one unit are told apart by an order of their texts. Nulls, repeats and empty tables as in ``mix``."""
    rows = materialize(keyed(docs, id_col, text_col, source_col, *docs.columns))
    unit = ["doc_id", "src", "size", "salt"]
    u = mix(rows, **how).select(F.col("doc_id").alias("u"), *unit[1:], "copies", "again")
    nth = F.row_number().over(Window.partitionBy(*unit).orderBy(f"__{text_col}"))
    # ids go last: they may be null
    taken = rows.withColumn("nth", nth).alias("r").join(u.alias("u"), [F.col("doc_id").eqNullSafe(F.col("u")), *[F.col(f"r.{c}") == F.col(f"u.{c}") for c in unit[1:]]]).drop(*[F.col(f"u.{c}") for c in unit[1:]])
    times = F.col("copies") + (F.col("nth") <= F.col("again")).cast("long")
    out = taken.withColumn("times", times).where("size > 0 AND times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(*[F.col(f"__{c}").alias(c) for c in docs.columns])


def op11_query(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; nulls, repeats and empty tables as in ``mix``; other columns, whatever
    their names, are ignored."""
    u = mix(keyed(docs, "doc_id", "text", "source"))
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return u.withColumn("nth", nth).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + (F.col("nth") <= F.col("again")).cast("long"))).alias("taken"))
