"""Catalog tables derived from event, order, line item and document tables, by the rules in FIXTURES.md."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.functions.sizes import EMPTY_DELTA, dummy_common_size
from palimpsest.schema import Catalog
from palimpsest.sources.tables import file_states, load_tables, materialize, new_folder, save_catalog

REPLICA_ROWS = [(1, "h1", "ann", "/r1", None), (2, "h1", "ann", "/r2", 2), (3, "h2", "bob", "/r3", 3)]
DEFAULT_ROWS = [("h1", "ann", 2)]
FILTER_ROWS = [(1, "all"), (2, "office"), (3, "no temp files"), (4, "default")]
ELEMENT_ROWS = [(2, "INCLUDE", 1, "**/*.doc"), (2, "INCLUDE", 2, "**/*.ods"), (2, "EXCLUDE", 1, "g0/**"), (3, "EXCLUDE", 1, "**/*.tmp"), (4, "INCLUDE", 1, "g?/u1*/**")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a source table's files for each partition that its rows are dealt to, 100,000 to 250,000 events.
PARTITION_BYTES = 2 << 20


def dealt(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> Callable[[DataFrame], DataFrame]:
    """Deals rows of a source table by keys to partitions in number with the table; a small one is left to the session's settings."""
    n = -(-sum(size for _, size, _ in file_states(spark, f"{sf_dir}/{name}.parquet")) // PARTITION_BYTES)
    return lambda df: df.repartition(n, *keys) if n > spark.sparkContext.defaultParallelism else df


def versions_with_paths(events: DataFrame, deal: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The version table with the file's path beside it. ``deal``: spreads the rows by path."""
    user, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("int")
    ext = F.element_at(F.array(*map(F.lit, (".txt", ".doc", ".ods", ".tmp"))), (user % 4 + 1).cast("int"))
    path = F.concat(F.lit("g"), (user % 10).cast("string"), F.lit("/u"), user.cast("string"), F.lit("/d"), (k % 5).cast("string"), ext)
    order = Window.partitionBy("path").orderBy("ts", "event_id")
    e = events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value", path.alias("path"))
    e = deal(e).withColumn("before", F.lag("event_type").over(order)).withColumn("mark", F.col("event_type") == "error")
    kept = e.where("NOT mark OR (before IS NOT NULL AND before <> 'error')")
    kept = kept.withColumn("life", F.coalesce(F.sum(F.col("mark").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    life = Window.partitionBy("path", "life")
    v = kept.withColumn("file_id", F.min("event_id").over(life)).withColumn("version_id", F.row_number().over(life.orderBy("ts", "event_id")))
    v = v.withColumn("undo", (F.col("event_type") == "signup") & (F.col("version_id") > 1)).withColumn("own", F.round(F.col("value") * 100).cast("long"))
    v = v.withColumn("size", F.when(~F.col("mark"), F.when(F.col("undo"), F.first("own").over(life.orderBy("ts", "event_id"))).otherwise(F.col("own"))))
    plain = (F.col("version_id") > 1) & ~F.col("mark")
    return v.select(
        "file_id", "version_id", F.lit(None).cast("string").alias("path"), "size", F.lit(None).cast("binary").alias("digest"), F.col("ts").alias("modified"),
        F.when(F.col("version_id") > 1, F.when(F.col("undo"), 1).otherwise(F.col("version_id") - 1)).cast("int").alias("base_version_id"),
        ((F.col("version_id") == 1) | ((F.col("event_id") % 5 == 0) & ~F.col("mark") & ~F.col("undo"))).alias("has_image"),
        F.when(plain, F.when(F.col("undo"), dummy_common_size(F.col("size"))).otherwise(10)).cast("long").alias("cdelta_len"),
        F.when(plain, F.when(F.col("undo"), EMPTY_DELTA).otherwise(7 + F.col("size") % 50)).cast("long").alias("fdelta_len"),
        F.when(plain, F.when(F.col("undo"), EMPTY_DELTA).otherwise(7 + F.col("size") % 30)).cast("long").alias("rdelta_len"),
        F.col("path").alias("file_path"),
    )


def last_sync(files: DataFrame, versions: DataFrame) -> DataFrame:
    rows = files.withColumn("replica_id", F.explode(F.array(*[F.lit(r[0]) for r in REPLICA_ROWS]))).where(F.pmod(F.col("file_id") * 7 + F.col("replica_id"), F.lit(5)) != 0)
    rows = rows.withColumn("version_id", F.greatest(F.lit(1), F.col("current_version_id") - F.pmod(F.col("file_id") + F.col("replica_id"), F.lit(3))).cast("int"))
    rows = rows.hint("merge").join(versions.select("file_id", "version_id", "size", "modified"), ["file_id", "version_id"])
    cut = F.pmod(F.col("file_id") + F.col("replica_id"), F.lit(11)) == 0
    return rows.select(
        "file_id", "replica_id", F.when(~cut, F.col("version_id")).alias("version_id"), F.when(cut, F.col("size")).alias("size"), F.lit(None).cast("binary").alias("digest"),
        F.when(cut, F.col("modified")).alias("modified"), F.lit(None).cast("string").alias("path"), F.col("version_id").alias("synced"),
    )


def listing(spark: SparkSession, files: DataFrame, versions: DataFrame, synced: DataFrame) -> DataFrame:
    at = versions.select("file_id", "version_id", "size", "modified")
    cur = files.hint("merge").join(at.withColumnRenamed("version_id", "current_version_id"), ["file_id", "current_version_id"])
    existing = cur.where("size IS NOT NULL")
    hour, two = F.expr("INTERVAL '1' HOUR"), F.expr("INTERVAL '2' SECOND")
    own = at.select("file_id", F.col("version_id").alias("synced"), F.col("size").alias("vs"), F.col("modified").alias("vm"))
    case = F.pmod(F.col("file_id") * 3 + F.col("replica_id"), F.lit(6))
    rows = synced.select("file_id", "replica_id", "synced").hint("merge").join(existing, "file_id").hint("merge").join(own, ["file_id", "synced"]).withColumn("c", case).where("c <> 0")
    size = F.when(F.col("c") == 1, F.col("size") + 1).when(F.col("c") == 2, F.col("vs")).when(F.col("c") == 4, F.col("size") + 7).otherwise(F.col("size"))
    time = F.when(F.col("c") == 1, F.col("modified") + hour).when(F.col("c") == 2, F.col("vm")).when(F.col("c") == 3, F.col("modified") + two).when(F.col("c") == 4, F.col("modified") - hour).otherwise(F.col("modified"))
    main = rows.select("replica_id", "path", size.alias("size"), time.alias("mtime"))
    gone = files.hint("merge").join(existing.select("path"), "path", "left_anti")
    newest = gone.groupBy("path").agg(F.max(F.struct("file_id", "current_version_id")).alias("f")).select("path", "f.file_id", F.greatest(F.lit(1), F.col("f.current_version_id") - 1).alias("version_id"))
    dead = synced.select("file_id", "replica_id").hint("merge").join(newest, "file_id").hint("merge").join(at, ["file_id", "version_id"]).select("replica_id", "path", "size", F.col("modified").alias("mtime"))
    stamp = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    fresh = spark.range(20).withColumn("replica_id", F.explode(F.array(*[F.lit(r[0]) for r in REPLICA_ROWS]))).select("replica_id", F.concat(F.lit("new/r"), F.col("replica_id").cast("string"), F.lit("/u"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), (F.col("id") * 10).alias("size"), stamp.alias("mtime"))
    under = existing.agg(F.min("path").alias("p")).where("p IS NOT NULL").select(F.lit(1).alias("replica_id"), F.concat("p", F.lit("/under.txt")).alias("path"), F.lit(1).cast("long").alias("size"), stamp.alias("mtime"))
    return main.unionByName(dead).unionByName(fresh).unionByName(under).where("size IS NOT NULL")


def op_log(orders: DataFrame, lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    status = F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "P", "failed")
    nulled = lambda c, n: F.when(c % n != 0, c % n).cast("int")
    log = orders.select(
        F.col("o_orderkey").alias("entry"), nulled(F.col("o_custkey"), 4).alias("replica_id"), nulled(F.col("o_orderkey"), 5).alias("filter_id"), (F.col("o_orderkey") % 2 == 1).alias("filter_inverted"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("started"), F.col("o_orderpriority").alias("operation"), status.alias("status"),
    )
    params = lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.concat("l_returnflag", "l_linestatus")).alias("value"))
    return log, params.select(F.col("l_orderkey").alias("entry"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("name"), "value")


def catalog(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Catalog:
    """All tables, lazily; an operator that uses two of them plans only those. ``keep`` stores what several are derived from."""
    full = keep(versions_with_paths(read(spark, sf_dir, "events"), dealt(spark, sf_dir, "events", "path")))
    versions = full.drop("file_path")
    files = keep(full.groupBy("file_id").agg(F.first("file_path").alias("path"), F.max("version_id").alias("current_version_id")))
    replicas = spark.createDataFrame(REPLICA_ROWS, schema.REPLICAS)
    synced = keep(last_sync(files, versions))
    log, params = op_log(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"))
    return Catalog(
        files, versions, synced.drop("synced"), replicas, spark.createDataFrame(DEFAULT_ROWS, schema.REPLICA_DEFAULTS), spark.createDataFrame(FILTER_ROWS, schema.FILTERS),
        spark.createDataFrame(ELEMENT_ROWS, schema.FILTER_ELEMENTS), log, params, listing(spark, files, versions, synced),
    )


#: Tables that the catalog is derived from.
SOURCES = ("events", "orders", "lineitem")
#: The log tables, derived from the last two of them; most queries use only the others.
LOGS = ("op_log", "op_log_params")
#: Folder of saved tables by application, source folder and tables, with the state that their sources had.
SAVED: dict[tuple[str, str, tuple[str, ...]], tuple[list, str]] = {}


def saved(spark: SparkSession, sf_dir: str, sources: tuple[str, ...], names: tuple[str, ...], make: Callable[[], Catalog]) -> dict[str, DataFrame]:
    """The named tables of what ``make`` derives, written once in a session; anew when a source table's files change."""
    of = (spark.sparkContext.applicationId, sf_dir, names)
    state = [file_states(spark, f"{sf_dir}/{name}.parquet") for name in sources]
    if SAVED.get(of, (None, ""))[0] != state:
        folder = new_folder(spark, "catalog")
        save_catalog(make(), folder, names)
        SAVED[of] = state, folder
    return load_tables(spark, SAVED[of][1], names)


def saved_catalog(spark: SparkSession, sf_dir: str, logs: bool = False) -> Catalog:
    """The same, written as a snapshot folder, so that no query plans the derivation again. The log tables are written only for
    queries that say that they use them; for others they stay lazy, so no query waits for a table that it does not read."""
    c = Catalog(**saved(spark, sf_dir, SOURCES[:1], tuple(name for name in schema.TABLES if name not in LOGS), lambda: catalog(spark, sf_dir, materialize)))
    lazy = dict(zip(LOGS, op_log(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")), strict=True))
    return replace(c, **(saved(spark, sf_dir, SOURCES[1:], LOGS, lambda: replace(c, **lazy)) if logs else lazy))


def many_replicas(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog with a replica for each customer and a filter for each supplier, besides ``all`` and ``default``."""
    n, f = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    key = F.col("c_custkey")
    own = F.when(key % 4 != 0, key % 10 + 1).cast("int")
    replicas = n.select((key + 1).cast("int").alias("replica_id"), F.concat(F.lit("h"), F.col("c_nationkey").cast("string")).alias("host"), F.col("c_mktsegment").alias("user"), F.concat(F.lit("/r"), key.cast("string")).alias("root"), own.alias("default_filter_id"))
    defaults = replicas.where("replica_id % 3 = 0").groupBy("host", "user").agg(F.max("replica_id").alias("replica_id"))
    filters = spark.createDataFrame([(1, "all"), (2, "default")], schema.FILTERS).unionByName(f.select((F.col("s_suppkey") + 3).cast("int").alias("filter_id"), F.col("s_name").alias("name")))
    return replace(saved_catalog(spark, sf_dir), replicas=replicas, replica_defaults=defaults, filters=filters)


def renamed(c: Catalog) -> Catalog:
    """Files with file_id % 7 = 0 and two versions or more now lie under ``moved/``; all but their last version keep the old path."""
    moved = (F.col("file_id") % 7 == 0) & (F.col("current_version_id") >= 2)
    files = c.files.select("file_id", F.when(moved, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path")).alias("path"), "current_version_id")
    old = c.files.where(moved).select("file_id", F.col("path").alias("old"), "current_version_id")
    v = c.versions.hint("merge").join(old, "file_id", "left").withColumn("path", F.when(F.col("version_id") < F.col("current_version_id"), F.col("old")))
    return Catalog(files, v.select(*c.versions.columns), c.last_sync, c.replicas, c.replica_defaults, c.filters, c.filter_elements, c.op_log, c.op_log_params, c.listing)


def edit_chain(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions, images of all three versions, fragments) of all documents, null text: empty; offsets are characters.

    The second version has a marker in the middle of the text, the third lacks the second quarter (of the first version's length)."""
    d = documents.select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("text"))
    marker = F.concat(F.lit("[edit "), F.col("file_id").cast("string"), F.lit("]"))
    d = d.withColumn("marker", marker).withColumn("n", F.char_length("text").cast("long")).withColumn("m", F.char_length("marker").cast("long"))
    d = d.withColumn("h", F.expr("n div 2").cast("int")).withColumn("q", F.expr("n div 4").cast("int"))
    second = F.concat(F.expr("substring(text, 1, h)"), "marker", F.expr("substring(text, h + 1)"))
    d = d.withColumn("second", second).withColumn("third", F.concat(F.expr("substring(second, 1, q)"), F.expr("substring(second, 2 * q + 1)")))
    image = lambda v, c: d.select("file_id", F.lit(v).alias("version_id"), F.col(c).alias("content"))
    images = image(1, "text").unionByName(image(2, "second")).unionByName(image(3, "third"))
    none = F.lit(None)

    def fragment(version: int, kind: str, rev, fwd, length, data=none):
        longs = {"rev_off": rev, "fwd_off": fwd, "len": length}
        return F.struct(F.lit(version).alias("version_id"), F.lit(kind).alias("kind"), *[(c if isinstance(c, Column) else F.lit(c)).cast("long").alias(k) for k, c in longs.items()], data.cast("string").alias("data"))

    n, m, h, q = (F.col(c) for c in "nmhq")
    rows = F.array(
        fragment(2, "COMMON", 0, 0, h), fragment(2, "COMMON", h, m + h, n - h), fragment(2, "FORWARD", None, h, m, F.col("marker")),
        fragment(3, "COMMON", 0, 0, q), fragment(3, "COMMON", 2 * q, q, n + m - 2 * q), fragment(3, "REVERSE", q, None, q, F.expr("substring(second, q + 1, q)")),
    )
    fragments = d.select("file_id", F.explode(rows).alias("f")).select("file_id", "f.*").where("len > 0")
    versions = images.select("file_id", "version_id", F.char_length("content").cast("long").alias("size"), F.when(F.col("version_id") > 1, F.col("version_id") - 1).alias("base_version_id"), (F.col("version_id") == 1).alias("has_image"))
    return versions, images, fragments
