"""Reading and writing catalog tables, listings and restored images."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.functions.paths import apply_filter, glob_match
from palimpsest.schema import Catalog

#: Spark's setting by which a finished query deletes its shuffle files.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folder of each materialised frame.
WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Where the session names none, a local one of our own, on one machine only."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        known = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def new_folder(spark: SparkSession, kind: str = "palimpsest") -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, columnar and compressed.

    Once it is written, nothing reads the query's shuffle files: they go at once and not when the driver collects garbage."""
    path, conf = new_folder(df.sparkSession), df.sparkSession.conf
    before = conf.get(CLEAN_UP)
    conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEAN_UP, before)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    WRITTEN[back] = path
    return back


def release(*made: DataFrame) -> None:
    """Delete what ``materialize`` wrote for frames that no later step reads."""
    for df in made:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop(df))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, time of change) of a table's files, in order."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files, out = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def scan_listing(spark: SparkSession, root: str, pattern: str | None = None, elements: list[tuple[str, str]] | None = None) -> DataFrame:
    """(path, size, mtime) of all files below a folder, paths relative to it. No content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    plain = F.regexp_replace("path", "^[a-zA-Z]+:/*", "/")
    base = root.split(":", 1)[-1].strip("/")
    rel = F.expr("substring(p, locate(b, p) + length(b) + 1)")
    rows = found.withColumn("p", plain).withColumn("b", F.lit(base)).select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"))
    rows = glob_match(rows, pattern) if pattern else rows
    return apply_filter(rows, elements) if elements else rows


def load_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """The named tables of a folder with their fixed schemas."""
    return {name: spark.read.schema(schema.TABLES[name]).parquet(f"{folder}/{name}") for name in names}


def load_catalog(spark: SparkSession, folder: str) -> Catalog:
    """Open the tables of a folder with their fixed schemas."""
    return Catalog(**load_tables(spark, folder, schema.TABLES))


def save_catalog(c: Catalog, folder: str, names: Iterable[str] = tuple(schema.TABLES)) -> None:
    """Write all tables, or the named ones, as a new snapshot folder."""
    for name in names:
        columns = [x.split()[0] for x in schema.TABLES[name].split(", ")]
        getattr(c, name).select(*columns).write.parquet(f"{folder}/{name}")


def read_images(versions: DataFrame, images: DataFrame) -> DataFrame:
    """Stored images of the given versions, only where there is one."""
    return versions.where("has_image").select("file_id", "version_id").join(images, ["file_id", "version_id"])


def write_restored(images: DataFrame, dest: str) -> DataFrame:
    """Write (path, modified, content) to a new place; an existing one is refused. Returns what is there then."""
    images.select("path", "modified", "content").write.mode("errorifexists").parquet(dest)
    return images.sparkSession.read.parquet(dest)
