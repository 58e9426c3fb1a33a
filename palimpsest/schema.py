"""Catalog tables. A version without a size is a deletion mark; a file exists while its current version is none."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = "file_id bigint, path string, current_version_id int"
VERSIONS = (
    "file_id bigint, version_id int, path string, size bigint, digest binary, modified timestamp_ntz, base_version_id int, "
    "has_image boolean, cdelta_len bigint, fdelta_len bigint, rdelta_len bigint"
)
IMAGES = "file_id bigint, version_id int, content string"
FRAGMENTS = "file_id bigint, version_id int, kind string, rev_off bigint, fwd_off bigint, len bigint, data string"
LAST_SYNC = "file_id bigint, replica_id int, version_id int, size bigint, digest binary, modified timestamp_ntz, path string"
REPLICAS = "replica_id int, host string, user string, root string, default_filter_id int"
REPLICA_DEFAULTS = "host string, user string, replica_id int"
FILTERS = "filter_id int, name string"
FILTER_ELEMENTS = "filter_id int, type string, number int, pattern string"
OP_LOG = "entry bigint, replica_id int, filter_id int, filter_inverted boolean, started timestamp_ntz, operation string, status string"
OP_LOG_PARAMS = "entry bigint, name string, value string"
LISTING = "replica_id int, path string, size bigint, mtime timestamp_ntz"

TABLES = {
    "files": FILES,
    "versions": VERSIONS,
    "last_sync": LAST_SYNC,
    "replicas": REPLICAS,
    "replica_defaults": REPLICA_DEFAULTS,
    "filters": FILTERS,
    "filter_elements": FILTER_ELEMENTS,
    "op_log": OP_LOG,
    "op_log_params": OP_LOG_PARAMS,
    "listing": LISTING,
}


@dataclass
class Catalog:
    """One DataFrame for each table; operators read the ones they need and never change them."""

    files: DataFrame
    versions: DataFrame
    last_sync: DataFrame | None = None
    replicas: DataFrame | None = None
    replica_defaults: DataFrame | None = None
    filters: DataFrame | None = None
    filter_elements: DataFrame | None = None
    op_log: DataFrame | None = None
    op_log_params: DataFrame | None = None
    listing: DataFrame | None = None

    @cached_property
    def current(self) -> DataFrame:
        """Each file with its current version; ``is_broken`` where that is missing."""
        v = self.versions.select("file_id", F.col("version_id").alias("current_version_id"), "size", "modified", "has_image", F.lit(True).alias("__there"))
        joined = self.files.hint("merge").join(v, ["file_id", "current_version_id"], "left")
        return joined.select("file_id", "path", "current_version_id", "size", "modified", "has_image", F.col("__there").isNull().alias("is_broken"))

    @cached_property
    def existing(self) -> DataFrame:
        """(file_id, path, current_version_id, size, modified) of files whose current version is no deletion mark."""
        return self.current.where("NOT is_broken AND size IS NOT NULL").select("file_id", "path", "current_version_id", "size", "modified")
