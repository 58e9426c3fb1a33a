"""Path splitting, globs and named filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_path(path: Column | str) -> Column:
    """Elements of a path. ``/`` and ``\\`` separate; one leading separator is dropped, a trailing one adds no element."""
    path = F.col(path) if isinstance(path, str) else path
    return F.split(F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^/", ""), "/$", ""), "/", -1)


def prefixes(path: Column | str, proper: bool = False) -> Column:
    """The paths of the directories above a path, from the top; the path itself comes last unless ``proper``."""
    parts = F.split(path, "/", -1)
    last = F.size(parts) - (1 if proper else 0)
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def glob_regex(pattern: str, case_sensitive: bool = True) -> str:
    """Regular expression for ``path || '/'``.

    ``?`` is one character and ``*`` any run of them within an element, ``**`` any number of whole elements, none
    included; nothing else is special."""
    elements = re.sub("/$", "", re.sub("^/", "", pattern.replace("\\", "/"))).split("/")
    out = []
    for e in elements:
        if e == "**":
            out.append("(?:[^/]*/)*")
        else:
            out.append("".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in e) + "/")
    return ("" if case_sensitive else "(?i)") + "^" + "".join(out) + "$"


def glob_prefix(pattern: str) -> str:
    """The literal elements that a pattern begins with; a matching path starts with them."""
    elements = re.sub("^/", "", pattern.replace("\\", "/")).split("/")
    fixed = []
    for e in elements:
        if "*" in e or "?" in e:
            break
        fixed.append(e)
    return "/".join(x for x in fixed if x) if all(fixed) else ""


def matches(path: Column | str, pattern: str, case_sensitive: bool = True) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    test = F.concat(path, F.lit("/")).rlike(glob_regex(pattern, case_sensitive))
    prefix = glob_prefix(pattern) if case_sensitive else ""
    return path.startswith(prefix) & test if prefix else test  # startswith reaches the parquet scan


def glob_match(df: DataFrame, pattern: str, case_sensitive: bool = True, path_col: str = "path") -> DataFrame:
    return df.where(matches(path_col, pattern, case_sensitive))


def passes(path: Column | str, elements: list[tuple[str, str]], invert: bool = False) -> Column:
    """(type, pattern) elements: any include, or no include at all, and no exclude; the whole negated when inverted."""
    test = F.lit(True)
    for kind, negate in (("INCLUDE", False), ("EXCLUDE", True)):
        some = [matches(path, p) for t, p in elements if t == kind]
        if some:
            any_of = some[0]
            for c in some[1:]:
                any_of = any_of | c
            test = test & (~any_of if negate else any_of)
    return ~test if invert else test


def apply_filter(df: DataFrame, elements: list[tuple[str, str]], invert: bool = False, path_col: str = "path") -> DataFrame:
    """An empty filter passes everything."""
    return df.where(passes(path_col, elements, invert))


def glob_regex_of(pattern: Column | str) -> Column:
    """``glob_regex`` of a column of patterns."""
    literal = lambda e: F.regexp_replace(e, r"([\p{Punct}&&[^*?]])", r"\\$1")
    one = lambda e: F.concat(F.replace(F.replace(literal(e), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("/"))
    parts = F.transform(split_path(pattern), lambda e: F.when(e == "**", F.lit("(?:[^/]*/)*")).otherwise(one(e)))
    return F.concat(F.lit("^"), F.array_join(parts, ""), F.lit("$"))


def filter_rules(filter_elements: DataFrame) -> DataFrame:
    """(filter_id, include, exclude): the regular expressions of each filter, joined; null where there are none."""
    regex = filter_elements.select("filter_id", "type", glob_regex_of("pattern").alias("regex"))
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.col("regex"))))
    rules = regex.groupBy("filter_id").agg(of("INCLUDE").alias("i"), of("EXCLUDE").alias("e"))
    return rules.select("filter_id", *[F.when(F.size(c) > 0, F.array_join(c, "|")).alias(n) for c, n in (("i", "include"), ("e", "exclude"))])


def passes_rules(path: Column | str, include: str = "include", exclude: str = "exclude") -> Column:
    """The same test with a row's own regular expressions, for a different filter in each row."""
    at = F.concat(F.col(path) if isinstance(path, str) else path, F.lit("/"))
    return F.coalesce(F.rlike(at, F.col(include)), F.lit(True)) & ~F.coalesce(F.rlike(at, F.col(exclude)), F.lit(False))


def effective_filter(replicas: DataFrame, filters: DataFrame, spec: str | None = None) -> DataFrame:
    """(replica_id, filter_id, name): the filter asked for by name, else the replica's default, else ``default``, else ``all``."""
    named = filters.select("filter_id", F.lower("name").alias("name"))
    if spec is not None:
        named = named.where(F.col("name") == spec.lower())
        return replicas.select("replica_id").join(F.broadcast(named.limit(1)), how="left").select("replica_id", "filter_id", "name")
    common = named.where(F.col("name").isin("default", "all")).orderBy(F.col("name") == "all").limit(1).select(F.col("filter_id").alias("__id"), F.col("name").alias("__name"))
    own = replicas.select("replica_id", F.col("default_filter_id").alias("filter_id")).join(named, "filter_id", "left")
    return own.join(F.broadcast(common), how="left").select("replica_id", F.coalesce("filter_id", "__id").alias("filter_id"), F.coalesce("name", "__name").alias("name"))
