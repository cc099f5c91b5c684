"""Scope, areas, changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions import globs
from sievemark.functions.canonical import ordered_digest

#: A changed list of at most so many rows is broadcast and compared with every path; beyond, paths meet by an equi-join on their substrings.
FEW = 32
#: Paths that an area's payload lists, the feature's own limit.
LISTED = 200


@dataclass(frozen=True)
class Area:
    name: str
    globs: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    policy: str = "moderate"


def excluded(path: Column, dirs: list[str], generated: list[str]) -> Column:
    """Any segment is an excluded folder, or a generated glob hits."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, dirs)).cast("array<string>")) | globs.matches(path, generated)


def in_scope(path: Column, include: list[str], dirs: list[str], generated: list[str]) -> Column:
    return globs.matches(path, include) & ~excluded(path, dirs, generated)


def area_of(path: Column, areas: list[Area], generated: list[str]) -> Column:
    """The first area in declared order that takes the path; generated comes first, ``unknown`` last."""
    found = F.when(globs.matches(path, generated), "generated")
    for a in areas:
        found = found.when(globs.matches(path, list(a.globs)) & ~globs.matches(path, list(a.exclude)), a.name)
    return found.otherwise("unknown")


def policy_of(area: Column, areas: list[Area]) -> Column:
    out = F.when(F.lit(False), "")
    for a in areas:
        out = out.when(area == a.name, a.policy)
    return out


def _holding(rows: DataFrame, column: str, parts: DataFrame, part: str) -> DataFrame:
    """(column, part): the distinct texts of ``column`` with every substring that may be one of ``parts``.

    A substring may if its first character and its length occur together in ``parts``, so most places of a text give none, and
    rows grow with the texts, not with the pairs.
    """
    first = lambda t: F.substring(t, 1, 1)
    lengths = parts.groupBy(first(part).alias("k")).agg(F.collect_set(F.length(part)).alias("n"))
    known = lengths.agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("__known"))  # one row: a list of lengths for each first character
    text = F.col(column)
    starts = F.sequence(F.lit(1), F.length(text))
    at = lambda s: F.filter(F.try_element_at("__known", text.substr(s, F.lit(1))), lambda n: n <= F.length(text) - s + 1)
    pieces = F.transform(starts, lambda s: F.coalesce(F.transform(at(s), lambda n: text.substr(s, n)), F.array().cast("array<string>")))
    return rows.crossJoin(F.broadcast(known)).select(column, F.explode(F.array_distinct(F.flatten(pieces))).alias(part))


def touched(rows: DataFrame, changed: DataFrame, path: str = "path", few: int = FEW) -> DataFrame:
    """The distinct paths of ``rows`` that contain a changed path or are contained in one. Nulls and empty changed paths don't count."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own, as paths are few bytes and much work
    paths = rows.select(F.col(path).alias("p")).filter("p <> ''").repartition(n, "p").distinct()
    c = changed.toDF("c").filter("c <> ''").repartition(n, "c").distinct()
    if len(c.limit(few + 1).collect()) <= few:  # only the list's size decides; it is read no further than few + 1 rows
        return paths.join(F.broadcast(c), F.col("p").contains(F.col("c")) | F.col("c").contains(F.col("p")), "left_semi")
    holds = _holding(paths, "p", c, "c").join(c, "c", "left_semi").select("p")
    held = _holding(c, "c", paths, "p").select("p").join(paths, "p", "left_semi").select("p")
    return holds.union(held).distinct()


def hit_fragments(fragments: DataFrame, changed: DataFrame, key: str = "fragment_id", locations: str = "locations") -> DataFrame:
    """(key, hits): whether any location of a fragment lies in the changed scope."""
    places = fragments.select(key, F.explode(locations).alias("l")).select(key, F.col("l.path").alias("path"))
    hit = touched(places, changed).withColumnRenamed("p", "path")
    return places.join(hit.withColumn("hit", F.lit(True)), "path", "left").groupBy(key).agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hits"))


def area_fingerprints(files: DataFrame) -> DataFrame:
    """(area, file_count, file_list, fingerprint) of columns area, path, content_hash: digest over ``path NUL hash LF`` in path
    order, then the count; the list holds the first LISTED paths."""
    rows = files.withColumn("line", F.concat("path", F.lit("\u0000"), "content_hash", F.lit("\n")))
    digests = ordered_digest(rows, "line", ["path"], ["area"]).select("area", F.col("n").alias("file_count"), F.concat(F.lit("sha256:"), "digest", F.lit(":"), "n").alias("fingerprint"))
    first = files.select("area", "path", F.row_number().over(Window.partitionBy("area").orderBy("path")).alias("nth")).filter(F.col("nth") <= LISTED)
    lists = first.groupBy("area").agg(F.array_sort(F.collect_list("path")).alias("file_list"))
    return digests.join(lists, "area").select("area", "file_count", "file_list", "fingerprint")


def revision_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status): added, removed or modified, of two (path, hash) tables."""
    both = before.select("path", F.col("hash").alias("a")).join(after.select("path", F.col("hash").alias("b")), "path", "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return both.select("path", status.alias("status")).filter("status is not null")


def edited(parent: Column, add: Column, remove: Column, exact: Column | None = None) -> Column:
    """An inherited collection: exact replaces; else (parent - remove) + add, sorted and unique."""
    new = F.array_sort(F.array_union(F.array_except(parent, remove), add))
    return new if exact is None else F.when(exact.isNotNull(), F.array_sort(F.array_distinct(exact))).otherwise(new)


def all_or_nothing(rows: DataFrame, valid: Column) -> DataFrame:
    """The rows if every one is valid, else none (V1): one aggregate row gates the batch."""
    gate = rows.agg(F.coalesce(F.bool_and(F.coalesce(valid, F.lit(False))), F.lit(True)).alias("__gate"))
    return rows.join(F.broadcast(gate), F.col("__gate"), "inner").drop("__gate")  # one row


def accepted_batch(rows: DataFrame, approved: DataFrame, path: str = "path") -> DataFrame:
    """The rows if every one's path is approved, else none."""
    marked = rows.join(approved.select(F.col(path)).distinct().withColumn("__ok", F.lit(True)), path, "left")
    return all_or_nothing(marked, F.col("__ok")).drop("__ok")
