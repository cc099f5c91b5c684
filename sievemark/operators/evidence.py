"""Closures and text evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.text import anchor, escape_data, escape_property


def entity_closure(static: DataFrame, runtime: DataFrame, key: str) -> DataFrame:
    """(key, state): duplicate on either side, static-only, runtime-only or matched."""
    a = static.groupBy(key).agg(F.count("*").alias("s"))
    b = runtime.groupBy(key).agg(F.count("*").alias("r"))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when((F.coalesce("s", F.lit(0)) > 1) | (F.coalesce("r", F.lit(0)) > 1), "duplicate").when(F.col("r").isNull(), "static-only").when(F.col("s").isNull(), "runtime-only").otherwise("matched").alias("state"))


def coverage(cases: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(key, issue): unknown references of the cases, and entities that no case covers."""
    loose = cases.join(entities, key, "left_anti").select(key, F.lit("unknown-reference").alias("issue")).distinct()
    bare = entities.join(cases, key, "left_anti").select(key, F.lit("uncovered").alias("issue")).distinct()
    return loose.union(bare)


def reconciled(topics: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(ordinal, key, issue) of declared topics without a file, in declared order, and of files without a topic, which come last."""
    both = topics.select(key, "ordinal").join(files.select(key).distinct().withColumn("__file", F.lit(True)), key, "full_outer")
    issue = F.when(F.col("ordinal").isNull(), "unknown-topic").when(F.col("__file").isNull(), "missing-file")
    return both.select("ordinal", key, issue.alias("issue")).filter("issue is not null").orderBy(F.col("ordinal").asc_nulls_last(), key)


def pattern_counts(rows: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """(pattern, matches) for each declared pattern, 0 included, in one pass over the rows."""
    counts = F.array(*[F.struct(F.lit(n).alias("pattern"), F.count_if(F.col(column).rlike(p)).alias("matches")) for n, p in sorted(patterns.items())])
    return rows.agg(counts.alias("c")).select(F.explode("c").alias("c")).select("c.*") if patterns else rows.select(F.lit("").alias("pattern"), F.lit(0).cast("long").alias("matches")).filter("false")


def report_groups(rows: DataFrame, key: str) -> DataFrame:
    """Of rows (key, start, end, ok, severity, error): a group's span, whether all are ok, the greatest severity and the first error by start."""
    return rows.groupBy(key).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_and("ok").alias("ok"), F.max("severity").alias("severity"), F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("start", "error"))).alias("first_error"))


def heading_anchors(headings: DataFrame) -> DataFrame:
    """Adds anchor to (doc, pos, heading); the n-th repeat in a document gets the suffix ``-n``, the first none."""
    a = headings.withColumn("anchor", anchor(F.col("heading")))
    nth = F.row_number().over(Window.partitionBy("doc", "anchor").orderBy("pos")) - 1
    return a.withColumn("nth", nth.cast("long")).withColumn("anchor", F.concat("anchor", F.when(F.col("nth") > 0, F.concat(F.lit("-"), F.col("nth").cast("string"))).otherwise(""))).drop("nth")


def page(rows: DataFrame, order: list[str], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of 1 to 100 rows with the total in each row."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset 0 or more")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(total)  # one row


def top(rows: DataFrame, section: str, order: list, n: int = 20) -> DataFrame:
    """The first n rows of each section, with rank. Ranks come from a bounded heap per partition (WindowGroupLimit)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(section).orderBy(*order)).cast("long")).filter(F.col("rank") <= n)


def annotations(records: DataFrame, n: int = 5) -> DataFrame:
    """CI lines of the first n records, by id, that aren't only informative. Of path, line and record_type_id those that are there."""
    rows = records.filter("level <> 'info'").orderBy("record_id").limit(n)
    given = [(k, F.col(c).cast("string")) for k, c in (("file", "path"), ("line", "line"), ("title", "record_type_id"))]
    attributes = F.concat_ws(",", *[F.when(v != "", F.concat(F.lit(k + "="), escape_property(v))) for k, v in given])
    return rows.select("record_id", F.concat(F.lit("::warning "), attributes, F.lit("::"), escape_data(F.col("message"))).alias("line"))


def headings(documents: DataFrame) -> DataFrame:
    """(doc, pos, heading) of the ATX headings of Markdown documents (doc, content), outside of front matter and of fenced code.

    Front matter begins with a first line ``---`` and ends with ``---`` or ``...``, at the document's end if nowhere. A fence of three
    or more backticks or tildes ends with as many or more of the same and nothing else. A line ends at LF or CR LF alone. Null content has no headings.
    """
    lines = F.split(F.regexp_replace("content", "^\ufeff", ""), "\r?\n")
    closing = F.array_position(F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda s: F.trim(s).isin("---", "...")), True)
    front = F.when(F.trim(F.get(lines, F.lit(0))) == "---", F.when(closing > 0, closing + 1).otherwise(F.size(lines))).otherwise(0)
    start = F.struct(F.lit("").alias("fence"), F.lit(0).alias("pos"), F.array().cast("array<struct<pos: int, heading: string>>").alias("found"))

    def step(state, line):
        opening = F.regexp_extract(line, "^ {0,3}(`{3,}|~{3,})", 1)
        closes = F.regexp_extract(line, "^ {0,3}(`+|~+)[ \t]*$", 1)
        ends = closes.startswith(F.substring(state["fence"], 1, 1)) & (closes != "") & (F.length(closes) >= F.length(state["fence"]))
        inside, text = state["fence"] != "", F.regexp_extract(line, "(?s)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*\\z", 1)
        fence = F.when(inside & ends, "").when(inside, state["fence"]).otherwise(opening)
        is_heading = ~inside & (opening == "") & (text != "")
        found = F.when(is_heading, F.concat(state["found"], F.array(F.struct(state["pos"].alias("pos"), text.alias("heading"))))).otherwise(state["found"])
        return F.struct(fence.alias("fence"), (state["pos"] + 1).alias("pos"), found.alias("found"))

    body = F.slice(lines, front.cast("int") + 1, F.greatest(F.size(lines) - front.cast("int"), F.lit(0)))
    got = documents.filter("content is not null").select("doc", F.explode(F.aggregate(body, start, step)["found"]).alias("h"))
    return got.select("doc", F.col("h.pos").cast("long").alias("pos"), "h.heading")
