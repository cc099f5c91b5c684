"""Decoders of text formats (S10, S13-S19, V1, J2, B3): bad rows are never dropped one by one; a batch is whole or void."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_HEADER = ("Language", "Provider", "Filename", "Lines", "Code", "Comments", "Blanks", "Complexity", "Bytes", "ULOC")
_DIGITS = r"^\d{1,15}$"


def cells(line: Column) -> Column:
    """Trimmed cells of a CSV line with quotes; a doubled quote stands for one."""
    raw = F.regexp_extract_all(line, F.lit(r'(?:^|,)\s*("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(raw, lambda c: F.when(F.trim(c).startswith('"'), F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(F.trim(c)))


def csv_rows(text: DataFrame) -> DataFrame:
    """(doc, pos, cells) of (doc, content): byte-order mark stripped, blank lines skipped, ragged rows kept."""
    lines = text.select("doc", F.posexplode(F.split(F.regexp_replace("content", "^﻿", ""), "\r?\n")).alias("pos", "line"))
    return lines.filter(F.trim("line") != "").select("doc", "pos", cells(F.col("line")).alias("cells"))


def file_metrics(text: DataFrame) -> DataFrame:
    """(doc, path, language, lines, code_lines, comment_lines, blank_lines, decision_tokens) of by-file CSV.

    Rows count from the exact ten-column header on. Counts are digits only; an empty complexity is null; the provider's path is
    preferred. One bad row, or no header, voids the whole of its ``doc``.
    """
    rows = csv_rows(text)
    head = rows.filter(F.col("cells") == F.array(*map(F.lit, FILE_HEADER))).groupBy("doc").agg(F.min("pos").alias("head"))
    rows = rows.join(head, "doc").filter("pos > head")
    at = lambda i: F.get("cells", i)
    count = lambda i: F.when(at(i).rlike(_DIGITS), F.expr(f"try_cast(get(cells, {i}) as bigint)"))
    path = F.when(at(1) != "", at(1)).otherwise(at(2))
    ok = (F.size("cells") == len(FILE_HEADER)) & (at(2) != "") & ((at(7) == "") | at(7).rlike(_DIGITS))
    for i in (3, 4, 5, 6):
        ok = ok & at(i).rlike(_DIGITS)
    out = rows.select("doc", path.alias("path"), at(0).alias("language"), *[count(i).alias(n) for i, n in ((3, "lines"), (4, "code_lines"), (5, "comment_lines"), (6, "blank_lines"), (7, "decision_tokens"))], F.coalesce(ok, F.lit(False)).alias("ok"))
    return whole(out, F.col("ok")).drop("ok")


def function_metrics(text: DataFrame) -> DataFrame:
    """(doc, file, name, start_line, end_line, lines, ccn, params) of positional CSV: eleven columns or more, header optional, empty name is ``unknown``."""
    rows = csv_rows(text)
    at = lambda i: F.get("cells", i)
    rows = rows.filter(F.coalesce(F.lower(at(0)) != "nloc", F.lit(True)))
    count = lambda i: F.when(at(i).rlike(_DIGITS), F.expr(f"try_cast(get(cells, {i}) as bigint)"))
    ok = (F.size("cells") >= 11) & at(0).rlike(_DIGITS) & ((at(1) == "") | at(1).rlike(_DIGITS)) & at(3).rlike(_DIGITS) & (at(6) != "") & (count(9) >= 1) & (count(10) >= count(9))
    out = rows.select("doc", at(6).alias("file"), F.when(at(7) == "", "unknown").otherwise(at(7)).alias("name"), count(9).alias("start_line"), count(10).alias("end_line"), count(0).alias("lines"), count(1).alias("ccn"), count(3).alias("params"), F.coalesce(ok, F.lit(False)).alias("ok"))
    return whole(out, F.col("ok")).drop("ok")


def whole(rows: DataFrame, ok: Column, by: str = "doc") -> DataFrame:
    """The rows of those documents of which every row is sound."""
    sound = rows.groupBy(by).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("__ok")).filter("__ok")
    return rows.join(sound.select(by), by, "left_semi")


_LOC = "struct<name: string, start: double, end: double, startLoc: struct<line: double>, endLoc: struct<line: double>>"
FRAGMENTS = f"struct<duplicates: array<struct<lines: double, tokens: double, firstFile: {_LOC}, secondFile: {_LOC}>>>"


def fragments(text: DataFrame) -> DataFrame:
    """(doc, ordinal, line_count, token_count, locations) of duplicate JSON: numbers truncated toward zero; a location's own line is preferred."""
    rows = text.select("doc", F.from_json("content", FRAGMENTS).alias("j")).select("doc", F.posexplode("j.duplicates").alias("ordinal", "d"))

    def place(side: str) -> Column:
        start = F.coalesce(F.col(f"d.{side}.startLoc.line"), F.col(f"d.{side}.start")).cast("long")
        end = F.coalesce(F.col(f"d.{side}.endLoc.line"), F.col(f"d.{side}.end")).cast("long")
        return F.struct(F.col(f"d.{side}.name").alias("path"), start.alias("start_line"), F.when(end == 0, start).otherwise(end).alias("end_line"))

    return rows.select("doc", F.col("ordinal").cast("long").alias("ordinal"), F.col("d.lines").cast("long").alias("line_count"), F.col("d.tokens").cast("long").alias("token_count"), F.array(place("firstFile"), place("secondFile")).alias("locations"))


def ndjson(text: DataFrame, schema: str) -> DataFrame:
    """(doc, pos, value, problem): good rows decoded, bad ones kept with a diagnostic; blank lines skipped."""
    lines = text.select("doc", F.posexplode(F.split("content", "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    sound = F.expr("try_parse_json(line) is not null")
    return lines.select("doc", F.col("pos").cast("long").alias("pos"), F.when(sound, F.from_json("line", schema)).alias("value"), F.when(~sound, F.concat(F.lit("line "), F.col("pos") + 1, F.lit(" is not JSON"))).alias("problem"))


def json_document(text: DataFrame) -> DataFrame:
    """(doc, state): missing, empty, malformed or ok."""
    return text.select("doc", F.when(F.col("content").isNull(), "missing").when(F.trim("content") == "", "empty").when(F.expr("try_parse_json(content) is null"), "malformed").otherwise("ok").alias("state"))


def status_lines(text: DataFrame) -> DataFrame:
    """Paths of short status lines ``XY path`` or ``XY old -> new``: the new name counts."""
    lines = text.select(F.explode(F.split("content", "\n")).alias("line")).filter(F.length("line") > 3)
    return lines.select(F.element_at(F.split(F.substring("line", 4, 1 << 30), " -> "), -1).alias("path"))


def gitlinks(text: DataFrame) -> DataFrame:
    """(path, sha) of tree listing lines ``mode type sha TAB path``: nested repositories only."""
    lines = text.select(F.explode(F.split("content", "[\n\u0000]")).alias("line"))
    part = lambda i: F.regexp_extract("line", "^(\\d{6}) (\\w+) ([0-9a-f]{40,64})\t(.+)$", i)
    return lines.filter((part(1) == "160000") & (part(2) == "commit")).select(part(4).alias("path"), part(3).alias("sha"))


def walk(spark: SparkSession, root: str, skip: list[str]) -> DataFrame:
    """(path, bytes) below a folder; an unreadable one is an error. Content isn't read."""
    from sievemark.functions.text import relative

    at = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = relative(F.regexp_replace("path", "^file:/+", "/"), root)
    return at.select(path.alias("path"), F.col("length").alias("bytes")).filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip)).cast("array<string>"))).distinct()


def junit_cases(text: DataFrame) -> DataFrame:
    """(doc, name, seconds) of test cases in JUnit XML."""
    tag = F.explode(F.regexp_extract_all("content", F.lit("<testcase\\b([^>]*)>"), F.lit(1)))
    return text.select("doc", tag.alias("a")).select("doc", F.regexp_extract("a", '\\bname="([^"]*)"', 1).alias("name"), F.expr("try_cast(regexp_extract(a, '\\\\btime=\"([^\"]*)\"', 1) as double)").alias("seconds"))
