"""The three built-in checks, C1-C4: candidates, records and comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.canonical import canonical, record_id, sha, subject
from sievemark.functions.text import level, stable_name
from sievemark.operators.scope import Area, area_of, policy_of


def regression(changed: Column, value: Column, baseline: Column, delta: int) -> Column:
    """regression or changed where the subject changed, else null. Without a baseline value it is changed."""
    return F.when(changed, F.when(value - baseline > delta, "regression").otherwise("changed"))


def file_records(files: DataFrame, areas: list[Area], floor: int = 300, allowance: int = 500, few_tokens: int = 10) -> DataFrame:
    """A record for every file above its limit; the higher limit holds for files of few decision tokens."""
    limit = F.when(F.col("decision_tokens") <= few_tokens, allowance).otherwise(floor).cast("long")
    rows = files.withColumn("code_limit", limit).withColumn("level", level(policy_of(F.col("area"), areas))).filter("level is not null and code_lines > code_limit")
    message = F.concat(F.lit("File "), "path", F.lit(" has "), "code_lines", F.lit(" code lines (threshold: "), "code_limit", F.lit(")"))
    check, kind, metric = F.lit("file-metrics"), F.lit("file-code-lines"), F.lit("code-lines")
    return rows.select(record_id(check, kind, {"metric": metric}, subject(F.col("path"))).alias("record_id"), check.alias("check_id"), kind.alias("record_type_id"), "level", F.col("path").alias("semantic_subject"), message.alias("message"), F.col("area").alias("code_area"), "code_limit", metric.alias("metric"), F.col("code_lines").alias("value"), "path", F.lit(1).cast("long").alias("line"))


def related_files(current: DataFrame, baseline: DataFrame, changed: DataFrame, delta: int) -> DataFrame:
    """Adds baseline and relation to (path, value, ...). Files missing in the baseline count 0; unchanged files have a null relation."""
    b = baseline.select("path", F.coalesce("value", F.lit(0)).cast("long").alias("baseline"))
    rows = current.join(b, "path", "left").join(changed.select(F.col("p").alias("path")).distinct().withColumn("__changed", F.lit(True)), "path", "left")
    rows = rows.withColumn("baseline", F.coalesce("baseline", F.lit(0).cast("long")))
    return rows.withColumn("relation", regression(F.col("__changed"), F.col("value"), F.col("baseline"), delta)).drop("__changed")


def file_relations(current: DataFrame, baseline: DataFrame, changed: DataFrame, delta: int) -> DataFrame:
    """(path, value, baseline, relation) of the changed files."""
    return related_files(current, baseline, changed, delta).select("path", "value", "baseline", "relation").filter("relation is not null")


def function_instances(functions: DataFrame) -> DataFrame:
    """Adds group_size, occurrence and the semantic subject. ``ordinal`` settles full ties."""
    group = Window.partitionBy("file", "name")
    nth = F.row_number().over(group.orderBy("lines", F.coalesce("ccn", F.lit(-1)), "params", "ordinal"))
    rows = functions.withColumn("group_size", F.count("*").over(group)).withColumn("nth", nth.cast("long"))
    lone = (F.col("group_size") == 1) & stable_name(F.col("name"))
    unique = F.concat(F.lit("function:"), canonical(file=F.col("file"), name=F.col("name")))
    many = F.concat(F.lit("function-instance:"), canonical(file=F.col("file"), name=F.col("name"), occurrence=F.col("nth")))
    return rows.withColumn("occurrence", F.when(~lone, F.col("nth"))).withColumn("semantic_subject", F.when(lone, unique).otherwise(many)).drop("nth")


#: metric: (record type, metric name, value column, limit, message's tail)
FUNCTION_METRICS = {
    "lines": ("function-code-lines", "function-code-density"),
    "ccn": ("function-cyclomatic-complexity", "cyclomatic-complexity"),
    "params": ("function-parameter-count", "parameter-count"),
}


SUGGESTIONS = {
    "lines": "Consider reducing branching or splitting the function when line count and complexity make it hard to review",
    "ccn": "Consider breaking this function into smaller, more focused functions",
    "params": "Consider using a parameter object or splitting the function",
}


def function_records(instances: DataFrame, areas: list[Area], generated: list[str], lines: int = 50, low_lines: int = 150, low_below: int = 5, ccn: int = 10, params: int = 5) -> DataFrame:
    """Up to three records for an instance, of the level that its area's policy gives; files of excluded and unknown areas have none.

    The higher line limit holds where the complexity is known and below ``low_below``.
    """
    low = F.coalesce(F.col("ccn") < low_below, F.lit(False))
    floor = F.when(low, low_lines).otherwise(lines)
    head = F.concat(F.lit('Function "'), "name", F.lit('" in '), "file", F.lit(":"), "start_line", F.lit(" has "))
    label = F.concat(floor.cast("string"), F.lit(" code lines"), F.when(low, F.lit(f" for CC < {low_below}")).otherwise(""))
    options = [
        ("lines", floor, F.concat(head, "lines", F.lit(" code lines at cyclomatic complexity "), F.coalesce(F.col("ccn").cast("string"), F.lit("n/a")), F.lit(" (threshold: "), label, F.lit(")"))),
        ("ccn", F.lit(ccn), F.concat(head, F.lit("cyclomatic complexity "), "ccn", F.lit(f" (threshold: {ccn} CC)"))),
        ("params", F.lit(params), F.concat(head, "params", F.lit(f" parameters (threshold: {params} parameters)"))),
    ]
    made = [
        F.struct(
            F.lit(FUNCTION_METRICS[m][0]).alias("record_type_id"), F.lit(FUNCTION_METRICS[m][1]).alias("metric"), F.col(m).cast("long").alias("value"),
            limit.cast("long").alias("metric_limit"), text.alias("message"), F.lit(SUGGESTIONS[m]).alias("suggestion"),
        )
        for m, limit, text in options
    ]
    rows = instances.withColumn("code_area", area_of(F.col("file"), areas, generated)).withColumn("level", level(policy_of(F.col("code_area"), areas))).filter("level is not null")
    rows = rows.withColumn("r", F.explode(F.array(*made))).select("semantic_subject", "file", "name", "start_line", "group_size", "level", "code_area", "r.*").filter("value > metric_limit")
    identity = record_id(F.lit("function-metrics"), F.col("record_type_id"), {"metric": F.col("metric")}, subject(F.col("semantic_subject")))
    return rows.withColumn("record_id", identity)


def function_relations(current: DataFrame, baseline: DataFrame, changed: DataFrame, delta: int, metric: str = "lines", key: str = "start_line") -> DataFrame:
    """(file, name, key, value, relation) of the functions of files in the changed scope (``changed``: p).

    Ambiguous groups and null baseline metrics are ``changed``; absent functions count 0.
    """
    was = baseline.groupBy("file", "name").agg(F.count("*").alias("was_n"), F.first(metric).alias("was"))
    scope = changed.select(F.col("p").alias("file")).distinct()
    rows = current.join(scope, "file", "left_semi").join(was, ["file", "name"], "left")
    vague = ~stable_name(F.col("name")) | (F.col("group_size") != 1) | (F.coalesce("was_n", F.lit(0)) > 1)
    base = F.when(F.col("was_n").isNull(), 0).otherwise(F.col("was"))
    relation = F.when(vague | base.isNull(), "changed").otherwise(regression(F.lit(True), F.col(metric), base, delta))
    return rows.filter(F.col(metric).isNotNull()).select("file", "name", key, F.col(metric).alias("value"), relation.alias("relation"))


def related_functions(records: DataFrame, baseline: DataFrame, changed: DataFrame, delta: int) -> DataFrame:
    """J4, C4 for the records of all metrics at once: adds relation, as ``function_relations`` gives it, null outside of the changed scope."""
    was = baseline.groupBy("file", "name").agg(F.count("*").alias("__n"), F.first(F.struct(*FUNCTION_METRICS)).alias("__was"))
    scope = changed.select(F.col("p").alias("file")).distinct().withColumn("__changed", F.lit(True))
    rows = records.join(scope, "file", "left").join(was, ["file", "name"], "left")
    own = F.coalesce(*[F.when(F.col("record_type_id") == t, F.col("__was")[m].cast("long")) for m, (t, _) in FUNCTION_METRICS.items()])
    base = F.when(F.col("__n").isNull(), 0).otherwise(own)
    vague = ~stable_name(F.col("name")) | (F.col("group_size") != 1) | (F.coalesce("__n", F.lit(0)) > 1)
    relation = F.when(vague | base.isNull(), "changed").otherwise(regression(F.lit(True), F.col("value"), base, delta))
    return rows.withColumn("relation", F.when(F.col("__changed"), relation)).drop("__n", "__was", "__changed")


def duplicate_subjects(fragments: DataFrame) -> DataFrame:
    """Adds fingerprint, occurrence and the semantic subject to fragments (ordinal, line_count, token_count, locations)."""
    paths = F.array_sort(F.array_distinct(F.col("locations.path")))
    print_ = sha(canonical(lineCount=F.col("line_count"), paths=paths, tokenCount=F.col("token_count")))
    rows = fragments.withColumn("fingerprint", print_)
    nth = F.row_number().over(Window.partitionBy("fingerprint").orderBy("ordinal")).cast("long")
    return rows.withColumn("occurrence", nth).withColumn("semantic_subject", F.concat(F.lit("duplicate-fragment/v1/sha256:"), "fingerprint", F.lit("/occurrence:"), "occurrence"))


def duplicate_relations(current: DataFrame, baseline: DataFrame, hits: DataFrame, delta: int) -> DataFrame:
    """(semantic_subject, relation) of fragments in the changed scope; a subject new to the baseline has delta 1, else 0."""
    was = baseline.select("semantic_subject").distinct().withColumn("known", F.lit(True))
    rows = current.join(was, "semantic_subject", "left").join(hits, "fragment_id", "left")
    grew = F.when(F.col("known"), 0).otherwise(1)
    return rows.select("semantic_subject", regression(F.coalesce("hits", F.lit(False)), grew, F.lit(0), delta).alias("relation")).filter("relation is not null")


def verdict(records: DataFrame) -> DataFrame:
    """Failed where there is any record."""
    return records.agg(F.when(F.count("*") > 0, "failed").otherwise("passed").alias("verdict"))
