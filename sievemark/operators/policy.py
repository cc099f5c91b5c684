"""Policy evaluation.

Acceptance and views are conditions on a record alone, so one pass over the records gives each of them its acceptances and its
views as arrays; relations come in by one join, where a predicate asks for them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.operators.durable import durable

KINDS = ("check", "record", "reference", "view", "readiness")

#: A predicate takes the records, with their relations as ``__relations``, and returns a condition on them.
Predicate = Callable[[DataFrame], Column]


def operand_equals(name: str, value) -> Predicate:
    """Type-strict; a null operand equals nothing."""
    kinds = {bool: ("boolean",), int: ("bigint", "int"), float: ("double", "float"), str: ("string",)}[type(value)]
    return lambda rows: F.coalesce(F.col(name) == value, F.lit(False)) if dict(rows.dtypes)[name] in kinds else F.lit(False)


def operand_includes(name: str, part: str) -> Predicate:
    """Of texts only; case counts."""
    return lambda rows: F.coalesce(F.col(name).contains(part), F.lit(False)) if dict(rows.dtypes)[name] == "string" else F.lit(False)


def relation_is(reference: str, relation: str) -> Predicate:
    return relation_kind_in(reference, [relation])


def relation_kind_in(reference: str, kinds: list[str]) -> Predicate:
    return lambda rows: F.exists("__relations", lambda r: (r["reference_name"] == reference) & r["relation_id"].isin(*kinds))


def related(records: DataFrame, relations: DataFrame) -> DataFrame:
    """The records with their distinct relations (reference_name, relation_id) as ``__relations``."""
    of = relations.groupBy("record_id").agg(F.collect_set(F.struct("reference_name", "relation_id")).alias("__relations"))
    none = F.array().cast("array<struct<reference_name: string, relation_id: string>>")
    return records.join(of, "record_id", "left").withColumn("__relations", F.coalesce("__relations", none))


def condition(records: DataFrame, selectors: list[tuple[str, str]], predicates: list[Predicate] = ()) -> Column:
    """One of the (check, record type) selectors, and every predicate; no predicates hold always."""
    chosen = reduce(lambda a, b: a | b, [(F.col("check_id") == c) & (F.col("record_type_id") == t) for c, t in selectors], F.lit(False))
    return F.coalesce(reduce(lambda a, p: a & p(records), predicates, chosen), F.lit(False))


def select(records: DataFrame, selectors: list[tuple[str, str]], predicates: list[Predicate] = ()) -> DataFrame:
    return records.filter(condition(records, selectors, predicates))


def observed(records: DataFrame, rules: list[dict], declared: list[dict], relations: DataFrame | None = None) -> DataFrame:
    """The records with ``acceptances`` (acceptance_id, reason) and ``views``, arrays in declared order, in one pass.

    A rule selects one record type, a view several. acceptance of a view: all, accepted or unaccepted. relations are needed only
    where a predicate asks for them. Record ids are unique, as the store leaves them.
    """
    rows = records if relations is None else related(records, relations)
    none = F.array().cast("array<struct<acceptance_id: string, reason: string>>")
    held = [F.when(condition(rows, [(r["check_id"], r["record_type_id"])], r.get("predicates", [])), F.struct(F.lit(r["acceptance_id"]).alias("acceptance_id"), F.lit(r["reason"]).alias("reason"))) for r in rules]
    rows = rows.withColumn("acceptances", F.array_compact(F.array(*held)) if held else none)
    seen = {"all": F.lit(True), "accepted": F.size("acceptances") > 0, "unaccepted": F.size("acceptances") == 0}
    member = [F.when(condition(rows, v["selectors"], v.get("predicates", [])) & seen[v.get("acceptance", "all")], F.lit(v["view_id"])) for v in declared]
    return rows.withColumn("views", F.array_compact(F.array(*member)) if member else F.array().cast("array<string>")).drop("__relations")


def acceptance(rows: DataFrame) -> DataFrame:
    """(record_id, acceptance_id, reason) of observed records: a row for each rule that holds; a record may have several."""
    return rows.select("record_id", F.explode("acceptances").alias("a")).select("record_id", "a.*")


def views(rows: DataFrame) -> DataFrame:
    """(view_id, record_id) of observed records."""
    return rows.select(F.explode("views").alias("view_id"), "record_id")


def view_sizes(rows: DataFrame, declared: list[str]) -> DataFrame:
    """(view_id, records) of each declared view, empty ones included, in one pass over observed records."""
    counts = F.array(*[F.struct(F.lit(v).alias("view_id"), F.count_if(F.array_contains("views", v)).alias("records")) for v in declared])
    return rows.agg(counts.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def same_evidence(left: DataFrame, right: DataFrame) -> DataFrame:
    """U4: one row (equal): whether two evidence tables (kind, id) hold the same set, whatever their order and repeats."""
    a, b = (t.select("kind", "id").distinct() for t in (left, right))
    odd = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), ["kind", "id"], "full_outer").filter("l is null or r is null")
    return odd.agg((F.count("*") == 0).alias("equal"))


def readiness(clauses: DataFrame) -> DataFrame:
    """(ordinal, readiness_id, state) of clauses (ordinal, readiness_id, ok), up to and with the first that fails; later ones aren't
    evaluated and have no row. Clauses are declared, a few rows."""
    before = F.coalesce(F.min(F.col("ok").cast("int")).over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    return clauses.withColumn("before", before).filter("before = 1").select("ordinal", "readiness_id", F.when(F.col("ok"), "passed").otherwise("failed").alias("state"))


def gate(ready: DataFrame, block: DataFrame, enabled: bool = True) -> DataFrame:
    """One row (gate, reason): disabled; not-evaluated with the failed clause; failed if the block matched; passed. block has a column matched."""
    failed = ready.filter("state = 'failed'").agg(F.min_by("readiness_id", "ordinal").alias("reason"))
    hit = block.agg(F.coalesce(F.bool_or("matched"), F.lit(False)).alias("m"))
    both = failed.crossJoin(hit)  # one row each
    if not enabled:
        return both.select(F.lit("disabled").alias("gate"), F.lit(None).cast("string").alias("reason"))
    return both.select(F.when(F.col("reason").isNotNull(), "not-evaluated").when(F.col("m"), "failed").otherwise("passed").alias("gate"), "reason")


def evidence_order(evidence: DataFrame) -> DataFrame:
    """Distinct (kind, id) with their canonical position: kind rank, then id.

    Rows are cut into ranges, which are numbered apart and moved by the sizes of the ranges before, so no task sorts all. The
    ranges are drawn from a sample, so they are written before they are counted.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rows = evidence.select("kind", "id").distinct().withColumn("__rank", rank)
    rows = durable(rows.repartitionByRange("__rank", "id").withColumn("__part", F.spark_partition_id()))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy("__rank", "id"))
    placed = rows.withColumn("__nth", nth).join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
    return placed.select("kind", "id", (F.col("__before") + F.col("__nth")).cast("long").alias("position"))


def status(outcomes: DataFrame) -> DataFrame:
    """A7 over (status, verdict): unavailable anywhere fails; nothing completed, or a failed verdict, warns; else passed."""
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return outcomes.agg(F.when(any_(F.col("status") == "unavailable"), "failed").when(~any_(F.col("status") == "completed"), "warning").when(any_((F.col("status") == "completed") & (F.col("verdict") == "failed")), "warning").otherwise("passed").alias("status"))


def verification(outcomes: DataFrame, view: DataFrame | None, accepted: DataFrame) -> DataFrame:
    """As ``status``, but a warning over completed checks passes where every record of the view is accepted; without the view, as ``status``."""
    normal = status(outcomes)
    if view is None:
        return normal
    completed = outcomes.agg(F.coalesce(F.bool_or(F.col("status") == "completed"), F.lit(False)).alias("completed"))
    left = view.select("record_id").join(accepted.select("record_id").distinct(), "record_id", "left_anti").agg(F.count("*").alias("open"))
    row = normal.crossJoin(completed).crossJoin(left)  # one row each
    return row.select(F.when((F.col("status") != "failed") & F.col("completed") & (F.col("open") == 0), "passed").otherwise(F.col("status")).alias("status"))


def split(records: DataFrame, view: DataFrame | None, accepted: DataFrame) -> DataFrame:
    """Visible records with section warning or accepted; all are visible without a view."""
    seen = records if view is None else records.join(view.select("record_id").distinct(), "record_id", "left_semi")
    reasons = accepted.groupBy("record_id").agg(F.array_sort(F.collect_set("acceptance_id")).alias("acceptance_ids"))
    return seen.join(reasons, "record_id", "left").withColumn("section", F.when(F.col("acceptance_ids").isNull(), "warning").otherwise("accepted"))


def exit_code(origins: DataFrame, *by: str) -> DataFrame:
    """One row (exit_code), or one for each of ``by``, over diagnostics (origin, blocking) of a check that isn't ok: the first origin of those that block
    in the order profile or static 3, runner 4, case 5; else 6."""
    any_ = lambda *o: F.coalesce(F.bool_or(F.col("blocking") & F.col("origin").isin(*o)), F.lit(False))
    return origins.groupBy(*by).agg(F.when(any_("profile", "static"), 3).when(any_("runner"), 4).when(any_("case"), 5).otherwise(6).cast("long").alias("exit_code"))
