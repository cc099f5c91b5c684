"""Task graphs as DataFrames (T2-T5, T10, J23): closures by rounds over the frontier, each round's rows written to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.operators.durable import durable


def closure(edges: DataFrame) -> DataFrame:
    """(task, needs): direct and indirect dependencies of (task, needs); a task on a cycle needs itself."""
    edges = edges.select("task", "needs").distinct()
    known, frontier = edges, edges
    while True:
        step = frontier.select("task", F.col("needs").alias("via")).join(edges.select(F.col("task").alias("via"), "needs"), "via").select("task", "needs").distinct()
        frontier = durable(step.join(known, ["task", "needs"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = durable(known.union(frontier))


def on_cycles(edges: DataFrame) -> DataFrame:
    return closure(edges).filter("task = needs").select("task")


def unknown_dependencies(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    return edges.join(tasks.select(F.col("task").alias("needs")).distinct(), "needs", "left_anti").select("task", "needs").distinct()


def in_scope(edges: DataFrame, roots: DataFrame, terminals: DataFrame) -> DataFrame:
    """T4: the tasks that ``roots`` (task) need, directly or not, themselves included, if each of them has ended (``terminals``: task); else none."""
    first = roots.select("task").distinct()
    needed = first.union(closure(edges).join(first, "task", "left_semi").select(F.col("needs").alias("task"))).distinct()
    open_ = needed.join(terminals.select("task").distinct(), "task", "left_anti").agg((F.count("*") == 0).alias("__done"))
    return needed.join(F.broadcast(open_), F.col("__done")).select("task")  # one row


def blocked(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(task, blockers): tasks that can't start, with the failed tasks that they need directly or not, sorted and unique."""
    bad = failed.select("task").distinct()
    hit = closure(edges).join(bad.withColumnRenamed("task", "needs"), "needs", "left_semi").join(bad, "task", "left_anti")
    return hit.groupBy("task").agg(F.array_sort(F.collect_set("needs")).alias("blockers"))


def expanded(needs: DataFrame, groups: DataFrame) -> DataFrame:
    """(task, needs): group names replaced by their members, the task itself removed, distinct."""
    rows = needs.join(groups.select(F.col("group").alias("needs"), "member"), "needs", "left")
    return rows.select("task", F.coalesce("member", "needs").alias("needs")).filter("task <> needs").distinct()
