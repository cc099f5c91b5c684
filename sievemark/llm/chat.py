"""Preference formatting: one prompt for the turns that chosen and rejected conversations share, and two masked completions.

The longest common prefix of turns (role and text equal) is rendered once. What follows in either conversation is rendered as
its completion, with a mask in run lengths of characters: only the text of assistant turns and the mark that ends it is trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import table

CLOSE = "<|end|>\n"


def _escaped_text(text: Column) -> Column:
    """A ``<`` before bars gets one bar more, so that no text holds a mark: marks have one bar. Undone by taking one bar away."""
    return F.regexp_replace(text, "<(\\|+)", "<|$1")


def _escaped_role(role: Column) -> Column:
    """Bars are doubled, so that the mark ends at the first odd run of bars before ``>``."""
    return F.replace(role, F.lit("|"), F.lit("||"))


def _turns(rows: DataFrame, name: str) -> DataFrame:
    """(conv_id, array of (role, text) in the order of (turn, role, text), null turn first), by one shuffle."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kept = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return kept.filter("conv_id is not null").groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), _escaped_role(t["role"]), F.lit("|>\n"), _escaped_text(t["text"]), F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """``0:n,1:m,...``: runs of characters outside and inside of what is trained on, in the order of the rendered turns."""

    def runs(t: Column) -> Column:
        head, body = F.length(_escaped_role(t["role"])) + 5, F.length(_escaped_text(t["text"])) + len(CLOSE)
        return F.when(t["role"] == "assistant", F.concat(F.lit("0:"), head.cast("string"), F.lit(",1:"), body.cast("string"))).otherwise(F.concat(F.lit("0:"), (head + body).cast("string")))

    return F.array_join(F.transform(turns, runs), ",")


def _formatted(both: DataFrame) -> DataFrame:
    """Of (conv_id, c, r), the turns of either side."""
    n = F.least(F.size("c"), F.size("r"))
    differ = F.array_position(F.zip_with("c", "r", lambda a, b: ~a.eqNullSafe(b)), True)
    both = both.withColumn("shared", F.when(differ > 0, differ - 1).otherwise(n.cast("long")).cast("long"))
    at, rest = F.col("shared").cast("int"), lambda c: F.slice(c, F.col("shared").cast("int") + 1, F.greatest(F.size(c) - F.col("shared").cast("int"), F.lit(0)))
    return both.select(
        "conv_id", F.col("shared").alias("shared_turns"), _render(F.slice("c", F.lit(1), at)).alias("prompt"),
        _render(rest(F.col("c"))).alias("chosen"), _mask(rest(F.col("c"))).alias("chosen_mask"),
        _render(rest(F.col("r"))).alias("rejected"), _mask(rest(F.col("r"))).alias("rejected_mask"),
    )


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(conv_id, shared_turns, prompt, chosen, chosen_mask, rejected, rejected_mask) for every conv_id in both tables.

    Both tables have conv_id, turn, role, text. Turns are in the order of (turn, role, text), null turn first. Null role or text
    counts as empty; a null conv_id has no row. Repeated turns are turns of their own. Equal conversations have everything in the
    prompt and two empty completions; without a common first turn the prompt is empty. Marks in texts and roles are escaped, so
    that different conversations never look the same; masks count the escaped characters. Texts of any length are kept whole.
    Empty tables: no rows. Other columns are ignored.
    """
    return _formatted(_turns(chosen, "c").join(_turns(rejected, "r"), "conv_id"))


def stale_preferences(conversations: DataFrame) -> DataFrame:
    """``preferences`` of pairs made of one table, by one shuffle: chosen is a conversation up to its last assistant turn, rejected
    gives the assistant's reply before instead, or the turn before where it is the first reply, or nothing where it is the first turn.

    Turns are in the order of (turn, role, text), null turn first, which also settles equal turn numbers. Turns after the last
    reply and conversations without one are left out: there is nothing to prefer. A null conv_id has no row.
    """
    turns = _turns(conversations, "t").withColumn("last", F.size("t") + 1 - F.array_position(F.transform(F.reverse("t"), lambda t: t["role"] == "assistant"), True).cast("int"))
    kept = turns.filter(F.col("last") <= F.size("t")).select("conv_id", F.slice("t", F.lit(1), F.col("last")).alias("c"), F.slice("t", F.lit(1), F.col("last") - 1).alias("before"))
    reply = F.get(F.reverse(F.filter("before", lambda t: t["role"] == "assistant")), F.lit(0))["text"]
    stale = F.coalesce(reply, F.get(F.reverse("before"), F.lit(0))["text"], F.lit(""))
    return _formatted(kept.select("conv_id", "c", F.concat("before", F.array(F.struct(F.lit("assistant").alias("role"), stale.alias("text")))).alias("r")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stale_preferences(table(spark, sf_dir, "conversations"))


_TEXT, _ROLE = r"regexp_replace({0}, '<(\|+)', '<|\1', 'g')", "replace(role, '|', '||')"
_TURN = "'<|' || " + _ROLE + " || '|>' || chr(10) || " + _TEXT + " || '<|end|>' || chr(10)"


def _sql_side(name: str) -> str:
    head, body = f"length({_ROLE}) + 5", f"length({_TEXT.format(name)}) + 8"
    return f"""coalesce(string_agg({_TURN.format(name)}, '' ORDER BY nth) FILTER (nth > shared), '') AS {name},
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN '0:' || ({head}) || ',1:' || ({body}) ELSE '0:' || ({head} + {body}) END, ',' ORDER BY nth) FILTER (nth > shared), '') AS {name}_mask"""


ORACLE = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(nth) AS last FROM o WHERE role = 'assistant' GROUP BY conv_id),
u AS (SELECT o.*, last FROM o JOIN l USING (conv_id) WHERE nth <= last),
e AS (SELECT conv_id, max_by(text, nth) FILTER (role = 'assistant') AS reply, max_by(text, nth) AS any_text FROM u WHERE nth < last GROUP BY conv_id),
t AS (SELECT u.conv_id, role, text AS chosen, CASE WHEN nth < last THEN text ELSE coalesce(reply, any_text, '') END AS rejected, nth FROM u LEFT JOIN e USING (conv_id)),
s AS (SELECT *, coalesce(min(CASE WHEN chosen <> rejected THEN nth END) OVER (PARTITION BY conv_id) - 1, count(*) OVER (PARTITION BY conv_id)) AS shared FROM t)
SELECT conv_id, CAST(max(shared) AS BIGINT) AS shared_turns,
  coalesce(string_agg({_TURN.format("chosen")}, '' ORDER BY nth) FILTER (nth <= shared), '') AS prompt,
  {_sql_side("chosen")}, {_sql_side("rejected")}
FROM s GROUP BY conv_id
"""
