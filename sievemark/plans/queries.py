"""Registered queries: each applies one operator to whole driver tables, with the SQL that gives the same rows beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemark.functions import canonical as C
from sievemark.functions import text as X
from sievemark.operators import checks, evidence, graph, measure, policy, references, scope, store
from sievemark.sources import decoders, publication, tables
from sievemark.sources.tables import AREAS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FLOOR, ALLOWANCE, FEW_TOKENS, DELTA, TOKENS = 6, 12, 10, 2, 20

_AREA = """CASE WHEN regexp_matches(path, '^([^./][^/]*/)*src19/') THEN 'generated' WHEN regexp_matches(path, '^en/') AND NOT regexp_matches(path, '^en/src7/') THEN 'english'
 WHEN regexp_matches(path, '^de/') THEN 'german' WHEN regexp_matches(path, '^fr/') THEN 'french' ELSE 'unknown' END"""
_BASE = f"""
f0 AS (SELECT doc_id, lang || '/' || source || '/' || doc_id AS path, lang AS language, text FROM documents),
files AS (SELECT *, {_AREA} AS area FROM f0),
m0 AS (SELECT *, string_split(text, chr(10)) AS ls FROM files),
measured AS (SELECT doc_id, path, language, area, len(ls) AS lines, len(list_filter(ls, lambda l: trim(l) <> '')) AS code_lines,
  len(ls) - len(list_filter(ls, lambda l: trim(l) <> '')) AS blank_lines, length(text) - length(regexp_replace(text, '[.,;:!?]', '', 'g')) AS decision_tokens FROM m0),
base AS (SELECT path, CAST(len(list_distinct(list_filter(ls, lambda l: trim(l) <> ''))) AS BIGINT) AS value FROM m0 WHERE path NOT LIKE '%/src3/%'),
changed AS (SELECT path FROM files WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
touched AS (SELECT path FROM files f WHERE EXISTS (SELECT 1 FROM changed c WHERE contains(f.path, c.path) OR contains(c.path, f.path))),
frec AS (SELECT *, CASE area WHEN 'german' THEN 'info' ELSE 'warning' END AS level FROM (SELECT *, CASE WHEN decision_tokens <= {FEW_TOKENS} THEN {ALLOWANCE} ELSE {FLOOR} END AS code_limit FROM measured)
  WHERE area IN ('english', 'german') AND code_lines > code_limit),
records AS (SELECT '{C.RECORD}' || sha256('{{"checkId":"file-metrics","identityFields":{{"metric":"code-lines"}},"recordTypeId":"file-code-lines","semanticSubject":"' || path || '"}}') AS record_id,
  'file-metrics' AS check_id, 'file-code-lines' AS record_type_id, level, path AS semantic_subject, 'File ' || path || ' has ' || code_lines || ' code lines (threshold: ' || code_limit || ')' AS message,
  area AS code_area, CAST(code_limit AS BIGINT) AS code_limit, 'code-lines' AS metric, CAST(code_lines AS BIGINT) AS value, path, CAST(1 AS BIGINT) AS line FROM frec),
relations AS (SELECT record_id, 'file-metrics' AS check_id, 'base' AS reference_name, CASE WHEN r.value - coalesce(b.value, 0) > {DELTA} THEN 'regression' ELSE 'changed' END AS relation_id
  FROM records r JOIN touched t ON t.path = r.semantic_subject LEFT JOIN base b ON b.path = r.semantic_subject),
fn0 AS (SELECT 'conv/' || conv_id AS file, role AS name, turn + 1 AS start_line, len(regexp_extract_all(text, '[^ \\n]+')) AS lines,
  nullif(length(text) - length(replace(text, ',', '')), 0) AS ccn, turn AS params, turn AS ordinal FROM conversations),
fn AS (SELECT *, count(*) OVER (PARTITION BY file, name) AS group_size, row_number() OVER (PARTITION BY file, name ORDER BY lines, coalesce(ccn, -1), params, ordinal) AS nth FROM fn0),
inst AS (SELECT * EXCLUDE (nth), CASE WHEN group_size = 1 THEN NULL ELSE nth END AS occurrence, CASE WHEN group_size = 1 THEN 'function:{{"file":"' || file || '","name":"' || name || '"}}'
  ELSE 'function-instance:{{"file":"' || file || '","name":"' || name || '","occurrence":' || nth || '}}' END AS semantic_subject FROM fn),
dl AS (SELECT area, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS start_line FROM files),
dup AS (SELECT area, line, max(CAST(len(regexp_split_to_array(trim(line), ' +')) AS BIGINT)) AS token_count, count(*) AS location_count, count(DISTINCT path) AS n_files, list_sort(list_distinct(list(path))) AS paths
  FROM dl WHERE len(regexp_split_to_array(trim(line), ' +')) >= {TOKENS} GROUP BY area, line HAVING count(DISTINCT path) >= 2)
"""


def query(name: str, sql: str | None = None, base: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {_BASE}{sql}" if base else sql
        return f

    return add


def file_records(spark, d):
    return checks.file_records(tables.measured(spark, d), AREAS, FLOOR, ALLOWANCE, FEW_TOKENS)


def relations(spark, d):
    """(record_id, check_id, reference_name, relation_id) of the file records."""
    r = file_records(spark, d)
    rel = checks.file_relations(r.select(F.col("semantic_subject").alias("path"), "value", "record_id"), tables.baseline(spark, d), scope.touched(tables.files(spark, d, False), tables.changed(spark, d)), DELTA)
    ids = r.select(F.col("semantic_subject").alias("path"), "record_id")
    return rel.join(ids, "path").select("record_id", F.lit("file-metrics").alias("check_id"), F.lit("base").alias("reference_name"), F.col("relation").alias("relation_id"))


# --- identity -------------------------------------------------------------------------------------------------------------


@query("record_identity", f", x AS (SELECT doc_id, replace(replace(nfc_normalize(path || chr(13) || chr(10) || substr(text, 1, 0)), chr(13) || chr(10), chr(10)), chr(10), '\\n') AS s FROM files) SELECT doc_id, '{C.RECORD}' || sha256('{{\"checkId\":\"file-metrics\",\"identityFields\":{{\"metric\":\"code-lines\"}},\"recordTypeId\":\"file-code-lines\",\"semanticSubject\":\"' || s || '\"}}') AS record_id FROM x", True)
def record_identity(spark, d):
    f = tables.files(spark, d, False)
    s = C.subject(F.concat("path", F.lit("\r\n")))
    return f.select("doc_id", C.record_id(F.lit("file-metrics"), F.lit("file-code-lines"), {"metric": F.lit("code-lines")}, s).alias("record_id"))


@query("catalog_fingerprint", f"""
WITH t AS (SELECT n_regionkey, '[' || string_agg('{{"fields":[{{"fieldId":"metric","required":true,"valueType":"string"}}],"identityFields":["metric"],"recordTypeId":"nation-' || n_nationkey || '"}}', ',' ORDER BY 'nation-' || n_nationkey) || ']' AS types FROM nation GROUP BY 1)
SELECT '{C.CATALOG}' || sha256('[' || string_agg('{{"checkId":"region-' || r_regionkey || '","displayName":"' || r_name || '","recordTypes":' || types || '}}', ',' ORDER BY 'region-' || r_regionkey) || ']') AS fingerprint, count(*) AS checks FROM region JOIN t ON n_regionkey = r_regionkey""")
def catalog_fingerprint(spark, d):
    """A catalog held in tables; the driver's own form is canonical.catalog_fingerprint."""
    field = F.array(F.struct(F.lit("metric").alias("fieldId"), F.lit(True).alias("required"), F.lit("string").alias("valueType")))
    t = F.struct(F.concat(F.lit("nation-"), "n_nationkey").alias("k"), F.struct(field.alias("fields"), F.array(F.lit("metric")).alias("identityFields"), F.concat(F.lit("nation-"), "n_nationkey").alias("recordTypeId")).alias("t"))
    types = table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(t)), lambda x: x["t"]).alias("recordTypes"))
    rows = table(spark, d, "region").join(types, F.col("n_regionkey") == F.col("r_regionkey"))
    check = F.concat(F.lit("region-"), "r_regionkey")
    row = F.struct(check.alias("k"), F.struct(check.alias("checkId"), F.col("r_name").alias("displayName"), "recordTypes").alias("c"))
    return rows.agg(F.concat(F.lit(C.CATALOG), C.sha(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["c"])))).alias("fingerprint"), F.count("*").alias("checks"))


@query("records_fingerprint", f""" SELECT '{C.RECORDS}' || sha256('[' || coalesce(string_agg('{{"record_id":"' || record_id || '","value":' || value || '}}', ',' ORDER BY record_id), '') || ']') AS fingerprint, count(*) AS n FROM records""", True)
def records_fingerprint(spark, d):
    return C.records_fingerprint(file_records(spark, d).select("record_id", "value"))


@query("reference_identity", f"SELECT o_orderkey, '{C.REFERENCE}' || sha256(CAST(o_orderkey AS VARCHAR) || '@' || o_orderpriority) AS reference_id FROM orders")
def reference_identity(spark, d):
    """Each order as a revision."""
    return table(spark, d, "orders").select("o_orderkey", C.reference_id(F.concat("o_orderkey", F.lit("@"), "o_orderpriority")).alias("reference_id"))


# --- scope ----------------------------------------------------------------------------------------------------------------


@query("scope_files", " SELECT path FROM files WHERE NOT list_contains(string_split(path, '/'), 'src3') AND NOT regexp_matches(path, '(^|/)src19/') AND NOT starts_with(path, 'fr/')", True)
def scope_files(spark, d):
    f = tables.files(spark, d, False)
    return f.filter(scope.in_scope(F.col("path"), ["{en,de,es}/**"], ["src3"], tables.GENERATED)).select("path")


@query("classify_areas", " SELECT path, area, CASE area WHEN 'english' THEN 'moderate' WHEN 'german' THEN 'watchlist-only' WHEN 'french' THEN 'exclude-warnings' END AS policy FROM files", True)
def classify_areas(spark, d):
    return tables.files(spark, d, False).select("path", "area", scope.policy_of(F.col("area"), AREAS).alias("policy"))


@query("area_groups", " SELECT area, count(*) AS files, min(path) AS first_path, max(path) AS last_path FROM files GROUP BY area HAVING count(*) >= 2", True)
def area_groups(spark, d):
    return tables.files(spark, d, False).groupBy("area").agg(F.count("*").alias("files"), F.min("path").alias("first_path"), F.max("path").alias("last_path")).filter("files >= 2")


@query("area_fingerprints", """
 SELECT area, count(*) AS file_count, array_to_string(list_slice(list_sort(list(path)), 1, 200), ',') AS file_list,
  'sha256:' || sha256(string_agg(path || chr(0) || sha256(text) || chr(10), '' ORDER BY path)) || ':' || count(*) AS fingerprint
 FROM files GROUP BY area""", True)
def area_fingerprints(spark, d):
    """The payload lists the first 200 paths, the feature's own limit; the digest covers all."""
    rows = scope.area_fingerprints(tables.files(spark, d).select("area", "path", C.sha(F.col("text")).alias("content_hash")))
    return rows.withColumn("file_list", F.array_join("file_list", ","))


@query("path_set_ops", " , a AS (SELECT path FROM files WHERE area = 'english'), b AS (SELECT path FROM changed) SELECT 'union' AS op, path FROM (SELECT path FROM a UNION SELECT path FROM b) UNION ALL SELECT 'except', path FROM (SELECT path FROM a EXCEPT SELECT path FROM b) UNION ALL SELECT 'both', path FROM (SELECT path FROM a INTERSECT SELECT path FROM b)", True)
def path_set_ops(spark, d):
    a, b = tables.files(spark, d, False).filter("area = 'english'").select("path"), tables.changed(spark, d)
    ops = [("union", a.union(b).distinct()), ("except", a.subtract(b)), ("both", a.intersect(b))]
    out = [x.select(F.lit(n).alias("op"), "path") for n, x in ops]
    return out[0].union(out[1]).union(out[2])


@query("changed_scope", " SELECT path FROM touched", True)
def changed_scope(spark, d):
    return scope.touched(tables.files(spark, d, False), tables.changed(spark, d)).select(F.col("p").alias("path"))


@query("changed_exact", " SELECT path FROM files SEMI JOIN changed USING (path)", True)
def changed_exact(spark, d):
    return tables.files(spark, d, False).join(tables.changed(spark, d), "path", "left_semi").select("path")


@query("revision_diff", """, b AS (SELECT path, sha256(text) AS hash FROM files), a AS (SELECT path, sha256(replace(text, '!!', '!')) AS hash FROM files WHERE path NOT LIKE '%/src3/%' UNION ALL SELECT 'bench/' || item_id, sha256(text) FROM benchmark)
 SELECT path, CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'removed' ELSE 'modified' END AS status FROM b FULL JOIN a USING (path) WHERE b.hash IS DISTINCT FROM a.hash""", True)
def revision_diff(spark, d):
    """The documents against a later revision: src3 gone, doubled exclamation marks made single, the benchmark's items new."""
    f = tables.files(spark, d)
    before = f.select("path", C.sha(F.col("text")).alias("hash"))
    after = f.filter("path not like '%/src3/%'").select("path", C.sha(F.replace("text", F.lit("!!"), F.lit("!"))).alias("hash"))
    return scope.revision_diff(before, after.union(table(spark, d, "benchmark").select(F.concat(F.lit("bench/"), "item_id"), C.sha(F.col("text")))))


@query("scheduling_inheritance", """SELECT n_nationkey, list_sort(list_distinct(list_concat(list_filter(['core', 'io', 'region-0', 'region-1'], lambda x: x <> 'region-' || n_regionkey), ['nation-' || n_nationkey]))) AS mutex FROM nation""")
def scheduling_inheritance(spark, d):
    parent = F.array(*map(F.lit, ["core", "io", "region-0", "region-1"]))
    n = table(spark, d, "nation")
    return n.select("n_nationkey", scope.edited(parent, F.array(F.concat(F.lit("nation-"), "n_nationkey")), F.array(F.concat(F.lit("region-"), "n_regionkey"))).alias("mutex"))


# --- file check -------------------------------------------------------------------------------------------------------------

QUERIES["file_metrics_records"] = file_records
SQL["file_metrics_records"] = f"WITH {_BASE} SELECT * FROM records"


@query("measured_files", " SELECT path, language, area, lines, code_lines, blank_lines, decision_tokens FROM measured", True)
def measured_files(spark, d):
    return tables.measured(spark, d).drop("doc_id")


@query("file_relations", f" SELECT m.path, code_lines AS value, coalesce(b.value, 0) AS baseline, CASE WHEN code_lines - coalesce(b.value, 0) > {DELTA} THEN 'regression' ELSE 'changed' END AS relation FROM measured m JOIN touched USING (path) LEFT JOIN base b USING (path)", True)
def file_relations(spark, d):
    m = tables.measured(spark, d).select("path", F.col("code_lines").alias("value"))
    return checks.file_relations(m, tables.baseline(spark, d), scope.touched(tables.files(spark, d, False), tables.changed(spark, d)), DELTA)


@query("language_aggregate", " SELECT language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(code_lines) AS BIGINT) AS code_lines, CAST(sum(blank_lines) AS BIGINT) AS blank_lines, CAST(sum(decision_tokens) AS BIGINT) AS decision_tokens FROM measured GROUP BY language", True)
def language_aggregate(spark, d):
    g = tables.measured(spark, d).groupBy("language").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("lines", "code_lines", "blank_lines", "decision_tokens")])
    return g.orderBy(F.desc("lines"), "language")


@query("file_verdict", " SELECT CASE WHEN count(*) > 0 THEN 'failed' ELSE 'passed' END AS verdict FROM records", True)
def file_verdict(spark, d):
    return checks.verdict(file_records(spark, d))


@query("top_files", " SELECT area, path, lines, rank FROM (SELECT area, path, lines, row_number() OVER (PARTITION BY area ORDER BY lines DESC, path) AS rank FROM measured) WHERE rank <= 20", True)
def top_files(spark, d):
    """A report: the 20 longest files of each area."""
    return evidence.top(tables.measured(spark, d).select("area", "path", "lines"), "area", [F.desc("lines"), "path"], 20)


# --- function check ---------------------------------------------------------------------------------------------------------


@query("function_groups", " SELECT file, name, count(*) AS members, max(lines) AS most_lines FROM fn0 GROUP BY ALL", True)
def function_groups(spark, d):
    return tables.functions(spark, d).groupBy("file", "name").agg(F.count("*").alias("members"), F.max("lines").alias("most_lines"))


@query("function_occurrences", " SELECT * FROM inst", True)
def function_occurrences(spark, d):
    return checks.function_instances(tables.functions(spark, d))


_FLIMITS = {"lines": 40, "low_lines": 80, "low_below": 5, "ccn": 4, "params": 2}
#: Conversations by their number's last digit: 5 excluded, other odd ones watched, even ones in full.
FUNCTION_AREAS = [
    scope.Area("closed", ("conv/*5",), (), "exclude-warnings"), scope.Area("watched", ("conv/*[1379]",), (), "watchlist-only"), scope.Area("plain", ("conv/*[02468]",)),
]
_INSTANCES = """, ia AS (SELECT *, CASE WHEN right(file, 1) = '5' THEN 'closed' WHEN right(file, 1) IN ('1', '3', '7', '9') THEN 'watched' ELSE 'plain' END AS code_area FROM inst),
 il AS (SELECT *, CASE code_area WHEN 'watched' THEN 'info' ELSE 'warning' END AS level, 'Function "' || name || '" in ' || file || ':' || start_line || ' has ' AS head,
  coalesce(ccn < 5, false) AS low FROM ia WHERE code_area <> 'closed'),
 r0 AS (SELECT semantic_subject, file, name, start_line, group_size, level, code_area, 'function-code-lines' AS record_type_id, 'function-code-density' AS metric, lines AS value,
   CASE WHEN low THEN 80 ELSE 40 END AS metric_limit, head || lines || ' code lines at cyclomatic complexity ' || coalesce(CAST(ccn AS VARCHAR), 'n/a')
   || ' (threshold: ' || CASE WHEN low THEN '80 code lines for CC < 5' ELSE '40 code lines' END || ')' AS message,
   'Consider reducing branching or splitting the function when line count and complexity make it hard to review' AS suggestion FROM il
 UNION ALL SELECT semantic_subject, file, name, start_line, group_size, level, code_area, 'function-cyclomatic-complexity', 'cyclomatic-complexity', ccn, 4,
   head || 'cyclomatic complexity ' || ccn || ' (threshold: 4 CC)', 'Consider breaking this function into smaller, more focused functions' FROM il
 UNION ALL SELECT semantic_subject, file, name, start_line, group_size, level, code_area, 'function-parameter-count', 'parameter-count', params, 2,
   head || params || ' parameters (threshold: 2 parameters)', 'Consider using a parameter object or splitting the function' FROM il),
 frecords AS (SELECT *, '{RECORD}' || sha256('{"checkId":"function-metrics","identityFields":{"metric":"' || metric || '"},"recordTypeId":"' || record_type_id
   || '","semanticSubject":"' || replace(semantic_subject, '"', '\\"') || '"}') AS record_id FROM r0 WHERE value > metric_limit)""".replace("{RECORD}", C.RECORD)


def function_rows(spark, d):
    return checks.function_records(checks.function_instances(tables.functions(spark, d)), FUNCTION_AREAS, [], **_FLIMITS)


@query("function_records", _INSTANCES + " SELECT * FROM frecords", True)
def function_records(spark, d):
    """An excluded, a watched and a plain area decide on the level, or that there is no record."""
    return function_rows(spark, d)


#: Conversations of more than four turns are the changed scope; the reference had the first three turns of the assistant.
_FCHANGED = "fchanged AS (SELECT file FROM fn0 GROUP BY file HAVING count(*) > 4)"


def _function_scope(spark, d):
    f = tables.functions(spark, d)
    return f, f.groupBy("file").agg(F.count("*").alias("n")).filter("n > 4").select(F.col("file").alias("p"))


@query("function_relations", f""", {_FCHANGED}, w AS (SELECT file, name, count(*) AS n, any_value(lines) AS was FROM fn0 WHERE name <> 'assistant' OR params < 3 GROUP BY ALL)
 SELECT i.file, i.name, start_line, lines AS value,
  CASE WHEN group_size <> 1 OR coalesce(n, 0) > 1 THEN 'changed' WHEN lines - coalesce(was, 0) > 2 THEN 'regression' ELSE 'changed' END AS relation
 FROM inst i LEFT JOIN w ON w.file = i.file AND w.name = i.name WHERE i.file IN (SELECT file FROM fchanged)""", True)
def function_relations(spark, d):
    f, changed = _function_scope(spark, d)
    return checks.function_relations(checks.function_instances(f), f.filter("name <> 'assistant' or params < 3"), changed, 2)


# --- duplicates ---------------------------------------------------------------------------------------------------------------


def fragments(spark, d):
    f = measure.repeated_lines(tables.files(spark, d), TOKENS)
    return f.withColumn("fragment_id", F.sha2(F.concat("area", F.lit("\n"), "line"), 256)).withColumn("line_count", F.lit(1).cast("long")).withColumn("ordinal", F.col("fragment_id"))


@query("duplicate_lines", " SELECT area, line, token_count, location_count, n_files AS file_count FROM dup", True)
def duplicate_lines(spark, d):
    f = fragments(spark, d)
    return f.select("area", "line", "token_count", F.size("locations").cast("long").alias("location_count"), F.size(F.array_distinct("locations.path")).cast("long").alias("file_count"))


_PRINT = """, p AS (SELECT *, sha256(area || chr(10) || line) AS fragment_id, sha256('{"lineCount":1,"paths":["' || array_to_string(paths, '","') || '"],"tokenCount":' || token_count || '}') AS fingerprint FROM dup),
 q AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY fragment_id) AS occurrence FROM p)"""


@query("duplicate_fingerprints", _PRINT + " SELECT fragment_id, fingerprint, occurrence, 'duplicate-fragment/v1/sha256:' || fingerprint || '/occurrence:' || occurrence AS semantic_subject FROM q", True)
def duplicate_fingerprints(spark, d):
    return checks.duplicate_subjects(fragments(spark, d)).select("fragment_id", "fingerprint", "occurrence", "semantic_subject")


@query("duplicate_levels", """, l AS (SELECT line, list_sort(list_distinct(list(area))) AS areas FROM dl WHERE len(regexp_split_to_array(trim(line), ' +')) >= 20 GROUP BY line HAVING count(DISTINCT path) >= 2)
 SELECT sha256(line) AS line_id, array_to_string(areas, ',') AS areas, CASE WHEN areas = ['german'] THEN 'info' ELSE 'warning' END AS level FROM l WHERE areas <> ['french']""", True)
def duplicate_levels(spark, d):
    """Lines shared across areas: excluded only if all of their areas are."""
    f = measure.repeated_lines(tables.files(spark, d).withColumn("own", F.col("area")).withColumn("area", F.lit("all")), TOKENS)
    where = f.select("line", F.explode("locations.path").alias("path"))
    areas = where.select("line", scope.area_of(F.col("path"), AREAS, tables.GENERATED).alias("area")).groupBy("line").agg(F.array_sort(F.collect_set("area")).alias("areas"))
    level = X.level_of_areas(F.transform("areas", lambda a: scope.policy_of(a, AREAS)))
    return areas.select(F.sha2("line", 256).alias("line_id"), F.array_join("areas", ",").alias("areas"), level.alias("level")).filter("level is not null")


@query("duplicate_relations", _PRINT + """, s AS (SELECT fragment_id, 'duplicate-fragment/v1/sha256:' || fingerprint || '/occurrence:' || occurrence AS semantic_subject, paths FROM q),
 bdup AS (SELECT area, line, max(CAST(len(regexp_split_to_array(trim(line), ' +')) AS BIGINT)) AS token_count, list_sort(list_distinct(list(path))) AS paths FROM dl WHERE path NOT LIKE '%/src3/%' AND len(regexp_split_to_array(trim(line), ' +')) >= 20 GROUP BY area, line HAVING count(DISTINCT path) >= 2),
 bp AS (SELECT sha256(area || chr(10) || line) AS fragment_id, sha256('{"lineCount":1,"paths":["' || array_to_string(paths, '","') || '"],"tokenCount":' || token_count || '}') AS fingerprint FROM bdup),
 bs AS (SELECT 'duplicate-fragment/v1/sha256:' || fingerprint || '/occurrence:' || row_number() OVER (PARTITION BY fingerprint ORDER BY fragment_id) AS semantic_subject FROM bp)
 SELECT semantic_subject, CASE WHEN semantic_subject IN (SELECT semantic_subject FROM bs) THEN 'changed' ELSE 'regression' END AS relation FROM s WHERE EXISTS (SELECT 1 FROM touched t WHERE list_contains(s.paths, t.path))""", True)
def duplicate_relations(spark, d):
    now = checks.duplicate_subjects(fragments(spark, d))
    old = measure.repeated_lines(tables.files(spark, d).filter("path not like '%/src3/%'"), TOKENS)
    old = checks.duplicate_subjects(old.withColumn("ordinal", F.sha2(F.concat("area", F.lit("\n"), "line"), 256)).withColumn("line_count", F.lit(1).cast("long")))
    return checks.duplicate_relations(now, old, scope.hit_fragments(now, tables.changed(spark, d)), 0)


# --- decoders -----------------------------------------------------------------------------------------------------------------


def _file_csv(spark, d):
    """A scanner's CSV for each language, rendered from the measures; French ones hold a row that isn't numeric."""
    m = tables.measured(spark, d)
    bad = F.when((F.col("language") == "fr") & (F.col("path").like("%/src2/%")), "x").otherwise(F.col("lines").cast("string"))
    row = F.concat_ws(",", "language", F.lit(""), F.concat(F.lit('"'), "path", F.lit('"')), bad, "code_lines", F.lit("0"), "blank_lines", F.when(F.col("decision_tokens") > 0, F.col("decision_tokens").cast("string")).otherwise(""), F.lit("0"), F.lit("0"))
    header = ",".join(decoders.FILE_HEADER)
    g = m.withColumn("row", row).groupBy(F.concat_ws("/", "language", F.split("path", "/")[1]).alias("doc")).agg(F.concat(F.lit("report\n" + header + "\n"), F.array_join(F.array_sort(F.collect_list("row")), "\n")).alias("content"))
    return g


@query("csv_metric_decode", " SELECT language || '/' || string_split(path, '/')[2] AS doc, path, language, lines, code_lines, CAST(0 AS BIGINT) AS comment_lines, blank_lines, nullif(decision_tokens, 0) AS decision_tokens FROM measured WHERE path NOT LIKE 'fr/src2/%'", True)
def csv_metric_decode(spark, d):
    return decoders.file_metrics(_file_csv(spark, d))


@query("csv_function_decode", " SELECT file AS doc, file, name, start_line, start_line + lines AS end_line, lines, ccn, params FROM fn0 WHERE file NOT IN (SELECT file FROM fn0 WHERE name = 'system')", True)
def csv_function_decode(spark, d):
    """A CSV for each conversation; a system turn is written without a parameter count, which voids its file."""
    f = tables.functions(spark, d)
    row = F.concat_ws(",", "lines", F.coalesce(F.col("ccn").cast("string"), F.lit("")), F.lit("0"), F.when(F.col("name") == "system", "").otherwise(F.col("params").cast("string")), F.lit("0"), F.lit(""), "file", "name", F.lit(""), "start_line", (F.col("start_line") + F.col("lines")).cast("string"))
    text = f.withColumn("row", row).groupBy(F.col("file").alias("doc")).agg(F.concat(F.lit("NLOC,CCN,token,PARAM,length,location,file,function,long_name,start,end\n"), F.array_join(F.array_sort(F.collect_list("row")), "\n")).alias("content"))
    return decoders.function_metrics(text)


@query("json_fragment_decode", """SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal, CAST(trunc(value) AS BIGINT) AS line_count, CAST(json_extract(props, '$.k') AS BIGINT) AS token_count, event_type AS first_path, event_id AS first_line FROM events""")
def json_fragment_decode(spark, d):
    """A report for each user, rendered from the events and decoded again."""
    loc = lambda n: F.struct(F.col("event_type").alias("name"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.struct((F.col("event_id") + 0.5).alias("line")).alias("startLoc"))
    e = table(spark, d, "events")
    one = F.struct("event_id", F.struct(F.col("value").alias("lines"), F.get_json_object("props", "$.k").cast("double").alias("tokens"), loc(0).alias("firstFile"), loc(1).alias("secondFile")).alias("d"))
    doc = e.groupBy(F.col("user_id").alias("doc")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["d"]).alias("duplicates"))).alias("content"))
    return decoders.fragments(doc).select("doc", "ordinal", "line_count", "token_count", F.col("locations")[0]["path"].alias("first_path"), F.col("locations")[0]["start_line"].alias("first_line"))


@query("ndjson_decode", """SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
 CASE WHEN event_type = 'error' THEN 'line ' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) || ' is not JSON' END AS problem FROM events""")
def ndjson_decode(spark, d):
    e = table(spark, d, "events").withColumn("line", F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"])
    text = e.groupBy(F.col("user_id").alias("doc")).agg(F.array_join(lines, "\n").alias("content"))
    return decoders.ndjson(text, "struct<k: bigint>").select("doc", "pos", F.col("value.k").alias("k"), "problem")


@query("batch_gate", " SELECT path, lines FROM measured WHERE (SELECT bool_and(lines >= 0 AND code_lines <= lines) FROM measured) AND NOT EXISTS (SELECT 1 FROM measured WHERE path NOT IN (SELECT path FROM files))", True)
def batch_gate(spark, d):
    m = tables.measured(spark, d).select("path", "lines", "code_lines")
    sound = scope.all_or_nothing(m, measure.valid_count(F.col("lines")) & (F.col("code_lines") <= F.col("lines")))
    return scope.accepted_batch(sound, tables.files(spark, d, False)).select("path", "lines")


@query("batch_gate_closed", " SELECT path, lines FROM measured WHERE (SELECT bool_and(code_lines > 0 AND decision_tokens > 0) FROM measured)", True)
def batch_gate_closed(spark, d):
    """Some files have no decision token, so the whole batch is void."""
    m = tables.measured(spark, d).select("path", "lines", "code_lines", "decision_tokens")
    return scope.all_or_nothing(m, (F.col("code_lines") > 0) & (F.col("decision_tokens") > 0)).select("path", "lines")


@query("batch_gate_by_area", " SELECT area, path, lines FROM measured WHERE area IN (SELECT area FROM measured GROUP BY area HAVING min(decision_tokens) > 0)", True)
def batch_gate_by_area(spark, d):
    """Batches by area: each is whole or void."""
    m = tables.measured(spark, d).select("area", "path", "lines", "decision_tokens")
    return decoders.whole(m, F.col("decision_tokens") > 0, "area").select("area", "path", "lines")


@query("json_states", "SELECT event_id, CASE event_type WHEN 'error' THEN 'malformed' WHEN 'view' THEN 'empty' WHEN 'click' THEN 'missing' ELSE 'ok' END AS state FROM events")
def json_states(spark, d):
    e = table(spark, d, "events")
    content = F.when(F.col("event_type") == "error", F.concat(F.lit("["), "props")).when(F.col("event_type") == "view", " ").when(F.col("event_type") != "click", F.col("props"))
    return decoders.json_document(e.select(F.col("event_id").alias("doc"), content.alias("content"))).withColumnRenamed("doc", "event_id")


# --- store ----------------------------------------------------------------------------------------------------------------------

_SUB = "s AS (SELECT user_id || '/' || event_type || '/' || CAST(ts AS DATE) AS record_id, CAST(floor(value / 50) AS BIGINT) AS body, * FROM events)"


def submissions(spark, d):
    e = table(spark, d, "events")
    return e.withColumn("record_id", F.concat_ws("/", "user_id", "event_type", F.to_date("ts").cast("string"))).withColumn("body", F.floor(F.col("value") / 50).cast("long"))


@query("record_conflicts", f"WITH {_SUB} SELECT record_id, CASE WHEN count(DISTINCT body) = 1 THEN min(body) END AS body, count(*) AS submissions, count(DISTINCT body) AS bodies, CASE WHEN count(DISTINCT body) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'replayed' ELSE 'stored' END AS state FROM s GROUP BY record_id")
def record_conflicts(spark, d):
    return store.settled(submissions(spark, d))


@query("terminal_outcomes", f"""WITH {_SUB}, c AS (SELECT user_id, record_id, count(DISTINCT body) > 1 AS conflict, bool_or(event_type = 'error') AS invalid, max(event_type) AS declared FROM s GROUP BY ALL)
 SELECT user_id, CASE WHEN bool_or(conflict) THEN 'record-conflict' WHEN bool_or(invalid) THEN 'invalid-record' ELSE max(declared) END AS terminal FROM c GROUP BY user_id""")
def terminal_outcomes(spark, d):
    s = submissions(spark, d)
    flags = s.groupBy("user_id", "record_id").agg((F.count_distinct("body") > 1).alias("conflict"), F.bool_or(F.col("event_type") == "error").alias("invalid"), F.max("event_type").alias("declared"))
    return store.terminal(flags, "user_id")


@query("schema_rejects", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'unknown:extra' WHEN event_type = 'view' THEN 'missing:k' WHEN NOT regexp_matches(CAST(value AS VARCHAR), '^-?(0|[1-9][0-9]{0,15})$') AND event_type = 'signup' THEN 'type:k' END AS issue FROM events WHERE event_type IN ('click', 'view', 'signup') AND NOT (event_type = 'signup' AND regexp_matches(CAST(value AS VARCHAR), '^-?(0|[1-9][0-9]{0,15})$'))""")
def schema_rejects(spark, d):
    """Events as maps of raw values against the closed schema {k: integer}: some have a key too many, none, or a fraction."""
    e = table(spark, d, "events")
    fields = F.when(F.col("event_type") == "click", F.create_map(F.lit("k"), F.lit("1"), F.lit("extra"), F.lit("1"))).when(F.col("event_type") == "view", F.create_map(F.lit("other"), F.lit("1"))).when(F.col("event_type") == "signup", F.create_map(F.lit("k"), F.col("value").cast("string"))).otherwise(F.create_map(F.lit("k"), F.get_json_object("props", "$.k")))
    fields = F.when(F.col("event_type") == "view", F.map_filter(fields, lambda k, _: k == "k")).otherwise(fields)
    return e.select("event_id", store.first_issue(fields, {"k": ("integer", True)}).alias("issue")).filter("issue is not null")


@query("canonical_order", "SELECT o_orderkey, o_custkey FROM (SELECT *, lag(o_custkey) OVER (ORDER BY o_orderkey) AS b FROM orders) WHERE b >= o_custkey")
def canonical_order(spark, d):
    return store.out_of_order(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", 1000)


@query("repeated_keys", "SELECT o_custkey, count(*) AS times FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, d):
    return store.repeated(table(spark, d, "orders"), "o_custkey")


@query("ownership_gate", " SELECT record_id FROM records WHERE (check_id, code_area) NOT IN (SELECT ('file-metrics', 'english'))", True)
def ownership_gate(spark, d):
    r = file_records(spark, d)
    catalog = spark.range(1).select(F.lit("file-metrics").alias("check_id"), F.lit("english").alias("code_area"))
    return store.orphans(r, catalog, ["check_id", "code_area"]).select("record_id")


# --- references -------------------------------------------------------------------------------------------------------------------

_EV = """req AS (SELECT DISTINCT r_name AS check_id, n_name AS reference_name FROM region CROSS JOIN nation),
sub AS (SELECT DISTINCT r_name AS check_id, n_name AS reference_name, CASE WHEN n_nationkey > 12 THEN 'complete' ELSE 'incomplete' END AS status FROM region JOIN nation ON r_regionkey = n_regionkey)"""


def _evidence(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    required = r.crossJoin(F.broadcast(n)).select(F.col("r_name").alias("check_id"), F.col("n_name").alias("reference_name"))  # a fixed catalog of pairs
    sub = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("check_id"), F.col("n_name").alias("reference_name"), F.when(F.col("n_nationkey") > 12, "complete").otherwise("incomplete").alias("status"))
    return required, sub


@query("required_evidence", f"WITH {_EV} SELECT check_id, reference_name, coalesce(status, 'unavailable') AS status FROM req LEFT JOIN sub USING (check_id, reference_name)")
def required_evidence(spark, d):
    return references.required_evidence(*_evidence(spark, d))


_REL = """rel AS (SELECT c_custkey AS record_id, r_name AS check_id, n_name AS reference_name, c_mktsegment AS relation_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def _relations(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.select(F.col("c_custkey").alias("record_id"), F.col("r_name").alias("check_id"), F.col("n_name").alias("reference_name"), F.col("c_mktsegment").alias("relation_id"))


@query("required_relations", f"WITH {_EV}, {_REL} SELECT * FROM rel SEMI JOIN (SELECT * FROM sub WHERE status = 'complete') USING (check_id, reference_name)")
def required_relations(spark, d):
    return references.required_relations(_relations(spark, d), _evidence(spark, d)[1].filter("status = 'complete'"))


@query("relation_resolution", f"""WITH {_REL}, k AS (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3 OR c_acctbal > 0)
 SELECT * FROM rel WHERE check_id NOT IN (SELECT check_id FROM rel r WHERE r.record_id NOT IN (SELECT c_custkey FROM k))""")
def relation_resolution(spark, d):
    """Of the last two regions customers in debt aren't records, which voids the submissions of these regions' checks."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    kept = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).filter("n_regionkey < 3 or c_acctbal > 0")
    return references.resolved(_relations(spark, d), kept.select(F.col("c_custkey").alias("record_id")))


@query("relation_constraints", f"WITH {_EV}, {_REL}, r2 AS (SELECT * FROM rel UNION ALL SELECT record_id, check_id, reference_name, 'twice' FROM rel WHERE relation_id = 'BUILDING') SELECT DISTINCT record_id, reference_name, 'incomplete-evidence' AS issue FROM r2 LEFT JOIN sub USING (check_id, reference_name) WHERE coalesce(status, 'unavailable') <> 'complete' UNION SELECT record_id, reference_name, 'several-relations' FROM r2 GROUP BY ALL HAVING count(*) > 1")
def relation_constraints(spark, d):
    r = _relations(spark, d)
    return references.violations(r.union(r.filter("relation_id = 'BUILDING'").withColumn("relation_id", F.lit("twice"))), _evidence(spark, d)[1])


# --- policy -------------------------------------------------------------------------------------------------------------------------

_SEL = [("file-metrics", "file-code-lines")]
RULES = [
    {"acceptance_id": "watchlist", "check_id": "file-metrics", "record_type_id": "file-code-lines", "reason": "watched", "predicates": [policy.operand_equals("level", "info")]},
    {"acceptance_id": "short", "check_id": "file-metrics", "record_type_id": "file-code-lines", "reason": "short", "predicates": [policy.operand_includes("message", "has 8 code")]},
]
_ACC = "acc AS (SELECT record_id, 'watchlist' AS acceptance_id, 'watched' AS reason FROM records WHERE level = 'info' UNION ALL SELECT record_id, 'short', 'short' FROM records WHERE contains(message, 'has 8 code'))"
_VIEWS = f"""{_ACC}, views AS (SELECT 'all-current' AS view_id, record_id FROM records UNION ALL SELECT 'accepted', record_id FROM records SEMI JOIN acc USING (record_id)
 UNION ALL SELECT 'open', record_id FROM records ANTI JOIN acc USING (record_id) UNION ALL SELECT 'regressed', record_id FROM records WHERE record_id IN (SELECT record_id FROM relations WHERE relation_id = 'regression'))"""


def _observed(spark, d):
    """One pass over the records gives each its acceptances and views."""
    declared = [
        {"view_id": "all-current", "selectors": _SEL}, {"view_id": "accepted", "selectors": _SEL, "acceptance": "accepted"}, {"view_id": "open", "selectors": _SEL, "acceptance": "unaccepted"},
        {"view_id": "regressed", "selectors": _SEL, "predicates": [policy.relation_is("base", "regression")]},
    ]
    return policy.observed(file_records(spark, d), RULES, declared, relations(spark, d))


@query("acceptance", f", {_ACC} SELECT * FROM acc", True)
def acceptance(spark, d):
    return policy.acceptance(policy.observed(file_records(spark, d), RULES, []))


@query("views", f", {_VIEWS} SELECT * FROM views", True)
def views(spark, d):
    return policy.views(_observed(spark, d))


@query("view_sizes", f", {_VIEWS}, v AS (SELECT unnest(['all-current', 'accepted', 'open', 'regressed', 'never']) AS view_id) SELECT view_id, count(record_id) AS records FROM v LEFT JOIN views USING (view_id) GROUP BY 1", True)
def view_sizes(spark, d):
    return policy.view_sizes(_observed(spark, d), ["all-current", "accepted", "open", "regressed", "never"])


@query("relation_views", " SELECT record_id, value FROM records WHERE record_id IN (SELECT record_id FROM relations WHERE relation_id IN ('changed', 'regression'))", True)
def relation_views(spark, d):
    rows = policy.related(file_records(spark, d), relations(spark, d))
    return policy.select(rows, _SEL, [policy.relation_kind_in("base", ["changed", "regression"])]).select("record_id", "value")


@query("operand_views", " SELECT record_id FROM records WHERE value = 7 AND contains(semantic_subject, 'src1')", True)
def operand_views(spark, d):
    return policy.select(file_records(spark, d), _SEL, [policy.operand_equals("value", 7), policy.operand_includes("semantic_subject", "src1")]).select("record_id")


def _readiness(spark, d):
    """Clauses over the regions in order: each asks that its nations have customers in debt; the last asks for more than there are."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    g = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").cast("long").alias("ordinal")).agg(F.count_if(F.col("c_acctbal") < 0).alias("debt"), F.count("*").alias("n"))
    return policy.readiness(g.select("ordinal", F.concat(F.lit("region-"), "ordinal").alias("readiness_id"), (F.col("debt") * 100 > F.col("n") * 8 + F.col("ordinal") * 0).alias("ok")))


_READY = """rd AS (SELECT n_regionkey AS ordinal, 'region-' || n_regionkey AS readiness_id, count(*) FILTER (c_acctbal < 0) * 100 > count(*) * 8 AS ok FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey),
 ready AS (SELECT ordinal, readiness_id, CASE WHEN ok THEN 'passed' ELSE 'failed' END AS state FROM (
  SELECT *, coalesce(min(CAST(ok AS INT)) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM rd) WHERE before = 1)"""


@query("readiness", f"WITH {_READY} SELECT CAST(ordinal AS BIGINT) AS ordinal, readiness_id, state FROM ready")
def readiness(spark, d):
    return _readiness(spark, d)


@query("block_when", f", {_VIEWS} SELECT count(*) > 0 AS matched, count(*) AS blocking FROM views WHERE view_id = 'regressed'", True)
def block_when(spark, d):
    return policy.view_sizes(_observed(spark, d), ["regressed"]).select((F.col("records") > 0).alias("matched"), F.col("records").alias("blocking"))


@query("gate", f", {_VIEWS}, {_READY} SELECT CASE WHEN (SELECT count(*) FROM ready WHERE state = 'failed') > 0 THEN 'not-evaluated' WHEN (SELECT count(*) FROM views WHERE view_id = 'regressed') > 0 THEN 'failed' ELSE 'passed' END AS gate, (SELECT min_by(readiness_id, ordinal) FROM ready WHERE state = 'failed') AS reason", True)
def gate(spark, d):
    return policy.gate(_readiness(spark, d), block_when(spark, d))


@query("evidence_order", "WITH e AS (SELECT DISTINCT 'record' AS kind, c_mktsegment AS id FROM customer UNION SELECT 'check', r_name FROM region UNION SELECT 'view', o_orderpriority FROM orders UNION SELECT 'reference', n_name FROM nation) SELECT kind, id, row_number() OVER (ORDER BY CASE kind WHEN 'check' THEN 1 WHEN 'record' THEN 2 WHEN 'reference' THEN 3 ELSE 4 END, id) AS position FROM e")
def evidence_order(spark, d):
    parts = [("record", table(spark, d, "customer").select("c_mktsegment")), ("check", table(spark, d, "region").select("r_name")), ("view", table(spark, d, "orders").select("o_orderpriority")), ("reference", table(spark, d, "nation").select("n_name"))]
    out = [p.toDF("id").distinct().select(F.lit(k).alias("kind"), "id") for k, p in parts]
    return policy.evidence_order(out[0].union(out[1]).union(out[2]).union(out[3]))


# --- status and readable -----------------------------------------------------------------------------------------------------------

_OUT = "o AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'not-applicable' ELSE 'unavailable' END AS status, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 200000 THEN 'failed' ELSE 'passed' END END AS verdict FROM orders)"


def _outcomes(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "not-applicable").otherwise("unavailable")
    return table(spark, d, "orders").select("o_custkey", s.alias("status"), F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_totalprice") > 200000, "failed").otherwise("passed")).alias("verdict"))


@query("normal_status", f"WITH {_OUT} SELECT CASE WHEN bool_or(status = 'unavailable') THEN 'failed' WHEN NOT bool_or(status = 'completed') THEN 'warning' WHEN bool_or(verdict = 'failed') THEN 'warning' ELSE 'passed' END AS status FROM o")
def normal_status(spark, d):
    return policy.status(_outcomes(spark, d))


_OPEN = "(SELECT count(*) FROM records WHERE record_id NOT IN (SELECT record_id FROM acc))"


@query("verification_status", f""", {_ACC}, {_OUT}, n AS (SELECT bool_or(status = 'unavailable') AS gone, bool_or(status = 'completed') AS done,
  coalesce(bool_or(status = 'completed' AND verdict = 'failed'), false) AS bad FROM o)
 SELECT CASE WHEN gone THEN 'failed' WHEN done AND {_OPEN} = 0 THEN 'passed' WHEN NOT done OR bad THEN 'warning' ELSE 'passed' END AS status FROM n""", True)
def verification_status(spark, d):
    rows = _observed(spark, d)
    return policy.verification(_outcomes(spark, d), rows.filter(F.array_contains("views", "all-current")), policy.acceptance(rows))


@query("verification_of_completed", f""", {_ACC}, {_OUT}, n AS (SELECT o_custkey % 2 AS half, bool_or(status = 'completed' AND verdict = 'failed') AS bad FROM o WHERE status <> 'unavailable' GROUP BY 1)
 SELECT CASE WHEN {_OPEN} = 0 THEN 'passed' WHEN bad THEN 'warning' ELSE 'passed' END AS status FROM n WHERE half = 0""", True)
def verification_of_completed(spark, d):
    """Of the customers of even number, without the checks that weren't available."""
    rows, outcomes = _observed(spark, d), _outcomes(spark, d).filter("status <> 'unavailable' and o_custkey % 2 = 0")
    return policy.verification(outcomes, rows.filter(F.array_contains("views", "all-current")), policy.acceptance(rows))


@query("record_split", f""", {_ACC} SELECT r.record_id, CASE WHEN count(acceptance_id) = 0 THEN 'warning' ELSE 'accepted' END AS section,
  coalesce(string_agg(acceptance_id, ',' ORDER BY acceptance_id), '') AS acceptance_ids FROM records r LEFT JOIN acc USING (record_id) GROUP BY 1""", True)
def record_split(spark, d):
    rows = _observed(spark, d)
    out = policy.split(rows, rows.filter(F.array_contains("views", "all-current")), policy.acceptance(rows))
    return out.select("record_id", "section", F.coalesce(F.array_join("acceptance_ids", ","), F.lit("")).alias("acceptance_ids"))


@query("watchlist", " SELECT record_id, semantic_subject, value FROM records WHERE semantic_subject IN (SELECT path FROM changed) ORDER BY value DESC, record_id LIMIT 50", True)
def watchlist(spark, d):
    """A report of 50 rows: changed files, by exact path, that have a record."""
    return file_records(spark, d).join(tables.changed(spark, d).withColumnRenamed("path", "semantic_subject"), "semantic_subject", "left_semi").orderBy(F.desc("value"), "record_id").limit(50).select("record_id", "semantic_subject", "value")


@query("record_preview_page", " SELECT record_id, message, (SELECT count(*) FROM records) AS total FROM records ORDER BY record_id LIMIT 5 OFFSET 10", True)
def record_preview_page(spark, d):
    """A page of the report's preview."""
    return evidence.page(file_records(spark, d).select("record_id", "message"), ["record_id"], 10, 5)


@query("annotations", """ SELECT record_id, '::warning file=' || path || ',line=1,title=file-code-lines::' || message AS line
 FROM (SELECT * FROM records WHERE level <> 'info' ORDER BY record_id LIMIT 5)""", True)
def annotations(spark, d):
    """The first five CI annotations, the feature's own limit."""
    return evidence.annotations(file_records(spark, d))


@query("text_functions", """SELECT event_id, replace(replace(props, ':', '%3A'), ',', '%2C') AS escaped, CASE WHEN ms < 1000 THEN CAST(CAST(floor(ms + 0.5) AS BIGINT) AS VARCHAR) || 'ms'
  WHEN ms < 10000 THEN printf('%.1fs', floor(ms / 1000 * 10 + 0.5) / 10) WHEN ms < 60000 THEN CAST(CAST(floor(ms / 1000 + 0.5) AS BIGINT) AS VARCHAR) || 's'
  ELSE CAST(CAST(floor(ms / 1000 / 60) AS BIGINT) AS VARCHAR) || 'm ' || lpad(CAST(CAST(floor((ms / 1000) % 60 + 0.5) AS BIGINT) AS VARCHAR), 2, '0') || 's' END AS took,
  strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') || ' GMT+09:00 (Asia/Tokyo; source ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z)' AS tokyo
 FROM (SELECT *, CAST(value AS DOUBLE) * 100 AS ms FROM events)""")
def text_functions(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", X.escape_property(F.col("props")).alias("escaped"), X.duration(F.col("value") * 100).alias("took"), X.in_zone(F.col("ts"), "Asia/Tokyo").alias("tokyo"))


# --- graph --------------------------------------------------------------------------------------------------------------------------

_EDGES = "edges AS (SELECT a.n_name AS task, b.n_name AS needs FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey < a.n_nationkey)"


def _edges(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("b.n_nationkey") < F.col("a.n_nationkey"))).select(F.col("a.n_name").alias("task"), F.col("b.n_name").alias("needs"))


@query("dependency_closure", f"WITH RECURSIVE {_EDGES}, c AS (SELECT task, needs FROM edges UNION SELECT c.task, e.needs FROM c JOIN edges e ON e.task = c.needs) SELECT DISTINCT task, needs FROM c")
def dependency_closure(spark, d):
    return graph.closure(_edges(spark, d))


@query("cycle_check", f"WITH RECURSIVE {_EDGES}, e2 AS (SELECT * FROM edges UNION SELECT min(n_name), max(n_name) FROM nation GROUP BY n_regionkey UNION SELECT max(n_name), min(n_name) FROM nation GROUP BY n_regionkey), c AS (SELECT task, needs FROM e2 UNION SELECT c.task, e.needs FROM c JOIN e2 e ON e.task = c.needs) SELECT DISTINCT task FROM c WHERE task = needs")
def cycle_check(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.min("n_name").alias("a"), F.max("n_name").alias("b"))
    return graph.on_cycles(_edges(spark, d).union(n.select("a", "b")).union(n.select("b", "a")))


@query("blocked_tasks", f"WITH RECURSIVE {_EDGES}, f AS (SELECT n_name AS task FROM nation WHERE n_nationkey IN (SELECT min(n_nationkey) FROM nation GROUP BY n_regionkey)), c AS (SELECT task, needs FROM edges UNION SELECT c.task, e.needs FROM c JOIN edges e ON e.task = c.needs) SELECT task, string_agg(DISTINCT needs, ',' ORDER BY needs) AS blockers FROM c WHERE needs IN (SELECT task FROM f) AND task NOT IN (SELECT task FROM f) GROUP BY task")
def blocked_tasks(spark, d):
    failed = table(spark, d, "nation").groupBy("n_regionkey").agg(F.min_by("n_name", "n_nationkey").alias("task"))
    return graph.blocked(_edges(spark, d), failed).select("task", F.array_join("blockers", ",").alias("blockers"))


@query("unknown_dependencies", f"WITH {_EDGES} SELECT DISTINCT task, needs FROM edges WHERE needs NOT IN (SELECT n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA')")
def unknown_dependencies(spark, d):
    known = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).filter("r_name <> 'ASIA'")
    return graph.unknown_dependencies(_edges(spark, d), known.select(F.col("n_name").alias("task")))


@query("group_expansion", "SELECT DISTINCT a.n_name AS task, b.n_name AS needs FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey WHERE a.n_name <> b.n_name")
def group_expansion(spark, d):
    n = table(spark, d, "nation")
    needs = n.select(F.col("n_name").alias("task"), F.concat(F.lit("region-"), "n_regionkey").alias("needs"))
    return graph.expanded(needs, n.select(F.concat(F.lit("region-"), "n_regionkey").alias("group"), F.col("n_name").alias("member")))


# --- publication and evidence ----------------------------------------------------------------------------------------------------------


@query("publication_rows", """ SELECT record_id, '{"check_id":"' || check_id || '","level":"' || level || '","message":"' || message || '","record_id":"' || record_id || '","value":' || value || '}' AS row FROM records""", True)
def publication_rows(spark, d):
    r = file_records(spark, d).select("record_id", "check_id", "level", "message", "value")
    return r.select("record_id", publication.row_json(r).alias("row"))


@query("set_invariants", " SELECT 'unknown-type' AS issue, record_id AS id FROM records WHERE code_area = 'german' UNION SELECT 'dangling-relation', path FROM changed", True)
def set_invariants(spark, d):
    """A set with a type that the catalog lacks and relations of records that don't exist."""
    r = file_records(spark, d).withColumn("record_type_id", F.when(F.col("code_area") == "german", "old-type").otherwise(F.col("record_type_id")))
    catalog = spark.range(1).select(F.lit("file-metrics").alias("check_id"), F.lit("file-code-lines").alias("record_type_id"))
    return publication.problems(r, catalog, tables.changed(spark, d).withColumnRenamed("path", "record_id"))


@query("entity_closure", "WITH a AS (SELECT doc_id, count(*) AS s FROM documents GROUP BY 1), b AS (SELECT doc_id, count(*) AS r FROM labels GROUP BY 1) SELECT doc_id, CASE WHEN coalesce(s, 0) > 1 OR coalesce(r, 0) > 1 THEN 'duplicate' WHEN r IS NULL THEN 'static-only' WHEN s IS NULL THEN 'runtime-only' ELSE 'matched' END AS state FROM a FULL JOIN b USING (doc_id)")
def entity_closure(spark, d):
    return evidence.entity_closure(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id")


@query("coverage", "SELECT o_custkey AS c_custkey, 'unknown-reference' AS issue FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION SELECT c_custkey, 'uncovered' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def coverage(spark, d):
    return evidence.coverage(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query("topic_counts", "SELECT n_nationkey, count(s_suppkey) AS cases FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def topic_counts(spark, d):
    """Zero counts stay: a topic without cases is an error of the catalog."""
    return table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("cases"))


@query("topic_reconciliation", "SELECT CAST(n_nationkey AS BIGINT) AS ordinal, coalesce(n_nationkey, s_nationkey) AS k, CASE WHEN s_nationkey IS NULL THEN 'missing-file' ELSE 'unknown-topic' END AS issue FROM (SELECT * FROM nation WHERE n_regionkey < 3) n FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 0) s ON s_nationkey = n_nationkey WHERE n_nationkey IS NULL OR s_nationkey IS NULL")
def topic_reconciliation(spark, d):
    topics = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("long").alias("ordinal"))
    return evidence.reconciled(topics, table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("k")), "k")


@query("pattern_counts", "SELECT 'digits' AS pattern, count(*) FILTER (regexp_matches(text, '[0-9]{3}')) AS matches FROM documents UNION ALL SELECT 'none', count(*) FILTER (regexp_matches(text, 'never written')) FROM documents UNION ALL SELECT 'shout', count(*) FILTER (regexp_matches(text, '!!')) FROM documents")
def pattern_counts(spark, d):
    return evidence.pattern_counts(table(spark, d, "documents"), "text", {"digits": "[0-9]{3}", "none": "never written", "shout": "!!"})


@query("exit_code", """SELECT c_nationkey, CASE WHEN bool_or(b AND o IN ('profile', 'static')) THEN 3 WHEN bool_or(b AND o = 'runner') THEN 4 WHEN bool_or(b AND o = 'case') THEN 5 ELSE 6 END AS exit_code
 FROM (SELECT c_nationkey, c_acctbal < -990 AS b, CASE c_mktsegment WHEN 'BUILDING' THEN 'profile' WHEN 'MACHINERY' THEN 'static' WHEN 'FURNITURE' THEN 'runner' WHEN 'HOUSEHOLD' THEN 'case' ELSE 'other' END AS o FROM customer) GROUP BY 1""")
def exit_code(spark, d):
    """One run a nation."""
    o = F.when(F.col("c_mktsegment") == "BUILDING", "profile").when(F.col("c_mktsegment") == "MACHINERY", "static").when(F.col("c_mktsegment") == "FURNITURE", "runner").when(F.col("c_mktsegment") == "HOUSEHOLD", "case").otherwise("other")
    return policy.exit_code(table(spark, d, "customer").select("c_nationkey", o.alias("origin"), (F.col("c_acctbal") < -990).alias("blocking")), "c_nationkey")


@query("report_groups", "SELECT user_id, min(ts) AS start, max(ts) AS \"end\", bool_and(event_type <> 'error') AS ok, max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) AS severity, min_by(CASE WHEN event_type = 'error' THEN event_id END, ts) FILTER (event_type = 'error') AS first_error FROM events GROUP BY 1")
def report_groups(spark, d):
    e = table(spark, d, "events")
    rows = e.select("user_id", F.col("ts").alias("start"), F.col("ts").alias("end"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0).alias("severity"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("error"))
    return evidence.report_groups(rows, "user_id")


#: Documents as Markdown: odd lines as headings of one to six marks; of every third document the lines from the third on are front matter or fenced.
_MARKDOWN = """md AS (SELECT doc_id, doc_id % 3 AS kind, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM m0 WHERE text IS NOT NULL),
 h AS (SELECT doc_id AS doc, kind, i, trim(line, ' ') AS heading FROM md WHERE i % 2 = 1 AND trim(line, ' ') <> '' AND NOT (kind > 0 AND i > 2)),
 x AS (SELECT *, regexp_replace(regexp_replace(lower(heading), '[^\\p{L}\\p{M}\\p{N}\\s_-]', '', 'g'), '\\s', '-', 'g') AS base FROM h)"""


@query("heading_anchors", f""", {_MARKDOWN} SELECT doc, heading, base || CASE WHEN nth > 0 THEN '-' || nth ELSE '' END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc, base ORDER BY i) - 1 AS nth FROM x)""", True)
def heading_anchors(spark, d):
    """Whole documents: each odd line that isn't blank is a heading, behind front matter, or in two kinds of documents from the third line on
    behind a fence that no line closes. The other lines are indented, so that none of them is a heading, a fence or front matter."""
    mark = lambda i: F.concat(F.repeat(F.lit("#"), (i % 6 + 1).cast("int")), F.lit(" "))
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.when((i % 2 == 0) & (F.trim(s) != ""), F.concat(mark(i), F.trim(s), F.lit(" ##"))).otherwise(F.concat(F.lit("    "), s)))
    kind = F.col("doc_id") % 3
    cut = lambda mark: F.concat(F.slice(lines, 1, 2), F.array(F.lit(mark)), F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))))
    body = F.when(kind <= 0, F.concat(F.array(F.lit("---"), F.lit("# hidden"), F.lit("...")), lines)).when(kind == 1, cut("```text")).otherwise(cut("~~~~"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.array_join(body, "\n").alias("content"))
    return evidence.heading_anchors(evidence.headings(docs)).select("doc", "heading", "anchor")


@query("link_targets", "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS target FROM pages) SELECT page_id, target, count(*) AS links FROM l WHERE target NOT IN (SELECT lang FROM documents) GROUP BY ALL")
def link_targets(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("target"))
    return p.join(table(spark, d, "documents").select(F.col("lang").alias("target")).distinct(), "target", "left_anti").groupBy("page_id", "target").agg(F.count("*").alias("links"))


@query("text_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a1') OR contains(lower(p_brand), 'a1') OR contains(lower(p_type), 'steel')")
def text_search(spark, d):
    p = table(spark, d, "part")
    return p.filter(X.mentions(F.array("p_name", "p_brand"), "A1") | X.mentions(F.array("p_type"), "STEEL")).select("p_partkey")


@query("full_run", " SELECT record_id, check_id, level, message, path, line FROM records", True)
def full_run(spark, d):
    """The public API over the file table: define, run, and take the records."""
    from sievemark.plans.definition import define_config, file_metrics, run

    check = file_metrics(FLOOR, ALLOWANCE, FEW_TOKENS, options={"areas": AREAS})
    return run(spark, define_config([check]), {"files": tables.measured(spark, d)}).records.select("record_id", "check_id", "level", "message", "path", "line")


#: Acceptance by level, a view by relation, one of all, readiness by all four kinds of clause, and a block on the regressed.
COMPARED = {
    "references": [{"reference_name": "base", "check_ids": ["file-metrics", "function-metrics"]}],
    "acceptance": [{"acceptance_id": f"watched-{t}", "reason": "watched", "check_id": c, "record_type_id": t, "predicates": [{"kind": "operand-equals", "operand": "level", "value": "info"}]} for c, t in [("file-metrics", "file-code-lines"), ("function-metrics", "function-code-lines")]],
    "views": [
        {"view_id": "open", "selectors": [("file-metrics", "file-code-lines"), ("function-metrics", "function-code-lines")], "acceptance": "unaccepted"},
        {"view_id": "regressed", "selectors": [("file-metrics", "file-code-lines"), ("function-metrics", "function-code-lines")], "acceptance": "unaccepted", "predicates": [{"kind": "relation-is", "reference_name": "base", "relation_id": "regression"}]},
        {"view_id": "src1", "selectors": [("file-metrics", "file-code-lines")], "predicates": [{"kind": "operand-includes", "operand": "location-path", "value": "/src1/"}, {"kind": "operand-equals", "operand": "value", "value": 7}]},
        {"view_id": "impossible", "selectors": [("file-metrics", "file-code-lines")], "predicates": [{"kind": "operand-equals", "operand": "value", "value": -1}]},
    ],
    "readiness": [
        {"readiness_id": "files-ran", "kind": "check-outcome", "check_id": "file-metrics", "outcome": "completed"},
        {"readiness_id": "files-found", "kind": "check-verdict", "check_id": "file-metrics", "verdict": "failed"},
        {"readiness_id": "files-compared", "kind": "reference-status", "check_id": "file-metrics", "reference_name": "base", "status": "complete"},
        {"readiness_id": "nothing-odd", "kind": "view-empty", "view_id": "impossible"},
    ],
    "block_when": {"kind": "view-not-empty", "view_id": "regressed"},
}


def _compared(spark, d, **policy_parts):
    from sievemark.plans.definition import Comparison, define_config, file_metrics, function_metrics, run

    own = [file_metrics(FLOOR, ALLOWANCE, FEW_TOKENS, DELTA, options={"areas": AREAS}), function_metrics(2, options={"areas": FUNCTION_AREAS} | _FLIMITS)]
    f, changed = _function_scope(spark, d)
    base = {"files": tables.baseline(spark, d).withColumnRenamed("value", "code_lines"), "functions": f.filter("name <> 'assistant' or params < 3")}
    touched = tables.changed(spark, d).union(changed.toDF("path"))
    now = {"files": tables.measured(spark, d), "functions": f}
    return run(spark, define_config(own, COMPARED | policy_parts), now, changed=touched, comparison=Comparison("base", "revision-1", base))


_CONVCHANGED = "cc AS (SELECT file FROM fn0 GROUP BY file HAVING count(*) > 4), ct AS (SELECT DISTINCT f.file FROM fn0 f JOIN cc ON contains(f.file, cc.file) OR contains(cc.file, f.file))"
_COMPARED = _INSTANCES + f""", {_CONVCHANGED},
 fw AS (SELECT file, name, count(*) AS n, any_value(lines) AS lines, any_value(ccn) AS ccn, any_value(params) AS params FROM fn0 WHERE name <> 'assistant' OR params < 3 GROUP BY ALL),
 frel AS (SELECT record_id, 'function-metrics' AS check_id, 'base' AS reference_name, CASE WHEN group_size <> 1 OR coalesce(n, 0) > 1 OR (n IS NOT NULL AND was IS NULL) THEN 'changed'
   WHEN value - coalesce(was, 0) > 2 THEN 'regression' ELSE 'changed' END AS relation_id FROM (
  SELECT r.*, n, CASE record_type_id WHEN 'function-code-lines' THEN w.lines WHEN 'function-cyclomatic-complexity' THEN w.ccn ELSE w.params END AS was
  FROM frecords r SEMI JOIN ct ON ct.file = r.file LEFT JOIN fw w ON w.file = r.file AND w.name = r.name)),
 allrel AS (SELECT record_id, check_id, reference_name, relation_id FROM relations UNION ALL SELECT * FROM frel),
 allrec AS (SELECT record_id, check_id, record_type_id, level, semantic_subject, message, code_area, metric, value, path, CAST(line AS BIGINT) AS line FROM records
  UNION ALL SELECT record_id, 'function-metrics', record_type_id, level, semantic_subject, message, code_area, metric, value, file, start_line FROM frecords),
 vw AS (SELECT r.record_id, (level <> 'info' AND record_type_id IN ('file-code-lines', 'function-code-lines')) AS open,
   (level <> 'info' AND record_type_id IN ('file-code-lines', 'function-code-lines') AND r.record_id IN (SELECT record_id FROM allrel WHERE relation_id = 'regression')) AS regressed,
   (record_type_id = 'file-code-lines' AND contains(path, '/src1/') AND value = 7) AS src1 FROM allrec r)"""


@query("full_run_compared", _COMPARED + " SELECT r.*, relation_id FROM allrec r LEFT JOIN allrel USING (record_id)", True)
def full_run_compared(spark, d):
    """The public API over files and functions, compared with a reference: every record with all its fields and its relation."""
    got = _compared(spark, d)
    field = lambda n: F.get_json_object("fields", f"$.{n}")
    rows = got.records.select("record_id", "check_id", "record_type_id", "level", "semantic_subject", "message", field("codeArea").alias("code_area"), field("metric").alias("metric"), field("value").cast("long").alias("value"), "path", "line")
    return rows.join(got.relations.select("record_id", "relation_id"), "record_id", "left")


@query("decision_views", _COMPARED + """ SELECT 'open' AS view_id, record_id FROM vw WHERE open UNION ALL SELECT 'regressed', record_id FROM vw WHERE regressed UNION ALL SELECT 'src1', record_id FROM vw WHERE src1""", True)
def decision_views(spark, d):
    return _compared(spark, d).views.select("view_id", "record_id")


@query("decision_gate", _COMPARED + """, n AS (SELECT count(*) FILTER (regressed) AS k FROM vw)
 SELECT 'files-ran,files-found,files-compared,nothing-odd' AS passed, CASE WHEN k > 0 THEN 'matched' ELSE 'not-matched' END AS block, CASE WHEN k > 0 THEN 'failed' ELSE 'passed' END AS gate FROM n""", True)
def decision_gate(spark, d):
    """Readiness by all four kinds of clause, then the block on a view, then the gate."""
    got = _compared(spark, d)
    passed = got.readiness.filter("state = 'passed'").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "readiness_id"))), lambda r: r["readiness_id"]), ",").alias("passed"))
    return passed.crossJoin(got.block.select(F.col("status").alias("block"))).crossJoin(got.gate.select("gate"))  # one row each


@query("decision_not_ready", "SELECT * FROM (VALUES (0, 'functions-compared', 'passed'), (1, 'none-open', 'failed')) t(ordinal, readiness_id, state)")
def decision_not_ready(spark, d):
    """The second clause fails, so the third is never evaluated."""
    ready = [
        {"readiness_id": "functions-compared", "kind": "reference-status", "check_id": "function-metrics", "reference_name": "base", "status": "complete"},
        {"readiness_id": "none-open", "kind": "view-empty", "view_id": "open"}, {"readiness_id": "files-ran", "kind": "check-outcome", "check_id": "file-metrics", "outcome": "completed"},
    ]
    return _compared(spark, d, readiness=ready).readiness


@query("decision_evidence", _COMPARED + """, e AS (SELECT 'gate' AS owner, 'check' AS kind, 'file-metrics' AS id UNION SELECT 'gate', 'view', 'regressed' UNION SELECT 'gate', 'view', 'impossible'
  UNION SELECT 'gate', 'reference', 'file-metrics/base/reference/v1/sha256:' || sha256('revision-1') UNION SELECT 'gate', 'readiness', unnest(['files-ran', 'files-found', 'files-compared', 'nothing-odd'])
  UNION SELECT 'gate', 'record', record_id FROM vw WHERE regressed)
 SELECT kind, id, row_number() OVER (ORDER BY CASE kind WHEN 'check' THEN 1 WHEN 'record' THEN 2 WHEN 'reference' THEN 3 WHEN 'view' THEN 4 ELSE 5 END, id) AS position FROM e""", True)
def decision_evidence(spark, d):
    """What the gate rests on, in canonical order: checks, records, references, views, readiness clauses."""
    return policy.evidence_order(_compared(spark, d).evidence.filter("owner = 'gate'"))
