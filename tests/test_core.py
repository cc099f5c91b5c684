"""The engine's rules on small rows, golden identities, and every registered query against its SQL."""

from __future__ import annotations

import hashlib
import json
import random
import re
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from sievemark import define_check, define_config, duplicate_detection, file_metrics, function_metrics, inherit, run
from sievemark.functions import canonical as C
from sievemark.functions import globs, text
from sievemark.operators import checks, evidence, graph, policy, references, scope, store
from sievemark.operators.measure import measured_files
from sievemark.plans import queries as Q
from sievemark.plans.definition import Comparison, DefinitionError, RecordType, Result, resolve
from sievemark.plans.scheduler import Scheduler, Task, pooled
from sievemark.sources import decoders, publication
from sievemark.streaming import submissions

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("glob,yes,no", [
    ("**/*.ts", ["a.ts", "a/b.ts", "a/b/c.ts"], ["a.tsx", ".h/a.ts", "a/.b.ts"]), ("src/*", ["src/a"], ["src/a/b", "src/", "src/.a"]), ("src/**", ["src/a", "src/a/b"], ["src", "srcx/a", "src/.x"]),
    ("*.{js,ts}", ["a.js", "a.ts"], ["a.j"]), ("a?c", ["abc"], ["ac", "a/c"]), ("[a-c]x", ["bx"], ["dx"]), ("[!a]x", ["bx"], ["ax"]), ("!a/*", ["b/c", "a"], ["a/b"]), ("#x", [], ["#x"]), (".*", [".a"], ["a"]), ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["a/xb"]), ("{a,b{c,d}}", ["a", "bc", "bd"], ["b"]), ("a.b", ["a.b"], ["axb"]),
])
def test_globs(spark, glob, yes, no):
    rows = spark.createDataFrame([(p, p in yes) for p in yes + no], "p string, want boolean")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", globs.matches(F.col("p"), [glob])).collect())


def test_golden_identities(spark):
    one = spark.range(1)
    published = C.record_id(F.lit("docs-example"), F.lit("example-finding"), {"category": F.lit("maintainability"), "value": F.lit(7)}, C.subject(F.lit("src/example.ts#canonical")))
    unit = C.record_id(F.lit("file-metrics"), F.lit("line-budget"), {"codeArea": F.lit("source")}, C.subject(F.lit("cafe\u0301")))
    a, b = one.select(published, unit).first()
    assert a.endswith("1925271c3cf35975961ab888092c9523ca1452c21c5aaf82b15439e956b00d29")
    assert b.endswith("2d1940fa4fec29b179334852476af675861001ac9373c70e00f984f22c33bafd")
    kind = {"recordTypeId": "line-budget", "identityFields": ["codeArea"], "fields": [{"fieldId": "limit", "required": False, "valueType": "integer"}, {"fieldId": "codeArea", "required": True, "valueType": "string"}], "policy": {"operands": [{"operandId": "codeArea", "source": {"fieldId": "codeArea", "kind": "field"}, "valueType": "string"}], "relations": ["regression"]}}
    both = [{"checkId": "file-metrics", "displayName": "File metrics", "recordTypes": [kind]}, {"checkId": "duplicate-detection", "displayName": "Duplicate detection", "recordTypes": [kind]}]
    assert C.catalog_fingerprint(both) == C.catalog_fingerprint(both[::-1])
    assert C.catalog_fingerprint(both).endswith("c949e2f5ca18137d5d93b502b363d71b33b35b29a97e8b6ef4afdf61aacdfab7")


def test_subjects_and_canonical_text(spark):
    rows = spark.createDataFrame([("cafe\u0301\r\nName ",), (" Name ",), (None,)], "s string")
    assert [r[0] for r in rows.select(C.subject(F.col("s"))).collect()] == ["café\nName ", " Name ", None]
    assert C.canonical_text({"b": [1, 2.0, None], "a": {"y": True, "x": "é"}}) == '{"a":{"x":"é","y":true},"b":[1,2,null]}'
    for bad in (float("nan"), {1: 2}, object()):
        with pytest.raises((ValueError, TypeError)):
            C.canonical_text(bad)


def test_records_fingerprint_of_empty_and_ordered_sets(spark):
    rows = spark.createDataFrame([(f"r{k}", k) for k in (3, 1, 2)], "record_id string, value long")
    want = hashlib.sha256("[".encode() + ",".join(f'{{"record_id":"r{k}","value":{k}}}' for k in (1, 2, 3)).encode() + b"]").hexdigest()
    assert C.records_fingerprint(rows).first() == (C.RECORDS + want, 3)
    assert C.records_fingerprint(rows.limit(0)).first() == (C.RECORDS + hashlib.sha256(b"[]").hexdigest(), 0)


def test_changed_scope_is_the_same_by_broadcast_and_by_substrings(spark):
    paths = spark.createDataFrame([("en/src1/1",), ("en/src1/12",), ("a",), ("b/x",), (None,), ("",)], "path string")
    changed = spark.createDataFrame([("en/src1/1",), ("xb/x",), ("",), (None,)], "path string")
    want = {"en/src1/1", "en/src1/12", "b/x"}
    for few in (100, 0):
        assert {r["p"] for r in scope.touched(paths, changed, few=few).collect()} == want


def test_changed_scope_of_many_paths_equals_brute_force_without_comparing_all_pairs(spark):
    draw = random.Random(5)
    word = lambda least, most: "".join(draw.choice("ab/é") for _ in range(draw.randint(least, most)))
    p, c = {word(2, 9) for _ in range(300)}, {word(4, 7) for _ in range(60)}
    frames = [spark.createDataFrame([(x,) for x in xs], "path string") for xs in (p, c)]
    want = {x for x in p if any(y in x or x in y for y in c)}
    for few in (100, 0):
        got = [r["p"] for r in scope.touched(*frames, few=few).collect()]
        assert set(got) == want and len(got) == len(want) < len(p)
    paths = spark.range(3000).select(F.concat(F.lit("en/src1/"), "id").alias("path"))
    got = scope.touched(paths, paths.filter("path like '%7'"))
    assert not re.search("NestedLoopJoin.*LeftSemi", got._jdf.queryExecution().executedPlan().toString())
    assert got.count() == sum("7" in str(n) or 1 <= n <= 299 for n in range(3000))
    pieces = scope._holding(paths.toDF("p"), "p", paths.toDF("c"), "c")
    assert pieces.count() < 5 * paths.count()


def test_a_run_evaluates_its_checks_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    files = spark.range(40).selectExpr("concat('en/', id) path", "'english' area", "id code_lines", "0L decision_tokens").mapInPandas(counted, "path string, area string, code_lines long, decision_tokens long")
    base = spark.createDataFrame([("en/30", 1)], "path string, code_lines long")
    two = {"references": [{"reference_name": "base", "check_ids": ["file-metrics"]}], "views": [{"view_id": "all", "selectors": [("file-metrics", "file-code-lines")]}], "block_when": {"kind": "view-not-empty", "view_id": "all"}}
    config = define_config([file_metrics(5, 5, 5, 2, options={"areas": [scope.Area("english", ("en/**",))]})], two)
    got = run(spark, config, {"files": files}, changed=spark.createDataFrame([("en/30",)], "path string"), comparison=Comparison("base", "1", {"files": base}))
    before = seen.value
    assert got.records.count() == got.views.count() == 34 and got.gate.first()["gate"] == "failed"
    assert [r["relation_id"] for r in got.relations.collect()] == ["regression"] and got.evidence.count() == 35 * 2
    assert 0 < seen.value == before <= 40 * 3


def test_areas_policies_and_levels(spark):
    areas = [scope.Area("a", ("a/**",), ("a/no/**",), "watchlist-only"), scope.Area("b", ("**",), (), "exclude-warnings")]
    rows = spark.createDataFrame([("a/x",), ("a/no/x",), ("gen/x",), ("c/.d",)], "p string")
    area = scope.area_of(F.col("p"), areas, ["gen/**"])
    got = rows.select(area.alias("a"), text.level(scope.policy_of(area, areas)).alias("l")).collect()
    assert [tuple(r) for r in got] == [("a", "info"), ("b", None), ("generated", None), ("unknown", None)]
    lists = spark.createDataFrame([(["exclude-warnings"],), (["watchlist-only"],), (["watchlist-only", None],), ([None],)], "p array<string>")
    assert [r[0] for r in lists.select(text.level_of_areas(F.col("p"))).collect()] == [None, "info", "warning", "warning"]


def test_thresholds_at_their_edges(spark):
    rows = spark.createDataFrame([("en/a", "english", 300, 11), ("en/b", "english", 301, 11), ("en/c", "english", 500, 10), ("en/d", "english", 501, 10), ("en/e", "english", 301, None), ("fr/f", "french", 900, 1), ("es/g", "unknown", 900, 1)], "path string, area string, code_lines long, decision_tokens long")
    from sievemark.sources.tables import AREAS

    assert {r["semantic_subject"] for r in checks.file_records(rows, AREAS).collect()} == {"en/b", "en/d", "en/e"}


def test_function_ambiguity_and_relations(spark):
    schema = "file string, name string, start_line long, lines long, ccn long, params long, ordinal long"
    now = spark.createDataFrame([("f", "g", 1, 90, 4, 1, 0), ("f", "h", 5, 10, None, 1, 1), ("f", "h", 9, 10, None, 1, 2), ("f", "unknown", 20, 60, 5, 6, 3), ("f", "new", 30, 3, 11, 0, 4)], schema)
    i = checks.function_instances(now)
    by = {(r["name"], r["start_line"]): r for r in i.collect()}
    assert by["g", 1]["semantic_subject"] == 'function:{"file":"f","name":"g"}' and by["g", 1]["occurrence"] is None
    assert [by["h", 5]["occurrence"], by["h", 9]["occurrence"], by["unknown", 20]["occurrence"]] == [1, 2, 1]
    everywhere = [scope.Area("all", ("**",))]
    got = {(r["name"], r["metric"]) for r in checks.function_records(i, everywhere, []).collect()}
    assert got == {("unknown", "function-code-density"), ("unknown", "parameter-count"), ("new", "cyclomatic-complexity")}
    old = spark.createDataFrame([("f", "g", 1, 80, None, 1, 0)], schema)
    rel = {(r["name"], r["start_line"]): r["relation"] for r in checks.function_relations(i, old, spark.createDataFrame([("f",)], "p string"), 2).collect()}
    assert rel == {("g", 1): "regression", ("h", 5): "changed", ("h", 9): "changed", ("unknown", 20): "changed", ("new", 30): "regression"}
    assert {r["name"]: r["relation"] for r in checks.function_relations(i, old, spark.createDataFrame([("f",)], "p string"), 2, "ccn").collect()}["g"] == "changed"
    assert checks.function_relations(i, old, spark.createDataFrame([("other",)], "p string"), 2).count() == 0
    for policy_, want in (("exclude-warnings", set()), ("watchlist-only", {"info"})):
        assert {r["level"] for r in checks.function_records(i, [scope.Area("all", ("**",), (), policy_)], []).collect()} == want


def test_batches_are_whole_or_void(spark):
    rows = spark.createDataFrame([(1, True), (2, None)], "x long, ok boolean")
    assert scope.all_or_nothing(rows, F.col("ok")).count() == 0
    assert scope.all_or_nothing(rows.filter("x = 1"), F.col("ok")).count() == 1
    assert scope.all_or_nothing(rows.limit(0), F.col("ok")).count() == 0


def test_decoders(spark):
    head = ",".join(decoders.FILE_HEADER)
    csv = [("a", f'\ufeffnoise\n{head}\nTS,,"x, ""y"".ts",3,2,0,1,,9,9\nTS,p/z.ts,z.ts,1,1,0,0,4,9,9\n\n'), ("b", f"{head}\nTS,,q,3,2,0,1,,9,9\nTS,,q,-3,2,0,1,,9,9"), ("c", "TS,,q,3,2,0,1,,9,9")]
    got = decoders.file_metrics(spark.createDataFrame(csv, "doc string, content string")).collect()
    assert [(r["doc"], r["path"], r["lines"], r["decision_tokens"]) for r in sorted(got, key=lambda r: r["path"])] == [("a", "p/z.ts", 1, 4), ("a", 'x, "y".ts', 3, None)]
    fn = [("a", "5,,0,2,0,,f.ts,,x,3,9\nNLOC,CCN,t,p,l,l,file,name,long,start,end"), ("b", "5,1,0,2,0,,f.ts,g,x,9,3")]
    got = decoders.function_metrics(spark.createDataFrame(fn, "doc string, content string")).collect()
    assert [(r["name"], r["ccn"], r["end_line"]) for r in got] == [("unknown", None, 9)]
    report = json.dumps({"duplicates": [{"lines": 3.9, "tokens": 80.2, "firstFile": {"name": "a", "start": 1, "end": 0, "startLoc": {"line": 7}}, "secondFile": {"name": "b", "start": 2, "end": 5}}]})
    r = decoders.fragments(spark.createDataFrame([("a", report)], "doc string, content string")).first()
    assert (r["line_count"], r["token_count"]) == (3, 80) and [tuple(x) for x in r["locations"]] == [("a", 7, 7), ("b", 2, 5)]
    nd = decoders.ndjson(spark.createDataFrame([("a", '{"k":1}\n\n{"k"\n{"k":3}\n')], "doc string, content string"), "struct<k: bigint>").collect()
    assert [(r["pos"], r["value"].k if r["value"] else None, r["problem"]) for r in nd] == [(0, 1, None), (2, None, "line 3 is not JSON"), (3, 3, None)]
    states = decoders.json_document(spark.createDataFrame([("a", None), ("b", " "), ("c", "{"), ("d", "[]")], "doc string, content string")).collect()
    assert [r["state"] for r in states] == ["missing", "empty", "malformed", "ok"]
    assert [r["path"] for r in decoders.status_lines(spark.createDataFrame([(" M a\nR  b -> c\n?? d",)], "content string")).collect()] == ["a", "c", "d"]
    links = decoders.gitlinks(spark.createDataFrame([(f"160000 commit {'a' * 40}\tm\n100644 blob {'b' * 40}\tx",)], "content string")).collect()
    assert [tuple(r) for r in links] == [("m", "a" * 40)]
    cases = decoders.junit_cases(spark.createDataFrame([("a", '<testcase name="x" time="0.5"/><testcase name="y"/>')], "doc string, content string")).collect()
    assert [(r["name"], r["seconds"]) for r in cases] == [("x", 0.5), ("y", None)]


def test_walk_prunes_folders(spark, tmp_path):
    for p in ("a/x.txt", "skip/y.txt", "z.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("1")
    assert sorted(r["path"] for r in decoders.walk(spark, str(tmp_path), ["skip"]).collect()) == ["a/x.txt", "z.txt"]


def test_store_rules(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 3)], "record_id string, body long")
    assert {r["record_id"]: (r["state"], r["body"]) for r in store.settled(rows).collect()} == {"a": ("replayed", 1), "b": ("conflict", None), "c": ("stored", 3)}
    order = spark.createDataFrame([(k, x) for k, x in enumerate("abbcad")], "o long, k string")
    for span in (1, 2, 3, 100):
        assert sorted(r["o"] for r in store.out_of_order(order, "o", "k", span).collect()) == [2, 4]
    maps = spark.createDataFrame([({"k": "1", "z": "2"},), ({},), ({"k": "x"},), ({"k": "7"},), ({"k": None},)], "m map<string,string>")
    assert [r[0] for r in maps.select(store.first_issue(F.col("m"), {"k": ("integer", True)})).collect()] == ["unknown:z", "missing:k", "type:k", None, "type:k"]


def test_store_over_a_stream_equals_the_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", 1), ("b", 1), ("a", 1), ("c", 2), ("b", 3)]
    for k in range(0, 5, 2):
        spark.createDataFrame(rows[k : k + 2], "record_id string, body long").coalesce(1).write.mode("append").parquet(src)
        submissions.run(spark.readStream.schema("record_id string, body long").parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.option("basePath", out).parquet(f"{out}/batch=*").groupBy("record_id").agg(F.max_by(F.struct("state", "body"), "submissions").alias("s")).collect()
    want = {r["record_id"]: (r["state"], r["body"]) for r in store.settled(spark.createDataFrame(rows, "record_id string, body long")).collect()}
    assert {r["record_id"]: tuple(r["s"]) for r in got} == want


def test_references(spark):
    req = spark.createDataFrame([("c", "r"), ("c", "s")], "check_id string, reference_name string")
    ev = spark.createDataFrame([("c", "r", "complete"), ("d", "r", "complete")], "check_id string, reference_name string, status string")
    assert {tuple(r) for r in references.required_evidence(req, ev).collect()} == {("c", "r", "complete"), ("c", "s", "unavailable")}
    rel = spark.createDataFrame([("1", "c", "r", "x"), ("1", "c", "r", "y"), ("2", "c", "s", "x"), ("9", "d", "r", "x")], "record_id string, check_id string, reference_name string, relation_id string")
    assert {tuple(r) for r in references.violations(rel, ev).collect()} == {("1", "r", "several-relations"), ("2", "s", "incomplete-evidence")}
    known = spark.createDataFrame([("1",), ("2",)], "record_id string")
    assert {r["check_id"] for r in references.resolved(rel, known).collect()} == {"c"}


def test_policy_and_gate(spark):
    rec = spark.createDataFrame([("1", "c", "t", "info", 5), ("2", "c", "t", "error", None)], "record_id string, check_id string, record_type_id string, level string, value long")
    assert policy.select(rec, [("c", "t")]).count() == 2 and policy.select(rec, []).count() == 0
    assert policy.select(rec, [("c", "t")], [policy.operand_equals("value", "5")]).count() == 0
    assert policy.select(rec, [("c", "t")], [policy.operand_equals("value", 5)]).count() == 1
    clauses = spark.createDataFrame([(0, "a", True), (1, "b", False), (2, "c", True)], "ordinal long, readiness_id string, ok boolean")
    ready = policy.readiness(clauses)
    assert [r["state"] for r in ready.orderBy("ordinal").collect()] == ["passed", "failed"]
    hit = spark.createDataFrame([(True,)], "matched boolean")
    assert tuple(policy.gate(ready, hit).first()) == ("not-evaluated", "b")
    good = policy.readiness(clauses.filter("ok"))
    assert policy.gate(good, hit).first()[0] == "failed" and policy.gate(good, hit.filter("not matched")).first()[0] == "passed" and policy.gate(good, hit, False).first()[0] == "disabled"
    out = lambda *r: spark.createDataFrame(list(r), "status string, verdict string")
    assert policy.status(out(("unavailable", None), ("completed", "passed"))).first()[0] == "failed"
    assert policy.status(out(("not-applicable", None))).first()[0] == "warning" and policy.status(out(("completed", "failed"))).first()[0] == "warning" and policy.status(out(("completed", "passed"))).first()[0] == "passed"
    acc = spark.createDataFrame([("1",), ("2",)], "record_id string")
    assert policy.verification(out(("completed", "failed")), rec, acc).first()[0] == "passed" and policy.verification(out(("completed", "failed")), rec, acc.limit(1)).first()[0] == "warning" and policy.verification(out(("completed", "failed")), None, acc).first()[0] == "warning"


def test_graph(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "task string, needs string")
    assert {tuple(r) for r in graph.closure(e).collect()} == {("b", "a"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")}
    assert {r["task"] for r in graph.on_cycles(e).collect()} == {"x", "y"}
    assert {r["task"]: r["blockers"] for r in graph.blocked(e, spark.createDataFrame([("a",)], "task string")).collect()} == {"b": ["a"], "c": ["a"]}
    assert graph.closure(e.limit(0)).count() == 0


def test_scheduler():
    seen, lock = [], threading.Lock()

    def work(name, fail=False):
        def f():
            with lock:
                seen.append(name)
            if fail:
                raise RuntimeError(name)
            return name

        return f

    got = Scheduler(2).run([Task("a", work("a")), Task("b", work("b", True), ("a",)), Task("c", work("c"), ("b",)), Task("d", work("d"), ("c",)), Task("e", work("e"), (), ("m",)), Task("f", work("f"), (), ("m",))])
    assert [s.state for s in got.values()] == ["completed", "failed", "blocked", "blocked", "completed", "completed"] and got["d"].blockers == ("b",)
    assert "c" not in seen
    for bad in ([Task("a", work("a"), ("z",))], [Task("a", work("a"), ("b",)), Task("b", work("b"), ("a",))], [Task("a", work("a"))] * 2):
        with pytest.raises(ValueError):
            Scheduler().run(bad)
    stop = threading.Event()
    stop.set()
    assert Scheduler().run([Task("a", work("a"))], stop)["a"].state == "cancelled-before-start"
    assert pooled(lambda x: x * x, [3, 1, 2]) == [9, 1, 4]
    assert resolve(("a", "b"), inherit(add=["c"], remove=["a"])) == ("b", "c") and resolve(("a",), None) == ("a",) and resolve(("a",), ["z", "y"]) == ("y", "z")


def test_run_decides_and_publishes(spark, tmp_path):
    from sievemark.sources import tables

    files = tables.files(spark, D)
    config = define_config(
        [file_metrics(6, 12, 10, options={"areas": tables.AREAS}), duplicate_detection(20, options={"areas": tables.AREAS}), function_metrics(options={"areas": Q.FUNCTION_AREAS, "lines": 40, "low_lines": 80, "params": 2, "ccn": 4}, depends_on=("file-metrics",))],
        policy={"acceptance": [{"acceptance_id": "watched", "reason": "r", "check_id": "file-metrics", "record_type_id": "file-code-lines", "predicates": [{"kind": "operand-equals", "operand": "level", "value": "info"}]}], "views": [{"view_id": "open", "selectors": [("file-metrics", "file-code-lines")], "acceptance": "unaccepted"}], "readiness": [{"readiness_id": "files-ready", "kind": "check-outcome", "check_id": "file-metrics", "outcome": "completed"}], "block_when": {"kind": "view-not-empty", "view_id": "open"}},
    )
    result = run(spark, config, {"files": measured_files(files), "functions": tables.functions(spark, D)})
    assert result.diagnostics == [] and result.gate.first()[0] == "failed" and result.status.first()[0] == "warning"
    n, accepted = result.records.filter("check_id = 'file-metrics'").count(), result.acceptance.count()
    assert n > accepted > 0 and result.views.count() == n - accepted
    seal = publication.publish(result.records, {"version": 3}, str(tmp_path), publication.report(result.records))
    meta, rows = publication.read(spark, str(tmp_path))
    assert rows.count() == seal["recordCount"] == result.records.count() and meta["recordsFingerprint"] == seal["recordsFingerprint"]
    path = tmp_path / publication.RECORDS
    path.write_bytes(path.read_bytes().replace(b'"info"', b'"warning"', 1))
    with pytest.raises(ValueError, match="fingerprint"):
        publication.read(spark, str(tmp_path))
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(ValueError, match="framing"):
        publication.read(spark, str(tmp_path))
    empty = publication.publish(result.records.limit(0), {}, str(tmp_path / "e"))
    assert empty["recordCount"] == 0 and (tmp_path / "e" / publication.RECORDS).read_bytes() == b"" and publication.read(spark, str(tmp_path / "e"))[1].count() == 0
    assert publication.summary(result.records).endswith("more")


def test_definitions_are_checked(spark):
    kind = RecordType("one-type", {"k": ("integer", True)}, ("k",))
    ok = lambda f: define_check(check_id="own-check", display_name="Own", record_types=(kind,), execution=f)
    rows = spark.createDataFrame([("one-type", "info", "s", "m", 1)], "record_type_id string, level string, semantic_subject string, message string, k long")
    assert run(spark, define_config([ok(lambda c: Result("completed", rows))])).records.count() == 1
    for bad in (rows.withColumn("level", F.lit("odd")), rows.withColumn("k", F.lit(None).cast("long")), rows.withColumn("record_type_id", F.lit("other")), rows.withColumn("message", F.lit(""))):
        got = run(spark, define_config([ok(lambda c, bad=bad: Result("completed", bad))]))
        assert got.outcomes.first()["status"] == "unavailable" and got.records.count() == 0
    assert run(spark, define_config([ok(lambda c: 1 / 0)])).outcomes.first()["status"] == "unavailable"
    for parts in ({"check_id": "Bad Id"}, {"display_name": ""}, {"record_types": (kind, kind)}, {"record_types": (RecordType("t", {"k": ("odd", True)}, ()),)}, {"record_types": (RecordType("t", {"k": ("integer", False)}, ("k",)),)}):
        with pytest.raises(DefinitionError):
            define_check(**({"check_id": "own-check", "display_name": "Own", "record_types": (kind,), "execution": lambda c: None} | parts))
    with pytest.raises(DefinitionError):
        define_config([ok(lambda c: None)], {"views": [{"view_id": "v", "selectors": [("x", "y")]}]})


def test_text_functions(spark):
    r = spark.createDataFrame([("a%\r\n:,b", "C:\\w\\x.ts", 61_500, "tool v1.22.3 x")], "s string, p string, ms long, v string")
    got = r.select(text.escape_property(F.col("s")), text.relative(F.col("p"), "c:\\w"), text.duration(F.col("ms")), text.version_of(F.col("v"))).first()
    assert tuple(got) == ("a%25%0D%0A%3A%2Cb", "x.ts", "1m 02s", "1.22.3")
    assert text.valid_zone("Asia/Tokyo") and not text.valid_zone("No/Where")
    assert globs.is_safe("a/b") and not globs.is_safe("a/../b")
    h = evidence.heading_anchors(spark.createDataFrame([(1, 0, "A b!"), (1, 1, "a B"), (1, 2, "c")], "doc int, pos int, heading string"))
    assert [x["anchor"] for x in h.orderBy("pos").collect()] == ["a-b", "a-b-1", "c"]
    with pytest.raises(ValueError):
        evidence.page(r, ["s"], 0, 101)


def test_heading_anchors_of_odd_documents_equal_the_sql(spark, tmp_path):
    texts = ["Head\n\nMore\nx\n \ny\nZ", "a\n# raw\nb\n```\nc\n~~~~\nd", "a b\r\nq\r\nc", "x\u0085y\u00a0 \u03a3\u0391\u03a3\nq\nz\u2028 \u0130", "#\n##\n# #\nq\n###", "---\na\n...\nb\nc", "", None]
    rows = [(sign * (3 * n + kind), t) for n, t in enumerate(texts, 1) for kind in range(3) for sign in (1, -1)]
    spark.createDataFrame([*rows, (None, "a\nb\nc")], "doc_id long, text string").selectExpr("*", "'en' lang", "'src1' source").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for t in ("labels", "conversations"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    mine = Q.QUERIES["heading_anchors"](spark, str(tmp_path)).select("doc", "heading", "anchor").collect()
    theirs = con.sql(f"select doc, heading, anchor from ({Q.SQL['heading_anchors']})").fetchall()
    assert sorted(map(tuple, mine), key=str) == sorted(theirs, key=str) and len(theirs) > 50


def _cell(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(_cell, v))
    return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) is False and isinstance(v, int) else str(v) if v is not None and not isinstance(v, (bool, int, float, str)) else v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = Q.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    mine = sorted((tuple(map(_cell, r)) for r in df.select(cols).collect()), key=str)
    rel = con.sql(Q.SQL[name])
    assert sorted(rel.columns) == cols
    theirs = sorted((tuple(map(_cell, r)) for r in con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({Q.SQL[name]})").fetchall()), key=str)
    assert mine == theirs


def test_published_columns_that_are_null_in_the_first_thousand_records_keep_their_type(spark, tmp_path):
    rows = spark.range(1200).selectExpr("format_string('r%05d', id) AS record_id", "if(id < 1100, null, id + 0.5D) AS late", "if(id < 1100, null, named_struct('a', id)) AS nested")
    publication.publish(rows, {}, str(tmp_path))
    got = publication.read(spark, str(tmp_path))[1]
    assert dict(got.dtypes)["late"] == "double" and dict(got.dtypes)["nested"] == "struct<a:bigint>"
    assert [tuple(r) for r in got.filter("record_id = 'r01150'").select("late", "nested.a").collect()] == [(1150.5, 1150)]
