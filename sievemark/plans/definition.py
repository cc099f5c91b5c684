"""The public API: ``define_check``, ``define_config``, ``inherit`` and ``run``, and the built-in checks' definitions.

A check is a callable that gets a ``Context`` and returns a ``Result``: records as a DataFrame, an outcome and, where the run is
compared with a reference, each record's relation to it. Checks run as tasks; their facts stay DataFrames, joined, decided on and
published without being collected. What is collected are outcomes, evidence states and view sizes: a row for each thing declared.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions.canonical import REFERENCE, catalog_fingerprint, digest_of, record_id, subject
from sievemark.operators import policy as policies
from sievemark.operators import references
from sievemark.operators.durable import durable
from sievemark.plans.scheduler import Scheduler, Task

_STABLE = re.compile(r"^[a-z][a-z0-9]*(-[a-z0-9]+)*$")
_FIELD = re.compile(r"^[a-z][a-zA-Z0-9]*$")
TYPES = {"boolean": "boolean", "integer": "bigint", "number": "double", "string": "string"}
LEVELS = ("info", "warning", "error")


class DefinitionError(ValueError):
    """A definition breaks the grammar; ``path`` says where."""

    def __init__(self, path: str, why: str):
        super().__init__(f"{path}: {why}")
        self.path = path


@dataclass(frozen=True)
class RecordType:
    record_type_id: str
    fields: dict[str, tuple[str, bool]]
    identity: tuple[str, ...]
    relations: tuple[str, ...] = ()


@dataclass(frozen=True)
class Comparison:
    """A named reference at a revision, with its own tables under the names that the run's tables have."""

    reference_name: str
    revision: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def reference_id(self) -> str:
        from hashlib import sha256

        return REFERENCE + sha256(self.revision.encode()).hexdigest()


class ControlError(ValueError):
    """A run control breaks the grammar; ``reason`` is unknown-key or invalid-value."""

    def __init__(self, path: str, reason: str):
        super().__init__(f"{path}: {reason}")
        self.path, self.reason = path, reason


def checked_controls(controls: dict) -> dict:
    """Of changed (a table of one text column), comparison and cancel those that are given, each of its type."""
    kinds = {"changed": DataFrame, "comparison": Comparison, "cancel": threading.Event}
    for name in controls:
        if name not in kinds:
            raise ControlError(f"controls.{name}", "unknown-key")
    given = {k: v for k, v in controls.items() if v is not None}
    for name, value in given.items():
        if not isinstance(value, kinds[name]) or name == "changed" and [t for _, t in value.dtypes] != ["string"]:
            raise ControlError(f"controls.{name}", "invalid-value")
    c = given.get("comparison")
    if c is not None and not (isinstance(c.reference_name, str) and c.reference_name and isinstance(c.revision, str)):
        raise ControlError("controls.comparison", "invalid-value")
    return given


@dataclass(frozen=True)
class Context:
    """changed: (path) of the changed scope; comparison: the reference, None where the run has none."""

    spark: SparkSession
    options: Any
    tables: dict[str, DataFrame]
    cancel: threading.Event
    changed: DataFrame | None = None
    comparison: Comparison | None = None


@dataclass
class Result:
    """status: completed, not-applicable or unavailable. records: record_type_id, level, semantic_subject, message and the fields as
    columns; path, line and column, where a record has a place; relation, where the run is compared (null: none).
    reference: complete, incomplete or unavailable: how far the reference was seen; None submits nothing."""

    status: str
    records: DataFrame | None = None
    reason: str | None = None
    reference: str | None = None


@dataclass(frozen=True)
class Check:
    check_id: str
    display_name: str
    record_types: tuple[RecordType, ...]
    execution: Callable[[Context], Result]
    options: Any = None
    depends_on: tuple[str, ...] = ()
    mutex: tuple[str, ...] = ()


@dataclass(frozen=True)
class Inherit:
    add: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()


def inherit(add=(), remove=()) -> Inherit:
    return Inherit(tuple(add), tuple(remove))


def resolve(parent: tuple[str, ...], own) -> tuple[str, ...]:
    """Scheduling of a child: absent keeps, a collection replaces, ``inherit`` edits; sorted and unique."""
    if own is None:
        return parent
    if isinstance(own, Inherit):
        return tuple(sorted((set(parent) - set(own.remove)) | set(own.add)))
    return tuple(sorted(set(own)))


def define_check(**parts) -> Check:
    check = Check(**parts)
    if not _STABLE.match(check.check_id):
        raise DefinitionError("check_id", f"{check.check_id!r} isn't a stable id")
    if not check.display_name:
        raise DefinitionError("display_name", "is empty")
    seen = set()
    for t in check.record_types:
        at = f"record_types.{t.record_type_id}"
        if not _STABLE.match(t.record_type_id) or t.record_type_id in seen:
            raise DefinitionError(at, "isn't a stable id, or repeats")
        seen.add(t.record_type_id)
        for name, (kind, _) in t.fields.items():
            if not _FIELD.match(name) or kind not in TYPES:
                raise DefinitionError(f"{at}.{name}", "isn't a field id with a known type")
        for name in t.identity:
            if name not in t.fields or not t.fields[name][1]:
                raise DefinitionError(f"{at}.identity", f"{name} isn't a required field")
        if list(t.relations) != sorted(set(t.relations)) or not all(_STABLE.match(r) for r in t.relations):
            raise DefinitionError(f"{at}.relations", "aren't stable ids in rising order")
    if not callable(check.execution):
        raise DefinitionError("execution", "can't be called")
    return check


@dataclass(frozen=True)
class Config:
    """policies by name; ``selected`` names the one that decides, None decides nothing."""

    checks: tuple[Check, ...]
    policies: dict[str, dict] = field(default_factory=dict)
    selected: str | None = None
    max_parallel: int = 4

    @property
    def policy(self) -> dict | None:
        return None if self.selected is None else self.policies[self.selected]

    @property
    def catalog(self) -> list[dict]:
        def kind(t: RecordType) -> dict:
            out = {"recordTypeId": t.record_type_id, "fields": [{"fieldId": f, "required": need, "valueType": k} for f, (k, need) in t.fields.items()], "identityFields": list(t.identity)}
            return out | ({"policy": {"operands": [], "relations": list(t.relations)}} if t.relations else {})

        return [{"checkId": c.check_id, "displayName": c.display_name, "recordTypes": list(map(kind, c.record_types))} for c in self.checks]

    @property
    def fingerprint(self) -> str:
        """Of the declarative part: options count, callables don't."""
        return digest_of({"catalog": catalog_fingerprint(self.catalog), "options": {c.check_id: c.options for c in self.checks}})


_OPERANDS = {"level": "string", "message": "string", "location-path": "string"}
_PARTS = {"references", "acceptance", "views", "readiness", "block_when"}
_READY = {"view-empty": ("view_id",), "reference-status": ("check_id", "reference_name", "status"), "check-outcome": ("check_id", "outcome"), "check-verdict": ("check_id", "verdict")}
_BLOCK = {"view-not-empty": ("view_id",), "reference-status": ("check_id", "reference_name", "status"), "check-outcome": ("check_id", "outcome")}
_VALUES = {"status": ("complete", "incomplete", "unavailable"), "outcome": ("completed", "not-applicable", "unavailable"), "verdict": ("passed", "failed")}
_PREDICATES = {"operand-equals": ("operand", "value"), "operand-includes": ("operand", "value"), "relation-is": ("reference_name", "relation_id"), "relation-kind-in": ("reference_name", "relation_ids")}


def _keys(at: str, got: dict, need: set[str], may: set[str] = frozenset()) -> None:
    if not isinstance(got, dict):
        raise DefinitionError(at, "isn't an object")
    if unknown := sorted(set(got) - need - may):
        raise DefinitionError(f"{at}.{unknown[0]}", "is unknown")
    if missing := sorted(need - set(got)):
        raise DefinitionError(f"{at}.{missing[0]}", "is missing")


def operand_type(types: list[RecordType], name: str) -> str | None:
    """the one type of an operand on all of the record types; None if it hasn't one."""
    kinds = {_OPERANDS.get(name) or t.fields.get(name, (None,))[0] for t in types}
    return kinds.pop() if len(kinds) == 1 else None


def _check_predicate(at: str, p: dict, types: list[RecordType], names: set[str]) -> None:
    if not isinstance(p, dict) or p.get("kind") not in _PREDICATES:
        raise DefinitionError(f"{at}.kind", "is unknown")
    _keys(at, p, {"kind", *_PREDICATES[p["kind"]]})
    if p["kind"].startswith("operand"):
        kind, value = operand_type(types, p["operand"]), p["value"]
        if kind is None:
            raise DefinitionError(f"{at}.operand", f"{p['operand']} isn't of one type on all selected record types")
        fits = {"boolean": isinstance(value, bool), "integer": type(value) is int, "number": type(value) in (int, float), "string": isinstance(value, str)}[kind]
        if not fits or p["kind"] == "operand-includes" and kind != "string":
            raise DefinitionError(f"{at}.value", f"isn't of the operand's type {kind}")
        return
    if p["reference_name"] not in names:
        raise DefinitionError(f"{at}.reference_name", "isn't a reference of the policy")
    wanted = [p["relation_id"]] if p["kind"] == "relation-is" else p["relation_ids"]
    if not wanted or any(r not in t.relations for t in types for r in wanted):
        raise DefinitionError(f"{at}.relation_id", "isn't a relation of all selected record types")


def check_policy(at: str, policy: dict, checks: tuple[Check, ...]) -> None:
    """V5, V6: the closed grammar of a policy, in declared order; the first breach is raised with its path."""
    _keys(at, policy, set(), _PARTS)
    types = {(c.check_id, t.record_type_id): t for c in checks for t in c.record_types}
    ids, pairs, names = {c.check_id for c in checks}, set(), set()
    for n, r in enumerate(policy.get("references", [])):
        _keys(f"{at}.references.{n}", r, {"reference_name", "check_ids"})
        if r["reference_name"] in names or not r["reference_name"]:
            raise DefinitionError(f"{at}.references.{n}.reference_name", "is empty or repeats")
        if not r["check_ids"] or not set(r["check_ids"]) <= ids:
            raise DefinitionError(f"{at}.references.{n}.check_ids", "name an unknown check, or none")
        names.add(r["reference_name"])
        pairs |= {(c, r["reference_name"]) for c in r["check_ids"]}
    seen: dict[str, set[str]] = {"acceptance_id": set(), "view_id": set(), "readiness_id": set()}

    def own_id(where: str, rule: dict, name: str) -> None:
        if not isinstance(rule[name], str) or not _STABLE.match(rule[name]) or rule[name] in seen[name]:
            raise DefinitionError(f"{where}.{name}", "isn't a stable id, or repeats")
        seen[name].add(rule[name])

    for part, name, need, may in (("acceptance", "acceptance_id", {"acceptance_id", "reason", "check_id", "record_type_id"}, {"predicates"}), ("views", "view_id", {"view_id", "selectors"}, {"predicates", "acceptance"})):
        for n, rule in enumerate(policy.get(part, [])):
            where = f"{at}.{part}.{n}"
            _keys(where, rule, need, may)
            own_id(where, rule, name)
            selectors = [tuple(x) for x in rule["selectors"]] if part == "views" else [(rule["check_id"], rule["record_type_id"])]
            if unknown := [x for x in selectors if x not in types]:
                raise DefinitionError(where, f"selects unknown {unknown[0]}")
            if not selectors or rule.get("acceptance", "all") not in ("all", "accepted", "unaccepted") or not rule.get("reason", "x"):
                raise DefinitionError(where, "selects nothing, or has an unknown acceptance or no reason")
            for k, p in enumerate(rule.get("predicates", [])):
                _check_predicate(f"{where}.predicates.{k}", p, [types[x] for x in selectors], names)
    rules = [(f"{at}.readiness.{n}", r, _READY, {"kind", "readiness_id"}) for n, r in enumerate(policy.get("readiness", []))]
    rules += [(f"{at}.block_when", policy["block_when"], _BLOCK, {"kind"})] if "block_when" in policy else []
    for where, rule, kinds, need in rules:
        if not isinstance(rule, dict) or rule.get("kind") not in kinds:
            raise DefinitionError(f"{where}.kind", "is unknown")
        _keys(where, rule, need | set(kinds[rule["kind"]]))
        if "readiness_id" in need:
            own_id(where, rule, "readiness_id")
        if "view_id" in rule and rule["view_id"] not in seen["view_id"]:
            raise DefinitionError(f"{where}.view_id", "isn't a view of the policy")
        if "check_id" in rule and rule["check_id"] not in ids:
            raise DefinitionError(f"{where}.check_id", "is unknown")
        if "reference_name" in rule and (rule["check_id"], rule["reference_name"]) not in pairs:
            raise DefinitionError(f"{where}.reference_name", "isn't required of this check")
        for key, values in _VALUES.items():
            if key in rule and rule[key] not in values:
                raise DefinitionError(f"{where}.{key}", "is unknown")


def define_config(checks, policy: dict | None = None, max_parallel: int = 4, policies: dict[str, dict] | None = None, selected: str | None = None) -> Config:
    """``policy`` alone is the one that is selected; several come as ``policies`` with the name of the selected one."""
    checks = tuple(checks)
    ids = [c.check_id for c in checks]
    if len(set(ids)) < len(ids):
        raise DefinitionError("checks", "ids repeat")
    if type(max_parallel) is not int or max_parallel < 1:
        raise DefinitionError("max_parallel", "is 1 or more")
    if policy is not None:
        if policies is not None or selected is not None:
            raise DefinitionError("policy", "is given beside policies")
        policies, selected = {"policy": policy}, "policy"
    policies = policies or {}
    if selected is not None and selected not in policies:
        raise DefinitionError("selected", f"{selected} isn't a policy")
    for name, one in policies.items():
        check_policy("policy" if policy is not None else f"policies.{name}", one, checks)
    Scheduler().check([Task(c.check_id, lambda: None, c.depends_on, c.mutex) for c in checks])
    return Config(checks, policies, selected, max_parallel)


def select_policy(config: Config, comparison: Comparison | None) -> dict | None:
    """The selected policy, bound to the comparison: a policy has one reference at most, which the comparison must name; without
    references, or without a policy, there must be no comparison."""
    names = {r["reference_name"] for r in (config.policy or {}).get("references", [])}
    if len(names) > 1 or ({comparison.reference_name} if comparison else set()) != names:
        raise DefinitionError("comparison", "doesn't match the selected policy's references")
    return config.policy


@dataclass
class RunResult:
    """records, relations and outcomes; where there is a policy also observed records (with ``acceptances`` and ``views``), evidence of
    references, readiness, block, gate and what they rest on (owner, kind, id, position). All are DataFrames."""

    config: Config
    outcomes: DataFrame
    records: DataFrame
    relations: DataFrame
    references: DataFrame | None = None
    observed: DataFrame | None = None
    readiness: DataFrame | None = None
    block: DataFrame | None = None
    gate: DataFrame | None = None
    evidence: DataFrame | None = None
    diagnostics: list[str] = field(default_factory=list)

    @property
    def acceptance(self) -> DataFrame:
        return policies.acceptance(self.observed)

    @property
    def views(self) -> DataFrame:
        return policies.views(self.observed)

    @property
    def status(self) -> DataFrame:
        return policies.status(self.outcomes)


_RECORDS = "record_id string, check_id string, record_type_id string, level string, semantic_subject string, message string, fields string, path string, line bigint, column bigint"
_RELATIONS = "record_id string, check_id string, reference_name string, relation_id string"
_PLACE = {"path": "string", "line": "bigint", "column": "bigint"}


def _conform(check: Check, rows: DataFrame) -> tuple[DataFrame, dict]:
    """Records of a check with their ids, each id once, and with ``__relation``; and the check's counts. One pass decides all: the
    records are written, so that the policy, the views and the caller read them instead of running the check again.

    A record that breaks its record type raises. Of one id, equal bodies are a replay and kept once; different ones are a conflict,
    which keeps none of them.
    """
    parts = []
    for t in check.record_types:
        missing = [f for f, (_, need) in t.fields.items() if need and f not in rows.columns]
        if missing:
            raise DefinitionError(f"{check.check_id}.{t.record_type_id}", f"no column {missing[0]}")
        have = [f for f in sorted(t.fields) if f in rows.columns]
        typed = {f: F.col(f).cast(TYPES[t.fields[f][0]]) for f in have}
        place = {c: (F.col(c) if c in rows.columns else F.lit(None)).cast(kind) for c, kind in _PLACE.items()}
        relation = F.col("relation").cast("string") if "relation" in rows.columns else F.lit(None).cast("string")
        sound = F.col("level").isin(*LEVELS) & (F.col("semantic_subject") != "") & (F.col("message") != "")
        sound = sound & (place["line"].isNull() | (place["line"] >= 1) & place["path"].isNotNull()) & (relation.isNull() | F.coalesce(relation.isin(*t.relations), F.lit(False)))
        for f in have:
            if t.fields[f][1]:
                sound = sound & typed[f].isNotNull()
        identity = record_id(F.lit(check.check_id), F.lit(t.record_type_id), {f: typed[f] for f in t.identity}, subject(F.col("semantic_subject")))
        own = rows.filter(F.col("record_type_id") == t.record_type_id)
        body = [F.lit(check.check_id).alias("check_id"), "record_type_id", "level", "semantic_subject", "message", F.to_json(F.struct(*[typed[f].alias(f) for f in have])).alias("fields"), *[place[c].alias(c) for c in _PLACE], relation.alias("__relation")]
        parts.append(own.select(identity.alias("record_id"), F.struct(*body).alias("body"), F.coalesce(sound, F.lit(False)).alias("ok")))
    known = [t.record_type_id for t in check.record_types]
    strange = rows.filter(~F.coalesce(F.col("record_type_id").isin(*known), F.lit(False))).select(F.lit("").alias("record_id"), F.lit(False).alias("ok"))
    stored = reduce(DataFrame.unionByName, parts).unionByName(strange, allowMissingColumns=True)
    stored = durable(stored.groupBy("record_id").agg(F.min("body").alias("body"), (F.min("body") != F.max("body")).alias("clash"), F.bool_and("ok").alias("ok")))
    counts = stored.agg(F.count_if(~F.col("ok")).alias("bad"), F.count_if(F.coalesce("clash", F.lit(False))).alias("clashes"), F.count("*").alias("n")).first()
    if counts["bad"]:
        raise DefinitionError(check.check_id, "a record breaks its record type")
    return stored.filter("not clash").select("record_id", "body.*"), counts.asDict()


def run(spark: SparkSession, config: Config, tables: dict[str, DataFrame] | None = None, cancel: threading.Event | None = None, **controls) -> RunResult:
    """Run all checks, keep their facts, decide. An unavailable check holds the gate back where readiness asks for it; failed and
    blocked ones and those whose records conflict count as unavailable. controls: changed, comparison."""
    given = checked_controls(controls | ({"cancel": cancel} if cancel is not None else {}))
    cancel, comparison = given.get("cancel") or threading.Event(), given.get("comparison")
    chosen = select_policy(config, comparison)

    def task(check: Check) -> Task:
        def work() -> tuple[Result, dict]:
            got = check.execution(Context(spark, check.options, tables or {}, cancel, given.get("changed"), comparison))
            if not isinstance(got, Result) or got.status not in ("completed", "not-applicable", "unavailable"):
                raise TypeError(f"{check.check_id} returned no result")
            if got.reference not in (None, "complete", "incomplete", "unavailable") or got.reference and comparison is None:
                raise TypeError(f"{check.check_id} submits a reference that isn't there")
            counts = {"n": 0, "clashes": 0}
            if got.records is not None:
                if got.status == "not-applicable":
                    raise TypeError(f"{check.check_id} isn't applicable and has records")
                rows, counts = _conform(check, got.records)
                got = replace(got, records=rows)
            if got.status == "unavailable":
                raise RuntimeError(got.reason or "unavailable")
            return got, counts

        return Task(check.check_id, work, check.depends_on, check.mutex)

    settled = Scheduler(config.max_parallel).run([task(c) for c in config.checks], cancel)
    rows, facts, submitted, notes = [], [], [], []
    for check_id, s in settled.items():
        result, counts = s.value if s.state == "completed" else (None, {})
        if result is None or counts["clashes"]:
            rows.append((check_id, "unavailable", None))
            notes.append(f"{check_id}: record-conflict" if result else f"{check_id}: {s.state}" + (f": {s.error}" if s.error else "") + (f" by {', '.join(s.blockers)}" if s.blockers else ""))
        else:
            rows.append((check_id, result.status, ("failed" if counts["n"] else "passed") if result.status == "completed" else None))
        if result is not None and result.records is not None:
            facts.append(result.records)
        if result is not None and result.reference:
            submitted.append((check_id, comparison.reference_name, result.reference))
    outcomes = spark.createDataFrame(rows, "check_id string, status string, verdict string")
    held = reduce(DataFrame.unionByName, facts) if facts else spark.createDataFrame([], _RECORDS + ", __relation string")
    relations, evidence = spark.createDataFrame([], _RELATIONS), None
    if chosen is not None and comparison is not None:
        pairs = [(c, r["reference_name"]) for r in chosen.get("references", []) for c in r["check_ids"]]
        required = spark.createDataFrame(pairs, "check_id string, reference_name string")
        evidence = references.required_evidence(required, spark.createDataFrame(submitted, "check_id string, reference_name string, status string"))
        name, said = comparison.reference_name, [c for c, _, _ in submitted if (c, comparison.reference_name) in pairs]
        relations = held.filter(F.col("__relation").isNotNull() & F.col("check_id").isin(*said)).select("record_id", "check_id", F.lit(name).alias("reference_name"), F.col("__relation").alias("relation_id"))
    out = RunResult(config, outcomes, held.drop("__relation"), relations, evidence, diagnostics=notes)
    if chosen is not None:
        decide(out, chosen, comparison)
    return out


def _predicate(p: dict, types: list[RecordType]) -> policies.Predicate:
    if p["kind"] == "relation-is":
        return policies.relation_is(p["reference_name"], p["relation_id"])
    if p["kind"] == "relation-kind-in":
        return policies.relation_kind_in(p["reference_name"], p["relation_ids"])
    kind = operand_type(types, p["operand"])
    column = {"level": F.col("level"), "message": F.col("message"), "location-path": F.col("path")}.get(p["operand"])
    value: Column = F.get_json_object("fields", f"$.{p['operand']}").cast(TYPES[kind]) if column is None else column
    held = value == F.lit(p["value"]) if p["kind"] == "operand-equals" else value.contains(p["value"])
    return lambda rows: F.coalesce(held, F.lit(False))


def decide(result: RunResult, policy: dict, comparison: Comparison | None) -> None:
    """Acceptance, then views, then readiness up to the first clause that fails, then the block rule, then the gate.

    Evidence names what a clause rests on: a view with its records, a check, or a reference.
    """
    spark = result.records.sparkSession
    types = {(c.check_id, t.record_type_id): t for c in result.config.checks for t in c.record_types}
    made = lambda rule, selectors: rule | {"predicates": [_predicate(p, [types[tuple(x)] for x in selectors]) for p in rule.get("predicates", [])]}
    rules = [made(r, [(r["check_id"], r["record_type_id"])]) for r in policy.get("acceptance", [])]
    declared = [made(v, v["selectors"]) | {"selectors": [tuple(x) for x in v["selectors"]]} for v in policy.get("views", [])]
    asks = any(p["kind"].startswith("relation") for r in [*policy.get("acceptance", []), *policy.get("views", [])] for p in r.get("predicates", []))
    result.observed = policies.observed(result.records, rules, declared, result.relations if asks else None)

    status = {r["check_id"]: r for r in result.outcomes.collect()}  # a row for each declared check
    states = {(r["check_id"], r["reference_name"]): r["status"] for r in result.references.collect()} if result.references is not None else {}  # and for each required pair
    clauses = [*policy.get("readiness", []), *([policy["block_when"]] if "block_when" in policy else [])]
    named = list(dict.fromkeys(c["view_id"] for c in clauses if "view_id" in c))
    sizes = {r["view_id"]: r["records"] for r in policies.view_sizes(result.observed, named).collect()} if named else {}

    def holds(c: dict) -> bool:
        kind = c["kind"]
        if kind in ("view-empty", "view-not-empty"):
            return (sizes[c["view_id"]] == 0) == (kind == "view-empty")
        if kind == "reference-status":
            return states.get((c["check_id"], c["reference_name"]), "unavailable") == c["status"]
        own = status[c["check_id"]]
        return own["status"] == c["outcome"] if kind == "check-outcome" else own["status"] == "completed" and own["verdict"] == c["verdict"]

    def rests_on(c: dict) -> tuple[str, str]:
        if "view_id" in c:
            return "view", c["view_id"]
        return ("reference", f"{c['check_id']}/{c['reference_name']}/{comparison.reference_id}") if "reference_name" in c else ("check", c["check_id"])

    ready, refs = [], []
    for k, c in enumerate(policy.get("readiness", [])):
        ready.append((k, c["readiness_id"], "passed" if holds(c) else "failed"))
        refs += [(c["readiness_id"], *rests_on(c)), ("gate", "readiness", c["readiness_id"]), ("gate", *rests_on(c))]
        if ready[-1][2] == "failed":
            break
    failed = next((r[1] for r in ready if r[2] == "failed"), None)
    block = policy.get("block_when")
    matched = None if block is None or failed else holds(block)
    if matched is not None:
        refs += [("block", *rests_on(block)), ("gate", *rests_on(block))]
    gate = "not-evaluated" if failed else "disabled" if block is None else "failed" if matched else "passed"
    result.readiness = spark.createDataFrame(ready, "ordinal long, readiness_id string, state string")
    result.block = spark.createDataFrame([] if matched is None else [("matched" if matched else "not-matched",)], "status string")
    result.gate = spark.createDataFrame([(gate, failed)], "gate string, reason string")
    listed = spark.createDataFrame(refs, "owner string, kind string, id string")
    members = listed.filter("kind = 'view'").join(policies.views(result.observed).withColumnRenamed("view_id", "id"), "id").select("owner", F.lit("record").alias("kind"), F.col("record_id").alias("id"))
    result.evidence = listed.unionByName(members).distinct()


def _compared(ctx: Context, name: str) -> DataFrame | None:
    """The reference's table, where the run is compared and has a changed scope."""
    return ctx.comparison.tables.get(name) if ctx.comparison is not None and ctx.changed is not None else None


def _seen(ctx: Context, name: str) -> str | None:
    return None if ctx.comparison is None else "unavailable" if _compared(ctx, name) is None else "complete"


def _option(name: str, value, kind=int, least: int = 0):
    """An option of a built-in check."""
    if type(value) is not kind or value < least:
        raise DefinitionError(f"options.{name}", f"isn't a {kind.__name__} of {least} or more")
    return value


RELATIONS = ("changed", "regression")


def file_metrics(floor: int = 300, allowance: int = 500, few_tokens: int = 10, delta: int = 50, **more) -> Check:
    """Built in: long files. The context's tables have ``files`` with path, area, code_lines, decision_tokens; options the areas.
    A reference's ``files`` has path and code_lines."""
    from sievemark.operators import scope
    from sievemark.operators.checks import file_records, related_files

    for name, value in (("floor", floor), ("allowance", allowance), ("few_tokens", few_tokens), ("delta", delta)):
        _option(name, value)

    def execution(ctx: Context) -> Result:
        files = ctx.tables["files"]
        if files.isEmpty():
            return Result("not-applicable", reason="no-eligible-input")
        r = file_records(files, ctx.options["areas"], floor, allowance, few_tokens)
        was = _compared(ctx, "files")
        if was is None:
            r = r.withColumn("relation", F.lit(None).cast("string"))
        else:
            r = related_files(r, was.select("path", F.col("code_lines").alias("value")), scope.touched(files, ctx.changed), delta)
        return Result("completed", r.select("record_type_id", "level", "semantic_subject", "message", F.col("code_area").alias("codeArea"), F.col("code_limit").alias("limit"), "metric", "value", "path", "line", F.lit(1).alias("column"), "relation"), reference=_seen(ctx, "files"))

    kinds = {"codeArea": ("string", True), "limit": ("integer", True), "metric": ("string", True), "value": ("integer", True)}
    return define_check(check_id="file-metrics", display_name="File metrics", record_types=(RecordType("file-code-lines", kinds, ("metric",), RELATIONS),), execution=execution, **more)


def function_metrics(delta: int = 10, **more) -> Check:
    """Built in: long, complex or many-parametered functions. The context's tables have ``functions``; options areas, generated and limits.
    A reference's ``functions`` has file, name, lines, ccn and params."""
    from sievemark.operators import scope
    from sievemark.operators.checks import function_instances, function_records, related_functions

    _option("delta", delta)

    def execution(ctx: Context) -> Result:
        functions = ctx.tables["functions"]
        if functions.isEmpty():
            return Result("not-applicable", reason="no-eligible-input")
        o = dict(ctx.options)
        r = function_records(function_instances(functions), o.pop("areas"), o.pop("generated", []), **o)
        was = _compared(ctx, "functions")
        if was is None:
            r = r.withColumn("relation", F.lit(None).cast("string"))
        else:
            r = related_functions(r, was, scope.touched(functions, ctx.changed, "file"), delta)
        return Result("completed", r.select("record_type_id", "level", "semantic_subject", "message", F.col("code_area").alias("codeArea"), F.col("metric_limit").alias("limit"), "metric", "suggestion", "value", F.col("file").alias("path"), F.col("start_line").alias("line"), F.lit(1).alias("column"), "relation"), reference=_seen(ctx, "functions"))

    kinds = {"codeArea": ("string", True), "limit": ("integer", True), "metric": ("string", True), "suggestion": ("string", True), "value": ("integer", True)}
    types = tuple(RecordType(t, kinds, ("metric",), RELATIONS) for t in ("function-code-lines", "function-cyclomatic-complexity", "function-parameter-count"))
    return define_check(check_id="function-metrics", display_name="Function metrics", record_types=types, execution=execution, **more)


def duplicate_detection(tokens: int = 75, **more) -> Check:
    """Built in: text that files of one area share. The context's tables have ``files`` with path, area, text; options the areas.
    A reference's ``files`` has the same columns."""
    from sievemark.functions.text import level_of_areas
    from sievemark.operators import scope
    from sievemark.operators.checks import duplicate_relations, duplicate_subjects
    from sievemark.operators.measure import repeated_lines

    _option("tokens", tokens, least=1)

    def fragments(files: DataFrame) -> DataFrame:
        f = repeated_lines(files, tokens).withColumn("fragment_id", F.sha2(F.concat("area", F.lit("\n"), "line"), 256))
        return duplicate_subjects(f.withColumn("line_count", F.lit(1).cast("long")).withColumn("ordinal", F.col("fragment_id")))

    def execution(ctx: Context) -> Result:
        files = ctx.tables["files"]
        if files.groupBy("area").count().filter("count >= 2").isEmpty():
            return Result("not-applicable", reason="no-eligible-input")
        level = level_of_areas(F.array(scope.policy_of(F.col("area"), ctx.options["areas"])))
        r = fragments(files).withColumn("level", level).filter("level is not null")
        was = _compared(ctx, "files")
        if was is None:
            r = r.withColumn("relation", F.lit(None).cast("string"))
        else:
            r = r.join(duplicate_relations(r, fragments(was), scope.hit_fragments(r, ctx.changed), 0), "semantic_subject", "left")
        n, first = F.size("locations").cast("long"), F.get("locations", F.lit(0))
        message = F.format_string("Duplicate code fragment (%d tokens) across %d locations in areas [%s]", "token_count", n, "area")
        where = F.array_join(F.transform("locations", lambda p: F.concat(p["path"], F.lit(":"), p["start_line"])), ", ")
        suggestion = F.concat(F.lit("Consider extracting shared code into a common function or module. Locations: "), where)
        return Result("completed", r.select(F.lit("duplicate-code").alias("record_type_id"), "level", "semantic_subject", message.alias("message"), F.col("area").alias("codeArea"), F.col("line_count").alias("lineCount"), n.alias("locationCount"), F.lit("duplicate-tokens").alias("metric"), suggestion.alias("suggestion"), F.col("token_count").alias("value"), first["path"].alias("path"), first["start_line"].alias("line"), F.lit(1).alias("column"), "relation"), reference=_seen(ctx, "files"))

    kinds = {"codeArea": ("string", True), "lineCount": ("integer", True), "locationCount": ("integer", True), "metric": ("string", True), "suggestion": ("string", True), "value": ("integer", True)}
    return define_check(check_id="duplicate-detection", display_name="Duplicate detection", record_types=(RecordType("duplicate-code", kinds, ("lineCount", "locationCount", "metric"), RELATIONS),), execution=execution, **more)
