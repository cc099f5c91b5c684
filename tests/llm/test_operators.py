"""Each operator against brute force and over awkward rows: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import bloom, chat, common, decontamination, exact_dedup, language_model, near_dedup, packing, quality, repair, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, bands string, pack_id long, canonical_url string, `listed` string, y int, p long, name string"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "lambda", "zeta", "river", "stone", "cloud", "field", "green", "light"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def docs(spark, rows):
    """(doc_id, text) rows with every clashing column null or odd."""
    return spark.createDataFrame([(i, t, None, "s", None, None, "x", None, 1, None, "?", 3, None, "n") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(3)
    long = sentence(rng, 30_000)
    return [(1, None), (2, ""), (3, "   \n "), (None, "one two three four"), (None, None), (4, "word"), (4, "word"), (5, "word"), (6, long), (7, long), (8, "!!! ??"), (9, "Ünï çødé\tτεστ\r\nline x"), (2**60 + 1, "big id here"), (10, "")]


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as k")
    other = spark.range(100_000, 120_000).selectExpr("xxhash64(id) as k")
    for most, slices in ((bloom.MOST_BYTES, 1), (2048, 4)):
        made = bloom.build(keys, most_bytes=most)
        assert len(made) == slices and all(m.words.nbytes <= most for m in made)
        ask = lambda df, made=made: bloom.tested(df, F.col("k"), made, "maybe")
        assert ask(keys).filter("maybe").count() == 5000 and ask(other).count() == 20_000
        assert ask(other).filter("maybe").count() < 1000
        assert ask(spark.sql("select cast(null as long) as k")).first()["maybe"] is False
    assert not bloom.tested(other, F.col("k"), bloom.build(keys.limit(0)), "maybe").filter("maybe").count()
    mixed = spark.sql("select if(id % 7 = 0, null, id) as a, id as b from range(500)")
    gone = spark.range(0, 200, 2).toDF("a")
    want = sum(r["a"] is None or r["a"] >= 200 or r["a"] % 2 for r in mixed.collect())
    assert bloom.without(mixed, gone, ["a"]).count() == want
    assert bloom.narrowed(mixed, gone, ["a"]).join(gone, "a").count() == 500 - want


def test_a_filter_that_takes_too_many_passes_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BYTES", 32)
    rows, gone = spark.range(2000).toDF("a"), spark.range(0, 2000, 2).toDF("a")
    assert bloom.without(rows, gone, ["a"]).count() == 1000 and bloom.narrowed(rows, gone, ["a"]).join(gone, "a").count() == 1000


def test_urls_equal_a_plain_join_with_and_without_the_filter(spark):
    pages = [(1, "HTTP://www.A.example:80/x/?utm_source=q&b=2&a=1#f"), (2, "https://a.example/x?a=1&b=2"), (3, "https://a.example/y"), (4, None), (5, ""), (6, "https://a.example/x/index.html?b=2&a=1"), (7, "https://a.example/" + "x" * 200_000), (2, "https://a.example/x?a=1&b=2")]
    p = spark.createDataFrame([(i, u, "h", True, "c") for i, u in pages], "page_id long, url string, html string, listed boolean, canonical_url string")
    bad = spark.createDataFrame([("http://m.a.example/x?a=1&b=2&ref=z",), (None,), ("",), ("http://m.a.example/x?a=1&b=2",)], "url string")
    for most in (bloom.MOST_BYTES, 32):
        got = sorted((r["page_id"], r["listed"]) for r in urls.listed(p, bad, most_bytes=most).collect())
        assert got == [(1, True), (2, True), (2, True), (3, False), (4, False), (5, False), (6, True), (7, False)]
    assert urls.listed(p.limit(0), bad).count() == 0
    assert not any(r["listed"] for r in urls.listed(p, bad.limit(0)).collect())


def test_quality_orders_grades_and_keeps_clean_documents(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        g = i % 4
        words = [rng.choice(WORDS) if rng.random() < g / 3 else rng.choice(WORDS).upper() + "!!" for _ in range(60)]
        rows.append((i, " ".join(words)))
        labels.append((i, g, None))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.grade(docs(spark, rows), lab.filter("doc_id < 160"), at_least=2).collect()}
    held = [(i % 4, got[i]["expected_grade"], got[i]["tail_probability"]) for i in range(160, 240)]
    means = [np.mean([e for g, e, _ in held if g == k]) for k in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5
    assert np.mean([(t >= 0.5) == (g >= 2) for g, _, t in held]) > 0.9
    assert all(0 <= r["expected_grade"] <= 3 for r in got.values())


def test_quality_thresholds_are_ordered_and_fit_the_likelihood():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2)).astype(np.float32)
    z = x @ [1.5, -1.0] + rng.logistic(size=3000)
    y = np.digitize(z, [-1.0, 0.5, 2.0])
    w, theta = quality.train(x, y, np.ones(3000), 4, steps=400)
    assert np.all(np.diff(theta) > 0)
    assert np.allclose(w, [1.5, -1.0], atol=0.2) and np.allclose(theta, [-1.0, 0.5, 2.0], atol=0.25)


def test_classifiers_on_awkward_rows(spark, awkward):
    d = docs(spark, awkward)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (99, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for lab in (none, some, some.filter("quality = 1")):
        a, b = toxicity.toxicity(d, lab).collect(), quality.grade(d, lab).collect()
        assert len(a) == len(b) == len(awkward)
        assert all(0 <= r["toxicity"] <= 1 for r in a) and all(0 <= r["tail_probability"] <= 1 for r in b)
    assert not any(r["toxic"] for r in toxicity.toxicity(d, none).collect())
    assert all(r["keep"] for r in quality.grade(d, none).collect())
    assert toxicity.toxicity(d.limit(0), some).count() == quality.grade(d.limit(0), some).count() == 0
    assert toxicity.clean(d, none).columns == d.columns and toxicity.clean(d, none).count() == len(awkward)


def test_factorization_machine_equals_the_pairwise_sum():
    rng = np.random.default_rng(2)
    m = toxicity.Machine({i: i for i in range(12)}, 0.3, rng.normal(size=12), rng.normal(size=(12, 3)))
    sets = [[0, 3, 5], [], [1], list(range(12))]
    rows = np.array([k for k, s in enumerate(sets) for _ in s])
    slots = np.array([i for s in sets for i in s])
    want = [0.3 + sum(m.w[i] for i in s) + sum(m.v[i] @ m.v[j] for i, j in itertools.combinations(s, 2)) for s in sets]
    assert np.allclose(m.logits(rows, slots, 4), want)


def test_factorization_machine_learns_what_additive_weights_miss():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (1200, 6)).astype(np.float32)
    y = (x[:, 0] != x[:, 1]).astype(np.float32)  # neither term tells alone
    b, w, v = toxicity.train(x, y, np.ones(1200), 4, steps=400, l2=1e-4, l2v=1e-4)
    s = x @ v
    z = b + x @ w + 0.5 * ((s * s).sum(1) - x @ (v * v).sum(1))
    assert ((z > 0) == (y > 0)).mean() > 0.95


def test_toxicity_on_held_out_labels(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(800):
        t = i % 5 == 0
        words = sentence(rng, 50).split()
        if t:
            for _ in range(4):
                words.insert(rng.randrange(50), rng.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(t)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs(spark, rows), lab.filter("doc_id < 500")).collect()}
    assert np.mean([got[i] == (i % 5 == 0) for i in range(500, 800)]) > 0.97
    kept = {r["doc_id"] for r in toxicity.clean(docs(spark, rows), lab.filter("doc_id < 500")).collect()}
    assert kept == {i for i in got if not got[i]}


def test_preferences_against_brute_force(spark):
    rng = random.Random(5)
    turns = {c: [(k, rng.choice(["user", "assistant", "system"]), rng.choice(["", "hi", "why?\n", None])) for k in range(rng.randrange(5))] for c in range(40)}
    other = {c: (t[: rng.randrange(len(t) + 1)] + [(9, "assistant", "no")] * rng.randrange(2)) for c, t in turns.items()}
    frame = lambda d: spark.createDataFrame([(c, *t, 1) for c, ts in d.items() for t in ts] + [(None, 0, "user", "x", 1)], "conv_id long, turn long, role string, text string, prompt int")
    got = {r["conv_id"]: r for r in chat.preferences(frame(turns), frame(other)).collect()}
    assert set(got) == {c for c in turns if turns[c] and other[c]}
    render = lambda ts: "".join(f"<|{r}|>\n{x or ''}<|end|>\n" for _, r, x in ts)
    for c, r in got.items():
        a, b = ([(k, role, x or "") for k, role, x in ts] for ts in (turns[c], other[c]))
        n = next((k for k, (p, q) in enumerate(zip(a, b)) if p[1:] != q[1:]), min(len(a), len(b)))
        assert (r["shared_turns"], r["prompt"], r["chosen"], r["rejected"]) == (n, render(a[:n]), render(a[n:]), render(b[n:]))
        for side, rest in (("chosen", a[n:]), ("rejected", b[n:])):
            runs = [tuple(map(int, x.split(":"))) for x in r[f"{side}_mask"].split(",") if x]
            assert sum(k for _, k in runs) == len(r[side])
            at, trained = 0, ""
            for bit, k in runs:
                trained += r[side][at : at + k] if bit else ""
                at += k
            assert trained == "".join(f"{x}<|end|>\n" for _, role, x in rest if role == "assistant")
    empty = frame({})
    assert chat.preferences(empty, empty).count() == 0
    assert chat.stale_preferences(empty).count() == 0


def test_packing_uses_every_piece_once_and_overfills_nothing(spark, awkward):
    rng = random.Random(6)
    rows = awkward + [(100 + i, " ".join(["w"] * rng.choice([1, 3, 7, 7, 12, 20, 31, 32, 33, 64, 65, 100]))) for i in range(300)]
    got = packing.pack(docs(spark, rows), window=32).collect()
    words = [(i, len(t.split())) for i, t in rows if t]
    want = sorted(((i, p, min(32, n - 32 * p)) for i, n in words for p in range(-(-n // 32))), key=str)
    assert sorted(((r["doc_id"], r["piece"], r["length"]) for r in got), key=str) == want
    packs = {}
    for r in got:
        packs.setdefault(r["pack_id"], []).append((r["position"], r["length"]))
    for parts in packs.values():
        at = 0
        for position, length in sorted(parts):
            assert position == at
            at += length
        assert at <= 32
    assert len(packs) <= math.ceil(sum(n for _, n in words) / 32) * 1.1 + 3
    assert packing.pack(docs(spark, rows).limit(0)).count() == 0


def test_least_squares_reach_the_brute_force_optimum():
    h = np.zeros(9, np.int64)
    h[[2, 3, 4, 5, 6]] = [40, 30, 25, 30, 20]
    combos, x = packing.solve(h, 8, 4000)
    a = np.zeros((9, len(combos)))
    for s, c in enumerate(combos):
        for v in c:
            a[v, s] += v > 0
    grad = a.T @ (a @ x - np.where(np.arange(9) > 0, h, 0))
    assert (x >= 0).all() and grad.min() > -0.5 and abs(grad @ x) < 0.05 * (h @ h)  # the conditions of the optimum
    plan = packing.plan(h, 8)
    used = np.zeros(9, int)
    for lengths, n in plan:
        assert sum(lengths) <= 8
        for v in lengths:
            used[v] += n
    assert (used == h).all()
    assert packing.plan(np.zeros(9, np.int64), 8) == []


def test_longest_common_subsequence_against_dynamic_programming():
    rng = random.Random(9)
    for _ in range(60):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.common_length(np.array(a), np.array(b)) == t[-1][-1]


def test_decontamination_finds_planted_items_and_leaves_others(spark, awkward):
    rng = random.Random(10)
    items = [(k, sentence(rng, n) + ". " + sentence(rng, 8)) for k, n in enumerate([12, 20, 35, 60, 150, 14, 25, 40, 90, 18])]
    rows = awkward + [(100 + i, sentence(rng, 120)) for i in range(120)]
    want = set()
    for k, (i, t) in enumerate(items):
        rows.append((300 + k, sentence(rng, 80) + " " + t.upper() + " " + sentence(rng, 200)))
        want.add((300 + k, i))
        words = t.split()
        for j in range(len(words) // 8):  # a paraphrase: every eighth word replaced
            words[8 * j] = "changed"
        rows.append((400 + k, sentence(rng, 50) + " " + " ".join(words) + " " + sentence(rng, 40)))
        want.add((400 + k, i))
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "too short"), items[0], (None, "x")], "item_id long, text string").selectExpr("*", "1 as cosine")
    d = docs(spark, rows)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(d, bench).collect()}
    assert len(got & want) >= 0.9 * len(want) and all(x in got for x in want if x[0] < 400)
    assert not got - want
    kept = decontamination.clean(d, bench)
    assert kept.columns == d.columns and kept.count() == len(rows) - len({x for x, _ in got})
    assert decontamination.leaks(d.limit(0), bench).count() == 0
    assert decontamination.leaks(d, bench.limit(0)).count() == 0 and decontamination.clean(d, bench.limit(0)).count() == len(rows)


def test_decontamination_finds_verbatim_items_of_a_benchmark_larger_than_the_rank(spark):
    rng = random.Random(21)
    prose = lambda n: " ".join(f"w{rng.randrange(20_000)}" for _ in range(n))
    items = [(i, prose(rng.randint(15, 48))) for i in range(1200)]
    rows = [(i, f"{prose(40)} {t} {prose(40)}") for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs(spark, rows), bench).collect()}
    assert got >= {(i, i) for i, _ in items}


def test_randomised_svd_spans_the_exact_space(spark):
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(60, 12).tolist()) for _ in range(20)]
    features, idf = np.arange(60), np.linspace(1, 2, 60)
    v = decontamination.randomised_svd(spark.createDataFrame([(r,) for r in rows], "ids array<int>"), features, idf, 20)
    x = np.zeros((20, 60))
    for k, r in enumerate(rows):
        at, w = decontamination.tf_idf(np.array(r), features, idf)
        x[k, at] = w
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3)
    assert np.linalg.norm(x - x @ v @ v.T) < 0.02 * np.linalg.norm(x)


def test_exact_dedup_against_brute_force(spark, awkward, tmp_path):
    rows = awkward + [(20 + i, f"text {i % 7}") for i in range(40)]
    d = docs(spark, rows)
    got = sorted((r["doc_id"], r["kept_doc_id"]) for r in exact_dedup.duplicates(d).collect())
    first, want = {}, []
    for i, t in sorted(((i, t) for i, t in rows if t is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        if t in first:
            want.append((i, first[t]))
        first.setdefault(t, i)
    assert got == sorted(want)
    d.write.parquet(str(tmp_path / "d"))  # read from files, the locators are used as they are
    read = spark.read.parquet(str(tmp_path / "d"))
    kept = exact_dedup.unique(read)
    assert kept.columns == d.columns
    texts = [r["text"] for r in kept.collect()]
    assert sorted(t for t in texts if t is not None) == sorted(first) and texts.count(None) == 2
    assert exact_dedup.duplicates(d.limit(0)).count() == 0


def test_state_keeps_the_first_arrival_over_micro_batches(spark, tmp_path):
    source, state = tmp_path / "arrivals", str(tmp_path / "state")
    for run, ids in enumerate([[5, 2], [1, 4]]):
        spark.createDataFrame([(run, b"d", str(i), i, "f", i) for i in ids], exact_dedup._KEY_SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        got = exact_dedup.stream_groups(spark, str(source), state).collect()
        assert [(r["ord"], r["run"], r["n"]) for r in got] == [(2, 0, 2 + 2 * run)]


def test_a_second_arrival_meets_the_state_of_the_first(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALT", 4)  # copies of one text are parted
    state, arrivals = str(tmp_path / "kept"), [[(7, "a"), (8, "b"), (9, "a"), (3, None)], [(1, "a"), (2, "c"), (4, "c"), (5, "d")] + [(20 + k, "e") for k in range(30)], [(0, "e"), (6, "new")]]
    want = [{(9, 7)}, {(1, 7), (4, 2)} | {(20 + k, 20) for k in range(1, 30)}, {(0, 20)}]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for k, rows in enumerate(arrivals):
        docs(spark, rows).write.parquet(str(tmp_path / f"d{k}"))
        got = exact_dedup.duplicates(spark.read.parquet(str(tmp_path / f"d{k}")), state).collect()
        assert {(r["doc_id"], r["kept_doc_id"]) for r in got} == want[k] and len(got) == len(want[k])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def _jaccard(a, b):
    grams = lambda t: {tuple(w[k : k + 3]) for w in [[x for x in map(common.normal, t.split()) if x]] for k in range(max(1, len(w) - 2))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_near_dedup_against_brute_force(spark, awkward):
    rng = random.Random(12)
    rows = list(awkward)
    shared = sentence(rng, 40)
    for g in range(40):
        base = sentence(rng, 120).split()
        rows.append((1000 + 10 * g, " ".join(base)))
        for c in range(g % 4):
            w = list(base)
            for k in rng.sample(range(len(w)), 1 + 3 * c):
                w[k] = "edit"
            rows.append((1001 + 10 * g + c, " ".join(w)))
    rows += [(2000 + k, shared + " " + sentence(rng, 300)) for k in range(30)]  # a passage alone makes no near copy
    got = {(r["doc_id"], r["kept_doc_id"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    live = {i: t for i, t in rows if i is not None and t and any(map(common.normal, t.split()))}
    par = {i: i for i in live}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in itertools.combinations(sorted(live), 2):
        if (len(live[a]) < 2000 or live[a] == live[b]) and _jaccard(live[a], live[b]) >= near_dedup.THRESHOLD:
            x, y = sorted((find(a), find(b)))
            par[y] = x
    want = {(i, find(i)) for i in live if find(i) != i}
    assert len(got & want) >= 0.95 * len(want) and not got - want
    kept = near_dedup.unique(docs(spark, rows))
    assert kept.count() == sum(i not in {x for x, _ in got} for i, _ in rows)
    assert near_dedup.near_duplicates(docs(spark, []).limit(0)).count() == 0 if rows else True


def test_near_dedup_finds_copies_whose_hub_is_none(spark, monkeypatch):
    """Documents share more than half of their words, any two at a Jaccard similarity below the threshold but the planted ones."""
    rng = random.Random(12)
    prose = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    common = prose(120)
    rows = [(i, " ".join(common + prose(80))) for i in range(300)]
    want = set()
    for k in range(60):
        own = prose(80)
        rows += [(1000 + 2 * k, " ".join(common + own)), (1001 + 2 * k, " ".join(common + own[:20] + prose(60)))]
        if _jaccard(rows[-2][1], rows[-1][1]) >= near_dedup.THRESHOLD:
            want.add((1001 + 2 * k, 1000 + 2 * k))
    assert len(want) == 60
    monkeypatch.setattr(near_dedup, "BLOCK", 64)  # buckets are parted
    got = {(r["doc_id"], r["kept_doc_id"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == want


def test_signatures_estimate_similarity_and_fill_every_bin():
    rng = random.Random(13)
    memo = common.Memo(near_dedup.token_hash)
    texts = ["a b c", "x", "", *[sentence(rng, 200) for _ in range(5)]]
    sig, some = near_dedup.signatures(*near_dedup.shingles(texts, memo), len(texts))
    assert some.tolist() == [True, True, False] + [True] * 5
    assert (sig[some] != 0xFFFFFFFF).all()
    errors = []
    for _ in range(30):
        w = sentence(rng, 150).split()
        v = list(w)
        for k in rng.sample(range(150), rng.randrange(2, 25)):
            v[k] = "z"
        s, _ = near_dedup.signatures(*near_dedup.shingles([" ".join(w), " ".join(v)], memo), 2)
        errors.append((s[0] == s[1]).mean() - _jaccard(" ".join(w), " ".join(v)))
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < near_dedup.MARGIN


def test_components_of_a_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101)], "hub long, id long")
    assert sorted((r["id"], r["root"]) for r in near_dedup.components(edges).collect()) == [*((k, 0) for k in range(1, n + 1)), (101, 100)]
    assert near_dedup.components(edges.limit(0)).count() == 0


def test_tables_drawn_follow_the_exact_conditional():
    rng = np.random.default_rng(1)
    n, base, rest = 6, 0.2, 3.0
    d, s = language_model.DISCOUNT, language_model.STRENGTH
    t = language_model.draw_tables(np.full(40_000, n), np.full(40_000, rest), np.full(40_000, base), rng)

    def weights(c):  # by seating customer after customer at explicit tables
        out = {(): 1.0}
        for _ in range(c):
            new = {}
            for seats, p in out.items():
                for k in range(len(seats)):
                    key = tuple(sorted((*seats[:k], seats[k] + 1, *seats[k + 1 :])))
                    new[key] = new.get(key, 0) + p * (seats[k] - d)
                key = tuple(sorted((*seats, 1)))
                new[key] = new.get(key, 0) + p * (s + d * (rest + len(seats))) * base
            out = new
        total = np.zeros(c + 1)
        for seats, p in out.items():
            total[len(seats)] += p
        return total / total.sum()

    assert np.allclose(np.bincount(t, minlength=n + 1) / len(t), weights(n), atol=0.01)
    n = 200  # beyond EXACT, where customers are seated one after the other and then in chunks
    stirling = language_model.log_stirling(n, d)[n, 1:]
    k = np.arange(1, n + 1)
    log = stirling + np.cumsum(np.log(s + d * (rest + k - 1)) + np.log(base))
    p = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
    large = language_model.draw_tables(np.full(20_000, n), np.full(20_000, rest), np.full(20_000, base), rng)
    mean = (p * k).sum()
    assert abs(large.mean() / mean - 1) < 0.05 and abs(large.std() / np.sqrt((p * (k - mean) ** 2).sum()) - 1) < 0.1


def _plain(model):
    """(sections {(u, w): (customers, mean tables)}, words {code: (customers, [(tables, dishes, parent's tables) of each sample])})."""
    rows = model.sections.toPandas()
    sections, words = {}, {}
    for _, g in rows.groupby("p"):
        codes, u, w, n = language_model._tables_of(g[g.kind == 0].blobs.iloc[0])
        t = np.ones(len(n))
        t[n > 1] = language_model.unpack(g[g.kind == 1].blobs.iloc[0][0]) / len(model.totals)
        sections |= {(int(codes[a]), int(codes[b])): (int(c), float(x)) for a, b, c, x in zip(u, w, n, t)}
    for blobs in model.lexicon.toPandas()["blobs"]:
        codes, n, *drawn = language_model.unpack_rising(blobs[0]), language_model.unpack(blobs[1]), *map(language_model.unpack, blobs[5:])
        words |= {int(c): (int(n[i]), [tuple(int(drawn[3 * s + k][i]) for k in range(3)) for s in range(len(model.totals))]) for i, c in enumerate(codes)}
    return sections, words


def _probability(model, sections, words, u, w, own=0):
    """By the textbook's formula, from the tables drawn."""
    d, s = language_model.DISCOUNT, language_model.STRENGTH
    c, t = sections.get((u, w), (0, 0.0))
    n, of_u = words.get(u, (0, [(0, 0, 0)] * len(model.totals)))
    _, of_w = words.get(w, (0, [(0, 0, 0)] * len(model.totals)))
    back = 0.0
    for k, (customers, tables) in enumerate(model.totals):
        _, dishes, up = of_w[k]
        back += (s + d * of_u[k][0]) * ((dishes - d * up) + (s + d * tables) / (model.size + 1)) / (s + customers) / len(model.totals)
    own = min(own, c)
    t *= 1 - own / max(c, 1)
    return (c - own - d * t + back) / (s + n - own)


def test_language_model_against_plain_code(spark, awkward):
    rng = random.Random(14)
    follow = {w: rng.sample(WORDS, 3) for w in WORDS}

    def text(n):
        out = [rng.choice(WORDS)]
        for _ in range(n):
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    rows = [(1000 + k, text(40)) for k in range(150)]
    model = language_model.train(docs(spark, rows))
    sections, words = _plain(model)
    code = language_model.word_code
    pairs = lambda t: list(zip([language_model.START, *map(code, t.split())], [*map(code, t.split()), language_model.END]))
    counts = Counter(p for _, t in rows for p in pairs(t))
    assert {p: c for p, (c, _) in sections.items()} == counts
    assert all(1 <= t <= c for c, t in sections.values()) and model.size == len(WORDS) + 1
    assert all(n == sum(c for (a, _), c in counts.items() if a == u) for u, (n, _) in words.items())
    for k in range(len(model.totals)):  # every table is a customer of the parent
        assert sum(x[k][0] for _, x in words.values()) == sum(x[k][1] for _, x in words.values()) == model.totals[k][0]
        assert all(min(x[k][1], 1) <= x[k][2] <= max(x[k][1], 0) for _, x in words.values())
    assert abs(sum(t for _, t in sections.values()) - np.mean([c for c, _ in model.totals])) < 1e-6
    for u in (code("alpha"), language_model.START, 12345):  # all words and the one for those never seen
        assert abs(sum(_probability(model, sections, words, u, w) for w in [*(x for x in words if x != language_model.START), 99]) - 1) < 1e-6
    long = " ".join(text(5000) for _ in range(6))
    held = [(1, text(60)), (2, " ".join(rng.choice(WORDS) for _ in range(61))), (3, "never seen words here"), (4, long), (None, "alpha"), (5, ""), (6, None)]
    got = {r["doc_id"]: r for r in language_model.score(docs(spark, held), model).collect()}
    for i, t in held:
        want = sum(math.log(_probability(model, sections, words, *p)) for p in pairs(t)) if t else 0.0
        assert got[i]["log_probability"] == pytest.approx(want, rel=1e-9) and got[i]["tokens"] == (len(pairs(t)) if t else 0)
        assert got[i]["perplexity"] is None if not t else got[i]["perplexity"] == pytest.approx(math.exp(-want / len(pairs(t))), rel=1e-9)
    assert got[1]["perplexity"] < 6 < got[2]["perplexity"]
    seen = {r["doc_id"]: r for r in language_model.score(docs(spark, rows), model, seen=True).collect()}
    for i, t in rows[:20]:
        own = Counter(pairs(t))
        want = sum(math.log(_probability(model, sections, words, *p, own[p])) for p in pairs(t))
        assert seen[i]["log_probability"] == pytest.approx(want, rel=1e-9)
    assert language_model.score(docs(spark, rows).limit(0), model).count() == 0
    empty = language_model.train(docs(spark, []).limit(0))
    assert language_model.score(docs(spark, rows[:3]), empty).count() == 3
    assert len(language_model.score(docs(spark, awkward), model).collect()) == len(awkward)  # very long texts that the model hasn't seen, too
    full = language_model.score(docs(spark, awkward), language_model.train(docs(spark, awkward)), seen=True)
    assert full.count() == len(awkward)


def test_counts_travel_whole():
    for x in ([], [0], [5_000_000_000, 1, 2**40], [2**62]):
        assert language_model.unpack(language_model.pack(np.array(x, np.int64))).tolist() == x
    assert language_model.unpack_rising(language_model.pack_rising(np.array([3, 3, 2**40]))).tolist() == [3, 3, 2**40]


def test_vocabulary_grows_with_the_corpus(spark):
    for n in (50, 5000):
        assert language_model.train(docs(spark, [(k, f"word{k} word{k + 1}") for k in range(n)]), 0, 1).size == n + 2


def test_repair_round_trip_and_random_access(spark, awkward):
    rng = random.Random(15)
    rows = awkward + [(50 + k, sentence(rng, 80) + rng.choice(["", " ", "  x", "\n", "\n\ny", "\tz", " aaaa aaaa aaaa aaaa aaaa"])) for k in range(60)]
    enc = repair.encoding(repair.vocabulary_file(repair.VOCABULARY))
    want = sorted(((i, tuple(enc.encode_ordinary(t or ""))) for i, t in rows), key=str)
    got = []
    for row in repair.shards(docs(spark, rows), shard=3000).collect():
        s = repair.Shard(row)
        for k, i in enumerate(row["doc_ids"]):
            ids = s.document(k)
            got.append((i, tuple(ids)))
            assert len(ids) == row["id_counts"][k]
            for at in {0, len(ids) // 2, len(ids) - 1} if ids else ():
                assert s.id_at(k, at) == ids[at]
            with pytest.raises(IndexError):
                s.id_at(k, len(ids))
    assert sorted(got, key=str) == want
    assert repair.shards(docs(spark, rows).limit(0)).count() == 0


def test_compression_replaces_what_repeats():
    x = np.array([5, 6, 7] * 200 + [-1] + [9] * 101 + [-1])
    y, left, right = repair.compress(x, 100)
    assert len(y) + 2 * len(left) < len(x) / 4
    size = repair.lengths(left, right, 100)
    assert sum(size[s - 100] if s >= 100 else 1 for s in y if s >= 0) == 701
    for z in (np.zeros(0), np.array([-1]), np.array([3]), np.array([1, 2, -1])):
        assert repair.compress(z.astype(np.int32), 100)[0].tolist() == z.tolist()


def test_no_module_swallows_import_errors_or_uses_local_checkpoints():
    from pathlib import Path

    for p in [*Path(common.__file__).parent.glob("*.py"), Path(common.__file__).parents[2] / "corpus_pipeline.py"]:
        assert not re.search(r"except (ImportError|ModuleNotFoundError)|localCheckpoint", p.read_text())


def textbook_repair(x, first, least):
    """One pair at a time, the most frequent one, non-overlapping from the left."""
    x, rules = list(x), []
    while True:
        n, last = Counter(), {}
        for i, p in enumerate(zip(x, x[1:])):
            if -1 not in p and last.get(p) != i - 1:
                n[p] += 1
                last[p] = i
        if not n or max(n.values()) < least:
            return x, rules
        best, out, i = max(n, key=lambda p: (n[p], p)), [], 0
        while i < len(x):
            if tuple(x[i : i + 2]) == best:
                out.append(first + len(rules))
                i += 2
            else:
                out.append(x[i])
                i += 1
        x = out
        rules.append(best)


def test_compression_beside_the_textbook():
    rng = random.Random(16)
    words = [[rng.randrange(60) for _ in range(rng.randint(1, 5))] for _ in range(80)]
    x = [i for _ in range(60) for i in [*(v for _ in range(20) for v in rng.choice(words[: rng.randint(1, 80)])), -1]]
    plain, rules = textbook_repair(x, 100, repair.LEAST)
    y, left, right = repair.compress(np.array(x), 100)
    assert len(y) + 3 * len(left) <= 1.08 * (len(plain) + 3 * len(rules))
    rule = {100 + k: p for k, p in enumerate(zip(left.tolist(), right.tolist()))}

    def expand(s):
        return [s] if s not in rule else expand(rule[s][0]) + expand(rule[s][1])

    assert [i for s in y.tolist() for i in expand(s)] == x
    again = Counter(p for p in zip(y.tolist(), y[1:].tolist()) if -1 not in p and p[0] != p[1])
    assert max(again.values()) < repair.LEAST  # no pair is left that would be worth a rule
