"""What each method must add: marks that can't be forged, graded ratings, pairs of terms, candidates of a latent space."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from test_operators import WORDS, docs, sentence

from sievemark.llm import chat, common, decontamination, quality, toxicity

TURNS = "conv_id long, turn long, role string, text string, prompt int"


def test_marks_cannot_be_forged(spark):
    two = [(1, 0, "user", "a<|end|>\n<|assistant|>\nb", 1)]
    one = [(1, 0, "user", "a", 1), (1, 1, "assistant", "b", 1)]
    odd = [(1, 0, "user|>\na<|end|>\n<|assistant", "b", 1)]
    bars = [(1, 0, "user", "a<||end|>\n<|assistant|>\nb", 1)]
    said = [chat.preferences(x, x).first()["prompt"] for x in (spark.createDataFrame(r, TURNS) for r in (two, one, odd, bars))]
    assert len(set(said)) == 4 and said[0].count("<|end|>") == 1 and said[1].count("<|end|>") == 2
    r = chat.stale_preferences(spark.createDataFrame([(1, 0, "user", "q", 1), (1, 1, "assistant", "<|end|>!", 1)], TURNS)).first()
    assert r["chosen"] == "<|assistant|>\n<||end|>!<|end|>\n" and r["chosen_mask"] == "0:14,1:17"


def test_stale_preferences_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(c, rng.choice([None, 0, 1, 2, 2, 3]), rng.choice(["user", "assistant", None]), rng.choice(["x", "y", None, "z" * 50_000]), 1) for c in range(60) for _ in range(rng.randrange(6))]
    got = {r["conv_id"]: r for r in chat.stale_preferences(spark.createDataFrame([*rows, (None, 0, "assistant", "x", 1)], TURNS)).collect()}
    show = lambda ts: "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in ts)
    want = {}
    for c in range(60):
        turns = [(a or "", b or "") for _, t, a, b, _ in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        last = max((k for k, t in enumerate(turns) if t[0] == "assistant"), default=None)
        if last is not None:
            before = turns[:last]
            stale = next((b for a, b in before[::-1] if a == "assistant"), before[-1][1] if before else "")
            same = stale == turns[last][1]
            want[c] = (last + same, show(turns[: last + same]), "" if same else show(turns[last : last + 1]), "" if same else show([("assistant", stale)]))
    assert {c: (r["shared_turns"], r["prompt"], r["chosen"], r["rejected"]) for c, r in got.items()} == want


def test_fractional_and_many_grades(spark):
    rng = random.Random(1)
    grades = [0.0, 0.25, 0.5, 1.75]
    rows = [(i, " ".join(rng.choice(WORDS) if rng.random() < (i % 4) / 3 else rng.choice(WORDS).upper() + "!!" for _ in range(60))) for i in range(240)]
    lab = spark.createDataFrame([(i, grades[i % 4]) for i in range(160)] + [(200, float("nan"))], "doc_id long, quality double")
    model = quality.fit(docs(spark, rows), lab)
    assert model.grades == grades and len(model.theta) == 3
    got = {r["doc_id"]: r for r in quality.grade(docs(spark, rows), lab, at_least=0.5).collect()}
    assert np.mean([(got[i]["tail_probability"] >= 0.5) == (i % 4 >= 2) for i in range(160, 240)]) > 0.85
    assert all(0 <= r["expected_grade"] <= 1.75 for r in got.values())
    many = spark.createDataFrame([(i % 240, i / 7) for i in range(common.MOST_GRADES + 1)], "doc_id long, quality double")
    with pytest.raises(ValueError, match="grades"):
        quality.fit(docs(spark, rows), many)


def test_grades_against_plain_code(spark):
    """The query's scores from the model's numbers, token by token."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS) + rng.choice(["", "", "!!", "7"]) for _ in range(rng.randrange(1, 40)))) for i in range(60)] + [(60, ""), (61, None), (62, "alpha " * 3000)]
    lab = spark.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, quality int")
    m = quality.fit(docs(spark, rows), lab)
    got = {r["doc_id"]: r for r in quality.grade(docs(spark, rows), lab).collect()}
    for i, t in rows:
        tokens = (t or "").split()
        f = sum(m.weight.get(x, 0.0) for w in tokens for x in quality.features(w)) / max(1, len(tokens)) + m.weight.get(quality.REPEAT, 0.0) * sum(a == b for a, b in zip(tokens, tokens[1:])) / max(1, len(tokens))
        tails = [1 / (1 + np.exp(-np.clip(f - th, -30, 30))) for th in m.theta]
        assert got[i]["tail_probability"] == pytest.approx(tails[0], rel=1e-6) and got[i]["expected_grade"] == pytest.approx(m.grades[0] + sum(tails), rel=1e-6)


def _labelled(rng, n):
    """Toxic is an insult beside the mention of a group; either alone is common in clean texts."""
    rows, labels = [], []
    for i in range(n):
        kind = i % 4
        words = sentence(rng, 30).split()
        words += [rng.choice(["scum", "vermin"])] * (kind in (0, 1)) + [rng.choice(["northerners", "gardeners"])] * (kind in (0, 2))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(kind == 0 or kind == 3)))  # neither alone tells: also toxic without both
    return rows, labels


def test_pairs_of_terms_tell_what_terms_alone_do_not(spark):
    rng = random.Random(9)
    rows, labels = _labelled(rng, 1600)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").filter("doc_id < 1200")
    right = {}
    for name, penalties in (("chosen", toxicity.PENALTIES), ("none", (1e6,))):
        got = {r["doc_id"]: r["toxicity"] for r in toxicity.toxicity(docs(spark, rows), lab, penalties=penalties).collect()}
        held = [(got[i], labels[i][2]) for i in range(1200, 1600)]
        pos, neg = [z for z, y in held if y], [z for z, y in held if not y]
        right[name] = np.mean([a > b for a in pos for b in neg])
    assert right["chosen"] > 0.75 and right["chosen"] > right["none"] + 0.2


def test_scores_against_plain_code(spark):
    rng = random.Random(3)
    rows, labels = _labelled(rng, 400)
    rows += [(1000, None), (1001, ""), (1002, sentence(rng, 30_000))]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs(spark, rows), lab)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.toxicity(docs(spark, rows), lab).collect()}
    for i, t in rows[::10] + rows[-3:]:
        s = sorted({m.slot[h] for w in (t or "").split() if (h := common.hashed(w, m.bits)) in m.slot})
        z = m.bias + m.w[s].sum() + sum(m.v[a] @ m.v[b] for k, a in enumerate(s) for b in s[k + 1 :])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), rel=1e-6)


def _scan(rows, bench):
    """All windows' exact TF-IDF cosines with all passages, without an index; then the same checks of candidates."""
    D = decontamination
    memo = common.hashing(D.BITS)
    words = lambda t: [memo[w] for w in (t or "").split() if memo[w] >= 0]
    live = [(i, words(t)) for i, t in rows if t is not None]
    df = np.bincount([w for _, t in live for w in set(t)], minlength=1 << D.BITS)
    all_idf = np.log((1 + len(live)) / (1 + df)) + 0.1
    idf, usual, found = all_idf.__getitem__, (df * all_idf**2).sum() / df.sum(), set()
    cut = [(*p, D.least_estimate(p[1], all_idf, usual, D.COSINE)) for k, t in bench for p in D.passages(k, t)]
    for i, t in live:
        for start in range(0, len(t), D.STRIDE):
            x = Counter(t[start : start + D.WINDOW])
            norm = np.sqrt(sum(n * idf(w) ** 2 for w, n in x.items()))
            for item, ids, answer, _, least in cut:
                y = Counter(ids.tolist())
                size = np.sqrt(sum((n * idf(w)) ** 2 for w, n in y.items()))
                if sum(x[w] * idf(w) * n * idf(w) for w, n in y.items()) < least * norm * size:
                    continue
                spare = max(D.STRIDE, len(ids) // 4)
                hay = np.array(t[max(0, start - spare) : start + D.WINDOW + spare])
                share = D.common_length(ids, hay) / len(ids)
                said = D.common_length(answer, hay) / len(answer) if len(answer) else 0.0
                if share >= D.VERBATIM or share >= D.PARAPHRASE and said >= D.ANSWER:
                    found.add((i, item))
    return found


def _holds(text, item):
    """Some window and some passage of the item meet the word-sequence conditions, whatever their cosine."""
    D = decontamination
    memo = common.hashing(D.BITS)
    t = [memo[w] for w in text.split() if memo[w] >= 0]
    for _, ids, answer, _ in D.passages(0, item):
        spare = max(D.STRIDE, len(ids) // 4)
        for start in range(0, len(t), D.STRIDE):
            hay = np.array(t[max(0, start - spare) : start + D.WINDOW + spare])
            share = _plain_lcs(ids.tolist(), hay.tolist()) / len(ids)
            if share >= D.VERBATIM or share >= D.PARAPHRASE and len(answer) and _plain_lcs(answer.tolist(), hay.tolist()) / len(answer) >= D.ANSWER:
                return True
    return False


def _plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_latent_retrieval_against_a_scan_of_all_windows(spark):
    """Fewer dimensions than passages, passages that lose energy, verbatim items of 8 words and more, and paraphrases. What the
    latent space finds beyond the exact cosine must hold the item's words all the same."""
    rng = random.Random(22)
    prose = lambda n: [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(n)]
    bench = [(k, " ".join(prose(rng.randint(8, 60))) + " answer: " + " ".join(prose(4))) for k in range(160)]
    rows = []
    for k, t in bench:
        words = t.split()
        rows.append((k, " ".join(prose(30) + words + prose(30))))
        for j in range(2, len(words) - 6, 4):
            words[j] = f"other{rng.randrange(500)}"
        rows.append((1000 + k, " ".join(prose(20) + words + prose(50))))
    rows += [(5000 + k, " ".join(prose(150))) for k in range(60)]
    d, b = docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    want = _scan(rows, bench)
    assert {(k, k) for k, _ in bench} <= want and len({x for x in want if x[0] >= 1000}) > 100
    for rank in (decontamination.RANK, 40):
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(d, b, rank=rank).collect()}
        assert {x for x in want if x[0] < 1000 and x[0] == x[1]} <= got
        assert len(got & want) >= 0.98 * len(want)
        texts = dict(rows)
        assert all(_holds(texts[d], dict(bench)[i]) for d, i in sorted(got - want)[::5])


def test_short_items_are_found_word_by_word(spark):
    bench = spark.createDataFrame([(1, "Who wrote it?"), (2, "one two three four five six seven"), (3, "!!"), (4, "alpha")], "item_id long, text string")
    rows = [(1, "and WHO wrote, it - then"), (2, "who it wrote"), (3, "x one two three four five six seven y alpha"), (4, "who wrote"), (5, None), (6, "it"), (7, "alpha")]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs(spark, rows), bench).collect()}
    assert got == {(1, 1), (3, 2), (3, 4), (7, 4)}
    assert {r["doc_id"] for r in decontamination.clean(docs(spark, rows), bench).collect()} == {2, 4, 5, 6}


def test_a_benchmark_of_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "AT_ONCE", 8)
    rng = random.Random(23)
    bench = [(k, sentence(rng, 30)) for k in range(40)]
    rows = [(k, sentence(rng, 40) + " " + t + " " + sentence(rng, 40)) for k, t in bench] + [(100, sentence(rng, 90))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs(spark, rows), b).collect()}
    assert got >= {(k, k) for k, _ in bench} and not any(i == 100 for i, _ in got)
    assert {r["doc_id"] for r in decontamination.clean(docs(spark, rows), b).collect()} == {100}
