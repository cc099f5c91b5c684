"""LM scoring: a hierarchical Pitman-Yor bigram model over an open vocabulary.

Restaurants: one for every context word; all of them share one parent, the unigram restaurant, whose base is uniform over the
corpus' words and one more for all words never seen. A section (u, w) is the customers of dish w in context u. Given the rest,
the number of its tables is drawn from its conditional, in which generalised Stirling numbers sum out who sits where: they come
from a table up to EXACT customers, beyond from their series or saddle point. Every table is a customer of the parent. A sweep draws all sections at once given the last sweep's totals (parallel Gibbs). After BURN sweeps, SAMPLES are averaged.

Words are known by WORD_BITS bits of a hash, so the vocabulary grows with the corpus (of 10 million words about 45 pairs share a
code). Nothing of the vocabulary's size is broadcast or collected: sections lie in parts by a hash of (u, w), whose number grows
with the text, so that a frequent context or word isn't one task's work; what is known of words lies in as many ranges of codes.
In a sweep every part reports its tables to the words' ranges, a range draws its words' tables in the parent and replies to each
part, and the parts draw. Arrays travel as byte planes, sorted ones as differences.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import Memo, chunks, codes, flatten, give_back, in_arrow, memo_of, normal, remove, table, written
from sievemark.llm.near_dedup import _ODD, _mix

WORD_BITS = 40
#: Codes of a text's start and end; words' codes follow.
START, END = 0, 1
DISCOUNT, STRENGTH = 0.75, 1.0
BURN, SAMPLES = 2, 3
EXACT = 64
#: Bytes of text whose sections make a part on average, and the least number of parts.
PART_BYTES, LEAST_PARTS = 16 << 20, 8
#: Tokens a task holds before it hands on their counts.
HELD = 1_000_000
#: Texts whose pairs a task holds at once in scoring.
TEXTS = 2048
#: Characters of texts that are words at once, texts of a batch and rows of a part that are Python's at once, and numbers hashed at once.
LETTERS, COUNTED, LOOKED, HASHED = 1 << 20, 512, 64, 1 << 16
_ROW = "p long, kind int, name string, blobs array<binary>, a long, b long"
_COLUMNS = ["p", "kind", "name", "blobs", "a", "b"]
_ROW_ARROW = pa.schema(list(zip(_COLUMNS, [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.binary()), pa.int64(), pa.int64()], strict=True)))
_COUNTED, _COUNTED_ARROW = "p long, u binary, w binary, n binary", pa.schema([("p", pa.int64()), *((c, pa.binary()) for c in "uwn")])
_LOOKED = "name string, kind int, x binary, y binary, z binary"
_LOOKED_ARROW = pa.schema([("name", pa.string()), ("kind", pa.int32()), *((c, pa.binary()) for c in "xyz")])


def pack(x: np.ndarray) -> bytes:
    """Whole numbers of 0 and more as byte planes, as many as the greatest needs."""
    x = np.ascontiguousarray(x, "<u8")
    k = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([k]) + x.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : data[0]] = planes.T
    return wide.view("<i8").ravel()


def pack_rising(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=0))


def unpack_rising(data: bytes) -> np.ndarray:
    x = unpack(data)
    return np.cumsum(x, out=x)


def word_code(raw: str) -> int:
    """Code of a token's normal form, -1 where nothing but punctuation is left."""
    word = normal(raw)
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % ((1 << WORD_BITS) - 2) + 2 if word else -1


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.empty(len(u), np.uint64)
    for lo, hi in chunks(len(u), HASHED):
        out[lo:hi] = _mix(u[lo:hi].astype(np.uint64) * _ODD[0] + w[lo:hi].astype(np.uint64) * _ODD[1])
    return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    out = np.empty(len(keys), np.min_scalar_type(parts - 1))
    for lo, hi in chunks(len(keys), HASHED):
        out[lo:hi] = _mix(keys[lo:hi] ^ _ODD[2]) % np.uint64(parts)
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 0 and more in as few bytes as the greatest needs."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def short(keys: np.ndarray) -> np.ndarray:
    """What tells the sections of a part apart."""
    return (keys & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)


def edges(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    new = np.ones(len(sorted_) + 1, bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:-1])
    return np.flatnonzero(new)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[edges(x)[:-1]]


def groups(sorted_: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, where it stands) of sorted values."""
    cut = edges(sorted_)
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        yield int(sorted_[lo]), slice(lo, hi)


def by_range(words: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    yield from groups(words // ((1 << WORD_BITS) // ranges + 1))


def word_codes(tokens: list[str]) -> np.ndarray:
    """``word_code`` of each."""
    got, some = codes(tokens, xxhash.xxh3_64_intdigest)
    return np.where(some, (got % np.uint64((1 << WORD_BITS) - 2)).astype(np.int64) + 2, -1)


def pieces(texts) -> Iterator[list[str | None]]:
    """``texts`` in order, about LETTERS characters at a time; a text isn't cut."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= LETTERS:
            yield held
            held, size = [], 0
    if held:
        yield held


def bigrams(texts, memo: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first code, second code, its text's number) of each pair of neighbours; a text without words has none."""
    found = [flatten(piece, memo) for piece in pieces(texts)] or [flatten((), memo)]
    ids, sizes = map(np.concatenate, zip(*found, strict=True))
    del found
    some = ids >= 0
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[some]
    ids = ids[some]
    n = np.bincount(rows, minlength=len(sizes))
    have = np.flatnonzero(n)
    ends = np.cumsum(n[have])
    return np.insert(ids, ends - n[have], START), np.insert(ids, ends, END), np.repeat(have.astype(np.int32), n[have] + 1)


def log_stirling(most: int, d: float) -> np.ndarray:
    """log S_d(c, t): ways to seat c customers at t tables, weighted by (1 - d)(2 - d)... of each table."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        grow = np.where(c - t * d > 0, np.log(np.maximum(c - t * d, 1e-300)), -np.inf) + s[c, 1 : c + 2]
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c, : c + 1], grow)
    return s


_STIRLING = log_stirling(EXACT, DISCOUNT)


def draw_tables(c: np.ndarray, rest: np.ndarray, base: np.ndarray, rng: np.random.Generator, d: float = DISCOUNT, strength: float = STRENGTH) -> np.ndarray:
    """Tables of sections of c customers, where the restaurant's other sections have ``rest`` tables and the parent gives the dish ``base``."""
    t = np.minimum(c, 1).astype(np.int64)
    order = np.argsort(c, kind="stable")
    table_of = _STIRLING if d == DISCOUNT else log_stirling(EXACT, d)
    for n, at in groups(c[order]):
        if n < 2 or n > EXACT:
            continue
        rows, k = order[at], np.arange(1, n + 1)
        for lo, hi in chunks(len(rows), max(1, (1 << 19) // n)):
            r = rows[lo:hi]
            open_ = np.log(strength + d * (rest[r, None] + k - 1))
            p = table_of[n, 1 : n + 1] + np.cumsum(open_ + np.log(base[r])[:, None], 1)
            p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), 1)
            t[r] = 1 + (p < rng.random(len(r))[:, None] * p[:, -1:]).sum(1)
    large = np.flatnonzero(c > EXACT)
    for lo, hi in chunks(len(large), 2048):
        r = large[lo:hi]
        t[r] = _draw_large(c[r], strength + d * rest[r], base[r], rng, d)
    return t


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of 8 and more."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _draw_large(c: np.ndarray, start: np.ndarray, base: np.ndarray, rng: np.random.Generator, d: float) -> np.ndarray:
    """As ``draw_tables``, for sections too large for a table of Stirling numbers: P(t) is in proportion to
    S_d(c, t) * prod_{k < t} (start + d k) * base.

    S_d(c, t) is c! / t! times the coefficient of z^c in f(z)^t, f(z) = (1 - (1 - z)^d) / d. Where t is small beside c^d, its
    expansion in powers of (1 - z)^d is summed for every t; else the saddle point, z = 1 - e^L, gives the slope of
    log P, log f - log t + log((start + d t) base), which is integrated over a range of L around the mode.
    """

    def at(where: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(t, f) of the saddle point; t rises with L from 0 to c."""
        f = -np.expm1(d * where) / d
        return c * f / (-np.expm1(where) * np.exp((d - 1) * where)), f

    def solve(above: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """L up to which ``above(t, f)`` is false, by halves."""
        lo, hi = np.log(0.25 * d / c) / (1 - d), np.full(len(c), -1e-7)
        for _ in range(40):
            mid = (lo + hi) / 2
            up = above(*at(mid, c))
            lo, hi = np.where(up, lo, mid), np.where(up, mid, hi)
        return (lo + hi) / 2

    mode = at(solve(lambda t, f: f * (start + d * t) * base < t), c)[0]
    spread_ = 8 * np.sqrt(mode) + 10
    few = (mode + spread_ <= 400) & (mode + spread_ <= c**d)
    out = np.ones(len(c), np.int64)
    for rows in np.array_split(np.flatnonzero(few), max(1, int(few.sum()) // 256)):
        if len(rows):
            k = np.arange(1, int((mode + spread_)[rows].max()) + 1)
            n, q, total = c[rows, None].astype(float), np.ones((len(rows), len(k))), np.zeros((len(rows), len(k)))
            for j in range(1, 29):
                q = q * -((k - j + 1).clip(0)[None] / j)  # (-1)^j of k over j
                a = d * j
                if abs(a - round(a)) > 1e-9:  # 1 / gamma(-a) is 0 else
                    total += q * np.exp(_log_gamma(n - a) - _log_gamma(n - d)) / math.gamma(-a)
            log = np.log(np.maximum(total, 1e-300)) - np.cumsum(np.log(k))[None] - k[None] * np.log(d)
            log += np.cumsum(np.log(start[rows, None] + d * (k - 1)) + np.log(base[rows])[:, None], 1)
            p = np.cumsum(np.exp(log - log.max(1, keepdims=True)), 1)
            out[rows] = 1 + (p < rng.random(len(rows))[:, None] * p[:, -1:]).sum(1)
    many = ~few
    if many.any():
        low, high = np.maximum(mode - spread_, 0.5), np.minimum(mode + spread_, c)
        ends = solve(lambda t, f: t > low)[many], solve(lambda t, f: t > high)[many]
        where = ends[0][:, None] + (ends[1] - ends[0])[:, None] * np.linspace(0, 1, 97)[None]
        t, f = at(where, c[many, None])
        more = start[many, None] + d * t
        slope = np.log(f) - np.log(t) + np.log(more * base[many, None])
        step = np.diff(t, axis=1)
        log = np.concatenate([np.zeros((len(t), 1)), np.cumsum((slope[:, 1:] + slope[:, :-1]) / 2 * step, 1)], 1)
        y = np.exp(where)  # the saddle point's width, and what sums have beside their integrals
        width = (y / (1 - y) + 1 - d - d * y**d / (1 - y**d)) * (1 - y) / y
        log -= (np.log(np.maximum(width, 1e-300)) + np.log(t) + np.log(more)) / 2
        p = np.exp(log - log.max(1, keepdims=True))
        p = np.cumsum((p[:, 1:] + p[:, :-1]) / 2 * step, 1)
        want = rng.random(len(t)) * p[:, -1]
        cell = (p < want[:, None]).sum(1)
        i = np.arange(len(t))
        before = np.where(cell > 0, p[i, np.maximum(cell - 1, 0)], 0.0)
        share = (want - before) / np.maximum(p[i, cell] - before, 1e-300)
        out[many] = np.clip(np.rint(t[i, cell] + share * step[i, cell]), 1, c[many]).astype(np.int64)
    return out


def unigram(customers: np.ndarray, tables: np.ndarray, totals: tuple[int, int], size: int) -> np.ndarray:
    """Predictive probabilities of the parent. totals: its customers and tables in all; size: the words that have a dish."""
    return (customers - DISCOUNT * tables + (STRENGTH + DISCOUNT * totals[1]) / (size + 1)) / (STRENGTH + totals[0])


class Model:
    """sections: rows of each part; kind 0: [words, u, w, customers] of its sections in order of (u, w), 1: [sum of tables over the
    samples] of those of more than one customer, 2: from each range of codes, what is known of the part's words.
    lexicon: a row for each range of codes. totals: (customers, tables) of the parent in each sample. size: words with a dish."""

    def __init__(self, parts: int, sections: DataFrame, lexicon: DataFrame, totals: list[tuple[int, int]], size: int):
        self.parts, self.sections, self.lexicon, self.totals, self.size = parts, sections, lexicon, totals, size


def tasks_for(rows: DataFrame, parts: int) -> int:
    """As many as there are parts or shuffle partitions: byte sizes, by which partitions would be coalesced, say little of the work."""
    return min(parts, max(LEAST_PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def spread(rows: DataFrame, parts: int) -> DataFrame:
    """By p, as groups of p take it."""
    return rows.repartition(tasks_for(rows, parts), "p")


def evenly(rows: DataFrame, parts: int) -> DataFrame:
    """By p, the same number of parts in each task, since a task's rows of many parts may travel as one batch."""
    tasks = tasks_for(rows, parts)
    return rows.repartitionById(tasks, (F.col("p") % tasks).cast("int"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def _tables_of(row) -> tuple[np.ndarray, ...]:
    words, u, w, n, *rest = row
    return unpack_rising(words), unpack_rising(u), unpack(w), unpack(n), *map(unpack, rest)


def _count(parts: int):
    def flush(starts: list, ws: list) -> pd.DataFrame:
        w, start = np.concatenate(ws), np.concatenate(starts)
        ws.clear()
        words = distinct(np.append(w, START))  # what comes first in a pair is START or the second of the pair before
        second = np.searchsorted(words, w)
        del w
        pairs = np.roll(second, 1)
        pairs[start] = 0
        pairs <<= 32
        pairs |= second
        del second
        pairs.sort()
        cut = edges(pairs)
        pairs, n = pairs[cut[:-1]], narrow(np.diff(cut))
        del cut
        p = part_of(pair_keys(words[pairs >> 32], words[pairs & 0xFFFFFFFF]), parts)
        order = np.argsort(p, kind="stable")
        rows = []
        for k, at in groups(p[order]):
            r = order[at]
            rows.append((k, pack_rising(words[pairs[r] >> 32]), pack(words[pairs[r] & 0xFFFFFFFF]), pack(n[r])))
        return pd.DataFrame(rows, columns=["p", "u", "w", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, starts, ws, held = memo_of("words", word_code, word_codes), [], [], 0
        for b in batches:
            for lo, hi in chunks(len(b), COUNTED):
                u, w, _ = bigrams(b["text"].iloc[lo:hi], memo)
                starts.append(u == START)
                ws.append(w)
                held += len(u)
                del u, w
                if held >= HELD:
                    yield flush(starts, ws)
                    starts, ws, held = [], [], 0
        if held:
            yield flush(starts, ws)
        starts, ws = [], []
        give_back()

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    p = pdf["p"].iloc[0]
    u, w, n = (np.concatenate([f(x) for x in pdf[c]]) for c, f in (("u", unpack_rising), ("w", unpack), ("n", unpack)))
    words = distinct(np.concatenate([distinct(u), distinct(w)]))
    key = np.searchsorted(words, u)
    del u
    key <<= 32
    key |= np.searchsorted(words, w)
    del w
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    del order
    cut = edges(key)[:-1]
    key, n = key[cut], np.add.reduceat(n, cut)
    del cut
    blobs = [pack_rising(words), pack_rising(key >> 32), pack(key & 0xFFFFFFFF), pack(n)]
    del words, key, n
    give_back()
    return _frame([(p, 0, "", blobs, 0, 0)])


def _known(ranges: int):
    """Of every part's words: customers as context, tables and dishes of sections of one customer, which never change."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, blobs in zip(b["p"], b["blobs"], strict=True):
                words, u, w, n = _tables_of(blobs)
                one, size = n == 1, len(words)
                sums = [np.bincount(u, n, size).astype(np.int64), np.bincount(u[one], minlength=size), np.bincount(w[one], minlength=size)]
                yield _frame([(q, 1, str(p), [pack_rising(words[at]), *(pack(s[at]) for s in sums)], 0, 0) for q, at in by_range(words, ranges)])

    return run


def _lexicon(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [(unpack_rising(b[0]), *map(unpack, b[1:])) for b in pdf["blobs"]]
    words = distinct(np.concatenate([r[0] for r in rows]))
    sums = np.zeros((3, len(words)), np.int64)
    for own, *values in rows:
        sums[:, np.searchsorted(words, own)] += values
    return _frame([(pdf["p"].iloc[0], 0, "", [pack_rising(words), *map(pack, sums), pack(np.zeros(len(words), np.int64))], int((words != START).sum()), 0)])


def _first_seating(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for p, blobs in zip(b["p"], b["blobs"], strict=True):
            words, u, w, n = _tables_of(blobs)
            many = n > 1
            u, w, n = u[many], w[many], n[many]
            own = distinct(np.concatenate([u, w]))
            t = np.ones(len(n), np.int64)
            yield _frame([(p, 0, "", [pack_rising(words[own]), pack_rising(np.searchsorted(own, u)), pack(np.searchsorted(own, w)), pack(n), pack(t), pack(t - 1)], 0, 0)])


def _report(ranges: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, blobs in zip(b["p"], b["blobs"], strict=True):
                words, u, w, _, t, _ = _tables_of(blobs)
                sums = [np.bincount(k, t, len(words)).astype(np.int64) for k in (u, w)]
                yield _frame([(q, 1, str(p), [pack_rising(words[at]), *(pack(s[at]) for s in sums)], 0, 0) for q, at in by_range(words, ranges)])

    return run


def _update(sweep: int, others: int, size: int, keep: bool, seed: int):
    """A range's words after the parts' reports: their tables in the parent are drawn, and each part gets its words' totals.

    others: all words' tables in the last sweep. The new lexicon row carries (customers, tables) of the range in a and b.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, head = int(pdf["p"].iloc[0]), pdf.loc[pdf["kind"] == 0, "blobs"].iloc[0]
        words, ones, dishes, up = unpack_rising(head[0]), unpack(head[2]), unpack(head[3]), unpack(head[4])
        reports = [(name, np.searchsorted(words, unpack_rising(b[0])), unpack(b[1]), unpack(b[2])) for name, b in pdf.loc[pdf["kind"] == 1, ["name", "blobs"]].itertuples(index=False)]
        for _, at, tu, tw in reports:
            ones[at] += tu
            dishes[at] += tw
        up = np.minimum(np.maximum(up, np.minimum(dishes, 1)), dishes)
        rng = np.random.default_rng([seed, sweep, q, 1])  # a task that runs again draws the same
        up = draw_tables(dishes, np.maximum(others - up, 0), np.full(len(words), 1 / (size + 1)), rng)
        sample = [pack(x) for x in (ones, dishes, up)]
        rows = [(q, 0, "", [*head[:4], sample[2], *head[5:], *(sample if keep else [])], int(dishes.sum()), int(up.sum()))]
        rows += [(int(name), 2, f"{q:09d}", [pack(x[at]) for x in (ones, dishes, up)], 0, 0) for name, at, *_ in reports]
        del words, ones, dishes, up, reports
        give_back()
        return _frame(rows)

    return run


def _joined(replies: pd.DataFrame) -> list[np.ndarray]:
    """The ranges' replies to a part, one after the other."""
    return [np.concatenate(x) for x in zip(*([unpack(b) for b in blobs] for blobs in replies.sort_values("name")["blobs"]), strict=True)]


def _seat(sweep: int, totals: tuple[int, int], size: int, keep: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, row = int(pdf["p"].iloc[0]), pdf.loc[pdf["kind"] == 0, "blobs"].iloc[0]
        _, u, w, n, t, total = _tables_of(row)
        if len(n):
            tables, customers, up = _joined(pdf[pdf["kind"] == 2])
            base = unigram(customers, up, totals, size)
            t = draw_tables(n, tables[u] - t, base[w], np.random.default_rng([seed, sweep, p]))
            del tables, customers, up, base
        blobs = [*row[:4], pack(t), pack(total + t if keep else total)]
        del u, w, n, t, total
        give_back()
        return _frame([(p, 0, "", blobs, 0, 0)])

    return run


def _ask(ranges: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, blobs in zip(b["p"], b["blobs"], strict=True):
                words = unpack_rising(blobs[0])
                yield _frame([(q, 1, str(p), [pack_rising(words[at])], 0, 0) for q, at in by_range(words, ranges)])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    q, head = int(pdf["p"].iloc[0]), pdf.loc[pdf["kind"] == 0, "blobs"].iloc[0]
    words, known = unpack_rising(head[0]), [unpack(head[1]), *map(unpack, head[5:])]
    asked = ((name, np.searchsorted(words, unpack_rising(b[0]))) for name, b in pdf.loc[pdf["kind"] == 1, ["name", "blobs"]].itertuples(index=False))
    return _frame([(int(name), 2, f"{q:09d}", [pack(x[at]) for x in known], 0, 0) for name, at in asked])


def train(docs: DataFrame, burn: int = BURN, samples: int = SAMPLES, seed: int = 5) -> Model:
    """From column text of all of ``docs``. Null, empty and wordless texts count for nothing; an empty table's model is the base alone."""
    texts = docs.select(F.col("text").cast("string").alias("text")).dropna()
    parts = max(LEAST_PARTS, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    counted = texts.mapInArrow(in_arrow(_count(parts), COUNTED, _COUNTED_ARROW), _COUNTED)
    found, _ = written(spread(counted, parts).groupBy("p").applyInPandas(_merge, _ROW), "lm-sections")
    lexicon, words_at = written(spread(found.mapInArrow(in_arrow(_known(parts), 1, _ROW_ARROW), _ROW), parts).groupBy("p").applyInPandas(_lexicon, _ROW), "lm-words")
    size = lexicon.agg(F.sum("a")).first()[0] or 0
    state, state_at = written(found.mapInArrow(in_arrow(_first_seating, 1, _ROW_ARROW), _ROW), "lm-seating")
    others, totals = size, []
    spark = docs.sparkSession
    for sweep in range(burn + samples + 1):
        told = spread(lexicon.unionByName(state.mapInArrow(in_arrow(_report(parts), 1, _ROW_ARROW), _ROW)), parts).groupBy("p").applyInPandas(_update(sweep, others, size, sweep > burn, seed), _ROW)
        swept, new_at = written(told, "lm-words")
        remove(spark, words_at)  # no plan reads it any more
        words_at, lexicon = new_at, swept.filter("kind = 0")
        now = lexicon.agg(F.sum("a"), F.sum("b")).first()
        now = (now[0] or 0, now[1] or 0)
        others = now[1]
        if sweep > burn:
            totals.append(now)
        if sweep == burn + samples:
            break
        seated = spread(state.unionByName(swept.filter("kind = 2")), parts).groupBy("p").applyInPandas(_seat(sweep, now, size, sweep >= burn, seed), _ROW)
        state, new_at = written(seated, "lm-seating")
        remove(spark, state_at)
        state_at = new_at
    sums = state.select("p", F.lit(1).alias("kind"), "name", F.array(F.col("blobs")[5]).alias("blobs"), "a", "b")
    told = spread(lexicon.unionByName(found.mapInArrow(in_arrow(_ask(parts), 1, _ROW_ARROW), _ROW)), parts).groupBy("p").applyInPandas(_answer, _ROW)
    return Model(parts, found.unionByName(sums).unionByName(told), lexicon, totals, size)


class Part:
    """A part's sections for look-up: rising keys, with customers, mean tables, the context's customers and what the parent adds."""

    def __init__(self, own: list, sums: list, replies: list[list], totals: list[tuple[int, int]], size: int):
        words, u, w, n = _tables_of(own)
        many = n > 1
        n = narrow(n)
        customers, *drawn = (np.concatenate(x) for x in zip(*([unpack(b) for b in r] for r in replies), strict=True))
        parent = [(STRENGTH + DISCOUNT * tables, unigram(dishes, up, total, size)) for tables, dishes, up, total in zip(drawn[::3], drawn[1::3], drawn[2::3], totals, strict=True)]
        del drawn
        keys, back, context = np.empty(len(n), np.int64), np.zeros(len(n)), np.empty(len(n), narrow(customers).dtype)
        for lo, hi in chunks(len(n), HASHED):
            keys[lo:hi] = short(pair_keys(words[u[lo:hi]], words[w[lo:hi]]))
            context[lo:hi] = customers[u[lo:hi]]
            for of_u, of_w in parent:
                back[lo:hi] += of_u[u[lo:hi]] * of_w[w[lo:hi]]
        del words, u, w, customers, parent
        back /= len(totals)
        order = np.argsort(keys, kind="stable")
        self.keys, self.n, self.context, self.back = keys[order], n[order], context[order], back[order]
        del keys, n, context, back
        t = np.ones(len(many))
        t[many] = unpack(sums[0]) / len(totals)
        self.t = t[order]
        del t, many, order
        give_back()

    def predict(self, keys: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(the samples' mean predictive probability of each key, which keys are known). own: customers of each key's section
        to leave out, with as large a share of its tables."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        c, t, total = self.n[at].astype(float), self.t[at], self.context[at].astype(float)
        if own is not None:
            own = np.minimum(own, c)
            t, c, total = t * (1 - own / c), c - own, total - own
        return (c - DISCOUNT * t + self.back[at]) / (STRENGTH + total), known


def _tokens(parts: int, seen: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, task, k = memo_of("words", word_code, word_codes), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi in chunks(len(b), TEXTS):
                texts, name = b.iloc[lo:hi], f"{task:07d}-{k:07d}"
                k += 1
                u, w, rows = bigrams(texts["text"], memo)
                n, rows = np.bincount(rows, minlength=len(texts)), rows.astype("<u2")
                keys = pair_keys(u, w)
                p = part_of(keys, parts)
                if seen:
                    keys, u, w = short(keys), None, None
                order = np.argsort(keys if seen else u, kind="stable")
                order = order[np.argsort(p[order], kind="stable")]
                ids = np.array([int(i) if i is not None else 0 for i in texts["doc_id"]], np.int64)
                out = [(k % parts, 4, name, [ids.tobytes(), texts["doc_id"].notna().to_numpy().tobytes(), pack(n)], 0, 0)]
                for q, at in groups(p[order]):
                    r = order[at]
                    pairs = [pack_rising(keys[r])] if seen else [pack_rising(u[r]), pack(w[r])]
                    out.append((q, 3, name, [rows[r].tobytes(), *pairs], 0, 0))
                del u, w, rows, keys, order, p, texts
                yield _frame(out)
                del out
        give_back()

    return run


def _occurrences(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How often each key is in its row."""
    order = np.lexsort((rows, keys))
    new = np.concatenate([[True], (np.diff(keys[order]) != 0) | (np.diff(rows[order]) != 0)])
    group = np.cumsum(new) - 1
    out = np.empty(len(keys))
    out[order] = np.bincount(group)[group]
    return out


def _look_up(totals: list[tuple[int, int]], size: int, seen: bool):
    """Rows sorted by (p, kind, name): a part's sections, then the tokens of block after block. Of a block's tokens the sums of each
    text's logarithms; pairs that the model doesn't have are handed on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own, sums, replies, part = None, None, None, [], None
        for b in batches:
            out = []
            for p, kind, name, blobs in zip(b["p"], b["kind"], b["name"], b["blobs"], strict=True):
                if p != now:
                    now, own, sums, replies, part = p, None, None, [], None
                if kind == 0:
                    own = blobs
                elif kind == 1:
                    sums = blobs
                elif kind == 2:
                    replies.append(blobs)
                elif kind == 4:
                    out.append((name, 0, *blobs))
                else:
                    if part is None and own is not None:
                        part, own, sums, replies = Part(own, sums, replies, totals, size), None, None, []
                    rows = np.frombuffer(blobs[0], "<u2").astype(np.int64)
                    codes = None if seen else (unpack_rising(blobs[1]), unpack(blobs[2]))
                    keys = unpack_rising(blobs[1]) if seen else short(pair_keys(*codes))
                    if part is None:
                        known = np.zeros(len(keys), bool)
                    else:
                        q, known = part.predict(keys, _occurrences(keys, rows) if seen else None)
                        texts, place = np.unique(rows[known], return_inverse=True)
                        out.append((name, 1, pack(texts), np.bincount(place, np.log(np.maximum(q[known], 1e-300))).tobytes(), None))
                    if not known.all() and not seen:
                        out.append((name, 2, *(pack(x[~known]) for x in (rows, *codes))))
            yield pd.DataFrame(out, columns=["name", "kind", "x", "y", "z"])

    return run


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    head = pdf[pdf["kind"] == 0].iloc[0]
    ids, known = np.frombuffer(head["x"], np.int64), np.frombuffer(head["y"], bool)
    total = np.zeros(len(ids))
    for texts, logs in pdf.loc[pdf["kind"] == 1, ["x", "y"]].sort_values(["x", "y"]).itertuples(index=False):
        total[unpack(texts)] += np.frombuffer(logs, np.float64)
    for row, log in pdf.loc[pdf["kind"] == 3, ["row", "log"]].sort_values("row").itertuples(index=False):
        total[int(row)] += log
    doc = pd.array(ids, "Int64")
    doc[~known] = pd.NA
    return pd.DataFrame({"doc_id": doc, "tokens": unpack(head["z"]), "log_probability": total})


def _unknown_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for name, x, y, z in b[["name", "x", "y", "z"]].itertuples(index=False):
            yield pd.DataFrame({"name": name, "row": unpack(x), "u": unpack(y), "w": unpack(z)})


def _words(totals: list[tuple[int, int]], size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for head in b["blobs"]:
                customers, *drawn = [unpack(head[1]), *map(unpack, head[5:])]
                p = [unigram(drawn[3 * s + 1], drawn[3 * s + 2], total, size) for s, total in enumerate(totals)]
                yield pd.DataFrame({"code": unpack_rising(head[0]), "n": customers, "t": list(np.stack(drawn[::3], 1).astype(float)), "q": list(np.stack(p, 1))})

    return run


def _unseen(looked: DataFrame, model: Model) -> DataFrame:
    """(name, row, log): sums over the pairs that no section has, by joins with what is known of their words."""
    known = model.lexicon.mapInPandas(_words(model.totals, model.size), "code long, n long, t array<double>, q array<double>")
    pairs = looked.filter("kind = 2").mapInPandas(_unknown_pairs, "name string, row long, u long, w long")
    both = pairs.join(known.select(F.col("code").alias("u"), "n", "t"), "u", "left").join(known.select(F.col("code").alias("w"), "q"), "w", "left")
    fresh = [unigram(np.zeros(1), np.zeros(1), total, model.size)[0] for total in model.totals]
    t, q = F.coalesce("t", F.array(*[F.lit(0.0) for _ in fresh])), F.coalesce("q", F.array(*[F.lit(float(x)) for x in fresh]))
    back = F.aggregate(F.zip_with(t, q, lambda a, b: (F.lit(STRENGTH) + F.lit(DISCOUNT) * a) * b), F.lit(0.0), lambda a, b: a + b) / len(fresh)
    log = F.log(back / (F.lit(STRENGTH) + F.coalesce("n", F.lit(0))))
    return both.select("name", "row", log.alias("log")).groupBy("name", "row").agg(F.sum("log").alias("log"))


def score(docs: DataFrame, model: Model, seen: bool = False) -> DataFrame:
    """(doc_id, tokens, log_probability, perplexity) for every row of ``docs``; tokens counts the words and the text's end.

    seen: the model was trained on these rows, so each text is scored without its own occurrences of a pair of words.

    Null, empty and wordless texts: 0 tokens, log_probability 0, perplexity null. Null doc_ids stay null; repeated rows: a row
    each. Empty table: no rows. Pairs never seen have the parent's probability, words never seen the base's. Texts of any length are
    scored whole. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = rows.mapInArrow(in_arrow(_tokens(model.parts, seen), TEXTS, _ROW_ARROW), _ROW)
    met = evenly(model.sections.unionByName(tokens), model.parts).sortWithinPartitions("p", "kind", "name")
    looked = met.mapInArrow(in_arrow(_look_up(model.totals, model.size, seen), LOOKED, _LOOKED_ARROW), _LOOKED)
    if seen:
        found = looked.withColumn("row", F.lit(None).cast("long")).withColumn("log", F.lit(None).cast("double"))
    else:
        looked, _ = written(looked, "lm-scores")
        rest = _unseen(looked, model).select("name", F.lit(3).alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in "xyz"], "row", "log")
        found = looked.filter("kind < 2").withColumn("row", F.lit(None).cast("long")).withColumn("log", F.lit(None).cast("double")).unionByName(rest)
    summed = found.groupBy("name").applyInPandas(_gather, "doc_id long, tokens long, log_probability double")
    return summed.withColumn("perplexity", F.when(F.col("tokens") > 0, F.exp(-F.col("log_probability") / F.col("tokens"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs), seen=True)
