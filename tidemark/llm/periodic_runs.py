"""Periodic runs of words by recursive frequency splitting and a lag scan.

A run has a smallest period ``q`` and at least ``max(6, 4 * q)`` words, so each
of its words occurs at least four times in it. A word that occurs less often in
the current segment belongs to no run there and splits the segment; this is
repeated until nothing splits. Only the surviving segments are scanned.

The scan compares a segment with itself ``q`` words later, for every possible
lag ``q``, at the multiples of ``q`` only: the part of a run that matches its
continuation has ``3 * q`` words at least, so it holds three multiples. Compared
are the names of whole stretches of ``2**k <= q`` words (equal names, equal
stretches), so nearly all that match lie in runs; their ends are found by
the same names in falling powers of two. A segment of ``m`` words costs
``m log m`` comparisons and ``4 * log2(m)`` bytes of names a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value

ship_by_value(__name__)

LEAST_REPEATS = 4        # whole periods in a run, hence occurrences of each of its words
LEAST_WORDS = 6
BATCH_WORDS = 1 << 20    # words whose segments are scanned together (a longer text alone)
WHOLE_ROUNDS = 24        # splitting rounds over all segments before the stubborn ones are split one by one
RUN_FIELDS = "doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def repeat_tail(words: list, doc_id) -> list:
    """The words with a planted repetition, for the ids that the digest names: with
    ``h = crc32(doc_id)``, ``g = h // 10``, ``n`` words and ``h % 10 = 0``, word
    ``i >= a`` becomes word ``a + (i - a) % p``, ``a = g % n``, ``p = 1 + (n - a) // (3 + g % 8)``.
    A null id names nothing."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def _split_one(ids: list[int], lo: int, hi: int) -> list[tuple[int, int]]:
    """Stable segments of ``ids[lo:hi]``. Only the smaller pieces of a split are
    counted anew, the largest keeps its counter, so a word is counted a logarithmic
    number of times however many rounds the splitting takes."""
    done, work = [], [(lo, hi, Counter(ids[lo:hi]), None)]
    while work:
        lo, hi, counts, suspects = work.pop()
        if hi - lo < LEAST_WORDS:
            continue
        rare = {w for w in (counts if suspects is None else suspects) if 0 < counts[w] < LEAST_REPEATS}
        if not rare:
            done.append((lo, hi))
            continue
        where = rare_positions(ids, lo, hi, rare)
        edges = [lo - 1, *where, hi]
        pieces = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
        largest = max(pieces, key=lambda p: p[1] - p[0], default=None)
        touched = set()
        for a, b in pieces:
            if (a, b) == largest:
                continue
            own = Counter(ids[a:b])
            counts.subtract(own)
            touched |= own.keys()
            work.append((a, b, own, None))
        counts.subtract(ids[p] for p in where)
        if largest:
            work.append((*largest, counts, touched))
    return done


def rare_positions(ids: list[int], lo: int, hi: int, rare: set[int]) -> list[int]:
    part = np.asarray(ids[lo:hi])
    return (np.flatnonzero(np.isin(part, list(rare))) + lo).tolist()


def segments(ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Stretches ``[lo, hi)`` of the concatenated texts that may hold runs.

    ``ids`` are word numbers and ``doc`` the number of the text they stand in.
    """
    at = np.arange(len(ids))
    seg = doc.astype(np.int64)
    stable: list[tuple[int, int]] = []
    for _ in range(WHOLE_ROUNDS):
        if not len(at):
            return sorted(stable)
        order = np.lexsort((ids[at], seg))
        s, w = seg[order], ids[at][order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (w[1:] != w[:-1])))
        group = np.cumsum(new) - 1
        often = np.empty(len(at), bool)
        often[order] = np.bincount(group)[group] >= LEAST_REPEATS
        split = np.zeros(int(seg.max()) + 1, bool)
        split[seg[~often]] = True
        calm = ~split[seg]
        stable += _stretches(at[calm], seg[calm])
        go = often & ~calm
        at, old = at[go], seg[go]
        if not len(at):
            return sorted(stable)
        cut = np.concatenate(([True], (old[1:] != old[:-1]) | (np.diff(at) != 1)))
        seg = np.cumsum(cut) - 1
        long = np.bincount(seg)[seg] >= LEAST_WORDS
        at, seg = at[long], seg[long]
        if len(seg):
            seg = np.cumsum(np.concatenate(([True], seg[1:] != seg[:-1]))) - 1
    listed = ids.tolist()
    for lo, hi in _stretches(at, seg):
        stable += _split_one(listed, lo, hi)
    return sorted(stable)


def _stretches(at: np.ndarray, seg: np.ndarray) -> list[tuple[int, int]]:
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return [(int(a), int(b) + 1) for a, b in zip(at[first], at[last], strict=True) if b - a + 1 >= LEAST_WORDS]


def _names(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """``names[k][p]`` names the stretch of ``2**k`` words at ``p``; up to stretches of
    ``longest`` words or until none occurs twice."""
    out = [np.unique(x, return_inverse=True)[1].astype(np.int32)]
    size = 1
    while 2 * size <= longest:
        low = out[-1]
        both = low[:-size].astype(np.int64) * (int(low.max()) + 1) + low[size:]
        kinds, name = np.unique(both, return_inverse=True)
        if len(kinds) == len(both):
            break
        out.append(name.astype(np.int32))
        size *= 2
    return out


def lag_scan(x: np.ndarray, longest: int) -> np.ndarray:
    """All runs of ``x`` as rows ``(start, end, period)``; ``longest`` bounds a run's length."""
    names, m, found = _names(x, longest), len(x), []
    known_end, known_period = np.zeros(m, np.int64), np.ones(m, np.int64)  # a long run found at each place
    for k in range(min(len(names), (longest // LEAST_REPEATS).bit_length())):
        lags = np.arange(1 << k, min(2 << k, longest // LEAST_REPEATS + 1))
        usable = len(names[k]) - 2 * lags  # starts p whose stretches at p, p + q and p + 2q lie inside
        lags, usable = lags[usable > 0], usable[usable > 0]
        if not len(lags):
            continue
        many = -(-usable // lags)
        q = np.repeat(lags, many)
        p = (np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)) * q
        name = names[k]
        hit = (name[p] == name[p + q]) & (name[p + q] == name[p + 2 * q])
        hit &= (known_end[p] < p + 2 * q) | (q % known_period[p] > 0)  # a multiple of a known run's period spans that run
        p, q = p[hit], q[hit]
        end, start = p.copy(), p.copy()
        for j in range(len(names) - 1, -1, -1):  # each power once: a match is shorter than twice the largest
            name, size = names[j], 1 << j
            for _ in range(2):  # the largest twice at most, when the names ended early
                fits = end + q + size <= m
                at = np.where(fits, end, 0)
                end = np.where(fits & (name[at] == name[np.where(fits, end + q, 0)]), end + size, end)
                fits = start >= size
                at = np.where(fits, start - size, 0)
                start = np.where(fits & (name[at] == name[np.where(fits, start + q - size, 0)]), start - size, start)
        end = end + q
        good = end - start >= np.maximum(LEAST_WORDS, LEAST_REPEATS * q)
        if good.any():
            found.append(np.unique(np.stack([start[good], end[good], q[good]], axis=1), axis=0))
            for a, b, lag in sorted(found[-1].tolist(), key=lambda r: r[1] - r[0]):
                known_end[a:b], known_period[a:b] = b, lag
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    smallest = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))  # multiples of a period span the same words
    return rows[smallest]


def find_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """Per text its runs ``(start, length, period)`` by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    ids = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    segs = segments(ids, doc)
    if not segs:
        return out
    lengths = np.array([b - a for a, b in segs])
    x, own = [], int(ids.max()) + 1
    for i, (a, b) in enumerate(segs):  # a separator of its own after each segment: no match reaches over it
        x += [ids[a:b], np.array([own + i])]
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    for start, end, period in lag_scan(np.concatenate(x), int(lengths.max())).tolist():
        s = int(np.searchsorted(begins, start, "right")) - 1
        at = segs[s][0] + start - int(begins[s])
        d = int(doc[at])
        out[d].append((at - int(first[d]), end - start, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run repeats after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _run_batches(planted: bool):
    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = find_runs(texts)
        return pa.RecordBatch.from_arrays([
            ids, pa.array([len(t) for t in texts], pa.int64()),
            pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs],
                     pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))),
            pa.array([collapse(t, r).decode("utf-8", "replace") for t, r in zip(texts, runs, strict=True)], pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, held, begin = [], 0, 0
            for i, (d, raw) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)):
                words = (raw or b"").split()
                texts.append(repeat_tail(words, d) if planted else words)
                held += len(words)
                if held >= BATCH_WORDS:
                    yield rows(b.column("doc_id").slice(begin, i + 1 - begin), texts)
                    texts, held, begin = [], 0, i + 1
            if texts:
                yield rows(b.column("doc_id").slice(begin), texts)
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """Periodic runs of every whole text, and the text without their repeats.

    Returns ``doc_id, n_words, runs (start, length, period; words from 0), collapsed``
    a row, in one pass without a shuffle. Words are stretches without ASCII white
    space. Null, empty and blank texts have no words, no runs and an empty
    collapsed text; null ids stay null; repeated rows are rows of their own; no
    rows give no rows; other columns are not read. ``planted`` first plants the
    repetitions of ``repeat_tail``.
    """
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = light.schema["doc_id"].dataType.simpleString()
    return light.mapInArrow(_run_batches(planted), RUN_FIELDS.format(kind=kind))


def run_digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of the runs and of the collapsed text of ``periodic_runs`` rows.

    Of runs of equal length the one with the smallest start, then period, counts
    as longest; without runs its four columns are null.
    """
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    some = F.when(F.size("runs") > 0, best)
    return (found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), some.alias("_b"),
                         F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", F.col("_b.start").alias("start"), (-F.col("_b.n")).alias("length"),
                    F.col("_b.period").alias("period"),
                    F.expr("cast((-1000 * _b.n) div _b.period as bigint)").alias("exponent_milli"),
                    "runs_sha256", "collapsed_sha256"))
