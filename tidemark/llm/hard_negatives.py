"""Hard negatives by rotated one-bit codes.

Vectors are made whole numbers, rotated at random and coded by the signs of
their components. What a code leaves is coded again, so a vector is a few
codes, the alignment stored with each (its inner product with what it codes)
and the length of the rest. The inner product of two vectors is estimated
from popcounts of their codes; the Cauchy-Schwarz inequality on the rests
bounds the error, so an interval holds the true score for certain. Rows whose
interval cannot reach an anchor's best ones go; the rest are scored in whole
numbers, and only these scores decide.

Anchors are a stated query set that meets all rows in blocks, slice by slice, twice: for
their positives and then, with the positives' scores known, for the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.llm.blocks import Best, batch_of, batches_of, cell_files, matrix, met, pack, vector_columns
from tidemark.llm.support import operator_conf, scratch, shuffle_width

ship_by_value(__name__)

CELL_ROWS = 4096
ANCHOR_BLOCK = 256
CODES = 6              # one-bit codes of a vector
STEPS = (3, 6)         # codes that each filter uses; the first one looks at all rows
EXACT = 1 << 53        # products below this are whole numbers in a double
LONGEST = (1 << 63) - 1


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of the rows of ``x``: ``bits (codes, rows, words)``, ``align (codes, rows)``
    and ``rest (codes, rows)``, the length of what is left after each code."""

    def __init__(self, x: np.ndarray, codes: int, seed: int):
        left = x @ rotation(x.shape[1], seed)
        self.dim, self.norm = x.shape[1], np.sqrt((x * x).sum(axis=1))
        bits, align, rest = [], [], []
        unit = 1 / np.sqrt(self.dim)
        for _ in range(codes):
            up = left > 0
            sign = np.where(up, unit, -unit)
            a = (left * sign).sum(axis=1)
            left = left - a[:, None] * sign
            wide = np.zeros((len(x), -(-self.dim // 64) * 64), bool)
            wide[:, :self.dim] = up
            bits.append(np.packbits(wide, axis=1).view(np.uint64))
            align.append(a)
            rest.append(np.sqrt((left * left).sum(axis=1)))
        self.bits, self.align, self.rest = np.stack(bits), np.stack(align), np.stack(rest)


def _agree(a: np.ndarray, b: np.ndarray, dim: int) -> np.ndarray:
    """Inner products of unit codes whose words lie in the last axis."""
    apart = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int32)
    for w in range(1, a.shape[-1]):
        apart += np.bitwise_count(a[..., w] ^ b[..., w])
    return 1.0 - apart * (2.0 / dim)


def _along(q: Codes, v: Codes, who, what, i: int) -> np.ndarray:
    """``<q', c_i>``: what the query's codes say of its inner product with code ``i`` of the rows."""
    t = 0.0
    for j in range(len(q.bits)):
        t = t + q.align[j][who] * _agree(q.bits[j][who], v.bits[i][what], q.dim)
    return t


def _bounds(q: Codes, v: Codes, who, what, estimate: np.ndarray, last: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """An interval around ``estimate`` (codes 0 to ``i``) that holds the true inner product.

    ``<q, v> = <q', v'> + <q', r> + <s, v>`` with the rests ``r`` of the row and ``s`` of the
    query; ``r`` is orthogonal to the row's code ``i``, along which ``q'`` has the length ``last``.
    """
    s = q.rest[-1][who]
    known = q.norm[who] + s  # at least the length of q'
    across = np.sqrt(np.maximum(known * known - last * last, 0))
    wide = across * v.rest[i][what] + s * v.norm[what]
    wide = wide + 1e-9 * (q.norm[who] * v.norm[what]) + 1.0  # rounding in double precision
    low, high = estimate - wide, estimate + wide
    low, high = np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)
    return np.clip(low, -float(LONGEST), float(LONGEST)), np.clip(high, -float(LONGEST), float(LONGEST))  # as scores are


def whole_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers (held in doubles), exact; beyond a long its bounds."""
    size = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    if size < EXACT:
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    out = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q.tolist(), v.tolist(), strict=True)]
    return np.array([max(-LONGEST, min(LONGEST, s)) for s in out], np.int64)


def _kth_low(who: np.ndarray, low: np.ndarray, slots: int, k: int) -> np.ndarray:
    """The ``k``-th largest ``low`` of each slot, minus infinity where there are fewer."""
    order = np.lexsort((-low, who))
    who, low = who[order], low[order]
    first = np.searchsorted(who, np.arange(slots))
    at = first + k - 1
    there = at < np.searchsorted(who, np.arange(slots), "right")
    return np.where(there, low[np.minimum(at, max(len(low) - 1, 0))] if len(low) else -np.inf, -np.inf)


def _filtered(q: Codes, v: Codes, allowed: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(slot-wise anchor, row)`` of ``allowed`` that may be among the ``k`` best of a slot.

    ``floor`` and ``ceiling`` ``(anchors, slots)``: scores wanted in a slot; a slot with
    ``floor > ceiling`` wants none.
    """
    anchors, slots = floor.shape
    want = floor <= ceiling
    least = np.where(want, floor, np.inf).min(axis=1)
    most = np.where(want, ceiling, -np.inf).max(axis=1)
    dense = (np.arange(anchors)[:, None], np.arange(len(v.norm))[None, :])
    estimate = np.zeros(allowed.shape)
    for i in range(STEPS[0]):
        along = _along(q, v, *dense, i)
        estimate += v.align[i][None, :] * along
    low, high = _bounds(q, v, *dense, estimate, along, STEPS[0] - 1)
    who, what = np.nonzero(allowed & (high >= least[:, None]) & (low <= most[:, None]))
    estimate = estimate[who, what]
    for step in range(1, len(STEPS)):
        for i in range(STEPS[step - 1], STEPS[step]):
            along = _along(q, v, who, what, i)
            estimate = estimate + v.align[i][what] * along
        low, high = _bounds(q, v, who, what, estimate, along, STEPS[step] - 1)
        keep = np.zeros(len(who), bool)
        for j in range(slots):
            sure = (low >= floor[who, j]) & (high <= ceiling[who, j])
            bar = np.maximum(floor[:, j], _kth_low(who[sure], low[sure], anchors, k))
            keep |= (high >= bar[who]) & (low <= ceiling[who, j]) & want[who, j]
        who, what, estimate = who[keep], what[keep], estimate[keep]
    return who, what


def _cell(dtype: str, seed: int):
    def row(table: pa.Table) -> dict:
        x = np.floor(256 * matrix(table.column("vec").combine_chunks(), dtype).astype(np.float64))
        with np.errstate(over="ignore", invalid="ignore"):
            c = Codes(x, CODES, seed)
        return {"n": len(x), "ids": table.column("id").to_numpy().tobytes(), "labels": table.column("label").to_numpy().tobytes(),
                "x": x.tobytes(), "bits": c.bits.tobytes(), "align": c.align.tobytes(), "rest": c.rest.tobytes(), "norm": c.norm.tobytes()}
    return row


CELL = "dim int, number bigint, n int, ids binary, labels binary, x binary, bits binary, align binary, rest binary, norm binary"


def _unpacked(r: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, Codes]:
    n, dim = r[prefix + "n"], r["dim"]
    c = Codes.__new__(Codes)
    c.dim = dim
    c.bits = np.frombuffer(r[prefix + "bits"], np.uint64).reshape(CODES, n, -1)
    c.align, c.rest = (np.frombuffer(r[prefix + f], np.float64).reshape(CODES, n) for f in ("align", "rest"))
    c.norm = np.frombuffer(r[prefix + "norm"], np.float64)
    return (np.frombuffer(r[prefix + "ids"], np.int64), np.frombuffer(r[prefix + "labels"], np.int64),
            np.frombuffer(r[prefix + "x"], np.float64).reshape(n, dim), c)


FOUND = "number bigint, worth binary, ids binary, filled binary"
BEST = "a_number bigint, p_worth binary, p_ids binary, p_filled binary"
OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _mine(positives: int, negatives: int | None, low: int, high: int):
    """Task code: the best rows of every anchor, same label (``negatives`` None) or another one."""
    def run(cells: Iterator[dict], blocks: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Best] = {}
        for cell in cells:
            ids, labels, x, v = _unpacked(cell)
            for r in blocks.get(cell["dim"], []):
                a_ids, a_labels, a_x, q = _unpacked(r, "a_")
                n = len(a_ids)
                slots, k = (1, positives) if negatives is None else (positives, negatives)
                best = held.setdefault(r["a_number"], Best(n * slots, k, np.int64))
                floor, ceiling = np.full((n, slots), -np.inf), np.full((n, slots), np.inf)
                if negatives is None:
                    allowed = (a_labels[:, None] == labels) & (a_ids[:, None] != ids)
                else:
                    allowed = a_labels[:, None] != labels
                    p = np.frombuffer(r["p_worth"], np.int64).reshape(n, slots)
                    there = np.frombuffer(r["p_filled"], bool).reshape(n, slots)
                    floor, ceiling = np.where(there, p * (low / high), np.inf), np.where(there, p, -np.inf)
                    floor = floor - np.where(there, np.abs(floor) * 1e-9 + 1, 0)
                full = best.filled[:, -1].reshape(n, slots)
                bar = np.maximum(floor, np.where(full, best.worth[:, -1].reshape(n, slots), -np.inf))
                with np.errstate(over="ignore", invalid="ignore"):
                    who, what = _filtered(q, v, allowed, bar, ceiling, k)
                score = np.concatenate([whole_scores(a_x[who[i:i + 65536]], x[what[i:i + 65536]]) for i in range(0, len(who), 65536)]
                                       or [np.zeros(0, np.int64)])
                for j in range(slots):
                    fits = np.ones(len(who), bool) if negatives is None else there[who, j] & _in_band(score, p[who, j], low, high)
                    best.add(who[fits] * slots + j, score[fits], ids[what[fits]])
        yield from batches_of(({"number": n} | best.packed() for n, best in held.items()), FOUND)
    return run


def _in_band(score: np.ndarray, positive: np.ndarray, low: int, high: int) -> np.ndarray:
    """``low * positive <= high * score <= high * positive`` without overflow."""
    if max(np.abs(score).max(initial=0), np.abs(positive).max(initial=0)) < (1 << 53) // max(low, high):
        return (low * positive <= high * score) & (score <= positive)
    both = zip(score.tolist(), positive.tolist(), strict=True)
    return np.array([low * p <= high * s <= high * p for s, p in both], bool)


def _merged(k: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        best = Best(len(rows[0]["ids"]) // (8 * k), k, np.int64)
        for r in rows:
            best.merge(r)
        row = {"a_number": rows[0]["number"]} | {f"p_{f}": v for f, v in best.packed().items()}
        return pa.Table.from_batches([batch_of([row], BEST)])
    return run


def _listed(positives: int, negatives: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a = np.frombuffer(r["a_ids"], np.int64)
                p_ids, p = (np.frombuffer(r[f], np.int64).reshape(len(a), positives) for f in ("pos_ids", "pos_worth"))
                ids, worth = (np.frombuffer(r[f], np.int64).reshape(len(a), positives, negatives) for f in ("p_ids", "p_worth"))
                who, j, rank = np.nonzero(np.frombuffer(r["p_filled"], bool).reshape(ids.shape))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (a[who], p_ids[who, j], (rank + 1).astype(np.int32), ids[who, j, rank], p[who, j], worth[who, j, rank])],
                    ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])
    return run


def mine_hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                        id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 13) -> DataFrame:
    """Hard negatives of the rows that meet ``anchors``, for each of their positives.

    Components count as ``floor(256 * x)``, scores are integer inner products; higher
    scores come first, ties by smaller id. An anchor's positives are its first
    ``positives`` other rows of the same label (a whole number), its negatives for one of
    them the first ``negatives`` rows of other labels with ``low * positive_score <=
    high * score <= high * positive_score``. Returns ``anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score``; the result is exact.

    Rows with a null id or label, a null or empty vector, null or non-finite
    components, or components beyond a double once multiplied, take no part. Zero
    vectors do. Only vectors of one length meet. Rows with an anchor's id are never its
    positives; repeated rows are candidates of their own, repeated anchors one anchor.
    Scores beyond a long count as its bounds. No rows give no rows.
    """
    spark = vectors.sparkSession
    usable, dtype = vector_columns(vectors, id_col, vector_col, label=F.col(label_col).cast("bigint"), _anchor=F.coalesce(anchors, F.lit(False)))
    usable = usable.where(F.col("label").isNotNull() & F.forall("vec", lambda x: F.abs(x.cast("double")) < 2.0 ** 1015)).withColumn("dim", F.size("vec"))
    with scratch(spark, "negatives") as s, operator_conf(spark):
        rows = s.table(usable, "rows")
        count, asked = rows.agg(F.count("*"), F.count_if("_anchor")).first()
        if not asked:
            return spark.createDataFrame([], OUT)
        files = cell_files(-(-count // CELL_ROWS), shuffle_width(spark))
        some = rows.select("id", "label", "vec", "dim")
        cells = s.table(some.repartition(files).mapInArrow(pack(CELL_ROWS, CELL, _cell(dtype, seed)), CELL), "cells")
        own = rows.where("_anchor").select("id", "label", "vec", "dim").distinct().repartition(-(-asked // (8 * ANCHOR_BLOCK)), "id")
        blocks = s.table(own.mapInArrow(pack(ANCHOR_BLOCK, CELL, _cell(dtype, seed)), CELL), "anchors")
        blocks = blocks.select("dim", *[F.col(c).alias(f"a_{c}") for c in blocks.columns if c != "dim"])
        near = met(s, cells, blocks, "a_number", _mine(positives, None, low, high), FOUND, "near")
        near = s.table(near.groupBy("number").applyInArrow(_merged(positives), BEST), "positives")
        known = s.table(blocks.join(near.hint("merge"), "a_number"), "known")  # a light file may hold many blocks: not by broadcast
        far = met(s, cells, known, "a_number", _mine(positives, negatives, low, high), FOUND, "far")
        far = s.table(far.groupBy("number").applyInArrow(_merged(negatives), BEST), "negatives")
        both = known.select("a_number", "a_ids", F.col("p_ids").alias("pos_ids"), F.col("p_worth").alias("pos_worth")).join(far.hint("merge"), "a_number")
        return s.table(both.mapInArrow(_listed(positives, negatives), OUT), "result", keep=True)
