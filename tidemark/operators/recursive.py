"""A linear learner that moves with every row: least squares with forgetting.

The state after a row is ``S = f S + x x'`` and ``v = f v + y x``; a row is predicted from the
state before it by ``x' (S + l2 I)^-1 v``. Such maps compose, so the state is a fold of matrix maps
at two levels: each range bucket of the stream adds up its own part, one matrix a bucket;
these, at most one a bucket and hence bounded, are composed on the driver into the state at
each bucket's start; then every bucket is scanned from its start. No row is left out however
old, and no task sees more than its bucket.

Inside a bucket rows come in chunks: their states are one cumulative sum, all
systems of a chunk are solved together. The bucket parts and the scan use the same steps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.plans.ordering import BUCKET, Sequenced

ship_by_value(__name__)

CHUNK = 256  # rows whose states are held together
LEAST_POWER = -250.0  # a chunk's weights span at most exp(-this); fast forgetting takes shorter chunks


def chunk_rows(forget: float) -> int:
    return CHUNK if forget == 1.0 else max(1, min(CHUNK, int(LEAST_POWER / np.log(forget))))


def design(pdf: pd.DataFrame, features: Sequence[str], y: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``x`` with a leading 1, the targets, and which rows are learned. Absent features count as 0."""
    x = np.column_stack([np.ones(len(pdf)), *[pd.to_numeric(pdf[f]).to_numpy(np.float64, na_value=np.nan) for f in features]])
    t = pd.to_numeric(pdf[y]).to_numpy(np.float64, na_value=np.nan)
    return np.nan_to_num(x, nan=0.0), np.nan_to_num(t, nan=0.0), ~np.isnan(t)


def states(s: np.ndarray, x: np.ndarray, t: np.ndarray, learned: np.ndarray, forget: float) -> np.ndarray:
    """The states before each row and after the last, ``s`` first. ``s`` is ``[S | v]``, ``p`` by ``p + 1``."""
    k = np.concatenate(([0], np.cumsum(learned)))  # rows learned so far: unlearned ones forget nothing
    row = x[:, :, None] * np.concatenate((x, t[:, None]), axis=1)[:, None, :]
    row = np.where(learned[:, None, None], row, 0.0) * np.power(forget, -k[1:].astype(np.float64))[:, None, None]
    sums = np.concatenate((s[None], s[None] + np.cumsum(row, axis=0)))
    return sums * np.power(forget, k.astype(np.float64))[:, None, None]


def _by_bucket(pdf: pd.DataFrame):
    at = np.flatnonzero(np.diff(pdf[BUCKET].to_numpy())) + 1
    for lo, hi in zip([0, *at], [*at, len(pdf)], strict=True):
        if hi > lo:
            yield int(pdf[BUCKET].iloc[lo]), pdf.iloc[lo:hi]


def bucket_parts(seq: Sequenced, features: Sequence[str], y: str, forget: float) -> dict[int, tuple[int, np.ndarray]]:
    """Each bucket's learned rows and the state that it alone gives: one matrix a bucket."""
    p, features, step = len(features) + 1, list(features), chunk_rows(forget)

    def part(batches):
        own: dict[int, tuple[int, np.ndarray]] = {}
        for pdf in batches:
            for b, rows in _by_bucket(pdf):
                n, s = own.get(b, (0, np.zeros((p, p + 1))))
                x, t, learned = design(rows, features, y)
                for a in range(0, len(x), step):
                    s = states(s, x[a:a + step], t[a:a + step], learned[a:a + step], forget)[-1]
                own[b] = (n + int(learned.sum()), s)
        yield pd.DataFrame({"b": pd.Series(list(own), dtype="int64"), "n": pd.Series([n for n, _ in own.values()], dtype="int64"),
                            "s": pd.Series([s.ravel().tolist() for _, s in own.values()], dtype=object)})

    rows = seq.df.select(BUCKET, *features, y).mapInPandas(part, "b long, n long, s array<double>").collect()
    return {r["b"]: (r["n"], np.array(r["s"]).reshape(p, p + 1)) for r in rows}


def starts(parts: dict[int, tuple[int, np.ndarray]], p: int, forget: float) -> dict[int, np.ndarray]:
    """The state at each bucket's start: earlier parts, forgotten by the rows learned since."""
    s, out = np.zeros((p, p + 1)), {}
    for b in sorted(parts):
        out[b] = s
        n, own = parts[b]
        s = s * forget ** n + own
    return out


def recursive_least_squares(seq: Sequenced, features: Sequence[str], y: str = "target", forget: float = 0.999, l2: float = 1.0,
                            name: str = "prediction") -> Sequenced:
    """Adds to every row the prediction of the learner as of the rows before it.

    Weights are ``forget`` to the number of labelled rows since; ``l2`` (positive) stays as it is. Rows without a
    target (null or NaN) are predicted and not learned; the first row is predicted as 0.
    """
    if not (0 < forget <= 1 and l2 > 0):
        raise ValueError("0 < forget <= 1 and l2 > 0")
    features, p, step = list(features), len(features) + 1, chunk_rows(forget)
    begin = starts(bucket_parts(seq, features, y, forget), p, forget)
    shared = seq.df.sparkSession.sparkContext.broadcast(begin)  # buckets x p x (p + 1) numbers
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in seq.df.schema), f"`{name}` double"])
    ridge = l2 * np.eye(p)

    def scan(batches):
        at, s = None, None
        for pdf in batches:
            preds = []
            for b, rows in _by_bucket(pdf):
                if b != at:
                    at, s = b, shared.value[b]
                x, t, learned = design(rows, features, y)
                for a in range(0, len(x), step):
                    every = states(s, x[a:a + step], t[a:a + step], learned[a:a + step], forget)
                    now, s = every[:-1], every[-1]
                    w = np.linalg.solve(now[:, :, :p] + ridge, now[:, :, p:])
                    preds.append((x[a:a + step, :, None] * w).sum(axis=(1, 2)))
            if preds:
                yield pdf.assign(**{name: np.concatenate(preds)})

    return seq.with_df(seq.df.mapInPandas(scan, schema))
