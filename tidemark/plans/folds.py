"""Per-key folds of affine maps along the stream order.

An exponentially weighted mean over a key's labels applies ``v -> q v + a y``
once a label. Such maps compose to ``v -> q**n v + A``, so the fold is done at
two levels like the other running aggregates: inside each range bucket, row by
row, and then over the buckets of a key. Nothing is cut off: a label counts
however far back it lies, and the cost does not depend on the decay.

Spark's windows have no recurrences, so both levels scan sorted rows in Arrow
batches. A batch is scanned by doubling steps in numpy (all keys at once); the
state of the keys of a bucket is carried to the next batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.shipping import ship_by_value
from tidemark.plans.ordering import BUCKET, Sequenced, _null_safe_join, materialize

ship_by_value(__name__)


def scan_maps(mult: np.ndarray, add: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive composition of maps ``v -> mult v + add`` within runs of rows;
    ``pos`` is a row's place in its run."""
    mult, add = mult.copy(), add.copy()
    step, longest = 1, int(pos.max(initial=0))
    while step <= longest:
        at = np.flatnonzero(pos >= step)
        add[at] = mult[at] * add[at - step] + add[at]
        mult[at] = mult[at] * mult[at - step]
        step *= 2
    return mult, add


def _scan(key: str, prefix: str, items: Sequence[str], alphas: Sequence[float]):
    """Batches sorted by key and order -> the state before each row: count, sum,
    first value and one ``A`` per alpha. ``items`` names the columns of a row's own
    count, sum, first value and ``A``s."""
    def run(batch: pa.RecordBatch, carried: dict) -> list[pa.Array]:
        coded = batch.column(key).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        names = coded.dictionary.to_pylist()
        own = [np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64), nan=np.nan) for c in items]
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        n, total, first, *adds = (x[order] for x in own)
        start = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        end = np.append(start[1:], len(codes)) - 1
        run_of = np.cumsum(np.isin(np.arange(len(codes)), start)) - 1
        pos = np.arange(len(codes)) - start[run_of]
        has = n > 0
        blank = (0.0, 0.0, 0.0, *(0.0 for _ in alphas))
        before = np.array([carried.get(names[c], blank) for c in codes[start]], np.float64).reshape(len(start), -1)
        one = np.ones(len(codes))

        def exclusive(mult, add, seed):
            m, a = scan_maps(mult, add, pos)
            whole = m * seed[run_of] + a
            prior = np.concatenate(([0.0], whole[:-1]))
            prior[start] = seed
            return prior, whole

        n_prior, n_all = exclusive(one, np.where(has, n, 0.0), before[:, 0])
        s_prior, s_all = exclusive(one, np.where(has, total, 0.0), before[:, 1])
        # a run's first value: the carried one, or that of its first row with labels (later rows leave it)
        f_prior, f_all = exclusive(np.where(has & (n_prior == 0), 0.0, 1.0), np.where(has & (n_prior == 0), first, 0.0), before[:, 2])
        out, last = [n_prior, s_prior, f_prior], [n_all, s_all, f_all]
        for k, (a, add) in enumerate(zip(alphas, adds, strict=True)):
            prior, whole = exclusive(np.where(has, (1.0 - a) ** np.where(has, n, 0.0), 1.0), np.where(has, add, 0.0), before[:, 3 + k])
            out.append(prior)
            last.append(whole)
        carried.update(zip([names[c] for c in codes[start]], np.stack(last, axis=1)[end].tolist(), strict=True))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return [pa.array(out[0][back].astype(np.int64)), *(pa.array(x[back]) for x in out[1:])]

    return run


def _state_names(prefix: str, horizons: Sequence[str]) -> list[str]:
    return [f"{prefix}_n", f"{prefix}_s", f"{prefix}_f", *(f"{prefix}_a_{h}" for h in horizons)]


def _key_text(keys: Sequence[str], *more: str) -> Column:
    """One-to-one text of the key values, nulls included."""
    return F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate([*more, *keys])]))


def _scanned(df: DataFrame, groups: Mapping[str, tuple[str, Sequence[str]]], alphas: Mapping[str, float], keep_last_key: bool) -> DataFrame:
    """``groups``: output prefix -> (key text column, item columns). Partitions must
    be sorted so that each key's rows are in order."""
    horizons = list(alphas)
    scans = {p: _scan(key, p, items, list(alphas.values())) for p, (key, items) in groups.items()}
    extra = [T.StructField(c, T.LongType() if i == 0 else T.DoubleType()) for p in groups for i, c in enumerate(_state_names(p, horizons))]
    schema = T.StructType([*df.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: dict[str, dict] = {p: {} for p in scans}
        for b in batches:
            if b.num_rows == 0:
                continue
            new = [x for p, scan in scans.items() for x in scan(b, carried[p])]
            if keep_last_key:  # rows are sorted by key: only the last one can go on
                for p, (key, _) in groups.items():
                    last = b.column(key)[b.num_rows - 1].as_py()
                    carried[p] = {last: carried[p][last]}
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *(f.name for f in extra)])

    return df.mapInArrow(run, schema)


def prior_folds(seq: Sequenced, encoders: Mapping[str, Sequence[str]], y: str, alphas: Mapping[str, float],
                start: Mapping[str, DataFrame] | None = None) -> Sequenced:
    """For each encoder ``prefix -> keys``: the state of the row's key before the row.

    ``start`` gives encoders a state from before the first row (``raw_folds``).

    Adds ``{prefix}_n`` (labels), ``{prefix}_sum`` and one ``{prefix}_{horizon}``
    per alpha: the exponentially weighted mean whose first label sets the
    value, null before it. Rows without a label leave the state; null keys
    are keys like any other.
    """
    columns = seq.df.columns
    local = _local(seq, encoders, y, alphas)
    out = local
    for p, keys in encoders.items():
        before = _bucket_prefix(local, p, list(keys), seq.order, y, alphas, False, (start or {}).get(p))
        out = _null_safe_join(out, before, [*keys, BUCKET])
    picked = []
    for p in encoders:
        n0, nl = F.coalesce(F.col(f"_b_{p}_n"), F.lit(0)), F.col(f"_l_{p}_n")
        first = F.when(n0 > 0, F.col(f"_b_{p}_f")).otherwise(F.col(f"_l_{p}_f"))
        picked += [(n0 + nl).alias(f"{p}_n"), (F.coalesce(F.col(f"_b_{p}_s"), F.lit(0.0)) + F.col(f"_l_{p}_s")).alias(f"{p}_sum")]
        for h, a in alphas.items():
            whole = F.when(n0 > 0, F.col(f"_b_{p}_a_{h}") * F.pow(F.lit(1.0 - a), nl.cast("double"))).otherwise(F.lit(0.0)) + F.col(f"_l_{p}_a_{h}")
            picked.append(_weighted_mean(n0 + nl, first, whole, a).alias(f"{p}_{h}"))
    return seq.with_df(out.select(*columns, *picked))


def _local(seq: Sequenced, encoders: Mapping[str, Sequence[str]], y: str, alphas: Mapping[str, float]) -> DataFrame:
    """The scan inside the buckets, for all encoders at once."""
    label = F.col(y).cast("double")
    items = ["_own_n", "_own_y", "_own_y", *(f"_own_{h}" for h in alphas)]
    own = [F.col(y).isNotNull().cast("double").alias("_own_n"), label.alias("_own_y"),
           *((F.lit(float(a)) * label).alias(f"_own_{h}") for h, a in alphas.items())]
    texts = [_key_text(keys, BUCKET).alias(f"_t_{p}") for p, keys in encoders.items()]
    return materialize(_scanned(seq.df.select("*", *own, *texts), {f"_l_{p}": (f"_t_{p}", items) for p in encoders}, alphas, False))


def _weighted_mean(n: Column, first: Column, whole: Column, a: float) -> Column:
    """``A`` counts every label with weight ``a``; the first one sets the value instead."""
    return F.when(n > 0, whole + F.lit(1.0 - a) * F.pow(F.lit(1.0 - a), (n - 1).cast("double")) * first)


def _bucket_prefix(local: DataFrame, p: str, keys: list[str], order: Sequence[str], y: str, alphas: Mapping[str, float], inclusive: bool,
                   start: DataFrame | None = None) -> DataFrame:
    """State of each key before each of its buckets (or after, if ``inclusive``)."""
    state = _state_names(f"_l_{p}", list(alphas))
    last = F.max_by(F.struct(*state, F.col(y).cast("double").alias("y")), F.struct(*order))
    ends = local.groupBy(*keys, BUCKET).agg(last.alias("e"))
    has = F.col("e.y").isNotNull()
    n = F.col(f"e._l_{p}_n")
    own = [(n + has.cast("long")).cast("double").alias("_own_n"), (F.col(f"e._l_{p}_s") + F.coalesce("e.y", F.lit(0.0))).alias("_own_s"),
           F.when(n > 0, F.col(f"e._l_{p}_f")).otherwise(F.col("e.y")).alias("_own_f")]
    for h, a in alphas.items():
        before = F.col(f"e._l_{p}_a_{h}")
        own.append(F.when(has, before * (1.0 - a) + F.lit(float(a)) * F.col("e.y")).otherwise(before).alias(f"_own_{h}"))
    items = ["_own_n", "_own_s", "_own_f", *(f"_own_{h}" for h in alphas)]
    table = ends.select(*keys, BUCKET, *own, _key_text(keys).alias("_t"))
    if start is not None:  # the state from before takes the place of an earlier bucket
        table = table.unionByName(start.select(
            *keys, F.lit(-1).cast(ends.schema[BUCKET].dataType).alias(BUCKET), F.col("n").cast("double").alias("_own_n"),
            F.col("s").alias("_own_s"), F.col("f").alias("_own_f"), *(F.col(f"a_{h}").alias(f"_own_{h}") for h in alphas),
            _key_text(keys).alias("_t")))
    table = table.repartition("_t").sortWithinPartitions("_t", BUCKET)
    scanned = _scanned(table, {f"_b_{p}": ("_t", items)}, alphas, True)
    names = _state_names(f"_b_{p}", list(alphas))
    if not inclusive:
        return scanned.select(*keys, BUCKET, *names)
    n0, nb = F.col(f"_b_{p}_n"), F.col("_own_n")
    after = [(n0 + nb.cast("long")).alias("n"), (F.col(f"_b_{p}_s") + F.col("_own_s")).alias("s"),
             F.when(n0 > 0, F.col(f"_b_{p}_f")).otherwise(F.col("_own_f")).alias("f")]
    after += [(F.col(f"_b_{p}_a_{h}") * F.pow(F.lit(1.0 - a), nb) + F.col(f"_own_{h}")).alias(f"a_{h}") for h, a in alphas.items()]
    return scanned.select(*keys, BUCKET, *after)


def raw_folds(seq: Sequenced, encoders: Mapping[str, Sequence[str]], y: str, alphas: Mapping[str, float],
              start: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """For each encoder, the state of the keys of ``seq`` after all rows, as
    ``prior_folds`` takes it: ``keys, n, s, f`` (labels, their sum, the first one) and
    one ``a_<horizon>`` per alpha."""
    local = _local(seq, encoders, y, alphas)
    out = {}
    for p, keys in encoders.items():
        after = _bucket_prefix(local, p, list(keys), seq.order, y, alphas, True, (start or {}).get(p))
        fields = ["n", "s", "f", *(f"a_{h}" for h in alphas)]
        last = after.groupBy(*keys).agg(F.max_by(F.struct(*fields), BUCKET).alias("e"), F.max(BUCKET).alias("_last"))
        out[p] = last.where("e.n > 0 AND _last >= 0").select(*keys, *[F.col(f"e.{c}").alias(c) for c in fields])
    return out


def final_folds(seq: Sequenced, encoders: Mapping[str, Sequence[str]], y: str, alphas: Mapping[str, float]) -> dict[str, DataFrame]:
    """For each encoder, ``keys, n, sum`` and one column per alpha after all rows."""
    return {p: t.select(*encoders[p], "n", F.col("s").alias("sum"), *(
        _weighted_mean(F.col("n"), F.col("f"), F.col(f"a_{h}"), a).alias(h) for h, a in alphas.items()))
        for p, t in raw_folds(seq, encoders, y, alphas).items()}
