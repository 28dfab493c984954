"""Graph search recall and exact hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as H
from tidemark.llm.graph_index import build_graph, distances, nearest_neighbours, pruned
from tidemark.llm.hard_negatives import Codes, mine_hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def frame(spark, x, labels=None, ids=None):
    ids = range(len(x)) if ids is None else ids
    labels = [0] * len(x) if labels is None else labels
    return spark.createDataFrame([(None if i is None else int(i), v if v is None else [None if c is None else float(c) for c in v], c2)
                                  for i, v, c2 in zip(ids, x, labels, strict=True)], SCHEMA)


def vectors(n, dim=24, topic=0.0, seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    x[: n // 3, 0] += topic * np.sqrt(dim)  # a third of all rows in one cone
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("topic", [0.0, 2.0, 8.0])
def test_graph_recall(topic):
    x = vectors(3000, 48, topic)
    g = build_graph(x)
    found, _ = g.search(x[::20], 128)
    hit = 0
    for q, ids in zip(x[::20], found.tolist(), strict=True):
        hit += len(set(np.argsort(((x - q) ** 2).sum(1))[:10].tolist()) & set(ids[:10]))
    assert hit >= 0.97 * 10 * len(x[::20])
    assert (g.edges >= 0).sum(1).min() > 0


def test_pruning_rule():
    """A candidate goes exactly when a kept one is nearer to it, by the factor, than the vector is."""
    x = vectors(60, 6).astype(np.float64)
    near = np.tile(np.arange(60), (60, 1))
    out = pruned(x, np.arange(60), near, 60, 1.3)
    for p in range(60):
        left = sorted((i for i in range(60) if i != p), key=lambda i: ((x[i] - x[p]) ** 2).sum())
        kept = []
        for i in left:
            if all(1.3 * np.linalg.norm(x[k] - x[i]) > np.linalg.norm(x[p] - x[i]) for k in kept):
                kept.append(i)
        assert [i for i in out[p].tolist() if i >= 0] == kept


def nearest(rows, k, queries):
    """Brute force over usable distinct rows ``(id, vector)``."""
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for i, v in ok:
        if i % queries == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in ok if j != i and len(w) == len(v))
            out += [(i, r + 1, j) for r, (_, j) in enumerate(near[:k])]
    return sorted(out)


def test_neighbours_query(spark, clashing):
    x = vectors(900).tolist()
    rows = list(enumerate(x))
    rows += [(900 + i, x[0]) for i in range(40)]          # copies of a query: ties by id
    rows += [(960 + i, x[i]) for i in range(1, 30)]
    rows += [rows[5], rows[0], rows[0]]                   # repeated rows
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [None] + x[3][1:]), (1004, [float("nan")] + x[3][1:]),
             (1005, [float("inf")] + x[3][1:]), (None, x[4]), (2000, [1.0, 2.0]), (2001, [1.0, 2.5]), (3000, [-0.0] + [0.0] * 23)]
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    df = clashing(frame(spark, [v for _, v in rows], ids=[i for i, _ in rows]))
    got = nearest_neighbours(df, F.col("vec_id") % 50 == 0, 10, shard_vectors=300).collect()
    want = nearest(rows, 10, 50)
    assert len(got) == len(want)
    assert len({(r.query_id, r.rank, r.vec_id) for r in got} & set(want)) >= 0.97 * len(want)
    by = dict(rows[::-1])
    for r in got:
        assert r.score == pytest.approx(float(np.linalg.norm(np.array(by[r.query_id]) - np.array(by[r.vec_id]))), abs=1e-12)
    zero = sorted((r.rank, r.vec_id) for r in got if r.query_id == 0)
    assert zero == [(k + 1, 900 + k) for k in range(10)]
    assert [(r.query_id, r.vec_id) for r in got if r.query_id == 2000] == [(2000, 2001)]  # all candidates, if fewer


def test_neighbours_of_nothing(spark):
    assert nearest_neighbours(frame(spark, [[1.0]]).where("false"), F.col("vec_id") % 2 == 0).collect() == []
    assert nearest_neighbours(frame(spark, [[1.0], [2.0]], ids=[1, 3]), F.col("vec_id") % 2 == 0).collect() == []


def test_extreme_distances():
    x = np.array([[1e300, 1e300], [1e-300, 0.0], [3.0, 4.0]])
    assert distances(x, np.zeros_like(x)) == pytest.approx([np.sqrt(2) * 1e300, 1e-300, 5.0], rel=1e-12)


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_intervals_hold_the_score(dim):
    r = np.random.default_rng(dim)
    x = np.floor(256 * r.standard_normal((300, dim)))
    x[0], x[1] = 0, x[2]
    c = Codes(x, H.CODES, 1)
    who, what = np.divmod(np.arange(300 * 300), 300)
    estimate = np.zeros(len(who))
    for i in range(H.CODES):
        along = H._along(c, c, who, what, i)
        estimate = estimate + c.align[i][what] * along
        low, high = H._bounds(c, c, who, what, estimate, along, i)
        true = np.einsum("ij,ij->i", x[who], x[what])
        assert ((low <= true) & (true <= high)).all()
    assert np.median(high - low) < 0.6 * np.median(c.norm) ** 2  # of 2 before any code


def negatives(rows, anchors, positives=5, count=5):
    ok = [(i, c, [int(np.floor(256 * np.float64(np.float32(t)))) for t in v]) for i, v, c in rows
          if i is not None and c is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for i, c, v in {(i, c, tuple(v)) for i, c, v in ok if i % anchors == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for j, d, w in ok if len(w) == len(v))
        for s, p, _ in [t for t in scored if t[2] == c and t[1] != i][:positives]:
            fits = [t for t in scored if t[2] != c and 80 * -s <= 100 * -t[0] <= 100 * -s][:count]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("topic", [0.0, 4.0])
def test_negatives_against_brute_force(spark, clashing, topic, monkeypatch):
    r = np.random.default_rng(3)
    x = vectors(700, 64, topic).tolist()
    rows = [(i, v, int(r.integers(0, 4))) for i, v in enumerate(x)]
    rows += [(700 + i, x[0], i % 4) for i in range(30)]   # equal scores: ties by id
    rows += [rows[1], rows[20], rows[20]]                 # repeated rows, a repeated anchor
    rows += [(740, None, 1), (760, x[1], None), (780, [None] + x[1][1:], 1), (800, [float("nan")] + x[1][1:], 1), (820, [0.0] * 64, 2),
             (None, x[2], 1), (840, [], 1), (860, [1.0, 1.0], 1), (861, [1.0, 1.0], 1), (862, [1.0, 0.9], 2), (880, x[5], 77)]
    monkeypatch.setattr(H, "CELL_ROWS", 200)
    df = clashing(frame(spark, [v for _, v, _ in rows], [c for _, _, c in rows], [i for i, _, _ in rows]))
    got = mine_hard_negatives(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(g) for g in got) == negatives(rows, 20)


def test_huge_components(spark):
    rows = [(i, [s * 3e18, 1.0, float(i)], i % 2) for i, s in enumerate([1, 1, 1, -1, 1, 0.9])]
    got = mine_hard_negatives(frame(spark, [v for _, v, _ in rows], [c for _, _, c in rows]), F.col("vec_id") % 3 == 0).collect()
    assert got and max(g.positive_score for g in got) == (1 << 63) - 1


def test_negatives_of_nothing(spark):
    assert mine_hard_negatives(frame(spark, [[1.0]]).where("false"), F.col("vec_id") % 2 == 0).collect() == []


def written_plans(monkeypatch):
    """The plans of the tables that operators write from here on, by label."""
    from tidemark.llm.support import Scratch

    plans, table = {}, Scratch.table

    def noted(self, df, label, *args, **more):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return table(self, df, label, *args, **more)

    monkeypatch.setattr(Scratch, "table", noted)
    return plans


def test_neighbours_in_slices(spark, monkeypatch):
    """Query blocks are not copied for a broadcast: they meet the shards a slice at a time, with the same answers."""
    import tidemark.llm.blocks as B
    import tidemark.llm.graph_index as G

    df = frame(spark, vectors(600).tolist())
    want = sorted(tuple(r) for r in nearest_neighbours(df, F.col("vec_id") % 5 == 0, 5, shard_vectors=200).collect())
    plans = written_plans(monkeypatch)
    monkeypatch.setattr(G, "QUERY_BLOCK", 16)
    monkeypatch.setattr(B, "SLICE_BLOCKS", 3, raising=False)
    assert sorted(tuple(r) for r in nearest_neighbours(df, F.col("vec_id") % 5 == 0, 5, shard_vectors=200).collect()) == want
    assert len(want) == 600 and not any("explode(sequence(" in p for p in plans.values())
    assert sum(label.startswith("found") for label in plans) >= 3  # 8 blocks or more


def test_negatives_in_slices(spark, monkeypatch):
    import tidemark.llm.blocks as B

    r = np.random.default_rng(4)
    x = vectors(500, 32, 2.0).tolist()
    rows = [(i, v, int(r.integers(0, 3))) for i, v in enumerate(x)] + [(500 + i, x[i][:5], i % 3) for i in range(20)]
    plans = written_plans(monkeypatch)
    monkeypatch.setattr(H, "CELL_ROWS", 100)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 8)
    monkeypatch.setattr(B, "SLICE_BYTES", 8_000, raising=False)
    df = frame(spark, [v for _, v, _ in rows], [c for _, _, c in rows], [i for i, _, _ in rows])
    got = mine_hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(g) for g in got) == negatives(rows, 10)
    assert not any("explode(sequence(" in p or "BroadcastHashJoin" in p for p in plans.values())
    assert sum(label.startswith("far") for label in plans) >= 3
