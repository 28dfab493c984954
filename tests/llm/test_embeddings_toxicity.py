import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm.embedding_dedup import _compare_blocks, _order_plan, _reduced, embedding_dedup
from tidemark.llm.support import scratch
from tidemark.llm.toxicity import (BUCKETS, PARTS, Learner, Scorer, Vocabulary, best_cut, best_cuts, blank, drop_toxic, fit, held_out,
                                   layout, learn, score_toxicity, word_parts)

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(24) for _ in range(200)]
    for k in range(12):  # groups of near copies, one larger than a window
        center = rng.standard_normal(24)
        rows += [center + rng.standard_normal(24) * 0.08 * np.linalg.norm(center) / 5 for _ in range(150 if k == 0 else k)]
    rows += [rows[3]] * 90 + [rows[4] * 2.5, np.zeros(24)]
    return [x.astype(np.float32).tolist() for x in rows]


def brute_links(vecs, threshold=0.95):
    def good(v):
        return bool(v) and None not in v and all(map(math.isfinite, v)) and any(v)
    n, comp = [0] * len(vecs), list(range(len(vecs)))
    near = np.zeros((len(vecs), len(vecs)), bool)
    for i, a in enumerate(vecs):
        for j, b in enumerate(vecs[:i]):
            if good(a) and good(b) and len(a) == len(b):
                x, y = np.array(a, np.float64), np.array(b, np.float64)
                near[i, j] = near[j, i] = x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold
    n = near.sum(1)
    changed = True
    while changed:
        new = [min([comp[i]] + [comp[j] for j in np.flatnonzero(near[i])]) for i in range(len(vecs))]
        changed, comp = new != comp, new
    return n.tolist(), comp


def test_links_and_components_match_brute_force(spark, clashing):
    vecs = vectors() + [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 0.0], [1.0, 0.01], [-0.0, 1.0], [0.0, 1.0], [1e-30, 1e-30], [1e30, 1e30]]
    df = clashing(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vecs)], SCHEMA)).repartition(5)
    got = {r["vec_id"]: r for r in embedding_dedup(df).collect()}
    links, comp = brute_links(vecs)
    assert [got[i]["n_links"] for i in range(len(vecs))] == links
    assert [got[i]["component_id"] for i in range(len(vecs))] == comp
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_empty_null_and_repeated_ids(spark):
    assert embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = embedding_dedup(spark.createDataFrame([(None, [1.0, 0.0], 0), (4, [1.0, 0.0], 0), (4, [1.0, 0.0], 0), (9, None, None)], SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in rows) == [(0, 2, 4), (4, 2, 4), (4, 2, 4), (9, 0, 9)]


def test_reduced_pairs_join_the_same_rows():
    near = np.zeros((4, 6), bool)
    near[0, 2] = near[2, 5] = near[1, 3] = True
    assert {frozenset(p) for p in _reduced(near)} == {frozenset((2, 0)), frozenset((5, 0)), frozenset((3, 1))}


def topic(n, planted, near, seed=3):
    """Half of the rows in one cone whose rows meet at cosine ``near``, and pairs just above 0.95 inside it."""
    rng = np.random.default_rng(seed)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)
    axis = unit(rng.standard_normal(64))
    z = rng.standard_normal((n // 2, 64))
    hot = np.sqrt(near) * axis + np.sqrt(1 - near) * unit(z - np.outer(z @ axis, axis))
    z = rng.standard_normal((planted, 64))
    pairs = 0.951 * hot[:planted] + math.sqrt(1 - 0.951 ** 2) * unit(z - (z * hot[:planted]).sum(1, keepdims=True) * hot[:planted])
    return np.concatenate([hot, pairs, rng.standard_normal((n - n // 2 - planted, 64))])


@pytest.mark.parametrize("near", [0.8, 0.9])
def test_dense_topic_keeps_its_links(spark, near):
    x = topic(6000, 300, near)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": [v.tolist() for v in x]})).repartition(8)
    got = embedding_dedup(df).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    assert links.sum() >= 600 and (got <= links).all()
    assert got.sum() >= 0.99 * links.sum()


def test_more_vectors_get_more_orders_and_longer_cells():
    agree = 1 - math.acos(0.95) / math.pi
    for n in (0, 1, 10 ** 6, 10 ** 9, 10 ** 11):
        passes, cell = _order_plan(n, 0.95, 0.995, 24, 64)
        assert 1 - (1 - agree ** cell) ** passes >= 0.995 - 1e-9 and n / 2 ** cell <= 2048
    assert _order_plan(10 ** 6, 0.95, 0.995, 24, 64)[0] == 24 < _order_plan(10 ** 11, 0.95, 0.995, 24, 64)[0]
    for threshold in (-1.0, 0.0, 1.0):
        assert all(v >= 1 for v in _order_plan(1000, threshold, 0.995, 24, 64))


@pytest.mark.parametrize("one_block", [True, False])
def test_blocks_link_different_components_only(one_block):
    x = topic(900, 200, 0.9, seed=5)
    comp = np.array([f"c{i % 350}" for i in range(len(x))])
    left = np.ones(len(x), bool) if one_block else np.arange(len(x)) % 2 == 0
    out = _compare_blocks("<f8", 0.95)(pa.table({"vec": [v.tobytes() for v in x], "component": comp, "on_left": left}))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    if not one_block:
        near &= left[:, None] & ~left[None, :]
    i, j = np.nonzero(near)
    want = {frozenset(p) for p in zip(comp[i], comp[j], strict=True) if p[0] != p[1]}

    def classes(pairs):
        label = {c: c for c in comp}
        for a, b in pairs:
            old, new = label[a], label[b]
            label = {k: new if v == old else v for k, v in label.items()}
        return {frozenset(k for k, v in label.items() if v == g) for g in set(label.values())}
    assert want and classes(map(tuple, want)) == classes(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))


def corpus(n=900, seed=8):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ta", "so", "pe", "dan", "vor", "lin", "qua")]
    rows = []
    for i in range(n):
        toxic = i % 6 == 0
        text = list(rng.choice(words, rng.integers(5, 120)))
        if toxic:
            for w in rng.choice(["vile", "grob", "scumbag"], 3):
                text.insert(int(rng.integers(len(text) + 1)), w)
        rows.append((i, " ".join(text).capitalize(), "en" if i % 3 else "de", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    return fit([(i, lang, t, y) for i, t, lang, y in rows], {0: 1.0, 1: 1.0})


def test_held_out_accuracy(model):
    held = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    predicted = Scorer(model).scores([r[1] for r in held]) >= 0.3
    right = sum(bool(p) == bool(r[3]) for p, r in zip(predicted, held, strict=True))
    assert right / len(held) > 0.97 and set(model.cuts) <= {"en", "de"}


def test_scores_do_not_depend_on_batches(model):
    texts = [r[1] for r in corpus(60)] + ["", None, "one", "vile", "vile " * 40_000 + "ka", "ka " * 70_000 + "scumbag lo"]
    together = Scorer(model).scores(texts)
    alone = np.array([Scorer(model).scores([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-6) and ((together >= 0) & (together <= 1)).all()
    assert together[-1] >= 0.3  # the whole text counts


def test_pooling_matches_plain_windows(model):
    scorer = Scorer(model)
    words = scorer.words.encode("vile ka lo mi ne")
    parts = np.frombuffer(scorer.words.new, np.int32).reshape(-1, PARTS).copy()
    pooled = scorer._pool([words, words[:0]])
    x = np.concatenate([model.embed(parts)[words], np.zeros((2, model.table.shape[1]))])
    plain = np.concatenate([np.maximum(np.max([sum(x[i + j] @ f[j] for j in range(len(f))) for i in range(len(words))], axis=0) + b, 0)
                            for f, b in zip(model.filters, model.bias, strict=True)])
    assert np.allclose(pooled[0], plain, atol=1e-4)
    assert layout([words, words[:0]])[1].tolist() == [0, len(words) + 3]


def test_tables(spark, clashing):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang, _ in rows] + [(None, None, None, None, None), (5000, "", "xx", "s", 0), (5000, "vile scumbag", "en", "s", 1)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    got = score_toxicity(clashing(docs), labels).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        want = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == want and r["predicted"] == int(r["score"] >= 0.3)
    truth = dict((i, y) for i, _, _, y in rows)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert sum(truth[i] for i in left if i in truth) <= 5 and sum(1 - truth[i] for i in left if i in truth) >= 0.98 * sum(1 - y for y in truth.values())
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert drop_toxic(docs, labels.where("toxic = 0")).count() == docs.count()


def test_helpers(spark):
    assert word_parts("") [0] > 0 and len(set(map(len, map(word_parts, ("a", "abcdefghij"))))) == 1
    assert all(0 <= x < BUCKETS for x in word_parts("wörter"))
    score, label = np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0])
    assert 1 < best_cut(score, label, np.ones(4)) < 2
    ids = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert [r["h"] for r in ids] == [zlib.crc32(str(r["id"]).encode()) % 4 == 2 for r in ids]


def test_every_labelled_row_teaches(spark):
    """A toxic word that only rows beyond the first 2,500 of their label hold, in the order of a hash, is learnt too."""
    ids = (spark.range(14_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
           .where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").collect())
    rng, seen, rows = np.random.default_rng(4), {0: 0, 1: 0}, []
    words = [a + b for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ta", "so", "pe", "dan", "vor")]
    for i, y in ids:
        seen[y] += 1
        rows.append((i, " ".join([*rng.choice(words, 6), *(["vile" if seen[y] <= 2500 else "grob"] if y else [])]), "en"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = learn(docs, spark.createDataFrame(ids).select("doc_id", "toxic"))
    new = [" ".join(rng.choice(words, 6)) for _ in range(300)]
    scorer = Scorer(model)
    for word in ("vile", "grob"):
        assert (scorer.scores([f"{t} {word}" for t in new]) >= 0.3).mean() > 0.97
    assert (scorer.scores(new) >= 0.3).mean() < 0.03


def test_cuts_of_all_rows_match_a_plain_scan(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 3000)
    z = np.round(rng.standard_normal(3000) + 1.5 * y, 2)  # with ties
    z[:5] = z[0]
    lang = rng.choice(["", "de", "en"], 3000)
    rows = [(str(a), float(b), int(c)) for a, b, c in zip(lang, z, y, strict=True)] + [("fr", 9.5, 0), ("es", -9.5, 1)]
    with scratch(spark, "cuts") as s:
        got = {a: (cut, n) for a, cut, n in best_cuts(s, spark.createDataFrame(rows, "lang string, z double, y int").repartition(5))}
    assert set(got) == {None, "", "de", "en"}  # one label alone has no cut
    for name, (cut, n) in got.items():
        own = [r for r in rows if name is None or r[0] == name]
        zs, ys = np.array([r[1] for r in own]), np.array([r[2] for r in own])
        assert cut == best_cut(zs, ys, np.ones(len(own))) and n == ys.sum()


def test_state_keeps_all_that_is_learnt():
    words = Vocabulary()
    texts = words.encode_all(["vile ka lo", "ka lo mi", "grob vile ka", "mi lo"])
    parts, shared = words.take(), np.ones(BUCKETS, bool)
    learner = Learner.fresh(shared)
    learner.epoch(np.random.default_rng(1), texts, np.array([1, 0, 1, 0]), np.ones(4), parts, 2)
    assert learner.steps == 2 and learner.touched.max() == 2
    again = Learner(blank(), shared).load(learner.state())
    assert (again.state() == learner.state()).all() and again.steps == 0
    for a in (learner, again):
        a.epoch(np.random.default_rng(2), texts, np.array([1, 0, 1, 0]), np.ones(4), parts, 2)
    assert np.allclose(again.state(), learner.state(), atol=1e-6)
