import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.simhash import ball_masks, keep_one_per_class, meeting_links, simhash_dedup
from tidemark.llm.support import scratch


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(ids, fps, distance):
    label = list(range(len(ids)))
    for _ in ids:
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (fps[i] ^ fps[j]).bit_count() <= distance:
                    label[i] = min(label[i], label[j])
    return [min(ids[j] for j in range(len(ids)) if label[j] == label[i]) for i in range(len(ids))]


def near_texts(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 3, 5, 40, 400]))] for _ in range(n // 3)]
    out = []
    for b in base:
        for edits in (0, 1, 2):
            t = list(b)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
    return out


def test_classes_match_brute_force(spark, make_docs, clashing):
    texts = near_texts() + ["", None, "  \n", "Mixed CASE Ä words", "mixed case Ä words", "a", "a"]
    got = {r["doc_id"]: r for r in simhash_dedup(clashing(make_docs(texts)), passes=4).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_classes(list(range(len(texts))), fps, 4)
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def test_meeting_in_the_middle_finds_every_pair():
    rng = np.random.default_rng(3)
    masks = ball_masks(2)
    for distance in range(5):
        a = rng.integers(0, 1 << 63, dtype=np.uint64)
        bits = rng.choice(64, distance, replace=False)
        b = a ^ np.uint64(sum(1 << int(x) for x in bits))
        assert len(np.intersect1d(a ^ masks, b ^ masks)) > 0
    far = a ^ np.uint64(0b11111)
    assert len(np.intersect1d(a ^ masks, far ^ masks)) == 0


def test_meeting_links_join_groups_with_members_out_of_reach():
    v = np.zeros(3, np.uint64)
    fps = np.array([0b0011, 0b1100, 0b110000], np.uint64)  # pairwise 4 apart
    assert {frozenset(x) for x in meeting_links(v, fps, 3)} == set()
    fps = np.array([0b0011, 0b1100, 0b11000], np.uint64)
    assert {frozenset(x) for x in meeting_links(v, fps, 3)} == {frozenset((0b1100, 0b11000))}


def test_empty_table_nulls_and_repeated_rows(spark, make_docs):
    assert simhash_dedup(make_docs([])).count() == 0
    docs = make_docs([(None, "one two three four five"), (7, "one two three four five"), (7, "one two three four five"), (3, None), (None, None)])
    rows = simhash_dedup(docs, passes=1).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(None, 7), (7, 7), (3, 3), (None, 3)}
    kept = keep_one_per_class(docs, simhash_dedup(docs, passes=2)).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 7]


def test_components_of_long_chains_and_hubs(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    odd = [(5000, 5000), (6002, 6001), (6001, 6002)]
    links = chain + hub + odd
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    with scratch(spark, "test") as s:
        got = {r["node"]: r["component"] for r in connected_components(s, df).collect()}
        assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(400)}, 6001: 6001, 6002: 6001}
        assert connected_components(s, df.where(F.lit(False))).count() == 0


def test_dense_groups_leave_few_links(spark):
    """Groups of near copies meet in every bucket of every pass; found components are contracted on the way."""
    from tidemark.llm.simhash import linked_components

    rng = np.random.default_rng(5)
    fps = list(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    for centre in fps[:4]:
        for _ in range(150):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            fps.append(centre ^ np.uint64(sum(1 << int(x) for x in bits)))
    chain = fps[10]
    for i in range(12):  # a chain whose links are four bits each
        chain = chain ^ np.uint64(0b1111 << 4 * i)
        fps.append(chain)
    fps = np.unique(np.array(fps, np.uint64))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    nodes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    made = []
    with scratch(spark, "dense") as s:
        table = s.table
        s.table = lambda df, name, **kw: (out := table(df, name, **kw), made.append(out.count()) if name.startswith("links") else None)[0]
        got = {r["node"]: r["component"] for r in linked_components(s, nodes, 4, 8).collect()}
    assert len(made) == 8 and sum(made[1:]) < made[0] and max(made[4:]) <= 5
    groups: dict = {}
    for f, g in zip(fps.view(np.int64).tolist(), label.tolist(), strict=True):
        groups.setdefault(g, set()).add(f)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    found: dict = {}
    for f, c in got.items():
        found.setdefault(c, set()).add(f)
    assert {frozenset(g) for g in found.values()} == want
