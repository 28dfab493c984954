import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.packing import TokenIds, pack_documents, place_ranges, plan_patterns
from tidemark.llm.sharding import difference, shard_documents
from tidemark.llm.token_counts import TokenCounter, prove_whole_tokens, token_counts, vocabulary_path

ODD = ["", None, "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "it's  we'll\n\n 2024年 ñandú", "😀 hi 😀", " " * 3000, "ab" * 9000,
       "x՘y ꟝", "tab\tand nbsp", "plain words here", "plain words here"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_counts_match_library(spark, make_docs, clashing, library):
    got = {r["doc_id"]: r for r in token_counts(clashing(make_docs(ODD))).collect()}
    for i, t in enumerate(ODD):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    assert token_counts(make_docs([])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_counter_and_ids_match_library_on_any_text(text):
    if not hasattr(test_counter_and_ids_match_library_on_any_text, "made"):
        path = vocabulary_path()
        test_counter_and_ids_match_library_on_any_text.made = (TokenCounter(path, prove_whole_tokens(path)), TokenIds(path))
    counter, coder = test_counter_and_ids_match_library_on_any_text.made
    ids = counter.whole.encode(text, add_special_tokens=False).ids
    assert counter.counts([text]) == [len(ids)]
    assert coder.ids(text).tolist() == ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_plan_uses_every_piece_once(lengths):
    counts = Counter(lengths)
    plan = plan_patterns(counts, 32)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 32
        for x in pattern:
            used[x] += times
    assert +used == counts
    assert sum(t for _, t in plan) <= max(2 * -(-sum(lengths) // 32), 1) or not lengths


def test_exact_complements_are_found():
    for lengths in ([20, 12], [20, 7, 5], [20, 5, 4, 3], [16, 16]):
        assert sum(t for _, t in plan_patterns(Counter(lengths * 9), 32)) == -(-9 * sum(lengths) // 32)
    ranges = place_ranges(plan_patterns(Counter([20, 12, 12, 8]), 32))
    assert ranges[:, 0].tolist() == sorted(ranges[:, 0].tolist())


def test_packing_is_a_round_trip(spark, make_docs, clashing, library):
    texts = ODD + ["lorem ipsum dolor " * k for k in (1, 40, 100, 400, 900)]
    rows = [r.asDict() for r in pack_documents(clashing(make_docs(texts)), max_len=256).collect()]
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 256 for r in own[1:])
        assert all(zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert pack_documents(make_docs([])).count() == 0


def test_differencing_is_balanced_and_complete():
    sizes = [7919 * (i * i % 97 + 1) for i in range(300)]
    shards, sums = difference([(x, 0, 0, 0) for x in sizes])
    got = [0] * 4
    for x, s in zip(sizes, shards, strict=True):
        assert sorted(s) == [0, 1, 2, 3]
        got[s[0]] += x
    assert sorted(got) == sorted(sums) and max(got) - min(got) <= min(sizes)
    assert difference([(8, 0), (7, 0), (6, 0), (5, 0), (4, 0)])[1] in ((14, 16), (16, 14))


def test_shards(spark, make_docs, clashing):
    texts = [("word " * (i * 37 % 101)) for i in range(400)] + ["same"] * 50 + [None, "", "é"] + [(None, "x"), (5, "word")]
    docs = clashing(make_docs(texts))
    rows = shard_documents(docs).collect()
    assert len(rows) == len(texts)
    text_of = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in text_of)
    for shard in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert len({r["shard"] for r in rows if r["size"] == 5 and r["text_crc32"] == zlib.crc32(b"same")}) == 1
    total = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(total) - min(total) < 600 and {r["law"] for r in rows} == {"bytes"}
    assert shard_documents(make_docs([])).count() == 0
