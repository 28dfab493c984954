import random

import pytest

from tidemark.llm.decontaminate import MATCH, align, drop_leaks, find_leaks, passages_of, words_of
from tidemark.llm.licenses import BANDS, TEMPLATES, block_size, retrieval_chance, scan_licenses

ITEM_SCHEMA = "item_id bigint, text string"


def brute_align(item, passage):
    best, row = 0, [0] * (len(passage) + 1)
    for x in item:
        new = [0]
        for j, y in enumerate(passage):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
            best = max(best, new[-1])
        row = new
    return best


def test_alignment_matches_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        item = [rng.choice("abcdef") for _ in range(rng.randrange(0, 14))]
        passage = [rng.choice("abcdef") for _ in range(rng.randrange(0, 30))]
        score, start, end = align(item, passage)
        assert score == brute_align(item, passage) == brute_align(item, passage[start:end])
    assert align(list("abcd"), list("xxabcdyy")) == (4 * MATCH, 2, 6)


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and"] * 30 + [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(n) for n in (15, 20, 30, 45, 60)] + [["short", "one"], [], ["only", "three", "words"]]
    docs, truth = [], set()
    for i in range(80):
        text = prose(rng.choice([5, 60, 200]))
        if i % 4 == 0:
            k = i // 4 % 5
            copy = list(items[k])
            for _ in range(len(copy) // 8):  # edits
                copy[rng.randrange(len(copy))] = "edited"
            if i % 8 == 0:
                del copy[len(copy) // 2]
            text = text[:20] + [w.upper() + "," for w in copy] + text[20:]
            truth.add((i, k))
        docs.append(" ".join(text))
    return [" ".join(x) for x in items], docs, truth


def test_edited_copies_are_found_and_clean_texts_left(spark, make_docs, clashing):
    items, texts, truth = corpus()
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, None)], ITEM_SCHEMA)
    texts += ["", None, "x only three words y"]
    found = {(r["doc_id"], r["item_id"]): r for r in find_leaks(clashing(make_docs(texts)), bench).collect()}
    assert truth <= set(found) and set(found) - truth == {(len(texts) - 1, 7)}
    for (d, i), r in found.items():
        score, s, e = align(words_of(items[i]), words_of(texts[d]))
        assert abs(r["score"] - score / (2 * len(words_of(items[i])))) < 1e-9 and (r["word_start"], r["word_end"]) == (s, e)
    kept = drop_leaks(make_docs(texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(texts))) - {d for d, _ in found})
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("exact", [False, True])
def test_edit_rates_match_brute_force(spark, make_docs, exact):
    rng = random.Random(9)
    vocabulary = ["the", "of", "and"] * 20 + [f"w{i}" for i in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(rng.randrange(15, 60)) for _ in range(24)]
    texts = [list(x) for x in items] if exact else []
    for item in items:
        for rate in (0.1, 0.15, 0.2, 0.25):
            copy = list(item)
            for i in rng.sample(range(len(copy)), round(rate * len(copy))):
                copy[i] = rng.choice(vocabulary)
            texts.append(prose(10) + copy + prose(10))
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if align(x, t)[0] >= len(x) * MATCH / 2}
    assert len(want) >= len(texts)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], ITEM_SCHEMA)
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(make_docs([" ".join(t) for t in texts]), bench).collect()} == want


def test_repeated_rows_null_ids_and_empty_tables(spark, make_docs):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (1, item), (2, item)], ITEM_SCHEMA)
    docs = make_docs([(None, item), (5, item), (5, item), (5, "clean")])
    assert sorted((r["doc_id"] or -1, r["item_id"], r["score"]) for r in find_leaks(docs, bench).collect()) == [
        (-1, 1, 1.0), (-1, 2, 1.0), (5, 1, 1.0), (5, 2, 1.0)]
    assert [r["text"] for r in drop_leaks(docs, bench).collect()] == ["clean"]
    assert find_leaks(docs, bench.limit(0)).count() == 0 and find_leaks(make_docs([]), bench).count() == 0
    assert drop_leaks(docs, bench.limit(0)).count() == 4


def test_passages_cover_runs_of_seeds():
    import numpy as np

    words = [str(i) for i in range(100)]
    seeds = np.array([[10, 7], [14, 8], [60, 7], [62, 7]], np.uint64)
    assert [(s, e) for s, e, _ in passages_of(words, seeds, 10, 2)] == [(0, 25)]
    assert [(s, e) for s, e, _ in passages_of(words, seeds, 10, 1)] == [(0, 25), (50, 73)]


def brute_licenses(text, containment=0.8):
    import re

    cut = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    grams = lambda w: {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
    words, out = cut(text or ""), set()
    for i, (_, _, template) in enumerate(TEMPLATES):
        own = grams(cut(template))
        size = block_size(len(own))
        for b in range(0, max(len(words) - 2, 0), size):
            if len(own & grams(words[b:b + 2 * size + 2])) / len(own) >= containment:
                out.add(i)
    return out


def test_licenses_match_brute_force(spark, make_docs, clashing):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["lorem", "ipsum", "the", "License", "of", "é", "version"]) for _ in range(n))
    texts = [f"{prose(rng.randrange(90))}\n{t}\n{prose(rng.randrange(90))}" for _, _, t in TEMPLATES for _ in range(3)]
    texts += [t.upper().replace(" ", "\n * ") for _, _, t in TEMPLATES] + [prose(300), "", None, "two words", "the MIT license"]
    found = {}
    for r in scan_licenses(clashing(make_docs(texts))).collect():
        found.setdefault(r["doc_id"], set()).add(r["template"])
    want = {i: b for i, t in enumerate(texts) if (b := brute_licenses(t))}
    assert found == want
    assert scan_licenses(make_docs([])).count() == 0


def test_bands_retrieve_with_high_probability():
    # a template makes up a quarter of its window at least when whole: 1 shingle in 4 at 4 or more of them
    assert retrieval_chance(0.25, BANDS) > 0.98 and retrieval_chance(0.375, BANDS) > 0.999


def test_common_phrase_joins_no_passages_to_all_items(spark, make_docs, monkeypatch):
    """A phrase of 60 items in 200 texts; real copies, an item made of common words and its copies are still found."""
    import random

    from tidemark.llm import decontaminate as d

    r = random.Random(7)
    own = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    items = [(i, f"which of the following is {own(18)}") for i in range(60)]
    form = "answer the next question with yes or no"
    items += [(100 + i, f"{form} q{i}") for i in range(20)]
    texts = [f"{own(30)} which of the following is {own(30)}" for _ in range(200)]
    texts += [f"{own(10)} {items[i][1]} {own(10)}" for i in range(5)] + [f"{own(10)} {form} q3 {own(10)}"]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    made, pairs = [], d.candidate_pairs
    monkeypatch.setattr(d, "candidate_pairs", lambda *a: made.append((out := pairs(*a)).count()) or out)
    rows = d.find_leaks(make_docs(texts), bench).collect()
    assert made[0] <= 5 + 20 + 20  # not 60 items a text
    got = {(x["doc_id"], x["item_id"]) for x in rows}
    assert {(200 + i, i) for i in range(5)} <= got
    assert {(205, 100 + i) for i in range(20)} <= got  # most of each is the form
    assert not any(doc < 200 for doc, _ in got)
