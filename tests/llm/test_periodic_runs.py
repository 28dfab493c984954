"""Runs and digests against a plain scan of every lag."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm import periodic_runs as P


def plain_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def random_words(r):
    n, kinds = r.randint(0, 120), r.choice([1, 2, 3, 5, 30])
    words = [b"w%d" % r.randrange(kinds) for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        if n > 8:
            a, p = r.randrange(n), r.randint(1, 12)
            for i in range(a + p, min(n, a + p * r.randint(2, 9))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("rounds", [0, 1, P.WHOLE_ROUNDS])
def test_runs_against_plain_scan(rounds, monkeypatch):
    monkeypatch.setattr(P, "WHOLE_ROUNDS", rounds)
    r = random.Random(rounds)
    for _ in range(120):
        texts = [random_words(r) for _ in range(5)]
        assert P.find_runs(texts) == [plain_runs(t) for t in texts]


def test_peeling_text_stays_fast():
    """Each round makes one more word too rare: as many rounds as words."""
    k = 20_000
    left = [b"%d" % i for i in range(k)]
    right = [b"%d" % w for i in range(k - 1, -1, -1) for w in (i, i + 1, i)]
    assert P.find_runs([left + right]) == [plain_runs([])]


def test_long_texts():
    runs = P.find_runs([[b"a"] * 300_000, [b"a", b"b", b"c"] * 50_000 + [b"d"]])
    assert runs == [[(0, 300_000, 1)], [(0, 150_000, 3)]]


def test_digest_query(spark, make_docs, clashing):
    texts = [None, "", " \t\n", "a " * 6, "a " * 5, "x y\x0bz " * 4 + "x", "ä ö " * 9, "one two three", "a b " * 40 + "c " * 9, "a " * 6]
    texts += [" ".join(f"t{i}-{j}" for j in range(60)) for i in range(60)]  # some ids plant a repetition
    docs = clashing(make_docs([(i, t) for i, t in enumerate(texts)])).unionByName(clashing(make_docs([(None, "b " * 8), (3, "a " * 6)])))
    got = P.run_digest(P.periodic_runs(docs, planted=True)).collect()
    assert len(got) == len(texts) + 2
    seen = 0
    for r in got:
        t = "b " * 8 if r.doc_id is None else texts[r.doc_id]
        words = (t or "").encode().split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and n and h % 10 == 0:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        seen += bool(runs)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
    assert seen > 8


def test_no_documents(make_docs):
    empty = make_docs(["x"]).where("false")
    assert P.run_digest(P.periodic_runs(empty)).collect() == []
