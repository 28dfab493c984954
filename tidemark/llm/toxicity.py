"""Toxicity scores by a convolutional text classifier in numpy.

A word's embedding is the mean of the embeddings of its hashed parts (itself,
its beginnings and its ending, 2**15 buckets). Filters of several widths slide
over the words, each keeps its largest value over the whole text, and a
logistic layer on those values gives the score. The gradient of a maximum
reaches one window a filter, so a step is sparse. The filters are applied once
to each distinct word, and a window's value is a sum of lookups.

Every labelled row that isn't held out takes part in learning. A fifth, by a
hash of the id, calibrates: on all of it, the score is shifted so that 0.3 is
the best cut for all texts, and a cut is found for each language. All others
train, in rounds: a round deals its rows to tasks, each trains a copy of the
model on its rows, and the copies' changes are averaged, a bucket's by the steps
that moved it. More rows give more tasks a round, not larger ones.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.llm.support import Scratch, operator_conf, scratch, shuffle_width

ship_by_value(__name__)

BUCKETS = 1 << 15
PARTS = 9          # hashed parts of a word; unused ones point at bucket 0, which stays zero
WIDTHS = (1, 2, 3)
#: Texts that must share a part before it gets an embedding.
MIN_TEXTS = 4
#: Steps of training at least, one after another, where few rows are labelled.
MIN_STEPS = 600
#: Rounds of training; the rows meet in as many disjoint turns, or fewer of enough rows.
ROUNDS = 8
#: Rows and bytes of texts that a task of a round trains on, about.
PART_ROWS = 1000
PART_BYTES = 16 << 20
#: Times that a task goes over its rows at least.
EPOCHS = 2
#: Texts of a step.
BATCH = 32
#: Rows and words that a task keeps at a time, however many rows it is dealt.
HOLD_ROWS, HOLD_WORDS = 4096, 8_000_000
#: Changes are added up as whole numbers of this unit, so their order doesn't matter.
UNIT = 2.0 ** -28
#: Cells of logits that cuts are counted by, a unit.
CELLS = 64
CUT = 0.3
WORD = re.compile(r"\w+")
#: Distinct words whose filter values a task keeps; beyond it the table starts anew.
CACHE_WORDS = 200_000
#: Letters of texts scored together, and words of a longer text, which bound a task's arrays.
SCORE_CHARS = 200_000
SCORE_WORDS = 60_000


def parts_of(words: list[str]) -> np.ndarray:
    """Buckets of words' parts, a row each: itself, beginnings of 2 to 7 letters, endings of 3 and 4."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    out = np.zeros((n, PARTS), np.int32)
    out[:, 0] = np.fromiter((1 + zlib.crc32(w.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for w in words), np.int64, n)
    column = 1
    for letters, sizes, start in (([w[:7] for w in words], range(2, 8), 0x3C), ([w[:-5:-1] for w in words], range(3, 5), 0x3E)):
        codes = np.array(letters, f"U{max(sizes)}").view(np.uint32).reshape(n, max(sizes))
        h = np.full(n, start, np.uint64)
        for k in range(max(sizes)):
            h = (h ^ codes[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if k + 1 in sizes:
                out[:, column] = np.where(k + 1 < size, 1 + (h >> np.uint64(20)) % np.uint64(BUCKETS - 1), 0)
                column += 1
    return out


def word_parts(word: str) -> list[int]:
    return parts_of([word])[0].tolist()


class _Numbers(dict):
    """Numbers words as they are looked up, and keeps the new ones in ``met``."""

    def __init__(self) -> None:
        self.met: list[str] = []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self) + 1
        self.met.append(word)
        return k


class Vocabulary:
    """Distinct words seen, numbered from 1; number 0 is padding."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.new = array("i", [0] * PARTS)  # parts of the words not taken yet, number 0 first

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            found = WORD.findall(text.lower())
            out.append(np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found)))
        if self.numbers.met:
            self.new.frombytes(parts_of(self.numbers.met).tobytes())
            self.numbers.met = []
        return out

    def take(self) -> np.ndarray:
        """Parts of the words met since the last call, a row each."""
        parts, self.new = np.array(self.new, np.int32).reshape(-1, PARTS), array("i")
        return parts


@dataclass
class Model:
    table: np.ndarray            # BUCKETS x dim, row 0 zero
    filters: list[np.ndarray]    # per width: width x dim x filters
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    cuts: dict[str, float] = field(default_factory=dict)
    trained: bool = True

    def embed(self, parts: np.ndarray) -> np.ndarray:
        used = np.maximum((parts > 0).sum(axis=1, keepdims=True), 1).astype(np.float32)
        return self.table[parts].sum(axis=1) / used

    def responses(self, parts: np.ndarray) -> np.ndarray:
        """Filter values of single words, one column block per width and place."""
        x = self.embed(parts)
        return np.concatenate([x @ f[j] for f in self.filters for j in range(len(f))], axis=1)

    def pooled(self, responses: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Largest filter values of texts whose words lie in ``words[start:end]``, padded by three zeros each."""
        k = len(self.bias[0])
        out, block = [], 0
        # places end, end+1, end+2 hold padding, so a window of up to three words stays in its text
        bounds = np.stack([starts, np.maximum(ends, starts + 1)], axis=1).ravel()
        for f, b in zip(self.filters, self.bias, strict=True):
            value = None
            for j in range(len(f)):
                place = responses[:, (block + j) * k:(block + j + 1) * k][np.concatenate([words[j:], np.zeros(j, words.dtype)])]
                value = place if value is None else value + place
            out.append(np.maximum(np.maximum.reduceat(value, bounds, axis=0)[::2] + b, 0))
            block += len(f)
        return np.concatenate(out, axis=1)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        """Logits of texts before the shift."""
        return pooled.astype(np.float64) @ self.out.astype(np.float64) + self.out_bias

    def score(self, pooled: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(pooled))
        return 1 / (1 + np.exp(-np.clip(self.logit(pooled) + self.shift, -60, 60)))


def layout(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of texts in one array, three zeros after each, with starts and ends."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 3)[:-1])).astype(np.int64)
    words = np.zeros(int((sizes + 3).sum()), np.int32)
    for t, s in zip(texts, starts, strict=True):
        words[s:s + len(t)] = t
    return words, starts, starts + sizes


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by their number ``at``, below ``n``."""
    return np.stack([np.bincount(at, v, n) for v in values.T], axis=1).astype(np.float32)


def blank(dim: int = 12, filters: int = 12) -> Model:
    """The model that nothing taught: every score is 0."""
    return Model(np.zeros((BUCKETS, dim), np.float32), [np.zeros((w, dim, filters), np.float32) for w in WIDTHS],
                 [np.zeros(filters, np.float32) for _ in WIDTHS], np.zeros(filters * len(WIDTHS), np.float32), 0.0, trained=False)


class Learner:
    """A model in training by AdaGrad, with the sums of squares that set its rates.

    ``shared`` marks the buckets that get an embedding. ``touched`` counts the
    steps that moved a bucket since the learner was made or loaded.
    """

    def __init__(self, model: Model, shared: np.ndarray, rate: float = 0.05):
        self.model, self.shared, self.rate = model, shared, rate
        self.model.table[~shared] = 0
        self.table = np.full(BUCKETS, 1e-6, np.float32)
        self.filters = [np.full_like(f, 1e-6) for f in model.filters]
        self.bias = [np.full_like(b, 1e-6) for b in model.bias]
        self.out, self.out_bias = np.full_like(model.out, 1e-6), 1e-6
        self.touched, self.steps = np.zeros(BUCKETS, np.int64), 0

    @classmethod
    def fresh(cls, shared: np.ndarray, dim: int = 12, filters: int = 12, seed: int = 11) -> Learner:
        rng = np.random.default_rng(seed)
        table = (rng.standard_normal((BUCKETS, dim)) * 0.05).astype(np.float32)
        return cls(Model(table, [(rng.standard_normal((w, dim, filters)) / math.sqrt(w * dim)).astype(np.float32) for w in WIDTHS],
                         [np.zeros(filters, np.float32) for _ in WIDTHS],
                         (rng.standard_normal(filters * len(WIDTHS)) * 0.3).astype(np.float32), 0.0), shared)

    def state(self) -> np.ndarray:
        """All that is learnt: a row for each bucket with its sum of squares, then rows of the other weights and their sums."""
        m = self.model
        rest = [np.ravel(x) for x in (*m.filters, *m.bias, m.out, m.out_bias, *self.filters, *self.bias, self.out, self.out_bias)]
        flat = np.concatenate(rest).astype(np.float64)
        width = m.table.shape[1] + 1
        flat = np.concatenate([flat, np.zeros(-len(flat) % width)]).reshape(-1, width)
        return np.concatenate([np.concatenate([m.table, self.table[:, None]], axis=1).astype(np.float64), flat])

    def load(self, state: np.ndarray) -> Learner:
        m = self.model
        m.table, self.table = state[:BUCKETS, :-1].astype(np.float32), state[:BUCKETS, -1].astype(np.float32)
        flat, at = state[BUCKETS:].ravel(), 0

        def take(like: np.ndarray) -> np.ndarray:
            nonlocal at
            at += like.size
            return flat[at - like.size:at].reshape(like.shape).astype(like.dtype)
        one = np.zeros(1)  # the out biases stay double
        m.filters, m.bias, m.out, m.out_bias = [take(f) for f in m.filters], [take(b) for b in m.bias], take(m.out), float(take(one)[0])
        self.filters, self.bias, self.out, self.out_bias = [take(f) for f in m.filters], [take(b) for b in m.bias], take(m.out), float(take(one)[0])
        self.touched, self.steps = np.zeros(BUCKETS, np.int64), 0
        return self

    def epoch(self, rng: np.random.Generator, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, parts: np.ndarray,
              batch: int = BATCH) -> None:
        """Steps over texts of word numbers in a random order."""
        used = np.maximum((parts > 0).sum(axis=1), 1).astype(np.float32)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            self.step([texts[i] for i in order[at:at + batch]], labels[order[at:at + batch]], weights[order[at:at + batch]], parts, used)

    def step(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, parts: np.ndarray, used: np.ndarray) -> None:
        model, rate = self.model, self.rate
        filters = len(model.bias[0])
        words, starts, ends = layout(texts)
        distinct, number = np.unique(words, return_inverse=True)
        x = model.embed(parts[distinct])
        # the best window of every filter in every text, filters in rows so that a text's values lie together
        alone = np.concatenate([f.transpose(0, 2, 1).reshape(-1, f.shape[1]) for f in model.filters]) @ x.T
        pooled, best, block = [], [], 0
        for f, b in zip(model.filters, model.bias, strict=True):
            value = 0
            for j in range(len(f)):
                value = value + alone[block:block + filters].take(np.concatenate([number[j:], np.zeros(j, number.dtype)]), axis=1)
                block += filters
            top = np.stack([s + value[:, s:max(e, s + 1)].argmax(axis=1) for s, e in zip(starts, ends, strict=True)])
            best.append(top)
            pooled.append(np.maximum(value[np.arange(filters), top] + b, 0))
        p = np.concatenate(pooled, axis=1)
        score = 1 / (1 + np.exp(-np.clip(p @ model.out + model.out_bias, -30, 30)))
        error = ((score - labels) * weights).astype(np.float32) / len(texts)
        back = error[:, None] * model.out[None, :] * (p > 0)
        g = p.T @ error + 1e-4 * model.out
        self.out += g * g
        model.out -= rate * g / np.sqrt(self.out)
        gb = float(error.sum())
        self.out_bias += gb * gb
        model.out_bias -= rate * gb / math.sqrt(self.out_bias)
        at, pull = [], []
        for i, f in enumerate(model.filters):
            own = back[:, i * filters:(i + 1) * filters]
            gf = np.zeros_like(f)
            for j in range(len(f)):
                word = number[np.minimum(best[i] + j, len(number) - 1)]  # text x filter
                gf[j] = np.einsum("tfd,tf->df", x[word], own)
                moves = np.flatnonzero(own)
                at.append(word.ravel()[moves])
                pull.append(own.ravel()[moves, None] * f[j].T[moves % filters])
            gbias = own.sum(axis=0)
            self.filters[i] += gf * gf
            f -= rate * gf / np.sqrt(self.filters[i])
            self.bias[i] += gbias * gbias
            model.bias[i] -= rate * gbias / np.sqrt(self.bias[i])
        gx = _sums(np.concatenate(at), np.concatenate(pull), len(x))
        hit = np.flatnonzero((gx != 0).any(axis=1))
        self.steps += 1
        if len(hit):
            buckets, inverse = np.unique(parts[distinct[hit]], return_inverse=True)
            gt = _sums(inverse.reshape(-1), np.repeat(gx[hit] / used[distinct[hit]][:, None], PARTS, axis=0), len(buckets))
            gt[~self.shared[buckets]] = 0
            self.table[buckets] += (gt * gt).mean(axis=1)
            model.table[buckets] -= rate * gt / np.sqrt(self.table[buckets])[:, None]
            self.touched[buckets[self.shared[buckets]]] += 1


def sharing(texts: list[np.ndarray], parts: np.ndarray) -> np.ndarray:
    """Texts that hold a bucket, for each bucket."""
    shared = np.zeros(BUCKETS, np.int64)
    for t in texts:
        shared[np.unique(parts[np.unique(t)])] += 1
    return shared


def enough(shared: np.ndarray) -> np.ndarray:
    """Buckets with an embedding: parts that few texts share say nothing about another text, and bucket 0 is none."""
    return (shared >= MIN_TEXTS) & (np.arange(BUCKETS) > 0)


def train(texts: list[np.ndarray], labels: np.ndarray, parts: np.ndarray, weights: np.ndarray, dim: int = 12,
          filters: int = 12, epochs: int = 10, batch: int = BATCH, seed: int = 11) -> Model:
    """Fit the classifier on texts of word numbers in this process."""
    learner = Learner.fresh(enough(sharing(texts, parts)), dim, filters, seed)
    rng = np.random.default_rng(seed)
    for _ in range(max(epochs, -(-MIN_STEPS * batch // max(len(texts), 1)))):
        learner.epoch(rng, texts, labels, weights, parts, batch)
    return learner.model


def best_cut(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """Logit midway in the gap of the cut with the best weighted F1."""
    order = np.argsort(-score, kind="stable")
    s, y, w = score[order], label[order], weight[order]
    hit, all_, total = np.cumsum(y * w), np.cumsum(w), (y * w).sum()
    f1 = 2 * hit / (all_ + total)
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores go together
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 1e-6)


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _drawn(cut: float, toxic: int) -> float:
    """A language's cut as a score, drawn towards the common one where few toxic rows speak for another."""
    share = toxic / (toxic + 30)
    return 1 / (1 + math.exp(-(share * cut + (1 - share) * _logit(CUT))))


def fit(samples: list[tuple], class_weight: dict[int, float], seed: int = 11, dim: int = 12, filters: int = 12, epochs: int = 10) -> Model:
    """Model from a few ``(doc_id, lang, text, label)`` rows in this process, by the steps and the cuts that
    ``learn`` takes over all rows; class weights restore the corpus's label shares."""
    labels = np.array([x[3] for x in samples], np.int64)
    held = np.array([xxhash.xxh32_intdigest(str(x[0]), seed) % 5 == 0 for x in samples], bool)
    if len(set(labels[~held].tolist())) < 2:
        held[:] = False
    if len(set(labels.tolist())) < 2:  # nothing to learn from: every score is 0
        return blank(dim, filters)
    vocabulary = Vocabulary()
    texts = [vocabulary.encode(x[2] or "") for x in samples]
    parts = vocabulary.take()
    use = np.flatnonzero(~held)
    rare = min(1.0, class_weight[1] / class_weight[0])  # toxic rows weigh by half their odds' root, neither 1 nor as in the corpus
    weights = np.where(labels == 1, math.sqrt(rare) if rare < 1 else 1.0, 1.0)
    model = train([texts[i] for i in use], labels[use], parts, weights[use], dim, filters, epochs, seed=seed)
    judge = np.flatnonzero(held)
    if len(set(labels[judge].tolist())) < 2:
        judge = use
    z = np.array([])
    responses = model.responses(parts)
    for i in range(0, len(judge), 64):
        pooled = model.pooled(responses, *layout([texts[j] for j in judge[i:i + 64]]))
        z = np.append(z, model.logit(pooled))
    w = np.array([class_weight[int(y)] for y in labels[judge]])
    model.shift = _logit(CUT) - best_cut(z, labels[judge], w)
    langs = np.array([x[1] or "" for x in samples])[judge]
    for lang in set(langs.tolist()):
        own = langs == lang
        toxic = int(labels[judge][own].sum())
        if 0 < toxic < own.sum():
            model.cuts[lang] = _drawn(best_cut(z[own] + model.shift, labels[judge][own], w[own]), toxic)
    return model


class Scorer:
    """Scores texts of a task, keeping the filter values of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._fresh()

    def _fresh(self) -> None:
        self.words = Vocabulary()
        self.known = np.zeros((1 << 14, sum(len(f) * f.shape[2] for f in self.model.filters)), np.float32)
        self.filled = 0

    def _pool(self, texts: list[np.ndarray]) -> np.ndarray:
        new = self.words.take()
        while self.filled + len(new) > len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.known[self.filled:self.filled + len(new)] = self.model.responses(new)
        self.filled += len(new)
        return self.model.pooled(self.known, *layout(texts))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.model.score(self.pooled(texts)) if texts else np.zeros(0)

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """Largest filter values of at least one text."""
        pooled, group, size = [], [], 0

        def flush() -> None:
            nonlocal group, size
            if group:
                pooled.append(self._pool(self.words.encode_all(group)))
                group, size = [], 0
            if self.filled > CACHE_WORDS:
                self._fresh()

        for t in texts:
            t = t or ""
            if size + len(t) > SCORE_CHARS:
                flush()
            if len(t) > SCORE_CHARS:  # a very long text by parts that overlap by a window
                words = self.words.encode(t)
                long = [self._pool([words[i:i + SCORE_WORDS + max(WIDTHS) - 1]])[0] for i in range(0, max(len(words), 1), SCORE_WORDS)]
                pooled.append(np.max(long, axis=0)[None])
                continue
            group.append(t)
            size += len(t) + 1
        flush()
        return np.concatenate(pooled)


def held_out(id_col: str | Column) -> Column:
    """Rows that learning never sees: crc32 of the id as text leaves 2 modulo 4."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


#: Labelled ids that are sent to every task, at most.
SENT_IDS = 2_000_000
#: Turn of the rows that calibrate; those that train have 0 to ROUNDS - 1.
JUDGE = ROUNDS


def _labelled(s: Scratch, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str | None, label_col: str,
              seed: int) -> DataFrame:
    """``at, turn, lang, text, bytes, y``, written by turn: every document with a known label that isn't held out."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("k")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col and lang_col in docs.columns else F.lit("")
    light = (docs.where(~held_out(id_col)).select(F.col(id_col).alias("doc_id"), lang.alias("lang"),
                                                  F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    known = s.table(known, "known", few=True)
    # sent to the tasks while that is light, so that texts stay where they are; beyond it the join is Spark's choice
    sent = F.broadcast(known) if known.count() <= SENT_IDS else known
    rows = light.join(sent, light.doc_id == known.k)
    at = F.xxhash64("doc_id", "text", F.lit(seed))
    judge = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0
    rows = rows.select(at.alias("at"), F.when(judge, JUDGE).otherwise(F.pmod(at, F.lit(ROUNDS))).cast("int").alias("turn"),
                       "lang", "text", F.octet_length("text").alias("bytes"), "y")
    return s.table(rows.repartition(shuffle_width(s.spark), "turn", F.pmod(F.shiftright("at", 3), F.lit(8))), "labelled", by="turn")


def _sharing_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold a bucket; a task whose texts share every bucket enough counts no more."""
    shared = np.zeros(BUCKETS, np.int64)
    for b in batches:
        words = Vocabulary()
        if shared[1:].min() < MIN_TEXTS:
            shared += sharing(words.encode_all(b.column("text").to_pylist()), words.take())
    found = np.flatnonzero(shared)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(shared[found])], ["bucket", "n"])


def _train_batches(state, odds: float, epochs: int, seed: int):
    """Trains a copy of the model on a task's rows and yields its changes, a row for each row of the state that moved."""
    repeats = max(1, round(odds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, shared = state.value
        learner = Learner(blank(), shared).load(before)
        rng, words, texts, labels = None, Vocabulary(), [], []

        def flush() -> None:
            nonlocal words, texts, labels
            parts, y = words.take(), np.array(labels, np.int64)
            # toxic rows come up as often as their weight says, so that most steps meet some
            rows = np.concatenate([np.arange(len(y))] + [np.flatnonzero(y == 1)] * (repeats - 1))
            weights = np.where(y == 1, odds / repeats, 1.0)[rows]
            for _ in range(epochs):
                learner.epoch(rng, [texts[i] for i in rows], y[rows], weights, parts)
            words, texts, labels = Vocabulary(), [], []
        for b in batches:
            if b.num_rows:
                rng = rng or np.random.default_rng([seed, b.column("at")[0].as_py() & (2 ** 63 - 1)])
                texts += words.encode_all(b.column("text").to_pylist())
                labels += b.column("y").to_pylist()
                if len(texts) >= HOLD_ROWS or sum(map(len, texts)) >= HOLD_WORDS:
                    flush()
        if texts:
            flush()
        change = learner.state() - before
        steps = np.concatenate([learner.touched, np.full(len(change) - BUCKETS, learner.steps)])
        moved = np.flatnonzero(steps)
        whole = np.rint(np.clip(change[moved] * steps[moved, None], -2.0 ** 20, 2.0 ** 20) / UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(moved.astype(np.int32)), pa.array(steps[moved])] + [pa.array(c) for c in whole.T],
                                         ["place", "steps"] + [f"c{i}" for i in range(whole.shape[1])])
    return run


def _round(rows: DataFrame, parts: int, learner: Learner, odds: float, epochs: int, seed: int) -> None:
    """One round: the rows are dealt to ``parts`` tasks, and the mean of what they change is added to the learner."""
    sc, before = rows.sparkSession.sparkContext, learner.state()
    state = sc.broadcast((before, learner.shared))
    cells = [f"c{i}" for i in range(before.shape[1])]
    part = F.pmod(F.shiftright("at", 3), F.lit(parts)).cast("int")
    dealt = rows.select("at", "text", "y").repartitionById(parts, part).sortWithinPartitions("at", "text", "y")
    changes = dealt.mapInArrow(_train_batches(state, odds, epochs, seed), ", ".join(["place int, steps long"] + [f"{c} long" for c in cells]))
    mean = changes.groupBy("place").agg(F.sum("steps").alias("steps"), *[F.sum(c).alias(c) for c in cells]).toArrow()
    state.destroy()
    if mean.num_rows:
        change = np.stack([mean.column(c).to_numpy() for c in cells], axis=1) * UNIT / mean.column("steps").to_numpy()[:, None]
        before[mean.column("place").to_numpy()] += change
    learner.load(before)


def _logit_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(**model.value))
        for b in batches:
            if b.num_rows:
                z = scorer.model.logit(scorer.pooled(b.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(z), b.column("y")], ["lang", "z", "y"])
    return run


def best_cuts(s: Scratch, judged: DataFrame) -> list[tuple[str | None, float, int]]:
    """``(lang, cut, toxic rows)`` of ``lang, z, y`` rows: ``best_cut`` for all (None) and each language that has both labels.

    Rows are counted by logit, then by narrow cells of logits, which are few: only
    these are summed up in one order a language. Each logit is then placed in its cell.
    """
    each = judged.select(F.explode(F.array(F.lit(None).cast("string"), F.col("lang"))).alias("lang"), "z", "y")
    each = each.select(F.col("lang").isNull().alias("every"), F.coalesce("lang", F.lit("")).alias("lang"), "z", "y")
    keys = ["every", "lang", "cell"]
    counted = s.table(each.groupBy("every", "lang", "z").agg(F.count("*").alias("n"), F.sum("y").alias("hit"))
                      .withColumn("cell", F.floor(F.col("z") * CELLS)), "counted", few=True)
    group = Window.partitionBy("every", "lang")
    above = group.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = (counted.groupBy(*keys).agg(F.sum("n").alias("cn"), F.sum("hit").alias("ch"), F.max("z").alias("top"))
             .select(*keys, F.coalesce(F.sum("cn").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("ch").over(above), F.lit(0)).alias("hit0"),
                     F.sum("cn").over(group).alias("rows"), F.sum("ch").over(group).alias("toxic"),
                     F.lead("top").over(group.orderBy(F.desc("cell"))).alias("under"))
             .where((F.col("toxic") > 0) & (F.col("toxic") < F.col("rows"))))
    within = Window.partitionBy(*keys).orderBy(F.desc("z"))
    n, hit = F.col("n0") + F.sum("n").over(within), F.col("hit0") + F.sum("hit").over(within)
    below = F.coalesce(F.lead("z").over(within), F.col("under"))
    best = (counted.join(cells, keys)
            .select("every", "lang", "z", "toxic", (2 * hit / (n + F.col("toxic"))).alias("f1"),
                    F.coalesce((F.col("z") + below) / 2, F.col("z") - 1e-6).alias("cut"))
            .groupBy("every", "lang").agg(F.max_by("cut", F.struct("f1", "z")).alias("cut"), F.max("toxic").alias("toxic")).collect())
    return [(None if r["every"] else r["lang"], r["cut"], r["toxic"]) for r in best]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
          label_col: str = "toxic", part_rows: int = PART_ROWS, seed: int = 11) -> Model:
    """Fit on every labelled row, whole texts: a fifth for the shift and the cuts, all others for the weights.

    Rows ``held_out`` are never read. Null ids and labels are left out; an id
    labelled twice counts as toxic if one label says so. A round takes one turn's
    rows, in tasks of about ``part_rows`` rows; with few rows the turns are fewer
    and come up again.
    """
    spark = docs.sparkSession
    with scratch(spark, "toxicity-learn") as s, operator_conf(spark):
        rows = _labelled(s, docs, labels, id_col, text_col, lang_col, label_col, seed)
        trains = F.col("turn") < JUDGE
        counts = rows.groupBy(trains.alias("trains"), "y").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()
        taught, tried = ({r["y"] for r in counts if r["trains"] == t} for t in (True, False))
        if taught | tried != {0, 1}:  # nothing to learn from: every score is 0
            return blank()
        if taught == {0, 1}:
            counts, used = [r for r in counts if r["trains"]], rows.where(trains)
        else:  # too few to hold some back
            used = rows.withColumn("turn", F.pmod("at", F.lit(ROUNDS)).cast("int"))
        judged = rows.where(~trains) if taught == tried == {0, 1} else used
        clean, toxic = (sum(r["n"] for r in counts if r["y"] == y) for y in (0, 1))
        odds = math.sqrt(max(1.0, clean / toxic))  # toxic rows weigh by their odds' root, neither 1 nor as much as all others
        slices = max(-(-(clean + toxic) // part_rows), -(-sum(r["bytes"] for r in counts) // PART_BYTES))
        turns = min(slices, ROUNDS)
        parts = -(-slices // turns)
        steps = (clean + toxic * max(1, round(odds))) / (turns * parts) / BATCH  # of a task going once over its rows
        epochs = max(EPOCHS, math.ceil(MIN_STEPS / (ROUNDS * steps)))
        shared = np.zeros(BUCKETS, np.int64)
        for i in range(turns):
            found = (used.where(F.col("turn") % turns == i).select("text").mapInArrow(_sharing_batches, "bucket int, n long")
                     .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
            shared[found.column("bucket").to_numpy()] += found.column("n").to_numpy()
            if shared[1:].min() >= MIN_TEXTS:  # counts only grow: no further row can change what is shared
                break
        learner = Learner.fresh(enough(shared), seed=seed)
        for i in range(ROUNDS):
            _round(used.where(F.col("turn") % turns == i % turns), parts, learner, odds, epochs, seed + i)
        model = learner.model
        sent = spark.sparkContext.broadcast(vars(model))
        cuts = best_cuts(s, judged.select("lang", "text", "y").mapInArrow(_logit_batches(sent), "lang string, z double, y int"))
        sent.destroy()
    model.shift = _logit(CUT) - next(cut for lang, cut, _ in cuts if lang is None)
    model.cuts = {lang: _drawn(cut + model.shift, n) for lang, cut, n in cuts if lang is not None}
    return model


def _score_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(**model.value))
        cuts = scorer.model.cuts
        for b in batches:
            score = scorer.scores(b.column("text").to_pylist())
            cut = np.array([cuts.get(x or "", CUT) for x in b.column("lang").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32)),
                 pa.array(cut), pa.array(score >= cut)],
                ["doc_id", "held_out", "score", "predicted", "threshold", "rejected"])
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted, threshold, rejected`` per row of ``docs``.

    ``score`` reads the text only. ``predicted`` is 1 from 0.3 on; ``rejected``
    compares with the ``threshold`` calibrated for the row's language (0.3 for
    null or unknown ones). Null and empty texts score as no words; repeated and
    null ids keep their own rows. Without labels of both kinds every score is 0.
    """
    spark = docs.sparkSession
    with scratch(spark, "toxicity") as s, operator_conf(spark):
        model = spark.sparkContext.broadcast(vars(learn(docs, labels, id_col, text_col, lang_col, **options)))
        lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
        light = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), lang.alias("lang"),
                            F.col(text_col).cast("string").alias("text"))
        kind = light.schema["doc_id"].dataType.simpleString()
        return s.table(light.mapInArrow(_score_batches(model), f"doc_id {kind}, held_out boolean, score double, predicted int, "
                                                               "threshold double, rejected boolean"), "result", keep=True)


def _keep_batches(model, text_at: int, lang_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(**model.value))
        cuts = scorer.model.cuts
        for b in batches:
            score = scorer.scores(b.column(text_at).to_pylist())
            langs = b.column(lang_at).to_pylist() if lang_at is not None else [None] * b.num_rows
            keep = score < np.array([cuts.get(x or "", CUT) for x in langs], np.float64)
            yield b.filter(pa.array(keep))
    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``docs`` without the rows that ``score_toxicity`` rejects; columns stay."""
    spark = docs.sparkSession
    with operator_conf(spark):
        model = spark.sparkContext.broadcast(vars(learn(docs, labels, id_col, text_col, lang_col, **options)))
    names = docs.columns
    return docs.mapInArrow(_keep_batches(model, names.index(text_col), names.index(lang_col) if lang_col in names else None), docs.schema)
