"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Items are cut to word n-grams. Seeds are the rare ones, those of at most
   ``COMMON_ITEMS`` items: an edited copy may keep any of them.
2. One pass over the corpus cuts passages around places with two n-grams of items
   within an item's length; passages join items on seeds, so a passage meets
   at most ``COMMON_ITEMS`` items a seed.
3. Common n-grams ("which of the following") join nothing by themselves; they count
   inside a pair that a seed has joined. Only items that consist of them, by
   the share of words that a match needs, are joined on them too.
4. A local alignment of words scores each passage against each item it shares
   two n-grams with (one, for items that have few).

The pass looks n-grams up in a bitmap of fixed size, which only saves work:
what passes it is joined with the n-grams themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.llm.support import Scratch, operator_conf, row_key, scratch

ship_by_value(__name__)

WORD = re.compile(r"\w+")
#: Word hashes a task keeps.
CACHE_WORDS = 500_000
#: Bits of the n-gram bitmaps: 4 MB in a task.
BITMAP_BITS = 25
#: Items that may share an n-gram for it to be a seed.
COMMON_ITEMS = 8
#: Weights of an n-gram's words (odd, fixed values).
WEIGHTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
           0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
MATCH, MISMATCH, GAP = 2, -1, -1


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams_of(words: list[str], n: int, cache: _Hashes) -> np.ndarray:
    """Hash of every run of ``n`` words, by its first word's place."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    last = len(words) - n + 1
    out = np.zeros(last, np.uint64)
    for j in range(n):
        out = (out ^ (h[j:j + last] >> np.uint64(29))) * np.uint64(WEIGHTS[j]) + h[j:j + last]
    return out ^ (out >> np.uint64(31))


def _slots(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)


def _in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _slots(h)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _item_batches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for b in batches:
            words = [words_of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("item_key"), b.column("item_id"), pa.array(words, pa.list_(pa.string())),
                 pa.array([grams_of(w, n, cache).view(np.int64).tolist() for w in words], pa.list_(pa.int64()))],
                ["item_key", "item_id", "words", "grams"])
    return run


def _bitmap_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << BITMAP_BITS, bool)
    for b in batches:
        bits[_slots(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["bits"])


def _bitmap(numbers: DataFrame) -> bytes:
    """Bitmap of the low bits of a column of numbers of the items; a few partial ones are merged one by one."""
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in numbers.coalesce(4).mapInArrow(_bitmap_batches, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def passages_of(words: list[str], hashes: np.ndarray, reach: int, at_least: int) -> list[tuple[int, int, np.ndarray]]:
    """``(start, end, places)`` of word ranges around runs of seed places no more
    than ``reach`` words apart that hold ``at_least`` different seeds."""
    if not len(hashes):
        return []
    places, h = hashes[:, 0].astype(np.int64), hashes[:, 1]
    out = []
    for run in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) > reach) + 1):
        if len(np.unique(h[run])) >= at_least:
            out.append((max(0, int(places[run[0]]) - reach), min(len(words), int(places[run[-1]]) + reach + 1), run))
    return out


def _passage_batches(n: int, bitmap, reach: int, at_least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, cache = np.frombuffer(bitmap.value, np.uint8), _Hashes()
        for b in batches:
            of, starts, words_out, seeds = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = words_of(text)
                h = grams_of(words, n, cache)
                hit = np.flatnonzero(_in_bitmap(bits, h)) if len(h) else h
                if len(hit) < at_least:
                    continue
                found = np.stack([hit.astype(np.uint64), h[hit]], axis=1)
                for s, e, run_ in passages_of(words, found, reach, at_least):
                    of.append(i)
                    starts.append(s)
                    words_out.append(words[s:e])
                    seeds.append(np.unique(found[run_, 1]).view(np.int64).tolist())
            if of:
                at = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_key").take(at), b.column("doc_id").take(at), pa.array(starts, pa.int64()),
                     pa.array(words_out, pa.list_(pa.string())), pa.array(seeds, pa.list_(pa.int64()))],
                    ["doc_key", "doc_id", "start", "words", "seeds"])
    return run


def _best_end(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: best score, and where it ends in ``a`` and ``b`` (exclusive)."""
    above, best, at = np.zeros(len(b) + 1, np.int64), 0, (0, 0)
    slope = -GAP * np.arange(len(b) + 1, dtype=np.int64)
    for i, x in enumerate(a):
        here = np.zeros(len(b) + 1, np.int64)
        here[1:] = np.maximum(above[:-1] + np.where(b == x, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + slope) - slope  # gaps along b
        j = int(here.argmax())
        if here[j] > best:
            best, at = int(here[j]), (i + 1, j)
        above = here
    return best, *at


def align(item: list[str], passage: list[str]) -> tuple[int, int, int]:
    """Score of the best local alignment and the words of ``passage`` it covers."""
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(w, len(number)) for w in x], np.int64) for x in (item, passage))
    if not len(a) or not len(b):
        return 0, 0, 0
    score, i, j = _best_end(a, b)
    _, _, back = _best_end(a[:i][::-1], b[:j][::-1])
    return score, j - back, j


def _align_batches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (start, passage, item) in enumerate(zip(*(b.column(c).to_pylist() for c in ("start", "words", "item_words")), strict=True)):
                score, s, e = align(item, passage)
                if score >= least * MATCH * len(item):
                    rows.append((i, score / (MATCH * len(item)), start + s, start + e))
            if rows:
                of = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_key").take(of), b.column("doc_id").take(of), b.column("item_id").take(of),
                     pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                    ["doc_key", "doc_id", "item_id", "score", "word_start", "word_end"])
    return run


def candidate_pairs(scratch: Scratch, passages: DataFrame, known: DataFrame, n: int, stretch: int, min_score: float) -> DataFrame:
    """``(passage, item_key, sure, needed)``: pairs that share a seed and may share ``needed`` n-grams;
    ``sure`` if their seeds alone are as many.

    ``passages(passage, seeds)`` hold n-grams of items, ``known(item_key, words, grams)`` the items.
    """
    grams = known.select("item_key", F.explode(F.array_distinct("grams")).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("items")).select(F.col("gram").alias("of"), (F.col("items") > COMMON_ITEMS).alias("common"))
    grams = scratch.table(grams.join(often, F.col("gram") == F.col("of")).drop("of"), "grams", few=True)
    shared = grams.where("common").groupBy("item_key").agg(F.collect_list("gram").alias("common"))  # an item's own n-grams
    there = known.join(shared, "item_key", "left").withColumn("common", F.coalesce("common", F.array().cast("array<bigint>")))
    covered = F.array_distinct(F.flatten(F.transform(F.filter(
        F.transform("grams", lambda g, i: F.when(F.array_contains("common", g), i)), lambda i: i.isNotNull()), lambda i: F.sequence(i, i + n - 1))))
    per_item = scratch.table(there.select(
        "item_key", F.least(F.ceil(F.size(F.array_distinct("grams")) / stretch), F.lit(2)).alias("needed"), (F.size("common") > 0).alias("some"),
        (F.size(covered) >= min_score * F.size("words")).alias("mostly")).where("needed > 0"), "needs", few=True)
    held = passages.select("passage", F.explode("seeds").alias("gram")).distinct()
    by_seed = held.join(grams.where("NOT common"), "gram").groupBy("passage", "item_key").agg(F.count("*").alias("shared")).join(per_item, "item_key")
    by_seed = by_seed.where("shared >= needed OR some").select("passage", "item_key", (F.col("shared") >= F.col("needed")).alias("sure"), "needed")
    made_of = grams.where("common").join(per_item.where("some AND mostly"), "item_key")
    by_common = held.join(made_of, "gram").select("passage", "item_key", F.lit(False).alias("sure"), "needed").distinct()
    return by_seed.unionByName(by_common).groupBy("passage", "item_key").agg(F.max("sure").alias("sure"), F.min("needed").alias("needed"))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", n: int = 3, stretch: int = 4, min_score: float = 0.5) -> DataFrame:
    """Texts that hold an item, also edited: ``doc_key, doc_id, item_id, score, word_start, word_end``.

    One row per text and item, the best place. ``score`` is the alignment's
    (match 2, mismatch and gap -1) as a share of the item against itself, at
    least ``min_score``; words are runs of letters, digits and underscores in lower
    case. A copy is found if it keeps two n-grams of its item (one if the item has no
    more than ``stretch``), of them one that at most ``COMMON_ITEMS`` items have, unless common
    n-grams cover ``min_score`` of the item's words; items of fewer than ``n`` words never are.
    Null and empty texts hold nothing; null or repeated ids are kept apart by ``doc_key`` (a digest
    of id and text), and repeated rows give one row together. Either table
    empty gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(row_key(id_col, text_col).alias("doc_key"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bench = items.select(row_key(item_id_col, item_text_col).alias("item_key"), F.col(item_id_col).alias("item_id"),
                         F.col(item_text_col).cast("string").alias("text"))
    doc_kind, item_kind = (x.schema[c].dataType.simpleString() for x, c in ((texts, "doc_id"), (bench, "item_id")))
    result_schema = f"doc_key string, doc_id {doc_kind}, item_id {item_kind}, score double, word_start bigint, word_end bigint"
    sc = spark.sparkContext
    with scratch(spark, "leaks") as s, operator_conf(spark):
        known = s.table(bench.mapInArrow(_item_batches(n), f"item_key string, item_id {item_kind}, words array<string>, grams array<bigint>")
                        .dropDuplicates(["item_key"]), "items", few=True)
        least = known.where(F.size("grams") > 0).agg(F.min(F.size(F.array_distinct("grams")))).first()[0]
        reach = int(known.agg(F.max(F.size("words"))).first()[0] or 1)  # words of the longest item
        at_least = min(-(-(least or 2 * stretch) // stretch), 2)
        bits = sc.broadcast(_bitmap(known.select(F.explode("grams").alias("gram"))))
        passages = texts.mapInArrow(_passage_batches(n, bits, reach, at_least),
                                    f"doc_key string, doc_id {doc_kind}, start bigint, words array<string>, seeds array<bigint>")
        passages = s.table(passages.withColumn("passage", F.sha2(F.concat("doc_key", F.lit(":"), F.col("start").cast("string")), 256)), "passages")
        pairs = s.table(candidate_pairs(s, passages, known, n, stretch, min_score), "pairs", few=True)
        ready = (pairs.join(known.select("item_key", "item_id", "grams", F.col("words").alias("item_words")), "item_key")
                 .join(passages.dropDuplicates(["passage"]), "passage")
                 .where(F.col("sure") | (F.size(F.array_intersect("seeds", "grams")) >= F.col("needed"))))
        scored = ready.select("doc_key", "doc_id", "item_id", "start", "words", "item_words").mapInArrow(_align_batches(min_score), result_schema)
        best = scored.groupBy("doc_key", "item_id").agg(
            F.max_by(F.struct("doc_id", "score", "word_start", "word_end"), F.struct("score", -F.col("word_start"))).alias("b"))
        return s.table(best.select("doc_key", "b.doc_id", "item_id", "b.score", "b.word_start", "b.word_end"), "result", keep=True, few=True)


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the texts in which ``find_leaks`` finds an item; columns stay."""
    keys = find_leaks(docs, items, id_col, text_col, **options).select(F.col("doc_key").alias("__doc_key")).distinct()
    return (docs.withColumn("__doc_key", row_key(id_col, text_col)).join(keys, "__doc_key", "left_anti").drop("__doc_key"))
