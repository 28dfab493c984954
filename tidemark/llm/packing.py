"""Best-fit packing of tokenized documents with exact-complement hashing.

Lengths are whole numbers up to ``max_len``, so the plan needs only how many
pieces of each length there are: a histogram of ``max_len`` counts, whatever
the corpus size. The plan is a list of patterns (a multiset of lengths and how
often it is used):

1. from the longest length down, gaps are filled exactly from an index of
   single, pair and triple length sums, as often as the counts allow;
2. what has no exact complement is packed best-fit: the longest piece that
   still fits goes in first.

Pieces are numbered without gaps inside their length by a distributed count,
and the number picks the pattern, its repetition and the place in it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.llm.support import operator_conf, scratch, shuffle_width
from tidemark.llm.token_counts import UNSURE, _files, byte_alphabet, vocabulary_path

ship_by_value(__name__)


# ---------------------------------------------------------------- the plan

class _SumIndex:
    """Which lengths, and pairs of lengths, sum to a gap, by present lengths."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.refresh()

    def refresh(self) -> None:
        self.have = np.flatnonzero(self.counts)
        pairs = np.full(len(self.counts), 0, np.int64)  # the larger length of a pair with this sum, 0 if none
        for a in self.have:
            partner = self.have[self.have < a]
            if self.counts[a] >= 2:
                partner = np.append(partner, a)
            sums = partner + a
            pairs[sums[sums < len(pairs)]] = a  # the largest wins: long pieces go first
        self.pairs = pairs

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """Lengths that fill ``gap`` exactly under the counts: one, two or three."""
        if self.counts[gap]:
            return (gap,)
        if self.pairs[gap]:
            a = int(self.pairs[gap])
            return (a, gap - a)
        for a in self.have[self.have < gap][::-1].tolist():
            b = int(self.pairs[gap - a])
            if b:
                need = (a, b, gap - a - b)
                if all(self.counts[x] >= need.count(x) for x in need):
                    return need
        return None


def plan_patterns(counts: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns ``(lengths, times)`` that use every piece of ``counts`` once."""
    left = np.zeros(max_len + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> bool:
        """Take the pattern as often as the counts allow; whether a length ran out or fell to one."""
        need = {x: pattern.count(x) for x in pattern}
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        plan.append((pattern, times))
        return any(left[x] < 2 for x in need)

    if left[max_len]:
        use((max_len,))
    index = _SumIndex(left)
    for length in range(max_len - 1, 0, -1):
        while left[length]:
            left[length] -= 1  # the piece that opens the sequence is not its own filler
            if left[length] < 2:
                index.refresh()
            found = index.fill(max_len - length)
            left[length] += 1
            if found is None:
                index.refresh()
                break
            use((length, *found))
            index.refresh()
    while left.any():
        present = np.flatnonzero(left)
        pattern, room = [], max_len
        taken: dict[int, int] = {}
        while len(present := present[present <= room]):
            x = int(present[-1])
            if taken.get(x, 0) < left[x]:
                pattern.append(x)
                taken[x] = taken.get(x, 0) + 1
                room -= x
            else:
                present = present[:-1]
        use(tuple(pattern))
    return plan


def place_ranges(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows ``length, first rank, first sequence, offset``, sorted: piece ``rank`` of
    a length lies in the last range starting at or below it."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for x in pattern:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


# ------------------------------------------------------------- tokenizing

class TokenIds:
    """Token ids of a text as the library gives them for a byte-level file.

    A faster encoder runs the same merges when the file's ids are its merge
    order (checked); special strings and characters of newer Unicode versions
    go to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        self.whole, _, self.specials, vocab = _files(path)
        with open(path, encoding="utf-8") as f:
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in json.load(f)["model"]["merges"]]
        to_byte, self.fast = byte_alphabet(), None
        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if all(c in to_byte for c in t) and t not in self.specials}
        singles = sorted(i for t, i in vocab.items() if len(t) == 1)
        if singles == list(range(256)) and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges)) and len(ranks) == 256 + len(merges):
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not UNSURE.search(text) and not any(s in text for s in self.specials):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def _piece_batches(path: str, end_id: int, max_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = TokenIds(path), np.array([end_id], np.uint32)
        for b in batches:
            rows, of = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.concatenate((coder.ids(text), end)).astype("<u4")
                first = len(ids) if len(ids) <= max_len else len(ids) % max_len or max_len
                cuts = [0, *range(first, len(ids) + 1, max_len)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((k, s, e - s, zlib.crc32(ids[s:e].tobytes())))
                    of.append(i)
            cols = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(of, pa.int64())), pa.array(cols[0].astype(np.int32)),
                 *(pa.array(np.ascontiguousarray(c)) for c in cols[1:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def _place_batches(ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranges.value
        keys = (table[:, 0] << 44) | table[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 1024,
                   end_id: int = 2, path: str | None = None) -> DataFrame:
    """Pack ``docs`` into sequences of at most ``max_len`` tokens.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``. A document is its token ids and ``end_id``; only
    longer ones are cut, the first piece taking what is left over. Null and
    empty texts are one piece of length 1; null or repeated ids keep their own
    rows (equal rows are placed in any order); no rows give no rows; other
    columns are not read. ``sequence_id`` runs from 0 without gaps.
    """
    spark, path = docs.sparkSession, path or vocabulary_path()
    light = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = light.schema["doc_id"].dataType.simpleString()
    piece_schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    with scratch(spark, "packing") as s, operator_conf(spark):
        pieces = s.table(light.mapInArrow(_piece_batches(path, end_id, max_len), piece_schema), "pieces")
        parts = 4 * shuffle_width(spark)
        pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
        sizes = s.table(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "sizes", few=True)
        counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_len rows at most
        ranges = spark.sparkContext.broadcast(place_ranges(plan_patterns(counts, max_len)))
        before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("skip"))
        own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
        ranked = pieces.withColumn("rank", F.row_number().over(own).cast("bigint") - 1).join(before, ["length", "part"])
        ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("skip")).alias("rank"))
        return s.table(ranked.mapInArrow(_place_batches(ranges), piece_schema + ", sequence_id bigint, offset bigint"),
                       "result", keep=True, few=True)
