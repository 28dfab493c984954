"""Token counts by the whole-token shortcut.

Offline, on the driver, every vocabulary string is encoded alone by the real
tokenizer; those that come back as one token are proven, and a pre-token that
equals one counts 1 without any merging. Only the other pre-tokens are merged,
each distinct one once per batch of texts and cache period.

Pre-tokens are cut by the tokenizer's published pattern. Strings of its
special tokens split the text first and count 1 each, as the tokenizer does by
default. Texts with characters whose class differs between Unicode versions
(``UNSURE``) go to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.llm.support import operator_conf, scratch

ship_by_value(__name__)

VOCABULARY = "byte_bpe_50k.json"
#: Merge results kept by a task between batches; beyond it the cache starts anew.
CACHE_WORDS = 400_000
#: Letters and digits that newer Unicode versions added, and all of the higher planes.
UNSURE = re.compile("[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7cb-\ua7f1\uab6c\uab6d\U00010000-\U0010ffff]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _files(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
        raise ValueError(f"{path}: only byte-level tokenizers without normalizer or prefix space are supported")
    specials = [t["content"] for t in spec["added_tokens"]]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens that trim their surroundings are not supported")
    whole = Tokenizer.from_file(path)
    spec["pre_tokenizer"]["use_regex"] = False
    return whole, Tokenizer.from_str(json.dumps(spec)), specials, spec["model"]["vocab"]


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the other bytes take code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    from public_tokenizers import PATTERN

    whole, _, specials, vocab = _files(path)
    to_byte, cut, strings = byte_alphabet(), regex.compile(PATTERN), []
    for token in vocab:
        if token in specials or any(c not in to_byte for c in token):
            continue
        try:
            text = bytes(to_byte[c] for c in token).decode()
        except UnicodeDecodeError:
            continue
        if not UNSURE.search(text) and cut.fullmatch(text) and cut.findall(text) == [text]:
            strings.append(text)
    encoded = whole.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1)


class TokenCounter:
    """Counts tokens of texts; one per task."""

    def __init__(self, path: str, proven: frozenset[str]):
        from public_tokenizers import PATTERN

        self.whole, self.bare, specials, _ = _files(path)
        self.cut = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.proven, self.merged = proven, {}

    def counts(self, texts: list[str]) -> list[int]:
        out, cuts = [0] * len(texts), []
        for i, t in enumerate(texts):
            if UNSURE.search(t):
                out[i] = len(self.whole.encode(t, add_special_tokens=False).ids)
            elif self.special and self.special.search(t):
                parts = self.special.split(t)
                out[i] = len(parts) - 1
                cuts.append((i, [w for p in parts for w in self.cut(p)]))
            else:
                cuts.append((i, self.cut(t)))
        proven, lefts = self.proven, []
        for i, words in cuts:
            # proven pre-tokens count one each; the others are left for merging
            left = [w for w in words if w not in proven]
            out[i] += len(words) - len(left)
            lefts.append((i, left))
        if len(self.merged) > CACHE_WORDS:
            self.merged = {}
        new = list(set().union(*(left for _, left in lefts)).difference(self.merged))
        self.merged.update(zip(new, map(len, self.bare.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        for i, left in lefts:
            out[i] += sum(map(self.merged.__getitem__, left))
        return out


def _count_batches(path: str, proven):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path, proven.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            counts = []
            for i in range(0, len(texts), 256):
                counts += counter.counts(texts[i:i + 256])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"),
                                              pa.array(np.array(counts, np.int64))], ["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
                 path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``.

    Tokens as the library gives them for the file at ``path`` without begin,
    end or added special tokens. Null text counts as empty (0 tokens); rows
    with null or repeated ids keep their own row; other columns are not read.
    """
    spark, path = docs.sparkSession, path or vocabulary_path()
    proven = spark.sparkContext.broadcast(prove_whole_tokens(path))  # bounded by the vocabulary
    light = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    light = light.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    kind = light.schema["doc_id"].dataType.simpleString()
    with scratch(spark, "tokens") as s, operator_conf(spark):
        out = light.mapInArrow(_count_batches(path, proven), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
        return s.table(out.withColumn("over_limit", F.col("n_tokens") > limit), "result", keep=True)
