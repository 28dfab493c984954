"""One text of 200,000 words with something to find at its very end, and one of a single endless word."""

import zlib

import pytest

from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.packing import pack_documents
from tidemark.llm.secrets import redact_secrets, scan_secrets
from tidemark.llm.sharding import shard_documents
from tidemark.llm.simhash import fingerprint, simhash_dedup
from tidemark.llm.token_counts import token_counts

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
TAIL = f' Released under the MIT License. {ITEM} token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"'
LONG = " ".join(f"wörd{i * 7919 % 50021}" for i in range(200_000)) + TAIL
BLOCK = "x" * 400_000


@pytest.fixture()
def long_docs(make_docs):
    return make_docs([LONG, BLOCK, "short"])


def test_whole_texts_count(spark, long_docs):
    from tokenizers import Tokenizer

    from tidemark.llm.token_counts import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path())
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in (LONG, BLOCK, "short")]
    assert [r["n_tokens"] for r in token_counts(long_docs).orderBy("doc_id").collect()] == want
    lengths = {}
    for r in pack_documents(long_docs).collect():
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {i: n + 1 for i, n in enumerate(want)}
    assert {r["text_crc32"] for r in shard_documents(long_docs).collect()} == {zlib.crc32(t.encode()) for t in (LONG, BLOCK, "short")}


def test_the_end_is_searched(spark, long_docs):
    spans = {r["doc_id"]: r["spans"] for r in scan_secrets(long_docs).collect()}
    start = LONG.index("token = ")
    assert spans[0] == f"assign:{start}:{len(LONG) - 1},hex:{start + 9}:{len(LONG) - 1}" and spans[1] == ""
    redacted = {r["doc_id"]: r["text"] for r in redact_secrets(long_docs).collect()}
    assert redacted[0] == LONG[:start] + '[SECRET]"' and redacted[1] == BLOCK
    bench = spark.createDataFrame([(0, ITEM)], "item_id bigint, text string")
    assert [(r["doc_id"], r["score"]) for r in find_leaks(long_docs, bench).collect()] == [(0, 1.0)]
    assert [(r["doc_id"], r["license"]) for r in scan_licenses(long_docs).collect()] == [(0, "MIT")]
    fps = {r["doc_id"]: r["fingerprint"] for r in simhash_dedup(long_docs, passes=1).collect()}
    assert fps == {i: f"{fingerprint(t.encode()):016x}" for i, t in enumerate((LONG, BLOCK, "short"))}
