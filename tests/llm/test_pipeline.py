import re

import pytest

import corpus_pipeline
from tidemark.llm.queries import ORACLE_SQL, QUERIES
from tidemark.llm.secrets import redact
from tidemark.llm.simhash import fingerprint


N = 600


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "secrets", "packing"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    prose = [" ".join(f"w{(i * 31 + j * j * 7 + j) % 997}" for j in range(30 + i % 90)) for i in range(N)]
    item = " ".join(f"q{i}" for i in range(24))
    texts = [p + (" vile scum" if i % 5 == 0 else "") for i, p in enumerate(prose)]
    texts += [texts[1], texts[1], prose[2] + " " + item, prose[3] + ' token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" x', "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(N)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, texts


def test_stages_do_what_they_say(spark, tables):
    at, texts = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, at)
    left = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and sum(i % 5 == 0 for i in left if i < N) <= 0.05 * N / 5 and sum(i % 5 != 0 for i in left if i < N) >= 0.96 * N * 4 / 5

    one = stages["simhash"](spark, docs, at)
    fps = [fingerprint((t or "").encode()) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        comp = [min(comp[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(texts))]
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(comp)) and one.columns == docs.columns

    no_leaks = stages["decontamination"](spark, docs, at)
    assert {r["doc_id"] for r in no_leaks.collect()} == set(range(len(texts))) - {N + 2}
    redacted = stages["secrets"](spark, docs, at)
    assert {r["doc_id"]: r["text"] for r in redacted.collect()} == {i: redact(t) for i, t in enumerate(texts)}


def test_run_ends_with_packed_pieces(spark, tables):
    at, _ = tables
    rows = corpus_pipeline.run(spark, at).collect()
    assert {N, N + 1, N + 2} & {r["doc_id"] for r in rows} == set()
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 1024
