"""Every stage of the pipeline on its own input against plain versions, and the whole on edge rows and an empty table."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
import __spark_entry__ as entry
from pagelens.llm import pii
from pagelens.session import fresh_path, materialize
from tests.llm import brute
from tests.llm.test_documents import check_packing
from tests.oracle_check import compare, connect

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def redacted(text):
    spans = [[*s] for s in brute.personal(text).values()]
    return pii.redact(text, spans, [])


def check_stage(name, before, after, docs):
    texts = lambda rows: [(r.doc_id, r.text) for r in rows]
    if name != "pack":
        assert docs.columns[:5] == COLUMNS
    if name == "language":
        gone = Counter(texts(before)) - Counter(texts(after))
        assert not Counter(texts(after)) - Counter(texts(before))
        assert all(t is None or not any(c.isalpha() for c in t) or len(brute.words(t)) < 5 for _, t in gone)
    elif name == "near_copies":
        assert sorted(r.doc_id for r in after if r.doc_id is not None) == brute.kept_ids(texts(before))
        assert not Counter(texts(after)) - Counter(texts(before))
    elif name == "personal_data":
        assert Counter(texts(after)) == Counter((r.doc_id, redacted(r.text)) for r in before)
    elif name == "mix":
        sizes, got = defaultdict(int), defaultdict(int)
        for r in before:
            sizes[r.source] += len(brute.words(r.text))
        for r in after:
            got[r.source] += len(brute.words(r.text))
        assert {s: round(t) for s, t in brute.targets(sizes).items() if round(t)} == dict(got)
        assert all(r.n_chars == len(r.text) for r in after)
    else:
        check_packing(after, texts(before))


def test_stages_on_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), "stage")
        after = docs.collect()
        check_stage(name, before, after, docs)
        before = after
    assert sorted(map(tuple, pipeline.run(spark, folder).collect())) == sorted(map(tuple, before))


def test_stages_on_edge_rows_and_nothing(spark, edge, nothing):
    for docs in (edge, nothing):
        folder = fresh_path(spark, "given")
        docs.write.parquet(f"{folder}/documents.parquet")
        rows = docs.collect()
        for name, stage in pipeline.STAGES:
            docs = materialize(stage(spark, docs, folder), "stage")
            after = docs.collect()
            if name in ("language", "mix", "pack", "near_copies"):
                check_stage(name, rows, after, docs)
            rows = after
        assert entry.queries()["pipeline"](spark, folder).count() == len(rows)


def test_registration():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert "op8_mixing" in entry.oracle_sql()


@pytest.mark.parametrize("name", ["op6_chat", "op8_mixing", "op9_rules", "op11_merkle", "op13_bitplanes"])
def test_query_equals_its_oracle(spark, name):
    folder = "/root/testdata/sf0.001"
    ok, detail = compare(spark, connect(folder), folder, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, detail
