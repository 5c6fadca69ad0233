"""The pipeline's stages on rows with nulls, copies, extra columns and an empty table."""

from collections import Counter

import pytest

from .test_operators import ROWS, SCHEMA, brute_lines, components_of, words_of


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_stages(spark, pipeline):
    rows = [(*r, 1, "x") for r in ROWS]
    docs = spark.createDataFrame(rows, SCHEMA + ", row int, p string").repartition(3)
    columns = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, "")
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["language_id"]
    gone = Counter(r["doc_id"] for r in before) - Counter(r["doc_id"] for r in after)
    assert set(gone) >= {60, 61, 62, 63, 69} and set(gone) <= {60, 61, 62, 63, 64, 65, 67, 68, 69, 70}
    before, after = seen["line_dedup"]
    want = [(i, kept) for i, _, removed, kept in brute_lines([(r["doc_id"], r["text"]) for r in before]) if not removed or kept.strip(" ")]
    assert sorted(((r["doc_id"], r["text"]) for r in after), key=str) == sorted(want, key=str)
    before, after = seen["near_dedup"]
    root = components_of([(r["doc_id"], r["text"]) for r in before])
    want = Counter({r["doc_id"]: 1 for r in before if r["doc_id"] is not None and root[r["doc_id"]] == r["doc_id"]})
    want[None] = sum(r["doc_id"] is None for r in before)
    assert Counter(r["doc_id"] for r in after) == +want
    first = {}
    for r in before:
        first[r["doc_id"]] = min(first.get(r["doc_id"], r["text"]), r["text"])
    assert all(r["text"] == first[r["doc_id"]] for r in after if r["doc_id"] is not None)
    before, after = seen["mixing"]
    assert {(r["doc_id"], r["text"]) for r in after} == {(r["doc_id"], r["text"]) for r in before} and len(after) >= len(before)
    tokens, copies = Counter(), Counter()
    for r in before:
        tokens[r["source"]] += len(words_of(r["text"]))
    for r in after:
        copies[r["source"]] += len(words_of(r["text"]))
    most = max(tokens, key=tokens.get)
    assert copies[most] == tokens[most] and all(tokens[s] <= copies[s] <= 2 * tokens[s] + max(len(words_of(r["text"])) for r in before) for s in tokens)
    before, after = seen["packing"]
    assert sum(r["length"] for r in after) >= sum(len(words_of(r["text"])) for r in before)
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}


def test_empty(spark, pipeline):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, "")
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() == 0


def test_run(spark, pipeline):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.where("offset + length > 2048").count() == 0
