"""The pipeline stage by stage against the operators' own rows."""

import corpus_pipeline as cp
from folio.llm import quality
from folio.llm.common import documents, materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    counts = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        assert docs.columns == before.columns and docs.join(before, docs.columns, "left_anti").count() == 0
        counts.append(docs.count())
        if name == "quality":
            assert docs.count() == quality.ledger(before).where(quality.kept_by("v1")).count()
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    packed = cp.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]


NAMES = "__toxicity string, __failed long, __n_words int, __text string, __words string, __raw string, __id long, score double, kept boolean"


def test_stages_on_odd_rows(spark):
    """Nulls, repeats, long texts and names that the stages use themselves; columns stay as they came."""
    body = " ".join(f"word{k}" for k in range(60))
    texts = [None, "", body, body + " more", "few words", body.upper(), " ".join(f"long{k}" for k in range(30_000)), None]
    rest = ("x", 1, 2, "t", "w", "r", 9, 0.5, True)
    rows = [(k, t, *rest) for k, t in enumerate(texts)] + [(2, body, *rest), (None, body, *rest), (None, " ".join(f"other{k}" for k in range(40)), *rest)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {NAMES}")
    for _, stage in cp.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "odd")
        assert docs.columns == ["doc_id", "text", *(x.split()[0] for x in NAMES.split(", "))]
    assert sorted(r.doc_id or -1 for r in docs.collect()) == [-1, 2, 6] and docs.where("__toxicity = 'x' and __failed = 1").count() == 3
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == 3


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    for _, stage in cp.STAGES:
        before, docs = docs.columns, materialize(stage(spark, docs, SF), "empty")
        assert docs.count() == 0
    assert "sequence_id" in docs.columns and before == ["doc_id", "text", "source"]
