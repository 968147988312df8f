"""The pipeline on the smallest tables, stage by stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from gridlark.llm.common import scratch, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = scratch(stage(spark, docs, SF))
        assert docs.columns == names, name
        assert 0 < docs.count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_of_odd_rows(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows and ids, names that the operators use."""
    letters = [chr(97 + k) for k in range(26)]
    prose = lambda seed, n: " ".join("".join(letters[(seed * 31 + k * 7 + j * j * (k + 3)) % 26] for j in range(5)) + str(seed) for k in range(n))
    texts = [(k, prose(k, 40)) for k in range(20)] + [(30, None), (31, ""), (32, " \n\t "), (33, prose(99, 20_000)), (5, prose(5, 40)), (None, prose(50, 40)), (None, None)]
    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    texts += [(40, prose(41, 200)), (41, prose(41, 199) + " changed"), (42, f"{prose(43, 10)} {item} {prose(44, 10)}")]
    given = Counter(i for i, _ in texts)
    rows = [(i, t, None if i == 3 else "en", None, None if t is None else len(t), "x", 1, 2) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, row int, bucket int")
    # a near copy of one line is emptied by line dedup before; on its own input near-dedup drops it
    assert given - Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == Counter([41])
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "row", "bucket"], name
        left[name] = Counter(r.doc_id for r in docs.collect())
    assert left["toxicity"] == left["line_dedup"] == left["near_dedup"] == given
    assert left["near_dedup"] - left["decontamination"] == Counter([42])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert set(left["decontamination"]) == {r.doc_id for r in pieces}
    assert sum(r.n_tokens for r in pieces if r.doc_id == 33) == 20_001


def test_pipeline_of_nothing(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch(stage(spark, docs, SF))
    assert docs.count() == 0
