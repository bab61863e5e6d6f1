"""The registered queries against their SQL, and the pipeline stage by stage."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline
from gaugewright.llm import containment, jaccard_join, language_id
from gaugewright.llm.queries import ORACLE_SQL, QUERIES, read
from oracle import compare, database


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, folder, name):
    assert compare(spark, database(folder), folder, QUERIES[name], ORACLE_SQL[name]) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, folder):
    docs = read(spark, folder, "documents")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = spark.createDataFrame(stage(spark, kept, folder).collect(), docs.schema)
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert kept.columns == columns and after <= before
        if name == "language":
            assert len(after) >= 0.97 * len(before)
        if name == "near duplicates":
            assert jaccard_join.near_duplicates(kept).where("n_links > 0").count() == 0
        if name == "decontamination":
            assert containment.contained_items(kept, read(spark, folder, "benchmark")).count() == 0
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept.collect()}


CAT = "the cat sat on the mat with the hat"


def test_stages_take_nulls_and_nothing(spark, frame, folder):
    schema = read(spark, folder, "documents").schema
    rows = [(1, CAT, "en", "a", 36), (1, CAT, "en", "a", 36), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "the cat sat on the mat with the dog", None, None, 1), (4, "1234", "en", "c", 4), (5, "the dog and the cat sat on a hat", None, None, 9)]
    for start in (rows, []):
        docs = spark.createDataFrame(start, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, folder).collect(), schema)
        assert sorted((r.doc_id or 0) for r in docs.collect()) == ([0, 1, 5] if start else [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == (3 if start else 0)
    assert language_id.UNKNOWN == "und"


def test_stages_judge_rows_without_an_id_and_under_a_shared_one(spark, folder):
    item = read(spark, folder, "benchmark").first().text
    other = "one two three four five six seven eight nine ten"
    rows = [(None, CAT), (None, CAT), (7, CAT), (7, other), (9, other), (None, f"before it {item} after it"), (8, f"{item}"), (8, "clean words that stand here alone without any item")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect())
    assert [r for r in kept if item not in r[1]] == [(7, other), (7, CAT), (8, rows[-1][1])]
    left = corpus_pipeline.decontamination(spark, docs, folder).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted((i or 0, t) for i, t in rows if item not in t)


def test_stages_keep_columns_of_clashing_names(spark, folder):
    names = ["score", "lang_pred", "n_lines", "n_removed", "n_links", "group_id", "row_0", "kept"]
    docs = spark.createDataFrame([(k, CAT, "en", "a", *[f"{n}{k}" for n in names]) for k in (1, 2)], f"doc_id bigint, text string, lang string, source string, {', '.join(f'{n} string' for n in names)}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert sorted(tuple(r)[4:] for r in out.collect())[0] == tuple(f"{n}1" for n in names)
