"""Every registered query with SQL against DuckDB, and the pipeline against its stages by hand."""

import re

import pytest
from compare import connect, differences

import corpus_pipeline
from test_near_copies import plain_firsts
from tidemark.llm import queries
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"pipeline"}))
def test_gives_rows(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", ["op2_source_mix", "op3_license_scan", "op4_secret_scan", "op9_chat_lines", "op11_host_rules"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_search_plans_have_no_cross_join(spark):
    for name in ("op1_inner_product_search", "op5_simhash_groups", "op8_main_text", "op10_benchmark_matches"):
        assert not re.search("CartesianProduct|BroadcastNestedLoop", queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString())


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept and kept <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "simhash_near_dedup":
            listed = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
            assert kept == {listed[i][0] for i in plain_firsts(listed)}
        docs = spark.createDataFrame(out.collect(), out.schema)
    files = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert files.count() == docs.count()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in docs.collect())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        given = table(spark, SF, name)
        (given if name != "documents" else given.limit(0)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
