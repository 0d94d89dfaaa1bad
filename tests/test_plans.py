"""What the physical plans must have: pushed filters, pruned columns, pruning before the shuffle, top-n sorts."""

import re

import pytest

from tesserae.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"


#: Queries that parse HTML, URLs or robots files, search for many texts at once, fold rows in order, or read a source in Python.
PYTHON = ("cursor_scan", "capture_pipeline", "collect_counts", "decoded_pages", "one_redirect", "verbatim_grounding", "rolling_admission", "soft_warnings", "domain_schedule", "job_state_fold", "reserve_outcomes")


def plan(spark, name):
    df = REGISTRY[name].run(spark, SF)
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def schemas(text):
    return re.findall(r"ReadSchema: struct<(.*)>", text)


@pytest.mark.parametrize("name", ["latest_ok_per_entity", "dedup_keep_first", "pinned_identity", "claim_queue", "sample_freeze", "host_page_cap"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert text.index("WindowGroupLimit") >= 0 and text.count("WindowGroupLimit") >= 2


def test_filters_reach_the_scan(spark):
    text = plan(spark, "latest_ok_per_entity")
    assert "EqualTo(o_orderstatus,F)" in text and "o_orderpriority" not in schemas(text)[0]
    assert "EqualTo(source,src8)" in plan(spark, "faceted_search")


@pytest.mark.parametrize(("name", "absent"), [("ledger_exposure", "l_shipdate"), ("days_active", "l_extendedprice"), ("theme_rollup", "text:"), ("host_page_cap", "html"), ("url_parts", "html"), ("rolling_counts", "props")])
def test_columns_are_pruned(spark, name, absent):
    assert all(absent not in s for s in schemas(plan(spark, name)))


@pytest.mark.parametrize("name", ["faceted_search", "bounded_buffer"])
def test_limits_are_top_n(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in PYTHON])
def test_no_python_where_built_ins_do(spark, name):
    assert not re.search("PythonUDF|EvalPython|InPandas|InArrow|MapPandas", plan(spark, name))


def test_containment_collects_no_quotes(spark, monkeypatch):
    """All the driver gets of the quotes is their number, the kinds of their grams and the filter's bits."""
    frame, columns = type(spark.range(0)), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (columns.extend(self.columns), collect(self))[1])
    text = plan(spark, "verbatim_grounding")
    assert set(columns) == {"n", "kinds"} and not re.search("CartesianProduct|NestedLoop", text) and text.count("documents.parquet") == 1


@pytest.mark.parametrize("name", ["rolling_admission", "soft_warnings", "domain_schedule", "job_state_fold", "reserve_outcomes"])
def test_folds_are_streams(spark, name):
    text = plan(spark, name)
    assert "MapInArrow" in text and not re.search("GroupsIn|CoGroup|collect_list|InPandas", text)


#: Lists over groups that have a bound: examples, first turns, one registry's keys, pages of a brand, references within a limit, a model's answer.
BOUNDED_LISTS = ("theme_rollup", "prompt_render", "error_samples", "whitespace_drafts", "whitespace_refs", "brand_batch", "voc_drafts")


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in BOUNDED_LISTS])
def test_no_group_becomes_a_list(spark, name):
    assert not re.search("collect_list|collect_set|BroadcastNestedLoopJoin Cross|CartesianProduct", plan(spark, name))


@pytest.mark.parametrize("name", ["whitespace_drafts", "whitespace_refs"])
def test_parts_and_suppliers_are_counted_before_they_meet(spark, name):
    """Else the join has a row for each pair of them, which grows with the square of the tables."""
    keys = re.findall(r"Keys[^:]*: \[(.*)\]", plan(spark, name))
    assert any("s_nationkey" in k and "p_" not in k for k in keys) and any("p_type" in k and "s_nationkey" not in k and "batch_id" not in k for k in keys)


def test_an_ad_is_parsed_once(spark):
    """Each field that is used, and the filters, read the row that parsing made."""
    assert len(re.findall(r"from_json\(", plan(spark, "nested_ads"))) == 1
