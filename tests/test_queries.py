"""Every query against its oracle, and the shape of the plans."""

import json
import subprocess
import sys

import pytest
from compare import ROOT, compare, connect

from __spark_entry__ import entry
from platwork.operators import match
from platwork.plans.oracles import ORACLES
from platwork.plans import queries
from platwork.plans.queries import AS_OF, QUERIES, Tables
from platwork.plans.imports import import_permits
from platwork.session import shared_dir


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, folder, name):
    problem, *_ = compare(spark, con, name, QUERIES[name], ORACLES[name], folder)
    assert problem is None, problem


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["permit_type", "permits", "in_error", "matched", "avg_confidence"] and df.count() > 5


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["match_addresses", "attach_best_parcel", "parcel_by_address", "parcel_by_number", "parcel_search", "flag_duplicate_permits", "upsert_keyed"]
)
def test_no_cross_joins_and_no_python(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan


def test_the_feed_is_read_once_for_the_texts_and_once_for_the_result(spark, folder):
    # The distinct texts were written by the first read; the plan that is left reads the feed once.
    assert plan_of(QUERIES["attach_best_parcel"](spark, folder)).count("/orders.parquet]") <= 1


def test_filters_and_columns_reach_the_scan(spark, folder):
    orders = Tables(spark, folder).base("orders").withColumnsRenamed({"o_orderstatus": "status", "o_orderkey": "src_row"})
    plan = plan_of(orders.filter("status = 'F'").select("src_row"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_no_query_consists_of_a_cap():
    assert "candidate_cap" not in QUERIES


def test_rank_limit_runs_before_the_shuffle(spark, folder):
    parcels = match.parcel_dimension(Tables(spark, folder).view("fx_parcel"))
    plan = plan_of(match.candidate_cap(parcels, ["street_number"], 100))
    assert plan.count("WindowGroupLimit") == 2


def test_a_session_without_a_shared_folder_is_refused_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session(), "x")


def test_flow_without_parcels(spark, folder):
    raw = Tables(spark, folder).view("fx_permit_raw")
    assert "match_confidence" not in import_permits(raw, AS_OF).columns


def test_bench_prints_one_json_line(folder):
    code = "import bench, os; bench.HEADLINE, bench.NUMBERED = ('permit_import_stats',), (); bench.main()"
    env = {"BENCH_SF_DIR": folder, "BENCH_CPUS": "2"}
    import os

    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, **env}, capture_output=True, text=True, timeout=300)
    line = json.loads(out.stdout.strip().splitlines()[-1])
    assert line["unit"] == "sec" and set(line["queries"]) == {"permit_import_stats"}


@pytest.mark.parametrize("name", ["min_confidence_filter", "rank_matches"])
def test_scored_queries_read_the_tables_before_the_last_join(spark, folder, name):
    files = QUERIES[name](spark, folder).inputFiles()
    assert files and not [f for f in files if "customer" in f or "orders" in f]


def test_ranks_of_first_parcels_equal_the_full_ranking(spark, folder):
    columns = ["normalized", "pid", "confidence", "match_rank"]
    full = match.rank_matches(queries._scored(Tables(spark, folder)), ["normalized"], 2).select(*columns)
    got = QUERIES["rank_matches"](spark, folder)
    assert got.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))
