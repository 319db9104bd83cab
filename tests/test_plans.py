"""Plan properties that matter at scale."""

import re

from catalog.fixtures import view
from catalog.registry import ORACLES, QUERIES
from modelbom import schemas as sc
from modelbom.operators import extract as ex
from modelbom.operators.common import first_wins


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_corpus_is_read_once(spark, sf_dir):
    hits = ex.scan_hits(view(spark, sf_dir, "src_files"))
    # The view reads part and documents, once each.
    plan = executed(ex.dedupe_discoveries(hits))
    assert len(re.findall(r"FileScan parquet", plan)) == 2


def test_scan_has_no_python_and_no_shuffle_before_hits(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("concat(source, '.md') AS path", "text AS content")
    plan = ex.scan_hits(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "PushedFilters" in plan
    assert "ReadSchema: struct<text:string,source:string>" in plan


def test_first_wins_cuts_before_the_shuffle(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = executed(first_wins(df, ["o_custkey"], ["o_orderkey"]))
    assert plan.count("WindowGroupLimit") == 2 and plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_scoring_does_not_shuffle(spark, sf_dir):
    from catalog import fixtures as fx
    from modelbom.operators import score

    rows = fx.components(spark, sf_dir).repartition(3)
    plan = score.completeness(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION")


def test_hot_bom_is_split(spark, sf_dir):
    """The join of a BOM's data components with its model must be one that Spark can split."""
    from modelbom.operators.assemble import dependency_edges

    plan = dependency_edges(spark.createDataFrame([], sc.COMPONENTS))._jdf.queryExecution().analyzed().toString()
    assert "Join Inner" in plan and "LeftOuter" not in plan


def test_dependencies_join_once(spark):
    from modelbom.operators.merge import merge_dependencies

    rows = spark.createDataFrame([], "target_id string, seq int, ord bigint, ref string, pos bigint, depends_on string")
    plan = merge_dependencies(rows)._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"\bJoin\b", plan)) == 1


def test_query_names():
    assert set(ORACLES) == set(QUERIES)
