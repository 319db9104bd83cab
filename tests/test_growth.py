"""Steps whose longest task or memory grew with the whole input: how their rows are dealt and combined."""

import pytest
from pyspark.sql import functions as F

from catalog import fixtures as fx
from modelbom.operators import assemble, merge, score, security
from modelbom.operators.assemble import apply_user_values


@pytest.fixture
def one_split(spark, tmp_path):
    """Tables in one row group each, read as more splits than there are cores: all rows of a table lie in one of them."""
    rows = spark.range(0, 4000, 1, 1)
    rows.selectExpr("id c_custkey", "concat('c', id) c_name", "'SEG' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    rows.selectExpr("id o_orderkey", "id % 7 o_custkey", "'1' o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    key, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    old = {k: spark.conf.get(k) for k in (key, cost)}
    spark.conf.set(key, "1000")
    spark.conf.set(cost, "0")
    yield str(tmp_path)
    for k, v in old.items():
        spark.conf.set(k, v)


def largest_share(df):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / sum(counts)


@pytest.mark.parametrize("query", ["A13", "X3", "L5", "P19"])
def test_rows_of_one_split_are_dealt(spark, one_split, query):
    """Models come from a narrow table whose rows lie in one split; their work is dealt."""
    made = fx.components(spark, one_split)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    models = made.where("is_metadata")
    assert models.count() == 4000 and models.select("k").distinct().count() == 4000
    done = {
        "A13": lambda: score.completeness(models), "X3": lambda: apply_user_values(models, F.create_map(F.lit("x"), F.lit("y"))),
        "L5": lambda: models.select("bom_id"), "P19": lambda: made.select("bom_id"),
    }[query]()
    assert largest_share(done) < 0.5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_before_are_computed_once(spark, one_split):
    """the start stands on two sides of the joins and is one exchange."""
    models = fx.components(spark, one_split).where("is_metadata")
    out = score.enrichment_progress(score.completeness(models), score.completeness(models))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan_of(out.select("*"))
        assert text.count("ReusedExchange") >= 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    rows = out.where("initial_score = refetched_score and initial_passed = refetched_passed").count()
    assert rows == 4000


def test_progress_keeps_rows_of_repeated_and_null_keys(spark):
    before = spark.createDataFrame([("a", 0.5, 1, 2), ("a", 0.6, 1, 2), (None, 0.1, 0, 2)], "bom_id string, score double, passed int, total int")
    after = spark.createDataFrame([("a", 0.9, 2, 2)], before.schema)
    rows = score.enrichment_progress(before, after).collect()
    assert len(rows) == 5 and [r["refetched_score"] for r in rows if r["bom_id"] is None] == [None]


def test_merge_stats_combine_by_hash(spark):
    """no aggregate sorts the rows of a task."""
    schema = "target_id string, seq int, rank int, ord long, is_metadata boolean, name string"
    rows = [("t", 0, 0, 0, True, "m"), ("t", 0, 1, 1, False, "x"), ("t", 0, 1, 2, False, None), ("t", 1, 1, 1, False, "y"), ("t", 1, 1, 2, False, "y"), ("u", 1, 0, 0, True, "n")]
    placed = spark.createDataFrame(rows, schema)
    stats = merge.merge_stats(placed, placed.where("ord < 2"))
    assert sorted(map(tuple, stats.collect())) == [("t", 2, 1, 1, "m"), ("u", 0, 1, 0, None)]
    first = [line for line in plan_of(stats).splitlines() if "partial_count_if" in line or "partial_count" in line]
    assert first and not any("SortAggregate" in line for line in first)


def test_hot_ref_is_not_one_task(spark):
    """The edges of one ref leave the join by an exchange on the edge, also without a broadcast."""
    rows = spark.range(0, 3000).selectExpr("'t' target_id", "cast(id % 5 as int) seq", "id ord", "'hot' ref", "id pos", "concat('d', id % 300) depends_on")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges = merge.merge_dependencies(rows)
        assert edges.count() == 300
        assert largest_share(edges) < 0.9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def stages_of(df):
    """Rows per task of a result."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


@pytest.fixture
def plain_joins(spark):
    """Sort-merge joins whose partitions stay as they are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_references_to_a_hot_dataset_are_dealt(spark, plain_joins):
    """the components of a hot dataset are not made in one task."""
    refs = spark.range(0, 60_000).selectExpr("concat('m', id) bom_id", "0L ord", "'ds/hot' dataset_id")
    odd = spark.createDataFrame([("m", 1, "ds/cold"), ("m", 2, "ds/none"), ("m", 3, None), ("m", 1, "ds/cold")], "bom_id string, ord long, dataset_id string")
    hub = spark.createDataFrame([("ds/hot", "a"), ("ds/cold", "b"), (None, "c")], "id string, author string").withColumn("card_data", F.try_parse_json(F.lit('{"configs":[{"config_name":"main"}]}')))
    card = spark.createDataFrame([("ds/cold", "mit"), (None, "x")], "id string, license string")
    out = assemble.attach_datasets(refs.unionByName(odd), hub, card)
    counts = stages_of(out)
    assert sum(counts) == 60_002 and max(counts) < 45_000
    cold = out.where("dataset_id != 'ds/hot'").select("bom_id", "ord", "dataset_id", "scan.name", "api.author", "card.license", "card.configs.name").collect()
    assert [tuple(r) for r in cold] == [("m", 1, "ds/cold", "ds/cold", "b", "mit", ["main"])] * 2
    assert out.where("dataset_id = 'ds/hot' and card is null and api.author = 'a'").count() == 60_000


@pytest.mark.parametrize("name", ["cards", "src_files", "hub_datasets"])
def test_texts_of_one_row_group_are_dealt(spark, one_split, name):
    """rows in one row group are not parsed in one task, though the file has many splits."""
    rows = spark.range(0, 4000, 1, 1)
    rows.selectExpr("id doc_id", "concat('text ', id) text", "'en' lang", "'web' source", "10L n_chars").write.parquet(f"{one_split}/documents.parquet")
    rows.selectExpr("id s_suppkey", "concat('s', id) s_name", "0 s_nationkey").write.parquet(f"{one_split}/supplier.parquet")
    spark.sql("SELECT 0 n_nationkey, 'n' n_name").write.parquet(f"{one_split}/nation.parquet")
    rows.where("id < 0").selectExpr("id p_partkey", "'' p_brand", "'' p_name").write.parquet(f"{one_split}/part.parquet")
    made = fx.view(spark, one_split, name)
    assert made.count() == 4000 and largest_share(made) < 0.5


def test_findings_of_a_hot_repository_are_dealt(spark, plain_joins):
    """neither the gate nor the join with components brings the files of a hot repository to one task."""
    file = F.struct(F.lit("unsafe").alias("status"), *[
        F.struct(F.lit(None).cast("string").alias("status"), *[F.lit(None).cast("string").alias(n) for n in names]).alias(key)
        for key, names in {k: ("message", "reportLink", "reportLabel") for k in ("protectAiScan", "avScan", "virusTotalScan", "jFrogScan")}.items()
    ], F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast("array<struct<module:string,name:string,safety:string>>").alias("pickleImports"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("version")).alias("pickleImportScan"))
    hot = spark.range(0, 60_000).selectExpr("'model' kind", "'org/hot' repo_id", "0 page", "concat('f', id) path")
    odd = spark.createDataFrame([("model", "org/cold", 0, "x"), ("model", "org/cold", 0, "x"), ("model", None, 0, "y"), ("dataset", "org/hot", 0, "z")], "kind string, repo_id string, page int, path string")
    entries = hot.unionByName(odd).withColumn("securityFileStatus", file)
    findings = security.file_findings(entries)
    counts = stages_of(findings)
    assert sum(counts) == 60_003 and max(counts) < 45_000
    targets = spark.createDataFrame(
        [("b1", 0, True, "r1", "model", "org/hot"), ("b2", 0, True, "r2", "model", "org/cold"), ("b3", 1, False, "r3", "dataset", "org/hot"), ("b4", 0, True, "r4", "model", None)],
        "bom_id string, ord long, is_metadata boolean, bom_ref string, kind string, hub_id string",
    )
    out = security.file_vulnerabilities(targets, entries)
    counts = stages_of(out)
    assert sum(counts) == 60_003 and max(counts) < 45_000
    few = out.where("bom_id != 'b1'").select("bom_id", "bom_ref", "path").collect()
    assert sorted(map(tuple, few)) == [("b2", "hfsec-r2-x", "x"), ("b2", "hfsec-r2-x", "x"), ("b3", "hfsec-r3-z", "z")]
