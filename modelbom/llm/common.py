"""What the operators of this package share: shared-folder tables, text columns, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that parts words: space and the control characters 9 to 13.
SPACE = "\t\n\x0b\x0c\r "


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, one in the warehouse, but only on a local master:
    on a cluster its default is a folder of the driver's machine."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")
    if folder:
        return folder.rstrip("/")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/modelbom-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several plans read to the shared folder and read it from there.

    Lineage ends at the written files, so a lost executor costs only its running tasks.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_small(df: DataFrame, name: str, size: int = 1 << 22) -> DataFrame:
    """``store`` for plans whose rows carry large binaries to Python workers: Arrow batches of ``size`` bytes at most
    (or one row), since the JVM and the worker both hold a batch outside the heap, and Spark's default is 64 MB."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    old = conf.get(key, None)
    conf.set(key, str(size))
    try:
        return store(df, name)
    finally:
        conf.unset(key) if old is None else conf.set(key, old)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored table that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("modelbom-"):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with their columns fixed: a filter above is not pushed below.

    Pushed through the projections, a filter would take the array expressions along and compute them
    again for every element. A one-row generator keeps it above them.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.inline(F.array(row)))


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, root), root the least node.

    Alternating large-star and small-star rounds. Each round aggregates a minimum per node (combined
    before the shuffle) and joins it back, so no neighbour list is ever gathered; a hub's edges are
    split by the adaptive skew join. Every round is stored; it ends when nothing changes.
    """
    pair = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, last = store(pair, name), None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct()
        new = store(small, name)
        forget(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
