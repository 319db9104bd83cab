"""Resharding by minimum-cost flow: the block transfers that move the fewest bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelbom.llm.common import new_path, store

#: Rows of a block, the unit in which running sizes are summed: two to this power.
BLOCK_BITS = 13


def min_cost_flow(supply: list[int], room: list[int], cost) -> list[list[int]]:
    """flow[i][j]: amounts from i to j that use all supply within the room at least total cost.

    Successive shortest paths over the residual graph by Bellman-Ford; nodes are shards, so it is small
    whatever the data. ``cost(i, j)`` is the cost of a unit, not negative.
    """
    n, m = len(supply), len(room)
    if sum(supply) > sum(room):
        raise ValueError("the new shards do not hold the data")
    flow = [[0] * m for _ in range(n)]
    left, free = list(supply), list(room)
    while any(left):
        dist = [0 if x else float("inf") for x in left] + [float("inf")] * m
        via: list[int | None] = [None] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost(i, j) < dist[n + j]:
                        dist[n + j], via[n + j], changed = dist[i] + cost(i, j), i, True
                    if flow[i][j] and dist[n + j] - cost(i, j) < dist[i]:
                        dist[i], via[i], changed = dist[n + j] - cost(i, j), n + j, True
            if not changed:
                break
        end = min((j for j in range(m) if free[j]), key=lambda j: dist[n + j])
        path, node = [n + end], n + end
        while via[node] is not None:
            node = via[node]
            path.append(node)
        path.reverse()
        steps = list(zip(path, path[1:]))
        amount = min([left[path[0]], free[end]] + [flow[b][a - n] for a, b in steps if a >= n])
        for a, b in steps:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        free[end] -= amount
    return flow


def equal_shares(total: int, shards: int) -> list[int]:
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def write_shards(docs: DataFrame, path: str, shard: Column, text: str = "text") -> None:
    """Write documents as shard folders: doc_id, text, and row_id, which orders all rows."""
    docs.select(
        F.col("doc_id").cast("long"), F.col(f"`{text}`").alias("text"),
        F.monotonically_increasing_id().alias("row_id"), shard.cast("int").alias("shard"),
    ).write.option("compression", "zstd").partitionBy("shard").parquet(path)


_SCHEMA = "doc_id long, text string, row_id long, shard int"


def read_shards(spark: SparkSession, *paths: str) -> DataFrame:
    parts = [spark.read.schema(_SCHEMA).parquet(p) for p in paths]
    return reduce(DataFrame.unionByName, parts)


def size() -> Column:
    """UTF-8 bytes of the text plus one; a null text counts as empty."""
    return F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1


def plan(rows: DataFrame, shards: int, capacities: list[int] | None = None, cost=None) -> tuple[DataFrame, list[tuple]]:
    """Where every row goes: (row_id, old, shard, slot), and the transfers (old, new, first, last row_id).

    ``rows``: row_id, old, size. Old shard sizes and the new capacities (equal shares of all bytes unless
    given) make a transport problem; a byte that stays costs nothing, a moved one 1 unless ``cost`` says
    otherwise. Within an old shard, rows in row_id order fill its transfers one after the other, first
    the part that stays, so each transfer is one run of rows and touches the fewest files. A row that
    spans a border goes where its middle lies: a shard misses its capacity by one row at a border.

    Running sizes are sums over blocks of rows (a window over one row per block) plus a window within
    each block, so no task holds more than a block of rows, or a row per block of one shard.
    """
    block = F.shiftright("row_id", BLOCK_BITS)
    rows = rows.select("row_id", "old", "size", block.alias("block"))
    blocks = store(rows.groupBy("old", "block").agg(F.sum("size").alias("bytes")), "blocks")
    old = {r["old"]: r["n"] for r in blocks.groupBy("old").agg(F.sum("bytes").alias("n")).collect()}
    names = sorted(old)
    supply = [old[i] for i in names]
    room = capacities or equal_shares(sum(supply), shards)
    flow = min_cost_flow(supply, room, lambda a, j: (cost or (lambda i, k: int(i != k)))(names[a], j))
    before = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("old", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("old", "block").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["old", "block"])
    middle = F.col("offset") + F.col("start") + F.shiftright("size", 1)
    new = F.lit(None).cast("int")
    for a, i in enumerate(names):
        stay_first = sorted((j for j in range(shards) if flow[a][j]), key=lambda j: (j != i, j))
        upto, cuts = 0, F.lit(stay_first[-1] if stay_first else None).cast("int")
        ends = []
        for j in stay_first[:-1]:
            upto += flow[a][j]
            ends.append((upto, j))
        for end, j in reversed(ends):
            cuts = F.when(middle < end, j).otherwise(cuts)
        new = F.when(F.col("old") == i, cuts).otherwise(new)
    placed = store(placed.select("row_id", "old", "block", new.alias("shard")), "placed")
    counts = placed.groupBy("shard", "old", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "old", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    turn = F.row_number().over(Window.partitionBy("shard", "old", "block").orderBy("row_id")) - 1
    slots = placed.withColumn("turn", turn).join(first, ["shard", "old", "block"])
    runs = placed.groupBy("old", "shard").agg(F.min("row_id").alias("a"), F.max("row_id").alias("b")).collect()
    transfers = sorted((r["old"], r["shard"], r["a"], r["b"]) for r in runs)
    return slots.select("row_id", "old", "shard", (F.col("first") + F.col("turn")).alias("slot")), transfers


def reshard(spark: SparkSession, old_path: str, new_path: str, shards: int) -> tuple[DataFrame, list[str]]:
    """Move a sharded folder to ``shards`` shards of equal bytes, rewriting only the files that lose rows.

    Returns the placement (row_id, old, shard, slot) and the paths that now hold the data: the untouched
    files of the old folder and the new one. The rewrite is one narrow pass over the affected files: a
    row's new shard follows from the row_id range of its transfer, so no text is shuffled.
    """
    rows = read_shards(spark, old_path).select(
        "row_id", F.col("shard").alias("old"), size().alias("size"), F.input_file_name().alias("file")
    )
    rows = store(rows, "rows")
    placement, transfers = plan(rows, shards)
    moved = [(i, j, a, b) for i, j, a, b in transfers if i != j]
    gone = reduce(lambda out, t: out | ((F.col("old") == t[0]) & F.col("row_id").between(t[2], t[3])), moved, F.lit(False))
    files = rows.groupBy("file").agg(F.max(gone).alias("moved"))
    paths: dict[bool, list[str]] = {True: [], False: []}
    for r in files.toLocalIterator():  # names alone, as a file listing has them
        paths[r["moved"]].append(r["file"])
    if paths[True]:
        shard = F.col("shard")
        for i, j, a, b in moved:
            shard = F.when((F.col("shard") == i) & F.col("row_id").between(a, b), j).otherwise(shard)
        affected = spark.read.schema(_SCHEMA).option("basePath", old_path).parquet(*paths[True])
        affected.withColumn("shard", shard).write.option("compression", "zstd").partitionBy("shard").parquet(new_path)
    return placement, paths[False]


def resharded(docs: DataFrame, old_shard: Column, shards: int = 8, text: str = "text") -> DataFrame:
    """Write documents by ``old_shard``, reshard the files to equal bytes and read the result back.

    Returns doc_id, size (UTF-8 bytes plus 1; null text as empty), text_crc32, law (``bytes``), shard,
    slot (from 0 without gaps), grown_shard (null). Shards differ from equal bytes by a row at each
    border of a transfer. Null ids, repeated rows and empty texts are rows like any other; a null old
    shard counts as 0; an empty table gives an empty result; other columns are not carried.
    """
    spark = docs.sparkSession
    old_path, made = new_path(spark, "old-shards"), new_path(spark, "new-shards")
    write_shards(docs, old_path, F.coalesce(old_shard, F.lit(0)), text)
    placement, untouched = reshard(spark, old_path, made, shards)
    return _result(spark, old_path, made, placement, untouched)


def _result(spark, old_path, made, placement, untouched):
    columns = ["doc_id", "row_id", "shard", size().alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32")]
    parts = []
    if untouched:
        parts.append(spark.read.schema(_SCHEMA).option("basePath", old_path).parquet(*untouched).select(*columns))
    at = spark._jvm.org.apache.hadoop.fs.Path(made)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        parts.append(spark.read.schema(_SCHEMA).parquet(made).select(*columns))
    if not parts:
        parts.append(spark.createDataFrame([], _SCHEMA).select(*columns))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.join(placement.select("row_id", "slot"), "row_id").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
