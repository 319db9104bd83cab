"""Embedding whitening: covariance over distinct vectors with multiplicities as weights, whitened once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelbom.llm.common import store

#: Steps per unit and offset of the whole numbers that entries become.
STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 16


def quantized(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", steps: int = STEPS, offset: int = OFFSET) -> DataFrame:
    """(id, x): the whole numbers floor(steps * c) + offset of every vector without null or non-finite entries."""
    v = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    v = v.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    return v.select("id", F.transform("v", lambda c: (F.floor(c * steps) + offset).cast("long")).alias("x"))


def _matrix(column):
    """Rows of a batch's list column as one 2-d array."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _whole(x):
    """64-bit integers, or Python's where sums or squares could leave 64 bits."""
    import numpy as np

    return x if x.size == 0 or np.abs(x).max() < 2**31 else x.astype(object)


def _sums(batches):
    """Per task: weights and weighted sums of each dimension, as decimal strings (exact at any size)."""
    import pyarrow as pa

    total, sums = 0, None
    for batch in batches:
        if len(batch):
            x, w = _whole(_matrix(batch.column(0))), _whole(batch.column(1).to_numpy())
            own = (x * w[:, None]).sum(0) if len(batch) < 2**20 else (x.astype(object) * w[:, None]).sum(0)
            total, sums = total + int(w.sum()), [a + int(b) for a, b in zip(sums or [0] * len(own), own)]
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(sums)), pa.int32()), pa.array([str(s) for s in [total, *sums]])], names=["i", "s"]
        )


def totals(distinct: DataFrame) -> tuple[int, list[int]]:
    """Exact sum of weights and weighted sums of all (x, w): one small row per task and dimension is added in Spark."""
    parts = distinct.select("x", "w").mapInArrow(_sums, "i int, s string")
    rows = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    sums = {r["i"]: int(r["s"]) for r in rows}  # dimensions + 1
    return sums.pop(-1, 0), [sums[i] for i in sorted(sums)]


def _products(centre):
    """Per task: the upper rows of the weighted product matrix of centred vectors (GEMM)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        g = None
        for batch in batches:
            if len(batch):
                z = centre(_matrix(batch.column(0)))
                own = (z * batch.column(1).to_numpy()[:, None].astype(float)).T @ z
                g = own if g is None else g + own
        if g is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(g)), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], names=["i", "row"]
            )

    return run


def covariance(rows: DataFrame, centre, n: int):
    """Weighted covariance of (x, w) rows about the centre, divisor n: d x d numbers reach the driver."""
    import numpy as np

    parts = rows.select("x", "w").mapInArrow(_products(centre), "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = 1 + max(r["i"] for r in cells)
    v = np.zeros((d, d))
    for r in cells:
        v[r["i"], r["j"]] = r["v"]
    return (v + v.T) / (2 * n)


def _centre(n: int, sums: list[int]):
    """x less the mean, through the whole number n * x - S, so that no digit of the offset is lost."""

    def run(x):
        import numpy as np

        return _distance(x, n, sums).astype(float) / n if x.size else np.zeros(x.shape)

    return run


def _distance(x, n: int, sums: list[int]):
    """n * x - S exactly: in 64 bits where they hold it, else in Python's integers."""
    import numpy as np

    if max(int(np.abs(x).max(initial=0)) * n, *map(abs, sums)) < 2**62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _whiten(n, sums, vectors, values):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        centre, scaled = _centre(n, sums), vectors / np.sqrt(values)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            far = _distance(x, n, sums)
            small = far.dtype != object and int(np.abs(far).max()) ** 2 * far.shape[1] < 2**63
            square = (far if small else far.astype(object)) ** 2
            deviation = [int(s) if s < 2**63 else None for s in square.sum(1)]
            z = centre(x) @ scaled
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviation, pa.int64()), pa.array(list(z), pa.list_(pa.float64())), batch.column(2)],
                names=["key", "deviation", "x", "w"],
            )

    return run


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", weights: str = "one", components: int = COMPONENTS,
    steps: int = STEPS, offset: int = OFFSET,
) -> DataFrame:
    """Whiten every vector; one row per usable row of ``vectors``.

    Entries become whole numbers x (see ``quantized``). Equal x vectors are grouped first; the fit list has
    each distinct one with weight one, or its count with ``weights="count"``. The covariance is the weighted
    product of the centred vectors (exact whole-number sums, divisor n), its unit eigenvectors by falling
    eigenvalue are the components. Each distinct vector is whitened once and joined back to its rows.

    Returns id, n, deviation (sum over dimensions of (n*x-S)^2, exact; null beyond 64 bits), whitened
    (array: component k at k - 1), explained (array of eigenvalue / trace) and identity_error (largest absolute entry of the
    covariance of all whitened vectors less the identity). Rows with a null or empty vector, or null or
    non-finite entries, are left out; a null id stays; repeated rows stay and count as one vector.
    Components whose eigenvalue is zero within rounding are left out, so a table of equal vectors has rows
    without components; an empty table gives no rows. Vectors of several lengths are an error. Further columns
    of any name are ignored. Only n, d sums and d x d products reach the driver.
    """
    import numpy as np

    rows = quantized(vectors, key, vector, steps, offset)
    digest = F.md5(F.array_join("x", ",").cast("binary")).alias("key")
    weight = F.lit(1).cast("long") if weights == "one" else F.count("*")
    # The digest only names a vector in the join back; vectors are grouped by all their numbers.
    distinct = store(rows.groupBy("x").agg(weight.alias("w")).select(digest, "x", "w"), "vectors")
    lengths = [r["d"] for r in distinct.select(F.size("x").alias("d")).distinct().orderBy("d").limit(3).collect()]
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {lengths}")
    n, sums = totals(distinct)
    values, axes, explained, error = np.ones(0), np.zeros((len(sums), 0)), [], 0.0
    if n:
        v = covariance(distinct, _centre(n, sums), n)
        e, u = np.linalg.eigh(v)
        order = np.argsort(-e)[:components]
        order = order[e[order] > max(e.max(), 0) * len(e) * 1e-14]
        values, axes, explained = e[order], u[:, order], (e[order] / np.trace(v)).tolist()
    made = distinct.select("key", "x", "w").mapInArrow(
        _whiten(n, sums, axes, values), "key string, deviation long, x array<double>, w long"
    )
    made = store(made, "whitened")
    if explained:
        middle = made.select(F.posexplode("x").alias("i", "z"), "w").groupBy("i").agg((F.sum(F.col("z") * F.col("w")) / n).alias("m"))
        mean = np.array([r["m"] for r in middle.orderBy("i").collect()])  # at most ``components`` numbers
        error = float(np.abs(covariance(made, lambda z: z - mean, n) - np.eye(len(mean))).max())
    back = rows.select("id", digest).join(made.select("key", "deviation", F.col("x").alias("whitened")), "key")
    return back.select(
        "id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(float(x)) for x in explained]).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"),
    )


def whitened_components(vectors: DataFrame, **options) -> DataFrame:
    """One row per vector and component, numbered from 1: vec_id, component, n, deviation, whitened, explained, identity_error."""
    w = whiten(vectors, **options)
    at = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "one")
    return w.select(F.col("id").alias("vec_id"), "n", "deviation", "identity_error", at).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("one.whitened").alias("whitened"), F.col("one.explained").alias("explained"), "identity_error",
    )
