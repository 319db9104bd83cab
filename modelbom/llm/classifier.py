"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelbom.llm.common import store
from modelbom.llm.quality_rules import measure

FEATURES = (
    "length", "word_length", "symbols", "marks", "upper", "stop_words", "distinct", "duplicate_lines",
    "repeated", "line_words", "stops", "odd_words",
)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the FEATURES of every whole text: ratios of counts, mostly on a logarithmic scale.

    Only the text is read: no label, language, source or id. An empty or null text has all ratios 0.
    """
    m = measure(docs.select("doc_id", F.col(f"`{text}`").alias("_text")), "_text", more={
        "n_distinct": lambda w: F.size(F.array_distinct(w)),
        "n_upper": lambda w: F.size(F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)))),
        "n_stops": lambda w: F.size(F.filter(w, lambda x: F.substring(x, -1, 1).isin(".", "!", "?", ":", ";", ","))),
        "n_odd": lambda w: F.size(F.filter(w, lambda x: F.length(x) == 1)),
    })
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    ratio = lambda c: F.col(c) / n
    return m.select(
        "doc_id",
        F.log1p("n_words").alias("length"),
        F.log1p(F.least(ratio("word_chars"), F.lit(50.0))).alias("word_length"),
        F.log1p(20 * ratio("n_symbols")).alias("symbols"),
        F.log1p(20 * ratio("n_marks")).alias("marks"),
        F.log1p(20 * ratio("n_upper")).alias("upper"),
        F.sqrt(ratio("n_stop_words")).alias("stop_words"),
        ((n - F.col("n_distinct")) / F.sqrt(n * F.log1p(n))).alias("distinct"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("duplicate_lines"),
        F.log1p(20 * ratio("n_repeat_words")).alias("repeated"),
        F.log1p(n / F.greatest(F.col("n_lines"), F.lit(1))).alias("line_words"),
        F.log1p(20 * ratio("n_stops")).alias("stops"),
        F.log1p(20 * ratio("n_odd")).alias("odd_words"),
    )


@dataclass
class Model:
    """Class means, inverse Cholesky factors and log normalisers, and the scale of the log odds."""

    means: list
    factors: list
    logs: list
    scale: float = 1.0
    shift: float = 0.0

    def log_odds(self, x):
        """Log density of class 1 less that of class 0, with the priors; x: rows of features."""
        import numpy as np

        logs = []
        for mean, inverse, log in zip(self.means, self.factors, self.logs):
            z = (x - mean) @ inverse.T
            logs.append(log - 0.5 * np.square(z).sum(axis=1))
        return logs[1] - logs[0]

    def score(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.scale * self.log_odds(x) + self.shift, -30, 30)))


def _moments(batches):
    """Per task and class: rows, sum and sum of products."""
    import numpy as np
    import pandas as pd

    d = len(FEATURES)
    sums = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for pdf in batches:
        x = pdf[list(FEATURES)].to_numpy(float)
        for label in (0, 1):
            own = x[(pdf["label"] == label).to_numpy()]
            sums[label] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    yield pd.DataFrame({"label": [0, 1], "sums": [s.tolist() for s in sums.values()]})


def fit(labelled: DataFrame, shrink: float = 0.1, scale_rows: int = 20_000) -> Model:
    """Fit to rows of doc_id, FEATURES and label (0 or 1).

    The class moments are sums over all rows (one small row per class reaches the driver). Each class
    covariance is shrunk to ``(1 - shrink)`` of itself, half of the rest from the pooled covariance and
    half from its diagonal; a class of too few rows leans on the pooled one in full. The log odds are
    scaled by a logistic fit on about ``scale_rows`` rows drawn by a hash of the id, twice as many at most.
    """
    import numpy as np

    d = len(FEATURES)
    totals = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    parts = labelled.select("label", *FEATURES).mapInPandas(_moments, "label int, sums array<double>")
    added = parts.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("s"))
    for r in added.collect():  # 2 (1 + d + d * d) numbers
        totals[r["label"]][r["pos"]] = r["s"]
    n = [totals[k][0] for k in (0, 1)]
    if not all(n):  # nothing to tell apart
        odds = {(True, False): 10.0, (False, True): -10.0}.get((bool(n[1]), bool(n[0])), 0.0)
        return Model([np.zeros(d)] * 2, [np.eye(d)] * 2, [0.0, 0.0], 0.0, odds)
    means = [totals[k][1 : 1 + d] / n[k] for k in (0, 1)]
    spread = [totals[k][1 + d :].reshape(d, d) - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (spread[0] + spread[1]) / max(n[0] + n[1] - 2, 1) + 1e-4 * np.eye(d)
    factors, logs = [], []
    for k in (0, 1):
        own = spread[k] / max(n[k] - 1, 1)
        keep = (1 - shrink) * n[k] / (n[k] + 5 * d)
        cov = keep * own + (1 - keep) / 2 * (pooled + np.diag(np.diag(own))) + 1e-4 * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        logs.append(np.log(n[k] / (n[0] + n[1])) - np.log(np.diag(lower)).sum())
    model = Model(means, factors, logs)
    share = min(1.0, scale_rows / sum(n))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < round(share * (1 << 20))
    some = labelled.where(drawn).select("label", *FEATURES).limit(2 * scale_rows).toPandas()
    if some["label"].nunique() == 2:
        odds, y = np.clip(model.log_odds(some[list(FEATURES)].to_numpy(float)), -200, 200), some["label"].to_numpy(float)
        a, b = 0.1, 0.0
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            g = np.array([((y - p) * odds).sum() - 1e-3 * a, (y - p).sum()])
            h = np.array([[(w * odds * odds).sum() + 1e-3, (w * odds).sum()], [(w * odds).sum(), w.sum()]])
            step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
            a, b = max(a + step[0], 1e-3), b + step[1]
        model.scale, model.shift = float(a), float(b)
    return model


def _scores(model: Model, threshold: float):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            s = model.score(pdf[list(FEATURES)].to_numpy(float))
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": s,
                "predicted": (s >= threshold).astype("int32"),
            })

    return run


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """Score every document for the probability of label 1.

    The model learns from labels of rows whose crc32(doc_id as text) modulo ``folds`` is not 0; the
    others are held out. Returns doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).
    A null text counts as empty and gets a score; a null doc_id has no label and is not held out;
    repeated rows are scored alike; labels other than 0 and 1 are ignored; without labels of both
    classes all scores are next to the one class there is, or 0.5. Further columns are ignored; an empty table
    gives an empty result.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    held = F.coalesce(remainder == 0, F.lit(False))
    rows = store(statistics(docs, text).withColumn("held_out", held), "statistics")
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    labelled = rows.where(~F.col("held_out")).join(known, "doc_id")
    model = fit(labelled)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInPandas(
        _scores(model, threshold), "doc_id long, held_out boolean, score double, predicted int"
    )
