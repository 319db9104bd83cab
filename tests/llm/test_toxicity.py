"""Held-out accuracy of the toxicity scores, what they depend on, and odd rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from modelbom.llm.queries import QUERIES
from modelbom.llm.toxicity import FEATURES, Reader, core, slices, toxicity

SF = "/root/testdata/sf0.01"


def auc(rows):
    ones, zeros = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.fixture(scope="module")
def scored(spark):
    return QUERIES["op13_toxicity"](spark, SF).collect()


def test_held_out(spark, scored):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)
    held = [(r, truth[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in truth]
    assert auc([(r["score"], y) for r, y in held]) > 0.9
    assert sum(r["predicted"] for r, y in held if not y) <= 0.02 * len(held)
    toxic = [r["predicted"] for r, y in held if y]
    assert sum(toxic) >= 0.6 * len(toxic)  # some 8 German, French or Spanish ones have few words to learn from here


def test_only_the_text_and_learned_labels_count(spark, scored):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = other.withColumn("quality", 1 - F.col("quality"))
    again = toxicity(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "weight": F.lit(1), "f": F.lit(2)}), other).collect()
    before = {r["doc_id"]: r["score"] for r in scored}
    assert all(abs(before[r["doc_id"]] - r["score"]) < 1e-9 for r in again)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(1, 60)] + [(None, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    labels = labels.withColumn("text", F.lit("clash"))
    got = toxicity(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity(no_docs, labels).count() == 0
    assert {r["score"] for r in toxicity(odd_docs, labels.where("toxic = 0")).collect()} == {0.01}
    assert {r["score"] for r in toxicity(odd_docs, labels.where("doc_id < 0")).collect()} == {0.5}


def test_features():
    reader = Reader({"loweic-": 4.0, "grobian": 3.0})
    get = lambda t: dict(zip(FEATURES, reader.features(t)))
    assert set(reader.features(None)) == set(reader.features("")) == {0.0}
    plain = get("the wind over the river")
    assert plain["hits"] == plain["insults"] == plain["near_you"] == plain["obfuscated"] == plain["marks"] == 0
    assert get("Loweichung im Wind")["strongest"] == 4 and get("ein GROBIAN!")["strongest"] == 3
    assert get("you are an idiot!")["near_you"] > 0 == get("an idiot is here")["near_you"]
    assert get("you a b c d e f g h idiot")["near_you"] == 0
    for t in ("st*pid", "1d10t", "stuuuupid", "s t u p i d", "m0r0n?"):
        assert get(f"so {t} now")["obfuscated_hits"] > 0, t
    assert get("so 3rd, x1 and a*b now")["obfuscated_hits"] == 0
    assert get("THE WIND")["capital_words"] > 0 == get("The Wind")["capital_words"]
    assert core("'Tree!") == "tree" and core("?!") == ""


def test_long_text():
    text = "the wind is here " * 100_000
    assert "".join(slices(text)) == text and len(list(slices(text))) == 2
    reader = Reader({})
    row = dict(zip(FEATURES, reader.features(text + "you idiot")))
    assert row["insults"] > 0 and row["near_you"] > 0 and row["length"] > 12.8
