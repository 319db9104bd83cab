"""Small tables with nulls, empty and repeated rows, ties and columns of clashing names."""

import random

import pytest
from pyspark.sql import functions as F

LINE = "The same line stands here for all to see."
PASSAGE = " ".join(f"pass{k % 17} age{k}" for k in range(60))


def make_texts():
    rnd = random.Random(11)
    word = lambda: rnd.choice(["of", "the", "and", "la", "der", "river", "stone", "Wind", "açaí", "Über", "x1", "b**", "tree!"])
    line = lambda: " ".join(word() + str(rnd.randrange(30)) * rnd.randrange(2) for _ in range(rnd.randrange(1, 18)))
    texts = ["\n".join(line() for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    texts += [None, "", " \n\t \n", "one", "a b c d e a b c d e", "\n\n\n", LINE, f"{LINE}\n{LINE}\n{LINE}\n{LINE}"]
    block = "\n".join(line() for _ in range(4))
    texts += [f"{line()}\n{block}\n{line()}" for _ in range(5)] + [f"{block}\n\n{block}\n{line()}"]
    texts += [f"{line()} {PASSAGE} {line()}" for _ in range(6)] + ["na " * 3000, "na " * 2990 + "end"]
    texts += [texts[3]] * 4 + [texts[5] + " more", texts[5] + " more words", "q" * 950]
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(k if k % 13 else None, t, "en", f"s{k % 3}") for k, t in enumerate(make_texts())]
    rows += [rows[7], rows[7], (None, None, None, None), (5, "another text of the same id", None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ["_text", "_words", "lines", "doc", "digest", "bits", "lead", "around", "found", "words", "part", "key", "row_id", "shard", "label"]
    return docs.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(f"clash {c}") for c in clash})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id < -1")
