"""Card numbers with other numbers around them, and dates with the month first."""

from pyspark.sql import functions as F

from modelbom.llm.pii import ALPHABETS, pseudonymise
from modelbom.llm.queries import PII_KEY
from tests.llm.test_brute import feistel, luhn


def other(number, shape):
    body = feistel(number[:-1], "card", ALPHABETS[:1])
    digits = iter(body + str(-luhn(body + "0") % 10))
    return "".join(next(digits) if c.isdigit() else c for c in shape)


A, B = "4845 1681 1440 7329", "378282246310005"


def test_cards_among_numbers(spark):
    a, b = other(A.replace(" ", ""), A), other(B, B)
    texts = {f"card {A}{after}": f"card {a}{after}" for after in (
        " 12/27", " 1", " 12", " 123", " 1234", " 12 27 2025", "/12", ". 5", " -", " 7 8", "-12", " 99-x")}
    texts |= {f"{before}{A} end": f"{before}{a} end" for before in ("12 ", "1999 ", "1234 5678 9013 ", "no. 7-", "3 ")}
    texts |= {f"{A} {A}": f"{a} {a}", f"{B} {A}": f"{b} {a}", f"{A} {B} 12": f"{a} {b} 12", f"1 2 3 {B} 4 5": f"1 2 3 {b} 4 5"}
    texts |= {"9807 9157 6280 4491": "9807 9157 6280 4491", "1 " * 5000 + A: None, "1" * 5000 + " x": "1" * 5000 + " x"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pseudonymise(docs, PII_KEY).collect():
        before = list(texts)[r["doc_id"]]
        if texts[before] is not None:
            assert r["text"] == texts[before], before
        else:
            assert r["text"].endswith(a)
    two = pseudonymise(docs.where(F.col("text") == f"{A} {A}"), PII_KEY).first()
    assert (two["n_found"], two["n_replaced"]) == (2, 2)


def test_other_kinds_after_cards(spark):
    after = ["12/31/1999", "31.12.1999", "2024-02-29", "97.51.17.173", "123-45-6789"]
    rows = [(k, f"{A} {x}") for k, x in enumerate(after)] + [(10 + k, x) for k, x in enumerate(after)]
    got = {r["doc_id"]: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), PII_KEY).collect()}
    for k, x in enumerate(after):
        assert got[k]["text"] == other(A.replace(" ", ""), A) + " " + got[10 + k]["text"] and x not in got[k]["text"]
        assert got[k]["n_found"] == got[k]["n_replaced"] == 2


def test_month_first_dates(spark):
    days = spark.sql("SELECT explode(sequence(date'1990-01-01', date'2009-12-31')) AS d").where("day(d) > 12")
    docs = days.select(F.lit(1).alias("doc_id"), F.date_format("d", "MM/dd/yyyy").alias("text"))
    got = pseudonymise(docs, PII_KEY).select("text").collect()
    made = {r["text"] for r in got}
    assert len(made) == len(got)
    assert all(1 <= int(t[:2]) <= 12 < int(t[3:5]) <= 31 for t in made)
    rest = spark.createDataFrame([(1, "13/31/1999 31.02.1999 02/30/1999")], "doc_id long, text string")
    assert pseudonymise(rest, PII_KEY).first()["text"] == "13/31/1999 31.02.1999 02/30/1999"
