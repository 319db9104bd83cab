"""The quality rules keep clean texts of any length."""

from modelbom.llm.quality_rules import RULES, verdict

CLEAN = dict(word_chars=5, n_symbols=0, n_marks=0, n_stop_words=0.3, n_dup_lines=0, n_repeat_words=0)


def test_long_clean_text(spark):
    rows = [{k: int(v * n) for k, v in CLEAN.items()} | {"n_words": n, "n_lines": n // 10} for n in (5, 5000, 2_000_001, 50_000_000)]
    measured = spark.createDataFrame(rows)
    kept = sorted(r["n_words"] for r in measured.where(verdict(RULES)[0]).collect())
    assert kept == [5000, 2_000_001, 50_000_000]
