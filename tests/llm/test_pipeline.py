"""Each stage of the pipeline against a plain version on its own input."""

import duckdb
import pytest

import corpus_pipeline
from modelbom.llm import decontaminate as dc
from modelbom.llm.queries import LINES_SQL, RULES_SQL
from tests.llm.test_near_copies import plain_kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path), path))
    return out


def by_sql(docs, sql, tmp_path):
    con = duckdb.connect()
    docs.write.parquet(str(tmp_path / "documents"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    return con.execute(sql).fetchall()


def test_columns(steps):
    assert all(new.columns == COLUMNS for _, new, _ in steps[:-1])


def test_quality(steps, tmp_path):
    old, new, _ = steps[0]
    kept = {r[0] for r in by_sql(old, f"SELECT doc_id FROM ({RULES_SQL}) WHERE kept", tmp_path)}
    assert {r["doc_id"] for r in new.collect()} == kept and 0 < len(kept) < old.count()


def test_lines(steps, tmp_path):
    old, new, _ = steps[1]
    want = sorted(by_sql(old, f"SELECT doc_id, text, length(text) FROM ({LINES_SQL})", tmp_path))
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in new.collect()) == want


def test_near_copies(steps):
    """Brute-force groups by the Jaccard similarity of five-word shingles on the stage's own input."""
    old, new, _ = steps[2]
    assert sorted(r["doc_id"] for r in new.collect()) == plain_kept([(r["doc_id"], r["text"]) for r in old.collect()])


def test_benchmark(spark, sf_dir, steps):
    old, new, _ = steps[3]
    items = [dc.words_of(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {
        r["doc_id"] for r in old.collect()
        if not any(dc.nearest_window(i, dc.words_of(r["text"]) or [""], int(0.15 * len(i))) for i in items)
    }
    assert {r["doc_id"] for r in new.collect()} == clean


def test_packing(steps):
    old, new, _ = steps[4]
    assert {r["doc_id"] for r in new.collect()} == {r["doc_id"] for r in old.collect()}


def test_odd_rows(spark, sf_dir, odd_docs, no_docs, tmp_path_factory):
    for docs, some in ((odd_docs, True), (no_docs, False)):
        columns = docs.columns
        docs = docs.where("length(text) < 5000 or text is null")
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path_factory.mktemp("odd") / str(n))
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            assert n == 4 or docs.columns == columns
        assert (docs.count() > 0) == some


def test_run(spark, sf_dir, steps):
    assert corpus_pipeline.run(spark, sf_dir).count() == steps[-1][1].count()
