"""Operators with a SQL counterpart, over the smallest tables and over odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from modelbom.llm.line_dedup import line_dedup
from modelbom.llm.quality_rules import RULES, Rule, quality_rules
from modelbom.llm.queries import LINES_SQL, ORACLES, QUERIES, RULES_SQL, WARC_SQL
from modelbom.llm.warc import export_warc, parse_records, read_archive, write_archive
from scripts.check_oracles import rows_of


def same(df, con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(columns, cur.fetchall())
    assert got == want
    return got


def table(df, name, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(name) / name)
    df.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"pipeline"}))
def test_tables(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    assert same(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def test_rules_on_odd_rows(odd_docs, no_docs, tmp_path_factory):
    same(quality_rules(odd_docs), table(odd_docs, "documents", tmp_path_factory), RULES_SQL)
    assert quality_rules(no_docs).count() == 0


def test_rules_filter_stays_above(odd_docs):
    """A filter on the verdict must not be pushed into the array expressions."""
    plan = quality_rules(odd_docs).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")


def test_own_rules(odd_docs):
    rows = quality_rules(odd_docs, rules=(*RULES, Rule("few_lines", "n_lines", None, 3))).collect()
    assert all("few_lines" in r["failed_rules"] for r in rows if r["n_lines"] < 3)


def test_lines_on_odd_rows(odd_docs, no_docs, tmp_path_factory):
    got = same(line_dedup(odd_docs), table(odd_docs.select("doc_id", "text"), "documents", tmp_path_factory), LINES_SQL)
    assert len(got) == odd_docs.count()
    assert line_dedup(no_docs).count() == 0


def test_line_dedup_twice(odd_docs):
    """What is left of a run of three is gone from all places but the first."""
    once = line_dedup(odd_docs.where("doc_id is not null"))
    assert once.where("n_removed > 0").count() > 5


@pytest.fixture(scope="module")
def pages(spark):
    body = ["<p>a</p>", "<p>a</p>", None, "", "<p>ü\r\n\r\nWARC/1.1</p>", "<p>a</p>", "x" * 70_000, "x" * 70_000]
    rows = [(k, f"http://h/{k}" if k % 3 else None, b) for k, b in enumerate(body)]
    rows += [rows[0], (None, "http://n", "<p>a</p>"), (None, "http://n", "alone"), (20, "a\r\nb", "alone too")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha256", F.lit("clash"))


def test_archive(spark, pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "a")
    write_archive(pages, path)
    got = parse_records(read_archive(spark, path))
    same(got.drop("url"), table(pages, "pages", tmp_path_factory), WARC_SQL)
    stored = spark.read.parquet(path + "/payloads")
    assert stored.count() == stored.select("sha256").distinct().count() == 6
    record = read_archive(spark, path).where("page_id = 4").first()["record"]
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith("<p>ü\r\n\r\nWARC/1.1</p>\r\n\r\n".encode())
    out = str(tmp_path_factory.mktemp("warc") / "w")
    export_warc(read_archive(spark, path).where("page_id = 4").coalesce(1), out)
    assert spark.read.format("binaryFile").load(out + "/*.txt").first()["content"] == record


def test_archive_least_bytes(spark, pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "b")
    write_archive(pages, path, least_bytes=100)
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in parse_records(read_archive(spark, path)).collect()}
    assert {x for x in got if x[1] == "revisit"} == {(6, "revisit", 7)}


def test_archive_of_nothing(spark, pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "c")
    write_archive(pages.where("page_id < -1"), path)
    assert parse_records(read_archive(spark, path)).count() == 0
