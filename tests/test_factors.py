"""Vulnerabilities as links and findings against the same upsert row by row."""

import random

import pytest
from pyspark.sql import functions as F

from modelbom.operators import security
from modelbom.plans import inventory
from modelbom.sources import boms as bomio

LINKS = "bom_id string, ord bigint, is_metadata boolean, bom_ref string, kind string, hub_id string"
FINDINGS = "kind string, hub_id string, path string, safe_path string, description string, ratings array<struct<source:string,severity:string,method:string>>, advisories array<struct<title:string,url:string>>"


def tables(spark, seed):
    """References and paths of few hyphened parts, so that they collide in every way."""
    rnd = random.Random(seed)
    name = lambda: "-".join(rnd.choice(["", "a", "b"]) for _ in range(rnd.randrange(1, 4)))
    links = [(rnd.choice("xyz"), k, rnd.random() < 0.2, name(), "model", rnd.choice("pq")) for k in range(40)]
    paths = [(rnd.choice("pq"), name().replace("-", rnd.choice("-/ "))) for _ in range(30)]
    findings = [("model", h, p, p.replace("/", "-").replace(" ", "_"), f"{h} {p}", None, None) for h, p in sorted(set(paths))]
    existing = [(rnd.choice("xyz"), f"hfsec-{name()}-{name()}", "old") for _ in range(40)] + [("x", "own", "old"), ("y", "hfsec-", "old"), ("w", "hfsec-a-b", "old")]
    return (
        spark.createDataFrame(links, LINKS), spark.createDataFrame(findings, FINDINGS),
        spark.createDataFrame(sorted(set(existing)), "bom_id string, bom_ref string, description string"),
    )


def seen(df):
    return sorted((r.bom_id, r.bom_ref, r.description) for r in df.collect())


@pytest.mark.parametrize("seed", range(6))
def test_equal_to_rows(spark, seed):
    links, findings, existing = tables(spark, seed)
    want = security.upsert_vulnerabilities(existing, security.expand_findings(links, findings))
    got = security.factor_vulnerabilities(existing, links, findings)
    assert seen(got.expanded()) == seen(want)
    count = {r.bom_id: r.vulnerabilities for r in got.counts().collect()}
    assert count == {r.bom_id: r["count"] for r in want.groupBy("bom_id").count().collect()}


def test_rows_are_links_and_findings(spark):
    """500 components of one repository with 400 findings are 900 rows, not 200,000."""
    links = spark.range(500).select(
        F.concat(F.lit("bom"), (F.col("id") % 50).cast("string")).alias("bom_id"), F.col("id").alias("ord"), F.lit(False).alias("is_metadata"),
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("bom_ref"), F.lit("model").alias("kind"), F.lit("hub").alias("hub_id"),
    )
    findings = spark.createDataFrame([("model", "hub", f"f{k}", f"f{k}", "d", None, None) for k in range(400)], FINDINGS)
    made = security.factor_vulnerabilities(None, links, findings)
    assert (made.links.count(), made.findings.count(), made.rows.count()) == (500, 400, 0)
    assert made.counts().agg(F.sum("vulnerabilities")).first()[0] == 200_000


def test_scanning_again_changes_nothing(spark):
    links, findings, existing = tables(spark, 3)
    once = security.factor_vulnerabilities(existing, links, findings)
    again = security.factor_vulnerabilities(once.expanded(), links, findings)
    assert seen(again.expanded()) == seen(once.expanded())


def test_documents_hold_them(spark):
    parts = spark.createDataFrame([("b", 0, True, None, "m", "machine-learning-model", "o/m", "pkg:huggingface/o/m@1")], "bom_id string, ord bigint, is_metadata boolean, parent_ref string, bom_ref string, type string, name string, purl string")
    from modelbom import schemas as sc

    for n, t in sc.COMPONENT_FIELDS.items():
        if n not in parts.columns:
            parts = parts.withColumn(n, F.lit(None).cast(t))
    boms = spark.createDataFrame([("b", "1.6", "CycloneDX", "s", 1, None)], sc.BOMS)
    entries = spark.createDataFrame(
        [("model", "o/m", 0, "a b.bin", ("unsafe", ("unsafe", "bad", "", "")))],
        "kind string, repo_id string, page int, path string, s struct<status:string,av:struct<status:string,message:string,reportLink:string,reportLabel:string>>",
    ).select("kind", "repo_id", "page", "path", F.struct(F.col("s.status"), F.col("s.av").alias("avScan"), *[F.lit(None).cast(t).alias(n) for n, t in (("protectAiScan", sc.SCANNER), ("pickleImportScan", sc.PICKLE), ("virusTotalScan", sc.SCANNER), ("jFrogScan", sc.SCANNER))]).alias("securityFileStatus"))
    done, report = inventory.vuln_scan(bomio.BomTables(boms=boms, components=parts), entries)
    assert done.vulnerabilities.count() == 0 and report.first().vulnerabilities == 1
    (doc,) = bomio.documents(done).collect()
    assert '"bom-ref":"hfsec-m-a_b.bin"' in doc.value and '"severity":"critical"' in doc.value
