"""Security: A5-A8, J4, J7, S5, L6."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import view, with_views
from catalog.function_queries import DATASET_ID_SQL, MODEL_ID_SQL, actionable_sql, severity_sql
from catalog.registry import query
from modelbom.operators import security
from modelbom.plans import inventory
from modelbom.sources.boms import BomTables

_OVERALL = "CASE WHEN {u} > 0 THEN 'unsafe' WHEN {c} > 0 THEN 'caution' ELSE 'safe' END"


@query(
    "A5_security_summary",
    with_views("security_flat")
    + f""" SELECT *, {_OVERALL.format(u='unsafe', c='caution')} AS overall FROM (SELECT kind, repo_id, count(*) AS files, count(status) AS scanned,
      CAST(count_if(lower(status) = 'unsafe') AS BIGINT) AS unsafe, CAST(count_if(lower(status) = 'caution') AS BIGINT) AS caution,
      CAST(count_if(lower(status) = 'suspicious') AS BIGINT) AS suspicious, CAST(count_if({actionable_sql('status')}) AS BIGINT) AS findings
    FROM security_flat GROUP BY kind, repo_id)""",
)
def a5(spark, sf_dir):
    return security.security_summary(fx.security_entries(spark, sf_dir))


_TARGETS = f"""tg AS (SELECT bom_id, ord, is_metadata, coalesce(bom_ref, '') AS bom_ref,
    CASE WHEN is_metadata OR type = 'machine-learning-model' THEN 'model' WHEN type = 'data' THEN 'dataset' END AS kind,
    CASE WHEN is_metadata OR type = 'machine-learning-model' THEN {MODEL_ID_SQL} ELSE {DATASET_ID_SQL} END AS hub_id FROM comp),
targets AS (SELECT * FROM tg WHERE kind IS NOT NULL AND coalesce(hub_id, '') <> '')"""
# The models of the BOMs are given hub ids so that both kinds of target occur.
_COMP = """comp AS (SELECT c.* EXCLUDE (purl), CASE WHEN c.is_metadata AND h.id IS NOT NULL THEN concat('pkg:huggingface/', h.id, '@x') ELSE c.purl END AS purl
  FROM comp_flat c LEFT JOIN hub_models h ON h.pk = c.k AND c.is_metadata)"""
_VIEWS = ("comp_flat", "hub_models", "security_flat")


def components(spark, sf_dir):
    hub = view(spark, sf_dir, "hub_models").select(F.col("id").alias("hub"), "pk")
    c = fx.components(spark, sf_dir)
    both = c.join(hub, (F.col("pk") == F.col("k")) & F.col("is_metadata"), "left")
    named = F.concat(F.lit("pkg:huggingface/"), "hub", F.lit("@x"))
    return both.withColumn("purl", F.coalesce(named, "purl")).drop("hub", "pk", "k")


@query("J4_scan_targets", with_views(*_VIEWS) + f", {_COMP}, {_TARGETS} SELECT * FROM targets")
def j4(spark, sf_dir):
    return security.scan_targets(components(spark, sf_dir))


_FINDINGS = f"""gate AS (SELECT DISTINCT kind, repo_id FROM listed WHERE lower(status) IN ('unsafe', 'caution')),
found AS (SELECT s.kind, s.repo_id, path, status,
    [CASE WHEN {actionable_sql('av_status')} THEN 'Cisco Foundation AI (ClamAV)=' || {severity_sql('av_status')} END,
     CASE WHEN {actionable_sql('pickle_status')} THEN 'HuggingFace Pickle Scanner=' || {severity_sql('pickle_status')} END,
     CASE WHEN {actionable_sql('vt_status')} THEN 'VirusTotal=' || {severity_sql('vt_status')} END] AS ratings,
    CASE WHEN {actionable_sql('av_status')} AND av_link <> '' THEN coalesce(nullif(av_label, ''), 'Cisco Foundation AI (ClamAV) report') || '=' || av_link END AS advisories,
    concat('Security finding in file "', replace(path, '"', chr(92) || '"'), '" (overall status: ', status, ')',
      coalesce('. ' || nullif(concat_ws('; ', CASE WHEN {actionable_sql('av_status')} AND av_message <> '' THEN '[Cisco Foundation AI (ClamAV)] ' || av_message END,
        CASE WHEN {actionable_sql('vt_status')} THEN '[VirusTotal] ' || vt_status END,
        CASE WHEN {actionable_sql('pickle_status')} AND imports_csv IS NOT NULL THEN 'Pickle imports: os.system (dangerous), re.match (safe)' END), ''), '')) AS description
  FROM listed s JOIN gate g ON g.kind = s.kind AND g.repo_id = s.repo_id WHERE {actionable_sql('status')}),
vulns AS (SELECT t.bom_id, concat('hfsec-', t.bom_ref, '-', replace(replace(path, '/', '-'), ' ', '_')) AS bom_ref, t.bom_ref AS affects,
    concat('https://huggingface.co/', hub_id, '/blob/main/', path) AS source_url, description,
    nullif(array_to_string(list_filter(ratings, lambda r: r IS NOT NULL), '|'), '') AS ratings, advisories,
    CASE WHEN t.is_metadata THEN 0 ELSE 1 END AS target_rank, t.ord AS target_ord, path
  FROM targets t JOIN found f ON f.kind = t.kind AND f.repo_id = t.hub_id)"""
_LISTED = "listed AS (SELECT * FROM security_flat)"
_VULN_COLUMNS = "bom_id, bom_ref, affects, source_url, description, ratings, advisories"


def flat_findings(df):
    def pairs(arr, a, b):
        return F.array_join(F.transform(arr, lambda x: F.concat(x[a], F.lit("="), x[b])), "|")

    return df.withColumn("ratings", pairs("ratings", "source", "severity")).withColumn(
        "advisories", pairs("advisories", "title", "url")
    )


def flat_vulns(df):
    return flat_findings(df).select(*_VULN_COLUMNS.split(", "))


@query(
    "A6_file_vulnerabilities",
    with_views(*_VIEWS) + f", {_COMP}, {_TARGETS}, {_LISTED}, {_FINDINGS} SELECT {_VULN_COLUMNS} FROM vulns",
)
def a6(spark, sf_dir):
    targets = security.scan_targets(components(spark, sf_dir))
    return flat_vulns(security.file_vulnerabilities(targets, fx.security_entries(spark, sf_dir)))


@query(
    "A6_file_findings",
    with_views("security_flat") + f", {_LISTED}, {_FINDINGS.split('vulns AS')[0].rstrip().rstrip(',')} SELECT kind, repo_id AS hub_id, path, description, "
    "nullif(array_to_string(list_filter(ratings, lambda r: r IS NOT NULL), '|'), '') AS ratings, advisories FROM found",
)
def a6_findings(spark, sf_dir):
    found = security.file_findings(fx.security_entries(spark, sf_dir)).withColumnRenamed("kind", "k").withColumnRenamed("hub_id", "h")
    return flat_findings(found).selectExpr("k AS kind", "h AS hub_id", "path", "description", "ratings", "advisories")


@query(
    "A6_finding_links",
    with_views(*_VIEWS) + f", {_COMP}, {_TARGETS}, {_LISTED}, {_FINDINGS} SELECT bom_id, affects AS bom_ref, target_ord AS ord, count(*) AS findings FROM vulns GROUP BY ALL",
)
def a6_links(spark, sf_dir):
    found = security.file_findings(fx.security_entries(spark, sf_dir))
    links = security.finding_links(security.scan_targets(components(spark, sf_dir)), found)
    return links.groupBy("bom_id", "bom_ref", "ord").agg(F.sum("findings").alias("findings"))


_SEV = """CASE WHEN contains(ratings, '=critical') THEN 'critical' WHEN contains(ratings, '=high') THEN 'high'
  WHEN contains(ratings, '=medium') THEN 'medium' ELSE 'unknown' END"""


@query(
    "A7_highest_severity",
    with_views(*_VIEWS) + f", {_COMP}, {_TARGETS}, {_LISTED}, {_FINDINGS} SELECT bom_id, bom_ref, source_url, {_SEV} AS severity FROM vulns",
)
def a7(spark, sf_dir):
    targets = security.scan_targets(components(spark, sf_dir))
    v = security.file_vulnerabilities(targets, fx.security_entries(spark, sf_dir))
    return v.select("bom_id", "bom_ref", "source_url", security.highest_severity("ratings").alias("severity"))


_REPORT = f"""rep AS (SELECT kind, repo_id, count(*) AS files, CAST(count_if(status = 'unsafe') AS BIGINT) AS unsafe, CAST(count_if(status = 'caution') AS BIGINT) AS caution,
    count(status) AS scanned, coalesce(bool_or(lower(status) IN ('unsafe', 'caution')), false) AS gate, CAST(count_if({actionable_sql('status')}) AS BIGINT) AS findings
  FROM listed GROUP BY kind, repo_id)
SELECT t.*, files IS NOT NULL AS found, files, unsafe, caution, scanned - unsafe - caution AS safe,
  CASE WHEN files IS NOT NULL THEN {_OVERALL.format(u='unsafe', c='caution')} END AS overall, CASE WHEN gate THEN findings ELSE CAST(0 AS BIGINT) END AS vulnerabilities
FROM targets t LEFT JOIN rep r ON r.kind = t.kind AND r.repo_id = t.hub_id"""


@query("A8_vuln_report", with_views(*_VIEWS) + f", {_COMP}, {_TARGETS}, {_LISTED}, {_REPORT}")
def a8(spark, sf_dir):
    targets = security.scan_targets(components(spark, sf_dir))
    return security.vuln_report(targets, fx.security_entries(spark, sf_dir))


# Existing vulnerabilities: some that the scan finds again, some it does not.
_EXISTING = """existing AS (SELECT concat('bom-', CAST(c_custkey AS VARCHAR)) AS bom_id, 'old-1' AS bom_ref, 'kept' AS description FROM customer
  UNION ALL SELECT bom_id, bom_ref, 'stale' FROM (SELECT DISTINCT bom_id, bom_ref FROM vulns) WHERE bom_id IN ('bom-1', 'bom-4', 'bom-10'))"""
_UPSERT = f"""{_EXISTING}, last AS (SELECT bom_id, bom_ref, description FROM (SELECT *, row_number() OVER (PARTITION BY bom_id, bom_ref
    ORDER BY target_rank DESC, target_ord DESC, path DESC) AS rn FROM vulns) WHERE rn = 1)
SELECT e.* FROM existing e WHERE NOT EXISTS (SELECT 1 FROM vulns v WHERE v.bom_id = e.bom_id AND v.bom_ref = e.bom_ref)
UNION ALL SELECT * FROM last"""


def existing_vulns(spark, sf_dir, incoming):
    fx.register_tables(spark, sf_dir, "customer")
    kept = spark.sql(
        "SELECT concat('bom-', CAST(c_custkey AS STRING)) AS bom_id, 'old-1' AS bom_ref, 'kept' AS description FROM customer"
    )
    stale = incoming.where("bom_id IN ('bom-1', 'bom-4', 'bom-10')").select("bom_id", "bom_ref").distinct()
    return kept.unionByName(stale.withColumn("description", F.lit("stale")))


@query(
    "J7_upsert_vulnerabilities",
    with_views(*_VIEWS) + f", {_COMP}, {_TARGETS}, {_LISTED}, {_FINDINGS}, {_UPSERT}",
)
def j7(spark, sf_dir):
    targets = security.scan_targets(components(spark, sf_dir))
    incoming = security.file_vulnerabilities(targets, fx.security_entries(spark, sf_dir))
    merged = security.upsert_vulnerabilities(existing_vulns(spark, sf_dir, incoming), incoming)
    return merged.select("bom_id", "bom_ref", "description")


@query(
    "L6_vuln_scan",
    with_views(*_VIEWS)
    + f""", {_COMP}, {_TARGETS}, {_LISTED}, {_FINDINGS}, last AS (SELECT bom_id, bom_ref, description, {_SEV} AS severity FROM (SELECT *,
      row_number() OVER (PARTITION BY bom_id, bom_ref ORDER BY target_rank DESC, target_ord DESC, path DESC) AS rn FROM vulns) WHERE rn = 1)
    SELECT * FROM last""",
)
def l6(spark, sf_dir):
    c = components(spark, sf_dir)
    tables = BomTables(boms=view(spark, sf_dir, "bom_rows"), components=c)
    done, _ = inventory.vuln_scan(tables, fx.security_entries(spark, sf_dir))
    return done.all_vulnerabilities().select(
        "bom_id", "bom_ref", "description", security.highest_severity("ratings").alias("severity")
    )


@query(
    "J7_upsert_factors",
    with_views(*_VIEWS) + f", {_COMP}, {_TARGETS}, {_LISTED}, {_FINDINGS}, {_UPSERT}",
)
def j7_factors(spark, sf_dir):
    """The upsert on links and findings; expanded only to be compared."""
    targets = security.scan_targets(components(spark, sf_dir))
    entries = fx.security_entries(spark, sf_dir)
    findings = security.file_findings(entries)
    existing = existing_vulns(spark, sf_dir, security.file_vulnerabilities(targets, entries))
    made = security.factor_vulnerabilities(existing, security.finding_links(targets, findings), findings)
    return made.expanded().select("bom_id", "bom_ref", "description")


@query(
    "L6_vulnerability_counts",
    with_views(*_VIEWS)
    + f", {_COMP}, {_TARGETS}, {_LISTED}, {_FINDINGS} SELECT bom_id, CAST(count(DISTINCT bom_ref) AS BIGINT) AS vulnerabilities FROM vulns GROUP BY bom_id",
)
def l6_counts(spark, sf_dir):
    """Vulnerabilities per BOM without expanding them."""
    tables = BomTables(boms=view(spark, sf_dir, "bom_rows"), components=components(spark, sf_dir))
    done, _ = inventory.vuln_scan(tables, fx.security_entries(spark, sf_dir))
    return done.factors.counts()
