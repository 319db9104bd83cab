"""Security roll-up: per-file scanner verdicts to summaries, vulnerabilities and reports.

Entries are rows (kind, repo_id, page, path, securityFileStatus). Everything per repository
is a hash aggregate with map-side combine; no step gathers the files of one repository.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelbom.functions.text import HUB_URL, col, dataset_id_from_component, model_id_from_component, nz
from modelbom.operators.common import first_wins, spread_join

# Scanner key -> display name, in report order.
SCANNERS = {
    "avScan": "Cisco Foundation AI (ClamAV)",
    "protectAiScan": "ProtectAI",
    "pickleImportScan": "HuggingFace Pickle Scanner",
    "virusTotalScan": "VirusTotal",
    "jFrogScan": "JFrog Research",
}
# Severities by rank.
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1, "none": 0}

STATUS = "securityFileStatus.status"


def status_severity(status) -> Column:
    s = F.lower(col(status))
    return (
        F.when(s == "unsafe", "critical")
        .when(s == "suspicious", "high")
        .when(s == "caution", "medium")
        .otherwise("unknown")
    )


def actionable(status) -> Column:
    return F.coalesce(~F.lower(col(status)).isin("", "safe", "unscanned"), F.lit(False))


def scanner_label(key) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in SCANNERS.items() for x in pair])
    return F.try_element_at(labels, col(key))


def _is(status: Column, value: str) -> Column:
    return F.coalesce(status == value, F.lit(False))


def security_summary(entries: DataFrame, keys: tuple[str, ...] = ("kind", "repo_id")) -> DataFrame:
    """Per repository: overall status and file counts. A repository without entries has no row;
    one with only suspicious files counts as safe (``suspicious`` tells)."""
    status = F.lower(F.col(STATUS))
    counts = entries.groupBy(*keys).agg(
        F.count("*").alias("files"),
        F.count("securityFileStatus").alias("scanned"),
        F.count_if(_is(status, "unsafe")).alias("unsafe"),
        F.count_if(_is(status, "caution")).alias("caution"),
        F.count_if(_is(status, "suspicious")).alias("suspicious"),
        F.count_if(actionable(F.col(STATUS))).alias("findings"),
    )
    overall = F.when(F.col("unsafe") > 0, "unsafe").when(F.col("caution") > 0, "caution").otherwise("safe")
    return counts.withColumn("overall", overall)


def scan_targets(components: DataFrame) -> DataFrame:
    """Components to look up: (bom_id, ord, is_metadata, bom_ref, kind, hub_id)."""
    as_model = F.col("is_metadata") | (F.col("type") == "machine-learning-model")
    kind = F.when(as_model, "model").when(F.col("type") == "data", "dataset")
    hub_id = F.when(as_model, model_id_from_component("purl", "name")).otherwise(
        dataset_id_from_component("purl", "name")
    )
    return components.select(
        "bom_id", "ord", "is_metadata", F.coalesce("bom_ref", F.lit("")).alias("bom_ref"),
        kind.alias("kind"), hub_id.alias("hub_id"),
    ).where("kind is not null and coalesce(hub_id, '') != ''")


def _scanner_findings() -> Column:
    """Actionable results of the five scanners, in report order."""

    def one(key: str) -> Column:
        s = F.col("securityFileStatus")[key]
        pickle = key == "pickleImportScan"
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(SCANNERS[key]).alias("label"),
            s["status"].alias("status"),
            nz(s["message"]).alias("message"),
            (none if pickle else nz(s["reportLink"])).alias("link"),
            (none if pickle else nz(s["reportLabel"])).alias("title"),
        )

    return F.filter(F.array(*[one(k) for k in SCANNERS]), lambda f: actionable(f["status"]))


def _quoted(text: Column) -> Column:
    out = text
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _finding_columns() -> list[Column]:
    """Vulnerability columns that depend on the file entry alone."""
    found = F.col("found")
    ratings = F.transform(
        found,
        lambda f: F.struct(
            f["label"].alias("source"), status_severity(f["status"]).alias("severity"),
            F.lit("other").alias("method"),
        ),
    )
    advisories = F.transform(
        F.filter(found, lambda f: f["link"].isNotNull()),
        lambda f: F.struct(
            F.coalesce(f["title"], F.concat(f["label"], F.lit(" report"))).alias("title"),
            f["link"].alias("url"),
        ),
    )
    notes = F.transform(
        F.filter(found, lambda f: f["message"].isNotNull()),
        lambda f: F.concat(F.lit("["), f["label"], F.lit("] "), f["message"]),
    )
    pickle = F.col("securityFileStatus.pickleImportScan")
    listed = F.transform(
        pickle["pickleImports"],
        lambda p: F.concat(
            F.coalesce(p["module"], F.lit("")), F.lit("."), F.coalesce(p["name"], F.lit("")),
            F.lit(" ("), F.coalesce(p["safety"], F.lit("")), F.lit(")"),
        ),
    )
    imports = F.when(
        actionable(pickle["status"]) & (F.size(listed) > 0),
        F.concat(F.lit("Pickle imports: "), F.array_join(listed, ", ")),
    )
    parts = F.concat(notes, F.array_compact(F.array(imports)))
    description = F.concat(
        F.lit("Security finding in file "), _quoted(F.col("path")), F.lit(" (overall status: "),
        F.col(STATUS), F.lit(")"),
        F.when(F.size(parts) > 0, F.concat(F.lit(". "), F.array_join(parts, "; "))).otherwise(""),
    )
    return [
        F.replace(F.replace(F.col("path"), F.lit("/"), F.lit("-")), F.lit(" "), F.lit("_")).alias("safe_path"),
        description.alias("description"),
        F.when(F.size(ratings) > 0, ratings).alias("ratings"),
        F.when(F.size(advisories) > 0, advisories).alias("advisories"),
    ]


def file_findings(entries: DataFrame) -> DataFrame:
    """One row per file with findings, of repositories with an unsafe or caution file:
    (kind, hub_id, path, safe_path, description, ratings, advisories).

    The gate is a per-repository aggregate joined back as a semi join; texts are built once per file. The files of
    a hot repository are dealt over tasks.
    """
    gate = (
        entries.where(F.lower(F.col(STATUS)).isin("unsafe", "caution")).select("kind", "repo_id").distinct()
    )
    return (
        spread_join(entries.where(actionable(F.col(STATUS))), gate, ["kind", "repo_id"], ["path"], "left_semi")
        .select("*", _scanner_findings().alias("found"))
        .select("kind", "repo_id", "path", *_finding_columns())
        .withColumnRenamed("repo_id", "hub_id")
    )


def finding_links(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """The components whose repository has findings, one row each: which component refers to which
    repository. With ``file_findings`` it says the same as ``file_vulnerabilities`` without repeating
    the texts of a repository for each of its components."""
    found = findings.groupBy("kind", "hub_id").agg(F.count("*").alias("findings"))
    return targets.join(found, ["kind", "hub_id"])


def expand_findings(links: DataFrame, findings: DataFrame) -> DataFrame:
    """Links and findings -> one row per component and finding, as documents hold them.

    The findings of a hot repository are dealt over tasks, and stream past its links.
    """
    joined = spread_join(findings, links, ["kind", "hub_id"], ["path"])
    return joined.select(
        "bom_id",
        F.concat(F.lit("hfsec-"), "bom_ref", F.lit("-"), "safe_path").alias("bom_ref"),
        F.col("bom_ref").alias("affects"),
        F.lit("HuggingFace Security Scanner").alias("source_name"),
        F.concat(F.lit(HUB_URL), "hub_id", F.lit("/blob/main/"), "path").alias("source_url"),
        "description",
        "ratings",
        "advisories",
        (~F.col("is_metadata")).cast("bigint").alias("target_rank"),
        F.col("ord").alias("target_ord"),
        "path",
    )


def file_vulnerabilities(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per component and finding: the rows are as many as documents need."""
    return expand_findings(targets, file_findings(entries))


def highest_severity(ratings) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])
    ranked = F.filter(
        F.transform(
            col(ratings),
            lambda r: F.struct(
                F.try_element_at(ranks, r["severity"]).alias("rank"), r["severity"].alias("sev")
            ),
        ),
        lambda r: r["rank"].isNotNull(),
    )
    return F.coalesce(F.array_max(ranked)["sev"], F.lit("unknown"))


def vuln_report(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """Per component: file counts by verdict (case-sensitive), overall label, number of
    vulnerabilities; ``found`` is false when the repository has no listing."""
    status = F.col(STATUS)
    lower = F.lower(status)
    per_repo = entries.groupBy("kind", F.col("repo_id").alias("hub_id")).agg(
        F.count("*").alias("files"),
        F.count_if(_is(status, "unsafe")).alias("unsafe"),
        F.count_if(_is(status, "caution")).alias("caution"),
        F.count("securityFileStatus").alias("scanned"),
        F.coalesce(F.bool_or(lower.isin("unsafe", "caution")), F.lit(False)).alias("gate"),
        F.count_if(actionable(status)).alias("findings"),
    )
    overall = F.when(F.col("unsafe") > 0, "unsafe").when(F.col("caution") > 0, "caution").otherwise("safe")
    rows = targets.join(per_repo, ["kind", "hub_id"], "left")
    return rows.select(
        "bom_id", "ord", "is_metadata", "bom_ref", "kind", "hub_id",
        F.col("files").isNotNull().alias("found"),
        "files", "unsafe", "caution",
        (F.col("scanned") - F.col("unsafe") - F.col("caution")).alias("safe"),
        F.when(F.col("files").isNotNull(), overall).alias("overall"),
        F.when(F.col("gate"), F.col("findings")).otherwise(F.lit(0).cast("bigint")).alias("vulnerabilities"),
    )


def upsert_vulnerabilities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing rows of the same (bom_id, bom_ref) give way to the incoming ones; of several
    incoming ones the last counts."""
    keys = ["bom_id", "bom_ref"]
    last = first_wins(incoming, keys, [F.desc("target_rank"), F.desc("target_ord"), F.desc("path")])
    kept = existing.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last, allowMissingColumns=True)


@dataclass
class Factors:
    """Vulnerabilities of many BOMs without the product of components and findings.

    ``links`` say which component refers to which repository, ``findings`` what its files hold: together they
    stand for one vulnerability per pair. ``rows`` are those that are not of that form: vulnerabilities of other
    sources, and those of the few components whose references collide with another's.
    """

    links: DataFrame
    findings: DataFrame
    rows: DataFrame

    def expanded(self) -> DataFrame:
        """One row per vulnerability, as documents hold them."""
        return self.rows.unionByName(expand_findings(self.links, self.findings), allowMissingColumns=True)

    def counts(self) -> DataFrame:
        """Vulnerabilities per BOM, from the factors alone."""
        per_repo = self.findings.groupBy("kind", "hub_id").agg(F.count("*").alias("n"))
        linked = self.links.drop("findings").join(per_repo, ["kind", "hub_id"]).select("bom_id", "n")
        both = linked.unionByName(self.rows.select("bom_id", F.lit(1).cast("bigint").alias("n")))
        return both.groupBy("bom_id").agg(F.sum("n").alias("vulnerabilities"))


def _cuts(text: Column) -> Column:
    """All ways to part a text at a hyphen: (head, tail)."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, 1) == "-")
    return F.transform(at, lambda i: F.struct(F.substring(text, 1, i - 1).alias("head"), F.substring(text, i + 1, F.length(text)).alias("tail")))


def factor_vulnerabilities(existing: DataFrame | None, links: DataFrame, findings: DataFrame) -> Factors:
    """The upsert of ``upsert_vulnerabilities`` on links and findings, equal to it when expanded.

    A reference is made of a component's and a file's. So repeats are settled within each factor: of a
    repository's files with one reference the last by path counts, of a BOM's links of one component to one
    repository the last. What is left can collide only between components with one reference, or where one
    component's reference begins another's up to a hyphen; those links alone are expanded and settled row by
    row. An existing row gives way if some parting of its reference names a link and a finding.
    """
    findings = first_wins(findings, ["kind", "hub_id", "safe_path"], [F.desc("path")])
    own = ["bom_id", "bom_ref"]
    links = first_wins(links, [*own, "kind", "hub_id"], ["is_metadata", F.desc("ord")])
    several = links.groupBy(*own).agg(F.count("*").alias("n")).where("n > 1").select(*own)
    begun = links.where(F.contains("bom_ref", F.lit("-"))).select(*own, F.inline(_cuts(F.col("bom_ref"))))
    refs = links.select("bom_id", F.col("bom_ref").alias("head")).distinct()
    pairs = begun.join(refs, ["bom_id", "head"]).select("bom_id", F.explode(F.array("bom_ref", "head")).alias("bom_ref"))
    contested = several.unionByName(pairs).distinct()
    plain = links.join(contested, own, "left_anti")
    rows = expand_findings(links.join(contested, own, "left_semi"), findings)
    rows = first_wins(rows, own, [F.desc("target_rank"), F.desc("target_ord"), F.desc("path")])
    if existing is not None:
        prefix = F.lit("hfsec-")
        cut = existing.where(F.startswith("bom_ref", prefix)).select(*own, F.inline(_cuts(F.substring(F.col("bom_ref"), F.lit(7), F.length("bom_ref")))))
        named = cut.join(plain.select("bom_id", F.col("bom_ref").alias("head"), "kind", "hub_id"), ["bom_id", "head"])
        again = named.join(findings.select("kind", "hub_id", F.col("safe_path").alias("tail")), ["kind", "hub_id", "tail"]).select(*own)
        kept = existing.join(again.unionByName(rows.select(*own)).distinct(), own, "left_anti")
        rows = kept.unionByName(rows, allowMissingColumns=True)
    return Factors(links=plain, findings=findings, rows=rows)


def fetch_outcomes(log: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Status log (keys, seq, stage, status) -> one outcome per model.

    Stages are api, readme, tree and complete. An unauthorised answer counts as not found
    unless the api stage succeeded before it, so the first success is found first and joined
    back. The answers of one model are then judged in several slices, which are combined.
    """
    keys = list(keys)
    ok_seq = (
        log.where("stage = 'api' and status = 200").groupBy(*keys).agg(F.min("seq").alias("ok_seq"))
    )
    rows = log.join(ok_seq, keys, "left")
    failed = (F.col("status") >= 400) & (F.col("stage") != "complete")
    unauthorised = failed & F.col("status").isin(401, 403)
    before_ok = F.col("ok_seq").isNull() | (F.col("seq") < F.col("ok_seq"))
    missing = failed & ((F.col("status") == 404) | (unauthorised & before_ok))
    error = failed & ~missing
    slice_ = F.pmod(F.xxhash64("seq"), F.lit(64)).alias("slice")
    judged = rows.select(
        *keys,
        slice_,
        F.col("ok_seq").isNotNull().alias("api_ok"),
        missing.alias("not_found"),
        F.when(error, F.struct("seq", unauthorised.alias("unauthorised"))).alias("error"),
        (F.col("stage") == "complete").alias("complete"),
    ).repartition(*keys, "slice")

    def combine(df, *by):
        return df.groupBy(*by).agg(
            F.max("api_ok").alias("api_ok"), F.max("not_found").alias("not_found"),
            F.min("error").alias("error"), F.max("complete").alias("complete"),
        )

    agg = combine(combine(judged, *keys, "slice"), *keys)
    first = F.col("error.unauthorised")
    outcome = (
        F.when(F.col("not_found") & ~F.col("api_ok"), "not found")
        .when(~F.col("complete"), "incomplete")
        .when(first, "unauthorised")
        .when(first.isNotNull(), "failed")
        .when(F.col("api_ok") & F.col("not_found"), "no readme")
        .otherwise("ok")
    )
    return agg.select(*keys, outcome.alias("outcome"))


def dataset_outcome(status) -> Column:
    s = col(status)
    return F.when(s == 200, "ok").when(s.isin(401, 403, 404), "not found").otherwise("failed")
