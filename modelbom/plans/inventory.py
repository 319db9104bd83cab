"""From sources to bills of materials: scan, generate, score, validate, enrich, merge.

Each function takes and gives DataFrames; nothing runs before an action on a result, except where
the caller names a ``store`` folder: there, results which several outputs read are written once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelbom.functions.rules import RULES, Rule
from modelbom.operators import assemble, enrich, extract, merge, score, security
from modelbom.operators.common import clean_ids, stored
from modelbom.operators.registry import DATASET_REGISTRY, MODEL_REGISTRY
from modelbom.sources.boms import BomTables, stamp_boms


@dataclass
class Hub:
    """Landed hub data. ``model_cards`` and ``dataset_cards`` are parsed cards with an ``id``;
    ``security`` holds listing entries; ``status`` is (id, status) of the api lookups."""

    models: DataFrame
    datasets: DataFrame | None = None
    model_cards: DataFrame | None = None
    dataset_cards: DataFrame | None = None
    security: DataFrame | None = None
    status: DataFrame | None = None


def generate(discoveries: DataFrame, hub: Hub, store: str | None = None, tool: tuple[str, str] = ("modelbom", "v0.0.0")) -> BomTables:
    """One BOM per reachable reference: model, data components, dependencies, vulnerabilities.

    Each BOM gets a serial number (a name-based UUID of its id, so a plan that runs twice gives the same
    one), the time and the tool. ``store`` names a folder for the components, which several tables read.
    """
    found = discoveries
    if hub.status is not None:
        found = assemble.drop_unreachable(found, hub.status)
    entries = hub.security
    summary = None
    if entries is not None:
        per_repo = security.security_summary(entries.where("kind = 'model'"), ("repo_id",))
        summary = per_repo.withColumnRenamed("repo_id", "id")
    rows = assemble.attach_metadata(found, hub.models, hub.model_cards, summary)
    # Models are stored with their dataset ids, so hub data is joined and read once.
    ids = {"dataset_ids": assemble.model_dataset_ids()}
    models = stored(assemble.assemble_models(rows, carry=ids), store, "models")
    components = models.drop("dataset_ids")
    if hub.datasets is not None:
        refs = assemble.model_dataset_refs(models, F.col("dataset_ids"))
        attached = assemble.attach_datasets(refs, hub.datasets, hub.dataset_cards)
        components = components.unionByName(stored(assemble.assemble_datasets(attached), store, "datasets"))
    factors = None
    if entries is not None:
        targets = components.where("is_metadata").select(
            "bom_id", "ord", "is_metadata", "bom_ref", F.lit("model").alias("kind"),
            F.col("bom_id").alias("hub_id"),
        )
        findings = security.file_findings(entries)
        factors = security.factor_vulnerabilities(None, security.finding_links(targets, findings), findings)
    none = F.lit(None).cast("string")
    boms = components.where("is_metadata").select(
        "bom_id", F.lit("1.6").alias("spec_version"), F.lit("CycloneDX").alias("bom_format"),
        none.alias("serial_number"), F.lit(1).cast("bigint").alias("version"), none.alias("timestamp"),
    )
    boms, tools = stamp_boms(boms, *tool)
    return BomTables(
        boms=boms,
        components=components,
        dependencies=assemble.dependency_edges(components),
        tools=tools,
        vulnerabilities=None if factors is None else factors.rows,
        factors=factors,
    )


def scan_and_generate(files: DataFrame, hub: Hub, rules: list[Rule] = RULES, store: str | None = None) -> BomTables:
    """Source files -> BOMs. With a ``store`` folder the corpus is read once.

    The evidence of all references comes as rows (bom_id, at, evidence) in ``extras["evidence"]``: a hot
    reference has any number of them. ``extract.joined_evidence`` makes one text per reference of them.
    """
    evidence = stored(extract.evidence_rows(extract.scan_hits(files, rules)), store, "evidence")
    tables = generate(extract.references(evidence), hub, store)
    seen = evidence.select(F.col("id").alias("bom_id"), "at", "evidence")
    known = tables.boms.select("bom_id")
    return replace(tables, extras={**tables.extras, "evidence": seen.join(known, "bom_id", "left_semi")})


def discoveries_from_ids(ids: DataFrame) -> DataFrame:
    """Model ids -> discoveries. A BOM is keyed by its model id, so an id counts once."""
    none = F.lit(None).cast("string")
    return clean_ids(ids.select("id")).distinct().select(
        "id",
        F.col("id").alias("name"),
        F.lit("huggingface").alias("type"),
        F.lit("").alias("path"),
        F.concat(F.lit("from model-id: "), "id").alias("evidence"),
        none.alias("method"),
    )


def generate_from_ids(ids: DataFrame, hub: Hub, store: str | None = None) -> BomTables:
    return generate(discoveries_from_ids(ids), hub, store)


def completeness(tables: BomTables) -> tuple[DataFrame, DataFrame]:
    """(model scores, dataset scores) of read BOMs."""
    return (
        score.completeness(tables.components, boms=tables.boms),
        score.dataset_completeness(tables.components),
    )


def validate(tables: BomTables, **options) -> DataFrame:
    return score.validate(tables.boms, tables.components, **options)


def enrich_boms(
    tables: BomTables,
    values: Column,
    hub: Hub | None = None,
    required_only: bool = False,
    min_weight: float = 0.0,
) -> tuple[BomTables, DataFrame]:
    """Fill missing fields of models and data components; (tables, progress per BOM).

    With ``hub`` the metadata of each model is applied again first.
    """
    models = tables.components.where("is_metadata")
    others = tables.components.where("not is_metadata")
    refreshed = models if hub is None else assemble.refresh_models(models, hub.models, hub.model_cards)
    options = dict(required_only=required_only, min_weight=min_weight)
    filled = enrich.enrich(refreshed, values, MODEL_REGISTRY, **options)
    data = enrich.enrich(others.where("type = 'data'"), values, DATASET_REGISTRY, **options)
    rest = others.where("coalesce(type, '') != 'data'")
    progress = score.enrichment_progress(
        score.completeness(models),
        score.completeness(filled),
        None if hub is None else score.completeness(refreshed),
    )
    components = (
        filled.drop("errors").unionByName(data.drop("errors")).unionByName(rest)
    )
    return replace(tables, components=components), progress


def vuln_scan(tables: BomTables, entries: DataFrame) -> tuple[BomTables, DataFrame]:
    """Look up every component, derive vulnerabilities, put them in: (tables, report).

    The vulnerabilities stay factorised (``tables.factors``: links, findings and the rows of other kinds); a
    component's findings are written out only with its document.
    """
    targets = security.scan_targets(tables.components)
    findings = security.file_findings(entries)
    existing = tables.vulnerabilities if tables.factors is None else tables.factors.expanded()
    factors = security.factor_vulnerabilities(existing, security.finding_links(targets, findings), findings)
    return replace(tables, vulnerabilities=factors.rows, factors=factors), security.vuln_report(targets, entries)


def merge_boms(
    tables: BomTables, members: DataFrame, deduplicate: bool = True, two_bom_form: bool = False
) -> tuple[BomTables, DataFrame]:
    """Merge member BOMs (target_id, seq, bom_id) into one BOM per target: (tables, statistics).

    ``two_bom_form``: only component rows of the second BOM are added (not its metadata
    component), old-style tools alone are carried over, repeated base dependencies give way to
    the last one and repeated base services stay.
    """
    placed = merge.place(tables.components, members)
    if two_bom_form:
        placed = placed.where("not (seq > 0 and is_metadata)")
    merged = merge.merge_components(placed, deduplicate)
    stats = merge.merge_stats(placed, merged)
    base = placed.where("seq = 0 and is_metadata").withColumn("rank", F.lit(0))
    # The other BOMs' metadata components are plain components of the merged BOM.
    components = merge.ordered(merged.unionByName(base)).withColumn("is_metadata", F.col("is_metadata") & (F.col("seq") == 0))

    def placed_or_none(rows_, make):
        return None if rows_ is None else make(merge.place(rows_, members))

    def as_bom(df):
        return None if df is None else df.withColumn("bom_id", F.col("target_id").cast("string"))

    def list_of(rows_):
        return None if rows_ is None else merge.concat_lists(rows_, members)

    tools = placed_or_none(
        tables.tools, merge.concat_legacy_tools if two_bom_form else merge.merge_tools
    )
    if tools is not None:
        tools = merge.ordered(tools, ["seq", "legacy", "ord"])
    services = placed_or_none(
        tables.services, lambda p: merge.merge_services(p, keep_base_repeats=two_bom_form)
    )
    deps = placed_or_none(
        tables.dependencies, lambda p: merge.merge_dependencies(p, base_last_wins=two_bom_form)
    )
    if deps is not None:
        deps = deps.select(
            "target_id", "ref", F.lit(0).cast("bigint").alias("ord"), F.col("at").alias("pos"), "depends_on"
        )
    out = BomTables(
        boms=as_bom(merge.merge_metadata(tables.boms, members)),
        components=as_bom(components),
        dependencies=as_bom(deps),
        tools=as_bom(tools),
        services=as_bom(None if services is None else merge.ordered(services, ["seq", "ord"])),
        compositions=as_bom(list_of(tables.compositions)),
        external_refs=as_bom(list_of(tables.external_refs)),
    )
    return out, stats
