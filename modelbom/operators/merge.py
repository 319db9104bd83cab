"""Merging bills of materials as keyed unions.

``members(target_id, seq, bom_id)`` says which BOMs go into which merged BOM and in what
order; ``seq`` 0 is the base. So one job merges any number of targets. First-wins is a
per-key minimum with a map-side cut; unions keep rows, and no list is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelbom.functions.text import identity_ref, nz, tool_key
from modelbom.operators.common import dealt, first_wins

ORDER = ["seq", "rank", "ord"]


def place(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Add target and sequence to rows of member BOMs."""
    return members.select("target_id", "seq", "bom_id").join(rows, "bom_id")


def append_new(rows: DataFrame, key: Column, is_base: Column, order: list[str]) -> DataFrame:
    """All base rows, then of the others the first per (target, key) unless a base row has
    that key; rows with an empty key all stay.

    The base takes part in the contest by its key alone, so its rows are not moved twice.
    """
    payload = rows.columns
    keyed = rows.withColumn("_key", key).withColumn("_base", is_base)
    contest = keyed.select(
        "target_id", "_key", "_base", *order, F.when(~F.col("_base"), F.struct(*payload)).alias("_row")
    )
    winners = first_wins(
        contest, ["target_id", "_key"], [F.desc("_base"), *order], blank_key="_key"
    )
    fresh = winners.where("not _base").select("_row.*")
    return keyed.where("_base").select(*payload).unionByName(fresh)


def component_rows(placed: DataFrame) -> DataFrame:
    """Rows that make up the merged component list: all but the base's metadata component."""
    return placed.where("not (seq = 0 and is_metadata)").withColumn(
        "rank", (~F.col("is_metadata")).cast("int")
    )


def merge_components(placed: DataFrame, deduplicate: bool = True) -> DataFrame:
    """Base components, then new components of the other BOMs in order."""
    rows = component_rows(placed)
    if not deduplicate:
        return rows
    key = identity_ref("bom_ref", "type", "name", "version")
    return append_new(rows, key, F.col("seq") == 0, ORDER)


def new_components(placed: DataFrame) -> DataFrame:
    """The components a merge adds to its base."""
    return merge_components(placed).where("seq > 0")


def merge_stats(placed: DataFrame, merged: DataFrame) -> DataFrame:
    """Counts per target: base components, added ones, duplicates left out, and the name of
    the base's metadata component.

    The name is a grouping column first: counts alone are combined by hash, while a maximum of texts among them would
    sort all rows of a task in its memory.
    """
    named = F.when((F.col("seq") == 0) & F.col("is_metadata"), F.col("name")).alias("metadata_component")
    counted = placed.groupBy("target_id", named).agg(
        F.count_if((F.col("seq") == 0) & ~F.col("is_metadata")).alias("sbom_components"),
        F.count_if(F.col("seq") > 0).alias("candidates"),
    )
    before = counted.groupBy("target_id").agg(
        F.sum("sbom_components").alias("sbom_components"), F.sum("candidates").alias("candidates"),
        F.max("metadata_component").alias("metadata_component"),
    )
    added = merged.groupBy("target_id").agg(F.count_if(F.col("seq") > 0).alias("aibom_components"))
    added_n = F.coalesce("aibom_components", F.lit(0).cast("bigint"))
    return before.join(added, "target_id", "left").select(
        "target_id", "sbom_components", added_n.alias("aibom_components"),
        (F.col("candidates") - added_n).alias("duplicates_removed"), "metadata_component",
    )


def merged_names(merged: DataFrame) -> DataFrame:
    """Rows (target_id, role, seq, rank, ord, name): base, model and dataset component names."""
    role = (
        F.when(F.col("seq") == 0, "sbom")
        .when(F.col("is_metadata") & (F.col("type") == "machine-learning-model"), "model")
        .when(~F.col("is_metadata") & (F.col("type") == "data"), "dataset")
    )
    return merged.select("target_id", role.alias("role"), *ORDER, "name").where("role is not null")


# ---- dependencies -----------------------------------------------------------------------


def merge_dependencies(placed: DataFrame, base_last_wins: bool = False) -> DataFrame:
    """Dependency rows (target_id, seq, ord, ref, pos, depends_on) -> one list per ref, as rows
    (target_id, ref, depends_on, at) with ``at`` an order value.

    A ref that one entry lists keeps that list as it is; lists of several entries become their
    union in first-seen order; a ref without any list keeps one empty row. ``base_last_wins``: of
    several base entries of one ref only the last counts (the two-BOM form).

    The entries of a ref are an aggregate combined before the shuffle, from rows dealt by entry: a task sorts its share, not
    the rows of a large BOM. It has one row per ref, so the join with the rows hashes that side, sorts none of the rows, and
    can be split at a hot ref. The distinct after it groups by the pair of target and ref as one value:
    by the two columns the join's own partitions would do, and a hot ref would be sorted whole in one task. So it is combined
    in the split tasks, then spread by the edge.
    """
    listed = F.col("depends_on").isNotNull()
    base, entry = F.col("seq") == 0, F.struct("seq", "ord")
    other = listed & ~base if base_last_wins else listed
    spread = dealt(placed.select("target_id", "ref", "seq", "ord", "depends_on"), "target_id", "ref", "ord")
    entries = spread.groupBy("target_id", "ref").agg(
        F.max(F.when(base, F.col("ord"))).alias("_last"),
        F.max(F.when(base & listed, F.col("ord"))).alias("_last_listed"),
        F.min(F.when(other, entry)).alias("_first"), F.max(F.when(other, entry)).alias("_final"),
    )
    rows = placed.join(entries.hint("shuffle_hash"), ["target_id", "ref"])
    first, final = F.col("_first"), F.col("_final")
    if base_last_wins:
        rows = rows.where("seq > 0 or ord = _last")
        kept = F.struct(F.lit(0).cast(rows.schema["seq"].dataType).alias("seq"), F.col("_last").alias("ord"))
        kept = F.when(F.col("_last_listed") == F.col("_last"), kept)
        first, final = F.coalesce(kept, first), F.coalesce(final, kept)
    at = F.struct("seq", "ord", "pos")
    rows = rows.where(listed | first.isNull())
    # Repeats inside the only list of a ref stay, each with its own place.
    copy = F.when(first == final, at).alias("_copy")
    edges = rows.select(F.struct("target_id", "ref").alias("_ref"), "depends_on", copy, at.alias("at"))
    one = edges.groupBy("_ref", "depends_on", "_copy").agg(F.min("at").alias("at"))
    return one.select("_ref.target_id", "_ref.ref", "depends_on", "at")


def dependency_lists(edges: DataFrame) -> DataFrame:
    """Edge rows -> (target_id, ref, depends_on ARRAY): the whole list of a ref in one row, for a
    caller who wants documents. The edges are the form to work with; this one gathers a ref's."""
    entry = F.when(F.col("depends_on").isNotNull(), F.struct("at", "depends_on"))
    lists = edges.groupBy("target_id", "ref").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    return lists.select("target_id", "ref", F.transform("items", lambda e: e["depends_on"]).alias("depends_on"))


# ---- tools, services, lists -------------------------------------------------------------


def legacy_tool_to_component(tools: DataFrame) -> DataFrame:
    """Old-style tools (vendor, name, version) -> application components."""
    return tools.select(
        *[c for c in tools.columns if c not in ("vendor", "type", "manufacturer")],
        F.lit("application").alias("type"),
        nz("vendor").alias("manufacturer"),
    )


def merge_tools(placed: DataFrame) -> DataFrame:
    """Tool rows (target_id, seq, ord, legacy, type, vendor, manufacturer, name, version).

    The base's component tools stay whole, then its old-style tools and the component tools of
    the other BOMs follow, first per name@version.
    """
    plain = placed.where("not legacy").drop("vendor")
    converted = legacy_tool_to_component(placed.where("legacy and seq = 0"))
    rows = plain.unionByName(converted).withColumn("rank", F.col("legacy").cast("int"))
    is_base = (F.col("seq") == 0) & ~F.col("legacy")
    return append_new(rows, tool_key("name", "version"), is_base, ORDER)


def merge_services(placed: DataFrame, keep_base_repeats: bool = False) -> DataFrame:
    """Services, first per reference; those without one all stay. The two-BOM form also keeps
    repeats inside the base."""
    rows = placed.withColumn("rank", F.lit(0))
    key = F.coalesce("bom_ref", F.lit(""))
    if keep_base_repeats:
        return append_new(rows, key, F.col("seq") == 0, ORDER)
    keyed = rows.withColumn("_key", key)
    return first_wins(keyed, ["target_id", "_key"], ORDER, blank_key="_key").drop("_key")


def concat_lists(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Compositions and external references of the merged BOMs: all rows, in (seq, ord) order."""
    return ordered(place(rows, members), ["seq", "ord"])


def merge_metadata(boms: DataFrame, members: DataFrame) -> DataFrame:
    """BOM-level columns of the merged BOMs: the base's, its timestamp else another's."""
    rows = place(boms, members)
    base = rows.where("seq = 0").drop("seq")
    other = rows.where("seq > 0").groupBy("target_id").agg(
        F.min(F.when(nz("timestamp").isNotNull(), F.struct("seq", "timestamp")))["timestamp"].alias("other_timestamp")
    )
    joined = base.join(other, "target_id", "left")
    return joined.select(
        "target_id", "bom_id",
        F.coalesce(nz("spec_version"), F.lit("1.6")).alias("spec_version"),
        F.coalesce(nz("bom_format"), F.lit("CycloneDX")).alias("bom_format"),
        "serial_number", "version",
        F.coalesce(nz("timestamp"), "other_timestamp").alias("timestamp"),
        *(["raw"] if "raw" in boms.columns else []),  # the base's authors, supplier, licences and the like
    )


def concat_legacy_tools(placed: DataFrame) -> DataFrame:
    """The two-BOM form of tools: old-style tools of both BOMs, others are not carried over."""
    return placed.where("legacy")


def ordered(rows: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """``ord`` as the order value of the merged document. It stays a struct: consecutive
    numbers would need all rows of a target in one task."""
    return rows.withColumn("ord", F.struct(*order))
