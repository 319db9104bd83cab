"""Join discoveries with hub metadata and assemble component rows.

All joins are equi joins on a hub id. The hub side holds one row per id, so a hot id is skew
on the left side only, which adaptive execution splits; a small hub side is broadcast by its
measured size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelbom import schemas as sc
from modelbom.functions import semistructured as ss
from modelbom.functions.text import bom_ref, first_text, property_entry, purl, trim_nz
from modelbom.operators.common import first_wins, spread_join, stage
from modelbom.operators.registry import (
    DATASET_REGISTRY, MODEL_REGISTRY, OPTIONAL_TEXT, FieldSpec, Get,
)

PROPS_TYPE = f"array<{sc.PROPERTY}>"
UNREACHABLE = (401, 403, 404)


def conform(df: DataFrame, fields: dict[str, str]) -> list[Column]:
    """The named columns in their types; absent ones as NULL."""
    return [
        (F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields.items()
    ]


def _side(df: DataFrame, fields: dict[str, str], name: str, key: str = "id") -> DataFrame:
    """key and one struct column, to be joined: one row per key.

    Landed tables may hold an id several times. The row with the least ``landed`` (a column of the
    caller's, if there) counts, then the one whose text comes first.
    """
    at = F.col("landed") if "landed" in df.columns else F.lit(0)
    side = F.struct(*conform(df, fields)).alias(name)
    rows = df.select(trim_nz(key).alias("_key"), side, at.alias("_landed")).where("_key is not null")
    rows = rows.withColumn("_text", F.to_json(F.struct(name)))
    return first_wins(rows, ["_key"], ["_landed", "_text"]).select("_key", name)


def _join(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    return left.join(right.withColumnRenamed("_key", on), on, how)


def drop_unreachable(discoveries: DataFrame, fetch_status: DataFrame) -> DataFrame:
    """Drop references whose hub lookup said not found or not authorised."""
    gone = fetch_status.where(F.col("status").isin(*UNREACHABLE)).select("id").distinct()
    return discoveries.join(gone, "id", "left_anti")


def attach_metadata(
    discoveries: DataFrame,
    hub_models: DataFrame,
    model_cards: DataFrame | None = None,
    security: DataFrame | None = None,
) -> DataFrame:
    """Discoveries -> (bom_id, model_id, scan, api, card, sec); missing sources are NULL.

    ``security`` is one summary row per repository, so the join adds no rows.
    """
    scan = F.struct(*conform(discoveries, sc.SCAN_FIELDS))
    rows = discoveries.select(first_text("id", "name").alias("model_id"), scan.alias("scan"))
    rows = _join(rows, _side(hub_models, sc.MODEL_API_FIELDS, "api"), "model_id", "left")
    null_card = F.lit(None).cast(_struct_type(sc.MODEL_CARD_FIELDS))
    null_sec = F.lit(None).cast(_struct_type(sc.SECURITY_FIELDS))
    if model_cards is not None:
        rows = _join(rows, _side(model_cards, sc.MODEL_CARD_FIELDS, "card"), "model_id", "left")
    else:
        rows = rows.withColumn("card", null_card)
    if security is not None:
        rows = _join(rows, _side(security, sc.SECURITY_FIELDS, "sec"), "model_id", "left")
    else:
        rows = rows.withColumn("sec", null_sec)
    return _with_index(rows).select(
        F.col("model_id").alias("bom_id"), "model_id", "scan", "api", "card", "sec"
    )


def _struct_type(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{n}:{t}" for n, t in fields.items()) + ">"


def _with_index(rows: DataFrame) -> DataFrame:
    """Add the model-index fields (held by the card data) to the card struct."""
    index = ss.parse_model_index(ss.at(F.col("api.card_data"), "$['model-index']"))
    staged = rows.withColumn("_index", index)
    card = (
        F.col("card")
        .withField("task_type", F.col("_index.task_type"))
        .withField("task_name", F.col("_index.task_name"))
        .withField("index_metrics", F.col("_index.metrics"))
    )
    return staged.withColumn("card", card).drop("_index")


def model_dataset_ids() -> Column:
    """Dataset ids of an attached row: card data first, then card text, distinct."""
    return ss.dataset_ids(F.col("api.card_data"), F.col("card.datasets"))


def model_dataset_refs(rows: DataFrame, ids: Column | None = None) -> DataFrame:
    """Attached rows (or rows with an array of ``ids``) -> (bom_id, ord, dataset_id)."""
    ids = model_dataset_ids() if ids is None else ids
    return rows.select("bom_id", F.posexplode(ids).alias("pos", "dataset_id")).select(
        "bom_id", F.col("pos").cast("bigint").alias("ord"), "dataset_id"
    )


def attach_datasets(
    refs: DataFrame, hub_datasets: DataFrame, dataset_cards: DataFrame | None = None
) -> DataFrame:
    """(bom_id, ord, dataset_id) -> with scan, api, card; unknown datasets are dropped.

    Both hub sides hold one row per dataset and are joined, and the configurations parsed, before the
    references come in; the references of a hot dataset are dealt over tasks.
    """
    known = _side(hub_datasets, sc.DATASET_API_FIELDS, "api")
    if dataset_cards is not None:
        known = known.join(_side(dataset_cards, sc.DATASET_CARD_FIELDS, "card"), "_key", "left")
    else:
        known = known.withColumn("card", F.lit(None).cast(_struct_type(sc.DATASET_CARD_FIELDS)))
    configs = ss.parse_dataset_configs(ss.at(F.col("api.card_data"), "$.configs"))
    known = known.select(F.col("_key").alias("dataset_id"), "api", F.col("card").withField("configs", configs).alias("card"))
    rows = spread_join(refs, known, ["dataset_id"], ["bom_id", "ord"])
    return rows.select("bom_id", "ord", "dataset_id", F.struct(F.col("dataset_id").alias("name")).alias("scan"), "api", "card")


# ---- component rows ---------------------------------------------------------------------


def row_get(path: str) -> Column:
    """``row_get('api.sha')`` on an attached row."""
    return F.col(path)


def component_get(path: str) -> Column:
    """``component_get('data.description')`` on a component row; data means its first entry."""
    root, *rest = path.split(".")
    c = F.get(F.col(root), F.lit(0)) if root == "data" else F.col(root)
    return reduce(lambda a, n: a[n], rest, c)


def _settled(spec: FieldSpec, value: Column, existing: Get | None) -> Column:
    if existing is None:
        return value
    old = existing(spec.target)
    both = F.coalesce(value, old)
    return F.when(spec.is_present(existing), old).otherwise(both) if spec.keep else both


def _any(cols: list[Column]) -> Column:
    return F.coalesce(*[F.when(c.isNotNull(), F.lit(True)) for c in cols]).isNotNull()


def _nest(leaves: dict[str, Column], prefix: str, type_: str, keep: Column | None = None) -> Column:
    """Struct of the given type out of leaf columns; an inner struct without leaves is NULL."""
    inner = type_[len("struct<"):-1]
    names, depth, start, parts = [], 0, 0, []
    for i, ch in enumerate(inner):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(inner[start:i])
            start = i + 1
    parts.append(inner[start:])
    for part in parts:
        name, sub = part.split(":", 1)
        path = f"{prefix}.{name}"
        if path in leaves:
            names.append(leaves[path].cast(sub).alias(name))
        elif sub.startswith("struct<") and any(p.startswith(path + ".") for p in leaves):
            names.append(_nest(leaves, path, sub).alias(name))
        else:
            names.append(F.lit(None).cast(sub).alias(name))
    filled = _any([c for p, c in leaves.items() if p.startswith(prefix + ".")])
    return F.when(filled if keep is None else filled | keep, F.struct(*names))


def _component_columns(
    values: dict[str, Column], props: Column, tags_extra: Column | None, existing: Get | None,
    is_model: bool,
) -> dict[str, Column]:
    """Final column per component field."""

    def old(name):
        return None if existing is None else F.col(name)

    out: dict[str, Column] = {}
    for name, type_ in sc.COMPONENT_FIELDS.items():
        if name in values:
            out[name] = values[name].cast(type_)
        elif name == "properties":
            before = [] if existing is None else [F.coalesce(old(name), F.array().cast(type_))]
            every = F.concat(*before, props)
            out[name] = F.when(F.size(every) > 0, every)
        elif name == "model_card" and is_model:
            leaves = {p: c for p, c in values.items() if p.startswith("model_card.")}
            keep = F.lit(True) if existing is None else old(name).isNotNull()
            out[name] = _nest(leaves, "model_card", type_, keep)
        elif name == "data" and not is_model:
            leaves = {p: c for p, c in values.items() if p.startswith("data.")}
            inner = type_[len("array<"):-1]
            was = F.lit("dataset") if existing is None else F.coalesce(component_get("data.type"), F.lit("dataset"))
            filled = _any(list(leaves.values()))
            first = _nest({**leaves, "data.type": F.when(filled, was)}, "data", inner)
            made = F.when(first.isNotNull(), F.array(first))
            if existing is not None:
                rest = F.slice(old(name), F.lit(2), F.greatest(F.size(old(name)) - 1, F.lit(0)))
                made = F.coalesce(F.concat(made, F.coalesce(rest, F.array().cast(type_))), old(name))
            out[name] = made.cast(type_)
        elif existing is not None:
            out[name] = old(name)
        else:
            out[name] = F.lit(None).cast(type_)
    if tags_extra is not None:
        base = F.coalesce(out["tags"], F.array().cast("array<string>"))
        out["tags"] = F.when(tags_extra.isNotNull(), F.concat(base, tags_extra)).otherwise(out["tags"])
    return out


def _from_sources(
    rows: DataFrame,
    registry: list[FieldSpec],
    existing: Get | None,
    is_model: bool,
    evidence: Column | None,
) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with staged source values, and the final column per component field."""
    specs = [s for s in registry if s.source is not None]
    rows, value = stage(rows, "source", {s.key: s.source(row_get) for s in specs})
    if existing is not None:
        targeted = [s for s in specs if s.target and s.target != "tags+"]
        rows, settled = stage(
            rows, "settled", {s.key: _settled(s, value[s.key], existing) for s in targeted}
        )
        value = {**value, **settled}
    values: dict[str, Column] = {}
    props: list[Column] = [] if evidence is None else [evidence]
    tags_extra = None
    for spec in specs:
        if spec.prop:
            props.append(property_entry(F.lit(spec.prop), value[spec.key]))
        elif spec.target == "tags+":
            tags_extra = value[spec.key]
        else:
            values[spec.target] = value[spec.key]
    joined = F.concat(*props) if props else F.array().cast(PROPS_TYPE)
    return rows, _component_columns(values, joined, tags_extra, existing, is_model)


def evidence_properties(scan: str = "scan", prefix: str = "modelbom.") -> Column:
    """Properties ``type``, ``evidence`` and ``path`` under the caller's prefix."""
    return F.concat(
        *[property_entry(F.lit(prefix + n), F.col(f"{scan}.{n}")) for n in ("type", "evidence", "path")]
    )


def _finish(rows: DataFrame, columns: dict[str, Column], keys: list[Column]) -> DataFrame:
    """Skeleton, then package URL and reference from the finished name and hash."""
    staged = rows.select(*keys, *[c.alias(n) for n, c in columns.items()])
    made = purl("type", "name", F.get("hashes", F.lit(0))["content"], "purl")
    named = staged.withColumn("purl", made)
    return named.withColumn("bom_ref", bom_ref("bom_ref", "purl"))


def assemble_models(
    rows: DataFrame,
    registry: list[FieldSpec] = MODEL_REGISTRY,
    evidence: bool = True,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Attached rows -> one metadata component per BOM: projections only, no shuffle.

    ``carry`` adds columns computed from the attached row.
    """
    seen = evidence_properties() if evidence else None
    rows, cols = _from_sources(rows, registry, None, True, seen)
    cols["type"] = F.lit("machine-learning-model")
    skeleton = first_text("model_id", "scan.name")
    cols["name"] = F.coalesce(cols["name"], skeleton, F.lit("model"))
    keys = [
        F.col("bom_id"), F.lit(0).cast("bigint").alias("ord"), F.lit(True).alias("is_metadata"),
        F.lit(None).cast("string").alias("parent_ref"),
        *[c.alias(n) for n, c in (carry or {}).items()],
    ]
    return _finish(rows, cols, keys)


def assemble_datasets(rows: DataFrame, registry: list[FieldSpec] = DATASET_REGISTRY) -> DataFrame:
    """Attached dataset rows -> data components."""
    rows, cols = _from_sources(rows, registry, None, False, None)
    cols["type"] = F.lit("data")
    cols["name"] = F.coalesce(cols["name"], trim_nz("dataset_id"), F.lit("dataset"))
    keys = [
        F.col("bom_id"), F.col("ord"), F.lit(False).alias("is_metadata"),
        F.lit(None).cast("string").alias("parent_ref"),
    ]
    return _finish(rows, cols, keys)


def refresh_models(
    components: DataFrame,
    hub_models: DataFrame,
    model_cards: DataFrame | None = None,
    registry: list[FieldSpec] = MODEL_REGISTRY,
) -> DataFrame:
    """Re-apply hub metadata to existing metadata components, looked up by their name.

    Properties are appended again, also when already there. Rows without any hub data stay.
    """
    keyed = components.withColumn("model_id", trim_nz("name"))
    rows = _join(keyed, _side(hub_models, sc.MODEL_API_FIELDS, "api"), "model_id", "left")
    if model_cards is not None:
        rows = _join(rows, _side(model_cards, sc.MODEL_CARD_FIELDS, "card"), "model_id", "left")
    else:
        rows = rows.withColumn("card", F.lit(None).cast(_struct_type(sc.MODEL_CARD_FIELDS)))
    rows = _with_index(rows).select(
        *components.columns, "model_id", "api", "card",
        F.lit(None).cast(_struct_type(sc.SCAN_FIELDS)).alias("scan"),
        F.lit(None).cast(_struct_type(sc.SECURITY_FIELDS)).alias("sec"),
    )
    rows, cols = _from_sources(rows, registry, component_get, True, None)
    found = F.col("api").isNotNull() | F.col("card").isNotNull()
    touched = {n: F.when(found, c).otherwise(F.col(n)) for n, c in cols.items()}
    keys = [F.col(k) for k in components.columns if k not in sc.COMPONENT_FIELDS]
    return rows.select(*keys, *[c.alias(n) for n, c in touched.items()])


def apply_user_values(
    components: DataFrame,
    values: Column,
    registry: list[FieldSpec] = MODEL_REGISTRY,
    only: Column | None = None,
) -> DataFrame:
    """Parse and overwrite with user-supplied texts; adds ``errors`` (keys not usable).

    ``values`` maps lower-cased field keys to text, as a literal or a column per row;
    ``only`` limits the fields to a list of keys. One projection, no shuffle.
    """
    is_model = registry is not DATASET_REGISTRY and not any(
        (s.target or "").startswith("data.") for s in registry
    )
    rows = components.withColumn("_values", values)
    specs = [s for s in registry if s.weight > 0]

    def supplied(spec: FieldSpec) -> Column:
        raw = F.try_element_at("_values", F.lit(spec.key.lower()))
        return raw if only is None else F.when(F.array_contains(only, spec.key), raw)

    rows, raw = stage(rows, "raw", {s.key: supplied(s) for s in specs})
    readable = [s for s in specs if s.parse]
    rows, parsed = stage(rows, "parsed", {s.key: s.parse(raw[s.key]) for s in readable})
    shaped = {s.key: s.user_target(parsed[s.key]) for s in readable if s.user_target}
    rows, shaped = stage(rows, "shaped", shaped)
    value = {**parsed, **shaped}
    targets: dict[str, Column] = {}
    props: list[Column] = [F.array().cast(PROPS_TYPE)]
    tags_extra = None
    for spec in readable:
        if spec.prop:
            props.append(property_entry(F.lit(spec.prop), value[spec.key]))
        elif spec.target == "tags+":
            tags_extra = value[spec.key]
        else:
            targets[spec.target] = F.coalesce(value[spec.key], component_get(spec.target))
    for spec in registry:
        if spec.parse is None and spec.target:
            targets[spec.target] = component_get(spec.target)
    rows, targets = stage(rows, "target", targets)
    errors = [
        F.when(raw[s.key].isNotNull() & parsed.get(s.key, F.lit(None)).isNull(), F.lit(s.key))
        for s in specs
        if s.key not in OPTIONAL_TEXT
    ]
    cols = _component_columns(targets, F.concat(*props), tags_extra, component_get, is_model)
    keys = [F.col(k) for k in components.columns if k not in sc.COMPONENT_FIELDS]
    return rows.select(
        *keys, *[c.alias(n) for n, c in cols.items()], F.array_compact(F.array(*errors)).alias("errors")
    )


# ---- dependencies -----------------------------------------------------------------------


def dependency_edges(components: DataFrame) -> DataFrame:
    """Components -> dependency rows (bom_id, ord, ref, pos, depends_on).

    The model of a BOM depends on each of its data components that has a reference; each of
    those also gets a row of its own. One row per edge (``depends_on`` NULL for none), so a
    BOM with very many datasets is never gathered into one list.
    """
    models = components.where("is_metadata and coalesce(bom_ref, '') != ''").select(
        "bom_id", F.col("bom_ref").alias("model_ref")
    )
    data = components.where("not is_metadata and type = 'data' and coalesce(bom_ref, '') != ''").select(
        "bom_id", "ord", F.col("bom_ref").alias("data_ref")
    )
    # Inner, so that Spark can split the data components of one BOM over tasks.
    pairs = data.join(models, "bom_id")
    alone = models.join(data.select("bom_id").distinct(), "bom_id", "left_anti")
    none = F.lit(None).cast("string")

    def entry(ord_, ref, pos, to):
        return F.struct(
            ord_.cast("bigint").alias("ord"), ref.alias("ref"), pos.alias("pos"), to.alias("depends_on")
        )

    edge = entry(F.lit(0), F.col("model_ref"), F.col("ord"), F.col("data_ref"))
    leaf = entry(F.col("ord") + 1, F.col("data_ref"), F.lit(None).cast("bigint"), none)
    single = entry(F.lit(0), F.col("model_ref"), F.lit(None).cast("bigint"), none)
    edges = pairs.select("bom_id", F.inline(F.array(edge, leaf)))
    return edges.unionByName(alone.select("bom_id", F.inline(F.array(single))))
