"""Completeness scores and validation: row-wise over component rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelbom.functions.text import SPEC_VERSIONS, nz, trim
from modelbom.operators.assemble import component_get
from modelbom.operators.common import dealt, first_wins, stage
from modelbom.operators.registry import DATASET_REGISTRY, DATASETS_KEY, MODEL_REGISTRY, FieldSpec


def datasets_referenced() -> Column:
    """True when the model lists at least one non-empty dataset reference."""
    refs = component_get("model_card.modelParameters.datasets")
    return F.coalesce(F.exists(refs, lambda d: d["ref"] != ""), F.lit(False))


def with_results(
    components: DataFrame, registry: list[FieldSpec], gate: dict[str, Column] | None = None
) -> DataFrame:
    """Add score, passed, total and the missing keys in registry order to component rows.

    Every presence test runs once, in a projection of flags; the rest is arithmetic on them.
    """
    specs = [s for s in registry if s.weight > 0]
    tests = {}
    for s in specs:
        test = s.is_present(component_get)
        tests[s.key] = test & gate[s.key] if gate and s.key in gate else test
    rows, ok = stage(components, "ok", tests)
    whole = sum((s.weight for s in specs), 0.0)
    earned, passed = F.lit(0.0), F.lit(0)
    for s in specs:
        earned = earned + F.when(ok[s.key], F.lit(float(s.weight))).otherwise(F.lit(0.0))
        passed = passed + ok[s.key].cast("int")

    def missing(required: bool) -> Column:
        keys = [F.when(~ok[s.key], F.lit(s.key)) for s in specs if s.required == required]
        return F.array_compact(F.array(*keys).cast("array<string>"))

    score = earned / F.lit(whole) if whole > 0 else F.lit(0.0)
    return rows.select(
        *components.columns,
        score.alias("score"),
        passed.alias("passed"),
        F.lit(len(specs)).alias("total"),
        missing(True).alias("missing_required"),
        missing(False).alias("missing_optional"),
    )


RESULT = ["score", "passed", "total", "missing_required", "missing_optional"]


def with_model_results(
    components: DataFrame, registry: list[FieldSpec] = MODEL_REGISTRY
) -> DataFrame:
    scored = with_results(components, registry, {DATASETS_KEY: datasets_referenced()})
    return scored.withColumn("model_id", F.coalesce(nz("name"), F.lit("(unknown)")))


def completeness(
    components: DataFrame, registry: list[FieldSpec] = MODEL_REGISTRY, boms: DataFrame | None = None
) -> DataFrame:
    """Score of each BOM's metadata component. With ``boms``, BOMs without one are scored too."""
    models = components.where("is_metadata")
    if boms is not None:
        models = boms.select("bom_id").join(models, "bom_id", "left")
    return with_model_results(models, registry).select("bom_id", "model_id", *RESULT)


def dataset_scores(components: DataFrame, registry: list[FieldSpec] = DATASET_REGISTRY) -> DataFrame:
    """Score of every data component, whatever its BOM."""
    data = components.where("not is_metadata and type = 'data'")
    return with_results(data, registry).select(
        "bom_id", "ord", F.col("name").alias("dataset_ref"), *RESULT
    )


def dataset_completeness(
    components: DataFrame, registry: list[FieldSpec] = DATASET_REGISTRY
) -> DataFrame:
    """Scores of data components in BOMs whose model references datasets; of several with one
    name in a BOM the last counts.

    The per-name rule comes first: on the scan its map-side cut works, while after the join
    all of a very large BOM could sit in one partition.
    """
    users = components.where("is_metadata").where(datasets_referenced()).select("bom_id")
    data = components.where("not is_metadata and type = 'data'")
    named = data.withColumn("_name", F.coalesce("name", F.lit("")))
    last = first_wins(named, ["bom_id", "_name"], [F.desc("ord")])
    used = last.join(users, "bom_id", "left_semi")
    return with_results(used, registry).select(
        "bom_id", "ord", F.col("name").alias("dataset_ref"), *RESULT
    )


def dataset_validation(scores: DataFrame, strict: bool = False) -> DataFrame:
    """Dataset scores with their errors (strict only) and warnings."""
    errors = F.transform(
        "missing_required", lambda k: F.concat(F.lit("required dataset field missing: "), k)
    )
    warnings = F.transform(
        "missing_optional", lambda k: F.concat(F.lit("optional dataset field missing: "), k)
    )
    none = F.array().cast("array<string>")
    return scores.withColumn("errors", errors if strict else none).withColumn("warnings", warnings)


def dataset_notes(components: DataFrame, registry: list[FieldSpec] = DATASET_REGISTRY) -> DataFrame:
    """Warnings of strict validation about data components: rows (bom_id, ord, note)."""
    flagged = dataset_validation(dataset_completeness(components, registry), True)
    rows = flagged.select("bom_id", "ord", "dataset_ref", F.explode("errors").alias("error"))
    note = F.concat(F.lit("dataset "), F.coalesce("dataset_ref", F.lit("")), F.lit(": "), F.col("error"))
    return rows.select("bom_id", "ord", note.alias("note"))


def validate(
    boms: DataFrame,
    components: DataFrame,
    strict: bool = False,
    min_score: float = 0.0,
    check_model_card: bool = False,
    registry: list[FieldSpec] = MODEL_REGISTRY,
) -> DataFrame:
    """One row per BOM: valid flag, errors, warnings and its completeness. What strict validation says
    about data components, any number per BOM, are the rows of ``dataset_notes``."""
    models = components.where("is_metadata").withColumn("_found", F.lit(True))
    rows = boms.select("bom_id", "spec_version").join(models, "bom_id", "left")
    has_component = F.col("_found").isNotNull()
    spec = nz("spec_version")
    spec_at = F.array_position(F.lit(SPEC_VERSIONS), trim(spec))
    no_metadata = F.when(~has_component, F.lit("BOM missing metadata.component"))
    bad_spec = F.when(spec.isNull(), F.lit("BOM missing spec version")).when(
        spec_at == 0, F.concat(F.lit("invalid or unsupported spec version: "), spec)
    )
    old_spec = F.when(
        (spec_at > 0) & (spec_at < SPEC_VERSIONS.index("1.5") + 1),
        F.concat(
            F.lit("spec version "), trim(spec),
            F.lit(" predates ML-BOM support (consider upgrading to 1.5+)"),
        ),
    )
    card = component_get("model_card")
    card_note = F.when(
        has_component,
        F.when(card.isNull(), F.lit("model card not present")).when(
            card["modelParameters"].isNull(), F.lit("model parameters not present")
        ),
    )
    scored = with_model_results(rows, registry).select(
        "bom_id", "model_id", *RESULT,
        no_metadata.alias("no_metadata"),
        bad_spec.alias("bad_spec"),
        old_spec.alias("old_spec"),
        (card_note if check_model_card else F.lit(None).cast("string")).alias("card_note"),
    )
    none = F.array().cast("array<string>")
    strict_errors = none
    if strict:
        required = F.transform(
            "missing_required", lambda k: F.concat(F.lit("required field missing: "), k)
        )
        low = F.when(
            F.col("score") < min_score,
            F.format_string(
                "completeness score %.2f below minimum %.2f", F.col("score"), F.lit(float(min_score))
            ),
        )
        strict_errors = F.concat(required, F.array_compact(F.array(low)))
    errors = F.concat(F.array_compact(F.array("no_metadata", "bad_spec")), strict_errors)
    optional = F.transform(
        "missing_optional", lambda k: F.concat(F.lit("optional field missing: "), k)
    )
    warnings = F.concat(
        F.array_compact(F.array("old_spec")), optional, F.array_compact(F.array("card_note"))
    )
    return scored.select(
        "bom_id", "model_id", (F.size(errors) == 0).alias("valid"), errors.alias("errors"),
        warnings.alias("warnings"), F.col("score").alias("completeness_score"),
        "missing_required", "missing_optional",
    )


def missing_fields(
    results: DataFrame,
    registry: list[FieldSpec] = MODEL_REGISTRY,
    required_only: bool = False,
    min_weight: float = 0.0,
    keys: tuple[str, ...] = ("bom_id",),
) -> DataFrame:
    """Completeness rows -> (keys, ord, key, weight, required) of fields worth filling."""
    return results.select(
        *keys, F.inline(missing_specs(registry, required_only, min_weight))
    )


def missing_specs(
    registry: list[FieldSpec], required_only: bool = False, min_weight: float = 0.0
) -> Column:
    """array<struct(ord, key, weight, required)> of missing fields, in registry order."""
    wanted = [
        (o, s) for o, s in enumerate(registry) if s.weight > 0 and s.weight >= min_weight
    ]

    def entry(o: int, s: FieldSpec) -> Column:
        listed = F.array_contains("missing_required", s.key)
        if not required_only:
            listed = listed | F.array_contains("missing_optional", s.key)
        made = F.struct(
            F.lit(o).alias("ord"), F.lit(s.key).alias("key"),
            F.lit(float(s.weight)).alias("weight"), F.lit(s.required).alias("required"),
        )
        return F.when(listed, made)

    return F.array_compact(F.array(*[entry(o, s) for o, s in wanted]))


def enrichment_progress(
    before: DataFrame, after: DataFrame, refetched: DataFrame | None = None, keys=("bom_id",)
) -> DataFrame:
    """Score, passed and total at the start, after a refetch and at the end.

    Without a refetch the start stands on two sides of the joins: it is dealt by its keys, so that both read one exchange
    and the scores are computed once. A one-row generator keeps the join's filter on the keys above that exchange.
    """
    middle = refetched
    if refetched is None:
        before = dealt(before.select(*keys, "score", "passed", "total"), *keys)
        middle = before.select(F.inline(F.array(F.struct(*before.columns))))

    def side(df, name):
        return df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("score", "passed", "total")])

    out = side(before, "initial")
    out = out.join(side(middle, "refetched"), list(keys), "left")
    return out.join(side(after, "final"), list(keys), "left")
