"""Scores, validation and enrichment: A2-A4, A13, X3, X4, J5, U-F, S6, L3-L5."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import view, with_views
from catalog.function_queries import has_prop_sql
from catalog.hub_queries import flat_components
from catalog.registry import query
from catalog.sqltext import nz_sql, trim_sql
from modelbom.operators import enrich, score
from modelbom.operators.assemble import apply_user_values, refresh_models
from modelbom.operators.registry import DATASET_REGISTRY, FieldSpec
from modelbom.plans import inventory
from modelbom.sources.boms import BomTables
from modelbom.functions.text import trim_nz

_M, _D = "BOM.metadata.component.", "BOM.components[DATA]."
_CARD = "has_card AND "

# (key, weight, SQL presence test) over comp_flat, in registry order.
MODEL_TESTS = [
    (_M + "name", 1.0, f"{nz_sql('name')} IS NOT NULL"),
    (_M + "externalReferences", 0.5, "url IS NOT NULL"),
    (_M + "tags", 0.5, "tags_csv IS NOT NULL"),
    (_M + "licenses", 1.0, "license IS NOT NULL"),
    (_M + "hashes", 1.0, "sha IS NOT NULL"),
    (_M + "manufacturer", 0.5, f"{nz_sql('author')} IS NOT NULL"),
    (_M + "group", 0.25, f"{nz_sql('grp')} IS NOT NULL"),
    *[
        (_M + "properties.huggingface:" + p, 0.2, has_prop_sql("huggingface:" + p))
        for p in (
            "lastModified", "createdAt", "language", "usedStorage", "private", "libraryName", "downloads", "likes",
            "baseModel", "modelCardContact",
        )
    ],
    (_M + "modelCard.modelParameters.task", 1.0, _CARD + f"{nz_sql('task')} IS NOT NULL"),
    (_M + "modelCard.modelParameters.architectureFamily", 0.5, _CARD + f"{nz_sql('family')} IS NOT NULL"),
    (_M + "modelCard.modelParameters.modelArchitecture", 0.5, _CARD + f"{nz_sql('arch')} IS NOT NULL"),
    (
        _M + "modelCard.modelParameters.datasets", 0.5,
        _CARD + f"len(list_filter(string_split(datasets_csv, ','), lambda d: {trim_sql('d')} <> '')) > 0",
    ),
    (_M + "modelCard.considerations.useCases", 0.5, _CARD + "use_case IS NOT NULL"),
    (_M + "modelCard.considerations.technicalLimitations", 0.5, _CARD + "limitation IS NOT NULL"),
    (_M + "modelCard.considerations.ethicalConsiderations", 0.25, _CARD + "ethic IS NOT NULL"),
    (_M + "modelCard.quantitativeAnalysis.performanceMetrics", 0.5, _CARD + "metric IS NOT NULL"),
    (_M + "modelCard.considerations.environmentalConsiderations.properties", 0.25, _CARD + "hardware IS NOT NULL"),
    *[
        (_M + "properties.huggingface:security:" + p, w, has_prop_sql("huggingface:security:" + p))
        for p, w in (
            ("overallStatus", 0.3), ("scannedFileCount", 0.2), ("unsafeFileCount", 0.2), ("cautionFileCount", 0.2),
        )
    ],
]
DATASET_TESTS = [
    (_D + "name", 1.0, f"{nz_sql('name')} IS NOT NULL"),
    (_D + "externalReferences", 0.5, "url IS NOT NULL"),
    (_D + "tags", 0.5, "tags_csv IS NOT NULL"),
    (_D + "licenses", 0.8, "license IS NOT NULL"),
    (_D + "data.description", 0.7, _CARD + f"{nz_sql('description')} IS NOT NULL"),
    (_D + "manufacturer", 0.6, f"{nz_sql('author')} IS NOT NULL"),
    (_D + "authors", 0.6, "author IS NOT NULL"),
    (_D + "group", 0.4, f"{nz_sql('grp')} IS NOT NULL"),
    (_D + "data.contents.attachments", 0.5, _CARD + "attachment IS NOT NULL"),
    (_D + "data.sensitiveData", 0.6, _CARD + "sensitive IS NOT NULL"),
    (_D + "data.classification", 0.6, _CARD + f"{nz_sql('classification')} IS NOT NULL"),
    (_D + "data.governance", 0.7, _CARD + "custodian IS NOT NULL"),
    (_D + "hashes", 0.5, "sha IS NOT NULL"),
    (_D + "properties.huggingface:createdAt", 0.3, has_prop_sql("huggingface:createdAt")),
    (_D + "properties.huggingface:usedStorage", 0.3, has_prop_sql("huggingface:usedStorage")),
    (_D + "tags.lastModified", 0.3, "len(list_filter(string_split(tags_csv, ','), lambda t: starts_with(t, 'lastModified:'))) > 0"),
    (_D + "properties.huggingface:datasetContact", 0.5, has_prop_sql("huggingface:datasetContact")),
]


def score_sql(tests, required) -> str:
    """Columns score, passed, total, missing_required, missing_optional ('|' joined)."""
    ok = [(k, w, f"coalesce({t}, false)") for k, w, t in tests]
    earned = " + ".join(f"CASE WHEN {t} THEN {w} ELSE 0 END" for _, w, t in ok)
    whole = sum(w for _, w, _ in ok)

    def missing(is_required):
        keys = [f"CASE WHEN NOT {t} THEN '{k}' END" for k, _, t in ok if (k in required) == is_required]
        return f"concat_ws('|', {', '.join(keys)})" if keys else "''"

    passed = " + ".join(f"CAST({t} AS INTEGER)" for _, _, t in ok)
    return (
        f"round(CAST({earned} AS DOUBLE) / {whole!r}, 9) AS score, {passed} AS passed, {len(ok)} AS total, "
        f"{missing(True)} AS missing_required, {missing(False)} AS missing_optional"
    )


MODEL_SCORE = score_sql(MODEL_TESTS, {_M + "name"})
DATASET_SCORE = score_sql(DATASET_TESTS, {_D + "name"})
_REFERENCED = "is_metadata AND has_card AND len(list_filter(string_split(datasets_csv, ','), lambda d: d <> '')) > 0"


def flat_result(df):
    return df.withColumn("score", F.round("score", 9)).withColumn(
        "missing_required", F.array_join("missing_required", "|")
    ).withColumn("missing_optional", F.array_join("missing_optional", "|"))


_A2 = f"SELECT bom_id, coalesce(nullif(name, ''), '(unknown)') AS model_id, {MODEL_SCORE} FROM comp_flat WHERE is_metadata"


@query("A2_completeness", with_views("comp_flat") + " " + _A2)
def a2(spark, sf_dir):
    return flat_result(score.completeness(fx.components(spark, sf_dir)))


_A3 = f"""SELECT bom_id, ord, name AS dataset_ref, {DATASET_SCORE} FROM (
  SELECT *, row_number() OVER (PARTITION BY bom_id, name ORDER BY ord DESC) AS rn FROM comp_flat
  WHERE NOT is_metadata AND type = 'data' AND bom_id IN (SELECT bom_id FROM comp_flat WHERE {_REFERENCED})) WHERE rn = 1"""


@query("A3_dataset_completeness", with_views("comp_flat") + " " + _A3)
def a3(spark, sf_dir):
    return flat_result(score.dataset_completeness(fx.components(spark, sf_dir)))


# Callers' own fields: one without weight, one required, one heavy.
CUSTOM_REGISTRY = [
    FieldSpec("custom.none", 0.0, present=lambda c: F.lit(True)),
    FieldSpec("custom.version", 2.0, required=True, present=lambda c: trim_nz(c("version")).isNotNull()),
    FieldSpec("custom.purl", 3.0, present=lambda c: c("purl").startswith("pkg:huggingface/")),
]


@query(
    "UF_custom_registry",
    with_views("comp_flat")
    + " SELECT bom_id, coalesce(nullif(name, ''), '(unknown)') AS model_id, "
    + score_sql(
        [("custom.version", 2.0, "version IS NOT NULL"), ("custom.purl", 3.0, "starts_with(purl, 'pkg:huggingface/')")],
        {"custom.version"},
    )
    + " FROM comp_flat WHERE is_metadata",
)
def custom_registry(spark, sf_dir):
    return flat_result(score.completeness(fx.components(spark, sf_dir), CUSTOM_REGISTRY))


_RESULTS = f"""res AS ({_A2}), dres AS ({_A3}),
v AS (SELECT b.bom_id, b.spec_version, coalesce(r.model_id, '(unknown)') AS model_id, r.bom_id IS NOT NULL AS found,
    coalesce(r.score, 0) AS score, coalesce(r.missing_required, '{_M}name') AS missing_required,
    coalesce(r.missing_optional, '{'|'.join(k for k, _, _ in MODEL_TESTS[1:])}') AS missing_optional,
    has_card, CASE WHEN has_card THEN coalesce(task, family, arch, datasets_csv) IS NOT NULL END AS has_params
  FROM bom_rows b LEFT JOIN res r ON r.bom_id = b.bom_id LEFT JOIN comp_flat c ON c.bom_id = b.bom_id AND c.is_metadata)"""


def prefixed_sql(prefix: str, keys: str) -> str:
    return f"list_transform(list_filter(string_split({keys}, '|'), lambda k: k <> ''), lambda k: '{prefix}' || k)"


def validate_sql(strict: bool, minimum: float, card: bool) -> str:
    structural = """CASE WHEN NOT found THEN ['BOM missing metadata.component'] ELSE [] END, CASE WHEN nullif(spec_version, '') IS NULL THEN ['BOM missing spec version']
      WHEN spec_version NOT IN ('1.0','1.1','1.2','1.3','1.4','1.5','1.6') THEN ['invalid or unsupported spec version: ' || spec_version] ELSE [] END"""
    hard = (
        f", {prefixed_sql('required field missing: ', 'missing_required')}, CASE WHEN score < {minimum} THEN "
        f"[printf('completeness score %.2f below minimum %.2f', score, {minimum})] ELSE [] END" if strict else ""
    )
    notes = """CASE WHEN spec_version IN ('1.0','1.1','1.2','1.3','1.4') THEN ['spec version ' || spec_version || ' predates ML-BOM support (consider upgrading to 1.5+)'] ELSE [] END"""
    notes += f", {prefixed_sql('optional field missing: ', 'missing_optional')}"
    if card:
        notes += ", CASE WHEN NOT found THEN [] WHEN NOT has_card THEN ['model card not present'] WHEN NOT has_params THEN ['model parameters not present'] ELSE [] END"

    def joined(lists):
        parts = [p for p in _split(lists)]
        out = parts[0]
        for p in parts[1:]:
            out = f"list_concat({out}, {p})"
        return out

    return (
        f"SELECT bom_id, model_id, array_to_string(e, '; ') AS errors, array_to_string(w, '; ') AS warnings, len(e) = 0 AS valid, score AS completeness_score "
        f"FROM (SELECT *, {joined(structural + hard)} AS e, {joined(notes)} AS w FROM v)"
    )


def _split(text: str):
    """Top-level comma split of a list of SQL expressions."""
    depth, start, quoted = 0, 0, False
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted:
            depth += ch in "([" or 0
            depth -= ch in ")]" or 0
            if text[i : i + 5] == "CASE ":
                depth += 1
            if text[i : i + 3] == "END" and not text[i - 1].isalnum():
                depth -= 1
            if ch == "," and depth == 0:
                yield text[start:i]
                start = i + 1
    yield text[start:]


def boms(spark, sf_dir):
    return view(spark, sf_dir, "bom_rows")


def flat_validation(df):
    return df.select(
        "bom_id", "model_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"),
        "valid", F.round("completeness_score", 9).alias("completeness_score"),
    )


@query("A4_validate", with_views("comp_flat", "bom_rows") + f", {_RESULTS} {validate_sql(False, 0.0, False)}")
def a4(spark, sf_dir):
    return flat_validation(score.validate(boms(spark, sf_dir), fx.components(spark, sf_dir)))


@query("A4_validate_strict", with_views("comp_flat", "bom_rows") + f", {_RESULTS} {validate_sql(True, 0.35, True)}")
def a4_strict(spark, sf_dir):
    c = fx.components(spark, sf_dir)
    return flat_validation(score.validate(boms(spark, sf_dir), c, strict=True, min_score=0.35, check_model_card=True))


@query(
    "A4_dataset_validation",
    with_views("comp_flat")
    + f""", dres AS ({_A3}) SELECT bom_id, ord, dataset_ref, array_to_string({prefixed_sql('required dataset field missing: ', 'missing_required')}, '; ') AS errors,
      array_to_string({prefixed_sql('optional dataset field missing: ', 'missing_optional')}, '; ') AS warnings FROM dres""",
)
def a4_dataset(spark, sf_dir):
    rows = score.dataset_validation(score.dataset_completeness(fx.components(spark, sf_dir)), strict=True)
    return rows.select(
        "bom_id", "ord", "dataset_ref", F.array_join("errors", "; ").alias("errors"),
        F.array_join("warnings", "; ").alias("warnings"),
    )


@query(
    "A4_dataset_notes",
    with_views("comp_flat")
    + f""", dres AS ({_A3}) SELECT bom_id, ord, 'dataset ' || coalesce(dataset_ref, '') || ': required dataset field missing: ' || missing_required AS note
    FROM dres WHERE missing_required <> ''""",
)
def a4_notes(spark, sf_dir):
    return score.dataset_notes(fx.components(spark, sf_dir))


def weights_sql(tests, minimum: float) -> str:
    rows = ", ".join(f"('{k}', {w}, {o})" for o, (k, w, _) in enumerate(tests) if w >= minimum)
    return f"(VALUES {rows}) AS reg(key, weight, ord)"


def _with_evidence(tests):
    """Registry position counts the evidence field without weight."""
    return tests[:7] + [("modelbom.evidence", -1.0, "")] + tests[7:]


@query(
    "X4_missing_fields",
    with_views("comp_flat")
    + f""", res AS ({_A2}), m AS (SELECT bom_id, unnest(string_split(concat_ws('|', nullif(missing_required, ''), nullif(missing_optional, '')), '|')) AS key FROM res)
    SELECT m.bom_id, CAST(reg.ord AS INTEGER) AS ord, m.key, CAST(reg.weight AS DOUBLE) AS weight, m.key = '{_M}name' AS required
    FROM m JOIN {weights_sql(_with_evidence(MODEL_TESTS), 0.3)} ON reg.key = m.key""",
)
def x4(spark, sf_dir):
    return score.missing_fields(score.completeness(fx.components(spark, sf_dir)), min_weight=0.3)


# Settings derived from the data: a value per region and for some keys none.
_SETTINGS = f"""SELECT concat(upper(left(k, 3)), substr(k, 4)) AS key, concat(v, ' ', (SELECT min(r_name) FROM region)) AS value FROM
  (SELECT '{_M}licenses' AS k, 'lic' AS v UNION ALL SELECT '{_M}tags', 'a, b,,a' UNION ALL SELECT '{_M}group', ' '
   UNION ALL SELECT '{_M}modelCard.considerations.useCases', ', x,' UNION ALL SELECT 'unknown.key', 'x') s"""


@query(
    "J5_enrichment_lookup",
    with_views("comp_flat")
    + f""", res AS ({_A2}), m AS (SELECT bom_id, unnest(string_split(concat_ws('|', nullif(missing_required, ''), nullif(missing_optional, '')), '|')) AS key FROM res)
    SELECT m.bom_id, m.key, s.value FROM m JOIN ({_SETTINGS}) s ON lower(s.key) = lower(m.key)""",
)
def j5(spark, sf_dir):
    missing = score.missing_fields(score.completeness(fx.components(spark, sf_dir)))
    fx.register_tables(spark, sf_dir, "region")
    return enrich.enrichment_lookup(missing, spark.sql(_SETTINGS)).select("bom_id", "key", "value")


# Values per BOM: the text of a user value goes to several fields of the BOM's model.
def user_value_map(prefix: str, keys: list[str]):
    pairs = [x for k in keys for x in (F.lit((prefix + k).lower()), F.col("value"))]
    return F.create_map(*pairs)


_X3_KEYS = [
    "name", "externalReferences", "tags", "licenses", "hashes", "group", "properties.huggingface:language",
    "modelCard.modelParameters.task", "modelCard.modelParameters.datasets", "modelCard.considerations.useCases",
    "modelCard.considerations.ethicalConsiderations", "modelCard.quantitativeAnalysis.performanceMetrics",
    "modelCard.considerations.environmentalConsiderations.properties",
]
_PIECES = f"list_transform(string_split({nz_sql('value')}, ','), lambda p: {trim_sql('p')})"
_ITEMS = f"nullif(list_filter({_PIECES}, lambda p: p <> ''), [])"
_PNAME = trim_sql("split_part(p, ':', 1)")
_PREST = f"CASE WHEN contains(p, ':') THEN {trim_sql('substr(p, strpos(p, chr(58)) + 1)')} ELSE '' END"
_PAIRS = f"nullif(array_to_string(list_transform(list_filter({_PIECES}, lambda p: {_PNAME} <> ''), lambda p: {_PNAME} || '=' || {_PREST}), '|'), '')"
_FULL = f"nullif(array_to_string(list_transform(list_filter({_PIECES}, lambda p: {_PNAME} <> '' AND {_PREST} <> ''), lambda p: {_PNAME} || '=' || {_PREST}), '|'), '')"
_V = nz_sql("value")
_ERR = ", ".join(
    f"CASE WHEN {t} IS NULL THEN '{_M}{k}' END"
    for k, t in [
        ("name", _V), ("externalReferences", _V), ("tags", _V), ("licenses", _V), ("hashes", _V), ("group", _V),
        ("properties.huggingface:language", _V), ("modelCard.modelParameters.task", _V),
        ("modelCard.modelParameters.datasets", _ITEMS), ("modelCard.considerations.useCases", _ITEMS),
        ("modelCard.considerations.ethicalConsiderations", _PAIRS),
        ("modelCard.quantitativeAnalysis.performanceMetrics", _PAIRS),
        ("modelCard.considerations.environmentalConsiderations.properties", _FULL),
    ]
)


@query(
    "X3_apply_user_values",
    with_views("comp_flat", "user_values")
    + f""" SELECT bom_id, coalesce({_V}, name) AS name, coalesce('website=' || {_V}, 'website=' || url) AS refs,
      coalesce(array_to_string({_PIECES}, '|'), replace(tags_csv, ',', '|')) AS tags, coalesce({_V}, license) AS license,
      coalesce('SHA-1=' || {_V}, 'SHA-1=' || sha) AS hashes, coalesce({_V}, grp) AS "group",
      nullif(concat_ws('|', nullif(props_csv, ''), 'huggingface:language=' || {_V}), '') AS props,
      coalesce({_V}, CASE WHEN has_card THEN task END) AS task,
      coalesce(array_to_string({_ITEMS}, '|'), CASE WHEN has_card THEN replace(datasets_csv, ',', '|') END) AS datasets,
      coalesce(array_to_string({_ITEMS}, '|'), CASE WHEN has_card THEN use_case END) AS use_cases,
      coalesce({_PAIRS}, CASE WHEN has_card THEN ethic || '=' END) AS ethics, coalesce({_PAIRS}, CASE WHEN has_card THEN metric || '=1' END) AS metrics,
      coalesce({_FULL}, CASE WHEN has_card THEN 'hardwareType=' || hardware END) AS environment, concat_ws('|', {_ERR}) AS errors
    FROM comp_flat JOIN user_values ON k = c_custkey WHERE is_metadata""",
)
def x3(spark, sf_dir):
    models = fx.components(spark, sf_dir).where("is_metadata")
    rows = models.join(view(spark, sf_dir, "user_values"), F.col("k") == F.col("c_custkey"))
    done = apply_user_values(rows, user_value_map(_M, _X3_KEYS))
    flat = flat_components(done).drop("ord")
    errors = done.select("bom_id", F.array_join("errors", "|").alias("errors"))
    cols = "bom_id name refs tags license hashes group props task datasets use_cases ethics metrics environment".split()
    return flat.select(*cols).join(errors, "bom_id")


_X3D_KEYS = ["tags", "authors", "data.description", "data.sensitiveData", "data.governance", "tags.lastModified", "data.contents.attachments"]
_NORMAL = f"list_filter(list_transform(string_split(value, ','), lambda p: {nz_sql('p')}), lambda p: p IS NOT NULL)"
_DISTINCT = f"list_filter({_NORMAL}, lambda x, i: list_position({_NORMAL}, x) = i)"


def _role(names: str) -> str:
    role = f"CASE WHEN contains(p, ':') THEN lower({trim_sql('split_part(p, chr(58), 1)')}) ELSE 'custodian' END"
    org = f"CASE WHEN contains(p, ':') THEN {trim_sql('substr(p, strpos(p, chr(58)) + 1)')} ELSE p END"
    return f"list_transform(list_filter({_PIECES}, lambda p: {role} IN ({names}) AND {org} <> ''), lambda p: {org})[-1]"


_CU, _ST, _OW = _role("'custodian','custodians'"), _role("'steward','stewards','curated','curatedby'"), _role("'owner','owners','funded','fundedby'")
_GOV = f"coalesce({_CU}, {_ST}, {_OW}) IS NOT NULL"


@query(
    "X3_apply_dataset_values",
    with_views("comp_flat", "user_values")
    + f""" SELECT bom_id, ord, CASE WHEN value IS NULL THEN replace(tags_csv, ',', '|') WHEN {_V} IS NOT NULL THEN array_to_string(list_concat({_DISTINCT}, ['lastModified:' || {_V}]), '|')
        ELSE array_to_string({_DISTINCT}, '|') END AS tags,
      coalesce(array_to_string(nullif({_DISTINCT}, []), '|'), author) AS authors, coalesce({_V}, CASE WHEN has_card THEN description END) AS description,
      CASE WHEN has_card THEN attachment END AS attachment, coalesce({_V}, CASE WHEN has_card THEN sensitive END) AS sensitive,
      CASE WHEN {_GOV} THEN {_CU} ELSE CASE WHEN has_card THEN custodian END END AS custodian, {_ST} AS steward, {_OW} AS owner
    FROM comp_flat LEFT JOIN user_values ON k = c_custkey WHERE NOT is_metadata""",
)
def x3_dataset(spark, sf_dir):
    data = fx.components(spark, sf_dir).where("not is_metadata")
    rows = data.join(view(spark, sf_dir, "user_values"), F.col("k") == F.col("c_custkey"), "left")
    done = apply_user_values(rows, user_value_map(_D, _X3D_KEYS), DATASET_REGISTRY)
    cols = "bom_id ord tags authors description attachment sensitive custodian steward owner".split()
    return flat_components(done).select(*cols)


# ---- enrichment as a whole --------------------------------------------------------------

_VALUES = {
    _M + "licenses": "Apache-2.0", _M + "group": "g2", _M + "modelCard.modelParameters.task": "new-task",
    _M + "properties.huggingface:likes": "5", _M + "modelCard.considerations.useCases": "u1,u2",
    _D + "licenses": "CC0", _D + "data.description": "described", _D + "properties.huggingface:datasetContact": "c@d",
}
_FILLED_MODEL = {
    "license": "coalesce(license, 'Apache-2.0')", "grp": f"coalesce({nz_sql('grp')}, 'g2')",
    "task": f"CASE WHEN has_card THEN coalesce({nz_sql('task')}, 'new-task') ELSE 'new-task' END",
    "props_csv": f"CASE WHEN {has_prop_sql('huggingface:likes')} THEN props_csv ELSE concat_ws('|', nullif(props_csv, ''), 'huggingface:likes=5') END",
    "use_case": "CASE WHEN has_card THEN coalesce(use_case, 'u1') ELSE 'u1' END",
}
_CARD_FIELDS = ["family", "arch", "datasets_csv", "limitation", "ethic", "metric", "hardware"]


def _progress_sql() -> str:
    # A model without a card gets one from the values set on it.
    hidden = ", ".join(f"CASE WHEN has_card THEN {f} END AS {f}" for f in _CARD_FIELDS)
    filled = ", ".join(f"{e} AS {c}" for c, e in _FILLED_MODEL.items())
    skip = ", ".join([*_CARD_FIELDS, *_FILLED_MODEL, "has_card"])
    return f"""after AS (SELECT * EXCLUDE ({skip}), {hidden}, {filled}, true AS has_card FROM comp_flat WHERE is_metadata),
    res AS ({_A2}), res2 AS ({_A2.replace('FROM comp_flat', 'FROM after')})
    SELECT a.bom_id, a.score AS initial_score, a.passed AS initial_passed, a.total AS initial_total, a.score AS refetched_score,
      a.passed AS refetched_passed, a.total AS refetched_total, b.score AS final_score, b.passed AS final_passed, b.total AS final_total
    FROM res a JOIN res2 b USING (bom_id)"""


def literal_values():
    return F.create_map(*[F.lit(x) for k, v in _VALUES.items() for x in (k.lower(), v)])


def rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if c.endswith("score") else F.col(c) for c in df.columns])


@query("A13_enrichment_progress", with_views("comp_flat") + f", {_progress_sql()}")
def a13(spark, sf_dir):
    models = fx.components(spark, sf_dir).where("is_metadata")
    after = enrich.enrich(models, literal_values())
    return rounded(score.enrichment_progress(score.completeness(models), score.completeness(after)))


@query(
    "L5_enrich",
    with_views("comp_flat")
    + f""" SELECT bom_id, ord, is_metadata, CASE WHEN is_metadata THEN coalesce(license, 'Apache-2.0') WHEN type = 'data' THEN coalesce(license, 'CC0') ELSE license END AS license,
      CASE WHEN is_metadata THEN coalesce({nz_sql('grp')}, 'g2') ELSE grp END AS "group",
      CASE WHEN is_metadata THEN {_FILLED_MODEL['task']} END AS task,
      CASE WHEN is_metadata THEN CASE WHEN has_card THEN coalesce(use_case, 'u1|u2') ELSE 'u1|u2' END END AS use_cases,
      CASE WHEN NOT is_metadata AND type = 'data' THEN CASE WHEN has_card THEN coalesce(CASE WHEN {nz_sql('description')} IS NOT NULL THEN description END, 'described') ELSE 'described' END
           WHEN NOT is_metadata AND has_card THEN description END AS description,
      nullif(CASE WHEN is_metadata THEN {_FILLED_MODEL['props_csv']} WHEN type = 'data' AND NOT {has_prop_sql('huggingface:datasetContact')}
        THEN concat_ws('|', nullif(props_csv, ''), 'huggingface:datasetContact=c@d') ELSE props_csv END, '') AS props
    FROM comp_flat""",
)
def l5(spark, sf_dir):
    tables = BomTables(boms=boms(spark, sf_dir), components=fx.components(spark, sf_dir).drop("k"))
    done, _ = inventory.enrich_boms(tables, literal_values())
    flags = done.components
    flat = flat_components(flags.withColumn("ord", F.struct("ord", "is_metadata")))
    cols = "license group task use_cases description props".split()
    return flat.select("bom_id", F.col("ord.ord").alias("ord"), F.col("ord.is_metadata").alias("is_metadata"), *cols)


@query(
    "L5_refresh_models",
    with_views("comp_flat", "hub_models")
    + f""", a AS (SELECT * FROM hub_models WHERE api_status = 200),
    c AS (SELECT f.*, coalesce(h.id, f.name) AS nm FROM comp_flat f LEFT JOIN hub_models h ON h.pk = f.k WHERE f.is_metadata)
    SELECT c.bom_id, CASE WHEN a.id IS NOT NULL THEN a.id ELSE nm END AS name,
      CASE WHEN a.id IS NOT NULL THEN coalesce('SHA-1=' || {nz_sql('a.sha')}, 'SHA-1=' || c.sha) ELSE 'SHA-1=' || c.sha END AS hashes,
      CASE WHEN a.id IS NOT NULL AND {nz_sql('c.author')} IS NULL THEN coalesce({nz_sql('a.author')}, c.author) ELSE c.author END AS manufacturer
    FROM c LEFT JOIN a ON a.id = {nz_sql('nm')}""",
)
def l5_refresh(spark, sf_dir):
    models = fx.components(spark, sf_dir).where("is_metadata")
    hub = fx.hub_models(spark, sf_dir)
    ids = hub.select(F.col("id").alias("hub_name"), F.col("pk").alias("k"))
    named = models.join(ids, "k", "left").withColumn("name", F.coalesce("hub_name", "name")).drop("hub_name", "k")
    fresh = refresh_models(named, hub.where("api_status = 200"))
    return flat_components(fresh).select("bom_id", "name", "hashes", "manufacturer")


@query(
    "L3_completeness",
    with_views("comp_flat", "bom_rows")
    + f""", {_RESULTS} SELECT v.bom_id, v.model_id, v.score, coalesce(r.passed, 0) AS passed, {len(MODEL_TESTS)} AS total, v.missing_required, v.missing_optional
    FROM v LEFT JOIN res r USING (bom_id)""",
)
def l3(spark, sf_dir):
    tables = BomTables(boms=boms(spark, sf_dir), components=fx.components(spark, sf_dir))
    return flat_result(inventory.completeness(tables)[0])


@query("L4_validate", with_views("comp_flat", "bom_rows") + f", {_RESULTS} {validate_sql(True, 0.5, True)}")
def l4(spark, sf_dir):
    tables = BomTables(boms=boms(spark, sf_dir), components=fx.components(spark, sf_dir))
    return flat_validation(inventory.validate(tables, strict=True, min_score=0.5, check_model_card=True))
