"""Joins with hub data and assembly: J1-J3, J8, X1, X2, A12, W1, T1, T2, S2-S5, L1, L2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.extract_queries import _TEXTS, DISCOVERIES_CTE, evidence_sql, hits_sql
from catalog.fixtures import view, with_views
from catalog.function_queries import (
    _FM, _FRONT_LINES, _HEAD, _ITEM_TEXT, yaml_scalar_sql,
    DATASET_FM, DATASETS_LIST_SQL, LANGUAGE_SQL, LICENSE_SQL, MODEL_FM, _METRICS_SQL, _RES_D, _J, card_sql,
    configs_sql, group_sql, normalized_sql, ordered_distinct_sql, purl_sql, refs_sql, string_members_sql,
    string_or_list_sql,
)
from catalog.registry import query
from catalog.sqltext import lit, nz_sql
from modelbom.functions import cards
from modelbom.functions import semistructured as ss
from modelbom.functions.rules import RULES
from modelbom.operators import assemble, extract, security
from modelbom.operators.common import cap_pages, dealt, first_wins, search_models, work_folder
from modelbom.plans import inventory
from modelbom import schemas as sc
from modelbom.sources import boms as bomio
from modelbom.sources import hub as hubio
from modelbom.sources.files import settings_rows

# ---- flattened component rows, Spark side -----------------------------------------------


def _pairs(arr, a, b):
    return F.array_join(F.transform(arr, lambda x: F.concat(x[a], F.lit("="), x[b])), "|")


def flat_components(c):
    """Component rows as text columns (what the oracles produce)."""
    mp, cons, d = F.col("model_card.modelParameters"), F.col("model_card.considerations"), F.get("data", F.lit(0))

    def parties(role):
        return F.get(d["governance"][role], F.lit(0))["organization"]["name"]

    return c.select(
        "bom_id", "ord", "type", "name", "group", "purl", "bom_ref",
        F.col("manufacturer.name").alias("manufacturer"),
        F.array_join(F.transform("authors", lambda a: a["name"]), "|").alias("authors"),
        F.get("licenses", F.lit(0))["license"]["name"].alias("license"),
        _pairs("hashes", "alg", "content").alias("hashes"),
        _pairs("external_references", "type", "url").alias("refs"),
        F.array_join("tags", "|").alias("tags"),
        _pairs("properties", "name", "value").alias("props"),
        mp["task"].alias("task"), mp["architectureFamily"].alias("family"), mp["modelArchitecture"].alias("arch"),
        F.array_join(F.transform(mp["datasets"], lambda r: r["ref"]), "|").alias("datasets"),
        F.array_join(cons["useCases"], "|").alias("use_cases"),
        F.array_join(cons["technicalLimitations"], "|").alias("limitations"),
        _pairs(cons["ethicalConsiderations"], "name", "mitigationStrategy").alias("ethics"),
        _pairs(F.col("model_card.quantitativeAnalysis.performanceMetrics"), "type", "value").alias("metrics"),
        _pairs(cons["environmentalConsiderations"]["properties"], "name", "value").alias("environment"),
        d["description"].alias("description"), d["contents"]["attachment"]["content"].alias("attachment"),
        F.array_join(d["sensitiveData"], "|").alias("sensitive"), d["classification"].alias("classification"),
        parties("custodians").alias("custodian"), parties("stewards").alias("steward"), parties("owners").alias("owner"),
    )


MODEL_COLUMNS = (
    "bom_id ord type name group purl bom_ref manufacturer license hashes refs tags props task family arch datasets "
    "use_cases limitations ethics metrics environment"
).split()
DATASET_COLUMNS = (
    "bom_id ord type name group purl bom_ref manufacturer authors license hashes refs tags props description attachment "
    "sensitive classification custodian steward owner"
).split()

# ---- the same rows in SQL ---------------------------------------------------------------

# Cards of models (by the model's pk) and of datasets (by document id).
_MODEL_CARDS = f"""{card_sql(cards.MODEL_SECTIONS, cards.MODEL_BULLETS, MODEL_FM)},
model_cards AS (SELECT m.id AS card_id, c.* EXCLUDE (doc_id) FROM card c JOIN hub_models m ON m.pk = c.doc_id)"""
_SEC = """sec AS (SELECT repo_id, CASE WHEN count_if(lower(status) = 'unsafe') > 0 THEN 'unsafe'
    WHEN count_if(lower(status) = 'caution') > 0 THEN 'caution' ELSE 'safe' END AS overall, count(status) AS scanned,
    count_if(lower(status) = 'unsafe') AS n_unsafe, count_if(lower(status) = 'caution') AS n_caution
  FROM security_flat WHERE kind = 'model' GROUP BY repo_id)"""
_API = """api AS (SELECT id AS api_id, * EXCLUDE (id, api_status) FROM hub_models WHERE api_status = 200)"""


def joined_cte(base: str) -> str:
    """base(id, scan_name, scan_type, scan_path, evidence) -> j, every source side by side."""
    return f"""{_MODEL_CARDS}, {_SEC}, {_API},
base AS ({base}),
j AS (SELECT coalesce({nz_sql('b.id')}, {nz_sql('b.scan_name')}) AS mid, b.scan_name, b.scan_type, b.scan_path, b.evidence,
        a.*, c.*, s.* EXCLUDE (repo_id)
      FROM base b LEFT JOIN api a ON a.api_id = coalesce({nz_sql('b.id')}, {nz_sql('b.scan_name')})
      LEFT JOIN model_cards c ON c.card_id = coalesce({nz_sql('b.id')}, {nz_sql('b.scan_name')})
      LEFT JOIN sec s ON s.repo_id = coalesce({nz_sql('b.id')}, {nz_sql('b.scan_name')}))"""


def _prop(name: str, value: str) -> str:
    return f"'{name}=' || {value}"


_IDX = f"CASE WHEN card_id IS NOT NULL THEN coalesce({_METRICS_SQL}, []) ELSE [] END"
_EXTRA = (
    f"list_transform(list_filter(coalesce(string_split(metrics, '|'), []), lambda n: NOT list_contains(list_transform({_IDX}, "
    "lambda x: split_part(x, '=', 1)), n)), lambda n: n || '=')"
)
_NORMAL_TAGS = f"nullif({normalized_sql(chr(115) + 'tring_split(tags_csv, ' + lit(',') + ')')}, [])"
X1_SQL = f"""SELECT mid AS bom_id, CAST(0 AS BIGINT) AS ord, 'machine-learning-model' AS type, name_ AS name, "group", purl, purl AS bom_ref,
  manufacturer, license_ AS license, hashes, refs, tags_ AS tags, props, task, family, arch, datasets_ AS datasets, use_cases, limitations,
  ethics, metrics_ AS metrics, environment
FROM (SELECT *, {purl_sql("'machine-learning-model'", "name_", "sha")} AS purl FROM (SELECT mid,
  coalesce({nz_sql('scan_name')}, {nz_sql('api_id')}, {nz_sql('model_id')}, {nz_sql('mid')}, 'model') AS name_,
  coalesce({group_sql('model_id', 'api_id', 'mid')}, {nz_sql('author')}, developed_by) AS "group", sha,
  coalesce({nz_sql('author')}, developed_by) AS manufacturer, coalesce({LICENSE_SQL}, license) AS license_,
  'SHA-1=' || {nz_sql('sha')} AS hashes, {refs_sql('mid', 'paper_url', 'demo_url', 'https://huggingface.co/')} AS refs,
  coalesce(array_to_string({_NORMAL_TAGS}, '|'), tags) AS tags_,
  concat_ws('|', {_prop('modelbom.type', nz_sql('scan_type'))}, {_prop('modelbom.evidence', nz_sql('evidence'))},
    {_prop('modelbom.path', nz_sql('scan_path'))}, {_prop('huggingface:lastModified', nz_sql('last_modified'))},
    {_prop('huggingface:createdAt', nz_sql('created_at'))}, {_prop('huggingface:language', LANGUAGE_SQL)},
    {_prop('huggingface:usedStorage', 'CASE WHEN used_storage > 0 THEN CAST(used_storage AS VARCHAR) END')},
    {_prop('huggingface:private', 'CAST(private AS VARCHAR)')}, {_prop('huggingface:libraryName', nz_sql('library_name'))},
    {_prop('huggingface:downloads', 'CASE WHEN downloads > 0 THEN CAST(downloads AS VARCHAR) END')},
    {_prop('huggingface:likes', 'CASE WHEN likes > 0 THEN CAST(likes AS VARCHAR) END')},
    {_prop('huggingface:baseModel', 'base_model')}, {_prop('huggingface:modelCardContact', 'model_card_contact')},
    {_prop('huggingface:security:overallStatus', 'overall')}, {_prop('huggingface:security:scannedFileCount', 'CAST(scanned AS VARCHAR)')},
    {_prop('huggingface:security:unsafeFileCount', 'CAST(n_unsafe AS VARCHAR)')},
    {_prop('huggingface:security:cautionFileCount', 'CAST(n_caution AS VARCHAR)')}) AS props,
  coalesce({nz_sql('pipeline_tag')}, CASE WHEN card_id IS NOT NULL THEN {nz_sql(f"json_extract_string({_J}, '{_RES_D}.task.type')")} END) AS task,
  {nz_sql('model_type')} AS family, {nz_sql("string_split(architectures_csv, ',')[1]")} AS arch,
  coalesce(CASE WHEN api_id IS NOT NULL THEN nullif(array_to_string({DATASETS_LIST_SQL}, '|'), '') END,
    array_to_string(list_transform(string_split(datasets, '|'), lambda d: CASE WHEN starts_with(d, 'dataset:') THEN d ELSE 'dataset:' || d END), '|')) AS datasets_,
  nullif(concat_ws('|', direct_use, 'out-of-scope: ' || out_of_scope_use), '') AS use_cases,
  bias_risks_limitations AS limitations,
  CASE WHEN bias_risks_limitations IS NOT NULL OR bias_recommendations IS NOT NULL
    THEN coalesce(bias_risks_limitations, 'bias_risks_limitations') || '=' || coalesce(bias_recommendations, '') END AS ethics,
  coalesce(nullif(array_to_string(list_concat({_IDX}, {_EXTRA}), '|'), ''), CASE WHEN testing_metrics IS NOT NULL OR results IS NOT NULL
    THEN coalesce(testing_metrics, 'testing_metrics') || '=' || coalesce(results, '') END) AS metrics_,
  nullif(concat_ws('|', 'hardwareType=' || hardware_type, 'hoursUsed=' || hours_used, 'cloudProvider=' || cloud_provider,
    'computeRegion=' || compute_region, 'carbonEmitted=' || carbon_emitted), '') AS environment
  FROM j))"""

_DS_IDS = ordered_distinct_sql(
    f"list_transform(list_concat(coalesce({string_or_list_sql('$.datasets')}, []), coalesce(string_split(datasets, '|'), [])), "
    f"lambda d: {nz_sql('d')})"
)
# Card fields of datasets get their own names: their CTEs run over the same cards.
_DS_CARD_FIELDS = ["license", "tags", "annotation_creators", *cards.DATASET_SECTIONS, *cards.DATASET_BULLETS]
_DCARD = card_sql(cards.DATASET_SECTIONS, cards.DATASET_BULLETS, DATASET_FM).rsplit("card AS (", 1)[1]
DATASET_ROWS = f"""dcard AS ({_DCARD},
ds_ids AS (SELECT mid AS bom_id, {_DS_IDS} AS ids FROM j),
ds_refs AS (SELECT bom_id, unnest(range(0, len(ids))) AS ord, unnest(ids) AS dataset_id FROM ds_ids),
dj AS (SELECT r.bom_id, r.ord, r.dataset_id, d.author, d.sha, d.description, d.last_modified, d.created_at, d.used_storage, d.tags_csv, d.card_json,
         {', '.join(f'k.{f} AS c_{f}' for f in _DS_CARD_FIELDS)}, k.doc_id AS card_id
       FROM ds_refs r JOIN hub_datasets d ON d.id = r.dataset_id
       LEFT JOIN dcard k ON concat('ds-org/', CAST(k.doc_id AS VARCHAR)) = r.dataset_id)"""

_CONFIG_LINES = (
    "array_to_string(flatten(list_transform(" + configs_sql() + ", lambda c: list_transform(list_filter(string_split(substr(c, strpos(c, '>') + 1), ';'), "
    "lambda f: f <> ''), lambda f: 'config:' || left(c, strpos(c, '>') - 1) || ' split:' || split_part(f, ':', 1) || ' path:' || split_part(f, ':', 2)))), chr(10))"
)
X2_SQL = f"""SELECT bom_id, ord, 'data' AS type, dataset_id AS name, {group_sql('dataset_id')} AS "group", {purl_sql("'data'", "dataset_id", "sha")} AS purl,
  {purl_sql("'data'", "dataset_id", "sha")} AS bom_ref, coalesce({nz_sql('author')}, {nz_sql("string_split(c_annotation_creators, '|')[1]")}) AS manufacturer,
  nullif(concat_ws('|', {nz_sql('author')}, c_annotation_creators), '') AS authors,
  coalesce(c_license, {nz_sql(f"json_extract_string({_J}, '$.license')")}) AS license, 'SHA-1=' || {nz_sql('sha')} AS hashes,
  {refs_sql('dataset_id', 'c_paper_url', 'c_demo_url', 'https://huggingface.co/datasets/')} AS refs,
  nullif(concat_ws('|', coalesce(array_to_string({_NORMAL_TAGS}, '|'), c_tags), 'lastModified:' || {nz_sql('last_modified')}), '') AS tags,
  nullif(concat_ws('|', {_prop('huggingface:createdAt', nz_sql('created_at'))},
    {_prop('huggingface:usedStorage', 'CASE WHEN used_storage > 0 THEN CAST(used_storage AS VARCHAR) END')},
    {_prop('huggingface:datasetContact', 'c_dataset_card_contact')}), '') AS props,
  coalesce(c_dataset_description, {nz_sql('description')}) AS description,
  CASE WHEN card_id IS NOT NULL THEN nullif({_CONFIG_LINES}, '') END AS attachment,
  nullif(concat_ws('|', array_to_string({string_members_sql('$.tags')}, '|'), 'out-of-scope: ' || c_out_of_scope_use,
    'personal-info: ' || c_personal_sensitive_info, 'bias-risks: ' || c_bias_risks_limitations), '') AS sensitive,
  CASE WHEN json_type({_J}, '$.task_categories') = 'ARRAY' AND json_type({_J}, '$.task_categories[0]') = 'VARCHAR'
    THEN {nz_sql(f"json_extract_string({_J}, '$.task_categories[0]')")} END AS classification,
  coalesce({nz_sql('author')}, c_shared_by, c_curated_by) AS custodian, c_curated_by AS steward, c_funded_by AS owner
FROM dj"""

_MODEL_VIEWS = ("hub_models", "cards", "security_flat")
_FROM_HUB = """SELECT id, CASE WHEN pk % 6 = 0 THEN ' ' ELSE concat(id, CASE WHEN pk % 5 = 0 THEN ' ' ELSE '' END) END AS scan_name,
  'model' AS scan_type, concat('/src/', id) AS scan_path, CASE WHEN pk % 4 <> 0 THEN concat('seen ', id) END AS evidence FROM hub_models"""


# ---- Spark side sources -----------------------------------------------------------------


def hub_cards(spark, sf_dir):
    """(hub models, model cards by id)."""
    every = fx.hub_models(spark, sf_dir)
    parsed = cards.model_card(view(spark, sf_dir, "cards"))
    return every, parsed.join(every.select("id", "pk"), F.col("doc_id") == F.col("pk"))


def dataset_cards(spark, sf_dir):
    ident = F.concat(F.lit("ds-org/"), F.col("doc_id").cast("string"))
    return cards.dataset_card(view(spark, sf_dir, "cards").withColumn("id", ident))


def landed_twice(rows):
    """Responses as a crawler lands them: every id twice, the second time with other contents."""
    again = rows.withColumn("author", F.lit("landed later"))
    return rows.withColumn("landed", F.lit(1)).unionByName(again.withColumn("landed", F.lit(2)))


def hub(spark, sf_dir) -> inventory.Hub:
    """Fixture hub: only models that answered 200 have metadata."""
    every, model_cards = hub_cards(spark, sf_dir)
    return inventory.Hub(
        models=landed_twice(every.where("api_status = 200")),
        datasets=landed_twice(fx.hub_datasets(spark, sf_dir)),
        model_cards=model_cards,
        dataset_cards=dataset_cards(spark, sf_dir),
        security=fx.security_entries(spark, sf_dir),
        status=every.select("id", F.col("api_status").alias("status")),
    )


def hub_discoveries(spark, sf_dir):
    rows = view(spark, sf_dir, "hub_models").selectExpr("*")
    rows.createOrReplaceTempView("hub_models")
    return spark.sql(_FROM_HUB).selectExpr(
        "id", "scan_name AS name", "scan_type AS type", "scan_path AS path", "evidence", "CAST(NULL AS STRING) AS method"
    )


def attached(spark, sf_dir):
    """Attached model rows over the fixture discoveries."""
    every, model_cards = hub_cards(spark, sf_dir)
    entries = fx.security_entries(spark, sf_dir).where("kind = 'model'")
    summary = security.security_summary(entries, ("repo_id",)).withColumnRenamed("repo_id", "id")
    return assemble.attach_metadata(
        hub_discoveries(spark, sf_dir), landed_twice(every.where("api_status = 200")), model_cards, summary
    )


def attached_datasets(spark, sf_dir):
    refs = assemble.model_dataset_refs(attached(spark, sf_dir))
    return assemble.attach_datasets(refs, landed_twice(fx.hub_datasets(spark, sf_dir)), dataset_cards(spark, sf_dir))


@query(
    "J1_attach_metadata",
    with_views(*_MODEL_VIEWS)
    + f", {joined_cte(_FROM_HUB)} SELECT mid AS bom_id, sha, downloads, license AS card_license, model_card_contact, overall, scanned FROM j",
)
def j1(spark, sf_dir):
    rows = attached(spark, sf_dir)
    return rows.select(
        "bom_id", "api.sha", "api.downloads", F.col("card.license").alias("card_license"), "card.model_card_contact",
        "sec.overall", "sec.scanned",
    )


@query(
    "J2_drop_unreachable",
    with_views("src_files", "hub_models")
    + f", {DISCOVERIES_CTE} SELECT id, path, method FROM discoveries WHERE id NOT IN (SELECT id FROM hub_models WHERE api_status IN (401, 403, 404))",
)
def j2(spark, sf_dir):
    found = extract.scan_references(view(spark, sf_dir, "src_files"))
    status = view(spark, sf_dir, "hub_models").select("id", F.col("api_status").alias("status"))
    return assemble.drop_unreachable(found, status).select("id", "path", "method")


@query(
    "J3_attach_datasets",
    with_views(*_MODEL_VIEWS, "hub_datasets")
    + f", {joined_cte(_FROM_HUB)}, {DATASET_ROWS} SELECT bom_id, ord, dataset_id, sha, c_license AS card_license, c_curated_by AS curated_by FROM dj",
)
def j3(spark, sf_dir):
    data = attached_datasets(spark, sf_dir)
    return data.select(
        "bom_id", "ord", "dataset_id", "api.sha", F.col("card.license").alias("card_license"), "card.curated_by"
    )


@query("X1_assemble_models", with_views(*_MODEL_VIEWS) + f", {joined_cte(_FROM_HUB)} {X1_SQL}")
def x1(spark, sf_dir):
    rows = attached(spark, sf_dir)
    return flat_components(assemble.assemble_models(rows)).select(*MODEL_COLUMNS)


@query(
    "X2_assemble_datasets",
    with_views(*_MODEL_VIEWS, "hub_datasets") + f", {joined_cte(_FROM_HUB)}, {DATASET_ROWS} {X2_SQL}",
)
def x2(spark, sf_dir):
    data = attached_datasets(spark, sf_dir)
    return flat_components(assemble.assemble_datasets(data)).select(*DATASET_COLUMNS)


_DEPENDENCIES = """m AS (SELECT bom_id, bom_ref FROM {c} WHERE is_metadata AND coalesce(bom_ref, '') <> ''),
d AS (SELECT bom_id, ord, bom_ref FROM {c} WHERE NOT is_metadata AND type = 'data' AND coalesce(bom_ref, '') <> '')
SELECT m.bom_id, CAST(0 AS BIGINT) AS ord, m.bom_ref AS ref, d.ord AS pos, d.bom_ref AS depends_on FROM m LEFT JOIN d USING (bom_id)
UNION ALL SELECT bom_id, d.ord + 1, d.bom_ref, NULL, NULL FROM m JOIN d USING (bom_id)"""


@query("J8_dependency_edges", with_views("comp_flat") + ", " + _DEPENDENCIES.replace("{c}", "comp_flat"))
def j8(spark, sf_dir):
    return assemble.dependency_edges(fx.components(spark, sf_dir))


_BASE_SCAN = """SELECT id, name AS scan_name, type AS scan_type, path AS scan_path, CAST(NULL AS VARCHAR) AS evidence FROM discoveries
  WHERE id NOT IN (SELECT id FROM hub_models WHERE api_status IN (401, 403, 404))"""
_L_COLUMNS = "bom_id, ord, type, name, \"group\", bom_ref, license, hashes, refs, tags, props"


def _generated(base: str) -> str:
    return (
        f"{joined_cte(base)}, {DATASET_ROWS}, models AS ({X1_SQL}), datas AS ({X2_SQL}) "
        f"SELECT {_L_COLUMNS}, true AS is_metadata FROM models UNION ALL SELECT {_L_COLUMNS}, false FROM datas"
    )


def _generated_columns(tables):
    flat = flat_components(tables.components)
    keys = [c.strip('"') for c in _L_COLUMNS.split(", ")]
    return flat.select(*keys).withColumn("is_metadata", F.col("type") == "machine-learning-model").withColumn(
        "props", F.when(F.col("is_metadata"), F.coalesce("props", F.lit(""))).otherwise(F.col("props"))
    )


@query(
    "L1_scan_and_generate",
    with_views("src_files", *_MODEL_VIEWS, "hub_datasets") + f", {DISCOVERIES_CTE}, {_generated(_BASE_SCAN)}",
)
def l1(spark, sf_dir):
    tables = inventory.scan_and_generate(view(spark, sf_dir, "src_files"), hub(spark, sf_dir), store=work_folder(spark))
    return _generated_columns(tables)


@query(
    "L1_evidence",
    with_views("src_files", "hub_models")
    + f""", {_TEXTS}, hits AS ({hits_sql('texts', RULES)}), ev AS ({evidence_sql('hits')})
    SELECT id AS bom_id, path, emit_line, evidence FROM ev WHERE id NOT IN (SELECT id FROM hub_models WHERE api_status IN (401, 403, 404))""",
)
def l1_evidence(spark, sf_dir):
    every = fx.hub_models(spark, sf_dir)
    status = every.select("id", F.col("api_status").alias("status"))
    some = inventory.Hub(models=every.where("api_status = 200"), status=status)
    tables = inventory.scan_and_generate(view(spark, sf_dir, "src_files"), some, store=work_folder(spark))
    return tables.extras["evidence"].select("bom_id", "at.path", "at.emit_line", "evidence")


_IDS_TABLE = "SELECT id FROM hub_models UNION ALL SELECT concat(' ', c_name, chr(9)) FROM customer UNION ALL SELECT '  ' FROM region"
_BASE_IDS = f"""SELECT DISTINCT {nz_sql('id')} AS id, {nz_sql('id')} AS scan_name, 'huggingface' AS scan_type, '' AS scan_path,
  concat('from model-id: ', {nz_sql('id')}) AS evidence FROM ({_IDS_TABLE}) WHERE {nz_sql('id')} IS NOT NULL
  AND {nz_sql('id')} NOT IN (SELECT id FROM hub_models WHERE api_status IN (401, 403, 404))"""


@query(
    "L2_generate_from_ids",
    with_views(*_MODEL_VIEWS, "hub_datasets") + f", {_generated(_BASE_IDS)}",
)
def l2(spark, sf_dir):
    fx.register_tables(spark, sf_dir, "customer region")
    view(spark, sf_dir, "hub_models").createOrReplaceTempView("hub_models")
    return _generated_columns(inventory.generate_from_ids(spark.sql(_IDS_TABLE), hub(spark, sf_dir)))


@query(
    "L1_vulnerabilities",
    with_views(*_MODEL_VIEWS, "hub_datasets")
    + f""", {joined_cte(_BASE_IDS)}, gate AS (SELECT DISTINCT repo_id FROM security_flat WHERE kind = 'model' AND lower(status) IN ('unsafe', 'caution'))
    SELECT mid AS bom_id, count(*) AS files FROM j JOIN gate ON gate.repo_id = mid JOIN security_flat s ON s.repo_id = mid AND s.kind = 'model'
    WHERE lower(s.status) NOT IN ('safe', 'unscanned', '') GROUP BY mid""",
)
def l1_vulnerabilities(spark, sf_dir):
    fx.register_tables(spark, sf_dir, "customer region")
    view(spark, sf_dir, "hub_models").createOrReplaceTempView("hub_models")
    tables = inventory.generate_from_ids(spark.sql(_IDS_TABLE), hub(spark, sf_dir))
    return tables.all_vulnerabilities().groupBy("bom_id").agg(F.count("*").alias("files"))


@query(
    "A12_fetch_outcomes",
    with_views("fetch_log")
    + """, o AS (SELECT id, min(seq) FILTER (WHERE stage = 'api' AND status = 200) AS ok_seq FROM fetch_log GROUP BY id),
    r AS (SELECT l.*, ok_seq, status >= 400 AND stage <> 'complete' AS failed FROM fetch_log l JOIN o USING (id)),
    q AS (SELECT *, failed AND (status = 404 OR (status IN (401, 403) AND (ok_seq IS NULL OR seq < ok_seq))) AS missing FROM r),
    g AS (SELECT id, max(ok_seq) IS NOT NULL AS api_ok, bool_or(missing) AS nf, bool_or(stage = 'complete') AS done,
      arg_min(status, seq) FILTER (WHERE failed AND NOT missing) AS err FROM q GROUP BY id)
    SELECT id, CASE WHEN nf AND NOT api_ok THEN 'not found' WHEN NOT done THEN 'incomplete' WHEN err IN (401, 403) THEN 'unauthorised'
      WHEN err IS NOT NULL THEN 'failed' WHEN api_ok AND nf THEN 'no readme' ELSE 'ok' END AS outcome FROM g""",
)
def a12(spark, sf_dir):
    return security.fetch_outcomes(view(spark, sf_dir, "fetch_log"))


@query(
    "A12_dataset_outcome",
    with_views("hub_models")
    + " SELECT id, CASE WHEN api_status = 200 THEN 'ok' WHEN api_status IN (401, 403, 404) THEN 'not found' ELSE 'failed' END AS outcome FROM hub_models",
)
def a12_dataset(spark, sf_dir):
    m = view(spark, sf_dir, "hub_models")
    return m.select("id", security.dataset_outcome("api_status").alias("outcome"))


@query(
    "W1_first_wins",
    with_views("services")
    + """ SELECT bom_ref, ord, name FROM (SELECT *, row_number() OVER (PARTITION BY bom_ref, CASE WHEN coalesce(bom_ref, '') = '' THEN ord END ORDER BY ord) AS rn
      FROM services) WHERE rn = 1""",
)
def w1(spark, sf_dir):
    s = view(spark, sf_dir, "services")
    return first_wins(s, ["bom_ref"], ["ord"], blank_key="bom_ref").select("bom_ref", "ord", "name")


@query(
    "T1_search_models",
    with_views("hub_models")
    + " SELECT id, downloads, likes FROM hub_models WHERE contains(lower(id), 'ring') ORDER BY downloads DESC, id LIMIT 20",
)
def t1(spark, sf_dir):
    return search_models(view(spark, sf_dir, "hub_models"), "Ring").select("id", "downloads", "likes")


@query("T2_cap_pages", with_views("security_flat") + " SELECT kind, repo_id, page, path FROM security_flat WHERE page < 10")
def t2(spark, sf_dir):
    return cap_pages(fx.security_entries(spark, sf_dir)).select("kind", "repo_id", "page", "path")


# ---- documents --------------------------------------------------------------------------


def small_boms(spark, sf_dir) -> bomio.BomTables:
    """Component rows regrouped into many small BOMs."""
    c = fx.components(spark, sf_dir).withColumn(
        "bom_id", F.concat("type", F.lit("-"), F.floor(F.col("k") / 10).cast("string"))
    ).withColumn("is_metadata", F.col("is_metadata") & (F.col("k") % 10 == 0)).drop("k")
    rows = c.groupBy("bom_id").agg(F.max("version").alias("version"))
    boms = rows.select(
        "bom_id", F.lit("1.6").alias("spec_version"), F.lit("CycloneDX").alias("bom_format"), F.col("bom_id").alias("serial_number"),
        F.lit(1).cast("bigint").alias("version"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
    )
    return bomio.BomTables(boms=boms, components=c)


@query(
    "S2_S3_document_round_trip",
    with_views("comp_flat")
    + """, s AS (SELECT *, concat(type, '-', CAST(CAST(floor(k / 10) AS BIGINT) AS VARCHAR)) AS doc, is_metadata AND k % 10 = 0 AS meta FROM comp_flat)
    SELECT doc AS bom_id, meta AS is_metadata, bom_ref, type, name, purl, license, replace(tags_csv, ',', '|') AS tags,
      nullif(props_csv, '') AS props, CASE WHEN is_metadata AND has_card THEN task END AS task,
      CASE WHEN NOT is_metadata AND has_card THEN classification END AS classification FROM s""",
)
def s2_s3(spark, sf_dir):
    path = work_folder(spark, "boms")
    bomio.write_boms(small_boms(spark, sf_dir), path)
    back = bomio.read_boms(spark, path, layout="entries")
    return back.components.select(
        "bom_id", "is_metadata", "bom_ref", "type", "name", "purl",
        F.get("licenses", F.lit(0))["license"]["name"].alias("license"), F.array_join("tags", "|").alias("tags"),
        _pairs("properties", "name", "value").alias("props"), F.col("model_card.modelParameters.task").alias("task"),
        F.get("data", F.lit(0))["classification"].alias("classification"),
    )


# Documents with fields that no column knows: expressions of licences, authors, children of children.
_ODD_DOCS = """SELECT concat('urn:uuid:', CAST(p_partkey AS VARCHAR)) AS serial_number,
  concat('{"$schema":"http://s","annotations":[{"text":"n', CAST(p_partkey AS VARCHAR), '"}],"bomFormat":"CycloneDX","components":[',
    '{"bom-ref":"c', CAST(p_partkey AS VARCHAR), '","components":[{"components":[{"components":[{"components":[{"name":"deep","type":"file"}],"name":"l4","type":"library"}],',
    '"name":"l3","type":"library"}],"name":"l2","type":"library"}],"cpe":"cpe:2.3:a","licenses":[{"expression":"MIT OR Apache-2.0"}],"name":"', lower(p_brand), '","scope":"optional","type":"library"},',
    '{"hashes":[{"alg":"MD5","content":"x","more":1}],"name":"twin","type":"library"}],"externalReferences":[{"hashes":[{"alg":"MD5","content":"y"}],"type":"vcs","url":"u"}],',
    '"metadata":{"authors":[{"name":"a"}],"component":{"description":"d","name":"m', CAST(p_partkey AS VARCHAR), '","type":"machine-learning-model"},"supplier":{"name":"s"},',
    '"timestamp":"2024-01-01T00:00:00Z","tools":{"components":[{"author":"w","name":"t","type":"application"}],"services":[{"name":"ts"}]}},"serialNumber":"urn:uuid:', CAST(p_partkey AS VARCHAR),
    '","services":[{"bom-ref":"s","endpoints":["http://e"],"name":"svc"}],"specVersion":"1.6","version":2,"vulnerabilities":[{"bom-ref":"v","cwes":[79],"id":"CVE"}]}') AS value FROM part"""


def odd_documents(spark, sf_dir):
    """The documents above, one JSON file line each, in a folder."""
    fx.register_tables(spark, sf_dir, "part")
    path = work_folder(spark, "odd")
    # Dealt by key, so that a row that comes twice stands in one file, where it is one document.
    dealt(spark.table("part"), "p_partkey").createOrReplaceTempView("part_by_key")
    sql = _ODD_DOCS.replace("VARCHAR", "STRING").replace("FROM part", "FROM part_by_key")
    spark.sql(sql).select("value").write.text(path)
    return path


def sorted_text(value):
    """A JSON text with sorted keys, as variants print."""
    return F.to_json(F.parse_json(value))


@query("S2_S3_whole_documents", _ODD_DOCS)
def s2_s3_whole(spark, sf_dir):
    tables = bomio.read_boms(spark, odd_documents(spark, sf_dir), layout="lines", store=work_folder(spark))
    path = work_folder(spark, "whole")
    bomio.write_boms(tables, path, layout="lines")
    back = spark.read.text(path)
    return back.select(F.get_json_object("value", "$.serialNumber").alias("serial_number"), sorted_text("value").alias("value"))


@query("S2_nested_components", """SELECT concat('urn:uuid:', CAST(p_partkey AS VARCHAR)) AS bom_id, * FROM part,
  (VALUES (2, 'l2', CONCAT('0.', '0')), (3, 'l3', '0.0.0'), (4, 'l4', '0.0.0.0'), (5, 'deep', '0.0.0.0.0')) AS k(level, name, path)""".replace("*", "level, name, path"))
def s2_nested(spark, sf_dir):
    tables = bomio.read_boms(spark, odd_documents(spark, sf_dir), layout="lines", store=work_folder(spark))
    kids = bomio.nested_components(tables.components).join(tables.boms.select("bom_id", "serial_number"), "bom_id")
    return kids.select(
        F.col("serial_number").alias("bom_id"), "level", "name", F.array_join(F.col("path").cast("array<string>"), ".").alias("path")
    )


@query("S2_S3_xml_documents", _ODD_DOCS)
def s2_s3_xml(spark, sf_dir):
    """Out as XML and back, with unknown fields, numbers, names that XML does not allow, and five levels of components."""
    tables = bomio.read_boms(spark, odd_documents(spark, sf_dir), layout="lines", store=work_folder(spark))
    path = work_folder(spark, "xml")
    bomio.write_boms(tables, path, fmt="xml", layout="lines")
    back = bomio.documents(bomio.read_boms(spark, path, fmt="xml", store=work_folder(spark)))
    return back.select(F.get_json_object("value", "$.serialNumber").alias("serial_number"), sorted_text("value").alias("value"))


_DEPTH = 12
_KIDS = reduce(
    lambda inner, k: f'{{"components":[{inner}],"name":"l{k}","scope":"s{k}","type":"library"}}',
    range(_DEPTH, 1, -1), '{"name":"deep","type":"file","x":{"y":[1,true,"z"]}}',
)
#: Two versions of each of these BOMs have one serial number; their components differ and are nested twelve levels deep.
_VERSIONED = f"""SELECT concat('urn:uuid:', CAST(s_suppkey AS VARCHAR)) AS serial_number, v AS version,
  concat('{{"bomFormat":"CycloneDX","components":[{{"components":[{_KIDS}],"name":"top', CAST(s_suppkey AS VARCHAR), '-', CAST(v AS VARCHAR),
    '","type":"library"}}],"serialNumber":"urn:uuid:', CAST(s_suppkey AS VARCHAR), '","specVersion":"1.6","version":', CAST(v AS VARCHAR), '}}') AS value
FROM supplier, (VALUES (1), (2)) AS k(v)"""


def versioned_documents(spark, sf_dir):
    fx.register_tables(spark, sf_dir, "supplier")
    path = work_folder(spark, "versions")
    spark.sql(_VERSIONED.replace("VARCHAR", "STRING")).select("value").write.text(path)
    return path


@query("S2_bom_identity", f"SELECT serial_number, version, concat('top', substr(serial_number, 10), '-', CAST(version AS VARCHAR)) AS name, CAST(1 AS BIGINT) AS n_components FROM ({_VERSIONED})")
def s2_identity(spark, sf_dir):
    """Two versions of one serial number stay two BOMs, each with its own components."""
    tables = bomio.read_boms(spark, versioned_documents(spark, sf_dir), layout="lines", store=work_folder(spark))
    own = tables.components.groupBy("bom_id").agg(F.min("name").alias("name"), F.count("*").alias("n_components"))
    return tables.boms.join(own, "bom_id").select("serial_number", F.col("version").cast("int").alias("version"), "name", "n_components")


@query(
    "S2_twelve_levels",
    f"""SELECT serial_number, version, level, CASE WHEN level = {_DEPTH + 1} THEN 'deep' ELSE concat('l', CAST(level AS VARCHAR)) END AS name,
      concat('0', repeat('.0', level - 1)) AS path FROM ({_VERSIONED}), (SELECT CAST(unnest(generate_series(2, {_DEPTH + 1})) AS INT) AS level)""",
)
def s2_twelve(spark, sf_dir):
    """Children of twelve levels after a way through XML."""
    tables = bomio.read_boms(spark, versioned_documents(spark, sf_dir), layout="lines", store=work_folder(spark))
    path = work_folder(spark, "deep-xml")
    bomio.write_boms(tables, path, fmt="xml", layout="lines")
    back = bomio.read_boms(spark, path, fmt="xml", store=work_folder(spark))
    about = back.boms.select("bom_id", "serial_number", F.col("version").cast("int").alias("bom_version"))
    kids = bomio.nested_components(back.components).join(about, "bom_id")
    return kids.select(
        "serial_number", F.col("bom_version").alias("version"), "level", "name", F.array_join(F.col("path").cast("array<string>"), ".").alias("path")
    )


_SPECS = ("1.1", "1.3", "1.4", "1.5", "1.6")


@query(
    "P19_fields_by_version",
    with_views("comp_flat") + """, s AS (SELECT *, concat(type, '-', CAST(CAST(floor(k / 10) AS BIGINT) AS VARCHAR)) AS doc, is_metadata AND k % 10 = 0 AS meta FROM comp_flat),
    v AS (SELECT unnest(['1.1', '1.3', '1.4', '1.5', '1.6']) AS spec)
    SELECT spec, doc AS bom_id, ord, meta AS is_metadata,
      CASE WHEN spec < '1.5' AND type IN ('machine-learning-model', 'data') THEN 'application' ELSE type END AS type,
      spec >= '1.6' AND tags_csv IS NOT NULL AND tags_csv <> '' AS has_tags,
      spec >= '1.3' AND nullif(props_csv, '') IS NOT NULL AS has_properties,
      spec >= '1.5' AND is_metadata AND has_card AS has_card,
      spec >= '1.5' AND NOT is_metadata AND has_card AS has_data
    FROM s, v WHERE NOT (spec = '1.1' AND meta)""",
)
def p19_versions(spark, sf_dir):
    """What the entries of each specification version hold, read from the written texts alone."""
    tables = small_boms(spark, sf_dir)
    made = [bomio.entries(tables, v).select(F.lit(v).alias("spec"), "bom_id", "ord", "section", "entry") for v in _SPECS]
    rows = reduce(DataFrame.unionByName, made).where("section in ('component', 'components')")
    # The fields are read in one pass over the text.
    fields = ["type", "tags", "properties", "modelCard", "data"]
    read = rows.select(
        "spec", "bom_id", F.get("ord", F.lit(0)).alias("ord"), (F.col("section") == "component").alias("is_metadata"),
        F.json_tuple("entry", *fields).alias(*fields),
    )
    has = lambda name: F.col(name).isNotNull()
    return read.select(
        "spec", "bom_id", "ord", "is_metadata", "type", has("tags").alias("has_tags"), has("properties").alias("has_properties"),
        has("modelCard").alias("has_card"), has("data").alias("has_data"),
    )


@query(
    "L1_written_and_validated",
    with_views("src_files", *_MODEL_VIEWS, "hub_datasets") + f", {DISCOVERIES_CTE}, {joined_cte(_BASE_SCAN)}, models AS ({X1_SQL}) SELECT bom_id, true AS named FROM models",
)
def l1_written(spark, sf_dir):
    folder = work_folder(spark)
    tables = inventory.scan_and_generate(view(spark, sf_dir, "src_files"), hub(spark, sf_dir), store=folder)
    bomio.write_boms(tables, folder + "/boms")
    before = inventory.validate(tables)
    after = inventory.validate(bomio.read_boms(spark, folder + "/boms", layout="entries"))
    same = before.join(after, ["bom_id", "completeness_score", "model_id"])
    return same.select("bom_id", F.col("model_id").isNotNull().alias("named"))


# ---- decoding of landed texts -----------------------------------------------------------


@query(
    "S4_decode_hub_models",
    with_views("hub_models")
    + f""" SELECT id, author, downloads, array_to_string(string_split(tags_csv, ','), '|') AS tags, last_modified, private,
      CASE json_type(CAST(gated_json AS JSON)) WHEN 'NULL' THEN NULL ELSE trim(json_extract_string(gated_json, '$')) END AS gated,
      model_type, nullif(array_to_string(string_split(architectures_csv, ','), '|'), '') AS architectures,
      json_extract_string({_J}, '$.license') AS license FROM hub_models""",
)
def s4(spark, sf_dir):
    m = fx.hub_models(spark, sf_dir)
    pairs = [
        F.concat(F.lit('"cardData":'), F.coalesce("card_json", F.lit("null"))),
        F.concat(F.lit('"gated":'), F.col("gated_json")),
    ]
    plain = F.to_json(
        F.struct(
            "id", "author", "downloads", "tags", F.col("last_modified").alias("lastModified"), "private",
            F.struct("model_type", "architectures").alias("config"),
        )
    )
    text = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit(","), F.substr(plain, F.lit(2), F.length(plain)))
    raw = m.select(F.from_json(text, sc.HUB_MODEL).alias("r")).select("r.*")
    return hubio.decoded_models(raw).select(
        "id", "author", "downloads", F.array_join("tags", "|").alias("tags"), "last_modified", "private", "gated",
        "model_type", F.array_join("architectures", "|").alias("architectures"),
        ss.at("card_data", "$.license", "string").alias("license"),
    )


@query(
    "S5_decode_security_tree",
    with_views("security_flat")
    + " SELECT repo_id, page, path, status, CASE WHEN status IS NOT NULL THEN av_status END AS av_status, "
    + "CASE WHEN status IS NOT NULL AND imports_csv IS NOT NULL THEN 'os.system=dangerous|re.match=safe' END AS imports FROM security_flat",
)
def s5(spark, sf_dir):
    e = fx.security_entries(spark, sf_dir)
    text = F.to_json(F.struct("repo_id", "page", "path", "securityFileStatus"))
    raw = e.select(F.from_json(text, hubio.TREE_ROW).alias("r")).select("r.*")
    s = F.col("securityFileStatus")
    return hubio.listed_entries(raw).select(
        "repo_id", "page", "path", s["status"].alias("status"), s["avScan"]["status"].alias("av_status"),
        F.array_join(
            F.transform(
                s["pickleImportScan"]["pickleImports"],
                lambda i: F.concat(i["module"], F.lit("."), i["name"], F.lit("="), i["safety"]),
            ), "|",
        ).alias("imports"),
    )


@query(
    "S6_settings_rows",
    with_views("cards")
    + f""", {_FM}, {_FRONT_LINES}, rows AS (SELECT doc_id, lower(owner) AS key, max(CASE WHEN key IS NOT NULL THEN {yaml_scalar_sql(_HEAD)} END) AS head,
        '[' || array_to_string(list(coalesce({yaml_scalar_sql(_ITEM_TEXT)}, '<nil>') ORDER BY n) FILTER (WHERE key IS NULL AND regexp_matches(l, '^[ \t]*-(?:[ \t]|$)')), ' ') || ']' AS items
      FROM fb GROUP BY doc_id, owner)
    SELECT doc_id, key, coalesce(head, items) AS value FROM rows WHERE coalesce(head, items) IS NOT NULL""",
)
def s6(spark, sf_dir):
    parts = cards.split_front_matter(view(spark, sf_dir, "cards"))
    texts = parts.select("doc_id", F.col("_front").alias("text"))
    return settings_rows(texts.where("text is not null"))


@query(
    "P23_stamp_boms",
    with_views("bom_rows")
    + """ SELECT bom_id, CASE WHEN serial_number IS NULL THEN 'urn:uuid:' ELSE serial_number END AS serial,
      CASE WHEN nullif(timestamp, '') IS NULL THEN 'now' ELSE timestamp END AS stamp, 'modelbom@v0.0.0' AS tool FROM bom_rows""",
)
def p23(spark, sf_dir):
    before = view(spark, sf_dir, "bom_rows")
    boms, tools = bomio.stamp_boms(before.withColumn("had", F.struct("serial_number", "timestamp")))
    new_time = F.col("timestamp").rlike(r"^20\d\d-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$")
    shown = boms.select(
        "bom_id",
        F.when(F.col("had.serial_number").isNull(), F.left("serial_number", F.lit(9))).otherwise(F.col("serial_number")).alias("serial"),
        F.when(F.coalesce("had.timestamp", F.lit("")) != "", F.col("timestamp")).when(new_time, "now").alias("stamp"),
    )
    tool = tools.select("bom_id", F.concat("name", F.lit("@"), "version").alias("tool"))
    return shown.join(tool, "bom_id")
