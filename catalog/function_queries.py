"""Scalar layer: P4-P24 and F1-F19."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import view, with_views
from catalog.registry import query
from catalog.sqltext import lit, nz_sql, trim_sql
from modelbom.functions import cards
from modelbom.functions import semistructured as ss
from modelbom.functions import text as tx
from modelbom.functions import uservalues as uv
from modelbom.operators import merge, security
from modelbom.operators.assemble import evidence_properties
from modelbom.operators.common import clean_ids
from modelbom.operators.registry import performance_metrics
from modelbom.sources.boms import spec_downgrade


def joined(arr, sep="|"):
    return F.array_join(arr, sep)


@query("P4_trim_nz", with_views("user_values") + f" SELECT c_custkey, {nz_sql('value')} AS v FROM user_values")
def p4(spark, sf_dir):
    return view(spark, sf_dir, "user_values").select("c_custkey", tx.trim_nz("value").alias("v"))


_SPEC_OK = f"{trim_sql('s')} IN ('1.0','1.1','1.2','1.3','1.4','1.5','1.6')"


@query(
    "P5_parse_spec_version",
    f"""SELECT o_orderkey, CASE WHEN {_SPEC_OK} THEN {trim_sql('s')} ELSE '1.6' END AS version, {_SPEC_OK} AS valid
    FROM (SELECT o_orderkey, concat(' 1.', CAST(o_orderkey % 9 AS VARCHAR), chr(9)) AS s FROM orders)""",
)
def p5(spark, sf_dir):
    fx.register_tables(spark, sf_dir)
    df = spark.sql("SELECT o_orderkey, concat(' 1.', CAST(o_orderkey % 9 AS STRING), chr(9)) AS s FROM orders")
    return df.select("o_orderkey", tx.parse_spec_version("s").alias("p")).select("o_orderkey", "p.*")


_NAMES = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat(c_mktsegment, '/', c_name, ' é.1') WHEN 1 THEN ' '
  WHEN 2 THEN concat(' ', c_name) END AS name, CASE WHEN c_custkey % 3 = 0 THEN concat(' disc:', c_name) END AS disc_name,
  CASE WHEN c_custkey % 5 = 0 THEN 'the/id' WHEN c_custkey % 5 = 1 THEN '' END AS disc_id FROM customer"""


@query(
    "P6_bom_file_name",
    f"""SELECT c_custkey, concat(regexp_replace(coalesce(CASE WHEN {nz_sql('name')} IS NOT NULL THEN name END,
      {nz_sql('disc_name')}, {nz_sql('disc_id')}, 'model'), '[^A-Za-z0-9._-]', '_', 'g'), '_aibom.json') AS file
    FROM ({_NAMES})""",
)
def p6(spark, sf_dir):
    fx.register_tables(spark, sf_dir)
    df = spark.sql(_NAMES)
    return df.select("c_custkey", tx.bom_file_name("name", "disc_name", "disc_id").alias("file"))


def purl_sql(type_: str, name: str, sha: str, existing: str | None = None) -> str:
    seg = f"list_transform(string_split({trim_sql(name)}, '/'), lambda s: replace(replace({trim_sql('s')}, '@', '%40'), ' ', '%20'))"
    made = (
        f"(CASE {type_} WHEN 'machine-learning-model' THEN 'pkg:huggingface/' WHEN 'data' THEN 'pkg:huggingface/datasets/' "
        f"ELSE 'pkg:huggingface/unknown/' END || CASE WHEN {nz_sql(name)} IS NULL THEN 'unknown' ELSE array_to_string({seg}, '/') END "
        f"|| coalesce('@' || lower({nz_sql(sha)}), ''))"
    )
    return made if existing is None else f"coalesce(nullif({existing}, ''), {made})"


_PURL = purl_sql("type", "name", "sha", "CASE WHEN ord % 2 = 0 THEN purl END")


@query(
    "P7_purl",
    with_views("comp_flat")
    + f" SELECT bom_id, ord, {_PURL} AS purl, {purl_sql('type', 'name', 'sha')} AS made FROM comp_flat",
)
def p7(spark, sf_dir):
    c = fx.components(spark, sf_dir)
    sha = F.get("hashes", F.lit(0))["content"]
    kept = F.when(F.col("ord") % 2 == 0, F.col("purl"))
    return c.select(
        "bom_id", "ord", tx.purl("type", "name", sha, kept).alias("purl"), tx.purl("type", "name", sha).alias("made")
    )


@query(
    "P8_bom_ref",
    with_views("comp_flat") + f" SELECT bom_id, ord, coalesce(nullif(bom_ref, ''), {_PURL}) AS ref FROM comp_flat",
)
def p8(spark, sf_dir):
    c = fx.components(spark, sf_dir)
    sha = F.get("hashes", F.lit(0))["content"]
    made = tx.purl("type", "name", sha, F.when(F.col("ord") % 2 == 0, F.col("purl")))
    return c.select("bom_id", "ord", tx.bom_ref("bom_ref", made).alias("ref"))


IDENTITY_SQL = (
    "coalesce(nullif(bom_ref, ''), concat_ws('/', nullif(type, ''), nullif(name, ''), nullif(version, '')))"
)


@query("P9_identity_ref", with_views("comp_flat") + f" SELECT bom_id, ord, {IDENTITY_SQL} AS ident FROM comp_flat")
def p9(spark, sf_dir):
    c = view(spark, sf_dir, "comp_flat")
    return c.select("bom_id", "ord", tx.identity_ref("bom_ref", "type", "name", "version").alias("ident"))


@query("P10_tool_key", with_views("tools") + " SELECT bom_id, ord, concat(name, '@', version) AS key FROM tools")
def p10(spark, sf_dir):
    return view(spark, sf_dir, "tools").select("bom_id", "ord", tx.tool_key("name", "version").alias("key"))


@query(
    "P11_legacy_tool_to_component",
    with_views("tools")
    + " SELECT bom_id, ord, name, version, 'application' AS type, nullif(vendor, '') AS manufacturer FROM tools WHERE legacy",
)
def p11(spark, sf_dir):
    tools = view(spark, sf_dir, "tools").where("legacy")
    return merge.legacy_tool_to_component(tools).drop("legacy")


MODEL_ID_SQL = (
    "coalesce(CASE WHEN starts_with(purl, 'pkg:huggingface/') AND contains(split_part(substr(purl, 17), '@', 1), '/') "
    f"THEN split_part(substr(purl, 17), '@', 1) END, {trim_sql('name')})"
)
DATASET_ID_SQL = (
    "coalesce(CASE WHEN starts_with(purl, 'pkg:huggingface/datasets/') THEN nullif(split_part(substr(purl, 26), '@', 1), '') END, "
    f"CASE WHEN starts_with({trim_sql('name')}, 'datasets/') THEN substr({trim_sql('name')}, 10) ELSE {trim_sql('name')} END)"
)


@query("P12_model_id", with_views("comp_flat") + f" SELECT bom_id, ord, {MODEL_ID_SQL} AS hub_id FROM comp_flat")
def p12(spark, sf_dir):
    c = view(spark, sf_dir, "comp_flat")
    return c.select("bom_id", "ord", tx.model_id_from_component("purl", "name").alias("hub_id"))


@query("P13_dataset_id", with_views("comp_flat") + f" SELECT bom_id, ord, {DATASET_ID_SQL} AS hub_id FROM comp_flat")
def p13(spark, sf_dir):
    c = view(spark, sf_dir, "comp_flat")
    return c.select("bom_id", "ord", tx.dataset_id_from_component("purl", "name").alias("hub_id"))


def severity_sql(c: str) -> str:
    return f"CASE lower({c}) WHEN 'unsafe' THEN 'critical' WHEN 'suspicious' THEN 'high' WHEN 'caution' THEN 'medium' ELSE 'unknown' END"


def actionable_sql(c: str) -> str:
    return f"coalesce(lower({c}) NOT IN ('', 'safe', 'unscanned'), false)"


@query(
    "P14_status_severity",
    with_views("security_flat")
    + f" SELECT event_id, {severity_sql('status')} AS severity, {actionable_sql('status')} AS act, "
    + f"{severity_sql('vt_status')} AS vt_severity, {actionable_sql('vt_status')} AS vt_act FROM security_flat",
)
def p14(spark, sf_dir):
    s = view(spark, sf_dir, "security_flat")
    return s.select(
        "event_id", security.status_severity("status").alias("severity"), security.actionable("status").alias("act"),
        security.status_severity("vt_status").alias("vt_severity"), security.actionable("vt_status").alias("vt_act"),
    )


_KEYS = "list_extract(['avScan', 'protectAiScan', 'pickleImportScan', 'virusTotalScan', 'jFrogScan', 'other'], CAST(event_id % 6 + 1 AS BIGINT))"


@query(
    "P15_scanner_label",
    f"""SELECT event_id, CASE {_KEYS} WHEN 'avScan' THEN 'Cisco Foundation AI (ClamAV)' WHEN 'protectAiScan' THEN 'ProtectAI'
      WHEN 'pickleImportScan' THEN 'HuggingFace Pickle Scanner' WHEN 'virusTotalScan' THEN 'VirusTotal'
      WHEN 'jFrogScan' THEN 'JFrog Research' END AS label FROM events""",
)
def p15(spark, sf_dir):
    fx.register_tables(spark, sf_dir)
    keys = F.lit(["avScan", "protectAiScan", "pickleImportScan", "virusTotalScan", "jFrogScan", "other"])
    e = spark.table("events")
    key = F.get(keys, (F.col("event_id") % 6).cast("int"))
    return e.select("event_id", security.scanner_label(key).alias("label"))


def group_sql(*ids: str) -> str:
    first = "coalesce(" + ", ".join(nz_sql(i) for i in ids) + ")"
    return nz_sql(f"split_part({first}, '/', 1)")


@query("P16_group_of", with_views("hub_models") + f" SELECT id, {group_sql('model_id', 'id')} AS grp FROM hub_models")
def p16(spark, sf_dir):
    return view(spark, sf_dir, "hub_models").select("id", tx.group_of("model_id", "id").alias("grp"))


def refs_sql(ident: str, paper: str, demo: str, base: str) -> str:
    bare = f"CASE WHEN starts_with({nz_sql(ident)}, '/') THEN substr({nz_sql(ident)}, 2) ELSE {nz_sql(ident)} END"
    return (
        f"CASE WHEN {nz_sql(ident)} IS NOT NULL THEN concat_ws('|', concat('website=', {lit(base)}, {bare}), "
        f"'documentation=' || {nz_sql(paper)}, 'other=' || {nz_sql(demo)}) END"
    )


def _ref_text(refs):
    return joined(F.transform(refs, lambda r: F.concat(r["type"], F.lit("="), r["url"])))


@query(
    "P17_external_refs",
    with_views("hub_models")
    + f""" SELECT id, {refs_sql('ident', 'author', 'library_name', 'https://huggingface.co/')} AS model_refs,
      {refs_sql('id', 'pipeline_tag', 'author', 'http://hub.local/datasets/')} AS dataset_refs
    FROM (SELECT *, CASE WHEN pk % 3 = 0 THEN concat('/', id) WHEN pk % 10 = 1 THEN ' ' ELSE id END AS ident FROM hub_models)""",
)
def p17(spark, sf_dir):
    m = view(spark, sf_dir, "hub_models")
    ident = F.when(F.col("pk") % 3 == 0, F.concat(F.lit("/"), "id")).when(F.col("pk") % 10 == 1, " ").otherwise(F.col("id"))
    return m.select(
        "id",
        _ref_text(tx.external_refs(ident, "author", "library_name")).alias("model_refs"),
        _ref_text(tx.external_refs("id", "pipeline_tag", "author", "dataset", " http://hub.local")).alias("dataset_refs"),
    )


@query(
    "P18_dataset_ref_forms",
    with_views("user_values")
    + f""" SELECT c_custkey,
      CASE WHEN starts_with(v, 'dataset:') THEN v ELSE 'dataset:' || v END AS normalized,
      CASE WHEN contains(v, ':') THEN v ELSE 'dataset:' || v END AS tagged
    FROM (SELECT c_custkey, {nz_sql('value')} AS v FROM user_values)""",
)
def p18(spark, sf_dir):
    u = view(spark, sf_dir, "user_values")
    return u.select(
        "c_custkey", tx.normalize_dataset_ref("value").alias("normalized"), tx.dataset_ref_tag("value").alias("tagged")
    )


@query(
    "P19_spec_downgrade",
    with_views("comp_flat")
    + " SELECT bom_id, ord, CAST(NULL AS VARCHAR) AS old_tags, replace(tags_csv, ',', '|') AS new_tags FROM comp_flat",
)
def p19(spark, sf_dir):
    c = fx.components(spark, sf_dir).select("bom_id", "ord", "tags")
    both = spec_downgrade(c.withColumn("now", F.col("tags")), "1.5")
    return both.select("bom_id", "ord", joined("tags").alias("old_tags"), joined("now").alias("new_tags"))


@query(
    "P20_clean_ids",
    with_views("user_values")
    + f" SELECT c_custkey, {nz_sql('value')} AS id FROM user_values WHERE {nz_sql('value')} IS NOT NULL",
)
def p20(spark, sf_dir):
    return clean_ids(view(spark, sf_dir, "user_values").withColumnRenamed("value", "id"))


@query(
    "P21_component_skeleton",
    with_views("hub_models")
    + f""" SELECT id, 'machine-learning-model' AS type, coalesce({nz_sql('author')}, {nz_sql('library_name')}, 'model') AS name
    FROM hub_models""",
)
def p21(spark, sf_dir):
    m = view(spark, sf_dir, "hub_models")
    return m.select(
        "id", F.lit("machine-learning-model").alias("type"),
        F.coalesce(tx.first_text("author", "library_name"), F.lit("model")).alias("name"),
    )


def _prop_text(props):
    return joined(F.transform(props, lambda p: F.concat(p["name"], F.lit("="), p["value"])))


@query(
    "P22_evidence_properties",
    with_views("hub_models")
    + f""" SELECT id, concat_ws('|', 'modelbom.type=' || {nz_sql('pipeline_tag')}, 'modelbom.evidence=' || {nz_sql('author')},
      'modelbom.path=' || {nz_sql('library_name')}) AS props FROM hub_models""",
)
def p22(spark, sf_dir):
    m = view(spark, sf_dir, "hub_models")
    scan = F.struct(
        F.col("pipeline_tag").alias("type"), F.col("author").alias("evidence"), F.col("library_name").alias("path")
    )
    return m.select("id", scan.alias("scan")).select("id", _prop_text(evidence_properties()).alias("props"))


_SCORE = "l_discount * l_quantity / 5"


@query(
    "P24_score_band",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s >= 0.8 THEN 'good' WHEN s >= 0.5 THEN 'warning' ELSE 'bad' END AS band,
      printf('%.1f%%', round_even(s * 100, 1)) AS percent
    FROM (SELECT *, {_SCORE} AS s FROM lineitem)""",
)
def p24(spark, sf_dir):
    fx.register_tables(spark, sf_dir)
    li = spark.table("lineitem").withColumn("s", F.expr(_SCORE))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tx.score_band("s").alias("band"),
        tx.score_percent("s").alias("percent"),
    )


# ---- strings, lists, card data ----------------------------------------------------------


def ordered_distinct_sql(lst: str) -> str:
    """First of equal, non-NULL list entries, in order."""
    return (
        f"list_filter({lst}, lambda x, i: x IS NOT NULL AND list_position({lst}, x) = i)"
    )


def trimmed_list_sql(lst: str) -> str:
    return f"list_transform({lst}, lambda y: {nz_sql('y')})"


def normalized_sql(lst: str) -> str:
    return ordered_distinct_sql(trimmed_list_sql(lst))


@query(
    "F1_normalize_strings",
    with_views("hub_models")
    + f" SELECT id, array_to_string({normalized_sql(chr(115) + 'tring_split(tags_csv, ' + lit(',') + ')')}, '|') AS tags FROM hub_models",
)
def f1(spark, sf_dir):
    return fx.hub_models(spark, sf_dir).select("id", joined(tx.normalize_strings("tags")).alias("tags"))


_J = "CAST(card_json AS JSON)"
LICENSE_SQL = (
    f"coalesce(CASE WHEN json_type({_J}, '$.license') = 'VARCHAR' THEN {nz_sql(f'json_extract_string({_J}, {lit(chr(36) + chr(46) + chr(108) + 'icense')})')} END, "
    f"{nz_sql('substr(list_filter(list_transform(string_split(tags_csv, ' + lit(',') + '), lambda t: ' + trim_sql('t') + '), lambda t: starts_with(t, ' + lit('license:') + '))[1], 9)')})"
)


@query("F2_extract_license", with_views("hub_models") + f" SELECT id, {LICENSE_SQL} AS license FROM hub_models")
def f2(spark, sf_dir):
    return fx.hub_models(spark, sf_dir).select("id", ss.extract_license("card_data", "tags").alias("license"))


def string_members_sql(path: str, j: str = _J) -> str:
    """String members of a JSON list as a list, NULL when it is no list."""
    return (
        f"CASE WHEN json_type({j}, '{path}') = 'ARRAY' THEN list_transform(list_filter(CAST(json_extract({j}, '{path}[*]') AS JSON[]), "
        f"lambda m: json_type(m) = 'VARCHAR'), lambda m: json_extract_string(m, '$')) END"
    )


def string_or_list_sql(path: str, j: str = _J) -> str:
    return (
        f"CASE WHEN json_type({j}, '{path}') = 'VARCHAR' THEN [json_extract_string({j}, '{path}')] "
        f"ELSE {string_members_sql(path, j)} END"
    )


LANGUAGE_SQL = (
    f"CASE WHEN json_type({_J}, '$.language') = 'VARCHAR' THEN {nz_sql(f'json_extract_string({_J}, {lit(chr(36) + ".language")})')} "
    f"ELSE nullif(array_to_string(list_filter({trimmed_list_sql(string_members_sql('$.language'))}, lambda x: x IS NOT NULL), ','), '') END"
)


@query("F3_extract_language", with_views("hub_models") + f" SELECT id, {LANGUAGE_SQL} AS lang FROM hub_models")
def f3(spark, sf_dir):
    return fx.hub_models(spark, sf_dir).select("id", ss.extract_language("card_data").alias("lang"))


_TAG_DATASETS = (
    f"list_filter(list_transform(string_split(tags_csv, ','), lambda t: {trim_sql('t')}), lambda t: starts_with(t, 'dataset:'))"
)
DATASETS_LIST_SQL = ordered_distinct_sql(
    f"list_transform(list_concat(coalesce({string_or_list_sql('$.datasets')}, []), coalesce({_TAG_DATASETS}, [])), "
    f"lambda d: CASE WHEN contains({nz_sql('d')}, ':') THEN {nz_sql('d')} ELSE 'dataset:' || {nz_sql('d')} END)"
)


@query(
    "F4_extract_datasets",
    with_views("hub_models") + f" SELECT id, array_to_string({DATASETS_LIST_SQL}, '|') AS datasets FROM hub_models",
)
def f4(spark, sf_dir):
    m = fx.hub_models(spark, sf_dir)
    return m.select("id", joined(ss.extract_datasets(F.col("card_data"), "tags")).alias("datasets"))


def slice_from_any_sql(path: str) -> str:
    t = f"json_type({_J}, '{path}')"
    texts = f"list_transform(CAST(json_extract({_J}, '{path}[*]') AS JSON[]), lambda m: json_extract_string(m, '$'))"
    return (
        f"CASE WHEN {t} = 'ARRAY' THEN nullif({normalized_sql(texts)}, []) "
        f"WHEN {nz_sql(f'json_extract_string({_J}, {lit(path)})')} IS NOT NULL THEN [{nz_sql(f'json_extract_string({_J}, {lit(path)})')}] END"
    )


@query(
    "F5_string_slice_from_any",
    with_views("hub_datasets", "hub_models")
    + " SELECT id, "
    + ", ".join(
        f"array_to_string({slice_from_any_sql('$.' + k)}, '|') AS {k}" for k in ("license", "tags", "task_categories")
    )
    + " FROM hub_datasets",
)
def f5(spark, sf_dir):
    d = fx.hub_datasets(spark, sf_dir)
    return d.select(
        "id",
        *[
            joined(ss.string_slice_from_any(ss.at("card_data", "$." + k))).alias(k)
            for k in ("license", "tags", "task_categories")
        ],
    )


@query(
    "F6_gated_value",
    with_views("hub_models")
    + f""" SELECT id, CASE json_type(CAST(gated_json AS JSON)) WHEN 'BOOLEAN' THEN json_extract_string(gated_json, '$')
      WHEN 'VARCHAR' THEN {trim_sql("json_extract_string(gated_json, '$')")} END AS gated FROM hub_models""",
)
def f6(spark, sf_dir):
    return view(spark, sf_dir, "hub_models").select("id", ss.gated_value("gated_json").alias("gated"))


_PIECES = f"list_transform(string_split({nz_sql('value')}, ','), lambda p: {trim_sql('p')})"
COMMA_SQL = f"nullif(list_filter({_PIECES}, lambda p: p <> ''), [])"


@query(
    "F7_parse_lists",
    with_views("user_values")
    + f""" SELECT c_custkey, array_to_string({_PIECES}, '|') AS tags, array_to_string({COMMA_SQL}, '|') AS items,
      {COMMA_SQL} IS NULL AS failed FROM user_values""",
)
def f7(spark, sf_dir):
    u = view(spark, sf_dir, "user_values")
    items = uv.parse_comma_list("value")
    return u.select(
        "c_custkey", joined(uv.parse_tags_keep_empty("value")).alias("tags"), joined(items).alias("items"),
        items.isNull().alias("failed"),
    )


@query(
    "F8_parse_dataset_refs",
    with_views("user_values")
    + f" SELECT c_custkey, pos, ref FROM (SELECT c_custkey, unnest(range(1, len(i) + 1)) AS pos, unnest(i) AS ref FROM (SELECT c_custkey, {COMMA_SQL} AS i FROM user_values))",
)
def f8(spark, sf_dir):
    u = view(spark, sf_dir, "user_values")
    rows = u.select("c_custkey", F.posexplode(uv.parse_dataset_refs("value")).alias("p", "r"))
    return rows.select("c_custkey", (F.col("p") + 1).cast("bigint").alias("pos"), F.col("r.ref").alias("ref"))


def pairs_sql(need_value: bool) -> str:
    name = trim_sql("split_part(p, ':', 1)")
    rest = f"CASE WHEN contains(p, ':') THEN {trim_sql(chr(115) + 'ubstr(p, strpos(p, ' + lit(':') + ') + 1)')} ELSE '' END"
    keep = f"{name} <> ''" + (f" AND {rest} <> ''" if need_value else "")
    return f"list_transform(list_filter({_PIECES}, lambda p: {keep}), lambda p: {name} || '=' || {rest})"


@query(
    "F9_parse_pairs",
    with_views("user_values")
    + f""" SELECT c_custkey, array_to_string(nullif({pairs_sql(False)}, []), '|') AS ethics,
      array_to_string(nullif({pairs_sql(False)}, []), '|') AS metrics,
      array_to_string(nullif({pairs_sql(True)}, []), '|') AS properties FROM user_values""",
)
def f9(spark, sf_dir):
    u = view(spark, sf_dir, "user_values")

    def text(arr, a, b):
        return joined(F.transform(arr, lambda x: F.concat(x[a], F.lit("="), x[b])))

    return u.select(
        "c_custkey", text(uv.parse_ethics("value"), "name", "mitigationStrategy").alias("ethics"),
        text(uv.parse_metrics("value"), "type", "value").alias("metrics"),
        text(uv.parse_properties("value"), "name", "value").alias("properties"),
    )


def role_sql(names: str) -> str:
    role = f"CASE WHEN contains(p, ':') THEN lower({trim_sql('split_part(p, ' + lit(':') + ', 1)')}) ELSE 'custodian' END"
    org = f"CASE WHEN contains(p, ':') THEN {trim_sql('substr(p, strpos(p, ' + lit(':') + ') + 1)')} ELSE p END"
    return f"list_transform(list_filter({_PIECES}, lambda p: {role} IN ({names}) AND {org} <> ''), lambda p: {org})[-1]"


@query(
    "F10_parse_governance",
    with_views("user_values")
    + f""" SELECT c_custkey, {role_sql("'custodian','custodians'")} AS custodians,
      {role_sql("'steward','stewards','curated','curatedby'")} AS stewards,
      {role_sql("'owner','owners','funded','fundedby'")} AS owners FROM user_values""",
)
def f10(spark, sf_dir):
    u = view(spark, sf_dir, "user_values").select("c_custkey", uv.parse_governance("value").alias("g"))
    return u.select("c_custkey", "g.custodians", "g.stewards", "g.owners")


# ---- cards ------------------------------------------------------------------------------

_FM = f"""t AS (SELECT doc_id, {trim_sql("replace(raw, chr(13) || chr(10), chr(10))")} AS t FROM cards),
r AS (SELECT doc_id, t, CASE WHEN starts_with(t, '---' || chr(10)) THEN substr(t, 5) END AS rest FROM t),
e AS (SELECT *, coalesce(nullif(strpos(rest, chr(10) || '---' || chr(10)), 0), nullif(strpos(rest, chr(10) || '---'), 0)) AS cut FROM r),
fm AS (SELECT doc_id, CASE WHEN cut IS NOT NULL THEN left(rest, cut - 1) END AS front,
  CASE WHEN cut IS NOT NULL THEN {trim_sql('substr(rest, cut)')} ELSE t END AS body FROM e)"""


@query("F11_split_front_matter", with_views("cards") + f", {_FM} SELECT * FROM fm")
def f11(spark, sf_dir):
    parts = cards.split_front_matter(view(spark, sf_dir, "cards"))
    return parts.select("doc_id", F.col("_front").alias("front"), F.col("_body").alias("body"))


# Flat keys by exploded lines: the key's own line, then the item lines up to the next key.
_FRONT_LINES = f"""fl AS (SELECT doc_id, string_split(front, chr(10)) AS ls FROM fm WHERE front IS NOT NULL),
fx AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS l FROM fl),
fk AS (SELECT *, CASE WHEN regexp_matches(l, '^[^ \t#\\-\\[\\]{{}}][^\n]*?:(?:[ \t]|$)') THEN regexp_extract(l, '^(.*?)[ \t]*:(?:[ \t]|$)', 1) END AS key FROM fx),
fb AS (SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS owner FROM fk)"""


def yaml_scalar_sql(c: str) -> str:
    t = trim_sql(c)
    plain = trim_sql(f"regexp_replace({t}, '(?:^|[ \t])#.*$', '')")
    return (
        f"nullif(CASE WHEN {plain} IN ('null', 'Null', 'NULL', '~') THEN '' WHEN starts_with({t}, '\"') THEN regexp_extract({t}, '^\"([^\"]*)\"', 1) "
        f"WHEN starts_with({t}, '''') THEN regexp_extract({t}, '^''([^'']*)''', 1) ELSE {plain} END, '')"
    )


_HEAD = trim_sql("regexp_extract(l, '^[^\n]*?:(?:[ \t]|$)(.*)$', 1)")
_ITEM_TEXT = "regexp_extract(l, '^[ \t]*-(?:[ \t]|$)(.*)$', 1)"


def fm_list_sql(key: str) -> str:
    """Sub-query (doc_id, v): '|'-joined values of a list key."""
    inline = "string_split(regexp_replace(regexp_replace(head, '^\\[', ''), '\\][ \t]*$', ''), ',')"
    values = f"CASE WHEN starts_with(head, '[') THEN {inline} WHEN head = '' THEN items ELSE [head] END"
    scal = f"list_transform({values}, lambda y: {nz_sql(yaml_scalar_sql('y'))})"
    return f"""(SELECT doc_id, array_to_string(nullif({ordered_distinct_sql(scal)}, []), '|') AS v FROM (
      SELECT doc_id, max(CASE WHEN key IS NOT NULL THEN {_HEAD} END) AS head,
             coalesce(list({_ITEM_TEXT} ORDER BY n) FILTER (WHERE key IS NULL AND regexp_matches(l, '^[ \t]*-(?:[ \t]|$)')), []) AS items
      FROM fb WHERE owner = '{key}' GROUP BY doc_id))"""


def fm_scalar_sql(key: str) -> str:
    return f"(SELECT doc_id, {nz_sql(yaml_scalar_sql(_HEAD))} AS v FROM fb WHERE key = '{key}')"


_FM_LISTS = ["tags", "datasets", "metrics", "language", "annotations_creators"]
_FM_SCALARS = ["license", "base_model"]
FRONT_CTE = f"{_FM}, {_FRONT_LINES}, " + ", ".join(
    [f"k_{k} AS {fm_list_sql(k)}" for k in _FM_LISTS] + [f"k_{k} AS {fm_scalar_sql(k)}" for k in _FM_SCALARS]
)


def front_columns(keys) -> str:
    return ", ".join(f"k_{k}.v AS {k}" for k in keys)


def front_joins(keys) -> str:
    return " ".join(f"LEFT JOIN k_{k} ON k_{k}.doc_id = c.doc_id" for k in keys)


_FM_KEYS = [*_FM_LISTS, *_FM_SCALARS]


@query(
    "F12_front_matter_fields",
    with_views("cards") + f", {FRONT_CTE} SELECT c.doc_id, {front_columns(_FM_KEYS)} FROM cards c {front_joins(_FM_KEYS)}",
)
def f12(spark, sf_dir):
    parsed = cards.parse_card(
        view(spark, sf_dir, "cards"), {k: k for k in _FM_SCALARS}, {k: k for k in _FM_LISTS}, {}, {}
    )
    return _flat(parsed.drop("fm_unparsed"))


_RES = "$.model-index[0].results[0]"
_RES_D = '$."model-index"[0].results[0]'
_METRICS_SQL = (
    f"list_filter(list_transform(list_filter(CAST(json_extract({_J}, '{_RES_D}.metrics[*]') AS JSON[]), lambda m: json_type(m) = 'OBJECT'), "
    f"lambda m: {trim_sql('coalesce(json_extract_string(m, ' + lit('$.type') + '), ' + lit('') + ')')} || '=' || "
    f"{trim_sql('coalesce(json_extract_string(m, ' + lit('$.value') + '), ' + lit('') + ')')}), lambda x: x <> '=')"
)


def _metric_text(arr):
    return joined(F.transform(arr, lambda m: F.concat(m["type"], F.lit("="), m["value"])))


@query(
    "F13_parse_model_index",
    with_views("hub_models")
    + f""" SELECT id, {nz_sql(f"json_extract_string({_J}, '{_RES_D}.task.type')")} AS task_type,
      {nz_sql(f"json_extract_string({_J}, '{_RES_D}.task.name')")} AS task_name,
      array_to_string(nullif({_METRICS_SQL}, []), '|') AS metrics FROM hub_models""",
)
def f13(spark, sf_dir):
    m = fx.hub_models(spark, sf_dir)
    index = ss.parse_model_index(ss.at("card_data", "$['model-index']"))
    rows = m.select("id", index.alias("i"))
    return rows.select("id", "i.task_type", "i.task_name", _metric_text(F.col("i.metrics")).alias("metrics"))


def configs_sql(j: str = _J) -> str:
    files = (
        "list_filter(list_transform(list_filter(coalesce(CAST(json_extract(c, '$.data_files[*]') AS JSON[]), []), lambda d: json_type(d) = 'OBJECT'), "
        f"lambda d: {trim_sql('coalesce(json_extract_string(d, ' + lit('$.split') + '), ' + lit('') + ')')} || ':' || "
        f"{trim_sql('coalesce(json_extract_string(d, ' + lit('$.path') + '), ' + lit('') + ')')}), lambda x: x <> ':')"
    )
    return (
        f"list_filter(list_transform(list_filter(CASE WHEN json_type({j}, '$.configs') = 'ARRAY' THEN CAST(json_extract({j}, '$.configs[*]') AS JSON[]) END, "
        f"lambda c: json_type(c) = 'OBJECT'), lambda c: {trim_sql('coalesce(json_extract_string(c, ' + lit('$.config_name') + '), ' + lit('') + ')')} "
        f"|| '>' || array_to_string({files}, ';')), lambda x: x <> '>')"
    )


@query(
    "F14_parse_dataset_configs",
    with_views("hub_datasets")
    + f" SELECT id, array_to_string(nullif({configs_sql()}, []), '|') AS configs FROM hub_datasets",
)
def f14(spark, sf_dir):
    d = fx.hub_datasets(spark, sf_dir)

    def text(c):
        files = F.transform(c["data_files"], lambda f: F.concat(f["split"], F.lit(":"), f["path"]))
        return F.concat(c["name"], F.lit(">"), F.array_join(files, ";"))

    configs = ss.parse_dataset_configs(ss.at("card_data", "$.configs"))
    return d.select("id", joined(F.transform(configs, text)).alias("configs"))


# Sections by list positions: first matching heading, next heading, lines between.
SECTION_CTE = f"""{_FM},
bl AS (SELECT doc_id, body, string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM fm),
bh AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '^#+\\s+.+$')) AS hs FROM bl)"""


def section_sql(heading: str) -> str:
    start = f"list_filter(hs, lambda i: regexp_matches(ls[i], '^#{{2,3}}\\s+' || {lit(heading)} || '\\s*$'))[1]"
    stop = f"coalesce(list_filter(hs, lambda i: i > {start})[1] - 1, len(ls))"
    return f"CASE WHEN {start} IS NOT NULL THEN {nz_sql(f'array_to_string(ls[{start} + 1 : {stop}], chr(10))')} END"


def bullet_sql(label: str) -> str:
    pat = "(?m)^-\\s+\\*\\*" + label + "(?:\\s*\\[[^\\]]+\\])?(?::\\*\\*|\\*\\*[^:\n]*:)\\s*(.+?)\\s*$"
    return nz_sql(f"regexp_extract(body, {lit(pat)}, 1)")


_ALL_SECTIONS = {**cards.MODEL_SECTIONS, **cards.DATASET_SECTIONS}
_ALL_BULLETS = {**cards.MODEL_BULLETS, **cards.DATASET_BULLETS}


@query(
    "F15_extract_section",
    with_views("cards")
    + f", {SECTION_CTE} SELECT doc_id, "
    + ", ".join(f"{section_sql(h)} AS {n}" for n, h in _ALL_SECTIONS.items())
    + " FROM bh",
)
def f15(spark, sf_dir):
    parsed = cards.parse_card(view(spark, sf_dir, "cards"), {}, {}, _ALL_SECTIONS, {})
    return parsed.drop("fm_unparsed")


@query(
    "F16_extract_bullet",
    with_views("cards")
    + f", {_FM} SELECT doc_id, "
    + ", ".join(f"{bullet_sql(h)} AS {n}" for n, h in _ALL_BULLETS.items())
    + " FROM fm",
)
def f16(spark, sf_dir):
    parsed = cards.parse_card(view(spark, sf_dir, "cards"), {}, {}, {}, _ALL_BULLETS)
    return parsed.drop("fm_unparsed")


def card_sql(sections: dict, bullets: dict, fm: dict) -> str:
    cols = [f"k_{k}.v AS {n}" for n, k in fm.items()]
    cols += [f"{section_sql(h)} AS {n}" for n, h in sections.items()]
    cols += [f"{bullet_sql(h)} AS {n}" for n, h in bullets.items()]
    bh = SECTION_CTE.split("bl AS", 1)[1]
    return f"{FRONT_CTE}, bl AS{bh}, card AS (SELECT c.doc_id, {', '.join(cols)} FROM bh c {front_joins(fm.values())})"


MODEL_FM = {k: k for k in ("license", "tags", "datasets", "metrics", "base_model")}
DATASET_FM = {"license": "license", "tags": "tags", "language": "language", "annotation_creators": "annotations_creators"}


def _flat(df):
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    return df.select(*[joined(c).alias(c) if c in arrays else F.col(c) for c in df.columns])


@query(
    "F17_model_card",
    with_views("cards") + f", {card_sql(cards.MODEL_SECTIONS, cards.MODEL_BULLETS, MODEL_FM)} SELECT * FROM card",
)
def f17(spark, sf_dir):
    return _flat(cards.model_card(view(spark, sf_dir, "cards")).drop("fm_unparsed"))


@query(
    "F18_dataset_card",
    with_views("cards") + f", {card_sql(cards.DATASET_SECTIONS, cards.DATASET_BULLETS, DATASET_FM)} SELECT * FROM card",
)
def f18(spark, sf_dir):
    return _flat(cards.dataset_card(view(spark, sf_dir, "cards")).drop("fm_unparsed"))


def has_prop_sql(name: str) -> str:
    return (
        f"coalesce(len(list_filter(string_split(props_csv, '|'), lambda p: {trim_sql('split_part(p, ' + lit('=') + ', 1)')} = '{name}' "
        f"AND {nz_sql('split_part(p, ' + lit('=') + ', 2)')} IS NOT NULL)) > 0, false)"
    )


@query(
    "F19_properties",
    with_views("comp_flat")
    + f""" SELECT bom_id, ord, concat_ws('|', nullif(props_csv, ''), CASE WHEN {nz_sql('author')} IS NOT NULL THEN 'by=' || {nz_sql('author')} END) AS props,
      {has_prop_sql('huggingface:private')} AS private, {has_prop_sql('huggingface:createdAt')} AS created FROM comp_flat""",
)
def f19(spark, sf_dir):
    c = fx.components(spark, sf_dir)
    author = F.col("manufacturer.name")
    return c.select(
        "bom_id", "ord", _prop_text(tx.set_property("properties", F.lit(" by "), author)).alias("props"),
        tx.has_property("properties", "huggingface:private").alias("private"),
        tx.has_property("properties", "huggingface:createdAt").alias("created"),
    )


_A11 = f"""card0 AS (SELECT doc_id, metrics, testing_metrics, results FROM card),
ix AS (SELECT m.id, m.pk, coalesce({_METRICS_SQL}, []) AS idx, c.doc_id, c.metrics, c.testing_metrics, c.results
  FROM hub_models m JOIN card0 c ON c.doc_id = m.pk),
nm AS (SELECT *, list_filter(string_split(metrics, '|'), lambda n: NOT list_contains(list_transform(idx, lambda x: split_part(x, '=', 1)), n)) AS extra FROM ix)"""


@query(
    "A11_performance_metrics",
    with_views("cards", "hub_models")
    + f""", {card_sql(cards.MODEL_SECTIONS, cards.MODEL_BULLETS, MODEL_FM)}, {_A11}
    SELECT id, coalesce(nullif(concat_ws('|', nullif(array_to_string(idx, '|'), ''), nullif(array_to_string(list_transform(extra, lambda n: n || '='), '|'), '')), ''),
      CASE WHEN testing_metrics IS NOT NULL OR results IS NOT NULL THEN coalesce(testing_metrics, 'testing_metrics') || '=' || coalesce(results, '') END) AS metrics
    FROM nm""",
)
def a11(spark, sf_dir):
    m = fx.hub_models(spark, sf_dir)
    card = cards.model_card(view(spark, sf_dir, "cards"))
    index = ss.parse_model_index(ss.at("card_data", "$['model-index']"))["metrics"]
    rows = m.select("id", "pk", index.alias("idx")).join(card, F.col("pk") == F.col("doc_id"))
    return rows.select(
        "id", _metric_text(performance_metrics(F.col("idx"), "metrics", "testing_metrics", "results")).alias("metrics")
    )
