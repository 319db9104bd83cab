"""Merge: J6, A9, A10, U1-U4, L7, L8."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import view, with_views
from catalog.function_queries import IDENTITY_SQL
from catalog.registry import query
from modelbom.operators import merge
from modelbom.plans import inventory
from modelbom.sources.boms import BomTables

# Component rows of the targets; the base's metadata component is not in the list.
_PLACED = f"""placed AS (SELECT m.target_id, m.seq, CASE WHEN is_metadata THEN 0 ELSE 1 END AS rank, {IDENTITY_SQL} AS ident, c.*
  FROM comp_flat c JOIN members m USING (bom_id)),
listed AS (SELECT * FROM placed WHERE NOT (seq = 0 AND is_metadata))"""


def merged_sql(source: str = "listed") -> str:
    return f"""base_ids AS (SELECT DISTINCT target_id, ident FROM {source} WHERE seq = 0 AND ident <> ''),
fresh AS (SELECT * FROM {source} l WHERE seq > 0 AND NOT EXISTS (SELECT 1 FROM base_ids b WHERE b.target_id = l.target_id AND b.ident = l.ident)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id, ident ORDER BY seq, rank, ord) AS rn FROM fresh),
merged AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1 OR ident = '' UNION ALL SELECT * FROM {source} WHERE seq = 0)"""


def placed(spark, sf_dir):
    return merge.place(fx.components(spark, sf_dir), view(spark, sf_dir, "members"))


@query(
    "J6_new_components",
    with_views("comp_flat", "members")
    + f", {_PLACED}, {merged_sql()} SELECT target_id, seq, ord, bom_id, name FROM merged WHERE seq > 0",
)
def j6(spark, sf_dir):
    return merge.new_components(placed(spark, sf_dir)).select("target_id", "seq", "ord", "bom_id", "name")


_DEPS = """dp AS (SELECT m.target_id, m.seq, d.* FROM dep_rows d JOIN members m USING (bom_id)){last},
once AS (SELECT target_id, ref, count(DISTINCT (seq, ord)) FILTER (WHERE depends_on IS NOT NULL) AS n FROM {src} GROUP BY target_id, ref),
e AS (SELECT d.*, n FROM {src} d JOIN once USING (target_id, ref)),
kept AS (
  SELECT target_id, ref, depends_on, seq, ord, pos FROM e WHERE n = 1 AND depends_on IS NOT NULL
  UNION ALL SELECT target_id, ref, depends_on, seq, ord, pos FROM (SELECT *, row_number() OVER (PARTITION BY target_id, ref, depends_on ORDER BY seq, ord, pos) AS rn
    FROM e WHERE n > 1 AND depends_on IS NOT NULL) WHERE rn = 1
  UNION ALL SELECT DISTINCT target_id, ref, CAST(NULL AS VARCHAR), NULL, NULL, NULL FROM e WHERE n = 0)"""
_DEPS_MANY = _DEPS.format(last="", src="dp")
_DEPS_TWO = _DEPS.format(
    last=""",
dp2 AS (SELECT * FROM dp WHERE seq > 0 OR ord = (SELECT max(x.ord) FROM dp x WHERE x.seq = 0 AND x.target_id = dp.target_id AND x.ref = dp.ref))""",
    src="dp2",
)
_DEP_COLUMNS = "target_id, ref, depends_on, CASE WHEN depends_on IS NOT NULL THEN seq END AS seq, CASE WHEN depends_on IS NOT NULL THEN ord END AS ord, pos"


def dep_columns(edges):
    at = F.when(F.col("depends_on").isNotNull(), F.col("at"))
    return edges.select(
        "target_id", "ref", "depends_on", at["seq"].alias("seq"), at["ord"].alias("ord"), at["pos"].alias("pos")
    )


@query("A9_merge_dependencies", with_views("dep_rows", "members") + f", {_DEPS_MANY} SELECT {_DEP_COLUMNS} FROM kept")
def a9(spark, sf_dir):
    rows = merge.place(view(spark, sf_dir, "dep_rows"), view(spark, sf_dir, "members"))
    return dep_columns(merge.merge_dependencies(rows))


@query(
    "A9_dependency_lists",
    with_views("dep_rows", "members")
    + f""", {_DEPS_MANY} SELECT target_id, ref, coalesce(array_to_string(list(depends_on ORDER BY seq, ord, pos) FILTER (WHERE depends_on IS NOT NULL), '|'), '') AS depends_on
    FROM kept GROUP BY target_id, ref""",
)
def a9_lists(spark, sf_dir):
    rows = merge.place(view(spark, sf_dir, "dep_rows"), view(spark, sf_dir, "members"))
    lists = merge.dependency_lists(merge.merge_dependencies(rows))
    return lists.select("target_id", "ref", F.array_join("depends_on", "|").alias("depends_on"))


_STATS = """st AS (SELECT target_id, CAST(count_if(seq = 0 AND NOT is_metadata) AS BIGINT) AS sbom_components, CAST(count_if(seq > 0) AS BIGINT) AS candidates,
    max(CASE WHEN seq = 0 AND is_metadata THEN name END) AS metadata_component FROM placed GROUP BY target_id),
ad AS (SELECT target_id, CAST(count_if(seq > 0) AS BIGINT) AS n FROM merged GROUP BY target_id)
SELECT target_id, sbom_components, coalesce(n, 0) AS aibom_components, candidates - coalesce(n, 0) AS duplicates_removed, metadata_component
FROM st LEFT JOIN ad USING (target_id)"""


@query("A10_merge_stats", with_views("comp_flat", "members") + f", {_PLACED}, {merged_sql()}, {_STATS}")
def a10(spark, sf_dir):
    p = placed(spark, sf_dir)
    return merge.merge_stats(p, merge.merge_components(p))


@query(
    "A10_merged_names",
    with_views("comp_flat", "members")
    + f""", {_PLACED}, {merged_sql()} SELECT * FROM (SELECT target_id, CASE WHEN seq = 0 THEN 'sbom' WHEN is_metadata AND type = 'machine-learning-model' THEN 'model'
      WHEN NOT is_metadata AND type = 'data' THEN 'dataset' END AS role, seq, rank, ord, name FROM merged) WHERE role IS NOT NULL""",
)
def a10_names(spark, sf_dir):
    return merge.merged_names(merge.merge_components(placed(spark, sf_dir)))


@query(
    "U1_concat_external_refs",
    with_views("ext_refs", "members")
    + " SELECT target_id, seq, ord, type, url FROM ext_refs JOIN members USING (bom_id)",
)
def u1(spark, sf_dir):
    rows = merge.concat_lists(view(spark, sf_dir, "ext_refs"), view(spark, sf_dir, "members"))
    return rows.select("target_id", "ord.seq", "ord.ord", "type", "url")


@query(
    "U1_concat_compositions",
    with_views("services", "members")
    + " SELECT target_id, seq, ord, name AS aggregate, concat_ws('|', bom_ref, name) AS assemblies FROM services JOIN members USING (bom_id)",
)
def u1_compositions(spark, sf_dir):
    rows = view(spark, sf_dir, "services").select(
        "bom_id", "ord", F.col("name").alias("aggregate"), F.array_compact(F.array("bom_ref", "name")).alias("assemblies")
    )
    out = merge.concat_lists(rows, view(spark, sf_dir, "members"))
    return out.select("target_id", "ord.seq", "ord.ord", "aggregate", F.array_join("assemblies", "|").alias("assemblies"))


_SERVICES = "sv AS (SELECT m.target_id, m.seq, s.* FROM services s JOIN members m USING (bom_id))"
_SERVICES_MANY = f"""{_SERVICES} SELECT target_id, seq, ord, bom_ref, name FROM (SELECT *, row_number() OVER (PARTITION BY target_id, bom_ref ORDER BY seq, ord) AS rn FROM sv)
  WHERE rn = 1 OR coalesce(bom_ref, '') = ''"""


@query("U2_merge_services", with_views("services", "members") + f", {_SERVICES_MANY}")
def u2(spark, sf_dir):
    rows = merge.place(view(spark, sf_dir, "services"), view(spark, sf_dir, "members"))
    return merge.merge_services(rows).select("target_id", "seq", "ord", "bom_ref", "name")


@query(
    "U2_merge_services_two",
    with_views("services", "members")
    + f""", {_SERVICES} SELECT target_id, seq, ord, bom_ref, name FROM sv WHERE seq = 0 UNION ALL
    SELECT target_id, seq, ord, bom_ref, name FROM (SELECT *, row_number() OVER (PARTITION BY target_id, bom_ref ORDER BY seq, ord) AS rn FROM sv WHERE seq > 0) l
    WHERE (rn = 1 AND NOT EXISTS (SELECT 1 FROM sv b WHERE b.seq = 0 AND b.target_id = l.target_id AND b.bom_ref = l.bom_ref)) OR coalesce(bom_ref, '') = ''""",
)
def u2_two(spark, sf_dir):
    rows = merge.place(view(spark, sf_dir, "services"), view(spark, sf_dir, "members"))
    return merge.merge_services(rows, keep_base_repeats=True).select("target_id", "seq", "ord", "bom_ref", "name")


_TOOLS = """tl AS (SELECT m.target_id, m.seq, t.*, concat(name, '@', coalesce(version, '')) AS key FROM tools t JOIN members m USING (bom_id)),
cand AS (SELECT * FROM tl WHERE (seq = 0 AND legacy) OR (seq > 0 AND NOT legacy)),
rk AS (SELECT *, row_number() OVER (PARTITION BY target_id, key ORDER BY seq, ord) AS rn FROM cand c
  WHERE NOT EXISTS (SELECT 1 FROM tl b WHERE b.seq = 0 AND NOT b.legacy AND b.target_id = c.target_id AND b.key = c.key))
SELECT target_id, seq, ord, legacy, type, manufacturer, name, version FROM tl WHERE seq = 0 AND NOT legacy
UNION ALL SELECT target_id, seq, ord, legacy, 'application', CASE WHEN legacy THEN nullif(vendor, '') ELSE manufacturer END, name, version FROM rk WHERE rn = 1"""
_TOOL_COLUMNS = ["target_id", "seq", "ord", "legacy", "type", "manufacturer", "name", "version"]


@query("U3_merge_tools", with_views("tools", "members") + f", {_TOOLS}")
def u3(spark, sf_dir):
    rows = merge.place(view(spark, sf_dir, "tools"), view(spark, sf_dir, "members"))
    return merge.merge_tools(rows).select(*_TOOL_COLUMNS)


_METADATA = """mb AS (SELECT m.target_id, m.seq, b.* FROM bom_rows b JOIN members m USING (bom_id)),
ot AS (SELECT target_id, arg_min(timestamp, seq) FILTER (WHERE nullif(timestamp, '') IS NOT NULL) AS other FROM mb WHERE seq > 0 GROUP BY target_id)
SELECT target_id, bom_id, coalesce(spec_version, '1.6') AS spec_version, coalesce(bom_format, 'CycloneDX') AS bom_format, serial_number, version,
  coalesce(nullif(timestamp, ''), other) AS timestamp FROM mb LEFT JOIN ot USING (target_id) WHERE seq = 0"""


@query("U4_merge_metadata", with_views("bom_rows", "members") + f", {_METADATA}")
def u4(spark, sf_dir):
    return merge.merge_metadata(view(spark, sf_dir, "bom_rows"), view(spark, sf_dir, "members"))


@query(
    "U4_concat_legacy_tools",
    with_views("tools", "members")
    + " SELECT target_id, seq, ord, vendor, name, version FROM tools JOIN members USING (bom_id) WHERE legacy",
)
def u4_tools(spark, sf_dir):
    rows = merge.place(view(spark, sf_dir, "tools"), view(spark, sf_dir, "members"))
    return merge.concat_legacy_tools(rows).select("target_id", "seq", "ord", "vendor", "name", "version")


def tables(spark, sf_dir) -> BomTables:
    return BomTables(
        boms=view(spark, sf_dir, "bom_rows"),
        components=fx.components(spark, sf_dir).drop("k"),
        dependencies=view(spark, sf_dir, "dep_rows"),
        tools=view(spark, sf_dir, "tools"),
        services=view(spark, sf_dir, "services"),
        external_refs=view(spark, sf_dir, "ext_refs"),
    )


def merged_components(out: BomTables):
    return out.components.select(
        F.col("bom_id").alias("target_id"), F.col("ord.seq").alias("seq"), F.col("ord.ord").alias("ord"),
        "is_metadata", "type", "name", "bom_ref",
    )


_MERGED_COLUMNS = "target_id, seq, ord, is_metadata AND seq = 0 AS is_metadata, type, name, bom_ref"


@query(
    "L7_merge_many",
    with_views("comp_flat", "members")
    + f", {_PLACED}, {merged_sql()} SELECT {_MERGED_COLUMNS} FROM merged UNION ALL SELECT {_MERGED_COLUMNS} FROM placed WHERE seq = 0 AND is_metadata",
)
def l7(spark, sf_dir):
    out, _ = inventory.merge_boms(tables(spark, sf_dir), view(spark, sf_dir, "members"))
    return merged_components(out)


# The two-BOM form over the base of each target and the BOM after it.
_TWO = """members2 AS (SELECT * FROM members WHERE seq = 0 UNION ALL SELECT m.* FROM members m
  JOIN (SELECT target_id, min(seq) AS s FROM members WHERE seq > 0 GROUP BY target_id) x ON x.target_id = m.target_id AND x.s = m.seq)"""
_TWO_LISTED = "listed2 AS (SELECT * FROM listed WHERE NOT is_metadata)"


def two_members(spark, sf_dir):
    every = view(spark, sf_dir, "members")
    second = every.where("seq > 0").groupBy("target_id").agg(F.min("seq").alias("seq"))
    return every.where("seq = 0").unionByName(every.join(second, ["target_id", "seq"], "left_semi"))


@query(
    "L8_merge_two",
    with_views("comp_flat", "members")
    + f", {_TWO}, {_PLACED.replace('JOIN members m', 'JOIN members2 m')}, {_TWO_LISTED}, {merged_sql('listed2')} "
    + f"SELECT {_MERGED_COLUMNS} FROM merged UNION ALL SELECT {_MERGED_COLUMNS} FROM placed WHERE seq = 0 AND is_metadata",
)
def l8(spark, sf_dir):
    out, _ = inventory.merge_boms(tables(spark, sf_dir), two_members(spark, sf_dir), two_bom_form=True)
    return merged_components(out)


@query(
    "L8_merge_two_dependencies",
    with_views("dep_rows", "members")
    + f", {_TWO}, {_DEPS_TWO.replace('JOIN members m', 'JOIN members2 m')} SELECT target_id, ref, depends_on FROM kept",
)
def l8_dependencies(spark, sf_dir):
    out, _ = inventory.merge_boms(tables(spark, sf_dir), two_members(spark, sf_dir), two_bom_form=True)
    return out.dependencies.select("target_id", "ref", "depends_on")


@query(
    "L7_merge_without_dedupe",
    with_views("comp_flat", "members") + f", {_PLACED} SELECT target_id, seq, ord, bom_id, name FROM listed",
)
def l7_all(spark, sf_dir):
    rows = merge.merge_components(placed(spark, sf_dir), deduplicate=False)
    return rows.select("target_id", "seq", "ord", "bom_id", "name")
