"""Extraction: P1-P3, G1-G7, A1, U-R."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import view, with_views
from catalog.registry import query
from catalog.sqltext import lit, trim_sql
from modelbom.functions.rules import RULES, Rule
from modelbom.functions.text import SKIPPED_DIRS, classify_file, plausible_id, skip_path
from modelbom.operators import extract as ex
from modelbom.operators.common import work_folder
from modelbom.sources.files import read_files

_NAME = "lower(regexp_extract(path, '[^/]*$'))"
_EXT = f"CASE WHEN contains({_NAME}, '.') THEN regexp_extract({_NAME}, '[^.]*$') END"
CLASS_SQL = f"""CASE
  WHEN {_EXT} = 'py' THEN 'python' WHEN {_EXT} = 'ipynb' THEN 'notebook'
  WHEN {_EXT} IN ('yaml','yml') THEN 'yaml' WHEN {_EXT} = 'json' THEN 'json'
  WHEN {_EXT} IN ('md','rst') THEN 'markdown' WHEN {_EXT} IN ('sh','bash','zsh') THEN 'shell'
  WHEN {_EXT} IN ('js','ts','mjs','cjs','jsx','tsx') THEN 'js'
  WHEN {_NAME} IN ('dockerfile','containerfile') OR starts_with({_NAME}, 'dockerfile.')
    OR starts_with({_NAME}, 'docker-compose') THEN 'shell'
  ELSE 'unknown' END"""
_DIRS = ", ".join(lit(d) for d in SKIPPED_DIRS)
SKIP_SQL = f"len(list_intersect(string_split(path, '/')[1:-2], [{_DIRS}])) > 0"


def plausible_sql(c: str) -> str:
    return (
        f"(strlen({c}) BETWEEN 2 AND 200 AND NOT (regexp_matches({c}, '^[0-9]+\\.[0-9]+') "
        f"AND NOT regexp_matches({c}, '[A-Za-z_-]')) AND NOT starts_with({c}, './') "
        f"AND NOT starts_with({c}, '../') AND NOT starts_with({c}, '/'))"
    )


# Lines of a text column as (line_no, line), without line ends.
def lines_cte(name: str, source: str, where: str = "TRUE") -> str:
    return f"""{name}_raw AS (
  SELECT path, string_split(content, chr(10)) AS parts FROM {source} WHERE {where}),
{name}_cut AS (
  SELECT path, CASE WHEN parts[-1] = '' THEN parts[1:len(parts)-1] ELSE parts END AS parts FROM {name}_raw),
{name}_pos AS (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS line_no FROM {name}_cut),
{name} AS (SELECT path, CAST(line_no AS INTEGER) AS line_no,
  CASE WHEN ends_with(parts[line_no], chr(13)) THEN left(parts[line_no], length(parts[line_no]) - 1)
       ELSE parts[line_no] END AS line FROM {name}_pos)"""


# Calls over several lines by running depth; source(path, cell, line_no, line).
def calls_cte(name: str, source: str) -> str:
    return f"""{name}_d AS (
  SELECT *, length(replace(line, ')', '')) - length(replace(line, '(', '')) AS delta FROM {source}),
{name}_s AS (SELECT *, sum(delta) OVER (PARTITION BY path, cell ORDER BY line_no) AS s FROM {name}_d),
{name}_m AS (SELECT *, min(s) OVER (PARTITION BY path, cell ORDER BY line_no) AS m FROM {name}_s),
{name}_e AS (SELECT *, s - least(0, m) AS depth FROM {name}_m),
{name}_g AS (
  SELECT *, coalesce(lag(depth) OVER (PARTITION BY path, cell ORDER BY line_no), 0) AS before,
         coalesce(count(*) FILTER (WHERE depth = 0) OVER (PARTITION BY path, cell ORDER BY line_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS call_no
  FROM {name}_e),
{name} AS (
  SELECT path, cell, CAST(min(line_no) AS INTEGER) AS start_line, CAST(max(line_no) AS INTEGER) AS end_line,
         string_agg({trim_sql('line')}, ' ' ORDER BY line_no) AS text
  FROM {name}_g WHERE depth > 0 OR before > 0
  GROUP BY path, cell, call_no HAVING arg_max(depth, line_no) = 0)"""


def markdown_cte(name: str, lines: str) -> str:
    t = trim_sql("line")
    return f"""{name}_f AS (
  SELECT path, max(CASE WHEN line_no = 1 AND {t} = '---' THEN 1 ELSE 0 END) AS opened,
         min(CASE WHEN line_no > 1 AND {t} IN ('---', '...') THEN line_no END) AS close
  FROM {lines} GROUP BY path),
{name} AS (
  SELECT l.path, l.line_no, l.line,
         CASE WHEN f.opened = 0 THEN 'body'
              WHEN l.line_no > 1 AND (f.close IS NULL OR l.line_no < f.close) THEN 'front'
              WHEN l.line_no > f.close THEN 'body' END AS kind
  FROM {lines} l JOIN {name}_f f USING (path))"""


def hits_sql(texts: str, rules: list[Rule]) -> str:
    """Matches of every rule; texts(path, cell, line_no, emit_line, phase, kind, text)."""
    parts = []
    for o, r in enumerate(rules):
        parts.append(
            f"SELECT path, cell, line_no, emit_line, phase, text, {o} AS rule_ord, {lit(r.method)} AS method, "
            f"regexp_extract_all(text, {lit(r.pattern)}, 1) AS ids FROM {texts} WHERE kind = {lit(r.kind)}"
        )
    union = " UNION ALL ".join(parts)
    return f"""SELECT path, cell, emit_line, phase, rule_ord, n AS match_ord, method, ids[n] AS id,
  concat(method, ' at line ', CAST(line_no AS VARCHAR), ': ', {trim_sql('text')}) AS evidence
FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS n FROM ({union})) WHERE {plausible_sql('ids[n]')}"""


_CELLS = f"""nb_json AS (
  SELECT path, content, CASE WHEN json_valid(content) THEN CAST(content AS JSON) END AS j FROM notebooks),
nb_cells AS (
  SELECT path, c AS cell, json_extract(j, '$.cells[' || (c - 1) || ']') AS cj
  FROM (SELECT path, j, unnest(range(1, CAST(coalesce(json_array_length(j, '$.cells'), 0) AS BIGINT) + 1)) AS c FROM nb_json
        WHERE j IS NOT NULL)),
nb_src AS (
  SELECT path, cell, json_extract_string(cj, '$.cell_type') AS cell_type,
         CASE json_type(cj, '$.source') WHEN 'ARRAY' THEN json_extract_string(cj, '$.source[*]')
              ELSE [json_extract_string(cj, '$.source')] END AS parts
  FROM nb_cells),
nb_split AS (
  SELECT path, cell, cell_type, flatten(list_transform(parts, lambda p: string_split(p, chr(10)))) AS parts
  FROM nb_src WHERE cell_type IN ('code', 'markdown')),
nb_broken AS (SELECT path, content FROM nb_json WHERE j IS NULL),
{lines_cte('nb_raw_lines', 'nb_broken')},
nb_lines AS (
  SELECT path, CAST(cell AS INTEGER) AS cell, cell_type, CAST(n AS INTEGER) AS line_no, parts[n] AS line
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM nb_split)
  UNION ALL SELECT path, 0, 'code', line_no, line FROM nb_raw_lines)"""


@query(
    "P1_classify_file",
    with_views("src_files") + f" SELECT path, {CLASS_SQL} AS class FROM src_files",
)
def p1(spark, sf_dir):
    return view(spark, sf_dir, "src_files").select("path", classify_file("path").alias("class"))


@query("P2_skip_path", with_views("src_files") + f" SELECT path, {SKIP_SQL} AS skipped FROM src_files")
def p2(spark, sf_dir):
    return view(spark, sf_dir, "src_files").select("path", skip_path("path").alias("skipped"))


_IDS_SQL = """SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN concat('./', p_name) WHEN 1 THEN
  CAST(p_retailprice AS VARCHAR) WHEN 2 THEN concat(CAST(p_size AS VARCHAR), '.', CAST(p_partkey AS VARCHAR))
  WHEN 3 THEN repeat(p_brand, p_size) WHEN 4 THEN left(p_name, 1) ELSE concat('3.1-', p_brand) END AS id FROM part"""


@query("P3_plausible_id", f"SELECT k, id, {plausible_sql('id')} AS plausible FROM ({_IDS_SQL})")
def p3(spark, sf_dir):
    from catalog.fixtures import register_tables

    register_tables(spark, sf_dir)
    ids = spark.sql(_IDS_SQL.replace("VARCHAR", "STRING"))
    return ids.select("k", "id", plausible_id("id").alias("plausible"))


@query(
    "G1_explode_lines",
    with_views("src_files") + ", " + lines_cte("ln", "src_files") + " SELECT path, line_no, line FROM ln",
)
def g1(spark, sf_dir):
    return ex.explode_lines(view(spark, sf_dir, "src_files"))


_TEXTS = f"""scanned AS (SELECT path, content, {CLASS_SQL} AS class FROM src_files WHERE NOT ({SKIP_SQL})),
{lines_cte('ln', 'scanned', "class NOT IN ('unknown', 'markdown')")},
{lines_cte('md', 'scanned', "class = 'markdown'")},
{markdown_cte('mdk', 'md')},
py AS (SELECT path, 0 AS cell, line_no, line FROM ln JOIN scanned USING (path) WHERE class = 'python'),
{calls_cte('calls', 'py')},
texts AS (
  SELECT path, 0 AS cell, line_no, line_no AS emit_line, 0 AS phase,
         CASE class WHEN 'python' THEN 'code' ELSE class END AS kind, line AS text
  FROM ln JOIN scanned USING (path)
  UNION ALL SELECT path, cell, start_line, end_line, 1, 'code', text FROM calls
  UNION ALL SELECT path, 0, line_no, line_no, 0, kind, line FROM mdk WHERE kind IS NOT NULL)"""
_HIT_COLUMNS = "path, emit_line, phase, method, id, evidence"


@query(
    "G2_apply_rules",
    with_views("src_files") + f", {_TEXTS} SELECT {_HIT_COLUMNS} FROM ({hits_sql('texts', RULES)})",
)
def g2(spark, sf_dir):
    return ex.scan_hits(view(spark, sf_dir, "src_files")).select(*_HIT_COLUMNS.split(", "))


@query(
    "G3_stitch_calls",
    with_views("src_files")
    + f", {lines_cte('ln', 'src_files')}, src AS (SELECT path, 0 AS cell, line_no, line FROM ln), "
    + f"{calls_cte('calls', 'src')} SELECT path, start_line, end_line, text FROM calls",
)
def g3(spark, sf_dir):
    return ex.stitch_calls(view(spark, sf_dir, "src_files"))


@query(
    "S1_read_files",
    """SELECT concat('source=', source) AS folder, 'json' AS class, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars
    FROM documents GROUP BY source""",
)
def s1(spark, sf_dir):
    """A tree of real files: the documents as JSON lines in a folder per source, read back whole."""
    fx.register_tables(spark, sf_dir, "documents")
    root = work_folder(spark, "tree")
    spark.table("documents").select("source", "text").write.partitionBy("source").json(root)
    files = read_files(spark, root)
    lines = ex.explode_lines(files.select("path", "content"))
    text = F.get_json_object("line", "$.text")
    both = lines.join(files.select("path", "class"), "path").select(
        F.split("path", "/")[0].alias("folder"), "class", F.length(text).alias("n")
    )
    return both.groupBy("folder", "class").agg(F.count("*").alias("lines"), F.sum("n").cast("bigint").alias("chars"))


@query("G4_explode_notebook", with_views("notebooks") + f", {_CELLS} SELECT * FROM nb_lines")
def g4(spark, sf_dir):
    return ex.explode_notebook(view(spark, sf_dir, "notebooks"))


_NB_TEXTS = f"""{_CELLS},
nb_code AS (SELECT path, cell, line_no, line FROM nb_lines WHERE cell_type = 'code'),
{calls_cte('nb_calls', 'nb_code')},
texts AS (
  SELECT path, cell, line_no, line_no AS emit_line, 0 AS phase,
         CASE cell_type WHEN 'code' THEN 'code' ELSE 'front' END AS kind, line AS text FROM nb_lines
  UNION ALL SELECT path, cell, start_line, end_line, 1, 'code', text FROM nb_calls)"""


@query(
    "G4_notebook_hits",
    with_views("notebooks")
    + f", {_NB_TEXTS} SELECT cell, {_HIT_COLUMNS} FROM ({hits_sql('texts', RULES)})",
)
def g4_hits(spark, sf_dir):
    hits = ex.scan_hits(view(spark, sf_dir, "notebooks"))
    return hits.select("cell", *_HIT_COLUMNS.split(", "))


@query(
    "G5_markdown_lines",
    with_views("src_files")
    + f", scanned AS (SELECT path, content FROM src_files WHERE {CLASS_SQL} = 'markdown'), "
    + f"{lines_cte('md', 'scanned')}, {markdown_cte('mdk', 'md')} "
    + "SELECT path, line_no, kind, line FROM mdk WHERE kind IS NOT NULL",
)
def g5(spark, sf_dir):
    files = view(spark, sf_dir, "src_files")
    return ex.markdown_lines(files.where(classify_file("path") == "markdown"))


_CLASS_TEXTS = f"""scanned AS (SELECT path, content, {CLASS_SQL} AS class FROM src_files
  WHERE {CLASS_SQL} IN ('yaml', 'json', 'shell', 'js')),
{lines_cte('ln', 'scanned')},
texts AS (SELECT path, 0 AS cell, line_no, line_no AS emit_line, 0 AS phase, class AS kind, line AS text
  FROM ln JOIN scanned USING (path))"""


@query(
    "G6_scan_line_class",
    with_views("src_files") + f", {_CLASS_TEXTS} SELECT {_HIT_COLUMNS} FROM ({hits_sql('texts', RULES)})",
)
def g6(spark, sf_dir):
    files = view(spark, sf_dir, "src_files").withColumn("class", classify_file("path"))
    lined = files.where(F.col("class").isin("yaml", "json", "shell", "js"))
    return ex.apply_rules(ex.match_texts(lined)).select(*_HIT_COLUMNS.split(", "))


def dedupe_sql(hits: str) -> str:
    order = "path, cell, emit_line, phase, rule_ord, match_ord"
    return f"""SELECT id, id AS name, 'model' AS type, first(path ORDER BY {order}) AS path, first(method ORDER BY {order}) AS method,
  count(DISTINCT evidence) AS evidence_texts, CAST(sum(length(evidence)) FILTER (rn = 1) AS BIGINT) AS evidence_chars
FROM (SELECT *, row_number() OVER (PARTITION BY id, evidence ORDER BY {order}) AS rn FROM {hits}) GROUP BY id"""


def evidence_sql(hits: str) -> str:
    order = "path, cell, emit_line, phase, rule_ord, match_ord"
    return f"""SELECT id, evidence, path, cell, emit_line, method FROM (SELECT *, row_number() OVER (PARTITION BY id, evidence ORDER BY {order}) AS rn
FROM {hits}) WHERE rn = 1"""


def joined_sql(hits: str) -> str:
    order = "path, cell, emit_line, phase, rule_ord, match_ord"
    return f"""SELECT id, list_reduce(list(evidence ORDER BY {order}),
    lambda acc, x: CASE WHEN contains(acc, x) THEN acc ELSE concat(acc, '. ', x) END) AS evidence FROM {hits} GROUP BY id"""


_DISCOVERY = ["id", "name", "type", "path", "method", "evidence_texts", "evidence_chars"]
_EVIDENCE = ["id", "evidence", "at.path", "at.cell", "at.emit_line", "at.method"]
DISCOVERIES_CTE = f"{_TEXTS}, hits AS ({hits_sql('texts', RULES)}), discoveries AS ({dedupe_sql('hits')})"


@query(
    "A1_dedupe_discoveries",
    with_views("notebooks") + f", {_NB_TEXTS}, hits AS ({hits_sql('texts', RULES)}) {dedupe_sql('hits')}",
)
def a1(spark, sf_dir):
    hits = ex.scan_hits(view(spark, sf_dir, "notebooks"))
    return ex.dedupe_discoveries(hits).select(*_DISCOVERY)


@query(
    "A1_evidence_rows",
    with_views("src_files") + f", {_TEXTS}, hits AS ({hits_sql('texts', RULES)}) {evidence_sql('hits')}",
)
def a1_evidence(spark, sf_dir):
    return ex.evidence_rows(ex.scan_hits(view(spark, sf_dir, "src_files"))).select(*_EVIDENCE)


@query(
    "A1_joined_evidence",
    with_views("notebooks") + f", {_NB_TEXTS}, hits AS ({hits_sql('texts', RULES)}) {joined_sql('hits')}",
)
def a1_joined(spark, sf_dir):
    hits = ex.scan_hits(view(spark, sf_dir, "notebooks"))
    return ex.joined_evidence(ex.evidence_rows(hits)).select("id", "evidence")


@query("G7_scan_references", with_views("src_files") + f", {DISCOVERIES_CTE} SELECT * FROM discoveries")
def g7(spark, sf_dir):
    return ex.scan_references(view(spark, sf_dir, "src_files")).select(*_DISCOVERY)


# Rules of a caller: prose words before a colon, in Markdown bodies, with no trigger given.
CUSTOM_RULES = [
    Rule("body", "word_colon", r"\b([A-Za-z][a-z]+)\s*:"),
    Rule("body", "sentence_start", r"\. ([A-Z][a-z]+)", r"\. "),
]


@query(
    "UR_custom_rules",
    with_views("src_files") + f", {_TEXTS} SELECT {_HIT_COLUMNS} FROM ({hits_sql('texts', CUSTOM_RULES)})",
)
def custom_rules(spark, sf_dir):
    files = view(spark, sf_dir, "src_files")
    return ex.scan_hits(files, CUSTOM_RULES).select(*_HIT_COLUMNS.split(", "))
