"""Views derived from the test tables, in SQL that runs unchanged on Spark and DuckDB."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelbom import schemas as sc

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}
STORED_LIKE = {"src_files", "notebooks", "cards", "comp_flat"}
#: Views of long rows over a narrow table, which is dealt over all tasks; filters on them are rewritten as on any view.
DEALT = {"hub_datasets"}

# One id in three is the same hot one. The rest are shared by four neighbouring parts.
_IDS = """
  SELECT p_partkey AS k,
         CASE WHEN p_partkey % 3 = 0 THEN 'hot-org/hot-model'
              ELSE concat(lower(replace(p_brand, '#', '-')), '/', replace(p_name, ' ', '-'), '-',
                          CAST(CAST(floor(p_partkey / 4.0) AS BIGINT) AS STRING)) END AS id,
         concat(replace(p_name, ' ', '-'), '-', CAST(CAST(floor(p_partkey / 4.0) AS BIGINT) AS STRING)) AS nm
  FROM part"""

VIEWS["src_files"] = f"""
WITH p AS ({_IDS})
SELECT concat('repo', CAST(k % 20 AS STRING), CASE WHEN k % 9 = 8 THEN '/node_modules/' ELSE '/src/' END,
              'f', CAST(k AS STRING),
              CASE k % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.yaml' WHEN 2 THEN '.json' WHEN 3 THEN '.md'
                         WHEN 4 THEN '.sh' WHEN 5 THEN '.ts' WHEN 6 THEN '.txt' ELSE '/Dockerfile.gpu' END) AS path,
       CASE k % 8
         WHEN 0 THEN concat('import x', chr(10), 'm = AutoModel.from_pretrained("', id, '")', chr(10),
                            'p = pipeline(', chr(10), '    "task",', chr(10), '    model="', nm, '",', chr(10), ')', chr(10),
                            'x = y) + hf_hub_download("', id, '", filename="f")', chr(13), chr(10),
                            'c = InferenceClient(', chr(10), chr(9), 'model = ''', id, ''')', chr(10),
                            'e = evaluate.load("', id, '"); v = "1.0"; AutoModel.from_pretrained("3.14")', chr(10), chr(10),
                            'open(', chr(10), 'SentenceTransformer("', nm, '"')
         WHEN 1 THEN concat('base_model: ', id, '  # base', chr(10), 'model_type: ', nm, chr(10), '  repo_id : "', id, '"', chr(10))
         WHEN 2 THEN concat('{{', chr(10), '  "_name_or_path": "', nm, '",', chr(10), '  "base_model": "', id, '"', chr(10), '}}')
         WHEN 3 THEN concat('---', chr(10), 'base_model: ', id, chr(10), 'other: ', id, chr(10), '---', chr(10),
                            'See ', id, '. Version 1.0/2.0', chr(10), 'at https://huggingface.co/', id, ' or a.b/c-', chr(10))
         WHEN 4 THEN concat('huggingface-cli download "', id, '"', chr(10), 'export HF_MODEL=', id, chr(10))
         WHEN 7 THEN concat('FROM x', chr(10), 'ENV MODEL_NAME=', id, ' MODEL_ID="', id, '"', chr(10))
         ELSE concat('const c = await pipeline("t", "', id, '");', chr(10), 'run({{ model: "', id, '" }});', chr(10)) END AS content
FROM p
UNION ALL
SELECT concat('docs/', source, '/d', CAST(doc_id AS STRING), CASE WHEN doc_id % 4 = 3 THEN '.rst' ELSE '.md' END),
       concat(CASE doc_id % 3 WHEN 0 THEN concat('---', chr(10), 'model: hot-org/hot-model', chr(10), '...', chr(10))
                              WHEN 1 THEN concat('---', chr(10), 'model_id: doc-org/m', CAST(doc_id AS STRING), chr(10))
                              ELSE '' END,
              text, chr(10), 'Built on doc-org/m', CAST(doc_id % 50 AS STRING), '.')
FROM documents
""".replace("{{", "{").replace("}}", "}")

VIEWS["notebooks"] = f"""
WITH p AS ({_IDS})
SELECT concat('nb/', CAST(k AS STRING), '.ipynb') AS path,
       replace(CASE k % 5
         WHEN 0 THEN concat('{{"cells":[{{"cell_type":"code","source":["x = pipeline(~n","  ~"t~",~n","  model=~"', nm, '~")~n"]}}]}}')
         WHEN 1 THEN concat('{{"cells":[{{"cell_type":"code","source":"AutoModel.from_pretrained(~"', id, '~")"}},{{"cell_type":"raw","source":"x"}}]}}')
         WHEN 2 THEN concat('{{"cells":[{{"cell_type":"markdown","source":["# t~n","model: ', id, '~n"]}},{{"cell_type":"code","source":"f(~n~n g(~"', id, '~"),~n model=~"', id, '~")"}}],"nbformat":4}}')
         WHEN 3 THEN concat('{{"cells":null,"x":"', nm, '"}}')
         ELSE concat('broken AutoModel.from_pretrained("', id, '")') END, '~', chr(92)) AS content
FROM p
""".replace("{{", "{").replace("}}", "}")

# One row per model id. Card data comes as JSON text in several shapes.
VIEWS["hub_models"] = f"""
WITH p AS ({_IDS}), g AS (
  SELECT id, min(k) + 1 AS pk, CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS downloads FROM p GROUP BY id)
SELECT id, pk, CASE WHEN pk % 7 = 0 THEN concat('  ', id) WHEN pk % 7 = 1 THEN concat('plain-', CAST(pk AS STRING)) END AS model_id,
       CASE WHEN pk % 4 <> 0 THEN concat('author ', CAST(pk % 9 AS STRING)) WHEN pk % 8 = 0 THEN '  ' END AS author,
       CASE WHEN pk % 3 <> 0 THEN 'text-generation' END AS pipeline_tag,
       CASE WHEN pk % 6 <> 0 THEN 'transformers ' END AS library_name,
       CASE WHEN pk % 5 <> 0 THEN concat(upper(md5(id)), ' ') END AS sha,
       downloads, pk % 50 AS likes, pk % 2 = 0 AS private, CAST((pk % 4) * 1000 AS BIGINT) AS used_storage,
       CASE WHEN pk % 3 = 0 THEN '2024-01-15T10:30:00.000Z' END AS last_modified,
       CASE WHEN pk % 4 = 1 THEN '2023-06-01T08:00:00.000Z' ELSE '' END AS created_at,
       CASE WHEN pk % 5 = 1 THEN 'llama' END AS model_type,
       CASE WHEN pk % 5 < 2 THEN concat(' Arch', CAST(pk % 3 AS STRING), ',Other') END AS architectures_csv,
       CASE pk % 3 WHEN 0 THEN ' transformers, license:mit ,nlp,nlp,,dataset:nation_3' WHEN 1 THEN 'nlp' END AS tags_csv,
       CASE pk % 5 WHEN 0 THEN concat('{{"license":" apache-2.0","language":["en"," fr ",7],"datasets":["ds-org/', CAST(pk % 120 AS STRING), '","ds-org/1",3,"ds-org/1"]}}')
                   WHEN 1 THEN concat('{{"language":"en ","datasets":"ds-org/', CAST(pk % 120 AS STRING), '","license":["x"]}}')
                   WHEN 2 THEN '{{}}'
                   WHEN 3 THEN '{{"license":"","model-index":[{{"results":[{{"task":{{"type":" qa ","name":"Q"}},"metrics":[{{"type":"acc","value":0.5}},{{"type":"","value":""}},"x",{{"type":"f1"}},{{"value":"high"}}]}}]}}],"datasets":["a:b"," ","ds-org/2"]}}'
                   END AS card_json,
       CASE pk % 4 WHEN 0 THEN 'false' WHEN 1 THEN '" auto "' WHEN 2 THEN 'true' ELSE 'null' END AS gated_json,
       CASE WHEN pk % 13 = 0 THEN 404 WHEN pk % 17 = 0 THEN 401 WHEN pk % 23 = 0 THEN 403 WHEN pk % 19 = 0 THEN 500 ELSE 200 END AS api_status
FROM g
""".replace("{{", "{").replace("}}", "}")

VIEWS["hub_datasets"] = """
SELECT concat('ds-org/', CAST(s_suppkey AS STRING)) AS id,
       CASE WHEN s_suppkey % 2 = 0 THEN n_name END AS author, md5(s_name) AS sha,
       CASE WHEN s_suppkey % 3 <> 0 THEN concat('About ', s_name) END AS description,
       CASE WHEN s_suppkey % 4 <> 0 THEN '2024-01-15T10:30:00.000Z' END AS last_modified,
       CASE WHEN s_suppkey % 5 <> 0 THEN '2022-01-01' END AS created_at,
       CAST((s_suppkey % 3) * 1000 AS BIGINT) AS used_storage,
       CASE WHEN s_suppkey % 2 = 1 THEN ' text , text,en' END AS tags_csv,
       CASE s_suppkey % 3
         WHEN 0 THEN '{"license":"cc0-1.0","task_categories":["text-classification"],"tags":["a",3,"b"],"configs":[{"config_name":"main","data_files":[{"split":"train","path":"a.csv"},{"split":"","path":""},"x"]},{"config_name":""},{"config_name":"e"}]}'
         WHEN 1 THEN '{"license":7,"task_categories":[1],"tags":"a","configs":"none"}'
         ELSE '{"configs":[{"data_files":[{"path":"only.csv"}]},5]}' END AS card_json
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

# A third of all entries belong to the hot repository.
VIEWS["security_flat"] = f"""
WITH p AS ({_IDS})
SELECT CASE WHEN event_id % 10 = 9 THEN 'dataset' ELSE 'model' END AS kind,
       CASE WHEN event_id % 10 = 9 THEN concat('ds-org/', CAST(user_id AS STRING)) ELSE id END AS repo_id,
       event_id, CAST(event_id % 12 AS INT) AS page,
       concat('dir ', CAST(event_id % 7 AS STRING), '/w"', CAST(event_id AS STRING), '.bin') AS path,
       CASE WHEN event_id % 11 = 0 THEN NULL
            WHEN user_id % 3 = 1 AND event_type IN ('error', 'click') THEN 'suspicious'
            WHEN event_type = 'error' THEN 'unsafe' WHEN event_type = 'click' THEN 'Caution'
            WHEN event_type = 'purchase' THEN 'suspicious' WHEN event_type = 'view' THEN 'safe' ELSE 'unscanned' END AS status,
       CASE WHEN event_id % 2 = 0 THEN 'unsafe' ELSE 'Safe' END AS av_status,
       CASE event_id % 3 WHEN 0 THEN 'suspicious' WHEN 1 THEN 'caution' ELSE '' END AS pickle_status,
       CASE event_id % 4 WHEN 0 THEN 'odd' WHEN 1 THEN 'unscanned' END AS vt_status,
       CASE WHEN event_id % 5 = 0 THEN 'found it' ELSE '' END AS av_message,
       CASE WHEN event_id % 4 = 0 THEN concat('https://example.com/r/', CAST(event_id AS STRING)) ELSE '' END AS av_link,
       CASE WHEN event_id % 8 = 0 THEN 'Report' ELSE '' END AS av_label,
       CASE WHEN event_id % 6 < 3 THEN 'os.system:dangerous,re.match:safe' END AS imports_csv
FROM events JOIN p ON p.k = user_id
"""

# Many BOMs: one model per customer, data components from orders, a third of them in one BOM.
_PROPS = "concat_ws('|', " + ", ".join(
    f"CASE WHEN (k + {i}) % {2 + i % 4} = 0 THEN '{n}={v}' END"
    for i, (n, v) in enumerate([
        ("huggingface:lastModified", "2024"), ("huggingface:createdAt", " "), ("huggingface:language", "en"),
        ("huggingface:usedStorage", "9"), (" huggingface:private ", "false"), ("huggingface:libraryName", "t"),
        ("huggingface:downloads", "1"), ("huggingface:likes", "2"), ("huggingface:baseModel", "b"),
        ("huggingface:modelCardContact", "c"), ("huggingface:security:overallStatus", "safe"),
        ("huggingface:security:scannedFileCount", "3"), ("huggingface:security:unsafeFileCount", "0"),
        ("huggingface:datasetContact", "me"),
    ])
) + ")"
VIEWS["comp_flat"] = f"""
WITH b AS (
  SELECT concat('bom-', CAST(c_custkey AS STRING)) AS bom_id, CAST(0 AS BIGINT) AS ord, true AS is_metadata, c_custkey AS k,
         CASE WHEN c_custkey % 11 = 0 THEN 'application' ELSE 'machine-learning-model' END AS type,
         CASE WHEN c_custkey % 7 <> 0 THEN concat('model/', CAST(c_custkey % 200 AS STRING)) END AS bom_ref,
         CASE WHEN c_custkey % 17 = 0 THEN ' ' WHEN c_custkey % 19 = 0 THEN ''
              ELSE concat(lower(c_mktsegment), '/', replace(c_name, '#', '-')) END AS name,
         CASE c_custkey % 3 WHEN 0 THEN concat('pkg:huggingface/', lower(c_mktsegment), '/', c_name, '@AB')
              WHEN 1 THEN 'pkg:npm/x' END AS purl
  FROM customer
  UNION ALL
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'bom-1' ELSE concat('bom-', CAST(o_custkey AS STRING)) END, o_orderkey + 1, false, o_orderkey,
         CASE WHEN o_orderkey % 5 = 0 THEN 'library' WHEN o_orderkey % 23 = 0 THEN 'machine-learning-model' ELSE 'data' END,
         CASE WHEN o_orderkey % 7 <> 0 THEN concat('data/', CAST(o_orderkey % 500 AS STRING)) WHEN o_orderkey % 2 = 0 THEN '' END,
         CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE concat('datasets/ds-org/', CAST(CAST(floor(o_orderkey / 20.0) AS BIGINT) AS STRING)) END,
         CASE o_orderkey % 4 WHEN 0 THEN concat('pkg:huggingface/datasets/ds-org/', CAST(CAST(floor(o_orderkey / 25.0) AS BIGINT) AS STRING), '@abc')
              WHEN 1 THEN 'pkg:huggingface/single' WHEN 2 THEN 'pkg:huggingface/datasets/' END
  FROM orders)
SELECT *, CASE WHEN k % 2 = 0 THEN CAST(k % 3 AS STRING) END AS version,
       CASE WHEN k % 3 = 0 THEN 'mit' END AS license, CASE WHEN k % 4 < 2 THEN 'ABC ' END AS sha,
       CASE k % 4 WHEN 0 THEN 'Acme' WHEN 1 THEN ' ' END AS author, CASE WHEN k % 5 < 3 THEN 'grp' END AS grp,
       CASE k % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN 'x,lastModified:2024' END AS tags_csv,
       CASE WHEN k % 6 < 3 THEN concat('https://example.com/', CAST(k AS STRING)) END AS url,
       {_PROPS} AS props_csv,
       k % 9 <> 0 AS has_card, CASE WHEN k % 3 <> 2 THEN 'qa' END AS task, CASE WHEN k % 4 = 1 THEN 'bert' END AS family,
       CASE WHEN k % 5 = 1 THEN 'Bert' WHEN k % 5 = 2 THEN ' ' END AS arch,
       CASE k % 4 WHEN 0 THEN 'dataset:a,dataset:b' WHEN 1 THEN ' ' WHEN 2 THEN '' END AS datasets_csv,
       CASE WHEN k % 3 = 1 THEN 'use it' END AS use_case, CASE WHEN k % 5 = 3 THEN 'limits' END AS limitation,
       CASE WHEN k % 6 = 3 THEN 'bias' END AS ethic, CASE WHEN k % 7 = 3 THEN 'f1' END AS metric,
       CASE WHEN k % 8 = 3 THEN 'GPU' END AS hardware,
       CASE WHEN k % 2 = 1 THEN 'text' WHEN k % 3 = 0 THEN ' ' END AS description, CASE WHEN k % 3 = 1 THEN 'pii' END AS sensitive,
       CASE WHEN k % 4 = 2 THEN 'tabular' END AS classification, CASE WHEN k % 5 = 4 THEN 'Owner' END AS custodian,
       CASE WHEN k % 6 = 5 THEN 'config:a' END AS attachment
FROM b
"""

VIEWS["bom_rows"] = """
SELECT concat('bom-', CAST(c_custkey AS STRING)) AS bom_id, c_custkey AS k,
       CASE c_custkey % 9 WHEN 7 THEN '1.7' WHEN 8 THEN NULL ELSE concat('1.', CAST(c_custkey % 9 AS STRING)) END AS spec_version,
       CASE WHEN c_custkey % 4 = 0 THEN 'CycloneDX' END AS bom_format, concat('urn:uuid:', CAST(c_custkey AS STRING)) AS serial_number,
       CAST(1 AS BIGINT) AS version, CASE WHEN c_custkey % 3 = 1 THEN concat('2024-01-0', CAST(c_custkey % 9 AS STRING)) WHEN c_custkey % 3 = 2 THEN '' END AS timestamp
FROM customer
UNION ALL
SELECT concat('empty-', CAST(s_suppkey AS STRING)), s_suppkey, '1.6', 'CycloneDX', NULL, CAST(1 AS BIGINT), NULL FROM supplier
"""

# Which BOMs are merged: a third of them go into one target. The smallest key is the base.
_TARGETS = """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'app-hot' ELSE concat('app-', CAST(c_custkey % 40 AS STRING)) END AS target_id,
         c_custkey AS k, concat('bom-', CAST(c_custkey AS STRING)) AS bom_id FROM customer"""
VIEWS["members"] = f"""
SELECT m.target_id, CASE WHEN m.k = b.base THEN 0 ELSE m.k + 1 END AS seq, m.bom_id
FROM ({_TARGETS}) m JOIN (SELECT target_id, min(k) AS base FROM ({_TARGETS}) t GROUP BY target_id) b ON b.target_id = m.target_id
"""

VIEWS["dep_rows"] = """
SELECT concat('bom-', CAST(l_orderkey % 100 + 1 AS STRING)) AS bom_id, l_orderkey AS ord,
       CASE WHEN l_orderkey % 3 = 0 THEN 'order/hot' ELSE concat('order/', CAST(l_orderkey AS STRING)) END AS ref,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS pos,
       concat('part/', CAST(l_partkey % 40 AS STRING)) AS depends_on
FROM lineitem
UNION ALL
SELECT concat('bom-', CAST(s_suppkey AS STRING)), s_suppkey + 100000000, concat('supp/', CAST(s_suppkey % 50 AS STRING)),
       CAST(NULL AS BIGINT), CAST(NULL AS STRING) FROM supplier
UNION ALL
SELECT concat('bom-', CAST(s_suppkey AS STRING)), s_suppkey + 200000000, concat('order/', CAST(s_suppkey AS STRING)),
       CAST(NULL AS BIGINT), CAST(NULL AS STRING) FROM supplier
"""

_TOOL_ROWS = " UNION ALL ".join(f"SELECT c_custkey, c_mktsegment, {n} AS n FROM customer" for n in (0, 1, 2, 5))
VIEWS["tools"] = f"""
SELECT concat('bom-', CAST(c_custkey AS STRING)) AS bom_id, CAST(n AS BIGINT) AS ord, (c_custkey + n) % 4 = 0 AS legacy,
       CASE WHEN (c_custkey + n) % 4 <> 0 THEN 'application' END AS type,
       CASE WHEN (c_custkey + n) % 4 = 0 AND c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN '' END AS vendor,
       CASE WHEN (c_custkey + n) % 4 <> 0 AND c_custkey % 5 = 0 THEN c_mktsegment END AS manufacturer,
       concat('tool-', CAST((c_custkey * 3 + n) % 11 AS STRING)) AS name,
       CASE WHEN n % 3 <> 0 THEN CAST(c_custkey % 2 AS STRING) END AS version
FROM ({_TOOL_ROWS}) r
"""

VIEWS["services"] = """
SELECT concat('bom-', CAST(o_custkey AS STRING)) AS bom_id, o_orderkey AS ord,
       CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('svc/', CAST(o_orderkey % 20 AS STRING)) END AS bom_ref,
       o_orderpriority AS name, CAST(o_orderkey % 3 AS STRING) AS version
FROM orders
"""

VIEWS["ext_refs"] = """
SELECT concat('bom-', CAST(s_suppkey AS STRING)) AS bom_id, CAST(0 AS BIGINT) AS ord, 'website' AS type,
       concat('https://example.com/', CAST(s_suppkey % 5 AS STRING)) AS url FROM supplier
UNION ALL
SELECT concat('bom-', CAST(p_partkey AS STRING)), p_partkey, 'vcs', p_name FROM part
"""

_NL = "chr(10)"
VIEWS["cards"] = f"""
SELECT doc_id, concat(
  CASE WHEN doc_id % 10 = 7 THEN '' ELSE concat(CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE '' END, '---', {_NL},
    'license: ', CASE doc_id % 4 WHEN 0 THEN 'mit' WHEN 1 THEN '"apache-2.0"' WHEN 2 THEN '''cc0-1.0'' # note' ELSE '' END, {_NL},
    'tags:', {_NL}, '  - ', lang, {_NL}, '  - ''', source, '''', {_NL}, '- ', lang, {_NL},
    'datasets: ', CASE WHEN doc_id % 2 = 0 THEN concat('[ds-org/', CAST(doc_id % 50 AS STRING), ', "ds-org/1", ds-org/1]') ELSE 'ds-org/3' END, {_NL},
    CASE WHEN doc_id % 3 = 0 THEN concat('metrics:', {_NL}, '- f1  # main', {_NL}, '- acc', {_NL}) ELSE '' END,
    'base_model: org/base-', CAST(doc_id AS STRING), {_NL}, 'language: en', {_NL},
    'annotations_creators:', {_NL}, '- crowd', CAST(doc_id % 7 AS STRING), {_NL}, '- expert', {_NL},
    CASE WHEN doc_id % 6 = 0 THEN concat('extra:', {_NL}, '  nested: 1', {_NL}) ELSE '' END,
    '---', {_NL}) END,
  '# Card', {_NL}, '- **Developed by:** ', source, {_NL},
  '- **Paper [optional]:** https://example.com/', CAST(doc_id AS STRING), {_NL},
  '- **Demo:**', {_NL}, CASE WHEN doc_id % 2 = 0 THEN concat('https://demo/', CAST(doc_id AS STRING)) ELSE '' END, {_NL},
  '- **Carbon Emitted** *(est.)*: ', CAST(n_chars AS STRING), ' g', chr(13), {_NL},
  '- **Curated by:** ', lang, {_NL}, '- **Funded by [optional]:**   F', CAST(doc_id % 3 AS STRING), chr(9), {_NL},
  CASE WHEN doc_id % 3 = 0 THEN '## Direct Use' ELSE '#### Direct Use' END, {_NL}, {_NL}, text, {_NL}, {_NL},
  CASE WHEN doc_id % 4 = 0 THEN concat('### Out-of-Scope Use  ', {_NL}, 'none', {_NL}) ELSE '' END,
  '## Bias, Risks, and Limitations', {_NL}, CASE WHEN doc_id % 5 = 0 THEN text ELSE '' END, {_NL},
  '### Recommendations', {_NL}, 'read', {_NL}, '## Metrics', {_NL}, CASE WHEN doc_id % 2 = 0 THEN 'm' ELSE ' ' END, {_NL},
  '#not a heading', {_NL}, '## Dataset Description', {_NL}, text, {_NL}, '## Model Card Contact', {_NL}, 'me', CAST(doc_id AS STRING), {_NL},
  '## Dataset Card Contact', {_NL}, 'you', {_NL}, '##', {_NL}, 'end') AS raw
FROM documents
"""

VIEWS["user_values"] = """
SELECT c_custkey, CASE c_custkey % 9
         WHEN 0 THEN concat(' ', lower(c_mktsegment), ' , ,nlp,', chr(9), 'nlp') WHEN 1 THEN 'accuracy:0.95, f1 ,:3,a:b:c'
         WHEN 2 THEN 'Custodian:A,curated:B,fundedby:C,custodian:D,none:E,owner:' WHEN 3 THEN 'hours:10,empty:,x,:y'
         WHEN 4 THEN concat('  ', chr(160), chr(9)) WHEN 5 THEN ',,' WHEN 6 THEN concat(c_name, chr(32)) WHEN 7 THEN 'none:x'
         ELSE concat('dataset:', c_name, ', org/', CAST(c_custkey AS STRING)) END AS value
FROM customer
"""

VIEWS["fetch_log"] = f"""
WITH p AS ({_IDS})
SELECT id, event_id AS seq,
       CASE event_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'readme' WHEN 2 THEN 'tree' ELSE 'complete' END AS stage,
       CASE WHEN user_id % 3 = 0 THEN 200 ELSE CASE event_type WHEN 'error' THEN CASE WHEN user_id % 5 = 0 THEN 500 ELSE 200 END
            WHEN 'signup' THEN CASE WHEN user_id % 4 < 2 THEN 404 ELSE 200 END
            WHEN 'click' THEN CASE WHEN user_id % 7 < 3 THEN 401 ELSE 200 END ELSE 200 END END AS status
FROM events JOIN p ON p.k = user_id
"""


_REGISTERED: dict[str, tuple] = {}


def register_tables(spark: SparkSession, sf_dir: str, sql: str | None = None) -> None:
    """Temporary views of the test tables (only those a SQL text names)."""
    for t in TABLES:
        if sql is not None and not re.search(rf"\b{t}\b", sql):
            continue
        path = os.path.join(sf_dir, f"{t}.parquet")
        here = (spark.sparkContext.applicationId, id(spark), path)
        if _REGISTERED.get(t) == here and spark.catalog.tableExists(t):
            continue
        if os.path.exists(path) or "://" in sf_dir:
            spark.read.parquet(path).createOrReplaceTempView(t)
            _REGISTERED[t] = here


def _over_dealt_tables(spark: SparkSession, sql: str) -> str:
    """``sql`` over tables whose rows are dealt over all tasks.

    Rows of few bytes stand for long work, and a split of a file holds very many of them: read as they lie, the models of
    the largest table would be one task. So may the texts of ``documents`` be, that lie in one row group: its splits by
    bytes are then many, but all rows in one of them. Tables are dealt, four tasks a core, before the views' wide columns are made.
    """
    width = spark.sparkContext.defaultParallelism
    for t in ("customer", "orders", "part", "supplier", "documents"):
        if not re.search(rf"\bFROM {t}\b", sql):
            continue
        df = spark.table(t).select(*[c for c in spark.table(t).columns if re.search(rf"\b{c}\b", sql)])
        df.repartition(4 * width).createOrReplaceTempView(f"{t}_dealt")
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {t}_dealt", sql)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as DataFrame over the tables of ``sf_dir``.

    Long computed texts pass through ``inline`` so that filters on them are not rewritten into
    filters on the whole text expression, as they would not be on a stored table.
    """
    sql = VIEWS[name]
    register_tables(spark, sf_dir, sql)
    if name not in STORED_LIKE | DEALT:
        return spark.sql(sql)
    if name in DEALT:
        return spark.sql(_over_dealt_tables(spark, sql))
    df = spark.sql(_over_dealt_tables(spark, sql))
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def with_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for oracle SQL."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


# ---- typed rows from the flat views (Spark side) ----------------------------------------


def hub_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "hub_models")
    return df.select(
        "*",
        F.split("tags_csv", ",").alias("tags"),
        F.split("architectures_csv", ",").alias("architectures"),
        F.try_parse_json("card_json").alias("card_data"),
    )


def hub_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "hub_datasets")
    return df.select("*", F.split("tags_csv", ",").alias("tags"), F.try_parse_json("card_json").alias("card_data"))


def security_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "security_flat")
    none = F.lit(None).cast("string")

    def scanner(status, message=none, link=none, label=none):
        return F.struct(
            status.alias("status"), message.alias("message"), link.alias("reportLink"), label.alias("reportLabel")
        )

    def imported(t):
        full = F.substring_index(t, ":", 1)
        return F.struct(
            F.substring_index(full, ".", 1).alias("module"),
            F.substring_index(full, ".", -1).alias("name"),
            F.substring_index(t, ":", -1).alias("safety"),
        )

    file_status = F.struct(
        F.col("status").alias("status"),
        scanner(none).alias("protectAiScan"),
        scanner(F.col("av_status"), F.col("av_message"), F.col("av_link"), F.col("av_label")).alias("avScan"),
        F.struct(
            F.col("pickle_status").alias("status"),
            F.transform(F.split("imports_csv", ","), imported).alias("pickleImports"),
            none.alias("message"), none.alias("version"),
        ).alias("pickleImportScan"),
        scanner(F.col("vt_status"), F.col("vt_status")).alias("virusTotalScan"),
        scanner(none).alias("jFrogScan"),
    )
    return df.select(
        "kind", "repo_id", "page", "path", F.when(F.col("status").isNotNull(), file_status).alias("securityFileStatus")
    )


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """comp_flat as component rows."""
    c = F.col

    def when_set(name, value):
        return F.when(c(name).isNotNull(), value)

    def pair(a, x, b, y):
        return F.struct(x.alias(a), y.alias(b))

    none = F.lit(None).cast("string")
    props = F.transform(
        F.split(F.nullif("props_csv", F.lit("")), "[|]"),
        lambda p: pair("name", F.substring_index(p, "=", 1), "value", F.substring_index(p, "=", -1)),
    )
    parameters = F.struct(
        c("task").alias("task"), c("family").alias("architectureFamily"), c("arch").alias("modelArchitecture"),
        F.transform(F.split("datasets_csv", ","), lambda d: F.struct(d.alias("ref"))).alias("datasets"),
    )
    card = F.struct(
        F.when(F.coalesce("task", "family", "arch", "datasets_csv").isNotNull(), parameters).alias("modelParameters"),
        when_set("metric", F.struct(F.array(pair("type", c("metric"), "value", F.lit("1"))).alias("performanceMetrics"))).alias("quantitativeAnalysis"),
        F.struct(
            when_set("use_case", F.array("use_case")).alias("useCases"),
            when_set("limitation", F.array("limitation")).alias("technicalLimitations"),
            when_set("ethic", F.array(pair("name", c("ethic"), "mitigationStrategy", F.lit("")))).alias("ethicalConsiderations"),
            when_set("hardware", F.struct(F.array(pair("name", F.lit("hardwareType"), "value", c("hardware"))).alias("properties"))).alias("environmentalConsiderations"),
        ).alias("considerations"),
    )
    party = F.array(F.struct(F.struct(c("custodian").alias("name")).alias("organization")))
    nobody = F.lit(None).cast(f"array<{sc.PARTY}>")
    data = F.struct(
        F.lit("dataset").alias("type"), c("description").alias("description"),
        when_set("attachment", F.struct(pair("contentType", F.lit("text/plain"), "content", c("attachment")).alias("attachment"))).alias("contents"),
        c("classification").alias("classification"), when_set("sensitive", F.array("sensitive")).alias("sensitiveData"),
        when_set("custodian", F.struct(party.alias("custodians"), nobody.alias("stewards"), nobody.alias("owners"))).alias("governance"),
    )
    values = {
        "bom_ref": c("bom_ref"), "type": c("type"), "name": c("name"), "version": c("version"), "group": c("grp"),
        "purl": c("purl"), "manufacturer": when_set("author", F.struct(c("author").alias("name"))),
        "authors": when_set("author", F.array(pair("name", c("author"), "email", none))),
        "licenses": when_set("license", F.array(F.struct(pair("id", none, "name", c("license")).alias("license")))),
        "hashes": when_set("sha", F.array(pair("alg", F.lit("SHA-1"), "content", c("sha")))),
        "external_references": when_set("url", F.array(pair("type", F.lit("website"), "url", c("url")))),
        "tags": F.split("tags_csv", ","), "properties": props,
        "model_card": F.when(c("is_metadata") & c("has_card"), card),
        "data": F.when(~c("is_metadata") & c("has_card"), F.array(data)),
    }
    df = view(spark, sf_dir, "comp_flat")
    return df.select(
        "bom_id", "ord", "is_metadata", none.alias("parent_ref"), "k",
        *[v.cast(sc.COMPONENT_FIELDS[n]).alias(n) for n, v in values.items()],
    )
