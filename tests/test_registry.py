"""Weights, a fully populated row, and source chains."""

from pyspark.sql import functions as F

from modelbom.functions import cards
from modelbom.operators import assemble, score, security
from modelbom.operators.registry import DATASET_REGISTRY, MODEL_REGISTRY

MODEL_TEXT = """---
license: mit
tags: [a, b]
datasets:
- org/ds
metrics: [f1]
base_model: org/base
---
- **Developed by:** Dev
- **Paper [optional]:** https://p
- **Demo:** https://d
- **Hardware Type:** GPU
- **Hours used:** 5
- **Cloud Provider:** c
- **Compute Region:** r
- **Carbon Emitted** *(x)*: 1 kg
## Direct Use
use
## Out-of-Scope Use
not this
## Bias, Risks, and Limitations
bias
### Recommendations
care
## Model Card Contact
me
"""
DATA_TEXT = """---
license: cc0
tags: [t]
annotations_creators: [crowd]
---
- **Curated by:** Cur
- **Funded by [optional]:** Fun
- **Shared by:** Sha
## Dataset Description
about
## Dataset Card Contact
you
"""


def hub(spark):
    models = spark.sql(
        """SELECT 'o/m' AS id, 'auth' AS author, 'qa' AS pipeline_tag, 'lib' AS library_name, array(' x ', 'x', '') AS tags, 'ABC' AS sha,
        5L AS downloads, 3L AS likes, 'lm' AS last_modified, 'ca' AS created_at, false AS private, 9L AS used_storage, 'bert' AS model_type,
        array('Bert') AS architectures, parse_json('{"language":["en","fr"],"datasets":["org/ds"],"license":"apache"}') AS card_data"""
    )
    datasets = spark.sql(
        """SELECT 'org/ds' AS id, 'dauth' AS author, 'DEF' AS sha, 'lm' AS last_modified, 'ca' AS created_at, array('t') AS tags, 'd' AS description,
        7L AS used_storage, parse_json('{"task_categories":["cls"],"tags":["s"],"configs":[{"config_name":"c","data_files":[{"split":"s","path":"p"}]}]}') AS card_data"""
    )
    text = spark.createDataFrame([("o/m", MODEL_TEXT)], "id string, raw string")
    dtext = spark.createDataFrame([("org/ds", DATA_TEXT)], "id string, raw string")
    return models, cards.model_card(text), datasets, cards.dataset_card(dtext)


def rows(spark, with_api=True):
    models, mcards, _, _ = hub(spark)
    found = spark.createDataFrame([(" o/m ", "", "model", "p.py", "ev", "m")], "id string, name string, type string, path string, evidence string, method string")
    sec = spark.createDataFrame([("o/m", "safe", 2, 0, 0)], "id string, overall string, scanned long, unsafe long, caution long")
    return assemble.attach_metadata(found, models if with_api else models.where("false"), mcards, sec)


def test_weights():
    assert abs(sum(s.weight for s in MODEL_REGISTRY) - 12.15) < 1e-9
    assert sum(s.weight > 0 for s in MODEL_REGISTRY) == 30
    assert abs(sum(s.weight for s in DATASET_REGISTRY) - 9.4) < 1e-9
    assert len(DATASET_REGISTRY) == 17


def test_everything_present_scores_one(spark):
    r = rows(spark)
    models = assemble.assemble_models(r)
    (m,) = score.completeness(models).collect()
    assert (m.score, m.passed, m.total, m.missing_required, m.missing_optional) == (1.0, 30, 30, [], [])
    _, _, datasets, dcards = hub(spark)
    data = assemble.assemble_datasets(assemble.attach_datasets(assemble.model_dataset_refs(r), datasets, dcards))
    (d,) = score.dataset_completeness(models.unionByName(data)).collect()
    assert (d.dataset_ref, d.score, d.passed) == ("org/ds", 1.0, 17)
    (c,) = data.collect()
    assert c.purl == c.bom_ref == "pkg:huggingface/datasets/org/ds@def"
    assert c.tags == ["t", "lastModified:lm"] and c.licenses[0].license.name == "cc0"
    assert c.data[0].contents.attachment.content == "config:c split:s path:p"
    g = c.data[0].governance
    assert (g.custodians[0].organization.name, g.stewards[0].organization.name, g.owners[0].organization.name) == ("dauth", "Cur", "Fun")


def test_model_values(spark):
    (c,) = assemble.assemble_models(rows(spark)).collect()
    assert (c.name, c.group, c.purl, c.manufacturer.name) == ("o/m", "o", "pkg:huggingface/o/m@abc", "auth")
    assert [(p.name, p.value) for p in c.properties][:3] == [("modelbom.type", "model"), ("modelbom.evidence", "ev"), ("modelbom.path", "p.py")]
    assert dict((p.name, p.value) for p in c.properties)["huggingface:language"] == "en,fr"
    assert c.licenses[0].license.name == "apache" and c.tags == ["x"]
    assert [r.url for r in c.external_references] == ["https://huggingface.co/o/m", "https://p", "https://d"]
    assert c.model_card.considerations.useCases == ["use", "out-of-scope: not this"]
    assert [(m.type, m.value) for m in c.model_card.quantitativeAnalysis.performanceMetrics] == [("f1", "")]
    assert [d.ref for d in c.model_card.modelParameters.datasets] == ["dataset:org/ds"]


def test_card_alone(spark):
    (c,) = assemble.assemble_models(rows(spark, with_api=False), evidence=False).collect()
    assert (c.licenses[0].license.name, c.manufacturer.name, c.group, c.purl) == ("mit", "Dev", "o", "pkg:huggingface/o/m")
    assert c.hashes is None and c.tags == ["a", "b"]
    assert {p.name for p in c.properties} >= {"huggingface:baseModel", "huggingface:security:overallStatus"}


def test_suspicious_only_gives_no_vulnerabilities(spark):
    entries = spark.createDataFrame(
        [("model", "o/a", 0, "x", ("suspicious",)), ("model", "o/b", 0, "x", ("Unsafe",)), ("model", "o/b", 0, "y", ("suspicious",)), ("model", "o/b", 0, "z", None)],
        "kind string, repo_id string, page int, path string, s struct<status:string>",
    ).withColumn("securityFileStatus", F.from_json(F.to_json("s"), security_status()))
    targets = spark.createDataFrame(
        [("b1", 0, True, "ra", "model", "o/a"), ("b1", 1, False, "rb", "model", "o/b")],
        "bom_id string, ord long, is_metadata boolean, bom_ref string, kind string, hub_id string",
    )
    got = {r.bom_ref: r.description for r in security.file_vulnerabilities(targets, entries).collect()}
    assert got == {
        "hfsec-rb-x": 'Security finding in file "x" (overall status: Unsafe)',
        "hfsec-rb-y": 'Security finding in file "y" (overall status: suspicious)',
    }
    summary = {r.repo_id: (r.overall, r.scanned, r.unsafe, r.suspicious) for r in security.security_summary(entries).collect()}
    assert summary == {"o/a": ("safe", 1, 0, 1), "o/b": ("unsafe", 2, 1, 1)}


def security_status():
    from modelbom.schemas import FILE_STATUS

    return FILE_STATUS
