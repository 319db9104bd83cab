"""Files in and out: trees, BOM documents in JSON and XML, hub responses, settings."""

import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from modelbom.operators.enrich import enrichment_lookup, values_map
from modelbom.operators.extract import scan_references
from modelbom.operators.registry import FieldSpec
from modelbom.plans import inventory
from modelbom.sources import boms as bomio
from modelbom.sources import files, hub

DOC = {
    "bomFormat": "CycloneDX", "specVersion": "1.6", "serialNumber": "urn:uuid:1", "version": 2,
    "metadata": {
        "timestamp": "2024-01-01T00:00:00Z",
        "tools": {"components": [{"type": "application", "name": "t", "version": "1", "manufacturer": {"name": "v"}}]},
        "component": {
            "bom-ref": "m", "type": "machine-learning-model", "name": "o/m", "tags": ["a", "b"],
            "licenses": [{"license": {"name": "mit"}}], "hashes": [{"alg": "SHA-1", "content": "abc"}],
            "properties": [{"name": "p", "value": "1"}, {"name": "p", "value": "2"}],
            "modelCard": {
                "modelParameters": {"task": "qa", "datasets": [{"ref": "dataset:d"}]},
                "considerations": {"useCases": ["u"], "environmentalConsiderations": {"properties": [{"name": "hw", "value": "x"}]}},
            },
        },
    },
    "components": [
        {"bom-ref": "d", "type": "data", "name": "d", "data": [{"type": "dataset", "description": "about", "governance": {"custodians": [{"organization": {"name": "c"}}]}}]},
        {"type": "library", "name": "lib", "version": "1", "tags": ["t"], "components": [{"type": "library", "name": "inner", "tags": ["x"], "components": [{"type": "file", "name": "deep"}]}]},
    ],
    "dependencies": [{"ref": "m", "dependsOn": ["d", "e"]}, {"ref": "d"}],
    "services": [{"bom-ref": "s", "name": "svc"}],
    "compositions": [{"aggregate": "complete", "assemblies": ["m"]}],
    "externalReferences": [{"type": "website", "url": "https://x"}],
    "vulnerabilities": [{"bom-ref": "v", "description": "d", "ratings": [{"severity": "high"}], "affects": [{"ref": "m"}]}],
}


@pytest.fixture
def doc_path(tmp_path):
    p = tmp_path / "in" / "a.json"
    p.parent.mkdir()
    p.write_text(json.dumps(DOC, indent=2))
    return str(p)


def test_read_json(spark, doc_path):
    t = bomio.read_boms(spark, doc_path)
    (b,) = t.boms.collect()
    assert (b.spec_version, b.serial_number, b.version, b.timestamp) == ("1.6", "urn:uuid:1", 2, "2024-01-01T00:00:00Z")
    rows = {(r.is_metadata, r.ord): r for r in t.components.collect()}
    assert [rows[k].name for k in sorted(rows, reverse=True)] == ["o/m", "lib", "d"]
    m = rows[(True, 0)]
    assert m.model_card.modelParameters.task == "qa" and [p.value for p in m.properties] == ["1", "2"]
    kids = bomio.nested_components(t.components).collect()
    assert {(r.level, r.parent_ref, r.name, tuple(r.path)) for r in kids} == {(2, "library/lib/1", "inner", (1, 0)), (3, "library/inner", "deep", (1, 0, 0))}
    assert {(r.ref, r.pos, r.depends_on) for r in t.dependencies.collect()} == {("m", 0, "d"), ("m", 1, "e"), ("d", None, None)}
    (tool,) = t.tools.collect()
    assert (tool.legacy, tool.name, tool.manufacturer) == (False, "t", "v")
    (v,) = t.vulnerabilities.collect()
    assert (v.bom_ref, v.affects, v.ratings[0].severity) == ("v", "m", "high")


def strip(x):
    """Documents without empty parts."""
    if isinstance(x, dict):
        return {k: strip(v) for k, v in x.items() if v not in (None, [], {})}
    return [strip(v) for v in x] if isinstance(x, list) else x


def test_json_round_trip(spark, doc_path, tmp_path):
    t = bomio.read_boms(spark, doc_path)
    out = str(tmp_path / "out")
    bomio.write_boms(t, out, layout="lines")
    (line,) = spark.read.text(out).collect()
    assert json.loads(line.value) == DOC
    parts = str(tmp_path / "entries")
    bomio.write_boms(t, parts)
    (line,) = bomio.documents(bomio.read_boms(spark, parts, layout="entries")).collect()
    assert json.loads(line.value) == DOC
    again = bomio.read_boms(spark, out + "/*.txt", fmt="json", layout="lines")
    assert again.components.count() == 3


def test_one_file_per_document(spark, doc_path, tmp_path):
    out = str(tmp_path / "files")
    bomio.write_boms(bomio.read_boms(spark, doc_path), out, layout="files", spec="1.5")
    assert "file_name=o_m_aibom.json" in os.listdir(out)
    (row,) = spark.read.option("recursiveFileLookup", "true").text(out, wholetext=True).collect()
    doc = json.loads(row.value)
    # Older specs have no tags, at any level.
    assert doc["specVersion"] == "1.5" and '"tags"' not in row.value


def test_xml_round_trip(spark, doc_path, tmp_path):
    t = bomio.read_boms(spark, doc_path)
    out = str(tmp_path / "xml")
    bomio.write_boms(t, out, fmt="xml")
    back = bomio.read_boms(spark, out, fmt="xml")
    cols = [c for c in t.components.columns if c not in ("bom_id", "parent_ref")]
    cols.remove("raw")
    # JSON text leaves out what is empty, so absent and empty structs compare equal.
    def texts(df):
        return sorted(json.dumps(strip(json.loads(r.j)), sort_keys=True) for r in df.select(F.to_json(F.struct(*cols)).alias("j")).collect())

    assert texts(back.components) == texts(t.components)
    assert {(r.ref, r.depends_on) for r in back.dependencies.collect()} == {("m", "d"), ("m", "e"), ("d", None)}
    assert [(r.name, r.manufacturer) for r in back.tools.collect()] == [("t", "v")]
    (b,) = back.boms.collect()
    assert (b.spec_version, b.serial_number, b.version, b.timestamp) == ("1.6", "urn:uuid:1", 2, "2024-01-01T00:00:00Z")


def test_changes_go_over_the_text(spark, doc_path, tmp_path):
    t = bomio.read_boms(spark, doc_path)
    new = t.components.withColumn("group", F.when(F.col("name") == "lib", "g")).withColumn("tags", F.when(F.col("name") != "lib", F.col("tags")))
    (row,) = bomio.documents(replace(t, components=new)).collect()
    got, want = json.loads(row.value), json.loads(json.dumps(DOC))
    want["components"][1]["group"] = "g"
    del want["components"][1]["tags"]
    assert got == want


def test_any_size_is_one_form(spark, doc_path):
    t = bomio.read_boms(spark, doc_path)
    many = t.components.where("name = 'lib'").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(500))))
    many = many.withColumn("ord", F.col("i").cast("bigint")).withColumn("name", F.concat("name", F.col("i").cast("string"))).drop("i")
    tables = bomio.BomTables(boms=t.boms, components=t.components.where("is_metadata").unionByName(many))
    rows = bomio.entries(tables)
    assert rows.where("section = 'components'").count() == 500
    (whole,) = bomio.documents(tables).collect()
    assert [c["name"] for c in json.loads(whole.value)["components"]] == [f"lib{i}" for i in range(1, 501)]


def test_lines_without_serial_number(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text("\n".join(json.dumps({"bomFormat": "CycloneDX", "metadata": {"component": {"name": n}}}) for n in ("a", "b", "c")))
    t = bomio.read_boms(spark, str(p), layout="lines")
    ids = {r.bom_id for r in t.boms.collect()}
    assert len(ids) == 3 and None not in ids and {r.name for r in t.components.collect()} == {"a", "b", "c"}


def test_each_file_by_its_extension(spark, doc_path, tmp_path):
    t = bomio.read_boms(spark, doc_path)
    out = str(tmp_path / "xml")
    bomio.write_boms(t, out, fmt="xml", layout="files")
    both = tmp_path / "both"
    both.mkdir()
    (both / "a.json").write_text(json.dumps(DOC))
    for folder, _, names in os.walk(out):
        for n in names:
            if n.endswith(".xml"):
                (both / "b.xml").write_bytes(open(os.path.join(folder, n), "rb").read())
    got = bomio.read_boms(spark, str(both))
    assert got.boms.count() == 2 and got.components.count() == 6
    assert got.services.count() == got.compositions.count() == got.external_refs.count() == got.vulnerabilities.count() == 2
    assert bomio.nested_components(got.components).count() == 4


def test_merged_boms_keep_base_metadata(spark, doc_path):
    import copy

    other = copy.deepcopy(DOC)
    base = copy.deepcopy(DOC)
    base["metadata"]["authors"] = [{"name": "who"}]
    other["components"][1] = {"type": "library", "name": "other", "components": [{"type": "file", "name": "kid", "cpe": "x"}]}
    docs = spark.createDataFrame([("a", json.dumps(base)), ("b", json.dumps(other))], "bom_id string, value string")
    members = spark.createDataFrame([("t", 0, "a"), ("t", 1, "b")], "target_id string, seq int, bom_id string")
    out, _ = inventory.merge_boms(bomio.tables_from_texts(docs), members)
    (row,) = bomio.documents(out).collect()
    doc = json.loads(row.value)
    assert doc["metadata"]["authors"] == [{"name": "who"}] and doc["metadata"]["component"]["name"] == "o/m"
    assert next(c for c in doc["components"] if c["name"] == "other")["components"] == [{"type": "file", "name": "kid", "cpe": "x"}]


def test_formats():
    assert bomio.resolve_format("x.XML") == "xml" and bomio.resolve_format("x.bom") == "json"
    assert bomio.check_output("o.json", "auto", " 1.5 ") == ("json", "1.5")
    for bad in [("o.xml", "json", ""), ("o.json", "yaml", ""), ("o.json", "json", "2.0")]:
        with pytest.raises(ValueError):
            bomio.check_output(*bad)


def test_source_tree(spark, tmp_path):
    root = tmp_path / "my build" / "src+x"
    for path, text in {
        "a b.py": 'x.from_pretrained("o/a")', "sub/c.yaml": "model: o/c", "node_modules/d.py": 'x.from_pretrained("o/d")', "e.txt": "x",
        "pct%20.sh": "export MODEL=o/e",
    }.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    df = files.read_files(spark, str(root))
    assert sorted((r.path, r["class"]) for r in df.collect()) == [("a b.py", "python"), ("pct%20.sh", "shell"), ("sub/c.yaml", "yaml")]
    assert sorted(r.id for r in scan_references(df).collect()) == ["o/a", "o/c", "o/e"]


def test_hub_responses(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(
        '{"id":"o/m","modelId":"o/m","gated":"auto","private":true,"downloads":5,"lastModified":"x","config":{"model_type":"bert","architectures":["B"]},"cardData":{"license":"mit","language":["en",3]}}\n'
        '{"id":"o/n","gated":false}\n'
    )
    a, b = hub.read_hub_models(spark, str(p)).orderBy("id").collect()
    assert (a.gated, a.model_type, a.architectures, a.last_modified, a.private) == ("auto", "bert", ["B"], "x", True)
    assert json.loads(a.card_data.toJson()) == {"license": "mit", "language": ["en", 3]}
    assert (b.gated, b.card_data, b.downloads) == ("false", None, None)
    s = tmp_path / "s.json"
    s.write_text("\n".join(json.dumps({"repo_id": "o/m", "page": i, "path": f"f{i}", "securityFileStatus": {"status": "safe"}}) for i in range(12)))
    tree = hub.read_security_tree(spark, str(s))
    assert tree.count() == 12 and tree.where("securityFileStatus.status = 'safe' and kind = 'model'").count() == 12


def test_settings(spark, tmp_path):
    p = tmp_path / "values.yaml"
    p.write_text('# note\nBOM.metadata.component.licenses: "Apache-2.0"\nBOM.metadata.component.tags:\n  - nlp\n  - bert\n\nBOM.metadata.component.properties.huggingface:language: en\n')
    df = files.read_enrichment(spark, str(p))
    assert {r.key: r.value for r in df.collect()} == {
        "bom.metadata.component.licenses": "Apache-2.0", "bom.metadata.component.tags": "[nlp bert]",
        "bom.metadata.component.properties.huggingface:language": "en",
    }
    again = df.unionByName(df.withColumn("key", F.upper("key")).withColumn("value", F.lit("zz")))
    (m,) = values_map(again).collect()
    assert len(m["values"]) == 3 and "zz" not in m["values"].values()
    own = [FieldSpec("Own.Field", 1.0, present=lambda c: F.lit(True), parse=None)]
    missing = spark.createDataFrame([("b", "Own.Field")], "bom_id string, key string")
    (r,) = enrichment_lookup(missing, df.unionByName(spark.createDataFrame([("own.field", "v")], "key string, value string")), own).collect()
    assert r.value == "v"


def test_enrich_from_file(spark, doc_path, tmp_path):
    p = tmp_path / "values.yaml"
    p.write_text("BOM.metadata.component.group: grp\nBOM.metadata.component.licenses: other\nBOM.components[DATA].licenses: cc0\n")
    t = bomio.read_boms(spark, doc_path)
    done, progress = inventory.enrich_boms(t, values_map(files.read_enrichment(spark, str(p))).scalar())
    rows = {r.name: r for r in done.components.collect()}
    assert rows["o/m"].group == "grp" and rows["o/m"].licenses[0].license.name == "mit"
    assert rows["d"].licenses[0].license.name == "cc0" and rows["lib"].licenses is None
    (r,) = progress.collect()
    assert r.final_passed == r.initial_passed + 1


def test_documents_are_parsed_once(spark, tmp_path, doc_path):
    """XML is parsed and rewritten in one place of a plan; with a store the tables read entries, not texts."""
    from modelbom.sources.bomxml import read_xml_documents

    out = str(tmp_path / "xml")
    bomio.write_boms(bomio.read_boms(spark, doc_path), out, fmt="xml", layout="lines")
    xml = read_xml_documents(spark, [out])
    plan = xml._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 2  # is it sound, and its VARIANT
    kept = bomio.read_boms(spark, out, fmt="xml", store=str(tmp_path / "store"))
    assert "Generate" not in kept.components._jdf.queryExecution().optimizedPlan().toString()
    lazy = bomio.read_boms(spark, out, fmt="xml")
    assert [r["value"] for r in bomio.documents(kept).collect()] == [r["value"] for r in bomio.documents(lazy).collect()]
    assert bomio.documents(lazy).rdd.getNumPartitions() > 1
