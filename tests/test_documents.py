"""BOM documents: XML that loses nothing, children of any depth, versions of one serial number, older specifications."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from modelbom.sources import boms as bomio
from modelbom.sources.bomxml import json_from_xml, xml_from_json
from modelbom.sources.downgrade import SINCE, pruned
from modelbom.sources.rewriting import depth
from tests.test_sources import DOC, strip

ODD = {
    "$schema": "http://s", "bomFormat": "CycloneDX", "specVersion": "1.6", "version": 3, "serialNumber": "urn:1",
    "annotations": [{"text": "n"}], "services": [], "x-empty": [], "_under": "v", "a b": {"c d": 1}, "xmlish": "q",
    "components": [
        {
            "type": "library", "name": "007", "version": "1.10", "scope": "optional", "cpe": "true", "description": " a <b> & \"c\" ' \n x ",
            "licenses": [{"expression": "MIT OR X"}], "mixed": [1, 2.5, True, None, "s", [], {}, [1, [2]], {"a": {}}], "one": ["z"],
            "number": 5, "flag": False, "nothing": None, "object": {}, "empty": "", "spaces": "  ", "control": "a\u0001b", "emoji": "😀 ]]> <!-- x -->",
            "data": [{"type": "dataset"}], "tags": ["one"], "hashes": [{"alg": "MD5", "content": "x", "more": 1}, {"alg": "SHA-1", "content": "0070"}],
            "properties": [{"name": "p", "value": "007"}, {"name": "q", "value": ""}, {"name": "r"}, {"value": "no name"}],
            "evidence": {"identity": [{"field": "purl", "confidence": 1}]},
        }
    ],
    "metadata": {"tools": [{"vendor": "v", "name": "old"}], "authors": [{"name": "a"}], "licenses": [{"license": {"id": "MIT"}, "acknowledgement": "x"}]},
    "dependencies": [{"ref": "m", "dependsOn": ["d"]}, {"ref": "d"}, {"ref": "e", "dependsOn": []}],
    "compositions": [{"aggregate": "complete", "assemblies": ["m"]}],
    "vulnerabilities": [{"bom-ref": "v", "cwes": [79], "id": "CVE", "ratings": [{"score": 7.5, "severity": "high"}], "affects": [{"ref": "m"}]}],
}


def nested(n):
    return {"type": "file", "name": f"n{n}", "x": {"level": n}, **({"components": [nested(n - 1), {"type": "file", "name": f"side{n}"}]} if n else {})}


def anything(rnd, level=0):
    """A random JSON value with odd names and texts."""
    kind = rnd.randrange(8 if level < 4 else 5)
    if kind < 5:
        return rnd.choice(["", " ", "a", "007", "1e5", "true", "null", "<&>\"'", "é😀", "\t\n\r", "]]>", "-0", 0, -7, 1.25, True, False, None])
    names = ["a", "b-c", "components", "licenses", "tools", "data", "dependsOn", "ref", "value", "_x", "x y", "é", "item", "tags", "xml", "name", "version", "1a"]
    if kind < 7:
        return {rnd.choice(names): anything(rnd, level + 1) for _ in range(rnd.randrange(4))}
    return [anything(rnd, level + 1) for _ in range(rnd.randrange(4))]


def through_xml(spark, docs):
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "k int, v string")
    rows = df.select("k", xml_from_json(F.col("v")).alias("x")).select("k", "x", json_from_xml(F.col("x")).alias("j")).orderBy("k").collect()
    return [r.x for r in rows], [json.loads(r.j) for r in rows]


def test_xml_keeps_everything(spark):
    docs = [DOC, ODD, {"bomFormat": "CycloneDX"}, {"bomFormat": "CycloneDX", "components": [nested(12)]}]
    texts, back = through_xml(spark, docs)
    assert back == docs
    assert '<component bom-ref="d" type="data">' in texts[0] and '<hash alg="SHA-1">abc</hash>' in texts[0] and "json:type" not in texts[0]


def test_xml_of_random_documents(spark):
    rnd = random.Random(6)
    docs = [{"bomFormat": "CycloneDX", "specVersion": "1.5", "extra": anything(rnd), "components": [{"name": "c", "field": anything(rnd), "more": anything(rnd)}]} for _ in range(120)]
    texts, back = through_xml(spark, docs)
    bad = [(d, b) for d, b in zip(docs, back) if d != b]
    assert not bad, bad[0]


def test_foreign_xml(spark):
    text = """<?xml version="1.0"?><!-- c --><bom xmlns="http://cyclonedx.org/schema/bom/1.4" serialNumber='urn:2' version="1">
      <metadata><timestamp>2024-01-01T00:00:00Z</timestamp><tools><tool><vendor>v</vendor><name>t</name></tool></tools>
        <component type="application" bom-ref="m"><name><![CDATA[a <b> & 1]]></name><version>1.10</version></component></metadata>
      <components><component type="library"><name>l</name><licenses><license><id>MIT</id></license><license><name>own</name></license></licenses>
        <purl>pkg:a/b@1?x=1&amp;y=2</purl></component></components>
      <dependencies><dependency ref="m"><dependency ref="l"/></dependency><dependency ref="l"/></dependencies></bom>"""
    (r,) = spark.createDataFrame([(text,)], "x string").select(json_from_xml(F.col("x")).alias("j")).collect()
    assert json.loads(r.j) == {
        "bomFormat": "CycloneDX", "specVersion": "1.4", "serialNumber": "urn:2", "version": 1,
        "metadata": {"timestamp": "2024-01-01T00:00:00Z", "tools": [{"vendor": "v", "name": "t"}], "component": {"type": "application", "bom-ref": "m", "name": "a <b> & 1", "version": "1.10"}},
        "components": [{"type": "library", "name": "l", "licenses": [{"license": {"id": "MIT"}}, {"license": {"name": "own"}}], "purl": "pkg:a/b@1?x=1&y=2"}],
        "dependencies": [{"ref": "m", "dependsOn": ["l"]}, {"ref": "l"}],
    }
    broken = spark.createDataFrame([("<bom><a></bom>",), ("",), ("x <b",), (None,)], "x string")
    assert [r.j for r in broken.select(json_from_xml(F.col("x")).alias("j")).collect()] == [None] * 4


def test_xml_is_walked_once(spark):
    """a document is parsed once each way and walked once, not once per level of its nesting."""
    doc = {"bomFormat": "CycloneDX", "components": [nested(150)], "x": [[[[[]]]]]}
    df = spark.createDataFrame([(json.dumps(doc),)], "v string").select(xml_from_json(F.col("v")).alias("x"))
    back = df.select(json_from_xml(F.col("x")).alias("j"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\+- ArrowEvalPython", plan)) == 2 and "aggregate(" not in plan
    assert json.loads(back.collect()[0].j) == doc


def test_long_and_mixed_texts(spark):
    """a long text is one text; texts beside elements are a list; what follows the element does not count."""
    long = "".join(f"{k} <&> 'é😀'\n" for k in range(20_000))
    doc = {"bomFormat": "CycloneDX", "components": [{"type": "file", "name": long, "description": " " * 9_000}]}
    texts, back = through_xml(spark, [doc])
    assert back == [doc]
    text = "<bom><name>a<![CDATA[<b>]]>c<!-- d --></name><x>1<y/>2</x></bom> rest <z"
    (r,) = spark.createDataFrame([(text,)], "x string").select(json_from_xml(F.col("x")).alias("j")).collect()
    assert json.loads(r.j) == {"bomFormat": "CycloneDX", "name": "a<b>c", "x": {"_VALUE": ["1", "2"], "y": ""}}


def test_documents_are_dealt_by_key(spark, tmp_path):
    """the documents of one split are made by many tasks, and a row that comes twice is in one file."""
    from catalog.hub_queries import odd_documents

    rows = spark.range(0, 400, 1, 1).selectExpr("id % 200 p_partkey", "concat('B', id % 200) p_brand", "'n' p_name")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    texts = spark.read.text(odd_documents(spark, str(tmp_path))).select("value", F.input_file_name().alias("f"))
    assert texts.count() == 400 and texts.distinct().count() == 200 and texts.select("f").distinct().count() > 1


def test_foreign_numbers_stay_json(spark):
    """F1: what XML calls a score or a version and JSON cannot say as a number is a string; the document is kept."""
    text = """<bom version="v1"><vulnerabilities><vulnerability><ratings><rating><score>007</score></rating>
      <rating><score>
        7.50
      </score></rating></ratings><cwes><cwe>79</cwe><cwe>x</cwe></cwes></vulnerability></vulnerabilities></bom>"""
    (r,) = spark.createDataFrame([(text,)], "x string").select(json_from_xml(F.col("x")).alias("j")).collect()
    assert json.loads(r.j) == {
        "bomFormat": "CycloneDX", "version": "v1", "vulnerabilities": [{"ratings": [{"score": "007"}, {"score": 7.5}], "cwes": [79, "x"]}],
    }


def test_xml_and_json_give_equal_tables(spark, tmp_path):
    docs = spark.createDataFrame([("a", json.dumps(DOC)), ("b", json.dumps({**ODD, "metadata": {"component": nested(7)}}))], "bom_id string, value string")
    tables = bomio.tables_from_texts(docs)
    for layout in ("lines", "files"):
        out = str(tmp_path / layout)
        bomio.write_boms(tables, out, fmt="xml", layout=layout)
        back = bomio.read_boms(spark, out, fmt="xml")
        for name in ("boms", "components", "dependencies", "tools", "services", "compositions", "external_refs", "vulnerabilities"):
            text = lambda df: sorted(json.dumps(strip(json.loads(r.j)), sort_keys=True) for r in df.drop("bom_id", "raw").select(F.to_json(F.struct("*")).alias("j")).collect())
            assert text(getattr(back, name)) == text(getattr(tables, name)), name
        kids = lambda t: sorted((r.level, r.parent_ref, r.name, tuple(r.path), json.dumps(json.loads(r.raw), sort_keys=True)) for r in bomio.nested_components(t.components).collect())
        assert kids(back) == kids(tables) and len(kids(tables)) == 2 + 14


def test_children_of_any_depth(spark):
    docs = spark.createDataFrame([("a", json.dumps({"components": [nested(12), nested(0)], "metadata": {"component": nested(3)}}))], "bom_id string, value string")
    kids = bomio.nested_components(bomio.tables_from_texts(docs).components).collect()
    assert len(kids) == 24 + 6 and max(r.level for r in kids) == 13
    deep = next(r for r in kids if r.level == 13 and r.name == "n0")
    assert deep.parent_ref == "file/n1" and deep.path == [0] * 13 and deep.ord == 0
    assert next(r for r in kids if r.name == "side2" and r.path[0] == -1).path == [-1, 0, 1]
    plan = bomio.nested_components(bomio.tables_from_texts(docs).components)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Union") == 0


def test_depth(spark):
    texts = ["1", '"{["', "{}", "[[]]", '{"a":[{"b":"}]"}],"c":"\\"{"}', None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(depth(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == [0, 0, 1, 2, 3, 0]


def test_versions_of_one_serial_number(spark, tmp_path):
    p = tmp_path / "a.json"
    lines = [{"serialNumber": "urn:1", "version": v, "components": [{"name": f"c{v}{k}"} for k in range(v)]} for v in (1, 2)]
    p.write_text("\n".join(json.dumps(x) for x in [*lines, lines[0]]))
    t = bomio.read_boms(spark, str(p), layout="lines")
    got = {r.version: r.names for r in t.boms.join(t.components.groupBy("bom_id").agg(F.sort_array(F.collect_list("name")).alias("names")), "bom_id").collect()}
    assert got == {1: ["c10"], 2: ["c20", "c21"]} and t.boms.count() == 2
    out = str(tmp_path / "xml")
    bomio.write_boms(t, out, fmt="xml", layout="lines")
    back = bomio.read_boms(spark, out, fmt="xml")
    assert sorted((r.serial_number, r.version) for r in back.boms.collect()) == [("urn:1", 1), ("urn:1", 2)]


def fields_of(value, kind, spec):
    """The plain version: a document of ``spec``."""
    from modelbom.sources.bomxml import LISTS
    from modelbom.sources.downgrade import TYPES_SINCE

    if isinstance(value, dict):
        kept = {k: v for k, v in value.items() if SINCE.get(kind, {}).get(k, "1.0") <= spec}
        return {k: "application" if kind == "component" and k == "type" and TYPES_SINCE.get(v, "1.0") > spec else fields_of(v, k, spec) for k, v in kept.items()}
    return [fields_of(v, LISTS.get(kind, kind), spec) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize("spec", ["1.0", "1.2", "1.4", "1.5", "1.6"])
def test_older_specifications(spark, spec):
    docs = [DOC, {**ODD, "components": [{**nested(6), "tags": ["t"], "modelCard": {"considerations": {"environmentalConsiderations": {"x": 1}, "users": ["u"]}}}]}]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "k int, v string")
    rows = df.select("k", pruned(F.col("v"), F.lit("bom"), spec).alias("v")).orderBy("k").collect()
    assert [json.loads(r.v) for r in rows] == [fields_of(d, "bom", spec) for d in docs]
    tables = bomio.tables_from_texts(df.select(F.col("k").cast("string").alias("bom_id"), F.col("v").alias("value")))
    written = json.loads(bomio.documents(tables, spec).where("bom_id = '0'").collect()[0].value)
    want = fields_of({**DOC, "specVersion": spec}, "bom", spec)
    if spec < "1.5" and "metadata" in want:
        want["metadata"]["tools"] = [{"vendor": "v", "name": "t", "version": "1"}]
    assert written == want


def test_order_values_of_any_size(spark, tmp_path):
    """More members and entries than fit the digits of one number keep their order, in entries and documents."""
    docs = spark.createDataFrame([("a", json.dumps({"components": [{"name": "x", "type": "library"}], "dependencies": [{"ref": "r", "dependsOn": ["p"]}]}))], "bom_id string, value string")
    t = bomio.tables_from_texts(docs)
    places = [(0, 0, 1 << 62), (0, 1, 0), (1, 0, 5), (1 << 15, 0, 0), (1 << 15, 0, 1 << 41), (1 << 15, 1, 3), (1 << 40, 0, 0)]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(random.Random(1).sample(places, len(places)))], "k int, p struct<seq:bigint,rank:bigint,ord:bigint>")
    many = t.components.drop("ord").crossJoin(rows).withColumn("ord", F.struct(F.col("p"), F.col("k").cast("bigint").alias("last"))).withColumn("name", F.to_json("p")).drop("p", "k")
    deps = t.dependencies.drop("pos").crossJoin(rows).withColumn("pos", F.col("p")).withColumn("depends_on", F.to_json("p")).drop("p", "k")
    tables = bomio.BomTables(boms=t.boms, components=many, dependencies=deps)
    want = [json.loads(r[0]) for r in rows.orderBy("p").select(F.to_json("p")).collect()]
    out = str(tmp_path / "entries")
    bomio.write_boms(tables, out)
    for source in (tables, bomio.read_boms(spark, out, layout="entries")):
        (doc,) = bomio.documents(source).collect()
        doc = json.loads(doc.value)
        assert [json.loads(c["name"]) for c in doc["components"]] == want
        assert [json.loads(x) for x in doc["dependencies"][0]["dependsOn"]] == want


def test_files_of_entries_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    """written entries take a part of their texts' bytes, in files of a bounded number of entries; nothing is lost."""
    doc = {**ODD, "components": [{"type": "file", "name": f"c{k}", "description": f"a text of component {k} " * 20} for k in range(3_000)]}
    tables = bomio.tables_from_texts(spark.createDataFrame([("a", json.dumps(doc))], "bom_id string, value string"))
    plain, out = str(tmp_path / "plain"), tmp_path / "out"
    bomio.write_boms(tables, plain, compression="none")
    monkeypatch.setattr(bomio, "ENTRIES_PER_FILE", 500)
    bomio.write_boms(tables, str(out))
    whole = spark.read.text(plain).agg(F.sum(F.length("value")).alias("n")).collect()[0].n
    parts = [f for f in out.iterdir() if f.name.startswith("part-")]
    assert sum(f.stat().st_size for f in parts) < whole / 5
    counts = [r["count"] for r in spark.read.text(str(out)).groupBy(F.input_file_name()).count().collect()]
    assert max(counts) <= 500 and sum(counts) == spark.read.text(plain).count() > 3_000
    rows = lambda path: sorted(map(repr, spark.read.schema(bomio.ENTRIES).json(path).collect()))
    assert rows(str(out)) == rows(plain)
    (back,) = bomio.documents(bomio.read_boms(spark, str(out), layout="entries")).collect()
    assert [c["name"] for c in json.loads(back.value)["components"]] == [f"c{k}" for k in range(3_000)]
