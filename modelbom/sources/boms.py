"""BOM documents (JSON and XML) to and from tables that lose nothing of them.

A document is taken apart into entries (bom_id, section, ord, entry): what it says about itself, its
metadata component, and one JSON text per list entry. The tables hold the typed columns of the entries
and, as ``raw``, the entry's own text. Writing puts the typed columns over that text: a column that still
says what the text says leaves the text as it is, so fields and children that the columns do not know
come out as they went in, at any depth.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from modelbom import schemas as sc
from modelbom.functions.text import SPEC_VERSIONS, bom_file_name, identity_ref, let
from modelbom.operators.common import dealt, stored
from modelbom.operators.security import Factors
from modelbom.sources.bomxml import LISTS
from modelbom.sources.downgrade import SECTIONS, SINCE, component_type, dropped, later, pruned
from modelbom.sources.rewriting import depth, descend

# Document field -> table column, where the names differ.
_JSON_NAMES = {
    "bom_ref": "bom-ref", "external_references": "externalReferences", "model_card": "modelCard",
}
_EXT_REFS = "array<struct<type:string,url:string>>"
_TOOL = "struct<vendor:string,name:string,version:string,type:string,manufacturer:struct<name:string>>"
_VULN = (
    "struct<`bom-ref`:string,source:struct<name:string,url:string>,description:string,"
    "ratings:array<struct<source:struct<name:string>,severity:string,method:string>>,"
    "advisories:array<struct<title:string,url:string>>,affects:array<struct<ref:string>>>"
)
_MAP = "map<string,variant>"
ENTRIES = "bom_id string, section string, ord array<bigint>, entry string"
#: Entries of a written file at most.
ENTRIES_PER_FILE = 250_000
#: Sections that are lists of the document, in its order.
LISTS_OF_DOCUMENT = ("components", "dependencies", "services", "compositions", "externalReferences", "vulnerabilities")
_SERVICE = "struct<`bom-ref`:string,name:string,version:string>"


def _component_type() -> str:
    inner = ",".join(f"`{_JSON_NAMES.get(n, n)}`:{t}" for n, t in sc.COMPONENT_FIELDS.items())
    return f"struct<{inner}>"


@dataclass
class BomTables:
    """Normalised tables of many BOMs; every row carries ``bom_id`` and its place ``ord``."""

    boms: DataFrame
    components: DataFrame
    dependencies: DataFrame | None = None
    tools: DataFrame | None = None
    services: DataFrame | None = None
    compositions: DataFrame | None = None
    external_refs: DataFrame | None = None
    vulnerabilities: DataFrame | None = None
    #: Vulnerabilities as links and findings, of which ``vulnerabilities`` are the rows of other kinds.
    factors: Factors | None = None
    extras: dict = field(default_factory=dict)

    def all_vulnerabilities(self) -> DataFrame | None:
        """One row per vulnerability, with those that stand in ``factors``."""
        return self.vulnerabilities if self.factors is None else self.factors.expanded()


def resolve_format(path: str, fmt: str = "auto") -> str:
    actual = (fmt or "").strip().lower()
    if actual in ("", "auto"):
        return "xml" if os.path.splitext(path)[1].lower() == ".xml" else "json"
    if actual not in ("json", "xml"):
        raise ValueError(f"unsupported BOM format: {fmt!r}")
    return actual


def check_output(path: str, fmt: str = "auto", spec: str = "") -> tuple[str, str | None]:
    """Format and spec version of an output; the extension has to agree with the format."""
    actual = resolve_format(path, fmt)
    ext = os.path.splitext(path)[1]
    if ext != f".{actual}":
        raise ValueError(f"output path extension {ext!r} does not match format {actual!r}")
    if spec and spec.strip() not in SPEC_VERSIONS:
        raise ValueError(f"unsupported CycloneDX spec version: {spec!r}")
    return actual, spec.strip() or None


# ---- reading ----------------------------------------------------------------------------


def read_boms(spark: SparkSession, paths, fmt: str = "auto", layout: str = "files", store: str | None = None) -> BomTables:
    """BOM documents -> tables.

    ``layout`` 'files' is one document per file, whose path is the id; 'lines' is one JSON document per
    line, and 'entries' JSON lines as ``write_boms`` makes them. The id of a line is the file's path and the
    hash of the line: two versions of a BOM with one serial number are two BOMs, and a line repeated in
    a file is read once. Serial numbers are a column. With ``fmt`` 'auto' each file counts by its own
    extension, also those in a folder. ``store`` names a folder for the entries, which all tables read: there
    each document is parsed once, without it once per table.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if fmt not in ("", "auto", None):
        resolve_format("", fmt)
    if layout == "entries":
        return tables_from_entries(spark.read.schema(ENTRIES).json(paths))
    kind = (fmt or "auto").strip().lower() or "auto"
    texts = []
    if kind in ("auto", "json"):
        reader = spark.read.option("recursiveFileLookup", "true")
        raw = reader.text(paths, wholetext=layout == "files").select("value", F.col("_metadata.file_path").alias("path"))
        if kind == "auto":
            raw = raw.where(~F.lower("path").endswith(".xml"))
        if layout == "files":
            texts.append(raw.select(F.col("path").alias("bom_id"), "value"))
        else:
            own = F.concat("path", F.lit("#"), F.sha1("value"))
            lines = raw.where(F.trim("value") != "").select(own.alias("bom_id"), "value")
            texts.append(dealt(lines, "bom_id").dropDuplicates(["bom_id"]))
    if kind in ("auto", "xml"):
        from modelbom.sources.bomxml import read_xml_documents

        texts.append(read_xml_documents(spark, paths, only_xml=kind == "auto"))
    return tables_from_entries(stored(entries_from_texts(reduce(DataFrame.unionByName, texts)), store, "entries"))


def _parts(variant: Column) -> Column:
    """A JSON value as a map of its fields."""
    return F.from_json(F.to_json(variant), _MAP)


def entries_from_texts(texts: DataFrame, ident: str = "bom_id", value: str = "value") -> DataFrame:
    """JSON document texts -> entries (bom_id, section, ord, entry)."""
    docs = texts.select(F.col(ident).alias("bom_id"), F.from_json(value, _MAP).alias("d"))
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    docs = docs.withColumn("m", _parts(get(F.col("d"), "metadata")))
    tools = get(F.col("m"), "tools")
    docs = docs.select("bom_id", "d", "m", F.to_json(tools).alias("tools_text"), _parts(tools).alias("t"))
    array = "array<variant>"

    def listed(variant: Column, section: str) -> Column:
        texts_ = F.transform(F.try_variant_get(variant, "$", array), lambda v, i: F.struct(
            F.lit(section).alias("section"), i.cast("bigint").alias("ord"), F.to_json(v).alias("entry")
        ))
        return F.coalesce(texts_, F.array().cast("array<struct<section:string,ord:bigint,entry:string>>"))

    def one(entry: Column, section: str) -> Column:
        made = F.struct(F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("ord"), entry.alias("entry"))
        return F.array(made)

    def rest(m: Column, names) -> Column:
        return F.map_filter(m, lambda k, v: ~k.isin(*names))

    old_tools = F.when(F.ltrim("tools_text").startswith("["), F.try_parse_json("tools_text")).otherwise(get(F.col("t"), "tools"))
    other_tools = rest(F.col("t"), ["components", "tools"])
    about = F.map_concat(
        F.coalesce(rest(F.col("m"), ["component", "tools"]), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))),
        F.when(F.size(other_tools) > 0, F.create_map(F.lit("tools"), F.try_parse_json(F.to_json(other_tools)))).otherwise(
            F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
        ),
    )
    self_ = F.map_concat(rest(F.col("d"), [*LISTS_OF_DOCUMENT, "metadata"]), F.create_map(F.lit("metadata"), F.try_parse_json(F.to_json(about))))
    component = get(F.col("m"), "component")
    parts = [
        one(F.to_json(self_), "bom"),
        F.when(F.to_json(component).startswith("{"), one(F.to_json(component), "component")).otherwise(
            F.array().cast("array<struct<section:string,ord:bigint,entry:string>>")
        ),
        listed(get(F.col("t"), "components"), "tools"),
        listed(old_tools, "legacy tools"),
        *[listed(get(F.col("d"), s), s) for s in LISTS_OF_DOCUMENT],
    ]
    return docs.select("bom_id", F.inline(F.concat(*parts)))


def _typed(entries: DataFrame, sections, type_: str) -> DataFrame:
    rows = entries.where(F.col("section").isin(*([sections] if isinstance(sections, str) else sections)))
    return rows.select("bom_id", "section", "ord", F.from_json("entry", type_).alias("e"), F.col("entry").alias("raw"))


def tables_from_texts(texts: DataFrame, ident: str = "bom_id", value: str = "value") -> BomTables:
    return tables_from_entries(entries_from_texts(texts, ident, value))


def _component_rows(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    fields = [F.col("e")[_JSON_NAMES.get(n, n)].cast(t).alias(n) for n, t in sc.COMPONENT_FIELDS.items()]
    return rows.select("bom_id", "ord", (F.col("section") == "component").alias("is_metadata"), none.alias("parent_ref"), *fields, "raw")


def tables_from_entries(entries: DataFrame) -> BomTables:
    """Entries -> typed tables with the entries' own texts in ``raw``."""
    e = F.col("e")
    self_ = "struct<specVersion:string,bomFormat:string,serialNumber:string,version:bigint,metadata:struct<timestamp:string>>"
    boms = _typed(entries, "bom", self_).select(
        "bom_id", e["specVersion"].alias("spec_version"), e["bomFormat"].alias("bom_format"),
        e["serialNumber"].alias("serial_number"), e["version"].alias("version"),
        e["metadata"]["timestamp"].alias("timestamp"), "raw",
    )
    whole = _typed(entries, "dependencies", "struct<ref:string,dependsOn:array<string>>")
    whole = whole.select("bom_id", "ord", e["ref"].alias("ref"), F.posexplode_outer(e["dependsOn"]).alias("pos", "depends_on"))
    written = isinstance(entries.schema["ord"].dataType, ArrayType)  # order values of ``entries``; else places in a text
    edges = _typed(entries, "edges", f"struct<ref:string,pos:{'array<bigint>' if written else 'bigint'},dependsOn:string>")
    edges = edges.select("bom_id", "ord", e["ref"].alias("ref"), e["pos"].alias("pos"), e["dependsOn"].alias("depends_on"))
    tools = _typed(entries, ["tools", "legacy tools"], _TOOL).select(
        "bom_id", "ord", (F.col("section") == "legacy tools").alias("legacy"), e["type"].alias("type"),
        e["vendor"].alias("vendor"), e["manufacturer"]["name"].alias("manufacturer"), e["name"].alias("name"),
        e["version"].alias("version"), "raw",
    )
    return BomTables(
        boms=boms,
        components=_component_rows(_typed(entries, ["component", "components"], _component_type())),
        dependencies=whole.withColumn("pos", F.array(F.col("pos").cast("bigint")) if written else F.col("pos").cast("bigint")).unionByName(edges),
        tools=tools,
        services=_typed(entries, "services", _SERVICE).select(
            "bom_id", "ord", e["bom-ref"].alias("bom_ref"), e["name"].alias("name"), e["version"].alias("version"), "raw"
        ),
        compositions=_typed(entries, "compositions", "struct<aggregate:string,assemblies:array<string>>").select(
            "bom_id", "ord", e["aggregate"].alias("aggregate"), e["assemblies"].alias("assemblies"), "raw"
        ),
        external_refs=_typed(entries, "externalReferences", "struct<type:string,url:string>").select(
            "bom_id", "ord", e["type"].alias("type"), e["url"].alias("url"), "raw"
        ),
        vulnerabilities=_vulnerabilities(_typed(entries, "vulnerabilities", _VULN)),
    )


_KID = "struct<level:int,parent:string,path:array<bigint>,raw:string>"


def nested_components(components: DataFrame) -> DataFrame:
    """Children of component rows at any depth, with ``parent_ref``, ``level`` and ``path``.

    ``path`` holds the places from the top-level component down, so it tells a child's parent also where
    names repeat. One narrow step over each component's text: its levels are walked within the row, as many
    as the text is deep, and nothing is asked of the data beforehand.
    """
    def ref(text: Column) -> Column:
        e = F.from_json(text, "`bom-ref` string, type string, name string, version string")
        return identity_ref(e["bom-ref"], e["type"], e["name"], e["version"])

    def kids(parent: Column) -> Column:
        items = F.try_variant_get(F.try_parse_json(parent["raw"]), "$.components", "array<variant>")
        made = F.transform(items, lambda v, i: F.struct(
            (parent["level"] + 1).alias("level"), ref(parent["raw"]).alias("parent"),
            F.concat(parent["path"], F.array(i.cast("bigint"))).alias("path"), F.to_json(v).alias("raw"),
        ))
        return F.coalesce(made.cast(f"array<{_KID}>"), F.array().cast(f"array<{_KID}>"))

    at = F.when(F.col("is_metadata"), F.array(F.lit(-1).cast("bigint"))).otherwise(_place(components))
    top = F.struct(F.lit(1).alias("level"), F.lit("").alias("parent"), at.alias("path"), F.col("raw").alias("raw"))
    rounds = F.floor(depth(F.col("raw")) / 2).cast("int")  # a level is a list and an object deep
    rows = components.where(F.col("raw").contains('"components"'))
    rows = rows.select("bom_id", F.explode(descend(F.array(top), rounds, kids, _KID)).alias("k"))
    rows = rows.select("bom_id", "k.level", "k.parent", "k.path", "k.raw", F.from_json("k.raw", _component_type()).alias("e"))
    fields = [F.col("e")[_JSON_NAMES.get(n, n)].cast(t).alias(n) for n, t in sc.COMPONENT_FIELDS.items()]
    return rows.select(
        "bom_id", F.element_at("path", -1).alias("ord"), F.lit(False).alias("is_metadata"), F.col("parent").alias("parent_ref"),
        "level", "path", *fields, "raw",
    )


def _vulnerabilities(rows: DataFrame) -> DataFrame:
    e = F.col("e")
    return rows.select(
        "bom_id", "ord", e["bom-ref"].alias("bom_ref"),
        F.get(e["affects"], F.lit(0))["ref"].alias("affects"),
        e["source"]["name"].alias("source_name"), e["source"]["url"].alias("source_url"),
        e["description"].alias("description"),
        F.transform(
            e["ratings"],
            lambda r: F.struct(
                r["source"]["name"].alias("source"), r["severity"].alias("severity"), r["method"].alias("method")
            ),
        ).alias("ratings"),
        e["advisories"].alias("advisories"), "raw",
    )


# ---- writing ----------------------------------------------------------------------------


def spec_downgrade(components: DataFrame, spec: str | None) -> DataFrame:
    """Component rows of an older specification: what came later goes, the rows' own and their children's.

    The fields and component types of each version are in ``downgrade``.
    """
    if spec is None or spec == SPEC_VERSIONS[-1]:
        return components
    gone = {f for f in dropped(spec, "component")}
    names = {n: _JSON_NAMES.get(n, n) for n in sc.COMPONENT_FIELDS}
    out = components.withColumns({
        n: F.lit(None).cast(t) for n, t in sc.COMPONENT_FIELDS.items() if names[n] in gone and n in components.columns
    })
    if "type" in out.columns:
        out = out.withColumn("type", component_type(F.col("type"), spec))
    card = SINCE["considerations"]["environmentalConsiderations"]
    if "model_card" in out.columns and "modelCard" not in gone and later(card, spec):
        considerations = F.col("model_card.considerations").dropFields("environmentalConsiderations")
        kept = F.col("model_card").withField("considerations", F.when(F.col("model_card.considerations").isNotNull(), considerations.withField("environmentalConsiderations", F.lit(None).cast("struct<properties:array<struct<name:string,value:string>>>"))))
        out = out.withColumn("model_card", F.when(F.col("model_card").isNotNull(), kept).cast(sc.MODEL_CARD))
    return out.withColumn("raw", pruned(F.col("raw"), F.lit("component"), spec)) if "raw" in out.columns else out


def over(raw: Column, typed: Column, type_: str) -> Column:
    """The text of ``raw`` with the changes of ``typed``, a struct of the known fields of type ``type_``.

    A field that says the same as the text leaves the text's value, with all it holds; a changed field
    takes its place; a null one goes. Without a text the struct alone is written.
    """
    names = list(StructType.fromDDL("x " + type_)[0].dataType.fieldNames())
    parsed = F.struct(
        F.from_json(F.to_json(typed), _MAP).alias("now"), F.from_json(F.to_json(F.from_json(raw, type_)), _MAP).alias("was"),
        F.from_json(raw, _MAP).alias("own"),
    )
    get = F.try_element_at

    def merged(x):
        def value(k):
            same = F.to_json(get(x["now"], k)).eqNullSafe(F.to_json(get(x["was"], k)))
            return F.struct(k.alias("key"), F.when(same, get(x["own"], k)).otherwise(get(x["now"], k)).alias("value"))

        known = F.filter(F.transform(F.array(*[F.lit(n) for n in names]), value), lambda e: e["value"].isNotNull())
        return F.map_concat(F.map_filter(x["own"], lambda k, v: ~k.isin(*names)), F.map_from_entries(known))

    # Parsed once, not once per field: inside the lambda the texts would be parsed again for every name.
    return F.when(raw.isNull(), F.to_json(typed)).otherwise(F.to_json(let(parsed, merged)))


def _raw(df: DataFrame) -> Column:
    return F.col("raw") if "raw" in df.columns else F.lit(None).cast("string")


def _place(df: DataFrame, column: str = "ord") -> Column:
    """An order value as a list of numbers, compared from the left: merged rows have a struct of (sequence, ..., place),
    whose parts may be such values themselves. No part is packed into another's digits, so any number of members
    and entries keeps its order."""
    return _numbers(F.col(column), df.schema[column].dataType)


def _numbers(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        return F.concat(*[_numbers(value[f.name], f.dataType) for f in kind.fields])
    return value if isinstance(kind, ArrayType) else F.array(value.cast("bigint"))


def entries(tables: BomTables, spec: str | None = None) -> DataFrame:
    """Tables -> entries (bom_id, section, ord, entry), one row per list entry and dependency edge.

    With ``spec``, sections and fields that came later are left out at any depth, and before 1.5 tools have
    the old form (vendor, name, version).
    """
    rows = _entries(tables, spec)
    if spec is None or spec == SPEC_VERSIONS[-1]:
        return rows
    gone = dropped(spec, "bom")
    rows = rows.where(~F.col("section").isin(*gone, *[s for s, holder in SECTIONS.items() if holder in gone], ""))
    kinds = {s: LISTS[s] for s in LISTS_OF_DOCUMENT} | {"bom": "bom", "tools": "component"}
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("section"))
    # Component rows are pruned before their columns go over their texts.
    done = F.col("section").isin("component", "components", "edges")
    return rows.withColumn("entry", F.when(done, F.col("entry")).otherwise(pruned(F.col("entry"), F.coalesce(kind, F.lit("")), spec)))


def _entries(tables: BomTables, spec: str | None) -> DataFrame:
    c = spec_downgrade(tables.components, spec)
    comp = F.struct(*[F.col(n).alias(_JSON_NAMES.get(n, n)) for n in sc.COMPONENT_FIELDS])
    section = F.when(F.col("is_metadata"), "component").otherwise("components")
    rows = [c.select("bom_id", section.alias("section"), _place(c).alias("ord"), over(_raw(c), comp, _component_type()).alias("entry"))]
    b = tables.boms
    version = F.lit(spec) if spec else F.coalesce("spec_version", F.lit("1.6"))
    about = F.struct(
        version.alias("specVersion"), F.coalesce("bom_format", F.lit("CycloneDX")).alias("bomFormat"),
        F.col("serial_number").alias("serialNumber"), F.coalesce("version", F.lit(1).cast("bigint")).alias("version"),
    )
    text = over(_raw(b), about, "struct<specVersion:string,bomFormat:string,serialNumber:string,version:bigint>")
    meta = over(F.get_json_object(_raw(b), "$.metadata"), F.struct("timestamp"), "struct<timestamp:string>")
    b = b.select("bom_id", F.from_json(text, _MAP).alias("m"), meta.alias("meta"))
    self_ = F.map_concat(F.map_filter("m", lambda k, v: k != "metadata"), F.create_map(F.lit("metadata"), F.try_parse_json("meta")))
    rows.append(b.select("bom_id", F.lit("bom").alias("section"), F.array(F.lit(0).cast("bigint")).alias("ord"), F.to_json(self_).alias("entry")))

    def add(df, section, typed):
        if df is not None:
            entry = F.coalesce(_raw(df), F.to_json(typed))
            rows.append(df.select("bom_id", F.lit(section).alias("section"), _place(df).alias("ord"), entry.alias("entry")))

    t = tables.tools
    if t is not None:
        maker = F.coalesce(*[c for c in ("manufacturer", "vendor") if c in t.columns])
        made = F.struct(
            F.coalesce("type", F.lit("application")).alias("type"), "name", "version",
            F.when(maker.isNotNull(), F.struct(maker.alias("name"))).alias("manufacturer"),
        )
        if spec is not None and later("1.5", spec):  # the form of before
            more = F.from_json(_raw(t), "hashes variant, externalReferences variant")
            old = F.struct(maker.alias("vendor"), "name", "version", more["hashes"].alias("hashes"), more["externalReferences"].alias("externalReferences"))
            add(t.withColumn("raw", F.when(F.col("legacy"), _raw(t))), "legacy tools", old)
        else:  # an old-style tool becomes a component; its own text has the old form
            add(t.withColumn("raw", F.when(~F.col("legacy"), _raw(t))), "tools", made)
    d = tables.dependencies
    if d is not None:
        edge = F.struct("ref", _place(d, "pos").alias("pos"), F.col("depends_on").alias("dependsOn"))
        rows.append(d.select("bom_id", F.lit("edges").alias("section"), _place(d).alias("ord"), F.to_json(edge).alias("entry")))
    add(tables.services, "services", F.struct(F.col("bom_ref").alias("bom-ref"), "name", "version") if tables.services is not None else None)
    add(tables.compositions, "compositions", F.struct("aggregate", "assemblies"))
    add(tables.external_refs, "externalReferences", F.struct("type", "url"))
    v = tables.all_vulnerabilities()
    if v is not None:
        ratings = F.transform(
            "ratings",
            lambda r: F.struct(
                F.struct(r["source"].alias("name")).alias("source"), r["severity"].alias("severity"), r["method"].alias("method"),
            ),
        )
        made = F.struct(
            F.col("bom_ref").alias("bom-ref"),
            F.struct(F.col("source_name").alias("name"), F.col("source_url").alias("url")).alias("source"),
            "description", ratings.alias("ratings"), "advisories",
            F.array(F.struct(F.col("affects").alias("ref"))).alias("affects"),
        )
        add(v if "ord" in v.columns else v.withColumn("ord", F.lit(0)), "vulnerabilities", made)
    return reduce(DataFrame.unionByName, rows)


def documents(tables: BomTables, spec: str | None = None) -> DataFrame:
    """Tables -> (bom_id, name, value): whole JSON documents, for a caller who wants them. Each gathers
    the entries of its BOM in one row; ``entries`` is the form that does not."""
    rows = entries(tables, spec)
    edges = rows.where("section = 'edges'").withColumn("e", F.from_json("entry", "struct<ref:string,pos:array<bigint>,dependsOn:string>"))
    lists = edges.groupBy("bom_id", "e.ref").agg(
        F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.when(F.col("e.dependsOn").isNotNull(), F.struct("e.pos", "e.dependsOn")))).alias("to")
    )
    to = F.transform("to", lambda x: x["dependsOn"])
    lists = lists.select(
        "bom_id", F.lit("dependencies").alias("section"), "ord",
        F.to_json(F.struct("ref", F.when(F.size(to) > 0, to).alias("dependsOn"))).alias("entry"),
    )
    rows = rows.where("section <> 'edges'").unionByName(lists)
    whole = dealt(rows, "bom_id").groupBy("bom_id").agg(F.array_sort(F.collect_list(F.struct("section", "ord", "entry"))).alias("x"))

    def of(section):
        return F.transform(F.filter("x", lambda e: e["section"] == section), lambda e: e["entry"])

    def field_(name, value):
        return F.concat(F.lit(f'"{name}":'), value)

    def list_of(section):
        return F.when(F.size(of(section)) > 0, F.concat(F.lit("["), F.array_join(of(section), ","), F.lit("]")))

    def with_fields(text, fields):
        body = F.regexp_replace(text, r"^\{|\}$", "")
        return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(F.nullif(body, F.lit("")), *fields)), ","), F.lit("}"))

    self_ = F.get(of("bom"), F.lit(0))
    component = F.get(of("component"), F.lit(0))
    about = F.get_json_object(self_, "$.metadata")
    other = F.get_json_object(about, "$.tools")
    own_tools = list_of("legacy tools")  # alone, in documents of before 1.5
    own_tools = F.when(own_tools.isNotNull(), own_tools).when(list_of("tools").isNotNull() | other.isNotNull(), with_fields(F.coalesce(other, F.lit("{}")), [field_("components", list_of("tools"))]))
    rest = lambda text, name: F.to_json(F.map_filter(F.from_json(text, _MAP), lambda k, v: k != name))
    meta = with_fields(rest(about, "tools"), [field_("tools", own_tools), field_("component", component)])
    value = with_fields(rest(self_, "metadata"), [field_("metadata", F.nullif(meta, F.lit("{}"))), *[field_(s, list_of(s)) for s in LISTS_OF_DOCUMENT]])
    return whole.where(self_.isNotNull()).select("bom_id", F.get_json_object(component, "$.name").alias("name"), value.alias("value"))


def write_boms(
    tables: BomTables, path: str, fmt: str = "json", spec: str = "", layout: str = "entries", mode: str = "errorifexists",
    compression: str = "gzip",
) -> None:
    """Write BOMs below ``path``.

    ``layout`` 'entries' (default): JSON lines (bom_id, section, ord, entry), one per entry, whatever the
    size of a BOM. 'lines': one JSON document per line. 'files': one directory per document, named after
    its component (for a moderate number of documents). The latter two gather a BOM in one row. XML has one
    ``bom`` element per line or file, with all fields and all levels of components. Files of entries are compressed:
    entries repeat each other's words, and plain they take several times the disk of their inputs. ``compression``
    is a name that Spark's JSON writer knows, or 'none'.
    """
    actual, version = check_output("out." + resolve_format("", fmt), fmt, spec)
    if actual == "json" and layout == "entries":
        # A compressed file is read by one task, so it holds a bounded number of entries.
        out = entries(tables, version).write.mode(mode).option("compression", compression)
        out.option("maxRecordsPerFile", ENTRIES_PER_FILE).json(path)
        return
    docs = documents(tables, version)
    none = F.lit(None).cast("string")
    named = docs.select(bom_file_name("name", none, none, "." + actual).alias("file_name"), "bom_id", "value")
    if actual == "xml":
        from modelbom.sources.bomxml import xml_from_json

        xml = named.select(*["file_name"] * (layout == "files"), xml_from_json(F.col("value")).alias("value"))
        # Plain lines in files that end with .xml, which the text writer cannot name; nothing is quoted.
        out = xml.write.mode(mode).format("csv").option("extension", "xml").option("sep", "\x01").option("quote", "\x00")
        (out.partitionBy("file_name") if layout == "files" else out).save(path)
    elif layout == "files":
        named.select("file_name", "value").write.mode(mode).partitionBy("file_name").text(path)
    else:
        named.select("value").write.mode(mode).text(path)


def stamp_boms(boms: DataFrame, tool_name: str = "modelbom", tool_version: str = "v0.0.0") -> tuple[DataFrame, DataFrame]:
    """Serial number and timestamp where unset, and a tool entry per BOM: (boms, tools).

    The serial number is a name-based UUID of the id, so it does not change when a plan runs again.
    """
    name = F.sha1(F.concat(F.lit("modelbom/bom/"), "bom_id"))
    digits = F.regexp_replace(name, "^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$", "$1-$2-5$3-8$4-$5")
    stamped = boms.withColumn(
        "serial_number",
        F.coalesce(F.nullif("serial_number", F.lit("")), F.concat(F.lit("urn:uuid:"), digits)),
    ).withColumn(
        "timestamp",
        F.coalesce(
            F.nullif("timestamp", F.lit("")), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
        ),
    )
    none = F.lit(None).cast("string")
    tools = boms.select(
        "bom_id", F.lit(0).cast("bigint").alias("ord"), F.lit(False).alias("legacy"),
        F.lit("application").alias("type"), none.alias("vendor"), none.alias("manufacturer"),
        F.lit(tool_name or "modelbom").alias("name"), F.lit(tool_version or "v0.0.0").alias("version"),
    )
    return stamped, tools
