"""Entries of an older specification version: fields that came later go, at any depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modelbom.functions.text import SPEC_VERSIONS
from modelbom.sources.bomxml import LISTS
from modelbom.sources.rewriting import PIECES, piece, rewrite

#: The version that brought a field, by the kind of object that holds it.
SINCE = {
    "bom": {
        "serialNumber": "1.1", "externalReferences": "1.1", "metadata": "1.2", "services": "1.2", "dependencies": "1.2",
        "compositions": "1.3", "vulnerabilities": "1.4", "annotations": "1.5", "formulation": "1.5", "properties": "1.5",
        "declarations": "1.6", "definitions": "1.6",
    },
    "metadata": {"licenses": "1.3", "properties": "1.3", "lifecycles": "1.5", "manufacturer": "1.6"},
    "component": {
        "bom-ref": "1.1", "externalReferences": "1.1", "pedigree": "1.1", "author": "1.2", "mime-type": "1.2",
        "supplier": "1.2", "swid": "1.2", "evidence": "1.3", "properties": "1.3", "releaseNotes": "1.4", "modelCard": "1.5",
        "data": "1.5", "tags": "1.6", "manufacturer": "1.6", "authors": "1.6", "omniborId": "1.6", "swhid": "1.6",
        "cryptoProperties": "1.6",
    },
    "service": {"properties": "1.3", "releaseNotes": "1.4", "trustZone": "1.5", "tags": "1.6"},
    "license": {"bom-ref": "1.5", "licensing": "1.5", "properties": "1.5", "acknowledgement": "1.6"},
    "reference": {"hashes": "1.3"},
    "evidence": {"identity": "1.5", "occurrences": "1.5", "callstack": "1.5"},
    "composition": {"bom-ref": "1.5", "vulnerabilities": "1.5"},
    "vulnerability": {"proofOfConcept": "1.5", "workaround": "1.5", "rejected": "1.5"},
    "dependency": {"provides": "1.6"},
    "considerations": {"environmentalConsiderations": "1.6"},
}
#: Component types that came after the first version; before, such a component is an application.
TYPES_SINCE = {
    "container": "1.2", "firmware": "1.2", "data": "1.5", "device-driver": "1.5", "machine-learning-model": "1.5",
    "platform": "1.5", "cryptographic-asset": "1.6",
}
#: Entry sections and the list they stand in.
SECTIONS = {"edges": "dependencies", "legacy tools": "metadata", "tools": "metadata", "component": "metadata"}


def later(version: str, spec: str) -> bool:
    return SPEC_VERSIONS.index(version) > SPEC_VERSIONS.index(spec)


def dropped(spec: str, kind: str) -> list[str]:
    """Fields of a kind of object that ``spec`` does not have yet."""
    return [f for f, v in SINCE.get(kind, {}).items() if later(v, spec)]


def component_type(type_: Column, spec: str) -> Column:
    new = [t for t, v in TYPES_SINCE.items() if later(v, spec)]
    return F.when(type_.isin(*new), F.lit("application")).otherwise(type_) if new else type_


def pruned(text: Column, kind: Column, spec: str | None) -> Column:
    """A JSON text of ``kind`` without the fields, its own and those of all it holds, that came after ``spec``."""
    if spec is None or spec == SPEC_VERSIONS[-1]:
        return text
    gone = [f"{k} {f}" for k in SINCE for f in dropped(spec, k)]
    types = [t for t, v in TYPES_SINCE.items() if later(v, spec)]

    def expand(p: Column) -> Column:
        name, value = p["name"], p["text"]
        pairs = F.map_entries(F.from_json(value, "map<string,variant>"))
        fields = F.filter(pairs, lambda f: ~F.concat_ws(" ", name, f["key"]).isin(*gone))
        item = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LISTS.items() for x in kv]), name), name)
        items = F.transform(F.try_variant_get(F.try_parse_json(value), "$", "array<variant>"), lambda v: F.to_json(v))

        def field(f, i):
            old = (name == "component") & (f["key"] == "type") & F.to_json(f["value"]).isin(*[f'"{t}"' for t in types])
            key = F.concat(F.when(i > 0, ",").otherwise(""), F.regexp_replace(F.to_json(F.array(f["key"])), r"^\[|\]$", ""), F.lit(":"))
            kept = F.when(old, piece(True, F.lit('"application"'))).otherwise(piece(False, F.to_json(f["value"]), f["key"]))
            return F.array(piece(True, key), kept)

        object_ = F.concat(F.array(piece(True, F.lit("{"))), F.flatten(F.transform(fields, field)), F.array(piece(True, F.lit("}"))))
        inside = F.transform(items, lambda x, i: F.array(piece(True, F.when(i > 0, ",").otherwise("")), piece(False, x, item)))
        list_ = F.concat(F.array(piece(True, F.lit("["))), F.flatten(inside), F.array(piece(True, F.lit("]"))))
        return (
            F.when(value.startswith("{"), object_.cast(PIECES)).when(value.startswith("["), list_.cast(PIECES))
            .otherwise(F.array(piece(True, value)).cast(PIECES))
        )

    return rewrite(text, kind, expand)
