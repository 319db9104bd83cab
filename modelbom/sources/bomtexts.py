"""The two forms of a BOM document as plain texts: JSON to XML and back, in one pass over a parsed document.

Spark's readers do the parsing: ``to_xml`` gets the normalised text of a VARIANT, ``to_json`` that of the VARIANT which
the XML parser makes of an element, whose texts begin with a mark. Work and memory grow with the text, whatever its depth.
"""

from __future__ import annotations

import base64
import contextlib
import json
import re
import sys

NAMESPACE = "http://cyclonedx.org/schema/bom/"
#: Namespace of the marks on what the tables below do not know.
MARKS = "urn:modelbom:json"

#: JSON list -> name of its XML items, which stand in an element of the list's name.
LISTS = {
    "components": "component", "services": "service", "properties": "property", "hashes": "hash",
    "externalReferences": "reference", "tags": "tag", "authors": "author", "datasets": "dataset",
    "performanceMetrics": "performanceMetric", "useCases": "useCase", "users": "user",
    "technicalLimitations": "technicalLimitation", "performanceTradeoffs": "performanceTradeoff",
    "ethicalConsiderations": "ethicalConsideration", "fairnessAssessments": "fairnessAssessment",
    "custodians": "custodian", "stewards": "steward", "owners": "owner", "compositions": "composition",
    "vulnerabilities": "vulnerability", "ratings": "rating", "advisories": "advisory", "affects": "target",
    "dependencies": "dependency", "assemblies": "assembly", "cwes": "cwe", "endpoints": "endpoint",
    "annotations": "annotation", "lifecycles": "lifecycle", "licenses": "license", "notes": "note",
    "inputs": "input", "outputs": "output",
}
#: JSON lists whose items stand side by side in XML, without an element around them.
REPEATED = ("data", "sensitiveData")
#: Fields that are attributes in XML: element name -> JSON field -> attribute.
ATTRIBUTES = {
    "bom": {"serialNumber": "serialNumber", "version": "version"},
    "component": {"type": "type", "bom-ref": "bom-ref", "mime-type": "mime-type"},
    "service": {"bom-ref": "bom-ref"}, "vulnerability": {"bom-ref": "bom-ref"}, "composition": {"bom-ref": "bom-ref"},
    "annotation": {"bom-ref": "bom-ref"}, "modelCard": {"bom-ref": "bom-ref"}, "license": {"bom-ref": "bom-ref"},
    "organization": {"bom-ref": "bom-ref"}, "property": {"name": "name"}, "hash": {"alg": "alg"}, "reference": {"type": "type"},
    "attachment": {"contentType": "content-type", "encoding": "encoding"}, "dependency": {"ref": "ref"},
    "text": {"contentType": "content-type", "encoding": "encoding"},
}
#: The field that is an element's own text in XML.
TEXTS = {"property": "value", "hash": "content", "attachment": "content", "text": "content"}
#: Numbers and booleans of the format, which XML has as plain text.
NUMBERS = ("score", "cwe")
BOOLEANS = ("modified", "authenticated", "x-trust-boundary")

#: Put before every text before parsing, so that no text is read as a number, a date or a boolean.
TEXT_MARK = ""
#: Documents are walked by recursion, a few calls a level; the parsers take some 1,000 levels.
_MOST_CALLS = 20_000

_FIELDS = {name: {attribute: field for field, attribute in known.items()} for name, known in ATTRIBUTES.items()}
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9._-]*")
_NO_NAME = re.compile(r"xml|x-json\.", re.IGNORECASE)
#: Characters that XML text cannot hold, and the mark of texts.
_UNSAFE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_SPECIAL = re.compile(r'[&<>"\t\n\r]')
_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\t": "&#9;", "\n": "&#10;", "\r": "&#13;"}
_NUMBER = re.compile(r"(0|[1-9][0-9]{0,8})(\.[0-9]{1,6})?")
_JSON_NUMBER = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_WHOLE = re.compile("[0-9]+")
_SPEC = re.compile("/bom/([0-9.]+)")
#: Names whose plain texts stand for other values.
_SETTLED = {"assembly", "dependsOn", *NUMBERS, *BOOLEANS}
_ABSENT = object()


class _Digits(str):
    """A number as its text says it."""


def _parsed(text: str):
    return json.loads(text, strict=False, parse_int=_Digits, parse_float=_Digits, parse_constant=_Digits)


def _shown(value) -> str:
    """JSON text of a parsed value."""
    if isinstance(value, _Digits):
        return value
    if isinstance(value, dict):
        return "{" + ",".join([_shown(k) + ":" + _shown(v) for k, v in value.items()]) + "}"
    if isinstance(value, list):
        return "[" + ",".join([_shown(v) for v in value]) + "]"
    return _encoded(value)


#: The escapes of a VARIANT's text.
_encoded = json.JSONEncoder(ensure_ascii=False).encode


def _is_string(value) -> bool:
    return type(value) is str


def _string(value) -> str | None:
    """A value read as a string: itself, or its text."""
    return value if value is None or _is_string(value) else _shown(value)


# ---- JSON to XML ------------------------------------------------------------------------


def _is_text(value) -> bool:
    return _is_string(value) and _UNSAFE.search(value) is None


def _escaped(string: str) -> str:
    """A string as XML text or attribute value; white space that a parser would change becomes references."""
    if not string.strip(" "):
        return "&#32;" * len(string)
    return _SPECIAL.sub(lambda m: _ESCAPES[m[0]], string)


def _tag(key: str) -> str:
    """The key, or its bytes in hexadecimal digits where XML does not allow it as a name."""
    if _NAME.fullmatch(key) and not _NO_NAME.match(key):
        return key
    return "x-json." + key.encode("utf-8", "replace").hex().upper()


def _element(out: list[str], name: str, flag: str, value) -> None:
    """The XML of one JSON value in an element of its name."""
    if isinstance(value, dict):
        _object_element(out, name, flag, value)
    elif isinstance(value, list):
        _list_element(out, name, flag, value)
    else:
        _scalar_element(out, name, flag, value)


def _scalar_element(out: list[str], name: str, flag: str, value) -> None:
    if _is_string(value):
        if _UNSAFE.search(value):
            kind, text = "base64", base64.b64encode(value.encode("utf-8", "replace")).decode()
        else:
            kind, text = "string" if name in LISTS else "", _escaped(value)
    elif value is None:
        kind, text = "null", ""
    else:
        kind, text = "boolean" if isinstance(value, bool) else "number", _shown(value)
        if name in NUMBERS or name in BOOLEANS:
            kind = ""
    tag = _tag(name)
    mark = f' json:type="{kind}"' if kind else ""
    out.append(f"<{tag}{flag}{mark}>{text}</{tag}>")


def _object_element(out: list[str], name: str, flag: str, fields: dict) -> None:
    """Attributes first, then the own text, then a child element for each other field."""
    tag, known, own_field = _tag(name), ATTRIBUTES.get(name, {}), TEXTS.get(name)
    attributes, others = [], []
    for k, v in fields.items():
        attribute = known.get(k)
        if attribute and _is_text(v):
            attributes.append(f' {attribute}="{_escaped(v)}"')
        elif attribute and name == "bom" and k == "version" and isinstance(v, _Digits) and _WHOLE.fullmatch(v):
            attributes.append(f' {attribute}="{v}"')
        elif not (name == "bom" and k in ("bomFormat", "specVersion") and _is_text(v)):
            others.append((k, v))
    text = ""
    if own_field and attributes:  # own text only beside an attribute: alone it would read as a plain string
        own = fields.get(own_field)
        if _is_text(own) and own and own_field not in known:
            text = _escaped(own)
            others = [(k, v) for k, v in others if k != own_field]
    space = ""
    if name == "bom":
        space = f' xmlns="{NAMESPACE}{_string(fields.get("specVersion")) or ""}" xmlns:json="{MARKS}"'
    mark = ' json:type="object"' if not fields or (name in LISTS and name != "tools") else ""
    out.append(f"<{tag}{space}{flag}{''.join(attributes)}{mark}>{text}")
    for k, v in others:
        if isinstance(v, list) and k not in LISTS and k != "tools":
            if not v:
                out.append(f'<{_tag(k)} json:list="empty"/>')
            elif name == "dependency" and k == "dependsOn" and all([_is_text(i) for i in v]):
                out.extend([f'<dependency ref="{_escaped(i)}"/>' for i in v])
            else:
                for i in v:
                    _element(out, k, "" if k in REPEATED else ' json:list="item"', i)
        else:
            _element(out, k, ' json:list="no"' if k in REPEATED else "", v)
    out.append(f"</{tag}>")


def _list_element(out: list[str], name: str, flag: str, items: list) -> None:
    """Lists stand in an element of their name."""
    tag = _tag(name)
    odd = not items if name == "tools" else name not in LISTS
    out.append(f"<{tag}{flag}{' json:type="list"' if odd else ''}>")
    item = "tool" if name == "tools" else "item" if name in ("licenses", "assemblies") else LISTS.get(name, "item")
    for v in items:
        if name == "licenses" and isinstance(v, dict) and len(v) == 1 and next(iter(v)) in ("license", "expression"):
            ((k, inner),) = v.items()
            _element(out, k, "", inner)
        elif name == "assemblies" and _is_text(v):
            out.append(f'<assembly ref="{_escaped(v)}"/>')
        else:
            _element(out, item, "", v)
    out.append(f"</{tag}>")


def to_xml(text: str | None) -> str | None:
    """XML text of a JSON document text."""
    if text is None:
        return None
    sys.setrecursionlimit(max(sys.getrecursionlimit(), _MOST_CALLS))
    out: list[str] = []
    _element(out, "bom", "", _parsed(text))
    return "".join(out)


# ---- XML to JSON ------------------------------------------------------------------------


def _unmarked(value):
    """A value without the marks of its texts."""
    if isinstance(value, str):
        return value if isinstance(value, _Digits) else value.replace(TEXT_MARK, "")
    if isinstance(value, list):
        return [_unmarked(v) for v in value]
    return {_unmarked(k): _unmarked(v) for k, v in value.items()} if isinstance(value, dict) else value


def _side_by_side(value) -> list:
    """The elements of one name: a list of them, or one alone."""
    return value if isinstance(value, list) else [] if value is _ABSENT else [value]


def _is_mark(key: str) -> bool:
    return key.startswith(("_json:", "_xmlns", "_xsi:"))


def _plain(name: str, kind: str | None, own, fields: dict) -> str | None:
    """The JSON of a value that its kind or name settles."""
    if kind == "null":
        return "null"
    if kind in ("number", "boolean"):
        return _string(own)
    if kind == "base64":
        with contextlib.suppress(ValueError):
            return _encoded(base64.b64decode(_string(own) or "").decode("utf-8", "replace"))
    if name in ("assembly", "dependsOn"):
        ref = fields.get("_ref", _ABSENT)
        return None if ref is _ABSENT else _shown(_unmarked(ref))
    if name in NUMBERS and _NUMBER.fullmatch((_string(own) or "").strip()):
        return _string(own).strip()
    if name in BOOLEANS and _string(own) in ("true", "false"):
        return _string(own)
    return None


def _value(out: list[str], name: str, value) -> None:
    """The JSON of one XML value, as its VARIANT has it."""
    is_object = isinstance(value, dict)
    if not is_object and not isinstance(value, list) and name not in LISTS and name not in _SETTLED:
        out.append(_shown(_unmarked("" if value is None else value)))  # most values are plain texts
        return
    fields = value if is_object else {}
    kind = fields.get("_json:type")
    kind = None if kind is None else _unmarked(_string(kind))
    own = _unmarked(fields.get("_VALUE", "")) if is_object else "" if value is None or isinstance(value, list) else _unmarked(value)
    done = _plain(name, kind, own, fields)
    if done is not None:
        out.append(done)
        return
    tool_list = name == "tools" and "tool" in fields
    if (name in LISTS or tool_list or kind == "list") and kind not in ("object", "string", "number", "boolean", "null"):
        _list(out, name, kind, tool_list, fields)
        return
    if isinstance(value, list):
        out.append("[")
        for i, v in enumerate(value):
            if i:
                out.append(",")
            _value(out, name, v)
        out.append("]")
        return
    shown = [(k, v) for k, v in fields.items() if not _is_mark(k) and not (k == "_VALUE" and own == "")]
    only_text = name != "bom" and kind is None and all([k == "_VALUE" for k, _ in shown])
    if is_object and kind != "string" and not (only_text and (not shown or name not in TEXTS)):
        _object(out, name, shown)
    else:
        out.append(_shown(own))


def _list(out: list[str], name: str, kind: str | None, tool_list: bool, fields: dict) -> None:
    """A list's items: those of its name, or marked ones; licences also stand under other names."""
    item = "item" if kind == "list" else "tool" if tool_list else LISTS[name]
    licences = name == "licenses"
    direct = [] if licences else _side_by_side(fields.get(item, _ABSENT))
    generic = [] if item == "item" else _side_by_side(fields.get("item", _ABSENT))
    makes = [(item, v, False) for v in direct] + [("item", v, False) for v in generic]
    if licences:
        makes += [(k, v, True) for k, held in fields.items() if not k.startswith("_") and k != "item" for v in _side_by_side(held)]
    out.append("[")
    for i, (key, v, held) in enumerate(makes):
        if i:
            out.append(",")
        if held:
            out.append("{" + _encoded(key) + ":")
        _value(out, key, v)
        if held:
            out.append("}")
    out.append("]")


def _json_key(name: str, key: str) -> str:
    if key == "_VALUE":
        return TEXTS.get(name, "_VALUE")
    if key.startswith("_"):
        return _FIELDS.get(name, {}).get(key[1:], key[1:])
    if key.startswith("x-json."):
        try:
            return bytes.fromhex(key[7:]).decode("utf-8", "replace")
        except ValueError:
            return key
    return "dependsOn" if name == "dependency" and key == "dependency" else key


def _object(out: list[str], name: str, shown: list[tuple]) -> None:
    """An object's fields: attributes, own text and child elements."""
    out.append("{")
    for n, (k, v) in enumerate(shown):
        needs = name == "dependency" and k == "dependency"
        out.append("," * (n > 0) + _encoded(_json_key(name, k)) + ":")
        if name == "bom" and k == "_version":
            version = _unmarked(_string(v)) or ""
            out.append(version if _JSON_NUMBER.fullmatch(version) else _encoded(version))
            continue
        child = "dependsOn" if needs else k
        items = _side_by_side(v)
        first = items[0] if items else None
        mark = first.get("_json:list") if isinstance(first, dict) else None
        mark = None if mark is None else _unmarked(_string(mark))
        many = (isinstance(v, list) or k in REPEATED or mark is not None) and k not in LISTS and mark != "no"
        if not (needs or many):
            _value(out, child, v)
            continue
        out.append("[")
        for i, x in enumerate([] if mark == "empty" else items):
            if i:
                out.append(",")
            _value(out, child, x)
        out.append("]")
    out.append("}")


def to_json(text: str | None) -> str | None:
    """JSON document text of the text of a VARIANT which the XML parser made of a ``bom`` element."""
    if text is None:
        return None
    sys.setrecursionlimit(max(sys.getrecursionlimit(), _MOST_CALLS))
    parsed = _parsed(text)
    out: list[str] = []
    _value(out, "bom", parsed)
    rest = "".join(out).removeprefix("{")
    space = parsed.get("_xmlns") if isinstance(parsed, dict) else None
    spec = _SPEC.search(space) if isinstance(space, str) else None
    head = '{"bomFormat":"CycloneDX"' + (f',"specVersion":"{spec[1]}"' if spec else "")
    return head + ("" if rest == "}" else ",") + rest
