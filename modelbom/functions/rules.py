"""Detection rules as data. Patterns are portable: ``\\b`` and ``\\s`` are ASCII here and
are spelled out for Java by :func:`java_pattern`."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Identifier syntax, with optional and with required organisation.
ID = r"[A-Za-z0-9][A-Za-z0-9_.-]*(?:/[A-Za-z0-9][A-Za-z0-9_.-]*)?"
ORG_ID = r"[A-Za-z0-9][A-Za-z0-9_.-]*/[A-Za-z0-9][A-Za-z0-9_.-]*"
QUOTE = "[\"']"

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_WORD_START = f"(?<!{_WORD})"  # the same, where a word character is known to follow
_SPACE = r"[\t\n\f\r ]"
# Any run of characters a line join may fold into one space.
WIDE_SPACE = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]*"


@dataclass(frozen=True)
class Rule:
    """One detection rule.

    ``kind`` selects the texts it applies to, ``pattern`` has the id in group 1, and
    ``trigger`` is a cheap pattern found in every matching text (also in a text joined
    from several lines). Without a trigger every text of the kind is tested.
    """

    kind: str
    method: str
    pattern: str
    trigger: str = ""


def java_pattern(pattern: str) -> str:
    r"""Spell out ASCII ``\b``, RE2's ``\s``, ``.`` and end-of-text ``$`` for java.util.regex."""
    pattern = re.sub(r"\\b(?=\(?(?:\[A-Za-z0-9\]|[A-Za-z0-9_]))", lambda m: _WORD_START, pattern)
    return (
        pattern.replace(r"\b", _BOUNDARY)
        .replace(r"\s", _SPACE)
        .replace("#.*", r"#[^\n]*")
        .replace("?$", r"?\z")
    )


def _call(method: str, name: str, ident: str = ID) -> Rule:
    return Rule("code", method, rf"{name}\(\s*{QUOTE}({ident}){QUOTE}", _token(name))


def _call_kwarg(method: str, name: str, kwarg: str, ident: str = ID) -> Rule:
    return Rule(
        "code", method, rf"{name}\([^)]*?{kwarg}\s*=\s*{QUOTE}({ident}){QUOTE}", _token(name)
    )


def _kwarg(method: str, name: str) -> Rule:
    trigger = name + WIDE_SPACE + "=" + WIDE_SPACE + QUOTE
    return Rule("code", method, rf"\b{name}\s*=\s*{QUOTE}({ORG_ID}){QUOTE}", trigger)


def _token(name: str) -> str:
    return name.replace(r"\b", "") + r"\("


def _json(method: str, key: str, ident: str = ORG_ID) -> Rule:
    return Rule("json", method, rf'"{key}"\s*:\s*"({ident})"', f'"{key}"')


def _field_line(kind: str, method: str, keys: list[str]) -> Rule:
    return Rule(
        kind,
        method,
        rf"^\s*(?:{'|'.join(keys)})\s*:\s*[\"']?({ORG_ID})[\"']?\s*(?:#.*)?$",
        "model|repo_id",
    )


# Configuration keys that name a model.
YAML_KEYS = [
    "model_name_or_path", "pretrained_model_name_or_path", "model_name", "model_checkpoint",
    "base_model", "base_model_name_or_path", "model_id", "model", "repo_id", "hub_model_id",
    "teacher_model_name_or_path", "student_model_name_or_path", "foundation_model", "lm_model",
]
FRONT_MATTER_KEYS = [
    "model", "base_model", "model_id", "model_name", "model_name_or_path", "widget_model",
]

# Method names and what they match, in match order per kind.
RULES: list[Rule] = [
    _call("from_pretrained", r"\.from_pretrained"),
    _call_kwarg("from_pretrained_kwarg", r"\.from_pretrained", "pretrained_model_name_or_path"),
    Rule(
        "code",
        "pipeline_positional",
        rf"\bpipeline\(\s*{QUOTE}[^\"']+{QUOTE}\s*,\s*{QUOTE}({ID}){QUOTE}",
        r"pipeline\(",
    ),
    _call_kwarg("pipeline_model_kwarg", r"\bpipeline", r"\bmodel"),
    _call("hf_hub_download", r"\bhf_hub_download"),
    _call_kwarg("hf_hub_download_kwarg", r"\bhf_hub_download", r"\brepo_id"),
    _call("snapshot_download", r"\bsnapshot_download"),
    _call_kwarg("snapshot_download_kwarg", r"\bsnapshot_download", r"\brepo_id"),
    _call("InferenceClient", r"\bInferenceClient"),
    _call_kwarg("InferenceClient_model_kwarg", r"\bInferenceClient", r"\bmodel"),
    _call("InferenceApi", r"\bInferenceApi"),
    _call("SentenceTransformer", r"\bSentenceTransformer"),
    _call("CrossEncoder", r"\bCrossEncoder"),
    _call_kwarg("HuggingFaceHub_repo_id", r"\bHuggingFaceHub", r"\brepo_id"),
    _call_kwarg("HuggingFaceEndpoint_repo_id", r"\bHuggingFaceEndpoint", r"\brepo_id"),
    _call_kwarg(
        "HuggingFacePipeline_from_model_id", r"\bHuggingFacePipeline\.from_model_id", r"\bmodel_id"
    ),
    _call("evaluate_load", r"\bevaluate\.load", ORG_ID),
    _kwarg("model_kwarg_slash", "model"),
    _kwarg("repo_id_kwarg_slash", "repo_id"),
    _kwarg("model_id_kwarg_slash", "model_id"),
    _field_line("yaml", "yaml_model_field", YAML_KEYS),
    _json("json_name_or_path", "_name_or_path", ID),
    _json("json_model_name_or_path", "model_name_or_path"),
    _json("json_base_model", "base_model"),
    _json("json_model_field", "model"),
    _json("json_repo_id", "repo_id"),
    _field_line("front", "markdown_frontmatter_model", FRONT_MATTER_KEYS),
    Rule("body", "markdown_inline", rf"\b({ORG_ID})\b", "/"),
    Rule(
        "shell",
        "hf_cli_download",
        rf"huggingface-cli\s+download\s+[\"']?({ORG_ID})[\"']?",
        "huggingface-cli",
    ),
    Rule(
        "shell",
        "shell_model_env",
        rf"(?:MODEL(?:_NAME|_ID|_PATH)?|HF_MODEL(?:_ID)?|HUGGINGFACE_MODEL)\s*=\s*[\"']?({ORG_ID})[\"']?",
        "MODEL",
    ),
    Rule(
        "js",
        "js_pipeline_positional",
        rf"\bpipeline\(\s*[\"'][^\"']+[\"']\s*,\s*[\"']({ID})[\"']",
        r"pipeline\(",
    ),
    Rule(
        "js",
        "js_from_pretrained",
        rf"\.from_pretrained\(\s*[\"']({ID})[\"']",
        r"\.from_pretrained\(",
    ),
    Rule(
        "js",
        "js_model_field",
        rf"\bmodel\s*:\s*[\"']({ORG_ID})[\"']",
        "model" + WIDE_SPACE + ":",
    ),
]

# Which kinds of text a file of each class can contain.
CLASS_KINDS = {
    "python": ["code"],
    "notebook": ["code", "front"],
    "yaml": ["yaml"],
    "json": ["json"],
    "markdown": ["front", "body"],
    "shell": ["shell"],
    "js": ["js"],
}


def trigger_of(rules: list[Rule]) -> str | None:
    """One pattern that every text with a hit contains; None when a rule has no trigger."""
    if not rules or any(not r.trigger for r in rules):
        return None
    return "|".join(dict.fromkeys(r.trigger for r in rules))
