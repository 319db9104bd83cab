"""String predicates and projections on single columns (no shuffle, no UDF)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space.
WHITESPACE = "".join(
    map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Directories which are never scanned.
SKIPPED_DIRS = [
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "env", ".env",
    ".tox", "dist", "build", "_build", "site-packages", ".mypy_cache", ".pytest_cache",
    ".ruff_cache",
]

# File extension -> class.
EXTENSION_CLASS = {
    "python": ["py"],
    "notebook": ["ipynb"],
    "yaml": ["yaml", "yml"],
    "json": ["json"],
    "markdown": ["md", "rst"],
    "shell": ["sh", "bash", "zsh"],
    "js": ["js", "ts", "mjs", "cjs", "jsx", "tsx"],
}

# Specification versions in order.
SPEC_VERSIONS = ["1.0", "1.1", "1.2", "1.3", "1.4", "1.5", "1.6"]

HUB_URL = "https://huggingface.co/"
MODEL_PURL = "pkg:huggingface/"
DATASET_PURL = "pkg:huggingface/datasets/"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. Inside lambdas nothing else keeps an expression from running at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(c: Column | str) -> Column:
    """Strip Unicode white space (Spark's own ``trim`` strips only spaces)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def nz(c: Column | str) -> Column:
    """Empty string -> NULL, without trimming."""
    return F.nullif(col(c), F.lit(""))


def trim_nz(c: Column | str) -> Column:
    """Trimmed text, or NULL when nothing is left."""
    return nz(trim(c))


def first_text(*cols: Column | str) -> Column:
    """First column with non-blank text, trimmed."""
    return F.coalesce(*[trim_nz(c) for c in cols])


def classify_file(path: Column | str) -> Column:
    """Rule class of a file: the extension decides first, then the file name."""
    name = F.lower(F.substring_index(col(path), "/", -1))
    ext = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))
    lookup = F.create_map(
        *[F.lit(x) for cls, exts in EXTENSION_CLASS.items() for e in exts for x in (e, cls)]
    )
    docker = (
        name.isin("dockerfile", "containerfile")
        | name.startswith("dockerfile.")
        | name.startswith("docker-compose")
    )
    by_name = F.when(docker, F.lit("shell")).otherwise(F.lit("unknown"))
    return F.coalesce(F.try_element_at(lookup, ext), by_name)


def skip_path(path: Column | str) -> Column:
    """True when a directory on the path (not the file itself) is a skipped one."""
    parts = F.split(col(path), "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIPPED_DIRS]))


def plausible_id(c: Column | str) -> Column:
    c = col(c)
    size = F.octet_length(c)
    version_like = c.rlike(r"^[0-9]+\.[0-9]+") & ~c.rlike(r"[A-Za-z_-]")
    local = c.startswith("./") | c.startswith("../") | c.startswith("/")
    return (size >= 2) & (size <= 200) & ~version_like & ~local


def parse_spec_version(c: Column | str) -> Column:
    """struct(version, valid); unknown text gives ('1.6', false)."""
    v = trim(c)
    valid = F.coalesce(v.isin(SPEC_VERSIONS), F.lit(False))
    return F.struct(
        F.when(valid, v).otherwise(F.lit("1.6")).alias("version"), valid.alias("valid")
    )


def bom_file_name(name, disc_name, disc_id, ext=".json") -> Column:
    chosen = F.coalesce(
        F.when(trim_nz(name).isNotNull(), col(name)), trim_nz(disc_name), trim_nz(disc_id), F.lit("model")
    )
    return F.concat(F.regexp_replace(chosen, r"[^A-Za-z0-9._-]", "_"), F.lit("_aibom" + ext))


def purl(type_, name, sha, existing=None) -> Column:
    """Package URL from component type, name and first hash; an existing one is kept."""
    escaped = F.transform(
        F.split(trim(name), "/"),
        lambda s: F.replace(F.replace(trim(s), F.lit("@"), F.lit("%40")), F.lit(" "), F.lit("%20")),
    )
    ident = F.coalesce(nz(F.when(trim_nz(name).isNotNull(), F.array_join(escaped, "/"))), F.lit("unknown"))
    prefix = (
        F.when(col(type_) == "machine-learning-model", F.lit(MODEL_PURL))
        .when(col(type_) == "data", F.lit(DATASET_PURL))
        .otherwise(F.lit(MODEL_PURL + "unknown/"))
    )
    version = F.lower(trim_nz(sha))
    made = F.concat(prefix, ident, F.coalesce(F.concat(F.lit("@"), version), F.lit("")))
    return made if existing is None else F.coalesce(nz(existing), made)


def bom_ref(existing, purl_) -> Column:
    return F.coalesce(nz(existing), nz(purl_), F.concat(F.lit("urn:uuid:"), F.uuid()))


def identity_ref(ref, type_, name, version) -> Column:
    """Component identity: its reference, else type/name/version, else ''."""
    return F.coalesce(nz(ref), F.concat_ws("/", nz(type_), nz(name), nz(version)))


def tool_key(name, version) -> Column:
    return F.concat(F.coalesce(col(name), F.lit("")), F.lit("@"), F.coalesce(col(version), F.lit("")))


def _purl_rest(purl_, prefix: str) -> Column:
    tail = F.substring(col(purl_), len(prefix) + 1, 1 << 30)
    return F.when(col(purl_).startswith(prefix), F.substring_index(tail, "@", 1))


def model_id_from_component(purl_, name) -> Column:
    rest = _purl_rest(purl_, MODEL_PURL)
    return F.coalesce(F.when(F.contains(rest, F.lit("/")), rest), trim(name))


def dataset_id_from_component(purl_, name) -> Column:
    plain = trim(name)
    stripped = F.when(
        plain.startswith("datasets/"), F.substring(plain, len("datasets/") + 1, 1 << 30)
    ).otherwise(plain)
    return F.coalesce(nz(_purl_rest(purl_, DATASET_PURL)), stripped)


def group_of(*ids) -> Column:
    """Part before the first '/' of the first non-blank id."""
    return trim_nz(F.substring_index(first_text(*ids), "/", 1))


def external_refs(ident, paper, demo, kind="model", base: str = HUB_URL) -> Column:
    base = base.strip() or HUB_URL
    base = base if base.endswith("/") else base + "/"
    if kind == "dataset":
        base += "datasets/"
    ident = trim_nz(ident)
    bare = F.when(ident.startswith("/"), F.substring(ident, 2, 1 << 30)).otherwise(ident)

    def ref(kind_, url):
        return F.struct(F.lit(kind_).alias("type"), url.alias("url"))

    refs = F.array(
        ref("website", F.concat(F.lit(base), bare)),
        ref("documentation", trim_nz(paper)),
        ref("other", trim_nz(demo)),
    )
    return F.when(ident.isNotNull(), F.filter(refs, lambda r: r["url"].isNotNull()))


def normalize_dataset_ref(c) -> Column:
    """Prefix ``dataset:`` unless already so prefixed."""
    v = trim_nz(c)
    return F.when(v.startswith("dataset:"), v).otherwise(F.concat(F.lit("dataset:"), v))


def dataset_ref_tag(c) -> Column:
    """Prefix ``dataset:`` unless the value holds any colon."""
    v = trim_nz(c)
    return F.when(F.contains(v, F.lit(":")), v).otherwise(F.concat(F.lit("dataset:"), v))


def score_band(score) -> Column:
    s = col(score)
    return F.when(s >= 0.8, "good").when(s >= 0.5, "warning").otherwise("bad")


def score_percent(score) -> Column:
    return F.format_string("%.1f%%", F.bround(col(score) * 100, 1))


def normalize_strings(arr) -> Column:
    """Trim, drop blanks, keep the first of equal values (order kept)."""
    return F.array_distinct(F.array_compact(F.transform(col(arr), trim_nz)))


def property_entry(name, value) -> Column:
    """One-element property list, or an empty one when either side is blank."""
    n, v = trim_nz(name), trim_nz(value)
    empty = F.array().cast("array<struct<name:string,value:string>>")
    return F.when(
        n.isNotNull() & v.isNotNull(), F.array(F.struct(n.alias("name"), v.alias("value")))
    ).otherwise(empty)


def set_property(props, name, value) -> Column:
    empty = F.array().cast("array<struct<name:string,value:string>>")
    return F.concat(F.coalesce(col(props), empty), property_entry(name, value))


def has_property(props, name: str) -> Column:
    return F.coalesce(
        F.exists(
            col(props),
            lambda p: (trim(p["name"]) == name.strip()) & trim_nz(p["value"]).isNotNull(),
        ),
        F.lit(False),
    )
