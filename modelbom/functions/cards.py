"""Card text: front matter, sections and bullets out of Markdown, as columns.

Sections and front-matter blocks are cut on an array of header positions, computed once
per card, instead of by backtracking patterns over the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelbom.functions.text import col, nz, trim, trim_nz

_SP = r"[\t\n\f\r ]"

# Headings and bullet labels of the card templates.
MODEL_SECTIONS = {
    "direct_use": "Direct Use",
    "out_of_scope_use": "Out-of-Scope Use",
    "bias_risks_limitations": "Bias, Risks, and Limitations",
    "bias_recommendations": "Recommendations",
    "model_card_contact": "Model Card Contact",
    "testing_metrics": "Metrics",
    "results": "Results",
}
MODEL_BULLETS = {
    "developed_by": "Developed by",
    "paper_url": "Paper",
    "demo_url": "Demo",
    "hardware_type": "Hardware Type",
    "hours_used": "Hours used",
    "cloud_provider": "Cloud Provider",
    "compute_region": "Compute Region",
    "carbon_emitted": "Carbon Emitted",
}
DATASET_SECTIONS = {
    "dataset_description": "Dataset Description",
    "out_of_scope_use": "Out-of-Scope Use",
    "personal_sensitive_info": "Personal and Sensitive Information",
    "bias_risks_limitations": "Bias, Risks, and Limitations",
    "dataset_card_contact": "Dataset Card Contact",
}
DATASET_BULLETS = {
    "curated_by": "Curated by",
    "funded_by": "Funded by",
    "shared_by": "Shared by",
    "repository_url": "Repository",
    "paper_url": "Paper",
    "demo_url": "Demo",
}


def _plain_ends(text) -> Column:
    """CRLF -> LF; the byte-wise replacement runs only on texts that hold a CR at all."""
    text = col(text)
    return F.when(text.rlike("\r"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)


def card_text(raw) -> Column:
    return trim(_plain_ends(raw))


def front_matter_end(text) -> Column:
    """Where the closing marker's line end is in a card text; NULL without front matter."""
    text = col(text)
    exact, loose = F.locate("\n---\n", text, 5), F.locate("\n---", text, 5)
    end = F.when(exact > 0, exact).when(loose > 0, loose)
    return F.when(text.startswith("---\n"), end)


def split_front_matter(cards: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``_front`` and ``_body``. ``_front`` is NULL without a front-matter block; the body
    then is the whole text, else it starts at the closing marker."""
    staged = cards.select("*", card_text(raw).alias("_text"))
    staged = staged.select("*", front_matter_end("_text").alias("_end"))
    text, end = F.col("_text"), F.col("_end")
    body = F.when(end.isNull(), text).otherwise(trim(F.substring(text, end, F.length(text))))
    return staged.select(
        *cards.columns, F.substring(text, F.lit(5), end - 5).alias("_front"), body.alias("_body")
    )


def text_lines(text) -> Column:
    return F.split(_plain_ends(text), "\n")


def header_positions(lines, pattern: str) -> Column:
    """array<struct(pos, line)> of the lines matching the pattern; pos is 1-based."""
    return F.filter(
        F.transform(col(lines), lambda l, i: F.struct((i + 1).alias("pos"), l.alias("line"))),
        lambda h: h["line"].rlike(pattern),
    )


HEADING = rf"\A#+{_SP}+[^\n]+\z"


def heading_at(headings, heading: str) -> Column:
    """Place of the first level 2-3 heading of that name in the headings, 0 when absent."""
    wanted = rf"\A#{{2,3}}{_SP}+\Q{heading}\E{_SP}*\z"
    flags = F.transform(col(headings), lambda h: h["line"].rlike(wanted))
    return F.array_position(flags, F.lit(True)).cast("int")


def section_at(lines, headings, hit) -> Column:
    """Text between the heading at that place and the next heading."""
    lines, headings, hit = col(lines), col(headings), col(hit)
    start = F.get(headings, hit - 1)["pos"]
    stop = F.coalesce(F.get(headings, hit)["pos"], F.size(lines) + 1)
    inner = F.slice(lines, start + 1, stop - start - 1)
    return F.when(hit > 0, trim_nz(F.array_join(inner, "\n")))


def extract_section(text, heading: str) -> Column:
    lines = text_lines(text)
    headings = header_positions(lines, HEADING)
    return section_at(lines, headings, heading_at(headings, heading))


def extract_bullet(text, label: str) -> Column:
    """Value of the first ``- **Label:** value`` or ``- **Label** note: value`` line."""
    pattern = (
        rf"(?md)^-{_SP}+\*\*\Q{label}\E(?:{_SP}*\[[^\]]+\])?(?::\*\*|\*\*[^:\n]*:)"
        rf"{_SP}*(.+?){_SP}*$"
    )
    return trim_nz(F.regexp_extract(col(text), pattern, 1))


# ---- flat front-matter keys -------------------------------------------------------------

_KEY_LINE = r"\A[^ \t#\-\[\]{}][^\n]*?:(?:[ \t]|\z)"
_ITEM = r"\A[ \t]*-(?:[ \t]|\z)"


def yaml_key_positions(lines) -> Column:
    return header_positions(lines, _KEY_LINE)


def _scalar(text: Column) -> Column:
    """Plain, quoted or commented scalar -> its text; null spellings -> NULL."""
    t = trim(text)
    double = F.regexp_extract(t, r'\A"([^"\\]*+(?:\\.[^"\\]*+)*+)"[ \t]*(?:#.*)?\z', 1)
    single = F.regexp_extract(t, r"\A'([^']*+)'[ \t]*(?:#.*)?\z", 1)
    plain = trim(F.regexp_replace(t, r"(?:\A|[ \t])#.*\z", ""))
    value = (
        F.when(t.startswith('"'), double).when(t.startswith("'"), single).otherwise(plain)
    )
    return nz(F.when(~plain.isin("null", "Null", "NULL", "~"), value))


def _block(lines, keys, key: str) -> Column:
    """struct(head, items): the rest of the key's line and its ``- item`` texts."""
    lines, keys = col(lines), col(keys)
    wanted = rf"\A[\"']?\Q{key}\E[\"']?[ \t]*:(?:[ \t]|\z)"
    places = F.filter(
        F.transform(keys, lambda k, i: F.when(k["line"].rlike(wanted), i)), lambda i: i.isNotNull()
    )

    def block(i):
        found = F.get(keys, i)
        stop = F.coalesce(F.get(keys, i + 1)["pos"], F.size(lines) + 1)
        inner = F.slice(lines, found["pos"] + 1, stop - found["pos"] - 1)
        items = F.transform(
            F.filter(inner, lambda l: l.rlike(_ITEM)), lambda l: F.regexp_replace(l, _ITEM, "")
        )
        head = trim(F.regexp_replace(found["line"], wanted, ""))
        return F.struct(head.alias("head"), items.alias("items"))

    return F.get(F.transform(F.slice(places, F.lit(1), F.lit(1)), block), F.lit(0))


def _inline_list(head: Column) -> Column:
    return F.split(F.regexp_replace(head, r"\A\[|\][ \t]*(?:#.*)?\z", ""), ",")


def block_scalar(block) -> Column:
    block = col(block)
    is_list = block["head"].startswith("[") | (F.size(block["items"]) > 0)
    return F.when(~is_list, trim_nz(_scalar(block["head"])))


def block_list(block) -> Column:
    """Values of a key as a normalised list: scalar, ``[a, b]`` or ``- item`` lines."""
    block = col(block)
    head = block["head"]
    raw = (
        F.when(head.startswith("["), _inline_list(head))
        .when((head == "") | head.startswith("#"), block["items"])
        .otherwise(F.array(head))
    )
    values = F.array_distinct(F.array_compact(F.transform(raw, lambda x: trim_nz(_scalar(x)))))
    return F.get(F.filter(F.array(values), lambda v: F.size(v) > 0), F.lit(0))


def front_matter_unparsed(lines) -> Column:
    """True when the block holds other constructs than flat keys, items and comments."""
    known = r"\A(?:[ \t]*(?:#.*)?|[^ \t#\-\[\]{}&*!|>][^\n]*?:(?:[ \t]+[^&*!|>{].*)?[ \t]*|[ \t]*-[ \t]+[^:{&*!|>]*)\z"
    return F.exists(col(lines), lambda l: ~l.rlike(known))


def with_parts(cards: DataFrame, raw: str = "raw") -> DataFrame:
    """Stage front matter, body, lines, headings and keys, each in its own projection so that
    it is computed once: _front, _body, _lines, _headings, _front_lines, _keys."""
    staged = split_front_matter(cards, raw).select(
        "*", F.split("_front", "\n").alias("_front_lines"), F.split("_body", "\n").alias("_lines")
    )
    return staged.select(
        "*",
        yaml_key_positions("_front_lines").alias("_keys"),
        header_positions("_lines", HEADING).alias("_headings"),
    )


def parse_card(
    cards: DataFrame,
    scalars: dict[str, str],
    lists: dict[str, str],
    sections: dict[str, str],
    bullets: dict[str, str],
    raw: str = "raw",
) -> DataFrame:
    """Card text -> the named front-matter keys, sections and bullets; other columns are kept."""
    keep = [c for c in cards.columns if c != raw]
    keys = {**scalars, **lists}
    parts = with_parts(cards, raw).select(
        "*",
        *[_block("_front_lines", "_keys", key).alias(f"_block_{n}") for n, key in keys.items()],
        *[heading_at("_headings", h).alias(f"_at_{n}") for n, h in sections.items()],
    )
    return parts.select(
        *keep,
        *[block_scalar(f"_block_{n}").alias(n) for n in scalars],
        *[block_list(f"_block_{n}").alias(n) for n in lists],
        *[section_at("_lines", "_headings", f"_at_{n}").alias(n) for n in sections],
        *[extract_bullet("_body", label).alias(n) for n, label in bullets.items()],
        F.coalesce(front_matter_unparsed("_front_lines"), F.lit(False)).alias("fm_unparsed"),
    )


def model_card(cards: DataFrame, raw: str = "raw") -> DataFrame:
    """Card text -> one row of model card fields; all other input columns are kept."""
    return parse_card(
        cards,
        {"license": "license", "base_model": "base_model"},
        {"tags": "tags", "datasets": "datasets", "metrics": "metrics"},
        MODEL_SECTIONS, MODEL_BULLETS, raw,
    )


def dataset_card(cards: DataFrame, raw: str = "raw") -> DataFrame:
    return parse_card(
        cards,
        {"license": "license"},
        {"tags": "tags", "language": "language", "annotation_creators": "annotations_creators"},
        DATASET_SECTIONS, DATASET_BULLETS, raw,
    )
