"""Parsers of user-supplied text. Each gives NULL where the value is not usable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modelbom.functions.text import col, normalize_strings, trim, trim_nz

# Accepted spellings per governance role.
GOVERNANCE_ROLES = {
    "custodians": ["custodian", "custodians"],
    "stewards": ["steward", "stewards", "curated", "curatedby"],
    "owners": ["owner", "owners", "funded", "fundedby"],
}


def _non_empty(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, arr)


def _pieces(value) -> Column:
    """Comma-separated pieces, trimmed, blanks kept; NULL for a blank value."""
    return F.transform(F.split(trim_nz(value), ","), trim)


def parse_tags_keep_empty(value) -> Column:
    return _pieces(value)


def parse_comma_list(value) -> Column:
    return _non_empty(F.filter(_pieces(value), lambda p: p != ""))


def parse_normalized_list(value) -> Column:
    """Distinct non-blank pieces; a blank value gives an empty list, not NULL."""
    return normalize_strings(F.split(col(value), ","))


def parse_dataset_refs(value) -> Column:
    return F.transform(parse_comma_list(value), lambda r: F.struct(r.alias("ref")))


def _pairs(value, first: str, second: str) -> Column:
    """name:value pairs; a piece without colon has an empty second part."""

    def pair(piece):
        name = trim(F.substring_index(piece, ":", 1))
        rest = F.when(
            F.contains(piece, F.lit(":")),
            trim(F.substring(piece, F.instr(piece, ":") + 1, F.length(piece))),
        ).otherwise(F.lit(""))
        return F.struct(name.alias(first), rest.alias(second))

    return F.filter(F.transform(_pieces(value), pair), lambda p: p[first] != "")


def parse_ethics(value) -> Column:
    return _non_empty(_pairs(value, "name", "mitigationStrategy"))


def parse_metrics(value) -> Column:
    return _non_empty(_pairs(value, "type", "value"))


def parse_properties(value) -> Column:
    return _non_empty(F.filter(_pairs(value, "name", "value"), lambda p: p["value"] != ""))


def parse_governance(value) -> Column:
    """struct(custodians, stewards, owners) of organisation names; the last per role wins."""

    def role_org(piece):
        has_role = F.contains(piece, F.lit(":"))
        role = F.when(has_role, F.lower(trim(F.substring_index(piece, ":", 1))))
        org = F.when(has_role, trim(F.substring(piece, F.instr(piece, ":") + 1, F.length(piece))))
        return F.struct(
            F.coalesce(role, F.lit("custodian")).alias("role"), F.coalesce(org, piece).alias("org")
        )

    entries = F.filter(F.transform(_pieces(value), role_org), lambda e: e["org"] != "")

    def last_org(names):
        mine = F.filter(entries, lambda e: e["role"].isin(names))
        return F.try_element_at(F.transform(mine, lambda e: e["org"]), F.lit(-1))

    orgs = {role: last_org(names) for role, names in GOVERNANCE_ROLES.items()}
    any_org = F.coalesce(*orgs.values()).isNotNull()
    return F.when(any_org, F.struct(*[c.alias(role) for role, c in orgs.items()]))
