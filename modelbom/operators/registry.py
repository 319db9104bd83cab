"""The field registry: one spec per field, each a set of column builders.

A spec says where a field's value comes from, where it goes, when it counts as present and
how a user-supplied text is read. Operators take ``registry=`` lists, so callers may pass
their own specs; all members are built-in column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from modelbom.functions import semistructured as ss
from modelbom.functions import uservalues as uv
from modelbom.functions.text import (
    external_refs, first_text, group_of, has_property, normalize_dataset_ref,
    normalize_strings, trim, trim_nz,
)

Get = Callable[[str], Column]

MODEL = "BOM.metadata.component."
DATASET = "BOM.components[DATA]."
DATASETS_KEY = MODEL + "modelCard.modelParameters.datasets"


@dataclass(frozen=True)
class FieldSpec:
    """``target`` is a component column or a path into ``model_card`` / ``data``;
    ``prop`` names a property instead. ``keep`` leaves an existing value alone unless a user
    sets it. ``source`` reads the joined row through ``s('api.sha')`` and gives NULL when no
    source has a value; ``present`` reads the component through ``c('tags')``."""

    key: str
    weight: float
    source: Callable[[Get], Column] | None = None
    target: str | None = None
    prop: str | None = None
    keep: bool = False
    required: bool = False
    present: Callable[[Get], Column] | None = None
    parse: Callable[[Column], Column] | None = field(default=trim_nz)
    user_target: Callable[[Column], Column] | None = None

    def is_present(self, c: Get) -> Column:
        test = has_property(c("properties"), self.prop) if self.prop else self.present(c)
        return F.coalesce(test, F.lit(False))


def _filled(path: str) -> Callable[[Get], Column]:
    return lambda c: F.size(c(path)) > 0


def _text(path: str) -> Callable[[Get], Column]:
    return lambda c: trim_nz(c(path)).isNotNull()


def data0(path: str) -> str:
    return "data." + path


# ---- value shapes -----------------------------------------------------------------------


def license_list(name: Column) -> Column:
    entry = F.struct(F.lit(None).cast("string").alias("id"), name.alias("name"))
    return F.when(name.isNotNull(), F.array(F.struct(entry.alias("license"))))


def hash_list(sha: Column) -> Column:
    entry = F.struct(F.lit("SHA-1").alias("alg"), sha.alias("content"))
    return F.when(sha.isNotNull(), F.array(entry))


def org(name: Column) -> Column:
    return F.when(name.isNotNull(), F.struct(name.alias("name")))


def website(url: Column) -> Column:
    entry = F.struct(F.lit("website").alias("type"), url.alias("url"))
    return F.when(url.isNotNull(), F.array(entry))


def author_list(names: Column) -> Column:
    rows = F.transform(
        names, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("email"))
    )
    return F.when(F.size(names) > 0, rows)


def dataset_refs(refs: Column) -> Column:
    return F.when(F.size(refs) > 0, F.transform(refs, lambda r: F.struct(r.alias("ref"))))


def _party(name: Column) -> Column:
    entry = F.struct(F.struct(name.alias("name")).alias("organization"))
    return F.when(name.isNotNull(), F.array(entry))


def governance(custodian: Column, steward: Column, owner: Column) -> Column:
    parties = F.struct(
        _party(custodian).alias("custodians"), _party(steward).alias("stewards"), _party(owner).alias("owners")
    )
    return F.when(F.coalesce(custodian, steward, owner).isNotNull(), parties)


def _non_empty(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, arr)


def _texts(*cols: Column) -> Column:
    return F.array_compact(F.array(*cols))


def _prefixed(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), trim_nz(c))


def _positive(c: Column) -> Column:
    return F.when(c > 0, c.cast("string"))


def attachment(text: Column) -> Column:
    entry = F.struct(F.lit("text/plain").alias("contentType"), text.alias("content"))
    return F.when(trim_nz(text).isNotNull(), F.struct(entry.alias("attachment")))


# ---- sources with more than one step ----------------------------------------------------


def performance_metrics(index_metrics, named, testing, results) -> Column:
    """Model-index metrics, then named metrics of a new type; if none, one section pair."""
    empty = F.array().cast(ss.METRICS_TYPE)
    indexed = F.coalesce(
        F.filter(
            F.transform(
                index_metrics,
                lambda m: F.struct(
                    F.coalesce(trim(m["type"]), F.lit("")).alias("type"),
                    F.coalesce(trim(m["value"]), F.lit("")).alias("value"),
                ),
            ),
            lambda m: (m["type"] != "") | (m["value"] != ""),
        ),
        empty,
    )
    types = F.transform(indexed, lambda m: m["type"])
    extra = F.coalesce(
        F.transform(
            F.filter(normalize_strings(named), lambda n: ~F.array_contains(types, n)),
            lambda n: F.struct(n.alias("type"), F.lit("").alias("value")),
        ),
        empty,
    )
    both = F.concat(indexed, extra)
    t, r = trim_nz(testing), trim_nz(results)
    section = F.array(
        F.struct(
            F.coalesce(t, F.lit("testing_metrics")).alias("type"),
            F.coalesce(r, F.lit("")).alias("value"),
        )
    )
    return F.when(F.size(both) > 0, both).when(t.isNotNull() | r.isNotNull(), section)


def _use_cases(s: Get) -> Column:
    return _non_empty(
        normalize_strings(
            _texts(
                trim_nz(s("card.direct_use")),
                _prefixed("out-of-scope: ", s("card.out_of_scope_use")),
            )
        )
    )


def _ethics(s: Get) -> Column:
    name, mitigation = trim_nz(s("card.bias_risks_limitations")), trim_nz(s("card.bias_recommendations"))
    pair = F.struct(
        F.coalesce(name, F.lit("bias_risks_limitations")).alias("name"),
        F.coalesce(mitigation, F.lit("")).alias("mitigationStrategy"),
    )
    return F.when(name.isNotNull() | mitigation.isNotNull(), F.array(pair))


# Property name -> card field.
ENVIRONMENT = {
    "hardwareType": "hardware_type",
    "hoursUsed": "hours_used",
    "cloudProvider": "cloud_provider",
    "computeRegion": "compute_region",
    "carbonEmitted": "carbon_emitted",
}


def _environment(s: Get) -> Column:
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("name"), trim_nz(s("card." + f)).alias("value"))
            for name, f in ENVIRONMENT.items()
        ]
    )
    return _non_empty(F.filter(pairs, lambda p: p["value"].isNotNull()))


def _training_datasets(s: Get) -> Column:
    listed = ss.extract_datasets(s("api.card_data"), s("api.tags"))
    card = F.transform(normalize_strings(s("card.datasets")), normalize_dataset_ref)
    return F.coalesce(
        F.when(s("api").isNotNull(), dataset_refs(listed)), dataset_refs(card)
    )


def _prop(name: str, weight: float, source: Callable[[Get], Column], base: str = MODEL, parse=trim_nz) -> FieldSpec:
    return FieldSpec(f"{base}properties.{name}", weight, source=source, prop=name, parse=parse)


# Keys, weights and source orders.
MODEL_REGISTRY: list[FieldSpec] = [
    FieldSpec(
        MODEL + "name", 1.0, required=True, target="name", present=_text("name"),
        source=lambda s: first_text(s("scan.name"), s("api.id"), s("api.model_id"), s("model_id")),
    ),
    FieldSpec(
        MODEL + "externalReferences", 0.5, target="external_references",
        present=_filled("external_references"), user_target=website,
        source=lambda s: external_refs(s("model_id"), s("card.paper_url"), s("card.demo_url")),
    ),
    FieldSpec(
        MODEL + "tags", 0.5, target="tags", keep=True, present=_filled("tags"),
        parse=uv.parse_tags_keep_empty,
        source=lambda s: F.coalesce(
            _non_empty(normalize_strings(s("api.tags"))), _non_empty(normalize_strings(s("card.tags")))
        ),
    ),
    FieldSpec(
        MODEL + "licenses", 1.0, target="licenses", keep=True, present=_filled("licenses"),
        user_target=license_list,
        source=lambda s: license_list(
            F.coalesce(ss.extract_license(s("api.card_data"), s("api.tags")), trim_nz(s("card.license")))
        ),
    ),
    FieldSpec(
        MODEL + "hashes", 1.0, target="hashes", present=_filled("hashes"), user_target=hash_list,
        source=lambda s: hash_list(trim_nz(s("api.sha"))),
    ),
    FieldSpec(
        MODEL + "manufacturer", 0.5, target="manufacturer", keep=True,
        present=_text("manufacturer.name"), user_target=org,
        source=lambda s: org(first_text(s("api.author"), s("card.developed_by"))),
    ),
    FieldSpec(
        MODEL + "group", 0.25, target="group", keep=True, present=_text("group"),
        source=lambda s: F.coalesce(
            group_of(s("api.model_id"), s("api.id"), s("model_id")),
            first_text(s("api.author"), s("card.developed_by")),
        ),
    ),
    FieldSpec("modelbom.evidence", 0.0, present=lambda c: F.lit(True), parse=None),
    _prop("huggingface:lastModified", 0.2, lambda s: trim_nz(s("api.last_modified"))),
    _prop("huggingface:createdAt", 0.2, lambda s: trim_nz(s("api.created_at"))),
    _prop("huggingface:language", 0.2, lambda s: ss.extract_language(s("api.card_data"))),
    _prop("huggingface:usedStorage", 0.2, lambda s: _positive(s("api.used_storage"))),
    _prop(
        "huggingface:private", 0.2,
        lambda s: F.when(s("api").isNotNull(), F.coalesce(s("api.private"), F.lit(False)).cast("string")),
    ),
    _prop("huggingface:libraryName", 0.2, lambda s: trim_nz(s("api.library_name"))),
    _prop("huggingface:downloads", 0.2, lambda s: _positive(s("api.downloads"))),
    _prop("huggingface:likes", 0.2, lambda s: _positive(s("api.likes"))),
    _prop("huggingface:baseModel", 0.2, lambda s: trim_nz(s("card.base_model"))),
    _prop("huggingface:modelCardContact", 0.2, lambda s: trim_nz(s("card.model_card_contact"))),
    FieldSpec(
        MODEL + "modelCard.modelParameters.task", 1.0, keep=True,
        target="model_card.modelParameters.task", present=_text("model_card.modelParameters.task"),
        source=lambda s: first_text(s("api.pipeline_tag"), s("card.task_type")),
    ),
    FieldSpec(
        MODEL + "modelCard.modelParameters.architectureFamily", 0.5,
        target="model_card.modelParameters.architectureFamily",
        present=_text("model_card.modelParameters.architectureFamily"),
        source=lambda s: trim_nz(s("api.model_type")),
    ),
    FieldSpec(
        MODEL + "modelCard.modelParameters.modelArchitecture", 0.5,
        target="model_card.modelParameters.modelArchitecture",
        present=_text("model_card.modelParameters.modelArchitecture"),
        source=lambda s: trim_nz(F.get(s("api.architectures"), F.lit(0))),
    ),
    FieldSpec(
        DATASETS_KEY, 0.5, target="model_card.modelParameters.datasets", keep=True,
        present=lambda c: F.exists(
            c("model_card.modelParameters.datasets"), lambda d: trim_nz(d["ref"]).isNotNull()
        ),
        parse=uv.parse_dataset_refs, source=_training_datasets,
    ),
    FieldSpec(
        MODEL + "modelCard.considerations.useCases", 0.5, keep=True,
        target="model_card.considerations.useCases",
        present=_filled("model_card.considerations.useCases"),
        parse=uv.parse_comma_list, source=_use_cases,
    ),
    FieldSpec(
        MODEL + "modelCard.considerations.technicalLimitations", 0.5, keep=True,
        target="model_card.considerations.technicalLimitations",
        present=_filled("model_card.considerations.technicalLimitations"),
        parse=uv.parse_comma_list,
        source=lambda s: _non_empty(_texts(trim_nz(s("card.bias_risks_limitations")))),
    ),
    FieldSpec(
        MODEL + "modelCard.considerations.ethicalConsiderations", 0.25, keep=True,
        target="model_card.considerations.ethicalConsiderations",
        present=_filled("model_card.considerations.ethicalConsiderations"),
        parse=uv.parse_ethics, source=_ethics,
    ),
    FieldSpec(
        MODEL + "modelCard.quantitativeAnalysis.performanceMetrics", 0.5, keep=True,
        target="model_card.quantitativeAnalysis.performanceMetrics",
        present=_filled("model_card.quantitativeAnalysis.performanceMetrics"),
        parse=uv.parse_metrics,
        source=lambda s: performance_metrics(
            s("card.index_metrics"), s("card.metrics"), s("card.testing_metrics"), s("card.results")
        ),
    ),
    FieldSpec(
        MODEL + "modelCard.considerations.environmentalConsiderations.properties", 0.25, keep=True,
        target="model_card.considerations.environmentalConsiderations.properties",
        present=_filled("model_card.considerations.environmentalConsiderations.properties"),
        parse=uv.parse_properties, source=_environment,
    ),
    _prop("huggingface:security:overallStatus", 0.3, lambda s: s("sec.overall")),
    _prop("huggingface:security:scannedFileCount", 0.2, lambda s: s("sec.scanned").cast("string")),
    _prop("huggingface:security:unsafeFileCount", 0.2, lambda s: s("sec.unsafe").cast("string")),
    _prop("huggingface:security:cautionFileCount", 0.2, lambda s: s("sec.caution").cast("string")),
]


def _all_authors(s: Get) -> Column:
    creators = F.coalesce(s("card.annotation_creators"), F.array().cast("array<string>"))
    return F.array_compact(F.concat(F.array(trim_nz(s("api.author"))), F.transform(creators, trim_nz)))


def _attachment_lines(s: Get) -> Column:
    def lines(cfg):
        return F.transform(
            cfg["data_files"],
            lambda d: F.concat(
                F.lit("config:"), cfg["name"], F.lit(" split:"), d["split"], F.lit(" path:"), d["path"]
            ),
        )

    every = F.flatten(F.transform(s("card.configs"), lines))
    return F.when(F.size(every) > 0, F.array_join(every, "\n"))


def _sensitive(s: Get) -> Column:
    tags = ss.at(s("api.card_data"), "$.tags")
    listed = F.when(ss.is_list(tags), ss.strings_in(tags))
    notes = _texts(
        _prefixed("out-of-scope: ", s("card.out_of_scope_use")),
        _prefixed("personal-info: ", s("card.personal_sensitive_info")),
        _prefixed("bias-risks: ", s("card.bias_risks_limitations")),
    )
    return _non_empty(F.concat(F.coalesce(listed, F.array().cast("array<string>")), notes))


def _classification(s: Get) -> Column:
    cats = ss.at(s("api.card_data"), "$.task_categories")
    return F.when(ss.is_list(cats), trim_nz(ss.string_only(ss.at(cats, "$[0]"))))


def _dataset_governance(s: Get) -> Column:
    curated = trim_nz(s("card.curated_by"))
    return governance(
        first_text(s("api.author"), s("card.shared_by"), s("card.curated_by")),
        curated,
        trim_nz(s("card.funded_by")),
    )


DATASET_REGISTRY: list[FieldSpec] = [
    FieldSpec(
        DATASET + "name", 1.0, required=True, target="name", present=_text("name"),
        source=lambda s: first_text(s("scan.name"), s("api.id"), s("dataset_id")),
    ),
    FieldSpec(
        DATASET + "externalReferences", 0.5, target="external_references",
        present=_filled("external_references"), user_target=website,
        source=lambda s: external_refs(
            s("dataset_id"), s("card.paper_url"), s("card.demo_url"), kind="dataset"
        ),
    ),
    FieldSpec(
        DATASET + "tags", 0.5, target="tags", keep=True, present=_filled("tags"),
        parse=uv.parse_normalized_list,
        source=lambda s: F.coalesce(
            _non_empty(normalize_strings(s("api.tags"))), _non_empty(normalize_strings(s("card.tags")))
        ),
    ),
    FieldSpec(
        DATASET + "licenses", 0.8, target="licenses", keep=True, present=_filled("licenses"),
        user_target=license_list,
        source=lambda s: license_list(
            F.coalesce(
                trim_nz(s("card.license")), trim_nz(ss.as_string(ss.at(s("api.card_data"), "$.license")))
            )
        ),
    ),
    FieldSpec(
        DATASET + "data.description", 0.7, target=data0("description"),
        present=_text(data0("description")),
        source=lambda s: first_text(s("card.dataset_description"), s("api.description")),
    ),
    FieldSpec(
        DATASET + "manufacturer", 0.6, target="manufacturer", keep=True,
        present=_text("manufacturer.name"), user_target=org,
        source=lambda s: org(
            first_text(s("api.author"), F.get(s("card.annotation_creators"), F.lit(0)))
        ),
    ),
    FieldSpec(
        DATASET + "authors", 0.6, target="authors", keep=True, present=_filled("authors"),
        parse=lambda v: _non_empty(uv.parse_normalized_list(v)), user_target=author_list,
        source=lambda s: author_list(_all_authors(s)),
    ),
    FieldSpec(
        DATASET + "group", 0.4, target="group", keep=True, present=_text("group"),
        source=lambda s: group_of(s("api.id"), s("dataset_id")),
    ),
    FieldSpec(
        DATASET + "data.contents.attachments", 0.5, target=data0("contents"), parse=None,
        present=lambda c: c(data0("contents.attachment")).isNotNull(),
        source=lambda s: attachment(_attachment_lines(s)),
    ),
    FieldSpec(
        DATASET + "data.sensitiveData", 0.6, target=data0("sensitiveData"),
        present=_filled(data0("sensitiveData")), user_target=lambda v: F.when(v.isNotNull(), F.array(v)),
        source=_sensitive,
    ),
    FieldSpec(
        DATASET + "data.classification", 0.6, target=data0("classification"),
        present=_text(data0("classification")), source=_classification,
    ),
    FieldSpec(
        DATASET + "data.governance", 0.7, target=data0("governance"),
        present=lambda c: c(data0("governance")).isNotNull(),
        parse=uv.parse_governance,
        user_target=lambda g: governance(g["custodians"], g["stewards"], g["owners"]),
        source=_dataset_governance,
    ),
    FieldSpec(
        DATASET + "hashes", 0.5, target="hashes", present=_filled("hashes"), user_target=hash_list,
        source=lambda s: hash_list(trim_nz(s("api.sha"))),
    ),
    _prop("huggingface:createdAt", 0.3, lambda s: trim_nz(s("api.created_at")), DATASET),
    _prop("huggingface:usedStorage", 0.3, lambda s: _positive(s("api.used_storage")), DATASET),
    FieldSpec(
        DATASET + "tags.lastModified", 0.3, target="tags+",
        present=lambda c: F.exists(c("tags"), lambda t: t.startswith("lastModified:")),
        user_target=lambda v: F.when(v.isNotNull(), F.array(F.concat(F.lit("lastModified:"), v))),
        source=lambda s: _non_empty(_texts(_prefixed("lastModified:", s("api.last_modified")))),
    ),
    _prop("huggingface:datasetContact", 0.5, lambda s: trim_nz(s("card.dataset_card_contact")), DATASET),
]

# A blank user value for these is accepted and changes nothing.
OPTIONAL_TEXT = {DATASET + "properties.huggingface:createdAt", DATASET + "properties.huggingface:usedStorage"}
