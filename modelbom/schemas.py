"""Column types of the component tables (DDL). Field names follow the BOM JSON format."""

PROPERTY = "struct<name:string,value:string>"
ORG = "struct<name:string>"
PARTY = "struct<organization:struct<name:string>>"

MODEL_CARD = (
    "struct<"
    "modelParameters:struct<task:string,architectureFamily:string,modelArchitecture:string,"
    "datasets:array<struct<ref:string>>>,"
    "quantitativeAnalysis:struct<performanceMetrics:array<struct<type:string,value:string>>>,"
    "considerations:struct<useCases:array<string>,technicalLimitations:array<string>,"
    "ethicalConsiderations:array<struct<name:string,mitigationStrategy:string>>,"
    f"environmentalConsiderations:struct<properties:array<{PROPERTY}>>>>"
)

DATA = (
    "struct<type:string,description:string,"
    "contents:struct<attachment:struct<contentType:string,content:string>>,"
    "classification:string,sensitiveData:array<string>,"
    f"governance:struct<custodians:array<{PARTY}>,stewards:array<{PARTY}>,owners:array<{PARTY}>>>"
)

# The document part of a component, in output order.
COMPONENT_FIELDS = {
    "bom_ref": "string",
    "type": "string",
    "name": "string",
    "version": "string",
    "group": "string",
    "purl": "string",
    "manufacturer": ORG,
    "authors": "array<struct<name:string,email:string>>",
    "licenses": "array<struct<license:struct<id:string,name:string>>>",
    "hashes": "array<struct<alg:string,content:string>>",
    "external_references": "array<struct<type:string,url:string>>",
    "tags": "array<string>",
    "properties": f"array<{PROPERTY}>",
    "model_card": MODEL_CARD,
    "data": f"array<{DATA}>",
}

# Keys of a component row: its document, its place there, and its parent when nested.
COMPONENT_KEYS = {
    "bom_id": "string", "ord": "bigint", "is_metadata": "boolean", "parent_ref": "string",
}
COMPONENTS = ", ".join(f"`{n}` {t}" for n, t in {**COMPONENT_KEYS, **COMPONENT_FIELDS}.items())

BOMS = (
    "bom_id string, spec_version string, bom_format string, serial_number string, "
    "version bigint, timestamp string"
)

SCANNER = "struct<status:string,message:string,reportLink:string,reportLabel:string>"
PICKLE = (
    "struct<status:string,pickleImports:array<struct<module:string,name:string,safety:string>>,"
    "message:string,version:string>"
)
FILE_STATUS = (
    f"struct<status:string,protectAiScan:{SCANNER},avScan:{SCANNER},pickleImportScan:{PICKLE},"
    f"virusTotalScan:{SCANNER},jFrogScan:{SCANNER}>"
)
SECURITY_ENTRY = (
    "type string, oid string, size bigint, path string, "
    f"lastCommit struct<id:string,title:string,date:string>, securityFileStatus {FILE_STATUS}"
)

HUB_MODEL = (
    "id string, modelId string, author string, pipeline_tag string, library_name string, "
    "tags array<string>, license string, sha string, downloads bigint, likes bigint, "
    "lastModified string, createdAt string, gated string, private boolean, inference string, "
    "usedStorage bigint, cardData string, config struct<model_type:string,architectures:array<string>>"
)
HUB_DATASET = (
    "id string, author string, sha string, lastModified string, createdAt string, "
    "private boolean, gated string, disabled boolean, tags array<string>, description string, "
    "downloads bigint, likes bigint, usedStorage bigint, cardData string"
)

# One row to assemble a model from: what each source contributes. A missing source is a NULL
# struct.
SCAN_FIELDS = {
    "id": "string", "name": "string", "type": "string", "path": "string", "evidence": "string",
    "method": "string",
}
MODEL_API_FIELDS = {
    "id": "string", "model_id": "string", "author": "string", "pipeline_tag": "string",
    "library_name": "string", "tags": "array<string>", "sha": "string", "downloads": "bigint",
    "likes": "bigint", "last_modified": "string", "created_at": "string", "private": "boolean",
    "used_storage": "bigint", "card_data": "variant", "model_type": "string",
    "architectures": "array<string>",
}
DATASET_API_FIELDS = {
    "id": "string", "author": "string", "sha": "string", "last_modified": "string",
    "created_at": "string", "tags": "array<string>", "description": "string",
    "used_storage": "bigint", "card_data": "variant",
}
MODEL_CARD_FIELDS = {
    "license": "string", "tags": "array<string>", "datasets": "array<string>",
    "metrics": "array<string>", "base_model": "string", "developed_by": "string",
    "paper_url": "string", "demo_url": "string", "direct_use": "string",
    "out_of_scope_use": "string", "bias_risks_limitations": "string",
    "bias_recommendations": "string", "model_card_contact": "string", "testing_metrics": "string",
    "results": "string", "hardware_type": "string", "hours_used": "string",
    "cloud_provider": "string", "compute_region": "string", "carbon_emitted": "string",
}
DATASET_CARD_FIELDS = {
    "license": "string", "tags": "array<string>", "language": "array<string>",
    "annotation_creators": "array<string>", "dataset_description": "string",
    "curated_by": "string", "funded_by": "string", "shared_by": "string",
    "repository_url": "string", "paper_url": "string", "demo_url": "string",
    "out_of_scope_use": "string", "personal_sensitive_info": "string",
    "bias_risks_limitations": "string", "dataset_card_contact": "string",
}
SECURITY_FIELDS = {
    "overall": "string", "scanned": "bigint", "unsafe": "bigint", "caution": "bigint",
}
