"""Schemas of the data model, as DDL strings."""

NOTE = "path string, content binary"
CITATION = "struct<concept_id:string,path:string,index_revision:string,bundle_commit:string>"
ENTRY = (
    "concept_id string, id string, title string, type string, description string, status string, content_category string, "
    f"topic_id string, module_id string, tags array<string>, candidate_status string, heading_title string, body string, citation {CITATION}"
)
POINT = "point_id string, digest_key string, path string, content_sha256 string, vector array<double>"
GRANT = (
    "grant_id string, actor string, task_id string, domains array<string>, capabilities array<string>, privacy_classes array<string>, "
    "issued_by string, issued_at timestamp, expires_at timestamp, max_items int, max_bytes int, credential_sha256 string"
)
BINDING = "note_id string, domain string"
RECORD = (
    "record_version string, writer_contract string, operation_id string, idempotency_hash string, actor string, task_hash string, "
    "target_path string, request_hash string, content_hash string, base_commit string, created_at timestamp, expires_at timestamp, "
    "binding_hash string, state string, attempts int, last_code string, lease_until timestamp, state_changed_at timestamp, envelope binary"
)
EXPORT_ITEM = "struct<path:string,title:string,status:string>"
#: The zones of an export whose items name a path, in order of precedence.
EXPORT_ZONES = ("knowledge_feed", "life_domains", "projects", "development_candidates", "topics")
EXPORT = "schema string, exported_at string, commit string, zones struct<" + ",".join(f"{z}:array<{EXPORT_ITEM}>" for z in EXPORT_ZONES) + ">"
