"""Declared schemas (DDL) for every input and event; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

MANIFEST_COLUMNS = ["repo_id", "provider", "path", "entry_type", "sha", "size", "ref"]

MANIFEST = "repo_id STRING, provider STRING, path STRING, entry_type STRING, sha STRING, size BIGINT, ref STRING"
BLOBS = "repo_id STRING, path STRING, ref STRING, content BINARY"

PROVIDER_LISTING_SCHEMAS = {
    "github": "repo_id STRING, path STRING, type STRING, sha STRING, size BIGINT, url STRING",
    "gitlab": "repo_id STRING, id STRING, name STRING, path STRING, type STRING, mode STRING",
    "bitbucket": "repo_id STRING, path STRING, type STRING, size BIGINT, commit STRUCT<hash: STRING>",
}

COMMITS = ("repo_id STRING, provider STRING, sha STRING, branch STRING, commit_ts TIMESTAMP, author STRING, "
           "message STRING, files ARRAY<STRUCT<filename: STRING, status: STRING, previous_filename: STRING, sha: STRING>>")

EVENTS_RAW = "key STRING, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"

ENVELOPE = "event_type STRING, event_id STRING, timestamp STRING, correlation_id STRING"

EVENT_SCHEMAS = {
    "STREAMED_FILE": ("event_type STRING, repo_id STRING, repo_name STRING, file_path STRING, content STRING, "
                      "url STRING, user_id STRING, is_deleted BOOLEAN"),
    "REPO_UPDATED": (ENVELOPE + ", payload STRUCT<repo_id: STRING, url: STRING, branch: STRING, provider: STRING, "
                     "old_commit: STRING, new_commit: STRING, credential_ref: STRING, update_type: STRING>"),
    "REPO_INGEST_REQUESTED": (ENVELOPE + ", payload STRUCT<repo_id: STRING, url: STRING, branch: STRING, "
                              "provider: STRING, commit_id: STRING, credential_ref: STRING, user_id: STRING, "
                              "organization_id: STRING>"),
    "REPO_INGEST_COMPLETED": (ENVELOPE + ", payload STRUCT<repo_id: STRING, commit_id: STRING, "
                              "stats: STRUCT<files_processed: INT, chunks_created: INT, "
                              "processing_duration_ms: BIGINT, repository_size_bytes: BIGINT>>"),
    "REPO_INGEST_FAILED": (ENVELOPE + ", payload STRUCT<repo_id: STRING, error_code: STRING, "
                           "error_message: STRING, retry_count: INT, fatal: BOOLEAN>"),
    "EMBEDDING_GENERATED": ("headers STRUCT<event_id: STRING, event_type: STRING, timestamp: STRING, "
                            "source_service: STRING, correlation_id: STRING, trace_id: STRING>, "
                            "metadata STRUCT<retry_count: INT, original_event_id: STRING, user_id: STRING, "
                            "tenant_id: STRING>, file_id STRING, source_id STRING, chunk_ids ARRAY<STRING>, "
                            "embedding_model STRING, embedding_dimension INT, total_chunks INT, "
                            "vector_storage_location STRING, processing_time_ms BIGINT"),
}

# Required (non-empty) payload fields per event type, checked by the typed reader.
REQUIRED_FIELDS = {
    "STREAMED_FILE": ["repo_id", "file_path"],
    "REPO_UPDATED": ["payload.repo_id", "payload.provider", "payload.old_commit", "payload.new_commit",
                     "payload.credential_ref"],
    "REPO_INGEST_REQUESTED": ["payload.repo_id", "payload.url"],
    "REPO_INGEST_COMPLETED": ["payload.repo_id"],
    "REPO_INGEST_FAILED": ["payload.repo_id", "payload.error_code"],
    "EMBEDDING_GENERATED": ["file_id", "source_id"],
}

# Payload fields that must be there, but may be empty (an empty file has empty content).
PRESENT_FIELDS = {"STREAMED_FILE": ["content", "repo_name", "url"]}
# Payload fields that default to a value when they are left out.
FIELD_DEFAULTS = {"STREAMED_FILE": {"is_deleted": False}}

DLQ = "failedTopic STRING, failedAt BIGINT, error STRING, event STRING"
WEBHOOK_DELIVERIES = ("delivery_id STRING, provider STRING, source_id STRING, headers MAP<STRING,STRING>, "
                      "body BINARY, received_at TIMESTAMP")


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
