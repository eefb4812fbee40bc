"""Schemas of stored tables."""

from pyspark.sql import types as T

# Fixed values.
EVENT_KINDS = ("Message", "Reasoning", "ToolCall", "ToolResult", "FileChange", "Artifact", "Status", "Error", "Unknown")

SOURCE = "struct<adapter: string, input_sha256: string, relative_path: string, byte_offset: bigint, line: int, json_pointer: string>"
ARTIFACTS = "array<struct<name: string, path: string, sha256: string>>"
EVENTS = (
    "event_id string, run_id string, sequence bigint, ts_text string, timestamp timestamp, kind string, actor string, summary string, "
    f"payload string, tool string, source {SOURCE}, artifacts {ARTIFACTS}, content_sha256 string"
)
RUNS = "run_id string, name string, input_sha256 string, adapter string, adapter_version string, imported_at timestamp"
DIAGNOSTICS = "run_id string, line int, byte_offset bigint, code string, message string"
#: batch: the number of the stream's batch; none for an import of all files at once.
OUTCOMES = "path string, run_id string, outcome string, code string, batch bigint"
EVENT_INDEX = "run_id string, sequence bigint, event_id string, kind string, content_sha256 string"
CONTEXT = "struct<event_id: string, event_text: string, event_kind: string, tool_name: string>"

BINARY_FILES = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])
