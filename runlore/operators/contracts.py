"""Contracts of datasets: candidates, examples, teacher labels and manifests, as checks over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strict_json
from ..sources import stores
from .audit import SHA256, _codes
from .candidates import _NOT_EMPTY, CATEGORIES, FIELDS, SCHEMA_VERSION, _plain, by_row, canonical_by_spark, identity, spelled_alike

# Fixed values.
LABELS = ("Explore", "Plan", "Execute", "Verify", "Recover", "Unknown")
STATUSES = ("rule_derived", "teacher_single", "teacher_consensus", "judge_resolved", "synthetic_invariant", "quarantined")
TEACHER_STATUSES = ("teacher_single", "teacher_consensus", "judge_resolved")
SPLITS = ("train", "validation", "test")
TEACHER_FIELDS = ("teacher_model", "teacher_revision", "prompt_version", "prompt_hash", "request_hash", "response_hash")


def _unique(ids: Column) -> Column:
    return F.size(F.array_distinct(ids)) == F.size(ids)


def observable_ids() -> Column:
    """Ids of a candidate's own and context events."""
    ids = lambda side: F.transform(side, lambda c: c["event_id"])
    return F.concat(ids("context_before"), F.array("event_id"), ids("context_after"))


def _identities() -> Column:
    """The hash of each candidate's canonical JSON, which is json where alike holds."""

    @F.pandas_udf("string")
    def made(known: pd.Series, rows: pd.DataFrame) -> pd.Series:
        return by_row(known, rows, lambda r: identity(_plain(r)))

    rare = made("alike", F.when(~F.col("alike"), F.struct(*FIELDS)))
    return F.when(F.col("alike"), F.sha2("json", 256)).otherwise(rare)


def _sound_candidate() -> dict[str, Column]:
    filled = [F.length(f) > 0 for f in _NOT_EMPTY]
    every = filled[0]
    for f in filled[1:]:
        every = every & f
    return {
        "SCHEMA_VERSION": F.col("schema_version") == SCHEMA_VERSION, "EMPTY_FIELD": every & F.col("event_text").isNotNull(),
        "SOURCE_CATEGORY": F.col("source_category").isin(*CATEGORIES), "SOURCE_HASH": F.col("source_hash").rlike(SHA256),
        "EVENT_IDS": _unique(observable_ids()),
    }


def validate_candidates(candidates: DataFrame) -> DataFrame:
    """example_id and violations of each candidate; EXAMPLE_ID where the id is not that of the content."""
    checks = _sound_candidate() | {"EXAMPLE_ID": F.col("example_id") == F.col("recomputed")}
    rows = candidates.withColumn("json", canonical_by_spark()).withColumn("alike", spelled_alike(F.col("json")))
    return rows.withColumn("recomputed", _identities()).select("example_id", _codes(checks).alias("violations"))


def example_checks() -> dict[str, Column]:
    evidence = F.col("evidence_event_ids")
    given = [F.col(f).isNotNull() for f in TEACHER_FIELDS]
    every, any_ = given[0], given[0]
    for g in given[1:]:
        every, any_ = every & g, any_ | g
    quarantined = F.col("label_status") == "quarantined"
    labelled = [F.col(f).isNotNull() for f in ("label", "confidence", "observable_reason", "split")]
    complete = labelled[0] & labelled[1] & labelled[2] & labelled[3] & (F.size(evidence) > 0) & F.col("quarantine_reason").isNull()
    bare = ~(labelled[0] | labelled[1] | labelled[2] | labelled[3]) & (F.size(evidence) == 0) & F.col("quarantine_reason").isNotNull()
    teacher = F.when(quarantined, every | ~any_).when(F.col("label_status").isin(*TEACHER_STATUSES), every).otherwise(~any_)
    optional = lambda c, ok: F.col(c).isNull() | ok
    return {
        "LABEL_STATUS": F.col("label_status").isin(*STATUSES), "STATE": F.when(quarantined, bare).otherwise(complete), "PROVENANCE": teacher,
        "EVIDENCE": _unique(evidence) & (F.size(F.array_except(evidence, observable_ids())) == 0),
        "LABEL": optional("label", F.col("label").isin(*LABELS)), "SPLIT": optional("split", F.col("split").isin(*SPLITS)),
        "CONFIDENCE": optional("confidence", F.col("confidence").between(0, 1)),
    }


def validate_examples(examples: DataFrame) -> DataFrame:
    """example_id and violations of each example."""
    return examples.select("example_id", _codes(example_checks()).alias("violations"))


def validate_teacher_labels(labels: DataFrame) -> DataFrame:
    """example_id and violations of each teacher label: exactly one of accepted and abstained, and what goes with it."""
    evidence, available = F.col("evidence_event_ids"), F.col("available_event_ids")
    has = lambda c: F.col(c).isNotNull()
    accepted = has("label") & has("confidence") & (F.size(evidence) > 0) & has("observable_reason") & ~has("quarantine_reason")
    abstained = ~has("label") & ~has("confidence") & (F.size(evidence) == 0) & ~has("observable_reason") & has("quarantine_reason")
    checks = {
        "EXAMPLE_ID": F.col("example_id").rlike(SHA256), "DECISION": F.col("accepted") != F.col("abstained"),
        "COMPLETE": F.when(F.col("accepted"), accepted).otherwise(abstained), "AVAILABLE": (F.size(available) > 0) & _unique(available),
        "EVIDENCE": _unique(evidence) & (F.size(F.array_except(evidence, available)) == 0),
        "LABEL": F.col("label").isNull() | F.col("label").isin(*LABELS), "CONFIDENCE": F.col("confidence").isNull() | F.col("confidence").between(0, 1),
    }
    return labels.select("example_id", _codes(checks).alias("violations"))


def assemble_examples(candidates: DataFrame, labels: DataFrame, provenance: dict[str, str], created_at: Column, split: Column) -> DataFrame:
    """Candidates with their teacher labels: accepted ones carry the label, all others are quarantined. provenance:
    values of TEACHER_FIELDS. split: of an accepted example; one label per candidate."""
    own = labels.select(
        F.col("example_id").alias("of"), "accepted", "label", "confidence", "evidence_event_ids", "observable_reason", F.col("quarantine_reason").alias("why")
    )
    rows = candidates.join(own, F.col("example_id") == F.col("of"), "left")
    yes = F.coalesce("accepted", F.lit(False))
    made = {c: F.when(yes, F.col(c)) for c in ("label", "confidence", "observable_reason")}
    made |= {
        "evidence_event_ids": F.when(yes, F.col("evidence_event_ids")).otherwise(F.array().cast("array<string>")), "split": F.when(yes, split),
        "label_status": F.when(yes, "teacher_single").otherwise("quarantined"),
        "quarantine_reason": F.when(~yes, F.coalesce("why", F.lit("no teacher label"))), "created_at": created_at,
    }
    made |= {k: F.when(F.col("of").isNotNull(), F.lit(v)) for k, v in provenance.items()}
    return rows.withColumns(made).drop("of", "accepted", "why")


def build_manifest(examples: DataFrame, requested: int, retried: int = 0) -> DataFrame:
    """One row: six maps of counts with every category, and lifecycle counts. One aggregation with grouping sets over
    the examples; categories come from fixed lists."""
    q = F.col("label_status") == "quarantined"
    rows = examples.select(
        F.when(~q, F.col("split")).alias("split"), F.col("source_category").alias("source"), F.col("label_status").alias("status"),
        F.when(~q, F.col("label")).alias("label"), q.alias("q"),
    )
    sets = [["split"], ["source"], ["split", "source"], ["q", "source"], ["status"], ["label"], ["q"]]
    keys = ["split", "source", "status", "label", "q"]
    counts = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    id_of = lambda s: sum(0 if c in s else 1 << (len(keys) - 1 - i) for i, c in enumerate(keys))
    at = lambda s: F.col("g") == id_of(s)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    def counted(s: list[str], column: str, categories: tuple[str, ...], more: Column | None = None) -> Column:
        own = at(s) if more is None else at(s) & more
        return F.create_map(*[x for c in categories for x in (F.lit(c), total(own & (F.col(column) == c)))])

    by_split = F.create_map(*[x for s in SPLITS for x in (F.lit(s), counted(["split", "source"], "source", CATEGORIES, F.col("split") == s))])
    return counts.agg(
        counted(["split"], "split", SPLITS).alias("split_counts"), counted(["source"], "source", CATEGORIES).alias("source_counts"),
        by_split.alias("split_source_counts"), counted(["q", "source"], "source", CATEGORIES, F.col("q")).alias("quarantined_source_counts"),
        counted(["status"], "status", STATUSES).alias("status_counts"), counted(["label"], "label", LABELS).alias("class_counts"),
        F.lit(requested).cast("bigint").alias("requested_count"), total(at(["q"])).alias("completed_count"), total(at(["q"]) & ~F.col("q")).alias("accepted_count"),
        F.lit(retried).cast("bigint").alias("retried_count"), total(at(["q"]) & F.col("q")).alias("quarantined_count"),
    )


#: What a manifest says beside its counts and files.
VERSIONS = ("config_version", "prompt_version", "redaction_version")


def complete_manifest(counts: DataFrame, files: DataFrame, versions: dict[str, str], created_at: Column) -> DataFrame:
    """The whole manifest, from the row of build_manifest and files as manifest_files lists them: schema_version, files in
    order of paths, VERSIONS, created_at (a time, written in UTC) and the manifest_id of all that. A data set's files stand
    in its one manifest, so they are gathered in one row."""
    listed = files.agg(F.sort_array(F.collect_list(F.struct("path", "sha256", "byte_size"))).alias("files"))
    one = F.lit(1).alias("one")
    whole = listed.select(one, "*").join(F.broadcast(counts.select(one, "*")), "one").drop("one").select(
        F.lit("1.0.0").alias("schema_version"), F.date_format(F.to_utc_timestamp(created_at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "*",
        *[F.lit(versions.get(v)).cast("string").alias(v) for v in VERSIONS],
    )
    return whole.withColumn("manifest_id", manifest_id(whole))


#: Every column of a manifest.
MANIFEST = (
    "schema_version", "manifest_id", "created_at", "files", "split_counts", "source_counts", "split_source_counts", "quarantined_source_counts", "status_counts",
    "class_counts", "requested_count", "completed_count", "accepted_count", "retried_count", "quarantined_count", *VERSIONS,
)


def _sum(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, b: a + b)


_PORTABLE = r"^[^/\\:\x00-\x1f\x7f-\x9f]*[^/\\:\x00-\x1f\x7f-\x9f. ](/[^/\\:\x00-\x1f\x7f-\x9f]*[^/\\:\x00-\x1f\x7f-\x9f. ])*$"
_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"
_RESERVED = r"(?i)(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|/|$)"


def validate_manifest(manifests: DataFrame) -> DataFrame:
    """violations of each manifest row, as complete_manifest makes them. A row that lacks a column or value of MANIFEST has
    FIELDS; checks of columns that aren't there don't pass."""
    given = manifests.columns
    types = dict(build_types()) | {c: "string" for c in ("schema_version", "manifest_id", "created_at", *VERSIONS)}
    manifests = manifests.withColumns({c: F.lit(None).cast(types[c]) for c in MANIFEST if c not in given})
    m = F.col
    rows = columns = F.lit(True)
    for s in SPLITS:
        rows = rows & (_sum(m("split_source_counts")[s]) == m("split_counts")[s])
    for c in CATEGORIES:
        columns = columns & (sum((m("split_source_counts")[s][c] for s in SPLITS), m("quarantined_source_counts")[c]) == m("source_counts")[c])
    same = lambda name, keys: F.array_sort(F.map_keys(name)) == F.array(*map(F.lit, sorted(keys)))
    checks = {
        "CATEGORIES": same("split_counts", SPLITS) & same("source_counts", CATEGORIES) & same("status_counts", STATUSES) & same("class_counts", LABELS)
        & same("split_source_counts", SPLITS) & same("quarantined_source_counts", CATEGORIES),
        "LIFECYCLE": (m("completed_count") <= m("requested_count")) & (m("accepted_count") + m("quarantined_count") == m("completed_count")),
        "TOTALS": (_sum(m("split_counts")) == m("accepted_count")) & (_sum(m("class_counts")) == m("accepted_count"))
        & (_sum(m("source_counts")) == m("completed_count")) & (_sum(m("status_counts")) == m("completed_count"))
        & (m("status_counts")["quarantined"] == m("quarantined_count")),
        "QUARANTINED_SOURCES": _sum(m("quarantined_source_counts")) == m("quarantined_count"), "ROWS": rows, "COLUMNS": columns,
    }
    paths = F.transform("files", lambda f: F.lower(f["path"]))
    portable = F.forall("files", lambda f: f["path"].rlike(_PORTABLE) & ~f["path"].rlike(_RESERVED) & f["sha256"].rlike(SHA256) & (f["byte_size"] >= 0))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(False))
    there = F.forall(F.array(*[m(c).isNotNull() for c in MANIFEST]), lambda x: x)
    checks |= {
        "FIELDS": there & (m("schema_version") == "1.0.0") & ~F.exists(F.array(*VERSIONS), blank) & m("created_at").rlike(_UTC),
        "PATHS": (F.size(paths) > 0) & _unique(paths), "FILES": portable, "MANIFEST_ID": m("manifest_id") == manifest_id(manifests.select(*MANIFEST)),
    }
    checks = {code: F.coalesce(ok, F.lit(False)) for code, ok in checks.items()}
    found = manifests.withColumn("violations", _codes(checks))
    return found.select(*given, "violations")


def build_types() -> dict[str, str]:
    """Types of a manifest's counts and files."""
    one = "map<string,bigint>"
    counts = {c: one for c in ("split_counts", "source_counts", "quarantined_source_counts", "status_counts", "class_counts")}
    totals = {c: "bigint" for c in ("requested_count", "completed_count", "accepted_count", "retried_count", "quarantined_count")}
    return counts | totals | {"split_source_counts": f"map<string,{one}>", "files": "array<struct<path:string,sha256:string,byte_size:bigint>>"}


def manifest_id(manifests: DataFrame) -> Column:
    """The hash of a manifest's canonical JSON without its id."""
    import hashlib

    @F.pandas_udf("string")
    def made(rows: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(strict_json.canonical(strict_json.loads(r)).encode()).hexdigest() for r in rows])

    return made(F.to_json(F.struct(*[c for c in manifests.columns if c not in ("manifest_id", "violations")]), {"ignoreNullFields": "false"}))


def manifest_files(spark, path: str, root: str | None = None) -> DataFrame:
    """path (relative to root), sha256 and byte_size of each file at path, in folders below it too. root: a folder above
    them; the path itself, or what of it stands before its first pattern, if none is given. Tasks list the files and
    hash them in blocks, so that one may be of any length."""
    pattern = next((i for i, c in enumerate(path) if c in "*?[{"), None)
    root = root or (path if pattern is None else path[: path.rfind("/", 0, pattern)])
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    above = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    files = stores.listed_files(spark, path, below=True)
    hashed = stores.with_sha256(files.select("path", F.col("length").alias("byte_size")))
    return hashed.select(F.substring("path", len(above) + 2, 1 << 30).alias("path"), "sha256", "byte_size")
