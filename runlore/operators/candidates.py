"""Training candidates: an event with its context, redacted and gated."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strict_json
from ..functions.redaction import LIMITS, VERSION, Policy, RedactionError, Redactor
from ..sources.schemas import CONTEXT
from . import text_redaction
from .audit import _codes

SCHEMA_VERSION = "1.0.0"
CATEGORIES = ("fake", "fixture", "live")
MODES = ("offline", "offline-analysis", "online")
MAX_CONTEXT = 64
#: Fields of a candidate in stored order, without example_id.
FIELDS = (
    "schema_version", "run_id", "event_id", "task_group_id", "lineage_id", "context_before", "event_text", "context_after", "event_kind", "tool_name",
    "source_category", "source_hash", "adapter", "adapter_version", "redaction_version", "license_or_consent",
)
_NOT_EMPTY = ("run_id", "event_id", "task_group_id", "lineage_id", "event_kind", "adapter", "adapter_version", "redaction_version", "license_or_consent")
_CONTEXT_FIELDS = ("event_id", "event_text", "event_kind", "tool_name")
CANDIDATE = ", ".join(f"{f} {f'array<{CONTEXT}>' if f.startswith('context_') else 'string'}" for f in FIELDS)


@dataclass(frozen=True)
class ExportOptions:
    """before and after: numbers of context events; online mode may not look ahead. option_violations checks rows of them."""

    source_category: str
    license_or_consent: str
    before: int = 4
    after: int = 0
    mode: str = "offline"

    def validate(self) -> None:
        if self.mode not in MODES or self.mode == "online" and self.after:
            raise ValueError("online exports have no context after the event")
        if not (0 <= self.before <= MAX_CONTEXT and 0 <= self.after <= MAX_CONTEXT):
            raise ValueError("context is 0 to 64 events")
        if self.source_category not in CATEGORIES or not self.license_or_consent.strip():
            raise ValueError("a source category and a licence or consent are needed")


def option_violations() -> Column:
    """Names of the export options in a row (source_category, license_or_consent, mode, before, after) that don't hold, in that
    order; empty if an export may run with them. A null option doesn't hold."""
    context = lambda c: F.col(c).between(0, MAX_CONTEXT)
    return _codes({
        "SOURCE_CATEGORY": F.col("source_category").isin(*CATEGORIES), "LICENSE_OR_CONSENT": F.col("license_or_consent").rlike(r"[^\s\x1c-\x1f\x85\xa0]"),
        "MODE": F.col("mode").isin(*MODES), "CONTEXT_BEFORE": context("before"), "CONTEXT_AFTER": context("after"),
        "LOOKS_AHEAD": (F.col("mode") != "online") | (F.col("after") == 0),
    })


def canonical_event_text(events: DataFrame) -> DataFrame:
    """events with event_text: canonical JSON of the stored event, its payload's numbers spelled as Python does."""
    pieces = ("event_id", "run_id", "sequence", "ts_text", "kind", "actor", "summary", "payload", "source", "artifacts", "content_sha256")

    @F.pandas_udf("string")
    def spelled(*columns: pd.Series) -> pd.Series:
        return pd.Series([_event_text(*x) for x in zip(*columns, strict=True)])

    flat = [F.to_json(c) if c in ("source", "artifacts") else F.col(c) for c in pieces]
    return events.withColumn("event_text", spelled(*flat))


def _event_text(event_id, run_id, sequence, timestamp, kind, actor, summary, payload, source, artifacts, content) -> str:
    s = strict_json.loads(source or "{}")
    event = {
        "id": event_id, "runId": run_id, "sequence": int(sequence), "timestamp": timestamp, "kind": kind, "actor": actor, "summary": summary,
        "payload": strict_json.loads(payload, unique=False), "contentSha256": content,
        "source": {"adapter": s.get("adapter"), "inputSha256": s.get("input_sha256"), "relativePath": s.get("relative_path"), "byteOffset": s.get("byte_offset"), "line": s.get("line"), "jsonPointer": s.get("json_pointer")},
        "artifacts": [{k: a.get(k) for k in ("name", "path", "sha256")} for a in strict_json.loads(artifacts or "[]")],
    }
    return strict_json.canonical(event)


def tool_name(payload: Column | str = "payload") -> Column:
    """payload.tool where the payload is an object and tool a string, else null."""
    variant = F.try_parse_json(payload)
    is_text = F.schema_of_variant(F.try_variant_get(variant, "$.tool", "variant")) == "STRING"
    return F.when(is_text, F.try_variant_get(variant, "$.tool", "string"))


def context_windows(events: DataFrame, before: int = 4, after: int = 0) -> DataFrame:
    """events with context_before and context_after: arrays of the neighbours in the run, in order; never of another
    run. Structs are put together after the one exchange by run."""
    if not (0 <= before <= MAX_CONTEXT and 0 <= after <= MAX_CONTEXT):
        raise ValueError("context is 0 to 64 events")
    w = Window.partitionBy("run_id").orderBy("sequence")
    own = F.struct(F.col("event_id"), F.col("event_text"), F.col("kind").alias("event_kind"), F.col("tool").alias("tool_name"))
    none = F.array().cast(f"array<{CONTEXT}>")
    rows = events.withColumn("own", own)
    rows = rows.withColumn("context_before", F.collect_list("own").over(w.rowsBetween(-before, -1)) if before else none)
    return rows.withColumn("context_after", F.collect_list("own").over(w.rowsBetween(1, after)) if after else none).drop("own")


def source_hash(adapter: str = "adapter", version: str = "adapter_version", content: str = "content_sha256", run_input: str = "input_sha256") -> Column:
    """The hash of the canonical JSON of where an event comes from."""
    whole = F.struct(
        F.col(adapter).alias("adapter"), F.col(version).alias("adapter_version"), F.col(content).alias("event_content_sha256"), F.col(run_input).alias("run_input_sha256")
    )
    return F.sha2(F.to_json(whole), 256)


def build_candidates(runs: DataFrame, events: DataFrame, options: ExportOptions) -> DataFrame:
    """Raw candidates of all events, with imported_at and sequence to order by."""
    options.validate()
    rows = context_windows(canonical_event_text(events), options.before, options.after)
    joined = rows.join(runs.select("run_id", "input_sha256", "adapter", "adapter_version", "imported_at"), "run_id")
    made = {
        "schema_version": F.lit(SCHEMA_VERSION), "task_group_id": F.col("run_id"), "lineage_id": F.col("run_id"), "event_kind": F.col("kind"),
        "tool_name": F.col("tool"), "source_category": F.lit(options.source_category), "source_hash": source_hash(), "redaction_version": F.lit(VERSION),
        "license_or_consent": F.lit(options.license_or_consent),
    }
    return joined.withColumns(made).select(*FIELDS, "imported_at", "sequence")


def identity(candidate: dict) -> str:
    """The hash of a candidate's canonical JSON without example_id."""
    return hashlib.sha256(strict_json.canonical({f: candidate[f] for f in FIELDS}).encode()).hexdigest()


def _plain(candidate: dict) -> dict:
    out = dict(candidate)
    for side in ("context_before", "context_after"):
        out[side] = [{k: c[k] for k in _CONTEXT_FIELDS} for c in out[side]]
    return out


def gate(candidate: dict, redactor: Redactor) -> tuple[dict | None, str | None]:
    """The redacted candidate with its id, or a code of what is wrong. Redaction of what came out must change nothing."""
    try:
        once, _ = redactor.redact(candidate)
        twice, _ = redactor.redact(once)
    except RedactionError as e:
        return None, e.code
    except (TypeError, ValueError, strict_json.BadJson):
        return None, "INPUT_ERROR"
    if twice != once or once["redaction_version"] != redactor.policy.version:
        return None, "GATE_FAILED"
    ids = [*(c["event_id"] for c in once["context_before"]), once["event_id"], *(c["event_id"] for c in once["context_after"])]
    if len(set(ids)) < len(ids) or not all(once[f] for f in _NOT_EMPTY) or once["source_category"] not in CATEGORIES:
        return None, "INVALID_CANDIDATE"
    return once | {"example_id": identity(once)}, None


def _contexts(side: str, fields: Iterable[str] = _CONTEXT_FIELDS) -> Column:
    return F.transform(side, lambda c: F.struct(*[c[k].cast("string").alias(k) for k in fields]))


def canonical_by_spark(*more: str) -> Column:
    """The JSON of a candidate (with more fields) as Spark spells it: canonical where spelled_alike holds."""
    fields = [
        _contexts(f, sorted(_CONTEXT_FIELDS)).alias(f) if f.startswith("context_") else F.col(f).cast("string").alias(f) for f in sorted((*FIELDS, *more))
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def spelled_alike(json: Column) -> Column:
    """Whether canonical_by_spark's JSON of a candidate is canonical: its contexts are there, and no text holds a control character
    that has no short escape (Spark's hex digits are upper case)."""
    whole = lambda side: F.coalesce(F.forall(side, lambda c: c.isNotNull()), F.lit(False))
    return whole("context_before") & whole("context_after") & ~json.contains("\\u00")


def _plain_candidate(json: Column) -> Column:
    """Whether a candidate (of this JSON by Spark) is within all limits and holds nothing that redaction looks for, so that it stays
    as it is. No name of a field holds a sign."""
    size = F.size("context_before") + F.size("context_after")
    small = (size <= 10 * MAX_CONTEXT) & (F.octet_length(json) <= LIMITS["max_string_chars"])
    return spelled_alike(json) & small & ~text_redaction.json_holds_signs(json)


def _unknown(known: pd.Series, rows: pd.DataFrame) -> Iterator[tuple[int, dict]]:
    """Place and fields of the rows that Spark's expressions don't know."""
    places = [i for i, k in enumerate(known) if not k]
    return zip(places, rows.iloc[places].to_dict("records"), strict=True)


def by_row(known: pd.Series, rows: pd.DataFrame, f: Callable[[dict], str]) -> pd.Series:
    """f of the rows that Spark's expressions don't know, null for the others."""
    out: list[str | None] = [None] * len(known)
    for i, row in _unknown(known, rows):
        out[i] = f(row)
    return pd.Series(out, dtype=object)


def candidate_gate(candidates: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Redacted candidates with example_id and error_code; rows that fail hold nothing else but their order. By the fixed policy,
    candidates without a sign of what is redacted are checked and hashed by Spark expressions; the engine takes the others."""
    order = [c for c in ("imported_at", "sequence") if c in candidates.columns]
    own = policy is not None and policy != Policy()

    @F.pandas_udf(f"example_id string, {CANDIDATE}, error_code string")
    def gated(plain: pd.Series, rows: pd.DataFrame) -> pd.DataFrame:
        redactor, columns = Redactor(policy), ["example_id", *FIELDS, "error_code"]
        out: list[dict] = [{}] * len(plain)
        for i, row in _unknown(plain, rows):
            made, code = gate(_plain({f: None if isinstance(row[f], float) else row[f] for f in FIELDS}), redactor)
            out[i] = (made or {}) | {"error_code": code}
        return pd.DataFrame({c: pd.Series([x.get(c) for x in out], dtype=object) for c in columns})

    given = candidates.select(*order, *[F.col(f) if f.startswith("context_") else F.col(f).cast("string").alias(f) for f in FIELDS])
    rows = given.withColumn("json", canonical_by_spark())
    rows = rows.withColumn("plain", F.lit(False) if own else _plain_candidate(F.col("json")))
    rows = rows.withColumn("engine", gated.asNondeterministic()("plain", F.when(~F.col("plain"), F.struct(*FIELDS))))
    ids = F.concat(F.col("context_before.event_id"), F.array("event_id"), F.col("context_after.event_id"))
    sound = F.size(F.array_distinct(ids)) == F.size(ids)
    for f in _NOT_EMPTY:
        sound = sound & (F.length(f) > 0)
    sound = F.coalesce(sound & F.col("source_category").isin(*CATEGORIES), F.lit(False))
    code = F.when(~F.col("redaction_version").eqNullSafe(F.lit(VERSION)), "GATE_FAILED").when(~sound, "INVALID_CANDIDATE")
    rows = rows.withColumn("code", F.when(F.col("plain"), code).otherwise(F.col("engine.error_code")))
    passed = F.col("plain") & F.col("code").isNull()
    kept = {f: _contexts(f) if f.startswith("context_") else F.col(f) for f in FIELDS} | {"example_id": F.sha2("json", 256)}
    told = [F.when(passed, kept[f]).otherwise(F.col(f"engine.{f}")).alias(f) for f in ("example_id", *FIELDS)]
    return rows.select(*told, F.col("code").alias("error_code"), *order)


def candidate_json(candidates: DataFrame) -> DataFrame:
    """value: canonical JSON lines of gated candidates, with their order."""

    @F.pandas_udf("string")
    def spelled(known: pd.Series, rows: pd.DataFrame) -> pd.Series:
        return by_row(known, rows, lambda r: strict_json.canonical(_plain(r)))

    rows = candidates.withColumn("json", canonical_by_spark("example_id")).withColumn("alike", spelled_alike(F.col("json")))
    rare = spelled("alike", F.when(~F.col("alike"), F.struct("example_id", *FIELDS)))
    value = F.when(F.col("alike"), F.col("json")).otherwise(rare)
    return rows.select("imported_at", "run_id", "sequence", value.alias("value"))


def write_candidates(gated: DataFrame, path: str) -> int:
    """Writes all candidates in order as JSON lines and returns their number. If any row has failed the gate, nothing
    is written; an existing path is never written over. gated must be stored or deterministic, as it is read twice."""
    failed = gated.agg(F.count_if(F.col("error_code").isNotNull()), F.count(F.lit(1))).first()
    if failed[0]:
        raise ValueError(f"{failed[0]} candidates fail the gate")
    ordered = candidate_json(gated).orderBy("imported_at", "run_id", "sequence")
    ordered.select("value").write.mode("errorifexists").text(path)
    return failed[1]
