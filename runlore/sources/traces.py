"""Import of trace files with one JSON object per line: provenance to the byte, typed diagnostics, limits, dedupe."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import strict_json
from ..operators.analysis import guid_from_hash
from . import commit_log, line_ranges, stores
from .commit_log import exists, removed
from .schemas import EVENT_KINDS, RUNS

ADAPTER, ADAPTER_VERSION = "generic-jsonl", "1.0.0"
EPOCH = "1970-01-01T00:00:00Z"
_BLANK = re.compile(rb"[\x09-\x0D\x20\x85\xA0]*")
_RUN = re.compile(rb"[^\n]+")
_ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}([.,]\d{1,7})?)?(Z|[+-]\d{2}:\d{2})?)?$"
_OFFSET = r"(Z|[+-]\d{2}:\d{2})$"


@dataclass(frozen=True)
class ImportLimits:
    """What a file may hold; exactly as much is allowed."""

    total_bytes: int = 256 << 20
    record_bytes: int = 1 << 20
    records: int = 100_000
    events: int = 100_000


def _described(files: DataFrame) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    return files.withColumn("input_sha256", F.sha2("content", 256)).withColumn("name", name).withColumn("run_id", run_id())


def run_id(adapter: str = ADAPTER, version: str = ADAPTER_VERSION) -> Column:
    """A run's id, from the identity of its import, so that importing again gives the same id."""
    return guid_from_hash(F.sha2(F.concat_ws("|", F.col("input_sha256"), F.lit(adapter), F.lit(version)), 256))


def read_trace_files(spark: SparkSession, path: str, limits: ImportLimits = ImportLimits()) -> DataFrame:
    """path, length, content, input_sha256, name and run_id of each file up to the limit of bytes, empty ones included; others stand
    in oversize_files, and their content is not read."""
    files = stores.listed_files(spark, path).filter(F.col("length") <= limits.total_bytes)
    return _described(stores.with_contents(files))


def oversize_files(spark: SparkSession, path: str | list[str], limits: ImportLimits = ImportLimits()) -> DataFrame:
    """path and code of files beyond the limit of bytes; their content is not read."""
    return _too_large(stores.listed_files(spark, path), limits)


def _too_large(files: DataFrame, limits: ImportLimits) -> DataFrame:
    return files.filter(F.col("length") > limits.total_bytes).select("path", F.lit("TOTAL_BYTES_LIMIT").alias("code"))


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches have a bounded number of bytes, as single values can be very large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))


def _lines(content: bytes, most: int) -> Iterator[tuple[int, int, bytes]]:
    """Line (from 1), byte offset and bytes of each line that is not empty, as long as no more than so many of them are
    not blank. Runs of line feeds are counted and skipped, not cut."""
    line, before, records = 1, 0, 0
    for found in _RUN.finditer(content):
        line += content.count(b"\n", before, found.start())
        before = found.start()
        raw = found.group()
        yield line, before, raw
        records += not _BLANK.fullmatch(raw)
        if records > most:
            return


def split_records(files: DataFrame, limits: ImportLimits = ImportLimits()) -> DataFrame:
    """Lines of files: path, line (from 1), byte_offset, raw_bytes (a trailing CR counts), blank, record (bytes
    without the line's end). Blank lines count but have no row unless they are beyond the limit of a record's bytes, which
    rejects their file; a record beyond it has no bytes here. Files stop one line after the limit of records, as what follows can't
    change that they are rejected, so lines never take more room than their file. Each file is cut by itself, in Python."""
    out = "path string, run_id string, name string, input_sha256 string, line int, byte_offset bigint, raw_bytes bigint, blank boolean, record binary"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, run, name, sha, content in zip(*(b[c] for c in ("path", "run_id", "name", "input_sha256", "content")), strict=True):
                rows, held = [], 0
                for line, offset, raw in _lines(content, limits.records):
                    blank, long = bool(_BLANK.fullmatch(raw)), len(raw) > limits.record_bytes
                    if not blank or long:
                        record = b"" if long else raw[:-1] if raw.endswith(b"\r") else raw
                        rows.append((path, run, name, sha, line, offset, len(raw), blank, record))
                        held += len(record) + 200
                    if held > 8 << 20:
                        yield pd.DataFrame(rows, columns=_LINE)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=_LINE)

    bounded_batches(files.sparkSession)
    return files.select("path", "run_id", "name", "input_sha256", "content").mapInPandas(cut, out)


_LINE = ["path", "run_id", "name", "input_sha256", "line", "byte_offset", "raw_bytes", "blank", "record"]


def _parse(record: bytes) -> tuple:
    try:
        text = record.decode("utf-8")
        found = {key: (value, own) for key, value, own in strict_json.members(text)}
    except (UnicodeDecodeError, strict_json.BadJson):
        return ("INVALID_JSON", None, None, None, None, None, None)
    if any(strict_json.depth(v) >= strict_json.MAX_DEPTH for v, _ in found.values()):
        return ("INVALID_JSON", None, None, None, None, None, None)
    value = lambda key: found.get(key, (None, ""))[0]
    wrong = "timestamp" in found and not isinstance(value("timestamp"), str)
    wrong = wrong or any(value(key) is not None and not isinstance(value(key), str) for key in ("kind", "actor"))
    if wrong:
        return ("INVALID_RECORD", None, None, None, None, None, None)
    payload, own = found.get("payload", (None, text.strip(" \t\r\n")))
    if "payload" not in found:
        payload = {key: v for key, (v, _) in found.items()}
    tool = payload.get("tool") if isinstance(payload, dict) else None
    summary = value("summary")
    return (None, value("timestamp"), value("kind"), value("actor"), summary if isinstance(summary, str) else None, own, tool if isinstance(tool, str) else None)


def parsed_record(record: str) -> Column:
    """A struct column of a record's fields, parsed in Arrow batches."""

    @F.pandas_udf("code string, ts_text string, kind string, actor string, summary string, payload string, tool string")
    def parsed(records: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_parse(bytes(r)) for r in records], columns=["code", "ts_text", "kind", "actor", "summary", "payload", "tool"])

    return parsed.asNondeterministic()(F.col(record))  # so that it is not computed once more for a filter


def parse_records(lines: DataFrame) -> DataFrame:
    """Lines that are not blank with the fields of their object; code says what is wrong with the others: INVALID_JSON
    (no JSON object) or INVALID_RECORD (a field of a wrong type). Of repeated keys the last counts."""
    return lines.filter("not blank").withColumn("p", parsed_record("record")).select("*", "p.*").drop("p")


def project_events(parsed: DataFrame) -> DataFrame:
    """Parsed lines with defaults: unreadable or missing times are the epoch, times without an offset are UTC; kinds
    count in any case or as a number 0 to 8, others are Unknown; blank actors are unknown."""
    word = F.lower(F.trim("kind"))
    names = F.create_map(*[F.lit(x) for i, k in enumerate(EVENT_KINDS) for x in (k.lower(), k, str(i), k)])
    text = F.regexp_replace(F.col("ts_text"), ",", ".")
    text = F.when(text.rlike(_OFFSET), text).when(F.col("ts_text").rlike(r"T"), F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("T00:00:00Z")))
    time = F.when(F.col("ts_text").rlike(_ISO), text.try_cast("timestamp"))
    return parsed.withColumns({
        "timestamp": F.coalesce(time, F.lit(EPOCH).cast("timestamp")), "ts_text": F.when(time.isNotNull(), text).otherwise(F.lit(EPOCH)),
        "kind": F.coalesce(F.try_element_at(names, word), F.lit("Unknown")),
        "actor": F.when(F.trim(F.coalesce("actor", F.lit(""))) == "", "unknown").otherwise(F.col("actor")),
    })


def assign_sequence(events: DataFrame) -> DataFrame:
    """sequence: the place of an event among its run's valid ones, in order of lines."""
    w = Window.partitionBy("run_id").orderBy("line")
    return events.withColumn("sequence", (F.row_number().over(w) - 1).cast("bigint"))


def event_identity(events: DataFrame) -> DataFrame:
    """content_sha256 of the record's bytes, and an event_id that follows from run, sequence and content."""
    hashed = events if "content_sha256" in events.columns else events.withColumn("content_sha256", F.sha2("record", 256))
    whole = F.concat_ws(":", F.replace("run_id", F.lit("-"), F.lit("")), F.col("sequence").cast("string"), F.col("content_sha256"))
    return hashed.withColumn("event_id", guid_from_hash(F.sha2(whole, 256)))


def enforce_import_limits(lines: DataFrame, parsed: DataFrame, limits: ImportLimits = ImportLimits()) -> DataFrame:
    """path and code of files that a limit rejects as a whole: that of the first offending line, and on one line
    record bytes before records before events. A line after the last allowed event offends, well-formed or not."""
    w = Window.partitionBy("path").orderBy("line")
    sizes = lines.filter(F.col("raw_bytes") > limits.record_bytes).select("path", "line", F.lit(1).alias("rank"), F.lit("RECORD_BYTES_LIMIT").alias("code"))
    places = parsed.select(
        "path", "line", F.row_number().over(w).alias("record"), F.sum(F.col("code").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before")
    )
    many = places.filter(F.col("record") > limits.records).select("path", "line", F.lit(2).alias("rank"), F.lit("RECORD_COUNT_LIMIT").alias("code"))
    full = places.filter(F.coalesce("before", F.lit(0)) >= limits.events).select("path", "line", F.lit(3).alias("rank"), F.lit("EVENT_COUNT_LIMIT").alias("code"))
    first = F.min(F.struct("line", "rank", "code"))["code"].alias("code")
    return sizes.unionByName(many).unionByName(full).groupBy("path").agg(first)


def dedupe_imports(files: DataFrame, existing_runs: DataFrame) -> DataFrame:
    """path, run_id, first of files: whether a file is the first of its identity here and not stored yet."""
    w = Window.partitionBy("input_sha256").orderBy("path")
    stored = existing_runs.filter((F.col("adapter") == ADAPTER) & (F.col("adapter_version") == ADAPTER_VERSION)).select("input_sha256").distinct()
    places = files.select("path", "run_id", "input_sha256", F.row_number().over(w).alias("place"))
    known = stored.withColumn("stored", F.lit(True))
    return places.join(known, "input_sha256", "left").select("path", "run_id", ((F.col("place") == 1) & F.col("stored").isNull()).alias("first"))


@dataclass
class Imported:
    """outcomes: path, run_id, outcome (Imported, Partial, Duplicate, Rejected) and code; the others: new rows."""

    outcomes: DataFrame
    runs: DataFrame
    events: DataFrame
    diagnostics: DataFrame

    @property
    def event_index(self) -> DataFrame:
        return self.events.select("run_id", "sequence", "event_id", "kind", "content_sha256")


def _keeper(keep: str):
    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{keep}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{keep}/{name}")

    return kept


def kept_lines(files: DataFrame, keep: str, limits: ImportLimits = ImportLimits()) -> tuple[DataFrame, DataFrame]:
    """What split_records and parse_records give, worked out once and kept in a new folder; lines have content_sha256 in place of
    their record."""
    whole = split_records(files, limits).withColumn("p", F.when(~F.col("blank"), parsed_record("record"))).withColumn("content_sha256", F.sha2("record", 256))
    lines = _keeper(keep)(whole.drop("record"), "lines")
    return lines.drop("p"), lines.filter("not blank").select("*", "p.*").drop("p")


def import_files(
    files: DataFrame, existing_runs: DataFrame, limits: ImportLimits = ImportLimits(), imported_at: Column | None = None, keep: str | None = None
) -> Imported:
    """The import of files that are read whole (read_trace_files) against stored runs, each cut by one task. With keep, a new
    folder, contents are read twice and each record is parsed once; without it nothing is kept on the way, so they are read for each
    of its frames. import_paths is the way for a store."""
    if keep:
        lines, parsed = kept_lines(files, keep, limits)
        files = _keeper(keep)(files.drop("content"), "files")
    else:
        lines = split_records(files, limits)
        parsed = parse_records(lines)
    rejected = enforce_import_limits(lines, parsed, limits)
    firsts = dedupe_imports(files.join(rejected.select("path"), "path", "left_anti"), existing_runs)
    new = files.join(firsts.filter("first").select("path"), "path", "left_semi")
    mine = project_events(parsed.join(new.select("path"), "path", "left_semi"))
    return _imported(assign_sequence(mine.filter("code is null")).unionByName(mine.filter("code is not null"), allowMissingColumns=True), new, firsts, rejected, imported_at)


def _imported(mine: DataFrame, new: DataFrame, firsts: DataFrame, rejected: DataFrame, imported_at: Column | None) -> Imported:
    """From the projected lines, numbered where they are valid, of new files."""
    diagnostics = mine.filter("code is not null").select(
        "run_id", "line", "byte_offset", "code",
        F.when(F.col("code") == "INVALID_JSON", "Record is not a JSON object.").otherwise("Record has a field of a wrong type.").alias("message"),
    )
    source = F.struct(
        F.lit(ADAPTER).alias("adapter"), "input_sha256", F.col("name").alias("relative_path"), "byte_offset", "line", F.lit("/").alias("json_pointer")
    )
    events = event_identity(mine.filter("code is null")).select(
        "event_id", "run_id", "sequence", "ts_text", "timestamp", "kind", "actor", "summary", "payload", "tool", source.alias("source"),
        F.array().cast("array<struct<name:string,path:string,sha256:string>>").alias("artifacts"), "content_sha256",
    )
    runs = new.select(
        "run_id", "name", "input_sha256", F.lit(ADAPTER).alias("adapter"), F.lit(ADAPTER_VERSION).alias("adapter_version"),
        (imported_at if imported_at is not None else F.current_timestamp()).alias("imported_at"),
    )
    bad = diagnostics.select("run_id").distinct().withColumn("bad", F.lit(True))
    outcome = F.when(~F.col("first"), "Duplicate").when(F.col("bad"), "Partial").otherwise("Imported")
    outcomes = firsts.join(bad, "run_id", "left").select("path", "run_id", outcome.alias("outcome"), F.lit(None).cast("string").alias("code"))
    refused = rejected.select("path", F.lit(None).cast("string").alias("run_id"), F.lit("Rejected").alias("outcome"), "code")
    return Imported(outcomes.unionByName(refused), runs, events, diagnostics)


TABLES = ("events", "diagnostics", "event_index", "runs", "outcomes")


def described_files(files: DataFrame, limits: ImportLimits = ImportLimits()) -> DataFrame:
    """path, file (the path too), length, input_sha256, name, run_id and bom (whether it begins with a byte order mark that is no
    part of its first line) of files(path, length) up to the limit of bytes, empty ones included. Files are read in blocks."""
    files = files.filter(F.col("length") <= limits.total_bytes)
    told = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    packed = re.compile(line_ranges.PACKED)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [stores.head_and_sha256(p, len(line_ranges.BOM)) for p in b["path"]]
            bom = [head == line_ranges.BOM and not packed.search(p) for p, (head, _) in zip(b["path"], found, strict=True)]
            yield pd.DataFrame({"path": b["path"], "length": b["length"], "input_sha256": [x for _, x in found], "bom": bom})

    read = stores.dealt(files.select("path", "length"), *told).mapInPandas(hashed, f"{stores.FILES}, input_sha256 string, bom boolean")
    return read.select("path", F.col("path").alias("file"), "length", "input_sha256", "bom").withColumn("name", F.substring_index("path", "/", -1)).withColumn("run_id", run_id())


def import_paths(
    spark: SparkSession, paths: str | list[str] | DataFrame, existing_runs: DataFrame, keep: str, limits: ImportLimits = ImportLimits(), imported_at: Column | None = None,
    range_bytes: int | None = None,
) -> Imported:
    """The import of files (paths, patterns or rows of path and length) against stored runs. Tasks list the files; their contents
    are read twice, once in blocks for their hash and once in ranges of bytes, which are cut and parsed; all else reads what that has
    left in keep, a new folder. Nothing of a rejected file is stored; a file of bad lines alone is stored as Partial without events."""
    bounded_batches(spark)
    kept = _keeper(keep)
    listed = kept(paths if isinstance(paths, DataFrame) else stores.listed_files(spark, paths), "listed")
    files = kept(described_files(listed, limits), "files")
    cut = line_ranges.with_marks_alone(kept(line_ranges.cut_ranges(listed, limits, _parse, range_bytes), "cut"), files)
    sums = cut.filter("is_range").groupBy("file").agg(F.sum("raw_bytes").alias("records"), F.sum("place").alias("valid"), F.sum("too_long").alias("long"))
    may_break = (F.col("records") > limits.records) | (F.col("valid") >= limits.events) | (F.col("long") > 0)
    marked = files.filter("bom").select("file", F.lit(True).alias("marked"))  # its first record may be longer than the reader tells
    suspects = sums.join(marked, "file", "left").filter(may_break | F.coalesce("marked", F.lit(False))).select("file").join(files.select("file", "path", "bom"), "file")
    lines = line_ranges.placed(cut, line_ranges.range_starts(cut, suspects))
    rejected = kept(enforce_import_limits(lines, lines.filter("not blank"), limits), "rejected")  # of these files' lines alone
    firsts = kept(dedupe_imports(files.join(rejected.select("path"), "path", "left_anti"), existing_runs), "firsts")
    new = files.join(firsts.filter("first").select("path"), "path", "left_semi")
    starts = kept(line_ranges.range_starts(cut, new.select("file", "bom", "path", "run_id", "name", "input_sha256")), "starts")
    mine = line_ranges.placed(cut, starts).filter("not blank")
    return _imported(project_events(mine), new, firsts, rejected, imported_at)


def stored(spark: SparkSession, store: str, name: str, schema: str, after: int = -1) -> DataFrame:
    """A table of the store, as its committed imports (those with greater numbers than after) hold it: a run counts once, as
    each import is committed against all that came before. Empty where nothing is stored yet, an error where it can't be
    read. A filter on import_id prunes folders."""
    if not commit_log.commits(spark, store) and exists(spark, f"{store}/{name}"):
        spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{store}/{name}").limit(1).collect()  # an error if it is no table
    found = commit_log.read(spark, store, name, schema, commit_log.commits(spark, store, after))
    return found.select(*[f.name for f in StructType.fromDDL(schema)])


def store_import(made: Imported, store: str, import_id: str, too_large: DataFrame | None = None, batch: int | None = None, seen: int = -1) -> str:
    """Writes an import's rows to folders of its own and commits them; returns the id that they are committed under. If
    imports were committed since the entry seen (-1: none was looked at), runs that these hold are duplicates now:
    the rows are written again without them, under a new id. A batch that is committed already is not committed again."""
    spark = made.runs.sparkSession
    outcomes = made.outcomes if too_large is None else made.outcomes.unionByName(too_large)
    frames = {
        "events": made.events, "diagnostics": made.diagnostics, "runs": made.runs, "outcomes": outcomes.withColumn("batch", F.lit(batch).cast("bigint")),
    }
    put = lambda: {t: _put(df, store, t, import_id) for t, df in frames.items()}
    rows = put()
    rows["event_index"] = _put(replace(made, events=rows["events"]).event_index, store, "event_index", import_id)  # events are worked out once
    while True:
        newer = commit_log.commits(spark, store, seen)
        if batch is not None and any(c.batch == batch for c in newer):
            return import_id
        if newer:
            seen = newer[-1].number
            taken = commit_log.read(spark, store, "runs", RUNS, newer).select("run_id")
            clash = rows["runs"].join(taken, "run_id", "left_semi").select("run_id").distinct()
            if not clash.isEmpty():
                import_id = new_import_id()
                duplicate = F.when(F.col("t").isNotNull(), "Duplicate").otherwise(F.col("outcome"))
                told = rows["outcomes"].join(clash.withColumn("t", F.lit(True)), "run_id", "left").withColumn("outcome", duplicate).drop("t")
                frames = {t: df.join(clash, "run_id", "left_anti") for t, df in rows.items()} | {"outcomes": told.select(*rows["outcomes"].columns)}
                rows = put()
        if commit_log.try_commit(spark, store, commit_log.Commit(seen + 1, import_id, TABLES, batch)):
            return import_id


def _put(df: DataFrame, store: str, table: str, import_id: str) -> DataFrame:
    where = commit_log.folder(store, table, import_id)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def new_import_id() -> str:
    return uuid.uuid4().hex


def import_traces(spark: SparkSession, path: str | list[str], store: str, limits: ImportLimits = ImportLimits(), imported_at: Column | None = None) -> DataFrame:
    """Imports all files at path into the store and returns their outcomes, which stay in the store, as those of all imports
    do. One that failed can be repeated: its rows without a commit don't count."""
    return _import(spark, path, store, limits, imported_at)


def _import(
    spark: SparkSession, path: str | list[str] | DataFrame, store: str, limits: ImportLimits, imported_at: Column | None = None, batch: int | None = None
) -> DataFrame:
    number = new_import_id()
    keep = f"{store}/_importing-{number}"
    before = commit_log.commits(spark, store)
    known = commit_log.read(spark, store, "runs", RUNS, before)
    made = import_paths(spark, path, known, keep, limits, imported_at)
    too_large = _too_large(spark.read.schema(stores.FILES).parquet(f"{keep}/listed"), limits)
    refused = too_large.select("path", F.lit(None).cast("string").alias("run_id"), F.lit("Rejected").alias("outcome"), "code")
    number = store_import(made, store, number, refused, batch, before[-1].number if before else -1)
    removed(spark, keep)
    return spark.read.schema(made.outcomes.schema).parquet(commit_log.folder(store, "outcomes", number))
