"""Lines of trace files by ranges of bytes: large files are cut by several tasks, each line is parsed where it is cut.

A range has the lines that begin in it: a task looks for the first line feed from the range's start on itself. It numbers
its range's lines and adds up their bytes, and tells both for the whole range in a row of its own. A running sum of these few
rows over the ranges of a file then gives every line its number, its offset and its place among the valid ones, so no line
is sorted or moved for them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import stores

_BLANK = re.compile(rb"[\x09-\x0D\x20\x85\xA0]*")
#: Names of packed files, which are cut whole.
PACKED = r"\.(gz|bz2|deflate|snappy|lz4|lzo|zst|zstd|xz)$"
BOM = b"\xef\xbb\xbf"
#: Of a line: place among its range's lines (from 0), offset in it, bytes, and place among its valid ones; of a range
#: (is_range): the numbers of lines, of bytes, of records, of valid ones and of too long ones.
_COLUMNS = {
    "file": "string", "start": "bigint", "is_range": "boolean", "line": "bigint", "at": "bigint", "raw_bytes": "bigint", "place": "bigint", "too_long": "bigint", "blank": "boolean",
    "code": "string", "ts_text": "string", "kind": "string", "actor": "string", "summary": "string", "payload": "string", "tool": "string", "content_sha256": "string",
}
_KINDS = {"string": object, "bigint": "int64", "boolean": bool}


def escaped(path: str) -> str:
    """A path that is taken as it is, not as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _frames(lines: Iterator[tuple[str, int, bytes]], limits, parse) -> Iterator[pd.DataFrame]:
    """Rows of (file, start of range, bytes of a line) in order, ranges one after the other."""
    rows, held = [], 0
    now, n, at, records, valid, long = None, 0, 0, 0, 0, 0

    def made() -> pd.DataFrame:
        return pd.DataFrame(rows, columns=list(_COLUMNS), dtype=object).astype({c: _KINDS[k] for c, k in _COLUMNS.items()})

    def told() -> tuple:
        return (*now, True, n, at, records, valid, long, False, *[None] * 8)

    for file, start, raw in lines:
        if (file, start) != now:
            if now:
                rows.append(told())
            now, n, at, records, valid, long = (file, start), 0, 0, 0, 0, 0
        blank, too_long = bool(_BLANK.fullmatch(raw)), len(raw) > limits.record_bytes
        first = start == 0 and n == 0
        # beyond the limit of records a file is rejected as a whole, so what follows need not be parsed
        if (not blank or too_long or first) and records <= limits.records:
            record = b"" if too_long else raw[:-1] if raw.endswith(b"\r") else raw
            found = (None,) * 7 if blank or too_long else parse(record)
            digest = None if blank or too_long or found[0] else hashlib.sha256(record).hexdigest()
            rows.append((file, start, False, n, at, len(raw), valid, 0, blank, *found, digest))
            held += len(record) + 300
            valid += not blank and not too_long and found[0] is None
        records += not blank
        long += too_long
        n += 1
        at += len(raw) + 1
        if held > 8 << 20:
            yield made()
            rows, held = [], 0
    if now:
        rows.append(told())
    yield made()


def cut_ranges(files: DataFrame, limits, parse, range_bytes: int | None = None) -> DataFrame:
    """Parsed lines and ranges of files(path, length) up to the limit of bytes; others and empty ones are not read. Ranges have
    range_bytes (spark.sql.files.maxPartitionBytes, if none are given); a task takes several where they are small. file is the path."""
    schema = ", ".join(f"{c} {k}" for c, k in _COLUMNS.items())
    size = range_bytes or files.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    files = files.filter((F.col("length") <= limits.total_bytes) & (F.col("length") > 0))
    packed = F.substring_index("path", "/", -1).rlike(PACKED)
    starts = F.when(packed, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size)))
    ranges = files.select("path", packed.alias("packed"), "length", F.explode(starts).alias("start"))
    ranges = ranges.withColumn("stop", F.when(F.col("packed"), F.col("length")).otherwise(F.least(F.col("start") + size, "length")))
    told = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (x for b in batches for x in zip(*(b[c] for c in ("path", "start", "stop", "packed")), strict=True))
        yield from _frames(_read(rows), limits, parse)

    return stores.dealt(ranges, *told, min(max(size, 1 << 20), stores.TASK_BYTES)).mapInPandas(cut, schema)


def _read(ranges: Iterator[tuple[str, int, int, bool]]) -> Iterator[tuple[str, int, bytes]]:
    """File, start of range and bytes of each line of ranges(path, start, stop, packed). A byte order mark is no part of a file's first
    line, unless it is packed; a mark alone makes no line."""
    for path, start, stop, packed in ranges:
        store, inside = stores.located(path)
        with store.open_input_file(inside) as file:
            for i, raw in enumerate(stores.lines_of(file, start, stop)):
                if start == 0 and i == 0 and not packed and raw.startswith(BOM):
                    raw = raw[len(BOM) :]
                    if not raw and stop == len(BOM):
                        continue
                yield path, start, raw


def with_marks_alone(cut: DataFrame, files: DataFrame) -> DataFrame:
    """cut with the one line of each of files(file, length, bom) that has nothing but a mark, of which cut_ranges tells none."""
    alone = files.filter((F.col("length") == len(BOM)) & F.col("bom")).select("file", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_range"))
    told = {"start": F.lit(0), "line": F.col("is_range").cast("bigint"), "at": F.col("is_range").cast("bigint"), "blank": ~F.col("is_range")}
    zero = {c: F.lit(0) for c in ("raw_bytes", "place", "too_long")}
    made = alone.withColumns(told | zero)
    return cut.unionByName(made.select(*[(F.col(c) if c in made.columns else F.lit(None)).cast(k).alias(c) for c, k in _COLUMNS.items()]))


def range_starts(cut: DataFrame, files: DataFrame) -> DataFrame:
    """What stands before each range of files(file, bom, ..): file, start, lines_before, bytes_before, valid_before, mark (bytes
    of the file's byte order mark), first_valid (whether what follows the mark would be a valid record), and columns of
    files. One row for each range, a few for each file."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    told = cut.filter("is_range").select("file", "start", summed("line").alias("lines_before"), summed("at").alias("bytes_before"), summed("place").alias("valid_before"))
    firsts = cut.filter("not is_range and start = 0 and line = 0 and content_sha256 is not null")
    firsts = firsts.join(files.filter("bom").select("file"), "file", "left_semi").select("file", F.lit(True).alias("v"))
    marked = files.withColumn("mark", F.when(F.col("bom"), len(BOM)).otherwise(0)).drop("bom")
    return told.join(marked, "file").join(firsts, "file", "left").withColumn("first_valid", F.coalesce("v", F.lit(False))).drop("v")


def placed(cut: DataFrame, starts: DataFrame) -> DataFrame:
    """Lines of the files of starts (from range_starts) with line (from 1), byte_offset, sequence (among valid ones), raw_bytes,
    blank, what was parsed, and what starts tells of their file. A byte order mark was taken off; with it a first line is no
    JSON."""
    lines = cut.filter("not is_range").withColumnRenamed("line", "place_in_range").join(starts, ["file", "start"])
    first = (F.col("start") == 0) & (F.col("place_in_range") == 0)
    marked = (F.col("mark") > 0) & first
    out = lines.withColumns({
        "line": (F.col("lines_before") + F.col("place_in_range") + 1).cast("int"),
        "byte_offset": F.col("bytes_before") + F.col("at") + F.when(first, 0).otherwise(F.col("mark")),
        "raw_bytes": F.col("raw_bytes") + F.when(first, F.col("mark")).otherwise(0),
        "code": F.when(marked, "INVALID_JSON").otherwise(F.col("code")), "blank": F.col("blank") & ~marked,
        "sequence": F.col("valid_before") + F.col("place") - F.col("first_valid").cast("int"),
    })
    return out.drop("place_in_range", "at", "is_range", "too_long", "place", "lines_before", "bytes_before", "valid_before", "mark", "first_valid", "start")
