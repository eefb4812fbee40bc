"""Redaction of columns, reports, and a scan for what is left: texts by the fixed policy in Spark expressions, JSON values
and rules of one's own in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redaction import BUILTINS, Policy, RedactionError, Redactor
from . import text_redaction

REPORT = (
    "redacted string, version string, config_hash string, input_hash string, output_hash string, counts map<string, int>, total int, "
    "passed boolean, error_code string"
)
_COLUMNS = [x.split()[0] for x in ("redacted", "version", "config_hash", "input_hash", "output_hash", "counts", "total", "passed", "error_code")]


def _reports(policy: Policy | None, json: bool) -> Column:
    @F.pandas_udf(REPORT)
    def redacted(values: pd.Series) -> pd.DataFrame:
        redactor, rows = Redactor(policy), []
        for v in values:
            if v is None:
                rows.append((None,) * 9)
                continue
            try:
                out, r = redactor.report_json(v) if json else redactor.report(v)
                rows.append((out, r["version"], r["config_hash"], r["input_hash"], r["output_hash"], r["counts"], r["total"], r["passed"], None))
            except RedactionError as e:
                counts = getattr(e, "counts", None)
                rows.append((None, redactor.policy.version, redactor.policy.config_hash, None, None, counts, None if counts is None else sum(counts.values()), False, e.code))
        return pd.DataFrame(rows, columns=_COLUMNS)

    return redacted.asNondeterministic()


def redact_text(df: DataFrame, col: str, policy: Policy | None = None, into: str = "redaction") -> DataFrame:
    """df with a struct column: the redacted text and its report (see REPORT). Rows that can't be redacted have an
    error_code and no text, but those that fail the scan tell what was found (counts, total); a null text has a null report."""
    if policy is not None and policy != Policy():
        return df.withColumn(into, _reports(policy, False)(F.col(col)))
    rare = text_redaction.holds_marks(F.col(col))
    by_engine = _reports(None, False)(F.when(rare, F.col(col)))
    return df.withColumn(into, F.when(rare, by_engine).otherwise(text_redaction.reports(F.col(col))))


def redact_json(df: DataFrame, col: str, policy: Policy | None = None, into: str = "redaction") -> DataFrame:
    """The same of a column of JSON values, keys and values under secret-like keys included."""
    return df.withColumn(into, _reports(policy, True)(F.col(col)))


def redaction_totals(reported: DataFrame, column: str = "redaction") -> DataFrame:
    """kind, rows, replacements over all reports, those of texts that fail the scan included."""
    kinds = reported.select(F.explode(f"{column}.counts").alias("kind", "n"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").cast("bigint").alias("replacements"))


def secret_scan(df: DataFrame, col: str, policy: Policy | None = None, into: str = "found") -> DataFrame:
    """df with an array of the kinds that a scan finds in a text, sorted; empty where it passes or is null."""

    @F.pandas_udf("array<string>")
    def found(values: pd.Series) -> pd.Series:
        redactor = Redactor(policy)
        return pd.Series([sorted(redactor.scan(v)) if v is not None else [] for v in values])

    if policy is not None and policy != Policy():
        return df.withColumn(into, found.asNondeterministic()(F.col(col)))
    rare = text_redaction.holds_marks(F.col(col))
    return df.withColumn(into, F.when(rare, found.asNondeterministic()(F.when(rare, F.col(col)))).otherwise(text_redaction.scanned(F.col(col))))


def builtin_counts(df: DataFrame, col: str, kinds: tuple[str, ...] = ("EMAIL", "PHONE")) -> DataFrame:
    """df with n_<kind> columns: matches of built-in patterns, counted in the JVM (with Unicode classes)."""
    counts = {f"n_{k.lower()}": F.coalesce(F.regexp_count(F.col(col), F.lit("(?U)" + BUILTINS[k])), F.lit(0)) for k in kinds}
    return df.withColumns(counts)
