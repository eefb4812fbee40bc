"""Line dedup by site-relative frequency (DataFrame functions only).

A line is boilerplate of a site when the pages of the site that hold it are more than a ratio of the site's pages.
Lines are counted once per page, so that partial counts meet before the shuffle; only lines seen on enough pages go
on. The boilerplate lines of a site are at most (mean lines of a page) / ratio, so their hashes fit in one array per
site, and pages are cleaned by a join on the site without being shuffled or taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hash128

#: Up to this many hashes of boilerplate lines (16 bytes each), they are broadcast.
BROADCAST_LINES = 200_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(
    df: DataFrame, text: str = "text", site: Column | str = "source", ratio: float = 0.1, min_pages: int = 2
) -> DataFrame:
    """One row per boilerplate line: site, line (its two hashes), pages, site_pages.

    Lines are compared after trimming spaces; blank lines are never boilerplate. min_pages: a line of one page alone
    repeats nothing, though on a site of few pages it exceeds the ratio, as all of the site's lines do. A null site is a site of its own; a null text has no lines but counts
    as a page; equal rows count as pages each."""
    site = F.col(site) if isinstance(site, str) else site
    pages = df.select(site.alias("site"), F.col(text).alias("text"))
    keys = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("text")), lambda x: F.trim(x)), lambda x: x != ""), hash128))
    seen = pages.select("site", F.explode(keys).alias("line")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("pages"))
    totals = pages.groupBy(F.col("site").alias("of")).agg(F.count(F.lit(1)).alias("site_pages"))
    return (
        seen.filter(F.col("pages") >= min_pages)
        .join(totals, F.col("site").eqNullSafe(F.col("of")))
        .filter(F.col("pages") > F.col("site_pages") * F.lit(float(ratio)))
        .select("site", "line", "pages", "site_pages")
    )


def drop_boilerplate_lines(
    df: DataFrame, text: str = "text", site: Column | str = "source", ratio: float = 0.1, min_pages: int = 2, counts: bool = True
) -> DataFrame:
    """df without the boilerplate lines of each row's site, plus, with counts, n_lines and n_removed (long; such columns of
    df are replaced; without counts all columns of df stay). What is left of a text keeps its order and line breaks; a text of boilerplate alone becomes empty, a
    null text stays null with 0 lines; an empty table stays empty."""
    site = F.col(site) if isinstance(site, str) else site
    bad = checkpointed(
        boilerplate_lines(df, text, site, ratio, min_pages).groupBy("site").agg(F.collect_list("line").alias("bad"))
    )
    if (bad.agg(F.sum(F.size("bad"))).first()[0] or 0) <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    names = [c for c in df.columns if not counts or c.lower() not in ("n_lines", "n_removed")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), site.alias("of"), F.col(text).alias("whole"))
    lines = _lines(F.col("whole"))
    good = F.filter(lines, lambda x: ~F.array_contains(F.col("bad"), hash128(F.trim(x))))
    cleaned = rows.join(bad, F.col("of").eqNullSafe(F.col("site")), "left").select(
        "row", "whole", F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.when(F.col("bad").isNull(), lines).otherwise(good).alias("good"),
    )
    kept = {c: F.col(f"row.`{c}`").alias(c) for c in names} | {
        text: F.when(F.col("whole").isNull(), F.lit(None)).otherwise(F.array_join("good", "\n")).alias(text)
    }
    n_lines = F.when(F.col("whole").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n_lines"))
    n_good = F.when(F.col("whole").isNull(), F.lit(0).cast("bigint")).otherwise(F.size("good").cast("bigint"))
    told = [n_lines.alias("n_lines"), (n_lines - n_good).alias("n_removed")] if counts else []
    return cleaned.select(*[kept[c] for c in names], *told)


LINE_DEDUP_SQL = r"""
WITH pages AS (SELECT doc_id, source, text, row_number() OVER () AS r FROM documents),
lines AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM pages),
totals AS (SELECT source, count(*) AS site_pages FROM pages GROUP BY source),
seen AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT r) AS pages FROM lines
         WHERE trim(line, ' ') <> '' GROUP BY ALL),
bad AS (SELECT s.source, s.line FROM seen s JOIN totals t ON s.source IS NOT DISTINCT FROM t.source
        WHERE s.pages >= 2 AND s.pages > t.site_pages * CAST(0.1 AS DOUBLE)),
marked AS (SELECT l.r, l.line, l.pos, b.line IS NOT NULL AS gone
           FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.line),
joined AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
                  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
           FROM marked GROUP BY r)
SELECT p.doc_id, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_removed, 0) AS n_removed,
       CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(j.kept, '') END AS text
FROM pages p LEFT JOIN joined j ON p.r = j.r
"""
