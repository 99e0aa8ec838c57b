"""Removal of boilerplate lines by how many of a site's pages carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.session import materialize

# What is not text, and tags that end a line.
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
_BREAKS = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|head|body|html)\b[^>]*>"
_TAGS = r"<[^>]*>"


def page_host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#@]+)", 1)
    return F.when(F.length(host) > 0, F.lower(host))


def page_lines(html: Column) -> Column:
    """Visible lines of a page in order, trimmed, without empty ones."""
    text = F.regexp_replace(html, _HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, _BREAKS, "\n"), _TAGS, "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r ]+", " ")))
    return F.filter(lines, lambda x: x != "")


def line_dedup(pages: DataFrame, ratio: float = 0.3, least_pages: int = 5) -> DataFrame:
    """Drop the lines that more than ``ratio`` of their site's pages carry.

    Returns ``page_id, host, n_lines, n_dropped, text`` with a row for every input row. A
    site is the host of the URL (all URLs without a host are one site); a line counts once
    a page. Sites with fewer than ``least_pages`` pages keep all lines, as a ratio says
    nothing there. Null or tag-only pages have no lines and an empty text; repeated rows
    count as pages of their own; an empty table gives no rows; other columns are not read.

    Lines are counted per site and line with partial sums before the shuffle, so neither a
    large site nor a common line meets in one task. Only the lines to drop go back to their
    pages, by number.
    """
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        page_host(F.col("url")).alias("host"),
        F.coalesce(page_lines(F.col("html")), F.array().cast("array<string>")).alias("lines"),
        # tells rows of one page_id apart; rows equal in both have equal lines
        F.xxhash64("url", "html").alias("mark"),
    )
    source = materialize(source, "pages")
    totals = source.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    carried = source.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    counted = carried.groupBy("host", "line").agg(F.count("*").alias("carriers"))
    totals = materialize(totals, "sites").select(F.col("host").alias("h"), "pages")
    common = (
        counted.join(totals, F.col("host").eqNullSafe(F.col("h")))
        .where(F.col("carriers") > ratio * F.col("pages"))
        .select(F.col("host").alias("h"), F.col("line").alias("l"))
    )
    common = materialize(common, "boilerplate")
    placed = source.select(
        "page_id", "mark", "host", F.posexplode("lines").alias("at", "line")
    )
    dropped = (
        placed.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
        .groupBy("page_id", "mark")
        .agg(F.collect_set("at").alias("gone"))
        .select(F.col("page_id").alias("p"), F.col("mark").alias("m"), "gone")
    )
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    joined = source.join(
        dropped, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("mark") == F.col("m")), "left"
    ).withColumn("gone", gone)
    places = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1))
    places = F.array_except(F.coalesce(places, F.array().cast("array<int>")), "gone")
    stay = F.transform(places, lambda i: F.get("lines", i))
    return joined.select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.array_join(stay, "\n").alias("text"),
    )
