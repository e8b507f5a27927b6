"""Links from a main page to the pages of its sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: whole path in group 1, numeric id in group 2.
SECTION_LINK = r'(?i)href="(/act-\d+/(?:section|chapter|sub-section)-(\d+)\.html)"'


def extract_links(pages: DataFrame, base: str, pattern: str = SECTION_LINK) -> DataFrame:
    """(page_id, ord, link_id, url): first mention of each address, in page order.

    Deduplication stays inside the row, so nothing is shuffled.
    """
    found = pages.select(
        "page_id", F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("paths"),
        F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("ids"))
    first = found.select("page_id", F.posexplode_outer(F.array_distinct(F.arrays_zip("paths", "ids")))).filter("pos is not null")
    # The id is part of the address, so distinct pairs are distinct addresses.
    return first.select("page_id", F.col("pos").alias("ord"), F.col("col.ids").alias("link_id"),
                        F.concat(F.lit(base), F.col("col.paths")).alias("url"))


def link_index(links: DataFrame) -> DataFrame:
    """One address per section id; the last mention counts."""
    return links.groupBy("page_id", "link_id").agg(F.max_by("url", "ord").alias("url"))
