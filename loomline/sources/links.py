"""Links of HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_links(pages: DataFrame, within: str | None = None) -> DataFrame:
    """(page_id, position, href): site-relative links without fragment or query, the first of each, in page order.

    ``within`` keeps links after the first occurrence of a marker (such as id="content"). Repeats are removed
    inside the page's own array, so there is no shuffle.
    """
    html = F.col("html") if within is None else F.substring("html", F.greatest(F.lit(1), F.locate(within, F.col("html"))), F.length("html"))
    found = F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))
    local = F.filter(found, lambda h: h.startswith("/") & ~h.startswith("//") & ~h.contains("#") & ~h.contains("?"))
    return pages.select("page_id", F.posexplode(F.array_distinct(local)).alias("position", "href"))
