"""Pages to links and documents. Everything but the frontier is one narrow stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import block_text, first_scope, hrefs, inline_text, with_scopes
from ..functions.urls import resolve_url
from ..schemas import DOCUMENTS, conform

# Fixed values.
LINK_SCOPE = "div.toc-tree"
TITLE = ".page-title"
CONTENT = "section#book-content"
FRONTIER_LIMIT = 50


def extract_links(pages: DataFrame, scope: str = LINK_SCOPE) -> DataFrame:
    """``(page_id, src_url, pos, href)`` for each link inside each matching element.

    Nested matching elements repeat their links, as a search per element does.
    """
    found = with_scopes(pages.select("page_id", "url", "html"), scope, "found")
    links = F.flatten(F.transform("found", hrefs))
    return found.select("page_id", F.col("url").alias("src_url"), F.posexplode(links).alias("pos", "href"))


def resolve_links(links: DataFrame, base: Column | None = None) -> DataFrame:
    """Add the absolute ``url`` of each link, against its page or a given base."""
    return links.withColumn("url", resolve_url(F.col("src_url") if base is None else base, F.col("href")))


def toc_urls(pages: DataFrame, scope: str = LINK_SCOPE, base: str | None = None) -> DataFrame:
    """The frontier of a contents page: links resolved on their page, then on ``base``."""
    found = resolve_links(extract_links(pages, scope))
    if base is not None:
        found = found.withColumn("url", resolve_url(F.lit(base), F.col("url")))
    return found.select("page_id", "src_url", "pos", "url")


def frontier_limit(frontier: DataFrame, n: int = FRONTIER_LIMIT) -> DataFrame:
    """The first ``n`` links in document order."""
    return frontier.orderBy("page_id", "pos").limit(n)


def frontier_distinct(frontier: DataFrame) -> DataFrame:
    """One row per URL, at its first place; pre-aggregated before the shuffle."""
    first = F.min(F.struct("page_id", "pos")).alias("first")
    return frontier.groupBy("url").agg(first).select("url", "first.page_id", "first.pos")


def extract_title(html: Column, selector: str = TITLE) -> Column:
    """Text of the first matching element, NULL if there is none."""
    return inline_text(first_scope(html, selector))


def extract_content(html: Column, selector: str = CONTENT) -> Column:
    """Text of the content element, NULL if there is none."""
    return block_text(first_scope(html, selector))


def documents_from_pages(pages: DataFrame, title: str = TITLE, content: str = CONTENT) -> DataFrame:
    """Pages as documents; a page without the content element keeps a NULL content."""
    return conform(
        pages.select(
            "url",
            extract_title(F.col("html"), title).alias("page_title"),
            extract_content(F.col("html"), content).alias("content"),
        ),
        DOCUMENTS,
    )


def element_texts(pages: DataFrame, selector: str) -> DataFrame:
    """``(page_id, pos, text)`` of each matching element, in document order, its text nodes joined; see ``with_scopes``."""
    found = with_scopes(pages.select("page_id", "html"), selector, "found")
    return found.select("page_id", F.posexplode(F.transform("found", inline_text)).alias("pos", "text"))


def content_counts(documents: DataFrame) -> DataFrame:
    """Pages with and without content."""
    kept = F.col("content").isNotNull()
    return documents.agg(
        F.count_if(kept).alias("n_kept"),
        F.count_if(~kept).alias("n_missing"),
    )
