"""From dump rows to a packed link graph.

A dump is ``(page_no, ns, title, text)`` in the order of page_no.  Only namespace 0
counts.  A redirect is a node with at most one edge; of pages with one title the last
wins; links to titles that no page has are dropped from the graph but counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wikitext
from ..lineage import checkpoint, stored
from .ranking import dense_index


def main_rows(dump: DataFrame, namespace: int = 0) -> DataFrame:
    """(page_no, title, text) of the main namespace."""
    return dump.where(F.col("ns") == namespace).select("page_no", "title", F.coalesce("text", F.lit("")).alias("text"))


def main_pages(dump: DataFrame, namespace: int = 0) -> DataFrame:
    """(id, title, text) of the main namespace, ids dense in dump order; only numbers are ranked, so where the text isn't asked for it isn't moved."""
    pages = main_rows(dump, namespace)
    return pages.join(dense_index(pages.select("page_no"), "page_no", "id"), "page_no").select("id", "title", "text")


def parse(pages: DataFrame) -> DataFrame:
    """(page_no or id, title, is_redirect, target, link_titles): a redirect has a target, an article its distinct link titles.

    A narrow pass: what numbers or joins pages comes after it and never moves a text.
    """
    redirect = wikitext.is_redirect(F.col("text"))
    return pages.select(
        *(c for c in ("page_no", "id") if c in pages.columns),
        "title",
        redirect.alias("is_redirect"),
        wikitext.redirect_target(F.col("text")).alias("target"),
        F.when(~redirect, wikitext.link_titles(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("link_titles"),
    )


def numbered(parsed: DataFrame) -> DataFrame:
    """``parse`` of dump rows with dense ids in dump order for their page_no."""
    return dense_index(parsed, "page_no", "id").select("id", "title", "is_redirect", "target", "link_titles")


def page_links(parsed: DataFrame) -> DataFrame:
    """(id, link) of every article, also of pages that a later one replaces."""
    return parsed.select("id", F.explode("link_titles").alias("link"))


#: Rows that are sent to every task at most, some 100 MB.
FEW = 1_000_000


def few(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has few rows."""
    table = stored(table)
    return F.broadcast(table) if table.count() <= FEW else table


def last_wins(parsed: DataFrame) -> DataFrame:
    """One page a title, the one with the largest id; where few lose, the others stay where they are."""
    named = parsed.where("title is not null")
    repeated = named.groupBy("title").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select("title", "last")
    lost = named.select("title", "id").join(few(repeated), "title").where("id < last").select("title", "id")
    return named.join(few(lost), ["title", "id"], "left_anti")


def title_universe(parsed: DataFrame) -> DataFrame:
    """All titles that pages have or articles link to; redirect targets don't count."""
    return parsed.select("title").unionByName(page_links(parsed).select(F.col("link").alias("title"))).distinct()


def java_hash_rank(title: Column) -> Column:
    """A rank for ``dropped_redirects``: the 32-bit polynomial hash of the title's UTF-16 units, base 31, and the title where hashes are equal."""
    units = F.encode(title, "UTF-16BE")
    unit = lambda i: F.conv(F.hex(F.substring(units, (2 * i + 1).cast("int"), F.lit(2))), 16, 10).cast("long")
    count = F.floor(F.octet_length(units) / 2)
    places = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    hashed = F.aggregate(places, F.lit(0).cast("long"), lambda h, i: F.pmod(h * 31 + unit(i), F.lit(1 << 32)))
    return F.struct(F.when(hashed >= 1 << 31, hashed - (1 << 32)).otherwise(hashed).alias("hash"), title.alias("title"))


def dropped_redirects(live: DataFrame, universe: DataFrame, rank: Column | None = None) -> DataFrame:
    """(id) of the redirects that cleanup removes.

    A redirect's walk fails if it comes to a title outside the universe or to a redirect
    again; a failing redirect goes if its rank is the least on its walk (``rank``: by
    default its id).  Walks double their length each round, so chains and cycles of any
    length take a logarithmic number of joins.
    """
    redirects = live.where("is_redirect").select("id", "title", "target", (F.col("id") if rank is None else rank).alias("rank"))
    # of all titles only those that redirects lead to are asked for, before they are made distinct
    targets = few(redirects.select(F.col("target").alias("title")).distinct())
    names = universe.join(targets, "title", "left_semi").select(F.col("title").alias("target"), F.lit(True).alias("known"))
    pages = live.select(F.col("title").alias("target"), F.when(F.col("is_redirect"), F.col("id")).alias("next"))
    state = redirects.join(names, "target", "left").join(pages, "target", "left")
    ended = F.when(F.col("known").isNull(), F.lit("fail")).when(F.col("next").isNull(), F.lit("ok"))
    state = checkpoint(state.select("id", "rank", F.col("rank").alias("least"), "next", ended.alias("ended")))
    walks, length = state.where("ended is null").count(), 1
    total = walks
    while walks and length <= 2 * total:
        far = state.select(F.col("id").alias("next"), F.col("least").alias("far_least"), F.col("next").alias("far_next"), F.col("ended").alias("far_ended"))
        moved = state.join(far, "next", "left")
        going = F.col("ended").isNull()
        state = checkpoint(moved.select("id", "rank", F.when(going, F.least("least", "far_least")).otherwise(F.col("least")).alias("least"), F.when(going, F.col("far_next")).otherwise(F.col("next")).alias("next"), F.coalesce("ended", "far_ended").alias("ended")))
        walks, length = state.where("ended is null").count(), 2 * length
    return state.where("coalesce(ended, 'fail') = 'fail' and rank = least").select("id")


def clean(live: DataFrame, universe: DataFrame, rank: Column | None = None) -> DataFrame:
    """The pages that stay after redirect cleanup."""
    return live.join(dropped_redirects(live, universe, rank), "id", "left_anti")


def edges_of(live: DataFrame) -> DataFrame:
    """Distinct (src, dst): article links and redirect targets that lead to a live page.

    A page's link titles are distinct and a title has one live page, so no edge comes twice.
    """
    links = live.select(F.col("id").alias("src"), F.explode(F.when(F.col("is_redirect"), F.array("target")).otherwise(F.col("link_titles"))).alias("title"))
    return links.join(live.select("title", F.col("id").alias("dst")), "title").select("src", "dst")


def nodes_of(live: DataFrame) -> DataFrame:
    return live.select("id", "title", "is_redirect")


def packed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, title, is_redirect, links) with ascending link ids."""
    links = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("links"))
    return nodes.join(links, "id", "left").withColumn("links", F.coalesce("links", F.array().cast("array<bigint>")))


def statistics(live: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: articles, redirects, links of articles to live pages, and null links (titles without a page, and links to them)."""
    titles = live.select("title", F.lit(True).alias("has_page"))
    links = page_links(live.where("not is_redirect")).join(titles.withColumnRenamed("title", "link"), "link", "left")
    zero = F.lit(0).cast("long")
    parts = live.agg(F.count_if(~F.col("is_redirect")).alias("articles"), F.count_if("is_redirect").alias("redirects")).select("*", zero.alias("links"), zero.alias("null_links"))
    parts = parts.unionByName(links.agg(F.count("has_page").alias("links"), F.count_if(F.col("has_page").isNull()).alias("null_links")).select(zero.alias("articles"), zero.alias("redirects"), "*"))
    parts = parts.unionByName(universe.join(titles, "title", "left_anti").agg(F.count("*").alias("null_links")).select(zero.alias("articles"), zero.alias("redirects"), zero.alias("links"), "*"))
    return parts.agg(*(F.sum(c).alias(c) for c in ("articles", "redirects", "links", "null_links")))
