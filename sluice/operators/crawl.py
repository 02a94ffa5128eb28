"""Breadth-first crawl over captured pages: link edges, levels, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import extract_deadline
from ..functions.htmldom import crawl_page, page_links
from ..functions.text import clean_text, computed_once, filled, has_any, slug_title, truncated
from ..functions import vocabulary as v
from ..functions.urls import crawl_domain, crawl_url, is_document, is_excluded_link, join_url, link_relevance, netloc, path, query, same_domain

MAX_PAGES, MAX_DEPTH, MIN_TEXT, MAX_DESCRIPTION = 30, 2, 80, 20_000
#: The name under which robots rules are asked.
AGENT = "sluice-crawler"


def link_edges(pages: DataFrame) -> DataFrame:
    """Relevant same-site links of pages (url, html): page_url, url, link_text, score, ordinal, rank."""
    from .upsert import best_links

    raw = pages.select(F.col("url").alias("page_url"), F.explode(page_links("html")).alias("a")).select("page_url", "a.*")
    raw = raw.where(F.col("href") != "").withColumn("url", crawl_url(join_url("page_url", "href")))
    raw = raw.where((F.col("url") != "") & same_domain(netloc("url"), netloc("page_url")))
    info = F.lower(clean_text(F.concat_ws(" ", "link_text", "url")))
    raw = raw.withColumn("_info", info).where(~is_excluded_link("_info"))
    raw = raw.withColumn("score", link_relevance("_info")).where("score >= 1")
    raw = raw.withColumn("score", F.col("score") + F.when(is_document("url"), 5).otherwise(0))
    return best_links(raw)


def forbidden(links: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """The distinct ``url`` of ``links`` that their host's robots rules forbid.

    ``robots``: host, agent, ordinal, path, allow.  A host's rules for an agent whose name ours holds
    go before its rules for ``*``.  Of those the first by ordinal that the url's path and query start
    with decides (a path ``*`` fits all, an empty one that forbids allows all); a url that none fits
    may be loaded, and so may all of a host without rules.
    """
    named = F.lower(F.trim("agent"))
    own = robots.where((named == "*") | F.contains(F.lit(agent.lower()), named))
    allowed = F.col("allow") | (F.col("path") == "")
    rules = own.groupBy(F.lower("host").alias("_host")).agg(F.sort_array(F.collect_list(F.struct((named == "*").alias("other"), "ordinal", "path", allowed.alias("allow")))).alias("_rules"))
    asked = F.concat(path("url"), F.when(query("url") != "", F.concat(F.lit("?"), query("url"))).otherwise(F.lit("")))
    rows = links.select("url").distinct().withColumns({"_host": F.lower(netloc("url")), "_asked": asked}).join(rules, "_host")
    # Rules for our name are sorted first; those for any agent count where there are none.
    fits = lambda r: (r["other"] == F.col("_rules")[0]["other"]) & ((r["path"] == "*") | F.startswith(F.col("_asked"), r["path"]))
    return rows.where(~F.coalesce(F.get(F.filter("_rules", fits), F.lit(0))["allow"], F.lit(True))).select("url")


def crawl(sources: DataFrame, edges: DataFrame, pages: DataFrame, disallowed: DataFrame | None = None, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH, robots: DataFrame | None = None) -> DataFrame:
    """Visited pages of each source: source_id, url, depth, position.

    ``sources``: id, monitor_url, base_url, domain.  ``edges``: link_edges.
    ``pages``: url of the pages that could be loaded.  ``disallowed``: url a
    robots rule forbids; ``robots``: the rules themselves, as in ``forbidden``.  Levels are joined one by one; a page is visited at
    its first level, and each source stops at ``max_pages`` in queue order.
    Pages that cannot be loaded count as visited but lead nowhere.
    """
    seeds = sources.select(F.col("id").alias("source_id"), crawl_domain("domain").alias("site"), F.posexplode(F.array(crawl_url("monitor_url"), crawl_url("base_url"))).alias("o", "url"))
    level = seeds.where("url <> ''").groupBy("source_id", "site", "url").agg(F.min(F.col("o").cast("string")).alias("path"))
    known = computed_once(pages.select("url"), {"page_url": crawl_url("url")}).select("page_url", F.lit(True).alias("_loads")).distinct()
    links = edges.select(F.col("page_url").alias("_from"), F.col("url").alias("_to"), "rank").join(known, F.col("_from") == F.col("page_url")).drop("page_url", "_loads")
    visited = None
    for depth in range(max_depth + 1):
        level = level.where(same_domain("url", "site"))
        if disallowed is not None:
            level = level.join(disallowed.select(F.col("url").alias("_no")), F.col("url") == F.col("_no"), "left_anti")
        if robots is not None:
            level = level.join(forbidden(level, robots), "url", "left_anti")
        if visited is not None:
            level = level.join(visited.select("source_id", "url"), ["source_id", "url"], "left_anti")
        # What lies further back than max_pages in its own level is never reached, nor is what it leads to.
        place = F.row_number().over(Window.partitionBy("source_id").orderBy("path"))
        level = level.withColumn("_place", place).where(F.col("_place") <= max_pages).drop("_place").withColumn("depth", F.lit(depth))
        visited = level if visited is None else visited.unionByName(level)
        if depth < max_depth:
            onward = level.where(~is_document("url")).join(links, F.col("url") == F.col("_from"))
            # The place in the queue: the parents' places, then the link's rank.
            spot = F.concat_ws(".", "path", F.lpad(F.col("rank").cast("string"), 6, "0"))
            level = onward.select("source_id", "site", F.col("_to").alias("url"), spot.alias("path")).groupBy("source_id", "site", "url").agg(F.min("path").alias("path"))
    queue = Window.partitionBy("source_id").orderBy("depth", "path")
    return visited.withColumn("position", F.row_number().over(queue)).where(F.col("position") <= max_pages).select("source_id", "url", "depth", "position")


def looks_like_opportunity(text) -> F.Column:
    return (F.length(text) >= MIN_TEXT) & has_any(F.lower(text), v.PAGE_OPPORTUNITY)


def page_listings(visited: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Raw listings of visited pages and documents.

    The HTML batch function runs once per distinct page that was visited.
    """
    who = sources.select(F.col("id").alias("source_id"), "organisation_name", F.coalesce("organisation_name", "domain").alias("source_name"))
    here = visited.join(who, "source_id")
    # Documents are told by their address: their pages are not read.
    html = pages.select(crawl_url("url").alias("url"), "html").where(~is_document("url")).dropDuplicates(["url"]).join(visited.select("url").distinct(), "url", "left_semi")
    fields = html.select("url", crawl_page("html", "title", "description").alias("f")).select("url", "f.title", "f.description")
    web = here.where(~is_document("url")).join(fields, "url")
    web = web.withColumn("_all", clean_text(F.concat_ws(" ", "title", "description")))
    web = web.where(looks_like_opportunity(F.col("_all"))).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), slug_title("url", v.CRAWL_DOCUMENT_EXTENSIONS)))
    web = web.withColumn("description", truncated(F.coalesce(F.nullif("description", F.lit("")), "title"), MAX_DESCRIPTION))
    docs = here.where(is_document("url")).withColumn("title", slug_title("url", v.CRAWL_DOCUMENT_EXTENSIONS))
    docs = docs.withColumn("_all", clean_text(F.concat_ws(" ", "title", "url"))).where(looks_like_opportunity(F.col("_all")))
    docs = docs.withColumn("description", F.concat(F.lit("Opportunity document discovered on "), "source_name", F.lit(": "), "title"))
    cols = ["source_id", "url", "position", "organisation_name", "source_name", "title", "description", "_all"]
    rows = web.select(*cols).unionByName(docs.select(*cols)).where(F.col("title") != "")
    return rows.select(
        F.coalesce("organisation_name", "source_name").alias("organisation_name"), truncated("title", 500).alias("title"),
        truncated("source_name", 100).alias("source_name"), F.col("url").alias("source_url"), "description",
        extract_deadline("_all").alias("deadline"), F.col("position").cast("long").alias("ordinal"),
    )


def section_pages(sections: DataFrame, found: DataFrame, max_pages: int = 5) -> DataFrame:
    """Index pages that are read: up to the first that brings no new link.

    ``found``: section, page, listing_url (null where a page is empty or fails).
    Page 0 stops only when empty.
    """
    grid = sections.select("section", F.explode(F.sequence(F.lit(0), F.lit(max_pages - 1))).alias("page"))
    firsts = found.where("listing_url is not null").groupBy("section", "listing_url").agg(F.min("page").alias("page"))
    fresh = firsts.groupBy("section", "page").agg(F.count("*").alias("new_links"))
    rows = grid.join(fresh, ["section", "page"], "left").withColumn("new_links", F.coalesce("new_links", F.lit(0)))
    stop = rows.where("new_links = 0").groupBy("section").agg(F.min("page").alias("stop"))
    return rows.join(stop, "section", "left").where("stop is null or page < stop").select("section", "page", "new_links")


def portal_listings(cards: DataFrame, details: DataFrame, portal_name: str, site_suffixes=()) -> DataFrame:
    """Raw listings of a portal: previews with their detail pages where those load.

    ``cards``: listing_url, title, card_text, organisation_name, ordinal (one a
    listing).  ``details``: listing_url, html.
    """
    from ..functions.dates import iso_or_parsed
    from ..functions.htmldom import portal_page
    from ..functions.text import choose_organisation, first_text, remove_site_names

    page = details.select("listing_url", portal_page("html").alias("p"))
    rows = cards.join(page, "listing_url", "left")
    own = F.when(F.col("p.title_from_meta"), remove_site_names("p.title", site_suffixes)).otherwise(F.col("p.title"))
    rows = rows.withColumn("_title", F.when(F.col("p").isNull(), clean_text("title")).otherwise(first_text(own, "p.ld_title", "title", slug_title("listing_url"))))
    org = choose_organisation("_title", filled("p.organisation"), filled("p.ld_organisation"), filled("organisation_name"), filled("p.meta_organisation"))
    deadline = F.coalesce(
        iso_or_parsed("p.ld_deadline"), extract_deadline("p.page_text", v.PORTAL_DEADLINES), extract_deadline("card_text", v.PORTAL_DEADLINES)
    )
    return rows.where(F.col("_title") != "").select(
        truncated(org, 255).alias("organisation_name"), truncated("_title", 500).alias("title"), F.lit(portal_name).alias("source_name"),
        F.col("listing_url").alias("source_url"), first_text("p.description", "p.ld_description", "card_text", "_title").alias("description"),
        deadline.alias("deadline"), F.col("ordinal").cast("long").alias("ordinal"),
    )
