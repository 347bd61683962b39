"""From stored result pages to new posting stubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblode import constants as K
from joblode.functions.dates import parse_posted_date
from joblode.functions.html import Css, attribute, inner, opening_tag, short_inner, visible_text
from joblode.functions.text import job_id, let, nonempty, without_query
from joblode.operators.keys import BROADCAST_ROWS, first_by, take_first
from joblode.session import staged

# Where a results page and a posting page hold their parts.
CARD_LIST = Css("ul", "jobs-search__results-list")
CARD_ITEM = Css("li")
CARD_TITLE = Css("h3", "base-search-card__title")
CARD_LINK = Css("a", "base-card__full-link")
CARD_SUBTITLE = Css("h4", "base-search-card__subtitle")
CARD_COMPANY = Css("a", "hidden-nested-link")
CARD_LOCATION = Css("span", "job-search-card__location")
DESCRIPTIONS = (Css("div", "show-more-less-html__markup"), Css("div", "description__text"),
                Css("section", "description"), Css("div", "core-section-container__content"))
POSTED_TIME = (Css("time", "posted-time-ago__text"), Css("time", attr="datetime"))
POSTED_SPAN = (Css("span", "posted-time-ago__text"),
               Css("[a-z][a-z0-9]*", "topcard__flavor--metadata"))

ARRIVAL = ("keyword_ord", "page", "position")


def read_cards(pages: DataFrame) -> DataFrame:
    """Stubs of all cards on result pages ``(keyword, keyword_ord, page, html)``.

    A card counts if it has a title and a link whose address holds a job id.
    Everything is a narrow projection: pages are read, cut and filtered in place.
    """
    listed = inner(F.col("html"), CARD_LIST)
    items = F.slice(F.split(listed, f"(?i){CARD_ITEM.opening()}"), 2, 1 << 30)
    cards = pages.select("keyword", "keyword_ord", "page",
                         F.posexplode(items).alias("position", "card"))
    card = F.col("card")
    parts = cards.select(
        "keyword", "keyword_ord", "page", "position",
        visible_text(inner(card, CARD_TITLE)).alias("title"),
        opening_tag(card, CARD_LINK).alias("link"),
        inner(card, CARD_SUBTITLE).alias("subtitle"),
        visible_text(inner(card, CARD_LOCATION)).alias("location"))
    real = parts.filter((F.col("title") != "") & F.col("link").isNotNull())
    linked = real.withColumn("href", F.coalesce(attribute(F.col("link"), "href"), F.lit("")))
    nested = inner(F.col("subtitle"), CARD_COMPANY)
    company = F.when(nested.isNull(), F.lit(K.MISSING)).otherwise(
        F.coalesce(nonempty(visible_text(nested)), visible_text(F.col("subtitle"))))
    stubs = linked.select(
        job_id(F.col("href")).alias("id"), "title", company.alias("company"),
        F.coalesce("location", F.lit(K.MISSING)).alias("location"),
        without_query(F.col("href")).alias("url"),
        "keyword", "keyword_ord", "page", "position")
    return stubs.filter(F.col("id").isNotNull())


def read_details(pages: DataFrame, as_of) -> DataFrame:
    """``id, raw_description, posted_at`` of stored posting pages ``(id, html)``.

    The description is the first of four elements with more than 50 characters
    of text; without one the posting date is not kept either.
    """
    html = F.col("html")

    def usable(css: Css) -> Column:
        return let(visible_text(inner(html, css)),
                   lambda text: F.when(F.length(text) > K.MIN_DESCRIPTION, text))

    tag = opening_tag(html, *POSTED_TIME)
    parts = pages.select(
        "id", F.coalesce(*map(usable, DESCRIPTIONS)).alias("body"),
        nonempty(attribute(tag, "datetime")).alias("stamp"),
        visible_text(short_inner(html, *POSTED_TIME)).alias("age"),
        visible_text(short_inner(html, *POSTED_SPAN)).alias("note"))
    posted = F.coalesce(parse_posted_date(F.coalesce("stamp", "age"), as_of),
                        parse_posted_date(F.col("note"), as_of))
    return parts.select("id", F.coalesce("body", F.lit(K.MISSING)).alias("raw_description"),
                        F.when(F.col("body").isNotNull(), posted).alias("posted_at"))


def page_rule(cards: DataFrame, max_pages: int = K.MAX_PAGES,
              min_cards: int = K.MIN_PAGE_CARDS, n_keywords: int | None = None) -> DataFrame:
    """Cards of the pages that would have been opened.

    The next page of a keyword is opened only while every page before it had
    ``min_cards`` cards. Pages are counted first and come back to the cards in a
    semi-join: broadcast if the caller knows the number of keywords and it is
    small, since a keyword gives ``max_pages`` rows at most; otherwise left to
    AQE, which goes by the size it sees.
    """
    pages = (cards.filter(F.col("page") < max_pages).groupBy("keyword_ord", "page")
             .agg(F.count(F.lit(1)).alias("_cards")))
    opened = _few(_opened(pages, min_cards), max_pages, n_keywords)
    return cards.join(opened, ["keyword_ord", "page"], "left_semi")


def _opened(pages: DataFrame, min_cards: int) -> DataFrame:
    """Pages that are reached, of pages with their number of ``_cards``."""
    earlier = (Window.partitionBy("keyword_ord").orderBy("page")
               .rowsBetween(Window.unboundedPreceding, -1))
    full_before = F.count(F.when(F.col("_cards") >= min_cards, 1)).over(earlier)
    return pages.withColumn("_full", full_before).filter(
        F.col("_full") == F.col("page")).select("keyword_ord", "page")


def _few(pages: DataFrame, max_pages: int, n_keywords: int | None) -> DataFrame:
    """Marked to be broadcast if the keywords are known to be few."""
    known = n_keywords is not None and n_keywords * max_pages <= BROADCAST_ROWS
    return F.broadcast(pages) if known else pages


def page_rule_in_turn(cards: DataFrame, max_pages: int = K.MAX_PAGES, min_cards: int = K.MIN_PAGE_CARDS,
                      n_keywords: int | None = None) -> DataFrame:
    """Like :func:`page_rule`, as if the keywords were browsed one after another.

    A card whose posting was on an opened page of an earlier keyword does not count
    towards ``min_cards``. What a keyword opens depends on earlier ones alone, so one
    set of pages agrees with itself: the rule is applied again, to the counts that the
    last set leaves, until the set stays. Each round settles one more keyword at the
    least, mostly all of them in two or three. A round handles a row per posting, keyword and
    page, so that a posting that fills the pages is a few rows.
    """
    shown = staged(cards.filter(F.col("page") < max_pages).groupBy("id", "keyword_ord", "page").agg(
        F.count(F.lit(1)).alias("_n")), "cards-by-page")

    def again(opened: DataFrame | None) -> DataFrame:
        left = shown.withColumn("_taken", F.lit(False))
        if opened is not None:
            taken = _few(opened.withColumn("_open", F.lit(True)), max_pages, n_keywords)
            first = F.min(F.when(F.col("_open"), F.col("keyword_ord"))).over(Window.partitionBy("id"))
            left = shown.join(taken, ["keyword_ord", "page"], "left").withColumn("_by", first).withColumn(
                "_taken", F.coalesce(F.col("_by") < F.col("keyword_ord"), F.lit(False)))
        pages = left.groupBy("keyword_ord", "page").agg(
            F.sum(F.when(F.col("_taken"), 0).otherwise(F.col("_n"))).alias("_cards"))
        return staged(_opened(pages, min_cards), "opened-pages")

    opened, changed = again(None), True
    while changed:
        last, opened = opened, again(opened)
        changed = not last.unionAll(opened).groupBy("keyword_ord", "page").count().filter("count <> 2").isEmpty()
    return cards.join(_few(opened, max_pages, n_keywords), ["keyword_ord", "page"], "left_semi")


def first_seen(cards: DataFrame) -> DataFrame:
    """One row per job: that of the first keyword, page and position to show it."""
    rest = [c for c in cards.columns if c not in ("id", *ARRIVAL)]  # two stored copies of a page
    return first_by(cards, ["id"], (*ARRIVAL, *rest))


def daily_quota(stubs: DataFrame, done_today: int, target: int = K.DAILY_TARGET) -> DataFrame:
    """The first stubs in keyword order that the day's target leaves room for."""
    return take_first(stubs, (*ARRIVAL, "id"), target - done_today)


def harvest_stats(cards: DataFrame, kept: DataFrame, fetches: DataFrame) -> DataFrame:
    """Per keyword: cards seen, new postings, pages fetched and mean seconds per fetch.

    ``fetches`` is ``(keyword, seconds)``. The three inputs are stacked, so that a
    single aggregation, partial before its shuffle, serves all of them.
    """
    none = F.lit(None).cast("double")
    rows = (cards.select("keyword", F.lit("cards").alias("what"), none.alias("seconds"))
            .unionAll(kept.select("keyword", F.lit("new"), none))
            .unionAll(fetches.select("keyword", F.lit("fetched"), F.col("seconds"))))
    return rows.groupBy("keyword").agg(
        F.count_if(F.col("what") == "cards").alias("cards"),
        F.count_if(F.col("what") == "new").alias("new"),
        F.count_if(F.col("what") == "fetched").alias("fetched"),
        F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_seconds"))
