import random
from datetime import date, datetime
from html.parser import HTMLParser

from pyspark.sql import functions as F

from joblode import constants as K
from joblode.functions.html import Css, attribute, short_inner, visible_text
from joblode.operators import harvest as H
from joblode.plans import ingest as P
from joblode.session import shared_dir
from joblode.sources import frontier as R
from joblode.sources import tables as B

NOW = datetime(2024, 3, 10, 2)


def card(number, title="Dev", company='<a class="hidden-nested-link">Co</a>', link=True):
    href = f'<a class="base-card__full-link" href="https://j.example/view/x-{number}?r=1"></a>'
    return (f'<li>{href if link else ""}<h3 class="base-search-card__title">{title}</h3>'
            f'<h4 class="base-search-card__subtitle">{company}</h4></li>')


def page(*cards):
    return f'<ul class="jobs-search__results-list">{"".join(cards)}</ul>'


def pages(spark, rows):
    return spark.createDataFrame(rows, "keyword string, keyword_ord int, page int, html string")


def test_frontier(spark):
    seeds = R.keyword_seeds(spark)
    rows = R.search_frontier(seeds, (0, 25)).collect()
    assert len(rows) == 2 * len(K.KEYWORDS)
    url = next(r["url"] for r in rows if r["keyword"] == "full stack" and r["offset"] == 25)
    assert url == (K.SEARCH_BASE + "?keywords=full%20stack&location=Israel&sortBy=DD&start=25"
                   "&f_TPR=r604800")
    assert R.search_frontier(seeds, (0,), None).first()["url"].endswith("&start=0")
    stored = spark.createDataFrame([(r["url"], "x") for r in rows], "url string, html string")
    found = R.result_pages(stored, seeds).select("keyword", "keyword_ord", "page").collect()
    assert {tuple(r) for r in found} == {(k, i, p) for i, k in enumerate(K.KEYWORDS) for p in (0, 1)}


def test_cards(spark):
    html = page(card(1234567), card(1234568, " "), card(1234569, link=False), card(12),
                card(1234570, company="Plain"), card(1234571, company='<a class="hidden-nested-link"> </a>Out'))
    rows = H.read_cards(pages(spark, [("k", 0, 0, html), ("k", 0, 1, "<p>none</p>")])).collect()
    assert [(r["id"], r["company"], r["position"]) for r in rows] == [
        ("1234567", "Co", 0), ("1234570", "N/A", 4), ("1234571", "Out", 5)]
    assert rows[0]["location"] == "N/A" and rows[0]["url"] == "https://j.example/view/x-1234567"


def test_details(spark):
    long = "word " * 20
    rows = spark.createDataFrame([
        ("1", f'<div class="show-more-less-html__markup">{long}</div><time datetime="2024-01-02">'),
        ("2", f'<section class="description"><div>{long}</div></section><time class="posted-time-ago__text">'
              "2 days ago</time>"),
        ("3", f'<div class="description__text">{long}</div><time datetime="soon"></time>'
              '<span class="posted-time-ago__text">3 weeks ago</span>'),
        ("4", '<div class="description__text">short</div><time datetime="2024-01-02"></time>')],
        "id string, html string")
    got = {r["id"]: (r["raw_description"], r["posted_at"]) for r in H.read_details(rows, NOW).collect()}
    assert got == {"1": (long.strip(), date(2024, 1, 2)), "2": (long.strip(), date(2024, 3, 8)),
                   "3": (long.strip(), date(2024, 2, 18)), "4": ("N/A", None)}


def cards(spark, rows):
    return spark.createDataFrame(rows, "id string, keyword_ord int, page int, position int")


def test_first_keyword_owns_a_job(spark):
    rows = H.first_seen(cards(spark, [("7", 3, 0, 0), ("7", 0, 1, 5), ("8", 1, 0, 0)])).collect()
    assert {(r["id"], r["keyword_ord"]) for r in rows} == {("7", 0), ("8", 1)}


def test_page_rule(spark):
    def kept(n_first, n_keywords=None):
        rows = [(f"a{i}", 0, 0, i) for i in range(n_first)] + [("b", 0, 1, 0), ("c", 0, 2, 0)]
        ruled = H.page_rule(cards(spark, rows), n_keywords=n_keywords)
        return {r["id"] for r in ruled.collect() if r["page"] > 0}
    assert kept(4) == set() and kept(0) == set() and kept(5) == {"b"} and kept(5, 1) == {"b"}


def loop(rows, max_pages=2, least=5):
    """The rule as a loop over keywords and pages."""
    seen, opened = set(), set()
    for k in sorted({r[1] for r in rows}):
        ids = set()
        for p in range(max_pages):
            fresh = [r[0] for r in rows if r[1] == k and r[2] == p and r[0] not in seen]
            opened.add((k, p))
            ids |= set(fresh)
            if len(fresh) < least:
                break
        seen |= ids
    return {tuple(r) for r in rows if (r[1], r[2]) in opened}


def test_page_rule_in_turn(spark):
    draw = random.Random(3)
    for n_ids, n_keywords, n_pages in ((25, 8, 2), (40, 6, 3), (12, 10, 2), (1, 4, 2)):
        rows = [(f"j{draw.randrange(n_ids)}", draw.randrange(n_keywords), draw.randrange(n_pages + 1), i)
                for i in range(9 * n_keywords * n_pages)]
        rows += [("hot", i % n_keywords, 0, 1000 + i) for i in range(len(rows) // 2)]  # a third of the cards
        found = H.page_rule_in_turn(cards(spark, rows), n_pages, 5, n_keywords=n_keywords)
        assert {tuple(r) for r in found.select("id", "keyword_ord", "page", "position").collect()} == loop(rows, n_pages)
    # A chain: whether a keyword opens its second page turns on whether the one before it did.
    chain = []
    for k in range(7):
        chain += [(f"{k}-{i}", k, 0, i) for i in range(3)] + [(f"{k - 1}-x{i}", k, 0, 3 + i) for i in range(2)]
        chain += [(f"{k}-x{i}", k, 1, 10 + i) for i in range(2)]
    found = H.page_rule_in_turn(cards(spark, chain)).select("keyword_ord").filter("page = 1").distinct()
    assert {r[0] for r in found.collect()} == {r[1] for r in loop(chain) if r[2] == 1} == {0, 2, 4, 6}
    assert H.page_rule_in_turn(cards(spark, chain).limit(0)).count() == 0


class Inside(HTMLParser):
    """Text of the first element of a class, by depth."""

    def __init__(self, cls):
        super().__init__()
        self.cls, self.name, self.depth, self.text = cls, None, 0, []

    def handle_starttag(self, tag, attrs):
        if self.name is None and self.cls in (dict(attrs).get("class") or "").split():
            self.name, self.depth = tag, 1
        elif tag == self.name and self.depth:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag == self.name and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.text.append(data)


def test_elements_of_any_tag_nest(spark):
    draw = random.Random(8)

    def tree(depth):
        if depth == 0 or draw.random() < 0.2:
            return f" w{draw.randrange(99)} "
        tag = draw.choice(["span", "SPAN", "b", "spanner", "s"])
        return f"<{tag} id='q'>" + "".join(tree(depth - 1) for _ in range(draw.randrange(3))) + f"</{tag.lower()}>"

    htmls = [f"<div>{tree(2)}<{t} class='a x'>{''.join(tree(4) for _ in range(3))}</{t} >{tree(2)}</div>{tree(3)}"
             for t in ("span", "b", "Span", "s", "spanner") for _ in range(12)]
    htmls += ["<b>no</b>", "<span class='x'>open", "<span class='x'></span>after", "", None]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in htmls], "h string").select(
        visible_text(short_inner(F.col("h"), Css("[a-z][a-z0-9]*", "x")))).collect()]
    for html, text in zip(htmls[:-5], got):
        parser = Inside("x")
        parser.feed(html)
        assert text == " ".join("".join(parser.text).split()), html
    assert got[-5:] == [None, "", "", None, None]


def test_quota(spark):
    five = cards(spark, [(str(i), i, 0, 0) for i in range(5)])
    assert [r["id"] for r in H.daily_quota(five, 48, 50).orderBy("id").collect()] == ["0", "1"]
    assert H.daily_quota(five, 50, 50).count() == 0 and H.daily_quota(five, 60, 50).count() == 0


def test_stats(spark):
    k = spark.createDataFrame([("a",), ("a",), ("b",)], "keyword string")
    f = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "keyword string, seconds double")
    rows = {r[0]: tuple(r)[1:] for r in H.harvest_stats(k, k.limit(1), f).collect()}
    assert rows == {"a": (2, 1, 2, 2.0), "b": (1, 0, 0, 0.0)}


def test_page_numbers(spark):
    """Pages are numbered by offset, and the third is closed."""
    seeds = spark.createDataFrame([(0, "ai"), (1, "go")], "keyword_ord int, keyword string")
    five = [card(1000000 + 10 * n) for n in range(5)]
    stored = [("ai", o, page(*[c.replace("10000", f"1{o:02d}00") for c in five])) for o in (0, 25, 50, 75)] + [("go", 25, page(*five))]
    found = R.result_pages(spark.createDataFrame([(f"{K.SEARCH_BASE}?keywords={k}&start={o}", h) for k, o, h in stored],
                                                 "url string, html string"), seeds)
    assert {(r["keyword"], r["page"]) for r in found.collect()} == {("ai", 0), ("ai", 1), ("ai", 2), ("ai", 3), ("go", 1)}
    opened = H.page_rule(H.read_cards(found)).select("keyword", "page").distinct().collect()
    assert {tuple(r) for r in opened} == {("ai", 0), ("ai", 1)}


def test_references_and_attributes(spark):
    texts = [("We&#8217;re &#x27;in&#x27; &ndash; caf&eacute; &amp;amp; &bogus; &#xD800; a&b&#160;x",
              "We\u2019re 'in' \u2013 caf\u00e9 &amp; &bogus; \ufffd a&b x"), ("plain", "plain"), ("&lt;p&gt;", "<p>")]
    rows = spark.createDataFrame(texts, "t string, want string")
    assert all(r[0] == r[1] for r in rows.select(visible_text(F.col("t")), "want").collect())
    tag = spark.createDataFrame([('<a data-href="/x" href="/y">',)], "t string")
    assert tag.select(attribute(F.col("t"), "href")).first()[0] == "/y"


def test_scratch_is_left_empty(spark, tmp_path):
    """A run leaves no copies behind."""
    import os

    root = shared_dir(spark) + "/joblode"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    found = pages(spark, [("go", 1, 0, page(card(1000001)))])
    details = spark.createDataFrame([], "id string, html string")
    P.run_all(spark, found, details, str(tmp_path / "j"), str(tmp_path / "v"), as_of=NOW)
    assert set(os.listdir(root)) <= before


def test_whole_run(spark, tmp_path):
    jobs_path, vectors_path = str(tmp_path / "jobs"), str(tmp_path / "vectors")
    found = pages(spark, [
        ("go", 1, 0, page(card(1000001), card(1000002))),
        ("ai", 0, 0, page(card(1000002, "NLP Engineer"), *[card(1000010 + i) for i in range(4)])),
        ("ai", 0, 1, page(card(1000099)))])
    body = '<div class="description__text">We need 3+ years of experience in SaaS and python, for sure.</div>'
    details = spark.createDataFrame([("1000002", body), ("1000002", "<p>later</p>"), ("1000001", body)],
                                    "id string, html string")
    run = lambda target, now=NOW: P.run_all(spark, found, details, jobs_path, vectors_path, as_of=now,
                                            target=target)
    counts = run(6)
    assert (counts.jobs.sent, counts.jobs.inserted) == (6, 6)
    rows = {r["id"]: r for r in B.read_jobs(spark, jobs_path).collect()}
    assert set(rows) == {"1000002", "1000010", "1000011", "1000012", "1000013", "1000099"}
    assert rows["1000002"]["keyword"] == "ai" and rows["1000002"]["role"] == "AI / ML"
    assert rows["1000002"]["skills_must"] == ["python"] and rows["1000002"]["yearsexperience"] == 3
    assert rows["1000010"]["description"] is None and rows["1000010"]["role"] == "Other"
    assert rows["1000002"]["source"] == "linkedin" and rows["1000002"]["scraped_at"] == NOW
    assert run(6).jobs.sent == 0  # the day is full
    again = run(6, datetime(2024, 3, 11))
    assert again.jobs.inserted == 1 and again.vectors.inserted > 0  # 1000001, the next day
    ids = [r["vector_id"] for r in B.read_vectors(spark, vectors_path).select("vector_id").collect()]
    assert len(ids) == len(set(ids)) and {i.split("_")[0] for i in ids} == set(rows) | {"1000001"}
    assert P.load_vectors(spark, jobs_path, vectors_path).sent == 0
