"""Cases of the functions that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from postflow.functions import places, quality, text, urls, values
from postflow.operators import rules


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "country", "city", "mode"),
    [
        ("Berlin, Germany (Hybrid)", "DE", "Berlin", "hybrid"),
        ("Remote (United States)", "US", None, "remote"),
        ("Sarıyer, Istanbul", "TR", "Sarıyer", "unknown"),
        ("Austin, TX", "US", "Austin", "unknown"),
        ("Saint-Denis", None, "Saint-Denis", "unknown"),
        ("US Remote National", "US", "US Remote National", "remote"),
        (None, None, None, "unknown"),
    ],
)
def test_location(spark, raw, country, city, mode):
    got = one(spark, places.parse_location, raw)
    assert (got["country"], got["city"], got["remote_type"]) == (country, city, mode)


@pytest.mark.parametrize(("name", "want"), [("Acme Technologies, Inc.", "acme technologies"), ("Holding Company", "holding company"), ("Söğüt GmbH & Co", "sogut"), (None, "")])
def test_company(spark, name, want):
    assert one(spark, text.normalize_company_name, name) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1577836800", "2020-01-01 00:00:00"), ("1577836800000", "2020-01-01 00:00:00"), ("2020-01-01T03:00:00+03:00", "2020-01-01 00:00:00"), ("Wed, 01 Jan 2020 00:00:00 +0000", "2020-01-01 00:00:00"), ("soon", None), (None, None)],
)
def test_datetime(spark, raw, want):
    got = one(spark, values.parse_datetime, raw)
    assert (str(got) if got else None) == want


def test_html(spark):
    page = "<nav>x</nav><p>One&nbsp;&amp; two</p><div>Three<br>four</div><script>y()</script>"
    assert one(spark, text.html_to_text, page) == "One & two\n\nThree\nfour"
    assert one(spark, text.html_to_markdown, "<nav><a href='u'>x</a></nav><h2>Head</h2><ul><li>a</li><li><b>b</b></li></ul>") == "## Head\n\n- a\n- **b**"


def test_board_hits(spark):
    got = one(spark, urls.board_hits, 'see https:\\/\\/boards.greenhouse.io\\/acme and acme.wd5.myworkdayjobs.com/en-US/Careers, jobs.lever.co/123')
    assert {(h["provider"], h["token"]) for h in got} == {("greenhouse", "acme"), ("workday", "acme/wd5/Careers")}


def test_quality(spark):
    good = ("We are looking for someone who will do a good deal of work here. " * 10).strip()
    assert one(spark, quality.assess, good)["passed"]
    assert one(spark, quality.assess, None)["score"] == 0.0
    assert not one(spark, quality.assess, "short")["passed"]


def test_unknown_is_never_a_reason(spark):
    own = rules.Rules(max_age_days=3, allowed={"country": ("DE",)}, min_level="mid", min_annual=1.0, min_overlap=4.0)
    c = F.col
    reasons = [*rules.age(c("d"), own), *rules.field_mismatch({"country": c("s")}, own), *rules.seniority(c("s"), own), *rules.salary(c("v"), c("s"), c("s"), own), *rules.time_zone(c("s"), c("s"), own)]
    df = spark.createDataFrame([(None, None, None)], "d int, s string, v double")
    assert rules.judged(df, reasons).first()["verdict"]["passed"]


def test_simhash_by_hand(spark):
    import hashlib

    def plain(said, digest):
        w = said.lower().split()
        parts = [" ".join(w[i : i + 2]) for i in range(len(w) - 1)] or w
        value = [int.from_bytes(digest(p.encode()), "big") for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in value) > len(value))

    said = "one two three four five six seven"
    assert one(spark, text.simhash_blake2b, said) == f"{plain(said, lambda x: hashlib.blake2b(x, digest_size=8).digest()):016x}"
    got = one(spark, text.simhash_md5, said)
    assert got["hi"] << 32 | got["lo"] == plain(said, lambda x: hashlib.md5(x).digest()[:8])
    assert one(spark, text.simhash_md5, " .,! ") is None and one(spark, text.simhash_md5, None) is None and one(spark, text.simhash_blake2b, "") is None


def test_latex_prose(spark):
    source = "\\documentclass{article} % c\n\\begin{document}\n\\section{Work}\nBuilt \\textbf{things} at scale. % note\n\\end{document}"
    got = one(spark, text.latex_to_prose, source)
    assert "Work" in got and "Built things at scale." in got and "\\" not in got and "note" not in got and "article" not in got
    assert not one(spark, text.latex_to_prose, None)


def test_quality_parts(spark):
    low = ("Cookie policy: we are an equal opportunity employer. " * 20).strip()
    assert not one(spark, quality.assess, low)["passed"]
    cut = ("We are looking for people who do this. " * 12).strip() + " read more"
    got = one(spark, quality.assess, cut)
    assert got["score"] == 0.75 and got["passed"] and got["chars"] == len(cut)


def test_main_content_by_density(spark):
    """On the supplied pages, the words of <article> are found and little else; menus, footers and advertisements stay out."""
    import re
    from collections import Counter

    from postflow.functions import density

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html", density.segments(F.col("html")).alias("found")).withColumn("best", density.best_run(F.col("found")))
    hit = said = wanted = 0
    for html, text in df.select("html", density.content(F.col("found"), F.col("best"))).collect():
        body = re.search(r"(?s)<article>(.*?)</article>", html)
        own = Counter(re.sub(r"<[^>]*>", " ", body[1] if body else "").split())
        got = Counter((text or "").split())
        hit, said, wanted = hit + (own & got).total(), said + got.total(), wanted + own.total()
    assert hit / wanted > 0.97 and hit / said > 0.9
    rows = [(None,), ("",), ("<p>short</p>",), ("<nav><li><a href='/x'>" + "menu " * 30 + "</a></li></nav><div>" + "long text " * 20 + "</div><p>and</p><p>" + "more text " * 20 + "</p><footer>© x</footer>",)]
    df = spark.createDataFrame(rows, "html string").select(density.segments(F.col("html")).alias("found")).withColumn("best", density.best_run(F.col("found")))
    got = [r[0] for r in df.select(density.content(F.col("found"), F.col("best"))).collect()]
    assert got[:3] == [None, None, None] and got[3].split("\n") == [("long text " * 20).strip(), "and", ("more text " * 20).strip()]


def test_table_functions_lose_nothing(spark):
    from postflow.functions import page_tables

    card = lambda i, title: f'<div class="base-card" data-entity-urn="urn:li:jobPosting:{i}"><h3 class="base-search-card__title">{title}</h3></div>'
    ad = lambda href, title: f'<div data-test="ad-card"><a data-test="ad-card-item" href="{href}"><span data-test="ad-card-title">{title}</span></a></div>'
    pages = [(1, card(7, "Dev") + card("", "Lost") + card(9, "")), (2, None), (3, "<p>none</p>"), (4, ad("/x-12?a=1", "Ops") + ad("/x", "Bad")), (5, '<nav><a href="/a">A</a></nav><a>B</a><footer><a href="/c">C</a></footer>')]
    df = spark.createDataFrame(pages, "page_id int, html string").repartition(2)
    rows = lambda table, *columns: sorted((tuple(r[c] for c in ("page_id", "n", *columns, "error")) for r in page_tables.told(df, "html", table).collect() if r["n"] or r["error"]), key=repr)
    assert rows(page_tables.profile_rows, "id", "title") == sorted([(1, 1, "7", "Dev", None), (1, 2, None, None, "no id"), (1, 3, None, None, "no title"), (2, None, None, None, "no page")], key=repr)
    assert rows(page_tables.board_rows, "id", "path") == sorted([(4, 1, "12", "/x-12", None), (4, 2, None, None, "no number in its link"), (2, None, None, None, "no page")], key=repr)
    assert rows(page_tables.links, "href", "place") == sorted([(4, 1, "/x-12?a=1", "other", None), (4, 2, "/x", "other", None), (5, 1, "/a", "nav", None), (5, 2, None, None, "no href"), (5, 3, "/c", "footer", None), (2, None, None, None, "no page")], key=repr)
    assert {r["page_id"] for r in page_tables.told(df, "html", page_tables.links).collect()} == {1, 2, 3, 4, 5}


def test_parts_of_a_page_stay_as_they_are_written(spark):
    from postflow.functions.html import board_detail, main_block

    inside = '<p title="a &amp; b">R&amp;D &amp;lt;b> &amp</p>'
    df = spark.createDataFrame([(f"<body><nav>x</nav><article>{inside}</article></body>", f'<div data-test="qualifications-and-job-description">{inside}</div>')], "page string, detail string")
    got = df.select(main_block(F.col("page")).alias("main"), board_detail(F.col("detail"))["body"].alias("body"), text.html_to_text(main_block(F.col("page"))).alias("text")).first()
    assert got["main"] == got["body"] == inside
    assert got["text"] == "R&D &lt;b> &amp"


def test_shingles_of_a_long_text_find_its_words_once(spark):
    import time

    df = spark.range(4).select(F.repeat(F.lit("one two three four five "), 20_000).alias("text"))
    began = time.time()
    assert df.select(F.size(text.shingles(text.tokens(F.col("text")))).alias("n")).agg(F.sum("n")).first()[0] == 4 * 99_999
    assert time.time() - began < 60  # a search for the words in every run would take hours


def test_the_parts_of_a_place_are_found_once(spark):
    plan = spark.range(1).select(places.parse_location(F.col("id").cast("string")).alias("p")).select("p.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\bor\b") == 1


@pytest.mark.parametrize(("page", "want"), [("<p>One</p> <b>two</b>\t three \n</LI>", "One\n\ntwo three"), ("a <\n b", "a <\nb"), ("a\x0b \x85", "a\x85"), ("a<hr>b<Nav>c</nav>d", "a\n\nb d"), (" a  &gt;b ", "a >b"), (None, "")])
def test_text_of_pages_with_and_without_rare_markup(spark, page, want):
    assert one(spark, text.html_to_text, page) == want


def test_authorisation_is_looked_for_once(spark):
    """What a text says on authorisation is found once, however often the decision refers to it."""
    rule = rules.authorization(F.col("text"), F.col("lang"), rules.Rules(authorized=("DE",), needs_sponsorship=True))[0]
    df = spark.createDataFrame([("You must be authorized to work in Germany",)], "text string").withColumn("lang", F.lit("US")).select(rule.alias("r"), F.length("text").alias("n"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 6


def test_blocked_company_is_normalised_once(spark):
    rule = rules.company_blocked(F.col("x"), rules.Rules(blocked_companies=("Acme, Inc.",)))[0]
    plan = spark.createDataFrame([("acme",)], "x string").select(rule.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1


def test_text_of_pages_with_any_white_space(spark):
    """Passes that squeeze white space are left out where there is none to squeeze, which must change no text."""
    from postflow.functions.text import html_to_text

    pages = {"<p>a</p><p>b</p>": "a\n\nb", "a  b": "a b", "a\tb": "a b", "a\r\nb": "a\nb", "a\fb": "a b", "<p>a</p>\n\n\n<p>b</p>": "a\n\nb", "a<b></b>b": "a b", "a \n b": "a\nb", "": "", "one two": "one two"}
    df = spark.createDataFrame([(k,) for k in pages], "page string")
    assert {r["page"]: r["t"] for r in df.select("page", html_to_text(F.col("page")).alias("t")).collect()} == pages
