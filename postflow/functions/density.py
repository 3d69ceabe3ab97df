"""The main content of a page by density: the run of segments with most text and least links.

A page is cut before every block tag. A segment scores the characters of its text, less LINK times those inside links, less COST, which
every segment pays; so long paragraphs score high, menus and footers below zero. The main content is the stretch of consecutive segments
with the greatest sum (of several the first, at its longest): short segments between paragraphs come along, what lies around does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that begin a segment. Fixed values.
BLOCKS = ("address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul")
LINK, COST = 4, 25
MARK = "\x01"
HIDDEN = r"(?is)<!--.*?-->|<(script|style|noscript|template|head)\b.*?</(script|style|noscript|template|head)>"


def plain(part: Column) -> Column:
    """The text of a piece of a page, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(part, "<[^>]*>", " "), r"\s+", " "))


def segments(page: Column) -> Column:
    """array<struct<text, score>> of a page; null and empty pages have none."""
    shown = F.regexp_replace(F.coalesce(page, F.lit("")), HIDDEN, " ")
    cut = F.split(F.regexp_replace(shown, rf"(?i)(</?({'|'.join(BLOCKS)})[\s/>])", MARK + "$1"), MARK)
    links = lambda x: F.array_join(F.regexp_extract_all(x, F.lit(r"(?is)<a\s[^>]*>(.*?)</a>"), 1), " ")
    scored = F.transform(cut, lambda x: F.struct(plain(x).alias("text"), (F.length(plain(x)) - LINK * F.length(plain(links(x))) - COST).alias("score")))
    return F.filter(scored, lambda x: x["text"] != "")


def best_run(found: Column) -> Column:
    """struct(score, first, last) of the best stretch of segments, numbered from 1; null if no segment is worth its cost."""
    start = F.struct(*[F.lit(v).cast("int").alias(k) for k, v in (("sum", 0), ("low", 0), ("low_at", 0), ("place", 0), ("score", 0), ("first", 0), ("last", 0))])

    def step(acc: Column, x: Column) -> Column:
        total, place = acc["sum"] + x["score"], acc["place"] + 1
        better = total - acc["low"] > acc["score"]
        lower = total < acc["low"]
        pick = lambda when, new, old: F.when(when, new).otherwise(acc[old]).cast("int").alias(old)
        return F.struct(total.cast("int").alias("sum"), pick(lower, total, "low"), pick(lower, place, "low_at"), place.cast("int").alias("place"), pick(better, total - acc["low"], "score"), pick(better, acc["low_at"] + 1, "first"), pick(better, place, "last"))

    best = F.aggregate(found, start, step)
    return F.when(best["score"] > 0, F.struct(best["score"].alias("score"), best["first"].alias("first"), best["last"].alias("last")))


def content(found: Column, run: Column) -> Column:
    """The text of a stretch of segments, a line each."""
    return F.array_join(F.transform(F.slice(found, run["first"], run["last"] - run["first"] + 1), lambda x: x["text"]), "\n")
