"""Table functions over pages: one page to a row for each of its parts, and a row with an error for what could not be read.

They are joined laterally: `pages.lateralJoin(links(F.col("html").outer()))`. Nothing vanishes: a page that is missing or fails as a
whole gives one row with its error and no number, a page without parts one with neither, and a part that fails one with both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.functions.html import Node, board_card, parsed, profile_card

PLACES = ("nav", "article", "footer")


def rows_of(page: str | None, parts: Callable[[Node], Iterator[Node]], read: Callable[[Node], tuple], width: int) -> Iterator[tuple]:
    """(n, fields..., error) for each part of a page."""
    none = (None,) * width
    if page is None:
        yield (None, *none, "no page")
        return
    try:
        found = list(parts(parsed(page)))
    except (ValueError, AssertionError, RecursionError) as e:
        yield (None, *none, f"page: {type(e).__name__}")
        return
    if not found:
        yield (None, *none, None)
    for n, part in enumerate(found, 1):
        try:
            yield (n, *read(part), None)
        except (ValueError, AttributeError, KeyError) as e:
            yield (n, *none, str(e) or type(e).__name__)


def needed(value: str | None, name: str) -> str:
    if not value:
        raise ValueError(f"no {name}")
    return value


def _link(link: tuple[Node, str]) -> tuple:
    node, place = link
    return needed(node.attrs.get("href"), "href"), node.text(), place


def _links(page: Node) -> Iterator[tuple[Node, str]]:
    """The links of a page in order, each with the part of the page it lies in."""
    places = {id(n): tag for tag in PLACES for part in page.all(tag) for n in part.all("a")}
    return ((n, places.get(id(n), "other")) for n in page.all("a"))


@F.udtf(returnType="n int, href string, text string, place string, error string", useArrow=True)
class links:
    """The links of a page: where they lead, their text, and whether they lie in its navigation, article or footer."""

    def eval(self, page: str):
        yield from rows_of(page, _links, _link, 3)


def _profile(card: Node) -> tuple:
    x = profile_card(card)
    return needed(x["id"], "id"), needed(x["title"], "title"), x["company"], x["location"], x["listed"], x["href"]


@F.udtf(returnType="n int, id string, title string, company string, location string, listed string, href string, error string", useArrow=True)
class profile_rows:
    """The cards of a network's result list."""

    def eval(self, page: str):
        yield from rows_of(page, lambda p: p.all(cls="base-card"), _profile, 6)


def _board(card: Node) -> tuple:
    x = board_card(card)
    if x is None:
        raise ValueError("no number in its link")
    return x["id"], x["path"], needed(x["title"], "title"), x["company"], x["location"], x["work_model"], x["work_type"], x["age"]


@F.udtf(returnType="n int, id string, path string, title string, company string, location string, work_model string, work_type string, age string, error string", useArrow=True)
class board_rows:
    """The cards of a job board's result list."""

    def eval(self, page: str):
        yield from rows_of(page, lambda p: p.all(data_test="ad-card"), _board, 8)


def told(pages: DataFrame, page: str, table) -> DataFrame:
    """Every page with the rows of a table function."""
    return pages.lateralJoin(table(F.col(page).outer()))
