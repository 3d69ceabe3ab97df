"""Parts of HTML pages: cards of a result list, blocks of a detail page, structured data and main content, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html import escape, unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
HIDDEN = ("script", "style", "noscript", "template")
NESTED = ("@graph", "mainEntity", "itemListElement")
REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|\w+)(?:;|(?![\w=]))")  # in an attribute's value
ASIDE = ("nav", "footer", "header", "aside", "form")


class Node:
    """An element of a page: tag, attributes, children (nodes, and texts as they are written, character references included)."""

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def __iter__(self) -> Iterator[Node]:
        """All elements below, in page order."""
        open_ = [c for c in reversed(self.children) if isinstance(c, Node)]
        while open_:
            node = open_.pop()
            yield node
            open_ += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, tag: str = "", cls: str = "", **attrs: str) -> Iterator[Node]:
        for n in self:
            if (not tag or n.tag == tag) and (not cls or cls in n.attrs.get("class", "").split()) and all(n.attrs.get(k.replace("_", "-")) == v for k, v in attrs.items()):
                yield n

    def first(self, tag: str = "", cls: str = "", **attrs: str) -> Node | None:
        return next(self.all(tag, cls, **attrs), None)

    def text(self, skip: tuple[str, ...] = HIDDEN) -> str:
        parts, open_ = [], list(reversed(self.children))
        while open_:
            c = open_.pop()
            if isinstance(c, str):
                parts.append(unescape(c))
            elif c.tag not in skip:
                open_ += reversed(c.children)
        return re.sub(r"\s+", " ", " ".join(p for p in parts if p.strip())).strip()

    def raw(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def html(self, drop: Callable[[Node], bool] = lambda n: False) -> str:
        """What is inside the element, as HTML again, without the elements that `drop` picks."""
        out, open_ = [], list(reversed(self.children))
        while open_:
            c = open_.pop()
            if isinstance(c, str):
                out.append(c)
            elif not drop(c):
                attrs = "".join(f' {k}="{escape(v)}"' for k, v in c.attrs.items())
                out.append(f"<{c.tag}{attrs}>")
                if c.tag not in VOID:
                    open_.append(f"</{c.tag}>")
                open_ += reversed(c.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Node("", {})
        self.path = [self.top]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: REFERENCE.sub(lambda m: unescape(m[0]), v or "") for k, v in attrs})
        self.path[-1].children.append(node)
        if tag not in VOID:
            self.path.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i].tag == tag:
                del self.path[i:]
                break

    def handle_data(self, data):
        verbatim = self.cdata_elem and not getattr(self, "_escapable", False)  # no references are resolved there
        self.path[-1].children.append(data.replace("&amp;", "&") if verbatim else data)


def parsed(page: str | None) -> Node:
    builder = _Builder()
    builder.feed((page or "").replace("&", "&amp;"))  # so that texts stay as they are written
    builder.close()
    return builder.top


def mapped(f: Callable[[Node], object], returns: str) -> Callable[[Column], Column]:
    """A function of a page as a function of Columns; a page that fails gives null and costs no other page."""

    def one(page: str | None):
        try:
            return f(parsed(page)) if page else None
        except (ValueError, RecursionError, AssertionError):
            return None

    names = re.findall(r"(\w+) \w+", returns) if returns.startswith("struct") else None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([one(p) for p in batch], dtype=object)

    def run_struct(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(p) or {} for p in batch], columns=names, dtype=object)

    return lambda page: F.pandas_udf(run if names is None else run_struct, returns)(page)


def _text(node: Node | None) -> str:
    return node.text() if node else ""


def profile_card(card: Node) -> dict:
    """A card of a network's result list; one that lacks its parts is still a card, its fields empty."""
    link, when = card.first("a", "base-card__full-link"), card.first("time", "job-search-card__listdate")
    subtitle = card.first("h4", "base-search-card__subtitle")
    company = subtitle.first("a") if subtitle else None
    place = card.first("span", "job-search-card__location")
    return {
        "id": card.attrs.get("data-entity-urn", "").rsplit(":", 1)[-1],
        "title": _text(card.first("h3", "base-search-card__title")),
        "company": company.text() if company else None,
        "location": place.text() if place else None,
        "listed": when.attrs.get("datetime") if when else None,
        "href": link.attrs.get("href") if link else None,
    }


def _profile_cards(page: Node) -> list[dict]:
    return [profile_card(card) for card in page.all(cls="base-card")]


def _profile_detail(page: Node) -> dict:
    """The body of a posting without its buttons, and who posted it."""
    body = page.first("div", "description__text")
    poster = page.first("div", "message-the-recruiter") or page.first("div", "hirer-card__hirer-information")
    links = list(poster.all("a")) if poster else []
    link = next((a for a in links if "/in/" in a.attrs.get("href", "")), next((a for a in links if a.attrs.get("href")), None))
    name = (poster.first(cls="base-main-card__title") if poster else None) or link
    return {
        "body": body.html(lambda n: "show-more-less-html__button" in n.attrs.get("class", "").split()) if body else None,
        "poster": (_text(name) or None) if name else None,
        "profile": link.attrs.get("href") if link else None,
    }


def board_card(card: Node) -> dict | None:
    """A card of a job board's result list, if its link ends in the posting's number."""
    link = card.first("a", data_test="ad-card-item")
    path = link.attrs.get("href", "").split("?")[0] if link else ""
    number = re.search(r"-(\d+)$", path)
    part = lambda name: _text(card.first(data_test=name))
    return {"id": number[1], "path": path, "title": part("ad-card-title"), "company": part("subtitle"), "location": part("location"), "work_model": part("work-model"), "work_type": part("mapped-badges"), "age": part("ad-date")} if number else None


def _board_cards(page: Node) -> list[dict]:
    return [found for card in page.all(data_test="ad-card") if (found := board_card(card))]


def _board_detail(page: Node) -> dict:
    body = page.first(data_test="qualifications-and-job-description")
    return {"body": body.html() if body else None, "company": _text(page.first(data_test="company-name")) or None}


def _main_block(page: Node) -> str | None:
    """The inside of <article> or <main>; else of the element with most text in its own paragraphs, navigation aside."""
    for tag in ("article", "main"):
        node = page.first(tag)
        if node and node.text((*HIDDEN, *ASIDE)):
            return node.html(lambda n: n.tag in HIDDEN + ASIDE)
    outside = {id(x) for n in page if n.tag in HIDDEN + ASIDE for x in [n, *n]}
    best, most = None, 0
    for n in page:
        own = sum(len(c.text()) for c in n.children if isinstance(c, Node) and c.tag in ("p", "li", "ul", "ol", "h1", "h2", "h3")) if id(n) not in outside else 0
        if own > most:
            best, most = n, own
    return best.html(lambda n: n.tag in HIDDEN + ASIDE) if best else None


def _loaded(text: str) -> object:
    """JSON, or what one repair (line ends in strings, commas before a closing bracket) makes of it."""
    for attempt in (text, re.sub(r",\s*([}\]])", r"\1", text.replace("\n", " "))):
        try:
            return json.loads(attempt)
        except ValueError:
            continue
    return None


def _job_posting(page: Node, deepest: int = 5) -> str | None:
    """The first JobPosting among a page's structured data, as JSON: at the top, in a list, or nested below one of three keys."""
    for script in page.all("script", type="application/ld+json"):
        open_ = [(_loaded(script.raw()), 0)]
        while open_:
            node, depth = open_.pop()
            if isinstance(node, list):
                below = node
            elif isinstance(node, dict):
                kinds = node.get("@type")
                if "jobposting" in (str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])):
                    return json.dumps(node)
                below = [node.get(k) for k in NESTED]
            else:
                continue
            if depth < deepest:
                open_ += [(x, depth + 1) for x in reversed(below)]
    return None


profile_cards = mapped(_profile_cards, "array<struct<id string, title string, company string, location string, listed string, href string>>")
profile_detail = mapped(_profile_detail, "struct<body string, poster string, profile string>")
board_cards = mapped(_board_cards, "array<struct<id string, path string, title string, company string, location string, work_model string, work_type string, age string>>")
board_detail = mapped(_board_detail, "struct<body string, company string>")
job_posting = mapped(_job_posting, "string")
main_block = mapped(_main_block, "string")
