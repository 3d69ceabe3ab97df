"""Text functions over Columns: names, titles, hashes, HTML, money and keys."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to. Fixed values.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿğışœæ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyygisoa"
#: Legal forms that end a company's name. Fixed values.
LEGAL_SUFFIXES = ("inc", "llc", "ltd", "limited", "corp", "corporation", "gmbh", "bv", "nv", "ab", "as", "oy", "sa", "plc", "co", "company", "holding", "holdings", "anonim", "sirketi", "sti")
#: Hosts of hiring platforms and of feeds, which name no employer. Fixed values.
BOARD_HOSTS = ("greenhouse.io", "ashbyhq.com", "lever.co", "recruitee.com", "workable.com", "smartrecruiters.com", "personio.de", "personio.com", "teamtailor.com", "myworkdayjobs.com")
FEED_HOSTS = ("himalayas.app", "remoteok.com", "remotive.com", "jobicy.com", "arbeitnow.com", "weworkremotely.com", "linkedin.com")
#: Levels in titles, the first match counts. Fixed values.
SENIORITY = (
    ("intern", r"\b(intern|internship|stajyer|trainee|working student|werkstudent)\b"),
    ("founding", r"\bfounding\b"),
    ("principal", r"\b(principal|distinguished|fellow)\b"),
    ("staff", r"\bstaff\b"),
    ("senior", r"\b(senior|sr\.?|kıdemli|kidemli)\b"),
    ("lead", r"\b(lead|leader|head of|manager|müdür|yönetici)\b"),
    ("junior", r"\b(junior|jr\.?|entry[- ]level|graduate|new grad|associate)\b"),
    ("mid", r"\b(mid[- ]level|intermediate)\b"),
)
#: Families of roles, the first match counts. Fixed values.
ROLE_FAMILIES = (
    ("ai_ml", r"\b(machine learning|ml|ai|artificial intelligence|deep learning|nlp|llm|research scientist|applied scientist|computer vision|genai)\b"),
    ("data", r"\b(data engineer|data scientist|analytics engineer|data analyst|business intelligence|bi )\b"),
    ("devops", r"\b(devops|sre|site reliability|platform engineer|infrastructure engineer|cloud engineer)\b"),
    ("fullstack", r"\b(full[- ]?stack|fullstack)\b"),
    ("frontend", r"\b(front[- ]?end|frontend|ui engineer|react engineer)\b"),
    ("backend", r"\b(back[- ]?end|backend|server[- ]side|api engineer|software engineer|yazılım|yazilim)\b"),
    ("pm", r"\b(product manager|program manager|product owner|technical program)\b"),
)
#: What is cut from titles before they are compared: notes in brackets, a work mode at the end, levels. Fixed values.
TITLE_NOTE = r"\((remote|hybrid|on[- ]?site|onsite|contract|full[- ]?time|part[- ]?time|[a-z]{2,3}\s*/\s*[a-z]{2,3}|[a-z ]*(office|based)|m/f/d|w/m/d|h/f)\)"
TITLE_TAIL = r"\s*[-–|,]\s*(remote|hybrid|on[- ]?site|onsite)\b.*$"
TITLE_LEVEL = r"\b(senior|sr\.?|junior|jr\.?|staff|principal|lead|founding|distinguished|entry[- ]level|mid[- ]level|intermediate|associate|graduate|new grad|kıdemli|kidemli)\b"
#: Kinds of employment, the first match counts. Fixed values.
EMPLOYMENT = (
    ("internship", r"intern|stag|stajyer|trainee|apprentic|working.?student|werkstudent"),
    ("part_time", r"part.?time|parttime|yari.?zamanli|yarı.?zamanlı|teilzeit"),
    ("contract", r"contract|freelance|consultan|b2b|sozlesme|sözleşme|contractor"),
    ("temporary", r"tempor|seasonal|interim|fixed.?term|gecici|geçici"),
    ("full_time", r"full.?time|fulltime|permanent|vollzeit|tam.?zamanli|tam.?zamanlı|regular"),
)
#: Tags whose content is no text, and tags that end a paragraph. Fixed values.
DROPPED_TAGS = ("script", "style", "nav", "footer", "noscript")
BLOCK_TAGS = ("p", "div", "li", "ul", "ol", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "blockquote", "header", "main", "aside", "figure", "hr", "dl", "dt", "dd")
#: What a page must have for references, breaks, rules or dropped tags to matter, or for line ends beyond white space to end it.
RARE_SIGNS = ("&", "\x85", "\u2028", "\u2029")
RARE_TAGS = rf"<(?i:br|hr|{'|'.join(DROPPED_TAGS)})"
#: Phrases by which a page says that a posting is closed. Fixed values.
CLOSED = (
    "no longer accepting applications",
    "this job is no longer available",
    "this job is no longer open",
    "this position is no longer available",
    "this position has been filled",
    "this job has expired",
    "this job posting has expired",
    "this posting has closed",
    "the job you are looking for is no longer",
    "the position you are looking for is no longer",
)


def _plain_letters() -> tuple[str, str]:
    """Letters that are a compatibility form of one other character, and that character without its marks."""
    pairs = []
    for char in map(chr, range(0x80, 0x10000)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != char:
            pairs.append((char, plain))
    return "".join(c for c, _ in pairs), "".join(c for _, c in pairs)


MARKED, UNMARKED = _plain_letters()


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def unaccented(text: Column) -> Column:
    """Letters of any script without their accents: marked letters to plain ones, then marks that stand alone go."""
    return F.regexp_replace(F.translate(text, MARKED, UNMARKED), r"\p{M}", "")


def normalize_company_name(name: Column) -> Column:
    """Lower case, without accents, punctuation and legal forms at the end; a name of legal forms alone stays whole. Letters of all scripts count."""
    bare = squeezed(F.regexp_replace(F.lower(unaccented(F.coalesce(name, F.lit("")))), r"[^\p{L}\p{N}_\s]", " "))
    form = f"(?:{'|'.join(LEGAL_SUFFIXES)})"
    return F.regexp_replace(bare, rf"^({form}(?:\s{form})*)$|\s{form}(?:\s{form})*$", "$1")  # one pass, so that the name is made ready once


def domain_from_url(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.trim(url), r"(?i)^https?://([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    platform = reduce(lambda a, b: a | b, [(host == h) | host.endswith("." + h) for h in BOARD_HOSTS + FEED_HOSTS])
    return F.when((host != "") & ~platform, host)


def first_match(text: Column, table: tuple[tuple[str, str], ...], default: str | None = None) -> Column:
    """The label of the first pattern that is found."""
    found = F.coalesce(*[F.when(text.rlike(f"(?i){p}"), F.lit(label)) for label, p in table])
    return F.coalesce(found, F.lit(default)) if default is not None else found


def detect_seniority(title: Column, description: Column | None = None) -> Column:
    level = first_match(title, SENIORITY)
    if description is None:
        return level
    told = tuple(x for x in SENIORITY if x[0] in ("intern", "founding"))
    return F.coalesce(level, first_match(F.substring(description, 1, 2000), told))


def detect_role_family(title: Column) -> Column:
    return first_match(title, ROLE_FAMILIES, "other")


def unescape(text: Column) -> Column:
    """The five named entities and the non-breaking space; the ampersand last, so nothing is unescaped twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def normalize_title(title: Column) -> Column:
    text = unescape(F.coalesce(title, F.lit("")))
    text = F.regexp_replace(text, f"(?i){TITLE_NOTE}", " ")
    text = F.regexp_replace(text, f"(?i){TITLE_TAIL}", "")
    text = F.regexp_replace(text, f"(?i){TITLE_LEVEL}", " ")
    return squeezed(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9À-ɏ]+"), 0)


def shingles(words: Column, size: int = 2) -> Column:
    """Runs of `size` words joined by a space; fewer words make one shingle, none make none."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(n >= size, each).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words), runs)[0]  # bound once: inside the inner lambda the words would be found again for every run


def hamming(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def _votes(text: str | None, digest) -> bytes | None:
    """The 8 bytes of a 64-bit simhash over two-word shingles: a bit is set if more shingles set it than not. None without words."""
    w = re.findall("[a-z0-9À-ɏ]+", (text or "").lower())
    parts = [f"{a} {b}" for a, b in pairwise(w)] or w
    if not parts:
        return None
    raw = b"".join([digest(p.encode()) for p in parts])
    votes = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0)
    return np.packbits(votes * 2 > len(parts)).tobytes()


def _blake2b(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=8).digest()


def _md5(x: bytes) -> bytes:
    return hashlib.md5(x).digest()[:8]


def _simhash_blake2b(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        found = [_votes(t, _blake2b) for t in batch]
        yield pd.Series([v and v.hex() for v in found], dtype=object)


def _simhash_md5(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        found = [_votes(t, _md5) for t in batch]
        yield pd.Series([v and v.hex() for v in found], dtype=object)


def simhash_md5(text: Column) -> Column:
    """struct(hi, lo) over MD5 digests, null without words, in one pass over Arrow batches and without a shuffle."""
    return halves(F.pandas_udf(_simhash_md5, "string")(text))


def halves(digits: Column) -> Column:
    """16 hexadecimal digits as struct(hi, lo) of 32 bits each."""
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("bigint")
    return F.when(digits.isNotNull(), F.struct(half(1).alias("hi"), half(9).alias("lo")))


def content_hash(title: Column, location: Column, body: Column) -> Column:
    norm = lambda c: squeezed(F.lower(F.coalesce(c, F.lit(""))))
    return F.sha2(F.concat_ws("\0", norm(title), norm(location), norm(body)), 256)


def completeness(text: Column) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "none").when(F.length(text) >= 400, "full").otherwise("snippet")


def html_to_text(page: Column) -> Column:
    """Visible text: dropped tags gone, breaks to line ends, blocks to paragraphs, white space squeezed, one blank line at most."""
    text, blocks = F.coalesce(page, F.lit("")), rf"</(?i:{'|'.join(BLOCK_TAGS)})>"
    full = text
    for tag in DROPPED_TAGS:
        full = F.regexp_replace(full, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    full = F.regexp_replace(full, r"(?i)<br\s*/?>", "\n")
    full = F.regexp_replace(full, rf"{blocks}|<(?i:hr)\s*/?>", "\n\n")
    full = F.regexp_replace(_lines(unescape(F.regexp_replace(full, r"<[^>]*>", " "))), r"^[\s]+|[\s]+$", "")
    # most pages have nothing that needs half of these passes; one look at the page tells
    plain = F.trim(_lines(F.regexp_replace(F.regexp_replace(text, blocks, "\n\n"), r"<[^>]*>", " ")), F.lit(" \t\n\x0b\f\r"))
    rare = reduce(lambda a, b: a | b, [text.contains(c) for c in RARE_SIGNS]) | text.rlike(RARE_TAGS)
    return F.when(rare, full).otherwise(plain)


def _lines(text: Column) -> Column:
    """Runs of white space are one space, one line end or one blank line."""
    wide = ("  ", "\t", "\r", "\f")  # passes over the text are made only where there is something to squeeze; most texts have nothing
    squeeze = lambda x: F.regexp_replace(x, r"[\t\r\f][ \t\r\f]*| [ \t\r\f]+", " ")
    text = _bound(text, lambda x: F.when(reduce(lambda a, b: a | b, [x.contains(c) for c in wide]), squeeze(x)).otherwise(x))
    text = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return _bound(text, lambda x: F.when(x.contains("\n\n\n"), F.regexp_replace(x, r"\n{3,}", "\n\n")).otherwise(x))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is found once, however often f refers to it."""
    return F.transform(F.array(value), f)[0]


class _Markdown(HTMLParser):
    """Collects Markdown from a page: headings, bullets, links, emphasis and paragraphs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.muted = 0
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED_TAGS:
            self.muted += 1
        elif self.muted:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag in BLOCK_TAGS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in DROPPED_TAGS:
            self.muted = max(0, self.muted - 1)
        elif self.muted:
            return
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag in BLOCK_TAGS and tag != "li":
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.muted:
            self.out.append(re.sub(r"\s+", " ", data))


def _html_to_markdown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Markdown with ATX headings and dash bullets; at most one blank line; long dashes spelled as commas and hyphens."""

    def one(page: str | None) -> str:
        parser = _Markdown()
        parser.feed(page or "")
        text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parser.out))
        return re.sub(r"\n{3,}", "\n\n", text).replace("—", ", ").replace("–", "-").strip()

    for batch in batches:
        yield batch.map(one)


def unescape_if_escaped(value: Column) -> Column:
    text = F.coalesce(value, F.lit(""))
    return F.when(text.contains("&lt;") & ~F.substring(text, 1, 200).contains("<"), unescape(text)).otherwise(text)


def employment_type(*values: Column) -> Column:
    return first_match(F.concat_ws(" ", *values), EMPLOYMENT)


def turkish_fold(text: Column) -> Column:
    return F.lower(F.trim(F.translate(text, "ıİşŞğĞüÜöÖçÇ", "iIsSgGuUoOcC")))


def profile_url(url: Column) -> Column:
    """https, without query, fragment, www and closing slash; null if there is no host."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?i)^(https?:)?//(www\.)?", ""), r"[?#].*$", "")
    rest = F.regexp_replace(rest, r"/+$", "")
    return F.when(rest != "", F.concat(F.lit("https://"), F.lower(F.substring_index(rest, "/", 1)), F.regexp_extract(rest, "^[^/]*(.*)$", 1)))


def safe_key(text: Column) -> Column:
    """Usable as a file name: runs of other characters become a hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9._-]+", "-"), r"^-+|-+$", "")


def salary_range(text: Column) -> Column:
    """struct(low, high, currency) from text like "$120k - 150k"; figures under 1000 without a k do not count."""
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"(\d+(?:\.\d+)?)\s*([kK]?)"), 0)
    value = lambda x: F.regexp_extract(x, r"[\d.]+", 0).cast("double") * F.when(F.lower(x).endswith("k"), 1000).otherwise(1)
    figures = F.filter(F.transform(found, value), lambda x: x >= 1000)
    currency = F.when(text.contains("$"), "USD").when(text.contains("€"), "EUR").when(text.contains("£"), "GBP")
    return F.struct(F.array_min(figures).alias("low"), F.array_max(figures).alias("high"), F.when(F.size(figures) > 0, currency).alias("currency"))


def mapped(key: Column, table: dict[str, str]) -> Column:
    """The table's value for a folded key, null if it has none."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.regexp_replace(F.lower(key), "[^a-z]", ""))


def split_title(text: Column) -> Column:
    """struct(company, title) from "Company: Title"; without a colon the whole is the title."""
    at = F.instr(text, ":")
    return F.struct(F.when(at > 0, F.trim(F.substring(text, F.lit(1), at - 1))).alias("company"), F.trim(F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text)).alias("title"))


def parsed_number(text: Column) -> Column:
    """80,000 and 80k and $80k; null if there is no number."""
    bare = F.lower(F.regexp_replace(text, r"[,$€£\s]", ""))
    number = F.regexp_replace(bare, "k$", "").try_cast("double")
    return F.when(bare.endswith("k"), number * 1000).otherwise(number)


def says_closed(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(p) for p in CLOSED])


def lost_call_to_action(page: Column, text: Column, button: str, whole: str) -> Column:
    """A page without its way to apply is closed if it is whole (has `whole`) or its text says so; a page cut short says nothing."""
    return ~page.contains(button) & (page.contains(whole) | says_closed(text))


def candidate_place(text: Column, names: tuple[str, ...], longest: int = 60) -> Column:
    """The first line that names one of the places: whole if it has at most `longest` characters, else the name alone."""
    named = rf"(?<!\p{{L}})({'|'.join(names)})(?!\p{{L}})"
    line = F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike(named)), F.lit(1))
    return F.when(F.length(line) <= longest, line).otherwise(F.regexp_extract(F.lower(line), named, 1))


def left_posting(url: Column, posting_id: Column) -> Column:
    """A redirect that reports an error, or whose address has lost the posting's id."""
    return (F.regexp_extract(url, r"[?&]error=([^&#]*)", 1) == "true") | ~F.contains(url, posting_id)


def _latex_to_prose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Prose of a LaTeX source: comments, preamble and commands gone, their arguments kept, contact details cut."""

    def one(source: str | None) -> str:
        text = re.sub(r"(?<!\\)%.*", "", source or "")
        text = text.split(r"\begin{document}", 1)[-1].split(r"\end{document}", 1)[0]
        text = re.sub(r"\\(begin|end)\{[^}]*\}", " ", text)
        for _ in range(4):
            text = re.sub(r"\\[A-Za-z]+\*?(\[[^\]]*\])?\{([^{}]*)\}", r"\2", text)
        text = re.sub(r"\\[A-Za-z]+\*?|[{}$~]", " ", text).replace("\\", " ")
        text = re.sub(r"\S+@\S+|https?://\S+|\+?\d[\d ()-]{7,}\d", " ", text)
        return re.sub(r"\s+", " ", html.unescape(text)).strip()

    for batch in batches:
        yield batch.map(one)


def compare_words(text: Column) -> Column:
    """Words for bag comparison: LaTeX commands, figures and single letters out."""
    bare = F.regexp_replace(F.lower(text), r"\\[a-z]+", " ")
    return F.filter(F.regexp_extract_all(bare, F.lit("[a-zà-ɏ]+"), 0), lambda w: F.length(w) > 1)


def simhash_blake2b(text: Column) -> Column:
    """The 64-bit simhash over BLAKE2b digests of two-word shingles, as 16 hexadecimal digits."""
    return F.pandas_udf(_simhash_blake2b, "string")(text)


def html_to_markdown(page: Column) -> Column:
    """Markdown with ATX headings and dash bullets; at most one blank line; long dashes spelled as commas and hyphens."""
    return F.pandas_udf(_html_to_markdown, "string")(page)


def latex_to_prose(source: Column) -> Column:
    """Prose of a LaTeX source: comments, preamble and commands gone, their arguments kept, contact details cut."""
    return F.pandas_udf(_latex_to_prose, "string")(source)
