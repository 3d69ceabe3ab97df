"""The quality gate of extracted prose, as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that head a posting's sections, endings of cut texts, and boilerplate. Fixed values.
SECTIONS = ("requirement", "responsibilit", "qualification", "what you", "about the role", "you will", "we are looking", "must have", "nice to have", "your profile", "gereksinim", "aranan nitelik", "sorumluluk", "iş tanımı", "is tanimi", "nitelikler", "genel nitelikler", "beklenen", "aday", "görev")
CUT_SHORT = ("read more", "show more", "see more", "devamını oku", "devamini oku", "daha fazla", "continue reading", "view full")
BOILERPLATE = "equal opportunity employer|we are an equal|cookie|privacy policy|all qualified applicants will receive consideration|without regard to race|e-?verify|kişisel verilerin korunması|kvkk|çerez"


def assess(text: Column, sections: tuple[str, ...] = SECTIONS, boilerplate: str = BOILERPLATE, paragraph: str = r"\n\s*\n", least: int = 400) -> Column:
    """struct(score, passed, chars): 1 is clean and whole, 0 unusable.

    The body and its parts are bound once (as the only elements of arrays that are transformed), so no branch computes them again.
    """
    stripped = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")

    def parts(body: Column) -> Column:
        n, low = F.length(body), F.lower(body)
        sentences = F.size(F.filter(F.split(body, r"[.!?\n]+"), lambda s: F.length(stripped(s)) > 20))
        headed = low.rlike("|".join(sections))
        spent = F.aggregate(F.filter(F.split(body, paragraph), lambda p: p.rlike(f"(?i){boilerplate}")), F.lit(0), lambda acc, p: acc + F.length(p))
        tail = stripped(F.substring(low, F.greatest(n - 59, F.lit(1)), F.lit(60)))
        cut = tail.rlike(r"(\.\.\.|…)$") | tail.rlike("|".join(CUT_SHORT))
        return F.struct(n.alias("n"), (n < least).alias("short"), (~headed & (sentences < 5)).alias("bare"), (spent / F.greatest(n, F.lit(1)) > 0.6).alias("spent"), cut.alias("cut"))

    def judged(x: Column) -> Column:
        lost = F.when(x["short"], 0.45).otherwise(0.0) + F.when(x["bare"], 0.3).otherwise(0.0) + F.when(x["spent"], 0.4).otherwise(0.0) + F.when(x["cut"], 0.25).otherwise(0.0)
        score = F.when(x["n"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - lost))
        return F.struct(F.round(score, 3).alias("score"), ((score >= 0.5) & (x["n"] > 0) & ~x["short"] & ~x["spent"]).alias("passed"), x["n"].alias("chars"))

    body = F.array(stripped(F.coalesce(text, F.lit(""))))
    return F.element_at(F.transform(F.transform(body, parts), judged), 1)
