"""The stage-one rules: every rule is judged for every posting, all reasons are kept, and an unknown value is never a reason.

A rule is a Column that holds the code of its reason where the posting is known to violate it, else null.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.functions.authorization import decision, merged, stated
from postflow.functions.places import bound, is_worldwide, offset_of, overlap_hours
from postflow.functions.text import detect_role_family, normalize_company_name
from postflow.functions.values import annual, convert, is_recent_batch

#: Levels from lowest to highest. Fixed values.
LEVELS = ("intern", "junior", "mid", "senior", "staff", "lead", "principal")
VERSION = 1


@dataclass(frozen=True)
class Rules:
    """What a reader wants. A field left as None or empty rules nothing out."""

    retired_sources: tuple[str, ...] = ()
    max_age_days: int | None = None
    blocked_companies: tuple[str, ...] = ()
    excluded_titles: tuple[str, ...] = ()
    required_titles: tuple[str, ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    excluded_phrases: tuple[str, ...] = ()
    min_level: str | None = None
    max_level: str | None = None
    min_annual: float | None = None
    currency: str | None = None
    include_unstated: bool = True
    rates: dict[str, float] = field(default_factory=dict)
    min_overlap: float | None = None
    base_offset: float = 3.0
    boosts: dict[str, float] = field(default_factory=dict)
    authorized: tuple[str, ...] = ()
    needs_sponsorship: bool = False
    anywhere: bool = True
    profile_titles: dict[str, tuple[str, ...]] = field(default_factory=dict)


def fingerprint(rules: Rules) -> str:
    """Changes when a rule does; exchange rates are left out."""
    told = {k: v for k, v in asdict(rules).items() if k != "rates"} | {"version": VERSION}
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


def known(c: Column) -> Column:
    return c.isNotNull() & (c != "") & (F.lower(c) != "unknown")


def violated(code: str, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(code))


def source_excluded(source: Column, rules: Rules) -> list[Column]:
    return [violated("source_excluded", source.isin(*rules.retired_sources))] if rules.retired_sources else []


def age(days: Column, rules: Rules) -> list[Column]:
    return [violated("age", days > rules.max_age_days)] if rules.max_age_days is not None else []


def company_blocked(name: Column, rules: Rules) -> list[Column]:
    """A company is blocked by its name as written or by its normalised name ("Acme, Inc." is "acme")."""
    if not rules.blocked_companies:
        return []
    blocked = [F.lit(c) for c in rules.blocked_companies]
    same = F.lower(name).isin(*(c.lower() for c in rules.blocked_companies)) | bound(normalize_company_name(name), lambda n: (n != "") & n.isin(*map(normalize_company_name, blocked)))
    return [violated("company_blocked", same)]


def title_excluded(title: Column, rules: Rules) -> list[Column]:
    """One reason for each pattern that matches."""
    return [violated("title_excluded", title.rlike(f"(?i){p}")) for p in rules.excluded_titles]


def title_unmatched(title: Column, rules: Rules, profile: Column | None = None) -> list[Column]:
    """No required pattern matches. A profile with patterns of its own is held to those instead."""
    any_of = lambda ps: reduce(lambda a, b: a | b, [F.coalesce(title, F.lit("")).rlike(f"(?i){p}") for p in ps])
    hit = any_of(rules.required_titles) if rules.required_titles else F.lit(True)
    if profile is not None:
        for name, patterns in rules.profile_titles.items():
            hit = F.when(profile == name, any_of(patterns) if patterns else F.lit(True)).otherwise(hit)
    return [violated("title_unmatched", ~hit)] if rules.required_titles or rules.profile_titles else []


def field_mismatch(columns: dict[str, Column], rules: Rules, location: Column | None = None) -> list[Column]:
    """A known value that is not allowed; a posting open to the world is exempt from the country rule."""
    out = []
    for name, values in rules.allowed.items():
        bad = known(columns[name]) & ~columns[name].isin(*values)
        if name == "country" and location is not None:
            bad = bad & ~is_worldwide(location)
        out.append(violated("field_mismatch", bad))
    return out


def haystack(title: Column, location: Column, body: Column, read: int = 4000) -> Column:
    """Where phrases are looked for: title, location and the opening of the body, as footers speak of other things."""
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(location, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, read))


def phrase_excluded(text: Column, rules: Rules) -> list[Column]:
    """A whole phrase in the haystack, letters and digits not touching it."""
    return [violated("phrase_excluded", F.lower(text).rlike(rf"(?U)(?<!\w)\Q{p.lower()}\E(?!\w)")) for p in rules.excluded_phrases]


def seniority(level: Column, rules: Rules) -> list[Column]:
    """Below the floor or above the ceiling; an unknown level only counts if the band is a single level."""
    at = F.array_position(F.array(*map(F.lit, LEVELS)), level)
    rank, out = F.when(at > 0, at), []
    low = LEVELS.index(rules.min_level) + 1 if rules.min_level else None
    high = LEVELS.index(rules.max_level) + 1 if rules.max_level else None
    if low is not None and low == high:
        out.append(violated("seniority_unstated", rank.isNull()))
    if low is not None:
        out.append(violated("seniority_low", rank < low))
    if high is not None:
        out.append(violated("seniority_high", rank > high))
    return out


def salary(amount: Column, period: Column, currency: Column, rules: Rules) -> list[Column]:
    """The top of the band a year against the floor, in the floor's currency where a rate is known."""
    if rules.min_annual is None:
        return []
    top = annual(F.nullif(amount, F.lit(0.0)), period)
    if rules.currency and rules.rates:
        same = currency.isNull() | (currency == rules.currency)
        top = F.when(same, top).otherwise(convert(top, currency, F.lit(rules.currency), rules.rates))
    unstated = [] if rules.include_unstated else [violated("salary_unstated", amount.isNull())]
    return [*unstated, violated("salary_below", top < rules.min_annual)]


def time_zone(country: Column, location: Column, rules: Rules) -> list[Column]:
    if rules.min_overlap is None:
        return []
    hours = F.when(is_worldwide(location), F.lit(9.0)).otherwise(overlap_hours(offset_of(country), F.lit(rules.base_offset)))
    return [violated("tz_overlap", hours < rules.min_overlap)]


def authorization(text: Column, country: Column, rules: Rules, stored: Column | None = None) -> list[Column]:
    """What a reader stored (struct of required and sponsorship, null if none has) and what the text says, merged, then decided."""
    if rules.anywhere and not rules.authorized and not rules.needs_sponsorship:
        return []
    empty = F.array().cast("array<string>")
    had = [] if stored is None else [F.coalesce(stored["required"], empty)]
    facts = bound(stated(text), lambda said: merged([*had, said["required"]], [*([] if stored is None else [stored["sponsorship"]]), said["sponsorship"]]))
    return [bound(facts, lambda f: decision(f["required"], f["sponsorship"], country, rules.authorized, rules.needs_sponsorship))]


def boost(rules: Rules, signs: dict[str, Column]) -> Column:
    """The product of the boosts whose sign is known to hold."""
    out = F.lit(1.0)
    for name, factor in rules.boosts.items():
        out = out * F.when(F.coalesce(signs[name], F.lit(False)), F.lit(float(factor))).otherwise(F.lit(1.0))
    return out


def signs(title: Column, batch: Column, year: int) -> dict[str, Column]:
    """What boosts may look for: a founding role, work on AI, a company of a recent batch."""
    return {"founding_engineer": F.lower(title).contains("founding"), "tag_ai": detect_role_family(title) == "ai_ml", "recent_batch": is_recent_batch(batch, year)}


def judged(df: DataFrame, reasons: list[Column], boosted: Column | None = None) -> DataFrame:
    """Adds verdict: struct(passed, codes, boost)."""
    codes = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    return df.withColumn("codes", codes).withColumn("verdict", F.struct((F.size("codes") == 0).alias("passed"), F.col("codes"), F.round(boosted if boosted is not None else F.lit(1.0), 3).alias("boost"))).drop("codes")
