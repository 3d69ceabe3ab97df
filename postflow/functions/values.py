"""Times, money and small scalar functions over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of relative ages and their seconds; years' worth of periods. Fixed values.
AGE_UNITS = {"dakika": 60, "saat": 3600, "gün": 86400, "hafta": 604800, "ay": 2592000, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000}
PERIODS = {"annual": 1.0, "monthly": 12.0, "weekly": 52.0, "daily": 260.0, "hourly": 2080.0}

#: Forms of moments, and what a text of that form must have: a form that fails costs an exception, so only those that may fit are tried.
DATE_FORMS = (
    ("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", r"(?i)-\d\dT.*(Z|[+-]\d\d:\d\d)$"),
    ("yyyy-MM-dd'T'HH:mm:ss[.SSS]", r"(?i)-\d\dT.*[:.]\d+$"),
    ("yyyy-MM-dd HH:mm:ss", r"-\d\d .*:\d\d$"),
    ("yyyy-MM-dd", r"-\d\d-\d\d$"),
    ("dd MMM yyyy HH:mm:ss Z", r"^\d\d .* .*:\d\d [+-]\d{4}$"),
    ("dd MMM yyyy", r"^\d\d [^ ]+ [+-]?\d+$"),
)


def parse_datetime(value: Column) -> Column:
    """Text to a timestamp in UTC without zone: epochs in seconds or (above 1e11) milliseconds, ISO forms, RFC dates; else null."""
    number = F.when(~value.rlike(r"[:,]|\d-\d"), value.try_cast("double"))  # no number has these, and a cast that fails costs an exception
    epoch = F.timestamp_millis((F.when(F.abs(number) > 1e11, number).otherwise(number * 1000)).cast("bigint"))
    plain = F.regexp_replace(value, "^[A-Z][a-z]{2}, ", "")
    parsed = F.coalesce(*[F.when(plain.rlike(sign), F.try_to_timestamp(plain, F.lit(form))) for form, sign in DATE_FORMS])
    return F.when(number.isNotNull(), epoch).otherwise(parsed).cast("timestamp_ntz")


def relative_age(text: Column, at: Column) -> Column:
    """The moment that a text such as "3 gün önce" or "2 weeks ago" means, seen from `at`."""
    n = F.regexp_extract(text, r"(\d+)", 1).try_cast("int")
    unit = F.regexp_extract(F.lower(text), f"({'|'.join(AGE_UNITS)})", 1)
    seconds = F.try_element_at(F.create_map(*[F.lit(x) for kv in AGE_UNITS.items() for x in kv]), unit)
    return at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n * seconds).cast("decimal(18,6)"))


def is_recent_batch(batch: Column, year: int, years: int = 2) -> Column:
    """A code such as W21, no more than `years` before `year`."""
    number = F.regexp_extract(F.trim(batch), r"(?i)^[WSFX](\d{2})$", 1).try_cast("int")
    return F.coalesce(year - (number + 2000) <= years, F.lit(False))


def convert(amount: Column, source: Column, target: Column, rates: dict[str, float]) -> Column:
    """The amount in another currency; null where a rate is missing or not above 0."""
    table = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])
    rate = F.try_element_at(table, source)
    return F.when(rate > 0, amount / rate * F.try_element_at(table, target))


def annual(amount: Column, period: Column) -> Column:
    """The amount a year; an unstated period is a year, an unknown one gives null."""
    return amount * F.try_element_at(F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv]), F.lower(F.coalesce(period, F.lit("annual"))))


def guess_token(domain: Column) -> Column:
    """The label before the suffix; one further left where a short second-level suffix stands there."""
    labels = F.filter(F.split(F.lower(domain), r"\."), lambda x: x != "")
    core, second = F.try_element_at(labels, F.lit(-2)), F.try_element_at(labels, F.lit(-3))
    return F.when(F.size(labels) >= 2, F.when(core.isin("co", "com", "net", "org", "gov", "ac") & second.isNotNull(), second).otherwise(core))


def days_from(value: Column, unit: Column) -> Column:
    """An age limit in whole days, rounded up."""
    per = F.try_element_at(F.create_map(F.lit("hours"), F.lit(1 / 24), F.lit("days"), F.lit(1.0), F.lit("weeks"), F.lit(7.0), F.lit("months"), F.lit(30.0)), unit)
    return F.ceil(value * per)
