"""Ways to write to a contact, and first messages for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Routes, and how many characters each takes. Fixed values.
DM, FREE_INMAIL, INVITE_NOTE, INVITE_THEN_DM, PAID_INMAIL = "dm", "free_inmail", "invite_note", "invite_then_dm", "paid_inmail"
FALLBACK = (INVITE_NOTE, INVITE_THEN_DM, PAID_INMAIL)
NOTE_LIMIT, LONG_LIMIT = 300, 1900


def route(is_connection: Column, can_send_inmail: Column) -> Column:
    """The one free way to a contact; null where the reader must choose."""
    return F.when(is_connection, DM).when(can_send_inmail, FREE_INMAIL)


def allowed(is_connection: Column, can_send_inmail: Column, credits: Column) -> Column:
    """All ways that are open now, in the order to show them; what costs a credit only if there is one."""
    single = route(is_connection, can_send_inmail)
    paid = F.array(*map(F.lit, FALLBACK))
    return F.when(single.isNotNull(), F.array(single)).when(credits > 0, paid).otherwise(F.slice(paid, 1, 2))


def limit(way: Column) -> Column:
    return F.when(way == INVITE_NOTE, NOTE_LIMIT).otherwise(LONG_LIMIT)


def message(way: Column, name: Column, title: Column, company: Column) -> Column:
    """A first message for a route: a short note with an invitation, a longer text otherwise. A missing name or company is spoken around."""
    who = F.coalesce(F.nullif(F.substring_index(F.coalesce(name, F.lit("")), " ", 1), F.lit("")), F.lit("there"))
    where = F.coalesce(F.nullif(company, F.lit("")), F.lit("your team"))
    note = F.concat(F.lit("Hello "), who, F.lit(", your opening for "), title, F.lit(" at "), where, F.lit(" is close to what I do. May I connect?"))
    long = F.concat(F.lit("Hello "), who, F.lit(",\n\nI read about the "), title, F.lit(" position at "), where, F.lit(" and have applied for it. I would be glad to tell you more about my work.\n\nKind regards"))
    return F.when(way == INVITE_NOTE, note).otherwise(long)


def over_limit(text: Column, way: Column) -> Column:
    return F.length(text) > limit(way)
