"""Normalising codes, text, numbers, dates and categories, as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import cache, reduce

from pyspark.sql import Column, functions as F

#: Spellings of a missing value.
MISSING = ("", "nan", "none", "<na>")


@cache
def accents() -> tuple[str, str]:
    """Letters below U+0250 whose compatibility form is one ASCII character, and that character."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if ord(x) < 128)) for c in range(0xA1, 0x250)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def to_ascii(c: Column) -> Column:
    """Letters without accents; what has no ASCII form is dropped."""
    plain = F.translate(F.regexp_replace(F.regexp_replace(c, "ß", "SS"), "[æÆ]", ""), *accents())
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(plain, "[^\\x00-\\x7F]", ""))  # as many bytes as characters: ASCII


def normalize_text(c: Column) -> Column:
    """Upper case, ASCII, single spaces, no outer spaces; null stays null."""
    return F.trim(F.regexp_replace(to_ascii(F.upper(F.trim(c.cast("string")))), "\\s+", " "))


def normalize_code(c: Column) -> Column:
    """As text, without a trailing .0 and, for codes of digits, without leading zeros; empty is null."""
    text = F.regexp_replace(normalize_text(c), "\\.0$", "")
    bare = F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", "")).otherwise(text)
    return F.nullif(bare, F.lit(""))


def clean_string(c: Column) -> Column:
    """Trimmed, single spaces; spellings of missing are null."""
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin(*MISSING), F.regexp_replace(text, "\\s+", " "))


def canonical_identifier(c: Column) -> Column:
    """Trimmed; spellings of missing are null; whole numbers lose their decimals."""
    text = F.trim(c.cast("string"))
    whole = F.when(text.rlike("^-?[0-9]+\\.0+$"), F.substring_index(text, ".", 1)).otherwise(text)
    return F.when(~F.lower(text).isin(*MISSING), whole)


def number(c: Column) -> Column:
    """A double, or null where the value is none."""
    return F.trim(c.cast("string")).try_cast("double")


#: Day-first formats, tried in order, then year-first ones.
FORMATS = ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy", "d-M-yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def day_first(c: Column) -> Column:
    """A timestamp from day-first text, or null.

    A format is only tried on text of its shape, numbers between its separators, as each failure raises an exception.
    """
    text = F.trim(c)
    shaped = lambda f: text.rlike(f"^{re.sub('[a-zA-Z]+', '[+-]?[0-9]+', f)}$")
    return F.coalesce(*[F.when(shaped(f), F.try_to_timestamp(text, F.lit(f))) for f in FORMATS])


def flow_of(action: Column) -> Column:
    """Flow of goods that a normalised action stands for."""
    return F.when(action.isin("ENVIO", "ENTREGA"), "delivery").when(action == "RECOGIDA", "pickup")


def flow(action: Column) -> Column:
    """Flow of goods that an action stands for."""
    return flow_of(normalize_text(action))


#: Words of a concept that tell its class, and prefixes of codes that tell their type.
PICKUP_WORDS = ("PORTE RECOGIDA", "RECOGIDA", "DEVOLUCION", "RECEPCION", "RETORNO")
DELIVERY_WORDS = ("PORTE ENTREGA", "PORTE ENVIO", "EXPEDICION", "ENTREGA")
PREFIXES = (("SGP", "SGP"), ("SGE", "SGE"), ("SG", "SGE"), ("EGE", "EGE"), ("EG", "EGE"), ("DEGE", "EGE"))


def code_type(code: Column) -> Column:
    """Service type of a code's prefix, or null."""
    prefixes = F.create_map(*[F.lit(x) for pair in PREFIXES for x in pair])
    return F.try_element_at(prefixes, F.regexp_extract(F.upper(F.trim(code)), f"^({'|'.join(p for p, _ in PREFIXES)})", 1))


def concept_class(concept: Column) -> Column:
    """Class that the words of a normalised concept tell, or null."""
    return F.when(concept.rlike("|".join(PICKUP_WORDS)), "pickup").when(concept.rlike("|".join(DELIVERY_WORDS)), "delivery")


def decide(kind: Column, by_action: Column, by_words: Column) -> Column:
    """Struct (service_type, service_class, reason) from what prefix, action and concept tell."""
    usual = F.when(kind == "EGE", "pickup").when(kind.isNotNull(), "delivery")
    reason = (
        F.when(kind.isNotNull() & (by_action == usual), "prefix and action").when(by_action.isNotNull(), "action").when(kind.isNotNull(), "prefix").when(by_words.isNotNull(), "concept").otherwise("unknown")
    )
    return F.struct(F.coalesce(kind, F.lit("UNK")).alias("service_type"), F.coalesce(by_action, usual, by_words, F.lit("UNK")).alias("service_class"), reason.alias("reason"))


def service_class(code: Column, action: Column, concept: Column) -> Column:
    """Struct (service_type, service_class, reason): type by code prefix, class by action, type or concept."""
    return decide(code_type(code), flow(action), concept_class(normalize_text(concept)))


def operational(started: str, completed: str) -> Column:
    """Struct (operational_date, date_fallback, duration_seconds): the day of the end, else of the start (flag 1)."""
    a, b = F.col(started).cast("timestamp"), F.col(completed).cast("timestamp")
    return F.struct(
        F.to_date(F.coalesce(b, a)).alias("operational_date"), (b.isNull() & a.isNotNull()).cast("int").alias("date_fallback"), (F.unix_timestamp(b) - F.unix_timestamp(a)).alias("duration_seconds")
    )


#: Spellings of urgency.
URGENCY = {"NO": "NO", "N": "NO", "NORMAL": "NO", "SI": "SI", "S": "SI", "MUY URGENTE": "MUY_URGENTE", "MUY_URGENTE": "MUY_URGENTE", "MUYURGENTE": "MUY_URGENTE"}


def mapped(c: Column, mapping: Mapping[str, str] = URGENCY, unknown: str = "UNKNOWN") -> Column:
    """Struct (value, missing, inconsistent): the mapped value of normalised text, or unknown."""
    text = F.nullif(normalize_text(c), F.lit(""))
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    value = F.try_element_at(pairs, text)
    return F.struct(F.coalesce(value, F.lit(unknown)).alias("value"), text.isNull().alias("missing"), (text.isNotNull() & value.isNull()).alias("inconsistent"))


def first_date(preferred: Mapping[str, Sequence[str]], fallback: Mapping[str, Sequence[str]], bucket: Column) -> Column:
    """Struct (date, field, rank, fallback, missing): the first non-null field of the row's bucket, preferred ones first."""
    names = list(preferred)
    fields = {name: [*preferred[name], *fallback.get(name, ())] for name in names}
    by_bucket = lambda value: reduce(lambda rest, name: F.when(bucket == name, value(name)).otherwise(rest), reversed(names), F.lit(None))
    rank = by_bucket(lambda name: F.coalesce(*[F.when(F.col(f).isNotNull(), k) for k, f in enumerate(fields[name], 1)]))
    # the rank is worked out once, in a lambda's variable; all else follows from it
    return F.element_at(F.transform(F.array(F.coalesce(rank, F.lit(999))), lambda k: F.struct(
        F.when(k < 999, by_bucket(lambda name: F.coalesce(*[F.to_date(f) for f in fields[name]]))).alias("date"),
        F.when(k < 999, by_bucket(lambda name: F.get(F.array(*map(F.lit, fields[name])), k - 1))).otherwise("<MISSING>").alias("field"), k.alias("rank"),
        F.when(k < 999, by_bucket(lambda name: k > len(preferred[name]))).otherwise(False).alias("fallback"), (k == 999).alias("missing"),
    )), 1)


def billable_weight(kg: Column, m3: Column, density: int = 270) -> Column:
    """The larger of weight and volumetric weight, rounded up; null counts as 0."""
    return F.ceil(F.greatest(F.coalesce(kg, F.lit(0.0)), F.coalesce(m3, F.lit(0.0)) * density))


def regime(date: Column, off: int = 2025, restart: int = 2026) -> Column:
    """Regime of a date's year."""
    return F.when(F.year(date) == off, "off").when(F.year(date) == restart, "restart").otherwise("normal")


def ramp_up(date: Column, start: str) -> Column:
    """Days since a restart, 0 before it."""
    return F.greatest(F.datediff(date, F.lit(start).cast("date")), F.lit(0))


def daily_bucket(days: Column) -> Column:
    """Horizon bucket of a number of days ahead."""
    return F.when(days == 1, "D+1").when(days.between(2, 3), "D+2_D+3").when(days.between(4, 7), "D+4_D+7").when(days.between(8, 14), "D+8_D+14").when(days.between(15, 28), "D+15_D+28")


def weekly_bucket(weeks: Column) -> Column:
    """Horizon bucket of a number of weeks ahead."""
    return F.when(weeks == 1, "W+1").when(weeks == 2, "W+2").when(weeks.between(3, 4), "W+3_W+4").when(weeks >= 5, "W+5")


def monday(date: Column) -> Column:
    """The Monday on or before a date."""
    return F.to_date(F.date_trunc("week", date))


def same_day_in(date: Column, year: int) -> Column:
    """The same calendar day of another year, 29 February falling on the month's last day."""
    last = F.day(F.last_day(F.make_date(F.lit(year), F.month(date), F.lit(1))))
    return F.make_date(F.lit(year), F.month(date), F.least(F.day(date), last))


def monday_of_iso(year: Column, week: Column) -> Column:
    """Monday of an ISO week, null where the year has no such week."""
    first = monday(F.make_date(year, F.lit(1), F.lit(4)))
    day = F.date_add(first, (week - 1) * 7)
    return F.when((week >= 1) & (F.extract(F.lit("YEAROFWEEK"), day) == year), day)


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year (Butcher's integer rule)."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    m = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    n = div(a + 11 * h + 22 * m, 451)
    t = h + m - 7 * n + 114
    return F.make_date(year, div(t, 31), t % 31 + 1)
