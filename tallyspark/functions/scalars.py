"""Scalar rules of the receipt model as Column expressions; nothing here leaves the JVM unless it says so.

Text that is missing is the empty string, numbers that cannot be read are null. Money is held as whole cents (long).
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Mapping
from decimal import Decimal
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and their numbers.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
#: White space as text editors know it: Unicode spaces, line ends and the byte order mark.
_SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# The three shapes of a purchase date, and what a number looks like.
_ISO, _US, _NAMED = r"^(\d{4})([-/])(\d{2})\2(\d{2})$", r"^(\d{2})/(\d{2})/(\d{2})$", r"^([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DOUBLE_STEP = 2.220446049250313e-16
DEFAULT_RATE = 13.0


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(trimmed(text), F.lit("")) == ""


def first_text(*choices: Column) -> Column:
    """The first choice that is not blank, as it stands; else the empty string."""
    out = F.lit("")
    for c in choices[::-1]:
        out = F.when(~is_blank(c), c).otherwise(out)
    return out


def number(text: Column) -> Column:
    """A decimal or hexadecimal number in text as double; null for blank, infinite, NaN and anything else."""
    t = trimmed(text)
    plain = F.regexp_extract(t, _NUMBER, 0).try_cast("double")
    hexadecimal = F.conv(F.regexp_extract(t, "^0[xX]([0-9a-fA-F]{1,15})$", 1), 16, 10).try_cast("double")
    return finite(F.coalesce(plain, hexadecimal))


def finite(value: Column) -> Column:
    return F.when(F.abs(value) < float("inf"), value)  # NaN is above every number


def leading_number(text: Column) -> Column:
    """The number that a text starts with ("12abc" is 12), null if it starts with none."""
    return number(F.regexp_extract(text, rf"^{_SPACE}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1))


def purchase_date(text: Column) -> Column:
    """YYYY-MM-DD, YYYY/MM/DD, MM/DD/YY (20YY) or "Month D, YYYY" as a date; null for other shapes and impossible days."""
    names = F.create_map(*[F.lit(x) for name, n in MONTHS.items() for x in (name, f"-{n:02d}-")])

    def read(t: Column) -> Column:
        numeric = F.regexp_replace(F.regexp_replace(t, _ISO, "$1-$3-$4"), _US, "20$3-$1-$2")
        month = F.try_element_at(names, F.lower(F.regexp_extract(t, _NAMED, 1)))
        named = F.concat(F.regexp_extract(t, _NAMED, 3), month, F.lpad(F.regexp_extract(t, _NAMED, 2), 2, "0"))
        return F.try_to_date(F.regexp_replace(F.when(t.rlike("^[0-9]"), numeric).otherwise(named), "^0000", "none"), "yyyy-MM-dd")

    return let(trimmed(text), read)


def read_date(text: str | None) -> datetime.date | None:
    """``purchase_date`` for a parameter, on the driver."""
    t = re.sub(rf"^{_SPACE}+|{_SPACE}+$", "", text or "")
    if m := re.search(_ISO, t, re.ASCII):
        year, month, day = int(m[1]), int(m[3]), int(m[4])
    elif m := re.search(_US, t, re.ASCII):
        year, month, day = 2000 + int(m[3]), int(m[1]), int(m[2])
    elif m := re.search(_NAMED, t, re.ASCII):
        year, month, day = int(m[3]), MONTHS.get(m[1].lower(), 0), int(m[2])
    else:
        return None
    try:
        return datetime.date(year, month, day)
    except ValueError:
        return None


# Date forms beyond the three shapes - ISO with a time; day, month name, year; month name, day, year; month, day, year in numbers - each as year, month,
# day and what follows; what may follow; and the zones that go by a name.
_FREE = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:T|\s+)(.*)$", "$1|$2|$3|$4"),
    (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3,9})\.?[\s,-]+(\d{4})(?:$|,?\s+(.*)$)", "$3|$2|$1|$4"),
    (r"^(?:[A-Za-z]{3,9},?\s+)?([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})(?:$|,?\s+(.*)$)", "$3|$1|$2|$4"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:$|,?\s+(.*)$)", "$3|$1|$2|$4"),
)
_CLOCK = r"^(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*([AaPp][Mm])?\s*([A-Za-z]{1,4})?\s*([+-]\d{2}:?\d{2})?\s*(?:\([^()]*\))?$"
_ZONES = {"z": "+00:00", "ut": "+00:00", "utc": "+00:00", "gmt": "+00:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00"}


def free_time(text: Column) -> Column:
    """The moment that a free-form date names (mail headers, clocks' own texts, dates with a time in words or numbers), null for other forms.

    A time with a zone is that moment; without one it is the session zone's; without a time it is the day's start. Names of weekdays, and remarks in brackets, say
    nothing; impossible days, times and zones that aren't known give null."""
    months = F.create_map(*[F.lit(x) for name, n in MONTHS.items() for x in (name, str(n))])
    zones = F.create_map(*[F.lit(x) for pair in _ZONES.items() for x in pair])

    def moment(parts: Column) -> Column:
        year, month, day, rest = (F.get(parts, F.lit(i)) for i in range(4))
        month = F.when(month.rlike("^[0-9]"), month).otherwise(F.try_element_at(months, F.lower(month)))
        part = lambda i: F.regexp_extract(rest, _CLOCK, i)
        hour, half = part(1).try_cast("int"), F.lower(part(4))
        hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
        zone = F.when(part(6) != "", F.regexp_replace(part(6), "^(...):?", "$1:")).when(part(5) != "", F.try_element_at(zones, F.lower(part(5)))).otherwise("")
        known = (part(5) == "") | F.try_element_at(zones, F.lower(part(5))).isNotNull()
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        clock = F.when(rest == "", "00:00:00").when(rest.rlike(_CLOCK) & known, F.concat(two(hour), F.lit(":"), part(2), F.lit(":"), F.when(part(3) == "", "00").otherwise(part(3)), zone))
        return F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "), clock).try_cast("timestamp")

    def read(t: Column) -> Column:
        found = F.coalesce(*(F.when(t.rlike(form), F.regexp_replace(t, form, order)) for form, order in _FREE))
        return let(F.split(found, r"\|", 4), moment)

    return let(trimmed(text), read)


def date_text(date: Column) -> Column:
    """The date as YYYY-MM-DD, empty for null."""
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(""))


def date_label(text: Column, style: str = "MMMM d, yyyy") -> Column:
    """A purchase date for display. Impossible dates of a known shape and unreadable texts are shown trimmed as they stand.

    Free-form dates (``free_time``) are shown by their date in the session's zone; what can't be read as one is shown trimmed as well."""
    return F.coalesce(F.date_format(F.coalesce(purchase_date(text).cast("timestamp"), free_time(text)), style), trimmed(text))


def cents(amount: Column) -> Column:
    """Whole cents of an amount, halves upwards; null for null."""
    return F.floor((amount + F.lit(_DOUBLE_STEP)) * 100 + 0.5)


def basis_points(rate_percent: float | None) -> int | None:
    """Percent times 100; the default rate for None; null for rates that are not positive or not finite."""
    rate = DEFAULT_RATE if rate_percent is None else float(rate_percent)
    if not 0 < rate < float("inf"):
        return None
    return int((rate + _DOUBLE_STEP) * 100 + 0.5)


def tax_cents(amount_cents: Column, rate_percent: float | None = None) -> Column:
    """Tax on whole cents, halves upwards; null for negative amounts, those beyond 2**53 - 1, or without a rate."""
    points = basis_points(rate_percent)
    if points is None:
        return F.lit(None).cast("long")
    ok = (amount_cents >= 0) & (amount_cents <= (1 << 53) - 1)
    exact = (amount_cents.cast("decimal(20,0)") * points + 5000) / F.lit(10000).cast("decimal(5,0)")
    return F.when(ok, F.floor(exact).cast("long"))


def matching_sums(tax: int, points: int) -> tuple[int, int]:
    """The least and the largest amount in cents whose tax is ``tax``."""
    return -(-(10_000 * tax - 5_000) // points), (10_000 * tax + 4_999) // points


def money(amount_cents: Column) -> Column:
    """Cents as text with two decimals."""
    size = F.abs(amount_cents)
    return F.concat(F.when(amount_cents < 0, "-").otherwise(""), F.floor(size / 100).cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def cents_of_text(text: Column) -> Column:
    """Cents of a tax text, 0 if it can't be read."""
    return F.coalesce(cents(number(text)), F.lit(0).cast("long"))


def plain_number(value: Column) -> Column:
    """The shortest usual text of a double: no trailing zeros, no exponent below 1e21, empty for null and non-finite."""
    short = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,16)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    text = value.cast("string")
    listed = F.when(~text.contains("E"), F.regexp_replace(text, r"\.0$", "")).otherwise(short)
    return F.when(finite(value).isNull(), "").when(value == 0, "0").otherwise(listed)


def two_decimals(value: Column) -> Column:
    """Two decimals of the double's exact binary value, halves away from zero (1.005 is stored a little lower, so "1.00")."""
    size = F.abs(value)
    product = size * 100
    high = size * F.lit(134217729.0) - (size * F.lit(134217729.0) - size)  # the upper half of the digits, so that both products are exact
    error = (high * 100 - product) + (size - high) * 100
    low = F.floor(product)
    rest = product - low
    whole = (low + F.when((rest > 0.5) | ((rest == 0.5) & (error >= 0)), 1).otherwise(0)).cast("long")
    return F.when(finite(value).isNotNull(), F.concat(F.when(value < 0, "-").otherwise(""), money(whole)))


def csv_field(text: Column) -> Column:
    """The text in quotes, quotes doubled."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def positive_whole(value: Column) -> Column:
    return F.when((finite(value) == F.floor(value)) & (value > 0), value)


def item_description(name: Column, quantity: Column) -> Column:
    """"N × name" for positive whole quantities, else the name; empty without a name."""
    n, q = trimmed(name), positive_whole(quantity)
    return F.when(n == "", "").when(q.isNull(), n).otherwise(F.concat(plain_number(q), F.lit(" × "), n))


def filename_part(text: Column, fallback: str) -> Column:
    """A name without characters that file systems refuse; the fallback if nothing is left."""
    clean = F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1F]', "-")
    clean = trimmed(F.regexp_replace(clean, f"{_SPACE}+", " "))
    clean = F.regexp_replace(clean, r"[. ]+$", "")
    return F.when(clean == "", fallback).otherwise(clean)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def optional_money(text: Column) -> Column:
    return number(text)


def epoch_millis(text: Column) -> Column:
    """Milliseconds of an ISO timestamp, 0 for a blank one, null for one that can't be read."""
    return F.when(is_blank(text), F.lit(0).cast("long")).otherwise(F.unix_millis(text.try_cast("timestamp")))


def iso_timestamp(stamp: Column) -> Column:
    """A timestamp as ISO text in the session's zone (UTC by convention)."""
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def first_word(text: Column) -> Column:
    return F.element_at(F.split(trimmed(text), f"{_SPACE}+"), 1)


def field_key(name: Column) -> Column:
    """A form field's name without case and punctuation."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def resolve_field(available: list[str], aliases: list[str]) -> str | None:
    """The available field that an alias names: exactly first, then as a part; by normalised names."""
    plain = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    by_name = {plain(a): a for a in available}
    for alias in aliases:
        if plain(alias) in by_name:
            return by_name[plain(alias)]
    return next((a for alias in aliases for a in available if plain(alias) in plain(a)), None)


def swap_extension(name: Column, extension: str) -> Column:
    """The file name with its last extension replaced, or with one if it has none."""
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit(f".{extension}"))


def short_tail(text: Column, keep: int = 12) -> Column:
    """The last characters after dots, if the text is longer than them."""
    return F.when(F.char_length(text) <= keep, text).otherwise(F.concat(F.lit("..."), F.right(text, F.lit(keep))))


def storage_key(prefix: str, identity: str) -> str:
    """A settings key: the prefix and the percent-encoded identity."""
    return prefix + quote(identity, safe="!'()*-._~")


def storage_key_of(prefix: str, identity: Column) -> Column:
    """``storage_key`` of a column; null for null."""
    encoded = F.replace(F.url_encode(identity), F.lit("+"), F.lit("%20"))
    for mark in "!'()~":  # these stay as they are
        encoded = F.replace(encoded, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    return F.concat(F.lit(prefix), encoded)


# The texts for errors that say nothing, and the type names that add nothing to a message.
EMPTY_TEXT, UNKNOWN_OBJECT, PLAIN_ERRORS = "empty error string", "unknown error object", ("", "Error", "Exception")


def number_text(value: float) -> str:
    """A number as scripts write it: shortest digits that read back the same, an exponent only from 1e21 on and below 1e-6."""
    if value != value or abs(value) == float("inf"):
        return "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"
    if value == 0 or 1e-6 <= abs(value) < 1e21:
        return f"{int(value)}" if value == int(value) else f"{Decimal(repr(value)):f}"
    return re.sub(r"e([+-])0+", r"e\1", repr(value))


def error_text(error: object) -> str:
    """A short text for any kind of error value. Exceptions and mappings are named by their type and message, as far as they have
    them; mappings with neither are written as JSON; texts are trimmed; everything else is written as scripts do."""
    if isinstance(error, (BaseException, Mapping)):
        said = (error.get("name"), error.get("message")) if isinstance(error, Mapping) else (type(error).__name__, str(error))
        name, message = (x.strip() if isinstance(x, str) else "" for x in said)
        if name or message:
            return (message if name in PLAIN_ERRORS else f"{name}: {message}") if message else name
        try:
            return json.dumps(dict(error), separators=(",", ":")) if error else UNKNOWN_OBJECT
        except TypeError:
            return UNKNOWN_OBJECT
    if isinstance(error, str):
        return error.strip() or EMPTY_TEXT
    if isinstance(error, float):
        return number_text(error)
    return {None: "null", True: "true", False: "false"}.get(error, str(error)) if error is None or isinstance(error, bool) else str(error)


def cleanup_text(package: Column, opened: Column, activation: Column, kept: Column, failures: Column) -> Column:
    """The sentence that reports an image cleanup."""
    s = lambda n: F.when(n == 1, "").otherwise("s")
    failed = F.coalesce(failures, F.lit(0))
    tail = F.when(failed > 0, F.concat(F.lit(" "), failed, F.lit(" image"), s(failed), F.lit(" could not be deleted."))).otherwise("")
    return F.concat(
        F.lit("Archived photo cleanup complete: "), package, F.lit(" package, "), opened, F.lit(" opened-card, and "), activation, F.lit(" activation receipt image"), s(activation),
        F.lit(" deleted. "), kept, F.lit(" sales receipt"), s(kept), F.lit(" preserved."), tail,
    )
