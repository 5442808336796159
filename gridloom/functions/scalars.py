"""Scalar column functions: time slots, forecast errors, binning, identifiers and survey answers.

All of them are built-in expressions, so that plans stay inside code generation. Missing values
are NULL, never NaN; a ratio without a denominator is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TIE = 1e-12


def clean_number(x: Column) -> Column:
    """NaN becomes NULL; text that is no number becomes NULL."""
    y = x.try_cast("double")
    return F.when(~F.isnan(y), y)


# ---- time -------------------------------------------------------------------------------------


def slot_index(ts: Column, origin: str, seconds: int) -> Column:
    """Number of whole steps since origin (a TIMESTAMP_NTZ literal's text)."""
    return F.floor(F.timestamp_diff("SECOND", F.lit(origin).cast("timestamp_ntz"), ts) / seconds).cast("int")


def slot_of_day(ts: Column, minutes: int = 30) -> Column:
    """1-based slot of the wall clock."""
    return (F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes) + 1).cast("int")


def slot_label(slot: Column, minutes: int = 30) -> Column:
    """'HH:MM' at which a slot begins."""
    at = (slot - 1) * minutes
    return F.format_string("%02d:%02d", F.floor(at / 60).cast("int"), (at % 60).cast("int"))


def hour_band(slot: Column, minutes: int = 30, hours: int = 2) -> Column:
    """'HH-HH' band of the day that a slot lies in."""
    begin = (F.floor((slot - 1) * minutes / (60 * hours)) * hours).cast("int")
    return F.format_string("%02d-%02d", begin, begin + hours)


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a 0-based position in a period."""
    angle = value * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def local_wall(ts: Column, zone: str = "Europe/London") -> Column:
    """Wall-clock time in a zone of a UTC time without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def offset_minutes(ts: Column, zone: str = "Europe/London") -> Column:
    return F.timestamp_diff("MINUTE", ts, local_wall(ts, zone)).cast("int")


def day_of_code(code: Column) -> Column:
    """Day of a combined day * 100 + slot code."""
    return F.floor(code / 100).cast("int")


def slot_of_code(code: Column) -> Column:
    return (code % 100).cast("int")


def date_of_day(day: Column, first: str = "2009-01-01") -> Column:
    """Date of a 1-based day number."""
    return F.date_add(F.lit(first).cast("date"), day - 1)


def day_number(date: Column, first: str = "2009-01-01") -> Column:
    return F.date_diff(date, F.lit(first).cast("date")) + 1


def split_label(ts: Column, splits: Sequence[tuple[str, str, str]]) -> Column:
    """Name of the closed interval (name, first, last) that a time lies in; NULL outside of all."""
    out = F.lit(None).cast("string")
    for name, first, last in reversed(list(splits)):
        out = F.when(ts.between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")), name).otherwise(out)
    return out


def crosses(first: Column, target: Column, boundaries: Sequence[int]) -> Column:
    """Whether a window of slots from `first` to `target` has a boundary in it: first <= boundary < target."""
    out = F.lit(False)
    for b in boundaries:
        out = out | ((first <= b) & (target > b))
    return out


def in_period(date: Column, slot: Column, first: tuple[str, int], last: tuple[str, int]) -> Column:
    """Lexicographic closed interval of (date, slot)."""
    at = F.struct(date.cast("date").alias("d"), slot.cast("int").alias("s"))
    bound = [F.struct(F.lit(d).cast("date").alias("d"), F.lit(s).alias("s")) for d, s in (first, last)]
    return at.between(*bound)


def circular_difference(a: Column, b: Column, period: int) -> Column:
    d = F.abs(a - b)
    return F.least(d, period - d)


# ---- errors -----------------------------------------------------------------------------------


def smape(actual: Column, predicted: Column) -> Column:
    """Symmetric percentage error of a row; 0 where both are 0."""
    total = F.abs(actual) + F.abs(predicted)
    return F.when(total > 0, 200 * F.abs(predicted - actual) / total).when(total == 0, F.lit(0.0))


def direction(actual: Column, predicted: Column, tol: float = TIE) -> Column:
    e = predicted - actual
    return F.when(e > tol, "over").when(e < -tol, "under").when(e.isNotNull(), "exact")


def safe_ratio(numerator: Column, denominator: Column, eps: float = TIE, scale: float = 1.0) -> Column:
    """NULL where the denominator is within eps of 0."""
    return F.when(F.abs(denominator) > eps, scale * numerator / denominator)


def positive_ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """NULL where the denominator isn't positive."""
    return F.when(denominator > 0, scale * numerator / denominator)


def floored_ratio(numerator: Column, denominator: Column, floor: float, scale: float = 1.0) -> Column:
    """With a denominator of at least `floor`."""
    return scale * numerator / F.greatest(denominator, F.lit(floor))


def scaled(x: Column, mean: Column, std: Column, floor: float = 0.01) -> Column:
    return (x - mean) / F.greatest(std, F.lit(floor))


def unscaled(z: Column, mean: Column, std: Column, floor: float = 0.01) -> Column:
    return z * F.greatest(std, F.lit(floor)) + mean


# ---- bins -------------------------------------------------------------------------------------


def load_bin(x: Column, edges: Sequence[float] = (0.1, 0.5, 1.0)) -> Column:
    """Names of ranges closed on the right; exactly zero has its own."""
    out = F.when(x == 0, "zero")
    low = 0.0
    for e in edges:
        out = out.when(x <= e, f"({low:g},{e:g}]")
        low = e
    return out.when(x.isNotNull(), f">{low:g}")


def coarse_bin(name: Column, merged: dict[str, str]) -> Column:
    """Bins merged by a mapping; others stay."""
    table = F.create_map(*(F.lit(x) for pair in merged.items() for x in pair))
    return F.coalesce(F.element_at(table, name), name)


def band(x: Column, bands: Sequence[tuple[float, float, str]]) -> Column:
    """Label of the inclusive band that x lies in."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(bands)):
        out = F.when(x.between(low, high), label).otherwise(out)
    return out


def effect_label(x: Column, small: float, medium: float, large: float) -> Column:
    y = F.abs(x)
    return F.when(y >= large, "large").when(y >= medium, "medium").when(y >= small, "small").when(y.isNotNull(), "negligible")


# ---- identifiers and answers ------------------------------------------------------------------


def clean_text(x: Column) -> Column:
    """Trimmed; blank and 'nan' are NULL."""
    y = F.trim(x)
    return F.when((y != "") & (F.lower(y) != "nan"), y)


def identifier(x: Column) -> Column:
    """Trimmed upper case without a '.0' that a number column left behind."""
    return F.upper(F.regexp_replace(F.trim(x), r"\.0$", ""))


def identifier_status(x: Column, valid: str = "^N[0-9]{4}$", other: str = "^D[0-9]{4}$") -> Column:
    y = identifier(x)
    return F.when(y.isNull() | (y == ""), "blank").when(y.rlike(valid), "valid").when(y.rlike(other), "out_of_scope").otherwise("malformed")


def category(x: Column) -> Column:
    """Clean text, whole numbers without '.0'."""
    return F.regexp_replace(clean_text(x), r"^(-?[0-9]+)\.0$", "$1")


def profile_group(x: Column) -> Column:
    """The group 1 to 4 that a text names at its end, as in 'G2', 'Profile G2', 'Group 3' or '4'."""
    last = F.substring(F.trim(x), -1, 1)
    return F.when(last.isin("1", "2", "3", "4"), last.try_cast("int"))


def with_reason(value: Column, reason: Column) -> Column:
    """(value, reason): a reason only where there is no value."""
    return F.struct(value.alias("value"), F.when(value.isNull(), reason).alias("reason"))


def int_in_range(x: Column, low: int, high: int) -> Column:
    text = clean_text(x)
    number = text.try_cast("double")
    whole = F.when((number == F.floor(number)) & number.between(low, high), number.cast("int"))
    return with_reason(whole, F.when(text.isNull(), "blank").when(number.isNull(), "not_a_number").otherwise("out_of_range"))


def yes_no(x: Column) -> Column:
    y = F.lower(clean_text(x))
    value = F.when(y.isin("yes", "y", "1"), 1).when(y.isin("no", "n", "0", "2"), 0)
    return with_reason(value, F.when(y.isNull(), "blank").when(y.like("%know%"), "dont_know").otherwise("unrecognised"))


def any_of(*answers: Column) -> Column:
    """Three-valued OR: 1 if any is 1, 0 if all are 0, otherwise NULL."""
    out = answers[0] == 1
    for a in answers[1:]:
        out = out | (a == 1)
    return out.cast("int")


def response_class(x: Column) -> Column:
    y = F.lower(F.trim(x))
    return F.when(y.isNull() | (y == ""), "blank").when(y.like("%refus%"), "refused").when(y.like("%know%"), "dont_know").when(y.isin("n/a", "na", "not applicable"), "not_applicable").otherwise("valid")


def column_key(name: str) -> str:
    """A column name in lower case, other characters as single underscores."""
    import re

    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def one_column(columns: Sequence[str], *candidates: str) -> str:
    """The one column whose key is among the candidates; an error for none or several."""
    found = [c for c in columns if column_key(c) in {column_key(x) for x in candidates}]
    if len(found) != 1:
        raise ValueError(f"expected exactly one of {candidates}, found {found}")
    return found[0]


def public_path(path: Column, root: str) -> Column:
    """A path as it may be published: relative to `root` where it lies below it, another absolute path by its last name alone, a relative one as it is, without empty or `.` parts. NULL stays NULL."""
    plain = F.regexp_replace(F.regexp_replace(path, r"/(\.?/)+", "/"), r"^(\./)+|(?<=.)/\.?$", "")
    top = root.rstrip("/")
    last = F.substring_index(plain, "/", -1)
    below = F.when(plain == (top or "/"), ".").when(plain.startswith(f"{top}/"), F.substr(plain, F.lit(len(top) + 2)))
    return F.when(plain.rlike("^[/~]"), F.coalesce(below, last)).when(plain == "", ".").otherwise(plain)


def public_text(text: Column, marks: dict[str, str]) -> Column:
    """A text in which private prefixes, such as a project's or a home folder, are replaced by their marks, in the order given; empty prefixes count for nothing."""
    for prefix, mark in marks.items():
        if prefix:
            text = F.replace(text, F.lit(prefix), F.lit(mark))
    return text
