"""Reporting periods: sortable integers like 20260331 and texts like 'March 31, 2026'."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and their short forms.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SHORT = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}
NUMBER_OF = {m: i + 1 for i, m in enumerate(MONTHS)} | SHORT

_LONG = "|".join(MONTHS)
_ANY = "(?:" + "|".join(sorted(NUMBER_OF, key=len, reverse=True)) + ")"
_YEAR = r"(?:19|20)\d{2}"
_FISCAL = r"'?(?:" + _YEAR + r"|\d{2})"


def month_number(name: Column) -> Column:
    pairs = [F.lit(x) for kv in NUMBER_OF.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def as_key(year: Column, month: Column, day: Column) -> Column:
    return (year.cast("int") * 10000 + month.cast("int") * 100 + day.cast("int")).cast("int")


def month_end(year: Column, month: Column) -> Column:
    return F.date_format(F.last_day(F.make_date(year.cast("int"), month.cast("int"), F.lit(1))), "yyyyMMdd").cast("int")


def period_key(period: Column) -> Column:
    """The first 'Month d, yyyy' of the text as a key; 0 if there is none."""
    rx = rf"(?i)({_LONG})\s+(\d{{1,2}}),?\s*(\d{{4}})"
    part = lambda i: F.regexp_extract(period, rx, i)
    return F.coalesce(F.when(part(1) != "", as_key(part(3), month_number(part(1)), part(2))), F.lit(0))


def _full_year(text: Column) -> Column:
    y = F.regexp_replace(text, "'", "").cast("int")
    return F.when(y >= 100, y).otherwise(y + 2000)


def _quarters(hit: Column) -> Column:
    year = _full_year(F.regexp_extract(hit, rf"(?i)({_FISCAL})$", 1))

    def end(q: Column) -> Column:
        n = F.substring(q, 2, 1)
        return F.when(n == "1", (year - 1) * 10000 + 630).when(n == "2", (year - 1) * 10000 + 930).when(n == "3", (year - 1) * 10000 + 1231).otherwise(year * 10000 + 331)

    return F.transform(F.regexp_extract_all(F.lower(hit), F.lit("q[1-4]"), F.lit(0)), end)


def _one(rule: Callable[[Callable[[int], Column]], Column], pattern: str) -> Callable[[Column], Column]:
    """A rule over one hit's groups."""
    return lambda hit: F.array(rule(lambda i: F.regexp_extract(hit, pattern, i)))


# Which expressions name a period, and the order in which they are taken out, decide what a question is
# searched by, so that both must be these.
_FULL = rf"(?i)\b(?:fy|f\.y\.?|fiscal\s+year|financial\s+year)\s*({_FISCAL})\b"
_SPAN = rf"(?i)\b({_ANY})\.?\s*(?:-|–|to)\s*({_ANY})\.?,?\s*({_YEAR})\b"
_MDY = rf"(?i)\b({_ANY})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+({_YEAR})\b"
_DMY = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_ANY})\.?,?\s+({_YEAR})\b"
_MY = rf"(?i)\b({_ANY})\.?,?\s+({_YEAR})\b"
_NUM = rf"\b(\d{{1,2}})[./-](\d{{1,2}})[./-]({_YEAR})\b"
#: (pattern, keys of a hit), in the order in which hits are taken out of the text.
RULES: list[tuple[str, Callable[[Column], Column]]] = [
    (rf"(?i)\b(?:q[1-4](?:\s*(?:,|&|/|\band\b|\bor\b))*\s*)+(?:of\s*)?(?:fy|f\.y\.?)\s*{_FISCAL}\b", _quarters),
    (_FULL, _one(lambda g: _full_year(g(1)) * 10000 + 331, _FULL)),
    (_SPAN, _one(lambda g: month_end(g(3), month_number(g(2))), _SPAN)),
    (_MDY, _one(lambda g: as_key(g(3), month_number(g(1)), g(2)), _MDY)),
    (_DMY, _one(lambda g: as_key(g(3), month_number(g(2)), g(1)), _DMY)),
    (_MY, _one(lambda g: month_end(g(2), month_number(g(1))), _MY)),
    (_NUM, _one(lambda g: as_key(g(3), g(2), g(1)), _NUM)),
]


def _cast(keys: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda hit: keys(hit).cast("array<int>")


def query_periods(question: Column) -> Column:
    """struct(periods, rest): sorted keys that a question names, and the question without them."""
    text, found = question, F.array().cast("array<int>")
    for pattern, keys in RULES:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found = F.concat(found, F.flatten(F.transform(hits, _cast(keys))))
        text = F.regexp_replace(text, pattern, " ")
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, r"\(\s*\)", " "), r"\s+", " "))
    return F.struct(F.array_sort(F.array_distinct(found)).alias("periods"), F.when(F.size(found) > 0, rest).otherwise(question).alias("rest"))


def names_period(question: Column) -> Column:
    """Whether a question holds a four-digit year or a month's full name anywhere."""
    q = F.lower(question)
    return q.rlike(r"\b(19|20)\d{2}\b") | q.rlike(_LONG)


_TEXT = rf"^({'|'.join(m.capitalize() for m in MONTHS)})\s+(\d{{1,2}}),\s*(\d{{4}})$"


def shift_period(period: Column, months: int) -> Column:
    """The month's end so many months earlier, as text; null if the period can't be read."""
    t = F.trim(period)
    first = F.make_date(F.regexp_extract(t, _TEXT, 3).try_cast("int"), month_number(F.regexp_extract(t, _TEXT, 1)), F.lit(1))
    return F.when(t.rlike(_TEXT), F.date_format(F.last_day(F.add_months(first, -months)), "MMMM d, yyyy"))


def column_labels(header: Column, n_values: Column, period: Column) -> Column:
    """A label for each value of a row, or null where the layout isn't certain."""
    squashed = F.lower(F.regexp_replace(header, r"\s+", ""))
    groups = F.regexp_extract_all(squashed, F.lit("(halfyear|ninemonths|quarter|year)ended"), F.lit(1))
    titles = F.create_map(*map(F.lit, ["quarter", "Quarter ended", "halfyear", "Half year ended", "ninemonths", "Nine months ended", "year", "Year ended"]))
    #: Months back of each column, by the place of its group.
    backs = [[0, 3, 12], [0, 12], [0]]
    label = lambda g, back: F.concat(F.try_element_at(titles, F.try_element_at(groups, F.lit(g + 1))), F.lit(" "), shift_period(period, back))
    out = F.lit(None).cast("array<string>")
    for n in (1, 2, 3):
        columns = [(g, b) for g in range(n) for b in backs[g]]
        out = F.when((F.size(groups) == n) & (n_values == len(columns)), F.array(*(label(g, b) for g, b in columns))).otherwise(out)
    return F.when(header.isNotNull() & F.trim(period).rlike(_TEXT), out)
