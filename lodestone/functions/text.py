"""Text functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These must equal the words and tokens that retrieval is specified with.
STOPWORDS = (
    "a an the of for to in on at and or as is are was were be been being it its this that these those "
    "what which who whom whose how when where why do does did have has had will would can could should "
    "by with from your you we our us their his her not no into about over per than then there here"
).split()
FIGURE_WORDS = [
    "how much", "how many", "number of", "net profit", "profit", "income", "revenue", "ratio", "npa",
    "capital adequacy", "adequacy", "assets", "provision", "eps", "earnings per share", "dividend",
    "net worth", "deposits", "advances", "interest", "expense", "amount", "percentage", "crore",
    "what was the", "figure", "%",
]
# Fixed as well: what counts as a number, a date and a missing value decides which rows a table has.
PLACEHOLDERS = ["nil", "nit", "iin", "-", "—", "–"]
NUMBER = r"^[\(\[]?-?(\d[\d,]*(\.\d+)?%?|\d{1,2}[.\-/]\d{2}[.\-/]\d{4})[\)\]]?$"
DATE = r"^\d{1,2}[.\-/]\d{2}[.\-/]\d{4}$"
DATE_INSIDE = r"\b\d{1,2}[.\-/]\d{2}[.\-/]\d{4}\b"
ROW_NUMBER = r"^\d{1,2}$"


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it, also within lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Tokens without stopwords and bare numbers; all of them if none would be left."""
    stop = _strings(STOPWORDS)
    kept = lambda every: F.filter(every, lambda t: ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$"))
    return let(tokens(text), lambda every: let(kept(every), lambda some: F.when(F.size(some) > 0, some).otherwise(every)))


def focus_tokens(text: Column) -> Column:
    """Tokens that may tell passages apart: no stopwords, numbers or single characters."""
    stop = _strings(STOPWORDS)
    return F.filter(tokens(text), lambda t: ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$") & (F.length(t) > 1))


def split_joined(text: Column) -> Column:
    """A space between a lower-case and an upper-case ASCII letter."""
    return F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", " ")


def is_noise(line: Column) -> Column:
    """Short lines of mostly marks. Blank lines are not noise."""
    t = F.trim(line)
    plain = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", ""))
    return (F.length(t) > 0) & (F.length(t) < 40) & (plain / F.length(t) < 0.6)


def cleaned(text: Column) -> Column:
    """Joined words parted, noise lines dropped, line ends trimmed, blank runs made one blank line."""
    lines = F.split(F.regexp_replace(split_joined(text), "\r\n?", "\n"), "\n")
    kept = F.transform(F.filter(lines, lambda x: ~is_noise(x)), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def blocks(text: Column) -> Column:
    """Stretches between blank lines."""
    return F.filter(F.split(F.regexp_replace(text, r"^\s*\n|\n\s*$", ""), r"\n\s*\n"), lambda b: F.length(F.trim(b)) > 0)


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def question_key(text: Column) -> Column:
    """Equal for questions that differ in case and white space only."""
    return F.lower(one_spaced(text))


def answer_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[,\s]", "")


def word_count(text: Column) -> Column:
    """Tokens of the default tokenizer: words between white space."""
    t = one_spaced(text)
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, " "))).cast("long")


def last_words(text: Column, n: int) -> Column:
    """The last ``n`` words."""
    words = F.filter(F.split(one_spaced(text), " "), lambda w: w != "")
    return let(words, lambda ws: F.array_join(F.slice(ws, F.greatest(F.size(ws) - (n - 1), F.lit(1)), F.lit(n)), " "))


def word_pieces(text: Column, n: int) -> Column:
    """Pieces of at most ``n`` words."""
    words = F.filter(F.split(one_spaced(text), " "), lambda w: w != "")
    starts = lambda ws: F.when(F.size(ws) > 0, F.sequence(F.lit(1), F.size(ws), F.lit(n))).otherwise(F.array().cast("array<int>"))
    return let(words, lambda ws: F.transform(starts(ws), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " ")))


def is_number(token: Column) -> Column:
    return token.rlike(NUMBER)


def is_placeholder(token: Column) -> Column:
    return F.lower(token).isin(PLACEHOLDERS)


def numeric_share(text: Column) -> Column:
    """Share of tokens that hold a digit."""
    return let(tokens(text), lambda t: F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.filter(t, lambda x: x.rlike("[0-9]"))) / F.size(t)))


def wants_number(question: Column) -> Column:
    q = F.lower(question)
    return F.exists(_strings(FIGURE_WORDS), lambda w: F.contains(q, w))


def statement_named(question: Column) -> Column:
    """The one statement kind that a question names, else null."""
    q = F.lower(question)
    both, own = q.rlike(r"\b(consolidated|group)\b"), q.rlike(r"\bstandalone\b")
    return F.when(both & ~own, "consolidated").when(own & ~both, "standalone")


def snippet(text: Column, n: int = 600) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def preview(text: Column, n: int = 280) -> Column:
    return F.concat(F.substring(one_spaced(text), 1, n), F.lit(" ..."))


def scrubbed(text: Column, secret: str) -> Column:
    return F.replace(text, F.lit(secret), F.lit("***")) if secret else text


def words_for_embedding(text: Column, chunk_type: Column, separator: str = " | ") -> Column:
    """What of a chunk is embedded: rows by their label words, other chunks whole."""
    row = F.element_at(F.split(F.element_at(F.split(text, "\n"), -1), r" \| "), 1)
    words = F.filter(F.split(row, " +"), lambda t: ~is_number(t) & ~is_placeholder(t))
    label = F.array_join(words, " ")
    return F.when(chunk_type != "row", text).when(F.length(label) > 0, label).otherwise(row)
