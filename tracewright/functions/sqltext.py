"""Functions over the text of SQL queries, as Columns: cleaning, normal form, extraction, cues.

Quirks that other tools' published figures depend on are kept: see the comments at each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

TARGET_COLUMNS = ("idcase", "activity", "resource", "timestamp", "cost")

# Words of an utterance that stand for a column.
COLUMN_SYNONYMS = {
    "idcase": ("idcase", "case", "process instance", "declaration", "travel declaration", "permit", "trip", "process", "identifier", "id"),
    "activity": ("activity", "activities", "task", "action", "event"),
    "resource": (
        "resource", "resources", "employee", "employees", "person", "people", "collaborator", "supervisor", "director", "administration",
        "administrator", "pre-approver", "approver", "budget owner", "budget holder", "worker", "staff",
    ),
    "timestamp": ("timestamp", "date", "time", "day", "month", "year", "when", "period", "temporal", "duration"),
    "cost": ("cost", "costs", "expense", "expenses", "price", "amount", "fee", "payment"),
}

# Cues of an utterance for an operation, as patterns. Two of them can't do what they look
# like (`aggregat` between word boundaries; the boundaries of the month list bind to its ends only).
OPERATION_CUES = {
    "COUNT": (r"\bhow many\b", r"\bnumber of\b", r"\bcount\b", r"\bquantify\b", r"\bhow many times\b", r"\boccurrences\b", r"\boccurrence\b"),
    "DISTINCT": (r"\bdifferent\b", r"\bdistinct\b", r"\bunique\b", r"\bdifferentes\b"),
    "SUM": (r"\btotal\b", r"\bsum\b", r"\baggregat\b"),
    "MIN": (r"\bminimum\b", r"\bmin\b", r"\bsmallest\b", r"\blowest\b", r"\bfewest\b", r"\bleast\b"),
    "MAX": (r"\bmaximum\b", r"\bmax\b", r"\blargest\b", r"\bhighest\b", r"\bmost\b", r"\bgreatest\b"),
    "GROUP BY": (r"\beach\b", r"\bper\b", r"\bby\b", r"\bgroup\b", r"\bbreakdown\b", r"\bbreaking down\b", r"\bdistribution\b"),
    "Temporal": (
        r"\bdate\b", r"\btime\b", r"\bwhen\b", r"\bday\b", r"\bmonth\b", r"\byear\b", r"\bbetween\b", r"\bbefore\b", r"\bafter\b", r"\bduring\b",
        r"\bperiod\b", r"\bin \d{4}\b", r"\b20\d{2}\b",
        r"\bjanuary|february|march|april|may|june|july|august|september|october|november|december\b",
    ),
    "Negation": (r"\bnot\b", r"\bexcept\b", r"\bexcluding\b", r"\bother than\b", r"\bwithout\b", r"\bno\b", r"\bnever\b", r"\bnone\b", r"\bdifferent from\b"),
    "Set operation": (r"\bexcept\b", r"\bunion\b", r"\bintersect\b", r"\bbut not\b", r"\bnot in\b"),
}

# What marks an operation in a query without its literals, upper-cased.
OPERATION_MARKS = {
    "COUNT": r"\bCOUNT\s*\(",
    "DISTINCT": r"\bDISTINCT\b",
    "SUM": r"\bSUM\s*\(",
    "MIN": r"\bMIN\s*\(",
    "MAX": r"\bMAX\s*\(",
    "GROUP BY": r"\bGROUP\s+BY\b",
    "Temporal": r"\bBETWEEN\b|\bTIMESTAMP\b.*\bLIKE\b",
    "Negation": r"!=|<>|\bNOT\b",
    "Set operation": r"\b(EXCEPT|INTERSECT|UNION)\b",
}

# The months' names, and below the patterns and limits by which literals are found, typed and looked for in a question.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def once(c: Column, use) -> Column:
    """use(c) with c made once a row, however often use() reads it: Spark makes what stands inside of a lambda or a branch anew each time."""
    return F.transform(F.array(c), use)[0]


def without_literals(sql: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sql, r"'[^']*'", "''"), r'"[^"]*"', '""')


def referenced_columns(sql: Column, plain: Column | None = None) -> Column:
    """The target columns that occur outside quotes, in their fixed order. plain: without_literals(sql), if it is a column already."""
    plain = without_literals(sql) if plain is None else plain
    return F.array_compact(F.array(*[F.when(F.rlike(plain, F.lit(rf"(?i)\b{c}\b")), c) for c in TARGET_COLUMNS]))


def literals(sql: Column) -> Column:
    """array<struct<literal, value_type>>: single-quoted, then double-quoted, then bare numbers, in order."""
    pair = lambda x, kind: F.struct(x.alias("literal"), kind.alias("value_type"))
    kind = F.lit

    def single(x: Column) -> Column:
        dated = F.rlike(x, F.lit(r"^\d{4}-\d{2}-\d{2}")) | F.rlike(x, F.lit(r"^\d{4}-\d{2}$"))
        year = F.rlike(x, F.lit(r"^\d{4}%"))
        return F.when(dated, pair(x, kind("date_string"))).when(year, pair(F.regexp_replace(x, "%+$", ""), kind("year_pattern"))).otherwise(pair(x, kind("string")))

    def double(x: Column) -> Column:
        return pair(x, F.when(F.rlike(x, F.lit(r"^\d{4}-\d{2}-\d{2}")), "date_string").otherwise("string"))

    return F.concat(
        F.transform(F.regexp_extract_all(sql, F.lit("'([^']+)'"), 1), single),
        F.transform(F.regexp_extract_all(sql, F.lit('"([^"]+)"'), 1), double),
        F.transform(F.regexp_extract_all(without_literals(sql), F.lit(r"\b(\d+(?:\.\d+)?)\b"), 1), lambda x: pair(x, kind("numeric"))),
    )


def operations(sql: Column, plain: Column | None = None) -> Column:
    """map<operation, boolean>. Temporal sees BETWEEN, of any column, and `timestamp ... LIKE` only. plain: without_literals(upper(sql))."""
    plain = without_literals(F.upper(sql)) if plain is None else plain
    return F.create_map(*[x for name, mark in OPERATION_MARKS.items() for x in (F.lit(name), F.rlike(plain, F.lit(mark)))])


def names_column(utterance: Column, column: str, toks: Column | None = None) -> Column:
    """Does the utterance name the column: words as tokens, phrases as substrings? (Tokens have no hyphen.) toks: tokens(utterance)."""
    words = [s for s in COLUMN_SYNONYMS[column] if " " not in s]
    phrases = [s for s in COLUMN_SYNONYMS[column] if " " in s]
    found = F.arrays_overlap(tokens(utterance) if toks is None else toks, F.array(*map(F.lit, words)))
    for p in phrases:
        found |= F.contains(F.lower(utterance), F.lit(p))
    return found


def has_cue(utterance: Column, operation: str) -> Column:
    return F.rlike(F.lower(utterance), F.lit("|".join(f"(?:{p})" for p in OPERATION_CUES[operation])))


def _soft(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "['-]", " "))


def _string_named(value: Column, low: Column) -> Column:
    return once(F.trim(F.lower(value)), lambda v: F.contains(low, v) | F.contains(_soft(low), _soft(v)))


def _number_named(value: Column, low: Column) -> Column:
    quoted = F.regexp_replace(value, r"\.", r"\\.")
    grouped = lambda g: F.contains(low, g) | F.contains(low, F.replace(g, F.lit(","), F.lit(".")))
    long = ~F.contains(value, F.lit(".")) & (F.length(value) >= 4)
    either = once(F.format_number(value.try_cast("bigint"), 0), grouped)
    return (value != "1") & (F.rlike(low, F.concat(F.lit(r"\b"), quoted, F.lit(r"\b"))) | (long & F.coalesce(either, F.lit(False))))


def _date_named(value: Column, low: Column) -> Column:
    bare = lambda c: F.ltrim(c, F.lit("0"))

    def by_parts(parts: Column) -> Column:
        part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        month = F.lit(False)
        for i, name in enumerate(MONTHS, 1):
            month |= (part(1) == f"{i:02d}") & (F.contains(low, F.lit(name)) | F.contains(low, F.lit(str(i))))
        year = (part(0) != "") & F.contains(low, part(0))
        return year | month | ((part(2) != "") & F.contains(low, bare(part(2))))

    return once(F.trim(F.lower(value)), lambda v: F.contains(low, v) | once(F.split(v, "-"), by_parts))


def value_named(literal: Column, utterance: Column) -> Column:
    """Does the utterance name a literal struct<literal, value_type>?"""
    value, kind = literal["literal"], literal["value_type"]
    return once(
        F.lower(utterance),
        lambda low: F.when(kind == "string", _string_named(value, low))
        .when(kind.isin("date_string", "year_pattern"), _date_named(value, low))
        .when(kind == "numeric", _number_named(value, low))
        .otherwise(False),
    )


def spaced(sql: Column) -> Column:
    """Trimmed, lower case, white space runs one space: for telling gold queries apart."""
    return F.regexp_replace(F.lower(F.trim(sql)), r"\s+", " ")


def _outside_quotes(sql: Column, change, inside=lambda x: x, keep_quotes: bool = True) -> Column:
    """change() on what stands outside single quotes, inside() on the rest."""
    parts = F.transform(F.split(sql, "'"), lambda x, i: F.when(i % 2 == 0, change(x)).otherwise(inside(x)))
    return F.array_join(parts, "'" if keep_quotes else "")


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\n\r\x0b\x0c"))


# The patterns of the next three functions and their order; scores that must come out equal depend on them.
def clean_sql(raw: Column, cot: bool = False, prefix: str = "") -> Column:
    """One executable statement out of a model's answer: chat marks, fence, final answer, prose, prefix,
    first statement (split at any semicolon, even in a literal), white space outside literals."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?s)<\|im_end\|>.*", "")
    return once(_strip(F.regexp_replace(text, r"<\|[^|>]+\|>", "")), lambda t: F.when(t == "", "").otherwise(_clean(t, cot, prefix)))


def _clean(text: Column, cot: bool, prefix: str) -> Column:
    """clean_sql of a text without chat marks, stripped; each step is made once."""
    fence = r"(?is)```(?:sql|sqlite)?\s*(.*?)\s*```"
    fenced = lambda c: F.when(F.contains(c, F.lit("```")) & F.rlike(c, F.lit(fence)), _strip(F.regexp_extract(c, fence, 1))).otherwise(c)
    final = r"(?is)final\s*sql\s*:?\s*(.+)"
    keyword = r"(?is)(\b(?:select|with|insert|update|delete)\b.*)"

    def answer(inner: Column) -> Column:
        last = once(F.regexp_extract(text, final, 1), lambda x: F.when(x != "", once(_strip(x), fenced)).otherwise(text))
        return F.when(inner != text, inner).otherwise(last)

    # both patterns catch a character at least, so an empty extract is no match
    def statement(inner: Column) -> Column:
        return once(F.regexp_extract(inner, keyword, 1), lambda x: F.when(x != "", x).otherwise(inner))

    def prefixed(inner: Column) -> Column:
        return F.when(F.rlike(inner, F.lit(r"(?i)^\s*select\b")), inner).otherwise(F.concat(F.lit(prefix), inner))

    inner = once(fenced(text), answer) if cot else fenced(text)
    inner = once(inner, statement)
    if prefix:
        inner = once(inner, prefixed)
    head = _strip(F.split_part(F.rtrim(_strip(inner), F.lit(";")), F.lit(";"), F.lit(1)))
    whole = once(head, lambda x: F.when(x == "", "").otherwise(F.concat(x, F.lit(";"))))
    return _strip(_outside_quotes(whole, lambda x: F.regexp_replace(x, r"[ \t\n\r]+", " ")))


def normal_sql(sql: Column) -> Column:
    """The form that exact match compares: lower case, white space and commas tightened, ` as name` and
    COUNT(name) levelled, all outside single quotes, and the quotes themselves gone."""

    def level(x: Column) -> Column:
        x = F.regexp_replace(F.lower(x), r"\s+", " ")
        x = F.regexp_replace(x, r"\s*,\s*", ",")
        x = F.regexp_replace(x, r"\s+as\s+\w+", "")
        return F.regexp_replace(x, r"count\s*\(\s*(?!\*)\w+\s*\)", "count(*)")

    bare = _strip(F.rtrim(_strip(F.coalesce(sql, F.lit(""))), F.lit(";")))
    return _strip(_outside_quotes(bare, level, F.lower, keep_quotes=False))


def has_order_by(sql: Column) -> Column:
    return F.rlike(sql, F.lit(r"(?i)\border\s+by\b"))


def has_order_by_text(sql: str | None) -> bool:
    return bool(re.search(r"\border\s+by\b", sql or "", re.I))
