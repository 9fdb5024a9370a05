"""Comparisons without case that reach the files: decided once against a column's different values, and asked as a list of them.

A filter on lower(activity) or ILIKE has to read every row; `activity IN (...)` is pushed into the scan, where statistics and
dictionaries of Parquet leave out what can't match. A column of more different values than a bound isn't listed, and its comparisons
stay as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different values of a column that are brought to the driver at most, and values in one list.
MOST, LONGEST_LIST = 10_000, 1_000


def _like(pattern: str) -> re.Pattern:
    parts = {"%": ".*", "_": "."}
    return re.compile("".join(parts.get(c) or re.escape(c) for c in pattern), re.DOTALL | re.IGNORECASE)


@dataclass(frozen=True)
class Vocabulary:
    """The different values of columns, without null."""

    values: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @staticmethod
    def of(log: DataFrame, *columns: str, most: int = MOST) -> Vocabulary:
        """The columns that have `most` different values at most."""
        found = {}
        for c in columns:
            rows = log.select(c).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect()
            if len(rows) <= most:
                found[c] = tuple(sorted(r[0] for r in rows))
        return Vocabulary(found)

    def matching(self, column: str, text: str, like: bool) -> list[str] | None:
        """The values that a comparison without case holds for; None if they aren't known or too many for a list."""
        if column not in self.values:
            return None
        if like:
            pattern = _like(text)
            found = [v for v in self.values[column] if pattern.fullmatch(v)]
        else:
            found = [v for v in self.values[column] if v.lower() == text.lower()]
        return found if len(found) <= LONGEST_LIST else None

    def equals(self, column: str, text: str) -> Column:
        found = self.matching(column, text, False)
        return F.lower(column) == text.lower() if found is None else _listed(column, found)

    def like(self, column: str, pattern: str) -> Column:
        found = self.matching(column, pattern, True)
        return F.ilike(F.col(column), F.lit(pattern)) if found is None else _listed(column, found)

    def condition(self, column: str, operator: str, text: str) -> str | None:
        """The SQL of a comparison: operator is =, <>, LIKE or NOT LIKE, text without its quotes; None if it stays as it is."""
        found = self.matching(column.lower(), text, "LIKE" in operator)
        if found is None:
            return None
        not_ = "NOT " if operator in ("<>", "NOT LIKE") else ""
        if not found:
            return f"({column} {'=' if not_ else '<>'} {column})"  # all or none, and null for null
        quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in found)
        return f"{column} {not_}IN ({quoted})"


def _listed(column: str, found: list[str]) -> Column:
    return F.col(column).isin(found) if found else F.col(column) != F.col(column)
