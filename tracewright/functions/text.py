"""Tokens and lexical measures as Columns; MTLD by a pandas UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MTLD_THRESHOLD = 0.72


def tokens(text: Column | str) -> Column:
    """Lower case, ASCII punctuation deleted, split at white space; null and blank give no token."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), ASCII_PUNCTUATION, "")
    return F.regexp_extract_all(plain, F.lit(r"\S+"), F.lit(0))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def ttr(toks: Column) -> Column:
    """Types a token; 0 without tokens."""
    return F.coalesce(F.try_divide(F.size(F.array_distinct(toks)), F.size(toks)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two token sets, rounded to 6 digits; 0 if both are empty."""
    share = F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
    return F.round(F.coalesce(share, F.lit(0.0)), 6)


class Factors:
    """Factors of one direction: each ends where the running ratio comes to the threshold; the rest counts in part."""

    def __init__(self, threshold: float = MTLD_THRESHOLD):
        self.threshold, self.whole, self.seen, self.n, self.tokens = threshold, 0, set(), 0, 0

    def add(self, toks) -> None:
        for t in toks:
            self.n += 1
            self.tokens += 1
            self.seen.add(t)
            if len(self.seen) / self.n <= self.threshold:
                self.whole, self.seen, self.n = self.whole + 1, set(), 0

    def total(self) -> float:
        return self.whole + ((1 - len(self.seen) / self.n) / (1 - self.threshold) if self.n else 0.0)


def _factors(toks, threshold: float) -> float:
    state = Factors(threshold)
    state.add(toks)
    return state.total()


def mtld_of(toks, threshold: float = MTLD_THRESHOLD) -> float:
    """Tokens over the mean factors of both directions; 0 below two tokens or without any factor."""
    if toks is None or len(toks) < 2:
        return 0.0
    mean = (_factors(toks, threshold) + _factors(toks[::-1], threshold)) / 2
    return len(toks) / mean if mean else 0.0


def mtld(toks: Column | str) -> Column:
    """MTLD of an array of tokens, by a pandas UDF made at the call: modules load without a session."""

    @F.pandas_udf("double")
    def fold(x: pd.Series) -> pd.Series:
        return x.map(mtld_of).astype(float)

    return fold(toks)


def slugify(text: Column) -> Column:
    """Runs of what isn't a letter or digit become one underscore; trimmed, lower; `unknown` if nothing is left."""
    s = F.lower(F.trim(F.regexp_replace(text, r"[^a-zA-Z0-9]+", "_"), F.lit("_")))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def source_tag(source: Column) -> Column:
    return F.when(source == "local", "oss").when(source == "hf", "hf").otherwise(slugify(source))


def model_slug(model: Column) -> Column:
    """Without the part before the last slash."""
    return slugify(F.substring_index(model, "/", -1))


def experiment_name(source: Column, model: Column, prompt: Column, tag: Column) -> Column:
    src, slug = source_tag(source), model_slug(model)
    start = F.when(F.startswith(slug, F.concat(src, F.lit("_"))), slug).otherwise(F.concat_ws("_", src, slug))
    return F.concat_ws("_", start, prompt, F.when(F.coalesce(tag, F.lit("")) != "", slugify(tag)))


def scores_filename(model: Column, metric: Column) -> Column:
    return F.concat(F.lit("scores_opr_"), model_slug(model), F.lit("_"), metric, F.lit(".tsv"))


def group_of(utterance_id: Column) -> Column:
    """What stands before the last underscore."""
    return F.regexp_replace(utterance_id, r"_[^_]*$", "")


def results_filename(model: Column) -> Column:
    """The file of statements, a line a question."""
    return F.concat(F.lit("RESULTS_MODEL-"), F.replace(model, F.lit("/"), F.lit("-")), F.lit(".txt"))


def signed_p(p: Column) -> Column:
    """A p-value with its mark: in powers of ten below 0.0001, else 4 digits; a dot between 0.05 and 0.1."""
    text = F.when(p < 0.0001, F.format_string("%.2e", p)).otherwise(F.format_string("%.4f", p))
    mark = F.when(p < 0.001, " ***").when(p < 0.01, " **").when(p < 0.05, " *").when(p < 0.1, " .").otherwise("")
    return F.concat(text, mark)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
