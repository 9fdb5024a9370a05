"""Query op5_language_id."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .common import table


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of each whole text of documents: doc_id, held_out, lang_pred, score.

    A null doc_id counts as not held out, and isn't learned from.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learned_from(docs)
    found = langid.identify(docs.select("doc_id", "text"), model)
    held = F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
