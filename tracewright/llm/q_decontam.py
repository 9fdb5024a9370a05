"""Query op6_decontamination."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontam import leaks


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that it leaks: doc_id, item_id, cosine, lcs_share, answer_share."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
