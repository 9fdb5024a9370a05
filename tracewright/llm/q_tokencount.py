"""Query op13_token_counts."""

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import Scratch, checkpointed, table
from .tokencount import counted


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each whole text of documents under piece_bpe_32k.model, and whether these are over 4,096."""
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with Scratch(spark) as scratch:
        return checkpointed(counted(docs, model, scratch, limit=4096, keep_text=False))
