"""Query op10_mpeg_audio."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, discard, stored, table
from .mpeg import probed, with_media


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text stored as MPEG audio and read back: the streams are a column of a table in the shared folder, which
    is removed once it has been read.

    feature: frames, the exact duration as samples/rate, the seek table's kind, the checksum of all
    frame offsets, and the number of failed checks.
    """
    media, path = stored(with_media(table(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    found = probed(media)
    seek = F.crc32(F.concat_ws(",", F.col("seek").cast("array<string>")).cast("binary"))
    feature = F.concat_ws(":", "frames", F.concat_ws("/", "samples", "rate"), "table", seek, "bad")
    out = found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
    out = checkpointed(out)
    discard(spark, path)
    return out
