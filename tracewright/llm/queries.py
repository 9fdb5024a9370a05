"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_chat, q_decontam, q_hardneg, q_html, q_langid, q_lines, q_minhash, q_mixing, q_mpeg, q_sharding, q_tokencount, q_vectorcode, q_warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_preference_chat": q_chat.op1_preference_chat,
    "op2_fuzzy_lines": q_lines.op2_fuzzy_lines,
    "op3_near_dedup": q_minhash.op3_near_dedup,
    "op4_html_main_text": q_html.op4_html_main_text,
    "op5_language_id": q_langid.op5_language_id,
    "op6_decontamination": q_decontam.op6_decontamination,
    "op7_warc": q_warc.op7_warc,
    "op8_sampled_shards": q_sharding.op8_sampled_shards,
    "op9_source_mix": q_mixing.op9_source_mix,
    "op10_mpeg_audio": q_mpeg.op10_mpeg_audio,
    "op11_hard_negatives": q_hardneg.op11_hard_negatives,
    "op12_vector_codes": q_vectorcode.op12_vector_codes,
    "op13_token_counts": q_tokencount.op13_token_counts,
}

ORACLES: dict[str, str] = {
    "op1_preference_chat": q_chat.SQL,
    "op2_fuzzy_lines": q_lines.SQL,
    "op3_near_dedup": q_minhash.SQL,
    "op4_html_main_text": q_html.SQL,
    "op7_warc": q_warc.SQL,
    "op8_sampled_shards": q_sharding.SQL,
    "op9_source_mix": q_mixing.SQL,
    "op11_hard_negatives": q_hardneg.SQL,
    "op12_vector_codes": q_vectorcode.SQL,
}
