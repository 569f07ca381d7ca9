"""Queries and SQL of the training-data operators, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteprism.llm import chat, decontaminate, fim, htmltext, langid, minhash, mixing, neighbours, phrases, quality, repeats, simhash, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat.query,
    "op2_source_mixing": mixing.query,
    "op3_line_quality": quality.query,
    "op4_nearest_neighbours": neighbours.query,
    "op5_language_id": langid.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_warc": warc.query,
    "op8_repeated_bytes": repeats.query,
    "op9_main_text": htmltext.query,
    "op10_decontamination": decontaminate.query,
    "op11_phrase_collocations": phrases.query,
    "op12_minhash_near_dedup": minhash.query,
    "op13_fill_in_middle": fim.query,
}

SQL: dict[str, str] = {
    "op1_chat_format": chat.SQL,
    "op7_warc": warc.SQL,
    "op10_decontamination": decontaminate.SQL,
    "op11_phrase_collocations": phrases.SQL,
    "op13_fill_in_middle": fim.SQL,
}
