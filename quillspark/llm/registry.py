"""Queries of the training-data operators, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import alignment, bpe, chat_format, exact_dedup, language, line_dedup, merkle, neighbours, packing, quality, simhash, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_warc": warc.op3_warc,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op4_line_dedup_pages": line_dedup.op4_line_dedup_pages,
        "op5_packing": packing.op5_packing,
        "op6_simhash": simhash.op6_simhash,
        "op7_quality": quality.op7_quality,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_chat_format": chat_format.op9_chat_format,
        "op10_neighbours": neighbours.op10_neighbours,
        "op11_language": language.op11_language,
        "op12_alignment": alignment.op12_alignment,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.OP3_SQL, "op4_line_dedup": line_dedup.OP4_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op9_chat_format": chat_format.OP9_SQL, "op13_merkle": merkle.OP13_SQL}
