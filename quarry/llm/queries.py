"""Queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, licenses, line_dedup, packing, quality, sharding, simhash, toxicity, url_filter
from .common import table

#: The tokenizer file that op2 packs with; None: word_bpe_49k.json of the installed public_tokenizers.
TOKENIZER: str | None = None


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


QUERIES = {
    "op1_language_id": lambda s, d: language_id.op1(_docs(s, d)),
    "op2_packing": lambda s, d: packing.op2(_docs(s, d), tokenizer_path()),
    "op3_line_dedup": lambda s, d: line_dedup.op3(_docs(s, d)),
    "op4_url_filter": lambda s, d: url_filter.op4(table(s, d, "pages")),
    "op5_simhash": lambda s, d: simhash.op5(_docs(s, d)),
    "op6_sharding": lambda s, d: sharding.op6(_docs(s, d)),
    "op7_toxicity": lambda s, d: toxicity.op7(_docs(s, d), table(s, d, "labels")),
    "op8_licenses": lambda s, d: licenses.op8(_docs(s, d)),
    "op9_decontaminate": lambda s, d: decontaminate.op9(_docs(s, d), table(s, d, "benchmark")),
    "op10_quality": lambda s, d: quality.op10(_docs(s, d), table(s, d, "labels")),
    # What SQL can express of op8 and op10: their base columns, through the same operators.
    "base_licenses": lambda s, d: licenses.op8(_docs(s, d)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
    "base_quality": lambda s, d: quality.op10(_docs(s, d), table(s, d, "labels")).select(*quality.BASE_COLUMNS),
}
SQL = {
    "base_licenses": licenses.BASE_SQL,
    "base_quality": quality.BASE_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
}
