"""A corpus through toxicity, line deduplication, near-deduplication, decontamination and packing.

Each stage's result is written to the shared folder and read again as the next one's documents.  Stages take documents with nulls in
any column, further columns (which they drop), repeated rows, ties and an empty table, and process whole texts; what each case
gives is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, line_dedup, packing, simhash, toxicity
from quarry.llm.common import drop_written, scratch, table, written
from quarry.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score the threshold or more go; null and empty texts score the base rate and stay.  Repeated rows go or stay together."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs.select(*COLUMNS), model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing is left; n_chars follows the text.

    Texts that were null or empty before stay, as empty ones.  Rows of one doc_id are one document; those without one come last."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    whole = kept.where((F.col("n_dropped") == 0) | (F.length(F.btrim("text")) > 0))
    return whole.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the least doc_id, one without doc_id last, one of its repeated rows; empty texts are one group."""
    return simhash.keep_one(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; wordless ones hold none, and an empty benchmark has none."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing's rows, not documents: one a piece.  Empty texts have the end id alone; repeated rows are packed each."""
    return packing.pack(docs.select(*COLUMNS), tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", near_dedup),
    ("decontamination", decontaminated),
    ("packing", packed),
]
#: A fitted toxicity model and 64-bit hashes are not SQL; tests hold run() over planted documents against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows.  What a stage wrote goes once its result is written, and that once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = made.keep(written(stage(spark, docs, sf_dir), name))
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
