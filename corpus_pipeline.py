"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; `run` writes
what a stage returns to the shared folder and reads it again for the next one. What a stage returns must
be written before the next stage is called: that deletes the tables that the one before it left, but for
those that its own input reads. The operators, and with them the subpackage, are imported when a stage runs.

Every stage passes the columns of its input through, whatever their names, but for the last. An empty
table stays empty. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Tables that there were when the last stage began.
_MARK: list[int] = []


def _begin(spark: SparkSession, docs: DataFrame) -> None:
    """Get ready for a stage over `docs`, and delete what the one before has left."""
    from stowage.llm import common

    common.prepare(spark)
    if _MARK:
        common.drop_since(spark, _MARK.pop(), docs)
    _MARK.append(common.tables_written())


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects go. Null, empty and short texts are rejected; rows that repeat, share an id or have none are judged each by its text."""
    from stowage.llm import quality

    _begin(spark, docs)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least doc_id stays, a null being the last. Different texts that share an id or have none are documents of their own; of repeated rows one stays; a null text is a copy of an empty one only."""
    from stowage.llm import simhash

    _begin(spark, docs)
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier in the corpus, by doc_id with null last, go from the texts. A text that loses none stays as it is; another becomes its kept words joined by blanks, so its line breaks go too. No row goes; null texts stay null."""
    from stowage.llm import substring

    _begin(spark, docs)
    return substring.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order. Texts without words are never taken; a null source is one; rows count each on its own."""
    from stowage.llm import mixing

    _begin(spark, docs)
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix, placed in sequences. Rows are packed each on its own, whatever their ids; a null text is an empty one."""
    from stowage.llm import packing

    _begin(spark, docs)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't say the rows of run(): its second stage needs XXH64 and its last one a tokenizer. Tests hold each stage against a plain version; the SQL of the first, third and fourth operator is that of op7, op9 and op6.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in `sf_dir`."""
    from stowage.llm import common

    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    _MARK.clear()
    for _, stage in STAGES[:-1]:
        written = common.Written(stage(spark, docs, sf_dir), "stage")
        if held:
            held.drop()
        held, docs = written, written.df
    last = STAGES[-1][1](spark, docs, sf_dir)
    # What the result reads stays, whatever is called next.
    _MARK.clear()
    return last
