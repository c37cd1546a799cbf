"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; its
result is written as Parquet and read again as the next stage's ``docs``. All
but the last return the columns of ``docs``.

1. ``quality``: documents that a quality rule rejects go.
2. ``lines``: lines repeated across the corpus (fuzzily) go but for the first
   occurrence; ``n_chars`` follows the new text. A document that loses lines
   and keeps none with a word goes.
3. ``near_duplicates``: one document of each group of near copies stays.
4. ``mix``: documents are sampled to source, language and topic targets.
5. ``pack``: the pieces of all that is left, in sequences of 1024 tokens.

Null and empty texts fall to the first stage. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    op1_mixing,
    op2_jaccard_join,
    op6_quality_rules,
    op7_packing,
    op8_line_dedup,
)
from ledgerloom.llm.common import SPACES, free_name, stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_quality_rules.apply_cascade(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = free_name(docs.columns, "_dropped")
    out = op8_line_dedup.without_repeats(docs, dropped_col=gone, exact_words=1,
                                         lines_col=free_name([*docs.columns, gone], "_lines"))
    whole = F.rtrim("text", F.lit(SPACES)) != ""
    kept = out.where((F.col(gone) == 0) | whole)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names: list[str] = []
    for name in ("_topic", "_tokens", "_rate", "_selected"):
        names.append(free_name([*docs.columns, *names], name))
    out = op1_mixing.mix(docs, out=names).where(F.col(names[-1]))
    return out.select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates),
          ("mix", mix), ("pack", pack)]

#: SimHash groups, the chosen-path join and token ids have no SQL form; the tests hold each stage
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
