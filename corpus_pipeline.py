"""The training-data pipeline: quality, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them in order, each on what the one before
it wrote. All but the last return the columns of ``documents``.

In every stage a null text counts as empty, texts are read whole whatever their length, an empty table stays empty, and columns other than
those of ``documents`` are left out, whatever their names. Rows are judged one by one, so repeated rows share their fate and a row
without id is judged by its text; near duplicates are told apart by id alone: rows that repeat an id stay or go together.
Where that matters more closely, a stage says so.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, decontaminate, near_dedup, quality, repeats
from llm.common import folders, forget, saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of the shortest passage that counts as repeated.
PASSAGE = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, accepts: a score of at least 0.7. Without any label every score is one half, and none stays."""
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("score >= 0.7").select(COLUMNS)


def keep_first_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates (similarity of 0.8 or more).

    Empty texts are near nothing and stay. A row without id goes if its group has a document with one.
    """
    return near_dedup.one_per_group(docs, threshold=0.8).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of ``PASSAGE`` or more words of an earlier document; a text without any stays as it was.

    A text that is cut altogether goes. A row without id loses nothing; rows of one id take nothing from each other.
    """
    later = repeats.remove_repeats(docs, width=PASSAGE, keep_columns=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    cut = later.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"), "n_removed")
    return cut.filter("n_removed = 0 OR text <> ''").select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark"), keep_columns=True).filter("n_items = 0").select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(docs, path), path)
    return coded.select(*COLUMNS, F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", keep_first_of_near),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("tokenize", tokenize),
]

#: No SQL expresses these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, older = _table(spark, sf_dir, "documents"), set()
    for name, stage in STAGES[:-1]:
        before = folders()
        made = stage(spark, docs, sf_dir)
        scratch = folders() - before
        docs = saved(made, name)
        forget(scratch | older)  # the stage's own tables and the table it read
        older = folders() - before - scratch
    return STAGES[-1][1](spark, docs, sf_dir)
