"""A training corpus from the documents table: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Texts change only where a stage decides so.
Documents are told apart by doc_id: rows without one leave at the first stage,
which judges every other row by itself; of rows that share one the near-duplicate stage keeps the
one whose text has the smallest hash. Near duplicates are op 8's: fingerprints at most three bits apart. Other columns than
those of documents are dropped, whatever their names; null texts have no words and
leave at the first stage; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import mixing, packing, rules, simhash, substring
from scanloom.session import find_package, scratch_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words that a worker of the last stage remembers, twice; fewer than op 2 alone, as executors hold the memory of the other stages too.
PIECES_KEPT = 100_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected rows go; each is judged where it lies, so nothing is shuffled."""
    return rules.keep(docs.select(*COLUMNS).where("doc_id is not null"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; of rows that share an id the one whose text has the smallest hash."""
    docs = docs.select(*COLUMNS)
    first = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    one = F.min(F.struct(F.xxhash64("text").alias("h"), *COLUMNS)).alias("d")
    return docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(one).select(*(f"d.{c}" for c in COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out. Untouched texts stay as they are; of others the words that stay, and nothing of those without."""
    docs = docs.select(*COLUMNS)
    found = substring.dedup_table(docs).where("n_removed > 0").select("doc_id", "n_words", "n_removed", "kept_text")
    cut = docs.join(found, "doc_id", "left").where("n_removed is null or n_removed < n_words")
    text = F.coalesce("kept_text", "text")
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document comes as often as its source's weight asks; each at least once."""
    docs = docs.select(*COLUMNS)
    places = mixing.mix(docs).groupBy("doc_id").agg(F.count("*").cast("int").alias("times"))
    often = docs.join(places, "doc_id").withColumn("turn", F.explode(F.sequence(F.lit(1), "times")))
    return often.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"), end_id=0, pieces_kept=PIECES_KEPT)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SimHash, tokenisation and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each result is written as Parquet and read again."""
    find_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
