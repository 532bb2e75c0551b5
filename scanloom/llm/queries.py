"""Registered queries of the numbered operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import embeddings, manifest, mixing, oracles, packing, planes, prefixes, quality, rules, sharding, simhash, slack, substring, toxicity
from scanloom.session import table

#: Production shards of op4.
SHARDS = [f"shard-{k:03d}" for k in range(128)]


def op1_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(rules.ledger(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")))


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_fingerprint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_table(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_lookup_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.place(docs, SHARDS)


def op5_itq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.token_index(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op7_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf against the manifest, where a fifth of the documents are tampered with."""
    made = manifest.manifest(table(spark, sf_dir, "documents"), now={"text": manifest.lower_fifth()})
    return manifest.verified(made)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.shared_trie(table(spark, sf_dir, "conversations"))


def op13_minimum_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack.pack_tightly(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_rule_ledger, rule_ablations, op2_best_two_fit, op3_fingerprint_log, op4_lookup_shards, op5_itq_embeddings, op6_bit_planes, op7_noisy_channel, op8_simhash_golay, op9_rule_ensemble, op10_temperature_mix, op11_merkle_manifest, op12_prefix_trie, op13_minimum_slack)
}

ORACLES: dict[str, str] = {
    "op1_rule_ledger": oracles.OP1,
    "rule_ablations": oracles.ABLATIONS,
    "op3_fingerprint_log": oracles.OP3,
    "op5_itq_embeddings": oracles.OP5,
    "op10_temperature_mix": oracles.OP10,
    "op11_merkle_manifest": oracles.OP11,
    "op12_prefix_trie": oracles.OP12,
}
