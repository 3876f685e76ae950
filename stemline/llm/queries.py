"""The registered queries: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemline.llm import attribution, bpe, centroids, crosspolytope, divergence, language, minhash, oracles, packing, ppm, quality, secrets, sharding, suffixes
from stemline.llm.scratch import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.digest(attribution.count_tokens(table(spark, sf_dir, "documents")))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.cluster(table(spark, sf_dir, "embeddings"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.strip(table(spark, sf_dir, "documents")))


def op4_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op5_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents")))


def op10_odd_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.cluster(table(spark, sf_dir, "documents"))


def op11_byte_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.evaluate(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_attribution, op2_cross_polytope, op3_suffix_repeats, op4_fertility_rules, op5_trigram_secrets,
        op6_best_fit_packing, op7_jump_sharding, op8_byte_gru_language, op9_forced_boundary_bpe, op10_odd_sketch_minhash,
        op11_byte_ppm, op12_source_divergence, op13_partial_distance,
    )
}
#: What SQL can't express (vocabularies, trained weights, CRC sums over wrapping arithmetic, byte strings of whole
#: corpora at useful speed) is held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)
