"""Queries of this subpackage over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, unsigned_hex
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(documents(spark, sf_dir), carry=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import drop_repeats

    return drop_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    found = quality(documents(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "common_distance")})


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import MARK, decode, encode

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decode(encode(docs, model), model)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        (F.col("decoded") == F.replace(text, F.lit(MARK), F.lit(" "))).alias("round_trip"),
    )


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_preferences, pair_conversations

    found = format_preferences(pair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    whole = lambda side: F.array_join(F.transform(f"{side}_completion", lambda s: s.text), "").alias(f"{side}_text")
    train = lambda side: F.aggregate(f"{side}_completion", F.lit(0), lambda n, s: n + F.when(s.train, F.length(s.text)).otherwise(0)).cast("bigint").alias(f"{side}_train_chars")
    return found.select("pair_id", "chosen_id", "rejected_id", "n_common", "prompt", whole("chosen"), whole("rejected"), train("chosen"), train("rejected"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chaining import repeated_passages

    # Each passage once for each of its two documents, so that every document that has one is a doc_id.
    found = repeated_passages(documents(spark, sf_dir)).withColumnsRenamed({"id": "doc_id", "partner": "partner_id", "component": "component_id"})
    turned = {"doc_id": "partner_id", "partner_id": "doc_id", "start": "partner_start", "end": "partner_end", "partner_start": "start", "partner_end": "end"}
    sides = F.array(*(F.struct(*(F.col(names.get(c, c)).alias(c) for c in found.columns)) for names in ({}, turned)))
    return found.select(F.explode(sides).alias("row")).select("row.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict, train

    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs.filter(~held_out))
    found = predict(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damaged, repair_conversations, summaries

    return summaries(repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import looped, periodic_runs

    found = periodic_runs(looped(documents(spark, sf_dir)))
    line = lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.start.alias("start"), best.length.alias("length"), best.period.alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    found = scan_licenses(documents(spark, sf_dir))
    starts, labels = F.col("places.start"), lambda c: F.col(f"{c}.label")
    named = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    share = F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(labels("places")).alias("base_labels"), named(F.concat(labels("places"), labels("blocks"))).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(share).alias("score"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_exact_dedup, op3_source_mix, op4_suffix_dedup, op5_quality_rules, op6_simhash, op7_sentencepiece, op8_preference_pairs, op9_repeated_passages, op10_language_id, op11_conversation_repair, op12_periodic_runs, op13_license_scan)}
