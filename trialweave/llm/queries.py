"""The operators on the given tables, as the driver calls them: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from trialweave.llm import (
    chat,
    codes,
    decontaminate,
    fingerprints,
    importance,
    lm,
    near_dedup,
    neighbours,
    passages,
    pieces,
    quality,
    secrets,
    sharding,
)


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings."""
    rows = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    odd = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(odd)))


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_likeness(_read(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digest(_read(spark, folder, "documents"))


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, folder, "documents"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_read(spark, folder, "documents"))


def op7_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Each shared passage from both sides; ``first`` marks the side of its first holder."""
    found = passages.repeated_passages(_read(spark, folder, "documents"))
    own, other = ("doc_id", "start_word", "end_word"), ("other_id", "other_start", "other_end")

    def side(mine, theirs, first: bool):
        cells = [F.col(c).alias(n) for c, n in zip((*mine, *theirs), (*own, *other))]
        return F.struct(*cells, "equal_words", F.lit(first).alias("first"))

    return found.select(F.inline(F.array(side(own, other, False), side(other, own, True))))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(_read(spark, folder, "documents"))


def op9_lm(spark: SparkSession, folder: str) -> DataFrame:
    found = lm.scores(_read(spark, folder, "documents"))
    return found.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op11_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compress(_read(spark, folder, "embeddings"))


def op12_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_read(spark, folder, "embeddings"))


def op13_resample(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


REGISTRY = {
    "op1_chat": op1_chat,
    "op2_fingerprints": op2_fingerprints,
    "op3_quality": op3_quality,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_near_dedup": op5_near_dedup,
    "op6_sharding": op6_sharding,
    "op7_passages": op7_passages,
    "op8_secrets": op8_secrets,
    "op9_lm": op9_lm,
    "op10_decontaminate": op10_decontaminate,
    "op11_codes": op11_codes,
    "op12_neighbours": op12_neighbours,
    "op13_resample": op13_resample,
    "pipeline": corpus_pipeline.run,
}
