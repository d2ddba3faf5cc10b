"""The registered queries of the subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm._shared import documents

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm.quality_rules import assess

    return assess(documents(spark, sf_dir)).drop("kept_text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm.token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), _tokenizer(BYTE_BPE), limit=1024)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm.substring_dedup import remove

    out = remove(documents(spark, sf_dir), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm.packing import pack

    return pack(documents(spark, sf_dir), _tokenizer(BYTE_BPE), size=2048, end_id=1)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm.sentencepiece_codec import round_trips

    return round_trips(documents(spark, sf_dir), _tokenizer(PIECE_BPE))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm.language_id import fold, identify

    out = identify(documents(spark, sf_dir), train=fold() != 1)
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm.license_scan import scan

    return scan(documents(spark, sf_dir)).drop("spans")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm.jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir), n=5, percent=80)


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm.vector_search import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm.warc import round_trip

    out = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=1000)
    # A row without an id has a record id of its own, which is no number.
    page = lambda c: F.expr(f"try_cast(case when startswith({c}, 'urn:page:') then substr({c}, 10) end as bigint)")
    return out.select(page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=4)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm.periodic_runs import best, find

    out = find(with_planted_runs(documents(spark, sf_dir))).withColumn("top", best(F.col("runs")))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    long = lambda f: F.col("top")[f].cast("long")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[long(f).alias(f) for f in ("start", "length", "period")],
        F.expr("1000L * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm.decontaminate import hits

    out = hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, gram=5)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents' ids and texts; where crc32 of the id ends in 0, the text's tail repeats itself
    with the offset and the period that the rest of the number gives."""
    h, w = F.crc32(F.col("doc_id").cast("string")), F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    docs = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, w)).withColumn("n", F.size("w"))
    a = F.expr("h div 10 % n")
    tailed = docs.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.expr("1 + (n - a) div (3 + h div 10 % 8)"))
    word = lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), word), " ")
    return tailed.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from trackloom.llm.oracles import SQL

    return dict(SQL)
