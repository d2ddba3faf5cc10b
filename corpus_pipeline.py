"""The corpus pipeline: five stages over documents, each working on all that the one before kept.

1. quality rules: failing lines go, rejected documents go
2. language ID: documents without a language go, and a missing or differing label is replaced
3. n-gram Jaccard join: of each group of near duplicates the smallest id stays
4. substring dedup: passages that a smaller id has too go
5. packing: what is left, as pieces of sequences

Every stage but the last returns the columns of documents; its result is written as Parquet
and read again as the next one's input.

Defined results: a null, empty or blank text goes in stage 1; a row with a null id is in no group
of near duplicates and passes stage 3, and stage 4 keeps all its words; of rows that repeat an id
and a text one stays, with the smallest (lang, source); rows that repeat an id with other texts
count as one document in stage 3, and stay or go together. A null or wrong label is replaced in
stage 2; ties go to the smaller label. Texts of any length are taken whole. An empty table gives
an empty result in each stage. Columns of other names are dropped by the first stage that meets
them; n_chars follows the text.

Each stage's result stays in the shared folder until the user removes it: the rows of run() are
read from the last one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import jaccard_join, language_id, packing, quality_rules, substring_dedup
from trackloom.llm._shared import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"
SEQUENCE = 2048


def _like_documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like_documents(quality_rules.clean(docs, keep=["lang", "source"]))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.identify(docs, train=language_id.fold() != 1, keep=["text", "source"])
    return _like_documents(found.where(F.col("lang_pred") != language_id.UNDETERMINED).withColumn("lang", F.col("lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.jaccard_components(docs, n=5, percent=80)
    first = settle(groups.where("doc_id = component_id").groupBy("doc_id").agg((F.count("*") > 1).alias("repeats")), "first-of-groups")
    kept = docs.join(first.where("not repeats"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    if not (repeats := first.where("repeats")).isEmpty():
        same = docs.join(repeats, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source")).alias("rest"))
        kept = kept.unionByName(_like_documents(same.select("doc_id", "text", "rest.*")))
    return _like_documents(kept)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like_documents(substring_dedup.remove(docs, window=13, keep=["lang", "source"]).where("n_words > n_removed"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), size=SEQUENCE, end_id=1)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", packed),
]

#: Tokenisation and fitted models have no SQL; what each stage keeps is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
