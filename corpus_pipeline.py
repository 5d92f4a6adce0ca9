"""A training-data pipeline: five stages over ``documents``, each written and read again.

Stages take ``(spark, docs, sf_dir)`` and return a frame; all but the last keep the columns of their
input, so that extra columns and empty tables pass through. Parameters are those of production runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.bpe import encode_texts
from thicket.llm.decontaminate import find_benchmark
from thicket.llm.jaccard_join import jaccard_groups
from thicket.llm.pii import pseudonymise
from thicket.llm.quality import apply_policy, ledger
from thicket.llm.queries import PSEUDONYM_KEY, word_bpe
from thicket.ordering import dense_index
from thicket.session import stage


def shielded(docs: DataFrame) -> tuple[DataFrame, list[str], list[Column]]:
    """``docs`` with its other columns under names that no operator uses, these names, and the columns as they were."""
    hidden = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    named = docs.select(*[F.col(c).alias(hidden.get(c, c)) for c in docs.columns])
    return named, list(hidden.values()), [F.col(hidden.get(c, c)).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps. A null or empty text has too few words and goes; repeated rows go or stay together."""
    named, _, back = shielded(docs)
    return apply_policy(ledger(named), "v1").where("kept").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8: the one with the smallest id.

    Of repeated rows one stays. Different texts of one id are documents of their own, in the order of
    their digests, and each goes only if its own group has another that stays. Rows without id are in
    no group and stay; null and blank texts are linked with nothing. Other columns, of any name, are
    kept. An empty table gives an empty result.
    """
    key, digest = "__near_key", "__near_digest"
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        keyed = docs.withColumn(key, F.col("doc_id"))
    else:  # every text of an id gets a number, in the order of the ids
        told = docs.withColumn(digest, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
        numbered = dense_index(told.where("doc_id IS NOT NULL").select("doc_id", digest).distinct(), [], ["doc_id", digest], key)
        keyed = told.join(numbered, ["doc_id", digest], "left").select(*docs.columns, key)
        once = keyed.where(F.col(key).isNotNull()).dropDuplicates([key])  # rows that differ in other columns only
        keyed = stage(once.unionByName(told.where("doc_id IS NULL").select(*docs.columns, F.lit(None).cast("bigint").alias(key))))
    groups = jaccard_groups(keyed.select(key, "text"), shingle=5, num=80, den=100, id_col=key)
    others = groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_other")).distinct()
    return keyed.join(others, F.col(key) == F.col("_other"), "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that occur in any ten-word window of the benchmark; texts that lose all words go.

    Null and blank texts have no words and stay as they are; repeated rows are treated alike.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named, hidden, back = shielded(docs)
    found = find_benchmark(named, benchmark, window=10, carry=hidden).where("n_hit = 0 OR n_hit < n_words")
    return found.withColumn("text", F.col("clean_text")).select(*back)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and credentials replaced by keyed pseudonyms of the same format. Every row stays; null stays null."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return pseudonymise(docs, PSEUDONYM_KEY, carry=rest).select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to. Null and blank texts have none; other columns are left out."""
    return encode_texts(docs, word_bpe()).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe_encoding", bpe_encoding),
]
#: BPE and keyed permutations have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each from the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
