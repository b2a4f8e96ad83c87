"""A corpus pipeline from the operators of pricewren.llm: toxic documents go, one document of each group of near duplicates stays, secrets
are masked, documents are sampled to target weights, and the rest is packed into training sequences.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and all but the last return the columns of documents.

Defined results, for each stage: null ids, texts, sources and languages are values; empty texts pass through all stages; repeated rows are rows of
their own but for the second stage, where one stays; empty tables stay empty; further columns of docs, of whatever name, are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.llm import jaccard_join, mixing, packing, secrets, toxicity
from pricewren.llm.common import held_out, read_table, written
from pricewren.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores below 0.5. It is trained on the labels of documents outside of the held-out fifth."""
    lexicon = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return toxicity.clean(docs.select(COLUMNS), lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity of 0.8): that of the smallest doc_id, null ids last.

    A row is known by its doc_id and 128 bits of hashes of its text, so where ids repeat or are null, the other texts of an id stay or go on their own,
    and of rows with the same id and text one stays. Texts without words are in no group and stay.
    """
    names = ("key_none", "key_id", "key_hash", "key_more")
    parts = (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    keyed = docs.select(*COLUMNS, *[p.alias(n) for p, n in zip(parts, names, strict=True)])
    groups = written(jaccard_join.jaccard_groups(docs, words=5, threshold=(4, 5), key=F.struct(*[p.alias(n) for p, n in zip(parts, names, strict=True)])), "groups")
    gone = groups.where("component_id <> doc_id").select("doc_id.*").distinct()
    several = groups.where("n_shingles > 0 and component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id.*")
    left = keyed.join(gone, list(names), "left_anti")
    if not several.limit(1).count():
        return left.select(COLUMNS)
    once = left.join(several, list(names), "left_semi").dropDuplicates(list(names))
    return left.join(several, list(names), "left_anti").unionByName(once).select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    model = secrets.train(secrets.random_strings(spark).unionByName(secrets.ordinary_strings(docs)))
    found = secrets.scan(docs.select(COLUMNS), model)
    masked = found.withColumn("text", F.when(F.size("found") > 0, secrets.redact(F.col("text"), F.col("found"))).otherwise(F.col("text")))
    return masked.withColumn("n_chars", F.when(F.size("found") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities raked to the tempered shares of source, language and topic."""
    return mixing.sample(docs.select(COLUMNS), share=mixing.KEEP_SHARE).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: Tokens, trained models and groups of near duplicates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
