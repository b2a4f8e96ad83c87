"""The registered query of each operator of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.llm import (
    alignment,
    embedding_dedup,
    fill_in_middle,
    fingerprints,
    html_text,
    jaccard_join,
    language_id,
    mixing,
    packing,
    secrets,
    substring_dedup,
    token_counts,
    toxicity,
)
from pricewren.llm.common import held_out, read_table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies, on the driver as on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_digests(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    lexicon = toxicity.train(docs, labels, ~held_out(F.col("doc_id")))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mixing.sample(read_table(spark, sf_dir, "documents"), share=mixing.KEEP_SHARE)
    return kept.select("doc_id", "source", "lang", mixing.form_topic(F.col("text")).alias("topic"), mixing.token_weight(F.col("text")).alias("n_tokens"), "mix_probability")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.train(secrets.random_strings(spark).unionByName(secrets.ordinary_strings(docs)))
    found = secrets.scan(docs, model).select("doc_id", "found")
    base = F.filter("found", lambda s: s["kind"] < 3)
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{secrets.KINDS[kind]}")
    return found.select("doc_id", number(0), number(1), number(2), F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(F.col("found")).alias("spans"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(read_table(spark, sf_dir, "documents"), words=3, threshold=(9, 10))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))))
    predicted = language_id.predict(docs, model)
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, window=2048)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = {"output_sha256": "sha256(output)", "restored_sha256": "sha256(restored)"}
    return fill_in_middle.fill_in_middle(read_table(spark, sf_dir, "documents"), digests)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"), words=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_html_extraction": op3_html_extraction,
    "op4_mixing": op4_mixing,
    "op5_secret_scans": op5_secret_scans,
    "op6_token_counts": op6_token_counts,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_alignment": op11_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_substring_dedup": op13_substring_dedup,
}

#: Bounds by lengths of units, output and rest by positions in the text.
FILL_SQL = """
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
hashed AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || sha256('1:' || doc_id)[i:i + 7])::BIGINT) AS h FROM units),
cut AS (
  SELECT *, list_sum(list_transform(u[1:least(h[1] % (n + 1), h[2] % (n + 1))], lambda x: length(x)))::BIGINT AS x,
    list_sum(list_transform(u[1:greatest(h[1] % (n + 1), h[2] % (n + 1))], lambda x: length(x)))::BIGINT AS y,
    CASE WHEN regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 90 OR n = 0 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
placed AS (SELECT doc_id, text, n, form, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', left(text, x), '<S>', substr(text, y + 1), '<M>', substr(text, x + 1, y - x))
    ELSE concat('<S>', substr(text, y + 1), '<P>', left(text, x), '<M>', substr(text, x + 1, y - x)) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM placed
"""

ORACLES: dict[str, str] = {"op12_fill_in_middle": FILL_SQL}
