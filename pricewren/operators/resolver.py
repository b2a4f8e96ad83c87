"""The last rung of matching: pairs that evidence leaves open are answered from a cache, else by a resolver, within each owner's quota.

The resolver is an argument, a function from a table of questions to answers (fingerprint, relation, confidence, reason): a model behind mapInPandas, a service, or column expressions. It is asked once for
each fingerprint, whatever number of pairs share it, and its answers are what the cache takes in. What it says may raise a confidence, but not above what a
checked identifier gives, and it never overturns a conflict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewren.functions import text
from pricewren.shared import written
from pricewren.sources import keyed

# The highest confidence that an answer gives, the highest after a denial (of the same family, of any other), and open candidates that a query may ask about.
HIGHEST, FAMILY, DENIED, MOST = 0.94, 0.6, 0.5, 12
POSITIVE = ("same_product", "compatible")
ANSWER = "fingerprint string, is_same boolean, confidence double, reason string, model string"
Resolver = Callable[[DataFrame], DataFrame]


def questions(pairs: DataFrame, model: str, most: int = MOST) -> DataFrame:
    """The strongest open pairs of each query, with place (from 1) and fingerprint. A pair is owner, query_id, query, candidate_id, candidate, relation, confidence and needs_review."""
    order = Window.partitionBy("owner", "query_id").orderBy(F.desc_nulls_last("confidence"), "candidate_id")
    rows = pairs.where("needs_review AND relation <> 'conflict'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return rows.withColumn("fingerprint", text.fingerprint(F.coalesce("query", F.lit("")), F.coalesce("candidate", F.lit("")), F.lit(model)))


def admitted(misses: DataFrame, quota: DataFrame) -> DataFrame:
    """misses with whether the owner's quota (owner, remaining; none is 0) covers them: queries in order of their number, candidates in order of place. A window runs
    over an owner's queries, a row for each, not over the pairs."""
    here = Window.partitionBy("owner", "query_id").orderBy("place")
    rows = misses.withColumn("nth", F.row_number().over(here))
    before = Window.partitionBy("owner").orderBy("query_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("owner", "query_id").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rows = rows.join(sums, ["owner", "query_id"]).join(quota.select("owner", "remaining"), "owner", "left")
    return rows.withColumn("admitted", F.col("before") + F.col("nth") <= F.coalesce("remaining", F.lit(0))).drop("nth", "before", "remaining")


def clamped(said: Column, confidence: Column, answer: Column) -> Column:
    """The confidence after an answer of this relation and confidence."""
    raised = F.least(F.lit(HIGHEST), F.greatest(confidence, answer))
    return F.when(said.isin(*POSITIVE), raised).otherwise(F.least(confidence, F.when(said == "same_family", FAMILY).otherwise(DENIED)))


def resolve(pairs: DataFrame, cache: DataFrame, quota: DataFrame, resolver: Resolver, model: str, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(pairs with relation and confidence after the answers, method ('ai' where there is one) and answered: cache, resolver, quota where that was used up,
    silent where the resolver gave no answer, null where nothing was asked; new rows of the cache).

    cache holds ANSWER. owner, query_id and candidate_id name a pair, no part of it is null; a repeated pair is a pair of its own and shares the answer. Pairs that aren't open come out as they were.
    """
    asked = questions(pairs, model, most).select("owner", "query_id", "candidate_id", "query", "candidate", "place", "fingerprint").dropDuplicates(["owner", "query_id", "candidate_id"])
    known = cache.select("fingerprint", F.struct(F.when(F.col("is_same"), "same_product").otherwise("possible").alias("said"), F.col("confidence").alias("answer")).alias("known"))
    met = written(asked.join(known, "fingerprint", "left"), "asked")
    due = written(admitted(met.where("known IS NULL").drop("known"), quota), "due")
    unique = due.where("admitted").select("fingerprint", "query", "candidate").dropDuplicates(["fingerprint"])
    answers = written(resolver(unique).select("fingerprint", "relation", "confidence", "reason").dropDuplicates(["fingerprint"]), "answers")
    fresh = due.join(answers.select("fingerprint", F.struct(F.col("relation").alias("said"), F.col("confidence").alias("answer")).alias("fresh")), "fingerprint", "left")
    fresh = fresh.select("owner", "query_id", "candidate_id", F.when(F.col("admitted"), F.col("fresh")).alias("a"), F.when(~F.col("admitted"), "quota").when(F.col("fresh").isNull(), "silent").otherwise("resolver").alias("answered"))
    held = met.where("known IS NOT NULL").select("owner", "query_id", "candidate_id", F.col("known").alias("a"), F.lit("cache").alias("answered"))
    rows = pairs.join(held.unionByName(fresh), ["owner", "query_id", "candidate_id"], "left")
    said, there = F.col("a.said"), F.col("a").isNotNull()
    rows = rows.withColumns({
        "method": F.when(there, "ai").otherwise(F.col("method") if "method" in pairs.columns else F.lit(None).cast("string")),
        "confidence": F.when(there, clamped(said, F.col("confidence"), F.col("a.answer"))).otherwise(F.col("confidence")),
        "relation": F.when(there & (said != "possible"), said).otherwise(F.col("relation")),
    }).drop("a")
    new = answers.select("fingerprint", (F.col("relation") == "same_product").alias("is_same"), "confidence", "reason", F.lit(model).alias("model"))
    return rows, new


def remember(folder: str, answers: DataFrame, batch: int) -> bool:
    """Write answers to a cache that is a keyed table, each batch once; whether it was new."""
    return keyed.put(answers.sparkSession, folder, answers, ANSWER, ("fingerprint",), batch)
