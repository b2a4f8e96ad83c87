"""Joins of texts: similar names by weighted tokens, words one edit apart, price rows by shared tokens, paths under the longest rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewren.functions.text import normalise_text, one_edit_apart, similarity, token_weight, tokens


def similar_names(names: DataFrame, least: float = 0.6, key: str = "id", name: str = "name") -> DataFrame:
    """Pairs (a < b) of names whose weighted Jaccard similarity is at least `least`.

    Names meet at tokens of their prefix: their rarest tokens, until the weight of the others can't make a pair any more. Two names that are similar
    enough share one of these, so no pair is lost, and common words are met at only by names that have hardly any other.
    """
    rows = names.select(F.col(key).alias("id"), tokens(normalise_text(F.col(name))).alias("tokens")).where(F.size("tokens") > 0)
    each = rows.select("id", F.explode("tokens").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("names"))
    ordered = each.join(common, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("names", "token"))).alias("t"), F.sum(token_weight(F.col("token"))).alias("weight"))
    # A token belongs to the prefix while it and those behind it weigh as much as the least overlap; similarities are rounded to three decimals.
    need = F.col("weight") * (least - 0.0005) - 1e-9
    zero = F.struct(F.col("weight").alias("left"), F.array().cast("array<string>").alias("prefix"))
    step = lambda acc, t: F.struct((acc["left"] - token_weight(t["token"])).alias("left"), F.when(acc["left"] >= need, F.array_append(acc["prefix"], t["token"])).otherwise(acc["prefix"]).alias("prefix"))
    at = ordered.select("id", F.explode(F.aggregate("t", zero, step, lambda acc: acc["prefix"])).alias("token"))
    met = at.alias("a").join(at.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    sides = [rows.select(F.col("id").alias(c), F.col("tokens").alias(f"{c}_tokens")) for c in "ab"]
    pairs = met.join(sides[0], "a").join(sides[1], "b").select("a", "b", similarity(F.col("a_tokens"), F.col("b_tokens")).alias("similarity"))
    return pairs.where(F.col("similarity") >= least)


def corrections(words: DataFrame, known: DataFrame, word: str = "word") -> DataFrame:
    """For each word that is not known, the known words one edit away (insertion, deletion, replacement or swap of neighbours).

    Words of five letters or more without digits. Two such words share a form with at most one letter left out, or are each other's with one
    letter replaced, which leaving out that letter shows as well: an equi-join on these forms finds all pairs.
    """
    fit = lambda c: (F.char_length(c) >= 5) & ~F.col(c).rlike("[0-9]")
    cut = lambda c: F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.char_length(c))))
    forms = lambda df, c: df.select(c, F.explode(F.array_distinct(F.array_prepend(cut(c), F.col(c)))).alias("form"))
    ask = words.select(F.lower(word).alias("word")).where(fit("word")).distinct()
    have = known.select(F.lower(word).alias("known")).where(fit("known")).distinct()
    open_ = ask.join(have.withColumnRenamed("known", "word"), "word", "left_anti")
    pairs = forms(open_, "word").join(forms(have, "known"), "form").select("word", "known").distinct()
    return pairs.where(one_edit_apart(F.col("word"), F.col("known")))


def price_search(queries: DataFrame, prices: DataFrame, top: int = 8) -> DataFrame:
    """queries(query) with the `top` price names that share most of their tokens; ties go by name."""
    ask = queries.select("query", F.explode(tokens(normalise_text(F.col("query")))).alias("token"))
    have = prices.select("name", F.explode(tokens(normalise_text(F.col("name")))).alias("token"))
    shared = ask.join(have, "token").groupBy("query", "name").agg(F.count("*").alias("shared"))
    order = Window.partitionBy("query").orderBy(F.desc("shared"), "name")
    return shared.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(host, path) with whether rules(host, allow, prefix) let a robot read them: the longest prefix decides, allow wins ties, without a
    rule it is allowed. An equi-join on the host and on each prefix of the path that has a rule's length."""
    lengths = rules.where(F.col("prefix") != "").groupBy("host").agg(F.collect_set(F.char_length("prefix")).alias("lengths"))
    asked = urls.select("host", "path").distinct().join(lengths, "host")
    cut = asked.select("host", "path", F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))).alias("n")).withColumn("prefix", F.substring(F.col("path"), F.lit(1), F.col("n")))
    best = cut.join(rules, ["host", "prefix"]).groupBy("host", "path").agg(F.max(F.struct("n", "allow")).getField("allow").alias("allow"))
    return urls.join(best, ["host", "path"], "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")
