"""Mixing sources to target weights by iterative proportional fitting.

The tokens of each cell (source, language, topic) are summed over all documents; raking scales the cells until the sums by source, by
language and by topic meet the targets; a document is then kept with its cell's calibrated probability, the fitted share of the wanted
tokens over the cell's tokens. The wanted total is a share of the tokens (the queries take KEEP_SHARE): cells that would be repeated are kept in
whole, and what they lack is raked over the others, so that no single cell decides how much is kept. Without a share, the largest mix is taken
in which no cell is wanted in more than its tokens: the highest probability is 1.

The cells are a table of their own throughout, and each step of the fit is a grouped sum over it; where it has at most DRIVER_CELLS rows, it
is fitted in the driver, with the same arithmetic. Whether a document is kept follows from a hash of its id and text, so that a repeated run
keeps the same ones and the loss of a task changes nothing.

Targets are shares by value. By default a margin's targets are its token shares to the power TEMPER, which lifts small groups. Values without
a target, and targets without documents, get nothing and are left out of the sums; margins that contradict each other are met as closely
as raking does after STEPS rounds.

Defined results: null source, language or topic are values of their own; null and empty texts have no tokens and are kept with their
cell's probability; texts of any length count in whole; rows with the same id and text, nulls included, are kept or left out together; a draw
that equals the probability leaves the row out; no documents give no rows. Further columns of docs pass through, whatever their names; only
a column mix_probability gives way to the result's.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import fresh, others, unit_hash, written

MARGINS = ("source", "lang", "topic")
STEPS, TOLERANCE = 60, 1e-9
TEMPER = 0.7
#: Share of the tokens that op4 and the pipeline keep.
KEEP_SHARE = 0.5
#: Of a value's target, the least that is left to its other cells when cells that are kept in whole have reached it.
LEAST = 1e-3
DRIVER_CELLS = 200_000
_NULL = "\0null"


def token_weight(text: Column) -> Column:
    """Tokens of a text, as runs of characters between white space."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    return F.when(t == "", 0).otherwise(F.char_length(t) - F.char_length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def form_topic(text: Column) -> Column:
    """A topic by form, where documents have none: table rows, lines in capitals, short notes, articles or long reads."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    bars = n - F.char_length(F.replace(t, F.lit("|"), F.lit("")))
    capitals = F.char_length(F.regexp_replace(t, "[^A-Z]+", ""))
    return F.when(bars * 40 > n, "table").when(capitals * 3 > n, "capitals").when(n < 1_000, "note").when(n < 5_000, "article").otherwise("long")


def _value(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(_NULL))


def default_targets(cells: DataFrame, margin: str, temper: float = TEMPER) -> DataFrame:
    """value and share: the margin's token shares to a power, brought to a sum of 1."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    powered = sums.select("value", F.pow("t", F.lit(temper)).alias("p"))
    return powered.crossJoin(F.broadcast(powered.agg(F.sum("p").alias("all")))).select("value", (F.col("p") / F.col("all")).alias("share"))  # one row


def fit_in_driver(values: list[np.ndarray], tokens: np.ndarray, targets: list[dict], steps: int = STEPS) -> np.ndarray:
    """Fitted shares of cells with values[m] in margin m."""
    fitted = tokens.astype(np.float64)
    codes, goals = [], []
    for v, target in zip(values, targets, strict=True):
        names, code = np.unique(v, return_inverse=True)
        codes.append(code)
        goals.append(np.array([target.get(x, 0.0) for x in names]))
    for _ in range(steps):
        off = 0.0
        for code, goal in zip(codes, goals, strict=True):
            sums = np.bincount(code, weights=fitted, minlength=len(goal))
            there = sums > 0
            wanted = np.where(there, goal, 0.0)
            wanted = wanted / wanted.sum() if wanted.sum() else wanted
            factor = np.divide(wanted, sums, out=np.zeros_like(sums), where=there)
            off = max(off, float(np.abs(wanted - sums).max(initial=0.0)))
            fitted = fitted * factor[code]
        if off < TOLERANCE:
            break
    return fitted


def fit(cells: DataFrame, targets: dict[str, DataFrame], steps: int = STEPS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """cells(source, lang, topic, tokens) with their fitted share."""
    spark = cells.sparkSession
    margins = list(targets)
    if cells.limit(driver_cells + 1).count() <= driver_cells:
        rows = cells.where("tokens > 0").orderBy(*margins).collect()
        goals = [{r["value"]: r["share"] for r in targets[m].collect()} for m in margins]
        fitted = fit_in_driver([np.array([r[m] for r in rows], dtype=object).astype(str) for m in margins], np.array([r["tokens"] for r in rows], dtype=np.int64), goals, steps) if rows else []
        kept = [(*[r[m] for m in margins], float(x)) for r, x in zip(rows, fitted, strict=True)]
        shares = spark.createDataFrame(kept, ", ".join(f"{m} string" for m in margins) + ", share double")
        return cells.join(shares, margins, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    # Too many cells for the driver: a cell's share is its tokens times one factor for each margin. A step sums the cells' shares by a margin's
    # values and writes that margin's new factors, so the plan of a step doesn't grow.
    full = cells.where("tokens > 0")
    goals = {m: written(t.select(F.col("value").alias(m), F.col("share").alias("goal")), "targets") for m, t in targets.items()}
    factors = {m: written(full.select(m).distinct().withColumn("factor", F.lit(1.0)), "factors") for m in margins}

    def shares() -> DataFrame:
        out = full.withColumn("share", F.col("tokens").cast("double"))
        for m in margins:
            out = out.join(factors[m], m).withColumn("share", F.col("share") * F.col("factor")).drop("factor")
        return out

    for _ in range(steps):
        off = 0.0
        for m in margins:
            sums = shares().groupBy(m).agg(F.sum("share").alias("sum")).join(goals[m], m, "left")
            sums = written(sums.withColumn("goal", F.when(F.col("sum") > 0, F.coalesce("goal", F.lit(0.0))).otherwise(0.0)), "sums")
            total = sums.agg(F.sum("goal")).first()[0] or 1.0
            wanted = F.col("goal") / total
            off = max(off, sums.agg(F.max(F.abs(wanted - F.col("sum")))).first()[0] or 0.0)
            step = sums.select(m, F.when(F.col("sum") > 0, wanted / F.col("sum")).otherwise(0.0).alias("step"))
            factors[m] = written(factors[m].join(step, m).select(m, (F.col("factor") * F.col("step")).alias("factor")), "factors")
        if off < TOLERANCE:
            break
    return cells.join(shares().select(*margins, "share"), margins, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))


def bounded_in_driver(values: list[np.ndarray], tokens: np.ndarray, targets: list[dict], share: float) -> np.ndarray:
    """Probabilities of cells that keep a share of the tokens: cells that the fit wants more of than there is are kept in whole, and the rest is
    fitted again to what the targets then lack."""
    whole, full, out = share * float(tokens.sum()), np.zeros(len(tokens), dtype=bool), np.zeros(len(tokens))
    there = [sum(t.get(x, 0.0) for x in set(v)) for v, t in zip(values, targets, strict=True)]
    while not full.all():
        goals = []
        for v, target, all_there in zip(values, targets, there, strict=True):
            names, code = np.unique(v, return_inverse=True)
            taken = np.bincount(code, weights=np.where(full, tokens, 0.0), minlength=len(names))
            wanted = [target.get(x, 0.0) / (all_there or 1.0) * whole for x in names]
            goals.append({x: max(w - t, w * LEAST) for x, w, t in zip(names, wanted, taken, strict=True)})
        fitted = fit_in_driver([v[~full] for v in values], tokens[~full], goals) * (whole - float(tokens[full].sum()))
        over = fitted > tokens[~full] * (1 + TOLERANCE)
        out[~full] = fitted / tokens[~full]
        full[np.flatnonzero(~full)[over]] = True
        if not over.any():
            break
    return np.where(full, 1.0, np.minimum(out, 1.0))


def bounded(cells: DataFrame, targets: dict[str, DataFrame], share: float, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """cells(source, lang, topic, tokens) with the probability of bounded_in_driver."""
    spark, margins = cells.sparkSession, list(targets)
    keyed = ", ".join(f"{m} string" for m in margins)
    if cells.limit(driver_cells + 1).count() <= driver_cells:
        rows = cells.where("tokens > 0").orderBy(*margins).collect()
        goals = [{r["value"]: r["share"] for r in targets[m].collect()} for m in margins]
        values = [np.array([r[m] for r in rows], dtype=object).astype(str) for m in margins]
        found = bounded_in_driver(values, np.array([r["tokens"] for r in rows], dtype=np.int64), goals, share) if rows else []
        kept = [(*[r[m] for m in margins], float(x)) for r, x in zip(rows, found, strict=True)]
        return cells.join(spark.createDataFrame(kept, f"{keyed}, probability double"), margins, "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    state = written(cells.where("tokens > 0").withColumn("full", F.lit(False)), "bounded")
    goals = {}
    for m, t in targets.items():
        there = written(t.join(state.select(F.col(m).alias("value")).distinct(), "value", "left_semi"), "targets")
        all_there = there.agg(F.sum("share")).first()[0] or 1.0
        goals[m] = there.select("value", (F.col("share") / all_there).alias("share"))
    whole = share * (state.agg(F.sum("tokens")).first()[0] or 0)
    while True:
        rest = whole - (state.where("full").agg(F.sum("tokens")).first()[0] or 0)
        left = {}
        for m, goal in goals.items():
            taken = state.where("full").groupBy(F.col(m).alias("value")).agg(F.sum("tokens").alias("taken"))
            wanted = F.col("share") * whole
            left[m] = goal.join(taken, "value", "left").select("value", F.greatest(wanted - F.coalesce("taken", F.lit(0)), wanted * LEAST).alias("share"))
        free = fit(state.where("not full").select(*margins, "tokens"), left, driver_cells=driver_cells).withColumn("probability", F.col("share") * rest / F.col("tokens"))
        free = written(free.select(*margins, "tokens", "probability", (F.col("probability") > 1 + TOLERANCE).alias("full")), "bounded")
        whole_cells = state.where("full").select(*margins, "tokens", F.lit(1.0).alias("probability"), "full")
        state = written(whole_cells.unionByName(free), "bounded")
        if not free.where("full").limit(1).count() or not state.where("not full").limit(1).count():
            break
    found = state.select(*margins, F.least("probability", F.lit(1.0)).alias("probability"))
    return cells.join(found, margins, "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, share: float | None = None, temper: float = TEMPER, seed: int = 4) -> DataFrame:
    """docs that are kept, with their probability in column mix_probability.

    targets: value and share by margin; topic: a document's topic (by default its form, by form_topic); share: the wanted tokens
    over all tokens (by default as many as the cell that is wanted most allows; one rare cell can make that little).
    """
    topic = form_topic(F.col("text")) if topic is None else topic
    keys = dict(zip(MARGINS, (_value(F.col("source")), _value(F.col("lang")), _value(topic)), strict=True))
    cells = written(docs.select(*[k.alias(m) for m, k in keys.items()], token_weight(F.col("text")).alias("t")).groupBy(*MARGINS).agg(F.sum("t").alias("tokens")), "cells")
    targets = {m: (targets or {}).get(m, default_targets(cells, m, temper)) for m in MARGINS}
    if share is None:
        fitted = written(fit(cells, targets), "mix")
        lift = F.try_divide(F.col("share"), F.col("tokens"))
        top = fitted.agg(F.max(lift)).first()[0]
        fitted = fitted.withColumn("probability", F.coalesce(lift, F.lit(0.0)) * (1.0 / top if top else 0.0))
    else:
        fitted = written(bounded(cells, targets, share), "mix")
    of, draw = {m: fresh(docs, f"cell_{m}") for m in MARGINS}, fresh(docs, "draw")
    # Cells without tokens hold empty texts alone: all are kept.
    cell = fitted.select(*[F.col(m).alias(of[m]) for m in MARGINS], F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("probability"))).otherwise(1.0).alias("mix_probability"))
    drawn = unit_hash(F.coalesce(F.col("doc_id"), F.lit(-1)), F.coalesce(F.col("text"), F.lit("")), seed=seed).alias(draw)
    placed = docs.select(*others(docs, "mix_probability"), drawn, *[k.alias(of[m]) for m, k in keys.items()])
    small = cells.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS
    joined = placed.join(F.broadcast(cell) if small else cell, list(of.values()))  # broadcast only when counted to be small
    return joined.where(F.col(draw) < F.col("mix_probability")).select(*others(docs, "mix_probability"), "mix_probability")


def margins(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """Token shares of docs by margin and value, to hold against the targets."""
    topic = form_topic(F.col("text")) if topic is None else topic
    rows = docs.select(_value(F.col("source")).alias("source"), _value(F.col("lang")).alias("lang"), _value(topic).alias("topic"), token_weight(F.col("text")).alias("t"))
    parts = [rows.groupBy(F.col(m).alias("value")).agg(F.sum("t").alias("tokens")).select(F.lit(m).alias("margin"), "value", "tokens") for m in MARGINS]
    return reduce(DataFrame.unionByName, parts)
