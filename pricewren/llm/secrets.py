"""Secret scans with DataFrame functions alone.

Base findings are those of three patterns. Besides, strings of at least SHORTEST characters of CHARACTERS are scored by two character Markov
models (of the first order), one of random strings and one of ordinary identifiers, words and numbers: a string whose log-likelihood ratio
is at least LEAST_RATIO in all and LEAST_MEAN for each character is a finding of kind `random`, unless it overlaps a base finding.

The models are trained from labelled samples (token, secret): by default, random strings in several alphabets made from a hash, against
words, names joined from them, and numbers, of at most SAMPLE_TEXTS texts chosen by a hash of the text.

Offsets count code points; ends are exclusive. Defined results: null and empty texts have no findings; equal findings of different kinds
all stay, in the order of KINDS; without training samples of both kinds nothing is added to the base findings; a ratio that equals a bound is
a finding; repeated rows are scanned each and train once; texts of any length are scanned in whole, in time that grows with their length (and,
for texts with both, with the base findings times the further ones); no documents give no rows. Further columns pass through, whatever their
names; only a column found gives way to the result's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.llm.common import fresh, others, unit_hash

# The patterns of the base findings and their order.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"  # the whole run, of 16 characters or more
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SHORTEST, LEAST_RATIO, LEAST_MEAN = 16, 14.0, 0.45
#: Bound of the texts that ordinary strings are taken from, and the number of random strings.
SAMPLE_TEXTS, RANDOM_STRINGS = 1_000, 6_000
_CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % SHORTEST
_SPAN = "struct<start:int,end:int,kind:int>"
#: Matches whose places are summed up at a time, and characters in a piece of a text that is redacted.
CHUNK, PIECE = 128, 4096


def _let(value: Column, of) -> Column:
    """of(value), where value is worked out once however often `of` names it."""
    return F.transform(F.array(value), of)[0]


def _running(items: Column, kind: str, step, moved, after) -> Column:
    """A running fold over an array: at, where it ends, and found, what its steps found, of type array<kind>.

    It runs over chunks of CHUNK items, each from at = 0 by step(acc, item); then moved(found, at) says what a finding of a chunk is when the fold
    stood at `at` before the chunk, and after(at, end) where it stands behind it. So a step copies few of the findings before it.
    """
    none = F.array().cast(f"array<{kind}>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("found"))
    chunks = lambda all_: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(all_) - 1).cast("int")), F.lit(CHUNK)), lambda i: F.slice(all_, i + 1, F.lit(CHUNK)))
    folded = _let(items, lambda all_: F.transform(chunks(all_), lambda chunk: F.aggregate(chunk, zero, step)))
    outer = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("found"))

    def join(acc: Column, chunk: Column) -> Column:
        return F.struct(after(acc["at"], chunk["at"]).alias("at"), F.concat(acc["found"], F.array(F.transform(chunk["found"], lambda s: moved(s, acc["at"])))).alias("found"))

    return F.aggregate(folded, outer, join, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["found"]).alias("found")))


def _spans(text: Column, pattern: str, kind: int, value: int | None = None, at_least: int = 0, keep=None) -> Column:
    """The places of all matches of a pattern, leftmost first and not overlapping; value is the group whose length must be at_least.

    The pieces between the matches and the matches themselves alternate, so their lengths add up to the offsets.
    """
    p = F.lit(pattern)
    matches = F.regexp_extract_all(text, p, F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("hit"), (F.regexp_extract_all(text, p, F.lit(value)) if value else matches).alias("value"))
    span = lambda start, end: F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.char_length(part["gap"])
        end = start + F.char_length(part["hit"])
        good = part["hit"].isNotNull() & (F.char_length(part["value"]) >= at_least)
        if keep is not None:
            good &= keep(part["hit"])
        return F.struct(F.coalesce(end, start).alias("at"), F.when(good, F.concat(acc["found"], F.array(span(start, end)))).otherwise(acc["found"]).alias("found"))

    found = _running(parts, _SPAN, step, lambda s, at: span(s["start"] + at, s["end"] + at), lambda at, end: at + end)["found"]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def base_spans(text: Column) -> list[Column]:
    return [_spans(text, ASSIGN, 0, value=2, at_least=8), _spans(text, ACCESS, 1), _spans(text, HEX, 2)]


def _transitions(tokens: DataFrame) -> DataFrame:
    """Numbers of neighbouring characters by label, of tokens(token, secret)."""
    at = F.explode(F.sequence(F.lit(1), F.char_length("token") - 1)).alias("at")
    pairs = tokens.where(F.char_length("token") >= 2).select("token", "secret", at)
    return pairs.select("secret", F.substring("token", F.col("at"), F.lit(1)).alias("a"), F.substring("token", F.col("at") + 1, F.lit(1)).alias("b")).groupBy("secret", "a", "b").agg(F.count("*").alias("n"))


def train(tokens: DataFrame) -> list[float] | None:
    """For each two characters of CHARACTERS, the logarithm of the ratio of the two models' transition probabilities; tokens(token, secret)."""
    size = len(CHARACTERS)
    counts = {True: [[0.5] * size for _ in CHARACTERS], False: [[0.5] * size for _ in CHARACTERS]}
    seen = set()
    for r in _transitions(tokens).collect():  # at most 2 * size ** 2 rows that count
        a, b = CHARACTERS.find(r["a"]), CHARACTERS.find(r["b"])
        if a >= 0 and b >= 0:
            counts[bool(r["secret"])][a][b] += r["n"]
            seen.add(bool(r["secret"]))
    if len(seen) < 2:
        return None
    share = {k: [[n / sum(row) for n in row] for row in m] for k, m in counts.items()}
    return [math.log(share[True][a][b] / share[False][a][b]) for a in range(size) for b in range(size)]


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled samples of random strings, a fixed function of their number: hex, Base64, and letters with digits."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest("b")))
    kinds = [F.substring(digest("a"), 1, 40), F.substring(base64, 1, 40), F.upper(F.substring(F.regexp_replace(base64, "[+/=]", ""), 1, 20)), F.substring(F.regexp_replace(base64, "[+/=]", ""), 5, 32)]
    token = F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int"))
    return spark.range(n).select(token.alias("token"), F.lit(True).alias("secret"))


def ordinary_strings(docs: DataFrame, texts: int = SAMPLE_TEXTS, seed: int = 5) -> DataFrame:
    """Labelled samples of ordinary strings from some texts: words, names joined from neighbouring words, and numbers.

    A text is taken by a hash of it, with a probability that makes about `texts` of them, so the same texts are taken however the rows lie;
    copies count once. Strings of the base patterns are blanked out before.
    """
    total = docs.count()
    picked = docs.where(F.col("text").isNotNull() & (unit_hash(F.col("text"), seed=seed) < min(1.0, texts / max(1, total)))).select("text").distinct()
    bare = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        bare = F.regexp_replace(bare, pattern, " ")
    some = picked.select(bare.alias("text"))
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}|[0-9]{2,}"), F.lit(0))).alias("token"))
    joined = some.select(F.explode(F.regexp_extract_all(F.regexp_replace("text", "([A-Za-z]{2,})[^A-Za-z]+", "$1_"), F.lit("[A-Za-z]{2,}_[A-Za-z]{2,}"), F.lit(0))).alias("token"))
    camel = joined.select(F.regexp_replace(F.initcap(F.regexp_replace("token", "_", " ")), " ", "").alias("token"))
    return words.unionByName(joined).unionByName(camel).select("token", F.lit(False).alias("secret"))


def log_ratio(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a token under the two models."""
    table = F.array(*[F.lit(round(x, 6)) for x in model])
    code = lambda c: F.instr(F.lit(CHARACTERS), c) - 1
    zero = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        more = F.when(acc["before"] >= 0, F.element_at(table, acc["before"] * len(CHARACTERS) + code(c) + 1)).otherwise(0.0)
        return F.struct(code(c).alias("before"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(F.split(token, ""), zero, step, lambda acc: acc["sum"])


def scan(docs: DataFrame, model: list[float] | None) -> DataFrame:
    """docs with a column found: all findings (start, end, kind as a number) in order, base findings first among equals. A column of that name
    in docs gives way."""
    text = F.coalesce("text", F.lit(""))
    columns = others(docs, "found")
    base, more = fresh(docs, "base"), fresh(docs, "more")
    out = docs.select(*columns, F.concat(*base_spans(text)).alias(base))
    if model:

        def random(hit: Column) -> Column:
            return _let(log_ratio(hit, model), lambda ratio: (ratio >= LEAST_RATIO) & (ratio >= LEAST_MEAN * F.char_length(hit)))

        out = out.select(*columns, base, _spans(text, _CANDIDATE, 3, keep=random).alias(more))
        free = F.filter(more, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        found = F.concat(base, F.when(F.size(base) == 0, F.col(more)).otherwise(free))
    else:
        found = F.col(base)
    order = lambda x, y: F.when((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["kind"] < y["kind"])), -1).when((x["start"] == y["start"]) & (x["kind"] == y["kind"]), 0).otherwise(1)
    return out.select(*columns, F.array_sort(found, order).alias("found"))


def as_text(found: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each finding, overlapping ones together, replaced by the mark; findings come in order of their starts.

    For each finding, `since` is the furthest end before it: where that lies behind its start, it belongs to a mark that stands already. The text is
    cut into pieces of PIECE characters once, and what stands between two marks is taken out of the pieces that it touches.
    """
    kind = "struct<since:int,start:int,end:int>"
    part = lambda since, s: F.struct(since.alias("since"), s["start"].alias("start"), s["end"].alias("end"))
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["found"], F.array(part(acc["at"], s))).alias("found"))
    run = _running(found, kind, step, lambda s, at: part(F.greatest(s["since"], at), s), lambda at, end: F.greatest(at, end))

    def between(pieces: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        touched = F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(touched, ""), start - first * PIECE + 1, F.greatest(F.lit(0), end - start))

    def whole(pieces: Column) -> Column:
        kept = lambda r: F.transform(r["found"], lambda s: F.when(s["start"] >= s["since"], F.concat(between(pieces, s["since"], s["start"]), F.lit(mark))).otherwise(""))
        return _let(run, lambda r: F.concat(F.array_join(kept(r), ""), between(pieces, r["at"], F.char_length(text))))

    return F.when(F.size(found) > 0, _let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)), whole)).otherwise(text)
