"""Statistics of signs in context, and the readings of signs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tellstone.constants import RULE_TEMPLATES

UNSEEN_RANK = 999
ALPHA = 0.1


def token_totals(tokens: DataFrame) -> DataFrame:
    """token, n, freq_rank of an array column ``tokens``; equal counts share a rank and leave a gap."""
    counts = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # ranks come from the number of tokens at each count: one row a count, far fewer than tokens
    steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    ranks = steps.select("n", (F.coalesce(F.sum("k").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).alias("freq_rank"))
    return counts.join(ranks, "n").select("token", "n", "freq_rank")


def window_pairs(tokens: DataFrame, reach: int) -> DataFrame:
    """token, context, n: how often a token stands within ``reach`` places of another place with the context.

    Each pair of places is made once, from the array and the array moved on, and counted in both directions.
    """
    toks, size = F.col("tokens"), F.size("tokens")
    moved = [
        F.when(size > d, F.arrays_zip(F.slice(toks, F.lit(1), size - d).alias("a"), F.slice(toks, F.lit(1 + d), size - d).alias("b"))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))
        for d in range(1, reach + 1)
    ]
    pairs = tokens.select(F.explode(F.concat(*moved)).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.groupBy(F.col("a").alias("token"), F.col("b").alias("context")).agg(F.sum("n").alias("n"))


def context_rules(tokens: DataFrame, reach: int = 3, most: int = 10, least: float = 0.01) -> DataFrame:
    """For each token its most probable contexts, P(context | token) = n(token, context) / n(token), above ``least``.

    A token sees up to 2 reach neighbours, so the probabilities of one token may add up to more than 1.
    """
    totals = token_totals(tokens).select("token", F.col("n").alias("n_token"))
    probs = window_pairs(tokens, reach).join(totals, "token").withColumn("probability", F.col("n") / F.col("n_token")).where(F.col("probability") > least)
    place = F.row_number().over(W.partitionBy("token").orderBy(F.desc("probability"), "context"))
    ranked = probs.withColumn("place", place).where(F.col("place") <= most)
    pattern = F.concat_ws(".", F.least("token", "context"), F.greatest("token", "context"))
    return ranked.select("token", "context", pattern.alias("pattern"), F.round("probability", 4).alias("probability"), "place")


def sign_catalog(knowledge: DataFrame, totals: DataFrame) -> DataFrame:
    """Known and observed signs together: counts, rank (999 if unseen), readings with the sign itself as default."""
    known = knowledge.select(F.col("sign_id").alias("token"), "unicode", "borger_number", "sumerian_readings", "akkadian_readings", "logographic_values")
    both = known.join(totals, "token", "full_outer")
    default = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, c).otherwise(F.array(F.lower("token")))
    return both.select(
        F.col("token").alias("sign_id"), "unicode", "borger_number", F.coalesce("n", F.lit(0)).alias("corpus_frequency"),
        F.coalesce("freq_rank", F.lit(UNSEEN_RANK)).alias("frequency_rank"), default(F.col("sumerian_readings")).alias("sumerian"),
        default(F.col("akkadian_readings")).alias("akkadian"), F.coalesce("logographic_values", F.array().cast("array<string>")).alias("logographic"), F.col("n").isNotNull().alias("observed"),
    )


def rules_of_signs(signs: DataFrame) -> DataFrame:
    """Rule templates whose pattern holds the sign, with their priority; the templates are part of the expression."""
    rules = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(r).alias("reading"), F.lit(k).alias("priority")) for p, r, _, k in RULE_TEMPLATES])
    matching = F.filter(rules, lambda r: F.contains(r["pattern"], F.col("sign_id")))
    return signs.select("sign_id", F.explode(matching).alias("r")).select("sign_id", "r.pattern", "r.reading", "r.priority")


def contextual_readings(signs: DataFrame, context: str) -> DataFrame:
    """Readings of rules that hold in the context: templates as patterns, over the context as given and joined by stops."""
    rules = rules_of_signs(signs)
    dotted = F.lit(".".join(context.split()))
    return rules.where(F.lit(context).rlike(F.col("pattern")) | dotted.rlike(F.col("pattern")) if context else F.lit(False))


def reading_posteriors(knowledge: DataFrame, totals: DataFrame, pairs: DataFrame, context: list[str], most: int = 5, alpha: float = ALPHA, uniform: bool = False) -> DataFrame:
    """For each sign its most probable readings in a context of tokens.

    Readings are SUM:, AKK: and LOG: entries, equal ones once, with equal priors. The likelihood is
    the geometric mean over the context of (n(reading, c) + alpha) / (n(reading) + alpha V), V the
    number of different tokens; a reading counts as the token it is written as. Posteriors of a
    sign add up to 1. ``uniform`` leaves the likelihood out. Signs without readings have no rows.
    """
    kinds = (("SUM", "sumerian_readings"), ("AKK", "akkadian_readings"), ("LOG", "logographic_values"))
    tagged = lambda k, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda r: F.concat(F.lit(f"{k}:"), r))
    entries = F.concat(*[tagged(k, c) for k, c in kinds])
    readings = knowledge.select("sign_id", F.explode(F.array_distinct(entries)).alias("reading"))
    readings = readings.withColumn("token", F.upper(F.regexp_replace(F.substring_index("reading", ":", -1), r"[0-9₀-₉]+$", "")))
    size = totals.agg(F.count(F.lit(1)).alias("v"))
    n_of = readings.join(totals.select("token", "n"), "token", "left").crossJoin(F.broadcast(size))  # one row
    wanted = sorted(set(context))
    seen = pairs.where(F.col("context").isin(wanted)).groupBy("token").pivot("context", wanted).agg(F.sum("n"))
    joined = n_of.join(seen, "token", "left")
    logs = [F.log((F.coalesce(F.col(f"`{c}`"), F.lit(0)) + alpha) / (F.coalesce("n", F.lit(0)) + alpha * F.col("v"))) for c in context]
    weight = F.lit(1.0) if uniform or not context else F.exp(sum(logs[1:], logs[0]) / len(logs))
    of_sign = W.partitionBy("sign_id")
    scored = joined.select("sign_id", "reading", weight.alias("w")).withColumn("posterior", F.col("w") / F.sum("w").over(of_sign))
    place = F.row_number().over(of_sign.orderBy(F.desc(F.round("posterior", 9)), "reading"))
    return scored.withColumn("place", place).where(F.col("place") <= most).select("sign_id", "reading", F.round("posterior", 6).alias("posterior"), "place")


def context_windows(tokens: DataFrame, key: str, around: int = 2, wide: int = 5) -> DataFrame:
    """For each place its token, the window around it with itself (joined), and the wider context without it."""
    toks = F.col("tokens")
    places = tokens.select(key, "tokens", F.posexplode("tokens").alias("pos", "token"))
    begin = lambda k: F.greatest(F.col("pos") + 1 - k, F.lit(1))
    left = F.slice(toks, begin(wide), F.col("pos") + 1 - begin(wide))
    right = F.slice(toks, F.col("pos") + 2, F.lit(wide))
    window = F.array_join(F.slice(toks, begin(around), F.col("pos") + 2 + around - begin(around)), " ")
    return places.select(key, "pos", "token", window.alias("window"), F.array_join(F.concat(left, right), " ").alias("context"))
