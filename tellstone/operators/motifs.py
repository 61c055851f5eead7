"""Motifs in texts, profiles of texts and distances between them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellstone.constants import HYBRID_WEIGHTS, MOTIFS, PRESENT

CONTEXT_CHARS = 100


def _pattern(pattern: str) -> str:
    """The pattern for lower-cased text within the JVM: word boundaries hold for letters of every script."""
    parts = pattern.lower().split(r"\b")
    return parts[0] if len(parts) == 1 else r"(?<![\p{L}\p{N}_])" + parts[1] + r"(?![\p{L}\p{N}_])" + r"\b".join(parts[2:])


def full_text(*columns: str) -> Column:
    """Columns in lower case, with a blank between each two; null counts as empty."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    return F.lower(F.concat(*[x for p in parts for x in (F.lit(" "), p)][1:]))


def motif_matches(texts: DataFrame) -> DataFrame:
    """text_id, motif_id, archetype, n, confidence of ``texts`` (text_id, full): matches of each motif, and the best confidence.

    The 26 patterns are part of the expression; no join is needed. A match of n characters has
    confidence 0.7 + 0.3 min(1, n / 20).
    """
    found = F.array(*[F.struct(F.lit(m).alias("motif_id"), F.lit(a).alias("archetype"), F.transform(F.regexp_extract_all("full", F.lit(_pattern(p)), F.lit(0)), F.length).alias("lengths")) for m, a, p in MOTIFS])
    rows = texts.select("text_id", F.explode(F.filter(found, lambda x: F.size(x["lengths"]) > 0)).alias("m"))
    confidence = 0.7 + 0.3 * F.least(F.lit(1.0), F.array_max("m.lengths") / 20.0)
    return rows.select("text_id", "m.motif_id", "m.archetype", F.size("m.lengths").alias("n"), confidence.alias("confidence"))


def motif_instances(texts: DataFrame) -> DataFrame:
    """Every match with its place (in characters), text, confidence and context, numbered within its text.

    Places need the matcher itself, so texts go to Python in Arrow batches.
    """
    compiled = [(m, re.compile(p, re.IGNORECASE)) for m, _, p in MOTIFS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text_id, full in zip(batch["text_id"], batch["full"]):
                number = 0
                for motif, pattern in compiled:
                    for m in pattern.finditer(full or ""):
                        around = full[max(0, m.start() - CONTEXT_CHARS) : m.end() + CONTEXT_CHARS].strip()
                        rows.append((f"MOTINST-{text_id}-{number:03d}", motif, text_id, m.start(), m.group(), 0.7 + 0.3 * min(1.0, len(m.group()) / 20.0), around))
                        number += 1
            yield pd.DataFrame(rows, columns=["id", "motif_id", "text_id", "position", "matched_text", "confidence", "context"])

    return texts.select("text_id", "full").mapInPandas(run, "id string, motif_id string, text_id string, position int, matched_text string, confidence double, context string")


def motif_profiles(matches: DataFrame, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Different profiles (profile, entries: motifs with their confidence, n_texts) and members (text_id, profile).

    Texts with the same motifs at the same confidence are one profile; its name is a hash of it. With ``texts`` (text_id), those
    without any motif have the empty profile.
    """
    entries = F.array_sort(F.collect_list(F.struct("motif_id", F.round("confidence", 6).alias("confidence"))))  # at most 26 a text
    per_text = matches.groupBy("text_id").agg(entries.alias("entries"))
    if texts is not None:
        none = F.array().cast("array<struct<motif_id:string,confidence:double>>")
        per_text = texts.select("text_id").join(per_text, "text_id", "left").withColumn("entries", F.coalesce("entries", none))
    per_text = per_text.withColumn("profile", F.substring(F.md5(F.to_json("entries")), 1, 12))
    profiles = per_text.groupBy("profile").agg(F.any_value("entries").alias("entries"), F.count(F.lit(1)).alias("n_texts"))
    return profiles, per_text.select("text_id", "profile")


def profile_distances(profiles: DataFrame) -> DataFrame:
    """profile_1 <= profile_2 with the cosine, Jaccard and hybrid distance of their texts, and the number of pairs of texts.

    Products come from an inverted index of motifs over different profiles that share one, not from a grid of texts. Pairs
    within a profile stand in a row of its own, at distance 0; texts without motifs have cosine distance 1 and Jaccard distance 0 from each other. All other pairs
    share nothing and have distance 1 in each: they are one row without names, with their number. Motifs above PRESENT count for Jaccard.
    """
    sized = profiles.select("profile", "entries", F.col("n_texts").cast("long").alias("n_texts"))
    long = sized.select("profile", F.explode("entries").alias("e")).select("profile", "e.motif_id", "e.confidence")
    norms = long.groupBy("profile").agg(F.sqrt(F.sum(F.col("confidence") * F.col("confidence"))).alias("norm"), F.count_if(F.col("confidence") > PRESENT).alias("size")).join(sized.select("profile", "n_texts"), "profile")
    a, b = (long.select(F.col("profile").alias(f"profile_{i}"), "motif_id", F.col("confidence").alias(f"c{i}")) for i in (1, 2))
    both = a.join(b, "motif_id").where("profile_1 < profile_2").groupBy("profile_1", "profile_2").agg(F.sum(F.col("c1") * F.col("c2")).alias("dot"), F.count_if((F.col("c1") > PRESENT) & (F.col("c2") > PRESENT)).alias("n_shared"))
    for i in (1, 2):
        both = both.join(norms.select(F.col("profile").alias(f"profile_{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("norm", "size", "n_texts")]), f"profile_{i}")
    cosine = F.coalesce(1 - F.try_divide(F.col("dot"), F.col("norm1") * F.col("norm2")), F.lit(1.0))
    union = F.col("size1") + F.col("size2") - F.col("n_shared")
    jaccard = F.when(union == 0, 0.0).otherwise(1 - F.col("n_shared") / union)
    wc, wj = HYBRID_WEIGHTS
    measured = lambda df, c, j: df.select(
        "profile_1", "profile_2", "n_shared", F.round(c, 6).alias("cosine_distance"), F.round(j, 6).alias("jaccard_distance"), F.round(wc * c + wj * j, 6).alias("hybrid_distance"), "n_pairs"
    )
    between = measured(both.withColumn("n_pairs", F.col("n_texts1") * F.col("n_texts2")), cosine, jaccard)
    present = F.size(F.filter("entries", lambda e: e["confidence"] > PRESENT)).cast("long")
    same = sized.where("n_texts > 1").select(F.col("profile").alias("profile_1"), F.col("profile").alias("profile_2"), present.alias("n_shared"), F.floor(F.col("n_texts") * (F.col("n_texts") - 1) / 2).alias("n_pairs"), (F.size("entries") == 0).cast("double").alias("apart"))
    within = measured(same, F.col("apart"), F.lit(0.0))
    listed = between.unionByName(within)
    n = sized.agg(F.coalesce(F.sum("n_texts"), F.lit(0)).alias("n"))
    rest = listed.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("listed")).crossJoin(n)  # one row each
    rest = rest.withColumn("n_pairs", F.floor(F.col("n") * (F.col("n") - 1) / 2) - F.col("listed")).where("n_pairs > 0")
    null = F.lit(None).cast("string")
    apart = rest.select(null.alias("profile_1"), null.alias("profile_2"), F.lit(0).cast("long").alias("n_shared"), "n_pairs")
    return listed.unionByName(measured(apart, F.lit(1.0), F.lit(1.0)))
