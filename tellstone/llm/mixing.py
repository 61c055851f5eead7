"""Problem 9: a selection in which each source has its share, measured in tokens."""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tellstone.llm.bytepairs import encoded
from tellstone.session import Scratch
from tellstone.sources.tables import read_table

#: Texts of one bucket of the seeded order, within which running sums are made by one task.
BUCKET_TEXTS = 50_000
#: Rows of mix_targets, and membership patterns, that may come to the driver.
MOST_TARGETS, MOST_PATTERNS = 10_000, 200_000
#: Stretches of a plan that are sent to all tasks; more are joined by shuffle.
SENT_STRETCHES = 50_000


class LevelledFlow:
    """Flow of the lowest cost where only the arcs that leave the start cost something.

    Such a flow is found level by level of cost: the arcs of the lowest cost are opened and as much is sent as can
    be, then those of the next, and so on. Within a level flow is sent along all shortest paths at once (Dinic's method),
    so that the work grows little faster than the number of arcs.
    """

    def __init__(self, nodes: int, start: int, end: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.start, self.end = start, end

    def add(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _far(self) -> list[int]:
        """Steps from the start over arcs with room; -1 for what can't be reached."""
        far = [-1] * len(self.arcs)
        far[self.start] = 0
        queue = deque([self.start])
        while queue:
            a = queue.popleft()
            for i in self.arcs[a]:
                if self.room[i] > 0 and far[self.to[i]] < 0:
                    far[self.to[i]] = far[a] + 1
                    queue.append(self.to[i])
        return far

    def reached(self) -> list[bool]:
        """Which nodes flow could still be sent to: the start's side of a smallest cut, after ``push``."""
        return [d >= 0 for d in self._far()]

    def push(self) -> int:
        """Sends as much as can be; returns the amount."""
        total = 0
        while (far := self._far())[self.end] >= 0:
            at = [0] * len(self.arcs)
            path: list[int] = []
            while True:
                a = self.to[path[-1]] if path else self.start
                if a == self.end:
                    amount = min(self.room[i] for i in path)
                    total += amount
                    for i in path:
                        self.room[i] -= amount
                        self.room[i ^ 1] += amount
                    path = path[: next(k for k, i in enumerate(path) if self.room[i] == 0)]
                    continue
                while at[a] < len(self.arcs[a]) and not (self.room[i := self.arcs[a][at[a]]] > 0 and far[self.to[i]] == far[a] + 1):
                    at[a] += 1
                if at[a] < len(self.arcs[a]):
                    path.append(self.arcs[a][at[a]])
                elif path:
                    at[self.to[path.pop() ^ 1]] += 1
                else:
                    break
        return total


def _network(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> tuple[LevelledFlow, dict, dict, dict]:
    """The flow, with the arcs from the start to patterns (closed), from patterns to sources, and the nodes of sources."""
    node = {x: i for i, x in enumerate(["start", "end", *(("pattern", p) for p in sorted(patterns)), *(("source", s) for s in sorted(quotas))])}
    flow = LevelledFlow(len(node), 0, 1)
    for s, quota in sorted(quotas.items()):
        flow.add(node["source", s], 1, quota)
    opening = {p: flow.add(0, node["pattern", p], 0) for p in sorted(patterns)}
    taken = {(p, s): flow.add(node["pattern", p], node["source", s], patterns[p] * repeats[s]) for p in sorted(patterns) for s in sorted(set(p))}
    return flow, opening, taken, {s: node["source", s] for s in quotas}


def route(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int) -> dict[tuple[tuple[str, ...], str, int], int]:
    """Tokens of each membership pattern that each source takes in each round of use.

    A pattern names the sources that hold a text; one that names a source twice is of further copies. The k-th use of
    a text costs k, that of a further copy k + 1, so that no text is used again while others are left. A source uses
    each document of its own ``repeats`` times at most. Takings follow each other round and round the
    texts of a pattern, so one of at most r times its tokens meets no text more than r times.
    """
    flow, opening, taken, _ = _network(patterns, {s: int(share * total) for s, share in shares.items()}, repeats)
    levels = defaultdict(list)
    for pattern in patterns:
        sources = set(pattern)
        for k in range(1, 1 + sum(repeats[s] for s in sources)):
            levels[k + (len(sources) < len(pattern))].append(pattern)
    for cost in sorted(levels):
        for pattern in levels[cost]:
            flow.room[opening[pattern]] += patterns[pattern]
        flow.push()
    out, used = {}, defaultdict(int)
    for (pattern, s), arc in taken.items():
        at, tokens = used[pattern], patterns[pattern]
        used[pattern] = upto = at + flow.room[arc ^ 1]
        while at < upto:
            stop = min(upto, (at // tokens + 1) * tokens)
            out[pattern, s, at // tokens + 1] = stop - at
            at = stop
    return out


def _short(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int) -> tuple[float, int] | None:
    """None if every source can fill its share of the total, else the share of the sources that can't together, and what they can take."""
    quotas = {s: int(share * total) for s, share in shares.items()}
    flow, opening, taken, nodes = _network(patterns, quotas, repeats)
    for pattern, arc in opening.items():
        flow.room[arc] = patterns[pattern] * sum(repeats[s] for s in set(pattern))
    sent = flow.push()
    if sent == sum(quotas.values()):
        return None
    there = flow.reached()
    lacking = [s for s, i in nodes.items() if not there[i]]
    return sum(shares[s] for s in lacking), sent - sum(quotas[s] for s in shares if s not in lacking)


def largest_total(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total at which every source can fill its share.

    Each total that is too large names sources that lack text; the next is what these can take over
    their share, so few flows are needed. A last search finds what is won by rounding shares down.
    """
    total = sum(tokens * sum(repeats[s] for s in set(pattern)) for pattern, tokens in patterns.items())
    high = total + 1
    while (lack := _short(patterns, shares, repeats, total)) is not None:
        high, total = total, min(total - 1, int(lack[1] / lack[0]))
    high = min(high, total + 2 + int(len(shares) / min(shares.values())))
    while high - total > 1:
        mid = (total + high) // 2
        total, high = (mid, high) if _short(patterns, shares, repeats, mid) is None else (total, mid)
    return total


_PLAN = T.StructType([
    T.StructField("mix_name", T.StringType()), T.StructField("pattern", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("round", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()),
])


def mixed(docs: DataFrame, targets: DataFrame, seed: int = 1, totals: dict[str, int] | None = None, whole: bool = False) -> DataFrame:
    """The selection: mix_name, doc_id, source, n_tokens, times.

    ``docs`` has doc_id (unique), text, source and n_tokens (``encoded(..., lengths_only=True)`` keeps no text, so it
    is joined by the caller or given as two hashes h1, h2); ``targets`` has mix_name, source, target_weight, max_repeats.

    * Equal texts are one text that may belong to several sources, by the document of each with the smallest id;
      further copies in a source stand for themselves. Texts of the same set of sources
      make one pattern, further copies of a source another; only the tokens of each pattern come to the driver, at
      most 2 ** sources a mix and one a source. There a min-cost flow sends tokens from patterns to the quotas of
      the sources, where the k-th use costs k, one more for copies, and each document may be used max_repeats times.
    * Without ``totals`` a mix is as large as it can be with every source that has text at its share;
      with them quotas are shares of the given total, and a source that can't fill its own stays below. With
      ``whole`` the total of a mix not in ``totals`` is that of all documents of its sources, each once.
      Weights need not add up to 1; sources without text, weight or repeats are left out and the others keep
      their proportions.
    * Texts of a pattern stand in an order seeded by ``seed``; each source takes the texts whose middle lies within
      its stretch of tokens in each round, so that a text at a boundary goes to the side that has more of it; stretches
      follow each other round and round. Running sums are made by buckets of the order, so no task holds a
      whole source. Shares are met up to half a text at either end of a stretch.

    A source takes only documents of its own, each at most max_repeats times. Documents without
    tokens or source are never used. Repeated targets of a source count once (largest
    weight, largest max_repeats). An empty input gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    goals = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.max("target_weight").alias("weight"), F.max("max_repeats").alias("repeats"))
    listed = goals.where("weight > 0 and not isnan(weight) and repeats > 0").limit(MOST_TARGETS + 1).collect()
    if len(listed) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    by_mix: dict[str, dict[str, tuple[float, int]]] = defaultdict(dict)
    for mix, source, weight, repeats in listed:
        by_mix[mix][source] = (float(weight), int(repeats))
    wanted = spark.createDataFrame([(m, s) for m in sorted(by_mix) for s in sorted(by_mix[m])], "mix_name string, source string")
    sized = docs.where("n_tokens > 0 and source is not null").select("doc_id", "source", "h1", "h2", F.col("n_tokens").cast("long").alias("n_tokens"))
    sized = scratch.write(sized.join(F.broadcast(wanted.select("source").distinct()), "source", "left_semi"))
    own = sized.groupBy("h1", "h2", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    owners = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "doc_id"))))
    texts = own.join(F.broadcast(wanted), "source").groupBy("mix_name", "h1", "h2").agg(F.max("n_tokens").alias("n_tokens"), owners.alias("owners"))
    texts = texts.withColumn("copy", F.lit(None).cast("long")).withColumn("order", F.xxhash64(F.lit(seed), "h1", "h2"))
    copies = sized.join(own.select("doc_id"), "doc_id", "left_anti").join(F.broadcast(wanted), "source")
    copies = copies.select("mix_name", "h1", "h2", "n_tokens", F.create_map("source", "doc_id").alias("owners"), F.col("doc_id").alias("copy"), F.xxhash64(F.lit(seed), "h1", "h2", "doc_id").alias("order"))
    texts = scratch.write(texts.unionByName(copies).withColumn("pattern", F.concat(F.when(F.col("copy").isNull(), "").otherwise("copies "), F.to_json(F.map_keys("owners")))))
    sums = texts.groupBy("mix_name", "pattern").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.first(F.map_keys("owners")).alias("sources"), F.max(F.col("copy").isNotNull()).alias("copies")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    plan = []
    for mix, goal in sorted(by_mix.items()):
        rows = {tuple(r["sources"]) * (1 + r["copies"]): r for r in sums if r["mix_name"] == mix}
        patterns = {p: r["tokens"] for p, r in rows.items()}
        there = {s for p in patterns for s in p}
        if not there:
            continue
        weights = {s: goal[s][0] for s in there}
        shares = {s: w / sum(weights.values()) for s, w in weights.items()}
        repeats = {s: goal[s][1] for s in there}
        total = (totals or {}).get(mix) or (sum(patterns.values()) if whole else 0) or largest_total(patterns, shares, repeats)
        reached: dict[tuple, int] = defaultdict(int)
        for (pattern, source, k), tokens in sorted(route(patterns, shares, repeats, total).items()):
            at = reached[pattern, k]
            reached[pattern, k] += tokens
            plan.append((mix, rows[pattern]["pattern"], source, k, at, at + tokens))
    stretches = spark.createDataFrame(plan, _PLAN)
    bits = max(0, (max((r["n"] for r in sums), default=1) // BUCKET_TEXTS).bit_length())
    texts = texts.withColumn("bucket", F.shiftrightunsigned(F.col("order").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long"))
    key = ["mix_name", "pattern"]
    buckets = texts.groupBy(*key, "bucket").agg(F.sum("n_tokens").alias("size"))
    buckets = buckets.withColumn("before", F.coalesce(F.sum("size").over(W.partitionBy(*key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("size")
    running = W.partitionBy(*key, "bucket").orderBy("order", "h1", "h2", "copy").rowsBetween(W.unboundedPreceding, -1)
    placed = texts.withColumn("within", F.coalesce(F.sum("n_tokens").over(running), F.lit(0))).join(buckets, [*key, "bucket"]).withColumn("at", F.col("before") + F.col("within"))
    middle = 2 * F.col("at") + F.col("n_tokens")
    used = placed.join(F.broadcast(stretches) if len(plan) <= SENT_STRETCHES else stretches, key).where((middle >= 2 * F.col("first")) & (middle < 2 * F.col("end")))
    return used.groupBy("mix_name", "h1", "h2", "copy", "source").agg(F.first("n_tokens").alias("n_tokens"), F.first("owners").alias("owners"), F.count(F.lit(1)).cast("int").alias("times")).select(
        "mix_name", F.try_element_at("owners", "source").alias("doc_id"), "source", "n_tokens", "times"
    )


def reached_shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """For each mix and source: target share, tokens and share really reached, texts, and most uses of one."""
    of_mix = W.partitionBy("mix_name")
    goals = targets.groupBy("mix_name", "source").agg(F.max("target_weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    goals = goals.withColumn("target_share", F.round(F.col("weight") / F.sum("weight").over(of_mix), 6)).drop("weight")
    got = selection.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("times").alias("most_times"))
    out = goals.join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens", "n_docs", "most_times"])
    total = F.sum("tokens").over(of_mix)
    return out.withColumn("actual_share", F.round(F.when(total > 0, F.col("tokens") / total).otherwise(0.0), 6))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", "doc_id", "text", "source").where("source is not null and text <> ''")
    docs = docs.select("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")
    return encoded(docs, out="n_tokens", lengths_only=True)


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(_sized(spark, folder), read_table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = read_table(spark, folder, "mix_targets")
    return reached_shares(mixed(_sized(spark, folder), targets), targets)


def p9_available(spark: SparkSession, folder: str) -> DataFrame:
    """A selection of as many tokens as there are: short sources are repeated as often as they may be, and fall short."""
    return mixed(_sized(spark, folder), read_table(spark, folder, "mix_targets"), whole=True)


def p9_available_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = read_table(spark, folder, "mix_targets")
    return reached_shares(mixed(_sized(spark, folder), targets, whole=True), targets)


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For each mix and source with text: its share among these, and whether the selection keeps to it and to max_repeats.

    A share is kept if it is off by no more than two of the longest texts of the mix.
    """
    targets = read_table(spark, folder, "mix_targets")
    goals = targets.groupBy("mix_name", "source").agg(F.max("target_weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    sized = Scratch(spark, "sized").write(_sized(spark, folder))
    there = sized.where("n_tokens > 0").select("source").distinct()
    got = mixed(sized, targets).groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.max("times").alias("most_times"), F.max("n_tokens").alias("longest"))
    rows = goals.where("weight > 0 and max_repeats > 0").join(there, "source").join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens", "most_times", "longest"])
    of_mix = W.partitionBy("mix_name")
    share = F.col("weight") / F.sum("weight").over(of_mix)
    off = F.abs(F.col("tokens") - share * F.sum("tokens").over(of_mix))
    rows = rows.withColumns({"target_share": F.round(share, 6), "share_kept": off <= 2 * F.max("longest").over(of_mix)})
    return rows.select("mix_name", "source", "target_share", "share_kept", (F.col("most_times") <= F.col("max_repeats")).alias("repeats_kept"))


QUERIES = {"p9_selection": p9_selection, "p9_shares": p9_shares, "p9_available": p9_available, "p9_available_shares": p9_available_shares, "p9_kept": p9_kept}
SQL = {
    "p9_kept": """
with g as (select mix_name, source, max(target_weight) as w from mix_targets where max_repeats > 0 and target_weight > 0 group by all),
t as (select g.* from g where exists (select 1 from documents d where d.source = g.source and d.text <> ''))
select mix_name, source, round(w / sum(w) over (partition by mix_name), 6) as target_share, true as share_kept, true as repeats_kept from t
"""
}
