"""Problem 3: items that stand together in a record, and how much more often than chance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.llm.cleantext import clean_sql, clean_text, signs, signs_sql
from tellstone.session import Scratch
from tellstone.sources.tables import read_table

#: Items in at least this share of the records are heavy; at most (items a record) / share items can be.
HEAVY_SHARE = 0.02
#: Records whose bits are counted at once.
BLOCK = 8192
_PAIRS = "term_a string, term_b string, n long"


def _pair_counter(heavy: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts pairs in batches of records: column ``terms`` holds the different items of each."""
    names = np.array(sorted(heavy, key=heavy.get), dtype=object)
    n_heavy = len(names)

    def rows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        low = a < b
        return pa.RecordBatch.from_arrays([pa.array(np.where(low, a, b), pa.string()), pa.array(np.where(low, b, a), pa.string()), pa.array(n, pa.int64())], ["term_a", "term_b", "n"])

    def dense(bits: np.ndarray, total: np.ndarray) -> None:
        """Heavy with heavy: popcounts of the rows of a bit matrix, an item a row, a record a bit."""
        for i in range(n_heavy - 1):
            total[i, i + 1 :] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(axis=1, dtype=np.int64)

    def mixed(here: np.ndarray, record: np.ndarray, item: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Heavy with light: the list of records of each light item probes the heavy bits."""
        order = np.argsort(item, kind="stable")
        record, item = record[order], item[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        step = max(1, 20_000_000 // max(1, n_heavy * 8))
        for at in range(0, len(starts), step):
            first, end = starts[at], (starts[at + step] if at + step < len(starts) else len(item))
            part = starts[at : at + step] - first
            count = np.zeros((len(part), n_heavy), np.int64)
            for lo in range(first, end, 65_536):  # lists may be long: add them up in pieces
                hi = min(end, lo + 65_536)
                group = np.searchsorted(part, np.arange(lo, hi) - first, side="right") - 1
                cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                count[group[cut]] += np.add.reduceat(here[record[lo:hi]], cut, axis=0, dtype=np.int64)
            li, hj = np.nonzero(count)
            if len(li):
                yield rows(words[item[starts[at + li]]], names[hj], count[li, hj])

    def light(record: np.ndarray, item: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Light with light: pairs in each record, hashed and counted in bounded pieces."""
        order = np.lexsort((item, record))
        record, item = record[order], item[order]
        size = len(item)
        left = np.searchsorted(record, record, side="right") - np.arange(size) - 1
        upto = np.cumsum(left)
        lo = 0
        while lo < size:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 4_000_000, side="right")))
            n = left[lo:hi]
            first = np.repeat(np.arange(lo, hi), n)
            if len(first):
                second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
                keys, count = np.unique(item[first].astype(np.int64) * len(words) + item[second], return_counts=True)
                yield rows(words[keys // len(words)], words[keys % len(words)], count)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_heavy, n_heavy), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                lists = batch.column(0).slice(at, BLOCK)
                n = len(lists)
                coded = lists.flatten().dictionary_encode()
                words = np.array(coded.dictionary.to_pylist(), dtype=object)
                if not len(words):
                    continue
                item = coded.indices.to_numpy(zero_copy_only=False)
                record = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                code = np.array([heavy.get(w, -1) for w in words], dtype=np.int64)
                is_heavy = code[item] >= 0
                here = np.zeros((n, n_heavy), np.uint8)
                here[record[is_heavy], code[item[is_heavy]]] = 1
                if n_heavy:
                    packed = np.packbits(here.T, axis=1)
                    packed = np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))))
                    dense(packed.view(np.uint64), total)
                if not is_heavy.all():
                    r, i = record[~is_heavy], item[~is_heavy]
                    if n_heavy:
                        yield from mixed(here, r, i, words)
                    yield from light(r, i, words)
        i, j = np.nonzero(total)
        for at in range(0, len(i), 50_000):
            yield rows(names[i[at : at + 50_000]], names[j[at : at + 50_000]], total[i[at : at + 50_000], j[at : at + 50_000]])

    return run


def cooccurrence(records: DataFrame, least_pairs: int = 1, least_share: float = 0.0, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Pairs of items that stand in the same record, with counts and lift.

    ``records`` has ``rec`` and ``terms`` (an array, with repetitions if any). Result: term_a <
    term_b, n_ab, n_a, n_b, n (records with an item), lift = n_ab n / (n_a n_b), for pairs in
    at least ``least_pairs`` records and at least ``least_share`` of them. These limits only
    leave out items that can't reach them by themselves: the counts of all others are whole.

    Items split into heavy and light by their number of records. Heavy pairs are popcounts
    of a dense bit matrix held by each task, light pairs are hashed and counted within
    the task, mixed pairs probe the heavy bits by the light item's list; the three
    kinds unite and are added up over all tasks. Only the heavy items are sent to all
    tasks; there are at most (mean items a record) / heavy_share of them.

    Null or empty ``terms`` and null items count for nothing, a record with one item adds
    to n. A record counts once: ``rec`` must be unique. An empty input gives no rows.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "cooccurrence")
    sets = scratch.write(records.select(F.array_distinct(F.array_compact("terms")).alias("terms"))).where("size(terms) > 0")
    n = sets.count()
    least = max(1, least_pairs, -(-int(round(least_share * n * 1e6)) // 1_000_000))
    terms = scratch.write(sets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).where(F.col("n_term") >= least))
    heavy = [r[0] for r in terms.where(F.col("n_term") >= max(least, heavy_share * n)).select("term").orderBy("term").collect()]
    codes = {t: i for i, t in enumerate(heavy)}
    if least > 1:
        # no item below the limit is in a pair that reaches it; what is left is bounded by it
        kept = [r[0] for r in terms.select("term").collect()] if least_share > 0 else None
        sets = _only(sets, terms, kept)
    counted = sets.mapInArrow(_pair_counter(codes), _PAIRS).groupBy("term_a", "term_b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= least)
    a, b = (terms.select(F.col("term").alias(f"term_{x}"), F.col("n_term").alias(f"n_{x}")) for x in "ab")
    return counted.join(a, "term_a").join(b, "term_b").select(
        "term_a", "term_b", "n_ab", "n_a", "n_b", F.lit(n).cast("long").alias("n"), (F.col("n_ab") * n / (F.col("n_a") * F.col("n_b"))).alias("lift")
    )


def _only(sets: DataFrame, terms: DataFrame, kept: list[str] | None) -> DataFrame:
    """Records with only the items that can reach the limit.

    With a limit as a share of the records at most (mean items a record) / share items
    are left, so they are sent to all tasks; otherwise items are joined by shuffle.
    """
    if kept is None:
        marked = sets.withColumn("rec", F.monotonically_increasing_id()).select("rec", F.explode("terms").alias("term"))
        return marked.join(terms.select("term"), "term", "left_semi").groupBy("rec").agg(F.collect_list("term").alias("terms")).select("terms")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(kept, pa.string())
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            ok = pa.compute.is_in(flat, value_set=known)
            upto = np.r_[0, np.cumsum(ok.to_numpy(zero_copy_only=False))]
            offsets = upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.filter(ok).cast(pa.string()))], ["terms"])

    import pyarrow.compute  # noqa: F401

    return sets.mapInArrow(keep, "terms array<string>")


def sign_records(spark: SparkSession, folder: str, *tables: str) -> DataFrame:
    """``rec`` and ``terms``: the signs of every record, in order; a record that comes again counts once."""
    out = None
    for t in tables:
        rows = read_table(spark, folder, t, "id", "transliteration").where("id is not null")
        part = rows.groupBy("id").agg(F.any_value("transliteration", True).alias("text")).select(F.concat_ws(":", F.lit(t), F.col("id").cast("string")).alias("rec"), signs(clean_text(F.col("text"))).alias("terms"))
        out = part if out is None else out.unionByName(part)
    return out


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cooccurrence(sign_records(spark, folder, "tablets", "corpus_catalog"), least_pairs=5, least_share=0.005)
    return pairs.where("n_ab >= 5 and n_ab * 200 >= n and n_ab * n >= 3 * n_a * n_b").select("term_a", "term_b")


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every two signs that stand in the same record, with counts and lift."""
    pairs = cooccurrence(sign_records(spark, folder, "tablets", "corpus_catalog"))
    return pairs.select("term_a", "term_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs}
_COUNTED = f"""
with r as (
  select 'tablets' as t, id, any_value(transliteration) as x from tablets group by id
  union all select 'corpus_catalog', cast(id as varchar), any_value(transliteration) from corpus_catalog group by id),
s as (select t, id, unnest(list_distinct({signs_sql(clean_sql('x'))})) as term from r where x is not null),
n as (select count(*) as n from (select distinct t, id from s)),
f as (select term, count(*) as n_term from s group by term),
p as (select a.term as term_a, b.term as term_b, count(*) as n_ab from s a join s b on a.t = b.t and a.id = b.id and a.term < b.term group by all)"""
SQL = {
    "p3_found": f"""{_COUNTED}
select term_a, term_b from p join f a on a.term = term_a join f b on b.term = term_b, n
where n_ab >= 5 and n_ab * 200 >= n and n_ab * n >= 3 * a.n_term * b.n_term
""",
    "p3_pairs": f"""{_COUNTED}
select term_a, term_b, n_ab, a.n_term as n_a, b.n_term as n_b, round(n_ab * n / (a.n_term * b.n_term), 6) as lift
from p join f a on a.term = term_a join f b on b.term = term_b, n
""",
}
