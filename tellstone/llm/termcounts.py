"""Problem 7: how often every term occurs, in how many records, and which are too rare or too common."""

from __future__ import annotations

import itertools
import shutil
import uuid
from collections.abc import Callable, Iterator
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.llm.cleantext import clean_sql, signs_sql
from tellstone.llm.cooccurrence import sign_records
from tellstone.session import Scratch
from tellstone.sources.tables import read_table

#: Bits of the hash that each level of partitioning uses; a level makes 2 ** BITS partitions of one.
BITS = 4
#: Rows of a partition beyond which it is split further.
MOST_ROWS = 1_000_000
#: Rows of counts that a task adds up at once.
FOLD_ROWS = 200_000
#: Memory of the engine that adds up a folder.
MEMORY = "512MB"
_COUNTED = "term string, occurrences long, records long"
RARE_RECORDS = 2
COMMON_SHARE = 0.3


def _batch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts within a batch of records: a row for each different term of it."""
    for batch in batches:
        lists = batch.column(0)
        coded = lists.flatten().dictionary_encode()
        n = len(coded.dictionary)
        if not n:
            continue
        item = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        record = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        once = np.unique(record * n + item) % n
        counts = [pa.array(np.bincount(x, minlength=n), pa.int64()) for x in (item, once)]
        yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), *counts], ["term", "occurrences", "records"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same counts with equal terms of a task added up, FOLD_ROWS rows at a time."""
    kept, rows = [], 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows >= FOLD_ROWS:
            done = _fold(kept)
            kept, rows = ([], 0) if 2 * done.num_rows > FOLD_ROWS else (done.to_batches(), done.num_rows)
            if not kept:
                yield from done.to_batches()
    if kept:
        yield from _fold(kept).to_batches()


def _fold(batches: list[pa.RecordBatch]) -> pa.Table:
    sums = pa.Table.from_batches(batches).group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")])
    return sums.select(["term", "occurrences_sum", "records_sum"]).rename_columns(["term", "occurrences", "records"])


def _adder(spill: str, memory: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up each folder that comes in, by an embedded engine that reads its files itself and spills beyond its memory."""
    on_disk = spill.startswith("file:")
    plain = lambda path: "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            room = f"{plain(spill)}/{uuid.uuid4().hex}"
            config = {"memory_limit": memory, "threads": 1, "preserve_insertion_order": False, "temp_directory": room if on_disk else ""}
            with duckdb.connect(config=config) as con:
                if on_disk:
                    con.execute("create view part as select * from read_parquet(?)".replace("?", "'" + f"{plain(folder)}/*.parquet".replace("'", "''") + "'"))
                else:
                    con.register("part", pyarrow.dataset.dataset(folder, format="parquet"))
                found = con.sql("select term, sum(occurrences)::bigint as occurrences, sum(records)::bigint as records from part group by term")
                yield from found.to_arrow_reader(50_000)
            shutil.rmtree(room, ignore_errors=True)

    import pyarrow.dataset

    return run


def term_counts(records: DataFrame, bits: int = BITS, most_rows: int = MOST_ROWS, memory: str = MEMORY) -> DataFrame:
    """Rows ``term``, ``occurrences``, ``records`` for every term of ``terms`` (an array of strings).

    Terms are counted within batches of records first, and the counts of a task are added up, so that a
    term that every record has is a row or few a task. Counts are partitioned by bits of the term's
    hash into folders of the shared folder; all folders of more than ``most_rows`` rows are read
    again, by one job a level, and split by the next bits, and so on, until they are small or the bits are used
    up; what a task reads is added up before it is written again, so that a single term of very many rows
    shrinks although no bits split it. Each folder is then read and added up by an embedded engine in one task, under a
    memory limit, beyond which it spills to the shared folder (where that is no file system that
    it can write to, it only has its memory, for which the folders are small enough). Only the
    sizes and names of the folders come to the driver, one for each ``most_rows`` rows at most 2 ** bits times.

    Null arrays, empty arrays and null terms count for nothing; an empty term is a term.
    ``records`` must hold each record once. An empty input gives no rows.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "termcounts")
    terms = records.select(F.array_compact("terms").alias("terms")).where("size(terms) > 0")
    rows, level, leaves, total = terms.mapInArrow(lambda it: _folded(_batch_counts(it)), f"{_COUNTED}").withColumn("part", F.lit("")), 0, [], 0
    while rows is not None:
        radix = F.pmod(F.shiftrightunsigned(F.xxhash64("term"), bits * level), F.lit(1 << bits)).cast("int")
        parts = scratch.write(rows.withColumn("part", F.concat(F.col("part"), F.lit("-"), radix.cast("string"))), "part")
        sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
        large = sorted(k for k, n in sizes.items() if n > most_rows) if bits * (level + 2) <= 60 else []
        leaves += [scratch.whole_path(parts, f"part={k}") for k in sorted(sizes) if k not in set(large)]
        total += sum(n for k, n in sizes.items() if k not in set(large))
        again = parts.where(F.col("part").isin(large)).select("part", "term", "occurrences", "records")
        rows = again.mapInArrow(_folded_parts, f"part string, {_COUNTED}").select("term", "occurrences", "records", "part") if large else None
        level += 1
    if not leaves:
        return spark.createDataFrame([], _COUNTED)
    tasks = min(len(leaves), -(-4 * total // most_rows))
    return spark.createDataFrame([(x,) for x in leaves], "folder string").repartition(tasks).mapInArrow(_adder(scratch.whole_path(None, "spill"), memory), _COUNTED)


def _folded_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of several folders, each added up by itself; rows of a folder follow each other in a task."""
    for part, run in itertools.groupby((piece for batch in batches for piece in _by_part(batch)), key=lambda x: x[0]):
        for out in _folded(x[1] for x in run):
            yield pa.RecordBatch.from_arrays([pa.array([part] * out.num_rows, pa.string()), *out.columns], ["part", "term", "occurrences", "records"])


def _by_part(batch: pa.RecordBatch) -> list[tuple[str, pa.RecordBatch]]:
    parts = batch.column(0)
    rest = batch.select(["term", "occurrences", "records"])
    names = parts.unique().to_pylist()
    return [(names[0], rest)] if len(names) == 1 else [(n, rest.filter(pa.compute.equal(parts, n))) for n in names]


def marked_terms(counts: DataFrame, n_records: int, rare_records: int = RARE_RECORDS, common_share: float = COMMON_SHARE) -> DataFrame:
    """Counts with ``mark``: rare, common or null."""
    share = Fraction(str(common_share))
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") * share.denominator > share.numerator * n_records, "common")
    return counts.withColumn("mark", mark)


def miscounted(counts: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Known terms whose stated number is not the counted one; a null number states nothing, an uncounted term has 0."""
    known = knowledge.select(F.lower("sign_id").alias("term"), F.col("corpus_frequency").cast("long").alias("stated")).where("term is not null and stated is not null")
    return known.join(counts, "term", "left").where(F.col("stated") != F.coalesce("occurrences", F.lit(0))).select("term", "stated", F.coalesce("occurrences", F.lit(0)).alias("occurrences"))


def _tablet_counts(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    scratch = Scratch(spark, "signs")
    records = scratch.write(sign_records(spark, folder, "tablets")).where("size(terms) > 0")
    return scratch.write(term_counts(records)), records.count()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    counts, n = _tablet_counts(spark, folder)
    marked = marked_terms(counts, n).where("mark is not null").select("term", "mark")
    wrong = miscounted(counts, read_table(spark, folder, "prebaked_sign_knowledge", "sign_id", "corpus_frequency"))
    return marked.unionByName(wrong.select("term", F.lit("miscounted").alias("mark"))).distinct()


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every sign with its counts and mark."""
    counts, n = _tablet_counts(spark, folder)
    return marked_terms(counts, n)


_COUNTS = f"""
with r as (select id, any_value(transliteration) as x from tablets group by id),
s as (select id, unnest({signs_sql(clean_sql('x'))}) as term from r where x is not null),
n as (select count(distinct id) as n from s),
f as (select term, count(*) as occurrences, count(distinct id) as records from s group by term)
"""

QUERIES = {"p7_found": p7_found, "p7_counts": p7_counts}
SQL = {
    "p7_found": _COUNTS
    + """
select term, 'rare' as mark from f where records <= 2
union select term, 'common' from f, n where records > 0.3 * n
union select lower(k.sign_id), 'miscounted' from prebaked_sign_knowledge k left join f on f.term = lower(k.sign_id)
where k.corpus_frequency is not null and k.corpus_frequency <> coalesce(f.occurrences, 0)
""",
    "p7_counts": _COUNTS + "select term, occurrences, records, case when records <= 2 then 'rare' when records > 0.3 * n then 'common' end as mark from f, n",
}
