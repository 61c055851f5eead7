"""Problem 6: records that share most of their content but differ by small edits."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.llm.cleantext import clean_sql, clean_text, words, words_sql
from tellstone.llm.components import connected_components
from tellstone.session import Scratch
from tellstone.sources.tables import read_table

#: How often a candidate must come up in the short lists; with more of them there are more short lists and fewer candidates.
MERGE_HITS = 3
#: Postings of one piece of an inverted list, and ids that are merged at once for one query.
LIST_PIECE, MERGED_AT_ONCE = 4096, 32_768
#: Members of the sets whose lists are probed by one task.
PROBED_PAIRS = 250_000
#: Cells (as powers of two) of the table of estimated list lengths: at least, and at most.
LEAST_BITS, MOST_BITS = 12, 24
LEAST_WORDS = 8
SIMILARITY = Fraction(1, 2)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EXACT = 128  # lengths below are stored as they are, others in quarters of powers of two


def word_pairs(tokens: Column) -> Column:
    """Hashes of the different pairs of adjacent words, ascending; empty for fewer than two words.

    A hash has 64 bits: among a billion different pairs one collision is to be expected
    with a probability of 3 %, and it would change one overlap by one.
    """
    n = F.size(tokens)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(F.element_at(tokens, i), F.element_at(tokens, i + 1)))
    return F.when(n >= 2, F.array_sort(F.array_distinct(pairs))).otherwise(F.array().cast("array<bigint>"))


def _mixed(values: np.ndarray) -> np.ndarray:
    """Well mixed bits of ids or hashes."""
    x = values.astype(np.int64).view(np.uint64) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def _cells(members: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(members) >> np.uint64(64 - bits)).astype(np.int64)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after another."""
    upto = np.cumsum(lengths)
    return np.repeat(starts - (upto - lengths), lengths) + np.arange(upto[-1] if len(upto) else 0)


def _power(n: np.ndarray) -> np.ndarray:
    """Exponent of the smallest power of two that is at least n."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def _list(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and where each list begins (one more entry at the end)."""
    return column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values, kind))


def _whole_groups(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that never end within a group; rows of a group follow each other."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in key]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
        if kept and any(kept[-1].column(c)[kept[-1].num_rows - 1].as_py() != batch.column(c)[0].as_py() for c in key):
            yield _one(kept)
            kept = []
        if len(change):
            end = int(change[-1]) + 1
            yield _one([*kept, batch.slice(0, end)])
            kept = [batch.slice(end)]
        else:
            kept.append(batch)
    if kept:
        yield _one(kept)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _counter(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many members fall in each cell, added up within a task a few million at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                kept.append(_cells(_list(batch.column(0))[0], bits))
                size += len(kept[-1])
            if size and (batch is None or size > 4_000_000):
                cell, n = np.unique(np.concatenate(kept), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell >> 10, pa.int32()), pa.array(cell, pa.int32()), pa.array(n, pa.int64())], ["block", "cell", "n"])
                kept, size = [], 0

    return run


def _coded_block(table: pa.Table) -> pa.Table:
    cell, n = table.column("cell").to_numpy(), table.column("n").to_numpy()
    codes = np.zeros(1024, np.uint8)
    codes[cell & 1023] = np.where(n < _EXACT, n, np.minimum(255, _EXACT + np.ceil(4 * np.log2(np.maximum(n, _EXACT) / _EXACT))))
    return pa.table({"block": pa.array(cell[:1] >> 10, pa.int32()), "codes": pa.array([codes.tobytes()], pa.binary())})


def _list_lengths(reps: DataFrame, bits: int) -> np.ndarray:
    """Upper estimates of the lengths of all inverted lists, a byte a cell.

    The members of a cell are counted together, so an estimate is never too low; it only decides the order of lists and
    how they are cut, not what is found. The table has at most 2 ** MOST_BITS bytes, whatever the collection.
    """
    counts = reps.select("pairs").mapInArrow(_counter(bits), "block int, cell int, n long").groupBy("block", "cell").agg(F.sum("n").alias("n"))
    codes = np.zeros(1 << bits, np.uint8)
    for row in counts.groupBy("block").applyInArrow(_coded_block, "block int, codes binary").toLocalIterator():
        codes[row["block"] * 1024 : (row["block"] + 1) * 1024] = np.frombuffer(row["codes"], np.uint8)[: len(codes)]
    return codes


class _Divided:
    """Members of sets from the shortest list to the longest, divided into short and long lists."""

    def __init__(self, batch: pa.RecordBatch, codes: np.ndarray, s: Fraction, hits: int, merged_at_once: int):
        self.id = batch.column("id").to_numpy()
        members, begins = _list(batch.column("pairs"))
        self.n = np.diff(begins)
        lengths = np.r_[np.arange(_EXACT), (_EXACT * 2.0 ** (np.arange(256 - _EXACT) / 4)).astype(np.int64)]
        est = lengths[codes[_cells(members, int(np.log2(len(codes))))]]
        row = np.repeat(np.arange(len(self.n)), self.n)
        order = np.lexsort((members, est, row))
        at = np.arange(len(row)) - begins[row]
        needed = -(-2 * s.numerator * self.n // (s.numerator + s.denominator))
        short = at < (self.n - needed + np.minimum(hits, needed))[row]
        there = est[order] > 1  # a member of one set only has no other set in its list
        self.member, self.est, self.row, self.short = members[order][there], est[order][there], row[there], short[there]
        merged = np.bincount(self.row[self.short], weights=self.est[self.short], minlength=len(self.n))
        self.parts = _power(merged / merged_at_once)  # a query with very long short lists is merged in parts, by hash bits of the ids


def _lister(codes: object, s: Fraction, hits: int, list_piece: int, merged_at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings, those of short lists also as queries. A long list is cut in a square of pieces: by the ids in it, and by those that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                d = _Divided(whole.slice(lo, 8192), codes.value, s, hits, merged_at_once)
                side = np.int64(1) << _power(d.est / list_piece)
                own = (_mixed(d.id)[d.row] & np.uint64((1 << 62) - 1)).astype(np.int64) % side
                one, many = np.flatnonzero(side == 1), np.flatnonzero(side > 1)
                yield from rows(d, one, np.zeros(len(one), np.int64), 1 + 2 * d.short[one])
                for many in np.split(many, np.flatnonzero(np.diff(np.cumsum(side[many]) // 500_000)) + 1):
                    other = _ranges(np.zeros(len(many), np.int64), side[many])
                    again = np.repeat(many, side[many])
                    yield from rows(d, again, other * side[again] + own[again], np.full(len(again), 1))
                    asks = d.short[again]
                    again, other = again[asks], other[asks]
                    yield from rows(d, again, own[again] * side[again] + other, np.full(len(again), 2))

    def rows(d: _Divided, at: np.ndarray, piece: np.ndarray, role: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(at):
            r = d.row[at]
            columns = [pa.array(d.member[at]), pa.array(piece, pa.int64()), pa.array(d.n[r], pa.int32()), pa.array(d.id[r]), pa.array(role, pa.int8()), pa.array(d.parts[r], pa.int8())]
            yield pa.RecordBatch.from_arrays(columns, ["member", "piece", "n", "id", "role", "parts"])

    return run


def _short_lists(s: Fraction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each query of a piece the ids in it that may be similar: larger sets, but not too large. Rows come ordered by list, piece, n, id and role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, "member", "piece"):
            member, piece, n, ids, role, parts = (batch.column(i).to_numpy() for i in range(6))
            group = np.cumsum(np.r_[False, (member[1:] != member[:-1]) | (piece[1:] != piece[:-1])]).astype(np.int64)
            held, asks = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
            key = (group[held] << 32) + n[held]
            start = np.searchsorted(held, asks, side="right")
            end = np.searchsorted(key, (group[asks] << 32) + np.minimum(n[asks].astype(np.int64) * s.denominator // s.numerator, 2**31), side="right")
            some = end > start
            asks, start, size = asks[some], start[some], (end - start)[some]
            for part in np.split(np.arange(len(asks)), np.flatnonzero(np.diff(np.cumsum(size) // 2_000_000)) + 1):
                if not len(part):
                    continue
                r = ids[held[_ranges(start[part], size[part])]]
                row = np.repeat(np.arange(len(part)), size[part])
                slot = (_mixed(r) >> np.uint64(40)).astype(np.int64) & ((np.int64(1) << parts[asks[part]].astype(np.int64)) - 1)[row]
                if slot.any():
                    order = np.lexsort((slot, row))
                    r, row, slot = r[order], row[order], slot[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (slot[1:] != slot[:-1])])
                q = asks[part][row[first]]
                columns = [pa.array(ids[q]), pa.array(slot[first], pa.int32()), pa.array(np.ones(len(first)), pa.int8()), pa.array(n[q], pa.int32()), _lists(r, np.diff(np.r_[first, len(r)]), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["q", "slot", "tag", "n", "list"])

    return run


def _long_lists(codes: object, s: Fraction, hits: int, merged_at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The members of each set whose lists are long, once for each part in which its short lists are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                d = _Divided(whole.slice(lo, 8192), codes.value, s, hits, merged_at_once)
                asks = np.unique(d.row[d.short])
                member, size = d.member[~d.short], np.bincount(d.row[~d.short], minlength=len(d.n))
                begin = np.cumsum(size) - size
                parts = np.int64(1) << d.parts[asks]
                q, slot = np.repeat(asks, parts), _ranges(np.zeros(len(asks), np.int64), parts)
                columns = [pa.array(d.id[q]), pa.array(slot, pa.int32()), pa.array(np.zeros(len(q)), pa.int8()), pa.array(d.n[q], pa.int32()), _lists(member[_ranges(begin[q], size[q])], size[q], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["q", "slot", "tag", "n", "list"])

    return run


def _merger(s: Fraction, hits: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges the short lists of each query and keeps the ids that come up often enough, with how often they did.

    The lists of all queries of a batch are merged at once: a stable sort, which merges runs, in
    place of a heap for each query. Candidates go on by hash of their id, with the query's long lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, "q", "slot"):
            q, slot, tag, n = (batch.column(i).to_numpy() for i in range(4))
            values, begins = _list(batch.column("list"))
            group = np.cumsum(np.r_[True, (q[1:] != q[:-1]) | (slot[1:] != slot[:-1])]) - 1
            lead = np.flatnonzero(tag == 0)  # one a group, before its lists
            met = np.flatnonzero(tag == 1)
            sizes = np.diff(begins)
            r, g = values[_ranges(begins[met], sizes[met])], np.repeat(group[met], sizes[met])
            order = np.lexsort((r, g))
            r, g = r[order], g[order]
            first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])]) if len(r) else np.empty(0, np.int64)
            times = np.diff(np.r_[first, len(r)])
            r, g = r[first], g[first]
            needed = -(-2 * s.numerator * n[lead].astype(np.int64) // (s.numerator + s.denominator))
            ok = times >= np.minimum(hits, needed)[g]
            r, g, times = r[ok], g[ok], times[ok]
            bucket = _bucket(r, buckets)
            order = np.lexsort((bucket, g))
            r, g, times, bucket = r[order], g[order], times[order], bucket[order]
            first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (bucket[1:] != bucket[:-1])]) if len(r) else np.empty(0, np.int64)
            lengths = np.diff(np.r_[first, len(r)])
            for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(np.cumsum(sizes[lead[g[first]]]) // 2_000_000)) + 1):
                if len(part):
                    at, c = lead[g[first[part]]], _ranges(first[part], lengths[part])
                    columns = [pa.array(bucket[first[part]], pa.int32()), pa.array(np.ones(len(part)), pa.int8()), pa.array(q[at]), pa.array(n[at], pa.int32()), _lists(values[_ranges(begins[at], sizes[at])], sizes[at], pa.int64())]
                    columns += [_lists(r[c], lengths[part], pa.int64()), _lists(times[c], lengths[part], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "tag", "id", "n", "members", "r", "times"])

    return run


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((_mixed(ids) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


class _Piece:
    """The inverted lists of the sets of one bucket: (member, id) in order."""

    def __init__(self, batches: list[pa.RecordBatch]):
        members, ids, sizes = [], [], []
        for b in batches:
            members.append(_list(b.column("members"))[0])
            ids.append(b.column("id").to_numpy())
            sizes.append(b.column("n").to_numpy())
        self.id, n = np.concatenate(ids), np.concatenate(sizes)
        member = np.concatenate(members)
        place = np.argsort(self.id)
        rank = np.empty_like(place)
        rank[place] = np.arange(len(place))
        self.members, of = np.unique(member, return_inverse=True)
        self.postings = np.sort(of * len(self.id) + np.repeat(rank, n))
        self.id, self.n = self.id[place], n[place].astype(np.int64)

    def holds(self, member: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether the list of a member (its place) has a set (its place): a binary search in the list."""
        key = member * len(self.id) + doc
        at = np.minimum(np.searchsorted(self.postings, key), len(self.postings) - 1)
        return self.postings[at] == key


def _prober(s: Fraction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Probes the long lists of each query for its candidates; what they add to the merged count is the whole overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, piece = None, [], None
        for whole in batches:
            bucket, tag = whole.column("bucket").to_numpy(), whole.column("tag").to_numpy()
            cuts = np.r_[0, np.flatnonzero((bucket[1:] != bucket[:-1]) | (tag[1:] != tag[:-1])) + 1, len(bucket)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                part = whole.slice(lo, hi - lo)
                if bucket[lo] != now:
                    now, kept, piece = bucket[lo], [], None
                if tag[lo] == 0:
                    kept.append(part)
                    continue
                piece = piece or _Piece(kept)
                kept = []
                yield from probed(piece, part)

    def probed(piece: _Piece, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        member, m_at = _list(part.column("members"))
        r, r_at = _list(part.column("r"))
        times = _list(part.column("times"))[0]
        place = np.minimum(np.searchsorted(piece.members, member), len(piece.members) - 1)
        known = piece.members[place] == member  # other lists have nothing in this piece
        place, upto = place[known], np.r_[0, np.cumsum(known)]
        m_at = upto[m_at]
        row = np.repeat(np.arange(part.num_rows), np.diff(r_at))
        doc = np.searchsorted(piece.id, r)
        q, nq = part.column("id").to_numpy()[row], part.column("n").to_numpy()[row].astype(np.int64)
        size = np.diff(m_at)[row]
        for c in np.split(np.arange(len(r)), np.flatnonzero(np.diff(np.cumsum(size) // 2_000_000)) + 1):
            if not len(c):
                continue
            of = np.repeat(np.arange(len(c)), size[c])
            hit = piece.holds(place[_ranges(m_at[row[c]], size[c])], doc[c][of])
            overlap = times[c] + np.bincount(of[hit], minlength=len(c))
            total = nq[c] + piece.n[doc[c]]
            ok = overlap * (s.numerator + s.denominator) >= s.numerator * total
            a, b, o, t = q[c][ok], r[c][ok], overlap[ok], total[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(o / (t - o))], ["rep_a", "rep_b", "similarity"])

    return run


def near_duplicates(docs: DataFrame, similarity: Fraction = SIMILARITY, hits: int = MERGE_HITS, pieces: tuple[int, int, int] = (LIST_PIECE, MERGED_AT_ONCE, PROBED_PAIRS)) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of different sets, and who has which set.

    ``docs`` has ``id`` (long, unique) and ``pairs`` (an ascending array of different longs). The Jaccard
    similarity of a pair is at least ``similarity``. Result: (rep_a < rep_b, similarity) between
    representatives, and (id, rep) for every document; rep is the smallest id with the same set.

    T-occurrence search by DivideSkip, every different set being a query for larger ones. A set of n that is the smaller of a similar pair has
    T = ceil(2 s n / (1 + s)) members in common with the other. Of the inverted lists of its members, n - T + h
    are short and merged; the T - h longest are not. An id that comes up fewer than h times in the short lists can't reach T (h = ``hits``).
    The others are looked up in each long list by a binary search, and what is found is added to the count
    of the merge, which gives the whole overlap.

    * Which lists are short is told by upper estimates of their lengths, in a table of bounded size that is
      sent to all tasks. Estimates only steer the work; any division gives the same pairs.
    * Lists are whole. Pieces of at most some LIST_PIECE ids (``pieces``), squared by those that ask, are merged in a task, so that a
      member that a third of the sets has meets in no task whole.
    * For the probes the lists are cut by hash of the ids, in pieces of PROBED_PAIRS postings; candidates stream past
      the piece that holds them.

    Empty sets and null arrays are like nothing, themselves included, and have no row in the second result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    s = similarity
    sets = scratch.write(docs.select("id", "pairs")).where("size(pairs) > 0")  # written first, or each use makes the pairs anew
    keys = [F.xxhash64("pairs").alias("h1"), F.hash(F.reverse("pairs")).alias("h2"), F.size("pairs").alias("n")]
    keyed = sets.select("id", *keys)
    again = keyed.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    copies = scratch.write(keyed.join(again, ["h1", "h2", "n"]).where("id <> rep").select("id", "rep"))
    members = sets.select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    reps = sets.join(copies.select("id"), "id", "left_anti").select("id", "pairs")
    total = sets.agg(F.sum(F.size("pairs"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(total).bit_length()))
    codes = spark.sparkContext.broadcast(_list_lengths(reps, bits))
    postings = reps.mapInArrow(_lister(codes, s, hits, *pieces[:2]), "member long, piece long, n int, id long, role tinyint, parts tinyint")
    postings = postings.repartition("member", "piece").sortWithinPartitions("member", "piece", "n", "id", "role")
    lists = "q long, slot int, tag tinyint, n int, list array<long>"
    met = postings.mapInArrow(_short_lists(s), lists).unionByName(reps.mapInArrow(_long_lists(codes, s, hits, pieces[1]), lists))
    buckets = -(-total // pieces[2]) or 1
    schema = "bucket int, tag tinyint, id long, n int, members array<long>, r array<long>, times array<int>"
    candidates = met.repartition("q", "slot").sortWithinPartitions("q", "slot", "tag").mapInArrow(_merger(s, hits, buckets), schema)
    indexed = reps.mapInArrow(_indexer(buckets), schema)
    pairs = candidates.unionByName(indexed).repartition("bucket").sortWithinPartitions("bucket", "tag").mapInArrow(_prober(s), "rep_a long, rep_b long, similarity double")
    return pairs, members


def _indexer(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pairs, k = b.column("id"), b.column("pairs"), b.num_rows
            empty = [pa.array([None] * k, pa.list_(t)) for t in (pa.int64(), pa.int32())]
            columns = [pa.array(_bucket(ids.to_numpy(), buckets), pa.int32()), pa.array(np.zeros(k), pa.int8()), ids, pa.array(np.diff(_list(pairs)[1]), pa.int32()), pairs, *empty]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "tag", "id", "n", "members", "r", "times"])

    return run


def catalog_sets(spark: SparkSession, folder: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """``id`` and ``pairs`` of the catalogue entries, null for fewer words; a row that comes again counts once."""
    rows = read_table(spark, folder, "corpus_catalog", "id", "transliteration").where("id is not null and transliteration is not null")
    texts = rows.groupBy("id").agg(F.any_value("transliteration").alias("text")).select("id", words(clean_text(F.col("text"))).alias("w"))
    return texts.select("id", F.when(F.size("w") >= least_words, word_pairs(F.col("w"))).alias("pairs"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs, members = near_duplicates(catalog_sets(spark, folder))
    a, b = (members.select(F.col("id").alias(f"id_{x}"), F.col("rep").alias(f"rep_{x}")) for x in "ab")
    between = pairs.join(a, "rep_a").join(b, "rep_b")
    within = a.join(b, F.col("rep_a") == F.col("rep_b")).where("id_a < id_b")
    return between.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).unionByName(within.select("id_a", "id_b"))


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry with enough words and the smallest id of its class: entries alike directly or over others."""
    pairs, members = near_duplicates(catalog_sets(spark, folder))
    groups = connected_components(pairs.select("rep_a", "rep_b"), "rep_a", "rep_b").withColumnRenamed("id", "rep")
    return members.join(groups, "rep", "left").select("id", F.coalesce("group", "rep").alias("class_id"))


_PAIRS = f"""
r as (select id, {words_sql(clean_sql('any_value(transliteration)'))} as w from corpus_catalog where transliteration is not null group by id),
s as (select id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as g from r where len(w) >= {LEAST_WORDS}),
c as (select id, count(*) as n from s group by id),
o as (select a.id as id_a, b.id as id_b, count(*) as n from s a join s b on a.g = b.g and a.id < b.id group by all),
found as (select o.id_a, o.id_b from o join c x on x.id = o.id_a join c y on y.id = o.id_b where 3 * o.n >= x.n + y.n)
"""

QUERIES = {"p6_found": p6_found, "p6_classes": p6_classes}
SQL = {
    "p6_found": "with" + _PAIRS + "select id_a, id_b from found",
    "p6_classes": "with recursive" + _PAIRS + """,
e as (select id_a as a, id_b as b from found union select id_b, id_a from found),
t(id, other) as (select id, id from c union select t.id, e.b from t join e on e.a = t.other)
select id, min(other) as class_id from t group by id
""",
}
