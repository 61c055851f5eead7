"""Problem 8: texts as the token ids of a public byte-level tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tellstone.sources.tables import read_table

#: Pieces longer than this many bytes are rows of their own, in which all places of the lowest rank merge in one round.
LONG_PIECE = 256
#: Characters of text, and different pieces kept, in one go.
SLICE_CHARS = 2_000_000
KEPT_PIECES = 300_000
_NONE = np.int32(2**31 - 1)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class BytePairEncoder:
    """Byte pair merges over numpy matrices.

    Pieces are grouped by length and padded to matrices of ids, a piece a row. In each
    round every row merges its leftmost pair of the lowest rank: ranks of pairs come from
    a hash table, the merged id takes the pair's place, and what follows moves up by one
    column. Rows without a pair left are done and leave the matrix.

    A long piece is a row of its own. Where ids are in the order of their merges, so that no pair
    with an id in it has a lower rank than the id (checked when the vocabulary is read), the
    row's next merges are all the places of the same pair, which then merge in one
    round, from the left: a round for each different rank instead of each merge.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        left, right = np.array(left, np.int64), np.array(right, np.int64)
        self.in_order = bool((np.maximum(left, right) < np.array(rank)).all())
        keys = left * self.size + right
        self._fill(keys, np.array(rank, np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressed hash table of at most a quarter full."""
        self.bits = int(np.ceil(np.log2(max(16, 4 * len(keys)))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        slot, at, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(at):
            self.probes += 1
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[at[free]]  # of several that want a slot the last stays
            won = self.keys[slot] == keys[at]
            self.values[slot[won]] = values[at[won]]
            slot, at = (slot[~won] + 1) & (len(self.keys) - 1), at[~won]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or the largest int where there is none; negative ids are padding."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], _NONE)
        open_ = np.flatnonzero((self.keys[slot].ravel() != keys.ravel()) & (self.keys[slot].ravel() >= 0) & (keys.ravel() >= 0))
        flat, s, k = out.ravel(), slot.ravel()[open_], keys.ravel()[open_]
        while len(open_):
            s = (s + 1) & (len(self.keys) - 1)
            here = self.keys[s]
            hit = here == k
            flat[open_[hit]] = self.values[s[hit]]
            more = ~hit & (here >= 0)
            open_, s, k = open_[more], s[more], k[more]
        return flat.reshape(out.shape)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and where each piece begins (one more entry at the end)."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            width = int(lengths[order[at]])
            if width > LONG_PIECE:
                for i in order[at:]:
                    ids = self._long_row(flat[starts[i] : starts[i] + lengths[i]])
                    found.append((np.array([i]), np.array([len(ids)]), ids))
                break
            upto = max(width, min(LONG_PIECE, width + width // 4))  # a bucket holds pieces of similar length
            end = min(int(np.searchsorted(lengths[order], upto, side="right")), at + max(1, 4_000_000 // max(1, upto)))
            rows = order[at:end]
            at = end
            width = int(lengths[rows].max(initial=0))
            cols = np.arange(width)
            inside = cols < lengths[rows][:, None]
            ids = np.where(inside, flat[np.minimum(starts[rows][:, None] + cols, max(0, len(flat) - 1))], -1) if width else np.zeros((len(rows), 0), np.int32)
            self._rounds(rows, ids.astype(np.int32), found)
        count = np.zeros(len(pieces), np.int64)
        for rows, n, _ in found:
            count[rows] = n
        begins = np.r_[0, np.cumsum(count)]
        out = np.empty(begins[-1], np.int32)
        for rows, n, ids in found:
            out[np.repeat(begins[rows] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, begins

    def _rounds(self, rows: np.ndarray, ids: np.ndarray, found: list) -> None:
        rank = self.ranks(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.zeros((len(rows), 0), np.int32)
        while True:
            best = rank.min(axis=1) if rank.shape[1] else np.full(len(rows), _NONE)
            done = best == _NONE
            if done.any():
                part = ids[done]
                real = part >= 0
                found.append((rows[done], real.sum(axis=1), part[real]))
                rows, ids, rank, best = rows[~done], ids[~done], rank[~done], best[~done]
            if not len(rows):
                return
            line, at = np.arange(len(rows)), rank.argmin(axis=1)
            ids[line, at] = best
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), axis=1) if len(cols) else rank[:, :0]
            if rank.shape[1]:
                for near in (at - 1, at):
                    ok = (near >= 0) & (near < rank.shape[1])
                    r, c = line[ok], near[ok]
                    rank[r, c] = self.ranks(ids[r, c], ids[r, c + 1])

    def _long_row(self, ids: np.ndarray) -> np.ndarray:
        rank = self.ranks(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != _NONE:
            at = np.flatnonzero(rank == best) if self.in_order else rank.argmin(keepdims=True)
            # of places that overlap (a run of one id) every other one merges, from the left
            begin = np.r_[True, np.diff(at) > 1]
            order = np.arange(len(at))
            at = at[(order - np.maximum.accumulate(np.where(begin, order, 0))) % 2 == 0]
            ids = ids.copy()
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep[1:]]
            now = at - np.arange(len(at))  # places of the merged ids after closing up
            near = np.unique(np.r_[now - 1, now])
            near = near[(near >= 0) & (near < len(rank))]
            rank[near] = self.ranks(ids[near], ids[near + 1])
        return ids


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(path)


class TextEncoder:
    """Splits texts into pieces and encodes each different piece once."""

    def __init__(self, path: str, pattern: str):
        self.encoder, self.split = encoder(path), regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.ids, self.begins = np.empty(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins (one more entry at the end)."""
        if len(self.seen) > KEPT_PIECES:
            self._forget()
        pieces = [self.split(t) if t else [] for t in texts]
        flat = [p for one in pieces for p in one]
        new = [p for p in dict.fromkeys(flat) if p not in self.seen]
        if new:
            ids, begins = self.encoder.encode([p.encode("utf-8") for p in new])
            self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new))))
            self.begins = np.r_[self.begins[:-1], begins + len(self.ids)]
            self.ids = np.r_[self.ids, ids]
        at = np.fromiter(map(self.seen.__getitem__, flat), np.int64, len(flat))
        n = self.begins[at + 1] - self.begins[at]
        upto = np.r_[0, np.cumsum(n)]
        out = self.ids[np.repeat(self.begins[at] - upto[:-1], n) + np.arange(upto[-1])]
        return out, upto[np.r_[0, np.cumsum([len(p) for p in pieces], dtype=np.int64)]]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about SLICE_CHARS characters."""
    part, size, first = [], 0, 0
    for i, t in enumerate(texts):
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= SLICE_CHARS:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def _coder(name: str, pattern: str, lengths_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TextEncoder(SparkFiles.get(name), pattern)
        for batch in batches:
            others = batch.select(range(1, batch.num_columns))
            for first, texts in _slices(batch.column(0)):
                ids, begins = encode(texts)
                made = pa.array(np.diff(begins), pa.int32()) if lengths_only else pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
                rest = others.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*rest.columns, made], names=[*map(str, range(rest.num_columns)), "made"])

    return run


def encoded(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None, lengths_only: bool = False) -> DataFrame:
    """All columns but ``text``, and ``out``: the ids of the text, or only their number.

    Whole texts are encoded as stored; strings that look like special tokens are
    ordinary text. Null and empty text gives an empty list (or 0). A column that
    already has the name ``out`` is replaced. Equal rows give equal rows; an empty input gives none.
    ``path`` names a vocabulary file that the driver can read; executors get it from there.
    """
    rest = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(out, T.IntegerType() if lengths_only else T.ArrayType(T.IntegerType()))])
    path = path or vocabulary_path()
    df.sparkSession.sparkContext.addFile(path)
    run = _coder(os.path.basename(path), pattern or split_pattern(), lengths_only)
    return df.select(text, *rest).mapInArrow(run, schema)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(read_table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
