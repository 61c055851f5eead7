"""Suppression of overlapping detections."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tellstone.constants import OVERLAP_LIMIT
from tellstone.functions.vectors import iou
from tellstone.session import Scratch

#: Boxes of one image that one task decides in sequence in a round.
ROUND_BOXES = 8192
#: Side of a cell of the grid in which boxes meet.
CELL = 128


def greedy_keep(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, limit: float) -> np.ndarray:
    """Which boxes stay if each, in order, goes when it overlaps a kept one by more than ``limit``."""
    keep = np.zeros(len(x), bool)
    for i in range(len(x)):
        k = np.flatnonzero(keep)
        both = np.clip(np.minimum(x[k] + w[k], x[i] + w[i]) - np.maximum(x[k], x[i]), 0, None) * np.clip(np.minimum(y[k] + h[k], y[i] + h[i]) - np.maximum(y[k], y[i]), 0, None)
        union = w[k] * h[k] + w[i] * h[i] - both
        keep[i] = not (both > limit * union).any()
    return keep


def suppressed(detections: DataFrame, limit: float = OVERLAP_LIMIT, round_boxes: int = ROUND_BOXES) -> DataFrame:
    """Detections (image, id, x, y, w, h, confidence) that stay under greedy suppression.

    By falling confidence, then id, a box stays if it overlaps no box that stays by more
    than ``limit`` (intersection over union). The order lets rounds be exact: the first
    ``round_boxes`` undecided boxes of each image are decided in sequence by one task, then
    all others that overlap a kept one go, in parallel, meeting in cells of a grid; so an image with very
    many boxes never is one task's work. A box of a null or empty image is of an image that isn't known, overlaps nothing and stays. Boxes with a null coordinate or size
    or confidence are left out. An empty input gives no rows.
    """
    scratch = Scratch(detections.sparkSession, "boxes")
    columns = ["image", "id", "x", "y", "w", "h", "confidence"]
    rows = detections.select(F.coalesce("image", F.lit("")).alias("image"), *columns[1:]).dropna(subset=["x", "y", "w", "h", "confidence"])
    unknown = rows.where("image = ''").withColumn("image", F.lit(None).cast("string"))
    todo, kept = scratch.write(rows.where("image <> ''")), unknown
    types = dict(rows.dtypes)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Boxes that stay; those of an image follow each other, in order."""
        held = None
        for batch in itertools.chain(batches, [None]):
            table = pa.Table.from_batches([b for b in (held, batch) if b is not None]) if held is not None or batch is not None else None
            if table is None or not table.num_rows:
                continue
            whole = table.combine_chunks().to_batches()[0]
            images = whole.column("image").dictionary_encode().indices.to_numpy()
            cuts = np.r_[0, np.flatnonzero(images[1:] != images[:-1]) + 1, len(images)]
            if batch is not None:  # the last image may go on in the next batch
                held = whole.slice(cuts[-2])
                cuts = cuts[:-1]
            sides = [whole.column(c).to_numpy().astype(float) for c in ("x", "y", "w", "h")]
            keep = np.zeros(len(images), bool)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                keep[lo:hi] = greedy_keep(*(v[lo:hi] for v in sides), limit)
            if keep.any():
                yield whole.filter(pa.array(keep))

    while not todo.isEmpty():
        place = F.row_number().over(W.partitionBy("image").orderBy(F.desc("confidence"), "id"))
        first = todo.withColumn("place", place).where(F.col("place") <= round_boxes).drop("place")
        first = scratch.write(first)
        ordered = first.repartition("image").sortWithinPartitions("image", F.desc("confidence"), "id").select(*columns)
        stays = scratch.write(ordered.mapInArrow(decide, ", ".join(f"{c} {types[c]}" for c in columns)))
        kept = kept.unionByName(stays)
        last = first.groupBy("image").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= round_boxes).select("image")
        rest = todo.join(last, "image", "left_semi").join(first.select("image", "id"), ["image", "id"], "left_anti")
        cells = lambda df: df.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x") / CELL), F.floor((F.col("x") + F.greatest("w", F.lit(0))) / CELL)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y") / CELL), F.floor((F.col("y") + F.greatest("h", F.lit(0))) / CELL))))
        other = cells(stays.select("image", *[F.col(c).alias(f"k_{c}") for c in "xywh"], "x", "y", "w", "h")).select("image", "cx", "cy", *[f"k_{c}" for c in "xywh"])
        overlap = iou(*[F.col(c) for c in "xywh"], *[F.col(f"k_{c}") for c in "xywh"]) > limit
        gone = cells(rest).join(other, ["image", "cx", "cy"]).where(overlap).select("image", "id").distinct()
        todo = scratch.write(rest.join(gone, ["image", "id"], "left_anti"))
    return kept
