"""Sharding by histogram sort: probe, count exact bytes, refine, exchange once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

SHARDS = 24
#: Splitters may miss their target by this share of a shard.
TOLERANCE = 0.001
#: Candidate keys that each splitter tries in a round.
PROBES = 31
#: Bytes that a cell of a shard has at about; slots are numbered within cells.
CELL_BYTES = 4 << 20
#: A group of equal texts stays whole up to this share of a shard, or up to the size of the largest row.
GROUP_TOLERANCE = 0.02
#: Cells that are divided further are broadcast up to this many; beyond, they are joined by shuffle.
BROADCAST_CELLS = 1 << 17

OFFSET = 1 << 63
ONE = 1 << 64


def _counter(probes: list[tuple[int, int]]):
    """Arrow task: bytes and rows between successive probes; keys are pairs compared in order."""
    ph, pt = np.array([p[0] for p in probes], np.int64), np.array([p[1] for p in probes], np.int64)

    def run(batches):
        size, rows = np.zeros(len(ph) + 1, np.int64), np.zeros(len(ph) + 1, np.int64)
        for b in batches:
            h, t = b.column("h").to_numpy(zero_copy_only=False), b.column("t").to_numpy(zero_copy_only=False)
            at, end = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
            for i in np.unique(at[end > at]).tolist():
                j = int(np.searchsorted(ph, ph[i], "right"))
                own = (at == i) & (end == j)
                at[own] = i + np.searchsorted(pt[i:j], t[own], "right")
            np.add.at(size, at, b.column("size").to_numpy(zero_copy_only=False))
            rows += np.bincount(at, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), pa.array(rows[full])], ["bucket", "size", "rows"])

    return run


def _pair(key: int) -> tuple[int, int]:
    return (key >> 64) - OFFSET, (key & (ONE - 1)) - OFFSET


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE) -> tuple[list[tuple[int, int]], int, bool]:
    """n_shards - 1 keys that divide the bytes evenly, the bytes of all, and whether equal keys would have to be cut.

    Each splitter has a bracket, the exact bytes below its ends, and the rows
    inside. A round sends PROBES keys for each open bracket to all partitions,
    which return bytes and rows between successive probes, and narrows the
    brackets. Probes fall between text hashes until a bracket is one group of equal texts.
    A group that is no larger than what a shard may be off by (group_tolerance of a shard,
    or the largest row) is not entered: the splitter takes its nearer edge. Otherwise a
    splitter is settled when an end is within tolerance of its target, or when its
    bracket holds one row or one key.
    """
    total, n_rows, largest = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    targets = [total * i / n_shards for i in range(1, n_shards)]
    slack, whole = tolerance * total / n_shards, max(group_tolerance * total / n_shards, largest)
    # Marks (key, bytes below, rows below): the ends of each bracket.
    brackets = [((0, 0, 0), (ONE * ONE, total, n_rows)) for _ in targets]
    open_ = [i for i in range(len(targets)) if n_rows]
    stuck = False
    while open_:
        probes = set()
        for i in open_:
            lo, hi = (m[0] for m in brackets[i])
            for k in range(1, PROBES + 1):
                p = lo + (hi - lo) * k // (PROBES + 1)
                p = p >> 64 << 64 if hi - lo > ONE else p
                if lo < p < hi:
                    probes.add(p)
        probes = sorted(probes)
        got = {r["bucket"]: (r["s"], r["n"]) for r in keys.mapInArrow(_counter([_pair(p) for p in probes]), "bucket long, size long, rows long").groupBy("bucket").agg(F.sum("size").alias("s"), F.sum("rows").alias("n")).collect()}
        below, ranks, s, n = [], [], 0, 0
        for k in range(len(probes)):
            s, n = s + got.get(k, (0, 0))[0], n + got.get(k, (0, 0))[1]
            below.append(s), ranks.append(n)
        still = []
        for i in open_:
            lo, hi = brackets[i]
            marks = [lo, *(m for m in zip(probes, below, ranks, strict=True) if lo[0] < m[0] < hi[0]), hi]
            k = max(k for k, m in enumerate(marks[:-1]) if m[1] <= targets[i])
            lo, hi = brackets[i] = marks[k], marks[k + 1]
            miss, group = min(targets[i] - lo[1], hi[1] - targets[i]), hi[1] - lo[1]
            if miss <= slack or hi[2] - lo[2] <= 1 or hi[0] - lo[0] == ONE and group <= whole:
                continue
            if hi[0] - lo[0] > 1:
                still.append(i)
            else:
                stuck |= group > whole
        open_ = still
    ends = [lo if t - lo[1] <= hi[1] - t else hi for (lo, hi), t in zip(brackets, targets, strict=True)]
    return [_pair(min(m[0], ONE * ONE - 1)) for m in ends], total, stuck


def shard(docs: DataFrame, n_shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size, shard (0 to n_shards - 1) and slot (gapless from 0 in each shard), near equal in bytes.

    A size is the UTF-8 bytes of the text (null: none) plus 8. Rows are ordered by a
    hash of the text, then by a hash of the id, so equal texts are neighbours. Their group
    stays in one shard unless it is larger than what a shard may be off by: at either end
    that is GROUP_TOLERANCE of its share, or the largest row. A larger group is cut where the bytes
    demand it, to within tolerance or one row. Rows equal in id and text (null ids too)
    are one key; if these alone are too many for that, rows are numbered, written
    once, and cut by number. An empty table gives an empty result. The added columns
    replace input columns of the same names.

    Slots need no shard in one task: each shard is divided into cells of the key's
    leading bits, of CELL_BYTES at about. A cell with more, as a hot text has, is
    divided by bits of the second hash, as many as its bytes demand. Cells are counted on the
    narrow keys, and the running count of a cell is added to the row number within it. The
    texts move in one exchange.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = ["size", "shard", "slot", "_h", "_t", "_hbin", "_tbin", "_bits", "_before", "_row"]
    rows = docs.drop(*own).withColumns({"size": (F.octet_length(text) + 8).cast("long"), "_h": F.xxhash64(text)})
    rows = rows.withColumn("_t", F.xxhash64(F.col(f"`{id_col}`"), F.col("_h")))
    narrow = [F.col("_h").alias("h"), F.col("_t").alias("t"), "size"]
    keys = materialise(rows.select(*narrow), "shard-keys")
    splitters, total, stuck = find_splitters(keys, n_shards, tolerance)
    if stuck:
        rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered").withColumn("_t", F.xxhash64("_t", "_row"))
        keys = materialise(rows.select(*narrow), "shard-keys")
        splitters, total, _ = find_splitters(keys, n_shards, tolerance)
    bits = max(1, min(40, math.ceil(math.log2(max(2, total / CELL_BYTES)))))

    def coarse(df, h, t):
        at = sum((F.when((h > a) | ((h == a) & (t >= b)), 1).otherwise(0) for a, b in splitters), F.lit(0))
        return df.withColumns({"shard": at.cast("int"), "_hbin": F.shiftright(h, 64 - bits)})

    marked = coarse(keys, F.col("h"), F.col("t"))
    # Log2 of how many cells a bin of more than two cells' bytes makes.
    deep = marked.groupBy("shard", "_hbin").agg(F.sum("size").alias("n")).where(F.col("n") > 2 * CELL_BYTES)
    deep = materialise(deep.select("shard", "_hbin", F.least(F.lit(40), F.ceil(F.log2(F.col("n") / CELL_BYTES))).cast("int").alias("_bits")), "cells")
    n_deep = deep.limit(BROADCAST_CELLS + 1).count()

    def cells(df, t):
        if n_deep:
            df = df.join(F.broadcast(deep) if n_deep <= BROADCAST_CELLS else deep, ["shard", "_hbin"], "left")
        else:
            df = df.withColumn("_bits", F.lit(None).cast("int"))
        # Two shifts, as one by 64 bits would be none.
        return df.withColumn("_tbin", F.coalesce(F.expr(f"shiftright(shiftright({t}, 63 - _bits), 1)"), F.lit(0).cast("long")))

    place = ["shard", "_hbin", "_tbin"]
    counts = cells(marked, "t").groupBy(*place).agg(F.count("*").alias("n"))
    run = Window.partitionBy("shard").orderBy("_hbin", "_tbin").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*place, F.coalesce(F.sum("n").over(run), F.lit(0)).alias("_before"))
    placed = cells(coarse(rows, F.col("_h"), F.col("_t")), "_t")
    numbered = placed.withColumn("slot", F.row_number().over(Window.partitionBy(*place).orderBy("_h", "_t", f"`{id_col}`")))
    placed = numbered.join(before.hint("merge"), place).withColumn("slot", F.col("slot") - 1 + F.col("_before"))
    return placed.select(*(F.col(f"`{c}`") for c in docs.columns if c not in own), "size", "shard", F.col("slot").cast("long").alias("slot"))


def op8_shard(spark, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards near equal in bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
