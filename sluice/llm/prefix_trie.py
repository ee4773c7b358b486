"""Conversation prefix trie: rolling fingerprints, verified groups, parents rolled up."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import columns, materialise, table

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Depths of one conversation that are summed in one task.
BLOCK_DEPTHS = 1024
#: Bytes of comma-joined ids in one row on their way to a digest.
CHUNK_BYTES = 1 << 16


def power(n: np.ndarray) -> np.ndarray:
    """K.BASE**n modulo 2**64."""
    out, square, n = np.ones(len(n), np.uint64), K.BASE, n.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        while n.any():
            out[(n & 1) == 1] *= np.uint64(square)
            square = square * square % (1 << 64)
            n >>= 1
    return out


def _scan_pieces(batches):
    """Arrow task over sorted rows: each row's number and prefix fingerprint within what this task holds of its conversation.

    A prefix's fingerprint is the sum of its turns' hashes, each times the base to the
    number of turns after it; sums over a batch come from one numpy scan.
    """
    part = TaskContext.get().partitionId()
    key, count, carried = None, 0, np.uint64(0)
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        conv = np.asarray(b.column("conv_id"))
        h = np.asarray(b.column("_hash")).view(np.uint64)
        up, down = K.powers(n)
        first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        start = np.repeat(first, np.diff(np.r_[first, n]))
        at = np.arange(n) - start + 1
        with np.errstate(over="ignore"):
            total = np.cumsum(h * down[:n], dtype=np.uint64)
            before = np.where(start > 0, total[start - 1], np.uint64(0))
            print_ = (total - before) * up[:n]
            if key == conv[0]:
                own = start == 0
                print_[own] += carried * power(at[own])
                at[own] += count
            last = np.r_[np.uint64(0), print_[:-1]]
            last[first] = 0
            if key == conv[0]:
                last[0] = carried
        key, count, carried = conv[-1], int(at[-1]), print_[-1]
        yield pa.RecordBatch.from_arrays([*(b.column(x) for x in b.schema.names if x != "_hash"), pa.array(np.full(n, part, np.int64)), pa.array(at), pa.array(print_.view(np.int64)), pa.array(last.view(np.int64))], [*(x for x in b.schema.names if x != "_hash"), "_part", "_at", "_print", "_last"])


def _carry_on(key, pieces):
    """What precedes each later piece of one conversation: number of rows and fingerprint. Pieces are no more than partitions."""
    rows = sorted(zip(*(pieces.column(c).to_pylist() for c in ("_part", "n", "print")), strict=True))
    count, print_, out = 0, 0, []
    for part, n, own in rows:
        out.append((part, key[0].as_py(), count, print_ - (1 << 64) if print_ >> 63 else print_))
        count, print_ = count + n, (print_ * pow(K.BASE, n, 1 << 64) + own) % (1 << 64)
    cols = list(zip(*out, strict=True))
    return pa.table([pa.array(c, pa.int64()) for c in cols], ["_part", "conv_id", "_before", "_carried"])


def _join_pieces(bits: int):
    def run(batches):
        for b in batches:
            at = np.asarray(b.column("_at"))
            carried = np.asarray(b.column("_carried")).view(np.uint64)
            with np.errstate(over="ignore"):
                now = np.asarray(b.column("_print")).view(np.uint64) + carried * power(at)
                last = np.asarray(b.column("_last")).view(np.uint64) + carried * power(at - 1)
            now, last = (x >> np.uint64(64 - bits) if bits < 64 else x for x in (now, last))
            depth = at + np.asarray(b.column("_before"))
            last = np.where(depth == 1, np.uint64(0), last)
            names = [x for x in b.schema.names if not x.startswith("_")]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(depth), pa.array(now.view(np.int64)), pa.array(last.view(np.int64))], [*names, "depth", "print", "last_print"])

    return run


def scan(turns: DataFrame, order: list[str], bits: int = 64) -> DataFrame:
    """turns (conv_id, role, text and the columns of order) with depth, print and last_print.

    Rows are dealt by ranges of conversation and order, so that a conversation of any
    length is many tasks; those that span partitions (as many as there are
    partitions, at most) then take what precedes them. bits shortens fingerprints, for tests.
    """
    names = ["conv_id", "role", "text"]
    by = ["conv_id", *order]
    dealt = turns.withColumn("_hash", F.xxhash64("role", "text")).repartitionByRange(*by).sortWithinPartitions(*by).select(*names, "_hash")
    pieces = materialise(dealt.mapInArrow(_scan_pieces, "conv_id long, role string, text string, _part long, _at long, _print long, _last long"), "pieces")
    ends = pieces.groupBy("conv_id", "_part").agg(F.max("_at").alias("n"), F.max_by("_print", "_at").alias("print"))
    cut = materialise(ends.withColumn("m", F.count("*").over(Window.partitionBy("conv_id"))).where("m > 1").drop("m"), "cut")
    carried = materialise(cut.groupBy("conv_id").applyInArrow(_carry_on, "_part long, conv_id long, _before long, _carried long"), "carried")
    zero = F.lit(0).cast("long")
    joined = pieces.join(F.broadcast(carried), ["conv_id", "_part"], "left").withColumns({c: F.coalesce(F.col(c), zero) for c in ("_before", "_carried")})
    joined = joined.select(*names, "_at", "_print", "_last", "_before", "_carried")
    return joined.mapInArrow(_join_pieces(bits), "conv_id long, role string, text string, depth long, print long, last_print long")


def _verified(groups: dict, key, last, role, text, conv):
    """Put a row to the turn that it equals, compared with its group's representative first, then with those split from it."""
    own = groups.setdefault(key, [])
    for turn in own:
        if turn[0] == last and turn[2] == text and turn[1] == role:
            turn[3] = min(turn[3], conv)
            return
    own.append([last, role, text, conv])


TURN = ("depth", "print", "last_print", "role", "text", "conv_id")
TURNS = "depth long, print long, last_print long, role string, text string, conv_id long"


def _collapse(batches):
    """Arrow task: of the rows of a batch that are verified as equal, one."""
    for b in batches:
        groups: dict = {}
        for d, p, last, role, text, conv in zip(*(b.column(c).to_pylist() for c in TURN), strict=True):
            _verified(groups, (d, p), last, role, text, conv)
        rows = [(*key, *turn) for key, own in groups.items() for turn in own]
        yield pa.RecordBatch.from_pylist([dict(zip(TURN, r, strict=True)) for r in rows], pa.schema([(c, pa.string() if c in ("role", "text") else pa.int64()) for c in TURN]))


def _split(batches):
    """Arrow task over sorted rows: turns that don't equal the representative of their group, numbered from 1."""
    kept, key = {}, None
    schema = pa.schema([(c, pa.string() if c in ("role", "text") else pa.int64()) for c in TURN] + [("split", pa.int64())])

    def others():
        return [dict(zip(schema.names, (*key, *turn, k), strict=True)) for k, turn in enumerate(kept.get(key, ())) if k]

    for b in batches:
        out = []
        for d, p, last, role, text, conv in zip(*(b.column(c).to_pylist() for c in TURN), strict=True):
            if key != (d, p):
                out += others()
                kept, key = {}, (d, p)
            _verified(kept, key, last, role, text, conv)
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist(others(), schema)


def verify(scanned: DataFrame) -> DataFrame:
    """Prefixes with path and last_path: which splits their conversation has been through, up to here and up to the turn before.

    Two conversations share a prefix if and only if depth, print and path are equal:
    then their last turns and fingerprints before are equal, and so on down to the root.
    Splits come from collisions of fingerprints, so there are hardly ever any.
    """
    few = scanned.select(*TURN).mapInArrow(_collapse, TURNS)
    splits = materialise(few.repartition("depth", "print").sortWithinPartitions("depth", "print", "conv_id").mapInArrow(_split, f"{TURNS}, split long"), "splits")
    kept = ["conv_id", "depth", "print", "last_print", F.octet_length("text").cast("long").alias("n_bytes")]
    if splits.isEmpty():
        return scanned.select(*kept).withColumns({"path": F.lit(""), "last_path": F.lit("")})
    through = scanned.join(splits.drop("conv_id"), ["depth", "print", "last_print", "role", "text"]).select("conv_id", F.col("depth").alias("at"), "split")
    through = materialise(through, "through")
    met = scanned.select(*kept).join(through, "conv_id", "left").where("at IS NULL OR at <= depth")
    step = F.when(F.col("at").isNotNull(), F.struct("at", "split"))
    paths = met.groupBy("conv_id", "depth").agg(F.array_sort(F.collect_list(step)).alias("p"))
    spell = lambda p: F.array_join(F.transform(p, lambda s: F.concat_ws(":", s["at"].cast("string"), s["split"].cast("string"))), ",")
    paths = paths.select("conv_id", "depth", spell(F.col("p")).alias("path"), spell(F.filter("p", lambda s: s["at"] < F.col("depth"))).alias("last_path"))
    empty = F.lit("")
    return scanned.select(*kept).join(paths, ["conv_id", "depth"], "left").withColumns({"path": F.coalesce("path", empty), "last_path": F.coalesce("last_path", empty)})


def _chunks(batches):
    """Arrow task over sorted rows: the ids of each node, comma-joined, a bounded row at a time."""
    key, ids, size, first = None, [], 0, 0
    out: list[tuple] = []
    for b in batches:
        for d, p, path, conv in zip(*(b.column(c).to_pylist() for c in ("depth", "print", "path", "conv_id")), strict=True):
            if key != (d, p, path) or size > CHUNK_BYTES:
                if ids:
                    out.append((*key, first, ",".join(ids)))
                key, ids, size, first = (d, p, path), [], 0, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if out:
            yield _chunk_batch(out)
            out = []
    if ids:
        yield _chunk_batch([(*key, first, ",".join(ids))])


def _chunk_batch(rows):
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["depth", "print", "path", "first", "ids"])


def _digests(batches):
    """Arrow task over sorted chunks: one digest a node."""
    key, state = None, None
    names = ["depth", "print", "path", "ends_sha256"]
    schema = pa.schema([("depth", pa.int64()), ("print", pa.int64()), ("path", pa.string()), ("ends_sha256", pa.string())])
    for b in batches:
        out = []
        for d, p, path, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "print", "path", "ids")), strict=True):
            if key != (d, p, path):
                if state:
                    out.append(dict(zip(names, (*key, state.hexdigest()), strict=True)))
                key, state = (d, p, path), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, state.hexdigest()), strict=True))] if state else [], schema)


def ends(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, print, path, ends_sha256) of the nodes where conversations end; their ids are sorted by range, so a node's may be many tasks."""
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("depth", "print", "path"), "depth").alias("e")).select("conv_id", "e.*")
    none = convs.join(last.select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("print"), F.lit("").alias("path"))
    by = ["depth", "print", "path"]
    whole = last.unionByName(none).repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id")
    chunks = whole.mapInArrow(_chunks, "depth long, print long, path string, first long, ids string")
    return chunks.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(_digests, "depth long, print long, path string, ends_sha256 string")


def chain_totals(chains: DataFrame) -> DataFrame:
    """(conv_id, parent, top, saved, leaves) of chains, with the sums of all chains below them added.

    A chain is the nodes of one smallest member; it hangs from a node of its parent's.
    Pointers are doubled: after round k each chain has the sums of what is less
    than 2**k chains below it, and points 2**k chains up.
    """
    state = materialise(chains.withColumn("up", F.col("parent")), "chains")
    while not (live := state.where("up IS NOT NULL")).isEmpty():
        add = live.groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        above = state.where("up IS NOT NULL").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        moved = live.join(above, "up", "left").drop("up").withColumnRenamed("next", "up")
        now = moved.unionByName(state.where("up IS NULL")).join(add, "conv_id", "left")
        now = now.withColumns({"saved": F.col("saved") + F.coalesce("s", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("l", F.lit(0))}).drop("s", "l")
        state = materialise(now, "chains")
    return state.drop("up")


def prefix_trie(turns: DataFrame, convs: DataFrame, order: list[str], bits: int = 64) -> DataFrame:
    """Every distinct prefix of conversations, as a node with its parent and what its subtree holds.

    turns has conv_id, role, text (none of them null) and the columns of order, which sort
    a conversation's turns; rows that agree in all of these are equal turns, one
    after another. convs holds each conv_id once, with those that have no turns. Returns
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256. No conversations: no nodes.

    Prefix fingerprints group candidates; turns of a group are compared with its
    representative's, first within the batch that holds them, so a first turn that a
    third of all conversations share is a row a batch when it is shuffled.
    """
    prefixes = materialise(verify(materialise(scan(turns, order, bits), "scanned")), "prefixes")
    by = ["depth", "print", "path"]
    found = prefixes.groupBy(*by).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("last_print").alias("last_print"), F.max("last_path").alias("last_path"))
    zero, empty = F.lit(0).cast("long"), F.lit("")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.withColumns({"depth": zero, "print": zero, "path": empty, "n_bytes": zero, "last_print": F.lit(None).cast("long"), "last_path": F.lit(None).cast("string")})
    found = materialise(found.unionByName(top), "found")
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("last_print"), F.col("path").alias("last_path"), F.col("conv_id").alias("parent_conv_id"))
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("last_print").alias("print"), F.col("last_path").alias("path")).agg(F.count("*").alias("n_children"))
    nodes = found.join(above, ["depth", "last_print", "last_path"], "left").join(children, by, "left").join(ends(prefixes, convs), by, "left")
    nodes = nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    )
    # From here on a node is its smallest member and depth.
    nodes = materialise(nodes.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")), "nodes")
    chains = nodes.groupBy("conv_id").agg(F.min_by("parent_conv_id", "depth").alias("parent"), F.min("depth").alias("top"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))
    totals = chain_totals(chains)
    hung = totals.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    own = nodes.join(hung, ["conv_id", "depth"], "left").withColumns({"saved": F.col("saved") + F.coalesce("s", zero), "leaf": F.col("leaf") + F.coalesce("l", zero), "blk": F.floor(F.col("depth") / BLOCK_DEPTHS)}).drop("s", "l")
    own = materialise(own, "own")
    later = Window.partitionBy("conv_id").orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("conv_id", "blk").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l")).withColumns({"s": F.sum("s").over(later), "l": F.sum("l").over(later)}).where("s IS NOT NULL")
    down = Window.partitionBy("conv_id", "blk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = own.withColumns({"saved": F.sum("saved").over(down), "leaf": F.sum("leaf").over(down)}).join(blocks, ["conv_id", "blk"], "left")
    return summed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaf") + F.coalesce("l", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("s", zero)).alias("saved_tokens"), "ends_sha256",
    )


def share_heads(conversations: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): conversations rebuilt so that they share beginnings.

    Turns are ordered by turn (null first), then role and text, null ones empty; a
    conversation c begins with the first h turns of conversation c - c % every (all of
    them if fewer, none if it is absent), then has its own after its first h, where h is
    crc32 of the decimal c modulo most. Remainders are those of SQL, so they have c's sign. Rows of a null conv_id belong to no conversation.
    """
    turns = columns(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    convs = materialise(turns.select("conv_id").distinct(), "convs")
    rest = F.col("conv_id") % every
    numbered = materialise(scan(turns, ["turn", "role", "text"]).select("conv_id", "depth", "role", "text"), "numbered")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = numbered.where((rest == 0) | (F.col("depth") > h)).withColumn("own", F.lit(1))
    near = F.explode(F.array(*(F.lit(k).cast("long") for k in range(1 - every, every) if k)))
    heads = numbered.where((rest == 0) & (F.col("depth") < most)).withColumn("k", near).withColumn("conv_id", F.col("conv_id") + F.col("k"))
    heads = heads.where((rest == F.col("k")) & (F.col("depth") <= h)).drop("k").join(convs, "conv_id", "left_semi").withColumn("own", F.lit(0))
    return own.unionByName(heads), convs


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt to share heads."""
    turns, convs = share_heads(table(spark, sf_dir, "conversations"))
    return prefix_trie(turns, convs, ["own", "depth"])


OP13_SQL = r"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
digits AS (SELECT conv_id, unnest(range(0, len(CAST(conv_id AS VARCHAR)) + 1)) AS p FROM ids),
sums(conv_id, p, s) AS (SELECT conv_id, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL SELECT conv_id, p + 1, xor(t[xor(s, ascii(substr(CAST(conv_id AS VARCHAR), p + 1, 1))) % 256 + 1], s // 256) FROM sums, crc WHERE p < len(CAST(conv_id AS VARCHAR))),
h AS (SELECT conv_id, xor(arg_max(s, p), 4294967295) % 9 AS h FROM sums GROUP BY conv_id),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT h.conv_id, 0 AS own, n, role, text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5 AND n <= h
      UNION ALL SELECT h.conv_id, 1, n, role, text FROM h JOIN o ON o.conv_id = h.conv_id AND n > h),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY own, n) AS l FROM b GROUP BY conv_id
      UNION ALL SELECT conv_id, [] FROM ids WHERE conv_id NOT IN (SELECT conv_id FROM b)),
p AS (SELECT conv_id, d, l[1:d] AS x, len(l) = d AS ends FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM c)),
node AS (SELECT x, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(octet_length(encode(x[d].t))), 0) AS saved,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY x),
up AS (SELECT a.conv_id, a.depth, q.conv_id AS parent_conv_id FROM node a JOIN node q ON q.depth = a.depth - 1 AND q.x = a.x[1 : a.depth - 1]),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY 1, 2),
below AS (SELECT a.conv_id, a.depth, sum(u.saved) AS saved_tokens, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves
          FROM node u JOIN p ON p.conv_id = u.conv_id AND p.d <= u.depth JOIN node a ON a.x = p.x LEFT JOIN kids k ON k.conv_id = u.conv_id AND k.depth = u.depth GROUP BY 1, 2)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM node LEFT JOIN up USING (conv_id, depth) LEFT JOIN kids USING (conv_id, depth) JOIN below USING (conv_id, depth)
"""
