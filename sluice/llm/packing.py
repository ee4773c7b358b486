"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.streaming.bounded import settings

from .common import materialise, materialise_bucketed, table

CAPACITY = 2048
SEPARATOR = 0
#: Buckets of token ids at most, as Spark allows by default.
MAX_BUCKETS = 100_000
#: Pieces that one island packs; a longer list is divided into blocks of about so many.
BLOCK_ITEMS = 4096
ISLANDS = 3
EPOCHS = 3
GENERATIONS = 12
POPULATION = 6
ELITES = 2
#: Bins filled less than this are packed again with those of other blocks.
LOOSE = 0.985

_tokenizers: dict[str, tuple] = {}


def load_tokenizer(path: str):
    """(fast, exact, special): two encoders of one vocabulary file, and the strings that only the exact one knows.

    The fast encoder is built from the file's own vocabulary, whose ids are its merge
    ranks; the exact one reads the file itself and takes texts that spell a special token.
    """
    if path not in _tokenizers:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Byte-level vocabularies print bytes as characters: those that show as themselves, others from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _tokenizers[path] = fast, Tokenizer.from_file(path), special
    return _tokenizers[path]


def encode(path: str, text: str) -> np.ndarray:
    fast, exact, special = load_tokenizer(path)
    if any(s in text for s in special):
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)


def _cutter(path: str, capacity: int, separator: int):
    """Arrow task: the pieces of each document with their token ids."""

    def run(batches):
        end_mark = int(separator).to_bytes(4, "little")
        for b in batches:
            ids_col, texts = b.column("doc_id"), b.column("text")
            rows: list[tuple] = []
            size = 0
            for doc_id, text in zip(ids_col.to_pylist(), texts.to_pylist(), strict=True):
                raw = encode(path, text or "").astype("<u4", copy=False).tobytes() + end_mark
                n = len(raw) // 4
                start, end, piece = 0, n % capacity or min(n, capacity), 0
                while start < n:
                    rows.append((doc_id, piece, start, end - start, raw if end - start == n else raw[4 * start : 4 * end]))
                    start, end, piece = end, end + capacity, piece + 1
                size += len(raw)
                if size > 8 << 20:
                    yield _piece_batch(rows, ids_col.type)
                    rows, size = [], 0
            if rows:
                yield _piece_batch(rows, ids_col.type)

    return run


def _piece_batch(rows, id_type):
    cols = list(zip(*rows, strict=True))
    kinds = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])


class Bins:
    """A packing: item lists with free space, found by best fit in constant time. Packings share lists, so these are replaced, not changed."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.cap = sizes, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self._cost: tuple[int, float] | None = None

    def add(self, items: list[int], free: int | None = None) -> None:
        self.items.append(items)
        self.free.append(self.cap - sum(self.sizes[i] for i in items) if free is None else free)

    def best_fit(self, items: list[int]) -> None:
        """Put items, in the order given, each into the fullest bin that takes it, or a new one."""
        self._cost = None
        by: dict[int, list[int]] = {}
        mask, least = 0, min((self.sizes[i] for i in items), default=0)
        for b, f in enumerate(self.free):
            if f >= least:
                by.setdefault(f, []).append(b)
        for f in by:
            mask |= 1 << f
        for i in items:
            s = self.sizes[i]
            m = mask >> s
            if m:
                f = s + (m & -m).bit_length() - 1
                own = by[f]
                b = own.pop()
                if not own:
                    mask ^= 1 << f
                self.items[b] = [*self.items[b], i]
            else:
                b, f = len(self.items), self.cap
                self.items.append([i])
                self.free.append(f)
            self.free[b] = f = f - s
            by.setdefault(f, []).append(b)
            mask |= 1 << f

    def cost(self) -> tuple[int, float]:
        """Fewer bins first; then fuller full bins, so that what is loose is together."""
        if self._cost is None:
            self._cost = len(self.items), -sum([((self.cap - f) / self.cap) ** 2 for f in self.free])
        return self._cost

    def genes(self) -> np.ndarray:
        out = np.zeros(len(self.sizes), np.int32)
        for b, own in enumerate(self.items):
            out[own] = b
        return out

    @classmethod
    def of(cls, sizes: list[int], capacity: int, genes: np.ndarray) -> Bins:
        new = cls(sizes, capacity)
        order = np.argsort(genes, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(genes[order])) + 1):
            new.add(own.tolist())
        return new


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Inject a section of b's well-filled bins into a; bins of a that share an item with them go, and their other items are placed by best fit, largest first."""
    full = sorted(range(len(b.items)), key=b.free.__getitem__)
    full = full[: max(1, len(full) * 3 // 4)]
    section = rng.sample(full, max(1, int(len(full) * rng.uniform(0.1, 0.5))))
    taken = {i for k in section for i in b.items[k]}
    child, displaced = Bins(a.sizes, a.cap), []
    for own, free in zip(a.items, a.free, strict=True):
        if taken.isdisjoint(own):
            child.add(own, free)
        else:
            displaced += [i for i in own if i not in taken]
    for k in section:
        child.add(b.items[k], b.free[k])
    child.best_fit(sorted(displaced, key=a.sizes.__getitem__, reverse=True))
    return child


def mutate(a: Bins, rng: random.Random) -> Bins:
    """Empty the loosest bins and a few others, and place their items again."""
    order = sorted(range(len(a.items)), key=a.free.__getitem__, reverse=True)
    gone = set(order[: 1 + len(order) // 50]) | set(rng.sample(order, min(len(order), 3)))
    child = Bins(a.sizes, a.cap)
    for k, own in enumerate(a.items):
        if k not in gone:
            child.add(own, a.free[k])
    loose = [i for k in gone for i in a.items[k]]
    rng.shuffle(loose)
    child.best_fit(sorted(loose, key=lambda i: -a.sizes[i] * rng.uniform(0.8, 1.0)))
    return child


def evolve(sizes: list[int], capacity: int, elites: list[np.ndarray], seed: int, generations: int = GENERATIONS) -> list[Bins]:
    """One epoch of an island: its best packings, best first. Stops at the lower bound."""
    rng = random.Random(seed)
    bound = -(-sum(sizes) // capacity)
    people = [Bins.of(sizes, capacity, g) for g in elites]
    while len(people) < POPULATION:
        new = Bins(sizes, capacity)
        noise = 0.0 if not people else 0.05 * len(people)
        new.best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i] * (1 - noise * rng.random()), i)))
        people.append(new)
        if len(new.items) == bound:
            break
    for _ in range(generations):
        people.sort(key=Bins.cost)
        if len(people[0].items) == bound:
            break
        children = [crossover(*rng.sample(people, 2), rng) for _ in range(POPULATION // 2)]
        children += [mutate(p, rng) for p in people[:2]]
        people = sorted(people + children, key=Bins.cost)[:POPULATION]
    return sorted(people, key=Bins.cost)[:ELITES]


STATE = "block long, island int, bound int, bins int, pids binary, sizes binary, elites binary"


def _state(block, island, pids, sizes, people, capacity) -> dict:
    return {"block": block, "island": island, "bound": -(-int(sizes.sum()) // capacity), "bins": len(people[0].items), "pids": pids.tobytes(), "sizes": sizes.tobytes(), "elites": np.concatenate([p.genes() for p in people]).tobytes()}


def _start(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        pdf = pdf.sort_values("pid")
        sizes = pdf["length"].to_numpy(np.int64)
        people = evolve(sizes.tolist(), capacity, [], block * 64 + island)
        return pd.DataFrame([_state(block, island, pdf["pid"].to_numpy(np.int64), sizes, people, capacity)])

    return run


def _epoch(capacity: int, epoch: int):
    """Each row is an island's state with the elites that came from its neighbour."""

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                sizes = np.frombuffer(r.sizes, np.int64)
                genes = [g for e in (r.elites, r.migrants) for g in np.frombuffer(e, np.int32).reshape(-1, len(sizes))]
                people = evolve(sizes.tolist(), capacity, genes, (epoch * 1_000_003 + r.block) * 64 + r.island)
                out.append(_state(r.block, r.island, np.frombuffer(r.pids, np.int64), sizes, people, capacity))
            if out:
                yield pd.DataFrame(out)

    return run


def _unpack(capacity: int):
    """The best packing of each block: a row for each item."""

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                pids, sizes = np.frombuffer(r.pids, np.int64), np.frombuffer(r.sizes, np.int64)
                genes = np.frombuffer(r.elites, np.int32)[: len(pids)]
                order = np.argsort(genes, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.searchsorted(genes[order], genes[order])
                offset = ends - sizes[order] - (ends - sizes[order])[first]
                fill = np.bincount(genes, weights=sizes, minlength=genes.max() + 1)[genes[order]]
                yield pd.DataFrame({"block": r.block, "bin": genes[order], "pid": pids[order], "length": sizes[order], "offset": offset, "fill": fill.astype(np.int64)})

    return run


def pack_block_items(items: DataFrame, capacity: int, n_blocks: int) -> DataFrame:
    """(block, bin, pid, length, offset, fill) of items (pid, length): blocks of bounded size, each packed by islands that send their elites round a ring after each epoch."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("pid"), F.lit(n_blocks)))
    dealt = dealt.withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))))
    state = materialise(dealt.groupBy("block", "island").applyInPandas(_start(capacity), STATE), "islands")
    for epoch in range(1, EPOCHS):
        rough = state.where("bins > bound").select("block").distinct()
        if rough.isEmpty():
            break
        ring = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elites").alias("migrants"))
        moved = state.join(rough, "block").join(ring, ["block", "island"]).select(*state.columns, "migrants")
        done = state.join(rough, "block", "left_anti")
        state = materialise(done.unionByName(moved.repartition("block", "island").mapInPandas(_epoch(capacity, epoch), STATE)), "islands")
    best = state.groupBy("block").agg(F.min_by(F.struct("pids", "sizes", "elites"), F.struct("bins", "island")).alias("s")).select("block", "s.*")
    return best.mapInPandas(_unpack(capacity), "block long, bin long, pid long, length long, offset long, fill long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pack tokenised documents into sequences of at most capacity tokens.

    A document is its token ids and then the separator. A longer one is cut into pieces
    of capacity tokens, the first of which may be shorter; full pieces are
    sequences of their own, the rest are packed. Returns a row per piece: doc_id, piece,
    start, length, ids (unsigned 32-bit, little-endian; left out of the result if with_ids is false), ids_crc32, sequence_id, offset. Null
    and empty texts are the separator alone. Null ids and repeated rows are
    documents like others; extra columns are ignored; an empty table gives an
    empty result.

    Packing sees only (pid, length). Token ids are written once, in buckets by the task that
    made them, and stay there: the finished plan, a few numbers for each piece, is dealt
    to these buckets and joined in place, and the result written. The buckets need a session catalogue that can be written to. Loose bins of all blocks are pooled and packed again, in
    ever fewer blocks, so what blocks waste doesn't grow with their number.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    pieces = source.mapInArrow(_cutter(tokenizer, capacity, separator), f"doc_id {kind}, piece int, start long, length long, ids binary")
    # The upper bits of a generated id are the number of its task.
    pieces = pieces.withColumn("pid", F.monotonically_increasing_id()).withColumn("part", F.shiftright("pid", 33))
    # A bucket for each task that writes, so that none holds much more than a split of the input.
    n_parts = min(MAX_BUCKETS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    pieces = materialise_bucketed(pieces, "pieces", "part", n_parts, "zstd")
    loose = pieces.where(F.col("length") < capacity).select("pid", "length")
    left, plans, level = loose.count(), [], 0
    while left:
        n_blocks = max(1, math.ceil(left / BLOCK_ITEMS))
        done = materialise(pack_block_items(loose, capacity, n_blocks), "packed")
        tight = done if n_blocks == 1 else done.where(F.col("fill") >= LOOSE * capacity)
        plans.append(tight.select("pid", ((F.col("block") * 1_000_000 + F.col("bin")) * 64 + 2 * level).alias("sequence_id"), "offset"))
        if n_blocks == 1:
            break
        again = done.where(F.col("fill") < LOOSE * capacity).select("pid", "length")
        n = again.count()
        if math.ceil(n / BLOCK_ITEMS) >= n_blocks:  # no fewer blocks: they stay as they are
            plans[-1] = done.select("pid", ((F.col("block") * 1_000_000 + F.col("bin")) * 64 + 2 * level).alias("sequence_id"), "offset")
            break
        loose, left, level = again, n, level + 1
    plan = None
    for p in plans:
        plan = p if plan is None else plan.unionByName(p)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    names = ["doc_id", "piece", "start", "length", *(["ids"] if with_ids else []), "ids_crc32"]
    if plan is None:
        return pieces.select(*names, (F.col("pid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    plan = plan.withColumn("part", F.shiftright("pid", 33))
    joined = pieces.join(plan.hint("shuffle_hash"), ["part", "pid"], "left").select(
        *names,
        F.coalesce("sequence_id", F.col("pid") * 2 + 1).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
    # The pieces' buckets are by part alone, which both sides of this join have to be told to make do with: written
    # here, so that the session's own setting holds again for whatever comes after.
    with settings(docs.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        return materialise(joined, "placed", "zstd")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids, and the documents in them by offset. A sequence is bounded by the capacity."""
    part = F.struct("offset", "length", "doc_id", "piece", "ids")
    got = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return got.select(
        "sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"),
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("documents"))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
