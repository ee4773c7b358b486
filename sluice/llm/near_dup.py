"""N-gram Jaccard self-join by MinHash banding."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import keep_rows, materialise, table

WORDS = 5
THRESHOLD = 0.8
#: Share of pairs at exactly the threshold that must become candidates.
RECALL = 0.9999
#: Candidate clusters are compared in tiles of about so many sets or hashes a side.
TILE_SETS = 1024
TILE_HASHES = 1 << 20
#: Ids of candidates are broadcast to filter the second scan up to this count.
BROADCAST_IDS = 1 << 20


def choose_bands(threshold: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective rows for which bands * rows stay in max_hashes.

    A pair of similarity s meets in some band with 1 - (1 - s**rows)**bands, so
    bands is the least count that reaches recall at the threshold itself; pairs
    above it do better.
    """
    best = (max_hashes, 1)
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def set_key(grams: np.ndarray) -> bytes:
    """128 bits that name a set of shingles: a sum and an exclusive-or of mixed hashes, and so in no order."""
    with np.errstate(over="ignore"):
        a = int(np.sum(K.mix(grams + np.uint64(0x51)), dtype=np.uint64))
    return a.to_bytes(8, "little") + int(np.bitwise_xor.reduce(grams, initial=np.uint64(0))).to_bytes(8, "little")


def _signer(n: int, bands: int, rows: int):
    """Arrow task: set key, size of the set and band hashes of each document; no band for a document without words."""

    def run(batches):
        rng = np.random.default_rng(20240607)
        k = bands * rows
        mult = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        flip = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
        weight = rng.integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        for b in batches:
            data, offsets = K.buffers(b.column("text"))
            keys, sizes, sigs = [], [], []
            for i, j in K.chunks(offsets, 1 << 18):
                sets = K.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                full = [s for s in sets if len(s)]
                keys += [set_key(s) for s in sets]
                sizes += [len(s) for s in sets]
                sig = np.empty((k, len(full)), np.uint32)
                if full:
                    h = (np.concatenate(full) >> np.uint64(32)).astype(np.uint32)
                    at = np.cumsum([0, *(len(s) for s in full[:-1])])
                    for r in range(k):
                        sig[r] = np.minimum.reduceat((h ^ flip[r]) * mult[r], at)
                with np.errstate(over="ignore"):
                    band = (sig.reshape(bands, rows, -1).astype(np.uint64) * weight[None, :, None]).sum(1, dtype=np.uint64)
                    band += (np.arange(bands, dtype=np.uint64) * np.uint64(K.BASE))[:, None]
                sigs.append(K.mix(band).T.reshape(-1).view(np.int64))
            lengths = np.cumsum([0, *(bands if s else 0 for s in sizes)]).astype(np.int32)
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))],
                ["doc_id", "text_hash", "set_key", "n_grams", "bands"],
            )

    return run


def _gram_maker(n: int):
    """Arrow task: set key and the whole set of shingle hashes."""

    def run(batches):
        for b in batches:
            data, offsets = K.buffers(b.column("text"))
            for i, j in K.chunks(offsets):
                sets = K.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_key", "grams"])

    return run


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as a matrix, by products of 0/1 matrices over slices of the shared hashes."""
    own_l, own_r = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    all_l, all_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(all_l, all_r)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return out
    cols = []
    for own, every in ((own_l, all_l), (own_r, all_r)):
        at = np.searchsorted(shared, every)
        ok = shared[np.minimum(at, len(shared) - 1)] == every
        order = np.argsort(at[ok], kind="stable")
        cols.append((at[ok][order], own[ok][order]))
    step = 4096
    for s in range(0, len(shared), step):
        mats = []
        for (at, own), n in zip(cols, (len(left), len(right)), strict=True):
            a, b = np.searchsorted(at, [s, s + step])
            m = np.zeros((n, min(step, len(shared) - s)), np.float32)
            m[own[a:b], at[a:b] - s] = 1
            mats.append(m)
        out += mats[0] @ mats[1].T
    return out


def _stars(adj: np.ndarray) -> list[tuple[int, int]]:
    """(member, first member) of each component of an undirected 0/1 matrix, without the first ones."""
    seen, edges = np.zeros(len(adj), bool), []
    for root in range(len(adj)):
        if seen[root]:
            continue
        seen[root] = True
        stack = [root]
        while stack:
            new = np.flatnonzero(adj[stack.pop()] & ~seen)
            seen[new] = True
            edges += [(v, root) for v in new.tolist()]
            stack += new.tolist()
    return edges


def _compare(threshold: float):
    """Grouped Arrow task over one tile: links of each set in it, and for each component of them an edge to its least set from every other.

    A pair counts if its sets share a band. In a tile of a bucket (band 0 or more) it counts only if this is
    the first band that they share, so that it counts once; in a tile of a whole cluster (band -1) any will do.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("sid")
        side, sid, size = (t.column(c).to_numpy() for c in ("side", "sid", "size"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
        same = bool(t.column("a")[0].as_py() == t.column("b")[0].as_py())
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        out: dict[str, list] = {"sid": [], "links": [], "other": []}
        if len(left) and len(right) and (len(left) > 1 or not same):
            inter = _intersections([sets[i] for i in left], [sets[i] for i in right])
            n_l, n_r = np.array([len(sets[i]) for i in left]), np.array([len(sets[i]) for i in right])
            adj = inter >= threshold * (n_l[:, None] + n_r[None, :] - inter) - 1e-6
            adj &= inter > 0
            band, bands = t.column("band")[0].as_py(), np.array(t.column("bands").to_pylist())
            share = np.zeros(adj.shape, bool)
            for k in range(band if band >= 0 else bands.shape[1]):
                share |= bands[left, k][:, None] == bands[right, k][None, :]
            adj &= share if band < 0 else ~share
            if same:
                np.fill_diagonal(adj, False)
            for ids, got in ((left, adj @ size[right]), (right, size[left] @ adj)) if not same else ((left, adj @ size[left]),):
                for i, x in zip(ids.tolist(), got.tolist(), strict=True):
                    if x:
                        out["sid"].append(int(sid[i])), out["links"].append(int(x)), out["other"].append(None)
            ids = np.arange(len(sid))
            whole = np.zeros((len(ids), len(ids)), bool)
            whole[np.ix_(left, right)] = adj
            whole |= whole.T
            for u, v in _stars(whole):
                out["sid"].append(int(sid[u])), out["links"].append(0), out["other"].append(int(sid[v]))
        return pa.table({"sid": pa.array(out["sid"], pa.int64()), "links": pa.array(out["links"], pa.int64()), "other": pa.array(out["other"], pa.int64())})

    return run


def _dealt(members: DataFrame, place: list[str]) -> DataFrame:
    """Members of each place (a cluster, or a bucket) in tiles of bounded size: a row for each tile that a member takes part in, with the tile's two numbers and the member's side."""
    shape = members.groupBy(*place).agg(F.count("*").alias("m"), F.sum("n_grams").alias("g")).where("m > 1").select(*place, F.greatest(F.ceil(F.col("m") / TILE_SETS), F.ceil(F.col("g") / TILE_HASHES)).alias("tiles"))
    own = members.join(shape, place).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("tiles")))
    each = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return each.select("set_key", "sid", "size", "bands", *place, F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"), F.when(F.col("own") <= F.col("o"), 0).otherwise(1).alias("side"))


def tiles_of(members: DataFrame, n_bands: int) -> DataFrame:
    """Which tiles (root, band, bucket, a, b) each candidate set goes to.

    Pairs that share a bucket are compared, in any cluster. One whose tiles would copy a set
    no more often than it has bands goes there whole, which is less work; in a larger one, as chains of
    near copies make, a set goes to the tiles of each of its buckets. The pairs are the same.
    """
    shape = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n_grams").alias("g")).select("root", F.greatest(F.ceil(F.col("m") / TILE_SETS), F.ceil(F.col("g") / TILE_HASHES)).alias("tiles"))
    shape = materialise(shape, "shapes")
    small = members.join(shape.where(F.col("tiles") <= n_bands).select("root"), "root", "left_semi")
    whole = _dealt(small, ["root"]).withColumns({"band": F.lit(-1), "bucket": F.lit(0).cast("long")})
    large = shape.where(F.col("tiles") > n_bands).select("root")
    if large.isEmpty():
        return whole
    spread = members.join(large, "root", "left_semi").select("*", F.posexplode("bands").alias("band", "bucket"))
    return whole.unionByName(_dealt(spread, ["root", "band", "bucket"]))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the component's least node.

    Alternating large-star and small-star rounds: edges never outnumber the
    input's, and every round is grouped minima and joins on one narrow table. Hubs should be
    the lesser ends of their edges: the large step, which they meet in, can be split.
    """
    now = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join has plain exchanges on both sides and adaptive execution can split a hub.
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "stars")
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_min.select("u", F.col("m").alias("v")))
        now = materialise(small.where("u != v").distinct(), "edges")
        new = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def ngram_jaccard_join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Self-join of documents on the Jaccard similarity of their n-word shingle sets.

    Words are maximal runs of digits, letters and bytes past ASCII after
    lower-casing A-Z; a document of fewer than n words, but not none, is one
    shingle. Two documents are linked at similarity >= threshold. Returns a row
    per document row: doc_id, text_hash (xxhash64 of the text), class_id (the
    least doc_id of its connected component of links), n_links (how many other
    documents it is linked with, copies included) and keep_first (one row of the
    class: that of the least doc_id, null ids last, then the least text_hash).
    Texts without words (null, empty, only signs) have no set: class_id is
    their own doc_id and n_links 0. A class without any id has a null
    class_id. Repeated rows are documents of their own, linked with each other;
    they share keep_first, as nothing tells them apart.

    Ids are whole numbers. Shingles are compared as 64-bit hashes, and sets are told
    apart by 128 bits of them; neither is checked against the words.

    Documents of equal sets are collapsed first, so copies never multiply. Band
    hashes are shuffled as (hash, id) pairs; each bucket adds one edge from each
    member to its least member, and the components of those edges are candidate
    clusters. Every pair that shares a bucket is then verified on full sets, tile by tile of bounded size: a tile emits a
    count for each member and an edge to the least one of its component, never its pairs.
    """
    bands, rows = choose_bands(threshold, recall)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = materialise(source.mapInArrow(_signer(n, bands, rows), "doc_id long, text_hash long, set_key binary, n_grams long, bands array<long>"), "signatures")

    # One row per distinct set.
    sets = signed.where("n_grams > 0").groupBy("set_key").agg(F.count("*").alias("size"), F.min("doc_id").alias("first_id"), F.any_value("bands").alias("bands"), F.any_value("n_grams").alias("n_grams"))
    sets = materialise(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")

    # Buckets to candidate clusters.
    band_rows = sets.select("sid", F.explode("bands").alias("band"))
    heads = band_rows.groupBy("band").agg(F.min("sid").alias("head"), F.count("*").alias("k")).where("k > 1").select("band", "head")
    stars = band_rows.join(heads, "band").where("sid != head").select(F.col("sid").alias("u"), F.col("head").alias("v"))
    clusters = connected_components(stars)
    members = materialise(sets.select("sid", "set_key", "size", "n_grams", "first_id", "bands").join(clusters.withColumnRenamed("node", "sid"), "sid"), "members")

    # Full sets of the members only.
    ids = members.select("first_id").distinct()
    narrow = source.select("doc_id", "text")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = narrow.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    grams = wanted.select("text").mapInArrow(_gram_maker(n), "set_key binary, grams binary")
    held = members.select("set_key").join(grams, "set_key").dropDuplicates(["set_key"])
    dealt = tiles_of(members, bands).join(held, "set_key")
    verified = materialise(dealt.groupBy("root", "band", "bucket", "a", "b").applyInArrow(_compare(threshold), "sid long, links long, other long"), "links")

    # Classes and counts back to documents.
    links = verified.groupBy("sid").agg(F.sum("links").alias("links"))
    classes = connected_components(verified.where("other is not null").select(F.col("sid").alias("u"), F.col("other").alias("v")))
    named = sets.select("sid", "set_key", "size", "first_id").join(classes.withColumnRenamed("node", "sid"), "sid", "left").join(links, "sid", "left")
    named = named.withColumn("root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), "sid")).alias("best"))
    verdict = named.join(least, "root").where("size > 1 OR links > 0").select(
        "set_key", F.col("best.id").alias("class_id"), F.col("best.sid").alias("best_sid"), "sid", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    firsts = signed.where("n_grams > 0").groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("first"))
    # Written, so that both sides of the last join are plain exchanges, whose hot keys adaptive execution splits.
    verdict = materialise(verdict.join(firsts, "set_key"), "classes")
    joined = signed.select("doc_id", "text_hash", "set_key", "n_grams").join(verdict, "set_key", "left")
    linked = F.col("class_id").isNotNull() | F.col("n_links").isNotNull()
    return joined.select(
        "doc_id", "text_hash",
        F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(linked, (F.col("sid") == F.col("best_sid")) & F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.hash"))).otherwise(F.lit(True)).alias("keep_first"),
    )


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class and number of links."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def drop_near_duplicates(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one document of each class of near duplicates, that of the least doc_id; columns stay as they are."""
    verdict = ngram_jaccard_join(docs, n, threshold, recall).select("doc_id", "text_hash", F.col("keep_first").alias("kept"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return keep_rows(docs, {"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64(text)}, verdict)
