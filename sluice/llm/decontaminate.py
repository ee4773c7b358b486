"""Benchmark decontamination: test n-gram windows against every document word."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import columns, materialise, table

WINDOW = 10
#: Bytes of benchmark text in one broadcast window set. A larger benchmark is
#: scanned in several blocks of this size, so that a task never holds more.
BLOCK_BYTES = 1 << 20
FILTER_BITS = 20
#: Documents hit are broadcast up to this many where several blocks meet; beyond, they are joined by shuffle.
BROADCAST_HITS = 1 << 17


class WindowSet:
    """The windows of one block of benchmark items: by hash, with their words to verify hits."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.n = n
        self.by_hash: dict[int, list[tuple[bytes, int, list[int]]]] = {}
        self.item_ids: list[str] = []
        lengths: dict[int, set[int]] = {}
        seen: dict[bytes, tuple[bytes, int, list[int]]] = {}
        for item_id, text in items:
            data = np.frombuffer(text, np.uint8)
            starts, ends, _ = K.words(data, np.array([0, len(data)]))
            if not len(starts):
                continue
            own = len(self.item_ids)
            self.item_ids.append(item_id)
            size = min(n, len(starts))
            wh = K.word_hashes(data, starts, ends)
            for i, h in enumerate(K.window_hashes(wh, size).tolist()):
                key = window_text(data, starts[i : i + size], ends[i : i + size])
                if key not in seen:
                    seen[key] = (key, size, [])
                    self.by_hash.setdefault(h, []).append(seen[key])
                    lengths.setdefault(size, set()).add(h)
                if own not in seen[key][2]:
                    seen[key][2].append(own)
        self.sizes = {}
        for size, hs in lengths.items():
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[np.fromiter(hs, np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
            self.sizes[size] = (bits, np.sort(np.fromiter(hs, np.uint64)))


def window_text(data: np.ndarray, starts, ends) -> bytes:
    """The lower-cased words of a window, separated by a byte that no word has."""
    return b" ".join(K.LOWER[data[a:b]].tobytes() for a, b in zip(starts, ends, strict=True))


def scan(data: np.ndarray, offsets: np.ndarray, block: WindowSet) -> Iterator[tuple[int, int, list[tuple[int, int]], list[str]]]:
    """For each document: number of words, words hit, byte spans hit, items found."""
    for i, j in K.chunks(offsets):
        base = offsets[i]
        part, off = data[base : offsets[j]], offsets[i : j + 1] - base
        starts, ends, first = K.words(part, off)
        hits: dict[int, list[tuple[int, int, list[int]]]] = {}
        if block.sizes and len(starts):
            wh = K.word_hashes(part, starts, ends)
            for size, (bits, hashes) in block.sizes.items():
                h = K.window_hashes(wh, size)
                maybe = np.flatnonzero(bits[h >> np.uint64(64 - FILTER_BITS)])
                at = np.searchsorted(hashes, h[maybe])
                maybe = maybe[hashes[np.minimum(at, len(hashes) - 1)] == h[maybe]]
                doc = np.searchsorted(first, maybe, side="right") - 1
                inside = maybe + size <= first[doc + 1]
                for w, d in zip(maybe[inside].tolist(), doc[inside].tolist(), strict=True):
                    text = window_text(part, starts[w : w + size], ends[w : w + size])
                    for key, n, owners in block.by_hash.get(int(h[w]), ()):
                        if n == size and key == text:
                            hits.setdefault(d, []).append((w, w + size, owners))
        counts = np.diff(first)
        for d in range(j - i):
            if d not in hits:
                yield int(counts[d]), 0, [], []
                continue
            spans: list[list[int]] = []
            found: set[int] = set()
            for a, b, owners in sorted(hits[d], key=lambda x: x[:2]):
                found.update(owners)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            yield int(counts[d]), sum(b - a for a, b in spans), [(int(starts[a] - off[d]), int(ends[b - 1] - off[d])) for a, b in spans], sorted({block.item_ids[x] for x in found})


def window_sets(benchmark: DataFrame, n: int, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(block, windows): pickled window sets of limit bytes of item text at about, each built in a task of its own."""
    rows = columns(benchmark, id_col, text_col).where(F.col(f"`{text_col}`").isNotNull())
    rows = rows.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).dropDuplicates()
    # A long item goes in ranges that share n - 1 words, so that none of its windows is lost and no block is much larger than limit.
    rows = rows.where(F.octet_length("t") <= limit).unionByName(rows.where(F.octet_length("t") > limit).mapInArrow(_ranges(n, limit), "i string, t string"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(total) // limit))

    def build(t: pa.Table) -> pa.Table:
        items = sorted(zip(t.column("i").to_pylist(), t.column("t").to_pylist(), strict=True))
        return pa.table({"block": t.column("block")[:1], "windows": pa.array([pickle.dumps(WindowSet([(i, x.encode()) for i, x in items], n))], pa.binary())})

    return rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks))).groupBy("block").applyInArrow(build, "block long, windows binary")


def _ranges(n: int, limit: int):
    def run(batches):
        for b in batches:
            for i, text in zip(b.column("i").to_pylist(), b.column("t").to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                starts, ends, _ = K.words(data, np.array([0, len(data)]))
                first = 0
                while first < len(starts):
                    # Up to the words that begin within limit, and the n - 1 that windows of the last of them need.
                    stop = max(first + 1, int(np.searchsorted(starts, starts[first] + limit)))
                    last = min(stop + n - 1, len(starts)) - 1
                    piece = data[starts[first] : ends[last]].tobytes().decode()
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([piece])], ["i", "t"])
                    if last == len(starts) - 1:
                        break
                    first = stop

    return run


def _scanner(shared, names):
    def run(batches):
        block = pickle.loads(shared.value)
        for b in batches:
            data, offsets = K.buffers(b.column("_scanned"))
            n_words, n_hit, spans, items = [], [], [], []
            for w, h, s, found in scan(data, offsets, block):
                n_words.append(w), n_hit.append(h), spans.append([{"start": x, "end": y} for x, y in s]), items.append(found)
            span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), *arrays], [*names, "n_words", "n_hit", "spans", "items"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where benchmark windows occur in each document.

    A word is a maximal run of digits, letters and bytes past ASCII after
    lower-casing A-Z. A window is n consecutive words of an item; an item of
    fewer words, but not none, is one window. Returns the carried columns,
    n_words, n_hit (words inside any occurrence), spans (byte spans of the UTF-8
    text, half-open) and items (ids as strings, sorted), one row per document
    row. Null and empty texts have no words; null items have no windows; an item
    of a null id is called "null"; repeated items count once by id. An empty
    benchmark hits nothing.

    The window set is broadcast: at most block_bytes of item text at a time. A
    larger benchmark, also one long item, takes one pass for each block, which writes a narrow row for each
    document that it hits; these are united and meet the documents once.
    """
    spark = docs.sparkSession
    source = docs.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{text_col}`").cast("string").alias("_scanned"))
    found = "n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<string>"
    kept = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema}
    names = list(carry)
    schema = ", ".join([*(kept[c] for c in names), found])
    blocks = materialise(window_sets(benchmark, n, item_col, "text", block_bytes), "windows")
    queue = (r["windows"] for r in blocks.select("windows").toLocalIterator())
    if blocks.count() <= 1:
        one = next(queue, None) or pickle.dumps(WindowSet([], n))
        return source.mapInArrow(_scanner(spark.sparkContext.broadcast(one), names), schema)
    # Several blocks: number the rows once, scan for each block, unite the hits.
    source = materialise(source.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    hits = None
    for block in queue:
        part = source.select("_row", "_scanned").mapInArrow(_scanner(spark.sparkContext.broadcast(block), ["_row"]), f"_row long, {found}")
        part = materialise(part.where("n_hit > 0").select("_row", "spans", "items"), "hits")
        hits = part if hits is None else hits.unionByName(part)
    merged = hits.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = materialise(merged, "united")
    few = merged.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    return source.join(F.broadcast(merged) if few else merged, "_row", "left").mapInArrow(_count_words(names), schema)


def _count_words(names):
    """n_words; and n_hit and spans from the spans of all blocks: the words that any of them covers, and their runs."""

    def run(batches):
        for b in batches:
            data, offsets = K.buffers(b.column("_scanned"))
            n_words, hit, united = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)]
            spans = b.column("spans").to_pylist()
            for i, j in K.chunks(offsets):
                starts, ends, first = K.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n_words[i:j] = np.diff(first)
                for k in range(i, j):
                    if spans[k]:
                        at, own = offsets[k] - offsets[i], slice(first[k - i], first[k - i + 1])
                        begin, end = starts[own] - at, ends[own] - at
                        covered = np.zeros(len(begin) + 2, bool)
                        for x in spans[k]:
                            covered[1 + np.searchsorted(begin, x["start"]) : 1 + np.searchsorted(end, x["end"], "right")] = True
                        edges = np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)
                        hit[k] = covered.sum()
                        united[k] = [{"start": int(begin[u]), "end": int(end[v - 1])} for u, v in edges.tolist()]
            span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [pa.array(n_words), pa.array(hit), pa.array(united, span_type), pa.array([x or [] for x in b.column("items").to_pylist()], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), *arrays], [*names, "n_words", "n_hit", "spans", "items"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WINDOW, text_col: str = "text") -> DataFrame:
    """docs without what benchmark windows hit; columns stay as they are.

    mode "documents" drops each document with a hit; "spans" cuts the hit bytes
    out of the text, first word to last, and keeps the rest. A document without
    hits, null or empty text included, is returned untouched.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    renamed = docs.toDF(*inner)
    text = inner[names.index(text_col)]
    found = contamination(renamed, benchmark, n, tuple(inner), text)
    if mode == "documents":
        return found.where("n_hit = 0").select(*inner).toDF(*names)
    raw = F.col(text).cast("binary")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    heads = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length(F.col(text)).cast("long")))
    pieces = F.zip_with(edges, heads, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    return found.withColumn(text, F.when(F.col("n_hit") > 0, F.array_join(pieces, "")).otherwise(F.col(text))).select(*inner).toDF(*names)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by the whole benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bwin),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM dwin JOIN bwin USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
