"""Ranked lexical search: WAND on each shard of documents, heaps of shards merged."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import ascii_lower, columns, materialise, table

TOP = 50
#: Words of documents and items: as in kernels.words, digits, letters and what is past ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of item text searched at a time; a larger set of items takes more passes.
BLOCK_BYTES = 4 << 20
#: Postings that a shard may hold: a task's documents are one shard, or several.
SHARD_POSTINGS = 1 << 21
#: Documents in the first run of pivots and in the longest one.
FIRST_RUN, LONGEST_RUN = 256, 8192
#: Parts that shard heaps of one item are merged in first.
MERGE_PARTS = 32


class Vocabulary:
    """The terms of one block of items: by hash, with their bytes to verify."""

    def __init__(self, terms: list[bytes]):
        lower = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum(np.array([len(t) for t in terms], np.int64)) if terms else np.zeros(0, np.int64)
        starts = ends - np.array([len(t) for t in terms], np.int64)
        hashes = K.word_hashes(lower, starts, ends)
        order = np.argsort(hashes, kind="stable")
        #: Terms of one hash stand together; a term's number is its place in the given list.
        self.hashes, self.number, self.terms = hashes[order], order, terms
        self.most = int(np.unique(hashes, return_counts=True)[1].max()) if terms else 0
        self.length, self.head = ends - starts, heads(lower, starts, ends)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word indexes, term numbers) of the words that are terms, compared byte by byte."""
        h = K.word_hashes(data, starts, ends)
        at = np.searchsorted(self.hashes, h)
        words, numbers = [], []
        for k in range(self.most):
            here = np.minimum(at + k, len(self.hashes) - 1)
            word = np.flatnonzero((self.hashes[here] == h) & (at + k < len(self.hashes)))
            number = self.number[here[word]]
            size = ends[word] - starts[word]
            same = (size == self.length[number]) & (heads(data, starts[word], ends[word]) == self.head[number]).all(axis=1)
            for i in np.flatnonzero(same & (size > 16)).tolist():
                w = word[i]
                same[i] = K.LOWER[data[starts[w] : ends[w]]].tobytes() == self.terms[number[i]]
            words.append(word[same])
            numbers.append(number[same])
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(words), np.concatenate(numbers)


def heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 16 lower-cased bytes of each word, as two integers; shorter words are filled up with zeros."""
    out = np.zeros((len(starts), 2), np.uint64)
    for k in range(16):
        at = starts + k
        inside = at < ends
        byte = np.zeros(len(starts), np.uint64)
        byte[inside] = K.LOWER[data[at[inside]]]
        out[:, k // 8] |= byte << np.uint64(8 * (k % 8))
    return out


def _scan(batch_text: pa.Array, vocab: Vocabulary):
    """For each chunk of texts: (first row, terms per row, row, term number, frequency) of the postings."""
    data, offsets = K.buffers(batch_text)
    for i, j in K.chunks(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = K.words(part, off)
        word, number = vocab.find(part, starts, ends)
        row = np.searchsorted(first, word, side="right") - 1
        key, tf = np.unique(row * max(1, len(vocab.terms)) + number, return_counts=True)
        yield i, np.diff(first), key // max(1, len(vocab.terms)), key % max(1, len(vocab.terms)), tf


def _counter(shared):
    """Arrow task: documents with terms and their terms with repeats (term -1), and documents of each term."""

    def run(batches):
        vocab = Vocabulary(shared.value)
        df = np.zeros(len(vocab.terms), np.int64)
        docs = total = 0
        for b in batches:
            for _, n, _, number, _ in _scan(b.column("_searched"), vocab):
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
                df += np.bincount(number, minlength=len(df))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, held]), pa.array(np.r_[docs, df[held]]), pa.array(np.r_[total, np.zeros(len(held), np.int64)])], ["term", "docs", "total"])

    return run


class Shard:
    """Postings of a shard in the order of its documents, with every term's impacts and the largest of them."""

    def __init__(self, lengths: np.ndarray, rows: np.ndarray, numbers: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, total: int):
        m = 100 - 50 + 50 * lengths * n_docs // max(1, total)
        order = np.lexsort((rows, numbers))
        self.rows, numbers, tf = rows[order], numbers[order], tf[order]
        self.impact = weights[numbers] * (1_000_000_000 * tf // (1000 * tf + 20 * m[self.rows]))
        self.size = len(lengths)
        held, self.begin = np.unique(numbers, return_index=True)
        self.end = np.r_[self.begin[1:], len(numbers)]
        self.most = np.maximum.reduceat(self.impact, self.begin) if len(held) else np.zeros(0, np.int64)
        self.place = {int(t): i for i, t in enumerate(held)}

    def top(self, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best for a set of terms, equal scores by lower document."""
        lists = sorted((self.place[t] for t in terms if t in self.place), key=lambda i: -self.most[i])
        docs = [self.rows[self.begin[i] : self.end[i]] for i in lists]
        impacts = [self.impact[self.begin[i] : self.end[i]] for i in lists]
        most = [int(self.most[i]) for i in lists]
        rest = np.r_[np.cumsum(most[::-1])[::-1], 0].tolist()  # what lists from here on can add
        heap_docs, heap_scores, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        cursor, run = 0, FIRST_RUN
        at = [0] * len(lists)
        while cursor < self.size and rest[0] > threshold:
            # A pivot holds one of the first lists: the others together can't beat the threshold.
            need = 1
            while rest[need] > threshold:
                need += 1
            nearest = min((int(docs[i][at[i]]) for i in range(need) if at[i] < len(docs[i])), default=self.size)
            if nearest >= self.size:
                break
            cursor, stop = nearest, min(self.size, nearest + run)
            bound = np.zeros(stop - cursor, np.int64)
            for i in range(need):
                a = at[i] + int(np.searchsorted(docs[i][at[i] :], cursor))
                b = a + int(np.searchsorted(docs[i][a:], stop))
                bound[docs[i][a:b] - cursor] += most[i]
                at[i] = b
            pivots = np.flatnonzero(bound + rest[need] > threshold) + cursor
            bound = bound[pivots - cursor]
            pivots, bound = pivots[bound > 0], bound[bound > 0]
            for i in range(need, len(lists)):
                if not len(pivots):
                    break
                bound += np.where(_held(docs[i], pivots)[1], most[i], 0)
                stay = bound + rest[i + 1] > threshold
                pivots, bound = pivots[stay], bound[stay]
            if len(pivots):
                score = np.zeros(len(pivots), np.int64)
                for own, impact in zip(docs, impacts, strict=True):
                    place, held = _held(own, pivots)
                    score[held] += impact[place[held]]
                good = score > threshold
                heap_docs, heap_scores = np.r_[heap_docs, pivots[good]], np.r_[heap_scores, score[good]]
                if len(heap_docs) > k:
                    best = np.lexsort((heap_docs, -heap_scores))[:k]
                    heap_docs, heap_scores = heap_docs[best], heap_scores[best]
                if len(heap_docs) == k:
                    threshold = int(heap_scores.min())
            cursor, run = stop, min(2 * run, LONGEST_RUN)
        return heap_docs, heap_scores


def _held(docs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted documents in a list, and whether they are there."""
    place = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    return place, docs[place] == wanted


def _searcher(shared, k: int):
    """Arrow task: the heaps of its shards, as (item, doc_id, score)."""

    def run(batches):
        terms, items, weights, n_docs, total = shared.value
        vocab = Vocabulary(terms)
        ids, lengths, rows, numbers, tfs, held, size = [], [], [], [], [], 0, 0
        for b in batches:
            for i, n, row, number, tf in _scan(b.column("_searched"), vocab):
                ids.append(b.column("doc_id").slice(i, len(n)))
                lengths.append(n)
                rows.append(row + size)
                numbers.append(number)
                tfs.append(tf)
                held, size = held + len(row), size + len(n)
                if held >= SHARD_POSTINGS:
                    yield _heaps(ids, lengths, rows, numbers, tfs, items, weights, n_docs, total, k)
                    ids, lengths, rows, numbers, tfs, held, size = [], [], [], [], [], 0, 0
        if held:
            yield _heaps(ids, lengths, rows, numbers, tfs, items, weights, n_docs, total, k)

    return run


def _heaps(ids, lengths, rows, numbers, tfs, items, weights, n_docs, total, k: int) -> pa.RecordBatch:
    doc_ids = pa.concat_arrays(ids)
    order = np.asarray(pc.sort_indices(doc_ids, null_placement="at_start"))  # in a shard, lower ids come first
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    shard = Shard(np.concatenate(lengths)[order], rank[np.concatenate(rows)], np.concatenate(numbers), np.concatenate(tfs), weights, n_docs, total)
    found = [(i, *shard.top(own, k)) for i, own in enumerate(items)]
    item = np.repeat([i for i, _, _ in found], [len(d) for _, d, _ in found]).astype(np.int64)
    docs = np.concatenate([d for _, d, _ in found]) if found else np.zeros(0, np.int64)
    scores = np.concatenate([s for _, _, s in found]) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(item), doc_ids.take(pa.array(order[docs.astype(np.int64)])), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of each item by integer BM25: item_id, rank, doc_id, score.

    Terms are maximal runs of digits, letters and bytes past ASCII, A-Z lower-cased.
    With N documents that have terms, L terms in them, df documents of a term, tf its
    occurrences in a document of n terms: w = floor(1000 ln((2N+2)/(2df+1))),
    m = 50 + 50nN div L, and the score sums w * (10^9 tf div (1000 tf + 20m)) over the
    distinct terms of the item. Documents of score 0 or below are left out; equal scores
    rank by ascending doc_id, a null id first. Every row of docs is a document, repeated
    rows too; a null or empty text has no terms. Rows of one item id are one item, a
    null id is one as any other; an item without terms finds nothing. Empty tables give
    no rows; other columns aren't read.

    Items go in blocks of about block_bytes of text, whose terms are broadcast. For each
    block one pass counts, and one cuts documents into shards and searches those.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_searched"))
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    own = _item_terms(items, item_col, item_text)
    n_bytes = own.agg(F.coalesce(F.sum(F.octet_length("term") + 1), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(n_bytes) // block_bytes))
    own = materialise(own.withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(n_blocks))), "item_terms")
    parts = []
    for block in range(n_blocks):
        per = own.where(F.col("block") == block).groupBy("item_id").agg(F.collect_set("term").alias("terms")).collect()
        terms = sorted({t.encode() for r in per for t in r.terms})
        number = {t: i for i, t in enumerate(terms)}
        sets = [sorted(number[t.encode()] for t in r.terms) for r in per]
        counted = source.select("_searched").mapInArrow(_counter(spark.sparkContext.broadcast(terms)), "term long, docs long, total long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"))
        counts = {r.term: (r.docs, r.total) for r in counted.collect()}  # a row for each term of the block, at most
        n_docs, total = counts.pop(-1, (0, 0))
        weights = np.zeros(len(terms), np.int64)
        for t, (docs_of, _) in counts.items():
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * docs_of + 1)))
        shared = spark.sparkContext.broadcast((terms, sets, weights, n_docs, total))
        heaps = source.mapInArrow(_searcher(shared, k), f"item long, doc_id {id_type}, score long")
        some = _best(heaps.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS))), ["item", "part"], k)
        best = _best(some.drop("rank", "part"), ["item"], k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(per)], f"item long, item_id {item_type}")
        parts.append(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    text = ascii_lower(F.col("t"))
    return columns(items, item_col, text_col).toDF("item_id", "t").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))).alias("term")).distinct()


def op11_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
dn AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
whole AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM dn),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM dn) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, whole GROUP BY term),
impact AS (SELECT term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))) AS x FROM tf JOIN w USING (term), whole),
scored AS (SELECT item_id, doc_id, CAST(sum(x) AS BIGINT) AS score FROM q JOIN impact USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
