"""Toxicity by nearest labelled examples: exact cosines of class-weighted TF-IDF over every word, from block-max inverted lists."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import held_out, materialise, table
from .quality import within_bytes

#: Labelled documents of each class that are indexed, at about.
PER_CLASS = 2048
NEIGHBOURS = 15
#: Bytes of text that these have together at most.
SAMPLE_BYTES = 256 << 20
#: Examples of a block, and blocks of the first group that is searched.
BLOCK, GROUP = 256, 1
#: Class factor of a word that tells the classes apart not at all; one that does for sure has 1 more.
QUIET = 0.1
#: A vote's weight is 1 / (this + 1 - cosine).
SOFT = 0.05


def doc_terms(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each whole text its distinct word hashes, sorted, and their counts."""
    out = []
    for i, j in K.chunks(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = K.words(part, off)
        wh = K.word_hashes(part, starts, ends)
        out += [np.unique(wh[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Labelled unit vectors as inverted lists: postings (example, weight) of each term, cut where a block of examples ends, with the largest weight of each cut.

    search() bounds every block by those largest weights, scores the most
    promising ones, and then all others that can still reach the k-th best cosine; so the
    result is the exact top k, ties going to the earlier example. keep has every term
    of the examples, sorted; a word that no example has only adds to the length of a query.
    """

    def __init__(self, keep: np.ndarray, idf: np.ndarray, rows: list[tuple[int, int, np.ndarray, np.ndarray]], weights: dict[int, float], unseen: float = 1.0):
        self.keep, self.idf, self.unseen = keep, idf, unseen
        self.ids, self.labels, self.at, values = [], [], [], []
        zero = {0: 0.0, 1: 0.0}
        for doc_id, label, at, n in rows:
            if len(at):
                w = (1 + np.log(n)) * idf[at]
                values.append((w / np.sqrt((w * w).sum())).astype(np.float32))
                self.at.append(at)
                self.ids.append(doc_id)
                self.labels.append(label)
            else:
                zero[label] += weights[label]
        self.weights = np.array([weights[x] for x in self.labels])
        self.labels = np.array(self.labels, np.float64)
        # Documents without any term: how often their kind is toxic.
        self.without = (zero[1] + 0.5 * weights[1] / max(weights.values())) / (zero[0] + zero[1] + 1)
        self.n, self.blocks, self.table = len(values), -(-len(values) // BLOCK), None
        terms = np.concatenate([*self.at, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(terms, kind="stable")
        self.example = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in self.at])[order]
        self.weight = np.concatenate([*values, np.zeros(0, np.float32)])[order]
        # A piece is what one term has in one block: postings cut[i] to cut[i + 1]; a term has pieces first[t] to first[t + 1].
        piece = terms[order] * self.blocks + self.example // BLOCK
        begins = np.flatnonzero(np.diff(piece, prepend=-1))
        self.cut = np.append(begins, len(piece))
        self.block = self.example[begins] // BLOCK
        self.most = np.maximum.reduceat(self.weight, begins) if len(begins) else self.weight
        self.first = np.searchsorted(terms[order][begins], np.arange(len(keep) + 1))
        self.prior = float((self.weights * self.labels).sum() / self.weights.sum()) if values else self.without

    @property
    def matrix(self) -> np.ndarray:
        """Terms by examples, dense; for looking at small indexes."""
        m = np.zeros((len(self.keep), self.blocks * BLOCK), np.float32)
        pieces = np.repeat(np.arange(len(self.keep)), np.diff(self.first))
        m[np.repeat(pieces, np.diff(self.cut)), self.example] = self.weight
        return m

    def locate(self, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions in keep, counts) of a text's terms, and the counts of terms that no example has."""
        if not len(self.keep):
            return np.zeros(0, np.int64), n[:0], n
        at = np.searchsorted(self.keep, terms)
        known = self.keep[np.minimum(at, len(self.keep) - 1)] == terms
        return at[known], n[known], n[~known]

    def query(self, at: np.ndarray, n: np.ndarray, others: np.ndarray = np.zeros(0)) -> np.ndarray:
        w, u = (1 + np.log(n)) * self.idf[at], (1 + np.log(others)) * self.unseen
        return (w / np.sqrt((w * w).sum() + (u * u).sum())).astype(np.float32)

    def search(self, at: np.ndarray, q: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0."""
        n = self.first[at + 1] - self.first[at]
        pieces, term = runs(self.first[at], n), np.repeat(np.arange(len(at)), n)
        block = self.block[pieces]
        bounds = np.bincount(block, q[term] * self.most[pieces], minlength=self.blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
        for group in (order[:GROUP], order[GROUP:]):
            if len(best_s) == k:
                group = group[bounds[group] >= best_s[-1] - 1e-9]
            if not len(group):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[group] = True
            use = chosen[block]
            # A term's pieces in adjoining blocks are one run of postings.
            on = use[1:] & use[:-1] & (term[1:] == term[:-1])
            begins, stops = np.flatnonzero(use & ~np.append(False, on)), np.flatnonzero(use & ~np.append(on, False))
            begin = self.cut[pieces[begins]]
            length = self.cut[pieces[stops] + 1] - begin
            to = runs(begin, length)
            s = np.bincount(self.example.take(to), self.weight.take(to) * np.repeat(q[term[begins]], length), minlength=self.n)
            if skip >= 0:
                s[skip] = 0
            own = np.flatnonzero(s > 0)
            if len(own) > k:
                own = own[s[own] >= np.partition(s[own], -k)[-k]]
            best_s, best_i = np.concatenate([best_s, s[own]]), np.concatenate([best_i, own])
            top = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[top], best_i[top]
        return best_i, best_s

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Distance-weighted share of toxic neighbours, each class weighing as it does among all labelled rows, with one vote of the prior."""
        w = self.weights[near] / (SOFT + 1 - np.minimum(cosine, 1.0))
        unit = self.weights.mean() / (SOFT + 1)
        return float(((w * self.labels[near]).sum() + unit * self.prior) / (w.sum() + unit))

    def calibrate(self) -> None:
        """Leave-one-out votes of the examples, pooled into a rising curve of observed shares."""
        votes = np.zeros(self.n)
        by_example = np.split(self.weight[np.argsort(self.example, kind="stable")], np.cumsum([len(x) for x in self.at])[:-1])
        for i in range(self.n):
            near, cos = self.search(self.at[i], by_example[i], skip=i)
            votes[i] = self.vote(near, cos)
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # [weight, toxic weight, last vote]
        for i in order.tolist():
            pools.append([self.weights[i], self.weights[i] * self.labels[i], votes[i]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                w, t, v = pools.pop()
                pools[-1] = [pools[-1][0] + w, pools[-1][1] + t, v]
        unit = float(self.weights.max()) if self.n else 1.0
        xs = [p[2] for p in pools]
        ys = [(p[1] + self.prior * unit) / (p[0] + unit) for p in pools]
        self.table = (np.array(xs), np.maximum.accumulate(np.array(ys))) if pools else None

    def score(self, vote: float) -> float:
        """Calibrated probability; the raw vote breaks ties within a pool."""
        if self.table is None:
            return vote
        return float(np.clip(0.98 * np.interp(vote, *self.table) + 0.02 * vote, 0, 1))


def _term_rows(batches):
    """Arrow task: distinct word hashes and counts of labelled documents."""
    for b in batches:
        data, offsets = K.buffers(b.column("text"))
        got = doc_terms(data, offsets)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("label"), pa.array([t.view(np.int64) for t, _ in got], pa.list_(pa.int64())), pa.array([n for _, n in got], pa.list_(pa.int64()))],
            ["doc_id", "label", "terms", "counts"])


def term_weights(df: np.ndarray, toxic: np.ndarray, n_pos: int, n_neg: int) -> tuple[np.ndarray, float]:
    """IDF times class factor of every term, from how many examples, and toxic ones, have it; and that of a word that none has.

    The factor rises with the chi-square between presence and label, up to where chance
    can't have given it to the best of very many terms. It is never 0, so no word is dropped.
    """
    n = n_pos + n_neg
    lift = toxic / max(1, n_pos) - (df - toxic) / max(1, n_neg)
    chi = lift * lift / (df / n * (1 - df / n) + 1e-9)
    sure = 16.0 * (1 / max(1, n_pos) + 1 / max(1, n_neg))
    return (np.log((1 + n) / (1 + df)) + 1) * (QUIET + np.minimum(1, chi / sure)), (np.log(1 + n) + 1) * QUIET


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, text_col: str = "text") -> BlockMaxIndex | None:
    """An index of about per_class labelled documents of each class, chosen by a hash of the id; None without labels.

    The vocabulary is every word of that sample. Rows without label
    are not used; a document labelled twice counts twice. Ids are whole numbers. The sample is bounded in
    documents and by SAMPLE_BYTES; one task builds the index from it and calibrates it, and
    the driver gets the finished index only.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col("doc_id"), F.col(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.coalesce(*(F.when(F.col("label") == c, F.lit(min(1.0, per_class / n))) for c, n in counts.items()))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select("doc_id", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    chosen = within_bytes(materialise(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text"), "labelled"), SAMPLE_BYTES)
    rows = chosen.mapInArrow(_term_rows, "doc_id long, label int, terms array<long>, counts array<long>")
    made = rows.groupBy(F.lit(0).alias("one")).applyInArrow(_index_task(counts), "index binary").collect()
    return pickle.loads(made[0]["index"]) if made else None


def _index_task(counts: dict[int, int]):
    def run(rows):
        return pa.table({"index": pa.array([pickle.dumps(build_index(rows, counts))], pa.binary())})

    return run


def build_index(rows: pa.Table, counts: dict[int, int]) -> BlockMaxIndex:
    """The calibrated index of labelled documents (doc_id, label, terms, counts); counts has how many rows each label has in all."""
    rows = rows.take(pc.sort_indices(rows.select(["doc_id", "label"]), [("doc_id", "ascending"), ("label", "ascending")])).combine_chunks()
    terms, n = (pc.list_flatten(rows[x]).to_numpy() for x in ("terms", "counts"))
    label, length = rows["label"].to_numpy(), pc.list_value_length(rows["terms"]).to_numpy()
    keep, at, df = np.unique(terms.view(np.uint64), return_inverse=True, return_counts=True)
    n_pos, n_neg = int((label == 1).sum()), int((label == 0).sum())
    value, unseen = term_weights(df, np.bincount(at, np.repeat(label, length), minlength=len(keep)), n_pos, n_neg)
    ends = np.cumsum(length)
    held = [(i, y, at[b - m : b], n[b - m : b]) for i, y, m, b in zip(rows["doc_id"].to_pylist(), label.tolist(), length.tolist(), ends.tolist(), strict=True)]
    seen = {1: max(1, n_pos), 0: max(1, n_neg)}
    weights = {x: counts.get(x, 0) / seen[x] for x in (0, 1)}
    top = max(weights.values())
    index = BlockMaxIndex(keep, value, held, {x: w / top for x, w in weights.items()}, unseen)
    index.calibrate()
    index.at = []  # the examples' terms, which only calibration wants: they aren't sent on
    return index


def _scorer(shared):
    def run(batches):
        index = pickle.loads(shared.value)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for b in batches:
            data, offsets = K.buffers(b.column("text"))
            scores, evidence = np.empty(b.num_rows), []
            for i, (terms, counts) in enumerate(doc_terms(data, offsets)):
                at, n, others = index.locate(terms, counts)
                if not len(at):
                    scores[i] = index.without
                    evidence.append([])
                    continue
                near, cos = index.search(at, index.query(at, n, others))
                scores[i] = index.score(index.vote(near, cos))
                evidence.append([{"doc_id": index.ids[x], "cosine": float(c), "label": int(index.labels[x])} for x, c in zip(near.tolist(), cos.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    return run


def score_toxicity(docs: DataFrame, index: BlockMaxIndex | None, text_col: str = "text") -> DataFrame:
    """doc_id, score and evidence (nearest examples: doc_id, cosine, label) of every document row, from its whole text.

    Texts that share no word with any example, null and empty ones included, get the
    share of toxic documents among labelled ones without words, and no evidence. Without
    an index every score is 0. Null ids, repeated rows and extra columns don't matter; an
    empty table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = "array<struct<doc_id: long, cosine: double, label: int>>"
    if index is None:
        return source.select("doc_id", F.lit(0.0).alias("score"), F.array().cast(kind).alias("evidence"))
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(index))
    return source.mapInArrow(_scorer(shared), f"doc_id long, score double, evidence {kind}")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of the fold that isn't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
