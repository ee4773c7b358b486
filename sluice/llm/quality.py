"""Quality classifier: a byte-level convolutional network, in numpy."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .common import held_out, materialise, table

EMBED = 8
#: A chunk is so many blocks of so many bytes; chunks start at every block.
BLOCK = 4
BLOCKS = 4
FILTERS = 32
#: Labelled documents of each class that are learned from, at about.
PER_CLASS = 3000
#: Bytes of text that the one training task holds at most; labelled documents beyond, in the order of a hash of their ids, are not trained on.
SAMPLE_BYTES = 256 << 20
EPOCHS = 12
#: A small sample is gone through more often, to make so many steps.
MIN_STEPS = 500
BATCH = 32
RATE = 0.004
#: Documents that score less are rejected.
THRESHOLD = 0.3
#: Bytes whose activations are held at once.
SPAN = 1 << 18


def init(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    width = BLOCK * BLOCKS * EMBED
    return {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": rng.normal(0, 1 / np.sqrt(width), (BLOCKS * BLOCK * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.3, FILTERS).astype(np.float32),
        "shift": np.zeros(1, np.float32),
    }


def blocks_of(text: np.ndarray) -> np.ndarray:
    """A text's bytes in blocks, filled up with zero bytes so that each byte is in a whole chunk."""
    n = max(BLOCKS, -(-len(text) // BLOCK) + BLOCKS - 1)
    out = np.zeros(n * BLOCK, np.uint8)
    out[: len(text)] = text
    return out.reshape(n, BLOCK)


def activations(net: dict, blocks: np.ndarray) -> np.ndarray:
    """Every filter at every chunk."""
    x = net["embed"][blocks].reshape(len(blocks), BLOCK * EMBED)
    w = net["filters"].reshape(BLOCKS, BLOCK * EMBED, FILTERS)
    n = len(blocks) - BLOCKS + 1
    y = x @ np.concatenate(list(w), axis=1)
    out = y[:n, :FILTERS].copy()
    for j in range(1, BLOCKS):
        out += y[j : n + j, j * FILTERS : (j + 1) * FILTERS]
    return out


def pool(net: dict, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest activation of each filter, the chunk that has it, blocks) over the whole text, span by span."""
    blocks = blocks_of(text)
    best, where = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
    step = SPAN // BLOCK
    for a in range(0, len(blocks) - BLOCKS + 1, step):
        y = activations(net, blocks[a : a + step + BLOCKS - 1])
        at = y.argmax(0)
        top = y[at, np.arange(FILTERS)]
        better = top > best
        best[better], where[better] = top[better], at[better] + a
    return best, where, blocks


def head(net: dict, best: np.ndarray) -> np.ndarray:
    """Log-odds from pooled activations."""
    return np.maximum(best + net["bias"], 0) @ net["out"] + net["shift"][0]


def add_gradient(g: dict, net: dict, text: np.ndarray, y: float, weight: float) -> None:
    """Add to g the gradient of one text's weighted log-loss."""
    best, where, blocks = pool(net, text)
    act = np.maximum(best + net["bias"], 0)
    p = 1 / (1 + np.exp(-np.clip(act @ net["out"] + net["shift"][0], -30, 30)))
    d = np.float32((p - y) * weight)
    g["out"] += d * act
    g["shift"] += d
    da = np.where(act > 0, d * net["out"], 0).astype(np.float32)
    g["bias"] += da
    chunk = blocks[where[:, None] + np.arange(BLOCKS)].reshape(FILTERS, -1)
    g["filters"] += (net["embed"][chunk].reshape(FILTERS, -1) * da[:, None]).T
    np.add.at(g["embed"], chunk.reshape(-1), (net["filters"].T * da[:, None]).reshape(-1, EMBED))


def fit(texts: list[bytes], y: np.ndarray, prior: float, seed: int = 11) -> dict[str, np.ndarray]:
    """Train on whole texts by Adam; only the chunk that won each pool gets a gradient.

    Classes weigh the same in training; the log-odds are then moved to prior, the share of
    label 1 among all labelled rows.
    """
    rng = np.random.default_rng(seed)
    net = init(seed)
    raw = [np.frombuffer(t, np.uint8) for t in texts]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    m, v = ({k: np.zeros_like(x) for k, x in net.items()} for _ in range(2))
    step, epochs = 0, max(EPOCHS, -(-MIN_STEPS // -(-len(raw) // BATCH)))
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(raw))
        for a in range(0, len(order), BATCH):
            g = {k: np.zeros_like(x) for k, x in net.items()}
            for i in order[a : a + BATCH].tolist():
                add_gradient(g, net, raw[i], y[i], weight[i] / BATCH)
            step += 1
            for k in net:
                grad = g[k] + 1e-4 * net[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                net[k] = net[k] - np.float32(rate) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    net["shift"] = (net["shift"] + np.log(prior / (1 - prior))).astype(np.float32)
    return {k: x.astype(np.float32) for k, x in net.items()}


def score_texts(net: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each whole text; short ones share a pass."""
    out = np.empty(len(offsets) - 1)
    for i, j in K.chunks(offsets, SPAN):
        if j == i + 1:
            best = pool(net, data[offsets[i] : offsets[j]])[0][None]
        else:
            parts = [blocks_of(data[a:b]) for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
            at = np.cumsum([0, *(len(p) for p in parts)])
            y = activations(net, np.concatenate(parts))
            # Chunks that straddle two texts are left out: they are the last of each text.
            ends = np.minimum(at[1:] - BLOCKS + 1, len(y))
            best = np.maximum.reduceat(y, np.stack([at[:-1], ends], 1).reshape(-1)[: 2 * len(parts) - (ends[-1] >= len(y))], axis=0)[::2]
        out[i:j] = 1 / (1 + np.exp(-np.clip(head(net, best), -30, 30)))
    return out


def _fit_task(prior: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "label"])
        net = fit([t.encode() for t in pdf["text"]], pdf["label"].to_numpy(), prior)
        return pd.DataFrame({"net": [pickle.dumps(net)]})

    return run


def within_bytes(sample: DataFrame, limit: int) -> DataFrame:
    """Rows (doc_id, label, text) of a sample bounded in rows, whose texts together have at most limit bytes.

    Each label has half of them: its documents by a hash of the id, those of more than a 64th of
    limit last and by size. So a very long text takes no place from others, and a label
    is left out only if none of its texts has half of limit or less.
    """
    if (sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= limit:
        return sample
    sizes = sample.groupBy("label", "doc_id").agg(F.sum(F.octet_length("text")).alias("size"))
    order = Window.partitionBy("label").orderBy(F.when(F.col("size") > limit / 64, F.col("size")).otherwise(0), F.xxhash64("doc_id"), "doc_id")
    kept = sizes.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= limit / 2).select("label", "doc_id")
    return sample.join(F.broadcast(kept), ["label", "doc_id"], "left_semi").select(*sample.columns)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, text_col: str = "text") -> dict | None:
    """A network from about per_class labelled documents of each class, chosen by a hash of the id; None without labels.

    Rows without label are not used; a document labelled twice counts twice. The sample
    is bounded in documents and by SAMPLE_BYTES, so one task trains on it.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.coalesce(*(F.when(F.col("label") == c, F.lit(min(1.0, per_class / n))) for c, n in counts.items()))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select("doc_id", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    chosen = materialise(texts.join(F.broadcast(sample), "doc_id"), "labelled")
    rows = within_bytes(chosen, SAMPLE_BYTES).groupBy(F.lit(0).alias("one"))
    got = rows.applyInPandas(_fit_task(counts.get(1, 0) / sum(counts.values())), "net binary").collect()
    return pickle.loads(got[0]["net"]) if got else None


def _scorer(shared, names):
    def run(batches):
        net = pickle.loads(shared.value)
        for b in batches:
            data, offsets = K.buffers(b.column("_text"))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(score_texts(net, data, offsets))], [*names, "score"])

    return run


def score_quality(docs: DataFrame, net: dict | None, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The carried columns and score (0 to 1, higher: better) of every document row, from its whole text.

    Null and empty texts are scored as a text of zero bytes only. Without a network every score is 1.
    Null ids, repeated rows and extra columns don't matter; an empty table gives an empty result.
    """
    source = docs.select(*(F.col(f"`{c}`") for c in carry), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    if net is None:
        return source.drop("_text").withColumn("score", F.lit(1.0))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))
    return source.mapInArrow(_scorer(shared, list(carry)), f"{kinds}, score double")


def drop_rejected(docs: DataFrame, net: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold; columns stay as they are."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*inner)
    scored = score_quality(renamed, net, tuple(inner), inner[docs.columns.index("text")])
    return scored.where(F.col("score") >= threshold).select(*inner).toDF(*docs.columns)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of the fold that isn't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
