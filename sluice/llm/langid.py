"""Language identification: family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

import itertools
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import held_out, materialise, table

DIMS = 8192
#: Labelled documents of each language that are learned from, at about.
PER_LANG = 400
#: Documents of other families, at about, that a family's classifier learns from; of each language as many.
REST = 2048

# ISO 639-1 codes by family. Others are families of their own.
FAMILIES = {
    "germanic": "af da de en fo is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tk tt uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

#: Bytes other than letters and bytes past ASCII become a space.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].lower(), lang)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A unit vector of hashed byte 2- and 3-gram counts (square roots) for each whole text; zeros for an empty one."""
    out = np.zeros((len(offsets) - 1, DIMS), np.float32)
    for i in range(len(offsets) - 1):
        counts = np.zeros(DIMS, np.int64)
        for a in range(int(offsets[i]), int(offsets[i + 1]), K.CHUNK):
            x = LETTERS[data[max(a - 2, int(offsets[i])) : min(a + K.CHUNK, int(offsets[i + 1]))]].astype(np.uint32)
            if len(x) >= 3:
                g = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
                g = (g * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 13)
                counts += np.bincount(g.astype(np.int64), minlength=DIMS)
            if len(x) >= 2:
                g = (((x[:-1] << np.uint32(8)) | x[1:]) * np.uint32(0x165667B1)) >> np.uint32(32 - 13)
                counts += np.bincount(g.astype(np.int64), minlength=DIMS)
        v = np.sqrt(counts)
        norm = np.sqrt(counts.sum())
        out[i] = v / norm if norm else 0
    return out


def _vectors(batches):
    """Arrow task: label and vector of each sampled document."""
    for b in batches:
        data, offsets = K.buffers(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([v.tobytes() for v in features(data, offsets)], pa.binary())], ["lang", "vec"])


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 20) -> tuple[np.ndarray, float, float]:
    """(weights, bias, slope) of a linear SVM by dual coordinate descent; slope maps margins to log-odds.

    Classes weigh the same however many rows they have.
    """
    rng = np.random.default_rng(7)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    cap = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    w, alpha, q = np.zeros(x.shape[1]), np.zeros(len(y)), (x.astype(np.float64) ** 2).sum(1)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cap[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    m = y * (x @ w)
    slope = 2.0
    for s in (0.5, 1.0, 2.0, 3.0, 5.0, 8.0):
        if np.logaddexp(0, -s * m).mean() < np.logaddexp(0, -slope * m).mean():
            slope = s
    return w[:-1].astype(np.float32), float(w[-1]), slope


def _train_task(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack([np.frombuffer(v, np.float32) for v in pdf["vec"]])
    w, b, s = train_svm(x, pdf["y"].to_numpy(np.float64))
    return pd.DataFrame({"task": [pdf["task"].iloc[0]], "w": [w.tobytes()], "b": [b], "s": [s]})


def train(docs: DataFrame, per_lang: int = PER_LANG, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict:
    """A model from documents with a language: about per_lang of each, chosen by a hash of the id.

    Each classifier is trained in its own task: one for each family against the
    rest, and one for each pair of languages in a family. With one language there
    is nothing to separate, and with none the model predicts und. A classifier learns from
    per_lang documents of a language, and of other families from about REST in all, by a hash of their
    vectors; so a task is bounded by what its own family has. Any number of languages will do; the model grows by a
    vector of DIMS for each.
    """
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": []}
    share = F.coalesce(*(F.when(F.col("lang") == c, F.lit(min(1.0, per_lang / n))) for c, n in counts.items()))
    sample = known.where(F.pmod(F.xxhash64("i", "text"), F.lit(1_000_000)) < share * 1_000_000)
    vectors = materialise(sample.select("lang", "text").repartition(F.xxhash64("text")).mapInArrow(_vectors, "lang string, vec binary"), "lang-vectors")
    families = sorted({family(c) for c in langs})
    tasks = []
    if len(families) > 1:
        tasks += [(f"family:{f}", [c for c in langs if family(c) == f], [c for c in langs if family(c) != f]) for f in families]
    for f in families:
        tasks += [(f"pair:{a}:{b}", [a], [b]) for a, b in itertools.combinations([c for c in langs if family(c) == f], 2)]
    model = {"langs": langs, "families": {f: [c for c in langs if family(c) == f] for f in families}, "svm": {}}
    if tasks:
        # What each language is to each classifier, and which share of its documents goes there.
        roles = []
        for t, pos, neg in tasks:
            rest = sum(min(per_lang, counts[c]) for c in neg)
            share_of_rest = min(1.0, REST / rest) if t.startswith("family:") else 1.0
            roles += [(c, t, 1.0, 1.0) for c in pos] + [(c, t, -1.0, share_of_rest) for c in neg]
        roles = docs.sparkSession.createDataFrame(roles, "lang string, task string, y double, share double")
        spread = vectors.join(F.broadcast(roles), "lang")
        rows = spread.where(F.pmod(F.xxhash64("vec", "task"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("task", "y", "vec")
        for r in rows.groupBy("task").applyInPandas(_train_task, "task string, w binary, b double, s double").collect():
            model["svm"][r["task"]] = (np.frombuffer(r["w"], np.float32), r["b"], r["s"])
    return model


def decide(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score (probability of the family times that of the language in it) of each vector."""
    names = list(model["svm"])
    if names:
        m = x @ np.stack([model["svm"][k][0] for k in names]).T + np.array([model["svm"][k][1] for k in names])
        p = dict(zip(names, (1 / (1 + np.exp(-np.clip(m * np.array([model["svm"][k][2] for k in names]), -30, 30)))).T, strict=True))
    n, fams = len(x), list(model["families"])
    pf = np.stack([p[f"family:{f}"] for f in fams]) if len(fams) > 1 else np.ones((1, n))
    pf = pf / pf.sum(0)
    best, score, langs = pf.argmax(0), pf.max(0), np.empty(n, object)
    for k, f in enumerate(fams):
        own = model["families"][f]
        at = np.flatnonzero(best == k)
        votes, odds = np.zeros((len(own), len(at))), np.zeros((len(own), len(at)))
        for a, b in itertools.combinations(range(len(own)), 2):
            q = p[f"pair:{own[a]}:{own[b]}"][at]
            votes[a] += q > 0.5
            votes[b] += q <= 0.5
            odds[a] += q
            odds[b] += 1 - q
        pick = (votes + odds / max(1, len(own))).argmax(0) if len(own) > 1 else np.zeros(len(at), int)
        langs[at] = np.array(own, object)[pick]
        if len(own) > 1:
            score[at] *= odds[pick, np.arange(len(at))] / (len(own) - 1)
    return langs.tolist(), np.clip(score, 0, 1)


def _predictor(shared):
    def run(batches):
        model = pickle.loads(shared.value)
        for b in batches:
            data, offsets = K.buffers(b.column("text"))
            ok = b.column("has_letter").to_pylist()
            langs, scores = [], []
            for i in range(0, b.num_rows, 256):
                j = min(i + 256, b.num_rows)
                if not model["langs"]:
                    langs += ["und"] * (j - i)
                    scores += [0.0] * (j - i)
                    continue
                got, s = decide(model, features(data, offsets[i : j + 1]))
                langs += [x if y else "und" for x, y in zip(got, ok[i:j], strict=True)]
                scores += [float(x) if y else 0.0 for x, y in zip(s, ok[i:j], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every document row, from the whole text alone.

    A null text or one without a letter is und with score 0. Null ids, repeated
    rows and extra columns don't matter; an empty table gives an empty result.
    """
    text = F.col(f"`{text_col}`").cast("string")
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_predictor(shared), f"doc_id {kind}, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the fold that isn't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
