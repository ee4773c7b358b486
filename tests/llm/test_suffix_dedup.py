import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import DOCS, documents
from sluice.llm import suffix_dedup


def brute(texts, length, words=50, least=240):
    """n_bytes, n_removed, n_spans, digest of the rest and passage of each text, over all of its strings."""
    raws = [(t or "").encode() for t in texts]
    least = min(least, length)
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    heads = {}
    for k, r in enumerate(raws):
        for i in range(len(r) - least + 1):
            heads.setdefault(r[i : i + least], []).append((k, i))

    def shares(k):
        """Whether a start has, in another text, a common prefix of length bytes or so many words."""
        r = raws[k]
        for i in range(len(r) - least + 1):
            for j, at in heads[r[i : i + least]]:
                if j != k:
                    n = least
                    while n < length and n < len(r) - i and n < len(raws[j]) - at and r[i + n] == raws[j][at + n]:
                        n += 1
                    if n >= length or len(re.findall(rb"[^ \t\n\x0b\f\r]+", r[i : i + n])) >= words:
                        return True
        return False

    out = []
    for k, r in enumerate(raws):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = int(np.diff(np.concatenate([[0], gone.astype(int), [0]])).clip(0).sum())
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest(), shares(k)))
    return out


def rows_of(docs, length=400):
    got = suffix_dedup.cut_repeats(docs, length)
    return Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256), "passage").collect())


@pytest.mark.parametrize("seed", range(40))
def test_suffix_order_is_the_sorted_order(seed):
    rng = random.Random(seed)
    alphabet = [b"ab", b"abcdef", bytes(range(256)), b"a"][seed % 4]
    depth, parts, starts, chosen, ends, at = 12, [], [], [], [], 0
    for _ in range(rng.randint(1, 8)):
        n = rng.randint(1, 60)
        parts.append([1 + rng.choice(alphabet) for _ in range(n + depth)])
        starts += range(at, at + n)
        chosen += range(at, at + n + depth)
        ends.append(at + n + depth - 1)
        at += n + depth
    text = np.array(sum(parts, []) + [0] * depth, np.uint16)
    order = suffix_dedup.suffix_array(text, np.array(chosen), np.array(ends), depth)
    assert sorted(order.tolist()) == chosen
    order = [i for i in order.tolist() if i in set(starts)]
    keys = [tuple(text[i : i + depth]) for i in order]
    assert keys == sorted(keys)


@pytest.mark.parametrize("seed", range(30))
def test_repeated_starts_equal_brute_force(seed):
    rng = random.Random(seed)
    length, least, words = 20, 12, 3
    alphabet = [b"ab ", b"a", b"abc  ", bytes(range(256))][seed % 4]
    base = bytes(rng.choice(alphabet) for _ in range(60))
    stretches = []
    for i in range(rng.randint(1, 9)):
        n = rng.randint(1, 15)
        at = rng.randint(0, 20)
        raw = bytes(rng.choice(alphabet) if rng.random() < 0.02 else b for b in base[at : at + n + length])
        cut = rng.choice([0, 0, rng.randint(0, length - least)])
        stretches.append((n, raw[: n + length - cut], rng.randint(0, 3)))
    got = suffix_dedup.repeated_starts(stretches, length, least, words)
    all_ = [(i, s, raw[s : s + length], doc) for i, (n, raw, doc) in enumerate(stretches) for s in range(n)]
    for i, (n, raw, doc) in enumerate(stretches):
        hit, flag = got[i]
        want_flag = False
        for s in range(n):
            own = raw[s : s + length]
            others = [(x, d) for j, at, x, d in all_ if (j, at) != (i, s)]
            assert hit[s] == (len(own) == length and any(x == own for x, _ in others))
            for x, d in others:
                k = next((k for k, (p, q) in enumerate(zip(own, x)) if p != q), min(len(own), len(x)))
                if d != doc and (k >= length or k >= least and len(re.findall(rb"[^ \t\n\x0b\f\r]+", own[:k])) >= words):
                    want_flag = True
        assert flag == want_flag


def awkward():
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randint(0, 999)}" for _ in range(120))
    texts = ["x" * 1500, "x" * 399, "x" * 400, "ab" * 700, "abc" * 500, passage, passage[:401] + "tail" * 50, "head" * 50 + passage[20:430], passage + passage]
    texts += [f"{rng.random()} {passage[:450]} {rng.random()}" for _ in range(12)]
    return [(1000 + i, t, None, None, None) for i, t in enumerate(texts)]


def planted():
    """Passages of 45 to 70 words and of 399 to 401 bytes in different surroundings, and one in very many."""
    rng = random.Random(5)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    texts = []
    for n in (45, 48, 49, 50, 51, 60, 70):
        passage = fresh(n)
        texts += [f"{fresh(30)} {passage} {fresh(30)}" for _ in range(2)]
    for n in (399, 400, 401):
        raw = fresh(200)[:n]
        texts += [f"{fresh(9)}<{raw}>{fresh(9)}", f"{fresh(5)}[{raw}]{fresh(20)}"]
    short, mid, long_ = fresh(45)[:250], fresh(60)[:330], fresh(200)[:450]
    for p in (short, mid, long_):
        texts += [f"{fresh(rng.randint(0, 40))}-{p}+{fresh(rng.randint(0, 40))}" for _ in range(25)]
    texts += [fresh(3) + " the" * 90, fresh(3) + " the" * 60]
    return [(5000 + i, t, None, None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("stretches", [512, 3])
def test_equals_brute_force(spark, monkeypatch, stretches):
    """Also where every key of more than three stretches is split, down to whole strings."""
    monkeypatch.setattr(suffix_dedup, "STRETCHES", stretches)
    rows = documents() + awkward() + planted()
    want = Counter((r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows], 400), strict=True))
    assert rows_of(spark.createDataFrame(rows, DOCS)) == want


def test_shuffle_paths_and_generated_table(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_TEXTS", 0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], 400), strict=True))
    assert rows_of(docs) == want


def test_empty_table_and_clashing_columns(spark):
    assert suffix_dedup.cut_repeats(spark.createDataFrame([], DOCS)).count() == 0
    extra = spark.createDataFrame(documents()[:8], DOCS).withColumn("digest", F.lit(1)).withColumn("spans", F.lit(2)).withColumn("hash", F.lit(1))
    assert suffix_dedup.cut_repeats(extra).count() == 8
