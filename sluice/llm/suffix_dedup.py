"""Repeated byte strings by suffix arrays: two-stage sorting of the stretches that can hold a repeat, and their common prefixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialise, table

LENGTH = 400
#: Least bytes of a passage of PASSAGE_WORDS words; anchors are taken in strings of this length.
SHARED = 240
PASSAGE_WORDS = 50
#: Starts of strings that one suffix array sorts, at about.
BUCKET_STARTS = 50_000
#: A key with more different stretches is split by more bytes before a bucket takes it.
STRETCHES = 1024
#: Parts that a split stretch is divided into.
PARTS = 8
#: Distinct texts whose anchors or spans are broadcast at most; beyond, they are joined by shuffle.
BROADCAST_TEXTS = 200_000
BROADCAST_ITEMS = 4_000_000

IS_SPACE = np.zeros(256, bool)
IS_SPACE[9:14] = IS_SPACE[32] = True


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values."""
    out, span = v, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[: len(v) - w + 1], out[w - span : w - span + len(v) - w + 1])
    return out


def anchors(text: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the text's anchors: for each string of length bytes, the least-hashed anchor in it, the first of equals."""
    n, w, slice_ = len(text), length - anchor + 1, K.SLICE
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, hashes = [], []
    up, down = K.powers(slice_)
    low = np.uint64((1 << 20) - 1)
    with np.errstate(over="ignore"):
        for a in range(0, n - length + 1, slice_ - length):
            part = text[a : min(n, a + slice_)]
            p = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=p[1:])
            h = K.mix((p[anchor:] - p[:-anchor]) * down[: len(part) - anchor + 1])
            least = _window_min((h & ~low) | np.arange(len(h), dtype=np.uint64), w)
            got = least[np.concatenate([[True], least[1:] != least[:-1]])] & low
            got = np.unique(got).astype(np.int64)
            places.append(got + a)
            hashes.append(h[got])
            if a + slice_ >= n:
                break
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def owned_starts(place: np.ndarray, hashes: np.ndarray, n: int, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Half-open ranges of string starts that belong to each anchor: those whose window has it as its least.

    A start belongs to an anchor inside its string; ranges of all anchors together
    cover every start, and where two anchors are in a string, the least hash
    (first of equals) has it.
    """
    lo, hi = np.maximum(place - (length - anchor), 0), np.minimum(place + 1, n - length + 1)
    key = hashes & ~np.uint64((1 << 20) - 1)
    for i in range(len(place)):
        j = i - 1
        while j >= 0 and place[j] > place[i] - (length - anchor) - 1:
            if key[j] <= key[i]:
                lo[i] = max(lo[i], place[j] + 1)
                break
            j -= 1
        j = i + 1
        while j < len(place) and place[j] <= place[i] + (length - anchor):
            if key[j] < key[i]:
                hi[i] = min(hi[i], place[j] - (length - anchor))
                break
            j += 1
    return lo, np.maximum(lo, hi)


def _anchor_task(length: int, anchor: int):
    """Arrow task: each distinct anchor hash of each text, and how often the text has it. A text that the task has had before is skipped."""

    def run(batches):
        had: set[bytes] = set()
        for b in batches:
            data, offsets = K.buffers(b.column("text"))
            own, hashes, counts = [], [], []
            for i, digest in enumerate(b.column("digest").to_pylist()):
                if digest in had:
                    continue
                had.add(digest)
                h, n = np.unique(anchors(data[offsets[i] : offsets[i + 1]], length, anchor)[1], return_counts=True)
                own.append(np.full(len(h), i)), hashes.append(h), counts.append(n)
            if own:
                at = pa.array(np.concatenate(own))
                cols = [b.column("d1").take(at), b.column("d2").take(at), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(counts))]
                yield pa.RecordBatch.from_arrays(cols, ["d1", "d2", "hash", "n"])

    return run


def _segment_task(length: int, least: int, anchor: int, words: int):
    """Arrow task: for each candidate anchor of a text, the stretch of bytes around it that decides its starts.

    A row has a digest of those bytes, and the bytes themselves. A stretch that the
    batch has had before is a row without bytes: its starts are known to be repeated, and
    adjoining ones are given together.
    """

    def run(batches):
        for b in batches:
            data, offsets = K.buffers(b.column("text"))
            cands, digests = b.column("cands").to_pylist(), b.column("digest").to_pylist()
            first: dict[tuple, list] = {}
            held, done = 0, set()
            for i, digest in enumerate(digests):
                if digest in done:
                    continue
                done.add(digest)
                text = data[offsets[i] : offsets[i + 1]]
                place, hashes = anchors(text, least, anchor)
                lo, hi = owned_starts(place, hashes, len(text), least, anchor)
                last_ok = last_passage_start(text, length, words)
                wanted = set(cands[i])
                for h, p, s, e in zip(hashes.view(np.int64).tolist(), place.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    if h not in wanted or s >= e:
                        continue
                    raw = text[s : e + length].tobytes()
                    key = (h, p - s, e - s, hashlib.blake2b(raw, digest_size=16).digest())
                    own = first.get(key)
                    if own is None:
                        first[key] = [digest, s, len(text), last_ok, raw, False, []]
                        held += len(raw)
                    else:
                        own[5] |= digest != own[0]
                        own[6].append((digest, s, e - s, len(text), last_ok))
                    if held > 8 << 20:
                        yield _segment_batch(first)
                        first, held = {}, 0
            if first:
                yield _segment_batch(first)

    return run


SEGMENT = "digest binary, pos long, n int, len long, last_ok long, key long, ap int, content binary, twice boolean, crossed boolean, bytes binary"


def _segment_batch(first):
    rows, again = [], []
    for (h, ap, n, content), (digest, s, size, last_ok, raw, crossed, others) in first.items():
        rows.append((digest, s, n, size, last_ok, h, ap, content, bool(others), crossed, raw))
        again += [(*x, crossed) for x in others]
    joined: list[list] = []
    for digest, s, n, size, last_ok, crossed in sorted(again):
        if joined and joined[-1][0] == digest and joined[-1][1] + joined[-1][2] == s and joined[-1][5] == crossed:
            joined[-1][2] += n
        else:
            joined.append([digest, s, n, size, last_ok, crossed])
    rows += [(digest, s, n, size, last_ok, None, None, None, True, crossed, None) for digest, s, n, size, last_ok, crossed in joined]
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_(), pa.binary()]
    names = ["digest", "pos", "n", "len", "last_ok", "key", "ap", "content", "twice", "crossed", "bytes"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def last_passage_start(text: np.ndarray, length: int, words: int) -> int:
    """The last start from which what is left of the text is a passage: length bytes, or so many words; -1 if there is none."""
    solid = ~IS_SPACE[text]
    begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    last = len(text) - length
    if len(begins) >= words:
        after = np.flatnonzero(~solid[begins[-words] :])
        last = max(last, begins[-words] + (after[0] if len(after) else len(text)) - 1)
    return max(-1, int(last))


def suffix_array(text: np.ndarray, chosen: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """The chosen starts in the order of their suffixes, as far as depth bytes tell.

    text has numbers from 0 to 256, and depth zeros at its end. Two stages: suffixes smaller
    than their successor are sorted directly; each other one is placed when the scan
    reaches its successor, which is smaller and so comes first. The scan goes
    first byte by first byte, and takes a bucket at once. A start that isn't smaller than its
    successor must be followed by another chosen one, or be the end of its stretch (ends),
    a place so far behind what is asked for that its order doesn't matter.
    """
    rise = np.append(text[1:], 0).astype(np.int32) - text
    # First place at or after each whose next number differs.
    at = np.where(rise != 0, np.arange(len(text)), len(text) - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = rise[at] > 0
    loose = ends[~smaller[ends]]
    direct = chosen[smaller[chosen]]
    induced = np.zeros(len(text) + 1, bool)
    induced[chosen] = True
    induced[direct] = induced[loose] = False
    windows = np.lib.stride_tricks.sliding_window_view(text, depth)
    # Big-endian pairs of bytes, so that the order of memory is that of the numbers.
    direct = direct[np.argsort(np.ascontiguousarray(windows[direct], ">u2").view(f"V{2 * depth}").ravel(), kind="stable")]
    of = np.searchsorted(text[direct], np.arange(258))
    queues: list[list[np.ndarray]] = [[] for _ in range(257)]
    for c in range(257):
        queues[c].append(loose[text[loose] == c])
    order = []
    for c in range(257):
        # Those placed by smaller buckets, then runs of this same byte, layer by layer, then those sorted directly.
        layer = np.concatenate(queues[c])
        bucket = [layer]
        while len(layer):
            layer = layer - 1
            layer = layer[induced[layer] & (text[layer] == c)]
            bucket.append(layer)
        bucket.append(direct[of[c] : of[c + 1]])
        order.append(np.concatenate(bucket))
        before = order[-1] - 1
        before = before[induced[before] & (text[before] > c)]
        by = np.argsort(text[before], kind="stable")
        before = before[by]
        for own in np.split(before, np.flatnonzero(np.diff(text[before])) + 1):
            if len(own):
                queues[text[own[0]]].append(own)
    return np.concatenate(order)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many numbers the suffixes at a and b have in common, up to depth."""
    windows = np.lib.stride_tricks.sliding_window_view(text, depth)
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), 4096):
        differ = windows[a[i : i + 4096]] != windows[b[i : i + 4096]]
        out[i : i + 4096] = np.where(differ.any(1), differ.argmax(1), depth)
    return out


def repeated_starts(stretches: list[tuple[int, bytes, int]], length: int, least: int, words: int) -> list[tuple[np.ndarray, bool]]:
    """For each stretch (number of starts, bytes, text): which of its starts begin a string of length bytes that occurs again, and whether one begins a passage that another text has.

    A passage has length bytes, or so many words (of least bytes at least).
    A stretch has length bytes from just after its last start on, unless its text ends before.
    """
    n = np.array([x[0] for x in stretches])
    size = np.array([len(x[1]) for x in stretches])
    begin = np.cumsum([0, *(n[:-1] + length)])
    text = np.zeros(int(begin[-1] + n[-1] + 2 * length), np.uint16)
    real = np.zeros(len(text), bool)
    for at, (k, raw, _) in zip(begin.tolist(), stretches, strict=True):
        text[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
        text[at : at + len(raw)] += np.uint16(1)
        real[at : at + k] = True
    # Beside the starts, those after the last one up to the first that is smaller than its successor.
    ends = begin + n + length - 1
    rise = np.diff(text.astype(np.int32), append=0)
    up = np.flatnonzero(rise > 0)
    stop = np.append(up, len(text))[np.searchsorted(up, begin + n)]
    stop = np.minimum(stop, ends)
    chosen = np.concatenate([np.arange(a, b + 1) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
    order = suffix_array(text, chosen, ends[stop == ends], length)
    order = order[real[order]]
    row = np.searchsorted(begin, order, side="right") - 1
    left = (begin + size)[row] - order
    doc = np.array([x[2] for x in stretches])[row]

    def prefixes(k: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.minimum(common_prefixes(text, order[k], order[other], length), np.minimum(left[k], left[other]))

    m = len(order)
    near = np.zeros(m + 1, np.int64)
    near[1:m] = prefixes(np.arange(1, m), np.arange(m - 1))
    any_ = np.maximum(near[:-1], near[1:])
    # The nearest entries of other texts, which are the neighbours mostly.
    change = np.append(True, doc[1:] != doc[:-1])
    own = np.cumsum(change) - 1
    first = np.flatnonzero(change)
    last = np.append(first[1:], m)
    cross = np.maximum(np.where(change, near[:-1], 0), np.where(np.append(change[1:], True), near[1:], 0))
    first, last = first[own], last[own]
    for k, other in ((np.flatnonzero((first > 0) & ~change), first - 1), (np.flatnonzero((last < m) & ~np.append(change[1:], True)), last)):
        cross[k] = np.maximum(cross[k], prefixes(k, other[k]))
    # Words that a prefix touches.
    solid = ~IS_SPACE[np.maximum(text, 1) - 1] & (text > 0)
    counted = np.cumsum(solid & ~np.append(False, solid[:-1]))
    ends_at = order + np.maximum(cross, 1) - 1
    touched = counted[ends_at] - counted[order] + solid[order]
    passage = (cross >= length) | ((cross >= least) & (touched >= words))
    hit, flagged = np.zeros(len(text), bool), np.zeros(len(n), bool)
    hit[order[any_ >= length]] = True
    flagged[row[passage]] = True
    return [(hit[a : a + c], bool(f)) for a, c, f in zip(begin.tolist(), n.tolist(), flagged, strict=True)]


RANGES = "digest binary, a long, b long, passage boolean"


def _ranges_batch(rows):
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.binary(), pa.int64(), pa.int64(), pa.bool_()], strict=True)], ["digest", "a", "b", "passage"])


def _sort_task(length: int, least: int, words: int):
    """Grouped Arrow task over one bucket of stretches: byte ranges of repeated strings, and texts with passages of others."""

    def run(t: pa.Table) -> pa.Table:
        digests = t.column("digest").to_pylist()
        number = {d: i for i, d in enumerate(dict.fromkeys(digests))}
        stretches = [(n, raw, number[d]) for n, raw, d in zip(t.column("n").to_pylist(), t.column("bytes").to_pylist(), digests, strict=True)]
        out: list[tuple] = []
        for digest, pos, twin, (hit, passage) in zip(digests, t.column("pos").to_pylist(), t.column("twin").to_pylist(), repeated_starts(stretches, length, least, words), strict=True):
            if passage:
                out.append((digest, None, None, True))
            if not twin:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
                out += [(digest, pos + a, pos + b + length - 1, False) for a, b in edge.reshape(-1, 2).tolist()]
        return pa.Table.from_batches([_ranges_batch(out)])

    return run


def _string_task(length: int, least: int, words: int):
    """Arrow task over stretches of one start: digests of the string of length bytes, and of the shortest prefix that is a passage."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for digest, pos, raw in zip(b.column("digest").to_pylist(), b.column("pos").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                raw = raw[:length]
                solid = ~IS_SPACE[np.frombuffer(raw, np.uint8)]
                begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
                short = max(least, int(begins[words - 1]) + 1) if len(begins) >= words else length
                for kind, k in ((0, length), (1, min(short, length))):
                    if len(raw) >= k:
                        out.append((digest, pos, kind, hashlib.blake2b(raw[:k], digest_size=16).digest()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.binary(), pa.int64(), pa.int32(), pa.binary()], strict=True)], ["digest", "pos", "kind", "string"])

    return run


def _merge_task(batches):
    """Arrow task: each text's byte ranges, merged to spans."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        out = []
        for ranges in b.column("ranges").to_pylist():
            spans: list[dict] = []
            for x in sorted(ranges, key=lambda x: x["a"]):
                if spans and x["a"] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], x["b"])
                else:
                    spans.append({"start": x["a"], "end": x["b"]})
            out.append(spans)
        yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(out, kind), b.column("passage")], ["digest", "spans", "passage"])


def _small(df: DataFrame, texts: int, items) -> bool:
    """Whether df has few enough rows and items to broadcast."""
    n, m = df.agg(F.count("*"), F.coalesce(F.sum(items), F.lit(0))).first()
    return n <= texts and m <= BROADCAST_ITEMS


def _known(rows: DataFrame, length: int, crossed) -> DataFrame:
    """Ranges of stretches that occur elsewhere as a whole: all their strings do."""
    last, fits = F.col("len") - length, F.col("pos") <= F.col("len") - length
    return rows.select("digest", F.when(fits, F.col("pos")).alias("a"), F.when(fits, F.least(F.col("pos") + F.col("n") - 1, last) + length).alias("b"), (crossed & (F.col("pos") <= F.col("last_ok"))).alias("passage"))


SAME = ["key", "ap", "n", "content"]


def _distinct(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Different stretches, one row each; how many each key has, where there are two or more; and the ranges of those that occur twice."""
    own = F.struct("digest", "pos", "len", "last_ok")
    alike = rows.groupBy(*SAME).agg(F.min(own).alias("own"), F.max(own).alias("last"), F.max("twice").alias("twice"), F.max("crossed").alias("crossed"), F.first("bytes").alias("bytes"))
    alike = alike.select(*SAME, "own.*", "bytes", (F.col("twice") | (F.col("own") != F.col("last"))).alias("twin"), (F.col("crossed") | (F.col("own.digest") != F.col("last.digest"))).alias("crossed"))
    alike = materialise(alike, "stretches", "zstd")
    twins = alike.where("twin").select(*SAME, F.col("crossed").alias("all_crossed"))
    known = _known(rows.select(*SAME, "digest", "pos", "len", "last_ok").join(twins, SAME), length, F.col("all_crossed"))
    return alike, materialise(alike.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "keys"), known


def _split(rows: DataFrame, length: int, slack: int, known: int) -> tuple[DataFrame, int]:
    """Stretches in up to PARTS parts, each under a key of more bytes; and how much slack is left.

    A string has its anchor 0 to slack bytes after its start, and known bytes of
    it are in the key. Those of a part have it in a range of step places: so they hold all bytes before the
    anchor that its first place leaves, and all behind that its last one does.
    """
    step = -(-(slack + 1) // PARTS)
    ap, n, parts = F.col("ap"), F.col("n"), []
    for low in range(0, slack + 1, step):
        before = min(low, slack - step + 1)
        behind = max(0, slack - (low + step - 1))
        first = F.greatest(F.lit(0), ap - (low + step - 1))
        count = F.least(n, ap - low + 1) - first
        key = F.xxhash64("key", F.lit(low), F.substring(F.col("bytes"), ap - before + 1, F.lit(before)), F.substring(F.col("bytes"), ap + known + 1, F.lit(behind)))
        parts.append(F.when(count > 0, F.struct(
            key.alias("key"), (ap - before - first).cast("int").alias("ap"), count.cast("int").alias("n"), (F.col("pos") + first).alias("pos"), F.substring(F.col("bytes"), first + 1, count + length).alias("bytes"))))
    split = rows.select("digest", "len", "last_ok", "twin", "crossed", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("part"))
    return split.select("digest", "part.*", "len", "last_ok", F.col("twin").alias("twice"), "crossed", F.substring(F.unhex(F.sha2("part.bytes", 256)), 1, 16).alias("content")), step - 1


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", shared: int = SHARED, words: int = PASSAGE_WORDS) -> DataFrame:
    """docs' id and text with spans, the merged byte ranges covered by strings of length bytes that also start elsewhere, and passage.

    Texts are their UTF-8 bytes; null counts as empty; matches never cross
    documents; strings are judged on the input. Shorter texts have no spans, and a text that
    occurs twice (repeated rows too) is covered whole if it is long enough. Null ids
    don't matter, extra columns are ignored, an empty table gives an empty result.

    passage tells whether another document has a byte range of this one with length
    bytes, or with so many words (runs of other than white space, those cut at its ends
    included) and shared bytes at least. It removes nothing.

    Every string of shared bytes holds an anchor, the place in it with the least hash, and equal
    strings hold the same one. Anchors are counted, and only the stretches around anchors that
    occur in two places go on. Equal stretches are collapsed: their strings are all
    repeated. Those left alone under their anchor are dropped. The rest, in buckets by anchor,
    are sorted by two-stage suffix sorting, and the common prefixes of neighbours tell
    which strings repeat, and for how long. An anchor with more than STRETCHES different
    stretches is split: they get keys of more bytes before or after the anchor,
    and are collapsed, dropped and split again until keys are small. What still shares a key when it
    spans whole strings is strings of one start each; these are grouped by 128-bit digests of BLAKE2.
    """
    least = min(shared, length)
    anchor = max(1, least * 3 // 5)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    source = base.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    long_ = F.octet_length("text") >= least
    # The digest as two numbers, which are grouped without being sorted.
    halves = [F.xxhash64("digest").alias("d1"), F.xxhash64("digest", F.lit(1)).alias("d2")]
    copies = materialise(source.where(long_).groupBy("digest").agg(F.count("*").alias("size"), F.min("doc_id").alias("first_id")), "texts")
    found = materialise(source.where(long_).select("text", "digest", *halves).mapInArrow(_anchor_task(least, anchor), "d1 long, d2 long, hash long, n long"), "anchors")
    # Hashes that two texts have, or one text twice.
    common = found.groupBy("hash").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.max("n").alias("n")).where("lo != hi OR n > 1").select("hash")
    common = materialise(common, "shared")
    marked = found.select("d1", "d2", "hash").join(common, "hash")
    cands = marked.groupBy("d1", "d2").agg(F.collect_set("hash").alias("cands")).join(copies.select("*", *halves), ["d1", "d2"])
    cands = materialise(cands.select("digest", "first_id", "cands"), "candidates")

    # The texts that have candidates, one row of each.
    side = F.broadcast(cands) if _small(cands, BROADCAST_TEXTS, F.size("cands")) else cands
    chosen = source.where(long_).join(side.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("text", "digest", "cands")
    segments = materialise(chosen.mapInArrow(_segment_task(length, least, anchor, words), SEGMENT), "segments", "zstd")

    rows, slack = segments.where("content IS NOT NULL"), least - anchor
    ranges = _known(segments.where("content IS NULL"), length, F.col("crossed"))
    sorted_ = None
    while True:
        # Keys with one stretch are left out: nothing else can have its strings.
        alike, keys, known = _distinct(rows, length)
        ranges = ranges.unionByName(known)
        few = alike.join(keys.where(F.col("k") <= STRETCHES), "key", "left_semi")
        sorted_ = few if sorted_ is None else sorted_.unionByName(few)
        large = keys.where(F.col("k") > STRETCHES)
        if large.isEmpty():
            break
        many = alike.join(large, "key", "left_semi")
        if not slack:
            strings = materialise(many.select("digest", "pos", "bytes").mapInArrow(_string_task(length, least, words), "digest binary, pos long, kind int, string binary"), "strings")
            place = F.struct("digest", "pos")
            again = strings.groupBy("kind", "string").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("(kind = 0 AND lo != hi) OR lo.digest != hi.digest").select("kind", "string")
            hit = strings.join(again, ["kind", "string"], "left_semi")
            ranges = ranges.unionByName(hit.select("digest", F.when(F.col("kind") == 0, F.col("pos")).alias("a"), F.when(F.col("kind") == 0, F.col("pos") + length).alias("b"), (F.col("kind") == 1).alias("passage")))
            break
        rows, slack = _split(many, length, slack, least - slack)
        rows = materialise(rows, "parts", "zstd")
    total = sorted_.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_buckets = max(1, -(-int(total) // BUCKET_STARTS))
    bucketed = sorted_.select(F.pmod("key", F.lit(n_buckets)).alias("bucket"), "n", "bytes", "digest", "pos", "twin")
    ranges = ranges.unionByName(bucketed.groupBy("bucket").applyInArrow(_sort_task(length, least, words), RANGES))
    listed = ranges.groupBy("digest").agg(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "b"))).alias("ranges"), F.max("passage").alias("passage"))
    spans = listed.mapInArrow(_merge_task, "digest binary, spans array<struct<start: long, end: long>>, passage boolean")
    whole = copies.where("size > 1").select("digest", F.lit(True).alias("all"))
    spans = materialise(spans.join(whole, "digest", "full"), "spans")
    side = F.broadcast(spans) if _small(spans, BROADCAST_TEXTS, F.coalesce(F.size("spans"), F.lit(1))) else spans
    size = F.octet_length("text").cast("long")
    none = F.array().cast("array<struct<start: long, end: long>>")
    covered = F.when(F.col("all"), F.when(size >= length, F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))).otherwise(none))
    whole_passage = F.col("all") & ((size >= length) | (F.regexp_count("text", F.lit(r"\S+")) >= words))
    return source.join(side, "digest", "left").select("doc_id", "text", F.coalesce(covered, F.col("spans"), none).alias("spans"), (F.coalesce("passage", F.lit(False)) | F.coalesce(whole_passage, F.lit(False))).alias("passage"))


def _cutter(batches):
    """Arrow task: counts of each text, and what is left of it."""
    for b in batches:
        data, offsets = K.buffers(b.column("text"))
        total, removed, n, kept = [], [], [], []
        for i, spans in enumerate(b.column("spans").to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            parts, at = [], 0
            for s in spans:
                parts.append(raw[at : s["start"]])
                at = s["end"]
            parts.append(raw[at:])
            left = b"".join(parts)
            total.append(len(raw)), removed.append(len(raw) - len(left)), n.append(len(spans)), kept.append(left)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), b.column("passage")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "passage"])


def cut_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain, binary, as a cut may split a character) and passage of each document row."""
    found = repeats(docs, length, id_col, text_col)
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_cutter, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, passage boolean")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of its repeated 400-byte strings, and whether another one has a passage of it of 50 words or more (1) or not (0)."""
    cut = cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("passage").cast("int").alias("shares_passage"))
