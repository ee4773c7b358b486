"""BPE encoding and decoding over a trie of distinct words.

The last token of a prefix's encoding depends on that prefix alone: it is the one
token, among those that the prefix ends with, that can follow the last token of the
prefix before it. So words that share a prefix share its encoding, and a word's
encoding is read back from its node along the beginnings of last tokens.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Nodes of a trie; beyond, a task begins a new one. A word of more than LONG bytes has a path of its own.
MAX_NODES = 1 << 20
LONG = 1 << 12
#: Token pairs whose check is remembered.
MAX_PAIRS = 1 << 20
#: Bytes of text that one output batch stands for at about.
OUT_BYTES = 4 << 20

_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once a worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def byte_characters() -> dict[str, int]:
    """How byte-level vocabularies print bytes: those that show as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class Vocabulary:
    """Tokens by their bytes, how each is merged, and how texts are cut into words."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_characters()
        model, added = spec["model"], spec["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        self.ids = {bytes(chars[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for a, b in merges:
            left, right, whole = (model["vocab"][x] for x in (a, b, a + b))
            self.merged[left, right] = whole
            self.halves[whole] = left, right
        order = [model["vocab"][a + b] for a, b in merges]
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        if not (order == sorted(set(order)) and plain and spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]):
            raise ValueError("a byte-level vocabulary whose ids follow its merges, without a normalizer, is needed")
        # Lengths of the tokens of three bytes or more that end in three given bytes, longest first.
        lengths: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) > 2:
                lengths.setdefault(t[-3:], set()).add(len(t))
        self.lengths = {end: sorted(own, reverse=True) for end, own in lengths.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.selfmade: dict[int, bool] = {}
        self.words_of = regex.compile(public_tokenizers.PATTERN).findall
        self.cut_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.own_words = Tokenizer.from_file(path).pre_tokenizer
        # Characters that Unicode has not assigned here may be letters to one library and not to another.
        self.unassigned = np.zeros(0x110000, bool)
        self.unassigned[[c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn"]] = True
        by_id = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        sizes = np.zeros(max(by_id) + 2, np.int64)
        for i, t in by_id.items():
            sizes[i + 1] = len(t)
        self.starts = np.cumsum(sizes)
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(max(by_id) + 1)), np.uint8)

    def can_follow(self, a: int, b: int) -> bool:
        """Whether the text of a, then b, is encoded as just these two."""
        key = a, b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._unmerged(a, b, 1 << 40)
        return got

    def _unmerged(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge earlier than limit crosses the border of a and b.

        Both are taken apart from their latest merge back, the later one of the two
        first; at each step the tokens at the border must not have merged before the
        merge that is undone.
        """
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            late_a, late_b = a if a in self.halves else -1, b if b in self.halves else -1
            if late_a < 0 and late_b < 0:
                return True
            # Of equal tokens the left one merges first, so the right one is undone first.
            if late_a > late_b:
                limit, a = a, self.halves[a][1]
            else:
                limit, b = b + 1, self.halves[b][0]

    def is_whole(self, t: int) -> bool:
        """Whether the text of t is encoded as t alone."""
        got = self.selfmade.get(t)
        if got is None:
            got = True
            if t in self.halves:
                a, b = self.halves[t]
                got = self.is_whole(a) and self.is_whole(b) and self._unmerged(a, b, t)
            self.selfmade[t] = got
        return got

    def last_token(self, word: bytes, end: int, last_at) -> tuple[int, int]:
        """(token, length): the last token of word[:end]; last_at(i) is that of word[:i], for i below end and above 0."""
        ids = self.ids
        for size in self.lengths.get(word[end - 3 : end], ()) if end > 2 else ():
            if size <= end:
                t = ids.get(word[end - size : end])
                if t is not None and (self.is_whole(t) if size == end else self.can_follow(last_at(end - size), t)):
                    return t, size
        if end > 1:
            t = ids.get(word[end - 2 : end])
            if t is not None and (self.is_whole(t) if end == 2 else self.can_follow(last_at(end - 2), t)):
                return t, 2
        return ids[word[end - 1 : end]], 1

    def split(self, text: str) -> list[str | int]:
        """The words of a text in order; a special token stands as its id."""
        if not any(s in text for s in self.special):
            return self.words(text)
        out: list[str | int] = []
        for part in self.cut_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.words(part)
        return out

    def words(self, text: str) -> list[str]:
        if text.isascii() or not self.unassigned[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            return self.words_of(text)
        return [text[a:b] for _, (a, b) in self.own_words.pre_tokenize_str(text)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        begin = self.starts[ids]
        sizes = self.starts[ids + 1] - begin
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(begin - (ends - sizes), sizes)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


def shared_prefix(a: bytes, b: bytes) -> int:
    """How many bytes a and b begin with in common."""
    n = min(len(a), len(b))
    differs = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differs.bit_length() + 7) // 8


class WordTrie:
    """Distinct words, inserted byte by byte; each node knows the last token of its prefix and the node where that token begins."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last = array("i", [-1])
        self.back = array("i", [0])
        self.ids_of: dict[str | int, bytes] = {i: int(i).to_bytes(4, "little") for i in self.vocab.special.values()}

    def add(self, words) -> None:
        """Encode words that are not known yet: the trie is gone through depth first, in the order of their bytes."""
        fresh = sorted((w.encode(), w) for w in words if w not in self.ids_of)
        before, path = b"", [0]
        child, last, last_token = self.child, self.last, self.vocab.last_token
        last_at = lambda i: last[path[i]]
        for raw, word in fresh:
            if len(raw) > LONG:
                self.ids_of[word] = self._alone(raw)
                continue
            shared = shared_prefix(raw, before)
            del path[shared + 1 :]
            node = path[-1]
            for end in range(shared + 1, len(raw) + 1):
                edge = node << 8 | raw[end - 1]
                node = child.get(edge)
                if node is None:
                    node = child[edge] = len(last)
                    token, size = last_token(raw, end, last_at)
                    last.append(token)
                    self.back.append(path[end - size])
                path.append(node)
            before = raw
            self.ids_of[word] = self._read_back(path[-1])

    def _read_back(self, node: int) -> bytes:
        out = []
        while node:
            out.append(self.last[node])
            node = self.back[node]
        return struct.pack(f"<{len(out)}I", *reversed(out))

    def _alone(self, raw: bytes) -> bytes:
        """A very long word: its prefixes are one path, which is dropped afterwards."""
        last, size = array("i", [-1]), array("i", [0])
        for end in range(1, len(raw) + 1):
            t, n = self.vocab.last_token(raw, end, last.__getitem__)
            last.append(t)
            size.append(n)
        out, end = array("I"), len(raw)
        while end:
            out.append(last[end])
            end -= size[end]
        out.reverse()
        return np.asarray(out, "<u4").tobytes()


def encode_texts(trie: WordTrie, texts: list[str]) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit integers."""
    words = [trie.vocab.split(t) for t in texts]
    if len(trie.last) > MAX_NODES:
        trie.clear()
    trie.add({w for own in words for w in own})
    return [b"".join(map(trie.ids_of.__getitem__, own)) for own in words]


def _coder(path: str, names: list[str]):
    def run(batches):
        vocab = vocabulary(path)
        trie = WordTrie(vocab)
        for b in batches:
            texts = ["" if t is None else t for t in b.column("_coded").to_pylist()]
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= OUT_BYTES):
                    size += len(texts[j])
                    j += 1
                ids = encode_texts(trie, texts[i:j])
                back = [vocab.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in ids]
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(i, j - i) for n in names), pa.array(ids, pa.binary()), pa.array(back, pa.string())], [*names, "ids", "decoded"])
                i = j

    return run


def encode_decode(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Token ids of every whole text, and the text that they decode to.

    path names a byte-level BPE vocabulary file whose ids follow its merges. Returns
    the carried columns, ids (binary, little-endian unsigned 32-bit) and decoded, one
    row per row of docs; special tokens that a text spells become their ids, nothing
    is cut or padded. A null text counts as empty: no ids and an empty decoded text.
    Repeated rows and null ids stay as they are; an empty table gives none; other
    columns, whatever they are called, aren't read.

    A task keeps one trie of the distinct words that it has met, of about MAX_NODES
    nodes at most: before a stretch of texts that finds it larger, it begins anew.
    Nothing is shuffled.
    """
    source = docs.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{text_col}`").cast("string").alias("_coded"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_coded"]
    return source.mapInArrow(_coder(path, list(carry)), ", ".join([*kept, "ids binary", "decoded string"]))


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document, and of what they decode to."""
    import public_tokenizers

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
