"""Chat formatting with expressions only: sort, merge, join, mask, and read back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Offsets are summed within chunks of so many pieces, then over chunks.
CHUNK = 256


@dataclass(frozen=True)
class Template:
    """Markers of a chat template. reserved: other control strings that texts must not spell either."""

    open: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    next: str = "<|im_next|>"
    end: str = "<|im_end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    trained: tuple[str, ...] = field(default=("assistant",))

    def firsts(self) -> list[tuple[str, list[str]]]:
        by: dict[str, list[str]] = {}
        for s in sorted({self.open, self.sep, self.next, self.end, *self.reserved}, key=len, reverse=True):
            by.setdefault(s[0], []).append(s[1:])
        return sorted(by.items())

    def escape(self, text: Column) -> Column:
        """One more backslash after the first character of each control string, however many it has."""
        for first, rests in self.firsts():
            text = F.regexp_replace(text, f"({_quote(first)})(\\\\*)({'|'.join(map(_quote, rests))})", "$1\\\\$2$3")
        return text

    def unescape(self, text: Column) -> Column:
        """One backslash less in each; the inverse of escape."""
        for first, rests in self.firsts():
            text = F.regexp_replace(text, f"({_quote(first)})\\\\(\\\\*)({'|'.join(map(_quote, rests))})", "$1$2$3")
        return text


def _quote(s: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in s)


def _prefix_sums(lens: Column) -> Column:
    """Sums of all earlier elements, in chunks so that no array is copied once for each element of a long one."""
    zero = F.lit(0).cast("long")
    scan = lambda values, start: F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    count = F.ceil(F.size(lens) / F.lit(float(CHUNK))).cast("int")
    chunk = lambda k: F.slice(lens, k * CHUNK + 1, F.lit(CHUNK))
    ks = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    heads = scan(F.transform(ks, lambda k: F.aggregate(chunk(k), zero, lambda a, x: a + x)), zero)
    return F.flatten(F.transform(F.arrays_zip(ks.alias("k"), F.slice(heads, 1, F.greatest(count, F.lit(1))).alias("h")), lambda z: F.slice(scan(chunk(z["k"]), z["h"]), 1, F.size(chunk(z["k"])))))


def format_chats(turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    Turns are sorted by (turn, role, text); null turns come first, ties and
    repeated rows are kept and so have a defined order. Null roles and texts count
    as empty. Adjacent turns of one role become one block, their texts divided by
    a marker. Control strings in roles and texts are escaped, so that the output
    can be parsed back exactly (parse_chats). loss_spans are half-open code-point
    ranges of formatted that hold the escaped texts of trained roles. A null
    conv_id is a conversation of its own; an empty table gives an empty
    result; extra columns are ignored. A conversation is one output row and
    is built in one task, as its string must be.
    """
    t = template
    row = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    got = turns.select(F.col(f"`{conv}`").alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    # Where blocks start, and the turns of each.
    got = got.withColumn("n", F.size("turns")).withColumn(
        "starts", F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"])))
    ends = F.concat(F.slice("starts", 2, F.col("n")), F.array(F.col("n") + 1))
    got = got.withColumn("bounds", F.arrays_zip(F.col("starts").alias("s"), ends.alias("e")))
    got = got.withColumn("blocks", F.transform("bounds", lambda b: F.slice("turns", b["s"], b["e"] - b["s"])))
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)

    def block(b):
        name = b[0]["role"]
        texts = F.transform(b, lambda x, i: F.array(
            piece(F.when(i == 0, F.concat(F.lit(t.open), t.escape(name), F.lit(t.sep))).otherwise(F.lit(t.next)), no),
            piece(t.escape(x["text"]), name.isin(*t.trained))))
        return F.concat(F.flatten(texts), F.array(piece(F.lit(t.end + "\n"), no)))

    got = got.withColumn("pieces", F.flatten(F.transform("blocks", block)))
    got = got.withColumn("lens", F.transform("pieces", lambda p: F.length(p["s"]).cast("long")))
    got = got.withColumn("at", _prefix_sums(F.col("lens")))
    spans = F.filter(F.arrays_zip(F.col("pieces").alias("p"), F.col("at").alias("a"), F.col("lens").alias("n")), lambda z: z["p"]["loss"])
    return got.select(
        "conv_id", F.col("n").cast("long").alias("n_turns"), F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        F.transform(spans, lambda z: F.struct(z["a"].alias("start"), (z["a"] + z["n"]).alias("end"))).alias("loss_spans"))


def parse_chats(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    t = template
    blocks = F.split(formatted, _quote(t.end) + "\n", -1)
    blocks = F.filter(blocks, lambda b: b != "")

    def turns(b):
        parts = F.split(F.substring(b, len(t.open) + 1, 2**31 - 1), _quote(t.sep), 2)
        return F.transform(F.split(parts[1], _quote(t.next), -1), lambda x: F.struct(t.unescape(parts[0]).alias("role"), t.unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_texts(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: template.unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


PROBE = "</s>[INST] ok [/INST]"


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation and a probe of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = format_chats(rows.unionByName(probe))
    out = out.withColumn("turns", parse_chats(F.col("formatted"))).withColumn("loss", F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(regexp_replace(text, '(<)(\\*)(\|im_start\|>|\|im_sep\|>|\|im_next\|>|\|im_end\|>|\|endoftext\|>|/s>|s>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/INST\]|INST\])', '\1\\\2\3', 'g')) AS n,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AND row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) > 1 AS same FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN same THEN length('<|im_next|>') ELSE length('<|im_start|><|im_sep|><|im_end|>') + 1 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
