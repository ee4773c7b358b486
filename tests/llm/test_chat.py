import random

from pyspark.sql import functions as F

from sluice.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", None, "plain", "</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_sep|><s>", "[\\INST]", "<|im_next|", "a<", "|im_end|>", "\\", "<<s>>", "é 日本\n\n", "<|im_start|>user<|im_sep|>x<|im_end|>\n", "[/INST][/INST]", "$1 \\2 ${x}"]


def conversations(seed=4):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "assistant", None, "<|im_sep|>"]), "".join(rng.choice(NASTY) or "" for _ in range(rng.randint(0, 4)))))
    rows += [(100, 1, "user", "tie b"), (100, 1, "user", "tie a"), (100, None, "user", None), (None, 0, "assistant", "no conversation"), (101, 0, "assistant", "twice"), (101, 0, "assistant", "twice")]
    rows += [(102, t, "assistant" if t % 3 else "user", f"t{t}") for t in range(1500)]
    return rows


def test_round_trip_is_exact(spark):
    rows = conversations()
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = {r.conv_id: r for r in out.withColumn("turns", chat.parse_chats(F.col("formatted"))).withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("loss_spans"))).collect()}
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r)
    assert set(got) == set(want)
    for key, own in want.items():
        own = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[key].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[key].n_turns == len(own)
        assert got[key].loss == [r[3] or "" for r in own if r[2] == "assistant"]
        # Adjacent turns of one role share a block.
        blocks = sum(i == 0 or (own[i - 1][2] or "") != (r[2] or "") for i, r in enumerate(own))
        assert got[key].formatted.count("<|im_start|>") == blocks == got[key].formatted.count("<|im_end|>")
        assert got[key].formatted.count("<s>") == got[key].formatted.count("[INST]") == got[key].formatted.count("</s>") == 0


def test_escaping_is_reversible(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(x for x in NASTY if x)], "i long, t string")
    t = chat.Template()
    for r in df.select("t", t.escape(F.col("t")).alias("e"), t.unescape(t.escape(t.escape(F.col("t")))).alias("once"), t.unescape(t.escape(F.col("t"))).alias("back")).collect():
        assert r.back == r.t and r.once == r.e


def test_empty_table_and_extra_columns(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame(conversations()[:9], SCHEMA).withColumn("turns", F.lit(1)).withColumn("formatted", F.lit("x"))
    assert chat.format_chats(extra).count() > 0


def test_main_path_has_no_python(spark):
    df = chat.op6_chat_format(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
