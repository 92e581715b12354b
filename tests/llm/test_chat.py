import hashlib

import __spark_entry__
from pyspark.sql import functions as F

from gridloom.llm import chat

SF = "/root/testdata/sf0.001"


def test_examples_and_read_back(spark):
    rows = [
        (1, 0, "system", "&lt; & [TURN]x</s>"), (1, 1, "user", None), (1, 2, "assistant", "a[b]<c>&#91;"), (1, 3, "user", "q"), (1, 4, "assistant", ""),
        (2, 0, "user", "only\nuser"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (4, 1, None, "role\nless"), (None, 0, "assistant", "no id"),
    ]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, example string")
    made = chat.examples(turns)
    read = made.select("conv_id", "example", "loss_chars", chat.read_turns(F.col("text")).alias("turns"), chat.read_loss(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss")).collect()
    by = {}
    for r in sorted(read, key=lambda r: r.example):
        by.setdefault(r.conv_id, []).append(r)
    for conv, own in by.items():
        mine = [(role or "", text or "") for c, _, role, text in rows if c == conv]
        assert [(t.role, t.text) for t in own[-1].turns] == mine
        assert [r.loss for r in own if r.turns[-1].role == "assistant"] == [t for role, t in mine if role == "assistant"]
        for r in own:
            assert [(t.role, t.text) for t in r.turns] == mine[: len(r.turns)]
    assert made.where("loss_chars = 0 and conv_id = 2").count() == 1
    assert chat.examples(turns.limit(0)).count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_against_plain_python(spark):
    got = {r.conv_id: r for r in __spark_entry__.queries()["op4_chat_formatting"](spark, SF).collect()}
    talks = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
