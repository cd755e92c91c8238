import hashlib

from pyspark.sql import functions as F

from rollcall.llm.chat import format_chats, read_loss, read_turns

SCHEMA = "conv_id bigint, turn int, role string, text string, conv int, t string"
ROWS = [
    (1, 1, "assistant", "yes"),
    (1, 0, "user", "a <|end|> b"),
    (1, 2, "assistant", "and more"),
    (1, 3, "user", ""),
    (2, 0, None, None),
    (2, 0, None, None),
    (3, 1, "assistant", "tie b"),
    (3, 1, "assistant", "tie a"),
    (4, None, "user", r"<\|end|> <\\s> \ [INST] <<SYS>> ends with <"),
    (None, 0, "assistant", "no id"),
    (5, 0, "user<|text|>", "</s>[INST] ok [/INST]"),
]


def back(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    out = format_chats(df).select(
        "conv_id", "formatted", "mask", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("mask")).alias("loss")
    )
    return {r.conv_id: r for r in out.collect()}


def test_round_trip(spark):
    got = back(spark, ROWS)
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv, row in got.items():
        want = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in ROWS if r[0] == conv))
        assert [(t.role, t.text) for t in row.turns] == [w[2:] for w in want]
        assert row.loss == "".join(w[3] for w in want if w[2] == "assistant")
        assert sum(m.n_chars for m in row.mask) == len(row.formatted)


def test_adjacent_turns_of_a_role_are_one_block(spark):
    text = back(spark, ROWS)[1].formatted
    assert text.count("<|start|>") == 3 and text.count("<|next|>") == 1


def test_no_control_string_of_a_text_survives(spark):
    text = back(spark, ROWS)[5].formatted
    assert "</s>" not in text and "[INST]" not in text and "[/INST]" not in text
    assert text.count("<|text|>") == 1


def test_empty_table(spark):
    assert back(spark, []) == {}


def test_query_digests(spark):
    from rollcall.llm import QUERIES

    rows = {r.conv_id: r for r in QUERIES["op10_chat_format"](spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(said)
    assert rows[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
