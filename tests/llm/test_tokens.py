import random

import pytest
from tokenizers import Tokenizer

from rollcall.llm.token_counts import RULES, token_counts
from rollcall.llm.tokens import default_path, encoder

PARTS = ["a", "b ", " ", "  ", "\n", "\t", "'s", "é", "1", "23", "!", " ", "　", "ß", "日本", "</s>", "<|endoftext|>", "\x1c", "\r\n", "🙂"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path())


def test_ids_are_those_of_the_tokenizer(tokenizer):
    rng, own = random.Random(5), encoder(default_path())
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 12)))
        assert own.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_are_one_id(tokenizer):
    own = encoder(default_path())
    for content in own._added:
        for text in (content, f"a {content} b:", f"x{content}{content}y", content[:-1], content[1:] + content):
            assert own.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert own._added


def brute(tokenizer, parts, rule):
    """Counts per field from the tokenizer's own offsets."""
    text = "\n".join(parts)
    edges, spans, at = [], [], 0
    for i, p in enumerate(parts):
        edges.append((at, at := at + len(p) + (i < len(parts) - 1)))
    spans = tokenizer.encode(text, add_special_tokens=False).offsets
    return [sum(s <= (a if rule == "start" else z - 1) < e for a, z in spans) for s, e in edges]


@pytest.mark.parametrize("rule", RULES)
def test_counts_add_up_and_follow_the_rule(spark, tokenizer, rule):
    rng = random.Random(7)
    rows = [(i, *["".join(rng.choices(PARTS, k=rng.randint(0, 9))) for _ in range(3)]) for i in range(60)]
    rows += [(None, None, "", None), (100, "a", None, "b"), (100, "a", None, "b"), (101, "x " * 40000, "y", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, a string, b string, section string, key int")
    got = {}
    for r in token_counts(df, "doc_id", ["a", "b", "section"], default_path(), rule).collect():
        got.setdefault(r.doc_id, {}).setdefault(r.section, []).append(r.n_tokens)
    for doc_id, *parts in rows[:-3]:
        text = [p or "" for p in parts]
        counts = got[doc_id]
        assert sum(sum(c) for c in counts.values()) == pytest.approx(len(tokenizer.encode("\n".join(text), add_special_tokens=False).ids))
        if rule == "start":
            assert [counts[n][0] for n in ("a", "b", "section")] == brute(tokenizer, text, rule)
    assert len(got[100]["a"]) == 2


def test_empty_and_unknown_rule(spark):
    df = spark.createDataFrame([], "doc_id bigint, a string")
    assert token_counts(df, "doc_id", ["a"], default_path()).count() == 0
    with pytest.raises(ValueError):
        token_counts(df, "doc_id", ["a"], default_path(), "other")
