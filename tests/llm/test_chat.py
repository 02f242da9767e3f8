import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from duskwatch.llm import chat, queries
from duskwatch.llm.common import table

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_escape_is_reversible():
    dice = random.Random(1)
    for _ in range(3000):
        text = "".join(dice.choice(["<", "|", "\\", "<|", "im_end|>", "<|im_start|>", "a", "\n"]) for _ in range(dice.randint(0, 12)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        assert "\n" not in chat.escape_role(text) and chat.unescape_role(chat.escape_role(text)) == text


def test_spans_cover_every_turn_once():
    dice = random.Random(2)
    for _ in range(500):
        tokens = np.array([dice.randint(1, 60) for _ in range(dice.randint(0, 30))], dtype=np.int64)
        earlier, system, budget, history = dice.randint(0, 3), dice.randint(0, 20), dice.randint(1, 120), dice.randint(0, 50)
        at = earlier
        for back, first, past in chat.spans(tokens, earlier, system, budget, history):
            assert first == at and past > first and back <= first
            assert tokens[back:first].sum() <= history
            assert system + tokens[back:past].sum() <= budget or (past == first + 1 and back == first)
            at = past
        assert at == max(len(tokens), earlier)


def test_edges(spark):
    rows = [(1, 0, "system", "be <|im_end|> brief"), *((1, k, ("user", "assistant")[k % 2 == 0], f"turn {k} " + "word " * (k % 9)) for k in range(1, 60))]
    rows += [(None, None, None, None), (None, 1, "assistant", "null id"), (2, None, "assistant", None), (2, None, "assistant", None), (3, 5, "user", "late"), (3, 1, "assistant", "tie b"), (3, 1, "assistant", "tie a"), (4, 0, "od\nd <|im_start|>\\role", "x\n\n"), (5, 0, "assistant", "long " * 5000), (5, 1, "assistant", "end"), (6, 0, "system", "alone"), (7, 0, "system", "a"), (7, 1, "system", "b")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, block int, window string").repartition(3)
    for options in ({}, {"budget": 40, "history": 15, "blocks": 2}, {"budget": 1, "history": 0, "blocks": 1}):
        formatted = chat.windows(frame, BYTES, **options).cache()
        got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(formatted).collect()}
        assert got == plain(rows)
        budget = options.get("budget", 2048)
        for r in formatted.collect():
            new = r["text"][r["fresh"] :].count(chat.START)
            assert r["n_tokens"] <= budget or new == 1 or r["window"] == 0
            if r["conv_id"] == 1 and (r["block"], r["window"]) != (0, 0):
                assert r["text"].startswith("<|im_start|>system\nbe <\\|im_end|> brief<|im_end|>\n")
    assert chat.digests(chat.windows(frame.limit(0), BYTES)).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_op10_query(spark, folder):
    rows = [tuple(r) for r in chat.with_probe(table(spark, folder, "conversations"), spark).collect()]
    got = queries.op10_chat(spark, folder).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == plain(rows) and all(r["formatted_chars"] > 0 for r in got)
