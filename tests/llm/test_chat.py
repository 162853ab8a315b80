"""Chat formatting: exact round trips, the machine's verdicts, loss masks against a plain walk over the input."""

from __future__ import annotations

import hashlib
from itertools import groupby

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, part int, valid string"
HARD = ["", " ", "\\", "\\\\### x", "</turn>\n", "### user: hi</turn>\n", ":", "a: b", "###", "####", "\\</turn", "é\u2028\r\n\x00", "x" * 5000]


def table(spark, rows, parts=3):
    return spark.createDataFrame([(c, t, r, x, 9, "v") for c, t, r, x in rows], SCHEMA).repartition(parts)


def expected(rows):
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for conv, turns in groupby(sorted(rows, key=lambda r: (*key(r), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")), key):
        turns = [(r[2] or "", r[3] or "") for r in turns]
        learnt = "".join(x for r, x in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        out[conv[1] if conv[0] else None] = (len(turns), digest, len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def got(spark, rows):
    found = chat.digests(chat.formatted(table(spark, rows))).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: r for r in found}


def test_round_trip_of_awkward_rows(spark):
    rows = [(c, t, r, HARD[(c + t) % len(HARD)]) for c in range(20) for t, r in enumerate(["system", "user", "assistant", "user: x", "###", ""][: 1 + c % 6])]
    rows += [(50, 0, "user", None), (50, 1, None, "x"), (51, None, "user", "b"), (51, 0, "assistant", "c"), (52, 3, "assistant", "b"), (52, 3, "assistant", "a"), (52, 3, "assistant", "a")]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a")]
    found = got(spark, rows)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in found.items()} == expected(rows)
    assert found[None].valid and not found[50].valid


def test_machine(spark):
    orders = {
        1: ("user assistant", None),
        2: ("system user assistant user assistant", None),
        3: ("assistant user", 0),
        4: ("user user assistant", 1),
        5: ("user assistant user", 3),
        6: ("user system", 1),
        7: ("tool", 0),
        8: ("user assistant assistant user assistant", 2),
    }
    found = got(spark, [(c, t, r, "x") for c, (order, _) in orders.items() for t, r in enumerate(order.split())])
    assert {c: r.fault for c, r in found.items()} == {c: fault for c, (_, fault) in orders.items()}
    assert all(r.valid == (r.fault is None) for r in found.values())


def test_long_conversations_are_divided_between_turns(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], chr(97 + t % 26) * (chat.PART_CHARS // 3)) for t in range(12)] + [(2, 0, "user", "y" * (2 * chat.PART_CHARS)), (2, 1, "assistant", "z")]
    parts = chat.formatted(table(spark, rows))
    sizes = parts.selectExpr("conv_id", "part", "aggregate(segments, 0, (n, s) -> n + length(s.text)) n").collect()
    assert {r.conv_id: 0 for r in sizes} and max(r.part for r in sizes if r.conv_id == 1) >= 5
    assert all(r.n <= chat.PART_CHARS for r in sizes if r.conv_id == 1)
    found = {r.conv_id: r for r in chat.digests(parts).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in found.items()} == expected(rows) and all(r.valid for r in found.values())


def test_empty_table(spark):
    assert got(spark, []) == {}


@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet="\\#<>/turn :\n", max_size=30)), max_size=5))
def test_any_text_comes_back(turns):
    whole = "".join(s for r, x in turns for s, _ in chat.PLAIN.segments(r, x))
    assert list(chat.read_turns(whole)) == turns


def test_templates_that_texts_could_imitate_are_refused():
    with pytest.raises(ValueError):
        chat.Template(closing="\n\n")
    with pytest.raises(ValueError):
        chat.Template(escape="#")


def test_other_template():
    ml = chat.Template(opening="<|im_start|>", naming="<|nl|>", closing="<|im_end|>", escape="~", marks=("<|",), trained=frozenset({"bot"}))
    turns = [("bot", "a<|im_end|>~"), ("me", "<|nl|>")]
    pieces = [s for r, x in turns for s in ml.segments(r, x)]
    assert list(chat.read_turns("".join(s for s, _ in pieces), ml)) == turns and [ml.unescaped(s) for s, loss in pieces if loss] == ["a<|im_end|>~"]
