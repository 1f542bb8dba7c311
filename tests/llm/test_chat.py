import hashlib
import re

import pytest

from octolith.llm import chat

SF = "/root/testdata/sf0.01"


def unescape(s):
    return re.sub(r"(?s)\\(.)", r"\1", s)


def parse(formatted):
    """An independent reader of the template."""
    out = []
    for m in re.finditer(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", formatted, re.S):
        out.append((unescape(m[1]), unescape(m[2])))
    return out


TRICKS = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>\n", "\\", "\\<|", "<", "|", "[/INST", "<\\|end|>\n", "", "é😀\n\n<|", None]


def test_tricks_survive(spark):
    rows = [(1, i, None if i == 3 else "assistant" if i % 2 else "a<|text|>b", t, 0) for i, t in enumerate(TRICKS)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part int")
    r = chat.read_back(chat.format_turns(df)).first()
    want = [(role or "", t or "") for _, _, role, t, _ in rows]
    assert parse(r.formatted) == want == [(t.role, t.text) for t in r.turns]
    assert "".join(unescape(r.formatted[s.start : s.end]) for s in r.loss_spans) == "".join(t for role, t in want if role == "assistant")


def test_events_fold(spark):
    log = [
        (1, 0, 1, "delta", "user", "He"), (1, 0, 2, "delta", "user", "llo"), (1, 1, 3, "delta", "assistant", "bad"), (1, 1, 4, "regenerate", "assistant", None),
        (1, 1, 5, "delta", "assistant", "go"), (1, 1, 6, "delta", "assistant", "od"), (1, 0, 7, "edit", "user", "Hi"), (2, None, 1, "message", "user", None),
        (None, 0, 1, "message", "assistant", "x"), (1, 300, 9, "message", "assistant", "late"),
    ]
    df = spark.createDataFrame(log, "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string").repartition(3)
    out = sorted(chat.format_events(df).collect(), key=lambda r: (str(r.conv_id), r.part))
    assert [(r.conv_id, r.part.block, parse(r.formatted)) for r in out] == [
        (1, 0, [("user", "Hi"), ("assistant", "good")]), (1, 1, [("assistant", "late")]), (2, -1, [("user", "")]), (None, 0, [("assistant", "x")]),
    ]
    assert chat.format_events(df.limit(0)).count() == 0


LOG = "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string"


def test_roles_outlive_events_without_one(spark):
    log = [
        (1, 0, 1, "message", "assistant", "Hel"), (1, 0, 2, "delta", None, "lo"), (1, 1, 1, "delta", "user", "x"), (1, 1, 2, "regenerate", None, None), (1, 1, 3, "delta", None, "y"),
        (1, 2, 1, "message", "user", "a"), (1, 2, 2, "edit", "assistant", "b"), (1, 2, 3, "delta", None, "c"), (1, 3, 1, "delta", None, None),
    ]
    r = chat.format_events(spark.createDataFrame(log, LOG).repartition(4)).first()
    assert parse(r.formatted) == [("assistant", "Hello"), ("user", "y"), ("assistant", "bc"), ("", "")]
    assert [r.formatted[s.start : s.end] for s in r.loss_spans] == ["Hello", "bc"]


@pytest.mark.parametrize("kind", ["insert", None])
def test_unknown_kinds_are_errors(spark, kind):
    df = spark.createDataFrame([(1, 0, 1, "message", "user", "a"), (1, 0, 2, kind, "user", "b")], LOG)
    with pytest.raises(Exception, match="unknown kind"):
        chat.format_events(df).collect()


def test_logs_hold_every_kind(spark):
    texts = ["", "a", "x" * 600, "é😀" * 300, None]
    rows = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts * 4)], "conv_id bigint, turn bigint, role string, text string")
    log = chat.events_from_turns(rows)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == set(chat.EVENT_KINDS) and log.where("role IS NULL").count() > 20
    parts = chat.format_turns(rows).collect()
    assert [t for r in parts for _, t in parse(r.formatted)] == [t or "" for t in texts * 4]


def test_turns_without_numbers_are_dealt_out(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("7L AS conv_id", "CAST(NULL AS BIGINT) AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    parts = chat.format_turns(rows).select("part", "n_turns", "formatted").collect()
    assert sum(r.n_turns for r in parts) == n and max(r.n_turns for r in parts) < 4 * chat.PART_TURNS and len({r.part for r in parts}) == len(parts)
    assert {t for r in parts for _, t in parse(r.formatted)} == {f"t{i}" for i in range(n)}


def test_crowded_turn_among_others(spark):
    rows = [(1, 5, "user", f"m{i}") for i in range(2000)] + [(1, t, "assistant", f"t{t}") for t in (0, 4, 6, 9, 400)] + [(None, 5, "user", "other")]
    parts = sorted((r for r in chat.format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect() if r.conv_id), key=lambda r: (r.part.block, r.part.turn if r.part.turn is not None else -9, r.part.bucket))
    said = [t for r in parts for _, t in parse(r.formatted)]
    assert [t for t in said if t[0] == "t"] == ["t0", "t4", "t6", "t9", "t400"] and said[:2] == ["t0", "t4"] and said[-3:] == ["t6", "t9", "t400"] and len(said) == 2005


def test_long_conversation_and_repeated_turns(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"t{i} <|") for i in range(2000)] + [(5, 7, "user", "again"), (5, 7, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    parts = sorted(chat.format_turns(df).collect(), key=lambda r: r.part)
    assert len(parts) == 8 and max(r.n_turns for r in parts) <= 258
    said = [t for r in parts for t in parse(r.formatted)]
    assert said == [(r[2], r[3]) for r in sorted(rows, key=lambda r: (r[1], r[2], r[3]))]


def test_query(spark):
    got = {r.conv_id: r for r in chat.op1_chat_format(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    convs = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    convs[-7] = [(x, TRICKS[0]) for x in ("user", "assistant")]
    assert got.keys() == convs.keys()
    for k, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
