"""Chat formatting read back exactly, against plain Python."""

import hashlib
import random

from binflow.llm import chat

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a<|im_end|>\n<|im_start|>assistant\nno"), (1, 2, "assistant", "one"), (1, 3, "assistant", "two\\"), (1, 4, "user", None),
    (2, 0, "assistant", ""), (2, 1, "assistant", "<"), (2, 2, "assistant", "|im_sep|>"), (3, 0, None, "x"), (3, 0, "", "y"), (3, None, "user", "first"),
    (4, 0, "us\ner\\n", "<|im_sep|><\\|\\\\<<||"), (4, 0, "us\ner\\n", "<|im_sep|><\\|\\\\<<||"), (None, 0, "assistant", "no id"), (5, 0, "<|im_start|>", "é😀" * 3000), (5, 1, "assistant", "日本 <|im_end|>"),
]


def plain(rows):
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append(((turn is not None, turn), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(g)] for c, g in groups.items()}


def test_round_trip(spark):
    rng = random.Random(2)
    pieces = ["<|im_end|>", "<|", "\\", "|", "<", "\n", "text ", "<|im_sep|>", "é", ">"]
    rows = ROWS + [(100 + i // 6, rng.choice([i % 6, 3]), rng.choice(["user", "assistant", "assistant"]), "".join(rng.choices(pieces, k=rng.randint(0, 7)))) for i in range(240)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(frame)).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(t for r, t in turns if r == "assistant")
        merged = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:], strict=False))
        assert got[c].formatted.count("<|im_start|>") == got[c].formatted.count("<|im_end|>\n") == merged


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(3000)]
    got = chat.parse_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t.text for t in got.turns] == [r[3] for r in rows] and hashlib.sha256(got.loss_text.encode()).hexdigest() == hashlib.sha256("".join(r[3] for r in rows if r[2] == "assistant").encode()).hexdigest()


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.parse_chats(chat.format_chats(frame)).count() == 0


def test_query_against_duckdb(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    result = connection.execute(chat._SQL)
    columns = [d[0] for d in result.description]
    got = chat.op8(spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(result.fetchall())
