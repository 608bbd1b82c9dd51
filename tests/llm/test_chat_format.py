import hashlib
import json
import random

from small_tables import sf  # noqa: F401
from stockflow.llm import chat_format as cf
from stockflow.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escape_round_trip():
    rng = random.Random(7)
    bits = [*cf.CONTROL, "\\", "\\\\", "<", "|", "[", "]", ">", "/", "a", "\n", "é", "<|", "end|>", "<\\|end|>", "SYS>>"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(10)))
        escaped = cf.escape(text)
        assert cf.unescape(escaped) == text
        assert not any(c in escaped for c in cf.CONTROL)
        turns = [("user", text), (text, "x"), ("assistant", text), ("assistant", "")]
        formatted, spans = cf.format_turns(turns)
        assert cf.read_turns(formatted) == turns
        assert cf.read_loss(formatted, spans) == text


def test_layouts_reach_the_same_turns(spark):
    records = [
        {"prompt": "p", "completion": "c"},
        {"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "c"}]},
        {"conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "c"}], "id": "x"},
        {"question": "p", "answer": "c", "id": 3},
        {"instruction": "p", "output": "c"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    rows += [(10, '{"instruction": "a", "input": "b", "output": null}'), (11, '{"system": "s", "prompt": "p", "response": "r"}')]
    rows += [(12, '{"messages": []}'), (13, None), (14, "no json"), (15, '{"other": 1}'), (16, "[1]"), (17, "{}"), (15, '{"other": 1}')]
    docs = spark.createDataFrame(rows, "k int, record string").selectExpr("*", "'z' as formatted", "1 as layout")
    got = cf.format_records(docs).collect()
    turns = [(r.k, [tuple(t) for t in r.turns] if r.turns is not None else None) for r in got]
    assert turns[:5] == [(i, [("user", "p"), ("assistant", "c")]) for i in range(5)]
    assert len({r.formatted for r in got[:5]}) == 1
    assert turns[5:8] == [
        (10, [("user", "a\nb"), ("assistant", "")]),
        (11, [("system", "s"), ("user", "p"), ("assistant", "r")]),
        (12, []),
    ]
    assert [t for _, t in turns[8:]] == [None] * 6
    assert cf.format_records(docs.limit(0)).count() == 0


def test_fingerprints_name_layouts_once():
    paths = [p for layout in cf.LAYOUTS for p in layout.paths()]
    assert len(cf.mapping_table()) == len(paths)


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = "</s>[INST] ok [/INST]"
    by[-7] = [(True, 0, "user", said), (True, 1, "assistant", said)]
    out = []
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op5_chat_format"](spark, sf)) == brute(rows)


def test_rows_without_an_id_are_conversations_of_their_own(spark):
    rows = [(None, i % 2, "assistant" if i % 2 else "user", f"t{i // 4}") for i in range(12)] + [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = rows_of(cf.read_back(cf.format_records(cf.message_records(table), keep=["conv_id"]), ["conv_id"]))
    want = [r for row in rows[:12] for r in brute([row]) if r[0] is None] + [r for r in brute(rows[12:]) if r[0] == 1]
    assert got == sorted(want, key=repr)


def test_rows_by_turn_edge_cases(spark):
    rows = [(1, 1, "assistant", "b \x00"), (1, 0, "user", None), (2, None, None, "x"), (2, 0, "assistant", "y"), (None, 0, "user", "z")]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "assistant", "long " * 100_000), (5, 0, "assistant", "\\<|end|>")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as m", "2 as record")
    formatted = cf.format_records(cf.message_records(table), keep=["conv_id"])
    got = rows_of(cf.read_back(formatted, ["conv_id"]))
    assert got == [r for r in brute(rows) if r[0] != -7]
    assert cf.message_records(table.limit(0)).count() == 0
