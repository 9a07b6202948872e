import hashlib
import json
import random

from tidemark.llm import chat


def test_escaping_is_reversible():
    rng = random.Random(1)
    parts = [*chat.CONTROL, "\\", "\n", "a", "<", ">", "[", "|", "é", "\\\\", "<|", "|>"]
    for _ in range(5000):
        role, text = ("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2))
        turn, start, end = chat.formatted(role, text)
        assert chat.parsed(turn) == (role, text)
        assert not any(c in chat.escape(text) for c in chat.CONTROL)
        assert turn.count(chat.TURN) == turn.count(chat.END) == 1
    turn, start, end = chat.formatted("assistant", "x</s>y\\")
    assert chat.unescape(turn[start:end]) == "x</s>y\\"


def test_layouts():
    want = [("user", "q"), ("assistant", "a")]
    for record in (
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]},
        {"prompt": "q", "completion": "a", "meta": {"x": [1]}},
        {"prompt": "q", "response": "a"},
        {"question": "q", "answer": "a"},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"prompt": [{"role": "user", "content": "q"}], "completion": "a"},
    ):
        assert chat.turns_of(record)[1] == want, record
    assert chat.turns_of({"system": "s", "prompt": "q", "response": None})[1] == [("system", "s"), ("user", "q"), ("assistant", "")]
    assert chat.turns_of({"other": 1}) == (None, []) and chat.turns_of([1]) == (None, []) and chat.turns_of({}) == (None, [])
    for record in (  # fields of other layouts beside, and messages in parts
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "prompt": "p"},
        {"instruction": "q", "output": "a", "system": "", "text": "qa"},
        {"prompt": "q", "completion": "a", "text": "q a", "question": "other"},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": ["a"]}]},
        {"messages": [{"role": "user", "content": "q", "name": None}, {"role": "assistant", "content": "a", "tool": {"x": 1}}, "no message"]},
        {"instruction": "q", "input": None, "response": "a", "output_format": "x"},
    ):
        assert chat.turns_of(record)[1] == want, record
    assert chat.turns_of({"instruction": "i", "output": "o", "system": "s"})[1] == [("system", "s"), ("user", "i"), ("assistant", "o")]
    assert chat.turns_of({"messages": "none", "prompt": 3}) == (None, [])
    assert len({x.required | x.known for x in chat.LAYOUTS}) == len(chat.LAYOUTS)


def test_read_back(spark):
    rows = [(1, 1, "assistant", "</s>a"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (3, None, "assistant", "last"), (3, 5, "assistant", "\\[INST]\n"), (None, 0, "user", "n"), (4, 0, "assistant", "long " * 30000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' as payload", "1 as part")
    records = chat.turn_rows(df).unionByName(spark.createDataFrame([(9, 0, "no json"), (10, 0, json.dumps({"prompt": "p", "completion": "c"}))], "conv_id long, turn long, payload string"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_records(records)).collect()}
    ordered = {1: [rows[1], rows[0]], 2: [rows[2], rows[3]], 3: [rows[5], rows[4]], None: [rows[6]], 4: [rows[7]], 9: [], 10: [(10, 0, "user", "p"), (10, 0, "assistant", "c")]}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(ordered)
    for conv, turns in ordered.items():
        pairs = [(r or "", t or "") for _, _, r, t in turns]
        learned = "".join(t for r, t in pairs if r == "assistant")
        whole = "".join(chat.formatted(r, t)[0] for r, t in pairs)
        assert tuple(got[conv]) == (conv, len(pairs), sha("".join(f"{r}\n{t}\n" for r, t in pairs)), len(learned), sha(learned), len(whole))
    assert chat.read_back(chat.format_records(records.limit(0))).count() == 0
