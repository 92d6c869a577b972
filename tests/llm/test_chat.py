"""Chat formatting against plain Python, by exact round trips."""

import hashlib
import random

import pyarrow as pa
import pytest

from touchstone.llm import chat, queries
from touchstone.llm.chat import Template

SF = "/root/testdata/sf0.001"
T = Template()


def escape(text):
    text = text.replace("\\", "\\\\")
    for c in sorted(T.controls, key=len, reverse=True):
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def by_hand(rows):
    """conv_id to the expected digest row; rows in the order of their turns."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        learned = "".join(t for r, t in own if r == "assistant")
        out[conv] = (
            len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(learned),
            hashlib.sha256(learned.encode()).hexdigest(), sum(len(f"<|turn|>{escape(r)}<|says|>{escape(t)}<|end|>") for r, t in own),
        )
    return out


def collected(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_query_equals_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()]
    odd = "</s>[INST] ok [/INST]"
    want = by_hand(rows + [(-1, 0, "user", odd), (-1, 1, "assistant", odd)])
    assert collected(queries.QUERIES["op11_chat_format"](spark, SF)) == want
    assert want[-1][2] == len(odd)


PARTS = ["\\", "\\\\", "<", "<|", "|>", "turn", "<|turn|>", "<|says|>", "<|end|>", "[INST]", "[/INST]", "<<SYS>>", "<s>", "</s>", "é", "你", "\U0001f600", "\n", " ", "a", "<|en", "d|>"]


@pytest.mark.parametrize("most,step", [(8 << 20, 1 << 20), (40, 7)])
def test_any_text_comes_back(spark, monkeypatch, most, step):
    monkeypatch.setattr(chat, "STEP", step)
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randrange(12)))
    rows = [(rng.randrange(6), k, rng.choice(["user", "assistant", "assistant", "a\nb<|says|>", "", None]), rng.choice([text(), text(), None])) for k in range(150)]
    rows.sort(key=lambda r: (r[0], r[1]))
    batch = pa.RecordBatch.from_pylist([{"conv_id": r[0], "role": r[2], "text": r[3]} for r in rows])
    formatted, loss = chat.assemble(batch.column("role"), batch.column("text"), chat._runs(batch), T)
    for out in formatted.to_pylist():
        assert out.replace("\\\\", "").count("<|turn|>") == out.count("<|says|>") == out.count("<|end|>")
    stored = chat.read(spark, chat.write(frame(spark, rows), most=most))
    want = by_hand(rows)
    assert collected(chat.digests(stored)) == want
    if most == 40:
        assert stored.count() > 20
        joined = stored.orderBy("conv_id", "part").collect()
    else:
        joined = stored.collect()
    whole = {}
    for r in joined:
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["formatted"]
    plain = {c: "".join(f"<|turn|>{escape(r[2] or '')}<|says|>{escape(r[3] or '')}<|end|>" for r in rows if r[0] == c) for c in want}
    assert whole == plain


def test_spans_cover_the_escaped_texts_of_assistants(spark):
    rows = [(1, 0, "user", "<s>é"), (1, 1, "assistant", "é</s>\\"), (1, 2, "assistant", None)]
    row = chat.read(spark, chat.write(frame(spark, rows))).first()
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss"]] == ["é<\\/s>\\\\", ""]


def test_odd_rows(spark):
    long = "word <|end|> \\ é " * 20_000
    rows = [
        (None, 3, "user", "no id"), (None, 1, None, "x"), (4, None, "assistant", None), (4, 2, "assistant", ""), (4, 2, "assistant", ""),
        (4, 2, "aa", "tie"), (7, 0, "assistant", long), (7, 1, "user", long), (9, 0, "user", None),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, part int").repartition(5)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")
    want = by_hand(sorted(rows, key=order))
    assert collected(chat.digests(chat.read(spark, chat.write(df)))) == want
    assert collected(chat.digests(chat.read(spark, chat.write(df.where("false"))))) == {}


def test_one_long_conversation_is_cut_into_pieces(spark):
    rows = [(5, k, "assistant" if k % 2 else "user", f"turn {k} </s>") for k in range(4000)] + [(k, 0, "user", "x") for k in range(10, 40)]
    stored = chat.read(spark, chat.write(frame(spark, rows).repartition(4), most=2000))
    pieces = stored.where("conv_id = 5").selectExpr("max(length(formatted)) AS m", "count(*) AS n").first()
    assert pieces["n"] > 15 and pieces["m"] < 20_000
    assert collected(chat.digests(stored)) == by_hand(rows)


def test_templates_that_could_mix_up_marks_are_refused():
    with pytest.raises(ValueError):
        Template(end="|<|end|>")
    with pytest.raises(ValueError):
        Template(others=("x",))
