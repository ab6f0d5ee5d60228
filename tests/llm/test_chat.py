import pytest
from pyspark.sql import functions as F

from depgrove.llm import chat

TURNS = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def part(kind, value=None, ref=None, tokens=None):
    return (kind, value, ref, tokens)


def test_typed_parts_become_placeholders_in_order(spark):
    rows = [
        (1, 0, "user", [part("text", "see <image 1> & "), part("image", ref="a.png"), part("audio", ref="b.wav", tokens=7), part("text", " and "), part("document", ref="c.pdf")]),
        (1, 1, "assistant", [part(None, "a </turn> b")]),
        (2, 0, "user", None),
    ]
    out = {r["conv_id"]: r for r in chat.format_turns(spark.createDataFrame(rows, TURNS), parts="parts").collect()}
    assert out[1]["formatted"] == '<turn role="user">see &lt;image 1> &amp; <image 1><audio 2> and <document 3></turn>\n<turn role="assistant"><loss>a &lt;/turn> b</loss></turn>\n'
    assert [tuple(a) for a in out[1]["attachments"]] == [(0, 1, "image", "a.png", 256), (0, 2, "audio", "b.wav", 7), (0, 3, "document", "c.pdf", 512)]
    assert out[1]["expanded_tokens"] == 256 + 7 + 512
    assert out[2]["formatted"] == '<turn role="user"></turn>\n' and out[2]["attachments"] == [] and out[2]["expanded_tokens"] == 0


def test_texts_come_back_as_they_were(spark):
    texts = ["", "&lt;", "&amp;lt;", "<turn role=\"user\">x</turn>\n", "<loss>", "</loss></turn>\n", "\\### Assistant: </turn> ok", "日本 🙂\n\n", "x" * 100_000]
    rows = [(1, i, ("assistant", 'us"er<', "&quot;")[i % 3], t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    turns = chat.format_turns(docs).select(chat.read_turns(F.col("formatted")).alias("turns")).first()["turns"]
    assert [(t["role"], t["text"], t["loss"]) for t in turns] == [(r[2], r[3], r[2] == "assistant") for r in rows]


def test_nulls_ties_repeated_rows_and_an_empty_table(spark):
    rows = [(None, None, None, None), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"), (3, None, "user", "first")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r["formatted"] for r in chat.format_turns(docs).collect()}
    assert out[None] == '<turn role=""></turn>\n'
    assert out[3] == "".join(f'<turn role="user">{t}</turn>\n' for t in ("first", "a", "a", "b"))
    assert chat.format_turns(docs.limit(0)).collect() == []


def test_an_unknown_kind_is_refused(spark):
    turns = spark.createDataFrame([(1, 0, "user", [part("video", ref="x")])], TURNS)
    with pytest.raises(Exception, match="unknown kind of part: video"):
        chat.format_turns(turns, parts="parts").collect()


def test_typed_parts_come_back(spark):
    given = [part("text", "see <image 1> & <"), part("image", ref="a.png"), part("audio", ref="b.wav", tokens=7), part("text", "&lt;document 3>"), part("document", ref="c.pdf", tokens=9), part("image")]
    rows = [(1, 0, "assistant", given), (2, 0, "user", None), (3, 0, "user", [part("text", "<image 1>")])]
    out = chat.format_turns(spark.createDataFrame(rows, TURNS), parts="parts")
    back = out.select("conv_id", chat.read_parts(chat.read_turns(F.col("formatted"))[0]["body"], F.col("attachments")).alias("parts")).collect()
    got = {r["conv_id"]: [tuple(p) for p in r["parts"]] for r in back}
    assert got[1] == [(k, v, r, t if k == "text" else t or chat.TOKENS[k]) for k, v, r, t in given]
    assert got[2] == [] and got[3] == [part("text", "<image 1>")]


def test_a_column_named_parts_is_no_content(spark):
    turns = spark.createDataFrame([(1, 0, "user", "said", "other")], "conv_id long, turn long, role string, text string, parts string")
    assert chat.format_turns(turns).first()["formatted"] == '<turn role="user">said</turn>\n'
