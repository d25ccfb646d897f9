import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from reelframe.llm import chat
from reelframe.llm.queries import ORACLE_SQL, op8_chat

TURNS = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "be ### kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo\\"), (1, 3, "user", "</turn>\n### assistant: x"), (1, 4, "assistant", "####\\#\\\\"), (1, 5, "user", None),
    (2, 0, "user", "only"), (3, 5, "assistant", ""), (3, 1, "assistant", "first 😀"), (4, None, None, "a"), (4, 0, "assistant", "b"), (4, 0, "assistant", "b"), (4, 0, "Assistant: ", "c"),
    (None, 0, "assistant", "null id"), (5, 0, "we:ird\n</turn>", "\\"),
]


def test_examples(spark):
    df = spark.createDataFrame(ROWS, TURNS).selectExpr("*", "'x' AS id", "'y' AS turns", "1 AS example")
    rows = chat.format_chats(df)
    got = {(r.conv_id, r.example): r for r in rows.collect()}
    assert sorted((str(c), e) for c, e in got) == [("1", 0), ("1", 1), ("1", 2), ("2", 0), ("3", 0), ("3", 1), ("4", 0), ("4", 1), ("5", 0), ("None", 0)]
    first = got[1, 0]
    assert first.text == "### system: be #\\#\\# kind</turn>\n### user: hi</turn>\n### assistant: yo\\\\</turn>\n"
    assert first.text[first.loss_start : first.loss_end] == "yo\\\\" and first.n_examples == 3
    assert got[1, 2].loss_start is None and got[1, 2].text.endswith("### user: </turn>\n")
    assert got[3, 0].text == "### assistant: first 😀</turn>\n"
    read = rows.select("conv_id", "example", chat.read_turns(rows["text"]).alias("t"), chat.read_loss(rows["text"], rows["loss_start"], rows["loss_end"]).alias("loss"))
    back = {(r.conv_id, r.example): r for r in read.collect()}
    assert [tuple(t) for t in back[1, 2].t] == [(r[2], r[3] or "") for r in ROWS[:6]]
    assert [back[1, i].loss for i in range(3)] == ["yo\\", "####\\#\\\\", ""]
    assert [tuple(t) for t in back[4, 1].t][:2] == [("", "a"), ("Assistant: ", "c")] and [tuple(t) for t in back[5, 0].t] == [("we:ird\n</turn>", "\\")]


@given(st.lists(st.text(st.sampled_from("#\\</turn>\n: ae?$1"), max_size=12), min_size=12, max_size=12))
@settings(max_examples=15, deadline=None)
def test_escaping_is_reversible(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    df = df.select("i", chat.escape(df["t"]).alias("e"))
    for r in df.select("i", "e", chat.unescape(df["e"]).alias("u")).collect():
        assert r.u == texts[r.i] and "</turn>" not in r.e and "##" not in r.e


def test_query_reads_everything_back(spark, tmp_path):
    spark.createDataFrame(ROWS, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op8_chat(spark, str(tmp_path)).collect()}
    both = "\\### Assistant: </turn> ok"
    chats = {c: sorted((r[1:] for r in ROWS if r[0] == c), key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or "")) for c in {r[0] for r in ROWS}}
    chats[-7] = [(0, "user", both), (1, "assistant", both)]
    assert set(got) == set(chats)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in chats.items():
        loss = "".join(t[2] or "" for t in turns if t[1] == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), sha(loss))
        assert got[c].turns_sha256 == sha("".join(f"{t[1] or ''}\n{t[2] or ''}\n" for t in turns))


def escaped(text):
    return re.sub("(?<=#)#", r"\\#", text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>"))


def test_formatted_chars_against_brute_force_and_sql(spark, tmp_path):
    import duckdb

    rows = [*ROWS, *((9, i, "assistant" if i % 3 == 2 else "user", "####" * (i % 4) + "\\" * (i % 3) + "x" * (i % 50)) for i in range(600))]
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op8_chat(spark, str(tmp_path)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == c), key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        shown = [f"### {escaped(t[1] or '').replace(':', chr(92) + ':')}: {escaped(t[2] or '')}</turn>\n" for t in turns]
        ends = [i for i, t in enumerate(turns) if t[1] == "assistant" or i == len(turns) - 1]
        assert got[c].formatted_chars == sum(len("".join(shown[: i + 1])) for i in ends)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    rel = con.sql(ORACLE_SQL["op8_chat"])
    names = sorted(rel.columns)
    assert names == sorted(next(iter(got.values())).asDict())
    want = sorted(str([dict(zip(rel.columns, r, strict=True))[n] for n in names]) for r in rel.fetchall())
    assert want == sorted(str([r[n] for n in names]) for r in got.values())


def test_empty_table_and_no_python(spark):
    rows = chat.format_chats(spark.createDataFrame(ROWS, TURNS).where("false"))
    assert rows.count() == 0 and "Python" not in rows._jdf.queryExecution().toString()
