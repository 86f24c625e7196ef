from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from vouch.llm import chat_parts as C

NASTY = st.text(alphabet=st.sampled_from(list("\\#<>/: \nturnUserAé\U0001f600")), max_size=40) | st.sampled_from(
    [r"\### Assistant: </turn> ok", "#### user: ", "</turn>\n### user: x</turn>\n", "<image:0>", "\\", "\\\\<", "### : "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(NASTY, NASTY), max_size=5))
def test_round_trip(turns):
    formatted = "".join(C.format_turn(role, [{"kind": "text", "text": text}])[0] for role, text in turns)
    assert C.read_turns(formatted) == [(role, text, []) for role, text in turns]


def test_parts_become_placeholders_with_references():
    parts = [{"kind": "text", "text": "see <image:0> #"}, {"kind": "image", "uri": "a.png", "width": 57, "height": 28},
             {"kind": "audio", "uri": "b.wav", "seconds": 1.5}, {"text": "end"}, {"kind": "document", "uri": "c.pdf", "pages": 3}]
    segment, loss, refs = C.format_turn("assistant", parts)
    assert [(r["kind"], r["uri"], r["tokens"]) for r in refs] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 1536)]
    assert all(segment[r["start"]:].startswith(f"<{r['kind']}:{r['index']}>") for r in refs)
    assert C.read_turns(segment) == [("assistant", "see <image:0> #end", [("image", 0), ("audio", 1), ("document", 2)])]
    assert segment[loss[0]["start"]:loss[0]["end"]].endswith("<document:2>")


def test_digests_of_edge_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (2, None, None, "x"), (None, 0, "assistant", "a"), (3, 0, "assistant", "é" * 100_000),
            (3, 0, "assistant", "é" * 100_000)]
    out = {r["conv_id"]: r for r in C.read_back(C.format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    assert out[1]["turns_sha256"] == sha256(b"user\nhi\nassistant\n\n").hexdigest() and out[1]["loss_chars"] == 0
    assert out[2]["turns_sha256"] == sha256(b"\nx\n").hexdigest()
    assert out[None]["loss_sha256"] == sha256(b"a").hexdigest()
    assert out[3]["n_turns"] == 2 and out[3]["loss_chars"] == 200_000
    assert C.read_back(C.format_turns(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


def test_parts_column(spark):
    df = spark.createDataFrame([(1, 0, "user", [("image", None, "a.png", 28, 28, None, None), ("text", "what?", None, None, None, None, None)]), (1, 1, "assistant", None)],
                               "conv_id bigint, turn bigint, role string, parts array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>")
    turns = C.format_turns(df).orderBy("turn").collect()
    assert turns[0]["attachments"][0]["uri"] == "a.png" and turns[0]["attachments"][0]["tokens"] == 1
    assert C.read_back(C.format_turns(df)).first()["attachment_tokens"] == 1


def test_a_parts_column_of_another_type_is_not_read(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hello", "text of my own")], "conv_id bigint, turn bigint, role string, text string, parts string")
    plain = C.format_turns(rows.drop("parts")).collect()
    assert C.format_turns(rows).collect() == plain and "hello" in plain[0]["segment"]


def test_a_conversation_over_many_partitions_is_read_in_order(spark, monkeypatch):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t} é") for t in range(3000)] + [(2, 0, "user", "x")] * 500
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    out = {r["conv_id"]: r for r in C.read_back(C.format_turns(df)).collect()}
    said = "".join(f"{r}\n{x}\n" for c, _t, r, x in rows if c == 1)
    assert out[1]["n_turns"] == 3000 and out[1]["turns_sha256"] == sha256(said.encode()).hexdigest()
    assert out[1]["loss_sha256"] == sha256("".join(x for c, _t, r, x in rows if c == 1 and r == "assistant").encode()).hexdigest()
    assert out[2]["n_turns"] == 500 and out[2]["loss_chars"] == 0
