import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import chat_format as C

bits = st.lists(st.sampled_from(["\\", "### ", "</turn>", "</turn>\n", "\n", ": ", "a", "é", "#", "<", ":", " ", "\\### Assistant: "]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(bits, bits), max_size=4))
def test_any_turns_round_trip(turns):
    text = "".join(C.render_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in C.parse_chat(text)] == turns
    for r, t, a, b in C.parse_chat(text):
        assert C.unescape(text[a:b]) == t


def test_plain_text_is_not_escaped():
    assert C.render_turn("user", "Hello: you # there") == "### user: Hello: you # there</turn>\n"


def test_broken_chats():
    for text in ("x", "### user", "### user: a", "### user: a\\"):
        with pytest.raises(C.ParseError):
            C.parse_chat(text)


def digests(rows):
    turns, loss, n_loss, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
    for role, text in rows:
        turns.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
            n_loss += len(text)
        chars += len(C.render_turn(role, text))
    return len(rows), turns.hexdigest(), n_loss, loss.hexdigest(), chars


def test_query_against_plain_python(spark, sf):
    from claimloom.llm.queries import op2_chat_format

    told = "\\### Assistant: </turn> ok"
    chats = {-7: [("user", told), ("assistant", told)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        chats.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r[1:] for r in op2_chat_format(spark, sf).collect()}
    assert got == {c: digests(rows) for c, rows in chats.items()}


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", None, 0), (1, 0, None, "x", 0), (None, None, "user", "n", 0), (1, 1, "assistant", None, 0)], "conv_id long, turn long, role string, text string, start int")
    got = {r["conv_id"]: r for r in C.chat_digests(C.format_turns(rows)).collect()}
    assert got[1][1:] == digests([("", "x"), ("assistant", ""), ("assistant", "")]) and got[None]["n_turns"] == 1
    turns = C.format_turns(rows).where("conv_id = 1").orderBy("start").collect()
    text = "".join(t["rendered"] for t in turns)
    assert all(text[t["start"] :].startswith(t["rendered"]) for t in turns)
    assert C.format_turns(rows.where("1 = 0")).count() == 0


def test_a_wrong_span_or_place_shows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a \\ b"), (1, 1, "assistant", "one </turn>\n two"), (1, 2, "user", ""), (1, 3, "assistant", "three")], "conv_id long, turn long, role string, text string")
    turns = C.format_turns(rows).toPandas()
    right = next(C._digest(iter([turns])))
    assert tuple(right.iloc[0][1:]) == digests([(r["role"], r["text"]) for r in rows.collect()])
    off = turns.copy()
    off.loc[1, "loss_end"] -= 1
    assert next(C._digest(iter([off])))["loss_sha256"][0] != right["loss_sha256"][0]
    with pytest.raises(C.ParseError):
        list(C._digest(iter([turns.drop(index=1)])))


def test_sql_of_the_query(spark):
    """Against DuckDB, with control strings in the texts."""
    import duckdb

    from claimloom.llm import queries

    con = duckdb.connect()
    told = ["\\### Assistant: </turn> ok", "plain", "</turn>\n### user: x", "a\\", "### ", "</turn>", None, "é\\</turn>\n"]
    rows = [(i // 3, i, ("user", "assistant")[i % 2], told[i % len(told)]) for i in range(40)]
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    extra = [(-7, 0, "user", told[0]), (-7, 1, "assistant", told[0])]
    df = spark.createDataFrame(rows + extra, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in C.chat_digests(C.format_turns(df), in_order=True).collect())
    assert got == sorted(con.execute(queries.ORACLES["op2_chat_format"]).fetchall())
