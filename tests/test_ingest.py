"""Export ingest: root shapes, conversation shapes, content shapes, acceptance, rejection, files (SRC-1..11)."""

import json
import os

from chatlens.sources.exports import flatten_exports, read_exports


def flat(spark, docs, on_error="file"):
    df = spark.createDataFrame([(f"f{i}", d) for i, d in enumerate(docs)], "account string, json string")
    res = flatten_exports(df, on_error=on_error)
    rows = res.messages.orderBy("account", "message_id", "text").collect()
    rejected = sorted(r.file for r in res.rejected.collect())
    return rows, rejected


def msg(mid, role="user", text="hello", t=1706720400):
    return {"id": mid, "author": {"role": role}, "content": {"content_type": "text", "parts": [text]},
            "create_time": t}


def conv_map(cid, *messages):
    return {"id": cid, "title": f"T{cid}", "mapping": {f"n{i}": {"message": m} for i, m in enumerate(messages)}}


def test_root_shapes(spark):
    one = conv_map("a", msg("m1"))
    docs = [json.dumps([one]), json.dumps({"conversations": [one]}), json.dumps(one),
            json.dumps({"conversations": []}), "5", "null", "{broken", "﻿" + json.dumps([one]),
            '{"id": "x", "id": "a", "title": "T", "mapping": {"n": {"message": ' + json.dumps(msg("m9")) + '}}}']
    rows, rejected = flat(spark, docs)
    by_file = {}
    for r in rows:
        by_file.setdefault(r.account, []).append(r)
    assert sorted(by_file) == ["f0", "f1", "f2", "f7", "f8"]
    assert by_file["f8"][0].conversation_id == "a"  # duplicate key: last value wins
    assert rejected == ["f4", "f5", "f6"]
    r = by_file["f0"][0]
    assert (r.conversation_id, r.conversation_title, r.message_id, r.role, r.text, r.department) == \
        ("a", "Ta", "m1", "user", "hello", "f0")
    assert str(r.create_time_local) == "2024-02-01 00:00:00" and r.month == "2024-02"


def test_conversation_shapes(spark):
    m = msg("m1")
    docs = [
        {"id": "c1", "mapping": {}, "messages": [m]},                  # empty mapping hides messages
        {"id": "c2", "mapping": [], "messages": [m]},                  # mapping of the wrong kind -> messages
        {"id": "c3", "messages": [m]},
        {"id": "c4"},                                                  # neither -> no rows
        {"id": "c5", "mapping": {"n": {"message": None}, "k": {"message": m}}},  # null message skipped
        {"conversation_id": "c6", "title": "", "conversation_title": "CT", "messages": [m]},
        {"id": "", "conversation_id": 7, "messages": [m]},             # id falsy -> conversation_id, cast to text
    ]
    rows, rejected = flat(spark, [json.dumps(d) for d in docs])
    assert rejected == []
    got = sorted((r.account, r.conversation_id, r.conversation_title) for r in rows)
    assert got == [("f1", "c2", ""), ("f2", "c3", ""), ("f4", "c5", ""), ("f5", "c6", "CT"), ("f6", "7", "")]
    # message id of a map node falls back to the node key
    docs2 = [json.dumps({"id": "c", "mapping": {"node-9": {"message": {"author": {"role": "user"}, "content": "x"}}}})]
    rows2, _ = flat(spark, docs2)
    assert rows2[0].message_id == "node-9"


def test_rejections(spark):
    docs = [
        json.dumps({"id": "c", "mapping": {"n": 5}}),                                  # node not an object
        json.dumps({"id": "c", "mapping": {"n": {"message": "text"}}}),                # message not an object
        json.dumps({"id": "c", "mapping": {"n": {"message": {"author": "bob", "content": "x"}}}}),  # author string
        json.dumps({"id": "c", "messages": [1]}),                                      # list item not an object
        json.dumps([1, {"id": "c"}]),                                                  # root list with a scalar
        json.dumps({"conversations": [None]}),
        json.dumps([conv_map("ok", msg("m1"))]),
    ]
    rows, rejected = flat(spark, docs)
    assert rejected == ["f0", "f1", "f2", "f3", "f4", "f5"]
    assert [r.account for r in rows] == ["f6"]


def test_on_error_record_keeps_good_conversations(spark):
    doc = json.dumps([{"id": "bad", "messages": [1]}, conv_map("good", msg("m1"))])
    rows, rejected = flat(spark, [doc], on_error="record")
    assert rejected == ["f0"] and [r.conversation_id for r in rows] == ["good"]
    rows, _ = flat(spark, [doc], on_error="file")
    assert rows == []


def test_content_shapes(spark):
    contents = [
        ({"parts": ["a", None, 2, {"k": 1}, True]}, 'a\n2\n{"k":1}\nTrue'),
        ({"parts": [], "text": "ignored"}, ""),
        ({"text": "plain"}, "plain"),
        ({"text": 5}, ""),
        ('{"parts": ["not an object"]}', '{"parts": ["not an object"]}'),
        (None, ""),
    ]
    items = [{"id": f"m{i}", "role": "user", "content": c, "timestamp": 1706720400} for i, (c, _) in enumerate(contents)]
    items.append({"id": "m9", "role": "user", "timestamp": 1706720400})  # content missing
    rows, _ = flat(spark, [json.dumps({"id": "c", "messages": items})])
    got = {r.message_id: r.text for r in rows}
    for i, (_, want) in enumerate(contents):
        assert got[f"m{i}"] == want
    assert got["m9"] == ""


def test_row_acceptance(spark):
    no_role = {"id": "m1", "content": "x", "create_time": 1706720400}
    empty_text = {"id": "m2", "author": {"role": "user"}, "content": "", "create_time": 1706720400}
    mapping = {"id": "c", "mapping": {"a": {"message": no_role}, "b": {"message": empty_text}}}
    listing = {"id": "c", "messages": [no_role, empty_text]}
    rows, _ = flat(spark, [json.dumps(mapping), json.dumps(listing)])
    assert [(r.account, r.message_id, r.role, r.text) for r in rows] == \
        [("f1", "m1", None, "x"), ("f1", "m2", "user", "")]


def test_list_path_time_and_role_fallbacks(spark):
    items = [
        {"id": "a", "author": {"role": "assistant", "name": "bot"}, "role": "user", "content": "x", "create_time": 0,
         "timestamp": "1706720400"},
        {"id": "b", "role": "system", "content": "y", "create_time": "abc"},
        {"id": "c", "author": {}, "role": "user", "content": "z", "timestamp": 1706720400000},
    ]
    rows, _ = flat(spark, [json.dumps({"id": "c", "messages": items})])
    got = {r.message_id: (r.role, r.author, str(r.create_time_local)) for r in rows}
    assert got["a"] == ("assistant", "bot", "2024-02-01 00:00:00")  # create_time 0 falls through to timestamp
    assert got["b"] == ("system", None, "None")
    assert got["c"] == ("user", None, "2024-02-01 00:00:00")        # milliseconds


def test_read_export_files(spark, scratch_dir):
    files = {"Phòng Kế toán.v2.json": [conv_map("a", msg("m1"))],
             "x+y 1%.json": {"conversations": [conv_map("b", msg("m2"))]},
             "broken.json": None}
    for name, payload in files.items():
        with open(os.path.join(scratch_dir, name), "w", encoding="utf-8") as fh:
            fh.write("{oops" if payload is None else json.dumps(payload, ensure_ascii=False))
    res = read_exports(spark, os.path.join(scratch_dir, "*.json"))
    got = sorted((r.account, r.department, r.conversation_id) for r in res.messages.collect())
    assert got == [("Phòng Kế toán.v2", "Phòng Kế toán.v2", "a"), ("x+y 1%", "x+y 1%", "b")]
    assert [r.file.endswith("broken.json") for r in res.rejected.collect()] == [True]


def test_roundtrip_equals_bridge(spark):
    from chatlens.plans.registry import QUERIES, q_messages_flat
    a = QUERIES["ingest_mapping_roundtrip"](spark, "/root/testdata/sf0.001")
    b = QUERIES["ingest_list_roundtrip"](spark, "/root/testdata/sf0.001")
    ref = q_messages_flat(spark, "/root/testdata/sf0.001").drop("is_user", "is_assistant")
    assert a.exceptAll(ref).count() == 0 and ref.exceptAll(a).count() == 0
    assert b.exceptAll(ref).count() == 0 and ref.exceptAll(b).count() == 0


def test_python_or_semantics(spark):
    """`x or y` yields y even when y is falsy: timestamp 0 is epoch 0, an empty role stays ''."""
    items = [
        {"id": "a", "role": "user", "content": "x", "timestamp": 0},                  # no create_time
        {"id": "b", "role": "user", "content": "y", "create_time": 0},                # no timestamp -> None
        {"id": "c", "author": {"role": ""}, "role": "", "content": "z", "create_time": 1706720400},
    ]
    rows, _ = flat(spark, [json.dumps({"id": "", "conversation_id": "", "messages": items})])
    got = {r.message_id: (r.role, str(r.create_time_utc)) for r in rows}
    assert got["a"] == ("user", "1970-01-01 00:00:00")
    assert got["b"] == ("user", "None")
    assert got["c"] == ("", "2024-01-31 17:00:00")
    assert {r.conversation_id for r in rows} == {""}
