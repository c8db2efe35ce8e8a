"""Records, tables and drift, on lines made here."""

import json

import pytest

from tracelake.operators import decompose
from tracelake.operators.decompose import Tables, quarantine
from tracelake.operators.drift import drift_fields, version_diff, version_history

COMMON = {"timestamp": "2031-07-05T08:00:00Z", "sessionId": "s1", "version": "7.3", "cwd": "/work/orchard", "isSidechain": False, "userType": "external", "gitBranch": "trunk"}


def user(uuid, content="good morning", **more):
    return COMMON | {"type": "user", "uuid": uuid, "message": {"role": "user", "content": content}} | more


def assistant(uuid, content, usage=None, **more):
    message = {"id": f"reply-{uuid}", "role": "assistant", "model": "oak", "content": content, "stop_reason": "end_turn", "usage": usage or {"input_tokens": 21, "output_tokens": 8}}
    return COMMON | {"type": "assistant", "uuid": uuid, "message": message} | more


def bronze_of(spark, lines, path="/logs/orchard/s1.jsonl"):
    rows = [(path, i * 10, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "path string, off long, line string")


@pytest.fixture
def tables(spark):
    return lambda *lines: Tables(bronze_of(spark, lines))


def test_rejected_lines_say_why_and_where(spark):
    lines = [user("p1"), "[1, 2", user("p2"), " ", json.dumps({"uuid": "p3"}), {"type": "summary", "summary": "apples"}, user("p4", isSidechain="often"), "nonsense"]
    t = Tables(bronze_of(spark, lines).unionByName(bronze_of(spark, ["{]"], "/logs/orchard/s2.jsonl")))
    assert quarantine(t.bronze)[0].count() == 2
    got = {(r.path[-8:-6], r.off): (r.line_number, r.error, r.preview) for r in t.rejected.collect()}
    assert {k: v[0] for k, v in got.items()} == {("s1", 10): 1, ("s1", 40): 4, ("s1", 50): 5, ("s1", 60): 6, ("s1", 70): 7, ("s2", 0): 0}
    assert got["s1", 10][1].startswith("malformed line: Expecting ',' delimiter") and got["s1", 70][1].startswith("malformed line: Expecting value") and got["s2", 0][2] == "{]"
    assert [got["s1", o][1] for o in (40, 50, 60)] == ["missing type", "missing field leafUuid", "field isSidechain is not BOOLEAN"]


def test_lines_told_twice_count_once(tables):
    reply = assistant("q2", [{"type": "text", "text": "pears are ripe"}])
    t = tables(user("q1"), reply, user("q1"), reply)
    assert (t.messages.count(), t.message_content.count(), t.token_usage.first().input_tokens) == (2, 2, 21)


def test_fields_nobody_modelled(tables):
    odd = 'ripe"ness\\level'
    t = tables(user("r1", **{odd: {"a\"b": 1}, "basket": [1, "two"]}))
    drift = {d.field_name: (d.record_type, d.version, d.sample_value) for d in t.schema_drift.collect()}
    assert drift["basket"] == ("user", "7.3", '[1,"two"]') and set(drift) == {odd, "basket"}
    assert json.loads(t.messages.first().extra_json) == {odd: {'a"b': 1}, "basket": [1, "two"]}


def test_odd_keys_stay_json_in_every_table(tables):
    key = 'we"ird\\key'
    reply = assistant("k1", [], usage={"input_tokens": 1, "output_tokens": 2, key: 3})
    hook = {"type": "attachment", "uuid": "k2", "timestamp": "t", "sessionId": "s1", "attachment": {"type": "hook_success", "hookName": "prune", key: "x", "toolUseID": "u9"}}
    event = COMMON | {"type": "system", "uuid": "k3", "subtype": "frost", key: True}
    t = tables(reply, hook, event)
    assert json.loads(t.token_usage.first().extra_json) == {key: 3}
    assert json.loads(t.attachments.first().body_json)[key] == "x" and t.hook_executions.first().hook_name == "prune"
    assert json.loads(t.system_events.first().extra_json) == {key: True}


def test_attachment_without_a_version(tables):
    line = {"type": "attachment", "uuid": "w1", "sessionId": "s1", "timestamp": "2031-07-06T08:00:00.000Z", "cwd": "/work", "season": "autumn", "attachment": {"type": "weather_note", "sky": "grey"}}
    t = tables(line, line | {"uuid": "w2"}, line | {"uuid": "w2"})
    assert [(x.type_name, x.version, x.occurrence_count) for x in t.record_type_drift.collect()] == [("attachment.weather_note", None, 3)]
    assert [x.field_name for x in t.schema_drift.collect()] == ["season"] and t.attachments.count() == 2


@pytest.mark.parametrize("plan,kept,rest", [("1. prune", "1. prune", None), ({"steps": 2}, None, '{"planContent":{"steps":2}}'), (7, None, '{"planContent":7}'), (None, None, '{"planContent":null}')])
def test_a_plan_is_text(tables, plan, kept, rest):
    t = tables(user("n1", planContent=plan))
    m = t.messages.first()
    assert (m.plan_content, m.extra_json) == (kept, rest)
    assert [r.text_content for r in t.plan_blocks.collect()] == [kept] * (kept is not None)


@pytest.mark.parametrize("turned", [False, True])
def test_results_meet_their_calls(tables, turned):
    call = assistant("c1", [{"type": "tool_use", "id": "u1", "name": "Read", "input": {"file_path": "/barn"}}])
    lines = [call, user("c2", [{"type": "tool_result", "tool_use_id": "u1", "content": "hay", "is_error": True}])]
    r = tables(*(lines[::-1] if turned else lines)).tool_executions.first()
    assert (r.tool_name, r.result_content, r.is_error) == ("Read", "hay", True)


def test_text_that_only_looks_like_blocks(tables):
    b = tables(user("x1", '[{"type": "text"')).message_content.first()
    assert (b.block_type, b.text_content, b.block_index) == ("text", '[{"type": "text"', 0)


def test_a_message_field_hides_the_record_field(tables):
    line = assistant("y1", [], shade="deep", sun="low")
    line["message"]["shade"] = "none"
    assert json.loads(tables(line).assistant_extra.first().extra_json) == {"shade": "none", "sun": "low"}


def test_versions_one_after_another(tables):
    lines = []
    for day, (v, own) in enumerate({"7.1": "seed", "7.9": "leaf", "7.5": "fruit"}.items(), 1):
        at = {"version": v, "sessionId": f"s{v}", "timestamp": f"2031-07-0{day}T00:00:00Z"}
        lines.append(user(f"v{v}", **at, **{own: 1, "root": 1}))
    t = tables(*lines)
    h = {r.version: (r.session_count, r.new_fields_count) for r in version_history(t.sessions, t.schema_drift).collect()}
    assert h == {"7.1": (1, 2), "7.9": (1, 1), "7.5": (1, 1)}
    d = {r.version: (r.previous_version, sorted(r.new_fields), sorted(r.disappeared_fields)) for r in version_diff(t.sessions, t.schema_drift).collect()}
    assert (d["7.9"], d["7.5"]) == (("7.1", ["leaf:user"], ["seed:user"]), ("7.9", ["fruit:user"], ["leaf:user"]))


def test_what_became_of_a_field(spark):
    rows = [("plan_content", "user", "promoted"), ("weather", "assistant", "extra_json"), ("weather", "queue-operation", "unhandled"), ("weather", "attachment", "unhandled")]
    d = spark.createDataFrame([(f, r, "1", 1, "a", "b", "x") for f, r, _ in rows], "field_name string, record_type string, version string, occurrence_count long, first_seen_at string, last_seen_at string, sample_value string")
    assert {(r.field_name, r.record_type, r.promotion_status) for r in drift_fields(d).collect()} == set(rows)


def test_a_line_is_parsed_once(spark):
    """A filter on parsed fields does not parse the line again for each of them, and good lines don't go through Python."""
    bronze = spark.createDataFrame([("/l/s1.jsonl", 0, json.dumps(user("u0", "hi")))], "path string, off long, line string")
    plan = quarantine(bronze)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1 and "ArrowEvalPython" not in plan


def test_stored_rows_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """However well rows compress, a part holds a bounded number of them, and lines are not exchanged."""
    lines = [user(f"u{i}", "hi", odd=i) if i % 2 else assistant(f"a{i}", [{"type": "text", "text": "x"}, {"type": "tool_use", "id": f"t{i}", "name": "Write", "input": {"file_path": "/f", "content": "c"}}]) for i in range(60)]
    bronze = spark.createDataFrame([("/l/s1.jsonl", i, json.dumps(x)) for i, x in enumerate(lines)], "path string, off long, line string")
    monkeypatch.setattr(decompose, "RECORDS_IN_PART", 2)
    t = Tables(bronze, decompose.stored_under(str(tmp_path)))
    assert t.parts == 30
    made = {}
    t.keep = lambda name, df: made.setdefault(name, df)
    for name in ("promoted", "assistant_extra", "messages", "message_content", "token_usage", "tool_executions", "file_operations"):
        df, plan = getattr(t, name), made[name]._jdf.queryExecution().executedPlan().toString()
        assert ", 30)" in plan
        for part in plan.split("Exchange")[1:]:
            assert "line#" not in part.split("\n")[0]
    assert t.messages.count() == 60 and t.file_operations.count() == 30
    plain = Tables(bronze)
    for name in ("messages", "message_content", "file_operations"):
        assert sorted(map(str, getattr(plain, name).collect())) == sorted(map(str, getattr(t, name).collect()))
