"""Artifacts mined from tool calls, and replay."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.operators import artifacts, replay
from tracelake.operators.listing import glob_regex

HERE = "git commit -m \"$(cat <<'EOF'\nsow the rye\nEOF\n)\""


@pytest.fixture
def bash(spark):
    def run(*commands):
        tools = spark.createDataFrame([("m", f"t{i}", "Bash", json.dumps({"command": c}), None, None) for i, c in enumerate(commands)], "message_uuid string, tool_use_id string, tool_name string, input_json string, result_content string, is_error boolean")
        messages = spark.createDataFrame([("m", "s", "2026-01-01")], "uuid string, session_id string, timestamp string")
        return tools, messages

    return run


def test_git(bash):
    got = {(r.tool_use_id, r.operation_type): (r.commit_message, r.branch) for r in artifacts.git_operations(*bash('git add field.txt && git commit -m "plough"', HERE, 'git commit -m "mend a fence"', "git push origin south-meadow", "git checkout -b north-meadow", "echo git add")).collect()}
    assert got == {
        ("t0", "add"): (None, None),
        ("t0", "commit"): ("plough", None),
        ("t1", "commit"): ("sow the rye", None),
        ("t2", "commit"): ("mend a fence", None),
        ("t3", "push"): (None, "south-meadow"),
        ("t4", "checkout"): (None, "north-meadow"),
    }


def test_shell_files(bash):
    got = {(r.operation_type, r.file_path, r.tool_use_id) for r in artifacts.file_operations(*bash("rm -rf a b && mkdir -p c; touch -x", "ls")).collect()}
    assert got == {("bash_rm", "a", "t0:bash:rm:a"), ("bash_rm", "b", "t0:bash:rm:b"), ("bash_mkdir", "c", "t0:bash:mkdir:c"), ("bash_touch", "<touch>", "t0")}


OPS = "session_id string, file_path string, operation_type string, timestamp string, tool_use_id string, content string, old_content string"


def test_replay(spark):
    ops = spark.createDataFrame(
        [
            ("s", "/a", "edit", "1", "t1", "early", "x"),
            ("s", "/a", "write", "2", "t2", "v1 v1", None),
            ("s", "/a", "edit", "3", "t3", "v2", "v1"),
            ("s", "/a", "read", "4", "t4", None, None),
            ("s", "/a", "edit", "5", "t5", "v3", "v2"),
            ("s", "/b", "edit", "1", "t6", "y", "x"),
        ],
        OPS,
    )
    messages = spark.createDataFrame([("m3", "3")], "uuid string, timestamp string")
    assert {r.file_path: (r.content, r.applied) for r in replay.reconstruct(ops).collect()} == {"/a": ("v3 v3", 3), "/b": (None, 0)}
    assert {r.file_path: r.content for r in replay.reconstruct(ops, replay.cutoffs_at(ops, messages, "m3")).collect()} == {"/a": "v2 v2", "/b": None}
    assert {r.file_path: r.content for r in replay.reconstruct(ops, replay.cutoffs_at(ops, messages, "nobody")).collect()} == {"/a": "v3 v3", "/b": None}
    assert [(r.tool_use_id, r.content) for r in replay.file_versions(ops).orderBy("version").collect()] == [("t2", "v1 v1"), ("t3", "v2 v2"), ("t5", "v3 v3")]
    diffs = [r.diff for r in replay.file_diffs(ops).orderBy("version").collect()]
    assert len(diffs) == 3 and "-v1 v1" in diffs[1] and "+v2 v2" in diffs[1] and diffs[1].startswith("--- a//a")


def test_nothing_to_write_or_to_replace(spark):
    """A write without a content, and an edit without its new or old text, change nothing and count for nothing."""
    ops = spark.createDataFrame(
        [
            ("s", "/a", "write", "1", "t1", "hello x", None),
            ("s", "/a", "edit", "2", "t2", None, "hello "),
            ("s", "/a", "edit", "3", "t3", "y", None),
            ("s", "/a", "write", "4", "t4", None, None),
            ("s", "/a", "edit", "5", "t5", "z", "x"),
            ("s", "/b", "write", "1", "t6", None, None),
            ("s", "/c", "write", "1", "t7", "", None),
        ],
        OPS,
    )
    assert {r.file_path: (r.content, r.applied) for r in replay.reconstruct(ops).collect()} == {"/a": ("hello z", 2), "/b": (None, 0), "/c": ("", 1)}
    assert [(r.file_path, r.tool_use_id, r.content) for r in replay.file_versions(ops).orderBy("file_path", "version").collect()] == [("/a", "t1", "hello x"), ("/a", "t5", "hello z"), ("/c", "t7", "")]


def applied(diff, before):
    """What a unified diff makes of ``before``."""
    import re

    old, out, at = replay._LINE.findall(before), [], 0
    lines = replay._LINE.findall(diff)[2:]
    for k, line in enumerate(lines):
        bare = k + 1 < len(lines) and lines[k + 1].startswith("\\ No newline")
        text = line[1:].rstrip("\r\n") if bare else line[1:]
        if m := re.match(r"@@ -(\d+)(?:,(\d+))? ", line):
            start = int(m[1]) - (m[2] != "0")
            out += old[at:start]
            at = start
        elif line[0] == " " or line[0] == "-":
            assert old[at] == text
            at += 1
            out += [text] * (line[0] == " ")
        elif line[0] == "+":
            out.append(text)
    return "".join(out + old[at:])


@given(st.lists(st.sampled_from(["a\n", "b\n", "c\r\n", "d\x0c\n", "e\u2028f\n", "\n", "g\x85\n"])), st.lists(st.sampled_from(["a\n", "b\n", "c\r\n", "d\x0c\n", "e\u2028f\n", "\n", "g\x85\n"])), st.sampled_from(["", "end", "a"]), st.sampled_from(["", "end", "a"]))
@settings(max_examples=300, deadline=None)
def test_a_diff_leads_from_one_text_to_the_other(a, b, end_a, end_b):
    before, after = "".join(a) + end_a, "".join(b) + end_b
    diff = replay.unified("f", before, after)
    assert (diff == "") == (before == after)
    if diff:
        assert diff.startswith("--- a/f") and applied(diff, before) == after


def test_glob():
    import re

    assert re.match(glob_regex("*/f?.p[xy]"), "/src/deep/f1.py")
    assert not re.match(glob_regex("*/f?.p[!y]"), "/src/f1.py")
    assert not re.match(glob_regex("src.py"), "srcxpy")


def test_long_stretches_of_edits(spark):
    """Thousands of edits after one write: versions as plain folding has them, in batches no larger than what a task may hold."""
    rows, content, want = [("s", "/long", "write", 0, "x" * 200, None)], "x" * 200, ["x" * 200]
    for i in range(1, 3000):
        old, new = ("x", "xy") if i == 1 else (f"{i - 1}|", f"{i}|") if i % 3 == 0 and i > 3 else ("y", f"y{i}|") if i < 3 else ("absent", "z") if i % 3 == 1 else (f"{i - 2}|", f"{i}|")
        rows.append(("s", "/long", "edit", i, new, old))
        content = content.replace(old, new)
        want.append(content)
    rows += [("s", "/other", "edit", 1, "a", "b"), ("s", "/other", "write", 2, "b", None), ("s", "/other", "edit", 3, "c", "b"), ("s", "/other", "edit", 4, "d", "")]
    ops = spark.createDataFrame([(s, p, k, f"2031-01-01T{i:06d}", f"t{i}", c, o) for s, p, k, i, c, o in rows], "session_id string, file_path string, operation_type string, timestamp string, tool_use_id string, content string, old_content string").repartition(5)
    got = replay.file_versions(ops)
    assert [r.content for r in got.filter("file_path = '/long'").orderBy("version").collect()] == want
    assert [(r.version, r.content) for r in got.filter("file_path = '/other'").orderBy("version").collect()] == [(1, "b"), (2, "c"), (3, "c")]
    assert {r.file_path: (r.content, r.applied) for r in replay.reconstruct(ops).collect()} == {"/long": (want[-1], 3000), "/other": ("c", 3)}
    # versions leave as they are made
    import pyarrow as pa

    big = [("s", "/f", 1, i, "t", "t", "edit" if i else "write", "z" * 100_000 if i == 0 else f"{i}", None if i == 0 else f"{i - 1}") for i in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*big[lo : lo + 50])], names=replay._STEP) for lo in range(0, 300, 50)]
    given = list(replay._folding(True)(iter(batches)))
    assert sum(b.num_rows for b in given) == 300 and max(b.nbytes for b in given) < 2 * replay._HELD
    assert [b.num_rows for b in replay._folding(False)(iter(batches))] == [1]


def test_upserts_keep_columns_of_any_name(spark):
    from tracelake.functions.columns import upsert_first, upsert_last

    df = spark.createDataFrame([("a", 2, 7, 1), ("a", 1, 8, 2), (None, 5, 9, 3), (None, 6, 0, 4)], "k string, at int, n int, __n int")
    assert sorted(map(tuple, upsert_first(df, ["k"], ["at"]).collect()), key=str) == [("a", 1, 8, 2), (None, 5, 9, 3)]
    assert sorted(map(tuple, upsert_last(df, ["k"], ["at"]).collect()), key=str) == [("a", 2, 7, 1), (None, 6, 0, 4)]
