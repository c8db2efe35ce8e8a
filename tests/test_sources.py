"""Reading and tailing trees of JSONL files."""

import json
import os

import pytest

from tracelake.operators.decompose import Tables
from tracelake.operators.search import phrase_matches, read_index
from tracelake.queries import QUERIES
from tracelake.sources.session_logs import _by_spark, follow_session_logs, followed_lines, read_session_logs, reingest, write_bronze
from tracelake.streaming.ingest import Lake, sync_session_logs

from .test_decompose import assistant, user


def text(*records):
    return "".join(json.dumps(r) + "\n" for r in records)


def lines(df):
    return sorted((r.path.rsplit("/", 1)[1], r.off, r.line) for r in df.collect())


def test_offsets_and_ranges(spark, tmp_path):
    (tmp_path / "p").mkdir()
    body = "first\n\n  \nsecond é\nno newline"
    (tmp_path / "p" / "a.jsonl").write_text(body)
    (tmp_path / "p" / "b.txt").write_text("other\n")
    raw = body.encode()
    expected = [("a.jsonl", raw.index(x.encode()), x) for x in ("first", "second é", "no newline")]
    for chunk in (1, 2, 5, 7, 1000):
        assert lines(read_session_logs(spark, str(tmp_path), chunk_bytes=chunk)) == expected, chunk


def test_tail_append_partial_line_and_restart(spark, tmp_path):
    logs, lake = tmp_path / "logs", Lake(spark, str(tmp_path / "lake"))
    logs.mkdir()
    f = logs / "s1.jsonl"
    a, b = text(user("u1")), text(user("u2"))
    f.write_text(a + b[:20])
    lake.follow(str(logs), once=True).awaitTermination()
    assert [r.off for r in lake.bronze.collect()] == [0]
    f.write_text(a + b)
    lake.follow(str(logs), once=True).awaitTermination()
    assert sorted(r.off for r in lake.bronze.collect()) == [0, len(a)]
    lake.follow(str(logs), once=True).awaitTermination()
    assert lake.bronze.count() == 2
    f.write_text(text(user("u9")))  # replaced by a shorter file
    lake.follow(str(logs), once=True).awaitTermination()
    assert {r.uuid for r in lake.tables().messages.collect()} == {"u1", "u2", "u9"}
    kinds = [r.type for r in lake.events.collect()]
    assert kinds.count("session:started") == 1 and kinds.count("record:added") == 3


def test_stream_equals_batch_and_index_refresh(spark, tmp_path):
    logs, lake = tmp_path / "logs", Lake(spark, str(tmp_path / "lake"))
    logs.mkdir()
    write = {"type": "tool_use", "id": "t1", "name": "Write", "input": {"file_path": "/f", "content": "reed bed"}}
    (logs / "s1.jsonl").write_text(text(user("u1", "tell me of HeronCreek upstream"), assistant("a1", [write], version="2.2")))
    lake.follow(str(logs), once=True, max_bytes_per_trigger=300).awaitTermination()
    batch = sorted(map(tuple, read_session_logs(spark, str(logs)).collect()))
    assert sorted((r.path, r.off, r.line) for r in lake.bronze.collect()) == batch
    assert {"file:written", "record:added", "session:started", "version:changed"} <= {r.type for r in lake.events.collect()}
    assert lake.refresh_index() and not lake.refresh_index()
    idx = read_index(spark, f"{lake.root}/index", ["message_uuid", "block_index"], "heroncreek upstream")
    assert [r.message_uuid for r in phrase_matches(idx, "heroncreek upstream").collect()] == ["u1"]


def test_three_batches_equal_one(spark, tmp_path):
    """A result one batch after its call, a call delivered again, and lines that come in three batches."""
    logs, lake = tmp_path / "logs", Lake(spark, str(tmp_path / "lake"))
    logs.mkdir()
    write = {"type": "tool_use", "id": "t1", "name": "Write", "input": {"file_path": "/barn", "content": "hay"}}
    commit = {"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": 'git commit -m "stack hay"'}}
    steps = [
        [("s1", user("u1", "first reeds")), ("s1", assistant("a1", [write, commit]))],
        [("s1", user("u2", [{"type": "tool_result", "tool_use_id": "t1", "content": "stacked", "is_error": True}])), ("s2", user("u3", "second reeds", sessionId="s2", version="8.0", timestamp="2031-07-06T00:00:00Z"))],
        [("s3", assistant("a1", [write, commit])), ("s2", user("u4", "third reeds", sessionId="s2", version="8.0"))],
    ]
    for step in steps:
        for name, line in step:
            with (logs / f"{name}.jsonl").open("a") as f:
                f.write(text(line))
        lake.follow(str(logs), once=True).awaitTermination()
        lake.refresh_index()
    stream, batch = lake.tables(), Tables(read_session_logs(spark, str(logs)))
    for name in ("sessions", "messages", "message_content", "token_usage", "tool_executions", "file_operations", "git_operations", "files", "schema_drift", "projects"):
        a, b = getattr(stream, name), getattr(batch, name)
        assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect())), name
    done = {r.tool_use_id: (r.result_content, r.is_error) for r in stream.tool_executions.collect()}
    assert done["t1"] == ("stacked", True)
    events = [(r.batch_id, r.type) for r in lake.events.collect()]
    # what is delivered again is not announced again; each file starts once
    assert sorted(e for e in events if e[1] in ("file:written", "git:commit")) == [(0, "file:written"), (0, "git:commit")]
    assert sorted(e for e in events if e[1] == "session:started") == [(0, "session:started"), (1, "session:started"), (2, "session:started")]
    keys = ["message_uuid", "block_index"]
    idx = read_index(spark, f"{lake.root}/index", keys, "reeds")
    assert {r.message_uuid for r in phrase_matches(idx, "reeds").collect()} == {"u1", "u3", "u4"} and idx.docs.count() == batch.searchable.filter("text_content is not null").count()


def test_unchanged_files_are_not_opened(tmp_path, monkeypatch):
    from tracelake.sources import session_logs

    for n in "ab":
        (tmp_path / f"{n}.jsonl").write_text(f"line of {n}\n" * 20)
    r = session_logs.TailReader({"path": str(tmp_path)})
    first = r.latestOffset()
    opened = []
    for name in ("_head", "_complete"):
        monkeypatch.setattr(session_logs, name, lambda path, *a, f=getattr(session_logs, name): opened.append(path[-7]) or f(path, *a))
    assert r.latestOffset() == first and not any(p.parts for p in r.partitions(first, first)) and not opened
    with (tmp_path / "b.jsonl").open("a") as f:
        f.write("more\n")
    second = r.latestOffset()
    assert set(opened) == {"b"}
    opened.clear()
    got = [x.as_py() for p in r.partitions(first, second) for b in r.read(p) for x in b.column(2)]
    assert got == ["more"] and not opened


def drive(reader, start):
    """One trigger: the new offset, and the lines by file."""
    now, got = reader.latestOffset(), {}
    for p in reader.partitions(start, now):
        for b in reader.read(p):
            for path, off, line in zip(*[c.to_pylist() for c in b.columns]):
                got.setdefault(path.rsplit("/", 1)[1], []).append((off, line))
    reader.commit(now)
    return now, {k: sorted(v) for k, v in got.items()}


def test_offsets_name_a_manifest(tmp_path):
    """Ten thousand files, appended, replaced and shrunk, over restarts: the offset stays a number."""
    from tracelake.sources.session_logs import ManifestReader

    logs, options = tmp_path / "logs", {"path": str(tmp_path / "logs"), "state": str(tmp_path / "state"), "chunkBytes": "4096"}
    logs.mkdir()
    for i in range(10_000):
        (logs / f"{i}.jsonl").write_text(f"line of {i}\nhalf")
    at, got = drive(ManifestReader(options), {"version": 0})
    assert at == {"version": 1} and len(got) == 10_000 and got["7.jsonl"] == [(0, "line of 7")]
    assert drive(ManifestReader(options), at) == (at, {})  # nothing new, and nothing written
    with (logs / "1.jsonl").open("a") as f:
        f.write(" is whole\nagain half")
    (logs / "2.jsonl").write_text("another file, and a longer one\n" * 3)
    (logs / "3.jsonl").write_text("x\n")
    (logs / "new.jsonl").write_text("new\n")
    at, got = drive(ManifestReader(options), at)
    assert got == {"1.jsonl": [(10, "half is whole")], "2.jsonl": [(31 * i, "another file, and a longer one") for i in range(3)], "3.jsonl": [(0, "x")], "new.jsonl": [(0, "new")]}
    # a version that was planned and never read, as after a crash, is read with the one after it
    with (logs / "new.jsonl").open("a") as f:
        f.write("second\n")
    assert ManifestReader(options).latestOffset() == {"version": 3}
    with (logs / "9.jsonl").open("a") as f:
        f.write("\n")
    at, got = drive(ManifestReader(options), at)
    assert at == {"version": 4} and got == {"new.jsonl": [(4, "second")], "9.jsonl": [(10, "half")]}
    # the same batch again gives the same
    again = ManifestReader(options)
    assert sum(b.num_rows for p in again.partitions({"version": 3}, at) for b in again.read(p)) == 1
    assert len(list((tmp_path / "state").glob("*.json"))) == 2


def test_manifest_tails_large_files_in_ranges(tmp_path):
    """Every split of appended bytes, ranges smaller than lines, a limit smaller than a line."""
    import random

    from tracelake.sources.session_logs import ManifestReader

    r = random.Random(3)
    for chunk, most in ((5, 0), (64, 0), (7, 9), (1000, 30)):
        at = tmp_path / f"{chunk}-{most}"
        (at / "logs").mkdir(parents=True)
        body = "".join("w" * r.randint(1, 40) + "\n" for _ in range(30)).encode()
        options = {"path": str(at / "logs"), "state": str(at / "state"), "chunkBytes": str(chunk), "maxBytesPerTrigger": str(most)}
        now, found, put = {"version": 0}, [], 0
        for _ in range(400):
            if put < len(body):
                step = r.randint(0, 70)
                with (at / "logs" / "a.jsonl").open("ab") as f:
                    f.write(body[put : put + step])
                put += step
            now, got = drive(ManifestReader(options), now)
            found += got.get("a.jsonl", [])
        want, off = [], 0
        for line in body.decode().split("\n")[:-1]:
            want.append((off, line))
            off += len(line) + 1
        assert found == want, (chunk, most)


def test_stores_that_only_spark_opens(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    body = "".join(f"line {i} é\r\n" for i in range(200)) + "\n  \nlast"
    (tmp_path / "deep" / "a.jsonl").write_text(body)
    (tmp_path / "b.txt").write_text("other\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = sorted((r.off, r.line) for r in _by_spark(spark, [str(tmp_path)], ".jsonl").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x for _, x in got] == [f"line {i} é" for i in range(200)] + ["last"] and len({o for o, _ in got}) == 201


def test_paths_with_commas_and_files_that_cannot_be_opened(spark, tmp_path, monkeypatch):
    from tracelake.sources import session_logs

    at = tmp_path / "a,b"
    at.mkdir()
    (at / "x.jsonl").write_text(text(user("u1")) + "[1\n")
    assert read_session_logs(spark, str(at)).count() == 2 and read_session_logs(spark, [str(at), str(at)]).count() == 2
    gone = [x for b in session_logs.read_range(session_logs.Range(str(at / "none.jsonl"), 0, 10)) for x in b.to_pylist()]
    assert gone == [{"path": str(at / "none.jsonl"), "off": -1, "line": None}]
    bronze = read_session_logs(spark, str(at)).unionByName(spark.createDataFrame([(str(at / "none.jsonl"), -1, None)], session_logs.SCHEMA))
    listed = spark.createDataFrame([(str(at / f"{n}.jsonl"),) for n in ("x", "none", "old")], "path string")
    t = Tables(bronze)
    report = session_logs.sync_report(listed, bronze, t.rejected, spark.createDataFrame([], "path string"))
    assert {r.path.rsplit("/", 1)[1]: (r.state, r.records, r.warnings) for r in report.collect()} == {"x.jsonl": ("synced", 1, 1), "none.jsonl": ("errored", 0, 0), "old.jsonl": ("skipped", 0, 0)}
    assert tuple(session_logs.sync_totals(report).first()) == (3, 1, 1, 1, 1, 1, 0)


def test_reingest_replaces_one_file(spark, tmp_path, monkeypatch):
    from tracelake.sources import session_logs

    monkeypatch.setattr(session_logs, "BUCKETS", 2)  # files share parts
    logs, at = tmp_path / "logs", str(tmp_path / "bronze")
    logs.mkdir()
    for s in "abcd":
        (logs / f"{s}.jsonl").write_text(text(user(s)))
    write_bronze(read_session_logs(spark, str(logs)), at)
    (logs / "a.jsonl").write_text(text(user("other"), user("a2")))
    (logs / "b.jsonl").write_text(text(user("not read")))
    for _ in range(2):
        reingest(spark, [str(logs / "a.jsonl")], at)
    got = sorted((r.path[-7], json.loads(r.line)["uuid"]) for r in spark.read.parquet(at).collect())
    assert got == [("a", "a2"), ("a", "other"), ("b", "b"), ("c", "c"), ("d", "d")]


def test_empty_tree(spark, tmp_path):
    assert read_session_logs(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("path,expected", [("/p/abc.jsonl", "abc"), ("/p/uuid/subagents/agent-x.jsonl", "uuid"), ("x.y.jsonl", "x.y")])
def test_session_from_path(spark, path, expected):
    from pyspark.sql import functions as F

    from tracelake.functions.columns import session_id_from_path

    assert spark.createDataFrame([(path,)], "p string").select(session_id_from_path(F.col("p"))).first()[0] == expected


def test_bytes_per_trigger(tmp_path):
    from tracelake.sources.session_logs import TailReader

    f = tmp_path / "a.jsonl"
    f.write_bytes(b"aa\nbbbb\ncc\n" + b"d" * 50 + b"\ntail")
    r, at = TailReader({"path": str(tmp_path), "maxBytesPerTrigger": "8"}), []
    before, got = r.initialOffset(), []
    for _ in range(4):
        now = r.latestOffset()
        got += [x.as_py() for p in r.partitions(before, now) for b in r.read(p) for x in b.column(2)]
        at.append(now[str(f)][0])
        before = now
    assert at == [8, 11, 62, 62] and got == ["aa", "bbbb", "cc", "d" * 50]


# ---------------------------------------------------------------- versions of a lake


def five_batches():
    """Sessions that go on, results after their calls, agents, drift, attachments, summaries, unknown types."""
    out, n = [], 0
    for b in range(5):
        step = []
        for s in ("s1", "s2", f"s{b + 3}"):
            n += 1
            own = {"sessionId": s, "timestamp": f"2031-07-0{b + 1}T0{n % 10}:00:00Z", "version": f"{b}.0", "agentId": f"g{n % 3}", "cwd": f"/work/{s[:2]}", "odd": n}
            call = {"type": "tool_use", "id": f"t{n}", "name": "Write", "input": {"file_path": f"/barn/{n % 4}", "content": f"hay {n}"}}
            result = {"type": "tool_result", "tool_use_id": f"t{n - 3}", "content": f"stacked {n}", "is_error": n % 2 == 0}
            step.append((s, user(f"u{n}", [{"type": "text", "text": f"reeds {n}"}, result], **own)))
            step.append((s, assistant(f"a{n}", [call], **own)))
        step.append(("s1", {"type": "summary", "summary": f"so far {b}", "leafUuid": f"a{n}"}))
        step.append(("s1", {"type": "mystery", "sessionId": "s1", "version": "9", "timestamp": f"2031-07-0{b + 1}T00:00:00Z"}))
        step.append(("s2", {"type": "attachment", "uuid": f"x{b}", "timestamp": f"2031-07-0{b + 1}T00:00:00Z", "sessionId": "s2", "attachment": {"type": "hook_success", "hookEvent": "e", "toolUseID": f"t{n}", "exitCode": b}}))
        out.append(step)
    return out


TABLES = "sessions projects agents messages message_content token_usage tool_executions system_events summaries attachments hook_executions file_operations git_operations files schema_drift record_type_drift plan_blocks".split()


def same_tables(a, b, names=TABLES):
    for name in names:
        x, y = getattr(a, name), getattr(b, name)
        assert sorted(map(str, x.select(y.columns).collect())) == sorted(map(str, y.collect())), name


def lines_of(spark, step, offsets):
    """A batch as the tail gives it; ``offsets`` go on over batches."""
    rows = []
    for s, r in step:
        line = json.dumps(r)
        rows.append((f"/logs/{s}.jsonl", offsets.get(s, 0), line))
        offsets[s] = offsets.get(s, 0) + len(line) + 1
    return rows, spark.createDataFrame(rows, "path string, off bigint, line string")


def test_a_stream_of_batches_equals_one_batch(spark, tmp_path, monkeypatch):
    from tracelake.functions import store

    monkeypatch.setattr(store, "FAN", 2)  # runs merge all the time
    lake, offsets, rows = Lake(spark, str(tmp_path), buckets=4), {}, []
    opened = []
    for i, step in enumerate(five_batches()):
        own, df = lines_of(spark, step, offsets)
        rows += own
        lake.ingest_batch(df, i)
        state = lake.store.state()
        opened.append(sum(map(len, state.runs.values())))
    batch = Tables(spark.createDataFrame(rows, "path string, off bigint, line string"))
    stored = lake.tables()
    assert type(stored).__name__ == "Stored" and not lake.store.state().notes["shared"]
    same_tables(stored, batch)
    assert sorted(map(str, lake.records.collect())) == sorted(map(str, batch.records.collect()))
    # no line is decoded when a table is read, and runs do not pile up
    assert "from_json" not in stored.messages._jdf.queryExecution().toString() and max(opened) <= 15
    assert not list(tmp_path.glob("work/*")) and len(list(tmp_path.glob("versions/*.json"))) == 2
    live = {(int(b), v) for b, v in lake.store.state().buckets.items()}
    there = {(int(p.name[7:]), int(p.parent.name[5:])) for p in tmp_path.glob("silver/messages/made=*/bucket=*")}
    assert live <= there and len(there) <= 2 * len(live)
    lake.ingest_batch(df, 4)  # what is committed is not done again
    same_tables(lake.tables(), batch, ["messages", "schema_drift"])


def test_a_batch_shows_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A batch that stops after each of its writes in turn."""
    from tracelake.functions import store

    steps, offsets = five_batches()[:2], {}
    lake = Lake(spark, str(tmp_path), buckets=2)
    old, df = lines_of(spark, steps[0], offsets)
    new, more = lines_of(spark, steps[1], offsets)
    lake.ingest_batch(df, 0)

    def seen():
        t = lake.tables()
        return [sorted(map(str, x.collect())) for x in (lake.bronze, lake.events, t.messages, t.sessions, t.schema_drift)]

    before, write, left = seen(), store.Store.write, [0]

    def stops(self, df, path, *by):
        write(self, df, path, *by)
        left[0] -= 1
        if left[0] == 0:
            raise RuntimeError("lost")

    monkeypatch.setattr(store.Store, "write", stops)
    for n in (1, 2, 3, 9, 19, 24):
        left[0] = n
        with pytest.raises(RuntimeError):
            lake.ingest_batch(more, 1)
        left[0] = 0
        assert seen() == before, n
    commit = store.Store.commit
    monkeypatch.setattr(store.Store, "commit", lambda self, state: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        lake.ingest_batch(more, 1)
    monkeypatch.setattr(store.Store, "commit", commit)
    assert seen() == before
    lake.ingest_batch(more, 1)
    same_tables(lake.tables(), Tables(spark.createDataFrame(old + new, "path string, off bigint, line string")), ["messages", "tool_executions", "schema_drift", "agents"])
    assert sorted(r.batch_id for r in lake.events.select("batch_id").distinct().collect()) == [0, 1]


def test_a_session_under_another_name(spark, tmp_path):
    """Records that stand in two sessions are settled together."""
    lake, offsets, rows = Lake(spark, str(tmp_path), buckets=64), {}, []
    copied = user("u1", "the same")
    for i, step in enumerate([[("b", copied | {"sessionId": "sb"})], [("a", copied | {"sessionId": "sa"}), ("a", user("u2", "more", sessionId="sa"))]]):
        own, df = lines_of(spark, step, offsets)
        rows += own
        lake.ingest_batch(df, i)
    assert lake.store.state().notes["shared"]
    same_tables(lake.tables(), Tables(spark.createDataFrame(rows, "path string, off bigint, line string")), ["messages", "message_content", "sessions", "schema_drift"])


def test_a_batch_counts_itself(spark, tmp_path):
    from tracelake.operators.drift import observations
    from tracelake.sources.session_logs import sync_report, sync_totals

    lake, offsets = Lake(spark, str(tmp_path), buckets=2), {}
    rows, df = lines_of(spark, five_batches()[0], offsets)
    df = df.unionByName(spark.createDataFrame([("/logs/s1.jsonl", 900_000, "[broken"), ("/logs/none.jsonl", -1, None)], df.schema))
    lake.ingest_batch(df, 0)
    t = Tables(df)
    want = sync_totals(sync_report(df.select("path").distinct(), df, t.rejected, observations(t.records))).first().asDict()
    assert lake.sync_totals(last=True) == {k: v for k, v in want.items() if k not in ("files_discovered", "files_skipped")} and want["total_warnings"] == 1
    assert [r.preview for r in lake.tables().rejected.collect()] == ["[broken"]
    lake.ingest_batch(df.limit(0), 1)
    assert set(lake.sync_totals(last=True).values()) == {0} and lake.sync_totals() == {k: v for k, v in want.items() if k not in ("files_discovered", "files_skipped")}


def test_keys_open_what_may_hold_them(spark, tmp_path, monkeypatch):
    from tracelake.functions import store

    monkeypatch.setattr(store, "FAN", 3)
    keys, state = store.Keys(store.Store(spark, str(tmp_path)), parts=4), store.State()

    def some(lo, hi):
        return spark.range(lo, hi).selectExpr("'k' as kind", "concat('key', id) as key", "cast(id % 7 as int) as home")

    for i in range(10):
        keys.add(state, some(1000 * i, 1000 * i + 1000), i)
    assert len(state.runs["keys"]) <= 5 and sum(len(list(tmp_path.glob(f"runs/keys/{r}"))) for r, _ in state.runs["keys"]) == len(state.runs["keys"])
    new = some(50_000, 50_200)
    assert sum(map(len, keys.opened(state, new).values())) <= 2 and keys.seen(state, new).count() == 0
    met = keys.seen(state, some(9_990, 10_010))
    assert sorted((r.key, r.home) for r in met.collect()) == sorted((f"key{i}", i % 7) for i in range(9_990, 10_000))


def test_two_writers_of_a_version(spark, tmp_path):
    from tracelake.functions.store import Conflict, Store

    store = Store(spark, str(tmp_path))
    state = store.state()
    store.commit(state)
    with pytest.raises(Conflict):
        store.commit(state)
    assert store.state().number == 1


def test_segments_of_an_index(spark, tmp_path, monkeypatch):
    """Many refreshes leave few segments; documents read anew count once; a refresh that stops is done again."""
    from tracelake.operators import search

    monkeypatch.setattr(search, "FAN", 3)
    at, texts = str(tmp_path / "index"), {}

    def put(n, docs, dead=()):
        df = spark.createDataFrame([(k, v) for k, v in docs.items()], "id string, text string")
        search.write_index(search.build_index(df, ["id"], "text"), at, run=n, part_tokens=30, dead=spark.createDataFrame([(k,) for k in dead], "id string") if dead else None)
        texts.update(docs)

    def same(query):
        whole = search.build_index(spark.createDataFrame(list(texts.items()), "id string, text string"), ["id"], "text")
        a, b = (sorted((r.id, r.tf, round(r.score, 9)) for r in search.ranked(i, query).collect()) for i in (search.read_index(spark, at, ["id"], query), whole))
        assert a == b and a

    for n in range(10):
        again = f"d{3 * n - 4}" if n > 3 else None  # read anew with another text
        put(n, {f"d{3 * n + i}": f"the tale {n} of the reeds {'x ' * (n + i)}" for i in range(3)} | ({again: f"the other tale of {n}"} if again else {}), [again] if again else ())
        if n in (1, 5, 9):
            same("the tale")
        if n in (5, 9):
            same("other")
    segments = search.index_notes(spark, at)["segments"]
    assert len(segments) <= 4 and max(x["parts"] for x in segments) > min(x["parts"] for x in segments)
    put(9, {f"d{27 + i}": f"the tale {i} again" for i in range(3)} | {"d23": texts["d23"]}, ["d23"])  # the last run again, with other texts
    same("the tale")
    # documents are written, the version is not: nothing is seen, and the refresh can be done again
    commit, held = search.Store.commit, dict(texts)
    monkeypatch.setattr(search.Store, "commit", lambda self, state: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        put(10, {"e1": "the tale of e"})
    monkeypatch.setattr(search.Store, "commit", commit)
    texts.clear()
    texts.update(held)
    same("the tale")
    put(11, {"e1": "the tale of e"})
    same("the tale")


def test_written_logs_are_one_file_a_path_and_nothing_beside(spark, tmp_path):
    from tracelake.sources.session_logs import write_session_logs

    lines = spark.createDataFrame([(f"session=s{i % 40}/lines.txt", i, f"line {i} é") for i in range(400)], "path string, off long, line string").repartition(3)
    write_session_logs(lines, str(tmp_path / "logs"))
    found = {p.relative_to(tmp_path / "logs").as_posix(): p.read_text() for p in (tmp_path / "logs").rglob("*") if p.is_file()}
    assert found == {f"session=s{s}/lines.txt": "".join(f"line {i} é\n" for i in range(s, 400, 40)) for s in range(40)}
    back = read_session_logs(spark, str(tmp_path / "logs"), suffix=".txt")
    assert sorted(r.line for r in back.collect()) == sorted(r.line for r in lines.collect())


def test_rendered_logs_have_a_file_a_session(spark, tmp_path):
    import datetime
    import pathlib

    from tracelake.queries import _written_logs

    events = [(i, datetime.datetime(2024, 1, 1), None if i == 9 else i % 3, "click", 1.5, '{"k": 5}') for i in range(12)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    at = _written_logs(spark, str(tmp_path))
    files = [p for p in pathlib.Path(at).rglob("*") if p.is_file()]
    assert sorted(p.parent.name for p in files) == ["session=__HIVE_DEFAULT_PARTITION__", "session=s0", "session=s1", "session=s2"]  # and no checksums
    assert sum(len(p.read_text().splitlines()) for p in files) == 12


def test_bronze_has_a_file_a_bucket_whatever_the_tasks(spark, tmp_path, monkeypatch):
    from tracelake.sources import session_logs

    monkeypatch.setattr(session_logs, "BUCKETS", 3)
    lines = spark.range(600).selectExpr("concat('f', id % 50) path", "id off", "concat('line ', id) line").repartition(4)
    write_bronze(lines, str(tmp_path / "bronze"))
    assert len(list((tmp_path / "bronze").rglob("*.parquet"))) == 3  # not one for each bucket and task
    assert spark.read.parquet(str(tmp_path / "bronze")).drop("bucket").exceptAll(lines).isEmpty()


def test_followed_lines_are_appended_once(spark, tmp_path):
    logs, to = tmp_path / "logs", str(tmp_path / "to")
    logs.mkdir()
    assert followed_lines(spark, to).count() == 0
    f = logs / "s1.jsonl"
    f.write_text("one\ntwo\nthr")
    for _ in range(2):  # the second run finds nothing new
        follow_session_logs(spark, str(logs), to, once=True).awaitTermination()
        assert lines(followed_lines(spark, to)) == [("s1.jsonl", 0, "one"), ("s1.jsonl", 4, "two")]
    f.write_text("one\ntwo\nthree\n")
    (logs / "s2.jsonl").write_text("other\n")
    follow_session_logs(spark, str(logs), to, once=True).awaitTermination()
    assert lines(followed_lines(spark, to)) == [("s1.jsonl", 0, "one"), ("s1.jsonl", 4, "two"), ("s1.jsonl", 8, "three"), ("s2.jsonl", 0, "other")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
@pytest.mark.parametrize("name", ["l1_tail_session_logs", "a4_incremental_read"])
def test_lines_alone_make_no_silver_tables(spark, name, monkeypatch):
    """A query that only asks for the tailed lines doesn't decompose them."""
    monkeypatch.setattr(Lake, "ingest_batch", lambda *a: pytest.fail("decomposed"))
    rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n_lines for r in rows) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count() > 0


def test_one_batch_settles_what_sessions_share(spark, tmp_path):
    """Where one batch wrote all buckets its tables are read as they are, also if sessions share messages or calls; uuids of several records are settled."""
    call = [{"type": "tool_use", "id": "t1", "name": "Write", "input": {"file_path": "/barn/1", "content": "hay"}}]
    step = [
        ("a", assistant("a1", call, sessionId="sa", odd=1)),
        ("a", user("u1", "[first]", sessionId="sa", planContent="sow", isCompactSummary=True)),
        ("a", user("u1", "again", sessionId="sa", planContent="reap", sourceToolUseID="t1", odd={"n": 2})),
        ("b", user("u2", [{"type": "tool_result", "tool_use_id": "t1", "content": "stacked"}], sessionId="sb")),
        ("b", assistant("a1", [{"type": "text", "text": "copied"}], sessionId="sb", odd=3)),
        ("b", assistant("u2", "of two kinds", sessionId="sb", strange=4)),
        ("c", user("u3", {"neither": "text nor blocks"}, sessionId="sc", planContent=5)),
        ("c", assistant("a3", "alone", {"input_tokens": 1, "unit": "u"}, sessionId="sc", more=[1])),
    ]
    lake = Lake(spark, str(tmp_path), buckets=64)
    rows, df = lines_of(spark, step, {})
    lake.ingest_batch(df, 0)
    assert lake.store.state().notes["shared"] and type(lake.tables()).__name__ == "Stored"
    same_tables(lake.tables(), Tables(df))
    assert lake.tables().messages.count() > 4
    _, df = lines_of(spark, [("d", user("u9", "later", sessionId="sd"))], {})
    lake.ingest_batch(df, 1)  # buckets of two batches again
    assert type(lake.tables()).__name__ == "Tables"


def test_a_sync_takes_what_came_since_the_one_before(spark, tmp_path):
    from tracelake.sources.session_logs import sync_totals

    logs, to = tmp_path / "logs", str(tmp_path / "synced")
    (logs / "deep").mkdir(parents=True)

    def run():
        got = sync_session_logs(spark, str(logs), to)
        assert got.totals == sync_totals(got.report).first().asDict()
        return {r.path.rsplit("/", 1)[1][:2]: tuple(r)[1:] for r in got.report.collect()}, got.totals["files_skipped"]

    assert run() == ({}, 0)
    (logs / "s1.jsonl").write_text(text(user("u1"), user("u2", "hi", odd=1, odder=2)) + "[broken\n\n")
    (logs / "deep" / "s2.jsonl").write_text(text(user("u3")) + '{"type": "us')
    assert run() == ({"s1": ("synced", 2, 1, 2), "s2": ("synced", 1, 0, 0)}, 0)
    assert run() == ({"s1": ("skipped", 0, 0, 0), "s2": ("skipped", 0, 0, 0)}, 2)
    with (logs / "s1.jsonl").open("a") as f:
        f.write(text(user("u4", "hi", odd=3)))
    (logs / "s3.jsonl").write_text("[broken\n")
    assert run() == ({"s1": ("synced", 1, 0, 1), "s2": ("skipped", 0, 0, 0), "s3": ("synced", 0, 1, 0)}, 1)


def test_a_sync_that_stopped_is_done_again(spark, tmp_path, monkeypatch):
    from tracelake.functions.store import Store

    logs, to, write = tmp_path / "logs", str(tmp_path / "synced"), Store.write
    logs.mkdir()
    (logs / "s1.jsonl").write_text(text(user("u1"), user("u2")))

    def stops(self, df, path, *by):
        write(self, df, path, *by)
        raise RuntimeError("stopped")

    monkeypatch.setattr(Store, "write", stops)
    with pytest.raises(Exception, match="stopped"):
        sync_session_logs(spark, str(logs), to)
    monkeypatch.setattr(Store, "write", write)
    with (logs / "s1.jsonl").open("a") as f:
        f.write(text(user("u3")))
    assert [(r.state, r.records) for r in sync_session_logs(spark, str(logs), to).report.collect()] == [("synced", 3)]
    assert spark.read.parquet(f"{to}/bronze").count() == 3
