"""Views, listings, search, SQL and exports."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.operators import assemble, export, listing, search, stats, views
from tracelake.operators.decompose import Tables
from tracelake.plans import sqlrun

from .test_decompose import assistant, user


@pytest.fixture(scope="module")
def t(spark):
    def call(i, name, **arg):
        return [{"type": "text", "text": f"doing {i}"}, {"type": "tool_use", "id": f"t{i}", "name": name, "input": arg}]

    lines = [
        user("u0", "please HeronCreek upstream"),
        assistant("a1", call(1, "Write", file_path="/f.py", content="one"), timestamp="2031-07-05T08:00:30Z"),
        assistant("a2", call(2, "Bash", command='git commit -m "msg"'), timestamp="2031-07-05T08:02:00Z"),
        user("u3", [{"type": "tool_result", "tool_use_id": "t2", "content": "boom", "is_error": True}], timestamp="2031-07-05T08:02:01Z", parentUuid="a2"),
        assistant("a4", [{"type": "thinking", "thinking": "hm"}], timestamp="2031-07-05T08:05:00Z", parentUuid="a2"),
        user("u5", "summary", isCompactSummary=True, timestamp="2031-07-05T08:06:00Z"),
        {"type": "attachment", "uuid": "att", "sessionId": "s1", "timestamp": "2031-07-05T08:00:00Z", "attachment": {"type": "skill_listing", "content": "the HeronCreek upstream skill"}},
    ]
    return Tables(spark.createDataFrame([("/l/s1.jsonl", i, json.dumps(x)) for i, x in enumerate(lines)], "path string, off long, line string"))


def test_views(t):
    c = views.session_cost(t.sessions, t.messages, t.token_usage, t.file_operations, t.git_operations).first()
    assert (c.message_count, c.input_tokens, c.file_ops, c.git_ops) == (5, 63, 1, 1)
    near = views.git_commit_context(t.git_operations, t.messages, t.message_content, t.sessions).collect()
    assert sorted(r.assistant_reasoning for r in near) == ["doing 1", "doing 2"]
    assert [r.assistant_reasoning for r in views.git_commit_context(t.git_operations, t.messages, t.message_content, t.sessions, window_s=60).collect()] == ["doing 2"]
    assert len(views.git_commit_context(t.git_operations, t.messages, t.message_content, t.sessions, window_s=60, compat="lexical").collect()) == 2
    e = views.tool_errors(t.tool_executions, t.messages, t.sessions).first()
    assert (e.tool_name, e.error_content) == ("Bash", "boom")


def test_fanout_in_closed_form(t):
    ops = t.file_operations.unionByName(t.file_operations)
    git = t.git_operations.unionByName(t.git_operations).unionByName(t.git_operations)
    p = views.project_summary(t.sessions, t.messages, t.token_usage, ops, git, compat="fanout").first()
    assert p.total_tokens == 87 * 2 * 3


def test_tree_and_conversation(t):
    assert {r.uuid: r.child_count for r in assemble.session_tree(t.messages).collect()}["a2"] == 2
    c = assemble.conversation(t.messages, t.message_content, t.token_usage, include_thinking=False, include_tool_io=False, limit=3, offset=1).orderBy("position").collect()
    assert [(r.uuid, len(r.blocks)) for r in c] == [("a1", 1), ("a2", 1), ("u3", 0)]


def test_stats(t):
    s = stats.session_summary(t.sessions, t.messages, t.token_usage, t.tool_executions).first()
    assert (s.message_count, s.tool_uses, s.distinct_tools, s.duration_seconds) == (6, 2, 2, 360)
    assert stats.model_breakdown(t.messages).first().percentage == 100.0


def test_search_union(t):
    keys, query = ["message_uuid", "block_index"], "heroncreek UPSTREAM"
    index = search.build_index(t.searchable.filter("text_content is not null"), keys, "text_content")
    texts = search.attachment_docs(t.attachments)
    hits = search.search_all(index, t.messages, t.searchable, search.build_index(texts, ["attachment_uuid", "part"], "text_content"), texts, query, 10).collect()
    assert {r.source for r in hits} == {"message", "attachment"}
    assert all(">>>HeronCreek upstream<<<" in r.snippet for r in hits)
    assert search.search_messages(index, t.messages, t.searchable, "upstream heroncreek").count() == 0
    ops = search.build_index(search.file_op_docs(t.file_operations), ["tool_use_id", "field"], "text_content")
    op = search.search_file_ops(ops, t.file_operations, "one").first()
    assert (op.file_path, op.snippet) == ("/f.py", "<b>one</b>")


def test_snippets_keep_the_source(spark):
    text = "One, two -- (three) FOUR: Crème\nbrûlée!  Five; e\u0301clair six."
    rows = spark.createDataFrame([(text,)], "text string")

    def cut(first, words, around):
        return rows.select(search.snippet(F.col("text"), F.lit(first), words, around=around)).first()[0]

    assert cut(4, 2, 6) == "...three) FOUR: >>>Crème\nbrûlée<<<!  Five; e\u0301clair..."
    assert cut(0, 1, 30) == ">>>One<<<" + text[3:]
    assert cut(8, 1, 2) == "...>>>six<<<." and cut(7, 1, 1) == "...>>>e\u0301clair<<<..."


def test_stored_index_and_a_second_run(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the the tale of number {i}" if i % 3 else None) for i in range(60)], "id int, text string")
    at, query = str(tmp_path / "index"), "the tale"
    search.write_index(search.build_index(docs.filter("id < 40"), ["id"], "text"), at, part_tokens=20)
    for _ in range(2):  # a run that is written again replaces itself
        search.write_index(search.build_index(docs.filter("id >= 40"), ["id"], "text"), at, run=1)
    stored, whole = search.read_index(spark, at, ["id"], query), search.build_index(docs, ["id"], "text")
    assert stored.docs.count() == 60 and stored.postings.select("term").distinct().count() < whole.postings.select("term").distinct().count()
    assert sorted(map(tuple, search.ranked(stored, query).collect())) == sorted(map(tuple, search.ranked(whole, query).collect()))


def test_phrase_repeats_and_marks(spark):
    assert search.query_terms("Ḟůłl ŠẼA e\u0301") == ["fułl", "sea", "e"] and len(search.PLAIN) > 200
    docs = spark.createDataFrame([(1, "Crème brûlée creme brulee"), (2, "brulee creme"), (3, None), (4, " ".join(["x"] * 70 + ["creme", "brulee"]))], "id int, text string")
    m = search.phrase_matches(search.build_index(docs, ["id"], "text"), "crème BRÛLÉE")
    assert {r.id: (r.tf, r.first) for r in m.collect()} == {1: (2, 0), 4: (1, 70)}


def test_sql_is_read_only(spark, t):
    sqlrun.register(t, spark, ["messages", "sessions", "tool_executions", "message_content"])
    assert sqlrun.sql_readonly(spark, "SELECT count(*) AS n FROM messages WHERE type = :t", {"t": "user"}).first().n == 3
    assert sqlrun.sql_readonly(spark, "SELECT 'DROP TABLE x; DELETE' AS s").first().s.startswith("DROP")
    sqlrun.sql_readonly(spark, "EXPLAIN SELECT 1")
    for bad in ("CREATE TABLE z AS SELECT 1", "INSERT INTO messages SELECT * FROM messages", "DROP VIEW messages", "SET a=b", "DELETE FROM messages", "EXPLAIN DROP VIEW messages"):
        with pytest.raises(sqlrun.NotReadOnly):
            sqlrun.sql_readonly(spark, bad)
    reads = [
        "WITH a AS (SELECT type, count(*) AS n FROM messages GROUP BY type HAVING n > 0) SELECT * FROM a JOIN a b USING (type) ORDER BY 1 LIMIT 3",
        "SELECT uuid FROM messages WHERE uuid IN (SELECT uuid FROM messages) AND EXISTS (SELECT 1 FROM sessions) UNION SELECT 'x' EXCEPT SELECT 'y'",
        "SELECT type, row_number() OVER (PARTITION BY type ORDER BY uuid) AS n, (SELECT max(timestamp) FROM messages) AS last FROM messages LATERAL VIEW explode(array(1, 2)) e AS x",
        "SELECT * FROM VALUES (1, 2), (3, 4) AS v(a, b)", "SELECT * FROM range(3)", "EXPLAIN WITH a AS (SELECT 1) SELECT * FROM a", "SELECT DISTINCT type FROM messages OFFSET 1", "SELECT 1;",
    ]
    for good in reads:
        sqlrun.sql_readonly(spark, good).collect()
    refused = [
        "ALTER TABLE t RENAME TO u", "ALTER TABLE t ADD COLUMNS (a int)", "ALTER TABLE t SET TBLPROPERTIES ('a' = 'b')", "COMMENT ON TABLE t IS 'x'", "SHOW TABLES", "DESCRIBE messages", "CACHE TABLE messages", "USE x", "TRUNCATE TABLE t",
        "MERGE INTO messages t USING messages s ON t.uuid = s.uuid WHEN MATCHED THEN DELETE", "SELECT reflect('java.lang.System', 'currentTimeMillis')", "SELECT 1 WHERE (SELECT java_method('java.lang.System', 'nanoTime')) > '0'",
        "WITH a AS (SELECT try_reflect('java.lang.System', 'exit', 1) AS x) SELECT * FROM a", "EXPLAIN ALTER TABLE t RENAME TO u", "FROM messages INSERT INTO t SELECT *", "ADD JAR x", "EXECUTE IMMEDIATE 'DROP VIEW messages'", "CALL x()",
    ]
    for bad in refused:
        with pytest.raises(Exception):
            sqlrun._check(spark, bad)
    for empty in ("", " ; "):
        with pytest.raises(Exception):
            sqlrun.sql_readonly(spark, empty)
    with pytest.raises(Exception):
        sqlrun.sql_readonly(spark, "SELECT 1; SELECT 2")
    assert sqlrun.run_canned(spark, "recent-sessions", {"limit": "1"}).count() == 1
    assert sqlrun.run_canned(spark, "message-search-context", {"search_term": "DOING"}).count() == 2
    with pytest.raises(ValueError):
        sqlrun.run_canned(spark, "tool-usage-by-session")
    assert sqlrun.parameters("SELECT ':no', a::int, :yes -- :neither") == ["yes"]


def test_sql_reads_registered_views_alone(spark, t, tmp_path):
    sqlrun.register(t, spark, ["messages", "sessions"])
    (tmp_path / "secret.txt").write_text("secret")
    spark.range(3).createOrReplaceTempView("not_registered")
    spark.udf.register("own_function", lambda x: x)
    relations = [f"text.`{tmp_path}/secret.txt`", f"IDENTIFIER('text.`{tmp_path}/secret.txt`')", "not_registered", "default.messages", "global_temp.messages", "read_files('/')", "sql_keywords()", "python_worker_logs()"]
    calls = ["IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.name')", "system.builtin.reflect('java.lang.System', 'nanoTime')", "java_method('java.lang.System', 'nanoTime')", "own_function(1)", "input_file_name()", "current_user()", "raise_error('x')", "xpath('<a/>', 'a')"]
    queries = [f"SELECT * FROM {r}" for r in relations] + [f"SELECT {c} AS x" for c in calls]
    for q in queries:
        for form in ("{}", "WITH a AS ({}) SELECT * FROM a", "SELECT (SELECT count(*) FROM ({}) AS b) AS n FROM messages", "SELECT * FROM messages, LATERAL ({}) AS l", "SELECT 1 WHERE EXISTS ({})", "EXPLAIN {}"):
            with pytest.raises(sqlrun.NotReadOnly):
                sqlrun.sql_readonly(spark, form.format(q))
    # a name of a WITH part is that part's own only where it is in reach
    with pytest.raises(Exception):
        sqlrun.sql_readonly(spark, "SELECT * FROM (WITH not_registered AS (SELECT 1) SELECT * FROM not_registered) JOIN not_registered")
    good = [
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT max(n) FROM r",
        "SELECT left(uuid, 1), to_char(5, '9'), to_json(try_parse_json('1')), date_trunc('day', now()), percentile_approx(1, 0.5), count(*) FILTER (WHERE type = 'user') FROM Messages GROUP BY ALL",
        "SELECT transform(array(1, 2), x -> x + 1), (SELECT max(s.version) FROM sessions s WHERE s.session_id = m.session_id) FROM MESSAGES m, LATERAL (SELECT 1)",
        "SELECT type, version, count(*) FROM messages GROUP BY CUBE (type, version)",
        "SELECT * FROM messages PIVOT (count(uuid) FOR type IN ('user', 'assistant'))", "SELECT /*+ REPARTITION(2) */ DISTINCT * EXCEPT (uuid) FROM messages TABLESAMPLE (50 PERCENT)", "SELECT stack(2, 1, 2), CASE WHEN true THEN 'a' END || 'b'",
    ]
    for q in good:
        sqlrun.sql_readonly(spark, q).collect()


def test_a_slow_query_is_stopped(spark, t):
    import time

    sqlrun.register(t, spark, ["messages"])
    assert sqlrun.sql_readonly(spark, "SELECT count(*) AS n FROM messages", seconds=60).first().n > 0
    began = time.time()
    with pytest.raises(sqlrun.TooSlow):
        sqlrun.sql_readonly(spark, "SELECT sum(sqrt(a.id * b.id)) AS s FROM range(3000000) a JOIN range(3000000) b ON a.id + b.id > 0", seconds=1)
    assert time.time() - began < 15
    assert sqlrun.sql_readonly(spark, "SELECT count(*) AS n FROM messages", seconds=60).first().n > 0


def test_exports(t, tmp_path, spark):
    md = export.export_markdown(t.sessions, t.messages, t.message_content, t.token_usage).first().markdown
    assert md.startswith("# Session: s1\n**Project:** /work/orchard\n**Date:** 2031-07-05T08:00:00Z\n") and "### Tool Use: Bash\n**Input:** `" in md
    row = {r.uuid: r for r in export.export_csv(t.messages, t.message_content, t.token_usage).collect()}
    assert (row["a4"].content_preview, row["u3"].content_preview, row["a1"].input_tokens) == ("hm", "", 21)
    docs = export.export_json(t.sessions, t.messages, t.message_content, t.token_usage)
    export.write_json(docs, str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json")).first()
    assert len(back.messages) == 6


def test_bookmarks(spark):
    b = spark.createDataFrame([(1, 7, "s", "u", "a", "Label", '["x","y"]', 0)], "id int, project_id int, session_id string, user_uuid string, assistant_uuid string, label string, tags string, created long")
    p = spark.createDataFrame([(7, "/Projects/p", "-Projects-p")], "id int, path string, encoded_name string")
    r = listing.read_bookmarks(b, p)
    assert str(r.first().created_at) == "2001-01-01 00:00:00" and r.first().tag_list == ["x", "y"]
    assert listing.search_bookmarks(r, "LAB", project="-Projects-p").count() == 1
    with pytest.raises(ValueError):
        listing.get_bookmark(r)


def test_index_gathers_words_without_an_exchange(spark, monkeypatch):
    """Words are grouped where a document is read: no row a word is exchanged, sorted or spilled."""
    texts = {"a": "b a B c a", "none": None, "odd": "...", "long": " ".join(f"w{i % 7}" for i in range(50)), "z": "é e É"}
    index = search.build_index(spark.createDataFrame(list(texts.items()), "id string, text string"), ["id"], "text")
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    got = {(r["id"], r["term"]): list(r["positions"]) for r in index.postings.collect()}
    want: dict = {}
    for key, text in texts.items():
        for i, t in enumerate(search.query_terms(text or "")):
            want.setdefault((key, t), []).append(i)
    assert got == want
    assert {r["id"]: r["doc_len"] for r in index.docs.collect()} == {"a": 5, "none": 0, "odd": 0, "long": 50, "z": 3}
    # and in whatever shares a batch is taken
    docs = pa.RecordBatch.from_pydict({"id": list(texts), "digest": list(range(5)), "tokens": [search.query_terms(t or "") for t in texts.values()]}, schema=pa.schema([("id", pa.string()), ("digest", pa.int64()), ("tokens", pa.list_(pa.string()))]))
    for words in (1, 4, 1000):
        monkeypatch.setattr(search, "WORDS_AT_ONCE", words)
        rows = [r for b in search._gathered(iter([docs.slice(0, 2), docs.slice(2), docs.slice(0, 0)])) for r in b.to_pylist()]
        assert {(r["id"], r["term"]): r["positions"] for r in rows if r["term"] is not None} == want
        assert sorted(r["id"] for r in rows if r["term"] is None) == ["none", "odd"]


def test_snippet_takes_a_text_apart_once(spark):
    df = spark.createDataFrame([("one two three four",)], "text string").select(search.snippet(F.col("text"), F.lit(1), 1, around=2).alias("s"))
    assert df.first()["s"] == "...>>>two<<< three..."
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
