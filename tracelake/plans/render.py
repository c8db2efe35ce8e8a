"""Session logs rendered from the driver's tables, so that the real parser has real work.

``events`` become user and assistant records, ``pages`` become attachments, system events,
summaries and noise.  All is integer arithmetic on the ids, so that SQL over the tables can
say what the parsed logs must hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _s(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def render_events(events: DataFrame) -> DataFrame:
    """path, off, line."""
    i, u, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("prev", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")))
    k = F.col("k")
    file = _s("/src/f", k % 20, ".py")
    calls = {
        "purchase": ("Write", _json(file_path=file, content=_s("v", i, " x"))),
        "click": ("Edit", _json(file_path=file, old_string=F.lit("x"), new_string=_s("x", i))),
        "view": ("Read", _json(file_path=file)),
        "signup": ("Bash", _json(command=_s('git add -A && git commit -m "c', i, '"'))),
        "error": ("Bash", _json(command=_s("rm ", file))),
    }
    name, arg = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (tool, made) in calls.items():
        name, arg = F.when(et == kind, tool).otherwise(name), F.when(et == kind, made).otherwise(arg)
    # inputs differ in their fields: parsed as variants they stay JSON objects
    base = dict(
        uuid=_s("e", i),
        timestamp=F.date_format(F.col("ts").cast("timestamp"), ISO),
        sessionId=_s("s", u),
        version=_s("1.0.", u % 5),
        cwd=_s("/Projects/p", u % 10),
        parentUuid=F.when(F.col("prev").isNotNull(), _s("e", F.col("prev"))),
        isSidechain=F.lit(False),
        userType=F.lit("external"),
        gitBranch=F.lit("main"),
        agentId=F.when(i % 30 == 7, _s("g", u % 20)),
    )
    blocks = F.array(
        F.struct(F.lit("text").alias("type"), _s("did ", et, " ", i).alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.parse_json(F.lit(None).cast("string")).alias("input")),
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), _s("t", i).alias("id"), name.alias("name"), F.parse_json(arg).alias("input")),
    )
    usage = F.struct(F.floor("value").cast("long").alias("input_tokens"), k.alias("output_tokens"), F.when(i % 4 == 0, k % 7).alias("cache_read_input_tokens"))
    assistant = _json(type=F.lit("assistant"), **base, message=F.struct(_s("msg", i).alias("id"), F.lit("assistant").alias("role"), _s("m", i % 3).alias("model"), blocks.alias("content"), F.lit("tool_use").alias("stop_reason"), usage.alias("usage")))
    result = F.to_json(F.array(F.struct(F.lit("tool_result").alias("type"), _s("t", i - 1).alias("tool_use_id"), _s("res ", i).alias("content"), (et == "error").alias("is_error"))))
    content = F.parse_json(F.when(i % 10 == 3, F.to_json(F.array(_s("say ", et, " ", i)))).otherwise(result))
    content = F.when(i % 10 == 3, F.try_variant_get(content, "$[0]", "variant")).otherwise(content)
    user = _json(
        type=F.when(i % 101 == 1, "mystery").otherwise("user"),
        **base,
        message=F.struct(F.lit("user").alias("role"), content.alias("content")),
        isCompactSummary=F.when(i % 97 == 1, F.lit(True)),
        planContent=F.when(i % 89 == 1, _s("plan ", et, " ", i)),
        brandNew=F.when(i % 50 == 1, F.struct(i.alias("n"))),
    )
    return e.select(_s("/logs/p", u % 10, "/s", u, ".jsonl").alias("path"), i.alias("off"), F.when(i % 2 == 0, assistant).otherwise(user).alias("line"))


def render_pages(pages: DataFrame) -> DataFrame:
    """path, off, line: attachments of each subtype, and every seventh page a record of another kind."""
    p, url = F.col("page_id"), F.col("url")
    base = dict(
        uuid=_s("a", p),
        timestamp=F.date_format(F.timestamp_seconds(F.lit(1767225600) + p * 60), ISO),
        sessionId=_s("s", p % 150),
        version=F.when(p % 5 > 0, _s("1.0.", p % 5)),
        cwd=_s("/Projects/p", p % 10),
    )
    versioned = base | {"version": _s("1.0.", p % 5)}
    tool = _s("t", p * 2)
    bodies = [
        _json(type=F.lit("hook_success"), hookName=F.lit("lint"), hookEvent=F.lit("PostToolUse"), toolUseID=tool, exitCode=p % 3, durationMs=p, stdout=url, stderr=F.lit(""), command=F.lit("make lint")),
        _json(type=F.lit("hook_permission_decision"), hookEvent=F.lit("PreToolUse"), toolUseID=tool, decision=F.when(p % 4 == 1, "deny").otherwise("allow")),
        _json(type=F.lit("mcp_instructions_delta"), addedNames=F.array(F.lit("x")), addedBlocks=F.array(_s("block one ", url), _s("block two ", url)), removedNames=F.array(F.lit("y"))),
        _json(type=F.lit("skill_listing"), content=_s("skills of page ", p, " at ", url)),
        _json(type=F.lit("edited_text_file"), filename=_s("/src/f", p % 20, ".py"), snippet=_s("snippet of page ", p)),
        _json(type=F.lit("nested_memory"), path=F.lit("/m"), content=F.struct(F.lit("/m").alias("path"), F.lit("User").alias("type"), _s("memory of page ", p).alias("content"))),
        _json(type=F.lit("mood_ring"), value=p),
    ]
    body = F.element_at(F.array(*bodies), (p % 7 + 1).cast("int"))
    attachment = _json(type=F.lit("attachment"), **base, entrypoint=F.lit("cli"), attachment=F.parse_json(body), oddField=F.when(p % 11 == 0, p))
    others = [
        _json(type=F.lit("system"), **versioned, subtype=F.lit("turn_duration"), durationMs=p, hookCount=F.when(p % 2 == 0, F.lit(2)), retryInMs=p),
        _json(type=F.lit("summary"), summary=_s("summary of page ", p), leafUuid=_s("e", p)),
        _json(type=F.lit("queue-operation"), operation=F.lit("enqueue"), timestamp=base["timestamp"], sessionId=base["sessionId"], priority=F.lit(1)),
        _json(type=F.lit("progress"), **versioned, data=F.struct(p.alias("step")), pct=p),
        _json(type=F.lit("file-history-snapshot"), messageId=_s("e", p), snapshot=F.struct(p.alias("n")), isSnapshotUpdate=F.lit(False), flavour=F.lit("f")),
        F.concat(F.lit('{"type": "user", "this is broken '), p.cast("string")),
    ]
    other = F.element_at(F.array(*others), (F.floor(p / 8) % 6 + 1).cast("int"))
    return pages.select(_s("/logs/pages/s", p % 150, ".jsonl").alias("path"), p.alias("off"), F.when(p % 8 == 3, other).otherwise(attachment).alias("line"))


def render_bookmarks(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bookmarks and projects tables as an app would store them."""
    p = F.col("page_id")
    bookmarks = pages.select(
        p.alias("id"), (p % 10).alias("project_id"), _s("s", p % 150).alias("session_id"), _s("e", p * 2 + 1).alias("user_uuid"), _s("e", p * 2).alias("assistant_uuid"), F.col("url").alias("label"), F.to_json(F.array(_s("tag", p % 3), F.lit("kept"))).alias("tags"), (p * 1000).alias("created")
    )
    n = p % 10
    projects = pages.select(n.alias("id"), _s("/Projects/p", n).alias("path"), _s("-Projects-p", n).alias("encoded_name")).distinct()
    return bookmarks, projects
