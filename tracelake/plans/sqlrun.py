"""Read-only SQL over the tables, and named queries with parameters."""

from __future__ import annotations

import re
import threading
import tomllib
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import delete, shared_dir

CANNED = Path(__file__).parent / "canned"
SILVER = "sessions projects agents messages message_content token_usage tool_executions system_events summaries attachments hook_executions file_operations git_operations files schema_drift record_type_drift".split()


class NotReadOnly(ValueError):
    """The text is not one query over the registered views."""


class TooSlow(TimeoutError):
    """The query took longer than it may."""


_VIEWS: dict[str, set[str]] = {}


def _views(spark: SparkSession) -> set[str]:
    return _VIEWS.setdefault(spark._jsparkSession.sessionUUID(), set())


def register(tables, spark: SparkSession, names: list[str] = SILVER) -> None:
    """The tables as temporary views: what read-only SQL of this session may read."""
    for n in names:
        getattr(tables, n).createOrReplaceTempView(n)
        _views(spark).add(n.lower())


# What a query may consist of, by Spark's names of the nodes of a plan, parsed and analysed.
PARSED_NODES = set(
    """Project Filter UnresolvedHaving Join LateralJoin Aggregate Sort GlobalLimit LocalLimit Offset Distinct SubqueryAlias UnresolvedRelation
    UnresolvedInlineTable ResolvedInlineTable LocalRelation OneRowRelation Union Except Intersect UnresolvedWith WithWindowDefinition Window Generate
    Pivot Unpivot UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedHint Sample NameParameterizedQuery PosParameterizedQuery""".split()
)
ANALYSED_NODES = set(
    """Project Filter Join LateralJoin Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate SubqueryAlias Union Except Intersect WithCTE
    CTERelationDef CTERelationRef UnionLoop UnionLoopRef Window Generate Expand Sample ResolvedHint Repartition RepartitionByExpression RebalancePartitions LocalRelation OneRowRelation Range""".split()
)
#: Names that are settled by analysis.  Others, as IDENTIFIER('...'), could name anything.
SETTLED_LATER = set(
    """UnresolvedAlias UnresolvedAttribute UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedRegex UnresolvedFunction UnresolvedGenerator UnresolvedExtractValue UnresolvedOrdinal
    UnresolvedNamedLambdaVariable UnresolvedWindowExpression UnresolvedWindowOrdering UnresolvedInlineTable""".split()
)
#: Spark's groups of functions that only compute; of the others those that are named.
PURE_GROUPS = {f"{g}_funcs" for g in "math agg generator datetime array string map predicate bitwise variant window json conversion lambda conditional csv url hash struct collection".split()}
PURE = {"typeof", "monotonically_increasing_id", "uuid", "range"}
IMPURE = {"sql_keywords", "collations"}
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
RUNS_CODE = re.compile(r"Reflect|Invoke|UDF|UDAF|UDTF|UserDefined|NewInstance|Aggregator|InputFile")


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _is(spark: SparkSession, x, name: str) -> bool:
    return spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{name}").isInstance(x)


def _pure(spark: SparkSession, parts: list[str]) -> bool:
    """Whether a function is one of Spark's own that only compute."""
    if len(parts) != 1:
        return False
    state, name = spark._jsparkSession.sessionState(), parts[0].lower()
    if name in PURE:
        return True
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    for registry in (state.functionRegistry(), state.tableFunctionRegistry()):
        found = registry.lookupFunction(identifier)
        if found.isDefined() and found.get().getSource() == "built-in" and found.get().getGroup() in PURE_GROUPS and name not in IMPURE:
            return True
    return False


def _name(x) -> list[str]:
    """The parts of the name of what a parsed plan calls."""
    kind = x.getClass().getSimpleName()
    return _all(x.nameParts()) if kind == "UnresolvedFunction" else [x.name().funcName()] if kind == "UnresolvedGenerator" else _all(x.name())


def _check(spark: SparkSession, text: str) -> bool:
    """Decided on the plan of Spark's parser, before anything is looked up: one query, of nodes that only read, over registered views and
    its own WITH parts, with functions that only compute.  Whether there is a query to analyse (EXPLAIN has none)."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    explained = plan.getClass().getSimpleName() == "ExplainCommand"
    todo, names, own = [plan.logicalPlan() if explained else plan], [], set()
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind not in PARSED_NODES:
            raise NotReadOnly(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            names.append(_all(p.multipartIdentifier()))
        elif kind == "UnresolvedWith":
            own |= {x.alias().lower() for x in _all(p.innerChildren())}
        elif kind == "UnresolvedTableValuedFunction" and not _pure(spark, _name(p)):
            raise NotReadOnly(f"the function {'.'.join(_name(p))} is not allowed")
        todo += _all(p.children()) + _all(p.subqueries()) + [x for x in _all(p.innerChildren()) if _is(spark, x, "plans.logical.LogicalPlan")]
        parts = _all(p.expressions())
        while parts:
            e = parts.pop()
            kind = e.getClass().getSimpleName()
            if "Unresolved" in kind and kind not in SETTLED_LATER:
                raise NotReadOnly(f"{kind} is not allowed")
            if kind in ("UnresolvedFunction", "UnresolvedGenerator") and not _pure(spark, _name(e)):
                raise NotReadOnly(f"the function {'.'.join(_name(e))} is not allowed")
            parts += _all(e.children())
    for n in names:
        if len(n) != 1 or n[0].lower() not in own | _views(spark):
            raise NotReadOnly(f"{'.'.join(n)} is not one of the views")
    return not explained


def _check_analysed(spark: SparkSession, df: DataFrame) -> None:
    """Decided on the analysed plan: its leaves are registered views or literals, and its expressions Spark's own that run no other code."""
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "View":
            if not p.isTempView() or p.desc().identifier().table().lower() not in _views(spark):
                raise NotReadOnly(f"{p.desc().identifier().table()} is not one of the views")
            continue  # what a registered view is made of is its owner's
        if kind not in ANALYSED_NODES:
            raise NotReadOnly(f"{kind} is not allowed in a query")
        todo += _all(p.children()) + _all(p.subqueries())
        parts = _all(p.expressions())
        while parts:
            e = parts.pop()
            kind = e.getClass().getName()
            if not kind.startswith(EXPRESSIONS) or kind.startswith(EXPRESSIONS + "objects.") or RUNS_CODE.search(kind):
                raise NotReadOnly(f"{e.getClass().getSimpleName()} is not allowed in a query")
            # of functions that Spark rewrites, what they were given
            parts += _all(e.parameters() if _is(spark, e, "expressions.InheritAnalysisRules") else e.children())


def within(df: DataFrame, seconds: float) -> DataFrame:
    """``df``, computed and stored in the shared folder in so many seconds, else its jobs are cancelled."""
    spark = df.sparkSession
    context, tag, path = spark.sparkContext, f"within-{uuid.uuid4().hex}", f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"
    late, done = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
            while not done.wait(0.2):  # a query may be between two jobs
                context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        df.write.parquet(path)
    except Exception as e:
        delete(spark, path)
        if late.is_set():
            raise TooSlow(f"stopped after {seconds:g} s") from e
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
    return spark.read.schema(df.schema).parquet(path)


def sql_readonly(spark: SparkSession, text: str, args: dict | list | None = None, *, seconds: float | None = None) -> DataFrame:
    """One SELECT, WITH or EXPLAIN with typed parameters, over the registered views alone.  With ``seconds`` it is run at once and stopped
    (``TooSlow``) if it takes longer."""
    text = text.strip().rstrip(";")
    query = _check(spark, text)
    df = spark.sql(text, args=args) if args else spark.sql(text)
    if query:
        _check_analysed(spark, df)
    return df if seconds is None else within(df, seconds)


def jsonable(df: DataFrame) -> DataFrame:
    """Booleans as 0 and 1, binaries as hexadecimal."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.select(*[F.col(f"`{c}`").cast("int").alias(c) if k == "boolean" else F.hex(f"`{c}`").alias(c) if k == "binary" else F.col(f"`{c}`") for c, k in kinds.items()])


@dataclass
class Canned:
    name: str
    sql: str
    description: str = ""
    params: dict[str, dict] = field(default_factory=dict)


def parameters(sql: str) -> list[str]:
    """The :names outside quotes and comments, in order."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    return list(dict.fromkeys(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", bare)))


def load_canned(folder: Path = CANNED) -> dict[str, Canned]:
    out = {}
    for f in sorted(Path(folder).glob("*.sql")):
        sql, more = f.read_text(), {}
        if (t := f.with_suffix(".toml")).exists():
            more = tomllib.loads(t.read_text())
        told = {p["name"]: p for p in more.get("params", [])}
        out[f.stem] = Canned(f.stem, sql, more.get("description", ""), {n: told.get(n, {"name": n}) for n in parameters(sql)})
    return out


def _typed(value, kind: str):
    return {"integer": int, "real": float, "text": str}[kind](value)


def run_canned(spark: SparkSession, name: str, params: dict | None = None, folder: Path = CANNED, *, seconds: float | None = None) -> DataFrame:
    """A named query; a parameter is the value given, else its default, else an error."""
    found = load_canned(folder)
    if name not in found:
        raise KeyError(f"no query {name!r}; there are {', '.join(found)}")
    q, args = found[name], {}
    for n, p in q.params.items():
        if params and n in params:
            value = params[n]
        elif "default" in p:
            value = p["default"]
        else:
            raise ValueError(f"query {name!r} needs a value for {n}")
        args[n] = _typed(value, p.get("type", "text"))
    return sql_readonly(spark, q.sql, args, seconds=seconds)
