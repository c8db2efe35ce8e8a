"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in turn,
and ends with the assistant.  For each source turn the repair keeps or changes its role,
and joins it to the open turn of the same role, opens a new turn, or first inserts an empty
one.  Dynamic programming over the automaton's states (nothing yet, system, user,
assistant) finds the cheapest sequence of choices.  The costs of a stretch of turns form a
small matrix, and stretches multiply (min, +): a conversation larger than a stretch is cut by
range partitioning, its stretches' matrices give each the states at its ends, and all stretches
are then repaired side by side.  Other conversations are dealt whole, many to a stretch.

Between two turns of one role the cheaper of joining them and inserting an empty turn is taken.

Nulls: a null text is empty; a null or unknown role always counts as changed.  Rows without
a conversation id form a conversation of their own, apart from one whose id is an empty text.  Turns go by turn (nulls first), role,
text; ties between equal rows don't matter.  Repeated rows are turns like others.  Ties
between repairs go to the state named first.  An empty table gives no rows.  Extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import discard, materialize, pieces_of, text_bytes

#: States in order; the first is the state before any turn.
STATES = ("", "system", "user", "assistant")
MERGE, INSERT, RELABEL = 1, 2, 3
_NO = 10**9
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
Link = tuple[int, tuple[int, ...], bool]


def links(merge: int = MERGE, insert: int = INSERT) -> dict[tuple[int, int], Link]:
    """What going from an open state to a turn of a role takes at least: cost, empty roles inserted before, whether it joins the open turn."""
    choices: dict[tuple[int, int], list[Link]] = {
        (_START, _SYSTEM): [(0, (), False)],
        (_START, _USER): [(0, (), False)],
        (_START, _ASSISTANT): [(insert, (_USER,), False)],
        (_SYSTEM, _SYSTEM): [(merge, (), True)],
        (_SYSTEM, _USER): [(0, (), False)],
        (_SYSTEM, _ASSISTANT): [(insert, (_USER,), False)],
        (_USER, _USER): [(merge, (), True), (insert, (_ASSISTANT,), False)],
        (_USER, _ASSISTANT): [(0, (), False)],
        (_ASSISTANT, _USER): [(0, (), False)],
        (_ASSISTANT, _ASSISTANT): [(merge, (), True), (insert, (_USER,), False)],
    }
    return {k: min(v, key=lambda x: x[0]) for k, v in choices.items()}


@dataclass(frozen=True)
class Costs:
    """What a repair weighs: joining two turns of a role, inserting an empty turn, changing a role."""

    merge: int = MERGE
    insert: int = INSERT
    relabel: int = RELABEL

    @cached_property
    def links(self) -> dict[tuple[int, int], Link]:
        return links(self.merge, self.insert)

    @cached_property
    def ends(self) -> dict[int, tuple[int, tuple[int, ...]]]:
        """What ending in a state takes."""
        return {_START: (0, ()), _SYSTEM: (2 * self.insert, (_USER, _ASSISTANT)), _USER: (self.insert, (_ASSISTANT,)), _ASSISTANT: (0, ())}

    @cached_property
    def steps(self) -> dict[str | None, np.ndarray]:
        """For each known role, and None, the costs from state to state of a turn of that role."""
        out = {}
        for role in (*STATES[1:], None):
            out[role] = np.full((4, 4), _NO, np.int64)
            for (s, t), (cost, _, _) in self.links.items():
                out[role][s, t] = cost + self.relabel * (role != STATES[t])
        return out

    def step(self, role: str | None) -> np.ndarray:
        return self.steps.get(role, self.steps[None])

    @cached_property
    def ending(self) -> np.ndarray:
        return np.array([self.ends[s][0] for s in range(4)])


USUAL = Costs()


def stretch_costs(roles: list[str | None], costs: Costs = USUAL) -> np.ndarray:
    """The cheapest repair of a stretch from each state to each state."""
    total = np.full((4, 4), _NO, np.int64)
    np.fill_diagonal(total, 0)
    for r in roles:
        total = np.minimum((total[:, :, None] + costs.step(r)[None]).min(axis=1), _NO)
    return total


def repair_stretch(roles: list[str | None], enter: int, leave: int | None, costs: Costs = USUAL) -> list[int]:
    """The state after each turn, from ``enter`` to ``leave``; None: to the conversation's end."""
    cost, back = np.full(4, _NO, np.int64), []
    cost[enter] = 0
    for r in roles:
        through = cost[:, None] + costs.step(r)
        back.append(through.argmin(axis=0))
        cost = np.minimum(through.min(axis=0), _NO)
    if leave is None:
        leave = int((cost + costs.ending).argmin())
    states = []
    for b in reversed(back):
        states.append(leave)
        leave = int(b[leave])
    return states[::-1]


def _edges(rows: pd.DataFrame, costs: Costs = USUAL) -> pd.DataFrame:
    """The matrices of the first and last conversation of a stretch: only these can go on in others."""
    rows = rows.sort_values(["n"], ignore_index=True)
    out = []
    for c in rows["conv"].iloc[[0, -1]].unique():
        roles = rows["role"][rows["conv"] == c].tolist()
        out.append((c, int(rows["seg"].iloc[0]), [int(x) for x in stretch_costs(roles, costs).ravel()]))
    return pd.DataFrame(out, columns=["conv", "seg", "costs"])


def _states(edges: pd.DataFrame, costs: Costs = USUAL) -> pd.DataFrame:
    """For one conversation its stretches' states: where each is entered and left."""
    edges = edges.sort_values("seg", ignore_index=True)
    cost, back = np.full(4, _NO, np.int64), []
    cost[_START] = 0
    for c in edges["costs"]:
        through = cost[:, None] + np.asarray(c, np.int64).reshape(4, 4)
        back.append(through.argmin(axis=0))
        cost = np.minimum(through.min(axis=0), _NO)
    leave = int((cost + costs.ending).argmin())
    out = []
    for i in reversed(range(len(edges))):
        enter = int(back[i][leave])
        out.append((edges["conv"].iloc[i], int(edges["seg"].iloc[i]), enter, leave, i == len(edges) - 1))
        leave = enter
    return pd.DataFrame(out, columns=["conv", "seg", "enter", "leave", "last"])


def _opened(role: int, text: str, after: int) -> str:
    return ("<|end|>\n" if after != _START else "") + f"<|{STATES[role]}|>\n{text}"


def repair_turns(roles: list[str | None], texts: list[str], enter: int = _START, leave: int | None = None, last: bool = True, costs: Costs = USUAL) -> list[tuple]:
    """For each row of the result: source turn's place in the stretch, step, role, action, cost, fragment.
    The fragments one after another are the rendered conversation."""
    out, at = [], enter
    for i, (r, text, to) in enumerate(zip(roles, texts, repair_stretch(roles, enter, leave, costs), strict=True)):
        _, empty, joins = costs.links[at, to]
        for step, e in enumerate(empty):
            out.append((i, step, STATES[e], "insert", costs.insert, _opened(e, "", at)))
            at = e
        changed = r != STATES[to]
        action = ("relabel+" if changed else "") + ("merge" if joins else "keep")
        out.append((i, len(empty), STATES[to], action, costs.relabel * changed + costs.merge * joins, ("\n\n" + text) if joins else _opened(to, text, at)))
        at = to
    if last and roles:
        for e in costs.ends[at][1]:
            out.append((len(roles) - 1, out[-1][1] + 1, STATES[e], "insert", costs.insert, _opened(e, "", at)))
            at = e
        out[-1] = (*out[-1][:5], out[-1][5] + "<|end|>\n")
    return out


def _repairer(rows: pd.DataFrame, states: pd.DataFrame, costs: Costs = USUAL) -> pd.DataFrame:
    rows = rows.sort_values("n", ignore_index=True)
    known = {c: (int(a), int(b), bool(x)) for c, a, b, x in zip(states["conv"], states["enter"], states["leave"], states["last"])}
    out = []
    conv, turn, role, text = (rows[c].tolist() for c in ("conv", "turn", "role", "text"))
    lo = 0
    while lo < len(conv):
        hi = lo + 1
        while hi < len(conv) and conv[hi] == conv[lo]:
            hi += 1
        enter, leave, last = known.get(conv[lo], (_START, None, True))
        out += [(conv[lo], turn[lo + i], *rest, lo + i) for i, *rest in repair_turns(role[lo:hi], text[lo:hi], enter, leave, last, costs)]
        lo = hi
    found = pd.DataFrame(out, columns=["conv", "turn", "step", "role", "action", "cost", "fragment", "n"])
    found["turn"] = found["turn"].astype("Int64")
    found["place"] = (int(rows["seg"].iloc[0]) << 40) + found.pop("n") if len(rows) else pd.Series([], dtype="int64")
    return found


def repair(conversations: DataFrame, *, stretch_bytes: int = 16 << 20, merge: int = MERGE, insert: int = INSERT, relabel: int = RELABEL) -> DataFrame:
    """conv_id, turn, place (order of the source turns), step, role, action, cost, fragment."""
    ship(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    costs, order = Costs(merge, insert, relabel), ["conv", "turn", "role", "text"]
    sizes = materialize(rows.groupBy("conv").agg(F.sum(F.octet_length("text")).alias("size")).filter(F.col("size") > stretch_bytes).select("conv", "size"), "long")
    long = rows.join(sizes.select("conv"), "conv", "left_semi").repartitionByRange(pieces_of(sizes.agg(F.sum("size")).first()[0] or 0, stretch_bytes), "conv", "turn", "role", F.xxhash64("text"))
    whole = rows.join(sizes.select("conv"), "conv", "left_anti").repartition(pieces_of(text_bytes(conversations), stretch_bytes), "conv")
    cut = whole.sortWithinPartitions(*order).unionByName(long.sortWithinPartitions(*order))
    table = materialize(cut.select("*", F.spark_partition_id().alias("seg"), F.monotonically_increasing_id().alias("n")), "turns")
    discard(sizes)
    edges = table.select("conv", "role", "seg", "n").groupBy("seg").applyInPandas(lambda x: _edges(x, costs), "conv string, seg int, costs array<long>")
    edges = materialize(edges, "edges")
    shared = edges.groupBy("conv").count().filter("count > 1").select("conv")
    states = edges.join(shared, "conv", "left_semi").groupBy("conv").applyInPandas(lambda x: _states(x, costs), "conv string, seg int, enter int, leave int, last boolean")
    out = table.groupBy("seg").cogroup(states.groupBy("seg")).applyInPandas(lambda x, y: _repairer(x, y, costs), "conv string, turn long, step int, role string, action string, cost long, fragment string, place long")
    key = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(kind)
    return out.select(key.alias("conv_id"), "turn", "place", "step", "role", "action", "cost", "fragment")


def render(repaired: DataFrame) -> DataFrame:
    """conv_id, part, turns (of the repaired sequence), inserted, relabelled, merged, cost, text: each conversation's rendered text.

    A conversation that runs over several stretches has a part for each, in order; none is larger than a stretch.
    """
    part = F.shiftright("place", 40).cast("int").alias("part")
    parts = F.array_sort(F.collect_list(F.struct("place", "step", "fragment")))

    def of(*actions: str):
        return F.count_if(F.col("action").isin(*actions))

    return repaired.groupBy("conv_id", part).agg(
        of("keep", "relabel+keep", "insert").alias("turns"),
        of("insert").alias("inserted"),
        of("relabel+keep", "relabel+merge").alias("relabelled"),
        of("merge", "relabel+merge").alias("merged"),
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(parts, lambda p: p["fragment"]), "").alias("text"),
    )
