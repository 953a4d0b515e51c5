"""Chat formatting with minimum-cost role repair.

A legal conversation has an optional system turn, then user and assistant turns in alternation from user on, and ends with an assistant
turn. For every conversation dynamic programming over that automaton finds the cheapest way to read its turns legally: a turn may merge
into the one before it, change its role, or be preceded by an inserted empty turn. The repaired sequence is then rendered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import shuffle_partitions

#: Other names of the three roles, after trimming and lower-casing.
ROLES = {"system": "system", "developer": "system", "user": "user", "human": "user", "prompter": "user", "assistant": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
#: Legal successors; None stands for the start. A conversation may end after an assistant turn, or be empty.
NEXT = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


@dataclass(frozen=True)
class Costs:
    merge: int = 2
    relabel: int = 3
    insert: int = 4
    relabel_unknown: int = 1


@dataclass(frozen=True)
class Edit:
    """What happens to a turn: inserts come first, then it merges into the turn before or stands alone in a role."""

    inserts: tuple[str, ...]
    merges: bool
    role: str


def role_of(name: str | None) -> str | None:
    return ROLES.get((name or "").strip().lower())


def _paths() -> dict[tuple[str | None, str], tuple[str, ...]]:
    """Shortest runs of empty turns that lead from a role to where another may follow."""
    out: dict[tuple[str | None, str], tuple[str, ...]] = {}
    for start in NEXT:
        edge: list[tuple[str, ...]] = [()]
        for _ in range(4):
            new = []
            for path in edge:
                last = path[-1] if path else start
                for role in NEXT[last]:
                    if (start, role) not in out:
                        out[start, role] = path
                    new.append((*path, role))
            edge = new
    return out


PATHS = _paths()


def repair(roles: list[str | None], costs: Costs = Costs()) -> tuple[int, list[Edit], tuple[str, ...]]:
    """Least cost, an edit for each turn, and the empty turns after the last.

    Ties: the first of merge, keep or relabel in the order system, user, assistant, and the state that comes first in that order.
    """
    order = ("system", "user", "assistant")
    best: dict[str | None, int] = {None: 0}
    back: list[dict[str, tuple[str | None, Edit]]] = []
    for role in roles:
        now: dict[str, int] = {}
        how: dict[str, tuple[str | None, Edit]] = {}
        for before in (None, *order):
            if before not in best:
                continue
            options = []
            if before is not None:
                options.append((costs.merge + (0 if role == before else costs.relabel_unknown if role is None else costs.relabel), before, Edit((), True, before)))
            for to in order:
                if (before, to) in PATHS:
                    path = PATHS[before, to]
                    change = 0 if role == to else costs.relabel_unknown if role is None else costs.relabel
                    options.append((costs.insert * len(path) + change, to, Edit(path, False, to)))
            for cost, to, edit in options:
                if to not in now or best[before] + cost < now[to]:
                    now[to], how[to] = best[before] + cost, (before, edit)
        best = now
        back.append(how)
    if not roles:
        return 0, [], ()
    ends = {"assistant": (), "user": ("assistant",), "system": ("user", "assistant")}
    last = min((r for r in order if r in best), key=lambda r: best[r] + costs.insert * len(ends[r]))
    cost, state, edits = best[last] + costs.insert * len(ends[last]), last, []
    for how in reversed(back):
        before, edit = how[state]
        edits.append(edit)
        state = before
    return cost, edits[::-1], ends[last]


def repaired(turns: list[tuple[str | None, str | None]], costs: Costs = Costs()) -> tuple[int, list[tuple[str, str]]]:
    """Cost and the legal sequence of (role, text); merged texts are joined by a line feed."""
    cost, edits, after = repair([role_of(r) for r, _ in turns], costs)
    out: list[tuple[str, list[str]]] = []
    for (_, text), edit in zip(turns, edits, strict=True):
        out += [(r, []) for r in edit.inserts]
        if not edit.merges:
            out.append((edit.role, []))
        out[-1][1].append(text or "")
    return cost, [(r, "\n".join(parts)) for r, parts in out] + [(r, "") for r in after]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def format_chats(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, n_out, cost, rendered.

    Turns are read in order of turn (null first), then role and text, so ties and repeated rows have one order; a null role or an unknown
    one can become any role cheaply; null text is empty. Every row with a null conv_id is a conversation of its own. Turns are dealt and
    sorted by conversation and streamed, so a task holds one conversation at a time. An empty table gives no rows; other columns are not
    looked at.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    deal = F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))
    dealt = rows.repartition(shuffle_partitions(turns.sparkSession), deal).sortWithinPartitions(*(F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")))

    def finish(conv_id, own: list) -> tuple:
        cost, out = repaired(own, costs)
        return conv_id, len(own), len(out), cost, render(out)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "n_out", "cost", "rendered"]
        current, own, out = None, [], []
        for pdf in batches:
            ids = pdf["conv_id"].astype("Int64")
            for conv_id, role, text in zip(ids, pdf["role"], pdf["text"], strict=True):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if own and (conv_id is None or conv_id != current):
                    out.append(finish(current, own))
                    own = []
                current = conv_id
                own.append((role, text))
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
                out = []
        if own:
            yield pd.DataFrame([finish(current, own)], columns=names).astype({"conv_id": "Int64"})

    return dealt.mapInPandas(work, "conv_id long, n_turns long, n_out long, cost long, rendered string")


def op3(turns: DataFrame) -> DataFrame:
    return format_chats(turns)
