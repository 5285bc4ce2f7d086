"""Conversation repair: faults of turns, and the cheapest edits that give a legal order of roles.

A legal conversation has the role initials ``(s?(ua)+)?``.  A persistent audit DP walks the turns of
a segment with one cheapest prefix of edits per automaton state.  Prefixes are linked nodes that
share their beginnings; each node has binary-lifting ancestors and a rolling hash, by which two
prefixes of equal cost are compared at the end of their longest common prefix.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atoflow.llm.common import shared_table
from atoflow.llm.ranges import SEGMENT_CHARS, SEGMENT_ROWS, digests, group_key, segments, tie

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a user or assistant turn is put in (the state tells which), and role of that turn.
STEP = (USER, USER, ASSISTANT, USER)
ROLES = ("", "", "user", "assistant")
#: Cost and inserts from each state to a legal end.
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
FAR = 1 << 60
BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT = 1, 2, 3
#: Segments that one group of a scan combines.
FAN = 1024
_SAID = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")


def keep_state(state: int, initial: str) -> int:
    """State after a turn of this role is kept, or -1."""
    if initial == "s":
        return SYSTEM if state == START else -1
    if initial == "u":
        return USER if state != USER else -1
    return ASSISTANT if initial == "a" and state == USER else -1


class Audits:
    """Edit prefixes as linked nodes; equal prefixes are one node, node 0 is the empty one."""

    def __init__(self, modulus: int = (1 << 61) - 1, base: int = 911_382_323):
        self.modulus, self.base = modulus, base
        self.char, self.depth, self.hash, self.up, self.made = [""], [0], [0], [[]], {}

    def extend(self, node: int, edit: str) -> int:
        found = self.made.get((node, edit))
        if found is None:
            found = self.made[node, edit] = len(self.char)
            self.char.append(edit)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * self.base + ord(edit)) % self.modulus)
            up, j = [node], 0
            while j < len(self.up[up[j]]):
                up.append(self.up[up[j]][j])
                j += 1
            self.up.append(up)
        return found

    def ancestor(self, node: int, depth: int) -> int:
        go = self.depth[node] - depth
        while go:
            j = go.bit_length() - 1
            node = self.up[node][j]
            go -= 1 << j
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether the edits of ``a`` come before those of ``b`` in ASCII order."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            # equal prefixes are the same node, so another node means that the hashes collide
            return self.depth[a] < self.depth[b] if x == y else self.text(a) < self.text(b)
        for j in range(len(self.up[x]) - 1, -1, -1):
            if j < len(self.up[x]) and self.hash[self.up[x][j]] != self.hash[self.up[y][j]]:
                x, y = self.up[x][j], self.up[y][j]
        if self.up[x][0] != self.up[y][0]:
            return self.text(a) < self.text(b)
        return self.char[x] < self.char[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def moves(state: int, initial: str, kind: int) -> list[tuple[str, int, int]]:
    """Edits of one turn in a state: edit, cost, next state."""
    out = [("D", DELETE, state)]
    if kind not in (BLANK_FAULT, DUPLICATE_FAULT):
        more = TRUNCATED if kind == TRUNCATED_FAULT else 0
        kept = keep_state(state, initial)
        if kept >= 0:
            out.append(("K", KEEP + more, kept))
        out.append(("R", REROLE + more, STEP[state]))
    return out


def _best(best: list, state: int, cost: int, node: int, audits: Audits) -> None:
    held = best[state]
    if held is None or cost < held[0] or cost == held[0] and audits.less(node, held[1]):
        best[state] = (cost, node)


def cheapest(initials: str, kinds: list[int], state: int = START, to_go: tuple = END, audits: Audits | None = None) -> tuple[str, int, int]:
    """(edits, cost, last state) of a segment that is entered in ``state``, when ``to_go`` are the
    costs behind it from each state.  Inserts stand before a turn; the edits end with a turn's own."""
    audits = audits or Audits()
    now: list = [None] * 4
    now[state] = (0, 0)
    for initial, kind in zip(initials, kinds):
        for _ in range(2):  # up to two turns put in before this one
            put = list(now)
            for s, held in enumerate(now):
                if held:
                    _best(put, STEP[s], held[0] + INSERT, audits.extend(held[1], "I"), audits)
            now = put
        then: list = [None] * 4
        for s, held in enumerate(now):
            if held:
                for edit, cost, to in moves(s, initial, kind):
                    _best(then, to, held[0] + cost, audits.extend(held[1], edit), audits)
        now = then
    end = None
    for s, held in enumerate(now):
        if held and (end is None or held[0] + to_go[s] < end[0]
                     or held[0] + to_go[s] == end[0] and audits.less(held[1], end[1])):
            end = (held[0] + to_go[s], held[1], s, held[0])
    return audits.text(end[1]), end[3], end[2]


#: Least cost of inserts from state to state.
_PUT = np.full((4, 4), FAR, np.int64)
for _s in range(4):
    _PUT[_s, _s] = 0
    _PUT[_s, STEP[_s]] = INSERT
    _PUT[_s, STEP[STEP[_s]]] = min(_PUT[_s, STEP[STEP[_s]]], 2 * INSERT)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-cost product of two tables of costs from state to state."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def cost_table(initials: str, kinds: list[int]) -> np.ndarray:
    """Least cost of a segment from each state to each state."""
    out, seen = None, {}
    for turn in zip(initials, kinds):
        one = seen.get(turn)
        if one is None:
            one = np.full((4, 4), FAR, np.int64)
            for s in range(4):
                for _, cost, to in moves(s, *turn):
                    one[s, to] = min(one[s, to], cost)
            one = seen[turn] = times(_PUT, one)
        out = one if out is None else times(out, one)
    return out


def apply_edits(roles: list[str], texts: list[str], edits: str, state: int) -> list[tuple[str, str]]:
    """Repaired (role, text) of a segment."""
    out, at = [], 0
    for e in edits:
        if e == "I":
            state = STEP[state]
            out.append((ROLES[state], ""))
            continue
        if e == "K":
            state = keep_state(state, roles[at][:1])
            out.append((roles[at], texts[at]))
        elif e == "R":
            state = STEP[state]
            out.append((ROLES[state], texts[at]))
        at += 1
    return out


def scan(items: DataFrame, backwards: bool = False, fan: int = FAN) -> DataFrame:
    """Per item ``(k, no, m)`` the product of the tables of the items before it (behind it): ``k, no, m``.

    ``no`` counts from 0 in each ``k``.  Groups of ``fan`` items are combined in a task, the groups'
    products by the same scan again, so no task reads more than ``fan`` items of a key.
    """
    total = items.agg(F.max("no")).first()[0]
    one = np.where(np.eye(4, dtype=bool), 0, FAR)
    cut = items.select("k", F.expr(f"no div {fan}").alias("g"), "no", "m")
    cut = cut.repartition("k", "g").sortWithinPartitions("k", "g", F.col("no").desc() if backwards else F.col("no").asc())

    def run(batches):
        last, acc = None, one
        for b in batches:
            ks, gs, nos, ms = (c.to_pylist() for c in b.columns)
            out = []
            for k, g, m in zip(ks, gs, ms):
                if (k, g) != last:
                    last, acc = (k, g), one
                out.append((acc, m))
                m = np.array(m, np.int64).reshape(4, 4)
                acc = times(m, acc) if backwards else times(acc, m)
                out[-1] = (out[-1][0].ravel().tolist(), acc.ravel().tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([x for x, _ in out], pa.list_(pa.int64())),
                 pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["k", "g", "no", "m", "upto"])

    local = cut.mapInArrow(run, "k string, g long, no long, m array<long>, upto array<long>")
    if total is None or total < fan:
        return local.select("k", "no", "m")
    local = shared_table(local, "scan")
    ends = local.groupBy("k", "g").agg((F.min_by if backwards else F.max_by)("upto", "no").alias("m"))
    outer = scan(ends.select("k", F.col("g").alias("no"), "m"), backwards, fan).select("k", F.col("no").alias("g"), F.col("m").alias("far"))
    row = lambda m, i, j: F.element_at(m, F.lit(1) + i * 4 + j)
    left, right = ("m", "far") if backwards else ("far", "m")
    cells = [F.least(*(row(F.col(left), F.lit(i), F.lit(x)) + row(F.col(right), F.lit(x), F.lit(j)) for x in range(4)), F.lit(FAR))
             for i in range(4) for j in range(4)]
    return local.join(outer, ["k", "g"]).select("k", "no", F.array(*cells).alias("m"))


@dataclass
class Repaired:
    """``conversations``: id, blank, duplicate, truncated, illegal, cost, audit.  ``parts``: k, seg, alone
    (its conversation has no other part) and ``lines``, the repaired (role, text) in order; one part per
    segment of a conversation."""

    conversations: DataFrame
    parts: DataFrame


def gaps(turns: DataFrame, key: Column, turn_col: str) -> DataFrame:
    """Turn numbers that a conversation lacks between its first and last: ``k, gaps``; nulls do not count."""
    return turns.groupBy(key.alias("k")).agg(
        F.coalesce(F.max(turn_col) - F.min(turn_col) + 1 - F.count_distinct(turn_col), F.lit(0)).cast("long").alias("gaps"))


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           size: int = SEGMENT_ROWS, most_chars: int = SEGMENT_CHARS, fan: int = FAN) -> Repaired:
    """Faults and cheapest repair of each conversation.

    Turns are taken by turn number (null first), equal numbers by a hash of role and text.  A turn's
    first fault counts: blank (only white space), duplicate (role and text stand earlier), truncated
    (does not end in ``.!?``).  Keep costs 0, Rerole 3, Delete 4 (a must for blank and duplicate),
    Insert of an empty turn 3, a truncated turn that stays 3 more; the cheapest edits are taken, of
    equal costs those whose initials come first in ASCII order.  Null roles and texts are empty, so
    a null text is blank; rows without id are one conversation; repeated rows are duplicates; extra
    columns are ignored; no turns give no rows.

    A conversation may have any number of turns: it is cut into bounded segments.  Tables of least
    costs between automaton states are combined by :func:`scan` from the end, so that each segment
    knows the costs behind it and its audit is settled inside it for every state that it may be
    entered in; a second scan tells which state that is.
    """
    rows = turns.select(group_key(id_col).alias("k"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                        F.coalesce(text_col, F.lit("")).alias("text"))
    ids = turns.groupBy(group_key(id_col).alias("k")).agg(F.first(id_col).alias("id"))
    cut = segments(rows, "k", [F.col("turn"), tie("role", "text")], ["role", "text"], ["role", "text"], "repair", size, most_chars)

    def look(batches):
        for b in batches:
            out = []
            for roles, texts in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                initials = [r[:1] or " " for r in roles]
                kinds, seen = [], set()
                for r, t in zip(roles, texts):
                    last = _LAST.search(t)
                    if last is None:
                        kinds.append(BLANK_FAULT)
                    elif (r, t) in seen:
                        kinds.append(DUPLICATE_FAULT)
                    else:
                        seen.add((r, t))
                        kinds.append(0 if last[0] in ".!?" else TRUNCATED_FAULT)
                illegal = sum(p + q not in ("su", "ua", "au") for p, q in zip(initials, initials[1:]))
                out.append(("".join(initials), kinds, illegal))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _, _ in out]), pa.array([x for _, x, _ in out], pa.list_(pa.int32())),
                 pa.array([x for *_, x in out], pa.int64())], names=["k", "seg", "initials", "kinds", "illegal"])

    seen = shared_table(cut.mapInArrow(look, "k string, seg long, initials string, kinds array<int>, illegal long"), "repair")
    long = shared_table(
        seen.groupBy("k").count().filter("count > 1").join(seen, "k").select(
            "k", "seg", (F.row_number().over(Window.partitionBy("k").orderBy("seg")) - 1).cast("long").alias("no"),
            F.substring("initials", 1, 1).alias("head"), F.lag(F.substring("initials", -1, 1)).over(Window.partitionBy("k").orderBy("seg")).alias("before")), "repair")
    seen = _seen_before(seen, cut, long)

    tables = long.join(seen.select("seg", "initials", "kinds"), "seg").select("k", "no", "initials", "kinds")

    def cost_rows(batches):
        for b in batches:
            ms = [cost_table(i, ks).ravel().tolist() for i, ks in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ms, pa.list_(pa.int64()))], names=["k", "no", "m"])

    costs = shared_table(tables.mapInArrow(cost_rows, "k string, no long, m array<long>"), "repair")
    ahead = scan(costs, backwards=True, fan=fan)
    to_go = [F.least(*(F.element_at("m", i * 4 + j + 1) + END[j] for j in range(4))) for i in range(4)]
    ahead = long.join(ahead, ["k", "no"]).select("seg", "no", F.array(*to_go).alias("to_go"))

    def audit(batches):
        for b in batches:
            out = []
            for initials, kinds, no, to in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                entries = range(4) if no else (START,)
                out.append([cheapest(initials, kinds, s, to or END) if s in entries else None for s in range(4)])
            text, ints = pa.list_(pa.string()), pa.list_(pa.int64())
            pick = lambda i, kind: pa.array([[x and x[i] for x in row] for row in out], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pick(0, text), pick(1, ints), pick(2, ints)],
                                             names=["k", "seg", "edits", "cost", "to"])

    ways = shared_table(seen.join(ahead, "seg", "left").select("k", "seg", "initials", "kinds", "no", "to_go").mapInArrow(
        audit, "k string, seg long, edits array<string>, cost array<long>, to array<long>"), "repair")
    # entering states: each segment as a table that allows one next state per state
    allowed = [F.when(F.element_at("to", i + 1) == j, F.lit(0)).otherwise(F.lit(FAR)).cast("long") for i in range(4) for j in range(4)]
    entered = scan(long.join(ways, ["k", "seg"]).select("k", "no", F.array(*allowed).alias("m")), fan=fan)
    entered = long.join(entered, ["k", "no"]).select(
        "seg", "no", F.coalesce(*(F.when(F.element_at("m", j + 1) < FAR, F.lit(j)) for j in range(4))).alias("state"))
    last = long.groupBy("k").agg(F.max("seg").alias("seg"), F.lit(True).alias("last"))
    way = ways.join(entered, "seg", "left").join(last, ["k", "seg"], "left").select(
        "k", "seg", F.coalesce("state", F.lit(START)).alias("state"), (F.col("no").isNull() | F.col("last").isNotNull()).alias("last"),
        F.col("no").isNull().alias("alone"), "edits", "cost", "to")
    at = lambda c: F.element_at(c, F.col("state") + 1)
    tail = lambda values: F.element_at(F.array(*map(F.lit, values)), (at("to") + 1).cast("int"))
    way = shared_table(way.select(
        "k", "seg", "state", "alone", F.concat(at("edits"), F.when(F.col("last"), tail(TAIL)).otherwise("")).alias("edits"),
        (at("cost") + F.when(F.col("last"), tail(END)).otherwise(0)).cast("long").alias("cost")), "repair")

    def mend(batches):
        line = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for b in batches:
            out = []
            for roles, texts, edits, state in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                out.append([{"role": r, "text": t} for r, t in apply_edits(roles, texts, edits, state)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(6), pa.array(out, line)], names=["k", "seg", "alone", "lines"])

    parts = shared_table(cut.join(way.select("seg", "edits", "state", "alone"), "seg").select(
        "k", "seg", "role", "text", "edits", "state", "alone").mapInArrow(
        mend, "k string, seg long, alone boolean, lines array<struct<role:string,text:string>>"), "repair")

    count = lambda kind: F.sum(F.size(F.filter("kinds", lambda x: x == kind))).cast("long")
    border = long.filter("before is not null").groupBy("k").agg(
        F.count_if(~F.concat("before", "head").isin("su", "ua", "au")).alias("border"))
    faults = seen.groupBy("k").agg(count(BLANK_FAULT).alias("blank"), count(DUPLICATE_FAULT).alias("duplicate"),
                                   count(TRUNCATED_FAULT).alias("truncated"), F.sum("illegal").alias("inner"))
    edits = way.groupBy("k").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("seg", "edits"))), lambda x: x["edits"]), "").alias("audit"))
    out = ids.join(faults, "k").join(border, "k", "left").join(edits, "k").select(
        F.col("id").alias(id_col), "k", "blank", "duplicate", "truncated",
        (F.col("inner") + F.coalesce("border", F.lit(0))).cast("long").alias("illegal"), "cost", "audit")
    return Repaired(out, parts)


def digest(done: Repaired) -> DataFrame:
    """SHA-256 of each repaired conversation's ``role:text`` lines, joined by line feeds: ``k, digest``.

    Conversations of one segment are digested where they are; only longer ones bring their segments
    together.  A conversation without repaired turns has the digest of nothing.
    """
    lines = F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    parts = done.parts.select("k", "seg", "alone", F.when(F.size("lines") > 0, F.array_join(lines, "\n")).alias("text"))
    one = parts.filter("alone").select("k", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return one.unionByName(digests(parts.filter("not alone"), "k", ["seg"], "text", "\n"))


def _seen_before(seen: DataFrame, cut: DataFrame, long: DataFrame) -> DataFrame:
    """``seen`` with the duplicates marked whose first copy stands in an earlier segment."""
    first = cut.join(long.select("seg"), "seg", "left_semi").join(seen.select("seg", "kinds"), "seg").select(
        "k", "seg", F.posexplode(F.arrays_zip(F.transform(F.arrays_zip("role", "text"), lambda x: F.sha2(
            F.concat_ws("\n", F.length(x["role"]).cast("string"), x["role"], x["text"]), 256)).alias("h"), "kinds")).alias("at", "x")).filter(
        ~F.col("x.kinds").isin(BLANK_FAULT, DUPLICATE_FAULT)).select("k", "seg", "at", F.col("x.h").alias("h"))
    # copies per text are counted map-side first; only texts of several segments are joined back
    again = first.groupBy("k", "h").agg(F.min("seg").alias("least"), F.max("seg").alias("most")).filter("least < most")
    marked = first.join(again, ["k", "h"]).filter("seg > least").groupBy("seg").agg(F.collect_list("at").alias("again"))
    return shared_table(seen.join(marked, "seg", "left").select(
        "k", "seg", "initials", F.transform("kinds", lambda x, i: F.when(F.array_contains(F.coalesce("again", F.array().cast("array<int>")), i), F.lit(DUPLICATE_FAULT)).otherwise(x)).alias("kinds"),
        "illegal"), "repair")
