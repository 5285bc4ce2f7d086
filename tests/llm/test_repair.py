import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from atoflow.llm import queries, ranges, repair
from tests.llm.helpers import words

LEGAL = re.compile(r"s?(ua)+|")


def brute(initials, kinds):
    """Cheapest (cost, audit) by trying every string of edits, cheapest first."""
    n, best = len(initials), None
    for inserts in range(0, n + 3):
        for length in [n + inserts]:
            for where in itertools.combinations(range(length), inserts):
                for own in itertools.product("DKR", repeat=n):
                    for put in itertools.product("ua", repeat=inserts):
                        for roles in itertools.product("ua", repeat=own.count("R")):
                            audit, out, cost, at, p, r = "", "", 0, 0, 0, 0
                            for i in range(length):
                                if i in where:
                                    audit, out, cost, p = audit + "I", out + put[p], cost + 3, p + 1
                                    continue
                                e, k = own[at], kinds[at]
                                audit += e
                                if e == "D":
                                    cost += 4
                                elif k in (1, 2):
                                    cost += 10_000
                                else:
                                    cost += (3 if k == 3 else 0) + (3 if e == "R" else 0)
                                    out += initials[at] if e == "K" else roles[r]
                                    r += e == "R"
                                at += 1
                            if LEGAL.fullmatch(out) and (best is None or (cost, audit) < best):
                                best = cost, audit
    return best


@pytest.mark.parametrize("seed", range(25))
def test_cheapest_equals_all_edits(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 4)
    initials, kinds = "".join(rng.choice("sua ") for _ in range(n)), [rng.choice([0, 0, 1, 2, 3]) for _ in range(n)]
    edits, cost, to = repair.cheapest(initials, kinds)
    assert (cost + repair.END[to], edits + repair.TAIL[to]) == brute(initials, kinds)


def test_audits_with_colliding_hashes():
    """Hashes mod 3 collide all the time; the order must not change."""
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 30)
        initials, kinds = "".join(rng.choice("sua") for _ in range(n)), [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        assert repair.cheapest(initials, kinds, audits=repair.Audits(3, 2)) == repair.cheapest(initials, kinds)


def plain(turns):
    """Expected digest rows by a DP that carries whole audit strings."""
    convs = {}
    for conv, turn, role, text in turns:
        rows = convs.setdefault(conv, [])
        s = lambda x: " " if x is None else str(x)
        lot = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if lot == 1:
            text = ""
        if lot == 2:
            text = re.sub("[.!?]", "", text)
        if lot == 4:
            role = "user"
        rows += [] if lot == 0 else [(turn, role, text)] * (2 if lot == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        numbers = [t for t, _, _ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, kinds = set(), []
        for _, r, t in rows:
            w = words(t)
            kinds.append(1 if not w else 2 if (r, t) in seen else 0 if w[-1][-1] in ".!?" else 3)
            seen.add((r, t))
        initials = [r[:1] or " " for _, r, _ in rows]
        best = {"": (0, "", ())}  # by the last role kept: cost, audit, lines

        def put(to, state, cost, audit, lines):
            if state not in to or (cost, audit) < to[state][:2]:
                to[state] = cost, audit, lines

        nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
        name = {"u": "user", "a": "assistant"}

        def inserted(best):
            for _ in range(2):
                more = dict(best)
                for s, (c, a, ls) in best.items():
                    put(more, nxt[s], c + 3, a + "I", (ls, name[nxt[s]] + ":"))
                best = more
            return best

        for i, k, (_, r, t) in zip(initials, kinds, rows):
            to = {}
            for s, (c, a, ls) in inserted(best).items():
                put(to, s, c + 4, a + "D", ls)
                if k not in (1, 2):
                    c += 3 if k == 3 else 0
                    if i == "s" and s == "" or i == nxt[s]:
                        put(to, i, c, a + "K", (ls, f"{r}:{t}"))
                    put(to, nxt[s], c + 3, a + "R", (ls, f"{name[nxt[s]]}:{t}"))
            best = to
        cost, audit, chain = min((best := inserted(best))[s] for s in ("", "a") if s in best) if rows else (0, "", ())
        lines = []
        while chain:
            chain, line = chain
            lines.append(line)
        out[conv] = (gaps, kinds.count(1), kinds.count(2), kinds.count(3),
                     sum(p + q not in ("su", "ua", "au") for p, q in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(reversed(lines)).encode()).hexdigest())
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.structure_repair(spark, sf).collect()}
    assert got == plain(turns)
    assert sum(v[5] for v in got.values()) > 0


def messy():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "why", "", " \t", None, "Ünï 漢字?", "a. "]
    out = [(c, t if rng.random() < 0.98 else None, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < .4 else f"turn {rng.random()}.")
           for c in [*range(12), None] for t in range(rng.randrange(0, 9))]
    out = [r for i, r in enumerate(out) if r[1] is not None or not any(q[0] == r[0] and q[1] is None for q in out[:i])]
    out += [(99, t, "user" if t % 2 else "assistant", f"long {t % 37}" + ".!?x"[t % 4]) for t in range(300)]
    return out


@pytest.mark.parametrize("size, fan", [(1024, 1024), (7, 3)])
def test_small_segments_change_nothing(spark, scratch, size, fan, monkeypatch):
    spark.createDataFrame(messy(), "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1)).withColumn(
        "seg", F.lit("x")).write.parquet(f"{scratch}/conversations.parquet")
    whole = repair.repair
    monkeypatch.setattr(repair, "repair", lambda rows: whole(rows, size=size, fan=fan))
    got = {r[0]: tuple(r)[1:] for r in queries.structure_repair(spark, scratch).collect()}
    assert got == plain(messy())


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    done = repair.repair(none)
    assert done.conversations.count() == 0 and repair.digest(done).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello.")], none.schema)
    done = repair.repair(twice)
    assert [tuple(r)[2:] for r in done.conversations.collect()] == [(0, 1, 0, 1, 4, "KDK")]
    assert [tuple(r)[1] for r in repair.gaps(twice, ranges.group_key("conv_id"), "turn").collect()] == [0]
