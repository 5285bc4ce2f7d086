import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from atoflow.llm import queries, trie
from tests.llm.helpers import words

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(turns):
    convs = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [r[2:] for r in sorted(rows)] for c, rows in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = tuple(convs.get(base, [])[:h] + own[h:])
    return nodes_of(rebuilt)


def nodes_of(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        below = children[seq]
        leaves[seq] = sum(leaves[b] for b in below) if below else 1
        own = (len(members[seq]) - 1) * len(words(seq[-1][1])) if seq else 0
        saved[seq] = own + sum(saved[b] for b in below)
    return sorted((min(m), len(seq), min(members[seq[:-1]]) if seq else None, len(m), len(children[seq]), leaves[seq], saved[seq],
                   hashlib.sha256(",".join(map(str, sorted(ends[seq]))).encode()).hexdigest()) for seq, m in members.items())


def got(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.conversation_trie(spark, sf)
    assert all(f.dataType.simpleString() == "bigint" for f in df.schema if f.name != "ends_sha256")
    assert got(df) == plain(turns)


def shared(seed=1):
    """Few different turns, so that conversations share long beginnings; one has very many turns."""
    rng = random.Random(seed)
    pick = lambda: (rng.choice(["user", "user", "assistant", None]), rng.choice(["a b", "a b", "c", "", None, "ü 漢 字"]))
    rows = [(c, t, *pick()) for c in [*range(90), -7, -20] for t in range(rng.randrange(0, 7))]
    rows += [(200, t, "user", "same words here") for t in range(150)] + [(201, t, "user", "same words here") for t in range(120)]
    rows += [(220 + c, t, "user", "copy") for c in range(30) for t in range(4)]
    rows += [(300, None, "user", "first"), (300, 0, "user", "second"), (300, 0, "assistant", "second"), (None, 0, "user", "nobody's")]
    return rows


@pytest.mark.parametrize("small", [1, 5, 4096])
def test_rounds_and_finish_agree(spark, small, monkeypatch):
    """With small = 1 every component is split by rounds over the whole table."""
    monkeypatch.setattr(trie, "SALT", 3)
    rows = shared()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("d", F.lit("x")).withColumn("rep", F.lit(1))
    turns, ids = queries.rebuilt_turns(df)
    assert got(trie.prefix_trie(turns, ids, small=small)) == plain(rows)


def test_decompose_by_itself():
    rng = random.Random(2)
    for n in (1, 2, 3, 17, 200):
        for shape in ("chain", "star", "any"):
            parent = [-1] + [v - 1 if shape == "chain" else 0 if shape == "star" else rng.randrange(v) for v in range(1, n)]
            one, size = [rng.randrange(5) for _ in range(n)], [1] * n
            want = list(one)
            for v in range(n - 1, 0, -1):
                size[parent[v]] += size[v]
                want[parent[v]] += want[v]
            assert trie.decompose(size, parent, one, [1] * n) == (want, size)


def test_empty(spark):
    turns, ids = queries.rebuilt_turns(spark.createDataFrame([], SCHEMA))
    assert got(trie.prefix_trie(turns, ids)) == []
    turns, ids = queries.rebuilt_turns(spark.createDataFrame([(5, 0, "user", "x"), (None, 1, "user", "x")], SCHEMA))
    assert got(trie.prefix_trie(turns, ids)) == plain([(5, 0, "user", "x")])


def task_count(spark, group, work):
    """Tasks of all stages that ``work`` runs."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)


def test_few_rounds_of_tasks(spark):
    """At a fixed number of shuffle partitions the query takes time for each of its exchanges."""
    fixed = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in fixed}
    rows = [(c, t, "user", f"{c % 7} {t}" if t else "hello") for c in range(300) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = []
    try:
        for k, v in fixed.items():
            spark.conf.set(k, v)
        tasks = task_count(spark, "trie-tasks", lambda: out.extend(got(trie.prefix_trie(*queries.rebuilt_turns(df), small=100))))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert out == plain(rows)
    assert tasks < 18 * 60


def test_salted_components(spark, monkeypatch):
    """More large components than are broadcast."""
    monkeypatch.setattr(trie, "BROADCAST", 0)
    monkeypatch.setattr(trie, "SALT", 3)
    rows = shared(4)
    assert got(trie.prefix_trie(*queries.rebuilt_turns(spark.createDataFrame(rows, SCHEMA)), small=20)) == plain(rows)


def test_digests_of_turns_and_ids(spark):
    """Turns without hashes, numbered by the caller; an id without turns, one that comes twice."""
    convs = {c: tuple((r, x) for r, x in [("user", "a b"), ("assistant", "c"), ("user", "d")][:c % 4]) for c in range(9)}
    convs[20] = tuple(("user", "same words") for _ in range(300))
    convs[21] = convs[20][:290]
    df = spark.createDataFrame([(c, d, *t) for c, seq in convs.items() for d, t in enumerate(seq, 1)], "conv_id long, d long, role string, text string")
    ids = spark.createDataFrame([(c,) for c in [*convs, 3]], "conv_id long")
    turns = df.select("conv_id", "d", *trie.token(F.col("role"), F.col("text")))
    assert got(trie.prefix_trie(turns, ids, small=64)) == nodes_of(convs)


def test_short_bases_move_turns(spark):
    """Conversations in several ranges, with a base that is absent or shorter than their h."""
    rows = [(c, t, "user", f"w{t % 3}") for c in (41, 42, 43, 44, 45, 46, 47, 48, 60, 61, 62, 63, 64, 65) for t in range(1 if c == 60 else 120)]
    shifts = {zlib.crc32(str(c).encode()) % 4 - (0 if c < 60 else 1) for c in {r[0] for r in rows} if c != 60}
    assert {1, 2, 3} <= shifts
    assert got(trie.prefix_trie(*queries.rebuilt_turns(spark.createDataFrame(rows, SCHEMA).repartition(7)))) == plain(rows)
