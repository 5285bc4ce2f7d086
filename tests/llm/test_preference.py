from atoflow.llm import preference


def plain(c, r):
    clean = lambda x: sorted(((t is not None, t or 0), ro or "", tx or "") for t, ro, tx in x)
    c, r = clean(c), clean(r)
    k = 0
    while k < min(len(c), len(r)) and c[k][1:] == r[k][1:]:
        k += 1

    def render(turns):
        text, spans = "", []
        for _, role, body in turns:
            text += f"<|{role}|>\n"
            at = len(text)
            text += body + "<|end|>\n"
            if role == "assistant":
                spans.append((at, len(text)))
        return text, spans

    (p, _), (a, am), (b, bm) = render(c[:k]), render(c[k:]), render(r[k:])
    return k, p, a, b, am, bm


CASES = {
    1: ([(0, "user", "hi"), (1, "assistant", "yes"), (2, "user", "ok")], [(0, "user", "hi"), (1, "assistant", "no")]),
    2: ([(0, "user", "hi")], [(0, "user", "hi")]),
    3: ([(0, "user", "hi")], []),
    4: ([], [(0, "assistant", "🙂é")]),
    5: ([(None, None, None), (1, "assistant", "")], [(None, None, ""), (1, "assistant", None), (2, "user", "x")]),
    6: ([(3, "user", "a"), (1, "system", "s"), (1, "system", "s")], [(1, "system", "s"), (2, "system", "s"), (9, "user", "a")]),
    7: ([(i, ("user", "assistant")[i % 2], "long " * 2000) for i in range(300)],
        [(i, ("user", "assistant")[i % 2], "long " * 2000 if i < 299 else "x") for i in range(300)]),
    None: ([(0, "user", "hi")], [(0, "user", "hi")]),
}


def frame(spark, side):
    rows = [(p, *t, "x") for p, sides in CASES.items() for t in sides[side]]
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string, c string")


def test_pairs_equal_the_plain_version(spark):
    got = {r.pair_id: (r.prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(x) for x in r.chosen_mask], [tuple(x) for x in r.rejected_mask])
           for r in preference.preference_pairs(frame(spark, 0), frame(spark, 1)).collect()}
    assert got == {p: plain(*sides) for p, sides in CASES.items() if p is not None}


def test_masked_spans_are_the_assistant_turns(spark):
    r = preference.preference_pairs(frame(spark, 0), frame(spark, 1)).filter("pair_id = 1").first()
    assert [r.chosen[a:b] for a, b in r.chosen_mask] == ["yes<|end|>\n"]


CONVERSATIONS = {
    0: [(0, "user", "a"), (1, "assistant", "b"), (2, "user", "c"), (3, "assistant", "d")],
    1: [(0, "user", "a"), (1, "assistant", "x"), (2, "user", "y")],
    2: [(None, "user", None), (None, None, "q"), (5, "assistant", "z"), (5, "assistant", "z")],  # null, repeated, skipped turns
    3: [(1, "user", "only")],
    5: [(0, "user", "odd"), (1, "assistant", "alone")],  # no partner
    8: [(0, "user", "even"), (1, "assistant", "alone"), (2, "user", "")],
    -2: [(0, "user", "m"), (1, "assistant", "n")],
    -1: [(0, "user", "m"), (1, "assistant", "o")],
    None: [(0, "user", "no conversation")],
}


def test_every_conversation_is_chosen_once(spark):
    rows = [(c, *t, "x", "y") for c, turns in CONVERSATIONS.items() for t in turns]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pair_id string, half string")
    clean = lambda x: sorted(((t is not None, t or 0), ro or "", tx or "") for t, ro, tx in x)
    want = {}
    for c, turns in CONVERSATIONS.items():
        if c is not None:
            own, other, half = clean(turns), clean(CONVERSATIONS.get(c ^ 1, [])), len(turns) // 2
            number = lambda side: [(i, ro, tx) for i, (_, ro, tx) in enumerate(side)]
            want[c] = plain(number(own), number(own[:half] + other[half:]))
    got = [(r.pair_id, (r.prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(x) for x in r.chosen_mask], [tuple(x) for x in r.rejected_mask]))
           for r in preference.conversation_pairs(conversations).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_empty_table(spark):
    none = frame(spark, 0).limit(0)
    assert preference.preference_pairs(none, none).count() == 0
    assert preference.conversation_pairs(none.withColumnRenamed("pair_id", "conv_id")).count() == 0


def test_query_reads_every_turn(spark):
    from atoflow.llm import queries

    sf = "/root/testdata/sf0.01"
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    out = queries.chat_formatting(spark, sf)
    assert out.count() == turns.select("conv_id").distinct().count()
    marks = out.selectExpr("sum(regexp_count(prompt, '<[|]end[|]>') + regexp_count(chosen, '<[|]end[|]>')) as n").first().n
    assert marks == turns.count()


def test_no_python_on_the_main_path(spark):
    plan = preference.preference_pairs(frame(spark, 0), frame(spark, 1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
