import random

import pytest

from lodegraph.llm import mixing as m

R = random.Random(9)


def docs(spark):
    rows, i = [], 0
    for source, n in (("big", 400), (" BIG ", 20), ("mid-size", 150), ("Tiny", 6), ("other", 30)):
        for _ in range(n):
            i += 1
            rows.append((i, source, " ".join(R.choice(("alpha", "beta", "gamma delta")) for _ in range(R.randint(1, 60)))))
    rows += [(i, source, rows[i - 1][2]) for i, source, _ in rows[:3]] + [(9001, "big", None), (9002, "big", "  "), (9003, None, "x"), (None, "big", "x")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as n_tokens", "2 as rate")


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, target_share double, max_repeats int")


@pytest.mark.parametrize("keep", [False, True])
def test_shares_meet_the_targets(spark, keep):
    t = targets(spark, ("big", 0.5, 1), ("mid_size", 0.3, 2), ("tiny", 0.1, 3), ("absent", 0.1, 2), (None, 0.1, 1))
    c, _, g = m.mix_copies(docs(spark), t, keep_size=keep)
    rows = c.collect()
    cap = {x.source: x.cap for x in g}
    taken = {}
    for r in rows:
        assert 0 <= r["copies"] <= cap[r["source"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["n_tokens"]
    total = sum(taken.values())
    for s, want in (("big", 0.5), ("mid_size", 0.3), ("tiny", 0.1)):
        assert taken[s] / total == pytest.approx(want + 0.1 / 3, abs=0.01)
    assert len({r["doc_id"] for r in rows}) == len(rows) == 576
    tiny = [r for r in rows if r["source"] == "tiny"]
    assert {r["copies"] for r in tiny} == {3}  # the binding source gives all it may


def test_the_dual_is_solved(spark):
    t = targets(spark, ("big", 0.2, 2), ("other", 0.8, 4))
    sizes = m.document_sizes(docs(spark), m.clean_targets(t))
    table = sizes.groupBy("source", "n_tokens").count().withColumnRenamed("count", "n")
    have = {r["source"]: (r["d"], r["t"]) for r in table.groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "d").join(sizes.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "t"), "source").collect()}
    g = m.goals([(s, w, c, *have[s]) for s, w, c in (("big", 0.2, 2), ("other", 0.8, 4))])
    assert m.newton(table, g) < m.NEWTON_STEPS
    got = {}
    for r in m._rates(sizes, g).collect():
        got[r["source"]] = got.get(r["source"], 0) + r["rate"] * r["n_tokens"]
    for x in g:
        assert got[x.source] == pytest.approx(x.want_tokens, rel=1e-6)


def test_report_and_empty(spark):
    t = targets(spark, ("big", 0.6, 1), ("absent", 0.4, 2), ("mid-size", None, 2), ("other", 0.1, None))
    r = {x["source"]: x for x in m.mix_report(docs(spark), t).collect()}
    assert r["big"]["actual_share"] == 1.0 and r["absent"]["actual_share"] == 0.0 and r["mid_size"]["tokens_taken"] == 0 and r["other"]["n_chosen"] == 0
    e = m.mix_report(docs(spark).limit(0), t).collect()
    assert len(e) == 4 and all(x["actual_share"] == 0 for x in e)
    assert m.mix_documents(docs(spark), t.limit(0)).count() == 0
