import random

import pytest

from lodegraph.llm import leakage as k

R = random.Random(6)
VOC = ["".join(R.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]


def words(n):
    return [R.choice(VOC) for _ in range(n)]


def edit(ws, n):
    ws = list(ws)
    for i in R.sample(range(len(ws)), n):
        ws[i] = "zzz" + ws[i]
    return ws


def levenshtein(p, t):
    d = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        e = [i]
        for j, b in enumerate(t, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (a != b)))
        d = e
    return min(d)


def test_distance_against_brute_force():
    for _ in range(300):
        p, t = [R.choice("abc") for _ in range(R.randint(1, 70))], [R.choice("abc") for _ in range(R.randint(0, 60))]
        assert k.edit_distance(p, t) == levenshtein(p, t)


@pytest.fixture(scope="module")
def items():
    return [(i, "s", " ".join(words(30)) + ". " + " ".join(words(40)) + ".") for i in range(30)]


def test_every_edited_window_is_found(items):
    x = k.EvalIndex(items, *k.prepare(items))
    for trial in range(60):
        i, _, text = items[trial % 30]
        w = k.words(text)
        a = R.randint(0, len(w) - 24)
        doc = " ".join([*words(40), *edit(w[a : a + 24], 2), *words(40)])
        assert [t for _, t, _ in x.leaks([doc])] == [i], trial


def test_short_passages_and_patterns_do_not_count(items):
    x = k.EvalIndex(items, *k.prepare(items))
    for i, _, text in items:
        w = k.words(text)
        assert x.leaks([" ".join([*words(30), *w[5:17], *words(30)])]) == []
    pattern = [(i, "p", f"Explain in one paragraph why it is safe to {a} the {b} {c} before the {d}, even though {n} of the {e} stay {f}.") for i, (a, b, c, d, e, f, n) in enumerate(tuple(words(7)) for _ in range(40))]
    y = k.EvalIndex(pattern, *k.prepare(pattern))
    assert y.leaks(["Explain in one paragraph why it is safe to " + "{} the {} {} before the {}, even though {} of the {} stay {}.".format(*words(7))]) == []
    assert len(y.leaks([pattern[3][2].upper()])) == 1


def test_tables(spark, items):
    standing = "Licensed under the terms in the file of this repository and no warranty of any kind is given or implied by the people who keep it."
    phrase = "Write a function that solves the following task. "
    it = [(i, s, (phrase if i % 2 else "") + t + (" " + standing if i in (3, 4) else "")) for i, s, t in items] + [(100, "s", items[0][2]), (101, "s", None), (102, "s", ""), (103, "s", "stub"), (None, "s", items[1][2])]
    it[0] = (0, "s", items[0][2])
    w = k.words(items[0][2])
    marked = "\n// ".join(" ".join(f"**{x.upper()}**," if j % 5 == 0 else x for j, x in enumerate(w[i : i + 6])) for i in range(0, 36, 6))
    docs = [(1, marked), (1, marked), (2, " ".join(words(50))), (3, None), (4, ""), (5, phrase + " ".join(words(30))), (None, marked), (6, " ".join(words(5000) + w[:25] + words(5000)))] + [(1000 + i, " ".join(words(10)) + " " + standing) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as item_id")
    i = spark.createDataFrame(it, "item_id long, suite string, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in k.leaked_items(d, i).collect())
    assert got == [(1, 0), (1, 100), (6, 0), (6, 100)]
    assert sorted((r["doc_id"], r["item_id"]) for r in k.leaked_items(d, i, block_chars=2000).collect()) == got  # items in blocks
    assert k.leaked_items(d, i.limit(0)).count() == 0 and k.leaked_items(d.limit(0), i).count() == 0


def test_leaks_that_many_documents_hold_are_no_standing_text(spark, items):
    i = spark.createDataFrame(items[:10], "item_id long, suite string, text string")
    whole, half = items[0][2], " ".join(k.words(items[1][2])[:30])
    body = words(80)
    copies = [(n, " ".join(words(80)) + ". " + whole) for n in range(60)]  # one leak in many unrelated documents
    copies += [(100 + n, " ".join(body) + ". " + half + ".") for n in range(60)]  # a sentence of an item in copies of one document
    copies += [(200 + n, " ".join(edit(body, 6)) + ". " + half + ".") for n in range(60)]  # and in near copies
    d = spark.createDataFrame([*copies, (300, " ".join(words(60)) + ". " + half), *((400 + n, " ".join(words(60))) for n in range(60))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in k.leaked_items(d, i).collect()}
    assert got == {(n, 0) for n in range(60)} | {(n, 1) for n in [*range(100, 160), *range(200, 260), 300]}


def test_phrases_of_items_in_different_blocks_are_common(spark, items):
    phrase = " ".join(words(24)) + ". "
    it = [(i, "s", phrase + text) for i, _, text in items[:4]]
    i = spark.createDataFrame([*it, (9, None, "stub")], "item_id long, suite string, text string")
    d = spark.createDataFrame([(1, " ".join(words(30)) + ". " + phrase), (2, items[0][2])], "doc_id long, text string")
    assert k.shared_wording(i) == k.prepare([*it, (9, None, "stub")])
    for chars in (1, 10**9):
        assert [tuple(r)[:2] for r in k.leaked_items(d, i, block_chars=chars).collect()] == [(2, 0)]
