import random

import numpy as np
import pytest

from lodegraph.llm import subjects as s

R = random.Random(12)
VOC = {"music": "guitar violin sonata chord tempo choir opera drum", "law": "court verdict appeal clause notary statute judge counsel", "food": "oven flour recipe garlic broth dough menu skillet"}
VOC = {k: v.split() for k, v in VOC.items()}
GENERIC = ["The page was renamed and the label moved to the top.", "Nothing else depends on this setting at the moment.", "Please keep the names short and run the test again."]


def sentence(subject):
    a, b = R.sample(VOC[subject], 2)
    return R.choice([f"Each {a} is stored with its {b} for later.", f"When the {a} changes, the view shows the {b} again.", f"A {a} without a {b} is reported and skipped."])


def document(*subjects):
    out = [sentence(x) for x in subjects for _ in range(R.randint(3, 5))] + R.sample(GENERIC, 2)
    R.shuffle(out)
    return out


def test_sentences():
    t = "# Title\n\n// First line goes\n// on here. Second one.\nlet x = a.b(1);\n// socket may lag behind\nfor y in z { y(); }\n\n```\nguitar violin.\n```\n- Item one. Item two!\n"
    assert [x.strip() for x in s.sentences(t)] == ["First line goes on here.", "Second one.", "Item one.", "Item two!"]
    assert s.sentences(None) == s.sentences("") == []


def test_updates_lower_the_divergence():
    rng = np.random.default_rng(1)
    v = rng.poisson(1.0, (40, 30)).astype(float)
    r, c = np.nonzero(v)
    starts = np.flatnonzero(np.r_[True, np.diff(r) > 0])
    h = rng.random((30, 4)) + 0.1
    h /= h.sum(0)

    def loss(h):
        w, _, _ = s.solve_w(starts, c, v[r, c], h, 30)
        p = (w * v.sum(1)[:, None]) @ h.T
        return (p - v * np.log(np.maximum(p, 1e-12))).sum()

    before = loss(h)
    for _ in range(10):
        n = np.full(h.shape, 1e-12)
        t, x = s.h_share(starts, c, v[r, c], h)
        n[t] += x
        h = n / n.sum(0)
    assert loss(h) < before


def test_encoding_and_mixtures():
    v = s.Vocabulary({"de": ["ton"], "en": ["bow", "court", "string"]})
    docs = [["en|bow string odd", "en|bow court", "de|ton"], [], ["fr|bow"]]
    r, sent, c = v.encode(docs)
    assert list(zip(r.tolist(), sent.tolist(), c.tolist())) == [(1, 0, 1), (1, 0, 3), (1, 1, 1), (1, 1, 2), (0, 2, 0)]
    rows, starts, cols, n, _ = v.matrix(r, c)
    assert (rows.tolist(), starts.tolist(), cols.tolist(), n.tolist()) == ([0, 1], [0, 1], [0, 1, 2, 3], [1, 2, 1, 1])
    h = np.array([[0, 0, 1], [0.5, 0, 0], [0, 1, 0], [0.5, 0, 0]], np.float32)  # music, law, and a free component
    share, mass, count = s.mixtures(docs, s.Model(["music", "law"], v, h))
    assert count.tolist() == [[1, 0], [0, 0], [0, 0]] and share[0, 0] > share[0, 1] > 0 and not share[1:].any()
    assert mass[0].round(3).tolist() == [round(2**0.5 + 1, 3), 1.0]


def test_held_out_subjects(spark):
    truth, rows = {}, []
    for i in range(600):
        subj = R.choice([(), ("music",), ("law",), ("food",), ("music", "law")])
        truth[i] = set(subj)
        text = document(*subj)
        if R.random() < 0.3:  # a passing mention
            text.append(f"The name has nothing to do with a {R.choice(VOC['food'])}, it is a joke.")
        rows.append((i, "\n".join("// " + x for x in text) + "\nlet guitar = violin.chord(3);\n"))
    rows += [(0, rows[0][1]), (700, None), (701, ""), (702, "let a = b;"), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as subject", "2 as sentences")
    lab = [(i, x.upper() if i % 7 == 0 else x, "a") for i in range(60) for x in truth[i]]
    lab += [(i, "law", "b") for i in range(0, 60, 20)] + [(5, "nonsense", "c"), (None, "law", "a"), lab[0]]
    sub = spark.createDataFrame([("Music", "songs"), ("Law", None), ("Food", "meals"), (None, "x")], "subject string, description string")
    labels = spark.createDataFrame(lab, "doc_id long, subject string, annotator string")
    got = {(r["doc_id"], r["subject"].lower()) for r in s.document_subjects(docs, sub, labels).collect()}
    want = {(i, x) for i, t in truth.items() if i >= 60 for x in t}
    held = {p for p in got if p[0] >= 60}
    assert len(held & want) >= 0.95 * len(want) and len(held & want) >= 0.95 * len(held)
    assert not {p for p in got if p[0] >= 700}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "A guitar and a violin play.")], "doc_id long, text string")
    sub = spark.createDataFrame([("Music", "guitar violin")], "subject string, description string")
    lab = spark.createDataFrame([], "doc_id long, subject string, annotator string")
    assert s.document_subjects(d.limit(0), sub, lab).count() == 0
    assert s.document_subjects(d, sub.limit(0), lab).count() == 0
    assert s.document_subjects(d, sub, lab).count() == 0


@pytest.mark.parametrize("text, lang", [("Der Hund und die Katze sind nicht da.", "de"), ("The dog and the cat are not here.", "en"), ("El perro y la gata no son de la casa.", "es")])
def test_languages(text, lang):
    assert s.by_language([text])[0].startswith(lang + "|")


def test_partitions_without_known_terms(spark):
    rows = [(i, "The guitar and the violin play a sonata. A choir sings the opera with a drum. The violin keeps the tempo of the guitar.") for i in range(6)] + [(i, "Xylo qwert zuio. Plok mnbv trew.") for i in range(10, 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9, "doc_id")
    sub = spark.createDataFrame([("Music", "guitar violin sonata")], "subject string, description string")
    lab = spark.createDataFrame([(0, "music", "a"), (1, "music", "a"), (1, "music", "b")], "doc_id long, subject string, annotator string")
    got = s.document_subjects(docs, sub, lab).collect()
    assert {r["doc_id"] for r in got} <= set(range(6)) and all(0 < r["share"] <= 1 for r in got)
