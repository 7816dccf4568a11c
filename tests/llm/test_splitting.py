import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.llm import splitting as s


def check(text, kind, words, size, over):
    p = s.split(text, kind, words, size, over)
    assert "".join(text[a + o : b] for a, b, o in p) == text
    for i, (a, b, o) in enumerate(p):
        t = text[a:b]
        assert len(t.encode("utf-8", "surrogatepass")) <= size and len(s._WORD.findall(t)) <= words
        assert len(s._WORD.findall(text[a : a + o])) <= over and (i or not o)
    return p


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab \n\t.;{}#é漢😀"), max_size=200), st.sampled_from(["Function", "Section", None]), st.integers(1, 12), st.integers(8, 60), st.integers(0, 5))
def test_round_trip_and_limits(text, kind, words, size, over):
    check(text, kind, words, size, over)


@pytest.mark.parametrize("text", ["x" * 20_000, "é" * 9_000, " " * 9_000, "a " * 60_000, "\n" * 9_000])
def test_extremes(text):
    check(text, "Module", 400, 4096, 40)


def test_cuts_fall_between_functions_and_paragraphs():
    code = "\n\n".join(f"fn f{i}() {{\n" + "\n".join(f"    step_{j}({i});" for j in range(30)) + "\n}" for i in range(20))
    assert all(code[b:].lstrip().startswith("fn f") for _, b, _ in check(code, "Module", 400, 4096, 40)[:-1])
    prose = "\n\n".join("Words and more words in a row. " * 12 for _ in range(30))
    assert all(prose[:b].endswith("\n\n") for _, b, _ in check(prose, "Section", 400, 4096, 40)[:-1])


def test_overlap_is_whole_words_from_before():
    text = " ".join(f"w{i}" for i in range(1000))
    p = check(text, "Paragraph", 400, 4096, 40)
    for a, b, o in p[1:]:
        assert o and text[a : a + o].split()[0].startswith("w") and text[a - 1] == " "


def test_table(spark):
    rng = random.Random(1)
    at = " ".join(["w"] * 400)
    rows = [(1, "Function", at), (2, "Function", at + " w"), (2, "Function", at + " w"), (3, "x", "b" * 4096), (4, None, "b" * 4097), (5, "Section", None), (6, "Section", ""), (None, "Section", "b" * 5000), (7, "Section", "é" * 2049), (8, "Section", "\r\n".join(["w"] * 401)), (9, "Section", "w\u00a0" * 500)]
    d = spark.createDataFrame(rows, "id long, chunk_type string, content string").selectExpr("*", "1 as text", "2 as h")
    p = s.split_oversized(d)
    assert sorted(r[0] for r in p.select("chunk_id").distinct().collect()) == [2, 4, 7, 8]
    by = {}
    for r in p.orderBy("chunk_id", "piece_no").collect():
        assert r["n_words"] <= 400 and r["n_bytes"] <= 4096
        by[r["chunk_id"]] = by.get(r["chunk_id"], "") + r["text"][r["overlap_chars"] :]
    assert by == {i: t for i, _, t in rows if i in by}
    assert s.split_oversized(d.limit(0)).count() == 0 and rng
