import random

import numpy as np
import pytest

from lodegraph.llm import machine_files as m

R = random.Random(8)
WORDS = [a + b for a in "ka lo mi nu pe".split() for b in "tor dan vex lim".split()]


def code(lines=40):
    return "\n".join(f"    {R.choice(WORDS)}.{R.choice(WORDS)}({R.choice(WORDS)}, {R.choice(WORDS)});" for _ in range(lines))


def test_winnowing_finds_every_long_common_run():
    toks = lambda n: [R.choice(WORDS) for _ in range(n)]
    for _ in range(20):
        common = toks(m.GRAM + m.WINDOW - 1)
        a, b = (m.fingerprints([" ".join(toks(R.randint(0, 90)) + common + toks(R.randint(0, 90)))])[0] for _ in range(2))
        assert np.intersect1d(a, b).size


def test_fingerprints_do_not_depend_on_neighbours_or_comments():
    t = [code(), "", "x", code(3)]
    alone = [m.fingerprints([x])[0].tolist() for x in t]
    assert [x.tolist() for x in m.fingerprints(t)] == alone
    assert m.fingerprints(["// note\n" + t[0].replace("    ", "\t")])[0].tolist() == alone[0]
    assert alone[1] == alone[2] == []


@pytest.mark.parametrize("head", ["// Code generated by x from y. DO NOT EDIT.", "# @generated by x", "// <auto-generated>", "// Diese Datei wurde automatisch erzeugt (x). Nicht bearbeiten.", "// machine-written; regenerate with make x", "<!-- generated: do not edit -->", "> Automatically assembled API listing. Change the sources, not this page.", "// Output of `x --in y`. Edit the input instead of this output."])
def test_generated_notes(head):
    assert m.head_notes(head + "\nfn a() {}")[0] == 1


@pytest.mark.parametrize("head", ["// The generator in tools/ writes a DO NOT EDIT banner; this file is the template logic.", "// Kept by hand: the table below mirrors the generated schema, update both.", "// Please do not edit the constants without asking.", "// Not vendored: we wrote this after dropping the third_party copy.", "/// Auto-generated stub.", "// Part of x. See LICENSE in the repository root."])
def test_notes_that_only_talk_about_it(head):
    assert m.head_notes(head + "\nfn a() {}") == (0, 0, 0)


@pytest.mark.parametrize("head", ["// Vendored from lib, commit 0123abcd; local patches: none", "# Copied verbatim from the lib distribution, release 1.2.3.", "/*\n * lib version 3.3.3\n * Redistribution and use are permitted provided the notice is kept.\n */", "// (c) 2021 the lib contributors, released under the Expat terms"])
def test_third_party_notes(head):
    assert m.head_notes(head + "\nfn a() {}")[1] == 1


def test_tables(spark):
    lib = code(60)
    hand = [(i, f"/r/own-{i}/src/f{i}.rs", 1, code(60)) for i in range(5)]
    copies = [(10 + i, f"/r/repo-{i}/deep/x{i}.rs", 1, f"// first {i}\n" + lib + "\n" + code(4)) for i in range(4)]
    other = [
        (20, "/r/a/gen/t.rs", 1, "\n".join(f"fn f_{i:04}(p: u8) -> u32 {{ read(p, {4 * i}) }}" for i in range(40))), (21, "/r/a/x.min.js", 1, "var a=b.c||{};" * 40), (22, "/r/a/web/p.js", 1, "var a=b.c||{};b[a]=1;" * 60), (23, "/r/a/deps.toml", 1, '[[package]]\nname = "x"\nversion = "1.2.3"\nchecksum = "abc"\n' * 4),
        (24, "/r/a/d.go", 1, "var d = []byte{\n" + "\n".join("0x12, 0x34, 0xff, 0x00, 0x7f, 0x55, 0xaa, 0x01, 0x02, 0x03," for _ in range(30)) + "\n}"), (25, "/r/a/vendor/lib/y.rs", 1, "fn y() {}"), (26, None, 1, "x"), (27, "/r/a/empty.rs", None, None), (27, "/r/a/empty.rs", None, None), (28, "/r/a/vendor_list.rs", 1, code(30)),
    ]
    d = spark.createDataFrame(hand + copies + other, "id long, file_path string, line_start int, content string").selectExpr("*", "'x' as reason", "1 as mini")
    p = spark.createDataFrame([(1, " *.min.js "), (2, "vendor"), (3, None), (4, "")], "pattern_id int, pattern string")
    got = {r["file_path"]: (r["reason"], r["ignored"]) for r in m.classify_files(d, p).collect()}
    reason = {k: v[0] for k, v in got.items()}
    assert {reason[r[1]] for r in hand} == {None} and {reason[r[1]] for r in copies} == {"copy"}
    assert [reason[r[1]] for r in other[:6]] == ["generated", "minified", "minified", "lock", "data", "third_party"]
    assert reason["/r/a/empty.rs"] is None and reason["/r/a/vendor_list.rs"] is None and len(got) == len(hand) + len(copies) + 8
    assert got["/r/a/x.min.js"][1] and got["/r/a/vendor_list.rs"][1] and not got["/r/a/d.go"][1]
    assert m.classify_files(d.limit(0)).count() == 0


def test_notes_below_a_long_licence_and_tables_with_long_rows():
    licence = "".join(f"// Clause {i} of the terms.\n" for i in range(300))
    assert m.head_notes(licence + "// Code generated by gridc. DO NOT EDIT.\nfn a() {}\n") == (1, 0, 0)
    assert m.head_notes(licence + "fn a() {}\n// Code generated by gridc. DO NOT EDIT.\n") == (0, 0, 0)
    rows = ["row(" + ", ".join(str(i * j % 977) for j in range(200)) + ");" for i in range(1, 41)]
    assert m.features("\n".join(rows))[4] == 40


def test_copies_of_known_third_party_code(spark):
    """One copy stands in a folder of such code, the other under a name of its own, without a note: its fingerprints tell."""
    lib, note = code(60), "// Vendored from lib, commit 0123abcd; local patches: none\n"
    rows = [(1, "/r/a/vendor/lib/x.rs", 1, lib), (2, "/r/b/src/own.rs", 1, lib + "\n" + code(3)), (3, "/r/a/src/user.rs", 1, code(60)), (4, "/R/A/./src/twin.rs", 1, lib)]
    more = code(60)
    rows += [(5, "/r/c/src/n.rs", 70, note + more), (6, "/r/d/src/m.js", 1, more), (7, "/r/e/src/late.rs", 1, "fn a() {}"), (8, "/r/e/src/late.rs", 9, "// Code generated by x. DO NOT EDIT.\nfn b() {}")]
    d = spark.createDataFrame(rows, "id long, file_path string, line_start int, content string")
    got = {r["file_path"]: (r["reason"], r["by_prints"]) for r in m.classify_files(d).collect()}
    assert got["/r/b/src/own.rs"] == got["/r/d/src/m.js"] == ("copy", True)
    assert got["/r/a/vendor/lib/x.rs"][0] == got["/r/c/src/n.rs"][0] == "third_party"
    # the user's own files, a twin in the same repository, and notes below the opening tell nothing
    assert got["/r/a/src/user.rs"] == got["/R/A/./src/twin.rs"] == got["/r/e/src/late.rs"] == (None, False)
