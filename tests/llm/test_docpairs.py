import pytest

from lodegraph.llm import docpairs as d

SAYS = "Walks every slot and keeps those that survive."
CASES = [
    ("rust", f"/// {SAYS}\n#[inline]\npub(crate) async fn keep<T: Copy>(a: &[T]) -> Option<u8> {{ let s = \"}}\"; '}}'; None }}\n", "keep"),
    ("rust", f'#[doc = "{SAYS}"]\nfn keep() {{}}', "keep"),
    ("rust", f"/**\n * {SAYS}\n */\nfn keep() {{}}", "keep"),
    ("rust", f"// {SAYS}\nfn keep() {{}}", None),
    ("rust", f"/// {SAYS}\n\nfn keep() {{}}", None),
    ("rust", "// let a = b.c(1);\nfn keep() {}", None),
    ("go", f"// Keep {SAYS}\nfunc (s *S) Keep(a int) error {{\n\treturn nil\n}}", "Keep"),
    ("go", "// x := a.B(1)\n// if y == nil { return 1 }\nfunc Keep() {}", None),
    ("script", f"/**\n * {SAYS}\n * @param a\n */\nexport async function keep(a) {{ return `}}${{a}}`; }}", "keep"),
    ("script", f"/** {SAYS} */\nconst keep = (a) => {{\n return a;\n}};", "keep"),
    ("script", f"class A {{\n    /** {SAYS} */\n    async keep(a: number): Promise<void> {{\n    }}\n}}", "keep"),
    ("script", f"// {SAYS}\nfunction keep() {{}}", None),
    ("script", "/**\n * @param a\n * @returns\n */\nfunction keep(a) {}", None),
    ("java", f"class A {{\n  /**\n   * {SAYS}\n   */\n  @Deprecated\n  @Get(\"/x)\")\n  public static int keep(int a) throws X {{\n    return a;\n  }}\n}}", "keep"),
    ("c", f"/*!\n * {SAYS}\n */\nstatic int keep(int a, char *b)\n{{\n  return a;\n}}", "keep"),
    ("c", f"/** @brief {SAYS}\n */\nint A::keep(int a) const {{ return 1; }}", "keep"),
    ("c", f"/** {SAYS} */\nint keep(int a);", None),
    ("python", f'def keep(a):\n    """{SAYS}"""\n    return a\n', "keep"),
    ("python", f"@x(1)\nasync def keep(a: int = (1)) -> int:\n    # note\n    r'''\n    {SAYS}\n    '''\n    return a\n", "keep"),
    ("python", f'def keep(a):\n    x = """{SAYS}"""\n    return a\n', None),
    ("python", f'# {SAYS}\ndef keep(a):\n    return a\n', None),
    ("python", 'X = """\ndef keep():\n    \'\'\'' + SAYS + "\'\'\'\n\"\"\"\n", None),
    ("script", "const t = `\n/** " + SAYS + " */\nfunction keep() {}\n`;\n", None),
]


@pytest.mark.parametrize("fam, text, name", CASES)
def test_pairs(fam, text, name):
    got = [f.name for f in d.functions(text, fam) if d.says_something(f.doc, f.name)]
    assert got == ([name] if name else [])


@pytest.mark.parametrize("doc", ["", "TODO", "TODO: document", "FIXME", "TBD", "XXX", "n/a", "...", "(no description)", "Internal.", "See above.", "Auto-generated stub.", "----------", "nolint", "@internal", "eslint-disable-next-line no-alert", "The load_chunk function.", "Load chunk.", "Loads the chunk.", "load_chunk", "@param a\n@param b", "Args:\n    a:\n    b:", "let a = b.c(1);", "x := y.Z(3)", "{@inheritDoc}", "See {@link Other}.", "@brief", "@brief Loads the chunk."])
def test_trivial(doc):
    assert not d.says_something(doc, "load_chunk")


@pytest.mark.parametrize("doc", [SAYS, "Liefert den Index des Puffers und wirft einen Fehler.", "TODO\nReads it from disk when the checksum differs.", "Loads the chunk from disk, or nothing if stale.", "@param a the ticket whose lease is renewed", "@brief Orders two values by size."])
def test_says_something(doc):
    assert d.says_something(doc, "load_chunk")


def test_code_is_balanced_and_protected():
    t = f'/// {SAYS}\nfn a() {{ let s = "{{"; /* }} */ if x {{ y() }} }}\n/// {SAYS}\nfn b() {{}}'
    f = list(d.functions(t, "rust"))
    assert [x.name for x in f] == ["a", "b"] and f[0].code.endswith("if x { y() } }") and t[f[1].start :].startswith("///")
    cut = f"/// {SAYS}\nfn a() {{ if x {{"
    assert list(d.functions(cut, "rust"))[0].code.endswith("{ if x {")


def test_long_text_is_quick():
    import time

    t = "x = [" + "1, " * 200_000 + "]\n" + f'def keep(a):\n    """{SAYS}"""\n'
    began = time.time()
    assert [f.name for f in d.functions(t, "python")] == ["keep"]
    assert [f.name for f in d.functions("{ ( [ \" ' " * 20_000 + f"\n/** {SAYS} */\nfunction keep() {{}}", "script")][-1:] in ([], ["keep"])
    assert time.time() - began < 30


def test_table(spark):
    ok = f"/// {SAYS}\nfn keep() {{}}"
    rows = [(1, "a.rs", "rs", "Function", ok), (1, "a.rs", "rs", "Function", ok), (2, "b", "RUST ", "Module", ok + "\n" + ok), (3, "c.rs", None, "Class", ok), (4, "d.rs", None, "Method", None), (None, "e.rs", None, "Method", ok), (5, "f.txt", None, "Module", ok), (6, None, None, "Module", ok), (7, "g.rs", None, None, ok)]
    t = spark.createDataFrame(rows, "id long, file_path string, language string, chunk_type string, content string").selectExpr("*", "1 as name", "2 as path")
    assert sorted(map(tuple, d.documented(t).collect())) == [(1, "keep"), (2, "keep")]
    assert d.doc_pairs(t).where("chunk_id = 2").count() == 2
    assert d.documented(t.limit(0)).count() == 0
