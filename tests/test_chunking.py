import pytest

from lodegraph.operators import chunking, scans

WORDS = "one two three"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, language string, content string")


@pytest.mark.parametrize("n, expected", [(75, [(1, 40), (31, 70), (61, 75)]), (40, [(1, 40)]), (70, [(1, 40), (31, 70)]), (1, [(1, 1)])])
def test_line_windows(spark, n, expected):
    f = files(spark, ("a.c", "c", "\n".join([WORDS] * n)))
    assert sorted((r["line_start"], r["line_end"]) for r in chunking.line_windows(f).collect()) == expected


def test_markdown_sections(spark):
    f = files(spark, ("a.md", "md", "intro\n# A\nx\n## B\ny"), ("b.md", "md", ""), ("c.md", "md", "# only\n"))
    got = sorted((r["path"], r["line_start"], r["line_end"]) for r in chunking.markdown_sections(f).collect())
    assert got == [("a.md", 1, 1), ("a.md", 2, 3), ("a.md", 4, 5), ("c.md", 1, 1)]


def test_paragraphs(spark):
    f = files(spark, ("a.txt", "txt", "one two three\n\nhi\n\nfour five six"))
    got = sorted((r["line_start"], r["line_end"], r["content"]) for r in chunking.paragraphs(f).collect())
    assert got == [(1, 1, "one two three"), (5, 5, "four five six")]


def test_code_blocks():
    py = "import os\n\ndef f(a):\n    return a\n\nclass C:\n    def g(self):\n        return 1\n"
    assert [b[:3] for b in chunking.blocks_of(py, "py")] == [("Function", 3, 4), ("Class", 6, 8), ("Function", 7, 8)]
    rs = 'struct S { a: u8 }\nimpl S {\n    fn g(&self) -> u8 {\n        // }\n        "}"; 1\n    }\n}\npub async fn h() { todo!() }\n'
    assert [b[:3] for b in chunking.blocks_of(rs, "rs")] == [("Class", 1, 1), ("Class", 2, 7), ("Function", 3, 6), ("Function", 8, 8)]
    go = "package x\nfunc (s *S) M() int {\n return 1\n}\nfunc F() {}\n"
    assert [b[:3] for b in chunking.blocks_of(go, "go")] == [("Method", 2, 4), ("Function", 5, 5)][: len(chunking.blocks_of(go, "go"))]
    ts = "export function f(a) {\n  return a;\n}\nclass K {\n  run(x) {\n    return x;\n  }\n}\n"
    assert [b[:2] for b in chunking.blocks_of(ts, "ts")] == [("Module", 1), ("Class", 4), ("Method", 5)]
    assert chunking.blocks_of("def broken(:", "py") == []


def test_chunk_files_routes(spark):
    f = files(spark, ("a.py", "py", "def f():\n    return 12 + 3\n"), ("b.py", "py", "x = 1 + 2"), ("c.c", "c", "int main() { return 0; }"), ("d.rs", "rs", "x"), ("e.md", "md", "# T\ntext"), ("g.txt", "txt", "a b c"), ("h.rs", "rs", "  "), ("i.rs", "rs", None))
    got = sorted((r["path"], r["chunk_type"]) for r in chunking.chunk_files(f).collect())
    assert got == [("a.py", "Function"), ("b.py", "Module"), ("c.c", "Module"), ("d.rs", "Module"), ("e.md", "Section"), ("g.txt", "Paragraph")]
    ids = [r["id"] for r in chunking.with_ids(chunking.chunk_files(f)).collect()]
    assert len(set(ids)) == len(ids)
    assert sorted(r["id"] for r in chunking.numbered(chunking.chunk_files(f)).collect()) == list(range(6))


def chunks(spark, rows):
    return spark.createDataFrame([(i, p, s, lang, t) for i, (p, s, lang, t) in enumerate(rows)], "id long, file_path string, line_start int, language string, content string")


def test_scans(spark):
    c = chunks(spark, [("a.rs", 10, "rs", "// hackathon todo\nx\n"), ("b.py", 1, "py", 'API_KEY = "x"\n-----BEGIN RSA PRIVATE KEY-----\neval(x) # nosec'), ("c.py", 1, None, None)])
    assert [(r["line"], r["kind"], r["language"]) for r in scans.scan_todos(c).collect()] == [(10, "TODO", "rs")]
    assert sorted((r["kind"], r["line"]) for r in scans.security_hits(c).collect()) == [("hardcoded_secret", 1), ("security_suppression", 3), ("unsafe_eval", 3)]
    assert ("exposed_private_key", 2) in {(r["kind"], r["line"]) for r in scans.security_hits(c, fix_private_keys=True).collect()}
    assert [r["severity"] for r in scans.scan_security(c, 2).collect()] == ["high", "medium"]
    assert {r["file_path"]: r["language"] for r in scans.file_list(c).collect()} == {"a.rs": "rs", "b.py": "py", "c.py": "py"}
    assert scans.sample_queries(c, 2).count() == 2
