import unicodedata

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import hashing, languages, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).collect()[0]["y"]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("retry_with_backoff", ["retry_with_backoff", "retry", "backoff"]),
        ("café Étre ß", ["cafe", "tre", "ß"]),
        ("a é1 x9", ["x9"]),
        ("the new type", []),
        ("", []),
        ("Data データ", None),
    ],
)
def test_tokens(spark, given, expected):
    got = one(spark, given, text.tokens)
    if expected is None:  # against the definition
        t = unicodedata.normalize("NFKD", given).lower()
        words = "".join(c if c.isalnum() else " " for c in t).split()
        expected = [w for w in words if len(w.encode()) >= 2 and w not in text.STOPWORDS]
    assert sorted(got) == sorted(expected)


def test_tokens_match_the_general_decomposition(spark):
    s = "Ünïcödé ǘ ñandú naïve_façade Ångström ήλιος"
    a = one(spark, s, text.tokens)
    b = spark.createDataFrame([(s,)], "x string").select(text.tokens(text.nfkd("x"), decompose=False).alias("y")).collect()[0]["y"]
    assert sorted(a) == sorted(b)
    assert one(spark, None, text.tokens) is None


def test_embedding_tokens(spark):
    assert sorted(one(spark, "the a_b cd_e", text.embedding_tokens)) == sorted(["the", "a_b", "cd_e", "cd"])


@pytest.mark.parametrize("given, expected", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\n", ["a", "b"]), ("a\n\n", ["a", ""]), ("\n", [""])])
def test_lines(spark, given, expected):
    assert one(spark, given, text.lines) == expected


def test_snippet(spark):
    body = "\n".join(f"line {i}" if i != 7 else "the keyword" for i in range(20))
    got = one(spark, body, lambda c: text.snippet(c, ["keyword"]))
    assert "the keyword" in got and got.endswith("\n  ...") and len(got.splitlines()) == 7
    assert one(spark, "x\ny", lambda c: text.snippet(c, ["z"])) == "x\ny"


def test_paths_ages_sizes(spark):
    assert one(spark, "/a/b/c.rs", text.last_two) == "b/c.rs"
    assert one(spark, "x" * 70, text.shorten_path) == "…/" + "x" * 60
    assert one(spark, "\\\\?\\C:\\a", text.clean_path) == "C:/a"
    assert [one(spark, s, text.http_method) for s in ("@app.get('/x')", "@app.route('/')", "@cached")] == ["GET", "ROUTE", None]
    assert one(spark, "7300", lambda c: text.ago(c)) == "2 h ago"
    assert text.human_size(1_500_000) == "1.5 MB" and text.human_size(12) == "12 B"


def test_languages(spark):
    rows = [("/a/x.rs", "rs"), ("/a/y.HPP", "cpp"), ("/a/Dockerfile", "dockerfile"), ("/a/z.xyz", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, l string").select(languages.language_of(F.col("p"))).collect()]
    assert got == [r[1] for r in rows]
    d = spark.createDataFrame([("RS ", "a.py"), ("golang", "a"), (None, "a.ts"), ("??", "a.c")], "l string, p string")
    assert [r[0] for r in d.select(languages.clean_language(F.col("l"), F.col("p"))).collect()] == ["rs", "go", "ts", "c"]
    assert languages.language_filter("C++") == "cpp" and languages.language_filter("nope") is None
    ig = spark.createDataFrame([("a/rebuild.rs",), ("a/b.min.js",), ("a/c.rs",)], "p string").select(languages.ignored(F.col("p"))).collect()
    assert [r[0] for r in ig] == [True, True, False]


def test_seeded_hash_matches_the_package(spark):
    import xxhash

    words = ["token", "Straße", "x" * 100, "a_b"]
    d = spark.createDataFrame([(w,) for w in words], "w string")
    for seed in range(3):
        got = [r[0] % 2**64 for r in d.select(hashing.seeded_hash(F.col("w"), seed)).collect()]
        assert got == [xxhash.xxh64_intdigest(w, seed) for w in words]


def test_embedding_is_the_same_on_both_sides(spark):
    texts = [(1, "retry_with_backoff http"), (2, ""), (3, "größe über alles")]
    got = {r["id"]: r["vec"] for r in hashing.embed(spark.createDataFrame(texts, "id long, t string"), "id", "t").collect()}
    for i, t in texts:
        assert max(abs(a - b) for a, b in zip(got[i], hashing.embed_text(t))) < 1e-12
    assert sum(x * x for x in got[1]) == pytest.approx(1) and not any(got[2])
