import json

import pytest

from lodegraph import api
from lodegraph.config import Config, ConfigError, IndexNotFound
from lodegraph.functions.hashing import embed_text
from lodegraph.sources import files


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    texts = {1: "fn load_ledger() { retry backoff }", 2: "// TODO fix\nfn parse_socket() {}", 3: "password = \"x\""}
    chunks = spark.createDataFrame([(i, f"/r/src/{i}.rs", 1, 3, "rs", "Function", t) for i, t in texts.items()], "id long, file_path string, line_start int, line_end int, language string, chunk_type string, content string")
    vectors = spark.createDataFrame([(i, i, embed_text(t)) for i, t in texts.items()], "embedding_id long, chunk_id long, vec array<float>")
    nodes = spark.createDataFrame([(1, "m", "module", "/r/src/1.rs", 1, 9, "rs", None), (2, "load_ledger", "function", "/r/src/1.rs", 1, 3, "rs", None), (3, "parse_socket", "function", "/r/src/2.rs", 1, 3, "rs", None)], "id int, name string, kind string, file_path string, line_start int, line_end int, language string, detail string")
    edges = spark.createDataFrame([(2, 3, "calls"), (1, 2, "contains")], "src int, dst int, kind string")
    folder = str(tmp_path_factory.mktemp("index"))
    files.save_index({"chunks": chunks, "vectors": vectors, "nodes": nodes, "edges": edges}, folder)
    return api.CodeIndex.load(spark, folder)


@pytest.mark.parametrize("tool, args, rows", [("search_code", {"query": "ledger backoff"}, None), ("find_callers", {"name": "parse_socket"}, 1), ("find_callees", {"name": "load_ledger"}, 1), ("get_endpoints", {}, 0), ("get_file_structure", {"path": "1.rs"}, 1), ("find_similar", {"text": "parse socket"}, None), ("get_stats", {}, 1), ("get_god_nodes", {"limit": 1}, 1), ("get_communities", {}, None), ("get_surprises", {}, 0), ("explain", {"query": "ledger"}, None), ("get_health_score", {}, 1), ("get_security_scan", {}, 1), ("blast_radius", {"file_path": "/r/src/2.rs"}, 1), ("get_languages", {}, 1), ("get_todos", {}, 1), ("get_files", {}, 3)])
def test_tools(index, tool, args, rows):
    got = api.call(index, tool, args).collect()
    assert got if rows is None else len(got) == rows


def test_best_hit_and_context(index):
    assert index.search_code("ledger backoff").collect()[0]["chunk_id"] == 1
    parts = {r["part"] for r in index.explain("ledger backoff").collect()}
    assert {"hit", "callee", "hub"} <= parts
    assert set(index.get_patterns()) == {"god_objects", "long_files", "high_coupling", "layer_violations", "singleton_suspects"}


def test_lines(index):
    ok = json.loads(api.handle(index, json.dumps({"id": 1, "method": "tools/call", "params": {"name": "find_callers", "arguments": {"name": "parse_socket"}}})))
    assert ok["result"]["rows"][0]["name"] == "load_ledger"
    for bad, code in (("{", -32602), (json.dumps({"id": 2, "method": "x"}), -32601), (json.dumps({"method": "tools/call", "params": {"name": "nope"}}), -32602)):
        assert json.loads(api.handle(index, bad))["error"]["code"] == code


def test_config(tmp_path, spark):
    p = str(tmp_path / "c.json")
    Config(watched_dirs=("/a",), limit=3).save(p)
    assert Config.load(p) == Config(watched_dirs=("/a",), limit=3)
    with pytest.raises(ConfigError):
        Config.load(str(tmp_path / "none"))
    with pytest.raises(IndexNotFound):
        api.CodeIndex.load(spark, str(tmp_path))
