"""Analytics over the code graph: nodes (id, name, kind, file_path, line_start, line_end, …) and edges (src, dst, kind).

Repeated nodes and edges count once. Every ranking has a total order (ties go to the smaller id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_in_loop as cut

# Thresholds and names of the health and pattern reports.
GOD_DEGREE, GOD_CALLS, LONG_FILE, HIGH_COUPLING, LISTED = 15, 15, 600, 8, 10
ENTRY_NAMES = ("main", "new", "run", "start", "stop", "default", "chunk", "embed")
KIND_ORDER = ("endpoint", "class", "struct", "trait", "function", "method", "module")
LAYERS = (
    ("test", ("/test", "_test", ".test.", "spec"), -2),
    ("ui", ("/component", "/ui/", "/views/", "/pages/"), 3),
    ("service", ("/service", "/api/", "/controller", "/handler"), 2),
    ("util", ("/util", "/helper", "/lib/"), 0),
    ("data", ("/model", "/store", "/repository", "/db/"), 1),
    ("config", ("/config", "/settings"), -1),
)


def clean_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where("id is not null").dropDuplicates(["id"])


def clean_edges(edges: DataFrame) -> DataFrame:
    return edges.where("src is not null and dst is not null").select("src", "dst", "kind").distinct()


def bare(name: Column) -> Column:
    """A name without its owner."""
    return F.substring_index(F.substring_index(name, "::", -1), ".", -1)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = clean_nodes(nodes)
    of = lambda *k: F.count_if(F.col("kind").isin(*k))
    s = n.agg(F.count("*").alias("total_nodes"), of("function").alias("functions"), of("method").alias("methods"), of("class", "struct", "trait").alias("classes"), of("endpoint").alias("endpoints"), of("module").alias("modules"))
    return s.join(F.broadcast(clean_edges(edges).agg(F.count("*").alias("total_edges"))))


def degrees(edges: DataFrame, kinds=("calls",)) -> DataFrame:
    """(id, in_degree, out_degree); both ends are counted in one aggregation, partially before the shuffle."""
    e = clean_edges(edges).where(F.col("kind").isin(*kinds))
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def god_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """The nodes with most calls in and out, modules apart."""
    n = clean_nodes(nodes).where("kind <> 'module'")
    d = degrees(edges).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    return n.join(d, "id").select("id", "name", "kind", "file_path", "degree").orderBy(F.desc("degree"), "id").limit(limit)


def _sides(edges: DataFrame) -> DataFrame:
    e = clean_edges(edges).where("kind in ('calls', 'imports')").select("src", "dst")
    return e.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("x")).select(F.col("x.src").alias("id"), F.col("x.dst").alias("nbr"))


def _turn(id: Column, draw: Column, half: int) -> Column:
    """Whether a node changes in this half of a pair of rounds: one of two sets of nodes, drawn anew with ``draw``."""
    x = F.pmod((F.pmod(id.cast("long"), F.lit(1_000_003)) + 1) * (draw * 7_919 + 40_503), F.lit(1_000_003))
    return F.pmod(F.shiftright(x * x, 7), F.lit(2)) == half


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, community): label propagation over calls and imports, both ways; a community is named by its label.

    Half the nodes (another half in every pair of rounds) change in a round, so two sides cannot swap labels for ever. A
    node takes its neighbours' most frequent label, keeps its own on a tie, else the smallest. Every node has its turn
    once in a pair of rounds, so a pair that changes nothing is the end. Labels are counted before the shuffle by node
    and label, so a hub is no single task. Only nodes with edges take part, and each pair of rounds is written once to
    the shared folder.
    """
    sides = cut(_sides(edges))
    linked = sides.select("id").distinct()
    every = clean_nodes(nodes).select("id", F.col("id").cast("long").alias("label"))
    labels = cut(every.join(linked, "id", "left_semi").withColumn("draw", F.lit(0).cast("long")))
    for _ in range(0, rounds, 2):
        # what changes from round to round is data, so every round runs the code compiled for the first
        step = labels.withColumn("old", F.col("label"))
        for half in (0, 1):
            votes = sides.join(step.select(F.col("id").alias("nbr"), "label"), "nbr").select("id", "label", F.lit(1).alias("n"), F.lit(0).alias("mine"), F.lit(None).cast("long").alias("old"), F.lit(None).cast("long").alias("draw"))
            own = step.select("id", "label", F.lit(0).alias("n"), F.lit(1).alias("mine"), "old", "draw")
            v = votes.unionByName(own).groupBy("id", "label").agg(F.sum("n").alias("n"), F.max("mine").alias("mine"), F.max("old").alias("old"), F.max("draw").alias("draw"))
            b = v.groupBy("id").agg(F.max(F.struct("n", "mine", (-F.col("label")).alias("low"))).alias("b"), F.max(F.when(F.col("mine") == 1, F.col("label"))).alias("own"), F.max("old").alias("old"), F.max("draw").alias("draw"))
            step = b.select("id", F.when(_turn(F.col("id"), F.col("draw"), half) & (F.col("b.n") > 0), -F.col("b.low")).otherwise(F.col("own")).alias("label"), "old", "draw")
        step = cut(step)
        labels = step.select("id", "label", (F.col("draw") + 1).alias("draw"))
        if not step.agg(F.count_if(F.col("label") != F.col("old"))).first()[0]:  # one job; isEmpty looks at few partitions a job
            break
    return every.select("id").join(labels, "id", "left").select("id", F.coalesce("label", F.col("id").cast("long")).alias("community"))


def surprise_edges(nodes: DataFrame, edges: DataFrame, community: DataFrame, limit: int = 15) -> DataFrame:
    """Calls between communities, those first whose pair of communities has fewest."""
    c = community.select("id", "community")
    e = clean_edges(edges).where("kind = 'calls'").select("src", "dst").join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst").where("a <> b")
    pairs = e.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    n = pairs.groupBy("lo", "hi").agg(F.count("*").alias("bridges"))
    return pairs.join(n, ["lo", "hi"]).select("src", "dst", "lo", "hi", "bridges").orderBy("bridges", "src", "dst").limit(limit)


def community_listing(nodes: DataFrame, community: DataFrame, limit: int = 8) -> DataFrame:
    """The largest communities: size (modules too), members that are no modules, their most frequent file, and the names
    of the first ``LISTED`` members by file, line and id (a listing shows so many; all are in ``communities``)."""
    n = clean_nodes(nodes).select("id", "name", "kind", "file_path", "line_start").join(community, "id")
    size = n.groupBy("community").agg(F.count("*").alias("size"), F.count_if(F.col("kind") != "module").alias("n_members"))
    top = size.orderBy(F.desc("size"), "community").limit(limit)
    files = n.where("kind <> 'module'").join(F.broadcast(top.select("community")), "community").groupBy("community", "file_path").count()
    mode = files.groupBy("community").agg(F.min_by("file_path", F.struct(-F.col("count"), F.col("file_path"))).alias("file_path"))
    return top.join(mode, "community", "left").join(community_members(nodes, community, top, LISTED).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("members")), "community", "left")


def community_members(nodes: DataFrame, community: DataFrame, which: DataFrame, most: int | None = None) -> DataFrame:
    """(community, rank, id, name, file_path): the members, modules apart, of the communities ``which``, by file, line and id."""
    n = clean_nodes(nodes).where("kind <> 'module'").select("id", "name", "file_path", "line_start").join(community, "id").join(which.select("community").distinct(), "community", "left_semi")
    w = Window.partitionBy("community").orderBy("file_path", "line_start", "id")
    m = n.withColumn("rank", F.row_number().over(w))  # a window with a rank below a bound keeps the first rows of each task only
    return (m.where(F.col("rank") <= most) if most else m).select("community", "rank", "id", "name", "file_path")


def reach(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth): nodes that depend on ``start`` (id) over imports and calls, by least depth: breadth first, backwards.

    Each round joins only the last frontier and drops what was reached before; ``depth`` bounds the rounds.
    """
    back = cut(clean_edges(edges).where("kind in ('calls', 'imports')").select(F.col("dst").alias("id"), F.col("src").alias("next")).distinct())
    seen = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, d = seen, 0
    while depth is None or d < depth:
        d += 1
        new = back.join(frontier.select("id"), "id").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        new = cut(new)
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
        frontier = new
    return seen


def blast_radius(nodes: DataFrame, edges: DataFrame, file_path: str) -> DataFrame:
    """(path, depth): other files that depend on a file, nearest first."""
    n = clean_nodes(nodes).select("id", "file_path")
    r = reach(nodes, edges, n.where(F.col("file_path") == file_path).select("id"))
    return r.join(n, "id").where(F.col("file_path") != file_path).groupBy(F.col("file_path").alias("path")).agg(F.min("depth").alias("depth"))


def blast_risk(affected: DataFrame) -> DataFrame:
    """One row: affected files and the risk score: 8 a file up to 70, and the depth up to 30."""
    a = affected.agg(F.count("*").alias("total_files"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"))
    return a.select("total_files", F.least(F.lit(100), F.least(F.lit(70), F.col("total_files") * 8) + F.least(F.lit(30), F.col("deepest"))).cast("int").alias("risk_score"))


def _named(nodes: DataFrame, name: str) -> DataFrame:
    return clean_nodes(nodes).where((F.col("name") == name) | F.col("name").endswith("::" + name))


def callers(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Nodes that call one of this name."""
    ids = _named(nodes, name).select(F.col("id").alias("dst"))
    e = clean_edges(edges).where("kind = 'calls'").join(ids, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return clean_nodes(nodes).join(e, "id", "left_semi").select("id", "name", "kind", "file_path", "line_start")


def callees(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Nodes that one of this name calls."""
    ids = _named(nodes, name).select(F.col("id").alias("src"))
    e = clean_edges(edges).where("kind = 'calls'").join(ids, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return clean_nodes(nodes).join(e, "id", "left_semi").select("id", "name", "kind", "file_path", "line_start")


def endpoints(nodes: DataFrame) -> DataFrame:
    return clean_nodes(nodes).where("kind = 'endpoint'").select("id", "name", "file_path", "line_start", "detail")


def kind_order(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, i) for i, k in enumerate(KIND_ORDER)), F.lit(len(KIND_ORDER)))


def file_structure(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """What the first module contains whose path is, ends with, or contains the query, by kind and line."""
    n = clean_nodes(nodes)
    p, q = F.lower("file_path"), query.lower()
    fit = F.when(F.col("file_path") == query, 0).when(p.endswith("/" + q), 1).when(F.contains(p, F.lit(q)), 2)
    module = n.where((F.col("kind") == "module") & fit.isNotNull()).orderBy("id").limit(1).select(F.col("id").alias("src"))
    kids = clean_edges(edges).where("kind = 'contains'").join(F.broadcast(module), "src").select(F.col("dst").alias("id"))
    return n.join(kids, "id", "left_semi").select("id", "name", "kind", "line_start", "line_end", kind_order(F.col("kind")).alias("rank")).orderBy("rank", "line_start", "id")


def degree_gods(nodes: DataFrame, edges: DataFrame, least: int = GOD_DEGREE) -> DataFrame:
    """Functions and methods with ``least`` calls in and out, or more."""
    d = degrees(edges).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree")).where(F.col("degree") >= least)
    return clean_nodes(nodes).where("kind in ('function', 'method')").join(d, "id").select("id", "name", "file_path", "degree")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that nobody calls, private and entry names apart."""
    called = clean_edges(edges).where("kind = 'calls'").select(F.col("dst").alias("id")).distinct()
    f = clean_nodes(nodes).where("kind = 'function'").withColumn("bare", F.substring_index("name", "::", -1))
    return f.where(~F.col("bare").startswith("_") & ~F.col("bare").isin(*ENTRY_NAMES)).join(called, "id", "left_anti").select("id", "name", "file_path")


def long_files(nodes: DataFrame, over: int = LONG_FILE) -> DataFrame:
    return clean_nodes(nodes).where((F.col("kind") == "module") & (F.col("line_end") - F.col("line_start") > over)).select("id", "file_path", (F.col("line_end") - F.col("line_start")).alias("n_lines"))


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: imports, modules, and imports a module in whole numbers."""
    m = clean_nodes(nodes).agg(F.count_if(F.col("kind") == "module").alias("n_modules"))
    i = clean_edges(edges).agg(F.count_if(F.col("kind") == "imports").alias("n_imports"))
    return m.join(F.broadcast(i)).select("n_modules", "n_imports", F.when(F.col("n_modules") > 0, F.expr("n_imports div n_modules")).otherwise(F.lit(0)).cast("long").alias("avg_coupling"))


def _imports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    m = clean_nodes(nodes).where("kind = 'module'").select("id")
    e = clean_edges(edges).where("kind = 'imports' and src <> dst").select("src", "dst")
    return e.join(m.withColumnRenamed("id", "src"), "src", "left_semi").join(m.withColumnRenamed("id", "dst"), "dst", "left_semi")


def lifted(nodes: DataFrame, edges: DataFrame, kinds=("imports", "calls")) -> DataFrame:
    """Edges between definitions as imports between the modules of their files."""
    module = clean_nodes(nodes).where("kind = 'module'").groupBy("file_path").agg(F.min("id").alias("module"))
    at = clean_nodes(nodes).select("id", "file_path").join(module, "file_path").select("id", "module")
    e = clean_edges(edges).where(F.col("kind").isin(*kinds)).join(at.toDF("src", "a"), "src").join(at.toDF("dst", "b"), "dst").where("a <> b")
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("imports").alias("kind")).distinct()


def cyclic_modules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cycle): modules on import cycles, by strongly connected component (its smallest id).

    Each round trims leaves, from both ends, so only what may be cyclic goes on. Components then come by forward and
    backward labels: every node learns the smallest id that reaches it and that it reaches; where both agree it belongs
    to that id's component, and the rest goes round again until no edge is left: a round settles the smallest id left
    at least, so it ends.
    """
    e = cut(_imports(nodes, edges).distinct())
    done: DataFrame | None = None
    left = e.count()
    while left:
        t = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        e = cut(t.select("src", "dst"))
        before, left = left, e.count()
        if left < before:
            continue
        ids = cut(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
        fwd, bwd = _least_label(ids, e, "src", "dst"), _least_label(ids, e, "dst", "src")
        both = cut(fwd.withColumnRenamed("label", "f").join(bwd.withColumnRenamed("label", "b"), "id"))
        comp = both.where("f = b").select("id", F.col("f").alias("cycle"))
        done = comp if done is None else done.unionByName(comp)
        e = cut(e.join(comp.select(F.col("id").alias("src")), "src", "left_anti").join(comp.select(F.col("id").alias("dst")), "dst", "left_anti"))
        left = e.count()
    if done is None:
        return clean_nodes(nodes).select("id", F.col("id").alias("cycle")).where(F.lit(False))
    size = done.groupBy("cycle").count().where("count > 1").select("cycle")
    return done.join(size, "cycle", "left_semi").select("id", "cycle")


def _least_label(ids: DataFrame, e: DataFrame, a: str, b: str) -> DataFrame:
    labels = cut(ids.select("id", F.col("id").alias("label")))
    while True:
        got = e.join(labels.withColumnRenamed("id", a), a).groupBy(F.col(b).alias("id")).agg(F.min("label").alias("new"))
        step = cut(labels.join(got, "id", "left").select("id", F.least("label", F.coalesce("new", "label")).alias("label"), F.col("label").alias("old")))
        labels = step.select("id", "label")
        if not step.agg(F.count_if(F.col("label") != F.col("old"))).first()[0]:
            return labels


def health_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of cycles, hubs, orphans (20 at most), long files, coupling; penalties, score and grade."""
    one = lambda d, name, cap=None: d.agg(F.least(F.count("*"), F.lit(cap)).alias(name) if cap else F.count("*").alias(name))
    r = one(cyclic_modules(nodes, edges).select("cycle").distinct(), "n_cycles", 10)
    for d in (one(degree_gods(nodes, edges), "n_gods"), one(orphans(nodes, edges), "n_orphans", 20), one(long_files(nodes), "n_long"), coupling(nodes, edges).select("avg_coupling")):
        r = r.join(F.broadcast(d))
    penalty = (
        F.least(F.col("n_cycles") * 15, F.lit(40)) + F.least(F.col("n_gods") * 5, F.lit(25)) + F.least(F.expr("n_orphans div 25"), F.lit(10)) + F.least(F.col("n_long") * 3, F.lit(15))
        + F.when(F.col("avg_coupling") > 10, 15).when(F.col("avg_coupling") > 5, 7).otherwise(0)
    )
    score = F.greatest(F.lit(100) - penalty, F.lit(0)).cast("int")
    grade = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    return r.select("n_cycles", "n_gods", "n_orphans", "n_long", "avg_coupling", score.alias("score"), grade.alias("grade"))


def call_hubs(nodes: DataFrame, edges: DataFrame, least: int = GOD_CALLS) -> DataFrame:
    """Nodes of any kind that make ``least`` calls or more."""
    d = degrees(edges).where(F.col("out_degree") >= least).select("id", F.col("out_degree").alias("calls"))
    return clean_nodes(nodes).join(d, "id").select("id", "name", "file_path", "calls")


def high_coupling(nodes: DataFrame, edges: DataFrame, over: int = HIGH_COUPLING) -> DataFrame:
    """Files whose modules import more than ``over`` times."""
    m = clean_nodes(nodes).where("kind = 'module'").select(F.col("id").alias("src"), "file_path")
    return clean_edges(edges).where("kind = 'imports'").join(m, "src").groupBy("file_path").agg(F.count("*").alias("imports")).where(F.col("imports") > over)


def layer(path: Column) -> Column:
    """The layer of a path: the first whose marks it contains."""
    p = F.lower(path)
    return F.coalesce(*(F.when(F.greatest(*(F.contains(p, F.lit(m)).cast("int") for m in marks), F.lit(0)) == 1, name) for name, marks, _ in LAYERS))


def layer_rank(name: Column) -> Column:
    return F.coalesce(*(F.when(name == n, r) for n, _, r in LAYERS))


def layer_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Imports from a lower layer to a higher one."""
    n = clean_nodes(nodes).where("kind = 'module'").select("id", "file_path", layer(F.col("file_path")).alias("layer")).where("layer is not null")
    a, b = n.toDF("src", "from_path", "from_layer"), n.toDF("dst", "to_path", "to_layer")
    e = clean_edges(edges).where("kind = 'imports'").join(a, "src").join(b, "dst")
    return e.where(layer_rank(F.col("from_layer")) < layer_rank(F.col("to_layer"))).select("src", "dst", "from_path", "to_path", "from_layer", "to_layer")


def singleton_suspects(nodes: DataFrame) -> DataFrame:
    """Structs and classes named like singletons."""
    low = F.lower("name")
    return clean_nodes(nodes).where(F.col("kind").isin("struct", "class") & (F.contains(low, F.lit("singleton")) | F.contains(low, F.lit("registry")) | low.isin("config", "settings"))).select("id", "name", "file_path")


def churn(log: DataFrame, limit: int = 200) -> DataFrame:
    """(path, commits, owner) from log lines (pos, line): an author's line, then the files of the commit.

    The author is carried forward by range partitions: each takes the last author before it, so no window holds the log.
    """
    line = F.trim("line")
    is_author = F.contains(line, F.lit("@")) & ~F.contains(line, F.lit("/"))
    is_file = ~is_author & (F.contains(line, F.lit(".")) | F.contains(line, F.lit("/"))) & ~line.startswith("[")
    d = log.where(F.length(line) > 0).select("pos", F.when(is_author, line).alias("author"), F.when(is_file, line).alias("path"))
    d = d.repartitionByRange("pos").sortWithinPartitions("pos").withColumn("part", F.spark_partition_id())
    last = d.where("author is not null").groupBy("part").agg(F.max_by("author", "pos").alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.select("part").distinct().join(last, "part", "left").select("part", F.last("last", ignorenulls=True).over(before).alias("carried"))  # a row a partition
    here = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(F.broadcast(parts), "part").select("path", F.coalesce(F.last("author", ignorenulls=True).over(here), "carried").alias("author")).where("path is not null")
    by = d.groupBy("path", "author").agg(F.count("*").alias("n"))
    return by.groupBy("path").agg(F.sum("n").alias("commits"), F.min_by("author", F.struct(-F.col("n"), F.col("author"))).alias("owner")).orderBy(F.desc("commits"), "path").limit(limit)


def enclosing_definition(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """For points (point_id, file_path, line) the innermost function or method around them: (point_id, id, name).

    The join is by file; where a file has very many of both, lines are cut into bands, and a definition stands in each
    band it touches, so a hot file is many small joins.
    """
    band = 256
    d = clean_nodes(nodes).where("kind in ('function', 'method') and line_end >= line_start").select("id", "name", "file_path", F.col("line_start").alias("s"), F.col("line_end").alias("e"))
    d = d.withColumn("band", F.explode(F.sequence(F.floor(F.col("s") / band), F.floor(F.col("e") / band))))
    p = points.withColumn("band", F.floor(F.col("line") / band))
    j = p.join(d, ["file_path", "band"]).where((F.col("s") <= F.col("line")) & (F.col("line") <= F.col("e")))
    return j.groupBy("point_id").agg(F.min(F.struct((F.col("line") - F.col("s")).alias("d"), "id", "name")).alias("m")).select("point_id", F.col("m.id").alias("id"), F.col("m.name").alias("name"))


def neighbourhood(edges: DataFrame, node_id: int) -> DataFrame:
    """A node and its neighbours over edges of any kind."""
    e = clean_edges(edges)
    other = e.where((F.col("src") == node_id) | (F.col("dst") == node_id)).select(F.explode(F.array("src", "dst")).alias("id"))
    return other.unionByName(e.sparkSession.range(1).select(F.lit(node_id).cast(e.schema["src"].dataType).alias("id"))).distinct()


def filter_edges(edges: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Edges of the kinds a viewer shows; all if none is named."""
    e = clean_edges(edges)
    return e.where(F.col("kind").isin(*kinds)) if kinds else e


def filter_graph(nodes: DataFrame, text: str | None = None) -> DataFrame:
    """Nodes whose name or path contains a text, whatever its case."""
    n = clean_nodes(nodes)
    return n if not text else n.where(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("file_path"), F.lit(text.lower())))
