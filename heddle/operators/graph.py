"""Typed graphs: scans, joins, traversal, centrality and propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heddle.functions.predicates import is_test_symbol
from heddle.sources.tables import checkpointed, dropped, few, settled

#: Edges out of one node from which on they are dealt over several tasks.
HUB = 100_000


def scan(nodes: DataFrame, *labels: str) -> DataFrame:
    return nodes.where(F.col("label").isin(*labels)) if labels else nodes


def related(edges: DataFrame, nodes: DataFrame, name: str, incoming: bool) -> DataFrame:
    """Callers (or callees) of a symbol with their places; the first place of each wins."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    ends = edges.where(F.col(here) == name).select(F.col(there).alias("qualified_name")).distinct()
    rows = nodes.join(ends, "qualified_name")
    placed = rows.select("qualified_name", F.coalesce("path", F.lit("")).alias("file_path"), F.coalesce("start_line", F.lit(0)).alias("line_number"))
    rn = F.row_number().over(W.partitionBy("qualified_name").orderBy("file_path", "line_number"))
    return placed.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def located(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """Place of every key; an empty one for those that have none."""
    rn = F.row_number().over(W.partitionBy("qualified_name").orderBy("path", "start_line"))
    first = nodes.where("path IS NOT NULL").withColumn("_rn", rn).where("_rn = 1").select("qualified_name", "path", "start_line", "end_line")
    return keys.join(first, "qualified_name", "left").select("qualified_name", F.coalesce("path", F.lit("")).alias("file_path"), F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"))


#: Projects whose names a row may hold, so that nodes are compared where they lie.
FEW_PROJECTS = 1000


def with_project(nodes: DataFrame, projects: DataFrame, strict: bool = False) -> DataFrame:
    """Each node with the project whose name is the longest prefix of its own, if any.

    Up to FEW_PROJECTS projects are one row that all tasks have, and no node is moved. Of more, a name's
    prefixes are few, so they are exploded and joined by equality; nothing is compared with everything.
    ``strict`` asks for a dot after the prefix.
    """
    name = F.col("qualified_name")
    named = projects.where("project IS NOT NULL").select("project").distinct()
    if named.limit(FEW_PROJECTS + 1).count() <= FEW_PROJECTS:
        row = named.agg(F.collect_list("project").alias("_projects"))  # at most FEW_PROJECTS
        of = lambda p: (name == p) | name.startswith(F.concat(p, F.lit("."))) if strict else name.startswith(p) & ((p != "") | (name == ""))
        found = F.filter("_projects", of)
        longest = F.array_max(F.transform(found, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
        return nodes.join(F.broadcast(row), how="cross").withColumn("project", longest).drop("_projects")  # one row
    if strict:
        parts = F.split(name, r"\.")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    else:
        prefixes = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, F.lit(1), i))
    found = nodes.select("qualified_name", F.explode(prefixes).alias("project")).join(few(named), "project", "left_semi")
    best = found.groupBy("qualified_name").agg(F.max_by("project", F.length("project")).alias("project"))
    return nodes.join(best, "qualified_name", "left")


def inbound_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counts = edges.groupBy(F.col("dst").alias("qualified_name")).agg(F.count("src").alias("callers"))
    return nodes.join(counts, "qualified_name", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))


def member_names(classes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sorted names of what each class has, an empty list for nothing."""
    m = edges.join(nodes.select(F.col("qualified_name").alias("dst"), "name"), "dst").groupBy(F.col("src").alias("qualified_name")).agg(F.array_sort(F.collect_list("name")).alias("members"))
    return classes.join(m, "qualified_name", "left").withColumn("members", F.coalesce("members", F.array().cast("array<string>")))


def orphans(packages: DataFrame, *children: DataFrame) -> DataFrame:
    """Rows that no child table points at by ``parent``."""
    out = packages
    for c in children:
        out = out.join(c.select(F.col("parent").alias("qualified_name")), "qualified_name", "left_anti")
    return out


#: Times the edges that the pointers of ``closure`` may be.
POINTERS = 4
#: Steps down from the roots that ``closure`` takes before it follows pointers up from all nodes.
FIRST_STEPS = 4


def breadth_first(edges: DataFrame, seeds: DataFrame, depth: int, caller_cap: int = 0, exclude_tests: bool = False) -> DataFrame:
    """Least depth at which each node is reached from the seeds along (src, dst): qualified_name, depth.

    With ``caller_cap``, up to so many callers of each seed, by name and none of them tests, join
    the frontier at depth 1 before the first hop.  Edges are settled once, by their sources.  A hop is
    a join of the frontier with them less what is known, settled before the next.
    """
    edges = checkpointed(edges.select("src", "dst").repartition("src"))
    known = settled(seeds.select("qualified_name", F.lit(0).alias("depth")).distinct())
    frontier = known.select("qualified_name")
    if caller_cap > 0 and depth > 0:
        up = edges.join(frontier.withColumnRenamed("qualified_name", "dst"), "dst", "left_semi").where(~is_test_symbol(F.col("src"))).select("src", "dst").distinct()
        up = up.withColumn("_rn", F.row_number().over(W.partitionBy("dst").orderBy("src"))).where(F.col("_rn") <= caller_cap)
        new = settled(up.select(F.col("src").alias("qualified_name")).distinct().join(known, "qualified_name", "left_anti"))
        known = known.unionByName(new.withColumn("depth", F.lit(1)))
        frontier = frontier.unionByName(new)
    for hop in range(depth):
        out = edges.join(frontier.withColumnRenamed("qualified_name", "src"), "src", "left_semi").select(F.col("dst").alias("qualified_name")).distinct()
        if exclude_tests:
            out = out.where(~is_test_symbol(F.col("qualified_name")))
        new = settled(out.join(known, "qualified_name", "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new.withColumn("depth", F.lit(hop + 1)))
        frontier = new
    return known


def pagerank(edges: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, nodes: DataFrame | None = None) -> DataFrame:
    """qualified_name, pagerank.  Repeated edges count once, self-loops stay, the rank of nodes
    without edges out is spread evenly.  Stops when the summed change falls below n * tolerance;
    with tolerance 0 after exactly ``iterations``; empty if it does not settle.

    Names are written once, beside their hashes; what moves in each round are these, or the names themselves should two
    share a hash.  A node's edges are one row, a hub's one for every HUB of them."""
    raw = settled(edges.where("src IS NOT NULL").select("src", "dst"))
    names = raw.select(F.col("src").alias("qualified_name")).unionByName(raw.select(F.col("dst").alias("qualified_name")))
    names = (names.unionByName(nodes.select("qualified_name")) if nodes is not None else names).distinct()
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    names = settled(names.withColumn("_id", hashed("qualified_name")))
    if names.groupBy("_id").count().where("count > 1").isEmpty():
        ends = raw.select(hashed("src").alias("_id"), hashed("dst").alias("_dst"))
    else:
        plain = names.withColumn("_id", F.col("qualified_name"))
        names, ends = plain, raw.select(F.col("src").alias("_id"), F.col("dst").alias("_dst"))
    hubs = ends.groupBy("_id").agg(F.count("*").alias("_n")).where(F.col("_n") > HUB).select("_id", F.ceil(F.col("_n") / F.lit(HUB)).cast("int").alias("_salts"))
    salted = ends.join(few(settled(hubs)), "_id", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    salted = salted.withColumn("_salt", F.when(F.col("_salts") > 1, F.pmod(F.xxhash64("_dst"), "_salts")).otherwise(0).cast("int"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = salted.repartition(parts, "_id", "_salt").distinct()
    links = checkpointed(once.groupBy("_id", "_salt").agg(F.first("_salts").alias("_salts"), F.count("*").alias("_n"), F.collect_list("_dst").alias("_dsts")))
    out = links.groupBy("_id").agg(F.sum("_n").alias("_out"), F.max("_salts").alias("_salts"))
    ids = settled(names.select("_id").join(out, "_id", "left"))
    dropped(raw)
    n = ids.count()
    if not n:
        return names.select("qualified_name", F.lit(0.0).alias("pagerank"))
    before, ranks = ids, ids.withColumn("pagerank", F.lit(1.0 / n))
    settles = not tolerance
    for _ in range(iterations):
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("_out").isNull(), F.col("pagerank"))), F.lit(0.0)).alias("_loose"))
        share = ranks.where("_out IS NOT NULL").select("_id", (F.col("pagerank") / F.col("_out")).alias("_share"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
        given = links.join(share, ["_id", "_salt"]).select(F.explode("_dsts").alias("_id"), "_share").groupBy("_id").agg(F.sum("_share").alias("_in"))
        base = F.lit((1 - alpha) / n) + F.lit(alpha / n) * F.col("_loose")
        after = ranks.join(given, "_id", "left").join(F.broadcast(loose), how="cross")  # one row
        after = settled(after.select("_id", "_out", "_salts", F.col("pagerank").alias("_before"), (base + F.lit(alpha) * F.coalesce("_in", F.lit(0.0))).alias("pagerank")))
        change = after.agg(F.sum(F.abs(F.col("pagerank") - F.col("_before")))).first()[0] if tolerance else None
        dropped(before)
        before, ranks = after, after.drop("_before")
        if change is not None and change < n * tolerance:
            settles = True
            break
    named = names.select("qualified_name", F.col("_id").alias("_name"))
    ranked = ranks.join(named, F.col("_id").eqNullSafe(F.col("_name"))).select("qualified_name", "pagerank")
    return ranked if settles else ranked.limit(0)


def by_greatest(ranks: DataFrame) -> DataFrame:
    """Score over the greatest score."""
    top = ranks.agg(F.max("pagerank").alias("_top"))
    return ranks.join(F.broadcast(top), how="cross").withColumn("pagerank", F.col("pagerank") / F.nullif("_top", F.lit(0.0))).drop("_top")  # one row


def by_range(ranks: DataFrame) -> DataFrame:
    """Scores from 0 to 1; all 1 if they are all equal."""
    ends = ranks.agg(F.min("pagerank").alias("_lo"), F.max("pagerank").alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col("pagerank") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    return ranks.join(F.broadcast(ends), how="cross").withColumn("pagerank", scaled).drop("_lo", "_hi")  # one row


def overview(edges: DataFrame, rels: list[str], most: int) -> DataFrame:
    """Edges of the wanted types between the first ``most`` nodes to appear, in the order type, src,
    dst, of at most five times as many edges."""
    few = edges.where(F.col("rel").isin(*rels)).select("rel", "src", "dst").orderBy("rel", "src", "dst").limit(5 * most)
    few = few.withColumn("_at", F.row_number().over(W.orderBy("rel", "src", "dst")))  # at most 5 * most rows
    ends = few.select(F.col("src").alias("id"), (F.col("_at") * 2).alias("_p")).unionByName(few.select(F.col("dst").alias("id"), (F.col("_at") * 2 + 1).alias("_p")))
    first = ends.groupBy("id").agg(F.min("_p").alias("_p")).orderBy("_p").limit(most).select("id")
    ok = few.join(F.broadcast(first.withColumnRenamed("id", "src")), "src", "left_semi").join(F.broadcast(first.withColumnRenamed("id", "dst")), "dst", "left_semi")
    return ok.select("rel", "src", "dst")


def propagated(seeds: DataFrame, edges: DataFrame, depths: DataFrame, decay: float = 0.5, ceiling: float = 0.99) -> DataFrame:
    """Scores of what is reached: a seed keeps its own; others get half their best parent's, at most
    a bit less than the least seed's, level by level."""
    floor = seeds.agg(F.min("score")).first()[0] or 0.0
    done = settled(seeds.select("qualified_name", "score"))
    deepest = depths.agg(F.max("depth")).first()[0] or 0
    for d in range(1, deepest + 1):
        here = depths.where(F.col("depth") == d).select("qualified_name")
        best = edges.select(F.col("src").alias("_s"), F.col("dst").alias("qualified_name")).join(here, "qualified_name", "left_semi").join(done.select(F.col("qualified_name").alias("_s"), "score"), "_s")
        level = best.groupBy("qualified_name").agg(F.max("score").alias("score")).join(done, "qualified_name", "left_anti")
        done = done.unionByName(settled(level.withColumn("score", F.least(F.col("score") * decay, F.lit(ceiling * floor)))))
    return done


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All that roots contain, at any depth, themselves included, in rounds that grow with the logarithm of the depth.

    The first FIRST_STEPS levels are found from the roots down; where there are no more, no other node is touched.  Then each node not yet known to be inside points to those so many steps above it, at first one.  In a
    round, the nodes that point at an inside one are inside; the others point twice as far.  A node
    with nothing that far above drops out.  Where nodes have so many parents that the pointers grow to over
    POINTERS times the edges, they become edges of their own, and what is left is found step by step along both.
    """
    every = settled(edges.select(F.col("dst").alias("node"), F.col("src").alias("above")))
    new = found = settled(roots.select("qualified_name").distinct())
    for _ in range(FIRST_STEPS):
        out = every.join(few(new.withColumnRenamed("qualified_name", "above")), "above", "left_semi").select(F.col("node").alias("qualified_name")).distinct()
        new = settled(out.join(few(found), "qualified_name", "left_anti"))
        if new.isEmpty():
            return found
        found = found.unionByName(new)
    up = settled(every.distinct())
    n = up.count()
    pairs = settled(up.join(found.withColumnRenamed("qualified_name", "node"), "node", "left_anti"))
    for _ in range(max(1, n).bit_length() + 1):  # no way without a cycle is longer than the edges
        if pairs.isEmpty():
            return found
        new = settled(pairs.join(found.withColumnRenamed("qualified_name", "above"), "above", "left_semi").select(F.col("node").alias("qualified_name")).distinct())
        found = found.unionByName(new)
        left = pairs.join(new.withColumnRenamed("qualified_name", "node"), "node", "left_anti")
        further = pairs.select(F.col("node").alias("above"), F.col("above").alias("_top"))
        before, pairs = pairs, settled(left.join(further, "above").select("node", F.col("_top").alias("above")).where("node <> above").distinct())
        if pairs.count() > POINTERS * n:
            return _stepped(found, up.unionByName(before))
        dropped(before)
    return found


def _stepped(found: DataFrame, up: DataFrame) -> DataFrame:
    """All below what is found, one step of (node, above) after another."""
    up = checkpointed(up.repartition("above"))
    new = found = settled(found)
    while True:
        out = up.join(new.withColumnRenamed("qualified_name", "above"), "above", "left_semi").select(F.col("node").alias("qualified_name")).distinct()
        new = settled(out.join(found, "qualified_name", "left_anti"))
        if new.isEmpty():
            return found
        found = found.unionByName(new)


def without_project(nodes: DataFrame, edges: DataFrame, project: str, containers: list[str], definitions: list[str]) -> DataFrame:
    """Nodes left when a project goes with all that it contains, at any depth, and what that defines."""
    root = edges.sparkSession.createDataFrame([(project,)], "qualified_name string")
    inside = closure(edges.where(F.col("rel").isin(*containers)), root)
    gone = closure(edges.where(F.col("rel").isin(*definitions)), inside)
    return nodes.join(few(gone), "qualified_name", "left_anti")


def without_module(nodes: DataFrame, edges: DataFrame, module: str) -> DataFrame:
    """Nodes left when a module goes with what it defines and their methods."""
    defined = edges.where((F.col("rel") == "DEFINES") & (F.col("src") == module)).select(F.col("dst").alias("qualified_name"))
    methods = edges.where("rel = 'DEFINES_METHOD'").join(defined.withColumnRenamed("qualified_name", "src"), "src", "left_semi").select(F.col("dst").alias("qualified_name"))
    gone = defined.unionByName(methods).distinct()
    return nodes.where(F.col("qualified_name") != module).join(gone, "qualified_name", "left_anti")


def paged(df: DataFrame, offset: int, limit: int, by: list[str] | None = None) -> tuple[DataFrame, bool]:
    """A page in the order of some columns, or of all, and whether there are more rows."""
    order = by or df.columns
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    more = rows.count() > limit
    return rows.orderBy(*order).limit(limit), more


def listed_by_rank(ranked: DataFrame, path: str, rank: str, extension: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """Files of lexical hits, each once, in the order of their best hit: path, name, extension."""
    best = ranked.where(F.coalesce(F.col(path), F.lit("")) != "").groupBy(F.col(path).alias("path")).agg(F.min(rank).alias("_r"))
    name = F.element_at(F.split("path", "/"), -1)
    out = best.select("path", name.alias("name"), F.regexp_extract(name, r"(\.[^.]+)$", 1).alias("extension"), "_r")
    out = out.where(F.col("extension") == "." + extension.lstrip(".")) if extension else out
    return out.orderBy("_r", "path").offset(max(offset, 0)).limit(max(1, min(5000, limit))).drop("_r")


def listed_files(df: DataFrame, path: str, contains: str = "", extension: str = "") -> DataFrame:
    """Files by part of the path, in any case, and extension: path, name, extension."""
    p = F.col(path)
    name = F.element_at(F.split(p, "/"), -1)
    ext = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    out = df.select(p.alias("path"), name.alias("name"), ext.alias("extension")).where(F.lower("path").contains(contains.lower()))
    return out.where(F.col("extension") == "." + extension.lstrip(".")) if extension else out


def repository_stats(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, roots: DataFrame) -> DataFrame:
    """A row for each repository that is known, has nodes or has embeddings: repo, root, nodes, relations and
    embeddings.  nodes: repo, qualified_name; vectors: repo; roots: repo, root.  A relation counts for the repository
    of its source."""
    where = nodes.select(F.col("qualified_name").alias("src"), "repo")
    counted = {"nodes": nodes.select("repo"), "relations": edges.select("src").join(where, "src").select("repo"), "embeddings": vectors.select("repo")}
    out = roots.select("repo", "root", *[F.lit(0).cast("long").alias(n) for n in counted])
    for name, rows in counted.items():
        n = rows.groupBy("repo").agg(F.count("*").alias(name))
        out = out.unionByName(n.withColumns({"root": F.lit(None).cast("string")} | {m: F.lit(0).cast("long") for m in counted if m != name}))
    return out.groupBy("repo").agg(F.max("root").alias("root"), *[F.sum(n).alias(n) for n in counted])


def observed_schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A description of a graph from its rows: kind, line, n and with_path.  A line for each label, with how many of its
    nodes have a path, and one for each pair of labels that a relation joins; edges without an end are left out."""
    kinds = nodes.groupBy("label").agg(F.count("*").alias("n"), F.count("path").alias("with_path"))
    one = kinds.select(F.lit("node").alias("kind"), F.concat(F.lit("("), "label", F.lit(")")).alias("line"), "n", "with_path")
    ends = lambda side: nodes.select(F.col("qualified_name").alias(side), F.col("label").alias(f"_{side}"))
    joined = edges.select("src", "rel", "dst").join(ends("src"), "src").join(ends("dst"), "dst").groupBy("_src", "rel", "_dst").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("("), "_src", F.lit(")-["), "rel", F.lit("]->("), "_dst", F.lit(")"))
    return one.unionByName(joined.select(F.lit("relation").alias("kind"), line.alias("line"), "n", F.lit(0).cast("long").alias("with_path")))


def type_counts(nodes: DataFrame, labels: list[str] | None = None, non_zero: bool = False) -> DataFrame:
    """Nodes of each label; labels asked for without nodes count 0, or are left out if ``non_zero``."""
    counts = nodes.groupBy("label").agg(F.count("*").alias("n"))
    if labels is None:
        return counts
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(x,) for x in labels], "label string")
    out = wanted.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.where("n > 0") if non_zero else out


def central(ranks: DataFrame, limit: int = 20, nodes: DataFrame | None = None) -> DataFrame:
    """The most central symbols, 1 to 500 of them, with their places if ``nodes`` are given, and the
    latest time at which one of these was computed: qualified_name, pagerank, last_computed_at."""
    top = ranks.orderBy(F.desc("pagerank"), "qualified_name").limit(max(1, min(500, limit)))
    last = top.agg(F.max("computed_at").alias("last_computed_at"))
    out = top.select("qualified_name", "pagerank").join(F.broadcast(last), how="cross")  # one row
    return out.join(located(out.select("qualified_name"), nodes), "qualified_name") if nodes is not None else out


def with_prefix(names: DataFrame, prefix: str) -> DataFrame:
    """Registered names below a prefix."""
    return names.where(F.col("qualified_name").startswith(prefix + "."))


def ending_with(names: DataFrame, suffix: str) -> DataFrame:
    """Registered names whose last parts are ``suffix``."""
    return names.where((F.col("qualified_name") == suffix) | F.col("qualified_name").endswith("." + suffix))


def hits_with_nodes(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vector hits with their nodes' label, name and path, the best first; hits without a node are dropped."""
    known = nodes.dropDuplicates(["qualified_name"]).select("qualified_name", "label", "name", "path")
    return hits.join(known, "qualified_name").orderBy(F.desc("score"), "qualified_name")


def scalars_or_structs(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """Of values said to be node, relationship or scalar, the scalars only if there is nothing else."""
    other = rows.where(F.col(kind) != "scalar").limit(1).select(F.lit(True).alias("_other"))
    return rows.join(F.broadcast(other), how="left").where((F.col(kind) != "scalar") | F.col("_other").isNull()).drop("_other")  # one row


def truncated(counts: DataFrame, definitions: list[str]) -> DataFrame:
    """Whether a graph has structure but no definition."""
    own = F.sum(F.when(F.col("label").isin(*definitions), F.col("n")).otherwise(0))
    return counts.agg(own.alias("definitions"), F.sum("n").alias("total")).withColumn("truncated", (F.col("definitions") == 0) & (F.col("total") > 0))


def budgeted(symbols: DataFrame, budget: int, by: str, key: str = "qualified_name", per_token: int = 4) -> DataFrame:
    """Symbols of each bundle that fit a token budget: the key, its cost and whether it is kept.

    ``symbols``: by, key, depth, score, snippet_length.  Over budget, the deepest layers go first,
    then seeds by longest name; then what was dropped comes back, shallow and high scores first, as
    far as it fits.

    Layers are kept by running sums of their costs; seeds by the running sum from the shortest name
    on, of which no more than ``budget`` can be kept.  What comes back is chosen in order, but of
    the symbols of one cost only the first budget / cost can fit, and one that doesn't fit never
    will; so no more than some budget * log(budget) candidates of a bundle meet in one task.
    """
    import pandas as pd

    kind = symbols.schema[by].dataType.simpleString()
    cost = (F.floor((F.coalesce("snippet_length", F.lit(0)) + F.length(key)) / F.lit(per_token)) + 1).cast("long")
    rows = settled(symbols.select(by, key, "depth", F.coalesce("score", F.lit(0.0)).alias("score"), cost.alias("cost")))
    layers = rows.groupBy(by, "depth").agg(F.sum("cost").alias("_layer"))
    layers = layers.withColumn("_upto", F.sum("_layer").over(W.partitionBy(by).orderBy("depth")))  # a row for each depth
    fits = layers.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("_upto") <= budget, F.col("depth"))), F.lit(0)).alias("_deepest"), F.max(F.when((F.col("depth") == 0) & (F.col("_upto") > budget), True)).alias("_over"))
    rows = rows.join(few(fits), by)
    length = F.length(key)
    first = rows.where(F.col("_over") & (F.col("depth") == 0)).withColumn("_i", F.row_number().over(W.partitionBy(by).orderBy(length, F.desc(key)))).where(F.col("_i") <= budget)
    short = first.withColumn("_sum", F.sum("cost").over(W.partitionBy(by).orderBy(length, F.desc(key)).rowsBetween(W.unboundedPreceding, 0))).where(F.col("_sum") <= budget)
    kept = settled(rows.where(F.col("_over").isNull() & (F.col("depth") <= F.col("_deepest"))).select(by, key, "cost").unionByName(short.select(by, key, "cost")))
    used = kept.groupBy(by).agg(F.sum("cost").alias("_used"))
    gone = rows.join(kept.select(by, key), [by, key], "left_anti").join(used, by, "left").withColumn("_room", F.lit(budget) - F.coalesce("_used", F.lit(0)))
    order = ["depth", F.desc("score"), key]
    able = gone.where(F.col("cost") <= F.col("_room")).withColumn("_i", F.row_number().over(W.partitionBy(by, "cost").orderBy(*order))).where((F.col("_i") <= budget) & (F.col("_i") * F.col("cost") <= F.col("_room")))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        room, keep = int(g["_room"].iloc[0]), []
        for c in g.assign(_s=-g["score"]).sort_values(["depth", "_s", key])["cost"]:
            keep.append(c <= room)
            room -= c if keep[-1] else 0
        return g.assign(_s=-g["score"]).sort_values(["depth", "_s", key])[[by, key]][keep]

    back = able.select(by, key, "depth", "score", "cost", "_room").groupBy(by).applyInPandas(fit, f"{by} {kind}, {key} string")
    chosen = kept.select(by, key).unionByName(back).withColumn("_kept", F.lit(True))
    return rows.select(by, key, "cost").join(chosen, [by, key], "left").withColumn("kept", F.coalesce("_kept", F.lit(False))).drop("_kept")


def entry_points(nodes: DataFrame, names: Column, limit: int) -> DataFrame:
    """Symbols whose names say that something starts there, none of them anonymous."""
    return nodes.where(names & ~F.col("name").startswith("anonymous")).orderBy("qualified_name").limit(limit)


def nearest_module(name: str, edges: DataFrame, nodes: DataFrame, most: int = 6) -> DataFrame:
    """The module nearest to a symbol along edges of any direction; by name among equals."""
    either = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seed = edges.sparkSession.createDataFrame([(name,)], "qualified_name string")
    modules = scan(nodes, "Module").select("qualified_name", "path")
    return breadth_first(either, seed, most).join(modules, "qualified_name").orderBy("depth", "qualified_name").limit(1)


def snippet(name: str, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Source of a symbol by exact name: found, reason, snippet.  ``texts``: path, text."""
    from heddle.operators.chunks import source_range

    wanted = nodes.sparkSession.createDataFrame([(name,)], "qualified_name string")
    rn = F.row_number().over(W.partitionBy("qualified_name").orderBy(F.col("path").isNull(), "path", "start_line"))
    first = nodes.where(F.col("qualified_name") == name).withColumn("_rn", rn).where("_rn = 1").select("qualified_name", F.lit(True).alias("_known"), "path", "start_line", "end_line")
    rows = wanted.join(first, "qualified_name", "left").join(texts, "path", "left")
    reason = F.when(F.col("_known").isNull(), "unknown symbol").when(F.col("path").isNull() | F.col("start_line").isNull() | F.col("end_line").isNull(), "no location").when(F.col("text").isNull(), "no source")
    got = F.when(reason.isNull(), source_range(F.col("text"), F.col("start_line").cast("int"), F.col("end_line").cast("int")))
    return rows.select("qualified_name", reason.isNull().alias("found"), reason.alias("reason"), got.alias("snippet"))
