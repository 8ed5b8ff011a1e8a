"""Entity resolution: calls to definitions, packages to repositories, inheritance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heddle.functions.text import import_distance, python_name
from heddle.sources.tables import few, settled

# Rules in the order in which they are tried, with provenance and confidence.
RULES = {
    "iife": (1, "exact", 1.0),
    "super": (2, "exact", 1.0),
    "import": (3, "exact", 1.0),
    "import_wildcard": (3, "wildcard", 0.5),
    "qualified": (4, "exact", 1.0),
    "wildcard": (5, "wildcard", 0.5),
    "same_module": (6, "exact", 1.0),
    "chained": (7, "heuristic", 0.6),
    "nearest": (8, "heuristic", 0.6),
    "builtin": (9, "exact", 1.0),
}
MOST_HOPS = 16


def re_exports(starts: DataFrame, exports: DataFrame, symbols: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """Where each re-exported name ends: start, target, via_wildcard, hops.

    ``exports``: module, symbol, target; the symbol ``*`` stands for every name of the target
    module.  Named hops go before wildcards, shorter chains before longer; no name is visited twice.  A chain
    that reaches a symbol goes no further, since what follows it would be longer and no less by wildcards.
    """
    known = few(symbols.select(F.col("qualified_name").alias("_q")).distinct())
    named = exports.where("symbol <> '*'").select(F.concat_ws(".", "module", "symbol").alias("_at"), F.col("target").alias("_to"))
    wild = exports.where("symbol = '*'").select(F.col("module").alias("_m"), F.col("target").alias("_t"))
    named, wild = few(named), few(wild)
    at = starts.select(F.col("qualified_name").alias("start"), F.col("qualified_name").alias("now"), F.array("qualified_name").alias("path"), F.lit(False).alias("via_wildcard"))
    found = None
    for hop in range(1, hops + 1):
        one = at.join(named, at["now"] == named["_at"]).select("start", F.col("_to").alias("next"), "path", "via_wildcard")
        parts = at.withColumn("_mod", F.regexp_replace("now", r"\.[^.]*$", "")).withColumn("_sym", F.regexp_extract("now", r"([^.]*)$", 1))
        two = parts.join(wild, parts["_mod"] == wild["_m"]).select("start", F.concat_ws(".", "_t", "_sym").alias("next"), "path", F.lit(True).alias("via_wildcard"))
        step = one.unionByName(two).where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("now"), F.array_append("path", F.col("next")).alias("path"), "via_wildcard")
        step = step.dropDuplicates(["start", "now", "via_wildcard"])
        step = settled(step.join(known, step["now"] == known["_q"], "left"))
        if step.isEmpty():
            break
        hit = step.where("_q IS NOT NULL").select("start", F.col("now").alias("target"), "via_wildcard", F.lit(hop).alias("hops"))
        found = hit if found is None else found.unionByName(hit)
        at = step.where("_q IS NULL").drop("_q")
    if found is None:
        return starts.select(F.col("qualified_name").alias("start"), F.lit("").alias("target"), F.lit(False).alias("via_wildcard"), F.lit(0).alias("hops")).limit(0)
    rn = F.row_number().over(W.partitionBy("start").orderBy("via_wildcard", "hops", "target"))
    return found.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def ancestors(parents: DataFrame) -> DataFrame:
    """Every class with all it inherits from, breadth first, at any depth: class, ancestor, depth,
    position (the declared places of the parents on the way, an array)."""
    base = settled(parents.select("class", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"), F.array(F.col("position").cast("int")).alias("position")))
    known, at, depth = base, base, 1
    up = parents.select(F.col("class").alias("_c"), "parent", F.col("position").cast("int").alias("_p"))
    while not at.isEmpty():
        depth += 1
        step = at.join(up, at["ancestor"] == up["_c"]).select("class", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"), F.array_append("position", F.col("_p")).alias("position")).where("class <> ancestor")
        step = step.join(known.select("class", "ancestor").distinct(), ["class", "ancestor"], "left_anti").groupBy("class", "ancestor", "depth").agg(F.min("position").alias("position"))
        at = settled(step)
        known = known.unionByName(at)
    return known.groupBy("class", "ancestor").agg(F.min(F.struct("depth", "position")).alias("s")).select("class", "ancestor", "s.depth", "s.position")


def inherited(wanted: DataFrame, parents: DataFrame, methods: DataFrame) -> DataFrame:
    """For each (class, method), the first ancestor in breadth-first order that has the method.

    All classes go up one depth at a time, and only those that still miss a method go on, so the work grows
    with the steps to what is found and not with all pairs of classes and ancestors.
    """
    m = settled(methods.select(F.col("class").alias("ancestor"), "method"))
    up = settled(parents.select(F.col("class").alias("_c"), "parent", F.col("position").cast("int").alias("_p")))
    left = settled(wanted.select("class", "method").distinct())
    first = up.select(F.col("_c").alias("class"), F.col("parent").alias("ancestor"), F.array("_p").alias("position"))
    at = known = settled(first.join(few(left.select("class").distinct()), "class", "left_semi").groupBy("class", "ancestor").agg(F.min("position").alias("position")))
    found = wanted.select("class", "method", F.lit(None).cast(m.schema["ancestor"].dataType).alias("ancestor")).limit(0)
    while not at.isEmpty():
        asked = left.join(few(at), "class")
        hit = settled(m.join(few(asked), ["ancestor", "method"]).groupBy("class", "method").agg(F.min_by("ancestor", F.struct("position", "ancestor")).alias("ancestor")))
        found = found.unionByName(hit)
        left = settled(left.join(few(hit), ["class", "method"], "left_anti"))
        still = few(left.select("class").distinct())
        going = at.join(still, "class", "left_semi").withColumnRenamed("ancestor", "_at")
        step = up.join(few(going), F.col("_c") == F.col("_at")).select("class", F.col("parent").alias("ancestor"), F.array_append("position", F.col("_p")).alias("position")).where("class <> ancestor")
        seen = known.select("class", "ancestor").join(still, "class", "left_semi")
        at = settled(step.join(few(seen), ["class", "ancestor"], "left_anti").groupBy("class", "ancestor").agg(F.min("position").alias("position")))
        known = settled(seen.unionByName(at.select("class", "ancestor")))
    return found


def overrides(parents: DataFrame, methods: DataFrame) -> DataFrame:
    """One edge from each method to the nearest one that it overrides."""
    return inherited(methods.select("class", "method"), parents, methods)


def latest_rebinds(rebinds: DataFrame) -> DataFrame:
    """Each method's last rebinding."""
    return rebinds.groupBy("original").agg(F.max_by("target", "seq").alias("target"))


def nearest(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbol of each wanted name that is nearest to a module by import distance, by name among
    equals: name, module, callee.  ``wanted``: name, module, distinct.

    No name is compared with all its symbols: of those that share a prefix and a length, the first by
    name stands for all, since the distance follows from the longest shared prefix and the lengths;
    a module meets these once for each of its own prefixes.
    """

    def prefixes(c: Column) -> Column:
        parts = F.split(c, r"\.")
        return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))

    s = symbols.select(F.col("name").alias("_n"), "qualified_name", F.size(F.split("qualified_name", r"\.")).alias("_len"), F.explode(prefixes(F.col("qualified_name"))).alias("_prefix"))
    stand = s.groupBy("_n", "_prefix", "_len").agg(F.min("qualified_name").alias("callee"))
    asked = wanted.select("name", "module", F.explode(prefixes(F.col("module"))).alias("_prefix"))
    met = asked.join(stand, (F.col("name") == F.col("_n")) & (asked["_prefix"] == stand["_prefix"]))
    return met.groupBy("name", "module").agg(F.min_by("callee", F.struct(import_distance(F.col("callee"), F.col("module")), F.col("callee"))).alias("callee"))


def resolved(
    calls: DataFrame,
    symbols: DataFrame,
    imports: DataFrame,
    exports: DataFrame,
    rebinds: DataFrame,
    builtins: DataFrame | None = None,
    parents: DataFrame | None = None,
    types: DataFrame | None = None,
    returns: DataFrame | None = None,
) -> DataFrame:
    """The definition that each call names, by the first rule that finds one.

    calls: caller, module, class, call_name, line, col.  symbols: qualified_name, name, module,
    class.  imports: module, alias, target; alias ``*`` for all names of a module.  builtins: name and,
    where a table has them, callee (what it stands for, such as the function of an operator) and language (of the
    calls that it is for; those of all, if null or if calls have no language).
    types: caller, variable, class (of local variables).  returns: qualified_name, class (what a
    function gives).  Returns the call with callee, resolved_via and confidence; rebinding swaps the
    callee.  Candidates of all rules are joined by equality and ranked, so no call is looked up by
    itself; the nearest symbol of a name is sought only for calls that no rule before has resolved.
    """
    c = calls.withColumn("_id", F.struct("caller", "call_name", "line", "col"))
    s = symbols.select(F.col("qualified_name").alias("callee"), F.col("name").alias("_n"), F.col("module").alias("_sm"), F.col("class").alias("_sc"))
    head = F.regexp_extract("call_name", r"^([^.]+)\.", 1)
    tail = F.regexp_extract("call_name", r"([^.]+)$", 1)
    c = c.withColumn("_head", head).withColumn("_tail", tail)

    def leg(rule: str, df: DataFrame) -> DataFrame:
        order, via, confidence = RULES[rule]
        return df.select("_id", "callee", F.lit(order).alias("_rule"), F.lit(via).alias("resolved_via"), F.lit(confidence).alias("confidence"))

    named = imports.where("alias <> '*'").select(F.col("module").alias("_im"), F.col("alias").alias("_ia"), F.col("target").alias("_it"))
    direct = c.join(named, (c["module"] == named["_im"]) & (c["call_name"] == named["_ia"]))
    at_once = direct.join(s, direct["_it"] == s["callee"])
    ends = re_exports(direct.select(F.col("_it").alias("qualified_name")).distinct(), exports, symbols)
    through = direct.join(ends, direct["_it"] == ends["start"]).withColumn("callee", F.col("target"))
    through_name = through.where("NOT via_wildcard")
    through_wild = through.where("via_wildcard")
    dotted = c.where("_head <> ''")
    owned = dotted.where("_head IN ('self', 'cls', 'this')").join(s, (F.col("class") == F.col("_sc")) & (F.col("_tail") == F.col("_n")))
    spaced = dotted.join(named, (dotted["module"] == named["_im"]) & (dotted["_head"] == named["_ia"]))
    spaced = spaced.withColumn("_full", F.concat_ws(".", "_it", "_tail")).join(s, F.col("_full") == F.col("callee"))
    local = dotted.withColumn("_full", F.concat_ws(".", "module", "call_name")).join(s, F.col("_full") == F.col("callee"))
    star = imports.where("alias = '*'").select(F.col("module").alias("_im"), F.col("target").alias("_it"))
    plain = c.where("_head = ''")
    wild = plain.join(star, plain["module"] == star["_im"]).join(s, (F.col("_it") == F.col("_sm")) & (F.col("call_name") == F.col("_n")))
    same = plain.join(s, (F.col("module") == F.col("_sm")) & (F.col("call_name") == F.col("_n")) & F.col("_sc").isNull())
    at_place = plain.where(F.col("call_name").rlike("^iife_(func|arrow)_")).join(s, (F.col("module") == F.col("_sm")) & (F.col("call_name") == F.col("_n")))
    legs = [leg("iife", at_place), leg("import", at_once), leg("import", through_name), leg("import_wildcard", through_wild), leg("qualified", owned), leg("qualified", spaced), leg("qualified", local), leg("wildcard", wild), leg("same_module", same)]
    if types is not None:
        t = types.select(F.col("caller").alias("_tc"), F.col("variable").alias("_tv"), F.col("class").alias("_tt"))
        typed = dotted.join(t, (F.col("caller") == F.col("_tc")) & (F.col("_head") == F.col("_tv"))).join(s, (F.col("_tt") == F.col("_sc")) & (F.col("_tail") == F.col("_n")))
        legs.append(leg("qualified", typed))
    if returns is not None:
        # f().m: the method m of what f gives, f being imported or of the module itself
        made = c.where(F.col("call_name").rlike(r"\)\.[^.()]+$")).withColumn("_made", F.regexp_extract("call_name", r"^([^.()]+)\(", 1)).where("_made <> ''")
        source = made.join(named, (made["module"] == named["_im"]) & (made["_made"] == named["_ia"]), "left").withColumn("_f", F.coalesce("_it", F.concat_ws(".", "module", "_made")))
        gives = returns.select(F.col("qualified_name").alias("_rf"), F.col("class").alias("_rc"))
        legs.append(leg("chained", source.join(gives, F.col("_f") == F.col("_rf")).join(s, (F.col("_rc") == F.col("_sc")) & (F.col("_tail") == F.col("_n")))))
    if parents is not None:
        up = dotted.where("_head = 'super()'").select("_id", "class", F.col("_tail").alias("method"))
        meth = symbols.where("class IS NOT NULL").select("class", F.col("name").alias("method"), F.col("qualified_name").alias("callee"))
        first = inherited(up.select("class", "method").distinct(), parents, meth)
        legs.append(leg("super", up.join(first, ["class", "method"]).drop("class").join(meth.withColumnRenamed("class", "ancestor"), ["ancestor", "method"])))
    rn = F.row_number().over(W.partitionBy("_id").orderBy("_rule", F.desc("confidence"), "callee"))
    found = settled(reduce(DataFrame.unionByName, legs).withColumn("_rn", rn).where("_rn = 1").select("_id", "callee", "resolved_via", "confidence"))
    rest = settled(c.join(found.select("_id"), "_id", "left_anti").select("_id", "module", "call_name", F.col("_tail").alias("name")))
    near = leg("nearest", rest.join(nearest(rest.select("name", "module").distinct(), symbols), ["name", "module"]))
    found = found.unionByName(near.drop("_rule"))
    if builtins is not None:
        said = lambda df, name: F.col(name) if name in df.columns else F.lit(None).cast("string")
        b = builtins.select(F.col("name").alias("_n"), F.coalesce(said(builtins, "callee"), F.concat(F.lit("builtins."), "name")).alias("callee"), said(builtins, "language").alias("_for"))
        spoken = c.select("_id", said(calls, "language").alias("_language"))
        known = rest.join(near.select("_id"), "_id", "left_anti").join(spoken, "_id").join(b, F.col("call_name") == F.col("_n"))
        own = known.where(F.col("_for").isNull() | F.col("_language").isNull() | (F.col("_for") == F.col("_language")))
        own = own.groupBy("_id").agg(F.min_by("callee", F.struct(F.col("_for").isNull(), "callee")).alias("callee"))  # a language's own goes before that of all
        found = found.unionByName(leg("builtin", own).drop("_rule"))
    r = latest_rebinds(rebinds).select(F.col("original").alias("_o"), F.col("target").alias("_new"))
    best = found.join(r, found["callee"] == r["_o"], "left")
    best = best.select("_id", F.coalesce("_new", "callee").alias("callee"), F.when(F.col("_new").isNotNull(), "rebound").otherwise(F.col("resolved_via")).alias("resolved_via"), "confidence")
    return calls.withColumn("_id", F.struct("caller", "call_name", "line", "col")).join(best, "_id", "left").drop("_id")


def external_modules(modules: DataFrame, own_prefix: str, most: int | None = None) -> DataFrame:
    """Modules that are neither a repository's own nor another one's by name: all of them, or by name
    the first ``most`` if a caller asks for so many."""
    q = F.col("qualified_name")
    out = modules.where(~q.startswith(own_prefix) & ~q.contains("::"))
    return out if most is None else out.orderBy("qualified_name").limit(most)


def repository_of(modules: DataFrame, identities: DataFrame) -> DataFrame:
    """The repository that owns each external module, or null.

    An npm name that equals the module's name or path, in any case, goes before a Python name that
    its first part has; of several, the first identity.  identities: seq, slug, npm_name,
    python_name, python_top_level.
    """
    keys = modules.select("qualified_name", F.explode(F.array_distinct(F.array(F.trim(F.lower("qualified_name")), F.trim(F.lower("path"))))).alias("_k")).where("_k <> ''")
    npm = identities.select(F.trim(F.lower("npm_name")).alias("_k"), "seq", "slug")
    a = keys.join(npm, "_k").select("qualified_name", F.lit(0).alias("_p"), "seq", "slug")
    first = lambda c: python_name(F.split(F.col(c), r"\.")[0])
    parts = modules.select("qualified_name", F.explode(F.array_distinct(F.array(first("qualified_name"), first("path")))).alias("_k")).where("_k <> ''")
    py = identities.select("seq", "slug", F.explode(F.array(python_name(F.col("python_name")), python_name(F.col("python_top_level")))).alias("_k")).where("_k IS NOT NULL AND _k <> ''").distinct()
    b = parts.join(py, "_k").select("qualified_name", F.lit(1).alias("_p"), "seq", "slug")
    best = a.unionByName(b).groupBy("qualified_name").agg(F.min_by("slug", F.struct("_p", "seq")).alias("slug"))
    return modules.join(best, "qualified_name", "left")


def rewired(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with their ends renamed (old, new), each once."""
    m = lambda side: names.select(F.col("old").alias(side), F.col("new").alias(f"_{side}"))
    out = edges.join(m("src"), "src", "left").join(m("dst"), "dst", "left")
    return out.withColumn("src", F.coalesce("_src", "src")).withColumn("dst", F.coalesce("_dst", "dst")).drop("_src", "_dst").select(*edges.columns).distinct()
