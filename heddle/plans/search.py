"""Searches made of the operators: semantic search, context bundles and guarded SQL."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions.predicates import is_noise, is_read_only, is_test_or_script
from heddle.functions.text import capped_snippet, folded_card, intent, module_keywords
from heddle.operators import chunks, graph, lexical, rank, vector
from heddle.sources.tables import few, settled

# Breadth and depth of a bundle for each intent.
INTENT_SETTINGS = {
    "symbol": {"k": 12, "depth": 3, "module_limit": 0, "entrypoint_limit": 0, "caller_cap": 0, "lexical_limit": 0, "snippet_cap": 0, "exclude_tests": False},
    "conceptual": {"k": 20, "depth": 2, "module_limit": 25, "entrypoint_limit": 0, "caller_cap": 0, "lexical_limit": 0, "snippet_cap": 0, "exclude_tests": False},
    "howto": {"k": 15, "depth": 3, "module_limit": 20, "entrypoint_limit": 10, "caller_cap": 0, "lexical_limit": 0, "snippet_cap": 0, "exclude_tests": False},
    "design": {"k": 12, "depth": 2, "module_limit": 15, "entrypoint_limit": 0, "caller_cap": 3, "lexical_limit": 6, "snippet_cap": 2000, "exclude_tests": True},
}
#: Tokens of a bundle.
BUDGET = 12_000
SUMMARY = r"::summary$"


@dataclass
class Store:
    """What a search reads.  embeddings: qualified_name, embedding; ranks: qualified_name, pagerank;
    documents: qualified_name, content; edges: src, dst; sources: qualified_name, source; nodes:
    qualified_name, label, name, module, path."""

    embeddings: DataFrame
    ranks: DataFrame
    documents: DataFrame
    edges: DataFrame
    sources: DataFrame
    nodes: DataFrame | None = None


def semantic(store: Store, query_vector: list[float], terms: list[str], k: int, name: str | None = None, pin_final: bool = False, rerank=None) -> DataFrame:
    """The k best symbols: cosine over-fetched, noise out, cards folded, fused with centrality, and
    ordered by reciprocal ranks with BM25.  The score shown is the fused one.  Both lists are cut to
    max(50 k, 500) before they are ranked.  ``rerank`` takes and returns the bounded list of the first
    fifty; ``pin_final`` keeps names that match ``name`` first.
    """
    k = max(1, min(100, k))
    deep = max(rank.DEEP * k, rank.LEAST_DEEP)
    found = vector.top_k(store.embeddings, query_vector, deep, key="qualified_name")
    clean = rank.folded(found.where(~is_noise(F.col("qualified_name"))), folded_card(F.col("qualified_name")), "qualified_name")
    fused = rank.linear_fusion(clean, store.ranks, "qualified_name").select("qualified_name", F.col("fused").alias("score"))
    words = fused.limit(0)
    if terms:
        best_words = lexical.bm25(store.documents, terms, "qualified_name", "content").orderBy(F.desc("score"), "qualified_name").limit(deep)
        words = rank.folded(best_words, folded_card(F.col("qualified_name")), "qualified_name")
    both = rank.reciprocal_ranks(fused, words, "qualified_name")
    order = [F.desc("rrf"), F.desc("score"), F.asc("qualified_name")]
    if name and pin_final:
        order.insert(0, F.desc(rank.pinned(both, name, "qualified_name")))
    best = both.orderBy(*order)
    if rerank is not None:
        head = rerank(best.limit(50).collect())  # fifty rows
        best = store.embeddings.sparkSession.createDataFrame(head, both.schema).limit(k)
    return best.limit(k).select("qualified_name", F.round("score", 4).alias("score"))


def rerank_prompt(query: str, rows: list, snippets: dict[str, str], most: int = 800) -> str:
    """Numbered candidates with their snippets, for a model that answers with their order."""
    lines = [f"Query: {query}", "Rank the candidates by relevance. Answer with their numbers only, the best first, like [2] > [1]."]
    lines += [f"[{i}] {r['qualified_name']}\n{snippets.get(r['qualified_name'], '')[:most]}" for i, r in enumerate(rows, 1)]
    return "\n\n".join(lines)


def reranked(query: str, snippets: dict[str, str], ask, most: int = 30, deadline_s: float = 5.0):
    """Function for ``semantic`` from the head of a list to its new order by a model.

    ``ask`` takes a prompt and gives the answer's text.  The first ``most`` rows are shown, the rest
    stay behind them.  No answer within the deadline, an error, or an answer without a number leaves
    the order as it was; numbers beyond the list and repeats count for nothing, and candidates that
    are not named follow in their old order.
    """
    import re
    from concurrent.futures import ThreadPoolExecutor

    def order(rows: list) -> list:
        head = rows[:most]
        pool = ThreadPoolExecutor(1)
        try:
            answer = pool.submit(ask, rerank_prompt(query, head, snippets)).result(timeout=deadline_s)
        except Exception:  # whatever the model's client raises, a late answer included
            return rows
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        said = list(dict.fromkeys(int(x) - 1 for x in re.findall(r"\[(\d{1,9})\]", answer or "")))
        said = [i for i in said if 0 <= i < len(head)]
        if not said:
            return rows
        return [head[i] for i in said] + [r for i, r in enumerate(head) if i not in said] + rows[most:]

    return order


def module_symbols(store: Store, text: Column, limit: int, cap: int = 5) -> DataFrame:
    """Symbols defined in modules that a text's keywords name: qualified_name, place (from 0).

    Up to four times the limit of symbols of modules outside tests and web, by name, no anonymous
    ones; at most ``cap`` of a module, one of each in turn, modules with two keywords or more first,
    by how many and by shorter names; where these are fewer than the limit, the web's follow in the
    same way.
    """
    spark = store.edges.sparkSession
    words = spark.range(1).select(module_keywords(text).alias("_k"))
    nodes = store.nodes
    low = F.lower("_m")
    base = F.element_at(F.split(low, r"\."), -1)
    modules = nodes.where("module IS NOT NULL").select(F.col("module").alias("_m")).distinct().join(F.broadcast(words), how="cross")  # one row of at most 12 words
    hit = F.size(F.filter("_k", lambda k: base.contains(k) | low.contains(F.concat(F.lit("."), k))))
    broad = F.size(F.filter("_k", lambda k: low.contains(k)))
    modules = few(settled(modules.select("_m", hit.alias("_hits"), F.when((broad >= 2) & (F.size("_k") >= 2), broad).otherwise(0).alias("_both")).where("_hits > 0")))
    own = nodes.where(F.col("label").isin("Function", "Method") & ~F.col("name").rlike("^(anonymous_|iife_arrow_)")).join(modules, F.col("module") == F.col("_m"))
    own = own.where(~F.col("_m").contains(".test") & ~F.col("_m").contains("tests."))

    def leg(df: DataFrame) -> DataFrame:
        few_ = df.select("qualified_name", "_m", "_both").distinct().orderBy("qualified_name").limit(4 * limit)
        w = F.row_number().over(W.partitionBy("_m").orderBy("qualified_name"))
        dealt = few_.withColumn("_slot", w).where(F.col("_slot") <= cap)
        order = W.orderBy("_slot", F.desc("_both"), F.when(F.col("_both") > 0, F.length("_m")).otherwise(0), "_m")
        return dealt.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= limit)  # 4 * limit rows

    first = leg(own.where(~F.col("_m").contains(".web."))).select("qualified_name", F.lit(0).alias("_leg"), "_i")
    second = leg(own).select("qualified_name", F.lit(1).alias("_leg"), "_i").join(first.select("qualified_name"), "qualified_name", "left_anti")
    both = first.unionByName(second)
    return both.withColumn("place", F.row_number().over(W.orderBy("_leg", "_i")) - 1).where(F.col("place") < limit).select("qualified_name", "place")


def lexical_seeds(hits: DataFrame, limit: int) -> DataFrame:
    """Seeds of lexical hits (qualified_name, file_path, rank): at most two of a file and half of
    them Markdown, no noise, no tests: qualified_name, place."""
    kept = lexical.quota(hits, 2 * limit, "file_path", F.col("file_path").endswith(".md"), "qualified_name")
    clean = kept.where(~is_noise(F.col("qualified_name")) & ~is_test_or_script(F.col("qualified_name")))
    return clean.withColumn("place", F.row_number().over(W.orderBy("rank", "qualified_name")) - 1).where(F.col("place") < limit).select("qualified_name", "place")


def entry_seeds(nodes: DataFrame, limit: int) -> DataFrame:
    """Symbols where something starts, by the name of their module or their own: qualified_name, place."""
    module, name = F.lower(F.element_at(F.split("module", r"\."), -1)), F.lower("name")
    starts = module.rlike("route|cli|main|handler") | name.startswith("handle_") | name.startswith("create_") | (name == "main")
    plain = nodes.where(F.col("label").isin("Function", "Method") & ~F.col("name").rlike("^(anonymous_|iife_arrow_)"))
    found = plain.where(starts & ~is_noise(F.col("qualified_name"))).select("qualified_name").distinct().orderBy("qualified_name").limit(limit)
    return found.withColumn("place", F.row_number().over(W.orderBy("qualified_name")) - 1)


def bundle_seeds(store: Store, ranked: DataFrame, text: str, k: int, settings: dict, hits: DataFrame | None = None, penalty: float = 0.4) -> DataFrame:
    """Seeds of a bundle, from a semantic ranking (qualified_name, score, rank from 1): qualified_name,
    score, part.  Exact names, lexical hits, symbols of modules that the keywords name and entry
    points are merged in with scores a little below the best, each place a ten-thousandth less;
    tests and scripts lose the most of theirs."""
    spark = store.edges.sparkSession
    q = F.lit(text)
    words = F.array_distinct(F.regexp_extract_all(q, F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1)))
    named = spark.range(1).select(F.explode(words).alias("name"))
    exact = store.nodes.join(F.broadcast(named), "name", "left_semi").where(~is_noise(F.col("qualified_name"))).select("qualified_name").distinct().orderBy("qualified_name").limit(2 * k)
    exact = exact.withColumn("place", F.row_number().over(W.orderBy("qualified_name")) - 1)
    legs = {"exact": exact}
    if settings["lexical_limit"] and hits is not None:
        legs["lexical"] = lexical_seeds(hits, settings["lexical_limit"])
    if settings["module_limit"]:
        legs["module"] = module_symbols(store, q, settings["module_limit"]).where(~is_noise(F.col("qualified_name")))
    if settings["entrypoint_limit"]:
        legs["entry"] = entry_seeds(store.nodes, settings["entrypoint_limit"])
    top = settled(ranked.where(F.col("rank") <= 2 * k))
    bases = rank.boost_bases(settled(ranked.select("qualified_name", "score")), k)
    sure = settled(reduce(DataFrame.unionByName, [df.select(F.lit(leg).alias("leg"), "place", "qualified_name") for leg, df in legs.items()]))
    base = F.when(F.col("leg") == "exact", F.col("exact")).when(F.col("leg") == "lexical", F.col("lexical")).when(F.col("leg") == "module", F.col("module")).otherwise(F.col("entry"))
    boosts = sure.join(F.broadcast(bases), how="cross").select("qualified_name", (base * (1 - F.col("place") * 1e-4)).alias("score"))  # one row
    merged = rank.max_merged(top.select("qualified_name", "score"), boosts, key="qualified_name")
    merged = settled(merged.withColumn("score", rank.penalised(F.col("score"), is_test_or_script(F.col("qualified_name")), penalty if 0 < penalty <= 1 else 0.4)))
    return rank.seeds(merged, sure, k, "qualified_name", F.col("qualified_name").rlike(SUMMARY))


def bundle(store: Store, seeds: DataFrame, depth: int, budget: int = BUDGET, caller_cap: int = 0, exclude_tests: bool = False, snippet_cap: int = 0) -> DataFrame:
    """What to read about the seeds (qualified_name, score): what their call graph reaches, scored,
    and cut to a token budget: qualified_name, depth, score, cost, kept."""
    seeds, edges = settled(seeds.select("qualified_name", "score")), settled(store.edges.select("src", "dst"))
    reached = settled(graph.breadth_first(edges, seeds, depth, caller_cap, exclude_tests))
    scores = settled(graph.propagated(seeds, edges, reached))
    snippet = capped_snippet(F.col("source"), snippet_cap) if snippet_cap else F.col("source")
    names = few(reached.select("qualified_name"))
    lengths = settled(store.sources.join(names, "qualified_name", "left_semi").select("qualified_name", F.length(snippet).alias("_length")))  # the sources themselves never move
    sized = reached.join(scores, "qualified_name", "left").join(lengths, "qualified_name", "left")
    symbols = sized.select(F.lit(0).alias("bundle"), "qualified_name", "depth", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("_length", F.lit(0)).alias("snippet_length"))
    symbols = settled(symbols)
    fit = graph.budgeted(symbols, budget, "bundle").drop("bundle")
    return symbols.drop("bundle", "snippet_length").join(fit, "qualified_name")


def context_bundle(store: Store, ranked: DataFrame, text: str, k: int = 8, depth: int = 1, hits: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """A bundle for a task: its intent widens k and depth, seeds come from all legs, and their graph
    is cut to the budget.  A k or depth of 0 stays 0."""
    if kind not in INTENT_SETTINGS:
        kind = store.edges.sparkSession.range(1).select(intent(F.lit(text)).alias("i")).first()[0]
    own = INTENT_SETTINGS[kind]
    k, depth = k and max(k, own["k"]), depth and max(depth, own["depth"])
    seeds = bundle_seeds(store, ranked, text, k, own, hits)
    return bundle(store, seeds, depth, BUDGET, own["caller_cap"], own["exclude_tests"], own["snippet_cap"])


def summary_snippets(symbols: DataFrame, summaries: DataFrame) -> DataFrame:
    """Text of the summaries among some symbols, from their stored rows (qualified_name, text), cut to
    their first lines."""
    wanted = symbols.where(F.col("qualified_name").rlike(SUMMARY) | F.col("qualified_name").contains(".md::")).select("qualified_name").distinct()
    return summaries.join(few(wanted), "qualified_name", "left_semi").select("qualified_name", chunks.hydrated(F.col("text")).alias("snippet"))


# Nodes of unresolved plans that only read; a plan with any other is refused.
READING_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "LimitAndOffset", "Offset", "Distinct", "Union", "Except", "Intersect", "Join", "LateralJoin",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "UnresolvedWith", "UnresolvedInlineTable", "UnresolvedHaving", "WithWindowDefinition",
    "OneRowRelation", "Generate", "Window", "Sample", "Pivot", "UnresolvedPivot", "Unpivot", "UnresolvedTVFAliases", "UnresolvedTableValuedFunction", "LocalRelation", "Tail", "UnresolvedHint",
}
#: Table functions that a query may use, and functions that it may not, since they run any code.
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}
RUNNING_FUNCTIONS = {"java_method", "reflect", "try_reflect"}


def refusal(spark: SparkSession, query: str, relations: Iterable[str] | None = None) -> str | None:
    """Why a query may not be run: a word that writes, a plan that does more than read, a function that
    runs other code, or a relation that is no named table; None if it may.  Parsed only, never run.

    ``relations`` are the tables and views that a query may name; where none are given, those that the
    session's catalogue has.  So no query reads a file by its path, whatever its format: such a relation is
    in no catalogue.  A common table expression counts only where it is in scope: in the query
    it stands before and in later ones of its list, not in its own definition unless that is recursive.
    """
    from pyspark.errors import ParseException

    if not is_read_only(query):
        return "word"
    allowed = None if relations is None else {r.lower() for r in relations}

    def each(seq):
        it = seq.iterator()
        while it.hasNext():
            yield it.next()

    def within(e):
        yield e
        for x in each(e.children()):
            yield from within(x)

    def known(parts: list[str], scope: frozenset[str]) -> bool:
        if len(parts) == 1 and parts[0].lower() in scope:
            return True
        if allowed is not None:
            return ".".join(parts).lower() in allowed
        return spark.catalog.tableExists(".".join("`" + x.replace("`", "``") + "`" for x in parts))

    def judged(plan, scope: frozenset[str]) -> str | None:
        kind = plan.getClass().getSimpleName()
        if kind not in READING_NODES:
            return f"plan {kind}"
        if kind == "UnresolvedTableValuedFunction" and list(each(plan.name()))[-1].lower() not in TABLE_FUNCTIONS:
            return "function"
        if kind == "UnresolvedRelation" and not known(list(each(plan.multipartIdentifier())), scope):
            return "relation"
        if kind == "UnresolvedWith":
            for named in each(plan.cteRelations()):
                name = named._1().lower()
                if why := judged(named._2(), scope | {name} if plan.allowRecursion() else scope):
                    return why
                scope = scope | {name}
            return judged(plan.child(), scope)
        inside = [*each(plan.children()), *each(plan.innerChildren())]
        for e in each(plan.expressions()):
            for x in within(e):
                name = x.getClass().getSimpleName()
                if name == "UnresolvedFunction" and list(each(x.nameParts()))[-1].lower() in RUNNING_FUNCTIONS:
                    return "function"
                if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                    inside.append(x.plan())
        for p in inside:
            if why := judged(p, scope):
                return why
        return None

    try:
        return judged(spark._jsparkSession.sessionState().sqlParser().parsePlan(query), frozenset())
    except ParseException:
        return "syntax"


def return_aliases(query: str) -> list[str]:
    """Names given with AS after the last RETURN of a query text, each once, in order."""
    import re

    ends = [m.end() for m in re.finditer(r"\bRETURN\b", query, re.I)]
    found = re.findall(r"\bAS\s+([A-Za-z_][A-Za-z0-9_]*)", query[ends[-1] :], re.I) if ends else []
    return list(dict.fromkeys(x for x in found if x.upper() not in ("ASC", "DESC", "ASCENDING", "DESCENDING")))


#: Rows that a guarded query gives at most at once.
MOST_ROWS = 5000


def guarded_sql(spark: SparkSession, query: str, offset: int = 0, limit: int = 1000, relations: Iterable[str] | None = None) -> tuple[DataFrame, bool]:
    """A page of a query's rows in the order of its columns, and whether there are more; a query with
    a LIMIT of its own keeps its order and is one page of up to MOST_ROWS rows.  Only queries that read
    named tables are run (``refusal``)."""
    import re

    if refusal(spark, query, relations) is not None:
        raise PermissionError("only reading queries are allowed")
    df = spark.sql(query)
    if re.search(r"\bLIMIT\b", re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", query), re.I):
        return df.limit(MOST_ROWS), not df.offset(MOST_ROWS).limit(1).isEmpty()
    return graph.paged(df, max(offset, 0), max(1, min(MOST_ROWS, limit)))


def generated_query(spark: SparkSession, question: str, generate, relations: Iterable[str] | None = None) -> str:
    """Query text that a model writes for a question, cleaned; an error if it is not a reading one of
    named tables."""
    from heddle.functions.predicates import has_generated_write_word
    from heddle.functions.text import cleaned_query

    row = spark.range(1).select(cleaned_query(F.lit(generate(question))).alias("q")).select("q", has_generated_write_word(F.col("q")).alias("w")).first()
    if row["w"] or refusal(spark, row["q"].rstrip("; "), relations) is not None:
        raise PermissionError("the generated query does more than read")
    return row["q"]


def clean_rows(df: DataFrame, struct: str, private: list[str]) -> Column:
    """A node or relationship struct without its private fields."""
    return F.col(struct).dropFields(*private)
