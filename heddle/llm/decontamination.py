"""Benchmark decontamination by winnowed fingerprints (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import BROADCAST_ROWS, by_key, joinable, row_hash, scratch, written

#: Characters that separate words, once ASCII letters are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, in which only A-Z are lowered."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, -1), "")


def folded_words(text: Column) -> Column:
    """As many words, all letters lowered: faster and coarser, for the search alone, which may
    find too much but never too little.  Capital sigma, the one letter whose lower case depends on
    what stands around it, is lowered first."""
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u03a3"), F.lit("\u03c3"))), SEPARATORS, -1), "")


def grams(w: Column, k: int) -> Column:
    """Hash of every run of k words, in order."""
    n = F.size(w) - F.lit(k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>"))


def winnowed(h: Column, window: int) -> Column:
    """The least hash of every ``window`` consecutive ones, each once."""
    n = F.size(h) - F.lit(window - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_min(F.slice(h, i, window))))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(df: DataFrame, w: str, length: int, k: int, short: list[int]) -> DataFrame:
    """Adds ``_fps``, winnowed k-grams of the words in column ``w``: any ``length`` words in a row
    hold one, the same one wherever they stand.  For items shorter than that, also every gram of
    each of the lengths ``short``.  (The grams are a column of their own: an expression that a
    lambda refers to would be computed again for every element.)"""
    df = df.withColumn("_grams", grams(F.col(w), k))
    return df.withColumn("_fps", F.concat(winnowed(F.col("_grams"), length - k + 1), *[grams(F.col(w), n) for n in short])).drop("_grams")


def looked_up(left: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` beside the row of ``known``, a written table with one row for each key, that has
    theirs.  If the keys are too many to broadcast, rows are counted by key first, so that those of a
    key in very many documents can stay where they are."""
    if known.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(known), on)
    counts = left.groupBy(*on).agg(F.count("*").alias("_n"))
    return by_key(left, written(counts.join(known, on)), on, "_n").drop("_n")


def of_set(members: Column) -> list[Column]:
    """Aggregates that tell sets of 64-bit pairs apart: 128 bits, whatever the order, combined before rows are shuffled."""
    return [F.bit_xor(F.xxhash64(members)).alias("_sa"), F.bit_xor(F.xxhash64(F.lit("second"), members)).alias("_sb")]


def _passages(source: DataFrame, lengths: list[int], length: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: each distinct passage (_len, a, b) once, with the class (_sa, _sb) of passages that
    stand in the same items; and each class's items, from one of its passages."""
    rows = source.select("_item", F.lit(0).alias("_len"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).limit(0)
    for n in lengths:
        whole = F.size("_w") >= n if n == length else F.size("_w") == n
        rows = rows.unionByName(source.where(whole).select("_item", F.lit(n).alias("_len"), F.explode(passage_hashes(F.col("_w"), n)).alias("_p")).select("_item", "_len", "_p.a", "_p.b"))
    rows = written(rows.distinct())
    passages = written(rows.groupBy("_len", "a", "b").agg(*of_set(F.col("_item"))))
    chosen = passages.groupBy("_sa", "_sb").agg(F.min(F.struct("_len", "a", "b")).alias("_p")).select("_sa", "_sb", "_p.*")
    items = rows.join(chosen, ["_len", "a", "b"]).groupBy("_sa", "_sb").agg(F.collect_list("_item").alias("_items"))
    return passages, written(items)


def _hits(docs: DataFrame, items: DataFrame, length: int, k: int, key: str, text: str, item_key: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: (key, _row, n_words) of every text; (key, _row, _len, _pos, _sa, _sb) of every
    passage in them, with its class; and the items of each class, _items."""
    source = items.select(F.col(item_key).alias("_item"), words(F.col(item_text)).alias("_w"), folded_words(F.col(item_text)).alias("_f")).where(F.size("_w") > 0)
    lengths = [r[0] for r in source.select(F.least(F.size("_w"), F.lit(length))).distinct().collect()]  # at most `length` numbers
    short = sorted(n for n in lengths if n < length)

    with scratch() as keep:
        prints = fingerprints(source, "_f", length, k, []).select(F.explode("_fps").alias("_fp"))
        prints = written(prints.unionByName(source.where(F.size("_w") < length).select(F.xxhash64("_f").alias("_fp"))).distinct())
        passages, classes = _passages(source, lengths, length)

        scanned = docs.select(F.col(key), row_hash(F.col(text)).alias("_row"), folded_words(F.col(text)).alias("_f"))
        scanned = fingerprints(scanned, "_f", length, k, short).select(key, "_row", F.size("_f").cast("bigint").alias("n_words"), "_fps")
        if prints.count() <= BROADCAST_ROWS:
            matched = scanned.select(key, "_row", "n_words", F.explode_outer("_fps").alias("_fp")).join(F.broadcast(prints.withColumn("_known", F.lit(True))), "_fp", "left")
            judged = written(matched.groupBy(key, "_row", "n_words").agg(F.coalesce(F.max("_known"), F.lit(False)).alias("_found")))
            found = written(judged.where("_found").select(F.col(key).alias("_k"), F.col("_row").alias("_r")))
            keep.append(judged)
            judged = judged.drop("_found")
        else:
            scanned = written(scanned)
            judged = written(scanned.select(key, "_row", "n_words").distinct())
            near = looked_up(scanned.select(key, "_row", F.explode("_fps").alias("_fp")), prints, ["_fp"])
            found = written(near.select(F.col(key).alias("_k"), F.col("_row").alias("_r")).distinct())

        texts = docs.select(F.col(key), row_hash(F.col(text)).alias("_row"), F.col(text).alias("_text"))
        near = texts.join(joinable(found), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r")), "left_semi")
        near = near.select(key, "_row", words(F.col("_text")).alias("_w"))
        runs = near.select(key, "_row", F.lit(0).alias("_len"), F.lit(0).alias("_pos"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).limit(0)
        for n in lengths:
            runs = runs.unionByName(near.select(key, "_row", F.lit(n).alias("_len"), F.posexplode(passage_hashes(F.col("_w"), n)).alias("_pos", "_p")).select(key, "_row", "_len", "_pos", "_p.a", "_p.b"))
        hits = written(looked_up(runs, passages, ["_len", "a", "b"]).select(key, "_row", "_len", "_pos", "_sa", "_sb").distinct())
        keep += [judged, hits, classes]
    return judged, hits, classes


def _named(hits: DataFrame, classes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: (key, _row, _ga, _gb), each document's set of classes; and n_items and items_sha256 of each such
    set.  Documents with equal sets share one list of items, so rows are never documents times items."""
    group = ["_ga", "_gb"]
    each = written(hits.select(key, "_row", "_sa", "_sb").distinct())
    sets = written(each.groupBy(key, "_row").agg(*of_set(F.struct("_sa", "_sb"))).withColumnsRenamed({"_sa": "_ga", "_sb": "_gb"}))
    first = sets.groupBy(*group).agg(F.min(F.struct(F.col(key).alias("_k"), F.col("_row").alias("_r"))).alias("_f")).select(*group, "_f.*")
    members = written(each.join(first, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r"))).select(*group, "_sa", "_sb"))
    counts = members.groupBy("_sa", "_sb").agg(F.count("*").alias("_n"))
    listed = by_key(members, written(counts.join(classes, ["_sa", "_sb"])), ["_sa", "_sb"], "_n")
    listed = listed.groupBy(*group).agg(F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_all"))
    ids = F.array_sort(F.transform("_all", lambda x: x.cast("string")))
    counts = sets.groupBy(*group).agg(F.count("*").alias("_n"))
    said = listed.select(*group, F.size("_all").cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    return sets, written(said.join(counts, group))


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10, k: int = 5, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Words of documents that stand in a passage of a benchmark.

    A passage is ``length`` consecutive words of an item, or a whole item of fewer.  First,
    documents and items are winnowed (k-grams, windows that a passage fills), and fingerprints are
    joined: every document with a passage is found, since both sides select from the same words.
    Then the hits are extended: in the documents found, every run of a passage's length is looked
    up by a 128-bit hash among the distinct passages, and the words of those that match are hit.  A
    passage says its class, that of all passages in the same items; documents are joined with classes, sets
    of these with items, so neither a passage in very many items nor one in very many documents multiplies rows.

    Returns key, n_words, n_hit, n_items, items_sha256 (of the item ids with a passage in the
    document, sorted as strings, comma-joined) and contaminated.  Null and empty texts have no
    words and are clean; items without words match nothing; repeated rows have a row each; rows
    that share a key but not a text are judged apart; extra columns are left out.  An empty table
    on either side gives no hit.  Tables of fingerprints and passages have one row for each and are
    broadcast only up to BROADCAST_ROWS rows; beyond, rows of a frequent fingerprint or passage stay where
    they are (``looked_up``); rows for a document are reduced before they are shuffled, so no item or document is hot.
    """
    judged, hits, classes = _hits(docs, items, length, k, key, text, item_key, item_text)
    spans = hits.select(key, "_row", "_len", "_pos").distinct().groupBy(key, "_row").agg(F.collect_list(F.struct("_pos", "_len")).alias("_spans"))
    with scratch() as keep:
        sets, said = _named(hits, classes, key)
        keep += [sets, said]
    named = by_key(sets, said, ["_ga", "_gb"], "_n")
    covered = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["_pos"], s["_pos"] + s["_len"] - 1))))
    other = lambda df, *c: df.select(F.col(key).alias("_k"), F.col("_row").alias("_r"), *c)
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r"))
    rows = docs.select(F.col(key), row_hash(F.col(text)).alias("_row"))
    out = rows.join(other(judged, "n_words"), same).drop("_k", "_r")
    out = out.join(other(spans, F.size(covered).cast("bigint").alias("n_hit")), same, "left").drop("_k", "_r")
    out = out.join(other(named, "n_items", "items_sha256"), same, "left")
    return out.select(
        key,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, items: DataFrame, length: int = 10, k: int = 5, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has no passage of a benchmark, as ``decontaminate``
    judges it: of rows that share a key, each is judged by its own text."""
    hits = _hits(docs, items, length, k, key, text, item_key, item_text)[1]
    leaks = written(hits.select(F.col(key).alias("_k"), F.col("_row").alias("_r")).distinct())
    same = F.col(key).eqNullSafe(F.col("_k")) & (row_hash(F.col(text)) == F.col("_r"))
    return docs.join(joinable(leaks), same, "left_anti")


def passage_hashes(w: Column, n: int) -> Column:
    """Two independent hashes of every run of n words."""
    m = F.size(w) - F.lit(n - 1)

    def pair(i: Column) -> Column:
        run = F.slice(w, i, n)
        return F.struct(F.xxhash64(run).alias("a"), F.xxhash64(F.lit("second"), run).alias("b"))

    return F.when(m > 0, F.transform(F.sequence(F.lit(1), m), pair)).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))


def oracle(length: int = 10) -> str:
    """DuckDB SQL of ``decontaminate`` over documents and benchmark: every run, no fingerprints."""
    cut = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {cut('text')} AS w FROM documents),
    i AS (SELECT item_id, {cut('text')} AS w FROM benchmark),
    p AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
        FROM (SELECT item_id, w, least(len(w), {length}) AS n, unnest(range(1, len(w) - least(len(w), {length}) + 2)) AS k FROM i WHERE len(w) > 0)),
    r AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
    h AS MATERIALIZED (SELECT doc_id, n, k, item_id FROM r JOIN p USING (n, g)),
    s AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)"""
