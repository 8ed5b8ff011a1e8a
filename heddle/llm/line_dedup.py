"""Lines that stand in many documents: keep bitmaps of every document (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.common import by_key, row_hash, scratch, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    """The text cut at line ends; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lowered.  (``lower`` is the faster and gives the same where all is ASCII.)"""
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.btrim(F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER)), F.lit(SPACE))


def _let(x: Column, f) -> Column:
    """Computes x once, however often f refers to it."""
    return F.get(F.transform(F.array(x), f), 0)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Which lines of every document stay, without the texts.

    A line's key (``line_key``) of ``min_chars`` code points or more that stands in ``min_docs``
    documents or more is repeated: all its lines go (``keep="none"``), or all but the first by
    (key, text hash, position) (``keep="first"``).

    128-bit hashes of the keys are partitioned by ranges of (hash, document) and sorted within
    by position, so that a hash that very many documents share lies in several tasks in a row, and
    no task holds more of it than a range's rows.  Each task streams over its rows: the first row of a
    hash in a document counts that document, and a hash gives one row a task to the totals.  The
    lines of repeated hashes then mark their documents: where these hashes are many, the rows of hot
    ones stay where they are (``common.by_key``).

    Returns a row for each distinct (key, text): key, ``_row`` (a hash of the text), n_lines,
    n_dropped and ``keep``, the bitmap as lengths of its runs: lines kept, lines dropped, lines kept
    and so on; ``kept_text`` applies it.  A document is a distinct (key, text): repeated rows count
    once, rows that share a key but not a text are documents of their own, and so are texts under
    a null key.  Null text counts as empty, one empty line that no rule drops while min_chars is over
    0; an empty table gives an empty one; other columns are left out.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    hashed = lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit("second"), k).alias("b")))
    hashes = F.transform(F.transform(lines(F.col(text)), line_key), hashed)
    on = ["a", "b"]
    with scratch() as kept:
        source = docs.select(F.col(key).alias("_k"), row_hash(F.col(text)).alias("_row"), hashes.alias("_lines"))
        source = written(source.groupBy("_k", "_row").agg(F.first("_lines").alias("_lines")))
        placed = source.select("_k", "_row", F.posexplode("_lines").alias("_pos", "_line")).where("_line IS NOT NULL").select("_line.*", "_k", "_row", "_pos")

        ranged = placed.repartitionByRange(*on, "_k", "_row")
        within = F.row_number().over(W.partitionBy(*on, "_k", "_row").orderBy("_pos"))
        streamed = ranged.withColumn("_within", within).groupBy(*on).agg(
            F.count("*").alias("_n"), F.count_if(F.col("_within") == 1).alias("_docs"), F.min(F.struct("_k", "_row", "_pos")).alias("_first")
        )
        repeated = written(streamed.where(F.col("_docs") >= min_docs).select(*on, "_n", "_first"))

        marked = by_key(placed, repeated, on, "_n")
        if keep == "first":
            marked = marked.where(~F.struct("_k", "_row", "_pos").eqNullSafe(F.col("_first")))
        gone = written(marked.groupBy("_k", "_row").agg(F.sort_array(F.collect_list("_pos")).alias("_gone")))
        kept += [source, gone]

    p = F.col("_gone")
    starts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
    ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))

    def runs(s: Column, e: Column) -> Column:
        pairs = F.transform(s, lambda x, i: F.array(x - F.coalesce(F.get(e, i - 1) + 1, F.lit(0)), F.get(e, i) - x + 1))
        return F.concat(F.flatten(pairs), F.array(F.col("_size") - F.coalesce(F.element_at(e, -1) + 1, F.lit(0))))

    all_ = source.select("_k", "_row", F.size("_lines").alias("_size"))
    other = gone.select(F.col("_k").alias("_k2"), F.col("_row").alias("_row2"), "_gone")
    joined = all_.join(other, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_row") == F.col("_row2")), "left")
    joined = joined.withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    return joined.select(
        F.col("_k").alias(key),
        "_row",
        F.col("_size").cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_dropped"),
        F.when(F.size("_gone") == 0, F.array("_size")).otherwise(_let(starts, lambda s: _let(ends, lambda e: runs(s, e)))).alias("keep"),
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps, joined by line ends."""
    flags = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    some = _let(flags, lambda f: F.array_join(F.filter(lines(text), lambda x, i: F.get(f, i)), "\n"))
    return F.when(F.size(keep) == 1, F.coalesce(text, F.lit(""))).otherwise(some)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs``, with ``_n_lines``, ``_n_dropped`` and ``_kept`` (the text that stays) from its bitmap."""
    side = bitmaps.select(F.col(key).alias("_bk"), F.col("_row").alias("_br"), F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"), F.col("keep").alias("_keep"))
    joined = docs.join(side, F.col(key).eqNullSafe(F.col("_bk")) & (row_hash(F.col(text)) == F.col("_br")))
    return joined.withColumn("_kept", kept_text(F.col(text), F.col("_keep"))).drop("_bk", "_br", "_keep")


def digest(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of lines and checksum of what stays, a row for every row of ``docs``."""
    out = with_bitmaps(docs.select(key, text), bitmaps, key, text)
    return out.select(key, F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


def oracle(min_docs: int = 10) -> str:
    """DuckDB SQL of ``digest`` over documents."""
    key = f"trim(translate(line, '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
    WITH l AS MATERIALIZED (SELECT doc_id, pos, line, {key} AS k
        FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
    r AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= {min_docs}),
    m AS (SELECT l.*, r.k IS NOT NULL AS gone FROM l LEFT JOIN r USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id"""
