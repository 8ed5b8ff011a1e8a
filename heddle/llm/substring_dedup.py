"""Repeated passages: rolling hashes of every fixed-length window of words, counted in Spark."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import by_key, dropped, row_hash, scratch, small_batches, written
from heddle.llm.shingles import Rolling, WordHashes, runs, sliding_min

#: Words of the grams by which windows are first sought.
GRAM = 10


def anchors_of(ids: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in some window: equal windows have the same
    ones at the same places within them, and every window has one."""
    h = runs(ids, gram)
    span = window - gram + 1
    if len(h) < span:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    least = sliding_min(h, span)
    # a gram is an anchor if one of the windows that hold it has it as its least
    padded = np.concatenate([np.zeros(span - 1, dtype=np.uint64), least, np.zeros(span - 1, dtype=np.uint64)])
    at = np.flatnonzero(~sliding_min(~padded, span) == h)
    return at, h[at]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def repeated_windows(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text", gram: int = GRAM, every: bool = False) -> DataFrame:
    """Starts of the windows of each document whose words also start in one with a smaller key: a
    written table (_key, _row, starts), starts an array of word positions, null for all.  See
    ``remove_repeats``."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be from 1 to window")
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), row_hash(F.col(text)).alias("_row"), F.col(text).alias("_text")).where("_key IS NOT NULL AND _text IS NOT NULL")

    def seek(batches):
        hashes = WordHashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            take, found = [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                a = np.unique(anchors_of(hashes.of(split(t)), window, gram)[1])
                take.append(np.full(len(a), i))
                found.append(a)
            take = pa.array(np.concatenate(take).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), signed(np.concatenate(found))], names=["_key", "_row", "_anchor"])

    def hashed(batches):
        words, more, rolling = WordHashes(), WordHashes(1), Rolling()
        for batch in batches:
            if not batch.num_rows:
                continue
            take, starts, first, second = [], [], [], []
            for i, (t, known) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                w = split(t)
                ids = words.of(w)
                n = len(w) - window + 1
                if known.values is None:
                    own = np.arange(max(n, 0))
                else:  # every window that holds a shared anchor
                    at, h = anchors_of(ids, window, gram)
                    at = at[np.isin(h, np.asarray(known.values).view(np.uint64))]
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, np.maximum(at - (window - gram), 0), 1)
                    np.add.at(edge, np.minimum(at + 1, n), -1)
                    own = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                take.append(np.full(len(own), i))
                starts.append(own)
                first.append(rolling.windows(ids, window)[own])
                second.append(rolling.windows(more.of(w), window)[own])
            take = pa.array(np.concatenate(take).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(starts).astype(np.int32)), signed(np.concatenate(first)), signed(np.concatenate(second))], names=["_key", "_row", "start", "a", "b"])

    with scratch() as keep:
        # texts that repeat whole: the one with the smallest key stands for all
        sha = F.sha2(F.col("_text"), 256).alias("_sha")
        wholes = rows.groupBy(sha).agg(F.min("_key").alias("_least"), F.count("*").alias("_n")).where("_n > 1")
        wholes = written(wholes.limit(0) if every else wholes)
        copies = written(by_key(rows.select("_key", "_row", sha), wholes, ["_sha"], "_n").where("_key > _least").select("_key", "_row").distinct())

        mark = copies.select(F.col("_key").alias("_k"), F.col("_row").alias("_r"))
        own = (F.col("_key") == F.col("_k")) & (F.col("_row") == F.col("_r"))
        if every:
            again = rows.join(mark, own, "left_anti").withColumn("_anchors", F.lit(None).cast("array<bigint>"))
        else:
            anchors = written(rows.mapInArrow(seek, f"_key {kind}, _row bigint, _anchor bigint"))
            shared = anchors.groupBy("_anchor").agg(F.min("_row").alias("_lo"), F.max("_row").alias("_hi"), F.count("*").alias("_n")).where("_lo <> _hi")
            shared = written(shared.select("_anchor", "_n"))
            theirs = by_key(anchors, shared, ["_anchor"], "_n", "left_semi").join(mark, own, "left_anti")
            theirs = written(theirs.groupBy("_key", "_row").agg(F.collect_set("_anchor").alias("_anchors")))
            dropped(anchors, shared)
            again = rows.join(theirs.select(F.col("_key").alias("_k"), F.col("_row").alias("_r"), "_anchors"), own).select("_key", "_row", "_text", "_anchors")
        windows = written(again.mapInArrow(hashed, f"_key {kind}, _row bigint, start int, a bigint, b bigint"))
        counted = windows.groupBy("a", "b").agg(F.min("_key").alias("_least"), F.max("_key").alias("_most"), F.count("*").alias("_n")).where("_least < _most").select("a", "b", "_least", "_n")
        hits = by_key(windows, written(counted), ["a", "b"], "_n").where("_key > _least").select("_key", "_row", "start")
        starts = hits.groupBy("_key", "_row").agg(F.collect_set("start").alias("starts"))
        whole = copies.select("_key", "_row", F.lit(None).cast("array<int>").alias("starts"))
        out = written(starts.unionByName(whole))
        keep.append(out)
    return out


def remove_repeats(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text", gram: int = GRAM, every: bool = False) -> DataFrame:
    """Remove every word that a repeated window covers.

    A window is ``window`` consecutive words (cut at ASCII white space) of one document; it repeats
    if the same words also start in a document with a smaller key.  Windows are judged on the
    input.  Overlapping and touching windows merge into maximal intervals of words.

    Windows are hashed twice by Rabin-Karp's rolling polynomials over 64-bit word hashes, and Spark
    counts each pair of hashes and takes its least key.  Not every window is hashed, unless
    ``every`` is set: those that cannot repeat are left out before, without loss.  Each window holds
    a gram that is least within it, and equal windows hold the same one, so only windows around such
    grams found in two different texts are hashed; and of texts that repeat whole, the one with the
    smallest key alone is searched, since the others repeat entirely.  Counts and minima are
    combined before they are shuffled, and windows of a hash that very many share meet its minimum
    where they are (``by_key``), so a passage in a third of all documents is spread as they are.

    Returns key, n_words, n_removed, intervals (arrays of start and end, in words, end exclusive)
    and kept_text (kept words joined by one space).  Null and empty texts have no word and nothing
    removed; rows with a null key are left as they are; rows that share a key do not repeat each
    other, and each is judged for itself; extra columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()
    marks = repeated_windows(docs, window, key, text, gram, every).select(F.col("_key").alias("_k"), F.col("_row").alias("_r"), "starts", F.lit(True).alias("_marked"))
    rows = docs.select(F.col(key).alias("_key"), row_hash(F.col(text)).alias("_row"), F.col(text).alias("_text"))
    joined = rows.join(marks, (F.col("_key") == F.col("_k")) & (F.col("_row") == F.col("_r")), "left").select("_key", "_text", "_marked", "starts")

    def run(batches):
        for batch in batches:
            n, gone, spans, kept = [], [], [], []
            for t, marked, starts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                w = split(t)
                n.append(len(w))
                if not marked or len(w) < window:
                    gone.append(0)
                    spans.append([])
                    kept.append(b" ".join(w))
                    continue
                at = np.sort(np.asarray(starts, dtype=np.int64)) if starts is not None else np.arange(len(w) - window + 1)
                cut = np.flatnonzero(np.diff(at) > window) + 1
                runs_ = [(int(g[0]), int(g[-1]) + window) for g in np.split(at, cut)]
                spans.append([list(x) for x in runs_])
                gone.append(sum(b - a for a, b in runs_))
                ends = [0, *(x for r in runs_ for x in r), len(w)]
                kept.append(b" ".join(x for a, b in zip(ends[::2], ends[1::2], strict=True) for x in w[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array([x.decode() for x in kept], pa.string())], names=[key, "n_words", "n_removed", "intervals", "kept_text"])

    return joined.mapInArrow(run, f"{key} {kind}, n_words bigint, n_removed bigint, intervals array<array<int>>, kept_text string")


def digest(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    return removed.select(key, "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def oracle(window: int = 50) -> str:
    """DuckDB SQL of ``remove_repeats`` and ``digest``: every window as text."""
    return f"""
    WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + {window} - 1], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window} + 2)) AS i FROM d WHERE len(w) >= {window})),
    m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
    r AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS x FROM g JOIN m USING (h) WHERE doc_id > least),
    k AS (SELECT doc_id, count(*) AS n, list(x) AS xs FROM r GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
        sha256(coalesce(array_to_string(CASE WHEN xs IS NULL THEN w ELSE (SELECT list(y.w ORDER BY y.x) FROM (SELECT unnest(d.w) AS w, unnest(range(1, len(d.w) + 1)) AS x) y WHERE NOT list_contains(k.xs, y.x)) END, ' '), '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)"""
