"""A living inverted index: immutable segments, tombstones, merges, and searches that skip blocks."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from heddle.functions.text import tokens
from heddle.sources.snapshots import Snapshots
from heddle.sources.tables import dropped, few, settled

#: Postings of a block, and blocks of a list that a search reads before it knows its threshold.
BLOCK, HEAD = 128, 8
#: More than what summing scores in another order can change, as a share of them.
EXACT = 1e-9

_ONE = "struct<key:{key},tf:bigint,dl:bigint>"
KINDS = {
    "documents": "seq long, repo string, key {key}, field string, dl long, terms array<struct<term:string,tf:bigint>>",
    "deleted": "seq long, repo string, key {key}",
    "totals": "seq long, victim long, repo string, field string, n long, dl long",
    "gone": "seq long, victim long, repo string, field string, term string, n long",
    "blocks": f"seq long, repo string, field string, term string, block long, n long, max_tf long, min_dl long, docs array<{_ONE}>",
}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (repo, key, field, dl, t) with their terms, sorted, and how often each occurs, in the place of their tokens."""
    for batch in batches:
        tokens_ = batch.column(4)
        flat = tokens_.flatten().dictionary_encode()
        words = np.asarray(flat.dictionary.to_pylist(), dtype=object)
        order = np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        row = pc.list_parent_indices(tokens_).to_numpy()
        pairs, tf = np.unique(row * max(1, len(words)) + place[flat.indices.to_numpy()], return_counts=True)
        at = np.searchsorted(pairs // max(1, len(words)), np.arange(batch.num_rows + 1))
        term = pa.array(words[order][pairs % max(1, len(words))], pa.string())
        terms = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([term, pa.array(tf, pa.int64())], ["term", "tf"]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], terms], ["repo", "key", "field", "dl", "terms"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings (seq, repo, field, term, block, key, tf, dl) as blocks; no more than one is held over to the next batch."""

    def blocks(rows: pa.Table, starts: np.ndarray, end: int) -> pa.RecordBatch:
        first = rows.take(pa.array(starts)).select(["seq", "repo", "field", "term", "block"]).combine_chunks()
        own = rows.slice(0, end).combine_chunks()
        tf, dl = own["tf"].to_numpy(), own["dl"].to_numpy()
        one = pa.StructArray.from_arrays([own[c].combine_chunks() for c in ("key", "tf", "dl")], ["key", "tf", "dl"])
        docs = pa.ListArray.from_arrays(pa.array([*starts, end], pa.int32()), one)
        sizes = [pa.array(np.diff([*starts, end])), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(dl, starts)), docs]
        return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in first.columns], *sizes], [*first.column_names, "n", "max_tf", "min_dl", "docs"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        rows = new if held is None else pa.concat_tables([held, new])
        change = np.zeros(len(rows), bool)
        change[0] = True
        for name in ("repo", "field", "term", "block"):
            codes = rows[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(change)
        if len(starts) > 1:
            yield blocks(rows, starts[:-1], int(starts[-1]))
        held = rows.slice(int(starts[-1])).combine_chunks()
    if held is not None:
        yield blocks(held, np.zeros(1, np.int64), len(held))


@dataclass(frozen=True)
class Found:
    """Hits (repo, key, score, rank), how many blocks the query's lists have, and how many had to be read."""

    hits: DataFrame
    blocks: int
    read: int


class SegmentedIndex:
    """BM25 over several fields of the documents of several repositories, a document being a (repo, key).

    Each ``add`` or ``remove`` writes one segment and notes it in a versioned list (``Snapshots``), so that
    searches see all of it or nothing, and of two writers one gets ``Conflict``.  A segment holds its documents with
    their terms, the keys that it replaces or deletes in older segments (tombstones), what these took
    from totals and document frequencies, and its postings in blocks.  So the totals and frequencies of
    a search are sums of small tables and always those of the live documents, as in an index made anew.

    The postings of a term are in blocks of BLOCK, the most frequent in the shortest documents first; they are dealt out by ranges,
    so a term of very many documents is no task's alone.  A block says its greatest frequency and its
    shortest document, which bound the score of any posting in it, whatever the averages are by then.
    """

    def __init__(self, spark: SparkSession, path: str, fields: list[str], key: str = "doc_id", repo: str = "repo", key_type: str = "string"):
        self.spark, self.path, self.fields, self.key, self.repo, self.key_type = spark, path.rstrip("/"), fields, key, repo, key_type
        self.store = Snapshots(spark, f"{self.path}/list")

    # --- segments --------------------------------------------------------------------------------

    def segments(self, version: int | None = None) -> list[tuple[int, str]]:
        """(seq, name) of the segments, oldest first."""
        table = self.store.read(version)
        return [] if table is None else sorted((r["seq"], r["name"]) for r in table.collect())  # a row for each segment; merges keep them few

    def _read(self, kind: str, segments: list[tuple[int, str]]) -> DataFrame:
        schema = KINDS[kind].format(key=self.key_type)
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/segments/{name}/{kind}" for _, name in segments])

    def _dead(self, segments: list[tuple[int, str]]) -> DataFrame:
        """(repo, key) of every tombstone, with the newest one's number."""
        return self._read("deleted", segments).groupBy("repo", "key").agg(F.max("seq").alias("_dead"))

    def _live(self, rows: DataFrame, segments: list[tuple[int, str]]) -> DataFrame:
        """Rows (seq, repo, key, ...) without those that a newer segment replaced or deleted."""
        dead = self._dead(segments).withColumnsRenamed({"repo": "_r", "key": "_k"})
        return rows.join(few(dead), rows["repo"].eqNullSafe(dead["_r"]) & rows["key"].eqNullSafe(dead["_k"]) & (dead["_dead"] > rows["seq"]), "left_anti")

    def documents(self, docs: DataFrame) -> DataFrame:
        """(repo, key, field, dl, terms) of documents; of rows that share repo and key the one with the greatest fields."""
        rows = docs.groupBy(F.col(self.repo).cast("string").alias("repo"), F.col(self.key).cast(self.key_type).alias("key")).agg(F.max(F.struct(*[F.col(f).cast("string").alias(f"_{i}") for i, f in enumerate(self.fields)])).alias("_f"))
        each = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f"_f._{i}")).alias("t")) for i, f in enumerate(self.fields)])
        cut = rows.select("repo", "key", F.inline(each)).select("repo", "key", "field", F.size("t").cast("long").alias("dl"), "t")
        return cut.mapInArrow(_counted, f"repo string, key {self.key_type}, field string, dl long, terms array<struct<term:string,tf:bigint>>")

    def _blocks(self, documents: DataFrame) -> DataFrame:
        """Postings in blocks.  Ranges of (term, field, repo, frequency down, length up) are sorted; a block is what of
        one list stands in BLOCK rows in a row, so its postings are much alike and its bound is close.  A block lies in one range, where it is cut as the rows
        pass; the ranges are in the order of terms, so what is stored is too."""
        rows = documents.select("seq", "repo", "field", "key", "dl", F.inline("terms"))
        order = ["term", "field", "repo", F.desc("tf"), "dl", "key"]
        ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        ranged = ranged.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK))
        kind = KINDS["blocks"].format(key=self.key_type)
        return ranged.select("seq", "repo", "field", "term", "block", "key", "tf", "dl").mapInArrow(_cut, kind)

    def _added(self, base: int, old: list[tuple[int, str]], documents: DataFrame | None, tombs: DataFrame | None, keep: list[tuple[int, str]], carried: dict[str, DataFrame] | None = None) -> int:
        """Write a segment and the list ``keep`` with it as the version after ``base``.  ``tombs`` are the keys that it takes out
        of the ``old`` segments, its documents' own if none are given."""
        seq, name = base + 1, uuid.uuid4().hex
        where = f"{self.path}/segments/{name}"
        kind = lambda name: KINDS[name].format(key=self.key_type)
        held = self.spark.createDataFrame([], kind("documents")) if documents is None else settled(documents.withColumn("seq", F.lit(seq).cast("long")))
        totals = held.groupBy("repo", "field").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).withColumn("victim", F.lit(None).cast("long"))
        gone, temporary = self.spark.createDataFrame([], kind("gone")), [held] if documents is not None else []
        if old:
            tombs = settled((held if tombs is None else tombs).select("repo", "key").distinct())
            mine = tombs.withColumnsRenamed({"repo": "_r", "key": "_k"})
            stored = self._read("documents", old)
            victims = settled(self._live(stored, old).join(few(mine), stored["repo"].eqNullSafe(mine["_r"]) & stored["key"].eqNullSafe(mine["_k"]), "left_semi").select(F.col("seq").alias("victim"), "repo", "field", "dl", "terms"))
            totals = totals.unionByName(victims.groupBy("victim", "repo", "field").agg((-F.count("*")).alias("n"), (-F.sum("dl")).alias("dl")))
            gone = victims.select("victim", "repo", "field", F.inline("terms")).groupBy("victim", "repo", "field", "term").agg(F.count("*").alias("n"))
            temporary += [tombs, victims]
        else:
            tombs = self.spark.createDataFrame([], f"repo string, key {self.key_type}")  # nothing is older
        out = {"documents": held, "deleted": tombs, "totals": totals, "gone": gone, "blocks": self._blocks(held)}

        def write(name: str) -> None:
            df, more = out[name].withColumn("seq", F.lit(seq).cast("long")), (carried or {}).get(name)
            df = df if more is None else df.unionByName(more, allowMissingColumns=True)
            df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(kind(name))]).write.parquet(f"{where}/{name}")

        with ThreadPoolExecutor(len(out)) as pool:  # five writes that don't depend on each other
            list(pool.map(write, out))
        listed = self.spark.createDataFrame([*keep, (seq, name)], "seq long, name string").coalesce(1)
        version = self.store.write(listed, base)
        dropped(*temporary)
        return version

    def add(self, docs: DataFrame) -> int:
        """Add documents (repo, key and fields); those that have been added before are replaced.  Returns the new version."""
        base = self.store.current()
        old = self.segments(base)
        return self._added(base, old, self.documents(docs), None, old)

    def remove(self, keys: DataFrame) -> int:
        """Delete documents (repo, key); keys that there are not are left alone."""
        base = self.store.current()
        old = self.segments(base)
        return self._added(base, old, None, keys.select(F.col(self.repo).cast("string").alias("repo"), F.col(self.key).cast(self.key_type).alias("key")), old)

    def merge(self, newest: int | None = None) -> int:
        """Make one segment of the newest so many (of all, if none is given): their live documents, and what
        they took from older ones.  Searches give the same as before."""
        base = self.store.current()
        old = self.segments(base)
        n = len(old) if newest is None else max(0, min(newest, len(old)))
        if n < 2:
            return base
        merged, kept = old[len(old) - n :], old[: len(old) - n]
        live = self._live(self._read("documents", merged), merged).drop("seq")
        if not kept:
            return self._added(base, [], live, None, [])
        outside = F.col("victim").isin([seq for seq, _ in kept])
        carried = {"deleted": self._read("deleted", merged).select("repo", "key").distinct(), "totals": self._read("totals", merged).where(outside), "gone": self._read("gone", merged).where(outside)}
        seq = base + 1
        return self._added(base, [], live, None, kept, {k: v.withColumn("seq", F.lit(seq).cast("long")) for k, v in carried.items()})

    def vacuum(self, keep: int = 2) -> int:
        """Delete the segments that the newest ``keep`` versions don't list; returns how many went."""
        self.store.vacuum(keep)
        stay = {name for v in self.store.versions() for _, name in self.segments(v)}
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        where = path(f"{self.path}/segments")
        gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName() not in stay] if fs.exists(where) else []
        for old in gone:
            fs.delete(old, True)
        return len(gone)

    # --- searches --------------------------------------------------------------------------------

    def search(self, query: str, k: int = 10, repo: str | None = None, fields: list[str] | None = None, k1: float = 1.2, b: float = 0.75) -> Found:
        """The best ``k`` documents, BM25 summed over fields; ties by repository and key.

        First the heads of the query's lists are read; the k-th best sum among their live documents is a
        threshold that the k-th best document reaches.  A block whose bound, with the greatest bounds of all
        other lists, stays under it holds none of the best, so it is skipped; all blocks of the
        best documents are read, and their scores are whole.  Only documents of ``repo`` count, also for totals, if one is
        given.  A query without a token finds nothing, and no query fails to parse.
        """
        version = self.store.current()
        segments = self.segments(version)
        terms = list(dict.fromkeys(t.lower() for t in re.findall("[A-Za-z][A-Za-z0-9]+", query.translate(str.maketrans("._", "  ")))))
        if not terms or not segments or k < 1:
            return Found(self.spark.createDataFrame([], f"repo string, key {self.key_type}, score double, rank int"), 0, 0)

        def own(df: DataFrame) -> DataFrame:
            for name, xs in (("repo", [repo] if repo is not None else None), ("field", fields)):
                df = df if xs is None else df.where(F.col(name).isin(*xs))
            return df

        blocks = own(self._read("blocks", segments)).where(F.col("term").isin(*terms))
        totals = own(self._read("totals", segments)).groupBy("field").agg(F.sum("n").cast("double").alias("_n"), F.sum("dl").alias("_dl"))
        df = blocks.select("field", "term", "n").unionByName(own(self._read("gone", segments)).where(F.col("term").isin(*terms)).select("field", "term", (-F.col("n")).alias("n")))
        df = df.groupBy("field", "term").agg(F.sum("n").cast("double").alias("_df")).where("_df > 0")
        idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
        weights = settled(df.join(totals, "field").select("field", "term", idf.alias("_idf"), (F.col("_dl") / F.col("_n")).alias("_avg")))  # terms times fields

        part = lambda tf, dl: F.col("_idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("_avg")))
        meta = blocks.select("seq", "repo", "field", "term", "block", "max_tf", "min_dl").join(F.broadcast(weights), ["field", "term"])
        meta = settled(meta.withColumn("_bound", part(F.col("max_tf"), F.col("min_dl"))).drop("max_tf", "min_dl"))
        place = ["seq", "repo", "field", "term", "block"]

        def scores(some: DataFrame) -> DataFrame:
            wanted = some.select(F.col("repo").alias("_r"), *[F.col(c).alias(f"_{c}") for c in place if c != "repo"], "_idf", "_avg")
            same = blocks["repo"].eqNullSafe(wanted["_r"])
            for c in place:
                same = same if c == "repo" else same & (blocks[c] == wanted[f"_{c}"])
            rows = blocks.join(few(wanted), same).select("seq", "repo", "_idf", "_avg", F.inline("docs"))
            return self._live(rows.select("seq", "repo", "key", part(F.col("tf"), F.col("dl")).alias("_part")), segments).groupBy("repo", "key").agg(F.sum("_part").alias("score"))

        head = meta.withColumn("_at", F.row_number().over(W.partitionBy("field", "term").orderBy(F.desc("_bound"), *place))).where(F.col("_at") <= HEAD)
        first = scores(head).orderBy(F.desc("score")).limit(k).agg(F.count("*"), F.min("score")).first()
        threshold = first[1] * (1 - EXACT) if first[0] == k else float("-inf")
        tops = {(r["field"], r["term"]): r["_top"] for r in meta.groupBy("field", "term").agg(F.max("_bound").alias("_top")).collect()}  # terms times fields
        others = F.lit(0.0)
        for (f, t), top in tops.items():
            others = others + F.when((F.col("field") == f) & (F.col("term") == t), 0.0).otherwise(top)
        kept = meta.where((F.col("_bound") + others) * (1 + EXACT) >= threshold)
        best = scores(kept).orderBy(F.desc("score"), "repo", "key").limit(k)
        hits = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "repo", "key")))
        return Found(hits, meta.count(), kept.count())


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
