"""Neighbours of many queries, stored inverted lists, and clusters of a defined start, in blocks of vectors."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.sources.snapshots import Snapshots
from heddle.sources.tables import dropped, settled

#: Numbers of a block of rows, and of queries; rows in them at most and at least.
ROW_CELLS, QUERY_CELLS, MOST_ROWS, MOST_QUERIES, LEAST = 1 << 17, 1 << 15, 2048, 512, 16
#: Query blocks whose best rows a task holds at once, and groups at least that rows are dealt into: a query has k rows from each.
HELD, GROUPS = 256, 4
#: Places to which scores are rounded before they are ranked, so that rows as near as each other go by key.
PLACES = 9


def _sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with a key and a vector without missing or non-finite numbers, one for each key (the least vector)."""
    ok = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(ok).groupBy(F.col(key).alias("key")).agg(F.min(vector).alias("vector"))


def _units(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of length 1; short ones are padded with zeros, zero ones stay."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def _dims(*tables: DataFrame) -> int:
    return max([1, *((t.agg(F.max(F.size("vector"))).first()[0] or 0) for t in tables)])


def _wide(cells: int, most: int, dims: int) -> int:
    return max(LEAST, min(most, cells // dims))


def blocks(rows: DataFrame, dims: int, most: int) -> DataFrame:
    """Rows (list, key, vector) as blocks (list, keys, units) of up to ``most`` rows of one list that stand one after another."""
    kind = rows.schema["key"].dataType
    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("units", T.BinaryType())])
    arrow = pa.schema([("list", pa.int32()), ("keys", pa.list_(T_arrow(kind))), ("units", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, units, n = None, [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"list": at, "keys": keys, "units": np.concatenate(units).tobytes()}], arrow)

        for batch in batches:
            lists, names = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            unit = _units(batch.column(2), dims)
            ends = [*(np.flatnonzero(np.diff(lists)) + 1), len(lists)]
            start = 0
            for end in ends:
                while start < end:
                    if keys and (lists[start] != at or n == most):
                        yield block()
                        keys, units, n = [], [], 0
                    at = int(lists[start])
                    take = min(end - start, most - n)
                    keys += names[start : start + take]
                    units.append(unit[start : start + take])
                    n, start = n + take, start + take
        if keys:
            yield block()

    return rows.select("list", "key", "vector").mapInArrow(cut, schema)


def T_arrow(kind: T.DataType) -> pa.DataType:
    """Arrow's type of a key."""
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]


def _best(held: tuple[np.ndarray, np.ndarray, np.ndarray], group: np.ndarray, score: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each group, score down and key up, of what was held and what is new."""
    g, s, d = (np.concatenate(x) for x in zip(held, (group, score, keys), strict=True))
    order = np.lexsort((d, -s, g))
    g, s, d = g[order], s[order], d[order]
    stays = np.arange(len(g)) - np.searchsorted(g, g) < k
    return g[stays], s[stays], d[stays]


def _scanned(k: int, dims: int, apart: bool, kind: pa.DataType) -> Callable:
    """Function for ``mapInArrow`` over pairs of a block of rows (list, keys, units) and one of queries (q_keys,
    q_units, q_probes): the first k rows that each task knows of each query.  ``q_probes`` has a row of bits for each list,
    the queries that probe it; without any all queries do.  Of a product only what reaches a query's k-th score so far is looked at, so what a
    task holds and sends is bounded by its queries.  Blocks are used where Arrow has them, one pair at a time."""
    near = 2 * 10.0**-PLACES  # more than what rounding can change

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def found() -> Iterator[pa.RecordBatch]:
            for names, _, (g, s, d) in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(names[g].tolist(), kind), pa.array(d.tolist(), kind), pa.array(s)], ["query", "key", "score"])
            held.clear()

        for batch in batches:
            list_, keys_, units_, q_keys, q_units, q_probes = batch.columns
            for at in range(batch.num_rows):
                names = np.asarray(q_keys[at].values.to_pylist())
                name = names[0]  # a query is in one block
                if name not in held and len(held) == HELD:
                    yield from found()
                if name not in held:
                    held[name] = names, np.full(len(names), -np.inf), (np.zeros(0, np.int64), np.zeros(0), names[:0])
                least, old = held[name][1:]
                q, r = (np.frombuffer(c[at].as_buffer()).reshape(-1, dims) for c in (q_units, units_))
                bits = np.frombuffer(q_probes[at].as_buffer(), np.uint8)
                who = np.arange(len(names))
                if len(bits):
                    wide = -(-len(names) // 8)
                    who = np.flatnonzero(np.unpackbits(bits[list_[at].as_py() * wide :][:wide], count=len(names)))
                    q = q[who]
                if not len(who):
                    continue
                s = q @ r.T
                s[~q.any(axis=1)] = -np.inf  # nothing is near a zero vector, nor is a zero vector near anything
                if not (some := r.any(axis=1)).all():
                    s[:, ~some] = -np.inf
                floor = least[who]
                if s.shape[1] > 4 * k and (floor == -np.inf).any():  # with one more, as a row may be the query itself
                    floor = np.maximum(floor, -np.partition(-s, k, axis=1)[:, k])
                i, j = np.nonzero(s >= np.maximum(floor - near, -2)[:, None])
                keys = np.asarray(keys_[at].values.to_pylist())
                if apart:
                    other = names[who[i]] != keys[j]
                    i, j = i[other], j[other]
                if len(i):
                    g, score, d = _best(old, who[i], np.round(s[i, j], PLACES), keys[j], k)
                    start = np.searchsorted(g, np.arange(len(names) + 1))
                    full = np.flatnonzero(np.diff(start) == k)
                    least[full] = score[start[full] + k - 1]
                    held[name] = names, least, (g, score, d)
        yield from found()

    return scan


def _ranked(rows: DataFrame, queries: DataFrame, k: int, dims: int, apart: bool) -> DataFrame:
    """The best k of all blocks of rows for each query.  Groups of rows meet groups of queries, both of blocks: every
    query has k rows from each group of rows, and there are more than GROUPS of these only where queries are too few to be shared out."""
    kind = rows.schema["keys"].dataType.elementType
    parts, n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, queries.count())
    shares = min(n, max(parts, 2 * n // HELD))
    r, q = rows.select("list", "keys", "units").repartition(max(GROUPS, parts // shares)), queries.select("q_keys", "q_units", "q_probes", "q_lists").repartition(shares)
    pairs = r.join(q.hint("shuffle_replicate_nl"), F.col("q_lists").isNull() | F.array_contains("q_lists", F.col("list")))  # blocks, not rows
    found = pairs.select("list", "keys", "units", "q_keys", "q_units", "q_probes").mapInArrow(_scanned(k, dims, apart, T_arrow(kind)), T.StructType([T.StructField("query", kind), T.StructField("key", kind), T.StructField("score", T.DoubleType())]))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query", "rank", "key", "score")


def _probed(queries: DataFrame, centres: np.ndarray, dims: int, probes: int) -> DataFrame:
    """Blocks of queries (q_keys, q_units) with the lists that some of them probe, and a row of bits for each list."""
    held = queries.sparkSession.sparkContext.broadcast(centres)  # as many as k_means or a bounded fit gives
    schema = T.StructType([queries.schema["q_keys"], queries.schema["q_units"], T.StructField("q_probes", T.BinaryType()), T.StructField("q_lists", T.ArrayType(T.IntegerType()))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                unit = np.frombuffer(batch.column(1)[at].as_buffer()).reshape(-1, dims)
                near = np.argsort(np.round(_distances(unit, held.value), PLACES), axis=1, kind="stable")[:, :probes]
                hit = np.zeros((len(held.value), len(unit)), bool)
                hit[near, np.arange(len(unit))[:, None]] = True
                one = batch.slice(at, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([np.packbits(hit, axis=1).tobytes()], pa.binary()), pa.array([np.flatnonzero(hit.any(axis=1)).tolist()], pa.list_(pa.int32()))], ["q_keys", "q_units", "q_probes", "q_lists"])

    return queries.select("q_keys", "q_units").mapInArrow(probe, schema)


def k_nearest(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", apart: bool = True) -> DataFrame:
    """The k rows with the greatest cosine for each of many queries: query, rank, key, score.

    Rows and queries are cut into blocks of bounded size; each pair of blocks is one product of matrices,
    of which the first k a query stay, and a window over what the tasks found gives the result: no list of all
    pairs is ever made.  Scores are rounded to PLACES places, ties go to the smaller key.  With ``apart`` a row is
    not its own neighbour.  Missing, empty and zero vectors are nobody's neighbours and have none; rows that
    share a key are one; vectors of different lengths are padded with zeros.
    """
    data, asked = settled(_sound(rows, key, vector)), settled(_sound(queries, key, vector))
    dims = _dims(data, asked)
    one = F.lit(0).alias("list")
    r = settled(blocks(data.select(one, "key", "vector"), dims, _wide(ROW_CELLS, MOST_ROWS, dims)))
    q = settled(blocks(asked.select(one, "key", "vector"), dims, _wide(QUERY_CELLS, MOST_QUERIES, dims)))
    every = [F.lit(b"").alias("q_probes"), F.lit(None).cast("array<int>").alias("q_lists")]
    return _ranked(r, q.select(F.col("keys").alias("q_keys"), F.col("units").alias("q_units"), *every), k, dims, apart)


# --- clusters ------------------------------------------------------------------------------------


def _distances(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centre."""
    return np.maximum((unit**2).sum(axis=1)[:, None] - 2 * unit @ centres.T + (centres**2).sum(axis=1), 0)


def _farthest(rows: DataFrame, centres: np.ndarray, dims: int) -> list[tuple[float, object, np.ndarray]]:
    """(distance, key, unit vector) of the row farthest from its nearest centre, ties to the smaller key."""
    kind = rows.schema["key"].dataType

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if batch.num_rows:
                unit, keys = _units(batch.column(1), dims), np.asarray(batch.column(0).to_pylist())
                d = np.round(_distances(unit, centres).min(axis=1), PLACES)
                i = np.lexsort((keys, -d))[0]
                if best is None or (-d[i], keys[i]) < (-best[0], best[1]):
                    best = d[i], keys[i], unit[i]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1].item()], T_arrow(kind)), pa.array([best[2].tolist()], pa.list_(pa.float64()))], ["d", "key", "unit"])

    schema = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("key", kind), T.StructField("unit", T.ArrayType(T.DoubleType()))])
    row = rows.select("key", "vector").mapInArrow(far, schema).orderBy(F.desc("d"), "key").first()
    return [(row["d"], row["key"], np.asarray(row["unit"]))] if row else []


def _sums(rows: DataFrame, centres: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of each centre, and the sums of their unit vectors.  A task sends one sum for each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centres), np.zeros(len(centres))
        for batch in batches:
            unit = _units(batch.column(0), dims)
            given = np.round(_distances(unit, centres), PLACES).argmin(axis=1)
            np.add.at(total, given, unit)
            n += np.bincount(given, minlength=len(centres))
        cells = np.concatenate([total, n[:, None]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "value"])

    cells = np.zeros(len(centres) * (dims + 1))
    for r in rows.select("vector").mapInArrow(add, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():  # centres times dimensions
        cells[r["cell"]] = r["value"]
    cells = cells.reshape(len(centres), dims + 1)
    return cells[:, dims], cells[:, :dims]


def k_means(rows: DataFrame, k: int, iterations: int = 25) -> tuple[np.ndarray, int]:
    """Centres of unit vectors (rows: key, vector, one for each key), and the dimensions.

    The start is defined: the row with the smallest key, then again and again the row farthest from
    the centres so far, ties to the smaller key.  Then up to ``iterations`` times each row goes to its nearest
    centre, the first of several, and a centre moves to its members' mean; one without members moves to the row
    farthest from its centre.  Nothing but the centres, at most 64 of them, is on the driver.
    """
    dims = _dims(rows)
    first = rows.orderBy("key").select("key", "vector").limit(1).toArrow()
    if not len(first):
        return np.zeros((0, dims)), dims
    centres = _units(first.column("vector").combine_chunks(), dims)
    while len(centres) < max(1, min(64, k)):
        far = _farthest(rows, centres, dims)
        if far[0][0] <= 0:
            break  # fewer different vectors than centres
        centres = np.vstack([centres, far[0][2]])
    for _ in range(iterations):
        n, sums = _sums(rows, centres, dims)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if (n == 0).any():
            moved[n == 0] = _farthest(rows, centres, dims)[0][2]
        if np.allclose(moved, centres, rtol=0, atol=1e-12):
            break
        centres = moved
    return centres, dims


def assigned(rows: DataFrame, centres: np.ndarray, dims: int, probes: int = 1) -> DataFrame:
    """(list, key, vector): each row beside its nearest ``probes`` centres' numbers."""
    kind = rows.schema["key"].dataType
    held = rows.sparkSession.sparkContext.broadcast(centres)  # as many as k_means or a bounded fit gives

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.round(_distances(_units(batch.column(1), dims), held.value), PLACES)
            near = np.argsort(d, axis=1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(len(near)), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["list", "key", "vector"])

    return rows.select("key", "vector").mapInArrow(give, T.StructType([T.StructField("list", T.IntegerType()), T.StructField("key", kind), rows.schema["vector"]]))


def clusters(df: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", iterations: int = 25) -> DataFrame:
    """k-means of unit vectors (``k_means``): key, cluster (0 the largest), size and label, the member with the
    greatest product with its cluster's mean; ties to the smaller key."""
    from heddle.operators.vector import dot, l2_normalised, mean_vectors

    rows = settled(_sound(df, key, vector))
    centres, dims = k_means(rows, k, iterations)
    if not len(centres):
        return rows.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("size"), F.col("key").alias("label"))
    given = settled(assigned(rows, centres, dims).select("key", l2_normalised(F.col("vector")).alias("_u"), F.col("list").alias("_c")))
    means = mean_vectors(given, ["_c"], "_u").select("_c", "centroid", F.col("n").alias("size"))
    near = given.join(F.broadcast(means), "_c").withColumn("_d", F.round(dot(F.col("_u"), F.col("centroid")), PLACES))  # 64 rows
    heads = near.groupBy("_c").agg(F.min_by("key", F.struct((-F.col("_d")).alias("_d"), "key")).alias("label"), F.first("size").alias("size"))
    named = heads.withColumn("cluster", (F.row_number().over(W.orderBy(F.desc("size"), "label")) - 1).cast("int"))
    return given.select("key", "_c").join(F.broadcast(named), "_c").select(F.col("key").alias(key), "cluster", "size", "label")


# --- stored lists --------------------------------------------------------------------------------


class InvertedLists:
    """A nearest-neighbour index on disk: vectors in the lists of their nearest centres, exact within what is probed.

    ``build`` fits the centres on a bounded sample (the SAMPLE rows with the least hash of their key; LISTS centres at
    most), then puts every row into its nearest centre's list.  Lists are stored as blocks of unit vectors, a
    large one over many tasks.  The true neighbours of TRIED rows then tell how many of the nearest lists hold the
    share ``recall`` of them; so many are probed unless a search says otherwise.  ``search`` ranks what the lists
    hold by full cosines; as many probes as lists give the exact result.  Builds are versions
    (``Snapshots``): a search sees one of them whole.
    """

    SAMPLE, LISTS, STEPS, TRIED, NEAR = 65_536, 4096, 12, 128, 10

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store, self.centres = Snapshots(spark, f"{self.path}/lists"), f"{self.path}/centres"

    def build(self, df: DataFrame, lists: int | None = None, recall: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> int:
        """Index every row of a table; returns the new version."""
        rows = settled(_sound(df, key, vector))
        dims, n = _dims(rows), rows.count()
        k = max(1, min(self.LISTS, lists or round(n**0.5) or 1, n))
        sample = rows.orderBy(F.xxhash64("key"), "key").limit(self.SAMPLE).select("vector")
        steps = self.STEPS

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [_units(b.column(0), dims) for b in batches]
            unit = np.concatenate(parts) if parts else np.zeros((1, dims))
            centres = unit[:k].copy()
            for _ in range(steps):
                given = _distances(unit, centres).argmin(axis=1)
                total, m = np.zeros_like(centres), np.bincount(given, minlength=len(centres))
                np.add.at(total, given, unit)
                centres = np.where(m[:, None] > 0, total / np.maximum(m, 1)[:, None], centres)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), pa.array(centres.tolist(), pa.list_(pa.float64()))], ["list", "centre"])

        name = uuid.uuid4().hex
        sample.coalesce(1).mapInArrow(fit, "list long, centre array<double>").write.parquet(f"{self.centres}/{name}")
        centres = self._centres(name)
        given = settled(assigned(rows, centres, dims))
        probes = self._probes(rows, given, centres, dims, recall)
        ranged = given.repartitionByRange("list", F.xxhash64("key")).sortWithinPartitions("list", "key")
        version = self.store.write(blocks(ranged, dims, _wide(ROW_CELLS, MOST_ROWS, dims)).withColumns({"fit": F.lit(name), "probes": F.lit(probes)}))
        dropped(rows, given)
        return version

    def _probes(self, rows: DataFrame, given: DataFrame, centres: np.ndarray, dims: int, recall: float) -> int:
        """How many of a query's nearest lists hold the share ``recall`` of the neighbours of TRIED rows, those with the greatest hash."""
        tried = settled(rows.orderBy(F.xxhash64("key").desc(), "key").limit(self.TRIED))
        near = k_nearest(tried, rows, self.NEAR, "key", "vector").select("query", "key")
        held = near.join(given.select("key", "list").join(F.broadcast(near.select("key").distinct()), "key", "left_semi"), "key").collect()  # TRIED times NEAR rows
        vectors = tried.select("key", "vector").toArrow()
        order = np.argsort(np.round(_distances(_units(vectors.column("vector").combine_chunks(), dims), centres), PLACES), axis=1, kind="stable")
        place = {k: {int(c): i for i, c in enumerate(row)} for k, row in zip(vectors.column("key").to_pylist(), order, strict=True)}
        ranks = sorted(place[r["query"]][r["list"]] for r in held)
        dropped(tried)
        return ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] + 1 if ranks else 1

    def _centres(self, name: str) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.centres}/{name}").orderBy("list").collect()  # LISTS at most
        return np.asarray([r["centre"] for r in found])

    def search(self, queries: DataFrame, k: int, probes: int | None = None, key: str = "vec_id", vector: str = "embedding", apart: bool = True) -> DataFrame:
        """query, rank, key and score of the best k rows in the nearest ``probes`` lists of each query, or in as many as
        the build found to hold enough."""
        stored = self.store.read()
        name = None if stored is None else stored.select("fit", "probes").first()
        asked = settled(_sound(queries, key, vector))
        if name is None:
            return asked.select(F.col("key").alias("query"), F.lit(0).alias("rank"), "key", F.lit(0.0).alias("score")).limit(0)
        centres = self._centres(name["fit"])
        dims = centres.shape[1]
        probes = max(1, min(len(centres), probes or name["probes"]))
        homes = assigned(asked.withColumn("vector", F.slice("vector", F.lit(1), F.lit(dims))), centres, dims)  # so that those of a block probe much the same
        ranged = homes.repartitionByRange("list", F.xxhash64("key")).sortWithinPartitions("list", "key")
        q = blocks(ranged, dims, _wide(QUERY_CELLS, MOST_QUERIES, dims)).select(F.col("keys").alias("q_keys"), F.col("units").alias("q_units"))
        return _ranked(stored, settled(_probed(q, centres, dims, probes)), k, dims, apart)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
