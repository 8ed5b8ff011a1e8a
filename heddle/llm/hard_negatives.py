"""Hard negatives of anchors: exact integer products behind bounds from rotated leading components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.common import scratch, small_batches, written

#: Quantised components stay within this, so that products of up to 4,096 of them fit 64 bits.
LARGEST = 1 << 25
#: Vectors of so many components or more are not rotated: their own first components lead.
GRAM_DIMS = 1024
#: Numbers in a block of rows, and of anchors; rows in them at most and at least.
ROW_CELLS, ANCHOR_CELLS, MOST_ROWS, MOST_ANCHORS, LEAST = 1 << 17, 1 << 15, 2048, 512, 16
#: Anchor blocks whose best rows a task holds at once, and pairs verified at once.
HELD, PAIRS = 256, 1 << 16
NONE = np.iinfo(np.int64).min

BLOCK = "size int, ids binary, labels binary, scores binary, q binary, rotated binary"


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, q): a row for each key, q the integers floor(``scale`` * component), within LARGEST.

    Rows with a null key, label or vector, or any null or non-finite component, take no part.  Repeated
    rows are one; of different rows that share a key, the one with the least (label, q) takes part.
    """
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(vector, lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(x.cast("double") * scale).cast("double"))).cast("int"))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & sound)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), q.alias("q"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("_r")).select("id", "_r.label", "_r.q")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows of a matrix, short ones padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """Orthogonal matrix whose first columns carry most of the vectors' squared length: eigenvectors of the
    sum of outer products over all rows.  Each task sends one matrix; the sum has ``dims`` squared cells."""
    if dims >= GRAM_DIMS or dims == 0:
        return np.eye(dims)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            m = _matrix(batch.column(0), dims).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"cell": np.arange(dims * dims), "value": total.ravel()})

    cells = rows.select("q").mapInArrow(outer, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    gram = np.zeros(dims * dims)
    for r in cells.collect():
        gram[r["cell"]] = r["value"]
    return np.linalg.eigh(gram.reshape(dims, dims))[1][:, ::-1].copy()


def slack(turn: np.ndarray) -> float:
    """Share of the product of two norms that rounding, and a rotation not quite orthogonal, may add."""
    dims = len(turn)
    return float(np.linalg.norm(np.eye(dims) - turn @ turn.T)) + 16 * (dims + 1) * 2.0**-53


def blocks(rows: DataFrame, turn: np.ndarray, most: int) -> DataFrame:
    """Rows (id, label, q and, for anchors with thresholds, scores) as blocks of up to ``most``."""
    dims = len(turn)

    def block(parts: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(parts).combine_chunks()
        q = _matrix(t.column("q").chunk(0), dims)
        scores = _matrix(t.column("scores").chunk(0), t.column("scores").chunk(0).value_lengths().to_numpy().max()) if "scores" in t.column_names else np.zeros((0, 0), np.int64)
        raw = lambda name: t.column(name).to_numpy().astype(np.int64).tobytes()
        return {"size": len(t), "ids": raw("id"), "labels": raw("label"), "scores": scores.tobytes(), "q": q.astype(np.int32).tobytes(), "rotated": (q @ turn).tobytes()}

    schema = pa.schema([("size", pa.int32()), *[(n, pa.binary()) for n in ("ids", "labels", "scores", "q", "rotated")]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == most:
                    yield pa.RecordBatch.from_pylist([block(held)], schema)
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_pylist([block(held)], schema)

    return rows.mapInArrow(cut, BLOCK)


class Block:
    """Rows of a block, with the norms of what stands after each of the ``steps``."""

    def __init__(self, row: dict, dims: int, steps: tuple[int, ...]):
        n = row["size"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.q = np.frombuffer(row["q"], np.int32).reshape(n, dims)
        self.rotated = np.frombuffer(row["rotated"]).reshape(n, dims)
        self.scores = np.frombuffer(row["scores"], np.int64).reshape(n, -1) if row["scores"] else None
        squares = self.rotated**2
        self.norm = np.sqrt(squares.sum(axis=1))
        self.rest = [np.sqrt(squares[:, k:].sum(axis=1)) for k in steps]


def survivors(a: Block, b: Block, mask: np.ndarray, low: np.ndarray, high: np.ndarray, steps: tuple[int, ...], share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ``mask`` whose integer product lies between their anchor's ``low`` and ``high``: anchors'
    indices, rows' indices, products.

    The products of the first ``steps[0]`` rotated components, give or take the product of the norms of the
    rest and what rounding may add (``share`` of the full norms' product), discard most pairs; what is left
    goes on to the next step, and the last ones are verified by their integer products.
    """
    k = steps[0]
    part = a.rotated[:, :k] @ b.rotated[:, :k].T
    width = np.outer(a.rest[0], b.rest[0]) + share * np.outer(a.norm, b.norm)
    i, j = np.nonzero(mask & (part + width >= low[:, None]) & (part - width <= high[:, None]))
    sums = part[i, j]
    for step in range(1, len(steps)):
        if 4 * len(i) > mask.size:
            break  # so many pairs are cheaper as whole matrices
        for at in range(0, len(i), PAIRS):
            cut = slice(at, at + PAIRS)
            sums[cut] += np.einsum("ij,ij->i", a.rotated[i[cut], steps[step - 1] : steps[step]], b.rotated[j[cut], steps[step - 1] : steps[step]])
        width = a.rest[step][i] * b.rest[step][j] + share * a.norm[i] * b.norm[j]
        stays = (sums + width >= low[i]) & (sums - width <= high[i])
        i, j, sums = i[stays], j[stays], sums[stays]
    if 4 * len(i) > mask.size:
        exact = _products(a.q, b.q)[i, j]
    else:
        exact = np.empty(len(i), np.int64)
        for at in range(0, len(i), PAIRS):
            cut = slice(at, at + PAIRS)
            exact[cut] = np.einsum("ij,ij->i", a.q[i[cut]].astype(np.int64), b.q[j[cut]].astype(np.int64))
    stays = (exact >= low[i]) & (exact <= high[i])
    return i[stays], j[stays], exact[stays]


def _products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """All integer products; by floating point where every sum is a whole number below 2^53, so exact."""
    largest = lambda x: int(np.abs(x).max(initial=0))
    if largest(p) * largest(q) * p.shape[1] < 1 << 53:
        return (p.astype(float) @ q.astype(float).T).astype(np.int64)
    return p.astype(np.int64) @ q.astype(np.int64).T


class Best:
    """The first ``k`` (score down, id up) of each of ``groups`` lists."""

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, NONE)
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        g, s, d = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((d, -s, g))
        g, s, d = g[order], s[order], d[order]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        stays = rank < self.k
        self.group, self.score, self.id, rank = g[stays], s[stays], d[stays], rank[stays]
        full = rank == self.k - 1
        self.least[self.group[full]] = self.score[full]


def _scanned(dims: int, steps: tuple[int, ...], share: float, k: int, low: int | None, high: int | None) -> Callable:
    """Function for ``mapInArrow`` over pairs of an anchor block and a row block: each task's first k
    rows of each anchor's own label or, with low and high (percents of an anchor's scores), its first k rows of
    other labels between these, for each of the scores."""

    def found(anchors: Block, best: Best) -> pa.RecordBatch:
        slots = 1 if low is None else anchors.scores.shape[1]
        return pa.RecordBatch.from_pydict({"anchor": anchors.ids[best.group // slots], "slot": (best.group % slots).astype(np.int32), "id": best.id, "score": best.score})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Block, Best]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                a_row, b = {n[2:]: v for n, v in row.items() if n.startswith("a_")}, Block({n: v for n, v in row.items() if not n.startswith("a_")}, dims, steps)
                name = int(np.frombuffer(a_row["ids"], np.int64)[0])
                if name not in held:
                    if len(held) == HELD:
                        yield from (found(*x) for x in held.values())
                        held.clear()
                    a = Block(a_row, dims, steps)
                    held[name] = a, Best(len(a.ids) * (1 if low is None else a.scores.shape[1]), k)
                a, best = held[name]
                same = a.labels[:, None] == b.labels
                if low is None:
                    i, j, s = survivors(a, b, same & (a.ids[:, None] != b.ids), best.least, np.full(len(a.ids), np.iinfo(np.int64).max), steps, share)
                    best.add(i, s, b.ids[j])
                    continue
                slots = a.scores.shape[1]
                real = a.scores != NONE
                floor = np.where(real, -((-low * np.where(real, a.scores, 0)) // 100), np.iinfo(np.int64).max)
                top = np.where(real, high * np.where(real, a.scores, 0) // 100, NONE)
                need = np.maximum(floor, best.least.reshape(-1, slots))
                i, j, s = survivors(a, b, ~same, need.min(axis=1), top.max(axis=1), steps, share)
                fit = [(s >= need[i, t]) & (s <= top[i, t]) for t in range(slots)]
                best.add(np.concatenate([i[f] * slots + t for t, f in enumerate(fit)]), np.concatenate([s[f] for f in fit]), np.concatenate([b.ids[j[f]] for f in fit]))
        yield from (found(*x) for x in held.values())

    return scan


def hard_negatives(
    vectors: DataFrame, anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256
) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives``
    rows of other labels whose score is ``low`` to ``high`` percent of the positive's.

    A score is the integer inner product of quantised vectors (``usable``); higher ones come first, ties go
    to the smaller key.  ``anchor`` says of a key whether it is an anchor's.  All rows meet all anchors
    in blocks of bounded size, two times: for the positives, then for the negatives between the bounds
    that these set.  Vectors are turned so that their first components carry most of their length; partial
    products of these bound a pair's score, and a pair that cannot reach the anchor's list as the task
    knows it so far is discarded early (``survivors``).  What a task returns is k rows an anchor and list; a
    window over these, tasks times k a list, gives the result.  Nothing but blocks is ever in memory, and
    the driver gets the dimensions and one matrix.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  Anchors without positives,
    and positives without fitting negatives (all with a score under 0), have no row.  Vectors of different
    lengths are padded with zeros; components beyond 2^25 / ``scale`` saturate; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    with scratch() as keep:
        rows = written(usable(vectors, key, vector, label, scale))
        dims, n = rows.agg(F.max(F.size("q")), F.count("*")).first()
        dims = max(dims or 0, 1)
        turn = rotation(rows, dims)
        steps, share = tuple(sorted({max(1, dims // 4), max(1, dims // 2)})), slack(turn)
        wide = lambda cells, most: max(LEAST, min(most, cells // dims))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (64 * wide(ROW_CELLS, MOST_ROWS)))
        others = written(blocks(rows, turn, wide(ROW_CELLS, MOST_ROWS)))

        def best(anchors: DataFrame, k: int, *bounds: int) -> DataFrame:
            """Every block of anchors beside every block of rows: each row of the join is one product of matrices."""
            stated = written(blocks(anchors, turn, wide(ANCHOR_CELLS, MOST_ANCHORS)))
            stated = stated.select(*[F.col(c).alias(f"a_{c}") for c in stated.columns])
            pairs = others.repartition(parts).crossJoin(stated)
            found = pairs.mapInArrow(_scanned(dims, steps, share, k, *(bounds or (None, None))), "anchor long, slot int, id long, score long")
            place = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
            return written(found.withColumn("rank", place).where(F.col("rank") <= k))

        anchors = rows.where(anchor(F.col("id")))
        near = best(anchors, positives)
        lists = near.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("_s"))
        missing = F.array_repeat(F.lit(int(NONE)), F.lit(positives) - F.size("_s"))
        bounded = anchors.join(lists, "id").select("id", "label", "q", F.concat(F.col("_s.score"), missing).alias("scores"))
        far = best(bounded, negatives, low, high)
        keep += [near, far]
    chosen = near.select(F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), (F.col("rank") - 1).alias("_slot"), F.col("score").alias("positive_score"))
    out = far.join(chosen, (F.col("anchor") == F.col("anchor_id")) & (F.col("slot") == F.col("_slot")))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle() -> str:
    """DuckDB SQL of the query over embeddings: every anchor against every row."""
    return """
    WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.y = b.y AS same, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS s
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS MATERIALIZED (SELECT a, b AS positive, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
    n AS (SELECT p.*, s.b AS negative, s.s AS ns, row_number() OVER (PARTITION BY a, positive ORDER BY s.s DESC, s.b) AS rank FROM p JOIN s USING (a) WHERE NOT same AND 30 * ps <= 100 * s.s AND 100 * s.s <= 90 * ps)
    SELECT a AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 10"""
