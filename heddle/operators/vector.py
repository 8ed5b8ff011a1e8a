"""Vectors: normalisation, similarity, nearest neighbours, means and clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def guarded(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has ``dim`` numbers, none of them null."""
    return df.where((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()))


def preferred(df: DataFrame, vector: str = "embedding", newer: str = "embedding_v2") -> DataFrame:
    """The newer vector where there is one."""
    return df.withColumn(vector, F.coalesce(newer, vector)).drop(newer) if newer in df.columns else df


def top_k(df: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to a query vector: key, score, rank.  Only the top k of each task move."""
    q = F.array(*[F.lit(float(x)) for x in query])
    found = df.select(key, cosine(F.col(vector), q).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(k)
    return found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


def neighbours(df: DataFrame, seed, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to a stored row, itself left out; none if it is unknown or zero."""
    k = max(1, min(100, k))
    one = df.where(F.col(key) == seed).select(F.col(vector).alias("_q")).limit(1)
    near = df.where(F.col(key) != seed).join(F.broadcast(one), how="cross")  # one row
    return near.select(key, cosine(F.col(vector), F.col("_q")).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(k)


def mean_vectors(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Element-wise mean of each group's vectors, not scaled; shorter vectors count for the places
    they have.  One sum for each place, combined before rows are shuffled, so a group may be of any size."""
    dim = df.agg(F.max(F.size(vector))).first()[0] or 0
    means = [F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dim)]
    longest = F.max(F.size(vector))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.slice(F.array(*means), F.lit(1), longest).alias("centroid") if dim else F.array().cast("array<double>").alias("centroid"))
    return out.select(*by, "n", "centroid")


def central_mean(ranks: DataFrame, vectors: DataFrame, k: int, key: str, score: str, vector: str = "embedding") -> DataFrame:
    """Mean of the vectors of the k highest-ranked keys, and how many had one."""
    k = max(1, min(200, k))
    top = ranks.orderBy(F.desc(score), key).limit(k).select(key)  # 200 rows at most
    return mean_vectors(vectors.join(F.broadcast(top), key, "left_semi").withColumn("_all", F.lit(1)), ["_all"], vector).drop("_all")


def batch_outcome(rows: DataFrame, batch: str, expected: DataFrame) -> DataFrame:
    """Rows of embedding batches with their outcome.  ``rows``: batch, key, embedding, error;
    ``expected``: batch, n.  A batch with an error, or with other than the expected number of
    vectors, fails as a whole."""
    got = rows.groupBy(batch).agg(F.count("embedding").alias("_got"), F.bool_or(F.col("error").isNotNull()).alias("_error"))
    judged = expected.join(got, batch, "left").select(batch, F.coalesce(~F.col("_error") & (F.col("_got") == F.col("n")), F.lit(False)).alias("_ok"))
    out = rows.join(judged, batch, "left")
    return out.withColumn("outcome", F.when(F.coalesce("_ok", F.lit(False)), "embedded").otherwise("failed")).withColumn("embedding", F.when(F.col("outcome") == "embedded", F.col("embedding"))).drop("_ok")


def embedded(df: DataFrame, text: str, embed, dim: int, retries: int = 1, wait=None) -> DataFrame:
    """Rows with ``embedding`` by a function from texts to vectors, called once for each Arrow batch,
    and ``error``.  A batch that fails, or gives other than as many vectors of ``dim`` numbers, is
    tried again ``retries`` times, after ``wait(attempt)`` seconds if given; then its rows get the error."""
    import pyarrow as pa

    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])
    names, at = [f.name for f in schema], df.columns.index(text)

    def run(batches):
        import time

        for b in batches:
            texts, error, vectors = b.column(at).to_pylist(), None, None
            for attempt in range(retries + 1):
                try:
                    vectors = [list(map(float, v)) for v in embed(texts)]
                    error = None if len(vectors) == len(texts) and all(len(v) == dim for v in vectors) else "wrong number of vectors or places"
                except Exception as e:  # whatever the function raises is the batch's outcome
                    error = f"{type(e).__name__}: {e}"
                if error is None:
                    break
                if wait is not None and attempt < retries:
                    time.sleep(wait(attempt))
            good = vectors if error is None else [None] * len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(good, pa.list_(pa.float32())), pa.array([error] * len(texts), pa.string())], names=names)

    return df.mapInArrow(run, schema)


def hashed_embedding(text_tokens: Column, dim: int) -> Column:
    """Embedding without a model, for tests: each token adds one to a place by its hash."""
    places = F.transform(text_tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))


def lsh_top_k(df: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", vector: str = "embedding", width: float = 0.5, tables: int = 8, seed: int = 7) -> DataFrame:
    """Approximate top k by random-projection buckets; ``top_k`` is exact and the default."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    data = df.select(key, vector, array_to_vector(l2_normalised(F.col(vector))).alias("features"))
    n = sum(x * x for x in query) ** 0.5 or 1.0
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="_hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(data)
    near = model.approxNearestNeighbors(data, Vectors.dense([x / n for x in query]), k)
    return top_k(near.select(key, vector), query, k, key, vector)
