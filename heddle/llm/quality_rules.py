"""Quality rules: text statistics, and robust multivariate outliers among them."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heddle.llm.common import KEY_ROWS, by_key, joinable, scratch, small_batches, written

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
#: Transformed statistics, rounded to 1/4096: sums of up to some 1e8 vectors and of their products are
#: then exact, so estimates don't depend on how rows are dealt.
VECTOR = ("x_length", "x_symbols", "x_lines", "x_repeats")
ROUNDED = 4096.0
#: Levels of groups, from the finest: of a language and source, of a language, of all.
LEVELS = 3
PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]


@dataclass(frozen=True)
class Robust:
    """Parameters of the estimates.

    share: part of a group's vectors that an estimate rests on.
    floors: spreads below which differences don't matter; their squares are added to the variances
        (at sf0.1 the median deviation of x_length is 0.05 to 0.1, that of the others mostly 0), so
        vectors that nearly all agree don't make every other one an outlier.
    weight: vectors that the language's estimate counts for beside a group's own, and the estimate
        over all beside a language's: small groups lean on it, large ones hardly, without a step.
    quantile: of the chi-square distribution, beyond which a vector is an outlier.
    sample, trials, tried, carried: starts come, beside two of the whole group, from the ``sample`` vectors with
        the least hash: ``trials`` subsets of as few vectors as fix an ellipsoid, ``tried`` steps each, and the
        two best go on with all vectors.  After as many steps on these, the best ``carried`` starts go on.
    settle, steps: concentration goes on while a logarithm of a determinant falls by more than
        ``settle``; determinants never rise, so this ends; after ``steps`` steps it is an error.
    """

    share: float = 0.75
    floors: tuple[float, ...] = (0.05, 0.10, 0.15, 0.15)
    weight: float = 30.0
    quantile: float = 0.9999
    sample: int = 256
    trials: int = 24
    tried: int = 2
    carried: int = 2
    settle: float = 1e-6
    steps: int = 200


def statistics_of(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        counts = Counter(grams)
        hit = np.zeros(len(words), dtype=bool)
        at = np.flatnonzero(np.fromiter((counts[g] > 1 for g in grams), dtype=bool, count=len(grams)))
        for o in range(3):
            hit[at + o] = True
        repeated = int(hit.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text."""
    small_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            rows = np.array([statistics_of(t) for t in batch.column(3).to_pylist()], dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], *[pa.array(rows[:, i]) for i in range(5)]], names=[key, "lang", "source", *names])

    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text))
    return picked.mapInArrow(run, f"{key} {kind}, lang string, source string, " + ", ".join(f"{n} bigint" for n in names))


def transformed() -> list[Column]:
    """The statistics' vector: logarithm of the mean word's length; square roots of symbols,
    repeated lines and repeated words to a word."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    exact = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), *[F.sqrt(F.col(c) / n) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")]]
    return [(F.rint(x * F.lit(ROUNDED)) / F.lit(ROUNDED)).alias(v) for x, v in zip(exact, VECTOR, strict=True)]


def chi2_4(p: float) -> float:
    """Quantile of chi-square with 4 degrees of freedom."""
    lo, hi = 0.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - math.exp(-mid / 2) * (1 + mid / 2) < p else (lo, mid)
    return lo


def consistency(share: float) -> float:
    """Factor that makes the covariance of the inner ``share`` of normal vectors that of all."""
    x = chi2_4(share) / 2
    return share / (1 - math.exp(-x) * (1 + x + x * x / 2))


def distance(center: Column, precision: Column) -> Column:
    """Squared Mahalanobis distance of the vector."""
    d = [F.col(v) - F.get(center, F.lit(i)) for i, v in enumerate(VECTOR)]
    k = len(VECTOR)
    return sum((d[i] * d[j] * F.get(precision, F.lit(i * k + j)) for i in range(k) for j in range(k)), F.lit(0.0))


def estimated(moments: DataFrame, factor: float, p: Robust) -> DataFrame:
    """From each group's count ``inner``, sums and sums of products: center, covariance times
    ``factor`` plus the floors' squares, its inverse and its determinant's logarithm; ``fall`` is how
    far that lies below the one before, ``was``."""
    k, floors = len(VECTOR), np.diag(np.array(p.floors) ** 2)

    def run(batches):
        for b in batches:
            n = b.column("inner").to_numpy().astype(float)
            center = np.array(b.column("sums").to_pylist(), dtype=float).reshape(-1, k) / n[:, None]
            products = np.array(b.column("products").to_pylist(), dtype=float).reshape(-1, len(PAIRS)) / n[:, None]
            cov = np.empty((len(n), k, k))
            for (i, j), x in zip(PAIRS, products.T, strict=True):
                cov[:, i, j] = cov[:, j, i] = (x - center[:, i] * center[:, j]) * factor
            cov += floors
            flat = lambda x: pa.array(list(x.reshape(len(n), -1)), pa.list_(pa.float64()))
            logdet = np.linalg.slogdet(cov)[1]
            fall = b.column("was").to_numpy(zero_copy_only=False).astype(float) - logdet
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("level", "group", "start", "size")], flat(center), flat(cov), flat(np.linalg.inv(cov)), pa.array(logdet), pa.array(fall)], names=["level", "group", "start", "size", "center", "cov", "precision", "logdet", "fall"])

    return moments.mapInArrow(run, "level int, group string, start int, size bigint, center array<double>, cov array<double>, precision array<double>, logdet double, fall double")


def moments(rows: DataFrame, *by: str) -> DataFrame:
    sums = F.array(*[F.sum(v) for v in VECTOR])
    products = F.array(*[F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])) for i, j in PAIRS])
    return rows.groupBy("level", "group", "start", *by).agg(F.count("*").alias("inner"), sums.alias("sums"), products.alias("products"))


def group_of(level: int) -> Column:
    """Name of a row's group at a level; null languages and sources are groups of their own."""
    said = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    both = F.concat_ws("\x1f", said("lang"), said("source"))
    return [both, F.substring_index(both, "\x1f", 1), F.lit("")][level]


def order_statistic(counts: DataFrame, by: list[str], value: str, rank: Column) -> DataFrame:
    """The least ``value`` of each group up to which ``rank`` rows or more are counted (column n): one
    row for each group, with the rows ``_below`` it, and the group's ``size``.  Groups are as large as
    the different values are many, which callers bound."""
    w = W.partitionBy(*by)
    told = counts.withColumn("size", F.sum("n").over(w)).withColumn("_upto", F.sum("n").over(w.orderBy(value)))
    told = told.withColumn("_below", F.col("_upto") - F.col("n"))
    return told.where((F.col("_below") < rank) & (F.col("_upto") >= rank)).select(*by, value, "_below", "size")


def median(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """The middle ``value`` of each group, counted first in steps of 1/64, then within the step that
    holds it: by, value, size."""
    half = F.ceil(F.col("size") / 2)
    stepped = counts.withColumn("_step", F.floor(F.col(value) * 64))
    edge = order_statistic(stepped.groupBy(*by, "_step").agg(F.sum("n").alias("n")), by, "_step", half)
    inside = stepped.join(edge, [*by, "_step"])
    upto = F.col("_below") + F.sum("n").over(W.partitionBy(*by).orderBy(value))
    return inside.withColumn("_upto", upto).where((F.col("_upto") - F.col("n") < half) & (F.col("_upto") >= half)).select(*by, value, "size")


def nearness(center: Column, precision: Column) -> Column:
    """Squared distances in steps of 2**-20, those of 1024 or more as one: what concentration compares."""
    return F.least(F.floor(distance(center, precision) * F.lit(float(1 << 20))), F.lit(1 << 30)).cast("long")


def trial_starts(x: np.ndarray, p: Robust) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two best centers and covariances after some steps on a sample, from subsets of one vector more than there
    are dimensions; the same for the same vectors in any order."""
    k, floors, factor = x.shape[1], np.diag(np.array(p.floors) ** 2), consistency(p.share)
    x = x[np.lexsort(x.T)]
    h, draw = math.ceil(len(x) * p.share), np.random.default_rng(len(x))

    def of(own: np.ndarray, times: float) -> tuple[np.ndarray, np.ndarray]:
        return own.mean(axis=0), np.cov(own.T, bias=True).reshape(k, k) * times + floors

    found = []
    for _ in range(p.trials):
        center, cov = of(x[draw.choice(len(x), min(len(x), k + 1), replace=False)], 1.0)
        for _ in range(p.tried):
            d = x - center
            q = np.minimum(np.floor(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) * (1 << 20)), 1 << 30)
            center, cov = of(x[q <= np.sort(q)[h - 1]], factor)
        found.append((np.linalg.slogdet(cov)[1], len(found), center, cov))
    return [(center, cov) for *_, center, cov in sorted(found, key=lambda f: f[:2])[:2]]


def sampled_starts(rows: DataFrame, p: Robust) -> DataFrame:
    """Starts 2 and 3 of every group: level, group, start, center, cov, precision.  Each task sends ``sample`` rows of a
    group at most, and so many meet in one task."""
    of = ["level", "group"]
    place = F.row_number().over(W.partitionBy(*of).orderBy(F.xxhash64(*VECTOR), *VECTOR))
    some = rows.withColumn("_at", place).where(F.col("_at") <= p.sample).drop("_at")

    def run(table: pa.Table) -> pa.Table:
        found = trial_starts(np.stack([table.column(v).to_numpy() for v in VECTOR], axis=1), p)
        flat = lambda m: m.reshape(-1).tolist()
        names = {c: table.column(c)[0].as_py() for c in of}
        out = [names | {"start": 2 + i, "center": flat(c), "cov": flat(s), "precision": flat(np.linalg.inv(s))} for i, (c, s) in enumerate(found)]
        many = pa.list_(pa.float64())
        return pa.Table.from_pylist(out, pa.schema([("level", pa.int32()), ("group", pa.string()), ("start", pa.int32()), ("center", many), ("cov", many), ("precision", many)]))

    return some.groupBy(*of).applyInArrow(run, "level int, group string, start int, center array<double>, cov array<double>, precision array<double>")


def minimum_covariance(vectors: DataFrame, p: Robust = Robust()) -> DataFrame:
    """Minimum-covariance-determinant estimates for every group at every level: level, group, size,
    center and cov.

    Four starts, the medians with median deviations, the means with the plain covariance and the two best of many
    trials on a sample (``sampled_starts``), are improved by concentration steps over all vectors, to the covariance of the
    ``share`` of them that are nearest under the last one; after two steps the best two go on until the
    determinant stops falling.  The smaller determinant wins.  It is a minimum of such steps: tests against all subsets of small
    groups find the least determinant of all in 99 of 100.

    Medians and bounds are exact order statistics of all vectors, found by counting: values, which are
    multiples of 1/4096, in steps of 1/64, distances in steps of 1/16, then, within the step that
    holds the one sought, by themselves and in steps of 2**-20.  Counts and sums are combined before they are shuffled, and models
    are broadcast or, if many, joined so that vectors of hot groups stay where they are.
    """
    k = len(VECTOR)
    names = F.array(*[F.struct(F.lit(i).alias("level"), group_of(i).alias("group")) for i in range(LEVELS)])
    rows = vectors.select(F.explode(names).alias("_at"), *VECTOR).select("_at.level", "_at.group", *VECTOR)
    of = ["level", "group"]

    values = rows.select(*of, F.posexplode(F.array(*VECTOR)).alias("place", "v")).groupBy(*of, "place", "v").agg(F.count("*").alias("n"))
    values = written(values)
    middle = written(median(values, [*of, "place"], "v").select(*of, "place", F.col("v").alias("middle")))
    away = values.join(joinable(middle, KEY_ROWS), [*of, "place"]).groupBy(*of, "place", F.abs(F.col("v") - F.col("middle")).alias("away"), "middle").agg(F.sum("n").alias("n"))
    spread = median(away, [*of, "place", "middle"], "away")
    placed = F.array_sort(F.collect_list(F.struct("place", "middle", "away")))  # one for each place
    first = spread.groupBy(*of, "size").agg(placed.alias("_m"))
    scale = [1 / (F.pow(F.col("_m")[i]["away"] * 1.4826, 2) + F.lit(p.floors[i] ** 2)) for i in range(k)]
    diagonal = F.array(*[scale[i] if i == j else F.lit(0.0) for i in range(k) for j in range(k)])
    none = F.lit(None).cast("double")
    first = first.select(*of, F.lit(0).alias("start"), "size", F.col("_m.middle").alias("center"), F.array().cast("array<double>").alias("cov"), diagonal.alias("precision"), none.alias("logdet"), none.alias("fall"))
    plain = estimated(moments(rows.withColumn("start", F.lit(1))).withColumn("size", F.col("inner")).withColumn("was", none), 1.0, p)
    drawn = sampled_starts(rows, p).join(joinable(written(first.select(*of, "size")), KEY_ROWS), of).withColumns({"logdet": none, "fall": none})
    now = written(first.unionByName(plain.withColumn("logdet", none)).unionByName(drawn))

    few = now.count() <= KEY_ROWS
    beside = lambda model: rows.join(F.broadcast(model), of) if few else by_key(rows, model, of, "size")
    at = [*of, "start"]
    share, settled = F.ceil(F.col("size") * F.lit(p.share)), []
    for done in range(1, p.steps + 1):
        near = beside(now).withColumn("_q", nearness(F.col("center"), F.col("precision")))
        coarse = near.groupBy(*at, F.shiftright("_q", 16).alias("_high")).agg(F.count("*").alias("n"))
        bound = order_statistic(coarse, at, "_high", share).select(*at, F.col("_high").alias("_edge"))
        edged = written(now.select(*at, "size", "center", "precision", F.col("logdet").alias("was")).join(bound, at))
        near = beside(edged).withColumn("_q", nearness(F.col("center"), F.col("precision"))).where(F.shiftright("_q", 16) <= F.col("_edge"))
        low = F.when(F.shiftright("_q", 16) == F.col("_edge"), F.col("_q").bitwiseAND(65535)).otherwise(F.lit(-1))
        fine = moments(near.withColumn("_low", low), "_low").join(edged.select(*at, "size", "was"), at)
        upto = F.sum("inner").over(W.partitionBy(*at).orderBy("_low"))
        inner = fine.withColumn("_below", upto - F.col("inner")).where(F.col("_below") < share)
        total = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c)
        inner = inner.groupBy(*at, "size", "was").agg(F.sum("inner").alias("inner"), total("sums", k), total("products", len(PAIRS)))
        after = written(estimated(inner, consistency(p.share), p))
        falls = F.coalesce("fall", F.lit(math.inf)) > p.settle
        settled.append(after.where(~falls))
        now = after.where(falls)
        if done == p.tried:  # a start behind as many others, all of which only fall further, is left
            place = F.row_number().over(W.partitionBy(*of).orderBy("logdet", "start"))
            now = after.withColumn("_place", place).where((F.col("_place") <= p.carried) & falls).drop("_place")
        if now.isEmpty():
            break
    else:
        raise RuntimeError("the determinants did not settle")
    model = settled[0]
    for x in settled[1:]:
        model = model.unionByName(x)
    best = model.groupBy(*of, "size").agg(F.min_by(F.struct("center", "cov"), F.struct("logdet", "start")).alias("m"))
    return best.select(*of, "size", "m.center", "m.cov")


def leaning(n: float, own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Center and covariance of ``n`` vectors, with the other estimate as that of ``weight`` more."""
    (c, s), (d, t) = own, other
    apart = np.outer(c - d, c - d) * (n * weight / (n + weight))
    return (n * c + weight * d) / (n + weight), (n * s + weight * t + apart) / (n + weight)


def models(estimates: DataFrame, p: Robust) -> DataFrame:
    """group, size, center and precision of every language and source, leaning on their language's
    estimate, and that on the one over all."""
    k = len(VECTOR)
    level = lambda i: estimates.where(F.col("level") == i).drop("level")
    called = lambda df, x: df.select(*[F.col(c).alias(f"{c}{x}") for c in df.columns])
    of_language = level(0).withColumn("group1", F.substring_index("group", "\x1f", 1)).join(called(level(1), 1), "group1")
    every = of_language.join(F.broadcast(called(level(2), 2)))  # one row

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                of = lambda x: (np.array(r[f"center{x}"]), np.array(r[f"cov{x}"]).reshape(k, k))  # noqa: B023, E731
                center, cov = leaning(r["size"], of(""), leaning(r["size1"], of(1), of(2), p.weight), p.weight)
                out.append({"group": r["group"], "size": r["size"], "center": center.tolist(), "precision": np.linalg.inv(cov).reshape(-1).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("group", pa.string()), ("size", pa.int64()), ("center", pa.list_(pa.float64())), ("precision", pa.list_(pa.float64()))]))

    return every.mapInArrow(run, "group string, size bigint, center array<double>, precision array<double>")


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", robust: Robust = Robust()) -> DataFrame:
    """Statistics of every whole text, and which documents are kept.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows.  Of the
    others, the transformed statistics' vectors get minimum-covariance-determinant estimates per
    language and source, at every size of a group; small groups lean on their language's (``Robust``).
    A document is kept unless its squared Mahalanobis distance exceeds the chi-square ``quantile``.

    Returns key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    distance (null where base_failed).  Null and empty texts have no words and fail.  Null languages
    and sources are groups of their own.  Repeated rows and ties count each; an empty table gives an
    empty one; extra columns are left out.  The result does not depend on how rows are dealt.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    with scratch() as keep:
        stats = written(statistics(docs, key, text, lang, source).select("*", failed.alias("base_failed"), group_of(0).alias("group"), *transformed()))
        clean = stats.where(~F.col("base_failed"))
        model = written(models(minimum_covariance(clean, robust), robust))
        keep += [stats, model]
    near = by_key(clean, model, ["group"], "size").withColumn("distance", distance(F.col("center"), F.col("precision")))
    rows = near.unionByName(stats.where("base_failed").withColumn("distance", F.lit(None).cast("double")), allowMissingColumns=True)
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_4(robust.quantile))
    return rows.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
