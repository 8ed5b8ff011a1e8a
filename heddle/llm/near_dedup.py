"""Near-duplicate documents: SetSketch registers, banded, then judged by likelihood and verified."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import HOT_KEYS, HOT_ROWS, by_key, joinable, scratch, small_batches, written
from heddle.llm.components import components
from heddle.llm.shingles import WordHashes, shingle_set

#: Bytes of texts that one block of a band's members holds at most, on average.
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Sketch:
    """Parameters.  A register is floor(1 - log_base(h)) of the least of exponential variates of
    rate ``rate``, one for each shingle, cut to 0 .. limit: registers of a union are the greater
    of both, and two are equal with a probability near the Jaccard similarity.  With ``rows``
    registers to each of ``bands`` bands, a pair at similarity s shares no band with probability
    (1 - s**rows)**bands: 3e-8 at 0.75."""

    bands: int = 32
    rows: int = 3
    base: float = 1.001
    rate: float = 20.0
    limit: int = 32766
    seed: int = 7

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def registers_of(shingles: np.ndarray, p: Sketch, seeds: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set of hashes.  Each register has a seed of its own, with which
    every hash is mixed anew, so that one register's order of the shingles tells nothing of another's."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(p.registers, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 256):
        h = x[i : i + 256, None] ^ seeds
        h *= np.uint32(0x7FEB352D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x846CA68B)
        np.minimum(least, h.min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**32
    variate = -np.log1p(-uniform) / p.rate
    return np.clip(np.floor(1.0 - np.log(variate) / math.log(p.base)), 0, p.limit).astype(np.int16)


def seeds_of(p: Sketch) -> np.ndarray:
    return np.random.default_rng(p.seed).integers(0, 2**32, p.registers, dtype=np.uint32)


def log_likelihoods(more: np.ndarray, less: np.ndarray, same: np.ndarray, n: np.ndarray, m: np.ndarray, at: np.ndarray, base: float) -> np.ndarray:
    """Log-likelihood of similarity ``at`` (pairs x grid), given how many registers of the first
    set are greater, smaller and equal, and both sets' sizes."""
    u, v = (n / (n + m))[:, None], (m / (n + m))[:, None]
    top = np.minimum(u / v, v / u)
    j = np.minimum(at, top * (1 - 1e-9))
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (base - 1) / base) / math.log(base)
    gt, lt = p(u - v * j), p(v - u * j)
    return more[:, None] * np.log(gt) + less[:, None] * np.log(lt) + same[:, None] * np.log(np.maximum(1 - gt - lt, 1e-12))


GRID = np.linspace(0.0, 1.0, 101)[None, :]


def least_equal(threshold: float, registers):
    """Equal registers below which a pair is dropped without more: 6.5 deviations, fewer than 45 of
    96 at 0.75, which one pair at the threshold in 1e9 has."""
    return threshold * registers - 6.5 * np.sqrt(threshold * (1 - threshold) * registers)


def plausible(more, less, same, n, m, threshold: float, base: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Joint estimate of the similarity, and whether the threshold is still plausible: sizes allow
    it, and it is at most ``slack`` nats less likely than the estimate."""
    # by registers alone first
    total = more + less + same
    open_ = same >= least_equal(threshold, total)
    if not open_.all():
        estimate = same / np.maximum(total, 1)
        good = np.zeros(len(n), dtype=bool)
        if open_.any():
            estimate[open_], good[open_] = plausible(more[open_], less[open_], same[open_], n[open_], m[open_], threshold, base, slack)
        return estimate, good
    n, m = n.astype(np.float64), m.astype(np.float64)
    curve = log_likelihoods(more, less, same, n, m, GRID, base)
    best = curve.argmax(axis=1)
    at = log_likelihoods(more, less, same, n, m, np.full((len(n), 1), threshold), base)[:, 0]
    estimate = GRID[0][best]
    sized = np.minimum(n, m) >= threshold * np.maximum(n, m) * (1 - 1e-12)
    return estimate, sized & ((estimate >= threshold) | (curve.max(axis=1) - at <= slack))


def sketched(docs: DataFrame, key: str, text: str, p: Sketch, k: int) -> DataFrame:
    """key, n_shingles, sid (digest of the set; null if it is empty) and registers."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_shingles bigint, sid binary, registers array<smallint>"

    def run(batches):
        hashes, seeds = WordHashes(), seeds_of(p)
        for batch in batches:
            n, sid, regs = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set((t or "").encode("utf-8", "replace").lower().split(), hashes, k)
                n.append(len(s))
                sid.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(registers_of(s, p, seeds) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(regs, pa.list_(pa.int16()))], names=[key, "n_shingles", "sid", "registers"])

    return docs.select(key, text).mapInArrow(run, schema)


def beside(pairs: DataFrame, at: str, table: DataFrame, columns: dict[str, str], narrow: DataFrame, how: str = "inner") -> DataFrame:
    """``pairs`` (u, v and more) with the ``columns`` (and their new names) of ``table``'s row for the
    key in column ``at``.  Pairs of a key that very many have are dealt over several copies of its
    row; ``narrow`` is the written table of the same pairs, to count them by."""
    total = narrow.count()
    known = table.select(F.col("_key").alias("_to"), *[F.col(c).alias(name) for c, name in columns.items()])
    if total <= 10 * HOT_ROWS:  # no key can have many
        return pairs.join(known, F.col(at) == F.col("_to"), how).drop("_to")
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = written(narrow.groupBy(F.col(at).alias("_hot")).agg(F.count("*").alias("_pairs")).where(F.col("_pairs") > least))  # HOT_KEYS rows at most
    copies = F.coalesce(F.ceil(F.col("_pairs") / F.lit(HOT_ROWS)).cast("int"), F.lit(1))
    salted = pairs.join(F.broadcast(hot), F.col(at) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64("u", "v"), copies).cast("int")).drop("_hot", "_pairs")
    known = known.join(F.broadcast(hot), F.col("_to") == F.col("_hot"), "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_hot", "_pairs")
    return salted.join(known, (F.col(at) == F.col("_to")) & (F.col("_salt") == F.col("_copy")), how).drop("_salt", "_to", "_copy")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """Pairs (u, v), a written table, whose full shingle sets are similar enough: 100 * both >= 100t * either."""

    def run(batches):
        hashes, last, seen = WordHashes(), None, None
        cut = lambda t: shingle_set(t.encode("utf-8", "replace").lower().split(), hashes, k)
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != last:
                    last, seen = b, cut(b)
                keep.append(similar(cut(a), seen, threshold))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"])
            yield out.filter(pa.array(keep, pa.bool_()))

    one = beside(pairs, "u", texts, {"_text": "_a"}, pairs)
    both = beside(one, "v", texts, {"_text": "_b"}, pairs).select("u", "v", "_a", "_b")
    kind = pairs.schema["u"].dataType.simpleString()
    return both.mapInArrow(run, f"u {kind}, v {kind}").distinct()


def judged(pairs: DataFrame, sketches: DataFrame, threshold: float, p: Sketch, slack: float) -> DataFrame:
    """Pairs (u, v), a written table, whose registers allow the threshold, with the joint estimate."""

    def run(batches):
        for batch in batches:
            a, b = (np.asarray(batch.column(i).flatten()).reshape(-1, p.registers) for i in (2, 4))
            n, m = (np.asarray(batch.column(i)) for i in (3, 5))
            estimate, good = plausible((a > b).sum(1), (a < b).sum(1), (a == b).sum(1), n, m, threshold, p.base, slack)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(estimate)], names=["u", "v", "estimate"])
            yield out.filter(pa.array(good))

    one = beside(pairs, "u", sketches, {"registers": "_a", "n_shingles": "_n"}, pairs)
    both = beside(one, "v", sketches, {"registers": "_b", "n_shingles": "_m"}, pairs).select("u", "v", "_a", "_n", "_b", "_m")
    kind = pairs.schema["u"].dataType.simpleString()
    return both.mapInArrow(run, f"u {kind}, v {kind}, estimate double")


def in_blocks(members: DataFrame, schema: str, unit) -> DataFrame:
    """Calls ``unit`` on every pair of blocks of every band, and gathers what it yields.

    ``members``: _band, _blocks and more.  A band is cut into so many blocks; a pair of blocks is a
    unit of work of bounded size.  unit(table, across) gets the members of both, with _own, and
    yields record batches.
    """
    blocks = F.col("_blocks")
    own = F.pmod(F.xxhash64("_key"), blocks).cast("int")
    dealt = members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
    # a band's units go to one partition after another, from one that its hash picks
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unit_no = (F.col("_i").cast("long") * F.col("_blocks") + F.col("_j")) % parts
    place = F.pmod(F.pmod(F.xxhash64("_band"), F.lit(parts)) + unit_no, F.lit(parts)).cast("int")
    dealt = dealt.withColumn("_place", place).drop("_other", "_blocks")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            place = np.stack([table.column(c).to_numpy() for c in ("_band", "_i", "_j")])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield from judged_unit(table.slice(a, b - a))
            held = table.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from judged_unit(held)

    def judged_unit(table):
        yield from unit(table, table.column("_i")[0].as_py() != table.column("_j")[0].as_py())

    dealt = dealt.repartitionById(parts, F.col("_place")).drop("_place")
    return dealt.sortWithinPartitions("_band", "_i", "_j").mapInArrow(run, schema)


def plausible_pairs(table: pa.Table, across: bool, threshold: float, p: Sketch, slack: float):
    """Places of pairs of different components that registers allow, block by block, each pair in
    the first band that it shares and in no other."""
    own, key, comp, n, no = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_own", "_key", "component", "n_shingles", "_no"))
    regs = table.column("registers").combine_chunks().flatten().to_numpy().reshape(-1, p.registers)
    floor = least_equal(threshold, p.registers)
    for x in range(0, len(key), 16):
        cut = slice(x, x + 16)
        other = (comp[cut, None] != comp) & (key[cut, None] > key)
        if across:
            other &= own[cut, None] != own
        a, b = np.nonzero(other)
        same = regs[x + a] == regs[b]
        near = np.flatnonzero(same.sum(axis=1) >= floor)
        first = same[near].reshape(-1, p.bands, p.rows).all(axis=2).argmax(axis=1)
        near = near[first == no[0]]
        if len(near):
            a, b = x + a[near], b[near]
            u, v = regs[a], regs[b]
            _, good = plausible((u > v).sum(1), (u < v).sum(1), (u == v).sum(1), n[a], n[b], threshold, p.base, slack)
            yield a[good], b[good]


def similar(s: np.ndarray, t: np.ndarray, threshold: float) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return both > 0 and 100 * both >= round(100 * threshold) * (len(s) + len(t) - both)


def linked_across(members: DataFrame, texts: DataFrame, threshold: float, k: int, p: Sketch, slack: float, block: int) -> DataFrame:
    """Links (u, v) between different components within each band, as many as join what can be
    joined: in each unit, a pair that earlier links have joined is not looked at.

    ``members``: _band, _no, _n, _key, component, n_shingles, registers.  First, registers alone
    tell which members may be linked at all; only these get their texts, and the pairs between
    them that registers allow are compared on full sets.
    """
    kind = members.schema["_key"].dataType.simpleString()

    def hopeful(table, across):
        pairs = [np.concatenate(x) for x in plausible_pairs(table, across, threshold, p, slack)]
        at = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *pairs]))
        if len(at):
            yield table.select(["_band", "_key"]).take(pa.array(at)).combine_chunks().to_batches()[0]

    def linking(table, across):
        words, sets = WordHashes(), {}
        key, comp = (table.column(c).to_pylist() for c in ("_key", "component"))
        text, top, found = table.column("_text"), {}, []

        def find(c):
            while top.get(c, c) != c:
                top[c] = c = top.get(top[c], top[c])
            return c

        def shingles(i):
            if i not in sets:
                sets[i] = shingle_set(text[i].as_py().encode("utf-8", "replace").lower().split(), words, k)
            return sets[i]

        for xs, ys in plausible_pairs(table, across, threshold, p, slack):
            for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                a, b = find(comp[x]), find(comp[y])
                if a != b and similar(shingles(x), shingles(y), threshold):
                    top[a] = b
                    found.append((key[x], key[y]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found]), pa.array([v for _, v in found])], names=["u", "v"])

    blocks = lambda *sizes: F.greatest(F.lit(1), *[F.ceil(F.col(c) / F.lit(most)) for c, most in sizes]).cast("int")
    some = written(in_blocks(members.withColumn("_blocks", blocks(("_n", block))).drop("_n"), f"_band bigint, _key {kind}", hopeful).distinct())
    t = texts.select(F.col("_key").alias("_k"), "_text")
    sizes = some.join(t.select("_k", F.octet_length("_text").alias("_size")), F.col("_key") == F.col("_k"))
    counts = written(sizes.groupBy("_band").agg(F.count("*").alias("_n"), F.sum("_size").alias("_bytes")))
    left = by_key(members.drop("_n").join(some, ["_band", "_key"]), counts, ["_band"], "_n")
    left = left.withColumn("_blocks", blocks(("_n", 4 * block), ("_bytes", BLOCK_BYTES))).drop("_n", "_bytes")
    left = left.join(t, F.col("_key") == F.col("_k")).drop("_k")
    return in_blocks(left, f"u {kind}, v {kind}", linking)


def near_duplicates(docs: DataFrame, threshold: float = 0.75, k: int = 5, key: str = "doc_id", text: str = "text", sketch: Sketch = Sketch(), slack: float = 14.0, block: int = 128) -> DataFrame:
    """Component of every document under links of similar shingle sets.

    A document's set: its distinct k-word shingles (ASCII letters lowered, words cut at ASCII white
    space), or its whole sequence if it has fewer words.  Two documents are linked if the Jaccard
    similarity of their sets is ``threshold`` or more; a component is all that links reach.

    1. One pass makes each set's digest and registers.  Equal sets are one class, stood for by its
       smallest key; nothing else is done with copies.
    2. Registers are banded.  In each band, every class is paired with a pivot, the member that
       shares most bands with others; registers drop pairs whose joint likelihood estimate rules
       the threshold out by ``slack`` nats.  Each class's likeliest pair is verified on full sets,
       which gives first components.
    3. What is left: the other such pairs between different components, and, in bands that still
       hold several components, all pairs across components, enumerated block by block and judged
       once each; these too are verified and joined in.  No pair within a component is ever made.

    A link is missed only if its classes share no band (2.4e-8 at the threshold) or the estimate is
    off by slack (4e-8, for sets of one size).  The work grows with the square of a band's members
    only where these lie in different components, that is among texts that are alike in part but not
    linked; it is then a comparison of registers, some 100 ns a pair, spread over pairs of blocks of
    ``block`` members, and texts are moved only for members that registers leave open, in blocks of
    BLOCK_BYTES.  Members of large bands, pairs of a pivot that very many have, and copies of one text
    meet what belongs to their key where they are, or over several copies of it (``by_key``, ``beside``).

    Returns key, n_shingles, component_id and kept (the smallest key of its component).  Null and
    empty texts, and texts without words, have an empty set and are linked with nothing; so are
    rows with a null key, whose component is null and which are kept.  Rows that share a key are
    one document, linked by any of its texts.  Extra columns are left out.
    """
    small_batches(docs.sparkSession)
    with scratch() as keep:
        sets = written(sketched(docs, key, text, sketch, k).withColumnRenamed(key, "_key"))
        classes = sets.where("sid IS NOT NULL AND _key IS NOT NULL").groupBy("sid").agg(F.min("_key").alias("rep"), F.count("*").alias("_rows"))
        classes = written(classes)
        chosen = classes.select(F.col("sid").alias("_s"), "rep")
        reps = sets.where("sid IS NOT NULL").join(chosen, (F.col("sid") == F.col("_s")) & (F.col("_key") == F.col("rep")), "left_semi").dropDuplicates(["_key", "sid"])
        reps = written(reps)

        numbers = F.sequence(F.lit(0), F.lit(sketch.bands - 1))
        keys = F.transform(numbers, lambda b: F.struct(b.alias("no"), F.xxhash64(b, F.slice("registers", b * sketch.rows + 1, sketch.rows)).alias("band")))
        bands = reps.select("_key", F.explode(keys).alias("_b")).select("_key", F.col("_b.no").alias("_no"), F.col("_b.band").alias("_band"))
        # bands of the same members, told by their number and two 64-bit digests, are one
        members = [F.bit_xor(F.xxhash64(F.lit(i), "_key")).alias(f"_set{i}") for i in range(2)]
        shared = bands.groupBy("_band").agg(F.min("_no").alias("_no"), F.count("*").alias("_n"), *members).where("_n > 1")
        groups = written(shared.groupBy("_n", "_set0", "_set1").agg(F.min("_no").alias("_no"), F.min_by("_band", "_no").alias("_band")).drop("_set0", "_set1"))
        in_bands = written(by_key(bands.drop("_no"), groups, ["_band"], "_n").select("_band", "_no", "_n", "_key"))

        # the pivot is the member that meets most others in all its bands, most likely a middle one
        weights = in_bands.groupBy("_key").agg(F.sum("_n").alias("_w"))
        pivots = in_bands.join(weights, "_key").groupBy("_band").agg(F.max(F.struct("_w", "_key")).alias("_p"), F.count("*").alias("_n"))
        pivots = written(pivots.select("_band", F.col("_p._key").alias("_pivot"), "_n"))
        star = by_key(in_bands.select("_band", "_key"), pivots, ["_band"], "_n").where("_key <> _pivot")
        star = written(star.select(F.col("_key").alias("u"), F.col("_pivot").alias("v")).distinct())
        star = written(judged(star, reps, threshold, sketch, slack))
        best = written(star.groupBy("u").agg(F.max_by("v", F.struct("estimate", "v")).alias("v")))

        needed = written(in_bands.select(F.col("_key").alias("_k")).distinct())
        texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
        texts = written(texts.join(joinable(needed), F.col("_key") == F.col("_k"), "left_semi"))

        links = written(verified(best, texts, threshold, k))
        first = written(components(links))

        top = first.select(F.col("node").alias("_key"), "component")
        ends = beside(star.select("u", "v"), "u", top, {"component": "_cu"}, star, "left")
        ends = beside(ends, "v", top, {"component": "_cv"}, star, "left").where(F.coalesce("_cu", "u") != F.coalesce("_cv", "v"))
        ordered = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        tried = ordered(best).select(F.col("u").alias("_u"), F.col("v").alias("_v"))
        rest = written(ordered(ends).distinct().join(tried, (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v")), "left_anti"))

        member = in_bands.join(top.withColumnRenamed("_key", "_k"), F.col("_key") == F.col("_k"), "left").drop("_k")
        member = written(member.withColumn("component", F.coalesce("component", "_key")))
        spread = member.groupBy("_band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count("*").alias("_m")).where("_lo <> _hi")
        member = by_key(member, written(spread.select("_band", "_m")), ["_band"], "_m", "left_semi")
        regs = reps.select(F.col("_key").alias("_k"), "n_shingles", "registers")
        member = member.join(regs, F.col("_key") == F.col("_k")).drop("_k")
        late = written(verified(rest, texts, threshold, k).unionByName(linked_across(member, texts, threshold, k, sketch, slack, block)))

        final = components(links.unionByName(late).unionByName(_shared_keys(sets)))
        final = final.select(F.col("node").alias("_node"), "component")
        by_set = classes.join(final, F.col("rep") == F.col("_node"), "left").select("sid", F.coalesce("component", "rep").alias("component_id"), "_rows")
        by_set = written(by_set)
        keep += [sets, by_set]

    rows = sets.select("_key", "n_shingles", "sid")
    alone = F.col("sid").isNull() | F.col("_key").isNull()
    out = by_key(rows.where(~alone), by_set, ["sid"], "_rows").select("_key", "n_shingles", "component_id")
    out = out.unionByName(rows.where(alone).select("_key", "n_shingles", F.col("_key").alias("component_id")))
    return out.select(F.col("_key").alias(key), "n_shingles", "component_id", F.coalesce(F.col("_key") == F.col("component_id"), F.lit(True)).alias("kept"))


def _shared_keys(sets: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a key."""
    rows = sets.where("sid IS NOT NULL AND _key IS NOT NULL").select("_key", "sid")
    several = written(rows.groupBy("_key").agg(F.count("*").alias("_rows")).where("_rows > 1"))
    rows = written(by_key(rows, several, ["_key"], "_rows", "left_semi"))
    least = written(rows.groupBy("sid").agg(F.min("_key").alias("v"), F.count("*").alias("_rows")))
    return by_key(rows, least, ["sid"], "_rows").select(F.col("_key").alias("u"), "v")


def oracle() -> str:
    """DuckDB SQL of ``near_duplicates`` over the documents: all pairs that share a shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    e AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
    f AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
    r(doc_id, reach) AS (SELECT u, v FROM f UNION SELECT r.doc_id, f.v FROM r JOIN f ON r.reach = f.u),
    c AS (SELECT doc_id, min(reach) AS m FROM r GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
        d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""
