"""A trie of conversations by their common first turns, built and rolled up level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import by_key, numbered, scratch, small_batches, written

#: Bytes of comma-joined ids that are digested as one row; a node with very many ends is a row for each such part.
PART_BYTES = 8192


def numbered_turns(convs: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written tables of the conversations' turns, without texts: (conv_id, depth, a, b, chars), where a and
    b hash role and text and chars are the text's code points, and (conv_id, size).

    Turns count from 1 in the order of ``turn``, null first; turns that share a number go by their hashes.
    Null role and text become empty; rows without a conversation take no part.  Turns are numbered by
    ranges (``common.numbered``), so that a conversation of any length is no task's alone.
    """
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    rows = convs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"),
        F.col(turn).alias("_turn"),
        F.xxhash64(*said).alias("a"),
        F.xxhash64(F.lit("second"), *said).alias("b"),
        F.char_length(said[1]).alias("chars"),
    )
    with scratch() as keep:
        turns = numbered(rows, ["conv_id"], ["_turn", "a", "b"], "_at0").select("conv_id", (F.col("_at0") + 1).cast("int").alias("depth"), "a", "b", "chars")
        turns = written(turns)
        sizes = written(turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("size")))
        keep += [turns, sizes]
    return turns, sizes


def borrowed(turns: DataFrame, sizes: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The same two tables of conversations that begin as their group's first one does: the first
    crc32(id) % ``most`` turns of conversation id - id % ``group`` (all, if it has fewer; none, if
    there is no such conversation), then their own turns after as many.  At most ``most`` - 1 turns
    of a conversation are gathered."""
    with scratch() as keep:
        heads = turns.where((F.col("conv_id") % group == 0) & (F.col("depth") < most)).groupBy(F.col("conv_id").alias("_lead"))
        heads = heads.agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "chars"))).alias("_head"))
        wanted = sizes.withColumn("_h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")).withColumn("_lead", F.col("conv_id") - F.col("conv_id") % group)
        plan = wanted.join(heads, "_lead", "left").withColumn("_used", F.least("_h", F.coalesce(F.size("_head"), F.lit(0))))
        plan = written(plan.withColumn("_head", F.slice(F.coalesce("_head", F.array().cast("array<struct<depth:int,a:bigint,b:bigint,chars:int>>")), F.lit(1), F.col("_used"))))
        lead = plan.select("conv_id", F.inline("_head"))
        own = by_key(turns, plan.select("conv_id", "_h", "_used", "size"), ["conv_id"], "size").where("depth > _h")
        out = written(lead.unionByName(own.select("conv_id", (F.col("depth") - F.col("_h") + F.col("_used")).alias("depth"), "a", "b", "chars")))
        total = written(plan.select("conv_id", (F.col("_used") + F.greatest(F.col("size") - F.col("_h"), F.lit(0))).alias("size")))
        keep += [out, total]
    return out, total


PART = pa.schema([("depth", pa.int32()), ("node", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
DIGEST = pa.schema([("depth", pa.int32()), ("node", pa.int64()), ("ends", pa.string())])


def _parts_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node, comma-joined in parts of PART_BYTES bytes; rows come sorted by (depth, node, conv_id)."""
    at, first, ids, size, out = None, None, [], 0, []

    def part():
        out.append({"depth": at[0], "node": at[1], "first": first, "ids": ",".join(ids)})

    for batch in batches:
        out = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if row[:2] != at or size > PART_BYTES:
                if ids:
                    part()
                at, first, ids, size = row[:2], row[2], [], 0
            ids.append(str(row[2]))
            size += len(ids[-1]) + 1
        if out:
            yield pa.RecordBatch.from_pylist(out, PART)
    if ids:
        out = []
        part()
        yield pa.RecordBatch.from_pylist(out, PART)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's parts, which come sorted by (depth, node, first id) and are not kept."""
    at, sha, out = None, None, []

    def done():
        out.append({"depth": at[0], "node": at[1], "ends": sha.hexdigest()})

    for batch in batches:
        out = []
        for depth, node, _, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (depth, node) == at:
                sha.update(b",")
            else:
                if at is not None:
                    done()
                at, sha = (depth, node), hashlib.sha256()
            sha.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, DIGEST)
    if at is not None:
        out = []
        done()
        yield pa.RecordBatch.from_pylist(out, DIGEST)


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """(depth, node, ends): SHA-256 of a node's ids, ascending, comma-joined.  Ids are sorted in ranges and
    joined in parts, so that only the parts of a node, not its ids, meet in one task, which streams them."""
    small_batches(ends.sparkSession)
    order = ["depth", "node", "conv_id"]
    parts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_parts_of_ids, "depth int, node long, first long, ids string")
    return parts.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_digests, "depth int, node long, ends string")


COLUMNS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations given as by ``numbered_turns``.

    Top down, a level at a time: the conversations still together with others meet their next turn and
    are grouped by (parent node, turn); the least conv_id names the new node.  A conversation that is
    alone in a node leaves: all below is a chain of its own, whose nodes follow from where it
    starts and how long the conversation is.  So there are as many rounds as the longest beginning
    that two conversations share has turns.  Bottom up, children are added up by parent: leaves, and
    the code points that members but one need not repeat.

    Returns per node conv_id (its least member), depth, parent_conv_id, n_convs (members), n_children,
    n_leaves and saved_tokens of its subtree, and ends_sha256 (of the members that end in it).  Groups
    are counted before they are shuffled, members of frequent nodes stay where they are
    (``common.by_key``), each level is written, and no node's members are gathered.  Equal conversations
    share all their nodes; without conversations there is no node.
    """
    spark = turns.sparkSession
    nothing = F.sha2(F.lit(""), 256)
    with scratch() as keep:
        root, total = sizes.agg(F.min("conv_id"), F.count("*")).first()
        if not total:
            return spark.createDataFrame([], COLUMNS)
        placed = written(turns.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"))  # a level is a few files
        live = [written(sizes.select("conv_id", "size", F.lit(root).cast("long").alias("node")))]
        groups = [written(spark.createDataFrame([(None, root, total, 0, 0)], "parent long, node long, n long, chars int, size int"))]
        while True:
            depth = len(groups)
            going = live[-1].where(F.col("size") >= depth).withColumnRenamed("node", "parent")
            members = written(placed.where(F.col("depth") == depth).drop("depth").join(going, "conv_id"))
            found = written(members.groupBy("parent", "a", "b").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("size").alias("size")))
            groups.append(found)
            shared = written(found.where("n > 1").select("parent", "a", "b", "node", "n"))
            if shared.isEmpty():
                break
            live.append(written(by_key(members, shared, ["parent", "a", "b"], "n").select("conv_id", "size", "node")))

        rolled: list[DataFrame] = []
        below = None
        for depth in reversed(range(len(live))):
            children = groups[depth + 1].select("parent", "node")
            children = children.withColumns({"leaves": F.lit(1).cast("long"), "saved": F.lit(0).cast("long")}) if below is None else children.join(below.select("node", "leaves", "saved"), "node", "left").na.fill({"leaves": 1, "saved": 0})
            sums = children.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            own = (F.col("n") - 1) * F.col("chars")
            below = groups[depth].where("n > 1").join(sums, "node", "left") if depth else groups[0].join(sums, "node", "left")
            below = written(below.select("node", F.lit(depth).alias("depth"), "parent", "n", F.coalesce("children", F.lit(0)).cast("long").alias("children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves"), (own + F.coalesce("saved", F.lit(0))).cast("long").alias("saved")))
            rolled.append(below)

        nodes, ends = rolled[0], None
        for more in rolled[1:]:
            nodes = nodes.unionByName(more)
        for depth, members in enumerate(live):
            here = members.where(F.col("size") == depth).select(F.lit(depth).alias("depth"), "node", "conv_id")
            ends = here if ends is None else ends.unionByName(here)
        nodes = written(nodes.join(digests_of_ends(written(ends)), ["depth", "node"], "left"))

        alone = None
        for depth, found in enumerate(groups[1:], 1):
            here = found.where("n = 1").select("node", "parent", "size", F.lit(depth).alias("start"))
            alone = here if alone is None else alone.unionByName(here)
        alone = written(alone)
        keep += [nodes, alone]

    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    together = nodes.select(
        F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", nothing).alias("ends_sha256"),
    )
    chains = alone.select("node", "parent", "size", "start", F.explode(F.sequence("start", "size")).alias("depth")).select(
        F.col("node").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("node")).alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(F.col("depth") < F.col("size"), one).otherwise(zero).alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(F.col("depth") < F.col("size"), nothing).otherwise(F.sha2(F.col("node").cast("string"), 256)).alias("ends_sha256"),
    )
    return together.unionByName(chains)


def oracle(group: int = 100, most: int = 6) -> str:
    """DuckDB SQL of the trie over borrowed conversations: every prefix written out."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"
    return f"""
    WITH t AS MATERIALIZED (SELECT conv_id, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n FROM conversations),
    l AS MATERIALIZED (SELECT conv_id, list(s ORDER BY n) AS own, {crc} % {most} AS h FROM t GROUP BY conv_id),
    f AS MATERIALIZED (SELECT l.conv_id, list_concat(coalesce(b.own[1:l.h], []), l.own[l.h + 1:]) AS s FROM l LEFT JOIN l b ON b.conv_id = l.conv_id - l.conv_id % {group}),
    p AS MATERIALIZED (SELECT conv_id, d, s[1:d] AS k, len(s) = d AS last FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM f)),
    n AS MATERIALIZED (SELECT d, k, min(conv_id) AS c, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS e FROM p GROUP BY d, k),
    k AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY 1, 2),
    m AS MATERIALIZED (SELECT n.*, coalesce(k.n, 0) AS children FROM n LEFT JOIN k USING (d, k)),
    u AS (SELECT u AS d, k[1:u] AS k, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum(CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(k[d].x) END) AS saved
        FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM m) GROUP BY 1, 2)
    SELECT m.c AS conv_id, CAST(m.d AS BIGINT) AS depth, q.c AS parent_conv_id, CAST(m.n AS BIGINT) AS n_convs, CAST(m.children AS BIGINT) AS n_children,
        CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, m.e AS ends_sha256
    FROM m JOIN u USING (d, k) LEFT JOIN n q ON q.d = m.d - 1 AND q.k = m.k[1:m.d - 1]"""
