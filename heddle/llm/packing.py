"""Packing of tokenised documents into sequences of fixed length, by bin completion."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import numbered, small_batches, written

#: Words of which a worker keeps the ids, in each of two generations.
CACHED_WORDS = 400_000
#: Choices of the packing search that are kept open; those above are enumerated anew when it comes back
#: to them, so that its memory doesn't grow with its depth.
LIVE = 32


class Words:
    """Ids of words that follow ``lead``, kept in two generations: when the young one is full it
    becomes the old one, and what is met again moves back."""

    def __init__(self, lead: str):
        self.lead, self.young, self.old = lead, {}, {}

    def learn(self, words: set[str], encode) -> dict[str, bytes | None]:
        """Ids of all of ``words``; None for those that can't be encoded alone."""
        if len(self.young) + len(words) > CACHED_WORDS:
            self.old, self.young = self.young, {}
        for w in words - self.young.keys():
            if w in self.old:
                self.young[w] = self.old[w]
        fresh = [w for w in words if w not in self.young]
        self.young.update(dict.fromkeys(fresh))
        good = [w for w in fresh if w and not w[0].isspace()]
        self.young.update(zip(good, encode(good, self.lead), strict=True))
        return self.young


def added_tokens(path: str | None) -> dict[str, int]:
    """Added tokens, such as ends of texts, of the tokenizer file that lies beside the rank file,
    and their ids; none if there is no such file."""
    import public_tokenizers

    path = os.path.splitext(path)[0] + ".json" if path else public_tokenizers.path("byte_bpe_50k.json")
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("an added token takes its neighbours into account")
    return {t["content"]: t["id"] for t in tokens}


class Encoder:
    """Ids of texts by a byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes.

    The vocabulary is a file of ranks; its ids are those of the same vocabulary's tokenizer file.
    The pattern cuts a text before every single space that a non-space follows, so words with the
    space before them are encoded apart and kept.  New words are encoded together as one text and
    cut by the bytes of its tokens.  Texts with other runs of white space next to a space are
    encoded whole.  Marks of the tokenizer file's added tokens in a text are their ids, and what
    stands between them is encoded apart, as by the tokenizer file.
    """

    def __init__(self, path: str | None, added: dict[str, int] | None = None):
        added = added_tokens(path) if added is None else added
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.first, self.later = Words(""), Words(" ")
        self.added = {mark: np.array([i], dtype="<u4").tobytes() for mark, i in added.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def apart(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of each word after ``lead``."""
        if not words:
            return []
        if not lead:
            return [self.whole(w) for w in words]
        ids = np.array(self.bpe.encode_ordinary(lead + lead.join(words)), dtype="<u4")
        ends = np.cumsum([len(w.encode("utf-8", "replace")) + 1 for w in words])
        at = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
        data, cuts = ids.tobytes(), [0, *(4 * at).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def batch(self, texts: list[str]) -> list[bytes]:
        marked = {i: self.marks.split(t) for i, t in enumerate(texts) if any(mark in t for mark in self.added)}
        if not marked:
            return self.unmarked(texts)
        ids = iter(self.unmarked([x for i, t in enumerate(texts) for x in (marked[i][::2] if i in marked else [t])]))
        return [b"".join(self.added[x] if j % 2 else next(ids) for j, x in enumerate(marked.get(i, [t]))) for i, t in enumerate(texts)]

    def unmarked(self, texts: list[str]) -> list[bytes]:
        parts = [t.split(" ") for t in texts]
        rest: set[str] = set()
        for p in parts:
            rest.update(p[1:])
        first = self.first.learn({p[0] for p in parts if p[0]}, self.apart)
        first[""] = b""
        later = self.later.learn(rest, self.apart)
        out = []
        for t, p in zip(texts, parts, strict=True):
            try:
                out.append(b"".join([first[p[0]], *map(later.__getitem__, p[1:])]))
            except TypeError:  # a word that can't be encoded alone
                out.append(self.whole(t))
        return out


def tokenized_pieces(docs: DataFrame, size: int = 2048, path: str | None = None, end: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids: key, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids, then id ``end``.  Only longer ones are cut; all pieces but the first are
    full, so that what is left over is one piece.  Null text counts as empty: one piece, of the end.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    last = np.array([end], dtype="<u4").tobytes()
    added = added_tokens(path)

    def run(batches):
        encoder = Encoder(path, added)
        for batch in batches:
            take, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, x in enumerate(encoder.batch([t or "" for t in batch.column(1).to_pylist()])):
                x += last
                n = len(x) // 4
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    take.append(i)
                    piece.append(j)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(x[4 * a : 4 * b]))
                    if with_ids:
                        ids.append(np.frombuffer(x[4 * a : 4 * b], dtype="<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


Plan = list[tuple[tuple[int, ...], int]]


def best_fit(counts: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing over lengths and how many there are of each: fillings and how often each
    is used.  Bins that hold the same are one group, so the work follows the lengths, not the rows."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room: list[int] = []  # sorted rooms that have bins

    def put(left: int, filling: tuple[int, ...], times: int) -> None:
        if left not in groups:
            groups[left] = []
            room.insert(bisect_right(room, left), left)
        groups[left].append((filling, times))

    for s in sorted((s for s, c in counts.items() if c), reverse=True):
        todo = counts[s]
        while todo:
            at = bisect_right(room, s - 1)
            if at < len(room):
                left = room[at]
                filling, times = groups[left].pop()
                if not groups[left]:
                    del groups[left], room[at]
            else:
                left, filling, times = size, (), todo
            each = min(left // s, todo)
            used = min(times, todo // each)
            put(left - each * s, filling + (s,) * each, used)
            if filling and used < times:
                put(left, filling, times - used)
            todo -= each * used
    return [(f, t) for g in groups.values() for f, t in g]


def completions(sizes: list[int], counts: dict[int, int], room: int, waste: int, even: bool) -> Iterator[tuple[int, ...]]:
    """Fillings of ``room`` that leave at most ``waste`` of it, of any number of pieces: fullest
    first, and of equally full ones those of the largest pieces first, or, if ``even``, those whose
    largest piece is the smallest.

    One bit set for each length says which sums it and the shorter ones reach, so every step of
    the enumeration ends in a filling.
    """
    fit = [s for s in sizes[: bisect_right(sizes, room)] if counts[s]]
    every = (1 << room + 1) - 1
    sums = [1]
    for s in fit:
        reached, most, k = sums[-1], min(counts[s], room // s), 1
        while most and reached != every:
            k = min(k, most)
            reached |= reached << k * s & every
            most, k = most - k, 2 * k
        sums.append(reached)

    def fill(total: int, n: int) -> Iterator[tuple[int, ...]]:
        """Fillings of exactly ``total`` by the ``n`` shortest lengths."""
        if not total:
            yield ()
            return
        ways = range(min(n, bisect_right(fit, total)))
        for i in ways if even else reversed(ways):
            if not sums[i + 1] >> total & 1:
                if even:
                    continue
                return
            s = fit[i]
            for m in range(min(counts[s], total // s), 0, -1):
                if sums[i] >> total - m * s & 1:
                    for rest in fill(total - m * s, i):
                        yield (s,) * m + rest

    for total in range(room, max(room - waste, 0) - 1, -1):
        if sums[-1] >> total & 1:
            yield from fill(total, len(fit))


def dominated(filling: tuple[int, ...], sizes: list[int], counts: dict[int, int], waste: int) -> bool:
    """Whether the filling can be left out, since another around the same longest piece is as good
    (Martello and Toth): a piece left over fits into the ``waste``, or one can stand in for some of
    the filling's pieces, whose places among the others these can then take.  For long fillings,
    only one and two pieces are tried."""
    used = Counter(filling)
    spare = [s for s in sizes if counts[s] > used[s]]
    if not spare:
        return False
    if spare[0] <= waste:
        return True
    parts = sorted(filling)
    for n in range(1, (len(parts) if len(parts) <= 8 else 2) + 1):
        for some in set(combinations(parts, n)):
            total = sum(some)
            i = bisect_right(spare, total + waste) - 1
            if i >= 0 and spare[i] >= total + (n == 1):
                return True
    return False


def searched(counts: dict[int, int], size: int, best: Plan, bound: int, nodes: int, even: bool) -> Plan:
    """The best plan found from the incumbent ``best`` on; the search of ``pack_lengths``."""
    total, bins = sum(s * c for s, c in counts.items()), sum(t for _, t in best)
    left, trail = dict(counts), []
    steps, waste, used = 0, 0, 0

    def options(done: list[int]) -> Iterator[tuple[tuple[int, ...], int]]:
        """Undominated fillings around the longest piece left, and how often to take each: first as often
        as can be, then once; without those that are ``done`` of either kind, and counting them there."""
        nonlocal steps
        own = {s: c for s, c in left.items() if c}
        s = max(own)
        there, sizes, spare = dict(own), sorted(own), (bins - 1) * size - total - waste
        own[s] -= 1
        for once in (False, True):
            before, at = done[once], 0
            for f in completions(sizes, own, size - s, spare, even):
                if dominated(f, sizes, own, size - s - sum(f)):
                    steps += 1
                    if steps >= nodes:
                        return
                    continue
                times = min(there[x] // n for x, n in Counter((s, *f)).items())
                if not once or times > 1:
                    at += 1
                    if at > before:
                        done[once] = at
                        yield (s, *f), 1 if once else times

    def undo() -> None:
        nonlocal waste, used
        filling, times = trail.pop()
        for s in filling:
            left[s] += times
        waste -= times * (size - sum(filling))
        used -= times

    done = [[0, 0]]
    live: list[Iterator[tuple[tuple[int, ...], int]] | None] = [options(done[0])]
    while live and steps < nodes and bins > bound:
        if live[-1] is None:
            live[-1] = options(done[-1])
        if (choice := next(live[-1], None)) is None:
            live.pop()
            done.pop()
            if trail:
                undo()
            continue
        steps += 1
        filling, times = choice
        for s in filling:
            left[s] -= times
        waste += times * (size - sum(filling))
        used += times
        trail.append((filling, times))
        rest = total - (used * size - waste)
        if not rest:
            if used < bins:
                best, bins = list(trail), used
        elif used + -(-rest // size) < bins:
            done.append([0, 0])
            live.append(options(done[-1]))
            if len(live) > LIVE:
                live[-LIVE - 1] = None
            continue
        undo()
    return best


def pack_lengths(counts: dict[int, int], size: int, nodes: int = 20_000) -> Plan:
    """As few bins as found for ``counts`` (how many pieces of each length).

    Bin completion: the longest piece left must be in some bin, so the undominated fillings around
    it that waste no more than a better result may are tried, fullest first, each as often in a row as the
    counts allow and, after all of these, once; a branch is left when its waste makes a better
    result than the incumbent impossible.  The first incumbent is best-fit decreasing.  Equally full
    fillings are tried in two orders, in a search of half the ``nodes`` steps each; both end at the
    lower bound or when all is tried.  When the steps run out, the incumbent may not be the least.
    Full pieces take a bin each.
    """
    counts = {s: c for s, c in counts.items() if c > 0}
    if any(not 0 < s <= size for s in counts):
        raise ValueError("a length is not in 1 .. size")
    full: Plan = [((size,), counts.pop(size))] if size in counts else []
    if not counts:
        return full
    best = best_fit(counts, size)
    total = sum(s * c for s, c in counts.items())
    bins = sum(t for _, t in best)
    over = sum(c for s, c in counts.items() if 2 * s > size)
    bound = max(-(-total // size), over)
    for even in (False, True):
        if bins > bound:
            best = searched(counts, size, best, bound, nodes // 2, even)
            bins = sum(t for _, t in best)
    return full + best


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, end: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack documents into as few sequences of at most ``size`` tokens as can be found.

    1. Documents are tokenised and cut (``tokenized_pieces``); the pieces are written.
    2. Only how many pieces have each length, at most ``size`` numbers, goes to the driver, which
       plans the fillings (``pack_lengths``); the plan's size follows the lengths, not the rows.
    3. Equally long pieces are numbered, in as many ranges as they fill (``common.numbered``), so that
       neither a length that a third of all pieces share nor a row repeated very often is one task's.
       A piece's number picks its sequence and offset from the plan.

    Returns key, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.
    Offsets are gapless from 0 in each sequence.  Null and empty texts have one piece, the end id;
    repeated rows are packed each for itself; an empty table gives an empty one; extra columns are
    left out.
    """
    out = [key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    pieces = written(tokenized_pieces(docs, size, path, end, key, text, with_ids).select(*out))  # ranges are sampled: texts aren't tokenised for that
    pieces = numbered(pieces, ["length"], [key, "piece", "ids_crc32"], "_rank")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places: dict[int, list[tuple[int, int, int]]] = {}  # length: first number, sequence of it, offset
    taken: dict[int, int] = {}
    base = 0
    for filling, times in pack_lengths(counts, size):
        offset = 0
        for s in filling:
            places.setdefault(s, []).append((taken.get(s, 0), base, offset))
            taken[s] = taken.get(s, 0) + times
            offset += s
        base += times
    plan = {s: np.array(rows, dtype=np.int64).T for s, rows in places.items()}

    ranked = pieces.select(*out, "_rank")
    at = out.index("length")

    def place(batches):
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(len(out)).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for s in np.unique(length):
                own = length == s
                first, seq, off = plan[int(s)]
                i = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own] = seq[i] + rank[own] - first[i]
                offset[own] = off[i]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(out))], pa.array(sequence), pa.array(offset)], names=[*out, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[: len(out)])
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")
