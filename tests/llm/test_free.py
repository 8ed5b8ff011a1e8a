"""Operators with Python in them, against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import near_dedup, packing, pii, quality_classifier, quality_rules, substring_dedup
from heddle.llm.components import components
from heddle.llm.shingles import Rolling, WordHashes, runs, sliding_min

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def plain_statistics(t):
    w = SPLIT.findall(t or "")
    lines = [x for x in (t or "").split("\n") if SPLIT.search(x)]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    hit = {i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)} if len(grams) < 2000 else set()
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_statistics(texts):
    for t in [*texts, "a*b # $% & | < >", "x y z x y z", "a\n\na\n \n"]:
        if len(t or "") < 20_000:
            assert quality_rules.statistics_of(t) == plain_statistics(t)


def test_quality_rules(spark, docs, empty):
    rng = random.Random(1)
    clean = [(i, " ".join("".join(rng.choice("etaoin") for _ in range(rng.choice((2, 3, 4, 5, 6, 7)))) for _ in range(rng.randrange(60, 300))), "en", "a") for i in range(400)]
    junk = [(1000 + i, " ".join(x + "***" for x in t.split()), "en", "a") for i, t, *_ in clean[:60]]
    odd = [(2000, None, None, None), (2001, "", "en", "b"), (2002, "w " * 60, None, "b"), (2003, clean[0][1], None, None)]
    df = spark.createDataFrame(clean + junk + odd, "doc_id long, text string, lang string, source string")
    got = by_id(quality_rules.quality_rules(df), "base_failed", "kept")
    assert all(got[i] == (False, True) for i, *_ in clean)
    assert all(got[1000 + i] == (False, False) for i in range(60))
    assert got[2000] == got[2001] == got[2002] == (True, False) and got[2003] == (False, True)
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.quality_rules(docs).count() == docs.count()


def test_pseudonyms_permute(texts):
    p = pii.Permutation(b"k", "n", 1000)
    seen = [p(x) for x in range(1000)]
    assert sorted(seen) == list(range(1000)) and all(p.undo(y) == x and x != y for x, y in enumerate(seen))
    assert [pii.Permutation(b"k", "n", 2)(x) for x in (0, 1)] == [1, 0] and pii.Permutation(b"k", "n", 1)(0) == 0


PERSONAL = "Mail of.55@mail9.example.com, +1 (017) 555-7713, card 4111 1111 1111 1111, account 9807915762804490, 97.51.17.173, 12/31/1999, 31.12.1999, 2020-02-29, 13/4/2020, SSN 123-45-6789, DE89370400440532013000"


def test_pseudonyms(spark, docs, empty):
    df = spark.createDataFrame([(1, PERSONAL, "x"), (2, f"again {PERSONAL}!", "x"), (3, None, "x"), (4, "", "x"), (5, "9" * 3000, "x"), (6, "999.1.1.1 2021-02-30 token=\"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"", "x")], "doc_id long, text string, n_values string")
    out = pii.pseudonymize(df, "key")
    got = by_id(out, "text", "n_values")
    one, two = got[1][0], got[2][0]
    values = re.findall(r"[^\s,]*\d[^,]*", PERSONAL)
    assert not any(v in one for v in values) and got[1][1] == 11 and two == f"again {one}!"
    assert re.sub(r"\d", "9", one.split(", ", 1)[1]) == re.sub(r"\d", "9", PERSONAL.split(", ", 1)[1]) or "." in one
    card = re.search(r"card ([\d ]+)", one)[1].replace(" ", "")
    assert pii.luhn_digit(card[:-1]) == int(card[-1]) and pii.mod97(one.split(", ")[-1]) == 1
    assert pii.Pseudonyms(b"key").replaced(one, undo=True)[0] == PERSONAL
    assert got[3] == (None, 0) and got[4] == ("", 0) and got[5] == ("9" * 3000, 0) and got[6][1] == 0
    assert by_id(pii.pseudonymize(df, "other"), "text")[1][0] != one
    assert pii.pseudonymize(empty, "key").count() == 0 and pii.pseudonymize(docs, "key").count() == docs.count()
    with pytest.raises(ValueError):
        pii.pseudonymize(df, "")


def test_ibans_before_capitals_and_digits():
    names = pii.Pseudonyms(b"key")
    known = ["NO9386011117947", "BE68539007547034", "AT611904300234573201", "DE89370400440532013000", "ES9121000418450200051332", "CZ6508000000192000145399", "SE4550000000058398257466", "RO49AAAA1B31007593840000", "PL61109010140000071219812874"]
    after = ["", ".", " BIC CAIXESBB", " EUR 20", " 2024", " 2024-01-01", " A", " ABCD EFGH 1234", " EUROPE", " 4111 1111 1111 1111", " AB12 3456 7890"]
    for v in known:
        assert pii.mod97(v) == 1
        new = names.replaced(v)[0]
        for layout in (v, " ".join(v[i : i + 4] for i in range(0, len(v), 4))):
            for lead in ("IBAN: ", "AB12 3456 7890 "):
                for x in after:
                    out, counts = names.replaced(f"{lead}{layout}{x}")
                    assert counts["iban"] == 1 and out.startswith(lead) and len(out) == len(lead + layout + x), (v, x)
                    assert out[len(lead) : len(lead + layout)].replace(" ", "") == new, (layout, x)
                    assert "4111 1111 1111" not in out and "2024-01-01" not in out
                    assert names.replaced(out, undo=True)[0] == f"{lead}{layout}{x}"
    assert names.replaced("XX12 3456 7890 ABCD")[1] == {}


def plain_removal(rows, n):
    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        w = SPLIT.findall(t or "")
        for j in range(len(w) - n + 1):
            first.setdefault(tuple(w[j : j + n]), i)
    out = {}
    for i, t in rows:
        w = SPLIT.findall(t or "")
        gone = {j + o for j in range(len(w) - n + 1) if first[tuple(w[j : j + n])] < i for o in range(n)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window,gram", [(50, 10), (12, 3)])
def test_substring_dedup(docs, texts, empty, window, gram):
    got = substring_dedup.digest(substring_dedup.remove_repeats(docs, window, gram=gram)).collect()
    want = plain_removal(list(enumerate(texts)), window)
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]
    if window == 12:
        assert substring_dedup.remove_repeats(empty).count() == 0


def test_removed_words_are_a_seeds_passage(spark):
    rng = random.Random(3)
    p = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    df = spark.createDataFrame([(None, p), (5, f"a b {p} c"), (9, f"{p} tail"), (5, f"again {p}")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): (r["n_removed"], r["intervals"]) for r in substring_dedup.remove_repeats(df).collect()}
    assert got[9, 61] == (60, [[0, 60]]) and got[5, 63][0] == 0 and got[5, 61][0] == 0 and got[None, 60][0] == 0


def test_windows_and_minima():
    ids = WordHashes().of([f"w{i % 7}".encode() for i in range(100)])
    a = Rolling().windows(ids, 20)
    assert len(a) == 81 and a[0] == a[7] and a[0] != a[1] and len(Rolling().windows(ids, 101)) == 0
    x = np.random.default_rng(1).integers(0, 2**63, 200, dtype=np.uint64)
    for w in (1, 2, 3, 7, 8, 41, 200):
        assert (sliding_min(x, w) == np.array([x[i : i + w].min() for i in range(200 - w + 1)])).all()
    assert len(runs(ids, 101)) == 0


def plain_shingles(t):
    w = SPLIT.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return set() if not w else {tuple(w)} if len(w) < 5 else set(zip(*(w[i:] for i in range(5)), strict=False))


def plain_components(rows):
    sets = [(i, plain_shingles(t)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def family(rng, n):
    """Texts that differ in more and more words: links at, above and below the threshold."""
    base = [f"b{rng.randrange(500)}" for _ in range(130)]
    return [" ".join([f"x{i}{j}" if j in set(rng.sample(range(130), i % 9)) else x for j, x in enumerate(base)]) for i in range(n)]


def test_near_duplicates(spark, docs, texts, empty):
    rng = random.Random(8)
    more = family(rng, 60) + family(rng, 30)
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    both = docs.select("doc_id", "text", "_key", "registers").unionByName(extra, allowMissingColumns=True)
    want = plain_components(list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(more)])
    got = near_dedup.near_duplicates(both, block=16).collect()
    assert len(got) == both.count()
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]


def test_near_duplicates_of_odd_rows(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "q r s t u v"), (7, "q r s t u v"), (9, "A B C D E F")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, None, True), (4, 4, True), (4, 4, True), (7, 4, False), (9, 4, False)]


def test_registers_estimate_and_merge():
    p, rng = near_dedup.Sketch(), np.random.default_rng(2)
    seeds = near_dedup.seeds_of(p)
    every = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = every[:2000], every[500:2300]
    ra, rb, rab = (near_dedup.registers_of(x, p, seeds) for x in (a, b, np.union1d(a, b)))
    assert (np.maximum(ra, rb) == rab).all()
    n = lambda x: np.array([int(x)])
    est, _ = near_dedup.plausible(n((ra > rb).sum()), n((ra < rb).sum()), n((ra == rb).sum()), n(2000), n(1800), 0.5, p.base, 14.0)
    assert abs(est[0] - 1500 / 2300) < 0.15


def test_register_floor_drops_no_plausible_pair():
    p, one = near_dedup.Sketch(), lambda x: np.array([x])
    for same in (48, 49, 50):  # 1 of 1e6 pairs at the threshold has 50 or fewer
        more = (p.registers - same) // 2
        assert near_dedup.plausible(one(more), one(p.registers - same - more), one(same), one(1000), one(1000), 0.75, p.base, 14.0)[1][0]
    missed = lambda k: sum(math.comb(96, i) * 0.75**i * 0.25 ** (96 - i) for i in range(k))
    assert missed(math.ceil(near_dedup.least_equal(0.75, p.registers))) < 3e-9


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(edges.limit(0)).count() == 0


def test_packing_plan():
    for seed in range(12):
        rng = random.Random(seed)
        counts = {}
        for _ in range(rng.choice((1, 9, 14, 200))):
            x = rng.choice((rng.randint(1, 100), rng.randint(30, 60), 100))
            counts[x] = counts.get(x, 0) + 1
        plan, used = packing.pack_lengths(counts, 100), {}
        for filling, times in plan:
            assert sum(filling) <= 100 and times > 0
            for s in filling:
                used[s] = used.get(s, 0) + times
        assert used == counts
        bins = sum(t for _, t in plan)
        assert -(-sum(s * c for s, c in counts.items()) // 100) <= bins <= sum(t for _, t in packing.best_fit(counts, 100))
    # best fit takes 4 here; the branch and bound finds 3
    assert sum(t for _, t in packing.pack_lengths({60: 1, 50: 2, 40: 1, 30: 2, 20: 2}, 100)) == 3
    assert packing.pack_lengths({}, 100) == []
    with pytest.raises(ValueError):
        packing.pack_lengths({101: 1}, 100)


def test_packing_plan_of_many_pieces():
    """Bins of five pieces and more: best fit takes 1250 and 75 here, the lower bounds are reached."""
    for counts, least in (({1024: 1200, 410: 1200, 307: 2400}, 1200), ({x: 2 + x % 5 for x in range(100, 401, 2)}, None)):
        plan, used = packing.pack_lengths(counts, 2048), {}
        for filling, times in plan:
            assert sum(filling) <= 2048 and times > 0
            for s in filling:
                used[s] = used.get(s, 0) + times
        bins = sum(t for _, t in plan)
        assert used == counts and bins == -(-sum(s * c for s, c in counts.items()) // 2048) < sum(t for _, t in packing.best_fit(counts, 2048))
        assert least in (None, bins)


def test_completions_are_all_fillings():
    rng = random.Random(2)
    for _ in range(20):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(6)}
        room, waste = rng.randint(5, 60), rng.randint(0, 9)
        every = set(itertools.product(*[range(c + 1) for c in counts.values()]))
        want = {tuple(sorted((s for s, n in zip(counts, ns, strict=True) for _ in range(n)), reverse=True)) for ns in every}
        want = {f for f in want if room - waste <= sum(f) <= room}
        for even in (False, True):
            got = list(packing.completions(sorted(counts), counts, room, waste, even))
            assert len(got) == len(set(got)) and set(got) == want and [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


def test_packing(docs, texts, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, 2048, with_ids=True).collect()
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])[:: 2 if i == 3 else 1]  # document 3 is there twice
        assert [x for r in pieces for x in r["ids"]] == ids
        for r in pieces:
            assert r["length"] == len(r["ids"]) <= 2048 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
            assert r["ids"] == ids[r["start"] : r["start"] + r["length"]] and (r["piece"] == 0 or r["length"] == 2048)
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_encoder_of_odd_spaces():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a  b", " lead", "trail ", "", "x\n y", "  a", "it's 's 12 3", "<|endoftext|> x", "é" * 50 + " \tz", "a\x1c b \x1c c", "tab\tx \t y", "  ", "\n\n a", "a b  c", "z" * 9000]
    got = packing.Encoder(None).batch(odd)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(o, add_special_tokens=False).ids for o in odd]


def test_marks_of_special_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [mark, f"a b{mark}c d", f"a b {mark} c  d", f"{mark}{mark}x", f"x \n{mark}\n y", "plain words", f"é <|endof{mark}text|> {mark}", "", "a <|endoftext |> b", f"w {mark} " * 900]
    want = [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert want[0] == [50256, 0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(df, 2048, with_ids=True).orderBy("doc_id", "piece").collect()
    for i, ids in enumerate(want):
        pieces = [r for r in got if r["doc_id"] == i]
        assert [x for r in pieces for x in r["ids"]] == ids and sum(r["length"] for r in pieces) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in pieces)


SMALL = quality_classifier.Settings(rows=600, epochs=20)


def test_classifier(spark, docs, empty):
    rng = random.Random(4)
    good = [(i, " ".join("".join(rng.choice("etaoin") for _ in range(5)) for _ in range(rng.randrange(5, 120))), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(x + rng.choice(("***", "$$$")) for x in t.split()), 0) for i, t, _ in good]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, y int")
    labels = df.select("doc_id", F.col("y").alias("quality")).unionByName(spark.createDataFrame([(None, 1), (5000, None), (5001, 7)], "doc_id long, quality int"))
    model = quality_classifier.fit(df, labels, settings=SMALL)
    got = quality_classifier.score(df, model, settings=SMALL).withColumn("out", quality_classifier.held_out("doc_id")).join(df.select("doc_id", "y"), "doc_id")
    r = got.where("out").agg(F.avg((F.col("predicted") == F.col("y")).cast("double")), F.min("score"), F.max("score"), F.count("*")).first()
    assert r[0] > 0.97 and 0 <= r[1] and r[2] <= 1 and 100 < r[3] < 300
    crc = {r["doc_id"]: r["out"] for r in got.collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 3 == 1) for k, v in crc.items())
    assert quality_classifier.score(docs, model, settings=SMALL).where("score between 0 and 1").count() == docs.count()
    assert quality_classifier.score(empty, model, settings=SMALL).count() == 0
    assert sorted(quality_classifier.accepted(docs, model, settings=SMALL).columns) == sorted(docs.columns)
    assert quality_classifier.fit(df, labels.limit(0), settings=SMALL) is None
    assert {x["score"] for x in quality_classifier.score(df.limit(5), None).collect()} == {0.5}
