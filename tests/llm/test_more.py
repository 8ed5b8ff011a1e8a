"""Rules that hold at every size, hot keys, and operators against brute force on small lists."""

import datetime
import functools
import hashlib
import ipaddress
import itertools
import math
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from heddle.llm import common, components, decontamination, license_scan, near_dedup, packing, pii, quality_rules, secret_scan, sharding, substring_dedup
from tests.llm.test_free import family, plain_components, plain_removal
from tests.llm.test_native import plain_decontamination


@pytest.fixture
def hot(monkeypatch):
    """Every key with more than three rows is hot, and no table is small."""
    for module in (common, near_dedup, decontamination, quality_rules):
        for name, value in (("HOT_ROWS", 3), ("HOT_KEYS", 10**9), ("BROADCAST_ROWS", -1), ("KEY_ROWS", -1)):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(common.by_key, "__defaults__", ("inner", -1))


def plain_mcd(x, p):
    """The estimate of one group by the same starts and steps: (center, covariance)."""
    n, k = x.shape
    h, floors = math.ceil(n * p.share), np.diag(np.array(p.floors) ** 2)
    least = lambda v: np.sort(v)[math.ceil(len(v) / 2) - 1]
    middle = np.array([least(x[:, i]) for i in range(k)])
    mad = np.array([least(abs(x[:, i] - middle[i])) for i in range(k)])
    plain = np.cov(x.T, bias=True).reshape(k, k)
    starts = [(middle, np.diag((mad * 1.4826) ** 2) + floors), (x.mean(0), plain + floors), *quality_rules.trial_starts(x, p)]

    def step(center, cov):
        d = x - center
        q = np.minimum(np.floor(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) * (1 << 20)), 1 << 30)
        own = x[q <= np.sort(q)[h - 1]]
        cov = np.cov(own.T, bias=True).reshape(k, k) * quality_rules.consistency(p.share) + floors
        return np.linalg.slogdet(cov)[1], own.mean(0), cov

    runs = []
    for i, (center, cov) in enumerate(starts):
        logdet, done = math.inf, False
        for _ in range(p.tried):
            if not done:
                last, (logdet, center, cov) = logdet, step(center, cov)
                done = last - logdet <= p.settle
        runs.append((logdet, i, done, center, cov))
    best = []
    for logdet, i, done, center, cov in sorted(runs, key=lambda r: r[:2])[: p.carried]:
        while not done:
            last, (logdet, center, cov) = logdet, step(center, cov)
            done = last - logdet <= p.settle
        best.append((logdet, i, center, cov))
    return min(best, key=lambda r: r[:2])[2:]


def test_starts_find_the_least_determinant():
    """Against all subsets of small groups, with outliers apart, together, and none."""
    p, rng, missed = quality_rules.Robust(), np.random.default_rng(1), 0
    floors, factor = np.diag(np.array(p.floors) ** 2), quality_rules.consistency(p.share)
    h = math.ceil(14 * p.share)
    subsets = np.array(list(itertools.combinations(range(14), h)))
    for i in range(200):
        x = rng.normal(size=(14, 4)) * np.array([0.1, 0.15, 0.2, 0.2]) * rng.uniform(0.5, 3)
        x[:3] += (rng.normal(size=(3, 4)) * 0.8, rng.normal(size=4), 0.0)[i % 3]
        x = np.rint(np.abs(x) * 4096) / 4096
        own = x[subsets]
        d = own - own.mean(axis=1, keepdims=True)
        least = np.linalg.slogdet(np.einsum("sij,sik->sjk", d, d) / h * factor + floors)[1].min()
        missed += np.linalg.slogdet(plain_mcd(x, p)[1])[1] > least + 1e-5
    assert missed <= 2


def plain_kept(rows, p):
    """Distance of every vector (lang, source, x) from its group's estimate, leaning on its language's."""
    x = np.array([r[2] for r in rows])
    lean = quality_rules.leaning
    every = plain_mcd(x, p)
    out, models = [], {}
    for lang in {r[0] for r in rows}:
        own = np.array([r[2] for r in rows if r[0] == lang])
        models[lang] = lean(len(own), plain_mcd(own, p), every, p.weight)
    for g in {r[:2] for r in rows}:
        own = np.array([r[2] for r in rows if r[:2] == g])
        models[g] = lean(len(own), plain_mcd(own, p), models[g[0]], p.weight)
    for lang, source, v in rows:
        c, s = models[lang, source]
        out.append(float((v - c) @ np.linalg.inv(s) @ (v - c)))
    return out


def test_robust_estimates_equal_plain_steps(spark, hot):
    rng, p = random.Random(12), quality_rules.Robust()
    word = lambda a, b: "".join(rng.choice("etaoin") for _ in range(rng.randrange(a, b)))
    docs = []
    for lang, source, n in (("en", "a", 150), ("en", "b", 40), ("en", "c", 3), ("de", "a", 60), ("fr", None, 1)):
        for _ in range(n):
            text = " ".join(word(2, 8 if lang == "en" else 11) + rng.choice(["", "", "", "", "#"]) for _ in range(rng.randrange(55, 200)))
            if rng.random() < 0.15:
                text = re.sub(r"(\w) ", r"\1*** ", text) if rng.random() < 0.5 else "\n".join([text[:60]] * 4) + "\n" + text
            docs.append((len(docs), text, lang, source))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    rows = []
    for i, text, lang, source in docs:
        n, chars, symbols, lines, repeats = quality_rules.statistics_of(text)
        if n >= 50 and 100 * repeats <= 50 * n:
            v = np.rint(np.array([math.log(chars / n), *(math.sqrt(c / n) for c in (symbols, lines, repeats))]) * 4096) / 4096
            rows.append((lang, source, v, i))
    want = dict(zip([r[3] for r in rows], plain_kept([r[:3] for r in rows], p), strict=True))
    got = {r["doc_id"]: (r["kept"], r["distance"]) for r in quality_rules.quality_rules(df.repartition(5)).collect()}
    bound = quality_rules.chi2_4(p.quantile)
    assert len(got) == len(docs) and sum(not k for k, _ in got.values()) > 10
    for i, (kept, distance) in got.items():
        assert (distance is None) == (i not in want)
        assert i not in want or (abs(distance - want[i]) <= 1e-6 * (1 + want[i]) and kept == (want[i] <= bound))
    again = {r["doc_id"]: (r["kept"], r["distance"]) for r in quality_rules.quality_rules(df.repartition(2, "text")).collect()}
    assert again == got  # to the last bit, however rows are dealt


def test_joins_with_hot_keys(spark, hot):
    left = spark.createDataFrame([(i, i % 7 if i % 3 else 100) for i in range(60)], "i long, k long")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m")).where("k <> 5")
    for how in ("inner", "left_semi", "left_anti"):
        want = sorted(map(tuple, left.join(right, ["k"], how).select(*(["k", "i", "m"] if how == "inner" else ["k", "i"])).collect()))
        got = common.by_key(left, right, ["k"], "n", how)
        assert sorted(map(tuple, got.select(*(["k", "i", "m"] if how == "inner" else ["k", "i"])).collect())) == want


def test_settings_and_tables_are_given_back(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    common.released(spark)
    spark.conf.set(name, "700")
    out = common.written(substring_dedup.digest(substring_dedup.remove_repeats(docs.limit(5))))
    assert spark.conf.get(name) == str(common.ARROW_ROWS)
    common.released(spark, out)
    assert spark.conf.get(name) == "700" and common._written == [out] and out.count() == 5
    common.released(spark)
    spark.conf.unset(name)
    assert common._written == []


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)


def test_pseudonyms_of_long_addresses():
    names, seen = pii.Pseudonyms(b"key"), set()
    for n in range(1, 301):
        local = ("ab9.Z_" * 60)[:n] if n % 2 else "a" * n
        v = f"{local}@example.org"
        new, counts = names.replaced(f"to {v} now")
        assert counts == {"email": 1} and len(new) == len(v) + 7 and v not in new and new.endswith("@example.org now")
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", new))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", f"to {v} now")))
        assert names.replaced(new, undo=True)[0] == f"to {v} now"
        seen.add(new)
    assert len(seen) == 300


def test_dates_of_all_years():
    names = pii.Pseudonyms(b"key")
    for day in [datetime.date.min, datetime.date(1899, 12, 31), datetime.date(1900, 1, 1), datetime.date(2099, 12, 31), datetime.date(2100, 1, 1), datetime.date.max]:
        for v in (f"{day.year:04d}-{day.month:02d}-{day.day:02d}", f"{day.month:02d}/{day.day:02d}/{day.year:04d}", f"{day.day:02d}.{day.month:02d}.{day.year:04d}"):
            new, counts = names.replaced(f"on {v}, so")
            assert counts == {"date": 1} and new != f"on {v}, so" and names.replaced(new, undo=True)[0] == f"on {v}, so"
            year = int(re.search(r"\d{4}", new)[0])
            assert (1900 <= year <= 2099) == (1900 <= day.year <= 2099)


def test_planted_values_are_found_and_nothing_else():
    """Values made without the module's patterns, between ordinary words: all go, the words stay."""
    rng, names = random.Random(21), pii.Pseudonyms(b"key")
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def luhn(n):
        body = digits(n - 1)
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def iban():
        body = digits(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    def day(form):
        return (datetime.date(1950, 1, 1) + datetime.timedelta(rng.randrange(30_000))).strftime(form)

    make = {
        "email": lambda: f"{rng.choice(['ann', 'bo.lee', 'c_d'])}{digits(3)}@mail{digits(2)}.example.net",
        "iban": iban,
        "date": lambda: day(rng.choice(["%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y"])),
        "phone": lambda: rng.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+49 30 {digits(4)} {digits(4)}"]),
        "ssn": lambda: f"{rng.randrange(100, 600):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10_000):04d}",
        "ip": lambda: str(ipaddress.IPv4Address(rng.randrange(1 << 24, 1 << 32))),
        "card": lambda: " ".join(re.findall("....", luhn(16))),
    }
    for _ in range(60):
        kinds = [rng.choice(list(make)) for _ in range(5)]
        values = [make[k]() for k in kinds]
        words = ["".join(rng.choice("etaoin") for _ in range(5)) for _ in range(6)]
        text = words[0] + "".join(f" {v}{rng.choice([',', ';', ' and', '!'])} {w}" for v, w in zip(values, words[1:], strict=True))
        new, counts = names.replaced(text)
        assert sum(counts.values()) == 5 and counts == {k: kinds.count(k) for k in set(kinds)}, (text, new)
        assert not any(v in new for v in values) and all(w in new for w in words) and names.replaced(new, undo=True)[0] == text
    plain = "Version 3.14.15 of 2 parts, 12 of 345 items at 9:30, room 1204, x=17; pages 10-20 (a) 1.5 and 99% #42"
    assert names.replaced(plain) == (plain, {})


def test_every_window_hashed_gives_the_same(docs, texts, hot):
    few = substring_dedup.digest(substring_dedup.remove_repeats(docs)).collect()
    all_ = substring_dedup.digest(substring_dedup.remove_repeats(docs, every=True)).collect()
    want = plain_removal(list(enumerate(texts)), 50)
    assert sorted(map(tuple, few)) == sorted(map(tuple, all_)) and all(tuple(r)[1:] == want[r["doc_id"]] for r in few)


def least_bins(lengths, size):
    """Fewest bins, by trying everything."""
    n = len(lengths)

    @functools.cache
    def best(mask):
        """(bins, room used in the last) for the lengths in mask."""
        if not mask:
            return 1, 0
        out = (n + 1, 0)
        for i in range(n):
            if mask >> i & 1:
                b, used = best(mask & ~(1 << i))
                out = min(out, (b, used + lengths[i]) if used + lengths[i] <= size else (b + 1, lengths[i]))
        return out

    return best((1 << n) - 1)[0] if n else 0


def test_packing_equals_exhaustive_search():
    improved = 0
    for seed in range(250):
        rng = random.Random(seed)
        size = rng.choice((20, 50, 100))
        lo, hi = rng.choice(((1, size), (size // 5, size // 2), (size // 4, size * 7 // 10)))
        lengths = [rng.randint(max(lo, 1), hi) for _ in range(rng.randrange(1, 12))]
        counts = {x: lengths.count(x) for x in lengths}
        bins = sum(t for _, t in packing.pack_lengths(counts, size))
        assert bins == least_bins(tuple(lengths), size), (size, lengths)
        improved += bins < sum(t for _, t in packing.best_fit(counts, size))
    assert improved


def test_dominated_fillings():
    sizes, counts = [10, 20, 30, 50], {10: 1, 20: 2, 30: 1, 50: 1}
    assert packing.dominated((20,), sizes, counts, 10)  # 10 fits too, and 30 is better
    assert packing.dominated((20, 30), sizes, counts, 0)  # 50 can stand in for both
    assert not packing.dominated((50,), sizes, counts, 0) and not packing.dominated((50,), sizes, counts, 9)


def test_rendezvous_equals_a_plain_version(spark):
    def draw(key, shard, weight):
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight

    weights = {0: 1.0, 1: 2.5, 7: 1.0, 40: 0.3}
    ids = spark.range(3000).selectExpr("id * 7919 - 5000000 AS doc_id", "'x' AS text")
    got = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(ids, weights).collect()}
    for key, shard in got.items():
        draws = sorted((draw(key, s, w), s) for s, w in weights.items())
        assert shard == draws[0][1] or draws[1][0] - draws[0][0] < 1e-12


def test_model_spans_equal_a_plain_scorer(spark, docs):
    ratios = secret_scan.fit_markov(secret_scan.labelled_samples(spark, 1500))
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(["x " + "deadbeefdeadbeef01 " * 3000, "p9hT2kQ7xZp4VwLm8Rb3NsYc6 " * 700, "a_b-c/d=e+f " * 50])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    for r in secret_scan.find_secrets(both, ratios).join(both.dropDuplicates(["doc_id"]), "doc_id").collect():
        text, base, want = r["text"] or "", [s for s in r["spans"] if s["kind"] != "markov"], []
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
            t = m[0]
            if not (re.search("[0-9]", t) and re.search("[A-Za-z]", t)) or any(b["start"] < m.end() and m.start() < b["end"] for b in base):
                continue
            steps = np.cumsum([0.0, *(ratios[ord(a) * 128 + ord(b)] for a, b in itertools.pairwise(t))])
            if max(steps[i + 19 :].max() - steps[i] for i in range(len(t) - 19)) > secret_scan.MARGIN:
                want.append((m.start(), m.end()))
        assert [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "markov"] == want, r["doc_id"]
        assert all(text[s["start"] : s["end"]] == s["text"] for s in r["spans"])
        if r["doc_id"] == 1000:
            assert len(base) == 3000
        if r["doc_id"] == 1001:
            assert len(want) == 700


MORE = [
    ("GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.", "GPL-3.0-only", "copyleft"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.", "GPL-2.0-only", "copyleft"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   1. Definitions.", "Apache-2.0", "permissive"),
    ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "MPL-2.0", "copyleft"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later", "copyleft"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "AGPL-3.0-or-later", "copyleft"),
    ("ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED", "ISC", "permissive"),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib", "permissive"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.", "Unlicense", "permissive"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)", "BSL-1.0", "permissive"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/", "EPL-2.0", "copyleft"),
    ("To the extent possible under law, Jane Q. Doe has waived all copyright and\nrelated or neighboring rights to this work.", "CC0-1.0", "permissive"),
    *[(f"SPDX-License-Identifier: {x}", x, y) for x, y in (("MIT", "permissive"), ("Apache-2.0", "permissive"), ("BSD-2-Clause", "permissive"), ("BSD-3-Clause", "permissive"), ("GPL-2.0-only", "copyleft"), ("GPL-3.0-or-later", "copyleft"), ("LGPL-3.0-or-later", "copyleft"), ("MPL-2.0", "copyleft"))],
]


def test_more_licenses(spark):
    dress = [lambda t: t, lambda t: "".join(f"# {x}\n" for x in t.split("\n")), lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */\nint x;"]
    cases = {10 * i + j: (f(t), *want) for i, (t, *want) in enumerate(MORE) for j, f in enumerate(dress)}
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["terms"]) for r in license_scan.scan_licenses(df).collect()}
    assert got == {k: tuple(v[1:]) for k, v in cases.items()}


def test_hint_drops_no_sentence_of_any_table(spark):
    own = {"zebra crossing ahead": "zebra", "mind the gap": "gap"}
    df = spark.createDataFrame([(1, "Zebra crossing ahead."), (2, "x. Mind the\nGAP!"), (3, "mind")], "doc_id long, text string")
    got = {r["doc_id"]: r["sentence_ids"] for r in license_scan.scan_licenses(df, sentences=own).collect()}
    assert got == {1: "zebra", 2: "gap", 3: ""}
    pattern = re.compile(license_scan.hint(license_scan.KNOWN))
    assert all(pattern.search(s) for s in license_scan.KNOWN)


def test_decontamination_with_hot_passages(spark, docs, texts, hot):
    items = [(1, texts[20]), (2, " ".join(texts[46].split()[5:60])), (3, texts[46]), (4, "one"), (5, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = dict(enumerate(plain_decontamination(texts, items)))
    got = decontamination.decontaminate(docs, bench).collect()
    assert len(got) == docs.count() and all(tuple(r)[1:] == want[r["doc_id"]] for r in got)
    twice = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(46, "clean words only, though the key is there twice")], "doc_id long, text string"))
    left = [tuple(r) for r in decontamination.uncontaminated(twice, bench).select("doc_id", "text").collect()]
    assert (46, "clean words only, though the key is there twice") in left and (46, texts[46]) not in left
    assert sorted({i for i, _ in left} - {46}) == sorted(i for i, w in want.items() if not w[-1])


def test_near_duplicates_with_hot_keys(spark, docs, texts, hot):
    rng = random.Random(4)
    more = family(rng, 40) + family(rng, 25) + ["one large group of copies of this very text, word by word"] * 30
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    want = plain_components(list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(more)])
    got = near_dedup.near_duplicates(both, block=8).collect()
    assert len(got) == both.count() and all(tuple(r)[1:] == want[r["doc_id"]] for r in got)


def test_components_of_a_hub(spark, hot):
    edges = spark.createDataFrame([(500, i) for i in range(1, 60)] + [(i, i + 1000) for i in range(1, 60, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert set(got.values()) == {1} and len(got) == 60 + 9


def test_registers_are_equal_as_often_as_sets_are_similar():
    """Pairs planted at similarities from 0.75 to 0.8: equal registers follow the binomial law, and all are candidates."""
    p, rng, shares, missed = near_dedup.Sketch(), np.random.default_rng(5), [], 0
    seeds = near_dedup.seeds_of(p)
    for trial in range(400):
        n, s = int(rng.integers(20, 400)), 0.75 + 0.05 * (trial % 5) / 4
        both = math.ceil(s * n)
        every = rng.integers(0, 2**63, n, dtype=np.uint64) if trial % 2 else (np.arange(n, dtype=np.uint64) + np.uint64(trial * 1000)) << np.uint64(32)  # also sets in sequence
        cut = both + (n - both) // 2
        a, b = near_dedup.registers_of(every[:cut], p, seeds), near_dedup.registers_of(np.concatenate([every[:both], every[cut:]]), p, seeds)
        shares.append((a == b).mean() - both / n)
        missed += not (a == b).reshape(p.bands, p.rows).all(axis=1).any()
    assert missed == 0 and abs(np.mean(shares)) < 0.01 and 0.03 < np.std(shares) < 0.06


def test_packing_search_put_away_and_taken_up_is_the_same(monkeypatch):
    lists = []
    for seed in range(30):
        rng = random.Random(seed)
        xs = [rng.randint(12, 60) for _ in range(rng.randrange(5, 40))]
        lists.append({x: xs.count(x) for x in xs})
    want = [packing.pack_lengths(c, 100, nodes=2000) for c in lists]
    monkeypatch.setattr(packing, "LIVE", 1)
    assert [sum(t for _, t in packing.pack_lengths(c, 100, nodes=2000)) for c in lists] == [sum(t for _, t in w) for w in want]


def test_a_passage_in_very_many_items(spark, hot):
    """A passage that all items share is one row to join with, and documents are never multiplied by items."""
    shared = " ".join(f"s{i}" for i in range(12))
    items = [(i, f"{shared} own{i} " + " ".join(f"i{i}w{j}" for j in range(10))) for i in range(5000)]
    texts = [f"before{i} {shared} after{i}" for i in range(20)] + ["clean text", None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    source = bench.select(F.col("item_id").alias("_item"), decontamination.words(F.col("text")).alias("_w"))
    passages, classes = decontamination._passages(source, [10], 10)
    assert passages.count() == passages.select("a", "b").distinct().count() and classes.count() == 5001 and classes.agg(F.max(F.size("_items"))).first()[0] == 5000
    judged, hits, _ = decontamination._hits(df, bench, 10, 5, "doc_id", "text", "item_id", "text")
    assert hits.count() == 20 * 3 and judged.count() == 22
    sets, said = decontamination._named(hits, classes, "doc_id")
    assert said.count() == 1 and sets.count() == 20
    got = {r["doc_id"]: r for r in decontamination.decontaminate(df, bench).collect()}
    want = hashlib.sha256(",".join(sorted(str(i) for i in range(5000))).encode()).hexdigest()
    assert all(got[i]["n_items"] == 5000 and got[i]["items_sha256"] == want and got[i]["n_hit"] == 12 for i in range(20)) and not got[20]["contaminated"] and got[21]["n_words"] == 0


def test_rows_are_numbered_by_ranges(spark):
    """Without a gap, in order, the same however rows are dealt, and equal rows in several tasks."""
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("x"), F.lit("t").alias("extra"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for parts in (1, 5):
        got = common.numbered(df.repartition(parts), ["g"], ["x"], "n")
        rows = sorted((r["g"], r["n"], r["x"]) for r in got.collect())
        assert [r[:2] for r in rows] == [(g, n) for g in (0, 1) for n in range(1500)] and all(a[2] <= b[2] for a, b in itertools.pairwise(rows) if a[0] == b[0])
        ranged = [p for p in common._written if "_part" in p.columns and "x" in p.columns][-1]
        assert ranged.where("x = 7 AND g = 0").select("_part").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert common.numbered(df.limit(0), ["g"], ["x"], "n").count() == 0
