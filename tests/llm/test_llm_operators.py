"""Operators against brute-force versions, round trips or held-out accuracy, and the odd cases: nulls, empties, ties, clashing columns."""

import json
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from choicelake.llm import ann, common, decontam, langid, licenses, neardup, packing, quality, sharding, simhash, tokens, urls
from choicelake.llm import queries as Q
from choicelake.llm.license_rules import rules

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
ODD = ["", None, "a", "é", "  \n\t ", "word " * 3000, "don't 's ''s I'll\r\n  \n x", "<|endoftext|>", "a<|endoftext|> b  ",
       "数字123 かな\u00a0\u2003x", "\u0000\u0001", "👩‍👩‍👧 flags 🇩🇪", "x" * 3000, "CC-BY all rights reserved", "!!!", "12345"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)] + [(None, "no id", "en", "s"), (3, "é", "en", "s"), (100, "a", None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.tokenizer_path())


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- token counts -----------------------------------------------------------------------------


def test_token_counts_are_the_library_s(odd, docs, tokenizer):
    for df in (odd, docs):
        df = df.withColumn("n_tokens", df.doc_id)
        for r in rows_of(tokens.with_token_counts(df, Q.tokenizer_path())):
            text = r["text"] or ""
            assert r["n_tokens"] == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text[:50])
            assert r["n_bytes"] == len(text.encode()) and r["over_limit"] == (r["n_tokens"] > 1024)


def test_merges_against_the_naive_loop():
    vocab = tokens.vocabulary(Q.tokenizer_path())
    letters, rng = tokens.byte_letters(), np.random.default_rng(0)
    for _ in range(300):
        data = bytes(rng.choice(list(b"theandingst e"), rng.integers(1, 24)).tolist())
        symbols = [letters[b] for b in data]
        naive, n = list(symbols), 0
        while True:
            pairs = [(vocab.ranks[p][0], i) for i, p in enumerate(zip(naive, naive[1:])) if p in vocab.ranks]
            if not pairs:
                break
            i = min(pairs)[1]
            naive[i : i + 2] = [naive[i] + naive[i + 1]]
            n += 1
        assert tokens.merges(symbols, vocab.ranks) == n


def test_token_counts_of_nothing(empty):
    assert tokens.with_token_counts(empty, Q.tokenizer_path()).count() == 0


# --- packing ------------------------------------------------------------------------------------


def _check_packing(df, packed, tokenizer, capacity):
    want = {}
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(r["doc_id"], []).append(ids)
    sequences = {}
    for r in packed:
        assert any(len(ids) >= r["start"] + r["length"] and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for ids in want[r["doc_id"]])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in packed) == sum(len(i) for v in want.values() for i in v)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_round_trip(odd, docs, tokenizer):
    for df, capacity in ((odd, 64), (docs, 1024)):
        packed = rows_of(packing.pack(df, Q.tokenizer_path(), capacity))
        n = _check_packing(df, packed, tokenizer, capacity)
        assert n <= -(-sum(r["length"] for r in packed) // capacity) * 1.05 + 1


def test_packing_gives_ids_back(odd, tokenizer):
    for r in rows_of(packing.pack(odd.where("doc_id = 6"), Q.tokenizer_path(), ids=True)):
        assert r["ids"] == [*tokenizer.encode(ODD[6], add_special_tokens=False).ids, 2]


def test_encoder_is_the_library(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    rng = np.random.default_rng(4)
    marks = ["a", " ", "  ", "\n", " \n", " ", " ", "'s", "'ll", "<|endoftext|>", "é", "数", "12", " !", "…", "\u3000", "\x1c", "\x85", "\u200b", "\t", "\r\n", " x"]
    encode = packing.Encoder(Q.tokenizer_path())
    for _ in range(300):
        texts = ["".join(rng.choice(marks, int(rng.integers(0, 15)))) for _ in range(30)]
        for text, ids in zip(texts, encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_very_long_runs(spark, tokenizer):
    texts = [" " * 1_000_000, "a" * 1_000_000, "\x00\n\t" * 100_000 + "x", "a b" + " " * 1_500_000 + "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _check_packing(df, rows_of(packing.pack(df, Q.tokenizer_path())), tokenizer, 1024)


def test_packing_nothing(empty):
    assert packing.pack(empty, Q.tokenizer_path()).count() == 0


def _optimal(items, capacity):
    """Least number of bins by search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for b in range(len(bins)):
            if bins[b] >= items[i] and bins[b] not in tried:
                tried.add(bins[b])
                bins[b] -= items[i]
                place(i + 1, bins)
                bins[b] += items[i]
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = np.random.default_rng(1)
    for _ in range(300):
        capacity = int(rng.integers(8, 20))
        items = rng.integers(1, capacity + 1, rng.integers(1, 9)).tolist()
        counts = {x: items.count(x) for x in items}
        fixed, left = packing.reduce(dict(counts), capacity)
        used = [x for pattern, n in fixed.items() for x in pattern * n]
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sorted(used + rest) == sorted(items)
        assert all(sum(p) <= capacity for p in fixed)
        assert sum(fixed.values()) + _optimal(rest, capacity) == _optimal(items, capacity), items
        done = packing.plan(dict(counts), capacity)
        assert sorted(x for p, n in done.items() for x in p * n) == sorted(items) and all(sum(p) <= capacity for p in done)


# --- SimHash --------------------------------------------------------------------------------------


def naive_fingerprint(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(values, linked):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def _check_components(df, found):
    ids = [r["doc_id"] for r in found]
    prints = [int(r["fingerprint"], 16) for r in found]
    label = components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    for i, r in enumerate(found):
        assert r["component_id"] == min((ids[j] for j in range(len(ids)) if label[j] == label[i] and ids[j] is not None), default=None)


def test_fingerprints_and_components(odd, docs, spark):
    from pyspark.sql import functions as F

    for df in (odd, docs):
        found = rows_of(simhash.with_components(df).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id"))
        assert len(found) == df.count()
        _check_components(df, found)
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], set()).add("%016x" % naive_fingerprint(r["text"], 3))
    for r in rows_of(simhash.with_components(odd).select("doc_id", simhash.hex_digits(F.col("fp")).alias("f"))):
        assert r["f"] in texts[r["doc_id"]]


def test_hot_keys_give_the_same_components(spark, monkeypatch):
    from choicelake.llm.common import connected_components

    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**32))
    values = {(base << 32) ^ int(x) for x in rng.integers(0, 2**10, 150)} | {((base ^ 1) << 32) ^ int(x) for x in rng.integers(0, 2**10, 20)} | set(map(int, rng.integers(0, 2**63, 30)))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    results = []
    for hot in (10**6, 8):
        monkeypatch.setattr(simhash, "HOT", hot)
        found = {r["node"]: r["component"] for r in connected_components(simhash.links(df)).collect()}
        results.append([found.get(v, v) for v in signed])
    assert results[0] == results[1]
    label = components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    groups = lambda x: sorted(sorted(i for i in range(len(x)) if x[i] == g) for g in set(x))
    assert groups(results[0]) == groups(label)


def test_probes_and_rows_are_not_broadcast(spark, tmp_path, monkeypatch):
    """A file of few bytes may hold many probes or copies; no join may gather them in the driver."""
    path = str(tmp_path / "prints")
    spark.range(300).selectExpr("id as fp").write.parquet(path)
    prints = spark.read.parquet(path)
    inner = lambda df: re.findall(r"(\w+Join) [^\n]*Inner", df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(simhash, "HOT", 10**6)
    assert set(inner(simhash.links(prints))) == {"SortMergeJoin"}
    monkeypatch.setattr(simhash, "HOT", 8)
    joins = inner(simhash.links(prints))
    assert len(joins) >= 2 and set(joins) == {"SortMergeJoin"}
    copies = spark.range(300).selectExpr("cast(null as long) as doc_id", "'one and the same text' as text")
    found = simhash.with_components(copies)
    assert found.count() == 300 and not inner(found)


def test_deduplication_keeps_one_of_each(spark, odd, empty):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(400)]
    text = lambda: rng.choice(words, 120).tolist()
    rows, group = [], []
    for g in range(12):
        body = text()
        for copy in range(4):
            new = list(body)
            if copy:
                new[int(rng.integers(120))] = "changed"
            rows.append((len(rows), " ".join(new), "en", "s"))
            group.append(g)
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "group")
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4 * g for g in range(12)]
    assert neardup.deduplicated(empty).count() == 0
    left = sorted((r["doc_id"] for r in neardup.deduplicated(odd).collect()), key=lambda x: (x is None, x))
    # nulls, empties and blanks are one group; "a" and "é" each have a copy
    assert left == [0, 2, 3, *range(5, 16), None]


def test_deduplication_meets_cut_and_appended_copies(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rows, group = [], []
    for n in (25, 50, 120, 500, 1500):
        for _ in range(12):
            body, other = rng.choice(words, n).tolist(), rng.choice(words, n).tolist()
            for new in (body, body[: n - int(0.15 * n)], body + other[: int(0.15 * n)]):
                rows.append((len(rows), " ".join(new), "en", "s"))
    sets = [set(simhash.shingle_hashes(simhash.word_bytes(r[1]), 5).tolist()) for r in rows]
    label = components(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) > 0)
    for i, g in enumerate(label):
        group.append((g, i))
    several = {g for g in label if label.count(g) > 1}
    assert len(several) == 60
    left = {r["doc_id"] for r in neardup.deduplicated(spark.createDataFrame(rows, DOCS)).collect()}
    for g in several:
        assert [i for h, i in group if h == g and i in left] == [min(i for h, i in group if h == g)]


def test_deduplication_finds_all_groups_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 8000")
    rows = docs.select("doc_id", "text").collect()
    sets = [set(simhash.shingle_hashes(simhash.word_bytes(r["text"]), 5).tolist()) for r in rows]
    label = components(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) > 0)
    left = {r["doc_id"] for r in neardup.deduplicated(docs).select("doc_id").collect()}
    groups = {}
    for r, g in zip(rows, label):
        groups.setdefault(g, []).append(r["doc_id"])
    several = [ids for ids in groups.values() if len(ids) > 1]
    assert several and all([i for i in ids if i in left] == [min(ids)] for ids in several)


# --- decontamination ---------------------------------------------------------------------------------


def test_overlaps_tolerate_substitutions(spark, odd, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()
    changed = list(item)
    changed[3] = changed[14] = "other"
    half = [*item[:6], *"one two three four five six seven eight nine ten".split()]
    rows = [(1, "Intro, " + " ".join(item).title() + ". End."), (2, "x y " + " ".join(changed)), (3, " ".join(half)), (4, "exact five words in here"),
            (5, "exact five words in here too"), (6, None), (7, " ".join(reversed(item)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (10, "exact five words in here"), (11, None), (12, "too short"), (None, "alpha beta")], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["start_word"], r["n_words"], r["n_matched"]) for r in decontam.overlaps(df, bench).collect())
    assert found == [(1, 9, 1, 18, 18), (2, 9, 2, 18, 16), (4, 10, 0, 5, 5), (5, 10, 0, 5, 5)]
    kept = decontam.decontaminated(df, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 6, 7] and kept.columns == df.columns
    assert decontam.decontaminated(empty, bench).count() == 0
    assert decontam.decontaminated(odd, bench.limit(0)).count() == odd.count()


def test_planted_passages_are_found(spark, docs):
    word = lambda s: " " + " ".join(re.findall(r"[^\W_]+", s.lower())) + " "
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [word(r["text"]) for r in bench.collect()]
    want = {r["doc_id"] for r in docs.collect() for w in [word(r["text"] or "")] if any(i in w for i in items)}
    assert want and {r["doc_id"] for r in decontam.overlaps(docs, bench).collect()} == want


def test_chunks_change_nothing(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontam.overlaps(docs, bench).collect()))
    marked = docs.withColumn("overlaps", docs.doc_id).withColumn("hash", docs.doc_id).withColumn("found", docs.doc_id)
    kept = sorted(map(tuple, decontam.decontaminated(marked, bench).select(*marked.columns).collect()), key=repr)
    monkeypatch.setattr(decontam, "CHUNK", 3000)
    assert sorted(map(tuple, decontam.overlaps(docs, bench).collect())) == whole
    again = decontam.decontaminated(marked, bench)
    assert sorted(again.columns) == sorted(marked.columns)
    assert sorted(map(tuple, again.select(*marked.columns).collect()), key=repr) == kept
    assert all(r["doc_id"] == r["overlaps"] == r["hash"] == r["found"] for r in again.collect())


def naive_overlaps(text, item):
    """Does any alignment hold a stretch that the rules accept?"""
    there, own = ([w for w in re.findall(r"[^\W_]+", x.lower())] for x in (text, item))
    need = len(own) if len(own) < 11 else min(13, -(-4 * len(own) // 5))
    for shift in range(-len(own) + 1, len(there)):
        first, last = max(0, -shift), min(len(own), len(there) - shift)
        best, a = (0, 0, 0), first
        total = 0
        for i in range(first, last):
            total += 1 if own[i] == there[i + shift] else -2
            if total < 0:
                total, a = 0, i + 1
            elif total > best[0]:
                best = (total, a, i + 1)
        equal = sum(own[i] == there[i + shift] for i in range(best[1], best[2]))
        if equal >= need and equal >= 0.8 * (best[2] - best[1]):
            return True
    return False


def test_overlaps_against_brute_force(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items, rows = [], []
    for n in (1, 2, 3, 4, 7, 10, 11, 12, 15, 18, 22, 25, 29, 30, 40, 60):
        for _ in range(3):
            item = rng.choice(vocabulary, n).tolist()
            items.append((len(items), " ".join(item)))
            for share in (0.0, 0.1, 0.15, 0.2, 0.25, 0.4):
                copy = list(item)
                for i in rng.choice(n, round(share * n), replace=False):
                    copy[i] = "other"
                around = rng.choice(vocabulary[:50], 20).tolist()
                rows.append((len(rows), " ".join(around + copy + around)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    long = {i for i, t in items if len(t.split()) >= decontam.SHORT_ITEM}
    want = {(d, i) for d, text in rows for i, item in items if naive_overlaps(text, item)}
    assert found <= want and {x for x in want - found if x[1] not in long} == set()
    assert len(found) >= 0.98 * len(want)
    some = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(docs, spark.createDataFrame(items, "item_id long, text string"), least_item=5).collect()}
    assert some == {x for x in found if len(items[x[1]][1].split()) >= 5}


def test_repeated_words_are_bounded_work():
    began = time.time()
    index = decontam.Index.of([1], ["a " * 1000])
    (found,) = index.overlaps(["a " * 4000])
    assert time.time() - began < 5 and {x[0] for x in found} == {1}
    rng = np.random.default_rng(1)
    a, b = np.unique(rng.integers(0, 9000, 3000)), np.unique(rng.integers(0, 2000, 900))
    assert decontam.distances(a, b).tolist() == sorted({int(x) - int(y) for x in a for y in b})


# --- sharding ------------------------------------------------------------------------------------------


def test_shards_are_even_and_gapless(odd, docs, empty):
    for df in (odd, docs):
        found = rows_of(sharding.assign(df, 8))
        counts = {}
        for r in found:
            counts.setdefault(r["shard"], []).append(r["slot"])
        sizes = [len(counts.get(s, [])) for s in range(8)]
        assert sum(sizes) == df.count() and max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    by_id = {r["doc_id"]: r for r in rows_of(sharding.assign(docs, 8))}
    for r in docs.collect():
        data = (r["text"] or "").encode()
        assert by_id[r["doc_id"]]["size"] == len(data) + 1 and by_id[r["doc_id"]]["text_crc32"] == zlib.crc32(data)
    assert sharding.assign(empty, 8).count() == 0


def test_few_keys_move_with_another_shard(docs):
    a = {r["doc_id"]: r["shard"] for r in rows_of(sharding.assign(docs, 8))}
    b = {r["doc_id"]: r["shard"] for r in rows_of(sharding.assign(docs, 9))}
    assert sum(a[k] != b[k] for k in a) < len(a) / 4


def test_hot_cells_are_ranked_in_lanes(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    df = docs.select("doc_id", "text").unionAll(docs.select(F.lit(7).cast("long"), "text")).unionAll(
        spark.range(300).select(F.lit(7).cast("long"), F.lit("same")))
    monkeypatch.setattr(sharding, "HOT_CELL", 20)
    found = rows_of(sharding.assign(df, 8))
    assert len(found) == df.count()
    counts = {}
    for r in found:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1


def test_dealing_by_hand():
    nodes = [(10, 0), (20, 1), (30, 0)]
    dealt = sharding.deal({5: 4, 15: 1, 40: 1}, nodes, 2)
    assert sorted(dealt) == [(5, 0, 3, 0, 0), (5, 3, 4, 1, 1), (15, 0, 1, 1, 0), (40, 0, 1, 1, 2)]


def test_written_shards(odd, spark, tmp_path):
    sharding.write(odd, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and {"shard", "slot", "text", "lang"} <= set(back.columns)


# --- licenses ----------------------------------------------------------------------------------------------


def naive_scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base = [], set()
    for phrase, label in licenses.BASE.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                base.add(label)
    found = [(r["tier"], m.start() - m.end(), r["id"], m.start(), m.end(), r["label"]) for r in rules() if r["keyword"] in low for m in re.finditer(r["regex"], low)]
    kept = [d for d in found if not any(e[:3] < d[:3] and e[3] <= d[3] and e[4] >= d[4] for e in found)]
    spans = sorted((d[3], d[4], d[5]) for d in kept)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[5] for d in kept})), spans


def test_license_scan(spark, odd, docs, empty):
    lines = ["Licensed under the Apache License, Version 2.0 (see LICENSE for details)", "SPDX-License-Identifier: GPL-2.0-or-later\nGNU General  Public\nLicense, version 2",
             "This is CC BY-SA 4.0; also cc by. CC  BY!", "All rights reserved. all-rights-reserved; Alle Rechte vorbehalten", "Tous droits réservés © 2020", "permit licensee mitlicense gplx",
             "the MIT License (MIT)\n" * 20, "ab\ufdd0cd x cc\ufdd0by cc by", "licensed under the\n" + " " * 40 + "apache license,\n//" + "*" * 30 + "\nversion 2.0",
             "mit license gpl v2 gplv3 " * 7 + "all rights reserved\x00\x01cc by", "\x00\x01 \x02", "©2020 copyright (c)2020 Open-Rail M"]
    extra = spark.createDataFrame([(1000 + i, t, "en", "s") for i, t in enumerate(lines)], DOCS)
    for df in (odd, extra, docs.select("doc_id", "text", "lang", "source")):
        for r in rows_of(licenses.scan(df.withColumn("labels", df.lang))):
            got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], sorted((s["start"], s["end"], s["label"]) for s in r["license_spans"]))
            assert got == naive_scan(r["text"]), r["text"][:80]
            assert 0 <= r["license_score"] <= 1
    assert licenses.scan(empty).count() == 0
    assert len(rules()) > 200


def test_license_scan_of_very_long_texts(spark):
    line = "Licensed under the MIT license. "
    for text, words in ((line * 32_000, 160_000), (" \x01" * 1_000_000, 0), ("cc " * 300_000 + "by", 300_001)):
        began = time.time()
        (r,) = rows_of(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")))
        assert time.time() - began < 60 and r["n_words"] == words
        if words == 160_000:
            assert len(r["license_spans"]) == 32_000 and r["labels"] == "mit"


def test_license_scan_keeps_other_columns(spark):
    names = ["low", "words", "spans", "_low", "n0", "first1", "last2", "_all", "labels"]
    df = spark.createDataFrame([(1, "cc by", *range(len(names)))], ["doc_id", "text", *names])
    (r,) = rows_of(licenses.scan(df))
    assert [r[c] for c in names[:-1]] == list(range(len(names) - 1)) and r["base_labels"] == "cc-by" and "cc-by" in r["labels"]


# --- classifiers -------------------------------------------------------------------------------------------


def test_quality_model(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(quality.training_rows(docs, labels))
    scored = quality.score(docs, model).join(labels, "doc_id")
    from choicelake.llm.common import doc_crc

    held = rows_of(scored.where(doc_crc() % 5 == 0).select("quality", "quality_predicted"))
    assert np.mean([r["quality"] == r["quality_predicted"] for r in held]) > 0.93
    for r in rows_of(quality.score(odd, model)):
        assert 0 <= r["quality_score"] <= 1 and r["quality_predicted"] == int(r["quality_score"] >= 0.3)
    assert quality.score(empty, model).count() == 0
    none = quality.fit(quality.training_rows(empty, labels))
    assert {r["quality_score"] for r in rows_of(quality.score(odd, none))} == {0.5}
    alone = quality.fit(quality.training_rows(docs, labels.where("quality = 1")))
    assert min(r["quality_score"] for r in rows_of(quality.score(odd, alone))) > 0.9


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(6, 3, replace=False)) for _ in range(40)]
    values = [rng.normal(size=3) for _ in rows]
    labels = np.where([r[0] + v[0] > 1 for r, v in zip(rows, values)], 1, -1)
    w = quality.dual_coordinate_descent(rows, values, labels, np.ones(40), 500)

    def loss(w):
        margins = np.array([v @ w[r] + w[quality.BUCKETS] for r, v in zip(rows, values)])
        return 0.5 * w @ w + np.maximum(0, 1 - labels * margins).sum()

    best = loss(w)
    used = [*range(6), quality.BUCKETS]
    for _ in range(300):
        moved = w.copy()
        moved[used] += rng.normal(size=7) * 0.01
        assert loss(moved) >= best - 1e-3


def test_features_of_a_batch_are_those_of_each():
    texts = ["The cat, the dog!", "", "a", "A B\n\nC 12 $$$ x"]
    owner, bucket = quality.features(texts)
    for i, t in enumerate(texts):
        assert set(bucket[owner == i]) == set(quality.features([t])[1])


def test_features_against_brute_force():
    texts = ["The cat, the dog!", "a 12 b", "A B\n\nC 12 $$$ x", "the cat sat on the mat", "éa ÉA 99..", "x"]

    def naive(text):
        tokens, out = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text), set()
        low = [t.lower() for t in tokens]

        def shape(t):
            if not (t[0].isalpha() or t[0].isdigit()):
                return t
            kind = lambda c: 3 if c.isdigit() else 1 if c.lower() == c else 2
            return kind(t[0]), kind(t[-1]), min(len(t), 3)

        shapes = list(map(shape, tokens))
        out |= {(1, t) for t in low} | {(2, *p) for p in zip(low, low[1:])}
        return out | {(3, *p) for p in zip(shapes, shapes[1:])} | {(4, *p) for p in zip(shapes, shapes[1:], shapes[2:])}

    owner, bucket = quality.features(texts)
    got, want = [set(bucket[owner == i].tolist()) for i in range(len(texts))], list(map(naive, texts))
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(want[i] & want[j]), (texts[i], texts[j])


def test_scores_against_brute_force():
    rng = np.random.default_rng(11)
    model = quality.Model(rng.normal(size=quality.BUCKETS), rng.normal(size=quality.BUCKETS), 0.3, 1.7, -0.2)
    texts = ["The cat, the dog!", "", "one two three 4"]
    for text, score in zip(texts, model.scores(texts)):
        buckets = quality.features([text])[1].tolist()
        norm = sum(model.ratios[b] ** 2 for b in buckets) ** 0.5
        margin = sum(model.weights[b] * model.ratios[b] for b in buckets) / max(norm, 1e-9) + 0.3
        assert abs(score - 1 / (1 + np.exp(-(1.7 * margin - 0.2)))) < 1e-12
    rows, labels = [np.array([1, 2]), np.array([2, 3]), np.array([5])], np.array([1, -1, 1])
    counts = {y: np.ones(quality.BUCKETS) for y in (1, -1)}
    for row, y in zip(rows, labels):
        for b in row:
            counts[y][b] += 1
    want = np.log((counts[1] / counts[1].sum()) / (counts[-1] / counts[-1].sum()))
    assert np.allclose(quality.log_count_ratios(rows, labels), want)


def test_training_features_are_bounded_in_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(quality.training_rows(docs, labels), most_bytes=200_000)
    held = rows_of(quality.score(docs, model).join(labels, "doc_id").select("quality", "quality_predicted"))
    assert np.mean([r["quality"] == r["quality_predicted"] for r in held]) > 0.8


def naive_language(rows):
    """Scores of a text per language by plain dictionaries of strings."""
    words_of = lambda text: re.findall(r"[^\W\d_]+", text.lower())
    langs = sorted({lang for _, lang in rows})
    words, grams = {x: Counter() for x in langs}, {(x, o): Counter() for x in langs for o in langid.ORDERS}
    cuts = lambda word, o: [p for i in range(len(word) + 3 - o) for p in [f" {word} "[i : i + o]] if o > 1 or p != " "]
    for text, lang in rows:
        for word in words_of(text):
            words[lang][word] += 1
            for o in langid.ORDERS:
                grams[lang, o].update(cuts(word, o))
    log = lambda counts, x: max(np.log10(counts[x] / counts.total()), langid.PENALTY) if counts[x] else langid.PENALTY

    def of_word(word):
        if sum(words[x][word] for x in langs) >= 2:
            return [log(words[x], word) for x in langs]
        for o in langid.ORDERS:
            known = [p for p in cuts(word, o) if any(grams[x, o][p] for x in langs)]
            if known:
                return [np.mean([log(grams[x, o], p) for p in known]) for x in langs]
        return [langid.PENALTY] * len(langs)

    return langs, lambda text: np.mean([of_word(w) for w in words_of(text)], axis=0)


def test_language_scores_against_brute_force(spark):
    rows = [("the thing that this was", "en"), ("the other thing was here", "en"), ("der die das nicht war", "de"), ("das andere war nicht hier", "de"),
            ("le chat était là et le chien", "fr"), ("un chat et un chien", "fr")]
    model = langid.fit(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string"))
    langs, score = naive_language(rows)
    assert model.languages == langs
    texts = ["the thing", "otherwise nichts", "chatte étaient", "zzz", "Das THE 12 le-chien", "q"]
    mean, _ = model.score(texts)
    for text, got in zip(texts, mean):
        assert np.allclose(got, score(text), atol=1e-6), text


def test_language_model(spark, odd, empty):
    docs = langid.folded(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    model = langid.fit(docs.where("not held_out"))
    held = rows_of(langid.identify(docs.where("held_out"), model).select("lang", "lang_pred"))
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    found = rows_of(langid.identify(odd, model))
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["lang_score"] <= 1
    assert langid.identify(empty, model).count() == 0
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in rows_of(langid.identify(odd, none))} == {"und"}


def test_unseen_words_back_off(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the thing that this", "en"), ("der die das nicht", "de")] * 5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mean, n = model.score(["thingamajig", "nichten", "THE Thing", "??"])
    assert n.tolist() == [1, 1, 2, 0]
    assert [model.languages[i] for i in mean[:3].argmax(1)] == ["en", "de", "en"]


# --- URLs ---------------------------------------------------------------------------------------------------


def naive_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def naive_rule(host, path):
    fits = [(len(h + p), f"{h}{p}", v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = ["", None, "no scheme", "http://EXAMPLE.com/en/x", "https://www.example.com/en/", "https://a.www.Example.com/en/?q", "x://net/es/1#f", "x://net", "x://dnet/fr/", "x://a.net/fr/y\nz",
           "http://h?x/y", "://", "a://b://c/d", "https://ünï.org/ä"]
    df = pages.unionByName(spark.createDataFrame([(10000 + i, u) for i, u in enumerate(odd)], "page_id long, url string"))
    found = rows_of(urls.judged(df.withColumn("score", df.page_id)))
    assert len(found) == df.count()
    for r in found:
        host, path = naive_host_path(r["url"])
        rule, verdict = naive_rule(host, path)
        assert (r["url_host"], r["url_path"], r["url_rule"]) == (host, path, rule), r["url"]
        assert r["url_verdict"] == verdict if rule else r["url_verdict"] in ("allow", "block")
    assert urls.judged(df.limit(0)).count() == 0


def test_url_ratios_against_a_plain_recursion(spark):
    taught = [("abab", True), ("abba", True), ("bbbc", False), ("xyz", None)]
    df = spark.createDataFrame(taught, "url string, accepted boolean")
    code = lambda c: urls.ALPHABET.find(c) + 1
    seqs = {c: [[0, 0, 0, *map(code, u)] for u, a in taught if a is c] for c in (True, False)}

    def p(c, gram):
        if not gram:
            return 1 / urls.SYMBOLS
        context, low = gram[:-1], p(c, gram[1:])
        seen = [s[i] for s in seqs[c] for i in range(3, len(s)) if s[i - len(context) : i] == context]
        if not seen:
            return low
        return (seen.count(gram[-1]) + len(set(seen)) * low) / (len(seen) + len(set(seen)))

    got = {r["code"]: r["ratio"] for r in urls.ratios(df).collect()}
    for url, _ in taught:
        s = [0, 0, 0, *map(code, url)]
        for i in range(3, len(s)):
            gram = s[i - 3 : i + 1]
            number = sum(x * urls.SYMBOLS ** (3 - k) for k, x in enumerate(gram))
            assert got[number] == pytest.approx(np.log(p(True, gram) / p(False, gram)))


# --- nearest neighbours ----------------------------------------------------------------------------------------


def naive_nearest(rows, queries, k):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    out = {}
    for q, v in queries:
        if ok(v):
            scored = sorted((-sum(map(float.__mul__, map(float, v), map(float, w))), i) for i, w in rows if ok(w) and i != q and len(w) == len(v))
            out[q] = [i for _, i in scored[:k]]
    return out


def test_search_recall_and_ties(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r[0], r[1]) for r in table.collect()]
    queries = [r for r in rows if r[0] % 20 == 0]
    got = {}
    for r in rows_of(ann.nearest(table, table.where("vec_id % 20 = 0"))):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    vectors = np.array([v for _, v in rows], float)
    scores = np.array([v for _, v in queries], float) @ vectors.T
    ids, hits = np.array([i for i, _ in rows]), 0
    for (q, _), s in zip(queries, scores):
        s[ids == q] = -np.inf
        hits += len({i for _, i in got[q]} & set(ids[np.argsort(-s)[:20]]))
    assert hits / (20 * len(queries)) >= 0.9


def test_search_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.5]) for i in range(50)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [float("nan"), 1.0, 1.0]), (203, [1.0, None, 1.0]), (204, [float("inf"), 0.0, 0.0]), (205, [1.0, 2.0]), (100, [1.0, 0.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 20 = 0 or vec_id > 199")
    got = {}
    for r in rows_of(ann.nearest(df, queries).orderBy("query_id", "rank")):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    unique = list({(i, None if v is None else tuple(v)) for i, v in rows})
    want = naive_nearest(unique, [u for u in unique if u[0] % 20 == 0 or u[0] > 199], 20)
    assert got.keys() == {k for k, v in want.items() if v}
    for q, best in got.items():
        assert len(best) == len(want[q])
        assert len(set(best) & set(want[q])) >= 0.9 * len(best)
        if want[q][0] >= 100:  # many equal vectors are nearest: ties go to the smaller ids
            assert best == want[q]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


# --- the pipeline ------------------------------------------------------------------------------------------------


def test_pipeline_against_its_stages_by_hand(spark, docs):
    import corpus_pipeline as pipeline

    frames, current = {}, docs
    for name, stage in pipeline.STAGES:
        current = stage(spark, current, SF)
        if name != "packing":
            assert current.columns == docs.columns
        current = current.cache()
        frames[name] = current
    rejected = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in frames["quality"].collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([labels[d] == 0 for d in rejected if d in labels] or [1]) > 0.8
    before, after = frames["language"].collect(), {r["doc_id"] for r in frames["near_duplicates"].collect()}
    sets = [set(simhash.shingle_hashes(simhash.word_bytes(r["text"]), 5).tolist()) for r in before]
    label = components(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) > 0)
    kept = {}
    for r, g in zip(before, label):
        kept.setdefault(g, []).append(r["doc_id"] in after)
    assert all(any(v) for v in kept.values())
    assert sum(sum(v) > 1 for v in kept.values()) <= 0.02 * len(kept)
    leaks = {r["doc_id"] for r in decontam.overlaps(frames["near_duplicates"], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in frames["decontamination"].collect()} == after - leaks
    packed = frames["packing"].collect()
    assert {r["doc_id"] for r in packed} == after - leaks
    ran = {r["doc_id"] for r in pipeline.run(spark, SF).collect()}
    assert ran == after - leaks


def test_pipeline_stages_survive_odd_documents(spark, odd):
    import corpus_pipeline as pipeline

    current = odd.withColumn("n_chars", odd.doc_id)
    for _, stage in pipeline.STAGES[1:]:
        current = stage(spark, current, SF)
    assert current.count() > 0
    scored = pipeline.STAGES[0][1](spark, odd, SF)
    assert scored.columns == odd.columns and scored.count() <= odd.count()
    packed = pipeline.STAGES[4][1](spark, odd, SF)
    assert packed.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    empty = odd.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_stages_keep_columns_of_clashing_names(spark):
    import corpus_pipeline as pipeline
    from pyspark.sql import functions as F

    names = ["quality_score", "quality_predicted", "lang_pred", "lang_score", "found", "exact", "_exact", "kept_id", "overlaps", "_overlaps", "hash", "node", "group"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    before = {r["doc_id"]: r for r in docs.collect()}
    for _, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert 0 < len(rows) <= len(before) and all(r == before[r["doc_id"]] for r in rows)


def test_pipeline_stages_bound_what_workers_get(spark, docs):
    import corpus_pipeline as pipeline
    import pandas as pd
    from pyspark.sql import functions as F

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [int(batch["text"].str.len().sum())]})

    limit, big = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    largest = lambda: max(r["n"] for r in big.mapInPandas(sizes, "n long").collect())
    before = spark.conf.get(limit)
    try:
        for _, stage in pipeline.STAGES:
            spark.conf.set(limit, "64m")
            stage(spark, docs, SF)
            assert largest() <= common.BATCH_BYTES + 2000  # the row that reaches the limit is the last
        spark.conf.set(limit, "64k")  # a smaller limit of the session's stays
        stage(spark, docs, SF)
        assert largest() <= (1 << 16) + 2000
    finally:
        spark.conf.set(limit, before)


def test_workers_keep_no_encoder_for_other_stages():
    packing.encoder(Q.tokenizer_path())
    assert packing.encoder.cache_info().currsize == 1
    common.release()
    assert packing.encoder.cache_info().currsize == 0


def test_tables_of_the_driver_need_no_worker(spark, docs, monkeypatch):
    """A table made from a list or a pandas frame is an RDD, for which executors start a second Python daemon."""
    made = []
    monkeypatch.setattr(type(spark), "createDataFrame", (lambda f: lambda *a, **b: made.append(f(*a, **b)) or made[-1])(type(spark).createDataFrame))
    packing.pack(docs, Q.tokenizer_path())
    packing.pack(docs.limit(0), Q.tokenizer_path())
    neardup.deduplicated(docs)
    assert len(made) >= 3
    assert not any("ExistingRDD" in df._jdf.queryExecution().executedPlan().toString() for df in made)


def test_every_operator_has_a_query():
    names = sorted(Q.queries(), key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))
    assert json.dumps(sorted(Q.oracle_sql())) is not None
