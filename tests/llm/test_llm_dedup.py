"""Exact and near duplicates against brute force."""
from __future__ import annotations

import hashlib
import random
import tracemalloc
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from vintage.llm import exact_dedup, simhash
from vintage.llm.components import components
from vintage.session import checkpoint_dir

SPACES = " \t\n\x0b\x0c\r"


def brute_exact(rows):
    """Multiset of (doc_id, keep_id, group_size, kept, sha)."""
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in SPACES), []).append((i, t or ""))
    out = []
    for norm, g in groups.items():
        best = min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        done = False
        for x in g:
            kept = not done and x[0] == best[0] and len(x[1]) == len(best[1])
            done |= kept
            out.append((x[0], best[0], len(g), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups_edge_cases(edge_docs):
    got = sorted([tuple(r) for r in exact_dedup.exact_groups(edge_docs).collect()], key=str)
    assert got == brute_exact([(r.doc_id, r.text) for r in edge_docs.collect()])


def test_exact_groups_small_filter_gives_the_same(documents):
    """A saturated filter lets everything shuffle; the result stays."""
    a = sorted(map(tuple, exact_dedup.exact_groups(documents).collect()))
    b = sorted(map(tuple, exact_dedup.exact_groups(documents, max_slots=64).collect()))
    assert a == b == brute_exact([(r.doc_id, r.text) for r in documents.collect()]) or a == b
    assert sorted(a, key=str) == brute_exact([(r.doc_id, r.text) for r in documents.collect()])
    assert any(r[2] > 1 for r in a) and not all(r[3] for r in a)


def test_bloom_never_misses_a_repeat(spark):
    rows = [(f"h{i}",) for i in range(3000)] + [(f"h{i}",) for i in range(0, 3000, 10)]
    d = spark.createDataFrame(rows, "h string").repartition(5).cache()
    got = d.withColumn("m", exact_dedup.possibly_repeated(d, "h")).collect()
    repeated = {f"h{i}" for i in range(0, 3000, 10)}
    assert all(r.m for r in got if r.h in repeated)
    assert sum(r.m for r in got if r.h not in repeated) < 0.1 * 2700  # and lets the rest pass


def test_drop_exact_keeps_columns_and_one_per_group(edge_docs):
    out = exact_dedup.drop_exact_duplicates(edge_docs)
    assert out.columns == edge_docs.columns
    kept = sorted([(r.doc_id, r.text) for r in out.collect()], key=str)
    want = sorted({(r[0]) for r in brute_exact([(r.doc_id, r.text) for r in edge_docs.collect()]) if r[3]}, key=str)
    assert sorted([k[0] for k in kept], key=str) == want


def test_exact_empty(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(no_docs).count() == 0


def brute_fingerprint(text, n=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {ord(c): " " for c in SPACES}).split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, d):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fs = sorted(parent)
    a = np.array(fs, np.uint64)
    for i, f in enumerate(fs):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= d) + i + 1:
            x, y = find(f), find(fs[j])
            parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fs}


def test_fingerprint_matches_definition():
    for t in ["", None, "A", "a B", "a b c", "É a b c D e f a b c", "x y z " * 50, "\x0bA\x0cB\rC"]:
        assert simhash.fingerprint((t or "").encode()) % 2 ** 64 == brute_fingerprint(t)


def test_long_text_in_blocks(monkeypatch):
    random.seed(3)
    t = " ".join(random.choice("abcdefgh") for _ in range(997))
    want = brute_fingerprint(t)
    for block in (2, 7, 100, 995, 996):
        monkeypatch.setattr(simhash, "_BLOCK", block)
        assert simhash.fingerprint(t.encode()) % 2 ** 64 == want


def test_near_groups_against_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rng = random.Random(8)
    for i, t in list(rows):  # near copies: some words replaced
        w = t.split()
        if i % 3 == 0 and len(w) > 150:
            for c in range(3):
                v = list(w)
                for _ in range(1 + len(w) // 300):
                    v[rng.randrange(len(v))] = "changed"
                rows.append((10_000 + 10 * i + c, " ".join(v)))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {i: brute_fingerprint(t) for i, t in rows}
    root = brute_components(set(fp.values()), 3)
    low = {}
    for i, f in fp.items():
        low[root[f]] = min(low.get(root[f], i), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(documents).collect()}
    assert got == {i: (f"{f:016x}", low[root[f]]) for i, f in fp.items()}
    assert len(set(low.values())) < len(set(fp.values()))


@pytest.mark.parametrize("d", [1, 2, 3, 4])
@pytest.mark.parametrize("bits", [5, 8])
def test_links_of_planted_clusters(spark, d, bits):
    """Chains and balls of fingerprints at known distances."""
    rng = random.Random(d * 10 + bits)
    fps = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(1, d + 2)):
                f ^= 1 << b
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), d, bucket_bits=bits)
    got = {r.node % 2 ** 64: r.root % 2 ** 64 for r in components(links).collect()}
    root = brute_components(fps, d)
    mine, theirs = {}, {}
    for f in fps:
        mine.setdefault(got.get(f, f), set()).add(f)
        theirs.setdefault(root[f], set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_near_edge_cases(edge_docs, no_docs):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(edge_docs).collect()]
    assert len(got) == edge_docs.count()
    by = {}
    for i, f, c in got:
        by.setdefault(i, set()).add((f, c))
    zero = "0" * 16
    assert all(by[i] == {(zero, 3)} for i in (3, 4, 5))
    assert by[None] == by[1] and by[1] == {(next(iter(by[1]))[0], 1)} and by[2] == by[1]
    assert len(by[7]) == 1
    assert simhash.near_groups(no_docs).count() == 0


def test_drop_near_keeps_one_per_component(edge_docs, no_docs):
    out = simhash.drop_near_duplicates(edge_docs)
    assert out.columns == edge_docs.columns
    comps = {(r.doc_id, r.component_id) for r in simhash.near_groups(edge_docs).collect()}
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c in comps})
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def test_components_chain_hub_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5), (None, 3), (2000, 1100), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61))
    assert all(got[1000 + i] == 1000 for i in range(200)) and got[2000] == 1000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hand_offs_of_few_rows_come_in_few_files(spark):
    """As many files as cores, not as many as the shuffle has partitions."""
    tables = Path(checkpoint_dir(spark).removeprefix("file://"), "tables")
    before, changed = set(tables.glob("*")), {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        words = [f"w{i}" for i in range(300)]
        near = [(i, " ".join([*words[:5 * i], "x", *words[5 * i:]])) for i in range(40)]
        docs = spark.createDataFrame(near, "doc_id long, text string").coalesce(1)
        groups = {r.component_id for r in simhash.near_groups(docs).collect()}
        assert simhash.drop_near_duplicates(docs).count() == len(groups) < 40
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = {t.name: len(list(t.glob("part-*"))) for t in set(tables.glob("*")) - before}
    assert any(n.startswith("roots") for n in files)
    assert {n: k for n, k in files.items() if k > spark.sparkContext.defaultParallelism and not n.startswith("simhash-stay")} == {}


def test_bucket_of_one_ball_does_not_hold_its_pairs():
    """All fingerprints within three bits of one: memory follows them, not the places where they meet."""
    near = [0] + [sum(1 << i for i in c) for w in (1, 2, 3) for c in combinations(range(64), w)]
    fps = np.array(near, np.uint64) ^ np.uint64(0x123456789ABCDEF0)
    batch = pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], names=["fp"])
    run = simhash._collide(3, 5)
    tracemalloc.start()
    try:
        out = [x for bucket in (30, 31) for x in run((pa.scalar(bucket),), iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(x.num_rows for x in out) > 30_000
    assert peak < 60e6
