"""WARC, mixing, top-k, BPE, chat formatting and the pipeline."""
from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm.conftest import SF2, duck
from pyspark.sql import functions as F

from vintage.llm import bpe, chat, mixing, topk, warc
from vintage.llm.queries import ORACLE, QUERIES, tokenizer_path

# --- SQL oracles -----------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF2)
    want = duck().sql(ORACLE[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall())))


# --- WARC ------------------------------------------------------------------

PAGES = [(1, "http://a/1", "<p>é</p>", "x"), (2, "http://a/2", "<p>é</p>", "x"), (5, None, "", "x"), (3, "http://b\r\nX: 1", None, "x"),
         (4, "http://c", "big" * 100_000, "x"), (None, "http://d", "<p>é</p>", "x"), (6, "u", "WARC/1.1\r\n\r\n\r\nWARC-Type: x", "x"),
         (7, "r", "same", "x"), (7, "r", "same", "x"), (None, "n", "alone", "x")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, payload string").cache()


@pytest.mark.parametrize("smallest", [0, 6])
def test_warc_round_trip(pages, smallest):
    got = sorted([tuple(r) for r in warc.round_trip(pages, smallest).collect()], key=str)
    want = []
    for i, _, html, _ in PAGES:
        raw = (html or "").encode()
        ids = [j for j, _, h, _ in PAGES if (h or "") == (html or "") and j is not None]
        keep = max(ids, default=None) if len(raw) >= smallest else i
        revisit = keep is not None and i != keep
        want.append((i, len(raw), warc.sha1_base32(raw), "revisit" if revisit else "response", keep if revisit else None))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_predicates_and_payloads(spark, pages, tmp_path, compression):
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    warc.page_records(pages).repartition(3).write.format("warc").option("compression", compression).option(
        "max_file_bytes", 2000).mode("append").save(path)
    back = spark.read.format("warc").load(path)
    assert back.count() == len(PAGES)
    payloads = {r.record_id: bytes(r.payload) for r in back.filter("record_type = 'response'").collect()}
    assert payloads["urn:page:6"] == PAGES[6][2].encode() and payloads["urn:page:4"] == b"big" * 100_000
    revisits = back.filter("record_type = 'revisit'")
    assert {r.record_id for r in revisits.collect()} == {"urn:page:1", "urn:page:3"} | {
        r.record_id for r in back.collect() if r.record_id.startswith("urn:page-of:") and r.record_type == "revisit"}
    assert all(r.payload is None for r in revisits.collect())
    assert back.filter(F.col("target_uri").startswith("http://a/")).count() == 2
    assert back.filter(F.col("record_id").isin("urn:page:1", "urn:page:2", "none")).count() == 2
    assert back.filter("payload_bytes > 1000").count() == 1


def test_warc_reader_skips_by_seeking(spark, pages, tmp_path):
    """Without the payload in the schema, uncompressed payload bytes are not read."""
    import io

    raw = b"".join(warc.record(f"urn:page:{i}", "response", "u", b"x" * 50_000) for i in range(4))

    class Counting(io.BytesIO):
        read_bytes = 0

        def readinto(self, b):
            n = super().readinto(b)
            Counting.read_bytes += n
            return n

    f = io.BufferedReader(Counting(raw), 512)
    rows = list(warc.read_records(f, {"record_id"}, []))
    assert len(rows) == 4 and Counting.read_bytes < 10_000
    rows = list(warc.read_records(io.BytesIO(raw), {"record_id", "payload"}, [("record_id", "in", ("urn:page:2",))]))
    assert [r["record_id"] for r in rows] == ["urn:page:2"] and rows[0]["payload"] == b"x" * 50_000


def test_warc_foreign_records():
    import io

    raw = (b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\n"
           b"Content-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\n"
           b"X-Folded: a\r\n b\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: 21\r\n\r\n"
           b"HTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n")
    rows = list(warc.read_records(io.BytesIO(raw), {"record_id", "record_type", "payload", "payload_bytes"}, []))
    assert [(r["record_type"], r["payload"], r["payload_bytes"]) for r in rows] == [("warcinfo", b"hello", 5), ("response", b"hi", 2)]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"junk\r\n\r\n"), {"record_id"}, []))


def test_warc_empty(pages):
    assert warc.round_trip(pages.limit(0)).count() == 0


# --- mixing ----------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """The excess is reshared until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        even = left / sum(w[s] for s in free)
        over = [s for s in free if even * w[s] >= most * sizes[s]]
        if not over:
            return target | {s: even * w[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_targets_against_resharing(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = {rng.choice(["é", "z", "A", "b", "Z"]) + str(i): rng.randint(0, 10_000) for i in range(9)} | {None: 300}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert set(got) == set(want) and all(got[s] == pytest.approx(want[s]) for s in want)


def test_subset_sum_is_as_close_as_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 5)
        lengths = np.array(rng.sample(range(1, 40), n))
        avail = np.array([rng.randint(0, 3) for _ in range(n)])
        goal = rng.randint(0, 80)
        sums = {0}
        for l, a in zip(lengths, avail):
            sums = {s + k * int(l) for s in sums for k in range(a + 1)}
        take = mixing.subset_sum(lengths, avail, goal)
        assert (take <= avail).all() and (take >= 0).all()
        assert abs(int((take * lengths).sum()) - goal) == min(abs(s - goal) for s in sums)


def test_mixture_near_targets_and_repeatable(spark, documents):
    a = mixing.mixture(documents).collect()
    size = {r.doc_id: len([w for w in r.text.translate({ord(c): " " for c in " \t\n\x0b\x0c\r"}).split(" ") if w])
            for r in documents.collect()}
    source = {r.doc_id: r.source for r in documents.collect()}
    assert {r.doc_id: r.size for r in a} == size
    total, taken = {}, {}
    for r in a:
        total[source[r.doc_id]] = total.get(source[r.doc_id], 0) + r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = brute_targets(total)
    for r in a:
        assert r.source_size == total[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
    assert all(abs(taken[s] - want[s]) <= 5 for s in want)
    b = mixing.mixture(documents.repartition(5)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_mix_repeats_rows(edge_docs, no_docs, documents):
    out = mixing.mix(documents)
    assert out.columns == documents.columns
    words = out.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == sum(r.taken for r in mixing.mixture(documents).collect())
    got = mixing.mixture(edge_docs).collect()
    assert len(got) == edge_docs.count() and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(edge_docs).columns == edge_docs.columns
    assert mixing.mix(edge_docs).select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r.taken for r in got)
    assert mixing.mixture(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


# --- top-k -----------------------------------------------------------------


def brute_top(rows, k):
    """(query, rank, id, score) from (id, scaled vector) rows; every row is a candidate and every row of a query id asks."""
    rows = [(i, [int(a) for a in v]) for i, v in rows]
    out = []
    for i in {r[0] for r in rows if r[0] % 20 == 0}:
        s = sorted((-sum(a * b for a, b in zip(v, w)), j) for q, v in rows if q == i for j, w in rows if j != i and len(w) == len(v))
        out += [(i, n + 1, j, max(-2 ** 63, min(2 ** 63 - 1, -x))) for n, (x, j) in enumerate(s[:k])]
    return sorted(out)


def test_topk_repeated_rows_equal_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(8)
    x = [(int(i) % 70, [float(a) for a in rng.integers(-3, 4, size=4) / 8]) for i in range(90)]
    x += x[:25] + [x[40]] * 30
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    sql = con.sql(ORACLE["op8_exact_topk"])
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, query_block=2, candidate_block=20).select(*sql.columns).collect()
    assert sorted(map(tuple, got)) == sorted(sql.fetchall())


def test_topk_drops_pairs_of_cells_before_the_search(spark, monkeypatch):
    """Clustered vectors: most pairs of cells never meet; a few huge rows change nothing for the others."""
    rng = np.random.default_rng(9)
    centres = 20 * rng.normal(size=(12, 8))
    x = [(int(i), [float(a) for a in np.float32(centres[i % 12] + 0.05 * rng.normal(size=8))]) for i in range(1200)]
    x += [(2001, [1e20] + [0.0] * 7), (2020, [3e25] * 8), (2041, [-1e30] * 8)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    asked, real = [], topk._searched
    monkeypatch.setattr(topk, "_searched", lambda v, pairs, k: (asked.append(pairs.count()), real(v, pairs, k))[1])
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, candidate_block=100, query_block=30).collect()))
    assert got == brute_top([(i, np.floor(64 * np.array(v))) for i, v in x], 5)
    cells = df.count() // 100
    assert sum(asked) < cells * cells * 0.7


def test_topk_blocks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    x = [(int(i), [float(a) for a in centres[i % 6] + 0.05 * rng.normal(size=8)]) for i in range(900)]
    x += [(i, [0.5] * 8) for i in range(900, 1100)]  # ties
    df = spark.createDataFrame(x, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, query_block=16, candidate_block=300).collect()))
    scaled = [(i, np.floor(64 * np.array(v, np.float32).astype(float))) for i, v in x]
    assert got == brute_top(scaled, 7)


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(5)
    centres = 100 * rng.normal(size=(8, 16))
    x = np.floor(np.concatenate([c + rng.normal(size=(100, 16)) for c in centres]))

    def check(node):
        d = np.sqrt(((x[node.points] - node.centre) ** 2).sum(axis=1))
        assert d.max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
            for c in node.children:
                check(c)

    tree = topk.cover_tree(x, np.arange(len(x)))
    assert tree.children
    check(tree)
    s = topk.Search(x[::2], np.arange(0, 800, 2), x, np.arange(800), 5)
    got = sorted(s.run())
    assert s.pruned > 0
    want = []
    for i, q in enumerate(range(0, 800, 2)):
        score = x[q] @ x.T
        by = [j for j in np.lexsort((np.arange(800), -score)) if j != q][:5]
        want += [(i, int(j), int(score[j])) for j in by]
    assert got == sorted(want)


def test_topk_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []),
            (20, [1.0, 2.0, 3.0]), (7, [2.0, 2.0, 2.0]), (None, [9.0, 9.0]), (1, [0.5, 0.5]), (40, [-1.0, 0.25]), (8, [1e30, 1e30])]
    df = spark.createDataFrame([(i, v, "a", 1, False) for i, v in rows],
                               "vec_id long, embedding array<double>, id string, v int, is_query boolean")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect()))
    ok = [(i, np.floor(64 * np.array(v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    assert got == brute_top(ok, 3)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# --- BPE -------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(tokenizer_path())


def same(library, codec, text):
    want = library.encode(text, add_special_tokens=False)
    got = codec.encode(text)
    return got.tolist() == want.ids and codec.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_random_texts(library, codec):
    rng = random.Random(11)
    alphabet = "abcdeéèßÉÀ 1234٣½²Ⅷ\n\t  ́̀<|>ΣσςΑİıǅ中文かな한글🙂‍﻿᠎\x85\x1c'str'llve#$%-_=ǰﬁ\x00"
    for k in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert same(library, codec, t + "<|startoftext|>" * (k % 5 == 0) + t[:3] + "<|endoftext|>" * (k % 7 == 0)), repr(t)
        t = "".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(12))
        assert same(library, codec, t), repr(t)


def test_bpe_query_equals_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op9_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        e = library.encode(docs[r.doc_id], add_special_tokens=False)
        assert r.n_tokens == len(e.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def naive_merge(m, ids):
    """Always the lowest rank, leftmost."""
    ids = list(ids)
    while True:
        found = [(m.pair[k], i) for i in range(len(ids) - 1) if (k := ids[i] << 20 | ids[i + 1]) in m.pair]
        if not found:
            return ids
        new, i = min(found)
        ids[i:i + 2] = [new & 0xFFFFF]


def test_bpe_stream_equals_whole(codec):
    rng = random.Random(7)
    m = codec.merger
    for a in ("ab", "aeiou", "the", "abcdefghijklmnopqrstuvwxyz", "aaaaaaab", "ation"):
        for n in (1, 2, 160, 900, 1500):
            p = "".join(rng.choice(a) for _ in range(n))
            ids = [m.vocab[c] for c in [*p[:-1], p[-1] + "</w>"]]
            assert list(m.stream(ids, step=rng.randint(1, 40))) == m.merge(list(ids)) == naive_merge(m, ids)


def test_natural_pieces_leave_the_window_before_their_end(codec):
    """A run of text without spaces goes through the window: its first tokens come long before its last symbol is read."""
    m = codec.merger
    piece = "统计数据显示经济增长速度放缓" * 30
    raw = piece.encode()
    symbols = [codec.byte_id[b] for b in raw[:-1]] + [codec.last_id[raw[-1]]]
    read = []

    def fed():
        for x in symbols:
            read.append(x)
            yield x
    stream = m.stream(fed())
    first = next(stream)
    assert len(read) < 2 * m.lookahead + 100 < len(symbols) / 2
    assert [first, *stream] == m.merge(list(symbols))


def test_bpe_memory_does_not_grow_with_the_text(library):
    import tracemalloc

    want = {"n_tokens", "ids_sha256", "decoded_sha256"}
    line = "the quick brown fox <|endoftext|> jumps, over 13 lazy dogs! 统计数据 "
    c = bpe.Codec(tokenizer_path())
    c.run(line * 10, want)
    peaks = []
    for n in (20_000, 80_000):
        text = line * n
        tracemalloc.start()
        got = c.run(text, want)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        if n == 20_000:
            ids = library.encode(text, add_special_tokens=False).ids
            assert got["n_tokens"] == len(ids) and got["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert max(peaks) < 8 << 20 and peaks[1] < 1.5 * peaks[0]


def test_lookahead_settles_tokens(codec):
    """Tokens further than the lookahead before the end stay, whatever follows."""
    rng = random.Random(9)
    m = codec.merger
    assert 0 < m.lookahead < 1000
    for _ in range(60):
        p = "".join(rng.choice("etaoinshrdlu") for _ in range(m.lookahead + rng.randint(1, 200)))
        settled = len(p) - m.lookahead
        more = p + "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 60)))
        a, b = (m.merge([m.vocab[c] for c in t]) for t in (p, more))
        at = 0
        for x, y in zip(a, b):
            at += m.length[x]
            if at > settled:
                break
            assert x == y


def test_small_lookahead_by_hand():
    # b|c may take b away from ab; a|b has the higher rank: one symbol back, then a
    merges = [("b", "c"), ("a", "b")]
    assert bpe.lookahead(merges, {"a": 1, "b": 1, "c": 1, "ab": 2, "bc": 2}) == 2
    assert bpe.lookahead([("ab", "c"), ("a", "b")], {"a": 1, "b": 1, "c": 1, "ab": 2, "abc": 3}) is None


def test_decoder_keeps_unfinished_characters():
    letters = bpe.byte_alphabet()
    raw = "é🙂a".encode()
    d = bpe.Decoder({i: letters[b] for i, b in enumerate(raw)}, byte_level=True)
    out = [d.feed([i]) for i in range(len(raw))]
    assert out == ["", "é", "", "", "", "🙂", "a"] and d.finish() == ""
    d.reset()
    assert d.feed([0]) == "" and d.finish() == "�"


def test_bpe_edge_cases(edge_docs, no_docs, library):
    got = {r.doc_id: r for r in bpe.token_digests(edge_docs, tokenizer_path()).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    for i in (3, 4, 5):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (0, empty, empty)
    for r in edge_docs.collect():
        e = library.encode(r.text or "", add_special_tokens=False)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest() or r.doc_id == 7
    assert bpe.token_digests(no_docs, tokenizer_path()).count() == 0
    e = edge_docs.filter("doc_id = 1").select(bpe.encode_column(F.col("text"), tokenizer_path(), ("ids", "decoded")).alias("e"))
    r = e.select("e.ids", "e.decoded", bpe.decode_column(F.col("e.ids"), tokenizer_path()).alias("back")).first()
    assert r.decoded == r.back == library.decode(r.ids, skip_special_tokens=False)


# --- chat ------------------------------------------------------------------

TURNS = [  # three snapshots, a fork, copies, gaps in the turn numbers, an empty turn
    *[(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(2)],
    *[(2, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(4)],
    *[(3, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(6)],
    (4, 0, "user", "m0"), (4, 1, "assistant", "other"),
    (5, 0, "user", "m0"), (5, 1, "assistant", "other"),
    *[(6, 10 * t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(5)],
    (7, 0, None, None), (7, 1, "user", ""), (8, 0, "", ""), (None, 0, "user", "solo"), (9, None, "system", "s"), (9, 0, "user", "q"),
    (10, 0, "user", "x"), (10, 0, "user", "x"), (11, 0, "user", "x"),
]


def brute_chat(turns):
    conv = {}
    for c, t, r, x in turns:
        conv.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    seqs = {c: tuple(v[2:] for v in sorted(g)) for c, g in conv.items()}
    whole = {}
    for c, s in seqs.items():
        whole.setdefault(s, []).append(c)
    out = []
    for s, cs in whole.items():
        if not any(len(o) > len(s) and o[:len(s)] == s for o in whole):
            first = min((c for c in cs if c is not None), default=None)
            out.append((first, len(s), len(cs), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in s)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 2, 256])
def test_chat_snapshots(spark, block):
    df = spark.createDataFrame([(*t, 1, "z") for t in TURNS], "conv_id long, turn long, role string, text string, n int, c string")
    p = {(r.c, r.pos): (r.p1, r.p2) for r in chat.prefix_hashes(df, block=block).collect()}
    assert p[(1, 2)] == p[(2, 2)] == p[(3, 2)] == p[(6, 2)] and p[(3, 4)] == p[(6, 4)]
    assert len(set(p.values())) < len(p) and p[(4, 2)] != p[(1, 2)]
    got = sorted([tuple(r) for r in chat.format_conversations(df).collect()], key=str)
    assert got == brute_chat(TURNS)


def test_chat_against_brute_force_random(spark):
    rng = random.Random(6)
    turns = []
    for c in range(120):
        n = rng.randint(1, 6)
        turns += [(c, t, "user", rng.choice("ab")) for t in range(n)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert sorted([tuple(r) for r in chat.format_conversations(df).collect()], key=str) == brute_chat(turns)


def test_chat_is_native(spark):
    plan = QUERIES["op10_chat_formatting"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_chat_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- pipeline --------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(900_000, "", "en", "src0", 0), (900_001, None, None, None, None), (900_002, "Ж" * 300 + " ъыэ" * 90, None, "src1", 5)],
                                  docs.schema)
    copy = docs.limit(20).select((F.col("doc_id") + 500_000).alias("doc_id"), "text", "lang", "source", "n_chars")
    docs = docs.unionByName(extra).unionByName(copy)
    seen, stages = {}, docs
    for name, stage in cp.STAGES[:-1]:
        before = stages
        stages = stage(spark, stages, sf).cache()
        seen[name] = {r.doc_id for r in stages.collect()}
        assert stages.columns == docs.columns
        assert seen[name] <= {r.doc_id for r in before.collect()}
    assert not {900_000, 900_001, 900_002} & seen["language_id"]
    assert {r.doc_id for r in copy.collect()} <= seen["language_id"] and not {r.doc_id for r in copy.collect()} & seen["exact_dedup"]
    out = cp.STAGES[-1][1](spark, stages, sf).collect()
    assert len(out) == stages.count() and all(len(r.ids) == r.n_tokens for r in out)


def test_pipeline_on_edge_rows(spark, edge_docs, library):
    """Repeated rows, long texts, NULLs and clashing names together, each stage against brute force on its own input."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, kind in edge_docs.dtypes:
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit("7").cast(kind))
    long_text = docs.filter("lang = 'en' and length(text) > 500").orderBy("doc_id").limit(1).select(
        (F.col("doc_id") + 700_000).alias("doc_id"), F.repeat(F.concat("text", F.lit(" ")), 400).alias("text"),
        *[c for c in docs.columns if c not in ("doc_id", "text")])
    twice = docs.orderBy("doc_id").limit(15)
    docs = docs.unionByName(edge_docs).unionByName(long_text).unionByName(twice)
    got = {"": [r.asDict() for r in docs.collect()]}
    assert max(len(r["text"] or "") for r in got[""]) > 200_000
    stages, before = docs, ""
    for name, stage in cp.STAGES[:-1]:
        stages = stage(spark, stages, sf).cache()
        assert stages.columns == docs.columns
        got[name] = [r.asDict() for r in stages.collect()]
        given = Counter(map(str, got[before]))
        if name != "mixing":  # filters: rows of the input, none more often than it came
            assert all(n <= given[r] for r, n in Counter(map(str, got[name])).items())
        else:
            assert set(map(str, got[name])) <= set(given)
        before = name

    def bare(r):
        return "".join(c for c in r["text"] or "" if c not in " \t\n\x0b\x0c\r")

    names = [n for n, _ in cp.STAGES]
    language, exact, near, mixed = (got[n] for n in names[:4])
    assert not [r for r in language if not any(c.isalpha() for c in r["text"] or "")]
    assert {r["doc_id"] for r in long_text.collect()} <= {r["doc_id"] for r in language}
    best = {}
    for r in language:
        rank = (-len(r["text"]), r["doc_id"] is None, r["doc_id"] or 0)
        best[bare(r)] = min(best.get(bare(r), rank), rank)
    assert Counter(map(bare, exact)) == Counter(list(best))  # one row of each text
    assert all(best[bare(r)] == (-len(r["text"]), r["doc_id"] is None, r["doc_id"] or 0) for r in exact)
    assert near and mixed and len(near) <= len(exact)
    out = cp.STAGES[-1][1](spark, stages, sf).collect()
    want = Counter((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in mixed)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == want


def test_pipeline_empty(spark, no_docs):
    import corpus_pipeline as cp

    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_pipeline_run(spark):
    import corpus_pipeline as cp

    a = cp.run(spark, "/root/testdata/sf0.001").select("doc_id", "ids_sha256").collect()
    assert len(a) > 50
    by_stage = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in cp.STAGES:
        by_stage = stage(spark, by_stage, "/root/testdata/sf0.001")
    assert sorted(map(tuple, a)) == sorted(map(tuple, by_stage.select("doc_id", "ids_sha256").collect()))
