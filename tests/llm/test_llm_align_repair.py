"""Decontamination, tokenizer alignment and conversation repair: brute force, planted cases and edge rows."""
from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from llm.conftest import SF, duck
from vintage.llm import align, decontaminate, queries, repair
from vintage.llm.queries import ORACLE, tokenizer_path

# ------------------------------------------------------------ decontamination

ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("w", T.StringType()), T.StructField("items", T.StringType())])
LONG = " ".join(f"w{i}" for i in range(14))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_hits(text, items, window=10):
    x, hit, found = words(text), set(), set()
    for item, t in items:
        y = words(t)
        for at in range(max(len(y) - window + 1, 1) if y else 0):
            run = y[at:at + window]
            for p in range(len(x) - len(run) + 1):
                if x[p:p + len(run)] == run:
                    hit |= set(range(p, p + len(run)))
                    if item is not None:
                        found.add(str(item))
    return len(x), len(hit), sorted(found)


ITEMS = [(1, LONG), (1, "Short item"), (2, "über ÄPFEL"), (3, None), (4, ""), (5, "..."), (None, "secret words"), (10, "short ITEM!"),
         (6, " ".join(f"w{i}" for i in range(4, 14)))]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(*i, "x", "y") for i in ITEMS], ITEM)


TEXTS = [None, "", "...", f"x {LONG} y", LONG.upper(), f"{LONG[:30]} {LONG}", "a SHORT,item\x00", "short xx item", "Über äpfel über ÄPFEL é",
         "the secret--words", " ".join(f"w{i}" for i in range(1, 9)), "short item " * 500 + "z", "w" * 70_000]


def test_hits_equal_brute_force(spark, bench):
    docs = spark.createDataFrame([(i % 11, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, items string")
    want = sorted(((i % 11, *brute_hits(t, ITEMS)) for i, t in enumerate(TEXTS)), key=repr)
    for per in (100_000, 3):  # one automaton, and several
        got = decontaminate.find_items(docs, bench, per_automaton=per).collect()
        assert sorted(((r.doc_id, r.n_words, sum(h.end_word - h.first_word for h in r.hits), list(r["items"])) for r in got), key=repr) == want


def test_spans_lie_in_the_original(spark, bench):
    docs = spark.createDataFrame([(1, f"é, {LONG.upper()}. Ende; Über-Äpfel über--ÄPFEL")], "doc_id long, text string")
    got = decontaminate.hit_passages(decontaminate.find_items(docs, bench)).orderBy("start").collect()
    assert [r.passage for r in got] == [LONG.upper(), "über--ÄPFEL"]


def test_drop_contaminated_keeps_clean_rows(spark, bench):
    docs = spark.createDataFrame([(1, "clean text", 5), (2, "a short item", 6), (1, "clean text", 5), (3, None, 7)], "doc_id long, text string, items int")
    got = decontaminate.drop_contaminated(docs, bench)
    assert got.columns == docs.columns and sorted(got.collect()) == sorted(docs.filter("doc_id <> 2 OR doc_id IS NULL").collect())
    assert decontaminate.drop_contaminated(docs, bench, max_share=0.7).count() == 4


def test_decontamination_edges(spark, bench, edge_docs, no_docs):
    none = spark.createDataFrame([], ITEM)
    got = decontaminate.contamination(edge_docs, none)
    assert got.count() == edge_docs.count() and got.filter("contaminated OR n_hit > 0 OR n_items > 0").isEmpty()
    assert decontaminate.contamination(no_docs, bench).isEmpty() and decontaminate.contamination(no_docs, none).isEmpty()
    assert decontaminate.contamination(edge_docs, bench).columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_decontamination_query_equals_sql(spark):
    con = duck()
    sql = con.sql(ORACLE["op11_decontamination"])
    got = queries.op11_decontamination(spark, "/root/testdata/sf0.01").select(*sql.columns).collect()
    assert sorted(map(tuple, got)) == sorted(sql.fetchall())


# ------------------------------------------------------------------ alignment

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def brute_text(a, text):
    """Ids, groups and links of one text by comparing every pair of tokens."""
    ids = [a.a.encode(" " + text, add_special_tokens=False).ids, a.b.encode(text)] if text else [[], []]
    raw = f" {text}".encode()
    if not text or any(b"".join(t[i] for i in x) != raw for x, t in zip(ids, (a.bytes_a, a.bytes_b))):
        return [], [], "", []
    ends = [list(itertools.accumulate(len(t[i]) for i in x)) for x, t in zip(ids, (a.bytes_a, a.bytes_b))]
    groups, before = [], 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        groups.append("|".join(",".join(str(i) for i, at in zip(x, y) if before < at <= e) for x, y in zip(ids, ends)))
        before = e
    starts = [[0, *y[:-1]] for y in ends]
    links = [(p, q) for p, s, e in zip(ids[0], starts[0], ends[0]) for q, u, v in zip(ids[1], starts[1], ends[1]) if s < v and u < e]
    return ids[0], ids[1], groups, links


def brute_alignment(rows):
    a = align.Aligner(A, B)
    got = [(i, brute_text(a, t)) for i, t in rows]
    n = Counter(x for _, g in got for x in g[3])
    top = defaultdict(int)
    for (_, q), c in n.items():
        top[q] = max(top[q], c)
    return [(i, len(x), len(y), len(g), len(links), sum(n[k] == top[k[1]] for k in links), sum(n[k] for k in links),
             hashlib.sha256(";".join(g).encode()).hexdigest() if links else "") for i, (x, y, g, links) in got]


ODD = ["", None, " ", "\n", "  a  b ", "a\nb c", "<|endoftext|> hi <s> <unk> <0x41>", "▁x y", "a ▁ b", "中文 é́ x\x00y z\x1c w", "x" * 400,
       " x y", "a  b c d", "tab\t x", "😀 😀😀 family👨‍👩‍👧 x", "\r\n a", "﻿ a b", "ﬁ ½ Å", "the the", "the the", "the the"]


def test_alignment_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "the end"), (7, "the end")]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, copies int")
    got = align.alignment(docs, A, B).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_alignment(rows), key=repr)


def test_alignment_query_equals_brute_force(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE length(text) < 6000 OR text IS NULL").fetchall()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, align.alignment(docs, A, B).collect())) == sorted(brute_alignment(rows))
    whole = queries.op12_tokenizer_alignment(spark, SF)
    assert whole.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_alignment_by_stretches_equals_whole_texts():
    import duckdb

    a = align.Aligner(A, B, remember=50)
    for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE length(text) BETWEEN 500 AND 9000 LIMIT 60").fetchall():
        x, y, g, links = brute_text(a, t)
        counts, sha, pairs = a.text(t)
        assert counts.tolist() == [len(x), len(y), len(g), len(links)] and sha == hashlib.sha256(";".join(g).encode()).hexdigest()
        assert sorted(pairs.tolist()) == sorted(p << align.SHIFT | q for p, q in links)
        pieces = list(a.segments(t, size=200))
        assert " ".join(s for p in pieces for s in p) == t and len(pieces) > 1


def test_links_by_id_and_edges(spark, edge_docs, no_docs):
    blocks = align.aligned_blocks(align.distinct_texts(edge_docs), A, B).cache()
    total = align.alignment(edge_docs, A, B)
    assert total.count() == edge_docs.count()
    assert align.links_by_id(blocks).groupBy().sum("n").first()[0] == total.groupBy().sum("n_links").first()[0]
    assert align.alignment(no_docs, A, B).isEmpty()


# --------------------------------------------------------------------- repair


def every_audit(codes):
    """All audits with at most two insertions in a row."""
    out = []

    def go(i, place, cost, audit, inserted):
        if i == len(codes) and place in (repair.START, repair.ASSISTANT):
            out.append((cost, audit))
        after, role = (repair.ASSISTANT, "a") if place == repair.USER else (repair.USER, "u")
        if i < len(codes):
            letter, stay = codes[i].lower(), 3 * codes[i].isupper()
            go(i + 1, place, cost + 4, audit + "D", 0)
            if letter != "x":
                go(i + 1, after, cost + stay + 3, audit + "R", 0)
            if letter == role:
                go(i + 1, after, cost + stay, audit + "K", 0)
            if letter == "s" and place == repair.START:
                go(i + 1, repair.SYSTEM, cost + stay, audit + "K", 0)
        if inserted < 2:
            go(i, after, cost + 3, audit + "I", inserted + 1)
    go(0, repair.START, 0, "", 0)
    return min(out)


def test_repair_equals_every_audit():
    rng = random.Random(3)
    for _ in range(250):
        codes = "".join(rng.choice("suaoSUAx") for _ in range(rng.randrange(6)))
        assert repair.repair(codes) == every_audit(codes), codes


def test_band_keeps_every_cost_up_to_the_cap():
    rng = random.Random(5)
    for _ in range(300):
        codes = "".join(rng.choice("uaUAox") for _ in range(rng.randrange(8)))
        target = "ua" * rng.randrange(5)
        wide = repair.align(codes, target, 10_000)
        assert repair.align(codes, target, wide[0]) == wide and repair.align(codes, target, wide[0] - 1) is None


def test_chained_blocks_equal_the_whole():
    rng = random.Random(4)
    for _ in range(300):
        codes = "".join(rng.choice("suauauaOUAx") for _ in range(rng.randrange(1, 30)))
        k = rng.randrange(1, 9)
        cost, path = repair.chain([repair.segments(codes[i:i + k]) for i in range(0, len(codes), k)])
        assert (cost, "".join(a for _, a in path)) == repair.repair(codes)


CONV = "conv_id long, turn long, role string, text string, c string, audit int"


def brute_repairs(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], *(" " if x is None else x for x in r[2:4])) for r in rows if r[0] == conv),
                       key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            faults.append(repair.fault(text, (role, text) in seen))
            seen.add((role, text))
        cost, audit = repair.repair("".join(repair._code(r, f) for (_, r, _), f in zip(turns, faults)))
        known = [t for t, _, _ in turns if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(repair.repaired_lines([t[1:] for t in turns], audit)).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repairs_equal_brute_force_at_any_length(spark):
    rng = random.Random(6)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Yes.", "no", "", None, " \t", "ok!", "longer one?", "a", "b."]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.3 else f"text {t}.")
            for c in (*range(25), None) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else "user", f"turn {t}." if rng.random() < 0.8 else "cut") for t in range(700)]
    rows += [(101, 5, "user", "same.")] * 300 + [(102, None, "user", f"t{i}.") for i in range(150)] + rows[:5]
    got = repair.repairs(spark.createDataFrame([(*r, "k", 3) for r in rows], CONV))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repairs(rows)


def test_repair_edges(spark):
    none = spark.createDataFrame([], CONV)
    assert repair.repairs(none).isEmpty() and repair.with_all_ids(repair.repairs(repair.damaged(none)), none).isEmpty()
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(lost, 0, "user", "x" * 70_000, "k", 3), (None, None, None, None, None, None)], CONV)
    got = {r.conv_id: r for r in repair.with_all_ids(repair.repairs(repair.damaged(one)), one).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got[lost]) == (lost, 0, 0, 0, 0, 0, 0, "", empty) and len(got) == 2


def test_repair_query_equals_sql(spark):
    sql = duck().sql(ORACLE["op13_conversation_repair"])
    got = queries.op13_conversation_repair(spark, "/root/testdata/sf0.01").select(*sql.columns).collect()
    assert sorted(map(tuple, got)) == sorted(sql.fetchall())
