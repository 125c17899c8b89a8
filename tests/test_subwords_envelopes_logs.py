"""Subword ids, full-submission files, append logs, text nodes and streams without input."""
from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vintage.operators import subwords as SW
from vintage.operators import text as TXT
from vintage.sources import files as SF
from vintage.sources import sinks as SK
from vintage.streaming import incremental as ST

SPECIAL = [SW.PAD, SW.UNKNOWN, SW.BEGIN, SW.END]


def brute_word(w, vocab):
    """Longest match by trying every length."""
    out, at = [], 0
    while at < len(w):
        for end in range(len(w), at, -1):
            piece = (SW.GOES_ON if at else "") + w[at:end]
            if piece in vocab and piece not in SPECIAL:
                out.append(vocab[piece])
                at = end
                break
        else:
            return [vocab[SW.UNKNOWN]]
    return out or [vocab[SW.UNKNOWN]]


def test_longest_match_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        pieces = {("##" if rng.random() < 0.5 else "") + "".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(12)}
        vocab = {t: i for i, t in enumerate([*SPECIAL, *sorted(pieces)])}
        s = SW.Subwords(vocab, remember=3)
        words = ["".join(rng.choice("abéc") for _ in range(rng.randrange(1, 12))) for _ in range(40)]
        assert [s.word(w) for w in words] == [brute_word(w, vocab) for w in words]
        assert s.text(" ".join(words)) == [i for w in words for i in brute_word(w, vocab)]


def test_subword_column_and_vocabulary(spark):
    vocab = {t: i for i, t in enumerate([*SPECIAL, "un", "##able", "##a", "!", "_", "#", "##"])}
    rows = [(1, "Unable, UN!"), (2, None), (3, ""), (4, "  \n"), (5, "unx un_a " + "u" * 200), (6, "## [CLS]")]
    df = spark.createDataFrame(rows, "id int, t string").select("id", SW.subword_ids(F.col("t"), vocab).alias("x"))
    got = {r.id: r.x for r in df.collect()}
    assert got[1] == [4, 5, 1, 4, 7] and got[2] is None and got[3] == [] == got[4]
    assert got[5] == [1, 4, 8, 1, 1] and got[6] == [9, 9, 1, 1, 1]
    table = spark.createDataFrame(list(vocab.items()), "token string, id int")
    assert SW.read_vocabulary(table) == vocab
    for bad in (table.filter("id > 0"), table.union(table.limit(1))):
        with pytest.raises(ValueError):
            SW.read_vocabulary(bad)
    with pytest.raises(ValueError):
        SW.read_vocabulary(table, max_size=5)


def test_one_file_is_read_as_many_parts(spark, tmp_path):
    docs = [f"\n<TYPE>{'10-K' if i % 2 else 'EX-99 '}\n<SEQUENCE>{i}\n<TEXT>\n<p>Filing {i} {'word ' * 200}</p>\n</TEXT>\n</DOCUMENT>\n" for i in range(400)]
    one = tmp_path / "one.txt"
    one.write_text("<SEC-HEADER>ignored <TEXT>head</TEXT>\n" + "".join("<DOCUMENT>" + d for d in docs) + "</SEC-DOCUMENT>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        got = SF.read_envelopes(spark, str(one))
        assert got.rdd.getNumPartitions() > 5  # one file, several byte ranges
        rows = {r.sequence: r for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(rows) == list(range(400)) and rows[3].type == "10-K" and rows[4].type == "EX-99"
    assert all(rows[i].document == d[:d.index("</DOCUMENT>")] for i, d in enumerate(docs))
    clean = TXT.clean_documents(SF.read_envelopes(spark, str(one)).filter("sequence = 7"), "document", "c", min_length=None).first().c
    assert clean == f"Filing 7 {'word ' * 200}".strip()
    (tmp_path / "none.txt").write_text("no document here")
    assert SF.read_envelopes(spark, str(tmp_path / "none.txt")).isEmpty()


def test_append_log_counts_each_run_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *d: spark.createDataFrame([(x, x * 10) for x in d], "d int, v int")
    assert SK.append_run(rows(1, 2), path, "007") and not SK.append_run(rows(1, 2), path, "007")
    assert SK.extend_log(path, "8", rows(2, 3), "d") and not SK.extend_log(path, "8", rows(2, 3, 4), "d")
    got = sorted((r.d, r.v, r.run_id) for r in SK.read_runs(spark, path).collect())
    assert got == [(1, 10, "007"), (2, 20, "007"), (3, 30, "8")]


def test_text_up_to_the_next_tag_is_one_node(spark):
    page = lambda d: TXT._page_text(d, TXT._PARSER_SKIP, "\n")
    assert page("<p>profit x<5</p>") == "profit x<5"
    assert page("a <b>c</b> d<!-- x -->e<script>f<g</script>h &lt; i & j") == "a \nc\n d\ne\nh < i & j"
    assert page("1 < 2 < 3 <= 4") == "1 < 2 < 3 <= 4" and page("") == "" and page(None) is None
    df = spark.createDataFrame([("<p>margin rose x<5 percent</p> &amp; <b>bold</b>text",)], "t string")
    assert TXT.html_words("<p>profit x<5</p>").split() == ["profit", "x<5"]
    assert TXT.refilter(df, "t").first().n_tokens == 7


def test_streams_without_input_give_empty_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    s = ST.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "cik string, ts timestamp").schema)
    ST.run_dedupe(s, "cik", str(tmp_path / "a"), str(tmp_path / "ca"))
    assert ST.read_log(spark, str(tmp_path / "a")).isEmpty()
    ST.run_daily_counts(s, "cik", "ts", str(tmp_path / "b"), str(tmp_path / "cb"))
    assert ST.trailing_counts(spark, str(tmp_path / "b"), "cik").isEmpty()


def test_seen_keys_are_state_and_not_read_again(spark, tmp_path):
    """Each batch reads its own input only; earlier keys come from the state."""
    src, sink, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    read = []
    for i in range(4):
        spark.range(i * 50, i * 50 + 100).selectExpr("cast(id as string) k").coalesce(1).write.mode("append").parquet(src)
        q = ST.run_dedupe(ST.file_stream(spark, src, spark.read.parquet(src).schema), "k", sink, ck)
        read.append(sum(p["numInputRows"] for p in q.recentProgress))
    assert read == [100] * 4
    log = ST.read_log(spark, sink)
    assert log.count() == 250 == log.select("k").distinct().count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False
