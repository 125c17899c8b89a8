from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vintage.functions import text as TX
from vintage.operators import text as TXT

ENVELOPE = """<SEC-DOCUMENT>header
<DOCUMENT><TYPE>10-K<TEXT>
<html><body><p>This is the primary document of the filing.</p>
<p>Item 1A. Risk Factors &amp; uncertainties are described here in detail.</p>
""" + "<p>" + " ".join(["Revenue grew as the company expanded its operations."] * 12) + "</p>" + """
</body></html></TEXT></DOCUMENT>
<DOCUMENT><TYPE>EX-99<TEXT type="EX-99">
<p>Exhibit text with more words about the business.</p></TEXT></DOCUMENT>
</SEC-DOCUMENT>"""


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first().y


def test_extract_bodies(spark):
    raw = '<TEXT>plain body</TEXT> middle <TEXT TYPE="EX-99">attr body</TEXT>'
    assert _one(spark, TX.extract_bodies("x"), raw) == ["plain body", "attr body"]
    assert _one(spark, TX.extract_bodies("x"), "no envelope here") == []


@pytest.mark.parametrize("entities", ["full", "basic"])
def test_clean_text_envelope(spark, entities):
    out = _one(spark, TXT.clean_text("x", entities=entities), ENVELOPE)
    assert "primary" in out and "Risk Factors" in out and "<" not in out and "&amp;" not in out
    assert len(out.split("\n")) == 2 and len(out) >= 500


@pytest.mark.parametrize("entities", ["full", "basic"])
def test_strip_tags_entities_whitespace(spark, entities):
    out = _one(spark, TXT.clean_text("x", entities=entities), "<p>Hello <b>world</b> &amp; friends</p>")
    assert out == "Hello world & friends"
    assert _one(spark, TXT.clean_text("x", entities=entities), "a \t\n  b c") == "a b c"


def test_full_entities_match_python(spark):
    import html
    raw = "x &eacute; &#8217; &#x41; &amp;lt; &ampz"
    assert _one(spark, TXT.clean_text("x"), raw) == " ".join(html.unescape(raw).split())


def test_short_envelope_dropped(spark):
    df = spark.createDataFrame([("<TEXT>short</TEXT>",), (ENVELOPE,)], "raw string")
    assert TXT.clean_documents(df, "raw").count() == 1


@pytest.mark.parametrize("tok,expected", [
    ("revenue", True), ("Apple", True), ("well-known", True), ("Apple's", True), ("Inc.", True),
    ("us-gaap:CoreDepositsMember", False), ("iso4217:USD", False), ("2021-03-31", False),
    ("1,234,567", False), ("$1.2B", False), ("12345", False), ('colspan="3"', False),
    ("font-family:Times", False), ("https://example.com", False), ("/path/to/thing", False),
    ("&K^*C", False), ("(-1+B", False), ("a", False), ("50×x", False),
])
def test_content_token(spark, tok, expected):
    assert _one(spark, TX.is_content_token(F.col("x")), tok) is expected


def _refilter(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return TXT.refilter(df, "text").first().refiltered


def test_refilter_cases(spark):
    facts = " ".join(["us-gaap:Revenue", "iso4217:USD", "2021-03-31", "1,234,567", 'colspan="3"'] * 110)
    out = _refilter(spark, facts)
    assert len(out) < 0.1 * len(facts) and "us-gaap" not in out
    prose = " ".join(["The company reported strong growth in its core markets this year."] * 30)
    mixed = _refilter(spark, prose + " " + " ".join(["us-gaap:Assets", "12345", "iso4217:USD", "x=1"] * 200))
    assert mixed.startswith("The company") and "us-gaap" not in mixed and "12345" not in mixed
    assert _refilter(spark, "") == ""
    sentence = "The board approved the plan to expand operations into three new regions"
    assert _refilter(spark, sentence) == sentence
    assert _refilter(spark, "12 34 :: == //") == ""


def test_keep_mask_window_clipping():
    import numpy as np
    flags = np.array([True] * 60 + [False] * 200 + [True] * 60)
    keep = TXT.keep_mask(flags)
    assert keep[:50].all() and not keep[150:170].any() and keep[-50:].all()


def test_chunk_starts(spark):
    df = spark.createDataFrame([(1, 1000), (2, 100), (3, 0), (4, 600)], "id int, n int")
    tr = {r.id: r.s for r in df.select("id", TXT.chunk_starts(F.col("n"), "train").alias("s")).collect()}
    assert tr == {1: [0, 446], 2: [], 3: [], 4: [0, 446]}
    inf = {r.id: r.s for r in df.select("id", TXT.chunk_starts(F.col("n"), "inference").alias("s")).collect()}
    assert inf == {1: [0, 446, 892], 2: [0], 3: [], 4: [0, 446]}


def test_model_inputs_padding(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "tok array<string>")
    ids, mask = TXT.model_inputs(TXT.hashed_ids(F.col("tok")), length=8)
    r = df.select(ids.alias("i"), mask.alias("m")).first()
    assert len(r.i) == 8 and r.i[0] == 101 and r.i[4] == 102 and r.i[5:] == [0, 0, 0]
    assert r.m == [1, 1, 1, 1, 1, 0, 0, 0]


def test_page_text_parser_and_regex_agree_on_simple_page(spark):
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>"
            "<script>var t='</p>';</script><h1>Title</h1><!-- c --><p>One &amp; two</p><p>Three</p></body></html>")
    a = _one(spark, TXT.page_text("x", "parser"), page)
    b = _one(spark, TXT.page_text("x", "regex"), page)
    assert a == b == "Title\nOne & two\nThree"


@pytest.mark.parametrize("method", ["parser", "regex"])
def test_sgml_text_bodies_joined_by_blank_line(spark, method):
    raw = ("<SEC-DOCUMENT><TEXT><html><body><p>First body</p><p>more</p></body></html></TEXT>"
           "<TEXT><p>Second &amp; last</p></TEXT></SEC-DOCUMENT>")
    assert _one(spark, TXT.sgml_text("x", method=method), raw) == "First body\nmore\n\nSecond & last"


def test_tokenizer_udf_and_approx_percentiles(spark):
    df = spark.createDataFrame([(1, "a bb ccc"), (2, "dddd")], "id int, text string")
    tok = TXT.tokenizer_udf(lambda t: [len(w) for w in t.split()])
    assert [r.ids for r in df.select(tok("text").alias("ids")).orderBy("id").collect()] == [[1, 2, 3], [4]]
    sizes = spark.createDataFrame([("en", float(i)) for i in range(1, 101)], "lang string, bytes double")
    ex = TXT.length_percentiles(sizes, "lang", "bytes").first()
    ap = TXT.length_percentiles(sizes, "lang", "bytes", exact=False).first()
    assert ex.p50 == pytest.approx(50.5) and abs(ap.p50 - 50.5) <= 1 and ap.max == 100


def test_page_text_head_without_end_tag(spark):
    page = "<html><head><title>T</title><script>x</script><body><p>One</p><script>no</script><p>Two</p></body></html>"
    assert _one(spark, TXT.page_text("x", "parser"), page) == "One\nTwo"
    assert _one(spark, TXT.page_text("x", "parser"), "<head><title>T</title><p>One</p>") == "One"


def test_refilter_html_by_parser(spark):
    out = _refilter(spark, '<p title="a > b">The management&rsquo;s results&mdash;revenue grew well</p><script>var x;</script>'
                           "<template>hidden words</template><!-- a comment --> and the outlook stays good")
    assert out == "The management\u2019s results\u2014revenue grew well and the outlook stays good"


def test_content_token_equals_column(spark):
    from vintage.functions import text as TX
    toks = ["a", "ab", "a1", "a12", "1ab", "x" * 40, "x" * 41, "us:gaap", "a=b", 'q"', "a/b", "\u00e9t\u00e9", "don't", "ab12c", "--", "\u4e2d\u6587"]
    df = spark.createDataFrame([(t,) for t in toks], "t string")
    got = {r.t: r.ok for r in df.select("t", TX.is_content_token(F.col("t")).alias("ok")).collect()}
    assert got == {t: TXT.content_token(t) for t in toks}
