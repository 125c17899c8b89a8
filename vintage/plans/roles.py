"""Role views: the driver's tables playing the reference's tables.

The reference works on daily bars, fundamentals, filings, index membership,
macro series, document vectors, raw pages and noisy text. The driver ships
TPC-H-like tables plus text tables; every view here is a lazy DataFrame
derived from them, so the work of each query grows with the data.

| role            | derived from                                                  |
|-----------------|---------------------------------------------------------------|
| daily bars      | lineitem by (supplier, ship day)                              |
| fundamentals    | lineitem x orders: order date is the filing date              |
| filings         | same rows, order priority as the form type                    |
| membership      | spells of order or ship days; events: signup/error change log |
| macro           | orders by (order day, priority) or events by (day, type)      |
| vectors         | embeddings: label = supplier, 1995-01-02 + 5 * vec_id = date   |
| pages / text    | pages.html, documents.text                                    |
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The calendar origin of the vector role and the days between vec_ids.
VECTOR_EPOCH = "1995-01-02"
VECTORS_PER_FILER = 25
VECTOR_SPAN_DAYS = 2000
VECTOR_STRIDE = 613


# Tables whose rows carry whole texts: per-row work is CPU-heavy. Where their files
# have few row groups, the session setting says over how many partitions to spread
# the scan; unset (on large tables) the scan stays as it is.
TEXT_PARTITIONS = "vintage.text.partitions"
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from vintage.sources.tables import read_table, spread
    df = read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get(TEXT_PARTITIONS, None) if name in TEXT_TABLES else None
    return spread(df, int(n) if n else None)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, date, ret, prc, vol) — one row per supplier and ship day;
    ``ret`` is the price relative ``sum(p (1 + discount)) / sum(p (1 + tax))`` less
    1.01, which centres it near zero (mean discount 5%, mean tax 4%)."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("entity_id"),
                       F.to_date("l_shipdate").alias("date"))
            .agg((F.sum(F.col("l_extendedprice") * (F.lit(1.0) + F.col("l_discount")))
                  / F.sum(F.col("l_extendedprice") * (F.lit(1.0) + F.col("l_tax"))) - F.lit(1.01)).alias("ret"),
                 F.sum("l_extendedprice").alias("prc"),
                 F.sum("l_quantity").alias("vol")))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, datekey, order_key, revenue, form_type): one row per
    (supplier, order) line; several rows may share (entity_id, datekey)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate",
                                                "o_totalprice", "o_orderpriority")
    return (li.join(od, li.l_orderkey == od.o_orderkey)
            .select(F.col("l_suppkey").alias("entity_id"),
                    F.to_date("o_orderdate").alias("datekey"),
                    F.col("o_orderkey").alias("order_key"),
                    F.col("o_totalprice").alias("revenue"),
                    F.col("o_orderpriority").alias("form_type")))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, filing_date, form_type) with the supplier key as a 10-digit cik."""
    f = fundamentals(spark, sf_dir)
    return f.select(F.lpad(F.col("entity_id").cast("string"), 10, "0").alias("cik"),
                    F.col("datekey").alias("filing_date"), "form_type")


def panel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, cik, date) grid of the daily bars."""
    return daily_bars(spark, sf_dir).select(
        "entity_id", F.lpad(F.col("entity_id").cast("string"), 10, "0").alias("cik"), "date")


def membership_windows(spark: SparkSession, sf_dir: str, max_gap_days: int = 5) -> DataFrame:
    """(entity_id, spell_no, date_in, date_out): spells of a supplier's order days
    (a gap of more than ``max_gap_days`` starts a new spell; the last one is open)."""
    from vintage.operators.temporal import spells
    days = fundamentals(spark, sf_dir).select("entity_id", F.col("datekey").alias("date"))
    return spells(days, "entity_id", "date", max_gap_days)


def ship_spells(spark: SparkSession, sf_dir: str, max_gap_days: int = 14) -> DataFrame:
    """(entity_id, spell_no, date_in, date_out): spells of a supplier's ship days."""
    from vintage.operators.temporal import spells
    days = daily_bars(spark, sf_dir).select("entity_id", "date")
    return spells(days, "entity_id", "date", max_gap_days)


def ticker_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, cik): supplier name as ticker, supplier key as 10-digit cik;
    suppliers with a negative balance have no filer id (not in the map)."""
    from vintage.functions.keys import normalize_cik, normalize_ticker
    s = table(spark, sf_dir, "supplier")
    return s.filter(F.col("s_acctbal") >= 0).select(normalize_ticker("s_name").alias("ticker"),
                                                     normalize_cik(F.col("s_suppkey")).alias("cik"))


def universe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, permno, date_in, date_out): ship-day spells as validity windows of a
    security id (supplier key + 100000) under the supplier's cik."""
    from vintage.functions.keys import normalize_cik
    sp = ship_spells(spark, sf_dir)
    return sp.select(normalize_cik(F.col("entity_id")).alias("cik"),
                     (F.col("entity_id") + 100000).alias("permno"), "date_in", "date_out")


def sf1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor-style fundamentals: (ticker, dimension, datekey, order_key, revenue);
    urgent/high priority orders are the as-reported quarterly ('ARQ') rows."""
    from vintage.functions.keys import normalize_ticker
    f = fundamentals(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", normalize_ticker("s_name").alias("ticker"))
    return f.join(s, f.entity_id == s.s_suppkey).select(
        "ticker",
        F.when(F.col("form_type").isin("1-URGENT", "2-HIGH"), F.lit("ARQ")).otherwise(F.lit("ARY")).alias("dimension"),
        "datekey", "order_key", "revenue")


def membership_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, seq, op) change rows: signup = added, error = removed."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "error"))
    return ev.select(F.format_string("U%d", F.col("user_id")).alias("ticker"),
                     F.to_date("ts").alias("date"),
                     F.col("event_id").alias("seq"),
                     F.when(F.col("event_type") == "signup", F.lit("added"))
                      .otherwise(F.lit("removed")).alias("op"))


def macro_long_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, series, value): mean order value per order day and priority."""
    od = table(spark, sf_dir, "orders")
    return (od.groupBy(F.to_date("o_orderdate").alias("date"),
                       F.regexp_replace(F.col("o_orderpriority"), "^[0-9]-", "").alias("series"))
            .agg(F.avg("o_totalprice").alias("value")))


def macro_long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, series, value): mean event value per day and event type."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.to_date("ts").alias("date"), F.upper("event_type").alias("series"))
            .agg(F.avg("value").alias("value")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, date, vec_id, vec): document vectors, ``VECTORS_PER_FILER`` weekly filings of each
    filer (a supplier key). A filer starts on one of ``VECTOR_SPAN_DAYS`` days after ``VECTOR_EPOCH``,
    so more vectors mean more filers on the same calendar, that of the daily panel."""
    em = table(spark, sf_dir, "embeddings")
    filer = F.floor(F.col("vec_id") / VECTORS_PER_FILER).cast("long") + 1
    start = (filer * VECTOR_STRIDE) % VECTOR_SPAN_DAYS
    return em.select(filer.alias("entity_id"),
                     F.date_add(F.lit(VECTOR_EPOCH).cast("date"),
                                (start + 7 * (F.col("vec_id") % VECTORS_PER_FILER)).cast("int")).alias("date"),
                     "vec_id", F.col("embedding").alias("vec"))
