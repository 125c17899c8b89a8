"""File and document sources: raw files, filing index files, JSON id maps,
HTML tables, calendars of index files, and key-bounded pulls.

Each returns a DataFrame; nothing is read on the driver.
"""
from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintage.functions.keys import accession_from_path, normalize_cik, normalize_ticker

# Extensions of raw filing files and index-line shape.
RAW_EXTENSIONS = (".txt", ".htm", ".html")
INDEX_LINE = r"^\d+\|.*\|.*\|\d{4}-\d{2}-\d{2}\|.*$"


def read_raw_files(spark: SparkSession, root: str, extensions: Sequence[str] = RAW_EXTENSIONS) -> DataFrame:
    """Every file under ``root`` with one of ``extensions``, as
    ``(path, length, text)``; UTF-8 decoded with malformed bytes dropped
    (Python's ``errors="ignore"``)."""
    globs = "{" + ",".join(f"*{e}" for e in extensions) + "}"
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", globs).load(root))
    text = F.translate(F.make_valid_utf8(F.col("content").cast("string")), "�", "")
    return raw.select("path", "length", text.alias("text"))


def decode_latin1(c: str) -> F.Column:
    """A8 for index files: bytes decoded as ISO-8859-1."""
    return F.decode(F.col(c), "ISO-8859-1")


def parse_master_index(lines: DataFrame, value: str = "value") -> DataFrame:
    """A4: ``cik|company|form|date|filename`` rows of filing-index text lines.

    Header lines (everything up to the dashes) never match the row shape, so a
    per-line pattern replaces "skip until the dashes"; cik zero-padded to 10,
    dates coerced, rows with a bad date dropped.
    """
    rows = lines.filter(F.col(value).rlike(INDEX_LINE))
    p = F.split(F.col(value), r"\|")
    out = rows.select(normalize_cik(F.trim(p[0])).alias("cik"), F.trim(p[1]).alias("company"),
                      F.trim(p[2]).alias("form_type"), F.try_to_date(F.trim(p[3]), "yyyy-MM-dd").alias("filing_date"),
                      F.trim(p[4]).alias("filename"))
    return out.filter(F.col("filing_date").isNotNull())


def read_latin1_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """A8 for index files: one row per line, decoded as ISO-8859-1 (the ``text``
    source reads UTF-8 only; the CSV source honours ``encoding``, so each line is
    read as a single field with separator and quoting switched off)."""
    return (spark.read.format("csv").option("encoding", "ISO-8859-1").option("sep", "\u0001")
            .option("quote", "\u0000").option("escape", "\u0000").option("header", "false")
            .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
            .schema("value string").load(paths))


def read_master_index(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """A4 from files (one line per row; Latin-1 index files decode byte-for-byte)."""
    return parse_master_index(read_latin1_lines(spark, paths))


def collect_filings(index: DataFrame, universe: DataFrame, forms: Sequence[str] = ("10-K", "10-Q", "8-K"),
                    cik: str = "cik") -> tuple[DataFrame, DataFrame]:
    """A15 + C7 + C3: index rows of universe ciks and wanted forms with their
    accession; rows whose filename holds no accession go to a rejects table
    with a reason instead of a log line."""
    x = (index.filter(F.col("form_type").isin(*forms))
         .join(universe.select(cik).distinct(), cik, "left_semi")
         .withColumn("accession", accession_from_path("filename")))
    good = x.filter(F.col("accession").isNotNull())
    rejects = x.filter(F.col("accession").isNull()).withColumn("reason", F.lit("no accession in filename"))
    return good, rejects


def quarters(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """``(year, quarter, index_path)`` for every quarter in the years."""
    y = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    q = y.select("year", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("quarter"))
    return q.withColumn("index_path", F.format_string("full-index/%d/QTR%d/master.idx", "year", "quarter"))


def ticker_map_from_json(df: DataFrame, json_col: str = "value") -> DataFrame:
    """A JSON object of rows ``{"0": {"cik_str": .., "ticker": ..}, ...}`` ->
    ``(ticker, cik)``, ticker normalised, cik zero-padded; a later duplicate
    ticker (higher row key) wins."""
    schema = T.MapType(T.StringType(), T.StructType([T.StructField("cik_str", T.StringType()),
                                                    T.StructField("ticker", T.StringType())]))
    m = df.select(F.explode(F.from_json(F.col(json_col), schema)).alias("k", "v"))
    rows = m.select(F.col("k").try_cast("long").alias("k"), normalize_ticker(F.col("v.ticker")).alias("ticker"),
                    normalize_cik(F.col("v.cik_str")).alias("cik")).filter(F.col("ticker").isNotNull())
    return rows.groupBy("ticker").agg(F.max_by("cik", "k").alias("cik"))


def pull_by_keys(table: DataFrame, keys: DataFrame, key: str, date: str | None = None,
                 start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose key is in ``keys`` (semi-join, no IN-list chunking) and whose
    date lies in ``[start, end]`` (pushed to the scan)."""
    t = table
    if date and start:
        t = t.filter(F.col(date) >= F.lit(start).cast("date"))
    if date and end:
        t = t.filter(F.col(date) <= F.lit(end).cast("date"))
    return t.join(keys.select(key).distinct(), key, "left_semi")


def parse_dates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Coerce date-like columns; bad values -> NULL (never an error)."""
    out = df
    for c in cols:
        if c in df.columns:
            out = out.withColumn(c, F.to_date(F.try_to_timestamp(F.col(c).cast("string"))))
    return out


def as_reported(fund: DataFrame, dimensions: Sequence[str] = ("ARQ", "ARY"), dim_col: str = "dimension") -> DataFrame:
    """A10: keep as-reported dimensions only."""
    return fund.filter(F.col(dim_col).isin(*dimensions))


# --------------------------------------------------------------------------- #
# A5 — tables (and lists) of HTML pages
# --------------------------------------------------------------------------- #
class _Grid:
    """One open table or list: its rows, the cells that reach down from above, and the open cell."""

    def __init__(self, number: int, kind: str):
        self.number, self.kind, self.row, self.col = number, kind, -1, 0
        self.reach: list[tuple[int, int, int]] = []  # (first column, end column, end row) of cells from above
        self.waiting: list[tuple[int, int, int]] = []  # the same of this row's cells that reach down
        self.cell: tuple[int, int, int, list[str]] | None = None

    def new_row(self) -> None:
        self.row, self.col = self.row + 1, 0
        self.reach = [x for x in self.reach + self.waiting if x[2] > self.row]
        self.waiting = []

    def open_cell(self, colspan: int, rowspan: int) -> None:
        if self.row < 0:
            self.new_row()
        above = True
        while above:
            above = [end for first, end, _ in self.reach if first <= self.col < end]
            self.col = max(above, default=self.col)
        self.cell = (self.col, colspan, rowspan, [])
        self.col += colspan
        if rowspan > 1:
            self.waiting.append((self.cell[0], self.col, self.row + rowspan))


def _span(attrs, name: str, most: int) -> int:
    value = dict(attrs).get(name) or "1"
    return min(max(int(value), 1), most) if value.strip().isdigit() else 1


class _TableParser(HTMLParser):
    """Cells of every <table> (rows of td/th) and every <ul>/<ol> (one cell per li).

    A cell ends at its end tag or wherever the next cell, row or the end of the
    table implies it. A cell is one record with the rows and columns that it
    covers (rows end with the table), so a page's records never outnumber its
    tags. The text of a nested table or list also belongs to the cell around it.
    """

    #: The largest spans of the HTML standard.
    MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.stack, self.n_tables, self.mute = [], [], 0, 0
        self.down: list[tuple[_Grid, int, int, int, int, str]] = []  # cells with a rowspan: rows are known at the table's end

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.mute += 1
        elif tag in ("table", "ul", "ol"):
            self.stack.append(_Grid(self.n_tables, tag))
            self.n_tables += 1
        elif self.stack and self.stack[-1].kind == "table" and tag in ("tr", "thead", "tbody", "tfoot"):
            self._close_cell()
            if tag == "tr":
                self.stack[-1].new_row()
        elif self.stack and self.stack[-1].kind == "table" and tag in ("td", "th"):
            self._close_cell()
            self.stack[-1].open_cell(_span(attrs, "colspan", self.MAX_COLSPAN), _span(attrs, "rowspan", self.MAX_ROWSPAN))
        elif self.stack and self.stack[-1].kind != "table" and tag == "li":
            self._close_cell()
            self.stack[-1].new_row()
            self.stack[-1].open_cell(1, 1)

    def _close_cell(self):
        g = self.stack[-1]
        if g.cell is not None:
            first, cols, rows, parts = g.cell
            text = " ".join("".join(parts).split())
            if rows > 1:
                self.down.append((g, g.row, rows, first, cols, text))
            else:
                self.out.append((g.number, g.kind, g.row, 1, first, cols, text))
        g.cell = None

    def _close_table(self):
        self._close_cell()
        g = self.stack.pop()
        for h, row, rows, first, cols, text in self.down:
            if h is g:
                self.out.append((g.number, g.kind, row, min(rows, g.row + 1 - row), first, cols, text))
        self.down = [d for d in self.down if d[0] is not g]

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif not self.stack:
            return
        elif tag in ("td", "th", "tr") and self.stack[-1].kind == "table" or tag == "li" and self.stack[-1].kind != "table":
            self._close_cell()
        elif tag in ("table", "ul", "ol") and any(g.kind == tag for g in self.stack):
            while self.stack[-1].kind != tag:  # lists left open inside the table end with it
                self._close_table()
            self._close_table()

    def handle_data(self, data):
        if not self.mute:
            for g in self.stack:
                if g.cell is not None:
                    g.cell[3].append(data)

    def close(self):
        super().close()
        while self.stack:
            self._close_table()


_CELL_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("table_no", T.IntegerType()), T.StructField("kind", T.StringType()),
    T.StructField("row_no", T.IntegerType()), T.StructField("rows", T.IntegerType()),
    T.StructField("col_no", T.IntegerType()), T.StructField("cols", T.IntegerType()),
    T.StructField("text", T.StringType())]))


@F.pandas_udf(_CELL_SCHEMA)
def _cells_udf(pages: pd.Series) -> pd.Series:
    def one(doc):
        if doc is None:
            return []
        p = _TableParser()
        try:
            p.feed(doc)
            p.close()
        except Exception:  # noqa: BLE001 - keep what was parsed
            pass
        return [dict(zip(_CELL_SCHEMA.elementType.names, cell)) for cell in p.out]
    return pages.map(one)


def html_cells(pages: DataFrame, key: str, html_col: str = "html") -> DataFrame:
    """A5: ``(key, table_no, kind, row_no, col_no, text)`` for every table cell
    and list item of every page (stdlib ``html.parser`` in an Arrow UDF). A spanned cell is repeated at
    every row and column that it covers, row by row in Spark: no list of them is ever built."""
    cells = pages.select(key, F.explode(_cells_udf(F.col(html_col))).alias("c")).select(key, "c.*")
    by_row = cells.withColumn("row_no", F.explode(F.sequence(F.col("row_no"), F.col("row_no") + F.col("rows") - 1)))
    by_col = by_row.withColumn("col_no", F.explode(F.sequence(F.col("col_no"), F.col("col_no") + F.col("cols") - 1)))
    return by_col.select(key, "table_no", "kind", "row_no", "col_no", "text")


def column_by_header(cells: DataFrame, key: str, fragment: str, out: str) -> DataFrame:
    """A5: values of the column whose header row (row 0) contains ``fragment``."""
    hdr = (cells.filter((F.col("row_no") == 0) & F.lower("text").contains(fragment.lower()))
           .groupBy(key, "table_no").agg(F.min("col_no").alias("_c")))
    body = cells.filter(F.col("row_no") > 0)
    j = body.join(hdr, [key, "table_no"]).filter(F.col("col_no") == F.col("_c"))
    return j.select(key, "table_no", "row_no", F.col("text").alias(out))


def _table_with(cells: DataFrame, key: str, fragments: Sequence[str]) -> DataFrame:
    """Tables (page, table_no) whose header row holds every fragment."""
    hdr = cells.filter((F.col("row_no") == 0) & (F.col("kind") == "table"))
    ok = None
    for f in fragments:
        c = F.max(F.lower("text").contains(f.lower()).cast("int")) == 1
        ok = c if ok is None else ok & c
    return hdr.groupBy(key, "table_no").agg(ok.alias("_ok")).filter("_ok").select(key, "table_no")


def membership_from_pages(pages: DataFrame, key: str, html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """A5: ``(current, changes)`` from index-constituent pages.

    ``current`` = tickers of the table with a 'symbol' header; ``changes`` =
    rows of the table with 'date', 'added' and 'removed' headers, one change row
    per (date, added, removed) line turned into ``op`` rows ('added' before
    'removed' on the same line via ``seq``). Tickers are normalised (upper, '.'
    -> '-', 'NAN' -> NULL); undated rows are dropped.
    """
    from vintage.functions.keys import normalize_ticker
    cells = html_cells(pages, key, html_col)
    cur_t = _table_with(cells, key, ["symbol"])
    sym = column_by_header(cells.join(cur_t, [key, "table_no"], "left_semi"), key, "symbol", "ticker")
    current = sym.select(key, normalize_ticker("ticker").alias("ticker")).filter(F.col("ticker").isNotNull())
    ch_t = _table_with(cells, key, ["date", "added", "removed"])
    ch = cells.join(ch_t, [key, "table_no"], "left_semi")
    cols = {}
    for name in ("date", "added", "removed"):
        cols[name] = column_by_header(ch, key, name, name)
    rows = (cols["date"].join(cols["added"], [key, "table_no", "row_no"])
            .join(cols["removed"], [key, "table_no", "row_no"])
            .withColumn("date", F.to_date(F.try_to_timestamp(F.col("date"))))
            .filter(F.col("date").isNotNull()))
    ops = F.explode(F.array(
        F.struct(F.lit("added").alias("op"), normalize_ticker("added").alias("ticker"), F.lit(1).alias("k")),
        F.struct(F.lit("removed").alias("op"), normalize_ticker("removed").alias("ticker"), F.lit(0).alias("k"))))
    changes = (rows.select(key, "row_no", "date", ops.alias("o"))
               .select(key, "date", F.col("o.ticker").alias("ticker"), F.col("o.op").alias("op"),
                       # later table rows are older; within a line 'added' is walked first
                       (-(F.col("row_no") * 2) + F.col("o.k")).cast("long").alias("seq"))
               .filter(F.col("ticker").isNotNull()))
    return current, changes


# --------------------------------------------------------------------------- #
# Filings of many documents
# --------------------------------------------------------------------------- #
def read_envelopes(spark: SparkSession, path: str, document: str = "<DOCUMENT>") -> DataFrame:
    """One row per document of full-submission files: path, sequence, type, document.

    The document tag is the record separator of Spark's text source, so a file
    of any size is split at byte offsets into as many tasks as it needs, and a
    document is one row; nothing holds a whole file. The part before a file's
    first document is no row. ``sequence`` and ``type`` are the document's own
    header fields, ``document`` is what stands between its tags (for the cleaner).
    """
    d = spark.read.option("lineSep", document).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("d"))
    head = lambda tag: F.nullif(F.trim(F.regexp_extract("d", rf"(?i)<{tag}>([^\r\n<]*)", 1)), F.lit(""))
    # its end tag tells a document from a file's preamble; what follows the end tag belongs to the file
    d = d.withColumn("document", F.regexp_extract("d", r"(?is)^(.*)</DOCUMENT>", 1)).filter(F.col("d").rlike("(?i)</DOCUMENT>"))
    return d.select("path", head("SEQUENCE").try_cast("int").alias("sequence"), head("TYPE").alias("type"), "document")
