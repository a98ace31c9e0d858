"""Readers of filers' JSON, XML and text payloads. All are plans over files; nothing is fetched."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerlens.functions import registry

_POINT = "struct<start:string,end:string,val:decimal(28,6),accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
COMPANY_FACTS = f"cik long, entityName string, facts map<string,map<string,struct<label:string,units:map<string,array<{_POINT}>>>>>"
_FILINGS = "struct<form:array<string>,accessionNumber:array<string>,primaryDocument:array<string>,filingDate:array<string>,reportDate:array<string>>"
SUBMISSIONS = f"cik string, filings struct<recent:{_FILINGS},older:array<{_FILINGS}>>"
#: Block tags of filing pages.
_BLOCKS = "p|div|tr|table|br|li|h1|h2|h3|h4|h5|h6"


def company_facts(spark: SparkSession, path: str, registered_only: bool = True) -> DataFrame:
    """Fact rows of company payloads; points without end, value, accession or filing date go.

    With ``registered_only`` tags outside the registry go before their points are unfolded.
    """
    raw = spark.read.schema(COMPANY_FACTS).json(path)
    tags = raw.select("cik", F.explode("facts").alias("taxonomy", "tags")).select("cik", "taxonomy", F.explode("tags").alias("tag", "body"))
    if registered_only:
        tags = tags.join(F.broadcast(registry.table(spark).select("taxonomy", "tag").distinct()), ["taxonomy", "tag"], "left_semi")
    points = tags.select("cik", "taxonomy", "tag", F.explode("body.units").alias("unit", "points")).select("cik", "taxonomy", "tag", "unit", F.explode("points").alias("p"))
    full = points.where("p.end is not null and p.val is not null and coalesce(p.accn, '') <> '' and coalesce(p.filed, '') <> ''")
    day = lambda c: F.to_date(F.col(c))
    return full.select("cik", "taxonomy", "tag", "unit", day("p.start").alias("start_date"), day("p.end").alias("end_date"), "p.val", "p.accn", "p.fy", "p.fp", "p.form", day("p.filed").alias("filed"), "p.frame")


def ticker_registry(spark: SparkSession, path: str) -> DataFrame:
    """``ticker, cik`` (ten digits), ``title`` from the listing file, a map of entries."""
    raw = spark.read.option("multiLine", True).option("wholetext", True).text(path)
    entries = raw.select(F.explode(F.map_values(F.from_json("value", "map<string,struct<cik_str:long,ticker:string,title:string>>"))).alias("e"))
    return entries.select(F.upper("e.ticker").alias("ticker"), F.lpad(F.col("e.cik_str").cast("string"), 10, "0").alias("cik"), "e.title")


def resolve_tickers(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """``wanted`` (ticker) with cik and title; ``error`` says what is wrong with the rest."""
    t = F.upper(F.trim("ticker"))
    met = wanted.withColumn("ticker", t).join(listing, "ticker", "left")
    return met.withColumn("error", F.when(~F.col("ticker").rlike(r"^[A-Z][A-Z0-9.\-]{0,9}$"), "malformed").when(F.col("cik").isNull(), "unknown"))


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """``cik, block, pos, form, accn, primary_doc, filed, report``: recent filings are block 0, older files follow."""
    raw = spark.read.option("multiLine", True).schema(SUBMISSIONS).json(path)
    blocks = raw.select("cik", F.posexplode(F.concat(F.array("filings.recent"), F.coalesce("filings.older", F.array().cast(f"array<{_FILINGS}>")))).alias("block", "b"))
    zipped = F.arrays_zip("b.form", "b.accessionNumber", "b.primaryDocument", "b.filingDate", "b.reportDate")
    rows = blocks.select("cik", "block", F.posexplode(zipped).alias("pos", "f"))
    return rows.select("cik", "block", "pos", F.col("f.form").alias("form"), F.col("f.accessionNumber").alias("accn"), F.col("f.primaryDocument").alias("primary_doc"), F.col("f.filingDate").alias("filed"), F.col("f.reportDate").alias("report"))


def latest_filing(rows: DataFrame, form: str = "10-K") -> DataFrame:
    """The first recent filing of exactly this form."""
    return rows.where((F.col("block") == 0) & (F.col("form") == form)).groupBy("cik").agg(F.min_by(F.struct("accn", "primary_doc", "filed", "report"), "pos").alias("f")).select("cik", "f.*")


def filing_for_year(rows: DataFrame, wanted: DataFrame, form: str = "10-K") -> DataFrame:
    """``wanted``: cik, fy. The first filing whose report year is fy, in recent then older blocks; else of the first quarter after."""
    met = rows.where(F.col("form") == form).join(wanted, "cik")
    year, month = F.substring("report", 1, 4).try_cast("int"), F.substring("report", 6, 2)
    tier = F.when(year == F.col("fy"), 1).when((year == F.col("fy") + 1) & month.isin("01", "02", "03"), 2)
    w = Window.partitionBy("cik", "fy").orderBy("tier", "block", "pos")
    return met.withColumn("tier", tier).where("tier is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("cik", "fy", "accn", "primary_doc", "filed", "report")


def filing_docs(rows: DataFrame, deep: bool = False) -> DataFrame:
    """``cik, accn, primary_doc``; filings without a document go, older blocks count only if ``deep``."""
    return rows.where((F.coalesce("primary_doc", F.lit("")) != "") & (F.lit(deep) | (F.col("block") == 0))).select("cik", "accn", "primary_doc")


def statement_pages(summaries: DataFrame) -> DataFrame:
    """``cik, accn, stmt, html_file`` from filing summaries (cik, accn, xml): the first report of each kind; malformed XML gives none."""
    schema = "MyReports struct<Report:array<struct<ShortName:string,HtmlFileName:string>>>"
    parsed = summaries.select("cik", "accn", F.from_xml("xml", schema, {"mode": "PERMISSIVE"}).alias("x"))
    each = parsed.select("cik", "accn", F.posexplode("x.MyReports.Report").alias("pos", "r")).withColumn("name", F.upper(F.coalesce("r.ShortName", F.lit(""))))
    has = lambda *words: F.greatest(*[F.col("name").contains(w).cast("int") for w in words], F.lit(0)) > 0
    kind = (
        F.when(has("BALANCE SHEET", "FINANCIAL POSITION"), "balance")
        .when(has("CASH FLOW"), "cashflow")
        .when(~has("COMPREHENSIVE") & has("STATEMENTS OF OPERATIONS", "STATEMENT OF OPERATIONS", "OF INCOME", "OF EARNINGS", "INCOME STATEMENT"), "income")
    )
    told = each.where((F.coalesce("r.HtmlFileName", F.lit("")) != "") & ~has("PARENTHETICAL")).withColumn("stmt", kind).where("stmt is not null")
    return told.groupBy("cik", "accn", "stmt").agg(F.min_by("r.HtmlFileName", "pos").alias("html_file"))


#: What may stand in a tag up to its end: quoted values may hold the sign that ends it.
_INSIDE = r"""(?:[^>=]++|=[=\s]*+(?:"[^"]*+"|'[^']*+')?+)*+"""
#: Blanks at the ends of a text.
_BLANK = r"[\s\x1c-\x1f\x85\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


@F.pandas_udf(StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    """Character references, numbered, named, and the old ones without a semicolon, as HTML reads them."""
    return pd.Series([html.unescape(t) if t and "&" in t else t for t in texts], dtype=object)


def page_text(page: Column) -> Column:
    """A filing page's text: scripts and styles go, to the page's end if they never close; comments and other markup go; block tags break lines; character references are decoded; blanks and empty lines collapse."""
    t = F.regexp_replace(page, rf"(?is)<(script|style)(?=[\s/>]){_INSIDE}>.*?(?:</\1(?=[\s/>])[^>]*+>|\z)", "")
    t = F.regexp_replace(t, r"(?s)<!--(?:-?>|.*?(?:--!?>|\z))", "")
    t = F.regexp_replace(t, rf"(?is)</?(?:{_BLOCKS})(?=[\s/>]){_INSIDE}>", "\n")
    t = F.regexp_replace(t, rf"(?s)</?[a-zA-Z]{_INSIDE}>|<[!?/][^>]*+>", "")
    t = F.regexp_replace(F.translate(_decoded(t), "\u00a0", " "), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"), rf"^{_BLANK}|{_BLANK}$", "")


def filing_texts(spark: SparkSession, path: str, meta: DataFrame | None = None, shortest: int = 10_000) -> DataFrame:
    """``ticker, doc_id, text``, a row for each file; texts below ``shortest`` characters are rejected. ``meta``: ticker, filing_date."""
    raw = spark.read.option("wholetext", True).text(path).select(F.upper(F.element_at(F.split(F.element_at(F.split(F.input_file_name(), "/"), -1), r"[_.]"), 1)).alias("ticker"), F.col("value").alias("text"))
    year = F.lit("")
    if meta is not None:
        raw = raw.join(meta, "ticker", "left")
        year = F.coalesce(F.substring("filing_date", 1, 4), F.lit(""))
    doc_id = F.concat("ticker", F.lit("_10K"), F.when(year != "", F.concat(F.lit("_"), year)).otherwise(""))
    return raw.where(F.length("text") >= shortest).select("ticker", doc_id.alias("doc_id"), "text")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records; blank and malformed lines go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file ``{"cases": [...]}``."""
    return spark.read.option("multiLine", True).schema(f"cases array<struct<{schema}>>").json(path).select(F.inline("cases"))
