"""Filing texts to chunks: paragraphs, sections, greedy packing.

Packing is sequential within a text, so it is one fold over the text's own array
of pieces, inside the JVM, which tells where chunks begin; their texts are cut out
afterwards. Texts are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET, LONGEST, SHORTEST = 1500, 2400, 200
#: Heading patterns and the bare names of standard sections.
ITEM = r"(?i)^\s*item\s+(\d{1,2}[A-C]?)\s*[.:—-]?\s*(.{0,120})$"
NOISE = r"\S{80,}"
BARE = {
    "business": "Item 1. Business",
    "risk factors": "Item 1A. Risk Factors",
    "unresolved staff comments": "Item 1B. Unresolved Staff Comments",
    "properties": "Item 2. Properties",
    "legal proceedings": "Item 3. Legal Proceedings",
    "management's discussion and analysis of financial condition and results of operations": "Item 7. Management's Discussion and Analysis",
    "quantitative and qualitative disclosures about market risk": "Item 7A. Quantitative and Qualitative Disclosures About Market Risk",
    "financial statements and supplementary data": "Item 8. Financial Statements and Supplementary Data",
    "controls and procedures": "Item 9A. Controls and Procedures",
}


def paragraphs(text: Column) -> Column:
    """Trimmed, non-empty, split at blank lines, without noise runs."""
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: (p != "") & ~p.rlike(NOISE))


def section(paragraph: Column, bare: bool) -> Column:
    """A heading's label, or null."""
    line = F.substring_index(paragraph, "\n", 1)
    number, title = F.upper(F.regexp_extract(line, ITEM, 1)), F.regexp_replace(F.trim(F.regexp_extract(line, ITEM, 2)), r"\.+$", "")
    label = F.when(line.rlike(ITEM), F.concat(F.lit("Item "), number, F.when(title != "", F.concat(F.lit(". "), title)).otherwise("")))
    if bare:
        key = F.replace(F.lower(F.regexp_replace(F.trim(line), r"[.:]+$", "")), F.lit("’"), F.lit("'"))
        names = F.create_map(*[F.lit(x) for pair in BARE.items() for x in pair])
        label = F.coalesce(label, F.try_element_at(names, key))
    return F.when(F.length(line) <= 150, label)


def _pieces(text: Column, bare: bool) -> Column:
    """Each paragraph, cut at the longest length, with the label it begins."""

    def cut(p: Column) -> Column:
        label = section(p, bare)
        return F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / LONGEST).cast("int")), lambda i: F.struct(F.substring(p, i * LONGEST + 1, F.lit(LONGEST)).alias("piece"), F.when(i == 0, label).alias("label")))

    return F.flatten(F.transform(paragraphs(text), cut))


_STATE = "struct<cuts:array<int>,size:int,at:int>"


def cuts(pieces: Column) -> Column:
    """Places of the pieces that begin a chunk: a chunk ends before it would pass the target, and at headings. The fold holds places, no texts."""

    def step(s: Column, x: Column) -> Column:
        n = F.length(x["piece"])
        new = (s["at"] == 0) | x["label"].isNotNull() | (s["size"] + n > TARGET)
        return F.struct(F.when(new, F.array_append(s["cuts"], s["at"])).otherwise(s["cuts"]).alias("cuts"), F.when(new, n).otherwise(s["size"] + n).alias("size"), (s["at"] + 1).alias("at"))

    empty = F.struct(F.array().alias("cuts"), F.lit(0).alias("size"), F.lit(0).alias("at")).cast(_STATE)
    return F.aggregate(pieces, empty, step, lambda s: s["cuts"])


def sections(pieces: Column, at: Column) -> Column:
    """For each place of ``at`` the label last given there or before."""
    none = F.array().cast("array<string>")
    return F.aggregate(F.transform(at, lambda c: F.get(pieces, c)["label"]), none, lambda s, label: F.array_append(s, F.coalesce(label, F.get(s, F.size(s) - 1))))


def packed(filings: DataFrame, output: str, bare: bool, where: Column | None = None) -> DataFrame:
    """Adds ``output``: chunks (section, text) of ``text``, short ones left out; null where ``where`` is not so."""
    pieces = _pieces(F.col("text"), bare)
    df = filings.withColumn("_pieces", pieces if where is None else F.when(where, pieces)).withColumn("_cuts", cuts(F.col("_pieces"))).withColumn("_sections", sections(F.col("_pieces"), F.col("_cuts")))

    def text(c: Column, i: Column) -> Column:
        end = F.coalesce(F.get("_cuts", i + 1), F.size("_pieces"))
        return F.struct(F.get("_sections", i).alias("section"), F.array_join(F.transform(F.slice("_pieces", c + 1, end - c), lambda x: x["piece"]), "\n\n").alias("text"))

    return df.withColumn(output, F.filter(F.transform("_cuts", text), lambda x: F.length(x["text"]) >= SHORTEST)).drop("_pieces", "_cuts", "_sections")


def chunk(filings: DataFrame) -> DataFrame:
    """``doc_id, ticker, corpus, chunk_id, ordinal, section, text``. A text with under 30 % labelled chunks is packed again with bare headings, kept if that labels more."""

    def labelled(chunks: Column) -> Column:
        return F.size(F.filter(chunks, lambda c: c["section"].isNotNull()))

    one = packed(filings, "one", False)
    both = packed(one, "two", True, (F.size("one") > 0) & (labelled(F.col("one")) < 0.3 * F.size("one")))
    best = F.when(F.col("two").isNotNull() & (labelled(F.col("two")) > labelled(F.col("one"))), F.col("two")).otherwise(F.col("one"))
    out = both.select("doc_id", "ticker", "corpus", F.posexplode(best).alias("ordinal", "c"))
    return out.select("doc_id", "ticker", "corpus", chunk_id(F.col("doc_id"), F.col("ordinal")).alias("chunk_id"), "ordinal", "c.section", "c.text")


def chunk_id(doc_id: Column, ordinal: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("_"), F.lpad(ordinal.cast("string"), 4, "0"))
