"""The store's tables: their columns, and a catalogue of them that can be made again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Tables and their columns.
TABLES = {
    "chunks": "chunk_id string, doc_id string, ticker string, section string, text string, embedding array<float>, corpus string, created_at timestamp",
    "claims": "claim_id string, query_id string, text string, cited_chunk_ids array<string>, verdict string, judge_reason string, created_at timestamp",
    "test_cases": "case_id string, ticker string, question string, expected_answer_snippet string, expected_chunk_id string",
    "xbrl_facts": "cik bigint, taxonomy string, tag string, unit string, start_date date, end_date date, val decimal(28,2), accn string, fy int, fp string, form string, filed date, frame string",
    "metric_map": "metric string, taxonomy string, tag string, priority int",
    "filing_docs": "cik bigint, accn string, primary_doc string",
    "filing_stmt_pages": "cik bigint, accn string, stmt string, html_file string",
}


def create(spark: SparkSession) -> DataFrame:
    """Empty views of all tables, for a session that reads none yet; those that are there stay. ``table, position, column, type``."""
    there = {t.name for t in spark.catalog.listTables()}
    rows = []
    for name, columns in TABLES.items():
        if name not in there:
            spark.createDataFrame([], columns).createOrReplaceTempView(name)
        rows += [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(StructType.fromDDL(columns))]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")
