"""Fill-in-the-middle transformation: DuckDB SQL over Arrow batches inside ``mapInArrow``.

A text is cut into units, two cut points are drawn from a hash of its doc_id, and
prefix, middle and suffix come out behind sentinels, either in the order prefix,
suffix, middle (``psm``) or suffix, prefix, middle (``spm``). The draw is a function
of ``seed`` and ``doc_id`` alone, so reruns and lost executors change nothing, and a
text can be rebuilt from its output and form. A task registers slices of its Arrow
batches of about ``SLICE`` bytes with an in-memory database of one thread; every
expression is SQL, no row is touched by Python, nothing is shuffled.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel,
stays plain; a null doc_id draws as an empty one; rows equal in doc_id are cut by the
same hash; texts of any length are read whole; bytes that are no UTF-8 become U+FFFD
first; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a text is cut into; each pattern covers every character.
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\s*[^\s]+|\s+", "char": r"(?s:.)"}
#: Prefix, suffix, middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of text that a task's database holds at once (one longer text is a slice of its own).
SLICE = 8 << 20

_CUT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(concat({seed} || ':', doc_id)) AS h FROM batch
), units AS (
  SELECT *, regexp_extract_all(text, {unit}) AS units FROM texts
), draws AS (
  SELECT *, len(units) AS n,
    CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS c2,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS d3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d4
  FROM units
), parts AS (
  SELECT doc_id, text, CAST(n AS BIGINT) AS n,
    CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR d3 >= {rate} THEN 'plain' WHEN d4 < {spm} THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(list_slice(units, 1, least(c1, c2)), '') AS prefix,
    array_to_string(list_slice(units, least(c1, c2) + 1, greatest(c1, c2)), '') AS middle,
    array_to_string(list_slice(units, greatest(c1, c2) + 1, n), '') AS suffix
  FROM draws
), made AS (
  SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output
  FROM parts
)"""

# A part stands between its own sentinel and the next one; none of them holds a sentinel.
_REBUILT = """
CASE form
  WHEN 'psm' THEN split_part(split_part(output, {s}, 1), {p}, 2) || split_part(output, {m}, 2) || split_part(split_part(output, {s}, 2), {m}, 1)
  WHEN 'spm' THEN split_part(split_part(output, {p}, 2), {m}, 1) || split_part(output, {m}, 2) || split_part(split_part(output, {p}, 1), {s}, 2)
  ELSE output END"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _settings(unit: str, rate: int, spm: int, seed: int, sentinels: Sequence[str]) -> dict:
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    if len(sentinels) != 3 or any(not s or "\x00" in s for s in sentinels):
        raise ValueError("three sentinels: prefix, suffix, middle")
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            # where one could begin inside another, an output would not tell its parts
            if any(a.endswith(b[:k]) for k in range(1, len(b))) or (i != j and b in a):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")
    p, s, m = map(_literal, sentinels)
    return {"unit": _literal(UNITS[unit]), "rate": int(rate), "spm": int(spm), "seed": _literal(str(int(seed))), "p": p, "s": s, "m": m}


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, batch.num_rows * most // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def _in_duckdb(df: DataFrame, query: str, schema: str) -> DataFrame:
    """``query`` over every slice, registered as ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect()
        con.execute("SET threads = 1")
        con.execute("SET temp_directory = ''")
        try:
            for part in slices(batches):
                con.register("batch", part)
                yield from con.sql(query).to_arrow_table().to_batches()
                con.unregister("batch")
        finally:
            con.close()

    return df.mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.make_valid_utf8(F.col("text")).alias("text"))


def transform(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row of ``docs`` (doc_id, text): ``rate`` per cent of the texts are cut, ``spm`` per cent of those come suffix first."""
    q = (_CUT + " SELECT * FROM made").format(**_settings(unit, rate, spm, seed, sentinels))
    return _in_duckdb(_texts(docs), q, f"doc_id {_type(docs)}, n long, form string, prefix_chars long, middle_chars long, output string")


def digests(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """As ``transform``, with digests in place of the output: of itself, and of the text rebuilt from it."""
    last = f" SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({_REBUILT}) AS restored_sha256 FROM made"
    q = (_CUT + last).format(**_settings(unit, rate, spm, seed, sentinels))
    return _in_duckdb(_texts(docs), q, f"doc_id {_type(docs)}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def restore(made: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """``doc_id, text`` from rows of ``transform``."""
    q = f"SELECT doc_id, {_REBUILT} AS text FROM batch".format(**_settings("line", 100, 50, 7, sentinels))
    return _in_duckdb(made.select("doc_id", "form", "output"), q, f"doc_id {_type(made)}, text string")


def _type(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()
