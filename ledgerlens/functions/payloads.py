"""Model payloads read leniently, on VARIANT, in the JVM: what can be saved is, the rest is null or empty.

Every function takes the payload's JSON text. Text that is no JSON, also with a key
twice in one object, is as no payload. A value of the wrong type that nothing can be
made of spoils its payload as a whole, as stated with each kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of claims, the first is what others become; routes, likewise.
KINDS = ("insight", "risk")
ROUTES = ("narrative", "numeric", "hybrid", "out_of_scope")
CLAIMS = "array<struct<text:string,cited_chunk_ids:array<string>,kind:string>>"
_NONE = "array<variant>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _shape(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID for a JSON null, or a type of numbers; null where there is nothing."""
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def _at(v: Column, key: str) -> Column:
    return F.when(_shape(v) == "OBJECT", F.try_variant_get(v, f"$.{key}", "variant"))


def _string(v: Column) -> Column:
    """A string's text; null for all else."""
    return F.when(_shape(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _list(v: Column) -> Column:
    return F.when(_shape(v) == "ARRAY", F.try_variant_get(v, "$", _NONE))


def _true(v: Column) -> Column:
    """Whether a value counts as true: not null, false, zero or empty."""
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(
        F.when(_shape(v).isin("OBJECT", "ARRAY"), ~F.to_json(v).isin("{}", "[]")).when(_shape(v) == "STRING", text != "").when(_shape(v) == "BOOLEAN", text == "true").when(_shape(v) != "VOID", F.try_variant_get(v, "$", "double") != 0),
        F.lit(False),
    )


def _blank(v: Column) -> Column:
    """Whether a value written out is white space: only strings can be."""
    return v.isNull() | F.coalesce(F.trim(F.regexp_replace(_string(v), r"\s", " ")) == "", F.lit(False))


def _strings(v: Column) -> Column:
    """A list of strings only; null if there is anything else in it, or it is no list."""
    return F.when(~F.exists(_list(v), lambda x: _string(x).isNull()), F.transform(_list(v), _string))


# --- answers


def _data(raw: Column) -> Column:
    """The object that holds the claims, out of an envelope of any one key; an envelope's list is its claims."""

    def opened(d: Column) -> Column:
        one = (_shape(d) == "OBJECT") & _at(d, "claims").isNull() & (F.size(F.try_variant_get(d, "$", "map<string,variant>")) == 1)
        inner = F.element_at(F.map_values(F.try_variant_get(d, "$", "map<string,variant>")), 1)
        inner = _let(inner, lambda v: F.when(_shape(v) == "STRING", F.try_parse_json(_string(v))).otherwise(v))
        return F.when(one, inner).otherwise(F.when(_shape(d) == "OBJECT", d))

    return _let(F.try_parse_json(raw), opened)


def _claims(d: Column) -> Column:
    """The list of claims, whatever form it came in; null if there is none."""

    def found(c: Column) -> Column:
        inner = F.try_parse_json(_string(c))
        flat = F.array(F.to_variant_object(F.struct(c.alias("text"), _at(d, "cited_chunk_ids").alias("cited_chunk_ids"), _at(d, "kind").alias("kind"))))
        told = F.when((_shape(c) == "STRING") & inner.isNull(), F.when(_at(d, "cited_chunk_ids").isNotNull(), flat))
        plain = _let(F.when(_shape(c) == "STRING", inner).otherwise(c), lambda v: F.when(_shape(v) == "OBJECT", F.array(v)).otherwise(_list(v)))
        return F.when((_shape(c) == "STRING") & inner.isNull(), told).otherwise(plain)

    return F.when(_shape(d) == "ARRAY", _list(d)).otherwise(_let(_at(d, "claims"), found))


def _claim(item: Column) -> Column:
    """A claim's object: the item, what an item's string holds, or null for an item without text. A bare string stays one."""

    def read(v: Column) -> Column:
        inner = F.when(F.ltrim(_string(v)).startswith("{"), F.try_parse_json(_string(v)))
        held = F.when((_shape(inner) == "OBJECT") & ~_blank(_at(inner, "text")), inner)
        return F.when(_shape(v) == "STRING", F.when(~_blank(v), F.coalesce(held, v))).when((_shape(v) == "OBJECT") & ~_blank(_at(v, "text")), v)

    return _let(item, read)


def _typed(v: Column) -> Column:
    """text, cited_chunk_ids, kind of a claim; a field that cannot be read is null."""
    cited = _at(v, "cited_chunk_ids")
    cited = F.when(cited.isNull() | (_shape(cited) == "VOID"), F.array().cast("array<string>")).when(_shape(cited) == "STRING", F.array(_string(cited))).otherwise(_strings(cited))
    kind = F.coalesce(F.when(_string(_at(v, "kind")).isin(*KINDS), _string(_at(v, "kind"))), F.lit(KINDS[0]))
    return F.when(_shape(v) == "STRING", F.struct(_string(v).alias("text"), F.array().cast("array<string>").alias("cited_chunk_ids"), F.lit(KINDS[0]).alias("kind"))).otherwise(
        F.struct(_string(_at(v, "text")).alias("text"), cited.alias("cited_chunk_ids"), kind.alias("kind"))
    )


def answer(raw: Column) -> Column:
    """``summary, claims`` of an answer, whatever envelope it came in; null if unusable.

    Items without text go; a claim whose text is no string or whose citations are no
    strings, and a summary that is neither a string nor empty, spoil the answer.
    """

    def read(d: Column) -> Column:
        claims = F.transform(F.filter(F.transform(_claims(d), _claim), lambda v: v.isNotNull()), _typed)
        told = _at(d, "summary")
        summary = F.when(_true(told), _string(told)).otherwise("")
        broken = F.exists(claims, lambda c: c["text"].isNull() | c["cited_chunk_ids"].isNull())
        return F.when(summary.isNotNull() & ~broken, F.struct(summary.alias("summary"), claims.alias("claims")))

    return _let(_data(raw), read)


# --- the other kinds


def _entries(raw: Column, key: str, named: tuple[str, ...], optional: tuple[str, ...]) -> Column:
    """The objects of a list in which all ``named`` are told, as strings; empty if one of them holds anything but strings."""
    rows = F.filter(_list(_at(F.try_parse_json(raw), key)), lambda e: F.coalesce((_shape(e) == "OBJECT") & ~_any(_blank(_at(e, n)) for n in named), F.lit(False)))
    read = lambda e: F.struct(*[_string(_at(e, n)).alias(n) for n in named], *[F.when(_at(e, n).isNull(), "").otherwise(_string(_at(e, n))).alias(n) for n in optional])
    fields = ",".join(f"{n}:string" for n in (*named, *optional))
    none = F.array().cast(f"array<struct<{fields}>>")
    return _let(F.transform(rows, read), lambda r: F.coalesce(F.when(~F.exists(r, lambda e: _any(e[n].isNull() for n in (*named, *optional))), r), none))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def verdicts(raw: Column) -> Column:
    """``claim_id, verdict, reason`` of the entries that name a claim."""
    return _entries(raw, "verdicts", ("claim_id",), ("verdict", "reason"))


def questions(raw: Column) -> Column:
    """``chunk_id, question`` of the items that have both."""
    return _entries(raw, "items", ("chunk_id", "question"), ())


def assessment(raw: Column) -> Column:
    """``decision, new_query, reason`` as strings, empty where there is none; other values as they are written in JSON."""

    def read(d: Column) -> Column:
        plain = lambda v: F.when(v.isNull() | (_shape(v) == "VOID"), "").when(_shape(v) == "STRING", _string(v)).otherwise(F.to_json(v))
        return F.struct(*[_let(_at(d, n), plain).alias(n) for n in ("decision", "new_query", "reason")])

    return _let(F.try_parse_json(raw), read)


_QUERY = "struct<op:string,metric:string,fy:int,years:int,tickers:array<string>>"


def _query(q: Column) -> Column:
    """A numeric query; null if a field cannot be read. Whole numbers may be strings."""

    def number(name: str) -> Column:
        v = _at(q, name)
        value = F.try_variant_get(v, "$", "double")
        return F.when(v.isNull() | (_shape(v) == "VOID"), F.lit(None).cast("int")).when(value == F.floor(value), value.cast("int")), v.isNotNull() & (_shape(v) != "VOID") & F.coalesce(value != F.floor(value), F.lit(True))

    (fy, bad_fy), (years, bad_years) = number("fy"), number("years")
    op = F.when(_at(q, "op").isNull(), "value").otherwise(_string(_at(q, "op")))
    tickers = F.when(_at(q, "tickers").isNull(), F.array().cast("array<string>")).otherwise(_strings(_at(q, "tickers")))
    metric = _string(_at(q, "metric"))
    whole = op.isNotNull() & metric.isNotNull() & tickers.isNotNull() & ~bad_fy & ~bad_years
    return F.when(whole, F.struct(op.alias("op"), metric.alias("metric"), fy.alias("fy"), years.alias("years"), tickers.alias("tickers")).cast(_QUERY))


def route(raw: Column) -> Column:
    """``route, queries, companies, refusal, fully_answers``: narrative with nothing else if there is no payload, or one of its queries cannot be read; queries without a metric go."""

    def read(d: Column) -> Column:
        route_ = F.coalesce(F.when(_string(_at(d, "route")).isin(*ROUTES), _string(_at(d, "route"))), F.lit(ROUTES[0]))
        queries = F.transform(F.filter(F.coalesce(_list(_at(d, "queries")), F.array().cast(_NONE)), lambda q: F.coalesce((_shape(q) == "OBJECT") & _true(_at(q, "metric")), F.lit(False))), _query)
        names = F.transform(F.filter(F.coalesce(_list(_at(d, "companies")), F.array().cast(_NONE)), lambda c: F.coalesce((_shape(c) == "STRING") & ~_blank(c), F.lit(False))), lambda c: F.upper(F.regexp_replace(_string(c), r"^\s+|\s+$", "")))
        refusal = F.coalesce(_string(_at(d, "refusal")), F.lit(""))
        told = F.struct(route_.alias("route"), queries.alias("queries"), names.alias("companies"), refusal.alias("refusal"), _true(_at(d, "fully_answers")).alias("fully_answers"))
        nothing = F.struct(F.lit(ROUTES[0]).alias("route"), F.array().cast(f"array<{_QUERY}>").alias("queries"), F.array().cast("array<string>").alias("companies"), F.lit("").alias("refusal"), F.lit(False).alias("fully_answers"))
        return F.when((_shape(d) == "OBJECT") & ~F.exists(queries, lambda q: q.isNull()), told).otherwise(nothing)

    return _let(F.try_parse_json(raw), read)
