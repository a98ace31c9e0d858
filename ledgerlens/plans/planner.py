"""Structured queries to cards: a table of queries in, one plan for each kind of operation, one table of cards out.

A query is ``query_id, cik, ticker, op, metric, fy, years``. Precedence: a derived
name wins over any op; then a ratio's name (or op ``ratio``) over all but average
and series; then the op itself; an unknown op is a value. A query that has no
answer, or is malformed, gives no card.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import registry, render
from ledgerlens.operators import claims, numeric
from ledgerlens.operators.facts import KEY, Points
from ledgerlens.sources.staging import kept

MOST = 6


def route(op: Column, metric: Column) -> Column:
    """Which operation answers; null where none can."""
    ratio, derived, known = metric.isin(*registry.RATIOS), metric.isin(*registry.DERIVED), metric.isin(*registry.METRICS)
    flow = metric.isin(*[m for m, (kind, _, _) in registry.METRICS.items() if kind == "duration"])
    plain = F.coalesce(op, F.lit("value"))
    return (
        F.when(derived, "derived")
        .when((ratio | (plain == "ratio")) & ~plain.isin("average", "series"), F.when(ratio, "ratio"))
        .when(ratio, F.concat(F.lit("ratio_"), plain))
        .when(~known, None)
        .when(plain == "q4", F.when(flow, "q4"))
        .when(plain.isin("yoy", "cagr", "average", "series", "compare"), plain)
        .otherwise("value")
    )


def refused(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """``query_id, error``: why each of ``queries`` (query_id, op, metric) has none among ``cards``: a name nobody knows, an operation that does not apply, or no figures for it."""
    left = queries.select("query_id", "op", "metric").join(cards.select("query_id"), "query_id", "left_anti")
    known = F.col("metric").isin(*registry.METRICS, *registry.RATIOS, *registry.DERIVED)
    plain = F.coalesce("op", F.lit("value"))
    error = F.when(~known, F.concat(F.lit("unknown metric: "), F.coalesce("metric", F.lit("")))).when(route(F.col("op"), F.col("metric")).isNull(), F.concat(plain, F.lit(" does not apply to "), "metric")).otherwise("no figures")
    return left.select("query_id", error.alias("error"))


def capped(queries: DataFrame, by: str, order: str) -> DataFrame:
    """The first six queries of each answer."""
    w = Window.partitionBy(by).orderBy(order)
    return queries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= MOST).drop("_n")


def _fact(x: Column | None = None, prefix: str = "") -> Column:
    """What a source is known by: accession, tag and period."""
    of = (lambda c: F.col(f"{prefix}{c}")) if x is None else (lambda c: x[f"{prefix}{c}"])
    return F.concat_ws("|", of("accn"), of("tag"), of("period_end").cast("string"))


def _current(queries: DataFrame, p: Points) -> DataFrame:
    """Each query with its point: of its year, else the latest."""
    cols = ["cik", "metric", "fy", "value", "unit", "accn", "tag", "period_end"]
    own = queries.where("fy is not null").join(p.years.select(*cols), ["cik", "metric", "fy"])
    new = queries.where("fy is null").drop("fy").join(p.newest.select(*cols), ["cik", "metric"])
    return own.unionByName(new)


def _named(metric: Column) -> Column:
    return F.replace(metric, F.lit("_"), F.lit(" "))


def _in(fy: Column) -> Column:
    return F.concat(F.lit("FY"), fy)


def series_text(points: Column, label: Column, ticker: Column) -> Column:
    """The line of a series (fy, value, unit; ascending): growth at each step, or halted and resumed; then gaps, compound growth, pace and declines."""
    n = F.size(points) - 1

    def growth(i: Column) -> Column:
        now, before = points[i]["value"], points[i - 1]["value"]
        return F.when(((before > 0) & (now == 0)) | (before == 0), None).otherwise((now - before) / F.abs(before))

    def part(x: Column, i: Column) -> Column:
        now, before = x["value"], F.get(points, i - 1)["value"]
        step = F.when(i == 0, "").when((before > 0) & (now == 0), " (halted)").when((before == 0) & (now > 0), " (resumed)").when(before == 0, "").otherwise(F.concat(F.lit(" ("), render.percent((now - before) / F.abs(before), 1, True), F.lit(")")))
        return F.concat(_in(x["fy"]), F.lit(" "), render.amount(now, x["unit"]), step)

    last = F.element_at(points, -1)
    years = F.transform(points, lambda x: x["fy"])
    gaps = F.array_except(F.sequence(F.array_min(years), F.array_max(years)), years)
    compound = F.pow(last["value"] / points[0]["value"], 1 / n) - 1
    now, before = F.when(n >= 2, growth(n)), F.when(n >= 2, growth(n - 1))
    down = F.filter(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: (growth(i) < 0) & (points[i]["value"] > 0))
    extras = F.filter(
        F.array(
            F.when(F.size(gaps) > 0, F.concat(F.array_join(F.transform(gaps, _in), ", "), F.lit(" not in the official data"))),
            F.when((n >= 2) & F.forall(points, lambda x: x["value"] > 0), F.concat(n, F.lit("-yr CAGR "), render.percent(compound, 1, True))),
            F.when(now > before + 0.10, F.concat(F.lit("growth accelerated in "), _in(last["fy"]))).when(now < before - 0.10, F.concat(F.lit("growth slowed in "), _in(last["fy"]))),
            F.when(F.size(down) > 0, F.concat(F.lit("declined in "), F.array_join(F.transform(down, lambda i: _in(points[i]["fy"])), ", "))),
        ),
        lambda x: x.isNotNull(),
    )
    line = F.concat(ticker, F.lit(" "), label, F.lit(": "), F.array_join(F.transform(points, part), "; "))
    return F.concat(line, F.when(F.size(extras) > 0, F.concat(F.lit(" — "), F.array_join(extras, "; "))).otherwise(""))


def execute(queries: DataFrame, p: Points, facts: DataFrame) -> DataFrame:
    """Cards ``query_id, cik, fy, value, text, sources``; a source is ``accession|tag|period's end``.

    ``queries`` may have ``peers`` (array of cik, ticker), which a comparison ranks; without them it is of the company alone.
    Queries are staged once; what several operations read is one branch of the plan.
    """
    peers = F.col("peers") if "peers" in queries.columns else F.lit(None).cast("array<struct<cik:bigint,ticker:string>>")
    q = queries.select("query_id", "cik", "ticker", "op", "metric", F.col("fy").cast("int").alias("fy"), F.col("years").cast("int").alias("years"), peers.alias("peers"))
    q = kept(q.withColumn("path", route(F.col("op"), F.col("metric"))).where("path is not null"), "asked")
    who = F.concat(F.col("ticker"), F.lit(" "), _named(F.col("metric")), F.lit(" "))
    own = ("query_id", "cik", "ticker", "metric", "path")
    out = []

    def of(*paths: str) -> DataFrame:
        return q.where(F.col("path").isin(*paths))

    def done(df: DataFrame, fy: Column, value: Column, text: Column, sources: Column) -> None:
        out.append(df.select("query_id", "cik", fy.cast("int").alias("fy"), value.cast("double").alias("value"), text.alias("text"), sources.alias("sources")).where("text is not null"))

    # a value, and its growth over the year before
    before = p.years.select("cik", "metric", (F.col("fy") + 1).alias("fy"), *[F.col(c).alias(f"p_{c}") for c in ("value", "accn", "tag", "period_end")])
    cur = _current(of("value", "yoy"), p).join(before, ["cik", "metric", "fy"], "left")
    growth = F.when(F.col("p_value") != 0, (F.col("value") - F.col("p_value")) / F.abs("p_value"))
    money = render.amount(F.col("value"), F.col("unit"))
    grown = F.concat(who, _in(F.col("fy")), F.lit(": "), money, F.lit(", "), render.percent(growth, 1, True), F.lit(" YoY ("), _in(F.col("fy") - 1), F.lit(": "), render.amount(F.col("p_value"), F.col("unit")), F.lit(")"))
    plain = F.concat(F.col("ticker"), F.lit(" "), render.label(F.col("metric"), F.col("tag")), F.lit(" "), _in(F.col("fy")), F.lit(": "), money)
    is_value = F.col("path") == "value"
    done(cur, F.col("fy"), F.when(is_value, F.col("value")).otherwise(growth), F.when(is_value, plain).otherwise(grown), F.when(is_value, F.array(_fact())).otherwise(F.array(_fact(), _fact(prefix="p_"))))

    # what looks back from the latest year: average, series, compound growth
    point = F.struct("fy", "value", "unit", "accn", "tag", "period_end")
    asked = of("average", "series", "cagr").drop("fy").withColumn("span", F.when(F.col("path") == "cagr", F.coalesce("years", F.lit(3)) + 1).otherwise(F.coalesce("years", F.lit(5))))
    latest = asked.join(p.newest.select("cik", "metric", F.col("fy").alias("base"), point.alias("newest")), ["cik", "metric"])
    older = latest.select(*own, "base", "span").join(p.years.select("cik", "metric", "fy", point.alias("x")), ["cik", "metric"]).where("fy < base and fy > base - span")
    pts = latest.select(*own, "span", F.col("newest").alias("x")).unionByName(older.select(*own, "span", "x")).groupBy(*own, "span").agg(F.array_sort(F.collect_list("x")).alias("pts"))
    x, first, last = F.col("pts"), F.col("pts")[0], F.element_at("pts", -1)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v["value"]) / F.size(x)
    average = F.concat(who, F.size(x), F.lit("-year average ("), _in(first["fy"]), F.lit("–"), _in(last["fy"]), F.lit("): "), render.amount(mean, last["unit"]))
    back = F.col("span") - 1
    ends = (first["fy"] == last["fy"] - back) & (first["value"] > 0) & (last["value"] > 0)
    rate = F.when(ends, F.pow(last["value"] / first["value"], 1 / back) - 1)
    compound = F.concat(who, back, F.lit("-year CAGR: "), render.percent(rate, 2, True), F.lit(" ("), _in(first["fy"]), F.lit(" "), render.amount(first["value"], first["unit"]), F.lit(" → "), _in(last["fy"]), F.lit(" "), render.amount(last["value"], last["unit"]), F.lit(")"))
    path = F.col("path")
    line = series_text(x, render.label(F.col("metric"), last["tag"]), F.col("ticker"))
    both = F.when(path == "cagr", F.array(_fact(last), _fact(first))).otherwise(F.transform(x, lambda v: _fact(v)))
    done(pts, last["fy"], F.when(path == "average", mean).when(path == "cagr", rate).otherwise(last["value"]), F.when(path == "average", average).when(path == "cagr", compound).otherwise(line), both)

    # ratios: of one year, their mean, their trend
    asked = of("ratio", "ratio_average", "ratio_series")
    ratio = F.struct("fy", F.col("value").alias("r"), *[f"{n}_{c}" for n in ("num", "den") for c in ("value", "unit", "accn", "tag")], F.col("num_end").alias("num_period_end"), F.col("den_end").alias("den_period_end"))
    wanted = numeric.ratios(p).join(asked.select("cik", F.col("metric").alias("ratio")).distinct(), ["cik", "ratio"], "left_semi").select("cik", F.col("ratio").alias("metric"), "newest", ratio.alias("x"))
    got = asked.join(wanted, ["cik", "metric"]).groupBy(*own, "fy", "years").agg(F.max(F.when(F.col("newest"), F.col("x"))).alias("new"), F.array_sort(F.collect_list(F.when(~F.col("newest"), F.col("x")))).alias("all"))
    got = got.withColumn("one", F.when(F.col("fy").isNull(), F.col("new")).otherwise(F.get(F.filter("all", lambda v: v["fy"] == F.col("fy")), F.lit(0)))).where("one is not null")
    got = got.withColumn("run", F.filter("all", lambda v: (v["fy"] <= F.col("one.fy")) & (v["fy"] > F.col("one.fy") - F.coalesce("years", F.lit(5)))))
    one, run = F.col("one"), F.col("run")
    parts = lambda v: F.array(_fact(v, "num_"), _fact(v, "den_"))
    single = F.when(numeric.sane(one["r"]), F.concat(who, _in(one["fy"]), F.lit(": "), render.percent(one["r"]), F.lit(" (= "), render.amount(one["num_value"], one["num_unit"]), F.lit(" / "), render.amount(one["den_value"], one["den_unit"]), F.lit(")")))
    first, last = run[0], F.element_at(run, -1)
    mean = F.when(F.size(run) > 0, F.aggregate(run, F.lit(0.0), lambda a, v: a + v["r"]) / F.size(run))
    detail = F.array_join(F.transform(run, lambda v: F.concat(_in(v["fy"]), F.lit(" "), render.percent(v["r"]))), "; ")
    average = F.when(F.size(run) > 0, F.concat(who, F.size(run), F.lit("-year average ("), _in(first["fy"]), F.lit("–"), _in(last["fy"]), F.lit("): "), render.percent(mean), F.lit(" ("), detail, F.lit(")")))
    total = (last["r"] - first["r"]) * 100
    steps = F.array_join(F.transform(run, lambda v, i: F.concat(_in(v["fy"]), F.lit(" "), render.percent(v["r"]), F.when(i == 0, "").otherwise(F.concat(F.lit(" ("), render.points_change((v["r"] - F.get(run, i - 1)["r"]) * 100), F.lit(")"))))), "; ")
    trend = F.when(F.exists(run, lambda v: F.abs(v["r"]) >= 0.0005), F.concat(who, F.lit("trend: "), steps, F.lit(" — "), render.points_change(total), F.lit(" over "), F.size(run) - 1, F.lit(" years")))
    value = F.when(path == "ratio", one["r"]).when(path == "ratio_average", mean).otherwise(total)
    done(got, F.when(path == "ratio", one["fy"]).otherwise(last["fy"]), value, F.when(path == "ratio", single).when(path == "ratio_average", average).otherwise(trend), F.when(path == "ratio", parts(one)).otherwise(F.flatten(F.transform(run, parts))))

    # derived formulas: their first component's year, all of them from one row for each company and year
    firsts = F.element_at(F.create_map(*[F.lit(v) for n, (c, *_) in registry.DERIVED.items() for v in (n, c[0])]), F.col("metric"))
    asked = of("derived").withColumn("name", F.col("metric")).withColumn("metric", firsts)
    cur = _current(asked, p).withColumn("c0", F.struct("metric", "value", "unit", "accn", "tag", "period_end")).drop("metric", "value", "unit", "accn", "tag", "period_end").withColumnRenamed("name", "metric")
    met = cur.join(numeric.components(p), ["cik", "fy"])
    some, unit, remark, value = F.lit(None), F.lit(None), F.lit(None), F.lit(None)
    for name, (names, formula, u, note) in registry.DERIVED.items():
        mine = F.col("metric") == name
        points = F.array(F.col("c0"), *[F.col(f"`{c}`") for c in names[1:]])
        some, unit, remark = F.when(mine, points).otherwise(some), F.when(mine, u).otherwise(unit), F.when(mine, note).otherwise(remark)
        value = F.when(mine, F.expr(formula.format(*(f"points[{i}].value" for i in range(len(names)))))).otherwise(value)
    met = met.withColumn("points", some).where(F.forall("points", lambda x: x.isNotNull())).withColumns({"unit": unit, "remark": remark}).withColumn("result", value).where("result is not null")
    listed = F.array_join(F.transform("points", lambda x: F.concat(_named(x["metric"]), F.lit(" "), render.amount(x["value"], x["unit"]))), ", ")
    done(met, F.col("fy"), F.col("result"), F.concat(who, _in(F.col("fy")), F.lit(": "), render.amount(F.col("result"), F.col("unit")), F.lit(" (= "), F.col("remark"), F.lit("; "), listed, F.lit(")")), F.transform("points", lambda v: _fact(v)))

    # the quarter that is not reported, only for the companies and metrics asked
    asked = of("q4")
    keys = asked.select("cik", "metric").distinct()
    only = Points.__new__(Points)
    only.years, only.newest, only.periods = p.years.join(keys, ["cik", "metric"], "left_semi"), p.newest, p.periods
    q4 = numeric.fourth_quarter(facts.join(keys.select("cik").distinct(), "cik", "left_semi"), only).select("cik", "metric", F.col("fy").alias("of"), "q4", "unit", "accn", "tag", "period_end")
    got = asked.join(p.newest.select("cik", "metric", F.col("fy").alias("newest")), ["cik", "metric"]).join(q4, ["cik", "metric"]).where("of = coalesce(fy, newest)")
    done(got, F.col("of"), F.col("q4"), F.concat(who, _in(F.col("of")), F.lit(" Q4 (derived): "), render.amount(F.col("q4"), F.col("unit")), F.lit(" — Q4 = FY − Q1 − Q2 − Q3 (computed; Q4 is not reported)")), F.array(_fact()))

    # a ranking of peers
    asked = of("compare")
    each = asked.withColumn("peer", F.explode(F.when(F.size("peers") > 1, F.col("peers")).otherwise(F.array(F.struct("cik", "ticker"))))).select("query_id", F.col("cik").alias("asker"), "metric", "fy", F.col("peer.cik").alias("cik"), F.col("peer.ticker").alias("ticker"))
    ranked = _current(each, p).groupBy("query_id", F.col("asker").alias("cik"), "metric").agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("down"), F.col("cik").alias("peer"), "ticker", "fy", "value", "unit", "accn", "tag", "period_end"))).alias("pts"))
    row = F.transform("pts", lambda v: F.concat(v["ticker"], F.lit(" "), _in(v["fy"]), F.lit(" "), render.amount(v["value"], v["unit"])))
    done(ranked, F.col("pts")[0]["fy"], F.col("pts")[0]["value"], F.concat(_named(F.col("metric")), F.lit(" comparison: "), F.array_join(row, "; ")), F.transform("pts", lambda v: _fact(v)))

    return reduce(DataFrame.unionByName, out)


def scoped(queries: DataFrame, facts: DataFrame) -> tuple[DataFrame, Points, DataFrame]:
    """Queries with ``scope_cik, scope_accn``, and the points and facts they may use: those of that one filing, as it prints them.

    A filing stands for a company of its own, so all scopes are answered by one plan; ``cik`` of what comes out is the filing's key.
    """
    key = F.xxhash64("scope_cik", "scope_accn")
    wanted = queries.select(F.col("scope_cik").alias("cik"), F.col("scope_accn").alias("accn")).distinct()
    own = facts.join(wanted, ["cik", "accn"], "left_semi").withColumn("cik", F.xxhash64("cik", "accn"))
    rest = [c for c in own.columns if c not in KEY]
    printed = own.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("val", "filed")).alias("one")).select(*KEY, "one.*")
    return queries.withColumn("cik", key), Points(printed), printed


def answered(queries: DataFrame, p: Points, facts: DataFrame) -> DataFrame:
    """Cards of whole answers: ``queries`` with ``answer_id`` and ``pos``; ``scope_cik, scope_accn`` hold an answer to one filing.

    The first six queries of an answer count. Cards that don't reach the company's
    latest revenue year go unless their query names a year or the answer is held to a
    filing, then cards that another card's sources contain.
    """
    q = capped(queries, "answer_id", "pos").withColumn("query_id", F.concat_ws("#", "answer_id", F.lpad(F.col("pos").cast("string"), 3, "0")))
    known = q.select("query_id", "answer_id", F.col("cik").alias("of"), F.col("fy").isNotNull().alias("fy_given"))
    if "scope_accn" in queries.columns:
        free, held = q.where("scope_accn is null").drop("scope_cik", "scope_accn"), q.where("scope_accn is not null")
        asked, points, only = scoped(held, facts)
        cards = execute(free, p, facts).withColumn("held", F.lit(False)).unionByName(execute(asked.drop("scope_cik", "scope_accn"), points, only).withColumn("held", F.lit(True)))
    else:
        cards = execute(q, p, facts).withColumn("held", F.lit(False))
    cards = kept(cards.drop("cik").join(known, "query_id").withColumnRenamed("of", "cik"), "cards")
    ends = F.transform("sources", lambda s: F.to_date(F.element_at(F.split(s, r"\|"), -1)))
    fresh = claims.drop_stale(cards.withColumns({"source_ends": ends, "fy_given": F.col("fy_given") | F.col("held")}), p.newest.where("metric = 'revenue'"))
    left = claims.subsume(fresh.select(F.col("answer_id").alias("query_id"), F.col("query_id").alias("card_id"), "text", "sources"))
    return fresh.join(left.select(F.col("card_id").alias("query_id")), "query_id", "left_semi").select("answer_id", "query_id", "cik", "fy", "value", "text", "sources")
