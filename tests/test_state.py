"""What lasts: numbered rows, committed versions, streams that are resumed, bounded caches, cases with their errors."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import benchmarks, evals, numbering
from ledgerlens.plans import answers
from ledgerlens.sources import staging, versions
from ledgerlens.streaming import events


def test_places_are_dense_and_the_same_on_every_run(spark):
    rows = spark.range(0, 3000, 1, 7).select("id", (F.col("id") % 11).alias("x"))
    want = sorted(range(3000), key=lambda i: (-(i % 11), i))
    for some in (rows, rows.repartition(3)):
        got = numbering.numbered(some, F.desc("x"), "id").orderBy("place").collect()
        assert [r.place for r in got] == list(range(1, 3001)) and [r.id for r in got] == want
    same = numbering.numbered(rows.select(F.lit(1).alias("x"), F.lit(None).cast("string").alias("n")), "x")
    assert same.agg(F.count("*"), F.countDistinct("place"), F.max("place")).first() == (3000, 3000, 3000)
    assert numbering.numbered(rows.limit(0), "id").columns == ["id", "x", "place"] and numbering.numbered(rows.limit(0), "id").count() == 0
    batches = {r.batch: r["count"] for r in numbering.batched(rows, 60, "id").groupBy("batch").count().collect()}
    assert batches == {i: 60 for i in range(50)}
    assert [r.place for r in benchmarks.ordered(rows.limit(5), "id").orderBy("id").collect()] == [1, 2, 3, 4, 5]
    assert "SinglePartition" not in numbering.numbered(rows, "id")._jdf.queryExecution().optimizedPlan().toString()


def test_calls_of_sixty_texts(spark):
    class Strict(answers.RuleProvider):
        def boilerplate(self, texts):
            assert len(texts) in (60, 25)
            if "t0000" in texts:
                raise RuntimeError("down")
            return [t.endswith("7") for t in texts] if "t0100" not in texts else [True]

    claims = spark.range(0, 205, 1, 9).select(F.format_string("c%04d", "id").alias("claim_id"), F.format_string("t%04d", "id").alias("text"))
    got = {r.claim_id: (r.batch, r.boilerplate) for r in answers.boilerplate(claims, Strict()).collect()}
    # the first call fails, the second has another number of answers
    assert got == {f"c{i:04}": (i // 60, i >= 120 and i % 10 == 7) for i in range(205)}


def test_versions_are_committed_or_not(spark, tmp_path):
    mk = lambda *rows: spark.createDataFrame(rows, "k int, v string, s int")
    t = versions.Table(spark, str(tmp_path / "t"), ["k"], 4)
    assert t.version() == 0 and t.read() is None
    assert t.upsert(mk((1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "n", 0)), "s") == 1
    first = t.read()
    assert t.upsert(mk((2, "d", 0), (3, "y", 1), (3, "x", 1), (3, "z", 0), (None, "m", 0)), "s") == 2
    assert {tuple(r) for r in t.read().select("k", "v", "s").collect()} == {(1, "b", 2), (2, "d", 0), (3, "y", 1), (None, "m", 0)}
    # a reader of the first version still reads it
    assert {tuple(r) for r in first.select("k", "v", "s").collect()} == {(1, "b", 2), (2, "c", 1), (None, "n", 0)}
    # a write that fails in its midst changes nothing
    broken = mk((1, "new", 9), (7, "q", 9)).withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        t.upsert(broken, "s")
    assert t.version() == 2 and t.read().where("v = 'new'").count() == 0
    # two writers of one version
    other = versions.Table(spark, str(tmp_path / "t"), ["k"], 4)
    found = other.manifest()
    assert t.insert_absent(mk((1, "no", 5), (8, "late", 2), (8, "early", 1), (None, "no", 7)), "s") == 3
    with pytest.raises(versions.Conflict):
        other._commit(3, found)
    assert (8, "early", 1) in {tuple(r) for r in t.read().select("k", "v", "s").collect()} and t.read().where("k = 1").first().v == "b"
    assert t.insert_absent(mk((8, "again", 0)), "s") == 3 and t.version() == 3
    # untouched buckets are carried over by name
    before, touched = t.manifest()["folders"], {r[0] for r in t._dealt(mk((1, "x", 0))).select("_bucket").collect()}
    t.upsert(mk((1, "x", 0)), "s")
    after = t.manifest()["folders"]
    assert {b for b in after if after[b] != before.get(b)} == {str(b) for b in touched}
    folders = len(os.listdir(tmp_path / "t"))
    want = sorted(map(str, t.read().collect()))
    assert t.vacuum() > 0 and len(os.listdir(tmp_path / "t")) < folders and sorted(map(str, t.read().collect())) == want
    empty = versions.Table(spark, str(tmp_path / "e"), ["k"])
    assert empty.upsert(mk((1, "a", 0)).limit(0), "s") == 1 and empty.read().count() == 0 and empty.insert_absent(mk((1, "a", 0)), "s") == 2


def log(path, name, *rows):
    path.mkdir(exist_ok=True)
    (path / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\nnot json\n\n")


def call(ts, query, stage, event="llm_call"):
    return {"ts": f"2024-01-01T{ts}:00Z", "event": event, "query_id": query, "stage": stage}


def test_progress_over_a_restart(spark, tmp_path):
    """Each stage of the own queries once, though they come again after a restart; other queries, events and stages without a label are not told."""
    at, out = tmp_path / "log", str(tmp_path / "out")

    def run():
        events.to_batches(events.progress(events.tail(spark, str(at)), "ui", "10 hours"), out, str(tmp_path / "cp")).awaitTermination()

    log(at, "a", call("10:00", "ui1", "route"), call("10:01", "ui1", "route"), call("10:01", "q9", "route"), call("10:02", "ui1", "odd"), call("10:02", "ui1", "verify", "done"))
    run()
    log(at, "b", call("10:03", "ui1", "route"), call("10:04", "ui1", "generate"), call("10:05", "ui2", "route"))
    run()
    run()
    got = spark.read.parquet(out).select("query_id", "stage", "label").collect()
    assert sorted(map(tuple, got)) == [("ui1", "generate", "Writing claims"), ("ui1", "route", "Routing the question"), ("ui2", "route", "Routing the question")]


def test_sessions_over_a_restart_and_late_events(spark, tmp_path):
    at, out = tmp_path / "log", str(tmp_path / "out")
    seen = lambda ts, who: {"ts": f"2024-01-0{ts}:00Z", "visitor": who}

    def run():
        events.to_batches(events.sessions(events.tail(spark, str(at), "ts timestamp, visitor string"), late="1 hour"), out, str(tmp_path / "cp")).awaitTermination()

    log(at, "a", seen("1T10:00", "x"), seen("1T10:20", "x"), seen("1T10:10", "y"))
    run()
    log(at, "b", seen("1T10:40", "x"), seen("1T11:30", "x"), seen("1T10:25", "y"), {"ts": None, "visitor": "x"}, seen("1T12:00", None))
    run()
    log(at, "c", seen("2T10:00", "end"))
    run()
    log(at, "d", seen("1T10:30", "y"), seen("3T10:00", "end"))  # a day late
    run()
    got = {(r.visitor, str(r.start)[11:16], str(r["last"])[11:16], r.n) for r in spark.read.parquet(out).where("visitor <> 'end'").collect()}
    assert got == {("x", "10:00", "10:40", 3), ("x", "11:30", "11:30", 1), ("y", "10:10", "10:25", 2)}


def test_a_batch_that_is_run_again_is_written_once(spark, tmp_path):
    """As after a loss between a batch's write and its commit: the checkpoint forgets the commit, the batch runs anew."""
    at, out, cp = tmp_path / "log", str(tmp_path / "out"), tmp_path / "cp"
    log(at, "a", call("10:00", "ui1", "route"), call("10:01", "ui2", "route"))
    run = lambda: events.to_batches(events.tail(spark, str(at)).select("query_id"), out, str(cp)).awaitTermination()
    run()
    for f in (cp / "commits").glob("*0*"):
        f.unlink()
    for f in (cp / "commits").glob(".*"):
        f.unlink()
    run()
    assert sorted(r.query_id for r in spark.read.parquet(out).where("query_id is not null").collect()) == ["ui1", "ui2"]


def test_caches_are_bounded_and_their_files_go(spark, tmp_path):
    kept_before, spark_dir = dict(staging._INGESTED), f"{staging.folder(spark)}/ledgerlens"
    source = tmp_path / "src"
    source.mkdir()
    staging._INGESTED.clear()
    try:
        for i in range(5):
            staging.ingested(spark, str(source), f"bounded{i % 4}", lambda: spark.range(3), most=2, grace=0)
        assert [k[2] for k in staging._INGESTED] == ["bounded3", "bounded0"]
        names = lambda: sorted(n.split("-")[0] for n in os.listdir(spark_dir) if n.startswith("bounded"))
        assert names() == ["bounded0", "bounded3"]
        staging.ingested(spark, str(source), "bounded3", lambda: spark.range(3), most=2, grace=0)
        assert [k[2] for k in staging._INGESTED] == ["bounded0", "bounded3"]
        (source / "x").write_text("more")  # ingestion has changed the source
        staging.ingested(spark, str(source), "bounded3", lambda: spark.range(4), most=2, grace=0)
        assert names() == ["bounded0", "bounded3"]
        staging.forget(str(source))
        staging._swept(spark, 2, 0)
        assert names() == []
        with staging.scratch(spark):
            assert staging.kept(spark.range(5), "scratched").count() == 5
            assert any(n.startswith("scratched") for n in os.listdir(spark_dir))
        assert not any(n.startswith("scratched") for n in os.listdir(spark_dir))
    finally:
        staging._INGESTED.clear()
        staging._INGESTED.update(kept_before)


def test_cases_with_attempts_and_errors(spark):
    class Unsure(answers.RuleProvider):
        def grade(self, question, expected, got):
            if "grader" in question:
                raise RuntimeError("grader down")
            return "no idea" if "odd" in question else super().grade(question, expected, got)

    def respond():
        seen = set()

        def run(question):
            if "twice" in question or ("once" in question and question not in seen):
                seen.add(question)
                raise TimeoutError(question)
            return None if "nothing" in question else f"it is {question}"

        return run

    rows = [("plain", "plain"), ("twice", "x"), ("once", "once"), ("nothing", "x"), ("grader", "x"), ("odd", "odd"), ("plain", "else")]
    got = answers.run_cases(spark.createDataFrame(rows, "question string, expected string"), respond(), Unsure())
    told = [(r.question, r.outcome.grade, r.outcome.error, r.outcome.attempts) for r in got.collect()]
    assert told == [("plain", "correct", None, 1), ("twice", "crash", "TimeoutError: twice", 2), ("once", "correct", None, 2), ("nothing", "abstain", None, 1), ("grader", "incorrect", "RuntimeError: grader down", 1), ("odd", "incorrect", None, 1), ("plain", "incorrect", None, 1)]
    total = evals.benchmark_summary(got.select(F.lit("t").alias("question_type"), "outcome.grade")).where("question_type is null").first()
    assert (total.total, total.crash, total.correct, total.incorrect, total.abstain) == (7, 1, 2, 3, 1)
