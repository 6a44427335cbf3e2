import pytest
from pyspark.sql import functions as F

from inkmeter.plans.article import article_scores
from inkmeter.profiles import LATIN
from inkmeter.sources import history, versions
from inkmeter.sources.history import newest
from inkmeter.streaming import jobs
from inkmeter.streaming.jobs import log_stream, newest_stream, read_newest, score_stream


def test_score_stream_equals_batch(spark, docs, tmp_path):
    data = docs("The cat sat on the mat. It was warm.", "Not a cat but a dog ran by.", "")
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    data.repartition(2).write.parquet(src)
    score_stream(spark, src, "doc_id bigint, text string", log, str(tmp_path / "cp"), LATIN).awaitTermination()
    got = spark.read.parquet(log).select("doc_id", "score").orderBy("doc_id").collect()
    assert got == article_scores(data, LATIN).select("doc_id", "score").orderBy("doc_id").collect()


def test_newest_stream_equals_batch(spark, tmp_path):
    src, target, cp = (str(tmp_path / n) for n in ("in", "newest", "cp"))
    schema = "user_id bigint, id bigint, ts timestamp"
    rows = spark.range(100).select((F.col("id") % 3).alias("user_id"), "id", F.timestamp_seconds((F.col("id") * 37) % 100).alias("ts"))
    for lo, hi in ((0, 60), (60, 100)):
        rows.where(f"id >= {lo} AND id < {hi}").write.mode("append").parquet(src)
        newest_stream(spark, src, schema, target, cp, "user_id", "ts", "id", 5).awaitTermination()
    got = {tuple(r) for r in read_newest(spark, target, schema).select("user_id", "id").collect()}
    want = {tuple(r) for r in newest(rows, "user_id", "ts", "id", 5).select("user_id", "id").collect()}
    assert got == want


SCHEMA = "user_id bigint, doc_id bigint, text string, title string, created_at timestamp"


def arrivals(spark):
    texts = ["The cat sat on the mat. It was warm.", "Not a cat but a dog ran by.", "", None, "The cat sat on the mat. It was warm."]
    rows = [(i % 3, 0 if i == 4 else i, t, "" if i % 2 else None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, 9, "No user at all.", "t", None)], SCHEMA)


def log_rows(spark, log):
    return sorted(map(tuple, history.read_log(spark, log).collect()), key=repr)


def test_log_stream_writes_the_log(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    arrivals(spark).repartition(3).write.parquet(src)
    log_stream(spark, src, SCHEMA, log, str(tmp_path / "cp"), LATIN).awaitTermination()
    got = history.read_log(spark, log)
    assert got.columns == [x.split()[0] for x in history.LOG_SCHEMA.split(", ")] and got.count() == 7
    assert got.select("record_id").distinct().count() == 7 and got.where("created_at is null or time is null").count() == 0
    assert {r.status for r in got.collect()} == {LATIN.texts["status_detect"]} and {r.title for r in got.collect()} == {LATIN.texts["untitled"], "t"}
    want = article_scores(arrivals(spark).select(F.struct("user_id", "doc_id").alias("doc_id"), "text"), LATIN).select("doc_id.user_id", "score", "word_count")
    assert sorted(map(repr, got.select("user_id", "score", "word_count").collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("at", ["before the switch", "after the switch"])
def test_log_stream_stopped_and_run_again(spark, tmp_path, monkeypatch, at):
    """A batch that dies around the switch of the table is run again: the same rows, once."""
    src, log, cp, other = (str(tmp_path / n) for n in ("in", "log", "cp", "other"))
    arrivals(spark).limit(4).write.parquet(src)
    log_stream(spark, src, SCHEMA, log, cp, LATIN).awaitTermination()
    first = log_rows(spark, log)
    arrivals(spark).withColumn("doc_id", F.col("doc_id") + 100).write.mode("append").parquet(src)
    real = versions.publish

    def dies(*args):
        if at == "after the switch":
            real(*args)
        raise RuntimeError("killed")

    monkeypatch.setattr(versions, "publish", dies)
    query = log_stream(spark, src, SCHEMA, log, cp, LATIN)
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    assert len(log_rows(spark, log)) == (len(first) if at == "before the switch" else len(first) + 7)
    seen = log_rows(spark, log)
    monkeypatch.setattr(versions, "publish", real)
    log_stream(spark, src, SCHEMA, log, cp, LATIN).awaitTermination()
    again = log_rows(spark, log)
    assert len(again) == len(first) + 7 and set(first) < set(again) and set(seen) <= set(again)
    log_stream(spark, src, SCHEMA, log, cp, LATIN).awaitTermination()
    assert log_rows(spark, log) == again


def payload(spark, n, first=0):
    return spark.range(first, first + n).select((F.col("id") % 20).alias("user_id"), F.timestamp_seconds("id").alias("created_at"), F.concat(F.lit("t"), "id").alias("title"))


def test_a_crash_never_shows_half_a_clearing(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    history.append_log(history.log_records(payload(spark, 60), LATIN), log)
    before = log_rows(spark, log)
    gone = spark.createDataFrame([(3,), (5,), (None,)], "user_id bigint")
    for step in ("move", "publish"):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(versions, step, lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
            history.clear_history(spark, log, gone)
        assert log_rows(spark, log) == before, step
    history.clear_history(spark, log, gone)
    assert log_rows(spark, log) == [r for r in before if r[0] not in (3, 5)]
    versions.vacuum(spark, log, history.LOG_SCHEMA)
    assert log_rows(spark, log) == [r for r in before if r[0] not in (3, 5)]
    assert len(list((tmp_path / "log" / "data").iterdir())) == 1 and len([x for x in (tmp_path / "log" / "_versions").iterdir() if x.suffix == ".json" and x.name[0] != "."]) == 1
    history.append_log(history.log_records(payload(spark, 3, 100), LATIN), log)
    assert len(log_rows(spark, log)) == len(before) - 6 + 3


def test_the_second_of_two_writers_tries_again(spark, tmp_path, monkeypatch):
    """While a clearing is made, rows of the same users' buckets arrive: none of them is lost."""
    log = str(tmp_path / "log")
    history.append_log(history.log_records(payload(spark, 60), LATIN), log)
    real, calls = versions.publish, []

    def late(session, path, new):
        calls.append(new["version"])
        if len(calls) == 1:  # another writer comes first
            assert real(session, path, {**versions.state(session, path), "version": new["version"]})
            monkeypatch.setattr(versions, "publish", real)
            history.append_log(history.log_records(payload(spark, 20, 200), LATIN), log)
            monkeypatch.setattr(versions, "publish", late)
        return real(session, path, new)

    monkeypatch.setattr(versions, "publish", late)
    history.clear_history(spark, log, spark.createDataFrame([(3,)], "user_id bigint"))
    left = history.read_log(spark, log)
    assert left.count() == 80 - 4 and left.where("user_id = 3").count() == 0 and left.select("record_id").distinct().count() == 76
    assert len(calls) >= 2
