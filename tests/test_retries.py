import json

import pytest
from pyspark.sql import functions as F

from shelfrate.streaming.retries import MessageLog, drain, final_outcomes, handle_batch, start_message_stream


def process(good):
    """A message fails until its attempt number passes k."""
    return good.select("message_id", F.when(F.col("attempts") <= F.col("message.k"), F.lit("busy")).alias("error"))


def body(k):
    return json.dumps({"k": k})


# id: (body, outcome, attempts, reason)
CASES = {"a": (body(0), "OK", 1, None), "b": (body(1), "OK", 2, None), "c": (body(2), "OK", 3, None),
         "d": (body(3), "DEAD_LETTER", 3, "busy"), "e": ('{"k": 1', "DEAD_LETTER", 1, "MALFORMED_JSON"),
         "f": (None, "DEAD_LETTER", 1, "MALFORMED_JSON"), "g": ("{}", "OK", 1, None)}


def outcomes(log):
    return {r.message_id: (r.body, r.outcome, r.attempts, r.reason) for r in final_outcomes(log).collect()}


def frame(spark, ids):
    return spark.createDataFrame([(i, CASES[i][0]) for i in ids] + [(None, body(0))], "message_id string, body string")


@pytest.mark.parametrize("cuts", [["abcdefg"], ["gfe", "dcb", "a"], ["d", "", "abc", "efg"]])
def test_outcomes_do_not_depend_on_micro_batches_and_replays(spark, tmp_path, cuts):
    log = MessageLog(spark, str(tmp_path / "log"))
    assert log.last() == -1
    for n, ids in enumerate(cuts):
        for _ in range(2):  # each micro-batch is run again after a lost commit
            handle_batch(log, frame(spark, ids), n, process)
    drain(log, process)
    assert outcomes(log) == CASES
    rows = sorted(map(tuple, log.rows().collect()), key=str)
    handle_batch(log, frame(spark, "abcdefg").union(frame(spark, "aab")), log.last() + 1, process)  # delivered again
    drain(log, process)
    assert sorted(map(tuple, log.rows().collect()), key=str) == rows


def test_a_failing_message_is_retried_alone(spark, tmp_path):
    log = MessageLog(spark, str(tmp_path / "log"))
    handle_batch(log, frame(spark, "abcg"), 0, process)
    handle_batch(log, frame(spark, ""), 1, process)
    second = {r.message_id: r.attempts for r in log.rows().where("batch = 1").collect()}
    assert second == {"b": 2, "c": 2}


def test_stream_of_files_restarts_where_it_stopped(spark, tmp_path):
    log, inbox = MessageLog(spark, str(tmp_path / "log")), str(tmp_path / "inbox")
    for ids in ("abd", "cefg"):
        frame(spark, ids).coalesce(1).write.mode("append").json(inbox)
        stream = spark.readStream.schema("message_id string, body string").option("maxFilesPerTrigger", 1).json(inbox)
        query = start_message_stream(stream, log, process, str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120) and query.exception() is None
    drain(log, process)
    assert outcomes(log) == CASES
