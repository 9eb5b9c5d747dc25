from datetime import datetime, timezone

from veilframe.streaming import client

AT = datetime(2024, 1, 1, tzinfo=timezone.utc)


def run(replies, **more):
    """``replies``: what each job says, one after the other; the last again and again."""
    passed = [0.0]
    places = dict.fromkeys(replies, 0)

    def status(job):
        said = replies[job][min(places[job], len(replies[job]) - 1)]
        places[job] += 1
        if isinstance(said, Exception):
            raise said
        return said

    rows = client.poll(replies, status, clock=lambda: passed[0], sleep=lambda s: passed.__setitem__(0, passed[0] + s), now=lambda: AT, **more)
    return rows, passed[0]


def test_polls_until_all_are_done(spark):
    done = {"status": "completed", "progress": 1, "warnings": ["w"], "entities": [1, 2]}
    rows, seconds = run({"a": [{"status": "queued"}, {"status": "processing", "progress": 0.5}, done], "b": [OSError("down"), {"status": "failed", "error": "bad file"}], "c": [{"status": "odd"}]})
    assert rows == [
        ("a", "completed", 1.0, AT, AT, 1, 2, None),
        ("b", "failed", 0.0, None, AT, 0, 0, "bad file"),
        ("c", "failed", 0.0, None, AT, 0, 0, None),
    ]
    assert seconds == 4.0
    assert spark.createDataFrame(rows, client.RECORD).count() == 3


def test_stops_in_time():
    rows, seconds = run({"a": [{"status": "processing", "progress": 7}], "b": [OSError("down")]}, every=2.0, at_most=9.0)
    assert rows == [("a", "processing", 1.0, AT, None, None, None, "not done in 9 seconds"), ("b", "queued", 0.0, None, None, None, None, "down")]
    assert seconds <= 9.0
    assert client.poll([], lambda j: {}) == []
