import random
from datetime import datetime, timedelta

import pytest

from lagscope.operators import silence
from lagscope.streaming import silence as silence_streams

START = datetime(2024, 3, 1)
KIND = "host string, at timestamp_ntz"


def minute(n):
    return START + timedelta(minutes=n)


def brute(beats, after, until):
    """Events by walking each host's beats."""
    out = []
    for host in {h for h, t in beats if h is not None and t is not None}:
        times = sorted({t for h, t in beats if h == host and t is not None and t <= until})
        for this, then in zip(times, [*times[1:], None]):
            due = this + after
            if due <= until and (then is None or then > due):
                out.append((host, "silent", due))
                if then is not None:
                    out.append((host, "returned", then))
    return sorted(out)


def collected(df):
    return sorted((r.host, r.event, r.at) for r in df.collect())


def test_silences(spark):
    rows = [("stops", minute(0)), ("stops", minute(4)), ("returns", minute(0)), ("returns", minute(30)), ("returns", minute(30)), ("edge", minute(0)),
            ("edge", minute(10)), ("edge", minute(20)), (None, minute(3)), ("stops", None), ("later", minute(90))]
    beats = spark.createDataFrame(rows, KIND)
    expected = spark.createDataFrame([("never",), ("stops",), ("later",)], "host string")
    got = collected(silence.silences(beats, "host", "at", "10 minutes", minute(40), minute(0), expected))
    assert got == [("edge", "silent", minute(30)), ("later", "silent", minute(10)), ("never", "silent", minute(10)), ("returns", "returned", minute(30)),
                   ("returns", "silent", minute(10)), ("returns", "silent", minute(40)), ("stops", "silent", minute(14))]
    assert collected(silence.silences(beats.limit(0), "host", "at", "10 minutes", minute(40))) == []
    with pytest.raises(ValueError, match="since"):
        silence.silences(beats, "host", "at", "10 minutes", minute(40), expected=expected)


def test_silences_equal_brute_force(spark):
    random.seed(5)
    # Half of all beats come from one host.
    beats = [(random.choice(["hot", "hot", "hot", "a", "b", "c"]), START + timedelta(seconds=random.randrange(40_000))) for _ in range(600)]
    df = spark.createDataFrame(beats, KIND)
    for minutes in (1, 3, 10):
        for until in (minute(200), minute(700)):
            assert collected(silence.silences(df, "host", "at", f"{minutes} minutes", until)) == brute(beats, timedelta(minutes=minutes), until)


def test_stream_of_silences(spark, tmp_path):
    """Beats arrive out of order over several runs; what the stream puts out is what the whole table says up to the watermark."""
    random.seed(6)
    beats = sorted([(random.choice(["hot", "hot", "a", "b"]), START + timedelta(seconds=random.randrange(12_000))) for _ in range(150)], key=lambda b: b[1])
    beats = [b for _, b in sorted((t + timedelta(seconds=random.randrange(250)), (h, t)) for h, t in beats)]  # at most 250 s late
    source, folder = f"{tmp_path}/beats", f"{tmp_path}/out"
    for run in range(3):
        part = beats[run * 50 : run * 50 + 50] + [(None, minute(1))] * (run == 0)
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KIND).parquet(source)
        silence_streams.stream_silences(stream, "host", "at", "5 minutes", folder, "300 seconds", available_now=True).awaitTermination()
        top = max(t for _, t in beats[: run * 50 + 50])
        assert collected(spark.read.parquet(f"{folder}/events")) == brute(beats[: run * 50 + 50], timedelta(minutes=5), top - timedelta(seconds=300))
