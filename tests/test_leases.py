"""Leases: a stream in pieces, with late rows, against the batch and a plain reading."""

import datetime as dt
import random

import pytest

from strandline.streaming import leases

T0 = dt.datetime(2024, 1, 1)


def plain(rows, seconds):
    last, out = {}, []
    for key, i, ts in sorted((r for r in rows if None not in r), key=lambda r: (r[2], r[1])):
        if key not in last or (ts - last[key]).total_seconds() > seconds:
            out.append((key, i, ts))
        last[key] = ts
    return sorted(out)


def sample(n=400, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 5 + ["a", "b", "c"]), i, T0 + dt.timedelta(seconds=rng.randint(0, 40_000), milliseconds=rng.randint(0, 3))) for i in range(n)]


def test_batch(spark):
    rows = sample() + [("a", 1000, T0), ("a", 1001, T0), (None, 1, T0), ("b", None, T0), ("c", 2, None)]
    df = spark.createDataFrame(rows, "u string, n long, t timestamp")
    for part in (60, 3_600, 86_400):
        assert sorted(tuple(r) for r in leases.leased_batch(df, "u", "n", "t", 300, part).collect()) == plain(rows, 300)
    assert leases.leased_batch(df.limit(0), "u", "n", "t", 300).count() == 0


@pytest.fixture
def disk_state(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


def test_stream_equals_batch(spark, tmp_path, disk_state):
    rows = sorted(sample(240, 2), key=lambda r: r[2])
    rng = random.Random(3)
    cut = [rows[i : i + 60] for i in range(0, 240, 60)]
    # Within a piece rows come in any order, and some of a piece come with the next; the watermark waits for them.
    moved = [r for r in cut[0] if rng.random() < 0.2]
    cut[0], cut[1] = [r for r in cut[0] if r not in moved], cut[1] + moved
    end, late = rows[-1][2], ("hot", 9_001, T0)
    pieces = [*cut, [("end", 9_000, end + dt.timedelta(days=3))], [late, ("end", 9_002, end + dt.timedelta(days=9))], [("end", 9_003, end + dt.timedelta(days=19))]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    schema = "u string, n long, t timestamp"
    stream = leases.leased_stream(spark.readStream.schema(schema).parquet(source), "u", "n", "t", 300, "6 hours")
    for piece in pieces:
        rng.shuffle(piece)
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(source)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = sorted(tuple(r) for r in spark.read.parquet(out).where("key <> 'end'").collect())
    assert got == plain(rows, 300)
    assert late[1] not in {i for _, i, _ in got}


def test_epochs(spark, tmp_path):
    rows = spark.range(4000)
    drawn = [{r[0] for r in leases.epoch_sample(rows, "id", 0.25, e).collect()} for e in (0, 1, 0)]
    assert drawn[0] == drawn[2] != drawn[1]
    assert all(850 < len(d) < 1150 for d in drawn) and 180 < len(drawn[0] & drawn[1]) < 320
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    query = leases.epochs(stream, "id", 0.25, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "out")).where("epoch = 0").collect()} == drawn[0]
