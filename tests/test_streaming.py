import datetime as dt

import numpy as np

from pairlab.functions import kernels
from pairlab.streaming import bars


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2020, 1, 1, 9, 0)
    z = np.random.default_rng(0).normal(0, 2, 60)
    for part in range(3):
        rows = [("p", t0 + dt.timedelta(minutes=i), float(z[i])) for i in range(20 * part, 20 * part + 20)]
        spark.createDataFrame(rows, "pair string, ts timestamp, z double").coalesce(1).write.mode("append").parquet(str(tmp_path / "z"))
    source = spark.readStream.schema("pair string, ts timestamp, z double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "z"))
    q = bars.signal_stream(source, max_holding=5).writeStream.format("memory").queryName("signals").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = [r.position for r in spark.table("signals").orderBy("ts").collect()]
    assert got == kernels.rolling_machine(z, 2.0, 0.5, 3.5, 5)[0].tolist()

    ticks = source.selectExpr("pair AS symbol", "ts", "z AS price")
    q = bars.resample_stream(ticks).writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    done = spark.table("bars").orderBy("bar_start").collect()
    assert done and all(r.volume == 5 for r in done) and done[0].close == z[4]


def told(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    try:
        q.processAllAvailable()
        assert not q.exception()
        return spark.table(name).collect(), q.lastProgress
    finally:
        q.stop()


def files(spark, rows, schema, path):
    """One file a batch, each a second younger than the last so that they are read in order."""
    import os

    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
        for f in path.glob("*.parquet"):
            if f.stat().st_mtime > 10_000_000:
                os.utime(f, (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_two_legs_on_streams(spark, tmp_path):
    """Out-of-order bars within the bound meet as in the batch form; a bar past it counts as missing."""
    from pairlab.operators import intraday

    t0 = dt.datetime(2020, 1, 1, 9, 0)
    at = lambda i: t0 + dt.timedelta(minutes=i)
    rng = np.random.default_rng(1)
    rows = [(s, at(i), float(i + k), 10 * i) for i in range(60) for k, s in enumerate(("YYY", "XXX", "ZZZ")) if rng.random() > 0.2 and i != 5]
    early = [r for r in rows if r[1] < at(30)]
    moved = [r for r in early if r[1] >= at(27)][::2]  # some arrive a batch later, within the bound
    late = ("XXX", at(5), 1.0, 1)
    y5 = ("YYY", at(5), 2.0, 2)
    end = [(s, at(600), 1.0, 1) for s in ("YYY", "XXX", "ZZZ")]
    batches = [[r for r in early if r not in moved] + [y5], moved + [r for r in rows if r[1] >= at(30)], [late], end, [(s, at(601), 1.0, 1) for s in ("YYY", "XXX", "ZZZ")]]
    schema = "symbol string, ts timestamp, close double, volume long"
    source = files(spark, batches, schema, tmp_path / "bars")
    pairs = spark.createDataFrame([("YYY", "XXX"), ("ZZZ", "XXX")], "y_sym string, x_sym string")
    got, _ = told(spark, bars.align_stream(source, source, pairs, late="10 minutes"), "legs", tmp_path)
    want = intraday.align_pairs(spark.createDataFrame(rows + [y5], schema), pairs, ["ts"]).collect()
    key = lambda r: (r.y_sym, r.x_sym, r.ts, str(r.close_y), str(r.close_x), r.volume_y, r.volume_x, r.tradeable)
    assert sorted(key(r) for r in got if r.ts < at(590)) == sorted(map(key, want))
    assert [(r.volume_y, r.tradeable) for r in got if r.ts == at(5) and r.y_sym == "YYY"] == [(2, False)]


def test_session_machine_on_event_time(spark, tmp_path):
    """Rows in any order within the bound give the batch machine's result, sessions close on their own and their state goes."""
    from pairlab.operators import signals

    rng = np.random.default_rng(4)
    rows = []
    for day in range(3):
        for p in ("p", "q"):
            n = 40
            z = rng.normal(0, 2, n)
            z[rng.random(n) < 0.1] = np.nan
            z[-8:] = 3.0 if p == "p" else z[-8:]  # open at the end
            for i in range(n):
                t = dt.datetime(2020, 1, 1 + day, 9, 0) + dt.timedelta(minutes=i)
                rows.append((p, t.date(), dt.datetime(2020, 1, 1 + day, 9, 39), t, float(z[i]), bool(i < n - 3 and rng.random() > 0.1)))
    rows.sort(key=lambda r: (r[3], r[0]))
    schema = "pair string, session date, closes timestamp, ts timestamp, z double, tradeable boolean"
    batches = []
    for lo in range(0, len(rows), 16):
        part = rows[lo : lo + 16]
        rng.shuffle(part := [tuple(r) for r in part])
        batches.append([(a, b, c, d, float(e), bool(f)) for a, b, c, d, e, f in part])
    # Neighbouring batches swap rows: out of order by some minutes.
    for a, b in zip(batches[::2], batches[1::2]):
        if a[0][1] == b[0][1]:
            a[:3], b[:3] = b[:3], a[:3]
    end = dt.datetime(2020, 1, 9, 9, 0)
    batches += [[("end", end.date(), end, end, 0.0, True)], [("end", end.date(), end, end, 0.0, True)]]
    source = files(spark, batches, schema, tmp_path / "z")
    kw = dict(entry=1.5, exit_=0.5, stop=3.5, max_holding=6)
    got, progress = told(spark, bars.session_stream(source, late="20 minutes", **kw), "sessions", tmp_path)
    df = spark.createDataFrame([tuple(r) for r in rows], schema)
    want = signals.rolling_signals(df, ["pair"], "ts", session="session", tradeable="tradeable", **kw).collect()
    key = lambda r: (r.pair, r.ts, r.position, r.held, r.exit_reason)
    assert sorted(map(key, (r for r in got if r.pair != "end")), key=str) == sorted(map(key, want), key=str)
    assert sum(r.exit_reason == "session_close" for r in got) >= 2
    assert progress.stateOperators[0].numRowsTotal <= 1  # of all sessions only the sentinel's may be left
