"""The liquidity gate by fold, cards of pairs and the fold store, against plain Python."""

import math
from collections import defaultdict
from datetime import date, timedelta
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.jobs import daily as jobs
from pairlab.jobs import intraday as bars_jobs
from pairlab.operators import cards, liquidity
from pairlab.sources.foldstore import FoldStore

D0 = date(2020, 1, 1)


@pytest.fixture(scope="module")
def minute(spark):
    """Four symbols on 60 sessions of 24 bars: one too empty, one absent at first; a close and a volume lack."""
    rng = np.random.default_rng(3)
    rows, n = [], 60 * 24
    x = np.cumsum(rng.normal(0, 0.002, n))
    legs = {"XXX": x}
    for s, beta in (("YYY", 0.8), ("ZZZ", 1.2), ("LATE", 1.0)):
        e = np.zeros(n)
        for i in range(1, n):
            e[i] = 0.8 * e[i - 1] + rng.normal(0, 0.004)
        legs[s] = beta * x + e
    for s, v in legs.items():
        for i, c in enumerate(v):
            if rng.random() > (0.25 if s == "ZZZ" and i < 40 * 24 else 0.002) and not (s == "LATE" and i < 30 * 24):
                rows.append((s, D0 + timedelta(i // 24), i % 24, float(100 * math.exp(c)), int(rng.integers(1, 900))))
    rows[5] = (*rows[5][:3], float("nan"), 3)
    rows[9] = (*rows[9][:3], 3.0, None)
    return spark.createDataFrame(rows, "symbol string, session date, bar int, close double, volume long").repartition(4), rows


@pytest.fixture(scope="module")
def folds(spark):
    """Three folds of 15 test sessions; the first's training ends before the bars begin."""
    day = lambda i: D0 + timedelta(i)
    rows = [(k, day(-20 + 15 * k), day(-1 + 15 * k), day(15 * k), day(14 + 15 * k)) for k in range(4)]
    return spark.createDataFrame(rows, "fold_id int, train_start date, train_end date, test_start date, test_end date"), rows


def plain_gate(rows, pairs, folds, start, days, forward, full, fill):
    out = {}
    for k, train_start, train_end, _, test_end in folds:
        lo, hi = max(train_end - timedelta(days), train_start), train_end
        if train_end < start:
            lo, hi = start, min(test_end, start + timedelta(forward))
        told = {}
        for s in {x for p in pairs for x in p}:
            own = [r for r in rows if r[0] == s and lo <= r[1] <= hi]
            per = defaultdict(int)
            for r in own:
                per[r[1]] += 1
            values = [r[3] * r[4] for r in own if r[4] is not None and r[3] == r[3]]
            told[s] = (len(per), sum(v / full for v in per.values()) / len(per) if per else 0.0, median(values) if values else None)
        for y, x in pairs:
            out[k, y, x] = (lo, hi, *told[y], *told[x], told[y][1] >= fill and told[x][1] >= fill)
    return out


def test_gate_against_plain_python(spark, minute, folds):
    bars, rows = minute
    frame, spans = folds
    pairs = [("YYY", "XXX"), ("ZZZ", "XXX"), ("LATE", "XXX"), ("NONE", "YYY")]
    chosen = spark.createDataFrame([(k, *p) for k in range(4) for p in pairs] + [(1, *pairs[0])], "fold_id int, y_sym string, x_sym string")
    for days, forward in ((12, 9), (365, 180)):
        want = plain_gate(rows, pairs, spans, D0, days, forward, 24, 0.9)
        got = liquidity.gate_by_fold(bars, chosen, frame, days=days, forward=forward, full=24).collect()
        assert len(got) == len(want) == 16
        for r in got:
            lo, hi, yn, yf, ym, xn, xf, xm, ok = want[r.fold_id, r.y_sym, r.x_sym]
            assert (r.probe_start, r.probe_end, r.y_n_sessions or 0, r.x_n_sessions or 0, r.intraday_pass) == (lo, hi, yn, xn, ok)
            assert (r.y_fill_rate or 0.0, r.x_fill_rate) == pytest.approx((yf, xf))
            assert (r.y_med_min_rupee, r.x_med_min_rupee) == (pytest.approx(ym) if ym is not None else None, pytest.approx(xm))
        assert {r.intraday_pass for r in got} == {True, False}
    empty = liquidity.gate_by_fold(bars.limit(0), chosen, frame, panel_start=D0, full=24).collect()
    assert len(empty) == 16 and not any(r.intraday_pass for r in empty)


def test_thin_volume_passes_and_the_gate_is_inclusive(spark):
    """Only the share of bars decides, and a share of exactly the bound passes."""
    rows = [(s, D0 + timedelta(d), b, 1.0, 1) for s, n in (("A", 9), ("B", 10), ("C", 8)) for d in range(5) for b in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, session date, bar int, close double, volume long")
    folds = spark.createDataFrame([(0, D0, D0 + timedelta(4), D0 + timedelta(5), D0 + timedelta(6))], "fold_id int, train_start date, train_end date, test_start date, test_end date")
    chosen = spark.createDataFrame([(0, "A", "B"), (0, "B", "C")], "fold_id int, y_sym string, x_sym string")
    got = {r.y_sym: r.intraday_pass for r in liquidity.gate_by_fold(bars, chosen, folds, full=10).collect()}
    assert got == {"A": True, "B": False}


def candidates(spark, pairs, folds=4):
    rows = [(k, y, x, a, b, 1.0 + k, True, True, True, True, True) for k in range(folds) for y, x, a, b in pairs]
    return spark.createDataFrame(rows, "fold_id int, y_sym string, x_sym string, alpha double, beta double, half_life double, raw_pass boolean, fdr_pass boolean, half_life_in_band boolean, hurst_pass boolean, stable_prior_window boolean")


PAIRS = [("YYY", "XXX", math.log(100) * 0.2, 0.8), ("ZZZ", "XXX", -math.log(100) * 0.2, 1.2)]


def test_job_keeps_liquid_pair_folds(spark, minute, folds, tmp_path):
    bars, rows = minute
    found = bars_jobs.liquid_pair_folds(spark, bars, candidates(spark, PAIRS), folds[0], str(tmp_path), full=24)
    want = plain_gate(rows, [p[:2] for p in PAIRS], folds[1], D0, 365, 180, 24, 0.9)
    assert {(r.fold_id, r.y_sym, r.x_sym) for r in found.collect()} == {k for k, v in want.items() if v[-1]}
    assert 0 < found.count() < 8 == spark.read.parquet(f"{tmp_path}/liquidity_filter").count()
    assert spark.read.csv(f"{tmp_path}/liquidity_filter_csv", header=True).count() == 8


def test_store_runs_only_what_it_lacks(spark, tmp_path):
    store = FoldStore(spark, str(tmp_path / "store"), ["fold_id", "pair"])
    asked = []

    def compute(new):
        asked.append(sorted((r.fold_id, r.pair) for r in new.collect()))
        rows = new.filter("pair <> 'none'").select("fold_id", "pair", F.explode(F.array(F.lit(1), F.lit(2))).alias("i"), (F.col("beta") * 10).alias("v"))
        return {"rows": rows, "more": new.select("fold_id", "pair", F.lit(len(asked)).alias("run"))}

    wanted = lambda *rows: spark.createDataFrame(list(rows), "fold_id int, pair string, beta double")
    told = lambda found: sorted((r.fold_id, r.pair, r.i, r.v) for r in found["rows"].collect())
    assert store.done() is None
    first = store.fill(wanted((0, "a", 1.0), (0, "none", 1.0), (1, "a", 2.0)), compute)
    assert told(first) == [(0, "a", 1, 10.0), (0, "a", 2, 10.0), (1, "a", 1, 20.0), (1, "a", 2, 20.0)]
    store.fill(wanted((0, "a", 1.0), (0, "none", 1.0), (1, "a", 2.0)), compute)
    assert len(asked) == 1  # also for a key without rows
    files = lambda fold: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "store" / "rows" / f"fold_id={fold}").glob("*.parquet")}
    old = files(0)
    # A new fold, and a new pair in one that is there.
    again = store.fill(wanted((0, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0), (2, "a", 4.0)), compute)
    assert asked[1] == [(1, "b"), (2, "a")] and files(0) == old
    assert {(r.fold_id, r.pair): r.run for r in again["more"].collect()} == {(0, "a"): 1, (1, "a"): 1, (1, "b"): 2, (2, "a"): 2}
    assert [t[:2] for t in told(again)] == sorted([(f, p) for f, p in ((0, "a"), (1, "a"), (1, "b"), (2, "a")) for _ in range(2)])
    # Another input is run again, and a key that isn't asked for stays.
    third = store.fill(wanted((1, "a", 9.0)), compute)
    assert asked[2] == [(1, "a")] and told(third) == [(1, "a", 1, 90.0), (1, "a", 2, 90.0)]
    assert store.done().count() == 5 and store.read("rows").filter("pair = 'b'").count() == 2
    # Rows of a job that broke off before its keys were written are not complete, and are replaced.
    spark.createDataFrame([(7, "a", 1, 1.0)], "fold_id int, pair string, i int, v double").write.mode("append").partitionBy("fold_id").parquet(f"{tmp_path}/store/rows")
    assert store.read("rows").filter("fold_id = 7").count() == 0
    assert told(store.fill(wanted((7, "a", 5.0)), compute)) == [(7, "a", 1, 50.0), (7, "a", 2, 50.0)]
    with pytest.raises(ValueError):
        FoldStore(spark, "x", ["pair"])


def test_kept_regimes_equal_a_whole_run_and_cards(spark, minute, folds, tmp_path):
    bars, _ = minute
    bars = bars.filter("NOT isnan(close)").na.fill(1)
    chosen = bars_jobs.pair_folds(candidates(spark, PAIRS), folds[0]).filter("fold_id > 0")
    kw = dict(per_session=24, warmup=2, entry=1.2)
    store = str(tmp_path / "store")
    part = bars_jobs.kept_regimes(spark, bars, chosen.filter("fold_id < 3"), store, **kw)
    n = part["trades"].count()
    runs = []
    plain = bars_jobs.two_regime.run
    bars_jobs.two_regime.run = lambda rows, sized, *a, **k: (runs.append(sorted({r.fold_id for r in sized.collect()})), plain(rows, sized, *a, **k))[1]
    try:
        whole = bars_jobs.kept_regimes(spark, bars, chosen, store, **kw)
        bars_jobs.kept_regimes(spark, bars, chosen, store, **kw)
        assert runs == [[3]]  # the stored folds are not run again
        bars_jobs.kept_regimes(spark, bars, chosen.filter("fold_id = 3"), store, **(kw | {"entry": 1.3}))
        assert runs == [[3], [3]]  # other settings are other results
    finally:
        bars_jobs.two_regime.run = plain
    whole = bars_jobs.kept_regimes(spark, bars, chosen, store, **kw)
    at_once = bars_jobs.two_regimes(spark, bars, chosen, str(tmp_path / "whole"), **kw)
    key = ["regime", "fold_id", "y_sym", "x_sym", "trade_no", "entry_t", "exit_t", "exit_reason"]
    told = lambda df, cols: sorted(map(tuple, df.select(*cols).collect()))
    assert 0 < n < whole["trades"].count() and told(whole["trades"], key) == told(at_once["trades"], key)
    rounded = ["regime", "fold_id", "y_sym", "spread_bps", "session", F.round("gross", 9), F.round("net", 9)]
    assert told(whole["sessions"], rounded) == told(at_once["sessions"], rounded)

    sectors = spark.createDataFrame([("YYY", "S1"), ("ZZZ", "S2")], "symbol string, sector string")
    found = bars_jobs.pair_cards(spark, bars, chosen, whole, str(tmp_path / "cards"), sectors=sectors, per_session=24, warmup=2)
    net = defaultdict(list)
    for r in at_once["sessions"].filter("spread_bps = 3").orderBy("session").collect():
        net[f"{r.y_sym}~{r.x_sym}", r.regime].append((r.session, r.net))
    axis = defaultdict(dict)
    for r in found["card_curves"].collect():
        axis[r.pair][r.session] = (r.cum_pct_A, r.cum_pct_B)
    for pair in ("YYY~XXX", "ZZZ~XXX"):
        dates = sorted({d for regime in "AB" for d, _ in net[pair, regime]})
        assert sorted(axis[pair]) == dates
        for d in dates:
            want = [math.expm1(sum(v for t, v in net[pair, regime] if t <= d)) * 100 for regime in "AB"]
            assert axis[pair][d] == pytest.approx(want)
    trades = at_once["trades"].collect()
    for r in found["card_totals"].collect():
        y = r.pair[:3]
        assert r.folds == [1, 2, 3] and r.n_folds == 3 and r.sector == ("S1" if y == "YYY" else "S2")
        assert (r.n_trades_A, r.n_trades_B) == tuple(sum(t.y_sym == y and t.regime == g for t in trades) for g in "AB")
        assert (r.cum_net_pct_A, r.cum_net_pct_B) == pytest.approx(axis[r.pair][max(axis[r.pair])])
    for r in found["card_folds"].collect():
        n = {f: sum(t.y_sym == r.pair[:3] and t.regime == "A" and t.fold_id == f for t in trades) for f in (1, 2, 3)}
        assert r.fold_id == min(f for f in n if n[f] == max(n.values())) and r.n_trades == n[r.fold_id]
        own = found["card_series"].filter(F.col("pair") == r.pair).orderBy("session", "bar").collect()
        assert {s.fold_id for s in own} == {r.fold_id}
        life = 1.0 + r.fold_id
        w = int(min(max(round(life * 24), 24), 120))
        spread = np.array([s.spread for s in own])
        for i, s in enumerate(own):
            first = sum(t.session == s.session for t in own[: i + 1]) <= 2
            frame = spread[i - w + 1 : i + 1]
            if i + 1 < w or first or np.isnan(frame).any():
                assert math.isnan(s.z)
            else:
                assert s.z == pytest.approx((spread[i] - frame.mean()) / frame.std(ddof=1))
        assert found["card_trades"].filter(F.col("pair") == r.pair).count() == sum(t.y_sym == r.pair[:3] and t.fold_id == r.fold_id for t in trades)
    assert spark.read.csv(f"{tmp_path}/cards/card_totals_csv", header=True).count() == 2


def test_stitching_segments_and_representatives(spark):
    rows = [("p", f, D0 + timedelta(10 * f + i), 0.01 * (i + 1) * (-1) ** f) for f in range(3) for i in range(4)] + [("q", 1, D0, 0.5)]
    got = cards.stitched_curves(spark.createDataFrame(rows, "pair string, fold_id int, date date, net double"), ["pair"], "fold_id", "date").orderBy("pair", "date").collect()
    total = 0.0
    for r, (_, f, _, v) in zip(got, rows):
        total = v if r.pair == "q" else total + v
        assert r.cum_pct == pytest.approx(math.expm1(total) * 100)
    assert [r.carry for r in got] == pytest.approx([0.0] * 4 + [0.1] * 4 + [0.0] * 5)
    states = [(i, p) for i, p in enumerate([0, 1, 1, 0, -1, 1, 1, 0, 0, -1])]
    segments = cards.position_segments(spark.createDataFrame([("k", *s) for s in states], "pair string, t int, position int"), ["pair"], "t").orderBy("start").collect()
    assert [(r.direction, r.start, r.end, r.n) for r in segments] == [(1, 1, 2, 2), (-1, 4, 4, 1), (1, 5, 6, 2), (-1, 9, 9, 1)]
    folds = spark.createDataFrame([("p", 2), ("p", 3), ("q", 5), ("q", 4)], "pair string, fold_id int")
    trades = spark.createDataFrame([("p", 3)] * 2 + [("p", 2)] * 2, "pair string, fold_id int")
    assert {(r.pair, r.fold_id, r.n_trades) for r in cards.representative_folds(folds, trades).collect()} == {("p", 2, 2), ("q", 4, 0)}


def test_pair_report(spark, tmp_path):
    """Summary, segments, bands and legs of hand-made results over two folds."""
    days = [D0 + timedelta(i) for i in range(60)]
    rng = np.random.default_rng(1)
    level = {s: 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 60))) for s in ("AA", "BB", "CC")}
    prices = [(s, d, float(v[i])) for s, v in level.items() for i, d in enumerate(days) if not (s == "CC" and i == 45)]
    daily = spark.createDataFrame(prices, "symbol string, date date, close double")
    sectors = spark.createDataFrame([("AA", "S1")], "symbol string, sector string")
    folds = spark.createDataFrame([(0, days[20], days[39]), (1, days[40], days[59])], "fold_id int, test_start date, test_end date")
    flags = "raw_pass boolean, fdr_pass boolean, half_life_in_band boolean, hurst_pass boolean, stable_prior_window boolean"
    chosen = [(f, y, x, 0.1, 0.9, 5.0, *[True] * 5) for f, y, x in ((0, "AA", "BB"), (1, "AA", "BB"), (1, "CC", "BB"))]
    tested = spark.createDataFrame(chosen, "fold_id int, y_sym string, x_sym string, alpha double, beta double, half_life double, " + flags)
    per_pair, closed = [], []
    for f, y, x, *_ in chosen:
        for i in range(20 + 20 * f, 40 + 20 * f):
            per_pair.append((f, f"{y}~{x}", days[i], float(rng.normal(0, 0.01)) if y == "AA" else 0.0, float(rng.normal(0, 0.01)) if y == "AA" else 0.0, (1 if i % 10 < 4 else 0) * (y == "AA")))
    closed = [(0, "AA~BB", v, h, e) for v, h, e in ((0.05, 4, "mean_revert"), (-0.02, 3, "stop"), (0.03, 9, "time"))] + [(1, "AA~BB", 0.01, 4, "fold_boundary")]
    run = {"per_pair": spark.createDataFrame(per_pair, "fold_id int, pair string, date date, gross double, net double, position int"), "trades": spark.createDataFrame(closed, "fold_id int, pair string, net_log double, held int, exit_reason string"), "candidates": tested, "folds": folds}
    found = jobs.pair_report(spark, daily, sectors, run, str(tmp_path), window=10)
    assert found["pair_summary"].columns == cards.SUMMARY and len(cards.SUMMARY) == 21
    told = {r.pair: r for r in found["pair_summary"].collect()}
    a, c = told["AA~BB"], told["CC~BB"]
    net = [r[4] for r in per_pair if r[1] == "AA~BB"]
    assert (a.sector, a.n_trades, a.n_obs, a.first_active, a.last_active) == ("S1", 4, 40, days[20], days[59])
    assert (a.n_exits_mean_revert, a.n_exits_stop, a.n_exits_time, a.n_exits_fold_boundary) == (1, 1, 1, 1)
    assert (a.win_rate_net, a.avg_holding_days, a.top1_pos_pnl_share, a.top2_pos_pnl_share) == pytest.approx((0.75, 5.0, 5 / 9, 8 / 9))
    assert a.net_total_pct == pytest.approx(math.expm1(sum(net)) * 100) and a.net_sharpe == pytest.approx(np.mean(net) / np.std(net, ddof=1) * math.sqrt(252))
    assert (c.sector, c.n_trades, c.top1_pos_pnl_share, c.net_total_pct) == ("", 0, 0.0, 0.0) and math.isnan(c.net_sharpe)
    bands = {(r.fold_id, r.pair, r.date): r for r in found["pair_bands"].collect()}
    spread = {s: np.log(level[s]) - 0.9 * np.log(level["BB"]) - 0.1 for s in ("AA", "CC")}
    for i in range(20, 60):
        w = spread["AA"][i - 9 : i + 1]
        r = bands[i // 20 - 1, "AA~BB", days[i]]
        assert (r.spread, r.lower, r.roll_mean, r.upper) == pytest.approx((w[-1], w.mean() - 2 * w.std(ddof=1), w.mean(), w.mean() + 2 * w.std(ddof=1)))
    segments = found["pair_segments"].orderBy("start").collect()
    assert [(r.fold_id, r.start, r.end, r.n) for r in segments] == [(k // 20 - 1, days[k], days[k + 3], 4) for k in (20, 30, 40, 50)]
    assert all(r.start_upper == pytest.approx(bands[r.fold_id, r.pair, r.start].upper) and r.end_lower == pytest.approx(bands[r.fold_id, r.pair, r.end].lower) for r in segments)
    legs = {(r.pair, r.date): r for r in found["pair_legs"].collect()}
    assert len(legs) == 40 + 19 and legs["CC~BB", days[50]].y_level == pytest.approx(level["CC"][50] / level["CC"][40])
    curve = {(r.pair, r.date): r.cum_pct for r in found["pair_curves"].collect()}
    assert curve["AA~BB", days[59]] == pytest.approx(a.net_total_pct)
    assert [r["pair"] for r in spark.read.csv(f"{tmp_path}/pair_summary_csv", header=True).collect()] == sorted(told, key=lambda p: -told[p].net_total_pct)


def test_both_engines_over_the_same_pair_folds(spark):
    """Only pair-folds of the headline cell count, in both engines, at each frequency and cost."""
    rng = np.random.default_rng(5)
    cells = [(k, "ou", f, "B", c, s) for k, (f, c, s) in enumerate([(5, 1.0, "none"), (5, 3.0, "none"), (5, 3.0, "hard"), (15, 3.0, "none")])]
    folds = [(0, "A", "X"), (0, "B", "X"), (1, "A", "X")]
    out = {folds[1]: "hl_band"}
    marked = [(*f, k, out.get(f) if k == 1 else None) for f in folds for k in range(4)]
    sessions = [(*f, k, D0 + timedelta(d), float(rng.normal()) / 50, float(rng.normal()) / 50) for f in folds for k in range(4) for d in range(6)]
    trades = [(*f, k) for f in folds for k in range(4) for _ in range(f[0] + 1)]
    rolled = [(*f, g, c, D0 + timedelta(d), float(rng.normal()) / 50, float(rng.normal()) / 50) for f in folds for g in "AB" for c in (1.0, 3.0, 5.0, 8.0) for d in range(6)]
    key = "fold_id int, y_sym string, x_sym string"
    df = lambda rows, more: spark.createDataFrame(rows, f"{key}, {more}")
    found = {
        "metrics": spark.createDataFrame(cells, "cell_id int, engine string, freq_min int, regime string, spread_bps double, stop_mode string"), "marked": df(marked, "cell_id int, exclusion_reason string"),
        "sessions": df(sessions, "cell_id int, session date, gross double, net double"), "trades": df(trades, "cell_id int"),
    }
    run = {"sessions": df(rolled, "regime string, spread_bps double, session date, gross double, net double"), "trades": df([(*f, g) for f in folds for g in "AB" for _ in range(3)], "regime string")}
    got = {(r.engine, r.freq_min, r.spread_bps): r for r in bars_jobs.matched_engines(found, {5: run}).collect()}
    kept = [folds[0], folds[2]]
    assert set(got) == {("ou", 5, 1.0), ("ou", 5, 3.0)} | {("rolling", 5, c) for c in (1.0, 3.0, 5.0, 8.0)}

    def want(rows, at):
        by = defaultdict(list)
        for r in rows:
            by[r[-3]].append(r[at])
        v = np.array([np.mean(by[d]) for d in sorted(by)])
        return math.expm1(v.sum()) * 100, v.mean() / v.std(ddof=1) * math.sqrt(252)

    for (engine, _, c), r in got.items():
        rows = [s for s in sessions if s[:3] in kept and s[3] == (0 if c == 1 else 1)] if engine == "ou" else [s for s in rolled if s[:3] in kept and s[3] == "B" and s[4] == c]
        assert (r.gross_total_pct, r.gross_sharpe) == pytest.approx(want(rows, -2)) and (r.net_total_pct, r.net_sharpe) == pytest.approx(want(rows, -1))
        assert r.n_trades == (3 if engine == "ou" else 6)


def test_one_key_smoothness(spark):
    from pairlab.operators import clean

    daily = spark.createDataFrame([("A", D0 + timedelta(i), c) for i, c in enumerate((100.0, 104.0, 52.0))] + [("B", D0, 1.0)], "symbol string, date date, close double")
    assert clean.smooth_at(daily, "A", D0 + timedelta(1)) and not clean.smooth_at(daily, "A", "2020-01-03")
    assert not clean.smooth_at(daily, "A", D0) and not clean.smooth_at(daily, "C", D0) and clean.smooth_at(daily, "A", D0 + timedelta(2), tolerance=0.6)


def test_bands_meet_segments_without_a_product(spark):
    n = 400
    states = spark.range(n).select(F.lit("k").alias("pair"), F.col("id").alias("t"), F.when(F.col("id") % 4 < 2, 1).when(F.col("id") % 4 == 2, -1).otherwise(0).alias("position"))
    bands = spark.range(n).select(F.lit("k").alias("pair"), F.col("id").alias("t"), F.col("id").cast("double").alias("spread"), F.lit(-1.0).alias("lower"), F.lit(0.0).alias("roll_mean"), F.lit(200.0).alias("upper"))
    found = cards.banded_segments(cards.position_segments(states, ["pair"], "t"), bands, ["pair"], "t")
    got = sorted((r.start, r.end, r.n, r.start_spread, r.end_spread, r.n_outside) for r in found.collect())
    want = sorted([(i, i + 1, 2, float(i), i + 1.0, sum(v > 200 for v in (i, i + 1))) for i in range(0, n, 4)] + [(i, i, 1, float(i), float(i), int(i > 200)) for i in range(2, n, 4)])
    assert got == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
