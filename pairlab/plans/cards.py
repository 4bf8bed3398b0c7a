"""Registered queries on the liquidity gate by fold and on cards of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab import fixtures
from pairlab.checkpoints import materialized
from pairlab.fixtures import SECTOR_SQL
from pairlab.operators import blocks, calendars, cards, liquidity, signals
from pairlab.plans import daily as days
from pairlab.plans import intraday as bars
from pairlab.plans.daily import RAW_PAIR_SQL, SIGNAL_SQL, TRADE_SQL, metrics_sql, query, rounded
from pairlab.plans.intraday import F3, KEYS, PER_SESSION, PS_B

#: Folds over the panel's thirty sessions: three before, eight of training, four of test; the bars count from the thirteenth session on.
_FOLD_DAYS, _PANEL_FROM, _PROBE, _FORWARD, _FILL = {"prior": 3, "train": 8, "test": 4}, 12, 6, 5, 0.99


@query(f"""WITH {F3}, d AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS i FROM (SELECT DISTINCT session FROM f3)),
fo AS (SELECT ((s - 11) // 4)::INT AS fold_id, a.session AS train_start, b.session AS train_end, c.session AS test_end
  FROM (SELECT unnest(range(11, (SELECT count(*) FROM d) - 4 + 1, 4)) AS s) JOIN d a ON a.i = s - 8 JOIN d b ON b.i = s - 1 JOIN d c ON c.i = s + 3),
p0 AS (SELECT min(session) + {_PANEL_FROM} AS p FROM d),
w AS (SELECT fold_id, CASE WHEN train_end < p THEN p ELSE greatest(train_end - {_PROBE}, train_start) END AS ps, CASE WHEN train_end < p THEN least(test_end, p + {_FORWARD}) ELSE train_end END AS pe FROM fo, p0),
st AS (SELECT fold_id, symbol, count(*) AS ns, avg(n / 12.0::DOUBLE) AS fr FROM w JOIN (SELECT symbol, session, count(*) AS n FROM f3 GROUP BY 1, 2) ON session BETWEEN ps AND pe GROUP BY 1, 2),
md AS (SELECT fold_id, symbol, median(close * volume) AS m FROM w JOIN f3 ON session BETWEEN ps AND pe GROUP BY 1, 2),
sm AS (SELECT DISTINCT symbol FROM f3)
SELECT fold_id, a.symbol AS y_sym, b.symbol AS x_sym, ps AS probe_start, pe AS probe_end, coalesce(y.ns, 0) AS y_n_sessions, coalesce(x.ns, 0) AS x_n_sessions,
  round(coalesce(y.fr, 0), 6) AS y_fill_rate, round(coalesce(x.fr, 0), 6) AS x_fill_rate, round(my.m, 6) AS y_med_min_rupee, round(mx.m, 6) AS x_med_min_rupee,
  coalesce(y.fr, 0) >= {_FILL} AND coalesce(x.fr, 0) >= {_FILL} AS intraday_pass
FROM w JOIN sm a ON TRUE JOIN sm b ON a.symbol < b.symbol LEFT JOIN st y USING (fold_id) LEFT JOIN st x USING (fold_id) LEFT JOIN md my USING (fold_id) LEFT JOIN md mx USING (fold_id)
WHERE y.symbol = a.symbol AND x.symbol = b.symbol AND my.symbol = a.symbol AND mx.symbol = b.symbol""")
def liquidity_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = materialized(bars.bars(spark, sf_dir))
    folds = materialized(calendars.build_folds(panel.select(F.col("session").alias("date")), **_FOLD_DAYS))
    first = panel.agg(F.date_add(F.min("session"), _PANEL_FROM)).first()[0]
    pairs = bars.all_pairs(panel).crossJoin(F.broadcast(folds.select("fold_id")))  # a handful of folds
    gate = liquidity.gate_by_fold(panel, pairs, folds, panel_start=first, days=_PROBE, forward=_FORWARD, full=PER_SESSION, fill=_FILL)
    return rounded(gate)


_CURVES_SQL = """, fs AS (SELECT y_sym || '~' || x_sym AS pair, ((dense_rank() OVER (PARTITION BY y_sym, x_sym ORDER BY session) - 1) // 10)::INT AS fold_id, session, net, active FROM ps),
cv AS (SELECT pair, fold_id, session, (exp(sum(net) OVER (PARTITION BY pair ORDER BY session ROWS UNBOUNDED PRECEDING)) - 1) * 100 AS cum_pct FROM fs)"""


def _by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session sums of the overnight machine by pair; ten sessions are a fold."""
    sums = bars._sessions(materialized(bars.rolling_run(spark, sf_dir, "B")))
    number = F.dense_rank().over(signals.Window.partitionBy(*KEYS).orderBy("session")) - 1
    return sums.select(F.concat_ws("~", *KEYS).alias("pair"), F.floor(number / 10).cast("int").alias("fold_id"), "session", "net", "active")


@query(PS_B + _CURVES_SQL + """SELECT pair, fold_id, session, round(cum_pct, 6) AS cum_pct FROM cv""")
def card_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of pairs, stitched over folds."""
    return rounded(cards.stitched_curves(_by_fold(spark, sf_dir), ["pair"], "fold_id", "session").drop("carry"))


@query(PS_B + _CURVES_SQL + """, v AS (SELECT 'all' AS variant, pair, fold_id, session, cum_pct FROM cv UNION ALL
  SELECT 'active', pair, fold_id, session, (exp(sum(net) OVER (PARTITION BY pair ORDER BY session ROWS UNBOUNDED PRECEDING)) - 1) * 100 FROM fs WHERE active AND fold_id > 0),
ax AS (SELECT DISTINCT pair, session FROM v)
SELECT pair, session, round(coalesce(last_value(a.cum_pct IGNORE NULLS) OVER w, 0), 6) AS cum_pct_all, round(coalesce(last_value(b.cum_pct IGNORE NULLS) OVER w, 0), 6) AS cum_pct_active
FROM ax LEFT JOIN (SELECT * FROM v WHERE variant = 'all') a USING (pair, session) LEFT JOIN (SELECT * FROM v WHERE variant = 'active') b USING (pair, session)
WINDOW w AS (PARTITION BY pair ORDER BY session ROWS UNBOUNDED PRECEDING)""")
def card_union_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve of all sessions and that of active ones after the first fold, on one axis."""
    sums = materialized(_by_fold(spark, sf_dir))
    both = sums.withColumn("variant", F.lit("all")).unionByName(sums.filter("active AND fold_id > 0").withColumn("variant", F.lit("active")))
    curves = cards.stitched_curves(both, ["pair", "variant"], "fold_id", "session")
    return rounded(cards.on_union_axis(curves, ["pair"], "variant", ["all", "active"], "session"))


_SEGMENT_SQL = """, l0 AS (SELECT pair, date, position, spread, position <> 0 AND position <> lag(position, 1, 0) OVER (PARTITION BY pair ORDER BY date) AS b FROM sg),
l1 AS (SELECT *, sum(b::INT) OVER (PARTITION BY pair ORDER BY date ROWS UNBOUNDED PRECEDING) AS segment_no FROM l0),
bd AS (SELECT pair, date, CASE WHEN count(*) OVER w >= 60 THEN avg(spread) OVER w END AS m, CASE WHEN count(*) OVER w >= 60 THEN stddev_samp(spread) OVER w END AS s
  FROM sg WINDOW w AS (PARTITION BY pair ORDER BY date ROWS 59 PRECEDING))
SELECT pair, segment_no::BIGINT AS segment_no, arg_min(position, date) AS direction, min(date) AS start, max(date) AS "end", count(*) AS n, round(arg_min(spread, date), 6) + 0.0::DOUBLE AS start_spread,
  round(arg_min(m, date), 6) + 0.0::DOUBLE AS start_roll_mean, round(arg_min(m + 2 * s, date), 6) + 0.0::DOUBLE AS start_upper, round(arg_max(m - 2 * s, date), 6) + 0.0::DOUBLE AS end_lower, count_if(spread > m + 2 * s OR spread < m - 2 * s)::BIGINT AS n_outside
FROM l1 JOIN bd USING (pair, date) WHERE position <> 0 GROUP BY pair, segment_no"""


@query(SIGNAL_SQL + _SEGMENT_SQL)
def position_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as intervals, with the bands where they begin and end."""
    found = cards.segments_in_blocks(days.pair_blocks(spark, sf_dir), ["pair"])
    found = found.withColumns({c: fixtures.dense_day(F.col(c)) for c in ("start", "end")})
    return rounded(found.select("pair", "segment_no", "direction", "start", "end", "n", "start_spread", "start_roll_mean", "start_upper", "end_lower", "n_outside"))


_EXITS = ", ".join(f"count_if(exit_reason = '{e}')::BIGINT AS n_exits_{e}" for e in ("mean_revert", "stop", "time", "fold_boundary"))
_SUMMARY_SQL = f""", mg AS ({metrics_sql("pd", "pair", "date", "gross")}), mn AS ({metrics_sql("pd", "pair", "date", "net")}),
ac AS (SELECT pair, min(date) AS first_active, max(date) AS last_active, count(*) AS n_obs FROM pd GROUP BY 1),
ts AS (SELECT pair, count(*) AS n_trades, avg((gross_log > cost_log)::INT) AS win_rate_net, avg(held) AS avg_holding_days, {_EXITS} FROM tc GROUP BY 1),
rw AS (SELECT pair, gross_log - cost_log AS v, row_number() OVER (PARTITION BY pair ORDER BY gross_log - cost_log DESC) AS r FROM tc WHERE gross_log > cost_log),
cc AS (SELECT pair, sum(v) FILTER (r = 1) / sum(v) AS t1, sum(v) FILTER (r <= 2) / sum(v) AS t2 FROM rw GROUP BY 1)
SELECT pair, {SECTOR_SQL.format("split_part(pair, '~', 1)")} AS sector, coalesce(n_trades, 0) AS n_trades, first_active, last_active, n_obs, mg.total_pct AS gross_total_pct, mn.total_pct AS net_total_pct,
  mg.ann_pct AS gross_ann_pct, mn.ann_pct AS net_ann_pct, mg.sharpe AS gross_sharpe, mn.sharpe AS net_sharpe, mn.max_drawdown_pct AS net_max_drawdown_pct, round(coalesce(win_rate_net, 0), 4) AS win_rate_net,
  round(coalesce(avg_holding_days, 0), 4) AS avg_holding_days, {", ".join(f"coalesce(n_exits_{e}, 0) AS n_exits_{e}" for e in ("mean_revert", "stop", "time", "fold_boundary"))},
  round(coalesce(t1, 0), 4) AS top1_pos_pnl_share, round(coalesce(t2, 0), 4) AS top2_pos_pnl_share
FROM ac LEFT JOIN mg USING (pair) LEFT JOIN mn USING (pair) LEFT JOIN ts USING (pair) LEFT JOIN cc USING (pair)"""


@query(TRADE_SQL + _SUMMARY_SQL)
def per_pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of pairs with their results, trades and exits."""
    run = materialized(days.pair_signals(spark, sf_dir))
    per_pair = days._per_pair(run).withColumn("part", blocks.block_of("place"))
    return rounded(cards.per_pair_summary(per_pair, materialized(days._trades(run)), fixtures.sectors(spark, sf_dir), part="part"), 4)


@query("WITH " + RAW_PAIR_SQL + """, sp2 AS (SELECT pair, min(date) + 100 AS a, max(date) - 50 AS b FROM pp GROUP BY 1)
SELECT pair, date, round(y / first_value(y) OVER w, 6) AS y_level, round(x / first_value(x) OVER w, 6) AS x_level FROM pp JOIN sp2 USING (pair) WHERE date BETWEEN a AND b WINDOW w AS (PARTITION BY pair ORDER BY date)""")
def leg_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = materialized(days.f2(spark, sf_dir))
    pairs = days.same_sector_pairs(spark, sf_dir)
    spans = cards_spans(panel, pairs)
    return rounded(cards.leg_levels(panel, spans))


def cards_spans(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, y_sym, x_sym, first_active, last_active): all days that both legs have but the first hundred and the last fifty."""
    own = panel.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    y, x = (own.select(F.col("symbol").alias(s), F.col("a").alias(f"a_{s}"), F.col("b").alias(f"b_{s}")) for s in KEYS)
    both = pairs.join(y, "y_sym").join(x, "x_sym")
    return both.select(F.concat_ws("~", *KEYS).alias("pair"), *KEYS, F.date_add(F.greatest("a_y_sym", "a_x_sym"), 100).alias("first_active"), F.date_sub(F.least("b_y_sym", "b_x_sym"), 50).alias("last_active"))
