"""Trades, returns, portfolios, metrics and the cost model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.checkpoints import small
from pairlab.params import DEFAULTS


def pair_cost(beta: Column, bps_per_leg: Column | float, *, guard: bool = True) -> Column:
    """Log cost of a round trip of a pair: (1 + beta) times the cost per leg; a negative or NaN beta raises if guarded."""
    bps = bps_per_leg if isinstance(bps_per_leg, Column) else F.lit(float(bps_per_leg))
    cost = (1 + beta) * bps / 1e4
    return F.when((beta < 0) | F.isnan(beta), F.raise_error(F.lit("beta must be finite and not negative")).cast("double")).otherwise(cost) if guard else cost


def leg_bps(spread_bps: Column | float, *, fixed: float = DEFAULTS.fixed_cost_bps) -> Column:
    """Cost per leg: the fixed part and the quoted spread."""
    return (spread_bps if isinstance(spread_bps, Column) else F.lit(float(spread_bps))) + fixed


def position_returns(signals: DataFrame, keys: list[str], order: str, *, session: str | None = None) -> DataFrame:
    """signals with gross: the previous position times the move of the spread; 0 on moves that are NaN.

    With ``session`` (machines that are flat overnight) the first bar of each session earns nothing.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    move = F.col("spread") - F.lag("spread").over(w)
    gross = F.lag("position", 1, 0).over(w) * F.when(move.isNull() | F.isnan(move), 0.0).otherwise(move)
    if session:
        gross = F.when(F.lag(session).over(w) == F.col(session), gross).otherwise(0.0)
    return signals.withColumn("gross", gross)


def trades(signals: DataFrame, keys: list[str], order: str, *, carry: tuple[str, ...] = (), finalize: bool = True, before: str | None = None) -> DataFrame:
    """(keys, trade_no, direction, entry_<order>, exit_<order>, entry and exit of ``carry``, held, gross_log, exit_reason).

    A trade runs from the bar it is entered to the first exit reason after; one still open at the end is
    closed as fold_boundary at the last bar with a spread if ``finalize``, else left out. ``held`` counts
    as the machine does, on the bar before an exit. ``before`` may name a column with that of the bar before; rows on which
    no trade begins or ends may then be left out.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    entry = (F.lag("position", 1, 0).over(w) == 0) & (F.col("position") != 0)
    s = signals.withColumn("entry__", entry).withColumn("before__", F.lag("held", 1, 0).over(w) if before is None else F.col(before))
    s = s.withColumn("trade_no", F.sum(F.col("entry__").cast("int")).over(running)).filter("trade_no > 0")
    here = ["spread", *carry]
    seen = ~F.isnan("spread") & F.col("spread").isNotNull()
    out = F.col("exit_reason").isNotNull()
    at_exit = lambda c: F.min_by(c, F.when(out, F.col(order)))
    at_end = lambda c: F.max_by(c, F.when(seen, F.col(order)))
    done = F.max(F.when(out, 1).otherwise(0)) == 1
    either = lambda a, b: F.when(done, a).otherwise(b)
    found = s.groupBy(*keys, "trade_no").agg(
        F.min_by("position", order).alias("direction"),
        F.min(order).alias(f"entry_{order}"),
        either(F.min(F.when(out, F.col(order))), F.max(F.when(seen, F.col(order)))).alias(f"exit_{order}"),
        *[F.min_by(c, order).alias(f"entry_{c}") for c in here],
        *[either(at_exit(c), at_end(c)).alias(f"exit_{c}") for c in here],
        either(at_exit("before__"), at_end("held")).alias("held"),
        F.coalesce(F.min_by("exit_reason", F.when(out, F.col(order))), F.lit("fold_boundary")).alias("exit_reason"),
    )
    found = found.withColumn("gross_log", F.col("direction") * (F.col("exit_spread") - F.col("entry_spread")))
    return found if finalize else found.filter("exit_reason <> 'fold_boundary'")


def deduct_costs(returns: DataFrame, closed: DataFrame, keys: list[str], order: str, cost: Column) -> DataFrame:
    """returns with net: gross less ``cost`` (over columns of closed) on the bars where trades end."""
    paid = closed.select(*keys, F.col(f"exit_{order}").alias(order), cost.alias("cost__"))
    return returns.join(paid, [*keys, order], "left").withColumn("net", F.col("gross") - F.coalesce("cost__", F.lit(0.0))).drop("cost__")


def densify(per_pair: DataFrame, axis: DataFrame, keys: list[str], date: str, values: tuple[str, ...] = ("gross", "net")) -> DataFrame:
    """Every pair on every date of ``axis(fold_id, date)``, with 0 where it has no row."""
    spine = per_pair.select(*keys).distinct().join(axis, "fold_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast(per_pair.schema[c].dataType)).alias(c)
    return spine.join(per_pair.select(*keys, date, *values), [*keys, date], "left").select(*keys, date, *[zero(c) for c in values])


def portfolio(per_pair: DataFrame, by: list[str], *, pair: str = "pair") -> DataFrame:
    """(by, gross, net, n_pairs, n_active): means over the pairs that have a row there."""
    moved = (F.col("gross") != 0) | (F.col("net") != 0)
    return per_pair.groupBy(*by).agg(F.avg("gross").alias("gross"), F.avg("net").alias("net"), F.count_distinct(pair).alias("n_pairs"), F.count_if(moved).alias("n_active"))


def session_sums(bars: DataFrame, keys: list[str], date: str) -> DataFrame:
    """(keys, date, gross, net, active): bars summed to sessions; active if any sum of a bar is not 0."""
    moved = (F.col("gross") != 0) | (F.col("net") != 0)
    return bars.groupBy(*keys, date).agg(F.sum("gross").alias("gross"), F.sum("net").alias("net"), F.bool_or(moved).alias("active"))


def metrics(returns: DataFrame, keys: list[str], date: str, value: str, *, periods: int = DEFAULTS.periods_per_year, part: str | None = None) -> DataFrame:
    """(keys, n, total_pct, ann_pct, sharpe, max_drawdown_pct) of log returns.

    The drawdown's first peak is the first cumulative return, not 0. A flat or single series has sharpe NaN. ``part`` may name a
    column that rises with ``date``; each part of a long series is then summed in a task of its own, and only sums meet.
    """
    w = Window.partitionBy(*keys, *([part] if part else [])).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    clean = returns.filter(F.col(value).isNotNull() & ~F.isnan(value))
    down = clean.withColumn("cum__", F.sum(value).over(w)).withColumn("down__", F.col("cum__") - F.max("cum__").over(w))
    if part is None:
        s = down.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("t"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.min("down__").alias("d"))
    else:
        # A row a part.
        ends = [F.min("cum__").alias("low"), F.max("cum__").alias("peak"), F.min("down__").alias("d"), F.min(value).alias("least"), F.max(value).alias("most")]
        per = down.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("t"), F.avg(value).alias("m"), F.var_pop(value).alias("v"), *ends)
        earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("at", F.coalesce(F.sum("t").over(earlier), F.lit(0.0)))
        per = per.withColumn("d", F.least("d", F.col("at") + F.col("low") - F.max(F.col("at") + F.col("peak")).over(earlier)))
        every = Window.partitionBy(*keys)
        per = per.withColumn("mean", F.sum("t").over(every) / F.sum("n").over(every))
        squares = F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))))
        deviation = F.when(F.min("least") == F.max("most"), 0.0).otherwise(F.sqrt(F.try_divide(squares, F.sum("n") - 1)))
        s = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.first("mean").alias("m"), deviation.alias("s"), F.min("d").alias("d"))
    years = F.greatest(F.col("n") / float(periods), F.lit(1.0 / periods))
    sharpe = F.when((F.col("n") > 1) & (F.col("s") > 0), F.try_divide("m", "s") * F.sqrt(F.lit(float(periods)))).otherwise(F.lit(float("nan")))
    pct = lambda c: F.expm1(c) * 100
    return s.select(*keys, "n", pct(F.col("t")).alias("total_pct"), pct(F.col("t") / years).alias("ann_pct"), sharpe.alias("sharpe"), pct(F.col("d")).alias("max_drawdown_pct"))


def trade_stats(closed: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_trades, win_rate, avg_held, avg_gross_pct, avg_net_pct) of trades with gross_log and net_log."""
    return closed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(F.when(F.col("net_log") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("held").alias("avg_held"),
        F.avg(F.expm1("gross_log") * 100).alias("avg_gross_pct"), F.avg(F.expm1("net_log") * 100).alias("avg_net_pct"),
    )


def concentration(closed: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_winners, top1_share, top2_share): share of positive net results in the best and the two best trades."""
    w = Window.partitionBy(*by).orderBy(F.col("net_log").desc())
    won = closed.filter("net_log > 0").withColumn("r__", F.row_number().over(w))
    s = won.groupBy(*by).agg(F.count(F.lit(1)).alias("n_winners"), F.sum("net_log").alias("t"), F.sum(F.when(F.col("r__") == 1, F.col("net_log"))).alias("a"), F.sum(F.when(F.col("r__") <= 2, F.col("net_log"))).alias("b"))
    return s.select(*by, "n_winners", F.try_divide("a", "t").alias("top1_share"), F.try_divide("b", "t").alias("top2_share"))


def cost_ladder(spark, levels: tuple[float, ...] = DEFAULTS.spread_ladder_bps) -> DataFrame:
    """(spread_bps), one row a level."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("spread_bps"))


def restamp(returns: DataFrame, closed: DataFrame, keys: list[str], order: str, date: str, ladder: DataFrame, *, fixed: float = DEFAULTS.fixed_cost_bps) -> DataFrame:
    """Session sums at every cost level in one pass: gross does not change, costs fall on the trades' last bars.

    ``closed`` carries beta. The ladder has a handful of rows.
    """
    levels = small(ladder)
    gross = returns.groupBy(*keys, date).agg(F.sum("gross").alias("gross")).crossJoin(levels)
    ends = closed.select(*keys, F.col(f"exit_{date}").alias(date), "beta").crossJoin(levels)
    paid = ends.groupBy(*keys, date, "spread_bps").agg(F.sum(pair_cost(F.col("beta"), leg_bps(F.col("spread_bps"), fixed=fixed))).alias("cost"))
    joined = gross.join(paid, [*keys, date, "spread_bps"], "left")
    return joined.withColumn("net", F.col("gross") - F.coalesce("cost", F.lit(0.0))).select(*keys, "spread_bps", date, "gross", "net")


def max_holding_days(half_life: Column, *, multiplier: float = DEFAULTS.holding_multiplier, cap: int = DEFAULTS.max_holding) -> Column:
    """ceil(multiplier * half-life) within 2 and cap."""
    return F.greatest(F.lit(2), F.least(F.lit(cap), F.ceil(half_life * multiplier).cast("int")))
