"""Books: cost-aware ledgers over target exposures, walk-forward choice, current targets.

A single-name ledger only changes state when its target changes, so the ordered fold runs
over those change rows alone (a Catalyst ``aggregate`` per key) and every bar is then marked
by a window. Keys are (symbol, window, parameter) and spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Default cost model in basis points, starting cash.
FEE_BPS, HALF_SPREAD_BPS, IMPACT_BPS = 10.0, 1.0, 25.0
CASH = 10_000.0


def _changes(df: DataFrame, keys: list[str], order: str, target: str, short: bool) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order)
    t = F.greatest(F.lit(-1.0 if short else 0.0), F.least(F.lit(1.0), F.col(target)))
    rows = df.withColumn("__t", t).withColumns(
        {
            "__prev": F.lag("__t").over(w),
            "__at": F.lead(order).over(w),
            "__open": F.lead("open").over(w),
            "__vol": F.lead("volume").over(w),
        }
    )
    # The last bar's order has no next open and is dropped; its size would not matter.
    return rows.where((F.col("__prev").isNull() | (F.col("__t") != F.col("__prev"))) & F.col("__at").isNotNull())


def fills(
    df: DataFrame, keys: list[str], order: str = "day", target: str = "target", short: bool = False,
    cash: float = CASH, fee_bps: float = FEE_BPS, half_spread_bps: float = HALF_SPREAD_BPS, impact_bps: float = IMPACT_BPS,
) -> DataFrame:
    """(keys, at, qty, price, fee, cash, pos): orders sized at the signal close, filled next open.

    ``qty`` is signed. Price moves against the order by half the spread plus impact times the
    share of the bar's volume taken (all of it when the bar has none).
    """
    packed = _changes(df, keys, order, target, short).groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col(order).alias("k"), F.col("__t").alias("t"), F.col("close").alias("c"),
                    F.col("__at").alias("at"), F.col("__open").alias("o"), F.col("__vol").alias("v"),
                )
            )
        ).alias("ev")
    )
    kind = df.schema[order].dataType.simpleString()
    rec = f"struct<at:{kind},qty:double,price:double,fee:double,cash:double,pos:double>"
    step = f"""aggregate(ev, named_struct('cash', {cash}D, 'pos', 0D, 'out', cast(array() as array<{rec}>)), (s, e) ->
      aggregate(array(e.t * (s.cash + s.pos * e.c) / e.c - s.pos), s, (s1, d) -> CASE WHEN d = 0 THEN s1 ELSE
       aggregate(array(e.o * (1 + signum(d) * ({half_spread_bps}D + {impact_bps}D * CASE WHEN e.v > 0 THEN least(abs(d) / e.v, 1D) ELSE 1D END) * 1e-4D)), s1, (s2, p) ->
        named_struct('cash', s2.cash - (d * p + abs(d) * p * {fee_bps}D * 1e-4D), 'pos', s2.pos + d, 'out', array_append(s2.out,
         named_struct('at', e.at, 'qty', d, 'price', p, 'fee', abs(d) * p * {fee_bps}D * 1e-4D,
          'cash', s2.cash - (d * p + abs(d) * p * {fee_bps}D * 1e-4D), 'pos', s2.pos + d)))) END))"""
    return packed.select(*keys, F.inline(F.expr(step).getField("out")))


def ledger(df: DataFrame, keys: list[str], order: str = "day", cash: float = CASH, **kw) -> DataFrame:
    """(keys, order, equity, exposure): every bar marked at its close after that bar's fills."""
    got = fills(df, keys, order, cash=cash, **kw).select(
        *keys, F.col("at").alias(order), F.col("cash").alias("__cash"), F.col("pos").alias("__pos")
    )
    run = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.select(*keys, order, "close").join(got, [*keys, order], "left")
    rows = rows.withColumns(
        {
            "__cash": F.coalesce(F.last("__cash", ignorenulls=True).over(run), F.lit(cash)),
            "__pos": F.coalesce(F.last("__pos", ignorenulls=True).over(run), F.lit(0.0)),
        }
    )
    equity = F.col("__cash") + F.col("__pos") * F.col("close")
    return rows.select(
        *keys, order, equity.alias("equity"),
        F.when(equity > 0, F.col("__pos") * F.col("close") / equity).otherwise(0.0).alias("exposure"),
    )


def stack_params(df: DataFrame, columns: dict[float, str], keep: list[str]) -> DataFrame:
    """One row per parameter from one signal column per grid value: (keep, param, target)."""
    rows = [F.struct(F.lit(float(p)).alias("param"), F.col(c).alias("target")) for p, c in columns.items()]
    return df.select(*keep, F.inline(F.array(*rows)))


def parameter_books(bars: DataFrame, columns: dict[float, str], cost_rate: float) -> DataFrame:
    """(symbol, day, param, i, n, held, r): every parameter's own uninterrupted screened book.

    A target decided on one bar is held over the next, which it pays for when it changes.
    """
    w = W.partitionBy("symbol", "param").orderBy("day")
    held = F.coalesce(F.lag("target").over(w), F.lit(0.0))
    before = F.coalesce(F.lag("target", 2).over(w), F.lit(0.0))
    rows = stack_params(bars, columns, ["symbol", "day", "ret"]).withColumns({"held": held, "__turn": F.abs(held - before)})
    r = F.coalesce(F.col("held") * F.col("ret"), F.lit(0.0)) - cost_rate * F.col("__turn")
    n = F.count(F.lit(1)).over(W.partitionBy("symbol", "param"))
    return rows.select("symbol", "day", "param", "held", r.alias("r"), (F.row_number().over(w) - 1).alias("i"), n.alias("n"))


def training_sharpes(books: DataFrame, warmup: int, train: int, test: int, per_year: float = 365.0) -> DataFrame:
    """(symbol, param, window, train_sharpe) of every whole walk-forward window.

    The moments of a window are the difference of two rows of running sums: the last row of its
    training span and the row before its first one past the warm-up. A row is either of a window
    by arithmetic on its position, so no window is expanded into its rows.
    """
    if warmup >= train:
        raise ValueError("the warm-up takes all of the training span")
    run = W.partitionBy("symbol", "param").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    rows = books.withColumns({"__s1": F.sum("r").over(run), "__s2": F.sum(F.col("r") * F.col("r")).over(run)})

    def end(at: int, sign: float):
        off = F.col("i") - at
        return F.when((off >= 0) & (off % test == 0), F.struct((off / test).cast("int").alias("window"), F.lit(sign).alias("sign")))

    ends = F.array_compact(F.array(end(warmup - 1, -1.0), end(train - 1, 1.0)))
    sums = rows.select("symbol", "param", "n", "__s1", "__s2", F.inline(ends)).where(F.col("window") * test + train + test <= F.col("n"))
    g = sums.groupBy("symbol", "param", "window").agg(F.sum(F.col("sign") * F.col("__s1")).alias("d1"), F.sum(F.col("sign") * F.col("__s2")).alias("d2"))
    m = float(train - warmup)
    var = (F.col("d2") - F.col("d1") * F.col("d1") / m) / (m - 1)
    sharpe = F.when(var > 0, F.col("d1") / m / F.sqrt(var) * F.sqrt(F.lit(per_year))).otherwise(0.0)
    return g.select("symbol", "param", "window", sharpe.alias("train_sharpe"))


def choose_parameters(sharpes: DataFrame, grid: list[float]) -> DataFrame:
    """(symbol, window, param, train_sharpe): the best of the grid, the first of it on ties (to nine places)."""
    place = F.array_position(F.array(*(F.lit(float(g)) for g in grid)), F.col("param"))
    order = F.struct(F.round("train_sharpe", 9).alias("sharpe"), (-place).alias("first"))
    best = sharpes.groupBy("symbol", "window").agg(F.max_by(F.struct("param", "train_sharpe"), order).alias("b"))
    return best.select("symbol", "window", F.col("b.param").alias("param"), F.col("b.train_sharpe").alias("train_sharpe"))


def walk_forward(bars: DataFrame, columns: dict[float, str], warmup: int, train: int, test: int, cost_rate: float = 1.1e-3, cash: float = CASH) -> DataFrame:
    """(symbol, day, window, param, train_sharpe, exposure, ret, equity): stitched out-of-sample books.

    ``bars`` hold returns and one target column per grid value, computed once over the whole
    history (they only read trailing bars). Windows of ``train + test`` bars move on by ``test``;
    those that do not fit whole are left out. Each window trades its test bars by the parameter
    with the best Sharpe over the training bars past ``warmup``; equity compounds over windows.
    """
    books = parameter_books(bars, columns, cost_rate)
    chosen = choose_parameters(training_sharpes(books, warmup, train, test), list(columns))
    window = F.floor((F.col("i") - train) / test).cast("int")
    trial = books.where(F.col("i") >= train).withColumn("window", window).where(F.col("window") * test + train + test <= F.col("n"))
    run = W.partitionBy("symbol").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    rows = trial.join(chosen, ["symbol", "window", "param"])
    return rows.select(
        "symbol", "day", "window", "param", "train_sharpe", F.col("held").alias("exposure"), F.col("r").alias("ret"),
        (F.exp(F.sum(F.log1p("r")).over(run)) * cash).alias("equity"),
    )


def equal_weight_returns(oos: DataFrame) -> DataFrame:
    """(day, ret, n): mean of the books' daily returns, aligned by date."""
    return oos.groupBy("day").agg(F.avg("ret").alias("ret"), F.count(F.lit(1)).alias("n"))


def current_targets(signals: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(symbol, day, close, targets): newest decision per symbol."""
    return signals.groupBy("symbol").agg(
        F.max("day").alias("day"), F.max_by("close", "day").alias("close"),
        *(F.max_by(c, "day").alias(n) for n, c in columns.items()),
    )


def rebalance_orders(targets: DataFrame, positions: DataFrame, equity: Column, dust: float = 0.005) -> DataFrame:
    """(symbol, notional): differences between target and held notional above the dust share."""
    both = targets.join(positions, "symbol", "left").withColumn(
        "notional", F.col("target") * equity - F.coalesce(F.col("units"), F.lit(0.0)) * F.col("close")
    )
    return both.where(F.abs("notional") >= equity * dust).select("symbol", "target", "close", "notional")


def reselection_due(last_selected: Column, today: Column, every: int = 90) -> Column:
    return last_selected.isNull() | (F.datediff(today, last_selected) >= every)


# --- several names in one book ---------------------------------------------------------------------

COST_RATE = 1.1e-3


def screened_book(rows: DataFrame, cost_rate: float = COST_RATE) -> DataFrame:
    """(book, day, ret, turnover, exposure) of ``(book, symbol, day, ret, weight)``.

    A weight decided on one bar is held over the next and paid for when it changes; sizes are
    shares of the book, so no bar waits for another's result. Two windows by book and symbol,
    then one aggregate by day, summed map-side.
    """
    w = W.partitionBy("book", "symbol").orderBy("day")
    held = F.coalesce(F.lag("weight").over(w), F.lit(0.0))
    before = F.coalesce(F.lag("weight", 2).over(w), F.lit(0.0))
    rows = rows.withColumns({"__held": held, "__turn": F.abs(held - before)})
    gain = F.col("__held") * F.coalesce("ret", F.lit(0.0)) - cost_rate * F.col("__turn")
    return rows.groupBy("book", "day").agg(F.sum(gain).alias("ret"), F.sum("__turn").alias("turnover"), F.sum(F.abs("__held")).alias("exposure"))


def book_bars(bars: DataFrame, books: dict[str, DataFrame]) -> DataFrame:
    """Returns of every book's bars with that day's weight (zero where the book names nothing)."""
    out = None
    for name, weights in books.items():
        part = bars.select("day", "symbol", "ret").join(
            weights.select("day", "symbol", "weight"), ["day", "symbol"], "left"
        ).select(F.lit(name).alias("book"), "day", "symbol", "ret", F.coalesce("weight", F.lit(0.0)).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


# --- carry ------------------------------------------------------------------------------------------


def carry_frame(legs: DataFrame, funding: DataFrame, gate: int | None = None) -> DataFrame:
    """(symbol, day, r_spot, r_perp, funding, hold): both legs and the day's settlements.

    ``gate`` holds a symbol only while its mean funding over the ``gate`` rows before is positive.
    """
    w = W.partitionBy("symbol").orderBy("day")
    per_day = funding.groupBy("symbol", "day").agg(F.sum("rate").alias("funding"))
    df = legs.join(per_day, ["symbol", "day"]).withColumns(
        {
            "r_spot": F.try_divide("close", F.lag("close").over(w)) - 1,
            "r_perp": F.try_divide("perp_close", F.lag("perp_close").over(w)) - 1,
        }
    ).dropna(subset=["r_spot", "r_perp", "funding"])
    hold = F.lit(True)
    if gate is not None:
        fr = w.rowsBetween(-gate, -1)
        hold = F.coalesce((F.count("funding").over(fr) == gate) & (F.avg("funding").over(fr) > 0), F.lit(False))
    return df.withColumn("hold", hold).select("symbol", "day", "r_spot", "r_perp", "funding", "hold")


def carry_gross(frame: DataFrame, collateral: float = 0.5, over: str = "present") -> DataFrame:
    """(day, funding_ret, basis_ret, n): the parts of the daily return that need no state.

    The target notional is the same share of yesterday's equity for every held symbol, so both
    legs' return on equity is a plain aggregate by day.
    """
    alloc = F.count(F.lit(1)) if over == "present" else F.count_if(F.col("hold"))
    on = F.when(F.col("hold"), 1.0).otherwise(0.0)
    g = frame.groupBy("day").agg(
        alloc.alias("n"), F.count(F.lit(1)).alias("present"),
        F.sum(on * F.col("funding")).alias("f"), F.sum(on * (F.col("r_spot") - F.col("r_perp"))).alias("b"),
    )
    share = F.when(F.col("n") > 0, collateral / F.col("n")).otherwise(0.0)
    return g.select("day", "present", (share * F.col("f")).alias("funding_ret"), (share * F.col("b")).alias("basis_ret"))


def carry_book(frame: DataFrame, cost_rate: float = COST_RATE, collateral: float = 0.5, over: str = "present") -> DataFrame:
    """(book, day, ret, funding_ret, basis_ret, cost_ret, n_symbols): :func:`carry_gross` less costs.

    Every held symbol takes the same share of the book; both legs pay for the change of that
    share since the symbol's row before. Windows by book and symbol, then one aggregate by day.
    """
    day = W.partitionBy("book", "day")
    n = F.count(F.lit(1)).over(day) if over == "present" else F.count_if(F.col("hold")).over(day)
    share = F.when(F.col("hold"), collateral / n).otherwise(0.0)
    w = W.partitionBy("book", "symbol").orderBy("day")
    rows = frame.withColumn("__w", share)
    rows = rows.withColumn("__turn", F.abs(F.col("__w") - F.coalesce(F.lag("__w").over(w), F.lit(0.0))))
    parts = rows.groupBy("book", "day").agg(
        F.sum(F.col("__w") * F.col("funding")).alias("funding_ret"), F.sum(F.col("__w") * (F.col("r_spot") - F.col("r_perp"))).alias("basis_ret"),
        F.sum(-2 * cost_rate * F.col("__turn")).alias("cost_ret"), F.count(F.lit(1)).alias("n_symbols"),
    )
    return parts.select("book", "day", (F.col("funding_ret") + F.col("basis_ret") + F.col("cost_ret")).alias("ret"), "funding_ret", "basis_ret", "cost_ret", "n_symbols")
