"""Named queries over the base tables: each operator on the weekly brand panel, with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as O
from .functions import columns as C
from .operators import cleaning, factors, ic, portfolio, validation
from .operators.panel import brand_panel, supplier_panel, table
from .plans import search
from .plans.batch import evaluate, long_form
from .plans.formula import BINARY, parse
from .sources import store
from .sources.probe import first_days

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def named(name: str, f, sql: str | None = None) -> None:
    f.__name__ = name
    query(sql)(f)


def rounded(df: DataFrame, keep: list[str], *values: str, digits: int = 6) -> DataFrame:
    return df.select(*keep, *[(F.round(F.col(v), digits) + 0.0).alias(v) for v in values])


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with a momentum signal s, a signal ls with gaps, and forward returns r7 and r1."""
    p = factors.forward_return(factors.forward_return(brand_panel(spark, sf_dir), 7, "r7"), 1, "r1")
    r = lambda x: F.round(x, 10) + 0.0
    return p.withColumns({
        "s": r(F.try_divide(F.col("close"), C.lag(F.col("close"), 7)) - 1), "ls": C.lag(F.col("ls_ratio"), 1), "r7": r(F.col("r7")), "r1": r(F.col("r1")),
    })


def one(df: DataFrame, x: str, name: str = "f") -> DataFrame:
    return df.withColumns({"formula": F.lit(name), "x": F.col(x)})


# --- panel assembly -----------------------------------------------------------------------------

_COLUMNS = "date_utc, ticker, close, volume, market_cap, funding_rate, taker_buy_volume, taker_sell_volume, taker_buy_ratio, taker_net_volume, oi_usd, ls_ratio, category"


@query(f"with {O.PANEL} select {_COLUMNS} from panel")
def p_panel(spark, d):
    return brand_panel(spark, d)


@query("""
select 'S' || l_suppkey as ticker, date_trunc('week', l_shipdate)::date as date_utc, round(sum(l_extendedprice) / sum(l_quantity) + 1e-9, 6) as close,
  round(sum(l_quantity), 6) as volume from lineitem group by 1, 2""")
def p_supplier_panel(spark, d):
    return supplier_panel(spark, d).select("ticker", "date_utc", "close", "volume")


_RAW = "event_type || case user_id % 4 when 0 then '_usdt' when 1 then '-usdt' when 2 then 'USDT' else '/USDT:USDT' end"


def _raw_symbols(spark, d):
    suffix = F.when(F.col("user_id") % 4 == 0, "_usdt").when(F.col("user_id") % 4 == 1, "-usdt").when(F.col("user_id") % 4 == 2, "USDT").otherwise("/USDT:USDT")
    return table(spark, d, "events").select(F.concat("event_type", suffix).alias("raw")).distinct()


@query(f"""
with r as (select distinct {_RAW} as raw from events), u as (select raw, replace(replace(upper(raw), '_', '/'), '-', '/') as u from r),
k as (select raw, case when len(string_split(u, '/')) > 2 then split_part(u, '/', 1) || '/' || split_part(u, '/', 2) else u end as u from u)
select raw, upper(replace(replace(raw, '_', '/'), ':USDT', '')) as normal,
  case when ends_with(u, 'USDT') and not contains(u, '/') then substr(u, 1, length(u) - 4) || '/USDT' else u end as harmonised from k""")
def p_symbols(spark, d):
    raw = F.col("raw")
    return _raw_symbols(spark, d).select("raw", cleaning.normalised_symbol(raw).alias("normal"), cleaning.harmonised_symbol(raw).alias("harmonised"))


@query("""
with s as (select distinct upper(event_type) as s from events union all select unnest(['USDT', 'USDC', 'DAI', 'BUSD', 'TUSD', 'FDUSD', 'BTC']))
select s as symbol, s || '/USDT:USDT' as perpetual, s || 'USDT' as spot from s where s not in ('USDT', 'USDC', 'DAI', 'BUSD', 'TUSD', 'FDUSD')""")
def p_exchange_symbols(spark, d):
    s = table(spark, d, "events").select(F.upper("event_type").alias("symbol")).distinct()
    s = s.unionByName(spark.createDataFrame([(x,) for x in [*cleaning.STABLECOINS, "BTC"]], "symbol string"))
    c = F.col("symbol")
    out = s.select("symbol", cleaning.exchange_symbol(c, perpetual=True).alias("perpetual"), cleaning.exchange_symbol(c, perpetual=False).alias("spot"))
    return out.where("spot is not null")


@query("""
select 'U' || user_id as ticker, ts::date as date_utc, round(max_by(value, (ts, event_id)), 6) as value
from events where value is not null group by 1, 2""")
def p_daily_last(spark, d):
    events = table(spark, d, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user"), "ts", "value", "event_id")
    return rounded(cleaning.daily_last(events, symbol="user", at="ts", value="value", tie="event_id"), ["ticker", "date_utc"], "value")


_UNIVERSE = "select p_brand as symbol, round(sum(p_retailprice), 4) as market_cap, list(distinct p_type order by p_type) as categories from part group by 1"


def _universe(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(
        F.round(F.sum("p_retailprice"), 4).alias("market_cap"), F.array_sort(F.collect_set("p_type")).alias("categories"))


@query(f"select symbol, market_cap from ({_UNIVERSE}) order by market_cap desc, symbol limit 10")
def p_top_universe(spark, d):
    return cleaning.top_universe(_universe(spark, d), 10).select("symbol", "market_cap")


@query(f"""
with {O.PANEL}, a as (select date_utc, ticker, close, volume, 1 as k from panel), b as (select date_utc, ticker, close * 2, case when volume > 100 then volume end, 2 from panel where category = 'CAT1'),
u as (select * from a union all select * from b)
select date_utc, ticker, arg_max(close, k) filter (close is not null) as close, arg_max(volume, k) filter (volume is not null) as volume from u
group by 1, 2 having count(close) + count(volume) > 0""")
def p_last_wins(spark, d):
    p = brand_panel(spark, d).select("date_utc", "ticker", "close", "volume", "category")
    a = p.drop("category").withColumn("k", F.lit(1))
    b = p.where("category = 'CAT1'").select("date_utc", "ticker", (F.col("close") * 2).alias("close"), F.when(F.col("volume") > 100, F.col("volume")).alias("volume"), F.lit(2).alias("k"))
    return cleaning.last_wins([a, b], order="k")


@query(f"""
with {O.PANEL}, a as (select date_utc, ticker, close from panel where category <> 'CAT0'), b as (select date_utc, ticker, funding_rate from panel where category <> 'CAT1'),
c as (select date_utc, ticker, ls_ratio from panel where ls_ratio is not null)
select date_utc, ticker, close, funding_rate, ls_ratio from a full join b using (date_utc, ticker) full join c using (date_utc, ticker)""")
def p_outer_merge(spark, d):
    p = brand_panel(spark, d)
    return cleaning.outer_merge({"close": p.where("category <> 'CAT0'"), "funding_rate": p.where("category <> 'CAT1'"), "ls_ratio": p.where("ls_ratio is not null")})


@query(f"""
with {O.PANEL}, u as (select * from ({_UNIVERSE}) where symbol <> 'Brand#7')
select date_utc, ticker, close, u.market_cap, coalesce(categories[1], 'Other') as category from panel left join u on ticker = symbol""")
def p_universe_join(spark, d):
    p = brand_panel(spark, d).select("date_utc", "ticker", "close")
    return cleaning.with_universe(p, _universe(spark, d).where("symbol <> 'Brand#7'"))


@query("select event_id, (ts - interval 9 hour)::date as day from events")
def p_utc_day(spark, d):
    return table(spark, d, "events").select("event_id", cleaning.utc_day(F.col("ts"), "Asia/Tokyo").alias("day"))


@query(f"with {O.PANEL} select date_utc, ticker, lag(funding_rate, 1) over {O.T} as funding_rate from panel")
def p_funding_lag(spark, d):
    return cleaning.lagged(brand_panel(spark, d)).select("date_utc", "ticker", "funding_rate")


_FILL = f"coalesce({{0}}, lag({{0}}, 1) over {O.T}, lag({{0}}, 2) over {O.T}, lag({{0}}, 3) over {O.T})"


@query(f"with {O.PANEL} select date_utc, ticker, {_FILL.format('ls_ratio')} as ls_ratio from panel")
def p_ffill(spark, d):
    return cleaning.filled(brand_panel(spark, d), ["ls_ratio"], 3).select("date_utc", "ticker", "ls_ratio")


@query(f"""
with {O.PANEL}, l as (select *, lag(funding_rate) over {O.T} as f from panel)
select date_utc, ticker, close, {_FILL.format('f')} as funding_rate, {_FILL.format('ls_ratio')} as ls_ratio, category from l""")
def p_clean_panel(spark, d):
    raw = brand_panel(spark, d).withColumnRenamed("ticker", "symbol")
    out = cleaning.clean_panel(raw.withColumn("symbol", F.replace("symbol", F.lit("Brand"), F.lit("BRAND"))))
    return out.select("date_utc", F.replace("ticker", F.lit("BRAND"), F.lit("Brand")).alias("ticker"), "close", "funding_rate", "ls_ratio", "category")


@query("select user_id, event_type, min_by(round(value, 6), event_id) as value, min(event_id) as event_id from events group by 1, 2")
def p_first_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.round("value", 6).alias("value"), "event_id", F.col("event_id").alias("k"))
    return cleaning.first_wins(e, ["user_id", "event_type"], order="k").drop("k")


@query(f"with {O.PANEL} select case when date_utc < date '1999-01-01' then 'is' else 'oos' end as part, count(*) as n, round(avg(close), 6) as close from panel group by 1")
def p_split(spark, d):
    a, b = cleaning.split_at(brand_panel(spark, d), "1999-01-01")
    both = a.withColumn("part", F.lit("is")).unionByName(b.withColumn("part", F.lit("oos")))
    return rounded(both.groupBy("part").agg(F.count("*").alias("n"), F.avg("close").alias("close")), ["part", "n"], "close")


@query("""
with e as (select distinct user_id, ts::date as date_utc from events), u as (select distinct user_id from e),
days as (select unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day))::date as date_utc)
select user_id, date_utc from u cross join days anti join e using (user_id, date_utc)""")
def s_missing_days(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("date_utc"))
    return cleaning.missing_days(e, start="2024-01-01", end="2024-01-30", keys=["user_id"])


@query("select user_id, min(ts::date) as first_date, max(ts::date) as last_date, count(distinct ts::date) as n_dates from events group by 1")
def s_availability(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("date_utc"))
    return cleaning.first_available(e, ["user_id"])


@query("""
with e as (select distinct user_id, ts::date as day from events), u as (select distinct user_id from e),
days as (select unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day))::date as day),
gaps as (select user_id, day from u cross join days anti join e using (user_id, day)),
marked as (select *, case when lag(day) over (partition by user_id order by day) = day - 1 then 0 else 1 end as anew from gaps),
runs as (select *, sum(anew) over (partition by user_id order by day) as run from marked)
select user_id, min(day) as first_day, max(day) as last_day, count(*) as n_days from runs group by user_id, run""")
def s_missing_spans(spark, d):
    """Runs of missing days, which one request each can ask for."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("date_utc"))
    return cleaning.day_spans(cleaning.missing_days(e, start="2024-01-01", end="2024-01-30", keys=["user_id"]), ["user_id"], "date_utc")


@query("select user_id || '/' || event_type as symbol, min(ts::date) as first_day from events group by 1")
def s_first_days(spark, d):
    """The first day of each user's events of a type, found by probes of spans of days."""
    stored = table(spark, d, "events").select(F.concat_ws("/", "user_id", "event_type").alias("symbol"), F.to_date("ts").alias("day"))

    def probe(spans):
        return spans.join(stored, "symbol").where(F.col("day").between(F.col("first_day"), F.col("last_day")))

    return first_days(stored.select("symbol"), probe, "2023-11-01", "2024-01-31").select("symbol", "first_day")


def _records(spark, d):
    """Records as a source would send them, made of events: epoch milliseconds and numbers as text."""
    e = table(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return e.select("event_id", "ms", F.round("value", 4).cast("string").alias("v"), F.upper("event_type").alias("symbol"), "user_id")


@query("""
select event_id, date_trunc('millisecond', ts) as funding_time, round(value, 4) as funding_rate, case when user_id % 3 = 0 then 0.0 else user_id end as mark_price, upper(event_type) as symbol
from events""")
def s_funding_rows(spark, d):
    raw = _records(spark, d).select("event_id", F.col("ms").alias("fundingTime"), F.col("v").alias("fundingRate"), F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string")).otherwise("").alias("markPrice"), "symbol")
    return store.funding_rows(raw.withColumn("symbol", F.struct("symbol", "event_id"))).select("symbol.event_id", "funding_time", "funding_rate", "mark_price", "symbol.symbol")


@query("""
select event_id, epoch_us(ts) // 1000 as timestamp_ms, user_id::double as open, round(value, 4) + 1 as high, round(value, 4) - 1 as low, round(value, 4) as close, (user_id % 7)::double as volume,
  date_trunc('millisecond', ts) as date_utc, upper(event_type) as symbol from events""")
def s_ohlcv_rows(spark, d):
    v = F.col("v").cast("double")
    raw = _records(spark, d).select(F.col("ms").alias("timestamp_ms"), F.col("user_id").cast("string").alias("open"), (v + 1).alias("high"), (v - 1).alias("low"), F.col("v").alias("close"),
                                    (F.col("user_id") % 7).cast("string").alias("volume"), F.struct("symbol", "event_id").alias("symbol"))
    return rounded(store.ohlcv_rows(raw), ["symbol.event_id", "timestamp_ms", "open", "volume", "date_utc", "symbol.symbol"], "high", "low", "close", digits=4)


@query("""
select event_id, round(value, 4) as volume, case when round(value, 4) > 0 then round(user_id / round(value, 4), 6) end as taker_buy_ratio,
  case when round(value, 4) > 0 then round((2 * user_id - round(value, 4)) / round(value, 4), 6) end as taker_net_volume from events""")
def s_taker_rows(spark, d):
    raw = _records(spark, d).select(F.col("ms").alias("open_ms"), F.col("v").alias("volume"), F.col("user_id").cast("string").alias("taker_buy_base"), F.col("event_id").alias("symbol"))
    return rounded(store.taker_rows(raw).withColumnRenamed("symbol", "event_id"), ["event_id"], "volume", "taker_buy_ratio", "taker_net_volume")


@query("select event_id, round(value, 4) as buy_ratio, (user_id % 5)::double as sell_ratio, round(round(value, 4) / nullif(user_id % 5, 0), 6) + 0.0 as ls_ratio from events")
def s_long_short_rows(spark, d):
    raw = _records(spark, d).select(F.col("ms").cast("string").alias("timestamp"), F.col("v").alias("buyRatio"), (F.col("user_id") % 5).cast("string").alias("sellRatio"), F.col("event_id").alias("symbol"))
    return rounded(store.long_short_rows(raw).withColumnRenamed("symbol", "event_id"), ["event_id"], "buy_ratio", "sell_ratio", "ls_ratio")


@query("select event_id, date_trunc('millisecond', ts) as timestamp, round(value, 4) as open_interest, round(value, 4) as open_interest_usd from events")
def s_interest_rows(spark, d):
    raw = _records(spark, d).select(F.col("ms").cast("string").alias("timestamp"), F.col("v").alias("openInterest"), F.col("event_id").alias("symbol"))
    return store.interest_rows(raw).select(F.col("symbol").alias("event_id"), "timestamp", "open_interest", "open_interest_usd")


@query("""
select c_custkey as id, upper(c_name) as symbol, c_acctbal as market_cap, case when c_custkey % 4 > 0 then c_mktsegment end as category
from customer order by c_acctbal desc, c_custkey limit 50""")
def s_universe_rows(spark, d):
    c = table(spark, d, "customer")
    raw = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("symbol"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("market_cap"), F.lit(1).alias("market_cap_rank"),
                   F.col("c_acctbal").alias("current_price"), F.when(F.col("c_custkey") % 4 > 0, F.array("c_mktsegment")).alias("categories"))
    rows = store.universe_rows(raw, "2024-01-01", 50)
    return store.fresh_universe(rows, "2024-01-02").select("id", "symbol", "market_cap", F.try_element_at("categories", F.lit(1)).alias("category"))


# --- factors and formulas -----------------------------------------------------------------------

for _name in factors.FACTORS:
    _digits = O.digits_of(_name)

    def _run(spark, d, name=_name, digits=_digits):
        return rounded(factors.factor(brand_panel(spark, d), name).withColumnRenamed(name, "value"), ["date_utc", "ticker"], "value", digits=digits)

    named(f"f_{_name.lower()}", _run, O.factor(_name, _digits))


@query(O.all_factors())
def f_all(spark, d):
    all_ = factors.with_factors(brand_panel(spark, d))
    return all_.select("date_utc", "ticker", *[(F.round(x, O.digits_of(x)) + 0.0).alias(x) for x in factors.FACTORS])


_BASE = ["close", "volume", "market_cap", "funding_rate", "oi_usd", "ls_ratio"]
FORMULAS = {
    "g_add": "add(close, funding_rate)", "g_sub": "sub(close, ls_ratio)", "g_mul": "mul(volume, funding_rate)", "g_div": "div(close, oi_usd)",
    "g_rank": "rank(ls_ratio)", "g_zscore": "zscore(ls_ratio)", "g_winsor": "winsor(close)",
    **{f"g_{op}_{w}": f"{op}({c}, W_{w})" for op, c in (("ts_mean", "close"), ("ts_std", "close"), ("delta", "volume"), ("ts_rank", "volume")) for w in (7, 30, 90)},
    "g_nested": "zscore(delta(ts_std(rank(volume), W_30), W_14))", "g_deep": "winsor(div(sub(ts_mean(close, W_7), ts_mean(close, W_30)), ts_std(close, W_30)))",
}


def _digits_of(text: str) -> int:
    """Exact for arithmetic on rounded columns, beyond the sums' noise for the rest."""
    return 9 if parse(text, _BASE).op in BINARY else 7


for _name, _text in FORMULAS.items():

    _digits = _digits_of(_text)

    def _run(spark, d, text=_text, digits=_digits):
        return rounded(evaluate(brand_panel(spark, d), {"value": parse(text, _BASE)}), ["date_utc", "ticker"], "value", digits=digits)

    named(_name, _run, O.formula_query(parse(_text, _BASE), _digits))


@query(f"""
with {O.PANEL} select date_utc, ticker,
  round(case when count(close) over {O.D} >= 2 then close - avg(close) over (partition by date_utc, category) end, 9) + 0.0 as value from panel""")
def g_neutralize(spark, d):
    return rounded(brand_panel(spark, d).withColumn("value", C.cs_neutralize(F.col("close"))), ["date_utc", "ticker"], "value", digits=9)


@query(f"""
with {O.PANEL}, a as (select *, round({O.winsor('close')}, 8) as x from panel), b as (select *, round({O.zscore('x')}, 8) as z from a),
c as (select *, round(z - avg(z) over (partition by date_utc, category), 8) + 0.0 as n from b)
select date_utc, ticker, round({O.rank('n')}, 6) as value from c""")
def g_canonical(spark, d):
    return rounded(factors.canonical(brand_panel(spark, d), "close", "value", digits=8), ["date_utc", "ticker"], "value")


def _dummies(panel: DataFrame) -> DataFrame:
    """Three dummies that overlap."""
    n = F.substring("ticker", 7, 10).cast("int")
    return panel.withColumns({"odd": (n % 2).cast("double"), "third": (n % 3 == 0).cast("double"), "cat1": (F.col("category") == "CAT1").cast("double")})


_DUMMIES = "select *, (substr(ticker, 7)::int % 2)::double as odd, (substr(ticker, 7)::int % 3 = 0)::int::double as third, (category = 'CAT1')::int::double as cat1"


@query(f"""
with {O.PANEL}, p as ({_DUMMIES} from panel where ls_ratio is not null),
a as (  -- without what each half of the first dummy has in common
  select *, ls_ratio - avg(ls_ratio) over w as y, third - avg(third) over w as u, cat1 - avg(cat1) over w as v, count(*) over {O.D} as n from p window w as (partition by date_utc, odd)),
b as (  -- without what goes with the second
  select *, y - case when sum(u * u) over {O.D} > 1e-9 then sum(u * y) over {O.D} / sum(u * u) over {O.D} else 0 end * u as y2,
    v - case when sum(u * u) over {O.D} > 1e-9 then sum(u * v) over {O.D} / sum(u * u) over {O.D} else 0 end * u as v2 from a),
c as (select *, y2 - case when sum(v2 * v2) over {O.D} > 1e-9 then sum(v2 * y2) over {O.D} / sum(v2 * v2) over {O.D} else 0 end * v2 as y3 from b)
select date_utc, ticker, round(y3, 7) + 0.0 as value from panel left join (select date_utc, ticker, y3 from c where n >= 2) using (date_utc, ticker)""")
def g_neutralize_dummies(spark, d):
    """Residuals of least squares on a constant and three overlapping dummies; the SQL takes one out after the other."""
    return rounded(factors.neutralised(_dummies(brand_panel(spark, d)), "ls_ratio", ["odd", "third", "cat1"], "value"), ["date_utc", "ticker"], "value", digits=7)


@query(O.formula_batch({k: (parse(v, _BASE), _digits_of(v)) for k, v in FORMULAS.items()}))
def g_batch(spark, d):
    """All example formulas as one batch."""
    trees = {k: parse(v, _BASE) for k, v in FORMULAS.items()}
    rows = long_form(evaluate(brand_panel(spark, d), trees), list(trees), ["date_utc", "ticker"])
    exact = F.col("formula").isin([k for k, v in FORMULAS.items() if _digits_of(v) == 9])
    return rows.select("date_utc", "ticker", "formula", (F.when(exact, F.round("x", 9)).otherwise(F.round("x", 7)) + 0.0).alias("x"))


# --- returns and portfolios ---------------------------------------------------------------------

@query(f"with {O.SIGNALS} select date_utc, ticker, round(r7, 6) as r7, round(r1, 6) as r1 from sig")
def r_forward_returns(spark, d):
    return rounded(signals(spark, d), ["date_utc", "ticker"], "r7", "r1")


@query(f"with {O.SIGNALS}, {O.WEIGHTS} select date_utc, ticker, round(w, 6) as weight from weights")
def r_weights(spark, d):
    return rounded(portfolio.with_weights(signals(spark, d), "s"), ["date_utc", "ticker"], "weight")


@query(f"with {O.SIGNALS}, {O.WEIGHTS} select ticker, round(w, 6) as weight from weights where date_utc = date '1999-06-07'")
def r_rebalance(spark, d):
    one_day = signals(spark, d).where("date_utc = date '1999-06-07'")
    return rounded(portfolio.with_weights(one_day, "s"), ["ticker"], "weight")


_EDGES = ", ".join(f"quantile_cont(s, {k / 10}) over {O.D}" for k in range(11))


@query(f"""
with {O.SIGNALS}, k as (select date_utc, s, r7 as r, count(*) over {O.D} as n, list_sort(list_distinct([{_EDGES}])) as e from sig where s is not null)
select date_utc, greatest(len(list_filter(e, lambda v: v < s)) - 1, 0) + 1 as decile, round(avg(r), 6) as ret from k where n >= 10 and len(e) > 1 group by 1, 2""")
def r_deciles(spark, d):
    return rounded(portfolio.decile_returns(signals(spark, d), "s", "r7").withColumn("decile", F.col("decile").cast("long")), ["date_utc", "decile"], "ret")


def _net(spark, d):
    return portfolio.net_returns(portfolio.with_weights(signals(spark, d), "s"), "weight", "r1", 10.0)


@query(f"with {O.SIGNALS}, {O.RETURNS} select date_utc, round(ret, 6) + 0.0 as ret, round(turnover, 6) + 0.0 as turnover, round(net, 6) + 0.0 as net from net")
def r_net_returns(spark, d):
    return rounded(_net(spark, d), ["date_utc"], "ret", "turnover", "net")


@query(f"with {O.SIGNALS}, {O.RETURNS} select round(avg(turnover), 6) as turnover from daily")
def r_turnover(spark, d):
    return rounded(portfolio.daily_turnover(portfolio.with_weights(signals(spark, d), "s"), "weight").agg(F.avg("turnover").alias("turnover")), [], "turnover")


@query(f"with {O.SIGNALS}, {O.WEIGHTS} select round(avg(d), 6) as turnover from (select abs(w - lag(w) over {O.T}) as d from weights)")
def r_cell_turnover(spark, d):
    return rounded(portfolio.mean_turnover_of_cells(portfolio.with_weights(signals(spark, d), "s"), "weight"), [], "turnover")


@query(f"with {O.SIGNALS}, {O.RETURNS} select count(*) as n, round(avg(net) / stddev_pop(net) * sqrt(365), 6) as sharpe from net")
def r_sharpe(spark, d):
    return rounded(_net(spark, d).agg(F.count("*").alias("n"), portfolio.sharpe(F.col("net")).alias("sharpe")), ["n"], "sharpe")


_CURVES = """c as (
  select date_utc, net as ret, sum(net) over w as cum_sum, product(1 + net) over w as cum_prod from net window w as (order by date_utc rows unbounded preceding)),
c2 as (select *, max(cum_prod) over (order by date_utc rows unbounded preceding) as peak from c)"""


def eight_digits(x: str):
    """A number of any size to eight digits after the first, as text."""
    return F.format_string("%.8e", F.col(x))


@query(f"""
with {O.SIGNALS}, {O.RETURNS}, {_CURVES}
select date_utc, round(ret, 6) + 0.0 as ret, round(cum_sum, 6) + 0.0 as cum_sum, printf('%.8e', cum_prod) as cum_prod, printf('%.8e', peak) as peak, round((cum_prod - peak) / peak, 6) + 0.0 as drawdown from c2""")
def r_curves(spark, d):
    """The curves of the full returns, which compound to numbers of any size."""
    out = portfolio.curves(_net(spark, d), "net")
    return rounded(out, ["date_utc", eight_digits("cum_prod").alias("cum_prod"), eight_digits("peak").alias("peak")], "ret", "cum_sum", "drawdown")


@query(f"with {O.SIGNALS}, {O.RETURNS}, {_CURVES} select round(min((cum_prod - peak) / peak), 6) as max_drawdown from c2")
def r_max_drawdown(spark, d):
    return rounded(portfolio.max_drawdown(_net(spark, d), "net"), [], "max_drawdown")


@query(f"with {O.SIGNALS}, {O.WEIGHTS} select category, round(sum(w), 6) + 0.0 as exposure from weights group by 1")
def r_exposure(spark, d):
    return rounded(portfolio.exposure(portfolio.with_weights(signals(spark, d), "s"), "weight"), ["category"], "exposure")


@query(f"""
with {O.SIGNALS}, {O.WEIGHTS}, x as ({_DUMMIES} from weights)
select 'odd' as dummy, round(sum(w * odd), 6) + 0.0 as exposure from x union all select 'third', round(sum(w * third), 6) + 0.0 from x union all select 'cat1', round(sum(w * cat1), 6) + 0.0 from x""")
def r_exposure_to(spark, d):
    return rounded(portfolio.exposure_to(_dummies(portfolio.with_weights(signals(spark, d), "s")), "weight", ["odd", "third", "cat1"]), ["dummy"], "exposure")


# --- information coefficients -------------------------------------------------------------------

@query(f"with {O.SIGNALS}, {O.daily_ic('s', 'r7')} select date_utc, round(ic, 6) + 0.0 as ic from ic")
def i_rank_ic(spark, d):
    return rounded(ic.daily_ic(one(signals(spark, d), "s"), "r7"), ["date_utc"], "ic")


@query(f"with {O.SIGNALS}, {O.daily_ic('ls', 'r7')} select date_utc, round(ic, 6) + 0.0 as ic from ic")
def i_rank_ic_gaps(spark, d):
    return rounded(ic.daily_ic(one(signals(spark, d), "ls"), "r7"), ["date_utc"], "ic")


@query(f"with {O.SIGNALS}, {O.daily_ic('ls', 'r7', joint=True)} select date_utc, round(ic, 6) + 0.0 as ic from ic")
def i_rank_ic_joint(spark, d):
    return rounded(ic.daily_ic(one(signals(spark, d), "ls"), "r7", joint=True), ["date_utc"], "ic")


@query(f"""
with {O.SIGNALS}, {O.daily_ic('s', 'r7')}, {O.hac('ic')}
select n, round(mean_ic, 6) + 0.0 as mean_ic, round(se, 6) as se, round(case when se > 0 then abs(mean_ic) / se else 0 end, 6) as stability from hac2""")
def i_stability(spark, d):
    return rounded(ic.newey_west(ic.daily_ic(one(signals(spark, d), "s"), "r7")), ["n"], "mean_ic", "se", "stability")


_HORIZONS = [1, 3, 7, 14, 30]
_DECAY = ", ".join(
    f"h{h} as (select *, lead(r7, {h}) over {O.T} as rh from sig), {O.daily_ic('s', 'rh', source=f'h{h}', name=f'ic{h}')}" for h in _HORIZONS
)


@query(f"with {O.SIGNALS}, {_DECAY} " + " union all ".join(f"select {h} as horizon, round(coalesce(avg(ic), 0), 6) + 0.0 as ic from ic{h}" for h in _HORIZONS))
def i_decay(spark, d):
    return rounded(ic.ic_decay(one(signals(spark, d), "s"), "r7", _HORIZONS), ["horizon"], "ic")


_ALL_DECAY = " union all ".join(f"select {h} as horizon, date_utc, ic from ic{h}" for h in _HORIZONS)


@query(f"""
with {O.SIGNALS}, {_DECAY}, h as ({_ALL_DECAY}), m as (select horizon, avg(ic) as ic from h group by 1), {O.bootstrap("h", "horizon", 200)}
select horizon, {", ".join(f"round(coalesce({c}, ic, 0), 6) + 0.0 as {c}" for c in ("mean", "lower", "upper"))}
from (values {", ".join(f"({h})" for h in _HORIZONS)}) as v(horizon) left join m using (horizon) left join bounds using (horizon)""")
def i_decay_ci(spark, d):
    """The decay with bootstrap intervals."""
    return rounded(ic.ic_decay_ci(one(signals(spark, d), "s"), "r7", _HORIZONS), ["horizon"], "mean", "lower", "upper")


@query(f"with {O.SIGNALS}, {O.daily_ic('s', 'ls', joint=True)} select 's' as a, 'ls' as b, round(abs(avg(ic)), 6) as corr from ic")
def i_signal_correlation(spark, d):
    return rounded(ic.signal_correlations(signals(spark, d), [("s", "ls")]), ["a", "b"], "corr")


_OTHERS = ["ls", "volume", "funding_rate"]
_DIV = ", ".join(O.daily_ic("s", o, joint=True, name=f"d_{o}") for o in _OTHERS)
_DIV_SQL = "(select coalesce(avg(c), 0) from (" + " union all ".join(f"select abs(avg(ic)) as c from d_{o}" for o in _OTHERS) + "))"


@query(f"with {O.SIGNALS}, {_DIV} select 's' as formula, round(1 - {_DIV_SQL}, 6) as diversity")
def i_diversity(spark, d):
    return rounded(ic.diversity(signals(spark, d), ["s"], _OTHERS), ["formula"], "diversity")


@query(f"""
with {O.SIGNALS}, {_DIV}, {O.daily_ic('s', 'r7')}, {O.hac('ic')}
select 's' as formula, round(mean_ic, 6) + 0.0 as rank_ic, round(case when se > 0 then abs(mean_ic) / se else 0 end, 6) as stability, round(1 - {_DIV_SQL}, 6) as diversity from hac2
union all select 'unknown', -99.0, -99.0, 0.0""")
def i_fitness(spark, d):
    wide = signals(spark, d).withColumn("unknown", F.lit(None).cast("double"))
    return rounded(ic.composite_fitness(wide, "r7", ["s", "unknown"], _OTHERS), ["formula"], "rank_ic", "stability", "diversity")


@query(f"with {O.SIGNALS} select distinct date_utc from sig where s is not null except select date_utc from sig where r7 is not null")
def i_guard_dates(spark, d):
    s = signals(spark, d)
    return ic.signal_dates_without_returns(s.where("s is not null"), s.where("r7 is not null"))


@query(f"with {O.PANEL}, k as (select *, row_number() over {O.T} as k from panel) select date_utc, ticker from k where k = 1 and funding_rate is not null")
def i_guard_lag(spark, d):
    return ic.unlagged_first_rows(brand_panel(spark, d), "funding_rate")


@query(f"with {O.PANEL}, w as (select date_utc, ticker, {O.winsor('close')} + case when category = 'CAT3' then 100000 else 0 end as winsorized, max(close) over {O.D} as hi from panel) select date_utc, ticker from w where winsorized > hi + 1e-9")
def i_guard_envelope(spark, d):
    p = brand_panel(spark, d).withColumn("w", C.cs_winsor(F.col("close")) + F.when(F.col("category") == "CAT3", 100000).otherwise(0))
    return ic.outside_envelope(p, "w", "close").select("date_utc", "ticker")


# --- validation and search ----------------------------------------------------------------------

@query(f"""
with {O.SIGNALS}, {O.daily_ic('s', 'r7', joint=True, name='a')}, {O.daily_ic('ls', 'r7', joint=True, name='b')},
u as (select 's' as formula, * from a union all select 'ls', * from b), {O.bootstrap("u", "formula", 1000)}
select formula, round(mean, 6) + 0.0 as mean, round(lower, 6) + 0.0 as lower, round(upper, 6) + 0.0 as upper from bounds""")
def v_bootstrap_ci(spark, d):
    """Of two signals' rank correlations, one of which has gaps."""
    rows = long_form(signals(spark, d), ["s", "ls"], ["date_utc", "r7"])
    return rounded(validation.bootstrap_ci(ic.daily_ic(rows, "r7", joint=True)), ["formula"], "mean", "lower", "upper")


_PERM = f"""{O.SIGNALS}, f as (select date_utc, ticker, s as x, r1 as r, row_number() over (partition by date_utc order by ticker) as k from sig where s is not null and r1 is not null),
m as (select date_utc, r, perm, row_number() over (partition by perm, date_utc order by md5('42|' || perm || '|' || date_utc::varchar || '|' || ticker)) as k from f, unnest(range(1, 101)) as u(perm)),
p as (select m.perm, m.date_utc, f.x, m.r from m join f on m.date_utc = f.date_utc and m.k = f.k),
pr as (select *, {O.rank('x', 'perm, date_utc')} as a, {O.rank('r', 'perm, date_utc')} as b from p),
pi as (select perm, date_utc, count(*) as n, {O.corr('a', 'b')} as ic from pr group by 1, 2),
pm as (select perm, avg(ic) as ic from pi where n >= 10 and ic is not null group by 1), {O.daily_ic('s', 'r1', joint=True)}, o as (select coalesce(avg(ic), 0) as observed from ic)"""


@query(f"with {_PERM} select round(observed, 6) + 0.0 as observed, round(sum((abs(ic) >= abs(observed))::int) / 100.0, 6) as p_value from pm, o group by observed")
def v_permutation(spark, d):
    rows = one(signals(spark, d), "s")
    return rounded(validation.permutation_test(rows, "r1"), [], "observed", "p_value")


@query()
def v_deflated_sharpe(spark, d):
    return rounded(validation.deflated_sharpe_of(_net(spark, d).select("date_utc", F.col("net").alias("ret")), 100), ["n"], "sharpe", "skew", "kurtosis", "dsr")


_WINDOWS = validation.walk_forward_windows(date(1995, 1, 2), date(2001, 11, 5), inside=730, outside=180, step=365)
_SPANS = ", ".join(f"({k}, 'is', date '{a}', date '{b}'), ({k}, 'oos', date '{c}', date '{e}')" for k, a, b, c, e in _WINDOWS)


#: Each span of a window as a backtest of its own, whose first date has no turnover.
_SLICED = f"""spans as (select * from (values {_SPANS}) as v(window_id, segment, a, b)),
sliced as (select sig.*, window_id, segment from sig join spans on date_utc >= a and date_utc < b), {O.returns("sliced", "window_id, segment, ")}"""


def _sliced(spark, d):
    by = ("window_id", "segment")
    rows = validation.walk_forward(spark, signals(spark, d).select("date_utc", "ticker", "s", "r1"), _WINDOWS)
    return portfolio.net_returns(portfolio.with_weights(rows, "s", by=by), "weight", "r1", 10.0, by=by)


@query(f"""
with {O.SIGNALS}, {_SLICED},
g as (select window_id, segment, count(*) as n, case when count(*) > 5 and stddev_pop(net) > 0 then avg(net) / stddev_pop(net) * sqrt(365) else 0 end as sharpe from net group by 1, 2)
select window_id, segment, n, round(sharpe, 6) as sharpe from g""")
def v_walk_forward(spark, d):
    daily = _sliced(spark, d)
    s = F.when(F.count("*") > 5, portfolio.sharpe(F.col("net"))).otherwise(0.0)
    return rounded(daily.groupBy("window_id", "segment").agg(F.count("*").alias("n"), s.alias("sharpe")), ["window_id", "segment", "n"], "sharpe")


@query(f"""
with {O.SIGNALS}, {_SLICED},
g as (select window_id, segment, case when count(*) > 5 and stddev_pop(net) > 0 then avg(net) / stddev_pop(net) * sqrt(365) else 0 end as s from net group by 1, 2),
p as (select window_id, max(s) filter (segment = 'is') as i, max(s) filter (segment = 'oos') as o from g group by 1)
select window_id, abs(i - o) / abs(i) > 0.5 as alert, round(abs(i - o) / abs(i), 6) as gap from p""")
def v_gap_alert(spark, d):
    daily = _sliced(spark, d)
    s = lambda seg: F.when(F.count(F.when(F.col("segment") == seg, 1)) > 5, portfolio.sharpe(F.when(F.col("segment") == seg, F.col("net")))).otherwise(0.0)
    pair = daily.groupBy("window_id").agg(s("is").alias("i"), s("oos").alias("o"))
    gap = F.try_divide(F.abs(F.col("i") - F.col("o")), F.abs(F.col("i")))
    return rounded(pair.select("window_id", (gap > 0.5).alias("alert"), gap.alias("gap")), ["window_id", "alert"], "gap")


_CPCV = f"""
with {O.PANEL}, n as (select count(distinct date_utc) as n from panel), g as (select g, g * n // 6 as a, (g + 1) * n // 6 as b, n from n, unnest(range(6)) as u(g)),
c as (select row_number() over (order by x.g, y.g) - 1 as split_id, x.g as i, y.g as j from g x join g y on x.g < y.g),
t as (select split_id, g.g, g.a + case when g.g - 1 in (i, j) then 3 else 0 end as a, g.b - case when g.g + 1 in (i, j) then 7 else 0 end as b, g.g in (i, j) as test, g.b - g.a as size from c, g)
select split_id::int as split_id, sum(case when test then 0 else greatest(b - a, 0) end)::bigint as n_train, sum(case when test then size else 0 end)::bigint as n_test from t group by 1"""


@query(_CPCV)
def v_cpcv(spark, d):
    return validation.split_sizes(spark, brand_panel(spark, d), 6, 2, purge=7, embargo=3)


#: The splits by comparing every date with every group's bounds.
_ROLES = """
n as (select count(distinct date_utc) as n from panel), days as (select date_utc, row_number() over (order by date_utc) - 1 as i from (select distinct date_utc from panel)),
g as (select g, g * n // 6 as a, (g + 1) * n // 6 as b, n from n, unnest(range(6)) as u(g)),
c as (select row_number() over (order by x.g, y.g) - 1 as split_id, x.g as i, y.g as j from g x join g y on x.g < y.g),
roles as (
  select split_id::int as split_id, date_utc, case when g.g in (c.i, c.j) then 'test' else 'train' end as role from c, g join days on days.i >= g.a and days.i < g.b
  where g.g in (c.i, c.j) or not (g.g - 1 in (c.i, c.j) and days.i < g.a + 3 or g.g + 1 in (c.i, c.j) and days.i >= g.b - 7))"""


@query(f"with {O.PANEL}, {_ROLES} select split_id, date_utc, role from roles")
def v_cpcv_dates(spark, d):
    """Which dates each purged split trains on and tests on."""
    return validation.split_dates(brand_panel(spark, d), 6, 2, purge=7, embargo=3)


@query(f"""
with {O.SIGNALS}, {_ROLES}, {O.daily_ic('s', 'r7', joint=True)}
select split_id, role, count(ic) as n, round(avg(ic), 6) + 0.0 as mean, round(avg(ic) / nullif(stddev_pop(ic), 0), 6) + 0.0 as ratio from ic join roles using (date_utc) group by 1, 2""")
def v_cpcv_ic(spark, d):
    """The rank correlation of a signal over each split's training and test dates."""
    s = signals(spark, d)
    splits = validation.split_dates(s, 6, 2, purge=7, embargo=3)
    return rounded(validation.split_measures(ic.daily_ic(one(s, "s"), "r7", joint=True), splits), ["split_id", "role", "n"], "mean", "ratio")


@query("""
with i as (select distinct l_suppkey as id, l_partkey as item from lineitem), s as (select id, count(*) as n from i group by 1),
p as (select a.id as i, b.id as j, count(*) as n_both from i a join i b on a.item = b.item and a.id < b.id group by 1, 2)
select round(sum(n_both / (x.n + y.n - n_both)) / (select count(*) * (count(*) - 1) / 2 from s), 6) as jaccard from p join s x on x.id = p.i join s y on y.id = p.j""")
def v_jaccard(spark, d):
    """Of the parts that suppliers deliver."""
    sets = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set("l_partkey").alias("items"))
    return rounded(validation.jaccard_stability(sets), [], "jaccard")


def _part_scores(spark, d):
    return table(spark, d, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("k")).agg(
        F.round(F.avg("p_retailprice"), 4).alias("a"), F.round(F.avg("p_size"), 4).alias("b"), (-F.round(F.stddev_pop("p_retailprice"), 4)).alias("c"))


_NEXT = "lag({0}) over w{0} as lo_{0}, lead({0}) over w{0} as hi_{0}, max({0}) over (partition by front) - min({0}) over (partition by front) as span_{0}"


@query(f"""
with recursive p as (select p_brand || '/' || p_type as k, round(avg(p_retailprice), 4) as a, round(avg(p_size), 4) as b, -round(stddev_pop(p_retailprice), 4) as c from part group by 1),
peel as (  -- what is left for each front: rows that some row of the one before dominates
  select 1 as front, k, a, b, c from p
  union all
  select distinct x.front + 1, x.k, x.a, x.b, x.c from peel x join peel y on y.a >= x.a and y.b >= x.b and y.c >= x.c and (y.a > x.a or y.b > x.b or y.c > x.c)),
fronts as (select k, any_value(a) as a, any_value(b) as b, any_value(c) as c, max(front) as front from peel group by 1),
near as (select *, {", ".join(_NEXT.format(o) for o in "abc")} from fronts window {", ".join(f"w{o} as (partition by front order by {o}, k)" for o in "abc")})
select k, front, round({" + ".join(f"case when lo_{o} is null or hi_{o} is null then null when span_{o} > 0 then (hi_{o} - lo_{o}) / span_{o} else 0 end" for o in "abc")}, 6) as crowding from near""")
def e_fronts(spark, d):
    """All fronts of the parts' scores, with crowding; none at the ends of a front."""
    out = search.ranked_fronts(_part_scores(spark, d), "k", ["a", "b", "c"])
    return rounded(out.withColumn("crowding", F.nullif("crowding", F.lit(float("inf")))), ["k", "front"], "crowding")


@query("""
with p as (select p_brand as k, p_type as t, round(avg(p_retailprice), 4) as a, round(avg(p_size), 4) as b, -round(stddev_pop(p_retailprice), 4) as c from part group by 1, 2),
q as (select k || '/' || t as k, a, b, c from p)
select * from q x where not exists (select 1 from q y where y.a >= x.a and y.b >= x.b and y.c >= x.c and (y.a > x.a or y.b > x.b or y.c > x.c))""")
def e_pareto(spark, d):
    return search.pareto_front(_part_scores(spark, d), "k", ["a", "b", "c"])


@query()
def e_search(spark, d):
    """A seeded search of fewer formulas and generations than the defaults of Search, for its time; its Pareto front."""
    panel = factors.with_factors(factors.forward_return(brand_panel(spark, d), 7, "r7")).persist()
    front = search.Search(panel, "r7", population=30, generations=3, return_dates=panel.select("date_utc").distinct()).run()
    panel.unpersist()
    rows = [(str(t), f.rank_ic, f.stability, f.diversity) for t, f in front]
    return rounded(spark.createDataFrame(rows, "formula string, rank_ic double, stability double, diversity double"), ["formula"], "rank_ic", "stability", "diversity")


# --- reports ------------------------------------------------------------------------------------

@query(f"""
with {O.SIGNALS}, {O.daily_ic('s', 'r7')}
select date_utc, round(ic, 6) + 0.0 as ic, round(case when count(*) over w >= 10 then avg(ic) over w end, 6) + 0.0 as ma from ic window w as (order by date_utc rows between 29 preceding and current row)""")
def report_ic_series(spark, d):
    from pyspark.sql import Window

    w = Window.orderBy("date_utc").rowsBetween(-29, 0)
    daily = ic.daily_ic(one(signals(spark, d), "s"), "r7")
    return rounded(daily.withColumn("ma", F.when(F.count("*").over(w) >= 10, F.avg("ic").over(w))), ["date_utc"], "ic", "ma")


@query(f"""
with {O.SIGNALS}, {O.daily_ic('s', 'r7', name='a')}, {O.daily_ic('ls', 'r7', name='b')}, u as (select * from a union all select * from b)
select date_utc, round(avg(ic), 6) + 0.0 as ic from u group by 1""")
def report_ensemble_ic(spark, d):
    rows = long_form(signals(spark, d), ["s", "ls"], ["date_utc", "r7"])
    return rounded(ic.daily_ic(rows, "r7").groupBy("date_utc").agg(F.avg("ic").alias("ic")), ["date_utc"], "ic")


@query(f"""
with {O.SIGNALS}, k as (select date_utc, s, r7 as r, count(*) over {O.D} as n, list_sort(list_distinct([{_EDGES}])) as e from sig where s is not null),
dd as (select date_utc, greatest(len(list_filter(e, lambda v: v < s)) - 1, 0) + 1 as decile, avg(r) as ret from k where n >= 10 and len(e) > 1 group by 1, 2)
select date_utc, decile, printf('%.8e', product(1 + coalesce(ret, 0)) over (partition by decile order by date_utc rows unbounded preceding)) as cum_prod from dd""")
def report_decile_curves(spark, d):
    """Each bucket's compounded return."""
    rows = portfolio.decile_returns(signals(spark, d), "s", "r7").select("date_utc", F.col("decile").cast("long").alias("decile"), F.coalesce("ret", F.lit(0.0)).alias("ret"))
    return portfolio.curves(rows, "ret", by=("decile",)).select("date_utc", "decile", eight_digits("cum_prod").alias("cum_prod"))


@query(f"""
with {O.SIGNALS}, {O.daily_ic('s', 'r7')}, {O.hac('ic')}, {O.RETURNS}, {_CURVES}, {_DECAY}
select 'f' as formula, round(mean_ic, 6) + 0.0 as mean_ic, round(case when se > 0 then abs(mean_ic) / se else 0 end, 6) as stability,
  (select round(avg(net) / stddev_pop(net) * sqrt(365), 6) from net) as sharpe, (select round(avg(turnover), 6) from net) as turnover,
  (select round(min((cum_prod - peak) / peak), 6) from c2) as max_drawdown, {", ".join(f"(select round(coalesce(avg(ic), 0), 6) + 0.0 from ic{h}) as ic_{h}" for h in _HORIZONS)} from hac2""")
def report_summary(spark, d):
    """One row of measures of a formula: information coefficients, risk, decay and validation."""
    s = signals(spark, d)
    daily = ic.daily_ic(one(s, "s"), "r7")
    base = ic.newey_west(daily).select("formula", "mean_ic", "stability").crossJoin(_net(spark, d).agg(portfolio.sharpe(F.col("net")).alias("sharpe"), F.avg("turnover").alias("turnover")))
    decay = ic.ic_decay(one(s, "s"), "r7", _HORIZONS).groupBy("formula").pivot("horizon", _HORIZONS).agg(F.first("ic"))
    decay = decay.select("formula", *[F.col(str(h)).alias(f"ic_{h}") for h in _HORIZONS])
    out = base.join(decay, "formula").crossJoin(portfolio.max_drawdown(_net(spark, d), "net"))
    return rounded(out, ["formula"], "mean_ic", "stability", "sharpe", "turnover", "max_drawdown", *[f"ic_{h}" for h in _HORIZONS])
