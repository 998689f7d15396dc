"""SQL for DuckDB that says, independently, what the panel queries must give."""

from __future__ import annotations

from .plans.formula import BINARY, SERIES, Node

PANEL = """
base as (
  select date_trunc('week', l_shipdate)::date as date_utc, p_brand as ticker,
    round(sum(l_extendedprice) / sum(l_quantity) + 1e-9, 6) as close, round(sum(l_quantity), 6) as volume,
    round(sum(l_extendedprice * (1 - l_discount)), 4) as market_cap, round(avg(l_discount) - avg(l_tax), 8) + 0.0 as funding_rate,
    round(sum(case when l_returnflag = 'N' then l_quantity else 0 end), 6) as taker_buy_volume,
    round(sum(case when l_returnflag <> 'N' then l_quantity else 0 end), 6) as taker_sell_volume,
    round(sum(case when l_linestatus = 'O' then l_extendedprice else 0 end), 4) as oi_usd,
    round(sum(case when l_returnflag = 'R' then l_quantity end) / nullif(sum(case when l_returnflag = 'A' then l_quantity end), 0), 8) as ls_ratio
  from lineitem join part on l_partkey = p_partkey group by 1, 2),
panel as (
  select *, round(taker_buy_volume / nullif(taker_buy_volume + taker_sell_volume, 0), 8) as taker_buy_ratio,
    round((taker_buy_volume - taker_sell_volume) / nullif(taker_buy_volume + taker_sell_volume, 0), 8) + 0.0 as taker_net_volume,
    'CAT' || (substr(ticker, 7)::int % 5)::varchar as category
  from base)"""
T = "(partition by ticker order by date_utc)"
D = "(partition by date_utc)"
SIGNALS = f"""{PANEL},
sig as (
  select *, round(close / lag(close, 7) over {T} - 1, 10) + 0.0 as s, lag(ls_ratio) over {T} as ls,
    round(lead(close, 7) over {T} / close - 1, 10) + 0.0 as r7, round(lead(close, 1) over {T} / close - 1, 10) + 0.0 as r1
  from panel)"""


def frame(rows: int) -> str:
    return f"(partition by ticker order by date_utc rows between {rows - 1} preceding and current row)"


def rank(x: str, by: str = "date_utc") -> str:
    return (
        f"case when {x} is not null then (rank() over (partition by {by} order by {x} nulls last) + (count(*) over (partition by {by}, {x}) - 1) / 2.0) "
        f"/ count({x}) over (partition by {by}) end"
    )


def guarded(agg: str, x: str, rows: int, least: int | None = None) -> str:
    return f"case when count({x}) over {frame(rows)} >= {least or rows} then {agg}({x}) over {frame(rows)} end"


def zscore(x: str) -> str:
    return f"({x} - avg({x}) over {D}) / nullif(stddev_pop({x}) over {D}, 0)"


def winsor(x: str) -> str:
    return f"case when {x} is not null then least(greatest({x}, quantile_cont({x}, 0.01) over {D}), quantile_cont({x}, 0.99) over {D}) end"


def stages(steps: list[str], start: str) -> tuple[str, str]:
    """CTEs that add a column x1, x2, ... each, and the last one's name."""
    out, last = [], start
    for k, step in enumerate(steps, 1):
        out.append(f"q{k} as (select *, {step} as x{k} from {last})")
        last = f"q{k}"
    return ", ".join(out), last


def formula(tree: Node, source: str = "panel") -> tuple[str, str, str]:
    """CTEs, the last one's name and the column of a formula over `source`."""
    steps: list[str] = []

    def visit(n: Node) -> str:
        if not n.args:
            return n.op
        a = [visit(x) for x in n.args]
        if n.op in BINARY:
            sign = {"add": "+", "sub": "-", "mul": "*"}.get(n.op)
            steps.append(f"{a[0]} {sign} {a[1]}" if sign else f"case when abs({a[1]}) > 1e-10 then {a[0]} / {a[1]} end")
        elif n.op in SERIES:
            x, w = a[0], n.rows
            if n.op == "ts_rank":
                steps.append(f"list({x}) over {frame(w)}")
                have = f"x{len(steps)}"
                count = lambda c: f"len(list_filter({have}, lambda v: v {c}))"
                steps.append(f"case when {x} is not null and {count('is not null')} = {w} then ({count(f'< {x}')} + ({count(f'= {x}')} + 1) / 2.0) / {w} end")
            else:
                steps.append({"ts_mean": guarded("avg", x, w), "ts_std": guarded("stddev_pop", x, w), "delta": f"{x} - lag({x}, {w}) over {T}"}[n.op])
        else:
            steps.append({"rank": rank, "zscore": zscore, "winsor": winsor}[n.op](a[0]))
        return f"x{len(steps)}"

    column = visit(tree)
    ctes, last = stages(steps, source)
    return ctes, last, column


#: Steps of each factor; the last is its value.
_RET = ["last_value(close ignore nulls) over " + frame(1_000_000), f"x1 / nullif(lag(x1) over {T}, 0) - 1"]
_ZS = lambda c: [f"lag({c}) over {T}", f"(x1 - {guarded('avg', 'x1', 30, 20)}) / nullif({guarded('stddev_pop', 'x1', 30, 20)}, 0)", zscore("x2")]
FACTORS: dict[str, list[str]] = {
    "MOM_1D": [f"close / nullif(lag(close, 1) over {T}, 0) - 1"],
    "MOM_7D": [f"close / nullif(lag(close, 7) over {T}, 0) - 1"],
    "MOM_30D": [f"close / nullif(lag(close, 30) over {T}, 0) - 1"],
    "MOM_90D": [f"lag(close, 7) over {T} / nullif(lag(close, 97) over {T}, 0) - 1"],
    "FUNDING_RATE": [f"lag(funding_rate) over {T}"],
    "FUNDING_RATE_ZS": _ZS("funding_rate"),
    "TAKER_BUY_RATIO": [f"lag(taker_buy_ratio) over {T}"],
    "TAKER_NET_VOLUME": [f"lag(taker_net_volume) over {T}"],
    "OI_CHANGE": [f"(lag(oi_usd, 1) over {T} - lag(oi_usd, 2) over {T}) / nullif(lag(oi_usd, 2) over {T}, 0)"],
    "OI_USD": ["ln(nullif(oi_usd, 0))", f"lag(x1) over {T}"],
    "LS_RATIO": [f"lag(ls_ratio) over {T}"],
    "LS_RATIO_ZS": _ZS("ls_ratio"),
    "VOL_30D": [*_RET, f"({guarded('stddev_pop', 'x2', 30, 20)}) * sqrt(365)"],
    "LOG_MCAP": ["ln(nullif(market_cap, 0))"],
    "AMIHUD": [*_RET, "abs(x2) / nullif(close * volume, 0)", f"lag(x3) over {T}"],
    "SKEW_30D": [*_RET, guarded("skewness", "x2", 30, 20)],
}


def factor(name: str, digits: int = 6) -> str:
    ctes, last = stages(FACTORS[name], "panel")
    return f"with {PANEL}, {ctes} select date_utc, ticker, round(x{len(FACTORS[name])}, {digits}) as value from {last}"


def digits_of(name: str) -> int:
    """Digits to which a factor is compared: small values to more, rounded inputs to their own."""
    return 12 if name == "AMIHUD" else 8 if name.startswith("TAKER") else 6


def all_factors() -> str:
    """All factors side by side."""
    first, *rest = FACTORS
    joins = " ".join(f"join ({factor(n, digits_of(n))}) as q_{n} using (date_utc, ticker)" for n in rest)
    return f"select date_utc, ticker, {', '.join(f'q_{n}.value as {n}' for n in FACTORS)} from ({factor(first, digits_of(first))}) as q_{first} {joins}"


def formula_batch(trees: dict[str, tuple[Node, int]]) -> str:
    """date_utc, ticker, formula, x of several formulas, each to its number of digits."""
    return " union all ".join(f"select date_utc, ticker, '{k}' as formula, value as x from ({formula_query(t, n)})" for k, (t, n) in trees.items())


def formula_query(tree: Node, digits: int) -> str:
    ctes, last, column = formula(tree)
    return f"with {PANEL}, {ctes} select date_utc, ticker, round({column}, {digits}) + 0.0 as value from {last}"


def corr(a: str, b: str) -> str:
    return f"case when isnan(corr({a}, {b})) then null else corr({a}, {b}) end"


def daily_ic(x: str, r: str, joint: bool = False, least: int = 10, source: str = "sig", name: str = "ic") -> str:
    """CTEs that end in `name` (date_utc, ic)."""
    where = f"where {x} is not null and {r} is not null" if joint else ""
    return f"""
{name}_r as (select date_utc, {x} as x, {r} as y, {rank(x)} as a, {rank(r)} as b from {source} {where}),
{name} as (
  select date_utc, ic from (
    select date_utc, count(x) as n, {corr("case when b is not null then a end", "case when a is not null then b end")} as ic from {name}_r group by 1)
  where n >= {least} and ic is not null)"""




def bootstrap(source: str, by: str, replicates: int, seed: int = 42) -> str:
    """CTE bounds (by, mean, lower, upper) of `source` (by, date_utc, ic): every position of every replicate looks its value up."""
    u = lambda *parts: f"(('0x' || substr(md5('{seed}|' || {' || '.join(parts)}), 1, 13))::bigint / 4503599627370496.0::double)"
    return f"""
spots as (select {by}, ic, row_number() over (partition by {by} order by date_utc) - 1 as t, count(*) over (partition by {by}) as n from {source}),
drawn as (
  select {by}, replicate, t, n, case when t = 0 or {u("'anew|'", "replicate", "'|'", "t")} < 0.1 then t end as begun from spots, unnest(range(1, {replicates} + 1)) as q(replicate)),
placed as (select *, max(begun) over (partition by {by}, replicate order by t) as b from drawn),
picked as (select {by}, replicate, ((floor({u("'from|'", "replicate", "'|'", "b")} * n)::bigint + t - b) % n)::bigint as t from placed),
means as (select {by}, replicate, avg(ic) as m from picked join spots using ({by}, t) group by all),
bounds as (
  select {by}, case when n >= 10 then mean end as mean, case when n < 10 then null when same then mean else lower end as lower, case when n < 10 then null when same then mean else upper end as upper
  from (select {by}, count(*) as n, avg(ic) as mean, min(ic) = max(ic) as same from {source} group by all)
  join (select {by}, quantile_cont(m, 0.025) as lower, quantile_cont(m, 0.975) as upper from means group by all) using ({by}))"""


def weights(source: str = "sig", by: str = "") -> str:
    """CTEs that end in weights; `by` (ending in a comma) holds several portfolios apart."""
    d = f"(partition by {by} date_utc)"
    return f"""
lim as (select *, quantile_cont(s, 0.9) over {d} as hi, quantile_cont(s, 0.1) over {d} as lo from {source}),
side as (select *, coalesce(s >= hi, false) as up, coalesce(s <= lo, false) as down from lim),
weights as (
  select *, case when down then -1.0 / sum(down::int) over {d} when up then 1.0 / sum(up::int) over {d} else 0 end as w from side)"""


def returns(source: str = "sig", by: str = "") -> str:
    """CTEs that end in net (by, date_utc, ret, turnover, net)."""
    t = f"(partition by {by} ticker order by date_utc)"
    of = f"partition by {by.rstrip(', ')} " if by else ""
    return f"""{weights(source, by)},
ord as (select *, dense_rank() over ({of}order by date_utc) as k from weights),
moved as (select *, case when lag(k) over {t} = k - 1 then abs(w - lag(w) over {t}) end as d from ord),
daily as (select {by} date_utc, coalesce(sum(w * r1), 0) as ret, coalesce(sum(d), 0) as turnover from moved group by all),
net as (select *, ret - turnover * 10 / 1e4 as net from daily)"""


WEIGHTS, RETURNS = weights(), returns()


def hac(source: str) -> str:
    """CTE hac (n, mean_ic, se) of `source` (date_utc, ic)."""
    return f"""
e as (select row_number() over (order by date_utc) as i, ic - avg(ic) over () as e, avg(ic) over () as m, count(*) over () as n from {source}),
l as (select max(m) as m, max(n) as n, greatest(1, least(floor(4 * power(max(n) / 100.0, 2 / 9.0))::int, max(n)::int - 1)) as lags from e),
g as (
  select k, (select coalesce(sum(a.e * b.e), 0) from e a join e b on a.i = b.i + k) / n as gamma
  from l, unnest(range(0, lags + 1)) as u(k)),
hac as (
  select n, m as mean_ic, (select sum(case when k = 0 then gamma else 2 * (1 - k / (lags + 1.0)) * gamma end) from g) * n / (n - 1) as v from l),
hac2 as (select n, mean_ic, case when v > 0 then sqrt(v / n) else 0 end as se from hac)"""
