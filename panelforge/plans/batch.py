"""Many formulas over one panel as few DataFrame stages.

Equal subtrees of all formulas are one column. What is ready is computed in turns: arithmetic by
row, then all time-series columns (one exchange and sort by ticker), then all cross-sectional ones
(one exchange by date), so a batch takes a few exchanges however many formulas it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .formula import BINARY, SERIES, UNARY, Node

ROW = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": C.safe_div}
BY_TICKER = {"ts_mean": C.ts_mean, "ts_std": C.ts_std, "delta": C.delta, "ts_rank": C.ts_rank}
BY_DATE = {"rank": C.cs_rank, "zscore": C.cs_zscore, "winsor": C.cs_winsor}
assert set(ROW) == set(BINARY) and set(BY_TICKER) == set(SERIES) and set(BY_DATE) == set(UNARY)


def evaluate(panel: DataFrame, formulas: dict[str, Node]) -> DataFrame:
    """`panel` with a column for each formula, under its name in `formulas`.

    Results beyond the range of doubles, and not-a-numbers, are NULL.
    """
    nodes = dict.fromkeys(n for tree in formulas.values() for n in tree.walk() if n.args)
    names = {n: f"_n{k}" for k, n in enumerate(nodes)}
    done: set[Node] = set()
    out = panel

    def value(n: Node) -> Column:
        return F.col(names[n] if n.args else n.op)

    def ready(ops) -> list[Node]:
        return [n for n in nodes if n not in done and n.op in ops and all(a in done or not a.args for a in n.args)]

    while len(done) < len(nodes):
        for ops in (ROW, BY_TICKER, BY_DATE):
            while own := ready(ops):
                columns = {names[n]: ops[n.op](*map(value, n.args), *([n.rows] if n.rows else [])) for n in own}
                out = out.withColumns({k: F.nanvl(v, F.lit(None).cast("double")) if ops is ROW else v for k, v in columns.items()})
                done.update(own)
                if ops is not ROW:
                    break
    return out.select(*panel.columns, *[value(tree).alias(name) for name, tree in formulas.items()])


def long_form(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """`keep`, formula, x: a row for each named column of each row."""
    pairs = F.array(*[F.struct(F.lit(n).alias("formula"), F.col(n).cast("double").alias("x")) for n in names])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.formula", "_p.x")
