"""The formula language: typed prefix expressions over factor columns.

panel := NAME | op1(panel) | op2(panel, panel) | ts(panel, W_n); a formula is an immutable tree
that prints as it is written.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, replace

from ..operators.factors import FACTORS
from ..operators.panel import BloatLimitExceeded, InvalidFormulaError

UNARY = ("rank", "zscore", "winsor")
BINARY = ("add", "sub", "mul", "div")
SERIES = ("ts_mean", "ts_std", "delta", "ts_rank")
WINDOWS = (7, 14, 30, 90)
MAX_NODES = 17


@dataclass(frozen=True)
class Node:
    """`op` is an operator or a column; `args` are its panels, `rows` the window of a time-series operator."""

    op: str
    args: tuple[Node, ...] = ()
    rows: int | None = None

    def __str__(self) -> str:
        if not self.args:
            return self.op
        return f"{self.op}({', '.join([*map(str, self.args), *([f'W_{self.rows}'] if self.rows else [])])})"

    @property
    def size(self) -> int:
        """Nodes, windows among them."""
        return 1 + (self.rows is not None) + sum(a.size for a in self.args)

    @property
    def depth(self) -> int:
        return 1 + max((a.depth for a in self.args), default=1 if self.rows else 0) if self.args else 0

    @property
    def look_back(self) -> int:
        """Rows before the current one that can enter."""
        own = 0 if self.rows is None else self.rows if self.op == "delta" else self.rows - 1
        return own + max((a.look_back for a in self.args), default=0)

    @property
    def columns(self) -> set[str]:
        return {self.op} if not self.args else set().union(*(a.columns for a in self.args))

    def walk(self):
        yield self
        for a in self.args:
            yield from a.walk()


def parse(text: str, names: list[str] | None = None) -> Node:
    """The tree of a formula; InvalidFormulaError for anything else. `names` are the allowed columns."""
    tokens = re.findall(r"[A-Za-z_][A-Za-z_0-9]*|[(),]|\S", text)
    allowed = set(FACTORS if names is None else names)
    at = 0

    def take(*expected: str) -> str:
        nonlocal at
        if at >= len(tokens) or expected and tokens[at] not in expected:
            raise InvalidFormulaError(f"expected {' or '.join(expected) or 'more'} at token {at + 1} of {text!r}")
        at += 1
        return tokens[at - 1]

    def panel() -> Node:
        name = take()
        if name in UNARY or name in BINARY or name in SERIES:
            take("(")
            args, rows = [panel()], None
            if name in BINARY:
                take(",")
                args.append(panel())
            elif name in SERIES:
                take(",")
                rows = int(take(*(f"W_{w}" for w in WINDOWS))[2:])
            take(")")
            return Node(name, tuple(args), rows)
        if name not in allowed:
            raise InvalidFormulaError(f"{name!r} is no column or operator")
        return Node(name)

    tree = panel()
    if at < len(tokens):
        raise InvalidFormulaError(f"{tokens[at]!r} follows a whole formula")
    return tree


def random_tree(rng: random.Random, low: int = 2, high: int = 4, names: list[str] = FACTORS) -> Node:
    """A tree all of whose branches have one height between `low` and `high`."""
    def grow(height: int) -> Node:
        if height == 0:
            return Node(rng.choice(names))
        op = rng.choice(UNARY + BINARY + SERIES)
        args = tuple(grow(height - 1) for _ in range(2 if op in BINARY else 1))
        return Node(op, args, rng.choice(WINDOWS) if op in SERIES else None)

    return grow(rng.randint(low, high))


def _replaced(tree: Node, at: int, new: Node) -> Node:
    """The tree with its node number `at`, in walking order, as `new`."""
    if at == 0:
        return new
    at -= 1
    for k, a in enumerate(tree.args):
        n = sum(1 for _ in a.walk())
        if at < n:
            return replace(tree, args=(*tree.args[:k], _replaced(a, at, new), *tree.args[k + 1 :]))
        at -= n
    raise IndexError(at)


def crossover(rng: random.Random, a: Node, b: Node, most: int = MAX_NODES) -> tuple[Node, Node]:
    """Swaps a subtree of each, never a root; a child of more than `most` nodes is its parent again."""
    in_a, in_b = list(a.walk()), list(b.walk())
    if len(in_a) < 2 or len(in_b) < 2:
        return a, b
    i, j = rng.randrange(1, len(in_a)), rng.randrange(1, len(in_b))
    x, y = _replaced(a, i, in_b[j]), _replaced(b, j, in_a[i])
    return (x if x.size <= most else a), (y if y.size <= most else b)


def mutate(rng: random.Random, tree: Node, names: list[str] = FACTORS, most: int = MAX_NODES) -> Node:
    """A fresh subtree of height 1 to 3 in place of a random one."""
    at = rng.randrange(sum(1 for _ in tree.walk()))
    new = _replaced(tree, at, random_tree(rng, 1, 3, names))
    return new if new.size <= most else tree


def mutate_point(rng: random.Random, tree: Node, names: list[str] = FACTORS) -> Node:
    """Another operator, column or window of the same kind at a random node."""
    nodes = list(tree.walk())
    at = rng.randrange(len(nodes))
    old = nodes[at]
    kind = next((k for k in (UNARY, BINARY, SERIES) if old.op in k), names)
    return _replaced(tree, at, replace(old, op=rng.choice(kind), rows=rng.choice(WINDOWS) if old.rows else None))


def bounded(tree: Node, most: int = MAX_NODES) -> Node:
    if tree.size > most:
        raise BloatLimitExceeded(f"{tree.size} nodes; {most} are allowed")
    return tree
