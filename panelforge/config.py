"""Run configuration, from a mapping or a YAML file."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

from .operators.factors import FACTORS


@dataclass
class Data:
    start: str = "1995-01-01"
    end: str = "2001-12-31"
    is_end: str = "2000-01-01"
    universe_size: int = 200
    funding_lag: int = 1
    max_gap: int = 3


@dataclass
class Search:
    names: list[str] = field(default_factory=lambda: list(FACTORS))
    population: int = 100
    generations: int = 50
    mate: float = 0.5
    mutate: float = 0.2
    max_nodes: int = 17


@dataclass
class Backtest:
    fraction: float = 0.1
    cost_bps: float = 10.0
    horizon: int = 7
    decay_horizons: list[int] = field(default_factory=lambda: [1, 3, 7, 14, 30])
    is_days: int = 730
    oos_days: int = 180
    step_days: int = 365
    gap_threshold: float = 0.5
    replicates: int = 1000


@dataclass
class Config:
    seed: int = 42
    data: Data = field(default_factory=Data)
    search: Search = field(default_factory=Search)
    backtest: Backtest = field(default_factory=Backtest)

    @classmethod
    def of(cls, values: dict) -> Config:
        """From nested mappings; a KeyError names what no section has."""
        def filled(kind, given: dict):
            known = {f.name: f for f in fields(kind)}
            if unknown := set(given) - set(known):
                raise KeyError(f"unknown settings: {sorted(unknown)}")
            parts = {"data": Data, "search": Search, "backtest": Backtest}
            return kind(**{k: filled(parts[k], v) if k in parts and isinstance(v, dict) else v for k, v in given.items()})

        return filled(cls, values or {})

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        with open(path) as file:
            return cls.of(yaml.safe_load(file))

    def as_dict(self) -> dict:
        return asdict(self)
