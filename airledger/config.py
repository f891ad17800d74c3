"""Settings: typed sections with defaults, and a YAML file that overrides them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class Split:
    train: float = 0.65
    cal: float = 0.15
    test: float = 0.20
    strategy: str = "station_grouped"


@dataclass(frozen=True)
class Physics:
    patch: int = 15
    omega: float = 0.95
    top_share: float = 0.001
    t_min: float = 0.05
    size: int = 224


@dataclass(frozen=True)
class Train:
    point_weight: float = 1.0
    huber_delta: float = 1.0
    balance_power: float = 1.0


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    coverage: float = 0.90
    quantiles: tuple[float, ...] = (0.05, 0.50, 0.95)
    split: Split = field(default_factory=Split)
    physics: Physics = field(default_factory=Physics)
    train: Train = field(default_factory=Train)


def overridden(base, given: dict):
    """`base` with the values of `given`, section by section; a name that no section has is an error."""
    known = {f.name for f in fields(base)}
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    now = {name: getattr(base, name) for name in given}
    return replace(base, **{n: overridden(now[n], v) if is_dataclass(now[n]) else tuple(v) if isinstance(now[n], tuple) else v for n, v in given.items()})


def find_config(start: str | Path = ".", name: str = "airledger.yaml") -> Path | None:
    """The nearest file of that name in `start` or a folder above it."""
    here = Path(start).resolve()
    return next((p / name for p in (here, *here.parents) if (p / name).is_file()), None)


def load_config(path: str | Path | None = None) -> Settings:
    """The defaults, overridden by the file at `path` or the nearest one."""
    path = path or find_config()
    if not path:
        return Settings()
    import yaml

    return overridden(Settings(), yaml.safe_load(Path(path).read_text()) or {})
