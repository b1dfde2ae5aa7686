"""Configuration: a YAML file over documented defaults, checked once."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Demand:
    slot_minutes: int = 15
    max_match_m: float = 250.0
    poi_match_m: float = 100.0
    poi_top_k: int = 10
    distance_top_k: int = 10
    decay_m: float = 3000.0

    def __post_init__(self) -> None:
        if self.slot_minutes <= 0:
            raise ValueError("slot_minutes must be positive")


@dataclass(frozen=True)
class Supply:
    max_gap_minutes: float = 60.0
    merge_gap_s: float = 0.0
    slot_minutes: int = 15
    mode: str = "daily"

    def __post_init__(self) -> None:
        if self.mode not in ("daily", "global"):
            raise ValueError(f"unknown mode {self.mode}")


@dataclass(frozen=True)
class Partitioning:
    clusters: int | None = 137
    resolution: float = 0.8
    lambda_c: tuple[float, ...] = (0.2, 0.5, 1.0, 2.0)
    lambda_r: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0)
    move_policy: str = "best_improving"
    capacity_loss: str = "squared_hinge"

    def __post_init__(self) -> None:
        if self.move_policy != "best_improving" or self.capacity_loss != "squared_hinge":
            raise ValueError("only best_improving moves and the squared_hinge loss are known")
        if not self.lambda_c or not self.lambda_r:
            raise ValueError("the grid of settings is empty")


@dataclass(frozen=True)
class Config:
    scopes: dict[str, dict[str, Any]] = field(default_factory=lambda: {"default": {}})
    active_scope: str = "default"
    demand: Demand = Demand()
    supply: Supply = Supply()
    partitioning: Partitioning = Partitioning()

    def __post_init__(self) -> None:
        if self.active_scope not in self.scopes:
            raise ValueError(f"unknown scope {self.active_scope}")

    @property
    def scope(self) -> dict[str, Any]:
        """The active scope's values over those of the scope ``default``."""
        return self.scopes.get("default", {}) | self.scopes[self.active_scope]

    def path(self, name: str, root: str | Path = ".") -> str:
        """A path that the scope names, below ``root`` unless it is absolute or a URI; a name it lacks is an error."""
        if not self.scope.get(name):
            raise ValueError(f"scope {self.active_scope} names no {name}")
        value = str(self.scope[name])
        return value if "://" in value or value.startswith("/") else f"{str(root).rstrip('/')}/{value}"


def _section(kind: type, values: dict[str, Any]) -> Any:
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings of {kind.__name__.lower()}: {', '.join(sorted(unknown))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load_config(path: str | Path | None = None) -> Config:
    """The defaults, or those with a YAML file's values over them."""
    if path is None:
        return Config()
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    kinds = {"demand": Demand, "supply": Supply, "partitioning": Partitioning}
    return Config(**{k: _section(kinds[k], v or {}) if k in kinds else v for k, v in raw.items()})
