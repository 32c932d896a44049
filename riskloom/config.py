"""Settings, passed in explicitly. Salts have no default and are never logged."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class GraphSettings:
    co_billing_window_days: int = 30
    similarity_threshold: float = 0.8


@dataclass(frozen=True)
class ModelSettings:
    embedding_dim: int = 128
    focal_alpha: float = 0.25
    focal_gamma: float = 2.0


@dataclass(frozen=True)
class Settings:
    graph: GraphSettings = field(default_factory=GraphSettings)
    model: ModelSettings = field(default_factory=ModelSettings)
    investigator_capacity: int = 50
    random_seed: int = 42
