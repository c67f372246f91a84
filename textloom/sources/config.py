"""Run settings read from a JSON or YAML file and checked on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    sequence_length: int = 4096
    per_shard: int = 12500
    quality_cut: float = 0.4
    minhash_slots: int = 64
    near_threshold: float = 0.8
    seed: int = 42
    policy: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if min(self.sequence_length, self.per_shard, self.minhash_slots) <= 0:
            raise ValueError("sizes must be positive")
        if not 0 < self.near_threshold <= 1:
            raise ValueError("near_threshold must lie in (0, 1]")
        if self.seed < 0:
            raise ValueError("seed must not be negative")

    @classmethod
    def load(cls, path: str) -> Settings:
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ValueError("YAML settings need the yaml package") from e
            return cls(**(yaml.safe_load(text) or {}))
        return cls(**json.loads(text))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2, sort_keys=True))
