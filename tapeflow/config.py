"""Typed configuration from TOML; unknown sections stay in ``raw``."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Windows:
    short_s: float = 2.0
    mid_s: float = 10.0
    long_s: float = 60.0


@dataclass(frozen=True)
class Scales:
    window: int = 3600
    least: int = 30
    gap_cap_s: int = 3600
    horizons: tuple[int, ...] = (30, 120, 600)


@dataclass(frozen=True)
class Labels:
    horizons: tuple[int, ...] = (30, 120, 600)
    cost: float = 0.2
    ratio: float = 2.0


@dataclass(frozen=True)
class Config:
    windows: Windows = Windows()
    scales: Scales = Scales()
    labels: Labels = Labels()
    paths: dict = field(default_factory=dict)
    raw: dict = field(default_factory=dict)

    def fingerprint(self) -> dict:
        """What fixes the meaning of normalized columns."""
        return {"window": self.scales.window, "least": self.scales.least, "gap_cap_s": self.scales.gap_cap_s, "horizons": list(self.scales.horizons)}


def load(path: str | Path) -> Config:
    """Reads a TOML file; relative entries of ``[paths]`` resolve against the file's folder."""
    path = Path(path)
    raw = tomllib.loads(path.read_text())
    pick = lambda kind, name: kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.get(name, {}).items() if k in kind.__dataclass_fields__})
    paths = {k: str(v if Path(v).is_absolute() else (path.parent / v).resolve()) for k, v in raw.get("paths", {}).items()}
    return Config(pick(Windows, "windows"), pick(Scales, "scales"), pick(Labels, "labels"), paths, raw)
