"""Parameters of the scoring pipeline, validated on the driver."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, fields

# Results depend on each of them.
DIM = 14
NEIGHBOURS = 5
SCALE = 10_000
ABSENT = -1.0
MCC_DEFAULT_RISK = 0.5
MAX_PROBES = 28
DEFAULT_FAST_PROBES = 8
DEFAULT_FULL_PROBES = 28
BORDERLINE_VOTES = (2, 3)
DENY_FROM_VOTES = 3

# Risk by merchant category code.
MCC_RISK = {
    "5411": 0.15,
    "5812": 0.30,
    "5912": 0.20,
    "5944": 0.45,
    "7801": 0.80,
    "7802": 0.75,
    "7995": 0.85,
    "4511": 0.35,
    "5311": 0.25,
    "5999": 0.50,
}

# A cluster id fits sixteen bits, so the centroid table has a hard size bound
# (65,535 x 14 doubles = 7 MB) and may be broadcast.
MAX_CLUSTERS = 65_535


@dataclass(frozen=True)
class Normalization:
    """Divisors that bring each raw feature into [0, 1]."""

    max_amount: float = 10_000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1_440.0
    max_km: float = 1_000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10_000.0

    def __post_init__(self) -> None:
        for field in fields(self):
            value = getattr(self, field.name)
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ValueError(f"{field.name} must be a number, got {value!r}")
            if not math.isfinite(value) or value <= 0:
                raise ValueError(f"{field.name} must be positive, got {value!r}")
            object.__setattr__(self, field.name, float(value))


@dataclass(frozen=True)
class ProbeParams:
    """How many clusters the fast pass and the extended pass visit."""

    fast: int = DEFAULT_FAST_PROBES
    full: int = DEFAULT_FULL_PROBES

    @classmethod
    def from_env(cls, environ: dict[str, str] | None = None) -> ProbeParams:
        """Read N_PROBE_FAST / N_PROBE_FULL; unset or unparsable means default."""
        environ = os.environ if environ is None else environ

        def read(name: str, default: int) -> int:
            try:
                return int(environ[name])
            except (KeyError, ValueError):
                return default

        return cls(
            fast=read("N_PROBE_FAST", DEFAULT_FAST_PROBES),
            full=read("N_PROBE_FULL", DEFAULT_FULL_PROBES),
        )

    def clamped(self, clusters: int) -> ProbeParams:
        """The effective probe counts against an index of ``clusters`` clusters."""
        ceiling = min(clusters, MAX_PROBES)
        fast = min(max(self.fast, 1), ceiling)
        return ProbeParams(fast=fast, full=min(max(self.full, fast), ceiling))


@dataclass(frozen=True)
class BuildParams:
    """Index-build settings."""

    clusters: int = 4_096
    train_rows: int = 50_000
    max_iter: int = 25
    early_stop: float = 0.001
    seed: int = 2_026

    def __post_init__(self) -> None:
        if not 1 <= self.clusters <= MAX_CLUSTERS:
            raise ValueError(f"clusters must be in 1..{MAX_CLUSTERS}, got {self.clusters}")
        if self.train_rows < 1:
            raise ValueError(f"train_rows must be positive, got {self.train_rows}")
        if self.max_iter < 1:
            raise ValueError(f"max_iter must be positive, got {self.max_iter}")
