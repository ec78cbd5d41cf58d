"""Settings of the engine; ``validate`` names every problem at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from loci.functions import scoring as S


@dataclass(frozen=True)
class EngineConfig:
    dim: int = 384
    fusion: str = "minmax"  # or 'linear', 'rrf'
    weights: tuple[float, float, float] = (S.WEIGHT_KEYWORD, S.WEIGHT_VECTOR, S.WEIGHT_ENTITY)
    coverage: float = S.COVERAGE
    rrf_k: int = S.RRF_K
    gate: float = S.SEMANTIC_GATE
    graph_signals: bool = True
    half_life_days: float = S.DECAY_DAYS
    stale_below: float = S.STALE
    prune_age_days: float = S.STALE_DAYS
    broadcast_queries: int = 100_000
    extra: dict = field(default_factory=dict)

    def validate(self) -> EngineConfig:
        wrong = []
        if not 1 <= self.dim <= 65_536:
            wrong.append("dim must be in 1..65536")
        if self.fusion not in ("minmax", "linear", "rrf"):
            wrong.append("fusion must be minmax, linear or rrf")
        if len(self.weights) != 3 or any(w < 0 for w in self.weights) or sum(self.weights) <= 0:
            wrong.append("weights must be three numbers, not negative, not all zero")
        if not 0 <= self.coverage <= 1:
            wrong.append("coverage must be in [0, 1]")
        if self.rrf_k < 0:
            wrong.append("rrf_k must not be negative")
        if self.half_life_days <= 0:
            wrong.append("half_life_days must be positive")
        if not 0 <= self.stale_below <= 1:
            wrong.append("stale_below must be in [0, 1]")
        if self.prune_age_days < 0:
            wrong.append("prune_age_days must not be negative")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self


def top_k(k: int | None) -> int:
    """Results asked for: 5 unless positive, at most 200."""
    return 5 if not k or k <= 0 else min(k, 200)


def pools(k: int) -> tuple[int, int, int]:
    """Candidates taken from the keyword, vector and entity retriever for ``k`` results."""
    k = max(1, k)
    return min(10 * k, 500), min(10 * k, 200), min(5 * k, 100)
