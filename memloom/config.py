"""Settings of the engine, one frozen value for a job."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Numbers that results depend on; ``Config(beam=4)`` overrides one."""

    depth: int = 4
    beam: int = 8
    walk_threshold: float = -0.1
    subgraph_budget: float = 10.0
    neighbours: int = 10
    delta: float = 0.05
    algorithm: str = "greedy"  # of modes.ALGORITHMS
    support: str = "lexical"  # or tfidf
    dim: int = 256
    regions: int = 10
