"""Options with the defaults the batch and streaming jobs share."""

from dataclasses import dataclass


@dataclass(frozen=True)
class WindowOptions:
    seconds: int = 60
    stride: int | None = None
    min_edges: int = 8
    max_edges: int | None = None  # a sample of so many edges from each larger window
    anchor: str = "first"  # "first": the earliest flow; "epoch": multiples of the width
    subnet_prefix: int | None = None
    add_reverse_edges: bool = True
    drop_edge_features: tuple = ()
    seed: int = 0


@dataclass(frozen=True)
class SplitOptions:
    train_frac: float = 0.70
    val_frac: float = 0.15
    gap_seconds: int = 300
    episode_gap_seconds: int = 120
    min_episodes: int = 3
    min_frac: float = 0.02
    benign: str = "BENIGN"


@dataclass(frozen=True)
class ServiceLimits:
    threshold: float = 0.75
    poll_seconds: int = 5
    max_retries: int = 5
    pending_seconds: int = 180
    claim_seconds: int = 60
    cidr: str = "10.0.0.0/24"
    retention_hours: int = 24
