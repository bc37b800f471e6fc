"""Typed thresholds and tuning knobs. Defaults are fixed values of the analysis."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DriftOptions:
    """Window sizes and the thresholds behind the window verdict."""

    window_sizes: tuple[tuple[str, int], ...] = (("5min", 300_000), ("30min", 1_800_000), ("1h", 3_600_000))
    drift_jsd: float = 0.15
    quality_drop_delta: float = 0.5
    quality_bad_abs: float = 3.0
    gpu_pressure: float = 0.6
    net_latency_us: float = 500.0


@dataclass(frozen=True)
class CorrelationOptions:
    """Tolerance between a model call and the metric samples around it."""

    tolerance_ms: int = 10_000
    live_margin_ms: int = 15_000
    live_fallback_samples: int = 2
    tile_ms: int = 10_000
    # Nodes are dealt into so many groups where traces meet the samples of all nodes.
    node_groups: int = 16


@dataclass(frozen=True)
class StepOptions:
    lookback_hours: int = 1
    # Steps of one trace are first put in order inside slices of this length.
    path_slice_ms: int = 300_000


@dataclass(frozen=True)
class RoutingOptions:
    default_node: str = "node-1"
    default_gpu: str = "gpu-0"
    pod_prefix: str = "ollama-"


@dataclass(frozen=True)
class FreshnessOptions:
    timeout_s: int = 30


DRIFT = DriftOptions()
CORRELATION = CorrelationOptions()
STEPS = StepOptions()
ROUTING = RoutingOptions()
FRESHNESS = FreshnessOptions()
