"""Column functions over GPU and network metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.options import ROUTING, RoutingOptions

# Weights and caps of the contention index.
CONTENTION_WEIGHTS = {
    "gpu_utilization": 0.20,
    "memory_controller_util": 0.15,
    "memory_used_pct": 0.15,
    "temperature_c": 0.15,
    "power_draw_pct": 0.15,
    "throttle_active": 0.10,
    "pcie": 0.10,
}
TEMPERATURE_CAP_C = 90.0
PCIE_CAP_MBPS = 15000.0
# Weights and cap of the queue-aware variant.
QUEUE_WEIGHTS = {"gpu_util": 0.25, "sm_occupancy": 0.20, "memory_pct": 0.20, "queue_delay": 0.25, "power_pct": 0.10}
QUEUE_CAP_MS = 500.0
# Cuts between the health badges and between the severity classes.
DEGRADED_ABOVE = 0.7
WARNING_ABOVE = 0.4


def _capped(value: Column, cap: float) -> Column:
    return F.least(value / F.lit(cap), F.lit(1.0))


def contention_index(
    gpu_utilization: Column,
    memory_controller_util: Column,
    memory_used_pct: Column,
    temperature_c: Column,
    power_draw_pct: Column,
    throttle_active: Column,
    pcie_tx_mbps: Column,
    pcie_rx_mbps: Column,
) -> Column:
    """Weighted GPU saturation, 0 idle to 1 saturated."""
    w = CONTENTION_WEIGHTS
    terms = [
        F.lit(w["gpu_utilization"]) * (gpu_utilization / 100.0),
        F.lit(w["memory_controller_util"]) * (memory_controller_util / 100.0),
        F.lit(w["memory_used_pct"]) * (memory_used_pct / 100.0),
        F.lit(w["temperature_c"]) * _capped(temperature_c, TEMPERATURE_CAP_C),
        F.lit(w["power_draw_pct"]) * (power_draw_pct / 100.0),
        F.lit(w["throttle_active"]) * throttle_active.cast("double"),
        F.lit(w["pcie"]) * _capped(pcie_tx_mbps + pcie_rx_mbps, PCIE_CAP_MBPS),
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.round(total, 4)


def queue_contention_index(
    gpu_util: Column, sm_occupancy: Column, memory_pct: Column, queue_delay_ms: Column, power_pct: Column
) -> Column:
    """Contention that also sees the queue, kept within 0..1."""
    w = QUEUE_WEIGHTS
    total = (
        F.lit(w["gpu_util"]) * (gpu_util / 100.0)
        + F.lit(w["sm_occupancy"]) * (sm_occupancy / 100.0)
        + F.lit(w["memory_pct"]) * (memory_pct / 100.0)
        + F.lit(w["queue_delay"]) * _capped(queue_delay_ms, QUEUE_CAP_MS)
        + F.lit(w["power_pct"]) * (power_pct / 100.0)
    )
    return F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0))


def percent_of(part: Column, whole: Column) -> Column:
    """Share in percent with two digits; 0 when the whole is not positive."""
    return F.when(whole > 0, F.round(part / F.nullif(whole, F.lit(0)) * 100.0, 2)).otherwise(F.lit(0.0))


def health_badge(contention: Column) -> Column:
    return (
        F.when(contention > DEGRADED_ABOVE, F.lit("DEGRADED"))
        .when(contention > WARNING_ABOVE, F.lit("WARNING"))
        .otherwise(F.lit("HEALTHY"))
    )


def severity(contention: Column) -> Column:
    return (
        F.when(contention > DEGRADED_ABOVE, F.lit("critical"))
        .when(contention > WARNING_ABOVE, F.lit("warn"))
        .otherwise(F.lit("normal"))
    )


def serving_node(node_id: Column, options: RoutingOptions = ROUTING) -> Column:
    return F.coalesce(F.nullif(node_id, F.lit("")), F.lit(options.default_node))


def pod_id(node: Column, options: RoutingOptions = ROUTING) -> Column:
    return F.concat(F.lit(options.pod_prefix), node)
