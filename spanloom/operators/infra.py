"""GPU and network metrics: derivation from raw counters, rates, freshness, routing, incident labels, topology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import infra as i
from spanloom.functions.timeparts import HOUR_MS, floor_div, ingestion_date, ingestion_hour, now_ms
from spanloom.operators.ordered import running_max_before, running_total, with_previous
from spanloom.operators.steps import reasoning_calls
from spanloom.options import FRESHNESS, ROUTING, FreshnessOptions, RoutingOptions

# Properties given to a node that is only known from its metrics.
DERIVED_NODE_PROPERTIES = '{"source":"gpu_collector","nic":"real","switch_port":"vast.ai"}'


def with_ingestion_parts(metrics: DataFrame) -> DataFrame:
    """Partition columns from the sample's own time, in UTC."""
    ts = F.col("timestamp_ms")
    return metrics.withColumn("ingestion_date", ingestion_date(ts)).withColumn("ingestion_hour", ingestion_hour(ts))


def gpu_metrics_from_counters(raw: DataFrame) -> DataFrame:
    """Raw device counters -> GPU samples with percentages, throttle flag, MB/s and contention."""
    derived = raw.select(
        "timestamp_ms",
        "node_id",
        "gpu_id",
        "gpu_uuid",
        F.col("gpu_utilization").cast("double").alias("gpu_utilization"),
        F.col("memory_controller_util").cast("double").alias("memory_controller_util"),
        i.percent_of(F.col("memory_used"), F.col("memory_total")).alias("memory_used_pct"),
        F.col("temperature_c").cast("double").alias("temperature_c"),
        i.percent_of(F.col("power_draw"), F.col("power_limit")).alias("power_draw_pct"),
        F.col("clock_sm_mhz").cast("double").alias("clock_sm_mhz"),
        F.col("clock_mem_mhz").cast("double").alias("clock_mem_mhz"),
        F.when(F.coalesce(F.col("throttle_reasons"), F.lit(0)) != 0, 1).otherwise(0).alias("throttle_active"),
        F.round(F.coalesce(F.col("pcie_tx_kbps"), F.lit(0)) / 1000.0, 2).alias("pcie_tx_mbps"),
        F.round(F.coalesce(F.col("pcie_rx_kbps"), F.lit(0)) / 1000.0, 2).alias("pcie_rx_mbps"),
        F.coalesce(F.col("ecc_errors"), F.lit(0)).cast("int").alias("ecc_errors_total"),
    )
    return derived.withColumn("contention_index", contention_of(derived))


def contention_of(metrics: DataFrame) -> Column:
    return i.contention_index(
        *[
            metrics[name]
            for name in (
                "gpu_utilization",
                "memory_controller_util",
                "memory_used_pct",
                "temperature_c",
                "power_draw_pct",
                "throttle_active",
                "pcie_tx_mbps",
                "pcie_rx_mbps",
            )
        ]
    )


COUNTERS = ("tx_bytes", "rx_bytes", "drops", "retransmits")


def network_rates(counters: DataFrame, slice_ms: int = HOUR_MS) -> DataFrame:
    """Cumulative counters -> Mbps and non-negative deltas per node; a node's first sample gives no row.

    Samples of one node at the same instant count once (no time passes between them).
    """
    first = F.min(F.struct(*COUNTERS)).alias("_c")
    instants = counters.groupBy("node_id", "ts_ms").agg(first).select("node_id", "ts_ms", "_c.*")
    paired = with_previous(
        instants, ["node_id"], "ts_ms", list(COUNTERS), floor_div(F.col("ts_ms"), slice_ms), "prev"
    ).where(F.col("prev").isNotNull())
    seconds = (F.col("ts_ms") - F.col("prev.ts_ms")) / F.lit(1000.0)

    def mbps(counter: str) -> Column:
        return F.round((F.col(counter) - F.col(f"prev.{counter}")) * 8 / seconds / F.lit(1_000_000.0), 4)

    def delta(counter: str) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), F.col(counter) - F.col(f"prev.{counter}"))

    return paired.select(
        F.col("ts_ms").alias("timestamp_ms"),
        "node_id",
        mbps("tx_bytes").alias("throughput_tx_mbps"),
        mbps("rx_bytes").alias("throughput_rx_mbps"),
        delta("drops").alias("packet_drop_count"),
        delta("retransmits").alias("tcp_retransmit_count"),
    )


def source_freshness(metrics: DataFrame, now: int | Column, options: FreshnessOptions = FRESHNESS) -> DataFrame:
    """Per node: seconds since its last sample, and whether it still counts as a real source."""
    now = F.lit(now).cast("bigint") if isinstance(now, int) else now
    age = (now - F.col("last_ms")) / F.lit(1000.0)
    return (
        metrics.groupBy("node_id")
        .agg(F.max("timestamp_ms").alias("last_ms"))
        .select(
            "node_id",
            F.round(age, 1).alias("last_real_ago_s"),
            F.when(age < options.timeout_s, F.lit("real")).otherwise(F.lit("synthetic")).alias("source"),
        )
    )


def latest_gpu(gpu_metrics: DataFrame) -> DataFrame:
    """Latest sample's GPU per node, one aggregation for all nodes; ties go to the smallest GPU id."""
    newest = F.struct((-F.col("timestamp_ms")).alias("age"), "gpu_id", "gpu_uuid")
    return gpu_metrics.groupBy("node_id").agg(F.min(newest).alias("g")).select("node_id", "g.gpu_id", "g.gpu_uuid")


def route_calls(
    steps: DataFrame, gpu_metrics: DataFrame, ingested_ms: Column | None = None, options: RoutingOptions = ROUTING
) -> DataFrame:
    """Every reasoning step with the pod, node and GPU that served it."""
    ingested_ms = now_ms() if ingested_ms is None else ingested_ms
    calls = reasoning_calls(steps).select(
        "trace_id",
        "span_id",
        i.serving_node(F.col("node_id"), options).alias("node_id"),
        F.col("start_ts_ms").alias("timestamp_ms"),
    )
    gpus = latest_gpu(gpu_metrics)
    return calls.join(gpus, "node_id", "left").select(
        "trace_id",
        "span_id",
        i.pod_id(F.col("node_id"), options).alias("vllm_pod_id"),
        "node_id",
        F.coalesce(F.nullif(F.col("gpu_id"), F.lit("")), F.lit(options.default_gpu)).alias("gpu_id"),
        F.coalesce(F.col("gpu_uuid"), F.lit("")).alias("gpu_uuid"),
        F.lit(0.0).alias("queue_wait_ms"),
        "timestamp_ms",
        ingestion_date(ingested_ms).alias("ingestion_date"),
        ingestion_hour(ingested_ms).alias("ingestion_hour"),
    )


def incident_segments(incidents: DataFrame, keys: list[str], slice_ms: int = HOUR_MS) -> DataFrame:
    """Overlapping incidents -> disjoint segments, each won by the earliest-starting incident that covers it.

    An incident wins from where all earlier-starting ones have ended; one that ends before that never wins.
    """
    ended = running_max_before(
        incidents.where(F.col("start_ms") <= F.col("end_ms")),
        ["start_ms", "name", "intensity"],
        F.col("end_ms"),
        floor_div(F.col("start_ms"), slice_ms),
        "_ended",
        keys,
    )
    opens = F.greatest(F.col("start_ms"), F.coalesce(F.col("_ended") + 1, F.col("start_ms")))
    return ended.where(F.col("_ended").isNull() | (F.col("end_ms") > F.col("_ended"))).select(
        *keys, opens.alias("from_ms"), F.col("end_ms").alias("to_ms"), "name", "intensity"
    )


def label_incidents(
    samples: DataFrame, incidents: DataFrame, keys: list[str], ts: str = "timestamp_ms", tile_ms: int = 300_000
) -> DataFrame:
    """Adds name and intensity of the earliest-starting incident that covers a sample (intensity 0.0 when none).

    Incidents become disjoint segments first, so a sample matches at most one however many incidents overlap, and the
    segments are cut at tile borders to meet the samples by an equality of (keys, tile). Neither side is collected.
    An incident without an end goes on; segments are cut to the time the samples cover before they are tiled.
    """
    open_end = F.coalesce(F.col("end_ms"), F.lit(2**62))
    earliest, latest = samples.agg(F.min(ts)).scalar(), samples.agg(F.max(ts)).scalar()
    covered = incident_segments(incidents.withColumn("end_ms", open_end), keys)
    covered = covered.where((F.col("to_ms") >= earliest) & (F.col("from_ms") <= latest)).withColumns(
        {"from_ms": F.greatest("from_ms", earliest), "to_ms": F.least("to_ms", latest)}
    )
    tiles = F.sequence(floor_div(F.col("from_ms"), tile_ms), floor_div(F.col("to_ms"), tile_ms))
    segments = covered.select(
        *keys, "from_ms", "to_ms", F.col("name").alias("incident"), "intensity", F.explode(tiles).alias("_tile")
    )
    timed = samples.withColumn("_tile", floor_div(F.col(ts), tile_ms))
    match = F.col(ts).between(F.col("from_ms"), F.col("to_ms"))
    for key in [*keys, "_tile"]:
        match = match & (timed[key] == segments[key])
    return timed.join(segments, match, "left").select(
        *[timed[c] for c in samples.columns],
        F.col("from_ms").isNotNull().cast("int").alias("contended"),
        "incident",
        F.coalesce(F.col("intensity"), F.lit(0.0)).alias("intensity"),
    )


def downsample(
    metrics: DataFrame, every: int, order_by: list[str], per: list[str] | None = None, slice_ms: int | None = None
) -> DataFrame:
    """Every n-th row in time order, over all rows or within each series ``per``.

    Row numbers come from counts per time slice plus the position inside the slice, so no task sorts a whole series, or, where
    all series are numbered together, more than a second of them.
    """
    slice_ms = slice_ms or (60_000 if per else 1_000)
    if every <= 1:
        return metrics
    numbered = running_total(
        metrics, order_by, F.lit(1), floor_div(F.col(order_by[0]), slice_ms), "_n", per
    )
    return numbered.where((F.col("_n") - 1) % every == 0).drop("_n")


def mean_contention(gpu_metrics: DataFrame) -> DataFrame:
    """Mean contention and its severity per series node:gpu."""
    entity = F.concat(F.col("node_id"), F.lit(":"), F.col("gpu_id")).alias("entity_id")
    return (
        gpu_metrics.groupBy(entity)
        .agg(F.avg("contention_index").alias("avg_contention"))
        .withColumn("severity", i.severity(F.col("avg_contention")))
    )


def topology_from_metrics(gpu_metrics: DataFrame) -> DataFrame:
    """Nodes and GPUs as entities, for deployments without a topology table."""
    seen = gpu_metrics.groupBy(
        F.coalesce(F.nullif(F.col("node_id"), F.lit("")), F.lit(ROUTING.default_node)).alias("node_id"),
        F.coalesce(F.nullif(F.col("gpu_id"), F.lit("")), F.lit(ROUTING.default_gpu)).alias("gpu_id"),
    ).agg(F.min_by(F.coalesce("gpu_uuid", F.lit("")), F.struct("timestamp_ms", "gpu_uuid")).alias("gpu_uuid"))
    nodes = seen.select("node_id").distinct().select(
        F.lit("node").alias("entity_type"),
        F.col("node_id").alias("entity_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit(DERIVED_NODE_PROPERTIES).alias("properties"),
    )
    gpus = seen.select(
        F.lit("gpu").alias("entity_type"),
        F.concat("node_id", F.lit(":"), "gpu_id").alias("entity_id"),
        F.col("node_id").alias("parent_id"),
        F.to_json(F.struct("gpu_uuid")).alias("properties"),
    )
    return nodes.unionByName(gpus)


def topology_summary(topology: DataFrame) -> DataFrame:
    return topology.groupBy("entity_type").agg(F.count("*").alias("entities"))


def topology_tree(topology: DataFrame, gpu_metrics: DataFrame, routing: DataFrame) -> DataFrame:
    """GPUs and pods under their nodes, with mean contention and number of routed requests."""
    entities = topology.select("entity_type", "entity_id", "parent_id")
    nodes = entities.where(F.col("entity_type") == "node").select(F.col("entity_id").alias("node_id"))
    parts = entities.where(F.col("entity_type").isin("gpu", "pod")).withColumnRenamed("parent_id", "node_id")
    requests = routing.groupBy(F.col("vllm_pod_id").alias("entity_id")).agg(F.count("*").alias("requests"))
    return (
        nodes.join(parts, "node_id", "left")
        .join(mean_contention(gpu_metrics), "entity_id", "left")
        .join(requests, "entity_id", "left")
        .select(
            "node_id",
            "entity_type",
            "entity_id",
            F.round(F.when(F.col("entity_type") == "gpu", F.coalesce("avg_contention", F.lit(0.0))), 2).alias(
                "avg_contention"
            ),
            F.when(F.col("entity_type") == "gpu", F.coalesce("severity", F.lit("normal"))).alias("severity"),
            F.when(F.col("entity_type") == "pod", F.coalesce("requests", F.lit(0))).alias("requests"),
        )
    )
