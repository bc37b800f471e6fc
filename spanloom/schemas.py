"""Declared schemas of every table, as DDL text (fixed values: column names and types)."""

from __future__ import annotations

OTLP_ATTRIBUTE = "STRUCT<key: STRING, value: MAP<STRING, STRING>>"

OTLP_SPAN = f"""STRUCT<
  traceId: STRING, spanId: STRING, parentSpanId: STRING, name: STRING,
  startTimeUnixNano: STRING, endTimeUnixNano: STRING,
  attributes: ARRAY<{OTLP_ATTRIBUTE}>,
  events: ARRAY<STRUCT<name: STRING, attributes: ARRAY<{OTLP_ATTRIBUTE}>>>,
  links: ARRAY<STRUCT<traceId: STRING, spanId: STRING, attributes: ARRAY<{OTLP_ATTRIBUTE}>>>,
  status: STRUCT<code: INT, message: STRING>>"""

OTLP_MESSAGE = f"""resourceSpans ARRAY<STRUCT<
  resource: STRUCT<attributes: ARRAY<{OTLP_ATTRIBUTE}>>,
  scopeSpans: ARRAY<STRUCT<spans: ARRAY<{OTLP_SPAN}>>>>>"""

SPANS = """trace_id STRING, session_id STRING, span_id STRING, parent_span_id STRING,
operation_name STRING, service_name STRING, start_time_unix_nano BIGINT, end_time_unix_nano BIGINT,
duration_ns BIGINT, status_code STRING, status_message STRING, warning STRING, tags STRING,
`references` STRING, ingested_at TIMESTAMP"""

AGENT_STEPS = """trace_id STRING, session_id STRING, span_id STRING, parent_span_id STRING,
span_kind STRING, sub_span_kind STRING, start_ts_ms BIGINT, duration_ms DOUBLE, end_ts_ms BIGINT,
method STRING, agent_name STRING, model STRING, input_tokens INT, output_tokens INT,
collection STRING, query_text STRING, returned_rows INT, rpc_method STRING, url STRING,
status_code STRING, context STRING, prompt STRING, response STRING, node_id STRING,
ingestion_date STRING, ingestion_hour INT"""

TRAJECTORIES = """trace_id STRING, session_id STRING, trajectory_signature STRING, step_sequence STRING,
step_sequence_detailed STRING, step_count INT, llm_call_count INT, tool_call_count INT,
retrieve_count INT, agent_count INT, retry_count INT, error_count INT, total_duration_ms DOUBLE,
start_ts_ms BIGINT, end_ts_ms BIGINT, ingestion_date STRING, ingestion_hour INT"""

QUALITY = """trace_id STRING, session_id STRING, completeness DOUBLE, coherence DOUBLE,
hallucination DOUBLE, groundedness DOUBLE, relevance DOUBLE, overall DOUBLE, explanation STRING,
eval_model STRING, eval_timestamp_ms BIGINT, start_ts_ms BIGINT, end_ts_ms BIGINT,
ingestion_date STRING, ingestion_hour INT"""

GPU_SAMPLE = """timestamp_ms BIGINT, node_id STRING, gpu_id STRING, gpu_uuid STRING,
gpu_utilization DOUBLE, memory_controller_util DOUBLE, memory_used_pct DOUBLE, temperature_c DOUBLE,
power_draw_pct DOUBLE, clock_sm_mhz DOUBLE, clock_mem_mhz DOUBLE, throttle_active INT,
pcie_tx_mbps DOUBLE, pcie_rx_mbps DOUBLE, ecc_errors_total INT, contention_index DOUBLE"""
GPU_METRICS = GPU_SAMPLE + ", ingestion_date STRING, ingestion_hour INT"

NETWORK_SAMPLE = """timestamp_ms BIGINT, node_id STRING, peer_node_id STRING, inter_node_latency_us DOUBLE,
throughput_tx_mbps DOUBLE, throughput_rx_mbps DOUBLE, packet_drop_count INT, tcp_retransmit_count INT"""
NETWORK_METRICS = NETWORK_SAMPLE + ", ingestion_date STRING, ingestion_hour INT"

ROUTING = """trace_id STRING, span_id STRING, vllm_pod_id STRING, node_id STRING, gpu_id STRING,
gpu_uuid STRING, queue_wait_ms DOUBLE, timestamp_ms BIGINT, ingestion_date STRING, ingestion_hour INT"""

CORRELATED = """trace_id STRING, session_id STRING, start_ts_ms BIGINT, end_ts_ms BIGINT,
total_duration_ms DOUBLE, trajectory_signature STRING, step_sequence STRING, step_count INT,
llm_call_count INT, tool_call_count INT, retrieve_count INT, retry_count INT,
quality_overall DOUBLE, quality_completeness DOUBLE, quality_coherence DOUBLE,
quality_hallucination DOUBLE, quality_groundedness DOUBLE, quality_relevance DOUBLE,
quality_explanation STRING, gpu_contention_avg DOUBLE, gpu_contention_max DOUBLE,
gpu_temperature_avg DOUBLE, gpu_temperature_max DOUBLE, gpu_memory_pressure_avg DOUBLE,
gpu_throttle_count BIGINT, gpu_power_avg DOUBLE, inter_node_latency_avg DOUBLE,
inter_node_latency_max DOUBLE, packet_drop_total BIGINT, tcp_retransmit_total BIGINT,
queue_wait_avg DOUBLE, queue_wait_max DOUBLE, primary_pod_id STRING, primary_node_id STRING,
primary_gpu_id STRING, ingestion_date STRING, ingestion_hour INT"""

ANALYTICS_WINDOWS = """window_size STRING, window_start_ms BIGINT, window_end_ms BIGINT, trace_count INT,
dominant_signature STRING, dominant_share DOUBLE, unique_signatures INT, trajectory_entropy DOUBLE,
trajectory_drift_jsd DOUBLE, is_baseline INT, quality_overall_avg DOUBLE,
quality_hallucination_avg DOUBLE, quality_overall_baseline DOUBLE, quality_delta DOUBLE,
gpu_contention_avg DOUBLE, gpu_contention_max DOUBLE, net_latency_avg DOUBLE,
packet_drop_total BIGINT, quality_drop INT, trajectory_drift INT, gpu_pressure INT,
network_pressure INT, contention_quality_corr DOUBLE, correlation_flag STRING,
correlation_details STRING"""

# What one version of a trace adds to (sign 1) or takes back from (sign -1) a slice of time and a signature.
WINDOW_CHANGES = """slice_ms BIGINT, signature STRING, q DOUBLE, h DOUBLE, c DOUBLE, l DOUBLE, d BIGINT, sign INT,
ingestion_date STRING, ingestion_hour INT"""

SIGNATURE_SLICES = """slice_ms BIGINT, signature STRING, n BIGINT, q_n BIGINT, q_sum DOUBLE, h_n BIGINT, h_sum DOUBLE,
c_n BIGINT, c_sum DOUBLE, l_n BIGINT, l_sum DOUBLE, drops BIGINT, x_sum DOUBLE, y_sum DOUBLE, xx DOUBLE, yy DOUBLE, xy DOUBLE,
x_min DOUBLE, y_min DOUBLE, x_max DOUBLE, y_max DOUBLE, c_max DOUBLE, ingestion_date STRING, ingestion_hour INT"""

# Tiles of time and nodes around the model calls of a correlated trace, and calls whose node had no sample yet.
TRACE_TILES = "node_id STRING, tile BIGINT, trace_id STRING, ingestion_date STRING, ingestion_hour INT"
UNPLACED_CALLS = "node_id STRING, trace_id STRING"

TOPOLOGY = "entity_type STRING, entity_id STRING, parent_id STRING, properties STRING"

MESSAGES = "session_id STRING, turn_number INT, role STRING, content STRING, `timestamp` STRING, metadata STRING"

# Table name -> (schema, key columns of its upsert)
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "trace_delta_table": (SPANS, ("trace_id", "span_id")),
    "agent_steps": (AGENT_STEPS, ("trace_id", "session_id", "span_id")),
    "trajectory_templates": (TRAJECTORIES, ("trace_id", "session_id")),
    "quality_scores": (QUALITY, ("trace_id", "session_id")),
    "gpu_metrics": (GPU_METRICS, ("timestamp_ms", "node_id", "gpu_id")),
    "network_metrics": (NETWORK_METRICS, ("timestamp_ms", "node_id")),
    "request_routing": (ROUTING, ("trace_id", "span_id")),
    "trace_correlated": (CORRELATED, ("trace_id", "session_id")),
    "trace_tiles": (TRACE_TILES, ("node_id", "tile", "trace_id")),
    "unplaced_calls": (UNPLACED_CALLS, ("node_id", "trace_id")),
    "window_changes": (WINDOW_CHANGES, ()),
    "signature_slices": (SIGNATURE_SLICES, ("slice_ms", "signature")),
    "analytics_windows": (ANALYTICS_WINDOWS, ("window_size", "window_start_ms")),
}
