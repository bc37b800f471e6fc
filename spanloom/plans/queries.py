"""Registered queries: every operator applied to the given test tables through the bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.functions import infra as infra_f
from spanloom.functions import judge as judge_f
from spanloom.functions import otlp as otlp_f
from spanloom.functions import spans as spans_f
from spanloom.functions.drift import verdict
from spanloom.operators import (
    correlate,
    infra,
    mutations,
    ops_metrics,
    otlp,
    retrieval,
    scoring,
    sessions,
    steps,
    trajectory,
    windows,
)
from spanloom.plans import bindings as b
from spanloom.plans import reports
from spanloom.plans.batch import INGESTED_MS, SPARSE, Inputs, scratch
from spanloom.sources import changelog, tables
from spanloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- messages, spans, steps ---


@query
def otlp_flatten(spark, sf_dir):
    return otlp.flatten(Inputs(spark, sf_dir).landed_messages).drop("ingested_at")


@query
def undecodable_messages(spark, sf_dir):
    return otlp.undecodable(Inputs(spark, sf_dir).landed_messages).select(
        "event_id", F.length("value").alias("chars")
    )


@query
def attribute_precedence(spark, sf_dir):
    """Attribute values of every type, empty ones, nested ones and repeated keys."""
    base = b.base_events(Inputs(spark, sf_dir).events)
    text = """'[{"key":"text","value":{"stringValue":"s' || k || '","intValue":"1"}},{"key":"int","value":{"intValue":"'
    || k || '"}},{"key":"double","value":{"doubleValue":' || k || '.5}},{"key":"bool","value":{"boolValue":'
    || case when k % 2 = 0 then 'true' else 'false' end || '}},{"key":"list","value":{"stringValue":"","arrayValue":{"values":['
    || k || ']}}},{"key":"map","value":{"kvlistValue":{"values":[' || k
    || ']}}},{"key":"twice","value":{"stringValue":"first"}},{"key":"twice","value":{"stringValue":"last' || k || '"}}]'"""
    attributes = F.from_json(F.expr(text), f"ARRAY<{schemas.OTLP_ATTRIBUTE}>")
    mapped = base.select("event_id", otlp_f.attribute_map(attributes).alias("m"))
    names = {"text": "text", "int": "int_text", "double": "double_text", "bool": "bool_text", "list": "list_text",
             "map": "map_text", "twice": "twice"}
    return mapped.select("event_id", *[F.col("m")[key].alias(name) for key, name in names.items()])


@query
def span_identifiers(spark, sf_dir):
    """Hex, base64, unreadable and missing ids."""
    base = b.base_events(Inputs(spark, sf_dir).events).selectExpr("event_id", f"{b.span_id_of('event_id')} as span_id", "k")
    raw = F.expr("""case k % 5 when 0 then span_id when 1 then base64(unhex(span_id)) when 2 then upper(span_id)
    when 3 then 'not an id!' end""")
    return base.select("event_id", otlp_f.normalise_id(raw).alias("id"))


@query
def span_links(spark, sf_dir):
    base = b.base_events(Inputs(spark, sf_dir).events).selectExpr("event_id", f"{b.TRACE_ID} as trace_id",
                                                        f"{b.span_id_of('event_id')} as span_id", "k")
    text = """'[{"traceId":"' || trace_id || '","spanId":"' || span_id || '","attributes":[{"key":"kind","value":{"intValue":"'
    || k || '"}}]},{"traceId":"","spanId":"' || base64(unhex(span_id)) || '"}]'"""
    links = F.from_json(F.expr(text), f"ARRAY<STRUCT<traceId: STRING, spanId: STRING, attributes: ARRAY<{schemas.OTLP_ATTRIBUTE}>>>")
    return base.select("event_id", F.to_json(otlp_f.link_map(links)).alias("links"))


@query
def span_classification(spark, sf_dir):
    """Every span with its step kind; dropped and unclassified spans say so."""
    spans = Inputs(spark, sf_dir).spans.withColumn("step", spans_f.classify(spans_f.parse_tags(F.col("tags"))))
    outcome = F.when(spans_f.is_dropped(F.col("operation_name")), F.lit("dropped")).when(
        F.col("step").isNull(), F.lit("unclassified")
    ).otherwise(F.col("step.kind"))
    return spans.select("span_id", outcome.alias("outcome"), F.coalesce("step.sub", F.lit("")).alias("sub"))


@query
def classified_steps(spark, sf_dir):
    return steps.classified(Inputs(spark, sf_dir).spans, F.lit(INGESTED_MS))


@query
def steps_of_broken_tags(spark, sf_dir):
    """Spans of every kind, some with tags that are cut off, no object or no value: those have no tags, so no kind."""
    tags = F.col("tags")
    broken = (
        F.when(F.col("span_id").endswith("0"), F.left(tags, F.length(tags) - 1))
        .when(F.col("span_id").endswith("1"), F.lit("[1, 2]"))
        .when(F.col("span_id").endswith("2"), F.lit("null"))
        .when(F.col("span_id").endswith("3"), F.concat(F.lit("x"), tags))
        .otherwise(tags)
    )
    spans = Inputs(spark, sf_dir).spans.withColumn("tags", broken)
    return steps.classified(spans, F.lit(INGESTED_MS)).select("span_id", "span_kind", "sub_span_kind")


@query
def agent_steps(spark, sf_dir):
    return Inputs(spark, sf_dir).steps.select(
        "trace_id", "session_id", "span_id", "parent_span_id", "span_kind", "sub_span_kind", "start_ts_ms", "duration_ms",
        "end_ts_ms", "ingestion_date", "ingestion_hour",
    )


@query
def impacted_lookback(spark, sf_dir):
    """All spans of the traces a batch touches, back to the lookback bound."""
    spans = Inputs(spark, sf_dir).spans
    batch = spans.where((F.col("status_code") == "ERROR") & (F.col("start_time_unix_nano") > 0))
    touched = steps.of_traces(spans, steps.impacted_traces(batch))
    return steps.within_lookback(touched, batch).select("trace_id", "span_id", "start_time_unix_nano")


@query
def trace_search(spark, sf_dir):
    spans = Inputs(spark, sf_dir).spans
    now = spans.agg(F.max("start_time_unix_nano")).scalar()
    return steps.trace_search(spans, "svc1", now, lookback_ms=48 * 3_600_000)


@query
def call_graph(spark, sf_dir):
    return steps.call_graph(Inputs(spark, sf_dir).spans)


@query
def call_graph_totals(spark, sf_dir):
    return steps.call_graph_totals(steps.call_graph(Inputs(spark, sf_dir).spans))


# --- trajectories ---


@query
def trajectories(spark, sf_dir):
    return Inputs(spark, sf_dir).trajectories


@query
def template_distribution(spark, sf_dir):
    return trajectory.distribution_of(Inputs(spark, sf_dir).templates)


@query
def span_errors(spark, sf_dir):
    return trajectory.span_errors(Inputs(spark, sf_dir).spans)


@query
def microstructure(spark, sf_dir):
    return reports.microstructure(Inputs(spark, sf_dir).trajectories)


@query
def trajectory_detail(spark, sf_dir):
    """Steps of every trace beside its signature; the report of one trace filters the same join."""
    i = Inputs(spark, sf_dir)
    paths = i.trajectories.select("trace_id", "trajectory_signature", "step_count")
    return i.steps.join(paths, "trace_id").select(
        "trace_id", "span_id", "span_kind", "start_ts_ms", "trajectory_signature", "step_count"
    )


# --- judging ---


@query
def judge_prompts(spark, sf_dir):
    contexts = scoring.judge_contexts(Inputs(spark, sf_dir).steps)
    return scoring.with_prompts(contexts)


@query
def judge_prompts_with_request(spark, sf_dir):
    """Contexts that include the user's message carried by the entry span."""
    spans = Inputs(spark, sf_dir).spans
    return scoring.judge_contexts(steps.agent_steps(spans, F.lit(INGESTED_MS), with_user_message=True)).select(
        "trace_id", "user_request", "final_response"
    )


@query
def judge_replies(spark, sf_dir):
    parsed = b.replies(Inputs(spark, sf_dir).events).withColumn("s", judge_f.parse_scores(F.col("reply")))
    return parsed.select("event_id", "s.*")


@query
def judged_traces(spark, sf_dir):
    """Contexts answered by the rule judge and scored."""
    scored = scoring.evaluate(Inputs(spark, sf_dir).steps, scoring.rule_judge, "rules", F.lit(INGESTED_MS))
    return scored.drop("eval_timestamp_ms", "ingestion_date", "ingestion_hour")


@query
def intent_replies(spark, sf_dir):
    parsed = b.replies(Inputs(spark, sf_dir).events).withColumn("m", judge_f.parse_intent(F.col("intent_reply")))
    fields = ("intent", "destination", "budget", "origin")
    return parsed.select("event_id", *[F.coalesce(F.col("m")[f], F.lit("")).alias(f) for f in fields])


@query
def request_parameters(spark, sf_dir):
    """Missing required parameters, and parameters with their defaults."""
    base = b.base_events(Inputs(spark, sf_dir).events)
    text = """'{"destination":"' || case when k % 3 = 0 then '' else 'd' || k end || '","budget":"'
    || case when k % 2 = 0 then '' else 'b' || k end || '","note":""}'"""
    params = base.select("event_id", F.from_json(F.expr(text), "map<string,string>").alias("p"))
    full = params.withColumn("f", judge_f.with_defaults(F.col("p")))
    names = ("destination", "budget", "origin", "passengers", "note")
    return full.select(
        "event_id",
        F.array_join(judge_f.missing_parameters(F.col("p")), ",").alias("missing"),
        *[F.coalesce(F.col("f")[n], F.lit("absent")).alias(n) for n in names],
    )


@query
def token_estimates(spark, sf_dir):
    text = F.col("text")
    reported = F.when(F.col("turn") % 3 == 0, F.col("turn").cast("int"))
    return Inputs(spark, sf_dir).table("conversations").select(
        "conv_id",
        "turn",
        spans_f.estimated_output_tokens(reported, text).alias("output_tokens"),
        spans_f.estimated_input_tokens(reported, text).alias("input_tokens"),
        F.length(spans_f.stored_text(text, 200)).alias("stored_chars"),
    )


# --- metrics and routing ---


def _raw_counters(events: DataFrame) -> DataFrame:
    return b.base_events(events).selectExpr(
        "event_id", f"{b.GPU_FIELDS['timestamp_ms']} as timestamp_ms", f"{b.GPU_FIELDS['node_id']} as node_id",
        f"{b.GPU_FIELDS['gpu_id']} as gpu_id", f"{b.GPU_FIELDS['gpu_uuid']} as gpu_uuid", "k as gpu_utilization",
        "100 - k as memory_controller_util", "cast(floor(value * 1000) as bigint) as memory_used",
        "case when k % 20 = 0 then cast(0 as bigint) else cast(700000 as bigint) end as memory_total",
        "30 + k as temperature_c", "cast(k * 2500 as bigint) as power_draw",
        "case when k % 30 = 1 then cast(0 as bigint) else cast(350000 as bigint) end as power_limit",
        "1200 as clock_sm_mhz", "5000 as clock_mem_mhz", "case when k % 9 = 0 then 4 else 0 end as throttle_reasons",
        "k * 123456 as pcie_tx_kbps", "k * 65432 as pcie_rx_kbps", "k % 2 as ecc_errors",
    )


@query
def gpu_from_counters(spark, sf_dir):
    return infra.gpu_metrics_from_counters(_raw_counters(Inputs(spark, sf_dir).events))


@query
def queue_contention(spark, sf_dir):
    base = b.base_events(Inputs(spark, sf_dir).events)
    value = infra_f.queue_contention_index(
        F.col("k").cast("double"), (F.lit(100) - F.col("k")).cast("double"), (F.col("k") / 2), F.col("value"), F.col("k") * 2.0
    )
    return base.select("event_id", value.alias("contention"), infra_f.severity(value).alias("severity"),
                       infra_f.health_badge(value).alias("badge"))


@query
def metric_ingest(spark, sf_dir):
    """JSON metric lines with missing fields, wrong types and broken text: accepted or the reason why not."""
    base = b.base_events(Inputs(spark, sf_dir).events)
    text = """case when k = 1 then '{broken' else '{"timestamp_ms":' || cast(floor(us / 1000) as bigint)
    || ',"node_id":"node-' || (user_id % 4) || '"' || case when k % 10 = 2 then ',"peer_node_id":"p"' else '' end
    || case when k % 10 = 3 then '' else ',"inter_node_latency_us":' || case when k % 10 = 4 then '"fast"' else k || '.5' end end
    || ',"throughput_tx_mbps":1.5,"throughput_rx_mbps":2,"packet_drop_count":' || case when k % 10 = 5 then '1.5' else '1' end
    || ',"tcp_retransmit_count":0}' end"""
    checked = tables.checked_metrics(base.select(F.expr(text).alias("value")), tables.NETWORK_FORMAT)
    good = tables.accepted(checked, tables.NETWORK_FORMAT).select(
        F.lit("accepted").alias("outcome"), "node_id", "ingestion_date", "ingestion_hour", "peer_node_id",
        F.col("inter_node_latency_us").alias("latency"),
    )
    bad = tables.rejected(checked).select(
        F.col("reject_reason").alias("outcome"), *[F.lit("").alias(c) for c in ("node_id", "ingestion_date")],
        F.lit(0).alias("ingestion_hour"), F.lit("").alias("peer_node_id"), F.lit(0.0).alias("latency"),
    )
    every = good.unionByName(bad)
    return every.groupBy("outcome", "node_id", "ingestion_date", "ingestion_hour", "peer_node_id").agg(
        F.count("*").alias("lines"), F.max("latency").alias("max_latency")
    )


@query
def source_freshness(spark, sf_dir):
    gpu = Inputs(spark, sf_dir).gpu
    return infra.source_freshness(gpu, gpu.agg(F.max("timestamp_ms")).scalar())


@query
def latest_gpu(spark, sf_dir):
    return infra.latest_gpu(Inputs(spark, sf_dir).gpu)


@query
def request_routing(spark, sf_dir):
    return Inputs(spark, sf_dir).routing


@query
def routing_distribution(spark, sf_dir):
    return reports.routing_distribution(Inputs(spark, sf_dir).routing)


@query
def network_rates(spark, sf_dir):
    return infra.network_rates(b.counters(Inputs(spark, sf_dir).table("lineitem")))


@query
def incident_labels(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    samples = i.gpu.select("timestamp_ms", "node_id", "gpu_id")
    return infra.label_incidents(samples, b.incidents(i.table("orders")), ["node_id"])


@query
def gpu_report(spark, sf_dir):
    """Filtered and thinned over all series in time order."""
    series = reports.gpu_series(Inputs(spark, sf_dir).gpu, start_ms=1_704_200_000_000, end_ms=0, node_id="node-1", every=4)
    return series.select("timestamp_ms", "node_id", "gpu_id", "contention_index")


@query
def gpu_report_per_series(spark, sf_dir):
    series = reports.gpu_series(Inputs(spark, sf_dir).gpu, every=10, per=["node_id", "gpu_id"])
    return series.select("timestamp_ms", "node_id", "gpu_id", "contention_index")


@query
def gpu_summary(spark, sf_dir):
    return reports.gpu_summary(Inputs(spark, sf_dir).gpu)


@query
def network_report(spark, sf_dir):
    series = reports.network_series(Inputs(spark, sf_dir).network, end_ms=1_705_000_000_000, every=3)
    return series.select("timestamp_ms", "node_id", "inter_node_latency_us", "packet_drop_count")


@query
def contention_by_gpu(spark, sf_dir):
    return infra.mean_contention(Inputs(spark, sf_dir).gpu)


@query
def topology(spark, sf_dir):
    return infra.topology_from_metrics(Inputs(spark, sf_dir).gpu)


@query
def topology_summary(spark, sf_dir):
    return infra.topology_summary(infra.topology_from_metrics(Inputs(spark, sf_dir).gpu))


@query
def topology_tree(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    pods = i.routing.select("vllm_pod_id", "node_id").distinct().select(
        F.lit("pod").alias("entity_type"), F.col("vllm_pod_id").alias("entity_id"), F.col("node_id").alias("parent_id"),
        F.lit("{}").alias("properties"),
    )
    return infra.topology_tree(infra.topology_from_metrics(i.gpu).unionByName(pods), i.gpu, i.routing)


@query
def calibrated_threshold(spark, sf_dir):
    return ops_metrics.calibrated_threshold(Inputs(spark, sf_dir).gpu)


# --- correlation ---


@query
def metric_time_range(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    late = i.trajectories.where(F.col("llm_call_count") >= 2)
    return correlate.in_time_range(infra.with_ingestion_parts(i.gpu), late).select("timestamp_ms", "node_id", "gpu_id")


@query
def gpu_around_calls(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return correlate.gpu_around_calls(correlate.call_intervals(i.calls, SPARSE), i.gpu, SPARSE)


@query
def network_around_calls(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return correlate.network_around_calls(correlate.call_intervals(i.calls, SPARSE), i.network, SPARSE)


@query
def primary_pods(spark, sf_dir):
    """Primary pod per trace, with queue waits."""
    waited = Inputs(spark, sf_dir).calls.withColumn("queue_wait_ms", (F.col("timestamp_ms") % 5).cast("double"))
    return correlate.primary_pods(waited)


@query
def correlated_traces(spark, sf_dir):
    return Inputs(spark, sf_dir).correlated


@query
def live_correlation(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return correlate.correlate_live(i.steps, i.gpu, i.network, F.lit(INGESTED_MS), SPARSE, i.kept("live"))


@query
def uncorrelated_traces(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    done = i.quality.where(F.col("overall") > 0)
    return correlate.uncorrelated(i.steps, done).select("trace_id").distinct()


# --- windows, alerts, mutations ---


@query
def drift_windows(spark, sf_dir):
    return Inputs(spark, sf_dir).windows


@query
def signature_distribution(spark, sf_dir):
    """Count and probability of each signature per window of every size."""
    dist = Inputs(spark, sf_dir).signature_windows
    totals = dist.groupBy(*windows.WINDOW).agg(F.sum("n").alias("total"))
    return dist.join(totals, windows.WINDOW).select(
        *windows.WINDOW, "signature", "n", F.round(F.col("n") / F.col("total"), 6).alias("probability")
    )


@query
def verdict_table(spark, sf_dir):
    """The verdict for every combination of signals that occurs when each is drawn from the data."""
    base = b.base_events(Inputs(spark, sf_dir).events)
    bits = [(F.call_function("div", F.col("k"), F.lit(2**n)) % 2).cast("int") for n in range(4)]
    flags = base.select(*[bit.alias(name) for bit, name in zip(bits, ("quality_drop", "drift", "gpu", "net"))])
    return flags.groupBy(*flags.columns).agg(F.count("*").alias("n")).withColumn(
        "verdict", verdict(F.col("quality_drop"), F.col("drift"), F.col("gpu"), F.col("net"))
    )


@query
def alerts(spark, sf_dir):
    return reports.alerts(Inputs(spark, sf_dir).windows).select(
        "window_size", "window_start_ms", "correlation_flag", "correlation_details"
    )


@query
def alert_counts(spark, sf_dir):
    return reports.alert_counts(Inputs(spark, sf_dir).windows)


@query
def first_alerts(spark, sf_dir):
    return reports.first_alerts(Inputs(spark, sf_dir).windows).select("window_size", "window_start_ms", "correlation_flag")


@query
def path_mutations(spark, sf_dir):
    return mutations.mutations_of(Inputs(spark, sf_dir).paths)


@query
def mutation_summary(spark, sf_dir):
    return mutations.mutation_summary_of(Inputs(spark, sf_dir).paths)


@query
def worst_mutation(spark, sf_dir):
    return mutations.worst_mutation(mutations.mutations_of(Inputs(spark, sf_dir).paths)).select(
        "signature", "bad_rate", "count", "lift", "why"
    )


@query
def drift_story(spark, sf_dir):
    return reports.drift_story(Inputs(spark, sf_dir).windows)


@query
def cooccurrence_story(spark, sf_dir):
    return reports.cooccurrence_story(Inputs(spark, sf_dir).windows)


@query
def quality_summary(spark, sf_dir):
    return reports.quality_summary(Inputs(spark, sf_dir).quality)


@query
def quality_series(spark, sf_dir):
    return reports.quality_series(Inputs(spark, sf_dir).quality).select("trace_id", "overall", "explanation", "start_ts_ms")


@query
def dashboard_numbers(spark, sf_dir):
    return reports.dashboard_numbers(Inputs(spark, sf_dir).correlated)


@query
def highest_contention(spark, sf_dir):
    return reports.highest_contention(Inputs(spark, sf_dir).correlated)


@query
def fleet_summary(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return reports.fleet_summary(i.correlated, i.windows, i.templates, listed=reports.template_text(i.templates))


@query
def fleet_numbers(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return reports.fleet_summary(i.correlated, i.windows, i.templates)


def _first_trace(i: Inputs):
    """The smallest trace id, for the reports about one trace."""
    return i.trajectories.agg(F.min("trace_id")).scalar()


@query
def trajectory_report(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return reports.trajectory_detail(i.steps, i.trajectories, _first_trace(i)).select(
        "trace_id", "span_id", "span_kind", "start_ts_ms", "trajectory_signature", "step_count"
    )


@query
def quality_report(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return reports.quality_detail(i.quality, _first_trace(i)).select("trace_id", "overall", "start_ts_ms")


@query
def correlated_report(spark, sf_dir):
    return reports.correlated_traces(Inputs(spark, sf_dir).correlated).drop("ingestion_date", "ingestion_hour")


@query
def window_report(spark, sf_dir):
    """The windows of one size."""
    return reports.windows(Inputs(spark, sf_dir).windows, "1h")


@query
def gpu_report_one_device(spark, sf_dir):
    series = reports.gpu_series(Inputs(spark, sf_dir).gpu, gpu_id="gpu-0", every=2)
    return series.select("timestamp_ms", "node_id", "gpu_id", "contention_index")


# --- operational metrics ---


@query
def model_calls(spark, sf_dir):
    return ops_metrics.model_calls(Inputs(spark, sf_dir).measured)


@query
def retrieval_calls(spark, sf_dir):
    return ops_metrics.retrievals(Inputs(spark, sf_dir).measured)


@query
def tool_calls(spark, sf_dir):
    return ops_metrics.tool_calls(Inputs(spark, sf_dir).measured)


@query
def workflows(spark, sf_dir):
    return ops_metrics.workflows(Inputs(spark, sf_dir).measured)


@query
def retry_attempts(spark, sf_dir):
    return ops_metrics.retries(Inputs(spark, sf_dir).measured)


@query
def agent_handoffs(spark, sf_dir):
    return ops_metrics.handoffs(Inputs(spark, sf_dir).measured)


@query
def active_agents(spark, sf_dir):
    return ops_metrics.active_agents(Inputs(spark, sf_dir).measured)


@query
def duration_histogram(spark, sf_dir):
    return ops_metrics.duration_histogram(Inputs(spark, sf_dir).measured, None, ["kind"], hourly=False)


@query
def model_duration_histogram(spark, sf_dir):
    return ops_metrics.duration_histogram(Inputs(spark, sf_dir).measured, "REASON", ["model", "agent"])


@query
def retrieval_duration_histogram(spark, sf_dir):
    return ops_metrics.duration_histogram(Inputs(spark, sf_dir).measured, "RETRIEVE", ["collection"])


@query
def tool_duration_histogram(spark, sf_dir):
    return ops_metrics.duration_histogram(Inputs(spark, sf_dir).measured, "TOOL", ["tool", "success"])


@query
def workflow_duration_histogram(spark, sf_dir):
    return ops_metrics.duration_histogram(Inputs(spark, sf_dir).measured, "ENTRY", ["status_code"])


@query
def retrieved_documents_histogram(spark, sf_dir):
    return ops_metrics.documents_histogram(Inputs(spark, sf_dir).measured)


@query
def errors_by_type(spark, sf_dir):
    return ops_metrics.errors_by_type(Inputs(spark, sf_dir).measured)


@query
def latency_percentiles(spark, sf_dir):
    return ops_metrics.latency_report(Inputs(spark, sf_dir).spans, ["service_name"])


@query
def latency_from_sketch(spark, sf_dir):
    """Exact percentiles from a stored sketch and one scan that looks only at the buckets of the wanted ranks."""
    i = Inputs(spark, sf_dir)
    return ops_metrics.latency_report_from_sketch(i.spans, i.latency_sketch, ["service_name"])


@query
def approximate_latency(spark, sf_dir):
    """Percentiles of one mergeable sketch per service; each is within a share of 1/10,000 of its rank."""
    return ops_metrics.approximate_latency(Inputs(spark, sf_dir).spans, ["service_name"])


# --- sessions and retrieval ---


@query
def session_rollup(spark, sf_dir):
    messages = Inputs(spark, sf_dir).messages
    lifecycle = messages.where(F.col("role") == "assistant").select(
        "session_id", F.col("timestamp").alias("at"),
        F.when(F.col("turn_number") % 2 == 0, "active").otherwise("ended").alias("status"),
    )
    return sessions.session_rollup(messages, lifecycle)


@query
def recent_sessions(spark, sf_dir):
    return sessions.recent_sessions(sessions.session_rollup(Inputs(spark, sf_dir).messages)).select("session_id", "updated_at")


@query
def session_history(spark, sf_dir):
    return sessions.history(Inputs(spark, sf_dir).messages).select("session_id", "turn_number", "role", "content")


@query
def session_context(spark, sf_dir):
    """Last non-empty value of each parameter a session's messages mention."""
    extracted = Inputs(spark, sf_dir).messages.withColumn(
        "params",
        F.create_map(
            F.lit("role"), F.col("role"),
            F.concat(F.lit("word"), (F.col("turn_number") % 3).cast("string")),
            F.when(F.length("content") % 2 == 0, F.length("content").cast("string")).otherwise(F.lit("")),
        ),
    )
    return sessions.session_context(extracted).select("session_id", F.to_json("params").alias("params"))


@query
def nearest_vectors(spark, sf_dir):
    """The three nearest vectors of every stored vector (itself included)."""
    stored = Inputs(spark, sf_dir).table("embeddings")
    vectors = stored.select(F.col("vec_id").alias("id"), "embedding")
    hits = retrieval.nearest(vectors, vectors.withColumnRenamed("id", "query_id"))
    labels = stored.select(F.col("vec_id").alias("id"), "label")
    return retrieval.with_documents(hits, labels).select("query_id", "id", "label", F.round("distance", 5).alias("distance"))


@query
def nearest_vectors_by_pivots(spark, sf_dir):
    """The same rows, without comparing vectors whose cells are too far from each other."""
    stored = Inputs(spark, sf_dir).table("embeddings")
    vectors = stored.select(F.col("vec_id").alias("id"), "embedding")
    hits = retrieval.nearest_by_pivots(vectors, vectors.withColumnRenamed("id", "query_id"))
    labels = stored.select(F.col("vec_id").alias("id"), "label")
    return retrieval.with_documents(hits, labels).select("query_id", "id", "label", F.round("distance", 5).alias("distance"))


@query
def nearest_messages(spark, sf_dir):
    """Assistant answers nearest to each user message, by the hashing embedder."""
    embedded = Inputs(spark, sf_dir).embedded_messages
    answers = embedded.where(F.col("role") == "assistant").select("id", "embedding")
    asked = embedded.where(F.col("role") == "user").select(F.col("id").alias("query_id"), "embedding")
    hits = retrieval.nearest(answers, asked)
    return hits.select("query_id", "id", F.round("distance", 5).alias("distance"))


# --- upsert and streams ---


def _order_log(orders: DataFrame) -> DataFrame:
    """Orders as a change log of a hundred batches with one row per customer: the newest batch replaces earlier ones."""
    rows = orders.select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderkey") % 100).alias(changelog.BATCH))
    return changelog.largest_per_key(rows, ["o_custkey", changelog.BATCH])


@query
def upsert_current(spark, sf_dir):
    return changelog.current(_order_log(Inputs(spark, sf_dir).table("orders")), ["o_custkey"])


@query
def upsert_roundtrip(spark, sf_dir):
    """Order lines written as three batches of a log on disk, one of them twice, then read through the view."""
    lines = Inputs(spark, sf_dir).table("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    path = f"{scratch(spark)}/log"
    keys = ["l_partkey"]
    for batch_id in (0, 1, 1, 2):
        changelog.write_batch(lines.where(F.col("l_orderkey") % 3 == batch_id), path, batch_id, keys)
    schema = "l_partkey BIGINT, l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE"
    return changelog.current(changelog.read_log(spark, path, schema), keys)


@query
def table_setup(spark, sf_dir):
    """All tables created in a new folder, one filled with the spans, then all created again: existing ones stay as they are."""
    folder = scratch(spark)
    created = tables.create_all(spark, folder)
    name = "trace_delta_table"
    changelog.write_batch(Inputs(spark, sf_dir).spans, f"{folder}/{name}", 0, schemas.TABLES[name][1])
    again = tables.create_all(spark, folder)
    rows = None
    for table, (schema, _) in schemas.TABLES.items():
        own = changelog.read_log(spark, f"{folder}/{table}", schema).agg(F.count("*").alias("row_count")).select(
            F.lit(table).alias("table_name"),
            F.lit(table in created).alias("created"),
            F.lit(table in again).alias("created_again"),
            "row_count",
        )
        rows = own if rows is None else rows.union(own)
    return rows


@query
def replaced_traces(spark, sf_dir):
    """A trace's newest batch replaces all of its rows."""
    log = Inputs(spark, sf_dir).spans.select(
        "trace_id", "span_id", F.when(F.col("status_code") == "ERROR", 2).when(F.col("status_code") == "OK", 1).otherwise(0)
        .cast("bigint").alias(changelog.BATCH),
    )
    return changelog.current_by_trace(log)


@query
def stream_signature_counts(spark, sf_dir):
    """Signatures per hour as a stream with a watermark, run to the end of the given files."""
    i = Inputs(spark, sf_dir)
    folder = scratch(spark)
    traces = i.trajectories.where(F.col("start_ts_ms") > 0).select(
        F.timestamp_millis("start_ts_ms").alias("start_ts"), "trajectory_signature"
    )
    tables.append(traces.repartitionByRange(4, "start_ts"), f"{folder}/traces")
    stream = tables.table_stream(spark, f"{folder}/traces", "start_ts TIMESTAMP, trajectory_signature STRING")
    counts = jobs.signature_counts(stream, lateness="3650 days")
    log, schema = f"{folder}/counts", "window_start_ms BIGINT, window_end_ms BIGINT, signature STRING, n BIGINT"
    keys = ["window_start_ms", "signature"]
    (
        counts.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: changelog.write_batch(batch, log, batch_id, keys))
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    return changelog.current(changelog.read_log(spark, log, schema), keys)


@query
def stream_backfill(spark, sf_dir):
    """Message and metric files through the whole streaming chain to the window table."""
    i = Inputs(spark, sf_dir)
    folder = scratch(spark)
    i.landed_messages.select("value").write.text(f"{folder}/messages")
    gpu, network = i.landed_samples
    gpu.write.json(f"{folder}/gpu")
    network.write.json(f"{folder}/network")
    chain = jobs.Pipeline(folder=f"{folder}/tables", trigger=None, correlation=SPARSE)
    jobs.run_to_end(spark, chain, f"{folder}/messages", f"{folder}/gpu", f"{folder}/network")
    return jobs.current_windows(spark, chain)


def _in_batches(spark, sf_dir: str, samples_last: bool) -> jobs.Pipeline:
    """The spans of every trace land in four sets of files, children before their parents; the whole chain runs after two of
    them and again after all. Samples land before everything else or after it."""
    i = Inputs(spark, sf_dir)

    def chain(folder: str) -> jobs.Pipeline:
        return jobs.Pipeline(folder=f"{folder}/tables", trigger=None, correlation=SPARSE)

    def build(folder: str) -> None:
        def samples() -> None:
            gpu, network = i.landed_samples
            gpu.write.mode("overwrite").json(f"{folder}/gpu")
            network.write.mode("overwrite").json(f"{folder}/network")

        def run() -> None:
            jobs.run_to_end(spark, chain(folder), f"{folder}/messages", f"{folder}/gpu", f"{folder}/network")

        i.gpu.limit(0).write.json(f"{folder}/gpu")
        i.network.limit(0).write.json(f"{folder}/network")
        if not samples_last:
            samples()
        for parts in ((3, 1), (2, 0)):
            for part in parts:
                landed = i.landed_messages.where(F.col("event_id") % 4 == part).select("value")
                landed.write.mode("append").text(f"{folder}/messages")
            run()
        if samples_last:
            samples()
            run()

    return chain(i.folder(f"in_batches_{samples_last}", build))


@query
def stream_in_batches(spark, sf_dir):
    """What comes out in the end are the correlated traces of the batch form: late entry spans retract calls, and every table
    replaces what it said about a trace before."""
    return jobs.current(spark, _in_batches(spark, sf_dir, False), "trace_correlated").drop("ingestion_date", "ingestion_hour")


@query
def stream_late_samples(spark, sf_dir):
    """All samples land after the traces, which are routed and correlated again."""
    return jobs.current(spark, _in_batches(spark, sf_dir, True), "trace_correlated").drop("ingestion_date", "ingestion_hour")


@query
def stream_late_windows(spark, sf_dir):
    """The windows after retracted calls and late samples, changed batch by batch, are those of one pass over everything."""
    return jobs.current_windows(spark, _in_batches(spark, sf_dir, True))


@query
def stream_timed(spark, sf_dir):
    """All jobs run side by side, each every second; the messages come in files of their own micro-batches. Stopped when idle."""
    i = Inputs(spark, sf_dir)
    folder = scratch(spark)
    i.landed_messages.select("value").repartition(3).write.text(f"{folder}/messages")
    i.gpu.coalesce(1).write.json(f"{folder}/gpu")
    i.network.repartition(2).write.json(f"{folder}/network")
    chain = jobs.Pipeline(folder=f"{folder}/tables", trigger="1 second", max_files=1, correlation=SPARSE)
    jobs.run_until_idle(jobs.start_all(spark, chain, f"{folder}/messages", f"{folder}/gpu", f"{folder}/network"))
    return jobs.current(spark, chain, "trace_correlated").drop("ingestion_date", "ingestion_hour")


def _closed_windows(spark, sf_dir) -> str:
    """Traces land by time in six files, some of them one file late; hours close ten minutes after the latest row."""
    i = Inputs(spark, sf_dir)

    def build(folder: str) -> None:
        traces = i.trajectories.where(F.col("start_ts_ms") > 0)
        parts = traces.selectExpr("timestamp_millis(start_ts_ms) as start_ts", "trajectory_signature", f"{b.LANDED_PART} as part")
        parts.write.parquet(f"{folder}/parts")
        landed = spark.read.parquet(f"{folder}/parts")
        for part in range(7):
            tables.append(landed.where(F.col("part") == part).drop("part").coalesce(1), f"{folder}/traces")
        stream = tables.table_stream(spark, f"{folder}/traces", "start_ts TIMESTAMP, trajectory_signature STRING", max_files=1)
        for running in jobs.start_closed_windows(spark, stream, folder):
            running.awaitTermination()

    return i.folder("closed_windows", build)


@query
def stream_closed_windows(spark, sf_dir):
    """Signatures of the hours that have closed; late rows are not in them."""
    schema = "window_start_ms BIGINT, window_end_ms BIGINT, signature STRING, n BIGINT"
    return changelog.read_log(spark, f"{_closed_windows(spark, sf_dir)}/closed", schema).drop(changelog.BATCH)


@query
def stream_late_rows(spark, sf_dir):
    """Rows that came after their hour had closed, per hour."""
    log = changelog.read_log(spark, f"{_closed_windows(spark, sf_dir)}/late", "window_start_ms BIGINT, start_ts TIMESTAMP, trajectory_signature STRING")
    return log.groupBy("window_start_ms").agg(F.count("*").alias("late"))


@query
def rejected_spans(spark, sf_dir):
    """Spans without a trace id, a third of all."""
    spans = otlp.unidentified(otlp.flatten(b.otlp_messages(Inputs(spark, sf_dir).dealt_events, b.NAMELESS)))
    return spans.select("span_id", "operation_name", "start_time_unix_nano")
