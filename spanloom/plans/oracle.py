"""DuckDB statements of the registered queries, written independently of the Spark plans.

Naive on purpose: plain range joins, window functions and full outer joins. Only the input bindings are shared text.
"""

from __future__ import annotations

from spanloom.functions.judge import NO_EVIDENCE, NO_REASONING, NO_REQUEST, NO_RESPONSE, PROMPT_TEMPLATE
from spanloom.plans import bindings as b
from spanloom.plans.reports import SUMMARY_PROMPT
from spanloom.schemas import TABLES

INGESTED = "'2024-01-02' as ingestion_date, 3 as ingestion_hour"


def rnd(expression: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal text of a double, as Spark rounds."""
    return f"cast(cast(cast(({expression}) as double) as varchar)::decimal(38,{digits}) as double)"


def fmt(expression: str, digits: int, sign: bool = False) -> str:
    """printf after half-up rounding, keeping the sign of small negative numbers."""
    pattern = f"%{'+' if sign else ''}.{digits}f"
    zero = f"-{0:.{digits}f}"
    return (
        f"case when {rnd(expression, digits)} = 0 and ({expression}) < 0 then '{zero}' "
        f"else printf('{pattern}', {rnd(expression, digits)}) end"
    )


def pick(fields: dict[str, str]) -> str:
    return ", ".join(f"{e} as {name}" for name, e in fields.items())


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def using(names: str, select: str) -> str:
    """A statement with the named CTEs and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    body = ",\n".join(f"{name} as materialized ({CTES[name][1]})" for name in order)
    return f"with {body}\n{select}"


cte(
    "base",
    "select event_id, user_id, event_type, value, cast(json_extract_string(props, '$.k') as integer) as k, "
    "epoch_us(ts) as us from events",
)
cte("keyed", f"select *, {pick(b.SPAN_KEYS)} from base", "base")
cte("spans", f"select *, {b.TAGS} as tags, {b.REFERENCES} as refs from keyed", "keyed")
cte(
    "classified",
    """select *, case shape when 'entry' then 'ENTRY' when 'agent' then 'AGENT' when 'reason' then 'REASON'
      when 'rpc' then 'TOOL' when 'http' then 'TOOL' when 'plan' then 'PLAN' else 'RETRIEVE' end as span_kind,
    case shape when 'entry' then '/api/' || k when 'agent' then 'run' when 'reason' then 'chat' when 'rpc' then 'MCP'
      when 'http' then 'HTTP' when 'plan' then 'plan_execution' else 'findNearest' end as sub_span_kind,
    start_time_unix_nano // 1000000 as start_ts_ms, end_time_unix_nano // 1000000 as end_ts_ms,
    duration_ns / 1000000.0e0 as duration_ms,
    case when shape = 'reason' then case when k % 4 = 0 then '' else 'node-' || (k % 4) end end as node_id
    from spans where k % 10 not in (0, 1)""",
    "spans",
)
cte(
    "steps",
    """select * from classified c where not (span_kind = 'REASON' and exists (select 1 from classified e
    where e.span_kind = 'ENTRY' and e.trace_id = c.trace_id and e.span_id = c.parent_span_id))""",
    "classified",
)
cte(
    "traj_base",
    """select trace_id, first(session_id order by start_ts_ms, span_id) as session_id,
    string_agg(span_kind, '|' order by start_ts_ms, span_id) as step_sequence,
    string_agg(span_kind || ':' || sub_span_kind, '|' order by start_ts_ms, span_id) as step_sequence_detailed,
    cast(count(*) as integer) as step_count,
    cast(count(*) filter (span_kind = 'REASON') as integer) as llm_call_count,
    cast(count(*) filter (span_kind = 'TOOL') as integer) as tool_call_count,
    cast(count(*) filter (span_kind = 'RETRIEVE') as integer) as retrieve_count,
    cast(count(*) filter (span_kind = 'AGENT') as integer) as agent_count,
    coalesce(min(start_ts_ms) filter (start_ts_ms <> 0), 0) as start_ts_ms,
    coalesce(max(end_ts_ms) filter (end_ts_ms <> 0), 0) as end_ts_ms
    from steps group by trace_id""",
    "steps",
)
cte(
    "traj",
    """select *, 'tpl_' || substr(sha256(step_sequence), 1, 12) as trajectory_signature,
    greatest(0, llm_call_count - agent_count - 1) as retry_count, 0 as error_count,
    cast(end_ts_ms - start_ts_ms as double) as total_duration_ms from traj_base""",
    "traj_base",
)
cte("gpu", f"select {pick(b.GPU_FIELDS)} from base", "base")
cte("net", f"select {pick(b.NETWORK_FIELDS)} from base", "base")
cte("quality", f"select {pick(b.QUALITY_FIELDS)} from base where {b.SCORED}", "base")
cte(
    "latest",
    """select node_id, gpu_id, gpu_uuid from (select *, row_number() over (partition by node_id
    order by timestamp_ms desc, gpu_id, gpu_uuid) as rn from gpu) where rn = 1""",
    "gpu",
)
cte(
    "routing",
    """select trace_id, span_id, 'ollama-' || node as vllm_pod_id, node as node_id,
    coalesce(l.gpu_id, 'gpu-0') as gpu_id, coalesce(l.gpu_uuid, '') as gpu_uuid, 0e0 as queue_wait_ms,
    start_ts_ms as timestamp_ms
    from (select *, coalesce(nullif(node_id, ''), 'node-1') as node from steps where span_kind = 'REASON') s
    left join latest l on l.node_id = s.node""",
    "steps", "latest",
)
cte(
    "calls",
    """select r.*, coalesce(nullif(r.timestamp_ms, 0), t.start_ts_ms) as call_ts
    from routing r join traj t using (trace_id)""",
    "routing", "traj",
)
TOLERANCE = 600_000
cte(
    "gpu_side",
    f"""select c.trace_id, count(*) as gpu_n, sum(contention_index) as contention_sum,
    max(contention_index) as contention_max, sum(temperature_c) as temperature_sum, max(temperature_c) as temperature_max,
    sum(memory_used_pct) as memory_sum, sum(power_draw_pct) as power_sum,
    cast(count(*) filter (throttle_active <> 0) as bigint) as throttled
    from calls c join gpu g on g.node_id = c.node_id and g.gpu_id = c.gpu_id and abs(g.timestamp_ms - c.call_ts) <= {TOLERANCE}
    group by c.trace_id""",
    "calls", "gpu",
)
cte(
    "net_side",
    f"""select c.trace_id, cast(count(*) filter (inter_node_latency_us > 0) as bigint) as latency_n,
    sum(inter_node_latency_us) filter (inter_node_latency_us > 0) as latency_sum,
    max(inter_node_latency_us) filter (inter_node_latency_us > 0) as latency_max,
    cast(sum(packet_drop_count) as bigint) as drops, cast(sum(tcp_retransmit_count) as bigint) as retransmits
    from calls c join net n on n.node_id = c.node_id and abs(n.timestamp_ms - c.call_ts) <= {TOLERANCE}
    group by c.trace_id""",
    "calls", "net",
)
cte(
    "pods",
    """select trace_id, vllm_pod_id as primary_pod_id, node_id as primary_node_id, gpu_id as primary_gpu_id from (
      select *, row_number() over (partition by trace_id order by n desc, vllm_pod_id, call_ts, span_id) as rn from (
        select *, count(*) over (partition by trace_id, vllm_pod_id) as n from calls)) where rn = 1""",
    "calls",
)
DIMS = ("overall", "completeness", "coherence", "hallucination", "groundedness", "relevance")
QUALITY_OF = ", ".join(f"coalesce(q.{d}, 0e0) as quality_{d}" for d in DIMS)


def signals(other: int) -> str:
    def mean(total: str, n: str, digits: int) -> str:
        return rnd(f"coalesce({total} / nullif({n}, 0), 0e0)", digits)

    return f"""{mean('contention_sum', 'gpu_n', 4)} as gpu_contention_avg,
    {rnd('coalesce(contention_max, 0e0)', 4)} as gpu_contention_max,
    {mean('temperature_sum', 'gpu_n', other)} as gpu_temperature_avg,
    {rnd('coalesce(temperature_max, 0e0)', other)} as gpu_temperature_max,
    {mean('memory_sum', 'gpu_n', other)} as gpu_memory_pressure_avg,
    cast(coalesce(throttled, 0) as bigint) as gpu_throttle_count,
    {mean('power_sum', 'gpu_n', other)} as gpu_power_avg,
    {mean('latency_sum', 'latency_n', other)} as inter_node_latency_avg,
    {rnd('coalesce(latency_max, 0e0)', other)} as inter_node_latency_max,
    cast(coalesce(drops, 0) as bigint) as packet_drop_total,
    cast(coalesce(retransmits, 0) as bigint) as tcp_retransmit_total"""


def correlated_sql(quality: str) -> str:
    return f"""select t.trace_id, t.session_id, t.start_ts_ms, t.end_ts_ms, total_duration_ms, trajectory_signature,
    step_sequence, step_count, llm_call_count, tool_call_count, retrieve_count, retry_count, {QUALITY_OF},
    coalesce(q.explanation, '') as quality_explanation, {signals(2)}, 0e0 as queue_wait_avg, 0e0 as queue_wait_max,
    coalesce(primary_pod_id, '') as primary_pod_id, coalesce(primary_node_id, '') as primary_node_id,
    coalesce(primary_gpu_id, '') as primary_gpu_id, {INGESTED}
    from traj t left join {quality} q on q.trace_id = t.trace_id left join pods p on p.trace_id = t.trace_id
    left join gpu_side g on g.trace_id = t.trace_id left join net_side n on n.trace_id = t.trace_id"""


cte("correlated", correlated_sql("quality"), "traj", "quality", "pods", "gpu_side", "net_side")


def window_ctes(prefix: str, correlated: str) -> None:
    """CTEs from a correlated table to its windows, all names prefixed."""
    p = prefix
    cte(
        f"{p}wtraces",
        f"""select w.window_size, w.ms, c.start_ts_ms // w.ms * w.ms as window_start_ms, c.* from {correlated} c,
        (values ('5min', 300000), ('30min', 1800000), ('1h', 3600000)) as w(window_size, ms) where c.start_ts_ms <> 0""",
        correlated,
    )
    cte(
        f"{p}wcounts",
        f"select window_size, window_start_ms, trajectory_signature as sig, count(*) as n from {p}wtraces "
        "group by all",
        f"{p}wtraces",
    )
    cte(
        f"{p}wbase",
        f"select window_size, min(window_start_ms) as base_start from {p}wtraces group by all",
        f"{p}wtraces",
    )
    cte(
        f"{p}wdist",
        f"select *, n / sum(n) over (partition by window_size, window_start_ms) as p from {p}wcounts",
        f"{p}wcounts",
    )
    cte(
        f"{p}wpairs",
        f"""select w.window_size, w.window_start_ms, coalesce(d.p, 0e0) as p, coalesce(s.q, 0e0) as q from
        (select distinct window_size, window_start_ms from {p}wdist) w
        join (select distinct x.window_size, x.window_start_ms, y.sig from {p}wdist x join (
            select window_size, window_start_ms as ws, sig from {p}wdist) y on y.window_size = x.window_size
            and (y.ws = x.window_start_ms or y.ws = (select base_start from {p}wbase z where z.window_size = x.window_size))) u
          on u.window_size = w.window_size and u.window_start_ms = w.window_start_ms
        left join {p}wdist d on d.window_size = w.window_size and d.window_start_ms = w.window_start_ms and d.sig = u.sig
        left join (select a.window_size, a.sig, a.p as q from {p}wdist a join {p}wbase z
            on z.window_size = a.window_size and z.base_start = a.window_start_ms) s
          on s.window_size = w.window_size and s.sig = u.sig""",
        f"{p}wdist", f"{p}wbase",
    )
    cte(
        f"{p}wjsd",
        f"""select window_size, window_start_ms, {rnd('''greatest(0e0, least(1e0, sum(
        case when p > 0 then 0.5e0 * p * log2(p / (0.5e0 * (p + q))) else 0e0 end
        + case when q > 0 then 0.5e0 * q * log2(q / (0.5e0 * (p + q))) else 0e0 end)))''', 4)} as jsd
        from {p}wpairs group by all""",
        f"{p}wpairs",
    )
    cte(
        f"{p}wentropy",
        f"select window_size, window_start_ms, {rnd('-sum(p * log2(p))', 4)} as entropy from {p}wdist group by all",
        f"{p}wdist",
    )
    cte(
        f"{p}wtop",
        f"""select window_size, window_start_ms, sig, p from (select *, row_number() over (
        partition by window_size, window_start_ms order by n desc, sig) as rn from {p}wdist) where rn = 1""",
        f"{p}wdist",
    )
    cte(
        f"{p}wagg",
        f"""select window_size, window_start_ms, any_value(ms) as ms, count(*) as n, avg(quality_overall) as q,
        avg(quality_hallucination) as h, avg(gpu_contention_avg) as c, max(gpu_contention_avg) as c_max,
        avg(inter_node_latency_avg) as l, cast(sum(packet_drop_total) as bigint) as drops,
        count(distinct trajectory_signature) as sigs,
        case when count(*) < 3 or min(gpu_contention_avg) = max(gpu_contention_avg)
          or min(quality_overall) = max(quality_overall) then 0e0
        else {rnd('''covar_pop(gpu_contention_avg, quality_overall)
          / sqrt(var_pop(gpu_contention_avg) * var_pop(quality_overall))''', 4)} end as corr
        from {p}wtraces group by window_size, window_start_ms""",
        f"{p}wtraces",
    )
    cte(
        f"{p}wwide",
        f"""select a.*, t.sig, t.p as share, e.entropy, case when a.window_start_ms = z.base_start then 0e0 else j.jsd end as jsd,
        cast(a.window_start_ms = z.base_start as integer) as is_baseline, s.q as base_q,
        {rnd('a.q - s.q', 4)} as delta, {rnd('a.c', 4)} as gpu_avg, {rnd('a.l', 2)} as lat
        from {p}wagg a join {p}wbase z using (window_size)
        join {p}wagg s on s.window_size = a.window_size and s.window_start_ms = z.base_start
        join {p}wtop t on t.window_size = a.window_size and t.window_start_ms = a.window_start_ms
        join {p}wentropy e on e.window_size = a.window_size and e.window_start_ms = a.window_start_ms
        join {p}wjsd j on j.window_size = a.window_size and j.window_start_ms = a.window_start_ms""",
        f"{p}wagg", f"{p}wbase", f"{p}wtop", f"{p}wentropy", f"{p}wjsd",
    )
    cte(
        f"{p}wflags",
        f"""select *, cast(delta <= -0.5 or (q > 0 and q < 3.0) as integer) as quality_drop,
        cast(jsd >= 0.15 as integer) as trajectory_drift, cast(gpu_avg >= 0.6 as integer) as gpu_pressure,
        cast(drops > 0 or lat >= 500.0 as integer) as network_pressure from {p}wwide""",
        f"{p}wwide",
    )
    cte(
        f"{p}windows",
        f"""select window_size, window_start_ms, window_start_ms + ms as window_end_ms, cast(n as integer) as trace_count,
        sig as dominant_signature, {rnd('share', 4)} as dominant_share, cast(sigs as integer) as unique_signatures,
        entropy as trajectory_entropy, jsd as trajectory_drift_jsd, is_baseline, {rnd('q', 4)} as quality_overall_avg,
        {rnd('h', 4)} as quality_hallucination_avg, {rnd('base_q', 4)} as quality_overall_baseline, delta as quality_delta,
        gpu_avg as gpu_contention_avg, {rnd('c_max', 4)} as gpu_contention_max, lat as net_latency_avg,
        cast(drops as bigint) as packet_drop_total, quality_drop, trajectory_drift, gpu_pressure, network_pressure,
        corr as contention_quality_corr,
        case when quality_drop = 1 and trajectory_drift = 1 and gpu_pressure = 1 then 'gpu_induced_degradation'
          when quality_drop = 1 and trajectory_drift = 1 and network_pressure = 1 then 'network_induced_degradation'
          when quality_drop = 1 and trajectory_drift = 1 then 'app_layer_degradation'
          when trajectory_drift = 1 then 'trajectory_drift_no_quality_impact'
          when quality_drop = 1 then 'quality_drop_stable_trajectory' else 'normal' end as correlation_flag,
        'q_avg=' || {fmt('q', 2)} || ' (delta ' || {fmt('delta', 2, True)} || '), halluc=' || {fmt('h', 2)}
        || ', drift_jsd=' || {fmt('jsd', 3)} || ', entropy=' || {fmt('entropy', 2)} || ', gpu_contention='
        || {fmt('gpu_avg', 3)} || ', corr(gpu,q)=' || {fmt('corr', 2, True)} || ', n=' || n as correlation_details
        from {p}wflags""",
        f"{p}wflags",
    )


window_ctes("", "correlated")

ORACLES: dict[str, str] = {}


def oracle(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = using(ctes, select)


# --- messages, spans, steps ---

SPAN_LIST = ", ".join(b.SPAN_COLUMNS)
oracle("otlp_flatten", "spans", f'select {SPAN_LIST}, tags, refs as "references" from spans where k <> {b.BROKEN_MESSAGE_K}')
oracle("undecodable_messages", "base", f"select event_id, 60 as chars from base where k = {b.BROKEN_MESSAGE_K}")
oracle(
    "attribute_precedence",
    "base",
    """select event_id, 's' || k as text, cast(k as varchar) as int_text, k || '.5' as double_text,
    case when k % 2 = 0 then 'true' else 'false' end as bool_text, '{"values":[' || k || ']}' as list_text,
    '{"values":[' || k || ']}' as map_text, 'last' || k as twice from base""",
)
oracle(
    "span_identifiers",
    "keyed",
    """select event_id, case k % 5 when 0 then span_id when 1 then span_id when 2 then upper(span_id)
    when 3 then 'not an id!' else '' end as id from keyed""",
)
oracle(
    "span_links",
    "keyed",
    """select event_id, '{"link.0.trace_id":"' || trace_id || '","link.0.span_id":"' || span_id || '","link.0.kind":"' || k
    || '","link.1.trace_id":"","link.1.span_id":"' || span_id || '"}' as links from keyed""",
)
oracle(
    "span_classification",
    "spans classified",
    """select s.span_id, case when s.k % 10 = 0 then 'dropped' when s.k % 10 = 1 then 'unclassified' else c.span_kind end
    as outcome, case when s.k % 10 = 1 then '' when s.k % 10 <> 0 then c.sub_span_kind else
      case s.shape when 'entry' then '/api/' || s.k when 'agent' then 'run' when 'reason' then 'chat' when 'rpc' then 'MCP'
      when 'http' then 'HTTP' when 'plan' then 'plan_execution' else 'findNearest' end end as sub
    from spans s left join classified c on c.event_id = s.event_id""",
)
oracle(
    "steps_of_broken_tags",
    "classified",
    "select span_id, span_kind, sub_span_kind from classified where right(span_id, 1) not in ('0', '1', '2', '3')",
)
oracle(
    "classified_steps",
    "classified",
    f"""select trace_id, session_id, span_id, parent_span_id, span_kind, sub_span_kind, start_ts_ms, duration_ms, end_ts_ms,
    case when shape = 'entry' then 'POST' end as method, case when shape = 'agent' then 'agent' || (k % 5) end as agent_name,
    case when shape = 'reason' then 'm' || (k % 3) end as model,
    cast(case when shape = 'reason' then k * 10 end as integer) as input_tokens,
    cast(case when shape = 'reason' and k % 7 <> 0 then k * 3 end as integer) as output_tokens,
    case when shape = 'retrieve' then 'col' || (k % 4) end as collection,
    case when shape = 'retrieve' then 'find ' || k end as query_text,
    cast(case when shape = 'retrieve' then k % 6 end as integer) as returned_rows,
    case when shape = 'rpc' then 'tool' || (k % 5) end as rpc_method,
    case when shape = 'http' then 'http://t/' || (k % 5) end as url, case when shape = 'http' then '200' end as status_code,
    case when shape = 'agent' then '{{"city":"c' || (k % 7) || '"}}' when shape = 'rpc' then '{{"q":"q' || k || '"}}' end as context,
    case when shape = 'reason' then 'question ' || k when shape = 'retrieve' then 'find ' || k end as prompt,
    case when shape = 'reason' then case when k % 11 = 0 then '' else 'answer ' || k end
      when shape = 'rpc' then 'result ' || k end as response, node_id, {INGESTED} from classified""",
)
oracle(
    "agent_steps",
    "steps",
    f"""select trace_id, session_id, span_id, parent_span_id, span_kind, sub_span_kind, start_ts_ms, duration_ms, end_ts_ms,
    {INGESTED} from steps""",
)
oracle(
    "impacted_lookback",
    "spans",
    """select trace_id, span_id, start_time_unix_nano from spans where trace_id in (select trace_id from spans
    where status_code = 'ERROR' and start_time_unix_nano > 0) and start_time_unix_nano >= (select min(start_time_unix_nano)
    from spans where status_code = 'ERROR' and start_time_unix_nano > 0) // 1000000 * 1000000 - 3600000000000""",
)
oracle(
    "trace_search",
    "spans",
    """select trace_id, count(*) as span_count, min(start_time_unix_nano) as start_time_unix_nano,
    max(end_time_unix_nano) as end_time_unix_nano, count(*) filter (status_code = 'ERROR') as error_count
    from spans where service_name = 'svc1' and start_time_unix_nano >= (select max(start_time_unix_nano) from spans)
      - 172800000000000 group by trace_id order by 3 desc, 1 limit 20""",
)
cte(
    "edges",
    """select p.operation_name as source, c.operation_name as target, count(*) as calls from spans c join spans p
    on p.trace_id = c.trace_id and p.span_id = c.parent_span_id where c.parent_span_id <> '' group by all""",
    "spans",
)
oracle("call_graph", "edges", "select * from edges")
oracle(
    "call_graph_totals",
    "edges",
    """select 'nodes' as measure, count(*) as value from (select source from edges union select target from edges)
    union all select 'edges', count(*) from edges union all select 'edges to ' || target, count(*) from edges group by target""",
)

# --- trajectories ---

TRAJ_COLUMNS = """trace_id, session_id, trajectory_signature, step_sequence, step_sequence_detailed, step_count,
llm_call_count, tool_call_count, retrieve_count, agent_count, retry_count, error_count, total_duration_ms, start_ts_ms,
end_ts_ms"""
oracle("trajectories", "traj", f"select {TRAJ_COLUMNS}, {INGESTED} from traj")
oracle(
    "template_distribution",
    "traj",
    f"""select signature, count, {rnd('count / (select count(*) from traj)', 4)} as share, step_count, llm_call_count,
    tool_call_count, retrieve_count, step_sequence, step_sequence_detailed from (
      select trajectory_signature as signature, count(*) over (partition by trajectory_signature) as count, *,
      row_number() over (partition by trajectory_signature order by start_ts_ms, trace_id) as rn from traj) where rn = 1""",
)
oracle(
    "span_errors",
    "spans",
    "select trace_id, cast(count(*) filter (status_code = 'ERROR') as integer) as error_count from spans group by 1",
)
oracle(
    "microstructure",
    "traj",
    """select trace_id, session_id, step_count, llm_call_count, tool_call_count, retrieve_count, agent_count, retry_count,
    error_count, total_duration_ms, trajectory_signature from traj""",
)
oracle(
    "trajectory_detail",
    "steps traj",
    """select s.trace_id, s.span_id, s.span_kind, s.start_ts_ms, t.trajectory_signature, t.step_count
    from steps s join traj t using (trace_id)""",
)

# --- judging ---

cte(
    "lines",
    """select *, case when span_kind = 'REASON' then '[LLM:m' || (k % 3) || ']: question ' || k
      when span_kind = 'AGENT' then '[Agent:agent' || (k % 5) || ']' end as reasoning,
    case when span_kind = 'RETRIEVE' then '[RAG:col' || (k % 4) || '] query=''find ' || k || ''''
      when shape = 'rpc' then '[Tool:tool' || (k % 5) || '] → result ' || k
      when shape = 'http' then '[Tool:http://t/' || (k % 5) || '] → ' end as evidence,
    case when span_kind = 'REASON' and k % 11 <> 0 then 'answer ' || k end as answer,
    case when span_kind = 'ENTRY' then 'plan ' || k end as message from steps""",
    "steps",
)
cte(
    "contexts",
    f"""select trace_id, first(session_id order by start_ts_ms, span_id) as session_id, '{NO_REQUEST}' as user_request,
    coalesce(string_agg(reasoning, chr(10) order by start_ts_ms, span_id), '{NO_REASONING}') as reasoning_chain,
    coalesce(string_agg(evidence, chr(10) order by start_ts_ms, span_id), '{NO_EVIDENCE}') as evidence,
    coalesce(last(answer order by start_ts_ms, span_id) filter (answer is not null), '{NO_RESPONSE}') as final_response,
    coalesce(last(message order by start_ts_ms, span_id) filter (message is not null), '{NO_REQUEST}') as message,
    coalesce(min(start_ts_ms) filter (start_ts_ms <> 0), 0) as start_ts_ms,
    coalesce(max(end_ts_ms) filter (end_ts_ms <> 0), 0) as end_ts_ms from lines group by trace_id""",
    "lines",
)


def _template_sql() -> str:
    pieces, rest = [], PROMPT_TEMPLATE
    for field in ("user_request", "reasoning_chain", "evidence", "final_response"):
        before, _, rest = rest.partition("{" + field + "}")
        pieces += [before, field]
    pieces.append(rest)
    quoted = [p if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(pieces)]
    return " || ".join(quoted)


oracle("judge_prompts", "contexts", f"select * exclude (message), {_template_sql()} as prompt from contexts")
oracle("judge_prompts_with_request", "contexts", "select trace_id, message as user_request, final_response from contexts")
cte(
    "judged",
    f"""select trace_id, session_id, case when final_response = '{NO_RESPONSE}' then 1e0 else 4e0 end as completeness,
    case when reasoning_chain = '{NO_REASONING}' then 2e0 else 4e0 end as coherence,
    case when evidence = '{NO_EVIDENCE}' then 2e0 else 5e0 end as hallucination,
    case when evidence = '{NO_EVIDENCE}' then 2e0 else 5e0 end as groundedness, 3e0 as relevance,
    (case when final_response = '{NO_RESPONSE}' then 1e0 else 4e0 end
     + case when evidence = '{NO_EVIDENCE}' then 2e0 else 5e0 end) / 2 as overall, '' as explanation,
    'rules' as eval_model, start_ts_ms, end_ts_ms from contexts""",
    "contexts",
)
oracle("judged_traces", "judged", "select * from judged")


def _scores(*five: str, overall: str, explanation: str = "''") -> str:
    names = ("completeness", "coherence", "hallucination", "groundedness", "relevance")
    fields = ", ".join(f"{n}: cast({v} as double)" for n, v in zip(names, five))
    return "{" + f"{fields}, overall: cast({overall} as double), explanation: {explanation}" + "}"


ERROR_ROW = _scores("0", "0", "0", "0", "0", overall="0", explanation="'eval_error: unreadable reply'")
oracle(
    "judge_replies",
    "base",
    f"""select event_id, s.completeness, s.coherence, s.hallucination, s.groundedness, s.relevance, s.overall, s.explanation
    from (select event_id, case {b.BLOCK} % 7 when 0 then {ERROR_ROW}
    when 1 then {_scores('greatest(1, least(5, k % 7))', '5', '3', '4', '4',
                         overall='(greatest(1, least(5, k % 7)) + 16) / 5e0')}
    when 2 then {_scores('4', 'greatest(1, k % 6)', '3', '3', '3', overall='(13 + greatest(1, k % 6)) / 5e0')}
    when 3 then {_scores('4', '3', '3', '3', '3', overall='k % 5 + 0.25e0', explanation="'ok ' || k")}
    when 4 then {ERROR_ROW}
    when 5 then {_scores('5', '1', '3', '3', '3', overall='3', explanation="'x'")}
    else {ERROR_ROW} end as s from base)""",
)
oracle(
    "intent_replies",
    "base",
    f"""select event_id, case {b.BLOCK} % 5 when 1 then 'modify_plan' when 2 then 'proceed' else 'plan_trip' end as intent,
    case {b.BLOCK} % 5 when 0 then 'd' || k else '' end as destination,
    case {b.BLOCK} % 5 when 1 then cast(k as varchar) else '' end as budget,
    case {b.BLOCK} % 5 when 2 then 'o' || k else '' end as origin from base""",
)
oracle(
    "request_parameters",
    "base",
    """select event_id, case when k % 3 = 0 then 'destination' else '' end as missing,
    case when k % 3 = 0 then '' else 'd' || k end as destination,
    case when k % 2 = 0 then 'mid-range' else 'b' || k end as budget, 'nearest major airport' as origin,
    '1' as passengers, '' as note from base""",
)
ORACLES["token_estimates"] = r"""select conv_id, turn,
    cast(case when turn % 3 = 0 then turn else 2 * (case when trim(text, ' ') = '' then 0
      else len(regexp_split_to_array(trim(text, ' '), '\s+')) end) end as integer) as output_tokens,
    cast(case when turn % 3 = 0 then turn else length(text) // 4 end as integer) as input_tokens,
    cast(least(length(text), 200) as integer) as stored_chars from conversations"""

# --- metrics and routing ---

cte(
    "counters_gpu",
    f"""select {b.GPU_FIELDS['timestamp_ms']} as timestamp_ms, {b.GPU_FIELDS['node_id']} as node_id,
    {b.GPU_FIELDS['gpu_id']} as gpu_id, {b.GPU_FIELDS['gpu_uuid']} as gpu_uuid, cast(k as double) as gpu_utilization,
    cast(100 - k as double) as memory_controller_util,
    case when k % 20 = 0 then 0e0 else {rnd('cast(floor(value * 1000) as bigint) / 700000e0 * 100e0', 2)} end as memory_used_pct,
    cast(30 + k as double) as temperature_c,
    case when k % 30 = 1 then 0e0 else {rnd('(k * 2500) / 350000e0 * 100e0', 2)} end as power_draw_pct,
    1200e0 as clock_sm_mhz, 5000e0 as clock_mem_mhz, case when k % 9 = 0 then 1 else 0 end as throttle_active,
    {rnd('k * 123456 / 1000e0', 2)} as pcie_tx_mbps, {rnd('k * 65432 / 1000e0', 2)} as pcie_rx_mbps,
    k % 2 as ecc_errors_total from base""",
    "base",
)
oracle(
    "gpu_from_counters",
    "counters_gpu",
    f"""select *, {rnd('''0.2e0 * (gpu_utilization / 100e0) + 0.15e0 * (memory_controller_util / 100e0)
    + 0.15e0 * (memory_used_pct / 100e0) + 0.15e0 * least(temperature_c / 90e0, 1e0) + 0.15e0 * (power_draw_pct / 100e0)
    + 0.1e0 * throttle_active + 0.1e0 * least((pcie_tx_mbps + pcie_rx_mbps) / 15000e0, 1e0)''', 4)} as contention_index
    from counters_gpu""",
)
oracle(
    "queue_contention",
    "base",
    """select event_id, c as contention, case when c > 0.7e0 then 'critical' when c > 0.4e0 then 'warn' else 'normal' end
    as severity, case when c > 0.7e0 then 'DEGRADED' when c > 0.4e0 then 'WARNING' else 'HEALTHY' end as badge from (
    select event_id, greatest(0e0, least(1e0, 0.25e0 * (k / 100e0) + 0.2e0 * ((100 - k) / 100e0) + 0.2e0 * (k / 2e0 / 100e0)
    + 0.25e0 * least(value / 500e0, 1e0) + 0.1e0 * (k * 2e0 / 100e0))) as c from base)""",
)
oracle(
    "metric_ingest",
    "base",
    """select outcome, node_id, ingestion_date, ingestion_hour, peer_node_id, count(*) as lines, max(latency) as max_latency
    from (select case when k = 1 then 'not JSON' when k % 10 = 3 then 'missing inter_node_latency_us'
      when k % 10 = 4 then 'bad inter_node_latency_us' when k % 10 = 5 then 'bad packet_drop_count' else 'accepted' end as outcome,
    case when outcome = 'accepted' then 'node-' || (user_id % 4) else '' end as node_id,
    case when outcome = 'accepted' then strftime(make_timestamp(us), '%Y-%m-%d') else '' end as ingestion_date,
    cast(case when outcome = 'accepted' then hour(make_timestamp(us)) else 0 end as integer) as ingestion_hour,
    case when outcome = 'accepted' and k % 10 = 2 then 'p' else '' end as peer_node_id,
    case when outcome = 'accepted' then k + 0.5e0 else 0e0 end as latency from base) group by all""",
)
oracle(
    "source_freshness",
    "gpu",
    f"""select node_id, {rnd('((select max(timestamp_ms) from gpu) - max(timestamp_ms)) / 1000e0', 1)} as last_real_ago_s,
    case when ((select max(timestamp_ms) from gpu) - max(timestamp_ms)) / 1000e0 < 30 then 'real' else 'synthetic' end as source
    from gpu group by node_id""",
)
oracle("latest_gpu", "latest", "select * from latest")
oracle("request_routing", "routing", f"select *, {INGESTED} from routing")
oracle(
    "routing_distribution",
    "routing",
    """select 'pod' as by, vllm_pod_id as id, count(*) as requests from routing group by 2
    union all select 'node', node_id, count(*) from routing group by 2
    union all select 'total', '', count(*) from routing""",
)
cte(
    "counters_net",
    """select node_id, ts_ms, min(c) as c from (select 'node-' || (l_suppkey % 50) as node_id,
    l_orderkey * 8000 + l_linenumber * 1000 as ts_ms,
    {tx: l_orderkey * 1000000 + l_partkey * 100, rx: l_orderkey * 500000 + l_suppkey * 100, d: l_partkey, r: l_suppkey} as c
    from lineitem) group by all""",
)
oracle(
    "network_rates",
    "counters_net",
    f"""select ts_ms as timestamp_ms, node_id, {rnd('(c.tx - p.tx) * 8 / s / 1000000e0', 4)} as throughput_tx_mbps,
    {rnd('(c.rx - p.rx) * 8 / s / 1000000e0', 4)} as throughput_rx_mbps, greatest(0, c.d - p.d) as packet_drop_count,
    greatest(0, c.r - p.r) as tcp_retransmit_count from (select *, lag(c) over w as p,
    (ts_ms - lag(ts_ms) over w) / 1000e0 as s from counters_net window w as (partition by node_id order by ts_ms))
    where p is not null""",
)
cte(
    "incidents",
    """select 'incident ' || o_orderkey as name, 1704067200000 + o_orderkey * 7919 % 2592000000 as start_ms,
    1704067200000 + o_orderkey * 7919 % 2592000000 + o_custkey * 977 as end_ms, 'node-' || (o_custkey % 9) as node_id,
    (o_orderkey % 8) / 8e0 as intensity from orders""",
)
oracle(
    "incident_labels",
    "gpu incidents",
    """select g.timestamp_ms, g.node_id, g.gpu_id, cast(h.w is not null as integer) as contended, h.w.name as incident,
    coalesce(h.w.intensity, 0e0) as intensity from gpu g left join (
      select t.timestamp_ms, t.node_id, min({s: i.start_ms, name: i.name, intensity: i.intensity}) as w
      from (select distinct timestamp_ms, node_id from gpu) t join incidents i on i.node_id = t.node_id
      and t.timestamp_ms between i.start_ms and i.end_ms group by all) h
    on h.timestamp_ms = g.timestamp_ms and h.node_id = g.node_id""",
)
oracle(
    "gpu_report",
    "gpu",
    """select timestamp_ms, node_id, gpu_id, contention_index from (select *, row_number() over (
    order by timestamp_ms, node_id, gpu_id) as rn from gpu where timestamp_ms >= 1704200000000 and node_id = 'node-1')
    where (rn - 1) % 4 = 0""",
)
oracle(
    "gpu_report_per_series",
    "gpu",
    """select timestamp_ms, node_id, gpu_id, contention_index from (select *, row_number() over (
    partition by node_id, gpu_id order by timestamp_ms) as rn from gpu) where (rn - 1) % 10 = 0""",
)
oracle(
    "gpu_summary",
    "gpu",
    f"""select count(*) as total_samples, {rnd('avg(contention_index)', 4)} as avg_contention,
    max(contention_index) as max_contention,
    {rnd('count(*) filter (contention_index > 0.7e0) / count(*) * 100', 1)} as high_contention_pct from gpu""",
)
oracle(
    "network_report",
    "net",
    """select timestamp_ms, node_id, inter_node_latency_us, packet_drop_count from (select *, row_number() over (
    order by timestamp_ms, node_id) as rn from net where timestamp_ms <= 1705000000000) where (rn - 1) % 3 = 0""",
)
SEVERITY = "case when {0} > 0.7e0 then 'critical' when {0} > 0.4e0 then 'warn' else 'normal' end"
oracle(
    "contention_by_gpu",
    "gpu",
    f"""select *, {SEVERITY.format('avg_contention')} as severity from (select node_id || ':' || gpu_id as entity_id,
    avg(contention_index) as avg_contention from gpu group by 1)""",
)
NODE_PROPERTIES = '{"source":"gpu_collector","nic":"real","switch_port":"vast.ai"}'
cte(
    "topo",
    f"""select 'node' as entity_type, node_id as entity_id, cast(null as varchar) as parent_id, '{NODE_PROPERTIES}' as properties
    from (select distinct node_id from gpu) union all
    select 'gpu', node_id || ':' || gpu_id, node_id, '{{"gpu_uuid":"' || first(gpu_uuid order by timestamp_ms, gpu_uuid) || '"}}'
    from gpu group by node_id, gpu_id""",
    "gpu",
)
oracle("topology", "topo", "select * from topo")
oracle("topology_summary", "topo", "select entity_type, count(*) as entities from topo group by 1")
oracle(
    "topology_tree",
    "topo routing gpu",
    f"""select n.entity_id as node_id, p.entity_type, p.entity_id,
    case when p.entity_type = 'gpu' then {rnd('coalesce(c.a, 0e0)', 2)} end as avg_contention,
    case when p.entity_type = 'gpu' then {SEVERITY.format('coalesce(c.a, 0e0)')} end as severity,
    case when p.entity_type = 'pod' then coalesce(r.n, 0) end as requests
    from (select entity_id from topo where entity_type = 'node') n
    left join (select entity_type, entity_id, parent_id from topo where entity_type = 'gpu'
      union all select distinct 'pod', vllm_pod_id, node_id from routing) p on p.parent_id = n.entity_id
    left join (select node_id || ':' || gpu_id as id, avg(contention_index) as a from gpu group by 1) c on c.id = p.entity_id
    left join (select vllm_pod_id as id, count(*) as n from routing group by 1) r on r.id = p.entity_id""",
)
oracle(
    "calibrated_threshold",
    "gpu",
    f"""select *, case when max_contention > avg_contention + 0.01e0 then
    {rnd('avg_contention + 0.6e0 * (max_contention - avg_contention)', 2)} end as suggested_threshold
    from (select {rnd('avg(contention_index)', 4)} as avg_contention, max(contention_index) as max_contention from gpu)""",
)

# --- correlation ---

oracle(
    "metric_time_range",
    "gpu traj",
    """select timestamp_ms, node_id, gpu_id from gpu where timestamp_ms between
    (select min(start_ts_ms) - 10000 from traj where llm_call_count >= 2 and start_ts_ms <> 0) and
    (select max(end_ts_ms) + 10000 from traj where llm_call_count >= 2 and end_ts_ms <> 0)""",
)
oracle("gpu_around_calls", "gpu_side", "select * from gpu_side")
oracle("network_around_calls", "net_side", "select * from net_side")
oracle(
    "primary_pods",
    "calls pods",
    """select p.*, waits, wait_sum, wait_max from pods p join (select trace_id, count(w) as waits, sum(w) as wait_sum,
    max(w) as wait_max from (select trace_id, nullif(cast(timestamp_ms % 5 as double), 0e0) as w from calls) group by 1) q
    using (trace_id)""",
)
oracle("correlated_traces", "correlated", "select * from correlated")
LIVE_MARGIN = 900_000
cte(
    "live",
    f"""select trace_id, first(session_id order by start_ts_ms, span_id) as session_id, min(start_ts_ms) as start_ts_ms,
    max(end_ts_ms) as end_ts_ms, cast(count(*) as integer) as step_count,
    cast(count(*) filter (span_kind = 'REASON') as integer) as llm_call_count,
    cast(count(*) filter (span_kind = 'TOOL') as integer) as tool_call_count,
    cast(count(*) filter (span_kind = 'RETRIEVE') as integer) as retrieve_count,
    min(start_ts_ms) - {LIVE_MARGIN} as lo, max(end_ts_ms) + {LIVE_MARGIN} as hi from steps group by trace_id""",
    "steps",
)
GPU_FOLD = """count(*) as gpu_n, sum(contention_index) as contention_sum, max(contention_index) as contention_max,
sum(temperature_c) as temperature_sum, max(temperature_c) as temperature_max, sum(memory_used_pct) as memory_sum,
sum(power_draw_pct) as power_sum, count(*) filter (throttle_active <> 0) as throttled,
min({s: timestamp_ms, gpu_id: gpu_id}) as first_gpu"""
NET_FOLD = """count(*) as net_n, count(*) filter (inter_node_latency_us > 0) as latency_n,
sum(inter_node_latency_us) filter (inter_node_latency_us > 0) as latency_sum,
max(inter_node_latency_us) filter (inter_node_latency_us > 0) as latency_max,
sum(packet_drop_count) as drops, sum(tcp_retransmit_count) as retransmits"""
BUSY = "row_number() over (partition by trace_id order by contention_sum / gpu_n desc, node_id) as rn"
cte(
    "live_node",
    f"""select * exclude (rn) from (select *, {BUSY} from (select l.trace_id, g.node_id, {GPU_FOLD} from live l
    join gpu g on g.timestamp_ms between l.lo and l.hi group by all)) where rn = 1""",
    "live", "gpu",
)
cte(
    "live_last",
    f"""select * exclude (rn, trace_id) from (select *, {BUSY} from (select 1 as trace_id, node_id, {GPU_FOLD} from (select *
    from gpu order by timestamp_ms desc, node_id, gpu_id limit 2) group by all)) where rn = 1""",
    "gpu",
)
cte(
    "live_placed",
    """select l.*, n.* exclude (trace_id) from live l join live_node n using (trace_id) union all
    select l.*, f.* from live l, live_last f where l.trace_id not in (select trace_id from live_node)""",
    "live", "live_node", "live_last",
)
cte(
    "live_net",
    f"""select p.trace_id, {NET_FOLD} from live_placed p join net n on n.node_id = p.node_id
    and n.timestamp_ms between p.lo and p.hi group by all""",
    "live_placed", "net",
)
cte(
    "live_net_last",
    f"""select node_id, {NET_FOLD} from (select *, row_number() over (partition by node_id order by timestamp_ms desc) as rn
    from net) where rn <= 2 group by all""",
    "net",
)
cte(
    "live_wide",
    """select p.*, case when a.net_n is null then b.latency_n else a.latency_n end as latency_n,
    case when a.net_n is null then b.latency_sum else a.latency_sum end as latency_sum,
    case when a.net_n is null then b.latency_max else a.latency_max end as latency_max,
    case when a.net_n is null then b.drops else a.drops end as drops,
    case when a.net_n is null then b.retransmits else a.retransmits end as retransmits
    from live_placed p left join live_net a on a.trace_id = p.trace_id left join live_net_last b on b.node_id = p.node_id""",
    "live_placed", "live_net", "live_net_last",
)
oracle(
    "live_correlation",
    "live_wide",
    f"""select trace_id, session_id, start_ts_ms, end_ts_ms,
    case when start_ts_ms <> 0 and end_ts_ms <> 0 then cast(end_ts_ms - start_ts_ms as double) else 0e0 end as total_duration_ms,
    '' as trajectory_signature, '' as step_sequence, step_count, llm_call_count, tool_call_count, retrieve_count,
    0 as retry_count, {', '.join(f'0e0 as quality_{d}' for d in DIMS)}, '' as quality_explanation, {signals(1)},
    0e0 as queue_wait_avg, 0e0 as queue_wait_max, 'ollama-' || node_id as primary_pod_id, node_id as primary_node_id,
    first_gpu.gpu_id as primary_gpu_id, {INGESTED} from live_wide""",
)
oracle(
    "uncorrelated_traces",
    "steps quality",
    "select distinct trace_id from steps where trace_id not in (select trace_id from quality where overall > 0)",
)

# --- windows, alerts, mutations ---

oracle("drift_windows", "windows", "select * from windows")
oracle(
    "signature_distribution",
    "wdist",
    f"select window_size, window_start_ms, sig as signature, n, {rnd('p', 6)} as probability from wdist",
)
oracle(
    "verdict_table",
    "base",
    """select quality_drop, drift, gpu, net, count(*) as n, case
    when quality_drop = 1 and drift = 1 then case when gpu = 1 then 'gpu_induced_degradation'
      when net = 1 then 'network_induced_degradation' else 'app_layer_degradation' end
    when drift = 1 then 'trajectory_drift_no_quality_impact' when quality_drop = 1 then 'quality_drop_stable_trajectory'
    else 'normal' end as verdict from (select k % 2 as quality_drop, k // 2 % 2 as drift, k // 4 % 2 as gpu, k // 8 % 2 as net
    from base) group by quality_drop, drift, gpu, net""",
)
oracle(
    "alerts",
    "windows",
    """select window_size, window_start_ms, correlation_flag, correlation_details from windows
    where correlation_flag <> 'normal'""",
)
oracle(
    "alert_counts",
    "windows",
    "select correlation_flag, count(*) as alerts from windows where correlation_flag <> 'normal' group by 1",
)
oracle(
    "first_alerts",
    "windows",
    """select window_size, window_start_ms, correlation_flag from windows where correlation_flag <> 'normal'
    order by window_start_ms, window_size limit 5""",
)
cte(
    "paths",
    """select trajectory_signature as signature, count(*) as count, count(*) filter (quality_overall < 3.0) as bad,
    avg(quality_overall) as q, avg(quality_hallucination) as h, avg(step_count) as steps, avg(llm_call_count) as calls,
    avg(tool_call_count) as tools, avg(retry_count) as retries, avg(gpu_contention_avg) as gpu,
    first(step_sequence order by start_ts_ms, trace_id) as step_sequence from correlated group by 1""",
    "correlated",
)
cte(
    "dominant",
    "select * from paths order by case when (count - bad) > count / 2 then 0 else 1 end, count desc, signature limit 1",
    "paths",
)
cte("totals", "select count(*) as total, count(*) filter (quality_overall < 3.0) as bad from correlated", "correlated")
cte(
    "mutated",
    f"""select p.signature, cast(p.signature = d.signature as integer) as is_dominant, p.count,
    {rnd('p.count / t.total', 4)} as share, {rnd('p.bad / p.count', 4)} as bad_rate,
    case when t.bad = 0 then 0e0 else {rnd('(p.bad / p.count) / (t.bad / t.total)', 3)} end as lift, {rnd('p.q', 3)} as avg_quality,
    {rnd('p.h', 3)} as avg_hallucination, {rnd('p.steps', 2)} as avg_step_count, {rnd('p.calls', 2)} as avg_llm_calls,
    {rnd('p.tools', 2)} as avg_tool_calls, {rnd('p.retries', 2)} as avg_retry_count, {rnd('p.gpu', 4)} as avg_gpu_contention,
    {rnd('p.steps - d.steps', 2)} as step_delta_vs_dominant, {rnd('p.calls - d.calls', 2)} as llm_delta_vs_dominant,
    p.step_sequence from paths p, dominant d, totals t""",
    "paths", "dominant", "totals",
)
cte(
    "explained",
    f"""select *, cast(lift > 1 as integer) as is_harmful, concat_ws(', ',
    case when step_delta_vs_dominant < 0 then printf('%.0f', {rnd('abs(step_delta_vs_dominant)', 0)})
      || ' fewer steps (truncated reasoning)' end,
    case when llm_delta_vs_dominant < 0 then printf('%.0f', {rnd('abs(llm_delta_vs_dominant)', 0)}) || ' fewer LLM calls' end,
    case when avg_retry_count > 0.5 then printf('%.1f', {rnd('avg_retry_count', 1)}) || ' avg retries (fallback churn)' end)
    as why from mutated""",
    "mutated",
)
oracle("path_mutations", "explained", "select * from explained")
oracle(
    "mutation_summary",
    "mutated totals dominant",
    f"""select total as total_traces, {rnd('bad / total', 4)} as global_bad_rate,
    (select signature from dominant) as dominant_signature, (select count(*) from mutated where lift > 1) as harmful_count
    from totals""",
)
oracle(
    "worst_mutation",
    "explained",
    """select signature, bad_rate, count, lift, why from explained where is_harmful = 1 and is_dominant = 0
    order by bad_rate desc, count desc, signature limit 1""",
)
oracle(
    "drift_story",
    "windows",
    """select window_size, window_start_ms, (window_start_ms - min(window_start_ms) over s) // 1000 as relative_s, trace_count,
    unique_signatures, dominant_share, trajectory_entropy, trajectory_drift_jsd,
    case when is_baseline = 1 then 'baseline' when trajectory_drift_jsd >= 0.15 then 'DRIFT' else '' end as mark,
    first_value(dominant_share) over o as first_share, last_value(dominant_share) over o as last_share,
    first_value(trajectory_entropy) over o as first_entropy, last_value(trajectory_entropy) over o as last_entropy,
    max(trajectory_drift_jsd) over s as peak_jsd from windows
    window s as (partition by window_size), o as (partition by window_size order by window_start_ms
      rows between unbounded preceding and unbounded following)""",
)
oracle(
    "cooccurrence_story",
    "windows",
    """select window_size, g as gpu_induced_windows, window_start_ms as strongest_window_start_ms,
    contention_quality_corr as strongest_corr, gpu_contention_avg from (select *,
    count(*) filter (correlation_flag = 'gpu_induced_degradation') over (partition by window_size) as g,
    row_number() over (partition by window_size order by contention_quality_corr, window_start_ms) as rn from windows)
    where rn = 1""",
)
oracle(
    "quality_summary",
    "quality",
    " union all ".join(
        f"select '{d}' as dimension, {rnd(f'avg({d})', 3)} as avg, min({d}) as min, max({d}) as max from quality"
        for d in DIMS
    ),
)
oracle("quality_series", "quality", "select trace_id, overall, explanation, start_ts_ms from quality")
BADGE = "case when {0} > 0.7e0 then 'DEGRADED' when {0} > 0.4e0 then 'WARNING' else 'HEALTHY' end"
oracle(
    "dashboard_numbers",
    "correlated",
    f"""select count(*) as traces, count(distinct trajectory_signature) as templates, {rnd('avg(quality_overall)', 2)} as avg_quality,
    {rnd('avg(gpu_contention_avg)', 3)} as avg_contention, {BADGE.format('avg(gpu_contention_avg)')} as badge from correlated""",
)
oracle(
    "highest_contention",
    "correlated",
    """select trace_id, quality_overall, gpu_contention_avg, step_count from correlated
    order by gpu_contention_avg desc, trace_id limit 3""",
)
SUMMARY_SQL = "'" + SUMMARY_PROMPT.replace("'", "''").replace("%s", "' || context || '") + "'"


def _fleet(listed: str) -> str:
    return f"""select n as total_traces, {rnd('q', 3)} as avg_quality, {rnd('c', 4)} as avg_contention, {rnd('h', 3)} as avg_hallucination,
    u as unique_templates, a as alert_count, context, {SUMMARY_SQL} as prompt, summary from (select *, 'Traces analyzed: ' || n || chr(10) || 'Average quality: ' || {fmt('q', 2)} || '/5'
    || chr(10) || 'Average hallucination score: ' || {fmt('h', 2)} || '/5' || chr(10) || 'Average GPU contention: ' || {fmt('c', 3)}
    || chr(10) || 'Unique trajectory templates: ' || u || chr(10) {listed}
    || 'Correlation alerts: ' || a || chr(10) || 'Kinds of alerts: ' || kinds || chr(10)
    || 'Traces under the highest GPU contention:' || busiest as context,
    'Analytics summary (auto-generated): ' || n || ' traces analyzed. Avg quality: ' || {fmt('q', 2)} || '/5. Avg GPU contention: '
    || {fmt('c', 3)} || '. ' || a || ' correlation alerts detected.' as summary
    from (select count(*) as n, avg(quality_overall) as q, avg(gpu_contention_avg) as c, avg(quality_hallucination) as h,
    (select count(distinct trajectory_signature) from traj) as u,
    (select count(*) from windows where correlation_flag <> 'normal') as a,
    (select '{{' || coalesce(string_agg('"' || s || '": ' || c, ', ' order by c desc, s), '') || '}}' from (
      select trajectory_signature as s, count(*) as c from traj group by 1)) as dist,
    (select '{{' || coalesce(string_agg('"' || f || '": "' || d || '"', ', ' order by rn), '') || '}}' from (
      select correlation_flag as f, min(rn) as rn, last(correlation_details order by rn) as d from (select *,
      row_number() over (order by window_start_ms, window_size) as rn from windows where correlation_flag <> 'normal')
      where rn <= 5 group by 1)) as kinds,
    (select string_agg(chr(10) || '  - trace ' || trace_id[1:12] || ': quality=' || {fmt('quality_overall', 1)} || ', gpu_contention='
      || {fmt('gpu_contention_avg', 3)} || ', steps=' || step_count, '' order by gpu_contention_avg desc, trace_id) from (
      select * from correlated order by gpu_contention_avg desc, trace_id limit 3)) as busiest from correlated))"""


oracle("fleet_summary", "correlated windows traj", _fleet("|| 'Traces per template: ' || dist || chr(10)"))
oracle("fleet_numbers", "correlated windows traj", _fleet(""))

oracle(
    "trajectory_report",
    "steps traj",
    """select s.trace_id, span_id, span_kind, s.start_ts_ms, trajectory_signature, step_count from steps s
    left join traj t on t.trace_id = s.trace_id where s.trace_id = (select min(trace_id) from traj)""",
)
oracle(
    "quality_report",
    "quality traj",
    "select trace_id, overall, start_ts_ms from quality where trace_id = (select min(trace_id) from traj)",
)
oracle("correlated_report", "correlated", "select * exclude (ingestion_date, ingestion_hour) from correlated")
oracle("window_report", "windows", "select * from windows where window_size = '1h'")
oracle(
    "gpu_report_one_device",
    "gpu",
    """select timestamp_ms, node_id, gpu_id, contention_index from (select *, row_number() over (order by timestamp_ms, node_id,
    gpu_id) as rn from gpu where gpu_id = 'gpu-0') where (rn - 1) % 2 = 0""",
)

# --- operational metrics ---

cte(
    "measured",
    """select *, case shape when 'entry' then 'ENTRY' when 'agent' then 'AGENT' when 'reason' then 'REASON'
      when 'rpc' then 'TOOL' when 'http' then 'TOOL' when 'plan' then 'PLAN' else 'RETRIEVE' end as kind,
    'm' || (k % 3) as model, 'agent' || (k % 5) as agent, 'col' || (k % 4) as collection,
    case when shape = 'rpc' then 'tool' || (k % 5) else 'http://t/' || (k % 5) end as tool, status_code <> 'ERROR' as success,
    duration_ns / 1000000000e0 as seconds, start_time_unix_nano // 1000000 as start_ms, end_time_unix_nano // 1000000 as end_ms
    from spans where k % 10 <> 1""",
    "spans",
)
CALLS = "count(*) as calls, count(*) filter (not success) as errors, {} as seconds"
SECONDS = "sum(duration_ns) / 1000000000e0"
oracle(
    "model_calls",
    "measured",
    f"""select model, agent, {CALLS.format(SECONDS)}, cast(sum(k * 10) as bigint) as input_tokens,
    cast(sum(case when k % 7 = 0 then 0 else k * 3 end) as bigint) as output_tokens from measured where kind = 'REASON' group by all""",
)
oracle(
    "retrieval_calls",
    "measured",
    f"""select collection, {CALLS.format(SECONDS)}, cast(sum(k % 6) as bigint) as documents from measured
    where kind = 'RETRIEVE' group by all""",
)
oracle("tool_calls", "measured", f"select tool, success, {CALLS.format(SECONDS)} from measured where kind = 'TOOL' group by all")
oracle("workflows", "measured", f"select status_code, {CALLS.format(SECONDS)} from measured where kind = 'ENTRY' group by all")
oracle(
    "retry_attempts",
    "measured",
    """select operation_name, k % 3 as attempt, count(*) as count from measured where shape = 'reason' and k % 3 > 0
    group by all""",
)
oracle(
    "agent_handoffs",
    "measured",
    """select p.agent as from_agent, c.agent as to_agent, count(*) as handoffs from measured c join measured p
    on p.trace_id = c.trace_id and p.span_id = c.parent_span_id where c.kind = 'AGENT' and p.kind = 'AGENT' group by all""",
)
cte(
    "changes",
    """select at_ms, cast(sum(d) as bigint) as change from (select start_ms as at_ms, 1 as d from measured where kind = 'AGENT'
    union all select end_ms, -1 from measured where kind = 'AGENT') group by 1 having sum(d) <> 0""",
    "measured",
)
oracle("active_agents", "changes", "select *, cast(sum(change) over (order by at_ms) as bigint) as active from changes")
oracle(
    "duration_histogram",
    "measured",
    """select kind, case when seconds <= 0.1e0 then 0.1e0 when seconds <= 0.5e0 then 0.5e0 when seconds <= 1e0 then 1e0
    when seconds <= 5e0 then 5e0 when seconds <= 10e0 then 10e0 when seconds <= 30e0 then 30e0 end as seconds_up_to,
    count(*) as count from measured group by all""",
)
SECONDS_UP_TO = """case when seconds <= 0.1e0 then 0.1e0 when seconds <= 0.5e0 then 0.5e0 when seconds <= 1e0 then 1e0
when seconds <= 5e0 then 5e0 when seconds <= 10e0 then 10e0 when seconds <= 30e0 then 30e0 end as seconds_up_to"""
HOUR = "start_ms // 3600000 * 3600000 as hour_ms"
for metric, step_kind, dimensions in (
    ("model", "REASON", "model, agent"),
    ("retrieval", "RETRIEVE", "collection"),
    ("tool", "TOOL", "tool, success"),
    ("workflow", "ENTRY", "status_code"),
):
    oracle(
        f"{metric}_duration_histogram",
        "measured",
        f"select {dimensions}, {HOUR}, {SECONDS_UP_TO}, count(*) as count from measured where kind = '{step_kind}' group by all",
    )
oracle(
    "retrieved_documents_histogram",
    "measured",
    f"""select collection, {HOUR}, cast(case when k % 6 <= 1 then k % 6 when k % 6 <= 3 then 3 else 5 end as integer)
    as documents_up_to, count(*) as count from measured where kind = 'RETRIEVE' group by all""",
)
oracle(
    "errors_by_type",
    "measured",
    f"""select kind, case when kind = 'REASON' then model else 'unknown' end as model, case when kind in ('AGENT', 'REASON')
    then agent else 'default' end as agent, split_part(status_message, ' ', 1) as error_type, {HOUR}, count(*) as errors
    from measured where not success group by all""",
)
oracle(
    "latency_percentiles",
    "spans",
    f"""select service_name, count(*) as requests, {rnd("count(*) filter (status_code <> 'ERROR') / count(*) * 100", 1)} as success_pct,
    {rnd("sum(duration_ns) filter (status_code <> 'ERROR') / count(*) filter (status_code <> 'ERROR') / 1000000000e0", 2)} as mean_s, v[cast(floor(len(v) * 0.5e0) as bigint) + 1] as p50,
    v[cast(floor(len(v) * 0.95e0) as bigint) + 1] as p95, v[cast(floor(len(v) * 0.99e0) as bigint) + 1] as p99
    from (select *, duration_ns / 1000000000e0 as s, list(case when status_code <> 'ERROR' then duration_ns / 1000000000e0 end)
      over (partition by service_name) as l, list_sort(list_filter(l, lambda x: x is not null)) as v from spans) group by service_name, v""",
)

# --- sessions and retrieval ---

cte(
    "messages",
    """select cast(conv_id as varchar) as session_id, cast(turn as integer) as turn_number, role, text as content,
    lpad(cast(conv_id % 7 * 100 + turn as varchar), 8, '0') as timestamp from conversations""",
)
oracle(
    "session_rollup",
    "messages",
    """select session_id, substr(coalesce(first(content order by turn_number, timestamp) filter (role = 'user'), ''), 1, 50) as title,
    min(timestamp) as created_at, max(timestamp) as updated_at, max(turn_number) as total_turns, count(*) as messages,
    coalesce(last(case when turn_number % 2 = 0 then 'active' else 'ended' end order by timestamp) filter (role = 'assistant'),
      'active') as status from messages group by session_id""",
)
oracle(
    "recent_sessions",
    "messages",
    """select session_id, max(timestamp) as updated_at from messages group by 1 order by 2 desc, 1 limit 20""",
)
oracle("session_history", "messages", "select session_id, turn_number, role, content from messages")
cte(
    "params",
    """select session_id, turn_number, 'role' as name, role as value from messages union all
    select session_id, turn_number, 'word' || (turn_number % 3), case when length(content) % 2 = 0
      then cast(length(content) as varchar) else '' end from messages""",
    "messages",
)
oracle(
    "session_context",
    "params",
    """select session_id, '{' || string_agg('"' || name || '":"' || value || '"', ',' order by name) || '}' as params from (
    select session_id, name, last(value order by turn_number, value) as value from params where value <> '' group by all)
    group by session_id""",
)
ORACLES["nearest_vectors"] = f"""with v as (select vec_id, label, cast(embedding as double[]) as e from embeddings)
select query_id, id, label, {rnd('d', 5)} as distance from (select *, row_number() over (partition by query_id order by d, id) as rn
from (select q.vec_id as query_id, v.vec_id as id, v.label, 1 - list_dot_product(q.e, v.e)
  / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)) as d from v q, v)) where rn <= 3"""

ORACLES["nearest_messages"] = f"""with m as (select conv_id * 1000 + turn as id, role, text from conversations),
words as (select id, cast('0x' || substr(md5(w), 1, 2) as integer) % 64 as dim from (
  select id, unnest(regexp_split_to_array(trim(lower(text)), '\\s+')) as w from m) where w <> ''),
v as (select id, any_value(role) as role, list_transform(range(64), lambda d: cast(len(list_filter(l, lambda x: x = d)) as double))
  as e from (select m.id, m.role, list(words.dim) filter (words.dim is not null) as l from m left join words on words.id = m.id
  group by all) group by id, l)
select query_id, id, {rnd('d', 5)} as distance from (select *, row_number() over (partition by query_id order by d, id) as rn
from (select q.id as query_id, v.id, round(1 - coalesce(list_dot_product(q.e, v.e)
  / nullif(sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 0e0), 0e0), 9) as d
  from v q, v where q.role = 'user' and v.role = 'assistant')) where rn <= 3"""

# --- upsert and streams ---

ORACLES["upsert_current"] = """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (
partition by o_custkey order by o_orderkey % 100 desc, o_orderkey desc) as rn from orders) where rn = 1"""
ORACLES["upsert_roundtrip"] = """select l_partkey, l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (
partition by l_partkey order by l_orderkey % 3 desc, l_orderkey desc, l_linenumber desc, l_quantity desc) as rn from lineitem)
where rn = 1"""
oracle(
    "table_setup",
    "spans",
    f"""select unnest({list(TABLES)}) as table_name, true as created, false as created_again,
    case when table_name = 'trace_delta_table' then (select count(*) from (select distinct trace_id, span_id from spans)) else 0 end
    as row_count""",
)
oracle(
    "replaced_traces",
    "spans",
    """select trace_id, span_id from (select trace_id, span_id, v, max(v) over (partition by trace_id) as m from (
    select *, case status_code when 'ERROR' then 2 when 'OK' then 1 else 0 end as v from spans)) where v = m""",
)
oracle(
    "stream_signature_counts",
    "traj",
    """select start_ts_ms // 3600000 * 3600000 as window_start_ms, start_ts_ms // 3600000 * 3600000 + 3600000 as window_end_ms,
    trajectory_signature as signature, count(*) as n from traj where start_ts_ms > 0 group by all""",
)


def _streamed(names: str, select: str) -> str:
    """A statement over the decodable messages only and with the rule judge's scores."""
    original = dict(CTES)
    CTES["spans"] = (("keyed",), f"{original['spans'][1]} where k <> {b.BROKEN_MESSAGE_K}")
    CTES["correlated"] = (("traj", "judged", "pods", "gpu_side", "net_side"), correlated_sql("judged"))
    statement = using(names, select)
    CTES.update(original)
    return statement


ORACLES["stream_backfill"] = _streamed("windows", "select * from windows")
ORACLES["stream_in_batches"] = _streamed("correlated", "select * exclude (ingestion_date, ingestion_hour) from correlated")
ORACLES["stream_late_samples"] = ORACLES["stream_in_batches"]
ORACLES["stream_late_windows"] = ORACLES["stream_backfill"]
ORACLES["stream_timed"] = ORACLES["stream_in_batches"]
oracle(
    "rejected_spans",
    "spans",
    f"select span_id, operation_name, start_time_unix_nano from spans where k <> {b.BROKEN_MESSAGE_K} and {b.NAMELESS}",
)
LANDED = f"""with landed as (select *, start_ts_ms // 3600000 * 3600000 as w, {b.LANDED_PART} as part from traj where start_ts_ms > 0),
per_part as (select part, max(start_ts_ms) as latest from landed group by part),
marked as (select *, (select max(latest) from per_part p where p.part < landed.part) - 600000 as mark from landed)"""
oracle(
    "stream_closed_windows",
    "traj",
    f"""select * from ({LANDED} select w as window_start_ms, w + 3600000 as window_end_ms, trajectory_signature as signature, count(*) as n from marked
    where (mark is null or w + 3600000 > mark) and w + 3600000 <= (select max(latest) - 600000 from per_part) group by all)""",
)
oracle(
    "stream_late_rows",
    "traj",
    f"select * from ({LANDED} select w as window_start_ms, count(*) as late from marked where w + 3600000 <= mark group by all)",
)
ORACLES["nearest_vectors_by_pivots"] = ORACLES["nearest_vectors"]
ORACLES["latency_from_sketch"] = ORACLES["latency_percentiles"]
