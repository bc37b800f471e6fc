import pytest

from spanloom.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
CORE = ("agent_steps", "trajectories", "template_distribution", "gpu_around_calls", "correlated_traces", "drift_windows",
        "path_mutations", "live_correlation", "incident_labels", "latency_percentiles", "network_rates", "upsert_current")


@pytest.mark.parametrize("name", CORE)
def test_no_cross_join_and_no_row_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan


def test_flatten_needs_no_shuffle_and_parses_once(spark):
    plan = QUERIES["otlp_flatten"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("from_json(") == 1


def test_classification_parses_tags_once(spark):
    from spanloom import schemas
    from spanloom.operators.steps import classified

    spans = spark.createDataFrame([], schemas.SPANS)
    plan = classified(spans)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") <= 1 and "Exchange" not in plan


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_pass_over_the_traces(spark, tmp_path):
    """Windows, paths and templates read their input once and shuffle it only after partial aggregation."""
    from spanloom import schemas
    from spanloom.operators import mutations, trajectory, windows

    for ddl, build in (
        (schemas.CORRELATED, windows.signature_windows),
        (schemas.CORRELATED, mutations.path_outcomes),
        (schemas.TRAJECTORIES, trajectory.template_counts),
    ):
        path = f"{tmp_path}/{build.__name__}"
        spark.createDataFrame([], ddl).write.parquet(path)
        plan = _plan(build(spark.read.parquet(path)))
        assert plan.count("FileScan") == 1 and plan.index("partial_") > 0
        assert plan.count("Exchange hashpartitioning") <= 2 and "Window" not in plan


def test_steps_and_correlation_without_cross_join(spark, tmp_path):
    from spanloom import schemas
    from spanloom.operators import correlate, steps

    def empty(name, ddl):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame([], ddl).write.parquet(path)
        return spark.read.parquet(path)

    plans = [
        _plan(steps.agent_steps(empty("spans", schemas.SPANS))),
        _plan(
            correlate.correlate(
                empty("paths", schemas.TRAJECTORIES), empty("quality", schemas.QUALITY), empty("routing", schemas.ROUTING),
                empty("gpu", schemas.GPU_METRICS), empty("network", schemas.NETWORK_METRICS),
            )
        ),
    ]
    for plan in plans:
        for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert operator not in plan


def test_views_of_logs_aggregate_keys_only_and_leave_out_dates(spark, tmp_path):
    from spanloom import schemas
    from spanloom.operators.infra import with_ingestion_parts
    from spanloom.sources import changelog
    from spanloom.streaming import jobs

    chain = jobs.Pipeline(folder=str(tmp_path), trigger=None)
    day = 86_400_000
    for batch_id in (0, 1):
        times = [(d * day + k, f"n{k}", "g") for d in range(4) for k in range(5)]
        rows = spark.createDataFrame(times, "timestamp_ms BIGINT, node_id STRING, gpu_id STRING")
        full = spark.createDataFrame([], schemas.GPU_METRICS).unionByName(with_ingestion_parts(rows), allowMissingColumns=True)
        jobs._write(full, chain, "gpu_metrics", batch_id)
    folders = sorted(str(p.relative_to(tmp_path)) for p in (tmp_path / "gpu_metrics").glob("*/*") if p.is_dir())
    assert folders == [f"gpu_metrics/batch_id={b}/ingestion_date=1970-01-0{d}" for b in (0, 1) for d in range(1, 5)]
    paths = spark.createDataFrame([("t", 2 * day + 1000, 2 * day + 2000)], "trace_id STRING, start_ts_ms BIGINT, end_ts_ms BIGINT")
    near = jobs.samples_near(spark, chain, "gpu_metrics", paths)
    assert near.columns == spark.createDataFrame([], schemas.GPU_METRICS).columns
    assert [r["node_id"] for r in near.orderBy("node_id").collect()] == [f"n{k}" for k in range(5)]
    plan = _plan(near)
    assert "SortAggregate" not in plan and plan.count("FileScan") == plan.count("PartitionFilters: [isnotnull(ingestion_date")


def test_logs_are_cut_to_the_traces_before_they_are_shuffled(spark, tmp_path):
    from spanloom import schemas
    from spanloom.streaming import jobs

    chain = jobs.Pipeline(folder=str(tmp_path), trigger=None)
    traces = spark.createDataFrame([("t",)], "trace_id STRING")
    for table in ("agent_steps", "trajectory_templates", "quality_scores", "request_routing"):
        jobs._write(spark.createDataFrame([], schemas.TABLES[table][0]), chain, table, 0)
        plan = _plan(jobs.current(spark, chain, table, traces))
        assert plan.count("LeftSemi") == 3 and "SortAggregate" not in plan
