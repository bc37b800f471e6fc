"""The analysis as batch jobs: every table is written once to the shared folder and read by the jobs after it.

Written tables cut the lineage: plans stay small, a lost executor costs tasks of one job only, and several queries of
a session share the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import correlate, infra, mutations, ops_metrics, retrieval, steps, trajectory, windows
from spanloom.options import CorrelationOptions
from spanloom.plans import bindings as b
from spanloom.session import shared_folder

# The test events are minutes apart, so calls look further for samples than in production.
SPARSE = CorrelationOptions(tolerance_ms=600_000, live_margin_ms=900_000, tile_ms=300_000)
# A fixed ingestion time keeps results repeatable.
INGESTED_MS = 1_704_164_645_000

_written: dict[tuple[str, str, str], str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_folder(spark)}/run-{uuid4().hex}"


def forget_tables() -> None:
    """Let the next query write its tables anew (for timing)."""
    _written.clear()


class Inputs:
    """The analysis tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _written:
            path = f"{scratch(self.spark)}/{name}"
            build().write.parquet(path)
            _written[key] = path
        return self.spark.read.parquet(_written[key])

    def kept(self, prefix: str) -> Callable[[str, DataFrame], DataFrame]:
        """Writes the intermediate tables of an operator."""
        return lambda name, rows: self._table(f"{prefix}_{name}", lambda: rows)

    def folder(self, name: str, build: Callable[[str], None]) -> str:
        """A folder of several tables that a chain of jobs writes, built once."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _written:
            path = scratch(self.spark)
            build(path)
            _written[key] = path
        return _written[key]

    def table(self, name: str) -> DataFrame:
        return b.table(self.spark, self.sf_dir, name)

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def dealt_events(self) -> DataFrame:
        """Events dealt by id: spans and messages land as many files, while the test table is one row group."""
        return self.events.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "event_id")

    @property
    def landed_messages(self) -> DataFrame:
        return self._table("landed_messages", lambda: b.otlp_messages(self.dealt_events))

    @property
    def spans(self) -> DataFrame:
        return b.spans(self.dealt_events)

    @property
    def steps(self) -> DataFrame:
        return self._table("agent_steps", lambda: steps.agent_steps(self.spans, F.lit(INGESTED_MS)))

    @property
    def trajectories(self) -> DataFrame:
        return self._table(
            "trajectory_templates", lambda: trajectory.trajectories(self.steps, F.lit(INGESTED_MS))
        )

    @property
    def quality(self) -> DataFrame:
        return b.quality_scores(self.events)

    @property
    def gpu(self) -> DataFrame:
        return b.gpu_samples(self.table("events"))

    @property
    def network(self) -> DataFrame:
        return b.network_samples(self.table("events"))

    @property
    def landed_samples(self) -> tuple[DataFrame, DataFrame]:
        """GPU and network samples, read from the dealt events: they land as many files, written by many tasks."""
        return b.gpu_samples(self.dealt_events), b.network_samples(self.dealt_events)

    @property
    def routing(self) -> DataFrame:
        return self._table("request_routing", lambda: infra.route_calls(self.steps, self.gpu, F.lit(INGESTED_MS)))

    @property
    def calls(self) -> DataFrame:
        return correlate.timed_calls(self.trajectories, self.routing)

    @property
    def correlated(self) -> DataFrame:
        return self._table(
            "trace_correlated",
            lambda: correlate.correlate(
                self.trajectories, self.quality, self.routing, self.gpu, self.network, F.lit(INGESTED_MS), SPARSE
            ),
        )

    @property
    def templates(self) -> DataFrame:
        return self._table("template_counts", lambda: trajectory.template_counts(self.trajectories))

    @property
    def paths(self) -> DataFrame:
        return self._table("path_outcomes", lambda: mutations.path_outcomes(self.correlated))

    @property
    def signature_windows(self) -> DataFrame:
        return self._table("signature_windows", lambda: windows.signature_windows(self.correlated))

    @property
    def windows(self) -> DataFrame:
        return self._table("analytics_windows", lambda: windows.drift_of(self.signature_windows))

    @property
    def measured(self) -> DataFrame:
        return ops_metrics.measured_spans(self.spans)

    @property
    def latency_sketch(self) -> DataFrame:
        return self._table("latency_sketch", lambda: ops_metrics.latency_sketch(self.spans, ["service_name"]))

    @property
    def messages(self) -> DataFrame:
        return b.messages(self.table("conversations"))

    @property
    def embedded_messages(self) -> DataFrame:
        """Messages embedded once; searches read the vectors from the table, however often they need them."""
        key = (F.col("session_id").cast("bigint") * 1000 + F.col("turn_number")).alias("id")
        messages = self.messages.select(key, "role", "content")
        return self._table(
            "embedded_messages", lambda: retrieval.embed(messages, "content", retrieval.hashing_embedder()).drop("content")
        )
