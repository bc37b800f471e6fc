import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from spanloom import schemas  # noqa: E402
from spanloom.session import local_session  # noqa: E402
from times import T  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def column(spark):
    """Evaluate one column function over literal rows."""

    def run(fn, ddl, rows):
        df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i INT, {ddl}")
        out = df.select("i", fn(*[df[c] for c in df.columns[1:]]).alias("out")).orderBy("i").collect()
        return [row["out"] for row in out]

    return run


@pytest.fixture()
def make(spark):
    """A table of the named schema from dicts; missing columns are null."""

    def run(ddl, rows):
        names = [f.name for f in spark.createDataFrame([], ddl).schema.fields]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)

    return run


@pytest.fixture()
def step(make):
    """Agent steps from (trace, span, kind, offset seconds) with overrides."""

    def one(trace, span, kind, at_s, **extra):
        return {
            "trace_id": trace, "session_id": "s", "span_id": span, "parent_span_id": "", "span_kind": kind,
            "sub_span_kind": "x", "start_ts_ms": T + int(at_s * 1000), "end_ts_ms": T + int(at_s * 1000) + 1000,
            "duration_ms": 1000.0, "ingestion_date": "2024-01-01", "ingestion_hour": 0, **extra,
        }

    def run(*rows):
        return make(schemas.AGENT_STEPS, [one(*r[:4], **(r[4] if len(r) > 4 else {})) for r in rows])

    return run
