"""Judging: the context of each trace, a pluggable judge, and the resulting scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import judge as j
from spanloom.functions.timeparts import ingestion_date, ingestion_hour, now_ms
from spanloom.operators.ordered import ordered_lines, step_slice
from spanloom.operators.trajectory import step_order
from spanloom.options import STEPS, StepOptions
from spanloom.session import ship_package

# Made once per partition: returns the function that answers one batch of prompts.
JudgeFactory = Callable[[], Callable[[list[str]], list[str]]]


def judge_contexts(steps: DataFrame, options: StepOptions = STEPS) -> DataFrame:
    """Request, ordered reasoning, ordered evidence and final answer per trace (slices first, as for paths)."""
    order = step_order()
    kind, empty = F.col("span_kind"), F.lit("")
    line = F.struct(
        order.alias("at"),
        j.reasoning_line(kind, F.col("model"), F.col("prompt"), F.col("agent_name")).alias("reasoning"),
        j.evidence_line(
            kind, F.col("collection"), F.col("query_text"), F.col("rpc_method"), F.col("url"), F.col("response")
        ).alias("evidence"),
    )
    has_line = kind.isin("REASON", "AGENT", "RETRIEVE", "TOOL")
    request = F.coalesce(F.nullif(F.col("prompt"), empty), F.nullif(F.col("context"), empty), empty)
    answered = (kind == "REASON") & (F.coalesce(F.col("response"), empty) != "")
    zero = F.lit(0).cast("bigint")
    pieces = (
        steps.groupBy("trace_id", step_slice(F.col("start_ts_ms"), F.col("span_id"), options.path_slice_ms).alias("at"))
        .agg(
            F.array_sort(F.collect_list(F.when(has_line, line))).alias("lines"),
            F.max(F.when(kind == "ENTRY", F.struct(order.alias("at"), request.alias("text")))).alias("request"),
            F.max(F.when(answered, F.struct(order.alias("at"), F.col("response").alias("text")))).alias("answer"),
            F.min(F.struct(order.alias("at"), F.coalesce("session_id", empty).alias("session_id"))).alias("first"),
            F.min(F.nullif(F.col("start_ts_ms"), zero)).alias("start_ts_ms"),
            F.max(F.nullif(F.col("end_ts_ms"), zero)).alias("end_ts_ms"),
        )
        .withColumn(
            "piece",
            F.struct(
                "at",
                F.nullif(ordered_lines(F.col("lines"), "reasoning", "\n"), empty).alias("reasoning"),
                F.nullif(ordered_lines(F.col("lines"), "evidence", "\n"), empty).alias("evidence"),
            ),
        )
        .drop("lines")
    )
    traces = pieces.groupBy("trace_id").agg(
        F.array_sort(F.collect_list("piece")).alias("pieces"),
        F.max("request").alias("request"),
        F.max("answer").alias("answer"),
        F.min("first").alias("first"),
        F.coalesce(F.min("start_ts_ms"), zero).alias("start_ts_ms"),
        F.coalesce(F.max("end_ts_ms"), zero).alias("end_ts_ms"),
    )

    def text(value: Column, placeholder: str) -> Column:
        return F.coalesce(F.nullif(value, empty), F.lit(placeholder))

    return traces.select(
        "trace_id",
        F.col("first.session_id").alias("session_id"),
        text(F.col("request.text"), j.NO_REQUEST).alias("user_request"),
        text(ordered_lines(F.col("pieces"), "reasoning", "\n"), j.NO_REASONING).alias("reasoning_chain"),
        text(ordered_lines(F.col("pieces"), "evidence", "\n"), j.NO_EVIDENCE).alias("evidence"),
        text(F.col("answer.text"), j.NO_RESPONSE).alias("final_response"),
        "start_ts_ms",
        "end_ts_ms",
    )


def with_prompts(contexts: DataFrame, template: str = j.PROMPT_TEMPLATE) -> DataFrame:
    return contexts.withColumn("prompt", j.prompt_text(template))


def ask(df: DataFrame, judge: JudgeFactory, prompt: str = "prompt", reply: str = "reply") -> DataFrame:
    """Adds the judge's reply to each prompt. The judge is made once per partition and sees Arrow batches.

    If the judge raises on a batch, its prompts are asked one by one; one that fails alone has a null reply, which is scored
    as an error row.
    """

    def alone(answer: Callable[[list[str]], list[str]], text: str) -> str | None:
        try:
            return answer([text])[0]
        except Exception:  # any judge failure becomes an error row, as an unreadable reply does
            return None

    def replies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = judge()
        for prompts in batches:
            texts = prompts.tolist()
            try:
                found = answer(texts)
            except Exception:
                found = [alone(answer, text) for text in texts]
            yield pd.Series(found, dtype="object")

    ship_package(df.sparkSession)
    return df.withColumn(reply, F.pandas_udf(replies, "string")(F.col(prompt)))


def score_replies(judged: DataFrame, eval_model: str, evaluated_ms: Column | None = None) -> DataFrame:
    """Replies -> quality scores (15 columns)."""
    evaluated_ms = now_ms() if evaluated_ms is None else evaluated_ms
    return judged.withColumn("_s", j.parse_scores(F.coalesce("reply", F.lit("")))).select(
        "trace_id",
        "session_id",
        "_s.*",
        F.lit(eval_model).alias("eval_model"),
        evaluated_ms.cast("bigint").alias("eval_timestamp_ms"),
        "start_ts_ms",
        "end_ts_ms",
        ingestion_date(evaluated_ms).alias("ingestion_date"),
        ingestion_hour(evaluated_ms).alias("ingestion_hour"),
    )


def evaluate(steps: DataFrame, judge: JudgeFactory, eval_model: str, evaluated_ms: Column | None = None) -> DataFrame:
    return score_replies(ask(with_prompts(judge_contexts(steps)), judge), eval_model, evaluated_ms)


def rule_judge() -> Callable[[list[str]], list[str]]:
    """Deterministic stand-in for a model: full marks for each part of the context that is present."""

    def one(prompt: str) -> str:
        found = {
            "completeness": 4 if f"FINAL RESPONSE: {j.NO_RESPONSE}" not in prompt else 1,
            "coherence": 4 if f"REASONING CHAIN: {j.NO_REASONING}" not in prompt else 2,
            "groundedness": 5 if f"EVIDENCE: {j.NO_EVIDENCE}" not in prompt else 2,
            "relevance": 4 if f"USER REQUEST: {j.NO_REQUEST}" not in prompt else 3,
        }
        found["hallucination"] = found["groundedness"]
        found["overall"] = (found["completeness"] + found["groundedness"]) / 2
        body = ", ".join(f'"{k}": {v}' for k, v in found.items())
        return "```json\n{" + body + "}\n```"

    return lambda prompts: [one(p) for p in prompts]
