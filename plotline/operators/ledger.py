"""The call ledger: A2, A6-A8, A11 spend, A12, J7, J8, G45."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import vocab
from plotline.functions.figures import cost_display
from plotline.operators import scans
from plotline.operators.filters import first_in
from plotline.operators.joins import last_before


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def summary(calls: DataFrame) -> DataFrame:
    """A2: the whole ledger; hidden reasoning is left out of these totals."""
    spent = zero("input_tokens") + zero("output_tokens")
    return calls.groupBy("purpose").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(zero("input_tokens")).alias("input_tokens"),
        F.sum(zero("output_tokens")).alias("output_tokens"), F.sum(spent).alias("total_tokens"))


def priced(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """The cost of each call; null where the model has no rate."""
    cost = (zero("input_tokens") * F.col("input_rate")
            + (zero("output_tokens") + zero("reasoning_tokens")) * F.col("output_rate"))
    return calls.join(rates, "model_id", "left").withColumn("cost", cost)


def cost_by_model(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Tokens are summed per model before any price is joined."""
    totals = calls.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.sum(zero(c)).alias(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens")])
    return priced(totals, rates).drop("input_rate", "output_rate")


def _micros(c: str) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', "
                  f"CAST({c} AS TIMESTAMP_NTZ))")


def answered_by(calls: DataFrame, questions: DataFrame, key: str,
                hot_rows: int | None = None) -> DataFrame:
    """The first question logged within two minutes after each query call.

    The first question at or after a call is an as-of lookup, done by one ordered
    scan over both sides (time negated), so no call is paired with more than one
    question. The two minutes are checked on what was found.
    """
    made = calls.select("call_id", F.col(key).alias("_key"), (-_micros("created_at")).alias("_at"))
    asked = questions.select(F.col(key).alias("_key"), (-_micros("asked_at")).alias("_at"),
                             F.struct((-_micros("asked_at")).alias("at"), "question").alias("mark"))
    found = last_before(made, asked, ["_key"], "_at", "call_id", "mark", hot_rows)
    wait = F.col("_at") - F.col("mark.at")
    return found.filter(wait <= vocab.QUESTION_WINDOW_SECONDS * 1000000).select(
        "call_id", F.col("mark.question").alias("question"))


def holding(spans: DataFrame, points: DataFrame, key: str, span_id: str,
            hot_rows: int | None = None) -> DataFrame:
    """Spans (key, first, last) that hold at least one point (key, started_at).

    Spans of one key do not overlap, so a point can only lie in the last span
    that starts at or before it: an as-of lookup, not a range join.
    """
    marks = spans.select(F.col(key).alias("_key"), _micros("first").alias("_at"),
                         F.struct(F.col(span_id).alias("id"), _micros("last").alias("last")).alias("mark"))
    rows = points.select(F.col(key).alias("_key"), _micros("started_at").alias("_at"),
                         F.lit(1).alias("_point"))
    found = last_before(rows, marks, ["_key"], "_at", "_point", "mark", hot_rows)
    hit = found.filter(F.col("_at") <= F.col("mark.last")).select(F.col("mark.id").alias(span_id))
    return spans.join(hit.distinct(), span_id, "left_semi")


def kind_of_action() -> Column:
    """Which burst a call may join, or null for one it may not."""
    free = F.col("change_set_id").isNull()
    return (F.when((F.col("purpose") == "extract") & free, "build")
            .when(F.col("purpose").isin("agent", "draft"), "agent")
            .when(free & (F.col("purpose") != "query"), "preview"))


def in_actions(calls: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Every call with the key of the user action it belongs to."""
    marked = calls.withColumn("kind", kind_of_action())
    loose = marked.filter("kind IS NOT NULL")
    joined = scans.bursts(loose, ["kind", "script_id"], "created_at", "call_id",
                          vocab.BURST_GAP_SECONDS, "burst_start", hot_rows)
    joined = joined.withColumn("action_key", F.concat_ws(
        "|", "kind", F.coalesce(F.col("script_id").cast("string"), F.lit("-")), "burst_start"))
    lone = marked.filter("kind IS NULL").withColumn(
        "burst_start", F.lit(None).cast(marked.schema["created_at"].dataType))
    lone = lone.withColumn("action_key", F.coalesce(
        F.concat(F.lit("preview|"), "change_set_id"), F.concat(F.lit("ask|"), "call_id")))
    lone = lone.withColumn("kind", F.when(F.col("change_set_id").isNotNull(), "preview")
                           .otherwise("ask"))
    return joined.unionByName(lone)


def actions(calls: DataFrame, rates: DataFrame, answers: DataFrame | None = None,
            forced_runs: DataFrame | None = None, hot_rows: int | None = None) -> DataFrame:
    """The ledger by user action.

    Counts, sums and extremes combine before the shuffle, so one action holding
    very many calls is no single task's input; the sets hold distinct scene
    numbers and models only.
    """
    tokens = zero("input_tokens") + zero("output_tokens") + zero("reasoning_tokens")
    rows = priced(in_actions(calls, hot_rows), rates)
    groups = rows.groupBy("action_key", "kind").agg(
        F.any_value("script_id").alias("script_id"), F.count(F.lit(1)).alias("call_count"),
        F.sum(tokens).alias("tokens"), F.sum("cost").alias("cost_usd"),
        F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.min("call_id").alias("first_call"),
        F.array_sort(F.collect_set(F.col("scene_number").cast("string"))).alias("scenes"),
        F.array_join(F.array_sort(F.collect_set("model_id")), ", ").alias("model"))
    label = (F.when(F.col("kind") == "build", "Graph build").when(F.col("kind") == "agent", "Ask")
             .when(F.col("kind") == "ask", "Ask the graph").otherwise("Preview"))
    groups = groups.withColumn("action", label)
    if forced_runs is not None:
        rebuilt = (holding(groups.filter("kind = 'build'").select("action_key", "script_id", "first",
                                                                  "last"),
                           forced_runs, "script_id", "action_key", hot_rows)
                   .select("action_key", F.lit("Graph rebuild").alias("_renamed")).distinct())
        groups = groups.join(rebuilt, "action_key", "left").withColumn(
            "action", F.coalesce("_renamed", "action")).drop("_renamed")
    listed = F.when(F.size("scenes") == 0, F.lit("")).when(
        F.size("scenes") <= 4, F.concat(F.lit("Scene "), F.array_join("scenes", ", "))
    ).otherwise(F.concat("call_count", F.lit(" scenes read")))
    if answers is not None:
        asked = answers.select(F.concat(F.lit("ask|"), "call_id").alias("action_key"), "question")
        groups = groups.join(asked, "action_key", "left")
        listed = F.coalesce(F.nullif("question", F.lit("")), listed)
    return groups.withColumn("detail", listed).withColumn("cost", cost_display(F.col("cost_usd")))


def variance(calls: DataFrame, window: int = 5) -> DataFrame:
    """The spread of a scene's last reads; needs two real ones."""
    reads = calls.filter((F.col("purpose") == "extract") & (F.col("outcome") != "cached")
                         & F.col("read_count").isNotNull())
    recent = first_in(reads, ["script_id", "scene_id"],
                      [F.col("created_at").desc(), F.col("call_id").desc()], window)
    return (recent.groupBy("script_id", "scene_id")
            .agg(F.count(F.lit(1)).alias("reads"),
                 (F.max("read_count") - F.min("read_count")).alias("spread"))
            .filter("reads >= 2"))


def variance_alerts(calls: DataFrame, threshold: int = vocab.VARIANCE_THRESHOLD, window: int = 5) -> DataFrame:
    """The scenes whose recent reads differ by more than ``threshold``, widest first."""
    return variance(calls, window).filter(F.col("spread") > threshold).orderBy(
        F.col("spread").desc(), "script_id", "scene_id")


def budget_gate(calls: DataFrame, cap: int, hot_rows: int | None = None) -> DataFrame:
    """Calls made once the recorded tokens reach the cap are refused.

    A refused call records no tokens, so the first crossing refuses every later
    call, and the running total of all calls decides the same rows. The ledger
    is one key, which the scan cuts into blocks of bounded rows.
    """
    spent = zero("input_tokens") + zero("output_tokens")
    total = scans.running_sum(calls.withColumn("_all", F.col("call_id") * 0), ["_all"],
                              [F.col("created_at"), F.col("call_id")], spent, "spent_before", hot_rows)
    return total.drop("_all").withColumn("refused", F.col("spent_before") >= cap)
