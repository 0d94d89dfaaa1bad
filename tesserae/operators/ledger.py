"""Prices, reservations and what is left of a budget."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.rules import MODEL_RATES, PRICE_CARDS, cents
from tesserae.operators.folds import kind, streamed
from tesserae.operators.prefix import last_before, prefix_sums, sliced


def price_cards(spark, overrides: DataFrame | None = None) -> DataFrame:
    """(job_kind, connector, cents), overridden where an override names the pair."""
    cards = spark.createDataFrame([(k, c, v) for (k, c), v in PRICE_CARDS.items()], "job_kind string, connector string, cents long")
    if overrides is None:
        return cards
    return cards.join(overrides.withColumnRenamed("cents", "_own"), ["job_kind", "connector"], "left").withColumn("cents", F.coalesce("_own", "cents")).drop("_own")


def priced(jobs: DataFrame, cards: DataFrame) -> DataFrame:
    """jobs with est_cents: the card of the connector, else of *, else null (no price, so no call)."""
    own = cards.where("connector <> '*'").withColumnRenamed("cents", "_own")
    other = cards.where("connector = '*'").select("job_kind", F.col("cents").alias("_other"))
    return jobs.join(F.broadcast(own), ["job_kind", "connector"], "left").join(F.broadcast(other), "job_kind", "left").withColumn("est_cents", F.coalesce("_own", "_other")).drop("_own", "_other")


def exposure(reservations: DataFrame, project: str, est: str, actual: str) -> DataFrame:
    """Per project: settled cents, cents still reserved, and their sum."""
    return reservations.groupBy(project).agg(
        F.coalesce(F.sum(actual), F.lit(0)).alias("settled_cents"), F.coalesce(F.sum(F.when(F.col(actual).isNull(), F.col(est))), F.lit(0)).alias("reserved_cents"),
    ).withColumn("exposure_cents", F.col("settled_cents") + F.col("reserved_cents"))


def settled(reserves: DataFrame, settlements: DataFrame, ref: str) -> DataFrame:
    """reserves with actual_cents of the first settlement of each ref that is within its reserve, and `overspent`: whether one
    was refused for being over it. A refused one settles nothing, so the reserve stands; those without a reserve are left out."""
    from tesserae.operators.pick import first_by

    met = settlements.select(F.col(ref).alias("_ref"), "pos", "actual_cents").join(reserves.select(ref, "est_cents"), F.col("_ref") == F.col(ref)).drop(ref)
    met = met.withColumn("_over", F.coalesce(F.col("actual_cents") > F.col("est_cents"), F.lit(False)))
    once = first_by(met.where("NOT _over"), ["_ref"], [F.col("pos")]).select("_ref", "actual_cents")
    over = met.where("_over").select(F.col("_ref").alias("_over_ref")).distinct()
    out = reserves.join(once, F.col(ref) == F.col("_ref"), "left").join(over, F.col(ref) == F.col("_over_ref"), "left")
    return out.withColumn("overspent", F.col("_over_ref").isNotNull()).drop("_ref", "_over_ref")


def reserve_fold(calls: DataFrame, project: str, ref: str, at: str, est: str, ceiling: int) -> DataFrame:
    """(project, ref, outcome): calls in order reserve while the sum stays within the ceiling. A ref that is
    reserved already is skipped, a call without a price has none, one that a guard blocked is blocked, one over the
    ceiling is refused; none of these reserves anything. `blocked`, where calls have it, is the guard's decision.

    Calls are streamed; what a project's stream holds is the refs that it has reserved at a cost, each of which is a part of the
    ceiling. Calls that cost nothing are reserved without being held: whether one comes first of its ref is told beforehand.
    """
    guarded = F.col("blocked") if "blocked" in calls.columns else F.lit(False)
    rows = calls.select(project, F.col(at).alias("_at"), F.col(ref).cast("string").alias(ref), F.col(est).cast("long").alias("_est"), F.coalesce(guarded, F.lit(False)).alias("_blocked"))
    free = rows.where("_est = 0 AND NOT _blocked").groupBy(F.col(project).alias("_project"), F.col(ref).alias("_ref")).agg(F.min("_at").alias("_free"))
    rows = rows.join(free, F.col(project).eqNullSafe(F.col("_project")) & F.col(ref).eqNullSafe(F.col("_ref")), "left")
    rows = rows.withColumn("_freed", F.coalesce(F.col("_free") < F.col("_at"), F.lit(False))).drop("_project", "_ref", "_free")

    def fold(k, given):
        total, reserved, last = 0, set(), None  # last: the latest ref that cost nothing, and its time
        for _, now, r, cost, blocked, freed in given:
            if freed or r in reserved or last == (now, r):
                outcome = "skip"
            elif blocked:
                outcome = "blocked"
            elif cost is None:
                outcome = "unpriced"
            elif total + cost > ceiling:
                outcome = "refused"
            else:
                outcome, total = "ok", total + cost
                if cost:
                    reserved.add(r)
                else:
                    last = now, r
            yield k, r, outcome

    return streamed(rows, project, ["_at", ref, "_est"], ["_blocked", "_freed"], f"{project} {kind(calls, project)}, {ref} string, outcome string", fold)


def running_costs(calls: DataFrame, key: str, order: list[str], cost: str, checkpoint: Column) -> DataFrame:
    """calls with `running` (the sum so far) and, at checkpoints, `drained`: what came since the checkpoint before. A key's calls
    may be most of all: they are summed in slices."""
    rows = prefix_sums(sliced(calls.withColumn("_mark", checkpoint), [key], order), [key], order, {"running": F.col(cost)})
    out = last_before(rows, [key], order, "_before", F.when(F.col("_mark"), F.col("running")))
    return out.withColumn("drained", F.when(F.col("_mark"), F.col("running") - F.coalesce("_before", F.lit(0)))).select(*calls.columns, "running", "drained")


def rate_table(spark) -> DataFrame:
    """(model, rate_in, rate_out): dollars for a million tokens."""
    return spark.createDataFrame([(m, i, o) for m, (i, o) in MODEL_RATES.items()], "model string, rate_in double, rate_out double")


def rated(calls: DataFrame, rates: DataFrame, model: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """calls with actual_cents by the rates of their model; a model without a rate is an error when the rows are read."""
    met = calls.join(F.broadcast(rates.withColumnRenamed("model", "_model")), F.col(model) == F.col("_model"), "left")
    missing = F.raise_error(F.concat(F.lit("no rate for model "), F.coalesce(F.col(model), F.lit("null")))).cast("long")
    return met.withColumn("actual_cents", F.when(F.col("_model").isNull(), missing).otherwise(cents(F.col(tokens_in), F.col(tokens_out), F.col("rate_in"), F.col("rate_out")))).drop("_model", "rate_in", "rate_out")


def settled_with_retries(attempts: DataFrame, ref: str, attempt: str, ok: str, most: int = 3) -> DataFrame:
    """(ref, attempts, settled): attempts in order up to the first that succeeds, `most` at the most."""
    used = attempts.where(F.col(attempt) < most)
    first = used.groupBy(ref).agg(F.min(F.when(F.col(ok), F.col(attempt))).alias("_ok"), F.count("*").alias("_n"))
    return first.select(ref, F.coalesce(F.col("_ok") + 1, F.col("_n")).alias("attempts"), F.col("_ok").isNotNull().alias("settled"))
