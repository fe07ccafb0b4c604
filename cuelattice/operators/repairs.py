"""What to do about a task's diagnostics, and which of its items fit a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The rules whose failure means that a fact is missing, and what may need more thought.
FACTS, THOUGHT, CATEGORIES = ("number.", "entity."), "translation.boundary", ("ownership", "fluency")
#: How a plan comes out, by precedence, and why.
CANCELLED, NOTHING, SPENT, PLANNED = "cancelled", "no_diagnostics", "budget_exhausted", "planned"
REASONS = {CANCELLED: ["task_cancelled"], NOTHING: ["no_diagnostics"], SPENT: ["total_attempt_budget_exhausted"]}
STRATEGIES = {
    "local_rewrite": ["source_fact_missing", "local_context_only"],
    "deterministic": ["all_diagnostics_deterministic"],
    "retry": ["hard_invariant_failed", "preserve_legacy_retry_policy"],
}
RISKY, SPOKEN = "confirmed_high_risk_window", "dialogue_context_is_read_only"


def same_keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]


def as_keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def evidence(diagnostics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key's diagnostics: rules by first mention, cues in order, and whether they are facts, need thought, are all deterministic."""
    rule = F.coalesce("rule", F.lit(""))
    fact = rule.startswith(FACTS[0]) | rule.startswith(FACTS[1])
    thought = rule.startswith(THOUGHT) | F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))
    by_rule = diagnostics.groupBy(*as_keys(keys), rule.alias("_rule")).agg(
        F.min("seq").alias("_seq"), F.bool_or(fact).alias("_fact"), F.bool_or(thought).alias("_thought"),
        F.bool_and(F.coalesce(F.col("strategy") == "deterministic", F.lit(False))).alias("_plain"),
    )
    named = [f"_key_{i}" for i in range(len(keys))]
    rules = by_rule.groupBy(*named).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_seq", "_rule"))), lambda x: x["_rule"]).alias("_rules"),
        F.bool_or("_fact").alias("_fact"), F.bool_or("_thought").alias("_thought"), F.bool_and("_plain").alias("_plain"),
    )
    cues = diagnostics.select(*as_keys(keys), F.explode("cues").alias("_cue")).where("_cue IS NOT NULL").distinct()
    cues = cues.groupBy(*named).agg(F.array_sort(F.collect_list("_cue")).alias("_cues")).select(*[F.col(n).alias(f"_of{n}") for n in named], "_cues")
    return rules.join(cues, [F.col(n).eqNullSafe(F.col(f"_of{n}")) for n in named], "left").drop(*[f"_of{n}" for n in named])


def repair_plans(tasks: DataFrame, diagnostics: DataFrame, keys: Sequence[str], most_attempts: int = 3, most_reasoning: int = 1) -> DataFrame:
    """A plan for each row of ``tasks`` (keys, attempts, reasoning_attempts, reasoning, dialogue, cancelled), by its ``diagnostics``
    (keys, seq, rule, category, strategy, cues).

    Cancelled tasks come first, then those without diagnostics, then those without attempts left; of the rest, missing facts are
    rewritten, what is deterministic throughout is repaired so, and all else is tried once more. Where thought may help, the provider
    (``reasoning``) has it and its attempts aren't used up, two cues around are shown with it. Null counts are 0, null ``reasoning``
    and ``cancelled`` false, null ``dialogue`` unknown; a null rule is an empty one, a null strategy isn't deterministic. Rules of
    equal ``seq`` go by name. Diagnostics without a task are left out.
    """
    both = tasks.join(evidence(diagnostics, keys), same_keys(keys), "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    left = F.greatest(F.lit(0), F.lit(most_attempts) - count("attempts"))
    none = F.col("_rules").isNull()
    disposition = F.when(F.coalesce("cancelled", F.lit(False)), CANCELLED).when(none, NOTHING).when(left == 0, SPENT).otherwise(PLANNED)
    both = both.withColumns({
        "disposition": disposition, "strategy": F.when(disposition != PLANNED, "none").when(F.col("_fact"), "local_rewrite").when(F.col("_plain"), "deterministic").otherwise("retry"),
        "reasoned": (disposition == PLANNED) & F.col("_thought") & F.coalesce("reasoning", F.lit(False)) & (count("reasoning_attempts") < most_reasoning),
        "session": F.when(F.col("dialogue"), "dialogue").when(~F.col("dialogue"), "monologue").otherwise("unknown"),
    })
    planned = F.col("disposition") == PLANNED
    reasons = F.coalesce(*[F.when(F.col("disposition") == d, strings(r)) for d, r in REASONS.items()], *[F.when(F.col("strategy") == s, strings(r)) for s, r in STRATEGIES.items()])
    some = lambda c, type_: F.coalesce(F.col(c), F.array().cast(type_))
    return both.select(
        *keys, "disposition", "strategy", some("_cues", "array<long>").alias("affected"),
        F.greatest(F.when(F.col("strategy") == "local_rewrite", 1).otherwise(0), F.when(F.col("reasoned"), 2).otherwise(0)).alias("context_radius"),
        F.when(F.col("reasoned"), "enabled").otherwise("disabled").alias("reasoning_mode"), F.when(planned, F.least(left, F.lit(1))).otherwise(0).cast("int").alias("maximum_attempts"),
        some("_rules", "array<string>").alias("rules"), F.col("session").alias("session_mode"),
        F.concat(reasons, F.when(F.col("reasoned"), strings([RISKY])).otherwise(strings([])), F.when(planned & (F.col("session") == "dialogue"), strings([SPOKEN])).otherwise(strings([]))).alias("rationale"),
    )


def plan_counts(plans: DataFrame) -> DataFrame:
    """(kind, value, plans): how often plans have each disposition, session mode and rule, and those carried out each strategy and reasoning mode."""
    planned = F.col("disposition") == PLANNED
    named = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    facts = F.concat(
        F.array(named("disposition", F.col("disposition")), named("session_mode", F.col("session_mode"))),
        F.when(planned, F.array(named("strategy", F.col("strategy")), named("reasoning_mode", F.col("reasoning_mode")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")),
        F.transform("rules", lambda r: named("rule", r)),
    )
    return plans.select(F.inline(facts)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("plans"))


def within_budget(items: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, most: int, budget: int) -> DataFrame:
    """The first items of each key that fit: ``most`` of them at most (one at least), and ``budget`` in size with a mark between two.

    Items larger than the budget are passed over until one fits; after that the first that doesn't ends the list. A null size is 0. Of a
    key, each task sends on its first ``most`` items only, so a busy key is no more than that.
    """
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    first = items.where(n <= budget).groupBy(*as_keys(keys)).agg(F.min(F.struct(*order)).alias("_first"))
    rest = items.join(first, same_keys(keys)).where(F.struct(*order) >= F.col("_first"))
    w = Window.partitionBy(*keys).orderBy(*order)
    few = rest.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= max(most, 1))
    used = F.sum(n + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    return few.withColumn("_used", used).where(F.col("_used") <= budget).select(*items.columns)
