"""Scores of selective classifiers and of paired conditions. Two families, which differ by design.

``score`` has the unsafe golds RETIRE and RETRACT below false KEEPs, counts coverage over decidable golds and leaves a
rate without a denominator null. ``condition_metrics`` has all golds other than KEEP there, counts coverage over all
golds and calls such a rate 0. Nothing is rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import divide, percent, wilson
from .decisions import DECIDABLE, LABELS


def count_if(x: Column) -> Column:
    return F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("long")


def _counts() -> dict[str, Column]:
    gold, pred, act = F.col("gold_label"), F.col("predicted_label"), ~F.col("abstain")
    out = {
        "n": F.count("*"),
        "abstentions": count_if(~act),
        "invalid_or_failed": count_if(F.col("status") != "success"),
        "unsafe": count_if(gold.isin("RETIRE", "RETRACT")),
        "false_keep": count_if(gold.isin("RETIRE", "RETRACT") & act & (pred == "KEEP")),
        "decidable": count_if(gold.isin(*DECIDABLE)),
        "actions": count_if(gold.isin(*DECIDABLE) & act),
        "wrong_actions": count_if(gold.isin(*DECIDABLE) & act & (pred != gold)),
        "keeps": count_if(gold == "KEEP"),
        "keep_correct": count_if((gold == "KEEP") & act & (pred == "KEEP")),
        "wrongful_removal": count_if((gold == "KEEP") & act & pred.isin("RETIRE", "RETRACT")),
        "retract_predicted": count_if(act & (pred == "RETRACT")),
        "retract_correct": count_if(act & (pred == "RETRACT") & (gold == "RETRACT")),
        "retracts": count_if(gold == "RETRACT"),
        "gold_unsure": count_if(gold == "UNSURE"),
        "unsure_withheld": count_if((gold == "UNSURE") & (~act | (pred == "UNSURE"))),
        "confident_on_unsure": count_if((gold == "UNSURE") & act & pred.isin(*DECIDABLE) & (F.col("confidence") >= 0.7)),
        "latencies": F.count("latency_ms"),
        "latency_sum": F.coalesce(F.sum("latency_ms"), F.lit(0.0)),
        "estimated_cost_usd": F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)),
    }
    for x in LABELS:
        out[f"tp_{x}"] = count_if(act & (gold == x) & (pred == x))
        out[f"fp_{x}"] = count_if(act & (gold != x) & (pred == x))
        out[f"fn_{x}"] = count_if((gold == x) & (~act | (pred != x)))
    return out


def _rates(df: DataFrame) -> DataFrame:
    rates = {
        "false_keep_rate": ("false_keep", "unsafe"), "decision_coverage": ("actions", "decidable"), "selective_risk": ("wrong_actions", "actions"),
        "keep_recall": ("keep_correct", "keeps"), "wrongful_removal_rate": ("wrongful_removal", "keeps"), "retraction_precision": ("retract_correct", "retract_predicted"),
        "retraction_recall": ("retract_correct", "retracts"), "unsure_withheld_rate": ("unsure_withheld", "gold_unsure"), "confident_on_unsure_rate": ("confident_on_unsure", "gold_unsure"),
        "mean_latency_ms": ("latency_sum", "latencies"),
    }
    out = df.withColumns({k: divide(a, b) for k, (a, b) in rates.items()})
    low, high = wilson("false_keep", "unsafe")
    per = {}
    for x in LABELS:
        tp, fp, fn = (F.col(f"{k}_{x}") for k in ("tp", "fp", "fn"))
        per |= {f"precision_{x}": divide(tp, tp + fp), f"recall_{x}": divide(tp, tp + fn), f"f1_{x}": divide(2 * tp, 2 * tp + fp + fn)}
    out = out.withColumns({"false_keep_low": low, "false_keep_high": high, **per})
    present = F.array_compact(F.array(*(F.col(f"f1_{x}") for x in LABELS)))
    return out.withColumn("macro_f1", F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)))


def score(df: DataFrame, *by: str) -> DataFrame:
    """The selective-classification scores of claim rows (gold_label, predicted_label, abstain, confidence, status,
    latency_ms, estimated_cost_usd), for each group."""
    return _rates((df.groupBy(*by) if by else df).agg(*(c.alias(k) for k, c in _counts().items())))


def evaluate(df: DataFrame, method: str = "method", family: str = "problem_family_id", problem: str = "problem_id") -> DataFrame:
    """Scores of each method overall, by family and by problem, in one pass over grouping sets. ``level`` tells which."""
    f, p = F.col(family), F.col(problem)
    sets = df.groupingSets([[F.col(method)], [F.col(method), f], [F.col(method), p]], F.col(method), f, p)
    level = F.when(F.grouping(family) == 0, "family").when(F.grouping(problem) == 0, "problem").otherwise("overall")
    return _rates(sets.agg(level.alias("level"), *(c.alias(k) for k, c in _counts().items())))


def integrity(df: DataFrame, constant: tuple[str, ...] = ("gold_label", "trajectory_id", "participant_id_hash", "problem_id", "problem_family_id")) -> DataFrame:
    """One row a check: keys unique, all methods with the same claims, each claim's attributes constant."""
    keys = df.groupBy("claim_id", "method").count().agg(F.coalesce(F.max("count"), F.lit(1)).alias("x")).select(F.lit("unique_claim_method").alias("check"), (F.col("x") == 1).alias("passed"))
    methods = df.agg(F.countDistinct("method").alias("m"))
    sets = df.groupBy("claim_id").agg(F.countDistinct("method").alias("k")).join(F.broadcast(methods)).agg(F.coalesce(F.min(F.col("k") == F.col("m")), F.lit(True)).alias("passed")).select(F.lit("identical_claim_sets").alias("check"), "passed")
    same = df.groupBy("claim_id").agg(*(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))).alias(c) for c in constant))
    worst = same.agg(*(F.coalesce(F.max(c) <= 1, F.lit(True)).alias(c) for c in constant))
    rows = F.array(*(F.struct(F.lit(f"constant_{c}").alias("check"), F.col(c).alias("passed")) for c in constant))
    return keys.unionByName(sets).unionByName(worst.select(F.inline(rows)))


def paired_false_keep(df: DataFrame, first: str = "B", second: str = "C") -> DataFrame:
    """The 2x2 table of false KEEPs of two methods over the claims with gold RETIRE or RETRACT, without a join."""
    wrong = ~F.col("abstain") & (F.col("predicted_label") == "KEEP")
    per = df.filter(F.col("gold_label").isin("RETIRE", "RETRACT") & F.col("method").isin(first, second)).groupBy("claim_id").agg(
        F.bool_or(F.when(F.col("method") == first, wrong)).alias("b"), F.bool_or(F.when(F.col("method") == second, wrong)).alias("c")
    )
    per = per.filter("b is not null and c is not null")
    b, c = F.col("b"), F.col("c")
    return per.agg(F.count("*").alias("eligible"), count_if(b & ~c).alias("B_only_error"), count_if(~b & c).alias("C_only_error"), count_if(b & c).alias("both_error"), count_if(~b & ~c).alias("neither_error"))


def condition_metrics(gold: DataFrame, predictions: DataFrame, *by: str, key: str = "item_id") -> DataFrame:
    """Scores of each condition (``by``) against all golds. ``predictions``: key, label, abstain; ``gold``: key, gold."""
    totals = gold.agg(F.count("*").alias("gold_total"), count_if(F.col("gold") == "KEEP").alias("gold_keep"), count_if(F.col("gold") == "RETRACT").alias("gold_retract"))
    act, g, p = ~F.coalesce(F.col("abstain"), F.lit(False)), F.col("gold"), F.col("label")
    rows = predictions.join(gold, key)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("usable"), count_if(act).alias("decisions"), count_if(act & (p == g)).alias("correct"), count_if(act & (p == "KEEP") & (g != "KEEP")).alias("false_keep"),
        count_if(act & (p == "KEEP") & (g == "KEEP")).alias("keep_tp"), count_if(act & p.isin("RETIRE", "RETRACT") & (g == "KEEP")).alias("wrongful_removal"),
        count_if(act & (p == "RETRACT") & (g == "RETRACT")).alias("retract_tp"), count_if(act & (p == "RETRACT")).alias("retract_predicted"),
    ).join(F.broadcast(totals))
    return out.withColumns({
        "abstentions": F.col("usable") - F.col("decisions"),
        "accuracy_percent": percent("correct", "decisions"), "availability_percent": percent("usable", "gold_total"), "coverage_percent": percent("decisions", "gold_total"),
        "risk_percent": percent(F.col("decisions") - F.col("correct"), "decisions"), "false_keep_percent": percent("false_keep", F.col("gold_total") - F.col("gold_keep")),
        "keep_recall_percent": percent("keep_tp", "gold_keep"), "retract_precision_percent": percent("retract_tp", "retract_predicted"), "retract_recall_percent": percent("retract_tp", "gold_retract"),
        "retract_f1_percent": percent(2 * F.col("retract_tp"), F.col("retract_predicted") + F.col("gold_retract")),
    })


def paired_metrics(gold: DataFrame, predictions: DataFrame, *by: str, key: str = "item_id", condition: str = "condition", problem: str = "problem_id") -> DataFrame:
    """Conditions B and C on the items that both decide: 2x2 table, difference in points, errors, and who is right
    alone. One aggregation by item brings both sides together."""
    own = predictions.filter(~F.coalesce(F.col("abstain"), F.lit(False)))
    per = own.groupBy(*by, key).agg(F.max(F.when(F.col(condition) == "B", F.col("label"))).alias("b"), F.max(F.when(F.col(condition) == "C", F.col("label"))).alias("c"))
    rows = per.filter("b is not null and c is not null").join(gold.select(key, "gold", problem), key)
    g, b, c = F.col("gold"), F.col("b"), F.col("c")
    sides = {}
    for n, x in (("b", b), ("c", c)):
        sides |= {
            f"{n}_correct": count_if(x == g), f"{n}_false_keep": count_if((x == "KEEP") & (g != "KEEP")), f"{n}_keep_tp": count_if((x == "KEEP") & (g == "KEEP")),
            f"{n}_wrongful_removal": count_if(x.isin("RETIRE", "RETRACT") & (g == "KEEP")), f"{n}_retract_tp": count_if((x == "RETRACT") & (g == "RETRACT")),
        }
    alone_b, alone_c = (b == g) & (c != g), (b != g) & (c == g)
    ids = lambda x, y: F.array_sort(F.collect_set(F.when(x, F.col(y))))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("paired"), *(v.alias(k) for k, v in sides.items()),
        count_if((b == g) & (c == g)).alias("both_correct"), count_if(alone_b).alias("b_only_correct"), count_if(alone_c).alias("c_only_correct"), count_if((b != g) & (c != g)).alias("both_wrong"),
        count_if(b == c).alias("label_agreement"), count_if(g == "KEEP").alias("gold_keep"), count_if(g != "KEEP").alias("gold_non_keep"), count_if(g == "RETRACT").alias("gold_retract"),
        ids(alone_b, problem).alias("b_only_problems"), ids(alone_c, problem).alias("c_only_problems"),
    )
    return out.withColumns({"b_accuracy_percent": percent("b_correct", "paired"), "c_accuracy_percent": percent("c_correct", "paired"), "c_minus_b_points": percent(F.col("c_correct") - F.col("b_correct"), "paired")})


def pooled(paired: DataFrame, counts: list[str]) -> DataFrame:
    """Counts of all models together, and the pooled difference."""
    out = paired.agg(*(F.sum(c).cast("long").alias(c) for c in counts))
    return out.withColumn("c_minus_b_points", percent(F.col("c_correct") - F.col("b_correct"), "paired"))
