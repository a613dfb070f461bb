"""Joins that carry checks with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pseudonym


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, name: str, missing=None) -> DataFrame:
    """Adds ``value`` of the table's row with the key; ``missing`` where there is none. The optimiser broadcasts the
    table where its size allows."""
    side = table.select(F.col(table_key).alias("_k"), F.col(value).alias("_v")).dropDuplicates(["_k"])
    out = df.join(side, F.col(key) == F.col("_k"), "left")
    return out.withColumn(name, F.col("_v") if missing is None else F.coalesce("_v", F.lit(missing))).drop("_k", "_v")


def with_next_attempt(manifest: DataFrame, submissions: DataFrame, key: str = "submission_id") -> DataFrame:
    """Manifest rows with their submission and the same trajectory's next attempt; ``found`` and ``next_found`` tell
    what is missing."""
    own = submissions.select(key, "user_id", "problem_id", "attempt", "code", F.lit(True).alias("_a"))
    nxt = submissions.select("user_id", "problem_id", (F.col("attempt") - 1).alias("attempt"), F.col(key).alias("next_id"), F.col("code").alias("next_code"), F.lit(True).alias("_b"))
    out = manifest.join(own, key, "left").join(nxt, ["user_id", "problem_id", "attempt"], "left")
    return out.withColumns({"found": F.coalesce("_a", F.lit(False)), "next_found": F.coalesce("_b", F.lit(False))}).drop("_a", "_b")


def manifest_problems(manifest: DataFrame, submissions: DataFrame, problems: DataFrame, languages: list[str], key: str = "submission_id") -> DataFrame:
    """(item, problem) of each row of a manifest (item, ``key``, attempt, problem_id, participant_id_hash) that does not fit the submissions
    it was drawn from, one row a reason; no rows if all fit.

    The selected submission must be there once, with the attempt, the problem and the participant that the manifest states; the
    next attempt of its trajectory must be there once; both must be of ``languages``; and the problem must be known. Repeats are counted by
    key before the joins, so neither a repeated submission nor a repeated attempt multiplies rows.
    """
    fields = ("user_id", "problem_id", "attempt", "language")
    own = submissions.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.min(F.struct(*fields)).alias("_s"))
    nxt = submissions.groupBy(F.col("user_id").alias("_u"), F.col("problem_id").alias("_p"), (F.col("attempt") - 1).alias("_a")).agg(F.count("*").alias("_m"), F.min("language").alias("_l"), F.max("language").alias("_l2"))
    known = problems.select(F.col("problem_id").alias("_k")).filter("_k is not null").distinct().withColumn("_known", F.lit(True))
    rows = manifest.join(own, key, "left")
    rows = rows.join(nxt, (F.col("_s.user_id") == F.col("_u")) & (F.col("_s.problem_id") == F.col("_p")) & (F.col("_s.attempt") == F.col("_a")), "left")
    rows = rows.join(known, F.col("_s.problem_id") == F.col("_k"), "left")
    found, goes_on = F.col("_s").isNotNull(), F.col("_m").isNotNull()
    named = lambda x: F.coalesce(F.lower(F.trim(x)).isin(*languages), F.lit(False))
    wrong = {
        "missing selected submission": ~found,
        "repeated submission": found & (F.col("_n") > 1),
        "attempt differs from its source": found & ~F.col("attempt").eqNullSafe(F.col("_s.attempt")),
        "problem differs from its source": found & ~F.col("problem_id").eqNullSafe(F.col("_s.problem_id")),
        "participant differs from its source": found & ~F.col("participant_id_hash").eqNullSafe(pseudonym(F.col("_s.user_id"))),
        "no next attempt": found & ~goes_on,
        "repeated next attempt": found & goes_on & (F.col("_m") > 1),
        "language not selected": found & ~(named(F.col("_s.language")) & (~goes_on | (named(F.col("_l")) & named(F.col("_l2"))))),
        "unknown problem": found & F.col("_known").isNull(),
    }
    return rows.select("item", F.explode(F.array_compact(F.array(*(F.when(when, what) for what, when in wrong.items())))).alias("problem"))


def evidence_match(b: DataFrame, c: DataFrame, key: str, hashed: str) -> DataFrame:
    """(key, status): MATCHED where both sides have the same hash, else MISMATCH."""
    both = b.select(key, F.col(hashed).alias("hb")).join(c.select(key, F.col(hashed).alias("hc")), key, "full_outer")
    return both.select(key, F.when(F.coalesce(F.col("hb") == F.col("hc"), F.lit(False)), "MATCHED").otherwise("MISMATCH").alias("status"))


def match_rate(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count("*").alias("items"), F.count_if(F.col("status") == "MATCHED").alias("matched")).withColumn("match_rate", F.try_divide(F.col("matched").cast("double"), F.col("items").cast("double")))


def set_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys only one side has, and how many both."""
    rows = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(b.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return rows.agg(F.count_if(F.expr("l = 1 and r = 0")).alias("only_left"), F.count_if(F.expr("l = 0 and r = 1")).alias("only_right"), F.count_if(F.expr("l = 1 and r = 1")).alias("both"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same rows as often, whatever their order."""
    cols = sorted(a.columns)
    h = lambda d, s: d.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("j"), F.lit(s).alias("s"))
    per = h(a, 1).unionAll(h(b, -1)).groupBy("j").agg(F.sum("s").alias("s"))
    return per.agg(F.coalesce(F.sum(F.when(F.col("s") > 0, F.col("s"))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.when(F.col("s") < 0, -F.col("s"))), F.lit(0)).alias("only_right"))


def frozen_cohort(manifest: DataFrame, qc: DataFrame, key: str, first_batch: int) -> DataFrame:
    """Manifest rows with their language check: batch by selection order, and whether they stay."""
    out = manifest.join(qc.select(key, "qc_status"), key, "left")
    return out.withColumns({
        "batch": F.when(F.col("selection_order").cast("int") <= first_batch, 1).otherwise(2),
        "language_eligible": F.coalesce(F.col("qc_status") == "CONFIRMED_C", F.lit(False)),
    }).orderBy(F.col("selection_order").cast("int"))
