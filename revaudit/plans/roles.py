"""The tables of the test data in the roles that the operators work on, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as submissions: source is the user, doc_id decides the problem, attempts skip each fifth number."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    rn = F.row_number().over(Window.partitionBy("source", F.col("doc_id") % 7).orderBy("doc_id"))
    verdict = F.when(F.col("quality") == 1, "Accepted").when(F.col("quality") == 0, "Wrong Answer")
    out = d.join(lab, "doc_id", "left").select(
        F.concat(F.lit("sub_"), F.col("doc_id").cast("string")).alias("submission_id"), F.col("source").alias("user_id"), F.concat(F.lit("prob_"), (F.col("doc_id") % 7).cast("string")).alias("problem_id"),
        (rn + F.floor(rn / 5)).cast("int").alias("attempt"), F.col("lang").alias("language"), F.col("text").alias("code"), verdict.alias("verdict"), "doc_id",
    )
    return out.withColumn("trace", F.when(F.col("verdict").isNotNull(), F.concat(F.lit('["Compiled","'), "verdict", F.lit('"]'))))


SUB = """sub AS (SELECT 'sub_' || doc_id AS submission_id, source AS user_id, 'prob_' || (doc_id % 7) AS problem_id, CAST(rn + rn // 5 AS INTEGER) AS attempt, lang AS language, text AS code,
  CASE quality WHEN 1 THEN 'Accepted' WHEN 0 THEN 'Wrong Answer' END AS verdict, doc_id, CASE quality WHEN 1 THEN '["Compiled","Accepted"]' WHEN 0 THEN '["Compiled","Wrong Answer"]' END AS trace
  FROM (SELECT d.*, l.quality, row_number() OVER (PARTITION BY source, d.doc_id % 7 ORDER BY d.doc_id) AS rn FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))"""
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
PAIR = f"""{SUB},
sh AS (SELECT *, sha256(code) AS h, sha256(regexp_replace(code, '{SPACE}', '', 'g')) AS w, substr(sha256(concat(substr(sha256('revground-codestream-stage45-v1|' || user_id), 1, 16), '|', problem_id)), 1, 20) AS trajectory_id, substr(sha256('revground-codestream-stage45-v1|' || user_id), 1, 16) AS participant_id_hash FROM sub),
pair AS (SELECT * FROM (SELECT trajectory_id, participant_id_hash, user_id, problem_id, submission_id AS submission_id_t, attempt AS attempt_t, language AS language_t, verdict AS verdict_t, trace AS trace_t, h AS code_sha256_t, w AS code_whitespace_sha256_t, code AS code_t,
  lead(submission_id) OVER o AS submission_id_t1, lead(attempt) OVER o AS attempt_t1, lead(language) OVER o AS language_t1, lead(verdict) OVER o AS verdict_t1, lead(trace) OVER o AS trace_t1, lead(h) OVER o AS code_sha256_t1, lead(w) OVER o AS code_whitespace_sha256_t1, lead(code) OVER o AS code_t1
  FROM sh WINDOW o AS (PARTITION BY user_id, problem_id ORDER BY attempt, submission_id)) WHERE submission_id_t1 IS NOT NULL)"""


def problems(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of the benchmark as six problems: the last two are the first two with a word more, one has a broken test, and
    one a test more than the traces have entries."""
    b = table(spark, sf, "benchmark").groupBy((F.col("item_id") % 4).alias("m")).agg(F.min_by("text", "item_id").alias("d"))
    k = spark.range(6).withColumnRenamed("id", "k").join(b, F.col("k") % 4 == F.col("m"))
    case = '{"test_case_no":%d,"input":"a","output":"b"}'
    cases = F.when(F.col("k") == 2, '[{"test_case_no":1,"input":"a"}]').when(F.col("k") == 5, f"[{case % 1},{case % 2},{case % 3}]").otherwise(f"[{case % 1},{case % 2}]")
    return k.select(F.concat(F.lit("prob_"), F.col("k").cast("string")).alias("problem_id"), F.concat("d", F.when(F.col("k") > 3, " more").otherwise("")).alias("description"), cases.alias("test_cases"))


#: The profile as the reference makes it: valid rows, their pairs, eligible ones, leakage groups, splits and crossing codes.
PROF = f"""{SUB}, prob AS (SELECT 'prob_' || k AS problem_id, d || CASE WHEN k > 3 THEN ' more' ELSE '' END AS description, CASE k WHEN 2 THEN 1 WHEN 5 THEN 3 ELSE 2 END AS tests, k <> 2 AS tests_valid
    FROM (SELECT unnest(range(6)) AS k) JOIN (SELECT item_id % 4 AS m, arg_min(text, item_id) AS d FROM benchmark GROUP BY 1) ON k % 4 = m),
  hs AS (SELECT *, coalesce(sha256(code), sha256('nan')) AS h, sha256(regexp_replace(coalesce(code, 'nan'), '{SPACE}', '', 'g')) AS w, substr(sha256('revground-codestream-stage45-v1|' || user_id), 1, 16) AS participant_id_hash FROM sub),
  fl AS (SELECT hs.*, submission_id IS NULL OR user_id IS NULL OR hs.problem_id IS NULL OR attempt IS NULL OR language IS NULL OR code IS NULL OR verdict IS NULL OR trace IS NULL AS required_missing, prob.problem_id IS NOT NULL AS linked, tests, coalesce(tests_valid, false) AS tests_valid,
    count(*) OVER (PARTITION BY submission_id) > 1 AS same_id, count(*) OVER (PARTITION BY user_id, hs.problem_id, attempt) > 1 AS same_key FROM hs LEFT JOIN prob ON hs.problem_id = prob.problem_id),
  ok AS (SELECT *, substr(sha256(concat(participant_id_hash, '|', problem_id)), 1, 20) AS trajectory_id FROM fl WHERE NOT required_missing AND attempt > 0 AND linked AND NOT same_id AND NOT same_key),
  tr AS (SELECT user_id, problem_id, count(*) AS n, min(attempt) AS lo, max(attempt) AS hi, count(DISTINCT attempt) AS seen, count(DISTINCT language) AS langs FROM ok GROUP BY 1, 2),
  pr AS (SELECT * FROM (SELECT submission_id, trajectory_id, participant_id_hash, problem_id, language AS lt, h, w, tests_valid, lead(submission_id) OVER o AS next, lead(attempt) OVER o = attempt + 1 AS consecutive, lead(language) OVER o AS lt1, lead(h) OVER o AS h1, lead(w) OVER o AS w1 FROM ok WINDOW o AS (PARTITION BY user_id, problem_id ORDER BY attempt, submission_id)) WHERE next IS NOT NULL),
  el AS (SELECT * FROM pr WHERE consecutive AND lt = lt1 AND tests_valid AND h <> h1),
  best AS (SELECT l.language FROM (SELECT DISTINCT language FROM sub WHERE language IS NOT NULL) l LEFT JOIN (SELECT lt, count(*) AS n, count(DISTINCT problem_id) AS p, count(DISTINCT participant_id_hash) AS u FROM el GROUP BY 1) e ON l.language = e.lt ORDER BY coalesce(n * sqrt(CAST(p * u AS DOUBLE)), 0) DESC, coalesce(p, 0) DESC, coalesce(u, 0) DESC, language LIMIT 1),
  p0 AS (SELECT el.* FROM el JOIN best ON lt = language),
  tk AS (SELECT problem_id, list_distinct(regexp_extract_all(lower(description), '[a-z0-9]+')) AS s FROM prob),
  near AS (SELECT a.problem_id AS a, b.problem_id AS b FROM tk a JOIN tk b ON a.problem_id < b.problem_id AND 100 * len(list_intersect(a.s, b.s)) >= 90 * len(list_distinct(list_concat(a.s, b.s)))),
  reach AS (SELECT problem_id AS a, problem_id AS b FROM prob UNION SELECT r.a, CASE WHEN near.a = r.b THEN near.b ELSE near.a END FROM reach r JOIN near ON r.b IN (near.a, near.b)),
  grp AS (SELECT a AS problem_id, 'lg_' || substr(sha256(array_to_string(list_sort(list(DISTINCT b)), '|')), 1, 12) AS g FROM reach GROUP BY 1),
  wt AS (SELECT g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, sha256('revground-problem-split-v1|' || g)) AS r FROM p0 JOIN grp USING (problem_id) GROUP BY 1), tot AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM wt),
  fold AS (SELECT CAST(0 AS BIGINT) AS r, CAST('' AS VARCHAR) AS g, '' AS part, 0.0::DOUBLE AS d, 0.0::DOUBLE AS v, 0.0::DOUBLE AS s UNION ALL
    SELECT r, g, part, d + CASE part WHEN 'development' THEN n ELSE 0 END, v + CASE part WHEN 'validation' THEN n ELSE 0 END, s + CASE part WHEN 'test' THEN n ELSE 0 END
    FROM (SELECT wt.r, wt.g, wt.n, d, v, s, CASE WHEN d / (t * 0.6) <= v / (t * 0.2) AND d / (t * 0.6) <= s / (t * 0.2) THEN 'development' WHEN v / (t * 0.2) <= s / (t * 0.2) THEN 'validation' ELSE 'test' END AS part FROM fold JOIN wt ON wt.r = fold.r + 1, tot)),
  asg AS (SELECT DISTINCT problem_id, part FROM p0 JOIN grp USING (problem_id) JOIN fold USING (g)),
  us AS (SELECT participant_id_hash, row_number() OVER (ORDER BY sha256('revground-problem-split-v1|' || participant_id_hash)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT participant_id_hash FROM p0)),
  p1 AS (SELECT p0.*, part FROM p0 JOIN asg USING (problem_id)),
  bad AS (SELECT h FROM (SELECT h, part FROM p1 UNION ALL SELECT h1, part FROM p1) GROUP BY 1 HAVING count(DISTINCT part) > 1 UNION SELECT w FROM (SELECT w, part FROM p1 UNION ALL SELECT w1, part FROM p1) GROUP BY 1 HAVING count(DISTINCT part) > 1),
  p2 AS (SELECT *, h IN (SELECT h FROM bad) OR h1 IN (SELECT h FROM bad) OR w IN (SELECT h FROM bad) OR w1 IN (SELECT h FROM bad) AS crossing FROM p1),
  strict AS (SELECT * FROM p2 WHERE NOT crossing),
  viol AS (SELECT near.* FROM near JOIN asg x ON near.a = x.problem_id JOIN asg y ON near.b = y.problem_id WHERE x.part <> y.part),
  left_over AS (SELECT h FROM (SELECT h, part FROM strict UNION ALL SELECT h1, part FROM strict) GROUP BY 1 HAVING count(DISTINCT part) > 1 UNION ALL SELECT w FROM (SELECT w, part FROM strict UNION ALL SELECT w1, part FROM strict) GROUP BY 1 HAVING count(DISTINCT part) > 1)"""


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as claims, each with a row of method B and of method C."""
    o, k, c = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    gold = F.when(k % 11 == 0, "UNSURE").when(F.col("o_orderstatus") == "F", "KEEP").when(F.col("o_orderstatus") == "O", "RETIRE").otherwise("RETRACT")
    b = F.when(F.col("o_orderpriority") == "1-URGENT", "KEEP").when(F.col("o_orderpriority") == "2-HIGH", "RETIRE").when(F.col("o_orderpriority") == "3-MEDIUM", "RETRACT")
    base = o.select(
        k.alias("claim_id"), F.concat(F.lit("t"), c.cast("string")).alias("trajectory_id"), F.concat(F.lit("u"), (c % 100).cast("string")).alias("participant_id_hash"),
        F.concat(F.lit("p"), (c % 20).cast("string")).alias("problem_id"), F.concat(F.lit("f"), (c % 5).cast("string")).alias("problem_family_id"), gold.alias("gold_label"), F.coalesce(b, gold).alias("b"),
        F.when(k % 5 == 0, "KEEP").otherwise(gold).alias("c"), ((k % 10) / 10.0).cast("double").alias("confidence"), F.when(k % 9 != 0, (k % 1000).cast("double")).alias("latency_ms"), ((k % 4) * 0.25).cast("double").alias("estimated_cost_usd"),
        F.when(k % 23 == 0, "error").otherwise("success").alias("status"),
    )
    sides = F.array(F.struct(F.lit("B").alias("method"), F.col("b").alias("predicted_label"), F.lit(False).alias("abstain")), F.struct(F.lit("C").alias("method"), F.col("c").alias("predicted_label"), (F.col("claim_id") % 7 == 0).alias("abstain")))
    return base.select("*", F.inline(sides)).drop("b", "c")


CLAIMS = """base AS (SELECT o_orderkey AS claim_id, 't' || o_custkey AS trajectory_id, 'u' || (o_custkey % 100) AS participant_id_hash, 'p' || (o_custkey % 20) AS problem_id, 'f' || (o_custkey % 5) AS problem_family_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'UNSURE' WHEN o_orderstatus = 'F' THEN 'KEEP' WHEN o_orderstatus = 'O' THEN 'RETIRE' ELSE 'RETRACT' END AS gold_label, o_orderpriority AS pr, CAST((o_orderkey % 10) / 10.0 AS DOUBLE) AS confidence,
  CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) END AS latency_ms, CAST((o_orderkey % 4) * 0.25 AS DOUBLE) AS estimated_cost_usd, CASE WHEN o_orderkey % 23 = 0 THEN 'error' ELSE 'success' END AS status FROM orders),
claims AS (SELECT * EXCLUDE (pr), 'B' AS method, CASE pr WHEN '1-URGENT' THEN 'KEEP' WHEN '2-HIGH' THEN 'RETIRE' WHEN '3-MEDIUM' THEN 'RETRACT' ELSE gold_label END AS predicted_label, false AS abstain FROM base
  UNION ALL SELECT * EXCLUDE (pr), 'C', CASE WHEN claim_id % 5 = 0 THEN 'KEEP' ELSE gold_label END, claim_id % 7 = 0 FROM base)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as rows of a run ledger; the item is the user and the number in the event's properties."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    failed = F.col("event_type") == "error"
    return e.select(
        "event_id", "ts", "user_id", k.alias("k"), F.concat_ws("_", F.col("user_id").cast("string"), k.cast("string")).alias("item_id"), "event_type",
        F.when(failed, "error").otherwise("accepted").alias("outcome"), F.when(failed, F.when(k % 2 == 0, 429).otherwise(500)).otherwise(200).alias("http_status"),
        F.when(failed, F.when(k % 2 == 0, "ProviderHTTPError").otherwise("ValueError")).alias("error_type"), F.when(k % 10 != 0, k.cast("long") * 10).alias("total_tokens"), (F.col("event_id") % 997).cast("double").alias("latency_ms"),
        F.when(k == 0, F.lit(None)).otherwise(F.concat(F.lit("model_"), (k % 3).cast("string"))).alias("returned_model"), F.lit("model_1").alias("requested_model"), "props",
    )


RUNS = """runs AS (SELECT event_id, ts, user_id, k, user_id || '_' || k AS item_id, event_type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'accepted' END AS outcome,
  CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 429 ELSE 500 END ELSE 200 END AS http_status, CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'ProviderHTTPError' ELSE 'ValueError' END END AS error_type,
  CASE WHEN k % 10 <> 0 THEN CAST(k AS BIGINT) * 10 END AS total_tokens, CAST(event_id % 997 AS DOUBLE) AS latency_ms, CASE WHEN k <> 0 THEN 'model_' || (k % 3) END AS returned_model, 'model_1' AS requested_model, props
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def annotators(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as two annotators' fields."""
    lab = table(spark, sf, "labels")
    name = lambda x: F.when(F.col(x) == 1, "YES").otherwise("NO")
    return lab.select("doc_id", name("quality").alias("validity_a"), name("toxic").alias("validity_b"), (F.col("doc_id") % 3).cast("string").alias("priority_a"), F.when(F.col("doc_id") % 5 == 0, "2").otherwise((F.col("doc_id") % 3).cast("string")).alias("priority_b"))


ANN = """ann AS (SELECT doc_id, CASE quality WHEN 1 THEN 'YES' ELSE 'NO' END AS validity_a, CASE toxic WHEN 1 THEN 'YES' ELSE 'NO' END AS validity_b, CAST(doc_id % 3 AS VARCHAR) AS priority_a, CASE WHEN doc_id % 5 = 0 THEN '2' ELSE CAST(doc_id % 3 AS VARCHAR) END AS priority_b FROM labels)"""


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as model decisions of all kinds, right and wrong."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.floor(i / n) % len(v)).cast("int") + 1)
    return e.select(
        i.cast("string").alias("item_id"), pick(1, "SUPPORTED", "REFUTED", "INDETERMINATE").alias("original_validity"), pick(3, "PRESENT", "RESOLVED", "INDETERMINATE", "NOT_APPLICABLE").alias("target_state_t1"),
        pick(12, "KEEP", "RETIRE", "RETRACT", "UNSURE").alias("lifecycle_label"), (i % 17 == 0).alias("abstain"), F.when(i % 17 == 0, "too little evidence").otherwise("").alias("abstention_reason"),
    )


def _pick(n: int, *v: str) -> str:
    return f"[{', '.join(repr(x) for x in v)}][CAST((event_id // {n}) % {len(v)} AS INTEGER) + 1]"


DEC = f"""dec AS (SELECT CAST(event_id AS VARCHAR) AS item_id, {_pick(1, "SUPPORTED", "REFUTED", "INDETERMINATE")} AS original_validity, {_pick(3, "PRESENT", "RESOLVED", "INDETERMINATE", "NOT_APPLICABLE")} AS target_state_t1,
  {_pick(12, "KEEP", "RETIRE", "RETRACT", "UNSURE")} AS lifecycle_label, event_id % 17 = 0 AS abstain, CASE WHEN event_id % 17 = 0 THEN 'too little evidence' ELSE '' END AS abstention_reason FROM events)"""


def packets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their line items as tests, and conversations' texts standing in for two states of a source."""
    from ..operators.packets import build, official_tests

    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    numbered = li.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_partkey").alias("p"), F.sum("l_suppkey").alias("s"))
    cases = numbered.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("test_case_no"), F.col("p").cast("string").alias("input"), F.col("s").cast("string").alias("output"))).alias("cases"))
    base = o.join(cases, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("item_id"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("problem_id"), F.concat(F.lit("priority "), "o_orderpriority").alias("statement"),
        F.concat(F.lit("status "), "o_orderstatus").alias("earlier_code"), F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("later_code"), F.when(F.col("o_orderkey") % 50 != 0, "a claim").alias("claim"), "cases",
    )
    return build(base.withColumn("tests", official_tests("cases", "problem_id")), "item_id", "problem_id", "statement", "earlier_code", "later_code", "claim", "tests")
