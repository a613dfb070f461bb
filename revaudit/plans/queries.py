"""The queries over the test data, each with its oracle where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import responses, signatures, text, udfs
from ..operators import agreement, bootstrap, checks, constraints, decisions, joins, ledger, metrics, packets, profile, quality, similarity, split, trajectory
from ..sources import readers, sinks
from . import roles
from .roles import ANN, CLAIMS, DEC, PAIR, PROF, RUNS, SPACE, SUB, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add



# ---------------------------------------------------------------- trajectories and transitions
@query(f"""WITH {PAIR} SELECT language_t AS language, count(*) AS transitions, count(DISTINCT problem_id) AS problems, count(DISTINCT participant_id_hash) AS participants,
  count(*) * sqrt(CAST(count(DISTINCT problem_id) * count(DISTINCT participant_id_hash) AS DOUBLE)) AS selection_score FROM pair WHERE attempt_t1 = attempt_t + 1 AND language_t = language_t1 AND code_sha256_t <> code_sha256_t1 GROUP BY 1""")
def trajectory_transitions(spark: SparkSession, sf: str) -> DataFrame:
    pairs = trajectory.transitions(roles.submissions(spark, sf))
    return trajectory.language_profile(pairs.filter("is_consecutive and same_language and not code_exact_same"))


@query(f"""WITH {PAIR} SELECT transition_id, trajectory_id, participant_id_hash, submission_id_t, submission_id_t1, attempt_t1 = attempt_t + 1 AS is_consecutive, language_t = language_t1 AS same_language, code_sha256_t = code_sha256_t1 AS code_exact_same,
  code_whitespace_sha256_t = code_whitespace_sha256_t1 AS code_whitespace_normalized_same, NOT coalesce(verdict_t = verdict_t1, false) AS verdict_changed,
  sha256(concat(trajectory_id, '|', submission_id_t, '|', submission_id_t1, '|', code_sha256_t, '|', code_sha256_t1)) AS pair_sha256 FROM (SELECT *, substr(sha256(concat(trajectory_id, '|', submission_id_t, '|', submission_id_t1)), 1, 24) AS transition_id FROM pair)""")
def transitions(spark, sf):
    return trajectory.transitions(roles.submissions(spark, sf)).select(
        "transition_id", "trajectory_id", "participant_id_hash", "submission_id_t", "submission_id_t1", "is_consecutive", "same_language", "code_exact_same", "code_whitespace_normalized_same", "verdict_changed", "pair_sha256"
    )


TRAJ = f"""{SUB}, traj AS (SELECT user_id, problem_id, count(*) AS submission_count, min(attempt) AS min_attempt, max(attempt) AS max_attempt, list_sort(list_distinct(list(attempt))) AS seen, list_sort(list_distinct(list(language))) AS langs, coalesce(bool_or(verdict = 'Accepted'), false) AS accepted_ever, arg_max_null(verdict, attempt) AS final_attempt_verdict FROM sub GROUP BY 1, 2)"""


@query(f"""WITH {TRAJ} SELECT user_id, problem_id, submission_count, min_attempt, max_attempt, min_attempt = 1 AS starts_at_one, len(gaps) = 0 AS attempt_numbers_contiguous, array_to_string(gaps, ';') AS missing_attempt_numbers, CAST(len(langs) AS INTEGER) AS language_count, array_to_string(langs, ';') AS languages, len(langs) > 1 AS mixed_language, accepted_ever, final_attempt_verdict
  FROM (SELECT *, list_filter(range(min_attempt, max_attempt + 1), lambda x: NOT list_contains(seen, x)) AS gaps FROM traj)""")
def trajectory_summary(spark, sf):
    return trajectory.summarise(roles.submissions(spark, sf))


@query(f"""WITH {TRAJ} SELECT CASE WHEN submission_count <= 10 THEN CAST(submission_count AS VARCHAR) ELSE '11+' END AS attempts, count(*) AS trajectories FROM traj GROUP BY 1""")
def trajectory_lengths(spark, sf):
    return trajectory.length_histogram(trajectory.summarise(roles.submissions(spark, sf)), 10)


@query(f"""WITH {TRAJ} SELECT CAST(m AS INTEGER) AS minimum_attempts, count(*) AS trajectories, count(DISTINCT user_id) AS participants, count(DISTINCT problem_id) AS problems FROM traj, (VALUES (2), (3), (4), (8)) v(m) WHERE submission_count >= m GROUP BY 1""")
def trajectory_thresholds(spark, sf):
    return trajectory.thresholds(trajectory.summarise(roles.submissions(spark, sf)), (2, 3, 4, 8))


@query(f"""WITH {PAIR}, p AS (SELECT language_t AS language, count(*) AS transitions, count(DISTINCT problem_id) AS problems, count(DISTINCT participant_id_hash) AS participants FROM pair GROUP BY 1)
  SELECT language, transitions FROM p ORDER BY transitions * sqrt(CAST(problems * participants AS DOUBLE)) DESC, transitions DESC, language LIMIT 1""")
def primary_language(spark, sf):
    return trajectory.best_language(trajectory.language_profile(trajectory.transitions(roles.submissions(spark, sf)))).select("language", "transitions")


@query(f"""WITH {PAIR} SELECT submission_id_t, coalesce(attempt_t1 = attempt_t + 1 AND trace_t IS NOT NULL AND trace_t1 IS NOT NULL, false) AS evidence_ready FROM pair""")
def evidence_readiness(spark, sf):
    p = trajectory.transitions(roles.submissions(spark, sf), carry=("trace",))
    ok = lambda c: text.json_list_reason(c).isNull()
    return p.select("submission_id_t", trajectory.evidence_ready(F.col("is_consecutive"), ok("trace_t"), ok("trace_t1")).alias("evidence_ready"))


@query("SELECT conv_id, turn AS turn_t, turn1 AS turn_t1, role, role1 = role AS same_role FROM (SELECT conv_id, turn, role, lead(turn) OVER w AS turn1, lead(role) OVER w AS role1 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE turn1 IS NOT NULL")
def conversation_transitions(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("user_id"), F.lit("c").alias("problem_id"), "turn", F.col("turn").alias("submission_id"), F.col("role").alias("language"), F.col("text").alias("code"), F.lit(None).cast("string").alias("verdict"))
    p = trajectory.transitions(c, attempt="turn")
    return p.select(F.col("user_id").cast("long").alias("conv_id"), F.col("attempt_t").alias("turn_t"), F.col("attempt_t1").alias("turn_t1"), F.col("language_t").alias("role"), F.col("same_language").alias("same_role"))


@query("SELECT item_id, 'DEV_' || lpad(CAST(row_number() OVER (ORDER BY text, item_id) AS VARCHAR), 3, '0') AS dev_id FROM benchmark")
def ordinal_ids(spark, sf):
    return trajectory.ordinals(table(spark, sf, "benchmark"), ["text", "item_id"], "dev_id", "DEV_").select("item_id", "dev_id")


@query(None)
def line_diffs(spark, sf):
    p = trajectory.transitions(roles.submissions(spark, sf))
    return p.select("submission_id_t", udfs.line_diff_counts("code_t", "code_t1").alias("d")).select("submission_id_t", "d.*")


@query(None)
def unified_diffs(spark, sf):
    p = trajectory.transitions(roles.submissions(spark, sf))
    return p.select("submission_id_t", F.sha2(udfs.unified_diff("code_t", "code_t1"), 256).alias("diff_sha256"))


# ---------------------------------------------------------------- quality
@query(f"""WITH {SUB}, f AS (SELECT submission_id, (user_id IS NULL OR verdict IS NULL OR trace IS NULL) AS required_missing, attempt > 0 AS attempt_valid, problem_id IN (SELECT 'prob_' || (item_id % 6) FROM benchmark) AS problem_linked, count(*) OVER (PARTITION BY submission_id) > 1 AS duplicate_submission_id, count(*) OVER (PARTITION BY user_id, problem_id, attempt) > 1 AS duplicate_attempt_key FROM sub)
  SELECT *, NOT required_missing AND attempt_valid AND problem_linked AND NOT duplicate_submission_id AND NOT duplicate_attempt_key AS row_valid_for_ordering FROM f""")
def submission_flags(spark, sf):
    probs = table(spark, sf, "benchmark").select(F.concat(F.lit("prob_"), (F.col("item_id") % 6).cast("string")).alias("problem_id"))
    subs = roles.submissions(spark, sf).withColumnRenamed("attempt", "attempt_number")
    out = quality.flag_submissions(subs, probs, ["user_id", "verdict", "trace"])
    return out.select("submission_id", "required_missing", "attempt_valid", "problem_linked", "duplicate_submission_id", "duplicate_attempt_key", "row_valid_for_ordering")


@query("SELECT text_hash, n FROM (SELECT sha256(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def duplicate_texts(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("text_hash"))
    return ledger.duplicate_keys(d, "text_hash").withColumnRenamed("rows", "n")


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_extra_rows(spark, sf):
    return quality.extra_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def _profile(spark, sf):
    return profile.build(roles.submissions(spark, sf).withColumnRenamed("attempt", "attempt_number"), roles.problems(spark, sf))


@query(f"""WITH RECURSIVE {PROF}, c AS (SELECT count(*) FILTER (NOT consecutive) AS t01, count(*) FILTER (consecutive AND lt <> lt1) AS t02, count(*) FILTER (consecutive AND NOT tests_valid) AS t03, count(*) FILTER (consecutive AND h = h1) AS t04, count(*) FILTER (consecutive AND h <> h1 AND w = w1) AS t05, (SELECT count(*) FROM p2 WHERE crossing) AS t06 FROM pr)
  SELECT 'transition' AS scope, unnest(['T01', 'T02', 'T03', 'T04', 'T05', 'T06']) AS rule_id, unnest([t01, t02, t03, t04, t05, t06]) AS count,
    unnest(['exclude', 'exclude from single-language primary set', 'exclude from evidence-grounded set', 'flag; exclude from edited primary set', 'flag', 'exclude from strict evaluation partitions']) AS status FROM c""")
def exclusion_ledger(spark, sf):
    """The rules on transitions, over those of valid rows."""
    return profile.transition_ledger(_profile(spark, sf)).drop("reason")


@query(f"""WITH {SUB} SELECT 'submissions' AS file, f AS field, m AS missing_count, m / CAST(n AS DOUBLE) AS missing_share FROM (SELECT count(*) AS n, unnest(['user_id', 'verdict', 'trace']) AS f, unnest([count(*) - count(user_id), count(*) - count(verdict), count(*) - count(trace)]) AS m FROM sub)
  UNION ALL SELECT 'benchmark', 'text', count(*) - count(text), (count(*) - count(text)) / CAST(count(*) AS DOUBLE) FROM benchmark""")
def missing_fields(spark, sf):
    return quality.missingness({"submissions": (roles.submissions(spark, sf), ["user_id", "verdict", "trace"]), "benchmark": (table(spark, sf, "benchmark"), ["text"])})


@query(f"""WITH {SUB} SELECT coalesce(verdict, '<MISSING>') AS verdict, count(*) AS n, count(*) / CAST((SELECT count(*) FROM sub) AS DOUBLE) AS share FROM sub GROUP BY 1""")
def verdict_distribution(spark, sf):
    return quality.distribution(roles.submissions(spark, sf), "verdict")


@query(f"""WITH {SUB}, h AS (SELECT sha256(code) AS h, problem_id FROM sub) SELECT h AS code_sha256, count(*) AS rows, count(DISTINCT problem_id) AS problems FROM h GROUP BY 1 HAVING count(DISTINCT problem_id) > 1""")
def cross_problem_code(spark, sf):
    s = roles.submissions(spark, sf).select(text.sha256_text("code").alias("code_sha256"), "problem_id")
    return s.groupBy("code_sha256").agg(F.count("*").alias("rows"), F.countDistinct("problem_id").alias("problems")).filter("problems > 1")


@query("""SELECT stage, count(*) AS n FROM (SELECT CASE WHEN quality IS NULL THEN 'NO_FOCAL_CLAIM' WHEN lang <> 'en' THEN 'EXCLUDED_LANGUAGE' WHEN quality = 0 THEN 'STAGE_A_FAILURE' ELSE 'SUCCESSFUL_C_CLAIM_BEARING' END AS stage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1""")
def stage_screening(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy(quality.screening_stage(F.col("quality").isNotNull(), F.col("lang") == "en", F.coalesce(F.col("quality") == 1, F.lit(False))).alias("stage")).agg(F.count("*").alias("n"))


@query("SELECT CAST(position AS INTEGER) AS position, n_name FROM (VALUES (0, 7), (1, 3), (2, 21)) v(position, k) JOIN nation ON n_nationkey = k")
def ordered_selection(spark, sf):
    return quality.select_ordered(table(spark, sf, "nation"), "n_nationkey", [7, 3, 21]).select("position", "n_name")


CHECK_VALUES = """(SELECT count(*) = count(DISTINCT problem_id) FROM prob) AS ids, (SELECT count(*) = count(DISTINCT submission_id) FROM sub) AS subs, (SELECT coalesce(bool_and(consecutive), true) FROM strict) AS con, (SELECT coalesce(bool_and(lt = lt1), true) FROM strict) AS lang, (SELECT coalesce(bool_and(tests_valid), true) FROM strict) AS ev,
  (SELECT coalesce(max(n) = 1, true) FROM (SELECT count(DISTINCT part) AS n FROM strict GROUP BY problem_id)) AS one, (SELECT coalesce(max(n) = 1, true) FROM (SELECT count(DISTINCT part) AS n FROM strict GROUP BY trajectory_id)) AS traj, (SELECT count(*) = count(DISTINCT participant_id_hash) FROM us) AS second,
  (SELECT count(*) = 0 FROM viol) AS near_ok, (SELECT count(*) = 0 FROM left_over) AS hash_ok, (SELECT count(DISTINCT part) = 3 FROM strict) AS three"""


@query(f"""WITH RECURSIVE {PROF}, a AS (SELECT count(*) AS submissions_rows, count(DISTINCT submission_id) AS unique_submission_ids, count(DISTINCT user_id) AS unique_participants, count(DISTINCT problem_id) AS unique_problems_in_submissions, array_to_string(list_sort(list(DISTINCT language) FILTER (language IS NOT NULL)), ';') AS languages,
    count(*) FILTER (required_missing) AS missing_required_submission_rows, count(*) FILTER (NOT coalesce(attempt > 0, false)) AS invalid_attempt_rows, count(*) FILTER (NOT linked) AS unlinked_problem_rows, count(*) FILTER (same_id) AS duplicate_submission_id_rows, count(*) FILTER (same_key) AS duplicate_attempt_key_rows,
    count(*) FILTER (trace IS NULL) AS malformed_trace_rows, count(*) FILTER (json_extract_string(trace, '$[#-1]') = verdict) AS trace_last_matches_final_rows, count(*) FILTER (coalesce(trace IS NOT NULL AND tests = 2, false)) AS trace_length_matches_test_count_rows,
    count(DISTINCT (user_id, problem_id)) FILTER (user_id IS NOT NULL AND problem_id IS NOT NULL) AS all_trajectories, count(*) - count(DISTINCT (submission_id, user_id, problem_id, attempt, language, code, verdict, trace)) AS exact_duplicate_submission_rows FROM fl),
  dup AS (SELECT count(*) FILTER (nh > 1) AS exact_code_duplicate_rows, count(*) FILTER (ch) AS exact_code_cross_problem_rows, count(*) FILTER (nw > 1) AS whitespace_normalized_code_duplicate_rows, count(*) FILTER (cw) AS whitespace_normalized_code_cross_problem_rows
    FROM (SELECT count(*) OVER (PARTITION BY h) AS nh, count(*) OVER (PARTITION BY w) AS nw, min(problem_id) OVER (PARTITION BY h) <> max(problem_id) OVER (PARTITION BY h) AS ch, min(problem_id) OVER (PARTITION BY w) <> max(problem_id) OVER (PARTITION BY w) AS cw FROM fl)),
  b AS (SELECT count(*) AS valid_trajectories, count(*) FILTER (n >= 2) AS trajectories_at_least_2, count(*) FILTER (n >= 3) AS trajectories_at_least_3, count(*) FILTER (n >= 4) AS trajectories_at_least_4, count(*) FILTER (hi - lo + 1 > seen) AS trajectories_with_attempt_gaps, count(*) FILTER (lo <> 1) AS trajectories_not_starting_at_one, count(*) FILTER (langs > 1) AS mixed_language_trajectories FROM tr),
  c AS (SELECT count(*) AS adjacent_pairs_all, count(*) FILTER (consecutive) AS consecutive_transitions_all, count(*) FILTER (consecutive AND tests_valid) AS evidence_ready_consecutive_transitions, count(*) FILTER (h = h1) AS unchanged_pairs FROM pr),
  d AS (SELECT count(*) AS primary_eligible_transitions_before_cross_split_dedup, count(*) FILTER (crossing) AS primary_cross_split_code_duplicate_transitions_removed FROM p2),
  e AS (SELECT count(*) AS primary_eligible_transitions, count(DISTINCT trajectory_id) AS primary_eligible_trajectories, count(DISTINCT participant_id_hash) AS primary_eligible_participants, count(DISTINCT problem_id) AS primary_eligible_problems, CASE WHEN count(*) >= 100 AND count(DISTINCT problem_id) >= 10 THEN 'PASS' ELSE 'REVIEW' END AS gate_stage4 FROM strict),
  v AS (SELECT {CHECK_VALUES}), listed AS (SELECT part, count(*) AS n FROM strict GROUP BY 1), probs AS (SELECT part, count(*) AS n FROM asg GROUP BY 1)
  SELECT a.*, dup.*, b.*, c.*, d.*, e.*, (SELECT language FROM best) AS primary_language, (SELECT count(*) FROM prob) AS problem_rows, (SELECT coalesce(string_agg(part || '=' || n, ';' ORDER BY part), '') FROM listed) AS split_counts, (SELECT coalesce(string_agg(part || '=' || n, ';' ORDER BY part), '') FROM probs) AS split_problem_counts,
    (SELECT count(*) FILTER (NOT tests_valid) FROM prob) AS malformed_problem_test_rows, (SELECT bool_and(tests_valid) FROM prob) AS official_tests_available, (SELECT count(*) FROM near) AS near_duplicate_problem_pairs_review, (SELECT count(*) FROM viol) AS near_duplicate_problem_split_violations,
    CASE WHEN ids AND subs AND con AND lang AND ev AND one AND traj AND second AND near_ok AND hash_ok AND three THEN 'PASS' ELSE 'FAIL' END AS gate_stage5 FROM a, dup, b, c, d, e, v""")
def profile_summary(spark, sf):
    """All numbers of the profile row; names and hashes of files and fixed texts are not data."""
    return profile.summary(_profile(spark, sf))


LANGS = ("en", "de", "fr", "es")


@query(f"""SELECT source, {', '.join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in LANGS)}, count(*) FILTER (lang IS NULL OR lang NOT IN {LANGS}) AS other FROM documents GROUP BY 1""")
def partition_status_crosstab(spark, sf):
    status = F.when(F.col("lang").isin(*LANGS), F.col("lang")).otherwise("other")
    return quality.crosstab(table(spark, sf, "documents").select("source", status.alias("status")), "source", "status", [*LANGS, "other"])


@query("""SELECT count(*) AS cases, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, count(*) FILTER (quality = 1) AS cases_good, count(DISTINCT source) FILTER (quality = 1) AS sources_good, count(*) FILTER (quality = 1 AND lang = 'en') AS cases_final FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def cohort_profile(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    good = F.col("quality") == 1
    return d.agg(F.count("*").alias("cases"), F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"), F.count_if(good).alias("cases_good"), F.countDistinct(F.when(good, F.col("source"))).alias("sources_good"), F.count_if(good & (F.col("lang") == "en")).alias("cases_final"))


# ---------------------------------------------------------------- scalar functions
@query(f"""SELECT doc_id, sha256(text) AS text_sha256, substr(sha256('revground-codestream-stage45-v1|' || source), 1, 16) AS pseudonym, substr(sha256(concat(source, '|', doc_id)), 1, 20) AS key20, sha256(regexp_replace(text, '{SPACE}', '', 'g')) AS compact_sha256,
  sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS tokens_sha256, CASE lower(trim(lang)) WHEN 'c++' THEN 'C++' WHEN 'c' THEN 'C' ELSE trim(lang) END AS language FROM documents""")
def text_hashes(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.sha256_text("text").alias("text_sha256"), text.pseudonym("source").alias("pseudonym"), text.composite_key("source", "doc_id", length=20).alias("key20"),
        F.sha2(text.normalize_code("text"), 256).alias("compact_sha256"), F.sha2(text.normalize_problem_text("text"), 256).alias("tokens_sha256"), text.normalize_language("lang").alias("language"),
    )


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'expected list, found dict' WHEN event_id % 5 = 1 THEN 'malformed' WHEN event_id % 5 = 2 THEN 'missing' END AS reason, CASE WHEN event_id % 5 >= 3 THEN 2 END AS n, CASE WHEN event_id % 5 >= 3 THEN event_type END AS last FROM events")
def json_lists(spark, sf):
    e, m = table(spark, sf, "events"), F.col("event_id") % 5
    raw = F.when(m == 0, F.col("props")).when(m == 1, F.lit('["a", ')).when(m > 2, F.concat(F.lit('["a","'), "event_type", F.lit('"]')))
    e = e.select("event_id", raw.alias("raw")).withColumn("reason", text.json_list_reason("raw")).withColumn("items", F.when(F.col("reason").isNull(), text.json_list("raw")))
    return e.select("event_id", "reason", text.array_length("items").alias("n"), text.array_last("items").alias("last"))


@query("SELECT event_id, event_id % 4 > 1 AS all_keys, CASE event_id % 4 WHEN 0 THEN 'input|test_case_no' WHEN 1 THEN 'input;input|output|test_case_no' ELSE 'input|output|test_case_no' END AS pattern FROM events")
def test_case_shapes(spark, sf):
    m = F.col("event_id") % 4
    raw = F.when(m == 0, '[{"test_case_no":1,"input":"a"}]').when(m == 1, '[{"test_case_no":1,"input":"a","output":"b"},{"input":"c"}]').otherwise('[{"output":"b","test_case_no":1,"input":"a"}]')
    e = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", text.items_have_keys("raw", ["test_case_no", "input", "output"]).alias("all_keys"), text.key_patterns("raw").alias("pattern"))


@query(None)
def strict_json(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise('["a"] x').alias("raw"))
    return e.select("event_id", udfs.strict_json_list("raw").alias("r")).select("event_id", "r.reason")


@query(None)
def canonical_hashes(spark, sf):
    return table(spark, sf, "events").select("event_id", F.sha2(udfs.canonical_json("props"), 256).alias("sha256"))


@query(r"SELECT item_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+(?:[-''][\p{L}\p{M}\p{N}_]+)*')) AS INTEGER) AS words, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+(?:[-''][\p{L}\p{M}\p{N}_]+)*')) BETWEEN 20 AND 60 AS in_range FROM benchmark")
def hint_word_counts(spark, sf):
    n = text.word_count("text")
    return table(spark, sf, "benchmark").select("item_id", n.alias("words"), n.between(20, 60).alias("in_range"))


#: The same without a lookahead: a mark after each end of a sentence, which needs a character before it.
_SENTENCES = "string_split(left(text, 1) || regexp_replace(substr(text, 2), '([.!?])([ \\t\\n\\x0B\\f\\r])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


@query(f"""WITH t AS (SELECT doc_id, text, list_filter([regexp_replace(x, '^{SPACE}|{SPACE}$', '', 'g') FOR x IN {_SENTENCES}], lambda s: s <> '') AS ss FROM documents),
  f AS (SELECT *, coalesce(regexp_matches(ss[1], '{text.IMPERATIVE}') AND NOT contains(ss[1], ':') AND len(ss) > 1, false) AS second FROM t), c AS (SELECT *, CASE WHEN second THEN ss[2] ELSE ss[1] END AS claim, CASE WHEN second THEN instr(text, ss[1]) - 1 + length(ss[1]) ELSE 0 END AS skip FROM f),
  p AS (SELECT *, CAST(CASE WHEN claim IS NULL THEN 0 ELSE skip + instr(substr(text, skip + 1), claim) - 1 END AS INTEGER) AS start FROM c)
  SELECT doc_id, start, CAST(start + coalesce(length(claim), 0) AS INTEGER) AS "end", CASE WHEN claim IS NULL THEN 'none' WHEN regexp_matches(claim, '{text.COMPOSITE}') THEN 'composite' ELSE 'diagnostic' END AS kind, coalesce(substr(text, start + 1, length(claim)) = claim, false) AS span_ok FROM p""")
def focal_claims(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", text.focal_claim("text").alias("c"))
    return d.select("doc_id", "c.start", "c.end", "c.kind", text.span_matches("text", "c.start", "c.end", "c.text").alias("span_ok"))


SIG = [("style", r"<style>[a-z]"), ("track", r"\btrack\s*\("), ("nav", r"<nav\b"), ("article", r"<article\b")]


@query(r"""WITH v AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '"(?:\\.|[^"\\])*"', '""', 'g'), '''(?:\\.|[^''\\])*''', '''''', 'g'), '(?s)/\*.*?\*/', ' ', 'g'), '//[^\n]*', ' ', 'g') AS v FROM pages)
  SELECT page_id, sha256(v) AS view_sha256, array_to_string(list_filter([CASE WHEN regexp_matches(v, '<style>[a-z]') THEN 'style' END, CASE WHEN regexp_matches(v, '\btrack\s*\(') THEN 'track' END, CASE WHEN regexp_matches(v, '<nav\b') THEN 'nav' END, CASE WHEN regexp_matches(v, '<article\b') THEN 'article' END], lambda x: x IS NOT NULL), '|') AS names FROM v""")
def page_signatures(spark, sf):
    v = table(spark, sf, "pages").select("page_id", signatures.syntax_view("html").alias("v"))
    return v.select("page_id", F.sha2("v", 256).alias("view_sha256"), text.joined(signatures.matched("v", tuple(SIG))).alias("names"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'Java' WHEN 2 THEN 'C++' WHEN 3 THEN 'C' ELSE 'AMBIGUOUS' END AS detected, CASE p_partkey % 5 WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'NON_C_JAVA' WHEN 2 THEN 'NON_C_CPP' WHEN 3 THEN 'CONFIRMED_C' ELSE 'AMBIGUOUS' END AS status,
  CASE p_partkey % 5 WHEN 0 THEN 'conflicting Java and C++ source signatures: Java Scanner; std namespace qualifier' WHEN 1 THEN 'Java-only source signatures: Java Scanner' WHEN 2 THEN 'C++-only source signatures: std namespace qualifier' WHEN 3 THEN 'C source signatures and no Java/C++-specific signature: C standard header; C stdio function' ELSE 'no decisive source-language signature found in either state' END AS reason FROM part""")
def source_languages(spark, sf):
    k = F.col("p_partkey") % 5
    code = F.when(k == 0, "new Scanner(x); std::cout").when(k == 1, "s = new Scanner(x);").when(k == 2, "std::sort(a)").when(k == 3, '#include <stdio.h>\nprintf("std::x")').otherwise("x = 1 // new Scanner(")
    return table(spark, sf, "part").select("p_partkey", signatures.classify_source(code, F.col("p_name")).alias("c")).select("p_partkey", "c.*")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE [0, 0, 124, 1, -9][CAST(event_id % 6 AS INTEGER) + 1] END AS rc, event_id % 6 = 1 AS other, event_id % 6 = 5 AS notrun, event_id % 12 = 8 AS infra FROM events)
  SELECT event_id, CASE WHEN notrun THEN 'NOT_RUN_COMPILE_ERROR' WHEN infra THEN 'INFRA_TIMEOUT' WHEN rc = 0 THEN CASE WHEN other THEN 'FAIL' ELSE 'PASS' END WHEN rc = 124 THEN 'PROGRAM_TIMEOUT' ELSE 'RUNTIME_ERROR' END AS status FROM e""")
def process_outcomes(spark, sf):
    m = (F.col("event_id") % 6).cast("int")
    e = table(spark, sf, "events").select("event_id", F.when(m == 5, F.lit(None)).otherwise(F.get(F.array(*map(F.lit, (0, 0, 124, 1, -9))), m)).alias("rc"), F.when(m == 1, F.lit("x")).otherwise(F.lit("a b \r\n\n")).alias("out"), (m != 5).alias("ran"), (F.col("event_id") % 12 == 8).alias("infra"))
    return e.select("event_id", text.process_status("rc", "out", F.lit("a b"), "ran", "infra").alias("status"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'INFRA_TIMEOUT' WHEN 2 THEN CASE WHEN event_id % 2 = 0 THEN 'PASS' ELSE 'FAIL' END WHEN 3 THEN 'PROGRAM_TIMEOUT' ELSE 'RUNTIME_ERROR' END AS status,
  CASE event_id % 5 WHEN 1 THEN 'host timeout while waiting for locked-down container' WHEN 3 THEN 'student program exceeded the in-container execution limit' WHEN 4 THEN 'non-zero process exit code: 7' END AS runtime_error FROM events""")
def status_normalisation(spark, sf):
    m = F.col("event_id") % 5
    raw = F.when(m == 0, "PASS").when(m == 1, "host_timeout").when(m == 2, "completed").otherwise("compile_or_runtime_failure")
    code = F.when(m == 2, 0).when(m == 3, 124).otherwise(7)
    e = table(spark, sf, "events").select("event_id", code.alias("code"), text.test_status(raw, code, F.col("event_id") % 2 == 0).alias("status"))
    return e.select("event_id", "status", text.runtime_error("status", F.lit(" "), "code").alias("runtime_error"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN NULL ELSE event_id END AS prompt_tokens, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 5 ELSE 9 END AS reasoning_tokens, CASE WHEN event_id % 7 <> 0 THEN 'stop' END AS finish_reason, 'm' AS model FROM events")
def response_telemetry(spark, sf):
    i = F.col("event_id").cast("string")
    details = F.when(F.col("event_id") % 3 == 0, '"completion_tokens_details":{"reasoning_tokens":5},').otherwise("")
    prompt = F.when(F.col("event_id") % 7 == 1, F.lit("-3")).otherwise(i)
    raw = F.when(F.col("event_id") % 7 == 0, '{"model":"m"}').otherwise(F.concat(F.lit('{"model":"m","usage":{'), details, F.lit('"reasoning_tokens":9,"prompt_tokens":'), prompt, F.lit('},"choices":[{"finish_reason":"stop"}]}')))
    e = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", responses.telemetry("raw").alias("t"), responses.returned_model("raw", F.lit("")).alias("model")).select("event_id", "t.prompt_tokens", "t.reasoning_tokens", "t.finish_reason", "model")


@query("""SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'response was not valid JSON' WHEN 2 THEN 'response keys do not match the fixed output schema' WHEN 3 THEN 'response has invalid lifecycle_label' WHEN 4 THEN 'response cited evidence IDs not supplied: z' WHEN 5 THEN 'response short_reason must be a non-empty string up to 2,000 characters' END AS error FROM events""")
def answer_contract(spark, sf):
    m, i = F.col("event_id") % 6, F.col("event_id").cast("string")
    body = F.concat(
        F.lit('{"item_id":"'), i, F.lit('","original_validity":"SUPPORTED","target_state_t1":"PRESENT","lifecycle_label":"'), F.when(m == 3, "MAYBE").otherwise("KEEP"), F.lit('","instructional_priority":"LOW","leakage_label":"ABSENT","evidence_ids":["a"'),
        F.when(m == 4, ',"z"').otherwise(""), F.lit('],"short_reason":"'), F.when(m == 5, " ").otherwise("because"), F.when(m == 2, '","more":"1"}').otherwise('"}'),
    )
    raw = F.when(m == 1, F.lit("no json")).when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    e = table(spark, sf, "events").select("event_id", raw.alias("raw"), i.alias("item"), F.array(F.lit("a"), F.lit("b")).alias("ids"))
    return e.select("event_id", responses.answer_error("raw", "item", "ids").alias("error"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'diagnostic' WHEN 1 THEN 'length_violation' WHEN 2 THEN 'non_diagnostic' WHEN 3 THEN 'error' ELSE 'model_mismatch' END AS status FROM events")
def generation_contract(spark, sf):
    m = F.col("event_id") % 5
    hint = F.when(m == 1, F.lit("too short")).otherwise(F.array_join(F.array_repeat(F.lit("word"), 25), " "))
    raw = F.when(m == 2, '{"generation_status":"non_diagnostic","diagnostic_claim":null,"hint":null,"target":null}').when(m == 3, '{"generation_status":"diagnostic","hint":"x"}').otherwise(F.concat(F.lit('{"generation_status":"diagnostic","diagnostic_claim":"c","target":null,"hint":"'), hint, F.lit('"}')))
    return table(spark, sf, "events").select("event_id", responses.generation_status(raw, F.lit("m"), F.when(m == 4, "other").otherwise("m")).alias("status"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey / CAST(c_custkey % 4 AS DOUBLE) END AS ratio, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE 100.0 * c_nationkey / (c_custkey % 4) END AS pct, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), c_mktsegment) AS first_text, c_custkey % 2 = 0 AS flag FROM customer")
def value_functions(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", text.divide("c_nationkey", k % 4).alias("ratio"), text.percent("c_nationkey", k % 4).alias("pct"), text.first_text(F.when(k % 3 == 0, "").otherwise(F.col("c_name")), "c_mktsegment").alias("first_text"), text.as_bool(F.when(k % 2 == 0, " Yes").otherwise("0")).alias("flag"))


@query("""SELECT lang, k, n, greatest(0, c - h) AS low, least(1, c + h) AS high FROM (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS c, z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n) AS h FROM (SELECT lang, count(*) FILTER (quality = 1) AS k, count(quality) AS n, count(*) FILTER (quality = 1) / CAST(count(quality) AS DOUBLE) AS p, CAST(1.959963984540054 AS DOUBLE) AS z FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1))""")
def wilson_intervals(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("quality").alias("n"))
    low, high = text.wilson("k", "n")
    return d.select("lang", "k", "n", low.alias("low"), high.alias("high"))


# ---------------------------------------------------------------- joins
@query("SELECT s_suppkey, coalesce(n_name, 'ineligible') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON s_nationkey = n_nationkey")
def dimension_lookup(spark, sf):
    return joins.lookup(table(spark, sf, "supplier"), "s_nationkey", table(spark, sf, "nation").filter("n_regionkey = 1"), "n_nationkey", "n_name", "nation", "ineligible").select("s_suppkey", "nation")


@query(f"""WITH {SUB}, m AS (SELECT 'sub_' || doc_id AS submission_id FROM labels) SELECT m.submission_id, a.submission_id IS NOT NULL AS found, b.submission_id IS NOT NULL AS next_found, b.submission_id AS next_id FROM m LEFT JOIN sub a ON a.submission_id = m.submission_id LEFT JOIN sub b ON b.user_id = a.user_id AND b.problem_id = a.problem_id AND b.attempt = a.attempt + 1""")
def manifest_join(spark, sf):
    m = table(spark, sf, "labels").select(F.concat(F.lit("sub_"), F.col("doc_id").cast("string")).alias("submission_id"))
    return joins.with_next_attempt(m, roles.submissions(spark, sf)).select("submission_id", "found", "next_found", "next_id")


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS only_left, 0::BIGINT AS only_right, count(*) FILTER (l.doc_id IS NOT NULL) AS both FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def id_set_comparison(spark, sf):
    return joins.set_compare(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unlabelled_documents(spark, sf):
    return ledger.unresolved(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT count(*) AS items, count(*) FILTER (m) AS matched, count(*) FILTER (m) / CAST(count(*) AS DOUBLE) AS match_rate FROM (SELECT coalesce(sha256(d.lang) = CASE WHEN l.doc_id % 3 = 0 THEN 'x' ELSE sha256(d.lang) END, false) AND l.doc_id IS NOT NULL AS m FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
def evidence_match(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("lang", 256).alias("h"))
    c = table(spark, sf, "labels").join(d, "doc_id").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("h")).alias("h"))
    return joins.match_rate(joins.evidence_match(d, c, "doc_id", "h"))


@query("SELECT doc_id, CASE WHEN doc_id <= 500 THEN 1 ELSE 2 END AS batch, coalesce(quality = 1, false) AS language_eligible FROM documents d LEFT JOIN labels l USING (doc_id)")
def cohort_freeze(spark, sf):
    m = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("selection_order"))
    qc = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "CONFIRMED_C").otherwise("AMBIGUOUS").alias("qc_status"))
    return joins.frozen_cohort(m, qc, "doc_id", 500).select("doc_id", "batch", "language_eligible")


# ---------------------------------------------------------------- similarity, components and splits
TOK = "tok AS (SELECT item_id AS k, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS s FROM benchmark)"


@query(f"""WITH {TOK} SELECT a.k AS a, b.k AS b, len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE) AS similarity FROM tok a JOIN tok b ON a.k < b.k WHERE len(list_intersect(a.s, b.s)) * 100 >= 15 * len(list_distinct(list_concat(a.s, b.s)))""")
def similar_problems(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", text.problem_tokens("text").alias("s"))
    return similarity.near_pairs(b, "item_id", "s", 15)


@query(None)
def near_duplicate_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.problem_tokens("text").alias("s"))
    return similarity.near_pairs(d, "doc_id", "s", 90, expand=False)


def _copies(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("a"))
    return d, d.join(first, "h").filter("doc_id > a").select("a", F.col("doc_id").alias("b"))


GROUPS = """g AS (SELECT doc_id, 'lg_' || substr(sha256(array_to_string(list_sort(m), '|')), 1, 12) AS leakage_group_id, CAST(len(m) AS INTEGER) AS leakage_group_size FROM (SELECT doc_id, list(CAST(o AS VARCHAR)) AS m FROM (SELECT a.doc_id, b.doc_id AS o FROM (SELECT doc_id, sha256(text) AS h FROM documents) a JOIN (SELECT doc_id, sha256(text) AS h FROM documents) b USING (h)) GROUP BY 1))"""


@query(f"WITH {GROUPS} SELECT * FROM g")
def leakage_groups(spark, sf):
    d, edges = _copies(spark, sf)
    return similarity.leakage_groups(d, "doc_id", edges)


def _near(spark, sf):
    """(members, pairs): each document with the first one of its token set, and the pairs of first ones of 0.9 and more.
    A null text has no tokens, as an empty one."""
    d = table(spark, sf, "documents").select("doc_id", text.problem_tokens(F.coalesce("text", F.lit(""))).alias("s"))
    members, pairs = similarity.near_classes(d, "doc_id", "s", 90)
    return members.withColumnRenamed("k", "doc_id"), pairs.select("a", "b")


@query(None)
def near_leakage_groups(spark, sf):
    """The groups that near copies make, as of problems in the reference; ``leakage_groups`` is that of exact copies."""
    members, pairs = _near(spark, sf)
    return similarity.class_leakage_groups(members, "doc_id", "first", pairs)


@query("""WITH k AS (SELECT DISTINCT source FROM documents), n AS (SELECT count(*) AS n FROM k), r AS (SELECT source, row_number() OVER (ORDER BY sha256('revground-problem-split-v1|' || source)) AS r FROM k) SELECT source, CASE WHEN r <= greatest(1, CAST(round_even(n * 0.2, 0) AS INTEGER)) THEN 'test' WHEN r <= 2 * greatest(1, CAST(round_even(n * 0.2, 0) AS INTEGER)) THEN 'validation' ELSE 'development' END AS split FROM r, n""")
def hash_split(spark, sf):
    return split.stable_split(table(spark, sf, "documents"), "source")


@query("""WITH RECURSIVE w AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, sha256('revground-problem-split-v1|' || source)) AS r FROM documents GROUP BY 1), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM w),
  f AS (SELECT CAST(0 AS BIGINT) AS r, CAST('' AS VARCHAR) AS source, CAST(0 AS BIGINT) AS n, '' AS split, 0.0::DOUBLE AS d, 0.0::DOUBLE AS v, 0.0::DOUBLE AS s UNION ALL
   SELECT w.r, w.source, w.n, p, d + CASE WHEN p = 'development' THEN w.n ELSE 0 END, v + CASE WHEN p = 'validation' THEN w.n ELSE 0 END, s + CASE WHEN p = 'test' THEN w.n ELSE 0 END FROM (SELECT f.*, w.r AS wr, CASE WHEN f.d / (t * 0.6) <= f.v / (t * 0.2) AND f.d / (t * 0.6) <= f.s / (t * 0.2) THEN 'development' WHEN f.v / (t * 0.2) <= f.s / (t * 0.2) THEN 'validation' ELSE 'test' END AS p FROM f, t, w WHERE w.r = f.r + 1) x JOIN w ON w.r = x.wr)
  SELECT source, n, split FROM f WHERE r > 0""")
def weighted_group_split(spark, sf):
    g = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return split.weighted_split(g, "source", "n")


def _split_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("h"), F.sha2(text.normalize_code("text"), 256).alias("w"))
    return d.join(F.broadcast(split.stable_split(d, "source")), "source")  # one row a source


SPLIT = f"""sp AS ({ORACLE_SQL["hash_split"]}), sd AS (SELECT doc_id, d.source, lang, sha256(text) AS h, sha256(regexp_replace(text, '{SPACE}', '', 'g')) AS w, split FROM documents d JOIN sp USING (source)),
  bad AS (SELECT hash, array_to_string(list_sort(list_distinct(list(split))), '|') AS splits FROM (SELECT split, h AS hash FROM sd UNION ALL SELECT split, w FROM sd) GROUP BY 1 HAVING count(DISTINCT split) > 1)"""


@query(f"WITH {SPLIT} SELECT * FROM bad")
def cross_split_hashes(spark, sf):
    return split.crossing_hashes(_split_docs(spark, sf), ["h", "w"])


@query(f"WITH {SPLIT} SELECT doc_id, h IN (SELECT hash FROM bad) OR w IN (SELECT hash FROM bad) AS cross_split_duplicate FROM sd")
def cross_split_exclusions(spark, sf):
    return split.exclude_crossing(_split_docs(spark, sf), ["h", "w"]).select("doc_id", "cross_split_duplicate")


@query(f"""WITH {SPLIT}, strict AS (SELECT * FROM sd WHERE h NOT IN (SELECT hash FROM bad) AND w NOT IN (SELECT hash FROM bad)), half AS (SELECT * FROM sd WHERE doc_id % 2 = 0 OR (h NOT IN (SELECT hash FROM bad) AND w NOT IN (SELECT hash FROM bad))),
  n AS (SELECT 'strict' AS rows, split, h AS x FROM strict UNION ALL SELECT 'strict', split, w FROM strict UNION ALL SELECT 'half', split, h FROM half UNION ALL SELECT 'half', split, w FROM half UNION ALL SELECT 'all', split, h FROM sd UNION ALL SELECT 'all', split, w FROM sd)
  SELECT rows, count(*) FILTER (k > 1) AS residual FROM (SELECT rows, x, count(DISTINCT split) AS k FROM n GROUP BY 1, 2) GROUP BY 1""")
def residual_overlap(spark, sf):
    """Codes in several parts: of all rows, of the strict ones, and where only rows of odd number were excluded."""
    marked = split.exclude_crossing(_split_docs(spark, sf), ["h", "w"])
    kinds = {"all": "true", "strict": "not cross_split_duplicate", "half": "doc_id % 2 = 0 or not cross_split_duplicate"}
    out = [split.crossing_hashes(marked.filter(rule), ["h", "w"]).agg(F.count("*").alias("residual")).select(F.lit(name).alias("rows"), "residual") for name, rule in kinds.items()]
    return out[0].union(out[1]).union(out[2])


@query(f"WITH {SPLIT} SELECT split, count(*) AS rows, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT h) AS texts FROM sd GROUP BY 1")
def split_audit(spark, sf):
    return split.audit(_split_docs(spark, sf), {"sources": "source", "langs": "lang", "texts": "h"})


@query(f"WITH {SPLIT} SELECT (SELECT max(n) <= 1 FROM (SELECT count(DISTINCT split) AS n FROM sd GROUP BY source)) AS passed")
def split_invariant(spark, sf):
    return split.one_split_each(_split_docs(spark, sf), "source")


@query(f"WITH {SPLIT}, p AS (SELECT min(doc_id) OVER (PARTITION BY h) AS a, doc_id AS b FROM sd) SELECT CAST(coalesce(sum(CASE WHEN x.split <> y.split THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations FROM p JOIN sd x ON x.doc_id = a JOIN sd y ON y.doc_id = b WHERE a < b")
def crossing_copies(spark, sf):
    return split.crossing_pairs(_copies(spark, sf)[1], _split_docs(spark, sf), "doc_id")


@query(None)
def crossing_near_copies(spark, sf):
    """All pairs of near copies across splits; ``crossing_copies`` counts exact copies against the first one alone."""
    members, pairs = _near(spark, sf)
    return split.crossing_classes(pairs, members, "first", _split_docs(spark, sf), "doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('s1|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 20")
def seeded_sample(spark, sf):
    return split.sample_keep_order(table(spark, sf, "documents"), "doc_id", "doc_id", 20, "s1").select("doc_id")


BOOT = f"""WITH {CLAIMS}, c AS (SELECT trajectory_id, CAST(sum(CASE WHEN NOT abstain AND predicted_label = gold_label THEN 1 ELSE 0 END) AS BIGINT) AS num, count(*) AS den FROM claims GROUP BY 1), s AS (SELECT row_number() OVER (ORDER BY trajectory_id) - 1 AS i, num, den FROM c), t AS (SELECT count(*) AS k, sum(num) AS n, sum(den) AS d FROM s),
  r AS (SELECT rep, ('0x' || substr(sha256('20260929|' || rep || '|' || draw), 1, 8))::BIGINT % k AS i FROM (SELECT k, unnest(range(40)) AS rep FROM t) JOIN (SELECT unnest(range(k)) AS draw FROM t) ON true), v AS (SELECT rep, 100 * CAST(sum(num) AS DOUBLE) / CAST(sum(den) AS DOUBLE) AS v FROM r JOIN s USING (i) GROUP BY rep)
  SELECT k AS clusters, 100 * CAST(n AS DOUBLE) / CAST(d AS DOUBLE) AS percent, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM t, v GROUP BY ALL"""


@query(BOOT)
def cluster_bootstrap(spark, sf):
    right = (~F.col("abstain") & (F.col("predicted_label") == F.col("gold_label"))).cast("long")
    return bootstrap.bootstrap_ratio(roles.claims(spark, sf), "trajectory_id", right, F.lit(1), 40)


def _bootstrap_sums(c: DataFrame) -> dict[str, DataFrame]:
    """Sums of each cluster for the share of right decisions and for the paired difference of C and B."""
    right = F.col("predicted_label") == F.col("gold_label")
    own = c.filter("status = 'success' and not abstain").groupBy("claim_id", "trajectory_id", "participant_id_hash")
    both = own.agg(*(F.max(F.when(F.col("method") == m, right.cast("long"))).alias(m) for m in "BC")).filter("B is not null and C is not null")
    tables = {"right": (c, (~F.col("abstain") & right).cast("long")), "c_minus_b": (both, F.col("C") - F.col("B"))}
    return {f"{name}|{cluster}": bootstrap.cluster_sums(df, cluster, num, F.lit(1)) for cluster in ("trajectory_id", "participant_id_hash") for name, (df, num) in tables.items()}


def _named_intervals(df: DataFrame) -> DataFrame:
    parts = F.split("statistic", r"\|")
    return df.select(parts[0].alias("statistic"), parts[1].alias("cluster"), "clusters", "percent", "low", "high")


@query(None)
def cluster_bootstrap_intervals(spark, sf):
    """The reference's 10,000 resamples of trajectories and of participants, for the share of right decisions and for
    the paired difference of C and B; ``cluster_bootstrap`` has 40, as its SQL."""
    return _named_intervals(bootstrap.intervals(spark, _bootstrap_sums(roles.claims(spark, sf)), hashed=True))


@query(None)
def published_intervals(spark, sf):
    """The reference's own draws, those of ``random.choices``: the share of retired claims among those of known gold label,
    and the paired difference of C and B in two runs (claims of odd and of even number), by trajectory and participant."""
    c = roles.claims(spark, sf)
    known = c.filter("method = 'B' and gold_label <> 'UNSURE'")
    sums = {f"retired|{k}": bootstrap.cluster_sums(known, k, (F.col("gold_label") == "RETIRE").cast("long"), F.lit(1)) for k in ("trajectory_id", "participant_id_hash")}
    for run in (0, 1):
        own = _bootstrap_sums(c.filter(F.col("claim_id") % 2 == run))
        sums |= {f"{name.replace('c_minus_b', f'c_minus_b_run{run}')}": df for name, df in own.items() if name.startswith("c_minus_b")}
    return _named_intervals(bootstrap.intervals(spark, sums))


# ---------------------------------------------------------------- agreement, decisions and metrics
FIELDS = {"validity": ("validity_a", "validity_b"), "priority": ("priority_a", "priority_b")}


@query(f"WITH {ANN} SELECT x AS validity_a, y AS validity_b, count(doc_id) AS n FROM (VALUES ('YES'), ('NO'), ('MAYBE')) v(x), (VALUES ('YES'), ('NO'), ('MAYBE')) u(y) LEFT JOIN ann ON validity_a = x AND validity_b = y GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return agreement.confusion(roles.annotators(spark, sf), "validity_a", "validity_b", ["YES", "NO", "MAYBE"])


@query(f"""WITH {ANN}, l AS (SELECT 'validity' AS field, validity_a AS a, validity_b AS b FROM ann UNION ALL SELECT 'priority', priority_a, priority_b FROM ann), t AS (SELECT field, count(*) AS items, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS agreements FROM l GROUP BY 1),
  e AS (SELECT field, sum(na * nb) AS p FROM (SELECT field, a, count(*) AS na FROM l GROUP BY 1, 2) x JOIN (SELECT field, b AS a, count(*) AS nb FROM l GROUP BY 1, 2) y USING (field, a) GROUP BY 1)
  SELECT field, items, agreements, agreements / CAST(items AS DOUBLE) AS observed, p / (CAST(items AS DOUBLE) * items) AS expected, (agreements / CAST(items AS DOUBLE) - p / (CAST(items AS DOUBLE) * items)) / (1 - p / (CAST(items AS DOUBLE) * items)) AS kappa FROM t JOIN e USING (field)""")
def cohen_kappa(spark, sf):
    return agreement.kappa(roles.annotators(spark, sf), FIELDS)


@query(f"WITH {ANN} SELECT doc_id, CASE WHEN validity_a <> validity_b AND priority_a <> priority_b THEN 'validity|priority' WHEN validity_a <> validity_b THEN 'validity' ELSE 'priority' END AS fields_differing FROM ann WHERE validity_a <> validity_b OR priority_a <> priority_b")
def disagreements(spark, sf):
    return agreement.disagreements(roles.annotators(spark, sf), FIELDS).select("doc_id", "fields_differing")


@query(f"WITH {ANN} SELECT count(*) AS items, CAST(sum(CASE WHEN validity_a = validity_b AND priority_a = priority_b THEN 1 ELSE 0 END) AS BIGINT) AS all_agree FROM ann")
def joint_agreement(spark, sf):
    return agreement.joint_agreement(roles.annotators(spark, sf), FIELDS)


@query(f"WITH {ANN} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE validity_a END AS label, CASE WHEN doc_id % 4 = 0 THEN 'adj' ELSE priority_a END AS why, doc_id % 4 = 0 AS adjudicated FROM ann")
def adjudication_overlay(spark, sf):
    base = roles.annotators(spark, sf).select("doc_id", F.col("validity_a").alias("label"), F.col("priority_a").alias("why"))
    return agreement.overlay(base, base.filter("doc_id % 4 = 0").select("doc_id", F.lit(None).cast("string").alias("label"), F.lit("adj").alias("why")), "doc_id")


EXPECTED = "CASE WHEN original_validity = 'REFUTED' THEN 'RETRACT' WHEN original_validity = 'SUPPORTED' AND target_state_t1 = 'PRESENT' THEN 'KEEP' WHEN original_validity = 'SUPPORTED' AND target_state_t1 = 'RESOLVED' THEN 'RETIRE' ELSE 'UNSURE' END"
VIOL = f"""v AS (SELECT *, {EXPECTED} AS e, list_filter([CASE WHEN original_validity = 'REFUTED' AND target_state_t1 <> 'NOT_APPLICABLE' THEN 'REFUTED original claim requires target_state_t1=NOT_APPLICABLE' END, CASE WHEN original_validity = 'SUPPORTED' AND target_state_t1 = 'NOT_APPLICABLE' THEN 'SUPPORTED original claim cannot use target_state_t1=NOT_APPLICABLE' END,
  CASE WHEN original_validity = 'INDETERMINATE' AND target_state_t1 <> 'INDETERMINATE' THEN 'INDETERMINATE original claim requires target_state_t1=INDETERMINATE' END, CASE WHEN abstain AND lifecycle_label <> 'UNSURE' THEN 'abstain=true requires lifecycle_label=UNSURE' END, CASE WHEN NOT abstain AND lifecycle_label <> {EXPECTED} THEN 'Lifecycle output inconsistent with decision table; expected ' || {EXPECTED} || ', got ' || lifecycle_label END], lambda x: x IS NOT NULL) AS viol FROM dec)"""


@query(f"WITH {DEC} SELECT item_id, {EXPECTED} AS expected FROM dec")
def decision_table(spark, sf):
    return roles.decisions(spark, sf).select("item_id", decisions.expected_lifecycle("original_validity", "target_state_t1").alias("expected"))


@query(f"""WITH {DEC}, {VIOL} SELECT item_id, original_validity, target_state_t1, lifecycle_label AS model_lifecycle_label, e AS rule_expected_lifecycle, len(viol) > 0 AS decision_rule_violation, CASE WHEN len(viol) > 0 OR abstain THEN 'UNSURE' ELSE lifecycle_label END AS lifecycle_label, len(viol) > 0 OR abstain AS abstain,
  CASE WHEN len(viol) > 0 THEN array_to_string(viol, '; ') ELSE abstention_reason END AS abstention_reason, CASE WHEN len(viol) > 0 THEN 'RULE_VIOLATION_ABSTAINED' WHEN abstain THEN 'ABSTAINED' ELSE 'PASS' END AS decision_validation FROM v""")
def decision_validation(spark, sf):
    return decisions.validate(roles.decisions(spark, sf))


@query(f"""WITH {DEC}, {VIOL}, f AS (SELECT item_id, lifecycle_label AS predicted_label, len(viol) > 0 OR abstain AS a, lifecycle_label AS l FROM v) SELECT item_id, 'C' AS condition, predicted_label, a AS abstain, CASE WHEN a THEN 'UNSURE' ELSE l END AS final_action FROM f""")
def normalised_predictions(spark, sf):
    return decisions.normalise(decisions.validate(roles.decisions(spark, sf)), "C")


@query(f"WITH {DEC} SELECT item_id, 'UNSURE' AS lifecycle_label, true AS abstain, 'DETERMINISTIC_PACKET_ABSTENTION' AS decision_validation, 'a is missing; b is missing' AS abstention_reason, 'x|y' AS evidence_ids FROM dec")
def packet_abstentions(spark, sf):
    d = roles.decisions(spark, sf).select("item_id", F.array(F.lit("y"), F.lit("x")).alias("ids"), F.array(F.lit("a is missing"), F.lit("b is missing")).alias("issues"))
    return decisions.deterministic_abstention(d, "item_id", "ids", "issues").select("item_id", "lifecycle_label", "abstain", "decision_validation", "abstention_reason", text.joined("evidence_ids").alias("evidence_ids"))


def _score_sql(group: str, level: str) -> str:
    c = {
        "n": "true", "abstentions": "abstain", "invalid_or_failed": "status <> 'success'", "unsafe": "gold_label IN ('RETIRE', 'RETRACT')", "false_keep": "gold_label IN ('RETIRE', 'RETRACT') AND NOT abstain AND predicted_label = 'KEEP'",
        "decidable": "gold_label <> 'UNSURE'", "actions": "gold_label <> 'UNSURE' AND NOT abstain", "wrong_actions": "gold_label <> 'UNSURE' AND NOT abstain AND predicted_label <> gold_label", "keeps": "gold_label = 'KEEP'",
        "keep_correct": "gold_label = 'KEEP' AND NOT abstain AND predicted_label = 'KEEP'", "wrongful_removal": "gold_label = 'KEEP' AND NOT abstain AND predicted_label IN ('RETIRE', 'RETRACT')", "retract_predicted": "NOT abstain AND predicted_label = 'RETRACT'",
        "retract_correct": "NOT abstain AND predicted_label = 'RETRACT' AND gold_label = 'RETRACT'", "retracts": "gold_label = 'RETRACT'", "gold_unsure": "gold_label = 'UNSURE'", "unsure_withheld": "gold_label = 'UNSURE' AND (abstain OR predicted_label = 'UNSURE')",
        "confident_on_unsure": "gold_label = 'UNSURE' AND NOT abstain AND predicted_label <> 'UNSURE' AND confidence >= 0.7",
    }
    for x in decisions.LABELS:
        c |= {f"tp_{x}": f"NOT abstain AND gold_label = '{x}' AND predicted_label = '{x}'", f"fp_{x}": f"NOT abstain AND gold_label <> '{x}' AND predicted_label = '{x}'", f"fn_{x}": f"gold_label = '{x}' AND (abstain OR predicted_label <> '{x}')"}
    counts = ", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in c.items())
    return f"SELECT {level} AS level, {group}, {counts}, count(latency_ms) AS latencies, coalesce(sum(latency_ms), 0) AS latency_sum, coalesce(sum(estimated_cost_usd), 0) AS estimated_cost_usd FROM claims GROUP BY ALL"


def _rates_sql(inner: str, keys: str) -> str:
    r = {"false_keep_rate": "false_keep/unsafe", "decision_coverage": "actions/decidable", "selective_risk": "wrong_actions/actions", "keep_recall": "keep_correct/keeps", "retraction_precision": "retract_correct/retract_predicted", "unsure_withheld_rate": "unsure_withheld/gold_unsure", "mean_latency_ms": "latency_sum/latencies"}
    rates = ", ".join(f"{a}::DOUBLE / nullif({b}, 0) AS {k}" for k, (a, b) in ((k, v.split("/")) for k, v in r.items()))
    f1 = ", ".join(f"2 * tp_{x}::DOUBLE / nullif(2 * tp_{x} + fp_{x} + fn_{x}, 0)" for x in decisions.LABELS)
    return f"SELECT {keys}, n, abstentions, invalid_or_failed, false_keep, confident_on_unsure, estimated_cost_usd, {rates}, list_sum(list_filter([{f1}], lambda x: x IS NOT NULL)) / nullif(len(list_filter([{f1}], lambda x: x IS NOT NULL)), 0) AS macro_f1 FROM ({inner})"


SCORES = ("n", "abstentions", "invalid_or_failed", "false_keep", "confident_on_unsure", "estimated_cost_usd", "false_keep_rate", "decision_coverage", "selective_risk", "keep_recall", "retraction_precision", "unsure_withheld_rate", "mean_latency_ms", "macro_f1")


@query(f"WITH {CLAIMS} " + _rates_sql(_score_sql("method", "'overall'"), "method"))
def selective_scores(spark, sf):
    return metrics.score(roles.claims(spark, sf), "method").select("method", *SCORES)


@query(f"WITH {CLAIMS} " + _rates_sql(" UNION ALL ".join([
    _score_sql("method, NULL::VARCHAR AS problem_family_id, NULL::VARCHAR AS problem_id", "'overall'"), _score_sql("method, problem_family_id, NULL::VARCHAR AS problem_id", "'family'"), _score_sql("method, NULL::VARCHAR AS problem_family_id, problem_id", "'problem'"),
]), "level, method, problem_family_id, problem_id"))
def method_evaluation(spark, sf):
    return metrics.evaluate(roles.claims(spark, sf)).select("level", "method", "problem_family_id", "problem_id", *SCORES)


@query("SELECT unnest(['unique_claim_method', 'identical_claim_sets', 'constant_gold_label', 'constant_trajectory_id', 'constant_participant_id_hash', 'constant_problem_id', 'constant_problem_family_id']) AS \"check\", true AS passed")
def evaluation_integrity(spark, sf):
    return metrics.integrity(roles.claims(spark, sf))


@query(f"""WITH {CLAIMS}, x AS (SELECT * REPLACE (CASE WHEN method = 'C' AND claim_id % 500 = 3 THEN 'p-other' ELSE problem_id END AS problem_id) FROM claims WHERE NOT (method = 'B' AND claim_id % 1000 = 6) UNION ALL SELECT * FROM claims WHERE claim_id % 2000 = 4),
  c AS (SELECT claim_id, count(*) <> count(DISTINCT method) AS twice, count(DISTINCT method) < 2 AS alone, count(DISTINCT gold_label) > 1 AS g, count(DISTINCT trajectory_id) > 1 AS t, count(DISTINCT participant_id_hash) > 1 AS u, count(DISTINCT problem_id) > 1 AS p, count(DISTINCT problem_family_id) > 1 AS f FROM x GROUP BY 1)
  SELECT unnest(['unique_claim_method', 'identical_claim_sets', 'constant_gold_label', 'constant_trajectory_id', 'constant_participant_id_hash', 'constant_problem_id', 'constant_problem_family_id']) AS "check", unnest([NOT bool_or(twice), NOT bool_or(alone), NOT bool_or(g), NOT bool_or(t), NOT bool_or(u), NOT bool_or(p), NOT bool_or(f)]) AS passed FROM c""")
def evaluation_violations(spark, sf):
    """Claims of which some occur twice, some lack a method and some have two problems."""
    c = roles.claims(spark, sf)
    other = F.when((F.col("method") == "C") & (F.col("claim_id") % 500 == 3), "p-other").otherwise(F.col("problem_id"))
    x = c.filter("not (method = 'B' and claim_id % 1000 = 6)").withColumn("problem_id", other).unionByName(c.filter("claim_id % 2000 = 4"))
    return metrics.integrity(x)


@query(f"""WITH {CLAIMS}, p AS (SELECT claim_id, bool_or(method = 'B' AND NOT abstain AND predicted_label = 'KEEP') AS b, bool_or(method = 'C' AND NOT abstain AND predicted_label = 'KEEP') AS c FROM claims WHERE gold_label IN ('RETIRE', 'RETRACT') GROUP BY 1)
  SELECT count(*) AS eligible, count(*) FILTER (b AND NOT c) AS "B_only_error", count(*) FILTER (c AND NOT b) AS "C_only_error", count(*) FILTER (b AND c) AS both_error, count(*) FILTER (NOT b AND NOT c) AS neither_error FROM p""")
def paired_false_keep(spark, sf):
    return metrics.paired_false_keep(roles.claims(spark, sf))


def _gold(spark, sf):
    c = roles.claims(spark, sf)
    gold = c.filter("method = 'B'").select(F.col("claim_id").alias("item_id"), F.col("gold_label").alias("gold"), "problem_id")
    return gold, c.filter("status = 'success'").select(F.col("claim_id").alias("item_id"), F.col("method").alias("condition"), F.col("predicted_label").alias("label"), "abstain", (F.col("claim_id") % 2).alias("model"))


USABLE = f"""{CLAIMS}, u AS (SELECT claim_id, method AS condition, predicted_label AS label, abstain, gold_label AS gold, problem_id, claim_id % 2 AS model FROM claims WHERE status = 'success'), g AS (SELECT count(*) AS t, count(*) FILTER (gold_label = 'KEEP') AS k, count(*) FILTER (gold_label = 'RETRACT') AS r FROM base)"""


@query(f"""WITH {USABLE}, m AS (SELECT model, condition, count(*) AS usable, count(*) FILTER (NOT abstain) AS decisions, count(*) FILTER (NOT abstain AND label = gold) AS correct, count(*) FILTER (NOT abstain AND label = 'KEEP' AND gold <> 'KEEP') AS false_keep, count(*) FILTER (NOT abstain AND label = 'RETRACT' AND gold = 'RETRACT') AS rt, count(*) FILTER (NOT abstain AND label = 'RETRACT') AS rp FROM u GROUP BY 1, 2)
  SELECT model, condition, usable, decisions, usable - decisions AS abstentions, correct, false_keep, 100.0::DOUBLE * correct / decisions AS accuracy_percent, 100.0::DOUBLE * usable / t AS availability_percent, 100.0::DOUBLE * decisions / t AS coverage_percent, 100.0::DOUBLE * (decisions - correct) / decisions AS risk_percent, 100.0::DOUBLE * false_keep / (t - k) AS false_keep_percent, 200.0::DOUBLE * rt / (rp + r) AS retract_f1_percent FROM m, g""")
def condition_scores(spark, sf):
    gold, pred = _gold(spark, sf)
    return metrics.condition_metrics(gold.drop("problem_id"), pred, "model", "condition").select("model", "condition", "usable", "decisions", "abstentions", "correct", "false_keep", "accuracy_percent", "availability_percent", "coverage_percent", "risk_percent", "false_keep_percent", "retract_f1_percent")


PAIRED = f"""{USABLE}, p AS (SELECT b.model, b.claim_id, b.label AS b, c.label AS c, b.gold, b.problem_id FROM u b JOIN u c ON b.claim_id = c.claim_id AND b.condition = 'B' AND c.condition = 'C' WHERE NOT b.abstain AND NOT c.abstain),
  x AS (SELECT model, count(*) AS paired, count(*) FILTER (b = gold) AS b_correct, count(*) FILTER (c = gold) AS c_correct, count(*) FILTER (b = gold AND c = gold) AS both_correct, count(*) FILTER (b = gold AND c <> gold) AS b_only_correct, count(*) FILTER (b <> gold AND c = gold) AS c_only_correct, count(*) FILTER (b <> gold AND c <> gold) AS both_wrong, count(*) FILTER (b = c) AS label_agreement,
  count(*) FILTER (b = 'KEEP' AND gold <> 'KEEP') AS b_false_keep, count(*) FILTER (c = 'KEEP' AND gold <> 'KEEP') AS c_false_keep, array_to_string(list_sort(list_distinct(list(problem_id) FILTER (b = gold AND c <> gold))), ',') AS b_only FROM p GROUP BY 1)"""
PAIR_COLS = ("paired", "b_correct", "c_correct", "both_correct", "b_only_correct", "c_only_correct", "both_wrong", "label_agreement", "b_false_keep", "c_false_keep")


@query(f"WITH {PAIRED} SELECT model, {', '.join(PAIR_COLS)}, 100.0::DOUBLE * (c_correct - b_correct) / paired AS c_minus_b_points, b_only FROM x")
def paired_conditions(spark, sf):
    gold, pred = _gold(spark, sf)
    return metrics.paired_metrics(gold, pred, "model").select("model", *PAIR_COLS, "c_minus_b_points", F.array_join("b_only_problems", ",").alias("b_only"))


@query(f"WITH {PAIRED} SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in PAIR_COLS)}, 100.0::DOUBLE * (sum(c_correct) - sum(b_correct)) / sum(paired) AS c_minus_b_points FROM x")
def pooled_conditions(spark, sf):
    gold, pred = _gold(spark, sf)
    return metrics.pooled(metrics.paired_metrics(gold, pred, "model"), list(PAIR_COLS))


# ---------------------------------------------------------------- run ledgers
FIRST = f"{RUNS}, fa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS rr FROM runs) WHERE rr = 1)"


@query(f"WITH {FIRST} SELECT item_id, event_id, outcome, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS sequence FROM fa")
def first_attempts(spark, sf):
    return ledger.first_attempts(roles.runs(spark, sf), ["user_id", "k"], ["event_id"]).select("item_id", "event_id", "outcome", "sequence")


@query(f"""WITH {RUNS}, l AS (SELECT unnest(['outcome', 'http_status', 'error_type', 'returned_model']) AS field, coalesce(unnest([outcome, CAST(http_status AS VARCHAR), error_type, returned_model]), '<MISSING>') AS value FROM runs) SELECT field, value, count(*) AS n FROM l GROUP BY 1, 2""")
def ledger_counters(spark, sf):
    return ledger.counters(roles.runs(spark, sf), ["outcome", "http_status", "error_type", "returned_model"])


@query(f"""WITH {RUNS} SELECT user_id, count(*) AS requests, count(total_tokens) AS with_usage, avg(latency_ms) AS mean_latency, min(latency_ms) AS min_latency, max(latency_ms) AS max_latency, list_sort(list(latency_ms))[CAST(count(*) // 2 + 1 AS INTEGER)] AS median_latency, CASE WHEN count(*) = count(total_tokens) THEN CAST(sum(total_tokens) AS BIGINT) END AS tokens FROM runs GROUP BY 1""")
def usage_summary(spark, sf):
    return ledger.usage_summary(roles.runs(spark, sf), "user_id")


@query(f"""WITH {RUNS} SELECT user_id, CASE WHEN count(DISTINCT coalesce(CAST(nullif(http_status, 500) AS VARCHAR), 'none')) = 1 THEN max(nullif(http_status, 500)) END AS exit_code, bool_or(http_status = 429) AS timed_out, sum(latency_ms) AS runtime_ms FROM runs GROUP BY 1""")
def termination_summary(spark, sf):
    r = roles.runs(spark, sf).withColumns({"exit_code": F.nullif("http_status", F.lit(500)), "timed_out": F.col("http_status") == 429})
    return ledger.termination(r, "user_id", runtime="latency_ms")


@query(f"""WITH {FIRST}, e AS (SELECT item_id FROM fa), p AS (SELECT item_id FROM fa WHERE outcome = 'accepted'), r AS (SELECT item_id FROM fa WHERE outcome = 'error' AND http_status = 429) SELECT count(*) AS expected, CAST(count(*) FILTER (p.item_id IS NULL AND r.item_id IS NULL) AS BIGINT) AS missing, 0::BIGINT AS unexpected, 0::BIGINT AS in_both, 0::BIGINT AS repeated, count(*) FILTER (p.item_id IS NULL AND r.item_id IS NULL) = 0 AS passed FROM e LEFT JOIN p USING (item_id) LEFT JOIN r USING (item_id)""")
def outcome_coverage(spark, sf):
    f = ledger.first_attempts(roles.runs(spark, sf), ["user_id", "k"], ["event_id"])
    return ledger.coverage(f, f.filter("outcome = 'accepted'"), f.filter("outcome = 'error' and http_status = 429"), "item_id")


SECOND = f"{FIRST}, sa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS rr FROM runs) WHERE rr = 2)"


@query(f"WITH {SECOND} SELECT fa.item_id, fa.http_status AS selected_from_primary_http_status, 2 AS attempt_number, coalesce(sa.outcome, 'missing') AS outcome, sa.http_status FROM fa LEFT JOIN sa ON fa.item_id = sa.item_id WHERE fa.http_status = 429")
def recovery_ledger(spark, sf):
    from pyspark.sql import Window

    r = roles.runs(spark, sf)
    second = r.withColumn("rr", F.row_number().over(Window.partitionBy("user_id", "k").orderBy("event_id"))).filter("rr = 2")
    return ledger.recovery(ledger.first_attempts(r, ["user_id", "k"], ["event_id"]), second, "item_id")


@query(f"WITH {RUNS} SELECT event_id FROM runs WHERE item_id NOT IN (SELECT item_id FROM runs WHERE outcome = 'accepted')")
def unresolved_intents(spark, sf):
    r = roles.runs(spark, sf)
    return ledger.unresolved(r, r.filter("outcome = 'accepted'"), "item_id").select("event_id")


@query(f"WITH {RUNS} SELECT item_id, max(event_id) AS event_id FROM runs GROUP BY 1")
def last_wins_union(spark, sf):
    r = roles.runs(spark, sf).select("item_id", "event_id")
    return ledger.last_wins(ledger.combine([r.filter("event_id < 300"), r.filter("event_id >= 300")], "item_id"), "item_id", "event_id").select("item_id", "event_id")


@query(f"WITH {RUNS} SELECT unnest(['requested_model', 'returned_model']) AS field, unnest([1, (SELECT count(DISTINCT coalesce(returned_model, '<MISSING>')) FROM runs)]) AS values, unnest([true, false]) AS passed")
def constant_settings(spark, sf):
    return ledger.constant_settings(roles.runs(spark, sf), ["requested_model", "returned_model"])


@query(f"WITH {FIRST}, u AS (SELECT item_id, max(total_tokens) AS t, max(returned_model) AS m, min(user_id) AS u FROM runs GROUP BY 1) SELECT item_id, event_id, CASE WHEN event_id % 3 = 0 THEN t ELSE total_tokens END AS total_tokens, CASE WHEN event_id % 3 = 0 THEN m ELSE returned_model END AS returned_model, u AS billed_user FROM fa LEFT JOIN u USING (item_id)")
def metadata_backfill(spark, sf):
    """First attempts of which a third lost tokens and model, filled in from the usage rows of all attempts, which repeat;
    the user is a new field."""
    r = roles.runs(spark, sf)
    lost = lambda c: F.when(F.col("event_id") % 3 != 0, F.col(c)).alias(c)
    first = ledger.first_attempts(r, ["user_id", "k"], ["event_id"]).select("item_id", "event_id", lost("total_tokens"), lost("returned_model"))
    usage = r.select("item_id", "total_tokens", "returned_model", F.col("user_id").alias("billed_user"))
    return ledger.enrich(first, usage, "item_id", ["total_tokens", "returned_model", "billed_user"])


@query("SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def interrupted_attempts(spark, sf):
    """Labels as the log, documents of even number as attempts: those that were never logged get a row."""
    d = table(spark, sf, "documents").filter("doc_id % 2 = 0").select("doc_id")
    return ledger.add_interrupted(table(spark, sf, "labels").select("doc_id", "quality"), d, "doc_id")


@query("SELECT w AS item, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark) GROUP BY 1")
def issue_histogram(spark, sf):
    return ledger.exploded_counts(table(spark, sf, "benchmark").select(text.problem_tokens("text").alias("w")), "w")


@query(f"WITH {DEC} SELECT item_id FROM dec WHERE original_validity = 'SUPPORTED' AND CAST(item_id AS BIGINT) IN (SELECT doc_id FROM labels)")
def stage_inputs(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("item_id"))
    return roles.decisions(spark, sf).filter("original_validity = 'SUPPORTED'").join(lab, "item_id", "left_semi").select("item_id")


# ---------------------------------------------------------------- nested packets
LI = "li AS (SELECT l_orderkey, l_linenumber, sum(l_partkey) AS p, sum(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), pk AS (SELECT 'i' || o_orderkey AS item_id, 'p' || o_custkey AS problem_id, o_orderkey, count(*) AS n, list(l_linenumber ORDER BY l_linenumber) AS lines FROM orders JOIN li ON o_orderkey = l_orderkey GROUP BY ALL)"


@query(f"WITH {LI} SELECT item_id, CAST(n AS INTEGER) AS tests, CAST(7 + 3 * n AS INTEGER) AS ids, 'official_test:' || problem_id || '_T' || lines[1] AS first_test FROM pk")
def packet_construction(spark, sf):
    p = roles.packets(spark, sf)
    return p.select("item_id", F.size("tests").alias("tests"), F.size("all_evidence_ids").alias("ids"), F.get("tests", F.lit(0)).official_evidence_id.alias("first_test"))


@query(f"""WITH {LI} SELECT item_id, CASE WHEN o_orderkey % 50 = 0 THEN 'focal claim is missing' ELSE '' END AS issues FROM pk""")
def packet_issues(spark, sf):
    return packets.issues(roles.packets(spark, sf)).select("item_id", text.joined("issues").alias("issues"))


#: What packets lose in ``packet_issue_kinds``, by their number, and the issue of it; "{i}" is the number of each test.
ISSUE_KINDS = [
    "problem statement is missing", "S_t code is missing", "S_t+1 code is missing", "packet is not explicitly marked packet_prepared_without_method_predictions=true", "all_evidence_ids is missing or malformed",
    "compiler evidence earlier entry is missing", "compiler evidence later is missing an evidence ID", "compiler evidence earlier references an evidence ID not supplied in the packet: x", "compiler evidence later has no completed status",
    "official tests are missing or empty", "test {i} is missing an evidence ID", "test {i} later result is missing", "test {i} earlier result has no completed status", "test {i} earlier result is missing an evidence ID",
    "test {i} later result references an evidence ID not supplied in the packet: y", "test {i} earlier result is indistinguishable from compiler evidence",
]


def _issue_sql() -> str:
    def each(x: str) -> str:
        a, b = x.split("{i}")
        return f"list_transform(range(n), lambda i: '{a}' || i || '{b}')"

    cases = " ".join(f"WHEN {m} THEN {each(x) if '{i}' in x else f"['{x}']"}" for m, x in enumerate(ISSUE_KINDS) if m)
    return f"""WITH {LI} SELECT item_id, array_to_string(list_concat(list_concat(CASE WHEN o_orderkey % 17 = 0 THEN ['{ISSUE_KINDS[0]}'] ELSE [] END, CASE WHEN o_orderkey % 50 = 0 THEN ['focal claim is missing'] ELSE [] END), CASE o_orderkey % 17 {cases} ELSE [] END), '|') AS issues FROM pk"""


@query(_issue_sql())
def packet_issue_kinds(spark, sf):
    p, m = roles.packets(spark, sf), F.substring("item_id", 2, 20).cast("long") % 17
    none = F.lit(None)

    def bad(k: int, damaged: Column, good: str | Column) -> Column:
        good = F.col(good) if isinstance(good, str) else good
        return F.when(m != k, good).otherwise(damaged)

    def entry(e: Column, kinds: dict[str, tuple[int, Column]], whole: int | None = None) -> Column:
        """A result with one field or all of it damaged."""
        out = F.struct(*(bad(*kinds[c], e[c]).alias(c) if c in kinds else e[c].alias(c) for c in ("evidence_id", "status")))
        return out if whole is None else F.when(m != whole, out)

    def test(t: Column) -> Column:
        first = F.when(m == 13, none).when(m == 15, F.col("compiler.earlier.evidence_id")).otherwise(t.earlier.evidence_id)
        early = F.struct(first.alias("evidence_id"), bad(12, F.lit(" "), t.earlier.status).alias("status"))
        late = entry(t.later, {"evidence_id": (14, F.lit("y"))}, 11)
        return F.struct(t.test_case_id.alias("test_case_id"), bad(10, none, t.official_evidence_id).alias("official_evidence_id"), t.input.alias("input"), t.expected_output.alias("expected_output"), early.alias("earlier"), late.alias("later"))

    c = F.col("compiler")
    p = p.select(
        "item_id", bad(0, F.lit("  "), "problem_statement").alias("problem_statement"), "claim_span",
        F.col("earlier").withField("source", bad(1, none, "earlier.source")).alias("earlier"), F.col("later").withField("source", bad(2, F.lit(" "), "later.source")).alias("later"),
        bad(3, none, "packet_prepared_without_method_predictions").alias("packet_prepared_without_method_predictions"), bad(4, none, "all_evidence_ids").alias("all_evidence_ids"),
        F.struct(entry(c.earlier, {"evidence_id": (7, F.lit("x"))}, 5).alias("earlier"), entry(c.later, {"evidence_id": (6, none), "status": (8, none)}).alias("later")).alias("compiler"),
        F.when(m != 9, F.transform("tests", test)).alias("tests"),
    )
    return packets.issues(p).select("item_id", text.joined("issues").alias("issues"))


@query(f"""WITH {LI} SELECT item_id, CAST(5 + 3 * n AS INTEGER) AS available, true AS ids_listed FROM pk""")
def packet_projection(spark, sf):
    return packets.project(roles.packets(spark, sf)).select("item_id", F.size("available_evidence_ids").alias("available"), "ids_listed")


@query(f"""WITH {LI} SELECT item_id, true AS intact, false AS intact_after_change FROM pk""")
def packet_seals(spark, sf):
    p = packets.sealed(roles.packets(spark, sf).select("item_id", "problem_id", "problem_statement", "tests"))
    a = p.select("item_id", packets.seal_intact(p).alias("intact"))
    changed = p.withColumn("problem_statement", F.concat("problem_statement", F.lit("!")))
    return a.join(changed.select("item_id", packets.seal_intact(changed).alias("intact_after_change")), "item_id")


@query(f"""WITH {LI} SELECT item_id, CAST(len(list_filter(lines, lambda x: x % 2 = 0)) AS INTEGER) AS later_pass, CAST(n AS INTEGER) AS earlier_open FROM pk""")
def packet_replay(spark, sf):
    p = roles.packets(spark, sf).select("item_id", "tests")
    runs = p.select("item_id", F.explode("tests.test_case_id").alias("test_case_id")).filter(F.regexp_extract("test_case_id", r"_T(\d+)$", 1).cast("int") % 2 == 0).select("item_id", "test_case_id", F.lit("st1").alias("state"), F.lit("PASS").alias("status"))
    out = packets.replayed(p, runs)
    n = lambda side, s: F.size(F.filter("tests", lambda t: t[side].status == s))
    return out.select("item_id", n("later", "PASS").alias("later_pass"), n("earlier", "NOT_REPLAYED").alias("earlier_open"))


def _nested(inner, depth):
    """``inner`` below so many levels of objects and arrays."""
    return F.concat(F.repeat(F.lit('{"a":[0,'), depth), inner, F.repeat(F.lit("]}"), depth))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x' || event_id || '|y' || event_type ELSE 'x' || event_id END AS evidence_ids FROM events WHERE event_id % 50 <> 0")
def evidence_walk(spark, sf):
    """Ids at up to 40 levels, several of them, empty ones and texts that are no JSON."""
    i, one = F.col("event_id"), F.concat(F.lit('{"evidence_id":"x'), F.col("event_id").cast("string"), F.lit('"}'))
    more = F.when(i % 3 == 0, F.concat(F.lit(',[{"b":{"evidence_id":"y'), "event_type", F.lit('"}},{"evidence_id":""}]'))).otherwise("")
    e = table(spark, sf, "events").select("event_id", F.when(i % 50 != 0, _nested(F.concat(one, more), (i % 40 + 1).cast("int"))).otherwise('{"evidence_id":"z"').alias("j"))
    return packets.carried_ids(packets.walk(e, "event_id", "j", packets.ID_KEYS), "event_id").select("event_id", text.joined("evidence_ids").alias("evidence_ids"))


@query("SELECT event_id, CASE WHEN event_id % 20 = 0 THEN 'A01_x|expected_answer' ELSE 'adjudicated_gold' END AS forbidden FROM events WHERE event_id % 20 IN (0, 7)")
def forbidden_keys(spark, sf):
    """Forbidden keys at up to 60 levels; values that look like them do not count."""
    i, depth = F.col("event_id"), (F.col("event_id") % 61).cast("int")
    inner = F.when(i % 20 == 0, '{"b":{"A01_x":1,"c":[{"expected_answer":2}]}}').when(i % 20 == 7, '{"b":[[{"adjudicated_gold":null}]]}').otherwise('{"b":{"a1":"adjudicated_gold"}}')
    w = packets.walk(table(spark, sf, "events").select("event_id", _nested(inner, depth).alias("j")), "event_id", "j")
    return packets.forbidden(w, "event_id").select("event_id", text.joined("forbidden").alias("forbidden"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'z' ELSE '' END AS unknown_ids FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 10 = 1")
def reference_validity(spark, sf):
    k = F.col("o_orderkey") % 10
    o = table(spark, sf, "orders").select("o_orderkey", F.when(k == 0, F.array(F.lit("a"), F.lit("z"))).when(k == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("b"))).alias("cited"), F.array(F.lit("a"), F.lit("b")).alias("listed"))
    return packets.invalid_references(o, "cited", "listed").select("o_orderkey", text.joined("unknown_ids").alias("unknown_ids"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS item_id, 2::BIGINT AS conditions, o_orderkey % 9 <> 0 AS equal FROM orders")
def evidence_parity(spark, sf):
    o = table(spark, sf, "orders")
    i = F.col("o_orderkey").cast("string").alias("item_id")
    b = o.select(i, F.sha2("o_orderpriority", 256).alias("evidence_sha256"))
    c = o.select(i, F.when(F.col("o_orderkey") % 9 == 0, "x").otherwise(F.sha2("o_orderpriority", 256)).alias("evidence_sha256"))
    return packets.parity(b, c)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'missing st_source' WHEN c_custkey % 6 = 1 THEN 'a hidden value reached the prompt' END AS problem, CASE WHEN c_custkey % 6 > 1 THEN sha256('S: ' || c_mktsegment || ' C: ' || c_name || ' V: WA') END AS sha256 FROM customer""")
def blind_prompts(spark, sf):
    k = F.col("c_custkey") % 6
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(k == 0, "").otherwise(F.col("c_name")).alias("src"), F.when(k == 1, F.col("c_name")).otherwise("nowhere").alias("hidden"))
    return c.select("c_custkey", packets.future_blind_prompt("S: %s C: %s V: %s", "c_mktsegment", "src", F.lit("WA"), ["hidden"]).alias("p")).select("c_custkey", "p.problem", "p.sha256")


@query("""WITH a AS (SELECT p_partkey, p_name, p_size FROM part), b AS (SELECT p_partkey, p_name, CASE WHEN p_size = 7 THEN 8 ELSE p_size END AS p_size FROM part WHERE p_partkey % 100 <> 3 UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_size = 9)
  SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right""")
def semantic_equality(spark, sf):
    """Parts against a copy with changed, lost and repeated rows."""
    a = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    b = a.filter("p_partkey % 100 <> 3").withColumn("p_size", F.when(F.col("p_size") == 7, 8).otherwise(F.col("p_size")))
    return joins.same_rows(a, b.unionByName(a.filter("p_size = 9")))


# ---------------------------------------------------------------- checks, sinks and sources
@query("SELECT unnest(['rows', 'sources', 'langs']) AS \"check\", unnest([CAST((SELECT count(*) FROM documents) AS VARCHAR), CAST((SELECT count(DISTINCT source) FROM documents) AS VARCHAR), CAST((SELECT count(DISTINCT lang) FROM documents) AS VARCHAR)]) AS actual, unnest([(SELECT count(*) FROM documents) = 1000, (SELECT count(DISTINCT source) FROM documents) = 20, (SELECT count(DISTINCT lang) FROM documents) = 4]) AS passed")
def named_checks(spark, sf):
    d = table(spark, sf, "documents")
    return checks.checks(d, [("rows", 1000, F.count("*")), ("sources", 20, F.countDistinct("source")), ("langs", 4, F.countDistinct("lang"))]).drop("expected")


@query("SELECT 2::BIGINT AS checks, CASE WHEN (SELECT count(DISTINCT lang) FROM documents) = 4 THEN 1 ELSE 2 END::BIGINT AS failed, 'FAIL' AS gate")
def check_gate(spark, sf):
    d = table(spark, sf, "documents")
    return checks.gate(checks.check(d, "langs", 4, F.countDistinct("lang")), checks.check(d, "sources", -1, F.countDistinct("source")))


@query("SELECT count(*) AS rows, count(DISTINCT source) AS groups, CASE WHEN count(*) >= 100 AND count(DISTINCT source) >= 10 THEN 'PASS' ELSE 'REVIEW' END AS gate FROM documents")
def stage_gate(spark, sf):
    return checks.size_gate(table(spark, sf, "documents"), "source")


@query("SELECT n_nationkey, NULL::VARCHAR AS reason, n_name FROM nation")
def reindexed(spark, sf):
    return sinks.reindex(table(spark, sf, "nation"), ["n_nationkey", "reason", "n_name"])


@query("SELECT '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS line FROM nation")
def canonical_lines(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(packets.canonical(n).alias("line"))


def _sheet(name: str, columns: list[str], table_: str, order: str) -> str:
    cells = " || '\",\"' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    heads = ",".join(f'"{c}"' for c in columns)
    return f"""SELECT '{name}' AS sheet, '{{"columns":[{heads}],"rows":[' || coalesce(string_agg('["' || {cells} || '"]', ',' ORDER BY {order}), '') || ']}}' AS payload FROM {table_}"""


@query(" UNION ALL ".join([_sheet("region", ["r_regionkey", "r_name"], "region", "CAST(r_regionkey AS VARCHAR)"), _sheet("nation", ["n_name", "n_regionkey"], "nation", "n_name"), _sheet("languages", ["lang", "n"], "(SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1)", "lang"), _sheet("none", ["lang"], "(SELECT lang FROM documents WHERE false)", "lang")]))
def workbook_payload(spark, sf):
    """Four sheets: two tables, a summary of documents, and one without rows."""
    d = table(spark, sf, "documents")
    counts = d.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    return sinks.workbook({"region": table(spark, sf, "region").select("r_regionkey", "r_name"), "nation": table(spark, sf, "nation").select("n_name", "n_regionkey"), "languages": counts, "none": d.select("lang").filter("false")})


@query("""SELECT v AS version, n AS only_left, n AS only_right, n = 0 AS identical FROM (SELECT 'dealt anew' AS v, 0::BIGINT AS n UNION ALL SELECT 'changed', count(*) FILTER (lang = 'en') FROM documents)""")
def rebuild_check(spark, sf):
    """Rows of documents against the same in other partitions, and against rows that were changed; ``rebuild_differences``
    compares order and bytes."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    versions = {"dealt anew": d.repartition(7), "changed": d.withColumn("source", F.when(F.col("lang") == "en", F.concat(F.coalesce("source", F.lit("")), F.lit("!"))).otherwise(F.col("source")))}
    out = [sinks.rebuild_check(d, v).select(F.lit(name).alias("version"), "*") for name, v in versions.items()]
    return out[0].union(out[1])


@query(None)
def file_inventory(spark, sf):
    """Every file of the tables: path, digest and size; a file is read in pieces."""
    return readers.file_hashes(spark, sf)


# ---------------------------------------------------------------- files written and read back
def _folder(spark) -> str:
    """A new folder below the one that all executors share; a temporary one only in a local session that names none."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    top = top or tempfile.gettempdir()
    return f"{top.rstrip('/')}/revaudit-files-{uuid.uuid4().hex}"


DOC_FIELDS = "doc_id long, lang string, source string, text string"


@query("SELECT doc_id, lang, source, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL")
def csv_round_trip(spark, sf):
    """Typed columns of a CSV file with quotes, commas and line breaks in its texts."""
    d, path = table(spark, sf, "documents").filter("text is not null"), _folder(spark)
    sinks.write_csv(d, path, ["doc_id", "lang", "source", "text"])
    back = readers.read_csv(spark, path, StructType.fromDDL(DOC_FIELDS), na_tokens=False)
    return back.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def csv_texts(spark, sf):
    """All columns of a CSV file as texts."""
    path = _folder(spark)
    sinks.write_csv(table(spark, sf, "part"), path, ["p_partkey", "p_name", "p_size"])
    return readers.read_csv_text(spark, path)


@query("SELECT doc_id, lang, source, sha256(text) AS text_sha256, n_chars FROM documents")
def jsonl_round_trip(spark, sf):
    """Canonical JSON lines in gzip files, read back by a schema."""
    d, path = table(spark, sf, "documents"), _folder(spark)
    sinks.write_canonical(d.select("doc_id", "lang", "source", "text", "n_chars"), path, gzip=True)
    back = readers.read_jsonl(spark, path, StructType.fromDDL(DOC_FIELDS + ", n_chars long"))
    return back.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), "n_chars")


@query("""WITH l AS (SELECT o_orderkey AS k, o_orderkey % 5 AS f, CASE WHEN o_orderkey % 3 = 2 THEN 2 ELSE 1 END AS lines FROM orders), n AS (SELECT *, sum(lines) OVER (PARTITION BY f ORDER BY k) - lines + 1 AS line_number FROM l)
  SELECT CAST(f AS INTEGER) AS file, CAST(line_number AS BIGINT) AS line_number, CASE WHEN k % 3 = 0 THEN 'broken ' || k ELSE '[' || k || ']' END AS line FROM n WHERE k % 3 <> 2""")
def jsonl_bad_lines(spark, sf):
    """Lines that are no JSON objects, by number, in five files of orders; blank lines count but are not bad."""
    o, k, name, path = table(spark, sf, "orders"), F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string"), _folder(spark)
    line = F.when(k == 0, F.concat(F.lit("broken "), name)).when(k == 1, F.concat(F.lit("["), name, F.lit("]"))).otherwise(F.concat(F.to_json(F.struct("o_orderkey")), F.lit("\n ")))
    o = o.select((F.col("o_orderkey") % 5).alias("f"), "o_orderkey", line.alias("value")).repartition(5, "f").sortWithinPartitions("f", "o_orderkey")
    o.select("f", "value").write.partitionBy("f").text(path)  # one sorted file a folder
    return readers.bad_lines(spark, path).select(F.regexp_extract("file", r"f=(\d+)", 1).cast("int").alias("file"), "line_number", "line")


@query("SELECT n_nationkey, n_name, form FROM nation, (VALUES ('list'), ('value')) v(form)")
def json_arrays(spark, sf):
    """A JSON file that is a list of objects, and one whose first list value is that list."""
    n, schema = table(spark, sf, "nation").select("n_nationkey", "n_name"), StructType.fromDDL("n_nationkey int, n_name string")
    rows = F.to_json(F.sort_array(F.collect_list(F.struct(*n.columns))))  # 25 nations
    parts = []
    for form, text_of in (("list", rows), ("value", F.concat(F.lit('{"kind": "nations", "none": {}, "rows": '), rows, F.lit(', "more": [1]}')))):
        path = _folder(spark)
        n.agg(text_of.alias("value")).write.text(path)
        parts.append(readers.read_json_array(spark, path, schema).withColumn("form", F.lit(form)))
    return parts[0].unionByName(parts[1])


@query("SELECT e.event_id, e.event_type, (event_id % 2 = 1) AS second FROM events e")
def appended_log(spark, sf):
    """A log that two batches were appended to."""
    e, path = table(spark, sf, "events").select("event_id", "event_type"), _folder(spark)
    for k in (0, 1):
        sinks.append_log(e.filter(F.col("event_id") % 2 == k).withColumn("second", F.lit(k == 1)), path)
    return readers.read_jsonl(spark, path, StructType.fromDDL("event_id long, event_type string, second boolean"))


@query("SELECT 'part' AS \"table\", count(*) AS rows, true AS refused FROM part")
def refused_overwrite(spark, sf):
    """A second write to a place that has a file is refused, and the first one's rows stay."""
    from pyspark.errors import AnalysisException

    p, path = table(spark, sf, "part"), _folder(spark)
    sinks.write_canonical(p.select("p_partkey"), path)
    try:
        sinks.write_canonical(p.limit(1).select("p_partkey"), path)
        refused = False
    except AnalysisException:
        refused = True
    return readers.read_jsonl(spark, path, StructType.fromDDL("p_partkey long")).agg(F.count("*").alias("rows")).select(F.lit("part").alias("table"), "rows", F.lit(refused).alias("refused"))


@query("SELECT unnest(['ok', 'missing', 'mismatch']) AS status, unnest([3, 1, 1])::BIGINT AS n")
def checksum_status(spark, sf):
    """A checksum file of a folder's files, of which one goes missing and another one is stated wrongly."""
    path = _folder(spark)
    for i, name in enumerate(["region", "nation", "supplier"]):
        table(spark, sf, name).coalesce(1).select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/data/t{i}")
    found = readers.file_hashes(spark, f"{path}/data").filter(F.col("path").contains("/part-"))
    more = found.limit(1).select(F.lit("gone").alias("path"), "sha256", "bytes").unionByName(found.limit(1).select(F.lit("wrong").alias("path"), "sha256", "bytes"))
    sinks.checksum_lines(found.unionByName(more)).coalesce(1).write.text(f"{path}/sums")
    stated = readers.read_checksums(spark, f"{path}/sums")
    now = found.unionByName(found.limit(1).select(F.lit("wrong").alias("path"), F.lit("0" * 64).alias("sha256"), "bytes"))
    return readers.verify_checksums(stated, now).groupBy("status").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- strict pool, ledgers of submissions, batches
@query(f"""WITH {SPLIT}, p AS (SELECT doc_id, split, lang, doc_id % 3 <> 0 AS ready, h IN (SELECT hash FROM bad) OR w IN (SELECT hash FROM bad) AS crossing FROM sd) SELECT doc_id, split FROM p WHERE split IN ('development', 'test') AND lang = 'en' AND ready AND NOT crossing""")
def strict_pool(spark, sf):
    d = split.exclude_crossing(_split_docs(spark, sf), ["h", "w"]).withColumn("ready", F.col("doc_id") % 3 != 0)
    return quality.strict_pool(d, [("lang", "en")], ["development", "test"], "ready", "cross_split_duplicate").select("doc_id", "split")


@query(f"""WITH {SUB}, n AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN '0' WHEN doc_id % 13 = 1 THEN '1.5' WHEN doc_id % 13 = 2 THEN 'x' WHEN doc_id % 13 = 3 THEN '1' ELSE CAST(attempt AS VARCHAR) END AS a, CASE WHEN doc_id % 17 = 0 THEN 'sub_same' ELSE submission_id END AS sid, CASE WHEN doc_id % 19 = 0 THEN '["x"' ELSE trace END AS tr FROM sub),
  f AS (SELECT (user_id IS NULL OR verdict IS NULL) AS s1, doc_id % 13 < 3 AS s2, NOT coalesce(problem_id IN (SELECT 'prob_' || (item_id % 6) FROM benchmark), false) AS s3, count(*) OVER (PARTITION BY sid) > 1 AS s4, count(*) OVER (PARTITION BY user_id, problem_id, a) > 1 AS s5, tr IS NULL OR doc_id % 19 = 0 AS s6 FROM n),
  c AS (SELECT [count(*) FILTER (s1), count(*) FILTER (s2), count(*) FILTER (s3), count(*) FILTER (s4), count(*) FILTER (s5), count(*) FILTER (s6)] AS v FROM f)
  SELECT 'submission' AS scope, unnest(['S01', 'S02', 'S03', 'S04', 'S05', 'S06']) AS rule_id, unnest(v) AS count, unnest(['exclude', 'exclude', 'exclude', 'exclude', 'exclude', 'exclude from evidence-grounded set']) AS status FROM c""")
def submission_ledger(spark, sf):
    probs = table(spark, sf, "benchmark").select(F.concat(F.lit("prob_"), (F.col("item_id") % 6).cast("string")).alias("problem_id"))
    m = F.col("doc_id") % 13
    subs = roles.submissions(spark, sf).withColumns({
        "attempt_number": F.when(m == 0, "0").when(m == 1, "1.5").when(m == 2, "x").when(m == 3, "1").otherwise(F.col("attempt").cast("string")),
        "submission_id": F.when(F.col("doc_id") % 17 == 0, "sub_same").otherwise(F.col("submission_id")),
        "trace": F.when(F.col("doc_id") % 19 == 0, '["x"').otherwise(F.col("trace")),
    }).drop("attempt")
    out = quality.flag_submissions(subs, probs, ["user_id", "verdict"])
    return quality.ledger(out, quality.submission_rules(text.json_list_reason("trace").isNull())).drop("reason")


VALID = f"{PAIR.replace(SUB, SUB.replace('sub AS (SELECT', 'every AS (SELECT', 1) + ', sub AS (SELECT * FROM every WHERE user_id IS NOT NULL AND verdict IS NOT NULL AND language IS NOT NULL AND code IS NOT NULL)')}"


@query(f"""WITH {SPLIT}, {VALID} SELECT 'transition' AS scope, 'T06' AS rule_id, count(*) AS count, 'exclude from strict evaluation partitions' AS status FROM pair WHERE attempt_t1 = attempt_t + 1 AND (code_sha256_t IN (SELECT hash FROM bad) OR code_sha256_t1 IN (SELECT hash FROM bad))""")
def crossing_ledger(spark, sf):
    """Transitions of valid rows of which a side's code occurs in several parts of the split by source. All problems are
    linked here; ``exclusion_ledger`` has T06 of the eligible pairs in the split by problem."""
    bad = split.crossing_hashes(_split_docs(spark, sf), ["h", "w"]).select("hash")
    subs = roles.submissions(spark, sf).withColumnRenamed("attempt", "attempt_number")
    flagged = quality.flag_submissions(subs, subs.select("problem_id").distinct(), profile.REQUIRED)
    t = trajectory.transitions(flagged.filter("row_valid_for_ordering")).filter("is_consecutive")
    sides = t.select("transition_id", F.explode(F.array("code_sha256_t", "code_sha256_t1")).alias("hash")).join(bad, "hash", "left_semi").select("transition_id").distinct()
    t = t.join(sides.withColumn("crossing", F.lit(True)), "transition_id", "left")
    rule = ("transition", "T06", "exclude from strict evaluation partitions", "Exact or whitespace-normalized code occurs across problem-disjoint splits", F.coalesce("crossing", F.lit(False)))
    return quality.ledger(t, [rule]).drop("reason")


@query(f"""WITH {LI} SELECT item_id, CASE WHEN o_orderkey % 29 = 0 THEN 'duplicate packet item ID' WHEN o_orderkey % 7 = 0 THEN 'packet hash mismatch: ' || item_id WHEN o_orderkey % 5 <> 0 THEN 'test replay missing: ' || item_id || ' later ' || problem_id || '_T' || lines[1] END AS problem FROM pk
  UNION ALL SELECT item_id, 'duplicate packet item ID' FROM pk WHERE o_orderkey % 29 = 0""")
def batch_assembly(spark, sf):
    """Two batches of packets, some replayed, some changed after they were sealed, some in both."""
    key = F.substring("item_id", 2, 20).cast("long")
    p = roles.packets(spark, sf).select("item_id", "problem_id", "problem_statement", "tests")
    done = lambda t, s, yes: t[s].withField("status", F.when(yes, "PASS").otherwise(t[s].status))
    p = p.withColumn("tests", F.transform("tests", lambda t: t.withField("earlier", done(t, "earlier", F.lit(True))).withField("later", done(t, "later", key % 5 == 0))))
    p = packets.sealed(p).withColumn("problem_statement", F.when(key % 7 == 0, F.concat("problem_statement", F.lit("!"))).otherwise(F.col("problem_statement")))
    out = packets.assembled(p.filter(key % 2 == 0), p.filter(key % 2 == 1), p.filter(key % 29 == 0))
    return out.select("item_id", "problem")


@query(f"""WITH {SECOND}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS rr FROM runs) WHERE rr IN (2, 3)), e AS (SELECT item_id FROM fa WHERE http_status = 429),
  m AS (SELECT item_id, count(*) AS rows, min(http_status) AS http_status, bool_or(outcome = 'accepted') AS hit, bool_or(outcome = 'error') AS failed, min(error_type) FILTER (outcome = 'error') AS error_type FROM t GROUP BY 1)
  SELECT item_id, CASE WHEN coalesce(hit, false) THEN 'accepted' ELSE 'error' END AS outcome, http_status, error_type,
  CASE WHEN e.item_id IS NULL THEN 'not selected' WHEN rows IS NULL THEN 'no attempt' WHEN rows > 1 THEN 'several attempts' END AS problem FROM e FULL JOIN m USING (item_id)""")
def covered_recovery(spark, sf):
    """Second and third attempts from two folders, against the items whose first attempt was turned away."""
    from pyspark.sql import Window

    r, path = roles.runs(spark, sf), _folder(spark)
    later = r.withColumn("rr", F.row_number().over(Window.partitionBy("user_id", "k").orderBy("event_id"))).filter("rr in (2, 3)")
    later = later.select("item_id", "http_status", "outcome", "error_type", "rr")
    schema = StructType.fromDDL("item_id string, http_status int, outcome string, error_type string, rr int")
    for rr in (2, 3):
        sinks.write_canonical(later.filter(F.col("rr") == rr), f"{path}/{rr}")
    both = readers.read_jsonl(spark, f"{path}/2", schema).unionByName(readers.read_jsonl(spark, f"{path}/3", schema))
    first = ledger.first_attempts(r, ["user_id", "k"], ["event_id"]).filter("http_status = 429")
    return ledger.covered_recovery(first, both, both.filter("outcome = 'accepted'"), both.filter("outcome = 'error'"), "item_id")


@query("""WITH a AS (SELECT o_orderkey AS item_id, o_custkey AS sequence, sha256('r' || o_orderkey) AS request_sha256 FROM orders WHERE o_orderkey % 4 = 3)
  SELECT l AS log, item_id, sequence, request_sha256, 'PRIMARY_FIRST_ATTEMPT' AS attempt_class, CASE l WHEN 'errors' THEN 'IncompleteRead' END AS error_type, CASE l WHEN 'metadata' THEN 'error' END AS status, CASE l WHEN 'raw' THEN '' END AS raw_response FROM a, (VALUES ('raw'), ('errors'), ('metadata')) v(l)""")
def reconstructed_attempts(spark, sf):
    """Orders as attempts, of which three quarters are in one of the logs."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    o = o.select(k.alias("item_id"), F.col("o_custkey").alias("sequence"), F.sha2(F.concat(F.lit("r"), k.cast("string")), 256).alias("request_sha256"))
    logs = [o.filter(F.col("item_id") % 4 == i) for i in range(3)]
    rows = ledger.reconstructed(o.filter("item_id % 4 = 3"), *logs, "item_id")
    wanted = ["log", "item_id", "sequence", "request_sha256", "attempt_class", "error_type", "status", "raw_response"]
    parts = [sinks.reindex(d.withColumn("log", F.lit(name)), wanted) for name, d in rows.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH RECURSIVE {PROF}, v AS (SELECT {CHECK_VALUES})
  SELECT unnest(['all_required_submission_columns_present', 'all_required_problem_columns_present', 'problem_ids_unique_in_problem_data', 'submission_ids_unique', 'all_primary_pairs_are_consecutive', 'all_primary_pairs_are_same_language', 'all_primary_pairs_have_evidence', 'one_primary_split_per_problem', 'one_primary_split_per_trajectory', 'one_secondary_split_per_participant',
  'no_near_duplicate_problem_pair_crosses_primary_splits', 'no_exact_or_whitespace_code_hash_crosses_strict_splits', 'all_three_primary_splits_nonempty']) AS "check", unnest([true, true, ids, subs, con, lang, ev, one, traj, second, near_ok, hash_ok, three]) AS passed FROM v""")
def validation_checks(spark, sf):
    """The thirteen named checks of a dataset: near pairs of problems against their parts, code of the strict pairs."""
    return profile.validation(_profile(spark, sf)).select("check", "passed")


@query(f"""WITH RECURSIVE {PROF} SELECT problem_id, coalesce(part, 'ineligible') AS split_primary, g AS leakage_group_id, coalesce(n, 0) AS eligible_transition_count FROM grp LEFT JOIN asg USING (problem_id) LEFT JOIN (SELECT problem_id, count(*) AS n FROM p0 GROUP BY 1) USING (problem_id)""")
def problem_split_assignments(spark, sf):
    """Every problem with its part, its leakage group and its eligible pairs."""
    p = _profile(spark, sf)
    counts = p.primary.groupBy("problem_id").agg(F.count("*").alias("n"))
    out = p.groups.join(p.assigned, "problem_id", "left").join(counts, "problem_id", "left")
    return out.select("problem_id", F.coalesce("split_primary", F.lit("ineligible")).alias("split_primary"), "leakage_group_id", F.coalesce("n", F.lit(0)).alias("eligible_transition_count"))


SUITE = (
    constraints.Constraint("document_ids_unique", "documents", "unique", ("doc_id",)),
    constraints.Constraint("texts_unique", "documents", "unique", ("sha2(text, 256)",)),
    constraints.Constraint("languages_known", "documents", "domain", ("lang",), values=("en", "de", "fr")),
    constraints.Constraint("lengths_stated", "documents", "holds", condition="n_chars = length(text)"),
    constraints.Constraint("no_text_missing", "documents", "rows", condition="text is null", count=0),
    constraints.Constraint("labels_one_each", "labels", "unique", ("doc_id",)),
    constraints.Constraint("labels_of_documents", "labels", "references", ("doc_id",), other="documents"),
    constraints.Constraint("labels_cover_documents", "labels", "covers", ("doc_id",), other="documents"),
    constraints.Constraint("packets_unique", "packets", "unique", ("item_id",)),
    constraints.Constraint("earlier_replayed", "packets", "excludes", ("tests.earlier.status",), values=("NOT_REPLAYED",)),
    constraints.Constraint("later_replayed", "packets", "excludes", ("tests.later.status",), values=("NOT_REPLAYED",)),
    constraints.Constraint("packets_without_labels", "packets", "lacks", ("lifecycle_label", "human_labels", "prediction")),
)
_VIOLATED = """SELECT {name} AS "constraint", '{table}' AS "table", '{kind}' AS kind, 0::BIGINT AS expected, CAST(coalesce(sum(n), 0) AS BIGINT) AS actual, coalesce(sum(n), 0) = 0 AS passed, coalesce(array_to_string(list(k ORDER BY k)[1:3], ','), '') AS sample FROM ({rows})"""


def _violated(name: str, table_: str, kind: str, rows: str) -> str:
    return _VIOLATED.format(name=f"'{name}'", table=table_, kind=kind, rows=rows)


@query(" UNION ALL ".join([
    _violated("document_ids_unique", "documents", "unique", "SELECT '[\"' || doc_id || '\"]' AS k, count(*) - 1 AS n FROM documents GROUP BY doc_id HAVING count(*) > 1"),
    _violated("texts_unique", "documents", "unique", "SELECT coalesce('[\"' || sha256(text) || '\"]', '[null]') AS k, count(*) - 1 AS n FROM documents GROUP BY text HAVING count(*) > 1"),
    _violated("languages_known", "documents", "domain", "SELECT '[\"' || doc_id || '\"]' AS k, 1 AS n FROM documents WHERE coalesce(lang NOT IN ('en', 'de', 'fr'), true)"),
    _violated("lengths_stated", "documents", "holds", "SELECT '[\"' || doc_id || '\"]' AS k, 1 AS n FROM documents WHERE n_chars IS DISTINCT FROM length(text) OR text IS NULL"),
    "SELECT 'no_text_missing', 'documents', 'rows', 0, count(*) FILTER (text IS NULL), count(*) FILTER (text IS NULL) = 0, '' FROM documents",
    _violated("labels_one_each", "labels", "unique", "SELECT '[\"' || doc_id || '\"]' AS k, count(*) - 1 AS n FROM labels GROUP BY doc_id HAVING count(*) > 1"),
    _violated("labels_of_documents", "labels", "references", "SELECT DISTINCT '[\"' || doc_id || '\"]' AS k, 1 AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"),
    _violated("labels_cover_documents", "labels", "covers", "SELECT DISTINCT '[\"' || coalesce(l.doc_id, d.doc_id) || '\"]' AS k, 1 AS n FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL"),
    _violated("packets_unique", "packets", "unique", "SELECT '' AS k, 1 AS n FROM region WHERE false"),
    _violated("earlier_replayed", "packets", "excludes", "SELECT '[\"i' || o_orderkey || '\"]' AS k, 1 AS n FROM orders WHERE o_orderkey % 5 = 1 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
    _violated("later_replayed", "packets", "excludes", "SELECT '' AS k, 1 AS n FROM region WHERE false"),
    "SELECT 'packets_without_labels', 'packets', 'lacks', 0, 0, true, ''",
]))
def integrity_suite(spark, sf):
    """Constraints on documents, labels and packets, of which some hold and some do not; the packets are replayed but for
    the earlier state of every fifth order."""
    key = F.substring("item_id", 2, 20).cast("long")
    done = lambda t, s, yes: t[s].withField("status", F.when(yes, "PASS").otherwise(t[s].status))
    p = roles.packets(spark, sf).select("item_id", F.transform("tests", lambda t: t.withField("earlier", done(t, "earlier", key % 5 != 1)).withField("later", done(t, "later", F.lit(True)))).alias("tests"))
    tables = {"documents": table(spark, sf, "documents"), "labels": table(spark, sf, "labels"), "packets": p}
    out = constraints.check(tables, list(SUITE), {"documents": ["doc_id"], "labels": ["doc_id"], "packets": ["item_id"]})
    return out.withColumn("sample", F.array_join("sample", ","))


@query(None)
def package_integrity(spark, sf):
    """Two packages of files that must hold the same packets and no other files, one of them changed by a byte."""
    top, docs = _folder(spark), table(spark, sf, "labels")
    for package, change in (("A01", 0), ("A02", 0), ("A03", 1)):
        sinks.write_canonical(docs.orderBy("doc_id").withColumn("quality", F.when(F.col("doc_id") % 10 == 0, (F.col("quality") + change) % 2).otherwise(F.col("quality"))).coalesce(1), f"{top}/{package}")
    found = readers.file_hashes(spark, top)
    files = found.filter("path like '%part-%'").select(F.regexp_replace("path", "/part-.*", "/packets").alias("path"), "sha256")
    same = constraints.same_files(files, [("A01 is A02", "A01/packets", "A02/packets"), ("A01 is A03", "A01/packets", "A03/packets"), ("A01 is A04", "A01/packets", "A04/packets")])
    names = [constraints.same_names(files, f"files of {x}", x, want) for x, want in (("A01", ["packets"]), ("A02", ["packets", "rubric"]))]
    return same.unionByName(names[0]).unionByName(names[1])


_LINE = "'{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"text\":\"' || coalesce(sha256(text), 'none') || '\"}'"


@query(f"""WITH a AS (SELECT doc_id, {_LINE} AS line FROM documents), f AS (SELECT min(doc_id) AS f FROM documents WHERE doc_id > 100 AND doc_id % 100 = 37),
  v AS (SELECT 'same' AS version, doc_id, line FROM a UNION ALL SELECT 'swapped', CASE WHEN doc_id = f THEN f + 1 WHEN doc_id = f + 1 THEN f ELSE doc_id END, line FROM a, f
    UNION ALL SELECT 'changed', doc_id, CASE WHEN doc_id % 100 = 71 THEN replace(line, '"lang":"', '"lang":"x') ELSE line END FROM a UNION ALL SELECT 'longer', doc_id, line FROM a UNION ALL SELECT 'longer', (SELECT max(doc_id) + 1 FROM a), 'more'),
  r AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY doc_id) AS place FROM v), s AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS place FROM a)
  SELECT r.version, bool_and(coalesce(r.line = s.line, false)) AND count(*) = (SELECT count(*) FROM a) AS identical, (SELECT count(*) FROM a) AS rows_a, count(*) AS rows_b, min(place) FILTER (s.line IS DISTINCT FROM r.line) AS first_difference FROM r LEFT JOIN s USING (place) GROUP BY 1""")
def rebuild_differences(spark, sf):
    """Canonical lines of documents against four rebuilt versions: the same, two lines swapped, bytes changed, and a line more."""
    from ..operators import identity

    d = table(spark, sf, "documents").select("doc_id", F.format_string('{"doc_id":%d,"lang":"%s","text":"%s"}', "doc_id", "lang", F.coalesce(F.sha2("text", 256), F.lit("none"))).alias("line"))
    k = F.col("doc_id")
    first, last = d.agg(F.min(F.when((k > 100) & (k % 100 == 37), k)), F.max(k)).first()
    versions = {
        "same": d,
        "swapped": d.withColumn("doc_id", F.when(k == first, first + 1).when(k == first + 1, first).otherwise(k)),
        "changed": d.withColumn("line", F.when(k % 100 == 71, F.replace("line", F.lit('"lang":"'), F.lit('"lang":"x'))).otherwise(F.col("line"))),
        "longer": d.unionByName(spark.createDataFrame([(last + 1, "more")], "doc_id long, line string")),
    }
    stored, out = identity.kept(identity.leaves(d, "line", ["doc_id"])), []
    for name, version in versions.items():
        row = identity.ordered_difference(stored, identity.leaves(version, "line", ["doc_id"]), 32)
        out.append(row.select(F.lit(name).alias("version"), "identical", "rows_a", "rows_b", "first_difference"))
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("SELECT 'b-' || (event_id % 4) AS batch, event_type, count(*) AS n FROM events WHERE event_id % 4 <> 3 GROUP BY ALL")
def batches_once(spark, sf):
    """Events in four batches; one is appended twice, one dies before its marker."""
    e, path = table(spark, sf, "events").select("event_id", "event_type"), _folder(spark)
    for i in (0, 1, 2, 0):
        sinks.append_batch(e.filter(F.col("event_id") % 4 == i), path, f"b-{i}")
    sinks.write_canonical(e.filter("event_id % 4 = 3"), f"{path}/b-3-left")
    back = readers.read_batches(spark, path, StructType.fromDDL("event_id long, event_type string"))
    return back.groupBy("batch", "event_type").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT 'g' || (doc_id // 2 % 50) AS "freeze", doc_id // 2 % 50 AS g, CASE WHEN doc_id % 2 = 0 THEN 'output' ELSE 'input' END AS role, doc_id FROM documents),
  q AS (SELECT *, CASE WHEN g % 6 = 0 THEN NULL WHEN g % 6 = 1 AND role = 'input' THEN 'input changed' WHEN g % 6 = 2 AND role = 'output' THEN 'output changed' WHEN g % 6 = 3 AND role = 'output' THEN 'output missing' WHEN g % 6 = 4 AND role = 'input' THEN 'new input' END AS problem FROM p)
  SELECT "freeze", CASE any_value(g) % 6 WHEN 0 THEN 'build' WHEN 1 THEN 'rebuild' WHEN 2 THEN 'refuse' WHEN 3 THEN 'refuse' WHEN 4 THEN 'rebuild' ELSE 'reuse' END AS decision, min(problem) AS reason, count(problem) AS problems FROM q GROUP BY 1""")
def freeze_reuse(spark, sf):
    """Documents as input and output files of fifty freezes: of six in turn one has no manifest, one changed inputs, one
    changed outputs, one lost outputs, one new inputs, and one is whole."""
    from ..operators import freeze

    k, g = F.col("doc_id"), F.expr("doc_id div 2 % 50")
    d = table(spark, sf, "documents").select(F.concat(F.lit("g"), g.cast("string")).alias("freeze"), (g % 6).alias("g"), F.when(k % 2 == 0, "output").otherwise("input").alias("role"), k.cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    manifest = d.filter("g <> 0 and not (g = 4 and role = 'input')")
    changed = F.expr("g = 1 and role = 'input' or g = 2 and role = 'output'")
    found = d.filter("not (g = 3 and role = 'output')").withColumn("sha256", F.when(changed, F.reverse("sha256")).otherwise(F.col("sha256")))
    return freeze.freeze_decisions(manifest, found)


@query("""WITH v AS (SELECT item_id, trim(unnest(regexp_split_to_array(text, '[.!?] '))) AS v FROM benchmark) SELECT DISTINCT doc_id, item_id, sha256(v) AS value_sha256 FROM documents JOIN v ON length(v) >= 20 AND contains(text, v)""")
def leaked_values(spark, sf):
    """Documents as prompts, sentences of the benchmark as the values that must not reach them."""
    from ..operators import containment

    v = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", "[.!?] ")).alias("v"))
    v = v.select("item_id", F.trim("v").alias("v")).filter(F.length("v") >= 20).distinct()
    v = v.withColumn("value", F.struct("item_id", F.sha2("v", 256).alias("value_sha256")))
    return containment.contained(table(spark, sf, "documents"), "doc_id", "text", v, "value", "v").select("doc_id", "value.*").distinct()


@query(f"""WITH {SUB}, t AS (SELECT l.doc_id, 'sub_' || l.doc_id AS case_id FROM labels l WHERE l.quality = 1 UNION ALL SELECT -1, 'sub_none'), s AS (SELECT t.case_id, sub.doc_id, sub.language FROM t LEFT JOIN sub ON t.case_id = sub.submission_id)
  SELECT 'targets_found' AS "constraint", count(*) FILTER (doc_id IS NULL) AS actual, count(*) FILTER (doc_id IS NULL) = 0 AS passed FROM s UNION ALL SELECT 'sources_unique', 0, true UNION ALL SELECT 'partition_is_test', count(*) FILTER (doc_id % 5 <> 0), count(*) FILTER (doc_id % 5 <> 0) = 0 FROM s WHERE doc_id IS NOT NULL
  UNION ALL SELECT 'language_is_en', count(*) FILTER (language IS DISTINCT FROM 'en'), count(*) FILTER (language IS DISTINCT FROM 'en') = 0 FROM s WHERE doc_id IS NOT NULL UNION ALL SELECT 'no_reference_fields', 1, false""")
def stage_input_guards(spark, sf):
    """The guards of a stage's input: every target has one source row, of the test part and the language, without fields
    that tell the answer. The targets are good documents and one that isn't there; the source rows keep their verdict."""
    lab = table(spark, sf, "labels").filter("quality = 1").select(F.concat(F.lit("sub_"), F.col("doc_id").cast("string")).alias("case_id"))
    targets = lab.unionByName(spark.createDataFrame([("sub_none",)], "case_id string"))
    source = roles.submissions(spark, sf).withColumnsRenamed({"submission_id": "case_id", "verdict": "lifecycle_label"}).withColumn("partition", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("other"))
    selected = source.join(targets, "case_id", "left_semi")
    c = constraints.Constraint
    wanted = [
        c("targets_found", "targets", "references", ("case_id",), other="source"), c("sources_unique", "source", "unique", ("case_id",)), c("partition_is_test", "selected", "domain", ("partition",), values=("test",)),
        c("language_is_en", "selected", "domain", ("language",), values=("en",)), c("no_reference_fields", "selected", "lacks", ("lifecycle_label", "human_labels")),
    ]
    return constraints.check({"targets": targets, "source": source, "selected": selected}, wanted, {x: ["case_id"] for x in ("targets", "source", "selected")}).select("constraint", "actual", "passed")


@query(f"""WITH {SECOND}, r AS (SELECT item_id, returned_model, row_number() OVER (ORDER BY event_id) AS sequence FROM sa WHERE item_id IN (SELECT item_id FROM fa WHERE outcome = 'error')),
  c AS (SELECT item_id, event_id AS position, returned_model, row_number() OVER (ORDER BY event_id, item_id) AS expected FROM fa WHERE http_status = 429),
  b AS (SELECT item_id, position, expected, c.returned_model AS mb, r.returned_model AS ma, sequence FROM c FULL JOIN r USING (item_id))
  SELECT item_id, position, 'selected' AS field, 'false' AS before, 'true' AS after FROM b WHERE expected IS NULL UNION ALL SELECT item_id, position, 'attempts', '1', '0' FROM b WHERE sequence IS NULL
  UNION ALL SELECT item_id, position, 'sequence', CAST(expected AS VARCHAR), CAST(sequence AS VARCHAR) FROM b WHERE expected <> sequence UNION ALL SELECT item_id, position, 'returned_model', mb, ma FROM b WHERE expected IS NOT NULL AND sequence IS NOT NULL AND mb IS DISTINCT FROM ma
  UNION ALL SELECT item_id, position, 'requested_model', 'model_2', 'model_1' FROM b WHERE expected IS NOT NULL AND sequence IS NOT NULL""")
def recovery_differences(spark, sf):
    """Second attempts of the items whose first failed, against those that were turned away: what must be equal and isn't."""
    from pyspark.sql import Window

    from ..operators.ranking import ranked

    r = roles.runs(spark, sf)
    first = ledger.first_attempts(r, ["user_id", "k"], ["event_id"])
    second = r.withColumn("rr", F.row_number().over(Window.partitionBy("user_id", "k").orderBy("event_id"))).filter("rr = 2")
    second = ranked(second.join(first.filter("outcome = 'error'").select("item_id"), "item_id", "left_semi"), ["event_id"], "sequence")
    return ledger.recovery_differences(first, second, "item_id", "event_id", "sequence", ["user_id", "returned_model"], {"requested_model": "model_2"})[1].withColumnRenamed("event_id", "position")


@query(f"""WITH {LI} SELECT evidence, state, status, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'compiler' AS evidence, s AS state, 'NOT_REPLAYED' AS status, 1 AS n FROM pk, (VALUES ('earlier'), ('later')) v(s) UNION ALL SELECT 'test', 'earlier', 'NOT_REPLAYED', len(lines) FROM pk
  UNION ALL SELECT 'test', 'later', CASE WHEN x % 2 = 0 THEN 'PASS' ELSE 'FAIL' END, 1 FROM (SELECT unnest(lines) AS x FROM pk)) GROUP BY ALL""")
def nested_statuses(spark, sf):
    """Statuses of compilers and tests inside packets, the later state of the tests replayed."""
    number = lambda t: F.element_at(F.split(t.test_case_id, "_T"), -1).cast("int")
    later = lambda t: t.later.withField("status", F.when(number(t) % 2 == 0, "PASS").otherwise("FAIL"))
    p = roles.packets(spark, sf).select("compiler", F.transform("tests", lambda t: t.withField("later", later(t))).alias("tests"))
    return ledger.status_counts(p)


@query("SELECT CAST(p - 1 AS BIGINT) AS position, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) AS p FROM documents) WHERE p > 30 AND p <= 75")
def offset_selection(spark, sf):
    """Documents 30 to 74 in the order of language and number."""
    return quality.select_window(table(spark, sf, "documents").select("lang", "doc_id"), ["lang", "doc_id"], 30, 45).select("position", "doc_id")


@query(f"""WITH {SUB}, ph AS (SELECT *, substr(sha256('revground-codestream-stage45-v1|' || user_id), 1, 16) AS p FROM sub),
  m AS (SELECT doc_id AS item, CASE WHEN doc_id % 50 = 1 THEN 'gone' ELSE submission_id END AS submission_id, attempt + CASE WHEN doc_id % 40 = 2 THEN 1 ELSE 0 END AS attempt, CASE WHEN doc_id % 30 = 3 THEN 'prob_x' ELSE problem_id END AS problem_id, CASE WHEN doc_id % 60 = 4 THEN 'x' ELSE p END AS participant_id_hash FROM ph WHERE doc_id % 3 <> 0),
  j AS (SELECT m.*, s.submission_id IS NOT NULL AS found, s.attempt AS sa, s.problem_id AS sp, s.p, s.language AS l0, n.submission_id IS NOT NULL AS goes_on, n.language AS l1 FROM m LEFT JOIN ph s ON m.submission_id = s.submission_id LEFT JOIN ph n ON n.user_id = s.user_id AND n.problem_id = s.problem_id AND n.attempt = s.attempt + 1),
  w AS (SELECT item, unnest([CASE WHEN NOT found THEN 'missing selected submission' END, CASE WHEN found AND attempt IS DISTINCT FROM sa THEN 'attempt differs from its source' END, CASE WHEN found AND problem_id IS DISTINCT FROM sp THEN 'problem differs from its source' END, CASE WHEN found AND participant_id_hash IS DISTINCT FROM p THEN 'participant differs from its source' END,
    CASE WHEN found AND NOT goes_on THEN 'no next attempt' END, CASE WHEN found AND NOT (coalesce(l0 IN ('en', 'de'), false) AND (NOT goes_on OR coalesce(l1 IN ('en', 'de'), false))) THEN 'language not selected' END, CASE WHEN found AND sp = 'prob_6' THEN 'unknown problem' END]) AS problem FROM j)
  SELECT * FROM w WHERE problem IS NOT NULL""")
def manifest_checks(spark, sf):
    """Submissions as a manifest of which some rows were changed, against the submissions and six problems."""
    s, k = roles.submissions(spark, sf), F.col("doc_id")
    m = s.filter("doc_id % 3 <> 0").select(
        k.alias("item"), F.when(k % 50 == 1, "gone").otherwise(F.col("submission_id")).alias("submission_id"), (F.col("attempt") + F.when(k % 40 == 2, 1).otherwise(0)).alias("attempt"),
        F.when(k % 30 == 3, "prob_x").otherwise(F.col("problem_id")).alias("problem_id"), F.when(k % 60 == 4, "x").otherwise(text.pseudonym("user_id")).alias("participant_id_hash"),
    )
    return joins.manifest_problems(m, s, roles.problems(spark, sf), ["en", "de"])


@query(f"""WITH {RUNS}, r AS (SELECT event_id, item_id, user_id, sha256(concat(item_id, '|', CASE WHEN event_id % 10 = 0 THEN 'B' ELSE c END)) AS request, c FROM runs, (VALUES ('B'), ('C')) v(c) WHERE event_id % 2 = 0), b AS (SELECT c, request, count(*) - 1 AS n FROM r GROUP BY ALL)
  SELECT 'requests_unique_' || c AS "constraint", CAST(sum(n) AS BIGINT) AS actual, sum(n) = 0 AS passed FROM b GROUP BY c UNION ALL SELECT 'evidence_parity', CAST(count(*) AS BIGINT), count(*) = 0 FROM (SELECT item_id FROM r GROUP BY item_id HAVING count(DISTINCT CASE WHEN event_id % 22 = 0 AND c = 'C' THEN 'other' ELSE item_id END) > 1)""")
def request_uniqueness(spark, sf):
    """Requests of two conditions: hashes that must be unique in each, and items whose evidence must be the same in both."""
    r = roles.runs(spark, sf).filter("event_id % 2 = 0").select("event_id", "item_id", F.explode(F.array(F.lit("B"), F.lit("C"))).alias("c"))
    r = r.withColumn("request", F.sha2(F.concat_ws("|", "item_id", F.when(F.col("event_id") % 10 == 0, "B").otherwise(F.col("c"))), 256))
    r = r.withColumn("evidence_sha256", F.when((F.col("event_id") % 22 == 0) & (F.col("c") == "C"), "other").otherwise(F.col("item_id")))
    wanted = [constraints.Constraint(f"requests_unique_{c}", c, "unique", ("request",)) for c in "BC"]
    out = constraints.check({c: r.filter(F.col("c") == c) for c in "BC"}, wanted, {}).select("constraint", "actual", "passed")
    unequal = packets.parity(r.filter("c = 'B'").select("item_id", "evidence_sha256"), r.filter("c = 'C'").select("item_id", "evidence_sha256")).agg(F.count_if(~F.col("equal")).alias("actual"))
    return out.unionByName(unequal.select(F.lit("evidence_parity").alias("constraint"), "actual", (F.col("actual") == 0).alias("passed")))
