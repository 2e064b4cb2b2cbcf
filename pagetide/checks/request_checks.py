"""The change-summary request table (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetide.checks import sql as Q
from pagetide.checks.registry import plain, query
from pagetide.functions import html as H
from pagetide.operators import requests as A
from pagetide.plans import derived as V

# A request per turn of a conversation: its sentences are the snippets, and
# the number of the turn decides how many deadlines and keywords there are.
REQUESTS = f"""
rows AS (
  SELECT conv_id, turn, role, text, 'conv' || conv_id AS target_id, CAST(least(turn, 3) AS INTEGER) AS n,
    list_filter(list_transform(string_split_regex(text, '[.!?]\\s+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: length(s) >= 10) AS snippets
  FROM conversations),
requests AS (
  SELECT *, list_transform(range(1, n + 1), lambda i: {{'date': DATE '2024-01-31' + CAST(30 * i AS INTEGER),
      'type': ['abstract', 'paper', 'registration'][i], 'source_text': ['Abstract', 'Paper', 'Registration'][i] || ' deadline'}}) AS deadlines,
    ['deadline', 'call for papers', 'tba'][1:n] AS keywords FROM rows)"""


def requests(spark, d):
    rows = V.table(spark, d, "conversations").withColumn("n", F.least(F.col("turn"), F.lit(3)))
    kinds = F.array(F.lit("deadline"), F.lit("call for papers"), F.lit("tba"))
    return rows.select(
        "conv_id", "turn", "role", "text", F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("target_id"),
        H.sentences(F.col("text")).alias("snippets"),
        V.deadlines_of(V.as_of(), F.col("n")).alias("deadlines"),
        F.slice(kinds, F.lit(1), F.col("n").cast("int")).alias("keywords"),
    )


LINES = "CASE WHEN len(snippets) = 0 THEN '{empty}' ELSE array_to_string(list_transform(snippets[1:{n}], lambda s: '- ' || s), chr(10)) END"


@query("i1_summary_prompts", f"""WITH {REQUESTS}
SELECT conv_id, turn, 'Target: ' || target_id || chr(10) || 'Changed text:' || chr(10) || {LINES.format(empty=A.NO_SNIPPETS, n=20)}
  || chr(10) || 'Keywords: ' || CASE WHEN n = 0 THEN '(No keywords matched)' ELSE array_to_string(keywords, ', ') END
  || chr(10) || 'Known deadlines:' || chr(10) || CASE WHEN n = 0 THEN 'None extracted yet' ELSE array_to_string(list_transform(deadlines,
       lambda x: '- ' || x.date || ' (' || x.type || '): ' || x.source_text), chr(10)) END
  || chr(10) || 'Reply with JSON: summary, relevance_score, categories, key_changes, potential_dates.' AS prompt FROM requests""")
def summary_prompts(spark, d):
    c = F.col
    return requests(spark, d).select(
        "conv_id", "turn", A.summary_prompt(c("target_id"), c("snippets"), c("keywords"), c("deadlines")).alias("prompt")
    )


@query("i2_other_prompts", f"""WITH {REQUESTS}
SELECT conv_id, turn, 'Target: ' || target_id || chr(10) || 'Text without dates:' || chr(10) || {LINES.format(empty=A.NO_CONTENT, n=15)}
    || chr(10) || 'Reply with JSON: summary, is_cfp_related, urgency.' AS no_dates,
  'Classify this page:' || chr(10) || CASE WHEN length(text) > 300 THEN left(text, 300) || '... (truncated)' ELSE text END
    || chr(10) || 'Reply with JSON: is_cfp, submission_types, confidence.' AS classify FROM requests""")
def other_prompts(spark, d):
    return requests(spark, d).select(
        "conv_id", "turn", A.no_dates_prompt(F.col("target_id"), F.col("snippets")).alias("no_dates"),
        A.classify_prompt(F.col("text"), chars=300).alias("classify"),
    )


@query("i3_cache_keys", f"""WITH {REQUESTS}
SELECT conv_id, turn, target_id || ':' || left(sha256(target_id || array_to_string(snippets[1:10], '|')), 16) AS cache_key FROM requests""")
def cache_keys(spark, d):
    return requests(spark, d).select("conv_id", "turn", A.cache_key(F.col("target_id"), F.col("snippets")).alias("cache_key"))


CALLS = f"""{Q.SCAN_LOG},
asks AS (SELECT event_id AS request_id, 'site' || target_id AS cache_key, scan_ts AS requested_at FROM scan_log WHERE change_detected),
replies AS (SELECT 'site' || target_id AS cache_key, scan_ts + INTERVAL 20 SECOND AS responded_at, 'reply ' || event_id AS reply
  FROM scan_log WHERE llm_api_called)"""


@query("i4_cache_lookup", f"""WITH {CALLS}
SELECT a.request_id, a.cache_key, {Q.ts('a.requested_at')} AS requested_at, CASE WHEN fresh THEN reply END AS reply,
  CASE WHEN fresh THEN 'hit' ELSE 'pending' END AS cache_status
FROM (SELECT a.*, r.reply, coalesce(a.requested_at <= r.responded_at + INTERVAL 24 HOUR, false) AS fresh
  FROM asks a ASOF LEFT JOIN replies r ON a.cache_key = r.cache_key AND a.requested_at >= r.responded_at) a""")
def cache(spark, d):
    log = V.scan_log(spark, d)
    key = F.concat(F.lit("site"), F.col("target_id").cast("string")).alias("cache_key")
    asks = log.filter("change_detected").select(F.col("event_id").alias("request_id"), key, F.col("scan_ts").alias("requested_at"))
    replies = log.filter("llm_api_called").select(
        key, (F.col("scan_ts") + F.expr("INTERVAL 20 SECONDS")).alias("responded_at"),
        F.concat(F.lit("reply "), F.col("event_id").cast("string")).alias("reply"),
    )
    return plain(A.cache_lookup(asks, replies))


BUDGET = f"""WITH {Q.SCAN_LOG},
calls AS (
  SELECT event_id AS request_id, scan_ts AS requested_at, CAST(floor(scan_duration_seconds * 10) AS BIGINT) AS tokens
  FROM scan_log WHERE llm_api_called)"""


def calls(spark, d):
    return V.scan_log(spark, d).filter("llm_api_called").select(
        F.col("event_id").alias("request_id"), F.col("scan_ts").alias("requested_at"),
        F.floor(F.col("scan_duration_seconds") * 10).cast("bigint").alias("tokens"),
    )


@query("i5_budget_gate", BUDGET + """
SELECT request_id, tokens, spent / 100 / 1000000 AS spent_before, spent < 0.10 * 100 * 1000000 AS allowed FROM (
  SELECT *, CAST(coalesce(sum(tokens * 40) OVER (PARTITION BY date_trunc('month', requested_at) ORDER BY requested_at, request_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS spent FROM calls)""")
def gate(spark, d):
    return A.budget_gate(calls(spark, d), 0.10).select("request_id", "tokens", "spent_before", "allowed")


@query("i6_fallback_summaries", f"""WITH {REQUESTS}
SELECT conv_id, turn, CASE WHEN n = 0 AND len(snippets) = 0 THEN 'Content updated' ELSE concat_ws('. ',
  CASE WHEN n > 0 THEN 'Found ' || n || ' deadline(s)' END,
  CASE WHEN n > 0 THEN array_to_string(list_transform(deadlines, lambda x: '- ' || x.type || ': ' || x.date), '. ') END,
  CASE WHEN len(snippets) > 0 THEN 'Content changes detected in ' || len(snippets) || ' locations' END) END AS summary FROM requests""")
def fallback(spark, d):
    return requests(spark, d).select("conv_id", "turn", A.fallback_summary(F.col("deadlines"), F.col("snippets")).alias("summary"))


def reply_text():
    """Replies of four kinds: full, without fields, cut off, and plain text."""
    body = F.regexp_replace("text", r'["\\\x00-\x1f]', " ")
    full = F.concat(F.lit('{"summary": "'), body, F.lit('", "relevance_score": 0.25, "categories": ["CFP", "Dates"], "key_changes": ["x"]}'))
    kind = F.col("conv_id") % 4
    return (
        F.when(kind == 0, full).when(kind == 1, F.lit('{"categories": null}'))
        .when(kind == 2, F.concat(F.lit('{"summary": "'), body)).otherwise(body)
    )


REPLY_BODY = "regexp_replace(text, '[\"\\\\\\x00-\\x1f]', ' ', 'g')"


@query("i7_parsed_replies", f"""
SELECT conv_id, turn, conv_id % 4 < 2 AS valid,
  CASE conv_id % 4 WHEN 1 THEN '{{"categories": null}}' WHEN 2 THEN '{{"summary": "' || {REPLY_BODY} ELSE {REPLY_BODY} END AS summary,
  CASE conv_id % 4 WHEN 0 THEN '0.25' WHEN 1 THEN '0.5' ELSE 'none' END AS relevance,
  CASE conv_id % 4 WHEN 0 THEN 'CFP,Dates' WHEN 1 THEN '' ELSE 'none' END AS categories FROM conversations""")
def replies(spark, d):
    rows = V.table(spark, d, "conversations").withColumn("reply", reply_text())
    parsed = rows.select("conv_id", "turn", A.parse_reply(F.col("reply")).alias("p"))
    return parsed.select(
        "conv_id", "turn", "p.valid", "p.summary", F.coalesce(F.col("p.relevance_score").cast("string"), F.lit("none")).alias("relevance"),
        F.coalesce(F.array_join("p.categories", ","), F.lit("none")).alias("categories"),
    )


@query("i8_usage_stats", BUDGET + """
SELECT strftime(date_trunc('month', requested_at), '%Y-%m-%d %H:%M:%S.%f') AS month, count(*) AS call_count,
  round(CAST(sum(tokens) AS DOUBLE) * 0.4 / 1000000, 4) AS monthly_cost, CAST(25.0 AS DOUBLE) AS cost_limit,
  round(25.0 - CAST(sum(tokens) AS DOUBLE) * 0.4 / 1000000, 4) AS remaining_budget FROM calls GROUP BY 1""")
def stats(spark, d):
    return plain(A.usage_stats(calls(spark, d), 25.0))
