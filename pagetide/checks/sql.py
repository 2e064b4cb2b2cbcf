"""Shared parts of the checking SQL: the derived views as CTEs."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


SCAN_LOG = """
scan_log AS (
  SELECT event_id, user_id AS target_id, ts AS scan_ts,
    'https://site' || user_id || '.example.org/' AS url,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status,
    event_type IN ('purchase', 'click') AS change_detected,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'FILTERED' ELSE 'NONE' END AS change_type,
    CASE WHEN event_type = 'purchase' THEN 1 + event_id % 3 ELSE 0 END AS deadlines_count,
    CASE WHEN event_id % 4 = 0 THEN 'playwright' ELSE 'requests' END AS fetch_method,
    event_type IN ('purchase', 'click') AND event_id % 2 = 0 AS llm_api_called,
    event_type <> 'error' AS email_sent,
    value AS scan_duration_seconds,
    CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN event_id % 6 END AS hamming_distance,
    CASE WHEN event_type = 'error' THEN 'fetch failed for scan ' || event_id END AS error_message
  FROM events)"""


def watch(source: str = "scan_log", suffix: str = "") -> str:
    """Watch state per scan, by plain windows over all scans of a target."""
    order = "PARTITION BY target_id ORDER BY scan_ts, event_id"
    s = suffix
    return f"""
w0{s} AS (
  SELECT *, status = 'succeeded' AS ok,
    CASE WHEN status <> 'succeeded' OR NOT change_detected THEN 0 WHEN deadlines_count > 0 THEN 2 ELSE 1 END AS r
  FROM {source}),
w1{s} AS (
  SELECT *,
    coalesce(max(r) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r0,
    max(r) OVER ({order} ROWS UNBOUNDED PRECEDING) AS r1,
    CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_ok
  FROM w0{s}),
w2{s} AS (
  SELECT *, ok AND n_ok = 1 AS is_baseline,
    sum(CASE WHEN ok AND (change_detected OR n_ok = 1) THEN 1 ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS island
  FROM w1{s}),
watch{s} AS (
  SELECT *,
    ['MONTHLY', 'BIWEEKLY', 'URGENT'][r0 + 1] AS previous_watch_mode,
    ['MONTHLY', 'BIWEEKLY', 'URGENT'][r1 + 1] AS new_watch_mode,
    CASE WHEN NOT ok THEN NULL WHEN r0 = 2 THEN 'ALREADY_URGENT' WHEN NOT change_detected THEN 'NO_CHANGE'
         WHEN deadlines_count > 0 THEN 'DEADLINES_PUBLISHED' WHEN r0 = 0 THEN 'CONTENT_UPDATED_NO_DATES'
         ELSE 'CONTINUE_MONITORING' END AS transition_reason,
    CAST(sum(CASE WHEN ok AND NOT change_detected AND NOT is_baseline THEN 1 ELSE 0 END)
      OVER (PARTITION BY target_id, island ORDER BY scan_ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS no_change_streak,
    CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END)
      OVER (PARTITION BY target_id, n_ok ORDER BY scan_ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS error_streak
  FROM w2{s})"""


AUDIT = """
audit AS (
  SELECT target_id, event_id, scan_ts, status,
    ok AND change_detected AS change_detected,
    CASE WHEN ok THEN change_type ELSE 'NONE' END AS change_type,
    CASE WHEN ok THEN hamming_distance END AS hamming_distance,
    CASE WHEN ok THEN deadlines_count ELSE 0 END AS deadlines_count,
    previous_watch_mode, CASE WHEN ok THEN new_watch_mode ELSE previous_watch_mode END AS new_watch_mode,
    CASE WHEN ok THEN transition_reason ELSE left('SCAN_FAILED: ' || error_message, 1000) END AS transition_reason,
    CASE WHEN ok THEN fetch_method END AS fetch_method,
    CASE WHEN ok THEN scan_duration_seconds ELSE 0 END AS scan_duration_seconds,
    ok AND llm_api_called AS llm_api_called, ok AND email_sent AS email_sent
  FROM watch)"""

HISTORY = """
history AS (
  SELECT sha256(target_id || '#' || event_id) AS run_id, target_id, event_id, url, scan_ts AS started_at, status,
    CASE WHEN status = 'succeeded' THEN fetch_method END AS fetch_method,
    CASE WHEN status = 'succeeded' THEN CAST(floor(scan_duration_seconds * 1000) AS BIGINT) END AS fetch_duration_ms,
    CASE WHEN status = 'succeeded' THEN change_detected END AS change_detected,
    CASE WHEN status = 'succeeded' THEN deadlines_count END AS deadlines_count,
    CASE WHEN status <> 'succeeded' THEN NULL WHEN NOT change_detected THEN 'NO_CHANGE'
         WHEN deadlines_count > 0 THEN 'CHANGE_WITH_DATES' ELSE 'CHANGE_NO_DATES' END AS email_type,
    CASE WHEN status = 'failed' THEN error_message END AS error_details
  FROM scan_log)"""


def state(until: str = AS_OF, suffix: str = "") -> str:
    """State of every target at `until`, with the watch CTEs it needs."""
    s = suffix
    return f"""
log{s} AS (SELECT * FROM scan_log WHERE scan_ts < {until}),
{watch(f'log{s}', s)},
last{s} AS (
  SELECT target_id, arg_max(new_watch_mode, (scan_ts, event_id)) AS mode,
    arg_max(no_change_streak, (scan_ts, event_id)) AS no_change_streak, arg_max(error_streak, (scan_ts, event_id)) AS error_streak,
    last(error_message ORDER BY scan_ts, event_id) AS error_message,
    max(scan_ts) AS any_scan, max(scan_ts) FILTER (ok) AS ok_scan, arg_max(event_id, (scan_ts, event_id)) FILTER (ok) AS ok_event,
    arg_max(scan_ts, (scan_ts, event_id)) FILTER (ok AND deadlines_count > 0) AS dl_ts,
    arg_max(deadlines_count, (scan_ts, event_id)) FILTER (ok AND deadlines_count > 0) AS dl_n,
    max(n_ok) AS total_scans
  FROM watch{s} GROUP BY target_id),
state{s} AS (
  SELECT CAST(coalesce(l.target_id, c.c_custkey) AS VARCHAR) AS target_id,
    coalesce(c.c_name, 'Target ' || l.target_id) AS name,
    'https://site' || coalesce(l.target_id, c.c_custkey) || '.example.org/' AS url,
    coalesce(mode, 'MONTHLY') AS watch_mode,
    coalesce(date_trunc('day', ok_scan) + to_days(CASE coalesce(mode, 'MONTHLY') WHEN 'MONTHLY' THEN 30 WHEN 'BIWEEKLY' THEN 14 ELSE 1 END), {until}) AS next_run_at,
    ok_scan AS last_scan_at,
    coalesce(l.target_id, c.c_custkey) % 10 <> 9 AS is_active,
    CASE WHEN ok_scan IS NOT NULL THEN sha256('page:' || l.target_id || ':' || ok_event) END AS binary_hash,
    CASE WHEN ok_scan IS NOT NULL THEN sha256('text:' || l.target_id || ':' || ok_event) END AS filtered_hash,
    ok_event * 2654435761 AS simhash,
    coalesce(list_transform(range(1, dl_n + 1), lambda i: {{
      'date': CAST(dl_ts AS DATE) + CAST(i * 30 AS INTEGER),
      'type': ['abstract', 'paper', 'registration'][i],
      'confidence': CAST(0.9 AS DOUBLE),
      'source_text': ['Abstract', 'Paper', 'Registration'][i] || ' deadline'}}), []) AS current_deadlines,
    coalesce(no_change_streak, 0) AS no_change_streak, coalesce(error_streak, 0) AS error_streak,
    coalesce(total_scans, 0) AS total_scans,
    CASE WHEN error_streak > 0 THEN error_message END AS last_error,
    coalesce(any_scan, {until}) AS updated_at
  FROM last{s} l FULL OUTER JOIN customer c ON l.target_id = c.c_custkey)"""


def with_log(body: str) -> str:
    return f"WITH {SCAN_LOG}\n{body}"


def with_watch(body: str) -> str:
    return f"WITH {SCAN_LOG},{watch()}\n{body}"


def with_audit(body: str) -> str:
    return f"WITH {SCAN_LOG},{watch()},{AUDIT}\n{body}"


def with_history(body: str) -> str:
    return f"WITH {SCAN_LOG},{HISTORY}\n{body}"


def with_state(body: str) -> str:
    return f"WITH {SCAN_LOG},{state()}\n{body}"


# ---- html and text ----------------------------------------------------------

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAK = "\ue000"
TAG = r"<[a-zA-Z/!?][^>]*>"
OPAQUE = r"(?is)<script(?:\s[^>]*)?>.*?(?:</script\s*>|\z)|<style(?:\s[^>]*)?>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
NOISE_TAGS = ("nav", "footer", "header", "aside", "iframe", "noscript")
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "copy": "©", "middot": "·", "amp": "&"}


def elements(tags: tuple[str, ...]) -> str:
    return "(?is)" + "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in tags)


def clean(html: str, tags: tuple[str, ...] = NOISE_TAGS) -> str:
    """SQL for the visible text of `html` without comments, scripts and `tags`."""
    bare = f"regexp_replace(regexp_replace(regexp_replace({html}, '{OPAQUE}', ' ', 'g'), '{elements(tags)}', ' ', 'g'), '{TAG}', ' ', 'g')"
    return squeeze(bare)


def lines(html: str, tags: tuple[str, ...]) -> str:
    """The same with the space inside text nodes left as it is."""
    bare = f"regexp_replace(regexp_replace({html}, '{OPAQUE}', '<x>', 'g'), '{elements(tags)}', '<x>', 'g')"
    for name, char in ENTITIES.items():
        bare = f"replace({bare}, '&{name};', '{char}')" if name not in ("lt", "gt") else bare
    nodes = f"string_split_regex({bare}, '{TAG}')"
    return f"array_to_string(list_filter(list_transform({nodes}, lambda n: regexp_replace(n, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda n: n <> ''), ' ')"


def squeeze(text: str) -> str:
    for name, char in ENTITIES.items():
        text = f"replace({text}, '&{name};', '{char}')"
    return f"trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'), ' ')"


SNAPSHOT_PAIRS = """
snapshot_pairs AS (
  SELECT page_id, url, CASE WHEN page_id % 5 = 3 THEN NULL ELSE html END AS old_html,
    CASE WHEN page_id % 5 = 1 THEN replace(html, '<nav>', '<nav>v2 ')
         WHEN page_id % 5 = 2 THEN replace(html, '</article>', '<p>Updated notice.</p></article>')
         WHEN page_id % 5 = 4 THEN concat(html, '<!-- v2 -->') ELSE html END AS new_html
  FROM pages)"""


def simhash(source: str, keys: str, text: str, name: str = "sims") -> str:
    """CTEs ending in `name`(keys, simhash): token votes bit by bit."""
    ones = ", ".join(f"sum((h >> {k}) & 1) AS b{k}" for k in range(32))
    ones_high = ", ".join(f"sum((g >> {k}) & 1) AS b{k + 32}" for k in range(32))
    low = " + ".join(f"CASE WHEN 2 * b{k} >= n THEN {1 << k} ELSE 0 END" for k in range(32))
    high = " + ".join(f"CASE WHEN 2 * b{k + 32} >= n THEN {1 << k if k < 31 else -(1 << 31)} ELSE 0 END" for k in range(32))
    return f"""
{name}_tokens AS (
  SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM {source}),
{name}_words AS (
  SELECT DISTINCT token, ('0x' || substr(sha256(token), 1, 8))::BIGINT AS g, ('0x' || substr(sha256(token), 9, 8))::BIGINT AS h
  FROM {name}_tokens),
{name}_votes AS (
  SELECT {keys}, count(*) AS n, {ones}, {ones_high} FROM {name}_tokens JOIN {name}_words USING (token) GROUP BY {keys}),
{name} AS (
  SELECT {keys}, CAST(coalesce(s.sig, 0) AS BIGINT) AS simhash FROM {source}
  LEFT JOIN (SELECT {keys}, ({high}) * 4294967296::HUGEINT + ({low}) AS sig FROM {name}_votes) s USING ({keys}))"""
