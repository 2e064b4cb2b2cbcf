"""The table around change-summary calls: prompts, keys, cache, budget, replies.

The call to the service is outside; this prepares requests and reads replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.operators.running import Running, sliced_running

# How much of each list goes into a prompt, and the stand-ins.
SUMMARY_SNIPPETS, SUMMARY_KEYWORDS, SUMMARY_DEADLINES, SOURCE_CHARS = 20, 10, 5, 100
NO_DATES_SNIPPETS = 15
CLASSIFY_CHARS = 4000
NO_SNIPPETS = "(No specific snippets available)"
NO_CONTENT = "(No specific content available)"
NO_KEYWORDS = "(No keywords matched)"
NO_DEADLINES = "None extracted yet"
CUT_MARK = "... (truncated)"
CACHE_HOURS = 24
DEFAULT_RELEVANCE = 0.5

SUMMARY_TEMPLATE = (
    "Target: {name}\nChanged text:\n{snippets}\nKeywords: {keywords}\nKnown deadlines:\n{deadlines}\n"
    "Reply with JSON: summary, relevance_score, categories, key_changes, potential_dates."
)
NO_DATES_TEMPLATE = "Target: {name}\nText without dates:\n{snippets}\nReply with JSON: summary, is_cfp_related, urgency."
CLASSIFY_TEMPLATE = "Classify this page:\n{content}\nReply with JSON: is_cfp, submission_types, confidence."


def fill(template: str, **parts: Column) -> Column:
    """`template` with each {name} replaced by its column."""
    pieces, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(head), parts[name]]
    return F.concat(*pieces, F.lit(rest))


def bullets(lines: Column, limit: int, empty: str) -> Column:
    text = F.array_join(F.transform(F.slice(lines, 1, limit), lambda s: F.concat(F.lit("- "), s)), "\n")
    return F.when(text == "", F.lit(empty)).otherwise(text)


def deadline_lines(deadlines: Column) -> Column:
    lines = F.transform(
        F.slice(deadlines, 1, SUMMARY_DEADLINES),
        lambda d: F.concat(
            F.lit("- "), d["date"].cast("string"), F.lit(" ("), d["type"], F.lit("): "), F.substring(d["source_text"], 1, SOURCE_CHARS)
        ),
    )
    return F.when(F.size(deadlines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NO_DEADLINES))


def summary_prompt(name: Column, snippets: Column, keywords: Column, deadlines: Column, template: str = SUMMARY_TEMPLATE) -> Column:
    words = F.array_join(F.slice(keywords, 1, SUMMARY_KEYWORDS), ", ")
    return fill(
        template, name=name, snippets=bullets(snippets, SUMMARY_SNIPPETS, NO_SNIPPETS),
        keywords=F.when(words == "", F.lit(NO_KEYWORDS)).otherwise(words), deadlines=deadline_lines(deadlines),
    )


def no_dates_prompt(name: Column, snippets: Column, template: str = NO_DATES_TEMPLATE) -> Column:
    return fill(template, name=name, snippets=bullets(snippets, NO_DATES_SNIPPETS, NO_CONTENT))


def classify_prompt(content: Column, template: str = CLASSIFY_TEMPLATE, chars: int = CLASSIFY_CHARS) -> Column:
    shown = F.when(F.length(content) > chars, F.concat(F.substring(content, 1, chars), F.lit(CUT_MARK))).otherwise(content)
    return fill(template, content=shown)


def cache_key(target_id: Column, snippets: Column) -> Column:
    content = F.concat(target_id, F.array_join(F.slice(snippets, 1, 10), "|"))
    return F.concat(target_id, F.lit(":"), F.substring(F.sha2(content, 256), 1, 16))


def cache_lookup(requests: DataFrame, responses: DataFrame, ttl_hours: int = CACHE_HOURS) -> DataFrame:
    """Requests with the reply cached at their time, or `pending`.

    A reply is used for a request of the same key made after it, up to and
    including the time to live.  Requests and replies of a key are merged into
    one sequence and the last reply carried along, in slices of equal size, so
    a key asked for very often neither multiplies rows nor ends up in one task.
    Of replies at one time only the greatest is ever the last.
    """
    asks = requests.select(
        "cache_key", "request_id", F.col("requested_at").alias("at"), F.lit(1).alias("side"),
        F.lit(None).cast(responses.schema["reply"].dataType).alias("reply"),
    )
    replies = responses.groupBy("cache_key", F.col("responded_at").alias("at")).agg(F.max("reply").alias("reply")).select(
        "cache_key", F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), "at", F.lit(0).alias("side"), "reply",
    )
    events = asks.unionByName(replies).withColumn("answer", F.when(F.col("side") == 0, F.struct("at", "reply")))
    carried = sliced_running(events, ["cache_key"], ["at", "side", "request_id"], [Running("last", "last", F.col("answer"))])
    fresh = F.col("at") <= F.col("last.at") + F.make_dt_interval(hours=F.lit(ttl_hours))
    return carried.filter("side = 1").select(
        "request_id", "cache_key", F.col("at").alias("requested_at"),
        F.when(fresh, F.col("last.reply")).alias("reply"),
        F.when(fresh, F.lit("hit")).otherwise(F.lit("pending")).alias("cache_status"),
    )


def cost(tokens: Column) -> Column:
    """Price in micro-dollars as an exact decimal, so that sums do not depend on order."""
    return (tokens.cast("decimal(18,0)") * F.lit("0.40").cast("decimal(4,2)")).cast("decimal(28,2)")


def budget_gate(calls: DataFrame, monthly_limit_usd: float, slices: int | None = None) -> DataFrame:
    """Adds `spent_before` (USD, this month) and `allowed`.

    A call is allowed while the month's spending before it is below the limit,
    so the last allowed call may go over.  Needs request_id, requested_at and
    tokens.  A month is cut into slices of equal size (`slices` in all), so any
    number of calls at one time are spread over tasks.
    """
    monthly = calls.withColumn("month", F.date_trunc("month", "requested_at"))
    spent = Running("_spent", "sum", cost(F.col("tokens")), inclusive=False)
    out = sliced_running(monthly, ["month"], ["requested_at", "request_id"], [spent], number=slices)
    limit = F.lit(str(monthly_limit_usd)).cast("decimal(18,6)") * 1_000_000
    return out.select(
        *monthly.columns, (F.col("_spent").cast("double") / 1_000_000).alias("spent_before"), (F.col("_spent") < limit).alias("allowed")
    )


def fallback_summary(deadlines: Column, snippets: Column) -> Column:
    n = F.size(deadlines)
    head = F.when(n > 0, F.concat(F.array(F.concat(F.lit("Found "), n.cast("string"), F.lit(" deadline(s)"))), F.transform(
        F.slice(deadlines, 1, 3), lambda d: F.concat(F.lit("- "), d["type"], F.lit(": "), d["date"].cast("string")))))
    count = F.size(snippets)
    tail = F.when(count > 0, F.array(F.concat(F.lit("Content changes detected in "), count.cast("string"), F.lit(" locations"))))
    none = F.array().cast("array<string>")
    text = F.array_join(F.concat(F.coalesce(head, none), F.coalesce(tail, none)), ". ")
    return F.when(text == "", F.lit("Content updated")).otherwise(text)


REPLY = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("relevance_score", T.DoubleType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("key_changes", T.ArrayType(T.StringType())),
    T.StructField("potential_dates", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("_bad", T.StringType()),
])


def parse_reply(reply: Column) -> Column:
    """struct(valid, summary, relevance_score, ...) with defaults.

    Text that is no JSON object is the summary itself and has no other fields.
    """
    parsed = F.from_json(reply, REPLY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    valid = F.trim(reply).startswith("{") & parsed.isNotNull() & parsed["_bad"].isNull()
    none = F.array().cast("array<string>")
    return F.struct(
        valid.alias("valid"),
        F.when(valid, F.coalesce(parsed["summary"], reply)).otherwise(reply).alias("summary"),
        F.when(valid, F.coalesce(parsed["relevance_score"], F.lit(DEFAULT_RELEVANCE))).alias("relevance_score"),
        F.when(valid, F.coalesce(parsed["categories"], none)).alias("categories"),
        F.when(valid, F.coalesce(parsed["key_changes"], none)).alias("key_changes"),
        F.when(valid, parsed["potential_dates"]).alias("potential_dates"),
    )


def usage_stats(calls: DataFrame, monthly_limit_usd: float) -> DataFrame:
    """One row per month: calls made, money spent and left."""
    spent = F.sum(cost(F.col("tokens"))).cast("double") / 1_000_000
    return calls.groupBy(F.date_trunc("month", "requested_at").alias("month")).agg(
        F.count(F.lit(1)).alias("call_count"),
        F.round(spent, 4).alias("monthly_cost"),
        F.lit(float(monthly_limit_usd)).alias("cost_limit"),
        F.round(F.lit(float(monthly_limit_usd)) - spent, 4).alias("remaining_budget"),
    )
