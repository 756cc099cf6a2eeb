"""Money and limits. Balances are long micro-cents (1 USD = 1e8); rates are decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.calendar import monthly_bounds, week_end, week_start
from quillspark.functions.text import half_up

RATE = "decimal(18,8)"
LARGE_CONTEXT = 200_000
COMPACTION_BUFFER = 20_000
RETRY_FIRST_MS, RETRY_FACTOR, RETRY_MOST_MS = 2000, 2, 30_000


def cents_to_micro(cents: Column) -> Column:
    return half_up(cents * 1_000_000).cast("long")


def step_cost(tokens: dict[str, Column], rates: dict[str, Column], large: dict[str, Column] | None = None) -> Column:
    """Cost of a step in USD: tokens input, output, reasoning, cache_read, cache_write at rates per
    million (F25). Reasoning is charged as output; ``large`` rates hold beyond 200 000 tokens of
    input and cache reads."""
    def total(r: dict[str, Column]) -> Column:
        each = [
            tokens["input"].cast("decimal(20,0)") * r["input"].cast(RATE),
            tokens["output"].cast("decimal(20,0)") * r["output"].cast(RATE),
            tokens["cache_read"].cast("decimal(20,0)") * F.coalesce(r["cache_read"], F.lit(0)).cast(RATE),
            tokens["cache_write"].cast("decimal(20,0)") * F.coalesce(r["cache_write"], F.lit(0)).cast(RATE),
            tokens["reasoning"].cast("decimal(20,0)") * r["output"].cast(RATE),
        ]
        out = each[0]
        for x in each[1:]:
            out = out + x
        return (out.cast("decimal(28,8)") * F.lit("0.000001").cast("decimal(7,6)")).cast("double")

    if large is None:
        return total(rates)
    return F.when(tokens["input"] + tokens["cache_read"] > LARGE_CONTEXT, total(large)).otherwise(total(rates))


def hosted_cost(tokens: dict[str, Column], rates: dict[str, Column], large: dict[str, Column]) -> Column:
    """Hosted cost in micro-cents (F26): a missing or zero token count or cache rate adds nothing."""
    caches = ("cache_read", "cache_write_5m", "cache_write_1h")
    context = tokens["input"] + sum((F.coalesce(tokens[c], F.lit(0)) for c in caches), F.lit(0))

    def cents(r: dict[str, Column]) -> Column:
        out = r["input"] * tokens["input"] * 100 + r["output"] * tokens["output"] * 100
        out = out + F.coalesce(r["output"] * tokens["reasoning"] * 100, F.lit(0.0))
        for c in caches:
            out = out + F.coalesce(r[c] * tokens[c] * 100, F.lit(0.0))
        return out

    return cents_to_micro(F.when(context > LARGE_CONTEXT, cents(large)).otherwise(cents(rates)))


def processing_fee(cents: Column) -> Column:
    """Card fee in cents, grossed up."""
    return half_up(((cents + 30) / F.lit(0.956)) * F.lit(0.044) + 30).cast("long")


def _status(fresh: Column, usage: Column, limit: Column, until: Column, full: Column) -> Column:
    ok = fresh & (usage >= limit)
    return F.struct(
        F.when(ok, "rate-limited").otherwise("ok").alias("status"),
        F.when(fresh, until).otherwise(full).cast("long").alias("reset_sec"),
        F.when(~fresh, 0).when(ok, 100).otherwise(F.floor(F.least(F.lit(100.0), usage / limit * 100))).cast("long").alias("percent"),
    )


def _seconds(a: Column, b: Column) -> Column:
    return F.ceil((F.unix_micros(b) - F.unix_micros(a)) / 1_000_000)


def rolling_status(usage: Column, updated: Column, now: Column, limit_usd: Column, window_hours: int) -> Column:
    """Status of a rolling limit (F28): usage older than the window counts as none."""
    start = now - F.expr(f"INTERVAL {window_hours} HOURS")
    until = _seconds(now, updated + F.expr(f"INTERVAL {window_hours} HOURS"))
    return _status(updated >= start, usage, cents_to_micro(limit_usd * 100), until, F.lit(window_hours * 3600))


def weekly_status(usage: Column, updated: Column, now: Column, limit_usd: Column) -> Column:
    until = _seconds(now, week_end(now))
    return _status(updated >= week_start(now), usage, cents_to_micro(limit_usd * 100), until, until)


def monthly_status(usage: Column, updated: Column, now: Column, subscribed: Column, limit_usd: Column) -> Column:
    start, end = monthly_bounds(now, subscribed)
    until = _seconds(now, end)
    return _status(updated >= start, usage, cents_to_micro(limit_usd * 100), until, until)


def overflows(total: Column, parts: Column, context: Column, input_limit: Column, max_output: Column, reserved: Column | None = None) -> Column:
    """Whether a context is used up (F29): a zero total falls back to the parts' sum, a zero context
    never overflows, and an input limit leaves a reserve of its own."""
    count = F.when(F.coalesce(total, F.lit(0)) == 0, parts).otherwise(total)
    kept = F.least(F.lit(COMPACTION_BUFFER), max_output) if reserved is None else reserved
    usable = F.when(F.coalesce(input_limit, F.lit(0)) > 0, input_limit - kept).otherwise(context - max_output)
    return (context != 0) & (count >= usable)


def frecency(frequency: Column, days: Column) -> Column:
    return frequency / (1 + days)


def retry_delay(attempt: Column) -> Column:
    """Milliseconds before an attempt, doubling up to a cap."""
    return F.least(F.lit(RETRY_FIRST_MS) * F.pow(F.lit(RETRY_FACTOR), attempt - 1), F.lit(RETRY_MOST_MS)).cast("long")


def normalized_usage(provider: Column, usage: Column) -> Column:
    """Four providers' usage JSON as one struct (F52): cached tokens leave the input they are part
    of, and reasoning leaves the output where the provider counts it in."""
    get = lambda path: F.coalesce(F.get_json_object(usage, path).cast("long"), F.lit(0))
    out = lambda i, o, r, cr, cw: F.struct(i.alias("input"), o.alias("output"), r.alias("reasoning"), cr.alias("cache_read"), cw.alias("cache_write"))
    zero = F.lit(0).cast("long")
    messages = out(get("$.input_tokens"), get("$.output_tokens"), zero, get("$.cache_read_input_tokens"), get("$.cache_creation_input_tokens"))
    cached, thought = get("$.input_tokens_details.cached_tokens"), get("$.output_tokens_details.reasoning_tokens")
    responses = out(get("$.input_tokens") - cached, get("$.output_tokens") - thought, thought, cached, zero)
    held = get("$.prompt_tokens_details.cached_tokens")
    chat = out(get("$.prompt_tokens") - held, get("$.completion_tokens"), get("$.completion_tokens_details.reasoning_tokens"), held, zero)
    kept = get("$.cachedContentTokenCount")
    generate = out(get("$.promptTokenCount") - kept, get("$.candidatesTokenCount"), get("$.thoughtsTokenCount"), kept, zero)
    return F.when(provider == "messages", messages).when(provider == "responses", responses).when(provider == "generate", generate).otherwise(chat)
