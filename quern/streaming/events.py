"""Event logic: repeated-query detection, burn rates, rate limiters, circuit breakers, a leased job queue, state machines, fan-out.

What depends on windows is declarative; what depends on earlier decisions is a fold over the sorted events of a key, in
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import backoff_ms


def n_plus_one(log: DataFrame, template: str, micros: str, threshold: int, window_us: int) -> DataFrame:
    """One alert per template: the first record with threshold records in [its time, its time + window], both ends inside; the count is the whole group's.

    Time is cut into stretches as long as the window, of which the first threshold records decide: a stretch that has so
    many is full from its first one on, and what follows a record in its window is in its stretch or the next. So no task
    holds a template, and no window is counted through.
    """
    least, width = max(threshold, 1), max(window_us, 1)
    rows = log.select(F.col(template).alias("_of"), F.col(micros).alias("_us")).withColumn("_at", F.col("_us") - F.pmod("_us", F.lit(width)))
    stretch = Window.partitionBy("_of", "_at").orderBy("_us")
    first = rows.withColumn("_n", F.row_number().over(stretch)).filter(F.col("_n") <= least)
    both = first.select("_of", "_us", F.posexplode(F.array("_at", F.col("_at") - width)).alias("_ahead", "_at")).filter("_ahead = 0 OR _at IS NOT NULL")
    ends = both.withColumns({"_end": F.lead("_us", least - 1).over(stretch), "_more": F.lead(F.lit(True), least - 1).over(stretch)})
    # Records without a time are in each other's windows only.
    hit = ends.filter((F.col("_ahead") == 0) & F.when(F.col("_us").isNull(), F.col("_more")).otherwise(F.col("_end") - F.col("_us") <= window_us))
    starts = hit.groupBy(F.col("_of").alias("_t")).agg(F.min("_us").alias("_start"))
    inside = F.when(F.col("_us") - F.col("_start") <= window_us, F.col("_us"))
    found = rows.join(starts, F.col("_of").eqNullSafe(F.col("_t"))).groupBy("_t", "_start").agg(F.count(F.lit(1)).alias("_n"), F.max(inside).alias("_last"))
    timed = F.col("_start").isNotNull()
    return found.select(F.col("_t").alias(template), F.when(timed, F.col("_n")).alias("count"), (F.col("_last") - F.col("_start")).alias("span_us")).orderBy(F.desc("count"), template)


def windowed(events: DataFrame, ts: str, failed: Column, minutes: int, name: str) -> DataFrame:
    """Failures and total of tumbling windows, by their start."""
    w = F.window(ts, f"{minutes} minutes")
    return events.groupBy(w.alias("_w")).agg(F.count_if(failed).alias(f"bad_{name}"), F.count(F.lit(1)).alias(f"all_{name}")).select(F.col("_w.start").alias(f"start_{name}"), f"bad_{name}", f"all_{name}")


def burn_rates(events: DataFrame, ts: str, failed: Column, target: float) -> DataFrame:
    """Per 5-minute window: burn rates of it and of the 30-minute, 1-hour and 6-hour windows it lies in, alerts page and ticket, and the budget left.

    One scan counts 5-minute windows; the longer ones are sums over these few rows.
    """
    out = windowed(events, ts, failed, 5, "5m")
    burn = lambda n: F.round(F.coalesce(F.try_divide(F.col(f"bad_{n}"), F.col(f"all_{n}")), F.lit(0.0)) / (1 - target), 6)
    for name, minutes in (("30m", 30), ("1h", 60), ("6h", 360)):
        w = Window.partitionBy(F.window(F.col("start_5m"), f"{minutes} minutes"))
        out = out.withColumn(f"bad_{name}", F.sum("bad_5m").over(w)).withColumn(f"all_{name}", F.sum("all_5m").over(w))
    out = out.withColumns({f"burn_{n}": burn(n) for n in ("5m", "30m", "1h", "6h")})
    left = F.round(1 - F.least(F.coalesce(F.try_divide(F.col("bad_6h"), F.col("all_6h")), F.lit(0.0)) / (1 - target), F.lit(1.0)), 6)
    return out.select("start_5m", *(f"burn_{n}" for n in ("5m", "30m", "1h", "6h")), ((F.col("burn_5m") > 14.4) & (F.col("burn_1h") > 14.4)).alias("page"), ((F.col("burn_30m") > 6) & (F.col("burn_6h") > 6)).alias("ticket"), left.alias("budget_left"))


def folded(events: DataFrame, key: str, micros: str, order: str, fold, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows key, order and what fold yields for each, in the order of time: fold takes the sorted rows of one key. Keys are shuffled once."""
    out_schema, run = fold
    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {out_schema}"

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([micros, order])
        rows = list(run(frame[[micros, *carry]].itertuples(index=False, name=None)))
        out = frame[[key, order]].reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(rows, columns=[c.split()[0] for c in out_schema.split(", ")])], axis=1)

    return events.select(key, micros, order, *carry).groupBy(key).applyInPandas(each, schema)


def sliding_window(most: int, window_us: int):
    """Accepts while fewer than most accepted ones lie in the window; what is rejected is not remembered."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple[bool]]:
        kept: list[int] = []
        for (now,) in rows:
            kept = [t for t in kept if t > now - window_us]
            ok = len(kept) < most
            if ok:
                kept.append(now)
            yield (ok,)

    return "accepted boolean", run


def token_bucket(capacity: float, per_second: float):
    def run(rows: Iterator[tuple]) -> Iterator[tuple[bool]]:
        tokens, last = capacity, None
        for (now,) in rows:
            if last is not None:
                tokens = min(capacity, tokens + (now - last) / 1e6 * per_second)
            last = now
            ok = tokens >= 1
            tokens -= ok
            yield (ok,)

    return "accepted boolean", run


def circuit_breaker(window_us: int, threshold: float, cooldown_us: int, successes: int, least: int = 1):
    """Rows are (time, failed). Closed opens at a failure with the share of failures in the window at the threshold; after the cooldown it is half open, where a failure opens it and so many successes close it."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple[str]]:
        state, seen, opened, good = "closed", [], 0, 0
        for now, failed in rows:
            if state == "open" and now - opened >= cooldown_us:
                state, good = "half_open", 0
            if state == "closed":
                seen = [x for x in seen if x[0] > now - window_us] + [(now, failed)]
                if failed and len(seen) >= least and sum(f for _, f in seen) / len(seen) >= threshold:
                    state, opened = "open", now
            elif state == "half_open":
                if failed:
                    state, opened = "open", now
                else:
                    good += 1
                    if good >= successes:
                        state, seen = "closed", []
            yield (state,)

    return "state string", run


def state_machine(start: str, transitions: dict[tuple[str, str], tuple[str, object]]):
    """Rows are (time, event, value). transitions: (state, event) to the next state and a guard on the value, or None. An event that doesn't fit changes nothing."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple[str, int]]:
        state, version = start, 0
        for _, event, value in rows:
            to, allowed = transitions.get((state, event), (None, None))
            if to is not None and (allowed is None or allowed(value)):
                state, version = to, version + 1
            yield state, version

    return "state string, version int", run


def limiter_key(user: Column, ip: Column, route: Column, by: str, forwarded: Column | None = None, trusted: bool = False) -> Column:
    """user, ip or ip_route; a forwarded address counts only from a trusted proxy, and of it the first hop."""
    if trusted and forwarded is not None:
        ip = F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), ip)
    if by == "user":
        return F.when(user.isNotNull(), F.concat(F.lit("user:"), user.cast("string"))).otherwise(F.concat(F.lit("ip:"), ip))
    return F.concat(F.lit("ip:"), ip, *([F.lit(":"), route] if by == "ip_route" else []))


def reclaimed(jobs: DataFrame, now: int, lease: int, strict: bool = True) -> DataFrame:
    """Running jobs whose lease is over are pending again; strict waits another lease after it."""
    over = (F.col("status") == "running") & (F.col("locked_until") < now - (lease if strict else 0))
    return jobs.withColumns({"status": F.when(over, "pending").otherwise(F.col("status")), "locked_until": F.when(over, None).otherwise(F.col("locked_until"))})


def claimed(jobs: DataFrame, now: int, lease: int, n: int) -> DataFrame:
    """The first n pending jobs that are due, as running: one attempt more, locked for a lease."""
    due = jobs.filter((F.col("status") == "pending") & (F.col("run_after") <= now)).orderBy("created_at", "id").limit(n)
    return due.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "locked_until": F.lit(now + lease)})


def finished(jobs: DataFrame, outcome: str, now: int, attempts: int, base: float, cap: float) -> DataFrame:
    """By outcome (ok, temporary, permanent): succeeded; pending again after a wait while attempts last; else dead."""
    retry = (F.col(outcome) == "temporary") & (F.col("attempts") <= attempts)
    status = F.when(F.col(outcome) == "ok", "succeeded").when(retry, "pending").otherwise("dead")
    return jobs.withColumns({"status": status, "run_after": F.when(retry, F.lit(now) + backoff_ms(F.col("attempts"), base, cap)).otherwise(F.col("run_after"))})


def retry_dead(jobs: DataFrame, now: int) -> DataFrame:
    dead = F.col("status") == "dead"
    return jobs.withColumns({"status": F.when(dead, "pending").otherwise(F.col("status")), "attempts": F.when(dead, 0).otherwise(F.col("attempts")), "run_after": F.when(dead, F.lit(now)).otherwise(F.col("run_after"))})


def fan_out(events: DataFrame, subscriptions: DataFrame, kind: str) -> DataFrame:
    """Each event once for each subscriber of its type."""
    return events.join(subscriptions, kind)


def exhausted(events: DataFrame, retries: str = "retry_count", most: int = 3) -> DataFrame:
    return events.filter(F.col(retries) >= most)


def scale_step(timeouts: Column, idle: Column) -> Column:
    return F.when(timeouts > 0.3, 1).when(idle > 0.7, -1).otherwise(0)


def stream_burn(events: DataFrame, ts: str, failed: Column, late: str = "10 minutes") -> DataFrame:
    """The 5-minute counts as a stream: late events count until the watermark has passed their window."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "5 minutes")).agg(F.count_if(failed).alias("bad"), F.count(F.lit(1)).alias("all")).select(F.col("window.start").alias("start"), "bad", "all")


def stream_limiter(events: DataFrame, key: str, micros: str, order: str, most: int, window_us: int) -> DataFrame:
    """The sliding-window limiter as a stream; each key's accepted times are its state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = dict(events.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for frame in frames:
            frame = frame.sort_values([micros, order])
            out = []
            for now in frame[micros]:
                kept = [t for t in kept if t > now - window_us]
                out.append(len(kept) < most)
                if out[-1]:
                    kept.append(int(now))
            yield pd.DataFrame({key: k[0], order: frame[order].to_numpy(), "accepted": out})
        state.update((kept,))

    return events.select(key, micros, order).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, accepted boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)
