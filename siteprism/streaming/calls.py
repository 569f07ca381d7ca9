"""Calls of a model from a stream, limited and tried again by keyed state with timers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Calls in so many seconds, attempts, and the least and most seconds between two of them (fixed values).
RATE, PER, ATTEMPTS, LEAST, MOST = 500, 60.0, 5, 4.0, 60.0

#: What state with timers is kept in; the session must name it before such a stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

RESULT = "id string, status string, attempt int, at_ms long, output string, error string"


def wait_ms(attempt: int, least: float = LEAST, most: float = MOST) -> int:
    """Milliseconds after so many failed attempts: 1, 2, 4, ... seconds, but within bounds."""
    return int(1000 * max(least, min(2.0 ** (attempt - 1), most)))


def refilled(tokens: float, since_ms: int, now_ms: int, rate: float, per: float) -> float:
    """Tokens of a bucket that holds ``rate`` at most and gets as many in ``per`` seconds."""
    return min(rate, tokens + max(0, now_ms - since_ms) * rate / (1000 * per))


def replayed(context: dict, attempt: int) -> dict:
    """A call that gives landed replies (context.replies, JSON texts) again, attempt by attempt; a null or missing one fails."""
    replies = context.get("replies") or []
    reply = replies[attempt - 1] if attempt <= len(replies) else None
    if reply is None:
        raise LookupError(f"no reply to attempt {attempt}")
    return json.loads(reply)


class Calls(StatefulProcessor):
    """One share of the limit: a token bucket, and the calls that wait for a token or for their next attempt.

    Time is that of the rows and of the watermark. A call that finds no token waits until there is one; one that
    fails waits longer each time, until its last attempt, which ends in a dead letter. Nothing is held in memory
    between batches: after a restart the state and its timers go on from the last batch that was committed.
    """

    def __init__(self, call: Callable[[dict, int], dict], rate: float, per: float, attempts: int):
        self.call, self.rate, self.per, self.attempts = call, rate, per, attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, at long")
        self.waiting = handle.getMapState("waiting", "id string", "context string, attempt int, due long")

    def _try(self, id_: str, context: str, attempt: int, now: int) -> list[tuple]:
        tokens, since = self.bucket.get() if self.bucket.exists() else (self.rate, now)
        tokens = refilled(tokens, since, now, self.rate, self.per)
        if tokens < 1 - 1e-9:
            self.bucket.update((tokens, max(now, since)))
            self._wait(id_, context, attempt, now + int((1 - tokens) * 1000 * self.per / self.rate) + 1)
            return []
        self.bucket.update((max(0.0, tokens - 1), max(now, since)))
        try:
            return [(id_, "done", attempt, now, json.dumps(self.call(json.loads(context), attempt)), None)]
        except Exception as e:  # whatever a caller's function raises
            if attempt >= self.attempts:
                return [(id_, "dead_letter", attempt, now, None, str(e))]
            self._wait(id_, context, attempt + 1, now + wait_ms(attempt))
            return []

    def _wait(self, id_: str, context: str, attempt: int, due: int) -> None:
        self.waiting.updateValue((id_,), (context, attempt, due))
        self.handle.registerTimer(due)

    def _told(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values(["at_ms", "id"])
        yield from self._told([r for x in fresh.itertuples() for r in self._try(x.id, x.context, 1, int(x.at_ms))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((v[2], k[0], v[0], v[1]) for k, v in list(self.waiting.iterator()) if v[2] <= now)
        out = []
        for _, id_, context, attempt in due:
            self.waiting.removeKey((id_,))
            out += self._try(id_, context, attempt, now)
        yield from self._told(out)

    def close(self) -> None:
        return


def limited_calls(queue: DataFrame, call: Callable[[dict, int], dict], shares: int = 8, rate: float = RATE, per: float = PER, attempts: int = ATTEMPTS, late: str = "0 seconds") -> DataFrame:
    """id, status (done or dead_letter), attempt, at_ms, output, error of each call of a streamed queue (id, context, at).

    ``context`` is a struct, which ``call`` gets as a dictionary with the number of the attempt; ``at`` is the time of
    the request. The limit is dealt over ``shares`` of ids, each with its part of it, so at most as many tasks call at
    a time and together never more than ``rate`` in ``per`` seconds beyond one full bucket. Timers follow the watermark
    of ``at``, ``late`` behind it. The session's state store must be PROVIDER.
    """
    rows = queue.withWatermark("at", late).select(F.pmod(F.xxhash64("id"), F.lit(shares)).alias("share"), "id", F.to_json("context").alias("context"), "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("share").transformWithStateInPandas(Calls(call, rate / shares, per, attempts), RESULT, "Append", "EventTime")
