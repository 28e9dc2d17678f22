"""Requests to services, some at a time in each task, with a ledger of what has been answered.

Requests are dealt to tasks by host, so a host's rate holds for the whole job: one task asks it, with at most `at_once` requests
on their way and `pause` seconds between two starts. A request that fails for now (busy, too many, timeout, reset) is put off,
twice as long each time, and the task goes on with others meanwhile. Every answer becomes a row of the ledger, a folder of
Parquet files: a run asks what has no final answer there yet, so one that was stopped goes on where it was. Answers are
written as each task ends; a task that runs again asks its own requests again.

Defined results: rows with a null key or address are left out; of rows with one key that with the least address is asked.
status is the HTTP status, or 0 where there was none; error names the failure. final is false where all tries failed for now.
A body of bytes is posted, a null body is a GET. An empty table asks nothing and gives no rows.
"""

from __future__ import annotations

import heapq
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statuses that say "not now".
AGAIN = frozenset((408, 425, 429, 500, 502, 503, 504))
ANSWER = "key string, url string, status int, answer string, error string, tries int, final boolean, seconds double, asked_at double"


def send(method: str, url: str, body: bytes | None, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
    """(status, body) of one request; errors of the connection are raised."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers, method=method), timeout=timeout) as r:  # noqa: S310
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


class Rest:
    """The four verbs of a service under one address. send can be replaced in tests."""

    def __init__(self, base: str, headers: dict[str, str] | None = None, timeout: float = 60, send: Callable = send):
        self.base, self.headers, self.timeout, self.send = base.rstrip("/"), headers or {}, timeout, send

    def _ask(self, method: str, path: str, body: bytes | None = None, **headers: str) -> tuple[int, bytes]:
        return self.send(method, f"{self.base}/{path.lstrip('/')}", body, {**self.headers, **headers}, self.timeout)

    def get(self, path: str, **headers: str) -> tuple[int, bytes]:
        return self._ask("GET", path, None, **headers)

    def post(self, path: str, body: bytes, **headers: str) -> tuple[int, bytes]:
        return self._ask("POST", path, body, **headers)

    def put(self, path: str, body: bytes, **headers: str) -> tuple[int, bytes]:
        return self._ask("PUT", path, body, **headers)

    def delete(self, path: str, **headers: str) -> tuple[int, bytes]:
        return self._ask("DELETE", path, None, **headers)


@dataclass(frozen=True)
class Manners:
    """How a service is asked."""

    at_once: int = 4
    pause: float = 1.0
    tries: int = 5
    wait: float = 2.0
    timeout: float = 60.0
    send: Callable = send

    def once(self, url: str, body: bytes | None) -> tuple[int, str | None, str | None]:
        """(status, text, error) of one try."""
        try:
            status, data = self.send("GET" if body is None else "POST", url, body, {}, self.timeout)
        except TimeoutError:
            return 408, None, "TimeoutError"
        except urllib.error.URLError as e:
            return (408 if isinstance(e.reason, TimeoutError) else 0), None, type(e.reason).__name__
        except (OSError, ValueError) as e:
            return 0, None, type(e).__name__
        return status, data.decode("utf-8", "replace") if 200 <= status < 300 else None, None

    def ask(self, rows: list[tuple[str, str, bytes | None]]) -> Iterator[tuple]:
        """The answers to (key, url, body), as they come."""
        waiting = [(0.0, k, 0) for k in range(len(rows))]  # not before, which, tries so far
        heapq.heapify(waiting)
        started: dict[str, float] = {}  # when each host was asked last
        running: dict = {}
        with ThreadPoolExecutor(self.at_once) as pool:
            while waiting or running:
                now = time.monotonic()
                while waiting and len(running) < self.at_once and waiting[0][0] <= now:
                    _, k, tries = heapq.heappop(waiting)
                    host = urlsplit(rows[k][1]).netloc
                    free = started.get(host, -1e9) + self.pause
                    if free > now:
                        heapq.heappush(waiting, (free, k, tries))
                        continue
                    started[host] = now
                    running[pool.submit(self.once, rows[k][1], rows[k][2])] = (k, tries + 1, now)
                soon = max(0.0, waiting[0][0] - time.monotonic()) if waiting else 3600.0
                if not running:
                    time.sleep(soon)
                    continue
                done, _ = wait(running, timeout=soon if len(running) < self.at_once else 3600.0, return_when=FIRST_COMPLETED)
                for f in done:
                    k, tries, began = running.pop(f)
                    status, text, error = f.result()
                    for_now = status in AGAIN or status == 0 and error != "ValueError"
                    if for_now and tries < self.tries:
                        heapq.heappush(waiting, (time.monotonic() + self.wait * 2 ** (tries - 1), k, tries))
                    else:
                        yield rows[k][0], rows[k][1], status, text, error, tries, not for_now, time.monotonic() - began, time.time()


def answered(spark, ledger: str) -> DataFrame | None:
    """The last answer to each key; None where nothing has been asked yet."""
    try:
        rows = spark.read.schema(ANSWER).parquet(ledger)
    except AnalysisException:
        return None
    last = W.partitionBy("key").orderBy(F.col("final").desc(), F.col("asked_at").desc())
    return rows.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def fetch(requests: DataFrame, ledger: str, manners: Manners | None = None, key: str = "key", url: str = "url", body: str | None = None, tasks: int | None = None) -> DataFrame:
    """Ask all requests that have no final answer in the ledger; the last answer to each of them."""
    spark, manners = requests.sparkSession, manners or Manners()
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), (F.col(body).cast("binary") if body else F.lit(None).cast("binary")).alias("body"))
    rows = rows.filter("key is not null and url is not null").groupBy("key").agg(F.min_by(F.struct("url", "body"), "url").alias("x")).select("key", "x.url", "x.body")
    before = answered(spark, ledger)
    rest = rows if before is None else rows.join(before.filter("final").select("key"), "key", "left_anti")
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            some = list(b[["key", "url", "body"]].itertuples(index=False, name=None))
            yield pd.DataFrame(list(manners.ask(some)), columns=[c.split()[0] for c in ANSWER.split(", ")])

    dealt = rest.withColumn("host", host).repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "host").sortWithinPartitions("host", "key")
    dealt.mapInPandas(run, ANSWER).write.mode("append").parquet(ledger)
    return answered(spark, ledger).join(rows.select("key"), "key", "left_semi")
