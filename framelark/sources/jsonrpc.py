"""Live reader: traces of a JSON-RPC node as a Spark data source, one partition for each range of blocks and direction.

``spark.read.format("jsonrpc_traces").option("url", ..).option("addresses", "0xa,0xb").option("from", 1).option("to", 9999).load()``
gives ``json`` rows for ``wire.flat_frames``. Ranges are planned before anything is read, so executors share the work and a lost
one repeats its ranges alone. Within a range slices of blocks are read newest first: a slow or failing one is halved, a fast one that
filled no page doubled. What was not read, as the provider refused or the time was over, is a row too: ``from_block, to_block, note``
without json, so that no count pretends to it. ``asked`` sends any other calls of a table, so many at a time.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Frames of a page, attempts of a request and seconds of an attempt; blocks of a slice at least and at most; seconds from which a slice is slow, and up to which it is fast.
PAGE, ATTEMPTS, TIMEOUT, LEAST, MOST, SLOW, FAST = 500, 4, 20, 25, 2000, 8.0, 1.0
TRANSIENT = re.compile(r"timeout|timed out|capacity|rate limit|try again", re.I)
#: What a provider says of a range that is too much for it, and would answer in parts.
TOO_MUCH = re.compile(r"too (large|many|big|wide)|limit|exceed|response size|block range", re.I)
LATE = "the time for it was over"


class RpcError(Exception):
    """A request that failed; its text holds no part of the endpoint's address. ``busy``: a smaller or later one may succeed."""

    def __init__(self, text: str, busy: bool = False):
        super().__init__(text)
        self.busy = busy


def transient(message: str, status: int) -> bool:
    return status == 429 or status >= 500 or bool(TRANSIENT.search(message))


def scrub(text: str, secrets: list[str]) -> str:
    for secret in sorted(filter(None, secrets), key=len, reverse=True):
        text = text.replace(secret, "***")
    return text


def secrets_of(url: str) -> list[str]:
    """The address and what in it may be a credential: its path, query and user."""
    rest = url.split("://", 1)[-1]
    host, _, path = rest.partition("/")
    return [url, path, *filter(lambda p: len(p) > 8, re.split(r"[/?=&]", path)), *([host.split("@")[0]] if "@" in host else [])]


def call(url: str, method: str, params: list, attempts: int = ATTEMPTS, pause: float = 0.4):
    """The result of one call. What may pass is tried again after pause * attempt^2 seconds; a refusal fails at once."""
    body = json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}).encode()
    for attempt in range(1, attempts + 1):
        status = 0
        try:
            request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                status, text = answer.status, answer.read().decode("utf-8", "replace")
            try:
                reply = json.loads(text)
            except ValueError:
                raise RpcError(f"{method}: the answer is not JSON") from None
            if "error" not in reply:
                return reply.get("result")
            failure = f"{method}: {reply['error'].get('message', 'error')}"
        except urllib.error.HTTPError as e:
            status, failure = e.code, f"{method}: HTTP {e.code}"
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            status, failure = 599, f"{method}: {getattr(e, 'reason', e)}"
        if attempt == attempts or not transient(failure, status):
            raise RpcError(scrub(failure, secrets_of(url)), transient(failure, status) or bool(TOO_MUCH.search(failure))) from None
        time.sleep(pause * attempt**2)


@dataclass
class Range(InputPartition):
    low: int
    high: int
    direction: str


class TraceReader(DataSourceReader):
    """Options: url, addresses, from, to; step (blocks of a partition), slice (blocks of its first slice), page, pause, seconds (for a partition), slow and fast (seconds of a slice)."""

    def __init__(self, options):
        self.url = options["url"]
        self.addresses = [a.strip().lower() for a in options.get("addresses", "").split(",") if a.strip()]
        self.low, self.high = int(options["from"]), int(options["to"])
        self.step, self.page = int(options.get("step", 10 * MOST)), int(options.get("page", PAGE))
        self.slice, self.pause = int(options.get("slice", 200)), float(options.get("pause", 0.4))
        self.seconds, self.slow, self.fast = (float(options.get(k, v)) for k, v in (("seconds", "inf"), ("slow", SLOW), ("fast", FAST)))

    def partitions(self):
        lows = range(self.low, self.high + 1, self.step)
        return [Range(low, min(low + self.step - 1, self.high), d) for low in lows for d in ("toAddress", "fromAddress")]

    def read(self, partition):
        top, size, began = partition.high, max(1, self.slice), time.monotonic()
        while top >= partition.low:
            if time.monotonic() - began > self.seconds:
                yield None, partition.low, top, LATE
                return
            low, started = max(partition.low, top - size + 1), time.monotonic()
            try:
                frames, full = self.frames(low, top, partition.direction)
            except RpcError as e:
                if e.busy and top - low + 1 > LEAST:
                    size = max(LEAST, (top - low + 1) // 2)
                    continue
                # a refusal holds for the rest of the range too; one slice that is too much does not
                yield None, low if e.busy else partition.low, top, str(e)
                if not e.busy:
                    return
                top = low - 1
                continue
            took = time.monotonic() - started
            for frame in frames:
                yield json.dumps(frame), low, top, None
            top = low - 1
            if took > self.slow:
                size = max(LEAST, size // 2)
            elif took < self.fast and not full:
                size = min(MOST, size * 2)

    def frames(self, low, high, direction):
        """The frames of a slice, and whether some page was full."""
        out = []
        while True:
            query = {"fromBlock": hex(low), "toBlock": hex(high), direction: self.addresses, "after": len(out), "count": self.page}
            page = call(self.url, "trace_filter", [query], pause=self.pause) or []
            out += page
            if len(page) < self.page:
                return out, len(out) >= self.page


class JsonRpcTraces(DataSource):
    @classmethod
    def name(cls):
        return "jsonrpc_traces"

    def schema(self):
        return "json string, from_block long, to_block long, note string"

    def reader(self, schema):
        return TraceReader(self.options)


def read_frames(rows: DataFrame) -> DataFrame:
    """The ``json`` of what was read."""
    return rows.where("note is null").select("json")


def unread(rows: DataFrame) -> DataFrame:
    """``from_block, to_block, note`` of the windows that were not read in some direction, each once."""
    return rows.where("note is not null").groupBy("from_block", "to_block").agg(F.min("note").alias("note"))


def asked(calls: DataFrame, url: str, at_once: int = 6, seconds: float = float("inf"), pause: float = 0.4) -> DataFrame:
    """``calls(id, method, params)`` with ``result`` (JSON) or ``note`` (why there is none); params are JSON lists.

    At most ``at_once`` calls are in flight: so many partitions. Each has ``seconds``; calls that it does not come to are noted as late.
    """
    kind = calls.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        began = time.monotonic()
        for batch in batches:
            results, notes = [], []
            for method, params in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                result = note = None
                if time.monotonic() - began > seconds:
                    note = LATE
                else:
                    try:
                        result = json.dumps(call(url, method, json.loads(params), pause=pause))
                    except RpcError as e:
                        note = str(e)
                results.append(result)
                notes.append(note)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(results, pa.string()), pa.array(notes, pa.string())], ["id", "result", "note"])

    return calls.select("id", "method", "params").repartition(at_once).mapInArrow(run, f"id {kind}, result string, note string")


def code_calls(addresses: DataFrame, block: str = "latest") -> DataFrame:
    """Calls for the code of ``addr``."""
    return addresses.select(F.col("addr").alias("id"), F.lit("eth_getCode").alias("method"), F.to_json(F.array("addr", F.lit(block))).alias("params"))


def storage_calls(slots: DataFrame, block: str = "latest") -> DataFrame:
    """Calls for the words of ``addr, slot``; the id is both."""
    return slots.select(F.concat_ws(":", "addr", "slot").alias("id"), F.lit("eth_getStorageAt").alias("method"), F.to_json(F.array("addr", "slot", F.lit(block))).alias("params"))


def trace_calls(txs: DataFrame) -> DataFrame:
    """Calls for the nested traces of ``tx``."""
    params = F.concat(F.lit('["'), "tx", F.lit('",{"tracer":"callTracer"}]'))
    return txs.select(F.col("tx").alias("id"), F.lit("debug_traceTransaction").alias("method"), params.alias("params"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonRpcTraces)
