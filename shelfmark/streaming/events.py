"""The event collector: disposition of each event, redaction, rate limit and repeats, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.functions.text import normal_query

NAMES = ("search", "outbound_click")
#: Longest domain and address that are kept.
DOMAIN, ADDRESS = 253, 2048
#: What Javascript reads as a decimal number.
DECIMAL, HEX = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", r"^0[xX][0-9A-Fa-f]{1,15}$"


def _parsed(body: Column) -> Column:
    """The body as a VARIANT if it is a JSON object, else null; an object that names a key twice is none."""
    v = F.try_parse_json(body)
    return F.when(_kind(v).startswith("OBJECT"), v)


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a type of numbers; null for what is not there."""
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def _text(v: Column, path: str) -> Column:
    """The string at a path, null if there is something else."""
    return F.when(_kind(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _name(v: Column) -> Column:
    return F.coalesce(_text(v, "$.name"), F.lit(""))


def number_of(v: Column) -> Column:
    """A JSON value as Javascript's ``Number`` has it, with -1 for what is no finite number: null, empty and blank texts and empty lists are 0, what is not there is -1. Longer lists and objects are -1."""
    kind, text = _kind(v), F.regexp_replace(v.try_cast("string"), r"^\s+|\s+$", "")
    of_text = F.when(text == "", 0.0).when(text.rlike(DECIMAL), text.try_cast("double")).when(text.rlike(HEX), F.conv(F.substring(text, 3, 15), 16, 10).try_cast("double"))
    n = F.when(kind == "VOID", 0.0).when(kind == "BOOLEAN", v.try_cast("boolean").cast("double")).when(kind == "STRING", of_text).when(kind == "ARRAY", F.when(F.to_json(v) == "[]", 0.0)).when(kind != "OBJECT", v.try_cast("double"))
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")), n).otherwise(-1.0)


def disposed(posts: DataFrame, allowed: str, refused: str | None = None) -> DataFrame:
    """``disposition``, the code of the first gate that answers a post (``method, origin, body``): 204 for OPTIONS, 405 for another method than POST, 429 where the column ``refused`` says that the
    limiter did, 403 for a foreign origin, 400 for a body that is no JSON object, and 204 for the rest, whether something is kept of it (``points``) or not. No origin is none that is foreign."""
    v = _parsed(F.col("body"))
    code = F.when(F.col("method") == "OPTIONS", 204).when(F.coalesce(F.col("method") != "POST", F.lit(True)), 405)
    if refused:
        code = code.when(F.col(refused), 429)
    code = code.when(F.coalesce((F.col("origin") != "") & (F.col("origin") != allowed), F.lit(False)), 403)
    return posts.withColumn("disposition", code.when(v.isNull(), 400).otherwise(204))


def limited_posts(posts: DataFrame, key: str, cap: int, window: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``refused`` for posts beyond the cap; only posts are charged, whatever else is wrong with them."""
    posted = rate_limited(posts.where("method = 'POST'"), key, cap, window, ts, tie)
    return posted.unionByName(posts.where("method IS NULL OR method <> 'POST'").withColumn("refused", F.lit(False)))


def dead_letters(posts: DataFrame, body: str = "body") -> DataFrame:
    """Posts whose body is no JSON object."""
    return posts.where(_parsed(F.col(body)).isNull())


def points(posts: DataFrame) -> DataFrame:
    """What is kept of posts that passed the gates: ``index``, ``blobs`` and ``number``. A search keeps its term, redacted again, with its count, and is dropped if no term is left; a click keeps its kind (``doi``, ``repo``, else ``external``),
    domain and address, cut to size, and 1. Other names are dropped. Works on streams as well."""
    # A generator, so that the body is read once and not once for each use of its parts.
    at = lambda v, name: _text(v, f"$.props.{name}")
    parts = lambda v: F.struct(
        _name(v).alias("index"), at(v, "search_term").alias("_term"), F.try_variant_get(v, "$.props.result_count", "variant").alias("_count"),
        at(v, "resource_kind").alias("_kind"), at(v, "link_domain").alias("_domain"), at(v, "link_url").alias("_url"),
    )
    v = posts.select("*", F.inline(F.transform(F.array(F.try_parse_json("body")), parts))).where(F.col("index").isin(*NAMES))
    search = F.col("index") == "search"
    kind = F.when(F.col("_kind").isin("doi", "repo"), F.col("_kind")).otherwise("external")
    click = [kind, F.left(F.coalesce("_domain", F.lit("")), F.lit(DOMAIN)), F.left(F.coalesce("_url", F.lit("")), F.lit(ADDRESS))]
    v = v.withColumn("_term", normal_query(F.col("_term"))).where(~search | F.col("_term").isNotNull())
    v = v.withColumn("blobs", F.when(search, F.array("index", "_term")).otherwise(F.array("index", *click)))
    return v.withColumn("number", F.when(search, number_of(F.col("_count"))).otherwise(1.0)).drop("_term", "_count", "_kind", "_domain", "_url")


def append_points(stream: DataFrame, path: str, checkpoint: str, allowed: str):
    """The points of posts that pass the gates, appended once each to a folder; a query that takes what there is and ends. The limiter is a stream of its own (``rate_limit_stream``)."""
    p = points(disposed(stream, allowed).where("disposition = 204 AND method = 'POST'"))
    return p.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limited(events: DataFrame, key: str, cap: int, window: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``refused`` for the events of a key beyond ``cap`` in a tumbling window, in the order of time; a window's events of one key share a task."""
    slot = F.window(F.col(ts), window)["start"]
    w = Window.partitionBy(key, slot).orderBy(ts, tie)
    return events.withColumn("refused", F.row_number().over(w) > cap)


def settled_terms(events: DataFrame, key: str, seconds: float = 1.2, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events after which their key stays quiet for ``seconds``: what a debounced sender sends."""
    after = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    gap = (F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) >= int(seconds * 1_000_000)
    return events.withColumn("_quiet", F.coalesce(gap, F.lit(True))).where("_quiet").drop("_quiet")


def without_repeats(events: DataFrame, key: str, value: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events whose value differs from the key's previous one."""
    last = F.lag(value).over(Window.partitionBy(key).orderBy(ts, tie))
    return events.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("_last") != F.col(value))).drop("_last")


class _Limiter(StatefulProcessor):
    """Counts a key's events by window of event time. A late event is charged to its own window, as long as that is one of the last ``KEPT``; older ones are refused."""

    KEPT = 4

    def __init__(self, cap: int, seconds: int):
        self.cap, self.seconds = cap, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("windows", "starts array<long>, counts array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        counts = dict(zip(*self.state.get(), strict=True)) if self.state.exists() else {}
        for part in rows:  # one Arrow batch at a time
            out = []
            for e in part.sort_values(["ts", "event_id"]).itertuples():
                slot = int(e.ts.timestamp()) // self.seconds * self.seconds
                if slot not in counts and len(counts) == self.KEPT:
                    oldest = min(counts)
                    if slot < oldest:
                        out.append((e.event_id, key[0], True))
                        continue
                    del counts[oldest]
                counts[slot] = counts.get(slot, 0) + 1
                out.append((e.event_id, key[0], counts[slot] > self.cap))
            yield pd.DataFrame(out, columns=["event_id", "user_id", "refused"])
        self.state.update((list(counts), list(counts.values())))

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, cap: int, seconds: int) -> DataFrame:
    """The limiter on a stream with ``event_id, user_id, ts``; state is one counter for each key."""
    s = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return s.groupBy("user_id").transformWithStateInPandas(_Limiter(cap, seconds), "event_id long, user_id long, refused boolean", "Append", "None")
