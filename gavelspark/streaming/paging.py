"""Pages of a site's listing as they come in, and where to stop: at an address
that was seen before, at the second empty page running, or at a page of which more
than `share` of the titles are among the last `tail` titles met so far.

`stops` says it of a table by windows over a site's pages; `stops_stream` says it of
pages as they arrive, keeping for each site only its addresses, its last titles and
its count of empty pages, and gives the same rows for pages that arrive in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

REVISIT, EMPTY, LOOP, AFTER = "revisit", "two empty", "same titles", "after a stop"


def overlap(titles: Column, before: Column) -> Column:
    """How many distinct titles of a page are among those before."""
    return F.size(F.array_intersect(F.array_distinct(titles), before))


def stops(pages: DataFrame, tail: int = 20, share: float = 0.8) -> DataFrame:
    """pages (site, page, url, titles) with kept and reason; null titles are none. The
    work grows with the pages of a site, not with their square: an address was seen
    if it isn't its first row, and the last titles stand in the last `tail` pages that
    have any, so a row's frame holds no more of them."""
    w = Window.partitionBy("site").orderBy("page")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    titles = F.coalesce(F.col("titles"), F.array().cast("array<string>"))
    out = pages.withColumn("titles", titles).withColumn("_empty", F.size("titles") == 0)
    out = out.withColumns({"_at": F.row_number().over(w), "_full": F.count_if(~F.col("_empty")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_empty_before": F.coalesce(F.lag("_empty").over(w), F.lit(False))})
    ends = F.when(~F.col("_empty"), F.slice("titles", F.greatest(F.size("titles") - tail, F.lit(0)) + 1, tail))  # null: not collected
    out = out.withColumn("_last", F.flatten(F.collect_list(ends).over(Window.partitionBy("site").orderBy("_full").rangeBetween(-tail, -1))))
    out = out.withColumn("_seen", F.col("url").isNotNull() & (F.min("_at").over(Window.partitionBy("site", "url")) < F.col("_at")))
    last = F.slice("_last", F.greatest(F.size("_last") - tail, F.lit(0)) + 1, tail)
    alike = overlap(F.col("titles"), last) > F.size(F.array_distinct("titles")) * F.lit(share)
    out = out.withColumn("reason", F.when(F.col("_seen"), REVISIT).when(F.col("_empty") & F.col("_empty_before"), EMPTY).when(~F.col("_empty") & alike, LOOP))
    out = out.withColumn("_stopped", F.coalesce(F.max(F.col("reason").isNotNull()).over(before), F.lit(False)))
    out = out.withColumn("reason", F.when(F.col("_stopped"), AFTER).otherwise(F.col("reason")))
    return out.withColumn("kept", F.col("reason").isNull() & ~F.col("_empty")).drop("_empty", "_at", "_full", "_seen", "_empty_before", "_last", "_stopped")


class _Stops(StatefulProcessor):
    """State of a site: (addresses, last titles, whether the page before was empty, stopped)."""

    def __init__(self, tail: int, share: float):
        self.tail, self.share = tail, share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "url string", "page long")
        self.run = handle.getValueState("run", "last array<string>, empty boolean, stopped boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        last, empty, stopped = self.run.get() if self.run.exists() else ([], False, False)
        last, out = list(last), []
        for page, url, titles in pd.concat(list(rows)).sort_values("page")[["page", "url", "titles"]].itertuples(index=False):
            titles = [] if titles is None else list(titles)
            own, reason = set(titles), None
            if stopped:
                reason = AFTER
            elif url is not None and self.seen.containsKey((url,)):
                reason = REVISIT
            elif not titles and empty:
                reason = EMPTY
            elif titles and len(own & set(last)) > len(own) * self.share:
                reason = LOOP
            if url is not None:
                self.seen.updateValue((url,), (int(page),))
            stopped, empty = stopped or reason is not None, not titles
            last = (last + titles)[-self.tail :]
            out.append((key[0], int(page), url, titles, reason, reason is None and bool(titles)))
        self.run.update((last, empty, stopped))
        yield pd.DataFrame(out, columns=["site", "page", "url", "titles", "reason", "kept"])

    def close(self) -> None:
        pass


def stops_stream(pages: DataFrame, tail: int = 20, share: float = 0.8) -> DataFrame:
    """The same of a stream whose pages of a site arrive in the order of their
    numbers. Needs the RocksDB state store."""
    kind = pages.schema["site"].dataType
    schema = T.StructType([T.StructField("site", kind), T.StructField("page", T.LongType()), T.StructField("url", T.StringType()), T.StructField("titles", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType()), T.StructField("kept", T.BooleanType())])
    rows = pages.select("site", F.col("page").cast("long").alias("page"), "url", "titles")
    return rows.groupBy("site").transformWithStateInPandas(_Stops(tail, share), outputStructType=schema, outputMode="Append", timeMode="None")
