"""URL rules by a sort-merge range join: a sweep over sorted keys with a stack of nested rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import checkpointed

DEFAULT_VERDICT = "allow"
ROWS_PER_TASK = 500_000


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels of a host from the last on, each ended by a space, which sorts before any label's
    character: a host's key is a prefix of its subdomains' keys, and they follow it directly."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), " "), F.lit(" "))


def _sweep(default: str):
    """Walk over sorted (key, rules, rows): rules open intervals, rows ask the open ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, stack = None, []  # open rules: (key, {path: (rule, verdict)}, path lengths, longest first)
        for batch in batches:
            rule, verdict, keep = [], [], []
            tasks, keys, paths, names, verdicts, kinds = (batch.column(c).to_pylist() for c in ("_task", "_key", "path", "_rule", "_verdict", "_kind"))
            for i, key in enumerate(keys):
                if tasks[i] != task:
                    task, stack = tasks[i], []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kinds[i] == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    _, by_path, lengths = stack[-1]
                    by_path.setdefault(paths[i], (names[i], verdicts[i]))
                    if len(paths[i]) not in lengths:
                        lengths.append(len(paths[i]))
                        lengths.sort(reverse=True)
                    continue
                best, own = (-1, None, default), paths[i]
                for _, by_path, lengths in reversed(stack):
                    for n in lengths:
                        hit = by_path.get(own[:n]) if n <= len(own) else None
                        if hit is not None:
                            if len(hit[0]) > best[0]:
                                best = (len(hit[0]), *hit)
                            break
                keep.append(i)
                rule.append(best[1])
                verdict.append(best[2])
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id"), rows.column("host"), rows.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["_id", "host", "path", "rule", "verdict"],
            )

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Longest rule that fits each url, and its verdict; ``default`` where none fits.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the url's path
    starts with the rule's; the longest (host and path together) wins, then the longer host, then the
    first by verdict. Returns id, host, path, rule (host and path; null if none) and verdict, a row
    for each row of ``pages``. A null url, or one without `://`, has empty host and path. A null part
    of a rule counts as empty; a rule without host fits only urls without host. Columns other than
    the id and ``url`` are not read.

    Reversed-host keys turn a host with its subdomains into one interval of the sorted urls. Urls are
    dealt out by ranges of (key, path, id), so a hot host or url is split; a rule goes to every range
    that its interval meets. A task keeps the open rules only, those of one host and its parents.
    """
    spark = pages.sparkSession
    url = F.col("url")
    asked = pages.select(F.col(id_column).alias("_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    asked = asked.withColumn("_key", host_key(F.col("host")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = asked.repartitionByRange(tasks, "_key", "path", "_id").withColumn("_task", F.spark_partition_id())
    # Written, so that the task numbers stay what they are when a task runs again.
    dealt = checkpointed(dealt)
    ranges = dealt.groupBy("_task").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"))
    clean = rules.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path", "verdict"))).groupBy("host", "path").agg(F.min("verdict").alias("_verdict"))
    clean = clean.withColumn("_key", host_key(F.col("host")))
    # At most one row for each task on one side. A rule meets a range unless it lies wholly before or after.
    meets = (F.col("_key") <= F.col("_high")) & ((F.col("_low") <= F.col("_key")) | F.col("_low").startswith(F.col("_key")))
    opened = clean.join(ranges, meets).select(
        "_task", "_key", F.lit(0).alias("_kind"), F.col("path"), F.lit(None).cast(dealt.schema["_id"].dataType).alias("_id"), "host", F.concat("host", "path").alias("_rule"), "_verdict"
    )
    nothing = F.lit(None).cast("string")
    both = dealt.select("_task", "_key", F.lit(1).alias("_kind"), "path", "_id", "host", nothing.alias("_rule"), nothing.alias("_verdict")).unionByName(opened)
    swept = (
        both.repartition(tasks, "_task")
        .sortWithinPartitions("_task", "_key", "_kind", "path")
        .mapInArrow(_sweep(default), f"_id {dict(pages.dtypes)[id_column]}, host string, path string, rule string, verdict string")
    )
    return swept.withColumnRenamed("_id", id_column)
