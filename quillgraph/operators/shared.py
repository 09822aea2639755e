"""Pairs of members that share keys, counted without a row for each pair and key.

Members get whole numbers in order of their links, so that each pair stands with the member of fewer
links and no member of very many gathers all its pairs. A task makes the pairs of a bounded share of
the keys, sorts them, and sends to each bucket of members one binary of their differences, two to
three bytes a pair. A bucket counts and keeps what is shared often enough. Tasks and buckets grow
with the number of pairs, so the memory of each does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import ordered
from quillgraph.plans.lineage import cut

#: Pairs that a task makes, sorts and sends at once.
SENT = 1 << 24
#: Pairs that a bucket counts.
COUNTED = 1 << 23


def _coders():
    """How a sorted array of whole numbers is packed and unpacked; nested, so that tasks need no package."""

    def pack(values):
        import zlib

        import numpy as np

        planes = np.diff(values, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T
        return zlib.compress(planes.tobytes(), 1)

    def unpack(packed):
        import zlib

        import numpy as np

        planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1)
        return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64))

    return pack, unpack


def _sender(size: int, buckets: int, at_once: int, some: bool):
    """Packed pairs of groups: (bucket, pairs), numbers being doubled with 1 added for a member that is asked for."""
    pack, _ = _coders()
    width = -(-size // buckets)

    def send(batches):
        import numpy as np
        import pyarrow as pa

        def pairs(lists):
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            values, ends = values[ends[0] : ends[-1]], ends - ends[0]
            place = np.arange(len(values))
            later = np.repeat(ends[1:], np.diff(ends)) - place - 1  # members after each one in its group
            first = np.repeat(place, later)
            second = np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later) + first + 1
            a, b = values[first], values[second]
            if some:
                asked = ((a | b) & 1).astype(bool)
                a, b = a[asked], b[asked]
            a, b = a >> 1, b >> 1
            return (a % buckets * width + a // buckets) * size + b

        def sent(parts):
            keys = np.sort(np.concatenate(parts))
            cuts = np.searchsorted(keys, np.arange(buckets + 1) * width * size)
            used = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "pairs": pa.array([pack(keys[cuts[i] : cuts[i + 1]]) for i in used], pa.binary())})

        held, n = [], 0
        for batch in batches:
            lists = batch.column(0)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            made = np.cumsum(sizes * (sizes - 1) // 2)
            start = 0
            while start < len(sizes):  # a batch may hold more pairs than are sent at once
                stop = max(start + 1, int(np.searchsorted(made, (made[start - 1] if start else 0) + at_once - n, side="right")))
                held.append(pairs(lists.slice(start, stop - start)))
                n += len(held[-1])
                if n and (n >= at_once or stop < len(sizes)):
                    yield sent(held)
                    held, n = [], 0
                start = stop
        if n:
            yield sent(held)

    return send


def _counter(size: int, buckets: int, least: int, at_once: int):
    """(a, b, n) of the pairs of a bucket that are there ``least`` times or more."""
    _, unpack = _coders()
    width = -(-size // buckets)

    def count(table):
        import numpy as np
        import pyarrow as pa

        def merged(keys, counts):
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(counts, first)

        found, counts, fresh, n = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        messages = table.column("pairs")
        for i, message in enumerate(messages, 1):
            fresh.append(unpack(message.as_buffer()))
            n += len(fresh[-1])
            if n >= at_once or i == len(messages):
                keys = np.concatenate([found, *fresh])
                found, counts = merged(keys, np.concatenate([counts, np.ones(n, np.int64)]))
                fresh, n = [], 0
        often = counts >= least
        found, counts = found[often], counts[often]
        a = found // size
        return pa.table({"a": pa.array(a % width * buckets + a // width, pa.int64()), "b": pa.array(found % size, pa.int64()), "n": pa.array(counts, pa.int64())})

    return count


def pairs(links: DataFrame, key: str, member: str, least: int = 1, of: DataFrame | None = None, every: DataFrame | None = None, sent: int = SENT, counted: int = COUNTED) -> DataFrame:
    """(a, b, n): each pair of members that shares n >= ``least`` keys, once; with ``of`` (member), pairs with one of it.

    ``links`` are distinct and keys capped before this, so no group of a key is a hub. ``every`` are links
    that include them, where those are cheaper to count members by.
    """
    spark = links.sparkSession
    degrees = (links if every is None else every).where(F.col(member).isNotNull()).groupBy(member).agg(F.count("*").alias("_d"))
    if of is None:
        asked = degrees.withColumn("_asked", F.lit(0))
    else:
        asked = degrees.join(of.select(member).distinct().withColumn("_asked", F.lit(1)), member, "left").withColumn("_asked", F.coalesce("_asked", F.lit(0)))
    codes = cut(ordered.numbered(asked, [F.col("_d"), F.col(member)], "_n").select(member, ((F.col("_n") - 1).cast("long") * 2 + F.col("_asked")).alias("_code")), "codes")
    coded = links.join(codes, member).groupBy(key).agg(F.sort_array(F.collect_list("_code")).alias("members"), F.max(F.col("_code") % 2).alias("_any"))
    groups = cut(coded.where((F.size("members") > 1) & ((F.col("_any") == 1) | F.lit(of is None))).select("members"), "groups")
    n = F.size("members").cast("long")
    total = groups.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("long").alias("n")).first().n
    size = max(1, codes.count())
    tasks, buckets = (max(1, -(-total // most), min(spark.sparkContext.defaultParallelism, total // 500_000)) for most in (sent, counted))
    buckets = min(buckets, size)
    messages = groups.repartition(tasks).mapInArrow(_sender(size, buckets, sent, of is not None), "bucket int, pairs binary")
    found = messages.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_counter(size, buckets, least, counted), "a long, b long, n long")
    names = codes.select(F.shiftright("_code", 1).alias("_id"), member)
    for x in ("a", "b"):
        found = found.join(names.withColumnsRenamed({"_id": x, member: f"_{x}"}), x)
    # few beside the pairs that were made, which more than one reader would make again
    return cut(found.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "n"), "pairs")
