"""Pages as WARC files, and a fixity audit of two replicas by Merkle trees.

A replica is a folder of gzipped WARC files, written by Spark in one task per file; files hold ranges of the page order.  An audit hashes
every record, then the ordered records of each 64 KiB offset range, then sixteen ranges at a time up to one root for each file.  Only
roots are compared for all files; below a root that differs the children are compared, and so on down to the records.  Records of ranges
that differ are paired by id and digest, as a record that is lost, added or of another length moves all behind it."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import parallelism
from .scratch import stored

END = "\r\n\r\n"
RANGE_BITS = 16
FAN_BITS = 4
LEVELS = 6
CHUNK = 1 << 16
GZIP = b"\x1f\x8b\x08"
_START = re.compile(rb"WARC/1\.\d\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.I)
_ID = re.compile(rb"\r\nWARC-Record-ID: *<([^>\r\n]*)>", re.I)
_RECORDS = pa.schema([("volume", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("digest", pa.string())])


def warc_record(record_id: Column, url: Column, body: Column) -> Column:
    """A resource record without the blank lines that end it; line breaks in a URL become blanks, a null URL has no header."""
    target = F.when(url.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, "[\r\n]", " "), F.lit("\r\n"))).otherwise("")
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <"), record_id, F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"), target,
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    )


def write_replicas(pages: DataFrame, path: str, replicas: dict[str, Column], key: str = "page_id", url: str = "url", body: str = "html") -> None:
    """Write one set of WARC files below ``path/replica=<name>`` for each replica, files of equal name holding the same pages.

    ``replicas`` gives the body each replica stores, as an expression over ``key`` and ``body``.  Null bodies are empty.  Every replica has
    its folder, so that an empty table gives replicas without a volume."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(body), F.lit("")).alias("body"))
    order = [F.col("key").asc_nulls_last(), F.col("url").asc_nulls_last(), F.xxhash64("body"), F.monotonically_increasing_id()]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("replica"), b.alias("stored")) for n, b in replicas.items()])).alias("copy")
    ranged = rows.repartitionByRange(parallelism(pages.sparkSession), *order).select("key", "url", F.xxhash64("body").alias("h"), each)
    sorted_rows = ranged.sortWithinPartitions("copy.replica", F.col("key").asc_nulls_last(), F.col("url").asc_nulls_last(), "h")
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("key").cast("string"), F.lit("none")))
    records = sorted_rows.select(F.col("copy.replica").alias("replica"), warc_record(name, F.col("url"), F.col("copy.stored")).alias("value"))
    records.write.partitionBy("replica").option("lineSep", END).option("compression", "gzip").text(path)
    spark = pages.sparkSession
    for replica in replicas:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/replica={replica}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def split_records(data: bytes) -> Iterator[tuple[int, int, str | None]]:
    """Start, length and id of each record.  Where a header is damaged, all up to the next record's start is one record without id."""
    at = 0
    while at < len(data):
        head_end = data.find(b"\r\n\r\n", at)
        head = data[at:head_end + 2] if head_end >= 0 else b""
        length = _LENGTH.search(head) if _START.match(head) else None
        end = head_end + 8 + int(length[1]) if length else -1
        if not length or end > len(data) or data[end - 4:end] != b"\r\n\r\n":
            following = _START.search(data, at + 1)
            yield at, (following.start() if following else len(data)) - at, None
            at = following.start() if following else len(data)
            continue
        name = _ID.search(head)
        yield at, end - at, name[1].decode("utf-8", "replace") if name else None
        at = end


def inflated(data: bytes) -> bytearray:
    """The content of all gzip members of a file.  Of a damaged member all that can be read is kept, and reading goes on at the next."""
    out, view, at = bytearray(), memoryview(data), 0
    while 0 <= at < len(data):
        member, begin = zlib.decompressobj(31), at
        try:
            while not member.eof and at < len(data):
                before = member.copy()
                out += member.decompress(view[at:at + CHUNK])
                at = min(at + CHUNK, len(data)) - len(member.unused_data)
        except zlib.error:
            try:
                for i in range(at, min(at + CHUNK, len(data))):
                    out += before.decompress(view[i:i + 1])
            except zlib.error:
                pass
            at = data.find(GZIP, begin + 1)
    return out


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = content.as_py()
            data = inflated(data) if data[:2] == b"\x1f\x8b" else data
            rows = [(path.rsplit("/", 1)[-1], s, n, name, hashlib.sha256(data[s:s + n]).hexdigest()) for s, n, name in split_records(data)]
            for begin in range(0, len(rows), 10_000):
                columns = zip(*rows[begin:begin + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _RECORDS)], schema=_RECORDS)


def record_table(spark: SparkSession, folder: str) -> DataFrame:
    """(volume, start, length, record_id, digest) of every record of the WARC files in a folder; a task holds one file at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    return files.mapInArrow(_hash_files, "volume string, start long, length long, record_id string, digest string")


def merkle_tree(records: DataFrame) -> DataFrame:
    """(level, volume, node, digest): level 0 are offset ranges, each level above joins sixteen nodes, the last has one node per volume.

    A node's digest covers the places, lengths and digests of its records, or the numbers and digests of its children, in order."""
    def joined(rows: DataFrame, *parts: str) -> DataFrame:
        item = F.struct(*[F.col(c) for c in parts])
        text = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.concat_ws(":", *[x[c] for c in parts])), ",")
        return rows.groupBy("volume", "node").agg(F.sha2(text, 256).alias("digest"))

    level = joined(records.withColumn("node", F.shiftright("start", RANGE_BITS)), "start", "length", "digest")
    tree = level.select(F.lit(0).alias("level"), "volume", "node", "digest")
    for number in range(1, LEVELS):
        up = FAN_BITS if number < LEVELS - 1 else 62
        level = joined(level.select("volume", F.shiftright("node", up).alias("node"), F.col("node").alias("child"), "digest"), "child", "digest")
        tree = tree.union(level.select(F.lit(number).alias("level"), "volume", "node", "digest"))
    return stored(tree, "merkle")


def _differing(one: DataFrame, two: DataFrame, *keys: str) -> DataFrame:
    both = one.select(*keys, F.col("digest").alias("d1")).join(two.select(*keys, F.col("digest").alias("d2")), list(keys), "full")
    return both.where(~F.col("d1").eqNullSafe(F.col("d2")))


def _aligned(one: DataFrame, two: DataFrame) -> DataFrame:
    """(volume, start, start_two, state) of the records of two tables, paired wherever they lie.

    Equal records of one id are ``intact``, in order; then records of one id are ``changed``; then, between the pairs found so far, a record
    whose id cannot be read is ``changed`` with the one in the same place of the other side.  What is left is ``missing`` or ``extra``."""
    sides = [t.select("volume", "record_id", "digest", *(F.col("start").alias(n) if n == m else F.lit(None).cast("long").alias(n) for n in ("s1", "s2")))
             for t, m in ((one, "s1"), (two, "s2"))]

    def paired(rows: DataFrame, *keys: str) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(*keys, F.col("s1").isNull()).orderBy(F.coalesce("s1", "s2")))
        rows = rows.withColumn("number", number).groupBy(*keys, "number")
        return rows.agg(*[F.max(c).alias(c) for c in ("s1", "s2", "record_id", "digest", "same") if c not in keys])

    both = F.col("s1").isNotNull() & F.col("s2").isNotNull()
    found = paired(sides[0].union(sides[1]).withColumn("same", F.lit(None).cast("boolean")), "volume", "record_id", "digest").withColumn("same", both)
    found = stored(found.select("volume", "record_id", "digest", "s1", "s2", "same"), "warc-equal")
    named = paired(found.where(~F.col("same") & F.col("record_id").isNotNull()), "volume", "record_id").select(*found.columns)
    found = stored(found.where(F.col("same") | F.col("record_id").isNull()).union(named), "warc-named")
    unread = found.where(~both & F.col("record_id").isNull()).select("volume").distinct()
    near = found.join(unread, "volume", "left_semi")
    loose = []
    for place in ("s1", "s2"):
        gap = F.count(F.when(both, 1)).over(Window.partitionBy("volume").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
        rows = near.where(F.col(place).isNotNull()).withColumn("gap", gap).where(~both)
        number = F.row_number().over(Window.partitionBy("volume", "gap").orderBy(place))
        loose.append(rows.select("volume", "gap", number.alias("number"), F.col(place), F.col("record_id").alias(place + "_id")))
    met = loose[0].join(loose[1], ["volume", "gap", "number"]).where("s1_id IS NULL OR s2_id IS NULL").select("volume", "s1", "s2")
    met = stored(met, "warc-met")
    alone = found.where(~both)
    for place in ("s1", "s2"):
        alone = alone.join(met.select("volume", F.col(place).alias("met")), [alone["volume"] == met["volume"], F.col(place) == F.col("met")], "left_anti")
    state = F.when(F.col("same"), "intact").when(F.col("s2").isNull(), "missing").when(F.col("s1").isNull(), "extra").otherwise("changed")
    every = found.where(both).union(alone).select("volume", "s1", "s2", state.alias("state")).union(met.withColumn("state", F.lit("changed")))
    return every.select("volume", F.col("s1").alias("start"), F.col("s2").alias("start_two"), "state")


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """(volume, start, start_two, state) of every record that differs between two record tables: ``changed``, ``missing`` or ``extra`` in the
    second.  ``start`` is its place in the first, null if extra; ``start_two`` its place in the second, null if missing.

    Trees are built for both; each level is compared only below nodes that differ.  Equal tables, two empty ones too, give no rows; a
    volume that only one side has differs as a whole.  A record that only lies elsewhere in its volume does not differ."""
    trees = [merkle_tree(t) for t in (one, two)]
    wrong = _differing(*[t.where(F.col("level") == LEVELS - 1) for t in trees], "volume", "node").select("volume", "node")
    for level in reversed(range(LEVELS - 1)):
        up = FAN_BITS if level < LEVELS - 2 else 62
        wrong = stored(wrong, "merkle-wrong").withColumnRenamed("node", "parent")
        below = [t.where(F.col("level") == level).withColumn("parent", F.shiftright("node", up)).join(wrong, ["volume", "parent"]) for t in trees]
        wrong = _differing(*below, "volume", "node").select("volume", "node")
    wrong = stored(wrong, "merkle-wrong")
    below = [t.withColumn("node", F.shiftright("start", RANGE_BITS)).join(wrong, ["volume", "node"], "left_semi") for t in (one, two)]
    return _aligned(*below).where("state <> 'intact'")
