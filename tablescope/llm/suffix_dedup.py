"""Passages that occur more than once anywhere in the corpus, found with suffix arrays of shards.

A window is ``width`` bytes of one text.  Its anchor, the k-byte string in it with the least hash, is the same wherever the window occurs, so
windows dealt to shards by their anchors meet all their equals there.  What is dealt out are runs of windows with one anchor: equal runs are
counted before they are shuffled, anchors that occur once are left out, and of the rest each different run is sent once.  A shard sorts all
suffixes of its runs, takes the common prefixes of neighbours, and knows which windows are equal.  An anchor with more than CROWD different
runs is dealt to several shards; each hands on its different windows as a sorted run of digests, and runs are merged by binary search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import remove, settled
from .suffixes import PAD, RangeHashes, anchored_runs, common_prefixes, suffix_array

NO_ID = -(1 << 63)
WIDTH = 200
ANCHOR = 50
CROWD = 512
BUFFER = 1 << 20
_PIECE = 1 << 22
_MERGED = 1 << 19


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, doc, h, body): doc and h are a key that rows share only if they agree in id and text; body has the bytes of the text."""
    body, name = F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(key).cast("long")
    return docs.select(name.alias("key"), F.coalesce(name, F.lit(NO_ID)).alias("doc"), F.xxhash64(body).alias("h"), body.cast("binary").alias("body"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(doc, h, start, n, g, f): every run of n windows from byte ``start`` on that share an anchor of hash g; f is a hash of its bytes."""
    def found(parts: list[tuple], columns: list[pa.Array]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join([p[2] for p in parts]), np.uint8)
        sizes = np.array([len(p[2]) for p in parts])
        text, start, n, g, f = anchored_runs(data, np.cumsum(sizes) - sizes, np.cumsum(sizes), width, k)
        row, offset = (np.array([p[i] for p in parts], np.int64) for i in (0, 1))
        at = pa.array(row[text])
        return pa.RecordBatch.from_arrays(
            [columns[0].take(at), columns[1].take(at), pa.array(start + offset[text]), pa.array(n), _signed(g), _signed(f)],
            names=["doc", "h", "start", "n", "g", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for row, body in enumerate(batch.column(2)):
                body = body.as_py()
                for at in range(0, max(1, len(body) - width + 1), _PIECE):
                    parts.append((row, at, body[at:at + _PIECE + width - 1]))
                    size += len(parts[-1][2])
                    if size >= BUFFER:
                        yield found(parts, batch.columns)
                        parts, size = [], 0
            if parts:
                yield found(parts, batch.columns)

    return docs.select("doc", "h", "body").mapInArrow(run, "doc long, h long, start long, n long, g long, f long")


def _together(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], size: Callable[[pa.Table], int], most: int) -> Iterator[pa.Table]:
    """The sorted rows in tables of about ``most`` in size; rows that agree in the keys come together."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            held.append(batch.slice(at, 1024))
            total += size(held[-1])
            if total < most:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            change = np.zeros(table.num_rows - 1, bool)
            for key in keys:
                values = table.column(key).to_numpy()
                change |= values[1:] != values[:-1]
            cuts = np.flatnonzero(change)
            if len(cuts):
                yield table.slice(0, cuts[-1] + 1)
                table = table.slice(cuts[-1] + 1)
                held, total = table.to_batches(), size(table)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_FOUND = "g long, f long, first long, after long, run long, d1 long, d2 long, total long"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _found(*columns) -> pa.RecordBatch:
    """Repeated windows ``first`` to ``after`` of a run, or, with digests, a window that other shards may hold as well."""
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_FOUND_NAMES)


def _shard(table: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
    g, f, n, salt, crowded = (table.column(c).to_numpy() for c in ("g", "f", "n", "salt", "crowded"))
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (f[1:] != f[:-1])])
    bodies = table.column("body").filter(pa.array(new)).to_pylist()
    g, f, n, salt, crowded = (c[new] for c in (g, f, n, salt, crowded))
    data = np.frombuffer(bytes([PAD]).join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    begin = np.cumsum(sizes + 1) - sizes - 1
    order, rank = suffix_array(data)
    kind = np.cumsum(common_prefixes(data, order, rank, width) < width)
    owner = np.repeat(np.arange(len(bodies)), sizes + 1)[:len(data)]
    whole = np.arange(len(data)) - begin[owner] <= sizes[owner] - width
    window = whole[order]
    place, kind = order[window], kind[window]
    total = np.bincount(kind, n[owner[place]]).astype(np.int64)
    again = np.sort(place[total[kind] >= 2])
    if len(again):
        first = np.flatnonzero(np.concatenate([[True], np.diff(again) > 1]))
        last = np.append(first[1:], len(again)) - 1
        run, none = owner[again[first]], np.full(len(first), None)
        yield _found(g[run], f[run], again[first] - begin[run], again[last] + 1 - begin[run], none, none, none, none)
    open_ = np.flatnonzero(crowded[owner[place]])
    if len(open_):
        kinds, at = np.unique(kind[open_], return_index=True)
        at = place[open_[at]]
        run, digest = owner[at], RangeHashes(data)
        d1, d2 = (digest(at, at + width, seed).view(np.int64) for seed in (5, 7))
        yield _found(g[run], f[run], at - begin[run], at + 1 - begin[run], salt[run], d1, d2, total[kinds])


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of (keys, totals) from several: a binary search places each key of one run in the other; equal keys add up."""
    while len(runs) > 1:
        merged = []
        for (keys, totals), (more, extra) in zip(runs[::2], runs[1::2]):
            at = np.searchsorted(keys, more)
            known = keys[np.minimum(at, len(keys) - 1)] == more
            totals = totals.copy()
            totals[at[known]] += extra[known]
            merged.append((np.insert(keys, at[~known], more[~known]), np.insert(totals, at[~known], extra[~known])))
        runs = merged + runs[len(runs) // 2 * 2:]
    return runs[0]


def _merged(table: pa.Table) -> pa.RecordBatch:
    columns = {c: table.column(c).to_numpy() for c in table.column_names}
    digest = np.stack([columns["d1"], columns["d2"]], 1).astype(">i8").view("S16").ravel()
    order = np.lexsort([digest, columns["run"]])
    cuts = np.flatnonzero(np.diff(columns["run"][order])) + 1
    keys, totals = merge_runs([(digest[part], columns["total"][part]) for part in np.split(order, cuts)])
    again = (totals[np.searchsorted(keys, digest)] >= 2) & (columns["total"] == 1)
    none = np.full(again.sum(), None)
    return _found(*[columns[c][again] for c in ("g", "f", "first", "after")], none, none, none, none)


def repeated_runs(runs: DataFrame, docs: DataFrame, width: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The occurrences of runs whose anchor is not alone, and (g, f, first, after): which windows of a run are repeated."""
    often = settled(runs.groupBy("g").agg(F.count(F.lit(1)).alias("times")).where("times >= 2").select("g"), "run-anchors")
    places = settled(runs.join(often.hint("shuffle_hash"), "g", "left_semi"), "run-places")
    remove(runs, often)
    kinds = settled(places.groupBy("g", "f").agg(F.count(F.lit(1)).alias("times"), F.min(F.xxhash64("doc", "h")).alias("teller")), "run-kinds")
    known = kinds.join(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")), "g")
    tellers = places.withColumn("teller", F.xxhash64("doc", "h")).join(known, ["g", "f", "teller"])
    told = tellers.groupBy("doc", "h").agg(F.collect_set(F.struct("start", "n", "g", "f", "times", "kinds")).alias("runs"))
    pieces = F.transform("runs", lambda r: F.struct(
        r["g"].alias("g"), r["f"].alias("f"), r["times"].alias("n"), r["kinds"].alias("kinds"),
        F.substring(F.col("body"), (r["start"] + 1).cast("int"), (r["n"] + width - 1).cast("int")).alias("body")))
    cut = docs.select("doc", "h", "body").join(told.hint("shuffle_hash"), ["doc", "h"]).select(F.explode(pieces).alias("r")).select("r.*")
    crowded = F.col("kinds") > crowd
    salt = F.when(crowded, F.pmod("f", F.ceil(F.col("kinds") / crowd))).otherwise(0).cast("long")
    dealt = cut.select("g", "f", "n", "body", salt.alias("salt"), crowded.alias("crowded"))

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, ("g", "salt"), lambda t: sum(c.nbytes for c in [t.column("body")]), BUFFER):
            yield from _shard(table, width)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, ("d1",), lambda t: t.num_rows, _MERGED):
            yield _merged(table)

    found = dealt.repartition("g", "salt").sortWithinPartitions("g", "salt", "f").mapInArrow(sharded, _FOUND)
    found = settled(found, "run-windows")
    handed = found.where("run is not null").repartition("d1", "d2").sortWithinPartitions("d1", "d2").mapInArrow(merged, _FOUND)
    spans = found.where("run is null").unionByName(handed).select("g", "f", "first", "after")
    remove(kinds)
    return places, spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for body, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            raw = body.as_buffer() if spans else b""
            begins, ends, kept, at = [], [], [], 0
            for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                if begins and start <= ends[-1]:
                    ends[-1] = max(ends[-1], end)
                else:
                    begins.append(start)
                    ends.append(end)
            for start, end in zip(begins, ends):
                kept.append(raw[at:start].to_pybytes())
                at = end
            rest = b"".join([*kept, raw[at:].to_pybytes()]) if spans else body.as_py()
            out.append((body.as_buffer().size, sum(ends) - sum(begins), len(begins), [{"start": a, "end": b} for a, b in zip(begins, ends)], rest))
        columns = list(zip(*out)) or [()] * 5
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), spans, pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                         names=["key", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def remove_repeats(
    docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, crowd: int = CROWD, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, spans, kept) of every row of ``docs``: its text as UTF-8 without passages that occur elsewhere.

    Every byte goes that is covered by a ``width``-byte string which also starts at another place of the corpus, the same text
    included; strings never reach into the next text, may overlap, and are judged on the texts as given.  ``spans`` are the removed
    stretches, which neither overlap nor touch; ``kept`` holds the remaining bytes, which need not be valid UTF-8.  Null is an empty
    text; texts shorter than ``width`` stay.  Repeated rows are different places, so both lose what they share; keys may be null or repeat.  An
    empty table gives no rows; other columns are ignored whatever their names.  ``anchor`` (below ``width``) and ``crowd`` have no effect on the result."""
    keyed = _keyed(docs, text, key)
    runs = settled(_runs(keyed, width, anchor), "runs")
    places, spans = repeated_runs(runs, keyed, width, crowd)
    covered = places.join(spans, ["g", "f"]).select(
        "doc", "h", F.struct((F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("after") + width - 1).alias("end")).alias("span"))
    by_doc = covered.groupBy("doc", "h").agg(F.collect_set("span").alias("spans"))
    joined = keyed.join(by_doc.hint("shuffle_hash"), ["doc", "h"], "left").select("key", "body", "spans")
    out = "key long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary"
    return joined.mapInArrow(_cut, out).withColumnRenamed("key", key)
