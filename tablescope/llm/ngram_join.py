"""Documents linked by the Jaccard similarity of their word n-grams, by a token-group matrix.

1. Documents with the same set of n-grams are one class; everything after works on classes.
2. The tokens of a set.  The range of hashes is cut into slices, one more than two sets of nearly this size may differ by (and a few for
   slices without an n-gram), so two sets that reach the threshold have a slice in common, n-gram by n-gram.  A token is the hash of one
   filled slice.  It stands for several n-grams at once, so passages that many documents share make no token that they share, and no
   count over the corpus is needed.  Slices choose the sets that can have a partner, those with as many slices found in other components
   as a near set must share; all others are done.  That is counted set by set and not pair by pair: many sets of one origin that are not
   near enough share slices with each other, and the n-grams, rarest first, tell them apart.
   The tokens of the chosen sets are their first ``size - least overlap + 1`` n-grams in the order of a sketch of counts; two sets that
   reach the threshold share one of those.  The order must be the same for all documents but need not be exact, so a coarse sketch costs
   time and never a link.  Where slices would hold fewer than LEAST n-grams, and with too many empty ones, a set is always chosen.
3. Classes are partitioned into groups of similar sets: by smallest hash and size, each linked to the most typical class of its group
   if the exact similarity confirms it.  Linked groups are one component from here on.
4. The matrix holds for each token the groups whose members have it, each group once: the union of a group's tokens.  A query set meets
   groups of other components only; the tokens it finds there bound the overlap it can have with any member.
5. Groups whose bound reaches the threshold are opened, their members compared with the query set exactly, and the links joined up.

Hot groups cost little: equal sets are one class, near copies become one component before they meet, and a matrix row stands for a
group of up to GROUP members.  Nothing is capped; what a bound lets pass is compared exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import AtomicType

from .components import connected_components
from .scratch import remove, settled as stored, total_rows
from .texts import column_bytes, mix, shingle_set, text_words

CELLS = 1 << 21
SLICES = 32
MERGE = 64
GROUP = 64
FILTER_BITS = 1 << 23
TOKEN_BITS = (1 << 16, 1 << 29)
LEAST = 6
LONGEST = 1 << 40
FAMILIES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_SETS = pa.schema([("doc", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("slice", pa.int32()), ("task", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
_PREFIXES = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("first", pa.list_(pa.int64())), ("band", pa.int32()), ("always", pa.bool_()), ("own", pa.list_(pa.int64())), ("next", pa.list_(pa.int64())), ("families", pa.list_(pa.int64())), ("typical", pa.float64())])
_TOKENS = pa.schema([("cid", pa.int64()), ("late", pa.int32()), ("place", pa.int32()), ("token", pa.int64())])
_MEMBERS = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("grams", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _cell(grams: np.ndarray) -> np.ndarray:
    return (mix(grams) >> np.uint64(43)).astype(np.int64)  # 21 bits


def _fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    two = np.array([grams.sum(dtype=np.uint64), mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)])
    return tuple(int(x) for x in mix(two).view(np.int64))


def _set_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        yield batch.column(0).to_pylist(), [shingle_set(w, n) for w in text_words(column_bytes(batch.column(1)))]


def _columns(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _sets(n: int):
    """A row for each document with the hashes of its text, size and fingerprint of its set, and for each task the slices of its part of
    the sketch."""

    def run(batches):
        from pyspark import TaskContext

        counts = np.zeros(CELLS, np.uint8)
        for batch in batches:
            hashes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for docs, sets in _set_batches([batch], n):
                for grams in sets:
                    cell = _cell(grams)
                    counts[cell] += counts[cell] < 255
                yield _columns(_SETS, [(d, *t, len(g), *_fingerprint(g), None, None, None, None) for d, t, g in zip(docs, hashes, sets)])
        task, width = TaskContext.get().partitionId(), CELLS // SLICES
        for i in range(SLICES):
            part = counts[i * width:(i + 1) * width]
            used = np.flatnonzero(part)
            if len(used):
                yield _columns(_SETS, [(None, None, None, None, None, None, i, task, used.astype(np.uint16).tobytes(), part[used].tobytes())])

    return run


def _summed(pdf):
    total = np.zeros(CELLS // SLICES, np.int64)
    for cells, counts in zip(pdf["cells"], pdf["counts"]):
        width = np.uint8 if len(counts) * 2 == len(cells) else np.uint32
        total[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, width)
    used = np.flatnonzero(total)
    row = pdf.iloc[:1].copy()
    row["cells"], row["counts"] = [used.astype(np.uint16).tobytes()], [np.minimum(total[used], 2**32 - 1).astype(np.uint32).tobytes()]
    row["task"] = row["task"] // MERGE
    return row


def _sketch(slices: DataFrame) -> np.ndarray:
    """The counts of all tasks, MERGE at a time; the result has CELLS numbers whatever the input."""
    tasks = slices.agg(F.max("task")).first()[0]
    sketch = np.zeros(CELLS, np.uint16)
    if tasks is None:
        return sketch
    while True:
        slices = slices.groupBy("slice", F.floor(F.col("task") / MERGE).alias("pile")).applyInPandas(
            lambda key, pdf: _summed(pdf), "slice int, task int, cells binary, counts binary")
        tasks //= MERGE
        if tasks == 0:
            break
    width = CELLS // SLICES
    for row in slices.collect():
        at = row["slice"] * width + np.frombuffer(row["cells"], np.uint16).astype(np.int64)
        sketch[at] = np.minimum(np.frombuffer(row["counts"], np.uint32), 65535)
    return sketch


def _text_hashes(text: Column) -> list[Column]:
    """128 bits of a text, byte for byte."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _least_overlap(n, threshold):
    """The n-grams of a set of n that any set similar enough must share."""
    top, bottom = threshold
    return -(-n * top // bottom)


class _Slices:
    """The slices of sets by size.

    Band i holds the sizes from ``start[i]`` to below ``start[i + 1]``; a size and any other near enough lie in the same band or in
    neighbours.  Sets of the bands j - 1 and j meet in cut j, of ``count[j]`` slices, and differ in at most ``differ[j]`` of them if they
    reach the threshold; a cut with no slices is not used."""

    def __init__(self, threshold: tuple[int, int]):
        top, bottom = threshold
        start = [1]
        while start[-1] < LONGEST:
            start.append(start[-1] * bottom // top + 1)
        self.start, self.differ, self.count = np.array(start), [], []
        for j in range(len(start) - 1):
            differ, smallest = 2 * (start[j + 1] - 1) * (bottom - top) // (bottom + top), start[max(0, j - 1)]
            empty = (differ + 1) * np.exp(-smallest / (differ + 1))
            count = differ + 1 + int(empty + 4 * np.sqrt(empty))
            self.differ.append(differ)
            self.count.append(count if smallest >= LEAST * count else 0)
        self.used = any(self.count)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.start, size, "right")) - 1

    def tokens(self, grams: np.ndarray, mixed: np.ndarray, cut: int) -> tuple[np.ndarray, bool]:
        """The hash of each filled slice, and whether these are enough to meet every set near enough whatever that set's are.

        ``grams`` is sorted, so a slice is a run of it."""
        count = self.count[cut] if cut < len(self.count) else 0
        if not count:
            return np.zeros(0, np.int64), False
        piece = (grams >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        name = mix(piece[begin] + np.uint64((cut + 1) << 32))
        return mix(mix(np.add.reduceat(mixed, begin)) ^ name).view(np.int64), len(begin) > self.differ[cut]


def _prefixes(n: int, threshold: tuple[int, int], sketch):
    """A row for each document with its tokens, its smallest hashes and how typical its n-grams are."""

    def run(batches):
        count, slices = sketch.value, _Slices(threshold)
        for docs, sets in _set_batches(batches, n):
            rows = []
            for doc, grams in zip(docs, sets):
                if len(grams):
                    often = count[_cell(grams)]
                    mixed, band = mix(grams ^ np.uint64(0x5851F42D4C957F2D)), slices.band(len(grams))
                    (own, enough), (after, also) = slices.tokens(grams, mixed, band), slices.tokens(grams, mixed, band + 1)
                    first = grams[np.argsort(often, kind="stable")[:len(grams) - _least_overlap(len(grams), threshold) + 1]]
                    families = [int(mix(grams ^ np.uint64(k)).min().view(np.int64)) for k in FAMILIES]
                    rows.append((doc, len(grams), *_fingerprint(grams), first.view(np.int64), band, not (enough and also), own, after, families, float(np.log1p(often).sum())))
            yield _columns(_PREFIXES, rows)

    return run


def _wanted_bits(docs: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits of the hashed ids; it only saves work, ids that fall on a set bit by chance are dropped by a join."""
    place = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS)) + 1  # buckets count from 1
    parts = docs.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p"))
    parts = parts.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    bits = np.zeros(FILTER_BITS >> 3, np.uint8)
    for row in parts.collect():
        at = (row["b"] - 1) * len(row["bits"])
        bits[at:at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _token_bits(met: DataFrame) -> np.ndarray:
    """A bitmap of the tokens by their last bits, at least 16 bits a token within TOKEN_BITS; it only saves work as well."""
    least, most = TOKEN_BITS
    size = min(most, max(least, 1 << (16 * total_rows(met)).bit_length()))
    place = F.col("token").bitwiseAND(F.lit(size - 1)) + 1
    parts = met.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p"))
    bits = np.zeros(size >> 3, np.uint8)
    for row in parts.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).toLocalIterator():
        at = (row["b"] - 1) * len(row["bits"])
        bits[at:at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _tokens(wanted):
    """The tokens of each set whose bit is set, from one or more columns of lists behind its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            cid = batch.column(0).to_numpy(zero_copy_only=False)
            for late, column in enumerate(batch.columns[1:]):
                token = column.flatten().to_numpy(zero_copy_only=False)
                size = np.diff(column.offsets.to_numpy(zero_copy_only=False))
                at = token & (len(bits) * 8 - 1)
                hit = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                owner = np.repeat(np.arange(len(size)), size)[hit]
                place = hit - (np.cumsum(size) - size)[owner]
                columns = [cid[owner], np.full(len(hit), late, np.int32), place.astype(np.int32), token[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TOKENS)], schema=_TOKENS)

    return run


def _members(n: int, wanted):
    """The sets of the documents whose bit is set."""

    def run(batches):
        bits = wanted.value
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).cast(pa.bool_()))
            for _, sets in _set_batches([batch], n):
                yield _columns(_MEMBERS, [(*_fingerprint(g), g.tobytes()) for g in sets if len(g)])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("size", pa.int64())])
    for batch in batches:
        out = []
        for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns]):
            left, right = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            place = np.minimum(np.searchsorted(left, right), len(left) - 1)
            common = int((left[place] == right).sum())
            out.append((a, b, common, len(left) + len(right) - common))
        yield _columns(schema, out)


class _Classes:
    """The classes of equal sets of one table of documents and the links between them."""

    def __init__(self, docs: DataFrame, n: int, threshold: tuple[int, int], text: str, key: str):
        self.spark, self.n, self.threshold = docs.sparkSession, n, threshold
        self.texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
        both = stored(self.texts.select("doc", "text", *_text_hashes(F.col("text"))).mapInArrow(_sets(n), _ddl(_SETS)), "gram-sets")
        self.docs = both.where("slice is null").select("doc", "t1", "t2", "n", "f1", "f2")
        sketch = self.spark.sparkContext.broadcast(_sketch(both.where("slice is not null").select("slice", "task", "cells", "counts")))
        rows = self.texts.mapInArrow(_prefixes(n, threshold, sketch), _ddl(_PREFIXES))
        classes = rows.groupBy("f1", "f2").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("n", "first", "band", "always", "own", "next", "families", "typical")])
        self.classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "gram-classes")
        self.rows = total_rows(self.classes)

    def links(self, pairs: DataFrame, rows: int | None = None) -> DataFrame:
        """The pairs (a, b) whose exact similarity reaches the threshold."""
        pairs = stored(pairs, "gram-pairs", rows)
        n_pairs = total_rows(pairs)
        used = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
        used = stored(self.classes.select("cid", "doc", "f1", "f2").join(used, "cid"), "gram-used", 2 * n_pairs)
        wanted = self.spark.sparkContext.broadcast(_wanted_bits(used))
        sets = self.texts.select("doc", "text", F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS)).alias("place"))
        sets = sets.mapInArrow(_members(self.n, wanted), _ddl(_MEMBERS)).join(used.select("cid", "f1", "f2"), ["f1", "f2"])
        sets = stored(sets.select("cid", "grams").dropDuplicates(["cid"]), "gram-members")
        both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("grams").alias("x")), "a")
        both = both.join(sets.select(F.col("cid").alias("b"), F.col("grams").alias("y")), "b")
        found = both.select("a", "b", "x", "y").mapInArrow(_overlaps, "a long, b long, common long, size long")
        top, bottom = self.threshold
        links = stored(found.where(F.col("common") * bottom >= F.col("size") * top).select("a", "b"), "gram-links", n_pairs)
        remove(pairs, used, sets)
        return links

    def partition(self) -> DataFrame:
        """Links of each class to the most typical class of the groups it belongs to."""
        rows = self.classes.select("cid", "typical", "band", F.posexplode("families").alias("family", "low"))
        lead = rows.groupBy("family", "low", "band").agg(F.max(F.struct("typical", "cid")).alias("lead"), F.count(F.lit(1)).alias("n"))
        lead = stored(lead.where("n > 1").select("family", "low", "band", F.col("lead.cid").alias("b")), "gram-leads", 2 * self.rows)
        pairs = rows.join(lead, ["family", "low", "band"]).where("cid != b").select(F.col("cid").alias("a"), "b").distinct()
        return self.links(pairs, 2 * self.rows)

    def _fits(self, n: Column, least: Column, most: Column) -> Column:
        """Whether a size between ``least`` and ``most`` can be near enough to n."""
        top, bottom = self.threshold
        return (n * top <= most * bottom) & (least * top <= n * bottom)

    def _met(self, rows: DataFrame, *columns: str) -> DataFrame:
        """(cid, late, place, token): the tokens that sets of two components have, a row for each such set; ``late`` tells which column they
        come from.

        Most tokens are met by no one.  They are shuffled once, combined on the map side; of the second reading only tokens in a bitmap of
        those that are met go on to the join."""
        tokens = None
        for late, column in enumerate(columns):
            part = rows.select("comp", F.lit(late).alias("late"), F.explode(column).alias("token"))
            tokens = part if tokens is None else tokens.union(part)
        met = tokens.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("late").alias("late"))
        met = stored(met.where("low < high and late = 0").select("token"), "gram-met")
        wanted = self.spark.sparkContext.broadcast(_token_bits(met))
        tokens = rows.select("cid", *columns).mapInArrow(_tokens(wanted), _ddl(_TOKENS))
        left = stored(tokens.join(met, "token").select("cid", "late", "place", "token"), "gram-left")
        remove(met)
        return left

    def _matrix(self, tokens: DataFrame) -> DataFrame:
        """The tokens of each group, each once, with the range of sizes and places they come from."""
        groups = tokens.groupBy("token", F.col("comp").alias("g"), F.col("part").alias("gpart"), F.col("members").alias("gm"))
        return stored(groups.agg(F.min("n").alias("small"), F.max("n").alias("large"), F.min("place").alias("gfirst"), F.max("place").alias("gplace")), "gram-matrix")

    def _chosen(self, rows: DataFrame) -> DataFrame:
        """The rows of the sets that can have a partner: those which share as many slices with sets of other components as with one near
        set of the largest size there can be.

        Sets meet in the cut of the larger one's band; those of the band below bring their second tokens there."""
        top, bottom = self.threshold
        tokens = self._met(rows, "own", "next")
        shared = tokens.groupBy("cid", "late").agg(F.count(F.lit(1)).alias("c"))
        shared = shared.join(rows.select("cid", "n", F.size("own").alias("size_own"), F.size("next").alias("size_next")), "cid")
        differ = F.floor((F.col("n") + F.floor(F.col("n") * bottom / top)) * (bottom - top) / (bottom + top))
        filled = F.when(F.col("late") == 0, F.col("size_own")).otherwise(F.col("size_next"))
        shared = shared.where(F.col("c") >= F.greatest(F.lit(1), filled - differ))
        ids = stored(shared.select("cid").union(rows.where("always").select("cid")).distinct(), "gram-ids")
        chosen = stored(rows.drop("own", "next").join(ids, "cid", "left_semi"), "gram-chosen")
        remove(tokens, ids)
        return chosen

    def _opened_by_grams(self, rows: DataFrame) -> DataFrame:
        """(cid, n, g, gpart): the groups that share as many of the first n-grams with a set as two near sets of these sizes must."""
        top, bottom = self.threshold
        left = self._met(rows, "first")
        grams = stored(left.join(rows.select("cid", "n", "comp", "members", "part"), "cid"), "gram-tokens")
        remove(left)
        matrix = self._matrix(grams)
        after = F.struct("members", "comp") < F.struct("gm", "g")  # each pair of components once, the smaller one asks
        # A pair of sizes n and m must share this many, so the first one it shares is at most at n (or m) less this place.
        need = lambda m: F.ceil((F.col("n") + F.col(m)) * top / (top + bottom))
        early = (F.col("place") <= F.col("n") - need("small")) & (F.col("gfirst") <= F.col("large") - need("large"))
        hits = grams.join(matrix, "token").where(after & self._fits(F.col("n"), F.col("small"), F.col("large")) & early)
        bound = hits.groupBy("cid", "n", "g", "gpart", "gm").agg(
            F.count(F.lit(1)).alias("c"), F.min("place").alias("begin"), F.max("place").alias("end"), F.max("gplace").alias("gend"), F.max("large").alias("large"))
        least = F.ceil(F.col("n") * top / bottom)
        # A group of one: nothing is shared behind the last n-gram found.  A larger group: members may have found different ones.
        one = F.col("c") + F.least(F.col("n") - 1 - F.col("end"), F.col("large") - 1 - F.col("gend")) >= need("large")
        many = F.col("c") + F.col("n") - 1 - F.col("begin") >= least
        opened = stored(bound.where(F.when(F.col("gm") == 1, one).otherwise(many)).select("cid", "n", "g", "gpart"), "gram-opened")
        remove(grams, matrix)
        return opened

    def matrix_pairs(self, components: DataFrame) -> DataFrame:
        """Pairs of a query class and a member of a group that the bound opens."""
        sizes = stored(components.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("members")), "gram-sizes", self.rows)
        rooted = components.join(sizes, "root").union(sizes.select("root", F.col("root").alias("node"), "members"))
        rooted = rooted.select(F.col("node").alias("cid"), "root", "members")
        rows = self.classes.select("cid", "n", "band", "always", "first", "own", "next").join(rooted, "cid", "left").withColumns({
            "comp": F.coalesce("root", "cid"), "members": F.coalesce("members", F.lit(1))}).drop("root")
        pieces = F.ceil(F.col("members") / GROUP)
        rows = stored(rows.withColumn("part", F.pmod(F.xxhash64("cid"), pieces).cast("long")), "gram-rows")
        slim = stored(self.classes.select("cid", "doc", "f1", "f2"), "gram-slim")  # the tokens are in the rows now
        remove(self.classes, sizes)
        self.classes = slim
        if _Slices(self.threshold).used:
            every, rows = rows, self._chosen(rows)
            remove(every)
        opened = self._opened_by_grams(rows)
        members = rows.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("comp").alias("g"), F.col("part").alias("gpart"))
        pairs = opened.join(members, ["g", "gpart"]).where(self._fits(F.col("n"), F.col("m"), F.col("m")))
        return pairs.select(F.col("cid").alias("a"), "b")

    def labelled(self, components: DataFrame) -> DataFrame:
        """(f1, f2, root, component_id) of each class: its component and the smallest document id in it."""
        rows = self.classes.select("cid", "doc", "f1", "f2").join(components, F.col("cid") == F.col("node"), "left")
        rows = rows.select("doc", "f1", "f2", F.coalesce("root", "cid").alias("root"))
        least = stored(rows.groupBy("root").agg(F.min("doc").alias("component_id")), "gram-least", self.rows)
        return stored(rows.join(least, "root").select("f1", "f2", "root", "component_id"), "gram-result", self.rows)

    def linked(self) -> DataFrame:
        """The components of all classes, as ``labelled`` gives them."""
        near = self.partition()
        far = self.links(self.matrix_pairs(connected_components(near)))
        return self.labelled(connected_components(near.union(far)))


def ngram_components(docs: DataFrame, n: int = 3, threshold: tuple[int, int] = (9, 10), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``.

    A set holds the distinct n-word sequences of the whole text, words being runs of other than ASCII white space with A-Z lower-cased; a
    shorter text is one sequence.  Two documents are linked when intersection / union reaches ``threshold`` (numerator, denominator);
    ``component_id`` is the smallest key reachable by links.  Null, empty and blank texts have no n-grams and are linked with nothing.
    Repeated rows stay and are linked like any equal texts; a null key counts behind all others, so a component has a null id only if all
    its keys are null.  An empty table gives an empty result; further columns are ignored."""
    classes = _Classes(docs, n, threshold, text, key)
    return classes.docs.join(classes.linked(), ["f1", "f2"], "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of ``docs``, all columns, of each component: the smallest key, null last, and of equal keys the text with the smallest hash.

    Keys need not name one text: components are told apart by their texts, so unrelated texts of one key, or without any, all stay.  Of
    copies with the same key and text one stays.  Rows without n-grams are linked with nothing and all stay."""
    classes = _Classes(docs, n, threshold, text, key)
    rows = classes.docs.where("n > 0").join(classes.linked(), ["f1", "f2"])
    kept = rows.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("nameless"), "doc", "t1", "t2")).alias("best"))
    kept = stored(kept.select(F.col("best.doc").alias("k"), F.col("best.t1").alias("t1"), F.col("best.t2").alias("t2")), "gram-kept", classes.rows)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = docs.select(row, F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), *_text_hashes(F.col(text)))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = whole["doc"].eqNullSafe(kept["k"]) & (whole["t1"] == kept["t1"]) & (whole["t2"] == kept["t2"])
    chosen = whole.where(~blank).join(kept.hint("shuffle_hash"), same, "left_semi")
    others = [F.col(f"row.`{f.name}`") for f in docs.schema if f.name not in (text, key) and isinstance(f.dataType, AtomicType) and f.dataType.typeName() != "variant"]
    copy = F.row_number().over(Window.partitionBy("doc", "t1", "t2").orderBy(F.xxhash64(F.lit(0), *others)))
    return chosen.withColumn("copy", copy).where("copy = 1").select("row.*").union(whole.where(blank).select("row.*"))
