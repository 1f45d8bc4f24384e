"""Two tokenizations of the same bytes aligned with each other, and the token pairs the corpus links most often.

The token ends of two tokenizers A and B are two sorted sequences.  Their merge is cut by diagonals into pieces of PIECE steps; a binary
search on each diagonal finds where the piece starts in A and in B, so that all pieces are merged side by side, one numpy step at a time.
A piece marks the ends that both sides share; a group of tokens may begin in one piece and end in another, and is stitched together by
reading the marks of all pieces in order.  Within a task the texts of a buffer of about BATCH bytes are merged as one sequence."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import stored

BATCH = 1 << 20
PIECE = 512
#: Links of larger groups are counted by distinct ids of the group instead of one by one.
WIDE = 4096
#: The pairs whose counts are sent to all tasks; the counts of all others are joined.
FREQUENT = 1 << 18
_LEVELS = 16


class Vocabulary:
    """A tokenizer: ``encode`` gives the ids of the text with a blank before it, ``bytes`` the bytes of every id."""

    def __init__(self, encode: Callable[[str], list[int]], spelled: list[bytes]):
        self.encode, self.bytes = encode, spelled
        self.lengths = np.array([len(x) for x in spelled], np.int64)


def _byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}


def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file.  Special tokens in a text are plain text.  Where ids count the merges, the vocabulary runs as ranks."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocab, special = content["model"]["vocab"], {t["content"] for t in content["added_tokens"]}
    alphabet = _byte_alphabet()
    spelled = {i: t.encode() if t in special else bytes(alphabet[c] for c in t) for t, i in {**vocab, **{t["content"]: t["id"] for t in content["added_tokens"]}}.items()}
    table = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in content["model"]["merges"]]
    split = content["pre_tokenizer"]
    if merged == list(range(256, 256 + len(merged))) and split["type"] == "ByteLevel" and split["use_regex"] and not content["normalizer"]:
        ranks = {spelled[i]: i for t, i in vocab.items() if t not in special}
        engine = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Vocabulary(lambda text: engine.encode_ordinary(" " + text), table)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return Vocabulary(lambda text: tokenizer.encode(" " + text, add_special_tokens=False).ids, table)


def pieces(path: str) -> Vocabulary:
    """A sentencepiece file, whose model puts a blank before the text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spell = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
             for i in range(model.get_piece_size())]
    return Vocabulary(model.encode, spell)


def diagonal_starts(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` are among the first d of the merge of two sorted arrays, equal ones of ``a`` first, for each diagonal d."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        further = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(diagonals - 1 - middle, 0, len(b) - 1)])
        low, high = np.where(further, middle + 1, low), np.where(open_ & ~further, middle, high)
    return low


def shared_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the elements of two strictly increasing arrays that are in both, by merging independent pieces."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    diagonals = np.arange(0, len(a) + len(b), piece)
    i = diagonal_starts(a, b, diagonals)
    j = diagonals - i
    top = max(a[-1], b[-1])
    a, b = np.append(a, top + 1), np.append(b, top + 2)
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for _ in range(piece):
        x, y = a[i], b[j]
        equal = x == y
        in_a[i[equal]] = True
        in_b[j[equal]] = True
        ahead = x <= y
        i = np.minimum(i + ahead, len(a) - 1)
        j = np.minimum(j + ~ahead, len(b) - 1)
    return np.flatnonzero(in_a), np.flatnonzero(in_b)


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group and the place in its group of every element of groups of the given sizes."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def _number_texts(size: int, marks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Every number below ``size`` in decimal followed by each of two marks, as rows of equal width, and their lengths."""
    rows = [b"%d%c" % (i, m) for i in range(size) for m in marks]
    width = max(map(len, rows))
    return np.frombuffer(b"".join(r.ljust(width) for r in rows), np.uint8).reshape(-1, width), np.array([len(r) for r in rows])


class Aligner:
    """Groups, links and distinct id pairs of many texts at once."""

    def __init__(self, a: Vocabulary, b: Vocabulary, piece: int = PIECE):
        self.a, self.b, self.piece = a, b, piece
        text_a, n_a = _number_texts(len(a.bytes), b",|")
        text_b, n_b = _number_texts(len(b.bytes), b",;")
        width = max(text_a.shape[1], text_b.shape[1])
        self.texts = np.concatenate([np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t in (text_a, text_b)])
        self.text_lengths = np.concatenate([n_a, n_b])

    def encoded(self, text: str | None) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        a, b, whole = self.a.encode(text), self.b.encode(text), b" " + text.encode()
        fits = all(b"".join([v.bytes[i] for i in ids]) == whole for v, ids in ((self.a, a), (self.b, b)))
        return (a, b) if fits else ([], [])

    def __call__(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, occurrences) of every text; a pair is a * (ids of B) + b."""
        found = [self.encoded(t) for t in texts]
        n_a, n_b = (np.array([len(f[k]) for f in found], np.int64) for k in (0, 1))
        a, b = (np.concatenate([np.zeros(0, np.int64), *[np.array(f[k], np.int64) for f in found]]) for k in (0, 1))
        cut_a, cut_b = shared_ends(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]), self.piece)
        first_a, first_b = (np.concatenate([np.zeros(1, np.int64), c[:-1] + 1])[:len(c)] for c in (cut_a, cut_b))
        size_a, size_b = cut_a + 1 - first_a, cut_b + 1 - first_b
        text = np.searchsorted(np.cumsum(n_a), cut_a, "right")
        links = np.bincount(text, size_a * size_b, len(texts)).astype(np.int64)
        pairs, times, ends = self._pairs(a, b, first_a, first_b, size_a, size_b, text, len(texts))
        hashes = self._hashes(a, b, cut_a, cut_b, first_a, first_b, size_a, size_b, n_a + n_b)
        groups, begins = np.bincount(text, minlength=len(texts)), np.append(0, ends[:-1])
        for k in range(len(texts)):
            part = slice(begins[k], ends[k])
            yield int(n_a[k]), int(n_b[k]), int(groups[k]), int(links[k]), hashes[k], pairs[part], times[part]

    def _pairs(self, a, b, first_a, first_b, size_a, size_b, text, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids_b = len(self.b.bytes)
        all_pairs = len(self.a.bytes) * ids_b
        size = size_a * size_b
        group, at = _ragged(np.where(size <= WIDE, size, 0))
        keys = a[first_a[group] + at // size_b[group]] * ids_b + b[first_b[group] + at % size_b[group]] + text[group] * all_pairs
        keys, times = np.unique(keys, return_counts=True)
        wide = [(keys, times)]
        for g in np.flatnonzero(size > WIDE).tolist():
            (x, n_x), (y, n_y) = (np.unique(ids[f[g]:f[g] + s[g]], return_counts=True) for ids, f, s in ((a, first_a, size_a), (b, first_b, size_b)))
            wide.append(((x[:, None] * ids_b + y + text[g] * all_pairs).ravel(), (n_x[:, None] * n_y).ravel()))
        if len(wide) > 1:
            keys, inverse = np.unique(np.concatenate([k for k, _ in wide]), return_inverse=True)
            times = np.bincount(inverse, np.concatenate([t for _, t in wide])).astype(np.int64)
        return keys % all_pairs, times, np.searchsorted(keys, (np.arange(n) + 1) * all_pairs)

    def _hashes(self, a, b, cut_a, cut_b, first_a, first_b, size_a, size_b, n_tokens) -> list[str]:
        codes = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a], last_b[cut_b] = 1, 1
        codes[np.arange(len(a)) + np.repeat(first_b, size_a)] = 2 * a + last_a
        codes[np.arange(len(b)) + np.repeat(cut_a + 1, size_b)] = 2 * (len(self.a.bytes) + b) + last_b
        lengths = self.text_lengths[codes]
        written = self.texts[codes][np.arange(self.texts.shape[1]) < lengths[:, None]]
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(n_tokens))].tolist()
        raw = memoryview(written)
        return [hashlib.sha256(raw[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
_NAMES = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
_DDL = "row long, key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned(docs: DataFrame, a: str, b: str, piece: int = PIECE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each of ``docs`` with its counts and its distinct pairs, as differences of sorted numbers, and how often each is linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align, row = Aligner(byte_level(a), pieces(b), piece), TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begin, size = 0, 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size < BATCH and k + 1 < len(texts):
                    continue
                rows = [(row + i, keys[begin + i], *r[:5], np.diff(r[5], prepend=0).astype("<u8").tobytes(), r[6].astype("<u4").tobytes())
                        for i, r in enumerate(align(texts[begin:k + 1]))]
                row += len(rows)
                begin, size = k + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _KINDS)], names=_NAMES)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, _DDL)


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values of a binary column, and how many each has."""
    values = column.to_pylist()
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(values), kind).astype(np.int64), np.array([len(v) // width for v in values], np.int64)


def _pair_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    steps, sizes = _numbers(column, "<u8")
    total = np.cumsum(steps)
    ends = np.cumsum(sizes)
    before = np.append(0, total)[ends - sizes]
    return total - np.repeat(before, sizes), sizes


def pair_counts(rows: DataFrame, ids_b: int) -> DataFrame:
    """(pair, n, best): in how many rows each pair is linked and whether no pair of its A id is in more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(_pair_numbers(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    counts = stored(rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    with_id = counts.withColumn("a", F.expr(f"pair div {ids_b}"))
    most = with_id.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A at most
    return with_id.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs with their counts, ``most`` of them or fewer: those above a level of the logarithm of the count."""
    levelled = counts.withColumn("level", F.floor(F.log2("n") * _LEVELS).cast("int"))
    total, least = 0, None
    for level, n in sorted(((r["level"], r["n_pairs"]) for r in levelled.groupBy("level").agg(F.count(F.lit(1)).alias("n_pairs")).collect()), reverse=True):
        total += n
        if total > most:
            break
        least = level
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = levelled.where(F.col("level") >= least).select("pair", "n", F.col("best").cast("long").alias("best")).toPandas().sort_values("pair")
    return tuple(top[c].to_numpy(np.int64) for c in ("pair", "n", "best"))


def _sums(spark: SparkSession, rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """(row, n_best, count_sum): frequent pairs are looked up in each task, the others are joined with their counts."""
    known = spark.sparkContext.broadcast(_frequent(counts, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            row = batch.column(0).to_numpy()
            (pair, sizes), (times, _) = _pair_numbers(batch.column(1)), _numbers(batch.column(2), "<u4")
            owner = np.repeat(np.arange(len(row)), sizes)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            sums = [np.bincount(owner[hit], times[hit] * x[at[hit]], len(row)).astype(np.int64) for x in (best, n)]
            rare = ~hit
            nothing = np.zeros(rare.sum(), np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([row, row[owner[rare]]])), *[pa.array(np.concatenate([s, nothing])) for s in sums],
                pa.array(np.concatenate([np.full(len(row), -1), pair[rare]])), pa.array(np.concatenate([np.zeros(len(row), np.int64), times[rare]])),
            ], names=["row", "n_best", "count_sum", "pair", "times"])

    ddl = "row long, n_best long, count_sum long, pair long, times long"
    found = stored(rows.select("row", "pairs", "times").mapInArrow(run, ddl), "pair-sums")
    here = found.where("pair < 0").select("row", "n_best", "count_sum")
    joined = found.where("pair >= 0").select("row", "pair", "times").join(counts, "pair")
    there = joined.select("row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return here.unionByName(there).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_tokenizers(
    docs: DataFrame, a: str, b: str, piece: int = PIECE, frequent: int = FREQUENT, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    ``a`` is the path of a byte-level BPE file, ``b`` that of a sentencepiece model, on every machine.  Both spell a blank and the text; the
    byte offsets where tokens of both end cut the tokens into groups, and every token of A is linked with every token of B of its group.
    The count of an id pair is the number of rows that hold it linked; ``n_best`` counts links whose pair has the highest count of its
    A id, ties included, and ``count_sum`` adds the counts of all links.  ``groups_sha256`` is of the groups written as
    ``a1,a2|b1;a3|b2,b3``.  Null and empty texts, and texts whose tokens do not spell them, have zeros and an empty hash.  Repeated rows
    count as rows of their own, keys may be null or repeat, an empty table gives no rows, other columns are ignored whatever their
    names.  ``frequent`` bounds the pair counts that every task gets; it has no effect on the result."""
    ids_b = len(pieces(b).bytes)
    rows = stored(aligned(docs, a, b, piece, text, key), "aligned")
    counts = stored(pair_counts(rows, ids_b), "pair-best")
    sums = _sums(docs.sparkSession, rows, counts, frequent)
    return rows.drop("pairs", "times").join(sums, "row").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
