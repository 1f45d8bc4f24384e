"""Texts as files of token ids in ascending key order, written and read by Spark.

A file is a Parquet part whose rows are blocks of about BLOCK ids (see ``id_coder``), each with the keys and id counts of its texts; a text
is never split between rows, but a row of many ids is a series of blocks that are reset one by one.  Parts hold ranges of the key order.
The tokenizer's file is a parameter and is read where it is."""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import parallelism
from .id_coder import decode, encode

BLOCK = 1_500_000
CACHED = 600_000
GROUP = 1 << 23
END = 2
_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.binary()),
                     ("nameless", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
_BLOCKS_DDL = "part int, block int, start long, n_ids long, keys binary, nameless binary, counts binary, ids binary"
_TEXTS = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("crc", pa.int64())])
# Some letters and digits, of which a run is one word to a byte-level tokenizer's pattern, and places where the pattern always begins anew.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = f"^\0?(?:[{_LETTERS}]+|[0-9]+)$"
_HAS_CUT = f"[{_LETTERS}][,.\n]|[{_LETTERS},.:;!?\0]\n[{_LETTERS}]"
_CUTS = (f"([{_LETTERS}])([,.\n])", f"([{_LETTERS},.:;!?\0]\n)([{_LETTERS}])")
_OTHER_BPE = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte; the separator 0 stays."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in kept)
    return {**{b: chr(b) for b in kept}, **{b: chr(256 + n) for n, b in enumerate(others)}, 0: "\0"}


def _ragged(pool: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` that the codes name, one after the other, and where each ends; ``sizes`` are those of all runs in order."""
    taken, starts = sizes.take(codes), np.cumsum(sizes) - sizes
    ends = np.cumsum(taken)
    places = np.repeat(starts.take(codes) - ends + taken, taken)
    places += np.arange(len(places))
    return pool.take(places), ends


def _distinct(split: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different texts in lists of texts, the code of every text, and where the lists end."""
    words, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
    return words.dictionary, words.indices.to_numpy(), offsets[1:] - offsets[0]


class WordEncoder:
    """Token ids of texts.  A byte-level tokenizer splits texts in front of a blank unless white space precedes and follows it.  So the
    different words between blanks are cut into parts between which the tokenizer splits as well, and the ids of parts are remembered.  New
    parts of plain letters or digits go to the tokenizer's model without its pattern, others to the tokenizer.  A text with a blank before
    white space or its end, or with the character 0, is encoded whole.  The memory is bounded: it has two generations of about CACHED parts of
    less than 64 characters.  With ``special`` a special token written out in a text is that token, as it is for ``Tokenizer.encode``; else
    it is text like any other.

    A part stands without the blank in front of it; one without a blank has the character 0 there."""

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.model, self.letters = None, _byte_letters()
        model, before, added = self.tokenizer.model, self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        if (
            isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space
            and self.tokenizer.normalizer is None and isinstance(model, models.BPE) and not any(getattr(model, k) for k in _OTHER_BPE)
            and all(re.search(rf"[^{_LETTERS}0-9]", t.content) and not re.search(r"[\s,.]", t.content) for t in added)
        ):
            self.model = Tokenizer(model)

    def _spelled(self, word: str) -> str:
        """A plain word as the vocabulary writes its bytes."""
        return (word[1:] if word[0] == "\0" else " " + word).encode().decode("latin-1").translate(self.letters)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of parts that are not known yet, except of those that begin with white space or are nothing but a blank."""
        if len(self.known) >= CACHED:
            self.known, self.old = {}, self.known
        met = list(map(self.old.get, words))
        found = {word: ids for word, ids in zip(words, met) if ids is not None}
        new = [word for word, ids in zip(words, met) if ids is None]
        kinds = pc.match_substring_regex(pa.array(new, pa.large_string()), _PLAIN).to_pylist() if self.model else [False] * len(new)
        plain, other = list(compress(new, kinds)), [word for word, kind in zip(new, kinds) if not kind and word and not word[0].isspace()]
        spelled = [("Ġ" + w if w[0] != "\0" else w[1:]) if w.isascii() else self._spelled(w) for w in plain]
        for some, engine, texts in ((plain, self.model, spelled), (other, self.tokenizer, [w[1:] if w[0] == "\0" else " " + w for w in other])):
            if some:
                found.update(zip(some, [array("I", e.ids).tobytes() for e in engine.encode_batch_fast(texts, add_special_tokens=False)]))
        self.known.update(found if max(map(len, found), default=0) < 64 else {word: ids for word, ids in found.items() if len(word) < 64})
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        marked = pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar("\0", texts.type))
        words, codes, ends = _distinct(pc.split_pattern(marked, " "))
        if self.model:
            has = pc.match_substring_regex(words, _HAS_CUT)
            some = words.filter(has)
            for cut in _CUTS:
                some = pc.replace_substring_regex(some, cut, "\\1 \0\\2")
            words = pc.replace_with_mask(words, has, some)
        parts, part_codes, part_ends = _distinct(pc.split_pattern(words, " "))
        names = parts.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, names))
        unknown = [at for at, ids in enumerate(found) if ids is None]
        learnt = self._learn([names[at] for at in unknown]) if unknown else {}
        strange = []
        for at in unknown:
            found[at] = learnt.get(names[at], b"")
            if names[at] not in learnt:
                strange.append(at)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, upto = _ragged(np.frombuffer(b"".join(found), "<u4"), sizes, part_codes)
        sizes = np.diff(np.concatenate([[0], upto]).take(np.concatenate([[0], part_ends])))
        ids, upto = _ragged(pool, sizes, codes)
        counts = np.diff(np.concatenate([[0], upto]).take(np.concatenate([[0], ends])))
        whole = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        if strange:
            odd = np.add.accumulate(np.concatenate([[False], np.isin(part_codes, strange)]), dtype=np.int64)
            odd_words = np.diff(odd.take(np.concatenate([[0], part_ends]))) > 0
            odd = np.add.accumulate(np.concatenate([[False], odd_words.take(codes)]), dtype=np.int64)
            whole = whole | (np.diff(odd.take(np.concatenate([[0], ends]))) > 0)
        if whole.any():
            pieces, rows = np.split(ids, np.cumsum(counts)[:-1]), np.flatnonzero(whole).tolist()
            for at, e in zip(rows, self.tokenizer.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)):
                pieces[at] = np.array(e.ids, dtype="<u4")
                counts[at] = len(e.ids)
            ids = np.concatenate(pieces)
        return ids, counts


@functools.lru_cache(maxsize=2)
def _encoder_of(path: str, special: bool, stamp: tuple[int, int]) -> WordEncoder:
    return WordEncoder(path, special)


def _encoder(path: str, special: bool) -> WordEncoder:
    """One encoder for all tasks of a Python worker, as long as the file stays the same."""
    file = os.stat(path)
    return _encoder_of(path, special, (file.st_mtime_ns, file.st_size))


def _written(path: str, end: int, block_ids: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part = _encoder(path, special), TaskContext.get().partitionId()
        keys, counts, held, size, block, start = [], [], [], 0, 0, 0

        def packed() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = (
                part, block, start, len(ids), zlib.compress(np.array([k or 0 for k in keys], dtype="<i8").tobytes()),
                zlib.compress(np.array([k is None for k in keys], dtype="u1").tobytes()), zlib.compress(np.array(counts, dtype="<u4").tobytes()),
                encode(ids),
            )
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCKS)], schema=_BLOCKS)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            groups = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // GROUP
            borders = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(texts)]
            for begin, after in zip(borders[:-1], borders[1:]):
                ids, sizes = encoder(texts[begin:after])
                ends = np.cumsum(sizes)
                ids, sizes, ends = np.insert(ids, ends, np.uint32(end)), (sizes + 1).tolist(), ends + np.arange(1, len(ends) + 1)
                at = 0
                for key, n, upto in zip(names[begin:after], sizes, ends.tolist()):
                    keys.append(key)
                    counts.append(n)
                    size += n
                    if size >= block_ids:
                        held.append(ids[at:upto])
                        at = upto
                        yield packed()
                        block, start = block + 1, start + size
                        keys, counts, held, size = [], [], [], 0
                held.append(ids[at:])
        if keys:
            yield packed()

    return run


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end: int = END, block_ids: int = BLOCK, text: str = "text", key: str = "doc_id", special: bool = False
) -> None:
    """Write the ids of every text and ``end`` after each to ``path``, in ascending key order, null keys last.

    Null is an empty text; repeated keys stay, in an order that depends on their texts; an empty table writes no block.  Further columns
    are ignored.  ``tokenizer`` is the path of a tokenizer file that every machine has.  ``special`` gives the ids of the library's plain
    ``encode`` where a text holds a special token's own name; without it the name is encoded as text."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("key").asc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(parallelism(docs.sparkSession), *order).sortWithinPartitions(*order)
    ranged.mapInArrow(_written(tokenizer, end, block_ids, special), _BLOCKS_DDL).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, start, keys, nameless, counts, ids in zip(*[c.to_pylist() for c in batch.columns]):
            keys, nameless, counts = (np.frombuffer(zlib.decompress(x), kind) for x, kind in ((keys, "<i8"), (nameless, "u1"), (counts, "<u4")))
            raw, ends = memoryview(decode(ids).tobytes()), np.cumsum(counts, dtype=np.int64)
            begins = ends - counts
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64(), mask=nameless.astype(bool)), pa.array(start + begins, pa.int64()),
                pa.array(counts.astype(np.int64), pa.int64()), pa.array(crc, pa.int64()),
            ], schema=_TEXTS)


def read_index(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every text, from the decoded and checked blocks.  A damaged block raises.

    The ids before a part come from the sizes stored with the blocks: one number for each part reaches the driver."""
    blocks = spark.read.schema(_BLOCKS_DDL).parquet(path)
    before, offsets = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        offsets.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    texts = blocks.select("part", "start", "keys", "nameless", "counts", "ids").mapInArrow(_read, "part int, key long, at long, n_tokens long, crc long")
    return texts.join(starts, "part").select(
        F.col("key").alias(key), (F.col("before") + F.col("at")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, ids) of every block: the ids themselves, as arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, ids in zip(*[c.to_pylist() for c in batch.columns]):
                yield pa.RecordBatch.from_arrays([
                    pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([decode(ids).astype(np.int64)], pa.list_(pa.int64()))],
                    names=["part", "block", "ids"])

    blocks = spark.read.schema(_BLOCKS_DDL).parquet(path)
    return blocks.select("part", "block", "ids").mapInArrow(run, "part int, block int, ids array<long>")
