"""Licence texts and notices in documents, by the Dice coefficient of word bigrams against templates.

Texts are normalised: A-Z in lower case, ASCII punctuation to blanks.  A document is compared in runs of consecutive lines, so a notice is
found in the middle of a long text.  Two bounds prune: a document must hold enough of a template's bigrams at all, and only runs whose
own number of bigrams lets the coefficient reach the threshold are compared."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .texts import column_bytes, sequence_hashes, word_hashes

# The usual wording of notices and short licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
        AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": "Released under the MIT License.",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum() and c != 10)
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + PUNCTUATION, bytes(range(97, 123)) + b" " * len(PUNCTUATION))
_RESULT = pa.schema([("key", pa.int64()), ("licence", pa.string()), ("common", pa.int64()), ("n_run", pa.int64()), ("n_template", pa.int64()),
                     ("first_line", pa.int64()), ("last_line", pa.int64())])


def bigrams(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word bigram of a normalised text, and the line, counted from 0, of its first and its second word."""
    plain = text.translate(_PLAIN)
    words, begins = word_hashes(plain)
    breaks = np.flatnonzero(np.frombuffer(plain, np.uint8) == 10)
    line = np.searchsorted(breaks, begins)
    return sequence_hashes(words, 2), line[:-1], line[1:]


def _best_run(grams: np.ndarray, first: np.ndarray, second: np.ndarray, template: frozenset, threshold: tuple[int, int]) -> tuple | None:
    """(common, bigrams of the run, first line, last line) of the run of lines with the largest coefficient that reaches the threshold."""
    top, bottom = threshold
    size = len(template)
    largest = (2 * bottom - top) * size // top
    ends = np.unique(second)
    starts = np.unique(first[[g in template for g in grams.tolist()]])  # a run that starts elsewhere only grows by what it adds in front
    best = None
    for start in starts.tolist():
        at, seen, common = int(np.searchsorted(first, start)), set(), 0
        for end in ends[ends >= start].tolist():
            stop = int(np.searchsorted(second, end, "right"))
            for gram in grams[at:stop].tolist():
                if gram not in seen:
                    seen.add(gram)
                    common += gram in template
            at = max(at, stop)
            if len(seen) > largest:
                break
            if 2 * common * bottom >= (len(seen) + size) * top:
                if best is None or common * (best[1] + size) > best[0] * (len(seen) + size):
                    best = (common, len(seen), start, end)
    return best


def _matches(templates: dict[str, frozenset], threshold: tuple[int, int]):
    top, bottom = threshold
    every = np.unique(np.array([g for t in templates.values() for g in t], dtype=np.uint64))
    need = {name: -(-top * len(t) // (2 * bottom - top)) for name, t in templates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1))):
                grams, first, second = bigrams(text)
                known = grams[every[np.minimum(np.searchsorted(every, grams), len(every) - 1)] == grams] if len(every) else grams[:0]
                held = set(known.tolist())
                for name, template in templates.items():
                    if len(held & template) >= need[name] > 0:
                        best = _best_run(grams, first, second, template, threshold)
                        if best:
                            rows.append((key, name, best[0], best[1], len(template), best[2], best[3]))
            columns = zip(*rows) if rows else [[] for _ in _RESULT]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)

    return run


def find_licences(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: tuple[int, int] = (4, 5), text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, licence, common, n_run, n_template, first_line, last_line) for each row and template that some run of lines matches.

    The coefficient 2 * common / (n_run + n_template) counts distinct bigrams and is at least ``threshold`` (numerator, denominator).  Of
    several runs the one with the largest coefficient counts, of equal ones the earliest, then the shortest.  Lines end at line feeds and
    count from 0.  Null, empty and one-word texts match nothing, nor do templates of fewer than two words; repeated rows match each; an
    empty table gives an empty result; a null key stays null and other columns are ignored.  Nothing is shuffled."""
    sets = {name: frozenset(bigrams(" ".join(t.split()).encode())[0].tolist()) for name, t in templates.items()}
    rows = docs.selectExpr(f"cast(`{key}` as long) as key", f"`{text}` as text").mapInArrow(
        _matches(sets, threshold), "key long, licence string, common long, n_run long, n_template long, first_line long, last_line long")
    return rows.withColumnRenamed("key", key)
