"""The operators for training data: SQL, brute force, and the cases their docstrings define."""

import contextlib
import gzip
import itertools
import os
import sys
import threading
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from tablescope.llm import (id_coder, licences, line_dedup, mixing, ngram_join, packing, quality, secret_scan, token_files, vector_dedup, warc)
from tablescope.llm.components import connected_components
from tablescope.llm.queries import QUERIES
from tablescope.session import scratch_path
from tools.compare import compare, connect

CLASH = "row string, key long, size long, place int, line string, bucket int, n long, h1 long, words string, blob string, batch int, doc long, piece int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
LINE = "This very line is found in several documents."
LONG = " ".join(f"word{i}" for i in range(60_000))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, f"first\n{LINE}\nlast"), (7, f"{LINE.upper()}\nx"), (8, f"  {LINE} "),
    (8, f"  {LINE} "), (None, "text without an id but with some words"), (9, LONG), (10, LONG + " more"), (None, None), (11, "a b c d"), (12, "A b C d"),
]


def docs_frame(spark, rows=TEXTS):
    full = [(i, t, None, None if (i or 0) % 3 == 0 else f"s{(i or 0) % 3}", None, *["x" if "string" in c else 7 for c in CLASH.split(", ")]) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture
def docs(spark):
    return docs_frame(spark)


@pytest.fixture
def none(spark):
    return docs_frame(spark, []).cache()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_agrees_with_sql(spark, db, name):
    query, sql = QUERIES[name]
    assert compare(query(spark, SF), sql, db) == []


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (52, 51), (60, 60)], "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 51: 50, 52: 50}
    assert connected_components(links.where("a < 0")).count() == 0


def plain_groups(rows, n, top, bottom):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and common * bottom >= len(sets[i] | sets[j]) * top:
            group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    return sets, group


def test_ngram_edge_cases(spark, docs, none):
    found = sorted(map(tuple, ngram_join.ngram_components(docs, 3, (9, 10)).collect()), key=str)
    sets, group = plain_groups(TEXTS, 3, 9, 10)
    ids = {g: min((TEXTS[i][0] for i in range(len(TEXTS)) if group[i] == g and TEXTS[i][0] is not None), default=None) for g in set(group)}
    assert found == sorted(((TEXTS[i][0], len(sets[i]), ids[group[i]] if sets[i] else TEXTS[i][0]) for i in range(len(TEXTS))), key=str)
    assert ngram_join.ngram_components(none).count() == 0
    kept = ngram_join.keep_one_of_each(docs, 3, (9, 10))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 8, 9, 11]


def test_one_of_each_component_stays_whatever_its_keys(spark):
    one, two, three, four = (" ".join(f"{name}{i}" for i in range(20)) for name in ("red", "green", "blue", "grey"))
    rows = [(None, one), (None, two), (None, two), (7, three), (7, four), (3, one + " x"), (8, one + " y"), (8, "lone words of nobody else"), (8, one + " y")]
    for order in (rows, rows[::-1]):
        kept = ngram_join.keep_one_of_each(docs_frame(spark, order), 3, (4, 5)).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(
            [(3, one + " x"), (None, two), (7, three), (7, four), (8, "lone words of nobody else")], key=str)


@pytest.mark.parametrize("n, threshold", [(5, (4, 5)), (2, (1, 2))])
def test_ngram_near_copies(spark, n, threshold):
    rng = np.random.default_rng(n)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.integers(0, 5)):
            words[rng.integers(0, 60)] = f"x{rng.integers(0, 1000)}"
        rows.append((i, " ".join(words)))
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs_frame(spark, rows), n, threshold).collect()}
    _, group = plain_groups(rows, n, *threshold)
    assert found == {i: group[i] for i in range(150)}


def test_ngram_tables_are_deleted_once_read(spark, docs):
    from pathlib import Path

    from tablescope.session import shared_dir

    held = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).glob("llm-gram-*")}
    before = held()
    ngram_join.ngram_components(docs, 3, (9, 10)).collect()
    left = {name.split("-")[2] for name in held() - before}
    assert not left & {"classes", "rows", "met", "left", "tokens", "matrix", "bound", "members"}, left


def test_ngram_slices_meet():
    """Two sets that reach the threshold share a slice, unless both are told that their slices are not enough."""
    rng, slices, alone = np.random.default_rng(3), ngram_join._Slices((9, 10)), 0
    for trial in range(3000):
        size = int(rng.integers(1, 60) if trial % 2 else rng.integers(60, 3000))
        pool = np.unique(rng.integers(0, 2**64, size + size // 9, dtype=np.uint64))
        one = np.sort(rng.permutation(pool)[:max(1, len(pool) - int(rng.integers(0, len(pool) // 18 + 1)))])
        two = np.sort(rng.permutation(pool)[:max(1, len(pool) - int(rng.integers(0, len(pool) // 18 + 1)))])
        one, two = sorted((one, two), key=len)
        common = len(np.intersect1d(one, two))
        if 10 * common < 9 * (len(one) + len(two) - common):
            continue
        bands = slices.band(len(one)), slices.band(len(two))
        assert bands[1] - bands[0] in (0, 1)
        (x, enough), (y, also) = (slices.tokens(g, ngram_join.mix(g), bands[1]) for g in (one, two))
        shared = len(np.intersect1d(x, y))
        assert shared or not (enough or also)
        alone += not (enough or also)
        if enough:
            assert shared >= len(x) - (len(one) + len(two)) // 19
    assert alone < 1000


def test_ngram_slices_against_all_pairs(spark):
    """Long sets of passages that many documents share, near copies at every distance around the threshold."""
    rng = np.random.default_rng(4)
    passages = [[f"p{j}-{i}" for i in range(60)] for j in range(6)]
    rows, texts = [], []
    for i in range(160):
        words = list(texts[rng.integers(0, len(texts))]) if i % 2 and texts else [w for j in rng.permutation(6)[:4] for w in passages[j]] + [f"u{i}-{k}" for k in range(int(rng.integers(10, 200)))]
        for _ in range(int(rng.integers(0, 12))):
            words[int(rng.integers(0, len(words)))] = f"x{rng.integers(0, 1000)}"
        words = words[:len(words) - int(rng.integers(0, 12))]
        texts.append(words)
        rows.append((i, " ".join(words)))
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs_frame(spark, rows), 3, (9, 10)).collect()}
    _, group = plain_groups(rows, 3, 9, 10)
    assert 20 < len(set(group)) < 150
    assert found == {i: group[i] for i in range(160)}


def test_ngram_joins_grow_with_the_sets(spark, monkeypatch):
    """Many sets of one origin, most pairs too far apart for a link: no join of tokens makes a row for every pair."""
    rng, made, found_matrix = np.random.default_rng(7), [], ngram_join._Classes._matrix
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(300):
        words = list(base)
        for at in rng.permutation(150)[:8 if i % 10 else 1]:
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))

    def matrix(self, tokens):
        result = found_matrix(self, tokens)
        made.append(tokens.select("token").join(result.select("token"), "token").count())
        return result

    monkeypatch.setattr(ngram_join._Classes, "_matrix", matrix)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs_frame(spark, rows), 3, (9, 10)).collect()}
    _, group = plain_groups(rows, 3, 9, 10)
    assert found == {i: group[i] for i in range(300)} and len(set(group)) > 200
    assert max(made) < 20 * 300, made


def test_ngram_tokens_that_are_met(spark):
    """Only tokens in the bitmap are read a second time, with their place and column."""
    rng = np.random.default_rng(8)
    lists = [[rng.integers(-2**63, 2**63, int(rng.integers(0, 50))).tolist() for _ in range(2)] for _ in range(200)]
    every = sorted((i, late, place, token) for i, pair in enumerate(lists) for late, tokens in enumerate(pair) for place, token in enumerate(tokens))
    met = {t[3] for t in every[::40]}
    bits = ngram_join._token_bits(spark.createDataFrame([(t,) for t in met], "token long"))
    frame = spark.createDataFrame([(i, *pair) for i, pair in enumerate(lists)], "cid long, own array<long>, next array<long>")
    left = sorted(map(tuple, frame.mapInArrow(ngram_join._tokens(spark.sparkContext.broadcast(bits)), ngram_join._ddl(ngram_join._TOKENS)).collect()))
    assert [t for t in left if t[3] in met] == [t for t in every if t[3] in met]
    assert set(left) <= set(every) and len(left) < 2 * len(met) + len(every) // 20
    assert not ngram_join._token_bits(frame.select(F.explode("own").alias("token")).where("false")).any()


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in base[i % 20] + rng.normal(size=8) * 0.05 * (i % 4)], i % 2) for i in range(200)]
    odd = [(200, None, 1), (201, [0.0] * 8, 1), (202, [1.0, None], 1), (203, [float("nan")] * 8, 1), (204, rows[0][1], None), (205, [], 0),
           (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1), (None, [-1.0, -2.0], 1), (0, rows[0][1], 0), (208, [1e300, 0.0], 0), (209, [3.0, 0.0], 0)]
    frame = spark.createDataFrame([(*r, 5, "c") for r in rows + odd], "vec_id long, embedding array<double>, label int, cid long, root string")
    found = sorted(map(tuple, vector_dedup.near_vectors(frame).collect()), key=str)
    every = rows + odd
    good = [i for i, (_, v, lab) in enumerate(every) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(every[i][1]) / np.abs(every[i][1]).max() for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = {i: [j for j in good if j != i and every[i][2] == every[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] for i in good}
    root = {i: every[i][0] for i in range(len(every))}
    for _ in range(50):
        root = {i: min([x for x in [root[i], *[root[j] for j in links.get(i, ())]] if x is not None], default=None) for i in root}
    assert found == sorted(((every[i][0], len(links.get(i, ())), root[i]) for i in root), key=str)
    assert vector_dedup.near_vectors(frame.where("vec_id < 0")).count() == 0


def units(n, width, seed=1):
    """Vectors without clusters, and then a tenth of them again with small changes."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[-(n // 10):] = x[:n // 10] + rng.normal(size=(n // 10, width)) * 0.1
    return x


def linked_to(x, ids, labels=None):
    """The id, number of links and smallest id reachable of each vector, all pairs being compared."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    near &= True if labels is None else np.equal.outer(labels, labels)
    least = np.array(ids)
    for _ in range(30):
        least = np.minimum(least, np.where(near, least[None], max(ids)).min(1))
    return {i: (int(n), int(r)) for i, n, r in zip(ids, near.sum(1), least)}


def test_vectors_of_large_labels_are_compared_in_pieces(spark, monkeypatch):
    x = units(1500, 16).astype(np.float32)
    labels = np.arange(1500) % 1350 % 3
    frame = spark.createDataFrame([(i, [float(c) for c in v], int(labels[i])) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    expected = linked_to(x.astype(float), list(range(1500)), labels)
    monkeypatch.setattr(vector_dedup, "PIECE", 64 * 150)
    found = {r[0]: (r[1], r[2]) for r in vector_dedup.near_vectors(frame).collect()}
    assert found == expected
    few = frame.where("label = 0 or vec_id < 20")
    assert {r[0]: (r[1], r[2]) for r in vector_dedup.near_vectors(few).collect() if labels[r[0]] == 0} == {i: v for i, v in expected.items() if labels[i] == 0}


def test_vectors_need_disk_in_proportion(spark, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    tops = [shared, *(f.toString() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())]
    used, over = [], threading.Event()

    def watch():
        while not over.wait(0.05):
            total = 0
            for f in (os.path.join(d, n) for top in tops for d, _, names in os.walk(top) for n in names):
                with contextlib.suppress(FileNotFoundError):
                    total += os.path.getsize(f)
            used.append(total)

    x = units(12_000, 32)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": list(x), "label": 1}))
    frame.repartition(4).write.parquet(f"{tmp_path}/vectors")
    given = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    thread = threading.Thread(target=watch)
    thread.start()
    try:
        assert vector_dedup.near_vectors(spark.read.parquet(f"{tmp_path}/vectors")).where("n_links > 0").count() >= 2400
    finally:
        over.set()
        thread.join()
    assert max(used) - used[0] < 6 * given


def test_links_of_pieces(monkeypatch):
    monkeypatch.setattr(vector_dedup, "LIST", 100)
    rng = np.random.default_rng(2)
    x = np.concatenate([units(1200, 48), rng.normal(size=48) + rng.normal(size=(300, 48)) * 0.2])
    x = x[rng.permutation(len(x))]
    model = vector_dedup.fit(vector_dedup._units(x), 12, 0.93)
    assert model.axes is not None and model.axes.shape[1] < 47

    def piece(rows, first):
        unit = vector_dedup._units(x[rows])
        lists = model.nearest(unit)
        order = np.argsort(lists, kind="stable")
        codes, error = model.encode(unit, lists)
        return vector_dedup.Piece(model, lists[order], (first + rows)[order], np.full(len(rows), 2), codes[order], error[order], x[rows][order])

    both, reach = linked_to(x, list(range(len(x)))), float(np.sqrt(2 - 2 * 0.93))
    whole = piece(np.arange(len(x)), 0)
    assert len(whole.cells) > 3
    cid, linked, root = vector_dedup.Links(whole, whole, 0.93, reach).find()
    assert {int(c): int(n) for c, n in zip(cid, linked)} == {i: 2 * n for i, (n, _) in both.items() if n}
    groups = {}
    for c, r in zip(cid.tolist(), root.tolist()):
        groups.setdefault(r, set()).add(c)
    assert sorted(map(min, groups.values())) == sorted({r for n, r in both.values() if n})
    half = len(x) // 2
    a, b = piece(np.arange(half), 0), piece(np.arange(half, len(x)), 0)
    counts = dict.fromkeys(range(len(x)), 0)
    for p, q in ((a, a), (a, b), (b, b)):
        for c, n in zip(*(v.tolist() for v in vector_dedup.Links(p, q, 0.93, reach).find()[:2])):
            counts[c] += n
    assert counts == {i: 2 * n for i, (n, _) in both.items()}


def test_lines(spark, docs, none):
    rows = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"][:30]) for r in line_dedup.dedup_lines(docs).select(
        "row.doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)
    assert (6, 3, 1, "first\nlast") in rows and (7, 2, 1, "x") in rows and rows.count((8, 1, 0, f"  {LINE} "[:30])) == 2
    assert (1, 1, 0, "") in rows and (2, 1, 0, "") in rows and len(rows) == len(TEXTS)
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_runs_grow_by_batches(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    for doc in (5, 1, 9, 3, 7):
        runs.add(spark.createDataFrame([(doc, 1, 1), (doc, doc, 2)], "doc long, h1 long, h2 long"))
    assert [tuple(r) for r in runs.shared().collect()] == [(1, 1, 9)]
    assert len(runs.levels) > 1


def test_mixing(spark, read, docs, none):
    mixed = mixing.mix_sources(read("documents")).toPandas()
    mixed["taken"] = mixed["size"] * mixed["rows"] * mixed["copies"]
    each = mixed.groupby("source").agg(target=("target", "first"), size=("source_size", "first"), taken=("taken", "sum"), largest=("size", "max"))
    total, names = each["size"].sum(), sorted(each.index)
    weight, most = [i % 3 + 1 for i in range(len(names))], [3 * each["size"][n] for n in names]
    target, open_ = [0.0] * len(names), set(range(len(names)))
    while True:
        level = (total - sum(most[i] for i in range(len(names)) if i not in open_)) / sum(weight[i] for i in open_)
        full = {i for i in open_ if weight[i] * level > most[i]}
        target = [most[i] if i not in open_ else weight[i] * level for i in range(len(names))]
        if not full:
            break
        open_ -= full
    assert np.allclose(each.loc[names, "target"], target)
    assert (abs(each["taken"] - each["target"]) <= each["largest"]).all() and mixed["copies"].max() <= 3
    again = mixing.mix_sources(read("documents").repartition(7)).toPandas()
    order = ["doc_id", "source"]
    assert (again.sort_values(order)["copies"].to_numpy() == mixed.sort_values(order)["copies"].to_numpy()).all()
    odd = mixing.mix_sources(docs).toPandas()
    assert odd["rows"].sum() == len(TEXTS) and (odd.loc[odd["size"] == 0, "target"] >= 0).all()
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_rows(none).columns == none.columns
    back = mixing.mixed_rows(docs)
    assert back.columns == docs.columns and back.count() == (odd["rows"] * odd["copies"]).sum()


@pytest.mark.parametrize("rule", ["settle", "pivot"])
def test_rounding_keeps_expectations(rule):
    size, rng = np.array([50, 20, 10, 5, 3, 2, 1, 1]), np.random.default_rng(3)
    rounded = []
    for _ in range(4000):
        p = mixing.settle(0.4, size, rng) if rule == "settle" else mixing.pivot(np.full(8, 0.4), size, rng)
        assert abs(p @ size - 0.4 * size.sum()) < 1e-6 and ((p > 0) & (p < 1)).sum() <= 1
        rounded.append(p)
    assert abs(np.mean(rounded, 0) - 0.4).max() < 0.04


def test_licences(spark, docs, none):
    rows = [(1, "intro\nReleased under the MIT licence or so\nend"), (2, "Some code.\n" + licences.TEMPLATES["MIT text"].replace("  ", "\n") + "\nmore words"),
            (3, "released UNDER the: mit license"), (4, None), (5, LONG), (5, "x"), (None, "Licensed under CC BY-NC 4.0!")]
    found = {(r["doc_id"], r["licence"]) for r in licences.find_licences(docs_frame(spark, rows)).collect()}
    assert found == {(2, "MIT text"), (3, "MIT"), (None, "CC-BY-NC-4.0")}
    assert licences.find_licences(none).count() == 0 and licences.find_licences(docs).count() == 0


def test_warc_audit(spark):
    rows = [(i % 30, None if i == 3 else f"http://h/{i}\r\nX: y", None if i == 4 else f"<p>é{i}</p>\r\n\r\nWARC/1.0\r\n" * (i % 4), 1) for i in range(60)] + [(None, None, "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, value int")
    path = scratch_path(spark, "test-warc")
    bad = F.when(F.col("key") == 7, F.expr("concat('?', substring(body, 2))")).otherwise(F.col("body"))
    warc.write_replicas(pages, path, {"a": F.col("body"), "b": bad, "c": F.col("body")})
    a, b, c = (warc.record_table(spark, f"{path}/replica={x}") for x in "abc")
    assert a.count() == 61 and warc.audit(a, c).count() == 0
    wrong = warc.audit(a, b).join(a, ["volume", "start"]).collect()
    assert wrong and {(r["record_id"], r["state"]) for r in wrong} == {("urn:page:7", "changed")}
    lost = a.where("record_id <> 'urn:page:9'")
    assert {r["state"] for r in warc.audit(a, lost).collect()} == {"missing"} and {r["state"] for r in warc.audit(lost, a).collect()} == {"extra"}
    assert warc.audit(a.where("false"), a.where("false")).count() == 0


def test_warc_members_and_moved_records(spark, tmp_path):
    record = lambda i, body: f"WARC/1.0\r\nWARC-Record-ID: <r{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    rng = np.random.default_rng(1)
    records = {i: record(i, "".join(rng.choice(list("abcdef"), 4000))) for i in range(60)}
    second = {**records, 12: record(12, "short"), 30: records[30][:-900], 45: records[45] + record("new", "an extra one"), 50: record(50, "x" * 9000)}
    del second[5]
    packed = {i: gzip.compress(r) for i, r in second.items()}
    torn = bytearray(packed[55])
    torn[len(torn) // 2] ^= 255
    packed[55] = bytes(torn)
    for name, parts in (("one", [gzip.compress(r) for r in records.values()]), ("whole", [gzip.compress(b"".join(records.values()))]), ("two", packed.values())):
        (tmp_path / name).mkdir()
        (tmp_path / name / "v.warc.gz").write_bytes(b"".join(parts))
    one, whole, two = (warc.record_table(spark, str(tmp_path / n)) for n in ("one", "whole", "two"))
    assert one.count() == 60 and warc.audit(one, whole).count() == 0
    wrong = warc.audit(one, two).where("start IS NOT NULL").join(one, ["volume", "start"]).collect()
    assert sorted((r["record_id"], r["state"]) for r in wrong) == [("r12", "changed"), ("r30", "changed"), ("r5", "missing"), ("r50", "changed"), ("r55", "changed")]
    extra = warc.audit(one, two).where("start IS NULL").collect()
    assert [(r["state"], r["start_two"]) for r in extra] == [("extra", sum(len(second[i]) for i in second if i < 45) + len(records[45]))]
    back = warc.audit(two, one).groupBy("state").count().collect()
    assert {r["state"]: r["count"] for r in back} == {"changed": 4, "extra": 1, "missing": 1}


def test_damaged_warc_header():
    one = b"WARC/1.0\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = one.replace(b"<a>", b"<b>")
    assert [x[2] for x in warc.split_records(one + two)] == ["a", "b"]
    hurt = one.replace(b"Content-Length: 3", b"Content-Length: 9")
    assert [x[2] for x in warc.split_records(hurt + two)] == [None, "b"]


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 3000])
@pytest.mark.parametrize("top", [1, 300, 2**32 - 1])
def test_blocks_of_ids(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    block = id_coder.encode(ids)
    assert (id_coder.decode(block) == ids).all()
    for at in range(0, len(block), max(1, len(block) // 20)):
        hurt = bytearray(block)
        hurt[at] ^= 16
        with pytest.raises(ValueError):
            id_coder.decode(bytes(hurt))


def test_a_long_repetitive_text_and_new_ids():
    ids = np.zeros(4_000_000, np.uint32)
    ids[-9:] = np.arange(1, 10)
    coded = id_coder.encode(ids)
    assert (id_coder.decode(coded) == ids).all() and coded == id_coder.encode(ids)
    for at in (0, 5, 14, 20, 40, 60, len(coded) // 2, len(coded) - 1):
        hurt = bytearray(coded)
        hurt[at] ^= 16
        with pytest.raises(ValueError):
            id_coder.decode(bytes(hurt))


def test_token_files(spark, docs, none):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    odd = [(20, "a  b c\n\nd <|endoftext|> 'll don't x  y \x1c z"), (21, " lead and trail "), (19, "日本語 text 123 456　x\0 y")]
    rows = TEXTS + odd
    for block_ids in (50, 1 << 20):
        path = scratch_path(spark, "test-ids")
        token_files.write_ids(docs_frame(spark, rows), path, public.path("byte_bpe_50k.json"), block_ids=block_ids)
        found = sorted(map(tuple, token_files.read_index(spark, path).collect()), key=lambda r: r[1])
        named = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
        at, expected = 0, []
        for key, text in named:
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
            expected.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert found[:len(named)] == expected and [r[0] for r in found[len(named):]] == [None, None]
        assert sum(len(r["ids"]) for r in token_files.read_ids(spark, path).collect()) == found[-1][1] + found[-1][2]
    path = scratch_path(spark, "test-ids")
    token_files.write_ids(none, path, public.path("byte_bpe_50k.json"))
    assert token_files.read_index(spark, path).count() == 0


def test_special_tokens_are_plain_encode(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rng, bits = np.random.default_rng(7), ["a", " ", "bc", "<|endoftext|>", "<|end", "oftext|>", "\n", "  ", "'ll", "7", ".", "é", "\t"]
    texts = ["a b <|endoftext|> c", "<|endoftext|>", "x<|endoftext|> ", " <|endoftext|> <|endoftext|>y", "<|endoftext|>\n z"]
    texts += ["".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(300)]
    rows, at, expected = list(enumerate(texts)), 0, []
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        expected.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    docs_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op7_id_files"][0](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == expected


def test_counts_of_a_block_are_renewed_seldom(monkeypatch):
    calls, renew = [], id_coder._Mixer._sum
    monkeypatch.setattr(id_coder._Mixer, "_sum", lambda self: (calls.append(1), renew(self))[1])
    ids = np.random.default_rng(3).zipf(1.2, 100_000).clip(max=60_000).astype(np.uint32)
    block = id_coder.encode(ids)
    assert len(calls) < 40  # once for each of 256 steps before
    assert (id_coder.decode(block) == ids).all() and len(calls) < 80


@pytest.mark.parametrize("top, n", [(2, 300_000), (50_000, 300_000), (2**32 - 1, 300_000), (1 << 21, 1_600_000)])
def test_blocks_of_many_different_ids(top, n):
    rng = np.random.default_rng(top)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, top, n, dtype=np.uint64), 7).astype(np.uint32)
    ids[n // 3: n // 2] = np.arange(n // 2 - n // 3) % 11
    assert (id_coder.decode(id_coder.encode(ids)) == ids).all()


def test_carries_pass_whole_words():
    out = np.array([5, 9, 2**32 - 1, 9, 2**32 - 1, 2**32 - 1], np.uint32)  # two lanes of three words
    id_coder._carry(out, np.array([6, 7]), 2)
    assert out.tolist() == [6, 9, 0, 10, 0, 0]


class _Counted:
    def __init__(self, engine):
        self.engine, self.texts = engine, []

    def encode_batch_fast(self, texts, **how):
        self.texts += texts
        return self.engine.encode_batch_fast(texts, **how)


@pytest.mark.parametrize("special", [True, False])
def test_each_part_of_a_word_is_encoded_once(special, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), token_files.WordEncoder(path, special)
    tokenizer.encode_special_tokens = not special
    encoder.model, encoder.tokenizer = _Counted(encoder.model), _Counted(encoder.tokenizer)

    def check(texts):
        ids, counts = encoder(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    check(["a blorf, blorf. blorf\nBlorf blorf.\nBlorf", "a blorf", ""])
    sent = encoder.model.texts + encoder.tokenizer.texts
    assert len(sent) == len(set(sent)) and sum("lorf" in t for t in sent) == 2  # "blorf," and "blorf." were words of their own before
    check(["a blorf, blorf."])
    assert len(encoder.model.texts + encoder.tokenizer.texts) == len(sent)
    monkeypatch.setattr(token_files, "CACHED", 20)
    rng = np.random.default_rng(11)
    bits = ["a", " ", "bc", "<|endoftext|>", "<|end", "oftext|>", "\n", "  ", "'ll", "7", ".", "é", "\t", "\0", ",", "Z.", "\r", "\u3000", "\xa0", "日", "x²", "\x1c", "ª", "\n\n", "!", ", "]
    for _ in range(60):
        check(["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(50)])
    assert len(encoder.known) < 400 and len(encoder.old) < 400


def test_one_encoder_for_all_tasks_of_a_worker(tmp_path):
    public = pytest.importorskip("public_tokenizers")
    path = tmp_path / "tokenizer.json"
    with open(public.path("byte_bpe_50k.json"), "rb") as file:
        path.write_bytes(file.read())
    first = token_files._encoder(str(path), True)
    assert token_files._encoder(str(path), True) is first and token_files._encoder(str(path), False) is not first
    path.write_bytes(path.read_bytes() + b"\n")
    assert token_files._encoder(str(path), True) is not first


def test_secrets_are_scanned_once(spark, docs, none):
    rows = [(1, 'é password = "abcdefgh1" token:short'), (2, "AKIA" + "A" * 12 + " " + "0" * 31 + " " + "a" * 32), (3, None), (4, 'é password = "abcdefgh1" token:short'),
            (5, "token=secret: abcdefgh12"), (None, "api-key apikey: '12345678'"), (6, " ".join(f"secret={i:08d}" for i in range(200)))]
    ledger = secret_scan.BlobLedger(spark, scratch_path(spark, "test-ledger"))
    frame = docs_frame(spark, rows)
    found = {r["doc_id"]: r["s"] for r in secret_scan.find_secrets(frame, ledger, secret_scan.BASE_RULES).select("doc_id", secret_scan.span_list(F.col("spans")).alias("s")).collect()}
    assert found[1] == found[4] == "assign:2:23" and found[2] == "access:0:16,hex:49:81" and found[3] == found[5] == ""
    assert found[6] == ",".join(f"assign:{16 * i}:{16 * i + 15}" for i in range(200)) and found[None] == "assign:8:25"
    n = ledger.entries().count()
    assert n == 6
    ledger.scan(frame, secret_scan.BASE_RULES)
    assert ledger.entries().count() == n
    ledger.scan(frame, secret_scan.RULES)
    assert ledger.entries().count() == 2 * n
    empty = secret_scan.BlobLedger(spark, scratch_path(spark, "test-ledger"))
    assert secret_scan.find_secrets(none, empty).count() == 0 and secret_scan.find_secrets(docs, empty).count() == len(TEXTS)


def test_packing(spark, read, docs, none):
    packed = packing.pack(read("documents"), budget=4096, buckets=5).toPandas()
    batches = packed.groupby("batch").agg(n=("slot", "size"), last=("slot", "max"), padded=("padded", "first"), kinds=("padded", "nunique"))
    assert (batches["n"] - 1 == batches["last"]).all() and (batches["kinds"] == 1).all()
    assert ((batches["n"] * batches["padded"] <= 4096) | (batches["n"] == 1)).all() and (packed["length"] <= packed["padded"]).all()
    assert sorted(batches.index) == list(range(len(batches))) and packed["padded"].nunique() <= 5
    assert packing.pack(docs).count() == len(TEXTS) and packing.pack(none).count() == 0


def test_best_buckets_are_best():
    rng = np.random.default_rng(5)
    for _ in range(30):
        tops = sorted(rng.choice(60, 8, replace=False).tolist())
        classes = [(t, int(n), t * int(n)) for t, n in zip(tops, rng.integers(1, 9, 8))]
        for most in (1, 2, 3, 8, 20):
            best = min(
                sum(n * classes[next(e for e in ends if e >= i)][0] - s for i, (_, n, s) in enumerate(classes))
                for k in range(1, min(most, 8) + 1) for ends in ((*c, 7) for c in itertools.combinations(range(7), k - 1))
            )
            chosen = packing.best_buckets(classes, most)
            assert packing.padding(chosen) == best and len(chosen) <= most and sum(b.rows for b in chosen) == sum(c[1] for c in classes)


def test_quality(spark, docs, none):
    ledger = quality.rule_ledger(docs)
    assert ledger.count() == len(TEXTS) and quality.rule_ledger(none).count() == 0
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [9, 10]
    counts = {(r["policy"], r["rule"]): tuple(r)[2:] for r in quality.ablations(ledger).collect()}
    rows = quality.apply_policy(ledger, quality.POLICIES["base"]).collect()
    assert counts["base", "few_words"] == (sum(r["n_words"] < 20 for r in rows), sum(r["failed_bits"] & 3 == 1 for r in rows), sum(r["failed_bits"] & 2 == 0 for r in rows))
    repeat = docs_frame(spark, [(1, "a b c d e f g h " * 2), (2, "a b c d e f g h i " * 2 + "z"), (3, "a " * 9)])
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.rule_ledger(repeat).collect()} == {1: 16, 2: 18, 3: 9}


def test_pipeline(spark, read):
    docs = read("documents")
    frames = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        path = scratch_path(spark, "test-stage")
        docs.write.parquet(path)
        docs = frames[name] = spark.read.parquet(path)
    kept = frames["quality_rules"]
    assert kept.columns == read("documents").columns and kept.count() == quality.apply_policy(quality.rule_ledger(read("documents")), quality.POLICIES["v1"]).where("kept").count()
    lines = {r["doc_id"]: r["text"] for r in frames["line_dedup"].collect()}
    holders = {}
    for r in kept.collect():
        for line in (r["text"] or "").split("\n"):
            holders.setdefault(line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}), set()).add(r["doc_id"])
    top = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    for r in kept.collect():
        left = [x for x in r["text"].split("\n") if top.get(x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}), r["doc_id"]) == r["doc_id"]]
        assert lines[r["doc_id"]] == "\n".join(left)
    rows = sorted(lines.items())
    sets, group = plain_groups(rows, 5, 4, 5)
    assert sorted(r["doc_id"] for r in frames["near_duplicates"].collect()) == [rows[i][0] for i in range(len(rows)) if group[i] == i]
    near, mixed = frames["near_duplicates"].toPandas().set_index("doc_id"), frames["source_mixing"].toPandas()
    assert set(mixed["doc_id"]) <= set(near.index) and (mixed.groupby("doc_id").size() <= 3).all() and list(mixed.columns) == docs_columns(read)
    assert frames["length_packing"].count() == len(mixed)
    assert corpus_pipeline.run(spark, SF).count() == len(mixed)


def docs_columns(read):
    return read("documents").columns


def test_fixity_query_on_empty_and_odd_pages(spark, tmp_path):
    """The query itself, on a table without rows and on one with nulls, empty bodies, repeated rows and clashing columns."""
    kinds = "page_id long, url string, html string, volume string, start long, state string, key long"
    rows = [(5, "u", "body of five"), (5, "u", "body of five"), (7, None, ""), (None, "v", None), (96, "a\nb", "x" * 70_000), (102, "w", "é")]
    for name, some in (("none", []), ("odd", rows)):
        spark.createDataFrame([(*r, "v", 1, "s", 2) for r in some], kinds).write.parquet(f"{tmp_path}/{name}/pages.parquet")
        found = QUERIES["op6_warc_fixity"][0](spark, f"{tmp_path}/{name}")
        assert found.columns == ["page_id", "n_bytes", "state", "digest"]
        states = sorted(((r["page_id"], r["state"]) for r in found.collect()), key=str)
        assert states == sorted(((k, "changed" if b and k is not None and (k % 97 == 5 or k % 89 == 7) else "intact") for k, _, b in some), key=str)
