"""Clustering, whitening and token files against plain forms."""

import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bytebpe, ptolemaic, rans, whitening
from tidemark.llm.common import opened

VECTORS = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VECTORS)


def lloyd(rows, k, rounds, scale, seed="3"):
    """Plain rounds over all distances; rows are (id, integers)."""
    hashed = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(x) for _, x in hashed[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, x in rows:
            groups.setdefault(near(x)[1], []).append(x)
        for i, members in groups.items():
            centers[i] = [sum(c) // len(members) for c in zip(*members)]
    return centers, {i: near(x) for i, x in rows}


def clumps(seed=2, n=300, width=8):
    """Vectors around six far points, with copies and an exact tie between two of them."""
    r = np.random.default_rng(seed)
    middles = r.normal(size=(6, width)) * 40
    x = (middles[r.integers(0, 6, n)] + r.normal(size=(n, width))).astype(np.float32)
    x[: n // 3] = x[0]
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_clusters_equal_plain_rounds(spark):
    rows = clumps()
    found = ptolemaic.cluster_vectors(frame(spark, rows), clusters=5, rounds=4, width=8, scale=16).collect()
    whole = [(i, [int(np.floor(16 * float(x))) for x in v]) for i, v in rows]
    centers, near = lloyd(whole, 5, 4, 16)
    assert {r["vec_id"]: (r["distance"], r["cluster"]) for r in found} == near
    total = sum(d for d, _ in near.values())
    for r in found:
        assert r["inertia"] == total and r["cluster_inertia"] == sum(d for d, c in near.values() if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centers[r["cluster"]])).encode()).hexdigest()
    # Far clumps: the bounds leave few centroids to compare.
    assert sum(r["checked"] for r in found) < 3 * len(found)


def test_bounds_never_exceed_distances():
    r = np.random.default_rng(5)
    for spread in (1, 1000, ptolemaic.LIMIT // 2):
        x, centers = (r.integers(-spread, spread + 1, (n, 64)) for n in (200, 8))
        pivots = ptolemaic.choose_pivots(x[:50], 10)
        low = ptolemaic.lower_bounds(ptolemaic.distances(x, pivots), centers, pivots)
        real = ptolemaic.distances(x, centers)
        assert (low <= real).all() and (low > 0).any()
        # A centroid that is a pivot: the bound is the distance itself, but for the rounding downwards.
        tight = ptolemaic.lower_bounds(ptolemaic.distances(x, pivots), pivots[:1], pivots)
        assert (tight <= ptolemaic.distances(x, pivots[:1])).all() and np.allclose(tight, ptolemaic.distances(x, pivots[:1]), rtol=1e-9, atol=1e-6 * spread)


def test_ties_go_to_the_smaller_number():
    x = np.array([[0, 0], [4, 0]])
    cluster, distance, _ = ptolemaic.nearest(x, ptolemaic.distances(x, x), np.array([[2, 1], [2, -1], [2, 1]]), x)
    assert cluster.tolist() == [0, 0] and distance.tolist() == [5, 5]


def test_clusters_of_awkward_tables(spark):
    good = [0.5] * 64
    rows = [(1, good), (1, good), (None, good), (2, None), (3, [0.5] * 63), (4, [None, *good[1:]]), (5, [float("nan"), *good[1:]]), (6, [float("-inf"), *good[1:]]), (7, [])]
    df = frame(spark, rows).withColumn("cluster", F.lit("x")).withColumn("x", F.lit(1))
    found = ptolemaic.cluster_vectors(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in found) == [(False, 1), (False, 1), (True, 0)]
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in found} == {(0, 0, 0)}
    assert ptolemaic.cluster_vectors(frame(spark, [(2, None)])).count() == 0
    with pytest.raises(Exception, match="beyond"):
        ptolemaic.cluster_vectors(frame(spark, [(1, [1e30] * 64)])).count()


def test_rank_one_updates():
    r = np.random.default_rng(1)
    for trial in range(120):
        n = int(r.integers(1, 20))
        values = [np.sort(r.random(n) * 10), np.sort(r.integers(0, 3, n).astype(float)), np.zeros(n), np.sort(10.0 ** r.integers(-12, 4, n))][trial % 4]
        q = np.linalg.qr(r.normal(size=(n, n)))[0]
        v = q[:, 0] * 3 if trial % 5 == 0 else r.normal(size=n) * 10.0 ** r.integers(-6, 3)
        new, axes = whitening.rank_one(values, q, v)
        whole = q @ np.diag(values) @ q.T + np.outer(v, v)
        assert np.abs(axes @ np.diag(new) @ axes.T - whole).max() <= 1e-12 * np.abs(whole).max()
        assert np.abs(axes.T @ axes - np.eye(n)).max() < 1e-12 and (np.diff(new) >= 0).all()


def test_secular_roots_are_roots():
    d, z = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-12, 50.0]), np.array([1.0, 1e-5, 2.0, 0.5, 1e-4])
    delta = whitening.secular_roots(d, z)
    t = d - np.diag(delta)
    assert (t[:-1] > d[:-1]).all() and (t[:-1] < d[1:]).all() and d[-1] < t[-1] < d[-1] + z @ z
    assert np.allclose(np.sort(np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))), t, rtol=1e-9, atol=1e-12)


def test_spectra_of_rows_one_by_one_and_of_blocks():
    x = np.random.default_rng(3).normal(size=(90, 7)) * np.arange(1, 8)
    x -= x.mean(0)
    one = np.zeros(7), np.eye(7)
    for v in x:
        one = whitening.rank_one(*one, v)
    block = whitening.add_rows(np.zeros(7), np.eye(7), x)
    halves = [whitening.add_rows(np.zeros(7), np.eye(7), y) for y in (x[:33], x[33:])]
    for values, _ in (one, block, whitening.combined(*halves[0], *halves[1])):
        assert np.allclose(values, np.linalg.eigvalsh(x.T @ x), rtol=1e-11)


def plain_whitening(rows, k=4):
    x = np.floor(256 * np.array([v for _, v in rows], float))
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening_equals_plain(spark):
    r = np.random.default_rng(4)
    x = (r.normal(size=(400, 12)) * np.linspace(1, 3, 12)).astype(np.float32)
    x[:150] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    n, deviation, whitened, explained = plain_whitening(rows)
    found = whitening.whiten(frame(spark, rows).repartition(7)).collect()
    assert len(found) == 1600
    got = np.zeros((400, 4))
    for f in found:
        got[f["vec_id"], f["component"] - 1] = f["whitened"]
        assert f["n"] == n == 251 and f["deviation"] == int(deviation[f["vec_id"]]) and f["identity_error"] < 1e-9
        assert f["explained"] == pytest.approx(explained[f["component"] - 1], rel=1e-10)
    assert np.allclose(got * np.sign((got * whitened).sum(0)), whitened, atol=1e-9)


def test_combining_in_a_tree(spark):
    x = np.random.default_rng(8).integers(-50, 50, (200, 5))
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<int>").repartition(9)
    parts = whitening.written(whitening.spectra(fit, x.mean(0), block=3), "parts")
    values, vectors = whitening.combine(parts, 5, fan_in=2)
    c = x - x.mean(0)
    assert np.allclose(values, np.linalg.eigvalsh(c.T @ c), rtol=1e-10) and np.allclose(vectors @ np.diag(values) @ vectors.T, c.T @ c)


def test_whitening_of_awkward_tables(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [-0.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("inf"), 0.0]), (6, [1.0, 2.0, 3.0]), (7, [])]
    df = frame(spark, rows).withColumn("component", F.lit("x"))
    found = whitening.whiten(df).collect()
    assert sorted((f["vec_id"] or 0, f["component"]) for f in found) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert {f["n"] for f in found} == {2}
    # The second dimension doesn't vary.
    assert all((f["whitened"] is None) == (f["component"] == 2) for f in found)
    assert all(abs(f["whitened"]) == pytest.approx(1) for f in found if f["component"] == 1)
    assert {round(f["explained"], 9) for f in found} == {1.0, 0.0}
    same = whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(same) == 6 and all(f["whitened"] is None and f["identity_error"] is None and f["deviation"] == 0 for f in same)
    assert whitening.whiten(frame(spark, [(3, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(3, [])])).count() == 0


def test_units_give_the_ids_of_whole_texts():
    import random

    known = bytebpe.byte_ids(rans.vocabulary())
    r = random.Random(1)
    some = [" ", "  ", "\n", "\t", "a", "b", "'s", "'t", " 12", "é", "日本", "\xa0", "　", ".", "!!", "<|endoftext|>", "\x1c", "​", "Ġ", "Ċ", "\r\n", "word", "\U0001f600"]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(0, 14))) for _ in range(6000)] + [None, "", " ", "x" * 5000, "ab " * 3000, "\n \n", "a\n  b", "a   b "]
    wanted = known.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)
    for text, got, want in zip(texts, known.batch(texts), wanted):
        assert np.frombuffer(got, known.kind).tolist() == want.ids, text


_HEX = str.maketrans("0123456789", "ghijklmnop")


def test_ids_kept_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    known = bytebpe.ByteIds(rans.vocabulary(), *([bytebpe.PATTERN] if hasattr(bytebpe, "PATTERN") else []))
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
        for i in range(0, 400_000, 4000):
            for _ in known.batch([" ".join([f"{j:x}".translate(_HEX) for j in range(k, k + 1000)]) for k in range(i, i + 4000, 1000)]):
                pass
        assert tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before < 30e6
    finally:
        tracemalloc.stop()


def test_parts_are_the_tokenizers(monkeypatch):
    """Also where few parts are kept, and few texts parted together."""
    import random

    for name, value in (("CACHE_PARTS", 12), ("CACHE_BYTES", 6), ("BATCH", 7), ("BATCH_CHARS", 60), ("CALL", 3)):
        monkeypatch.setattr(bytebpe, name, value)
    known, r = bytebpe.ByteIds(rans.vocabulary()), random.Random(3)
    some = ["'", "'s", "'re", "'ll", "'VE", "'l", "re", "s", " ", "  ", "\n", "\x85", "\u3000", "\u200b", "a", "Z", "\u00e9", "\u0301", "\u65e5", "7", "\u00bd", "\u0667", "!", "<", "<|", bytebpe.END, "\0", "\U0001f600"]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(0, 9))) for _ in range(4000)] + [None, "", bytebpe.END, "'s", "x'", "x'r", "it's", " 's", "''s", "'s's", "a \n", "a \n b"]
    wanted = known.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)
    got = list(known.batch(texts))
    assert len(got) == len(texts) and list(known.batch([])) == []
    for text, ids, want in zip(texts, got, wanted):
        assert np.frombuffer(ids, known.kind).tolist() == want.ids, text
    assert len(known.parts) <= 12


def test_numeral_system_round_trips():
    r = np.random.default_rng(0)
    for n, size in ((0, 10), (1, 10), (5, 3), (rans.BLOCK_IDS, 50), (70_000, 50_257), (2 * rans.BLOCK_IDS + 1, 300), (70_000, 1)):
        ids = np.minimum((r.pareto(1, n) * 3).astype(np.int64), size - 1)
        shared = rans.Table(np.bincount(ids, minlength=size))
        assert int(shared.own.sum()) == 1 << rans.BITS and (shared.own[np.unique(ids)] > 0).all()
        data = rans.file_bytes([(7, n)], ids.astype("<u2"), shared)
        held = rans.Reader(io.BytesIO(data), len(data), rans.Table.read(shared.data))
        assert (held.ids() == ids).all() and held.keys.tolist() == [7] and held.lengths.tolist() == [n]
        for _ in range(10 if n else 0):
            a, b = sorted(r.integers(0, n + 1, 2).tolist())
            assert (held.ids(a, b) == ids[a:b]).all()


def test_size_is_near_the_entropy():
    ids = np.minimum((np.random.default_rng(2).pareto(0.7, 600_000) * 3).astype(np.int64), 50_000)
    counts = np.bincount(ids, minlength=50_257)
    p = counts[counts > 0] / len(ids)
    bits = 8 * len(rans.file_bytes([(1, len(ids))], ids, rans.Table(counts))) / len(ids)
    assert bits < 1.08 * float(-(p * np.log2(p)).sum())


def test_damage_is_found():
    ids = np.random.default_rng(6).integers(0, 100, 40_000)
    shared = rans.Table(np.bincount(ids, minlength=100))
    data = bytearray(rans.file_bytes([(1, len(ids))], ids, shared))
    for at in (len(rans.MAGIC) + 3, len(data) // 2, len(data) - 60, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            rans.Reader(io.BytesIO(bytes(broken)), len(broken), shared).ids()
    with pytest.raises(ValueError):
        rans.Reader(io.BytesIO(bytes(data)), len(data), rans.Table(np.bincount(ids, minlength=101)))
    with pytest.raises(ValueError):
        rans.file_bytes([(1, 1)], np.array([99]), rans.Table(np.array([1, 1])))


def test_ids_of_documents_come_back(spark):
    texts = [(5, "a b c"), (2, "one two"), (2, "another one"), (None, "no id"), (9, None), (7, ""), (-3, "the end " * 400), (5, "a b c"), (None, "none either")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, start int, ids string")
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(rans.vocabulary())
    own = lambda t: [*known.encode(t or "", add_special_tokens=False).ids, rans.END_ID]
    for file_ids in (rans.FILE_IDS, 100):
        root, files = rans.write_ids(df.repartition(3), file_ids=file_ids)
        rows = rans.read_files(files, root).orderBy("start").collect()
        assert [r["doc_id"] for r in rows] == [-3, 2, 2, 5, 5, 7, 9, None, None]
        at, left = 0, [(d, tuple(own(t))) for d, t in texts]
        for r in rows:
            ids = tuple(np.frombuffer(r["ids"], "<u4").tolist())
            left.remove((r["doc_id"], ids))
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(r["ids"]))
            at += len(ids)
        assert not left
        if file_ids == 100:
            assert files.count() > 1
        system, path = opened(root)
        assert rans.Table.read(system.open_input_stream(f"{path}/{rans.TABLE}").read()).crc == rans.read_table(root).crc
    root, files = rans.write_ids(df.limit(0))
    assert files.count() == 0 and rans.read_files(files, root).count() == 0


def test_folder_names_its_file_system(spark):
    with pytest.raises(ValueError):
        opened("/no/scheme")
    with pytest.raises(Exception):
        opened("nosuchsystem://x/y")
