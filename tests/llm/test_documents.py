"""The document operators against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import ctw, langid, lines, mixing, near, packing, quality, syncmers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["mix_size", "q_m", "q_kept", "ld_doc", "ld_kept", "li_lang", "place", "part", "k", "n", "key", "block", "bucket", "rep", "band", "id", "slice", "also", "offset"]


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}x{r.randrange(7)}" for _ in range(n)]


def corpus() -> list[tuple]:
    long = " ".join(words(300, 1))
    changed = long.split()
    changed[150] = "changed"
    shared = " ".join(words(60, 2))
    typo = shared.replace(shared.split()[30], "typo", 1)
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t\n ", "en", "b"), (4, long, "en", "a"), (5, long, "en", "b"), (6, " ".join(changed), "en", "a"),
        (7, shared + "\n" + " ".join(words(80, 3)), "en", "a"), (8, typo + "\n" + " ".join(words(80, 4)), "de", "b"), (9, "one two", "en", None), (10, "one two", "de", "a"),
        (11, "ünï çödé 漢字 🙂 " + " ".join(words(70, 5)), "fr", "c"), (12, "$$$ %%% *** ### " * 40, "en", "a"), (13, "same line again here now\n" * 60, "en", "a"),
        (14, " ".join(words(9000, 6, 4000)), "en", "a"), (15, "x" * 30000, "en", "b"), (16, "line\r\nwith\x0bblanks\x0c and\ttabs " + " ".join(words(60, 7)), "es", "b"),
    ]
    rows += [(100 + i, " ".join(words(60 + i, 50 + i)), "en", "a" if i % 3 else "b") for i in range(30)]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids, repeated rows and columns whose names the operators use."""
    from pyspark.sql import functions as F

    rows = corpus() + [corpus()[3], (None, "a null id " + " ".join(words(60, 9)), "en", "a", 5), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# Language model


def sequential_ctw(texts: list[bytes], depth: int):
    """Context-tree weighting one bit at a time, as published; returns the ln probability of each text given those before."""
    counts: dict = {}
    weighted: dict = {}
    estimate: dict = {}

    def update(path, bit):
        """path: keys from the root to the leaf."""
        for i in range(len(path) - 1, -1, -1):
            a, b = counts.get(path[i], (0, 0))
            estimate[path[i]] = estimate.get(path[i], 0.0) + math.log(((b if bit else a) + 0.5) / (a + b + 1))
            counts[path[i]] = (a, b + 1) if bit else (a + 1, b)
            if i == len(path) - 1:
                weighted[path[i]] = estimate[path[i]]
            else:
                kids = sum(weighted[k] for k in children.setdefault(path[i], set()) | {path[i + 1]})
                children[path[i]].add(path[i + 1])
                weighted[path[i]] = np.logaddexp(estimate[path[i]], kids) - math.log(2)

    children: dict = {}
    out = []
    for text in texts:
        data, total = bytes([255]) * depth + text + b"\xff", 0.0
        for i in range(depth, len(data)):
            context = tuple(data[i - 1 - d] for d in range(depth))
            for b in range(8):
                node, bit = (1 << b) | (data[i] >> (8 - b)), data[i] >> (7 - b) & 1
                path = [(node, context[:d]) for d in range(depth + 1)]
                before = weighted.get(path[0], 0.0)
                update(path, bit)
                total += weighted[path[0]] - before
        out.append(total)
    return out


def test_ctw_is_the_published_mixture():
    depth = ctw.DEPTH
    train, test = [b"abracadabra", b"abra abra", b"cad"], b"x"
    whole = sequential_ctw([*train, test[:1]], depth)
    block = ctw.Block([x.decode() for x in train])
    runs, n = ctw.run_counts(block, np.zeros(3, int))
    levels = ctw.build_levels(ctw.gathered(runs), n, 0)
    roots = levels[0].weighted.sum()
    assert abs(roots - sum(whole[:3])) < 1e-8  # the probability of the training texts
    # One byte after the training texts, frozen against sequential: the first bits agree, since no node is seen twice in a byte's path.
    end = next(ctw.Block([""]).parts())[0]
    assert abs(ctw.code_log10(end, levels)[0] * math.log(10) - sequential_ctw([*train, b""], depth)[3]) < 1e-8


def test_scores(spark, docs, empty, awkward):
    rows = {r["doc_id"]: r for r in ctw.ctw_scores(docs).collect()}
    table = {d: (t or "").encode().lower() for d, t, *_ in corpus()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in table}
    counts = Counter(w for d, t in table.items() if not held[d] for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(table)
    for d, text in table.items():
        tokens = [*text.split(), None]
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
        assert r["score"] < 0
    assert rows[4]["score"] == rows[5]["score"]
    assert ctw.ctw_scores(empty).count() == 0
    assert ctw.ctw_scores(awkward).count() == awkward.count()


def test_bits_sum_to_one():
    runs, n = ctw.run_counts(ctw.Block(["banana bandana"]), np.zeros(1, int))
    levels = ctw.build_levels(ctw.gathered(runs), n, 0)
    context = ctw.gathered(runs)[len(runs) // 2] >> 8 << 8
    assert sum(10 ** ctw.code_log10(context | np.arange(256), levels)) == pytest.approx(1.0)


def frozen_scores(rows):
    """log10 of the probability of every text under the trees of the training texts, by plain recursion over all contexts."""
    depth, counts = ctw.DEPTH, {}
    symbols = lambda t: [*(t or "").encode().lower(), 255]

    def decisions(text):
        data = [255] * depth + symbols(text)
        for i in range(depth, len(data)):
            for b in range(8):
                yield (1 << b) | (data[i] >> (8 - b)), tuple(data[i - 1 - d] for d in range(depth)), data[i] >> (7 - b) & 1

    for d, text in rows:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            for node, context, bit in decisions(text):
                for k in range(depth + 1):
                    counts.setdefault((node, context[:k]), [0, 0])[bit] += 1
    children = {}
    for node, context in counts:
        if context:
            children.setdefault((node, context[:-1]), []).append((node, context))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted = {}
    for key in sorted(counts, key=lambda x: -len(x[1])):
        own = kt(*counts[key])
        weighted[key] = own if len(key[1]) == depth else np.logaddexp(own, sum(weighted[c] for c in children[key])) - math.log(2)

    def probability(node, context, bit):
        p = 0.5
        for k in range(depth, -1, -1):
            key = (node, context[:k])
            if key not in counts:
                p = 0.5 * 0.5 + 0.5 * p
                continue
            stop = 1.0 if k == depth else math.exp(kt(*counts[key]) - math.log(2) - weighted[key])
            p = stop * (counts[key][bit] + 0.5) / (sum(counts[key]) + 1) + (1 - stop) * p
        return p

    return [sum(math.log10(probability(*x)) for x in decisions(text)) for _, text in rows]


def test_parts_of_a_block_give_what_the_block_gives():
    texts, held = [" ".join(words(r, 5 + r)) for r in range(12)] + [None, ""], np.arange(14) % 2
    whole, cut = ctw.Block(texts), ctw.Block(texts, part=50)
    runs, n = ctw.run_counts(whole, held)
    assert all((x == y).all() for x, y in zip((runs, n), ctw.run_counts(cut, held)))
    value = np.arange(len(runs), dtype=np.float32)
    assert (ctw.sums_by_text(whole, runs, value) == ctw.sums_by_text(cut, runs, value)).all()
    assert (ctw.gathered(ctw.scattered(runs)) == runs).all()


@pytest.mark.parametrize("fan", [64, 2])
def test_scores_of_a_table_equal_the_sequential_model(spark, monkeypatch, fan):
    """In one group of blocks, and merged and passed down over four steps."""
    monkeypatch.setattr(ctw, "FAN", fan)
    rows = [(i, " ".join(words(12, 60 + i, 9))) for i in range(30)] + [(40, None), (41, "ÄÖ 漢字 aAa")]
    got = {r["doc_id"]: r for r in ctw.ctw_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (d, text), wanted in zip(rows, frozen_scores(rows)):
        assert got[d]["score"] == pytest.approx(wanted, rel=1e-5)
        assert got[d]["bits_per_byte"] == pytest.approx(-wanted * math.log2(10) / (len((text or "").encode()) + 1), rel=1e-5)


# Packing


def test_ids_are_the_tokenizers_own(docs):
    texts = [t for _, t, *_ in corpus()] + ["It's I'M <|endoftext|>x Straße ǅ İ \u0085y", "don't!we'll...ok 3.14"]
    ids = packing.WordIds(packing.vocabulary())
    for text, got in zip(texts, ids.batch(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids.tokenizer.encode(text or "", add_special_tokens=False).ids


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_a_sweep_gives_every_piece_its_successor():
    r = random.Random(3)
    for _ in range(200):
        pieces = {x: r.randint(1, 4) for x in r.sample(range(20, 30), r.randint(1, 6))}
        gaps = {x: r.randint(1, 4) for x in r.sample(range(1, 140), r.randint(1, 12))}
        opened, closed, left = packing.sweep(gaps, pieces)
        stack, levels = [], {}
        for g, slots, longest, first, last in opened:
            sizes = [(longest, first + i) for i in range(gaps[g] * (slots - 1))] + [(g - (slots - 1) * longest, last + i) for i in range(gaps[g])]
            for size, level in sizes:
                levels.setdefault(level, []).append((-size, 0))
            stack += [size for size, _ in sizes]
        for length, level, taken in closed:
            for i in range(taken):
                levels.setdefault(level - 1 - i, []).append((-length, 1))
        stack.sort()
        wanted = []
        for length in sorted(pieces, reverse=True):  # one by one, the longest first: the smallest slot that is left and holds it
            for _ in range(pieces[length]):
                fit = [x for x in stack if x >= length]
                if fit:
                    stack.remove(min(fit))
                    wanted.append((length, min(fit)))
        got = []
        for rows in levels.values():
            rows.sort()
            slots, asked = [-s for s, kind in rows if kind == 0], [-s for s, kind in rows if kind]
            assert len(asked) <= len(slots)
            got += list(zip(asked, slots))
        assert sorted(got) == sorted(wanted) and sum(left.values()) == sum(pieces.values()) - len(wanted)


@pytest.mark.parametrize("seed, split_rows", [(0, 100_000), (1, 100_000), (2, 7)])
def test_sequences_are_about_as_few_as_best_fit_decreasing_makes(spark, monkeypatch, seed, split_rows):
    monkeypatch.setattr(packing, "SPLIT_ROWS", split_rows)
    r = random.Random(seed)
    sizes = [r.choice([1, 2, 3, 50, r.randint(1, 100), r.randint(1, 40)]) for _ in range(600)]
    df = spark.createDataFrame([(i if i % 3 else None, 0, 0, n, i % 5) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(df, 100).collect()
    assert sorted(x["length"] for x in rows) == sorted(sizes)
    fewest = best_fit_decreasing(sizes, 100)
    assert fewest <= check_packing(rows, 100) <= fewest * 1.01 + 1


def check_packing(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, awkward, empty):
    rows = packing.pack_documents(docs).collect()
    check_packing(rows)
    tokenizer = packing.WordIds(packing.vocabulary()).tokenizer
    of = {(r["doc_id"], r["piece"]): r for r in rows}
    for d, text, *_ in corpus():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for p in range(0, -(-len(ids) // 2048)):
            piece = np.array(ids[p * 2048 : (p + 1) * 2048], "<u4")
            r = of.pop((d, p))
            assert (r["start"], r["length"], r["ids_crc32"]) == (p * 2048, len(piece), zlib.crc32(piece.tobytes()))
    assert not of
    check_packing(packing.pack_documents(awkward).collect())
    assert packing.pack_documents(empty).count() == 0


# Language identification


def test_languages(spark, docs, empty, awkward):
    r = random.Random(4)
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["shr", "ent", "que"], "cc": ["öl", "ßa", "ün"]}
    rows = [(i, " ".join("".join(r.choices(kinds[k], k=3)) for _ in range(30)), k, "s", 0) for i in range(150) for k in [r.choice(list(kinds))]]
    rows += [(500, None, "aa", "s", 0), (501, "12 34 !?", "bb", "s", 0), (502, "", None, "s", 0)]
    got = {x["doc_id"]: x for x in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [i for i, *_ in rows[:150] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["li_lang"] == rows[i][2] for i in held) >= 0.97 * len(held)
    assert all(got[i]["li_lang"] == "und" and got[i]["li_score"] == 0 for i in (500, 501, 502))
    assert all(0 <= x["li_score"] <= 1 for x in got.values())
    assert langid.identify(empty).count() == 0 and langid.identify(awkward).count() == awkward.count()
    assert set(docs.columns) < set(langid.identify(docs).columns)


def test_nystrom_weights_equal_the_kernel_form():
    texts = [f"{a} {b}".encode() for a in ("kalomi", "shrent") for b in ("kami", "quent", "loka")]
    bits = [np.packbits(x.astype(bool)).tobytes() for x in langid.presence(texts)]
    names, weights = langid.fit(bits, ["a", "a", "a", "b", "b", "b"])
    rows = langid.presence(texts)
    scores = rows @ weights / np.sqrt(rows.sum(1))[:, None]
    assert [names[i] for i in scores.argmax(1)] == ["a"] * 3 + ["b"] * 3


def ngrams(text):
    """The presence bits of a text followed by zero bytes, one n-gram at a time."""
    out, data = set(), text + bytes(3)
    for order in langid.ORDERS:
        for i in range(len(text)):
            key = int.from_bytes(data[i : i + order], "big") % 2**32
            out.add((key * 2654435761 + order * 0x9E3779B1) % 2**32 * 2246822519 % 2**32 >> 32 - langid.DIMENSIONS_LOG2)
    return out


def test_scores_equal_the_explicit_kernel_machine():
    r = random.Random(8)
    texts = [" ".join("".join(r.choices(x, k=3)) for _ in range(8)).encode() for x in (["ka", "lo", "mi"], ["shr", "ent", "que"], ["öl", "ßa", "ün"]) for _ in range(5)]
    langs = ["a"] * 5 + ["b"] * 5 + ["c"] * 5
    asked = [b"kalomi", b"shrent quent", "ölßa x".encode(), b"", b"zz"]
    sets = [ngrams(t) for t in texts]
    assert [set(np.flatnonzero(x)) for x in langid.presence(texts)] == sets
    kernel = lambda a, b: len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))
    own = np.array([[kernel(a, b) for b in sets] for a in sets])  # all rows are landmarks
    target = np.array([[1.0 if x == y else -1.0 for y in "abc"] for x in langs])
    alpha = np.linalg.solve(own.T @ own + langid.RIDGE * len(texts) * own + 1e-8 * np.eye(len(texts)), own.T @ target)
    wanted = np.array([[kernel(ngrams(t), b) for b in sets] for t in asked]) @ alpha
    names, weights = langid.fit([np.packbits(x.astype(bool)).tobytes() for x in langid.presence(texts)], langs)
    rows = langid.presence(asked)
    assert names == ["a", "b", "c"] and np.allclose(rows @ weights / np.sqrt(np.maximum(rows.sum(1), 1))[:, None], wanted, atol=2e-4)


def test_chunks_bound_bytes_and_texts():
    from tidemark.llm.hashing import CHUNK_BYTES, CHUNK_TEXTS, chunks

    texts = ["x"] * 1000 + ["y" * (CHUNK_BYTES // 2)] * 5 + ["z" * 3 * CHUNK_BYTES] + [None]
    found = list(chunks(texts))
    assert [t for _, raws in found for t in raws] == [(t or "").encode() for t in texts]
    assert all(len(raws) <= CHUNK_TEXTS and (len(raws) == 1 or sum(map(len, raws)) <= CHUNK_BYTES) for _, raws in found)


# Mixing


def test_mixing(docs, awkward, empty):
    rows = mixing.mix_sources(docs).collect()
    by = {}
    for r in rows:
        assert r["mix_size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["mix_taken"] <= 2 * r["mix_size"]
        by.setdefault(r["source"], []).append(r)
    totals = {s: x[0]["mix_source_size"] for s, x in by.items()}
    assert {s: sum(r["mix_size"] for r in x) for s, x in by.items()} == totals
    targets = {s: x[0]["mix_target"] for s, x in by.items()}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(totals.values()))
    weights = dict(zip(sorted(totals, key=lambda s: (s is None, s)), [3, 1, 2, 3]))
    free = {s for s in totals if targets[s] < 2 * totals[s] - 1e-6}
    levels = {round(targets[s] / weights[s], 6) for s in free}
    assert len(levels) == 1 and all(2 * totals[s] <= weights[s] * max(levels) + 1e-6 for s in set(totals) - free)
    for s, x in by.items():
        assert abs(sum(r["mix_taken"] for r in x) - targets[s]) <= 2 * max(r["mix_size"] for r in x) + 1
    again = mixing.mix_sources(docs).collect()
    assert sorted((r["doc_id"], r["mix_taken"]) for r in rows) == sorted((r["doc_id"], r["mix_taken"]) for r in again)
    assert mixing.mixed(docs).count() == sum(r["mix_copies"] for r in rows)
    assert mixing.mix_sources(awkward).count() == awkward.count() and mixing.mix_sources(empty).count() == 0


def test_splits_leave_the_order_of_size_and_id(spark, monkeypatch):
    r = random.Random(5)
    rows = [(d, " ".join(words(r.choice((3, 4)), d)), r.choice("ab")) for d in r.sample(range(-(10**6), 10**6), 300)]
    rows += [(None, " ".join(words(3, 9000 + i)), "a") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    taken = lambda: sorted(((x["doc_id"], x["text"], x["mix_copies"]) for x in mixing.mix_sources(df).collect()), key=str)
    whole = taken()
    monkeypatch.setattr(mixing, "SPLIT_ROWS", 40)
    assert taken() == whole and len({x[2] for x in whole}) > 1


# Quality


def brute_measures(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    covered = {j for i, x in enumerate(windows) if many[x] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality(docs, awkward, empty):
    rows = {r["doc_id"]: r for r in quality.quality_verdicts(docs).collect()}
    for d, text, *_ in corpus():
        m = rows[d]["q_m"]
        got = (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"])
        assert got == brute_measures(text), d
        failed = got[0] < 50 or 100 * got[4] > 50 * got[0]
        assert rows[d]["q_base_failed"] == failed and not (failed and rows[d]["q_kept"])
    assert all(rows[100 + i]["q_kept"] for i in range(30)) and not rows[12]["q_kept"]
    assert set(rows[4].asDict()) == {*docs.columns, "q_m", "q_base_failed", "q_kept"}
    assert quality.quality_verdicts(awkward).count() == awkward.count() and quality.quality_verdicts(empty).count() == 0


def wilson(part, whole, z, side):
    n = max(whole, 1)
    p = min(part / n, 1)
    return (p + z * z / (2 * n) + side * z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def brute_kept(rows):
    """Verdicts by exact weighted quartiles, rounded to the sketch's buckets; rows of (doc_id, text, lang, source)."""
    measured = []
    for d, text, lang, source in rows:
        n, chars, symbols, dup, repeats = brute_measures(text)
        n_lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        z, mean = quality.ERRORS, chars / max(n, 1)
        error = z * mean / (2 * math.sqrt(max(n, 1)))
        shares = [(symbols, chars), (repeats, n), (dup, n_lines)]
        metrics = [(wilson(*x, z, -1), wilson(*x, z, 1), wilson(*x, z, 1)) for x in shares] + [(mean - error, mean + error, mean)]
        measured.append((d, lang or "", source or "", n < 50 or 100 * repeats > 50 * n, metrics))
    passing = [x for x in measured if not x[3]]
    bucket = lambda v: math.ceil(math.log(v) / quality.GAMMA_LN) if v > 0 else quality.ZERO
    value = lambda b: 0.0 if b == quality.ZERO else 2 * quality.GAMMA**b / (quality.GAMMA + 1)
    out = {}
    for d, lang, source, failed, metrics in measured:
        own, near = [x for x in passing if x[1:3] == (lang, source)], [x for x in passing if x[1] == lang]
        fine = not failed
        for k in range(4) if fine else ():
            weighed = sorted((bucket(x[4][k][2]), w) for some, w in ((own, 1), (near, quality.PRIOR / len(near)), (passing, quality.PRIOR / len(passing))) for x in some)
            total, q = sum(w for _, w in weighed), []
            for share in (0.25, 0.75):
                upto = 0
                for b, w in weighed:
                    upto += w
                    if upto >= total * (share - 1e-9):
                        q.append(value(b))
                        break
            reach = quality.REACH * (q[1] - q[0])
            fine = fine and metrics[k][0] <= q[1] + reach and (k < 3 or metrics[k][1] >= q[0] - reach)
        out[d] = fine
    return out


def test_verdicts_equal_brute_force(spark, docs):
    rows = [(d, t, lang, s) for d, t, lang, s, _ in corpus()]
    for i in range(160):  # groups of all sizes, some documents with symbols, long words, repeats
        w = words(60 + i, 3000 + i)
        w = [x + "#" * (i % 40 == 0) for x in w] if i % 2 else [x * (3 if i % 50 == 0 else 1) for x in w]
        rows.append((1000 + i, " ".join(w), "en" if i % 3 else "de", "abc"[i % 7 % 3]))
    df = spark.createDataFrame([(d, t, lang, s, 0) for d, t, lang, s in rows], SCHEMA)
    kept = {r["doc_id"]: r["q_kept"] for r in quality.quality_verdicts(df).collect()}
    assert kept == brute_kept(rows)
    assert 20 < sum(kept.values()) < len(kept) and all(not kept[1000 + i] for i in range(0, 160, 50))


def test_small_groups_lean_on_the_language_and_the_corpus(spark):
    rows = [(i, " ".join(words(80, i)), "en", "big", 0) for i in range(120)] + [(500, " ".join(f"{w} ###" for w in words(60, 999)), "en", "tiny", 0), (501, " ".join(words(70, 998)), "xx", "tiny", 0)]
    kept = {r["doc_id"]: r["q_kept"] for r in quality.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not kept[500] and kept[501] and sum(kept.values()) == 121


# Fingerprints


def test_fingerprints(docs, awkward, empty):
    rows = {r["doc_id"]: r for r in syncmers.fingerprints(docs).collect()}
    table = sorted(((d, t or "") for d, t, *_ in corpus()), reverse=True)
    for i, (d, text) in enumerate(table):
        follow = table[(i + 1) % len(table)][1]
        third = len(text) // 3
        changed = text[: len(text) - third] + follow[:third]
        r = rows[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == syncmers.as_string(syncmers.anchors(text)) and r["edited_fingerprint"] == syncmers.as_string(syncmers.anchors(changed))
        assert r["near_next"] == syncmers.likeness(syncmers.anchors(text), syncmers.anchors(follow))
    assert rows[4]["fingerprint"] == rows[5]["fingerprint"] and rows[5]["near_next"] == 1
    assert 0.55 < rows[100]["near_edited"] < 0.8
    assert 0.55 < rows[14]["near_edited"] < 0.85 and rows[14]["near_next"] < 0.05
    assert syncmers.fingerprints(awkward).count() == awkward.count() and syncmers.fingerprints(empty).count() == 0


def test_likeness_is_the_longest_chain_by_rank():
    """Against the plain table of longest common subsequences of (hash, rank) pairs."""
    r = random.Random(8)
    for _ in range(300):
        a, b = ([r.randrange(1, 7) for _ in range(r.randrange(0, 12))] for _ in range(2))
        x, y = ([(v, s[:i].count(v)) for i, v in enumerate(s)] for s in (a, b))
        best = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, j in np.ndindex(len(x), len(y)):
            best[i + 1, j + 1] = best[i, j] + 1 if x[i] == y[j] else max(best[i, j + 1], best[i + 1, j])
        wanted = 2 * best[-1, -1] / (len(a) + len(b)) if a or b else 1.0
        found = syncmers.likeness(*[(np.arange(len(s), dtype=np.uint32), np.array(s, np.uint32)) for s in (a, b)])
        assert found == pytest.approx(wanted)
    assert syncmers.likeness((np.arange(3), np.array([1, 2, 1], np.uint32)), (np.arange(2), np.array([2, 1], np.uint32))) == 0.4


def test_only_empty_texts_have_no_anchor():
    texts = [" ".join(words(20, 4000 + i))[:n] for i in range(20) for n in range(syncmers.K, 56)]
    found = [syncmers.anchors(t) for t in texts]
    assert all(len(at) and at.max() <= len(t) - syncmers.K for (at, _), t in zip(found, texts))
    alike = [syncmers.likeness(found[i], found[i + 24]) for i in range(len(texts) - 24)]  # another text of the same length
    assert max(alike) == 0 and len(syncmers.anchors("")[0]) == 0


def test_anchors_are_closed_syncmers():
    text = " ".join(words(60, 8))
    at, _ = syncmers.anchors(text)
    k, s = syncmers.K, syncmers.S
    assert len(syncmers.anchors("!" * 5 + text)[0]) >= len(at)
    inner, _ = syncmers.anchors(text[3:])
    assert set((inner + 3).tolist()) == {x for x in at.tolist() if x >= 3}  # free of context
    assert all(0 <= x <= len(text) - k for x in at) and s < k
    p = syncmers.from_string(syncmers.as_string(syncmers.anchors(text)))
    assert (p[0] == at).all()


def naive_syncmers(text):
    """The places of closed syncmers, one run at a time."""
    from tidemark.llm.hashing import BASE, mix

    points, k, s = [ord(c) + 1 for c in text], syncmers.K, syncmers.S
    inner = [int(mix(np.array([sum(p * BASE ** (s - 1 - j) for j, p in enumerate(points[i : i + s])) % 2**64], np.uint64))[0]) for i in range(len(points) - s + 1)]
    out = []
    for i in range(len(points) - k + 1):
        window = inner[i : i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            out.append(i)
    return out


def test_anchors_equal_naive_syncmers():
    for text in (" ".join(words(60, 8)), "ab" * 60, "x" * 40, "ünï çödé 漢字 🙂 " * 9, " ".join(words(300, 77, 5))):
        assert syncmers.anchors(text)[0].tolist() == naive_syncmers(text)


def test_neighbours_of_rows_without_or_with_one_doc_id(spark):
    """Each row is compared with the next by descending id, null ids last in an order of their own, whatever the slices."""
    texts = [" ".join(words(20, 500 + i, 5000)) for i in range(90)]
    rows = [(i % 40 if i < 60 else None, t) for i, t in enumerate(texts)] + [(None, texts[70]), (3, texts[3])]
    got = syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    follow = Counter()
    for r in got:
        base = [t for d, t in rows if d == r["doc_id"] and syncmers.as_string(syncmers.anchors(t)) == r["fingerprint"]]
        assert base
        after = [t for t in texts if hashlib.sha256((base[0][: len(base[0]) - len(base[0]) // 3] + t[: len(base[0]) // 3]).encode()).hexdigest() == r["edited_sha256"]]
        assert len(after) == 1
        follow[after[0]] += 1
    assert follow == Counter(t for _, t in rows)  # every row follows one other


# Lines


def one_apart(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def units(line):
    """Words, or characters where they take more than two bytes each."""
    return re.findall(r"[^\x20\x09-\x0D]", line) if len(line.encode()) > 2 * len(line) else WORD.findall(line)


def brute_lines(rows, fuzzy_units=lines.FUZZY_UNITS):
    first, kept = [], {d: [] for d, _ in rows}
    for d, text in sorted(rows):
        for i, line in enumerate((text or "").split("\n")):
            u = units(line)
            if u:
                if not any(u == v or (min(len(u), len(v)) >= fuzzy_units and one_apart(u, v)) for v in first):
                    kept[d].append((i, line))
                if u not in first:
                    first.append(u)
    return kept


def test_line_dedup_equals_all_pairs(spark, awkward, empty):
    r = random.Random(11)
    base = [words(r.randint(5, 16), 700 + i, 12) for i in range(25)]
    rows = []
    for d in range(60):
        out = []
        for _ in range(r.randint(0, 5)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                i = r.randrange(len(w))
                w[i : i + r.choice([0, 1])] = r.choice([[], [f"new{r.randrange(9)}"], [w[i]]])
            out.append(r.choice(["", " "]) + r.choice([" ", "  "]).join(w))
            if r.random() < 0.2:
                out.append(r.choice(["", "short one", "   ", "short  one\t", "one", "第一章 世界の始まりと終わりについて", "第二章 世界の始まりと終わりについて", "短い"]))
        rows.append((d, "\n".join(out)))
    got = {x["doc_id"]: x for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = brute_lines(rows)
    for d, text in rows:
        n = sum(bool(WORD.search(x)) for x in text.split("\n"))
        assert (got[d]["ld_n_lines"], got[d]["ld_n_kept"]) == (n, len(wanted[d])), d
        assert got[d]["text"] == (text if n == len(wanted[d]) else "\n".join(x for _, x in wanted[d]))
    few = {x["doc_id"]: x["ld_n_kept"] for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    assert few == {d: len(x) for d, x in brute_lines(rows, 3).items()}
    assert lines.dedup_lines(empty).count() == 0


def test_lines_of_rows_without_or_with_one_doc_id(spark, awkward):
    """Rows that repeat doc_id and text get one result; null ids come last."""
    a, b, c = (" ".join(words(15, 900 + i, 5000)) for i in range(3))
    rows = [(5, a + "\n" + b), (5, a + "\n" + b), (5, b + "\n" + c), (None, a), (None, c + "\nnew"), (None, None), (-3, b)]
    got = sorted(((x["doc_id"], x["text"], x["ld_n_lines"], x["ld_n_kept"]) for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    fives = [x for x in got if x[0] == 5]
    assert {(x[2], x[3]) for x in fives if x[1] == a} == {(2, 1)} and len([x for x in fives if x[1] == a]) == 2  # b stands in document -3
    assert [x[1:] for x in fives if x[1] != a] == [(c, 2, 1)]
    assert [x[1:] for x in got if x[0] == -3] == [(b, 1, 1)]
    assert sorted(((x[1:]) for x in got if x[0] is None), key=str) == sorted([("", 1, 0), ("new", 2, 1), (None, 0, 0)], key=str)
    rows = awkward.collect()
    found = lines.dedup_lines(awkward).collect()
    assert len(found) == len(rows) and set(found[0].asDict()) == {c for c in awkward.columns if not c.startswith("ld_")} | {"ld_n_lines", "ld_n_kept"}
    by = {}
    for x in found:
        by.setdefault(x["doc_id"], set()).add((x["ld_n_lines"], x["ld_n_kept"]))
    wanted = brute_lines([(d, t) for d, t, *_ in corpus()])
    assert all(by[d] == {(sum(bool(units(x)) for x in (t or "").split("\n")), len(wanted[d]))} for d, t, *_ in corpus())


def test_a_line_of_50_000_words(spark):
    long = [f"w{i}" for i in range(50_000)]
    other = [*long[:777], "x", *long[777:]]
    df = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[1:-1]))], "doc_id long, text string")
    assert {x["doc_id"]: x["ld_n_kept"] for x in lines.dedup_lines(df).collect()} == {1: 1, 2: 0, 3: 1}


def test_lines_of_the_corpus(docs):
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert got[1]["text"] is None and got[4]["ld_n_kept"] == 1 and got[5]["ld_n_kept"] == 0 and got[6]["ld_n_kept"] == 0
    assert got[7]["ld_n_kept"] == 2 and got[8]["ld_n_kept"] == 1 and got[13]["ld_n_kept"] == 1


# Near duplicates


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute_classes(rows):
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {d: bag(t) for d, t in rows}
    ids = sorted(parent)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = sum((bags[a] & bags[b]).values())
            if both and both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_near_classes_equal_all_pairs(spark, docs, awkward, empty):
    r = random.Random(21)
    rows = [(d, t) for d, t, *_ in corpus()]
    base = words(200, 31, 5000)
    w = list(base)
    for i in range(40):  # a chain: neighbours are near, the ends are not
        w[r.randrange(200)] = f"edit{i}"
        rows.append((1000 + i, " ".join(w)))
    for i in range(30):  # copies of one text with their own edits
        v = list(base)
        for _ in range(r.randint(1, 6)):
            v[r.randrange(200)] = f"own{i}"
        rows.append((2000 + i, " ".join(v)))
    rows += [(3000 + i, "short text") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in near.near_classes(df).collect()} == brute_classes(rows)
    assert near.near_classes(awkward).count() == awkward.count() and near.near_classes(empty).count() == 0
    kept = {x["doc_id"] for x in near.dedup_near(df).collect()}
    assert kept == set(brute_classes(rows).values())


def test_rows_without_or_with_one_doc_id_are_classed_by_text(spark):
    a, b, c, d, e = (" ".join(words(80, 700 + i, 5000)) for i in range(5))
    near_e = e + " more"
    rows = [(1, a), (2, b), (None, a), (None, b), (None, c), (None, c + " more"), (7, d), (7, e), (8, near_e), (None, "\n"), (None, "\n"), (9, " "), (9, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    kept = sorted(((x["doc_id"], x["text"]) for x in near.dedup_near(df).collect()), key=order)
    assert [k for k in kept if k[1] not in (c, c + " more")] == sorted([(1, a), (2, b), (7, d), (7, e), (9, " "), (None, "\n"), (None, "\n")], key=order)
    assert sum(k[1] in (c, c + " more") for k in kept) == 1
    classes = Counter((x["doc_id"], x["class_id"]) for x in near.near_classes(df).collect())
    assert classes == Counter([(1, 1), (2, 2), (None, 1), (None, 2), (None, None), (None, None), (7, 7), (7, 7), (8, 7), (None, None), (None, None), (9, 9), (9, 9)])


def test_signatures_estimate_the_weighted_similarity():
    a = ("a b c d e f g h i j " * 3 + " ".join(f"w{i}" for i in range(300))).encode()
    b = ("a b c d e f g h i j " * 2 + " ".join(f"w{i}" for i in range(270))).encode()
    s = near.signatures([a, b], 6000)
    x, y = bag(a.decode()), bag(b.decode())
    true = sum((x & y).values()) / sum((x | y).values())
    assert abs((s[0] == s[1]).mean() - true) < 0.03


# Pipeline


def test_pipeline(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            kept[name] = sorted(r["doc_id"] for r in docs.collect())
            docs = spark.createDataFrame(docs.collect(), SCHEMA)
    assert set(range(100, 130)) <= set(kept["quality_rules"]) and 12 not in kept["quality_rules"] and 1 not in kept["quality_rules"]
    assert 4 in kept["line_dedup"] and 5 not in kept["line_dedup"]
    assert set(kept["mixing"]) <= set(kept["near_dedup"])
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"]) for r in final) == sorted((r["doc_id"], r["piece"]) for r in docs.collect())
    check_packing(final)


@pytest.mark.parametrize("known", ["none", "some", "all"])
def test_mixing_with_null_ids_in_many_splits(spark, monkeypatch, known):
    rows = [(None if known == "none" or known == "some" and i % 3 else i // 2, "w " * (i % 4), "ab"[i % 5 == 0]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = lambda: sorted(((r["doc_id"], r["text"], r["mix_copies"]) for r in mixing.mix_sources(df).collect()), key=str)
    whole = taken()
    for rows_of_split, most in ((20, 1024), (1, 7)):
        monkeypatch.setattr(mixing, "SPLIT_ROWS", rows_of_split)
        monkeypatch.setattr(mixing, "MOST_SPLITS", most)
        assert taken() == whole


def test_every_language_has_a_landmark(spark):
    """More languages than landmarks, and than a sample has rows for: none is dropped."""
    alphabet = [chr(0x4E00 + i) for i in range(5000)]
    rows = [(1000 * lang + i, "".join(alphabet[7 * lang + (i + j) % 7] for j in range(30)), f"l{lang:03d}") for lang in range(450) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {lang for d, _, lang in rows if zlib.crc32(str(d).encode()) % 5}
    assert {r["lang"] for r in langid.training_sample(df).select("lang").distinct().collect()} == learned
    got = langid.identify(df).select("lang", "li_lang").collect()
    assert np.mean([r["lang"] == r["li_lang"] for r in got if r["lang"] in learned]) > 0.95


def test_common_words_are_encoded_once_however_many_others_pass(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 600)
    words, learned = packing.WordIds(packing.vocabulary()), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda new: (learned.extend(new), learn(new)))
    texts = [f"common word{i}x{i * 7} thing, common" for i in range(1280)]
    found = list(words.batch(texts))
    assert learned.count(b"common") == 1 and len(words.known) + len(words.before) <= 1200
    assert found == [np.array(x.ids, "<u4").tobytes() for x in words.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_batchs_words_are_looked_up_once_each():
    words, asked = packing.WordIds(packing.vocabulary()), []
    ids_of = words._ids_of
    words._ids_of = lambda some: (asked.extend(some), ids_of(some))[1]
    texts = [None, "", " \n", *[f"A common\tword,\x0band word{i} \x1c  ÉTÉ a.'b " for i in range(300)], "<|endoftext|> Common WORD<| <|X Word<|endoftext|>"]
    found = list(words.batch(texts))
    assert len(asked) == len(set(asked)) < 400
    assert found == [np.array(x.ids, "<u4").tobytes() for x in words.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_a_superstep_deals_its_rows_few_times(spark, monkeypatch):
    plans, write = [], packing.written
    monkeypatch.setattr(packing, "written", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), write(df, name))[1])
    pieces = spark.createDataFrame([(i, 0, 0, 2048 - 37 * (i % 55), i) for i in range(600)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    check_packing(packing.pack(packing.written(pieces, "pieces")).collect())
    dealt = {kind: max(len(re.findall(r"\bExchange ", p)) for name, p in plans if name == kind) for kind in ("placed", "gaps")}
    assert dealt["placed"] <= 4 and dealt["gaps"] <= 1
