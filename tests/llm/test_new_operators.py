"""Importance resampling, vector codes and nearest vectors: brute force, hand cases, missing and odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.llm import codes, importance, neighbours

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("mine")).withColumn("weight", F.lit(1))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text, most):
    words = WORD.findall(lowered(text))
    return [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, percent, least, most):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000

    s, t = [0] * 10_000, [0] * 10_000
    for _, text in rows:
        for f in features(text, most):
            s[bucket(f)] += 1
    for text in target:
        for f in features(text, most):
            t[bucket(f)] += 1
    top, low = sum(s) + 10_000, sum(t) + 10_000
    gain = [math.floor(1000 * math.log((b + 1) * top / ((a + 1) * low))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        found = features(text, most)
        weight = sum(gain[bucket(f)] for f in found)
        key = "null" if i is None else str(i)
        h = int(hashlib.sha256(f"2024:{key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, len(WORD.findall(lowered(text))) >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = {id(r): n for n, r in enumerate(order[: percent * len(order) // 100], 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=repr)


def texts(n):
    rng = random.Random(4)
    vocabulary = ["Ärger", "ÉCOLE", "x_y", "a-b", "12", "Data", "tree", "naïve", "日本 語", "KK", "\x00", "end."] + [f"w{i}" for i in range(300)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 3])
def test_resample_matches_brute_force(spark, monkeypatch, most):
    rows = list(enumerate(texts(300)))
    rows += [(301, None), (302, ""), (303, " \n "), (None, rows[3][1]), (5, rows[5][1]), (5, rows[6][1]), (304, "word " * 40_000 + "z" * 90_000)]
    target = [*texts(40)[20:], None, "unseen words only here"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(documents(spark, rows).repartition(5), bench, 10, 20, most, range_rows=7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(rows, target, 10, 20, most)


def test_resample_of_empty_tables(spark):
    none = documents(spark, []).where("false")
    bench = spark.createDataFrame([], "text string")
    assert importance.resample(none, bench).count() == 0
    rows = list(enumerate(texts(60)))
    got = importance.resample(documents(spark, rows), bench)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(rows, [], 10, 20, 1)


def test_pieces_end_between_words():
    text = "ab cd,ef " * 50 + "z" * 100 + " end"
    parts = list(importance.pieces(text, 16))
    assert "".join(parts) == text and [w for p in parts for w in WORD.findall(p)] == WORD.findall(text)


def vectors(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.withColumn("code", F.lit("mine")).withColumn("id", F.lit(1)).withColumn("vector", F.lit("x"))


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    size = max((len(r[1]) for r in kept), default=0)
    size = -(-size // parts) * parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(float(x) * 1024) if abs(x) < 1e15 else int(x) * 1024 for x in r[1]] + [0] * (size - len(r[1])) for r in kept]
    w = size // parts
    cut = [[q[p * w : (p + 1) * w] for p in range(parts)] for q in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            d = [[sum((a - b) ** 2 for a, b in zip(c[p], e)) for e in books[p]] for p in range(parts)]
            out.append([(min(x), x.index(min(x))) for x in d])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    return sorted(
        (
            (
                r[0],
                "".join(f"{e:02x}" for _, e in f),
                err if err < 1 << 63 else None,
                total if (total := sum(x for x, s in zip(errors, kept) if s[2] == r[2])) < 1 << 63 else None,
                digest,
            )
            for r, f, err in zip(kept, found, errors)
        ),
        key=repr,
    )


def random_vectors(n, size, scale=1.0, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, size))
    x = (centres[rng.integers(0, 6, n)] + 0.3 * rng.standard_normal((n, size))) * scale
    return [(int(i), [float(np.float32(v)) for v in r], int(i) % 5 or None) for i, r in enumerate(x)]


@pytest.mark.parametrize("size, scale", [(16, 1.0), (20, 1.0), (12, 3e4)])
def test_codes_match_brute_force(spark, size, scale):
    rows = random_vectors(120, size, scale)
    rows += [(200, None, 1), (201, [1.0, None], 1), (202, [math.nan] * size, 1), (203, [math.inf] * size, 1)]
    rows += [(None, rows[3][1], None), (7, rows[9][1], 2), (7, rows[9][1], 2), (204, [], 3), (205, rows[8][1][:-3], 3)]
    got = codes.compress(vectors(spark, rows).repartition(3), entries=16)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_codes(rows, entries=16)


def test_codes_of_few_huge_and_no_vectors(spark):
    huge = [(i, [float(s) * 1e19, 1.0, -2.5, 7e30 * s], 1) for i, s in enumerate((1, -1, 3))]
    got = codes.compress(vectors(spark, huge, "double"), entries=2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_codes(huge, entries=2)
    assert codes.compress(vectors(spark, [(1, None, 1)])).collect() == []


def test_transform_keeps_distances_and_elimination_keeps_ties():
    rng = np.random.default_rng(2)
    assert codes.sequency(8).tolist() == [0, 4, 6, 2, 3, 7, 5, 1]
    x, e = rng.integers(-9, 9, (400, 11)), rng.integers(-9, 9, (30, 11))
    e[17] = e[4]
    d = ((x[:, None] - e[None]) ** 2).sum(2)
    at, far = codes.nearest(codes.transform(x), codes.transform(e))
    assert (at == d.argmin(1)).all() and (far == d.min(1)).all() and 17 not in at


def brute_nearest(rows, k, every):
    size = max(len(v) for _, v, _ in rows if v)
    kept = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            kept[i] = np.array([*v, *[0.0] * (size - len(v))])
    out = {}
    for i, q in kept.items():
        if i % every == 0:
            scored = sorted((-float((q * x).sum()), j) for j, x in kept.items() if j != i)
            out[i] = scored[:k]
    return out


def test_nearest_of_few_rows_is_complete(spark):
    rows = random_vectors(60, 12)
    rows += [(100, None, 1), (120, [0.0] * 12, 1), (140, [math.nan] * 12, 1), (None, rows[1][1], 1), (160, [1.0, None], 1)]
    rows += [(180, rows[0][1][:-4], 1), (181, rows[7][1], 1), (7, rows[7][1], 1), (200, rows[7][1], 1), (240, [], 1)]
    got = neighbours.nearest(vectors(spark, rows).repartition(4))
    want = brute_nearest(rows, 20, 20)
    have = {}
    for r in got.collect():
        have.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(have) == set(want)
    for i, found in have.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and [f[1] for f in found] == [j for _, j in want[i]]
        assert all(abs(f[2] + s) < 1e-9 for f, (s, _) in zip(found, want[i]))


def test_nearest_of_almost_no_rows(spark):
    assert neighbours.nearest(vectors(spark, [(0, None, 1)])).collect() == []
    assert neighbours.nearest(vectors(spark, [(0, [1.0, 2.0], 1)])).collect() == []
    two = neighbours.nearest(vectors(spark, [(0, [1.0, 2.0], 1), (20, [-1.0, 2.0], 1)])).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in two) == [(0, 1, 20, 3.0), (20, 1, 0, 3.0)]


@pytest.mark.parametrize("spread", [0.0, 0.4])
def test_recall_with_small_blocks_and_a_hot_vector(spark, monkeypatch, spread):
    """A third of the rows hold one vector; blocks far smaller than the table leave the work to the descent."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(5)
    rows = random_vectors(1200, 16)
    scale = np.exp(spread * rng.standard_normal(len(rows)))
    rows = [(i, [float(np.float32(v * s)) for v in x], 1) for (i, x, _), s in zip(rows, scale)]
    rows = [(i, rows[1][1] if i % 3 == 1 else x, 1) for i, x, _ in rows]
    want = brute_nearest(rows, 20, 20)
    have = {}
    for r in neighbours.nearest(vectors(spark, rows)).collect():
        have.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(have) == set(want) and all(len(v) == 20 for v in have.values())
    assert np.mean([len(have[i] & {j for _, j in w}) / 20 for i, w in want.items()]) >= 0.95
