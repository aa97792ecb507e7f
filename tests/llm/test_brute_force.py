"""The classifier and the fingerprints against plain forms of their definitions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from glossa.llm import near_copies, quality_classifier as Q, syncmers as S

MASK = (1 << 64) - 1


def isotonic_by_min_max(n, hits):
    """Each bin's value is the largest over starts of the least mean over ends; equal neighbours are one pool."""
    at = np.flatnonzero(n)
    w, y = n[at], hits[at]
    value = [max(min(y[a : b + 1].sum() / w[a : b + 1].sum() for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    knots, values, i = [], [], 0
    while i < len(at):
        j = i
        while j + 1 < len(at) and abs(value[j + 1] - value[i]) < 1e-12:
            j += 1
        knots.append(Q.LOW + (at[i] + at[j] + 1) / 2 * (Q.HIGH - Q.LOW) / Q.BINS)
        values.append(value[i])
        i = j + 1
    return np.array(knots), np.array(values)


def test_classifier_equals_a_dense_fit(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["plain", "word", "$$$", "x1", "Longer,", "end."][(0 if i % 2 else 2) :]) + str(rng.randrange(30)) for _ in range(20 + rng.randrange(60))) for i in range(240)]
    labels = [int(i % 2 == 0) if rng.random() < 0.9 else int(i % 2 == 1) for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.score for r in Q.quality_scores(docs, spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")).collect()}
    x = np.array([Q.statistics_of(t.encode()) for t in texts])
    learn = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in range(240)])
    y = np.array(labels, float)[learn]
    mean, scale = x[learn].mean(0), x[learn].std(0)
    z = np.clip((x - mean) / np.where(scale > 1e-9, scale, 1), -8, 8)
    rand = np.random.default_rng(7)
    waves, phases = rand.normal(size=(x.shape[1], 256)) / 4.0, rand.uniform(0, 2 * np.pi, 256)
    f = np.hstack([np.sqrt(2 / 256) * np.cos(z @ waves + phases), np.ones((len(z), 1))])
    a = np.vstack([f[learn], np.sqrt(1e-4 * learn.sum()) * np.eye(257)])  # ridge as least squares of a taller system
    weights = np.linalg.lstsq(a, np.concatenate([y, np.zeros(257)]), rcond=None)[0]
    raw = f @ weights
    at = np.clip(((raw[learn] - Q.LOW) / (Q.HIGH - Q.LOW) * Q.BINS).astype(int), 0, Q.BINS - 1)
    knots, values = isotonic_by_min_max(np.bincount(at, minlength=Q.BINS), np.bincount(at, y, minlength=Q.BINS))
    want = np.interp(raw, knots, values)
    assert np.abs(want - [got[i] for i in range(240)]).max() < 1e-4


def mixed(x):
    x = ((x ^ (x >> 29)) * int(S._A)) & MASK
    return x ^ (x >> 32)


def plain_anchors(text):
    points = [ord(c) for c in text]
    if len(points) < S.K:
        h = len(points)
        for p in points:
            h = mixed((h * int(S._B) + p) & MASK)
        return [(0, h >> 48)] if points else []

    def small(i):
        h = points[i]
        for j in range(1, S.S):
            h = (h * int(S._B) + points[i + j]) & MASK
        return mixed(h)

    hashes = [small(i) for i in range(len(points) - S.S + 1)]
    out = []
    for i in range(len(points) - S.K + 1):
        inner = hashes[i : i + S.K - S.S + 1]
        if inner.index(min(inner)) in (0, S.K - S.S):
            h = hashes[i]
            for j in range(S.S, S.K - S.S + 1, S.S):
                h = (h * int(S._B) + hashes[i + j]) & MASK
            out.append((i, mixed(h) >> 48))
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    same = set(a) & set(b)
    rest, others = [x for x in a if x not in same], [x for x in b if x not in same]
    first = {}
    for p, h in others:
        first.setdefault(h, p)
    shifts = Counter(first[h] - p for p, h in rest if h in first)
    return min(1.0, (len(same) + sum(n for n in shifts.values() if n >= S.LEAST_SHIFTED)) / max(len(a), len(b)))


def test_fingerprints_equal_plain_ones(spark):
    rng = random.Random(8)
    base = " ".join(rng.choice(["alpha", "beta", "é", "日本", "gamma.", "x"]) for _ in range(300))
    texts = ["", "a", "elevenchars", "twelve chars", base, base[40:], base, "aaaaaaaaaaaaaaaaaaaaaaaa", None, base[:200] + "!" + base[200:], "🙂" * 30] + ["".join(rng.choice("abc ") for _ in range(rng.randrange(200))) for _ in range(25)]
    got = {r.doc_id: r for r in S.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    texts = [t or "" for t in texts]
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        cut = len(text) - len(text) // 4
        edited = text[:cut] + after[: len(text) // 4]
        r, own = got[i], plain_anchors(text)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for fingerprint, want in ((r.fingerprint, own), (r.edited_fingerprint, plain_anchors(edited))):
            at, h = S.decode(fingerprint)
            assert list(zip(at.tolist(), h.tolist())) == want
        assert r.near_edited == pytest.approx(plain_likeness(own, plain_anchors(edited))) and r.near_next == pytest.approx(plain_likeness(own, plain_anchors(after)))


def test_pigeonring_filter_keeps_every_near_pair():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**64, (400, 4), np.uint64)
    for k in range(200, 400):  # copies with up to 100 bits changed, spread or crowded
        bits = rng.choice(256 if k % 2 else 90, int(rng.integers(0, 90)), replace=False)
        words[k] = words[k - 200]
        for b in bits:
            words[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    i, j = np.triu_indices(400, 1)
    want = np.bitwise_count(words[i] ^ words[j]).sum(1) <= near_copies.MAX_BITS
    assert (near_copies._close(words, i, j) == want).all() and want.sum() > 100
