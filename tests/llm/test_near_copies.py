"""Near copies of the pipeline against all pairs by brute force."""

import random

import numpy as np

import corpus_pipeline
from glossa.llm import near_copies
from glossa.llm.common import materialize
from glossa.llm.components import components, contracted


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_stage_removes_copies_of_five_word_similarity(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(900)}"
    texts = []
    for family in range(40):
        base = [word() for _ in range(rng.randrange(60, 200))]
        for _ in range(90 if family == 0 else 4):  # the first family is longer than a small run
            changed = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                changed[rng.randrange(len(changed))] = word()
            texts.append(" ".join(changed))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, parent = [_shingles(t) for t in texts], list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = [k for k in range(len(texts)) if root(k) == k]
    got = corpus_pipeline.simhash_near_dedup_stage(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == want


def test_contracted_components_are_the_others(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(60)] + [(100 + k, 100 + rng.randrange(40)) for k in range(40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    edges += [(a, b) for a in range(500, 530) for b in range(a + 1, 530)]
    table = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, contracted(table).collect())) == sorted(map(tuple, components(table).collect()))
    assert contracted(table.limit(0)).count() == 0


def test_candidates_come_from_bits_of_the_simhash():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, (400, near_copies.WORDS_OF_64), np.uint64)
    bits = np.unpackbits(base.view(np.uint8), axis=1)
    for row in bits:
        row[rng.choice(256, 39, replace=False)] ^= 1
    keys = near_copies.table_keys(base, 0, near_copies.TABLES), near_copies.table_keys(np.packbits(bits, axis=1).view(np.uint64), 0, near_copies.TABLES)
    assert len(np.unique(keys[0] >> near_copies.KEY_BITS)) == near_copies.TABLES
    assert (keys[0] == keys[1]).any(1).mean() >= 0.99
    assert (near_copies.table_keys(base, 40, 48) == keys[0][:, 40:48]).all()


def test_pairs_to_compare_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    base, texts = [word() for _ in range(150)], []
    for k in range(700):  # near in SimHash to all others, similar by 0.8 to few
        changed = list(base)
        for _ in range(rng.randrange(1, 9)):
            changed[rng.randrange(len(changed))] = word()
        texts.append(" ".join(changed))
    sets = [_shingles(t) for t in texts]
    apart, compared = list(range(len(texts))), []

    def root(k):
        while apart[k] != k:
            k = apart[k]
        return k

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                apart[y] = x
    similar = near_copies._similar

    def counted(pairs, *rest):
        pairs = materialize(pairs, "counted")
        compared.extend((r.a, r.b) for r in pairs.collect())
        return similar(pairs, *rest)

    monkeypatch.setattr(near_copies, "_similar", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_copies.keep_first(docs)
    assert sorted(r.doc_id for r in got.collect()) == [k for k in range(len(texts)) if root(k) == k]
    assert len(compared) == len(set(compared)) <= 30 * len(texts)


def test_bounds_of_bitmaps_lose_no_link():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**64, int(rng.integers(1, 1500)), np.uint64)
        sets += [base, *(np.concatenate((base[: max(1, int(len(base) * rng.uniform(0.6, 1)))], rng.integers(0, 2**64, int(len(base) * rng.uniform(0, 0.3)), np.uint64))) for _ in range(4))]
    bits = np.full(len(sets), None, object)
    bits[:] = [near_copies.parity_bitmap(x) for x in sets]
    bits[::17] = None
    wide = np.array([len(x or b"") for x in bits])
    i, j = np.triu_indices(len(sets), 1)
    size = np.array([len(x) for x in sets])
    may = near_copies._within(bits, wide, size, i, j, 8)
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    links = 10 * both >= 8 * (size[i] + size[j] - both)
    known = (wide[i] > 0) & (wide[j] > 0)
    assert may[links].all() and may[~known].all() and (links & known & (wide[i] != wide[j])).any()
    assert may[known & ~links].mean() < 0.05
