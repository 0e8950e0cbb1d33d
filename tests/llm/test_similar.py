"""Near-duplicates by exact similarity against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from keyloom.llm import similar, simhash

RNG = random.Random(11)
SCHEMA = "doc_id long, text string, lang string"


def prose(n):
    return " ".join(f"w{RNG.randrange(10**5)}" for _ in range(n))


def changed(text, times):
    ws = text.split()
    for i in RNG.sample(range(len(ws)), times):
        ws[i] = f"x{RNG.randrange(10**6)}"
    return " ".join(ws)


def brute(texts):
    shingles = []
    for t in texts:
        w = (t or "").lower().split()
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            if root[i] != root[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


@pytest.fixture(scope="module")
def texts():
    base = [prose(390) for _ in range(20)] + [prose(100) for _ in range(20)]
    near = [changed(b, 4) for b in base[:20]] + [changed(b, 1) for b in base[20:]]
    limit = [changed(b, k) for b in base[:20] for k in (8, 9, 10)]
    hot, line = prose(120), prose(30)
    chain = [hot]
    for _ in range(30):
        chain.append(changed(chain[-1], 1))
    shared = [prose(60) + " " + line + " " + prose(60) for _ in range(30)] + [line, line.upper(), line + " end"]
    texts = base + near + limit + chain + shared + [None, "", " \n", "a b", "A  b", "a b c", hot, hot]
    RNG.shuffle(texts)
    return texts


@pytest.mark.parametrize("small,common", [(8, 5), (1, 10**6)])
def test_similar_matches_brute_force(spark, texts, monkeypatch, small, common):
    monkeypatch.setattr(similar, "SMALL", small)
    monkeypatch.setattr(similar, "COMMON", common)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA)
    kept = similar.drop_similar(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(brute(texts))
    assert similar.drop_similar(docs.limit(0)).count() == 0


def test_stage_drops_copies_beyond_four_bits(spark):
    base = [prose(390) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(base + [changed(b, 4) for b in base])] + [(None, base[0], "en"), (7, base[7], "de")], SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert simhash.drop_near_duplicates(docs).count() > 60


def test_prefix_loses_no_pair():
    for _ in range(2000):
        n = RNG.randint(1, 60)
        a = set(RNG.sample(range(80), n))
        b = {x for x in a if RNG.random() < 0.93} | set(RNG.sample(range(80), RNG.randint(0, 4)))
        common = np.array(sorted(RNG.sample(range(80), RNG.randint(0, 20))), np.uint64)
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if similar.jaccard(x, y) >= 0.8:
            assert set(similar.prefix(x, common, 0.8).tolist()) & set(similar.prefix(y, common, 0.8).tolist())


def test_sketches_lose_no_pair():
    far = 0
    for _ in range(1000):
        a = np.unique(np.array([RNG.getrandbits(64) for _ in range(RNG.choice((1, 4, 30, 300, 900)))], np.uint64))
        fresh = np.array([RNG.getrandbits(64) for _ in range(RNG.randint(0, 1 + len(a) // 3))], np.uint64)
        b = np.unique(np.concatenate((a[[RNG.random() < 0.93 for _ in a]], fresh)))
        able = similar.may_reach(similar.sketch(a), similar.sketch(b), len(a), len(b), 0.8)
        assert able or similar.jaccard(a, b) < 0.8
    for n in (40, 400, 4000):
        a, b = (np.array([RNG.getrandbits(64) for _ in range(n)], np.uint64) for _ in "ab")
        far += not similar.may_reach(similar.sketch(a), similar.sketch(b), n, n, 0.8)
    assert far == 3


def test_blocks_find_what_is_near(spark):
    """pairs within RADIUS bits come through blocks of the SimHash, and only they."""
    for text in (prose(90), "a b", None):
        own = similar.shingle_set(text)
        bits = [2 * sum(int(h) >> b & 1 for h in own) > len(own) for b in range(64)]
        assert similar.fingerprint(own) == sum(1 << b for b in range(64) if bits[b])
    fps = [RNG.getrandbits(64) for _ in range(100)]
    fps += [fp ^ sum(1 << b for b in RNG.sample(range(64), k)) for fp in fps[:50] for k in (0, 5, 8, 9)]
    rows = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in enumerate(fps)]
    pairs = {(r.a, r.b) for r in similar._near(spark.createDataFrame(rows, "sig long, fp long")).collect()}
    near = {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= similar.RADIUS}
    root = list(range(len(fps)))
    for i, j in pairs:
        lo, hi = sorted((root[i], root[j]))
        root = [lo if r == hi else r for r in root]
    assert pairs <= near and all(root[i] == root[j] for i, j in near)


def test_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Candidates as made, repeats included: pairs between classes a few times at most, besides some for each document."""
    base, made, arrow = prose(120), [], similar.arrow
    texts = [changed(base, RNG.choice((1, 2, 3))) for _ in range(160)]

    def counted(df, run, schema):
        out = arrow(df, run, schema)
        if schema == "a long, b long" and "s_a" not in df.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(similar, "arrow", counted)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, 100)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA)
    kept = {r.doc_id for r in similar.drop_similar(docs).collect()}
    spark.conf.unset(batch)
    root = brute(texts)
    between = sum(a != b for i, a in enumerate(root) for b in root[:i])
    assert kept == set(root) and sum(made) <= 2 * between + 20 * len(texts), (made, between)


def test_parities_lose_no_pair_and_are_tight():
    total = np.zeros(2)
    for _ in range(1000):
        a = np.unique(np.array([RNG.getrandbits(64) for _ in range(RNG.choice((1, 4, 30, 300, 3000)))], np.uint64))
        fresh = np.array([RNG.getrandbits(64) for _ in range(RNG.randint(0, 1 + len(a) // 3))], np.uint64)
        b = np.unique(np.concatenate((a[[RNG.random() < 0.93 for _ in a]], fresh)))
        differ = int(np.bitwise_count(similar.parities(a) ^ similar.parities(b)).sum())
        apart = len(np.setxor1d(a, b))
        assert differ <= apart
        total += (differ, apart) if len(a) <= 300 else 0
    assert total[0] > 0.8 * total[1]
    assert similar.parities(np.empty(0, np.uint64)).tolist() == [0] * (similar.BITS // 64)


def test_near_copies_that_just_miss_make_few_pairs(spark, monkeypatch):
    """Near copies of one text that mostly aren't linked to one another: rows are made for pairs near the similarity, not for all."""
    base, made, arrow = prose(120), [], similar.arrow
    texts = [changed(base, RNG.choice((1, 2, 3))) for _ in range(160)]

    def counted(df, run, schema):
        out = arrow(df, run, schema)
        if schema == "a long, b long" and "s_a" not in df.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(similar, "arrow", counted)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA)
    kept = {r.doc_id for r in similar.drop_similar(docs).collect()}
    root, sets = brute(texts), [similar.shingle_set(t) for t in texts]
    unlinked = [similar.jaccard(a, sets[j]) for i, a in enumerate(sets) for j in range(i) if root[i] != root[j]]
    close = sum(x >= 0.77 for x in unlinked)
    assert kept == set(root) and len(unlinked) > 20 * len(texts) > 20 * close
    # the first list holds the forests of the blocks, linear by construction
    assert sum(made[1:]) <= 2 * close + 4 * len(texts), (made, close, len(unlinked))
