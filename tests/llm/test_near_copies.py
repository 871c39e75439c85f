"""The near-duplicate stage against a brute force over five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from sparkgauge.llm import near_copies, simhash


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(rows):
    """Smallest ids of the components of links of 0.8 or more."""
    sets = {i: grams(t) for i, t in rows}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
    return {*label.values()}


def texts():
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(400)]
    passage = rng.choices(pool, k=40)
    out = []
    for n in (6, 12, 60, 60, 200):
        base = rng.choices(pool, k=n)
        out.append(base)
        for k in (1, 2, 3, 4, 8):
            part = max(1, n * k // 40)
            out += [base + rng.choices(pool, k=part), base[:-part], base[part:], rng.choices(pool, k=part) + base]
            edited = [*base]
            for at in rng.sample(range(n), min(n, k)):
                edited[at] = rng.choice(pool)
            out.append(edited)
    group = rng.choices(pool, k=120)
    for _ in range(60):  # a large group in which many pairs, also with the leader, are less alike than 0.8
        edited = [*group]
        for at in rng.sample(range(120), rng.choice((1, 2, 3, 4))):
            edited[at] = rng.choice(pool)
        out.append(edited)
    out += [passage + rng.choices(pool, k=60) for _ in range(20)] + [passage, passage, [], []]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("block", [20_000, near_copies.BLOCK])
def test_verdict_is_the_brute_force_where_all_are_candidates(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "clusters", lambda sets: sets.selectExpr("node", "size", "1L as cluster"))
    rows = texts()
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()}
    assert got == survivors(rows)


def test_stage_removes_only_true_copies_and_nearly_all(spark):
    rows = texts()
    got, want = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()}, survivors(rows)
    assert got >= want
    assert len(rows) - len(got) >= 0.95 * (len(rows) - len(want))


def test_recall_by_kind_of_copy():
    """Share of copies at or above the similarity that are candidates by themselves."""
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(3000)]

    def edited(base, share):
        return [rng.choice(pool) if rng.random() < share else w for w in base]

    kinds = {
        "replaced words": lambda b: edited(b, rng.uniform(0.002, 0.025)),
        "dropped words": lambda b: [w for w in b if rng.random() > 0.015],
        "cut at the end": lambda b: b[: int(len(b) * rng.uniform(0.81, 0.99))],
        "longer at the start": lambda b: rng.choices(pool, k=int(len(b) * rng.uniform(0.01, 0.23))) + b,
    }
    found = {}
    for kind, change in kinds.items():
        hits = []
        for _ in range(300):
            base = rng.choices(pool, k=rng.randint(60, 600))
            a, b = (near_copies.word_hashes(" ".join(x)) for x in (base, change(base)))
            if near_copies.alike(near_copies.shingles(a), near_copies.shingles(b)):
                near = ((near_copies.fingerprint(a) ^ near_copies.fingerprint(b)) & 2**64 - 1).bit_count() <= near_copies.MOST
                keys = (near_copies.bands(near_copies.shingles(x)) for x in (a, b))
                hits.append(near or bool(np.equal(*keys).any()))
        assert len(hits) > 100
        found[kind] = sum(hits) / len(hits)
    print(found)
    assert min(found.values()) >= 0.98


def test_unlike_sets_are_no_candidates():
    """Chance links no clusters: sets without a common shingle share no key, and those that are half alike rarely do."""
    rng = np.random.default_rng(2)
    keys = {k for _ in range(3000) for k in near_copies.bands(rng.integers(0, 2**63, 40).astype(np.uint64)).tolist()}
    assert len(keys) == 3000 * near_copies.BANDS
    shared = rng.integers(0, 2**63, (400, 30)).astype(np.uint64)
    halves = [[near_copies.bands(np.unique(np.concatenate((s, rng.integers(0, 2**63, 35).astype(np.uint64))))) for _ in range(2)] for s in shared]  # 30 of 100 in common
    assert sum(bool((a == b).any()) for a, b in halves) / len(halves) < 0.06


def test_rows_a_text_do_not_grow():
    """The search of fingerprints writes as many rows a text at a billion as at a hundred thousand."""
    both = np.full((64, 64), 0.25)
    np.fill_diagonal(both, 0.5)
    rows = []
    for n in (10**5, 10**7, 10**9):
        plans = [simhash.allocate(n, both * n, simhash.group_bits(n, both * n, m), near_copies.MOST) for m in range(1, near_copies.MOST + 2)]
        _, thresholds, m = min((cost, t, m) for (cost, t), m in zip(plans, range(1, near_copies.MOST + 2)))
        rows.append(sum(simhash.variants(64 // m, (t + 1) // 2) for t in thresholds if t >= 0))
    print(rows)
    assert max(rows) <= 80


def test_rows_that_share_an_id_are_judged_each(spark):
    a, b, c = (" ".join(random.Random(k).choices([f"w{i}" for i in range(500)], k=80)) for k in range(3))
    rows = [(1, a), (1, b), (1, b), (2, b), (2, c), (None, a), (None, a)]
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()), key=str)
    assert got == sorted([(1, a), (1, b), (2, c), (None, a), (None, a)], key=str)
