import random
from collections import Counter, defaultdict

import numpy as np

from auralake.llm.components import connected_components
from auralake.llm.hashing import shingle_set
from auralake.llm.jaccard_join import _block_pairs, _fold, _often, jaccard_components, parity_sketch, signatures


def brute(rows, percent=75):
    sets = [(i, set(shingle_set(t).tolist())) for i, t in rows]
    inverted, parent = defaultdict(list), {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        shared = Counter(m for h in s for m in inverted[h])
        for m, k in shared.items():
            j, t = sets[m]
            if 100 * k >= percent * (len(s) + len(t) - k):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
        for h in s:
            inverted[h].append(n)
    return {i: top(i) for i, _ in rows}, {i: len(s) for i, s in sets}


def family(seed=3, groups=12, copies=14):
    """Near copies with a share of edits around the threshold."""
    rng, rows, number = random.Random(seed), [], 0
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((3, 8, 15, 40, 120, 400)))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 14) + 1)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
            rows.append((number, " ".join(words)))
            number += 1
        rows.append((number, " ".join(base[: len(base) * 3 // 4])))
        number += 1
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = family()
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    component, sizes = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == component
    assert {r["doc_id"]: r["n_shingles"] for r in found} == sizes


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 5, 7, 15, 16, 17, 63, 64, 65, 255, 256, 300, 1100):
        for _ in range(30):
            pool = np.unique(rng.integers(0, 2**63, 3 * n + 9, dtype=np.uint64))
            rng.shuffle(pool)
            m = int(rng.integers(n, max(n + 1, n * 4 // 3 + 1)))
            same = -(-75 * (n + m) // 175)
            if same > min(n, m):
                continue
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:same], pool[n : n + m - same])))
            assert set(signatures(a, 75).tolist()) & set(signatures(b, 75).tolist()), (n, m)
            often = np.sort(rng.choice(pool, len(pool) // 3, replace=False))
            assert set(signatures(a, 75, often).tolist()) & set(signatures(b, 75, often).tolist()), (n, m)


def test_a_passage_of_many_documents_makes_no_signature(spark):
    """200 different texts share 60 words; with the frequent shingles last no signature stands for the shared passage."""
    shared = [f"s{i}" for i in range(60)]
    texts = [" ".join([f"d{n}_{i}" for i in range(150)] + shared + [f"e{n}_{i}" for i in range(60)]) for n in range(200)]
    sets = [shingle_set(t) for t in texts]
    often = np.sort(_often(sets).view(np.uint64))
    assert len(often) == 56
    plain, ordered = ([signatures(s, 75, o) for s in sets] for o in (None, often))
    assert max(Counter(g for own in plain for g in own.tolist()).values()) > 100
    assert max(Counter(g for own in ordered for g in own.tolist()).values()) == 1
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(500, texts[7] + " more"), (501, " ".join(shared))], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_components(rows).collect()}
    assert found[500] == 7 and all(found[i] == i for i in range(200)) and found[501] == 501


def test_sketch_never_exceeds_the_distance():
    rng = np.random.default_rng(1)
    for n, m in ((5, 6), (40, 50), (300, 500)):
        a, b = np.unique(rng.integers(0, 900, n).astype(np.uint64)), np.unique(rng.integers(0, 900, m).astype(np.uint64))
        x, y = (np.frombuffer(parity_sketch(s, 3), np.uint64) for s in (a, b))
        w = min(len(x), len(y))
        assert np.bitwise_count(_fold(x, w) ^ _fold(y, w)).sum() <= len(np.setxor1d(a, b))


def test_awkward_rows(awkward, empty):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(awkward).collect()}
    assert {(1, 56, 1), (2, 56, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (None, 56, None)} <= found
    assert jaccard_components(awkward).count() == awkward.count()
    assert jaccard_components(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (3, 2)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(found[i] == 0 for i in range(1, 41)) and found[101] == 100


def test_every_text_of_a_repeated_id_links(spark):
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    near = [*b[:30], "other", *b[31:]]
    rows = [(1, a), (2, a), (2, b), (3, near), (4, [f"c{i}" for i in range(60)])]
    found = jaccard_components(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]


def test_components_of_large_stars(spark):
    """Two centres with thousands of neighbours each, joined by one edge, and a chain hanging off."""
    edges = [(0, i) for i in range(1, 3000)] + [(5000, i) for i in range(5001, 8000)] + [(2999, 7999), (7000, 9000), (9000, 9001)] + [(20_000, 20_001)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in (*range(1, 3000), *range(5000, 8000), 9000, 9001)) and found[20_001] == 20_000


def test_components_of_one_group_are_not_expanded_to_pairs(spark):
    """Two halves of near copies, larger than a block: the first round proposes no more pairs than there are nodes."""
    sets = [np.sort(np.unique(np.random.default_rng(i // 500).integers(0, 2**63, 60, dtype=np.uint64))) for i in range(1000)]
    rows = [(1, 1000, i, i % 2, len(s), bytearray(parity_sketch(s, 2)), [1]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "key long, size long, node long, component long, n_shingles long, sketch binary, groups array<long>")
    found = [tuple(r) for r in _block_pairs(df, 75, nearest=True).collect()]
    assert 0 < len(found) <= 1000 and {x for p in found for x in p} == set(range(1000))
    assert all(a < b and a % 2 != b % 2 and a // 500 == b // 500 for a, b in found)
    assert _block_pairs(df, 75).count() >= 2 * 250 * 250
