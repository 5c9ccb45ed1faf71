"""Links of short sets and of tiles: nothing is lost where registers are few."""

import random

import numpy as np

from rankforge.llm import near_dedup
from rankforge.llm.components import HELD, _forest, _join_batches


def test_short_sets_always_meet():
    """100,000 pairs at a similarity of exactly 0.75 and more share a bucket and go to the full sets."""
    rng = np.random.default_rng(3)
    for _ in range(100_000):
        n = int(rng.integers(3, 9))
        own = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        more = own if n < 3 else np.concatenate([own, rng.integers(0, 2**63, n // 3, dtype=np.uint64)])
        a, b = np.unique(own), np.unique(more)
        if 100 * len(a) < 75 * len(b):
            continue
        assert set(near_dedup.least_hashes(a, 75)) & set(near_dedup.least_hashes(b, 75))
    x, y = (near_dedup.compress(*near_dedup.registers(s))[None] for s in (a, b))
    assert near_dedup.may_link(x, y * 0, np.array([len(a)]), np.array([len(b)]), 75)[0]


def test_seven_and_eight_words_link(spark):
    rng = random.Random(2)
    rows = []
    for i in range(5_000):
        words = [f"w{rng.randrange(10**9)}" for _ in range(8)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:7]))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got) and len(got) == 10_000


def test_group_with_a_common_component_and_strays(spark, monkeypatch):
    """Many near copies of one text and some of another that share its lines, over several tiles."""
    monkeypatch.setattr(near_dedup, "TILE_ROWS", 8)
    rng = random.Random(5)
    base, rows = [f"a{i}" for i in range(200)], []
    for i in range(120):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    for i in range(120, 150):
        # 0.6 to 0.9 of the base text: links by chain or not at all
        words = base[: rng.randint(130, 190)] + [f"y{i}-{j}" for j in range(20)]
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    assert got == label


def test_forest_of_a_task():
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    a, b = (np.array(x) for x in zip(*edges))
    node, root = _forest(a, b)
    label = {i: i for i in range(300)}
    for x, y in edges:
        low, high = sorted((label[x], label[y]))
        label = {i: low if v == high else v for i, v in label.items()}
    assert dict(zip(node.tolist(), root.tolist())) == {i: v for i, v in label.items() if i != v}
    assert HELD > 0 and list(_join_batches([])) == []
