import random

import numpy as np
import pytest

from barloom.llm import jaccard as J
from tests.llm.common import ROWS, documents, roots, shingles


def expected(rows):
    texts = [t for _, t, _, _ in rows]
    sets = [shingles(t) for t in texts]
    link = lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    root = roots(list(range(len(rows))), link)
    out = []
    for k, (i, *_rest) in enumerate(rows):
        if not sets[k]:
            out.append((i, 0, i))
            continue
        ids = [rows[j][0] for j in root if root[j] == root[k] and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=str)


def run(spark, rows, **options):
    got = J.near_duplicates(spark, documents(spark, rows), **options)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str)


def test_odd_documents(spark):
    assert run(spark, ROWS) == expected(ROWS)


def test_empty_table(spark):
    assert run(spark, []) == []


def corpus(seed, n=70):
    """Groups of near copies, shared passages, short texts and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows = []
    while len(rows) < n:
        base = [word() for _ in range(rng.choice([1, 3, 6, 20, 60, 300]))]
        if rng.random() < 0.4:
            base = base[: len(base) // 3] + passage + base[len(base) // 3 :]
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w), "en", "a"))
    return rows


@pytest.mark.parametrize("seed, options, lists", [(1, {}, None), (2, dict(sample_rate=1, frequent_least=2), None), (3, dict(sample_rate=1, frequent_least=2), 2), (4, {}, 2), (5, dict(frequent_most=5, sample_rate=1, frequent_least=1), 3)])
def test_against_brute_force(spark, monkeypatch, seed, options, lists):
    """Also with frequent tokens everywhere and with every list long."""
    if lists:
        monkeypatch.setattr(J, "LONG_LIST", lists)
        monkeypatch.setattr(J, "BLOCK", 16)
    rows = corpus(seed)
    assert run(spark, rows, **options) == expected(rows)


def test_prefixes_of_linked_sets_share_a_key():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        tokens = rng.choice(1 << 62, n, replace=False).astype(np.uint64)
        drop = int(rng.integers(0, J.slack(n) + 1))
        other = np.sort(np.concatenate([tokens[drop:], rng.choice(1 << 62, int(rng.integers(0, 3)), replace=False).astype(np.uint64)]))
        tokens = np.sort(tokens)
        overlap = len(np.intersect1d(tokens, other))
        bound = J.overlap_bound(J.sketch_of(tokens), J.sketch_of(other))
        assert bound is None or bound >= overlap
        if not J.links(overlap, len(tokens), len(other)):
            continue
        share = rng.choice([0.0, 0.5, 1.0])
        often = np.sort(np.union1d(tokens, other)[rng.random(len(np.union1d(tokens, other))) < share])
        keys = [J.prefix_keys(t[~np.isin(t, often)], t[np.isin(t, often)]) for t in (tokens, other)]
        assert len(np.intersect1d(*keys))


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = J.keep_one(spark, docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str)
    assert ids == sorted([1, 4, 5, 6, 7, None, 8, 10, 12, 13, 14], key=str)


@pytest.mark.parametrize("parts", [1, 2])
def test_a_cell_gives_fewer_links_than_nodes(parts):
    """Sets that mostly share as much as the threshold asks for by their sketches, but not by their tokens, are compared in the cell itself."""
    import pyarrow as pa

    from barloom.llm import _text as X

    rng = np.random.default_rng(11)
    base = rng.choice(1 << 62, 120, replace=False).astype(np.uint64)
    sets = []
    for k in range(120):
        own = base.copy()
        at = rng.choice(120, 12 + k % 4, replace=False)
        own[at] = base[at] ^ rng.integers(1, 1 << 20, len(at)).astype(np.uint64)  # another token of the same bucket
        sets.append(np.unique(own))
    table = pa.table({
        "i": pa.array([0] * 120, pa.int32()), "j": pa.array([parts - 1] * 120, pa.int32()), "node": pa.array(range(120), pa.int64()), "comp": pa.array(range(120), pa.int64()),
        "n": pa.array([len(s) for s in sets], pa.int32()), "sketch": X.binary_array([J.sketch_of(s) for s in sets]), "salt": pa.array([k % parts for k in range(120)], pa.int32()), "tokens": X.binary_array(sets),
    })
    link = lambda x, y: (parts == 1 or x % 2 != y % 2) and J.links(len(np.intersect1d(sets[x], sets[y])), len(sets[x]), len(sets[y]))
    want = roots(list(range(120)), link)
    bounded = sum(J.links(J.overlap_bound(J.sketch_of(sets[x]), J.sketch_of(sets[y])), len(sets[x]), len(sets[y])) for x in range(120) for y in range(x))
    got = J._blocks(table).to_pylist()
    assert all(link(r["a"], r["b"]) for r in got) and bounded > 1000 and len(got) < 120
    found = {(r["a"], r["b"]) for r in got}
    assert roots(list(range(120)), lambda x, y: (min(x, y), max(x, y)) in found) == want
