import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import _text as X
from barloom.llm._spark import BitFilter, Scratch, checkpoint_dir, components
from tests.llm.common import alnum, words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB zé\n\t1-,東", max_size=30)), max_size=8), st.sampled_from([1, 10, 1 << 20]))
def test_words_are_those_of_the_pattern(texts, limit):
    seen: dict[int, str] = {}
    for table, pattern in ((X.NON_SPACE, words), (X.ALNUM, alnum)):
        got, n = [], 0
        for i, j, w in X.text_words(pa.array(texts, pa.string()), table, limit):
            assert i == n
            n = j
            for d in range(j - i):
                got.append(w.hashes[w.first[d] : w.first[d + 1]].tolist())
        assert n == len(texts)
        for t, hashes in zip(texts, got):
            own = pattern(t)
            assert len(own) == len(hashes)
            for word, h in zip(own, hashes):
                assert seen.setdefault(h, word) == word
    assert len(set(seen.values())) == len(seen)


def test_windows_and_segments():
    h = np.random.default_rng(0).integers(0, 1 << 63, 50, dtype=np.uint64)
    w = X.windows(h, 5)
    assert len(w) == 46 and w[3] == X.windows(h[3:8], 5)[0] and len(X.windows(h[:4], 5)) == 0
    s = X.segment_hashes(np.concatenate([h, h]), np.array([0, 50, 3]), np.array([10, 60, 13]))
    assert s[0] == s[1] != s[2]
    assert X.member(np.array([1, 5, 9], dtype=np.uint64), np.array([5, 6, 10], dtype=np.uint64)).tolist() == [True, False, False]


def test_slices_of_columns():
    column = pa.array(["ab", None, "cd e", ""], pa.string()).slice(1, 3)
    data, o = X.column_bytes(column)
    assert data.tobytes() == b"cd e" and o.tolist() == [0, 0, 4, 4]


@pytest.mark.parametrize("n", [0, 1, 40])
def test_components(spark, n):
    rng = np.random.default_rng(n)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (n, 2))] + [(100 + i, 101 + i) for i in range(30)] * bool(n)
    with Scratch(spark) as scratch:
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        parent[find(a)] = find(b)
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (find(a) == find(b))
    assert set(got) == {x for e in edges for x in e if e[0] != e[1]}


def test_bit_filter(spark):
    ids = spark.createDataFrame([(i * 7,) for i in range(500)] + [(None,)], "i long")
    f = BitFilter(ids)
    at = np.array([r[0] for r in ids.select(f.column("i")).collect()])
    assert BitFilter.test(f.words, at).all()
    others = spark.range(1, 4000, 7).select(f.column("id"))
    assert BitFilter.test(f.words, np.array([r[0] for r in others.collect()])).mean() < 0.2


def test_scratch_is_removed_and_the_shared_folder_is_used(spark):
    import os

    with Scratch(spark) as scratch:
        assert scratch.path.startswith(checkpoint_dir(spark))
        scratch.table(spark.range(3), "x")
        folder = scratch.path.removeprefix("file:")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)
    assert spark.sparkContext.getConf().get("spark.checkpoint.dir") in checkpoint_dir(spark)
