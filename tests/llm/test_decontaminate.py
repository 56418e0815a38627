import hashlib
import random

import pytest

from barloom.llm import decontaminate as D
from tests.llm.common import LONG, ROWS, alnum, documents


def expected(rows, items):
    windows = {}
    for item, text in items:
        w = alnum(text)
        k = min(10, len(w))
        windows.setdefault("" if item is None else str(item), set()).update((k, tuple(w[i : i + k])) for i in range(len(w) - k + 1) if k)
    out = []
    for i, text, *_ in rows:
        w, hit, found = alnum(text), set(), set()
        for item, own in windows.items():
            for k, span in own:
                for a in range(len(w) - k + 1):
                    if tuple(w[a : a + k]) == span:
                        hit.update(range(a, a + k))
                        found.add(item)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, rows, items):
    got = D.contamination(spark, documents(spark, rows), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as h", "'x' as uid"))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()), key=str)


ITEMS = [(1, "kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi"), (2, "One, TWO"), (2, None), (None, "nobody else has written"), (5, ""), (6, "!!"), (7, "one two"), (8, "not there at all in any of the documents given")]


def test_odd_documents(spark):
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 1000] + [(20, " ".join(["one two"] * 30), None, None), (21, "x " * 400 + "nobody else has written", None, None)]
    assert run(spark, rows, ITEMS) == expected(rows, ITEMS)


def test_long_text(spark):
    tail = " ".join(LONG.split()[-14:])
    got = run(spark, [(1, LONG, None, None), (2, LONG[: len(LONG) // 2], None, None)], [(3, tail)])
    assert got[0][1:3] == (60_000, got[0][2]) and got[0][2] >= 14


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.choice([1, 1, 2])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for k in range(12)]
    rows = []
    for k in range(40):
        w = [word() for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            own = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(own))
            at = rng.randrange(len(w) + 1)
            w[at:at] = own[a : a + rng.randrange(1, 26)]
        rows.append((k, " ".join(w), None, None))
    assert run(spark, rows, items) == expected(rows, items)


@pytest.mark.parametrize("rows, items", [([], ITEMS), (ROWS[:5], []), ([], [])])
def test_empty_tables(spark, rows, items):
    assert run(spark, rows, items) == expected(rows, items)


def test_clean_documents_stay(spark):
    docs = documents(spark)
    kept = D.drop_contaminated(spark, docs, spark.createDataFrame(ITEMS[:1], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([4, 5, 6, 7, None, 8, 9, 10, 11, 12, 13, 14], key=str)
