"""op11, op12 and op13 against brute force, and their odd inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import _text as X
from barloom.llm import divergence, lloyd, tokenfile
from tests.llm.common import documents

# op11


def brute_audit(rows, least, top):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        in_docs = Counter(t for _, _, w in mine for t in set(w))
        kept = {t for t, n in in_docs.items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, w in mine:
            counts[source].update(t for t in w if t in kept)
        whole = sum(counts.values(), Counter())

        def share(count, term):
            return 1 + 1_000_000_000 * (count[term] + 2) // (sum(count.values()) + 2 * len(kept))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for source in counts:
            pair = [(-sum(f(share(counts[source], t), share(counts[other], t)) for t in kept), other) for other in counts if other != source]
            terms = [(-f(share(counts[source], t), share(whole, t)), t) for t in kept if counts[source][t] and share(counts[source], t) > share(whole, t)]
            for part, found, most in (("pair", pair, None), ("term", terms, top)):
                out += [(lang, source, part, item, -v, r) for r, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


@pytest.fixture
def mixed_rows():
    rng = np.random.default_rng(5)
    words = [f"{w}{chr(97 + k % 26)}" for k, w in enumerate(["Alpha", "beta", "GAMMA", "été", "東京", "delta", "eps", "Zeta", "eta"] * 4)]
    rows = [(i, " ".join(rng.choice(words[i % 5 * 3 :], size=rng.integers(0, 30))), ("en", "de", None)[i % 3], ("a", "b", "c", None, "É")[int(rng.integers(0, 5))]) for i in range(120)]
    return rows + [(1000, None, "fr", "a"), (1001, "", "fr", "b"), (1002, "12 34 !!", "fr", None), (1003, "alone", "it", "a"), (5, rows[5][1], "en", "a"), (5, rows[5][1], "en", "a")]


@pytest.mark.parametrize(("least", "top"), [(10, 10), (1, 3), (200, 10)])
def test_audit_equals_brute_force(spark, mixed_rows, least, top):
    found = divergence.audit(spark, documents(spark, mixed_rows), least, top).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found) == brute_audit(mixed_rows, least, top)


def test_audit_of_nothing_and_of_large_chunks(spark, mixed_rows, monkeypatch):
    assert divergence.audit(spark, documents(spark, [])).count() == 0
    monkeypatch.setattr(divergence, "_CHUNK", 3)
    monkeypatch.setattr(X, "CHUNK_BYTES", 40)
    assert sorted(map(tuple, divergence.audit(spark, documents(spark, mixed_rows), 1, 3).collect())) == brute_audit(mixed_rows, 1, 3)


def test_shares_of_very_large_counts_are_exact(spark):
    n, total = 3 * 10**13, 7 * 10**13 + 1
    assert spark.range(1).selectExpr(f"{n}L AS n", f"{total}L AS total").select(divergence.share("n", "total")).first()[0] == 1 + 10**9 * (n + 2) // total


# op12


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenfile.vocabulary().decode())


def plain(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


TEXTS = [
    (7, "It's A test,  of\tWORDS here 1234   end", "en", "a"),
    (-3, "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "en", "a"),
    (2, None, "en", "a"),
    (3, "", "en", "a"),
    (None, "late ́ mark é \U0001f600 東京", "en", "a"),
    (4, "\x00\x1c\x85 　xİ ΑΣ ΑΣ. \r\n", "en", "a"),
    (4, "twice", "en", "a"),
    (4, "twice", "en", "a"),
    (9, " ".join(f"wort{i % 997}x{i % 13}" for i in range(30_000)), "en", "a"),
    (10, "short tail", "en", "a"),
]


def test_files_hold_what_the_library_gives(spark, tmp_path, library):
    path = str(tmp_path / "ids")
    tokenfile.write_ids(spark, documents(spark, TEXTS), path, block=64, every=8)
    rows = sorted(tokenfile.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [-3, 2, 3, 4, 4, 4, 7, 9, 10, None]
    expected = defaultdict(list)
    for doc, text, *_ in TEXTS:
        expected[doc].append(plain(library, text))
    got, start = defaultdict(list), 0
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert r["start"] == start and r["n_tokens"] == len(ids)
        start += len(ids)
        got[r["doc_id"]].append(ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    crc = {(r["start"], r["ids_crc32"]) for r in tokenfile.digests(spark, path).collect()}
    assert crc == {(r["start"], zlib.crc32(bytes(r["ids"]))) for r in rows}
    # a range of positions, from checkpoints
    flat = [i for r in rows for i in np.frombuffer(r["ids"], dtype="<u4").tolist()]
    for a, b in ((0, 5), (17, 1000), (len(flat) - 3, len(flat) + 9), (5, 5), (len(flat), len(flat) + 1)):
        pieces = sorted((r["position"], np.frombuffer(r["ids"], dtype="<u4").tolist()) for r in tokenfile.read_range(spark, path, a, b).collect())
        assert [i for _, p in pieces for i in p] == flat[a:b]


def test_round_trip_query_of_odd_tables(spark, library):
    found = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.round_trip(spark, documents(spark, TEXTS)).collect()}
    assert found == {(d, len(i), zlib.crc32(np.array(i, dtype="<u4").tobytes())) for d, i in ((d, plain(library, t)) for d, t, *_ in TEXTS)}
    assert tokenfile.round_trip(spark, documents(spark, [])).count() == 0
    assert [tuple(r) for r in tokenfile.round_trip(spark, documents(spark, [(1, None, "en", "a")])).collect()] == [(1, 0, 1, zlib.crc32(b"\x02\0\0\0"))]


def best_cost(counts, max_bits):
    """The least number of bits of any prefix code of limited length: all length profiles by dynamic programming over used leaves."""
    counts = sorted(counts, reverse=True)
    best = {(0, 1): 0}  # (coded, open nodes at this depth)
    answer = None
    for depth in range(max_bits + 1):
        nxt = {}
        for (coded, room), cost in best.items():
            for take in range(min(room, len(counts) - coded) + 1):
                c = cost + depth * sum(counts[coded : coded + take])
                if coded + take == len(counts):
                    answer = c if answer is None else min(answer, c)
                elif room - take:
                    state = (coded + take, min(2 * (room - take), len(counts)))
                    nxt[state] = min(nxt.get(state, c), c)
        best = nxt
    return answer


@pytest.mark.parametrize("max_bits", [3, 4, 7, 20])
def test_lengths_are_the_shortest_of_limited_length(max_bits):
    rng = np.random.default_rng(max_bits)
    for n in (2, 3, 5, 8):
        counts = (rng.pareto(0.5, n) * 10).astype(np.int64) + 1
        lengths = tokenfile.code_lengths(counts, max_bits)
        assert lengths.max() <= max_bits and (0.5**lengths).sum() <= 1
        assert int((counts * lengths).sum()) == best_cost(counts.tolist(), max_bits)


def test_code_is_canonical_and_free_of_prefixes():
    ids, counts = np.array([9, 4, 100, 7, 3]), np.array([50, 20, 20, 5, 5])
    code = tokenfile.Code(ids, tokenfile.code_lengths(counts))
    words = [f"{w:0{n}b}" for w, n in zip(code.words.tolist(), code.lengths.tolist())]
    assert words == sorted(words) and all(not b.startswith(a) for a in words for b in words if a != b)
    assert [(n, i) for n, i in zip(code.lengths.tolist(), code.ids.tolist())] == sorted(zip(code.lengths.tolist(), code.ids.tolist()))
    seen = ids[np.random.default_rng(0).integers(0, 5, 5000)]
    bits, offsets = code.encode(seen, 64)
    plain_bits = "".join(words[code.ids.tolist().index(i)] for i in seen.tolist())
    assert "".join(f"{b:08b}" for b in bits.tolist())[: len(plain_bits)] == plain_bits and len(offsets) == -(-5000 // 64)
    assert (tokenfile.decode(code, [tokenfile.Block(tokenfile.pack(code, [1], [seen], 64))])[0] == seen).all()


def test_damaged_files_are_reported():
    code = tokenfile.Code(np.arange(4), np.array([1, 2, 3, 3]))
    data = bytearray(tokenfile.pack(code, [1], [np.tile(np.arange(4), 100)], 16))
    data[-30] ^= 255
    with pytest.raises(ValueError, match="checkpoint"):
        tokenfile.decode(code, [tokenfile.Block(bytes(data))])


# op13


def brute_lloyd(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1]).tobytes()))[:k]
    centroids = [v for _, v in first]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[place(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if groups[n] else c for n, c in enumerate(centroids)]
    return sorted(((i, place(v)[1], place(v)[0]) for i, v in kept), key=repr), centroids


VECTORS = "vec_id long, embedding array<double>, cluster string, distance int, v string, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y", 2) for i, v in rows], VECTORS).repartition(3)


def test_lloyd_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).round(2).tolist()) for i in range(60)]
    rows += [(100 + i, [0.5] * 64) for i in range(30)]  # copies: centroids that coincide and stay empty
    rows += [(7, rows[7][1]), (8, [0.25] * 64), (None, [0.125] * 64), (None, [0.125] * 64)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [None, *[1.0] * 63]), (204, [float("nan"), *[1.0] * 63]), (205, [float("inf"), *[1.0] * 63]), (206, [1.0] * 65)]
    placed, centroids = lloyd.lloyd(spark, vectors(spark, rows), k=9, rounds=5)
    found = placed.collect()
    expected, means = brute_lloyd(rows, 9, 5)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found), key=repr) == expected
    assert centroids.tolist() == means
    whole = sum(r["distance"] for r in found)
    by = Counter()
    for r in found:
        by[r["cluster"]] += r["distance"]
    assert all(r["inertia"] == whole and r["cluster_inertia"] == by[r["cluster"]] for r in found)


def test_lloyd_of_few_and_of_no_vectors(spark):
    few = [(3, [0.1] * 64), (1, [-0.1] * 64), (9, [float(2**20)] * 64)]
    placed, centroids = lloyd.lloyd(spark, vectors(spark, few))
    assert len(centroids) == 2 and sorted(r["distance"] for r in placed.collect()) == [0, 0]
    placed, centroids = lloyd.lloyd(spark, vectors(spark, [(1, None)]))
    assert placed.count() == 0 and len(centroids) == 0
    assert lloyd.centroid_digests(spark, centroids).count() == 0


def test_ties_go_to_the_lowest_number():
    cluster, distance = lloyd.nearest(np.array([[0, 0], [5, 0]]), np.array([[1, 0], [-1, 0], [9, 0]]))
    assert cluster.tolist() == [0, 0] and distance.tolist() == [1, 16]
