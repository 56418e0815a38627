"""LM scoring, language ID, quality, mixing."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from barloom.llm import _text as X
from barloom.llm import langid, lm, mixing, quality
from tests.llm.common import LONG, ROWS, documents, words

VOCABULARY = {"en": "the and of house water bring tion ing".split(), "de": "der und ich wasser haus schluss ung keit".split(), "ru": "вода дом человек страна слово".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.choice([1, 1, 2]))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    return [(k, sentence(rng, lang := rng.choice(["en", "en", "de", "ru"]), rng.choice([5, 30, 80])), lang, f"s{k % 3}") for k in range(300)] + [r for r in ROWS if r[0] is None or r[0] > 4]


def crc(i, m):
    return zlib.crc32(b"" if i is None else str(i).encode()) % m


def test_lm_base_scores_and_gain(spark, corpus):
    rows = [(None if i is None else i + 1000 * (k >= 300), t, lang, s) for k, (i, t, lang, s) in enumerate(corpus)]
    for head in (200_000, 20):
        got = lm.language_model(spark, documents(spark, rows), head=head).collect()
        count = Counter()
        for i, t, *_ in rows:
            if crc(i, 10):
                count.update(words(t))
                count["\0end"] += 1
        n, v = sum(count.values()), len(count)
        want = []
        for i, t, *_ in rows:
            w = [*words(t), "\0end"]
            want.append((i, not crc(i, 10), len(w), sum(x in count for x in w), n, sum(math.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
        key = lambda r: (str(r[0]), r[2], r[5])
        have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
        for a, b in zip(have, sorted(want, key=key), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
        assert all(math.isfinite(r.score) for r in got)


def test_lm_sums_to_one_and_learns(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["aa bb", "cc dd"]) for _ in range(40)), "en", "a") for k in range(200)]
    got = [r for r in lm.language_model(spark, documents(spark, rows)).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got) * 1.0 and sum(r.score for r in got) > sum(r.base_score for r in got)


def one_text(text):
    (piece,) = X.text_words(pa.array([text]), X.NON_SPACE)
    return lm.Tokens(piece[2])


def test_lm_probabilities_by_brute_force():
    """Every digit's softmax, written out feature by feature, and its sum over all classes."""
    rng = np.random.default_rng(0)
    n = rng.integers(1, 50, lm.LEAVES).astype(float)
    model = lm.Model(int(n.sum()), 100, n, np.ones(lm.LEAVES))
    model.weights = rng.normal(0, 1, model.weights.shape).astype(np.float32)
    tokens = one_text("ein Haus am See ein Haus am Fluss")
    got, features = lm.log_digits(model, tokens), tokens.features()
    for i in range(len(tokens.hash)):
        want, total = 0.0, 1.0
        for level in range(lm.LEVELS):
            before, digit = int(tokens.before[level][i]), int(tokens.digits[level][i])
            z = [float(x) for x in model.bias[level][before]]
            for kind, r in enumerate(tokens.rows(features, level, model.buckets)):
                z = [x + float(w) for x, w in zip(z, model.weights[level, kind, r[i]])]
            want += z[digit] - math.log(sum(map(math.exp, z)))
            total *= sum(math.exp(x - math.log(sum(map(math.exp, z)))) for x in z)
        assert got[i] == pytest.approx(want, abs=1e-4) and total == pytest.approx(1)
        assert tokens.leaf[i] == sum(int(d[i]) * lm.CLASSES ** (lm.LEVELS - 1 - k) for k, d in enumerate(tokens.digits))


def test_lm_step_is_the_gradient(monkeypatch):
    """One step on a small text against finite differences of its log probability."""
    monkeypatch.setattr(lm, "RATE", 1.0)
    tokens = one_text("a b a b c a")
    model = lm.Model(60, 3, np.ones(lm.LEAVES), np.ones(lm.LEAVES))
    weights, squares = model.zeros(), model.zeros()
    lm.learn(model.bias, weights, squares, tokens)
    found = np.argwhere(squares > 1e-3)
    assert len(found)
    for at in map(tuple, found[:: max(1, len(found) // 20)]):
        sides = []
        for step in (1e-2, -1e-2):
            model.weights = model.zeros()
            model.weights[at] = step
            sides.append(lm.log_digits(model, tokens).sum())
        slope = (sides[0] - sides[1]) / 2e-2
        assert squares[at] == pytest.approx(slope**2, rel=0.02, abs=1e-3)
        assert weights[at] == pytest.approx(slope / math.sqrt(slope**2 + 1), rel=0.02, abs=1e-3)


def test_lm_tells_words_apart_by_context(spark):
    """Words that no ending tells apart, each certain from the word before it."""
    rng = random.Random(2)
    pairs = [(f"left{k}", f"right{k}end") for k in range(40)]
    rows = [(k, " ".join(w for _ in range(30) for w in rng.choice(pairs)), "en", "a") for k in range(300)]
    got = [r for r in lm.language_model(spark, documents(spark, rows)).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert gain > 0.4  # half of all tokens are certain: log10(40) / 2 = 0.8 at most


def test_lm_does_not_follow_the_cluster(spark, corpus, monkeypatch):
    """The same scores from other splits of the input and another number of shuffle partitions, with several partial models."""
    monkeypatch.setattr(lm, "PART_TOKENS", 512)
    docs, found = documents(spark, corpus), []
    for splits, shuffles in ((1, "3"), (7, "8")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        try:
            got = lm.language_model(spark, docs.repartition(splits)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        found.append(sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in got))
    assert got[0].train_tokens > 16 * 512  # more than four parts
    for a, b in zip(*found, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-5)


def test_lm_whole_scores_by_brute_force(spark, monkeypatch):
    """Scores of a small corpus, several parts: each word's digits softmax by softmax and its share in its class, added up in Python."""
    monkeypatch.setattr(lm, "MOST_PART_TOKENS", 500)
    rng = random.Random(9)
    rows = [(k, sentence(rng, "en", rng.choice([0, 1, 2, 40])), "en", "a") for k in range(160)]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in lm.language_model(spark, docs).collect()}
    training = docs.where(lm.fold(10) != 0).select("doc_id", "text")
    model = lm.train(spark, training, lm.word_counts(training))
    assert model.n > 2 * lm.MOST_PART_TOKENS
    count, leaf_of = Counter(), {}
    for i, t, *_ in rows:
        tokens = one_text(t)
        names = [*words(t), "\0end"]
        leaf_of.update(zip(names, tokens.leaf.tolist(), strict=True))
        if crc(i, 10):
            count.update(names)
    class_n, class_v = Counter(), Counter()
    for w, c in count.items():
        class_n[leaf_of[w]] += c
        class_v[leaf_of[w]] += 1
    for i, t, *_ in rows:
        tokens, want = one_text(t), 0.0
        features = tokens.features()
        for k, w in enumerate([*words(t), "\0end"]):
            for level in range(lm.LEVELS):
                z = [float(x) for x in model.bias[level][tokens.before[level][k]]]
                for kind, r in enumerate(tokens.rows(features, level, model.buckets)):
                    z = [x + float(y) for x, y in zip(z, model.weights[level, kind, r[k]])]
                want += (z[int(tokens.digits[level][k])] - math.log(sum(map(math.exp, z)))) / math.log(10)
            want += math.log10((count[w] + 0.1) / (class_n[leaf_of[w]] + 0.1 * (class_v[leaf_of[w]] + 1)))
        assert got[i].score == pytest.approx(want, rel=1e-4)


def test_lm_without_rows(spark):
    assert lm.language_model(spark, documents(spark, [])).count() == 0
    held = next(i for i in range(1000) if not crc(i, 10))
    (r,) = lm.language_model(spark, documents(spark, [(held, "a b", None, None)])).collect()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and r.base_score == pytest.approx(0.0)


def test_languages(spark, corpus):
    got = {r.doc_id: r for r in langid.languages(spark, documents(spark, corpus[:300])).collect()}
    lang = {i: x for i, _, x, _ in corpus[:300]}
    held = [i for i in got if got[i].held_out]
    assert held and np.mean([got[i].lang_pred == lang[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and all(got[i].held_out == (crc(i, 5) == 0) for i in got)
    odd = langid.languages(spark, documents(spark, corpus)).collect()
    assert len(odd) == len(corpus)
    by = {r.doc_id: r for r in odd}
    assert by[5].lang_pred == by[6].lang_pred == by[7].lang_pred == by[13].lang_pred == "und" and by[13].score == 0
    assert langid.languages(spark, documents(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.languages(spark, documents(spark, [(1, "abc", None, None)])).collect()} == {"und"}


def test_language_spans(spark, corpus):
    docs = documents(spark, corpus[:300])
    model = langid.fit(spark, langid.typed(docs))
    rng = random.Random(9)
    parts = [sentence(rng, x, 30) for x in ("en", "ru", "de")]
    text = " ".join(parts)
    got = langid.language_spans(spark, documents(spark, [(1, text, None, None)]), model).orderBy("begin").collect()
    assert [r.lang for r in got] == ["en", "ru", "de"]
    data = text.encode()
    assert abs(len(data[got[0].begin : got[0].end].decode()) - len(parts[0])) < 40


def test_viterbi_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(2)
    first = np.array([0, 4, 4, 5, 10])
    scores = rng.normal(0, 3, (10, 3))
    got = langid.viterbi(scores, first, 2.0, cells=30)
    for a, b in zip(first[:-1], first[1:]):
        value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
        if b > a:
            assert value(tuple(got[a:b])) == pytest.approx(max(map(value, product(range(3), repeat=int(b - a)))))


def test_unknown_documents_go(spark, corpus):
    docs = documents(spark, corpus)
    kept = langid.keep_known(spark, docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(14, 300))
    assert not {r.text for r in kept.collect()} & {None, "", " \t\n ", "12345 !!! ..."}


def test_quality(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(240):
        good = k % 3 > 0
        text = sentence(rng, "en", 60) if good else " | ".join(sentence(rng, "en", 1) + "###" for _ in range(40))
        rows.append((k, text, "en", "a"))
        labels.append((k, int(good), None))
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "x", None, None), (1002, LONG, None, None)]
    table = spark.createDataFrame(labels + [(None, 1, 0), (5000, 0, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(spark, documents(spark, rows), table).collect()}
    assert len(got) == len(rows)
    held = [k for k in range(240) if crc(k, 3) == 1]
    assert all(got[k].held_out == (crc(k, 3) == 1) for k in range(240))
    assert np.mean([got[k].predicted == (k % 3 > 0) for k in held]) > 0.95
    assert got[1000].score == got[1001].score == 0.5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    none = quality.quality_scores(spark, documents(spark, rows[:3]), table.limit(0)).collect()
    assert [r.score for r in none] == [0.5] * 3
    assert quality.quality_scores(spark, documents(spark, []), table).count() == 0


def test_quality_by_brute_force():
    """A score is the curve of the sizes of the text's blocks, compressed one by one with each dictionary."""
    dictionaries = tuple(quality._dictionary([f"{word} {k} water house".encode() * 20 for k in range(30)], 4096) for word in ("bad", "good"))
    model = quality.Model(dictionaries, (2.0, 0.5, 0.01, 0.2), 0.5)
    texts = [b"", b"good water", "гут".encode() * 9000, b"bad 1 water house" * 2000]
    for text, got in zip(texts, model.scores(quality._compressors(dictionaries), texts), strict=True):
        sizes = []
        for d in dictionaries:
            c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=quality.LEVEL, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(text[a : a + quality.BLOCK_BYTES])) for a in range(0, len(text), quality.BLOCK_BYTES)))
        x = (sizes[0] - sizes[1]) / max(1, len(text))
        assert got == pytest.approx(1 / (1 + math.exp(-(2.0 * (x - 0.01) / 0.2 + 0.5))) if text else 0.5, rel=1e-9)


def test_quality_curve():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * x - 0.5)))).astype(float)
    slope, intercept, centre, scale = quality.fit_curve(x, y, np.ones(len(x)))
    assert slope / scale == pytest.approx(1.5, abs=0.1) and intercept - slope * centre / scale == pytest.approx(-0.5, abs=0.1)


def test_mixing_meets_its_targets(spark, corpus):
    docs = documents(spark, corpus[:300])
    rows = mixing.featured(docs).cache()
    targets = {"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2}, "lang": {"en": 0.4, "de": 0.3, "ru": 0.3}}
    from barloom.llm._spark import Scratch

    shares = []
    for most in (200_000, 0):
        with Scratch(spark) as scratch:
            table = mixing.probabilities(spark, rows, scratch, targets, keep=0.3, most_cells=most)
        total = rows.groupBy().sum("_tokens").first()[0]
        each = rows.join(table, ["_source", "_lang", "_topic"]).selectExpr("_source", "_lang", "_tokens * probability as e").toPandas()
        assert each.e.sum() == pytest.approx(0.3 * total, rel=1e-3)
        s, g = each.groupby("_source").e.sum() / each.e.sum(), each.groupby("_lang").e.sum() / each.e.sum()
        assert s["s0"] == pytest.approx(0.5, abs=2e-3) and g["de"] == pytest.approx(0.3, abs=2e-3)
        shares.append(sorted((r._source, r._lang, r._topic, round(r.probability, 4)) for r in table.collect()))
    assert shares[0] == shares[1]


def test_mixing_of_odd_documents(spark):
    docs = documents(spark)
    a = mixing.sample(spark, docs, keep=1.0)
    assert set(docs.columns) <= set(a.columns) and len(a.columns) == len(set(a.columns))
    first, second = (sorted(map(str, mixing.sample(spark, docs.repartition(k)).collect())) for k in (2, 5))
    assert first == second
    assert {5, 6, 7} <= {r.doc_id for r in a.collect()}
    assert mixing.sample(spark, documents(spark, [])).count() == 0


def test_long_labelled_text_keeps_the_sample(spark):
    from barloom.llm import quality

    rows = [(k, ("good clear words in order " if k % 2 else "buy cheap pills now click ") * (2000 if k < 40 else 5) + str(k)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    model = quality.fit(spark, docs, labels, bytes_per_label=20_000)
    assert model.curve is not None
    got = {r.doc_id: r.score for r in quality.score(spark, docs.selectExpr("doc_id", "false as held_out", "text"), model).collect()}
    assert min(got[k] for k in got if k % 2) > max(got[k] for k in got if not k % 2)


def test_repeated_labelled_ids_enter_the_fit_once(spark):
    rows = [(k, "good clear words in order " * 5 + str(k) if k % 2 else "buy cheap pills now click " * 5 + str(k)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    plain = quality.fit(spark, spark.createDataFrame(rows, "doc_id long, text string"), labels, rows_per_label=20)
    again = quality.fit(spark, spark.createDataFrame(rows + rows[:40] * 30, "doc_id long, text string").repartition(5), labels, rows_per_label=20)
    assert (again.dictionaries, again.curve) == (plain.dictionaries, plain.curve) and plain.curve is not None
    # other texts under one id: one of them is taken, whatever the order of rows
    other = rows + [(k, f"something else {k} {n}") for k in range(60) for n in range(9)]
    two = [quality.fit(spark, spark.createDataFrame(o, "doc_id long, text string").repartition(3), labels, rows_per_label=20) for o in (other, other[::-1])]
    assert (two[0].dictionaries, two[0].curve) == (two[1].dictionaries, two[1].curve)


def test_quality_on_held_out_documents(spark):
    """The share of held-out (good, bad) pairs that the score puts in order, through Spark (rows that settings were once chosen on)."""
    from barloom.llm.queries import QUERIES

    data = "/root/testdata/sf0.1"  # smaller tables hold out a dozen bad documents only
    got = QUERIES["op10_quality_classifier"](spark, data).where("held_out").join(spark.read.parquet(f"{data}/labels.parquet").where("quality is not null"), "doc_id").select("score", "quality").collect()
    good, bad = (np.array([r.score for r in got if r.quality == y]) for y in (1, 0))
    order = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert len(good) and len(bad) and order > 0.95, order


def test_topics_are_learned(spark):
    """Documents of two vocabularies fall apart; the model is the same whatever the partitioning; expected tokens are recomputed."""
    rng = random.Random(8)
    kinds = ["alphabet binding circuit document elephant".split(), "mountain northern orchestra painting question".split()]
    rows = [(k, " ".join(rng.choice(kinds[k % 2]) for _ in range(40)), "en", f"s{k % 3}") for k in range(120)] + [(200, None, "en", "s0"), (201, "a b c", None, None)]
    docs = documents(spark, rows)
    topics = mixing.learn_topics(docs, k=2)
    assert np.array_equal(topics.models["en"][1], mixing.learn_topics(docs.repartition(5), k=2).models["en"][1])
    got = {r.doc_id: (r._topic, r._tokens) for r in mixing.featured(docs, topics).select("row.doc_id", "_topic", "_tokens").collect()}
    assert len({got[k][0] for k in range(0, 120, 2)}) == len({got[k][0] for k in range(1, 120, 2)}) == 1 and got[0][0] != got[1][0]
    assert got[200] == ("-1", 0) and got[201] == ("-1", 3)
    all_rows = mixing.sample(spark, docs, keep=1.0, targets={"source": {"s0": 1.0}}).collect()
    assert all_rows and all(r.residual > 0.5 for r in all_rows)  # s0 has a third of the tokens: the target cannot be met
    fine = mixing.sample(spark, docs, keep=0.5).collect()
    assert fine and all(0 <= r.residual < 1e-3 for r in fine)


def test_topics_are_learned_from_every_document(spark):
    """With more documents than any sample took: rarities count all of them, and each centre is the mean of all that are nearest to it."""
    rng = random.Random(3)
    words = [f"{a}{b}word" for a in ("alpha", "bravo", "candle", "delta") for b in range(12)]
    rows = [(k, " ".join(rng.choice(words[k % 4 * 12 : k % 4 * 12 + 12]) for _ in range(15)), "en", "s") for k in range(2600)]
    docs = documents(spark, rows)
    weight, centres = mixing.learn_topics(docs, k=4).models["en"]
    (_, _, w), = mixing.X.text_words(pa.array([r[1] for r in rows]), mixing.X.NON_SPACE)
    counts = mixing._profiles(w)
    assert np.allclose(weight, np.log(2601.0 / ((counts > 0).sum(axis=0) + 1.0)) + 0.1)
    x = mixing._unit(counts, weight)
    at = (x @ centres.T).argmax(axis=1)
    for j in range(4):
        mean = x[at == j].sum(axis=0)
        assert (at == j).sum() == 650 and np.allclose(centres[j], mean / np.linalg.norm(mean), atol=1e-6)


def test_profiles_that_are_not_zero_suffice():
    """Rounds take the counts that are not 0 alone: the same values as of whole rows, whatever slice of a batch they come in."""
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 3, (40, mixing.TOPIC_WIDTH)) * (rng.random((40, mixing.TOPIC_WIDTH)) < 0.1)
    counts[7] = 0
    weight = rng.random(mixing.TOPIC_WIDTH) + 0.1
    at, n = mixing._sparse(counts)
    for i, j in ((0, 40), (5, 9), (7, 8)):
        part = mixing.Profiles(at.slice(i, j - i), n.slice(i, j - i))
        assert part.rows == j - i and np.allclose(part.dense(part.unit(weight)), mixing._unit(counts[i:j], weight), rtol=1e-13, atol=0)
        whole = np.log1p(counts[i:j]) * weight
        assert np.allclose(mixing._unit(counts[i:j], weight), whole / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12))
