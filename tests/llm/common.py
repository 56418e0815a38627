"""Odd documents, and brute-force restatements."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, uid long, key string, `_id` long, node long, n_tokens string, topic string, probability string, score string"
LONG = " ".join(f"wort{i % 997}x{i % 13}" for i in range(60_000))
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten"
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE + " extra", None, "b"),
    (4, "Completely different words that nobody else has written down here today", "en", None),
    (5, None, "fr", "a"),
    (6, "", "fr", "b"),
    (7, " \t\n ", None, None),
    (None, BASE, "en", "a"),
    (None, None, None, None),
    (8, "one two", "en", "c"),
    (9, "one two", "en", "c"),
    (10, LONG, "de", "a"),
    (11, LONG + " tail", "de", "a"),
    (12, "été à Zürich ñandú 東京 Москва", "es", "b"),
    (13, "12345 !!! ...", "en", "b"),
    (14, "l1 same line of five words\nshort\nl1 same line of five words\n\nother tail words are here now", "en", "b"),
]


def documents(spark, rows=ROWS):
    full = [(i, t, lang, src, None if t is None else len(t), "r", 7, None, -1, None, "x", None, "p", "s") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def roots(nodes, linked):
    """The smallest member of the component of each node; linked(a, b) says what is linked."""
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}
