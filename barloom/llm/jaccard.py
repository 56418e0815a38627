"""N-gram Jaccard join: near-duplicate documents by their word shingles.

Method: token-combination prefixes.  A document's tokens are its distinct
word shingles.  In one global order (rare tokens first) a document that
reaches the threshold with another can lose only its first ``slack`` tokens,
so a prefix of ``slack + 1`` rare tokens is indexed singly.  Tokens of the
frequent class come last; where a prefix must reach into them it is extended
and 2-token combinations are indexed instead, inside groups given by the
token's hash: a group of c prefix tokens keeps one of its pairs until c - 1
tokens are lost.  The prefix is extended until the losses that would destroy
all keys exceed the slack, so no qualifying pair is missed, whatever tokens
are called frequent; the estimate of that class only moves work.

Documents with equal sets collapse to one node first.  Pairs are thinned by an
exact upper bound from bucket counts and verified on whole sets.  Groups of near
copies are contracted first: the posting lists of ``FIRST_KEYS`` keys of each
node are joined as stars around one of their nodes, which connects most of what
is similar by a few pairs for each node.  Then all keys follow, but a list whose
nodes are in one component by now is done, and of the others only pairs across
components count: first as stars, then all pairs of a list whose ends are still
apart; lists with the same nodes count once.  Very long lists (near copies in
the thousands; tokens that common are in the frequent class otherwise) are
not multiplied out per list: the nodes of the components that they join are held
against the bound and compared as whole sets in blocks, only across components, so
that the components stay exact; a block gives no more links than it has nodes.

Defined cases: null and empty texts, and texts without words, have an empty
set, size 0, and are components of their own; a text with fewer words than a
shingle has its whole sequence as its one token; equal rows share one
component; a null ``doc_id`` takes part, but a component is named by its
smallest non-null id (null if there is none); an empty table gives an empty
result; other columns are ignored.  Tokens are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm import _text as X
from barloom.llm._spark import KEY, BitFilter, Scratch, components, keyed, on_hot, partitions

_U = np.uint64
SHINGLE = 5
#: Keys of a node that take part in the first contraction.
FIRST_KEYS = 3
#: Longer posting lists are compared in blocks, once for all lists of a star.
LONG_LIST = 128
#: Rows, and about how many tokens, of one side of a block in which components of one star are compared.
BLOCK = 2048
BLOCK_TOKENS = 1 << 21
#: Threshold as a ratio of whole numbers.
OVER, OF = 4, 5

_DOC = "doc_id long, n_shingles long, sig long, keys binary, sketch binary, text_key long"


def token_sets(column, width: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct tokens of each document, chunk by chunk."""
    for _, _, words in X.text_words(column, X.NON_SPACE):
        shingles = X.windows(words.hashes, width)
        out = []
        for i, j in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if j - i >= width:
                out.append(np.unique(shingles[i : j - width + 1]))
            else:
                out.append(X.whole(words.hashes[i:j]))
        yield out


def _signature(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = X.mix(tokens ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + X.mix(tokens).sum(dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    return int(X.mix(np.array([total + _U(len(tokens))], dtype=np.uint64)).view(np.int64)[0])


def slack(n: int) -> int:
    """How many tokens of a set of n may be absent from a set it links with."""
    return n - -(-OVER * n // OF)


def levels(n: int) -> list[int]:
    """Size levels (powers of 4) that a partner of a set of n tokens can have; 0 below 16."""

    def level(m: int) -> int:
        return 0 if m < 16 else (m.bit_length() - 1) // 2

    return sorted({level(-(-OVER * n // OF)), level(n), level(OF * n // OVER)})


def prefix_keys(rare: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Index keys of a set that is given as its rare and its frequent tokens, each sorted."""
    n = len(rare) + len(frequent)
    need = slack(n) + 1
    if len(rare) >= need:
        return rare[:need]
    need -= len(rare)
    keys = [rare]
    for level in levels(n):
        if level == 0:
            keys.append(frequent[:need])
            continue
        group = (X.mix(frequent) % _U(4**level // 2)).astype(np.int64)
        _, first = np.unique(group, return_index=True)
        gain = np.ones(len(frequent), dtype=np.int64)
        gain[first] = 0
        cut = int(np.searchsorted(np.cumsum(gain), need)) + 1
        order = np.argsort(group[:cut], kind="stable")
        token, group = frequent[:cut][order], group[:cut][order]
        with np.errstate(over="ignore"):
            for step in range(1, len(token)):
                same = group[step:] == group[:-step]
                if not same.any():
                    break
                keys.append(X.mix(token[:-step][same] * _U(0xD6E8FEB86659FD93) + token[step:][same] * _U(3) + _U(level)))
    return np.unique(np.concatenate(keys))


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """Token counts of equal ranges of the hash space, about 4 tokens in each."""
    buckets = 16
    while buckets < 65536 and buckets * 4 < len(tokens):
        buckets *= 2
    counts = np.bincount((tokens >> _U(64 - buckets.bit_length() + 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8) if counts.max(initial=0) < 256 else np.empty(0, dtype=np.uint8)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int | None:
    """No two sets with these sketches share more tokens; None: nothing is known."""
    if not len(a) or not len(b):
        return None
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = a.reshape(len(b), -1).sum(axis=1, dtype=np.int64)
    return int(np.minimum(a, b).sum(dtype=np.int64))


def links(overlap: int, n: int, m: int) -> bool:
    return OF * overlap >= OVER * (n + m - overlap)


def frequent_tokens(docs: DataFrame, width: int, rate: int, least: int, most: int) -> np.ndarray:
    """Hashes of tokens seen in at least `least` of one in `rate` documents, `most` at most (the commonest).

    The class is an estimate from a sample and bounded in size; it only
    decides the order of tokens and what is indexed in combinations.
    """

    def count(batches):
        for batch in batches:
            for sets in token_sets(batch.column(0), width):
                tokens, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], ["token", "n"])

    found = (
        docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(rate)) == 0)
        .select("text")
        .mapInArrow(count, "token long, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least)
        .orderBy(F.desc("n"), "token")
        .limit(most)
        .select("token")
        .toArrow()
    )
    return np.sort(found["token"].to_numpy().view(np.uint64)) if len(found) else np.empty(0, dtype=np.uint64)


def _index(width: int, frequent):
    def run(batches):
        seen: set[int] = set()
        often = frequent.value
        for batch in batches:
            ids, at = batch.column(0), 0
            for sets in token_sets(batch.column(1), width):
                sigs, keys, sketches = [], [], []
                flat = X.member(often, np.concatenate(sets)) if len(often) and sets else None
                o = 0
                for tokens in sets:
                    n = len(tokens)
                    sig = _signature(tokens) if n else None
                    if n and sig not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(sig)
                        if flat is None:
                            keys.append(prefix_keys(tokens, tokens[:0]))
                        else:
                            f = flat[o : o + n]
                            keys.append(prefix_keys(tokens[~f], tokens[f]))
                        sketches.append(sketch_of(tokens))
                    else:
                        keys.append(tokens[:0])
                        sketches.append(np.empty(0, dtype=np.uint8))
                    sigs.append(sig)
                    o += n
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(sets)), pa.array([len(t) for t in sets], pa.int64()), pa.array(sigs, pa.int64()), X.binary_array(keys), X.binary_array(sketches), batch.column(2).slice(at, len(sets))],
                    ["doc_id", "n_shingles", "sig", "keys", "sketch", "text_key"],
                )
                at += len(sets)

    return run


def _postings(batches):
    for batch in batches:
        keys, o = X.unpack(batch.column(3), np.int64)
        per = np.diff(o)
        sig, n, comp = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), per) for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sig), pa.array(n.astype(np.int32)), pa.array(comp)], ["key", "node", "n", "comp"])


def _first_keys(batches):
    """key, node of some keys of each node, in an order that is the same for all nodes and has nothing to do with the texts."""
    for batch in batches:
        keys, o = X.unpack(batch.column(1), np.uint64)
        node = np.repeat(np.arange(batch.num_rows), np.diff(o))
        order = np.lexsort((X.mix(keys ^ _U(0x3C6EF372FE94F82B)), node))
        keep = order[np.arange(len(order)) - o[:-1][node] < FIRST_KEYS]
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), batch.column(0).take(pa.array(node[keep]))], ["key", "node"])


def _hubs(batches):
    """Pairs of each node and the first of its list; rows come sorted by key and node."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        hub = node[start].copy()
        if last and last[0] == key[0]:
            hub[0] = last[1]
        last = int(key[-1]), int(hub[-1])
        to = np.repeat(hub, np.diff(np.append(start, len(key))))
        low, high = _unique(node[node != to], to[node != to])
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])


def _unique(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.minimum(low, high), np.maximum(low, high)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[new], high[new]


_NO_NODES = np.empty(0, dtype=np.int64)
_FOUND = "a long, b long, comp_a long, comp_b long, long_list boolean, list long, nodes binary, sizes binary"


def _stars(batches):
    """Pairs of a list's nodes with its hub and the lists, as far as they lie in several components.

    Postings come sorted by key, size and node; no more is held than a long list's length and a batch.
    """
    held = np.empty((0, 4), dtype=np.int64)
    star: tuple[int, int, int] | None = None  # key, hub and its component of a long list that was passed on in part
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def emit(rows, star):
        key, node, n, comp = rows.T
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(start, len(key)))
        at = np.repeat(np.arange(len(start)), length)
        first = np.lexsort((node, at))[start]
        hub, hub_comp = node[first], comp[first]
        is_long = length > LONG_LIST
        if star and key[0] == star[0]:
            is_long[0], hub[0], hub_comp[0] = True, star[1], star[2]
        apart = comp != hub_comp[at]
        pairs = np.stack([node, hub[at], comp, hub_comp[at], is_long[at]], axis=1)[apart]
        swap = pairs[:, 0] > pairs[:, 1]
        pairs[swap] = pairs[swap][:, [1, 0, 3, 2, 4]]
        pairs = np.unique(pairs, axis=0)
        lists = np.flatnonzero((length > 2) & ~is_long & np.logical_or.reduceat(apart, start))
        spans = [slice(s, s + m) for s, m in zip(start[lists].tolist(), length[lists].tolist())]
        out = []
        if len(pairs):
            none = pa.nulls(len(pairs), pa.binary())
            out.append(pa.RecordBatch.from_arrays([*(pa.array(pairs[:, k].copy()) for k in range(4)), pa.array(pairs[:, 4] > 0), pa.nulls(len(pairs), pa.int64()), none, none], names))
        if len(lists):
            none = [pa.nulls(len(lists), pa.int64())] * 4
            out.append(pa.RecordBatch.from_arrays([*none, pa.nulls(len(lists), pa.bool_()), pa.array(key[start[lists]]), X.binary_array([node[c] for c in spans]), X.binary_array([n[c] for c in spans])], names))
        return out, (int(key[-1]), int(hub[-1]), int(hub_comp[-1])) if is_long[-1] else None

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([held, np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])])
        same = np.zeros(len(rows), dtype=bool)
        same[1:] = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
        rows = rows[~same]
        cut = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1 if rows[0, 0] != rows[-1, 0] else 0
        if len(rows) - cut > 2 * LONG_LIST:  # this list is long whatever follows; its last node stays to find repeats
            cut = len(rows) - 1
        rows, held = rows[:cut], rows[cut:]
        if len(rows):
            out, star = emit(rows, star)
            yield from out
    if len(held):
        yield from emit(held, star)[0]


def _spread_lists(batches):
    for batch in batches:
        nodes, o = X.unpack(batch.column(1), np.int64)
        sizes, _ = X.unpack(batch.column(2), np.int64)
        which = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(o))
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(nodes), pa.array(sizes)], ["list", "node", "n"])


def _crossing(batches):
    """Pairs of a list in different components that agree in size; rows come sorted by list, size and node."""
    held = np.empty((0, 4), dtype=np.int64)

    def emit(rows):
        which, node, n, comp = rows.T
        a, b = [_NO_NODES], [_NO_NODES]
        for step in range(1, LONG_LIST):
            same = which[step:] == which[:-step]
            if not same.any():
                break
            ok = same & (comp[step:] != comp[:-step]) & (OF * n[:-step] >= OVER * n[step:])
            a.append(node[:-step][ok])
            b.append(node[step:][ok])
        low, high = _unique(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([held, np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])])
        cut = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1 if rows[0, 0] != rows[-1, 0] else 0
        rows, held = rows[:cut], rows[cut:]
        if len(rows):
            yield emit(rows)
    if len(held):
        yield emit(held)


def _bounded(batches):
    for batch in batches:
        (sa, oa), (sb, ob) = (X.unpack(batch.column(k), np.uint8) for k in (5, 6))
        na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
        keep, score = [], []
        for i in range(batch.num_rows):
            bound = overlap_bound(sa[oa[i] : oa[i + 1]], sb[ob[i] : ob[i + 1]])
            small, large = min(na[i], nb[i]), max(na[i], nb[i])
            bound = int(small) if bound is None else min(bound, int(small))
            if links(bound, int(small), int(large)):
                keep.append(i)
                score.append(bound / (small + large))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array(score, pa.float64())], ["a", "b", "score"])


def _verified(batches):
    for batch in batches:
        (sa, oa), (sb, ob) = (X.unpack(batch.column(k), np.uint64) for k in (2, 3))
        keep = []
        for i in range(batch.num_rows):
            x, y = sa[oa[i] : oa[i + 1]], sb[ob[i] : ob[i + 1]]
            if len(x) > len(y):
                x, y = y, x
            if links(int(X.member(y, x).sum()), len(x), len(y)):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])


def _sets(width: int, ids, nodes):
    def run(batches):
        for batch in batches:
            hit = BitFilter.test(ids.value, batch.column(1).to_numpy(zero_copy_only=False)) if batch.num_rows else []
            text = batch.column(0).filter(pa.array(hit, pa.bool_()))
            for sets in token_sets(text, width):
                sets = [t for t in sets if len(t)]
                sigs = np.array([_signature(t) for t in sets], dtype=np.int64)
                keep = np.flatnonzero(BitFilter.test_hashes(nodes.value, sigs.view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(sigs[keep]), X.binary_array([sets[k] for k in keep.tolist()])], ["node", "tokens"])

    return run


def _blocks(table: pa.Table) -> pa.Table:
    """Links of one block cell between its components, as many as connect what links; pairs that the bound lets pass are compared as whole sets here."""
    node, comp, n, side = (table[c].to_numpy() for c in ("node", "comp", "n", "salt"))
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    sketches, o = X.unpack(table["sketch"].combine_chunks(), np.uint8)
    tokens, at = X.unpack(table["tokens"].combine_chunks(), np.uint64)
    names, tokens = np.unique(tokens, return_inverse=True)
    own = np.zeros(len(names), dtype=bool)
    comp = np.unique(comp, return_inverse=True)[1]
    left = np.flatnonzero(side == i)
    right = np.flatnonzero(side == j)
    each = [sketches[o[k] : o[k + 1]] for k in range(len(node))]
    sizes = np.array([len(s) for s in each])
    wide = [(int(w), ys := right[sizes[right] == w], np.array([each[k] for k in ys], dtype=np.int32).reshape(-1, int(w))) for w in np.unique(sizes[right])]
    a, b = [], []
    for x in left.tolist():
        own[tokens[at[x] : at[x + 1]]] = True
        for w, ys, matrix in wide:
            ok = (comp[ys] != comp[x]) & (OF * np.minimum(n[ys], n[x]) >= OVER * np.maximum(n[ys], n[x]))
            if i == j:
                ok &= node[ys] > node[x]
            if not ok.any():
                continue
            ys, rows, mine = ys[ok], matrix[ok], each[x].astype(np.int32)
            if w and len(mine):
                small = min(w, len(mine))
                bound = np.minimum(rows.reshape(len(rows), small, -1).sum(axis=2), mine.reshape(small, -1).sum(axis=1)).sum(axis=1)
                ys = ys[OF * bound >= OVER * (n[ys] + n[x] - bound)]
            for y in ys.tolist():
                if comp[y] != comp[x] and links(int(own[tokens[at[y] : at[y + 1]]].sum()), int(n[x]), int(n[y])):
                    a.append(node[x])
                    b.append(node[y])
                    comp[comp == comp[y]] = comp[x]
        own[tokens[at[x] : at[x + 1]]] = False
    ends = np.sort(np.array([a, b], dtype=np.int64), axis=0)
    return pa.table({"a": ends[0], "b": ends[1]})


def text_key():
    """Tells texts of one id apart."""
    return F.xxhash64("text").alias("text_key")


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    width: int = SHINGLE,
    sample_rate: int = 16,
    frequent_least: int = 3,
    frequent_most: int = 1_000_000,
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text); `text_key`, and `root`, the component's own key (null for empty sets).

    Two documents link when the Jaccard similarity of their sets of distinct
    `width`-word shingles is 0.8 or more.  ``sample_rate``,
    ``frequent_least`` and ``frequent_most`` describe the estimate of the
    frequent class (see the module's docstring); results do not depend on them.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sc = spark.sparkContext
    with Scratch(spark) as scratch:
        frequent = sc.broadcast(frequent_tokens(docs, width, sample_rate, frequent_least, frequent_most))
        table = scratch.table(docs.select("doc_id", "text", text_key()).mapInArrow(_index(width, frequent), _DOC), "documents")
        first = table.where(F.length("keys") > 0)
        nodes = first.groupBy("sig").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        nodes = scratch.table(nodes.withColumnRenamed("sig", "node"), "nodes")
        ids = scratch.table(table.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")).withColumnRenamed("sig", "node"), "ids")

        def bounded(pairs: DataFrame, name: str) -> DataFrame:
            a, b = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
            joined = pairs.join(a, "a").join(b, "b").select("a", "b", F.lit(0), "n_a", "n_b", "sketch_a", "sketch_b")
            return scratch.table(joined.mapInArrow(_bounded, "a long, b long, score double"), name)

        def sets_of(wanted: DataFrame) -> DataFrame:
            """node, tokens of these nodes (and of some more), made again from the texts; of copies, several rows."""
            bits = BitFilter(ids.join(wanted, "node", "left_semi").select("doc_id"))
            held = sc.broadcast(bits.words), sc.broadcast(BitFilter(wanted, hashed=True).words)
            return scratch.table(docs.select("text", bits.column("doc_id").alias("at")).mapInArrow(_sets(width, *held), "node long, tokens binary"), "sets")

        def verify(edges: DataFrame, name: str) -> DataFrame:
            """Those of the edges that link; the sets of their ends alone are made again from the texts."""
            sets = sets_of(scratch.table(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "wanted"))
            sa, sb = (sets.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
            return scratch.table(edges.join(sa, "a").join(sb, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(_verified, "a long, b long").distinct(), name, batch=250)

        def across(edges: DataFrame, comps: DataFrame) -> DataFrame:
            ca, cb = (comps.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
            both = edges.join(ca, "a", "left").join(cb, "b", "left")
            return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")

        few = first.select(F.col("sig").alias("node"), "keys").mapInArrow(_first_keys, "key long, node long")
        hubs = few.repartition(partitions(spark), "key").sortWithinPartitions("key", "node").mapInArrow(_hubs, "a long, b long").distinct()
        hubs = scratch.table(hubs, "hubs", batch=20_000)
        proved = verify(bounded(hubs, "likely").select("a", "b"), "proved")
        comps = start = components(proved, scratch)

        postings = first.select(F.col("sig").alias("node"), "n_shingles", "keys").join(start, "node", "left")
        postings = postings.select("node", "n_shingles", F.coalesce("root", "node").alias("comp"), "keys").mapInArrow(_postings, "key long, node long, n int, comp long")
        found = scratch.table(
            postings.repartition(partitions(spark), "key").sortWithinPartitions("key", "n", "node").mapInArrow(_stars, _FOUND),
            "found",
            batch=20_000,
        )
        stars = found.where("a is not null")
        tried = scratch.table(stars.select("a", "b").distinct().join(hubs, ["a", "b"], "left_anti"), "tried")
        likely = bounded(tried, "likely").select("a", "b")
        if not likely.isEmpty():
            proved = proved.union(verify(likely, "proved"))
            comps = components(proved, scratch)

        lists = found.where("list is not null").groupBy("nodes").agg(F.first("list").alias("list"), F.first("sizes").alias("sizes"))
        members = lists.select("list", "nodes", "sizes").mapInArrow(_spread_lists, "list long, node long, n long")
        members = members.join(comps, "node", "left").select("list", "node", "n", F.coalesce("root", "node").alias("comp"))
        apart = members.repartition(partitions(spark), "list").sortWithinPartitions("list", "n", "node").mapInArrow(_crossing, "a long, b long").distinct()
        apart = apart.join(hubs, ["a", "b"], "left_anti").join(tried, ["a", "b"], "left_anti")
        rest = scratch.table(bounded(apart, "more").select("a", "b"), "rest", batch=10_000)
        if not rest.isEmpty():
            proved = proved.union(verify(rest, "proved"))
            comps = components(proved, scratch)

        # the nodes of all components that long lists join
        group = components(stars.where("long_list").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), scratch)
        if not group.isEmpty():
            begun = nodes.select("node").join(start.withColumnRenamed("root", "begun"), "node", "left").withColumn("begun", F.coalesce("begun", "node"))
            member = begun.join(group.select(F.col("node").alias("begun"), "root"), "begun").select("node", "root")
            member = member.join(comps.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            member = scratch.table(member, "members")
            mixed = member.join(nodes, "node").groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
            parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
            mixed = scratch.table(mixed.select("root", "size", parts.alias("parts")), "mixed")
            mine = scratch.table(on_hot(member, mixed, "root", "size"), "crossed")
            if not mine.isEmpty():
                sets = sets_of(mine.select("node")).dropDuplicates(["node"])
                rows = (
                    mine.join(nodes, "node")
                    .join(sets, "node")
                    .withColumn("salt", F.pmod(F.xxhash64("node"), "parts").cast("int"))
                    .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                    .select("root", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "node", "comp", "n", "sketch", "salt", "tokens")
                )
                proved = proved.union(scratch.table(rows.groupBy("root", "i", "j").applyInArrow(_blocks, "a long, b long"), "proved"))
                comps = components(proved, scratch)

        # a set of its own that one row has is its own component; the others are named by their nodes, then given to their rows
        named = ids.join(comps, "node", "left").where("root is not null or rows > 1")
        named = scratch.table(named.withColumn("root", F.coalesce("root", "node")), "named")
        least = scratch.table(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "least")
        named = on_hot(named.select("root", "node", "rows"), least, "root", "size")
        named = scratch.table(named.select(F.col("node").alias("sig"), "root", "component_id", "rows"), "named")
        rows = on_hot(table.select("doc_id", "n_shingles", "sig", "text_key"), named, "sig", "rows", "left")
        component = F.when(F.col("root").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
        out = rows.select("doc_id", "n_shingles", component.alias("component_id"), "text_key", F.coalesce("root", "sig").alias("root"))
        return scratch.finish(out)


def keep_one(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component one row stays.

    It is the one with the smallest id (null ids last); rows that give one id
    and text repeatedly are one document.  Rows with empty sets all stay.
    """
    found = near_duplicates(spark, docs, **options)
    ident = F.struct(F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_key").alias("_text_key"))
    best = found.where("root is not null").groupBy("root").agg(F.min(ident).alias("best")).select(F.lit(False).alias("empty"), "best.*")
    empty = found.where("root is null").select(F.lit(True).alias("empty"), ident.alias("best")).select("empty", "best.*").distinct()
    rows = keyed(docs).join(best.union(empty), KEY).withColumn("_nth", F.row_number().over(W.partitionBy(KEY).orderBy(KEY)))
    return rows.where("_nth = 1 or empty").select("row.*")
