"""Token ids in compressed files: canonical length-limited Huffman coding.

Ids are counted over all documents; the counts (as many as the vocabulary has
entries at most) give code lengths of at most ``MAX_BITS`` by package-merge,
and these alone determine the canonical code.

Format, a folder with two Parquet tables, so that Spark commits, reads and
prunes it in any store:

* ``code``: id, length.  The canonical code orders by length, then id.
* ``blocks``: part, block, base, n_ids, n_docs, first_doc, last_doc, crc32,
  data.  Files and the blocks in them are in ascending order of document.  A
  block holds whole documents, ``BLOCK`` ids or somewhat more, and is read
  without any other: `data` holds the ids of its documents, their numbers of
  ids, a bit offset for every ``EVERY`` ids (checkpoints), and the bits.
  `base` is the number of ids before the block in its part; the ids before a
  part follow from the sums of the parts.

Decoding is table-driven: the next ``longest`` bits, whatever follows the code
word, are an index of its id and length.  All checkpoints of some blocks are
decoded side by side, one id of each at a step, in NumPy; each must end where
the next one begins.  ``read_range`` starts at the checkpoint before the first
id wanted and skips blocks that do not meet the range.

Defined cases: a null text is empty; an empty text has the end id alone; null
document ids come last; rows that share a document id are ordered by their
ids' hash; repeated rows are written as often as they occur; a single distinct
id has a code of one bit; an empty table gives tables without rows; other
columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import _text as X
from barloom.llm._spark import Scratch, partitions

VOCABULARY, END = "word_bpe_49k.json", 2
MAX_BITS, BLOCK, EVERY = 20, 1 << 16, 512
#: Words whose ids a task remembers, at most.
MOST_KNOWN = 1 << 18
#: Of bytes: 1 letters and all outside ASCII, 2 marks other than the apostrophe, 3 all else.
_KIND = np.full(256, 3, dtype=np.int8)
_KIND[0x21:0x7F] = 2
_KIND[0x27] = 3
_KIND[0x30:0x3A] = 3
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1
#: Latin letters, then ASCII marks other than the apostrophe.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Bytes of ids for each part of the file, about.
PART_BYTES = 1 << 27
_MAGIC = np.frombuffer(b"BLHF", dtype="<u4")[0]
_DECODED = 1 << 20


# code


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """The lengths, at most `max_bits`, that make the coded text shortest; package-merge.  Counts are above zero."""
    n = len(counts)
    if n < 2:
        return np.ones(n, dtype=np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need codes of more than {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    is_leaf, level = [np.ones(n, dtype=bool)], leaves
    for _ in range(max_bits - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, packages])
        by = np.argsort(merged, kind="stable")
        level = merged[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of ids and their lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.longest = int(self.lengths.max(initial=1))
        room = np.left_shift(1, self.longest - self.lengths)
        self.words = (np.cumsum(room) - room) >> (self.longest - self.lengths)
        size = int(self.ids.max(initial=0)) + 1
        self._word, self._length = np.zeros(size, dtype=np.uint32), np.zeros(size, dtype=np.int64)
        self._word[self.ids], self._length[self.ids] = self.words, self.lengths
        self._table = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(id, length) for every value of the next `longest` bits."""
        if self._table is None:
            room = np.left_shift(1, self.longest - self.lengths)
            ids, lengths = np.zeros(1 << self.longest, dtype=np.uint32), np.ones(1 << self.longest, dtype=np.uint8)
            filled = int(room.sum())
            ids[:filled], lengths[:filled] = np.repeat(self.ids, room), np.repeat(self.lengths, room)
            self._table = ids, lengths
        return self._table

    def encode(self, ids: np.ndarray, every: int = EVERY) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bit offset of every `every`-th id)."""
        word, length = self._word[ids], self._length[ids]
        if len(ids) and not length.all():
            raise ValueError("an id has no code")
        at = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(length, out=at[1:])
        out = np.zeros((int(at[-1]) + 7) // 8 + 4, dtype=np.uint8)
        # a word of up to 25 bits lies in four bytes; those that begin in one byte are joined first, since their bits do not meet
        window = word << (32 - length - (at[:-1] & 7)).astype(np.uint32)
        byte = at[:-1] >> 3
        if len(ids):
            first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            joined, byte = np.bitwise_or.reduceat(window, first), byte[first]
            for k in range(4):
                out[byte + k] |= ((joined >> np.uint32(24 - 8 * k)) & np.uint32(255)).astype(np.uint8)
        return out[: (int(at[-1]) + 7) // 8], at[:-1][::every]


def pack(code: Code, docs: list[int | None], ids: list[np.ndarray], every: int = EVERY) -> bytes:
    """The data of one block."""
    flat = np.concatenate([np.empty(0, dtype=np.int64), *ids])
    bits, offsets = code.encode(flat, every)
    head = np.array([_MAGIC, every, len(docs), len(flat), len(offsets), len(bits)], dtype="<i8")
    known = np.array([d is not None for d in docs], dtype="<i8")
    numbers = np.array([d or 0 for d in docs], dtype="<i8")
    sizes = np.array([len(i) for i in ids], dtype="<i8")
    return b"".join(a.tobytes() for a in (head, numbers, known, sizes, offsets.astype("<i8"), bits))


class Block:
    """A block's directory and bits."""

    __slots__ = ("bits", "docs", "every", "known", "n", "offsets", "sizes")

    def __init__(self, data: bytes) -> None:
        magic, self.every, docs, self.n, checkpoints, size = np.frombuffer(data, dtype="<i8", count=6).tolist()
        if magic != _MAGIC:
            raise ValueError("not a block of token ids")
        self.docs, self.known, self.sizes = np.frombuffer(data, dtype="<i8", offset=48, count=3 * docs).reshape(3, docs)
        self.offsets = np.frombuffer(data, dtype="<i8", offset=48 + 24 * docs, count=checkpoints)
        self.bits = np.frombuffer(data, dtype=np.uint8, offset=48 + 24 * docs + 8 * checkpoints, count=size)


def decode(code: Code, blocks: list[Block], lanes: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """The ids of each block, or of its checkpoints named in `lanes`."""
    ids, lengths = code.table()
    lanes = lanes if lanes is not None else [np.arange(len(b.offsets)) for b in blocks]
    starts = np.cumsum([0, *(8 * (len(b.bits) + 8) for b in blocks)])
    data = np.concatenate([np.empty(0, dtype=np.uint8), *(x for b in blocks for x in (b.bits, np.zeros(8, dtype=np.uint8)))]).astype(np.uint32)
    if not len(data):
        return []
    windows = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    last = 8 * (len(windows) - 1)
    at = np.concatenate([b.offsets[l] + s for b, l, s in zip(blocks, lanes, starts)])
    sizes = np.concatenate([np.minimum(b.every, b.n - b.every * l) for b, l in zip(blocks, lanes)])
    shift = np.uint32(32 - code.longest)
    steps = int(sizes.max(initial=0))
    out, ends = np.empty((steps, len(at)), dtype=np.uint32), np.empty(len(at), dtype=np.int64)
    for k in range(steps):
        value = (windows[at >> 3] << (at & 7).astype(np.uint32)) >> shift
        out[k] = ids[value]
        at = np.minimum(at + lengths[value], last)
        done = sizes == k + 1
        ends[done] = at[done]
    result, a = [], 0
    for b, l, s in zip(blocks, lanes, starts):
        z = a + len(l)
        expected = np.append(b.offsets, -1)[l + 1] + s
        inner = l + 1 < len(b.offsets)
        if (ends[a:z][inner] != expected[inner]).any():
            raise ValueError("a run of ids does not end at the next checkpoint")
        mask = np.arange(steps)[None, :] < sizes[a:z, None]
        result.append(out[:, a:z].T[mask])
        a = z
    return result


# tokens


def vocabulary(path: str | None = None) -> bytes:
    """The tokenizer's file; it travels with the query (a fixed size), so executors need no such file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


class Tokenizer:
    """Ids of texts by the tokenizers library; each distinct piece of a batch is encoded once.

    The tokenizer drops white space and no token reaches across it, so the ids
    of a text are those of its words (cut at ASCII white space) in order.
    Marks after a word's last letter are a piece of their own.  A piece of
    letters is encoded by the library's model, lower case and in the byte
    alphabet; all other words take the whole way.
    """

    def __init__(self, raw: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Library.from_str(raw.decode())
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = id_type(self.size)
        self.model = self.library.model
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {ord(c): "".join(p for p, _ in alphabet.pre_tokenize_str(c)) for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}
        self.known: dict[str, list[int]] = {}
        self.plain = self._is_plain()

    def _is_plain(self) -> bool:
        """Whether the short way gives what the whole way does, looked at for every letter, mark and contraction; another tokenizer may differ."""
        letters = [chr(c) for c in range(0x41, 0x100) if _SIMPLE.fullmatch(chr(c)) and chr(c).isalpha()]
        tried = [a + b + m for a in letters for b in ("", "a", "Thing", "é") for m in ("", ",", "<|", ").", "_")] + [f"x{chr(m)}" for m in range(0x21, 0x7F) if _SIMPLE.fullmatch(f"x{chr(m)}")]
        return [self._simple(_SIMPLE.fullmatch(w)) for w in tried] == [e.ids for e in self.library.encode_batch_fast(tried, add_special_tokens=False)]

    def _letters(self, letters: str) -> list[int]:
        letters = letters.lower()
        return [t.id for t in self.model.tokenize(letters if letters.isascii() else letters.translate(self.spelled))]

    def _simple(self, match: re.Match) -> list[int]:
        letters, marks = match.groups()
        if marks and marks not in self.known:
            self.known[marks] = self.library.encode(marks, add_special_tokens=False).ids
        return self._letters(letters) + (self.known[marks] if marks else [])

    def of_pieces(self, pieces: list[str]) -> list[list[int]]:
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
        known, rest = self.known, []
        for w in pieces:
            if w in known:
                continue
            if self.plain and w.isascii() and w.isalpha():
                known[w] = self._letters(w)
            elif self.plain and (match := _SIMPLE.fullmatch(w)):
                known[w] = self._simple(match)
            else:
                rest.append(w)
        for w, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False)):
            known[w] = e.ids
        return [known[w] for w in pieces]

    def pieces(self, words: X.Words) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(number of each piece, the distinct pieces, the first piece of each document and the end).

        A word is cut where its letters end, if only marks follow and the last letter is in ASCII, and A-Z in a word of ASCII letters and such marks become a-z.
        """
        data, starts, ends = words.data, words.starts, words.ends
        if not self.plain or not len(starts):
            return *X.distinct(words), words.first
        kind = _KIND[data]
        sums = [_sums(x) for x in (kind == 1, kind == 3, np.append((kind[:-1] == 2) & (kind[1:] == 1), False), data > 127)]
        letters, other, _, wide = (s[ends] - s[starts] for s in sums)
        turns = sums[2][ends - 1] - sums[2][starts]
        middle = starts + letters
        simple = (letters > 0) & (other == 0) & (turns == 0) & (data[middle - 1] < 128)
        cut = simple & (middle < ends)
        before = np.concatenate([[0], np.cumsum(1 + cut)])
        a, z = np.empty(before[-1], dtype=np.int64), np.empty(before[-1], dtype=np.int64)
        a[before[:-1]], z[before[1:] - 1] = starts, ends
        z[before[:-1][cut]] = a[before[1:][cut] - 1] = middle[cut]
        fold = np.zeros(len(data) + 1, dtype=np.int8)
        plain = simple & (wide == 0)
        fold[starts[plain]] += 1
        fold[ends[plain]] -= 1
        low = np.where(np.cumsum(fold[:-1]) > 0, X.LOWER[data], data)
        return *X.distinct_slices(low, a, z), before[words.first]

    def of_texts(self, column: pa.Array, end: int) -> Iterator[np.ndarray]:
        """The ids of each text, then `end`."""
        for _, _, words in X.text_words(column, X.NON_SPACE, 4 * X.CHUNK_BYTES):
            code, distinct, first = self.pieces(words)
            ids = [*self.of_pieces(distinct.to_pylist()), [end]]
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            start = np.cumsum(size) - size
            code = np.insert(code, first[1:], len(ids) - 1)
            n = size[code]
            edge = np.zeros(len(code) + 1, dtype=np.int64)
            np.cumsum(n, out=edge[1:])
            of_piece = np.fromiter(chain.from_iterable(ids), dtype=self.width, count=int(size.sum()))
            kind = np.int32 if edge[-1] < 1 << 31 else np.int64
            flat = of_piece[np.repeat((start[code] - edge[:-1]).astype(kind), n) + np.arange(edge[-1], dtype=kind)]
            cuts = edge[first + np.arange(len(first))]
            yield from (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:]))


def token_ids(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, ids (unsigned, 16 bits where the vocabulary fits, else 32) of every text."""
    held = spark.sparkContext.broadcast(vocabulary(tokenizer_path))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(held.value)
        for batch in batches:
            ids = list(tokenizer.of_texts(batch.column(1), end))
            yield pa.RecordBatch.from_arrays([batch.column(0), X.binary_array(ids), pa.array([len(i) for i in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def _sums(marks: np.ndarray) -> np.ndarray:
    """The number of marks before each position of a chunk."""
    out = np.zeros(len(marks) + 1, dtype=np.int32)
    np.cumsum(marks, out=out[1:])
    return out


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def id_counts(coded: DataFrame, size: int) -> DataFrame:
    """id, n over all documents; at most `size` rows from each task."""
    width = id_type(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(X.unpack(batch.column(0), width)[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    return coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# files

BLOCKS = "part int, block int, base long, n_ids long, n_docs long, first_doc long, last_doc long, crc32 long, data binary"


def write_ids(spark: SparkSession, docs: DataFrame, path: str, tokenizer_path: str | None = None, end: int = END, max_bits: int = MAX_BITS, block: int = BLOCK, every: int = EVERY) -> None:
    """Writes the ids of all documents, in ascending order of doc_id, to `path`."""
    if not 0 < max_bits <= 25:
        raise ValueError("codes have 1 to 25 bits")
    size = Tokenizer(vocabulary(tokenizer_path)).size
    width = id_type(size)
    with Scratch(spark) as scratch:
        coded = scratch.table(token_ids(spark, docs, tokenizer_path, end), "ids")
        counts = id_counts(coded, size).toArrow()  # the vocabulary at most
        ids, n = counts["id"].to_numpy(), counts["n"].to_numpy()
        lengths = code_lengths(n, max_bits)
        spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id long, length long").coalesce(1).write.parquet(f"{path}/code")
        code = spark.sparkContext.broadcast(Code(ids, lengths))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number, base = TaskContext.get().partitionId(), 0, 0
            held_docs: list[int | None] = []
            held_ids: list[np.ndarray] = []
            held = 0

            def close() -> pa.RecordBatch:
                data = pack(code.value, held_docs, held_ids, every)
                row = [[part], [number], [base], [held], [len(held_docs)], [held_docs[0]], [held_docs[-1]], [zlib.crc32(data)], [data]]
                types = [pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["part", "block", "base", "n_ids", "n_docs", "first_doc", "last_doc", "crc32", "data"])

            for batch in batches:
                values, offsets = X.unpack(batch.column(1), width)
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    held_docs.append(doc)
                    held_ids.append(values[offsets[k] : offsets[k + 1]].astype(np.int64))
                    held += len(held_ids[-1])
                    if held >= block:
                        yield close()
                        number, base, held_docs, held_ids, held = number + 1, base + held, [], [], 0
            if held_docs:
                yield close()

        parts = max(partitions(spark), int(n.sum()) * np.dtype(width).itemsize // PART_BYTES)
        order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("ids")]
        placed = coded.select("doc_id", "ids").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        placed.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")


def _open(spark: SparkSession, path: str):
    """(blocks, code, ids before each part) of a folder; driver and tasks hold a row for each id of the code and each part."""
    table = spark.read.schema("id long, length long").parquet(f"{path}/code").toArrow()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    held = spark.sparkContext.broadcast((table["id"].to_numpy(), table["length"].to_numpy(), {p: b for (p, _), b in zip(sizes, before)}))
    return blocks, held


def _some(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[Block]]]:
    """(part, base, block) of some rows at a time, checked against their checksums."""
    part, base, size, crc = (batch.column(c).to_pylist() for c in ("part", "base", "n_ids", "crc32"))
    data, a = batch.column("data"), 0
    while a < len(part):
        z, held = a, 0
        while z < len(part) and (z == a or held + size[z] <= _DECODED):
            held += size[z]
            z += 1
        raw = [data[k].as_py() for k in range(a, z)]
        for k, r in enumerate(raw):
            if zlib.crc32(r) != crc[a + k]:
                raise ValueError(f"block {k} of part {part[a + k]} is damaged")
        yield part[a:z], base[a:z], [Block(r) for r in raw]
        a = z


def _documents(spark: SparkSession, path: str, last, name: str, kind: pa.DataType, sql: str) -> DataFrame:
    blocks, held = _open(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, before = held.value
        code = Code(ids, lengths)
        for batch in batches:
            for part, base, some in _some(batch):
                docs, start, sizes, values = [], [], [], []
                for p, b, block, flat in zip(part, base, some, decode(code, some)):
                    edge = np.concatenate([[0], np.cumsum(block.sizes)])
                    docs.append(pa.array(block.docs, mask=block.known == 0))
                    start.append(edge[:-1] + before[p] + b)
                    sizes.append(block.sizes)
                    values += [flat[x:y] for x, y in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(docs), pa.array(np.concatenate(start)), pa.array(np.concatenate(sizes)), last(values, kind)], ["doc_id", "start", "n_tokens", name])

    return blocks.select("part", "base", "n_ids", "crc32", "data").mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {sql}")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32 bit, little-endian) of every document."""
    return _documents(spark, path, lambda values, _: X.binary_array([v.astype("<u4") for v in values]), "ids", pa.binary(), "binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    return _documents(spark, path, lambda values, kind: pa.array([zlib.crc32(v.astype("<u4").tobytes()) for v in values], kind), "ids_crc32", pa.int64(), "long")


def read_range(spark: SparkSession, path: str, first: int, end: int) -> DataFrame:
    """position, ids (binary, unsigned 32 bit) of the ids at positions from `first` to before `end`, a row for each block that meets them.

    Blocks and checkpoints outside are not decoded.
    """
    blocks, held = _open(spark, path)
    met = [(p, b) for p, b in held.value[2].items()]
    offsets = spark.createDataFrame(met or [(-1, 0)], "part int, before long")  # one row for each part
    inside = blocks.join(F.broadcast(offsets), "part").where((F.col("before") + F.col("base") < end) & (F.col("before") + F.col("base") + F.col("n_ids") > first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, before = held.value
        code = Code(ids, lengths)
        for batch in batches:
            for part, base, some in _some(batch):
                at = [before[p] + b for p, b in zip(part, base)]
                spans = [(max(0, first - s), min(b.n, end - s)) for s, b in zip(at, some)]
                lanes = [np.arange(x // b.every, -(-y // b.every)) for (x, y), b in zip(spans, some)]
                cut = [flat[x - l[0] * b.every : y - l[0] * b.every].astype("<u4") for flat, (x, y), l, b in zip(decode(code, some, lanes), spans, lanes, some)]
                yield pa.RecordBatch.from_arrays([pa.array([s + x for s, (x, _) in zip(at, spans)], pa.int64()), X.binary_array(cut)], ["position", "ids"])

    return inside.select("part", "base", "n_ids", "crc32", "data").mapInArrow(run, "position long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """`digests` of all documents from files written for it."""
    with Scratch(spark, batch=64) as scratch:
        path = f"{scratch.path}/files"
        write_ids(spark, docs, path, tokenizer_path)
        return scratch.finish(digests(spark, path))
