"""Chat formatting: token-level assembly.

Roles and texts are encoded on their own, as ordinary text, and reserved ids
are spliced between them, so that nothing inside a text can become a control
token.  For readers of the formatted text, strings in a text that look like
control strings are escaped reversibly: every ``<``, any backslashes, ``|``
gets one more backslash.  The loss mask marks the tokens of assistant texts;
it is the prefix sum of the marks at their ends.

A conversation of any length is worked off turn by turn: turns are encoded
where they are, then sorted within their conversation, and positions are
running sums, so only one turn is held at a time.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn.

Defined cases: a null text or role is the empty string; turns come in the
order of ``turn`` (null first), then role, then text; repeated rows are
repeated turns; rows with a null conv_id are one conversation; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import _text as X
from barloom.llm._spark import partitions, wide_rows

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: Fixed value: how byte-level vocabularies of this kind cut texts before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"<\\{m[1]}|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text)


class Tokenizer:
    """A byte-level vocabulary with the reserved ids after its last rank."""

    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        top = max(table.values()) + 1
        self.start, self.sep, self.end = top, top + 1, top + 2
        self.names = {self.start: START, self.sep: SEP, self.end: END}

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes(list(ids)).decode("utf-8")


def vocabulary(path: str | None = None) -> bytes:
    """The file's bytes; they travel with the query (a fixed size), so executors need no such file."""
    with open(path or f"{TOKENIZERS}/{VOCABULARY}", "rb") as f:
        return f.read()


def assemble(tokenizer: Tokenizer, role: str, text: str, loss_role: str = LOSS_ROLE) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of one turn."""
    segments = [[tokenizer.start], tokenizer.encode(escape(role)), [tokenizer.sep], tokenizer.encode(escape(text)), [tokenizer.end]]
    edge = np.cumsum([0, *map(len, segments)])
    mark = np.zeros(edge[-1] + 1, dtype=np.int8)
    if role == loss_role:
        mark[edge[3]] += 1
        mark[edge[4]] -= 1
    return np.array([i for s in segments for i in s], dtype=np.int32), np.cumsum(mark[:-1]).astype(np.int8)


def format_turns(spark: SparkSession, conversations: DataFrame, vocabulary_path: str | None = None, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row for each turn, sorted within conversations that lie in one partition each.

    conv_id, turn_no (from 0), first_token (its position in the conversation),
    ids (int32), loss_mask (int8), formatted (the text with its template).
    """
    wide_rows(spark)
    held = spark.sparkContext.broadcast(vocabulary(vocabulary_path))

    def encode(batches):
        tokenizer = Tokenizer(held.value)
        for batch in batches:
            ids, masks = [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                i, m = assemble(tokenizer, role, text, loss_role)
                ids.append(i)
                masks.append(m)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), X.binary_array(ids), X.binary_array(masks)], ["conv_id", "turn", "role", "text", "ids", "loss_mask"])

    def place(batches):
        tokenizer = Tokenizer(held.value)
        now: tuple | None = None
        number = position = 0
        for batch in batches:
            ids, o = X.unpack(batch.column(1), np.int32)
            convs = batch.column(0).to_pylist()
            numbers, positions, texts = [], [], []
            for k, conv in enumerate(convs):
                if now != (conv,):
                    now, number, position = (conv,), 0, 0
                own = ids[o[k] : o[k + 1]]
                numbers.append(number)
                positions.append(position)
                texts.append(render(tokenizer, own))
                number += 1
                position += len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), pa.array(positions, pa.int64()), batch.column(1), batch.column(2), pa.array(texts, pa.string())], ["conv_id", "turn_no", "first_token", "ids", "loss_mask", "formatted"])

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, ids binary, loss_mask binary")
    turns = turns.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "loss_mask")
    return turns.mapInArrow(place, "conv_id long, turn_no long, first_token long, ids binary, loss_mask binary, formatted string")


def render(tokenizer: Tokenizer, ids: np.ndarray) -> str:
    """The formatted text of token ids."""
    out, last = [], 0
    for at in np.flatnonzero(ids >= tokenizer.start).tolist():
        out.append(tokenizer.decode(ids[last:at].tolist()))
        out.append(tokenizer.names[int(ids[at])])
        last = at + 1
    out.append(tokenizer.decode(ids[last:].tolist()))
    return "".join(out)


def read_turn(tokenizer: Tokenizer, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str]:
    """(role, text, text under the loss mask) from the tokens of one turn."""
    sep = int(np.flatnonzero(ids == tokenizer.sep)[0])
    role, text = (unescape(tokenizer.decode(part.tolist())) for part in (ids[1:sep], ids[sep + 1 : -1]))
    return role, text, unescape(tokenizer.decode(ids[mask.astype(bool)].tolist()))


def digests(spark: SparkSession, turns: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """For each conversation what its tokens and mask say, read back turn by turn in bounded memory."""
    held = spark.sparkContext.broadcast(vocabulary(vocabulary_path))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]

    def run(batches):
        tokenizer = Tokenizer(held.value)
        now = None
        done: list[list] = []

        def fresh(conv):
            return [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]

        def flush():
            rows = [[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5], r[6], r[7]] for r in done]
            done.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            ids, o = X.unpack(batch.column(1), np.int32)
            masks, _ = X.unpack(batch.column(2), np.int8)
            for k, (conv, shown) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = fresh(conv)
                own, mask = ids[o[k] : o[k + 1]], masks[o[k] : o[k + 1]]
                role, text, loss = read_turn(tokenizer, own, mask)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(shown)
                now[6] += len(own)
                now[7] += int(mask.sum())
            if done:
                yield flush()
        if now is not None:
            done.append(now)
            yield flush()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    return turns.select("conv_id", "ids", "loss_mask", "formatted").mapInArrow(run, schema)
