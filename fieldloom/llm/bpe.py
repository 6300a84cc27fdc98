"""Byte-level BPE with the tokenizers library over Arrow batches.

The tokenizer writes each of the 256 bytes as a printable character. Encoding
gives ids and, for each, the characters of the text it covers; decoding maps
the printable characters back to bytes, so that a character split over several
tokens comes back whole once its bytes stand together again.

Defined results: a null text counts as empty; an empty text has no id, and the
digests of no bytes; repeated rows are each encoded; ids without bytes (special
tokens, or ids beyond the table) decode to nothing; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.llm.common import map_arrow, narrow, record, slices

#: Bytes that each half of a worker's memo of encoded units takes at most, those of an entry besides its text, and characters of the longest unit in it.
MEMO_BYTES, ENTRY_BYTES, LONG_UNIT = 36 << 20, 200, 64
#: Bytes of text that are split into units at once.
TEXT_BYTES = 1 << 19
#: Units given to the tokenizer at once.
AT_ONCE = 10_000


def byte_of_char() -> dict[str, int]:
    """The printable character of each byte, reversed.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are then ordinary text
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = byte_of_char()
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        self.known = set(vocab.values())
        for token, i in vocab.items():
            if all(c in back for c in token):
                self.bytes_of[i] = bytes(back[c] for c in token)
            else:
                self.known.discard(i)
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.decimals = [b"%d" % i for i in range(len(self.bytes_of))]
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of the ids. An id outside the byte table (a special token, or none at all) has no bytes."""
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        except IndexError:
            return b"".join(self.bytes_of[i] for i in ids if i in self.known)

    def units(self, wanted: set[str]) -> dict[str, bytes]:
        """The ids of each unit as 32-bit integers.

        Units are encoded once and short ones remembered, in two halves: where
        the newer one is full, it takes the place of the older one.
        """
        found, add = {}, []
        for u in wanted:
            v = self.memo.get(u)
            if v is None:
                v = self.before.get(u)
                add.append(u)
            if v is not None:
                found[u] = v
        new = [u for u in add if u not in found]
        for a in range(0, len(new), AT_ONCE):
            part = new[a : a + AT_ONCE]
            for unit, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                found[unit] = array("i", e.ids).tobytes()
        short = [u for u in add if len(u) <= LONG_UNIT]
        size = sum(ENTRY_BYTES + 2 * len(u) for u in short)
        if self.held + size > MEMO_BYTES:
            self.memo, self.before, self.held = {}, self.memo, 0
        if size <= MEMO_BYTES:
            self.memo.update((u, found[u]) for u in short)
            self.held += size
        return found

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text.

        A space between two characters that aren't white space always begins a
        match of the pattern, so what stands between such spaces is encoded by
        itself, once for each distinct unit. Other texts are encoded whole.
        """
        units: list[list[str] | None] = []
        for t in texts:
            s = t.split(" ")
            # No piece is empty, or begins or ends with white space.
            even = all(s) and list(map(str.strip, s)) == s
            units.append(list(map(str.__add__, chain(("",), repeat(" ")), s)) if even else None)
        known = self.units({u for x in units if x for u in x})
        whole = iter(self.tokenizer.encode_batch_fast([t for t, x in zip(texts, units, strict=True) if not x], add_special_tokens=False))
        for x in units:
            yield array("i", b"".join(map(known.__getitem__, x))).tolist() if x else next(whole).ids

    def offsets(self, ids: list[int], data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last, of the text whose bytes are ``data``.

        A token that holds part of a character only covers that character.
        """
        ends = np.cumsum(self.lengths[np.array(ids, dtype=np.int64)])
        begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        place = np.concatenate([[0], np.cumsum(begins)])  # characters begun before each byte
        starts = ends - self.lengths[np.array(ids, dtype=np.int64)]
        inside = np.append(~begins, False)
        return place[starts] - inside[starts], place[ends]


    def split_tokens(self, ids: list[int], data: bytes) -> int:
        """Tokens that begin or end within a character."""
        if data.isascii():
            return 0
        sizes = self.lengths[np.array(ids, dtype=np.int64)]
        ends = np.cumsum(sizes)
        inside = np.append((np.frombuffer(data, np.uint8) & 0xC0) == 0x80, False)
        return int((inside[ends] | inside[ends - sizes]).sum())


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts and ends: token i covers characters starts[i] to ends[i] of the text."""
    schema = pa.schema([("doc_id", pa.int64())] + [(c, pa.list_(pa.int32())) for c in ("ids", "starts", "ends")])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=TEXT_BYTES):
            texts, c = [t or "" for t in part.column(1).to_pylist()], codec(path)
            rows = [(ids, *map(np.ndarray.tolist, c.offsets(ids, t.encode()))) for ids, t in zip(c.encode(texts), texts, strict=True)]
            yield record(schema, part.column(0), *zip(*rows, strict=True))

    return map_arrow(narrow(docs, id_col, text_col).toDF("doc_id", "text"), kernel, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, data (the bytes) and text (malformed bytes become U+FFFD); null ids count as none."""
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary()), ("text", pa.string())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data = [codec(path).decode([i for i in x or [] if i is not None and i >= 0]) for x in part.column(1).to_pylist()]
            yield record(schema, part.column(0), data, [d.decode("utf-8", "replace") for d in data])

    return map_arrow(narrow(encoded, id_col, ids_col).toDF("doc_id", "ids"), kernel, "doc_id long, data binary, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_split of every whole text.

    Each text's ids are decoded again in the same pass. n_split counts the
    tokens that begin or end within a character.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_split", pa.int64())])
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in slices(batches, most=TEXT_BYTES):
            rows = []
            for ids in c.encode([t or "" for t in part.column(1).to_pylist()]):
                data = c.decode(ids)
                rows.append((len(ids), sha(b" ".join(map(c.decimals.__getitem__, ids))), sha(data), c.split_tokens(ids, data)))
            yield record(schema, part.column(0), *zip(*rows, strict=True))

    return map_arrow(narrow(docs, id_col, text_col).toDF("doc_id", "text"), kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")
