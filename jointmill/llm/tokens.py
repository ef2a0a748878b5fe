"""Encoding with a public byte-level tokenizer, by fragments between forced boundaries."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from jointmill.session import spread

#: Pattern of the tokenizer's words, and the white space it knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: SHA-256 of the vocabulary files made for that pattern.
VOCABULARIES = (
    "306cd27f03c1a714eca7108e03d66b7dc042abe8c258b44c199a7ed9838dd930",
    "316413f0a5497a8219e48697be7faac30a90c0756680c24114266233fba152af",
)
#: Bytes of the largest vocabulary that is sent to the executors.
LARGEST = 64 << 20
#: Fragments longer than this are cut again inside; shorter ones are remembered, so many at most in a worker.
LONG, REMEMBERED = 48, 200_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public tokenizer files of this machine are; JOINTMILL_TOKENIZERS names another folder."""
    own = os.environ.get("JOINTMILL_TOKENIZERS")
    if own:
        return os.path.join(own, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


class _Ids(dict):
    """Fragment to the little-endian int32 bytes of its ids; bounded, with short fragments only."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, fragment: str) -> bytes:
        if len(fragment) > LONG:
            return self.encode(fragment)
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[fragment] = self.encode(fragment)
        return ids


class Encoder:
    """Byte pair encoding of whole texts, fragment by fragment.

    A byte pair that occurs inside no token of the vocabulary can never be merged over, so a cut there is certain; so is one
    at the end of a word of the pattern, as words are encoded on their own. The scanner cuts where white space follows
    anything else: the pattern always ends a word there, and nearly all of these pairs are held by no token either (`held`
    names the few that are, where the word's end alone is the reason). Fragments that are still long are cut at every
    pair between two characters that no token holds. Fragments are encoded on their own and their ids concatenated: the ids
    are those of the text in one piece.

    The pattern belongs to the vocabulary, so one that isn't of VOCABULARIES needs its own; texts are then encoded whole, as
    nothing is known of that pattern's words.
    """

    def __init__(self, vocabulary: str | bytes, pattern: str | None = None):
        import tiktoken

        data = vocabulary if isinstance(vocabulary, bytes) else Path(vocabulary).read_bytes()
        if pattern is None and hashlib.sha256(data).hexdigest() not in VOCABULARIES:
            raise ValueError("a vocabulary that isn't known needs its word pattern")
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.core = tiktoken.Encoding("jointmill", pat_str=pattern or PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.joined = np.zeros((256, 256), bool)
        for t in ranks:
            b = np.frombuffer(t, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.token_bytes[i] = len(t)
        self.certain = pattern is None
        #: Pairs of (last byte of a character, first byte of white space) that a token holds although the scanner cuts there.
        spaces = {c.encode("utf-8")[0] for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c)}
        lasts = [x for x in range(256) if (33 <= x < 127 or 128 <= x < 192)]
        self.held = {(x, y) for x in lasts for y in spaces if self.joined[x, y]}
        self.scan = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+" if self.certain else "(?s:.+)").findall
        self.known = _Ids(self._fragment)
        self.get = self.known.__getitem__

    def _plain(self, fragment: str) -> bytes:
        return np.array(self.core.encode_ordinary(fragment), "<i4").tobytes()

    def cuts(self, raw: bytes) -> np.ndarray:
        """Where a fragment can be cut for certain: pairs no token holds, between characters that aren't white space.

        A cut before an apostrophe could turn it into a contraction, so there is none.
        """
        b = np.frombuffer(raw, np.uint8)
        first, second = b[:-1], b[1:]
        sure = ~self.joined[first, second] & ((second & 0xC0) != 0x80) & (second != 0x27)
        at = np.flatnonzero(sure) + 1
        lead = len(raw) - len(raw.decode("utf-8").lstrip().encode("utf-8"))
        return at[at > lead]

    def _fragment(self, fragment: str) -> bytes:
        if len(fragment) <= LONG or not self.certain:
            return self._plain(fragment)
        raw = fragment.encode("utf-8")
        at = self.cuts(raw)
        if not len(at):
            return self._plain(fragment)
        ends = [0, *at.tolist(), len(raw)]
        parts = [raw[i:j].decode("utf-8") for i, j in zip(ends, ends[1:], strict=False)]
        known = self.known
        return b"".join([known[p] if len(p) <= LONG else self._plain(p) for p in parts])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the text; none for an empty or null one."""
        return np.frombuffer(self.raw_ids(text), "<i4")

    def raw_ids(self, text: str | None) -> bytes:
        return b"".join(map(self.get, self.scan(text))) if text else b""

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.get, self.scan(text)))) // 4 if text else 0


@lru_cache(maxsize=4)
def encoder(vocabulary: str | bytes, pattern: str | None = None) -> Encoder:
    """One encoder a worker and vocabulary, which is a file's path or what the file holds."""
    return Encoder(vocabulary, pattern)


_sent: dict[tuple[str, str], Broadcast] = {}


def sent(spark: SparkSession, path: str | None) -> Broadcast:
    """The vocabulary file, read here and sent to the executors, which need no such file."""
    path = path or vocabulary_path()
    key = spark.sparkContext.applicationId, path
    if key not in _sent:
        data = Path(path).read_bytes()
        if len(data) > LARGEST:
            raise ValueError(f"{path} is too large for a vocabulary")
        _sent[key] = spark.sparkContext.broadcast(data)
    return _sent[key]


def texts_of(column: pa.Array) -> list[str | None]:
    """Python strings; bytes that aren't UTF-8 become replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [x if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def encoded(rows: DataFrame, text: str = "text", path: str | None = None, ids: str | None = "ids", count: str | None = None, pattern: str | None = None) -> DataFrame:
    """rows without the text, with the ids of the whole text (array of int) and/or their number (long).

    Columns that already bear the name of a result are replaced.

    Defined results: null and empty texts have no ids (an empty array, a count of 0); the strings of special tokens are
    ordinary text; white space, damaged characters and repeated rows are encoded like anything else. Texts of any
    length are encoded whole. An unknown vocabulary without its `pattern` is refused. Rows aren't shuffled unless there are fewer partitions than cores.
    """
    vocabulary = sent(rows.sparkSession, path)
    kept = [c for c in rows.columns if c not in (text, ids, count)]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c in kept), *([f"`{ids}` array<int>"] if ids else []), *([f"`{count}` bigint"] if count else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary.value, pattern)
        for batch in batches:
            texts = texts_of(batch.column(text))
            columns = [batch.column(c) for c in kept]
            if ids:
                raw = [own.raw_ids(t) for t in texts]
                ends = np.zeros(len(raw) + 1, np.int64)
                np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // 4, out=ends[1:])
                values = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values))
                if count:
                    columns.append(pa.array(np.diff(ends)))
            elif count:
                columns.append(pa.array(np.fromiter(map(own.count, texts), np.int64, len(texts))))
            yield pa.RecordBatch.from_arrays(columns, [*kept, *([ids] if ids else []), *([count] if count else [])])

    return spread(rows).mapInArrow(run, schema)
