"""Packed exchange: corpus-wide facts about the n-grams of all documents at a few bytes an n-gram.

Documents are dealt into chunks by the hash of their id and text (about `CHUNK_BYTES` of text each), so
rows that share an id, null ids among them, are no hot chunk; rows equal in both do share one. A chunk turns its
n-grams into sorted 64-bit keys and sends every key bucket one row with a packed block of its distinct
keys; a bucket answers every block in the block's own order, a bit or a byte a key; the chunk, met again
by a cogroup on the same exchange of texts, looks its n-grams up. Sorted keys travel as byte planes,
whose leading planes the shuffle's compression removes. Buckets are ranges of a mixed hash, so a frequent
n-gram reaches its bucket once per chunk and none is hot. The numbers of chunks and buckets follow the
bytes of the input, so blocks and tasks keep their size as the corpus grows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import id_and_text

CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 1_500_000
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Grid:
    """texts: (chunk, doc_id, t), to be grouped by chunk; n_bytes: of all texts."""

    texts: DataFrame
    n_bytes: int
    n_chunks: int

    @property
    def n_words(self) -> int:
        return self.n_bytes // 5 + 1

    def buckets(self, keys_a_word: float = 1.0) -> int:
        return max(int(self.n_words * keys_a_word // BUCKET_KEYS) + 1, min(16, self.n_chunks))

    def key_bytes(self, spare_bits: int = 13) -> int:
        """Bytes of a key, so that a chance meeting of two keys stays rare: 2^-spare_bits a key."""
        return min(8, -(-(self.n_words.bit_length() + spare_bits) // 8))


def grid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Grid:
    rows = id_and_text(docs, id_col, text_col)
    n_bytes = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n_chunks = max(n_bytes // CHUNK_BYTES + 1, min(16, n_bytes // (CHUNK_BYTES // 32) + 1))
    chunk = F.pmod(F.xxhash64("doc_id", "t"), F.lit(n_chunks)).cast("int")
    return Grid(rows.select(chunk.alias("chunk"), "doc_id", "t"), n_bytes, n_chunks)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hash(words: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Hash of every window of so many word hashes; as many rows as windows."""
    n = max(0, len(words) - size + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(size):
        acc = acc * np.uint64(factor) + words[j : j + n]
    return mix(acc)


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(NO_ID).to_numpy()


def texts_of(table: pa.Table):
    """The texts one at a time, so that only one is a Python object."""
    for piece in table.column("t").chunks:
        for value in piece:
            yield value.as_py()


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the key space, so sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets starts in sorted keys, and the end."""
    return np.searchsorted(bucket_of(keys, n), np.arange(n + 1, dtype=np.uint64))


def planes(values: np.ndarray, n_bytes: int) -> bytes:
    """The leading n_bytes bytes of 64-bit values, byte plane by byte plane."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T.tobytes()


def from_planes(data: bytes, n_bytes: int) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8).reshape(n_bytes, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :n_bytes] = flat.T
    return out.reshape(-1).view(">u8").astype(np.uint64)


def pack_sorted(keys: np.ndarray, n_bytes: int) -> bytes:
    """The leading n_bytes bytes of ascending 64-bit keys: the planes of their differences, compressed."""
    top = keys >> np.uint64(64 - 8 * n_bytes)
    return zstandard.ZstdCompressor(level=1).compress(planes(np.diff(top, prepend=np.uint64(0)) << np.uint64(64 - 8 * n_bytes), n_bytes))


def unpack_sorted(data: bytes, n_bytes: int) -> np.ndarray:
    steps = from_planes(zstandard.ZstdDecompressor().decompress(data), n_bytes) >> np.uint64(64 - 8 * n_bytes)
    return np.cumsum(steps, dtype=np.uint64) << np.uint64(64 - 8 * n_bytes)


def pack_numbers(values: np.ndarray) -> bytes:
    """Non-negative 64-bit values: byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(planes(values.astype(np.uint64), 8))


def unpack_numbers(data: bytes) -> np.ndarray:
    return from_planes(zstandard.ZstdDecompressor().decompress(data), 8)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def from_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
