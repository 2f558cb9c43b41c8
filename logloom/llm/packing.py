"""Sequence packing by Karmarkar-Karp multiway differencing.

A document's ids (with its end id) are cut into full windows and one rest; a rest longer than `piece` ids
is cut into near-equal pieces. Pieces gather in blocks of about `windows` windows. In a block of T ids,
k starts at ceil(T / capacity). Every piece starts as a partial partition with one loaded subset of k;
the two partial partitions with the largest imbalance are merged, heaviest subset against lightest, until
one is left. If its heaviest window exceeds the capacity, k rises by one and the block is differenced
again. A map-only operator: no shuffle, and a task holds one block of piece descriptors, never the ids.

Sequence ids are the task's partition number times 2^33 plus a counter, unique and stable for the same input.

Defined results: null text counts as empty and is one piece holding the end id; repeated rows are packed
each; null ids are kept; a text longer than a window spans several; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import string
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from logloom.llm.common import batches, ddl, id_and_text, keep, record_batch, release

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


#: The printable character that stands for each byte in byte-level vocabularies.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Bytes of text that are encoded at a time.
STEP_BYTES = 2 << 20


class WordEncoder:
    """Ids of texts from ids of their chunks between ASCII spaces.

    Sound for tokenizers that drop white space, never look across it and mark the end of a word in its last
    id, as the default one does: its normaliser composes and lower-cases character by character, its splitter
    never keeps white space, keeps runs of letters whole and parts them from punctuation. Arrow splits a batch
    and numbers its distinct chunks; only those are looked up, and numpy gathers the ids. New words of composed
    letters go to the tokenizer's model many at a time, parted again at their end marks, with closing
    punctuation learned apart; everything else goes to the tokenizer. Two generations of remembered chunks,
    bounded in number and in bytes, keep frequent ones.
    """

    CLOSING = string.punctuation.encode()
    END, EMPTY = 0, 1
    #: Words that go to the tokenizer at a time: what it returns is some hundred bytes a token.
    AT_ONCE = 16_000

    def __init__(self, tokenizer_path: str, end_id: int, remember: int = 400_000, remember_bytes: int = 8 << 20) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(tokenizer_path)
        self.encode = tokenizer.encode_batch_fast
        plain = Tokenizer(tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.encode_words = plain.encode_batch_fast
        suffix = tokenizer.model.end_of_word_suffix
        if not suffix:
            raise ValueError("the tokenizer's model marks no word ends")
        vocabulary = plain.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
        self.end_id, self.remember, self.remember_bytes = end_id, remember, remember_bytes
        self.young: dict[bytes, int] = {}
        self._start_generation(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _start_generation(self, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Slots END and EMPTY, then the young chunks, which become the old ones."""
        # numbered anew in place, so that never three generations lie in memory
        self.old, self.young, self.young_bytes = self.young, {b"": self.EMPTY}, 0
        for slot, w in enumerate(self.old, 2):
            self.old[w] = slot
        self.sizes = np.concatenate(([1, 0], sizes))
        self.ids = np.concatenate((np.array([self.end_id], np.uint32), _gather(ids, starts, sizes)))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The unsigned 32-bit ids of all texts (binary), each closed by the end id, and where each text ends."""
        texts = texts.view(pa.string())
        # a marker of a special token counts in its own case only, so such a text stays as it is
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(lowered)
        coded = words.flatten().dictionary_encode()
        slots = self._slots(_values(coded.dictionary))
        ends = np.cumsum(pc.list_value_length(words).to_numpy())
        chunk = np.insert(slots[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64), ends, self.END)
        sizes = self.sizes[chunk]
        out = _gather(self.ids, self.starts[chunk], sizes)
        closed = np.cumsum(sizes)[ends + np.arange(len(ends))]
        if len(self.young) > self.remember or self.young_bytes > self.remember_bytes:
            kept = np.fromiter(self.young.values(), np.int64, len(self.young))
            self._start_generation(self.starts[kept], self.sizes[kept], self.ids)
        return out, closed

    def _slots(self, words: list[bytes]) -> np.ndarray:
        young, old, missing = self.young, self.old, []
        for w in words:
            if w not in young:
                slot = old.get(w)
                if slot is None:
                    missing.append(w)
                else:
                    young[w] = slot
                    self.young_bytes += len(w)
        if missing:
            self._learn(missing)
        return np.fromiter(map(young.__getitem__, words), np.int64, len(words))

    def _learn(self, missing: list[bytes]) -> None:
        young, bases, odd, parted = self.young, {}, {}, []
        for w in missing:
            base = w.rstrip(self.CLOSING)
            # punctuation stands alone after a letter or digit only
            if not base or b"<|" in w or not (base[-1:].isalnum() or base[-1] > 127 and base[-4:].decode("utf-8", "ignore").lower()[-1:].isalpha()):
                odd[w] = None
                continue
            bases[base] = None
            if len(base) < len(w):
                tail = w[len(base) :]
                parted.append((w, base, tail))
                if tail not in young:
                    odd[tail] = None
        bases = [b for b in bases if b not in young]
        ascii_, other = [], []
        for b in bases:
            (ascii_ if b.isalpha() else other).append(b)
        words, names = ascii_, [b.lower().decode() for b in ascii_]
        if other:
            joined = b"\n".join(other).decode("utf-8", "replace")
            composed = is_normalized("NFC", joined)
            # a capital sigma's lower case depends on its neighbours, but not for the tokenizer
            lowered = "".join(map(str.lower, joined)) if "\u03a3" in joined else joined.lower()
            letters = []
            for b, low in zip(other, lowered.split("\n"), strict=True):
                if low.isalpha() and (composed or is_normalized("NFC", low)):
                    words.append(b)
                    letters.append(low)
                else:
                    odd[b] = None
            if letters:
                names += "\n".join(letters).encode().decode("latin-1").translate(BYTE_LEVEL | {10: 10}).split("\n")
        if words:
            ids = []
            for at in range(0, len(names), self.AT_ONCE):
                part = names[at : at + self.AT_ONCE]
                found = self.encode_words([" ".join(part[i : i + 500]) for i in range(0, len(part), 500)], add_special_tokens=False)
                ids += [np.array(e.ids, np.uint32) for e in found]
                del found
            ids = np.concatenate(ids)
            self._add(words, ids, np.diff(np.flatnonzero(self.closes[ids]), prepend=-1))
        odd = [w for w in odd if w not in young]
        if odd:
            each = [np.array(e.ids, np.uint32) for at in range(0, len(odd), self.AT_ONCE) for e in self.encode([w.decode("utf-8", "replace") for w in odd[at : at + self.AT_ONCE]], add_special_tokens=False)]
            self._add(odd, np.concatenate(each), np.array([len(e) for e in each], np.int64))
        if parted:
            pairs = np.array([(young[base], young[tail]) for _, base, tail in parted])
            self._add([w for w, _, _ in parted], _gather(self.ids, self.starts[pairs.ravel()], self.sizes[pairs.ravel()]), self.sizes[pairs].sum(axis=1))

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(sizes) != len(words) or sizes.sum() != len(ids):
            raise ValueError("the tokenizer's word ends do not part its ids")
        self.young_bytes += sum(map(len, words))
        self.young.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words))))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, ids))


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of values that start there, one after the other."""
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    at += np.arange(len(at))
    return values[at]


def _values(strings: pa.Array) -> list[bytes]:
    _, offsets, data = strings.buffers()
    if data is None:
        return [b""] * len(strings)
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist()
    raw = data.to_pybytes()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def _steps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most 1000 rows and, but for single texts, about STEP_BYTES of text."""
    for part in batches(parts, 1000):
        total = np.cumsum(pc.fill_null(pc.binary_length(part.column(1)), 0).to_numpy())
        at = 0
        while at < len(total):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP_BYTES, side="right")))
            yield part.slice(at, end - at)
            at = end


def karmarkar_karp(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of sizes by window; near-equal windows, none above capacity. No size exceeds capacity."""
    total, k = sum(sizes), 1
    k = max(1, -(-total // capacity))
    while True:
        windows = _difference(sizes, k)
        if max((sum(sizes[i] for i in w) for w in windows), default=0) <= capacity:
            return [w for w in windows if w]
        k += 1


def _difference(sizes: list[int], k: int) -> list[list[int]]:
    if k == 1:
        return [list(range(len(sizes)))]
    #: Heap of (-imbalance, order, loads ascending above the least, members as nested pairs).
    heap = []
    for order, i in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        loads = np.zeros(k, np.int64)
        loads[-1] = sizes[i]
        members = [None] * (k - 1) + [i]
        heap.append((-sizes[i], order, loads, members))
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a, members_a = heapq.heappop(heap)
        _, _, b, members_b = heapq.heappop(heap)
        loads = a + b[::-1]
        rank = np.argsort(loads, kind="stable")
        loads = loads[rank]
        loads -= loads[0]
        members = []
        for r in rank.tolist():
            x, y = members_a[r], members_b[k - 1 - r]
            members.append(y if x is None else x if y is None else (x, y))
        heapq.heappush(heap, (-int(loads[-1]), order, loads, members))
        order += 1
    return [_flat(m) for m in heap[0][3]]


def _flat(member) -> list[int]:
    out, stack = [], [] if member is None else [member]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            out.append(x)
    return out


def _pack(path: str, end_id: int, capacity: int, piece: int, windows: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one encoder a worker process, so that later tasks find the words of earlier ones
        encoder, block, held = keep(f"encoder {path} {end_id}", lambda: WordEncoder(path, end_id)), [], 0
        base, sequence = TaskContext.get().partitionId() << 33, 0
        out: list[tuple] = []

        def close():
            nonlocal sequence
            for window in karmarkar_karp([p[2] for p in block], capacity):
                offset = 0
                for i in sorted(window):
                    out.append((*block[i], base + sequence, offset))
                    offset += block[i][2]
                sequence += 1
            block.clear()

        for part in _steps(parts):
            ids, ends = encoder(part.column(1))
            release()
            first = 0
            for doc_id, last in zip(part.column(0).to_pylist(), ends.tolist(), strict=True):
                coded, n = ids[first:last], last - first
                first = last
                full = n - n % capacity
                for start in range(0, full, capacity):
                    out.append((doc_id, start, capacity, zlib.crc32(coded[start : start + capacity]), n, base + sequence, 0))
                    sequence += 1
                if rest := n - full:
                    cuts = -(-rest // piece)
                    at = [full + rest * c // cuts for c in range(cuts + 1)]
                    block.extend((doc_id, a, b - a, zlib.crc32(coded[a:b]), n) for a, b in zip(at, at[1:]))
                    held += rest
                if held >= 2 * windows * capacity:
                    # close all but a last part as large as a block, so that no small block is left over
                    later = []
                    while held > windows * capacity:
                        later.append(block.pop())
                        held -= later[-1][2]
                    close()
                    block.extend(reversed(later))
                    held = sum(p[2] for p in block)
            if out:
                yield record_batch(PIECES, list(zip(*out, strict=True)))
                out.clear()
        close()
        if out:
            yield record_batch(PIECES, list(zip(*out, strict=True)))

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 2048, piece: int = 512, windows: int = 96) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_pack(tokenizer_path, end_id, capacity, piece, windows), ddl(PIECES))
