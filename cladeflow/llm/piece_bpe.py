"""SentencePiece BPE: texts to ids and back, with a given model, merging many words at once in rounds of array operations.

A text is escaped (spaces become U+2581, one more stands in front) and cut into words before each run of U+2581, which no
piece crosses. The symbols of all words that a worker does not know yet lie in one flat array. In each round every word
merges its pairs of least rank, leftmost first where they overlap; merged symbols are compacted, and finished words leave.

Null texts count as empty: no ids, and the empty text decoded. Other columns are handed through under their own names;
those named like a result are replaced. Repeated rows are encoded each, an empty table gives none.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from cladeflow.llm.bpe import _lists, _parts

# Fixed values of the model format: the escaped space; the kinds of pieces; the number of the BPE kind of model.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2

#: Words that a worker remembers in each of two generations, the longest of them, and code points merged in one go.
REMEMBERED, REMEMBERED_CHARS, AT_ONCE = 200_000, 48, 1 << 18
#: Symbols of a run beyond which a queue replaces rounds that could merge one pair each only.
QUEUE_FROM = 64
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NO_PAIR = np.int32(2**31 - 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one message in the protocol-buffer wire format: number, and an integer or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _one_replacement_a_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one_replacement_a_byte", _one_replacement_a_byte)


class PieceBpe:
    """A SentencePiece model of the BPE kind with byte fallback and without a normalisation table."""

    def __init__(self, model: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3) != BPE_MODEL or not trainer.get(35) or trainer.get(24) or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only BPE models with byte fallback, spaces in front and without user-defined or unused pieces are read")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("only models that escape spaces, keep all of them and normalise nothing are read")
        self.prefix = SPACE if normaliser.get(3, 1) else ""
        normal = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        if any(a != SPACE and b == SPACE for text in normal for a, b in zip(text, text[1:])):
            raise ValueError("a piece goes on after a space that follows other characters: words cannot be cut there")
        self.size = len(pieces)
        self.bytes = [b""] * self.size
        self.byte_ids = np.zeros(256, dtype=np.int32)
        #: Pieces that start with an escaped space; in the bytes of pieces it is a space, while three byte pieces may still spell it.
        self.opens = set()
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                byte = int(text[3:5], 16)
                self.byte_ids[byte], self.bytes[i] = i, bytes([byte])
            elif kind == UNKNOWN:
                self.bytes[i] = trainer.get(44, " ⁇ ".encode())
            elif kind != CONTROL:
                self.bytes[i] = text.replace(SPACE, " ").encode()
                if text.startswith(SPACE):
                    self.opens.add(i)
        self._tables(normal, np.array([score for _, score, _ in pieces]))
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}

    def _tables(self, normal: dict[str, int], scores: np.ndarray) -> None:
        # Characters that stand in longer pieces only get symbols beyond the ids.
        chars = sorted({c for text in normal for c in text})
        symbol = dict(normal)
        for c in chars:
            symbol.setdefault(c, self.size + len(symbol) - len(normal))
        self.symbols = self.size + len(symbol) - len(normal)
        self.char_symbol = np.full(0x110000, -1, dtype=np.int32)
        self.char_symbol[[ord(c) for c in chars]] = [symbol[c] for c in chars]
        #: Greater scores merge first; equal ones share a rank.
        self.rank = np.full(self.symbols, _NO_PAIR, dtype=np.int32)
        ids = np.fromiter(normal.values(), dtype=np.int64)
        self.rank[ids] = np.unique(-scores[ids], return_inverse=True)[1]
        left, right, merged = [], [], []
        for text, i in normal.items():
            for cut in range(1, len(text)):
                x, y = symbol.get(text[:cut]), symbol.get(text[cut:])
                if x is not None and y is not None:
                    left.append(x), right.append(y), merged.append(i)
        left, right, merged = (np.array(x, dtype=np.int64) for x in (left, right, merged))
        order = np.argsort(left * self.symbols + right)
        self.pair_keys, self.pair_merged = (left * self.symbols + right)[order], merged[order].astype(np.int32)
        #: Symbols after whose making a neighbouring pair may come before, or at the same time as, pairs of their own rank.
        self.early = np.zeros(self.symbols, dtype=bool)
        for part in (left, right):
            own = self.rank[part]
            self.early[part[(self.rank[merged] <= own) & (own < _NO_PAIR)]] = True
        adjacent = {(ord(a) << 21) | ord(b) for text in normal for a, b in zip(text, text[1:])}
        self.adjacent = np.array(sorted(adjacent), dtype=np.int64)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair of symbols merges to, -1 for none."""
        keys = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_merged[at], -1)

    def _queue(self, symbol: list[int]) -> list[int]:
        """Merge one run of symbols by a queue of (rank, place); for ties of rank that rounds would take out of order."""
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due: list[int] = [-1] * n
        queue: list[tuple[int, int]] = []

        def offer(i: int) -> None:
            if i >= 0:
                due[i] = -1
                if after[i] < n:
                    due[i] = int(self._merged(np.array([symbol[i]]), np.array([symbol[after[i]]]))[0])
                    if due[i] >= 0:
                        heapq.heappush(queue, (int(self.rank[due[i]]), i))

        for i in range(n - 1):
            offer(i)
        while queue:
            rank, i = heapq.heappop(queue)
            if due[i] < 0 or self.rank[due[i]] != rank:
                continue
            j = after[i]
            symbol[i], after[i], due[j], symbol[j] = due[i], after[j], -1, -2
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return symbol

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        symbol, place = self._rounds(code, np.concatenate([[0], ends[:-1]]))
        plain = (symbol >= 0) & (symbol < self.size)
        length = np.ones(len(symbol), dtype=np.int64)
        encoded = [chr(c).encode() for c in code[place[~plain]]]
        length[~plain] = [len(e) for e in encoded]
        ids = np.repeat(np.where(plain, symbol, 0), length).astype("<i4")
        ids[np.repeat(~plain, length)] = self.byte_ids[np.frombuffer(b"".join(encoded), dtype=np.uint8)]
        upto = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(place, ends)]
        flat, bounds = ids.tobytes(), (upto * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *bounds], bounds)]

    def _rounds(self, code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left when no pair merges, and the places of their first characters.

        Runs are words, cut further between characters that are neighbours in no piece.
        """
        symbol, place = self.char_symbol[code], np.arange(len(code))
        pairs = (code[:-1] << 21) | code[1:]
        at = np.minimum(np.searchsorted(self.adjacent, pairs), len(self.adjacent) - 1)
        first = np.concatenate([[True], self.adjacent[at] != pairs]) if len(code) else np.zeros(0, dtype=bool)
        first[starts] = True
        run = np.cumsum(first)

        def merged_at(i: np.ndarray) -> np.ndarray:
            """What the symbols at places i merge to with the next one of their run."""
            following = np.minimum(i + 1, len(symbol) - 1)
            joined = (i + 1 < len(symbol)) & (run[i] == run[following])
            return np.where(joined, self._merged(symbol[i], symbol[following]), -1)

        merged = merged_at(place)
        done = []
        while len(symbol):
            rank = np.where(merged >= 0, self.rank[merged], _NO_PAIR)
            heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            sizes = np.diff(np.append(heads, len(run)))
            least = np.repeat(np.minimum.reduceat(rank, heads), sizes)
            chosen = (rank == least) & (rank < _NO_PAIR)
            # In a row of overlapping pairs every second one merges, from the left.
            index = np.arange(len(chosen))
            row_start = np.maximum.accumulate(np.where(chosen & ~np.concatenate([[False], chosen[:-1]]), index, 0))
            take = chosen & ((index - row_start) % 2 == 0)
            early = take & self.early[np.maximum(merged, 0)]
            odd = np.zeros(len(run), dtype=bool)
            if early.any():
                # Only the leftmost merge of such a run is safe; long runs are left to the queue.
                hasty = np.logical_or.reduceat(early, heads)
                slow = np.flatnonzero(hasty & (sizes > QUEUE_FROM))
                for h, size in zip(heads[slow], sizes[slow]):
                    left = np.array(self._queue(symbol[h : h + size].tolist()), dtype=np.int32)
                    done.append((left[left != -2], place[h : h + size][left != -2]))
                    odd[h : h + size] = True
                so_far = np.cumsum(take)
                nth = so_far - np.repeat((so_far - take)[heads], sizes)
                take &= (nth == 1) | ~np.repeat(hasty, sizes)
            over = (least == _NO_PAIR) & ~odd
            if over.any():
                done.append((symbol[over], place[over]))
            symbol = np.where(take, merged, symbol)
            gone = np.concatenate([[False], take[:-1]])
            keep = ~(gone | odd | over)
            fresh = take[keep]
            symbol, place, run, merged = symbol[keep], place[keep], run[keep], merged[keep]
            touched = np.flatnonzero(fresh | np.concatenate([fresh[1:], [False]]))
            merged[touched] = merged_at(touched)
        if not done:
            return symbol, place
        symbol, place = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place, kind="stable")
        return symbol[order], place[order]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, merged in goes of bounded size; short ones are remembered."""
        found, go, chars = {}, [], 0
        for i, word in enumerate(words):
            go.append(word)
            chars += len(word)
            if chars >= AT_ONCE or i == len(words) - 1:
                found.update(zip(go, self.merge(go)))
                go, chars = [], 0
        for word, ids in found.items():
            if len(word) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.known_before, self.known = self.known, {}
                self.known[word] = ids
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        cut = [_WORDS.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        ids = dict.fromkeys(word for words in cut for word in words)
        for known in (self.known_before, self.known):
            ids.update((word, known[word]) for word in ids.keys() & known.keys())
        ids |= self._learn([word for word, found in ids.items() if found is None])
        return [b"".join(map(ids.__getitem__, words)) for words in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that form no UTF-8 become U+FFFD each, escaped spaces are spaces again, but for the one in front."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        first = next((i for i in ids if self.bytes[i]), None)
        if self.prefix and first in self.opens:
            data = data[1:]
        return data.decode("utf-8", errors="one_replacement_a_byte")


_LOADED: dict[int, PieceBpe] = {}


def _load(model) -> PieceBpe:
    """One model for each worker process, made from a broadcast of its file."""
    key = hash(model.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceBpe(model.value)
    return _LOADED[key]


def _model(df: DataFrame, path: str):
    """The file, read once on the driver and sent to the executors: it is as large as the vocabulary, whatever the data."""
    with open(path, "rb") as f:
        data = f.read()
    PieceBpe(data)  # a model that cannot be read is an error here, not in a task
    return df.sparkSession.sparkContext.broadcast(data)


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add `ids` (array<int>): the ids of every whole text, without begin and end."""
    sent = _model(df, path)
    kept = [c for c in df.columns if c != out]
    schema = df.select(*[f"`{c}`" for c in kept]).schema.add(out, T.ArrayType(T.IntegerType(), False), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(sent)
        for batch in _parts(batches):
            ids = bpe.encode([t or "" for t in batch.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _lists(ids)], names=[*kept, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add `decoded`: the text of the ids. Null ids decode to the empty text."""
    sent = _model(df, path)
    kept = [c for c in df.columns if c != out]
    schema = df.select(*[f"`{c}`" for c in kept]).schema.add(out, "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(sent)
        for batch in _parts(batches):
            texts = pa.array([bpe.decode(x.values.tolist() if x.is_valid else []) for x in batch.column(ids_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], texts], names=[*kept, out])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """`encode` and `decode` in one pass over the texts: adds `ids` and `decoded`, and leaves the text out."""
    sent = _model(df, path)
    kept = [c for c in df.columns if c not in (text_col, "ids", "decoded")]
    schema = df.select(*[f"`{c}`" for c in kept]).schema.add("ids", T.ArrayType(T.IntegerType(), False), False).add("decoded", "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(sent)
        for batch in _parts(batches):
            ids = bpe.encode([t or "" for t in batch.column(text_col).to_pylist()])
            texts = pa.array([bpe.decode(np.frombuffer(x, dtype="<i4").tolist()) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _lists(ids), texts], names=[*kept, "ids", "decoded"])

    return df.mapInArrow(run, schema)
