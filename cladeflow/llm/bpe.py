"""Byte-level BPE: texts to ids and back, with a given vocabulary."""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

# Fixed value: how byte-level vocabularies split text before merging, with L and N for letters and numbers and W for the
# Unicode property White_Space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{W}{L}{N}]+|[{W}]+(?![^{W}])|[{W}]+"

#: Pieces that a worker remembers in each of two generations, and the longest of them; others are merged anew.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48
#: Bits of an id in a packed pair.
PACK = 24
_ID = (1 << PACK) - 1


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where it is visible, else the next free one from U+0100."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _latin(test) -> str:
    """The inside of a character class: the code points below U+0100 that pass a test."""
    return "".join(re.escape(chr(c)) for c in range(256) if test(chr(c)))


@lru_cache(1)
def splitters() -> tuple[re.Pattern, regex.Pattern]:
    """The splitting pattern for texts of code points below U+0100, which the standard library matches faster, and for all."""
    latin = SPLIT.format(
        L=_latin(lambda c: unicodedata.category(c)[0] == "L"), N=_latin(lambda c: unicodedata.category(c)[0] == "N"),
        W=_latin(lambda c: regex.match(r"\p{White_Space}", c)),
    )
    return re.compile(latin), regex.compile(SPLIT.format(L=r"\p{L}", N=r"\p{N}", W=r"\p{White_Space}"))


def split(text: str) -> list[str]:
    narrow, wide = splitters()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return wide.findall(text)
    return narrow.findall(text)


class ByteBpe:
    """A vocabulary in the `tokenizers` file format: a byte-level BPE model without normaliser."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        byte_of = {letter: b for b, letter in letters.items()}
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        #: The ids of single bytes as a table, where they are below 256 as well.
        self.as_ids = bytes(self.byte_ids) if max(self.byte_ids) < 256 else None
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        #: Left and right id of a merge, packed, to its rank and id, packed.
        self.merges = {vocab[x] << PACK | vocab[y]: rank << PACK | vocab[x + y] for rank, (x, y) in enumerate(pairs)}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *added.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(byte_of[letter] for letter in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.added = added
        longest_first = sorted(added, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if added else None
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}

    def merge(self, symbol: list[int]) -> list[int]:
        """Apply merges by rank, leftmost first, on a doubly linked list of symbols, which is changed in place.

        The queue holds (rank, position) of neighbours, packed; `due` has the merge that is possible at a position now,
        so an entry of another rank is stale and skipped.
        """
        n = len(symbol)
        find = self.merges.get
        due = [find(a << PACK | b, -1) for a, b in zip(symbol, symbol[1:])]
        queue = [(m >> PACK) * n + i for i, m in enumerate(due) if m >= 0]
        if not queue:
            return symbol
        due.append(-1)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            rank, i = divmod(pop(queue), n)
            m = due[i]
            if m < 0 or m >> PACK != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            new = symbol[i] = m & _ID
            symbol[j] = due[j] = due[i] = -1
            if k < n:
                before[k] = i
                m = due[i] = find(new << PACK | symbol[k], -1)
                if m >= 0:
                    push(queue, (m >> PACK) * n + i)
            h = before[i]
            if h >= 0:
                m = due[h] = find(symbol[h] << PACK | new, -1)
                if m >= 0:
                    push(queue, (m >> PACK) * n + h)
        return [s for s in symbol if s >= 0]

    def piece(self, piece: str) -> bytes:
        """The ids of one piece, as little-endian 32-bit numbers."""
        ids = self.known_before.get(piece)
        if ids is None:
            data = piece.encode()
            merged = self.merge(list(data.translate(self.as_ids)) if self.as_ids else [self.byte_ids[b] for b in data])
            ids = struct.pack(f"<{len(merged)}i", *merged)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known_before, self.known = self.known, {}
            self.known[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        pieces = split(text)
        out = list(map(self.known.get, pieces))
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = self.piece(pieces[i])
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian 32-bit numbers; strings of added tokens become their ids."""
        if not self.special:
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.int32(self.added[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: list[int]) -> str:
        """Concatenate the vocabulary strings; bytes that form no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")


_LOADED: dict[int, ByteBpe] = {}


def _load(text) -> ByteBpe:
    """One vocabulary for each worker process, made from a broadcast of its file."""
    key = hash(text.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(text.value)
    return _LOADED[key]


def _vocabulary(df: DataFrame, path: str):
    """The file, read once on the driver and sent to the executors: it is as large as the vocabulary, whatever the data."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add `ids` (array<int>): the tokens of every whole text. Null texts count as empty and have no tokens."""
    sent = _vocabulary(df, path)
    schema = df.drop(out).schema.add(out, T.ArrayType(T.IntegerType(), False), False)
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(sent)
        for batch in _parts(batches):
            ids = [bpe.encode(t or "") for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _lists(ids)], names=[*kept, out])

    return df.mapInArrow(run, schema)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches in smaller parts, so that a worker holds the tokens of few texts at once."""
    for batch in batches:
        for i in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(i, rows)


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32()))


def round_trip(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """`encode` and `decode` in one pass over the texts: adds `ids` and `decoded`, and leaves the text out."""
    sent = _vocabulary(df, path)
    kept = [c for c in df.columns if c not in (text_col, "ids", "decoded")]
    schema = df.select(*kept).schema.add("ids", T.ArrayType(T.IntegerType(), False), False).add("decoded", "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(sent)
        for batch in _parts(batches):
            ids = [bpe.encode(t or "") for t in batch.column(text_col).to_pylist()]
            texts = pa.array([bpe.decode(np.frombuffer(x, dtype="<i4").tolist()) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _lists(ids), texts], names=[*kept, "ids", "decoded"])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add `decoded`: the text of the ids. Null ids decode to the empty text."""
    sent = _vocabulary(df, path)
    schema = df.drop(out).schema.add(out, "string", False)
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(sent)
        for batch in _parts(batches):
            texts = pa.array([bpe.decode(x.values.tolist() if x.is_valid else []) for x in batch.column(ids_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], texts], names=[*kept, out])

    return df.mapInArrow(run, schema)
