"""Column functions on residue strings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F

# The alphabets whose order gives each residue its code, and the complement of each DNA code letter.
DNA_VOCAB = "ACYWSKDVNTGRMHB"
DNA_COMPLEMENT = "TGRWSMHBNACYKDV"
AA_VOCAB = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PAD = "N"


def clean_dna(seq: Column) -> Column:
    """Upper-case IUPAC letters; every other character becomes N."""
    return F.regexp_replace(F.upper(seq), f"[^{DNA_VOCAB}]", PAD)


def clean_protein(seq: Column) -> Column:
    return F.regexp_replace(F.upper(seq), "[^A-Z]", "X")


#: Residues, or codes, that are worked on at a time: what a function needs beside a batch does not grow with the batch.
PIECE = 1 << 20


def _over_batches(function, returns: str, size):
    """A column function that works on Arrow batches in pieces of about `PIECE` residues, a single row being the least.

    `function` and `size`, the residues of each row of a batch, are self-contained, so that workers need numpy and arrow only.
    """
    most = PIECE

    def run(values: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        upto = np.cumsum(size(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        if not len(upto) or upto[-1] <= most:
            return function(values)
        parts, first, done = [], 0, 0
        while first < len(upto):
            last = max(first + 1, int(np.searchsorted(upto, done + most, side="right")))
            parts.append(function(values.slice(first, last - first)))
            first, done = last, upto[last - 1]
        return pa.concat_arrays(parts)

    return F.arrow_udf(run, returns)


def _text_bytes():
    """The function from an Arrow column of texts to their lengths in bytes."""

    def size(texts):
        import pyarrow.compute as pc

        return pc.binary_length(texts)

    return size


def _list_lengths():
    def size(lists):
        return lists.value_lengths()

    return size


def _flat():
    """The function from an Arrow column of texts to (bytes, offsets), one byte per character: others than ASCII become 0."""

    def flat(texts):
        import numpy as np
        import pyarrow as pa

        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
        _, ends, data = texts.buffers()
        offsets = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        if len(data) and data.max() >= 128:
            first = (data & 0xC0) != 0x80  # the first byte of a character
            offsets = np.concatenate([[0], np.cumsum(first)])[offsets]
            data = np.where(data < 128, data, 0)[first]
        return data, offsets

    return flat


def encode_seq(seq: Column, alphabet: str = "dna") -> Column:
    """Residues to vocabulary codes, one `tinyint` each, by one table of 256 entries over the bytes of a batch.

    Letters count in either case. Others become N, in proteins X.
    """
    vocab, other = (DNA_VOCAB, PAD) if alphabet == "dna" else (AA_VOCAB, "X")
    table, flat = [vocab.index(chr(b).upper()) if chr(b).upper() in vocab else vocab.index(other) for b in range(128)] + [0] * 128, _flat()

    def encode(texts):
        import numpy as np
        import pyarrow as pa

        data, offsets = flat(texts)
        codes = pa.array(np.array(table, dtype=np.int8)[data])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), codes, mask=texts.is_null() if texts.null_count else None)

    return _over_batches(encode, "array<tinyint>", _text_bytes())(seq)


def decode_seq(codes: Column, alphabet: str = "dna") -> Column:
    """Vocabulary codes back to residues; codes outside the vocabulary, and NULL ones, are left out."""
    vocab = DNA_VOCAB if alphabet == "dna" else AA_VOCAB

    def decode(lists):
        import numpy as np
        import pyarrow as pa

        values, lengths = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        codes = values.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        known = (codes >= 0) & (codes < len(vocab))
        letters = np.frombuffer(vocab.encode(), dtype=np.uint8)[np.where(known, codes, 0)][known]
        ends = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(lengths)])]
        mask = pa.py_buffer(np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
        parts = [mask, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes())]
        return pa.Array.from_buffers(pa.string(), len(lists), parts)

    return _over_batches(decode, "string", _list_lengths())(codes)


def codes_text(codes: Column) -> Column:
    """Codes below 100 as decimal numbers with commas between them."""

    def write(lists):
        import numpy as np
        import pyarrow as pa

        codes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        sizes = np.where(codes < 10, 2, 3)  # digits and a comma
        ends = np.cumsum(sizes)
        data = np.full(ends[-1] if len(ends) else 0, ord(","), dtype=np.uint8)
        data[ends - 2] = ord("0") + codes % 10
        wide = codes >= 10
        data[ends[wide] - 3] = ord("0") + codes[wide] // 10
        # The comma after the last code of a row goes.
        last = np.cumsum(counts)[counts > 0] - 1
        keep = np.ones(len(data), dtype=bool)
        keep[ends[last] - 1] = False
        upto = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
        offsets = upto[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        mask = pa.py_buffer(np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.string(), len(lists), [mask, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes())])

    return _over_batches(write, "string", _list_lengths())(codes)


def revcomp(seq: Column) -> Column:
    """Reverse complement over the IUPAC letters."""
    return F.reverse(F.translate(seq, DNA_VOCAB, DNA_COMPLEMENT))


def pad_seq(seq: Column, width: int, pad: str = PAD) -> Column:
    """Right-pad to `width`; longer sequences stay whole."""
    return F.when(F.length(seq) >= width, seq).otherwise(F.rpad(seq, width, pad))


def one_hot(code: Column, n: int) -> Column:
    """0/1 vector of length `n` with a one at `code`."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == code).cast("int"))


def one_hot_seq(codes: Column, n: int) -> Column:
    """One 0/1 vector per residue code, looked up in the identity matrix; a code outside of it gives zeros."""

    def expand(lists):
        import numpy as np
        import pyarrow as pa

        codes = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        rows = np.vstack([np.eye(n, dtype=np.int32), np.zeros((1, n), dtype=np.int32)])
        vectors = rows[np.where((codes >= 0) & (codes < n), codes, n)]
        inner = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * n), pa.array(vectors.ravel()))
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, inner, mask=lists.is_null() if lists.null_count else None)

    return _over_batches(expand, "array<array<int>>", _list_lengths())(codes)


def kmers(seq: Column, k: int = 4) -> Column:
    """All k-mers at stride 1, as an array; empty when the sequence is shorter than k."""
    # A zero-width match steps through the string once; indexing by position would rescan it for every k-mer.
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), 1)


def canonical_kmer(kmer: Column) -> Column:
    """The lexicographic minimum of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def trim_stop(seq: Column) -> Column:
    """Drop one trailing stop."""
    return F.regexp_replace(seq, r"\*$", "")


def wrap(seq: Column, width: int = 100) -> Column:
    """Break into lines of `width` residues, without a newline at the end."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), r"\n\z", "")


def log_length(seq: Column) -> Column:
    return F.log10(F.length(seq))
