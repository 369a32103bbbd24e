"""Token ids of a corpus by a public byte-level vocabulary, and back."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; the files are read from there and never copied.
TOKENIZERS = os.environ.get("CATALITH_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which a text is encoded piece by piece.
LONG_TEXT = 200_000

#: White space (as PATTERN counts it) in runs so long that the library's pattern engine would overflow on them.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")
#: A place where no match of PATTERN can go on: after a letter or digit, before white space or punctuation.
_SAFE = re.compile("(?<=[A-Za-z0-9À-ÖØ-öа-яぁ-ゖァ-ヺ一-龥가-힣])(?=[ \n\r\t.,;:!?()\\[\\]{}\"、。])")
_built: dict[str, object] = {}


class Vocabulary:
    """A rank file. Pickled as its bytes (under 1 MB), built once in each Python worker."""

    def __init__(self, raw: bytes):
        self.raw, self.digest = raw, hashlib.sha256(raw).hexdigest()

    @classmethod
    def load(cls, name: str = "byte_bpe_50k", folder: str | None = None) -> Vocabulary:
        with open(os.path.join(folder or TOKENIZERS, f"{name}.tiktoken"), "rb") as f:
            return cls(f.read())

    @property
    def built(self):
        """(encoding, bytes of each id, their lengths)."""
        if self.digest not in _built:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.raw.splitlines())}
            words = [b""] * (max(ranks.values()) + 1)
            for w, r in ranks.items():
                words[r] = w
            encoding = tiktoken.Encoding(self.digest, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _built[self.digest] = encoding, words, np.fromiter(map(len, words), np.int64, len(words))
        return _built[self.digest]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) < 2000:
            return self.built[0].encode_ordinary(text)
        out, at = [], 0
        for m in _BLANKS.finditer(text):
            self._extend(out, text[at : m.start()])
            # PATTERN takes a run but for its last character, which belongs to the word that follows, if any does.
            at = m.end() - (m.end() < len(text))
            out += self.built[0]._encode_single_piece(text[m.start() : at])
        self._extend(out, text[at:])
        return out

    def _extend(self, out: list[int], text: str) -> None:
        encode = self.built[0].encode_ordinary
        for piece in [text] if len(text) <= LONG_TEXT else safe_pieces(text):
            out += encode(piece)

    def decode_bytes(self, ids) -> bytes:
        words = self.built[1]
        return b"".join([words[i] for i in ids])

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each token."""
        return self.built[2][ids]


def safe_pieces(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Pieces of at least ``size`` characters, cut only where their encodings join to that of the whole text."""
    at = 0
    while at < len(text):
        m = _SAFE.search(text, at + size)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def _flat(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def encode_corpus(docs: DataFrame, doc_id: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """``(doc_id, ids)``: the token ids of each text, without special tokens.

    Empty and null texts have the empty list; strings that look like special tokens are ordinary text; one row for each row, repeated
    ones too. No shuffle: Arrow batches of the scan are encoded where they are read. Texts beyond
    200,000 characters are cut at places no token can span, so the ids are those of the whole text.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = known.value.encode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _flat([encode(t) for t in batch.column(1).to_pylist()])], names=[doc_id, "ids"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text).mapInArrow(encoded, f"`{doc_id}` {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, doc_id: str, ids: str, vocabulary: Vocabulary) -> DataFrame:
    """``(doc_id, data, text)``: the raw bytes of the ids, and as text where they are valid UTF-8 (else null).

    A null list gives nulls, the empty list the empty text; an id outside the vocabulary raises an error.
    """
    known = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def text_of(data: bytes | None) -> str | None:
        try:
            return None if data is None else data.decode()
        except UnicodeDecodeError:
            return None

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = known.value.decode_bytes
        for batch in batches:
            data = [None if x is None else decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(map(text_of, data), pa.string())], names=[doc_id, "data", "text"])

    kind = dict(encoded.dtypes)[doc_id]
    return encoded.select(doc_id, F.col(ids)).mapInArrow(decoded, f"`{doc_id}` {kind}, data binary, text string")
