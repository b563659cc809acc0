"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 6).

The vocabulary's byte strings are mapped to Latin-1 and put into an Aho-Corasick automaton, which gives
the longest token at every position of a piece. From these the encoding is found by backtracking: a
token may follow another only if merging their bytes alone would give these two tokens and no others.
That compatibility is computed once per pair and kept. The result equals applying the merges in rank
order, in time linear in the piece.

Null and empty texts have an empty list of ids.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the pattern by which this vocabulary's authors split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker keeps; beyond that the store starts anew, with the same results.
KEPT_PIECES = 200_000


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = "/opt/tokenizers") -> str:
    """The rank file of a public tokenizer; the folder may also be set as KOLLATE_TOKENIZERS."""
    return os.path.join(os.environ.get("KOLLATE_TOKENIZERS", folder), f"{name}.tiktoken")


def read_ranks(data: bytes) -> list[bytes]:
    """Token bytes by rank of a rank file's content."""
    pairs = (line.split() for line in data.splitlines() if line)
    return [token for _, token in sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)]


class ByteBpe:
    """Encoder of one rank file. Ranks must be complete and in merge order, single bytes first."""

    def __init__(self, data: bytes):
        self.tokens = [t.decode("latin-1") for t in read_ranks(data)]
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(self.tokens):
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.tokens]
        self._shorter: dict[int, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, list[int]] = {}
        self._split = regex.compile(PATTERN).findall
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = []
        for i, token in enumerate(self.tokens):
            self.parts.append(self._parts(i, token))
        self._fits.clear()  # answers given before all merges were known don't hold

    def _parts(self, i: int, token: str) -> tuple[int, int]:
        """The two tokens whose merge is ``token``; a single byte is its own part."""
        left = self.shorter(i)
        while left >= 0:
            right = self.rank.get(token[self.length[left] :], -1)
            if 0 <= right < i and left < i and self._compatible(left, right):
                self.merge[left, right] = i
                return left, right
            left = self.shorter(left)
        return i, i

    def shorter(self, i: int) -> int:
        """The longest token that is a proper prefix of token ``i``; -1 if there is none."""
        found = self._shorter.get(i)
        if found is None:
            token = self.tokens[i]
            found = next((r for n in range(len(token) - 1, 0, -1) if (r := self.rank.get(token[:n])) is not None), -1)
            self._shorter[i] = found
        return found

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b, merged on their own, stay a and b.

        Undoes the merges at the seam, latest first; if the two pieces that meet there would merge before the
        merge that was undone last, the seam could not have survived.
        """
        limit = len(self.tokens) + 1
        merge, parts = self.merge, self.parts
        while True:
            joined = merge.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:
                limit, a, one = a, parts[a][1], a
                if a == one:
                    limit, b, one = b + 1, parts[b][0], b
                    if b == one:
                        return True
            else:
                limit, b, one = b + 1, parts[b][0], b
                if b == one:
                    limit, a, one = a, parts[a][1], a
                    if a == one:
                        return True

    def fits(self, a: int, b: int) -> bool:
        found = self._fits.get((a, b))
        if found is None:
            if len(self._fits) > 4_000_000:
                self._fits.clear()
            found = self._fits[a, b] = self._compatible(a, b)
        return found

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1 of its UTF-8 bytes."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        length = self.length
        for end, i in self.automaton.iter(piece):
            start = end - length[i] + 1
            if longest[start] < 0 or length[longest[start]] < length[i]:
                longest[start] = i
        open_ = bytearray(b"\1") * (n + 1)  # positions from which the rest may still be encoded
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if open_[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = self.shorter(token)
            while token < 0:
                open_[at] = 0
                last = out.pop()
                at -= length[last]
                token = self.shorter(last)
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        kept = self._pieces
        for piece in self._split(text):
            found = kept.get(piece)
            if found is None:
                found = self.piece(piece.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(piece) <= 64:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[piece] = found
            ids += found
        return ids


_encoders: dict[int, ByteBpe] = {}


def encoder(data: bytes) -> ByteBpe:
    """The encoder of a rank file's content; built once per process."""
    key = hash(data)
    if key not in _encoders:
        _encoders[key] = ByteBpe(data)
    return _encoders[key]


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # under 1 MB, whatever the corpus


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; repeated rows stay repeated. No shuffle: texts are encoded where they are read."""
    vocabulary = _vocabulary(docs.sparkSession, path or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary.value)
        for batch in batches:
            ids = pa.array([bpe.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    plain = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return plain.mapInArrow(run, f"key {plain.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def token_counts(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens): only the number of ids leaves the worker."""
    vocabulary = _vocabulary(docs.sparkSession, path or vocabulary_path())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(vocabulary.value)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "n_tokens": [len(bpe.encode(t)) for t in batch["text"]]})

    plain = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return plain.mapInPandas(run, f"key {plain.schema['key'].dataType.simpleString()}, n_tokens long").withColumnRenamed("key", key)
