"""Problem 7: encoding a whole corpus with a public byte-level BPE vocabulary.

A sentencepiece BPE model is written straight from the vocabulary's rank file: each token's bytes are
spelled with the printable stand-ins of the byte-level scheme (`byte_letters`), its score is the
negative rank, normalisation is the identity, and nothing is added in front or taken out. Piece ids are
the ranks. Texts are cut into pre-tokens by the vocabulary's pattern, each pre-token is encoded by the
model, and decoding maps pieces back to bytes.

Defined cases
- a null text and an empty text both have the ids [] (not null); a blank text is encoded as it stands.
- strings of special tokens in a text are ordinary text.
- lone surrogates can't occur in Spark strings; invalid UTF-8 comes in as U+FFFD.
- very long texts are encoded whole; pre-tokens of over LONG_PIECE characters bypass the cache only.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
CACHE = 400_000
#: Bytes of a vocabulary file at most.
MOST_BYTES = 64 << 20
LONG_PIECE = 64


def byte_letters() -> list[str]:
    """The stand-in letter of each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in printable else spare))
        spare += b not in printable
    return letters


def read_ranks(ranks: bytes) -> list[bytes]:
    """The tokens of a rank file in order of rank; ranks must be 0, 1, 2, ... without a gap."""
    found = {int(r): base64.b64decode(t) for t, r in (line.split() for line in ranks.splitlines() if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("the vocabulary's ranks have gaps")
    return [found[i] for i in range(len(found))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: a varint, a 32-bit float or a length-delimited value."""
    if isinstance(value, float):
        import struct

        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto of type BPE whose piece ids are the tokens' ranks; one <unk> follows them."""
    letters = byte_letters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        spelled = "".join(letters[b] for b in token).encode()
        out += _field(1, _field(1, spelled) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    bpe, unk = 2, len(tokens)
    out += _field(2, _field(3, bpe) + _field(40, unk))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Encoder:
    """Encodes texts by a rank file's content; keeps the ids of pre-tokens it has seen, up to CACHE of them."""

    def __init__(self, ranks: bytes) -> None:
        import regex
        import sentencepiece

        self.tokens = read_ranks(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.split = regex.compile(PATTERN).findall
        self.spell = dict(enumerate(byte_letters()))
        self.seen: dict[str, list[int]] = {}

    def _learn(self, pieces: Iterable[str]) -> dict[str, list[int]]:
        new = [p for p in pieces if p not in self.seen]
        spelled = [p.encode("utf-8").decode("latin-1").translate(self.spell) for p in new]
        found = dict(zip(new, self.model.encode(spelled, num_threads=1))) if new else {}
        if len(self.seen) < CACHE:
            self.seen.update((p, i) for p, i in found.items() if len(p) <= LONG_PIECE)
        return found

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = self.split(text)
        new = self._learn(dict.fromkeys(pieces))
        seen = self.seen
        ids: list[int] = []
        for p in pieces:
            ids += seen[p] if p in seen else new[p]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", errors="replace")


def read_file(path: str) -> bytes:
    """A vocabulary file, which is read where the query is made; one of over MOST_BYTES isn't sent to the executors."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} is too large for a vocabulary")
    with open(path, "rb") as f:
        return f.read()


_SENT: dict[tuple[str, str], Broadcast] = {}


def vocabulary(path: str) -> Broadcast:
    """The vocabulary file's content, broadcast once per application, so that no executor needs the file."""
    sc = SparkContext.getOrCreate()
    key = (sc.applicationId, path)
    if key not in _SENT:
        _SENT[key] = sc.broadcast(read_file(path))
    return _SENT[key]


@lru_cache(maxsize=2)
def encoder(ranks: bytes) -> Encoder:
    return Encoder(ranks)


def token_ids(text: Column, path: str = VOCABULARY) -> Column:
    """The ids of each text, array<int>, never null."""
    ranks = vocabulary(path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(ranks.value)
        for texts in batches:
            yield pd.Series([e.encode(t) for t in texts], dtype=object)

    return encode(text)


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """How many ids each text has, int, never null."""
    ranks = vocabulary(path)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(ranks.value)
        for texts in batches:
            yield pd.Series([len(e.encode(t)) for t in texts], dtype="int32")

    return count(text)


def decoded(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of each array of ids; null ids give null."""
    ranks = vocabulary(path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(ranks.value)
        for rows in batches:
            yield pd.Series([None if r is None else e.decode(r) for r in rows], dtype=object)

    return decode(ids)


def encode_corpus(docs: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """key, ids for every row of docs. No shuffle: each file part is encoded where it is read."""
    return docs.select(F.col(key), token_ids(F.col(text), path).alias("ids"))
