"""Byte-pair encoding with a segment tree, and decoding.

A piece's adjacent pairs are the leaves of a segment tree that holds ``rank * 2**40 + position``; the
root is then the leftmost pair of lowest rank. A merge rewrites at most three leaves, each in
logarithmic time, and encoding ends when the root holds no mergeable pair, so a piece of n characters
takes O(n log n) whatever its length.

Texts are cut at white space first: neither normalisation (NFC, lower case by character) nor the piece
pattern reaches across it, so a chunk's ids never depend on its neighbours and bounded caches of chunks
and pieces give exactly what the whole text would. The strings of added tokens are cut out of the raw
text before that. Decoding joins the tokens' strings by spaces, as the vocabulary file declares no decoder.

Null text counts as empty: no ids, and empty decoded text. Repeated rows repeat their result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import table

#: Cached chunks and pieces of a worker; a full cache drops what its last half of keys doesn't hold. Longer strings than CACHED_CHARS aren't cached.
CACHED_CHUNKS, CACHED_PIECES, CACHED_CHARS = 400_000, 400_000, 48
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+")  # on chunks, which hold no white space
#: PIECE on lower-case ASCII.
_ASCII_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: White space of the normaliser; str.split() also cuts at the four separators U+001C to U+001F.
_BLANK = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_NEVER = 1 << 62
_SHIFT = 40


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_table() -> dict[int, str]:
    """Latin-1 code point of a byte -> the character that stands for it in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table_ = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in table_):
        table_[b] = chr(256 + n)
    return table_


_BYTES = byte_table()


def byte_level(piece: str) -> str:
    return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTES)


class SegmentTreeBpe:
    """Merges of one vocabulary; ``encode`` takes a byte-level piece."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str) -> None:
        self.vocab, self.suffix = vocab, suffix
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for i, (a, b) in enumerate(merges):
            left, right, made = vocab.get(a), vocab.get(b), vocab.get(a + b)
            if left is not None and right is not None and made is not None:
                self.rank.setdefault((left, right), (i << _SHIFT, made))

    def encode(self, piece: str) -> list[int]:
        """Ids of the piece; characters that the vocabulary lacks give none."""
        if not piece:
            return []
        marks = [*piece[:-1], piece[-1] + self.suffix]
        ids = [i for m in marks if (i := self.vocab.get(m)) is not None]
        n, rank = len(ids), self.rank
        if n < 2:
            return ids
        width = 1
        while width < n - 1:
            width *= 2
        tree = [_NEVER] * (2 * width)
        for i in range(n - 1):
            if (got := rank.get((ids[i], ids[i + 1]))) is not None:
                tree[width + i] = got[0] | i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := tree[1]) != _NEVER:
            i = least & ((1 << _SHIFT) - 1)
            j = after[i]
            ids[i] = rank[ids[i], ids[j]][1]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            tree[width + i] = _NEVER if k >= n or (got := rank.get((ids[i], ids[k]))) is None else got[0] | i
            leaves = [width + i]
            if j < n - 1:
                tree[width + j] = _NEVER
                if (i ^ j) > 1:  # else they have their parent in common
                    leaves.append(width + j)
            if (h := before[i]) >= 0:
                tree[width + h] = _NEVER if (got := rank.get((ids[h], ids[i]))) is None else got[0] | h
                if (h ^ i) > 1:
                    leaves.append(width + h)
            for at in leaves:
                at >>= 1
                while at:
                    a, b = tree[2 * at], tree[2 * at + 1]
                    least = a if a < b else b
                    if tree[at] == least:
                        break
                    tree[at] = least
                    at >>= 1
        return [i for i in ids if i >= 0]


def normalised(chunk: str) -> str:
    """NFC, then lower case character by character (a final sigma has no form of its own)."""
    if chunk.isascii():
        return chunk.lower()
    chunk = unicodedata.normalize("NFC", chunk)
    return "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()


def pieces_of(text: str) -> list[str]:
    """The pieces of a normalised chunk."""
    if text.isascii():
        return [text] if text.isalpha() else _ASCII_PIECE.findall(text)
    return PIECE.findall(text)


class Recent(dict):
    """Values worked out on demand by ``make``. It holds ``most`` keys at most, the last half of them used among these."""

    def __init__(self, most: int, make: Callable[[str], object]) -> None:
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key: str) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if 2 * (len(self) + 1) > self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class ChunkCache(Recent):
    """Chunk -> ``join`` of its pieces' ``finish(ids)``."""

    def __init__(self, encode_piece: Callable[[str], list[int]], finish: Callable[[list[int]], object], join: Callable[[list], object], added: dict[str, int]) -> None:
        super().__init__(CACHED_CHUNKS, self.chunk)
        self.pieces, self.join = Recent(CACHED_PIECES, lambda piece: finish(encode_piece(byte_level(piece)))), join
        self.added = {k: finish([v]) for k, v in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def chunk(self, chunk: str) -> object:
        found, pieces = pieces_of(normalised(chunk)), self.pieces
        return pieces[found[0]] if len(found) == 1 else self.join([pieces[x] for x in found])

    def of(self, text: str | None) -> list:
        """The finished values of all chunks of a text, in order."""
        if not text:
            return []
        get = self.__getitem__
        if self.cut is None or not any(a in text for a in self.added):
            return list(map(get, _chunks(text)))
        out: list = []
        for part in self.cut.split(text):
            out += [self.added[part]] if part in self.added else map(get, _chunks(part))
        return out


def _chunks(text: str) -> list[str]:
    if any(c in text for c in _SEPARATORS):
        return [c for c in _BLANK.split(text) if c]
    return text.split()


def joined(parts: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    """(number of ids, ids, tokens) of parts of a text; those without ids leave no blank."""
    parts = [p for p in parts if p[0]]
    return sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])


class Codec:
    """Encoder and decoder of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bpe = SegmentTreeBpe(model["vocab"], merges, model["end_of_word_suffix"] or "")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (model["vocab"] | added).items()}
        self.chunks = ChunkCache(self.bpe.encode, lambda ids: (len(ids), " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids))), joined, added)
        self.ids = ChunkCache(self.bpe.encode, list, lambda parts: [i for x in parts for i in x], added)

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.ids.of(text) for i in part]

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by spaces; unknown ids are skipped."""
        return " ".join(t for i in ids if (t := self.token.get(i)) is not None)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids array<int>, decoded) of every text."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            decoded = [own.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], [key, "n_tokens", "ids", "decoded"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids array<int>, decoded string")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text. Decoded chunks are cached with their ids, as decoding joins by spaces."""
    path = vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path).chunks
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column("text"):
                many, own_ids, tokens = joined(own.of(text.as_py()))
                n.append(many)
                ids.append(hashlib.sha256(own_ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(tokens.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
