"""Exact byte-pair encoding of a corpus with a public vocabulary, by backtracking.

The encoder takes the longest token at each position and keeps it if it and the
token before it can stand side by side, that is, if merging their bytes would
never join across the boundary. Otherwise it tries the next shorter token, and,
where there is none, takes the last token back. Positions found impossible are
remembered, so that the time is linear in the text. Decoding copies the tokens'
bytes from one block by an offset table.
"""

from __future__ import annotations

import ast
import base64
import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import map_arrow

#: Where the vocabulary files lie unless a path is given.
TOKENIZER_DIR = "/opt/tokenizers"
DEFAULT_VOCABULARY = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
#: Pieces kept encoded per worker, and the longest piece that is kept.
CACHE_PIECES, CACHE_CHARS = 1 << 17, 48
#: Texts above this many characters are cut into pieces one by one.
STREAM_CHARS = 1 << 20


@dataclass
class Vocabulary:
    """Tokens in order of rank: their bytes, and the two tokens that each was merged from."""

    pattern: str
    blob: bytes
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray
    digest: str

    def token(self, i: int) -> bytes:
        return self.blob[self.offsets[i] : self.offsets[i + 1]]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def decode(self, ids) -> bytes:
        """The bytes of ``ids``; ids outside the vocabulary raise ValueError."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self)):
            raise ValueError("an id is outside the vocabulary")
        blob, at = self.blob, self.offsets.tolist()
        return b"".join([blob[at[i] : at[i + 1]] for i in ids.tolist()])


@dataclass
class Encoder:
    vocabulary: Vocabulary
    pairs: dict[tuple[int, int], int] = field(default_factory=dict)
    beside: dict[tuple[int, int], bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.left, self.right = v.left.tolist(), v.right.tolist()
        tokens = [v.token(i) for i in range(len(v))]
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.lengths = [len(t) for t in tokens]
        self.tokens = tokens
        self.prefix: dict[int, int] = {}
        self.pairs = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a >= 0}
        self.matches = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.matches.add_word(t.decode("latin-1"), i)
        self.matches.make_automaton()
        self.pieces = regex.compile(v.pattern)
        self.cache: dict[str, array] = {}

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) >= 1 << 20:
                self.beside.clear()
            known = self.beside[key] = _stays_apart(a, b, self.pairs, self.left, self.right)
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        found = self.prefix.get(token)
        if found is None:
            t, found = self.tokens[token], -1
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in self.ranks:
                    found = self.ranks[t[:n]]
                    break
            self.prefix[token] = found
        return found

    def encode_piece(self, piece: bytes) -> array:
        whole = self.ranks.get(piece)
        if whole is not None:
            return array("i", (whole,))
        n, lengths = len(piece), self.lengths
        longest = [0] * n
        for end, token in self.matches.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # later ends are longer
        possible = bytearray(b"\x01" * (n + 1))
        out, at, token = array("i"), 0, longest[0]
        while True:
            end = at + lengths[token]
            if possible[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = self.shorter(token)
            while token < 0:
                possible[at] = 0
                token = out.pop()
                at -= lengths[token]
                token = self.shorter(token)

    def encode(self, text: str | None) -> array:
        """The ids of ``text``; none for null and empty texts."""
        out = array("i")
        if not text:
            return out
        cache = self.cache
        pieces = self.pieces.findall(text) if len(text) <= STREAM_CHARS else (m.group() for m in self.pieces.finditer(text))
        for piece in pieces:
            ids = cache.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= CACHE_CHARS:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)
        return out


def _stays_apart(a: int, b: int, pairs: dict[tuple[int, int], int], left, right) -> bool:
    """Whether the merges of two neighbouring tokens never join across their boundary.

    Merges happen in order of rank. Going back through both tokens' merges, latest
    first, a pair on the boundary that has a token of lower rank than the merges
    undone so far would have been merged instead.
    """
    limit = 1 << 62
    while True:
        joined = pairs.get((a, b))
        if joined is not None and joined < limit:
            return False
        # Undo the later of the two tokens; on a tie, the left one was merged first.
        if a > b and left[a] >= 0 or left[b] < 0:
            if left[a] < 0:
                return True
            limit, a = a, right[a]
        else:
            limit, b = b + 1, left[b]


def _stated_pattern(module: Path) -> str:
    """The text that a module assigns to PATTERN, read without running the module."""
    for node in ast.parse(module.read_text(encoding="utf-8")).body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "PATTERN" for t in node.targets):
            return ast.literal_eval(node.value)
    raise ValueError(f"{module} states no PATTERN; give one")


@lru_cache(maxsize=8)
def load_vocabulary(path: str = DEFAULT_VOCABULARY, pattern: str | None = None) -> Vocabulary:
    """A vocabulary from a rank file (base64 token and rank in each line).

    ``pattern`` cuts texts into pieces before merging; by default, what the
    module beside the file states as PATTERN. Each token's two halves are found from the ranks.
    """
    if pattern is None:
        pattern = _stated_pattern(Path(path).resolve().parent / "__init__.py")
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    tokens = [t for _, t in ranked]
    ranks = {t: i for i, t in enumerate(tokens)}
    left, right = np.full(len(tokens), -1, np.int32), np.full(len(tokens), -1, np.int32)
    pairs: dict[tuple[int, int], int] = {}
    halves_l, halves_r = [-1] * len(tokens), [-1] * len(tokens)
    for i, t in enumerate(tokens):
        for n in range(1, len(t)):
            a, b = ranks.get(t[:n], i), ranks.get(t[n:], i)
            if a < i and b < i and _stays_apart(a, b, pairs, halves_l, halves_r):
                pairs[a, b] = i
                halves_l[i], halves_r[i] = a, b
                break
        if len(t) > 1 and halves_l[i] < 0:
            raise ValueError(f"token {i} isn't made of two lower ones")
    left[:], right[:] = halves_l, halves_r
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
    blob = b"".join(tokens)
    digest = hashlib.sha256(pattern.encode() + offsets.tobytes() + blob).hexdigest()
    return Vocabulary(pattern, blob, offsets, left, right, digest)


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder of this vocabulary, kept from task to task."""
    if vocabulary.digest not in _encoders:
        _encoders.clear()
        _encoders[vocabulary.digest] = Encoder(vocabulary)
    return _encoders[vocabulary.digest]


def _share(df: DataFrame, path: str):
    # The vocabulary has the fixed size of its file, so it is sent once to each executor.
    return df.sparkSession.sparkContext.broadcast(load_vocabulary(path))


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col): each row's token ids, without special tokens.

    Null and empty texts give an empty list; marks of special tokens are plain
    text; repeated and null ids come out as they are. Texts of any length are
    encoded whole. No shuffle.
    """
    shared = _share(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode
        for batch in batches:
            flat, offsets = array("i"), [0]
            for text in batch[1]:
                flat.extend(encode(text.as_py()))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch[0], ids], names=[id_col, ids_col])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, F.col(text_col).cast("string").alias("text")), run, f"`{id_col}` {kind}, `{ids_col}` array<int>")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, count_col: str = "n_tokens") -> DataFrame:
    """(id_col, count_col): the number of each row's token ids; 0 for null and empty texts."""
    shared = _share(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode
        for batch in batches:
            n = [len(encode(t.as_py())) for t in batch[1]]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(n, pa.int64())], names=[id_col, count_col])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, F.col(text_col).cast("string").alias("text")), run, f"`{id_col}` {kind}, `{count_col}` long")


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY, text_col: str = "text") -> DataFrame:
    """(id_col, text_col): the text of each list of ids; '' for empty lists, null for null ones."""
    shared = _share(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts = [None if ids.as_py() is None else v.decode(ids.values.to_numpy()).decode("utf-8", "replace") for ids in batch[1]]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(texts, pa.string())], names=[id_col, text_col])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_arrow(encoded.select(id_col, ids_col), run, f"`{id_col}` {kind}, `{text_col}` string")
