"""Per-document text statistics, and fixed-threshold rules with a reason for each failure.

The lines, words and characters of all texts of an Arrow batch are counted at once,
on flat arrays. The counts are summed per passage (lines up to one that ends a
sentence, within a block and of one kind: list items or not) and per document. The
rules judge passages; a document is no running text where passages that fail a rule
hold the larger part of its characters.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import map_arrow

# Thresholds of published rule sets for web text (Gopher, C4, FineWeb), for whole documents.
MIN_WORDS, MAX_WORDS = 50, 100_000
MIN_MEAN_WORD, MAX_MEAN_WORD = 3.0, 10.0
MAX_SYMBOL_RATIO = 0.1
MAX_BULLET_LINES = 0.9
MAX_ELLIPSIS_LINES = 0.3
MIN_ALPHA_WORDS = 0.8
MIN_COMMON_WORDS = 2
MIN_PUNCTUATED_LINES = 0.12
MAX_REPEATED_LINE_CHARS = 0.01
MAX_SHORT_LINES, SHORT_LINE = 0.67, 30

# The rules for passages. From the above sets are the mean word length, the least share of common words
# (2 of 50), the words of a line without an end (5), and bullets. A passage is short, so that of its words 0.4 may lack
# letters, not 0.2; symbols are of more kinds and counted against characters, not words.
MIN_LINE_WORDS = 5
MIN_COMMON_SHARE, MIN_OPEN_COMMON_SHARE, MAX_COMMON_SHARE = 0.04, 0.12, 0.75
FEWEST_WORDS_JUDGED, FEWEST_WORDS_REPEATED = 6, 8
MIN_PASSAGE_ALPHA_WORDS = 0.6
MAX_SYMBOL_CHARS = 0.15
MIN_DISTINCT_WORDS, ENOUGH_DISTINCT_WORDS = 0.3, 40
LONGEST_WORD = 30
MIN_SEPARATORS, MAX_WORDS_A_SEPARATOR = 3, 4.5
# The same for scripts without spaces, in characters; function words are written in hiragana there.
MIN_UNSPACED, MIN_HIRAGANA = 0.15, 0.15
MIN_LINE_CHARS, MAX_CHARS_A_SEPARATOR = 15, 10

_BREAKS = regex.compile(r"\r\n|[\r\n\x0b\x0c\x1c-\x1e\x85  ]")
_HIDDEN = regex.compile(r"\p{Cf}+")
_MARKUP = regex.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->|<\|\w{1,40}\|>")
_SENTENCE_SIGNS = ".,;:!?'\"()-–—…。、「」！？’‘“”«»¿¡"
_SEPARATORS = ";,、|；，\t"
_END = r"""[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}]+["'\x{201D}\x{2019}\x{00BB})\]]*"""
_BULLET = r"^([-*+]|\pS|\x{2022}|\x{00B7}|\x{2013}|\x{2014}|[-=]>|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s"
_GAP = r"\S(\t|\s{2,})"
#: A separator right before the next field, which isn't one of a number.
_TIGHT = r"[^\s\d,;|][,;|][^\s,;|]|\d[,;|][^\s,;|\d]|;\S"

RULES = ("bullets", "symbols", "non_alphabetic", "word_length", "few_common_words", "only_common_words", "repeated_words", "short_open_lines", "separators", "columns")

_STATS = (
    "n_words long, mean_word_len double, symbol_ratio double, punctuated_lines double, bullet_lines double, ellipsis_lines double, "
    "short_lines double, alpha_words double, common_share double, n_common long, repeated_line_chars double, prose_share double, main_reason string, passage_reasons string, reasons string"
)


def _share(a, b):
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def _flags(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)


def _counts(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(values, pattern).to_numpy(zero_copy_only=False)


def _codes(values: pa.Array) -> np.ndarray:
    return pc.dictionary_encode(values).indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(values) else np.zeros(0, np.int64)


@dataclass
class _Groups:
    """Sums of values of items, each of which lies in one of ``n`` groups."""

    of: np.ndarray
    n: int

    def sum(self, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.of, values, self.n) if len(self.of) else np.zeros(self.n)

    def distinct(self, codes: np.ndarray) -> np.ndarray:
        width = int(codes.max()) + 1 if len(codes) else 1
        return np.bincount(np.unique(self.of * width + codes) // width, minlength=self.n) if len(codes) else np.zeros(self.n)

    def through(self, items: np.ndarray) -> _Groups:
        """The groups of things that lie in the items."""
        return _Groups(self.of[items], self.n)


_CLASSES = ("solid", "hiragana", "unspaced", "separator", "symbol")


@lru_cache(maxsize=1)
def _character_classes() -> np.ndarray:
    """For each code point, the bits of the classes it is in."""
    bits = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        c = chr(point)
        kind = unicodedata.category(c)
        solid = kind[0] != "Z" and not c.isspace()
        unspaced = 0x3040 <= point <= 0x30FF or 0x3400 <= point <= 0x9FFF or 0xAC00 <= point <= 0xD7A3
        symbol = solid and kind[0] not in "LM" and kind != "Nd" and c not in _SENTENCE_SIGNS
        for k, there in enumerate((solid, 0x3041 <= point <= 0x309F, unspaced, c in _SEPARATORS, symbol)):
            bits[point] |= there << k
    return bits


def _class_counts(lines: list[str], chars: np.ndarray) -> dict[str, np.ndarray]:
    """How many characters of each class every line has."""
    if not lines:
        return {c: np.zeros(0, np.int64) for c in _CLASSES}
    bits = _character_classes()[np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.concatenate(([0], np.cumsum(chars)[:-1]))
    return {c: np.add.reduceat((bits >> k) & 1, starts, dtype=np.int64) for k, c in enumerate(_CLASSES)}


def _split(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lines without blank ones, the document of each, and the block of each."""
    lines, docs, blocks, block = [], [], [], -1
    for d, text in enumerate(texts):
        if not text:
            continue
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", _MARKUP.sub(" ", html.unescape(text) if "&" in text else text)))
        fresh = True
        for line in _BREAKS.split(text):
            line = line.strip()
            while line.startswith(">"):
                line = line[1:].lstrip()
            if not line:
                fresh = True
                continue
            block += fresh
            fresh = False
            lines.append(line)
            docs.append(d)
            blocks.append(block)
    return lines, np.array(docs, np.int64), np.array(blocks, np.int64)


def _parts(lines: pa.Array, pattern: str) -> tuple[np.ndarray, pa.Array]:
    """What lies between matches of ``pattern``, and the line of each."""
    lists = pc.split_pattern_regex(lines, pattern)
    at, parts = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    some = pc.not_equal(parts, "")
    return at[some.to_numpy(zero_copy_only=False)], parts.filter(some)


def _failures(s: dict[str, np.ndarray], block: _Groups) -> dict[str, np.ndarray]:
    """Which passages fail each of RULES; ``block`` groups them by block."""
    unspaced = s["unspaced"] >= MIN_UNSPACED * s["solid"]
    words, open_ = s["words"], s["ends"] == 0
    common, mean = _share(s["common"], words), _share(s["word_chars"], words)
    # Function words are missed where a whole block of sentences has too few, or a passage that ends none.
    plain = s["bullets"] == 0
    near_words, near_common = (block.sum(s[c] * plain)[block.of] for c in ("words", "common"))
    few = np.where(open_, common < MIN_OPEN_COMMON_SHARE, (near_words >= FEWEST_WORDS_JUDGED) & (near_common < MIN_COMMON_SHARE * near_words))
    separators = s["separator"] + s["lone_signs"] + s["gaps"]
    listed = np.where(unspaced, s["solid"] <= MAX_CHARS_A_SEPARATOR * (separators + 1), words <= MAX_WORDS_A_SEPARATOR * (separators + 1))
    short = np.where(unspaced, s["solid"] < MIN_LINE_CHARS * s["lines"], words < MIN_LINE_WORDS * s["lines"])
    return {
        "bullets": ~plain,
        "symbols": _share(s["symbol"], s["solid"]) > MAX_SYMBOL_CHARS,
        "non_alphabetic": ~unspaced & (_share(s["alpha_tokens"], s["tokens"]) < MIN_PASSAGE_ALPHA_WORDS),
        "word_length": ~unspaced & ((mean < MIN_MEAN_WORD) | (mean > MAX_MEAN_WORD) | (s["long_token_chars"] > 0.5 * s["solid"])),
        "few_common_words": np.where(unspaced, s["hiragana"] < MIN_HIRAGANA * s["unspaced"], few),
        "only_common_words": ~unspaced & (common > MAX_COMMON_SHARE) & (words >= FEWEST_WORDS_REPEATED),
        "repeated_words": (words >= FEWEST_WORDS_REPEATED) & (s["distinct_words"] < np.minimum(MIN_DISTINCT_WORDS * words, ENOUGH_DISTINCT_WORDS)),
        "short_open_lines": open_ & short,
        "separators": open_ & (separators >= MIN_SEPARATORS) & listed,
        "columns": open_ & (np.maximum(s["gaps"], s["tight"]) >= s["lines"]),
    }


def measure(texts: list[str | None], common: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text; ``common`` holds the common words in lower case."""
    raw, doc, block = _split(texts)
    lines, n, n_docs = pa.array(raw, pa.string()), len(raw), len(texts)
    chars = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, bullets = _flags(lines, _END + r"\s*$"), _flags(lines, _BULLET)
    first = np.ones(n, bool)
    first[1:] = (block[1:] != block[:-1]) | ends[:-1] | (bullets[1:] != bullets[:-1])
    of = np.cumsum(first) - 1
    passage, document = _Groups(of, int(of[-1]) + 1 if n else 0), _Groups(doc, n_docs)

    word_at, words = _parts(pc.utf8_lower(lines), r"[^\pL\pM]+")
    token_at, tokens = _parts(lines, r"\s+")
    is_common = pc.is_in(words, value_set=common).to_numpy(zero_copy_only=False)
    word_len, token_len = (pc.utf8_length(x).to_numpy(zero_copy_only=False) for x in (words, tokens))
    alpha = _flags(tokens, r"\pL")
    per_line = {
        **_class_counts(raw, chars), "chars": chars, "lines": np.ones(n), "bullets": bullets, "ends": _counts(lines, _END + r"(\s|$)"),
        "gaps": _counts(lines, _GAP), "tight": _counts(lines, _TIGHT),
    }
    stats = {c: passage.sum(v) for c, v in per_line.items()}
    by_word, by_token = passage.through(word_at), passage.through(token_at)
    stats |= {"words": by_word.sum(), "common": by_word.sum(is_common), "word_chars": by_word.sum(word_len), "distinct_words": by_word.distinct(_codes(words))}
    stats |= {"tokens": by_token.sum(), "alpha_tokens": by_token.sum(alpha), "lone_signs": by_token.sum(_flags(tokens, r"^[^\pL\pN]$")), "long_token_chars": by_token.sum((token_len > LONGEST_WORD) * token_len)}
    failed = _failures(stats, _Groups(block[first], int(block[-1]) + 1 if n else 0))

    # Per document: the characters in passages that fail each rule, and in those that fail none.
    home = _Groups(doc[first], n_docs)
    total = document.sum(chars)
    hit = np.array([home.sum(stats["chars"] * failed[r]) for r in RULES])
    sound = home.sum(stats["chars"] * ~np.any([failed[r] for r in RULES], axis=0)) if n else np.zeros(n_docs)
    prose_share = _share(sound, total)
    not_prose = (prose_share < 0.5) & (total > 0)
    reasons = [",".join(r for r, x in zip(RULES, hit[:, d]) if x > 0) for d in range(n_docs)]

    d_word, d_token, d_lines = document.through(word_at), document.through(token_at), document.sum()
    n_words = d_word.sum()
    line_codes = _codes(lines)
    again = np.ones(n, bool)
    again[np.unique(doc * (int(line_codes.max()) + 1 if n else 1) + line_codes, return_index=True)[1]] = False
    out = {
        "n_words": n_words.astype(np.int64),
        "mean_word_len": _share(d_word.sum(word_len), n_words),
        "symbol_ratio": _share(document.sum(_counts(lines, r"#|\x{2026}|\.\.\.")), n_words),
        "punctuated_lines": _share(document.sum(ends), d_lines),
        "bullet_lines": _share(document.sum(bullets), d_lines),
        "ellipsis_lines": _share(document.sum(_flags(lines, r"(\x{2026}|\.\.\.)$")), d_lines),
        "short_lines": _share(document.sum(chars <= SHORT_LINE), d_lines),
        "alpha_words": _share(d_token.sum(alpha), d_token.sum()),
        "common_share": _share(d_word.sum(is_common), n_words),
        "n_common": d_word.sum(is_common).astype(np.int64),
        "repeated_line_chars": _share(document.sum(chars * again), total),
        "prose_share": prose_share,
        "main_reason": np.where(not_prose, np.array(RULES, object)[hit.argmax(axis=0)] if n_docs else "", ""),
        "passage_reasons": np.array(reasons, object),
        "not_prose": not_prose,
    }
    whole = {
        "few_words": n_words < MIN_WORDS,
        "many_words": n_words > MAX_WORDS,
        "word_length": (out["mean_word_len"] < MIN_MEAN_WORD) | (out["mean_word_len"] > MAX_MEAN_WORD),
        "symbols": out["symbol_ratio"] > MAX_SYMBOL_RATIO,
        "bullets": out["bullet_lines"] > MAX_BULLET_LINES,
        "ellipses": out["ellipsis_lines"] > MAX_ELLIPSIS_LINES,
        "non_alphabetic": out["alpha_words"] < MIN_ALPHA_WORDS,
        "few_common_words": out["n_common"] < MIN_COMMON_WORDS,
        "unpunctuated_lines": out["punctuated_lines"] < MIN_PUNCTUATED_LINES,
        "short_lines": out["short_lines"] > MAX_SHORT_LINES,
        "repeated_lines": out["repeated_line_chars"] > MAX_REPEATED_LINE_CHARS,
        "not_prose": not_prose,
    }
    out["reasons"] = np.array([",".join(r for r, x in whole.items() if x[d]) for d in range(n_docs)], object)
    return out


def text_quality(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of each text, and the names of the rules that it fails.

    ``passage_reasons`` lists the rules that a passage fails, ``prose_share`` is the
    share of characters in passages that fail none, and ``main_reason`` the rule that
    most characters fail where that share is below a half. ``reasons`` lists the
    published rules for whole documents, of which the first fails most short texts,
    and 'not_prose' where there is a main reason. Null, empty and blank texts have zeros and no main reason. ``common_words``
    (lang, word) is sent to each executor; nulls in it are ignored. Its size is
    checked against MOST_COMMON_BYTES. Repeated and null ids are kept.
    """
    words = common_words.where("word is not null").select(F.lower("word").alias("word")).distinct()
    held = words.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    if held > MOST_COMMON_BYTES:
        raise ValueError(f"{held} bytes of common words; a list of function words has some thousand")
    shared = docs.sparkSession.sparkContext.broadcast([r[0] for r in words.collect()])
    names = [c.strip().split(" ")[0] for c in _STATS.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = pa.array([unicodedata.normalize("NFKC", w) for w in shared.value], pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                stats = measure(part[1].to_pylist(), common)
                yield pa.RecordBatch.from_arrays([part[0], *[pa.array(stats[c]) for c in names]], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, F.col(text_col).cast("string").alias("text")), run, f"`{id_col}` {kind}, {_STATS}")


#: Bytes of common words of all languages together.
MOST_COMMON_BYTES = 64 << 20


def not_prose(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col) of the texts whose characters are, by the larger part, in passages that fail a rule."""
    return text_quality(docs, common_words, id_col, text_col).where("main_reason <> ''").select(id_col)
