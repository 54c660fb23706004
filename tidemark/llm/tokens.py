"""Token ids and counts by the public tokenizers, with caches of what workers have encoded before.

Both tokenizers never merge across the pieces that they cut a text into first, so a piece
is encoded once and its ids or its count are kept. A cache of counts holds at most CACHE
entries and starts anew beyond; one of ids, whose entries are larger and which a worker keeps
through all later stages, has two halves of CACHE // 8 entries and gives up the half that was
not used for longer. Entries longer than LONG characters are not kept.

Texts that contain a special string (such as <|endoftext|>) go to the library whole, which
treats it as its default says.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE, LONG, SLICE = 1_000_000, 64, 1 << 20

#: Unicode white space, as the tokenizers' pattern language has it.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=1)
def byte_level_pattern():
    """How the byte-level tokenizer cuts a text before merging."""
    import regex

    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """Byte-level models write a byte as a letter: printable Latin-1 as itself, the others as the letters from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(0x100 + k) for k, b in enumerate(others)}


def as_letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_byte_letters())


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer without truncation and padding, and its special strings."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, tuple(x.content for x in t.get_added_tokens_decoder().values())


#: A word of Latin-1 letters and ASCII signs, without digits and apostrophes, needs no normalizer but lower case, and is cut into letters and signs.
_EASY = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff!-&(-/:-@\[-`{-~]+\Z")
_RUNS = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[!-&(-/:-@\[-`{-~]+")


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit bytes) of white-space separated words under a tokenizer that ignores white space and case."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer, self.special = tokenizer(path)
        self.merge = self.tokenizer.model.tokenize
        self.before: dict[bytes, bytes] = {}  # the half that is read and not added to
        every = np.arange(max(self.tokenizer.get_vocab().values()) + 1, dtype="<u4").tobytes()
        self.single = [every[k : k + 4] for k in range(0, len(every), 4)]

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, word: bytes, text: str) -> bytes:
        if len(text) > LONG or not _EASY.match(text):
            return self.encode(text)
        runs = _RUNS.findall(text)
        if len(runs) > 1:  # each is a word of its own, with the same ids
            return b"".join([self[run.encode()] for run in runs])
        return b"".join([self.single[x.id] for x in self.merge(text if text.isascii() else as_letters(word))])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            ids = self._encoded(word, text)
            if len(text) > LONG:
                return ids
        if len(self) >= CACHE // 8:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """The ids of a text; a null text is an empty one."""
        if not text:
            return b""
        body = text.encode("utf-8", "replace").lower()
        if b"<|" in body and any(x.lower().encode() in body for x in self.special):
            return self.encode(text)
        return b"".join(b"".join(map(self.__getitem__, part.split())) for part in _white_slices(body))


def _white_slices(body: bytes):
    """A long text in parts of about SLICE bytes, cut at white space."""
    at = 0
    while len(body) - at > SLICE:
        end = at + SLICE
        while end < len(body) and body[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield body[at:end]
        at = end
    yield body[at:] if at else body


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One cache for a worker process."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


class PieceCounts(dict):
    """Token counts of pieces: the shared table of frequent ones first, then this worker's cache, then the library."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer, self.special = tokenizer(path)
        self.merge = self.tokenizer.model.tokenize
        self.frequent: dict[str, int] = {}
        self.find = byte_level_pattern().findall

    def __missing__(self, piece: str) -> int:
        n = len(self.merge(as_letters(piece.encode("utf-8", "replace"))))
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n

    def use(self, frequent: dict[str, int]) -> None:
        if self.frequent is not frequent:
            self.frequent = frequent
            self.update(frequent)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(sum(map(self.__getitem__, self.find(part))) for part in _slices(text))


_BETWEEN = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def _slices(text: str):
    """A long text cut before a space that follows a letter and precedes one: no piece spans such a place."""
    at = 0
    while len(text) - at > SLICE:
        m = _BETWEEN.search(text, at + SLICE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


_piece_counts: dict[str, PieceCounts] = {}


def piece_counts(path: str) -> PieceCounts:
    if path not in _piece_counts:
        _piece_counts[path] = PieceCounts(path)
    return _piece_counts[path]


def frequent_pieces(docs: DataFrame, path: str, text_col: str, size: int, sample_rows: int) -> dict[str, int]:
    """The `size` most frequent pieces of about `sample_rows` sampled texts, with their counts: it decides speed only, never a result."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    total = rows.count()
    if not total:
        return {}
    sample = rows.sample(min(1.0, sample_rows / total), seed=7)

    def pieces(batches):
        find = byte_level_pattern().findall
        for b in batches:
            tally: dict[str, int] = {}
            for text in b.column(0).to_pylist():
                for p in find(text):
                    if len(p) <= LONG:
                        tally[p] = tally.get(p, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["piece", "n"])

    top = sample.mapInArrow(pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    found = [r["piece"] for r in top.collect()]
    counts = PieceCounts(path)
    return {p: counts[p] for p in found}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", table_size: int = 16_384, sample_rows: int = 2_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, without a shuffle.

    A table of at most `table_size` frequent pre-tokens (under 2 MB) is broadcast; other
    pre-tokens are encoded once a worker and kept in its bounded cache.

    Cases: null and empty texts have 0 bytes and tokens; repeated rows are counted each;
    no rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_pieces(docs, path, text_col, table_size, sample_rows))

    def run(batches):
        counts = piece_counts(path)
        counts.use(table.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            n_bytes = [len(t.encode("utf-8", "replace")) if t else 0 for t in texts]
            n_tokens = [counts.count(t) for t in texts]
            n = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), n, pa.array([x > limit for x in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
