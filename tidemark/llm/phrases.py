"""Phrase collocations by Toivonen's method: a sample proposes, full passes count, until the border is closed.

A phrase of words is frequent if it has `least` occurrences; then its parts are frequent
too. A sample of the documents proposes words and pairs (those with two occurrences in it).
A full pass counts, exactly and at once, all words, every pair of two proposed words and
every triple of two proposed pairs: the proposals and their negative border. Where the
border fails - words or pairs are frequent that were not proposed - another pass counts what
their extensions add: pairs and triples that the new border reaches and no pass before it
did. The pass after a failure of words may still find pairs that fail, the one after that
only triples; so two expansions close it at most, and the result is exact whatever the
sample was.

What is proposed is broadcast as a bitmap of `filter_bits` bits over hashes (2 MB for words,
8 MB for pairs as given), never as a list: it does not grow with the corpus. Phrases that
share a bit with a proposed one are counted as well, which costs rows and changes nothing.
A task counts words by numbers of its own (exact), at most BUFFER occurrences at a time, and
hands over sums; the shuffles add sums. Words go through shuffles as 64-bit hashes with their
strings once each; two words of one hash are found, and the run repeats with another seed.

Cases: null texts are empty; a null lang is `und`; repeated rows count each; words and texts
may have any length, a long text is cut between words and goes on with its last two; no rows
give no rows; columns other than lang and text are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidemark.llm.common import bounded_batches, staged
from tidemark.llm.shingles import mixed

#: Occurrences and distinct words that a task holds before it hands over sums; bytes of text that are cut into words at once; rows of a batch.
BUFFER, VOCABULARY, SLICE, ROWS = 750_000, 1 << 16, 1 << 17, 1 << 15
SIGNS = b".,;:!?\n\x0b\x0c\r"
_END = bytes.maketrans(SIGNS, b"\xff" * len(SIGNS))  # \xff is in no UTF-8 text: it ends a piece
_CUT = re.compile(rb"[ \t\xff" + SIGNS + rb"]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_COUNTED = "k int, key binary, n long"


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(first * _ODD + second)


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(65 - (len(bitmap) * 8).bit_length())
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _Numbers(dict):
    """Numbers of a language's words within a counter; 0 ends a piece."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]):
        super().__init__({b"\xff": 0})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self.names.append((self.lang, word))
        i = self[word] = len(self.names)
        return i


class Counter:
    """Counts of one task: words (if asked for), and the pairs and triples that the last of `borders` reaches and none before it.

    A border is two bitmaps, of words and of pairs; a pair is reached if both words are in
    the first, a triple if both pairs are in the second. Without borders all pairs are counted and no triples.
    """

    def __init__(self, seed: int, borders: list[tuple[np.ndarray, np.ndarray]], words: bool):
        self.seed, self.borders, self.words = seed, borders, words
        self.codes: tuple[list, list, list] = ([], [], [])
        self.held = 0
        self._forget()

    def _forget(self) -> None:
        self.names: list[tuple[str, bytes]] = []
        self.numbers: dict[str, _Numbers] = {}
        self.hash = np.zeros(1, np.uint64)
        self.known = np.zeros((len(self.borders), 1), bool)
        self.n_known = 1

    def add(self, lang: str, body: bytes):
        """Takes texts of one language, \xff between them; yields batches of sums whenever the buffer is full."""
        at, last = 0, []
        while at < len(body):
            cut = _CUT.search(body, at + SLICE)
            end = cut.start() if cut else len(body)
            found = body[at:end].lower().translate(_END).replace(b"\xff", b" \xff ").split()
            self._take(lang, last, found)
            last, at = (last + found)[-2:], end
            if self.held >= BUFFER or len(self.names) >= VOCABULARY:
                yield from self.sums()

    def _take(self, lang: str, last: list[bytes], found: list[bytes]) -> None:
        """Counts what ends in one of the words `found`, which follow `last`."""
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = _Numbers(lang, self.names)
        old = len(last)
        ids = np.fromiter(map(numbers.__getitem__, last + found), np.int64, old + len(found))
        self._know()
        if self.words:
            self._hold(0, ids[old:][ids[old:] > 0])
        i, j = ids[:-1], ids[1:]
        pair, triple = (i > 0) & (j > 0), None
        if self.borders:
            in_words = [pair & known[i] & known[j] for known in self.known]
            at = np.flatnonzero(in_words[-1])  # words of a pair in the border are in it too
            h = pair_hash(self.hash[i[at]], self.hash[j[at]])
            in_pairs = np.zeros((len(self.borders), len(pair)), bool)
            for k, (_, bitmap) in enumerate(self.borders):
                in_pairs[k, at] = in_bitmap(bitmap, h) & in_words[k][at]
            pair = _newly(in_words)
            triple = np.flatnonzero(_newly([x[:-1] & x[1:] for x in in_pairs]))
            triple = triple[triple >= old - 2]
            self._hold(2, ids[triple] << 42 | ids[triple + 1] << 21 | ids[triple + 2])
        at = np.flatnonzero(pair)
        at = at[at >= old - 1]
        self._hold(1, i[at] << 21 | j[at])

    def _know(self) -> None:
        """Hashes and membership in the borders of words that are new."""
        first, n = self.n_known, len(self.names) + 1
        if n == first:
            return
        if n > len(self.hash):
            more = n + VOCABULARY // 4 - len(self.hash)
            self.hash = np.concatenate([self.hash, np.zeros(more, np.uint64)])
            self.known = np.concatenate([self.known, np.zeros((len(self.borders), more), bool)], axis=1)
        own = (lang.encode() + b"\xff" + word for lang, word in self.names[first - 1 :])
        self.hash[first:n] = np.fromiter((xxh3_64_intdigest(x, self.seed) for x in own), np.uint64, n - first)
        for k, (bitmap, _) in enumerate(self.borders):
            self.known[k, first:n] = in_bitmap(bitmap, self.hash[first:n])
        self.n_known = n

    def _hold(self, k: int, codes: np.ndarray) -> None:
        if len(codes):
            self.codes[k].append(codes)
            self.held += len(codes)

    def sums(self):
        """All that is held as batches of (k, key, n); the key of a word is lang, \\xff and the word, that of a longer phrase its words' hashes."""
        for k, parts in enumerate(self.codes):
            if not parts:
                continue
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            for at in range(0, len(codes), ROWS):
                c = codes[at : at + ROWS]
                ids = [c >> 21 * (k - x) & (1 << 21) - 1 for x in range(k + 1)]
                if k == 0:
                    key = pa.array([lang.encode() + b"\xff" + word for lang, word in (self.names[x - 1] for x in ids[0].tolist())], pa.binary())
                else:
                    data = np.stack([self.hash[x] for x in ids], 1)
                    ends = np.arange(0, data.nbytes + 1, data.itemsize * (k + 1), dtype=np.int32)
                    key = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), k + 1, np.int32)), key, pa.array(n[at : at + ROWS])], ["k", "key", "n"])
        self.held = 0
        if len(self.names) >= VOCABULARY:
            self._forget()


def _newly(reached: list[np.ndarray]) -> np.ndarray:
    """What the last border reaches and none before it."""
    new = reached[-1]
    for before in reached[:-1]:
        new = new & ~before
    return new


def counted(docs: DataFrame, seed: int, borders: list, words: bool, keep: str) -> DataFrame:
    """k (words in the phrase), h1, h2, h3, lang and word (where k = 1), n: one pass over all of docs (lang, text), and of its sums those that `keep` says."""

    def run(batches):
        counter = Counter(seed, [b.value for b in borders], words)
        for b in batches:
            held: dict[str, list[bytes]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                body = text.as_py().encode()
                held.setdefault(lang, []).append(body)
                size[lang] = size.get(lang, 0) + len(body)
                if size[lang] >= SLICE:
                    yield from counter.add(lang, b"\xff".join(held.pop(lang)))
                    del size[lang]
            for lang, bodies in held.items():
                yield from counter.add(lang, b"\xff".join(bodies))
        yield from counter.sums()

    def named(batches):
        for b in batches:
            k, keys = b.column(0).to_numpy(), b.column(1).to_pylist()
            h = np.zeros((len(k), 3), np.uint64)
            for x in (2, 3):
                h[k == x, :x] = np.frombuffer(b"".join([key for key, size in zip(keys, k.tolist()) if size == x]), np.uint64).reshape(-1, x)
            word = [key if size == 1 else None for key, size in zip(keys, k.tolist())]
            h[k == 1, 0] = np.array([xxh3_64_intdigest(x, seed) for x in word if x is not None], np.uint64)
            cut = [x.partition(b"\xff")[::2] if x is not None else (None, None) for x in word]
            text = [pa.array([None if x is None else x.decode() for x in side], pa.string()) for side in zip(*cut)] if cut else [pa.nulls(0, pa.string())] * 2
            hashes = [pa.array(h[:, x].view(np.int64), mask=k <= x) for x in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *hashes, *text, b.column(2)], ["k", "h1", "h2", "h3", "lang", "word", "n"])

    sums = docs.mapInArrow(run, _COUNTED).groupBy("k", "key").agg(F.sum("n").alias("n")).where(keep)
    return sums.mapInArrow(named, "k int, h1 long, h2 long, h3 long, lang string, word string, n long")


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits, of which those are set that a hash (column h, long) begins with.

    Blocks of 2^16 bits are made in tasks; the driver takes blocks, 2^bits / 8 bytes at most.
    """
    block = min(16, bits)

    def filled(t: pa.Table) -> pa.Table:
        data = np.zeros(1 << block, np.uint8)
        data[t.column("at").to_numpy() & (1 << block) - 1] = 1
        return pa.table({"block": t.column("block")[:1], "data": pa.array([np.packbits(data, bitorder="little").tobytes()], pa.binary())})

    at = hashes.select(F.shiftrightunsigned("h", 64 - bits).alias("at")).distinct()
    found = at.select(F.shiftright("at", block).alias("block"), "at").groupBy("block").applyInArrow(filled, "block long, data binary")
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in found.collect():
        out[r["block"] << block - 3 : r["block"] + 1 << block - 3] = np.frombuffer(r["data"], np.uint8)
    return out


def hashes_of(counts: DataFrame, k: int) -> DataFrame:
    """Column h: the hash by which bitmaps know a word (k = 1) or a pair (k = 2)."""

    def run(batches):
        for b in batches:
            first, second = (b.column(x).to_numpy().view(np.uint64) for x in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(pair_hash(first, second).view(np.int64))], ["h"])

    some = counts.where(F.col("k") == k)
    return some.select(F.col("h1").alias("h")) if k == 1 else some.select("h1", "h2").mapInArrow(run, "h long")


def _fails(counts: DataFrame, border) -> bool:
    """Whether a frequent word or pair is outside the border."""

    def outside(k: int):
        def run(batches):
            for b in batches:
                h, *more = (b.column(x).to_numpy().view(np.uint64) for x in range(k))
                known = in_bitmap(border.value[k - 1], pair_hash(h, *more) if more else h)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(~known))], ["h"])

        return run

    some = lambda k: counts.where(F.col("k") == k).select(*["h1", "h2"][:k])
    return any(some(k).mapInArrow(outside(k), "h long").take(1) for k in (1, 2))


def frequent_phrases(docs: DataFrame, least: int, fraction: float, filter_bits: tuple[int, int], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to three words with `least` occurrences (k, h1, h2, h3, lang, word, n), and the words of each language (lang, n)."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def border_of(counts: DataFrame):
        return spark.sparkContext.broadcast(tuple(bitmap(hashes_of(counts, k), filter_bits[k - 1]) for k in (1, 2)))

    proposed = staged(counted(docs.sample(fraction, seed=11), seed, [], True, "n > 1"), "proposed")
    borders = [border_of(proposed)]
    first = staged(counted(docs, seed, borders, True, f"k = 1 OR n >= {least}"), "counted")
    words = first.where("k = 1")
    if words.groupBy("h1").agg(F.count("*").alias("same")).where("same > 1").take(1):
        return frequent_phrases(docs, least, fraction, filter_bits, seed + 1)
    found = first.where(F.col("n") >= least)
    while _fails(found, borders[-1]):
        borders.append(border_of(found))
        found = found.union(staged(counted(docs, seed, borders, False, f"n >= {least}"), "expansion"))
    return found, words.groupBy("lang").agg(F.sum("n").alias("n"))


def _score(a: Column, l: Column, r: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (F.lit(1_000_000).cast("decimal(7,0)") * wide(a)).cast("decimal(38,0)") * wide(a), wide(l) * wide(r))


def collocations(docs: DataFrame, least: int = 10, top: int = 2_000, inside_percent: int = 50, fraction: float = 0.05, filter_bits: tuple[int, int] = (24, 26), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two and three words.

    A phrase of a occurrences has the score floor(10^6 a^2 / (l r)) of its lowest cut into
    two parts of l and r occurrences. A pair inside a triple that has `inside_percent` of its
    occurrences or more is left out. `fraction` (of the documents in the sample) and
    `filter_bits` decide the work only, never the result.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found, totals = frequent_phrases(rows, least, fraction, filter_bits)
    word = lambda x: found.where("k = 1").select(F.col("h1").alias(f"h{x}"), F.col("word").alias(f"w{x}"), F.col("n").alias(f"f{x}"), *(["lang"] if x == 1 else []))
    pair = lambda x, y: found.where("k = 2").select(F.col("h1").alias(f"h{x}"), F.col("h2").alias(f"h{y}"), F.col("n").alias(f"f{x}{y}"))
    triples = found.where("k = 3").select("h1", "h2", "h3", F.col("n").alias("a"))
    inside = triples.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"), "a").groupBy("p").agg(F.max("a").alias("longer"))
    pairs = found.where("k = 2").select("h1", "h2", F.col("n").alias("a")).join(inside.select("p.*", "longer"), ["h1", "h2"], "left")
    pairs = pairs.where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))).drop("longer")
    of_two = pairs.join(word(1), "h1").join(word(2), "h2").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    cut = lambda k, l, r: F.struct(_score(F.col("a"), F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
    of_three = triples.join(pair(1, 2), ["h1", "h2"]).join(pair(2, 3), ["h2", "h3"]).join(word(1), "h1").join(word(2), "h2").join(word(3), "h3").withColumn("cut", F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3")))
    of_three = of_three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    every = of_two.unionByName(of_three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
