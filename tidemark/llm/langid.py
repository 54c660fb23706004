"""Language identification with word-first backoff.

A text's words are scored by their log frequency in each language. A word that the model
does not know falls back to its character 4-grams (with marks at both ends), then 3-, 2-
and 1-grams: the longest size with a known gram decides. The sums over all words, per
square root of the word count, give a softmax whose largest part is the score.

The frequencies are counted by Spark over at most `max_rows` labelled texts: of each language
the same number (smallest hash of doc_id), or all where it has fewer, so a rare language is
learned as well; of each the most frequent words and grams, an equal part of VOCABULARY, make
the model that is broadcast (a few MB). A word of more than WORD characters, as of a text
without white space, has no entry of its own, but all its grams are learned, and it is scored
by the longest known gram at each of its places. Texts are scored where they lie, whole,
without a shuffle; a worker keeps the scores of words that it has seen.

Cases: null texts and texts without a letter give `und` with score 0; a null lang is not
learned from; a null doc_id is not held out and not learned from; without any labelled
text every prediction is `und`; equal scores go to the language first in the alphabet;
no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Kept entries by kind: 0 words, else grams of that many characters.
VOCABULARY = {0: 30_000, 4: 15_000, 3: 8_000, 2: 2_000, 1: 500}
#: Numbers that a worker keeps for tokens it has seen, and characters of texts that are scored together; both bound memory only.
CACHE, TOGETHER = 2_000_000, 1 << 21
#: Longer words are no entries of their own, only their grams are; longer tokens are not cached.
WORD, TOKEN = 40, 200
#: Word characters that are neither letters nor decimal digits, such as ½, ² and Ⅷ.
_NUMBERS = "".join(x for x in map(chr, range(0x80, sys.maxunicode + 1)) if x.isalnum() and not x.isalpha() and not x.isdecimal())
_LETTERS = rf"[^\W\d_{_NUMBERS}]"
_CORE = re.compile(rf"{_LETTERS}(?:.*{_LETTERS})?", re.S)
_LETTER = re.compile(_LETTERS)


def core(token: str) -> str:
    """A token in lower case without what stands before its first and after its last letter."""
    m = _CORE.search(token)
    return m.group().lower() if m else ""


def grams(word: str, size: int):
    marked = f"^{word}$" if size > 1 else word
    return (marked[i : i + size] for i in range(len(marked) - size + 1))


#: Characters of words that are looked up at a time; it bounds memory only.
SLICE = 1 << 20


class Trie:
    """Grams of 1 to 4 characters as sorted arrays: a node is a prefix, its key the node of the prefix before and the last character."""

    def __init__(self, scores: dict[int, dict[str, np.ndarray]], width: int):
        entries = [(g, size, v) for size in (1, 2, 3, 4) for g, v in scores[size].items()]
        prefixes = sorted({g[:k] for g, _, _ in entries for k in range(1, len(g) + 1)}, key=lambda x: (len(x), x))
        node: dict[str, int] = {"": 0}
        self.keys, self.first = [], []  # of each depth: sorted keys, and the number of its first node
        for depth in (1, 2, 3, 4):
            own = sorted(((node[x[:-1]] << 21) | ord(x[-1]), x) for x in prefixes if len(x) == depth)
            self.keys.append(np.array([k for k, _ in own], np.int64))
            self.first.append(len(node))
            for _, x in own:
                node[x] = len(node)
        self.known = np.zeros(len(node), bool)
        self.score = np.zeros((len(node), width))
        for g, _, v in entries:
            self.known[node[g]], self.score[node[g]] = True, v

    def walk(self, code: np.ndarray) -> np.ndarray:
        """4 x places: the node of the gram of 1 to 4 characters that begins at each place, or 0 where none is known."""
        out = np.zeros((4, len(code)), np.int64)
        at, place = np.zeros(len(code), np.int64), np.arange(len(code))
        for depth, keys in enumerate(self.keys):
            place = place[place + depth < len(code)]
            if not len(keys) or not len(place):
                break
            key = (at[place] << 21) | code[place + depth]
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[k] == key
            place = place[hit]
            at[place] = self.first[depth] + k[hit]
            out[depth, place] = np.where(self.known[at[place]], at[place], 0)
        return out


@dataclass
class Model:
    languages: list[str]
    scores: dict[int, dict[str, np.ndarray]]  # kind -> entry -> log frequency in each language
    _row: dict[str, int] = field(default_factory=dict, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)
    _trie: Trie | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.languages, self.scores

    def __setstate__(self, state):
        self.__init__(*state)

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        """A row of scores for each token; those that the words lack fall back to grams, all in one pass."""
        out = np.zeros((len(tokens), len(self.languages)))
        known, unseen, where = self.scores[0], [], []
        for i, token in enumerate(tokens):
            word = core(token)
            found = known.get(word)
            if found is not None:
                out[i] = found
            elif word:
                unseen.append(word)
                where.append(i)
        if unseen:
            self._trie = self._trie or Trie(self.scores, len(self.languages))
            out[where] = self._by_grams(unseen)
        return out

    def _by_grams(self, words: list[str]) -> np.ndarray:
        """The mean score of a word's known grams of the largest size that has any; of a long word, of the longest known gram at each place."""
        n, width = len(words), len(self.languages)
        count, total = np.zeros((5, n), np.int64), np.zeros((5, n, width))  # by size; 0: of long words
        block: list[int] = []
        at = 0

        def add(word: np.ndarray, start: np.ndarray, size: np.ndarray, code: np.ndarray) -> None:
            node = self._trie.walk(code)
            rank = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            owner = np.repeat(word, size)
            length = np.array([len(words[i]) + 2 for i in word.tolist()], np.int64)
            left = np.repeat(length, size) - rank  # characters from here to the word's end mark
            fits = [(rank > 0) & (left > 1), left >= 2, left >= 3, left >= 4]
            for k in range(4):
                node[k][~fits[k]] = 0
            long = np.repeat(length > WORD + 2, size)
            if long.any():
                best = np.where(node[3] > 0, node[3], np.where(node[2] > 0, node[2], np.where(node[1] > 0, node[1], node[0])))
                node = np.where(long, 0, node)
                tally(0, owner, np.where(long, best, 0))
            for k in range(4):
                tally(k + 1, owner, node[k])

        def tally(kind: int, owner: np.ndarray, node: np.ndarray) -> None:
            hit = node > 0
            if hit.any():
                count[kind] += np.bincount(owner[hit], minlength=n)
                for j in range(width):
                    total[kind, :, j] += np.bincount(owner[hit], self._trie.score[node[hit], j], n)

        def flush() -> None:
            if block:
                marked = "".join(f"^{words[i]}$" for i in block)
                size = np.array([len(words[i]) + 2 for i in block], np.int64)
                add(np.array(block, np.int64), np.zeros(len(block), np.int64), size, codes(marked))
                block.clear()

        for i, word in enumerate(words):
            if len(word) + 2 > SLICE:  # in parts that overlap by three characters
                marked = f"^{word}$"
                for a in range(0, len(marked), SLICE):
                    part = codes(marked[a : a + SLICE + 3])
                    self._add_part(i, a, part, len(marked), count, total)
                continue
            if at + len(word) + 2 > SLICE:
                flush()
                at = 0
            block.append(i)
            at += len(word) + 2
        flush()
        out = np.zeros((n, width))
        for kind in (1, 2, 3, 4, 0):  # the largest size is the last to be written
            has = count[kind] > 0
            out[has] = total[kind, has] / count[kind, has, None]
        return out

    def _add_part(self, i: int, start: int, code: np.ndarray, length: int, count: np.ndarray, total: np.ndarray) -> None:
        """A part of one very long word, from place `start`."""
        node = self._trie.walk(code)[:, :SLICE]
        rank = start + np.arange(node.shape[1])
        node[0][(rank == 0) | (rank == length - 1)] = 0
        best = np.where(node[3] > 0, node[3], np.where(node[2] > 0, node[2], np.where(node[1] > 0, node[1], node[0])))
        best = best[best > 0]
        count[0, i] += len(best)
        total[0, i] += self._trie.score[best].sum(0)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predictions([text])[0]

    def predictions(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and its share for each text; tokens that this worker has not seen are scored together."""
        split = [t.split() if t and self.languages and _LETTER.search(t) else None for t in texts]
        if self._rows is None or self._rows.size > CACHE:
            self._row, self._rows = {}, np.zeros((0, len(self.languages)))
        row = self._row
        new = list(set().union(*filter(None, split)).difference(row))
        new.sort(key=len)  # the long ones, which are not kept, last
        short = bisect_right(new, TOKEN, key=len)
        first = len(row)
        row.update(zip(new, range(first, first + len(new))))
        rows = np.concatenate([self._rows[:first], self.token_scores(new)])
        out = []
        for tokens in split:
            if not tokens:
                out.append(("und", 0.0))
                continue
            total = rows[np.fromiter(map(row.__getitem__, tokens), np.int64, len(tokens))].sum(0)
            part = np.exp((total - total.max()) / np.sqrt(len(tokens)))
            part /= part.sum()
            best = int(total.argmax())
            out.append((self.languages[best], float(part[best])))
        for t in new[short:]:
            del row[t]
        self._rows = rows[: first + short]
        return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 when divided by four."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def share(counts: list[int], total: int) -> int:
    """The largest number that each may take at most so that all together take no more than total; 1 at least."""
    left, n = total, len(counts)
    for k, c in enumerate(sorted(counts)):
        if c * (n - k) > left:
            return max(1, left // (n - k))
        left -= c
    return max([1, *counts])


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 8_000) -> Model:
    """Word and gram frequencies of at most max_rows labelled, not held-out texts (one of each language at least)."""
    ids = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    ids = ids.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"))
    rows_of = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}  # one row a language
    most = share(list(rows_of.values()), max_rows)
    # hashes up to where a language has its share, and six standard deviations more, are all that is ranked
    upto = [x for lang, n in rows_of.items() for x in (F.lit(lang), F.lit(int(-(2**63) + min(1.0, (most + 6 * most**0.5 + 10) / n) * (2**64 - 2048))))]
    near = ids.where(F.xxhash64("id") <= F.element_at(F.create_map(*upto), F.col("lang"))) if upto else ids
    of_lang = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = near.withColumn("place", F.row_number().over(of_lang)).where(F.col("place") <= most).select("id", "lang")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("lang", "text")  # at most max_rows pairs

    def count(batches):
        for b in batches:
            words: dict[tuple[str, str], int] = {}
            tally: dict[tuple[int, str, str], int] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in map(core, text.split()):
                    if w and len(w) <= WORD:
                        words[lang, w] = words.get((lang, w), 0) + 1
                    elif w:
                        for size in (1, 2, 3, 4):
                            for g in grams(w, size):
                                tally[size, g, lang] = tally.get((size, g, lang), 0) + 1
            for (lang, w), n in words.items():
                tally[0, w, lang] = n
                for size in (1, 2, 3, 4):
                    for g in grams(w, size):
                        tally[size, g, lang] = tally.get((size, g, lang), 0) + n
            kind, entry, lang = zip(*tally) if tally else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(entry, pa.string()), pa.array(lang, pa.string()), pa.array(list(tally.values()), pa.int64())], ["kind", "entry", "lang", "n"])

    counted = rows.mapInArrow(count, "kind int, entry string, lang string, n long").groupBy("kind", "entry", "lang").agg(F.sum("n").alias("n"))
    counted = staged(counted, "counted")  # counted once for all kinds
    top = None
    for kind, size in VOCABULARY.items():
        of_lang = Window.partitionBy("lang").orderBy(F.desc("n"), "entry")
        part = counted.where(F.col("kind") == kind).withColumn("place", F.row_number().over(of_lang)).where(F.col("place") <= max(1, size // max(1, len(rows_of))))
        top = part if top is None else top.union(part)
    # at most sum(VOCABULARY) entries, as columns: rows of Python objects would take many times the memory
    found = counted.join(top.select("kind", "entry").distinct(), ["kind", "entry"], "left_semi").groupBy("kind", "entry").agg(F.collect_list(F.struct("lang", "n")).alias("by")).toArrow()
    by = found["by"].combine_chunks()
    langs = by.flatten().field("lang").dictionary_encode()
    languages = sorted(langs.dictionary.to_pylist())
    counted_in = np.zeros((len(by), len(languages)))
    if len(languages):
        at = np.array([languages.index(x) for x in langs.dictionary.to_pylist()], np.int64)[langs.indices.to_numpy()]
        np.add.at(counted_in, (np.repeat(np.arange(len(by)), by.value_lengths().to_numpy()), at), by.flatten().field("n").to_numpy())
    kinds = found["kind"].to_numpy()
    scores: dict[int, dict[str, np.ndarray]] = {}
    for kind in VOCABULARY:
        own = np.flatnonzero(kinds == kind)
        names, counts = found["entry"].take(pa.array(own)).to_pylist(), counted_in[own]
        every = np.maximum(1, counts.sum(0))
        least = 0.5 / every.max(initial=1)  # the same in all: a language of few texts must not rate what it lacks higher
        logs = np.log((counts / every + least) / (1 + least * max(1, len(names)))).astype(np.float32)
        scores[kind] = dict(zip(names, logs))
    return Model(languages, scores)


def _parts(texts: list[str | None]):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    yield part


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            found = [x for some in _parts(b.column(2).to_pylist()) for x in m.predictions(some)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
