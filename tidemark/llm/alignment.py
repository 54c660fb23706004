"""How the tokens of two tokenizers lie over each other in the same texts.

Each text is tokenised by a byte-level model (A, after a space) and a piece model (B, which
adds the space). Where an A and a B token end at the same byte, both cut the text: a group.
An A and a B token are linked where their bytes overlap, which is only inside a group.

1. A text and the space before it is cut where no token of either model can lie across: at
   the end of a run of letters, and before white space (but for a carriage return). That
   leaves windows of about a word or a sign each, whose groups and links do not depend on
   their neighbours.
2. Windows that a worker does not remember are tokenised together by both models, checked
   against their bytes, and aligned: the ends of both are running sums of token lengths.
   What is inside - groups and links - is kept under the window's text (at most 2 MEMO), so
   most of a document is looked up. A document has the number, the links and the groups of
   its windows.
3. The documents that hold an id pair linked are counted over the corpus: one row for each
   distinct pair of a document, summed before the shuffle.
4. Counts come back to the documents in two tiers: the `tier` most frequent pairs are
   broadcast (16 bytes each, 4 MB as given) and looked up where the document is; links of
   other pairs, which are rare, are joined by pair. Every pair is counted and looked up.

Why windows stand alone: A's pattern ends a piece at both kinds of cut and does not look
back, and merges stay inside a piece; B merges neighbours only to pieces of its list, none
of which lies across a cut. The list is searched for such pieces when it is loaded. If a
model has one, or sums up scores over a text instead of merging, and where a text has
letters beyond Latin, whose tables of letters decide where runs end, the text is tokenised
whole and is one window. A merges by the ranks of its tokens, in a library that does so,
but by its own library where a text has letters beyond Latin.

Cases: null and empty texts, and those whose tokens do not give back the text's bytes (B
writes U+2581 as a space), have zeros and an empty digest; a null doc_id and repeated
doc_ids are rows of their own, and each counts; no rows give no rows; columns other than id
and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.tokens import LONG, SLICE, WHITE, as_letters

#: Windows that a worker remembers at least, with as many older ones; rows of a batch that is handed over.
MEMO, ROWS = 250_000, 256
#: How the byte-level tokenizer cuts a text before merging, in its own pattern language.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND_LATIN = re.compile("[^\x00-ɏ‐-‧€]")
#: Letters among those that are not beyond Latin; a window: white space, then signs and digits (also behind a carriage return, since B has pieces such as `;\\r`), then letters, as far as there are any.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_WINDOW = re.compile(rf"[{WHITE}]*(?:[^{WHITE}{_LETTERS}]+(?:\r[{WHITE}]*[^{WHITE}{_LETTERS}]*)*[{_LETTERS}]*|[{_LETTERS}]+)|[{WHITE}]+")
#: What lies across a cut; a cut before white space; beginnings before which there is a cut after every window; ends that may go on.
_ACROSS = re.compile(rf"[{_LETTERS}][^{_LETTERS}]|[^{WHITE}](?!\r)[{WHITE}]")
_BEFORE_WHITE = re.compile(rf"(?<![{WHITE}])(?!\r)(?=[{WHITE}])")
_APART, _OPEN = re.compile(rf"(?!\r)[{WHITE}]"), re.compile(rf"[{WHITE}]\Z")
_BYTE = re.compile("<0x([0-9A-F]{2})>")
_IDS = 1 << 16  # more than either tokenizer has
#: Ids as they are written: inside a group, at the end of its A ids, at the end of its B ids.
_TEXT = [f"{x}{sign}" for sign in ",|;" for x in range(_IDS)]


class ByteLevel:
    """Model A: by the ranks of its tokens, whose ids rise in order of its merges; texts with letters beyond Latin by its own library."""

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.whole.encode_special_tokens = True
        byte = {ord(as_letters(bytes([b]))): b for b in range(256)}
        special = self.whole.get_added_tokens_decoder()
        names = [self.whole.id_to_token(i) or "" for i in range(self.whole.get_vocab_size())]
        self.tokens = [x.encode() if i in special else bytes(byte[ord(c)] for c in x) for i, x in enumerate(names)]
        ranks = {x: i for i, x in enumerate(self.tokens) if i not in special}
        self.ranked = Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        spaced = " " + text
        return self.whole.encode(spaced, add_special_tokens=False).ids if _BEYOND_LATIN.search(text) else self.ranked.encode_ordinary(spaced)


class Pieces:
    """Model B, which puts a space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        as_byte = (self.model.is_byte(i) and _BYTE.fullmatch(x) for i, x in enumerate(names))
        self.tokens = [bytes([int(m[1], 16)]) if m else x.replace("▁", " ").encode() for m, x in zip(as_byte, names)]
        merged = (x.replace("▁", " ") for i, x in enumerate(names) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)))
        trained = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto()).trainer_spec
        self.cut = trained.model_type == trained.BPE and not any(_ACROSS.search(x) and not _BEYOND_LATIN.search(x) for x in merged)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def inside(ids: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray], window: tuple[np.ndarray, np.ndarray]) -> list[tuple[str, bytes]]:
    """Of each of some windows its groups as text, and its links as 64-bit numbers a << 32 | b.

    ids, ends (rising) and window numbers of their A tokens and of their B tokens. Between
    two neighbouring ends of either kind lies one A and one B token: a link.
    """
    cuts = np.union1d(*ends)
    of_a, of_b = (np.searchsorted(x, cuts) for x in ends)
    links = ids[0][of_a].astype(np.int64) << 32 | ids[1][of_b]
    first_link = np.flatnonzero(np.diff(window[0][of_a], prepend=-1)).tolist()
    shared = np.intersect1d(*ends, assume_unique=True)
    group = [np.searchsorted(shared, x) for x in ends]
    last = [np.diff(g, append=g[-1] + 1) != 0 for g in group]
    order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
    written = np.concatenate([ids[0] + np.where(last[0], _IDS, 0), ids[1] + np.where(last[1], 2 * _IDS, 0)])[order]
    first_text = np.flatnonzero(np.diff(np.concatenate(window)[order], prepend=-1)).tolist()
    texts, raw = [_TEXT[x] for x in written.tolist()], links.tobytes()
    return [("".join(texts[i:j])[:-1], raw[8 * m : 8 * n]) for i, j, m, n in zip(first_text, [*first_text[1:], len(texts)], first_link, [*first_link[1:], len(links)])]


class Windows(dict):
    """Groups as text, links as bytes and number of A tokens of windows by their text; None where tokens do not give back the bytes."""

    def __init__(self, a: ByteLevel, b: Pieces):
        super().__init__()
        self.models, self.older = (a, b), {}
        self.length = tuple(np.array([len(x) for x in t.tokens], np.int64) for t in self.models)
        self.cut = b.cut and self.worked_out([" a"]) != [None]

    def keep(self, window: str, found: tuple[str, bytes, int] | None) -> None:
        """Short windows are kept: those of the last MEMO to twice as many that were asked for."""
        if len(window) <= LONG:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[window] = found

    def found(self, windows: Iterable[str]) -> dict[str, tuple[str, bytes, int] | None]:
        """What is in each window; those not known yet are worked out together."""
        out, new = {}, []
        for x in windows:
            if x in self:
                out[x] = self[x]
            elif x in self.older:
                out[x] = self.older[x]
                self.keep(x, out[x])
            else:
                new.append(x)
        last = {x for x in new if _OPEN.search(x)}  # nothing may follow them
        for some in [[x for x in new if x not in last], *([x] for x in last)] if new else []:
            row = [" a"]
            for x in some:
                row += [x] if _APART.match(x) else [" a", x]
            out.update(zip(row[1:], self.worked_out(row)[1:]))
        for x in new:
            self.keep(x, out[x])
        return out

    def worked_out(self, row: list[str]) -> list[tuple[str, bytes, int] | None]:
        """What is in each of some windows that follow one another. The first begins with a space; where there are more, it is " a" and counts for nothing."""
        text = "".join(row)
        plain, data = [m.ids(text[1:]) for m in self.models], text.encode()
        if any(b"".join(map(m.tokens.__getitem__, x)) != data for m, x in zip(self.models, plain)):
            if len(row) <= 2:
                return [None] * len(row)
            half = (len(row) + 1) // 2
            return self.worked_out(row[:half]) + self.worked_out([" a", *row[half:]])[1:]
        ids = tuple(np.array(x, np.int64) for x in plain)
        ends = tuple(np.cumsum(length[x]) for length, x in zip(self.length, ids))
        stops = np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in row])
        counts = [np.diff(np.searchsorted(x, stops, "right"), prepend=0) for x in ends]
        window = tuple(np.repeat(np.arange(len(row)), x) for x in counts)
        return [(*x, n) for x, n in zip(inside(ids, ends, window), counts[0].tolist())]


@lru_cache(maxsize=2)
def windows(path_a: str, path_b: str) -> Windows:
    """One pair of tokenizers and one memory of windows for a worker process."""
    return Windows(ByteLevel(path_a), Pieces(path_b))


def stretches(text: str) -> Iterator[str]:
    """A long text in parts of about SLICE letters, cut before white space."""
    at = 0
    while len(text) - at > SLICE and (m := _BEFORE_WHITE.search(text, at + SLICE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def all_aligned(texts: list[str | None], known: Windows) -> list[tuple[int, int, int, str, np.ndarray] | None]:
    """Of each text n_a, n_b, n_groups, digest of the groups, links (a << 32 | b of each occurrence); None without tokens."""
    parts: list[list] = [[] for _ in texts]
    waiting: list[tuple[int, list[str]]] = []

    def look_up() -> None:
        here = known.found(set().union(*(x for _, x in waiting)))
        unlike = {x for x, inner in here.items() if inner is None}
        for k, row in waiting:
            if unlike and not unlike.isdisjoint(row):
                parts[k].append(None)
            else:
                groups, links, n_a = zip(*map(here.__getitem__, row))
                parts[k].append((";".join(groups), b"".join(links), sum(n_a)))
        waiting.clear()

    size = 0
    for k, text in enumerate(texts):
        if text and known.cut and (text.isascii() or not _BEYOND_LATIN.search(text)):
            for x in stretches(" " + text):
                waiting.append((k, _WINDOW.findall(x)))
                size += len(x)
                if size >= SLICE:
                    look_up()
                    size = 0
        elif text:
            parts[k] = known.worked_out([" " + text])
    look_up()
    return [_joined(x) if x and None not in x else None for x in parts]


def _joined(parts: list[tuple[str, bytes, int]]) -> tuple[int, int, int, str, np.ndarray]:
    """A text's numbers by those of its parts: its links are as many as ends of either kind, its groups as many as ends of both."""
    groups = ";".join([x for x, _, _ in parts])
    links = np.frombuffer(b"".join([x for _, x, _ in parts]), np.int64)
    n_a, n_groups = sum(n for _, _, n in parts), groups.count("|")
    return n_a, len(links) + n_groups - n_a, n_groups, hashlib.sha256(groups.encode()).hexdigest(), links


def aligned(text: str | None, known: Windows) -> tuple[int, int, int, str, np.ndarray] | None:
    return all_aligned([text], known)[0]


_ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its numbers, its groups' digest, its distinct linked pairs (rising) and how often each is linked."""

    def run(batches):
        known = windows(path_a, path_b)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = all_aligned(part.column("text").to_pylist(), known)
                numbers = [[x[k] if x else 0 for x in found] for k in range(3)]
                distinct = [np.unique(x[4], return_counts=True) if x else (np.zeros(0, np.int64),) * 2 for x in found]
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x[0]) for x in distinct]), pa.int32()), pa.array(np.concatenate([x[k] for x in distinct]), kind)) for k, kind in ((0, pa.int64()), (1, pa.int32()))]
                links = [len(x[4]) if x else 0 for x in found]
                digests = pa.array([x[3] if x else "" for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (*numbers, links)), digests, *lists], [x.split()[0] for x in _ROW.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, _ROW)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether no pair with the same A id has more)."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", tier: int = 1 << 18) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: see the module for method and cases."""
    spark = docs.sparkSession
    rows = staged(alignments(docs, path_a, path_b, id_col, text_col), "alignments")
    counts = staged(pair_counts(rows), "pair_counts")
    top = counts.orderBy(F.desc("n"), "pair").limit(tier).toArrow().sort_by("pair")  # `tier` rows at most
    table = spark.sparkContext.broadcast(tuple(top.column(x).to_numpy() for x in ("pair", "n", "best")))

    def looked_up(batches):
        pair, n, best = table.value
        for b in batches:
            pairs, times = (b.column(x).flatten().to_numpy() for x in ("pairs", "times"))
            starts = b.column("pairs").offsets.to_numpy()
            at = np.minimum(np.searchsorted(pair, pairs), max(0, len(pair) - 1))
            hit = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            of_hit = lambda x: np.where(hit, times * x[at], 0) if len(pair) else np.zeros(len(pairs), np.int64)
            sums = [np.diff(np.concatenate([[0], np.cumsum(of_hit(x))])[starts - starts[0]]) for x in (best, n)]
            owner = np.repeat(np.arange(b.num_rows), np.diff(starts))[~hit]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b.num_rows))])
            rare = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x[~hit], kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
            plain = [b.column(x) for x in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*plain, *(pa.array(x, pa.int64()) for x in sums), *rare], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "pairs", "times"])

    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    out = rows.mapInArrow(looked_up, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<int>")
    if counts.count() <= tier:
        return out.select(*names)
    out = staged(out, "looked_up")
    links = out.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times").withColumnRenamed("pairs", "pair")
    more = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_more"), F.sum(F.col("times") * F.col("n")).alias("sum_more"))
    whole = out.drop("pairs", "times").join(more, "row", "left")
    return whole.withColumn("n_best", F.col("n_best") + F.coalesce("best_more", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("sum_more", F.lit(0))).select(*names)
