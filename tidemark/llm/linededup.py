"""Line dedup by content-defined chunks.

A text is cut into lines; a rolling hash over the hashes of `WINDOW` neighbouring non-blank
lines ends a chunk after a line where it is divisible by `divisor`, so the same run of lines
is cut at the same places wherever it stands. A line of more than `WORDS` words is a chunk of
its own, unless a single shorter line stands between it and the next such line or the end of
the text: that line goes with it. Every other chunk has two to `longest` non-blank lines; what
is left of one line at the end of a run goes into the chunk before. Blank lines between chunks
belong to none and stay. Chunks of two or more non-blank lines or of more than `WORDS` words
are counted over all documents by a 128-bit hash; of each repeated chunk the first occurrence
(smallest doc_id, then smallest place) stays, and every other one goes if it equals that one
byte for byte. A chunk that only shares the hash stays. So of a text that repeats another
nothing but blank lines is left, unless it is one line of at most `WORDS` words.

With `whole_passages`, copies that chunks miss go too: between other neighbours a passage is
cut elsewhere at its ends. From every non-blank line the shortest run of more than `WORDS`
words that begins with it and the one that ends with it are looked up by a 128-bit BLAKE2
hash; any repeated passage of whole lines with more than `WORDS` words is made up of such
runs, so all its copies but the first go, however they are cut (blank lines don't count, and
equal hashes are taken for equal runs). Where a text overlaps its own first place only what
lies behind that place goes.

Only hashes are shuffled to find what repeats; the bytes of repeated chunks follow, and
texts travel to their decisions compressed. A chunk in a third of all documents is one
pre-aggregated row on one side and split by skew handling on the other; joins are sort-merge
at every size, which is where Spark splits skew.

Cases: a null text stays null and has no lines; an empty text, and one of a single line
of at most `WORDS` words, stays as it is;
\\r is part of its line; rows with equal doc_id and text are one document (all keep what
one keeps), a null doc_id sorts first; no rows give no rows; other columns pass through
whatever their names.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tidemark.llm.common import staged
from tidemark.llm.shingles import mixed

WINDOW, DIVISOR, SHORTEST, LONGEST = 2, 2, 2, 64
#: A line of more words is long.
WORDS = 50
_P = np.uint64(0x9E3779B97F4A7C15)


def _long(line: bytes) -> bool:
    return len(line) > 2 * WORDS and len(line.split()) > WORDS


def _runs(ends: np.ndarray, start: int, stop: int, longest: int) -> list[tuple[int, int]]:
    """Ranges of SHORTEST to `longest` that cover start to stop, which are at least SHORTEST apart."""
    out = []
    for end in [*ends[(ends > start) & (ends < stop)].tolist(), stop]:
        while end - start > longest:
            out.append((start, start + longest))
            start += longest
        if end - start >= SHORTEST:
            out.append((start, end))
            start = end
    if start < stop:  # one line is left
        a, b = out.pop()
        out += [(a, stop)] if b - a < longest else [(a, b - 1), (b - 1, stop)]
    return out


def cut(lines: list[bytes], divisor: int = DIVISOR, longest: int = LONGEST) -> list[tuple[int, int]]:
    """Half-open ranges of lines, in order, that cover all of them."""
    full = filled(lines)
    n = len(full)
    if not n:
        return [(0, len(lines))]
    h = np.fromiter((xxh3_64_intdigest(lines[i]) for i in full), np.uint64, n)
    with np.errstate(over="ignore"):
        roll = h.copy()
        for k in range(1, WINDOW):
            roll = roll * _P
            roll[k:] += h[:-k]
        ends = np.flatnonzero(mixed(roll) % np.uint64(divisor) == 0) + 1
    long = [k for k, i in enumerate(full) if _long(lines[i])]
    parts, at = [], 0  # of non-blank lines
    for k in [*long, n]:
        if k - at >= SHORTEST:
            parts += _runs(ends, at, k, longest)
            at = k
        elif k > at and parts and parts[-1][1] - parts[-1][0] < longest:  # one short line goes with the long line before it
            parts[-1] = (parts[-1][0], k)
            at = k
        if k < n:  # or, as the first, with the one after it
            parts.append((at, k + 1))
            at = k + 1
    if at < n:
        parts.append((at, n))
    out, done = [], 0
    for a, b in parts:
        if full[a] > done:
            out.append((done, full[a]))
        done = full[b - 1] + 1
        out.append((full[a], done))
    return [*out, (done, len(lines))] if done < len(lines) else out


def chunks(text: str, divisor: int, longest: int) -> list[bytes]:
    """The text as chunks; joined by line feeds they give the text again."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return [b"\n".join(lines[a:b]) for a, b in cut(lines, divisor, longest)]


def filled(lines: list[bytes]) -> list[int]:
    """The places of the non-blank lines."""
    return [i for i, x in enumerate(lines) if x and not x.isspace()]


def passages(lines: list[bytes], words: int = WORDS) -> list[tuple[int, int]]:
    """From each line the shortest run of more than `words` words that begins with it, and the one that ends with it."""
    n = len(lines)
    before = np.concatenate([[0], np.cumsum(np.fromiter((len(x.split()) for x in lines), np.int64, n))])
    ends = np.searchsorted(before, before[:-1] + words, "right")
    starts = np.searchsorted(before, before[1:] - words, "left") - 1
    forward = {(a, b) for a, b in enumerate(ends.tolist()) if b <= n}
    return sorted(forward | {(a, b + 1) for b, a in enumerate(starts.tolist()) if a >= 0})


def _counts(chunk: bytes) -> bool:
    """Whether a chunk has two non-blank lines, or more than WORDS words."""
    head, sep, tail = chunk.strip().partition(b"\n")
    return bool(sep and head and tail) or _long(chunk)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, longest: int = LONGEST, whole_passages: bool = False) -> DataFrame:
    """All columns of docs with the text shortened, and n_chunks_removed (int; how many lost a line), chars_removed (long).

    whole_passages: also every later copy of a run of whole lines with more than WORDS words goes.
    """
    spark_id = F.col(f"`{id_col}`").cast("long")
    base = docs.select(spark_id.alias("d"), F.col(f"`{text_col}`").cast("string").alias("text"))
    base = base.select("d", F.xxhash64("text").alias("r"), "text")

    def hashes(batches):
        for b in batches:
            row, no, digest = [], [], []
            for i, text in enumerate(b.column(2)):
                if text.is_valid:
                    for k, c in enumerate(chunks(text.as_py(), divisor, longest)):
                        if _counts(c):
                            row.append(i)
                            no.append(k)
                            digest.append(xxh3_128_digest(c))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(no, pa.int32()), pa.array(digest, pa.binary())], ["d", "r", "no", "digest"])

    found = staged(base.mapInArrow(hashes, "d long, r long, no int, digest binary"), "chunks")
    repeated = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("d", "r", "no")).alias("first")).where("n > 1")
    repeated = staged(repeated.select("digest", "first"), "repeated")
    # as a set: rows that repeat a document bring the same places twice. Nothing here needs the rows of a hash
    # together, so the join may be split where one hash is hot
    marks = found.join(repeated.hint("merge"), "digest").select("d", "r", "no", "digest", (F.struct("d", "r", "no") == F.col("first")).alias("first"))
    marks = staged(marks.groupBy("d", "r").agg(F.collect_set(F.struct("no", "digest", "first")).alias("marks")), "marks")

    def packed(batches):
        z = zstandard.ZstdCompressor(1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if t is None else z.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()], pa.binary())], ["d", "r", "z"])

    def bytes_of_marks(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            row, no, digest, first, body = [], [], [], [], []
            for i, (text, marked) in enumerate(zip(b.column(2), b.column(3))):
                parts = chunks(z.decompress(text.as_py()).decode("utf-8", "surrogatepass"), divisor, longest)
                for m in marked.as_py():
                    row.append(i)
                    no.append(m["no"])
                    digest.append(m["digest"])
                    first.append(m["first"])
                    body.append(parts[m["no"]])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(no, pa.int32()), pa.array(digest, pa.binary()), pa.array(first, pa.bool_()), pa.array(body, pa.binary())], ["d", "r", "no", "digest", "first", "body"])

    def same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnsRenamed({"d": "d2", "r": "r2"})
        return left.join(right.hint("merge"), left["d"].eqNullSafe(right["d2"]) & (left["r"] == right["r2"]), how)

    carried = base.where("text IS NOT NULL").mapInArrow(packed, "d long, r long, z binary")
    bodies = same(carried, marks, "inner").select("d", "r", "z", "marks").mapInArrow(bytes_of_marks, "d long, r long, no int, digest binary, first boolean, body binary")
    bodies = staged(bodies, "bodies")
    firsts = bodies.where("first").select("digest", F.col("body").alias("first_body"))
    gone = bodies.where("NOT first").join(staged(firsts.dropDuplicates(["digest"]), "firsts").hint("merge"), "digest").where("body = first_body")
    gone = gone.select("d", "r", F.col("no").alias("a"), F.lit(-1).alias("b"))
    if whole_passages:
        gone = gone.union(_repeated_passages(base.where("text IS NOT NULL")))
    gone = staged(gone.groupBy("d", "r").agg(F.collect_set(F.struct("a", "b")).alias("gone")), "gone")

    keep = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    whole = docs.toDF(*keep.values())
    d, t = keep[id_col], keep[text_col]
    whole = whole.withColumns({"d": F.col(d).cast("long"), "r": F.xxhash64(F.col(t).cast("string")), t: F.col(t).cast("string")})
    shape = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == t else f.dataType) for f in whole.schema])
    at = whole.columns.index(t)

    def pack(batches):
        z = zstandard.ZstdCompressor(1)
        for b in batches:
            body = pa.array([None if x is None else z.compress(x.encode("utf-8", "surrogatepass")) for x in b.column(at).to_pylist()], pa.binary())
            yield b.set_column(at, t, body)

    joined = same(whole.mapInArrow(pack, shape), gone, "left").select(*whole.columns, "gone").drop("d", "r")
    out = T.StructType([*[T.StructField(keep[f.name], T.StringType() if f.name == text_col else f.dataType) for f in docs.schema], T.StructField("n_removed", T.IntegerType()), T.StructField("chars", T.LongType())])

    def shorten(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            texts, n, chars = [], [], []
            for body, drop in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                text = None if body is None else z.decompress(body).decode("utf-8", "surrogatepass")
                left = text
                lost = 0
                if drop:
                    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                    parts, full = cut(lines, divisor, longest), filled(lines)
                    stays = np.ones(len(lines), bool)
                    for m in drop:
                        x, y = parts[m["a"]] if m["b"] < 0 else (full[m["a"]], full[m["b"] - 1] + 1)
                        stays[x:y] = False
                    lost = sum(not stays[x:y].all() for x, y in parts)
                    left = b"\n".join(x for x, stay in zip(lines, stays) if stay).decode("utf-8", "surrogatepass")
                texts.append(left)
                n.append(lost)
                chars.append(len(text or "") - len(left or ""))
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32()), pa.array(chars, pa.int64())], names=out.names)

    return joined.mapInArrow(shorten, out).toDF(*docs.columns, "n_chunks_removed", "chars_removed")


def _repeated_passages(base: DataFrame) -> DataFrame:
    """d, r, a, b: ranges of non-blank lines that an earlier text, or an earlier place of this one, holds. base: d, r, text."""

    def hashes(batches):
        for batch in batches:
            row, first, end, digest = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                lines = text.as_py().encode("utf-8", "surrogatepass").split(b"\n")
                lines = [x for x in lines if x and not x.isspace()]
                each = b"".join(blake2b(x, digest_size=16).digest() for x in lines)
                for a, b in passages(lines):
                    row.append(i)
                    first.append(a)
                    end.append(b)
                    digest.append(blake2b(each[16 * a : 16 * b], digest_size=16).digest())
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.binary())], ["d", "r", "a", "b", "digest"])

    found = staged(base.mapInArrow(hashes, "d long, r long, a int, b int, digest binary"), "passages")
    repeated = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("d", "r", "a", "b")).alias("first")).where("n > 1")
    marks = found.join(staged(repeated.select("digest", "first"), "repeated_passages").hint("merge"), "digest")
    # a run that overlaps its own first place loses only what lies behind that
    marks = marks.withColumn("a", F.expr("if(d <=> first.d AND r = first.r, greatest(a, first.b), a)")).where("a < b")
    return marks.select("d", "r", "a", "b")
