"""Near-duplicate groups by SimHash: documents whose fingerprints differ in few bits, directly or through others.

A text's fingerprint has a bit set if over half of its shingles' XXH64 values have it.
Equal fingerprints are one class, of which the smallest doc_id goes on. Classes are linked
at Hamming distance 2 or less:

1. Embedding: a fingerprint becomes the counts of set bits in segments of 4 bits, a point
   in 16 dimensions. A differing bit moves one count by one at most, so the Manhattan
   distance of two points is a lower bound on the Hamming distance.
2. Grid range-join: cells are the unit cells of that space. Every point is put in its own
   cell and those next to it (33 at most); between two points at Manhattan distance 2 or
   less lies a cell within 1 of both, so they meet by an equi-join on the cell.
3. Pairs that meet in a cell are verified on the fingerprints themselves.

A cell of more than `crowd` fingerprints is not compared pair by pair: its members meet
again in the grid of segments half as long (32 of 2 bits, then 64 of one bit), where the
bound is sharper. With segments of one bit it is the distance itself: all members of a cell
are within one bit of it and so within two of each other, and a star from the smallest says
all. So a group of near copies costs 33 + 65 + 65 rows a fingerprint at most, whatever its
size, and no link is lost. Joins on cells are merges by hint: Spark sizes exploded rows like
their input, 33 or 65 times too low, and would broadcast them.

Cases: null, empty and blank texts have fingerprint zero and are linked like any other;
rows with a null doc_id link nothing and have a null component_id; rows that repeat a
doc_id are one row each, by the fingerprint of their own text; no rows give no rows;
columns other than id and text are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import connected_components, staged
from tidemark.llm.shingles import words

#: The seed of XXH64; shingles whose bits are counted together.
SEED, PART = 42, 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits: those set in over half the hashes of the runs of `shingle` words, repeats included; fewer words are one run; no words, zero."""
    w = words(text)
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    body, starts = b" ".join(w), np.cumsum([0] + [len(x) + 1 for x in w])
    last = min(shingle, len(w))
    runs = zip(starts[:n].tolist(), (starts[last : last + n] - 1).tolist())
    h = np.fromiter((xxh64_intdigest(body[a:b], SEED) for a, b in runs), np.uint64, n)
    ones = sum(np.unpackbits(h[k : k + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for k in range(0, n, PART))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of every row."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: Column, bits: int) -> Column:
    """The embedding, packed in a long: in each field of `bits` bits (1, 2 or 4) the count of set bits of that segment."""
    if bits == 1:
        return fp
    low, next_to = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    v = F.shiftleft(fp.bitwiseAND(next_to).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseXOR(next_to).bitwiseAND(low))
    low = F.lit(0x3333333333333333)
    return v if bits == 2 else v.bitwiseAND(low) + F.shiftrightunsigned(v, 2).bitwiseAND(low)


def cells(fp: Column, bits: int) -> Column:
    """The unit cells within Manhattan distance 1 of a fingerprint's point."""
    v = popcounts(fp, bits)
    near = [v]
    for at in range(0, 64, bits):
        count = F.shiftrightunsigned(v, at).bitwiseAND(F.lit((1 << bits) - 1))
        moved = lambda to: v.bitwiseXOR(F.shiftleft(count.bitwiseXOR(to), at))  # noqa: B023, E731
        near += [F.when(count > 0, moved(count - 1)), F.when(count < bits, moved(count + 1))]
    return F.array_compact(F.array(*near))


def links(prints: DataFrame, crowd: int = 32, bits: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) such that those within two bits of each other are connected, and no others."""
    met, found = prints, []
    while bits > 1:
        keys = met.select("fp", F.explode(cells(F.col("fp"), bits)).alias("cell"))
        shared = keys.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
        members = staged(keys.join(shared.hint("merge"), "cell"), "cells")
        few = members.where(F.col("size") <= crowd)
        pairs = few.select("cell", F.col("fp").alias("a")).join(few.select("cell", F.col("fp").alias("b")).hint("merge"), "cell").where("a < b AND bit_count(a ^ b) <= 2")
        found.append(pairs.select("a", "b"))
        met = staged(members.where(F.col("size") > crowd).select("fp").distinct(), "crowded")
        if not met.take(1):
            break
        bits //= 2
    else:
        keys = met.select("fp", F.explode(cells(F.col("fp"), 1)).alias("cell"))
        hubs = keys.groupBy("cell").agg(F.min("fp").alias("a"), F.count("*").alias("size")).where("size > 1")
        found.append(keys.join(hubs.hint("merge"), "cell").where("a <> fp").select("a", F.col("fp").alias("b")))
    return reduce(DataFrame.union, found).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", crowd: int = 32) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: see the module for method and cases."""
    prints = staged(fingerprints(docs, shingle, id_col, text_col), "prints")
    classes = staged(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = connected_components(links(classes.select("fp"), crowd)).withColumnRenamed("node", "fp")
    placed = staged(classes.join(found, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = prints.join(placed.join(least, "component").select("fp", "component_id"), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
