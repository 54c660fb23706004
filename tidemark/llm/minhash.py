"""Near-duplicate groups by HyperMinHash.

One pass turns every text into a set of word shingles (64-bit hashes), a 128-bit digest
of the set and 512 compressed registers: a shingle's top 9 bits choose the bucket, and of
the smallest rest in a bucket a register keeps the leading-zero count (4 bits, saturating)
and four mantissa bits. Empty buckets borrow from filled ones by one fixed order per
bucket. Eight neighbouring registers are one 64-bit band key, so 64 keys a text: two sets
at 0.8 share none of them with probability (1 - 0.8^8)^64 = 8e-6, and texts that have 3 %
in common meet in a bucket with 1e-11, which holds for billions of texts.

1. Equal sets form a class and only its smallest doc_id goes on.
2. In each band bucket all members are compared with the smallest one (a hub, never all
   pairs). Registers give an estimate of the similarity, corrected for registers that
   agree by chance; pairs at `threshold - margin` (over five standard deviations) or more
   are confirmed on full sets, and confirmed pairs give components.
3. The members of a bucket that are not linked with its hub itself are handed to a next hub,
   of their own number and chosen by the bucket's key, ROUNDS times, for as long as they are
   of several components.
4. What may still be linked past the hubs is put in families and compared on full sets. Two
   linked texts of a bucket are in one family: if one is linked with a hub, the other is
   at 1 - 2 * (1 - threshold) to it at least, since 1 - similarity is a metric, and pairs
   of hub and member estimated that high (less the margin) are a family; if neither is
   linked with a hub, both are left after the last round, and what a bucket has left is
   a family whatever was estimated. In a family that is not one component yet, the members
   outside its largest component are compared with all of it in blocks of bounded size, by
   counting common shingles as a matrix product; a block returns at most one link for
   each text and component. Work there is the number of such members times the family,
   inside tasks; rows stay few.

So a link decides unless its texts share no bucket (8e-6 at 0.8) or registers put the pair
more than `margin` too low (five standard deviations).

Cases: null or blank texts have n_shingles 0 and link with nothing; rows with a null
doc_id take part in no link and have a null component_id and kept = true; rows that
repeat a doc_id are one row each with the smallest component of that doc_id; no rows give
no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, connected_components, long_matrix, staged
from tidemark.llm.shingles import set_digest, shingle_set

REGISTERS, ROWS, MANTISSA = 512, 8, 4
BANDS = REGISTERS // ROWS
#: Hub rounds; texts and shingles in a block.
ROUNDS, BLOCK, BLOCK_SHINGLES = 3, 512, 500_000
_REST = 64 - 9  # bits of a hash below the bucket number
_ORDER = np.stack([np.random.default_rng(1000 + i).permutation(REGISTERS) for i in range(REGISTERS)]).astype(np.int16)


def registers(hashes: np.ndarray) -> np.ndarray:
    """512 registers (uint8) of sorted distinct hashes, at least one."""
    bucket = (hashes >> np.uint64(_REST)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: the first of a bucket is its minimum
    rest = (hashes[first] & np.uint64((1 << _REST) - 1)) | np.uint64(1)
    bits = rest.astype(np.float64).view(np.uint64)
    zeros = np.clip(_REST - 1 + 1023 - (bits >> np.uint64(52)).astype(np.int64), 0, 15)
    mantissa = ((bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)
    out = np.zeros(REGISTERS, np.uint8)
    filled = np.zeros(REGISTERS, bool)
    at = bucket[first]
    out[at], filled[at] = (zeros << MANTISSA | mantissa).astype(np.uint8), True
    empty = np.flatnonzero(~filled)
    for reach in (16, REGISTERS):  # nearly all find a lender among the first
        if len(empty):
            lent = filled[_ORDER[empty, :reach]]
            found = lent.any(1)
            out[empty[found]] = out[_ORDER[empty[found], lent[found].argmax(1)]]
            empty = empty[~found]
    return out


def estimated(agree: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate: the share of agreeing registers, less those expected to agree by chance.

    A register cell near x is about x * 2^-MANTISSA / (2 ln 2) wide; integrating the two
    exponential densities over it gives the chance that different minima share a cell.
    """
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    chance = 2.0**-MANTISSA / (2 * np.log(2)) * n_a * n_b / (n_a + n_b) ** 2
    return (np.asarray(agree) / REGISTERS - chance) / (1 - chance)


def signatures(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest (16 bytes, null if the set is empty), bands (64 longs holding 512 registers)."""

    def run(batches):
        for b in batches:
            n, digest, bands = [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, shingle)
                n.append(len(s))
                digest.append(set_digest(s) if len(s) else None)
                bands.append(registers(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _estimate(pairs: DataFrame) -> DataFrame:
    """The estimated similarity of (a, b, n_a, n_b, bands_a, bands_b)."""

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            x, y = (long_matrix(t.column(i), BANDS).view(np.uint8) for i in (4, 5))
            e = estimated((x == y).sum(1), t.column(2).to_numpy(), t.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(e)], ["a", "b", "estimate"])

    return pairs.mapInArrow(run, "a long, b long, estimate double")


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Each pair takes the text of b along, then meets the text of a; the join leaves the
    pairs of one a next to each other, so its set is built once.
    """
    pairs = staged(pairs, "candidates")
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))

    def run(batches):
        last, sa = None, None
        for t in batches:
            keep = []
            for a, text_a, text_b in zip(t.column(0).to_pylist(), t.column(2), t.column(3).to_pylist()):
                if a != last:
                    last, sa = a, shingle_set(text_a.as_py(), shingle)
                sb = shingle_set(text_b, shingle)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * both >= percent * (len(sa) + len(sb) - both))
            yield t.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(tb, "b").join(ta, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def _fewer(edges: DataFrame) -> DataFrame:
    """Edges (hub a, member b) of the same components: of a member's hubs it keeps the smallest, and the others are joined with that one.

    A group has few hubs beside its members, so what many members say of two hubs becomes
    one edge. A member has at most one hub for each band and round, so windows stay small.
    """
    first = F.min("a").over(Window.partitionBy("b"))
    one = edges.select("a", "b", first.alias("first"))
    return one.select(F.col("first").alias("a"), F.when(F.col("a") == F.col("first"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.1) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: see the module for method and cases."""
    bounded_batches(docs.sparkSession)
    least = percent / 100 - margin
    loose = max(0.0, 2 * percent / 100 - 1 - margin)
    sigs = staged(signatures(docs, shingle, id_col, text_col), "signatures")
    reps = sigs.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    reps = staged(reps.where("rep IS NOT NULL"), "representatives")

    def keys_of(some: DataFrame) -> DataFrame:
        return some.select("rep", F.posexplode("bands").alias("band", "key")).select("rep", F.xxhash64("band", "key").alias("key"))

    buckets = keys_of(reps).groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
    buckets = staged(buckets.select("key", "hub"), "buckets")
    stars = staged(keys_of(reps).join(buckets, "key").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    some = staged(stars.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "some")
    of_some = staged(reps.join(some, "rep", "left_semi").select("rep", "n", "bands"), "of_some")

    def estimates(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(of_some.select(F.col("rep").alias(x), F.col("n").alias("n_" + x), F.col("bands").alias("bands_" + x)), x)
        return _estimate(pairs.select("a", "b", "n_a", "n_b", "bands_a", "bands_b"))

    stars = staged(estimates(stars), "stars", (stars,))
    # the only texts that are looked at again, fetched once: those that share a bucket with another
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = staged(texts.join(some.withColumnRenamed("rep", "id"), "id", "left_semi"), "texts")
    links = staged(_confirm(stars.where(F.col("estimate") >= least).select("a", "b"), texts, shingle, percent), "links")
    placed = staged(connected_components(_fewer(links)).withColumnsRenamed({"node": "rep"}), "placed")

    def apart(pairs: DataFrame, placed: DataFrame) -> DataFrame:
        """Those of the pairs (a, b and more) whose texts are in two components."""
        for x in "ab":
            pairs = pairs.join(placed.select(F.col("rep").alias(x), F.col("component").alias("c" + x)), x, "left")
        return pairs.where("coalesce(ca, a) <> coalesce(cb, b)").drop("ca", "cb")

    def joined_up(placed: DataFrame, links: DataFrame) -> DataFrame:
        """placed after more links: only components that they join change."""
        ends = links
        for x in "ab":
            ends = ends.join(placed.select(F.col("rep").alias(x), F.col("component").alias("c" + x)), x, "left")
        ends = staged(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"), F.array("a", "b").alias("both")), "ends")
        more = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("lower"))
        every = placed.union(ends.select(F.explode("both").alias("rep")).distinct().join(placed, "rep", "left_anti").select("rep", F.col("rep").alias("component")))
        return staged(every.join(more, "component", "left").select("rep", F.coalesce("lower", "component").alias("component")), "placed")

    def several(left: DataFrame, placed: DataFrame) -> DataFrame:
        """Members (key, rep) of the buckets whose members are of several components."""
        left = left.join(placed, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        open_keys = left.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        return left.join(open_keys, "key", "left_semi").select("key", "rep")

    # members that are not linked with their hub go to a next one, by bucket
    edges = stars.where(F.col("estimate") >= loose).select("a", "b")
    failed = staged(stars.join(links, ["a", "b"], "left_anti").select(F.col("a").alias("hub"), F.col("b").alias("rep")), "failed")
    if failed.take(1):
        ids = staged(failed.select("rep").distinct(), "ids")
        left = keys_of(of_some.join(ids, "rep", "left_semi")).join(buckets, "key").join(failed, ["hub", "rep"], "left_semi").select("key", "rep")
        left = staged(several(staged(left, "left"), placed), "left")
        for turn in range(1, ROUNDS):
            mask = F.xxhash64("key", F.lit(turn))
            # exclusive or with a number of the bucket's own: another order in each bucket, turned back by itself
            hubs = left.groupBy("key").agg(F.min(F.col("rep").bitwiseXOR(mask)).alias("m")).select("key", F.col("m").bitwiseXOR(mask).alias("hub"))
            tried = staged(left.join(hubs, "key").where("rep <> hub").select("key", F.col("hub").alias("a"), F.col("rep").alias("b")), "tried", (left,))
            pairs = staged(estimates(tried.select("a", "b").distinct()), "pairs")
            edges = edges.union(pairs.where(F.col("estimate") >= loose).select("a", "b"))
            found = staged(_confirm(apart(pairs.where(F.col("estimate") >= least).select("a", "b"), placed), texts, shingle, percent), "found")
            placed = joined_up(placed, found)
            left = tried.join(found, ["a", "b"], "left_anti").select("key", F.col("b").alias("rep"))
            left = staged(several(staged(left, "left", (tried,)), placed), "left")
        rest = left.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("size")).where("size > 1")
        over = staged(left.join(rest, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "over")
        edges = edges.union(over)
        family = connected_components(_fewer(edges)).select(F.col("node").alias("rep"), F.col("component").alias("family"))
        family = staged(family, "family")
        untried = family.join(over.select(F.col("a").alias("rep")).distinct(), "rep").select("family", F.lit(True).alias("untried")).distinct()
        member = family.join(placed, "rep", "left").select("rep", "family", F.coalesce("component", "rep").alias("component"))
        member = staged(member.join(of_some.select("rep", "n"), "rep"), "members")
        parts = member.groupBy("family", "component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
        main = parts.groupBy("family").agg(F.max(F.struct("size", "component", "shingles")).alias("main"), F.sum("size").alias("n_all"), F.sum("shingles").alias("shingles"))
        blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
        outside, outside_shingles = F.col("n_all") - F.col("main.size"), F.col("shingles") - F.col("main.shingles")
        # a family of hub and member has been compared; what a bucket has left has not
        open_ones = main.join(untried, "family", "left").where((outside > 0) & ((F.col("n_all") > 2) | F.col("untried"))).select("family", F.col("main.component").alias("main"), blocks(F.col("n_all"), F.col("shingles")).alias("na"), blocks(outside, outside_shingles).alias("no"))
        more = _within_families(member, staged(open_ones, "open"), texts, shingle, percent)
        placed = joined_up(placed, staged(more, "more"))
    of_set = reps.select("digest", "rep").join(placed, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sigs.select("doc_id", "n_shingles", "digest").join(staged(of_set, "of_set"), "digest", "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def _within_families(member: DataFrame, families: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between members outside a family's main component and any member of another component.

    All members are dealt to blocks, and those outside the main component again; a task
    compares one block of either kind.
    """
    own = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = staged(member.join(families, "family").join(texts.withColumnRenamed("id", "rep"), "rep"), "parts")
    right = part.select("family", "rep", "component", "text", own("na", 1).alias("i"), every("no").alias("j"))
    left = part.where("component <> main").select("family", "rep", "component", "text", own("no", 2).alias("j"), every("na").alias("i"))

    def compare(l: pa.Table, r: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if l.num_rows and r.num_rows:
            ls, rs = ([shingle_set(x.as_py(), shingle) for x in t.column("text")] for t in (l, r))
            both = common_counts(ls, rs)
            ln, rn = (np.array([len(x) for x in s], np.int64) for s in (ls, rs))
            lc, rc = (t.column("component").to_numpy() for t in (l, r))
            hit = (100 * both >= percent * (ln[:, None] + rn[None, :] - both)) & (lc[:, None] != rc[None, :])
            x, y = np.nonzero(hit)
            first = np.unique(np.stack([x, rc[y]]), axis=1, return_index=True)[1]  # one link a text and component
            out_a, out_b = l.column("rep").to_numpy()[x[first]], r.column("rep").to_numpy()[y[first]]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    by = ["family", "i", "j"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], frequent: int = 8, width: int = 4096) -> np.ndarray:
    """How many hashes each left set shares with each right set.

    Hashes in `frequent` left sets or more are columns of a matrix product, `width` at a
    time; the others are counted one by one.
    """
    tokens = np.concatenate(left)
    row = np.repeat(np.arange(len(left)), [len(x) for x in left])
    words, code, n = np.unique(tokens, return_inverse=True, return_counts=True)
    out = np.zeros((len(left), len(right)), np.int64)
    r_tokens = np.concatenate(right)
    r_row = np.repeat(np.arange(len(right)), [len(x) for x in right])
    if not len(words):
        return out
    at = np.minimum(np.searchsorted(words, r_tokens), len(words) - 1)
    same = words[at] == r_tokens
    r_code, r_row = at[same], r_row[same]
    rank = np.cumsum(n >= frequent) - 1  # column of a frequent hash
    often, r_often = n[code] >= frequent, n[r_code] >= frequent
    lf, rf, lrow, rrow = rank[code[often]], rank[r_code[r_often]], row[often], r_row[r_often]
    for start in range(0, int((n >= frequent).sum()), width):
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        inside, r_inside = (lf >= start) & (lf < start + width), (rf >= start) & (rf < start + width)
        x[lrow[inside], lf[inside] - start] = 1
        y[rrow[r_inside], rf[r_inside] - start] = 1
        out += (x @ y.T).astype(np.int64)
    order = np.argsort(code[~often], kind="stable")
    lcode, lrow = code[~often][order], row[~often][order]
    rcode, rrow = r_code[~r_often], r_row[~r_often]
    for k in range(frequent - 1):  # the k-th left set that has the hash
        pos = np.searchsorted(lcode, rcode) + k
        ok = pos < len(lcode)
        ok[ok] = lcode[pos[ok]] == rcode[ok]
        np.add.at(out, (lrow[pos[ok]], rrow[ok]), 1)
    return out
