"""Best-fit packing with certified bin counts.

Documents become token ids with an end id; one longer than `capacity` is cut into pieces
of `capacity`, the last shorter. Pieces are dealt to groups of about GROUP, of like lengths. A
group packs best-fit decreasing and compares its bins with the best lower bound that
dual-feasible functions give for its lengths, in every round, the last too. Bins of a group
that meets its bound are final, but for one that is less than half full. A group with a gap
opens its emptiest bins, so many that their room is twice what its gap needs. The documents
of open bins are exchanged: dealt anew to as many groups as they need, and packed again.
If an exchange does not lower the bins of what was opened by LEAST_GAIN of the gap, it was
the last of its kind: where it made more bins the packing before it stands, and from then
on only bins that are less than half full (one a group at most) are opened, so the rest soon
fits one group. All groups are of bounded size and no number is capped; each row says how
many bins its group made and how many it needs at least.

Cases: a null or empty text is the end id alone; repeated rows are packed each; equal
lengths are placed by row number, so a rerun gives the same bins; no rows give no rows;
columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.tokens import word_ids

#: Pieces in a group; the share of the gap that an exchange must win for another to follow.
GROUP, LEAST_GAIN = 20_000, 0.01


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and with_ids: ids, little-endian unsigned 32-bit) of every document."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        words = word_ids(tokenizer_path)
        for b in batches:
            row, cols = [], [[] for _ in names[1:]]
            for i, text in enumerate(b.column(1)):
                ids = words.ids(text.as_py()) + end
                for k in range(ceil(len(ids) / 4 / capacity)):
                    part = ids[4 * capacity * k : 4 * capacity * (k + 1)]
                    row.append(i)
                    for col, value in zip(cols, (k, capacity * k, len(part) // 4, zlib.crc32(part), part)):
                        col.append(value)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def lower_bound(counts: np.ndarray) -> int:
    """The least number of bins for counts[l] items of each length l = 0..capacity.

    The greatest of the bounds of two families of dual-feasible functions: one takes
    lengths above C - e as whole bins and those below e as nothing; the other, for k = 1
    to 32, rounds (k + 1) l / C down to k-ths unless it is whole.
    """
    c = len(counts) - 1
    length = np.arange(c + 1, dtype=np.int64)
    n, mass = np.cumsum(counts), np.cumsum(counts * length)
    best = ceil(int(mass[-1]) / c)
    e = np.arange(1, c // 2 + 1)
    large = n[-1] - n[c - e]
    between = mass[c - e] - mass[e - 1]
    best = max(best, int((large + -(-between // c)).max(initial=0)))
    for k in range(1, 33):
        scaled = (k + 1) * length
        value = np.where(scaled % c == 0, length * k, scaled // c * c)  # times k
        best = max(best, ceil(int((counts * value).sum()) / (c * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item (items in descending order of length) and how many bins there are."""
    bins = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with room r
    n = 0
    for i, x in enumerate(lengths.tolist()):
        fits = some >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, k = capacity, n
            n += 1
        bins[i] = k
        left = r - x
        if left:
            room[left].append(k)
            some |= 1 << left
    return bins, n


def pack_group(uid: np.ndarray, lengths: np.ndarray, capacity: int, exchange: bool) -> dict[str, np.ndarray]:
    """The group's rows by bin: uid, length, bin, offset, whether it stays; and bins, bound of the group."""
    order = np.lexsort((uid, -lengths))
    uid, lengths = uid[order], lengths[order]
    bins, n = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1))
    room = capacity - np.bincount(bins, lengths, n).astype(np.int64)
    emptiest = np.argsort(-room, kind="stable")
    emptiest = emptiest[room[emptiest] > 0]
    some = np.searchsorted(np.cumsum(room[emptiest]), 2 * (n - bound) * capacity) + 1 if exchange and n > bound else 0
    opened = np.union1d(emptiest[:some], np.flatnonzero(2 * room > capacity))
    by_bin = np.argsort(bins, kind="stable")
    uid, lengths, bins = uid[by_bin], lengths[by_bin], bins[by_bin]
    before = np.cumsum(lengths) - lengths
    first = np.searchsorted(bins, bins)  # the first item of the same bin
    return {"uid": uid, "length": lengths, "bin": bins, "offset": before - before[first], "stays": ~np.isin(bins, opened), "bins": np.full(len(uid), n), "bound": np.full(len(uid), bound)}


def _packer(turn: int, capacity: int, exchange: bool, last: bool):
    def run(key, t):
        found = pack_group(t.column("uid").to_numpy(), t.column("length").to_numpy(), capacity, exchange)
        found["sequence_id"] = (turn << 56) + (int(key[0].as_py()) << 32) + found.pop("bin")
        if last:
            found["stays"][:] = True
        return pa.table(found).select(["uid", "length", "sequence_id", "offset", "stays", "bins", "bound"])

    return run


def _dealt(rows: DataFrame, groups: int, turn: int) -> DataFrame:
    """uid, length and g: each batch is dealt round in order of length, so that every group gets long and short pieces in the same shares.

    rows is a staged table: a task that runs again reads the same batches and deals them the same way.
    """

    def run(batches):
        for b in batches:
            uid, size = b.column(0).to_numpy(), b.column(1).to_numpy()
            g = np.empty(len(uid), np.int32)
            start = zlib.crc32(f"{turn}:{uid[0] if len(uid) else 0}".encode())
            g[np.lexsort((uid, size))] = (np.arange(len(uid)) + start) % groups
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(g)], ["uid", "length", "g"])

    return rows.select("uid", "length").mapInArrow(run, "uid long, length long, g int")


def packed(lengths: DataFrame, capacity: int = 4096, uid: str = "uid", length: str = "length") -> DataFrame:
    """uid, sequence_id, offset, group_bins, group_bound for rows of distinct uid (long) and length 1..capacity."""
    rest = staged(lengths.select(F.col(uid).cast("long").alias("uid"), F.col(length).cast("long").alias("length")), "lengths")
    n, done, turn, groups, exchange, opened, before = rest.count(), None, 0, 1 << 40, True, None, None
    final = ["uid", "sequence_id", "offset", F.col("bins").alias("group_bins"), F.col("bound").alias("group_bound")]
    while True:
        groups = max(1, min(ceil(n / GROUP), groups if exchange else ceil(groups / 2)))
        tried = _dealt(rest, groups, turn).groupBy("g").applyInArrow(_packer(turn, capacity, exchange, groups == 1), "uid long, length long, sequence_id long, offset long, stays boolean, bins long, bound long")
        tried = staged(tried, "packed")
        # each bin has one row with offset 0
        heads = tried.where("offset = 0").groupBy("bins", "bound", F.expr("shiftright(sequence_id, 32)").alias("g")).agg(F.count_if(~F.col("stays")).alias("opened"))
        total = heads.agg(F.sum("bins").alias("bins"), F.sum(F.col("bins") - F.col("bound")).alias("gap"), F.sum("opened").alias("opened")).first()
        if opened is not None and (total["bins"] or 0) > opened:
            # the exchange made it worse: the packing before it stands, but for the bins less than half full
            half = before.groupBy("sequence_id").agg(F.sum("length").alias("filled")).where(2 * F.col("filled") < capacity).select("sequence_id")
            done = done.union(before.join(half, "sequence_id", "left_anti").select(*final))
            rest, exchange, opened = staged(before.join(half, "sequence_id", "left_semi").select("uid", "length"), "rest"), False, None
        else:
            kept = tried.where("stays").select(*final)
            done = kept if done is None else done.union(kept)
            if groups == 1:
                return done
            gained = opened is None or opened - total["bins"] >= max(1, LEAST_GAIN * total["gap"])
            before = tried.where("NOT stays")
            rest, opened = staged(before.select("uid", "length"), "rest"), total["opened"] if exchange else None
            exchange = exchange and gained
        n, turn = rest.count(), turn + 1
        if not n:
            return done


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; group_bins and group_bound of the group that packed it last."""
    cut = staged(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    cut = staged(cut.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    return cut.join(packed(cut, capacity), "uid").drop("uid")


def certificate(placed: DataFrame, capacity: int = 4096) -> tuple[int, int]:
    """How many sequences there are, and how many there must be at least."""
    rows = placed.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows:
        counts[r["length"]] = r["n"]
    return placed.select("sequence_id").distinct().count(), lower_bound(counts)
