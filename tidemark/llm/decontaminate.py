"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame and SQL functions only.

Words are runs of letters and digits in lower case; a shingle is five words (an item with
fewer words is one shingle of all of them). A window has as many words as the item, so
both have the same number n of shingles, and a similarity (sum of smaller over sum of
larger shingle weights, a weight being how often the shingle occurs) of `percent` needs
c = ceil(2 n t / (1 + t)) of them in common. Hence

1. Seeds: any n - c + 1 shingles of an item contain one that a matching window has; those
   that fewest items share are taken. Only around a seed that occurs in a document are
   windows laid, at its place in the item and up to n - c words before and after: every
   word by which a passage is longer or shorter costs a shingle. A document of fewer words
   than the item is one window, as a whole; it may share as few as n t shingles, so for it
   n - ceil(n t) + 1 of them are seeds, and its own number counts in the similarity.
2. A window meets the items of its size that have one of its seeds, through an index of
   SimHash blocks: equal windows are one, each has a 64-bit SimHash of its weighted
   shingles, and an item is listed under every value within RADIUS // BLOCKS = 2 bits of
   each of its BLOCKS = 8 blocks. Fingerprints within RADIUS = 23 bits agree so far in at
   least one block, hence none of those is missed; at similarity 0.8 about 10 bits differ
   (standard deviation 3), and more than 23 with a probability near 1e-6.
3. Pairs within the radius are verified on their shingles.

The seed table and the index are broadcast where their rows take no more than
`broadcast_bytes`; beyond it they are joined by shuffle.

Cases: null and blank texts and items match nothing; a null doc_id or item_id is carried
along; repeated documents and items give one row each pair of ids (most similar window,
then the first); no rows give no rows; columns other than the four named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

SHINGLE, RADIUS, BLOCKS = 5, 23, 8
_BITS = 64 // BLOCKS
#: Of a row of the seed table and of the index: numbers and their places in a hash table.
ROW_BYTES = 64


def word_hash_array(text: str) -> str:
    """SQL: the hashes of the words of a text column."""
    return f"transform(array_remove(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), ''), w -> xxhash64(w))"


def _shingles(h: str, width: int) -> str:
    """SQL: hashes of the runs of `width` word hashes in array h, in order and with repeats."""
    parts = ", ".join(f"{h}[i + {k}]" for k in range(width))
    return f"transform(sequence(0, size({h}) - {width}), i -> xxhash64({parts}))"


def _simhash(s: str) -> str:
    """SQL: bit b is set where more than half of the weight of shingles s has it."""
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * aggregate({s}, 0, (c, x) -> c + int(shiftright(x, b) & 1L)) > size({s}), shiftleft(1L, b), 0L))"


def _block(f: str, k: int) -> str:
    return f"(shiftright({f}, {k * _BITS}) & {(1 << _BITS) - 1}L)"


def _blocks(f: str) -> str:
    return "array(" + ", ".join(f"struct({k} AS k, {_block(f, k)} AS v)" for k in range(BLOCKS)) + ")"


#: The numbers with as many bits as one block of fingerprints within the radius may differ in.
_MASKS = "array(" + ", ".join(f"{m}L" for m in range(1 << _BITS) if m.bit_count() <= RADIUS // BLOCKS) + ")"
_FIRST_MET = "CASE " + " ".join(f"WHEN bit_count({_block('(f ^ item_f)', k)}) <= {RADIUS // BLOCKS} THEN {k}" for k in range(BLOCKS)) + " END"
#: The weight that two arrays of shingles share; repeats count as often as both have them.
_SHARED = (
    "CASE WHEN size(array_distinct(s)) = size(s) OR size(array_distinct(item_s)) = size(item_s) THEN size(array_intersect(s, item_s)) "
    "ELSE aggregate(array_distinct(item_s), 0, (c, x) -> c + least(size(filter(s, y -> y = x)), size(filter(item_s, y -> y = x)))) END"
)


def prepared_items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """item (a number of its own), item_id, words (how many), width (of a shingle), s (shingles), item_f (SimHash)."""
    base = items.select(F.col(f"`{item_id}`").alias("item_id"), F.expr(word_hash_array(f"cast(`{item_text}` AS string)")).alias("h")).where("size(h) > 0")
    width = f"CASE {' '.join(f'WHEN size(h) = {k} THEN {_shingles("h", k)}' for k in range(1, SHINGLE))} ELSE {_shingles('h', SHINGLE)} END"
    base = base.select("item_id", F.expr("size(h)").alias("words"), F.expr(f"least(size(h), {SHINGLE})").alias("width"), F.expr(width).alias("s"))
    return base.distinct().select(F.expr("xxhash64(item_id, s)").alias("item"), "*", F.expr(_simhash("s")).alias("item_f"))


def _matches(docs: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, r (hash of the text), item_id, start_word, n_words, shared, similarity: one row for each window that is similar enough."""
    t = percent / 100
    item = staged(prepared_items(items, item_id, item_text), "items")
    need = F.ceil(F.lit(2 * t / (1 + t)) * F.size("s") - 1e-9).cast("int")
    placed = item.select("item", "words", "width", (F.size("s") - need).alias("slack"), (F.size("s") - F.ceil(F.lit(t) * F.size("s") - 1e-9).cast("int")).alias("shorter"), F.posexplode("s").alias("at", "shingle"))
    spread = placed.groupBy("width", "shingle").agg(F.countDistinct("item").alias("shared_by"))
    one = placed.groupBy("item", "words", "width", "slack", "shorter", "shingle").agg(F.count("*").alias("weight"), F.collect_set("at").alias("ats")).join(spread, ["width", "shingle"])
    ahead = "coalesce(sum(weight) OVER (PARTITION BY item ORDER BY shared_by, shingle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    first = staged(one.select("*", F.expr(ahead).alias("ahead")).where("ahead <= shorter"), "first")
    seeds = first.select("width", "shingle", "words", "slack", "shorter", (F.col("ahead") <= F.col("slack")).alias("near"), F.explode("ats").alias("at")).distinct()
    seeds = staged(seeds, "seeds")
    sizes = {r["width"]: r["n"] for r in seeds.groupBy("width").agg(F.count("*").alias("n")).collect()}  # at most SHINGLE rows
    small = lambda df, n: F.broadcast(df) if n * ROW_BYTES <= broadcast_bytes else df

    text = f"cast(`{text_col}` AS string)"
    hashed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.expr(f"xxhash64({text})").alias("r"), F.expr(word_hash_array(text)).alias("h"))
    windows = None
    for width, n in sizes.items():
        runs = ", ".join(["h", *(f"slice(h, {k}, size(h))" for k in range(2, width + 1))])
        placed_words = hashed.where(f"size(h) >= {width}").select("doc_id", "r", "h", F.expr(f"posexplode(arrays_zip({runs}))").alias("at_word", "w"))
        run = [F.col("w").getField("h"), *(F.col("w").getField(str(k)) for k in range(1, width))]
        placed_words = placed_words.where(run[-1].isNotNull())
        of_width = seeds.where(F.col("width") == width).select("shingle", "words", "slack", "shorter", "near", "at")
        hits = placed_words.withColumn("shingle", F.xxhash64(*run)).join(small(of_width, n), "shingle")
        # the stretch that holds all windows around this seed
        low = "greatest(0, at_word - at - slack)"
        stretch = hits.where("near").select("doc_id", "r", "words", "shingle", F.expr(low).alias("low"), F.expr(f"slice(h, {low} + 1, at_word - at + slack + words - {low})").alias("part"))
        stretch = stretch.where("size(part) >= words").distinct()
        win = stretch.select("doc_id", "r", "words", "shingle", "low", "part", F.expr("explode(sequence(0, size(part) - words))").alias("k"))
        win = win.select("doc_id", "r", "words", "shingle", (F.col("low") + F.col("k")).alias("start_word"), F.expr("slice(part, k + 1, words)").alias("h")).distinct()
        # a document with fewer words than the item is a window as a whole
        short = hits.where("size(h) < words AND size(h) >= words - shorter").select("doc_id", "r", "words", "shingle", F.lit(0).alias("start_word"), "h").distinct()
        windows = win.union(short) if windows is None else windows.union(win).union(short)
    if windows is None:
        return hashed.where("false").select("doc_id", "r", F.lit(None).cast(item.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0).alias("shared"), F.lit(0.0).alias("similarity"))
    windows = staged(windows, "windows")

    pick = f"CASE {' '.join(f'WHEN words = {k} THEN {_shingles("h", k)}' for k in range(1, SHINGLE))} ELSE {_shingles('h', SHINGLE)} END"
    prints = windows.select("h", "words").distinct().select("h", "words", F.expr(pick).alias("s")).select("*", F.expr(_simhash("s")).alias("f"))
    prints = staged(prints, "prints")  # its blocks would each compute the print anew
    holders = first.select("shingle", "words", "item").distinct()
    held = windows.select("h", "words", "shingle").distinct().join(holders, ["shingle", "words"]).select("h", "words", "item").distinct()
    left = prints.join(held, ["h", "words"]).select("*", F.expr(f"inline({_blocks('f')})"))
    index = item.select("item", "item_f", F.expr(f"inline({_blocks('item_f')})")).select("item", "item_f", "k", F.expr(f"explode(transform({_MASKS}, m -> m ^ v))").alias("v"))
    index = staged(index, "index")
    near = left.join(small(index, index.count()), ["item", "k", "v"]).where(f"bit_count(f ^ item_f) <= {RADIUS} AND k = {_FIRST_MET}")
    near = near.join(item.select("item", "item_id", F.col("s").alias("item_s")), "item")
    sure = near.select("h", "words", "item_id", (F.size("s") + F.size("item_s")).alias("both"), F.expr(_SHARED).alias("shared")).where(f"100 * shared >= {percent} * (both - shared)")
    sure = staged(sure.select("h", "words", "item_id", "shared", (F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity")), "sure")
    found = windows.select("doc_id", "r", "words", "start_word", "h").distinct().join(sure, ["h", "words"])
    return found.select("doc_id", "r", "item_id", "start_word", F.size("h").alias("n_words"), "shared", "similarity")


def contaminated(docs: DataFrame, items: DataFrame, *args, **options) -> DataFrame:
    """doc_id, item_id, start_word (from 0), n_words, shared, similarity: one row for each document and item that it holds.

    Arguments as of _matches.
    """
    found = _matches(docs, items, *args, **options)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("before"), "n_words", "shared")).alias("best")
    out = found.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", (-F.col("best.before")).alias("start_word"), F.col("best.n_words").alias("n_words"), F.col("best.shared").alias("shared"), F.col("best.similarity").alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that hold a benchmark item; a null doc_id is no excuse."""
    bad = _matches(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("_bad"), F.col("r").alias("_bad_text")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["_bad_text"]), "left_anti")
