import random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import queries, simhash


def plain_print(text, size=3):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(prints):
    """Index of the smallest of each print's component, all pairs compared."""
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return [find(x) for x in range(len(prints))]


def test_query_equals_brute_force(spark, sf_dir):
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    prints = [plain_print(r.text) for r in rows]
    want = {r.doc_id: (f"{p:016x}", rows[c].doc_id) for r, p, c in zip(rows, prints, components(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op13_simhash_near_dedup"](spark, sf_dir).collect()} == want


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("crowd", [1, 4, 32])
def test_links_of_crowded_and_loose_cells_equal_all_pairs(spark, crowd):
    """Chains, clouds around centres and prints of none, so that each level of the grid has work."""
    rng = random.Random(crowd)
    prints = {0, 1, 2**64 - 1, 2**63}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):  # a walk
            prints.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
        centre = rng.getrandbits(64)
        for _ in range(90):
            y = centre
            for _ in range(rng.randint(0, 3)):
                y ^= 1 << rng.randrange(64)
            prints.add(y)
    prints = sorted(prints)
    got = simhash.links(spark.createDataFrame([(signed(x),) for x in prints], "fp long"), crowd)
    found = [(a % 2**64, b % 2**64) for a, b in got.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    at = {x: i for i, x in enumerate(prints)}
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in found:
        x, y = sorted((find(at[a]), find(at[b])))
        top[y] = x
    assert [find(x) for x in range(len(prints))] == components(prints)


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_popcounts_bound_the_distance_and_cells_meet(spark, bits):
    rng = random.Random(bits)
    pairs = []
    for _ in range(200):
        x = y = rng.choice([rng.getrandbits(64), 0, 2**64 - 1])
        for _ in range(rng.randint(0, 2)):
            y ^= 1 << rng.randrange(64)
        pairs.append((signed(x), signed(y)))
    df = spark.createDataFrame(pairs, "x long, y long")
    r = df.select("x", simhash.popcounts(F.col("x"), bits).alias("v"), F.size(F.array_intersect(simhash.cells(F.col("x"), bits), simhash.cells(F.col("y"), bits))).alias("met")).collect()
    field = (1 << bits) - 1
    for x, v, met in r:
        assert met > 0
        assert [v % 2**64 >> k & field for k in range(0, 64, bits)] == [(x % 2**64 >> k & field).bit_count() for k in range(0, 64, bits)]


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].component_id == by[2][0].component_id == 1
    assert {by[i][0].component_id for i in (4, 5, 6)} == {4} and by[4][0].fingerprint == "0" * 16
    assert by[8][0].component_id == by[9][0].component_id == 8
    assert by[None][0].component_id is None and by[None][0].fingerprint == by[1][0].fingerprint
    assert sorted(r.component_id for r in by[7]) == [4, 7, 7] and [r.component_id for r in by[13]] == [13, 13]
    assert simhash.near_duplicates(no_docs).count() == 0


def test_a_long_text_is_counted_in_parts(monkeypatch):
    text = " ".join(f"w{k % 911}" for k in range(5000))
    want = plain_print(text)
    monkeypatch.setattr(simhash, "PART", 128)
    assert simhash.fingerprint(text) == want


def test_no_join_on_cells_is_broadcast(spark, monkeypatch):
    """Spark sizes exploded cells like the fingerprints that they come from."""
    plans = []
    kept, plan = simhash.staged, lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(simhash, "staged", lambda df, name: (plan(df), kept(df, name))[1])
    rng = random.Random(8)
    prints = spark.createDataFrame([(signed(x ^ 1 << k),) for x in (rng.getrandbits(64) for _ in range(3)) for k in range(64)], "fp long")
    plan(simhash.links(prints, crowd=1))
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
