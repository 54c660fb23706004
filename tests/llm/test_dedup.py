from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, linededup, minhash
from tidemark.llm.common import connected_components


def sets(text, size):
    w = (text or "").encode().lower().split()
    n = min(size, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def expected_groups(rows, size, percent):
    s = {i: sets(t, size) for i, t in rows}
    top = {i: i for i in s}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b]:
                c = len(s[a] & s[b])
                if 100 * c >= percent * (len(s[a]) + len(s[b]) - c):
                    x, y = sorted((find(a), find(b)))
                    top[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, sf_dir, size):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 150")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, size).collect()}
    assert got == expected_groups([(r.doc_id, r.text) for r in docs.collect()], size, 80)


def test_near_duplicates_in_a_family_whose_hub_reaches_only_some(spark):
    """Texts that are linked with each other but not with the smallest of their family."""
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(24):
        w = list(base)
        for k in range(0, 300, 12):
            w[k] = f"own{i // 2}_{k}"  # pairs share their changes
        w[7] = f"single{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 2).collect()}
    want = expected_groups(rows, 2, 80)
    assert got == want and len({c for _, c in want.values()}) == 12


def test_near_duplicates_in_loose_clusters_equal_brute_force(spark):
    """Versions that drift from each other, so that most pairs of a cluster lie below the threshold and hubs reach few."""
    rng = np.random.default_rng(11)
    rows = []
    for c in range(6):
        w = [f"c{c}w{k}" for k in range(150)]
        for v in range(40):
            if v % 8 == 0:
                w = [f"c{c}w{k}" for k in range(150)]
            for k in rng.choice(150, rng.integers(2, 14), replace=False):
                w[k] = f"new{c}_{v}_{k}"
            rows.append((int(rng.permutation(10_000)[0]) * 1000 + len(rows), " ".join(w)))
    want = expected_groups(rows, 2, 80)
    assert 10 < len({c for _, c in want.values()}) < 200
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == want


def test_two_texts_that_a_bucket_has_left_are_compared(spark, monkeypatch):
    """Buckets of five texts, in each one pair alike: which pair the hub rounds leave over depends on the bucket."""
    rng = np.random.default_rng(6)
    rows, signed, pairs = [], [], {}
    for g, (x, y) in enumerate([(x, y) for x in range(2, 5) for y in range(1, x)] * 5):
        base = rng.integers(0, 250, minhash.REGISTERS).astype(np.uint8)
        alike = [f"g{g}w{k}" for k in range(40)]
        for m in range(5):
            r = base.copy()
            r[8::8] = 250 + m  # one register of every band but the first
            words = alike + [f"m{m}"] if m in (x, y) else [f"g{g}m{m}w{k}" for k in range(41)]
            rows.append((10 * g + m, " ".join(words)))
            signed.append((10 * g + m, 41, f"{g},{m}".encode(), r.view(np.int64).tolist()))
        pairs[10 * g + x] = 10 * g + y
    monkeypatch.setattr(minhash, "signatures", lambda *a: spark.createDataFrame(signed, "doc_id long, n_shingles long, digest binary, bands array<long>"))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert got == {i: pairs.get(i, i) for i, _ in rows}


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs, 2).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].component_id == by[2][0].component_id == by[3][0].component_id == 1
    assert [by[i][0].n_shingles for i in (4, 5, 6)] == [0, 0, 0] and all(by[i][0].kept for i in (4, 5, 6))
    assert by[8][0].n_shingles == 1 and by[9][0].component_id == 8 and not by[9][0].kept
    assert by[None][0].component_id is None and by[None][0].kept
    assert len(by[7]) == 3 and len(by[13]) == 2
    assert minhash.near_duplicates(no_docs, 2).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    a, b = np.sort(x[:3000]), np.sort(x[1000:])
    agree = (minhash.registers(a) == minhash.registers(b)).sum()
    assert abs(minhash.estimated(agree, len(a), len(b)) - 2000 / len(x)) < 0.09


def test_common_counts_equal_set_sizes():
    rng = np.random.default_rng(1)
    for _ in range(10):
        some = lambda: [np.unique(rng.integers(0, 300, rng.integers(0, 60)).astype(np.uint64)) for _ in range(rng.integers(1, 25))]
        l, r = some(), some()
        assert (minhash.common_counts(l, r, frequent=3, width=7) == [[len(np.intersect1d(a, b)) for b in r] for a in l]).all()


def test_connected_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 10), (20, 21), (21, 20), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 10: 3, 20: 20, 21: 20, 7: 7}
    assert connected_components(links.where("false")).count() == 0


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    from tidemark.llm import common

    written = []
    monkeypatch.setattr(common, "staged", lambda df, name, instead_of=(), staged=common.staged: written.append(name) or staged(df, name, instead_of))
    chain = spark.range(2_000).selectExpr("id AS a", "id + 1 AS b")
    got = connected_components(chain).groupBy("component").count().collect()
    assert [(r.component, r["count"]) for r in got] == [(0, 2_001)]
    assert written.count("pairs") <= 18


def expected_lines(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda x: x[0]):
        left = []
        for c in linededup.chunks(text, 2, 64):
            if linededup._counts(c):
                if c in seen:
                    continue
                seen.add(c)
            left.append(c)
        out[i] = b"\n".join(left).decode()
    return out


def test_line_dedup_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert got == expected_lines([(r.doc_id, r.text) for r in docs.collect()])


def test_line_dedup_leaves_nothing_of_exact_copies(spark):
    """Not by chunks(): of copies nothing may be left, and a long line or passage stays once."""
    rng = np.random.default_rng(3)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    sizes = [[9] * n for n in range(2, 40)] + [[60], [9, 60], [60, 9], [9, 60, 9, 60], [60, 9, 9, 9], [9, 9, 60, 60, 9], [9] * 65, [9] * 129]
    texts = ["\n".join(line(n) for n in s) for s in sizes] + ["\n\n".join(line(n) for n in s) for s in sizes]
    rows = [(c * len(texts) + i, t) for c in range(3) for i, t in enumerate(texts)]
    own, planted = [line(12) for _ in range(60)], line(70)
    rows += [(10_000 + k, "\n".join([own[4 * k], own[4 * k + 1], planted, own[4 * k + 2], own[4 * k + 3]])) for k in range(15)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == t for i, t in enumerate(texts))
    assert {i for i in range(len(texts), 3 * len(texts)) if got[i].strip()} == set()
    assert [k for k in range(15) if planted in got[10_000 + k]] == [0]
    assert all(x in "\n".join(got.values()) for x in own)


def test_line_dedup_removes_every_later_passage(spark):
    """Passages of over 50 words between neighbours that differ everywhere, with blank lines and cut anywhere."""
    rng = np.random.default_rng(4)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    planted = [[line(n) for n in s] for s in ([51], [26, 25], [17, 17, 17], [50, 1], [1, 50], [3] * 17, [1] * 51, [40, 9, 9, 40])]
    rows, own = [], []
    for k, p in enumerate(planted):
        for c in range(12):
            own += [line(9), line(9), line(9)]
            gap = "\n\n" if c % 3 == 2 else "\n"
            rows.append((100 * k + c, "\n".join([own[-3], own[-2], gap.join(p), own[-1]] if c % 2 else [own[-3], gap.join(p), own[-2], own[-1]])))
    short = [line(25), line(25)]
    rows += [(5000 + c, "\n".join([line(9), short[0], line(9), short[1]])) for c in range(3)]
    rows += [(6000, "\n".join(["again"] * 200))]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), whole_passages=True).collect()}
    for k, p in enumerate(planted):
        assert got[100 * k].text.split("\n") == rows[12 * k][1].split("\n")
        for c in range(1, 12):
            assert not set(p) & set(got[100 * k + c].text.split("\n")) and got[100 * k + c].n_chunks_removed > 0
    lines = [x for r in got.values() for x in r.text.split("\n")]
    assert all(lines.count(x) == 1 for x in own) and all(lines.count(x) == 3 for x in short)
    assert lines.count("again") >= 51
    assert all(r.chars_removed == len(t) - len(got[i].text) for i, t in rows for r in [got[i]])


def test_chunks_are_shift_resistant_and_lossless():
    body = [f"line {i * i % 97} of the body" for i in range(200)]
    one, two = "\n".join(body), "\n".join(["new", "lines", "ahead", *body])
    a, b = linededup.chunks(one, 2, 64), linededup.chunks(two, 2, 64)
    assert b"\n".join(a).decode() == one and b"\n".join(b).decode() == two
    assert sum((Counter(a) & Counter(b)).values()) >= len(a) - 3
    assert all(len(c.split(b"\n")) <= 64 for c in a)


def test_line_dedup_odd_rows(spark, odd_docs, no_docs):
    wide = odd_docs.withColumns({"d": F.lit(1), "r": F.lit(2), "z": F.lit("q"), "gone": F.lit(None).cast("string")})
    rows = linededup.dedup_lines(wide).collect()
    assert len(rows) == odd_docs.count() and rows[0].d == 1 and rows[0].z == "q"
    assert {r.text for r in rows if r.doc_id == 4} == {None} and {r.text for r in rows if r.doc_id == 5} == {""}
    assert linededup.dedup_lines(no_docs).count() == 0
    block = "first line of it\nsecond line of it\nthird line"
    twice = spark.createDataFrame([(1, block), (1, block), (2, block), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in linededup.dedup_lines(twice).collect() if r.doc_id)
    assert got[0] == got[1] == (1, block) and got[2][1] != block


def leaks(docs, items, percent=80):
    """Every window of item size, all shingle weights."""
    import regex

    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    out = set()
    for i, item in items:
        w = words(item)
        if not w:
            continue
        k = min(5, len(w))
        s = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
        for d, text in docs:
            v = words(text)
            for a in range(len(v) - len(w) + 1):
                t = Counter(tuple(v[a + j : a + j + k]) for j in range(len(w) - k + 1))
                if 100 * sum((s & t).values()) >= percent * sum((s | t).values()):
                    out.add((d, i))
                    break
    return out


def test_decontamination_equals_brute_force(spark):
    item = " ".join(f"q{i}" for i in range(60))
    changed = item.replace("q30 ", "other ")
    longer = item.replace("q20 q21", "q20 extra q21")
    short = "only three words"
    rows = [(1, f"before {item} after"), (2, f"x y z {changed} end"), (3, f"so {longer} on"), (4, " ".join(f"q{i}" for i in range(0, 60, 2))), (5, "Only, THREE words!"), (6, None), (7, ""), (8, item.upper()), (9, item[: len(item) // 2]), (10, "q1 q1 q1 q1 q1 q1 " * 30)]
    items = [(1, item), (2, short), (3, None), (4, ""), (5, "q1 q1 q1 q1 q1 q1 q1 q1"), (1, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "words": F.lit("w"), "similarity": F.lit(0)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == leaks(rows, items) and {(1, 1), (8, 1), (5, 2), (10, 5)} <= got
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in got}
    assert decontaminate.contaminated(docs, bench, broadcast_bytes=0).count() == len(got)


def test_decontamination_of_short_documents_and_null_ids(spark):
    w = [f"q{i}" for i in range(60)]
    rows = [(1, " ".join(w[1:])), (2, " ".join(w[:-9])), (3, " ".join(w[6:-5])), (4, " ".join(w[:-12])), (5, " ".join(w[8:])), (None, "so " + " ".join(w)), (None, "a clean text"), (6, "another")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    got = {r.doc_id: (r.start_word, r.n_words, r.shared, r.similarity) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {1: (0, 59, 55, 55 / 56), 2: (0, 51, 47, 47 / 56), 3: (0, 49, 45, 45 / 56), 5: (0, 52, 48, 48 / 56), None: (1, 60, 56, 1.0)}
    assert {(r.doc_id, r.text) for r in decontaminate.clean(docs, items).collect()} == {rows[3], rows[6], rows[7]}


def test_index_meets_every_print_within_the_radius_and_few_others(spark):
    rng = np.random.default_rng(12)
    f = rng.integers(-(2**63), 2**63 - 1, 400)
    flips = [sum(1 << int(b) for b in rng.choice(64, k % (decontaminate.RADIUS + 1), replace=False)) for k in range(400)]
    rows = [(int(x), int(x ^ np.uint64(y).astype(np.int64))) for x, y in zip(f, flips)] + [(int(x), int(y)) for x, y in zip(f, rng.permutation(f))]
    df = spark.createDataFrame(rows, "f long, item_f long").selectExpr("*", f"{decontaminate._FIRST_MET} IS NOT NULL AS met", f"bit_count(f ^ item_f) <= {decontaminate.RADIUS} AS near")
    assert df.where("near AND NOT met").count() == 0 and df.where("near").count() >= 400


def test_decontamination_with_equal_windows_and_repeated_items(spark):
    """Ties go to the first window; one id with two texts, equal texts under two ids, and a null item id are carried along."""
    w = " ".join(f"q{i}" for i in range(30))
    v = " ".join(f"z{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{w} between {w}"), (2, v), (2, v), (None, w)], "doc_id long, text string")
    items = spark.createDataFrame([(1, w), (1, v), (2, w), (None, v), (1, w)], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id or 0, r.start_word, r.similarity) for r in decontaminate.contaminated(docs, items).collect()))
    assert got == [(0, 1, 0, 1.0), (0, 2, 0, 1.0), (1, 1, 0, 1.0), (1, 2, 0, 1.0), (2, 0, 0, 1.0), (2, 1, 0, 1.0)]
    assert decontaminate.clean(docs, items).count() == 0


def test_decontamination_recall_near_the_threshold(spark):
    """400 passages with random edits against brute force."""
    rng = np.random.default_rng(13)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(int(rng.integers(20, 70))))) for i in range(40)]
    rows = []
    for d in range(400):
        w = items[d % 40][1].split()
        for k in rng.choice(len(w), int(rng.integers(0, 3)), replace=False):
            w[k] = f"d{d}"
        rows.append((d, " ".join([f"x{d}"] * int(rng.integers(0, 9)) + w + [f"y{d}"] * int(rng.integers(0, 9)))))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = leaks(rows, items)
    assert len(want) > 200 and got == want


def test_decontamination_empty_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "some words of an item to look for")], "item_id long, text string")
    assert decontaminate.contaminated(no_docs, bench).count() == 0
    assert decontaminate.contaminated(odd_docs, bench).count() == 0
    assert decontaminate.contaminated(odd_docs, bench.where("false")).count() == 0


def test_hubs_of_a_crowd_are_joined_once(spark, monkeypatch):
    """Near copies that meet in buckets of many hubs: components are found over few edges, not over every pair of hub and member."""
    rng = np.random.default_rng(8)
    rows, seen = [], []
    for i in range(300):
        w = [f"b{k}" for k in range(200)]
        for k in rng.choice(8, 2, replace=False):
            w[20 * k] = f"x{k}_{rng.integers(3)}"  # changes that many share: their buckets have hubs of their own
        rows.append((i, " ".join(w)))

    def watched(links, *names):
        seen.append((links.count(), links.select(F.explode(F.array("a", "b")).alias("x")).distinct().count()))
        return connected_components(links, *names)

    monkeypatch.setattr(minhash, "connected_components", watched)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == expected_groups(rows, 2, 80)
    edges, nodes = seen[0]
    assert nodes > 100 and edges < 2 * nodes
