import random
import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh3_64_intdigest

from tidemark.llm import phrases, queries


def pieces(text):
    low = (text or "").encode().lower()
    return [[w for w in re.split(rb"[ \t]+", p) if w] for p in re.split(rb"[.,;:!?\n\x0b\x0c\r]", low)]


def expected(rows, least=10, top=2000, inside=50):
    f = {}
    for lang, text in rows:
        for w in pieces(text):
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        frequent = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in frequent.items():
            if len(p) == 2 and any(100 * b >= inside * a for q, b in frequent.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, b" ".join(p), c[p[:k]], c[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n, -s) for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "The", "of", "a", "naïve", "Ünit", "x" * 50, "<b>", "№", "it's", "end less"] + [f"w{i}" for i in range(40)]
    weight = [30 // (k + 1) + 1 for k in range(len(words))]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!?", ";", ":", "\r\n", "\x0b", " . "]
    out = []
    for k in range(1200):
        text = "".join(w + rng.choice(ends) for w in rng.choices(words, weight, k=rng.randint(0, 120)))
        out.append((rng.choice(["en", "en", "fr", None, "und"]), text if k % 17 else rng.choice([None, "", " ", "..", "one"])))
    return out + [("en", "new york city " * 30), ("en", "new york " * 25), ("fr", "seul " * 200)]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("fraction, bits", [(0.3, (25, 27)), (0.0, (25, 27)), (1.0, (3, 4))])
def test_any_sample_and_any_bitmap_give_all_phrases(spark, rows, fraction, bits):
    """A sample of nothing, of which everything fails, and bitmaps with nearly all bits set."""
    docs = spark.createDataFrame([(*x, "t") for x in rows], "lang string, text string, word string").repartition(3)
    want = expected(rows, top=40)
    assert len(want) == 120 and {x[0] for x in want} == {"en", "fr", "und"} and any(len(x[2].split()) == 3 for x in want)
    assert got(phrases.collocations(docs, top=40, fraction=fraction, filter_bits=bits)) == want


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = expected([(r.lang, r.text) for r in docs.select("lang", "text").collect()])
    assert want and got(queries.QUERIES["op12_phrase_collocations"](spark, sf_dir)) == want


def test_words_of_one_hash_are_found_and_counted_apart(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "a b. a b. c d. c d")] * 6, "lang string, text string")
    apart = phrases.counted
    seeds = []

    def clashing(docs, seed, borders, words, keep):
        seeds.append(seed)
        out = apart(docs, seed, borders, words, keep)
        return out.selectExpr("k", *(f"IF({h} IS NULL, NULL, IF({seed} = 0, 7, {h})) AS {h}" for h in ("h1", "h2", "h3")), "lang", "word", "n") if borders else out

    monkeypatch.setattr(phrases, "counted", clashing)
    found = {(r.phrase, r.a, r.l, r.r) for r in phrases.collocations(docs, fraction=1.0).collect()}
    assert found == {("a b", 12, 12, 12), ("c d", 12, 12, 12)} and {0, 1} <= set(seeds)


def test_counter_over_slices_and_full_buffers(monkeypatch):
    """A text cut in slices, sums handed over early and a vocabulary forgotten: totals stay."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcd") * rng.randint(1, 2) + rng.choice([" ", " ", " ", ".", "\t"]) for _ in range(800)).encode()
    monkeypatch.setattr(phrases, "SLICE", 40)
    monkeypatch.setattr(phrases, "BUFFER", 60)
    monkeypatch.setattr(phrases, "VOCABULARY", 5)
    full = (np.full(8, 255, np.uint8), np.full(8, 255, np.uint8))
    counter, tally, names = phrases.Counter(0, [full], True), Counter(), {}
    for batch in [*counter.add("en", text), *counter.sums()]:
        for r in batch.to_pylist():
            key = (r["key"],) if r["k"] == 1 else tuple(r["key"][i : i + 8] for i in range(0, 8 * r["k"], 8))
            tally[tuple(names.setdefault(x.partition(b"\xff")[2], x) if r["k"] == 1 else x for x in key)] += r["n"]
    of = {w: xxh3_64_intdigest(key, 0).to_bytes(8, "little") for w, key in names.items()}
    want = Counter()
    for w in pieces(text.decode()):
        for k in (1, 2, 3):
            for i in range(len(w) - k + 1):
                want[(names[w[i]],) if k == 1 else tuple(of[x] for x in w[i : i + k])] += 1
    assert tally == want


def test_passes_count_each_phrase_once():
    none, full = np.zeros(8, np.uint8), np.full(8, 255, np.uint8)
    kinds = lambda borders: Counter(r["k"] for b in _all(phrases.Counter(0, borders, False), b"a b c d") for r in b.to_pylist())
    assert kinds([(none, none)]) == {}
    assert kinds([(full, none)]) == {2: 3}
    assert kinds([(full, none), (full, full)]) == {3: 2}
    assert kinds([(full, full), (full, full)]) == {}


def _all(counter, body):
    return [*counter.add("en", body), *counter.sums()]


def test_odd_rows(odd_docs, no_docs):
    want = expected([(r.lang, r.text) for r in odd_docs.select("lang", "text").collect()])
    assert got(phrases.collocations(odd_docs)) == want
    assert phrases.collocations(no_docs).count() == 0


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    from tidemark.llm.common import BATCH_BYTES, bounded_batches

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    bounded_batches(spark)
    texts = spark.range(3_000, numPartitions=1).selectExpr("repeat('x', 4000) AS text")
    got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert len(got) > 1 and max(got) < 2 * BATCH_BYTES
