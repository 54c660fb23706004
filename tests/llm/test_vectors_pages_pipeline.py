import hashlib

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import topk, warc
from tidemark.llm.common import new_path


def expected_top(vectors, k, every):
    ok = [(i, v) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max(len(v) for _, v in ok)
    ids = np.array([i for i, _ in ok])
    m = np.zeros((len(ok), dim), np.int64)
    for r, (_, v) in enumerate(ok):
        m[r, : len(v)] = np.floor(np.array(v, np.float32).astype(float) * 1024)
    out = set()
    for r in np.flatnonzero(ids % every == 0):
        s = m @ m[r]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[r]][:k]
        out |= {(ids[r], n + 1, ids[j], s[j]) for n, j in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [40, 8192])
def test_top_k_equals_brute_force(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 25 = 0"), 10).collect()}
    assert got == expected_top([(r.vec_id, r.embedding) for r in v.collect()], 10, 25)


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, [-1.0]), (8, [0.0, 0.0]), (9, []), (None, [1.0, 1.0]), (10, [1.0, 2.0])]
    v = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, norm int")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 5 = 0"), 3).collect()}
    assert got == expected_top(rows, 3, 5)
    assert topk.top_k(v.where("false"), v).count() == 0 and topk.top_k(v, v.where("false")).count() == 0


def test_top_k_with_one_id_on_many_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 30)
    rng = np.random.default_rng(5)
    rows = [(7 if i % 2 else i, rng.normal(size=4).round(3).tolist()) for i in range(200)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id = 0"), 60).collect())
    m = np.floor(1024 * np.array([x for _, x in rows]))
    want = sorted(((-int(s), i) for (i, _), s in zip(rows, m @ m[0]) if i != 0))[:60]
    assert [(s, i) for _, i, s in got] == [(-s, i) for s, i in want]


def test_pruning_computes_few_products():
    rng = np.random.default_rng(4)
    c = np.floor(rng.normal(size=(4000, 32)) * np.exp(rng.normal(size=(4000, 1))) * np.linspace(1, 0.05, 32) * 1024)
    q = c[:5]
    basis = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    ids = np.arange(4000)
    a, v, s, full = topk.best_of_block(ids[:5], q, np.full(5, -np.inf), ids, c, 10, basis)
    assert full < 0.2 * 5 * 4000
    for i in range(5):
        want = [j for j in np.lexsort((ids, -(c @ q[i]))) if j != i][:10]
        assert sorted(v[a == i]) == sorted(want)


def test_products_beyond_doubles_are_exact():
    q, c = np.array([2.0**40, 3.0]), np.array([[2.0**20, 1.0], [2.0**40, 0.0]])
    assert topk.exact(q, c).tolist() == [2**60 + 3, 2**63 - 1]


def test_warc_round_trip(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows += [(9001, None, None), (9002, "a\nb", "x" * 300_000 + "WARC/1.1\r\n\r\n"), (9003, "u", "é" * 100_000), (9004, "u", "é" * 100_000), (9005, "u", "short"), (9006, "u", "short"), (9007, "u", "y" * 100), (9008, "u", "y" * 100), (9008, "u", "y" * 100), (9007, "u", "y" * 100), (None, "u", "y" * 100), (None, "u", None), (None, "u", "z" * 200), (None, "u", "z" * 200)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, uid int, digest string").repartition(4)
    path = new_path(spark, "warc")
    archive = warc.write_archives(pages, path)
    first, want = {}, set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        body = (h or "").encode()
        f = first.setdefault(body, i) if len(body) >= 100 else i
        want.add((i, len(body), hashlib.sha256(body).hexdigest(), "response" if f == i else "revisit", None if f == i else f))
    got = warc.read_records(spark, path, archive).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
    chunks = warc.read_chunks(spark, path, archive)
    assert chunks.selectExpr("max(octet_length(data))").first()[0] <= warc.CHUNK
    body = b"".join(bytes(r.data) for r in chunks.where("page_id = 9002").orderBy("chunk_no").collect())
    assert body.decode() == "x" * 300_000 + "WARC/1.1\r\n\r\n"
    check_files(path, archive, rows, want)


def check_files(path, archive, rows, want):
    """Reads the files by the format's own rules: a gzip member a record, headers, Content-Length; no part of the library."""
    import glob
    import zlib
    from collections import Counter

    records = []
    for name in glob.glob(path.removeprefix("file:") + "/*.warc.gz"):
        left = open(name, "rb").read()
        while left:
            z = zlib.decompressobj(31)
            raw = z.decompress(left) + z.flush()
            left = z.unused_data
            head, _, rest = raw.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            block = rest[: int(fields["Content-Length"])]
            assert first == "WARC/1.1" and rest == block + b"\r\n\r\n" and len(block) <= warc.CHUNK + 100
            records.append((fields, block))
    by_id = {f["WARC-Record-ID"]: (f, b) for f, b in records}
    assert len(by_id) == len(records) and sum(f["WARC-Type"] == "warcinfo" for f, _ in records) == 1
    pages, bodies = Counter(), {}
    for f, b in records:
        if f["WARC-Type"] == "warcinfo":
            continue
        assert by_id[f["WARC-Warcinfo-ID"]][0]["WARC-Type"] == "warcinfo"
        origin = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])
        assert by_id[origin][0]["WARC-Type"] in ("response", "revisit")
        bodies.setdefault(origin, {})[int(f.get("WARC-Segment-Number", 1))] = b
    for origin, parts in bodies.items():
        f = by_id[origin][0]
        assert sorted(parts) == list(range(1, len(parts) + 1))
        payload = b"".join(parts[k] for k in sorted(parts)).partition(b"\r\n\r\n")[2]
        stated = f["WARC-Payload-Digest"].removeprefix("sha256:")
        if f["WARC-Type"] == "revisit":
            target = by_id[f["WARC-Refers-To"]][0]
            assert payload == b"" and target["WARC-Type"] == "response" and target["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
        else:
            assert hashlib.sha256(payload).hexdigest() == stated and len(payload) == int(f["WARC-Payload-Length"])
        page = f["WARC-Record-ID"].split(":")[3]
        refers = f["WARC-Refers-To"].split(":")[3] if "WARC-Refers-To" in f else None
        pages[int(page) if page else None, int(f["WARC-Payload-Length"]), stated, f["WARC-Type"], int(refers) if refers else None] += 1
    assert set(pages) == want and sum(pages.values()) == len(rows)


def test_warc_without_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    assert warc.read_records(spark, path, warc.write_archives(pages, path)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    from tests.llm.test_dedup import expected_groups, expected_lines, leaks
    from tidemark.llm import quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    by = dict(corpus_pipeline.STAGES)
    assert list(by) == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    good = by["quality_classifier"](spark, docs, sf_dir).cache()
    model = quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert good.columns == columns and set(text(good)) == {r.doc_id for r in quality.scored(docs, model).where("predicted = 1").collect()}

    short = by["line_dedup"](spark, good, sf_dir).cache()
    before = text(good)
    want = {i: t for i, t in expected_lines(list(before.items())).items() if t.strip() or not before[i].strip() or t == before[i]}
    assert short.columns == columns and text(short) == want

    single = by["minhash_near_dedup"](spark, short, sf_dir).cache()
    groups = expected_groups(list(want.items()), 5, 80)
    assert single.columns == columns and set(text(single)) == {i for i, (_, c) in groups.items() if i == c}

    clean = by["benchmark_decontamination"](spark, single, sf_dir).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(8).collect()]
    assert clean.columns == columns and not leaks(list(text(clean).items())[:40], items)

    packed = by["best_fit_packing"](spark, clean, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(text(clean))
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)


def test_pipeline_stages_with_odd_rows(spark, sf_dir, odd_docs):
    """Nulls, empty and very long texts, repeated rows, clashing column names, and no rows at all go through every stage."""
    docs = odd_docs.selectExpr("*", "CAST(length(text) AS LONG) AS n_chars", "1 AS d", "'x' AS r", "2 AS gone", "3 AS uid")
    for rows in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, rows, sf_dir)
            assert found.columns == docs.columns, name
            kept = found.collect()
            assert len(kept) <= rows.count() and all(r.d == 1 and r.r == "x" for r in kept), name
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir)
        assert packed.where("piece = 0").count() == rows.count()
    single = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in single} >= {1, 4, 5, 6, None} and 2 not in {r.doc_id for r in single}
