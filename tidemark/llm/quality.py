"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Arrow batches. The trees are fitted on at most
`max_rows` labelled rows (those with the smallest hash of doc_id, a documented bound),
in numpy on the driver, over quantile bins; the model is flat arrays of a few hundred KB.
All rows are then scored where they lie: a batch walks all trees at once, one level a
step. No shuffle moves a text.

Cases: null and empty texts have all statistics 0 and get a score; rows with a null
doc_id are not held out and are never learned from; rows that repeat a doc_id are scored
each; labels that are null are ignored, and without any (or with one class) every score is
the share of good labels, or 0.5; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "lower", "upper", "digit", "space", "newline", "sentence", "comma",
    "sign", "bracket", "high", "distinct_words", "top_word", "repeats", "distinct_pairs", "distinct_lines", "line_words", "byte_entropy",
    "one_letter", "long_words", "sign_words", "capital_words",
)
_KIND = np.zeros(256, np.int64)  # 0: other signs
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".!?", b",;:", b"()[]{}<>|"), 1):
    _KIND[list(_chars)] = _k
_KIND[128:] = 9


def statistics(text: str | None) -> list[float]:
    """The values of NAMES for a whole text."""
    if not text:
        return [0.0] * len(NAMES)
    body = text.encode("utf-8", "replace")
    data = np.frombuffer(body, np.uint8)
    n = len(data)
    by_byte = np.bincount(data, minlength=256)
    kinds = np.bincount(_KIND, weights=by_byte, minlength=10) / n
    p = by_byte[by_byte > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    words = body.split()
    m = len(words)
    if not m:
        return [np.log1p(n), 0, 0, 0, *kinds[1:8].tolist(), kinds[0], *kinds[8:10].tolist(), 0, 0, 0, 0, 0, 0, entropy, 0, 0, 0, 0]
    size = np.fromiter(map(len, words), np.int64, m)
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(code.__getitem__, words), np.int64, m)
    pairs = np.unique(codes[:-1] * len(code) + codes[1:]).size if m > 1 else 1
    lines = [x for x in body.split(b"\n") if x]
    first = np.fromiter((w[0] for w in words), np.int64, m)
    last = np.fromiter((w[-1] for w in words), np.int64, m)
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(size.mean()), float(size.std()), *kinds[1:8].tolist(), float(kinds[0]), *kinds[8:10].tolist(),
        len(code) / m, float(np.bincount(codes).max() / m), float((codes[1:] == codes[:-1]).sum() / m), pairs / max(1, m - 1), len(set(lines)) / max(1, len(lines)),
        m / max(1, len(lines)), entropy, float((size == 1).mean()), float((size > 20).mean()), float((_KIND[last] == 0).mean()), float((_KIND[first] == 2).mean()),
    ]


@dataclass
class Trees:
    """Flat trees: node k of a tree sends a row left if bin[feature[k]] <= cut[k]; leaves point at themselves."""

    edges: np.ndarray  # features x (bins - 1), upper bin edges
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for rows of statistics."""
        raw = np.full(len(x), self.start)
        if len(self.roots) and len(x):
            b = self.binned(x)
            row = np.arange(len(x))[:, None]
            node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(b[row, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            raw = raw + self.value[node].sum(1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Boosted trees for the logistic loss, grown level by level from gradient histograms."""
    share = float(y.mean()) if len(y) else 0.5
    grid = np.linspace(0, 1, bins + 1)[1:-1]
    edges = np.stack([np.quantile(x[:, j], grid) for j in range(x.shape[1])]) if len(y) else np.zeros((x.shape[1], bins - 1))
    empty = np.zeros(0, np.int64)
    if not 0 < share < 1:
        rest = np.clip(share, 1e-3, 1 - 1e-3)
        return Trees(edges, empty, empty, empty, empty, np.zeros(0), empty, 0, float(np.log(rest / (1 - rest))))
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    model = Trees(edges, empty, empty, empty, empty, np.zeros(0), empty, depth, float(np.log(share / (1 - share))))
    b = model.binned(x)
    raw = np.full(len(y), model.start)
    n_features = x.shape[1]

    def new() -> int:
        k = len(feature)
        for column, item in zip((feature, cut, left, right, value), (0, bins, k, k, 0.0)):
            column.append(item)
        return k

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        nodes = [new()]
        roots.append(nodes[0])
        place = np.zeros(len(y), np.int64)  # of a row among this level's nodes, -1 in a leaf
        final = np.zeros(len(y), np.int64) + nodes[0]
        for level in range(depth):
            live = place >= 0
            k = len(nodes)
            hist = np.zeros((3, n_features, k, bins))
            for j in range(n_features):
                slot = place[live] * bins + b[live, j]
                for q, w in enumerate((g[live], h[live], None)):
                    hist[q, j] = np.bincount(slot, w, k * bins).reshape(k, bins)
            gl, hl, nl = hist.cumsum(-1)
            gt, ht, nt = gl[..., -1:], hl[..., -1:], nl[..., -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = -np.inf
            flat = gain.transpose(1, 0, 2).reshape(k, -1)
            best = flat.argmax(1)
            following, to = [], np.full((k, 2), -1, np.int64)
            for i, node in enumerate(nodes):
                j, c = divmod(int(best[i]), bins)
                if flat[i, best[i]] > 1e-6:
                    feature[node], cut[node] = j, c
                    left[node], right[node] = new(), new()
                    to[i] = len(following), len(following) + 1
                    following += [left[node], right[node]]
                    for side, s in ((left[node], 0), (right[node], 1)):
                        gs = gl[j, i, c] if s == 0 else gt[j, i, 0] - gl[j, i, c]
                        hs = hl[j, i, c] if s == 0 else ht[j, i, 0] - hl[j, i, c]
                        value[side] = -rate * gs / (hs + ridge)
            if not following:
                break
            at = np.flatnonzero(live)
            i = place[at]
            side = (b[at, np.array(feature)[np.array(nodes)][i]] > np.array(cut)[np.array(nodes)][i]).astype(np.int64)
            place[at] = to[i, side]
            nodes = following
            moved = place >= 0
            final[moved] = np.array(nodes)[place[moved]]
        raw = raw + np.array(value)[final]
    return Trees(edges, *(np.array(c, np.int64) for c in (feature, cut, left, right)), np.array(value), np.array(roots, np.int64), depth, model.start)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Trees:
    """Trees fitted on at most max_rows labelled, not held-out rows."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", "text")  # at most max_rows pairs of numbers

    def run(batches):
        for b in batches:
            x = [statistics(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    found = rows.mapInArrow(run, "id long, y double, x array<double>").orderBy("id", "y").collect()
    x = np.array([r["x"] for r in found]).reshape(len(found), len(NAMES))
    return fit(x, np.array([r["y"] for r in found]))


def scored(docs: DataFrame, model: Trees, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        trees = shared.value
        for b in batches:
            x = np.array([statistics(t) for t in b.column(2).to_pylist()]).reshape(b.num_rows, len(NAMES))
            s = trees.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, model: Trees, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject, all columns, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column(at).to_pylist()]).reshape(b.num_rows, len(NAMES))
            yield b.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
