import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm import alignment, queries
from tidemark.llm.tokens import as_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Ids and bytes of a text's tokens by the libraries, as a function."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letter = {as_letters(bytes([k])): k for k in range(256)}

    def bytes_b(piece):
        m = re.fullmatch("<0x(..)>", piece)
        return bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode()

    def tokens(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in ids_a], [(i, bytes_b(b.id_to_piece(i))) for i in ids_b]

    return tokens


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def expected(rows, plain):
    docs = []
    for key, text in rows:
        ta, tb = plain(text) if text else ([], [])
        same = all(b"".join(x for _, x in t) == (" " + (text or "")).encode() for t in (ta, tb))
        a, b = (spans(t) if text and same else [] for t in (ta, tb))
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, walk_a, walk_b = [], a[::-1], b[::-1]
        for hi in ends:
            sides = []
            for t in (walk_a, walk_b):
                side = []
                while t and t[-1][2] <= hi:
                    side.append(str(t.pop()[0]))
                sides.append(",".join(side))
            groups.append("|".join(sides))
        links, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        docs.append((key, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts = Counter(p for d in docs for p in set(d[4]))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [(key, na, nb, ng, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), sha) for key, na, nb, ng, links, sha in docs]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ordered = lambda rows: sorted(map(tuple, rows), key=str)


def test_query_equals_brute_force(spark, sf_dir, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = expected(rows, plain)
    assert sum(x[1] for x in want) > 100_000
    assert ordered(queries.QUERIES["op11_token_alignment"](spark, sf_dir).select(*COLUMNS).collect()) == ordered(want)


ODD = [
    None, "", " ", "   ", "a", " a  b   c ", "line\nline\n\n\tx\r\n", "x▁y", "▁", "café naïve ½ ² ﬁ", "é é", "<|endoftext|> <s> </s> <unk> <0x0A> [UNK]", "don't can't I'll we've 's '", "日本語の文 русский عربي", "\U0001f600 \U0001f469‍\U0001f4bb!", "1234567890 3.14 1,000", "a\x00b \x7f \x85 \xa0 x　y  z", "http://x.y/z?q=1&r=2#s", "x\n  y \xa0 z\x85  q \t w", "a \xa0\xa0 b", "\n", "\xa0 ", "a\xa0 b", "foo_bar FooBar fooBAR", "=" * 300, " " * 200 + "x", "ՠֈ Ა", "� ﻿x", "under the the the understanding",
]


@pytest.mark.parametrize("tier", [0, 7, 1 << 18])
def test_odd_texts_and_rare_pairs_by_join(spark, plain, tier):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "   "), (None, "a b"), (None, "a b"), (7, "the understanding of the text")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, row long, pair string, n long").repartition(3)
    assert ordered(alignment.align(docs, A, B, tier=tier).collect()) == ordered(expected(rows, plain))


def test_long_and_odd_rows(odd_docs, no_docs, plain):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert ordered(alignment.align(odd_docs, A, B).collect()) == ordered(expected(rows, plain))
    assert alignment.align(no_docs, A, B).count() == 0


def test_ids_rise_in_order_of_merges():
    """What lets model A merge by ranks."""
    merges = json.load(open(A, encoding="utf-8"))["model"]["merges"]
    vocab = Tokenizer.from_file(A).get_vocab(with_added_tokens=False)
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in merges]
    assert made == sorted(made) and len(set(made)) == len(made) == len(vocab) - 256


def test_windows_are_remembered_and_a_full_memory_changes_nothing(monkeypatch, plain):
    text = "the understanding of the text, the text of the understanding. " * 20
    known = alignment.Windows(alignment.ByteLevel(A), alignment.Pieces(B))
    once = alignment.aligned(text, known)
    assert 0 < len(known) < 20
    monkeypatch.setattr(alignment, "MEMO", 2)
    small = alignment.Windows(alignment.ByteLevel(A), alignment.Pieces(B))
    again = alignment.aligned(text, small)
    assert len(small) <= 2 and len(small.older) <= 2
    assert once[:4] == again[:4] and (once[4] == again[4]).all()
    assert once[:4] == (lambda x: (x[1], x[2], x[3], x[7]))(expected([(0, text)], plain)[0])


def test_known_windows_are_not_tokenised_again(monkeypatch):
    known = alignment.Windows(alignment.ByteLevel(A), alignment.Pieces(B))
    asked = []
    for m in known.models:
        monkeypatch.setattr(m, "ids", lambda text, f=m.ids: asked.append(len(text)) or f(text))
    text = "The understanding of the text, the text of the understanding.\n" * 200
    once = alignment.aligned(text, known)
    assert 0 < sum(asked) < len(text) / 10
    asked.clear()
    again = alignment.aligned("The text of the text, the understanding.\n" * 50, known)
    assert asked == [] and once[0] > again[0] > 0


def test_windows_apart_equal_whole_texts(plain, monkeypatch):
    """Texts of letters, signs, digits and all kinds of white space, in batches, with long ones cut in parts; some go whole."""
    rng = random.Random(11)
    parts = [*"abstlvxAQéßƀ  \t\n\r\xa0\x85\x0b\x1c\x1f\x00''.,;:!?*/(){}[]<>\"=_-1234567890²½ªµ€…—", " ", "\r\n", "  ", "'s", "'ll", " the", ";\r\n", "<s>", "<0x41>", "<|endoftext|>", "▁", "я"]
    texts = [None, ""] + ["".join(rng.choices(parts, [1] * (len(parts) - 2) + [0.02] * 2, k=rng.choice([1, 2, 3, 8, 40, 300]))) for _ in range(1500)]
    monkeypatch.setattr(alignment, "SLICE", 150)
    known = alignment.Windows(alignment.ByteLevel(A), alignment.Pieces(B))
    assert known.cut
    found = [alignment.all_aligned(texts[i : i + 40], known) for i in range(0, len(texts), 40)]
    got = [(x[0], x[1], x[2], len(x[4]), x[3]) if x else (0, 0, 0, 0, "") for batch in found for x in batch]
    assert got == [(x[1], x[2], x[3], x[4], x[7]) for x in expected(list(enumerate(texts)), plain)]
    assert sum(x[0] == 0 for x in got) < 600


def test_a_window_that_is_not_given_back_takes_only_its_own_texts(monkeypatch):
    """A model without a sign for `q`: texts with it have no tokens, others of the same batch have theirs."""
    texts = ["a b c", "a q b", "q", "d, e. f", "a d\n", "x y zq"]
    known = alignment.Windows(alignment.ByteLevel(A), alignment.Pieces(B))
    want = alignment.all_aligned(texts, known)
    lossy = alignment.Windows(alignment.ByteLevel(A), alignment.Pieces(B))
    b = lossy.models[1]
    monkeypatch.setattr(b, "ids", lambda text, f=b.ids: f(text.replace("q", "k")))
    got = alignment.all_aligned(texts, lossy)
    assert [x is None for x in got] == ["q" in x for x in texts]
    assert all(x is None or x[:4] == y[:4] for x, y in zip(got, want))
