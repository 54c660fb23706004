import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import html, langid, packing, quality, tokens

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["a  b\n c \n\n d e　f <|endoftext|> x", "it's We'LL 123abc ½ ²", "́ á ΣΑΣ İx  ", "", "\n \n x", "don't  \t\tstop<|EndOfText|>", "𝔘𝔫𝔦 日本語テキスト १२३", "ÀÉÎ straße ªº µm naïve —dash… $$$&&& x_y [z] ñ\x85q\x1cw"]


def test_word_ids_and_piece_counts_equal_the_library(spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    w, b = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    ids, counts = tokens.WordIds(WORD), tokens.PieceCounts(BYTE)
    for t in texts:
        assert np.frombuffer(ids.ids(t), "<u4").tolist() == w.encode(t, add_special_tokens=False).ids
        assert counts.count(t) == len(b.encode(t, add_special_tokens=False).ids)


def test_caches_and_slices_change_nothing(monkeypatch, spark, sf_dir):
    text = " ".join(r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(10).collect())
    whole = tokens.WordIds(WORD).ids(text), tokens.PieceCounts(BYTE).count(text)
    monkeypatch.setattr(tokens, "SLICE", 500)
    monkeypatch.setattr(tokens, "CACHE", 50)
    assert (tokens.WordIds(WORD).ids(text), tokens.PieceCounts(BYTE).count(text)) == whole


def test_word_ids_keep_a_bounded_number_of_words_and_those_in_use(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 800)
    ids, encoded = tokens.WordIds(WORD), []
    merge = ids.merge
    monkeypatch.setattr(ids, "merge", lambda run: encoded.append(run) or merge(run))
    letters = "abcdefghij"
    for k in range(2_000):
        word = "".join(letters[int(d)] for d in str(k))
        assert ids.ids(f"often {word}, {word}.") == ids.encode(f"often {word}, {word}.")
        assert len(ids) + sum(len(x) for x in vars(ids).values() if isinstance(x, dict)) <= 200
    assert encoded.count("often") == 1


def test_token_counts_odd_rows(odd_docs, no_docs):
    b = Tokenizer.from_file(BYTE)
    want = sorted((r.doc_id or 0, len((r.text or "").encode()), len(b.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    got = tokens.token_counts(odd_docs, BYTE).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert tokens.token_counts(no_docs, BYTE).count() == 0


def least_bins(lengths, c):
    """The optimum by trying every way, for a few items."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k, r in enumerate(rooms):
            if r >= lengths[i]:
                rooms[k] -= lengths[i]
                place(i + 1, rooms)
                rooms[k] += lengths[i]
        rooms.append(c - lengths[i])
        place(i + 1, rooms)
        rooms.pop()

    place(0, [])
    return best


def test_lower_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 21, rng.integers(1, 8)))[::-1]
        bound = packing.lower_bound(np.bincount(lengths, minlength=21))
        bins, n = packing.best_fit_decreasing(lengths, 20)
        best = least_bins(lengths.tolist(), 20)
        assert bound <= best <= n and np.bincount(bins, lengths).max() <= 20


def test_packing_is_whole_gapless_and_near_its_bound(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 4)
    rows = packing.pack_documents(odd_docs, WORD, capacity=64).collect()
    w = Tokenizer.from_file(WORD)
    assert sum(r.length for r in rows) == sum(len(w.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    placed = spark.createDataFrame([(r.sequence_id, r.length) for r in rows], "sequence_id long, length long")
    used, bound = packing.certificate(placed, 64)
    assert bound <= used <= bound + 3
    assert all(0 < r.group_bound <= r.group_bins for r in rows)
    assert packing.pack_documents(no_docs, WORD).count() == 0


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_equal_the_library(spark, odd_docs, capacity):
    """Ids, crc32, start and length of each piece, cut from the library's ids."""
    import zlib
    from collections import Counter
    from math import ceil

    w, want = Tokenizer.from_file(WORD), []
    for r in odd_docs.collect():
        ids = np.array([*w.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(ceil(len(ids) / capacity)):
            part = ids[k * capacity : (k + 1) * capacity]
            want.append((r.doc_id, k, k * capacity, len(part), zlib.crc32(part.tobytes())))
    rows = packing.pack_documents(odd_docs, WORD, capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(want)
    with_ids = packing.pieces(odd_docs, WORD, capacity, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in with_ids)


@pytest.mark.parametrize("kind", ["wide", "thirds", "heavy"])
def test_groups_come_near_one_pass_and_are_certified(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "GROUP", 500)
    rng = np.random.default_rng(15)
    sizes = {"wide": rng.integers(1, 4097, 4000), "thirds": rng.normal(1700, 150, 4000), "heavy": np.exp(rng.normal(5, 1.5, 4000))}[kind]
    sizes = np.clip(sizes, 1, 4096).astype(np.int64)
    df = spark.createDataFrame(list(enumerate(sizes.tolist())), "uid long, length long")
    got = packing.packed(df).join(df, "uid").collect()
    assert len({r.uid for r in got}) == len(got) == len(sizes)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0] + [x for _, x in spans])[:-1].tolist() and sum(x for _, x in spans) <= 4096
    one_pass = packing.best_fit_decreasing(np.sort(sizes)[::-1], 4096)[1]
    bound = packing.lower_bound(np.bincount(sizes, minlength=4097))
    assert bound <= len(by) <= one_pass + 8


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site head</header><div id="cookie-notice">We use cookies</div><div class="post-content"><h1>My title</h1>
<p>Hello <b>wor</b>ld &amp; all of you reading this article today.</p><div class="ad">buy now</div><form><label>Mail</label><input name=q></form><p>Second para with words
 enough.<br>line two</p></div><div class="comments"><p>nice one mate</p></div><aside>side words</aside><footer>foot</footer><script>var x="</p>";</script></body></html>"""


WEIGHTS = html.Weights({"p": -0.01, "/p": -0.01, "div": -2.0, "/div": -2.0})


def test_main_text():
    assert html.main_text(PAGE, WEIGHTS) == "My title Hello world & all of you reading this article today. Second para with words enough. line two"
    for bad in (None, "", "<p>", "<a href='x", "<!-- open", "&amp;", "<<<>>>", "</div></p>", "<p hidden", "<div style='display:none'>"):
        assert isinstance(html.main_text(bad, WEIGHTS), str)


def prose(start, n=40):
    return " ".join(f"word{start + k}" for k in range(n))


LAYOUTS = {
    "comments in main": ("<body><main><h1>{a}</h1><p>{b}</p><div class='article-comments'><p>{x}</p></div></main></body>", "ab"),
    "comments as articles": ("<body><div class='post'><h1>{a}</h1><p>{b}</p></div><div id='comments'><ol class='comment-list'><li class='comment'><article class='comment-body'><p>{x}</p></article></li></ol></div></body>", "ab"),
    "topic names": ("<body><article><section class='social-science'><p>{a}</p></section><section id='login-history'><p>{b}</p></section></article></body>", "ab"),
    "one form": ("<body><form id='aspnetForm'><nav>{x}</nav><div id='content'><p>{a}</p><p>{b}</p></div><div class='footer'>{y}</div></form></body>", "ab"),
    "not shown": ("<body><article><p>{a}</p><p hidden>{x}</p><div style='display: none'><div>{y}</div></div><p>{b}</p></article></body>", "ab"),
    "table layout": ("<body><table><tr><td class='menu'>{x}</td><td><h1>{a}</h1><p>{b}</p></td><td class='right-sidebar'>{y}</td></tr></table></body>", "ab"),
    "furniture that is not closed": ("<body><div class='wrap'><ul class='nav'><li>{x}<li>{y}</ul><p>{a}<p>{b}<footer>{x}", "ab"),
    "sidebar that holds main": ("<body><div class='sidebar-right'><main><p>{a}</p><p>{b}</p></main><aside>{x}</aside></div></body>", "ab"),
    "sign up in the text": ("<body><article><p>{a}</p><div class='newsletter-signup'><form><label>{x}</label></form></div><p>{b}</p><div class='share-buttons'>{y}</div></article></body>", "ab"),
    "article header": ("<body><header>{x}</header><article><header><h1>{a}</h1></header><p>{b}</p></article></body>", "ab"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_main_text_of_layouts(name):
    layout, want = LAYOUTS[name]
    parts = {"a": prose(0), "b": prose(100), "x": prose(1000, 12), "y": prose(2000, 12)}
    assert html.main_text(layout.format(**parts), WEIGHTS) == " ".join(parts[k] for k in want)


def test_names_are_learned_from_labelled_pages(spark):
    """Names that mean nothing by themselves are furniture where marked pages have them outside; what is inside stays, also under a telling name."""
    rows = [(i, f"u{i}", f"<body><div class='zq wrap'><p>{prose(i * 50, 30)}</p></div><article class='t'><p>{prose(9000 + i * 50)}</p></article></body>") for i in range(30)]
    rows.append((99, "v", f"<body><div class='zq'><p>{prose(0, 90)}</p></div><div class='t'><p>{prose(5000, 60)}</p></div></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    weights = html.tag_weights(pages)
    assert weights.furniture == {"zq", "wrap"}
    got = {r.page_id: r.text for r in html.extracted(pages, weights).collect()}
    assert got[99] == prose(5000, 60) and all(got[i] == prose(9000 + i * 50) for i in range(30))


def test_extraction_keeps_articles(spark, sf_dir):
    import html as h
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html.extracted(pages, html.tag_weights(pages)).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>)", r.html, re.S)[1]
        want = " ".join(h.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_extraction_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (2, None, "", 1), (None, "u", "<p>word " * 50_000, 1)], "page_id long, url string, html string, text long")
    weights = html.tag_weights(pages)
    rows = html.extracted(pages, weights).collect()
    assert len(rows) == 4 and {r.text for r in rows if r.page_id} == {""}
    assert html.extracted(pages.where("false"), weights).count() == 0 and html.tag_weights(pages.where("false")).tags == {}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identified(docs, langid.trained(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_without_white_space_and_rare_language(spark):
    rng = np.random.default_rng(6)
    signs = {"ja": [chr(0x3041 + i) for i in range(80)], "zh": [chr(0x4E00 + i) for i in range(300)], "th": [chr(0x0E01 + i) for i in range(46)]}
    run = lambda lang, n: "".join(rng.choice(signs[lang], n))
    en = lambda: " ".join(rng.choice(["the", "house", "of", "and", "river", "green"], 30))
    rows = [(i, en(), "en") for i in range(400)] + [(400 + 40 * k + i, run(lang, 300), lang) for k, lang in enumerate(("ja", "zh")) for i in range(20)] + [(500 + i, run("th", 300), "th") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.trained(docs, max_rows=60)
    assert model.languages == ["en", "ja", "th", "zh"]
    assert [model.predict(run(x, 500))[0] for x in ("ja", "zh", "th")] == ["ja", "zh", "th"] and model.predict(en())[0] == "en"
    assert model.predict(run("ja", 250) + run("zh", 3000))[0] == "zh" and model.predict(run("zh", 250) + run("ja", 3000))[0] == "ja"
    assert all(len(t) <= langid.TOKEN for t in model._row)  # long tokens are not kept


def plain_scores(model, token):
    word, none = langid.core(token), np.zeros(len(model.languages))
    if not word or word in model.scores[0]:
        return model.scores[0].get(word, none)
    by = {size: [(i, g) for i, g in enumerate(langid.grams(word, size), 1 if size == 1 else 0) if g in model.scores[size]] for size in (4, 3, 2, 1)}
    if len(word) > langid.WORD:
        found = [model.scores[size][g] for i in range(len(word) + 2) for size, g in [next(((s, g) for s in by for j, g in by[s] if i == j), (0, ""))] if size]
    else:
        found = next(([model.scores[s][g] for _, g in by[s]] for s in by if by[s]), [])
    return np.mean(found, axis=0) if found else none


@pytest.mark.parametrize("together", [50, 64, 1 << 20])
def test_tokens_scored_together_equal_one_by_one(monkeypatch, together):
    monkeypatch.setattr(langid, "SLICE", together)
    rng = np.random.default_rng(8)
    word = lambda a, b: "".join(rng.choice(list("abcdeé"), rng.integers(a, b)))
    row = lambda: rng.normal(size=3)
    scores = {0: {word(2, 5): row() for _ in range(30)}} | {k: {g: row() for _ in range(40) for g in langid.grams(word(4, 9), k)} for k in (2, 3, 4)} | {1: {"a": row(), "b": row()}}
    model = langid.Model(["x", "y", "z"], scores)
    tokens = [word(1, 9) for _ in range(300)] + [word(41, 120) for _ in range(20)] + ["12", "(abc)", "zzz", "z" * 60, "a"]
    assert np.allclose(model.token_scores(tokens), [plain_scores(model, t) for t in tokens])


def test_language_equals_brute_force(spark, sf_dir):
    """The whole query: model by plain counting, texts by plain sums; ends of long words and equal scores included."""
    from collections import Counter

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.trained(docs)
    tally = {k: Counter() for k in langid.VOCABULARY}
    for r in docs.where(~langid.held_out()).where("lang IS NOT NULL AND text IS NOT NULL").collect():
        for w in filter(None, map(langid.core, r.text.split())):
            for k in tally:
                for g in langid.grams(w, k) if k else [w] * (len(w) <= langid.WORD):
                    tally[k][r.lang, g] += 1
    for k, size in langid.VOCABULARY.items():
        top = {g for x in model.languages for _, g in sorted((-n, g) for (lang, g), n in tally[k].items() if lang == x)[: size // len(model.languages)]}
        assert set(model.scores[k]) == top
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.identified(docs, model).collect():
        tokens = (texts[r.doc_id] or "").split()
        total = sum((plain_scores(model, t) for t in tokens), np.zeros(len(model.languages)))
        assert r.lang_pred == "und" or np.isclose(total.max(), total[model.languages.index(r.lang_pred)])
    same = langid.Model(["b", "c"], {0: {"one": np.zeros(2)}, 1: {}, 2: {}, 3: {}, 4: {}})
    assert same.predict("one")[0] == "b"


def test_shares():
    assert langid.share([], 10) == 1 and langid.share([3, 4], 10) == 4 and langid.share([1, 100, 100], 11) == 5 and langid.share([5] * 9, 4) == 1


def test_language_odd_rows(odd_docs, no_docs):
    model = langid.trained(odd_docs)
    rows = langid.identified(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (4, 5, 6))
    assert langid.identified(no_docs, model).count() == 0
    assert {r.lang_pred for r in langid.identified(odd_docs, langid.trained(no_docs)).collect()} == {"und"}


def test_language_backs_off_to_shorter_grams():
    one = lambda *v: np.log(np.array(v))
    model = langid.Model(["a", "b"], {0: {"haus": one(0.9, 0.1)}, 4: {"^auf": one(0.2, 0.8)}, 3: {"und": one(0.6, 0.4)}, 2: {"zz": one(0.5, 0.5)}, 1: {"x": one(0.1, 0.9)}})
    assert model.predict("Haus,")[0] == "a" and model.predict("auffahrt")[0] == "b" and model.predict("bund")[0] == "a" and model.predict("x")[0] == "b" and model.predict("12 !")[0] == "und"


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.trained(docs, labels)
    rows = quality.scored(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    kept = quality.good_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.scored(docs, model).where("predicted = 1").count()


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (7, 0), (None, 1), (99, 0), (7, 0)], "doc_id long, quality int")
    model = quality.trained(odd_docs, labels)
    rows = quality.scored(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.scored(no_docs, model).count() == 0
    none = quality.trained(odd_docs, labels.where("false"))
    assert {r.score for r in quality.scored(odd_docs, none).collect()} == {0.5}


def test_trees_walk_equals_plain_recursion():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = quality.fit(x, y, rounds=20, depth=3)
    b = m.binned(x)

    def walk(row, node, depth=0):
        if m.left[node] == node:
            return m.value[node]
        return walk(row, m.left[node] if row[m.feature[node]] <= m.cut[node] else m.right[node])

    raw = np.array([m.start + sum(walk(r, t) for t in m.roots) for r in b])
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-raw))) and ((m.score(x) > 0.5) == (y == 1)).mean() > 0.9


@pytest.mark.parametrize("text", ["", "   ", "a", "\n\n", "é" * 50, "word " * 10])
def test_statistics_are_finite(text):
    s = quality.statistics(text)
    assert len(s) == len(quality.NAMES) and np.isfinite(s).all()


def test_numbers_that_are_no_digits_are_no_letters():
    """½ and the like are neither letters of a text nor parts of a word, and a text of them has no language."""
    assert [langid.core(x) for x in ("1½", "²", "①a②", "Ⅷ", "x²y½", "_é_")] == ["", "", "a", "", "x²y", "é"]
    assert all(bool(langid._LETTER.match(chr(c))) == chr(c).isalpha() for c in range(0x3000))


def test_a_text_of_numbers_has_no_language_though_the_model_knows_them(spark):
    rows = [(k, ("½ ² eins zwei drei " if k % 2 else "one two three ") * 5, "de" if k % 2 else "en") for k in range(40)]
    rows += [(100, "1½ 2²", None), (101, "① Ⅷ", None), (102, "½ eins", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(docs, langid.trained(docs)).collect()}
    assert got[100] == got[101] == ("und", 0.0) and got[102][0] == "de"
