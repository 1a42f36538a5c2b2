"""HTML, vocabulary pieces, perplexity: against other implementations and brute force, and at the edges."""

from __future__ import annotations

import hashlib
import random
from html.parser import HTMLParser

import numpy as np
import pytest

from setloom.llm import html_text, perplexity, pieces
from setloom.llm.common import table, with_row_id
from tests.llm.helpers import documents, edge_texts

SF = "/root/testdata/sf0.001"


class Article(HTMLParser):
    """The text of the article element, as the standard library reads it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.out.append("" if tag in ("b", "i", "a", "em", "span") else " ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.out.append("" if tag in ("b", "i", "a", "em", "span") else " ")

    def handle_data(self, data):
        self.out.append(data if self.inside else "")


def test_pages_equal_another_parser(spark):
    pages = table(spark, SF, "pages")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        a = Article()
        a.feed(r.html)
        a.close()
        assert got[r.page_id].text == " ".join("".join(a.out).split()) and got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []), ("", []), ("<p>a<p>b", ["a", "b"]), ("<article><!-- open <p>x", []), ('<script>if (a<b) "</p>"', []),
        ('<div class="ad">x y z</div><article><p>Hello <b>wor</b>ld &amp; &#x41; &copy</p><aside>no</aside><div class="comments"><p>reader words here</p></div><form>x</form></article><footer>f</footer>', ["Hello world & A ©"]),
        ('<article>x <p title="a>b">y</p></article>', ["x", "y"]), ("<article><p>A<br/>B</p><ul><li>one<li>two</ul></article>", ["A", "B", "one", "two"]),
        ("<article><p>x</p><div hidden>no</div><p>y <span class=ad>spam</span> z</p></article>", ["x", "y", "z"]), ("<article>\n a \n\t b&nbsp;c </article>", ["a b c"]),
        ("<body><nav><a href=1>Home</a></nav><p>" + "word " * 60 + "</p><p>" + "more " * 50 + "</p></body>", [("word " * 60).strip(), ("more " * 50).strip()]),
    ],
)
def test_blocks_of_pages(page, want):
    assert html_text.main_blocks(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>A drug.</p><section class="side-effects"><p>Nausea in one of ten.</p></section></article>', ["A drug.", "Nausea in one of ten."]),
        ('<article><p>Intro text here.</p><div class="related-work"><p>Others did it before us.</p></div></article>', ["Intro text here.", "Others did it before us."]),
        ('<article><p>News.</p><p class="share-price">The price rose.</p></article>', ["News.", "The price rose."]),
        ('<body><div id="content" class="has-sidebar menu-open"><h1>Title</h1><p>Some text.</p><p>More text.</p></div></body>', ["Title", "Some text.", "More text."]),
        ('<article><p>See below.</p><p><a href="/r">The whole report in one file</a></p><p>And more.</p></article>', ["See below.", "The whole report in one file", "And more."]),
        ("<body><p>One.</p><p>Two words.</p><p>Three little words.</p></body>", ["One.", "Two words.", "Three little words."]),
        ('<article><p>Text.</p><div class="share-buttons"><a>Mail</a></div><div class="relatedPosts"><p>Read this too</p></div><div id="comments"><p>I agree with all of it</p></div></article>', ["Text."]),
    ],
)
def test_names_are_weighed(page, want):
    assert html_text.main_blocks(page) == want


def test_tree_reads_its_labelled_pages_and_unseen_ones():
    x, y = html_text.labelled()
    assert len(y) > 150 and all(html_text.decide(html_text.tree(), tuple(r)) == bool(t) for r, t in zip(x, y, strict=True))
    right = n = 0
    for page in html_text.LABELLED:  # each page by a tree of the others
        own = html_text.blocks(html_text.written_out(page))
        rows = {tuple(map(float, q)) for k in html_text.LENGTHS for q in html_text.features(html_text.blocks(html_text.written_out(page, k)))}
        keep = [i for i, r in enumerate(x.tolist()) if tuple(r) not in rows]
        tree = html_text.grow(x[keep], y[keep])
        for b, r in zip(own, html_text.features(own), strict=True):
            if b.text[0] in "+-":
                right, n = right + (html_text.decide(tree, r) == (b.text[0] == "+")), n + 1
    assert right / n > 0.85
    # The word counts and link densities of a block and its neighbours decide too.
    def used(node):
        return {node[0]} | used(node[2]) | used(node[3]) if len(node) > 1 else set()

    assert used(html_text.tree()) & set(range(6, 12))


def test_unclosed_elements_take_linear_time():
    import time

    for piece in ("<svg>", "<div>", "<b class=x>", "<p>x</q>"):
        t = time.process_time()
        html_text.blocks(piece * 60_000)
        assert time.process_time() - t < 5, piece


def test_pages_at_the_edges(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, "v", "<article>" + "<p>w</p>" * 5000)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 9999)]
    assert html_text.extract(table(spark, SF, "pages").where("false")).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read())


def numbers(ids: bytes) -> list[int]:
    return np.frombuffer(ids, np.int32).tolist()


def test_lines_equal_the_library(vocabulary):
    import sentencepiece

    with open(pieces.MODEL, "rb") as f:
        library = sentencepiece.SentencePieceProcessor()
        library.LoadFromSerializedProto(pieces.as_unigram(f.read()))
    for t in edge_texts():
        if t and len(t) < 2000 and "\n" not in t and t.isascii() and t.isprintable():
            assert numbers(vocabulary.encode(t)) == library.encode(t)


def test_file_ids_are_those_of_the_library(vocabulary, spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(8)
    mixed = ["".join(rng.choice(["the", "ing", " ", "  ", "\n", "é", "x", "tion", "你", " of", "\t", "\u00a0", "Ｆ", "ﬁ", "0", ".", "\u0301", "\U0001f600"]) for _ in range(rng.randint(1, 120))) for _ in range(200)]
    docs = [r.text for r in table(spark, SF, "documents").select("text").collect()]
    for t in [*edge_texts(), *mixed, *docs]:
        if t:
            assert numbers(vocabulary.merge(t)) == library.encode(t), t[:80]


def test_words_equal_the_general_recurrence(vocabulary):
    rng = random.Random(4)
    for _ in range(400):
        u = "".join(rng.choice(["the", "ing", "é", "x", "tion", "你", "of", "▁", "\x01", "zz"]) for _ in range(rng.randint(1, 8)))
        score, back = vocabulary.best(u, {0: 0.0}, len(u))
        spans, j = [], len(u)
        while j:
            spans.append(u[back[j] : j])
            j = back[j]
        want = [i for s in reversed(spans) for i in ([vocabulary.vocab[s][0]] if s in vocabulary.vocab else [vocabulary.byte_ids[x] for x in s.encode()])]
        assert numbers(vocabulary.solve(u)[0]) == want and vocabulary.solve(u)[1] == score[-1]


def test_words_together_equal_words_alone(vocabulary):
    rng = random.Random(5)
    parts = ["the", "ing", "é", "x", "tion", "你", "of", "▁", "\x01", "zz", " ", "\n", "aab", "\U0001f600", "\ue000", ".", "%%"]
    words = ["".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 5, 9, 40]))) for _ in range(2000)]
    for some in (words, words[:1], ["\ue000"], ["x" * 64, "x" * 65, "a" * 500], [" "], ["", "ab", ""]):
        ids, ends = vocabulary.solve_all(some)
        assert [ids[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)] == [vocabulary.solve(u)[0] for u in some]
        ids, ends = vocabulary.merge_all(some)
        assert [ids[i:j].tolist() for i, j in zip(ends, ends[1:], strict=False)] == [vocabulary.library.encode(u) for u in some]


class Held:
    def __init__(self, p):
        self.p = p

    def get(self):
        return self.p


def test_new_words_are_solved_together(spark, monkeypatch):
    """Words that come once are the dear part: they may not be solved one by one."""
    docs = table(spark, SF, "documents").select("text").toArrow().combine_chunks()
    with open(pieces.MODEL, "rb") as f:
        p = pieces.Pieces(f.read())
    alone, solve = [], p.solve
    monkeypatch.setattr(p, "solve", lambda u: alone.append(u) or solve(u))
    got = [x for b in pieces._encode_rows(iter(docs.to_batches()), Held(p), [], True, True) for x in b.column("ids").to_pylist()]
    distinct = {u for t in docs.column("text").to_pylist() for u in p._UNITS.findall(" " + (t or ""))}
    assert len(distinct) > 10_000 and len(alone) < len(distinct) / 50
    monkeypatch.undo()
    assert got == [numbers(p.encode(t)) for t in docs.column("text").to_pylist()]


def test_tables_of_words_that_are_cut_give_the_same_ids(spark, vocabulary, monkeypatch):
    texts = [*edge_texts(), *(r.text for r in table(spark, SF, "documents").select("text").limit(60).collect()), None, "x" * 100, "x" * 100]
    monkeypatch.setattr(pieces, "WORDS", 40)
    monkeypatch.setattr(pieces, "SLICE_CHARS", 3000)
    monkeypatch.setattr(pieces, "SLICE", 3)
    p = pieces.Pieces(vocabulary.model)
    import pyarrow as pa

    found = list(pieces._encode_rows(iter([pa.record_batch({"text": pa.array(texts, pa.string())})] * 2), Held(p), ["text"], True, True))
    rows = [r for b in found for r in b.to_pylist()]
    assert [r["text"] for r in rows] == texts * 2 and max(b.num_rows for b in found) <= 3
    assert [(r["ids"], r["file_ids"]) for r in rows] == [(numbers(vocabulary.encode(t)), numbers(vocabulary.merge(t))) for t in texts] * 2
    assert all(r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in rows)
    p.encode_texts([" ".join(map(str, range(100, 200)))] * 2, True)
    assert len(p.words_merged.slots) >= 100
    p.encode_texts(["never"], True)
    assert len(p.words_merged.slots) == pieces.WORDS // 2 + 1
    assert all(x.num_rows == 0 for x in pieces._encode_rows(iter([pa.record_batch({"text": pa.array([], pa.string())})]), Held(p), [], True, True))
    assert [r["ids"] for b in pieces._encode_rows(iter([pa.record_batch({"text": pa.nulls(2)})]), Held(p), [], False, False) for r in b.to_pylist()] == [[], []]


def test_chunks_give_the_best_way_of_the_whole(vocabulary):
    rng, k = random.Random(3), vocabulary.longest
    for trial in range(120):
        n = rng.randint(1, 300)
        t = "".join(rng.choice(["the", "ing", " ", "  ", "\n", "é", "x", "▁", "tion", "你", " of"]) for _ in range(n)) if trial % 3 else "".join(rng.choice("abethinglor") for _ in range(3 * n))
        t = rng.choice(["x", "ab", "é", "aab"]) * n if trial % 10 == 0 else t  # many ties
        full, size = " " + t, rng.choice([2 * k, 40, 64])
        chunks = [(full[max(0, a - k + 1) : a], full[a : a + size]) for a in range(0, len(full), size)]
        mats = [vocabulary.matrix(x, y) for x, y in chunks]
        alphas = pieces.forward(mats)
        maps = [vocabulary.origins(x, y, z) for (x, y), z in zip(chunks, alphas, strict=False)]
        s, ids = pieces.borders(maps), b""
        assert s[0] == 0 == pieces.joined(maps)[0]
        for (x, y), enter, leave in zip(chunks, s, s[1:], strict=False):
            z = x[len(x) - enter :] + y
            ids += vocabulary.encode_part(z[: len(z) - leave])
        product = mats[0]
        for m in mats[1:]:
            product = pieces.times(product, m)
        best = vocabulary.score(numbers(vocabulary.encode(t)))
        assert product[0, 0] == best == vocabulary.score(numbers(ids)) and vocabulary.decode(ids) == t
        assert ids == vocabulary.encode(t)


def test_texts_come_back_whole(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "GROUP", 3)
    texts = edge_texts()
    docs = documents(spark, texts, [None, *range(1, len(texts) - 1), 1])
    whole = sorted((r.decoded_sha256, r.ids, r.file_ids) for r in pieces.tokenize(docs, file_ids=True).collect())
    assert whole == sorted((hashlib.sha256((t or "").encode()).hexdigest(), numbers(vocabulary.encode(t)), numbers(vocabulary.merge(t))) for t in texts)
    for giant in (65_536, 60):
        got = pieces.tokenize(docs, giant=giant, chunk=64, file_ids=True).collect()
        assert sorted((r.decoded_sha256, r.ids, r.file_ids) for r in got) == whole  # the same ids on either side of the switch
        assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in texts)
        assert sum(r.n_pieces for r in got) == sum(len(r.ids) for r in got)
        assert abs(sum(vocabulary.score(r.ids) for r in got) - sum(vocabulary.score(numbers(vocabulary.encode(t))) for t in texts)) < 1e-3
    kept = pieces.tokenize(docs, ("doc_id", "h", "_row", "fp"))
    assert {(r.h, r._row, r.fp) for r in kept.collect()} == {(-2, -1, "x")}
    assert pieces.tokenize(docs.where("false")).count() == 0
    back = pieces.decode(pieces.encode(docs, ["doc_id"], giant=60, chunk=64)).collect()
    assert sorted(r.decoded for r in back) == sorted(t or "" for t in texts)


def test_perplexity_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "PIECE", 50)
    texts = [t[:900] if t else t for t in edge_texts()]
    docs = with_row_id(documents(spark, texts))
    scored = perplexity.score(docs, docs.where("doc_id % 3 = 0"))
    got = {r.doc_id: r.log_perplexity for r in scored.join(docs.select("doc_id", "_sl_row"), "_sl_row").collect()}
    want = perplexity.brute_force([t or "" for t in texts], [t for i, t in enumerate(texts) if i % 3 == 0 and t])
    for i, x in enumerate(want):
        assert (got[i] is None) == (x is None) and (x is None or abs(got[i] - x) < 1e-9)


def test_batches_do_not_change_perplexities(spark, monkeypatch):
    """Arrow batches that are cut by bytes, at other rows in each scan."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    monkeypatch.setattr(perplexity, "BLOCK", 300_000)
    rows, conf = {}, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    for size in ("20000", "200000", "67108864"):
        spark.conf.set(conf, size)
        rows[size] = sorted((r.doc_id, round(r.perplexity or 0, 9), r.kept) for r in perplexity.classify(docs, labels).collect())
    spark.conf.set(conf, before)
    assert rows["20000"] == rows["200000"] == rows["67108864"]


def test_absent_ngrams_are_errors():
    import pyarrow as pa

    text = pa.table({"block": [0], "blob": [perplexity.zstandard.compress(b"abc")], "offsets": [[0, 3]], "rows": [[5]]})
    g = perplexity.distinct_grams(np.frombuffer(b"abc", np.uint8), np.array([0, 3]))
    full = pa.table({"block": [0] * len(g), "g": g, "lp": np.full(len(g), -1.0)})
    assert perplexity._answer(text, full)["lp"].to_pylist() == [-3.0]
    for bad in (full.slice(1), full.slice(0, 0)):
        with pytest.raises(ValueError):
            perplexity._answer(text, bad)


def test_perplexity_at_the_edges(spark):
    """Null languages, too few trusted documents of a language, clashing columns."""
    from pyspark.sql import functions as F

    docs = documents(spark, edge_texts()).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).withColumn("_sl_row", F.lit(1)).withColumn("limit", F.lit(2))
    docs = perplexity.stage(docs, "test-edges")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = perplexity.classify(docs, labels, min_trusted=3).collect()
    assert len(got) == docs.count() and {r.lang for r in got} == {"en", "und"}
    assert len({round(r.limit, 9) for r in perplexity.classify(docs, labels, min_trusted=10**6).collect()}) == 1
    assert not any(r.kept for r in got if not r.n_bytes)


def test_classifier_keeps_clean_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = perplexity.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.995 and (~got[got.quality == 0].kept).mean() > 0.6
    few = documents(spark, edge_texts())
    assert perplexity.classify(few, labels.where("false")).count() == few.count()
    assert perplexity.classify(few.where("false"), labels).count() == 0
