"""Tokens, packing, languages, page text, and the quality model."""

import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provenant.llm import crf, harmonic, kneser_ney, tag_paths, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", "   ", " \n \n", "a  b   c\n\n d\te <|endoftext|> e<|endoftext|>", "don't  we'll 12345 ünï　x\xa0y \x1c z​ q", "日本語 テキスト 123 🎉🎉 ",
       "def f(x):\n    return x\n\n\n", "<|endoftext|>", "word " * 3000, "x" * 5000, " a\x85b", "\r\n\r\n a"]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_token_counts(spark, library):
    rows = list(enumerate(ODD)) + [(1, "again")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_tokens", F.lit("clash"))
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PATH, limit=1000).collect())
    want = []
    for i, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 1000))
    assert got == sorted(want)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x0b\x1c\x85\xa0 　'sd1.!aé"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_is_cut_where_the_library_cuts(text):
    ids = harmonic.ids_of(PATH)
    want = ids.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(next(ids.encode([text])), "<u4").tolist() == want
    assert token_counts.counter(PATH).count(text) == len(want)


def check_packing(pieces, ids_by_doc, capacity=2048):
    """Every id in one piece, pieces gapless in sequences; returns the share of padding."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids_by_doc)
    for doc, ids in ids_by_doc.items():
        at, array = 0, np.array([*ids, 1], "<u4")
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(array)
            assert p.ids_crc32 == zlib.crc32(array[at:at + p.length].tobytes())
            at += p.length
        assert at == len(array)
    padded = used = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        used += at
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded / max(1, used)


def test_packing(spark, library):
    random.seed(5)
    texts = [t for t in ODD] + [" ".join(random.choices(["the", "fox", "jumps", "tion", "qqq"], k=random.choice((3, 90, 700, 4000)))) for _ in range(200)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("start", F.lit("clash")).repartition(70)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    pieces = harmonic.pack(docs, PATH).collect()
    # 70 workers need two rounds for their open pieces.
    assert check_packing(pieces, ids) < 0.03
    assert harmonic.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9000))
def test_cuts_fit_their_class(n):
    cuts = list(harmonic.cuts(n))
    assert sum(length for length, _ in cuts) == n
    assert all(k * length <= harmonic.CAPACITY and harmonic.CAPACITY - k * length <= harmonic.SLACK * k + k for length, k in cuts)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    emission, transitions, starts = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    active = np.array([2, 2, 2, 1])
    p, expected = crf.posteriors(emission, active, transitions, starts, pairs=True)
    moves = np.zeros((3, 3))
    for j, n in ((0, 4), (1, 3)):
        total, sums, own = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            w = math.exp(starts[path[0]] + sum(emission[i, j, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                sums[i, y] += w
            for a, b in zip(path, path[1:]):
                own[a, b] += w
        assert np.allclose(p[:n, j], sums / total)
        moves += own / total
    assert np.allclose(expected, moves)


LANGUAGES = {"en": "the of and to in is that for with was this from are not".split(), "fr": "le la les des une dans pour que qui est avec pas".split(),
             "de": "der die das und ist nicht ein eine mit von für auf".split()}


def language_rows(n=240):
    random.seed(3)
    ends = {"en": ("tion", "ing"), "fr": ("eaux", "ment"), "de": ("ung", "keit")}
    out = []
    for i in range(n):
        lang = sorted(LANGUAGES)[i % 3]
        words = [random.choice(LANGUAGES[lang]) if random.random() < 0.5 else "".join(random.choices("aeiourst", k=4)) + random.choice(ends[lang]) for _ in range(40)]
        out.append((i, " ".join(words), lang))
    return out


def test_languages(spark):
    rows = language_rows()
    odd = [(900, None, "en"), (901, "", "fr"), (902, "12 34 !", "de"), (903, "x", None), (904, rows[1][1] + " " + rows[4][1] + " 77 " + " ".join(rows[0][1].split()[:6]), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = crf.fit(docs, crf.Settings(epochs=6))
    got = {r.doc_id: r for r in crf.predict(docs, model).collect()}
    unseen = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(unseen) > 40 and all(got[i].lang_pred == rows[i][2] for i in unseen)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0.0
    assert all(0.0 <= r.score <= 1.0 for r in got.values()) and got[904].lang_pred == rows[1][2] and got[904].score < 0.99
    held = docs.select("doc_id", crf.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


def test_languages_without_training(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert crf.fit(docs) is None
    assert crf.predict(docs, None).collect()[0].lang_pred == "und"


def test_languages_switch_within_a_text():
    rows = language_rows()
    model = crf.train([(lang, text) for _, text, lang in rows], crf.Settings(epochs=6))
    words = crf.Words(model)
    text = rows[0][1].split()[:15] + rows[1][1].split()[:15]
    ids = np.array([words.table[w] for w in text])
    grid, active = crf._padded([ids])
    p, _ = crf.posteriors(words.emissions()[grid], active, model.transitions, model.starts)
    labels = [model.languages[k] for k in p[:, 0].argmax(axis=1)]
    right = sum(a == b for a, b in zip(labels, [rows[0][2]] * 15 + [rows[1][2]] * 15))
    assert right >= 28


def test_page_text(spark):
    body = "<h1>A title</h1><p><b>First, with <i>words</i> &amp; more.<br><p>Second&nbsp;one,\n here.</p><ul><li>x<li>y &lt;3</ul>"
    shell = ("<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script><style>p{{}}</style></head><body><header><h1>Site</h1></header>"
             "<nav><ul><li><a>One</a></li></ul></nav><div class='ad banner'>Buy now, really, it is cheap.</div>{}<aside>More</aside>"
             "<section id=comments><p>I think, that this is a long comment. Yes, it is.</p></section><form>Mail <input></form><footer>&copy; x</footer>")
    want = "A title\nFirst, with words & more.\nSecond one, here.\nx\ny <3"
    pages = [(1, shell.format(f"<article>{body}</article>")), (2, shell.format(f"<div id=content>{body}</div>")), (3, None), (4, ""), (5, "<p>only <!-- no --> this"),
             (6, shell.format("<main>" + body + "<div class=comment>bad, bad.</div></main>")), (7, "<script>x</script>"), (8, "a < b")]
    docs = spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit("u")).withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars, r.url) for r in tag_paths.extract(docs).collect()}
    assert got[1][0] == got[2][0] == got[6][0] == want and got[1][1] == len(want)
    assert [got[i][0] for i in (3, 4, 5, 7, 8)] == ["", "", "only this", "", "a < b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "text, here", "<", ">", "&amp;", "<li>", "<a href='", "'>", "<!--", "-->", "<script>", "</script>", " "]), max_size=25))
def test_any_markup_is_read(parts):
    text = tag_paths.main_text("".join(parts))
    assert text == text.strip() and not re.search(r"\n\n|  ", text) and html.unescape(text) is not None


def test_paths_of_running_text_score_higher():
    leaves = tag_paths.leaves_of("<div><span>a</span><span>b</span><span>c</span></div><div><p>Some long text, with words. And more.</p><p>Other long text, it is.</p></div>")
    scores = tag_paths.scores(leaves)
    assert min(s for s, x in zip(scores, leaves) if x.element.tag == "p") > max(s for s, x in list(zip(scores, leaves))[:2])


def quality_rows():
    random.seed(11)
    words = ["the", "of", "and", "ration", "onthe", "ering", "thand", "in", "is", "rean", "blest", "ofer"]
    docs, labels = [], []
    for i in range(300):
        text = " ".join(random.choices(words, k=random.randint(20, 60)))
        docs.append((i, text.capitalize() + ".", ["en", "fr", None][i % 3]))
        labels.append((i, 1, 0))
    for i in range(300, 340):
        kind = i % 4
        text = docs[i - 300][1]
        bad = (text.upper() + "!!", " ".join(w + "$%&" for w in text.split()), " ".join(w + " | " + w for w in text.split()), " ".join([text.split()[1]] * 40))[kind]
        docs.append((i, bad, "en"))
        labels.append((i, 0, 0))
    return docs, labels


def test_quality_model(spark):
    rows, labels = quality_rows()
    odd = [(900, None, "en"), (901, " ", None), (5, rows[5][1], "xx")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("perplexity", F.lit("old")).withColumn("extra", F.lit(7))
    marks = spark.createDataFrame(labels + [(None, 1, 0), (99999, 1, None)], "doc_id long, quality int, toxic int")
    model = kneser_ney.fit(docs, marks)
    got = kneser_ney.score(docs, model).collect()
    good = [r for r in got if r.doc_id < 300]
    assert len(got) == len(rows) + 3 and sum(r.accepted for r in good) >= 298
    assert not any(r.accepted for r in got if r.doc_id >= 300) and {r.extra for r in got} == {7}
    assert next(r.perplexity for r in got if r.doc_id == 900) is None


def test_probabilities_sum_to_one(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = kneser_ney.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    size = len(model.unigram_p)
    tokens = np.arange(size)
    assert model.unigram_p.sum() == pytest.approx(1.0, abs=1e-9)
    words = sorted(model.words.values())
    for u, v in ((kneser_ney.BEGIN, kneser_ney.BEGIN), (words[0], words[1]), (words[2], words[0]), (size - 1, kneser_ney.REPEATED)):
        found = (np.int64(u) << 2 * kneser_ney.BITS) | (np.int64(v) << kneser_ney.BITS) | tokens
        assert np.exp(kneser_ney.log_probabilities(model, found)).sum() == pytest.approx(1.0, abs=1e-6)


def plain_perplexities(texts, words):
    """Modified Kneser-Ney over all n-grams of the texts, from dictionaries."""
    tokens = kneser_ney.Tokens(words)
    padded = [[kneser_ney.BEGIN] * 2 + tokens.ids(t).tolist() for t in texts]
    counts = [Counter(), Counter(), Counter(tuple(p[i - 2:i + 1]) for p in padded for i in range(2, len(p)))]
    for order in (1, 0):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    # Repetitions are unigrams only.
    counts[1:] = [Counter({g: c for g, c in of.items() if not kneser_ney.REPEATED <= g[-1] < kneser_ney.FIRST_SHAPE}) for of in counts[1:]]
    cuts, total, left = [], [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
    for order in range(3):
        of = Counter(counts[order].values())
        n = [max(1, of[i]) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        cuts.append([min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), i * 0.95) for i in (1, 2, 3)])
        for g, c in counts[order].items():
            total[order][g[:-1]] += c
            left[order][g[:-1]] += cuts[order][min(c, 3) - 1]

    def p(g):
        order, c = len(g) - 1, g[:-1]
        if not g:
            return 1 / (kneser_ney.FIRST_WORD + len(words))
        if c not in total[order]:
            return p(g[1:])
        own = counts[order][g] - cuts[order][min(counts[order][g], 3) - 1] if g in counts[order] else 0
        return (own + left[order][c] * p(g[1:])) / total[order][c]

    return [math.exp(-sum(math.log(p(tuple(x[i - 2:i + 1]))) for i in range(2, len(x))) / (len(x) - 2)) for x in padded]


def test_rare_trigrams_count_as_they_are(spark):
    # Each pair of documents has a phrase of its own, far below any share of all of them; copies of a text are judged alike.
    names = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "mnopqr"]
    texts = [f"common words of style come {names[i // 2 % 150]} then {names[i // 2 * 7 % 150]} and {names[i // 2 * 11 % 149]} again{' again' * (i % 9 // 7)}" for i in range(1600)]
    texts += [texts[7]] * 40 + ["word word word word word word then word word"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    settings = kneser_ney.Settings(model_share=1.1)
    model = kneser_ney.fit(docs, docs.selectExpr("doc_id", "1 as quality", "0 as toxic"), settings)
    assert model.counted == len(texts)
    more = ["again style of common words", "one #two THREE 4 ab ab ab ab ab ab ab"]
    got = {r.text: (r.n_tokens, r.perplexity) for r in kneser_ney.score(docs.select("text", "lang").union(spark.createDataFrame([(m, "en") for m in more], "text string, lang string")), model).collect()}
    seen = plain_perplexities(texts, model.words)
    for text, wanted in zip(texts, seen):
        assert got[text] == (len(text.split()), pytest.approx(wanted, rel=1e-6))
    assert got[more[0]][0] == 5 and got[more[0]][1] > max(seen) and got[more[1]][0] == 11


def test_no_trusted_text(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "", "en")], "doc_id long, text string, lang string")
    model = kneser_ney.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert model is None
    assert {r.doc_id: r.accepted for r in kneser_ney.score(docs, model).collect()} == {1: True, 2: False}


def test_quality_model_counts_all_trusted_text(spark):
    # Shapes repeat, so the n-grams of the many documents are few; one in ten is of a rare language with words of its own.
    docs = spark.range(13_000).selectExpr("id as doc_id", "if(id % 10 = 0, 'rare words of ours', concat('common words ', id % 7)) as text", "if(id % 10 = 0, 'xx', 'en') as lang")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    model = kneser_ney.fit(docs, labels)
    assert model.counted + model.held_out == 13_000 and 8_300 < model.counted < 9_000


def test_each_language_has_its_vocabulary(spark):
    hot = [(i, " ".join(f"hot{chr(97 + j)}" for j in range(12)), "en") for i in range(200)]
    rare = [(200 + i, "rarea rareb rarea rareb", "xx") for i in range(12)]
    docs = spark.createDataFrame(hot + rare, "doc_id long, text string, lang string")
    model = kneser_ney.fit(docs, docs.selectExpr("doc_id", "1 as quality", "0 as toxic"), kneser_ney.Settings(vocabulary=5))
    assert {"rarea", "rareb"} < set(model.words) and len(model.words) == 7


def test_all_parts_of_a_word_count():
    place = crf.Places(16)
    found = crf.features("abcdefghijklmnopqrstuvwxyz", {}, place)
    assert {place[n] for n in ("de", "ab", "cde", "xyz", "pab", "pabcd", "syz", "swxyz", "lmn")} <= set(found)
    # A text without spaces is one word; its end counts too.
    assert place["zz!"[:2]] in crf.features("あいう" * 50 + "zz", {}, place)


def test_languages_are_learned_from_whole_texts(spark):
    rows = [(i, "filler " * 800 + ("late " if i % 2 else "tard ") * 800, "en" if i % 2 else "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf.fit(docs, crf.Settings(epochs=1))
    assert {"late", "tard"} <= set(model.lexicon)


def test_layouts_around_the_page_are_read():
    body = "<p>" + "First, a long text with words. " * 8 + "</p><p>" + "Second, it is long as well. " * 8 + "</p>"
    side = "<div class=sidebar>More, here.</div>"
    want = tag_paths.main_text(f"<body><div>{body}</div></body>")
    assert want.count("First") == want.count("Second") == 8
    for shell in ("<div class='layout has-sidebar'>{}</div>", "<div id=page class=no-sidebar>{}</div>", "<div class=menu-open>{}</div>", "<form>{}</form>"):
        assert tag_paths.main_text("<body>" + shell.format(f"<div>{body}</div>{side}") + "</body>") == want
    # An article with short text beside long comments keeps to itself.
    assert tag_paths.main_text(f"<body><div>{body}</div><div id=comments>{body * 6}</div></body>") == want


def test_all_chosen_leaves_are_kept():
    a, b = "<p>" + "Some long text, with words. " * 30 + "</p>", "<p>" + "Other text, it is long. " * 30 + "</p>"
    text = tag_paths.main_text(f"<body><div id=a>{a * 10}</div><div id=b>{b}</div></body>")
    assert text.count("Some") == 300 and text.count("Other") == 30


RUNNING = "<p>" + "Some long text, with words. " * 6 + "</p>"
MENUS = f"<div id=top><ul><li><a>Alpha</a></li><li><a>Beta</a></li></ul></div>{RUNNING * 4}<div id=x><a>Gamma</a></div>"


def test_path_ratios_select_the_text(monkeypatch):
    text = tag_paths.main_text(MENUS)
    assert text.count("Some") == 24 and not re.search("Alpha|Beta|Gamma", text)
    monkeypatch.setattr(tag_paths, "scores", lambda leaves: [1.0] * len(leaves))
    assert re.search("Alpha\nBeta\n", tag_paths.main_text(MENUS))


def test_path_ratios_against_plain_sums():
    page = "<div><h2>A title</h2><p>One, two. <a>Three</a></p><p>Four; five!</p><ul><li><a>six</a><li>seven</ul></div>"
    blocks = [("h2", "A title", 0, 0), ("p", "One, two." + "Three", 2, 5), ("p", "Four; five!", 2, 0), ("li", "six", 0, 3), ("li", "seven", 0, 0)]
    total = lambda tag, at: sum(at(b) for b in blocks if b[0] == tag)
    raw = [0] + [math.log1p(total(t, lambda b: len(b[1])) / total(t, lambda b: 1) * (1 + total(t, lambda b: b[2]) / total(t, lambda b: 1))) for t, *_ in blocks] + [0]
    want = [max(raw[i], (raw[i - 1] + 2 * raw[i] + raw[i + 1]) / 4) * (1 - total(b[0], lambda x: x[3]) / total(b[0], lambda x: len(x[1]))) for i, b in enumerate(blocks, 1)]
    leaves = tag_paths.leaves_of(page)
    got = dict(zip((x.block for x in leaves), tag_paths.scores(leaves)))
    assert [round(s, 9) for s in got.values() if s] == [round(s, 9) for s in want]


def test_articles_titles_and_deep_pages():
    text = tag_paths.main_text(f"<body><article>{RUNNING}one</article><div><ul><li><a>menu</a></ul></div><article>{RUNNING}two</article></body>")
    assert text.count("Some") == 12 and "one" in text and text.endswith("two") and "menu" not in text
    assert tag_paths.main_text(f"<div class=post><header><h1>Title</h1></header>{RUNNING * 3}</div>").startswith("Title\n")
    assert "a x b" in tag_paths.main_text(f"{RUNNING}<p>a <math><mi>x</mi></math> b</p>")
    assert tag_paths.main_text(f"<article>{RUNNING * 3}<h2>See</h2><ul><li><a>linked item</a></ul><p>End.</p></article>").endswith("See\nlinked item\nEnd.")
    assert tag_paths.main_text("<div>" * 2000 + RUNNING * 3000).count("Some") == 18000


def test_pages_empty_repeated_and_long(spark):
    kind = "page_id long, url string, html string, text int, n_chars string"
    assert tag_paths.extract(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, "u", MENUS, 1, "x")] * 3 + [(None, None, f"<p>{'long, text. ' * 200_000}</p>", None, None)]
    got = tag_paths.extract(spark.createDataFrame(rows, kind)).collect()
    assert sorted(r.n_chars for r in got) == [671] * 3 + [2_399_999] and len({r.text for r in got}) == 2
