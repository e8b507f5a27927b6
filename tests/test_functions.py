from pyspark.sql import functions as F

from provenant.functions import hashing, language, policy, text
from provenant.functions.regex import unicode_pattern
from provenant.settings import Settings

import pytest


def test_settings_rules():
    for bad in ({"chunk_max_tokens": 100}, {"chunk_overlap_tokens": 512}, {"top_k": 41},
                {"vector_weight": 0.0, "lexical_weight": 0.0}, {"confidence_medium": 0.9}, {"confidence_keep": 0.7}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_hidden_markup_goes_and_text_stays(value):
    html = "<html><head><title>t</title></head><body><script>var a='</p>';</script><p>এক&nbsp;২</p><!-- x --><STYLE>p{}</STYLE><embed src=x>b</body></html>"
    assert value(text.html_text(F.lit(html))) == "এক ২\nb"


def test_entities_once(value):
    assert value(text.decode_entities(F.lit("a &amp;lt; &#2453;&#x995; &nosuch; & &copy;"))) == "a &lt; কক &nosuch; & ©"


def test_whitespace_keeps_unicode(value):
    messy = " a\t\t b \r\n\n\n\n c ়\n"
    assert value(text.clean_ws(F.lit(messy))) == "a b\n\nc ়"


def test_titles_in_order_of_preference(value):
    html = '<h1>second</h1><div class="x act_title"> First <b>one</b></div>'
    assert value(text.page_title(F.lit(html))) == "First one"
    assert value(text.page_title(F.lit("<h1> </h1><p class='lawTitle'>L</p>"))) == "L"
    assert value(text.page_title(F.lit("<p>x</p>"))) is None


@pytest.mark.parametrize("label,kind", [("Department", "part"), ("CHAP II", "chapter"), ("sub-section", "subsection"), ("clause a", "clause"), ("x", "section")])
def test_kinds(value, label, kind):
    assert value(text.provision_kind(F.lit(label))) == kind


@pytest.mark.parametrize("title,number", [("103A. Weekly", "103A"), ("12.5 x", "12.5"), ("১০৩. সাপ্তাহিক", "১০৩"), ("", "?"), ("No number in this long title", "No number in this lo"), ("103", "103")])
def test_numbers(value, title, number):
    assert value(text.provision_number(F.lit(title))) == number


def test_tokens_keep_vowel_signs(value):
    assert value(text.tokenize(F.lit("আমি কি—PARTS of it"))) == ["আমি", "কি", "parts", "of", "it"]


@pytest.mark.parametrize("words,code,confidence", [("আমার অধিকার", "bn", 1.0), ("what is it", "en", 1.0), ("", "en", 1.0), ("   ", "en", 1.0), ("কখ ab", "mixed", 0.5)])
def test_language(value, words, code, confidence):
    found = value(language.detect_language(F.lit(words)))
    assert (found["language"], round(found["confidence"], 6)) == (code, confidence)


def test_routing(value):
    assert value(F.struct(language.search_language(F.lit("mixed")), language.response_language(F.lit("mixed")), language.selected_language(F.lit(None), F.lit("bn")))) == ("en", "en", "bn")


@pytest.mark.parametrize("question,intent", [
    ("List all the sections of this", "section_list"), ("কোন কোন ধারা আছে", "section_list"), ("Summarize it", "act_summary"), ("এর সারসংক্ষেপ", "act_summary"),
    ("What is a contract?", "act_explain"), ("Should I sue?", "legal_advice"), ("আমার অধিকার", "legal_advice"), ("penalty for theft", "legal_qa")])
def test_intents(value, question, intent):
    assert value(policy.classify_intent(F.lit(question))) == intent


def test_decline_order(value):
    settings = Settings()
    reason = lambda q, s, i=None: value(policy.decline_reason(F.lit(q), F.lit(s), i, settings))
    assert reason("Should I?", 0.0).startswith("recall_floor: top score 0.000")
    assert reason("What should I do", 1.0) == r"advice_seeking_en: matched '\\bshould\\s+i\\b'"
    assert reason("পরামর্শ দিন", 1.0).startswith("advice_seeking_bn")
    assert reason("theft", 1.0) is None
    assert reason("Should I?", 1.0, F.lit("legal_advice")) is None


def test_bengali_word_end_follows_python(value):
    # A vowel sign is no word character, so \b after it needs a word character to follow.
    import re
    pattern = r"আমি\s+কি\s+(?:পারব|পারি)\b"
    for question in ("আমি কি পারি?", "আমি কি পারব?", "আমি কি পারিx"):
        assert value(F.lit(question).rlike(unicode_pattern(pattern))) == bool(re.search(pattern, question))


@pytest.mark.parametrize("answer,label", [("You MUST go", "you must"), ("you can't", "you cannot"), ("এটি  অবৈধ", "এটি অবৈধ"), ("fine", None)])
def test_guardrails(value, answer, label):
    assert value(policy.guardrail(F.lit(answer))) == label


@pytest.mark.parametrize("before,after", [
    ("Certainly! Based on the provided provisions, X", "X"), ("উত্তর: অবশ্যই! কাজ", "কাজ"), ("X is sure", "X is sure"), ("Surely not", "ly not"), ("  **Answer:** Y", "Y")])
def test_fillers(value, before, after):
    assert value(policy.strip_filler(F.lit(before))) == after


def _context(**changes):
    fields = {"act_name_en": "The Labour Act", "act_name_bn": "শ্রম আইন", "act_year": 2006, "section_ref": "103(1)", "source_url": ""} | changes
    return F.struct(*[F.lit(v).alias(k) for k, v in fields.items()])


@pytest.mark.parametrize("changes,lang,text_", [
    ({}, "en", "Section 103(1) of The Labour Act, 2006"), ({"act_name_en": "The Act, 2006"}, "en", "Section 103(1) of The Act, 2006"),
    ({}, "bn", "শ্রম আইন, ২০০৬-এর ধারা ১০৩(১)"), ({"act_name_bn": "আইন, ২০০৬"}, "bn", "আইন, ২০০৬-এর ধারা ১০৩(১)"),
    ({"source_url": "http://x"}, "en", "[Section 103(1) of The Labour Act, 2006](http://x)")])
def test_citations(value, changes, lang, text_):
    assert value(policy.format_citation(_context(**changes), F.lit(lang))) == text_


def test_placeholders(value):
    table = F.create_map(F.lit("a"), F.lit("[A]"), F.lit("b"), F.lit("[B]"))
    assert value(policy.resolve_placeholders(F.lit("x {{cite:a}} {cite:b}{cite:zz}."), table)) == "x [A] [B]."
    assert value(policy.resolve_placeholders(F.lit("none"), table)) == "none"


def test_disclaimers(value):
    assert value(policy.refresh_disclaimer(F.lit("a\n\nb\n\nold"), F.lit("new"))) == "a\n\nb\n\nnew"
    assert value(policy.refresh_disclaimer(F.lit("a\n\nnew"), F.lit("new"))) == "a\n\nnew"
    assert value(policy.refresh_disclaimer(F.lit("a"), F.lit("new"))) == "a\n\nnew"
    assert value(policy.split_disclaimer(F.lit("body \n\n**Disclaimer:** x"))) == ("body", "**Disclaimer:** x")
    assert value(policy.split_disclaimer(F.lit("body"))) == ("body", None)


def test_cost_equality_refuses(value):
    settings = Settings(cost_per_1k_input=1.0, cost_per_1k_output=0.0, cost_ceiling=2.0)
    assert value(policy.over_ceiling(F.lit(2000), settings)) and not value(policy.over_ceiling(F.lit(1999), settings))


def test_cache_key_ignores_order_and_spacing(value):
    key = lambda q, *ids: value(hashing.cache_key(F.lit(q), F.array(*map(F.lit, ids)), F.lit("2024-01-01").cast("date"), "m", "v", "r"))
    assert key("  What  IS ", "b", "a") == key("what is", "a", "b") != key("what is", "a")
    assert key("x", "a").startswith("response:") and len(key("x", "a")) == 73


def test_paths(value):
    assert value(policy.section_of(F.lit("A > Section 103A (see Section 9) > (2)"))) == "103"
    assert value(policy.section_of(F.lit("A > Chapter 1"))) is None
    assert value(policy.first_section(F.lit("A > Section 103A > Section 4"))) == "103A"
    assert value(policy.section_reference(F.lit("A > section 12 (x)"))) == "12 (x)"


def test_preview(value):
    assert value(policy.preview(F.lit("a  b\nc"))) == "a b c"
    cut = value(policy.preview(F.lit("word " * 100)))
    assert cut.endswith("word...") and len(cut) <= 300


def test_language_counts_a_text_once(spark):
    rows = spark.createDataFrame([("কখ a\n ",), ("ab c",), (" \n",), ("",), (None,), ("ক",)], "t string")
    found = rows.select(language.detect_language(F.col("t"))["language"].alias("l"), language.detect_language(F.col("t"))["confidence"].alias("c"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 4
    assert [(r.l, r.c if r.c is None else round(r.c, 4)) for r in found.collect()] == [("mixed", 0.6667), ("en", 1.0), ("en", 1.0), ("en", 1.0), ("en", 1.0), ("bn", 1.0)]


def test_similar_texts_are_compared_by_their_edits(monkeypatch):
    """A few edits in a long text take waves of edits, not a pass over all letters; both ways agree with the plain table."""
    import random

    from provenant.functions import distance

    def plain(a, b):
        above = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
            above = row
        return above[-1]

    draw = random.Random(3)
    for round_ in range(400):
        letters = "ab\0\1" if round_ % 2 else "abcdefgh "
        a = "".join(draw.choice(letters) for _ in range(draw.randrange(60)))
        b = "".join(draw.choice(letters) if draw.random() < 0.1 else x for x in a if draw.random() > 0.05)
        assert distance.distance(a, b) == plain(a, b)
        a, b = sorted((a + "x", b + "y"), key=len, reverse=True)
        found = plain(a, b)
        assert distance._waves(a, b, 4) == (found if found <= 4 else None)

    def passes(*_):
        raise AssertionError("all letters are passed")

    monkeypatch.setattr(distance, "_within", passes)
    text = "".join(draw.choice("abcdefgh ") for _ in range(20_000))
    changed = text[:50] + "X" + text[50:7000] + text[7001:15_000] + "Y" + text[15_001:] + "Z"
    assert distance.distance(text, changed) == 4
