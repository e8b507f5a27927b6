"""Operators that are expressions only: mixing, fingerprints, quality rules, pseudonyms."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from provenant.llm import decision_list, fair_queue, one_permutation, pseudonyms, stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [(1, None), (2, ""), (3, " \n \n"), (4, "a b c d e a b c d e"), (5, "x x x x x x x"), (6, "a\n\na\nb\n a\n"), (7, "a b c d e a b c d e"),
         (None, "A b"), (8, "# $5 & <b> | % *"), (9, " ".join(f"w{i % 700}" for i in range(5000)))]
SCHEMA = "doc_id long, text string"


def windows(text, size=5):
    w = WORD.findall(text)
    return [tuple(w[i:i + size]) for i in range(len(w) - size + 1)]


def test_statistics(spark):
    got = {r.doc_id: r for r in stats.with_stats(spark.createDataFrame(TEXTS, SCHEMA)).collect()}
    for doc_id, text in TEXTS:
        text = text or ""
        words, found = WORD.findall(text), windows(text)
        counts, covered = Counter(found), set()
        for i, window in enumerate(found):
            if counts[window] > 1:
                covered.update(range(i, i + 5))
        lines = [line for line in text.split("\n") if WORD.search(line)]
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_stutters == sum(a == b for a, b in zip(words, words[1:]))


def brute_mix(rows, weights=(5, 2, 1), repeats=3):
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    budget, stopped = sum(total.values()), set()
    while True:
        rest, open_ = budget - sum(repeats * total[s] for s in stopped), [s for s in sources if s not in stopped]
        share = {s: weight[s] * (rest / sum(weight[x] for x in open_)) for s in open_}
        over = {s for s in open_ if share[s] > repeats * total[s]}
        if not over:
            break
        stopped |= over
    target = {s: float(repeats * total[s]) if s in stopped else share[s] for s in sources}
    queue = []
    for s in sources:
        done = 0
        order = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, _, x in rows if x == s)
        for copy in range(repeats):
            for draw, i in order:
                done += size[i]
                if size[i]:
                    queue.append((done / target[s], draw, i, copy))
    taken, used = Counter(), 0
    for _, _, i, _ in sorted(queue):
        if used + size[i] > budget:
            break
        used += size[i]
        taken[i] += size[i]
    return {i: (size[i], total[s], target[s], taken[i]) for i, _, s in rows}


def test_mix_matches_brute_force(spark):
    rows = [(i, " ".join("w" * (i % 7 * 3)), [None, "a", "b", "c", "d"][min(4, i % 9)]) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "e"), (1002, "w " * 40, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in fair_queue.mix(docs).collect()}
    want = brute_mix(rows)
    assert got == {i: (a, b, pytest.approx(c), d) for i, (a, b, c, d) in want.items()}
    assert all(taken <= 3 * size for size, _, _, taken in got.values())


def test_mix_of_nothing_and_of_repeated_rows(spark):
    assert fair_queue.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    rows = [(1, "a b", "s")] * 3 + [(2, None, None)]
    got = fair_queue.mix(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()
    assert sorted((r.doc_id, r["size"], r.taken) for r in got) == [(1, 2, 2), (1, 2, 2), (1, 2, 2), (2, 0, 0)]


def shingles(text):
    words = WORD.findall(text.lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints(spark):
    texts = TEXTS + [(20 + i, " ".join(f"{'ab' if (j * 7 + i) % 10 else 'cd'}{j}" for j in range(300))) for i in range(30)]
    docs = spark.createDataFrame(texts, SCHEMA).withColumn("values", F.lit("clash"))
    got = one_permutation.compare(docs).collect()
    rows = sorted(((i, t or "") for i, t in texts), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    by_id, errors = {r.doc_id: r for r in got}, []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        third = len(text) // 3
        edited = text[:len(text) - third] + following[:third]
        r = by_id[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            a, b = shingles(text), shingles(other)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.03
    assert by_id[4].fingerprint == by_id[7].fingerprint and by_id[1].fingerprint == "" and len(by_id[5].fingerprint) == 256


def test_blocks_of_neighbours(spark):
    rows = spark.createDataFrame([(i * 3 % 101, f"t{i * 3 % 101}") for i in range(101)] + [(50, "t50b"), (None, "none")], SCHEMA)
    for per_block in (1, 7, 1000):
        got = {(r.doc_id, r.text): r.next_text for r in one_permutation.beside_next(rows, ["text"], per_block).collect()}
        order = sorted(got, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
        assert [got[x] for x in order] == [x[1] for x in order[1:] + order[:1]]
    for few in ([], [(1, "x")], [(None, "x"), (None, "y")]):
        assert one_permutation.compare(spark.createDataFrame(few, SCHEMA)).count() == len(few)


def test_decision_list(spark):
    clean = "the quick brown fox jumps over one lazy dog and then it sleeps well number"
    docs = [(i, f"{clean} {i}") for i in range(200)] + [(1000 + i, " ".join(f"w{j}#$%" for j in range(20 + i % 5))) for i in range(60)]
    docs += [(2000 + i, " ".join(f"{w} {w}" for w in clean.split())) for i in range(60)] + [(3000, None), (3001, "")]
    labels = [(i, 0 if i >= 1000 else 1) for i, _ in docs] + [(9, None), (99999, 0)]
    judged, rules = decision_list.judge(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = {r.doc_id: r for r in judged.collect()}
    assert 1 <= len(rules) <= 4
    assert all(rows[i].kept for i in range(200)) and not any(r.kept for i, r in rows.items() if i >= 1000)
    assert rows[3000].base_failed and rows[1000].rule is not None
    judged, rules = decision_list.judge(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "doc_id long, quality int"))
    assert rules == [] and judged.filter(F.col("kept") == F.col("base_failed")).count() == 0


def _permuted(values, radices, key, kind):
    values = list(values)
    half = len(values) // 2
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for k in range(pseudonyms.ROUNDS):
        left = k % 2 == 0
        other = values[half:] if left else values[:half]
        g = sha("|".join([key, kind, ",".join(map(str, radices)), str(k), ",".join(map(str, other))]))
        for i in range(len(values)):
            if (i < half) == left and radices[i] > 1:
                values[i] = (values[i] + int(sha(f"{g}:{i}")[:12], 16)) % radices[i]
    return values


def test_pseudonyms_match_brute_force(spark):
    text = "at 10.2.33.254, or 4111111111111111 (not 4111111111111112) or 300.1.1.1; +1 (017) 555-7713"
    row = pseudonyms.pseudonymize(spark.createDataFrame([(1, text)], SCHEMA), "k").first()
    ip = ".".join(map(str, _permuted((10, 2, 33, 254), (256,) * 4, "k", "ip")))
    digits = _permuted(map(int, "411111111111111"), [10] * 15, "k", "card")
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    card = "".join(map(str, digits)) + str(-total % 10)
    phone = "+1 (017) 555-7713"
    radices = [1 if i < 2 or not c.isdigit() else 10 for i, c in enumerate(phone)]
    moved = _permuted([int(c) if r > 1 else 0 for c, r in zip(phone, radices)], radices, "k", "phone")
    number = "".join(str(v) if r > 1 else c for v, r, c in zip(moved, radices, phone))
    assert row.text == f"at {ip}, or {card} (not 4111111111111112) or 300.1.1.1; {number}" and row.n_replaced == 3


def test_pseudonyms_keep_formats_and_links(spark):
    valid = ["und.34@mail7.example.com", "123-45-6789", "1984-02-29", "31.12.1999", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819",
             "4111 1111 1111 1111", "202-555-0100", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
    plain = ["000-12-3456", "2023-02-30", "GB29NWBK60161331926818", "version 4.0.", "12345678", None, "", "call 5 of 7"]
    rows = [(i, f"x {v} y" if v else v) for i, v in enumerate(valid + plain)] + [(100 + i, f"see {v}, again {v}!") for i, v in enumerate(valid)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_e", F.lit("clash"))
    got = {r.doc_id: r for r in pseudonyms.pseudonymize(docs, "k").collect()}
    for i, v in enumerate(valid):
        text = got[i].text
        assert got[i].n_replaced == 1 and v not in text and got[i]["_e"] == "clash"
        assert re.sub(r"[0-9]", "9", re.sub(r"[a-f0-9]{40}", "h", text)) != "" and len(text) == len(f"x {v} y")
        assert got[100 + i].text == f"see {text[2:-2]}, again {text[2:-2]}!"
        # A pseudonym is valid in its turn.
    again = pseudonyms.pseudonymize(spark.createDataFrame([(i, got[i].text) for i in range(len(valid))], SCHEMA), "k")
    assert {r.n_replaced for r in again.collect()} == {1}
    assert all((got[len(valid) + i].text, got[len(valid) + i].n_replaced) == (f"x {v} y" if v else v, 0) for i, v in enumerate(plain))


def test_pseudonyms_are_a_permutation(spark):
    docs = spark.createDataFrame([(i, f"id {i:03d}-{i % 99 + 1:02d}-0001") for i in range(1, 600)], SCHEMA)
    texts = [r.text for r in pseudonyms.pseudonymize(docs, "k").collect()]
    assert len(set(texts)) == 599 and all(re.fullmatch(r"id \d{3}-\d{2}-\d{4}", t) for t in texts)


def test_addresses_of_one_shape_do_not_share_a_shift(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs, lone = [a + b for a in letters for b in letters], list(letters)
    rows = [(i, f"{v}@mail.example.com") for i, v in enumerate(pairs + lone)]
    got = {r.doc_id: r.text.split("@")[0] for r in pseudonyms.pseudonymize(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    for values, at in ((pairs, 0), (lone, len(pairs))):
        new = [got[at + i] for i in range(len(values))]
        assert len(set(new)) == len(values)
        assert len({tuple((ord(y) - ord(x)) % 26 for x, y in zip(a, b)) for a, b in zip(values, new)}) > 5


def test_letters_of_all_scripts_and_country_codes(spark):
    import unicodedata
    values = ["李雷@example.com", "李磊@example.com", "éé@example.com", "jose.é@example.com", "иван77@example.com", "ИВАН@example.com", "한글@example.com",
              "৭৮@example.com", "李@example.com", "+491701234567", "+491701234568", "+12025550123", "+35312345678", "+49 170 1234567"]
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id int, text string")
    got = {values[r.doc_id]: (r.text, r.n_replaced) for r in pseudonyms.pseudonymize(rows, "k").collect()}
    assert all(n == 1 and a != b for a, (b, n) in got.items()) and len({b for b, _ in got.values()}) == len(values)
    kind = lambda x: [(unicodedata.category(c), unicodedata.name(c).split()[0]) for c in x]
    for before, (after, _) in got.items():
        if "@" in before:
            assert kind(after) == kind(before) and after.endswith("@example.com"), (before, after)
    code = {"+491701234567": "+49", "+12025550123": "+1", "+35312345678": "+353", "+49 170 1234567": "+49 "}
    assert all(got[v][0].startswith(c) and len(got[v][0]) == len(v) for v, c in code.items())
    assert got["jose.é@example.com"][0].split("@")[0][-1] != "é"


def test_script_stretches_are_letters_or_digits_throughout():
    import unicodedata
    for a, b in pseudonyms.SCRIPTS:
        assert all(unicodedata.category(chr(x))[0] in "LN" for x in range(a, b + 1)), hex(a)
    assert all(b < c for (_, b), (c, _) in zip(sorted(pseudonyms.SCRIPTS), sorted(pseudonyms.SCRIPTS)[1:]))


def test_version_numbers_are_no_addresses(spark):
    rows = spark.createDataFrame([(1, "ver 10.2.33.254, Version: 1.2.3.4, v8.8.8.8"), (2, "server 10.2.33.254"), (3, "rev 1.2.3.4")], "doc_id int, text string")
    assert {r.doc_id: r.n_replaced for r in pseudonyms.pseudonymize(rows, "k").collect()} == {1: 0, 2: 1, 3: 1}
