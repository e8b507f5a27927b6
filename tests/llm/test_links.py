"""Similarity join, components, and the pipeline's stages."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provenant.llm import signature_tree
from provenant.llm.components import components

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets, up = [(i, shingles(t)) for i, t in rows], {}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus():
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = random.choices(vocabulary, k=60)
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n * 7 % 1009, " ".join(words)))
        n += 1

    for _ in range(60):  # unrelated, a third of them with the passage
        words = random.choices(vocabulary, k=random.randint(1, 120))
        add(words + passage if n % 3 == 0 else words)
    for edits in (0, 1, 2, 5, 9):  # groups of copies with more and more changes
        base = random.choices(vocabulary, k=150)
        for _ in range(12):
            words = list(base)
            for _ in range(edits):
                words[random.randrange(150)] = f"e{random.random()}"
            add(words)
    for k in range(40):  # a chain: neighbours are similar, its ends are not
        add([f"c{i}" for i in range(k * 3, k * 3 + 100)])
    for _ in range(3):
        add(passage)
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "A b c"), (2004, "a B C"), (2005, "a b c d"), (2006, "a b c d e f"), (2007, "a b c d e f")]
    return rows


def test_join_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("class", F.lit("clash")).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_tree.link(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block, cell", [(3, 500), (2048, 300)])
def test_blocks_of_lists_and_bundles(spark, monkeypatch, block, cell):
    monkeypatch.setattr(signature_tree, "BLOCK", block)
    monkeypatch.setattr(signature_tree, "CELL", cell)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_tree.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_join_of_few(spark):
    assert signature_tree.link(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "x y"), (5, "x y"), (3, "X Y"), (None, "x y"), (None, None), (9, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in signature_tree.link(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("3", 1, "3"), ("5", 1, "3"), ("5", 1, "3"), ("9", 0, "9"), ("None", 0, "None"), ("None", 1, "3")]


def test_links_through_rows_without_id_and_of_one_id(spark):
    random.seed(8)
    a = [f"w{i}" for i in range(100)]
    b, c = a[10:] + [f"x{i}" for i in range(10)], a[20:] + [f"x{i}" for i in range(20)]
    rows = [(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c))] + [(7, " ".join(random.choices(a, k=30))) for _ in range(1000)] + [(7, " ".join(c) + " y")]
    got = [(r.doc_id, r.component_id) for r in signature_tree.link(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()]
    assert [g for g in got if g[0] != 7] in [list(p) for p in itertools.permutations([(1, 1), (None, 1), (2, 1)])]
    assert sorted(g[1] for g in got if g[0] == 7) == [1] + [7] * 1000


def test_sets_of_all_widths_of_bitmaps():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    sets = [np.unique(base[at:at + n]) for n in (20, 60, 250, 300, 1000, 1100, 4000, 4800, 8000) for at in (0, n // 40, n // 12, n // 8, n // 2)]
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    sets, n = [sets[i] for i in order], n[order]
    want = signature_tree.Groups(np.arange(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                want.join(i, j)
    roots = np.arange(len(sets))
    exact, loose = signature_tree.Groups(roots), signature_tree.Groups(roots)
    for i, j in signature_tree.search(n, signature_tree.shared_bits(sets), roots, True):
        exact.join(i, j)
    for i, j in signature_tree._by_width(n, [signature_tree.signature(s) for s in sets], roots, None):
        loose.join(i, j)
    groups = list(map(want.find, range(len(sets))))
    assert list(map(exact.find, range(len(sets)))) == groups and len(set(groups)) < len(sets)
    assert all(loose.find(i) == loose.find(g) for i, g in enumerate(groups))


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (9, 9), (500, 400), (400, 300), (300, 500)] + [(1000, 1001 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 300: 300, 400: 300, 500: 300, 1000: 1000, **{1001 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    random.seed(4)
    words = ["the", "of", "and", "ration", "onthe", "ering", "thand", "in", "is", "rean", "blest", "ofer"]
    docs = [(i, " ".join(random.choices(words, k=60)).capitalize() + ".", "en", f"s{i % 4}") for i in range(150)]
    docs += [(200 + i, docs[i][1] + " tail", "en", "s9") for i in range(10)]
    docs += [(300 + i, " ".join(f"{w}$%&" for w in docs[i][1].split()), "en", "s1") for i in range(20)]
    docs += [(400, docs[20][1] + " call 202-555-0100 now", "fr", None), (401, None, "en", "s1"), (402, "", None, "s1")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(150)] + [(300 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    good = stages["quality classifier"](spark, docs, folder)
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns and len(kept & set(range(150))) >= 148 and not kept & set(range(300, 320)) and not kept & {401, 402}

    single = stages["n-gram Jaccard join"](spark, docs, folder)
    groups = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, root) in groups.items() if i == root)

    clean = stages["PII"](spark, docs, folder)
    rows = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and len(rows) == docs.count() and "202-555-0100" not in rows[400].text and rows[400].n_chars == len(rows[400].text)
    assert all(rows[r.doc_id] == r for r in docs.collect() if r.doc_id != 400)

    mixed = stages["mixing sources to target weights"](spark, docs, folder)
    texts = {r.doc_id: r.text for r in docs.collect()}
    taken = mixed.collect()
    assert mixed.columns == columns and all(texts[r.doc_id] == r.text for r in taken)
    total = sum(len(t.split()) for t in texts.values() if t)
    assert 0.95 * total <= sum(len(r.text.split()) for r in taken) <= total
    twice = docs.union(docs)
    assert {r.doc_id for r in stages["mixing sources to target weights"](spark, twice, folder).collect()} <= set(texts)


def test_pipeline(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    ids = {p.doc_id for p in pieces}
    assert not ids & {401, 402, *range(300, 320)} and len(ids) > 50


def test_rows_of_one_id_are_not_duplicates(spark):
    random.seed(6)
    texts = [" ".join(f"w{random.randint(0, 10**6)}" for _ in range(40)) for _ in range(8)]
    rows = [(1, texts[0]), (2, texts[1]), (2, texts[0] + " more"), (None, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[1]),
            (3, texts[4]), (3, texts[4]), (3, texts[5]), (3, None), (None, " \n"), (4, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n_chars int").repartition(5)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in kept.collect())
    assert got == sorted([(1, texts[0]), (2, texts[1]), (-1, texts[2]), (-1, texts[3]), (3, texts[4]), (3, texts[5]), (3, ""), (-1, " \n"), (4, "")])
