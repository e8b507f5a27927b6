"""Periodic runs, clustering with pivots, and the byte-pair transducer."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from provenant.llm import periodic, pivots, queries, transducer

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string"


def brute_runs(w, periods=4, words=6):
    found, n = [], len(w)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(words, periods * q):
                x = w[i:i + length]
                if not any(x[:-d] == x[d:] for d in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=12), st.lists(st.integers(1, 3), min_size=1, max_size=6), st.integers(1, 9), st.lists(st.integers(1, 3), max_size=8))
def test_runs_match_brute_force(head, unit, times, tail):
    symbols = head + unit * times + unit[:len(unit) // 2] + tail
    for periods, words in ((4, 6), (2, 2), (3, 5)):
        got = sorted(periodic.runs_of(symbols, periods, words), key=lambda r: (r[0], r[2]))
        assert got == brute_runs(symbols, periods, words)
    # Cutting a text into the stretches that recur loses no run.
    words = [b"w%d" % x for x in symbols]
    rare = [w for i, x in enumerate(words) for w in ([x, b"rare%d" % i] if i % 17 == 16 else [x])]
    assert periodic.runs_of_words(rare) == brute_runs(rare)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=2, max_size=60))
def test_extensions_match_direct_comparison(symbols):
    ahead = periodic.Extensions(periodic.SuffixTree(symbols))
    n = len(symbols)
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
    got = ahead.of(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), length in zip(pairs, got.tolist()):
        x, y = symbols[a:], symbols[b:]
        assert length == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert ahead.order.tolist() == sorted(range(n + 1), key=lambda i: symbols[i:])


ODD_RUNS = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 6), (4, "a " * 6), (5, "a b " * 3 + "a"), (6, "x " + "a b c " * 5 + "d d d d d d d"),
            (None, "u v " * 9), (7, "aé b　c " * 4), (8, "one two three " * 3000), (9, "\x1c\x85 " * 8), (10, "a a a a a"),
            # Words behind white space that only Unicode knows are one word.
            (11, "p\xa0q r " * 4)]


def test_runs_of_documents(spark):
    docs = spark.createDataFrame(ODD_RUNS, SCHEMA).withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(1))
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.detect(docs).collect())
    want = []
    for doc, text in ODD_RUNS:
        words = (text or "").encode().split()
        runs = brute_runs(words) if len(words) < 1000 else [(0, 9000, 3)]
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((str(doc), len(words), runs, b" ".join(w for i, w in enumerate(words) if i not in dropped).decode()))
    assert got == sorted(want)
    assert periodic.detect(spark.createDataFrame([], SCHEMA)).count() == 0


def test_periodic_run_query(spark, tmp_path):
    random.seed(4)
    rows = [(i, " ".join(random.choices("abcdefgh", k=random.choice((0, 1, 5, 40, 200))))) for i in range(700)] + [(7, "a a a a a a a"), (12345, None)]
    spark.createDataFrame(rows, SCHEMA).withColumn("runs", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect())
    want, rewritten = [], 0
    for doc, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a, rewritten = g % n, rewritten + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        want.append((doc, len(runs), s, length, q, None if q is None else 1000 * length // q,
                     hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert rewritten > 20 and sum(w[1] for w in want) > 15
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(64 * x) < pivots.LARGEST for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:k]]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    total = {j: sum(d for d, c in found if c == j) for j in range(len(centroids))}
    return sorted((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, found))


def vectors(n, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 64))
    return [(i, (middles[i % 5] + spread * rng.normal(size=64)).round(4).tolist()) for i in range(n)]


@pytest.mark.parametrize("rows", [
    vectors(300), vectors(9), vectors(80, spread=0.0), [(i, [0.5] * 64) for i in range(40)], [(i, [float(i % 3)] + [0.0] * 63) for i in range(60)],
    [*vectors(40), (100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 63 + [None]), (104, [float("nan")] + [1.0] * 63), (105, [float("inf")] + [1.0] * 63),
     (106, [1e30] + [0.0] * 63), (107, [1e6, -1e6] * 32), (3, [0.25] * 64), (3, [0.25] * 64), (3, [-0.26] * 64)]])
def test_clusters_match_brute_force(spark, rows):
    given_rows = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("cluster", F.lit("clash")).withColumn("table", F.lit(1))
    found = pivots.cluster(given_rows)
    assert sorted(tuple(r) for r in pivots.report(found).collect()) == brute_clusters(rows)


def test_pivots_spare_distances(spark):
    rows = vectors(2000, spread=0.05)
    found = pivots.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    # A vector needs far fewer exact distances than there are centroids.
    assert len(found.worked) == 3 and all(2000 <= n < 2000 * 16 / 2 for n in found.worked)


def test_no_vectors(spark):
    empty = pivots.report(pivots.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def library(name):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=transducer.read_ranks(public_tokenizers.path(name)), special_tokens={})


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    return library(request.param), transducer.encoder(public_tokenizers.path(request.param), public_tokenizers.PATTERN)


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


ODD = [None, "", " ", " \n\n x", "a  b   c\n\n d\te <|endoftext|>", "don't we'll 12345 ünï　x\xa0y \x1c z​ q", "日本語 テキスト 123 🎉🎉 ", "a" * 3000, " \x85b \r\n\r\n",
       "word " * 4000, "==========------", "aaaaaaaaaaab" * 9, "x" * 70 + " " + "é" * 100]


def test_transducer_matches_the_library(both):
    lib, encoder = both
    for text in ODD[1:]:
        assert ids_of(encoder, text) == lib.encode_ordinary(text)
    # Every token of the vocabulary encodes to itself, and random byte strings as the library has them.
    random.seed(6)
    machine = encoder.transducer
    assert all(machine.encode(token) == [rank] for token, rank in machine.merges.ranks.items())
    for _ in range(3000):
        piece = bytes(random.choices(random.choice((b"ab", b"aeinorst", bytes(range(256)))), k=random.randint(1, 24)))
        assert machine.encode(piece) == lib._encode_single_piece(piece)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x0b\x1c\x85\xa0 　'sd1.!aé"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_is_encoded_as_the_library_does(text):
    encoder = transducer.encoder(RANKS, public_tokenizers.PATTERN)
    assert ids_of(encoder, text) == test_any_text_is_encoded_as_the_library_does.lib.encode_ordinary(text)


test_any_text_is_encoded_as_the_library_does.lib = library("byte_bpe_50k.tiktoken")


def test_full_tables_change_nothing():
    small = transducer.Encoder(RANKS, public_tokenizers.PATTERN)
    small.transducer.most_moves = 50
    small.spaced.half = small.pieces.half = 3
    lib = library("byte_bpe_50k.tiktoken")
    random.seed(8)
    for _ in range(200):
        text = " ".join("".join(random.choices("abcdeinorst", k=random.randint(1, 12))) for _ in range(12))
        assert ids_of(small, text) == lib.encode_ordinary(text)
    assert len(small.spaced) <= 3 and len(small.transducer.moves) <= 50 + 12


def test_ranks_without_bytes_are_refused():
    with pytest.raises(ValueError, match="single bytes"):
        transducer.Merges({b"a": 0})


def test_tokens_that_no_merges_make():
    # "abc" has no two parts that are tokens and adjacent: only the whole pre-token is it.
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"xy": 257}
    lib = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    machine = transducer.Transducer(ranks)
    for piece in (b"abc", b"abcd", b"xyxyx", b"aabc"):
        assert machine.encode(piece) == lib._encode_single_piece(piece)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 7))
def test_streamed_bytes_end_between_characters(data, size):
    stream = transducer.Utf8Stream([bytes([b]) for b in range(256)])
    blocks = [list(data[i:i + size]) for i in range(0, len(data), size)]
    fed = [stream.feed(b) for b in blocks]
    assert b"".join(fed) + stream.close() == data
    assert "".join(stream.text(blocks)) == data.decode("utf-8", "replace")
    if data.decode("utf-8", "ignore").encode() == data:
        assert all(x.decode("utf-8") is not None for x in fed)


def test_decoding_holds_back_unfinished_characters():
    stream = transducer.Utf8Stream([bytes([b]) for b in range(256)])
    assert stream.feed("é".encode()[:1]) == b"" and stream.feed("é".encode()[1:]) == "é".encode()
    assert stream.feed("🎉".encode()[:3]) == b"" and stream.close() == "🎉".encode()[:3]
    with pytest.raises(ValueError, match="no token"):
        stream.feed([256])


def test_round_trip_of_documents(spark):
    rows = list(enumerate(ODD)) + [(1, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    lib = library("byte_bpe_50k.tiktoken")
    encoded = transducer.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in transducer.decode(encoded, RANKS).collect())
    want = [(str(i), len(ids := lib.encode_ordinary(t or "")), np.array(ids, "<u4").tobytes(), (t or "").encode()) for i, t in rows]
    assert got == sorted(want)
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in transducer.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()) == got
    empty = transducer.encode(spark.createDataFrame([], SCHEMA), RANKS, public_tokenizers.PATTERN)
    assert transducer.decode(empty, RANKS).count() == 0
