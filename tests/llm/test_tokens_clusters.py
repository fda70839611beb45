"""Byte-level BPE, alignment and clustering against the libraries, brute force and SQL."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dimframe.llm import alignment, byte_bpe, chunks, clusters

from .conftest import CLASHES, TABLES
from .test_documents import key, table_rows

PARTS = ["a", "b", "e", " ", "  ", "\n", "'", "s", "re", "'ll", "ñ", "中", "文", "1", "9", ".", "!!", "՘", "\U0003fff0", "т", "\t", "é", "́", "the", "ing", "<|endoftext|>", "<s>", "\x00", "▁", "　", "\xa0", "ﬁ"]


def scraps(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.ranks_of(byte_bpe.default_ranks()).rank
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: np.array(enc.encode_ordinary(t), "<u4").tobytes()


def test_byte_bpe(spark, odd_docs, no_docs, odd_rows, library):
    more = table_rows() + list(enumerate(scraps(400, 2), 10_000)) + [(2**60 + 1, "far"), (None, "x")]
    for df, rows in ((odd_docs, odd_rows), (spark.createDataFrame(more, "doc_id long, text string"), more)):
        got = sorted((tuple(r) for r in byte_bpe.byte_bpe(df).collect()), key=key)
        want = [(i, len(library(t or "")) // 4, hashlib.sha256(library(t or "")).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
        assert got == sorted(want, key=key)
    assert byte_bpe.byte_bpe(no_docs).count() == 0


@pytest.mark.parametrize("piece", ["x" * 5000, "ab" * 3000, "的中文" * 1000, " " * 3000, "aaaa" * 999 + "b", "'" * 999 + "r"])
def test_byte_bpe_of_long_pieces(piece, library):
    assert byte_bpe.TextEncoder(byte_bpe.default_ranks()).ids(piece) == library(piece)


def test_small_caches_change_nothing(library):
    encoder = byte_bpe.TextEncoder(byte_bpe.default_ranks(), remembered=5)
    assert all(encoder.ids(t) == library(t) for t in scraps(500, 3) + [t or "" for _, t in table_rows()[:20]])


def test_short_pieces_ask_for_few_entries(library):
    """Not every beginning of a word is encoded, nor a long piece again for each time it stands in a text; what is remembered serves the next task."""
    whole, asked = (byte_bpe.Ranks(byte_bpe.ranks_of(byte_bpe.default_ranks()).rank) for _ in range(2))
    rng = random.Random(9)
    made = [("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(5, 14)))).encode() for _ in range(500)]
    for p in made:
        assert asked.ids(p) == whole.read(whole.extended([-1], p), p)
    assert len(asked.follows) < 0.8 * len(whole.follows)
    encoder, calls = byte_bpe.TextEncoder(byte_bpe.default_ranks()), []
    make = encoder.pieces.make
    encoder.pieces.make = lambda p: calls.append(p) or make(p)
    text = " ".join(["né" * 50 + "-"] * 30)
    assert encoder.ids(text) == library(text) and len(calls) == 3
    assert byte_bpe.encoder_of(byte_bpe.default_ranks()) is byte_bpe.encoder_of(byte_bpe.default_ranks())


@pytest.mark.parametrize("size", [*range(60, 69), 130])
def test_pieces_about_as_long_as_short_ones(size, library):
    rng = random.Random(size)
    for letters in ("ab", "etaoinshr", "ñé中"):
        for _ in range(20):
            text = "".join(rng.choice(letters) for _ in range(size))
            assert byte_bpe.TextEncoder(byte_bpe.default_ranks()).ids(text) == library(text)


def test_words_with_a_mark(library):
    encoder = byte_bpe.TextEncoder(byte_bpe.default_ranks())
    texts = [f"{a}{w}{m}{b}" for a in ("", " ", "x ") for w in ("the", "don't", "a1", "é", "", "we") for m in ("", *",.;:!?'\"", "..", "'s") for b in ("", " ", " y", "\n")]
    assert all(encoder.ids(t) == library(t) for t in texts)


def test_tokens_that_no_merge_gives():
    """A token whose bytes encode to others ends nothing but a piece that it is."""
    ranks = byte_bpe.Ranks({bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257, b"bc": 258, b"abc": 259})
    assert ranks.ids(b"xyz") == [257] and ranks.ids(b"axyz") == [97, 120, 121, 122] and ranks.ids(b"abc") == [259] and ranks.ids(b"abcab") == [259, 256]


def test_edits_keep_the_table():
    rng, ranks = random.Random(5), byte_bpe.ranks_of(byte_bpe.default_ranks())
    draw = lambda n: bytes(rng.choice(b"abeing \xc3\xb1") for _ in range(rng.randrange(n)))
    for _ in range(300):
        p, new = draw(300), draw(5)
        a = rng.randrange(len(p) + 1)
        b = rng.randrange(a, len(p) + 1)
        piece = byte_bpe.Piece(ranks, p)
        piece.replace(a, b, new)
        piece.append(b"zz")
        whole = p[:a] + new + p[b:] + b"zz"
        assert piece.bytes == whole and piece.last == ranks.extended([-1], whole) and piece.ids() == ranks.ids(whole)
    long = byte_bpe.Piece(ranks, b"information" * 2000)
    assert long.replace(9000, 9001, b"q") < 200 and long.last == ranks.extended([-1], long.bytes)


def test_appended(spark, library):
    rng, texts = random.Random(6), scraps(60, 7)
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (99, None)]
    state = byte_bpe.encoded_state(spark.createDataFrame(rows, "doc_id long, text string"))
    whole = dict(rows) | {None: "no id", 99: ""}
    for r in range(3):
        more = [(k, "".join(rng.choice(PARTS) for _ in range(rng.randrange(4)))) for k in range(r, 60, 2)] + [(None, "!"), (1000, "?"), (99, None)]
        state = byte_bpe.appended(state, spark.createDataFrame(more, "doc_id long, text string"))
        whole |= {k: whole[k] + m for k, m in more if k in whole and k is not None and m}
    got = {r["doc_id"]: bytes(r["ids"]) for r in state.collect()}
    assert got == {k: library(t or "") for k, t in whole.items()}


def brute_alignment(rows):
    tokens = alignment.tokens_of(chunks.default_vocab(), alignment.default_pieces())
    found, count = [], Counter()
    for i, t in rows:
        want = (" " + (t or "")).encode()
        a = tokens.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = tokens.b.encode(t) if t else []
        if b"".join(tokens.bytes_a[x] for x in a) != want or b"".join(tokens.bytes_b[x] for x in b) != want:
            a, b = [], []
        end_a, end_b = (np.cumsum([len(known[x]) for x in ids]).tolist() for ids, known in ((a, tokens.bytes_a), (b, tokens.bytes_b)))
        links, groups, overlaps = [], [], 0
        for c in sorted(set(end_a) & set(end_b)):
            k, m = end_a.index(c), end_b.index(c)
            links.append((a[k], b[m]))
            before = sum(len(g) for g, _ in groups), sum(len(g) for _, g in groups)
            groups.append((a[before[0] : k + 1], b[before[1] : m + 1]))
        for k, e in enumerate(end_a):
            s = end_a[k - 1] if k else 0
            overlaps += sum((end_b[m - 1] if m else 0) < e and s < f for m, f in enumerate(end_b))
        count.update(links)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((i, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else "", overlaps))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(((i, n_a, n_b, n, len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), h, o) for i, n_a, n_b, n, ls, h, o in found), key=key)


@pytest.mark.parametrize("size", [200, 4_000_000])
def test_aligned(spark, odd_docs, no_docs, odd_rows, monkeypatch, size):
    monkeypatch.setattr(alignment, "SLICE", size)
    short = [(i, t if t is None else t[:3000]) for i, t in odd_rows]
    df = odd_docs.withColumn("text", F.substring("text", 1, 3000))
    assert sorted((tuple(r) for r in alignment.aligned(df).collect()), key=key) == brute_alignment(short)
    assert alignment.aligned(no_docs).count() == 0
    rows = [(i, t if t is None else t[:2000]) for i, t in table_rows()] + list(enumerate(scraps(200, 9), 10_000)) + [(7, "word x▁ more"), (8, " "), (9, "a "), (10, "\n a")]
    assert sorted((tuple(r) for r in alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=key) == brute_alignment(rows)


def test_slices_of_an_aligner():
    """Small caches and parts that are whole texts give what fresh ones give."""
    texts = scraps(300, 11) + ["one two three", "one x▁ two", "one two three"]
    whole, small = (alignment.Aligner(chunks.default_vocab(), alignment.default_pieces(), n) for n in (10**6, 3))
    rows, pairs, total = whole.slice(texts)
    assert int(total.sum()) == sum(r[4] for r in rows)
    for a in range(0, len(texts), 50):
        some, _, _ = small.slice(texts[a : a + 50])
        assert [r[:6] for r in some] == [r[:6] for r in rows[a : a + 50]]


def brute_lloyd(rows, k=8, dims=64, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    if not centroids:
        return []

    def give():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        to = [n for _, n in give()]
        for n in range(len(centroids)):
            own = [v for (_, v), t in zip(kept, to, strict=True) if t == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = give()
    inertia = Counter()
    for d, n in last:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, last, strict=True)), key=key)


def vectors(n, seed, near=3):
    """Few distinct places, so that ties, empty clusters and repeated rows occur."""
    rng = np.random.default_rng(seed)
    places = rng.normal(size=(near, 64)).round(1)
    return [(int(i), (places[rng.integers(near)] + (rng.random() < 0.5) * rng.normal(size=64) / 5).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("near", [2, 9])
def test_clusters(spark, near):
    rows = vectors(90, 1, near) + [(3, vectors(90, 1, near)[3][1])] * 2 + [(4, [0.5] * 64), (None, [0.25] * 64), (91, None), (92, [1.0] * 63), (93, [float("nan")] + [0.0] * 63), (94, [None] + [0.0] * 63), (95, [float("inf")] * 64), (96, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(7) for c in [*CLASHES, "cluster", "distance", "x", "ids", "owners", "moved"]})
    got = sorted((tuple(r) for r in clusters.delta_lloyd(df.repartition(5)).collect()), key=key)
    assert got == brute_lloyd(rows)


def test_few_or_no_vectors(spark):
    rows = vectors(3, 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in clusters.delta_lloyd(df).collect()), key=key) == brute_lloyd(rows)
    assert clusters.delta_lloyd(df.where("false")).count() == 0
    with pytest.raises(Exception, match="beyond"):
        clusters.delta_lloyd(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).count()


def test_rounds_look_only_at_what_moved():
    rng = np.random.default_rng(3)
    x, centroids = rng.integers(-99, 99, (50, 4)), rng.integers(-99, 99, (5, 4))
    every = np.ones(5, bool)
    owners, distances = clusters.assigned(x, np.full(50, -1), np.zeros(50, np.int64), centroids, every)
    centroids[2] += 40
    moved = np.arange(5) == 2
    assert all(np.array_equal(p, q) for p, q in zip(clusters.assigned(x, owners, distances, centroids, moved), clusters.assigned(x, np.full(50, -1), distances, centroids, every), strict=True))
    after = clusters.assigned(x, owners, distances, centroids, moved)[0]
    sums = np.zeros((5, 4), int)
    for t in clusters.transfers(x, owners, after):
        sums[t["cluster"]] += t["sums"]
    assert np.array_equal(sums, np.array([x[after == c].sum(0) - x[owners == c].sum(0) for c in range(5)]))


def test_clusters_in_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{TABLES}/embeddings.parquet'")
    got = sorted(tuple(r) for r in clusters.delta_lloyd(spark.read.parquet(f"{TABLES}/embeddings.parquet")).collect())
    assert got == sorted(con.execute(clusters.lloyd_sql()).fetchall())
