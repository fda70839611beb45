"""Operators on documents against brute force, with odd rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dimframe.llm import chunks, decontamination, line_dedup, near_dups, packing, quality, repeats, secrets, sequences, shingles, token_counts
from dimframe.llm.common import WordHashes, words

from .conftest import TABLES, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table_rows(tables=TABLES):
    return duckdb.sql(f"select doc_id, text from '{tables}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(chunks.default_vocab())


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_words():
    assert words("a b\x1cc d e\te") == WORD.findall("a b\x1cc d e\te") and words(None) == []


def test_token_counts(spark, odd_docs, no_docs, odd_rows, tokenizer):
    more = [(i, t) for i, t in table_rows()]
    got = sorted((tuple(r) for r in token_counts.token_counts(odd_docs).collect()), key=key)
    want = []
    for i, t in odd_rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=key)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    assert counts == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in more}
    assert token_counts.token_counts(no_docs).count() == 0


def test_merging_one_pair_at_a_time():
    pairs = token_counts.RankedPairs(chunks.default_vocab())
    pieces = [b"aaaaaaa", b" the", b"x", "ünïcödé".encode(), b"\n\n\n\n", b"0123456789" * 30]
    one = []
    for p in pieces:
        sym = pairs.byte_ids[np.frombuffer(p, np.uint8)].tolist()
        while len(sym) > 1:
            ranks = pairs.ranks(np.array(sym[:-1]), np.array(sym[1:]))
            k = int(ranks.argmin())
            if ranks[k] >= 1 << 40:
                break
            sym[k : k + 2] = [int(pairs.merged[ranks[k]])]
        one.append(len(sym))
    assert pairs.counts(pieces).tolist() == one


def brute_groups(rows, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    out = []
    for k, (i, _) in enumerate(rows):
        known = [x for x in groups[find(k)] if x is not None]
        least = min(known) if known else None
        out.append((i, len(sets[k]), least, least is None if i is None else i == least))
    return sorted(out, key=key)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, odd_docs, no_docs, odd_rows, percent):
    got = sorted((tuple(r) for r in near_dups.near_duplicates(odd_docs, percent).collect()), key=key)
    assert got == brute_groups(odd_rows, percent)
    assert near_dups.near_duplicates(no_docs).count() == 0
    rows = table_rows()
    got = sorted((tuple(r) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()), key=key)
    assert got == brute_groups(rows, percent)


def test_near_copies_without_ids(spark):
    """Rows without an id, or of one id, meet the set of their own text alone."""
    rows = []
    for k in range(40):
        words_ = prose(60, 1000 + k // 4).split(" ")
        words_[k % 4 * 9] = f"w{k}"
        rows += [(None, " ".join(words_)), (5, " ".join([f"v{k}", *words_]))]
    got = sorted((tuple(r) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()), key=key)
    assert got == brute_groups(rows, 80)
    sketched = near_dups.sketches(spark.createDataFrame(rows, "doc_id long, text string"))
    made = near_dups.sets_of(spark.createDataFrame(rows, "doc_id long, text string"), sketched.select("cls", "doc_id", "t"))
    assert made.count() == 80


def test_near_copies_in_one_bucket(spark, monkeypatch):
    """A chain of edits: most pairs are not similar, and blocks are smaller than the bucket."""
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    base, rows = prose(150, 11).split(" "), []
    for k in range(40):
        base = list(base)
        base[(k * 3) % 150] = f"new{k}"
        rows.append((k, " ".join(base)))
    got = sorted((tuple(r) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()), key=key)
    assert got == brute_groups(rows, 85)


def test_sketches_estimate():
    rng, errors = np.random.default_rng(4), []
    for n in (6, 40, 400, 3000):
        for same in (0.3, 0.6, 0.9):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate((a[: int(n * same)], rng.integers(0, 2**63, n - int(n * same)).astype(np.uint64)))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = (shingles.registers(np.unique(shingles.mix(v))) for v in (a, b))
            errors.append(shingles.estimated_jaccard((x == y).sum()) - j)
    assert max(map(abs, errors)) < 0.2 and abs(np.mean(errors)) < 0.05


def test_shingle_hashes_are_of_lower_case():
    h = WordHashes()
    assert (shingles.shingle_set("A b C d E f", h) == shingles.shingle_set("a B c D e F", h)).all()
    assert len(shingles.shingle_set("Ä b", h)) == 1 and shingles.shingle_set("Ä b", h)[0] != shingles.shingle_set("ä b", h)[0]


def test_secrets(odd_docs, no_docs, odd_rows):
    got = {r["doc_id"]: r for r in secrets.secret_scan(odd_docs).where("doc_id is not null").collect()}
    t = dict(odd_rows)[14]
    spans = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            spans.append((m.start(), "assign", m.end()))
    for kind, pattern, least in (("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, t) if len(m[0]) >= least]
    text = ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[1]))))
    assert got[14]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and (got[14]["n_assign"], got[14]["n_access"], got[14]["n_hex"]) == (1, 1, 1)
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.secret_scan(no_docs).count() == 0 and secrets.secret_scan(odd_docs).count() == len(odd_rows)


def test_random_strings():
    encode = secrets._encoder(None, None).encode_ordinary
    text = "key Zx9Qw3Lk8Vb2Nm7Tr5Yp1Gd and 550e8400-e29b-41d4-a716-446655440000 and internationalization_of_things and " + "d41d8cd98f00b204e9800998ecf8427e"
    found = secrets.random_spans(text, [], encode, 2.2)
    assert [text[a:b] for a, b, _ in found] == ["Zx9Qw3Lk8Vb2Nm7Tr5Yp1Gd"]


def brute_repeats(rows, n=50):
    first = {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    ws = [WORD.findall(t or "") for _, t in rows]
    rank = lambda i: (i is None, i or 0)
    for k in order:
        for a in range(len(ws[k]) - n + 1):
            first.setdefault(tuple(ws[k][a : a + n]), rank(rows[k][0]))
    out = []
    for k, (i, _) in enumerate(rows):
        gone = set()
        for a in range(len(ws[k]) - n + 1):
            if first[tuple(ws[k][a : a + n])] < rank(i):
                gone.update(range(a, a + n))
        kept = [w for j, w in enumerate(ws[k]) if j not in gone]
        out.append((i, len(ws[k]), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=key)


def test_repeats(spark, odd_docs, no_docs, odd_rows):
    got = sorted((tuple(r) for r in repeats.without_repeats(odd_docs).collect()), key=key)
    assert got == brute_repeats(odd_rows)
    assert repeats.without_repeats(no_docs).count() == 0
    rows = table_rows()
    rows += [(100_000 + k, " ".join(WORD.findall(t or "")[3 : 60 + k])) for k, (_, t) in enumerate(rows[:20])] + [(200_000, "a " * 70 + "b"), (200_001, "c " + "a " * 300), (200_002, "a b " * 60), (200_003, "z a b " * 5 + "a b " * 60)]
    got = sorted((tuple(r) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=key)
    assert got == brute_repeats(rows)
    with pytest.raises(ValueError):
        repeats.without_repeats(odd_docs, window=40)


def test_windows_have_the_same_anchors_in_any_context():
    rng = np.random.default_rng(8)
    for trial in range(60):
        w = rng.integers(0, 4 if trial % 2 else 2**40, 50).astype(np.uint64)
        names = set()
        for _ in range(4):
            before, after = (rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64) for _ in range(2))
            both = np.concatenate((before, w, after))
            _, place, name = repeats.anchors(both, np.array([len(both)]), 50)
            names.add(int(name[place == len(before)][0]))
        assert len(names) == 1


def brute_patience(a, b):
    """Patience diff by its definition, on lines: equal ends, unique common lines in the longest order, the ranges between."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in brute_patience(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return brute_patience(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    links = [(i, b.index(s)) for i, s in enumerate(a) if a.count(s) == 1 and b.count(s) == 1]
    if not links:
        return sequences.common_pairs([hash(s) for s in a], [hash(s) for s in b])
    chain = [links[k] for k in sequences.longest_chain([j for _, j in links])]
    out, i, j = [], 0, 0
    for x, y in [*chain, (len(a), len(b))]:
        out += [(i + p, j + q) for p, q in brute_patience(a[i:x], b[j:y])]
        out += [(x, y)] * (x < len(a))
        i, j = x + 1, y + 1
    return out


def brute_lines(rows, least=20):
    """Every later document against the first holder of each of its features, and lines left over against all their holders."""
    clean = lambda s: re.sub(r"[\r\t]", " ", s).strip(" ")
    rank = lambda i: 2**63 - 1 if i is None else i
    texts = [None if t is None else tuple(clean(s) for s in t.split("\n")) for _, t in rows]
    wide = lambda s: len(s) >= least
    unit = {}
    for (i, _), t in zip(rows, texts, strict=True):
        if t is not None and re.search(r"[^ \t\x0b\f\r]", "".join(t)):
            unit[t] = min(unit.get(t, 2**63), rank(i))

    def features(t):
        for k, s in enumerate(t):
            if wide(s):
                yield (s,)
                if k + 1 < len(t):
                    yield (s, t[k + 1], "after")
                if k:
                    yield (s, t[k - 1], "before")

    holders = defaultdict(list)
    for t in sorted(unit, key=lambda t: unit[t]):
        for f in set(features(t)):
            holders[f].append(t)

    def aligned(t, other):
        pairs, out, block = brute_patience(t, other), set(), []
        for k, (p, q) in enumerate(pairs):
            block.append(p)
            if k + 1 == len(pairs) or pairs[k + 1] != (p + 1, q + 1):
                out |= set(block) if any(wide(t[p]) for p in block) else set()
                block = []
        return out

    gone = {}
    for t in unit:
        firsts = {holders[f][0] for f in features(t)}
        gone[t] = set().union(*(aligned(t, o) for o in firsts if unit[o] < unit[t]))
        for k, s in enumerate(t):
            if wide(s) and t.count(s) == 1 and k not in gone[t] and len(holders[s,]) > 2:
                gone[t] |= {("?", k)}
    out = []
    for (i, t), lines in zip(rows, texts, strict=True):
        cut = set()
        if lines in unit and t is not None:
            cut = set(range(len(lines))) if rank(i) > unit[lines] else {k for k in gone[lines] if isinstance(k, int)}
            asked = [k[1] for k in gone[lines] if not isinstance(k, int)] if rank(i) == unit[lines] else []
            for k in asked:
                if any(k in aligned(lines, o) for o in holders[lines[k],] if unit[o] < unit[lines]):
                    cut.add(("some", k))
        out.append((i, t, cut))
    return out


def check_lines(rows, got, least=20):
    """Rows as brute force has them; a line left over may take its block with it, which wave it met first decides."""
    assert len(got) == len(rows)
    want = sorted(((-1 if i is None else i, t or "", cut) for i, t, cut in brute_lines(rows, least)), key=lambda x: x[:2])
    for (i, t, cut), r in zip(want, sorted(got, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")), strict=True):
        removed, sure = set(r[2]), {k for k in cut if isinstance(k, int)}
        late = {k[1] for k in cut if not isinstance(k, int)}
        assert i == (-1 if r[0] is None else r[0]) and sure | late <= removed, (i, sure, late, removed)
        if not late:
            assert sure == removed, (i, sure, removed)


def lines_gone(df):
    gone = line_dedup.line_dedup(df.select("doc_id", "text", F.col("text").alias("before")))
    return [(r["doc_id"], r["before"], r["removed"], r["text"]) for r in gone.select("doc_id", "before", "removed", "text").collect()]


def test_line_dedup(spark, odd_docs, no_docs, odd_rows):
    got = lines_gone(odd_docs)
    check_lines(odd_rows, got)
    for _, before, removed, after in got:
        if before is not None:
            assert after == "\n".join(s for k, s in enumerate(before.split("\n")) if k not in removed)
    assert line_dedup.line_dedup(no_docs).count() == 0
    rows = table_rows()
    got = lines_gone(spark.createDataFrame(rows, "doc_id long, text string"))
    check_lines(rows, got)
    assert sum(len(r[2]) for r in got) > 0
    digest = {r["doc_id"]: r for r in line_dedup.line_dedup_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, _, removed, after in got:
        assert digest[i]["kept_sha256"] == hashlib.sha256((after or "").encode()).hexdigest() and digest[i]["removed"] == ",".join(map(str, removed))


def test_lines_in_shuffled_orders(spark):
    """Many documents of few lines in any order and number: lines left over by first holders are tried with all others."""
    rng = np.random.default_rng(9)
    pool = [f"a long line of prose, number {k}" for k in range(9)] + ["short", "", "brief"]
    rows = [(int(i), "\n".join(pool[j] for j in rng.integers(0, len(pool), rng.integers(1, 9)))) for i in [*range(60), *range(40, 50), *[70] * 5]]
    rows += [(None, rows[3][1]), (None, "\n".join(pool[:5])), (None, None), (0, None)]
    check_lines(rows, lines_gone(spark.createDataFrame(rows, "doc_id long, text string")))


def test_quality(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("pmod(xxhash64(doc_id), 3) > 0")
    model = quality.fit_quality(docs, train)
    held = labels.join(train, "doc_id", "left_anti").withColumn("g", quality.grade())
    rows = quality.graded(docs, model).join(held, "doc_id").select("g", "kept", "expected_grade").collect()
    share = lambda g: np.mean([r["kept"] for r in rows if r["g"] == g])
    assert share(2) > 0.95 and share(0) < 0.15 and share(1) < 0.3, (share(0), share(1), share(2))
    assert np.mean([r["expected_grade"] for r in rows if r["g"] == 2]) > np.mean([r["expected_grade"] for r in rows if r["g"] == 0]) + 0.5
    assert model.thresholds[0] < model.thresholds[1]
    assert quality.graded(odd_docs, model).count() == odd_docs.count()
    kept = quality.selected(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == quality.graded(odd_docs, model).where("kept").count()
    empty = labels.where("false")
    assert quality.graded(no_docs, quality.fit_quality(docs, empty)).count() == 0
    odd = spark.createDataFrame([(0, None, 1), (None, 1, 0), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.graded(odd_docs, quality.fit_quality(odd_docs, odd)).count() == odd_docs.count()


def check_packing(rows, pieces, tokenizer, size=2048):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append(p)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    want = defaultdict(list)
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        raw = np.array(ids, "<u4").tobytes()
        for a in range(0, len(ids), size):
            part = raw[4 * a : 4 * (a + size)]
            want[i].append((a, len(part) // 4, zlib.crc32(part), len(ids)))
    for i, parts in want.items():
        assert sorted(parts) == sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in by_doc[i])
    return sum(p["length"] for p in pieces) / (len(by_sequence) * size)


def test_packing(spark, odd_docs, no_docs, odd_rows, tokenizer):
    check_packing(odd_rows, packing.packed(odd_docs).collect(), tokenizer)
    rows = table_rows()
    full = check_packing(rows, packing.packed(spark.createDataFrame(rows, "doc_id long, text string")).collect(), tokenizer)
    assert full > 0.98
    assert packing.packed(no_docs).count() == 0
    with_ids = packing.packed(odd_docs, with_ids=True).where("doc_id = 10").first()
    assert np.frombuffer(with_ids["ids"], "<u4").tolist() == [*tokenizer.encode("one two", add_special_tokens=False).ids, 1]


def test_fullest_is_fullest():
    rng = np.random.default_rng(6)
    for _ in range(200):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.choice(np.arange(1, 30), rng.integers(1, 6), replace=False)}
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * c for s in sums for c in range(n + 1)}
        capacity = int(rng.integers(1, 60))
        best = max(s for s in sums if s <= capacity)
        got = packing.fullest(counts, capacity)
        assert sum(k * c for k, c in got.items()) == best and all(c <= counts[k] for k, c in got.items())


def test_decontamination(spark, odd_docs, no_docs):
    docs, bench = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "benchmark"))
    items, rows = bench.collect(), docs.collect()
    exact = {(d["doc_id"], i["item_id"]) for d in rows for i in items if d["text"] and i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()}
    assert exact and got == exact
    text = items[3]["text"].split(" ")
    changed = " ".join(w.upper() if k % 5 == 0 else w for k, w in enumerate(text) if k % 9)  # every ninth word is gone
    more = spark.createDataFrame([(900_000, prose(100, 1) + "\n" + changed + " " + prose(80, 2)), (900_001, prose(300, 3)), (900_002, " ".join(sorted(text)))], "doc_id long, text string")
    found = decontamination.leaks(docs.select("doc_id", "text").union(more), bench).where("doc_id >= 900000").collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(900_000, items[3]["item_id"])]
    assert decontamination.leaks(no_docs, bench).count() == 0 and decontamination.leaks(odd_docs, bench).count() == 0
    blank = spark.createDataFrame([(1, None), (None, "x y"), (2, ""), (3, "one two")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(odd_docs, blank).collect()} <= {(10, 3), (11, 3)}
    assert decontamination.leaks(docs, bench.where("false")).count() == 0


def test_columns_of_documents_may_clash(odd_docs):
    out = line_dedup.line_dedup(odd_docs)
    assert set(odd_docs.columns) <= set(out.columns) and out.select(F.max("lang")).first()[0] is None


def lines_left(spark, texts):
    rows = line_dedup.line_dedup(spark.createDataFrame(list(texts), "doc_id long, text string")).select("doc_id", "text", "removed").collect()
    return {(r["doc_id"], r["text"]): r["removed"] for r in rows}


def test_hot_lines_and_partners(spark, monkeypatch):
    """A line that many units ask for, and a partner of many, are dealt out in parts."""
    from dimframe.llm import groups

    monkeypatch.setattr(groups.salted_join, "__defaults__", (3, 10, "inner"))
    monkeypatch.setattr(line_dedup, "BATCH", 2)
    rng = np.random.default_rng(21)
    rows = [(k, "\n".join(rng.permutation(["a very common line of all texts", f"one line of its own, number {k}", f"a line of a few texts, number {k % 4}", "brief"]).tolist())) for k in range(40)]
    check_lines(rows, lines_gone(spark.createDataFrame(rows, "doc_id long, text string")))


def test_lines_align_with_later_holders_and_whole_blocks(spark):
    """Lines that the first holder has in another order go by a later holder's; copies go whole, whatever their lines."""
    a, b, c, d, e = (f"a long line of prose, number {k}" for k in range(5))
    crossed = {1: [b, a], 2: [a, b, c], 3: [a, b, c]}
    got = lines_left(spark, [(i, "\n".join(v)) for i, v in crossed.items()])
    assert got[3, ""] == [0, 1, 2] and len(got[2, f"{a}\n{c}" if (2, f"{a}\n{c}") in got else f"{b}\n{c}"]) == 1
    # many holders in the other order before one in this order
    far = [(k, "\n".join([b, a])) for k in range(1, 8)] + [(8, f"{a}\n{b}\nx"), (9, f"{a}\n{b}\nx")]
    assert lines_left(spark, far)[9, ""] == [0, 1, 2]
    mixed = [d, "short", "", "", e, "twice, a line of prose as long", "twice, a line of prose as long", "end"]
    got = lines_left(spark, [(1, "\n".join(mixed)), (2, "\n".join(mixed)), (3, f"{e}\ntwice, a line of prose as long\nother")])
    assert got[2, ""] == list(range(8)) and got[3, "other"] == [0, 1]
    # short lines between lines of two other documents
    got = lines_left(spark, [(1, a), (2, b), (3, f"{a}\nshort\n{b}"), (4, f"{a}\nshort\n{b}")])
    assert got[3, "short"] == [0, 2] and got[4, ""] == [0, 1, 2]
    # texts of short lines: copies go whole, other texts lose nothing
    verse = "o rose\nthou art\n\nsick"
    assert lines_left(spark, [(1, verse), (2, verse), (3, verse + "\nend"), (4, " \n"), (5, " \n")]) == {(1, verse): [], (2, ""): [0, 1, 2, 3], (3, verse + "\nend"): [], (4, " \n"): [], (5, " \n"): []}
    # rows of one id lose their own lines
    got = lines_left(spark, [(1, a), (2, f"x\n{a}"), (2, f"{b}\n{c}\ny")])
    assert got == {(1, a): [], (2, "x"): [1], (2, f"{b}\n{c}\ny"): []}


def test_repeats_of_rows_with_equal_ids(spark):
    """Rows of one id, or without one, lose what their own texts repeat."""
    rows = [(1, prose(120, 41)), (None, prose(120, 41)), (None, prose(90, 42)), (None, prose(200, 43)), (2, prose(150, 44)), (3, "start " + prose(150, 44)), (3, prose(60, 45)), (3, prose(170, 46)), (None, prose(30, 47) + " " + prose(150, 44))]
    got = sorted((tuple(r) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=key)
    assert got == brute_repeats(rows) and sum(r[2] for r in got) == 120 + 150 + 150


def test_long_items_and_many_words(spark):
    """A verbatim item of several hundred words is found, beside items of more different words than 16 bits count."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(12)
    item = " ".join(f"w{k}" for k in rng.permutation(600))
    items = [(1, item)] + [(2 + k, " ".join(f"u{k}x{j}" for j in range(700))) for k in range(100)]
    more = [(900_000, prose(100, 51) + " " + item + " " + prose(77, 52)), (900_001, " ".join(f"w{k}" for k in rng.permutation(600)))]
    more += [(900_010 + k, " ".join(f"w{j}" for j in rng.integers(0, 600, 200))) for k in range(30)]  # other texts of the same words
    found = decontamination.leaks(docs.union(spark.createDataFrame(more, docs.schema)), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["matched"]) for r in found] == [(900_000, 1, 1.0)]


def test_random_letters_and_short_strings():
    encode = secrets._encoder(None, None).encode_ordinary
    planted = ["qzxvkjwpfhbtmrydgcnlqzwxkvjphfbg", "QZXVKJWPFHBTMRYDGCNLQZWXKVJPHFBG", "x9Qw3Lk8Vb2Nm7Tr", "zQ4vX8kJ2pW7mB5nT9"]
    text = "internationalization CHARACTERISTICALLY Misunderstandings_and counterrevolutionaries " + " and ".join(planted)
    found = secrets.random_spans(text, [], encode, 2.2)
    assert [text[a:b] for a, b, _ in found] == planted


def paraphrase(text, rng):
    """Every fifth word another one, and the two halves swapped."""
    ws = text.split()
    ws = [f"synonym{rng.integers(1000)}" if k % 5 == 2 else w for k, w in enumerate(ws)]
    return " ".join(ws[len(ws) // 2 :] + ws[: len(ws) // 2])


def test_paraphrases_are_found(spark, monkeypatch):
    """Recall of planted paraphrases, over all items; the same items in parts; items of one id."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    docs, rng = docs.select("doc_id", "text"), np.random.default_rng(5)
    whole = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()}
    items, others = bench.collect(), [r["text"] for r in docs.where("length(text) > 300").collect() if r["doc_id"] not in {d for d, _ in whole}]
    rows = [(900_000 + k, others[k % len(others)][:300] + " " + paraphrase(i["text"], rng) + " " + others[(7 * k + 3) % len(others)][:300]) for k, i in enumerate(items)]
    want = {(900_000 + k, i["item_id"]) for k, i in enumerate(items)}
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs.union(spark.createDataFrame(rows, docs.schema)), bench).collect()}
    assert len(found & want) >= 0.9 * len(want), (len(found & want), len(want))
    assert found - want == whole
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", 30_000)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()} == whole
    first = min(whole)[1]
    twice = bench.where(F.col("item_id") == first).union(spark.createDataFrame([(first, "quite another item of seven or more words")], bench.schema))
    assert {r["item_id"] for r in decontamination.leaks(docs, twice).collect()} == {first}


def test_short_and_large_items(spark, monkeypatch):
    """Items far shorter than a passage are found word by word; an item over the limit is a part of its own."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(31)
    known = [w for _, t in table_rows() for w in words(t)][:5000]
    items, rows = [], []
    for k in range(60):
        n = 3 + k % 6
        items.append((k, " ".join(f"{known[int(j)]}" for j in rng.integers(0, len(known), n - 1)) + f" rare{k}"))
        rows.append((800_000 + k, " ".join(known[int(j)] for j in rng.integers(0, len(known), 150)) + " " + items[-1][1].upper() + ", " + " ".join(known[int(j)] for j in rng.integers(0, len(known), 90))))
    large = (900, " ".join(f"term{k}" for k in range(400)))
    rows += [(900_000, prose(40, 1) + " " + large[1]), (900_001, "term1 term3 term2")]
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", 300)
    all_docs, bench = docs.union(spark.createDataFrame(rows, docs.schema)), spark.createDataFrame([*items, large, large], "item_id long, text string")
    found = [(r["doc_id"], r["item_id"]) for r in decontamination.leaks(all_docs, bench).collect()]
    assert {(800_000 + k, k) for k in range(60)} | {(900_000, 900)} <= set(found)
    assert sorted(found).count((900_000, 900)) == 2 and all(d >= 800_000 for d, _ in found)


def test_directions_are_singular_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.choice(40, 32, p=np.arange(1, 41) / 820).astype(np.uint32).tobytes()) for k in range(300)]
    coded = spark.createDataFrame(rows, "doc_id long, ids binary")
    weight = rng.uniform(0.1, 2, 40)
    a = np.stack([np.bincount(np.frombuffer(r, np.uint32), minlength=40) for _, r in rows]) * weight
    v, s = decontamination.directions(coded, weight, np.arange(30, 40))
    _, want, vt = np.linalg.svd(a)
    assert np.allclose(s, want, rtol=1e-3) and np.allclose(np.abs((v * vt.T).sum(0))[:5], 1, atol=1e-3)


def test_token_counts_of_every_kind_of_character(tokenizer):
    """Characters of all blocks, assigned or not, between letters, contractions and spaces."""
    counter = token_counts.ChunkCounts(chunks.default_vocab())
    points = [c for c in [*range(0, 0x3400), *range(0x3400, 0x20000, 5), *range(0x20000, 0x110000, 997), 0x1E6C0] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}'ll {chr(c)}1 {chr(c)}. b" for c in points]
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts).tolist() == want


def test_secrets_of_all_documents(spark):
    """Base and random spans of a whole table against the patterns and the token ratio as they stand in the contract."""
    rows = table_rows("/root/testdata/sf0.1")
    encode = secrets._encoder(None, None).encode_ordinary
    got = {r["doc_id"]: r for r in secrets.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order, found = ["assign", "access", "hex", "random"], 0
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), "assign", m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        for kind, pattern, least in (("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)):
            spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, t) if len(m[0]) >= least]
        base = list(spans)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t):
            known = re.fullmatch(r"[0-9a-fA-F]+", m[0]) and len(m[0]) in (32, 40, 56, 64, 96, 128) or re.fullmatch(r"[0-9+/_=-]+", m[0]) or re.fullmatch(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", m[0])
            if not known and not any(a <= m.start() and m.end() <= b for a, _, b in base) and len(m[0]) / len(encode(m[0])) < 2.2:
                spans.append((m.start(), "random", m.end()))
        text = lambda x: ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(x, key=lambda s: (s[0], order.index(s[1]))))
        r = got[i]
        assert r["spans"] == text(spans) and r["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for _, k, _ in base) for kind in order[:3]]
        found += len(base)
    assert found > 0


def test_ratio_finds_planted_secrets():
    """Recall of random strings of several alphabets by length, and precision on words put together."""
    rng, encode = np.random.default_rng(7), secrets._encoder(None, None).encode_ordinary
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plain = re.findall(r"[A-Za-z]{3,}", "the quick brown fox jumps over lazy dogs while many important international conferences discuss environmental developments and responsibilities")
    for n in (16, 24, 40):
        hits = sum(bool(secrets.random_spans("".join(rng.choice(list(letters), n)), [], encode, 2.2)) for _ in range(300))
        false = sum(bool(secrets.random_spans("_".join(rng.choice(plain, 4)), [], encode, 2.2)) for _ in range(300))
        assert hits >= 0.97 * 300 and false <= 0.03 * 300, (n, hits, false)


def test_shapes():
    letters = re.compile(r"[^\W_]+")
    for w in ("a", "A", "AB", "Ab1", "x,", "X.", "XY.", "don't", "--", "_", "é!", "a.b.c.d.e.f.g.h", "ß1?", "(A"):
        inner = "".join(letters.findall(w))
        assert quality.shape(w) == ("A" if len(inner) > 1 and inner.isupper() else "a") + letters.sub("", w)[:6], w


def test_scores_and_likelihood_of_the_ordinal_model():
    """Scores against sums over sets of features; the online fit against full-batch ascent of the same likelihood."""
    rng = np.random.default_rng(2)
    common, groups = [f"word{k}" for k in range(30)], [[f"bad{k}" for k in range(8)], [f"poor{k}" for k in range(8)], [f"good{k}" for k in range(8)]]
    texts, grades = [], []
    for _ in range(240):
        g = int(rng.integers(3))
        of = g if rng.random() < 0.85 else int(rng.integers(3))
        texts.append(" ".join(rng.permutation([*rng.choice(common, 12), *rng.choice(groups[of], 3)])))
        grades.append(g)
    table, grades = quality.WordTable(), np.array(grades)
    rows = [quality.text_features(t, table) for t in texts]
    model = quality.OrdinalModel.fit(rows, grades, passes=60, sparsity=0.0)

    want = []
    for t in texts:
        ws = set(t.split())
        at = [(quality.place("w" + w.strip(".,").lower()), quality.place("p" + w.lower()[:4]), quality.place("s" + ("A" if len(w) > 1 and w.isupper() else "a"))) for w in ws]
        lexical = {p for a in at for p in a[:2]}
        want.append(sum(model.weights[p] for p in lexical) + 4 * sum(model.weights[a[2]] for a in at) / len(ws) + model.weights[quality.repeat_place(len(ws), len(t.split()))])
    assert np.allclose(quality.Scorer(model).scores(texts), want, atol=1e-4)
    assert quality.Scorer(model).scores([None, "", " "]).tolist() == [0, 0, 0]

    def likelihood(score, t):
        up, low = quality.sigmoid(np.append(t, 99)[grades] - score), quality.sigmoid(np.append(-99, t)[grades] - score)
        return np.log(np.maximum(up - low, 1e-12)).mean()

    used = sorted({int(p) for at, _ in rows for p in at})
    x = np.zeros((len(rows), len(used)))
    for k, (at, v) in enumerate(rows):
        x[k, np.searchsorted(used, at)] = v
    w, t = np.zeros(len(used)), np.array([-1.0, 1.0])
    best = None
    for _ in range(4000):
        s = x @ w
        up, low = quality.sigmoid(np.append(t, 99)[grades] - s), quality.sigmoid(np.append(-99, t)[grades] - s)
        w += 0.1 * x.T @ (up + low - 1) / len(rows)
        mass = np.maximum(up - low, 1e-9)
        for j in range(2):
            t[j] += 0.1 * ((grades == j) * up * (1 - up) / mass - (grades == j + 1) * low * (1 - low) / mass).mean()
        now = likelihood(x @ w, t)
        best = now if best is None else max(best, now)
    none = likelihood(np.zeros(len(rows)), np.log([np.mean(grades <= 0) / np.mean(grades > 0), np.mean(grades <= 1) / np.mean(grades > 1)]))
    assert likelihood(np.array(want), model.thresholds) > none + 0.8 * (best - none), (none, best)


def test_repeats_of_one_text_very_often(spark):
    """Rows of one id and text, or of none, are more than one task is to hold: their key is split, and no row is lost."""
    hot, other = prose(70, 31), prose(60, 32)
    rows = [(1, hot)] + [(None, hot)] * 2500 + [(None, None)] * 2500 + [(7, hot + " " + other)] * 1200 + [(8, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {tuple(r) for r in repeats.without_repeats(df).distinct().collect()}
    counts = {r["doc_id"]: r["count"] for r in repeats.without_repeats(df).groupBy("doc_id").count().collect()}
    assert got == {tuple(r) for r in brute_repeats([(1, hot), (None, hot), (None, None), (7, hot + " " + other), (8, other)])}
    assert counts == {1: 1, None: 5000, 7: 1200, 8: 1}


def test_secrets_within_many_spans():
    """A candidate within any fixed span is left out, wherever in the order of starts that span stands."""
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdef0123456789XYZqrs") for _ in range(rng.choice([10, 18, 30]))) for _ in range(300))
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    base = [(a - rng.randrange(2) if a else a, b + rng.randrange(-1, 3), rng.choice(secrets.KINDS[:3])) for a, b in words if rng.random() < 0.4]
    encode = secrets._encoder(None, None).encode_ordinary
    every = secrets.random_spans(text, [], encode, 2.2)
    assert secrets.random_spans(text, base, encode, 2.2) == [s for s in every if not any(a <= s[0] and s[1] <= b for a, b, _ in base)]
