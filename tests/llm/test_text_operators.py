"""Operators on documents against brute-force versions, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

duckdb = pytest.importorskip("duckdb")

from millrace.llm import fingerprints, jaccard, licenses, lmscore, mixing, packing, queries, textblocks, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, size string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles_of(text):
    ws = words_of(text)
    return frozenset({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set()))


def make(seed=3, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n ", "one", "One two", "a b c d", "A b\tC d", "x " * 3000, "ünï cödé ß — 漢字 and more words here", "one"]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    for _ in range(n):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([6, 20, 80, 300]))]
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 5])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy) + rnd.choice(["", " Extra"]))
        if rnd.random() < 0.4:
            texts.append(passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([5, 10, 60]))))
    rows = [(i * 3 + 1, t, "en", rnd.choice(["s1", "s2", "s2", "s2", None, "é"]), len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def view(docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return con


# --- shared words and shingles


def test_blocks_match_regular_expressions():
    texts = [r[1] for r in make(5, 30)]
    per, sizes = [], []
    for _, _, data, offsets in textblocks.slices(pa.array(texts)):
        w, n = textblocks.word_hashes(data, offsets)
        per += n.tolist()
        sizes += textblocks.shingle_sets(w, n)[1].tolist()
    assert per == [len(words_of(t)) for t in texts]
    assert sizes == [len(shingles_of(t)) for t in texts]


# --- 7


def brute_components(rows):
    sets = {r[0]: shingles_of(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components(docs):
    want = brute_components([tuple(r) for r in docs.collect()])
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == want and len({c for _, c in got.values()}) < len(got)


def test_jaccard_refines_hot_keys(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "REFINE_PAIRS", 3)
    monkeypatch.setattr(jaccard, "REFINE_CLASSES", 2)
    monkeypatch.setattr(jaccard, "REFINE_LEVELS", 1)
    want = brute_components([tuple(r) for r in docs.collect()])
    assert {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(docs).collect()} == want


def test_jaccard_deals_large_groups_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "REFINE_CLASSES", 2)
    monkeypatch.setattr(jaccard, "REFINE_LEVELS", 0)
    want = brute_components([tuple(r) for r in docs.collect()])
    assert {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(docs).collect()} == want


def test_jaccard_null_and_repeated_ids(spark):
    """Links go by text, not by doc_id."""
    rnd = random.Random(4)
    t1, t2 = ([f"w{rnd.randrange(10**6)}" for _ in range(60)] for _ in range(2))
    near = lambda t: " ".join([*t[:-1], "other"])
    t1, t2, n1, n2 = " ".join(t1), " ".join(t2), near(t1), near(t2)
    rows = [(1, t1), (1, t2), (2, n1), (3, n2), (None, n1)]
    for order in (rows, rows[::-1]):
        got = jaccard.jaccard_components(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted(((r[0] or 0, r[2]) for r in got)) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1)]
    got = jaccard.jaccard_components(spark.createDataFrame([(None, t1), (5, n1), (6, t2), (None, n2), (7, "x y")], "doc_id long, text string")).collect()
    assert sorted(((r[0] or 0, r[2]) for r in got)) == [(0, 5), (0, 6), (5, 5), (6, 6), (7, 7)]


def test_jaccard_edges(spark, empty):
    assert jaccard.jaccard_components(empty).count() == 0
    rows = [(None, "a b c"), (None, None), (5, "a b c"), (5, "a b c"), (6, None), (7, "")]
    got = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 1, 5), (None, 0, None), (5, 1, 5), (5, 1, 5), (6, 0, 6), (7, 0, 7)], key=str)


def test_every_link_shares_a_segment():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 9, 10, 17, 40, 150, 700):
        for _ in range(60):
            a = rnd.integers(1, 2**63, n).astype(np.uint64)
            change = rnd.integers(0, n // 9 + 1)
            b = np.concatenate([a[change:], rnd.integers(1, 2**63, rnd.integers(0, change + n // 8 + 1)).astype(np.uint64)])
            common = n - change
            if 100 * common < 80 * (n + len(b) - common) or not len(b):
                continue
            ka, _ = jaccard.segment_keys(np.sort(a), np.array([len(a)]))
            kb, _ = jaccard.segment_keys(np.sort(b), np.array([len(b)]))
            assert set(ka.tolist()) & set(kb.tolist())
            assert jaccard.hamming(jaccard.bit_sketch(a), jaccard.bit_sketch(b)) <= n + len(b) - 2 * common


# --- 2


def test_fingerprint_edits(docs, spark, empty):
    rows = sorted(((r[0], r[1] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    assert len(got) == len(rows)
    errors = []
    for i, (id_, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(text) // 2
        edited = text[: len(text) - k] + following[:k]
        r = got[id_]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles_of(text), shingles_of(edited)
        if a | b:
            errors.append(abs(r["near_edited"] - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.05
    same = defaultdict(set)
    for id_, text in rows:
        same[text].add(got[id_]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.fingerprint_edits(empty).count() == 0
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    odd = spark.createDataFrame([(None, "n"), (2, "b c"), (2, "b c"), (2, None), (9, "z")], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(odd).count() == 5


def test_fingerprint_edits_of_many_odd_ids(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 7, -3, 10**12, *range(200)]), " ".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(12)))) for _ in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), sha(r[1])))
    want = Counter()
    for i, (id_, text) in enumerate(order):
        k = len(text) // 2
        want[id_, sha(text[: len(text) - k] + order[(i + 1) % len(order)][1][:k])] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprints.fingerprint_edits(d).collect()) == want


def test_near_pairs_finds_near_copies(docs):
    """At the default bands: of all pairs of different sets with a similarity of 0.8, at least 0.95."""
    classes, pairs = fingerprints.near_pairs(docs)
    names = {r["doc_id"]: r["id"] for r in classes.collect()}
    found = {frozenset((r["a"], r["b"])) for r in pairs.collect()}
    comp = {x: x for x in names.values()}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in map(tuple, found):
        comp[find(a)] = find(b)
    sets = {r[0]: shingles_of(r[1]) for r in docs.collect()}
    ids = [i for i in names if sets[i]]
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if names[a] != names[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert near and sum(find(names[a]) == find(names[b]) for a, b in near) >= 0.95 * len(near)


def test_near_pairs(docs):
    classes, pairs = fingerprints.near_pairs(docs, bands=64)
    names = defaultdict(set)
    for r in classes.collect():
        names[r["id"]].add(r["doc_id"])
    sets = {r[0]: shingles_of(r[1]) for r in docs.collect()}
    for r in pairs.collect():
        a, b = (sets[min(names[r[x]])] for x in "ab")
        assert abs(len(a & b) / len(a | b) - r["jaccard"]) < 1e-9 and r["jaccard"] >= 0.8


# --- 5


def test_encode_is_the_tokenizers_own():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    texts = ["It's a Test, don't!", "ÉCOLE naïve Straße ΣΊΣΥΦΟΣ İstanbul", "a\x1cb <|endoftext|> x", "é ﬁ ① 漢字かな 12,345 foo_bar --- ***!!", "", " \n", "x" * 500, "'s 'S it'll", "a b c\u0085d"]
    texts += [r[1] for r in make(8, 20) if r[1]]
    for text, data in zip(texts, packing.encode(texts, path)):
        assert np.frombuffer(data, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_gapless_and_tight(seed):
    rnd = random.Random(seed)
    counts = Counter(min(4096, int(rnd.paretovariate(0.7) * 30)) for _ in range(3000)) if seed else Counter({1366: 5, 2048: 7, 4096: 2, 1: 9, 1365: 4, 2730: 3, 2731: 2})
    bins, used = defaultdict(list), Counter()
    for n, lo, hi, first, each, base in packing.plan(dict(counts), 4096):
        for k in range(lo, hi):
            bins[first + (k - lo) // each].append((base + (k - lo) % each * n, n))
            used[n] += 1
    assert used == counts
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 4096
    total = sum(n * c for n, c in counts.items())
    assert len(bins) <= math.ceil(total / 4096) * 1.25 + 2


def test_encode_looks_distinct_words_up_once():
    path = queries.tokenizer_path()
    calls = 0

    def count(*_):
        nonlocal calls
        calls += 1

    text = "The cat, it's \u00c9t\u00e9. " * 20_000 + "x" * 40
    packing.encode(["warm up"], path)
    sys.setprofile(count)
    try:
        (data,) = packing.encode([text], path)
    finally:
        sys.setprofile(None)
    assert calls < 5_000  # 80,001 words
    t = packing._tokenizer(path)[0]
    assert np.frombuffer(data, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    texts = ["", " ", "\x00a b\x00", "!!! a'b' 'a, A1, b-c, \u0130x \u017f K\u212a. \xa0z\x85y\u3000x", "a\x1cb c", "Q" * 50 + "?", "?" * 50]
    for text, data in zip(texts, packing.encode(texts, path)):
        assert np.frombuffer(data, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_encode_keeps_few_bytes():
    path = queries.tokenizer_path()
    rnd = random.Random(6)
    t = packing._tokenizer(path)
    for _ in range(30):
        packing.encode(["".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(20_000)), "a\x1c" * 5000], path)
    assert max(map(len, t[2].ids), default=0) <= packing.CACHED_LENGTH and t[2].used + t[3].used <= packing.CACHE_BYTES


def test_pack_null_ids(spark):
    d = spark.createDataFrame([(None, None)] * 3000 + [(1, "a b")], "doc_id long, text string")
    rows = packing.pack(d, queries.tokenizer_path(), 16).collect()
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(rows) == len(places) == 3001 and len({p[0] for p in places}) <= 3002 // 16 + 2


def test_pack(docs, empty):
    path = queries.tokenizer_path()
    got = packing.pack(docs, path, 256).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    rows = {r[0]: r[1] or "" for r in docs.collect()}
    assert set(by_doc) == set(rows)
    for id_, text in rows.items():
        data = packing.encode([text], path)[0] + (1).to_bytes(4, "little")
        parts = sorted(by_doc[id_], key=lambda r: r["piece"])
        assert sum(r["length"] for r in parts) == len(data) // 4
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(data[4 * r["start"] : 4 * (r["start"] + r["length"])]) and r["start"] == 256 * r["piece"]
    for items in by_bin.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack(empty, path).count() == 0


# --- 9


def test_mixing_equals_sql(docs, empty):
    mixed = mixing.mix(docs)
    got = sorted(map(tuple, mixed.selectExpr("doc_id", "size", "source_size", "round(target, 3)", "taken").collect()))
    assert got == [tuple(r) for r in view(docs).sql(mixing.MIX_SQL + " ORDER BY doc_id").fetchall()]
    per = defaultdict(lambda: [0, 0, 0])
    for r in mixed.collect():
        assert r["taken"] <= 2 * r["size"]
        p = per[r["source"]]
        p[0] += r["taken"]
        p[1] += r["size"]
        p[2] = r["target"]
    assert all(abs(t - target) <= 1 and target <= 2 * size + 1e-6 for t, size, target in per.values())
    assert abs(sum(t for t, *_ in per.values()) - 1.5 * sum(s for _, s, _ in per.values())) < 5
    assert mixing.mix(empty).count() == 0


def test_dealt_positions_equal_sql(docs):
    got = sorted(tuple(r) for r in mixing.deal(docs).selectExpr("doc_id", "size", "source_size", "round(target, 3)", "taken", "round(position, 6)").collect())
    want = view(docs).sql(mixing.DEAL_SQL + " ORDER BY doc_id").fetchall()
    assert len(got) == len(want) and any(r[5] for r in got)
    for a, b in zip(got, want):
        assert a[:5] == tuple(b)[:5] and (a[5] is None) == (b[5] is None) and abs((a[5] or 0) - (b[5] or 0)) < 2e-6


def test_positions_follow_the_curriculum(docs):
    copies = mixing.positions(mixing.mix(docs)).collect()
    assert all(0 <= r["position"] <= 1 for r in copies)
    per = defaultdict(list)
    for r in copies:
        per[r["ordinal"]].append((r["position"], r["words"]))

    def early(rows):
        return sum(w for p, w in rows if p < 0.5) / sum(w for _, w in rows)

    # the first source's weight falls with time, the last one's rises
    assert early(per[0]) > early(per[max(per)])


def training_position(done, slope):
    """The time at which the cumulative demand t * (1 + s) - s * t * t reaches ``done``, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mid * (1 + slope) - slope * mid * mid < done else (low, mid)
    return low


def test_mixing_query_deals_all_copies_in_order(docs, spark, tmp_path):
    odd = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c d e", None), (2, None, "s"), (3, "", None)], "doc_id long, text string, source string")
    docs = docs.select("doc_id", "text", "source").unionByName(odd)
    first = []
    for r in mixing.mix(docs).collect():
        slope = 0.5 * (1 - 2 * r["ordinal"] / (r["sources"] - 1)) if r["sources"] > 1 else 0.0
        place = training_position(r["before"] / r["target"], slope) if r["taken"] else None
        first.append((r["doc_id"], r["size"], r["taken"], r["repeats"] * (r["size"] > 0) + (r["part"] > 0), place))
    dealt = mixing.deal(docs).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r[:4]) + (r[4] is None, round(r[4] or 0, 9))
    got = [(r["doc_id"], r["size"], r["taken"], r["copies"], r["position"]) for r in dealt]
    for a, b in zip(sorted(got, key=key), sorted(first, key=key), strict=True):
        assert a[:4] == b[:4] and (a[4] is None) == (b[4] is None) and abs((a[4] or 0) - (b[4] or 0)) < 1e-7
    placed = [p for *_, p in got if p is not None]
    assert placed == sorted(placed) and all(p is None for *_, p in got[len(placed) :])
    # the query gives its rows in that order
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r["doc_id"], r["taken"]) for r in queries.op9_mixing(spark, str(tmp_path)).collect()] == [r[:1] + r[2:3] for r in got]


def test_mixing_keeps_rows_that_repeat(spark):
    d = spark.createDataFrame([(1, "a b", "s", "k"), (1, "a b", "s", "k"), (None, "c", None, "k"), (2, None, "s", "k")], "doc_id long, text string, source string, size2 string")
    m = mixing.mix(d, keep=True)
    assert m.count() == 4 and m.select("row.*").columns == d.columns
    assert mixing.positions(m).count() >= 3


def test_mixing_takes_whole_copies_of_rows_without_words(spark):
    d = spark.createDataFrame([(1, "a b c", "s"), (2, "", "s"), (3, None, "s"), (4, "x", "t")], "doc_id long, text string, source string")
    copies = mixing.positions(mixing.mix(d)).collect()
    times = Counter(r["doc_id"] for r in copies)
    assert times[2] == times[3] == min(r["repeats"] for r in copies if r["source"] == "s")


def test_mixing_whole_documents(docs):
    cut = {(r["source"], r["doc_id"]): r for r in mixing.mix(docs).collect()}
    rows = mixing.mix(docs, whole=True).collect()
    assert all(r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0 for r in rows)
    for source in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == source]
        more = round(mine[0]["target"] - mine[0]["repeats"] * mine[0]["source_size"])
        first = [r for r in mine if r["before"] + r["size"] <= more]
        gap = more - sum(r["size"] for r in first)
        rest = sorted(r["size"] for r in mine if r["before"] + r["size"] > more and r["size"])
        for turn in range(mixing.FILL):
            fits = [x for x in rest if (abs(x - gap) <= gap and gap > 0 if turn == mixing.FILL - 1 else x <= gap)]
            if fits:
                pick = min(fits, key=lambda x: abs(x - gap))
                rest.remove(pick)
                gap -= pick
        assert abs(sum(r["part"] for r in mine) - more) == abs(gap)
        assert all(r["part"] == r["size"] == cut[(source, r["doc_id"])]["part"] for r in first)


def test_first_words(spark):
    d = spark.createDataFrame([("  a  b\tc\n", 2), ("a b", 1), ("x", 5)], "t string, n long")
    assert [r[0] for r in d.select(mixing.first_words(d["t"], d["n"])).collect()] == ["  a  b", "a", "x"]


# --- 8


def test_lm_scores_equal_sql(docs, empty):
    want = {r[0]: r[1:] for r in view(docs).sql(lmscore.SCORE_SQL).fetchall()}
    for common in (lmscore.COMMON, 5):
        for r in lmscore.score(docs, common).collect():
            n, back, s = want[r["doc_id"]]
            assert (r["n_words"], r["n_backed_off"]) == (n, back)
            assert s is None and r["score"] is None or abs(r["score"] - s) < 2e-6
    assert lmscore.score(empty).count() == 0


def test_lm_repeated_ids(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    got = {r[0]: r[1] for r in lmscore.score(d).collect()}
    assert got == {1: 4, None: 2, 2: 0}


# --- 10


def test_licenses_equal_sql(spark, empty):
    lines = [t for _, t in licenses.TEMPLATES]
    texts = [None, "", "nothing here", *lines, *(f"Some prose.\n{t.upper()}\nMore of it." for t in lines), "Released under the MIT Licence!", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "released\tunder the\nMIT License", lines[1] + "\n" + lines[5]]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, "x", "y"), (None, lines[1], "z")], "doc_id long, text string, license string")
    got = sorted(map(tuple, licenses.scan(d).selectExpr("doc_id", "license", "round(dice, 6)", "n_matches").collect()), key=str)
    assert got == sorted(map(tuple, view(d).sql(licenses.scan_sql()).fetchall()), key=str)
    names = {r[0]: r[1] for r in got}
    assert all(names[3 + i] == name for i, (name, _) in enumerate(licenses.TEMPLATES))
    assert licenses.scan(empty).count() == 0


#: Every licence line of the test tables.
LICENCE_LINES = {
    "All rights reserved.": "Proprietary",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
}


def test_licence_lines_of_the_tables(spark):
    d = spark.createDataFrame([(line, f"Prose stands here, and goes on for many more words than a notice has.\n{line}\nAnd here is some more of it, and no licence at all.") for line in LICENCE_LINES], "doc_id string, text string")
    assert {r["doc_id"]: (r["license"], r["dice"], r["n_matches"]) for r in licenses.scan(d).collect()} == {line: (name, 1.0, 1) for line, name in LICENCE_LINES.items()}
    if os.path.isdir(SF):
        rows = spark.read.parquet(f"{SF}/documents.parquet").where("text rlike '(?i)licen[sc]e|all rights'")
        texts = {r["doc_id"]: r["text"] for r in rows.collect()}
        for r in licenses.scan(rows).collect():
            assert r["license"] in {name for line, name in LICENCE_LINES.items() if line in texts[r["doc_id"]].split("\n")}
        assert {t.strip() for x in texts.values() for t in x.split("\n") if re.search("(?i)licen[sc]e|all rights", t)} <= set(LICENCE_LINES)


def best_window(text, t=licenses.THRESHOLD):
    """The best Dice of any window of words with any template, by brute force."""
    have = licenses.bigrams(text)
    best = (0.0, "")
    for name, template in licenses.TEMPLATES:
        want = Counter(licenses.bigrams(template))
        held = np.concatenate([[0], np.cumsum([b in want for b in have])])
        for n in licenses.allowed_sizes(want.total(), t):
            # windows that hold too few of the template's bigrams to reach the threshold are left out
            for i in np.flatnonzero(2 * (held[n:] - held[:-n]) >= t * (n + want.total()) - 1e-6):
                dice = 2 * (Counter(have[i : i + n]) & want).total() / (n + want.total())
                best = min(best, (-dice, name)) if dice >= t else best
    return (best[1], -best[0]) if best[1] else (None, None)


def test_licence_windows(spark, empty):
    rnd = random.Random(5)
    prose = lambda n: " ".join(rnd.choice("this work is under the license of a public garden released by all who may version it 3 0 rights".split()) for _ in range(n))
    texts = []
    for _, t in licenses.TEMPLATES:
        ws = t.split()
        for k in range(4):
            changed = [w for w in ws if rnd.random() > 0.05 * k]
            changed.insert(rnd.randrange(len(changed) + 1), "garden") if k > 1 else None
            cut = rnd.randrange(len(changed) + 1)
            texts.append(f"{prose(60)} {' '.join(changed[:cut])}\n{' '.join(changed[cut:])} {prose(60)}")
    texts += [prose(n) for n in (1, 30, 300)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(d, windows=True).collect():
        name, dice = best_window(texts[r["doc_id"]] or "")
        assert (r["license"], r["dice"]) == (name, pytest.approx(dice) if dice else None), texts[r["doc_id"]]
        assert (r["n_matches"] > 0) == (name is not None)
    wrapped = "This work is licensed under the GNU General\nPublic License, version 3."
    cases = {
        f"{prose(40)}\n{wrapped}\n{prose(40)}": ("GPL-3.0", 1),
        f"Words of ours, which are many and go on. Released under the MIT License. {prose(30)}": ("MIT", 1),
        "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.": ("CC-BY-NC-4.0", 2),
        f"{prose(40)}\nReleased under the MIT License.\n{prose(40)} Licensed under the Apache License, Version 2.0. {prose(9)}": ("Apache-2.0", 2),
        f"{prose(40)}\nReleased under the MIT License.\n{prose(40)}": ("MIT", 1),
    }
    d = spark.createDataFrame([(t, t) for t in cases] + [(None, f"{wrapped} {prose(40)}"), (None, "x")], "doc_id string, text string")
    got = {r["doc_id"]: (r["license"], r["n_matches"]) for r in licenses.scan(d, windows=True).collect()}
    assert got == cases | {None: ("GPL-3.0", 1)}
    assert licenses.scan(empty, windows=True).count() == 0


# --- 1


def toxic_rows(n=1500, seed=2):
    rnd = random.Random(seed)
    plain = [f"word{i}" for i in range(400)]
    bad = ["idiot", "scum", "zorgle", "blarf", "kwatsch"]
    docs, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.15
        ws = [rnd.choice(plain) for _ in range(rnd.choice([15, 60, 200]))]
        if toxic:
            for _ in range(rnd.choice([2, 4, 6])):
                ws.insert(rnd.randrange(len(ws)), rnd.choice(bad))
        docs.append((i, " ".join(ws)))
        if i % 3:
            labels.append((i, 1, int(toxic) if rnd.random() > 0.03 else 1 - int(toxic)))
    truth = {i: any(b in t.split() for b in bad) for i, t in docs}
    return docs, labels, truth


def test_toxicity(spark):
    rows, labels, truth = toxic_rows()
    d = spark.createDataFrame([(i, t, "score") for i, t in rows] + [(9001, None, ""), (9002, "", ""), (None, "a", "")], "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab)
    assert "zorgle" in model.words
    got = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    assert len(got) == len(rows) + 3
    right = [got[i]["predicted"] == int(t) for i, t in truth.items() if got[i]["held_out"]]
    assert np.mean(right) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert got[9001]["score"] == got[9002]["score"] < 0.5 and all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())


def test_toxicity_gathers_a_row_for_each_label(spark):
    """However often a doc_id repeats, the model sees one text of it."""
    docs, labels, _ = toxic_rows(300)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    many = toxicity.fit(spark.createDataFrame(docs * 5, "doc_id long, text string"), labels)
    assert once.words == many.words and np.allclose(once.weights, many.weights, atol=1e-6)


def test_toxicity_learns_from_no_held_out_row(spark):
    rows, labels, _ = toxic_rows(600)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    a = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    b = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    m, n = toxicity.fit(d, a), toxicity.fit(d, b)
    assert m.words == n.words and np.allclose(m.weights, n.weights)


def test_toxicity_without_labels(spark, empty):
    d = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r["predicted"] for r in sorted(toxicity.score(d, model).collect())] == [1, 0]
    assert toxicity.score(empty, model).count() == 0
