"""Operators 11 to 13 against SQL, brute force and exact formulas; then the awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import decontaminate, divergence, filteraudit
from quire.llm.wordscan import ALPHANUMERICS, LETTERS, Words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_word_scan_finds_words(texts):
    column = pa.array(texts, pa.string())
    for fold, pattern in ((ALPHANUMERICS, ALNUM), (LETTERS, TERM)):
        scan = Words(column, fold)
        want = [words_of(t, pattern) for t in texts]
        every = [w for ws in want for w in ws]
        n = np.arange(len(scan))
        assert scan.joined(n, n + 1).to_pylist() == every
        assert np.diff(scan.first).tolist() == [len(w) for w in want]
        same = defaultdict(set)
        for word, code in zip(every, scan.hashes().tolist(), strict=True):
            same[word].add(code)
        assert all(len(v) == 1 for v in same.values()) and len(set.union(set(), *same.values())) == len(same)


def test_word_hash_of_long_words_does_not_depend_on_place():
    long = "ab" * 100_000
    scan = Words(pa.array([long, "x " + long + " y", long + "c"]), LETTERS)
    a, _, b, _, c = scan.hashes().tolist()
    assert a == b != c


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), max_size=60), st.integers(0, 3))
def test_sorted_words(words, deepest):
    words = words + [w * 6 for w in words]
    old, divergence.DEEPEST = divergence.DEEPEST, deepest or 16
    try:
        scan = Words(pa.array([" ".join(words)]), LETTERS)
        order, first = divergence.sorted_words(scan)
    finally:
        divergence.DEEPEST = old
    got = [words[i] for i in order]
    assert got == sorted(words)
    assert [got[i] for i in first] == sorted(set(words))


def brute_shapley(v, n):
    out = []
    for i in range(n):
        total = 0
        for order in permutations(range(n)):
            before = sum(1 << k for k in order[: order.index(i)])
            total += v[before | 1 << i] - v[before]
        out.append(total)
    return out


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_shapley_coefficients_against_all_orders(n):
    rng = random.Random(n)
    for _ in range(20):
        v = [0] + [rng.randrange(1000) for _ in range((1 << n) - 1)]
        got = [sum(c * x for c, x in zip(row, v, strict=True)) for row in filteraudit.shapley_coefficients(n)]
        assert got == brute_shapley(v, n)
        assert Fraction(sum(got), factorial(n)) == v[-1]


def audit_by_hand(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    text = lambda r: r[1] or ""
    fails = []
    for r in rows:
        t = text(r)
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        caps = sum("A" <= c <= "Z" for c in t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * caps > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = r[0] is not None and any(o[0] is not None and o[0] < r[0] and text(o) == t for o in rows)
        fails.append((r[2] or "", f, r[0]))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [(f, d) for p, f, d in fails if p == part]
        removed_of = Counter()
        for order in permutations("ABCDE"):
            kept = own
            for step, x in enumerate(order, 1):
                gone = [(f, d) for f, d in kept if f[x]]
                kept = [(f, d) for f, d in kept if not f[x]]
                removed_of[x] += len(gone)
                failing = sum(f[x] for f, _ in own)
                lone = sum(f[x] and sum(f.values()) == 1 for f, _ in own)
                out[part, "".join(order), step] = [len(kept), len(gone), failing - len(gone), lone, sum(d in good for _, d in gone), sum(d in toxic for _, d in gone), x]
        for key, value in out.items():
            if key[0] == part:
                value[-1] = removed_of[value[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_of_odd_rows(spark, odd_docs):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    long = " ".join(f"w{i}" for i in range(250))
    rows += [(100 + i, rng.choice([long, long + " #", long.upper(), "a b", "a a a", None]), rng.choice([None, "s", "t"])) for i in range(60)]
    rows += [(None, long, "s"), (None, long, "t"), (100, long, "s"), (7, "1234 !!", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 160, 2), 100, None, None]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "2 AS n", "3 AS good", "'x' AS part", "4 AS digest")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filteraudit.audit(docs, frame).collect()}
    known = {d for d, *_ in labels if d is not None}
    assert got == audit_by_hand(rows, [x for x in labels if x[0] in known])
    assert filteraudit.audit(docs.limit(0), frame).count() == 0
    assert filteraudit.audit(docs, frame.limit(0)).where("good_lost > 0 or toxic_lost > 0").count() == 0


def divergence_by_hand(rows, least):
    docs = [(lang or "", source or "", words_of(text, TERM)) for text, lang, source in rows]
    out = {}
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        count = defaultdict(Counter)
        for _, source, terms in own:
            count[source].update(t for t in terms if t in kept)
            count[None].update(t for t in terms if t in kept)
        share = lambda s, t: 1 + 10**9 * (count[s][t] + 2) // (sum(count[s].values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        sources = {d[1] for d in own}
        for s in sources:
            pairs = [(o, sum(f(share(s, t), share(o, t)) for t in kept)) for o in sources if o != s]
            terms = [(t, f(share(s, t), share(None, t))) for t in kept if count[s][t] and share(s, t) > share(None, t)]
            for part, rows_, cap in (("pair", pairs, None), ("term", terms, 10)):
                for rank, (item, value) in enumerate(sorted(rows_, key=lambda x: (-x[1], x[0].encode()))[:cap], 1):
                    out[lang, s, part, item] = (value, rank)
    return out


def test_divergence_of_odd_rows(spark, odd_docs, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["ab", "abcdefgh", "abcdefghi", "abcdefghij" * 40, "abcdefghij" * 40 + "k", "é", "漢字", "Zed", "zed"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(r.text, r.lang, None if r.n_lines is None else str(r.n_lines)) for r in odd_docs.collect()]
    rows += [(" ".join(rng.choices(vocabulary, k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for _ in range(150)]
    rows += [("only here", "xx", "a"), (None, "xx", "b"), ("1 2 3", "xx", "c"), ("alone", "yy", "z")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "3 AS p", "4 AS tile", "5 AS docs")
    want = divergence_by_hand(rows, 10)
    assert {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in divergence.divergence(docs).collect()} == want
    monkeypatch.setattr(divergence, "CELLS", 8)  # many tiles
    assert {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in divergence.divergence(docs).collect()} == want
    assert divergence.divergence(docs.limit(0)).count() == 0


def contaminated_by_hand(docs, items, width):
    found = defaultdict(set)
    for item, text in items:
        w = words_of(text, ALNUM)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            found[tuple(w[i : i + width])].add(item)
    sizes = {len(w) for w in found}
    out = []
    for doc, text in docs:
        w = words_of(text, ALNUM)
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in found:
                    hit.update(range(i, i + n))
                    ids |= found[key]
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("width", "bits"), [(10, 24), (7, 24), (10, 8)])
def test_contamination_of_odd_rows(spark, odd_docs, width, bits, monkeypatch):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)  # a full table finds the same
    rng = random.Random(width + bits)
    items = [(i, " ".join(rng.choices("abcde", k=rng.randrange(1, 40)))) for i in range(25)]
    items += [(40, "Alpha, beta! GAMMA delta"), (41, "ÉTÉ naïve café 漢字"), (42, None), (43, " .. "), (44, items[3][1]), (3, items[3][1]), (None, "x1 y2 z3"), (45, "the end " * 9)]
    passages = [t for _, t in items if t]
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for i in range(60):
        parts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(12))) for _ in range(3)]
        docs.append((100 + i, "; ".join([parts[0], rng.choice(passages), parts[1], rng.choice(passages).upper(), parts[2]])))
    docs += [(100, "repeated id " + passages[0]), (None, passages[5]), (None, passages[5]), (300, "(alpha) beta gamma delta"), (301, "lalpha beta gamma delta")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS words", "3 AS item_id", "4 AS hits")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS words", "2 AS start")
    got = [tuple(r) for r in decontaminate.contaminated(frame, bench, width).collect()]
    assert sorted(got, key=repr) == contaminated_by_hand(docs, items, width)


def test_contamination_of_empty_tables(spark, odd_docs):
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert decontaminate.contaminated(odd_docs.limit(0), bench).count() == 0
    got = decontaminate.contaminated(odd_docs, bench.limit(0))
    assert got.count() == 12 and got.where("contaminated or n_hit > 0 or n_items > 0").count() == 0
