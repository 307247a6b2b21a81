"""Every operator against a brute-force version, an exact round trip or held-out accuracy; then the awkward tables."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import bpe, embed, exact, graph, hpylm, langid, linededup, packing, pii, queries, simhash, tokencount
from tools.check import compare, connect


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return docs.orderBy("doc_id").toPandas()


def reference_encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf).toArrow(), connect(sf).execute(queries.SQL[name]).to_arrow_table()) is None


def test_exact_groups_of_odd_rows(odd_docs):
    got = exact.exact_groups(odd_docs).toPandas()
    assert len(got) == 12
    by = {r.doc_id: r for r in got.itertuples()}
    assert by[5].keep_id == 0 and by[5].group_size == 4 and not by[5].kept
    assert by[3].keep_id == 2 and by[3].group_size == 2
    assert by[4].text_sha256 == hashlib.sha256(b" ").hexdigest()


def test_exact_groups_without_ids(spark):
    """A missing doc_id beside every salt hides no smaller doc_id, and no group is lost."""
    rows = [(None, "a  b")] * 5 + [(i, "a b") for i in range(40, 140)] + [(40, "a b"), (None, "only"), (None, "only"), (7, "x"), (7, "x"), (None, None), (8, " ")]
    frame = spark.createDataFrame([(*r, i, "s") for i, r in enumerate(rows)], "doc_id long, text string, row int, _salt string")
    for salts in (1, 7, None):
        got = exact.exact_groups(frame, salts).toPandas()
        big = got[got["group_size"] == 106]
        assert len(big) == 106 and (big["keep_id"] == 40).all() and big["kept"].sum() == 2 and (big.loc[big["kept"], "doc_id"] == 40).all()
        assert got.loc[got["doc_id"] == 7, "kept"].all() and got[got["keep_id"].isna()]["kept"].sum() == 2
    kept = exact.drop_copies(frame)
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), re.sub(" +", " ", r.text or "")) for r in kept.collect()) == [("40", "a b"), ("7", "x"), ("8", " "), ("None", ""), ("None", "only")]


def test_near_copies_without_ids_keep_one_row(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (5, text + " "), (5, text), (None, "quite another text without an id"), (None, "quite another text without an id"), (1, "")]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _n int")
    kept = simhash.drop_near_copies(frame)
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), r.text.strip()) for r in kept.collect()) == [("1", ""), ("5", text), ("None", "quite another text without an id")]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (601, 600)], "a long, b long")
    got = {r.id: r.component for r in graph.components(links).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[500] == 500 and got[601] == 600


def test_tile_pairs_against_double_precision():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 1500))
    near = x[:150] + rng.normal(size=(150, 1500)) * rng.uniform(0.3, 0.6, (150, 1))
    y = np.concatenate([near, rng.normal(size=(50, 1500)) * 1e-30])
    unit = lambda m: m / np.abs(m).max(1, keepdims=True)
    a, b = unit(x), unit(y)
    cosine = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    want = {tuple(p) for p in np.argwhere(cosine >= 0.9)}
    assert want and {*zip(*(k.tolist() for k in embed.tile_pairs(x, y)), strict=True)} == want


def test_linked_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    rows = [(i, [float(v) for v in base[i % 40] + rng.normal(size=8) * 0.2 * (i % 3)]) for i in range(240)]
    rows += [(300, None), (301, [0.0] * 8), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (305, [1.0, 2.0])]
    rows += [(400 + i, rows[0][1]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("links", F.lit("clash"))
    got = {r.vec_id: r for r in embed.linked(frame, tile=64).collect()}
    good = {i: np.array(v, "f4").astype("f8") for i, v in rows if i < 300 or i >= 400}
    ids = sorted(good)
    m = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = (m @ m.T >= 0.9) & ~np.eye(len(ids), dtype=bool)
    label = np.array(ids)
    for _ in ids:
        label = np.minimum(label, np.where(near, label, 10**6).min(axis=1))
    assert len(got) == len(rows)
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id) == (near[k].sum(), label[k])
    assert all(got[i].n_links == 0 and got[i].kept for i in range(300, 306))
    assert embed.linked(frame.limit(0)).count() == 0


def test_seating_matches_the_full_conditional():
    rng = np.random.default_rng(3)
    tables = hpylm.seated(np.full(40_000, 4), np.full(40_000, 1.5), 2, rng)
    d, weight = hpylm.DISCOUNT[2], Counter()

    def seat(sizes, w):  # all seatings of four customers
        if sum(sizes) == 4:
            weight[len(sizes)] += w
            return
        seat((*sizes, 1), w * 1.5)
        for k, n in enumerate(sizes):
            seat((*sizes[:k], n + 1, *sizes[k + 1 :]), w * (n - d))

    seat((1,), 1.5)
    for t, w in weight.items():
        assert abs((tables == t).mean() - w / sum(weight.values())) < 0.02
    large = hpylm.seated(np.array([1000]), np.array([5.0]), 1, rng)
    assert 1 <= large[0] <= 1000


def test_predictions_add_up_to_one():
    rng = np.random.default_rng(4)
    word, context = rng.integers(0, 50, 5000) ** 2 // 50, rng.integers(0, 40, 5000) * 7
    key, n = np.unique(word * hpylm.CONTEXTS + context, return_counts=True)
    state = hpylm.Restaurants(50, key, n)
    base = 1 / 51
    for state in hpylm.chain(state, state.totals(), base, 0, 2, 2):  # noqa: B020
        totals = state.totals()
        for c in (0, 7, 8000):
            known = state.predict(totals, base, np.arange(50), np.full(50, c)).sum()
            unseen = hpylm.Restaurants(1, key[:0], n[:0])
            assert abs(known + unseen.predict(totals, base, np.zeros(1, int), np.array([c]))[0] - 1) < 1e-9


def test_language_model_scores(spark, sf, docs, local, odd_docs):
    got = hpylm.scored(docs).orderBy("doc_id").toPandas()
    tokens = [hpylm.words_of(t) for t in local["text"]]
    held = np.array([zlib.crc32(str(i).encode()) % 7 == 2 for i in local["doc_id"]])
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    assert (got["held_out"] == held).all() and (got["train_tokens"] == n).all()
    assert (got["n_tokens"] == [len(t) for t in tokens]).all()
    assert (got["n_known"] == [sum(counts[w] > 0 for w in t) for t in tokens]).all()
    assert np.allclose(got["base_score"], [sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in t) for t in tokens])
    assert got["score"][held].sum() > got["base_score"][held].sum()
    again = hpylm.scored(docs).orderBy("doc_id").toPandas()
    assert np.allclose(got["score"], again["score"])
    odd = hpylm.scored(odd_docs).toPandas()
    assert len(odd) == 12 and np.isfinite(odd["score"]).all() and odd["doc_id"].isna().sum() == 1
    assert hpylm.scored(odd_docs.limit(0)).count() == 0


def test_every_word_has_its_own_restaurant(spark):
    """Words with the same end, frequent or rare, tell apart what follows them."""
    rows = [(i, " ".join(f"{w}{k}suffix after{w}{k}" for w in "pq" for k in ("", f"x{i % 40}"))) for i in range(240)]
    held = [i for i in range(1000, 9000) if hpylm.is_held(i)]
    pairs = [(w, v, k) for k in ("", "x3", "x17") for w in "pq" for v in "pq"]
    rows += [(i, f"{w}{k}suffix after{v}{k}") for i, (w, v, k) in zip(held, pairs, strict=False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in hpylm.scored(frame).collect()}
    score = {x: got[i].score for i, x in zip(held, pairs, strict=False)}
    assert all(got[i].n_known == 3 for i, _ in zip(held, pairs, strict=False))
    for w, v, k in pairs:
        if w != v:
            assert score[w, w, k] > score[w, v, k] + 0.5


def test_language_model_leaves_no_token_cells_and_one_worker_a_task(odd_docs, tmp_path, monkeypatch):
    """Tokens that buckets have are not kept twice, and no task of the last stage feeds one Python worker from another."""
    monkeypatch.setattr("quire.llm.common.shared_root", lambda _: str(tmp_path))
    out = hpylm.scored(odd_docs)
    (tokens,) = tmp_path.glob("quire-lm-tokens-*")
    assert {x.name for x in tokens.glob("kind=*")} == {"kind=d", "kind=h"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow score_rare" in plan and not re.search(r"MapInArrow[^\n]*\n[^\n]*FlatMapGroupsInArrow", plan)
    assert out.count() == 12


def test_predictions_behind_rare_words_add_up_to_one():
    rng = np.random.default_rng(5)
    key, n = np.unique(rng.integers(0, 20, 400) * 30 + rng.integers(0, 30, 400) ** 2 // 30, return_counts=True)
    root = rng.random((hpylm.SAMPLES, 30))
    root /= root.sum(axis=1, keepdims=True)
    got = hpylm.behind_rare(21, 30, key, n, root, 0, np.arange(21 * 30)).reshape(21, 30)
    assert np.allclose(got.sum(axis=1), 1) and np.allclose(got[20], root.mean(axis=0))


def test_heavy_words_anywhere(spark):
    """Frequent only behind the beginning of long texts, or only in the last of many rows."""
    code = lambda w: xxhash.xxh3_64_intdigest(w)
    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    deep = [(k, own(k, 900) + " hot" * 500) for k in range(4)]
    late = [(k, own(k, 3)) for k in range(2500)] + [(2500 + k, "hot " * 400) for k in range(20)]
    for rows in (deep, late):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        counts = Counter(w for _, t in rows for w in hpylm.words_of(t))
        n = sum(counts.values())
        want = {code(w) for w, c in counts.items() if c * hpylm.HEAVY > n}
        assert code(b"hot") in want and set(hpylm.heavy_words(frame).tolist()) == want


def test_byte_pairs_round_trip(docs, local, odd_docs):
    encoding = reference_encoding()
    for frame, rows in ((docs, local), (odd_docs, odd_docs.toPandas())):
        got = bpe.round_trip(frame).toPandas()
        want = Counter()
        for i, text in zip(rows["doc_id"], rows["text"], strict=True):
            ids = encoding.encode_ordinary(text or "")
            want[str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
        assert Counter((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.itertuples()) == want
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_pieces_of_all_kinds():
    encoding = reference_encoding()
    texts = ["don't  stop\n\n\n now", "a" * 700, " " * 500 + "x", "it's wide\x85 \xa0 ½²ª", "<|endoftext|>", "漢字かな 🙂", "ʯʰ\x1c\x1d"]
    ids, counts = bpe.memo().documents(texts)
    want = [encoding.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_token_counts(spark, docs, local, odd_docs, tmp_path):
    encoding = reference_encoding()
    got = tokencount.document_token_counts(docs).toPandas().set_index("doc_id")["n_tokens"]
    assert got.to_dict() == {i: len(encoding.encode_ordinary(t)) for i, t in zip(local["doc_id"], local["text"], strict=True)}
    assert tokencount.document_token_counts(odd_docs).count() == 12
    assert tokencount.document_token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_separator_blocks(block):
    tokens = np.array([7, 7, 1, 9, 9, 9, 9, 9, 9, 9, 1, 1, 3], "<u2")
    counts, tail = tokencount.scan_block_counts(tokens, 1, block)
    assert counts.tolist() == [2, 7, 0] and tail == 1


def test_documents_over_several_files(spark, tmp_path):
    """One stream in three files: a document begins in the first, runs through the second and ends in the third."""
    for k, ids in enumerate(([5, 5, 0, 6], [6, 6], [6, 0, 7, 7])):
        (tmp_path / f"part-00003-x-c00{k}.txt").write_bytes(np.array(ids, "<u4").tobytes())
    got = tokencount.token_counts(spark, str(tmp_path), width=4, end=0).orderBy("ordinal").collect()
    assert [(r.ordinal, r.start, r.n_tokens) for r in got] == [(0, 0, 2), (1, 3, 4), (2, 8, 2)]

def test_long_pieces():
    encoding, rng = reference_encoding(), np.random.default_rng(5)
    texts = ["a" * 20_001, "international" * 900, " " * 5000, "=-" * 4000, "é" * 3000]
    texts += ["".join(rng.choice(list(letters), n)) for letters in ("ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz") for n in (bpe.LONG, bpe.LONG + 1, 6000)]
    ids, counts = bpe.Memo(bpe.memo().encode).documents(texts)
    want = [encoding.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def luhn(number):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", number))]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def test_pseudonyms(spark):
    texts = {
        "card": ["pay 4111 1111 1111 1111 now", "or 4111-1111-1111-1111.", "4111111111111112 is none"],
        "ip": ["from 10.200.3.4, twice 10.200.3.4", "not 300.1.1.1 or 1.2.3.4.5"],
        "date": ["born 1984-02-29", "born 29.02.1984", "no 1983-02-29 and 31/04/2001"],
        "ssn": ["id 123-45-6789", "no 666-45-6789 or 123-00-6789"],
        "phone": ["call +1 (743) 555-3824", "or +1 743 555 3824"],
        "email": ["mail Ann.Lee@mail5.example.com!", "mail ann.lee@MAIL5.example.com"],
    }
    rows = [(k * 10 + i, t) for k, ts in enumerate(texts.values()) for i, t in enumerate(ts)] + [(90, None), (91, ""), (92, "year 1999, page 12, 3.14")]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kinds", F.lit(1))).collect()}
    before = dict(rows)
    find = lambda p, i: re.search(p, got[i].text).group()
    cards = find(r"\d{4}( \d{4}){3}", 0), find(r"\d{4}(-\d{4}){3}", 1)
    assert luhn(cards[0]) and re.sub(r"\D", "", cards[0]) == re.sub(r"\D", "", cards[1]) != "4111111111111111"
    ips = re.findall(r"[\d.]+\d", got[10].text)
    assert ips[0] == ips[1] != "10.200.3.4" and all(int(x) < 256 for x in ips[0].split("."))
    day = find(r"\d{4}-\d\d-\d\d", 20)
    assert "-".join(reversed(find(r"\d\d\.\d\d\.\d{4}", 21).split("."))) == day != "1984-02-29"
    assert find(r"\d{3}-\d\d-\d{4}", 30) != "123-45-6789"
    assert re.sub(r"\D", "", got[40].text) == re.sub(r"\D", "", got[41].text) != "17435553824"
    assert "example" not in got[50].text and got[50].text.strip("!") == got[51].text
    for i in (2, 11, 22, 31, 90, 91, 92):
        assert got[i].text == before[i] and got[i].n_found == 0
    assert got[10].n_found == 2 and got[10].kinds == {"ip": 2}


def test_pseudonyms_beside_other_digits(spark):
    cases = [
        ("4111 1111 1111 1111 123", "4111 1111 1111 1111", "card", " 123"),
        ("4111111111111111 12/27", "4111111111111111", "card", " 12/27"),
        ("qty 2 4111111111111111", "4111111111111111", "card", "qty 2 "),
        ("99 98 97 96 95 4111 1111 1111 1111", "4111 1111 1111 1111", "card", "99 98 97 96 95 "),
        ("4111111111111111-2", "4111111111111111", "card", "-2"),
        ("call 555-123-4567", "555-123-4567", "phone", "call "),
        ("212 555 0100.", "212 555 0100", "phone", "."),
        ("1-800-555-0100", "800-555-0100", "phone", "1-"),
        ("+33 1 23 45 67 89", "1 23 45 67 89", "phone", "+"),
        ("1984-02-29T10:15:00Z", "1984-02-29", "date", "T10:15:00Z"),
        ("1984-02-29-10:15", "1984-02-29", "date", "-10:15"),
        ("29.02.1984T10:15", "29.02.1984", "date", "T10:15"),
    ]
    texts = [c[0] for c in cases] + ["4111111111111111 123-45-6789", "4111111111111111 4242424242424242 212-555-0100", "1 " * 5 + "2 " * 5_000, "9" * 300_000, "1984-02-29-1985-03-01"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r for r in pii.pseudonymised(frame).orderBy("doc_id").collect()]
    for r, (text, value, kind, rest) in zip(got, cases, strict=False):
        assert r.n_found == 1 and r.kinds == {kind: 1} and len(r.text) == len(text), text
        assert value not in r.text and rest in r.text, text
        if kind == "card":
            assert luhn(r.text[text.index(value) :][: len(value)])
    assert [got[k].kinds for k in (12, 13, 16)] == [{"card": 1, "ssn": 1}, {"card": 2, "phone": 1}, {"date": 2}]
    assert len({re.sub(r"\D", "", r.text)[:16] for r in got[12:14]}) == 1
    assert len(got[14].text) == len(texts[14]) and got[15].text == texts[15]


def test_pseudonyms_in_very_long_runs(spark):
    """Unbroken letters, endless domains, and addresses that touch: linear time, nothing overlooked."""
    texts = ["a" * 300_000 + " 5", "x@" + "a." * 20_000 + "5", "1.2." * 20_000, "a@b.com-c@d.org, e@f.net", "." * 50_000 + "a.b@c.example.org..."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(frame).collect()}
    assert [got[i].text == t for i, t in enumerate(texts)] == [True, True, True, False, False]
    assert got[3].n_found == 3 and re.fullmatch(r"u\w{32}@mail\.invalidu\w{32}@mail\.invalid, u\w{32}@mail\.invalid", got[3].text)
    assert got[4].n_found == 1 and got[4].text.endswith("@mail.invalid...")


def test_pseudonym_keys(spark):
    """Another key gives other values; the session's key is set or drawn once, and never a constant of the source."""
    frame = spark.createDataFrame([(1, "4111 1111 1111 1111, a@b.com")], "doc_id long, text string")
    one, two = (pii.pseudonymised(frame, key).first().text for key in ("one", "two"))
    assert one != two and one == pii.pseudonymised(frame, "one").first().text
    other = spark.newSession()
    assert pii.session_key(other) == pii.session_key(other) != pii.session_key(spark.newSession())
    other.conf.set(pii.KEY_SETTING, "one")
    assert pii.pseudonymised(other.createDataFrame(frame.toArrow())).first().text == one


def test_pseudonyms_of_clashing_columns_and_empty_tables(spark):
    """Own columns named like the working ones stay as they are; a table without rows gives none."""
    frame = spark.createDataFrame([(1, "id 123-45-6789", 7, "new", "x", "n")], "doc_id long, text string, _found int, _New string, _kinds string, n_found string")
    out = pii.pseudonymised(frame)
    got = out.first()
    assert out.columns == ["doc_id", "text", "_found", "_New", "_kinds", "n_found", "kinds"]
    assert (got["_found"], got["_New"], got["_kinds"], got.n_found, got.kinds) == (7, "new", "x", 1, {"ssn": 1})
    assert pii.pseudonymised(frame.limit(0)).collect() == []


def test_feistel_is_one_to_one(spark):
    frame = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("n"))
    assert frame.select(pii.permuted_digits(F.col("n"), "t", "k").alias("p")).where("length(p) = 3").distinct().count() == 1000
    days = spark.range(0, 71589, 7).select(F.date_format(F.date_add(F.lit("1901-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    made = days.select(pii.pseudonym(F.col("d"), "k").alias("p"))
    assert made.distinct().count() == days.count() == made.where(F.col("p").cast("date").isNotNull()).count()


def test_close_pairs_against_all_distances():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 700, dtype=np.uint64)
    for k in range(300):
        fps[400 + k] = fps[k] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 1 + k % 4).astype(np.uint64))
    for radius in (1, 2, 3, 5):
        i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= radius, 1))
        assert {*zip(*(x.tolist() for x in simhash.close_pairs(fps, radius)), strict=True)} == {*zip(i.tolist(), j.tolist(), strict=True)}


def test_simhash_groups(docs, local, odd_docs):
    for frame, rows in ((docs, local), (odd_docs, odd_docs.toPandas())):
        got = simhash.near_groups(frame).toPandas().sort_values(["doc_id", "fingerprint"])
        fps = {}
        for i, text in zip(rows["doc_id"], rows["text"], strict=True):
            words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower() if (text or "").isascii() else (text or "").encode().translate(simhash.LOWER))
            shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
            hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
            fps[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes[:5000]) * 2 > len(hashes[:5000])) if len(hashes) <= 5000 else None
        own = {r.doc_id: int(r.fingerprint, 16) for r in got.itertuples()}
        assert all(own[i] == f for i, f in fps.items() if f is not None and i == i)
        ids = [i for i in own if i == i]
        label = {i: i for i in ids}
        for _ in range(6):
            label = {i: min(label[j] for j in ids if (own[i] ^ own[j]).bit_count() <= 2) for i in ids}
        assert all(r.component_id == label[r.doc_id] for r in got.itertuples() if r.doc_id == r.doc_id)
        assert len(got) == len(rows)
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_simhash_of_near_copies_without_id(spark):
    rng = np.random.default_rng(12)
    for _ in range(50):
        base = [f"w{k}" for k in rng.integers(0, 5000, 600)]
        texts = [" ".join(base), " ".join([*base[:300], "other", *base[301:]]), " ".join([*base[:500], "more", *base[501:]])]
        fps = [simhash.fingerprint(simhash.shingle_hashes(t)) for t in texts]
        if len({*fps}) == 3 and all((fps[0] ^ f).bit_count() <= 2 for f in fps[1:]):
            break
    else:
        raise AssertionError("no near copies drawn")
    alone = " ".join(f"v{k}" for k in range(600))
    for ids in ((7, None, 3), (None, 5, 9), (5, None, None), (None, None, None)):
        rows = [*zip(ids, texts, strict=True), (None, alone), (20, "one more text")]
        got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        low = min((i for i in ids if i is not None), default=None)
        hexes = [f"{f:016x}" for f in fps]
        assert sorted((r.fingerprint, str(r.doc_id)) for r in got if r.fingerprint in hexes) == sorted(zip(hexes, map(str, ids), strict=True))
        assert all(r.component_id == low for r in got if r.fingerprint in hexes)
        assert sorted((str(r.doc_id), str(r.component_id)) for r in got if r.fingerprint not in hexes) == [("20", "20"), ("None", "None")]


def test_hot_simhash_key_is_split(spark):
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 12, 600, dtype=np.int64))  # all equal in the upper blocks
    frame = spark.createDataFrame([(int(k), int(f)) for k, f in enumerate(fps)], "id long, fp long")
    got = {r.id: r.component for r in graph.components(simhash.near_links(frame, tile=50)).collect()}
    label = np.arange(len(fps))
    near = np.bitwise_count(fps.astype(np.uint64)[:, None] ^ fps.astype(np.uint64)[None]) <= 2
    for _ in range(30):
        label = np.array([label[r].min() for r in near])
    assert all(got.get(k, k) == label[k] for k in range(len(fps)))


def test_packing(docs, local, odd_docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    marked = docs.sparkSession.createDataFrame([(0, "a <|endoftext|> b"), (1, "<|endoftext|><|endoftext|>"), (2, "x  <|endoftext|>\ny"), (3, "<|endof"), (None, "z"), (4, None)], "doc_id long, text string")
    for frame, rows in ((docs, local), (odd_docs, odd_docs.toPandas()), (marked, marked.toPandas())):
        got = packing.packed(frame).toPandas()
        want = Counter()
        for i, text in zip(rows["doc_id"], rows["text"], strict=True):
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
            starts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                want[str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        assert Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
        total = 0
        for _, rows_ in got.sort_values("offset").groupby("sequence_id"):
            assert rows_["offset"].tolist() == [0, *rows_["length"].cumsum().tolist()[:-1]] and rows_["length"].sum() <= 1024
            total += 1
        bound = packing.lower_bound(np.bincount(got["length"], minlength=1025))
        assert bound <= total <= bound * 1.005 + 2
        dealt = packing.packed(frame, share=100).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()["n"]
        assert dealt.sum() == got["length"].sum() and dealt.max() <= 1024 and len(dealt) <= bound * 1.05 + 2
    assert packing.packed(docs.limit(0)).count() == 0


def test_lower_bounds_hold():
    rng = np.random.default_rng(8)
    for _ in range(30):
        lengths = rng.integers(1, 1025, rng.integers(1, 60))
        at, offset, used = packing.best_fit_decreasing(lengths)
        assert packing.lower_bound(np.bincount(lengths, minlength=1025)) <= used
        assert np.bincount(at, weights=lengths).max() <= 1024
    assert packing.lower_bound(np.bincount(np.full(9, 513), minlength=1025)) == 9


def kept_lines(rows):
    """Brute force over pairs of distinct lines."""
    first, seen = {}, []
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            words = tuple(line.encode().split())
            if words and i is not None:
                seen.append((i, k, words))
                first[words] = min(first.get(words, (i, k)), (i, k))
    start = dict(first)
    lines = list(first)

    def near(a, b):
        if min(len(a), len(b)) < linededup.MIN_WORDS or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    for x, a in enumerate(lines):
        for b in lines[:x]:
            if near(a, b):
                start[a], start[b] = min(start[a], first[b]), min(start[b], first[a])
    return {(i, k) for i, k, words in seen if (i, k) > start[words]}


def test_one_edit_apart():
    """Against a table of distances, over all short word lists; equal lists are no pair but count as within the bound."""
    lists = [list(x) for n in range(5) for x in itertools.product([b"a", b"b"], repeat=n)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for a in lists:
        for b in lists:
            assert linededup.one_edit_apart(a, b) == (distance(a, b) <= 1)


def test_line_dedup_drops_pairs_whose_words_differ(spark):
    """A false partner, as equal hashes would give one, does not pass."""
    rows = [(1, "a b c d e f"), (2, "a b c d e g"), (3, "u v w x y z")]
    ids = spark.createDataFrame(rows, "doc_id long, text string")
    seen = linededup.occurrences(ids)
    distinct = seen.select("k1", "k2", F.struct("doc_id", "line").alias("first"))
    first = seen.where("doc_id = 1").select(F.struct("doc_id", "line", "k1", "k2").alias("near"))
    nearest = seen.where("doc_id > 1").select("k1", "k2").crossJoin(first)
    got = linededup.verified(nearest, distinct, ids).join(seen, ["k1", "k2"]).collect()
    assert [r.doc_id for r in got] == [2]


def test_line_dedup(spark, odd_docs):
    rng = np.random.default_rng(9)
    word = [f"w{k}" for k in range(6)]
    rows = [(i, "\n".join(" ".join(rng.choice(word, rng.integers(0, 9))) for _ in range(6))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("line", "_doc", "_dropped", "k1", "_c0", "a`b")})
    got = {r.doc_id: r for r in linededup.deduplicated(frame).collect()}
    cut = kept_lines(rows)
    for i, text in rows:
        want = [x for k, x in enumerate(text.split("\n")) if (i, k) not in cut]
        assert got[i].text == "\n".join(want) and got[i].n_dropped == 6 - len(want) and got[i].line == "clash"
    odd = linededup.deduplicated(odd_docs).toPandas()
    assert len(odd) == 12 and list(odd.columns).count("n_lines") == 1
    assert odd.set_index("doc_id").loc[2, "n_lines"] == 0
    assert linededup.deduplicated(odd_docs.limit(0)).count() == 0


def test_language_gradients():
    rng = np.random.default_rng(10)
    net = langid.Network(["a", "b", "c"], units=3)
    net.w = {k: v.astype("f8") for k, v in net.w.items()}
    windows, truth = rng.integers(0, 256, (4, 7)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, g = net.gradients(windows, truth)
    for name, at in (("u", (0, 1, 4)), ("u", (1, 2, 7)), ("o", (1, 0, 2)), ("b", (1,)), ("x", (0, int(windows[0, 2]), 5)), ("x", (1, int(windows[1, 3]), 1))):
        keep, step, loss = net.w[name][at], 1e-3, []
        for sign in (1, -1):
            net.w[name][at] = keep + sign * step
            loss.append(net.gradients(windows, truth)[0])
        net.w[name][at] = keep
        assert abs((loss[0] - loss[1]) / (2 * step) - g[name][at]) < 1e-3


def test_language_accuracy(docs, local, odd_docs):
    got = langid.languages(docs).toPandas().merge(local[["doc_id", "lang"]], on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()
    odd = langid.languages(odd_docs).toPandas()
    by = {r.doc_id: r for r in odd.itertuples() if r.doc_id == r.doc_id}
    assert len(odd) == 12 and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4, 7))
    numbers = docs.sparkSession.createDataFrame([(1, "½ ² ① Ⅷ"), (2, "a½")], "doc_id long, text string")
    signs = {r.doc_id: r.lang_pred for r in langid.predicted(numbers, langid.Network(["b", "a"])).collect()}
    assert signs == {1: "und", 2: signs[2]} and signs[2] != "und"
    assert langid.languages(odd_docs.limit(0)).count() == 0
    assert langid.languages(odd_docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_pipeline(spark, sf, docs, odd_docs):
    """Each stage against what it should keep of its own input."""
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in now.collect()}, {r.doc_id: r for r in out.collect()}
        if name == "language":
            assert all((i in after) == bool(regex.search(r"\p{L}", r.text)) for i, r in before.items())
        elif name == "exact_dedup":
            groups = {}
            for i in sorted(before):
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i].text), i)
            assert set(after) == set(groups.values())
        elif name == "near_dedup":
            heads = {r.component_id for r in simhash.near_groups(now).collect()}
            assert set(after) == heads
        else:
            assert set(after) == set(before) and any(after[i].text != before[i].text for i in before)
            assert all(len(after[i].text) == after[i].n_chars for i in after if after[i].text != before[i].text)
        now = spark.createDataFrame(out.collect(), docs.schema)
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert set(got["doc_id"]) == {r.doc_id for r in now.collect()}
    odd = odd_docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    marked = odd.union(odd.where("doc_id is null or doc_id = 1"))
    network = langid.train(marked)
    texts = Counter(r.text for r in corpus_pipeline.language_stage(spark, marked, sf).collect())
    kept = langid.labelled(marked, network).where("lang_pred <> 'und'").select("row.*").collect()
    assert texts == Counter(r.text for r in kept) and texts["no identifier here at all"] == 2
    for frame in (odd, odd.limit(0), marked):
        now = frame
        for _, stage in corpus_pipeline.STAGES:
            now = spark.createDataFrame(stage(spark, now, sf).collect(), stage(spark, now, sf).schema)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op6_pii_pseudonyms"])
def test_native_plans_have_no_python(spark, sf, name):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().explainString(mode)
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_queries_are_whole(sf):
    n = duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    assert n and set(queries.SQL) <= set(queries.QUERIES) and len([q for q in queries.QUERIES if q.startswith("op")]) == 13
