"""Toxicity, hard negatives and periodic runs against brute force, and their edge cases."""

import hashlib
import itertools
import math
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonelake.llm import hard_negatives, periodic, toxicity

SF = "/root/testdata/sf0.001"


def split(text):
    return (text or "").encode().split()


# 13: periodic runs


def brute_runs(w, shortest=6, power=4):
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(shortest, power * q):
                if not any(all(w[k] == w[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                    found.append((i, size, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


@pytest.mark.parametrize("shortest,power", [(6, 4), (2, 2), (9, 3)])
def test_runs_against_brute_force(shortest, power):
    rng = np.random.default_rng(power)
    for _ in range(150):
        rows = []
        for _ in range(rng.integers(1, 6)):
            parts = [rng.integers(0, rng.integers(1, 4), rng.integers(1, 7)).tolist() * int(rng.integers(1, 9)) for _ in range(rng.integers(0, 5))]
            rows.append([x for p in parts for x in p])
        number = np.array([x for w in rows for x in w], np.int64)
        row = np.repeat(np.arange(len(rows)), [len(w) for w in rows])
        first = np.cumsum([0] + [len(w) for w in rows])
        found = periodic.find_runs(number, row, shortest, power).tolist()
        for r, w in enumerate(rows):
            assert [(s - first[r], n, q) for k, s, n, q in found if k == r] == brute_runs(w, shortest, power)


def test_large_ordered_sets_stay_ordered():
    rng = np.random.default_rng(0)
    numbers = rng.permutation(5000).tolist()
    held = periodic.Positions(numbers[0])
    for k, x in enumerate(numbers[1:], 1):
        before, behind = held.put(x)
        if k % 500 == 0:
            have = sorted(numbers[: k + 1])
            i = have.index(x)
            assert before == (have[i - 1] if i else -1) and behind == (have[i + 1] if i < k else -1)
    assert list(held) == list(range(5000))


def test_runs_of_odd_rows(spark):
    long = " ".join(["a b c"] * 9000)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "x x x x x"), (5, "x x x x x x y"), (5, "x x x x x x y"), (None, "p é p é p é p é"), (6, long)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, runs string")
    got = defaultdict(list)
    for r in periodic.periodic_runs(docs).collect():
        got[r.doc_id].append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[3] == [(0, [], "")] and got[4] == [(5, [], "x x x x x")]
    assert got[5] == [(7, [(0, 6, 1)], "x y")] * 2 and got[None] == [(8, [(0, 8, 2)], "p é")]
    assert got[6] == [(27_000, [(0, 27_000, 3)], "a b c")]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, power=1)


def test_words_of_one_hash_are_no_repeats(monkeypatch):
    whole = periodic.word_hashes
    monkeypatch.setattr(periodic, "word_hashes", lambda d, s, e, kind=0: whole(d, s, e, kind) % np.uint64(2 if kind == 0 else 1 << 63))
    data = np.frombuffer(b"a b c d a", np.uint8)
    starts = np.arange(0, 9, 2)
    n = periodic.word_numbers(data, starts, starts + 1).tolist()
    assert n[0] == n[4] and len(set(n)) == 4


def test_run_query_against_brute_force(spark):
    got = {r.doc_id: r for r in periodic.op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for r in docs:
        w, h = split(r.text), zlib.crc32(str(r.doc_id).encode())
        if len(w) > 700:  # the plain version takes the square of it
            continue
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
        runs = brute_runs(w)
        x = got[r.doc_id]
        some += bool(runs)
        best = min(runs, key=lambda z: (-Fraction(z[1], z[2]), z[0], z[2])) if runs else (None, None, None)
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(b" ".join(kept_words(w, runs))).hexdigest()
    assert some > 5


# 12: hard negatives


def brute_negatives(rows, is_anchor):
    v = {i: (label, [math.floor(256 * x) for x in e]) for i, label, e in rows}
    out = []
    for a in sorted(x for x in v if is_anchor(x)):
        score = {b: sum(x * y for x, y in zip(v[a][1], v[b][1])) for b in v if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if v[b][0] == v[a][0]][:5]:
            near = [b for b in order if v[b][0] != v[a][0] and 50 * score[p] <= 100 * score[b] <= 95 * score[p]][:3]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(near)]
    return sorted(out)


def test_four_russians_scores_are_inner_products():
    rng = np.random.default_rng(0)
    for width, reach in ((1, 3), (13, 300), (64, 1 << 20)):
        a, c = rng.integers(-reach, reach, (5, width)), rng.integers(-reach, reach, (40, width))
        planes = int(reach).bit_length() + 1
        packed = hard_negatives.bit_planes(c, planes)
        pad = np.pad(a, ((0, 0), (0, -width % 8)))
        assert (hard_negatives.unpacked(packed)[:, :width] == c).all()
        assert (hard_negatives.SubsetSums(pad, planes).scores(packed) == c @ a.T).all()


def test_negatives_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((3, 6))
    rows = [(i, i % 3, (centres[rng.integers(0, 3)] + 0.3 * rng.standard_normal(6)).round(1).tolist()) for i in range(240)]
    rows += [(300 + i, i % 3, rows[i][2]) for i in range(40)]  # ties
    whole = [*rows, rows[7]]
    odd = [(400, None, rows[0][2]), (402, 1, None), (403, 1, [1.0, None] + [0.0] * 4), (404, 1, [float("nan")] + [0.0] * 5), (405, 1, [float("inf")] + [0.0] * 5), (None, 1, rows[0][2])]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in whole + odd], "vec_id long, label long, embedding array<double>, planes string, rank long")
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for per_round in (2048, 9):
        got = hard_negatives.hard_negatives(vectors, F.col("vec_id") % 10 == 0, per_round=per_round)
        assert sorted(tuple(r) for r in got.select(*columns).collect()) == want
    assert len(want) > 100
    assert hard_negatives.hard_negatives(vectors.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(vectors, F.lit(False)).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame([(1, 1, [1e9])], vectors.select("vec_id", "label", "embedding").schema), F.lit(True))


# 11: toxicity


@pytest.fixture(scope="module")
def letters():
    text = "you are such an idiot and a loser the stupid moron said to the clown it is not a good trip to the pool book\n" * 30
    return toxicity.LetterModel(np.bincount(toxicity.trigram_codes(text), minlength=toxicity.SYMBOLS**3))


def test_trigram_counts():
    got = toxicity.trigram_codes("ab é!\nc").tolist()
    e = toxicity.symbol("é")
    code = lambda a, b, c: (a * 64 + b) * 64 + c
    assert got == [code(0, 0, 1), code(0, 1, 2), code(1, 2, 0), code(0, 0, e), code(0, e, 0), code(0, 0, 3), code(0, 3, 0)]


def test_decoding_finds_the_likeliest_reading(letters):
    def worth(reading, charge):
        total, a, b = -charge, 0, 0
        for ch in "".join(reading):
            if ch == " " and b == 0:
                continue
            x = toxicity.symbol(ch)
            total += float(letters.log[a, b, x])
            a, b = (0, 0) if ch == " " else (b, x)
        return total + (float(letters.log[a, b, 0]) if b else 0.0)

    for form in ("1d10t", "m0rr0n", "l o o", "s-t u", "tr|p", "$tuup1d", "aaa!b", "5+8"):
        options = list(toxicity.lattice(form))
        every = [("".join(x for x, _ in way), sum(c for _, c in way)) for way in itertools.product(*options)]
        best = max(worth(r, c) for r, c in every)
        got = letters.restore(form)
        assert any(" ".join(r.split()) == " ".join(got.split()) and abs(worth(r, c) - best) < 1e-4 for r, c in every)


def test_disguises_are_undone(letters):
    for shown in ("1d10t", "id1ot", "i d i o t", "i.d.i.o.t", "iiidiooot", "IDIOT!!", "(idiot)", "i-d-i-o-t"):
        assert toxicity.restored_tokens(shown, letters) == ["idiot"], shown
    assert toxicity.restored_tokens("the m0r0n said: l o s e r !", letters) == ["the", "moron", "said", "loser"]
    assert toxicity.restored_tokens(None, letters) == [] == toxicity.restored_tokens("12 -- 3.4 !!", letters)
    assert toxicity.restored_tokens("a good book", letters) == ["a", "good", "book"]


def test_features_of_a_batch_are_those_of_its_restored_words(letters):
    texts = ["The Idiot said: 1d10t, i d i o t!", None, "", "looose bookish été ñandú €uro $$$ ok", "m o r o n s or fööl", "stupidly st00pid"]
    column = pa.array(texts, pa.string())

    def of(words):
        data = np.frombuffer("".join(words).encode(), np.uint8)
        end = np.cumsum([len(w.encode()) for w in words]).astype(np.int64)
        return set(toxicity.word_features(data, end - [len(w.encode()) for w in words], end)[1].tolist()) if words else set()

    row, f = toxicity.batch_features(column, letters)
    for k, t in enumerate(texts):
        have, want = set(f[row == k].tolist()), of(toxicity.restored_tokens(t, letters))
        assert want <= have  # spelled-out letters also stand for themselves
    ids = np.array(sorted(of(["idiot", "moron", "stupid"])))
    only = toxicity.Features(ids)
    row2, f2 = toxicity.batch_features(column, letters, only)
    want = {(int(r), int(x)) for r, x in zip(row, f) if x in set(ids.tolist())}
    assert {(int(r), int(only.ids[k])) for r, k in zip(row2, f2)} == want and want


def test_weights_are_a_penalised_fit():
    """The slope of the fit is zero at every weight over zero, and not above zero at the others."""
    rng = np.random.default_rng(0)
    x = rng.random((200, 12)) < 0.2
    x[:, 5] = x[:, 4]
    y = (x[:, 0] | x[:, 4] | (rng.random(200) < 0.1)).astype(float)
    rows, cols = np.nonzero(x)
    times = rng.integers(1, 4, 200).astype(float)
    w, c = toxicity.fit_weights(rows, cols, y, times, 12)
    gap = (y - 1 / (1 + np.exp(-(x @ w + c)))) * times
    slope = x.T @ gap
    assert abs(gap.sum()) < 0.01 and w[4] == w[5] > 0 and w[0] > 1
    assert (np.abs(slope[w > 0] - 1) < 0.01).all() and (slope[w == 0] <= 1.01).all()


def test_a_beginning_is_judged_without_its_surer_words():
    # Feature 0: a toxic word; 1: its beginning, which 40 clean texts have too; 2: always with 0; 3: rare.
    rows = np.concatenate([np.arange(100), np.arange(140), np.arange(100), np.arange(3)])
    features = np.repeat([0, 1, 2, 3], [100, 140, 100, 3])
    labels = np.array([1.0] * 100 + [0.0] * 100)
    share = toxicity.feature_shares(rows, features, labels, np.ones(200), 4, 0.5)
    assert share[0] > 0.9 and share[2] > 0.9 and share[1] < 0.1 and share[3] < 0.7


def test_toxicity_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    plain = ["river", "stone", "garden", "window", "table", "paper", "yellow", "morning", "winter", "sudden"]
    rows, marks = [], []
    for i in range(600):
        words = rng.choice(plain, 12).tolist()
        bad = i % 3 == 0
        if bad:
            words[int(rng.integers(0, 12))] = str(rng.choice(["scoundrel", "weasel"]))
        rows.append((i, " ".join(words), "x"))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([*marks, (3, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    odd = [(None, "you weasel", "x"), (1000, None, "x"), (1001, "", "x"), (1002, " \n", "x"), (1003, "a w 3 a $ e l !", "x"), (1003, "river stone", "x")]
    odd += [(1004, "sc0undreeeel", "x"), (1005, ("river " * 200_000) + "WEASEL", "x"), (1006, "w e a s e l", "x"), (1006, "w e a s e l", "x")]
    got = defaultdict(list)
    for r in toxicity.score_documents(docs.unionByName(spark.createDataFrame(odd, docs.schema)), model).collect():
        got[r.doc_id].append(r)
    assert all(got[i][0].predicted == bad for i, bad in marks)
    assert got[None][0].predicted == 1 and got[None][0].held_out is None
    assert len({got[k][0].score for k in (1000, 1001, 1002)}) == 1 and got[1000][0].predicted == 0
    assert [got[k][0].predicted for k in (1004, 1005, 1006)] == [1, 1, 1] and len(got[1006]) == 2
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    bare = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(docs, bare).collect()} == {0.5}
    assert toxicity.fit(docs.limit(0), labels).constant == 0.0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op11_toxicity(spark, sf).toPandas()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert set(got.held_out) == {True, False} and (both.predicted[both.toxic == 0] == 0).mean() > 0.98
    held = both[both.held_out]
    ranks = held.score.rank()
    n1, n0 = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    assert (ranks[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.8


def test_restored_texts(spark, letters):
    docs = spark.createDataFrame([(1, "The 1d10t"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in toxicity.restored_texts(docs, letters).collect()) == [(1, "the idiot"), (2, "")]
