"""The training-text operators against brute force, and their edge cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tonelake.llm import class_model, hamming_search, idcoder, language, mixing, neardup_vectors, packing, quality, simhash, substrings, texts, token_files
from tonelake.llm.components import components
from tonelake.llm.store import written
from tonelake.llm.tokens import default_vocabulary, encoder
from tonelake.session import scratch_path

SF = "/root/testdata/sf0.001"
VOCABULARY = default_vocabulary()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, n_words string, size string, bucket string"


def passage(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, copies, repeated rows, odd characters, clashing column names."""
    rows = [
        (1, passage(1, 40), "en", "a", 1),
        (2, passage(1, 40), "en", "a", 1),
        (3, "Start " + passage(1, 40) + " end", "en", None, 1),
        (4, None, None, "b", None),
        (5, "", "fr", "b", 0),
        (6, " \t\n ", "fr", "b", 0),
        (7, "It's <|endoftext|> 123 ΑΣ é́ İ\x1cx y", "de", "c", 1),
        (8, " ".join(f"long{k % 977}" for k in range(30_000)), "en", "c", 1),
        (9, passage(9, 13) + " " + passage(9, 13), "en", "c", 1),
        (9, passage(9, 13) + " " + passage(9, 13), "en", "c", 1),
        (10, "THE End " + passage(9, 12), "en", "c", 1),
        (None, passage(1, 40), "en", "a", 1),
        (12, "one two", None, None, 1),
    ]
    return spark.createDataFrame([(*r, 0.5, "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def split(text):
    return (text or "").encode().split()


# Words


def test_words_and_window_hashes_tell_words_apart():
    column = pa.array(["a bb\tccc", None, "", " d", "e f g"])
    data, at = texts.text_bytes(column)
    starts, ends, before = texts.words(data, at)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["a", "bb", "ccc", "d", "e f", "g"]
    assert np.diff(before).tolist() == [3, 0, 0, 1, 2]
    one, two, first = texts.window_hashes(tuple(texts.word_hashes(data, starts, ends, k) for k in (0, 1)), before, 2)
    assert first.tolist() == [0, 1, 4] and len(set(one)) == 3 and len(set(two)) == 3


# 1 and 7: tokens


def reference_ids(text):
    return encoder(VOCABULARY).library.encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_are_the_librarys_ids(docs, none):
    got = packing.pack_documents(docs, VOCABULARY, with_ids=True).collect()
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(reference_ids(r.text))
    for doc, all_ids in want.items():
        pieces = sorted((r for r in got if r.doc_id == doc), key=lambda r: (r.piece, r.ids))
        copies = len(all_ids)
        joined = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces[::copies]])
        assert joined.tolist() == all_ids[0] and len(pieces) == copies * -(-len(all_ids[0]) // packing.CAPACITY)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 and r.start == r.piece * packing.CAPACITY
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert packing.pack_documents(none, VOCABULARY).count() == 0


def simple_best_two_fit(lengths, capacity):
    """One bin after the other on a list of pieces."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        taken, room = [], capacity
        for x in list(left):
            if x <= room:
                taken.append(x)
                left.remove(x)
                room -= x
        small = min(taken)
        best = (0, None)
        if room and len(taken) > 1:
            for a in sorted(set(left)):  # of equal pairs the most even one
                for b in sorted(set(left), reverse=True):
                    if b <= a and (a != b or left.count(a) > 1) and small < a + b <= room + small and a + b > best[0]:
                        best = (a + b, (a, b))
        if best[1]:
            taken.remove(small)
            left.append(small)
            for x in best[1]:
                taken.append(x)
                left.remove(x)
            left.sort(reverse=True)
        bins.append(sorted(taken))
    return sorted(bins)


def test_plan_is_best_two_fit():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 41, rng.integers(1, 60)).tolist()
        plan, n = packing.plan_bins(Counter(lengths), 40)
        bins = defaultdict(list)
        for length, lo, hi, first, per, _ in plan:
            for r in range(hi - lo):
                bins[first + r // per].append(length)
        assert sorted(sorted(b) for b in bins.values()) == simple_best_two_fit(lengths, 40)
        assert n == len(bins)


def test_sequences_hold_their_pieces(spark):
    docs = spark.createDataFrame([(i, passage(i, 40 + i)) for i in range(30)], "doc_id long, text string")
    packed = written(packing.pack_documents(docs, VOCABULARY, capacity=600, with_ids=True), "t")
    ids = {(r.doc_id, r.piece): r.ids for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        assert r.ids == b"".join(ids[p.doc_id, p.piece] for p in r.pieces)


def test_coder_round_trip_and_checksums():
    rng = np.random.default_rng(1)
    for n in (0, 1, 15, 16, 5000, 40_000):
        for ids in (rng.integers(0, 49_408, n), np.full(n, 7), np.arange(n) % 5, rng.zipf(1.3, n) % 49_408):
            block = idcoder.encode_block(ids, np.array([3, -1]), np.array([n, 0]), 49_408)
            docs, lens, back = idcoder.decode_block(block)
            assert docs.tolist() == [3, -1] and lens.tolist() == [n, 0] and (back == ids).all()
    assert len(idcoder.encode_block(np.arange(40_000) % 5, np.array([1]), np.array([40_000]), 49_408)) < 40_000
    for at in (2, 30, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            idcoder.decode_block(bytes(bad))
    with pytest.raises(ValueError):
        idcoder.decode_block(block[:10])


def test_coded_ids_are_smaller_than_order_0():
    """On ids of real texts orders 1 and 2 have to earn more than lanes and adaptation cost."""
    import pyarrow.parquet as pq

    column = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"]
    ids, _ = encoder(VOCABULARY).encode(column)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    order_0 = -(share * np.log2(share)).sum()  # without the cost of telling the shares
    block = idcoder.encode_block(ids.astype(np.int64), np.array([1]), np.array([len(ids)]), 49_408)
    assert (idcoder.decode_block(block)[2] == ids).all()
    assert 8 * len(block) / len(ids) < order_0 - 0.2


def test_token_files_read_back(spark, docs, none):
    folder = scratch_path(spark, "t")
    manifest = token_files.write_token_files(docs, folder, VOCABULARY, block_ids=300)
    back = token_files.read_token_files(manifest, folder).join(token_files.block_starts(manifest), ["file", "block"]).collect()
    back.sort(key=lambda r: (r.file, r.block, r.place))
    assert manifest.count() > 2
    numbers = [r.doc_id for r in back]
    assert numbers == sorted(numbers) and numbers[0] == -(2**63)
    got = sorted((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in back)
    want = sorted((-(2**63) if r.doc_id is None else r.doc_id, tuple(reference_ids(r.text))) for r in docs.collect())
    assert got == want
    at = 0
    for r in back:
        assert r.first_id + r.before == at and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    empty = token_files.write_token_files(none, folder, VOCABULARY)
    assert empty.count() == 0 and token_files.read_token_files(empty, folder).count() == 0


# 2: passages


def brute_passages(rows, size=13):
    """(number, words, kept words) of every row; a null number is the largest."""
    first = {}
    for doc, text in rows:
        ws = split(text)
        for k in range(len(ws) - size + 1):
            key = tuple(ws[k : k + size])
            first[key] = min(first.get(key, math.inf), math.inf if doc is None else doc)
    out = []
    for doc, text in rows:
        ws = split(text)
        gone = set()
        for k in range(len(ws) - size + 1):
            if first[tuple(ws[k : k + size])] < (math.inf if doc is None else doc):
                gone |= set(range(k, k + size))
        out.append((doc, len(ws), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return sorted(out, key=repr)


def test_passages_against_brute_force(docs, none):
    got = rows_of(substrings.substring_dedup(docs, bucket_bytes=5000), "doc_id", "n_words", "kept_text")
    assert got == brute_passages([(r.doc_id, r.text) for r in docs.collect()])
    spans = {r.doc_id: (r.removed, r.n_removed) for r in substrings.substring_dedup(docs, keep=("lang",)).collect()}
    assert spans[3] == ([1, 41], 40) and spans[1] == ([], 0) and spans[None] == ([0, 40], 40)
    assert substrings.substring_dedup(none).count() == 0


def test_passage_query_against_brute_force(spark):
    got = rows_of(substrings.op2_substring_dedup(spark, SF), "doc_id", "n_words", "kept_sha256")
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute_passages([(r.doc_id, r.text) for r in docs])
    assert got == sorted(((d, n, hashlib.sha256(t.encode()).hexdigest()) for d, n, t in want), key=repr)


# 3: language


def test_forward_sums_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"bc"]
    p = language.Pieces(pieces)
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T)
    logs = np.vstack([logs, [-np.inf, -np.inf]])
    where = {x: i for i, x in enumerate(pieces)}

    def brute(w, lang):
        if not w:
            return 1.0
        return sum(math.exp(logs[where[w[:k]], lang]) * brute(w[k:], lang) for k in range(1, len(w) + 1) if w[:k] in where)

    data = np.frombuffer(b"abcxabcabc", np.uint8)
    got = language.word_scores(data, np.array([0, 4, 0]), np.array([3, 6, 1]), p, logs)
    for row, w in zip(got, (b" abc", b" abcabc", b" a")):
        assert np.allclose(row, [math.log(brute(w, 0)), math.log(brute(w, 1))])
    long = np.frombuffer(b"abc" * 4000, np.uint8)
    whole = language.word_scores(long, np.array([0]), np.array([12_000]), p, logs)
    assert np.isfinite(whole).all()


def test_languages_held_out(spark, docs, none):
    got = language.op3_language_id(spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(lang, on="doc_id")
    both = both[both.held_out & (both.lang_pred != "und")]
    assert (both.lang == both.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    model = language.fit(docs, language.default_vocabulary())
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert odd[4] == odd[5] == odd[6] == ("und", 0.0) and odd[7][0] != "und"
    assert language.identify(none, model).count() == 0
    unlearned = language.fit(none, language.default_vocabulary())
    assert {r.lang_pred for r in language.identify(docs, unlearned).collect()} == {"und"}


def test_expected_pieces_of_long_words():
    """The counts of short words against the plain sums; those of a long word add up to its bytes."""
    pieces_list = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"bc", b"cab"]
    pieces = language.Pieces(pieces_list)
    p = np.random.default_rng(1).dirichlet(np.ones(len(pieces_list)))
    data = np.frombuffer(b"abcabcaabbc", np.uint8)
    starts, lens, times = np.array([0, 3, 2]), np.array([8, 3, 9]), np.array([2, 5, 1])
    want = np.zeros(len(pieces_list))
    for s, n, t in zip(starts, lens, times):
        w = b" " + data[s : s + n].tobytes()
        ways = [([], 0)]
        whole = []
        while ways:
            cut, at = ways.pop()
            if at == len(w):
                whole.append(cut)
            ways += [([*cut, i], at + len(x)) for i, x in enumerate(pieces_list) if x == w[at : at + len(x)]]
        chance = np.array([np.prod(p[c]) for c in whole])
        for c, x in zip(whole, chance / chance.sum()):
            np.add.at(want, c, x * t)
    assert np.allclose(language.expected_pieces(data, starts, lens, times, pieces, p), want)
    rare = np.full(len(pieces_list), 1e-11)
    rare[0] = 1 - rare[1:].sum()
    long = np.frombuffer(b"abcab" * 1000, np.uint8)
    use = language.expected_pieces(long, np.array([0, 7]), np.array([5000, 61]), np.array([1, 1]), pieces, rare)
    assert np.isclose(use @ np.array([len(x) for x in pieces_list]), 5001 + 62)


def test_languages_without_spaces(spark):
    rng = np.random.default_rng(5)
    signs = {"ja": [chr(0x3041 + i) for i in range(80)], "zh": [chr(0x4E00 + 7 * i) for i in range(200)]}
    rows = [(i, "".join(rng.choice(signs[x], 40 + int(rng.integers(200)))), x) for i, x in enumerate(["ja", "zh"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, language.fit(docs, language.default_vocabulary())).where("held_out").collect()}
    assert len(got) > 10 and all(got[i] == x for i, _, x in rows if i in got)


def test_language_sample_is_never_empty(spark):
    """The wanted number of rows by hash at any count, also of a number that repeats; and all pieces of the vocabulary."""
    rows = [(i, "en", f"t{i}") for i in range(300)] + [(7, "de", f"s{i}") for i in range(50)] + [(9, "fr", "u")]
    rows = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language.sample_languages(rows, {"en": 300, "de": 50, "fr": 1}, 20).to_pandas()
    assert got.lang.value_counts().to_dict() == {"en": 20, "de": 20, "fr": 1}
    huge = language.sample_languages(rows, {"en": 10**12, "de": 10**12, "fr": 10**12}, 1).to_pandas()
    assert sorted(huge.lang) == ["de", "en", "fr"]
    assert {b" international", b" relationship"} <= set(language.vocabulary_pieces(language.default_vocabulary()))


# 4: SimHash


def brute_fingerprint(text):
    import xxhash

    ws = split((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=2):
    """Smallest number reachable, for (number, fingerprint) rows."""
    label = [d for d, _ in fps]
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(fps):
            for j, (_, b) in enumerate(fps):
                if bin(a ^ b).count("1") <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash_against_brute_force(spark, docs, none):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.where("doc_id is not null").collect()]
    want = sorted((d, f, c) for (d, f), c in zip(rows, brute_components(rows)))
    got = simhash.near_duplicates(docs.where("doc_id is not null")).collect()
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert {r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is None} == {1}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_pigeonring_finds_every_link(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 12)
    fps = set()
    for b in base.tolist():
        for _ in range(25):
            f = b
            for bit in rng.choice(64, rng.integers(0, 4), replace=False).tolist():
                f ^= 1 << bit
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    comp = {r.node: r.component for r in components(simhash.fingerprint_links(df, distance)).collect()}
    got = [comp.get(s, s) for s in signed]
    assert got == brute_components(list(zip(signed, fps)), distance)


def test_large_buckets_find_the_same_links(monkeypatch):
    rng = np.random.default_rng(5)
    start, mask = simhash._tables(2)[4]
    free = [b for b in range(64) if not mask >> b & 1]
    f = np.unique([sum(1 << int(b) for b in rng.choice(free, 3)) for _ in range(300)]).astype(np.uint64)
    small = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in simhash.bucket_links(f, start, mask, 2)))}
    monkeypatch.setattr(simhash, "_PAIRS", 1)
    assert small and {tuple(sorted(p)) for p in zip(*(x.tolist() for x in simhash.bucket_links(f, start, mask, 2)))} == small


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


# 5: language model


def test_base_score_and_counts(docs, none):
    rows = docs.collect()
    tokens = [(r.doc_id, [w.lower() for w in split(r.text)] + [None]) for r in rows]
    learn = Counter()
    for d, ts in tokens:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            learn.update(ts)
    n, v = sum(learn.values()), len(learn)
    want = sorted(
        ((d, len(ts), sum(t in learn for t in ts), n, round(sum(math.log10((learn[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 6)) for d, ts in tokens), key=repr
    )
    out = class_model.score_texts(docs, bucket_bytes=50_000).toPandas()
    got = sorted(
        ((None if math.isnan(r.doc_id) else int(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.itertuples()), key=repr
    )
    assert got == want and (out.score < 0).all()
    assert class_model.score_texts(none).count() == 0


def test_class_model_is_a_distribution_and_beats_the_base(spark):
    out = class_model.op5_class_lm(spark, SF).toPandas()
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()
    # Over all words, the unknown one and the end, shares times transitions add up to one.
    counts, cls = np.array([9, 8, 7, 3, 2, 1, 1, 1]), np.array([0, 1, 0, 1, 1, 0, 0, 2])
    rng = np.random.default_rng(0)
    text = np.append(rng.permutation(np.repeat(cls, counts)), 4)  # no word has class 3
    big = np.zeros((5, 5))
    np.add.at(big, (np.concatenate([[4], text[:-1]]), text), 1)
    model = class_model.ClassBigrams(big, np.array([2.0, 0, 1, 0]))
    of, share = model.symbols(np.append(counts, 0), np.append(cls, 1))
    assert of.tolist() == [*cls.tolist(), model.unknown, model.end]
    assert np.allclose((10.0 ** (model.log_follow[:, of] + share)).sum(axis=1), 1)


def test_every_word_gets_the_class_of_its_neighbours(spark):
    """Words outside the clustered ones stand with those that have the same neighbours; unseen ones with the most."""
    rng = np.random.default_rng(0)
    animals, verbs = [f"cat{i}" for i in range(30)], [f"run{i}" for i in range(30)]
    texts_ = [" ".join(f"the {rng.choice(animals)} will {rng.choice(verbs)} now" for _ in range(40)) for _ in range(60)]
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)  # held out
    rows = [(i, t) for i, t in enumerate(texts_) if zlib.crc32(str(i).encode()) % 5 != 1] + [(None, "the cat99 will run99 now"), (out, "gnu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = class_model.encode(docs, "doc_id", "text")
    told = class_model.count_words(encoded, 8, 12)
    top, counts, sums = class_model.top_words(told, 8, 12)
    assert list(counts) == sorted(counts, reverse=True) and sums[0] == sum(len(split(t)) for d, t in rows if d != out)
    symbols = class_model._Frequent(top)
    table, n = class_model._sums(encoded.select("seq", "lens", "train", "dict"), lambda r: symbols.of(class_model._unzip(r["dict"], "<u8")), symbols.size)
    of = class_model.exchange(table, symbols.other, 5)
    member = np.eye(int(of.max()) + 1)[of]
    found = class_model.exchange_rest(encoded, 8, symbols, of, member.T @ table @ member)
    batches = class_model._with_counts(encoded, told, found).join(encoded.select("batch", "dict"), "batch").collect()
    cls = {}
    for r in batches:
        known, c = class_model._unzip(r["dict"], "<u8"), class_model._unzip(r["classes"], "<u2")
        assert len(known) == len(c)
        cls |= dict(zip(known.tolist(), c.tolist()))

    def class_of(w):
        data = np.frombuffer(w.encode(), np.uint8)
        return cls[int(class_model._hashes(data, np.array([0]), np.array([len(data)]))[0])]

    assert len({class_of(w) for w in [*animals, "cat99"]}) == 1 and len({class_of(w) for w in [*verbs, "run99"]}) == 1
    assert class_of("cat1") != class_of("run1") and class_of("the") != class_of("cat1")


def test_top_words_are_merged_in_steps(spark, docs, monkeypatch):
    encoded = class_model.encode(docs, "doc_id", "text")
    told = class_model.count_words(encoded, 40, 5)
    plain = class_model.top_words(told, 40, 5)
    monkeypatch.setattr(class_model, "TOPS", 3)
    assert all((a == b).all() for a, b in zip(class_model.top_words(told, 40, 5), plain))


def test_exchange_groups_words_that_behave_alike():
    big = np.zeros((6, 6))
    big[np.ix_([0, 1], [2, 3])] = 50  # 0 and 1 are followed by 2 and 3, and these by the end
    big[np.ix_([2, 3], [5])] = 100
    big[5, :2] = 100
    of = class_model.exchange(big, 4, 2)
    assert of[0] == of[1] != of[2] == of[3] and of[4] != of[5]


# 6: quality


def test_quality_held_out(spark, docs, none):
    got = quality.op6_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert len(got) == 200 and got.score.between(0, 1).all()
    assert ((both.score >= 0.7) == (both.quality == 1)).mean() > 0.9
    assert (got.predicted == (got.score >= 0.7)).all()
    marks = spark.createDataFrame([(1, 1), (8, 0), (8, 1), (9, None), (None, 1), (12, 0)], "doc_id long, quality int")
    model = quality.fit(docs, marks)
    out = {r.doc_id: r for r in quality.score_documents(docs, model, keep=("lang",)).collect()}
    assert out[4].score == out[5].score == float(model.labels.mean()) and out[1].lang == "en"
    assert quality.score_documents(none, model).count() == 0
    bare = quality.fit(docs, marks.limit(0))
    assert {r.score for r in quality.score_documents(docs, bare).collect()} == {0.5}


def test_repeated_numbers_are_learned_from_in_any_order(spark):
    """Of a number with several texts the one of the smallest hash counts, however the rows come."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: 30 + 30 * (i % 2)], 12))) for i in range(60) for _ in range(2)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    scores = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        scores.append(sorted((r.doc_id, r.score) for r in quality.score_documents(df, quality.fit(df, marks)).collect()))
    assert all(a == b and abs(x - y) < 1e-5 for (a, x), (b, y) in zip(*scores))  # single precision
    few = quality.fit(df, marks, max_cells=100)
    assert 0 < len(few.labels) < 10 and len(quality.fit(df, marks, max_cells=1).labels) == 1


def test_votes_are_exact():
    rng = np.random.default_rng(0)
    w = np.abs(rng.standard_normal((60, quality.TERMS))).astype(np.float32) * (rng.random((60, quality.TERMS)) < 0.01)
    model = quality.NeighbourVote(w, (rng.random(60) < 0.5).astype(int), dimensions=8, neighbours=5)
    v = quality.unit((w * model.idf) @ model.project)
    for i, s in enumerate(model.scores(w)):
        sim = v[i] @ model.vectors
        near = np.flatnonzero(sim >= np.sort(sim)[-5] - 1e-6)
        weight = np.maximum(sim[near], 0)
        assert abs(s - (weight @ model.labels[near]) / weight.sum()) < 1e-5


def test_votes_tell_words_of_one_shape():
    """Spam in ordinary lower-case words looks like prose; only its words tell."""
    rng = np.random.default_rng(3)
    prose, spam = ([f"{a}{x}{y}" for x in "aeiou" for y in "bdlmnrst"] for a in "hw")

    def texts_of(n):
        label = rng.integers(0, 2, n)
        return pa.array([" ".join(rng.choice(prose if y else spam, 30 + rng.integers(20))) + "." for y in label]), label

    (learn, marks), (held, truth) = texts_of(200), texts_of(100)
    model = quality.NeighbourVote(quality.term_weights(learn), marks)
    assert ((model.scores(quality.term_weights(held)) >= quality.THRESHOLD) == (truth == 1)).mean() > 0.95


# 8: top-k


def test_topk_edges(spark):
    codes = spark.createDataFrame([(i, c) for i, c in enumerate([5, 5, 5, 7, -1, 0, None])] + [(None, 3), (0, 5)], "id long, code long")
    got = rows_of(hamming_search.top_codes(codes, codes.where("id in (0, 4)"), k=3), "query_id", "rank", "id", "distance")
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 3, 1), (4, 1, 3, 61), (4, 2, 0, 62), (4, 3, 1, 62)]
    assert hamming_search.top_codes(codes.limit(0), codes.limit(0)).count() == 0
    few = hamming_search.top_codes(codes.where("id < 2"), codes.where("id < 2"), k=3)
    assert rows_of(few, "query_id", "rank", "id") == [(0, 1, 1), (1, 1, 0)]


# 9: vectors


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    x = [b + rng.standard_normal(16) * s for b in base for s in (0, 0, 0.05, 0.1, 0.25)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, [1.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in [*rows, *odd]], "vec_id long, embedding array<float>, h string, n int")
    m = np.array([r[1] for r in rows])
    cos = m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1))
    link = cos >= 0.95
    label = np.arange(len(m))
    for _ in range(len(m)):
        label = np.array([label[link[i]].min() for i in range(len(m))])
    want = [(i, int(link[i].sum()) - 1, int(label[i]), bool(label[i] == i)) for i in range(len(m))]
    for df, chunk in ((df, 4096), (df, 3), (df.withColumn("embedding", df["embedding"].cast("array<double>")), 3)):
        got = neardup_vectors.near_duplicate_vectors(df, chunk=chunk).collect()
        assert sorted(tuple(r) for r in got if r.vec_id is not None and r.vec_id < 900) == want
        assert all(r.n_links == 0 and r.kept and r.component_id == r.vec_id for r in got if r.vec_id is None or r.vec_id >= 900)
    assert neardup_vectors.near_duplicate_vectors(df.limit(0)).count() == 0
    assert neardup_vectors.near_duplicate_vectors(df.where("vec_id >= 900")).count() == 5 + 1


# 10: mixing


def test_sainte_lague_is_by_highest_quotients():
    rng = np.random.default_rng(0)
    for _ in range(40):
        w = rng.integers(0, 50, rng.integers(1, 8)).astype(float)
        caps = rng.integers(0, 30, len(w))
        seats = int(rng.integers(0, 80))
        want = np.zeros(len(w), int)
        for _ in range(seats):
            q = [w[i] / (2 * want[i] + 1) if want[i] < caps[i] else 0 for i in range(len(w))]
            if max(q) <= 0:
                break
            want[int(np.argmax(q))] += 1
        assert mixing.sainte_lague(w, seats, caps).tolist() == want.tolist()


def test_mix(spark, docs, none):
    out = [r.asDict() for r in mixing.mix_documents(docs, shard_words=2000).collect()]
    size = {None: 0}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert sum((b - a) * n for a, b, n in zip(r["spans"][::3], r["spans"][1::3], r["spans"][2::3])) == r["taken"]
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in out:
        s = by[r["source"]]
        s[0] += r["size"]
        s[1] = r["source_size"]
        s[2] = r["target"]
        s[3] += r["taken"]
    del size
    names = ["a", "b", "c", None]
    assert [by[n][0] for n in names] == [by[n][1] for n in names]
    assert np.allclose([by[n][2] for n in names], mixing.targets([by[n][0] for n in names], [3, 1, 2, 3]))
    assert abs(sum(by[n][2] for n in names) - 1.5 * sum(by[n][0] for n in names)) < 1e-6
    for n in names:
        assert abs(by[n][3] - by[n][2]) <= mixing.BLOCK * 20
    again = mixing.mix_documents(docs.repartition(5), shard_words=2000)
    assert rows_of(again, "doc_id", "size", "taken", "target") == sorted(((r["doc_id"], r["size"], r["taken"], r["target"]) for r in out), key=repr)
    assert mixing.mix_documents(none).count() == 0
    assert mixing.targets([10, 0, 10], [3, 1, 2]) == [18.0, 0.0, 12.0] and mixing.targets([2, 100], [3, 1]) == [4.0, 149.0]


def test_taken_text():
    assert mixing.taken_text("a b  c\nd", [1, 3, 1]) == "b c"
    assert mixing.taken_text("a b c", [0, 1, 1, 1, 3, 2]) == "a b c\nb c"


# The pipeline


def test_pipeline_against_plain_steps(spark):
    """Every stage's rows against a plain version of it on the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "t")
        outs.append(docs)
    start = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    scores = {r.doc_id: r.score for r in quality.op6_quality_classifier(spark, SF).collect()}
    one = {r.doc_id: r for r in outs[0].collect()}
    assert set(one) == {d for d, s in scores.items() if s >= 0.7} and all(one[d] == start[d] for d in one)
    fps = sorted((d, brute_fingerprint(r.text)) for d, r in one.items())
    two = {r.doc_id: r for r in outs[1].collect()}
    assert set(two) == {d for (d, _), c in zip(fps, brute_components(fps)) if d == c} and all(two[d] == one[d] for d in two)
    kept = {d: (n, t) for d, n, t in brute_passages([(d, r.text) for d, r in two.items()])}
    three = {r.doc_id: r for r in outs[2].collect()}
    assert set(three) == set(two)
    for d, r in three.items():
        whole = kept[d][1] == b" ".join(split(two[d].text)).decode()
        assert r.text == (two[d].text if whole else kept[d][1]) and r.n_chars == len(r.text)
    taken = {r.doc_id: r for r in mixing.mix_documents(outs[2]).collect()}
    four = {r.doc_id: r for r in outs[3].collect()}
    assert set(four) == {d for d, r in taken.items() if r.taken}
    for d, r in four.items():
        assert len(split(r.text)) == taken[d].taken and set(split(r.text)) <= set(split(three[d].text))
    five = outs[4].collect()
    total = Counter()
    for r in five:
        total[r.doc_id] += r.length
    assert total == {d: len(reference_ids(r.text)) for d, r in four.items()}
    assert corpus_pipeline.run(spark, SF).count() == len(five)


def test_near_dedup_drops_copies_only(spark):
    """Null and repeated numbers: only rows of one component replace each other."""
    near = passage(1, 60)
    rows = [
        (None, passage(2, 40), "en", "a", 1),
        (None, passage(3, 40), "en", "a", 1),
        (None, passage(3, 40), "en", "a", 1),
        (None, near, "en", "a", 1),
        (5, near, "en", "b", 1),
        (5, near, "en", "a", 1),
        (5, passage(6, 40), "en", "a", 1),
        (4, near, "en", "a", 1),
        (7, None, "en", "a", 1),
        (None, "", "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = [rows[0], rows[1], rows[6], rows[7], rows[8]]
    assert rows_of(corpus_pipeline.near_dedup(spark, docs, SF), *docs.columns) == sorted(want, key=repr)


def test_mixture_of_repeated_rows(spark):
    """Each row gets the spans of one of its equals: as many words come out as the mix takes, by source."""
    rows = [(1, passage(1, 50), "en", "a", 1)] * 5 + [(None, passage(2, 70), "en", "b", 1)] * 4
    rows += [(1, passage(1, 50), "en", "c", 1), (3, passage(3, 400), "fr", "a", 1), (4, "", "fr", "a", 0), (None, None, "fr", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mix_documents(docs)
    want = Counter((r.doc_id, r.source, r.taken) for r in mixed.collect() if r.taken)
    assert Counter((r.doc_id, r.source, len(split(r.text))) for r in corpus_pipeline.mixture(spark, docs, SF).collect()) == want
    assert sum(want.values()) > len(want)


# Words of one polynomial hash


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_share_polynomial_hashes_stay_apart(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64, whatever the base."""
    one, two = thue_morse(1024)
    column = pa.array([f"{one} {two}", f"{two} x"])
    ids, lens = encoder(VOCABULARY).encode(column)
    assert ids.tolist() == reference_ids(f"{one} {two}") + reference_ids(f"{two} x") and lens.tolist() == [len(reference_ids(t)) for t in column.to_pylist()]
    rest = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string")
    assert {r.n_removed for r in substrings.substring_dedup(docs).collect()} == {0}
    # The same with words in place of letters, in windows that long.
    left, right = (" ".join(w) for w in (one, two))
    docs = spark.createDataFrame([(1, left), (2, right), (3, left)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substrings.substring_dedup(docs, size=1024).collect()}
    assert got == {1: 0, 2: 0, 3: 1024}


def test_words_whose_first_hash_is_shared_get_their_own_ids(monkeypatch):
    from tonelake.llm import tokens

    whole = tokens.word_hashes
    monkeypatch.setattr(tokens, "word_hashes", lambda d, s, e, kind=0: whole(d, s, e, kind) % np.uint64(3 if kind == 0 else 1 << 63))
    own = tokens.WordEncoder(VOCABULARY)
    for texts_ in (["some plain words", "of a few texts"], ["words of other texts", "some more"]):
        ids, _ = own.encode(pa.array(texts_))
        assert ids.tolist() == sum((reference_ids(t) for t in texts_), [])


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 16, 17, 255, 256, 257, 300])
def test_word_hashes_depend_on_every_byte(n):
    rng = np.random.default_rng(n)
    word = rng.integers(97, 123, n, np.uint8)
    alone = texts.word_hashes(word, np.array([0]), np.array([n]))[0]
    around = np.concatenate([np.full(3, 120, np.uint8), word, np.full(9, 121, np.uint8)])
    assert texts.word_hashes(around, np.array([3]), np.array([3 + n]))[0] == alone
    seen = {int(alone)}
    for i in range(n):
        other = word.copy()
        other[i] ^= 1
        seen.add(int(texts.word_hashes(other, np.array([0]), np.array([n]))[0]))
    assert len(seen) == n + 1


# Every stage on odd rows


def test_stages_take_odd_rows_and_empty_tables(spark, docs):
    """Nulls in every column, blanks, very long texts, repeated rows and further columns of clashing names."""
    odd = docs.drop("n_words").unionByName(docs.drop("n_words").where("doc_id is null or doc_id in (4, 5, 9)"))
    odd = odd.selectExpr("*", "cast(null as string) as mark", "1L as spans", "text as kept_text", "1 as _id")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        rows = out.collect()
        if stage is not corpus_pipeline.packing:
            assert out.columns == list(corpus_pipeline.COLUMNS), name
            assert {r.doc_id for r in rows} <= {r.doc_id for r in odd.collect()}
        else:
            assert sum(r.length for r in rows if r.piece == 0) > 0 and len(rows) >= odd.count()
        assert stage(spark, odd.limit(0), SF).count() == 0, name
