"""The training-data operators against brute force, on a table of hard cases."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from hunkwise.llm import archive, chunks, components, decontaminate, html_text, language, packing, quality, simhash, suffix, tokens  # noqa: E402
from hunkwise.llm._shared import Scratch  # noqa: E402

rng = random.Random(7)
SYLLABLES = "ka lo mi ter an de ru sol vin qua el bor".split()


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else rng
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


PASSAGE = prose(70, 1)
LONG = prose(30_000, 2)
COPY = prose(120, 3)


def near(text, edits, seed):
    words, r = text.split(), random.Random(seed)
    for i in r.sample(range(len(words)), edits):
        words[i] = "edit" + str(r.random())[2:6]
    return " ".join(words)


def rows():
    out = [(i, prose(80, 100 + i)) for i in range(12)]
    out += [(20, COPY), (21, COPY), (22, near(COPY, 1, 1)), (23, near(COPY, 2, 2)), (24, COPY), (24, COPY)]
    out += [(30, prose(40, 4) + "\n" + PASSAGE + "\n" + prose(40, 5)), (31, PASSAGE + " " + prose(30, 6)), (32, prose(30, 7) + " " + PASSAGE)]
    out += [(40, None), (41, ""), (42, " \n\t "), (43, "12 34 !!"), (44, "One"), (45, "É ß straße x\x0by"), (46, "Du " * 300), (None, prose(60, 8)), (None, COPY)]
    out += [(50, LONG), (51, LONG[:5000]), (52, "<|endoftext|> a\x00b <|startoftext|>"), (53, "x" * 3000), (54, "tab\tand\r\nline  two ")]
    return out


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns whose names the operators use inside, too.
    full = [(i, t, "k", "s", 1, 2, 3, "z") for i, t in ROWS]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, _id long, fp long, rank int, words string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def data(text):
    return (text or "").encode()


def collected(df):
    return [tuple(r) for r in df.collect()]


def groups(n, linked):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


# --- 1 ---


def slow_fingerprint(text, k=4):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), data(text)))
    if not words:
        return 0
    sh = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(docs, empty):
    got = collected(simhash.near_duplicates(docs))
    small = [(i, t) for i, t in ROWS if t is None or len(t) < 9000]
    fps = [slow_fingerprint(t) for _, t in small]
    assert Counter((i, f"{f:016x}") for (i, _), f in zip(small, fps, strict=True)) == Counter((g[0], g[1]) for g in got if g[0] not in (50,))
    all_fps = [int(g[1], 16) for g in got]
    label = groups(len(got), lambda a, b: (all_fps[a] ^ all_fps[b]).bit_count() <= 4)
    least = defaultdict(lambda: None)
    for g, x in zip(got, label, strict=True):
        if g[0] is not None:
            least[x] = g[0] if least[x] is None else min(least[x], g[0])
    assert [g[2] for g in got] == [least[x] for x in label]
    assert simhash.near_duplicates(empty).count() == 0


def slow_components(ids, fps, distance=4):
    label = groups(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= distance)
    least = defaultdict(lambda: None)
    for i, x in zip(ids, label, strict=True):
        if i is not None:
            least[x] = i if least[x] is None else min(least[x], i)
    return [least[x] for x in label]


@pytest.mark.parametrize("rows", [400_000, 40])
def test_simhash_links_null_ids_and_large_keys(spark, monkeypatch, rows):
    """Null ids that bridge others, and keys that are dealt anew, against all pairs."""
    monkeypatch.setattr(simhash, "PARTITION_ROWS", rows)
    monkeypatch.setattr(simhash, "LOOKED_AT", 1)
    monkeypatch.setattr(simhash, "HOT_ROWS", 2)
    r = random.Random(12)
    table = [(7, 0), (None, 0b11), (9, 0b111111), (None, 1 << 63), (None, (1 << 63) - 1), (3, 0b111111)]
    for i in range(60):
        fp = r.getrandbits(64) if i % 3 else 0x5555555500000000 | r.getrandbits(10) << 3
        for j in range(4):
            table.append((r.choice([None, 100 + 9 * i + j]), fp))
            fp ^= sum(1 << b for b in r.sample(range(64), r.choice([2, 4, 5])))
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in table], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_, **__: df)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    want = slow_components([i for i, _ in table], [x for _, x in table])
    assert want[:3] == [3, 3, 3]
    assert got == Counter((i, f"{x:016x}", c) for (i, x), c in zip(table, want, strict=True))


def test_masks_cover_all_pairs():
    r = random.Random(13)
    for distance in (0, 1, 4, 7):
        for m in simhash.masks(distance)[:4]:
            finer = simhash.masks(distance, m)
            for _ in range(50):
                change = sum(1 << b for b in r.sample([b for b in range(64)], distance))
                assert any(not change & x for x in simhash.masks(distance))
                assert change & m or any(not change & x for x in finer)


@pytest.mark.parametrize("similarity", [0.5, 0.6, 0.8])
def test_recall_of_near_copies(spark, similarity):
    """Planted pairs at the threshold and above, against exact sets; scattered edits and edits at one end."""
    r, texts = random.Random(int(100 * similarity)), []
    for k in range(150):
        base = prose(r.choice([60, 200, 500]), 9000 + k)
        n = len(base.split())
        edits = max(1, int(n * (1 - similarity) / (1 + similarity) / 5 * r.choice([0.6, 0.95])))
        texts += [base, near(base, edits, k) if k % 3 else " ".join(base.split()[: int(n * (similarity + 0.03))])]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for t in texts for w in [t.split()]]
    true = [k for k in range(0, len(texts), 2) if len(grams[k] & grams[k + 1]) >= similarity * len(grams[k] | grams[k + 1])]
    got = dict(collected(simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), similarity)))
    found = sum(got[k] == got[k + 1] for k in true)
    print(f"near copies at {similarity}: {found} of {len(true)} pairs")
    assert len(true) > 80
    assert found >= 0.9 * len(true)
    assert all(got[k] == k for k in range(0, len(texts), 2))


def test_null_ids_bridge_near_copies(spark):
    a = prose(300, 71)
    b = near(a, 5, 1)
    c = " ".join([*b.split()[:280], *prose(20, 72).split()])
    texts = [a, b, c]
    table = [(7, a), (None, b), (9, c), (None, prose(80, 73)), (11, prose(90, 74))]
    assert slow_similar(texts) == [0, 0, 0]
    assert slow_similar([a, c]) == [0, 1]
    got = collected(simhash.similar_groups(spark.createDataFrame(table, "doc_id long, text string")))
    assert Counter(got) == Counter([(7, 7), (None, 7), (9, 7), (None, None), (11, 11)])


def test_copies_whatever_the_columns(spark):
    a = prose(80, 75)
    df = spark.createDataFrame([(1, a, 1, 2), (2, a, 3, 4), (3, None, 5, 6)], "doc_id long, text string, gone long, _c0 long").withColumnRenamed("gone", "_gone")
    got = simhash.without_copies(df)
    assert got.columns == df.columns
    assert Counter(collected(got)) == Counter([(1, a, 1, 2), (3, None, 5, 6)])


def test_gray_index_finds_all_pairs_and_blocks_do(spark, monkeypatch):
    base = np.random.default_rng(1).integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(x) for x in (0, 1, 3, 7, 15, 31, 1 << 40, 5 << 50)] + [np.arange(60, dtype=np.uint64)]))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    found = {(int(i), int(j)) for a, b in simhash.GrayIndex(fps, np.zeros(len(fps), np.int64)).pairs(4) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for j in range(len(fps)) for i in range(j) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    assert found == want
    # Many fingerprints with equal fields over several partitions: links come from blocks.
    near_zero = sorted({(1 << a) | (1 << b) | (1 << c) for a in range(64) for b in range(a) for c in range(0, b, 9)})
    rows = [(x if x < 1 << 63 else x - (1 << 64), n) for n, x in enumerate(near_zero)]
    monkeypatch.setattr(simhash, "BLOCK", 100)
    df = spark.createDataFrame(rows, "fp long, rep long")
    scratch = Scratch(spark, "t")
    links = simhash.links(df, 4, scratch)
    comp = {r.node: r.component for r in components.components(links, scratch).collect()}
    label = groups(len(rows), lambda a, b: (near_zero[a] ^ near_zero[b]).bit_count() <= 4) if len(rows) < 1500 else [0] * len(rows)
    assert [comp.get(i, i) for i in range(len(rows))] == label


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = dict(collected(components.components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark, "t"))))
    linked = set(pairs)
    label = groups(470, lambda a, b: (a, b) in linked or (b, a) in linked)
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {n: label[n] for n in nodes if label[n] != n}
    assert components.components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_similar_groups(docs, empty):
    kept = [r.doc_id for r in simhash.without_copies(docs).collect()]
    assert {20} == set(kept) & {20, 21, 22, 23, 24}
    assert {0, 5, 11, 30, 31, 32, 44, 50, None} <= set(kept)
    assert kept.count(None) == 2
    assert len([k for k in kept if k is not None]) == len({k for k in kept if k is not None})
    assert simhash.without_copies(empty).count() == 0
    assert simhash.without_copies(docs).columns == docs.columns


def slow_similar(texts, k=5, similarity=0.8):
    grams = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if (w := t.lower().split()) else set() for t in texts]
    return groups(len(texts), lambda a, b: len(grams[a] & grams[b]) >= similarity * len(grams[a] | grams[b]))


def variants(n, words=400, edits=7, seed=70):
    """``n`` loose variants of one text, then a near copy of each."""
    loose = [near(prose(words, seed), edits, 1000 + i) for i in range(n)]
    return loose + [near(t, 3, 5000 + i) for i, t in enumerate(loose)]


@pytest.mark.parametrize("block", [60_000])
def test_similar_groups_of_many_variants(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "SET_BYTES", block)
    texts = variants(200)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = dict(collected(simhash.similar_groups(df)))
    want = slow_similar(texts)
    assert len(set(want)) >= 100
    assert [got[i] for i in range(len(texts))] == want


def few_words(n=6, words=1500, vocabulary=12):
    r = random.Random(90)
    return [" ".join(r.choices(SYLLABLES[:vocabulary], k=words)) for _ in range(n)]


def test_equal_fingerprints_are_no_copies(spark):
    texts = few_words()
    assert len({tuple(simhash.wide_fingerprint(data(t), 2, simhash.LANES)) for t in texts}) == 1
    texts += [texts[2].upper(), "  " + texts[4]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = dict(collected(simhash.similar_groups(df)))
    assert [got[i] for i in range(8)] == slow_similar(texts) == [0, 1, 2, 3, 4, 5, 2, 4]


def test_repeated_ids_with_other_texts(spark):
    a, b, c = prose(100, 31), prose(100, 32), prose(100, 33)
    table = [(1, a), (1, b), (2, near(a, 1, 34)), (3, c), (3, c), (4, near(b, 1, 35)), (4, prose(100, 36))]
    kept = collected(simhash.without_copies(spark.createDataFrame(table, "doc_id long, text string")))
    assert Counter(kept) == Counter([table[0], table[1], table[3], table[6]])


# --- 2 ---


def slow_repeats(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                cover[p : p + length] = b"\1" * length
        out.append((len(t), sum(cover), len([x for x in bytes(cover).split(b"\0") if x]), hashlib.sha256(bytes(x for x, c in zip(t, cover, strict=True) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("contexts", [1, 512])
def test_suffix(docs, empty, monkeypatch, contexts):
    monkeypatch.setattr(suffix, "TASK_CONTEXTS", contexts)
    got = collected(suffix.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    want = [(i, *w) for (i, _), w in zip(ROWS, slow_repeats([data(t) for _, t in ROWS], 200), strict=True)]
    assert Counter(got) == Counter(want)
    assert suffix.remove_repeats(empty).count() == 0


def test_suffix_segments_and_refinement(monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 300)
    t = data(LONG[:3000])
    spans = suffix.pointers(t, 200)
    assert [p for *_, a, z in spans for p in range(a, z + 1)] == list(range(len(t) - 199))
    flags = suffix.refine([t[:300], b"x" + t[:250], b"y" * 200], 200)
    assert flags[0].tolist() == [i <= 50 for i in range(101)]
    assert flags[1].tolist() == [i > 0 for i in range(52)]
    assert flags[2].tolist() == [False]
    assert suffix.refine([b"y" * 201], 200)[0].tolist() == [True, True]


def test_refinement_against_counting():
    r = random.Random(21)
    for length, letters in ((5, "ab"), (8, "ab"), (9, "a"), (30, "ab"), (37, "abc"), (200, "ab")):
        base = "".join(r.choices(letters, k=600)).encode()
        contexts = []
        for _ in range(25):
            a = r.randrange(300)
            c = bytearray(base[a : a + length + r.randrange(60)])
            for _ in range(r.choice([0, 0, 1, 2])):
                c[r.randrange(len(c))] = r.choice(b"ab\0")
            contexts.append(bytes(c))
        seen = Counter(c[p : p + length] for c in contexts for p in range(len(c) - length + 1))
        got = suffix.refine(contexts, length)
        assert [g.tolist() for g in got] == [[seen[c[p : p + length]] > 1 for p in range(len(c) - length + 1)] for c in contexts]


def test_suffix_of_many_contexts(spark, monkeypatch):
    """One passage in many surroundings, in tasks and by tables."""
    r = random.Random(22)
    passage = prose(60, 23)
    texts = [prose(r.randint(1, 20)) + r.choice([" ", "\n"]) + passage + r.choice([" ", "; "]) + prose(r.randint(1, 20)) for _ in range(120)] + [passage[:-3]] * 2
    want = Counter((i, *w) for i, w in enumerate(slow_repeats([data(t) for t in texts], 200)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for contexts in (10, 512):
        monkeypatch.setattr(suffix, "TASK_CONTEXTS", contexts)
        assert Counter(collected(suffix.remove_repeats(df).drop("spans"))) == want


# --- 3 ---


def test_language(spark, empty):
    r = random.Random(5)
    kinds = {"aa": "ka lo mi".split(), "bb": "zu xi ött".split()}
    table = [(i, " ".join("".join(r.choices(kinds[k], k=3)) for _ in range(30)), k) for i in range(300) for k in [r.choice(list(kinds))]]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 !", "bb"), (None, "kalomi lomika", "aa"), (903, "kalo kami", None), (904, "zuxi " * 20000, None)]
    df = spark.createDataFrame(table + odd, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language.identify(df).collect()}
    assert all(got[i].lang_pred == k for i, _, k in table)
    assert [got[i].lang_pred for i in (900, 901, 902, 904)] == ["und", "und", "und", "bb"]
    assert got[900].score == 0
    assert all(0 <= x.score <= 1 for x in got.values())
    assert all(x.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items())
    # What is held out, or has no language, is never learned from.
    relabelled = [(i, t, "cc" if zlib.crc32(str(i).encode()) % 4 == 2 else k) for i, t, k in table]
    assert language.learn(spark.createDataFrame(relabelled, "doc_id long, text string, lang string")).langs == ["aa", "bb"]
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(df.where("lang is null")).collect()} == {"und"}


def test_language_letters_ties_and_dirty_labels(spark):
    r = random.Random(6)
    kinds = {"aa": "ka lo mi".split(), "bb": "zu xi ött".split()}
    table = [(i, " ".join("".join(r.choices(kinds[k], k=3)) for _ in range(20)), k) for i in range(120) for k in [r.choice(list(kinds))]]
    table += [(1000 + i, "odd " + prose(5, i), f"dirty{i}") for i in range(30)] + [table[0], table[0]]
    odd = ["½ ² ①", "ª", "ⅷ", "\u0345", "٣", "字"]
    df = spark.createDataFrame([*table, *[(2000 + i, t, None) for i, t in enumerate(odd)]], "doc_id long, text string, lang string")
    assert language.learn(df, most_langs=2).langs == ["aa", "bb"]
    got = defaultdict(list)
    for x in language.identify(df, most_langs=2).collect():
        got[x.doc_id].append((x.lang_pred, x.score))
    import unicodedata

    for i, t in enumerate(odd):
        assert (got[2000 + i][0][0] != "und") == any(unicodedata.category(c)[0] == "L" for c in t), t
    assert len(got[table[0][0]]) == 3
    assert len(set(got[table[0][0]])) == 1
    tie = language.Model(["aa", "bb"], np.zeros((language.DIM, 2), np.float32))
    assert {(x.lang_pred, x.score) for x in language.predict(df.limit(3), tie).collect()} == {("aa", 0.5)}
    # What no regression claims is not recognised; columns keep their names.
    other = spark.createDataFrame([(1, "kalomi lomika mikalo", 1), (2, "9%)(", 2), (3, None, 3), (4, "wvw vwv wwvv vvww wvwv", 4)], "doc_id long, text string, _lang_pred int")
    found = language.recognised(other, language.learn(df, most_langs=2))
    assert found.columns == other.columns
    assert {x.doc_id for x in found.collect()} >= {1}
    assert {x.doc_id for x in found.collect()} & {2, 3} == set()
    assert {x.doc_id for x in language.recognised(other, language.learn(df, most_langs=2), langs=["bb"]).collect()} & {1} == set()


def test_language_values_against_the_kernel():
    """The matrix product against kernel ridge regression with the kernel written out."""
    r = np.random.default_rng(9)
    langs = ["aa"] * 20 + ["bb"] * 30
    texts = [" ".join("".join(r.choice(list("abcd" if k == "aa" else "cdef"), 4)) for _ in range(12)).encode() for k in langs]
    sets = np.zeros((50, language.DIM), np.float32)
    for row, t in zip(sets, texts, strict=True):
        language.gram_set(t, row)
    model = language.fit(np.packbits(sets.astype(np.uint8), axis=1), langs, landmarks=50)
    common = np.array([[len(set(np.flatnonzero(a)) & set(np.flatnonzero(b))) / np.sqrt(a.sum() * b.sum()) for b in sets] for a in sets])
    # With all rows as landmarks Nyström is exact: weighted ridge regression in the kernel's own space.
    weight = np.array([1 / langs.count(k) for k in langs])
    weight /= weight.mean()
    target = np.where(np.array(langs) == "aa", 1.0, -1.0)
    alpha = np.linalg.solve(np.diag(weight) @ common + 1e-2 * 50 / 10 * np.eye(50), weight * target)
    assert np.allclose(model.scores(texts)[0][:, 0], common @ alpha, atol=2e-3)


def test_language_of_long_texts(spark):
    r = random.Random(15)
    kinds = {"aa": "abcdefghijklmé", "bb": "nopqrstuvwxyzö"}
    text = lambda k, n: " ".join("".join(r.choices(kinds[k], k=r.randint(3, 9))) for _ in range(n))
    table = [(i, text(k, 40), k) for i in range(200) for k in ["ab"[i % 2] * 2]] + [(900, text("aa", 400_000), None), (901, text("bb", 400_000), None)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language.identify(df).where("doc_id >= 900").collect()}
    assert [got[i].lang_pred for i in (900, 901)] == ["aa", "bb"]
    assert min(x.score for x in got.values()) > 0.95


# --- 4 ---


def test_tokens(docs, empty):
    import public_tokenizers

    tk = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    enc = tokens.span_encoder(tokens.default_ranks(), tokens.default_pattern())
    for _, t in ROWS:
        found = tk.encode(t or "", add_special_tokens=False)
        assert found.ids == enc.ids(t or "").tolist()
        # The tokenizer's own offsets are in characters; of a token within a character they cover it.
        points = np.concatenate([[0], np.cumsum((np.frombuffer(data(t), np.uint8) & 0xC0) != 0x80)])
        for (a, b), (x, y) in zip(found.offsets, _byte_spans(enc, t or ""), strict=True):
            assert a in (points[x], points[x] - 1)
            assert b == points[y]
    got = defaultdict(list)
    for r in tokens.count_tokens(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect():
        got[r.doc_id].append(r)
    for i, t in dict(ROWS).items():
        if i is None:
            continue
        parts = sorted(got[i], key=lambda r: r.section)
        assert sum(p.n_tokens for p in parts) == parts[0].doc_tokens == len(tk.encode(t or "", add_special_tokens=False).ids)
        assert "".join((t or "")[p.start : p.end] for p in parts) == (t or "")
        if t and t.isascii():
            want = Counter(next(k for k, p in enumerate(parts) if p.start <= a < p.end) for a, _ in _byte_spans(enc, t))
            assert [p.n_tokens for p in parts] == [want[k] for k in range(len(parts))]
    assert tokens.count_tokens(empty).count() == 0
    both = tokens.count_tokens(docs.where("doc_id = 44"), sections=["text", "lang"]).collect()
    assert [(b.start, b.end) for b in both] == [(0, 4), (4, 5)]


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_tokens_of_sections_against_bytes(spark, rule):
    """Every token's bytes are dealt one by one; lines and fields, null and repeated ids, any characters."""
    texts = ["a\n\nb  \n\n\n  c", "é\nßß ö\n", "字字\n\n\n字  \t\n 🙂🙂\n", "\n", "\n\n\n\n", None, "", "x" * 400 + "\n" + "y z\n" * 30]
    table = [(i if i % 3 else None, t, f"f{t or ''}\n") for i, t in enumerate(texts)] + [(1, texts[1], "again")]
    df = spark.createDataFrame(table, "doc_id long, text string, section string")
    enc = tokens.span_encoder(tokens.default_ranks(), tokens.default_pattern())

    def dealt(parts):
        whole = b"".join(parts)
        owner = [k for k, p in enumerate(parts) for _ in p]
        counts = [0] * len(parts)
        for a, z in _byte_spans(enc, whole.decode()):
            of = Counter(owner[a:z])
            counts[owner[a] if rule == "first" else owner[z - 1] if rule == "last" else min(of, key=lambda k: (-of[k], k))] += 1
        return counts

    lines = lambda t: [x.encode() for x in re.findall(r"[^\n]*\n|[^\n]+", t or "")] or [b""]
    want = Counter((i, k, n) for i, t, _ in table for k, n in enumerate(dealt(lines(t))))
    assert Counter((r.doc_id, r.section, r.n_tokens) for r in tokens.count_tokens(df, rule=rule).collect()) == want
    fields = lambda t, f: [data(t) + b"\n", data(f)]
    want = Counter((i, k, n) for i, t, f in table for k, n in enumerate(dealt(fields(t, f))))
    assert Counter((r.doc_id, r.section, r.n_tokens) for r in tokens.count_tokens(df, sections=["text", "section"], rule=rule).collect()) == want


def _byte_spans(enc, text):
    return list(zip(*[x.tolist() for x in enc.spans(text)], strict=True))


def test_crossing_tokens():
    starts, stops, sections = np.array([0, 3, 8]), np.array([3, 8, 9]), np.array([0, 4, 9])
    assert tokens.attribute(starts, stops, sections, "first").tolist() == [2, 1]
    assert tokens.attribute(starts, stops, sections, "last").tolist() == [1, 2]
    assert tokens.attribute(starts, stops, sections, "most").tolist() == [1, 2]
    with pytest.raises(ValueError):
        tokens.count_tokens(None, rule="none")


# --- 5 ---


def test_quality(spark, docs, empty):
    got = {r.doc_id: r for r in quality.judge(docs.where("doc_id is not null"), None).collect()}
    for i, t in dict(ROWS).items():
        if i is None:
            continue
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        cov = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[x] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov))
        assert r.base_failed == (len(w) < 50 or 100 * len(cov) > 50 * len(w))
        assert r.kept == (not r.base_failed)
    good = [(i, prose(60, i), 1) for i in range(150)]
    bad = [(i, " ".join(w + "&&&" for w in prose(60, i).split()), 0) for i in range(150, 300)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.learn(df.drop("quality"), df.drop("text"), per_class=60)
    out = {r.doc_id: r.kept for r in quality.judge(df, model).collect()}
    assert sum(out[i] == bool(y) for i, _, y in good + bad) >= 297
    assert quality.learn(empty, df.where("quality = 1")) is None
    assert quality.judge(empty, model).count() == 0


def test_quality_labels_and_calibration(spark):
    """Null, contradicting and repeated labels; probabilities follow the labels' shares."""
    r = random.Random(31)
    text = lambda i, y: " ".join(w + ("&&" if r.random() < (0.2 if y else 0.75) else "") for w in prose(70, 4000 + i).split())
    rows = [(i, text(i, i % 5 != 0), int(i % 5 != 0)) for i in range(900)]
    df = spark.createDataFrame([*rows, (None, "x " * 60, 1), (5000, None, 0), *rows[:50]], "doc_id long, text string, quality int")
    labels = df.select("doc_id", "quality").unionByName(spark.createDataFrame([(3, 0), (4, None), (None, 1), (7, 1), (7, 1), (6000, 5)], "doc_id long, quality int"))
    model = quality.learn(df.drop("quality"), labels, per_class=150)
    again = quality.learn(df.drop("quality").repartition(7), labels, per_class=150)
    assert np.array_equal(model.weights, again.weights)
    got = quality.judge(df.drop("quality"), model).collect()
    assert len(got) == df.count()
    p = {x.doc_id: x.probability for x in got}
    assert abs(np.mean([p[i] for i, *_ in rows]) - 0.8) < 0.06
    assert sum((p[i] >= 0.5) == bool(y) for i, _, y in rows) >= 860
    assert {x.kept for x in got if x.doc_id == 5000} == {False}
    assert len({(x.doc_id, x.probability) for x in got if x.doc_id is not None}) == 901


def test_quality_grams_are_of_characters(monkeypatch):
    want = defaultdict(Counter)
    texts = ["é ßé é", "字字字字", "ab ab"]
    for t in texts:
        for kind, n in ((2, 3), (3, 4), (4, 5)):
            want[t][kind] = len({t[i : i + n] for i in range(len(t) - n + 1)})
    for t in texts:
        got = {kind: len(set(places.tolist())) for kind, places in quality.grams(t.encode())}
        assert all(got.get(kind, 0) == want[t][kind] for kind in (2, 3, 4))
        assert got[0] == len(set(t.split()))
    # Segments end between words, or characters.
    monkeypatch.setattr(quality, "SEGMENT", 37)
    t = " ".join(prose(40, 32).split()) + " " + "字" * 40
    assert sum(len(x) for kind, x in quality.grams(t.encode()) if kind == 0) in (41, 42, 43, 44)


def test_quality_grams_across_segments(monkeypatch):
    """Whatever the segments, the n-grams are those of the whole text."""
    texts = [prose(40, 33).encode(), "字é \n ß字 a".encode() * 9, b"x" * 90, b" " * 40 + b"a  b", b"ab \xff\x80\x80\x80 c\xe5\xad", b"\x80" * 50, b"", b"a"]

    def got(t):
        found = defaultdict(Counter)
        for kind, places in quality.grams(t):
            found[kind].update(places.tolist())
        return {kind: c for kind, c in found.items() if c}

    want = [got(t) for t in texts]
    for size in (1, 2, 3, 4, 5, 7, 16, 37):
        monkeypatch.setattr(quality, "SEGMENT", size)
        assert [got(t) for t in texts] == want


def test_quality_learns_from_whole_texts(spark, monkeypatch):
    """Long texts that differ only in some places, between those of eight parts of 8 KB."""
    same = prose(4000, 34)[:9000]
    r = random.Random(35)

    def text(y):
        gap = " ".join(w + ("" if y else "&&") for w in r.choices(prose(300, 36).split(), k=2000))[:11000]
        return (same[200:] + gap + same[:200]) * 8

    rows = [(i, text(i % 2), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    model = quality.learn(df.drop("quality"), df.drop("text"), per_class=60)
    out = {x.doc_id: x.probability >= 0.5 for x in quality.judge(df, model).collect()}
    assert sum(out[i] == bool(y) for i, _, y in rows) >= 58
    # In memory or in a file, in one batch or many, rows and weights are the same.
    for name in ("HELD", "BATCH"):
        monkeypatch.setattr(quality, name, 1000)
    monkeypatch.setattr(quality, "SENT", 300_000)
    assert np.array_equal(quality.learn(df.drop("quality"), df.drop("text"), per_class=60).weights, model.weights)


def test_quality_features_are_exact():
    t = ("a " * 300 + prose(3000, 37) + " 字字字").encode()
    counts = np.zeros(len(quality.KINDS) * quality.DIM)
    for kind, places in quality.grams(t):
        np.add.at(counts, places.astype(int) + kind * quality.DIM, 1)
    at, x = quality._shares(quality._features(t))
    shares = counts.reshape(len(quality.KINDS), -1) / counts.reshape(len(quality.KINDS), -1).sum(axis=1, keepdims=True)
    assert np.array_equal(at, np.flatnonzero(counts)) and np.array_equal(x, shares.ravel()[at].astype(np.float32))
    assert [len(z) for z in quality._shares(quality._features(b""))] == [0, 0]
    assert quality._shares(quality._features(b"a"))[1].tolist() == [1.0]


# --- 6 ---


@pytest.mark.parametrize("part", [100, 10**6])
def test_decontaminate(spark, docs, empty, part):
    words = PASSAGE.split()
    items = [(1, " ".join(words[5:18]).upper() + "!"), (2, "one"), (3, None), (4, "- -"), (5, prose(14, 99)), (10, " ".join(words[30:33])), (None, words[50]), (6, "é ß STRAßE"), (1, " ".join(words[40:52])), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    got = collected(decontaminate.decontaminate(docs, bench, part_bytes=part).drop("spans"))
    want = []
    for i, t in ROWS:
        w = norm(t)
        hit, found = set(), set()
        for name, x in items:
            v = norm(x)
            for win in {tuple(v[k : k + 10]) for k in range(max(1, len(v) - 9))} if v else ():
                for p in range(len(w) - len(win) + 1):
                    if tuple(w[p : p + len(win)]) == win:
                        hit |= set(range(p, p + len(win)))
                        found |= {str(name)} if name is not None else set()
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(found), digest, bool(hit)))
    assert Counter(got) == Counter(want)
    clean = decontaminate.clean(docs, bench, part_bytes=part)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(x[0] for x in want if not x[5])
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_automaton_against_windows(monkeypatch):
    """Random texts and items over few words, stretches and pieces cut short."""
    for name, size in (("WORDS", 50), ("STEPS", 7), ("SEGMENT", 40)):
        monkeypatch.setattr(decontaminate, name, size)
    r = random.Random(66)
    for window in (1, 2, 4, 10):
        say = lambda n: " ".join(r.choices(SYLLABLES[:4], k=n)).encode()  # noqa: E731, B023
        items = [(str(i % 7), say(r.randint(0, 14))) for i in range(12)] + [(None, say(3))]
        texts = [say(r.choice([0, 1, 5, 60])) for _ in range(20)] + [b"zz " * 5 + items[0][1]]
        auto = decontaminate.Automaton(items, window)
        got = auto.scan([auto.ids(t) for t in texts])
        for t, (hit, found) in zip(texts, got, strict=True):
            w, covered, names = t.split(), set(), set()
            for name, x in items:
                v = x.split()
                for k in range(max(1, len(v) - window + 1)) if v else ():
                    for p in range(len(w)):
                        if w[p : p + len(v[k : k + window])] == v[k : k + window]:
                            covered |= set(range(p, p + len(v[k : k + window])))
                            names |= {name} - {None}
            assert (hit.tolist(), found) == (sorted(covered), names)


def test_decontaminate_by_a_benchmark_of_megabytes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 500)
    r = random.Random(67)
    words = [f"w{i}" for i in range(20_000)]
    items = [(i // 2, " ".join(r.choices(words, k=n))) for i, n in enumerate([1000] * 400 + [100_000])]
    cut = lambda i, a, n: " ".join(items[i][1].split()[a : a + n])
    texts = [prose(50, 1), cut(3, 200, 9), cut(3, 990, 10), "x " + cut(400, 490, 30) + " y", cut(17, 0, 500) + " " + cut(390, 7, 10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sum(len(t) for _, t in items) > 2_500_000
    for part in (8 << 20, 1 << 20):
        got = {x.doc_id: (x.n_hit, x.n_items, x.items_sha256) for x in decontaminate.decontaminate(df, bench, part_bytes=part).collect()}
        sha = lambda *names: hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        assert got == {0: (0, 0, sha()), 1: (0, 0, sha()), 2: (10, 1, sha(1)), 3: (30, 1, sha(200)), 4: (510, 2, sha(8, 195))}


def test_spans_map_to_the_original():
    text = "É, Words-HERE\nand there".encode()
    assert [text.decode()[a:b] for a, b in decontaminate.char_spans(text, [1, 2, 4])] == ["Words-HERE", "there"]


# --- 7 ---


def test_packing(docs, empty):
    got = packing.pack(docs).collect()
    tk = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    want = Counter((i, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for i, t in ROWS for ids in [tk.encode(t or "", add_special_tokens=False).ids])
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for pieces in fill.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1].tolist()]
        total = sum(n for _, n in pieces)
        assert total <= 4096
        assert total & (total - 1) == 0  # full, or a power of two
    whole = Counter((r.doc_id, r.length, r.ids_crc32) for r in got if r.length == r.doc_tokens)
    assert not whole - want
    tokens_of = Counter()
    for r in got:
        tokens_of[r.doc_id] += r.length
    expect = Counter()
    for (i, n, _), k in want.items():
        expect[i] += n * k
    assert tokens_of == expect
    long = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 50)
    ids = np.array([*tk.encode(LONG, add_special_tokens=False).ids, 2], "<u4")
    assert [s for s, _, _ in long] == [0, *np.cumsum([n for _, n, _ in long])[:-1].tolist()]
    assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in long)
    assert packing.pack(empty).count() == 0


def test_level_choice():
    p = packing._Packer(10, 99, 0)
    p.add(1, np.zeros(6, np.uint32))
    assert p.level_for(4) == 6  # fills a window
    p.add(2, np.zeros(4, np.uint32))
    assert p.n_open == 0
    p.add(3, np.zeros(25, np.uint32))
    assert len(p.rows) == 4
    assert p.open[5]


def test_final_filling_moves_little():
    """Sum-of-squares places nearly all tokens: the end of a task moves less than a twentieth."""
    draw = np.random.default_rng(11)
    for docs_of_task in (500, 2000):
        lens = np.minimum(draw.lognormal(6.4, 0.8, docs_of_task).astype(int) + 2, 9000)
        p = packing._Packer(4096, 2048, 0)
        for i, n in enumerate(lens):
            p.add(i, np.zeros(n, np.uint32))
        p.finish(last=True)
        print(f"moved at the end of a task of {docs_of_task} documents: {p.moved / lens.sum():.2%}")
        assert p.moved < 0.05 * lens.sum()
        fill = Counter()
        for _, _, n, _, _, seq, _ in p.rows:
            fill[seq] += n
        assert sum(fill.values()) == lens.sum()
        assert sum(n != 4096 for n in fill.values()) <= 12
    few = packing._Packer(64, 3, 0)
    for i in range(200):
        few.add(i, np.arange(1 + i % 50, dtype=np.uint32))
        assert few.n_open <= 4
    few.finish(last=True)
    got = defaultdict(list)
    for doc, start, n, _, total, _, _ in few.rows:
        got[doc].append((start, n, total))
    assert all(sum(n for _, n, _ in v) == v[0][2] and sorted(v)[0][0] == 0 for v in got.values())
    assert len(got) == 200


def test_word_encoder_equals_tokenizer():
    tk = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    texts = [t for _, t in ROWS] + ["don't we'll 's '", "ΑΣ ΟΔΟΣ ὀ", "İstanbul ǅ ﬁ", "́e é", "a²b ½ ٣", "_x_ __", "naïve…“q”–€"]
    for t, ids in zip(texts, packing.encoder(packing.default_tokenizer()).encode(texts), strict=True):
        assert tk.encode(t or "", add_special_tokens=False).ids == ids.tolist(), t


# --- 8 ---


def slow_ends(text):
    """Chunk ends byte by byte, with a gear table of its own."""
    gear, x = [], 8 * 0x9E3779B97F4A7C15 + 1
    for _ in range(256):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        gear.append(x >> 32)
    ends, at, h = [], 0, 0
    for i, byte in enumerate(text):
        h = ((h << 1) + gear[byte]) & 0xFFFFFFFF
        size = i + 1 - at
        if size == 256 or size >= 24 and h >> 27 == 0:
            at = i + 1
            ends.append(at)
    return ends + [len(text)] * (at < len(text))


def slow_dedup(table):
    """What stays of each (id, text): later copies of chunks go, in runs of 64 bytes and more."""
    seen, out = set(), {}
    for i, t in sorted(set(table), key=lambda r: (-(2**63) if r[0] is None else r[0], _text_hash(r[1]))):
        b, ends, kept, run = data(t), slow_ends(data(t)), bytearray(), [0, 0]
        spans = []
        for a, z in zip([0, *ends], ends, strict=False):
            if b[a:z] in seen:
                if spans and spans[-1][1] == a:
                    spans[-1][1] = z
                else:
                    spans.append([a, z])
            seen.add(b[a:z])
        at = 0
        whole = lambda p: next(q for q in range(p, p + 4) if q >= len(b) or b[q] & 0xC0 != 0x80)  # noqa: E731, B023
        for a, z in [*([whole(x), whole(y)] for x, y in spans if y - x >= 64), [len(b), len(b)]]:
            kept += b[at:a]
            at = z
        out[i, t] = bytes(kept)
    return out


def _text_hash(t):
    """Spark's xxhash64 of a string, which orders rows of one id."""
    import xxhash

    h = xxhash.xxh64_intdigest(data(t), 42)
    return h - (1 << 64) if h >> 63 else h


def test_chunks_against_bytes(spark):
    table = [*ROWS, (20, COPY + " x"), (20, COPY), (70, "字" * 500), (71, "a" + "字" * 500)]
    df = spark.createDataFrame([(i, t, 1) for i, t in table], "doc_id long, text string, _t int").repartition(3)
    want = slow_dedup(table)
    got = collected(chunks.dedup(df).select("doc_id", "n_bytes", "n_removed", "text"))
    assert Counter(got) == Counter((i, len(data(t)), len(data(t)) - len(want[i, t]), want[i, t].decode()) for i, t in table)




def test_chunks(docs, empty):
    got = {r.doc_id: r for r in chunks.dedup(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    table = {i: data(t) for i, t in ROWS if i is not None}
    seen, want = set(), {}
    for i in sorted(table):
        b, spans = table[i], []
        ends = chunks.cut_places(b)
        assert b"".join(b[a:z] for a, z in zip([0, *ends], ends, strict=False)) == b
        for a, z in zip([0, *ends], ends, strict=False):
            if b[a:z] in seen:
                if spans and spans[-1][1] == a:
                    spans[-1][1] = z
                else:
                    spans.append([a, z])
            seen.add(b[a:z])
        want[i] = sum(z - a for a, z in spans if z - a >= chunks.RUN_BYTES)
    assert {i: r.n_removed for i, r in got.items()} == want
    assert got[21].n_removed > 0
    assert got[31].n_removed > 100
    assert got[0].n_removed == 0
    kept = chunks.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(ROWS)
    assert kept.where("doc_id = 40 and text is null").count() == 1
    assert chunks.dedup(empty).count() == 0


def test_chunks_resist_shifts():
    b = data(LONG[:20_000])
    cut = lambda t: {t[a:z] for a, z in zip([0, *chunks.cut_places(t)], chunks.cut_places(t), strict=False)}
    a, c = cut(b), cut(b[:500] + b"inserted" + b[500:])
    assert len(a & c) >= len(a) - 8
    assert max(map(len, a)) <= chunks.MOST


@pytest.mark.parametrize("words", [51, 55, 60])
def test_chunks_catch_short_passages(spark, words):
    table = []
    for k in range(200):
        passage = prose(words, 3000 + k)
        table += [(2 * k + d, " ".join([prose(60), passage, prose(60)])) for d in (0, 1)]
    got = {r.doc_id: r.n_removed for r in chunks.dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] > 0 for k in range(200)) >= 194
    assert sum(got[2 * k] > 0 for k in range(200)) == 0


# --- 9 ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><nav><li>Home</nav><div class="cookie-notice">We use</div>
<script>var x="</p>";</script><div class="widget-x"><p>Top story %d</div><article><header><h1>Head &amp; line %d</h1></header><p>First <b>bold<br>text %d<p>Second&nbsp;&lt;x&gt; %d
<aside>no</aside><form>no</form></article><div class="comments"><article class="comment">me too</article></div><footer>&copy; all</footer>"""


def test_html(spark):
    pages = [(i, f"http://h{i % 2}.example.org/{i}", PAGE % (i, i, i, i)) for i in range(20)]
    plain = "<body><div class='box'><p>Same words on each page</p></div><div class='col'><p>Own text %d here</p></div></body>"
    pages += [(100 + i, "http://plain.example.org/x", plain % i) for i in range(12)]
    pages += [(200, None, None), (201, "bad url", ""), (202, "http://a.b/", "<p>a<p>b &#233; &amp"), (203, "x", "<div>cut <a hre"), (None, "http://a.b/", "one")]
    pages += [(300, "http://big/", "<article>" + "<p>%s</p>" % prose(20_000, 12) + "</article>")]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[3].text == "Head & line 3\nFirst bold text 3\nSecond <x> 3"
    assert got[105].text == "Own text 5 here"
    assert got[200].text == got[201].text == ""
    assert got[202].text == "a\nb é &"
    assert got[203].text == "cut"
    assert got[None].text == "one"
    assert len(got) == len(pages)
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract(df.limit(0)).count() == 0
    assert html.unescape("&am") == "&am"


def html_pages():
    """Hosts with boilerplate that only entropy tells, pages with copies, and a host too small for a tree of its own."""
    out = []
    for i in range(40):
        ad = f'<div class="ad">{prose(6, 700 + i)}</div>'
        box = "<div class='inner'><p>Read more of us each week</p></div>" if i % 2 else ""
        paragraphs = "".join(f"<p>{prose(20, 800 + 9 * i + k)}</p>" for k in range(1 + i % 5))
        out.append((i, f"http://a.example/{i}", f"<body><nav>{prose(4)}</nav>{ad}<article><h1>{prose(4, 900 + i)}</h1>{paragraphs}<p>Read more of us each week</p>{box}</article></body>"))
    out += [(100 + i, "http://a.example/c", out[7][2]) for i in range(30)]  # copies of one page
    out += [(200 + i, f"http://small{i}.example/", f'<body><div class="ad">{prose(6, 1000 + i)}</div><article><h1>{prose(3, 1100 + i)}</h1><p>{prose(9, 1200 + i)}</p></article></body>') for i in range(6)]
    return out


def slow_importance(pages, host, wanted):
    """Entropies by counting: of how pages show each path, and of the blocks below it."""
    import math

    shown, under, keys = defaultdict(dict), defaultdict(lambda: defaultdict(set)), {}
    for n, (_, url, source) in enumerate(pages):
        if html_text.host_of(url) == host:
            page = html_text.Page(source)
            keys.setdefault(page.key(), n)
            if keys[page.key()] != n:
                continue
            for node, main, kind, feature in page.features():
                if kind == 0:
                    shown[node, main][n] = feature
                else:
                    under[node, main][feature].add(n)
    out = {}
    for at, by_page in shown.items():
        m = len(by_page)
        if m >= wanted and at in under:
            entropy = -sum(c / m * math.log(c / m, m) for c in Counter(by_page.values()).values())
            spread = [len(p) for p in under[at].values()]
            out[at] = (m, entropy, 1 - sum(n * math.log(n, m) for n in spread) / sum(spread))
    return out


def test_style_tree_against_counting(spark):
    pages = html_pages()
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    nodes, blocks, over = html_text.style_tree(df, Scratch(spark, "t"))
    got = {(r.node, r.main): (r.pages, r.style, r.content) for r in nodes.where("host = 'a.example'").collect()}
    want = slow_importance(pages, "a.example", 8)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert {r.pages for r in nodes.collect()} <= {20, 40}  # copies of a page count once
    assert blocks.count() == 2  # the repeated paragraph, as one and within the box
    assert over.count() >= 1


def test_html_by_entropy(spark):
    pages = html_pages()
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    for i, _, source in pages:
        article = re.search("<article>(.*?)</article>", source)[1].replace("<div class='inner'><p>Read more of us each week</p></div>", "").replace("<p>Read more of us each week</p>", "")
        assert got[i] == "\n".join(x for x in re.split("</?[^>]*>", article) if x)


def test_html_share_that_the_tree_changes(spark):
    import os

    if not os.path.exists("/root/testdata/sf0.1/pages.parquet"):
        pytest.skip("no test tables")
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    with_tree = dict(collected(html_text.extract(df).select("page_id", "text")))
    without = dict(collected(html_text.extract(df, tree=False).select("page_id", "text")))
    share = sum(with_tree[k] != without[k] for k in without) / len(without)
    print(f"pages of sf0.1 whose text the style tree changes: {share:.1%}")
    assert share > 0.3


def test_html_markup_is_a_prior(spark):
    cases = [
        ("<article><p>Let <math><mi>x</mi></math> be</p></article>", "Let x be"),
        ('<article><h2>T</h2><section class="related-work"><p>Earlier</p></section><section id="discussion"><p>We see</p></section></article>', "T\nEarlier\nWe see"),
        ('<div class="content"><p>A long body of the page itself</p></div><article class="teaser"><p>Short</p></article>', "A long body of the page itself\nShort"),
        ('<div class="comments"><article class="comment"><p>me too</p></article></div><p>Text</p>', "Text"),
        ("<p>Price <span hidden>was <b>9</b> then </span>now</p>", "Price now"),
        ('<div class="has-comments"><article><p>Kept</p></article></div>', "Kept"),
        ("<div>" * 2000 + "deep", "deep"),
        ("<header>no</header><p>a<br>b<p>c <svg><text>no</text></svg>d", "a b\nc d"),
    ]
    rows = [(i, f"http://h{i}/", h) for i, (h, _) in enumerate(cases)]
    df = spark.createDataFrame([*rows, rows[0], (None, None, "<p>x")], "page_id long, url string, html string")
    got = collected(html_text.extract(df).select("page_id", "text"))
    assert Counter(got) == Counter([*((i, t) for i, (_, t) in enumerate(cases)), (0, cases[0][1]), (None, "x")])


# --- 10 ---


def test_arc_forms():
    body = b"<html>\n\nx</html>"
    for v in (1, 2):
        arc = archive.arc_version_block(v) + archive.arc_record(v, "http://a b/", "20010203", body) + archive.arc_record(v, "http://c/", "20010203040506", b"")
        found = list(archive.parse_arc(arc))
        assert [f["URL"] for f in found] == ["http://a%20b/", "http://c/"]
        assert found[0]["block"].endswith(body)
    assert archive.timestamp("20010203040506") == "2001-02-03T04:05:06Z"
    assert archive.timestamp("20010203") == "2001-02-03T00:00:00Z"
    with pytest.raises(ValueError):
        list(archive.parse_arc(arc[:-30]))
    rec = archive.to_warc(found[0], "k")
    (h, block), = archive.parse_warc(rec + b"\r\n\r\n")
    assert h["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
    assert block == found[0]["block"]


def test_arc_files_of_others():
    """ARC bytes written by hand: dates of 12 digits, CRLF line ends, blanks in a URL, bodies with blank lines, no final line end."""
    head = b"1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n"
    a = b"HTTP/1.0 200 Document follows\r\nContent-Type: text/html\r\n\r\n<HTML>\n\nhttp://not.a/record 1.2.3.4 19990101 text/html 5\n</HTML>"
    b = b"HTTP/1.1 404 Not Found\r\n\r\n"
    arc = b"filedesc://x.arc 0.0.0.0 19960923142103 text/plain %d\r\n%s" % (len(head), head)
    arc += b"\n\nhttp://www.dryswamp.edu:80/index page.html 127.10.100.2 199611041421 text/html %d\n%s\n" % (len(a), a)
    arc += b"http://b/ 127.0.0.1 1997 no-type %d\n%s" % (len(b), b)
    found = list(archive.parse_arc(arc))
    assert [(f["URL"], f["Archive-date"], f["block"]) for f in found] == [("http://www.dryswamp.edu:80/index%20page.html", "199611041421", a), ("http://b/", "1997", b)]
    (h, block), (h2, block2) = archive.parse_warc(b"".join(archive.to_warc(f, str(f["at"])) + b"\r\n\r\n" for f in found))
    assert (h["WARC-Type"], h["WARC-Date"], block) == ("response", "1996-11-04T14:21:00Z", a)
    assert h["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(a.split(b"\r\n\r\n", 1)[1]).hexdigest()
    assert h["WARC-Block-Digest"] == "sha1:" + hashlib.sha1(a).hexdigest()
    assert block2 == b
    assert h["WARC-Record-ID"] != h2["WARC-Record-ID"]
    two = b"2 0 crawler\n" + archive.ARC_FIELDS[2].encode() + b"\n"
    arc = b"filedesc://y.arc 0.0.0.0 2001 text/plain 200 - - 0 y.arc %d\n%s\nhttp://c/ 1.2.3.4 20010203040506 text/html 200 sum - 99 y.arc %d\n%s\n" % (len(two), two, len(a), a)
    assert [f["Offset"] for f in archive.parse_arc(arc)] == ["99"]
    with pytest.raises(ValueError, match="unknown fields"):
        list(archive.parse_arc(arc.replace(b"Checksum", b"Sum")))


def test_warc_of_repeated_and_null_ids(spark):
    big, other = "y" * 1500, "z" * 1500
    pages = [(None, "u", big), (1, "u", big), (1, "u", big), (None, "u", "small"), (0, "u", big), (2, "u", other), (2, None, big[:1200]), (None, None, None), (None, "u", other[:1300]), (None, "u", other[:1300])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archive.archive_pages(df).collect())
    assert got == Counter([
        (None, 1500, "response", None), (1, 1500, "response", None), (1, 1500, "response", None), (None, 5, "response", None), (0, 1500, "revisit", 1),
        (2, 1500, "response", None), (2, 1200, "response", None), (None, 0, "response", None), (None, 1300, "response", None), (None, 1300, "response", None),
    ])


def test_warc_round_trip(spark):
    big = "x\r\n\r\ny" * 300
    pages = [(1, "u", big), (2, None, big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", "é" * 600), (8, "u", LONG), (9, "u", big + "z"), (10, "u v", "é" * 600)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    got = {r.page_id: r for r in archive.archive_pages(df).collect()}
    assert len(got) == len(pages)
    for i, _, h in pages:
        b = data(h)
        same = [j for j, _, x in pages if data(x) == b and len(b) >= 1000]
        top = max(same, default=i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", top) if top != i else ("response", None))
        assert r.valid
    assert archive.archive_pages(df.limit(0)).count() == 0


# --- the pipeline ---


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    items = [(1, " ".join(prose(14, 8).split()[:12]))]
    table = [(i, t, "k", "s", len(t or "")) for i, t in ROWS if i is not None and i != 24]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    contaminated = (60, prose(50, 61) + " " + items[0][1] + " " + prose(50, 62), "k", "s", 1)
    spark.createDataFrame([contaminated], "doc_id long, text string, lang string, source string, n_chars long").write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id for r in cp.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert {40, 41, 42, 43} & out == set()  # no language
    assert {20, 21, 22, 23} & out == {20}  # copies
    assert 60 not in out  # contaminated
    assert {0, 5, 11, 30, 31, 32, 44} <= out
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cut = {r.doc_id: r.text for r in cp.cut_repeats(spark, docs, str(tmp_path)).collect()}
    words = set(PASSAGE.split())
    assert len(words & set(cut[31].split())) < len(words)
    assert cut[30] == dict(ROWS)[30]


def test_pipeline_against_brute_force(spark, tmp_path):
    """The whole run on a group of variants, copies, repeats, contaminated texts, and rows of no language."""
    import corpus_pipeline as cp

    r = random.Random(41)
    other = lambda n, seed: " ".join("".join(random.Random(seed + k).choices("zug xif ött wur".split(), k=2)) for k in range(n))
    table = [(i, prose(80, 5000 + i), "ka") for i in range(40)] + [(100 + i, other(80, 100 * i), "zu") for i in range(40)]
    base = prose(300, 42)
    table += [(200 + i, near(base, r.choice([2, 25]), i), None) for i in range(30)]
    passage = prose(90, 43)
    table += [(300 + i, prose(40, 6000 + i) + " " + passage + " " + prose(40, 6100 + i), "ka") for i in range(4)]
    item = prose(14, 44)
    table += [(310, prose(50, 45) + " " + item, "ka"), (311, item.upper(), None), (312, None, "ka"), (313, "", "ka"), (314, "12 ½", "zu"), (None, prose(60, 46), "ka"), (None, table[0][1], "ka"), (5, table[5][1], "ka")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _gone int, _lang_pred int"
    docs = spark.createDataFrame([(i, t, k, "s", len(t or ""), 1, 2) for i, t, k in table], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = language.learn(docs)
    claimed = lambda t: bool(t) and any(c.isalpha() for c in t) and model.scores([t.encode()])[0].max() > 0
    left = [(i, t) for i, t, _ in table if claimed(t)]
    assert len(left) >= 115
    label = slow_similar([t for _, t in left])
    first: dict = {}
    for (i, t), x in zip(left, label, strict=True):
        if i is not None:
            first[x] = min(first.get(x, (i, _text_hash(t), t)), (i, _text_hash(t), t))
    left = [(i, t) for i, t in dict.fromkeys(left) if i is None or any(f[0] == i and f[2] == t for f in first.values())]
    cut = slow_dedup(left)
    left = [(i, cut[i, t].decode()) for i, t in left if cut[i, t].strip()]
    grams = lambda t: {tuple(w[k : k + 10]) for w in [t.lower().split()] for k in range(len(w) - 9)}
    left = [(i, t) for i, t in left if not grams(t) & grams(item)]
    tk = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    want = Counter((i, len(tk.encode(t, add_special_tokens=False).ids) + 1) for i, t in left)
    got = Counter()
    for x in cp.run(spark, str(tmp_path)).collect():
        got[x.doc_id, x.doc_tokens] += x.length
    assert got == Counter({k: k[1] * n for k, n in want.items()})


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
