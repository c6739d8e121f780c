"""Alignment, SimHash groups and vector codes against plain Python: nulls, empty and long texts, copies, ties, clashing columns, empty tables."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from gaugework.llm import alignment, simhash, vector_codes  # noqa: E402
from gaugework.session import ship_package  # noqa: E402

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def make_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["th", "an", "er", "on", "ö", "ß", "in", "日", "12", "."]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(300)
    words = base.split(" ")
    near = []
    for k in range(1, 10):
        w = list(words)
        for _ in range(k):
            w[rng.randrange(len(w))] = word()
        near.append(" ".join(w))
    odd = [None, "", " ", "\t\n", "a", "A", "one two", "One  TWO", "x  y\n\n z\t", "<s> </s> <|endoftext|> x", "a▁b", "\x00 \x01", "é é    x", "  lead", "trail  ", "a\n b\r\n c", " " * 12000 + "z" * 3000 + "\n" * 12000, "👩‍👩‍👧 𝒳 �", "don't we'LL 's", "word " * 5000]
    return [*odd, base, base, base.upper(), *near, prose(4000), *(prose(rng.randint(1, 60)) for _ in range(30))]


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    rows = [(i if i != 30 else None, t, i, "clash", 1.0) for i, t in enumerate(TEXTS)]
    rows += [(40, TEXTS[40], -1, "again", 2.0), (41, "another text of an id that is there twice", -2, "again", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a long, block string, mark double").repartition(3)


def source_rows():
    rows = [(i if i != 30 else None, t) for i, t in enumerate(TEXTS)]
    return rows + [(40, TEXTS[40]), (41, "another text of an id that is there twice")]


def test_stretches():
    rng = random.Random(3)
    for _ in range(400):
        m, p, q = rng.randint(0, 80), rng.random(), rng.random()
        a, b = ([i for i in range(1, m + 1) if rng.random() < x] for x in (p, q))
        i, j = alignment.common_ends(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
        assert [a[k] for k in i] == sorted(set(a) & set(b)) == [b[k] for k in j]
    same = np.arange(1, 100_001)
    assert [x.tolist() for x in alignment.matched(same, same)] == [[0], [0], [100_000]]  # one stretch, not one token at a time
    longer = np.concatenate([np.arange(1, 501), [600], np.arange(601, 1001)])
    split = np.concatenate([np.arange(1, 501), [550, 600], np.arange(601, 1001)])
    assert [x.tolist() for x in alignment.matched(longer, split)] == [[0, 500], [0, 501], [500, 401]]  # the shift grows by one


def aligned_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    side_a = Tokenizer.from_file(PATHS[0])
    side_a.encode_special_tokens = True
    side_b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shown = alignment.shown_bytes()
    length = lambda p: 1 if len(p) == 6 and p.startswith("<0x") else len(p.replace("▁", " ").encode())
    links, texts = collections.Counter(), []
    for key, text in rows:
        a = side_a.encode(" " + text, add_special_tokens=False) if text else None
        ids_b = side_b.encode(text) if text else []
        raw_a = b"".join(bytes(shown[c] for c in t) for t in a.tokens) if text else b""
        raw_b = b"".join(bytes([int(p[3:5], 16)]) if length(p) == 1 and len(p) == 6 else p.replace("▁", " ").encode() for p in map(side_b.id_to_piece, ids_b))
        if not text or not raw_a == raw_b == (" " + text).encode():
            texts.append((key, [], [], []))
            continue
        ends_a = np.cumsum([len(t) for t in a.tokens]).tolist()
        ends_b = np.cumsum([length(side_b.id_to_piece(i)) for i in ids_b]).tolist()
        at_a, at_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
        common = sorted(at_a.keys() & at_b.keys())
        groups, i, j = [], 0, 0
        for e in common:
            groups.append((a.ids[i : at_a[e] + 1], ids_b[j : at_b[e] + 1]))
            i, j = at_a[e] + 1, at_b[e] + 1
        pairs = [(x[-1], y[-1]) for x, y in groups]
        links.update(pairs)
        texts.append((key, groups, a.ids, ids_b))
    best = collections.defaultdict(int)
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    out = []
    for key, groups, ids_a, ids_b in texts:
        pairs = [(x[-1], y[-1]) for x, y in groups]
        shown_groups = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(links[p] == best[p[1]] for p in pairs)
        out.append((key, len(ids_a), len(ids_b), len(groups), len(pairs), n_best, sum(links[p] for p in pairs), hashlib.sha256(shown_groups.encode()).hexdigest() if groups else ""))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("block_bytes", [5 << 20, 900])
def test_op11(docs, monkeypatch, block_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    got = alignment.aligned_digests(docs, *PATHS)
    want = aligned_by_hand(source_rows())
    assert ordered(got.collect()) == ordered(want)
    assert sum(r[1] == 0 for r in want) >= 3 and sum(r[1] > 0 for r in want) > 40


def test_op11_empty(docs):
    empty = alignment.aligned_digests(docs.filter("false"), *PATHS)
    assert empty.count() == 0 and empty.columns[-1] == "groups_sha256"
    assert all(r["n_a"] == 0 and r["groups_sha256"] == "" for r in alignment.aligned_digests(docs.filter("text is null or text = ''"), *PATHS).collect())


def test_golay_code():
    words = np.arange(1 << 23)
    code = words[simhash.syndromes(words) == 0]
    assert len(code) == 4096 and np.bitwise_count(code[1:]).min() == 7 and sorted(code >> 11) == list(range(4096))
    some = np.random.default_rng(1).integers(0, 1 << 23, 200)
    index, many = simhash.nearby_codewords(some)
    ends = np.cumsum(many)
    for w, a, b in zip(some, ends - many, ends):
        assert sorted(index[a:b]) == sorted(code[np.bitwise_count(code ^ w) <= 4] >> 11)
    assert set(many.tolist()) == {1, 6}


def test_keys_meet():
    rng = np.random.default_rng(2)
    marks = rng.integers(0, 1 << 63, 3000).astype(np.uint64) << np.uint64(1) | rng.integers(0, 2, 3000).astype(np.uint64)
    sets = lambda m: [set(k) for k in np.split(*(lambda k, p: (k[np.argsort(p, kind="stable")], np.cumsum(np.bincount(p))[:-1]))(*simhash.fuzzy_keys(m)))]
    own, other = sets(marks), marks.copy()
    for _ in range(2):
        other ^= np.uint64(1) << rng.integers(0, 64, len(other)).astype(np.uint64)
        assert all(a & b for a, b in zip(own, sets(other)))


def marks_by_hand(rows):
    out = []
    for key, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        out.append((key, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    return out


def components_by_hand(marks, bits=2):
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = collections.defaultdict(lambda: None)
    for i, (key, _) in enumerate(marks):
        r = find(i)
        least[r] = key if least[r] is None else least[r] if key is None else min(key, least[r])
    return [(key, f"{mark:016x}", least[find(i)]) for i, (key, mark) in enumerate(marks)]


@pytest.mark.parametrize("most", [64, 2, 1])
def test_op12(docs, most):
    want = components_by_hand(marks_by_hand(source_rows()))
    assert ordered(simhash.simhash_groups(docs, most=most).collect()) == ordered(want)
    assert len({w[2] for w in want}) < len(want) - 5


def test_op12_empty(docs):
    assert simhash.simhash_groups(docs.filter("false")).count() == 0


@pytest.mark.parametrize("most", [64, 3])
def test_linked_marks(spark, most):
    """Dense balls of fingerprints, more than a key may hold, and random ones; links that chain through others."""
    ship_package(spark)
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 62, 6)
    marks = set(rng.integers(0, 1 << 62, 300).tolist())
    for c in centres.tolist():
        for _ in range(150):
            marks.add(c ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) if rng.random() < 0.7 else c ^ (1 << int(rng.integers(0, 63))))
    marks = sorted(marks)
    got = {r["node"]: r["component"] for r in simhash.link_marks(spark.createDataFrame([(m,) for m in marks], "mark long"), most).collect()}
    want = components_by_hand([(m, m) for m in marks])
    assert [got.get(m, m) for m in marks] == [w[2] for w in want]


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = [(k, v, lab) for k, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    whole = [[int(np.floor(1024 * float(x))) for x in v] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))
    width = len(whole[0]) // parts
    cut = [[w[p * width : (p + 1) * width] for w in whole] for p in range(parts)]
    books = [[list(cut[p][i]) for i in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for x in cut[p]:
                own[near(x, books[p])[1]].append(x)
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[near(cut[p][i], books[p]) for p in range(parts)] for i in range(len(kept))]
    error = [sum(f[0] for f in x) for x in found]
    label = collections.Counter()
    for e, (_, _, lab) in zip(error, kept):
        label[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(k, "".join(f"{f[1]:02x}" for f in x), e, label[lab], sha) for (k, _, lab), x, e in zip(kept, found, error)]


def vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.01 if i % 3 else 0.4, width)], int(i % 4) if i % 5 else None) for i in rng.permutation(n)]
    rows += [(None, rows[0][1], None), (rows[1][0], rows[1][1], 1), (rows[2][0], rows[3][1], 1)]  # a null key, a row twice, a key twice
    bad = [(n + 1, None, 1), (n + 2, [], 1), (n + 3, [None] + rows[0][1][1:], 1), (n + 4, [float("nan")] * width, 1), (n + 5, [float("inf")] + rows[0][1][1:], None)]
    return rows, bad


@pytest.mark.parametrize("n, width", [(40, 8), (420, 8), (300, 64)])
def test_op13(spark, n, width):
    ship_package(spark)
    rows, bad = vectors(n, width, n)
    table = spark.createDataFrame([(*r, "clash", 1.5) for r in rows + bad], "vec_id long, embedding array<float>, label int, code string, x double").repartition(3)
    assert ordered(vector_codes.vector_codes(table).collect()) == ordered(codes_by_hand(rows))


def test_op13_empty_and_refused(spark):
    ship_package(spark)
    table = spark.createDataFrame([(1, None, 1), (2, [float("nan")] * 4, 1)], "vec_id long, embedding array<float>, label int")
    out = vector_codes.vector_codes(table)
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="one length"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [0.5] * 6, 1)], "vec_id long, embedding array<float>, label int"))


def test_gnat_leaves_out_subtrees_and_stays_exact():
    rng = np.random.default_rng(5)
    for width, size, most in [(1, 256, 40), (2, 256, 1000), (3, 200, 1 << 28), (4, 256, 3), (16, 256, 600), (2, 1, 5), (2, 17, 2)]:
        entries = rng.integers(-most, most + 1, (size, width))
        points = np.concatenate([rng.integers(-most, most + 1, (3000, width)), entries, (entries[:1] + entries[-1:]) // 2])
        tree = vector_codes.Gnat(entries)
        at, squares = tree.nearest(points)
        plain = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (at == plain.argmin(axis=1)).all() and (squares == plain.min(axis=1)).all()  # ties go to the lower index
        if width <= 4 and size == 256 and most > 3:
            assert tree.visited < 0.4 * size * tree.queries
