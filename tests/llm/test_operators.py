"""The numbered operators against plain Python on a small table with nulls, empty and long texts, copies, ties and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from gaugework.llm import bwt, common, compression_quality, elias_fano, language_model, media, ngram_join, packing, piece_bpe, quality_rules, rollups, substring_dedup, token_files  # noqa: E402
from gaugework.llm.elias_fano import EliasFano  # noqa: E402
from gaugework.session import ship_package  # noqa: E402

PATH = public_tokenizers.path


def make_texts() -> list:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "an", "er", "on", "ö", "ß", "in", "日"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    base = prose(120)
    words = base.split(" ")
    near = []
    for k in range(12):
        w = list(words)
        for _ in range(k):
            w[rng.randrange(len(w))] = word()
        near.append(" ".join(w))
    passage = prose(60)
    shared = [prose(30 + 5 * k) + " " + passage + " " + prose(20) for k in range(5)]
    return [None, "", " ", "a", "one two", "One TWO", "x  y\n\n z\t", base, base, base.upper(), *near, *shared, prose(3000), "ab " * 400, "<s> </s> <|endoftext|> ▁ \x00", "Don't we'LL 's ''s Ünd É1,2<|startoftext|>x", " " * 12000 + "z" * 3000 + "\n" * 12000, "  lead", "trail  ", *[prose(rng.randint(1, 80)) for _ in range(25)]]


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    rows = [(i, t, "en", "src", i % 3, float(i), "clash") for i, t in enumerate(TEXTS)]
    names = "doc_id long, text string, lang string, source string, n_bytes long, score double, votes string"
    return spark.createDataFrame(rows, names).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bwt_against_counts():
    rng = random.Random(2)
    for _ in range(150):
        least = rng.choice([1, 2, 3, 6])
        strings = [bytes(rng.choice(b"ab\x00\xff"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        flags, starts = bwt.repeated_suffixes(strings, least)
        count = collections.Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
        for s, a in zip(strings, starts):
            assert [bool(x) for x in flags[a : a + len(s) + 1]] == [i + least <= len(s) and count[s[i : i + least]] > 1 for i in range(len(s) + 1)]


def test_segments_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(4)
    lengths = np.array([0, 5000, 3, 199, 200, 0, 2500, 201])
    raw = rng.integers(97, 101, int(lengths.sum())).astype(np.uint8)
    ends = np.cumsum(lengths)
    want = {s for a, b in zip(ends - lengths, ends) for s in range(a, b - 199)}
    whole = {}
    for size in (1 << 20, 997, 300):
        monkeypatch.setattr(substring_dedup, "SLICE_BYTES", size)
        start, count, anchor, _ = substring_dedup.block_segments(raw, lengths, 200, 32)
        found = {s + k: a for s, n, a in zip(start.tolist(), count.tolist(), anchor.tolist()) for k in range(n)}
        assert set(found) == want and len(found) == count.sum()
        whole = whole or found
        assert found == whole  # a window's anchor depends on its bytes only


def removed_by_hand(texts, least):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                gone[i : i + least] = True
        out.append(gone)
    return raw, out


@pytest.mark.parametrize("crowded", [3000, 2])
def test_op1(docs, crowded):
    got = by_id(substring_dedup.remove_repeats(docs, most_segments=crowded))
    for i, (b, gone) in enumerate(zip(*removed_by_hand(TEXTS, 200))):
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"], bytes(got[i]["kept"])) == (len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept)
        assert sum(s["length"] for s in got[i]["spans"]) == got[i]["n_removed"] and len(got[i]["spans"]) == got[i]["n_spans"]
    text = by_id(substring_dedup.remove_repeats(docs, as_text=True))
    assert text[0]["text"] is None and text[7]["text"] == "" and text[3]["text"] == "a" and text[3]["votes"] == "clash"


def shuffled_parts(df):
    """What stands under each shuffle of a plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    for k, line in enumerate(lines):
        if line.lstrip(" :+-*").startswith("Exchange"):
            yield "\n".join(itertools.takewhile(lambda x: depth(x) > depth(line), lines[k + 1 :]))


@pytest.mark.parametrize("crowded", [3000, 2])
def test_op1_texts_are_not_shuffled(docs, monkeypatch, crowded):
    """Answers go to the blocks in all passes, with crowded anchors too: no shuffle has whole blocks under it but where requests are cut from them."""
    plans, write = {}, substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda spark, df, name, **more: plans.update({name: df}) or write(spark, df, name, **more))
    plans["result"] = substring_dedup.remove_repeats(docs, digest_only=True, most_segments=crowded)
    assert set(plans) >= {"segment-counts", "verdicts", "result"} | ({"window-counts"} if crowded == 2 else set())
    assert list(shuffled_parts(plans["result"]))
    for name, df in plans.items():
        assert not any("payload" in x and "InArrow" not in x for x in shuffled_parts(df)), name
    got = by_id(plans["result"])
    for i, (b, gone) in enumerate(zip(*removed_by_hand(TEXTS, 200))):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())


def test_bucketed_tables(spark):
    df = spark.range(1000).selectExpr("if(id = 7, null, id) AS k", "id AS v").repartition(3)
    names = lambda: {t.name for t in spark.catalog.listTables("default")}
    before = names()
    table = common.bucketed(spark, df, "rows", "k", 5)
    assert names() == before and sorted(table.collect(), key=lambda r: r["v"]) == sorted(df.collect(), key=lambda r: r["v"])
    sums = table.groupBy("k").agg(F.sum("v").alias("s"))
    assert not list(shuffled_parts(sums)) and sums.count() == 1000 and sums.filter("k is null").first()["s"] == 7
    assert common.bucketed(spark, df.limit(0), "rows", "k", 5).count() == 0


def test_op2_equals_library(docs):
    import sentencepiece

    path = PATH("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(piece_bpe.digests(docs, path))
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    both = by_id(piece_bpe.decode(piece_bpe.encode(docs, path), path, out="decoded"))
    assert all(both[i]["ids"] == library.encode(t or "") and both[i]["decoded"] == library.decode(both[i]["ids"]) for i, t in enumerate(TEXTS))


def groups_by_hand(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sets, [root(k) for k in range(len(sets))]


def test_op3(docs):
    sets, roots = groups_by_hand(TEXTS)
    got = by_id(ngram_join.near_groups(docs))
    assert all((got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), roots[i]) for i in range(len(TEXTS)))
    kept = sorted(r["doc_id"] for r in ngram_join.keep_one(docs).collect())
    assert kept == sorted(i for i in range(len(TEXTS)) if not sets[i] or roots[i] == i)


def ids_by_library(name, end):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(PATH(name))
    return [np.array(e.ids + [end], dtype="<u4") for e in tool.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]


def test_op4(spark, docs, tmp_path):
    want = ids_by_library("word_bpe_49k.json", 1)
    folder, shards = token_files.store(docs, PATH("word_bpe_49k.json"), f"file://{tmp_path}/shards")
    got = by_id(token_files.read_shards(spark, shards))
    start = 0
    for i, ids in enumerate(want):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    held = [token_files.Shard(open(p.removeprefix("file://"), "rb").read()) for _, p, _, _ in shards]
    found = [s.get(7) for s in held if s.get(7) is not None]
    assert len(found) == 1 and found[0].tolist() == want[7].tolist()
    assert all(s.get(10**9) is None for s in held)


def test_op4_null_and_repeated_keys(spark):
    ship_package(spark)
    rows = spark.createDataFrame([(None, "a b"), (3, "x"), (3, "y y"), (None, None)], "doc_id long, text string")
    got = token_files.read_shards(spark, token_files.store(rows, PATH("word_bpe_49k.json"))[1]).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "3", "None", "None"] and sorted(r["start"] for r in got)[0] == 0


def test_op5(docs):
    words = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in enumerate(TEXTS)}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 5 != 1]
    count = collections.Counter(w for i in train for w in words[i])
    before = {i: [None, *ws[:-1]] for i, ws in words.items()}
    triples = collections.Counter(t for i in train for t in zip([None, *before[i][:-1]], before[i], words[i]))
    pairs, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    after2, after3 = collections.Counter(), collections.Counter()
    for (u, v, w), n in triples.items():
        pairs[v, w] += n
        three[u, v] += n
        after3[u, v] += 1
    for (v, _), n in pairs.items():
        two[v] += n
        after2[v] += 1
    total, size = sum(count.values()), len(count)
    got = by_id(language_model.scores(docs))
    for i, ws in words.items():
        base = [(count[w] + 0.5) / (total + 0.5 * (size + 1)) for w in ws]
        full = []
        for u, v, w, p in zip([None, *before[i][:-1]], before[i], ws, base):
            p = (max(pairs[v, w] - 0.75, 0) + 0.75 * after2[v] * p) / two[v] if two[v] else p
            full.append((max(triples[u, v, w] - 0.75, 0) + 0.75 * after3[u, v] * p) / three[u, v] if three[u, v] else p)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(count[w] > 0 for w in ws), total, i not in train)
        assert r["base_score"] == pytest.approx(sum(map(math.log10, base))) and r["score"] == pytest.approx(sum(map(math.log10, full)), rel=1e-5)


def test_op5_trie_answers_by_key(tmp_path):
    """A stored trie against a dictionary: known and unknown words in each place, few questions and many."""
    rng = np.random.default_rng(5)
    key = lambda n: np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
    middles, thirds, firsts = key(30), key(200), key(60)
    entries = {(m, u, w): float(rng.integers(1, 9)) for m, u, w in zip(rng.integers(0, len(middles), 4000).tolist(), rng.integers(0, len(firsts), 4000).tolist(), rng.integers(0, len(thirds), 4000).tolist())}
    entries = {k: entries[k] for k in sorted(entries)}
    pairs = sorted({(m, w) for m, _, w in entries})
    contexts = sorted({(m, u) for m, u, _ in entries})
    two, weight = {p: 0.5 + p[1] % 7 for p in pairs}, {c: 0.25 + c[1] % 5 for c in contexts}
    place = {c: k for k, c in enumerate(contexts)}
    arrays = lambda rows: tuple(np.array(x) for x in zip(*rows))
    packed = elias_fano.Trie.pack(middles, thirds, firsts, arrays((*p, two[p]) for p in pairs), arrays((*c, weight[c]) for c in contexts), arrays((place[m, u], w, v) for (m, u, w), v in entries.items()))
    trie = elias_fano.Trie(elias_fano.stored(packed, f"file://{tmp_path}/0.trie"))
    assert trie.middles.all().tolist() == middles.tolist()
    asks = [(rng.integers(-1, len(middles)), rng.integers(-1, len(firsts)), rng.integers(-1, len(thirds))) for _ in range(3000)] + list(entries)
    for part in (asks[:40], asks):
        m, u, w = (np.unique(np.array([3 if k < 0 else int(table[k]) for k in x], dtype=np.uint64), return_inverse=True) for x, table in zip(zip(*part), (middles, firsts, thirds)))
        got = trie.triple(m, u, w)
        for k, (a, b, c) in enumerate(part):
            want = two.get((a, c), 0), weight.get((a, b), 0), entries.get((a, b, c), 0)
            assert tuple(float(book[code[k]]) for book, code in zip((trie.two_book, trie.weight_book, trie.three_book), got)) == pytest.approx(want)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (200, 50), (5000, 1 << 20), (3000, 1 << 63)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        level = EliasFano(EliasFano.pack(values))
        assert (level.get(np.arange(n)) == values).all()
        if n:
            wanted = rng.integers(0, top, 500).astype(np.uint64)
            assert (level.search(wanted, np.zeros(500, np.int64), np.full(500, n)) == np.searchsorted(values, wanted)).all()


def test_op6(spark, docs):
    want = ids_by_library("byte_bpe_50k.json", 2)
    parts = packing.pieces(docs, PATH("byte_bpe_50k.json"))
    for rows in (packing.BUCKET_ROWS, 20):
        got = packing.pack(parts, bucket_rows=rows).collect()
        bins = collections.defaultdict(list)
        for r in got:
            ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert sum(r["length"] for r in got) == sum(map(len, want))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(bins) <= -(-sum(map(len, want)) // 1024) + 2


def test_lower_bound_never_exceeds_packing():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = rng.integers(1, 101, rng.integers(1, 40))
        bins, offsets, count = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= count and np.bincount(bins, weights=lengths).max() <= 100
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3
    assert packing.piece_bounds(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


def test_op7(docs):
    got = by_id(quality_rules.judge(docs))
    for i, t in enumerate(TEXTS):
        t = t or ""
        words = quality_rules.WORDS.findall(t)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        twice = collections.Counter(windows)
        covered = {j for k, w in enumerate(windows) if twice[w] > 1 for j in range(k, k + 3)}
        lines = [x for x in t.split("\n") if quality_rules.WORDS.search(x)]
        dup = len(lines) - len(set(lines))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


def test_op7_posterior_and_verdict(docs):
    """The posterior is that of a plain EM over all rows' votes, and it decides."""
    got = [r for r in quality_rules.judge(docs).collect()]
    want = plain_em([r["votes"] for r in got])
    for r in got:
        assert r["quality_probability"] == pytest.approx(want[r["votes"]], abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["quality_probability"] >= 0.5)
    rows = {r["doc_id"]: r for r in quality_rules.kept_rows(docs).collect()}
    assert set(rows) == {r["doc_id"] for r in got if r["kept"]} and all(rows[i]["text"] == TEXTS[i] and rows[i]["votes"] == "clash" for i in rows)


def plain_em(votes, steps=100):
    """Posterior by vote pattern, row by row in plain Python."""
    order, prior_good, prior_bad = "=-0+", quality_rules.PRIOR_IF_GOOD, quality_rules.PRIOR_IF_BAD
    rules, times = len(votes[0]), collections.Counter(votes)
    share = quality_rules.PRIOR_SHARE[0] / sum(quality_rules.PRIOR_SHARE)
    tables = [[[x / sum(prior) for x in prior] for _ in range(rules)] for prior in (prior_good, prior_bad)]

    def posterior(v):
        odds = math.log(share / (1 - share)) + sum(math.log(tables[0][k][order.index(c)] / tables[1][k][order.index(c)]) for k, c in enumerate(v))
        return 1 / (1 + math.exp(-odds))

    for _ in range(steps):
        p = {v: posterior(v) for v in times}
        good = sum(p[v] * n for v, n in times.items())
        for side, (prior, of) in enumerate(((prior_good, lambda v: p[v]), (prior_bad, lambda v: 1 - p[v]))):
            total = sum(of(v) * n for v, n in times.items()) + sum(prior)
            tables[side] = [[(sum(of(v) * n for v, n in times.items() if v[k] == c) + prior[j]) / total for j, c in enumerate(order)] for k in range(rules)]
        share = (good + quality_rules.PRIOR_SHARE[0]) / (len(votes) + sum(quality_rules.PRIOR_SHARE))
    return {v: posterior(v) for v in times}


def test_op7_finds_known_accuracies():
    rng = np.random.default_rng(7)
    n, rules = 20000, len(quality_rules.RULE_NAMES)
    good = rng.random(n) < 0.8
    hit = np.linspace(0.75, 0.95, rules)
    votes = []
    for q in good:
        speaks, right = rng.random(rules) < 0.6, rng.random(rules) < hit
        votes.append("".join("0" if not s else "+" if r == q else "-" for s, r in zip(speaks, right)))
    model = quality_rules.fit(list(collections.Counter(votes).items()))
    assert model.share == pytest.approx(0.8, abs=0.02)
    for k, x in enumerate(model.accuracy().values()):
        assert x == pytest.approx(hit[k], abs=0.03)
    p = model.posterior(quality_rules.grades(votes))
    assert np.mean((p >= 0.5) == good) > 0.95


def test_op7_is_not_all_must_pass():
    """One weak bad vote can be outweighed; a text that no rule speaks for is refused without any bad vote."""
    clean, junk, weak, silent = "++++++0+0+++", "==-+++0+0+++", "+++0-+0+0+++", "0" * 12
    model = quality_rules.fit([(clean, 9000), (junk, 900), ("==--++0+0++0", 300), (weak, 60), (silent, 20)])
    p = dict(zip((clean, junk, weak, silent), model.posterior(quality_rules.grades([clean, junk, weak, silent]))))
    assert p[clean] > 0.99 and p[junk] < 0.01 and p[weak] > 0.5 and p[silent] < 0.5
    none = quality_rules.fit([])
    assert none.share == pytest.approx(0.8) and none.good.shape == (12, 4)


def test_op8(spark):
    ship_package(spark)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "an", "er", "on", "in"]) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word() for _ in range(120)) if i % 2 else " ".join(word().upper() + "!!" for _ in range(120))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (999, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    got = by_id(compression_quality.score(docs, compression_quality.fit(docs, labels)))
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == i % 2 for i in held) / len(held) > 0.95
    assert 0 <= got[999]["score"] <= 1 and got[999]["score"] == got[1000]["score"]
    none = compression_quality.fit(docs, labels.limit(0))
    assert by_id(compression_quality.score(docs, none))[3]["score"] == pytest.approx(0.5)


def test_op9(docs):
    stored = media.store_texts(docs)
    files, got = by_id(stored), by_id(media.features(stored))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r, wave = got[i], bytes(files[i]["media"])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.read_wave(wave)[3] == payload and r["media_sha256"] == hashlib.sha256(wave).hexdigest() and r["media_bytes"] == len(wave)
        sound = [int(media.MULAW[x]) for x in payload[::2]]  # half the rate: every other sample
        assert bytes(r["pcm"]) == np.array(sound, "<i2").tobytes()
        turns = sum((a < 0) != (b < 0) for a, b in zip(sound, sound[1:]))
        alaw = sum(int(media.ALAW[x]) ** 2 for x in payload) / len(payload)
        adpcm = int(np.abs(media.decode_adpcm(np.frombuffer(payload, np.uint8).reshape(-1, 64)).astype(np.int64)).sum())
        assert r["feature"] == f"mulaw={sum(x * x for x in sound) / len(sound):.3f};turns={turns};alaw={alaw:.3f};adpcm={adpcm}"
    pcm = by_id(media.decode_audio(stored))
    assert pcm[3]["codec"] == "mulaw" and pcm[3]["n_samples"] == 128


def test_op9_every_sample_counts(spark, tmp_path):
    """The query: a change of any one byte of a text changes its PCM and its feature."""
    from gaugework.llm import queries

    base = "Every sample of a telephone call counts, the odd ones as well as the even ones; all of them."
    texts = [base, *(base[:k] + "\x02" + base[k + 1 :] for k in range(len(base)))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = by_id(queries.op9_media_columns(spark, f"file://{tmp_path}"))
    assert all(got[i]["pcm"] != got[0]["pcm"] and got[i]["feature"] != got[0]["feature"] for i in range(1, len(texts)))
    for i, t in enumerate(texts):
        payload = t.encode() + b"\0" * (-len(t) % 64)
        sound = [int(media.MULAW[x]) for x in payload]
        low, held = media.low_pass_weights(1, 2)[0].tolist(), [sound[0]] * 6 + sound + [sound[-1]] * 6
        pcm = [max(-32768, min(32767, (sum(w * x for w, x in zip(low, held[k : k + 13])) + 8192) >> 14)) for k in range(0, len(sound), 2)]
        assert bytes(got[i]["pcm"]) == np.array(pcm, "<i2").tobytes()
        turns = lambda xs: sum((a < 0) != (b < 0) for a, b in zip(xs, xs[1:]))
        alaw, adpcm = sum(int(media.ALAW[x]) ** 2 for x in payload) / len(payload), int(np.abs(media.decode_adpcm(np.frombuffer(payload, np.uint8).reshape(-1, 64)).astype(np.int64)).sum())
        want = f"mulaw={sum(x * x for x in sound) / len(sound):.3f};turns={turns(sound)};alaw={alaw:.3f};adpcm={adpcm};pcm={sum(x * x for x in pcm) / len(pcm):.3f};pcm_turns={turns(pcm)}"
        assert got[i]["feature"] == want


def test_low_pass():
    """What the lower rate cannot hold goes, what it can stays, at any ratio; no sample is left out."""
    at = np.arange(2400)
    for rate, target in ((8000, 4000), (8000, 3000), (16000, 1000), (44100, 8000)):
        weights = media.low_pass_weights(target // math.gcd(rate, target), rate // math.gcd(rate, target))
        assert (weights.sum(1) == 1 << 14).all()
        high, low = (np.round(20000 * np.sin(2 * np.pi * at * f * target / rate)).astype(np.int16) for f in (0.9, 0.1))
        gone, kept = media.resample(high, rate, target), media.resample(low, rate, target)
        assert np.abs(gone[10:-10]).max() < 1000 and np.abs(media.resample(high, rate, target, filtered=False)).max() > 10000
        assert np.abs(kept[10:-10] - 20000 * np.sin(2 * np.pi * np.arange(len(kept)) * 0.1)[10:-10]).max() < 400
        flat = np.zeros(240, dtype=np.int16)
        for k in range(200):
            click = flat.copy()
            click[k] = 32000
            assert media.resample(click, rate, target).any()
    assert media.resample(np.array([5], np.int16), 8000, 4000).tolist() == [] and media.resample(np.full(9, 7, np.int16), 8000, 4000).tolist() == [7] * 4


def test_audio_tables_and_adpcm():
    assert media.MULAW[0xFF] == 0 and media.MULAW[0x00] == -32124 and media.MULAW[0x80] == 32124
    assert media.ALAW[0xD5] == 8 and media.ALAW[0x55] == -8 and media.ALAW[0xAA] == 32256
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (5, 64)).astype(np.uint8)
    blocks[:, 2] %= 89
    got = media.decode_adpcm(blocks)
    for b, row in zip(blocks, got):
        value, index = int(np.frombuffer(b[:2].tobytes(), "<i2")[0]), int(b[2])
        out = [value]
        for byte in b[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = int(media.STEPS[index])
                size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - size if code & 8 else value + size))
                index = max(0, min(88, index + int(media.INDEX_CHANGE[code & 7])))
                out.append(value)
        assert row.tolist() == out
    with pytest.raises(ValueError):
        media.read_wave(b"nothing")


def test_op10(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", "w", 5), ("s", "en", "w", 7), (None, None, "w", None)], "source string, lang string, tokenizer string, n_tokens long")
    totals = rollups.Rollup(spark, f"file://{tmp_path}/totals")
    assert totals.totals().count() == 0
    assert totals.commit("one", rollups.changes(new=rows)) and not totals.commit("one", rollups.changes(new=rows))
    assert totals.commit("two", rollups.changes(new=rows.filter("n_tokens = 7").withColumn("n_tokens", F.lit(9)), old=rows.filter("n_tokens = 7")))
    again = rollups.Rollup(spark, f"file://{tmp_path}/totals")
    assert not again.commit("two", rollups.changes(old=rows))
    assert {(r["source"], r["n_docs"], r["n_tokens"]) for r in again.totals().collect()} == {("s", 2, 14), (None, 1, 0)}
    assert again.commit("three", rollups.changes(old=rows.filter("source is null"))) and again.totals().count() == 1


def test_op10_counts_by_tokenizers(docs):
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tool = Tokenizer.from_file(PATH(name))
        got = by_id(rollups.count_tokens(docs, {"n_tokens": PATH(name)}, ["doc_id", "votes"]))
        assert all(got[i]["n_tokens"] == len(tool.encode(t or "", add_special_tokens=False).ids) and got[i]["votes"] == "clash" for i, t in enumerate(TEXTS))


def test_op3_each_order_cuts_candidates(spark):
    """Texts of few words have many shingles in common with others, but no two texts many."""
    ship_package(spark)
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(40)) for _ in range(600)]
    near = texts[5].split(" ")
    near[-1] = "z"
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, " ".join(near)])], "doc_id long, text string")
    sets = ngram_join.candidate_sets(spark, ngram_join.written(spark, ngram_join.blocks(df, "doc_id", "text", 5), "b"), 5, 75)
    lists = ngram_join.prefix_lists(sets)
    a, b = lists.select("token", F.col("sid").alias("x")), lists.select("token", F.col("sid").alias("y"))
    pairs = a.join(b, "token").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    left = [ngram_join.met_in_all(pairs, sets, k).count() for k in (1, 2, 3)]
    assert left[0] > 2 * left[1] > 2 * left[2] > 0
    groups = by_id(ngram_join.near_groups(df))
    assert groups[600]["component_id"] == 5 and sum(r["component_id"] != i for i, r in groups.items()) == 1


def test_long_runs(spark):
    """Texts of one character, as long as block and chunk bounds or beyond them, in every operator on texts."""
    ship_package(spark)
    texts = [" " * 1_500_000, "\n" * 700_000, "a" * 300_000, "." * 300_000, "ab " * 100_000, "é" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = by_id(packing.pack(packing.pieces(df, PATH("byte_bpe_50k.json")).groupBy("doc_id").agg(F.lit(0).alias("piece"), F.lit(5).cast("long").alias("length"), F.sum("length").alias("n"))))
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(PATH("byte_bpe_50k.json"))
    assert all(ids[i]["n"] == len(tool.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts))
    gone = by_id(substring_dedup.remove_repeats(df, digest_only=True))
    assert all(gone[i]["n_removed"] == len(t.encode()) for i, t in enumerate(texts))
    assert piece_bpe.digests(df, PATH("piece_bpe_32k.model")).count() == 6
    assert {i: r["n_shingles"] for i, r in by_id(ngram_join.near_groups(df)).items()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 1}
    assert [r["n_words"] for r in quality_rules.judge(df).orderBy("doc_id").collect()] == [0, 0, 1, 1, 100_000, 1]
    assert [r["n_tokens"] for r in language_model.scores(df).orderBy("doc_id").collect()] == [1, 1, 2, 2, 100_001, 2]
    assert media.features(media.store_texts(df)).count() == 6
    assert token_files.read_shards(spark, token_files.store(df, PATH("word_bpe_49k.json"))[1]).count() == 6


def test_empty_tables(spark):
    ship_package(spark)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(none).count() == 0
    assert piece_bpe.digests(none, PATH("piece_bpe_32k.model")).count() == 0
    assert ngram_join.near_groups(none).count() == 0
    assert token_files.store(none, PATH("word_bpe_49k.json"))[1] == []
    assert language_model.scores(none).count() == 0
    assert packing.pack(packing.pieces(none, PATH("byte_bpe_50k.json"))).count() == 0
    assert quality_rules.judge(none).count() == 0
    assert media.features(media.store_texts(none)).count() == 0
    assert rollups.count_tokens(none, {"n": PATH("byte_bpe_50k.json")}, ["doc_id"]).count() == 0
    assert ngram_join.keep_one(none).count() == 0 and quality_rules.kept_rows(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert compression_quality.score(none, compression_quality.fit(none, labels)).count() == 0
