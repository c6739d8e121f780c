"""The pipeline's stages one by one against plain Python, on a table with nulls, ties, repeated rows and clashing columns."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from gaugework.llm import compression_quality, packing, quality_rules  # noqa: E402
from gaugework.session import ship_package  # noqa: E402
from test_operators import groups_by_hand, removed_by_hand  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, sid long, id long, score double, _row string, `a.b` string"


def make_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["th", "an", "er", "on", "in", "ou"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    passage = prose(70)
    texts = [prose(rng.randint(60, 160)) for _ in range(60)]
    texts += [t + " " + prose(2) for t in texts[:6]] + texts[:4]
    texts += [prose(60) + " " + passage + " " + prose(60) for _ in range(3)]
    texts += [" ".join(word() + "###" for _ in range(90)) for _ in range(12)]
    texts += [None, "", "  ", "one two"]
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 0.5, "mine", "dot") for i, t in enumerate(texts)]
    return rows + [rows[8], rows[8], (None, texts[9], None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def table(spark):
    ship_package(spark)
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    rows = [(i, 0 if "###" in (t or "") else 1, 0) for i, t, *_ in make_rows() if t and len(t) > 20 and i is not None]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").dropDuplicates(["doc_id"]).write.parquet(f"{folder}/labels.parquet")
    return folder


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]


def test_quality_classifier(spark, table, sf_dir):
    model = compression_quality.fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = pipeline.quality_classifier(spark, table, sf_dir)
    assert got.columns == table.columns
    want = sorted((r for r in make_rows() if model.scores([r[1]])[0] >= 0.5), key=repr)
    assert listed(got) == want
    prose = [r for r in make_rows() if r[1] and len(r[1]) > 200 and "###" not in r[1]]
    assert sum(r in want for r in prose) > 0.95 * len(prose) and not any("###" in (r[1] or "") for r in want)


def test_rules(spark, table, sf_dir):
    rows = make_rows()
    votes = ["".join(map(quality_rules.vote, quality_rules.RULE_NAMES, s[5:])) if (s := quality_rules.statistics(r[1]))[0] else "0" * len(quality_rules.RULE_NAMES) for r in rows]
    model = quality_rules.fit(list(collections.Counter(votes).items()))
    p = model.posterior(quality_rules.grades(votes))
    stats = [quality_rules.statistics(r[1]) for r in rows]
    want = sorted((r for r, s, x in zip(rows, stats, p) if s[0] >= 50 and 100 * s[4] <= 50 * s[0] and x >= 0.5), key=repr)
    got = pipeline.rules(spark, table, sf_dir)
    assert got.columns == table.columns and listed(got) == want and len(want) > 50


def test_near_duplicates(spark, table, sf_dir):
    rows = sorted(make_rows(), key=lambda r: (r[0] is None, r[0] or 0))
    sets, roots = groups_by_hand([r[1] for r in rows])
    seen, want = set(), []
    for r, s, root in zip(rows, sets, roots):
        if not s or root not in seen:
            want.append(r)
        seen.add(root)
    got = pipeline.near_duplicates(spark, table, sf_dir)
    assert got.columns == table.columns and listed(got) == sorted(want, key=repr)


def test_repeated_passages(spark, table, sf_dir):
    rows = make_rows()
    raw, gone = removed_by_hand([r[1] for r in rows], 200)
    want = []
    for r, b, g in zip(rows, raw, gone):
        text = None if r[1] is None else bytes(x for x, out in zip(b, g) if not out).decode("utf-8", errors="ignore")
        want.append((r[0], text, *r[2:4], None if text is None else len(text), *r[5:]))
    got = pipeline.repeated_passages(spark, table, sf_dir)
    assert got.columns == table.columns and listed(got) == sorted(want, key=repr)
    assert sum(map(sum, gone)) > 2000


def test_best_fit_packing(spark, table, sf_dir):
    import numpy as np
    from tokenizers import Tokenizer

    import public_tokenizers

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in make_rows():
        ids = tool.encode(r[1] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        cuts = [0] * (first > 0) + list(range(first, len(ids), 1024))
        for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            want[r[0], p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = pipeline.best_fit_packing(spark, table, sf_dir).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    fill = collections.defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    bound = packing.lower_bound(np.array([k[3] for k, n in want.items() for _ in range(n)]), 1024)
    assert bound <= len(fill) <= bound + 1 and all(r["certified"] == (len(fill) == bound) for r in got)


def test_run_chains_the_stages(spark, table, sf_dir, tmp_path):
    table.write.parquet(f"{sf_dir}/documents.parquet")
    docs = table
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
    places = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert listed(pipeline.run(spark, sf_dir).select(*places)) == listed(docs.select(*places)) and docs.count() > 40


def test_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and got.count() == 0, name
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0
