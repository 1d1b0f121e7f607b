"""The pipeline against its stages run by hand on small tables."""

import corpus_pipeline
from tarnweave.llm import common, minhash, packing, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.settle(stage(spark, seen, SF))
        assert out.columns == docs.columns and 0 < out.count() < seen.count(), name
        assert out.select("doc_id").subtract(seen.select("doc_id")).count() == 0
        seen = out
    good = {r.doc_id for r in quality.score_quality(docs, labels).where("good").collect()}
    assert {r.doc_id for r in seen.collect()} <= good
    groups = minhash.near_duplicates(seen)
    assert groups.where("group_id <> doc_id").count() == 0
    bins = corpus_pipeline.packing_stage(spark, seen, SF).collect()
    sizes = {r.doc_id: r.size for r in packing.token_counts(seen).collect() if r.size}
    packed = {}
    for b in bins:
        for d, n in zip(b.doc_ids, b.lens):
            packed[d] = packed.get(d, 0) + n
    assert packed == sizes


def test_run_equals_stages(spark):
    a = sorted(tuple(r.doc_ids) for r in corpus_pipeline.run(spark, SF).collect())
    docs = common.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert a == sorted(tuple(r.doc_ids) for r in docs.collect())


def test_planted_cases(spark):
    """Copies and toxic texts go, clean texts stay."""
    docs = common.table(spark, "/root/testdata/sf0.1", "documents")
    labels = common.table(spark, "/root/testdata/sf0.1", "labels")
    clean = [r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()]
    kept = {r.doc_id for r in quality.keep_quality(docs, labels).collect()}
    assert len(kept & set(clean)) > 0.97 * len(clean)
    safe = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert len(safe & set(clean)) > 0.95 * len(clean)
    bad = [r.doc_id for r in labels.where("toxic = 1").collect()]
    assert len(safe & set(bad)) < 0.3 * len(bad)


def _folder(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_against_brute_force(spark, tmp_path):
    """Scores looked up one document at a time, all pairs of shingle sets, each placement tried in turn."""
    import numpy as np
    import pyarrow as pa
    from test_corpus_ops import brute_groups, brute_packing

    from tarnweave.llm import bpe_ids

    docs = common.table(spark, SF, "documents").where("doc_id < 400")
    labels = common.table(spark, SF, "labels")
    sf = _folder(spark, tmp_path, docs, labels)
    docs = common.table(spark, sf, "documents")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    left = rows
    model = quality.unpack_model(quality.train(docs, labels))
    good = [r for r in left if quality.vote(model, quality.features(pa.array([r.text or ""])))[0] >= 0.5]
    kept = common.settle(docs.join(spark.createDataFrame([(r.doc_id,) for r in good], "doc_id long"), "doc_id", "left_semi").select(docs.columns))
    machine = quality.unpack_model(toxicity.train(kept, labels))
    safe = [r for r in good if toxicity.predict(machine, pa.array([r.text or ""]))[0] < machine["cut"][0]]
    groups = brute_groups([r.text for r in safe])
    one = [r for i, r in enumerate(safe) if groups[i] == i]
    e = bpe_ids.Ids(bpe_ids.load_ranks())
    sizes = [(r.doc_id, len(e.enc.encode_ordinary(r.text or ""))) for r in one]
    pieces = [(d, min(2048, n - s)) for d, n in sizes for s in range(0, n, 2048)]
    got = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(one) < len(safe) < len(rows)
    assert sorted((d, n) for r in got for d, n in zip(r.doc_ids, r.lens)) == sorted(pieces)
    before = brute_packing([n for _, n in pieces], 2048)
    mine = {}
    for r in got:
        level = 0
        for d, s, n in zip(r.doc_ids, r.starts, r.lens):
            mine[d, s] = level
            level += n
    assert np.array_equal([mine[d, s] for d, n in sizes for s in range(0, n, 2048)], before)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, ids of 32 bits, extra columns with the operators' own names."""
    long_ = " ".join(f"word{i % 977}" for i in range(25_000))
    rows = [(None, None), (None, "no id"), (None, "no id"), (1, None), (2, ""), (3, " \n"), (4, long_), (5, long_ + " more"), (6, "!!!"), (7, "twice"), (7, "twice"), (7, "another text of seven"), (8, "Some short text here."), (9, "some short TEXT here")]
    docs = spark.createDataFrame([(i, t, None, "s", 1, 2, 3) for i, t in rows], "doc_id int, text string, lang string, source string, n_chars int, score int, id int").withColumnsRenamed({"n_chars": "keys"})
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (8, 1, 1), (None, 1, 1), (6, None, None)], "doc_id int, quality int, toxic int")
    sf = _folder(spark, tmp_path / "odd", docs, labels)
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.settle(stage(spark, seen, sf))
        assert out.columns == docs.columns
        assert stage(spark, seen.limit(0), sf).count() == 0
        seen = out
    left = [(r.doc_id, r.text) for r in seen.collect()]
    assert left.count((None, "no id")) == 2 and left.count((None, None)) == 1
    assert {1, 2, 3, 6} <= {i for i, _ in left} and [i for i, _ in left].count(7) == 1
    assert 5 not in {i for i, _ in left} or 4 not in {i for i, _ in left}
    packed = corpus_pipeline.packing_stage(spark, seen, sf).collect()
    ids = [d for r in packed for d, s in zip(r.doc_ids, r.starts) if s == 0]
    assert sorted(map(str, ids)) == sorted(str(i) for i, t in left if t)
    assert corpus_pipeline.packing_stage(spark, seen.limit(0), sf).count() == 0
    empty = _folder(spark, tmp_path / "empty", docs.limit(0), labels.limit(0))
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, _folder(spark, tmp_path / "unlabelled", docs, labels.limit(0))).count() > 0


def test_dedup_stage_misses_no_copy(spark):
    """800 pairs that just reach the threshold (40 of 60 triples each are the same): one of each stays."""
    import random

    rnd = random.Random(12)
    some = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(800):
        same = some(42)
        rows += [(2 * i + k, " ".join(same + some(20)), "en") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    left = corpus_pipeline.dedup_stage(spark, docs, SF)
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 1600, 2))
