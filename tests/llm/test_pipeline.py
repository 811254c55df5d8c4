import numpy as np
import pytest
from odd_texts import ODD

import corpus_pipeline
from graticule.llm import common, decontam, embed, lm, neardup, secrets, simhash, substrings


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shape = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "secrets", "mixing"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(common.stored(stage(spark, kept[-1], sf), name))
        if name != "mixing":
            assert kept[-1].columns == shape
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5]
    # near copies: exactly the least of each group of what came before
    rows = kept[1].select("doc_id", "text").collect()
    sets = {r[0]: set(neardup.shingle_hashes(common.space_words(common.utf8(r[1]).lower()), 5).tolist()) for r in rows}
    left = sorted(ids[2])
    for a in left:
        for b in left:
            if a < b and sets[a] | sets[b]:
                assert len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
    # no window of the benchmark is left, and nothing else went
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    hit = {r[0] for r in decontam.hits(kept[2], bench).where("n_hit > 0").select("doc_id").collect()}
    assert ids[3] == ids[2] - hit
    # texts change only where secrets stood
    before, after = ({r[0]: r[1] for r in k.select("doc_id", "text").collect()} for k in kept[3:5])
    for d, t in before.items():
        found = secrets.base_spans(t or "")
        assert (t == after[d]) <= (not found)
        assert not secrets.base_spans(after[d] or "") or "<SECRET>" not in after[d]
    assert all(np.isfinite(r["rate"]) and r["rate"] >= 0 for r in kept[5].collect())


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and {"doc_id", "rate"} <= set(got.columns)


def test_scratch_tables_go(spark, docs):
    old = common.stored(docs(["o"]), "scratch")
    before = common.written()
    one, two = (common.stored(docs([t]), "scratch") for t in "ab")
    assert common.clear(spark, two, before) == 1
    assert [r["text"] for r in two.collect()] == ["b"] and [r["text"] for r in old.collect()] == ["o"]
    with pytest.raises(Exception):
        one.collect()
    assert common.clear(spark, before=before) == 1 and common.written() == before


def test_settle_frees_the_drivers_jvm(spark):
    memory = spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean()
    rubbish = spark.sparkContext._gateway.new_array(spark._jvm.byte, 64 << 20)
    held = memory.getHeapMemoryUsage().getUsed()
    del rubbish
    common.settle(spark)
    assert memory.getHeapMemoryUsage().getUsed() <= held - (60 << 20)


def test_near_copies_hold_one_lane_at_a_time(spark, docs, monkeypatch):
    """The links of a lane are worked out, and the driver settles, before the next lane is looked at."""
    seen, settle, links = [], common.settle, neardup.links
    monkeypatch.setattr(common, "settle", lambda s: (seen.append("settle"), settle(s))[1])
    monkeypatch.setattr(neardup, "links", lambda *a: (seen.append("lane"), links(*a))[1])
    words = [f"w{k}" for k in range(60)]
    out = neardup.one_of_each(docs([" ".join(words), " ".join(words[:58]), "quite another text of some words", " ".join(words).upper()]))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2]
    assert seen[: 2 * neardup.LANES] == ["lane", "settle"] * neardup.LANES and seen[2 * neardup.LANES :] == ["settle"] * 3


def test_stages_with_odd_rows_and_more_columns(spark, sf, docs):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use; texts and columns come out as they went in."""
    rows = [(k, t, "en", "s", 1, 5, "x") for k, t in enumerate(ODD)]
    rows += [(3, "another text of id three that is long enough", "en", "s", 1, 5, "x"), (None, "a text without an id", None, None, None, None, None), (4, ODD[4], "en", "s", 1, 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, part string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, df, sf), name)
        assert out.columns == df.columns and out.count() <= df.count()
        assert {r["part"] for r in out.collect()} <= {"x", None}
        df = out
    assert {r["text"] for r in df.collect()} >= {"word", "another text of id three that is long enough", "a text without an id"}
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() == df.count()


def test_stages_without_rows(spark, sf, docs):
    df = docs([])
    for name, stage in corpus_pipeline.STAGES:
        df = common.stored(stage(spark, df, sf), name)
        assert df.count() == 0
        if name == "mixing":
            assert "rate" in df.columns


@pytest.mark.parametrize("query", [
    lambda df: secrets.scan(df, secrets.fit_on_base(df)).select("doc_id", "spans"), lambda df: lm.score(df).select("doc_id", "base_score", "score"), lambda df: substrings.without_repeats(df).select("doc_id", "n_bytes", "n_removed"),
    lambda df: simhash.classes(df).select("doc_id", "fp", "component_id"), lambda df: decontam.hits(df, df.selectExpr("doc_id as item_id", "text")).select("doc_id", "n_words", "n_hit"),
])
def test_clashing_names(spark, docs, query):
    """Columns named as the operators name theirs change nothing."""
    df = docs(["some words of a text", "some words of a text", None, "token=abcdef123 and more"]).select("doc_id", "text")
    names = ["key", "key2", "part", "fp", "block", "held", "spans", "items", "n_words", "component_id", "bucket", "score", "rows"]
    more = df.selectExpr("doc_id", "text", *[f"'z' as {n}" for n in names])
    assert sorted(map(tuple, query(more).collect())) == sorted(map(tuple, query(df).collect()))


def test_clashing_names_of_vectors(spark):
    rows = [(1, [1.0, 0.0], "z", "z"), (2, [1.0, 0.01], "z", "z"), (3, [0.0, 1.0], "z", "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string, tile string")
    assert {r["vec_id"]: r["component_id"] for r in embed.near_vectors(df).collect()} == {1: 1, 2: 1, 3: 3}
