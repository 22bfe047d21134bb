"""The pipeline against brute force, stage by stage on what the stage before kept."""

import collections

import corpus_pipeline
from oracle import DATA
from test_documents import brute_dedup, brute_fingerprint, closure
from tidelex.llm import decontam, mixing, toxicity
from tidelex.llm.common import new_dir


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    bench = [decontam.simplified(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        at = new_dir(spark, "test")
        stage(spark, docs, DATA).write.parquet(at)
        out = spark.read.parquet(at)
        after = collections.Counter(r.doc_id for r in out.collect())
        if name != "mixing":
            assert out.columns == docs.columns and max(after.values()) == 1
        if name == "toxicity":
            flagged = toxicity.flag(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()
            assert set(after) == {d for d, _ in before} - {r.doc_id for r in flagged}
        elif name == "exact_dedup":
            assert sorted(after) == sorted(r[0] for r in brute_dedup(before) if r[3])
        elif name == "near_dedup":
            ids = sorted(d for d, _ in before)
            fp = {d: brute_fingerprint(t) for d, t in before}
            c = closure(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fp[ids[i]] ^ fp[ids[j]]).bit_count() <= 4])
            assert sorted(after) == [ids[i] for i in range(len(ids)) if c[i] == i]
        elif name == "decontamination":
            assert not {d for d, t in before if any(b in decontam.simplified(t) for b in bench)} & set(after)
            assert len(before) - len(after) < len(before) / 10
        else:
            copies = {r.doc_id: r.copies for r in mixing.plan(docs).collect()}
            assert after == collections.Counter({d: n for d, n in copies.items() if n})
        docs = out


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    count = lambda df: collections.Counter(map(tuple, df.collect()))
    assert count(out) == count(docs) and out.count() > 0


def test_odd_and_empty_tables_through_all_stages(spark, odd, none, tmp_path):
    """Nulls, ties, repeated and very long rows and clashing names pass all stages; what stays are rows of the table."""
    rows = collections.Counter(map(tuple, odd.collect()))
    for docs, some in ((odd, True), (none, False)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
            assert docs.columns == odd.columns
            got = collections.Counter(map(tuple, docs.collect()))
            assert set(got) <= set(rows) and (name == "mixing" or all(n <= rows[r] for r, n in got.items()))
            if name in ("exact_dedup", "near_dedup"):
                assert max(got.values(), default=1) == 1
            if name == "decontamination":
# 3, 4 and 7 have no words; 1, both rows 2, and 9 are alike
                assert {r[0] for r in got} == ({1, 3, None, 5, 6, 8} if some else set()) and len(got) == (6 if some else 0)




def test_order_of_rows_and_map_columns(spark):
    """Rows that differ in other columns only, maps at any depth among them: three orders of them give the same rows in every stage that drops or repeats some."""
    from pyspark.sql import functions as F

    rows = [(1, "some words that are here for all of them", "en", f"s{i % 2}", i) for i in range(20)] + [(i, f"another text number {i} with words of its own", "en", "s0", i) for i in range(2, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int").coalesce(1)
    df = df.select("*", F.create_map(F.lit("k"), F.col("n")).alias("m"), F.struct(F.array(F.create_map(F.lit("a"), F.col("n"))).alias("deep")).alias("s"))
    show = lambda x: collections.Counter((r.doc_id, r.source, r.n, r.m["k"], r.s.deep[0]["a"]) for r in x.collect())
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        got = [show(stage(spark, x, DATA)) for x in (df, df.orderBy(F.desc("n")).coalesce(1), df.repartition(5))]
        assert got[0] == got[1] == got[2] and got[0]
