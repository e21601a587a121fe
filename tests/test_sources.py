import pytest
from pyspark.sql import functions as F

from proseweave.operators import corpus as K
from proseweave.operators import review as R
from proseweave.sources import corpora as C


def altered(spark, n=3):
    return spark.createDataFrame(
        [(f"p{i}", "g", "m", 1.5, 3, f"({i}, {i + 2})", "['close']", f"One, two.\nThree {i}.") for i in range(n)], C.ALTERED
    )


def test_delimited_round_trip(spark, tmp_path):
    df = altered(spark)
    for sep in (",", "\t"):
        path = str(tmp_path / ("c" if sep == "," else "t"))
        C.write_delimited(df, path, sep)
        back = C.read_delimited(spark, path, C.ALTERED)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
        with pytest.raises(Exception):
            C.write_delimited(df, path, sep)


def test_sweep_parameters_come_from_the_folder(spark, tmp_path):
    for q, band in (("0.9", ""), ("0.1", "_temperature_2-3")):
        C.write_delimited(altered(spark), str(tmp_path / f"online_phi_paraphrase-gpt-3.5-turbo_n1_p0.1_q{q}_alpha0-5{band}"), "\t")
    got = C.read_sweep(spark, str(tmp_path / "online_*"))
    rows = got.select("llm_model", "paraphrase_model", "nb_paraphrase_max", "p_paraphrase", "q_paraphrase", "alpha_paraphrase", "temperature_band").distinct().collect()
    assert {tuple(r) for r in rows} == {("phi", "gpt-3.5-turbo", 1, 0.1, 0.9, 0.5, ""), ("phi", "gpt-3.5-turbo", 1, 0.1, 0.1, 0.5, "_temperature_2-3")}
    agg = K.aggregate_corpora(got)
    assert agg.count() == 6 and agg.where("one_paraphrase").count() == 6


def test_stages_and_parameters(spark, tmp_path):
    df = spark.range(5)
    assert C.stage(df, str(tmp_path / "s")).count() == 5
    C.write_once(df, str(tmp_path / "o"))
    C.write_once(spark.range(9), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5
    C.save_parameters(spark, {"alpha": 0.5}, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).first()["alpha"] == "0.5"


def test_resumable_batches(spark, tmp_path):
    from proseweave.streaming.resumable import enrich_new_rows, run_new_files

    src, out = spark.range(10).withColumn("x", F.col("id") * 2), str(tmp_path / "done")
    enrich = lambda d: d.withColumn("y", F.col("x") + 1)
    assert enrich_new_rows(src.where("id < 4"), enrich, out, "id") == 4
    assert enrich_new_rows(src, enrich, out, "id") == 6
    assert enrich_new_rows(src, enrich, out, "id") == 0
    assert sorted(r["y"] for r in spark.read.parquet(out).collect()) == [2 * i + 1 for i in range(10)]
    with pytest.raises(ValueError):
        enrich_new_rows(src.withColumn("id", F.col("id") + 100), lambda d: d.where("x > 5"), out, "id")
    inbox = str(tmp_path / "inbox")
    src.write.parquet(inbox)
    for _ in range(2):
        run_new_files(spark, inbox, src.schema, enrich, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_batches_in_order_survive_a_break(spark, tmp_path, monkeypatch):
    from proseweave.streaming import resumable as B

    src, path = spark.range(23).withColumn("x", F.col("id") * 7 % 23).repartition(5), str(tmp_path / "b")
    enrich = lambda d: d.withColumn("y", F.col("x") + 1)
    commit, calls = B._commit, []

    def breaks(*args):
        calls.append(args)
        if len(calls) == 3:
            raise RuntimeError("lost")
        commit(*args)

    monkeypatch.setattr(B, "_commit", breaks)
    with pytest.raises(RuntimeError):
        B.enrich_in_order(src, enrich, path, "id", ["x"], 4)
    # the third batch is written but not committed
    assert len(list((tmp_path / "b" / "data").iterdir())) == 3
    assert [r["x"] for r in B.committed_rows(spark, path).orderBy("order_number").collect()] == list(range(8))
    monkeypatch.setattr(B, "_commit", commit)
    assert B.enrich_in_order(src, enrich, path, "id", ["x"], 4) == 15
    assert B.enrich_in_order(src, enrich, path, "id", ["x"], 4) == 0
    rows = B.committed_rows(spark, path).orderBy("order_number").collect()
    assert [(r["order_number"], r["x"], r["y"]) for r in rows] == [(i, i, i + 1) for i in range(23)]
    assert [tuple(r) for r in B.manifest(spark, path).orderBy("batch").select("batch", "first", "n").collect()] == [(0, 0, 4), (1, 4, 4), (2, 8, 4), (3, 12, 4), (4, 16, 4), (5, 20, 3)]
    # later rows go on behind, whatever their place; a batch that loses rows is not committed
    more = src.union(spark.createDataFrame([(99, -1)], "id long, x long"))
    with pytest.raises(ValueError):
        B.enrich_in_order(more, lambda d: d.where("x > 0"), path, "id", ["x"], 4)
    assert B.enrich_in_order(more, enrich, path, "id", ["x"], 4) == 1
    assert B.committed_rows(spark, path).where("order_number = 23").first()["id"] == 99
    assert B.enrich_in_order(src.where("id < 0"), enrich, str(tmp_path / "none"), "id", ["x"]) == 0


def test_offline_insertion_rejects_bad_positions(spark):
    df = spark.createDataFrame([(1, "a. b. c", [1, 2]), (2, "a. b", [9, 1])], "id int, text string, index_paraphrase array<int>")
    para = lambda s: s.select("sentence", F.upper("sentence").alias("paraphrase"))
    got = {r["id"]: r for r in K.alter_offline(df, para).collect()}
    assert got[1]["altered_text"] == "a. b.  B. c" and got[1]["error"] is None
    assert got[2]["altered_text"] == "a. b" and got[2]["error"]


def test_review_round(spark):
    q = R.review_queue(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, altered_text string"))
    v = spark.createDataFrame([(1, True), (2, False)], "k int, good boolean")
    done = R.apply_verdicts(q, v, "k")
    assert {(r["k"], r["evaluation"], r["verified"]) for r in done.collect()} == {(1, 1, 1), (2, 0, 1), (3, 0, 0)}
    assert R.review_queue(q, done).count() == 1
    assert R.progress(done).first()["percent"] == pytest.approx(200 / 3)
