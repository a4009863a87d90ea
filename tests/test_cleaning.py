import json
import random
import string
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import tokens
from tidemark.operators import active, aqp, evaluate, extract, features, matchers, resolution
from tidemark.operators.pipeline import Pipeline, run_pipeline, stage
from tidemark.operators.sample import WorkingSet, consistent
from tidemark.plans.parser import ParseError, parse
from tidemark.plans.scratch import SHUFFLE_CLEANUP_KEY, materialize
from tidemark.session import Session
from tidemark.sources.loaders import coerce, read_csv, read_text


def dirty_values(spark):
    """A header as a row, 100 values, and 100 that extend them by as many tokens: 201 values."""
    r = random.Random(1)
    token = lambda: "".join(r.choices(string.ascii_lowercase, k=7))
    base = [[token() for _ in range(10)] for _ in range(100)]
    values = ["col0"] + [" ".join(b) for b in base] + [" ".join(b + [token() for _ in range(10)]) for b in base]
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "id string, col0 string").repartition(3)


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("selectrawsc sum(a+b) from t where x = 'from where' group by g;", ("raw", "sum", "a+b", "t", "x = 'from where'", "g")),
        ("SelectNSC COUNT(1) FROM t", ("normalized", "count", "1", "t", None, None)),
        ("selectrawsc avg(f(a, g(b))) from t join u on t.k = u.k", ("raw", "avg", "f(a, g(b))", "t join u on t.k = u.k", None, None)),
    ],
)
def test_parser(sql, want):
    s = parse(sql)
    assert (s.mode, s.function, s.attr, s.source, s.where, s.group) == want


@pytest.mark.parametrize("sql", ["selectrawsc sum(a)", "selectrawsc median(a) from t", "selectrawsc sum(a), sum(b) from t", "selectrawsc sum((a) from t", "selectrawsc sum(a) from t where", "select 1", "selectrawsc sum(a) group by g from t"])
def test_parser_rejects(sql):
    with pytest.raises(ParseError):
        parse(sql)


def test_raw_of_everything_is_exact(spark):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("g"), (F.col("id") * 1.5).alias("x"))
    ws = WorkingSet.create(df, row_key=["id"], unique=True)
    got = {r.group: r.agg for r in ws.aqp("sum", "x", "id >= 10", "g").collect()}
    assert got == {str(g): sum(i * 1.5 for i in range(10, 100) if i % 4 == g) for g in range(4)}
    row = ws.aqp("count", where="id < 0").first()
    assert (row.group, row.agg, row.se) == ("1", 0.0, 0.0)
    assert ws.aqp("avg", "x").first().agg == pytest.approx(74.25)
    assert {r.agg for r in ws.aqp("sum", "x", mode="normalized").collect()} == {0.0}
    with pytest.raises(ValueError, match="median"):
        aqp.raw(ws.clean, "median")


def test_samples_are_unbiased(spark):
    df = spark.range(2000).select("id", F.lit(1.0).alias("x"))
    got = [WorkingSet.create(df, ratio=0.2, seed=s, row_key=["id"], unique=True).aqp("sum", "x").first().agg for s in range(4)]
    assert sum(got) / 4 == pytest.approx(2000, rel=0.1)
    part, ratio = consistent(df, "id", 0.3)
    assert ratio == pytest.approx(1 / 3) and 550 < part.count() < 780


def test_row_ids_are_unique_and_stable(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "x string")
    a, b = (sorted(r.hash for r in WorkingSet.create(df).clean.collect()) for _ in range(2))
    assert a == b and len(set(a)) == 4


def test_working_set_operations(spark, tmp_path):
    ws = WorkingSet.create(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string"), row_key=["id"], unique=True)
    heard = []
    ws.listeners.append(heard.append)
    one = ws.clean.where("id = 1").select("hash")
    ws.update_attr("v", one.withColumn("value", F.lit("z")))
    assert [r.v for r in ws.clean.orderBy("id").collect()] == ["z", None, None] and ws.columns == ["id", "v"]
    ws.reset().keep(one.union(one))
    assert ws.clean.count() == 1 and ws.reset().clean.count() == 3
    ws.update_dup(one.withColumn("dup", F.lit(5)))
    assert [r.dup for r in ws.clean.orderBy("id").collect()] == [5, 1, 1] and len(heard) == 5
    assert ws.write_back(str(tmp_path / "t")).columns == ["id", "v"]
    with pytest.raises(ValueError, match="cannot replace"):
        WorkingSet.create(spark.range(4), ratio=0.5).write_back()
    assert ws.column_index("V") == 3
    with pytest.raises(KeyError):
        ws.column_index("w")


def test_session(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,v\n1,"a,b"\n2,c\n')
    s = Session(spark)
    ws = s.load_csv(str(tmp_path / "t.csv"), [("id", "string"), ("v", "string")], "t")
    assert ws.clean.count() == 3
    assert s.sql("selectrawsc count(1) from t where v like '%b%'").first().agg == 1.0
    assert s.sql("select count(*) as n from t").first().n == 3
    with pytest.raises(KeyError):
        s.sql("selectrawsc count(1) from u")
    s.close()
    assert read_text(spark, str(tmp_path / "t.csv"), ",", ["a", "b", "c"]).where("c = ''").count() == 2
    assert coerce(spark.createDataFrame([("x", "1")], "a string, b string"), spark.createDataFrame([], "h string, n int").schema).first().n == 1
    assert read_csv(spark, str(tmp_path / "t.csv"), "id int, v string", header=True).count() == 2


def test_entity_resolution_fixture(spark):
    ws = WorkingSet.create(dirty_values(spark), row_key=["id"], unique=True)
    er = resolution.long("col0", 0.5, weighted=False).with_(tokenizer=tokens.white_space())
    er(ws)
    assert ws.clean.select("col0").distinct().count() == 101
    er.with_(threshold=0.51)(ws.reset())
    assert ws.clean.select("col0").distinct().count() == 201


def test_merge_strategies_and_nulls(spark):
    rows = [(1, "new york"), (2, "new york"), (3, "new york city"), (4, None), (5, "x")]
    for strategy, want in (("mostFrequent", "new york"), ("least concise", "new york city"), ("mostConcise", "new york")):
        ws = WorkingSet.create(spark.createDataFrame(rows, "id int, v string"), row_key=["id"], unique=True)
        resolution.long("v", 0.6, False).with_(strategy=strategy)(ws)
        assert [r.v for r in ws.clean.orderBy("id").collect()] == [want] * 3 + ["", "x"]
    with pytest.raises(ValueError, match="not mostConcise"):
        resolution.merge_order("largest")


def test_record_dedup(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "a b c d e"), (4, "q"), (5, None)]
    ws = WorkingSet.create(spark.createDataFrame(rows, "id int, v string"), row_key=["id"], unique=True)
    resolution.RecordDeduplication(["v"], 0.75, False)(ws)
    assert [r.dup for r in ws.clean.orderBy("id").collect()] == [3, 3, 3, 1, 1]


def test_extraction(spark):
    df = spark.createDataFrame([("a-b",), ("a",), (None,)], "v string")
    assert [tuple(r) for r in extract.split("v", "-", ["x", "y"]).apply(df).collect()] == [("a-b", "a", "b"), ("a", "a", ""), (None, "", "")]
    assert extract.fast_split("v", "-", ["x", "y"]).apply(df).collect()[1].y is None
    learned = extract.LearnedSplit("v", ["x", "y"]).add("1-2", ["1", "2"])
    ws = learned(WorkingSet.create(df))
    assert {r.y for r in ws.clean.collect()} == {"b", ""} and "y" in ws.dirty.columns
    with pytest.raises(ValueError, match="delimiter"):
        extract.LearnedSplit("v", ["x"]).split()


def test_hybrid_routing_splits_all_pairs(spark):
    pairs = spark.range(200).select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    low, high = matchers.shares([0.3, 0.7])
    assert matchers.Hybrid().add(low, matchers.all_pairs).add(high, matchers.all_pairs)(pairs).count() == 200
    assert 30 < pairs.where(low).count() < 90
    with pytest.raises(ValueError, match="sum to 1"):
        matchers.shares([0.5, 0.4])


def test_pipeline_specs(spark):
    df = spark.createDataFrame([(1, "aa bb cc"), (2, "aa bb cc"), (3, "aa bb cc dd"), (4, "zz")], "id int, v string")
    sets = {"d": WorkingSet.create(df, row_key=["id"], unique=True)}
    spec = {"dataset": "d", "sql_query": "select count(distinct v) as n from $t", "stages": [{"operator": "attrdedup", "field": "v", "options": {"similarity": "jaccard", "threshold": 0.5}}]}
    got = run_pipeline(json.dumps(spec), sets)["0"]
    assert [d.first().n for d in got] == [3, 2]
    with pytest.raises(ValueError, match="unknown stage"):
        stage({"name": "nothing"})
    with pytest.raises(ValueError, match="learns"):
        stage({"name": "activeLearningER", "attribute": "v"})
    assert Pipeline([lambda w: w.reset()]).run(sets["d"], background=True).result() is sets["d"]


def test_feature_view(spark):
    df = spark.createDataFrame([("b a", "2"), (None, "x")], "t string, n string")
    got = [r.features.toArray().tolist() for r in features.feature_view(df, [("n", "number"), ("t", "text")]).collect()]
    assert got == [[2.0, 1.0, 1.0], [0.0, 0.0, 0.0]]


def test_active_learning(spark):
    from pyspark.ml.functions import array_to_vector

    points = spark.range(60).select(F.col("id").cast("string").alias("id"), array_to_vector(F.array((F.col("id") - 30) * 1.0)).alias("features"))
    truth = spark.range(60).select(F.col("id").cast("string").alias("id"), (F.col("id") >= 30).cast("double").alias("label"))
    learner = active.ActiveLearner(active.svm(10, 0.01), active.margin_selector, active.TableLabels(truth), budget=14, batch=2, bootstrap=10)
    last = learner.fit(points)
    assert last.spent == 14 and last.labelled.count() >= 14
    assert active.train_error(last.model, points.join(truth, "id")) < 0.1
    with pytest.raises(LookupError):
        active.labelled(points, active.TableLabels(truth.limit(3)))
    forest = active.ActiveLearner(active.forest(5), active.uncertainty_selector, active.TableLabels(truth), budget=12, batch=2, bootstrap=10).fit(points)
    assert forest.labelled.count() == 12


def test_evaluation_and_tuning(spark):
    rows = [(1, "a b c d"), (2, "a b c"), (3, "a b"), (4, "q r")]
    ws = WorkingSet.create(spark.createDataFrame(rows, "id int, v string"), row_key=["id"], unique=True)
    groups = ws.clean.select("hash", F.when(F.col("id") < 4, 0).otherwise(1).alias("group"))
    binary = evaluate.from_groups(groups, "v")
    assert binary.count() == 12
    assert evaluate.tune_threshold(ws, binary, "v") == pytest.approx(2 / 3)
    assert evaluate.persistence_threshold(ws, binary, "v") == pytest.approx(0.75)
    assert evaluate.candidate_count(ws.clean, "v", 0.6) == 4 + 2 * 2
    # jaccard keeps the three together at 2/3, cosine at sqrt(2/3) = 0.816: both leave the pairs (1, 2) and (2, 3), and the first wins
    assert evaluate.choose_metric(ws, binary, "v") == ("jaccard", pytest.approx(2 / 3))
    assert evaluate.choose_metric(ws, binary, "v", ("cosine",)) == ("cosine", pytest.approx((2 / 3) ** 0.5))
    assert resolution.long("v").auto(ws, binary).threshold == pytest.approx(2 / 3)
    assert resolution.long("v").tune(ws, binary).threshold == pytest.approx(2 / 3)
    assert resolution.long("v").tune_persistent(ws, binary).threshold == pytest.approx(0.75)
    got = evaluate.Evaluator(ws, binary=binary).evaluate({"none": lambda w: w, "er": resolution.long("v", 0.6, False)})
    assert got["none"]["binary"] == 0.5 and got["er"]["binary"] == 1.0


def test_streamed_labels_resolve_incrementally(spark, tmp_path):
    from tidemark.streaming import labels

    ws = WorkingSet.create(spark.createDataFrame([(1, "a"), (2, "a1"), (3, "b")], "id int, v string"), row_key=["id"], unique=True)
    er = resolution.IncrementalResolution(ws, "v", "leastConcise")
    ids = {r.value: r.id for r in er.values.collect()}
    pairs = spark.createDataFrame([("p", ids["a"], ids["a1"]), ("q", ids["a"], ids["b"])], "id string, id_a string, id_b string")
    for i, (p, y) in enumerate((("p", 1.0), ("q", 0.0), ("p", 1.0))):
        (tmp_path / f"{i}.json").write_text(json.dumps({"group_id": "g", "id": p, "label": y, "worker": f"w{i}"}) + "\n")
    q = labels.stream_resolution(er, pairs, labels.answer_stream(spark, str(tmp_path)))
    q.awaitTermination()
    assert [r.v for r in ws.clean.orderBy("id").collect()] == ["a1", "a1", "b"]
    answers = spark.read.schema(labels.ANSWERS).json(str(tmp_path))
    assert labels.pending(pairs, answers).count() == 0 and labels.unknown(pairs, answers).count() == 0
    points = pairs.select("id", labels.er_context(["id_a"], ["id_b"]).alias("context"))
    made = [json.loads(r.value) for r in labels.requests(points, "g", labels.RequestConfig()).collect()]
    assert sum(len(m["content"]) for m in made) == 2 and made[0]["configuration"]["task_type"] == "er"


def test_updates_refuse_clashing_values(spark):
    ws = WorkingSet.create(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), row_key=["id"], unique=True)
    one = ws.clean.where("id = 1").select("hash", F.lit("z").alias("value"))
    ws.update_attr("v", one.union(one), missing="keep")
    assert sorted(r.v for r in ws.clean.collect()) == ["b", "z"]
    ws.update_attr("v", one.union(one.withColumn("value", F.lit("y"))))
    with pytest.raises(Exception, match="two different values"):
        ws.clean.collect()


def test_sample_joins_know_both_tables(spark):
    s = Session(spark)
    s.sample(spark.createDataFrame([(1, 10.0), (2, 20.0)], "k int, price double"), "a", row_key=["k"], unique=True)
    s.sample(spark.createDataFrame([(1, 1000.0, "x"), (1, 500.0, "y"), (3, 7.0, "x")], "k int, price double, note string"), "b")
    get = lambda q: {r.group: r.agg for r in s.sql(q).collect()}
    assert get("selectrawsc sum(b.price) from a join b on a.k = b.k") == {"1": 1500.0}
    assert get("selectrawsc sum(a.price) from a join b on a.k = b.k where 'a.k' = 'k'") == {"1": 0.0}
    assert get("selectrawsc count(1) from b join a on a.k = b.k where a.price > 5 group by note") == {"x": 1.0, "y": 1.0}
    assert get("selectnsc sum(b.price) from a join b on a.k = b.k group by a.k") == {"1": 0.0, "2": 0.0}
    s.sample(spark.range(100).withColumnRenamed("id", "k"), "c", 0.5)
    with pytest.raises(ValueError, match="whole table"):
        s.sql("selectrawsc count(1) from a join c on a.k = c.k")


def test_saved_sets_and_cleanup(spark):
    from tidemark.sources import catalog

    s = Session(spark)
    s.sample(spark.range(10), "saved_t", 0.5, key="id")
    s.save("saved_t")
    again = Session(spark).open("saved_t")
    assert again.ratio == 0.5 and again.clean.count() == s.get("saved_t").clean.count() and again.base.count() == 10
    assert catalog.column_indexes(spark, "saved_t_clean", ["ID", "hash"]) == [2, 0]
    with pytest.raises(KeyError, match="no column"):
        catalog.column_indexes(spark, "saved_t_clean", ["nope"])
    with pytest.raises(ValueError, match="has the columns"):
        catalog.overwrite(spark.range(3), "saved_t_clean")
    s.close()
    assert not spark.catalog.tableExists("saved_t_clean")


def test_learned_similarity_and_regressor(spark):
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}", "same words here", "same words here" if i % 2 else "other thing") for i in range(24)], "id_a string, id_b string, value_a string, value_b string")
    truth = spark.createDataFrame([(f"a{i}/b{i}", float(i % 2)) for i in range(24)], "id string, label double")
    for estimator, selector in ((active.svm(20, 0.01), active.margin_selector), (active.forest_regressor(5), active.uncertainty_selector)):
        heard = []
        learned = active.LearnedSimilarity(active.ActiveLearner(estimator, selector, active.TableLabels(truth), budget=14, batch=2, bootstrap=10), on_model=[heard.append])
        with pytest.raises(ValueError, match="train"):
            learned(pairs)
        learned.train(pairs)
        assert len(heard) >= 2 and sorted(r.id_a for r in learned(pairs).collect()) == sorted(f"a{i}" for i in range(1, 24, 2))
    ws = WorkingSet.create(spark.createDataFrame([(i, f"name {i % 3}") for i in range(6)], "id int, v string"), row_key=["id"], unique=True)
    a, b = ws.clean.select(F.col("hash").alias("hash1"), F.col("v").alias("x")), ws.clean.select(F.col("hash").alias("hash2"), F.col("v").alias("y"))
    both = a.join(b, F.col("hash1") < F.col("hash2"))
    labels = both.select(F.concat_ws("/", "hash1", "hash2").alias("id"), (F.col("x") == F.col("y")).cast("double").alias("label"))
    got = evaluate.bought_constraints(ws, "v", active.ActiveLearner(active.svm(10, 0.01), active.margin_selector, active.TableLabels(labels), budget=15, batch=5, bootstrap=15), both)
    assert got.count() == 15 and got.where("same").count() == 3


def test_crowd_strategy(spark, tmp_path):
    from tidemark.streaming import labels

    points = spark.createDataFrame([("p", "x"), ("q", "y")], "id string, context string")
    (tmp_path / "in").mkdir()
    crowd = labels.CrowdStrategy(spark, str(tmp_path / "out"), str(tmp_path / "in"))
    heard = []
    for i, (p, y) in enumerate((("p", 1.0), ("other", 1.0))):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"group_id": "g", "id": p, "label": y, "worker": "w"}) + "\n")
    with pytest.raises(TimeoutError, match="1 points"):
        crowd.run(points, "g", lambda d: heard.extend(r.id for r in d.collect()), str(tmp_path / "c"))
    (tmp_path / "in" / "2.json").write_text(json.dumps({"group_id": "g", "id": "q", "label": 0.0, "worker": "w"}) + "\n")
    got = {r.id: r.label for r in crowd.run(points, "g", lambda d: heard.extend(r.id for r in d.collect()), str(tmp_path / "c")).collect()}
    assert got == {"p": 1.0, "q": 0.0} and heard == ["p", "q"]
    assert spark.read.text(str(tmp_path / "out")).count() >= 2
    answers = labels.FileLabels(spark, str(tmp_path / "in")).label(points)
    assert {r.id for r in answers.collect()} == {"p", "q"}
    assert points.select(labels.sa_context("context").alias("c")).first().c == "x"


def test_written_tables_leave_no_shuffle_files(spark):
    def left() -> int:
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(blocks.apply(i).getName().startswith("shuffle_") for i in range(blocks.size()))

    before, own = left(), spark.conf.get(SHUFFLE_CLEANUP_KEY, None)
    counted = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.1)
    assert left() <= before and counted.count() == 7 and spark.conf.get(SHUFFLE_CLEANUP_KEY, None) == own
