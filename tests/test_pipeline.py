"""Tables in, scores out: fitted state, payloads, storage, streams, and hot clients."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from oracle import rows_of
from revisit.operators.hot import HotPolicy
from revisit.plans import durable as durable_module
from revisit.plans.features import FeaturePipeline, FeatureSettings
from revisit.plans.score import score_json, support_flags
from revisit.plans.train import ScoringModel, forest, report, retrain, ridge, train
from revisit.schema import CHILD_TABLES, MASTER, REQUIRED_TABLES, EventColumns
from revisit.sources.payloads import (
    inferred_text_schema,
    parse_payloads,
    payload_tables,
    read_payloads,
    write_payload_lines,
)
from revisit.sources.sinks import write_features, write_scores
from revisit.sources.tables import (
    check_tables,
    children_of_events,
    empty_table,
    parquet_tables,
)
from revisit.streaming.scoring import (
    latest_tables,
    newest_scores,
    stream_scores,
    with_arrival,
)

AS_OF = "2018-08-19 14:09:15"


def make_payload(client, rng):
    """One client's whole history in the nested format."""
    moment = datetime(2015, 1, 1) + timedelta(days=rng.randint(0, 200), hours=rng.randint(0, 23))
    payload = {name: [] for name in REQUIRED_TABLES}
    payload["client"].append(
        {
            "clientid": client,
            "clientdateofbirth": f"{1950 + client}-03-01T00:00:00",
            "addresssincedate": "2014-05-06T00:00:00" if client % 2 else None,
            "clientismale": bool(client % 2),
            "partnerid": 4 if client % 3 == 0 else None,
            "clientcountryid": client % 3 or None,
            "clientaddresstypeid": 1 + client % 2,
            "addresslocalityid": 7,
            "clientresidencyid": None,
        }
    )
    payload["clientissue"] = [{"clientid": client, "clientissueid": i} for i in (1, client % 3)]
    for i in range(5 + client * 2):
        event = client * 1000 + i
        payload["referral"].append(
            {
                "referralinstanceid": event,
                "clientid": client,
                "referraltakendate": moment.isoformat(),
                "statusid": 2,
                "referralnotes": "text",
            }
        )
        for name, (key, item) in CHILD_TABLES.items():
            for _ in range(rng.randint(0, 2)):
                payload[name].append({key: event, item: rng.randint(1, 4)})
        moment += timedelta(days=rng.choice([0, 3, 7, 7, 14, 40]), hours=rng.choice([0, 0, 5]))
    return payload


@pytest.fixture(scope="module")
def payloads():
    rng = random.Random(5)
    return [make_payload(c, rng) for c in range(1, 9)]


@pytest.fixture(scope="module")
def lines(spark, payloads, tmp_path_factory):
    path = tmp_path_factory.mktemp("payloads") / "lines.json"
    path.write_text("\n".join(json.dumps(p) for p in payloads))
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, lines):
    staged = durable_module.durable(read_payloads(spark, lines), "test-payloads")
    return payload_tables(staged)


@pytest.fixture(scope="module")
def trained(tables):
    return train(tables, AS_OF, ridge(0.01), test=True)


@pytest.fixture(scope="module")
def batch_scores(trained, tables):
    return {r.referralinstanceid: r.score for r in trained.model.predict(tables).collect()}


def test_expected_feature_groups(trained):
    columns = trained.model.features.column_schema
    for part in (
        "referralissue_1_current", "referralissue_1_ever", "referraldocument_2",
        "referraldietaryrequirements_3", "clientissue_1", "client_age", "client_knownpartner",
        "client_clientcountryid_2", "timefeature_indexinburst", "window_count_12",
    ):
        assert part in columns
    for absent in (
        "referral_statusid", "referral_referralnotes", "timefeature_burstnumber",
        "timefeature_referralnumber", "client_clientid", "referraldocument_2_ever",
    ):
        assert absent not in columns


def test_training_matrix_is_clipped_and_complete(trained, payloads):
    times = [r["referraltakendate"] for p in payloads for r in p["referral"]]
    newest = max(datetime.fromisoformat(t) for t in times)
    limit = newest - timedelta(days=365)
    assert trained.matrix.count() == sum(datetime.fromisoformat(t) <= limit for t in times)
    nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in trained.model.features.column_schema]
    assert set(trained.matrix.select(nulls).first()) == {0}


def test_metrics_are_correlations(trained):
    row = trained.metrics.first()
    assert set(trained.metrics.columns) == {"spearman", "overlap"}
    assert row.spearman is None or -1 <= row.spearman <= 1
    made = report(trained, trained.metrics).first()
    assert made.feature_columns == len(trained.model.features.column_schema)


def test_one_client_alone_scores_as_in_the_batch(spark, trained, payloads, batch_scores):
    assert len(batch_scores) == sum(len(p["referral"]) for p in payloads)
    for one in (payloads[0], payloads[5]):
        rows = spark.createDataFrame([(json.dumps(one),)], "body string")
        alone = score_json(trained.model, rows, "body").collect()
        assert len(alone) == len(one["referral"])
        for r in alone:
            assert abs(r.score - batch_scores[r.referralinstanceid]) < 1e-9


def test_empty_children_and_unseen_categories(spark, trained, payloads):
    one = json.loads(json.dumps(payloads[0]))
    for name in CHILD_TABLES:
        one[name] = []
    one["referralissue"] = [
        {"referralinstanceid": one["referral"][0]["referralinstanceid"], "clientissueid": 99}
    ]
    rows = spark.createDataFrame([(json.dumps(one),)], "body string")
    tables = payload_tables(parse_payloads(rows, "body"))
    made = trained.model.features.transform(tables)
    schema = trained.model.features.column_schema
    assert made.columns[-len(schema):] == schema
    children = [c for c in schema if c.startswith(tuple(CHILD_TABLES))]
    for row in made.select(children).collect():
        assert set(row) == {0.0}


def test_client_rows_missing_or_twice(spark, trained, tables):
    client = tables["client"]
    changed = client.where("clientid <> 2").unionByName(client.where("clientid = 3"))
    made = trained.model.features.transform({**tables, "client": changed})
    assert made.count() == tables["referral"].count()
    orphan = made.where(F.col(MASTER.entity) == 2)
    assert orphan.count() > 0
    for row in orphan.select("client_age", "client_clientismale", "window_count_4").collect():
        assert tuple(row) == (0.0, 0.0, 0.0)


def test_hot_clients_give_the_same_features(tables):
    features = FeaturePipeline.fit(tables, AS_OF)
    some_hot = HotPolicy(min_rows=12, chunks=4)
    expected = features.training_rows(tables)
    made = features.training_rows(tables, some_hot)
    assert made.columns == expected.columns
    a = rows_of([r.asDict() for r in expected.collect()], expected.columns)
    b = rows_of([r.asDict() for r in made.collect()], expected.columns)
    assert a == b


def test_model_survives_storage(spark, trained, tables, batch_scores, tmp_path):
    trained.model.save(spark, str(tmp_path / "m"))
    loaded = ScoringModel.load(spark, str(tmp_path / "m"))
    assert loaded.features.column_schema == trained.model.features.column_schema
    for r in loaded.predict(tables).collect():
        assert abs(r.score - batch_scores[r.referralinstanceid]) < 1e-9


def test_forest_and_retrain(spark, tables, tmp_path):
    small = forest({"numTrees": 5, "maxDepth": 4})
    made = retrain(tables, AS_OF, str(tmp_path / "v2"), "2", small).first()
    assert made.training_rows > 0 and made.model_version == "2"
    scores = ScoringModel.load(spark, str(tmp_path / "v2")).predict(tables)
    row = scores.agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    row = row.first()
    assert row.n == tables["referral"].count()
    assert 0 <= row.lo < row.hi  # a forest cannot leave the range of its labels
    assert {r.model_version for r in scores.select("model_version").distinct().collect()} == {"2"}


def test_count_encoding_mode(tables):
    features = FeaturePipeline.fit(tables, AS_OF, FeatureSettings(encode_counts=True))
    fitted = features.consolidation.children["referralissue"]
    names = {f"referralissue_{n}_ever" for n in fitted.values()}
    assert names <= set(features.column_schema)
    assert features.transform(tables).count() == tables["referral"].count()


def test_stream_scores_like_the_batch(spark, trained, payloads, batch_scores, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    old = json.loads(json.dumps(payloads[0]))
    old["referral"] = old["referral"][:1]
    (source / "a.json").write_text(json.dumps(old))
    (source / "b.json").write_text("\n".join(json.dumps(p) for p in payloads))
    paths = [str(tmp_path / n) for n in ("in", "out", "state")]
    stream_scores(spark, trained.model, *paths).awaitTermination()
    found = {r.referralinstanceid: r.score for r in spark.read.parquet(paths[1]).collect()}
    assert found.keys() == batch_scores.keys()
    assert all(abs(found[k] - batch_scores[k]) < 1e-9 for k in found)
    (source / "c.json").write_text(json.dumps(payloads[2]))
    stream_scores(spark, trained.model, *paths).awaitTermination()
    again = spark.read.parquet(paths[1])
    assert again.count() == len(batch_scores) + len(payloads[2]["referral"])
    assert again.select("batch_id").distinct().count() == 2


def test_newest_object_wins_per_event(spark, lines):
    rows = read_payloads(spark, lines)
    old = rows.select("*", F.lit(1).alias("arrived"), F.lit("f").alias("file"))
    new = rows.where("client[0].clientid = 1").select(
        *[F.slice("referral", 1, 2).alias(c) if c == "referral" else F.col(c) for c in rows.columns],
        F.lit(2).alias("arrived"),
        F.lit("g").alias("file"),
    )
    doubled = durable_module.durable(with_arrival(old.unionByName(new).unionByName(new)), "twice")
    kept, plain = latest_tables(doubled), payload_tables(rows)
    for name in ("referral", "client", "referralissue"):
        assert kept[name].count() == plain[name].count()
    assert kept["clientissue"].where("clientid <> 1").count() == (
        plain["clientissue"].where("clientid <> 1").count()
    )


def test_payload_formats(spark, lines, payloads, tmp_path):
    whole = tmp_path / "whole.json"
    whole.write_text(json.dumps(payloads, indent=1))
    array = payload_tables(read_payloads(spark, str(whole), multi_line=True))
    per_line = payload_tables(read_payloads(spark, lines))
    for name in REQUIRED_TABLES:
        assert array[name].count() == per_line[name].count()
    write_payload_lines(read_payloads(spark, str(whole), multi_line=True), str(tmp_path / "again"))
    again = payload_tables(read_payloads(spark, str(tmp_path / "again")))
    assert again["referral"].count() == per_line["referral"].count()
    limited = payload_tables(read_payloads(spark, lines), limit=3)
    assert {r.clientid for r in limited["client"].collect()} == {1, 2, 3}


def test_missing_keys_and_double_encoding(spark):
    body = json.dumps({"referral": [{"referralinstanceid": 1, "clientid": 2}], "client": []})
    rows = spark.createDataFrame([(body,), (json.dumps(body),)], "b string")
    tables = payload_tables(parse_payloads(rows, "b"))
    assert tables["referral"].count() == 2
    assert tables["client"].count() == tables["clientissue"].count() == 0


def test_required_tables(spark, tables):
    with pytest.raises(ValueError, match="referraldocument"):
        check_tables({k: v for k, v in tables.items() if k != "referraldocument"})
    with pytest.raises(ValueError, match="no rows"):
        FeaturePipeline.fit({**tables, "client": empty_table(spark, "client")}, AS_OF)


def test_bad_time_fails_unless_lenient(spark, tables):
    from revisit.sources.tables import conform

    bad = tables["referral"].withColumn("referraltakendate", F.lit("never"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        conform({**tables, "referral": bad})["referral"].collect()
    lenient = conform({**tables, "referral": bad}, strict=False)["referral"]
    assert lenient.where("referraltakendate IS NULL").count() == bad.count()


def test_parquet_tables_with_id_limit(spark, tables, tmp_path):
    for name, df in tables.items():
        df.toDF(*[c.upper() for c in df.columns]).write.parquet(str(tmp_path / name))
    read = parquet_tables(spark, str(tmp_path), id_below=2000)
    assert read["referral"].agg(F.max("referralinstanceid")).first()[0] < 2000
    plan = read["referral"]._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(REFERRALINSTANCEID,2000)" in plan
    kept = children_of_events(read)["referralissue"]
    assert kept.agg(F.max("referralinstanceid")).first()[0] < 2000


def test_writers(spark, trained, tables, tmp_path):
    write_scores(trained.model.predict(tables), str(tmp_path / "s"), "json")
    assert spark.read.json(str(tmp_path / "s")).count() == tables["referral"].count()
    write_features(trained.matrix, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == trained.matrix.count()
    assert "month" in back.columns


def test_support_flags(spark, trained, tables):
    from revisit.sources.tables import conform

    events = conform(tables)["referral"].select("referralinstanceid", "clientid", "referraltakendate")
    cols = EventColumns("referralinstanceid", "clientid", "referraltakendate")
    made = support_flags(trained.model.predict(tables), events, cols)
    n = made.count()
    assert n == events.count()
    assert abs(made.where("flagged").count() / n - 0.1) < 0.05
    fixed = support_flags(trained.model.predict(tables), events, cols, threshold=1e9)
    assert fixed.where("flagged").count() == 0


def test_undeclared_columns_reach_json_scores(spark, tables, payloads):
    """A numeric column that no schema declares is a feature, from tables and from JSON alike."""
    more = json.loads(json.dumps(payloads))
    for p in more:
        for r in p["referral"]:
            r["householdsize"] = r["referralinstanceid"] % 7
    rows = spark.createDataFrame([(json.dumps(p),) for p in more], "b string")
    schema = inferred_text_schema(rows, "b")
    assert "householdsize" in schema["referral"].dataType.elementType.names
    wide = payload_tables(durable_module.durable(parse_payloads(rows, "b", schema), "wide"))
    model = train(wide, AS_OF, ridge(0.01)).model
    assert "referral_householdsize" in model.features.column_schema
    batch = {r.referralinstanceid: r.score for r in model.predict(wide).collect()}
    found = {r.referralinstanceid: r.score for r in score_json(model, rows, "b").collect()}
    assert found.keys() == batch.keys()
    assert all(abs(found[k] - batch[k]) < 1e-9 for k in found)


def test_last_scores_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, "1", 0), (2, 0.1, "1", 0), (1, 0.7, "1", 3)],
                                 "referralinstanceid bigint, score double, model_version string, batch_id int")
    rows.write.partitionBy("batch_id").parquet(str(tmp_path / "out"))
    made = {r.referralinstanceid: r.score for r in newest_scores(spark, str(tmp_path / "out")).collect()}
    assert made == {1: 0.7, 2: 0.1}


def test_shared_folder_on_any_file_system(spark, tmp_path, monkeypatch):
    from revisit.plans.durable import durable_at, forget, scratch

    monkeypatch.setattr(durable_module, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    copy, path = durable_at(spark.range(5), "numbers")
    assert copy.count() == 5 and list((tmp_path / "shared").iterdir())
    forget(spark, path)
    with scratch(spark, "more") as place:
        spark.range(2).write.parquet(place)
    assert not list((tmp_path / "shared").iterdir())


def test_forest_queries_grow_the_default_forests(spark, monkeypatch):
    from workload import model_queries

    class Asked(Exception):
        pass

    def learner_of(job, query):
        def stop(*args, **kwargs):
            raise Asked(next(a for a in args if hasattr(a, "getNumTrees")))

        monkeypatch.setattr(model_queries.training, job, stop)
        with pytest.raises(Asked) as asked:
            query(spark, "/root/testdata/sf0.001")
        monkeypatch.undo()
        return asked.value.args[0].getNumTrees(), asked.value.args[0].getMaxDepth()

    default = (forest().getNumTrees(), forest().getMaxDepth())
    assert default == (120, 10)
    assert learner_of("train", model_queries.forest_scores) == default
    assert learner_of("retrain", model_queries.retrain_report) == default
    assert learner_of("train", model_queries.alternative_forest_scores) == (150, 10)
