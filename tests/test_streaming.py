import pandas as pd

from quarry.plans import entities as plans
from quarry.streaming import entities, messages
from tests.oracle import DATA, same


def test_changes_apply_in_batches(spark, tmp_path):
    schema = "source string, id long, type string, at long, text string"
    batches = [
        [("a", 1, "new", 1, "x"), ("a", 2, "new", 2, "y"), ("a", 1, "edit", 3, "x2")],
        [("a", 2, "delete", 4, None), ("b", 1, "new", 5, "z")],
        [("b", 1, "edit", 6, "z2")],
    ]
    apply = messages.apply_changes(f"file://{tmp_path}/t", ["source", "id"], ["at"])
    for n, rows in enumerate(batches):
        apply(spark.createDataFrame(rows, schema), n)
    apply(spark.createDataFrame(batches[2], schema), 2)  # a batch that comes again
    got = sorted((r.source, r.id, r.text) for r in spark.read.parquet(f"file://{tmp_path}/t/2").collect())
    assert got == [("a", 1, "x2"), ("b", 1, "z2")]


def test_rate_limit_opens_a_window_with_the_first_event(spark, tmp_path):
    rows = pd.DataFrame({"user": ["u"] * 5 + ["v"], "at": pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 00:00:20", "2024-01-01 00:01:00", "2024-01-01 00:01:05", "2024-01-01 00:00:00"])})
    df = spark.createDataFrame(rows)
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = messages.limit_rate(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), "user", "at", 2, "1min")
    stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").orderBy("user", "at").collect()
    assert [r.allowed for r in got] == [True, True, False, True, True, True]


def test_old_messages_and_deletions_go(spark):
    df = spark.createDataFrame([(1, "new", "2024-01-01"), (1, "edit", "2024-01-05"), (2, "new", "2024-01-05"), (2, "delete", "2024-01-06"), (3, "new", "2023-01-01")], "id long, type string, at string").selectExpr("id", "type", "cast(at as timestamp_ntz) at")
    assert [r.id for r in messages.current_messages(df, ["id"], ["at"], "2023-12-01").collect()] == [1]


def test_keys_are_worked_out_for_last_changes_only(spark, monkeypatch):
    """However many changes an offer has; files of the stream hold few rows each."""
    seen, keys = [], entities.with_identity

    def counted(rows):
        seen.append(rows.count())
        return keys(rows)

    monkeypatch.setattr(entities, "with_identity", counted)
    monkeypatch.setattr(plans, "FILE_ROWS", 100)
    same(spark, plans.retracted_entities, plans.SQL["retracted_entities"])
    offers = plans.offer_changes(spark, DATA).select("source_id", "id").distinct().count()
    assert len(seen) == 2 and offers <= sum(seen) < 1000
