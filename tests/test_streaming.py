from flatwork.functions.calc import calculated_fields
from flatwork.operators.features import apply_rule
from flatwork.operators.filters import apply_filters


def test_row_wise_operators_on_a_stream(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))

    def steps(df):
        kept = apply_filters(df, [{"column": "value", "operator": ">", "value": 1}])
        made = calculated_fields(kept, [{"field_name": "twice", "expression": "value * 2"}])
        return apply_rule(made, "event_type", "head", {"operation": "extract_first_character"}).select("event_id", "twice", "head")

    stream = steps(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("rowwise").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("rowwise").collect()) == sorted(steps(batch).collect())
