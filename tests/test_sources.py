"""What the projections of the driver's tables keep."""

from touchline.sources import tracking

SF = "/root/testdata/sf0.001"


def test_every_event_is_a_labelled_action_and_all_but_a_fifth_are_spotted(spark):
    events = {r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()}
    labelled = [r.event_id for r in tracking.labelled_actions(spark, SF).collect()]
    assert sorted(labelled) == sorted(events)
    for model in (0, 2):
        assert {r.event_id for r in tracking.spotted_actions(spark, SF, model).collect()} == {e for e in events if (e + model) % 5}
