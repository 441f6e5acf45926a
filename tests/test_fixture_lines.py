"""What the fixture's shared tables shuffle: lines, not the texts derived from them."""

from latewise.operators import reports as RP
from latewise.sources.fixture import Fixture

SF = "/root/testdata/sf0.001"


def _exchanged(node):
    """Column names of every shuffle in a physical plan."""
    node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
    names = []
    if node.nodeName().startswith("Exchange"):
        out = node.output()
        names.append({out.apply(i).name() for i in range(out.size())})
    kids = node.children()
    return names + [n for i in range(kids.size()) for n in _exchanged(kids.apply(i))]


def test_shared_tables_shuffle_lines(spark):
    fx = Fixture(spark, SF, materialize=False)
    for df in (fx.latest, fx.keyed, fx.jlegs):
        moved = _exchanged(df._jdf.queryExecution().executedPlan())
        assert moved and not set().union(*moved) & {"station_name", "id", "dest_name", "final_destination_station", "xml_station_name", "operator", "line_name"}


def test_stations_meet_counts_not_events(spark):
    fx = Fixture(spark, SF, materialize=False)
    df = RP.trains_by_station_hour(fx.stop_events, fx.stop_events.select("eva"))
    moved = _exchanged(df._jdf.queryExecution().executedPlan())
    # events reach no shuffle by station with their times (the line table's own shuffles have no eva)
    assert not [m for m in moved if "eva" in m and "arrival_planned_time" in m]
