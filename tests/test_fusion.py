"""Recorded values of one published case: what goes into the fusion and what comes out."""

import pytest

from slickwake.operators import fusion

# fixed values: mmsi, attribution, anomaly, gap, twin (None: not simulated), confidence, flags
GOLDEN = [
    (999000001, 0.9710154014026141, 0.10491125892388672, 6.0, 0.6812026881208083, 0.6963601232582366, "PHYSICS_TWIN_MATCH"),
    (999000004, 0.9910671594398678, 0.11301468958616158, 180.0, 0.641406934827403, 0.6930755868547639, "AIS_GAP_180min_NEAR_RELEASE;PHYSICS_TWIN_MATCH"),
    (999000002, 0.9402107595855317, 0.1248072436985405, 6.0, 0.6311078069911856, 0.6689440230001124, "PHYSICS_TWIN_MATCH"),
    (313535482, 0.8291333513007789, 0.10894461769914024, 6.0, 0.5298639409331067, 0.5803513109517658, "PHYSICS_TWIN_MATCH"),
    (381297666, 0.571597636884289, 0.07085487978702969, 6.0, 0.30094509262042407, 0.37672069497248445, ""),
    (434146145, 0.11291212734466521, 0.07132477364399434, 6.0, None, 0.06507541203389822, ""),
]


def run(spark, rows):
    f = spark.createDataFrame([(m, str(m), True, a, n, g, g >= 60) for m, a, n, g, *_ in rows], "mmsi long, vessel_name string, passes_all boolean, attribution_score double, anomaly_confidence double, max_ais_gap_min_near_release double, dark_gap_flag boolean")
    t = spark.createDataFrame([(r[0], r[4]) for r in rows if r[4] is not None] or [], "mmsi long, digital_twin_score double")
    return fusion.fuse(f, t)


def test_recorded_case(spark):
    fused = run(spark, GOLDEN)
    for rank, (want, got) in enumerate(zip(GOLDEN, fused.orderBy("rank").collect(), strict=True), 1):
        assert got["rank"] == rank and got["mmsi"] == want[0] and got["evidence_flags"] == want[6] and got["confidence"] == pytest.approx(want[5], abs=1e-15)
    c = fusion.conclude(fused).first()
    assert (c["level"], c["top_mmsi"], c["top_confidence"], c["margin_to_second"], c["n_within_ambiguity_margin"], c["shortlist"]) == ("AMBIGUOUS_SHORTLIST", 999000001, 0.696, 0.003, 3, [999000001, 999000004, 999000002])
    assert "not a probability of guilt" in c["text"]


@pytest.mark.parametrize(("scores", "level"), [([(1, 1.0, 1.0), (2, 0.2, 0.1)], "STRONG_LEAD"), ([(1, 0.9, 0.5), (2, 0.1, 0.1)], "MODERATE_LEAD"), ([(1, 0.3, 0.1)], "WEAK_INCONCLUSIVE"), ([], "NO_CANDIDATE"), ([(2, 0.9, 0.9), (1, 0.9, 0.9)], "AMBIGUOUS_SHORTLIST")])
def test_levels(spark, scores, level):
    fused = run(spark, [(m, a, 0.5, 6.0, t) for m, a, t in scores])
    c = fusion.conclude(fused).first()
    assert c["level"] == level
    if scores and scores[0][0] == 2:
        assert c["top_mmsi"] == 1  # a tie goes to the smaller number
