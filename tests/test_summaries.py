"""Summary tables against hand-computed values."""

import datetime as dt

import pytest

from townhall_spark.operators import summaries

MEETINGS = ("canonical_id string, jurisdiction_fips string, jurisdiction_name string,"
            "state string, meeting_date date, source string, has_transcript boolean")
ACTIONS = ("canonical_id string, action_text string, action_category string,"
           "hazard_type string, confidence double")


@pytest.fixture(scope="module")
def tables(spark):
    day = dt.date
    meetings = spark.createDataFrame([
        ("a", "1", "A", "WA", day(2014, 1, 1), "s1", True),
        ("b", "1", "A", "WA", day(2015, 1, 1), "s1", False),
        ("c", "2", "C", "CA", day(2014, 1, 1), "s2", True),
        ("d", "3", "D", "", None, "s2", True),
    ], MEETINGS)
    actions = spark.createDataFrame([
        ("a", "t1", "adaptation", "flood", 0.9), ("a", "t2", "both", "heat", 0.9),
        ("a", "t3", "mitigation", "none", 0.9), ("a", "t4", "unrelated", "none", 0.5),
        ("c", "t5", "adaptation", "flood", 0.9), ("c", "t6", "adaptation", None, 0.9),
        ("d", "t7", "mitigation", "none", 0.9), ("orphan", "t8", "adaptation", "heat", 0.9),
    ], ACTIONS)
    return meetings, actions


def rows(df, *keys):
    return {tuple(r[k] for k in keys): tuple(v for c, v in r.asDict().items() if c not in keys)
            for r in df.collect()}


def test_by_region(tables):
    out = summaries.by_region(summaries.meeting_counts(*tables))
    assert out.columns == ["region", "meetings", "jurisdictions", "adaptation", "mitigation",
                           "both", "climate_actions", "actions_per_meeting"]
    assert rows(out, "region") == {("West",): (3, 2, 3, 1, 1, 5, 1.667),
                                   ("Unknown",): (1, 1, 0, 1, 0, 1, 1.0)}


def test_by_state_and_time(tables):
    assert rows(summaries.by_state(summaries.meeting_counts(*tables)), "state") == {
        ("WA",): ("West", 2, 1, 1, 1, 3, 1.5), ("CA",): ("West", 1, 2, 0, 0, 2, 2.0),
        ("",): ("Unknown", 1, 0, 1, 0, 1, 1.0)}
    assert rows(summaries.by_time(summaries.meeting_counts(*tables)), "year") == {
        (2014,): (2, 3, 1, 1, 5, 2.5), (2015,): (1, 0, 0, 0, 0, 0.0)}


def test_hazards(tables):
    meetings, actions = tables
    assert [tuple(r) for r in summaries.by_hazard(actions).collect()] == [
        ("flood", 2), ("heat", 2)]
    assert [tuple(r) for r in summaries.hazard_by_region(meetings, actions).collect()] == [
        ("Unknown", "heat", 1), ("West", "flood", 2), ("West", "heat", 1)]


def test_coverage_and_pivot(tables):
    cov = summaries.coverage(tables[0])
    assert rows(cov, "region", "source") == {("West", "s1"): (2, 1, 50.0),
                                             ("West", "s2"): (1, 1, 100.0),
                                             ("Unknown", "s2"): (1, 1, 100.0)}
    occurring = summaries.coverage_pivot(cov)
    assert occurring.columns == ["region", "s1", "s2"]
    assert rows(summaries.coverage_pivot(cov, ["s1", "s2", "s3"]), "region") == {
        ("West",): (2, 1, 0), ("Unknown",): (0, 1, 0)}


def test_enriched_keeps_orphans(tables):
    out = {r.action_text: r for r in summaries.actions_enriched(*tables).collect()}
    assert len(out) == 8
    assert (out["t8"].region, out["t8"].state, out["t8"].year) == ("Unknown", None, None)
    assert (out["t1"].region, out["t1"].year) == ("West", 2014)


def test_counts(tables):
    meetings, actions = tables
    assert rows(summaries.category_counts(actions), "action_category") == {
        ("adaptation",): (4,), ("both",): (1,), ("mitigation",): (2,), ("unrelated",): (1,)}
    assert rows(summaries.category_pivot(actions, "canonical_id",
                                         ("adaptation", "unrelated")), "canonical_id") == {
        ("a",): (1, 1), ("c",): (2, 0), ("d",): (0, 0), ("orphan",): (1, 0)}
    assert tuple(summaries.overview(meetings).first()) == (4, 3, 3, 2)
    assert rows(summaries.region_rollup(meetings), "region") == {("West",): (3,),
                                                                 ("Unknown",): (1,)}
    assert rows(summaries.source_jurisdiction_counts(meetings), "source",
                "jurisdiction_name")[("s1", "A")] == (2,)


EXPOSURE = ("canonical_id string, county_fips string, county_name string, risk_flood double,"
            "risk_heat double, risk_wildfire double, risk_drought double")


def test_exposure(spark):
    day = dt.date(2014, 1, 1)
    meetings = spark.createDataFrame(
        [(f"m{i}", str(i), "n", "WA", day, "s", True) for i in range(7)], MEETINGS)
    exposure = spark.createDataFrame(
        [(f"m{i}", f"c{i % 6}" if i != 6 else None, f"County {i}", float(i),
          None if i > 3 else float(i), 5.0, float(10 - i)) for i in range(7)], EXPOSURE)
    acts = [("m0", "x", "adaptation", "heat", 1.0)]
    for i in range(6):
        acts += [(f"m{i}", "x", "both", "flood", 1.0)] * (2 * i)
        acts += [(f"m{i}", "x", "mitigation", "flood", 1.0)]
        acts += [(f"m{i}", "x", "adaptation", "wildfire", 1.0)] * i
    acts += [("m6", "x", "adaptation", "flood", 1.0)]
    actions = spark.createDataFrame(acts, ACTIONS)
    counties = summaries.exposure_jurisdictions(actions, exposure)
    out = {r.county_fips: r for r in counties.collect()}
    assert len(out) == 6
    assert (out["c3"].meetings, out["c3"].act_flood, out["c3"].act_wildfire, out["c3"].act_heat,
            out["c3"].act_drought, out["c3"].risk_flood) == (1, 6, 3, 0, 0, 3.0)
    align = summaries.exposure_alignment(counties)
    assert rows(align, "hazard") == {
        ("flood",): (6, 30, 1.0),        # actions rise with risk
        ("heat",): (4, 1, None),         # fewer than five pairs
        ("wildfire",): (6, 15, None),    # risk is constant
        ("drought",): (6, 0, None)}      # actions are constant
    assert [r.hazard for r in summaries.alignment_display(align).collect()] == ["flood"]
    built = summaries.build_all(meetings, actions, exposure)
    assert list(built) == ["by_region", "by_state", "by_time", "by_hazard", "hazard_by_region",
                           "coverage", "exposure_jurisdictions", "exposure_alignment"]
    assert list(summaries.build_all(meetings, actions)) == list(built)[:6]


def test_rounding_is_half_even(spark):
    meetings = spark.createDataFrame(
        [(f"m{i}", "1", "A", "WA", dt.date(2014, 1, 1), "s", True) for i in range(16)], MEETINGS)
    actions = spark.createDataFrame([("m0", "t", "both", "heat", 1.0)], ACTIONS)
    counts = summaries.meeting_counts(meetings, actions)
    assert summaries.by_region(counts).first().actions_per_meeting == 0.062
