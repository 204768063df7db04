"""County tiers and risk lookup."""

from townhall_spark.operators import exposure
from townhall_spark.schemas import COUNTY_RISK


def counties(spark):
    rows = [("53033", "WA", "King", 1, 50.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0),
            ("1001", "al", "Autauga ", 1, 10.0, 1.5, None, 3.5, 4.5, 5.5, None),
            ("99999", "AL", "AUTAUGA", 1, 99.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0),
            ("02020", "AK", "Anchorage", 1, 20.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)]
    return spark.createDataFrame(rows, COUNTY_RISK).coalesce(1)


def test_tiers(spark):
    places = spark.createDataFrame([(" 7 ", "111"), ("7", "222"), ("5363000", "1")],
                                   "place_fips string, county_fips string").coalesce(1)
    meetings = spark.createDataFrame([
        ("fixed", "5363000", "Seattle", "WA"), ("place", "7 ", "Town", "WA"),
        ("name", "01001", "Autauga County", "AL"), ("parish", "x", "Anchorage  BOROUGH", "ak"),
        ("wrong_state", "x", "King County", "OR"), ("no_suffix", "x", "King", "WA"),
        ("inside", "x", "King County Council", "WA"), ("noname", "x", None, "WA"),
        ("unlisted", "0820000", "Denver", "CO"),
    ], "canonical_id string, jurisdiction_fips string, jurisdiction_name string, state string")
    out = {r.canonical_id: r for r in
           exposure.enrich(meetings, counties(spark), places).collect()}
    assert {k: r.county_fips for k, r in out.items()} == {
        "fixed": "53033", "place": "00222", "name": "01001", "parish": "02020",
        "wrong_state": None, "no_suffix": None, "inside": None, "noname": None,
        "unlisted": "08031"}
    fixed = out["fixed"]
    assert (fixed.county_name, fixed.overall_risk, fixed.risk_flood, fixed.risk_sea_level_rise,
            fixed.risk_wildfire, fixed.risk_heat, fixed.risk_drought, fixed.risk_storm) == (
        "King", 50.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
    assert out["place"].county_name is None and out["place"].risk_flood is None
    assert out["name"].overall_risk == 10.0
    assert tuple(exposure.exposure_coverage(
        exposure.enrich(meetings, counties(spark), places)).first()) == (5, 9)


def test_slim(spark):
    wide = spark.createDataFrame([(1001, "AL", "Autauga", 5, *[0.5] * 7, "junk")],
                                 "STCOFIPS int, STATEABBRV string, COUNTY string,"
                                 "POPULATION long, RISK_SCORE double, IFLD_RISKS double,"
                                 "CFLD_RISKS double, WFIR_RISKS double, HWAV_RISKS double,"
                                 "DRGT_RISKS double, HRCN_RISKS double, EXTRA string")
    slim = exposure.slim_counties(wide)
    assert slim.columns == COUNTY_RISK.names
    assert slim.first().STCOFIPS == "01001"
