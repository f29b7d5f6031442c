from millrace.operators.measures import UNITS, conditions, measurements

GOLDEN = {
    "The gap shall not exceed 6 mm.": [("max", None, 6.0, "mm", "gap")],
    "Clearance of not less than 1,200 mm": [("min", 1200.0, None, "mm", "clearance")],
    "between 44 and 48 mm": [("range", 44.0, 48.0, "mm", None)],
    "cant ± 5 mm": [("tolerance", -5.0, 5.0, "mm", "cant")],
    "Para 429 mm and Annexure 4 days": [],
    "in 1998 days": [],
    "in 1998.5 days": [("value", 1998.5, 1998.5, "day", None)],
    "speed 900 km/h": [],
    "5 m/s": [],
    "width of 30 kg": [("value", 30.0, 30.0, "kg", None)],
    "once in 6 months": [("value", 6.0, 6.0, "month", "frequency")],
    "wear 3 mm and height 7 cm": [("value", 3.0, 3.0, "mm", "wear"), ("value", 7.0, 7.0, "cm", "height")],
    "60 kg/m": [("value", 60.0, 60.0, "kg/m", None)],
    "": [],
}


def test_golden_texts(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(GOLDEN)] + [(99, None)], "k long, t string")
    got = {}
    for r in measurements(df, "k", "t").collect():
        got.setdefault(r.k, []).append((r.comparator, r.lo, r.hi, r.unit, r.quantity))
    assert {t: got.get(k, []) for k, t in enumerate(GOLDEN)} == GOLDEN and 99 not in got
    assert len(UNITS) >= 50


def test_conditions_near_a_value(spark):
    text = "On curves and curve of BG track with 52 kg rails the wear is 6 mm for goods  trains, and 60 kg/m is none."
    got = {}
    for r in conditions(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").collect():
        got.setdefault(r.raw, set()).add((r.type, r.condition))
    assert got["6 mm"] == {("geometry", "curve"), ("gauge", "bg"), ("rail_section", "52kg"), ("traffic", "goodstrain")}
    assert ("rail_section", "52kg") not in got["52 kg"]
