"""Measurements in text: numbers with a unit, their comparator and bounds, and what they are a measure of.

Each extractor is one set of patterns that Spark's and other regular-expression engines read alike; nothing looks around a
match. A match may begin with the word of a reference (a paragraph, a figure) or end in a letter beyond the unit: it is
then dropped, which is how both guards work without context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import sentences

# Spellings of units and the unit each stands for.
UNITS = {
    "km/h": "kmph", "kmph": "kmph", "kmh": "kmph", "kg/m": "kg/m", "mm": "mm", "cm": "cm", "km": "km", "kn": "kn", "mpa": "mpa",
    "khz": "khz", "mhz": "mhz", "hz": "hz", "db": "db", "kg": "kg", "gmt": "gmt", "metres": "m", "metre": "m", "meters": "m",
    "meter": "m", "tonnes": "t", "tonne": "t", "litres": "litre", "litre": "litre", "liters": "litre", "liter": "litre",
    "degrees": "deg", "degree": "deg", "° c": "degC", "°c": "degC", "deg c": "degC", "deg": "deg", "days": "day", "day": "day",
    "months": "month", "month": "month", "years": "year", "year": "year", "hours": "hour", "hour": "hour", "hrs": "hour",
    "hr": "hour", "minutes": "minute", "minute": "minute", "mins": "minute", "min": "minute", "seconds": "second",
    "second": "second", "secs": "second", "sec": "second", "%": "%", "m": "m", "t": "t",
}
# The largest number that is plausible in a unit.
LARGEST = {"kmph": 400, "%": 100, "deg": 360, "degC": 100}
# Words of comparators, and of references whose number is no measurement.
AT_MOST = r"not\s+(?:more|greater)\s+than|not\s+exceed(?:ing)?|maximum(?:\s+(?:of|is|shall\s+be))?|max\.?|up\s?to|less\s+than|below|within|upper\s+limit"
AT_LEAST = r"not\s+less\s+than|at\s+least|minimum(?:\s+(?:of|is|shall\s+be))?|min\.?|more\s+than|greater\s+than|above|exceed(?:ing|s)?|lower\s+limit"
REFERENCE = r"(?:para(?:graph)?s?|annexure|appendix|fig(?:ure)?s?|table|clause|chapter|irs|rt|no|sl|sr|item|drg|drawing|acs|note|section|rule)\W{0,4}"
_LENGTH, _TIME = ("mm", "cm", "m", "km"), ("day", "month", "year", "hour", "minute", "second", "gmt")
# What can be measured, the words that name it, and the units that can measure it (the last named wins).
QUANTITIES = {
    "wear": (r"\bwear\b|\bworn\b", _LENGTH),
    "gap": (r"\bgap\b|\bopening\b", _LENGTH),
    "clearance": (r"clearance|flangeway", _LENGTH),
    "speed": (r"\bspeed\b|\bkmph\b|km/h", ("kmph",)),
    "temperature": (r"temperature|\btd\b|\bt_d\b", ("degC",)),
    "gauge": (r"\bgauge\b", _LENGTH),
    "cant": (r"\bcant\b|super-?elevation", ("mm",)),
    "height": (r"\bheight\b|\bdepth\b|cushion", _LENGTH),
    "width": (r"\bwidth\b", _LENGTH),
    "length": (r"\blength\b", _LENGTH),
    "distance": (r"\bdistance\b|\bspacing\b|\bapart\b", _LENGTH),
    "thickness": (r"thickness", _LENGTH),
    "diameter": (r"diameter|\bdia\b", _LENGTH),
    "radius": (r"radius|\bcurve of\b", _LENGTH),
    "load": (r"\bload\b|\bforce\b|\bpressure\b|\bweight\b", ("kg", "t", "kn", "mpa")),
    "frequency": (r"frequency|interval|periodicity|\bonce\b|\bevery\b|\bper\b", (*_TIME, "km", "m")),
    "time": (r"\bduration\b|\btime\b|\bperiod\b|\bwithin\b", _TIME),
    "gradient": (r"gradient|slope", ("%", "deg")),
}
# What a sentence may say that a value applies to.
CONDITIONS = {
    "rail_section": r"\b(?:52|60|90)\s?kg\b|\b60\s?E1\b|\bUIC\s?60\b|\b(?:90|110)\s?UTS\b",
    "sleeper": r"\b(?:PSC|wooden|steel\s+trough|concrete|CST-?9|ST)\s+sleepers?\b",
    "geometry": r"\b(?:straight\s+track|straight|curves?|curved|turnouts?|points\s+and\s+crossings?|crossings?|switch(?:es)?|SEJ|bridges?|tunnels?|level\s+crossings?|station\s+yards?|running\s+lines?|loop\s+lines?|main\s+lines?|transition|approach(?:es)?)\b",
    "gauge": r"\b(?-i:BG|MG|NG|broad\s+gauge|metre\s+gauge|narrow\s+gauge)\b",
    "route_class": r"\bGroup\s+[A-E]\b|\bZone[\s-]*(?:I{1,3}|IV|V)\b|\b[A-E]\s+class\s+routes?\b|\bQ\s+routes?\b|\brunning\s+track\b",
    "traffic": r"\b(?:passenger|goods|freight|mixed)\s+(?:traffic|trains?|lines?)\b",
}
#: Characters before and after a value in which its conditions are looked for.
BEFORE, AFTER = 100, 60
NUMBER = r"(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)"
UNIT = "(" + "|".join(u.replace(" ", r"\s") for u in UNITS) + r")([A-Za-z/²]?)"
WHOLE = rf"(?i)(?:\b{REFERENCE})?(?:\b(?:{AT_MOST}|{AT_LEAST})\s*)?(?:(?:±|\+/-)\s*)?{NUMBER}(?:\s*(?:to|and|-|–)\s*{NUMBER})?\s*{UNIT}"


def _first(pattern: str) -> str:
    return rf"(?i)^(?:{pattern})"


def measurements(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentence, raw, comparator, lo, hi, unit, quantity) of every measurement, by sentence (numbered from 0).

    comparator: max, min, range, tolerance or value; lo and hi: its bounds in the unit, null where there is none; quantity: of
    the words that name one, the nearest before the number in the sentence, if the unit can measure it. Numbers of
    references, years without a decimal point, units with a letter after them and implausible values are none. A null or
    empty text has none; repeated rows give theirs again.
    """
    return _found(df, key, text).select(key, "sentence", "raw", "comparator", "lo", "hi", "unit", _quantity().alias("quantity"))


def conditions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentence, raw, type, condition): what the sentence says, near a value and outside it, that the value applies to; each
    condition once for a value, whatever its spacing and plural. Handles texts as measurements does."""
    x = _found(df, key, text)
    place = F.instr("s", F.col("raw"))
    after = place + F.length("raw")
    near = F.concat(F.substring("s", F.greatest(place - BEFORE, F.lit(1)), F.least(place - 1, F.lit(BEFORE))), F.lit(" # "), F.substring("s", after, F.lit(AFTER)))
    x = x.withColumn("near", F.regexp_replace(near, r"(?i)kg\s*/\s*m", "kgpm"))

    def found(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("near", F.lit(f"(?i){pattern}"), F.lit(0)), lambda c: F.struct(F.lit(name).alias("type"), c.alias("c")))

    every = F.concat(*(found(*family) for family in CONDITIONS.items()))
    one = x.select(key, "sentence", "raw", F.inline(every))
    return one.select(key, "sentence", "raw", "type", F.regexp_replace(F.regexp_replace(F.lower("c"), r"\s+", ""), r"s?\W*$", "").alias("condition")).distinct()


def _found(df: DataFrame, key: str, text: str) -> DataFrame:
    """Measurements with their sentence s, without what they measure."""
    s = df.select(key, F.posexplode(sentences(F.col(text))).alias("sentence", "s"))
    x = s.select(key, "sentence", "s", F.explode(F.regexp_extract_all("s", F.lit(WHOLE), F.lit(0))).alias("raw"))
    raw = F.col("raw")
    numbers = F.transform(F.regexp_extract_all(raw, F.lit(NUMBER), F.lit(0)), lambda n: F.regexp_replace(n, ",", "").cast("double"))
    x = x.withColumns({"numbers": numbers, "spelling": F.lower(F.regexp_replace(F.regexp_extract(raw, rf"(?i){UNIT}$", 1), r"\s", " ")), "beyond": F.regexp_extract(raw, rf"(?i){UNIT}$", 2)})
    x = x.where((F.col("beyond") == "") & ~raw.rlike(_first(REFERENCE + "[0-9]")))
    x = x.withColumn("unit", F.create_map(*(F.lit(v) for pair in UNITS.items() for v in pair))[F.col("spelling")])
    one, two = F.col("numbers")[0], F.try_element_at("numbers", F.lit(2))
    comparator = F.when(two.isNotNull(), "range").when(raw.rlike(r"±|\+/-"), "tolerance").when(raw.rlike(_first(AT_MOST)), "max").when(raw.rlike(_first(AT_LEAST)), "min").otherwise("value")
    x = x.withColumn("comparator", comparator)
    is_ = F.col("comparator")
    x = x.withColumns(
        {
            "lo": F.when(is_ == "tolerance", -one).when(is_ != "max", one),
            "hi": F.when(is_ == "range", two).when(is_ != "min", one),
        }
    )
    year = (is_ != "range") & F.regexp_extract(raw, NUMBER, 0).rlike("^(19|20)[0-9][0-9]$")
    limit = F.create_map(*(F.lit(v) for pair in LARGEST.items() for v in pair))[F.col("unit")]
    return x.where(~year & (limit.isNull() | (F.greatest(F.abs("lo"), F.abs("hi")) <= limit)))


def _quantity() -> Column:
    """Of the words before the number the last that names a quantity; of several at one place the one listed last."""
    before = F.substring("s", F.lit(1), F.instr("s", F.col("raw")) - 1)

    def one(k: int, name: str, words: str, units: tuple[str, ...]) -> Column:
        at = F.when(before.rlike(f"(?i){words}"), F.length(F.regexp_extract(before, f"(?is)^(.*)(?:{words})", 1))).otherwise(-1)
        return F.struct(at.alias("at"), F.lit(k).alias("k"), F.when(F.col("unit").isin(*units), name).alias("name"))

    best = F.array_max(F.array(*(one(k, name, *v) for k, (name, v) in enumerate(QUANTITIES.items()))))
    return F.get(F.filter(F.array(best), lambda b: b["at"] >= 0), F.lit(0))["name"]


def conditions_sql(source: str, key: str, text: str) -> str:
    """The rows of conditions in SQL, from a table or subquery."""
    base = measurements_sql(source, key, text)
    base = base[: base.rindex("SELECT")]
    q = lambda p: "'" + p.replace("'", "''") + "'"
    every = " UNION ALL ".join(f"SELECT {key}, sentence, raw, '{name}' AS type, unnest(regexp_extract_all(near, {q('(?i)' + p)})) AS c FROM w" for name, p in CONDITIONS.items())
    return f"""{base.rstrip()}, w AS (SELECT *, regexp_replace(right(p, {BEFORE}) || ' # ' || substr(s, length(p) + length(raw) + 1, {AFTER}), '(?i)kg\\s*/\\s*m', 'kgpm', 'g') AS near FROM c), f AS ({every})
SELECT DISTINCT {key}, sentence, raw, type, regexp_replace(regexp_replace(lower(c), '\\s+', '', 'g'), 's?\\W*$', '') AS condition FROM f"""


def measurements_sql(source: str, key: str, text: str) -> str:
    """The same rows in SQL, from a table or subquery."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    pick = lambda d, c: f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in d.items()) + " END"
    places = ", ".join(f"CASE WHEN regexp_matches(p, {q('(?i)' + w)}) THEN length(regexp_extract(p, {q(f'(?is)^(.*)(?:{w})')}, 1)) ELSE -1 END AS q{k}" for k, (w, _) in enumerate(QUANTITIES.values()))
    every = ", ".join(f"q{k}" for k in range(len(QUANTITIES)))
    named = " ".join(f"WHEN q{k} = best THEN CASE WHEN unit IN ({', '.join(map(q, QUANTITIES[name][1]))}) THEN {q(name)} END" for k, name in reversed(list(enumerate(QUANTITIES))))
    return f"""WITH t AS (SELECT {key}, list_filter(list_transform(regexp_split_to_array(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|' || chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ss FROM {source}),
s AS (SELECT {key}, unnest(ss) AS s, unnest(range(len(ss)))::INTEGER AS sentence FROM t), x AS (SELECT *, unnest(regexp_extract_all(s, {q(WHOLE)})) AS raw FROM s),
y AS (SELECT *, list_transform(regexp_extract_all(raw, {q(NUMBER)}), lambda n: replace(n, ',', '')::DOUBLE) AS n, lower(regexp_replace(regexp_extract(raw, {q(f'(?i){UNIT}$')}, 1), '\\s', ' ', 'g')) AS spelling, left(s, strpos(s, raw) - 1) AS p FROM x
  WHERE regexp_extract(raw, {q(f'(?i){UNIT}$')}, 2) = '' AND NOT regexp_matches(raw, {q(_first(REFERENCE + "[0-9]"))})),
z AS (SELECT *, {pick(UNITS, 'spelling')} AS unit, CASE WHEN len(n) > 1 THEN 'range' WHEN regexp_matches(raw, '±|\\+/-') THEN 'tolerance' WHEN regexp_matches(raw, {q(_first(AT_MOST))}) THEN 'max' WHEN regexp_matches(raw, {q(_first(AT_LEAST))}) THEN 'min' ELSE 'value' END AS comparator FROM y),
b AS (SELECT *, CASE comparator WHEN 'tolerance' THEN -n[1] WHEN 'max' THEN NULL ELSE n[1] END AS lo, CASE comparator WHEN 'range' THEN n[2] WHEN 'min' THEN NULL ELSE n[1] END AS hi, {places} FROM z),
c AS (SELECT *, greatest({every}) AS best FROM b WHERE (comparator = 'range' OR NOT regexp_matches(regexp_extract(raw, {q(NUMBER)}), '^(19|20)[0-9][0-9]$')) AND coalesce(greatest(abs(lo), abs(hi)) <= {pick(LARGEST, 'unit')}, TRUE))
SELECT {key}, sentence, raw, comparator, lo, hi, unit, CASE WHEN best >= 0 THEN CASE {named} END END AS quantity FROM c"""
