"""Queries that recode survey answers, and their SQL. The answers are made from customers' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import recodes as C
from gridloom.plans.registry import Registry, rounded
from gridloom.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

BANDS = {"household_size": [(1, 1, "1"), (2, 2, "2"), (3, 4, "3-4"), (5, 50, "5+")], "bedrooms": [(0, 2, "0-2"), (3, 3, "3"), (4, 100, "4+")]}
UNDER16 = ("0-4", "5-15")


def _pick(step: int, *answers: str) -> str:
    """SQL of an answer by key: one of a list."""
    return f"CASE c_custkey * {step} % 101 % {len(answers)} " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(answers)) + " END"


COUNT = ("0", "1", "2", "", " 1.0 ", "some", "-1")
YES_NO = ("Yes", "no", "Yes; all of it", "Don''t know", "", "perhaps", "NO ")
TEXT = {
    "size": _pick(3, "1", "2", "3", "4.0", "7", "", "60", "two"), **{f"age{i}": _pick(5 + i, "16-30", "0-4", "Don''t know", "31-60", "", "5-15", "61+") for i in range(3)},
    "house": _pick(17, "End terraced", "", "Semi-detached", "", "Detached bungalow", "", "Barn"), "flat": _pick(19, "", "", "", "First floor"), "mobile": _pick(23, "", "", "", "", "Caravan"),
    "rooms": _pick(29, "3", "5", "", "x", "101"), "bedrooms": _pick(31, "1", "2", "3", "4", "", "2.5"), "glazing": _pick(37, *YES_NO), "roof": _pick(41, *YES_NO), "wall": _pick(43, *YES_NO),
    "central": _pick(47, "Gas boiler", "Electric storage", "", "I don''t know"), "hot_water": _pick(53, "Electric immersion", "Gas", "", "Don''t know", "Electric, don''t know which"),
    **{k: _pick(59 + 2 * i, *COUNT) for i, k in enumerate(("washing", "washer_dryer", "dryer", "dishwasher", "hob", "oven", "shower", "heater"))},
}
TEXT_COLUMNS = {k: k for k in TEXT if not k.startswith("age")} | {"ages": [k for k in TEXT if k.startswith("age")]}


def _codes(*codes: str) -> tuple[str, ...]:
    return (*codes, "", "99")


CODED = {
    "composition": _pick(3, *_codes("1", "2", "3", "2", "3")), "adults": _pick(5, *_codes("1", "2", "3", "7")), "children": _pick(7, *_codes("1", "2", "7")), "adults_day": _pick(11, *_codes("8", "1", "2")), "children_day": _pick(13, *_codes("8", "1", "3")),
    "dwelling": _pick(17, *_codes("1", "2", "3", "4", "5", "6")), "bedrooms": _pick(19, *_codes("1", "2", "3", "4", "5", "6")), "area": _pick(23, "100", "1200.5", "999999999", "", "0", "big"), "area_unit": _pick(29, *_codes("1", "2", "2")),
    "rated": _pick(31, *_codes("1", "1", "2", "3")), "rating": _pick(37, *_codes("1", "2", "3", "4", "5", "6", "7")), "glazing": _pick(41, *_codes("1", "2", "3", "4", "5")), "attic": _pick(43, *_codes("1", "2", "3", "4")), "wall": _pick(47, *_codes("1", "2", "3")),
    **{k: _pick(53 + 2 * i, *_codes("0", "1", "0")) for i, k in enumerate(("space_central", "space_plug", "water_immersion", "water_instant", "cannot_afford"))},
    **{k: _pick(67 + 2 * i, *_codes("1", "2", "3", "4", "1")) for i, k in enumerate(("washing_machine", "tumble_dryer", "dishwasher", "electric_cooker", "portable_electric_heater", "shower_instant", "shower_pumped"))},
    "immersion_use": _pick(83, *_codes("1", "2")), "social": _pick(87, *_codes("1", "2", "3", "4", "5", "6")), "tenure": _pick(89, *_codes("1", "2", "3", "4", "5")), "warm": _pick(91, *_codes("1", "2")), "went_without": _pick(93, *_codes("1", "2")),
}


def _answers(spark, sf, answers: dict[str, str]):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), *(F.expr(v.replace("n''t", r"n\'t")).alias(k) for k, v in answers.items()))


def _plain(df):
    """Values as text, so that absent ones need no special number; areas stay numbers."""
    return rounded(df.select(*(F.col(c).cast("string").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes)))


def _clean(answers: dict[str, str]) -> str:
    cells = ", ".join(f"CASE WHEN trim({v}) <> '' AND lower(trim({v})) <> 'nan' THEN trim({v}) END AS {k}" for k, v in answers.items())
    return f"WITH a AS (SELECT c_custkey AS entity, {cells} FROM customer)"


def _absent(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'source_blank' ELSE 'invalid_source_value' END"


def _case(x: str, codes: dict, other: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in codes.items()) + f" ELSE {other} END"


def _bands(x: str, name: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} BETWEEN {a} AND {b} THEN '{t}'" for a, b, t in BANDS[name]) + " END"


def _or(*parts: str) -> str:
    return "CASE WHEN " + " OR ".join(f"coalesce({p} = 1, false)" for p in parts) + " THEN 1 WHEN " + " AND ".join(f"coalesce({p} = 0, false)" for p in parts) + " THEN 0 END"


def _select(variables: dict[str, tuple[str, ...]]) -> str:
    """Each variable's value, why it is missing, and how it came about."""
    out = []
    for name, (value, missing, *how) in variables.items():
        shown = f"round({value}, 6)" if name == "floor_area_m2" else f"CAST({value} AS VARCHAR)"
        out.append(f"{shown} AS {name}, CASE WHEN ({value}) IS NULL THEN {missing} ELSE {how[0] if how else chr(39) + 'available' + chr(39)} END AS {name}__reason")
    return ", ".join(out)


PARTS = "'incomplete_component_coverage'"


def _whole(x: str, low: int, high: int) -> str:
    return f"CASE WHEN TRY_CAST({x} AS DOUBLE) = floor(TRY_CAST({x} AS DOUBLE)) AND TRY_CAST({x} AS DOUBLE) BETWEEN {low} AND {high} THEN CAST(TRY_CAST({x} AS DOUBLE) AS INT) END"


def _yes(x: str) -> str:
    return f"CASE WHEN lower({x}) = 'yes' OR lower({x}) LIKE 'yes;%' THEN 1 WHEN lower({x}) = 'no' THEN 0 END"


def _has(x: str) -> str:
    return f"CASE WHEN TRY_CAST({x} AS DOUBLE) >= 0 AND TRY_CAST({x} AS DOUBLE) = floor(TRY_CAST({x} AS DOUBLE)) THEN CAST(TRY_CAST({x} AS DOUBLE) > 0 AS INT) END"


NAMED = {"house": "CASE WHEN lower(house) LIKE '%terraced%' THEN 'terraced' WHEN lower(house) LIKE '%semi-detached%' THEN 'semi_detached' WHEN lower(house) LIKE '%detached%' THEN 'detached_or_bungalow' WHEN house IS NOT NULL THEN 'other_or_mobile' WHEN flat IS NOT NULL THEN 'flat_or_apartment' WHEN mobile IS NOT NULL THEN 'other_or_mobile' END"}
KINDS = "((house IS NOT NULL)::INT + (flat IS NOT NULL)::INT + (mobile IS NOT NULL)::INT)"
KNOWN = "list_filter([age0, age1, age2], lambda x: x IS NOT NULL AND lower(x) <> 'don''t know')"
CHILD = "len(list_intersect([age0, age1, age2], ['0-4', '5-15'])) > 0"
ELECTRIC = {"central": "CASE WHEN central NOT ILIKE '%don''t know%' THEN CAST(central ILIKE '%electric%' AS INT) END", "hot_water": "CASE WHEN NOT (hot_water ILIKE '%don''t know%' AND hot_water NOT ILIKE '%electric%') THEN CAST(hot_water ILIKE '%electric%' AS INT) END"}
NUMBERS = f"b AS (SELECT *, {_whole('size', 1, 50)} AS n, {_whole('bedrooms', 0, 100)} AS bed, {_yes('glazing')} AS g1, {_yes('roof')} AS g2, {_yes('wall')} AS g3, {ELECTRIC['central']} AS e1, {ELECTRIC['hot_water']} AS e2, " + ", ".join(f"{_has(k)} AS h_{k}" for k in ("washing", "washer_dryer", "dryer", "dishwasher", "hob", "oven", "shower", "heater")) + f", {CHILD} AS child, len({KNOWN}) AS ages FROM a)"
UNKNOWN = "CASE WHEN lower({0}) IN ('don''t know', 'dont know', 'do not know') THEN 'dont_know' ELSE " + _absent("{0}") + " END"
TEXT_SQL = _clean(TEXT) + ", " + NUMBERS + " SELECT entity, " + _select({
    "household_size": ("n", _absent("size")), "household_size_band_common": (_bands("n", "household_size"), f"CASE WHEN n IS NULL THEN {_absent('size')} ELSE 'available' END"),
    "household_composition_common": ("CASE WHEN n IS NULL THEN NULL WHEN n = 1 THEN 'live_alone' WHEN child THEN 'adults_with_children_under16' WHEN n <= 3 AND ages >= n THEN 'adults_only_or_no_under16' END", f"CASE WHEN n IS NULL THEN {_absent('size')} ELSE 'insufficient_age_coverage' END"),
    "dwelling_type_common": (f"CASE WHEN {KINDS} <= 1 THEN {NAMED['house']} END", f"CASE WHEN {KINDS} > 1 THEN 'conflicting_source_fields' ELSE 'source_blank' END"),
    "rooms_count": (_whole("rooms", 0, 100), _absent("rooms")), "bedroom_count_min": ("bed", _absent("bedrooms")), "bedroom_band_common": (_bands("bed", "bedrooms"), f"CASE WHEN bed IS NULL THEN {_absent('bedrooms')} ELSE 'available' END"),
    "double_glazing_any": ("g1", UNKNOWN.format("glazing")), "attic_roof_insulation_any": ("g2", UNKNOWN.format("roof")), "wall_insulation_any": ("g3", UNKNOWN.format("wall")), "thermal_efficiency_proxy_count": ("g1 + g2 + g3", PARTS),
    "electric_space_heating_any": ("e1", "CASE WHEN central IS NULL THEN 'source_blank' ELSE 'dont_know' END"), "electric_water_heating_any": ("e2", "CASE WHEN hot_water IS NULL THEN 'source_blank' ELSE 'dont_know' END"), "electric_thermal_load": (_or("e1", "e2"), PARTS),
    "washing_machine_any": (_or("h_washing", "h_washer_dryer"), PARTS), "tumble_dryer_any": (_or("h_dryer", "h_washer_dryer"), PARTS), "dishwasher_any": ("h_dishwasher", _absent("dishwasher")), "electric_cooker_any": (_or("h_hob", "h_oven"), PARTS), "electric_shower_any": ("h_shower", _absent("shower")), "portable_electric_heater_any": ("h_heater", _absent("heater")),
}) + " FROM b"


@query("recode_text_survey", TEXT_SQL)
def recode_text_survey(spark, sf):
    return _plain(C.text_survey(_answers(spark, sf, TEXT), TEXT_COLUMNS, BANDS, UNDER16))


def _people(x: str, none: str = "") -> str:
    return f"CASE WHEN {x} IN ('1', '2', '3', '4', '5', '6', '7') THEN CAST({x} AS INT)" + (f" WHEN {x} = '{none}' THEN 0" if none else "") + " END"


def _refusable(x: str, code: str, why: str) -> str:
    return f"CASE WHEN {x} = '{code}' THEN '{why}' ELSE {_absent(x)} END"


TICK, ANY = {"0": 0, "1": 1}, {"1": 0, "2": 1, "3": 1, "4": 1}
OWNED = ("washing_machine", "tumble_dryer", "dishwasher", "electric_cooker", "portable_electric_heater", "shower_instant", "shower_pumped")
PARTS_SQL = "b AS (SELECT *, CASE composition WHEN '1' THEN 1 WHEN '2' THEN " + _people("adults") + " WHEN '3' THEN " + _people("adults") + " END + CASE composition WHEN '1' THEN 0 WHEN '2' THEN 0 WHEN '3' THEN " + _people("children") + " END AS n, " + _people("adults_day", "8") + " + CASE WHEN composition = '2' THEN 0 ELSE " + _people("children_day", "8") + " END AS day, CASE WHEN bedrooms IN ('1', '2', '3', '4', '5') THEN CAST(bedrooms AS INT) END AS bed, CASE WHEN TRY_CAST(area AS DOUBLE) > 0 THEN TRY_CAST(area AS DOUBLE) END AS m, " + ", ".join(f"{_case(k, TICK)} AS t_{k}" for k in ("space_central", "space_plug", "water_immersion", "water_instant", "cannot_afford")) + ", " + ", ".join(f"{_case(k, ANY)} AS o_{k}" for k in OWNED) + f", {_case('glazing', {'1': 0, '2': 1, '3': 1, '4': 1, '5': 1})} AS g1, {_case('attic', {'1': 1, '2': 1, '3': 0})} AS g2, {_case('wall', {'1': 1, '2': 0})} AS g3, {_case('immersion_use', {'1': 1, '2': 0})} AS im, {_case('went_without', {'1': 1, '2': 0})} AS ww FROM a), d AS (SELECT *, {_or('t_space_central', 't_space_plug')} AS e1, {_or('t_water_immersion', 't_water_instant')} AS e2, CASE warm WHEN '1' THEN 0 WHEN '2' THEN t_cannot_afford END AS poor FROM b)"
DAYTIME = "CASE WHEN composition IN ('2', '3') THEN CASE WHEN day = 0 THEN 'none' WHEN day = 1 THEN 'one' WHEN day > 1 THEN 'two_or_more' END END"
TOP = "CASE WHEN bedrooms = '5' THEN 'available_topcoded_5_plus' ELSE 'available' END"
CODED_SQL = _clean(CODED) + ", " + PARTS_SQL + " SELECT entity, " + _select({
    "household_composition_common": (_case("composition", {"1": "live_alone", "2": "adults_only", "3": "adults_with_children_under15"}), _absent("composition")), "household_size": ("n", PARTS), "household_size_band_common": (_bands("n", "household_size"), f"CASE WHEN n IS NULL THEN {PARTS} ELSE 'available' END"),
    "daytime_presence_category": (DAYTIME, f"CASE WHEN composition = '1' THEN 'structurally_not_asked_live_alone' WHEN composition IN ('2', '3') THEN {PARTS} ELSE 'invalid_parent_response' END"),
    "dwelling_type_common": (_case("dwelling", {"1": "flat_or_apartment", "2": "semi_detached", "3": "detached_or_bungalow", "4": "terraced", "5": "detached_or_bungalow"}), _refusable("dwelling", "6", "refused")),
    "bedroom_count_min": ("bed", _refusable("bedrooms", "6", "refused"), TOP), "bedroom_category": ("CASE WHEN bed = 5 THEN '5+' ELSE CAST(bed AS VARCHAR) END", _refusable("bedrooms", "6", "refused"), TOP), "bedroom_band_common": (_bands("bed", "bedrooms"), _refusable("bedrooms", "6", "refused")),
    "floor_area_m2": ("CASE WHEN area = '999999999' THEN NULL WHEN area_unit = '1' THEN m WHEN area_unit = '2' THEN m * 0.09290304::DOUBLE END", "CASE WHEN area = '999999999' THEN 'special_missing_not_provided' WHEN area IS NULL THEN 'source_blank' WHEN m IS NULL THEN 'invalid_source_value' ELSE 'missing_or_invalid_unit' END", "CASE WHEN area_unit = '2' THEN 'available_converted_from_sqft' ELSE 'available' END"),
    "ber_rating": ("CASE WHEN rated = '1' THEN " + _case("rating", dict(zip("1234567", "ABCDEFG"))) + " END", f"CASE WHEN rated IS NULL THEN 'source_blank' WHEN rated = '1' THEN {_absent('rating')} WHEN rated = '2' THEN 'not_applicable_no_ber' WHEN rated = '3' THEN 'dont_know' ELSE 'invalid_source_value' END"),
    "double_glazing_category": (_case("glazing", {"1": "none", "2": "about_quarter", "3": "about_half", "4": "about_three_quarters", "5": "all"}), _absent("glazing")), "attic_insulation_category": (_case("attic", {"1": "yes_within_5_years", "2": "yes_more_than_5_years_ago", "3": "no", "4": "dont_know"}), _absent("attic")), "wall_insulation_category": (_case("wall", {"1": "yes", "2": "no", "3": "dont_know"}), _absent("wall")),
    "double_glazing_any": ("g1", _absent("glazing")), "attic_roof_insulation_any": ("g2", _refusable("attic", "4", "dont_know")), "wall_insulation_any": ("g3", _refusable("wall", "3", "dont_know")), "reported_thermal_feature_count": ("g1 + g2 + g3", PARTS),
    "electric_space_heating_any": ("e1", PARTS), "electric_water_heating_any": ("e2", PARTS), "immersion_use_when_heating_off": ("CASE WHEN water_immersion = '1' THEN im END", f"CASE WHEN water_immersion = '0' THEN 'structurally_not_asked_no_immersion' WHEN water_immersion = '1' THEN {_absent('immersion_use')} ELSE 'invalid_parent_response' END"), "electric_thermal_load": (_or("e1", "e2"), PARTS),
    **{f"{k}_any": (f"o_{k}", _absent(k)) for k in OWNED[:5]}, "electric_shower_any": (_or("o_shower_instant", "o_shower_pumped"), PARTS),
    "social_class": (_case("social", {"1": "AB", "2": "C1", "3": "C2", "4": "DE", "5": "F_farmer"}), _refusable("social", "6", "refused")), "tenure": (_case("tenure", {"1": "private_rent", "2": "social_rent", "3": "own_outright", "4": "own_mortgage", "5": "other"}), _absent("tenure")), "energy_vulnerability": (_or("poor", "ww"), PARTS),
}) + " FROM d"


@query("recode_coded_survey", CODED_SQL)
def recode_coded_survey(spark, sf):
    return _plain(C.coded_survey(_answers(spark, sf, CODED), {k: k for k in CODED}, BANDS))
