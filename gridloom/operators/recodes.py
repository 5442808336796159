"""Recodes of two household surveys onto common variables.

Every variable is (value, reason): the reason is 'available', how the value came about, or why there
is none. Rules are expressions over one row. Which column answers which question, and the edges of
bands, are parameters; what codes mean is stated as maps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import any_of, band, clean_text

OK, BLANK, INVALID, DONT_KNOW, REFUSED, PARTS = "available", "source_blank", "invalid_source_value", "dont_know", "refused", "incomplete_component_coverage"

# Meanings of codes.
COMPOSITION = {"1": "live_alone", "2": "adults_only", "3": "adults_with_children_under15"}
DWELLING = {"1": "flat_or_apartment", "2": "semi_detached", "3": "detached_or_bungalow", "4": "terraced", "5": "detached_or_bungalow"}
BEDROOMS = {"1": "1", "2": "2", "3": "3", "4": "4", "5": "5+"}
RATING = {"1": "A", "2": "B", "3": "C", "4": "D", "5": "E", "6": "F", "7": "G"}
GLAZING = {"1": "none", "2": "about_quarter", "3": "about_half", "4": "about_three_quarters", "5": "all"}
ATTIC = {"1": "yes_within_5_years", "2": "yes_more_than_5_years_ago", "3": "no", "4": "dont_know"}
WALL = {"1": "yes", "2": "no", "3": "dont_know"}
SOCIAL = {"1": "AB", "2": "C1", "3": "C2", "4": "DE", "5": "F_farmer"}
TENURE = {"1": "private_rent", "2": "social_rent", "3": "own_outright", "4": "own_mortgage", "5": "other"}
#: Square metres of a square foot, and the code that stands for no area given.
SQUARE_FOOT, NO_AREA = 0.09290304, "999999999"


class Answer:
    """A value and its reason; the reason given applies where there is no value, `how` where there is one."""

    def __init__(self, value: Column, missing: Column | str, how: Column | str = OK):
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        self.value, self.reason = value, F.when(value.isNull(), text(missing)).otherwise(text(how))

    def named(self, name: str) -> list[Column]:
        return [self.value.alias(name), self.reason.alias(f"{name}__reason")]


def _absent(x: Column) -> Column:
    """Why a text that has no meaning has none."""
    return F.when(clean_text(x).isNull(), BLANK).otherwise(INVALID)


def _among(x: Column, codes: Mapping) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for pair in codes.items() for v in pair)), F.coalesce(clean_text(x), F.lit("")))


def coded(x: Column, codes: Mapping, reasons: Mapping[str, str] | None = None) -> Answer:
    """A code's meaning; some codes without one have reasons of their own."""
    missing = _absent(x)
    for code, why in (reasons or {}).items():
        missing = F.when(clean_text(x) == code, why).otherwise(missing)
    return Answer(_among(x, codes), missing)


def whole(x: Column, low: int, high: int) -> Answer:
    n = clean_text(x).try_cast("double")
    return Answer(F.when((n == F.floor(n)) & n.between(low, high), n.cast("int")), _absent(x))


def yes_no_text(x: Column) -> Answer:
    """'Yes' (also with an explanation after a semicolon), 'No', or not known."""
    key = F.replace(F.lower(clean_text(x)), F.lit("’"), F.lit("'"))
    value = F.when((key == "yes") | key.startswith("yes;"), 1).when(key == "no", 0)
    return Answer(value, F.when(key.isin("don't know", "dont know", "do not know"), DONT_KNOW).otherwise(_absent(x)))


def presence(x: Column) -> Answer:
    """Whether a count is above zero."""
    n = clean_text(x).try_cast("double")
    return Answer(F.when((n >= 0) & (n == F.floor(n)), (n > 0).cast("int")), _absent(x))


def ticked(x: Column) -> Answer:
    """A box of a multiple choice: 0 or 1."""
    return coded(x, {"0": 0, "1": 1})


def binary_code(x: Column, yes: str = "1", no: str = "2") -> Answer:
    return coded(x, {yes: 1, no: 0})


def either(*parts: Answer) -> Answer:
    """1 if any part is, 0 if all are, otherwise unknown for lack of parts."""
    return Answer(any_of(*(p.value for p in parts)), PARTS)


def count_of(*parts: Answer) -> Answer:
    """How many parts are 1, if all are known."""
    return Answer(reduce(lambda a, b: a + b, (p.value for p in parts)), PARTS)


def banded(of: Answer, bands: Sequence[tuple[float, float, str]]) -> Answer:
    return Answer(band(of.value, bands), of.reason)


def mentions(x: Column, word: str, unless_known: bool = False) -> Answer:
    """Whether a text names something; one that says it isn't known tells nothing, if not (unless_known) both are said."""
    text = F.lower(clean_text(x))
    unknown = text.contains("don't know") & (~text.contains(word) if unless_known else F.lit(True))
    return Answer(F.when(~unknown, text.contains(word).cast("int")), F.when(unknown, DONT_KNOW).otherwise(BLANK))


# ---- the text survey --------------------------------------------------------------------------


def text_survey(rows: DataFrame, columns: Mapping, bands: Mapping, under16: Sequence[str]) -> DataFrame:
    """entity and 20 variables of a survey answered in words; columns names the source column of each question, a list of them for ages."""
    c = {k: F.col(v) for k, v in columns.items() if isinstance(v, str)}
    size = whole(c["size"], 1, 50)
    ages = F.filter(F.transform(F.array(*map(F.col, columns["ages"])), clean_text), lambda a: a.isNotNull() & (F.lower(a) != "don't know"))
    child = F.exists(ages, lambda a: a.isin(*under16))
    complete = (size.value <= len(columns["ages"])) & (F.size(ages) >= size.value)
    made_of = Answer(
        F.when(size.value.isNull(), None).when(size.value == 1, "live_alone").when(child, "adults_with_children_under16").when(complete, "adults_only_or_no_under16"),
        F.when(size.value.isNull(), size.reason).otherwise("insufficient_age_coverage"),
    )
    house, flat, mobile = (clean_text(c[k]) for k in ("house", "flat", "mobile"))
    kinds = sum((x.isNotNull().cast("int") for x in (house, flat, mobile)), F.lit(0))
    low = F.lower(house)
    dwelling = F.when(low.contains("terraced"), "terraced").when(low.contains("semi-detached"), "semi_detached").when(low.contains("detached"), "detached_or_bungalow").when(house.isNotNull(), "other_or_mobile").when(flat.isNotNull(), "flat_or_apartment").when(mobile.isNotNull(), "other_or_mobile")
    lives_in = Answer(F.when(kinds <= 1, dwelling), F.when(kinds > 1, "conflicting_source_fields").otherwise(BLANK))
    bedrooms = whole(c["bedrooms"], 0, 100)
    glazing, roof, wall = (yes_no_text(c[k]) for k in ("glazing", "roof", "wall"))
    space, water = mentions(c["central"], "electric"), mentions(c["hot_water"], "electric", unless_known=True)
    has = {k: presence(c[k]) for k in ("washing", "washer_dryer", "dryer", "dishwasher", "hob", "oven", "shower", "heater")}
    found = {
        "household_size": size, "household_size_band_common": banded(size, bands["household_size"]), "household_composition_common": made_of, "dwelling_type_common": lives_in,
        "rooms_count": whole(c["rooms"], 0, 100), "bedroom_count_min": bedrooms, "bedroom_band_common": banded(bedrooms, bands["bedrooms"]),
        "double_glazing_any": glazing, "attic_roof_insulation_any": roof, "wall_insulation_any": wall, "thermal_efficiency_proxy_count": count_of(glazing, roof, wall),
        "electric_space_heating_any": space, "electric_water_heating_any": water, "electric_thermal_load": either(space, water),
        "washing_machine_any": either(has["washing"], has["washer_dryer"]), "tumble_dryer_any": either(has["dryer"], has["washer_dryer"]), "dishwasher_any": has["dishwasher"],
        "electric_cooker_any": either(has["hob"], has["oven"]), "electric_shower_any": has["shower"], "portable_electric_heater_any": has["heater"],
    }
    return rows.select("entity", *(x for name, a in found.items() for x in a.named(name)))


# ---- the coded survey -------------------------------------------------------------------------


def _people(x: Column, none: str | None = None) -> Answer:
    """A head count by code, 7 for 7 and more; code `none` for nobody."""
    codes = {str(i): i for i in range(1, 8)} | ({none: 0} if none else {})
    return Answer(_among(x, codes), _absent(x))


def _by(parent: Column, ways: Mapping[str, Answer], missing: str) -> Answer:
    """The answer that a parent question's code leads to."""
    value, reason = F.lit(None), F.lit(missing)
    for code, a in ways.items():
        value, reason = F.when(parent == code, a.value).otherwise(value), F.when(parent == code, a.reason).otherwise(reason)
    out = Answer(value, missing)
    out.reason = reason
    return out


def _never(reason: str, kind: str = "int") -> Answer:
    return Answer(F.lit(None).cast(kind), reason)


def coded_survey(rows: DataFrame, columns: Mapping[str, str], bands: Mapping) -> DataFrame:
    """entity and the variables of a survey answered in codes; columns names the source column of each question."""
    c = {k: F.col(v) for k, v in columns.items()}
    kind = clean_text(c["composition"])
    zero, one = Answer(F.lit(0), BLANK, "available_structural_zero"), Answer(F.lit(1), BLANK, "available_derived_from_live_alone")
    adults = _by(kind, {"1": one, "2": _people(c["adults"]), "3": _people(c["adults"])}, "invalid_parent_response")
    children = _by(kind, {"1": zero, "2": zero, "3": _people(c["children"])}, "invalid_parent_response")
    size = Answer(adults.value + children.value, PARTS)
    at_home = Answer(_people(c["adults_day"], "8").value + F.when(kind == "2", 0).otherwise(_people(c["children_day"], "8").value), PARTS)
    by_day = Answer(F.when(at_home.value == 0, "none").when(at_home.value == 1, "one").when(at_home.value > 1, "two_or_more"), PARTS)
    daytime = _by(kind, {"1": _never("structurally_not_asked_live_alone", "string"), "2": by_day, "3": by_day}, "invalid_parent_response")
    topcoded = F.when(clean_text(c["bedrooms"]) == "5", "available_topcoded_5_plus").otherwise(OK)
    no_bedrooms = F.when(clean_text(c["bedrooms"]) == "6", REFUSED).otherwise(_absent(c["bedrooms"]))
    bedrooms = Answer(_among(c["bedrooms"], {str(i): i for i in range(1, 6)}), no_bedrooms, topcoded)
    area, unit = clean_text(c["area"]), clean_text(c["area_unit"])
    number = F.when(area.try_cast("double") > 0, area.try_cast("double"))
    floor = Answer(
        F.when(area == NO_AREA, None).when(unit == "1", number).when(unit == "2", number * SQUARE_FOOT),
        F.when(area == NO_AREA, "special_missing_not_provided").when(area.isNull(), BLANK).when(number.isNull(), INVALID).otherwise("missing_or_invalid_unit"),
        F.when(unit == "2", "available_converted_from_sqft").otherwise(OK),
    )
    rated = clean_text(c["rated"])
    rating = _by(rated, {"1": coded(c["rating"], RATING), "2": _never("not_applicable_no_ber", "string"), "3": _never(DONT_KNOW, "string")}, INVALID)
    rating.reason = F.when(rated.isNull(), BLANK).otherwise(rating.reason)
    glazing = coded(c["glazing"], {"1": 0} | {str(i): 1 for i in range(2, 6)})
    attic, wall = coded(c["attic"], {"1": 1, "2": 1, "3": 0}, {"4": DONT_KNOW}), coded(c["wall"], {"1": 1, "2": 0}, {"3": DONT_KNOW})
    space, water = either(ticked(c["space_central"]), ticked(c["space_plug"])), either(ticked(c["water_immersion"]), ticked(c["water_instant"]))
    immersion = _by(clean_text(c["water_immersion"]), {"0": _never("structurally_not_asked_no_immersion"), "1": binary_code(c["immersion_use"])}, "invalid_parent_response")
    owned = lambda k: coded(c[k], {"1": 0, "2": 1, "3": 1, "4": 1})
    warm = clean_text(c["warm"])
    poor = _by(warm, {"1": zero, "2": ticked(c["cannot_afford"])}, INVALID)
    found = {
        "household_composition_common": coded(c["composition"], COMPOSITION), "household_size": size, "household_size_band_common": banded(size, bands["household_size"]), "daytime_presence_category": daytime,
        "dwelling_type_common": coded(c["dwelling"], DWELLING, {"6": REFUSED}), "bedroom_count_min": bedrooms, "bedroom_category": Answer(_among(c["bedrooms"], BEDROOMS), no_bedrooms, topcoded), "bedroom_band_common": banded(bedrooms, bands["bedrooms"]),
        "floor_area_m2": floor, "ber_rating": rating, "double_glazing_category": coded(c["glazing"], GLAZING), "attic_insulation_category": coded(c["attic"], ATTIC), "wall_insulation_category": coded(c["wall"], WALL),
        "double_glazing_any": glazing, "attic_roof_insulation_any": attic, "wall_insulation_any": wall, "reported_thermal_feature_count": count_of(glazing, attic, wall),
        "electric_space_heating_any": space, "electric_water_heating_any": water, "immersion_use_when_heating_off": immersion, "electric_thermal_load": either(space, water),
        **{f"{k}_any": owned(k) for k in ("washing_machine", "tumble_dryer", "dishwasher", "electric_cooker", "portable_electric_heater")},
        "electric_shower_any": either(owned("shower_instant"), owned("shower_pumped")),
        "social_class": coded(c["social"], SOCIAL, {"6": REFUSED}), "tenure": coded(c["tenure"], TENURE), "energy_vulnerability": either(poor, binary_code(c["went_without"])),
    }
    # A band that no edge holds has no value either, and keeps how its number came about as the reason.
    return rows.select("entity", *(x for name, a in found.items() for x in a.named(name)))
