"""Attribute harmonization: header names, aliases, survey numbers, land use, register text."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Canonical fields and the headers that stand for them, in order of precedence.
SYNONYMS = {
    "survey_no": ["survey_no", "surveyno", "survey_number", "surveynumber", "survey_id", "khasra_no", "khasra", "khasrano", "plot_no", "plotno", "plot_id", "plotid", "cts_no", "ctsno"],
    "subdivision_no": ["subdivision_no", "subdivision", "sub_division", "sub_div", "subdiv", "hissa_no", "pothi_no"],
    "parcel_id": ["parcel_id", "parcelid", "parcel_uid", "id", "uid", "gid", "objectid", "feature_id"],
    "area": ["area", "extent", "area_sq_m", "area_m2", "total_area", "sqm", "size_sqm", "land_area", "rakba"],
    "owner_ref": ["owner_ref", "owner_name", "ownername", "property_holder", "holder_name", "owner", "khata_no", "khatano", "khatedar", "proprietor"],
    "land_use": ["land_use", "landuse", "usage", "property_type", "type", "category", "classification"],
    "status": ["status", "dispute_status", "record_status", "state", "registration_status"],
}
# Property names that stand for a canonical attribute, the first non-null one wins.
ALIASES = {
    "survey_number": ["survey_no", "survey_number", "survey_num", "plot_id", "sy_no"],
    "subdivision_number": ["subdivision_no", "subdiv_no", "hissa_no", "sub_no"],
    "area_m2": ["area", "extent", "parcel_area", "shape_area", "area_sqm"],
    "land_use": ["land_use", "category", "classification", "zoning", "use_type"],
    "village": ["village", "gaothan", "locality"],
    "ward": ["ward", "zone_no", "sector"],
    "owner_ref": ["owner_ref", "owner", "holder", "khathedar"],
}
# Land-use spellings and their standard names.
LAND_USES = {
    "res": "Residential", "residential": "Residential", "comm": "Commercial", "commercial": "Commercial", "agri": "Agricultural", "agricultural": "Agricultural",
    "ind": "Industrial", "industrial": "Industrial", "inst": "Institutional", "institutional": "Institutional", "mixed": "Mixed Use",
}
# Patterns of the fields of a revenue document (all ignore case) and the confidence of a match.
FIELD_PATTERNS = {
    "survey_number": (r"Survey\s*(?:No|Number|#)?[:.\s]*([0-9]+(?:\/[0-9A-Za-z]+)?)", 0.96),
    "subdivision": (r"Subdivision(?:\s*No)?[:.\s]*([0-9A-Za-z]+)", 0.94),
    "owner_name": (r"(?:Owner|Pattadar|Holder|Name)[:.\s]*([A-Za-z\s]+?)(?:\n|,|Area|Status)", 0.93),
    "area_m2": (r"(?:Area|Extent)[:.\s]*([0-9]+(?:\.[0-9]+)?)\s*(?:sq\.?m|m2|sqm|acres|hectares)?", 0.95),
    "land_use": (r"(?:Land\s*Use|Classification)[:.\s]*([A-Za-z\s]+?)(?:\n|,|Village)", 0.91),
    "village": (r"Village[:.\s]*([A-Za-z\s]+?)(?:\n|,|Taluk)", 0.95),
    "taluk": (r"Taluk[:.\s]*([A-Za-z\s]+?)(?:\n|,|District)", 0.94),
    "district": (r"District[:.\s]*([A-Za-z\s]+?)(?:\n|,|State)", 0.97),
    "patta_number": (r"(?:Patta|Khata|Account)\s*(?:No|Number)?[:.\s]*([0-9]+)", 0.92),
    "document_number": (r"(?:Document|Doc|Ref)\s*(?:No|Number)?[:.\s]*([A-Za-z0-9\/-]+)", 0.90),
    "status": (r"Status[:.\s]*([A-Za-z]+)", 0.95),
}
SUBDIVISION_FROM_SURVEY = 0.90
FUZZY_LEAST = 0.78


def clean_key(key: Column) -> Column:
    """Lower-cased key without anything but a-z and 0-9."""
    return F.regexp_replace(F.lower(F.trim(key)), "[^a-z0-9]", "")


def normalized_survey(survey: Column) -> Column:
    """Survey number without spaces and without leading zeros in its parts; null gives ''."""
    packed = F.replace(F.trim(F.coalesce(survey, F.lit(""))), F.lit(" "), F.lit(""))
    parts = F.transform(F.split(packed, "/"), lambda p: F.when(F.regexp_like(p, F.lit("^0*$")), "0").otherwise(F.regexp_replace(p, "^0+", "")))
    return F.when(packed == "", "").otherwise(F.array_join(parts, "/"))


def survey_similarity(a: Column, b: Column) -> Column:
    """100 equal, 80 same base number, 50 if either is blank, else 20."""
    return normal_similarity(normalized_survey(a), normalized_survey(b))


def normal_similarity(x: Column, y: Column) -> Column:
    """``survey_similarity`` of numbers that are normalized already."""
    base = lambda s: F.split_part(s, F.lit("/"), F.lit(1))
    return F.when((x == "") | (y == ""), 50.0).when(x == y, 100.0).when(base(x) == base(y), 80.0).otherwise(20.0)


def full_survey(survey: Column, subdivision: Column) -> Column:
    """Number and subdivision joined by "/", or the number alone if the subdivision is blank or "None"."""
    sub = F.trim(F.coalesce(subdivision, F.lit("")))
    return F.when((sub != "") & (sub != "None"), F.concat_ws("/", F.trim(survey), sub)).otherwise(F.trim(survey))


def first_alias(props: Column, aliases: list[str]) -> Column:
    """Value of the first alias that the map holds with a value."""
    return F.coalesce(*[F.try_element_at(props, F.lit(a)) for a in aliases])


def first_alias_name(props: Column, aliases: list[str], usable=None) -> Column:
    """Name of the alias that ``first_alias`` takes (``usable``: a further test of its value)."""
    usable = usable or (lambda v: v.isNotNull())
    return F.coalesce(*[F.when(usable(F.try_element_at(props, F.lit(a))), F.lit(a)) for a in aliases])


def standard_land_use(raw: Column) -> Column:
    """Standard name of a land use; others in title case: every run of letters begins with a capital, also behind hyphens and digits."""
    names = F.create_map(*[F.lit(x) for pair in LAND_USES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(raw))), F.array_join(F.transform(F.regexp_extract_all(F.trim(raw), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), ""))


def attribute_agreement(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean agreement of attribute pairs: equal 1, one within the other 0.5; .70 if none can be compared."""
    score, n = F.lit(0.0), F.lit(0)
    for a, b in pairs:
        x, y = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
        both = (x != "") & (y != "")
        n = n + F.when(both, 1).otherwise(0)
        score = score + F.when(~both, 0.0).when(x == y, 1.0).when(F.contains(y, x) | F.contains(x, y), 0.5).otherwise(0.0)
    return F.when(n > 0, score / n).otherwise(0.70)


def revenue_fields(text: Column) -> Column:
    """Map of field -> (value, confidence) of what the text holds; a subdivision may come from the survey number.

    The values stand in an array that a lambda binds, so each pattern is searched once.
    """
    names = list(FIELD_PATTERNS)
    found = F.array(*[F.trim(F.regexp_extract(text, "(?i)" + pattern, 1)) for pattern, _ in FIELD_PATTERNS.values()])

    def fields(values: Column) -> Column:
        own = {f: F.nullif(F.get(values, F.lit(i)), F.lit("")) for i, f in enumerate(names)}
        sure = {f: F.lit(c) for f, (_, c) in FIELD_PATTERNS.items()}
        sure["subdivision"] = F.when(own["subdivision"].isNotNull(), sure["subdivision"]).otherwise(F.lit(SUBDIVISION_FROM_SURVEY))
        own["subdivision"] = F.coalesce(own["subdivision"], F.try_element_at(F.split(own["survey_number"], "/"), F.lit(2)))
        entries = F.array(*[F.struct(F.lit(f).alias("key"), F.struct(own[f].alias("value"), sure[f].alias("confidence")).alias("value")) for f in names])
        return F.map_from_entries(F.filter(entries, lambda e: e["value"]["value"].isNotNull()))

    return F.get(F.transform(F.array(found), fields), F.lit(0))


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; for distinct headers only, of which there are few."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def crs_code(crs: Column) -> Column:
    """EPSG number out of the usual spellings of a CRS name."""
    return F.try_to_number(F.regexp_extract(F.upper(F.trim(crs)), r"EPSG:*([0-9]+)$", 1), F.lit("999999")).cast("int")
