"""Names, addresses and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped from street names.
ADDRESS_NOISE = (
    "AV", "AV.", "AVENIDA", "CALLE", "PJE", "PJE.", "PASAJE", "DIAGONAL", "SITIO",
    "RSU", "HUMEDA", "HÚMEDA", "SECA", "RECICLABLES", "ORGANICO", "ORGÁNICO",
    "INDIFERENCIADO", "DE", "DEL", "LA", "LOS", "LAS", "Y", "E",
)
# Titles dropped before matching significant words of a street.
STREET_TITLES = (
    "AV|AVENIDA|CALLE|PASAJE|PJE|AUT|AUTOPISTA|BV|BOULEVARD|PQUE|PARQUE|DR|DRA|DOCTOR|DOCTORA|"
    "GRAL|GENERAL|CNEL|CORONEL|TTE|TENIENTE|CAP|CAPITAN|ALMTE|ALMIRANTE|BRIG|BRIGADIER|"
    "CBO|CABO|SGTO|SARGENTO|MY|MAYOR|ING|INGENIERO|ARQ|ARQUITECTO|PROF|PROFESOR|"
    "PBTRO|PRESBITERO|MONS|MONSENOR|STA|SANTA|STO|SANTO|SAN|PRES|PRESIDENTE|"
    "GOB|GOBERNADOR|INT|INTENDENTE|DON|DONA|HNA|HERMANA|HNO|HERMANO"
)
# Spellings of street names in the parcel survey.
STREET_ALIASES = {
    "AGURO": "AGUERO",
    "GUMES": "GUEMES",
    "CURAPALIGU": "CURAPALIGUE",
    "AV CURAPALIGU": "CURAPALIGUE",
    "ECHAGU": "ECHAGUE",
    "PEDRO ECHAGU": "PEDRO ECHAGUE",
    "RICCHIERI": "RICHIERI",
    "TENIENTE GENERAL PABLO RICCHIERI": "RICHIERI",
    "JOSE PABLO TORCUATO BATLLE Y ORDONEZ": "BATLLE Y ORDONEZ",
    "AV JOSE PABLO TORCUATO BATLLE Y ORDONEZ": "BATLLE Y ORDONEZ",
}
# Accented letters and their plain forms.
ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝáàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCYaaaaaaeeeeiiiiooooouuuuncyy"


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def neighbourhood_key(name: Column) -> Column:
    """Case- and accent-free key of a neighbourhood name."""
    return fold_accents(F.lower(F.trim(name)))


def normal_name(text: Column, aliases: dict[str, str] = STREET_ALIASES) -> Column:
    """Upper case without accents or punctuation, single spaces, known aliases applied."""
    plain = F.upper(fold_accents(F.coalesce(text, F.lit(""))))
    ascii_only = F.regexp_replace(plain, r"[^\x00-\x7F]", "")
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(ascii_only, r"[^A-Z0-9\s]", " "), r"\s+", " "))
    if not aliases:
        return cleaned
    mapping = F.create_map(*[F.lit(item) for pair in aliases.items() for item in pair])
    return F.coalesce(mapping[cleaned], cleaned)


def significant_words(text: Column) -> Column:
    """Sorted words of a street name without titles and single letters."""
    bare = F.regexp_replace(normal_name(text), rf"(?i)\b({STREET_TITLES})\b", " ")
    words = F.filter(
        F.split(F.trim(bare), r"\s+"),
        lambda w: (F.length(w) > 1) | F.regexp_like(w, F.lit(r"^[0-9]$")),
    )
    return F.array_sort(words)


def _after_dash(text: Column) -> Column:
    upper = F.upper(text)
    dash = F.locate("-", upper)
    tail = F.when(dash > 0, F.trim(F.substring(upper, dash + 1, F.length(upper)))).otherwise(upper)
    return F.replace(tail, F.lit("º"), F.lit("°"))


def _street_words(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")
    words = F.filter(
        F.split(F.trim(spaced), r"\s+"),
        lambda w: (~w.isin(*ADDRESS_NOISE)) & (F.length(w) > 1),
    )
    return F.when(F.size(words) > 0, F.array_join(words, " "))


_DOOR = r"(?<![\p{L}\p{N}_])(\d{1,5})(?![\p{L}\p{N}_])"


def street_name(text: Column) -> Column:
    """Normalised street, with or without a number in the text; null when nothing is left."""
    return _street_words(F.regexp_replace(_after_dash(text), _DOOR, " "))


def street_number(text: Column) -> Column:
    """First free-standing number of one to five digits."""
    found = F.regexp_extract(_after_dash(text), _DOOR, 1)
    return F.when(found != "", found.cast("int"))


def parse_address(text: Column) -> Column:
    """struct<street, number>, or null when either part is missing."""
    street, number = street_name(text), street_number(text)
    return F.when(
        street.isNotNull() & number.isNotNull(), F.struct(street.alias("street"), number.alias("number"))
    )


def repair_enie(text: Column) -> Column:
    """Undo the broken letter of the route files."""
    return F.replace(text, F.lit("±"), F.lit("ñ"))


def id_suffix(text: Column) -> Column:
    """Part after the last pipe, trimmed."""
    return F.trim(F.element_at(F.split(text, r"\|"), -1))


def numeric_suffix(text: Column) -> Column:
    return id_suffix(text).try_cast("bigint")


def source_serie_id(raw: Column, prefix: str) -> Column:
    """Serie ids carry their source: prefix and pipe are added when absent."""
    return F.when(F.contains(raw, F.lit("|")), raw).otherwise(F.concat(F.lit(f"{prefix}|"), raw))
