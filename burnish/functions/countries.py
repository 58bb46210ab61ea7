"""Countries: codes from the JVM's own ISO 3166 table, names by rule with the few
that the standard writes otherwise."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import SparkSession

#: ISO 3166 short names that differ from the usual English ones.
ISO_NAMES = {
    "BN": "Brunei Darussalam", "BO": "Bolivia, Plurinational State of", "CD": "Congo, The Democratic Republic of the",
    "CG": "Congo", "CI": "Côte d'Ivoire", "CV": "Cabo Verde", "CZ": "Czechia", "FK": "Falkland Islands (Malvinas)",
    "FM": "Micronesia, Federated States of", "HK": "Hong Kong", "IR": "Iran, Islamic Republic of", "KP": "Korea, Democratic People's Republic of",
    "KR": "Korea, Republic of", "LA": "Lao People's Democratic Republic", "MD": "Moldova, Republic of", "MK": "North Macedonia",
    "MM": "Myanmar", "MO": "Macao", "PS": "Palestine, State of", "RU": "Russian Federation", "SY": "Syrian Arab Republic",
    "SZ": "Eswatini", "TL": "Timor-Leste", "TR": "Türkiye", "TW": "Taiwan, Province of China", "TZ": "Tanzania, United Republic of",
    "VA": "Holy See (Vatican City State)", "VE": "Venezuela, Bolivarian Republic of", "VN": "Viet Nam",
}
#: Further names in use.
ALIASES = {
    "GB": ("Great Britain", "UK", "England", "United Kingdom of Great Britain and Northern Ireland"), "US": ("USA", "United States of America", "America"),
    "AE": ("UAE",), "CZ": ("Czech Republic",), "NL": ("Holland",), "IN": ("Republic of India", "Bharat"), "MM": ("Burma",), "CI": ("Ivory Coast",),
    "CN": ("People's Republic of China",), "DE": ("Federal Republic of Germany",), "TR": ("Turkey",), "SZ": ("Swaziland",), "CV": ("Cape Verde",),
}


def normal(name: str) -> str:
    """Lower case, without accents and outer spaces."""
    plain = unicodedata.normalize("NFKD", name)
    return "".join(c for c in plain if not unicodedata.combining(c)).lower().strip()


@lru_cache(maxsize=1)
def countries() -> tuple[tuple[str, str, str, tuple[str, ...]], ...]:
    """(alpha-2, alpha-3, name, all normal names), by alpha-2."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    locale = spark._jvm.java.util.Locale
    out = []
    for two in sorted(locale.getISOCountries()):
        place = locale("", two)
        usual = place.getDisplayCountry(locale.ENGLISH).replace("&", "and").replace("St.", "Saint")
        name = ISO_NAMES.get(two, usual)
        out.append((two, place.getISO3Country(), name, tuple(dict.fromkeys(normal(n) for n in (name, usual, *ALIASES.get(two, ()))))))
    return tuple(out)
