"""Lookup values and the columns that use them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The federal units of Brazil and their macro-regions.
STATES = {
    "AC": "Acre",
    "AL": "Alagoas",
    "AM": "Amazonas",
    "AP": "Amapá",
    "BA": "Bahia",
    "CE": "Ceará",
    "DF": "Distrito Federal",
    "ES": "Espírito Santo",
    "GO": "Goiás",
    "MA": "Maranhão",
    "MG": "Minas Gerais",
    "MS": "Mato Grosso do Sul",
    "MT": "Mato Grosso",
    "PA": "Pará",
    "PB": "Paraíba",
    "PE": "Pernambuco",
    "PI": "Piauí",
    "PR": "Paraná",
    "RJ": "Rio de Janeiro",
    "RN": "Rio Grande do Norte",
    "RO": "Rondônia",
    "RR": "Roraima",
    "RS": "Rio Grande do Sul",
    "SC": "Santa Catarina",
    "SE": "Sergipe",
    "SP": "São Paulo",
    "TO": "Tocantins",
}
# The macro-region of each federal unit.
REGIONS = {
    "AC": "North",
    "AL": "Northeast",
    "AM": "North",
    "AP": "North",
    "BA": "Northeast",
    "CE": "Northeast",
    "DF": "Central-West",
    "ES": "Southeast",
    "GO": "Central-West",
    "MA": "Northeast",
    "MG": "Southeast",
    "MS": "Central-West",
    "MT": "Central-West",
    "PA": "North",
    "PB": "Northeast",
    "PE": "Northeast",
    "PI": "Northeast",
    "PR": "South",
    "RJ": "Southeast",
    "RN": "Northeast",
    "RO": "North",
    "RR": "North",
    "RS": "South",
    "SC": "South",
    "SE": "Northeast",
    "SP": "Southeast",
    "TO": "North",
}
# Fills, segment names by rank of spend, weekday order, aspects.
NO_TITLE, NO_MESSAGE = "No Title", "No Message"
SEGMENTS = ("Champion", "Loyal Customer", "Potential Loyal", "At Risk")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
ASPECTS = ("delivery", "product quality", "price", "customer service", "packaging")


def lookup(key: Column, pairs: dict[str, str]) -> Column:
    """pairs[key], null for unknown and null keys."""
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.try_element_at(F.create_map(*flat), key)


def state_name(code: Column) -> Column:
    """Full name of a state code; anything else passes through."""
    return F.coalesce(lookup(code, STATES), code)


def region(code_or_name: Column) -> Column:
    """Macro-region of a state given by code or by name; null if unknown."""
    return lookup(code_or_name, REGIONS | {STATES[c]: r for c, r in REGIONS.items()})
