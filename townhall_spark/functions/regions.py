"""US state names, Census regions and divisions as map literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from townhall_spark.functions.literals import text_map

# State name -> postal code.
STATE_CODES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA",
    "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "District of Columbia": "DC",
    "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL",
    "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA",
    "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI",
    "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT",
    "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ",
    "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND",
    "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA",
    "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN",
    "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}

# Census region -> division -> states.
CENSUS = {
    "Northeast": {
        "New England": ("CT", "ME", "MA", "NH", "RI", "VT"),
        "Middle Atlantic": ("NJ", "NY", "PA"),
    },
    "Midwest": {
        "East North Central": ("IL", "IN", "MI", "OH", "WI"),
        "West North Central": ("IA", "KS", "MN", "MO", "NE", "ND", "SD"),
    },
    "South": {
        "South Atlantic": ("DE", "DC", "FL", "GA", "MD", "NC", "SC", "VA", "WV"),
        "East South Central": ("AL", "KY", "MS", "TN"),
        "West South Central": ("AR", "LA", "OK", "TX"),
    },
    "West": {
        "Mountain": ("AZ", "CO", "ID", "MT", "NV", "NM", "UT", "WY"),
        "Pacific": ("AK", "CA", "HI", "OR", "WA"),
    },
}

STATE_REGION = {
    state: region
    for region, divisions in CENSUS.items()
    for states in divisions.values()
    for state in states
}
STATE_DIVISION = {
    state: division
    for divisions in CENSUS.values()
    for division, states in divisions.items()
    for state in states
}


def lookup(table: dict[str, str], key: Column, default: Column | str | None) -> Column:
    """Value of ``key`` in a small fixed table, ``default`` when absent."""
    found = F.try_element_at(text_map(table), key)
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def region(state: Column) -> Column:
    """Census region of a postal code, ``Unknown`` when there is none."""
    return lookup(STATE_REGION, F.upper(state), "Unknown")


def division(state: Column) -> Column:
    """Census division of a postal code, ``Unknown`` when there is none."""
    return lookup(STATE_DIVISION, F.upper(state), "Unknown")
