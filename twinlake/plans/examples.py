"""Specs of the two example tables: the health survey and the vaccination register."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.operators.generate import (
    Bernoulli,
    Conditional,
    DateBetween,
    DrawFrom,
    Expr,
    Fake,
    InBand,
    Lookup,
    SubRecord,
    Weighted,
    Words,
    by_bracket,
)
from twinlake.operators.joins import prefix_join

# Everything from here to the specs is a fixed value: weights, rates, products and postcode areas.
GENDER = {"Männlich": 0.4929, "Weiblich": 0.5071}

AGE_BANDS = {
    "Männlich": {"15-29": 0.2095, "30-44": 0.2457, "45-59": 0.2629, "60-74": 0.1906, "75-100": 0.0913},
    "Weiblich": {"15-29": 0.1886, "30-44": 0.2287, "45-59": 0.2537, "60-74": 0.2001, "75-100": 0.1289},
}

STATES = {
    "Burgenland": 0.0331,
    "Kärnten": 0.0629,
    "Niederösterreich": 0.1892,
    "Oberösterreich": 0.1676,
    "Salzburg": 0.0627,
    "Steiermark": 0.1395,
    "Tirol": 0.0851,
    "Vorarlberg": 0.0447,
    "Wien": 0.2151,
}

STATE_PREFIXES = {
    "Burgenland": ["7"],
    "Kärnten": ["90", "91", "92", "93", "94", "95", "96", "97", "98"],
    "Niederösterreich": ["2", "3"],
    "Oberösterreich": ["4"],
    "Salzburg": ["5"],
    "Steiermark": ["8"],
    "Tirol": ["60", "61", "62", "63", "64", "65", "66", "99"],
    "Vorarlberg": ["67", "68", "69"],
    "Wien": ["1"],
}

NECK_PAIN = {
    "Männlich": [(29, 1), (44, 8), (59, 20), (74, 19), (None, 24)],
    "Weiblich": [(29, 11), (44, 18), (59, 30), (74, 29), (None, 34)],
}
HIGH_PRESSURE = {
    "Männlich": [(29, 6), (44, 6), (59, 23), (74, 42), (None, 50)],
    "Weiblich": [(29, 3), (44, 3), (59, 23), (74, 42), (None, 56)],
}
BACK_PAIN = {
    "Männlich": [(29, 10), (44, 18), (59, 32), (74, 36), (None, 33)],
    "Weiblich": [(29, 10), (44, 18), (59, 32), (74, 36), (None, 50)],
}
COVID_RATE = {
    "Männlich": [(24, 42), (34, 49), (44, 55), (54, 63), (64, 73), (74, 80), (None, 85)],
    "Weiblich": [(24, 46), (34, 51), (44, 56), (54, 65), (64, 73), (74, 79), (None, 81)],
}
POLIO_RATE = {"Männlich": [(None, 59)], "Weiblich": [(None, 59)]}
TETANUS_RATE = {"Männlich": [(None, 70)], "Weiblich": [(None, 67)]}
TBE_RATE = {"Männlich": [(None, 62)], "Weiblich": [(None, 63)]}
BOOSTER = 0.30
COVID_BOOSTER = 0.80

TETANUS = {
    "Boostrix": "GSK Pharma GmbH",
    "Covaxis": "Sanofi Pasteur Europe",
    "diTeBooster": "AJ Vaccines A/S",
    "DTaP Booster": "AJ Vaccines A/S",
    "dT-reduct Merieux": "Sanofi Pasteur Europe",
    "Td - pur": "Astro Pharma",
}
POLIO = {
    "Boostrix Polio": "GSK Pharma GmbH",
    "Repevax": "Sanofi Pasteur Europe",
    "Revaxis": "Sanofi Pasteur Europe",
}
TBE = {
    "Encepur 0,5 ml": "Bavarian Nordic A/S",
    "FSME-Immun 0,5 ml": "Pfizer Corporation Austria Ges.m.b.H",
}
COVID = {
    "Comirnaty 30 µg": "BioNTech Manufacturing GmbH",
    "Comirnaty Original/Omicron BA.1 (15/15 micrograms)": "BioNTech Manufacturing GmbH",
    "Comirnaty Original/Omicron BA.4 -5 (15/15 micrograms)": "BioNTech Manufacturing GmbH",
    "Covid-19 Impfstoff Valneva": "Valneva Austria GmbH",
    "Jcovden (previously: COVID-19 vaccine Janssen)": "Janssen-Cilag International NV",
    "Nuvaxovid": "Novavax CZ",
    "Spikevax (COVID-19 vaccine Moderna) 0,2 mg/mL": "Moderna Biotech Spain, S.L.",
    "Spikevax (COVID -19 vaccine Moderna) 0,1 mg/mL": "Moderna Biotech Spain, S.L.",
    "Spikevax (COVID -19 vaccine Moderna) 50 µg in Fertigspritze": "Moderna Biotech Spain, S.L.",
    "Spikevax bivalent Original/Omicron BA.1 (50 micrograms/50 micrograms)/mL": "Moderna Biotech Spain, S.L.",
    "Spikevax bivalent Original/Omicron BA.4 - 5 (50 micrograms/50 micrograms)/mL": "Moderna Biotech Spain, S.L.",
    "Vaxzevria (COVID-19 vaccine AstraZeneca)": "AstraZeneca AB",
    "VidPrevtyn Beta": "Sanofi Pasteur",
}


def _names():
    return {
        "Vorname": Conditional("Geschlecht", {"Männlich": Fake("first_name_male"), "Weiblich": Fake("first_name_female")}),
        "Nachname": Fake("last_name"),
    }


def health_survey() -> dict:
    """Person, age and three complaints, each with its rate by gender and age."""
    return {
        "Geschlecht": Weighted(GENDER),
        **_names(),
        "Alterskategorie": Conditional("Geschlecht", AGE_BANDS),
        "Alter": InBand("Alterskategorie"),
        "Nackenschmerzen": Bernoulli(by_bracket("Geschlecht", "Alter", NECK_PAIN)),
        "Rückenschmerzen": Bernoulli(by_bracket("Geschlecht", "Alter", BACK_PAIN)),
        "Bluthochdruck": Bernoulli(by_bracket("Geschlecht", "Alter", HIGH_PRESSURE)),
    }


def birthday(age: str, year: int = 2022) -> DateBetween:
    """A birthday that gives ``age`` in ``year``."""
    lo = F.add_months(F.lit(f"{year}-01-01").cast("date"), F.col(age) * -12)
    hi = F.add_months(F.lit(f"{year}-12-31").cast("date"), F.col(age) * -12)
    return DateBetween(lo, hi)


def insurance_number(ctx, name):
    """Four random digits followed by the birthday."""
    head = F.lit(1000) + F.floor(ctx.u(name) * 9000)
    return F.concat(head.cast("string"), F.date_format("Geburtsdatum", "ddMMyy")).cast("long")


def vaccination(products: dict, rate, copy_from=None, first="2022-01-01", last="2022-12-31") -> SubRecord:
    """A vaccination record: product, manufacturer, date and an expiry 1 to 36 months later."""

    def expiry(record):
        day = F.col(f"`{record} Impfdatum`")
        return DateBetween(F.add_months(day, 1), F.add_months(day, 36))

    return SubRecord(
        p=rate,
        flag="Impfung",
        copy_from=copy_from,
        fields={
            "Impfstoff": Words(list(products)),
            "Impfstoffhersteller": lambda record: Lookup(f"`{record} Impfstoff`", products),
            "Impfdatum": DateBetween(first, last),
            "Ablaufdatum des Impfstoffs": expiry,
        },
    )


def vaccination_register(postcodes: DataFrame, code: str = "code", cities: str = "cities") -> dict:
    """The register over a reference list of postcodes with comma-separated city names."""
    areas = prefix_join(postcodes.withColumn(code, F.col(code).cast("string")), code, STATE_PREFIXES, "state")
    towns = areas.select("state", code, F.explode(F.split(cities, ",")).alias("city")).withColumn("city", F.trim("city"))
    return {
        "Geschlecht": Weighted(GENDER),
        **_names(),
        "Alterskategorie": Conditional("Geschlecht", AGE_BANDS),
        "Alter": InBand("Alterskategorie"),
        "Geburtsdatum": birthday("Alter"),
        "Sozialversicherungsnummer": Expr(insurance_number),
        "Bundesland": Weighted(STATES),
        "Postleitzahl": DrawFrom(areas.select("state", code).distinct(), {"Bundesland": "state"}, {"Postleitzahl": code}),
        "Ort": DrawFrom(towns.select(code, "city").distinct(), {"Postleitzahl": code}, {"Ort": "city"}),
        "Straße": Fake("street"),
        "Polio": vaccination(POLIO, by_bracket("Geschlecht", "Alter", POLIO_RATE, BOOSTER)),
        "Tetanus und Diphterie": vaccination(
            TETANUS, by_bracket("Geschlecht", "Alter", TETANUS_RATE, BOOSTER), copy_from="Polio"
        ),
        "FSME": vaccination(TBE, by_bracket("Geschlecht", "Alter", TBE_RATE, BOOSTER), last="2022-04-30"),
        "Covid": vaccination(COVID, by_bracket("Geschlecht", "Alter", COVID_RATE, COVID_BOOSTER)),
    }
