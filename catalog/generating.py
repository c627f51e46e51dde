"""Rule-based tables generated over the keys of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import SEED, Family, table, u_sql, weighted_sql
from twinlake.operators.aggregate import rounded
from twinlake.operators.generate import (
    Bernoulli,
    Conditional,
    DateBetween,
    DrawFrom,
    Expr,
    Fake,
    InBand,
    Lookup,
    Weighted,
    Words,
    by_bracket,
    generate,
    generate_purchases,
)
from twinlake.operators.pseudonym import DICTIONARIES, id_from_pattern, substitute_pii
from twinlake.plans import examples as ex

family = Family()
add = family.add
KEY = "o_orderkey"


def entities(spark, d):
    return table(spark, d, "orders").select(KEY)


def u(stream, key=KEY):
    return u_sql(stream, key)


def _text(v):
    return "'" + str(v).replace("'", "''") + "'"


def _case(on, arms):
    return f"CASE {on} " + " ".join(f"WHEN {_text(k)} THEN {v}" for k, v in arms.items()) + " END"


def _bracket(group, value, spec, factor=1.0):
    arms = {}
    for g, brackets in spec.items():
        inner = " ".join(
            f"WHEN {value} <= {b} THEN {p * factor / 100!r}" for b, p in brackets if b is not None
        )
        last = repr(brackets[-1][1] * factor / 100)
        arms[g] = f"CASE {inner} ELSE {last} END::DOUBLE" if inner else f"{last}::DOUBLE"
    return _case(group, arms)


def _words(words, uu):
    return f"list_value({', '.join(_text(w) for w in words)})[CAST(floor({len(words)} * {uu}) AS INTEGER) + 1]"


GENDER_SQL = weighted_sql(u("Geschlecht"), ex.GENDER)
BAND_SQL = _case('"Geschlecht"', {g: weighted_sql(u("Alterskategorie"), w) for g, w in ex.AGE_BANDS.items()})
PEOPLE = f"""g AS (SELECT o_orderkey, {GENDER_SQL} AS "Geschlecht" FROM orders),
  b AS (SELECT *, {BAND_SQL} AS "Alterskategorie" FROM g),
  people AS (SELECT *, CAST(split_part("Alterskategorie", '-', 1)::INTEGER + floor({u('Alter')} *
      (split_part("Alterskategorie", '-', 2)::INTEGER - split_part("Alterskategorie", '-', 1)::INTEGER + 1)) AS INTEGER)
      AS "Alter" FROM b)"""
PERSON = {
    "Geschlecht": Weighted(ex.GENDER),
    "Alterskategorie": Conditional("Geschlecht", ex.AGE_BANDS),
    "Alter": InBand("Alterskategorie"),
}


def made(spark, d, spec, *cols):
    out = generate(entities(spark, d), spec, SEED, KEY)
    return out.select(KEY, *cols) if cols else out


@add("gen_entities", f"WITH {PEOPLE} SELECT * FROM people")
def _(spark, d):
    return made(spark, d, PERSON)


@add("gen_weighted_draw", f"SELECT o_orderkey, {weighted_sql(u('Bundesland'), ex.STATES)} AS \"Bundesland\" FROM orders")
def _(spark, d):
    return made(spark, d, {"Bundesland": Weighted(ex.STATES)})


@add("gen_conditional_draw", f'WITH {PEOPLE} SELECT o_orderkey, "Geschlecht", "Alterskategorie" FROM people')
def _(spark, d):
    return made(spark, d, PERSON, "Geschlecht", "Alterskategorie")


@add(
    "gen_bernoulli_bracket",
    f"""WITH {PEOPLE} SELECT o_orderkey, "Alter",
        ({u('Covid')} < {_bracket('"Geschlecht"', '"Alter"', ex.COVID_RATE, ex.COVID_BOOSTER)})::INTEGER AS "Covid"
        FROM people""",
)
def _(spark, d):
    spec = {**PERSON, "Covid": Bernoulli(by_bracket("Geschlecht", "Alter", ex.COVID_RATE, ex.COVID_BOOSTER))}
    return made(spark, d, spec, "Alter", "Covid")


def _date_sql(stream, lo, hi):
    return f"CAST({lo} + CAST(floor({u(stream)} * (date_diff('day', {lo}, {hi}) + 1)) AS INTEGER) AS DATE)"


_BORN = _date_sql(
    "Geburtsdatum",
    "CAST(DATE '2022-01-01' - to_years(\"Alter\") AS DATE)",
    "CAST(DATE '2022-12-31' - to_years(\"Alter\") AS DATE)",
)
_BIRTHS = f'births AS (SELECT *, {_BORN} AS "Geburtsdatum" FROM people)'
_EXPIRES = _date_sql(
    "expires", 'CAST("Geburtsdatum" + to_months(1) AS DATE)', 'CAST("Geburtsdatum" + to_months(36) AS DATE)'
)


@add(
    "gen_date_between",
    f"""WITH {PEOPLE}, {_BIRTHS} SELECT o_orderkey, strftime("Geburtsdatum", '%Y-%m-%d') AS born,
        strftime({_EXPIRES}, '%Y-%m-%d') AS expires FROM births""",
)
def _(spark, d):
    born = F.col("Geburtsdatum")
    spec = {
        **PERSON,
        "Geburtsdatum": ex.birthday("Alter"),
        "expires": DateBetween(F.add_months(born, 1), F.add_months(born, 36)),
    }
    out = made(spark, d, spec)
    return out.select(KEY, born.cast("string").alias("born"), F.col("expires").cast("string").alias("expires"))


@add(
    "gen_derived_id",
    f"""WITH {PEOPLE}, {_BIRTHS} SELECT o_orderkey, CAST(CAST(1000 + floor({u('number')} * 9000) AS BIGINT)::VARCHAR
        || strftime("Geburtsdatum", '%d%m%y') AS BIGINT) AS number FROM births""",
)
def _(spark, d):
    spec = {**PERSON, "Geburtsdatum": ex.birthday("Alter"), "number": Expr(ex.insurance_number)}
    return made(spark, d, spec, "number")


_REGIONS = {"AFRICA": 0.1, "AMERICA": 0.3, "ASIA": 0.3, "EUROPE": 0.2, "MIDDLE EAST": 0.1}


@add(
    "gen_hierarchical_draw",
    f"""WITH dim AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS i,
                     count(*) OVER (PARTITION BY r_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey),
             e AS (SELECT o_orderkey, {weighted_sql(u('region'), _REGIONS)} AS region FROM orders),
             sized AS (SELECT e.*, CAST(floor({u('nation')} * s.n) AS BIGINT) AS pick FROM e
                       JOIN (SELECT DISTINCT r_name, n FROM dim) s ON s.r_name = region)
        SELECT o_orderkey, region, n_name AS nation FROM sized JOIN dim ON r_name = region AND i = pick""",
)
def _(spark, d):
    r = table(spark, d, "region")
    n = table(spark, d, "nation")
    dim = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return made(
        spark, d, {"region": Weighted(_REGIONS), "nation": DrawFrom(dim, {"region": "r_name"}, {"nation": "n_name"})}
    )


_MALE, _FEMALE = DICTIONARIES["first_name_male"], DICTIONARIES["first_name_female"]


@add(
    "gen_dictionary_draw",
    f"""WITH g AS (SELECT o_orderkey, {GENDER_SQL} AS "Geschlecht" FROM orders)
        SELECT o_orderkey, "Geschlecht", CASE "Geschlecht" WHEN 'Männlich' THEN {_words(_MALE, u('first/word'))}
            ELSE {_words(_FEMALE, u('first/word'))} END AS first,
          {_words(DICTIONARIES['street'], u('street/word'))} || ' ' ||
          CAST(CAST(floor({u('street/number')} * 200) AS BIGINT) + 1 AS VARCHAR) AS street FROM g""",
)
def _(spark, d):
    first = Conditional("Geschlecht", {"Männlich": Fake("first_name_male"), "Weiblich": Fake("first_name_female")})
    return made(spark, d, {"Geschlecht": Weighted(ex.GENDER), "first": first, "street": Fake("street")})


def _record(name, src, products, rate, copy=None, factor=ex.BOOSTER, last="2022-12-31"):
    flag, fields = f"{name} Impfung", ["Impfstoff", "Impfstoffhersteller", "Impfdatum", "Ablaufdatum des Impfstoffs"]
    q = {f: f'"{name} {f}"' for f in fields}
    given = f"({u(flag)} < {_bracket(chr(34) + 'Geschlecht' + chr(34), chr(34) + 'Alter' + chr(34), rate, factor)})::INTEGER"
    made_by = {
        "Impfstoff": _words(list(products), u(f"{name} Impfstoff")),
        "Impfstoffhersteller": _case(q["Impfstoff"], {k: _text(v) for k, v in products.items()}),
        "Impfdatum": _date_sql(f"{name} Impfdatum", "DATE '2022-01-01'", f"DATE '{last}'"),
        "Ablaufdatum des Impfstoffs": _date_sql(
            f"{name} Ablaufdatum des Impfstoffs",
            f"CAST({q['Impfdatum']} + to_months(1) AS DATE)",
            f"CAST({q['Impfdatum']} + to_months(36) AS DATE)",
        ),
    }
    tag = name.replace(" ", "_").lower()
    if copy:
        given = f'CASE WHEN "{copy} Impfung" = 1 THEN 1 ELSE {given} END'
    out = [f'{tag}0 AS (SELECT *, {given} AS "{flag}" FROM {src})']
    for i, f in enumerate(fields):
        value = f'CASE WHEN "{flag}" = 1 THEN {made_by[f]} END'
        if copy:
            value = f'CASE WHEN "{copy} Impfung" = 1 THEN "{copy} {f}" ELSE {value} END'
        out.append(f"{tag}{i + 1} AS (SELECT *, {value} AS {q[f]} FROM {tag}{i})")
    return ", ".join(out), f"{tag}{len(fields)}"


_POLIO_SQL, _AFTER_POLIO = _record("Polio", "people", ex.POLIO, ex.POLIO_RATE)
_TD_SQL, _AFTER_TD = _record("Tetanus und Diphterie", _AFTER_POLIO, ex.TETANUS, ex.TETANUS_RATE, "Polio")
_RECORDS = [
    f"{v} {f}"
    for v in ("Polio", "Tetanus und Diphterie")
    for f in ("Impfung", "Impfstoff", "Impfstoffhersteller", "Impfdatum", "Ablaufdatum des Impfstoffs")
]


@add(
    "gen_correlated_record",
    f"WITH {PEOPLE}, {_POLIO_SQL}, {_TD_SQL} SELECT o_orderkey, "
    + ", ".join(f"strftime(\"{c}\", '%Y-%m-%d') AS \"{c}\"" if "datum" in c else f'"{c}"' for c in _RECORDS)
    + f" FROM {_AFTER_TD}",
)
def _(spark, d):
    spec = {
        **PERSON,
        "Polio": ex.vaccination(ex.POLIO, by_bracket("Geschlecht", "Alter", ex.POLIO_RATE, ex.BOOSTER)),
        "Tetanus und Diphterie": ex.vaccination(
            ex.TETANUS, by_bracket("Geschlecht", "Alter", ex.TETANUS_RATE, ex.BOOSTER), copy_from="Polio"
        ),
    }
    out = made(spark, d, spec)
    return out.select(
        KEY, *[F.col(c).cast("string").alias(c) if "datum" in c else F.col(c) for c in _RECORDS]
    )


@add(
    "gen_lookup_join",
    f"""WITH p AS (SELECT o_orderkey, {_words(list(ex.COVID), u('product'))} AS product FROM orders)
        SELECT o_orderkey, product, {_case('product', {k: _text(v) for k, v in ex.COVID.items()})} AS maker FROM p""",
)
def _(spark, d):
    return made(spark, d, {"product": Words(list(ex.COVID)), "maker": Lookup("product", ex.COVID)})


_SURVEY = [
    ("Nackenschmerzen", ex.NECK_PAIN),
    ("Rückenschmerzen", ex.BACK_PAIN),
    ("Bluthochdruck", ex.HIGH_PRESSURE),
]


@add(
    "gen_health_survey",
    f"""WITH {PEOPLE} SELECT *, CASE "Geschlecht" WHEN 'Männlich' THEN {_words(_MALE, u('Vorname/word'))}
          ELSE {_words(_FEMALE, u('Vorname/word'))} END AS "Vorname",
        {_words(DICTIONARIES['last_name'], u('Nachname/word'))} AS "Nachname", """
    + ", ".join(
        f"({u(n)} < {_bracket(chr(34) + 'Geschlecht' + chr(34), chr(34) + 'Alter' + chr(34), r)})::INTEGER AS \"{n}\""
        for n, r in _SURVEY
    )
    + " FROM people",
)
def _(spark, d):
    return made(spark, d, ex.health_survey())


_TBE_SQL, _AFTER_TBE = _record("FSME", _AFTER_TD, ex.TBE, ex.TBE_RATE, last="2022-04-30")
_COVID_SQL, _AFTER_COVID = _record("Covid", _AFTER_TBE, ex.COVID, ex.COVID_RATE, factor=ex.COVID_BOOSTER)
_PREFIXES = ", ".join(f"('{p}', {_text(s)})" for s, ps in ex.STATE_PREFIXES.items() for p in ps)


def _place(name, src, dim, parent, parent_col, value):
    """SQL for a uniform row of a dimension within its parent."""
    pick = f"CAST(floor({u(name)} * n) AS BIGINT)"
    return f"""{name.lower()}_d AS (SELECT *, row_number() OVER (PARTITION BY {parent_col} ORDER BY {value}) - 1 AS i,
        count(*) OVER (PARTITION BY {parent_col}) AS n FROM (SELECT DISTINCT {parent_col}, {value} FROM {dim})),
      {name.lower()}_e AS (SELECT e.*, d.{value} AS "{name}" FROM {src} e LEFT JOIN {name.lower()}_d d
        ON d.{parent_col} = e."{parent}" AND d.i = {pick})"""


_REGISTER_COLUMNS = [
    f"{v} {f}"
    for v in ("Polio", "Tetanus und Diphterie", "FSME", "Covid")
    for f in ("Impfung", "Impfstoff", "Impfstoffhersteller", "Impfdatum", "Ablaufdatum des Impfstoffs")
]


@add(
    "gen_vaccination_register",
    f"""WITH rules(prefix, state) AS (VALUES {_PREFIXES}),
        codes AS (SELECT CAST(1000 + p_partkey * 4001 % 9000 AS VARCHAR) AS code, p_brand || ',' || p_type AS cities FROM part),
        areas AS (SELECT state, code, cities FROM codes JOIN rules ON starts_with(code, prefix)),
        towns AS (SELECT code, trim(unnest(string_split(cities, ','))) AS city FROM areas),
        {PEOPLE}, {_POLIO_SQL}, {_TD_SQL}, {_TBE_SQL}, {_COVID_SQL},
        homes AS (SELECT *, {weighted_sql(u('Bundesland'), ex.STATES)} AS "Bundesland" FROM {_AFTER_COVID}),
        {_place('Postleitzahl', 'homes', 'areas', 'Bundesland', 'state', 'code')},
        {_place('Ort', 'postleitzahl_e', 'towns', 'Postleitzahl', 'code', 'city')},
        born AS (SELECT *, {_BORN} AS "Geburtsdatum" FROM ort_e)
        SELECT o_orderkey, "Geschlecht", "Alter", "Alterskategorie", "Bundesland", "Postleitzahl", "Ort",
          strftime("Geburtsdatum", '%Y-%m-%d') AS "Geburtsdatum",
          CAST(CAST(1000 + floor({u('Sozialversicherungsnummer')} * 9000) AS BIGINT)::VARCHAR
            || strftime("Geburtsdatum", '%d%m%y') AS BIGINT) AS "Sozialversicherungsnummer",
          CASE "Geschlecht" WHEN 'Männlich' THEN {_words(_MALE, u('Vorname/word'))}
            ELSE {_words(_FEMALE, u('Vorname/word'))} END AS "Vorname",
          {_words(DICTIONARIES['last_name'], u('Nachname/word'))} AS "Nachname",
          {_words(DICTIONARIES['street'], u('Straße/word'))} || ' ' ||
            CAST(CAST(floor({u('Straße/number')} * 200) AS BIGINT) + 1 AS VARCHAR) AS "Straße", """
    + ", ".join(f"strftime(\"{c}\", '%Y-%m-%d') AS \"{c}\"" if "datum" in c else f'"{c}"' for c in _REGISTER_COLUMNS)
    + " FROM born",
)
def _(spark, d):
    # the parts table stands in for the postcode reference list
    codes = table(spark, d, "part").select(
        (F.lit(1000) + F.col("p_partkey") * 4001 % 9000).alias("code"), F.concat_ws(",", "p_brand", "p_type").alias("cities")
    )
    out = made(spark, d, ex.vaccination_register(codes))
    return out.select(*[F.col(c).cast("string").alias(c) if "datum" in c else F.col(c) for c in out.columns])


@add(
    "gen_purchases",
    f"""WITH m AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r, count(*) OVER () AS n FROM customer),
             p AS (SELECT p_partkey, p_name, p_retailprice, row_number() OVER (ORDER BY p_partkey, p_name, p_retailprice) AS r,
                   count(*) OVER () AS n FROM part),
             e AS (SELECT o_orderkey, CAST(floor({u('member')} * (SELECT any_value(n) FROM m)) AS BIGINT) + 1 AS mr,
                   CAST(floor({u('product')} * (SELECT any_value(n) FROM p)) AS BIGINT) + 1 AS pr,
                   CAST(1 + floor({u('quantity')} * 5) AS INTEGER) AS quantity FROM orders)
        SELECT o_orderkey, c_custkey AS member, p_partkey, p_name, p_retailprice AS unit_price, quantity,
               round(p_retailprice * quantity, 2) AS total, CAST(floor(round(p_retailprice * quantity, 2)) AS BIGINT) AS points
        FROM e JOIN m ON m.r = mr JOIN p ON p.r = pr""",
)
def _(spark, d):
    out = generate_purchases(
        entities(spark, d),
        table(spark, d, "customer"),
        table(spark, d, "part"),
        SEED,
        member="c_custkey",
        product=["p_partkey", "p_name"],
        price="p_retailprice",
        key=KEY,
        points=lambda total: F.floor(total),
    )
    return rounded(out)


@add("syn_id_pattern", "SELECT o_orderkey, 'C' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS case_id FROM orders")
def _(spark, d):
    return entities(spark, d).select(KEY, id_from_pattern("C[0-9]{9}", KEY).alias("case_id"))


def _cu(stream):
    return u_sql(stream, "c_custkey")


@add(
    "anon_substitute_pii",
    f"""SELECT c_custkey, {_words(DICTIONARIES['last_name'], _cu('c_name/word'))} AS c_name,
        '+43 660 ' || lpad(CAST(CAST(floor({_cu('phone/number')} * 10000000) AS BIGINT) AS VARCHAR), 7, '0') AS phone,
        lower({_words(DICTIONARIES['last_name'], _cu('mail/word'))}) ||
          CAST(CAST(floor({_cu('mail/number')} * 1000) AS BIGINT) AS VARCHAR) || '@' ||
          {_words(DICTIONARIES['mail_host'], _cu('mail/host'))} AS mail FROM customer""",
)
def _(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", F.lit("").alias("phone"), F.lit("").alias("mail"))
    return substitute_pii(df, {"c_name": "last_name", "phone": "phone", "mail": "email"}, SEED, "c_custkey")
