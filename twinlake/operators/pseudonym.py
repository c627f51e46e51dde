"""Pseudonyms, fake personal data and pattern ids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.functions.rand import as_column, below, digest, uniform
from twinlake.operators.rank import global_rank
from twinlake.sources.scratch import materialize

# Example dictionaries for fake personal data.
DICTIONARIES = {
    "first_name_male": ["Anton", "Bernd", "Emil", "Georg", "Jakob", "Leo", "Paul", "Valentin"],
    "first_name_female": ["Anna", "Clara", "Elsa", "Greta", "Ida", "Lena", "Marie", "Sophie"],
    "last_name": ["Bauer", "Eder", "Fuchs", "Gruber", "Huber", "Lang", "Maier", "Wolf", "Ziegler"],
    "street": ["Ahornweg", "Bachgasse", "Dorfplatz", "Feldweg", "Hauptstraße", "Lindenallee", "Ringstraße"],
    "mail_host": ["example.org", "example.com", "example.net"],
}


def pseudonym_map(df: DataFrame, col: str, seed, null_as_value: bool = True) -> DataFrame:
    """One distinct integer in [1, 5n-1] per distinct value: columns ``value``, ``pseudonym``.

    Values are ordered by a keyed digest, so the numbers say nothing about the
    order of the values.
    """
    values = df.select(F.col(col).alias("value")).distinct()
    if not null_as_value:
        values = values.filter(F.col("value").isNotNull())
    keyed = values.withColumn("__h", digest(seed, "pseudonym", "value"))
    ranked, _ = global_rank(keyed, "__h", name="__r")
    step = below(uniform(seed, "pseudonym-gap", "value"), 4)  # a stream of its own: the rank says nothing about it
    return ranked.select("value", (5 * (F.col("__r") - 1) + 1 + step).alias("pseudonym"))


def hash_pseudonym(col, seed) -> Column:
    """Join-free pseudonym of 128 bits as text, for streams and for keys whose map would be too large."""
    return digest(seed, "pseudonym", col)


def pseudonymize(df: DataFrame, col: str, seed, method: str = "rank", null_as_value: bool = True) -> DataFrame:
    if method == "hash":
        p = hash_pseudonym(col, seed)
        return df.withColumn(col, p if null_as_value else F.when(F.col(col).isNotNull(), p))
    if method != "rank":
        raise ValueError("method is 'rank' or 'hash'")
    mapping = materialize(pseudonym_map(df, col, seed, null_as_value))
    order = df.columns
    joined = df.join(mapping, F.col(col).eqNullSafe(F.col("value")), "left").drop(col, "value")
    return joined.withColumnRenamed("pseudonym", col).select(*order)


def dictionary_draw(words: list[str], u: Column) -> Column:
    """A word of a short list, by index into a literal array."""
    if len(words) > 10_000:
        raise ValueError("long dictionaries belong in a table: use DrawFrom")
    return F.element_at(F.array(*[F.lit(w) for w in words]), (below(u, len(words)) + 1).cast("int"))


def fake_value(kind: str, seed, stream: str, key, dictionaries=None) -> Column:
    """Fake personal data of a kind: a dictionary name, ``street``, ``phone`` or ``email``."""
    words = {**DICTIONARIES, **(dictionaries or {})}

    def draw(name, tag):
        return dictionary_draw(words[name], uniform(seed, f"{stream}/{tag}", key))

    if kind == "street":
        number = below(uniform(seed, f"{stream}/number", key), 200) + 1
        return F.concat_ws(" ", draw("street", "word"), number.cast("string"))
    if kind == "phone":
        digits = below(uniform(seed, f"{stream}/number", key), 10_000_000)
        return F.concat(F.lit("+43 660 "), F.lpad(digits.cast("string"), 7, "0"))
    if kind == "email":
        number = below(uniform(seed, f"{stream}/number", key), 1000)
        user = F.concat(F.lower(draw("last_name", "word")), number.cast("string"))
        return F.concat(user, F.lit("@"), draw("mail_host", "host"))
    return draw(kind, "word")


def substitute_pii(df: DataFrame, kinds: dict[str, str], seed, key, dictionaries=None) -> DataFrame:
    """Overwrite each column by fakes of its kind, drawn from the row key."""
    return df.withColumns(
        {c: fake_value(kind, seed, c, key, dictionaries) for c, kind in kinds.items()}
    )


_PIECE = re.compile(r"\[0-9\]\{(\d+)\}|\\d\{(\d+)\}|([^\[\]\\{}()|*+?.^$]+)")


def id_from_pattern(pattern: str, number) -> Column:
    """Ids such as ``C[0-9]{6}`` from a row number: literals and one fixed-width digit run.

    A number too large for the run is NULL rather than a truncated duplicate.
    """
    pieces, at, runs = [], 0, 0
    n = as_column(number).cast("long")
    fits = F.lit(True)
    while at < len(pattern):
        m = _PIECE.match(pattern, at)
        if not m:
            raise ValueError(f"unsupported id pattern: {pattern}")
        width = m.group(1) or m.group(2)
        if width:
            runs += 1
            pieces.append(F.lpad(n.cast("string"), int(width), "0"))
            fits = fits & (F.length(n.cast("string")) <= int(width))
        else:
            pieces.append(F.lit(m.group(3)))
        at = m.end()
    if runs != 1:
        raise ValueError("an id pattern has exactly one run of digits")
    return F.when(fits, F.concat(*pieces))
