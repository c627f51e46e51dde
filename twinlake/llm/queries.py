"""The registered queries of this subpackage and, where SQL can express them, their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Family, table, u_sql

from . import crosspoly, divergence, langid, ledger, mix, packing, preference, quality, rankbpe, refine, repeats, simhash, spelling
from .common import LOWER, UPPER

family = Family()

_MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
docs AS (SELECT *, floor(sqrt(n))::BIGINT AS x FROM sized),
sources AS (SELECT source, sum(n)::BIGINT AS size FROM docs GROUP BY source),
weighed AS (
  SELECT *, 2 * size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM sources),
lev AS (
  SELECT *, ((sum(size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
targets AS (
  SELECT source, size,
    coalesce(least(cap::DOUBLE, max(CASE WHEN level * w < cap THEN level END) OVER () * w), cap::DOUBLE) AS target FROM lev),
levels AS (SELECT source, x, sum(n)::BIGINT AS words FROM docs WHERE x > 0 GROUP BY source, x),
rated AS (
  SELECT l.source, l.x, (t.target - 2::DOUBLE * coalesce(sum(words) OVER (PARTITION BY l.source ORDER BY x DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(x * words) OVER (PARTITION BY l.source ORDER BY x DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS c
  FROM levels l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source),
rates AS (SELECT source, max(CASE WHEN c * x < 2 THEN c END) AS rate FROM rated GROUP BY source),
means AS (
  SELECT d.*, t.size AS source_size, t.target, {u_sql("pareto", "doc_id")} AS u,
    CASE WHEN n > 0 THEN least(2::DOUBLE, coalesce(r.rate * x, 2::DOUBLE)) ELSE 0::DOUBLE END AS mean
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
  LEFT JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
odds AS (
  SELECT *, floor(mean)::BIGINT AS whole, CASE WHEN mean - floor(mean) > 0
    THEN (u / (1::DOUBLE - u)) / ((mean - floor(mean)) / (1::DOUBLE - (mean - floor(mean)))) END AS q FROM means),
ranked AS (
  SELECT *, target - (sum(whole * n) OVER (PARTITION BY source))::DOUBLE AS need,
    (sum(CASE WHEN q IS NOT NULL THEN n END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE - n::DOUBLE / 2 AS middle FROM odds)
SELECT doc_id, n AS size, source_size, target,
  (whole + CASE WHEN q IS NOT NULL AND middle < need THEN 1 ELSE 0 END) * n AS taken
FROM ranked"""


@family.add("op1_pareto_mix", _MIX_SQL)
def op1_pareto_mix(spark, sf_dir):
    """Mix all documents; within a source, expected copies grow with the square root of a document's words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mix.word_count("text").alias("size"))
    docs = docs.withColumn("weight", F.floor(F.sqrt("size")).cast("long"))
    mixed = mix.pareto_mix(docs, "doc_id", "source", "size", "weight")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@family.add("op2_attention_quality")
def op2_attention_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = langid.remainder(F.col("doc_id"), 3) == 1
    labels = table(spark, sf_dir, "labels").where(~held_out)
    model = quality.fit(docs, labels, "doc_id", "text", "quality")
    out = quality.scored(docs.withColumn("held_out", held_out), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# A conversation against itself re-answered: its last assistant reply swapped for the one before (or an empty reply).
_REPLIES_SQL = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
last_reply AS (
  SELECT conv_id, max(turn) AS stop, coalesce(arg_max(text, turn) FILTER (WHERE turn < top), '') AS other
  FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS top FROM turns WHERE role = 'assistant') GROUP BY conv_id),
"""


def rejected_replies(turns):
    """Each conversation up to its last assistant turn, answered there with its previous reply, or with nothing."""
    replies = turns.where("role = 'assistant'").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "text")), asc=False).alias("r")
    )
    swap = replies.select(
        "conv_id", F.col("r")[0]["turn"].alias("at"), F.coalesce(F.get("r", F.lit(1))["text"], F.lit("")).alias("other")
    )
    cut = turns.join(swap, "conv_id", "left").where("at IS NULL OR turn <= at")
    return cut.select("conv_id", "turn", "role", F.when(F.col("turn") == F.col("at"), F.col("other")).otherwise(F.col("text")).alias("text"))


_PREFERENCE_SQL = (
    _REPLIES_SQL
    + """
sides AS (
  SELECT conv_id, 'c' AS side, turn, role, text FROM turns
  UNION ALL
  SELECT t.conv_id, 'r', turn, role, CASE WHEN turn = stop THEN other ELSE text END
  FROM turns t LEFT JOIN last_reply l ON t.conv_id = l.conv_id WHERE stop IS NULL OR turn <= stop),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, role, text) AS k FROM sides),
aligned AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.k, r.k) AS k,
    c.k IS NOT NULL AND r.k IS NOT NULL AND c.role = r.role AND c.text = r.text AS same
  FROM (SELECT * FROM placed WHERE side = 'c') c
  FULL JOIN (SELECT * FROM placed WHERE side = 'r') r ON c.conv_id = r.conv_id AND c.k = r.k),
split AS (SELECT conv_id, coalesce(min(CASE WHEN NOT same THEN k END) - 1, max(k)) AS n FROM aligned GROUP BY conv_id),
laid AS (
  SELECT p.*, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown,
    coalesce(sum(CASE WHEN k > n THEN length(role) + length(text) + 13 END) OVER (PARTITION BY p.conv_id, side ORDER BY k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS pos
  FROM placed p JOIN split s ON p.conv_id = s.conv_id)
SELECT conv_id, n AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE k <= n AND side = 'c'), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE k > n AND side = 'c'), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE k > n AND side = 'r'), '') AS rejected,
  coalesce(string_agg(pos::BIGINT || '-' || (pos::BIGINT + length(text) + 7), ',' ORDER BY k)
    FILTER (WHERE k > n AND side = 'c' AND role = 'assistant'), '') AS chosen_loss,
  coalesce(string_agg(pos::BIGINT || '-' || (pos::BIGINT + length(text) + 7), ',' ORDER BY k)
    FILTER (WHERE k > n AND side = 'r' AND role = 'assistant'), '') AS rejected_loss
FROM laid GROUP BY conv_id, n"""
)


@family.add("op3_preference_pairs", _PREFERENCE_SQL)
def op3_preference_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return preference.preference_pairs(turns, rejected_replies(turns))


@family.add(
    "op4_exact_groups",
    f"""
WITH normal AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM normal WINDOW g AS (PARTITION BY text_sha256)""",
)
def op4_exact_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return refine.exact_groups(docs, digest_all=True)


@family.add("op5_remove_repeats")
def op5_remove_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@family.add("op6_language")
def op6_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.remainder(F.col("doc_id"), 5) == 0
    model = langid.fit(docs.where(~held_out), required=False)
    out = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("doc_id", "held_out", "language.lang_pred", "language.score", "language.bits", "language.rejected")


@family.add("op7_pack")
def op7_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@family.add("op8_near_vectors")
def op8_near_vectors(spark, sf_dir):
    return crosspoly.near_vectors(table(spark, sf_dir, "embeddings"))


@family.add("op9_simhash")
def op9_simhash(spark, sf_dir):
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "fingerprint", "component_id", "kept")


@family.add("op10_secrets")
def op10_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found, _ = ledger.scan(docs, ledger.empty_ledger(spark))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*ledger.BASE))
    shown = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ledger.BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(spans).alias("spans"))


@family.add(
    "op11_divergence",
    rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
occurs AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM occurs GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM occurs GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
grid AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n) AS own, sum(lang_n) AS total, count(*) AS v FROM grid GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (own + v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (lang_n + 1)) // (total + v)::HUGEINT AS q
  FROM grid g JOIN totals t ON g.lang = t.lang AND g.source = t.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM items)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
)
def op11_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


@family.add("op12_rank_bpe")
def op12_rank_bpe(spark, sf_dir):
    coded = rankbpe.decode(rankbpe.encode(table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@family.add("op13_spelling")
def op13_spelling(spark, sf_dir):
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


@family.add("pipeline")
def pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)
