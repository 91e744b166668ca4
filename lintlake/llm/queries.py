"""The registered queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.llm import (
    cover_dedup, decontamination, divergence, line_quality, line_runs, mixing, packing, quality_trees, simhash, site_style, spotsigs,
    token_alignment, toxicity,
)
from lintlake.plans.registry import QueryFn

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Words, and lines trimmed and in lower case, as DuckDB sees them.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query()
def op1_simhash_near_dedup(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query()
def op2_retrieval_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query()
def op3_site_style(spark, sf):
    return site_style.main_texts(table(spark, sf, "pages"))


@query()
def op4_block_mixing(spark, sf):
    return mixing.mix_report(table(spark, sf, "documents"))


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 6)) AS p, w FROM d),
g8 AS (SELECT r, p, array_to_string(w[p:p + 7], ' ') AS k FROM g),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM
  (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS c FROM g8) WHERE c > 1) GROUP BY r),
l AS (SELECT r, source, line, {_KEY} AS k, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT r, source, unnest(ls) AS line FROM d)),
lw AS (SELECT * FROM l WHERE n > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY r),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY source),
above AS (SELECT lw.source, lw.k FROM lw JOIN hosts h ON h.source IS NOT DISTINCT FROM lw.source GROUP BY lw.source, lw.k, h.n
  HAVING count(DISTINCT r) > {line_quality.HOST_DOCUMENTS} AND count(DISTINCT r) > {line_quality.HOST_SHARE} * h.n),
taken AS (SELECT r, CAST(sum(n) AS BIGINT) AS n FROM lw JOIN above a ON a.source IS NOT DISTINCT FROM lw.source AND a.k = lw.k GROUP BY r),
s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(taken.n, 0) AS BIGINT) AS n_common_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN taken USING (r)),
b AS (SELECT *, n_words < {line_quality.MIN_WORDS} OR 100 * n_repeat_words > {line_quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND n_words - n_common_words >= {line_quality.MIN_WORDS}
  AND n_words - n_common_words >= {line_quality.MIN_SHARE} * n_words AS kept FROM b""")
def op5_line_frequency_rules(spark, sf):
    return line_quality.quality_rules(table(spark, sf, "documents"))


@query()
def op6_quality_trees(spark, sf):
    return quality_trees.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op7_toxic_neighbours(spark, sf):
    return toxicity.flagged(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, p, line, {_KEY} AS k FROM (SELECT r, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM d)),
c AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= {line_runs.MIN_DOCUMENTS}),
m AS (SELECT l.*, c.k IS NOT NULL AS gone FROM l LEFT JOIN c ON c.k = l.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m JOIN d USING (r) GROUP BY r""")
def op8_line_runs(spark, sf):
    docs = line_runs.drop_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op9_spotsigs(spark, sf):
    return spotsigs.edited_and_next(table(spark, sf, "documents"))


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS i, {_WORDS} AS w FROM documents),
g AS (SELECT r, i, p, array_to_string(w[p:p + 12], ' ') AS k FROM (SELECT r, i, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
f AS (SELECT r, i, p, min(i) OVER (PARTITION BY k) AS first FROM g),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS p FROM f WHERE first < i),
x AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT x.r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM x ANTI JOIN gone USING (r, p) GROUP BY x.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""")
def op10_cover_dedup(spark, sf):
    return cover_dedup.remove_repeats(table(spark, sf, "documents")).drop("kept_text")


@query()
def op11_token_alignment(spark, sf):
    return token_alignment.align(table(spark, sf, "documents"))


#: The words of a text between the given separators, A-Z in lower case.
def _lower_words(separators: str) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(regexp_split_to_array({low}, '{separators}+'), lambda x: x <> '')"


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_lower_words(divergence.BETWEEN)} AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.MIN_DOCUMENTS}),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS n FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
g AS (SELECT e.lang, e.source, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS all_n, coalesce((SELECT sum(n) FROM c WHERE c.lang = e.lang AND c.source = e.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) e LEFT JOIN l ON l.lang = e.lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (g.n + g.v) AS p,
  1 + (1000000000 * (k.total + 1)::HUGEINT) // (g.all_n + g.v) AS q
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x
QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}""")
def op12_source_divergence(spark, sf):
    return divergence.audit(table(spark, sf, "documents"))


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_lower_words(decontamination.BETWEEN)} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), {decontamination.WINDOW}) AS n FROM (SELECT item_id, {_lower_words(decontamination.BETWEEN)} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dw AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.k = dw.k),
hit AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM h)) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)""")
def op13_benchmark_decontamination(spark, sf):
    return decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
