"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import fim, html, langid, license, minhash, mixing, passages, pu, quality, sharding, tiling, turns, urls
from granary.llm.sql_turns import repair_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.assigned(_table(spark, sf_dir, "documents"))
    first = F.round(F.try_element_at("positions", F.lit(1)), 9).alias("first_position")
    rows = rows.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies", first)
    return rows.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(quality.measured(_table(spark, sf_dir, "documents")))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=2)


def op5_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"))


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op9_passage_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(_table(spark, sf_dir, "documents"), within=True)


def op10_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return turns.repairs(turns.damaged(rows), rows.select("conv_id"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transformed(_table(spark, sf_dir, "documents")))


def op13_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_curriculum_mix": op1_curriculum_mix,
        "op2_fertility": op2_fertility,
        "op3_main_text": op3_main_text,
        "op4_circulant_minhash": op4_circulant_minhash,
        "op5_positive_unlabelled": op5_positive_unlabelled,
        "op6_license_join": op6_license_join,
        "op7_string_tiling": op7_string_tiling,
        "op8_label_propagation": op8_label_propagation,
        "op9_passage_banding": op9_passage_banding,
        "op10_naive_bayes": op10_naive_bayes,
        "op11_turn_repair": op11_turn_repair,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_url_cascade": op13_url_cascade,
    }


#: Words of the lower-cased text, and its distinct 2-word shingles; all pairs that share a shingle are compared.
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || chr(10) || w[i + 1])) END AS s FROM words
), sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
items AS (SELECT doc_id, n, unnest(s) AS x FROM sized),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (
  SELECT a, b FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a
), least_id AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(l.m, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(l.m, s.doc_id)) AS kept
FROM sized s LEFT JOIN least_id l ON l.node = s.doc_id
"""


#: Levels are tried in the order in which sources reach their limit; the curriculum's inverses are written out.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CAST(list_extract([5, 2, 1], rank % 3 + 1) AS DOUBLE) AS weight, 3.0 * CAST(source_size AS DOUBLE) AS most FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY most / weight, rank) AS place FROM w),
l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(most) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM p),
f AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM l WHERE level * weight <= most),
t AS (SELECT l.source, source_size, rank, CASE WHEN f.place IS NULL OR l.place < f.place THEN most ELSE f.level * weight END AS target FROM l, f),
b AS (SELECT doc_id, d.source, size, source_size, target, rank, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin,
  CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(CASE WHEN size > 0 THEN passes + (CASE WHEN begin + size / 2.0 < target - passes * source_size THEN 1 ELSE 0 END) ELSE least(passes, 1) END AS INTEGER) AS copies,
  CASE WHEN target > 0 THEN least(1.0, (begin + CAST(size AS DOUBLE) / 2) / target) END AS q FROM b)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, CAST(size * copies AS BIGINT) AS taken, copies,
  CASE WHEN copies > 0 THEN round(least(1.0, CASE rank % 3
    WHEN 0 THEN q
    WHEN 1 THEN CASE WHEN q < 0.625 THEN 2 * q / (1.5 + sqrt(2.25 - 2 * q)) ELSE 0.5 + 2 * (q - 0.625) / (1 + sqrt(greatest(1 - 2 * (q - 0.625), 0))) END
    ELSE CASE WHEN q < 0.375 THEN 2 * q / (0.5 + sqrt(0.25 + 2 * q)) ELSE 0.5 + 2 * (q - 0.375) / (1 + sqrt(1 + 2 * (q - 0.375))) END END), 9) END AS first_position
FROM c
"""


def _op6_sql() -> str:
    word, upper = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in license.PHRASES)
    templates = ", ".join(f"('{label}', '{text.lower()}')" for label, text in license.TEMPLATES)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS low FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(low, '{word}') AS words FROM t),
p(phrase, label) AS (VALUES {phrases}),
places AS (SELECT rid, label, unnest(list_filter(range(1, len(words) + 1), lambda i: list_slice(words, i, i + len(phrase) - 1) = phrase)) - 1 AS pos FROM w, p),
base AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS found FROM places GROUP BY rid),
m AS (SELECT label, list_distinct(parts) AS tokens, len(parts) AS span, ceil(len(list_distinct(parts)) * 0.8 - 1e-9) AS needed FROM (SELECT label, regexp_extract_all(line, '{word}') AS parts FROM (VALUES {templates}) v(label, line))),
likely AS (SELECT rid, words, m.* FROM w, m WHERE len(list_intersect(words, tokens)) >= needed),
blocks AS (SELECT rid, label, tokens, needed, span, first, list_slice(words, first + 1, first + 2 * span) AS have FROM (SELECT *, unnest(range(0, len(words), span)) AS first FROM likely)),
near AS (SELECT rid, label, first, first + 2 * span AS beyond, len(list_intersect(have, tokens)) / len(tokens) AS containment FROM blocks WHERE len(list_intersect(have, tokens)) >= needed),
rivals AS (SELECT a.label, b.label AS other FROM m a, m b WHERE a.label <> b.label AND len(list_intersect(a.tokens, b.tokens)) >= a.needed),
top AS (SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM near o JOIN rivals r ON r.other = o.label WHERE o.rid = n.rid AND r.label = n.label AND o.containment > n.containment AND o.first < n.beyond AND n.first < o.beyond)),
own AS (SELECT rid, list(label) AS labels, max(containment) AS best FROM top GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(found, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(found, labels))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0::DOUBLE) END AS score
FROM w LEFT JOIN base ON w.rid = base.rid LEFT JOIN own ON w.rid = own.rid
"""


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), h AS (
  SELECT *, len(w) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (len(w) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (
  SELECT *, array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(w[greatest(a, b) + 1:], '') AS r FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || r || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || r || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""


def _op13_sql() -> str:
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    rules = " ".join(f"WHEN {fits(host, path)} THEN '{host}{path}'" for _, host, path in urls.by_length(urls.RULES))
    verdicts = " ".join(f"WHEN '{host}{path}' THEN '{verdict}'" for verdict, host, path in urls.RULES)
    listed = " OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in urls.LISTED)
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
r AS (SELECT *, CASE {rules} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE CASE WHEN {listed} THEN 'block' ELSE 'allow' END END AS verdict FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_curriculum_mix": OP1_SQL, "op4_circulant_minhash": OP4_SQL, "op6_license_join": _op6_sql(), "op11_turn_repair": repair_sql(), "op12_fill_in_middle": OP12_SQL, "op13_url_cascade": _op13_sql()}
