"""One query per operator over its whole table, with SQL twins where SQL can say the same."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import QUERIES, SQL, query, table
from .chat import CONTROLS, conversation_digests, format_conversations
from .decontaminate import contaminated
from .divergence import source_divergence
from .language import fit_languages, predict_language
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .negatives import hard_negatives
from .repeats import remove_repeats
from .scoring import score_texts
from .sharding import extendible_shards
from .text import id_crc32
from .token_files import read_token_files, write_token_files
from .url_filter import HIDDEN, TAGS, VALUE, judge_urls
from .vector_search import top_inner_products

SHARD_BYTES = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"


@query(
    "op1_near_duplicates",
    f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least_id AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_id ON x = d.doc_id""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def public_vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, as the installed package of them tells it."""
    return importlib.import_module("public_tokenizers").path(name)


@query("op2_lm_scores")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, id_crc32("doc_id") % 7 == 2, public_vocabulary("byte_bpe_50k.tiktoken"))


@query("op3_mix_sources")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


@query("op4_repeats")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


@query(
    "op5_shards",
    f"""
WITH h AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS varchar), '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
),
b AS (SELECT d, h >> (60 - d) AS p, sum(n_bytes) AS s FROM h, range(0, 61) t(d) GROUP BY 1, 2),
leaf AS (SELECT h, min(d) AS d FROM (SELECT DISTINCT h.h, b.d FROM h JOIN b ON h.h >> (60 - b.d) = b.p WHERE s <= {SHARD_BYTES} OR b.d = 60) GROUP BY h)
SELECT doc_id, substr(lpad(bin(h.h), 60, '0'), 1, leaf.d) AS shard, CAST(leaf.d AS integer) AS shard_depth, n_bytes,
  CAST(s AS bigint) AS shard_bytes, s > {SHARD_BYTES} AS oversize
FROM h JOIN leaf ON h.h = leaf.h JOIN b ON b.d = leaf.d AND b.p = h.h >> (60 - leaf.d)""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = extendible_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)
    return docs.drop("text")


_TURNS = """
SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'"""


def _escaped_length(column: str) -> str:
    extra = [f"len({column}) - len(replace({column}, chr(92), ''))"]
    extra += [f"(len({column}) - len(replace({column}, '{c}', ''))) // {len(c)}" for c in CONTROLS]
    return f"len({column}) + " + " + ".join(extra)


@query(
    "op6_chat",
    f"""
WITH t AS ({_TURNS}),
o AS (
  SELECT *, {_escaped_length("role")} + {_escaped_length("text")} + {sum(map(len, CONTROLS[:3])) + 1} AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS bigint) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(chars) AS bigint) AS formatted_chars
FROM o GROUP BY conv_id""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, t.* FROM VALUES (0L, 'user', '{hard}'), (1L, 'assistant', '{hard}') AS t(turn, role, text)")
    return conversation_digests(format_conversations(given.union(more)))


@query("op7_contaminated")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op8_top_vectors",
    """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS double)) AS bigint) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS bigint) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS integer) AS rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_token_files(spark, write_token_files(docs, public_vocabulary("word_bpe_49k.json")))


@query("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_crc32("doc_id") % 4 == 2, F.lit(False))
    model = fit_languages(docs.where(id_crc32("doc_id") % 4 != 2))
    found = predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def _share_sql(n: str, total: str) -> str:
    return f"CAST(1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * v) AS bigint)"


@query(
    "op11_source_divergence",
    f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(ln) AS ltotal FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_share_sql("coalesce(c.n, 0)", "coalesce(s.total, 0)")} AS p, {_share_sql("k.ln", "ltotal")} AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS bigint) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM dense WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS integer) AS rank FROM every
) WHERE part = 'pair' OR rank <= 50""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


@query(
    "op12_hard_negatives",
    """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS double)) AS bigint) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.e, c.e)]) AS bigint) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
),
p AS (SELECT * FROM (SELECT a, c, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, c) AS r FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT p.a, p.c AS positive, s.c AS negative, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT a AS anchor_id, positive AS positive_id, CAST(r AS integer) AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 10""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(given.withColumn("label", moved))


# The rules that the query is asked to apply, as (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _url_sql(url: str) -> str:
    """Columns rest, host, path of a URL."""
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"{rest} AS rest, translate(regexp_extract({rest}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"


def _attribute_sql(name: str) -> str:
    pattern = (r"(?is)\s" + name + VALUE).replace("'", "''")
    value = " || ".join(f"regexp_extract(tag, '{pattern}', {i})" for i in (1, 2, 3))
    return f"trim(replace({value}, '&amp;', '&'))"


def _ruled_sql(column: int) -> str:
    longest = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    cases = "".join(
        f" WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(h + p, kind)[column]}'" for kind, h, p in longest
    )
    return f"CASE{cases} END"


_TARGET = f"""CASE WHEN tag ILIKE '<link%' AND list_contains(regexp_split_to_array(lower({_attribute_sql("rel")}), '\\s+'), 'canonical') THEN {_attribute_sql("href")}
  WHEN tag ILIKE '<meta%' AND lower({_attribute_sql("http-equiv")}) = 'refresh'
  THEN trim(regexp_extract({_attribute_sql("content")}, '(?is)^[^;,]*[;,]\\s*url\\s*=\\s*[''"]?([^''"]*)', 1)) END"""
_FULL = """CASE WHEN target = '' OR starts_with(target, '#') THEN NULL WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
  WHEN starts_with(target, '//') THEN scheme || ':' || target WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  WHEN starts_with(target, '/') THEN site || target WHEN starts_with(target, '?') THEN site || path || target
  ELSE site || CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(?s)(.*/)', 1) ELSE '/' END || target END"""
_KEY = "CASE WHEN host <> '' THEN md5(host || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1)) END"


@query(
    "op13_url_verdicts",
    f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, split_part(url, '://', 1) AS scheme, {_url_sql("coalesce(url, '')")} FROM pages
),
tags AS (
  SELECT url, scheme, path, scheme || '://' || host AS site,
    unnest(regexp_extract_all(regexp_replace(html, '{HIDDEN}', ' ', 'g'), '{TAGS}')) AS tag FROM p WHERE host <> ''
),
links AS (SELECT url AS u, {_FULL} AS v FROM (SELECT *, {_TARGET} AS target FROM tags) WHERE target IS NOT NULL),
ends AS (SELECT DISTINCT u FROM (SELECT u FROM links WHERE v IS NOT NULL UNION ALL SELECT v FROM links WHERE v IS NOT NULL)),
keys AS (SELECT u, {_KEY} AS k, {_ruled_sql(1)} AS verdict FROM (SELECT u, {_url_sql("u")} FROM ends)),
one_way AS (SELECT a.k AS x, b.k AS y FROM links l JOIN keys a ON a.u = l.u JOIN keys b ON b.u = l.v WHERE a.k IS NOT NULL AND b.k IS NOT NULL),
both_ways AS (SELECT x, y FROM one_way UNION SELECT y, x FROM one_way),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
judged AS (SELECT r.x, bool_or(verdict = 'allow') AS allowed FROM reach r JOIN keys ON k = r.y WHERE verdict IS NOT NULL GROUP BY 1),
q AS (SELECT page_id, host, path, {_ruled_sql(0)} AS rule, {_ruled_sql(1)} AS own, {_KEY} AS k FROM p)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN NOT allowed THEN 'block' ELSE 'allow' END) AS verdict,
  own IS NULL AND coalesce(NOT allowed, false) AS by_alias
FROM q LEFT JOIN judged ON x = k""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
