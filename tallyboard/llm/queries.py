"""One query for each operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm import bpe, divergence, exact_dedup, fold_bpe, lang_id, licenses, mixing, ngram_join, pii, quality, spelling, toxicity, url_filter
from tallyboard.llm.common import bound_batches, read_table


#: Key of the query's pseudonyms; a real run passes a secret.
PII_KEY = "query-key"

#: The dated URL list of the query: (entry, key, action, listed from).
URL_LIST = (
    (1, "casino-win.example.com", "block", "2024-01-10"),
    (2, "casino-win.example.com", "allow", "2024-05-01"),
    (3, "casino-win.example.com", "block", "2024-09-15"),
    (4, "free-bets.example.com", "block", "2024-03-01"),
    (5, "cheap-pills.example.com", "block", "2023-06-01"),
    (6, "ads-track.example.com", "block", "2024-02-01"),
    (7, "ads-track.example.com", "allow", "2024-11-01"),
    (8, "example.org", "block", "2024-10-01"),
    (9, "example.org/en", "allow", "2024-10-01"),
    (10, "tionsh.example.net", "block", "2024-04-01"),
    (11, "tionsh.example.net", "allow", "2024-04-20"),
    (12, "blog.tionsh.example.com/de", "block", "2024-07-01"),
)
#: Day on which captures begin; the pages table has no fetch time, so page n was fetched n hours later, by turns of a year.
FIRST_FETCH = "2024-01-01 00:00:00"
HOURS = 8784


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymize(docs, PII_KEY)

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("pii", lambda v: v["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of_kind(k) for k in pii.KINDS]
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_values"), *counts)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    hours = F.make_dt_interval(hours=F.pmod(F.col("page_id") * 7, F.lit(HOURS)).cast("int"))
    captures = pages.select("page_id", "url", (F.lit(FIRST_FETCH).cast("timestamp_ntz") + hours).alias("at"))
    entries = spark.createDataFrame(list(URL_LIST), "entry_id int, key string, action string, day string").withColumn("listed_at", F.col("day").cast("timestamp_ntz"))
    return url_filter.judge(captures, entries, "page_id", "url", "at")


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return quality.compression_rules(read_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    first = F.when(F.col("repeats") > 0, F.get("times", F.lit(0)))
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", "start", F.floor(first * 1e9).cast("long").alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def _fourth(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def language_model(docs: DataFrame) -> lang_id.Model:
    """Model learned from the documents that are not held out."""
    return lang_id.learn(docs.filter(_fourth(F.col("doc_id")) != 2), F.col("lang"), F.col("text"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    found = lang_id.identify(docs, language_model(docs))
    return found.select("doc_id", (_fourth(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    chain = toxicity.train(docs, labels, [("low_quality", 1 - F.col("quality")), ("toxic", F.col("toxic"))])
    found = toxicity.predict(docs, chain)
    return found.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= toxicity.THRESHOLD).alias("toxic"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    return fold_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_ngram_join, op3_url_filter, op4_compression_bands, op5_exact_dedup, op6_source_mix, op7_language, op8_toxicity, op9_licenses, op10_bpe, op11_spelling, op12_rank_bpe, op13_divergence)
}

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"



def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _url_sql() -> str:
    entries = ", ".join(f"({i}, {_text(k)}, {_text(a)}, TIMESTAMP {_text(d)})" for i, k, a, d in URL_LIST)
    return rf"""
WITH entry AS (SELECT * FROM (VALUES {entries}) e(entry_id, key, action, listed_at)),
span AS (SELECT key, action, entry_id, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY key ORDER BY listed_at) AS valid_to
  FROM (SELECT key, listed_at, max_by(action, entry_id) AS action, max(entry_id) AS entry_id FROM entry GROUP BY key, listed_at)),
capture AS (
  SELECT page_id, url, TIMESTAMP {_text(FIRST_FETCH)} + to_hours((page_id * 7 % {HOURS})::INTEGER) AS fetched_at, nullif(rtrim(regexp_extract(lower(url), '{url_filter.HOST}', 1), '.'), '') AS host FROM pages),
part AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(regexp_extract(url, '{url_filter.PATH}', 1), '/'), lambda p: p <> '') AS parts FROM capture),
piece AS (
  SELECT *, list_transform(range(1, least(len(labels), {url_filter.MOST_LABELS}) + 1), lambda k: array_to_string(labels[len(labels) - k + 1:], '.')) AS hosts,
    list_transform(range(0, least(len(parts), {url_filter.MOST_SEGMENTS}) + 1), lambda k: CASE WHEN k = 0 THEN '' ELSE '/' || array_to_string(parts[1:k], '/') END) AS paths FROM part),
asked AS (SELECT DISTINCT page_id, fetched_at, h || p AS key FROM (SELECT page_id, fetched_at, h, unnest(paths) AS p FROM (SELECT page_id, fetched_at, paths, unnest(hosts) AS h FROM piece WHERE host IS NOT NULL))),
best AS (
  SELECT page_id, arg_max({{'key': key, 'action': action, 'entry_id': entry_id}}, (length(split_part(key, '/', 1)), length(key))) AS e
  FROM asked JOIN span USING (key) WHERE fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY page_id)
SELECT page_id, host, fetched_at, coalesce(e.action <> 'block', true) AS allowed, e.entry_id AS entry_id, e.key AS key FROM capture LEFT JOIN best USING (page_id)"""


def _license_sql() -> str:
    known = ", ".join(f"{_text(k)}: {_text(v)}" for k, v in licenses.known().items())
    anchors = "|".join(licenses.ANCHORS)
    low = "lower(text)"
    for sign, form in licenses.SHORT:
        low = f"replace({low}, {_text(sign)}, {_text(form)})"
    steps, last = [], "line0"
    for i, (name, ids) in enumerate((r for r in licenses.RULES if len(r[1]) > 1), 1):
        run = "".join(f"|{x}|" for x in ids)
        steps.append(f"line{i} AS (SELECT doc_id, n_sentences, sentence_ids, replace(line, {_text(run)}, '/') AS line, found || repeat({_text(name + ',')}, ((length(line) - length(replace(line, {_text(run)}, '/'))) // {len(run) - 1})::INTEGER) AS found FROM {last})")
        last = f"line{i}"
    single = [(i, name, ids[0]) for i, (name, ids) in enumerate(licenses.RULES) if len(ids) == 1]
    places = ", ".join(f"{_text(x)}: {i}" for i, _, x in single)
    names = ", ".join(f"{i}: {_text(name + ',')}" for i, name, _ in single)
    return rf"""
WITH cut AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{anchors}') THEN list_filter(list_transform(regexp_split_to_array({low}, '\n|[.!?;:]+[ \t\r\f\v\n]+'),
    lambda s: MAP {{{known}}}[trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))]), lambda x: x IS NOT NULL) ELSE [] END AS ids FROM documents),
line0 AS (SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids, CASE WHEN len(ids) > 0 THEN '|' || replace(array_to_string(ids, ','), ',', '||') || '|' ELSE '' END AS line, '' AS found FROM cut),
{", ".join(steps)}
SELECT doc_id, n_sentences, sentence_ids, rtrim(found || array_to_string(list_transform(list_sort(list_filter(list_transform(regexp_extract_all(line, '\|([^|/]+)\|', 1), lambda i: MAP {{{places}}}[i]), lambda k: k IS NOT NULL)), lambda k: MAP {{{names}}}[k]), ''), ',') AS licenses FROM {last}"""


ORACLE_SQL = {
    "op2_ngram_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)""",
    "op3_url_filter": _url_sql(),
    "op9_licenses": _license_sql(),
    "op5_exact_dedup": rf"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op6_source_mix": rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM totals),
capped AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][rank % 3 + 1] AS weight, (2 * source_size)::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
targets AS (SELECT source, rank, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.rank, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.place, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CASE WHEN source_size > 0 THEN greatest(0, least(2, floor((target - start - size / 2.0::DOUBLE) / source_size)::BIGINT + 1)) ELSE 0 END AS repeats,
    start / target AS part FROM placed),
timed AS (
  SELECT *, CASE rank % 3
    WHEN 0 THEN 2 * part / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * part))
    WHEN 1 THEN 2 * part / (1.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2.0::DOUBLE * part)))
    WHEN 2 THEN CASE WHEN part >= 0.5 THEN 0.5::DOUBLE + 2 * (part - 0.5) / (1.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 4.0::DOUBLE * (part - 0.5))))
      ELSE 2 * part / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 4.0::DOUBLE * part)) END END AS first FROM taken)
SELECT doc_id, size, source_size, target, size * repeats AS taken, start,
  CASE WHEN repeats > 0 THEN floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, first)) * 1e9)::BIGINT END AS position
FROM timed""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
own AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
whole AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(c)::BIGINT AS n FROM own GROUP BY lang, source),
g AS (SELECT lang, source, coalesce(whole.v, 0) AS v, coalesce(sizes.n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN whole USING (lang) LEFT JOIN sizes USING (lang, source)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(own.c, 0) AS c,
    (1 + 1000000000::HUGEINT * (coalesce(own.c, 0) + 5) // (g.n + 5 * g.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (kept.c + 5) // (whole.n + 5 * whole.v))::BIGINT AS q
  FROM g JOIN kept ON kept.lang = g.lang JOIN whole ON whole.lang = g.lang LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
apart AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
every AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(apart.value, 0) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN apart ON apart.lang = g.lang AND apart.source = g.source AND apart.item = h.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
