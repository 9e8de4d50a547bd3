"""Registered queries of the operators, whole tables each, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import (
    conversation_repair,
    decontamination,
    html_extraction,
    language,
    packing,
    quality,
    ranked_search,
    sharding,
    simhash,
    token_counts,
    token_store,
    url_filters,
    warc,
)
from termloom.llm.byte_bpe import Vocabulary
from termloom.operators.partitioning import spread
from termloom.session import scratch_path

VOCABULARY = Vocabulary.read(
    public_tokenizers.path("byte_bpe_50k.json"),
    public_tokenizers.path("byte_bpe_50k.tiktoken"),
    public_tokenizers.PATTERN,
)
PIECES_PATH = public_tokenizers.path("piece_bpe_32k.model")
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table; one in a few files is divided over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def op1_best_fit_packing(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(documents, VOCABULARY)


def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(
        _table(spark, sf_dir, "documents", "doc_id", "text"), PIECES_PATH
    )


def op3_quality_rules(spark, sf_dir):
    return quality.judge(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return url_filters.filter_urls(pages, labels, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op5_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op6_html_extraction(spark, sf_dir):
    return html_extraction.extract(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_language_id(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.train(documents)
    return language.identify(documents, model, spans=False).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op8_benchmark_decontamination(spark, sf_dir):
    found = decontamination.find_leaks(
        _table(spark, sf_dir, "documents", "doc_id", "text"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
    )
    return found.select(
        "doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "first_word"
    )


def op9_sharding(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents", "doc_id", "text")
    found = sharding.shard(documents, scratch_path(spark, "slot_maps"))
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("slot").alias("virtual_slot"),
        F.col("version").alias("map_version"),
    )


def op10_warc(spark, sf_dir):
    folder = scratch_path(spark, "warc_bundles")
    index = warc.write_bundles(_table(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    return warc.read_bundles(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_ranked_search(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked_search.search(_table(spark, sf_dir, "documents", "doc_id", "text"), benchmark)


def op12_token_store(spark, sf_dir):
    folder = scratch_path(spark, "token_store")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_store.read_documents(token_store.write_shards(documents, folder, VOCABULARY), folder)


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with faults by a checksum of each row's place; `present` is false for
    a row that was dropped."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = blank("text")
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(blank("role")).alias("role"),
        F.when(fault == 1, F.lit(""))
        .when(fault == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        (fault != 0).alias("present"),
        F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    )


def op13_conversation_repair(spark, sf_dir):
    turns = damaged(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return conversation_repair.report(turns, F.col("present")).drop("roles")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        query.__name__: query
        for query in (
            op1_best_fit_packing,
            op2_token_counts,
            op3_quality_rules,
            op4_url_filters,
            op5_simhash_near_dedup,
            op6_html_extraction,
            op7_language_id,
            op8_benchmark_decontamination,
            op9_sharding,
            op10_warc,
            op11_ranked_search,
            op12_token_store,
            op13_conversation_repair,
        )
    }


# ---------------------------------------------------------------- SQL


def _quality_sql() -> str:
    """The measures by unnested windows, and the rules as in the table."""
    stop_words = sorted({w for words in quality.STOP_WORDS.values() for w in words.split()})
    listed = ", ".join(f"'{word}'" for word in stop_words)
    punctuation = quality.PUNCTUATION.replace("'", "''")
    rules = []
    for _, numerator, denominator, least, most in quality.RULES:
        below = denominator or "1"
        rules += [f"{numerator} >= {below} * {least}::DOUBLE"] if least is not None else []
        rules += [f"{numerator} <= {below} * {most}::DOUBLE"] if most is not None else []
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
win AS (SELECT r, i, words[i:i + 2] AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n
  FROM twice CROSS JOIN (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words,
  length(array_to_string(words, '')) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(list_filter(words, lambda x: lower(trim(x, '{punctuation}')) IN ({listed}))) AS n_stop_words,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (r))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words
    > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words
    > {quality.MAX_REPEATED_PERCENT} * n_words) AND {' AND '.join(rules)} AS kept
FROM m"""


def _url_sql() -> str:
    cases = "".join(
        f" WHEN (host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}'))"
        f" AND starts_with(path, '/{rule.partition('/')[2]}') THEN '{rule}'"
        for rule, _ in sorted(URL_RULES, key=lambda pair: -len(pair[0]))
    )
    verdicts = "".join(f" WHEN '{rule}' THEN '{verdict}'" for rule, verdict in URL_RULES)
    second = ", ".join(f"'{label}'" for label in url_filters.SECOND_LEVEL)
    low, high = url_filters.MIN_WEIGHT, url_filters.MAX_WEIGHT

    def level(name: str, children: str) -> str:
        """CTEs of the prior's weight and the posterior rates of `children`."""
        return f"""
{name}_weight AS (SELECT coalesce(greatest({low}, least({high}, CASE WHEN more > 0 AND excess > 0
    THEN more / excess - 1 END)), {high}) AS w FROM (
  SELECT sum(p * (1 - p) * (n - 1)) AS more,
    sum(n * pow(good / n - p, 2)) - sum(p * (1 - p)) AS excess FROM {children} WHERE n > 0)),
{name} AS (SELECT c.*, n + w AS weight, (good + w * p) / (n + w) AS rate
  FROM {children} c, {name}_weight)"""

    return rf"""
WITH located AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
outcomes AS (SELECT doc_id AS page_id, (quality = 1 AND coalesce(toxic, 0) = 0)::INT AS good
  FROM labels WHERE quality IS NOT NULL),
hosts AS (SELECT host, count(good) AS n, coalesce(sum(good), 0)::DOUBLE AS good
  FROM located LEFT JOIN outcomes USING (page_id) GROUP BY host),
parts AS (SELECT *, regexp_replace(host, ':\d*$', '') AS name,
  string_split(regexp_replace(host, ':\d*$', ''), '.') AS labels FROM hosts),
sized AS (SELECT *, regexp_matches(name, '^[\d.]+$|^\[') AS address,
  CASE WHEN length(labels[-1]) = 2 AND len(labels) > 1 AND labels[-2] IN ({second})
    THEN 2 ELSE 1 END AS size FROM parts),
placed AS (SELECT host, n, good,
  CASE WHEN address OR len(labels) <= size THEN name
    ELSE array_to_string(labels[-size:], '.') END AS suffix,
  CASE WHEN address OR len(labels) <= size THEN name
    ELSE array_to_string(labels[-(size + 1):], '.') END AS domain FROM sized),
suffix_rows AS (SELECT suffix, sum(n) AS n, sum(good) AS good,
  (SELECT coalesce(sum(good) / nullif(sum(n), 0), 1.0) FROM placed) AS p FROM placed GROUP BY suffix),
{level("suffixes", "suffix_rows")},
domain_rows AS (SELECT d.*, s.rate AS p FROM (SELECT suffix, domain, sum(n) AS n, sum(good) AS good
  FROM placed GROUP BY ALL) d JOIN suffixes s USING (suffix)),
{level("domains", "domain_rows")},
host_rows AS (SELECT h.*, d.rate AS p FROM placed h JOIN domains d USING (suffix, domain)),
{level("rated", "host_rows")},
ruled AS (SELECT *, CASE{cases} END AS rule FROM located)
SELECT page_id, host, path, rule, CASE rule{verdicts}
  ELSE CASE WHEN rate + {url_filters.Z} * sqrt(rate * (1 - rate) / (weight + 1))
    < {url_filters.MIN_GOOD} THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled JOIN rated USING (host)"""


def _leaks_sql() -> str:
    """Every window that shares a shingle with an item, compared by its shingles themselves."""
    return rf"""
WITH words AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id,
    regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS words FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), item_id,
    regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') FROM benchmark),
shingles AS (SELECT side, r, id, pos, k, n, array_to_string(words[pos + 1:pos + k], ' ') AS shingle
  FROM (SELECT *, unnest(range(0, n)) AS pos FROM (
    SELECT *, unnest(CASE WHEN side = 'd' THEN range(1, {decontamination.SHINGLE_WORDS + 1})
      ELSE [least(len(words), {decontamination.SHINGLE_WORDS})] END) AS k,
      len(words) - k + 1 AS n FROM words)) WHERE n > 0 AND k > 0),
d AS (SELECT * FROM shingles WHERE side = 'd'),
b AS (SELECT * FROM shingles WHERE side = 'b'),
windows AS (SELECT DISTINCT d.r AS dr, d.id AS doc_id, b.r AS br, b.id AS item_id, b.n AS size, d.k,
    d.n AS dn, greatest(0, least(d.pos - b.pos, d.n - b.n)) AS start
  FROM d JOIN b USING (k, shingle)),
inside AS (SELECT w.*, shingle, count(*) AS times FROM windows w
  JOIN d ON d.r = w.dr AND d.k = w.k AND d.pos >= start AND d.pos < start + size GROUP BY ALL),
wanted AS (SELECT r AS br, shingle, count(*) AS times FROM b GROUP BY ALL),
shared AS (SELECT i.dr, i.doc_id, i.item_id, i.start, i.size, least(i.size, i.dn) AS held,
    sum(least(i.times, w.times)) AS n
  FROM inside i JOIN wanted w USING (br, shingle) GROUP BY ALL),
alike AS (SELECT doc_id, item_id, start, n / (size + held - n) AS similarity FROM shared)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity,
  arg_max(start, (similarity, -start))::INT AS first_word FROM alike
WHERE similarity >= {decontamination.MIN_SIMILARITY} GROUP BY doc_id, item_id"""


def _search_sql() -> str:
    """Every document that shares a term with an item, scored in full."""
    terms = rf"regexp_extract_all(translate(text, '{url_filters.UPPER}', '{url_filters.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS terms FROM documents),
sizes AS MATERIALIZED (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
weights AS (SELECT term,
    floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, totals GROUP BY term, n_docs),
norms AS (SELECT r, doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM sizes, totals),
asked AS (SELECT b, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS b, item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT b, item_id, r, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN norms USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank,
  doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {ranked_search.TOP}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": _quality_sql(),
        "op4_url_filters": _url_sql(),
        "op8_benchmark_decontamination": _leaks_sql(),
        "op11_ranked_search": _search_sql(),
        "op10_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
  max(page_id) OVER (PARTITION BY html) AS last FROM p),
v AS (SELECT *, payload_bytes >= {warc.MIN_REVISIT_BYTES} AND last IS NOT NULL
  AND page_id IS DISTINCT FROM last AS revisit FROM s)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN revisit THEN last END AS refers_to FROM v""",
    }
