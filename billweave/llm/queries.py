"""The registered queries of the corpus operators, with SQL twins where SQL can express them.

Each query applies its operator to the whole table and derives the reported columns from its result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.catalog.registry import Query
from billweave.llm import byte_bpe, chat_format, decontaminate, html_text, merkle, near_dedup, periodic_runs, pieces, quality_classifier, quality_rules, substring_dedup, token_counts, url_filter
from billweave.llm.common import ascii_lower, table, words_of


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


_PATTERN_SQL = " OR ".join(f"regexp_matches(low, '{r.regex}')" for r in url_filter.PATTERN_RULES if r.verdict == url_filter.BLOCK)
_EXCEPT_SQL = " OR ".join(f"regexp_matches(low, '{r.regex}')" for r in url_filter.PATTERN_RULES if r.verdict == url_filter.ALLOW)

OP2_SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, lower(url) AS low_url
  FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, lower(rest) AS low
  FROM parts),
ruled AS (
  SELECT page_id, host, path, low, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NULL AND low <> '' AND ({_PATTERN_SQL}) AND NOT ({_EXCEPT_SQL}) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encoded_and_checked(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_pieces", "piece_ids", "round_trip")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality_rules.quality_rules(docs, carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op4_sql() -> str:
    ratios = {
        "symbol_ratio": "(n_symbols + 1)::DOUBLE / (n_words + 1)::DOUBLE",
        "dup_line_ratio": "(n_dup_lines + 1)::DOUBLE / (n_words + 1)::DOUBLE",
        "repeat_ratio": "(n_repeat_words + 1)::DOUBLE / (n_words + 1)::DOUBLE",
        "mean_word_chars": "CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words::DOUBLE ELSE 0 END",
    }
    picks, bounds, tests = [], [], []
    prior = f"{quality_rules.PRIOR}::DOUBLE"
    for r in quality_rules.RULES:
        for n, q in quality_rules.QUANTILES.items():
            picks.append(f"list_sort(list({r.ratio}))[greatest(1, ceil({q} * count(*))::BIGINT)] AS {r.ratio}_{n}")
        all_ = {n: f"a.{r.ratio}_{n}" for n in quality_rules.QUANTILES}
        own = {n: f"((g.n::DOUBLE * g.{r.ratio}_{n} + {prior} * a.{r.ratio}_{n}) / (g.n::DOUBLE + {prior}))" for n in quality_rules.QUANTILES}
        distance = lambda x, y, r=r: f"{r.reach}::DOUBLE * greatest({y} - {x}, {r.least}::DOUBLE)"
        bounds.append(f"least({own['hi']} + {distance(own['mid'], own['hi'])}, {all_['hi']} + 2 * ({distance(all_['mid'], all_['hi'])})) AS {r.ratio}_hi")
        tests.append(f"{r.ratio} <= {r.ratio}_hi")
        if r.both:
            bounds.append(f"greatest({own['lo']} - {distance(own['lo'], own['mid'])}, {all_['lo']} - 2 * ({distance(all_['lo'], all_['mid'])})) AS {r.ratio}_lo")
            tests.append(f"{r.ratio} >= {r.ratio}_lo")
    return f"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM windows) WHERE n > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
counts AS (
  SELECT s.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN repeated r USING (doc_id)),
m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{sql} AS {name}" for name, sql in ratios.items())}
  FROM counts),
g AS (SELECT lang, source, count(*) AS n, {", ".join(picks)} FROM m WHERE NOT base_failed GROUP BY lang, source),
a AS (SELECT lang, {", ".join(picks)} FROM m WHERE NOT base_failed GROUP BY lang),
cut AS (SELECT g.lang, g.source, {", ".join(bounds)} FROM g JOIN a ON g.lang IS NOT DISTINCT FROM a.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({" AND ".join(tests)}, true) AS kept
FROM m LEFT JOIN cut ON m.lang IS NOT DISTINCT FROM cut.lang AND m.source IS NOT DISTINCT FROM cut.source"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
component AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN component c USING (doc_id)"""


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade 2: good and not toxic, 1: one of both, 0: neither."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grade = F.col("quality") + 1 - F.col("toxic")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), grade)
    return quality_classifier.classify(docs, model).select("doc_id", "expected_grade", "p_top", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_ranges", F.lit(0), lambda total, x: x - total)
    joined = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"),
        (F.size("hit_ranges") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS size FROM bw WHERE len(w) > 0),
test AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT size FROM test),
starts AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, s.size, i, item_id FROM starts s JOIN test t ON s.size = t.size AND s.win = t.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
by_doc AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(by_doc.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN by_doc USING (doc_id)"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.substring_dedup(docs).select("doc_id", "text", "n_cut", "cut_ranges")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a transcript shows them: speaker markers before three of four, the given role hidden. The
    recovered role stands beside the given one."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) != 0
    lines = chat_format.transcribed(given.withColumn("marked", marked), F.col("marked"))
    said = chat_format.render(chat_format.recover_roles(lines, role=None))
    return said.select("conv_id", "turn", "marked", "given_role", "speaker", F.col("speaker").eqNullSafe(F.col("given_role")).alias("agrees"), "starts_turn", "rendered")


#: The CRC-32 of each ``doc_id`` as text, byte by byte (its polynomial is a fixed value).
_CRC_SQL = """crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
crc AS (SELECT DISTINCT doc_id, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM documents, crc_table WHERE doc_id IS NOT NULL)"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    def leaf_of(text: Column) -> Column:
        return merkle.digest_of(*[merkle.field_of(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], merkle.field_of(text))

    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", leaf_of(F.col("text")).alias("own"), F.when(tampered, leaf_of(ascii_lower(F.col("text")))).alias("other"))
    made = merkle.manifest(rows, F.col("own"), "lang", ["doc_id"])
    found = merkle.proofs(made, made.leaves.select("tree", "place", "row"))
    again = merkle.folded(F.coalesce("row.other", "reached"), F.col("path"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("reached").alias("leaf"),
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        again.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = f"""
WITH RECURSIVE {_CRC_SQL},
fields AS (SELECT d.doc_id, coalesce('=' || lang, '-') AS tree, coalesce(crc % 3 = 0, false) AS tampered, text,
    coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents d LEFT JOIN crc ON d.doc_id = crc.doc_id),
hashed AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
  FROM fields),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
nodes AS (SELECT tree, 0 AS level, place, leaf AS digest, n FROM leaves
  UNION ALL SELECT tree, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, place // 8, n),
groups AS (SELECT tree, digest AS subroot, level AS depth, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, place, subroot AS digest, n FROM groups
  UNION ALL SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, place // 8, n),
steps AS (
  SELECT l.tree, l.place, b.level, string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < l.place >> (3 * b.level)) AS l,
    string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > l.place >> (3 * b.level)) AS r
  FROM leaves l JOIN nodes b ON b.tree = l.tree AND b.n > 1 AND b.place >> 3 = l.place >> (3 * b.level + 3) GROUP BY ALL),
top_steps AS (
  SELECT g.tree, g.depth + b.level AS level, string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < g.place >> (3 * b.level)) AS l,
    string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > g.place >> (3 * b.level)) AS r
  FROM groups g JOIN tops b ON b.n > 1 AND b.place >> 3 = g.place >> (3 * b.level + 3) GROUP BY ALL),
path AS (SELECT tree, place, level, coalesce(l, '') AS l, coalesce(r, '') AS r FROM steps
  UNION ALL SELECT leaves.tree, leaves.place, level, coalesce(l, ''), coalesce(r, '') FROM leaves JOIN top_steps USING (tree)),
paths AS (SELECT tree, place, list({{'l': l, 'r': r}} ORDER BY level) AS p FROM path GROUP BY ALL),
fold AS (SELECT tree, place, coalesce(other, leaf) AS node, 1 AS lv, p FROM leaves LEFT JOIN paths USING (tree, place)
  UNION ALL SELECT tree, place, sha256(p[lv].l || node || p[lv].r), lv + 1, p FROM fold WHERE lv <= coalesce(len(p), 0)),
ends AS (SELECT tree, place, node FROM fold WHERE lv > coalesce(len(p), 0))
SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root,
  sha256(coalesce(array_to_string(list_transform(p, lambda s: s.l || s.r), ''), '')) AS proof_sha256, node AS folded_root,
  node = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM leaves JOIN groups USING (tree) LEFT JOIN paths ON paths.tree = leaves.tree AND paths.place = leaves.place
JOIN ends ON ends.tree = leaves.tree AND ends.place = leaves.place"""


def planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with part of the texts made periodic, as the query's contract says: from word ``a`` on, the
    first ``p`` words again and again."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, g = words_of(F.col("text")), F.floor(h / 10).cast("long")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = periodic_runs.collapse_runs(docs)
    # Runs ascend by start and period, so the first of equal exponents stays.
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda x, y: y.isNull() | (x["length"] * y["period"] > y["length"] * x["period"])
    best = F.aggregate("runs", none, lambda y, x: F.when(better(x, y), x).otherwise(y))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = f"""
WITH {_CRC_SQL},
original AS (SELECT row_number() OVER () AS id, d.doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, crc
  FROM documents d LEFT JOIN crc ON d.doc_id = crc.doc_id),
sized AS (SELECT *, len(w) AS n, CASE WHEN crc % 10 = 0 AND len(w) > 0 THEN (crc // 10) % len(w) END AS a FROM original),
periods AS (SELECT *, 1 + (n - a) // (3 + (crc // 10) % 8) AS p FROM sized),
docs AS (SELECT id, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM periods),
words AS (SELECT id, n, i, w[i + 1] AS word FROM (SELECT id, n, w, unnest(range(n)) AS i FROM docs)),
equal AS (SELECT x.id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.id = y.id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT id, start, length, min(q) AS period FROM stretches GROUP BY id, start, length),
best AS (SELECT id, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
listed AS (SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY id),
dropped AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS text FROM words WHERE (id, i) NOT IN (SELECT (id, i) FROM dropped) GROUP BY id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length::BIGINT AS length, period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (id) LEFT JOIN listed USING (id) LEFT JOIN kept USING (id)"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    "op1_html_text": Query(op1_html_text, None),
    "op2_url_filter": Query(op2_url_filter, OP2_SQL),
    "op3_pieces": Query(op3_pieces, None),
    "op4_quality_rules": Query(op4_quality_rules, _op4_sql()),
    "op5_near_dedup": Query(op5_near_dedup, OP5_SQL),
    "op6_quality_classifier": Query(op6_quality_classifier, None),
    "op7_decontamination": Query(op7_decontamination, OP7_SQL),
    "op8_token_counts": Query(op8_token_counts, None),
    "op9_substring_dedup": Query(op9_substring_dedup, None),
    "op10_chat_format": Query(op10_chat_format, None),
    "op11_merkle_manifest": Query(op11_merkle_manifest, OP11_SQL),
    "op12_periodic_runs": Query(op12_periodic_runs, OP12_SQL),
    "op13_byte_bpe": Query(op13_byte_bpe, None),
}
