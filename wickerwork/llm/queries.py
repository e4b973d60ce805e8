"""The registered queries of this package: each operator over its whole table, with its production parameters, and SQL where
SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerwork.llm import decontamination, line_dedup, mixing, near_dup, packing, phrases, pii, quality, quality_rules, spelling, token_output, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
FOLDED_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def query(name: str, sql: str | None = None) -> Callable:
    def register(plan: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = plan
        if sql is not None:
            ORACLE[name] = sql.strip()
        return plan

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_line_dedup", """
WITH lines AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS place
    FROM documents),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM lines),
counted AS (SELECT source, k, count(DISTINCT doc_id) AS pages FROM keyed WHERE k <> '' GROUP BY source, k),
totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
boiler AS (
    SELECT source, k FROM counted JOIN totals USING (source)
    WHERE pages >= 5 AND pages::DOUBLE / host_pages > 0.1),
marked AS (
    SELECT keyed.*, boiler.k IS NOT NULL AS gone
    FROM keyed LEFT JOIN boiler ON keyed.source = boiler.source AND keyed.k = boiler.k),
rebuilt AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS kept
    FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE r.kept END AS text
FROM documents d LEFT JOIN rebuilt r USING (doc_id)
""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text", F.col("text").alias("original"))
    lines = lambda c: F.size(F.split(c, "\n"))
    dropped = F.when(F.col("original").isNull(), 0).when(F.col("original") == F.col("text"), 0)
    # a document of boilerplate only has an empty text left, which still splits into one line
    left = F.when((F.col("text") == "") & (F.col("original") != ""), F.lit(0)).otherwise(lines("text"))
    return line_dedup.drop_boilerplate(docs).select("doc_id", dropped.otherwise(lines("original") - left).cast("long").alias("n_dropped"), "text")


@query("op3_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(table(spark, folder, "documents"))


@query("op4_token_files")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return token_output.token_files(table(spark, folder, "documents"))


@query("op5_near_duplicates", f"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array({LOWERED}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, least(3, len(words)) AS k, unnest(range(1, len(words) - least(3, len(words)) + 2)) AS i FROM w WHERE len(words) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + k - 1], ' ') AS gram FROM p),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


@query("op6_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.*, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived_pages(table(spark, folder, "pages"))


@query("op8_quality_rules", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS lines FROM t),
base AS (
    SELECT doc_id, text, words, len(words)::BIGINT AS n_words,
           coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines
    FROM w),
windows AS (
    SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base WHERE len(words) >= 3)),
repeated AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
hit AS (
    SELECT doc_id, count(DISTINCT i + d) AS n
    FROM windows JOIN repeated USING (doc_id, g), (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
whole AS (
    SELECT base.*, coalesce(hit.n, 0)::BIGINT AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines,
           length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_chars,
           length(regexp_replace(text, '[\x00-@\[-`{-\x7f]', '', 'g')) AS letters,
           length(regexp_replace(text, '[^!]', '', 'g')) AS marks,
           length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits,
           len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS bullets,
           len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(rtrim(x, ' '), '(\.\.\.|…)$'))) AS ellipses
    FROM base LEFT JOIN hit USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR n_symbols > 0.1::DOUBLE * n_words OR word_chars < 2 * n_words OR word_chars > 18 * n_words
            OR n_dup_lines > 0.5::DOUBLE * n_lines OR upper_chars > 0.5::DOUBLE * word_chars OR marks > 0.3::DOUBLE * n_words
            OR digits > 0.3::DOUBLE * word_chars OR bullets > 0.9::DOUBLE * n_lines OR ellipses > 0.3::DOUBLE * n_lines
            OR letters < 0.5::DOUBLE * word_chars) AS kept
FROM whole
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, folder, "documents"))


@query("op9_personal_data")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(table(spark, folder, "documents"))


@query("op10_decontamination", f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, {FOLDED_WORD}) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWERED}, {FOLDED_WORD}) AS w FROM benchmark),
g AS (
    SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS gram
    FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM (SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0))),
dg AS (
    SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS gram
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
hits AS (SELECT doc_id, k, p, item_id FROM dg JOIN g USING (k, gram)),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_spelling", r"""
WITH RECURSIVE r AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
c AS (SELECT doc, run, count(*) AS n FROM r GROUP BY ALL),
bytes AS (
    SELECT run, n, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc || ':' || run, ''), lambda x:
           CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END))) AS b
    FROM c),
hashed AS (
    SELECT run, n, xor(4294967295::BIGINT, list_reduce(b, lambda h, x: list_reduce([xor(h, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z:
           CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END))) AS h
    FROM bytes),
words AS (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
del AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
    SELECT a.word, b.word AS other, b.n FROM del a JOIN del b ON a.cut = b.cut AND a.i = b.i WHERE a.word <> b.word
    UNION SELECT v.word, del.word, del.n FROM v JOIN del ON del.cut = v.word
    UNION SELECT del.word, v.word, v.n FROM v JOIN del ON del.cut = v.word),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, n AS other_n FROM near
         QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
f AS (
    SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form,
           CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n
    FROM v LEFT JOIN best USING (word)),
steps AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION SELECT steps.word, f.form FROM steps JOIN f ON f.word = steps.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, root FROM steps WHERE root NOT IN (SELECT word FROM f WHERE form IS NOT NULL))
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN ends USING (word)
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


@query("op12_phrases", r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
    FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (
    SELECT lang, k, w[i:i + k - 1] AS words
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, words, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
    SELECT c.lang, c.k AS size, c.words, c.a, l.a AS l, r.a AS r, j, (1000::HUGEINT * c.a::HUGEINT * n.n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS score, n.n
    FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c JOIN n USING (lang)
    JOIN f l ON l.lang = c.lang AND l.words = c.words[1:j] JOIN f r ON r.lang = c.lang AND r.words = c.words[j + 1:c.k]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, j) = 1),
inside AS (
    SELECT DISTINCT lang, words[i:i + m - 1] AS words, a
    FROM (SELECT lang, words, k, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2))),
kept AS (SELECT * FROM lowest WHERE NOT EXISTS (FROM inside i WHERE i.lang = lowest.lang AND i.words = lowest.words AND i.a >= lowest.a)),
ranked AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked QUALIFY rank <= 2000
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query("op13_mixing", r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           len(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{3,}')) AS runs,
           (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656::DOUBLE AS u
    FROM documents),
k AS (
    SELECT *, -ln(u) / CASE WHEN size = 0 THEN 1.0::DOUBLE ELSE 0.05::DOUBLE + 0.95::DOUBLE * least(1.0::DOUBLE, runs::DOUBLE / size) END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM s),
o AS (
    SELECT *, row_number() OVER by_ratio AS place, coalesce(sum(cap) OVER (by_ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
           sum(weight) OVER (by_ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, (SELECT sum(size) FROM d) AS total
    FROM w WINDOW by_ratio AS (ORDER BY cap::DOUBLE / weight, source)),
f AS (SELECT * FROM o WHERE (total - spent)::DOUBLE * weight / weights::DOUBLE <= cap ORDER BY place LIMIT 1),
t AS (
    SELECT o.source, o.source_size, CASE WHEN f.place IS NULL OR o.place < f.place THEN o.cap::DOUBLE
           ELSE (f.total - f.spent)::DOUBLE * o.weight / f.weights::DOUBLE END AS target
    FROM o LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (
    SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
           coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM p
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
