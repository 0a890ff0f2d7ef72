"""The corpus queries that ``__spark_entry__`` registers, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import mine_collocations
from .common import table
from .decontam import find_leaks
from .digest import compare_edits
from .extract import extract_pages
from .mixing import mix_documents
from .pseudolikelihood import score_likelihood
from .quality import held_out, judge_quality
from .repeats import remove_repeats
from .search import search_top_k
from .simhash import near_duplicates
from .tokencount import count_tokens
from .urlrules import filter_urls
from .variants import group_variants

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"), budget=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).cast("long").alias("taken"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), table(spark, sf_dir, "labels"), threshold=0.3)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.filter(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search_top_k(docs, queries, k=10)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_likelihood(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bound=2)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"), spoil=31, least_length=7, least=2, ratio=10)


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"), share=3)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"), threshold=100, longest=5, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_top_k_search": op7_top_k_search,
    "op8_html_extraction": op8_html_extraction,
    "op9_pseudo_likelihood": op9_pseudo_likelihood,
    "op10_simhash": op10_simhash,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = {
    "op3_url_filter": r"""
        WITH split AS (
          SELECT page_id,
                 translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
          FROM pages),
        rules(rule_host, rule_path, action) AS (VALUES
          ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
        SELECT page_id, host, path,
               (SELECT max_by(rule_host || rule_path, length(rule_host || rule_path)) FROM rules
                WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
               coalesce((SELECT max_by(action, length(rule_host || rule_path)) FROM rules
                WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)), 'allow') AS verdict
        FROM split""",
    "op4_substring_dedup": r"""
        WITH split AS (
          SELECT doc_id, row_number() OVER () AS r,
                 list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
          FROM documents),
        windows AS (
          SELECT r, unnest(range(1, len(words) - 33)) AS p, words FROM split WHERE len(words) >= 35),
        hashed AS (SELECT r, p, md5(array_to_string(words[p:p + 34], ' ')) AS h FROM windows),
        more AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM hashed JOIN more USING (h)),
        per AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
               sha256(coalesce(array_to_string(list_filter(words, lambda w, i: ps IS NULL OR NOT list_contains(ps, i)), ' '), '')) AS kept_sha256
        FROM split LEFT JOIN per USING (r)""",
    "op11_spelling_variants": r"""
        WITH RECURSIVE
        steps AS (
          SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)::BIGINT[]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) t(b)),
        tab AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM steps),
        texts AS (
          SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+'),
            lambda r: translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS rs FROM documents),
        runs AS (SELECT doc_id, unnest(rs) AS r FROM texts),
        per AS MATERIALIZED (SELECT doc_id, r, count(*) AS c FROM runs WHERE length(r) >= 7 GROUP BY ALL),
        bytes AS (
          SELECT doc_id, r, c,
            list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda x: ascii(x)::BIGINT)
            || flatten(list_transform(string_split(r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, (unicode(x) - 64)::BIGINT] END)) AS bs
          FROM per),
        hashed AS (
          SELECT r, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
          FROM bytes, tab),
        cut AS (
          SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, c FROM hashed),
        words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
        holes AS (SELECT word, n, unnest(list_transform(range(length(word)), lambda i: left(word, i::BIGINT) || '*' || substr(word, i::BIGINT + 2))) AS hole FROM words),
        shorter AS (SELECT DISTINCT word, n, replace(hole, '*', '') AS gone FROM holes),
        near AS (
          SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
          UNION ALL SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.gone = w.word
          UNION ALL SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.gone = w.word),
        best AS (SELECT word, count(*) AS n_near, max(m) AS top FROM near GROUP BY word),
        chosen AS (
          SELECT n.word, min(n.other) AS other FROM near n JOIN best b ON n.word = b.word AND n.m = b.top GROUP BY n.word),
        formed AS MATERIALIZED (
          SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.top >= 10 * w.n THEN c.other END AS form, CASE WHEN b.top >= 10 * w.n THEN b.top END AS form_n
          FROM words w LEFT JOIN best b USING (word) LEFT JOIN chosen c USING (word)),
        walk AS (
          SELECT word, word AS root, form AS ahead FROM formed
          UNION ALL SELECT k.word, f.word, f.form FROM walk k JOIN formed f ON f.word = k.ahead)
        SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk k ON k.word = f.word AND k.ahead IS NULL""",
    "op12_document_fingerprints": r"""
        WITH ordered AS (
          SELECT doc_id, coalesce(text, '') AS text,
                 coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS following,
                 coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id
          FROM documents),
        edited AS (
          SELECT doc_id, next_id, length(text)::BIGINT AS n_chars, text,
                 left(text, length(text) - length(text) // 3) || left(following, length(text) // 3) AS changed FROM ordered),
        forms AS (SELECT doc_id, 0 AS form, text AS t FROM edited UNION ALL SELECT doc_id, 1, changed FROM edited),
        letters AS (SELECT doc_id, form, list_transform(string_split(t, ''), lambda x: unicode(x)) AS cs FROM forms WHERE t <> ''),
        bytes AS (
          SELECT doc_id, form, unnest(flatten(list_transform(cs, lambda u: CASE
              WHEN u < 128 THEN [u]
              WHEN u < 2048 THEN [192 + u // 64, 128 + u % 64]
              WHEN u < 65536 THEN [224 + u // 4096, 128 + u // 64 % 64, 128 + u % 64]
              ELSE [240 + u // 262144, 128 + u // 4096 % 64, 128 + u // 64 % 64, 128 + u % 64] END)))::UBIGINT AS b,
            generate_subscripts(flatten(list_transform(cs, lambda u: CASE WHEN u < 128 THEN [0] WHEN u < 2048 THEN [0, 0] WHEN u < 65536 THEN [0, 0, 0] ELSE [0, 0, 0, 0] END)), 1) AS i
          FROM letters),
        reach AS (
          SELECT doc_id, form, b, lead(b, 1) OVER w AS b1, lead(b, 2) OVER w AS b2, lead(b, 3) OVER w AS b3, lead(b, 7) OVER w AS b7,
                 lead(b, 4) OVER w AS b4, lead(b, 9) OVER w AS b9, lead(b, 5) OVER w AS b5, lead(b, 11) OVER w AS b11
          FROM bytes WINDOW w AS (PARTITION BY doc_id, form ORDER BY i)),
        triplets AS (
          SELECT doc_id, form, b + 256 * b1 + 65536 * b2 + 16777216 AS x FROM reach WHERE b2 IS NOT NULL
          UNION ALL SELECT doc_id, form, b + 256 * b3 + 65536 * b7 + 2 * 16777216 FROM reach WHERE b7 IS NOT NULL
          UNION ALL SELECT doc_id, form, b + 256 * b4 + 65536 * b9 + 3 * 16777216 FROM reach WHERE b9 IS NOT NULL
          UNION ALL SELECT doc_id, form, b + 256 * b5 + 65536 * b11 + 4 * 16777216 FROM reach WHERE b11 IS NOT NULL),
        once AS (SELECT doc_id, form, (x::UBIGINT * 2654435761) % 4294967296 AS y FROM triplets),
        twice AS (SELECT doc_id, form, ((xor(y, y >> 15) * 2246822519::UBIGINT) % 4294967296) >> 24 AS bucket FROM once),
        counted AS (SELECT doc_id, form, bucket, count(*) AS c FROM twice GROUP BY ALL),
        counts AS MATERIALIZED (
          SELECT f.doc_id, f.form, b.bucket, coalesce(c.c, 0) AS c
          FROM forms f CROSS JOIN (SELECT range::UBIGINT AS bucket FROM range(256)) b LEFT JOIN counted c ON c.doc_id = f.doc_id AND c.form = f.form AND c.bucket = b.bucket),
        sorted AS (SELECT doc_id, form, list_sort(list(c)) AS cs FROM counts GROUP BY ALL),
        quartiles AS (SELECT doc_id, form, cs[64] AS q1, cs[128] AS q2, cs[192] AS q3 FROM sorted),
        codes AS (
          SELECT doc_id, form, bucket, (c > q1)::BIGINT + (c > q2)::BIGINT + (c > q3)::BIGINT AS code FROM counts JOIN quartiles USING (doc_id, form)),
        lists AS (SELECT doc_id, form, list(code ORDER BY bucket) AS code FROM codes GROUP BY ALL),
        sizes AS (SELECT doc_id, form, octet_length(encode(t))::BIGINT AS n FROM forms),
        tops AS (SELECT doc_id, form, n, length(bin(n)) - 1 AS top FROM sizes),
        heads AS (
          SELECT doc_id, form, CASE WHEN n < 4 THEN n ELSE 4 * top + (n >> (top - 2)) % 4 END AS len,
                 least(15, 16 * q1 // greatest(q3, 1)) AS r1, least(15, 16 * q2 // greatest(q3, 1)) AS r2
          FROM tops JOIN quartiles USING (doc_id, form)),
        prints AS MATERIALIZED (
          SELECT doc_id, form, len, r1, r2, code,
                 printf('%02x%x%x', len, r1, r2) || array_to_string(list_transform(range(128), lambda j: printf('%x', 4 * code[2 * j + 1] + code[2 * j + 2])), '') AS digest
          FROM heads JOIN lists USING (doc_id, form)),
        pairs AS (
          SELECT doc_id, 1 AS other_form, doc_id AS other FROM edited UNION ALL SELECT doc_id, 0, next_id FROM edited),
        alike AS (
          SELECT p.doc_id, p.other_form, 1.0::DOUBLE - least(416, least(abs(a.len - b.len), 16) + least(abs(a.r1 - b.r1), 4) + least(abs(a.r2 - b.r2), 4)
                   + list_sum(list_transform(list_zip(a.code, b.code), lambda z: CASE WHEN abs(z[1] - z[2]) = 3 THEN 6 ELSE abs(z[1] - z[2]) END)))::DOUBLE / 416.0::DOUBLE AS v
          FROM pairs p JOIN prints a ON a.doc_id = p.doc_id AND a.form = 0 JOIN prints b ON b.doc_id = p.other AND b.form = p.other_form)
        SELECT e.doc_id, e.n_chars, sha256(e.changed) AS edited_sha256, a.digest AS fingerprint, b.digest AS edited_fingerprint, x.v AS near_edited, y.v AS near_next
        FROM edited e JOIN prints a ON a.doc_id = e.doc_id AND a.form = 0 JOIN prints b ON b.doc_id = e.doc_id AND b.form = 1
        JOIN alike x ON x.doc_id = e.doc_id AND x.other_form = 1 JOIN alike y ON y.doc_id = e.doc_id AND y.other_form = 0""",
    "op13_collocations": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang,
                 unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents),
        lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
        grams AS (
          SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
          FROM lists, (SELECT unnest(range(1, 6)) AS size) WHERE len(ws) >= size),
        counts AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
        candidates AS MATERIALIZED (SELECT lang, size, phrase, f AS a FROM counts WHERE size > 1 AND f >= 100),
        free AS (
          SELECT * FROM candidates c WHERE NOT EXISTS (
            SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.size > c.size AND d.a = c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
        cuts AS (
          SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
          FROM (SELECT *, unnest(range(1, size)) AS k FROM free)),
        scored AS (
          SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
          FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
        weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest WHERE nth = 1)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
}
