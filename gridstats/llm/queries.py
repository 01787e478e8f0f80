"""Registered queries of this subpackage: opN_<name> over the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstats.llm import ann, audit, decontam, jaccard, licenses, linededup, mixing, pii, quality, rules, tokencount, variants, warc
from gridstats.llm.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, vocabulary()).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    # Every record is put together again; its bytes are told by their number and digest.
    return warc.with_record(warc.read_archive(spark, folder)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified",
        F.octet_length("record").cast("long").alias("record_bytes"), F.sha1("record").alias("record_sha1"),
    )


#: Three words, at least 90 of 100.
NEAR = jaccard.Spec(words=3, num=90, den=100)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), NEAR)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rules.fit(docs, table(spark, sf_dir, "labels"))
    return rules.judge(docs, model).drop("text")


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_personal_data": op10_personal_data,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE: dict[str, str] = {
    # Every document through every order, step by step.
    "op11_filter_audit": """
        WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        d AS (SELECT id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                     100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
                     coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS e FROM t LEFT JOIN l USING (doc_id)),
        f AS (SELECT id, 'A' AS f FROM d WHERE a UNION ALL SELECT id, 'B' FROM d WHERE b UNION ALL SELECT id, 'C' FROM d WHERE c UNION ALL SELECT id, 'D' FROM d WHERE d UNION ALL SELECT id, 'E' FROM d WHERE e),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT p.x || q.x || r.x || s.x || u.x AS o FROM x p, x q, x r, x s, x u WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
        g AS (SELECT o, id, min(instr(o, f)) AS g FROM o, f GROUP BY ALL),
        n AS (SELECT id, count(*) AS n FROM f GROUP BY id),
        y AS (SELECT d.part, o.o, CAST(s AS INT) AS s, count(*) FILTER (coalesce(g.g, 9) > s) AS kept, count(*) FILTER (g.g = s) AS removed,
                     count(*) FILTER (g.g < s AND f.f IS NOT NULL) AS redundant, count(*) FILTER (f.f IS NOT NULL AND n.n = 1) AS unique_fails,
                     count(*) FILTER (g.g = s AND good = 1) AS good_lost, count(*) FILTER (g.g = s AND toxic = 1) AS toxic_lost
              FROM d CROSS JOIN o CROSS JOIN (SELECT unnest(range(1, 6)) AS s) LEFT JOIN g ON g.id = d.id AND g.o = o.o LEFT JOIN n ON n.id = d.id LEFT JOIN f ON f.id = d.id AND f.f = substr(o.o, s, 1)
              GROUP BY ALL)
        SELECT part, o AS filter_order, s AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, substr(o, s, 1)) AS BIGINT) AS shapley FROM y""",
    # CRC-32 by its table, which a rule builds; one edit apart by what is left when one letter goes.
    "op12_spelling_variants": """
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
        r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        d AS (SELECT id, run, count(*) AS n FROM r GROUP BY ALL),
        h AS (SELECT run, n, xor(4294967295, list_reduce(flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)),
                lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295)) AS h FROM d, crc),
        v AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
        w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        c AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
        p AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM c a JOIN c b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
              UNION SELECT c.word, w.word, w.n FROM c JOIN w ON w.word = c.cut UNION SELECT w.word, c.word, c.n FROM c JOIN w ON w.word = c.cut),
        b AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM p GROUP BY word),
        f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * w.n THEN (SELECT min(near) FROM p WHERE p.word = w.word AND p.near_n = b.top) END AS form,
                     CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n FROM w LEFT JOIN b USING (word)),
        up(word, top) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.top WHERE f.form IS NOT NULL)
        SELECT f.word, f.n, f.n_near, f.form, f.form_n, up.top AS root FROM f JOIN up USING (word) JOIN f AS last ON last.word = up.top AND last.form IS NULL""",
    "op8_jaccard_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, l.y FROM reach JOIN l ON l.x = reach.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id)
            JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)""",
    "op7_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages),
        k AS (SELECT *, n >= 1000 AND page_id < m AS again, chr(13) || chr(10) AS e FROM p),
        r AS (SELECT *, 'WARC/1.1' || e || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e
                || 'WARC-Date: 1970-01-01T00:00:00Z' || e || coalesce('WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || e, '') || 'WARC-Payload-Digest: sha1:' || sha1(t) || e
                || CASE WHEN again THEN 'WARC-Refers-To: <urn:page:' || m || '>' || e || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' ELSE 'Content-Type: text/html; charset=utf-8' END || e
                || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE n END || e || e || CASE WHEN again THEN '' ELSE t END || e || e AS record FROM k)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN m END AS refers_to,
               TRUE AS verified, CAST(octet_length(encode(record)) AS BIGINT) AS record_bytes, sha1(record) AS record_sha1 FROM r""",
    "op4_line_dedup": """
        WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS raw FROM l0),
        f AS (SELECT doc_id, i, t, md5(t) AS h, length(t) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r,
                     sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS c
              FROM (SELECT doc_id, i, trim(raw, ' ' || chr(9) || chr(13)) AS t FROM l) WHERE t <> ''),
        k AS (SELECT a.doc_id, a.r, min(b.r - a.r + 1) AS k FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r AND a.r + 3
              WHERE b.c - a.c + a.n >= 40 OR b.r - a.r = 3 GROUP BY ALL),
        g AS (SELECT k.doc_id, k.r, k.k, CASE WHEN k.k = 1 THEN min(m.h) ELSE md5(string_agg(m.h, '' ORDER BY m.r)) END AS key
              FROM k JOIN f m ON m.doc_id = k.doc_id AND m.r BETWEEN k.r AND k.r + k.k - 1 GROUP BY k.doc_id, k.r, k.k),
        s AS (SELECT DISTINCT doc_id, r, key FROM (
              SELECT a.doc_id, b.r, b.key, row_number() OVER (PARTITION BY a.doc_id, a.r ORDER BY b.key, b.r) AS q
              FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r AND a.r + a.k - 1) WHERE q = 1),
        o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, r) AS q FROM s),
        m AS (SELECT b.doc_id, b.r, a.doc_id AS od, a.r AS og FROM o a JOIN o b ON a.key = b.key AND a.q = 1 AND b.q > 1),
        x AS (SELECT m.*, d FROM m CROSS JOIN (SELECT unnest(range(-3, 8)) AS d) WHERE d <> 0),
        y AS (SELECT x.doc_id, x.r, x.d, b.i, row_number() OVER (PARTITION BY x.doc_id, x.r, x.d > 0 ORDER BY abs(x.d)) AS q
              FROM x JOIN f b ON b.doc_id = x.doc_id AND b.r = x.r + x.d JOIN f a ON a.doc_id = x.od AND a.r = x.og + x.d
              WHERE a.t = b.t AND b.n < 40),
        gone AS (SELECT doc_id, i FROM y WHERE q = abs(d) UNION SELECT m.doc_id, f.i FROM m JOIN f ON f.doc_id = m.doc_id AND f.r = m.r)
        SELECT d.doc_id, coalesce(x.text, CASE WHEN d.text IS NOT NULL THEN '' END) AS text,
               CAST(coalesce(x.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(x.g, 0) AS BIGINT) AS n_removed
        FROM documents d LEFT JOIN (
            SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text,
                   count(*) AS n, count(g.i) AS g
            FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id) x USING (doc_id)""",
}
