"""Queries of the corpus operators over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import op1_warc as op1
from . import op2_suffix_dedup as op2
from . import op3_mixing as op3
from . import op4_html as op4
from . import op5_language as op5
from . import op6_quality as op6
from . import op7_minhash as op7
from . import op8_toxicity as op8
from . import op9_ann as op9
from . import op10_decontaminate as op10
from . import op11_collocations as op11
from . import op12_secrets as op12
from . import op13_fill_in_middle as op13
from .common import table


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.captures(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "capture")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.digest(op2.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.digest(op3.mix(table(spark, sf_dir, "documents").select("doc_id", "source")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.extract(table(spark, sf_dir, "pages"))


def op5_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_quality_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.score(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op8_toxicity_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return op9.search(rows, rows.where("vec_id % 100 = 0"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.digest(op10.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.collocations(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.digest(op12.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.digest(op13.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    "op1_warc_index_merge": op1_warc_index_merge,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_pfair_mixing": op3_pfair_mixing,
    "op4_html_extraction": op4_html_extraction,
    "op5_language_fusion": op5_language_fusion,
    "op6_quality_weak_labels": op6_quality_weak_labels,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_toxicity_string_kernel": op8_toxicity_string_kernel,
    "op9_balanced_posting_lists": op9_balanced_posting_lists,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_secret_scan": op12_secret_scan,
    "op13_fill_in_middle": op13_fill_in_middle,
}


def _spans(order: int, rule: op12.Rule) -> str:
    """All matches of a rule with the text before each: a lazy group in front of the expression holds what was skipped."""
    fold = lambda p: re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", p)
    pattern = rule.pattern
    if rule.either_case:  # letters outside classes and escapes, each as a class: RE2 would fold letters beyond ASCII too
        pattern = "".join(p if p[0] in "[\\" else fold(p) for p in re.findall(r"\\x..|\[[^]]*\]|[^\[\\]+", pattern))
    pattern = pattern.replace("'", "''")
    every = lambda group: f"unnest(regexp_extract_all(x, '(?s)(.*?)({pattern})', {group}))"
    return f"SELECT t, '{rule.kind}' AS kind, {order} AS o, {rule.least} AS least, {every(1)} AS skipped, {every(2)} AS m, {every(2 + rule.group)} AS v, generate_subscripts(regexp_extract_all(x, '{pattern}'), 1) AS i FROM d WHERE regexp_matches(x, '{pattern}')"


ORACLE: dict[str, str] = {
    "op1_warc_index_merge": f"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, greatest(-{op1.EPOCH}, least({op1.LAST} - {op1.EPOCH}, page_id)) + {op1.EPOCH} AS ts FROM pages),
        k AS (SELECT *, octet_length(encode(h)) AS n, sha256(h) AS d, regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS r FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS m, regexp_replace(regexp_replace(lower(regexp_extract(r, '^[^/]*')), ':[0-9]+$', ''), '^www[.]', '') AS host,
              regexp_extract(r, '^[^/]*/(.*)$', 1) AS path FROM k)
        SELECT *, row_number() OVER (PARTITION BY urlkey ORDER BY ts, page_id) AS capture FROM (SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> m THEN m END AS refers_to,
               CASE WHEN r = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')/' || path END AS urlkey, ts FROM f)
    """,
    "op10_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT row_number() OVER () AS t, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        i AS (SELECT t, coalesce(CAST(item_id AS VARCHAR), '') AS item, p AS o, least(len(w), 13) AS n, array_to_string(w[p:p + 12], ' ') AS k FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(p) WHERE len(w) > 0),
        s AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM i) AS l, unnest(range(1, len(w) - n + 2)) AS u(p)),
        h AS (SELECT s.doc_id, s.p, s.n, i.t, i.o, i.item FROM s JOIN i ON s.n = i.n AND s.k = i.k),
        c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM h) AS x, unnest(range(p, p + n)) AS u(q) GROUP BY doc_id),
        g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) AS x GROUP BY doc_id),
        r AS (SELECT doc_id, t, p, n, o - p AS diagonal, p - row_number() OVER (PARTITION BY doc_id, t, o - p ORDER BY p) AS run FROM h),
        m AS (SELECT doc_id, max(k) AS longest_match, min(p - 1) FILTER (k = best) AS longest_at FROM (SELECT *, max(k) OVER (PARTITION BY doc_id) AS best FROM (SELECT doc_id, min(p) AS p, count(*) + max(n) - 1 AS k FROM r GROUP BY doc_id, t, diagonal, run) AS x) AS y GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest_match, 0) AS longest_match, longest_at
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
    "op11_phrase_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, (VALUES (1), (2), (3)) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(i)) AS x GROUP BY lang, k, phrase),
        c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
        s AS (SELECT c.lang, c.k, c.phrase, c.a, j, l.a AS l, r.a AS r, 1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a) AS score
              FROM c, unnest(range(1, c.k)) AS u(j) JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ') JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:c.k], ' ')),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        d AS (SELECT DISTINCT x.lang, x.phrase FROM c AS x JOIN (SELECT lang, a, k, w, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE k = 3) AS y ON x.lang = y.lang AND x.phrase = y.part WHERE x.k = 2 AND 100 * y.a >= 50 * x.a)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM b JOIN n ON n.lang = b.lang WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.phrase = b.phrase) QUALIFY rank <= 2000
    """,
    "op12_secret_scan": f"""
        WITH d AS (SELECT row_number() OVER () AS t, doc_id, coalesce(text, '') AS x FROM documents),
        m AS ({" UNION ALL ".join(_spans(i, r) for i, r in enumerate(op12.RULES))}),
        e AS (SELECT *, sum(length(skipped) + length(m)) OVER (PARTITION BY t, o ORDER BY i) AS stop FROM m),
        s AS (SELECT t, o, kind, stop - length(m) AS start, kind || ':' || (stop - length(m)) || ':' || stop AS span FROM e WHERE length(v) >= least),
        g AS (SELECT t, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex, string_agg(span, ',' ORDER BY start, o) FILTER (o < 3) AS base, string_agg(span, ',' ORDER BY start, o) AS spans FROM s GROUP BY t)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (t)
    """,
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        k AS (SELECT doc_id, x, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM d),
        c AS (SELECT doc_id, x, n, array_to_string(u[1:least(h[1] % (n + 1), h[2] % (n + 1))], '') AS a, array_to_string(u[least(h[1] % (n + 1), h[2] % (n + 1)) + 1:greatest(h[1] % (n + 1), h[2] % (n + 1))], '') AS b,
              array_to_string(u[greatest(h[1] % (n + 1), h[2] % (n + 1)) + 1:], '') AS c, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(x) AS restored_sha256 FROM c
    """,
}
