"""The registered queries of this subpackage, each over the whole of its tables, and SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contamination_report
from .html import extract_pages
from .licenses import TEMPLATES, classes, default_templates, license_scan
from .line_dedup import line_report
from .near_dup import near_duplicates
from .packing import pack
from .quality import fit_quality, quality_report
from .substring import substring_report
from .token_output import token_output
from .warc import warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"), default_templates(spark))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_report(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_token_output, op3_decontaminate, op4_substring, op5_licenses, op6_html, op7_near_dup, op8_packing, op9_quality, op10_warc)}

_CLASSES = classes({len([w for w in re.split("[^a-z0-9]+", t.lower()) if w]): 1 for _, t in TEMPLATES})

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS x
            FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM iw),
        dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS x
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
        h AS (SELECT doc_id, n, s, item_id FROM dw JOIN iw USING (n, x)),
        hw AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM h) GROUP BY doc_id),
        hi AS (SELECT doc_id, count(*) AS c, sha256(string_agg(item, ',' ORDER BY item)) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hw.c, 0) AS n_hit, coalesce(hi.c, 0) AS n_items, coalesce(hi.x, sha256('')) AS items_sha256, hw.c IS NOT NULL AS contaminated
        FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op4_substring": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
        r AS (SELECT x FROM s GROUP BY x HAVING count(*) > 1),
        g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM s JOIN r USING (x)),
        k AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
        t AS (SELECT d.doc_id, p, w[p] AS word FROM d, unnest(generate_series(1, len(w))) AS u(p)),
        o AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM t ANTI JOIN g USING (doc_id, p) GROUP BY t.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id) LEFT JOIN o USING (doc_id)""",
    # every run of a template's shingles in every window of the template's length class, by exact comparison
    "op5_licenses": """
        WITH t(template_id, text) AS (VALUES """ + ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES) + """),
        tw AS (SELECT template_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM t),
        tc AS (SELECT template_id, w, least(len(w), 5) AS k, CAST(sizes.s AS BIGINT) AS s FROM tw JOIN (VALUES """
    + ", ".join(f"({n}, {s})" for n, s in _CLASSES.items())
    + """) sizes(n, s) ON len(w) = sizes.n),
        ts AS (SELECT template_id, k, s, list_distinct(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS x FROM tc),
        d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
        ds AS (SELECT doc_id, i, array_to_string(w[i : i + c.k - 1], ' ') AS x, c.k, len(w) AS n FROM d, (SELECT DISTINCT k FROM ts) c, unnest(generate_series(1, len(w) - c.k + 1)) AS u(i)),
        hit AS (SELECT ds.doc_id, ds.i, ds.n, ts.template_id, ts.s, ts.k, len(ts.x) AS n_shingles, ds.x FROM ds JOIN (SELECT *, unnest(x) AS y FROM ts) ts ON ds.x = ts.y AND ds.k = ts.k),
        win AS (SELECT doc_id, template_id, n_shingles, x, unnest(generate_series(0, (s + greatest(1, s // 4) - k) // greatest(1, s // 4) + 1)) AS back, i, s, k, greatest(1, s // 4) AS step FROM hit),
        inw AS (SELECT DISTINCT doc_id, template_id, n_shingles, x, ((i - 1) // step - back) * step + 1 AS q FROM win WHERE ((i - 1) // step - back) >= 0 AND i + k <= ((i - 1) // step - back) * step + 1 + s + step),
        best AS (SELECT doc_id, template_id, n_shingles, q, count(*) AS c FROM inw GROUP BY ALL HAVING count(*) >= 0.75 * n_shingles)
        SELECT doc_id, template_id, CAST(max(c) AS INT) AS n_shared, CAST(max(n_shingles) AS INT) AS n_shingles, round(max(c) / max(n_shingles), 6) AS containment FROM best GROUP BY doc_id, template_id""",
    "op7_near_dup": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS (SELECT p.a, p.b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c FROM s l JOIN s r USING (x) WHERE l.doc_id <> r.doc_id GROUP BY 1, 2) p
            JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)),
        reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, h, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
        c AS (SELECT page_id, payload_bytes, top, list_transform(range(8), lambda g: ('0x' || substring(x, CAST(g * 5 + 1 AS INT), 5))::BIGINT) AS five FROM d)
        SELECT page_id, payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((five[CAST(i // 4 + 1 AS INT)] >> CAST(15 - 5 * (i % 4) AS INT)) % 32 + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM c""",
}
