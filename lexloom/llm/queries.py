"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster_vectors
from .decontaminate import contamination
from .language import identify
from .line_dedup import dedup_lines
from .lm_score import cross_entropy_difference
from .near_dup import near_duplicates
from .packing import pack
from .reputation import TWO_LABEL_SUFFIXES, UrlRule, judge_urls, url_host, url_path
from .rules import quality_rules
from .secret_scan import scan_secrets
from .site_quality import classify
from .substring_dedup import repeated_passages
from .whitening import whiten

#: Fixed rules of the url filter.
URL_RULES = [UrlRule("block", "com/en/"), UrlRule("allow", "example.com/en/7"), UrlRule("allow", "net/de/"), UrlRule("block", "example.net/de/8"), UrlRule("block", "org/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_document(path: Column) -> Column:
    """The document that a page shows: the number at the end of its path."""
    return F.regexp_extract(path, "/([0-9]{1,18})/?$", 1).try_cast("long")


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, good): good is of high quality and not toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are those of the pages that show a document, else its source; paths are the first segment of the url's
    path, else the language, which is what that segment says."""
    url = F.col("url")
    sites = table(spark, sf_dir, "pages").select(page_document(url_path(url)).alias("doc_id"), url_host(url).alias("host"), F.regexp_extract(url_path(url), "^/([^/]*)", 1).alias("path"))
    return classify(table(spark, sf_dir, "documents"), good_labels(spark, sf_dir), sites, host=F.col("source"), path=F.col("lang"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = identify(docs.select("doc_id", "text"), docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    url = F.col("url")
    shown = pages.select(url_host(url).alias("host"), page_document(url_path(url)).alias("doc_id"))
    outcomes = shown.join(good_labels(spark, sf_dir), "doc_id").select("host", "good")
    return judge_urls(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = good_labels(spark, sf_dir).where("good").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), target)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, places = pack(table(spark, sf_dir, "documents"), digests={"ids_crc32": F.crc32("ids")}, keep_ids=False)
    return places.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white, rows = whiten(table(spark, sf_dir, "embeddings"))
    n, error = (white.n, white.identity_error) if white else (0, None)
    explained = [float(v) / white.trace if white.trace else None for v in white.values] if white else []
    share = F.array(*(F.lit(v).cast("double") for v in explained))
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, placed = cluster_vectors(table(spark, sf_dir, "embeddings"))
    of = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))
    return placed.select(
        "vec_id", "cluster", "distance", of(clusters.inertia, "bigint").alias("cluster_inertia"), F.lit(sum(clusters.inertia)).cast("long").alias("inertia"),
        of([clusters.digest(i) for i in range(len(clusters.centroids))], "string").alias("centroid_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_classifier, op2_language_id, op3_minhash_near_dedup, op4_quality_rules, op5_url_filter, op6_lm_scoring, op7_decontamination, op8_line_dedup, op9_best_fit_packing, op10_substring_dedup, op11_secret_scan, op12_embedding_whitening, op13_centroid_clustering]
    return {f.__name__: f for f in found}


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_SUFFIXES = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)

ORACLE_SQL = {
    "op3_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
        both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, v FROM reach JOIN both_ways ON b = u),
        c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON d.doc_id = a LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op4_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
        twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
        rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
        m AS (
            SELECT doc_id, text, w, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
                coalesce(rep.n, 0) AS n_repeat_words
            FROM d LEFT JOIN rep USING (r)
        ),
        v AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > 3 * n_words
                OR 10 * n_dup_lines > 3 * len(string_split(text, chr(10)))
                OR 2 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))
                OR 3 * len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) > n_words AS rejected
            FROM m
        )
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
            CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
        FROM v""",
    "op8_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM d),
        k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        hot AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        j AS (SELECT k.doc_id, k.line, k.i, hot.key IS NOT NULL AND k.doc_id < hot.last AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
    "op5_url_filter": r"""
        WITH p AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ),
        h AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
        ),
        lab AS (SELECT h.host, CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0.0 END AS good FROM h JOIN labels ON TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})/?$', 1), '') AS BIGINT) = labels.doc_id),
        base AS (
            SELECT a.host, coalesce(n, 0.0) AS n, coalesce(s, 0.0) AS s,
                CASE WHEN two IN (""" + _SUFFIXES + r""") AND three <> '' THEN three WHEN two <> '' THEN two ELSE a.host END AS domain, CASE WHEN two IN (""" + _SUFFIXES + r""") THEN two ELSE regexp_extract(a.host, '([^.]*)$', 1) END AS suffix
            FROM (SELECT DISTINCT host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS two, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS three FROM h) a LEFT JOIN (SELECT host, CAST(count(*) AS DOUBLE) AS n, sum(good) AS s FROM lab GROUP BY host) b USING (host)
        ),
        g0 AS (SELECT (sum(s) + 1) / (sum(n) + 2) AS rate FROM base),
        s1 AS (SELECT suffix, sum(n) AS n, sum(s) AS s, any_value(rate) AS prior FROM base, g0 GROUP BY suffix),
        k1 AS (SELECT least(200, greatest(2, 1 / greatest(1e-6, (sum((s - n * prior) ** 2) - sum(n * prior * (1 - prior))) / sum(n * (n - 1) * prior * (1 - prior))) - 1)) AS k FROM s1 WHERE n > 0),
        m1 AS (SELECT suffix, (prior * k + s) / (n + k) AS mean FROM s1, k1),
        s2 AS (SELECT b.suffix, b.domain, sum(n) AS n, sum(s) AS s, any_value(mean) AS prior FROM base b JOIN m1 USING (suffix) GROUP BY b.suffix, b.domain),
        k2 AS (SELECT least(200, greatest(2, 1 / greatest(1e-6, (sum((s - n * prior) ** 2) - sum(n * prior * (1 - prior))) / sum(n * (n - 1) * prior * (1 - prior))) - 1)) AS k FROM s2 WHERE n > 0),
        m2 AS (SELECT suffix, domain, (prior * k + s) / (n + k) AS mean FROM s2, k2),
        s3 AS (SELECT b.host, n, s, mean AS prior FROM base b JOIN m2 USING (suffix, domain)),
        k3 AS (SELECT least(200, greatest(2, 1 / greatest(1e-6, (sum((s - n * prior) ** 2) - sum(n * prior * (1 - prior))) / sum(n * (n - 1) * prior * (1 - prior))) - 1)) AS k FROM s3 WHERE n > 0),
        m3 AS (SELECT host, (prior * k + s) / (n + k) AS mean, n, k FROM s3, k3),
        rated AS (SELECT host, least(1, mean + 1.645 * sqrt(mean * (1 - mean) / (n + k + 1))) AS upper FROM m3),
        r AS (SELECT * FROM (VALUES ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'), ('net', '/de/', 'net/de/', 'allow'), ('example.net', '/de/8', 'example.net/de/8', 'block'), ('org', '/es/', 'org/es/', 'block')) t(rhost, rpath, rule, verdict)),
        f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h JOIN r ON (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath) GROUP BY page_id)
        SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
        FROM h LEFT JOIN f USING (page_id) LEFT JOIN rated ON h.host = rated.host""",
}


def cluster_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The rounds of op13 as a chain of table expressions."""
    near = "SELECT r, arg_min(c, (d, c)) AS c FROM (SELECT x.r, m.c, sum((x.x - m.x) * (x.x - m.x)) AS d FROM x JOIN m{} m USING (i) GROUP BY x.r, m.c) GROUP BY r"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dims})""",
        f"x AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range({dims})) AS i FROM v)",
        f"first AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM v ORDER BY c LIMIT {k})",
        "m0 AS MATERIALIZED (SELECT c, i, x FROM x JOIN first USING (r))",
    ]
    for t in range(rounds):
        parts.append(f"a{t} AS MATERIALIZED ({near.format(t)})")
        parts.append(f"s{t} AS (SELECT c, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM x JOIN a{t} USING (r) GROUP BY c, i)")
        parts.append(f"m{t + 1} AS MATERIALIZED (SELECT m.c, m.i, CASE WHEN n IS NULL THEN m.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM m{t} m LEFT JOIN s{t} s ON m.c = s.c AND m.i = s.i)")
    parts += [
        f"a AS MATERIALIZED ({near.format(rounds)})",
        f"d AS MATERIALIZED (SELECT a.r, a.c, sum((x.x - m.x) * (x.x - m.x)) AS distance FROM a JOIN x ON a.r = x.r JOIN m{rounds} m ON a.c = m.c AND x.i = m.i GROUP BY a.r, a.c)",
        f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c)",
    ]
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(d.c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY d.c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM v JOIN d USING (r) JOIN h ON d.c = h.c"""


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | {"op13_centroid_clustering": cluster_sql()}
