"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storylake.llm.decontamination import contamination
from storylake.llm.exact_dedup import exact_dedup
from storylake.llm.html_density import page_texts
from storylake.llm.importance import resample
from storylake.llm.language_id import identify
from storylake.llm.licence_scan import TEMPLATES, THRESHOLD, scan
from storylake.llm.near_dedup import near_duplicates
from storylake.llm.pii import pii_digest
from storylake.llm.quality_crf import quality
from storylake.llm.suffix_dedup import repeats_digest
from storylake.llm.unigram import load_model, tokenize
from storylake.llm.warc import round_trip
from storylake.llm.yinyang import cluster_digest

#: A public SentencePiece model; a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near-duplicates of every whole document."""
    return near_duplicates(_read(spark, folder, "documents"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every whole document."""
    return pii_digest(_read(spark, folder, "documents"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole document, learned from those that are not held out."""
    return identify(_read(spark, folder, "documents"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of every whole document and the row that stays."""
    return exact_dedup(_read(spark, folder, "documents"))


def op5_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every whole document, learned from labels that are not held out."""
    return quality(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op6_html_density(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every whole page."""
    return page_texts(_read(spark, folder, "pages"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every whole document."""
    return contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark")).drop("items")


def op8_unigram(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every whole document, and whether they decode to it."""
    return tokenize(_read(spark, folder, "documents"), load_model(PIECES))


def op9_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every whole document that no earlier place repeats."""
    return repeats_digest(_read(spark, folder, "documents"))


def op10_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of every whole document; its source and language are its directory."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    found = scan(_read(spark, folder, "documents").withColumn("path", path), id_col="doc_id")
    return found.withColumnRenamed("file_id", "doc_id")


def op11_yinyang(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every vector of 64 finite components."""
    return cluster_digest(_read(spark, folder, "embeddings"), k=40, rounds=5, dims=64, scale=256, salt="2")


def op12_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, score and rank of every document in a draw towards the benchmark's texts."""
    return resample(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"), percent=25, least_words=20, salt="7")


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Record of every page, as read back from the archives written of them."""
    return round_trip(_read(spark, folder, "pages"), least=0).drop("intact")


QUERIES = {
    "op1_dart_minhash": op1_dart_minhash,
    "op2_pii": op2_pii,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_crf": op5_quality_crf,
    "op6_html_density": op6_html_density,
    "op7_decontamination": op7_decontamination,
    "op8_unigram": op8_unigram,
    "op9_suffix_array": op9_suffix_array,
    "op10_licence_scan": op10_licence_scan,
    "op11_yinyang": op11_yinyang,
    "op12_importance": op12_importance,
    "op13_warc": op13_warc,
}

#: ASCII lower-casing in DuckDB: its own lower() also changes other letters.
ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEMPLATE_VALUES = ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(TEMPLATES))

#: Rounds of nearest centroids and floored means: ``c0`` are the first centroids, ``a0 .. a5`` the vectors with their nearest.
_ROUNDS = ",\n".join(
    f"""        a{n} AS MATERIALIZED (SELECT rid, arg_min(c, d * 100 + c) AS c, min(d) AS d
                FROM (SELECT v.rid, c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN c{n} m USING (i) GROUP BY v.rid, c) GROUP BY rid),
        c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, o.x) AS x
                FROM c{n} o LEFT JOIN (SELECT c, i, sum(x) AS s, count(*) AS n FROM v JOIN a{n} USING (rid) GROUP BY c, i) USING (c, i))"""
    for n in range(6)
)

ORACLES = {
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {ASCII_LOWER} AS norm FROM documents),
        h AS (SELECT doc_id, norm, sha256(norm) AS text_sha256 FROM d)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, text_sha256
        FROM h""",
    "op7_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
               FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
        m AS (SELECT doc_id, p, n, item_id FROM dw JOIN bw USING (n, k)),
        h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM m) GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op10_licence_scan": f"""
        WITH RECURSIVE tpl(template_no, licence, text) AS (VALUES {_TEMPLATE_VALUES}),
        tt AS (SELECT template_no, licence, term, count(*) AS tf
               FROM (SELECT template_no, licence, unnest(regexp_extract_all({ASCII_LOWER}, '[a-z0-9]+')) AS term FROM tpl) GROUP BY ALL),
        f AS (SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, {ASCII_LOWER} AS norm FROM documents),
        l AS (SELECT doc_id, unnest(range(1, len(string_split(norm, chr(10))) + 1)) AS block, unnest(string_split(norm, chr(10))) AS line FROM f),
        b AS (SELECT doc_id, block, regexp_extract_all(line, '[a-z0-9]+') AS terms FROM l
              UNION ALL SELECT doc_id, 0, regexp_extract_all(norm, '[a-z0-9]+') FROM f),
        n AS (SELECT count(*) AS n FROM b WHERE block > 0 AND len(terms) > 0),
        o AS (SELECT doc_id, block, term, count(*) AS tf FROM (SELECT doc_id, block, unnest(terms) AS term FROM b) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM o WHERE block > 0 AND term IN (SELECT term FROM tt) GROUP BY term),
        w AS (SELECT template_no, licence, term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf, tf FROM tt LEFT JOIN df USING (term), n),
        v AS (SELECT *, tf * idf AS weight, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template_no)) AS norm FROM w),
        u AS (SELECT DISTINCT term, idf FROM w),
        k AS (SELECT doc_id, block, term, o.tf, idf, (SELECT max(idf) FROM w) AS top FROM o LEFT JOIN u USING (term)),
        len AS (SELECT doc_id, block, sqrt(sum(CASE WHEN idf IS NULL THEN tf * top * top ELSE tf * idf * tf * idf END)) AS length FROM k GROUP BY ALL),
        dot AS (SELECT doc_id, block, template_no, licence, norm, sum(k.tf * k.idf * weight) AS dot FROM k JOIN v USING (term) GROUP BY ALL),
        s AS (SELECT doc_id, block, template_no, licence, round(dot / (length * norm), 6) AS score FROM dot JOIN len USING (doc_id, block)),
        m AS (SELECT * FROM s WHERE score >= {THRESHOLD}),
        h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template_no, block) AS r FROM m WHERE block > 0),
        wh AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template_no) AS r FROM m WHERE block = 0),
        own AS (SELECT doc_id, 'header' AS origin, licence, score, block FROM h WHERE r = 1
                UNION ALL SELECT doc_id, 'file', licence, score, block FROM wh WHERE r = 1 AND doc_id NOT IN (SELECT doc_id FROM h)),
        d AS (SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f),
        dirs AS (SELECT dir AS above, licence, score FROM (SELECT dir, licence, score, row_number() OVER (PARTITION BY dir ORDER BY score DESC, template_no) AS r
                 FROM d JOIN wh USING (doc_id) WHERE wh.r = 1) WHERE r = 1),
        near AS (SELECT dir, above, licence, score, row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) AS r
                 FROM (SELECT DISTINCT dir FROM d) x JOIN dirs ON x.dir = above OR above = '' OR starts_with(x.dir, above || '/'))
        SELECT doc_id, path, coalesce(own.licence, near.licence) AS licence,
               coalesce(origin, CASE WHEN above IS NOT NULL THEN 'inherited' ELSE 'none' END) AS origin,
               coalesce(own.score, near.score) AS score, CAST(CASE WHEN origin = 'header' THEN block ELSE 0 END AS BIGINT) AS line,
               CASE WHEN origin IS NULL THEN above END AS source_dir
        FROM d LEFT JOIN own USING (doc_id) LEFT JOIN (SELECT * FROM near WHERE r = 1) near USING (dir)""",
    "op11_yinyang": f"""
        WITH k AS (SELECT row_number() OVER () AS rid, vec_id, embedding AS e FROM embeddings
                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        v AS MATERIALIZED (SELECT rid, i, CAST(floor(256 * CAST(e[i] AS DOUBLE)) AS HUGEINT) AS x FROM (SELECT rid, e, unnest(range(1, 65)) AS i FROM k)),
        f AS (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, rid) - 1 AS c FROM k QUALIFY c < 40),
        c0 AS MATERIALIZED (SELECT c, i, x FROM v JOIN f USING (rid)),
{_ROUNDS},
        s AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sha FROM c5 GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
        FROM k JOIN a5 USING (rid) JOIN s USING (c)""",
    "op12_importance": f"""
        WITH RECURSIVE steps(n, k, v) AS (  -- the CRC-32 of a single byte, by eight steps of its polynomial
            SELECT n, 0, n FROM range(256) t(n)
            UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
        tab AS (SELECT list(v ORDER BY n) AS tab FROM steps WHERE k = 8),
        texts AS (SELECT 'd' AS side, doc_id AS id, {ASCII_LOWER} AS norm FROM documents UNION ALL SELECT 'b', item_id, {ASCII_LOWER} FROM benchmark),
        w AS (SELECT side, id, regexp_extract_all(norm, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
        g AS (SELECT side, id, unnest(w) AS gram FROM w
              UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
        hashed AS (SELECT gram, xor(list_reduce(list_transform(range(0, octet_length(encode(gram))), lambda i: CAST('0x' || substr(hex(encode(gram)), 2 * i + 1, 2) AS BIGINT)),
                   lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
                   FROM (SELECT DISTINCT gram FROM g), tab),
        f AS (SELECT side, id, bucket, count(*) AS n FROM g JOIN hashed USING (gram) GROUP BY ALL),
        b AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM f GROUP BY bucket),
        a AS (SELECT sum(s) AS s_all, coalesce(sum(t), 0) AS t_all FROM b),
        gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)
                 / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS HUGEINT) AS gain FROM b, a),
        per AS (SELECT id, sum(n) AS n, sum(n * gain) AS s FROM f JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
        d AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce((s - ((s % n) + n) % n) // n, 0) AS BIGINT) AS weight,
              CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN per ON id = doc_id),
        r AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d),
        k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_features >= 39)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM r LEFT JOIN k USING (doc_id)""",
    "op13_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, html, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
        b AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT)) AS fives FROM h)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
               array_to_string(flatten(list_transform(fives, lambda v: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> s) % 32 + 1, 1)))), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM b""",
}
