"""Queries of the story library over conversations, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storylake.functions import text as tx
from storylake.operators import cache, chunks, intervals, library, volumes
from storylake.sources.tables import table


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as chapters in volumes of three; odd stories were cut after their first chapter once."""
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("story"), F.col("turn").cast("int").alias("index"), F.col("role").alias("title"), F.split("text", "\n").alias("paragraphs"))
    return turns.withColumn("volume", F.floor((F.col("index") + F.when(F.col("story") % 2 == 1, 2).otherwise(0)) / 3 + 1).cast("int"))


def _progress(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("slug"), F.get_json_object("props", "$.k").try_cast("int").alias("chapter_idx"))


def index_rebuild_lww(spark, folder):
    """Last writer wins over documents that share source and size class."""
    docs = table(spark, folder, "documents").select("source", (F.col("n_chars") % 40).alias("index"), F.col("lang").alias("title"), F.col("doc_id").alias("volume"), F.lit(0).alias("position"))
    return volumes.last_written(docs, ["source", "index"], "volume", "position").select("source", "index", "title", "volume")


def _lookup(mode):
    def query(spark, folder):
        turns = _turns(spark, folder)
        found = library.lookup(turns.select("story", "index"), turns, turns.select("story", "index"), mode, 3)
        return found.select("story", "index", "title", F.when(F.col("paragraphs").isNull(), 0).otherwise(F.size("paragraphs")).alias("n_paragraphs"))

    query.__doc__ = f"Every chapter looked up in the {mode} way."
    return query


def story_cards(spark, folder):
    """Sources as stories with count and title; some titles are missing or empty."""
    docs = table(spark, folder, "documents").select(F.col("source").alias("story"), "lang", "doc_id")
    metadata = docs.where("story <> 'src3'").groupBy("story").agg(F.when(F.col("story") == "src5", "").otherwise(F.min("lang")).alias("story_title"))
    return library.cards(docs.select("story").distinct(), docs, metadata)


def total_vs_count(spark, folder):
    """Counted chapters against last index plus one."""
    return library.totals(_turns(spark, folder).where("index <> 1").select("story", "index"))


def source_first_match(spark, folder):
    """Size classes as stories, the first source that has each."""
    listing = table(spark, folder, "documents").select((F.col("n_chars") % 97).alias("story"), "source", F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("source_ord"))
    return library.first_source(listing)


def chapter_search(spark, folder):
    """Parts searched by name or number."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("index"), F.col("p_name").alias("title"))
    return library.search(parts, " 12 ")


def progress_flags(spark, folder):
    """Read and current flags of ten chapters for every reader and story."""
    latest = library.latest_progress(_progress(spark, folder))
    chapters = latest.select("user_id", "slug").withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(90), F.lit(10))))
    return library.with_progress(chapters, latest, ["user_id", "slug"]).select("user_id", "slug", "index", "is_read", "is_current")


def continue_target(spark, folder):
    """Title at the reader's place, or one made of its number."""
    latest = library.latest_progress(_progress(spark, folder))
    index = table(spark, folder, "part").select(F.col("p_partkey").alias("chapter_idx"), F.when(F.col("p_partkey") % 10 == 0, "").when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("title"))
    made = F.concat(F.lit("Chương "), (F.col("chapter_idx") + 1).cast("string"))
    return latest.join(index, "chapter_idx", "left").select("user_id", "slug", library.title_or(F.col("title"), made).alias("target"))


def progress_percent(spark, folder):
    """Percentage at every turn, and the neighbours that exist."""
    turns = _turns(spark, folder)
    joined = turns.join(library.totals(turns).drop("n_chapters"), "story")
    before, after = library.neighbours(F.col("index"), F.col("total"))
    return joined.select("story", "index", library.percent(F.col("index"), F.col("total")).alias("pct"), before.alias("has_prev"), after.alias("has_next"))


def next_volume_no(spark, folder):
    """The next volume number of every conversation, some file names being odd."""
    turns = _turns(spark, folder)
    ranges = volumes.volume_ranges(turns, ["story"], "index")
    names = F.when(F.col("volume") % 3 == 0, F.lit("notes-x.json")).otherwise(F.col("file_name"))
    return volumes.next_volume(ranges.withColumn("file_name", names), ["story"])


def paragraph_explode(spark, folder):
    """Paragraphs of all documents with their place."""
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(tx.paragraphs(F.col("text"))).alias("para_idx", "text"))
    return docs.select("doc_id", "para_idx", F.md5("text").alias("text_md5"))


def sentences(spark, folder):
    """Sentences of all documents, counted and digested."""
    docs = table(spark, folder, "documents").select("doc_id", F.explode(tx.sentences(tx.single_spaced(F.col("text")))).alias("s"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"), F.max(F.md5("s")).alias("max_md5"))


def tts_chunks(spark, folder):
    """Speech-sized chunks of all documents."""
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(chunks.chunks(F.split("text", "\n"))).alias("chunk_idx", "c"))
    return docs.select("doc_id", "chunk_idx", F.col("c.text").alias("text"), F.col("c.start_idx").alias("start_idx"), F.col("c.end_idx").alias("end_idx"))


def chunk_for_paragraph(spark, folder):
    """Chunk of the third paragraph of every document."""
    found = table(spark, folder, "documents").select("doc_id", chunks.ranges(F.split("text", "\n")).alias("c"))
    return found.select("doc_id", chunks.chunk_of(F.col("c"), F.lit(2)).alias("chunk_idx"))


def chunks_of_paragraphs(spark, folder):
    """First chunk of every paragraph of every document, by a join of paragraphs with the ranges of chunks."""
    docs = table(spark, folder, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("p"))
    paragraphs = docs.select("doc_id", F.posexplode("p").alias("paragraph", "text")).drop("text")
    ranges = docs.select("doc_id", F.posexplode(chunks.ranges(F.col("p"))).alias("chunk_idx", "r")).select("doc_id", "chunk_idx", "r.start_idx", "r.end_idx")
    found = intervals.within(paragraphs, ranges, ["doc_id"], "paragraph", "start_idx", "end_idx").groupBy("doc_id", "paragraph").agg(F.min("chunk_idx").alias("chunk_idx"))
    return paragraphs.join(found, ["doc_id", "paragraph"], "left").select("doc_id", "paragraph", F.coalesce("chunk_idx", F.lit(-1)).alias("chunk_idx"))


def cache_key_escape(spark, folder):
    """Cache keys and escaped texts of every turn."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.element_at(F.array(*map(F.lit, (0.75, 1.0, 1.25, 1.5, 2.0))), (F.col("turn") % 5 + 1).cast("int")).alias("rate"), F.concat(F.lit("<a & 'b'> "), F.col("text")).alias("said"))
    return turns.select("conv_id", "turn", F.md5(cache.cache_key(F.col("rate"), F.col("said"))).alias("key_md5"), F.md5(tx.xml_escaped(F.col("said"))).alias("xml_md5"))


def _inserts(spark, folder):
    return _progress(spark, folder).select(F.concat_ws(":", "slug", F.col("chapter_idx").cast("string")).alias("key"), "ts", "event_id")


def audio_cache_retention(spark, folder):
    """The 200 keys that stay in the cache."""
    return cache.retained(_inserts(spark, folder), "key", "ts", "event_id")


def audio_cache_expiry(spark, folder):
    """Expiry of every key at the end of the last day but one hour."""
    inserts = _inserts(spark, folder)
    now = inserts.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("now"))
    return cache.expired(inserts, "key", "ts", now.scalar()).select("key", "expired")


def single_flight(spark, folder):
    """Computations and shared results by cache key, if one takes an hour."""
    flown = cache.single_flight(_inserts(spark, folder), "key", "ts", "event_id", 3600)
    return flown.groupBy("key").agg(F.count_if("computes").alias("computations"), F.count_if(~F.col("computes")).alias("shared"))


def static_routes(spark, folder):
    """All (story, chapter) routes, the index as text."""
    return _turns(spark, folder).select(F.col("story").cast("string").alias("slug"), F.col("index").cast("string").alias("chapter_idx"))


QUERIES = {
    "index_rebuild_lww": index_rebuild_lww, "chapter_lookup_robust": _lookup("robust"), "chapter_lookup_strict": _lookup("strict"), "story_cards": story_cards,
    "total_vs_count": total_vs_count, "source_first_match": source_first_match, "chapter_search": chapter_search, "progress_flags": progress_flags,
    "continue_target": continue_target, "progress_percent": progress_percent, "next_volume_no": next_volume_no, "paragraph_explode": paragraph_explode,
    "sentences": sentences, "tts_chunks": tts_chunks, "chunk_for_paragraph": chunk_for_paragraph, "chunks_of_paragraphs": chunks_of_paragraphs, "cache_key_escape": cache_key_escape,
    "audio_cache_retention": audio_cache_retention, "audio_cache_expiry": audio_cache_expiry, "single_flight": single_flight, "static_routes": static_routes,
}

_WS = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIP = f"^{_WS}+|{_WS}+$"
_TURNS = """turns AS (SELECT conv_id AS story, CAST(turn AS INTEGER) AS index, role AS title, string_split(text, chr(10)) AS paragraphs,
  CAST(floor((turn + CASE WHEN conv_id % 2 = 1 THEN 2 ELSE 0 END) / 3 + 1) AS INTEGER) AS volume FROM conversations)"""
_LATEST = """p AS (SELECT event_id, ts, user_id, event_type AS slug, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS chapter_idx FROM events),
  latest AS (SELECT user_id, slug, chapter_idx FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slug ORDER BY ts DESC, event_id DESC) AS r FROM p) WHERE r = 1)"""
_INSERTS = "ins AS (SELECT concat_ws(':', event_type, CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR)) AS key, ts, event_id FROM events)"

#: Chunks packed one sentence after another by a recursive query: ``c(doc_id, k, chunk, size)`` beside the sentences ``n``.
_PACKED = f"""p AS (SELECT doc_id, i - 1 AS p, regexp_replace(regexp_replace(string_split(text, chr(10))[i], '{_WS}+', ' ', 'g'), '{_STRIP}', '', 'g') AS t
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
  f AS (SELECT doc_id, p, t, list_filter(list_transform(regexp_extract_all(t, '[^.!?]+(?:[.!?]+["'')\\]]*|$)'), lambda x: regexp_replace(x, '{_STRIP}', '', 'g')), lambda x: x <> '') AS s FROM p WHERE t <> ''),
  g AS (SELECT doc_id, p, CASE WHEN len(s) > 0 THEN s ELSE [t] END AS s FROM f), u AS (SELECT doc_id, p, unnest(range(1, len(s) + 1)) AS j, unnest(s) AS s FROM g),
  n AS MATERIALIZED (SELECT doc_id, p, s, j = 1 AS opens, length(s) + len(regexp_extract_all(s, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY p, j) AS k FROM u),
  c(doc_id, k, chunk, size) AS (SELECT doc_id, k, 0, size FROM n WHERE k = 1
    UNION ALL SELECT n.doc_id, n.k, CASE WHEN full_ THEN chunk + 1 ELSE chunk END, CASE WHEN full_ THEN n.size ELSE total END
    FROM (SELECT c.doc_id, n.k, n.size, chunk, c.size + CASE WHEN opens THEN 2 ELSE 1 END + n.size AS total, total > {chunks.MAX_CHARS} AND c.size >= {chunks.MIN_CHARS} AS full_ FROM c JOIN n ON n.doc_id = c.doc_id AND n.k = c.k + 1) n),
  z AS (SELECT doc_id, chunk, k, p, CASE WHEN k = min(k) OVER (PARTITION BY doc_id, chunk) THEN s WHEN opens THEN chr(10) || chr(10) || s ELSE ' ' || s END AS s FROM n JOIN c USING (doc_id, k)),
  chunked AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_idx, string_agg(s, '' ORDER BY k) AS text, CAST(min(p) AS INTEGER) AS start_idx, CAST(max(p) AS INTEGER) AS end_idx FROM z GROUP BY doc_id, chunk)"""

ORACLES = {
    "tts_chunks": f"WITH RECURSIVE {_PACKED} SELECT * FROM chunked",
    "chunk_for_paragraph": f"WITH RECURSIVE {_PACKED} SELECT doc_id, CAST(coalesce(min(chunk_idx) FILTER (WHERE start_idx <= 2 AND end_idx >= 2), -1) AS INTEGER) AS chunk_idx FROM documents LEFT JOIN chunked USING (doc_id) GROUP BY doc_id",
    "chunks_of_paragraphs": f"""WITH RECURSIVE {_PACKED}, l AS (SELECT doc_id, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS paragraph FROM documents)
        SELECT l.doc_id, CAST(paragraph AS INTEGER) AS paragraph, CAST(coalesce(min(chunk_idx), -1) AS INTEGER) AS chunk_idx FROM l LEFT JOIN chunked c ON c.doc_id = l.doc_id AND paragraph BETWEEN start_idx AND end_idx GROUP BY ALL""",
    "index_rebuild_lww": "SELECT source, index, title, volume FROM (SELECT source, n_chars % 40 AS index, lang AS title, doc_id AS volume, row_number() OVER (PARTITION BY source, n_chars % 40 ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1",
    "chapter_lookup_robust": f"WITH {_TURNS} SELECT story, index, title, len(paragraphs) AS n_paragraphs FROM turns",
    "chapter_lookup_strict": f"""WITH {_TURNS}, pos AS (SELECT story, index, (row_number() OVER (PARTITION BY story ORDER BY index) - 1) // 3 + 1 AS volume FROM turns)
        SELECT pos.story, pos.index, t.title, coalesce(len(t.paragraphs), 0) AS n_paragraphs FROM pos LEFT JOIN turns t ON t.story = pos.story AND t.index = pos.index AND t.volume = pos.volume""",
    "story_cards": """WITH m AS (SELECT source, CASE WHEN source = 'src5' THEN '' ELSE min(lang) END AS story_title FROM documents WHERE source <> 'src3' GROUP BY source),
        c AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
        SELECT s.source AS story, coalesce(nullif(story_title, ''), s.source) AS title, coalesce(n, 0) AS n_chapters
        FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN c USING (source) LEFT JOIN m USING (source)""",
    "total_vs_count": "SELECT conv_id AS story, count(*) AS n_chapters, max(turn) + 1 AS total FROM conversations WHERE turn <> 1 GROUP BY conv_id",
    "source_first_match": "SELECT story, source FROM (SELECT DISTINCT n_chars % 97 AS story, source, row_number() OVER (PARTITION BY n_chars % 97 ORDER BY CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER)) AS r FROM documents) WHERE r = 1",
    "chapter_search": "SELECT p_partkey AS index, p_name AS title FROM part WHERE contains(lower(p_name), '12') OR contains(CAST(p_partkey + 1 AS VARCHAR), '12')",
    "progress_flags": f"WITH {_LATEST} SELECT user_id, slug, CAST(i.index AS INTEGER) AS index, coalesce(chapter_idx >= i.index, false) AS is_read, coalesce(chapter_idx = i.index, false) AS is_current FROM latest, (SELECT unnest(range(0, 91, 10)) AS index) i",
    "continue_target": f"""WITH {_LATEST} SELECT user_id, slug, coalesce(nullif(CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 3 > 0 THEN p_name END, ''), 'Chương ' || CAST(chapter_idx + 1 AS VARCHAR)) AS target
        FROM latest LEFT JOIN part ON p_partkey = chapter_idx""",
    "progress_percent": """WITH t AS (SELECT conv_id AS story, CAST(turn AS INTEGER) AS index, max(turn) OVER (PARTITION BY conv_id) + 1 AS total FROM conversations)
        SELECT story, index, CAST(floor(index / total * 100 + 0.5) AS INTEGER) AS pct, index > 0 AS has_prev, index < total - 1 AS has_next FROM t""",
    "next_volume_no": f"""WITH {_TURNS}, v AS (SELECT DISTINCT story, volume FROM turns)
        SELECT story, coalesce(max(CASE WHEN volume % 3 <> 0 THEN volume END), 0) + 1 AS next_volume FROM v GROUP BY story""",
    "paragraph_explode": f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_STRIP}', '', 'g')), lambda x: x <> '') AS ps FROM documents)
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS para_idx, md5(ps[i]) AS text_md5 FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)""",
    "sentences": f"""WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '{_STRIP}', '', 'g') AS t FROM documents),
        f AS (SELECT doc_id, t, list_filter(list_transform(regexp_extract_all(t, '[^.!?]+(?:[.!?]+["'')\\]]*|$)'), lambda x: regexp_replace(x, '{_STRIP}', '', 'g')), lambda x: x <> '') AS s FROM n),
        u AS (SELECT doc_id, unnest(CASE WHEN t = '' THEN [] WHEN len(s) > 0 THEN s ELSE [t] END) AS s FROM f)
        SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars, max(md5(s)) AS max_md5 FROM u GROUP BY doc_id""",
    "cache_key_escape": """WITH t AS (SELECT conv_id, turn, (['0.75', '1', '1.25', '1.5', '2'])[turn % 5 + 1] AS rate, '<a & ''b''> ' || text AS said FROM conversations)
        SELECT conv_id, turn, md5(rate || ':' || said) AS key_md5,
          md5(replace(replace(replace(replace(replace(said, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS xml_md5 FROM t""",
    "audio_cache_retention": f"WITH {_INSERTS}, f AS (SELECT key, ts, event_id, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS r FROM ins) SELECT key, ts AS first_ts FROM f WHERE r = 1 ORDER BY ts DESC, event_id DESC LIMIT 200",
    "audio_cache_expiry": f"WITH {_INSERTS} SELECT key, max(ts) + INTERVAL 30 MINUTES <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ins) AS expired FROM ins GROUP BY key",
    "single_flight": f"""WITH {_INSERTS}, g AS (SELECT key, coalesce(ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) >= INTERVAL 1 HOUR, true) AS computes FROM ins)
        SELECT key, count(*) FILTER (WHERE computes) AS computations, count(*) FILTER (WHERE NOT computes) AS shared FROM g GROUP BY key""",
    "static_routes": "SELECT CAST(conv_id AS VARCHAR) AS slug, CAST(turn AS VARCHAR) AS chapter_idx FROM conversations",
}
