"""Queries of writing and reading back, of the player, of requests and of streams with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from storylake.functions import text as tx
from storylake.operators import chunks, config, corpus, extraction, library, player, reports, scripts, tracking, volumes
from storylake.sources import library as files
from storylake.sources import settings as source
from storylake.sources.shared import shared_path
from storylake.sources.tables import table
from storylake.streaming import progress, stateful


def _chapters(spark, folder):
    """Conversations as stories of two sources; every turn is a chapter, in volumes of two."""
    turns = table(spark, folder, "conversations").select(F.concat(F.lit("src"), (F.col("conv_id") % 2).cast("string")).alias("source"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("slug"), F.col("turn").cast("int").alias("index"), F.concat(F.lit("«"), F.col("role"), F.lit("»")).alias("title"), F.split("text", "\n").alias("paragraphs"))
    return volumes.batched(turns, ["source", "slug"], "index", 2)


def volumes_round_trip(spark, folder):
    """Volumes written as files under their names and read as a library."""
    path = shared_path(spark, "volumes")
    files.write_volumes(_chapters(spark, folder), path)
    read = files.open_library(spark, path).chapters()
    return read.select("source", "slug", F.col("vol_file").alias("file_name"), F.col("volume").cast("long").alias("volume"), "index", "title", F.md5(F.array_join("paragraphs", "\n")).alias("text_md5"))


def index_round_trip(spark, folder):
    """Index of every story written as a file with a JSON array and read as a library."""
    path = shared_path(spark, "index")
    files.write_index(_chapters(spark, folder), path)
    return files.open_library(spark, path).index()


def _titles(spark, folder):
    return _chapters(spark, folder).select("source", "slug", F.when(F.col("slug").rlike("[02468]$"), F.upper("slug")).alias("story_title")).distinct()


def copied_library(spark, folder):
    """Titles of stories written where there are any, and copied over an older library."""
    path, target = shared_path(spark, "metadata"), shared_path(spark, "copy")
    files.write_metadata(_titles(spark, folder).withColumn("slug", F.concat("slug", F.lit("-old"))), target)
    files.write_metadata(_titles(spark, folder), path)
    files.copied(spark, path, target)
    return files.open_library(spark, target).metadata()


def library_stories(spark, folder):
    """Folders of a library by what they hold: long conversations have an index, some have a title, some both."""
    path = shared_path(spark, "library")
    files.write_index(_chapters(spark, folder).where("volume >= 2"), path)
    files.write_metadata(_titles(spark, folder), path)
    return files.open_library(spark, path).stories()


def library_rebuilt(spark, folder):
    """Index made anew from volumes of which later ones hold some chapters again: the last file and place win."""
    path, chapters = shared_path(spark, "library"), _chapters(spark, folder)
    again = chapters.where("index % 2 = 1").withColumns({"volume": F.col("volume") + 7, "title": F.concat(F.lit("again "), "title")})
    files.write_volumes(chapters, path)
    files.write_volumes(again, path)
    return files.open_library(spark, path).rebuilt_index()


def library_resolved(spark, folder):
    """Chapters of every story from the first of the sources that have it; every third story stands in a second one."""
    path, chapters = shared_path(spark, "library"), _chapters(spark, folder)
    other = chapters.where("cast(substring(slug, 2) as int) % 3 = 0").withColumns({"source": F.translate("source", "01", "10"), "title": F.concat(F.lit("other "), "title")})
    files.write_index(chapters.unionByName(other), path)
    opened = files.open_library(spark, path)
    return opened.resolved(opened.index())


def library_checkpoints(spark, folder):
    """Checkpoints written for all stories, then again for some, of which finished ones lose theirs."""
    path = shared_path(spark, "library")
    last = _chapters(spark, folder).groupBy("source", "slug").agg(F.max("index").alias("at"))
    points = last.select("source", "slug", F.concat(F.lit("/p"), F.col("at") + 1).alias("next_url"), (F.col("at") + 1).alias("next_index"), F.lit(None).cast("string").alias("story_title"))
    files.write_checkpoints(points, points.limit(0), path)
    newer = points.where("next_index % 2 = 0").withColumns({"next_index": F.col("next_index") + 10, "story_title": F.upper("slug")})
    files.write_checkpoints(newer, newer.where("next_index > 12"), path)
    return files.open_library(spark, path).progress().select("source", "slug", "next_url", "next_index", F.coalesce("story_title", F.lit("-")).alias("story_title"))


def _checkpoints(spark, folder):
    events = table(spark, folder, "events").select(F.col("user_id").alias("story"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("/p"), F.get_json_object("props", "$.k"))).alias("next_url"), (F.get_json_object("props", "$.k").try_cast("int") % 5).alias("next_index"))
    finished = events.where("story % 7 = 0").select("story")
    return files.upserted(events.where("seq % 2 = 0"), events.where("seq % 2 = 1"), finished, ["story"], "seq")


def checkpoint_upsert(spark, folder):
    """Checkpoints after all updates, finished stories being gone."""
    return _checkpoints(spark, folder).select("story", "seq", F.coalesce("next_url", F.lit("-")).alias("next_url"), F.coalesce("next_index", F.lit(-1)).alias("next_index"))


def checkpoint_resume(spark, folder):
    """Chapters left to read by the checkpoints, at most two a story."""
    stories = table(spark, folder, "events").select(F.col("user_id").alias("story")).distinct()
    chapters = stories.select("story", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("index"))
    return files.left_to_read(chapters, _checkpoints(spark, folder), ["story"], "index", 2)


def catalog_round_trip(spark, folder):
    """A catalog with quotes and commas written as CSV and read back by its header."""
    path = shared_path(spark, "catalog")
    rows = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("skill"), F.concat(F.lit('"'), F.col("p_name"), F.lit('", or so')).alias("about"), F.col("p_type").alias("kind"))
    source.write_catalog(rows, path)
    return source.read_catalog(spark, path, ["skill", "about", "kind"]).select("skill", "about", "kind")


def csv_round_trip(spark, folder):
    """Whole texts with their line ends and quotes written as CSV records of two or three cells and read back in splits."""
    path = shared_path(spark, "records")
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit('"'), F.coalesce("text", F.lit("")), F.lit(',\n"')).alias("text"), "lang")
    source.write_records(docs, path, F.concat(F.array("id", "text"), F.when(F.length("text") % 2 == 0, F.array("lang")).otherwise(F.array().cast("array<string>"))))
    cells = F.col("cells")
    return source.read_records(spark, path).select(cells[0].cast("long").alias("doc_id"), F.size(cells).alias("n_cells"), F.md5(cells[1]).alias("text_md5"), F.coalesce(F.try_element_at(cells, F.lit(3)), F.lit("-")).alias("lang"))


def settings_round_trip(spark, folder):
    """Settings of eight suppliers a file, written as text with a comment and read back."""
    path = shared_path(spark, "settings")
    key = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").select(F.floor(key / 8).cast("string").alias("scope"), key.alias("ord"), F.concat(F.lit("k"), key.cast("string")).alias("key"), F.concat(F.col("s_name"), F.lit(" é: x")).alias("value"))
    source.write_settings(rows, path, "written\nby a job")
    return source.read_settings(spark, path).select("scope", F.explode("settings").alias("key", "value"))


def report_round_trip(spark, folder):
    """Reports of long lines written as JSON and read back."""
    path = shared_path(spark, "reports")
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    found = docs.where("length(line) > 300").select("doc_id", (F.col("at") + 1).alias("line_no"), F.when(F.length("line") > 800, "high").otherwise("low").alias("severity"), F.lit("long-line").alias("category"))
    reports.write_reports(found, "doc_id", path)
    return reports.read_reports(spark, path).select("name", "finding_count", F.size(F.filter("findings", lambda f: f["severity"] == "high")).alias("n_high"), F.col("findings")[0]["line_no"].alias("first_line"))


def local_progress(spark, folder):
    """Progress kept as JSON text, some of it spoiled: what can't be read is none."""
    text = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return table(spark, folder, "events").select("event_id", F.coalesce(F.from_json(text, "k int")["k"], F.lit(-1)).alias("k"))


def request_bodies(spark, folder):
    """Texts and rate of requests made of every turn: a text, lists with blanks and other values, values of the wrong type, or nothing."""
    quoted = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    bodies = (
        F.to_json(F.struct(F.concat(F.lit("  "), F.col("text"), F.lit(" ")).alias("text"), F.lit(1.5).alias("rate"))), F.to_json(F.struct(F.array(F.col("role"), F.lit(" "), F.col("text")).alias("paragraphs"), F.lit("fast").alias("rate"))),
        F.lit('{"text": 7, "rate": "1.5"}'), F.concat(F.lit('{"paragraphs": [3, '), quoted, F.lit(', null, true, ["x"]], "rate": 2}')), F.lit("{broken"), F.concat(F.lit('{"paragraphs": {"a": 1}, "rate": true, "text": '), quoted, F.lit("}")),
    )
    body = F.element_at(F.array(*bodies), (F.col("turn") % 6 + 1).cast("int"))
    found = table(spark, folder, "conversations").select("conv_id", "turn", config.request_fields(body).alias("r"))
    return found.select("conv_id", "turn", F.size(F.coalesce("r.texts", F.array().cast("array<string>"))).alias("n"), F.md5(F.coalesce(F.array_join("r.texts", "|"), F.lit(""))).alias("texts_md5"), F.coalesce("r.rate", F.lit(1.0)).alias("rate"))


def input_files(spark, folder):
    """Text files of a tree made of documents, some listed twice, some under folders that are skipped."""
    place = F.element_at(F.array(*map(F.lit, ("docs", "node_modules/x", "a/.git", "venv2", "b/__pycache__/c"))), (F.col("doc_id") % 5 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".md", ".TXT", ".py", ".tar.json", "", ".yml/x"))), (F.col("doc_id") % 6 + 1).cast("int"))
    files = table(spark, folder, "documents").select(F.concat_ws("/", "source", place, F.concat(F.lit("f"), F.floor(F.col("doc_id") / 2).cast("string"), ending)).alias("path"), "lang")
    return corpus.resolve(files.select("path").unionByName(files.where("lang = 'en'").select("path")))


def story_keys(spark, folder):
    """Keys of stories whose titles are the texts of turns."""
    title = F.concat(F.lit("Story "), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit(": "), F.col("text"))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.md5(tracking.story_key(title)).alias("key_md5"))


def route_params(spark, folder):
    """Chapter numbers of addresses as a browser parses them."""
    text = F.element_at(F.array(F.col("o_orderkey").cast("string"), F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit("abc")), F.lit("abc"), F.concat(F.lit("-"), F.col("o_custkey").cast("string")), F.lit("")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", F.coalesce(config.parsed_int(text), F.lit(-999_999)).alias("index"))


def player_targets(spark, folder):
    """Rates, jumps and what is fetched ahead and held at every turn of every conversation, turns standing for chunks."""
    turns = table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("total"))
    at = turns.select("conv_id", "total", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("chunk"))
    elapsed = F.pmod(F.col("conv_id") + F.col("chunk"), F.lit(7))
    chunk, total = F.col("chunk"), F.col("total")
    held = F.size(F.filter(F.sequence(F.lit(0), total - 1), lambda k: player.still_held(k, chunk)))
    return at.select("conv_id", "chunk", player.rate(chunk).alias("rate"), player.back_target(chunk, elapsed).cast("int").alias("back"), player.forward_target(chunk, total).cast("int").alias("onward"), F.array_join(player.fetched_ahead(chunk, total), ",").alias("ahead"), held.alias("held"))


def active_paragraphs(spark, folder):
    """Paragraphs with text that some chunk's range covers, a document."""
    told = lambda p: F.filter(F.transform(p, lambda x, i: F.when(tx.strip_white(x) != "", i)), lambda i: i.isNotNull())
    covered = lambda p: tx.bound(chunks.ranges(p), lambda found: F.size(F.filter(told(p), lambda i: F.exists(found, lambda c: player.is_active(i, c)))))
    return table(spark, folder, "documents").select("doc_id", tx.bound(F.split("text", "\n"), covered).alias("n_active"))


def chapter_lines(spark, folder):
    """Lines of documents with a heading before and site noise around them, both taken off."""
    around = F.concat_ws("\n", F.when(F.col("doc_id") % 2 == 0, "Chương 12: x"), F.lit("Người đăng: ai"), F.lit("Bạn đang đọc truyện"), F.when(F.col("doc_id") % 9 > 0, F.col("text")), F.lit("nguồn: site.com"), F.when(F.col("doc_id") % 3 == 0, "x.net"))
    found = table(spark, folder, "documents").select("doc_id", extraction.trimmed(extraction.headless(tx.paragraphs(around))).alias("l"))
    return found.select("doc_id", F.size("l").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("text_md5"))


def audio_in_order(spark, folder):
    """Turns of every conversation put together in order after work in parallel; a failed one fails all."""
    parts = table(spark, folder, "conversations").repartition(3, "turn").select("conv_id", "turn", F.when((F.col("conv_id") % 10 > 0) | (F.col("turn") != 1), F.col("text")).alias("text"))
    return player.in_order(parts, "conv_id", "turn", "text").select("conv_id", F.coalesce(F.md5("joined"), F.lit("-")).alias("joined_md5"))


def iso_stamps(spark, folder):
    """Times of events as text and as days."""
    return table(spark, folder, "events").select("event_id", *(c.alias(n) for n, c in reports.stamps(F.col("ts")).items()))


def stale_orders(spark, folder):
    """Orders whose last update, or else their date, is older than a week before a fixed day."""
    updated = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS"))
    return table(spark, folder, "orders").select("o_orderkey", reports.stale(updated, F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp_ntz")).alias("is_stale"))


def report_prompts(spark, folder):
    """Numbered prompts from the lines of every order as findings, with a place where both parts are known."""
    f = F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("title"), F.when(F.col("l_linenumber") % 3 == 0, "issue").alias("issue"), F.col("l_linestatus").alias("message"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("f"), F.col("l_partkey").cast("string"))).alias("file"), F.when(F.col("l_linenumber") < 4, F.col("l_linenumber").cast("int")).alias("line"), F.lit("low").alias("severity"))
    listed = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", f.alias("f")))).alias("l"))
    return listed.select("l_orderkey", reports.prompt(F.transform("l", lambda x: x["f"])).alias("prompt"))


def sorted_listings(spark, folder):
    """Names of each brand's parts in order."""
    return reports.listing(table(spark, folder, "part"), "p_brand", "p_name", 12)


def source_literals(spark, folder):
    """Values that scripts made of suppliers set."""
    text = F.concat(F.lit('X = 1\nSKILL_NAME = "'), F.col("s_name"), F.lit('"\nTEMPLATE_FILES = [\n  "a.md",\n  \''), F.col("s_suppkey").cast("string"), F.lit("-b.md',\n]\n"), F.when(F.col("s_suppkey") % 2 == 0, 'SKILL_ONLY_FILES = {"c.md"}\n').otherwise(""), F.when(F.col("s_suppkey") % 3 == 0, "EVOLVABLE = False\n").when(F.col("s_suppkey") % 3 == 1, "EVOLVABLE = True\n").otherwise(""))
    found = scripts.literals(text)
    return table(spark, folder, "supplier").select("s_suppkey", found["skill_name"].alias("skill_name"), F.array_join(found["templates"], ",").alias("templates"), F.size(found["skipped"]).alias("n_skipped"), F.coalesce(found["evolvable"].cast("string"), F.lit("-")).alias("evolvable"))


def _reads(spark, folder, slices=4):
    """Events as a stream in the order of time, a slice of it a micro-batch; every kind of event is a cache, users and numbers make names."""
    number = (F.get_json_object("props", "$.k").try_cast("int") % 10).cast("string")
    events = table(spark, folder, "events").select("ts", "event_id", F.col("event_type").alias("cache"), F.concat_ws(":", (F.col("user_id") % 40).cast("string"), number).alias("name"), F.concat_ws(":", "event_type", number).alias("key"))
    return progress.in_order(events, "ts", slices, shared_path(spark, "events"))


def stream_ttl_cache(spark, folder):
    """Hits and misses of entries that live half an hour, each by itself, read as a stream."""
    alone = _reads(spark, folder).withColumns({"cache": F.col("key"), "name": F.col("key")})
    reads = progress.drained(stateful.cache_reads(alone, 30, 0), "append")
    return reads.groupBy(F.col("cache").alias("key")).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def stream_audio_cache(spark, folder):
    """Hits of caches whose entries live five days and of which 200 at most are kept, the oldest insertions going first."""
    reads = progress.drained(stateful.cache_reads(_reads(spark, folder), 5 * 24 * 60, 200), "append")
    return reads.groupBy("cache").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("event_id"))), F.lit(0)).alias("hit_ids"))


def stream_batches(spark, folder):
    """Batches of fifty events of every key, read as a stream."""
    numbered = progress.drained(stateful.numbered_batches(_reads(spark, folder), 50), "append")
    return numbered.groupBy("key", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


class _Killed(RuntimeError):
    """Stands for the loss of a driver."""


def stream_resumed(spark, folder):
    """The same batches of a run that was lost after a write and before its commit, and taken up from its checkpoint."""
    stream = stateful.numbered_batches(_reads(spark, folder), 50)
    kept = progress.Resumable(spark, shared_path(spark, "resumed"))

    def dying(batch, number):
        kept.write(batch, number)
        if number == 1:
            raise _Killed("lost")

    try:
        kept.run(stream, "append", dying)
    except Exception as error:
        if "lost" not in str(error):
            raise
    kept.run(stream)
    return kept.rows(stream.schema).groupBy("key", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def volume_metadata(spark, folder):
    """Titles of stories as they stand, a story's name standing in for one without."""
    stories = _chapters(spark, folder).select("slug").distinct()
    return stories.select("slug", library.title_or(F.when(F.col("slug").rlike("[05]$"), F.lit("")).otherwise(F.upper("slug")), F.col("slug")).alias("title"))


QUERIES = {
    f.__name__: f
    for f in (
        volumes_round_trip, index_round_trip, copied_library, library_stories, library_rebuilt, library_resolved, library_checkpoints, checkpoint_upsert, checkpoint_resume, catalog_round_trip, csv_round_trip, settings_round_trip, report_round_trip, local_progress, request_bodies, input_files, story_keys, route_params,
        player_targets, active_paragraphs, chapter_lines, audio_in_order, iso_stamps, stale_orders, report_prompts, sorted_listings, source_literals, stream_ttl_cache, stream_audio_cache, stream_batches, stream_resumed, volume_metadata,
    )
}

_WS = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CHAPTERS = """ch AS (SELECT 'src' || conv_id % 2 AS source, 'c' || conv_id AS slug, CAST(turn AS INTEGER) AS index, '«' || role || '»' AS title, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 + 1 AS volume FROM conversations)"""
_POINTS = """e AS (SELECT user_id AS story, event_id AS seq, CASE WHEN event_id % 4 > 0 THEN '/p' || json_extract_string(props, '$.k') END AS next_url, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS next_index FROM events),
  cp AS (SELECT story, max(seq) AS seq, arg_max(coalesce(next_url, '-'), seq) AS next_url, arg_max(coalesce(next_index, -1), seq) AS next_index FROM e WHERE story % 7 <> 0 GROUP BY story)"""
_READS = "r AS (SELECT event_type || ':' || TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS key, ts, event_id FROM events)"

ORACLES = {
    "volumes_round_trip": f"""WITH {_CHAPTERS}, n AS (SELECT *, min(index) OVER (PARTITION BY slug, volume) + 1 AS a, max(index) OVER (PARTITION BY slug, volume) + 1 AS b FROM ch)
        SELECT source, slug, printf('vol-%03d-ch%03d-%03d.json', volume, a, b) AS file_name, volume, index, title, md5(text) AS text_md5 FROM n""",
    "index_round_trip": f"WITH {_CHAPTERS} SELECT source, slug, index, title FROM ch",
    "copied_library": "SELECT DISTINCT 'src' || conv_id % 2 AS source, 'c' || conv_id AS slug, 'C' || conv_id AS story_title FROM conversations WHERE conv_id % 2 = 0",
    "library_stories": f"""WITH {_CHAPTERS}, s AS (SELECT source, slug, max(volume) >= 2 AS has_index, CAST(substring(slug, 2) AS INT) % 2 = 0 AS has_metadata FROM ch GROUP BY ALL) SELECT * FROM s WHERE has_index OR has_metadata""",
    "library_rebuilt": f"WITH {_CHAPTERS} SELECT source, slug, index, CASE WHEN index % 2 = 1 THEN 'again ' ELSE '' END || title AS title FROM ch",
    "library_resolved": f"""WITH {_CHAPTERS}, a AS (SELECT source, slug, index, title FROM ch UNION ALL SELECT translate(source, '01', '10'), slug, index, 'other ' || title FROM ch WHERE CAST(substring(slug, 2) AS INT) % 3 = 0)
        SELECT * FROM a QUALIFY source = min(source) OVER (PARTITION BY slug)""",
    "library_checkpoints": f"""WITH {_CHAPTERS}, p AS (SELECT source, slug, max(index) + 1 AS n FROM ch GROUP BY ALL)
        SELECT source, slug, '/p' || n AS next_url, CAST(CASE WHEN n % 2 = 0 THEN n + 10 ELSE n END AS INTEGER) AS next_index, CASE WHEN n % 2 = 0 THEN upper(slug) ELSE '-' END AS story_title FROM p WHERE n % 2 = 1 OR n + 10 <= 12""",
    "checkpoint_upsert": f"WITH {_POINTS} SELECT * FROM cp",
    "checkpoint_resume": f"""WITH {_POINTS}, s AS (SELECT DISTINCT story FROM e), f AS (SELECT story, CASE WHEN coalesce(next_url, '-') <> '-' THEN greatest(next_index, 0) ELSE 0 END AS first FROM s LEFT JOIN cp USING (story))
        SELECT story, CAST(i AS INTEGER) AS index FROM f, (SELECT unnest(range(0, 6)) AS i) WHERE i >= first AND i < first + 2""",
    "catalog_round_trip": """SELECT CAST(p_partkey AS VARCHAR) AS skill, '"' || p_name || '", or so' AS about, p_type AS kind FROM part""",
    "csv_round_trip": """WITH d AS (SELECT doc_id, '"' || coalesce(text, '') || ',' || chr(10) || '"' AS text, lang FROM documents)
        SELECT doc_id, CAST(CASE WHEN length(text) % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS n_cells, md5(text) AS text_md5, CASE WHEN length(text) % 2 = 0 THEN coalesce(lang, '') ELSE '-' END AS lang FROM d""",
    "settings_round_trip": "SELECT CAST(s_suppkey // 8 AS VARCHAR) AS scope, 'k' || s_suppkey AS key, s_name || ' é: x' AS value FROM supplier",
    "report_round_trip": """WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)
        SELECT CAST(doc_id AS VARCHAR) AS name, CAST(count(*) AS INTEGER) AS finding_count, CAST(count(*) FILTER (WHERE length(line) > 800) AS INTEGER) AS n_high, CAST(min(line_no) AS INTEGER) AS first_line FROM l WHERE length(line) > 300 GROUP BY doc_id""",
    "local_progress": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) END AS k FROM events",
    "request_bodies": """WITH b AS (SELECT *, trim(text) AS t, turn % 6 AS k FROM conversations)
        SELECT conv_id, turn, CAST(CASE WHEN k IN (0, 3, 5) THEN (t <> '')::INT WHEN k = 1 THEN (trim(role) <> '')::INT + (t <> '')::INT ELSE 0 END AS INTEGER) AS n,
        md5(CASE WHEN k IN (0, 3, 5) THEN t WHEN k = 1 THEN trim(role) || '|' || t ELSE '' END) AS texts_md5, CASE k WHEN 0 THEN 1.5::DOUBLE WHEN 3 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS rate FROM b""",
    "input_files": """WITH f AS (SELECT source || '/' || (['docs', 'node_modules/x', 'a/.git', 'venv2', 'b/__pycache__/c'])[doc_id % 5 + 1] || '/f' || doc_id // 2 || (['.md', '.TXT', '.py', '.tar.json', '', '.yml/x'])[doc_id % 6 + 1] AS path FROM documents)
        SELECT DISTINCT path FROM f WHERE regexp_matches(lower(path), '[.](md|txt|yaml|yml|json)$') AND NOT list_has_any(string_split(path, '/')[:-2], ['node_modules', '.git', '__pycache__', '.venv', 'venv', '.claude', '.cursor', '.vscode'])""",
    "story_keys": """SELECT conv_id, turn, md5(regexp_replace(regexp_replace(lower(conv_id || '.' || turn || ': ' || text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS key_md5 FROM conversations""",
    "route_params": "SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN o_orderkey WHEN 1 THEN o_custkey WHEN 3 THEN -o_custkey ELSE -999999 END AS INTEGER) AS index FROM orders",
    "player_targets": """WITH t AS (SELECT conv_id, count(*) AS total FROM conversations GROUP BY conv_id), a AS (SELECT conv_id, total, unnest(range(0, total)) AS c FROM t)
        SELECT conv_id, CAST(c AS INTEGER) AS chunk, ([0.75, 1.0, 1.25, 1.5, 2.0])[c % 5 + 1]::DOUBLE AS rate, CAST(CASE WHEN (conv_id + c) % 7 > 3 THEN c ELSE greatest(c - 1, 0) END AS INTEGER) AS back, CAST(least(c + 1, total - 1) AS INTEGER) AS onward,
          coalesce(array_to_string(range(c + 1, least(c + 6, total)), ','), '') AS ahead, CAST(total - greatest(c - 1, 0) AS INTEGER) AS held FROM a""",
    "active_paragraphs": f"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_WS}+', '', 'g') <> '')) AS INTEGER) AS n_active FROM documents",
    "chapter_lines": f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN text ELSE '' END || chr(10) AS text FROM documents),
        p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS l FROM t),
        g AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: NOT regexp_matches(l[i], '{"|".join(extraction.NOISE)}')) AS good FROM p),
        k AS (SELECT doc_id, CASE WHEN len(good) = 0 THEN [] ELSE l[list_min(good):list_max(good)] END AS k FROM g)
        SELECT doc_id, CAST(len(k) AS INTEGER) AS n_lines, md5(coalesce(array_to_string(k, chr(10)), '')) AS text_md5 FROM k""",
    "audio_in_order": "SELECT conv_id, CASE WHEN conv_id % 10 = 0 AND bool_or(turn = 1) THEN '-' ELSE md5(string_agg(text, '' ORDER BY turn)) END AS joined_md5 FROM conversations GROUP BY conv_id",
    "iso_stamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "stale_orders": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 5 DAYS ELSE o_orderdate END < TIMESTAMP '1998-01-01' - INTERVAL 7 DAYS AS is_stale FROM orders",
    "report_prompts": """SELECT l_orderkey, string_agg(r || '. ' || title || place, chr(10) ORDER BY r) AS prompt FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r,
          CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag WHEN l_linenumber % 3 = 0 THEN 'issue' ELSE l_linestatus END AS title, CASE WHEN l_linenumber IN (2, 3) THEN ' (f' || l_partkey || ':' || l_linenumber || ')' ELSE '' END AS place FROM lineitem) GROUP BY l_orderkey""",
    "sorted_listings": "SELECT p_brand, count(*) AS n, string_agg(substring(p_name, 1, 12), ',' ORDER BY p_name) AS names FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY p_brand",
    "source_literals": "SELECT s_suppkey, s_name AS skill_name, 'a.md,' || s_suppkey || '-b.md' AS templates, CAST(s_suppkey % 2 = 0 AS INTEGER) AS n_skipped, CASE s_suppkey % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'true' ELSE '-' END AS evolvable FROM supplier",
    "stream_ttl_cache": f"""WITH RECURSIVE {_READS}, w(key, ts) AS (SELECT key, min(ts) FROM r GROUP BY key UNION ALL SELECT w.key, (SELECT min(r.ts) FROM r WHERE r.key = w.key AND r.ts >= w.ts + INTERVAL 30 MINUTES) FROM w WHERE w.ts IS NOT NULL),
        m AS (SELECT key, count(ts) AS misses FROM w GROUP BY key), n AS (SELECT key, count(*) AS n FROM r GROUP BY key) SELECT key, n - misses AS hits, misses FROM m JOIN n USING (key)""",
    "stream_audio_cache": """WITH e AS (SELECT event_type AS cache, concat_ws(':', user_id % 40, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) AS name, epoch_us(ts) AS us, event_id FROM events),
        l AS (SELECT cache, count(*) AS n, list({'name': name, 'us': us, 'id': event_id, 'names': []::VARCHAR[], 'ats': []::BIGINT[], 'hits': 0::BIGINT, 'ids': 0::BIGINT} ORDER BY us, event_id) AS l FROM e GROUP BY cache),
        -- a step: which entry is the one that is read, whether it is young enough; a miss drops an expired one, appends, and keeps the last 200
        f AS (SELECT cache, n, list_reduce(l, lambda s, e: CASE WHEN list_contains(s.names, e.name) AND s.ats[list_position(s.names, e.name)] + 432000000000 > e.us
            THEN {'name': e.name, 'us': e.us, 'id': e.id, 'names': s.names, 'ats': s.ats, 'hits': s.hits + 1, 'ids': s.ids + e.id}
            ELSE {'name': e.name, 'us': e.us, 'id': e.id,
                  'names': list_append(list_filter(s.names, lambda x, i: x <> e.name), e.name)[-200:], 'ats': list_append(list_filter(s.ats, lambda x, i: s.names[i] <> e.name), e.us)[-200:], 'hits': s.hits, 'ids': s.ids} END,
            {'name': '', 'us': 0::BIGINT, 'id': 0::BIGINT, 'names': []::VARCHAR[], 'ats': []::BIGINT[], 'hits': 0::BIGINT, 'ids': 0::BIGINT}) AS s FROM l)
        SELECT cache, n, s.hits AS hits, s.ids AS hit_ids FROM f""",
    "stream_resumed": f"WITH {_READS}, b AS (SELECT key, event_id, (row_number() OVER (PARTITION BY key ORDER BY ts, event_id) - 1) // 50 AS batch FROM r) SELECT key, batch, count(*) AS n, min(event_id) AS first_id FROM b GROUP BY ALL",
    "stream_batches": f"WITH {_READS}, b AS (SELECT key, event_id, (row_number() OVER (PARTITION BY key ORDER BY ts, event_id) - 1) // 50 AS batch FROM r) SELECT key, batch, count(*) AS n, min(event_id) AS first_id FROM b GROUP BY ALL",
    "volume_metadata": "SELECT DISTINCT 'c' || conv_id AS slug, CASE WHEN conv_id % 5 = 0 THEN 'c' || conv_id ELSE 'C' || conv_id END AS title FROM conversations",
}
