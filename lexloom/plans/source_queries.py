"""Queries of readers and writers: files in the formats that the readers take are written from whole test tables to the
scratch folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.plans.queries import TAGS, TOK, TURN, marked_tags, query, read, turn_tokens
from lexloom.scratch import Scratch
from lexloom.sources import readers, writers

FLAT = "regexp_replace({x}, '[\\r\\n\\t]+', ' ', 'g')"
#: Transcripts are dealt to this number of files.
FILES = 16


def flat(column: str):
    return F.regexp_replace(column, "[\r\n\t]+", " ")


TRANSCRIPT = f"""lines AS (SELECT 'ab' || lpad(CAST(conv_id % {FILES} AS VARCHAR), 2, '0') AS file, conv_id, turn, 1 AS kind, '*' || upper(substr(role, 1, 3)) AS speaker, {FLAT.format(x='text')} AS utterance FROM conversations
UNION ALL SELECT 'ab' || lpad(CAST(conv_id % {FILES} AS VARCHAR), 2, '0'), conv_id, turn, 0, CASE conv_id % 3 WHEN 0 THEN '@Com' WHEN 1 THEN '@New Ep' ELSE '@Begin' END, CASE conv_id % 3 WHEN 1 THEN '...' ELSE 'start' END FROM conversations WHERE turn = 0),
numbered AS (SELECT *, row_number() OVER w AS line_num, CASE WHEN kind = 1 THEN sum(kind) OVER w END AS utt_num FROM lines WINDOW w AS (PARTITION BY file ORDER BY conv_id, turn, kind, speaker, utterance ROWS UNBOUNDED PRECEDING))"""


def transcripts(spark, sf):
    """Writes conversations as transcript files, one folder per file, and reads them."""
    c = read(spark, sf, "conversations").withColumn("file", F.concat(F.lit("ab"), F.lpad((F.col("conv_id") % FILES).cast("string"), 2, "0")))
    said = c.select("file", *TURN, F.lit(1).alias("kind"), F.concat(F.lit("*"), F.upper(F.substring("role", 1, 3))).alias("speaker"), flat("text").alias("utterance"))
    k = F.col("conv_id") % 3
    heads = c.where("turn = 0").select("file", *TURN, F.lit(0).alias("kind"), F.when(k == 0, "@Comment").when(k == 1, "@New Episode").otherwise("@Begin").alias("speaker"), F.lit("start").alias("utterance"))
    scratch = Scratch(spark, "transcripts")
    lines = said.union(heads).repartition(FILES, "file").sortWithinPartitions("file", *TURN, "kind", "speaker", "utterance")
    lines.select("file", F.concat("speaker", F.lit(":\t"), F.coalesce("utterance", F.lit(""))).alias("value")).write.partitionBy("file").text(f"{scratch.root}/cha")
    return readers.chat_transcripts(spark, f"{scratch.root}/cha/*/*.txt", name="file=([^/]*)/")


@query(f"WITH {TRANSCRIPT} SELECT file, CAST(line_num AS INTEGER) AS line_num, speaker, coalesce(utterance, '') AS utterance, CAST(utt_num AS INTEGER) AS utt_num FROM numbered WHERE speaker <> '@Begin'")
def read_transcripts(spark, sf):
    return transcripts(spark, sf).select("file", "line_num", "speaker", "utterance", "utt_num")


@query(f"WITH {TRANSCRIPT} SELECT CAST(line_num AS INTEGER) AS \"LineNum\", CAST(utt_num AS INTEGER) AS \"UttNum\", file, CAST(p AS INTEGER) AS pass FROM numbered, (SELECT unnest([1, 2, 3]) AS p) WHERE kind = 1")
def blank_coding_document(spark, sf):
    return readers.coding_template(transcripts(spark, sf)).select("LineNum", "UttNum", "file", "pass")


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def tsv_round_trip(spark, sf):
    path = f"{Scratch(spark, 'tsv').root}/orders"
    writers.tsv(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice")), path)
    return readers.delimited(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")


@query("SELECT w AS word, upper(w) AS phon FROM (SELECT DISTINCT unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM benchmark)")
def read_dictionary(spark, sf):
    from lexloom.plans.queries import dictionary_words

    path = f"{Scratch(spark, 'dictionary').root}/words"
    writers.tsv(dictionary_words(spark, sf).select(F.col("w").alias("word"), F.upper("w").alias("phon")), path, " ")
    return readers.delimited(spark, path, "word string, phon string", " ")


@query("SELECT DISTINCT event_type AS context, 'a ' || user_id AS word FROM events WHERE user_id % 3 <> 0")
def read_keyword_list(spark, sf):
    path = f"{Scratch(spark, 'keywords').root}/list"
    rows = read(spark, sf, "events").select(F.lit("c").alias("category"), F.concat(F.lit("a_"), F.col("user_id").cast("string")).alias("word"), F.when(F.col("user_id") % 3 != 0, F.col("event_type")).otherwise("NA").alias("context")).distinct()
    rows.write.option("lineSep", "\r").option("header", True).csv(path)
    return readers.keyword_list(spark, path).select("context", "word")


@query("WITH a AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS line, 'e' || event_id AS a FROM events), b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line, 'o' || o_orderkey AS b FROM orders) SELECT coalesce(a.line, b.line) AS line, a, b FROM a FULL JOIN b ON a.line = b.line")
def aligned_line_lists(spark, sf):
    scratch = Scratch(spark, "aligned")
    paths = {}
    for name, table, key in (("a", "events", "event_id"), ("b", "orders", "o_orderkey")):
        rows = read(spark, sf, table).select(F.concat(F.lit(table[0]), F.col(key).cast("string")).alias("value"), key)
        paths[name] = f"{scratch.root}/{name}"
        # part files are named in the order of the sort
        rows.repartitionByRange(4, key).sortWithinPartitions(key).select("value").write.text(paths[name])
    return readers.aligned_lines(spark, paths)


CODED = "c AS (SELECT CAST(event_id % 50 AS INTEGER) AS \"LineNum\", CAST(event_id % 50 AS INTEGER) AS \"UttNum\", 'f' || user_id AS file, CASE event_id % 5 WHEN 0 THEN 'RM' WHEN 1 THEN NULL ELSE 'AB' END AS coder, upper(event_type) || ',x/y' AS context, CAST(event_id % 3 AS INTEGER) AS pass FROM events)"


@query(f"WITH {CODED} SELECT DISTINCT \"LineNum\", \"UttNum\", file, coder, replace(replace(lower(context), ',', ';'), '/', ';') AS context, pass FROM c WHERE coder = 'AB'")
def read_coding_documents(spark, sf):
    k = F.col("event_id") % 5
    rows = read(spark, sf, "events").select((F.col("event_id") % 50).cast("int").alias("LineNum"), (F.col("event_id") % 50).cast("int").alias("UttNum"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.when(k == 0, "RM").when(k > 1, "AB").alias("coder"), F.lit(1400000000).cast("long").alias("date"), F.concat(F.upper("event_type"), F.lit(",x/y")).alias("context"), (F.col("event_id") % 3).cast("int").alias("pass"), (F.col("user_id") % 3).alias("part"))
    root = Scratch(spark, "coding").root
    rows.write.option("sep", "\t").option("header", True).option("quote", "").partitionBy("part").csv(f"{root}/docs")
    return readers.coding_documents(spark, f"{root}/docs", "*.csv").select("LineNum", "UttNum", "file", "coder", "context", "pass")


@query("SELECT event_type AS context, CAST(event_id AS DOUBLE) AS p, CAST(user_id AS DOUBLE) / 4 AS r FROM events")
def read_score_tables(spark, sf):
    root = Scratch(spark, "scores").root
    rows = read(spark, sf, "events").select(F.concat_ws("  ", F.col("event_id").cast("string"), (F.col("user_id") / 4).cast("string")).alias("value"), F.col("event_type").alias("context"))
    head = rows.select("context").distinct().select(F.lit("p r").alias("value"), "context")
    rows.union(head).write.partitionBy("context").text(f"{root}/output")
    return readers.score_tables(spark, f"{root}/output", ["p", "r"], keep="output", context=r".*context=([^/]*)/.*", pattern="*.txt").select("context", "p", "r")


def logged_runs(spark, sf):
    """(run, value): lines of logs. A run is in one task, as it has one file; runs are dealt to several tasks."""
    e = read(spark, sf, "events").withColumn("run", F.col("user_id") % 7)
    line = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("P "), F.col("event_id").cast("string"), F.lit(" BP "), (F.col("event_id") / 2).cast("string"))).otherwise("noise P 1")
    return e.repartition("run").select("run", line.alias("value"))


@query("SELECT user_id % 7 AS run, round(avg(event_id), 6) AS p, round(avg(event_id / 2), 6) AS bp FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def read_score_logs(spark, sf):
    root = Scratch(spark, "logs").root
    logged_runs(spark, sf).write.partitionBy("run").text(f"{root}/out")
    found = readers.score_logs(spark, f"{root}/out", r".*run=([^/]*)/", "*.txt")
    return found.select(F.col("context").cast("long").alias("run"), F.round("P", 6).alias("p"), F.round("BP", 6).alias("bp"))


@query("SELECT event_id, user_id % 4 AS job FROM events")
def read_batch_results(spark, sf):
    root = Scratch(spark, "batch").root
    e = read(spark, sf, "events").select("event_id", (F.col("user_id") % 4).alias("job"))
    for job in range(4):
        e.where(F.col("job") == job).write.parquet(f"{root}/jobs/{job}/result")
    return readers.batch_results(spark, f"{root}/jobs").select("event_id", "job")


@query(f"WITH {TAGS} SELECT context, c.text AS value, count(*) AS n FROM tags t JOIN (SELECT conv_id, turn, {FLAT.format(x='text')} AS text FROM conversations) c ON t.conv_id = c.conv_id AND t.turn = c.turn GROUP BY ALL")
def context_corpora(spark, sf):
    """Exports the turns of each context as headerless text and reads the folders."""
    path = f"{Scratch(spark, 'corpora').root}/corpora"
    said = read(spark, sf, "conversations").select(*TURN, flat("text").alias("text"))
    writers.context_corpora(marked_tags(spark, sf).join(said, TURN), path, "text")
    return spark.read.text(path).groupBy("context", "value").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def json_round_trip(spark, sf):
    path = f"{Scratch(spark, 'json').root}/nation"
    writers.json_lines(read(spark, sf, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.schema("n_nationkey bigint, n_name string").json(path).select(F.col("n_nationkey"), "n_name")


@query("SELECT string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS body FROM region")
def markdown_table(spark, sf):
    table = writers.markdown(read(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame([("\n".join(table.split("\n")[2:]),)], "body string")


@query("SELECT k, i FROM (SELECT unnest(range(2, 6)) AS k), (SELECT unnest(range(1, 4)) AS i)")
def parameter_grid(spark, sf):
    return readers.grid(spark, k=[2, 3, 4, 5], i=[1, 2, 3])


@query("SELECT 'nation' AS name, 6 AS n UNION ALL SELECT 'region', 5")
def preview_tables(spark, sf):
    shown = readers.preview({n: read(spark, sf, n) for n in ("nation", "region")})
    counts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in shown.items()]
    return counts[0].union(counts[1])


@query(f"WITH {TOK} SELECT role, w, count(*) AS n FROM tok GROUP BY ALL")
def saved_table(spark, sf):
    """A table that is written once and read twice."""
    saved = Scratch(spark, "saved").put(turn_tokens(spark, sf).groupBy("role", "conv_id", "w").agg(F.count("*").alias("n")), "tokens")
    return saved.groupBy("role", "w").agg(F.sum("n").alias("n"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first, round(value, 6) AS value FROM events")
def positional_bind(spark, sf):
    """Two tables bound by position, as a join on the position."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").withColumn("first", F.row_number().over(w).cast("long"))
    return e.select("user_id", "first", "event_id").join(e.select("user_id", "first", F.round("value", 6).alias("value")), ["user_id", "first"]).select("event_id", "first", "value")


