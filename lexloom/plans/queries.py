"""The catalogue of queries over the test tables, each with the SQL it is checked against where SQL can express it.

Roles of the tables: a turn of ``conversations`` is an utterance of its conversation, with its words as syllables;
``events`` of a user are an ordered sequence; ``labels`` are two binary tagging methods; the words of ``benchmark``
are a dictionary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import stats, text
from lexloom.operators import agreement, contexts, descriptives, models, ngrams, resample, segment, translate, windows
from lexloom.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Keyword lists of the contexts that turns are tagged with.
KEYWORDS = [("article", "the"), ("article", "a"), ("relation", "of"), ("relation", "of_the"), ("joining", "and"), ("joining", "as"), ("place", "in"), ("place", "to"), ("place", "für"), ("relation", "ción"), ("joining", "that's"), ("article", "pat-a-cake")]
CONTEXTS = sorted({c for c, _ in KEYWORDS})
TURN = ["conv_id", "turn"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def turn_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "conversations")
    return t.select(*TURN, "role", F.posexplode(text.tokens(text.letters(F.col("text")))).alias("i", "w"))


def turn_pairs(spark: SparkSession, sf: str, by: list[str]) -> DataFrame:
    return windows.bigrams(turn_tokens(spark, sf), [*by, *TURN], "i", "w")


def tags(spark: SparkSession, sf: str, turns: DataFrame | None = None) -> DataFrame:
    words = spark.createDataFrame(KEYWORDS, "context string, word string")
    return contexts.keyword_tags(read(spark, sf, "conversations") if turns is None else turns, TURN, "text", words)


def marked_tags(spark: SparkSession, sf: str, turns: DataFrame | None = None) -> DataFrame:
    return tags(spark, sf, turns).withColumn("value", contexts.binarise(F.col("value")))


def wide_tags(spark: SparkSession, sf: str) -> DataFrame:
    return contexts.to_wide(marked_tags(spark, sf), TURN, CONTEXTS, fill=0)


def event_hits(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", "event_id", "ts", "event_type", "value", F.row_number().over(w).cast("long").alias("pos"), (F.col("event_type") == "error").cast("int").alias("hit"))




TOK = "tok AS (SELECT conv_id, turn, role, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT conv_id, turn, role, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM conversations))"
PAIR = "pair AS (SELECT * FROM (SELECT conv_id, turn, role, i, w AS a, lead(w) OVER (PARTITION BY role, conv_id, turn ORDER BY i) AS b FROM tok) WHERE b IS NOT NULL)"
KW = "kw(context, word) AS (VALUES " + ", ".join(f"('{c}', '{w.replace('_', ' ').replace(chr(39), 2 * chr(39))}')" for c, w in KEYWORDS) + ")"
WORD, BETWEEN = r"[\p{L}\p{M}\p{N}_]+", r"[^\p{L}\p{M}\p{N}_]"
FORM = r"trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def tags_sql(texts: str, keywords: list[tuple[str, str]]) -> str:
    """tags (conv_id, turn, context, value) of a table of texts: a regular expression for each keyword."""
    word = lambda w: f"'(^|{BETWEEN})" + w.replace("_", " ").replace("'", "''") + f"($|{BETWEEN})'"
    found = ", ".join(f"CASE WHEN regexp_matches(form, {word(w)}) THEN '{c}' END" for c, w in keywords)
    return f"tags AS (SELECT conv_id, turn, context, count(*) AS value FROM (SELECT conv_id, turn, unnest([{found}]) AS context FROM (SELECT conv_id, turn, {FORM} AS form FROM {texts})) WHERE context IS NOT NULL GROUP BY ALL)"


TAGS = f"{TOK}, {tags_sql('conversations', KEYWORDS)}"
WIDE = f"{TAGS}, wide AS (SELECT conv_id, turn, " + ", ".join(f"max(CASE WHEN context = '{c}' THEN 1 ELSE 0 END) AS {c}" for c in CONTEXTS) + " FROM tags GROUP BY conv_id, turn)"
EV = "ev AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS hit FROM events)"


def bigram_sql(by: str = "") -> str:
    b = f"{by}, " if by else ""
    p = f"PARTITION BY {by}" if by else ""
    pa, pb = (f"PARTITION BY {b}{x}" for x in "ab")
    return f"big AS (SELECT {b}a, b, ab, sum(ab) OVER ({pa}) AS a1, sum(ab) OVER ({pb}) AS b2, sum(ab) OVER ({p}) AS n, ab / sum(ab) OVER ({pa}) AS tp, log2((ab / sum(ab) OVER ({p})) / ((sum(ab) OVER ({pa}) / sum(ab) OVER ({p})) * (sum(ab) OVER ({pb}) / sum(ab) OVER ({p})))) AS mi FROM (SELECT {b}a, b, CAST(count(*) AS DOUBLE) AS ab FROM pair GROUP BY ALL))"


# ------------------------------------------------------------------ bigrams


@query(f"WITH {TOK}, {PAIR}, {bigram_sql()} SELECT a, b, CAST(ab AS BIGINT) AS ab, CAST(a1 AS BIGINT) AS a1, CAST(b2 AS BIGINT) AS b2, round(tp, 6) AS tp, round(mi, 6) AS mi FROM big")
def bigram_tp_mi(spark, sf):
    t = ngrams.bigram_table(turn_pairs(spark, sf, []))
    return t.select("a", "b", "ab", "a1", "b2", F.round("tp", 6).alias("tp"), F.round("mi", 6).alias("mi"))


@query(f"WITH {TOK}, {PAIR}, {bigram_sql()}, r AS (SELECT *, row_number() OVER (ORDER BY round(tp, 9) DESC, ab DESC, a, b) AS tp_rank FROM big) SELECT a, b, tp_rank, row_number() OVER (ORDER BY round(mi, 9) DESC, tp_rank) AS mi_rank FROM r")
def bigram_ranks(spark, sf):
    return ngrams.bigram_ranks(ngrams.bigram_table(turn_pairs(spark, sf, []))).select("a", "b", "tp_rank", "mi_rank")


@query(f"WITH {TOK}, f AS (SELECT role, w, count(*) AS freq FROM tok GROUP BY ALL) SELECT role, w, freq, round(freq / count(*) OVER (PARTITION BY role), 6) AS share FROM f")
def token_type_share(spark, sf):
    t = ngrams.type_share(turn_tokens(spark, sf), "w", ["role"])
    return t.select("role", "w", "freq", F.round("share", 6).alias("share"))


@query(f"WITH {TOK}, {PAIR}, {bigram_sql()}, v AS (SELECT a AS token FROM big GROUP BY a HAVING sum(ab) / (0.03 * (SELECT max(s) FROM (SELECT sum(ab) AS s FROM big GROUP BY a))) >= 0.5), c AS (SELECT quantile_cont(mi, 0.1) AS cut FROM big) SELECT a, b, CAST(ab AS BIGINT) AS ab, round(mi, 6) AS mi FROM big, c WHERE mi >= cut - 1e-12 AND a IN (SELECT token FROM v) AND b IN (SELECT token FROM v)")
def bigram_graph_edges(spark, sf):
    _, e = ngrams.bigram_graph(ngrams.bigram_table(turn_pairs(spark, sf, [])), p=0.1)
    return e.select("a", "b", "ab", F.round("mi", 6).alias("mi"))


# ------------------------------------------------------------------ descriptives


@query(f"""WITH {TOK}, u AS (SELECT role, conv_id, turn, count(*) AS k FROM tok GROUP BY ALL), l AS (SELECT role, count(*) AS n_utts, avg(k) AS m, avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END) AS o FROM u GROUP BY role),
f AS (SELECT role, w, count(*) AS f FROM tok GROUP BY ALL), t AS (SELECT role, CAST(sum(f) AS BIGINT) AS n_tokens, count(*) AS n_types, max(f) AS highest_freq FROM f GROUP BY role), h AS (SELECT f.role, min(w) AS highest_token FROM f JOIN t ON f.role = t.role AND f.f = t.highest_freq GROUP BY f.role)
SELECT role, n_utts, n_tokens, n_types, highest_freq, highest_token, round(n_types / n_tokens, 6) AS ttr, round(highest_freq / n_tokens, 6) AS prop_highest, round(m, 6) AS mean_per_utt, round(o, 6) AS prop_one FROM l JOIN t USING (role) JOIN h USING (role)""")
def corpus_descriptives_by_context(spark, sf):
    d = descriptives.describe(turn_tokens(spark, sf), ["role"], TURN, "w")
    return d.select("role", "n_utts", "n_tokens", "n_types", "highest_freq", "highest_token", *(F.round(c, 6).alias(c) for c in ("ttr", "prop_highest", "mean_per_utt", "prop_one")))


@query(f"WITH {TOK}, f AS (SELECT role, w, count(*) AS freq FROM tok GROUP BY ALL) SELECT role, w, freq, row_number() OVER (PARTITION BY role ORDER BY freq DESC, w) AS rank FROM f QUALIFY rank <= 3")
def word_freq_top3_by_role(spark, sf):
    return descriptives.top_tokens(turn_tokens(spark, sf), ["role"], "w").select("role", "w", "freq", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {TOK}, f AS (SELECT role, w, count(*) AS f FROM tok GROUP BY ALL) SELECT role, min(f) AS least, max(f) AS most, round(quantile_cont(f, 0.25), 6) AS q25, round(quantile_cont(f, 0.5), 6) AS q50, round(quantile_cont(f, 0.75), 6) AS q75, round(quantile_cont(f, 0.9), 6) AS q90, round(quantile_cont(f, 0.95), 6) AS q95, round(quantile_cont(f, 0.99), 6) AS q99 FROM f GROUP BY role")
def word_freq_quantiles(spark, sf):
    ps = {f"q{int(p * 100)}": p for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)}
    d = descriptives.frequency_quantiles(turn_tokens(spark, sf), ["role"], "w", ps)
    return d.select("role", "least", "most", *(F.round(c, 6).alias(c) for c in ps))


@query(f"WITH {TOK}, u AS (SELECT conv_id, turn, count(*) AS length FROM tok GROUP BY ALL) SELECT length, count(*) AS utterances, round(100 * count(*) / (SELECT count(*) FROM u), 6) AS percent, round((SELECT avg(length) FROM u), 6) AS mean_length, round((SELECT stddev_samp(length) FROM u), 6) AS sd_length FROM u GROUP BY length")
def utterance_lengths(spark, sf):
    d = descriptives.length_profile(turn_tokens(spark, sf), TURN)
    return d.select("length", "utterances", *(F.round(c, 6).alias(c) for c in ("percent", "mean_length", "sd_length")))


@query(f"WITH {TAGS}, n AS (SELECT c.conv_id, c.turn, count(DISTINCT context) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations) c LEFT JOIN tags t ON c.conv_id = t.conv_id AND c.turn = t.turn GROUP BY ALL) SELECT count(*) AS elements, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0 END), 6) AS none, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END), 6) AS one, round(avg(CASE WHEN n = 2 THEN 1.0 ELSE 0 END), 6) AS two, round(avg(CASE WHEN n >= 3 THEN 1.0 ELSE 0 END), 6) AS more FROM n")
def context_coverage(spark, sf):
    d = descriptives.coverage(tags(spark, sf), TURN, read(spark, sf, "conversations"))
    return d.select("elements", *(F.round(c, 6).alias(c) for c in ("none", "one", "two", "more")))


@query(f"""WITH {KW}, n AS (SELECT *, len(regexp_extract_all(word, '{WORD}')) AS n FROM kw), c AS (SELECT regexp_extract_all({FORM}, '{WORD}|{BETWEEN}+') AS parts FROM conversations),
k AS (SELECT context, word, CAST(sum(len(list_filter(range(1, len(parts) + 1), lambda i: array_to_string(parts[i:i + 2 * n - 2], '') = word))) AS BIGINT) AS f FROM n, c GROUP BY ALL) SELECT context, CAST(sum(f) AS BIGINT) AS total, round(avg(f), 6) AS mean, max(f) AS most, first(word ORDER BY f DESC, word) AS top_word FROM k GROUP BY context""")
def keyword_frequency(spark, sf):
    words = spark.createDataFrame(KEYWORDS, "context string, word string")
    d = descriptives.keyword_frequency(read(spark, sf, "conversations"), "text", words)
    return d.select("context", "total", F.round("mean", 6).alias("mean"), "most", "top_word")


@query("SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def transcript_length(spark, sf):
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))


@query("SELECT event_type, count(*) AS n, round(corr(pos, value), 6) AS r, round(regr_slope(value, pos), 6) AS slope, round(regr_intercept(value, pos), 6) AS intercept FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events WHERE value IS NOT NULL) GROUP BY event_type")
def value_trend(spark, sf):
    e = stats.global_rank(read(spark, sf, "events").where("value is not null").select("event_type", "ts", "event_id", "value"), [F.col("event_type"), F.col("ts"), F.col("event_id")], "place")
    e = e.join(F.broadcast(e.groupBy("event_type").agg(F.min("place").alias("first"))), "event_type").withColumn("pos", F.col("place") - F.col("first") + 1)
    return stats.trend(e, ["event_type"], "pos", "value").select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("r", "slope", "intercept")))


@query("WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, n, n > (SELECT quantile_cont(n, 0.5) FROM u) AS above_median FROM u")
def median_split(spark, sf):
    return descriptives.median_split(read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")), "n")


@query("WITH o AS (SELECT user_id, event_type, sum(value) AS s FROM events GROUP BY ALL), n AS (SELECT event_type, count(*) AS n FROM o WHERE s > 0 GROUP BY event_type) SELECT 'events' AS method, event_type, n, n = 1 AS once, n >= max(n) OVER () / 2 AS common, n = max(n) OVER () AS top FROM n")
def occurrence_counts(spark, sf):
    return descriptives.occurrence_counts(read(spark, sf, "events").withColumn("method", F.lit("events")), ["user_id"], "method", "event_type", "value")


@query("SELECT event_type, count(CASE WHEN value = 1 THEN 1 END) AS n_hits, count(CASE WHEN value > 0 THEN 1 END) AS n_utterances FROM events GROUP BY event_type")
def hits_and_utterances(spark, sf):
    return descriptives.hits_and_utterances(read(spark, sf, "events"), "event_type")


# ------------------------------------------------------------------ contexts


@query(f"WITH {TAGS} SELECT conv_id, turn, context, value FROM tags")
def keyword_tag(spark, sf):
    return tags(spark, sf)


#: Keywords that have more than letters, and parts of them.
MARKED = [("play", "pat-a-cake"), ("play", "cake"), ("joining", "that's"), ("joining", "that"), ("joining", "hat's"), ("place", "café"), ("place", "caf"), ("place", "café_is")]


@query(f"WITH t AS (SELECT conv_id, turn, replace(replace(replace(text, ' la ', ' Pat-a-cake '), ' de ', ' that''s '), ' die ', ' café  is ') AS text FROM conversations), {tags_sql('t', MARKED)} SELECT conv_id, turn, context, value FROM tags")
def keyword_marks(spark, sf):
    """Keywords with hyphens, apostrophes and accents, in turns whose articles are replaced by such words."""
    t = F.col("text")
    for a, b in ((" la ", " Pat-a-cake "), (" de ", " that's "), (" die ", " café  is ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return contexts.keyword_tags(read(spark, sf, "conversations").select(*TURN, t.alias("text")), TURN, "text", spark.createDataFrame(MARKED, "context string, word string"))


@query("WITH s AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS v FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)), m AS (SELECT *, CASE WHEN v > 0.3 THEN 1 ELSE 0 END AS value FROM s) SELECT user_id, event_type, value FROM m WHERE event_type IN (SELECT event_type FROM m WHERE value = 1)")
def threshold_apply(spark, sf):
    return contexts.apply_threshold(event_shares(spark, sf), 0.3, name="event_type").select("user_id", "event_type", "value")


def event_shares(spark, sf):
    n = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.select("user_id", "event_type", (F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("value"))


@query("""WITH s AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS v FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)), t(threshold) AS (VALUES (CAST(0.1 AS DOUBLE)), (0.15), (0.2), (0.25), (0.3)),
n AS (SELECT user_id, threshold, count(CASE WHEN v > threshold THEN 1 END) AS n FROM s, t GROUP BY ALL),
o AS (SELECT threshold, avg(n) AS mean_n, avg(CASE WHEN n = 0 THEN 1.0 ELSE 0 END) AS zero, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END) AS one, avg(CASE WHEN n IN (1, 2) THEN 1.0 ELSE 0 END) AS one_or_two, avg(CASE WHEN n = 2 THEN 1.0 ELSE 0 END) AS two, avg(CASE WHEN n > 2 THEN 1.0 ELSE 0 END) AS more FROM n GROUP BY threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(mean_n, 6) AS mean_n, round(zero, 6) AS zero, round(one, 6) AS one, round(one_or_two, 6) AS one_or_two, round(two, 6) AS two, round(more, 6) AS more, threshold = (SELECT threshold FROM o ORDER BY one_or_two DESC, threshold LIMIT 1) AS best FROM o""")
def threshold_sweep(spark, sf):
    d = contexts.threshold_sweep(event_shares(spark, sf), ["user_id"], [0.1, 0.15, 0.2, 0.25, 0.3])
    return d.select("threshold", *(F.round(c, 6).alias(c) for c in ("mean_n", "zero", "one", "one_or_two", "two", "more")), "best")


@query(f"WITH {WIDE} SELECT * FROM wide WHERE {' + '.join(CONTEXTS)} < 2")
def remove_ambiguous(spark, sf):
    w = contexts.remove_ambiguous(wide_tags(spark, sf), CONTEXTS)
    return w.select(*TURN, *(F.col(c).cast("int").alias(c) for c in CONTEXTS))


@query(f"WITH {WIDE} SELECT conv_id, turn, CASE WHEN {' + '.join(CONTEXTS)} > 1 THEN 'ambiguous' WHEN {' + '.join(CONTEXTS)} = 0 THEN 'no context tag' " + " ".join(f"WHEN {c} = 1 THEN '{c}'" for c in CONTEXTS) + " END AS context FROM wide")
def extract_context(spark, sf):
    return contexts.extract_context(wide_tags(spark, sf), CONTEXTS).select(*TURN, "context")


@query(f"WITH {WIDE} SELECT conv_id, turn, " + ", ".join(f"round({c} / greatest({' + '.join(CONTEXTS)}, 1), 6) AS {c}" for c in CONTEXTS) + " FROM wide")
def fuzzy_code(spark, sf):
    w = contexts.fuzzy_code(wide_tags(spark, sf), CONTEXTS)
    return w.select(*TURN, *(F.round(c, 6).alias(c) for c in CONTEXTS))


@query(f"WITH {TAGS} SELECT context, CAST(count(*) AS BIGINT) AS total FROM tags GROUP BY context HAVING count(*) > 100")
def min_support_contexts(spark, sf):
    return contexts.min_support(marked_tags(spark, sf), 100)


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"CAST(count(CASE WHEN event_type = '{k}' THEN 1 END) AS BIGINT) AS {k}" for k in KINDS) + " FROM events GROUP BY user_id")
def pivot_context(spark, sf):
    n = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("value"))
    return contexts.to_wide(n, ["user_id"], KINDS, "event_type", fill=0)


@query("SELECT doc_id, 'quality' AS context, CAST(quality AS DOUBLE) AS value FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) FROM labels")
def unpivot_context(spark, sf):
    return contexts.to_long(read(spark, sf, "labels"), ["doc_id"])


@query("SELECT event_type, max(CASE WHEN user_id % 3 = 0 THEN s END) AS g0, max(CASE WHEN user_id % 3 = 1 THEN s END) AS g1, max(CASE WHEN user_id % 3 = 2 THEN s END) AS g2 FROM (SELECT event_type, user_id % 3 AS user_id, count(*) AS s FROM events GROUP BY ALL) GROUP BY event_type")
def transpose(spark, sf):
    n = read(spark, sf, "events").groupBy("event_type", F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("g")).agg(F.count("*").alias("value"))
    return contexts.to_wide(n, ["event_type"], ["g0", "g1", "g2"], "g")


@query("SELECT event_type AS code, user_id, count(DISTINCT event_id % 5) AS votes, round(count(DISTINCT event_id % 5) / 5, 6) AS share FROM events GROUP BY ALL")
def vote_proportions(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.col("event_type").alias("code"), (F.col("event_id") % 5).alias("coder"))
    return contexts.vote_counts(e, ["user_id"], "code", "coder", 5).withColumn("share", F.round("share", 6))


@query(r"SELECT doc_id, line, unnest(list_filter(list_transform(regexp_split_to_array(cell, '[ \t]*;[ \t]*')[1:10], lambda x: trim(x)), lambda x: x <> '')) AS code FROM (SELECT doc_id, line, replace(translate(lines[line], '.,', ';;'), chr(13), '') AS cell FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents))")
def split_explode_codes(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "cell"))
    d = d.select("doc_id", (F.col("at") + 1).cast("long").alias("line"), F.replace(F.translate("cell", ".,", ";;"), F.lit("\r"), F.lit("")).alias("cell"))
    return contexts.explode_codes(d, ["doc_id", "line"], "cell")


@query("WITH a AS (SELECT doc_id, quality FROM labels WHERE quality = 1), b AS (SELECT doc_id, toxic FROM labels WHERE toxic = 1), c AS (SELECT doc_id, lang FROM documents WHERE lang = 'de') SELECT coalesce(a.doc_id, b.doc_id, c.doc_id) AS doc_id, quality AS q_quality, toxic AS t_toxic, lang AS l_lang FROM a FULL JOIN b ON a.doc_id = b.doc_id FULL JOIN c ON coalesce(a.doc_id, b.doc_id) = c.doc_id")
def full_outer_methods(spark, sf):
    lab = read(spark, sf, "labels")
    return contexts.full_join({"q": lab.where("quality = 1").select("doc_id", "quality"), "t": lab.where("toxic = 1").select("doc_id", "toxic"), "l": read(spark, sf, "documents").where("lang = 'de'").select("doc_id", "lang")}, ["doc_id"])


@query(f"WITH {TOK}, bw AS (SELECT DISTINCT unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM benchmark), v AS (SELECT DISTINCT w FROM tok) SELECT w, 'both' AS side FROM v WHERE w IN (SELECT w FROM bw) UNION ALL SELECT w, 'conversation' FROM v WHERE w NOT IN (SELECT w FROM bw)")
def semi_anti_vocab(spark, sf):
    v, bw = turn_tokens(spark, sf).select("w").distinct(), dictionary_words(spark, sf).select("w")
    return v.join(bw, "w", "left_semi").withColumn("side", F.lit("both")).union(v.join(bw, "w", "left_anti").withColumn("side", F.lit("conversation")))


def dictionary_words(spark, sf):
    return read(spark, sf, "benchmark").select(F.explode(text.tokens(text.letters(F.col("text")))).alias("w")).distinct()


@query(f"WITH {TAGS} SELECT t.conv_id, t.turn, CASE WHEN t.turn % 2 = 0 THEN 'even' ELSE 'odd' END AS method, min(context) AS context FROM tags t GROUP BY ALL HAVING count(*) = 1")
def exactly_one_context(spark, sf):
    t = marked_tags(spark, sf).withColumn("method", F.when(F.col("turn") % 2 == 0, "even").otherwise("odd"))
    return contexts.exactly_one(t, TURN)


@query(f"WITH {TAGS}, one AS (SELECT conv_id, turn, min(context) AS a FROM tags GROUP BY ALL HAVING count(*) = 1), b AS (SELECT conv_id, turn, role AS b FROM conversations) SELECT coalesce(a, 'none') AS a, coalesce(b, 'none') AS b, count(*) AS n FROM one FULL JOIN b ON one.conv_id = b.conv_id AND one.turn = b.turn GROUP BY ALL")
def method_agreement(spark, sf):
    t = tags(spark, sf).select(*TURN, F.lit("kw").alias("method"), "context")
    r = read(spark, sf, "conversations").select(*TURN, F.lit("role").alias("method"), F.col("role").alias("context"))
    return agreement.method_pairs(t.union(r), TURN, "kw", "role")


@query(f"WITH {TAGS}, p AS (SELECT x.context AS a, y.context AS b FROM tags x JOIN tags y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.context < y.context) SELECT a, b, count(*) AS n FROM p GROUP BY ALL")
def cooccurrence_edges(spark, sf):
    return ngrams.cooccurrence(tags(spark, sf), TURN)


@query(f"WITH {TAGS}, x AS (SELECT conv_id, turn FROM tags WHERE context = 'article') SELECT context, round(count(*) / (SELECT count(*) FROM x), 6) AS share FROM tags JOIN x USING (conv_id, turn) WHERE context IN ('joining', 'place', 'relation') GROUP BY context")
def percent_match(spark, sf):
    d = descriptives.percent_match(marked_tags(spark, sf), TURN, "article", ["joining", "place", "relation"])
    return d.select("context", F.round("share", 6).alias("share"))


@query("""WITH c AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'RM' WHEN 1 THEN '' WHEN 2 THEN 'TEST' WHEN 3 THEN NULL ELSE 'AB' END AS coder, CASE WHEN user_id % 2 = 0 THEN event_id END AS date, substr(event_type, 1, 2 + CAST(user_id % 3 AS INTEGER)) AS context, CAST(event_id % 4 AS INTEGER) AS pass, event_type FROM events)
SELECT event_id, CASE event_type WHEN 'click' THEN 'C' WHEN 'error' THEN 'E' ELSE event_type END AS code, coalesce(coder IN ('RM', 'TEST'), false) OR coalesce(coder = '' AND date IS NOT NULL, false) OR (length(context) < 3 AND date IS NOT NULL) OR pass < 1 AS bad FROM c""")
def recode_and_flag(spark, sf):
    k = F.col("event_id") % 6
    coder = F.when(k == 0, "RM").when(k == 1, "").when(k == 2, "TEST").when(k > 3, "AB")
    e = read(spark, sf, "events").select("event_id", "event_type", coder.alias("coder"), F.when(F.col("user_id") % 2 == 0, F.col("event_id")).alias("date"), F.substr("event_type", F.lit(1), (2 + F.col("user_id") % 3).cast("int")).alias("context"), (F.col("event_id") % 4).cast("int").alias("pass"))
    return e.select("event_id", contexts.recode(F.col("event_type"), {"click": "C", "error": "E"}).alias("code"), contexts.bad_rows(F.col("coder"), F.col("date"), F.col("context"), F.col("pass")).alias("bad"))


@query("WITH k(raw, clean) AS (VALUES ('en', 'english'), ('de', 'german')) SELECT doc_id, coalesce(clean, lang) AS lang FROM documents LEFT JOIN k ON lang = raw")
def clean_codes(spark, sf):
    key = spark.createDataFrame([("en", "english"), ("de", "german")], "raw string, clean string")
    return contexts.clean_key(read(spark, sf, "documents").select("doc_id", "lang"), "lang", key, "raw", "clean")


# ------------------------------------------------------------------ windows


@query(f"WITH {EV} SELECT event_id, CAST(CASE WHEN hit = 1 THEN 1 WHEN max(hit) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 THEN 1.5 ELSE 0 END AS DOUBLE) AS expanded FROM ev")
def expand_windows_pm2(spark, sf):
    return windows.expand_windows(event_hits(spark, sf), "hit", ["user_id"], ["pos"]).select("event_id", "expanded")


@query(f"WITH {EV}, k AS (SELECT event_id, coalesce(max(hit) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS lag, coalesce(max(hit) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS lead FROM ev) SELECT event_id, lag, lead, greatest(lag, lead) AS either FROM k")
def within_k(spark, sf):
    e = event_hits(spark, sf)
    return e.select("event_id", *(windows.within_k("hit", ["user_id"], ["pos"], 3, kind).alias(kind) for kind in ("lag", "lead", "either")))


def continuity_sql(legacy: bool) -> str:
    source = "(SELECT * FROM (SELECT user_id, pos, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS nx FROM ev WHERE hit > 0) WHERE nx IS NOT NULL)" if legacy else "(SELECT user_id, pos FROM ev WHERE hit > 0)"
    return f"""WITH {EV}, c AS (SELECT user_id, count(*) AS len FROM (SELECT user_id, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM {source}) GROUP BY user_id, g),
    s AS (SELECT user_id, count(*) AS n_chunks, avg(len) AS mean_length, stddev_samp(len) AS sd_length, min(len) AS min_length, quantile_cont(len, 0.5) AS med_length, max(len) AS max_length FROM c GROUP BY user_id),
    d AS (SELECT user_id, count(*) AS n_hits, avg(d) AS mean_distance, quantile_cont(d, 0.5) AS med_distance, stddev_samp(d) AS sd_distance FROM (SELECT user_id, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) - pos AS d FROM ev WHERE hit > 0) GROUP BY user_id)
    SELECT d.user_id, n_hits, round(mean_distance, 6) AS mean_distance, round(med_distance, 6) AS med_distance, round(sd_distance, 6) AS sd_distance, n_chunks, round(mean_length, 6) AS mean_length, round(sd_length, 6) AS sd_length, min_length, round(med_length, 6) AS med_length, max_length FROM d LEFT JOIN s USING (user_id)"""


def continuity_of(spark, sf, legacy):
    d = windows.continuity(event_hits(spark, sf), "hit", ["user_id"], "pos", legacy)
    rounded = ("mean_distance", "med_distance", "sd_distance", "mean_length", "sd_length", "med_length")
    return d.select("user_id", "n_hits", "n_chunks", "min_length", "max_length", *(F.round(c, 6).alias(c) for c in rounded))


@query(continuity_sql(False))
def continuity_stats(spark, sf):
    return continuity_of(spark, sf, False)


@query(continuity_sql(True))
def continuity_stats_legacy(spark, sf):
    return continuity_of(spark, sf, True)


@query(f"WITH {EV} SELECT user_id, (pos - 1) // 30 AS window, count(*) AS n, string_agg(event_type, ' ' ORDER BY pos) AS text FROM ev GROUP BY ALL")
def tumbling_30(spark, sf):
    return windows.window_text(windows.tumbling(event_hits(spark, sf), ["user_id"], ["pos"]), ["user_id", "window"], "pos", "event_type")


@query("WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, CAST(f AS INTEGER) AS first, least(f + 29, n) AS last FROM (SELECT user_id, n, unnest(range(4, n + 1, 30)) AS f FROM n)")
def offset_windows(spark, sf):
    return windows.offset_windows(read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"], "n", 4)


@query(f"WITH {EV} SELECT event_id, pos AS iteration, round(avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 9) AS running_mean FROM ev")
def running_mean(spark, sf):
    d = windows.running_mean(event_hits(spark, sf), ["user_id"], ["pos"], "value")
    return d.select("event_id", F.col("iteration").cast("long").alias("iteration"), F.round("running_mean", 9).alias("running_mean"))


@query(f"WITH {EV} SELECT event_id, CASE WHEN pos >= 39 THEN round(quantile_cont(value, 0.975) OVER w, 6) END AS hi, CASE WHEN pos >= 39 THEN round(quantile_cont(value, 0.025) OVER w, 6) END AS lo FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)")
def running_quantile(spark, sf):
    d = windows.running_quantiles(event_hits(spark, sf), ["user_id"], ["pos"], "value", {"hi": 0.975, "lo": 0.025})
    return d.select("event_id", F.round("hi", 6).alias("hi"), F.round("lo", 6).alias("lo"))


@query("SELECT user_id, coalesce(min(CASE WHEN event_type <> 'error' THEN event_id % 9 END), max(event_id % 9) + 1) AS next_pass FROM events GROUP BY user_id")
def next_pass(spark, sf):
    e = read(spark, sf, "events").withColumn("number", F.col("event_id") % 9)
    return windows.next_pass(e, ["user_id"], "number", F.col("event_type") == "error")


# ------------------------------------------------------------------ segmentation


def segmented(spark, sf, stat, frequency_rule=False):
    scratch = Scratch(spark, "segmented")
    c = read(spark, sf, "conversations").select("role", *TURN, text.tokens(text.letters(F.col("text"))).alias("words"))
    rows = scratch.put(c.where("words IS NOT NULL"), "rows")
    table = scratch.put(ngrams.bigram_table(segment.neighbours(rows, ["role"], "words"), ["role"]), "bigrams")
    return segment.units_of_rows(rows, table, ["role"], TURN, "words", (stat,), frequency_rule=frequency_rule).drop("stat")


def units_sql(stat: str, frequency_rule: bool = False, name: str = "") -> str:
    """From tok (role, conv_id, turn, i, w) and big to the units of each role; ``name`` tells several apart."""
    freq = f"fcut{name} AS (SELECT role, quantile_cont(f, 0.85) AS fcut FROM (SELECT role, w, count(*) AS f FROM tok GROUP BY ALL) GROUP BY role), " if frequency_rule else ""
    low = f"{stat} < cut - 1e-9" + (" OR ab < fcut" if frequency_rule else "")
    return f"""cut{name} AS (SELECT role, quantile_cont({stat}, 0.85) AS cut FROM big GROUP BY role), {freq}
    seg{name} AS (SELECT big.role, a, b, CASE WHEN {low} THEN 1 ELSE 0 END AS low FROM big JOIN cut{name} USING (role) {f"JOIN fcut{name} USING (role)" if frequency_rule else ""}),
    m{name} AS (SELECT t.*, CASE WHEN prev IS NULL THEN 1 ELSE coalesce(low, 1) END AS st FROM (SELECT *, lag(w) OVER (PARTITION BY role, conv_id, turn ORDER BY i) AS prev FROM tok) t LEFT JOIN seg{name} seg ON seg.role = t.role AND seg.a = t.prev AND seg.b = t.w),
    g{name} AS (SELECT *, sum(st) OVER (PARTITION BY role, conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS u FROM m{name}),
    units{name} AS (SELECT role, conv_id, turn, CAST(u AS BIGINT) AS unit_no, string_agg(w, '-' ORDER BY i) AS phon, count(*) AS n_syl FROM g{name} GROUP BY ALL)"""


def segment_sql(stat: str, frequency_rule: bool = False) -> str:
    return f"{TOK}, {PAIR}, {bigram_sql('role')}, {units_sql(stat, frequency_rule)}"


@query(f"WITH {segment_sql('tp')} SELECT role, conv_id, turn, unit_no, phon, n_syl FROM units")
def segment_tp85(spark, sf):
    return segmented(spark, sf, "tp").select("role", *TURN, F.col("unit_no").cast("long").alias("unit_no"), "phon", "n_syl")


@query(f"WITH {segment_sql('mi')} SELECT role, conv_id, turn, unit_no, phon, n_syl FROM units")
def segment_mi85(spark, sf):
    return segmented(spark, sf, "mi").select("role", *TURN, F.col("unit_no").cast("long").alias("unit_no"), "phon", "n_syl")


SCORE = f"""{segment_sql('tp')}, t AS (SELECT role, phon, any_value(n_syl) AS n_syl, count(*) AS unit_freq FROM units GROUP BY role, phon),
bw AS (SELECT DISTINCT unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM benchmark),
d AS (SELECT role, w AS phon, 1 AS n_syl, count(*) AS freq FROM tok WHERE w IN (SELECT w FROM bw) GROUP BY role, w),
j AS (SELECT coalesce(d.role, t.role) AS role, coalesce(d.phon, t.phon) AS phon, coalesce(d.n_syl, t.n_syl) AS n_syl, CASE WHEN d.phon IS NULL THEN 'false.alarm' WHEN t.phon IS NULL THEN 'miss' ELSE 'hit' END AS result, CASE WHEN t.phon IS NULL THEN d.freq ELSE unit_freq END AS freq FROM d FULL JOIN t ON d.role = t.role AND d.phon = t.phon AND d.n_syl = t.n_syl)"""


def assessed(spark, sf):
    table = segment.unit_table(segmented(spark, sf, "tp"), ["role"])
    words = turn_tokens(spark, sf).join(dictionary_words(spark, sf), "w", "left_semi").groupBy("role", "w").agg(F.count("*").alias("freq"))
    d = words.select("role", F.col("w").alias("word"), F.col("w").alias("phon"), F.lit(1).cast("long").alias("n_syl"), "freq")
    return segment.assess(table, d, ["role"])


@query(f"WITH {SCORE} SELECT role, phon, CAST(n_syl AS BIGINT) AS n_syl, result, freq FROM j")
def segment_hits(spark, sf):
    return assessed(spark, sf).select("role", "phon", "n_syl", "result", "freq")


@query(f"WITH {SCORE} SELECT role, count(CASE WHEN result = 'hit' THEN 1 END) AS hits, count(CASE WHEN result = 'miss' THEN 1 END) AS misses, count(CASE WHEN result = 'false.alarm' THEN 1 END) AS false_alarms, round(count(CASE WHEN result = 'hit' THEN 1 END) / count(CASE WHEN result IN ('hit', 'miss') THEN 1 END), 6) AS recall, round(count(CASE WHEN result = 'hit' THEN 1 END) / count(CASE WHEN result IN ('hit', 'false.alarm') THEN 1 END), 6) AS precision FROM j GROUP BY role")
def segment_scores(spark, sf):
    s = segment.scores(assessed(spark, sf), ["role"])
    return s.select("role", "hits", "misses", "false_alarms", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(f"WITH {segment_sql('tp')}, t AS (SELECT role, phon, any_value(n_syl) AS n_syl, count(*) AS unit_freq FROM units GROUP BY role, phon) SELECT role, phon, n_syl, unit_freq FROM t s WHERE NOT EXISTS (SELECT 1 FROM t l WHERE l.role = s.role AND l.n_syl > s.n_syl AND contains('-' || l.phon || '-', '-' || s.phon || '-'))")
def embedding_rule(spark, sf):
    return segment.embedding_rule(segment.unit_table(segmented(spark, sf, "tp"), ["role"]), ["role"])


# ------------------------------------------------------------------ agreement and tests


@query("WITH c AS (SELECT quality, toxic, count(*) AS o FROM labels GROUP BY ALL), g AS (SELECT r.quality, s.toxic, ra, cb, coalesce(o, 0) AS o, (SELECT sum(o) FROM c) AS n FROM (SELECT quality, sum(o) AS ra FROM c GROUP BY 1) r CROSS JOIN (SELECT toxic, sum(o) AS cb FROM c GROUP BY 1) s LEFT JOIN c ON c.quality = r.quality AND c.toxic = s.toxic), x AS (SELECT sum((o - ra * cb / n) ** 2 / (ra * cb / n)) AS chi2, count(DISTINCT quality) - 1 AS r, count(DISTINCT toxic) - 1 AS c, max(n) AS n FROM g) SELECT round(chi2, 6) AS chi2, r * c AS dof, CAST(n AS BIGINT) AS total, round(sqrt(chi2 / (n * least(r, c))), 6) AS cramers_v, round(sqrt(chi2 / n), 6) AS phi FROM x")
def crosstab_chi2_cramers_v(spark, sf):
    x = agreement.chi_square(agreement.crosstab(read(spark, sf, "labels"), "quality", "toxic"), "quality", "toxic")
    return x.select(F.round("chi2", 6).alias("chi2"), "dof", "total", F.round("cramers_v", 6).alias("cramers_v"), F.round("phi", 6).alias("phi"))


EST = "est AS (SELECT user_id, event_type, value, avg(value) OVER (PARTITION BY event_type, user_id) AS est FROM events)"


@query("WITH m AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1), e AS (SELECT event_id, event_type, value, avg(value) OVER (PARTITION BY event_type, user_id) AS est FROM events) SELECT event_id, round((est - m) / nullif(s, 0), 6) AS z_est, round((value - m) / nullif(s, 0), 6) AS z_value FROM e JOIN m USING (event_type)")
def bootstrap_z(spark, sf):
    e = read(spark, sf, "events").withColumn("est", F.avg("value").over(Window.partitionBy("event_type", "user_id")))
    return stats.with_z(e, "value", "est", ["event_type"]).select("event_id", F.round("z_est", 6).alias("z_est"), F.round("z_value", 6).alias("z_value"))


#: P(X <= k) or P(X > k) of a binomial at 0.025, k the smaller count.
UNSURE = """CASE WHEN n_above <> n_below THEN CASE WHEN least(p_hi, p_lo) < 0.025 THEN 1 ELSE -1 END * list_sum(list_transform(range(0, least(n_above, n_below) + 1), lambda i: exp(lgamma(iters + 1) - lgamma(i + 1) - lgamma(iters - i + 1) + i * ln(0.025) + (iters - i) * ln(0.975)))) + CASE WHEN least(p_hi, p_lo) < 0.025 THEN 0 ELSE 1 END END"""


@query("WITH e AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) * 1.5 AS est FROM events), t AS (SELECT event_type, count(*) AS iters, count(CASE WHEN value >= est THEN 1 END) AS n_above FROM e WHERE value IS NOT NULL GROUP BY event_type), p AS (SELECT *, iters - n_above AS n_below, n_above / iters AS p_hi, (iters - n_above) / iters AS p_lo FROM t) SELECT event_type, iters, n_above, n_below, round(p_hi, 6) AS p_hi, round(p_lo, 6) AS p_lo, round(least(p_hi, p_lo), 6) AS p_val, CASE WHEN least(p_hi, p_lo) < 0.001 THEN '***' WHEN least(p_hi, p_lo) < 0.01 THEN '**' WHEN least(p_hi, p_lo) < 0.05 THEN '*' WHEN least(p_hi, p_lo) < 0.1 THEN '+' ELSE '' END AS stars, round(" + UNSURE + ", 6) AS p_boot_unsure FROM p")
def bootstrap_test(spark, sf):
    e = read(spark, sf, "events")
    e = e.join(F.broadcast(e.groupBy("event_type").agg((F.avg("value") * 1.5).alias("est"))), "event_type")
    t = stats.bootstrap_test(e, "value", "est", ["event_type"])
    return t.select("event_type", "iters", "n_above", "n_below", *(F.round(c, 6).alias(c) for c in ("p_hi", "p_lo", "p_val", "p_boot_unsure")), text.stars(F.col("p_val")).alias("stars"))


@query("SELECT event_type, round(stddev_samp(value) / sqrt(count(value)), 6) AS se, round(median(value), 6) AS med, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def summary_statistics(spark, sf):
    e = read(spark, sf, "events")
    out = e.groupBy("event_type").agg(F.round(stats.standard_error("value"), 6).alias("se"), F.min("value").alias("low"), F.max("value").alias("high"))
    med = stats.cutoffs(e, ["event_type"], {"med": ("value", 0.5)}).withColumn("med", F.round("med", 6))
    return out.join(F.broadcast(med), "event_type").select("event_type", "se", "med", "low", "high")


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.85), 6) AS q85, round(quantile_cont(l_extendedprice, 0.975), 6) AS q975 FROM lineitem GROUP BY l_returnflag")
def exact_quantiles(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    a, b = stats.grouped_quantiles(lines, ["l_returnflag"], "l_quantity", {"q85": 0.85}), stats.grouped_quantiles(lines, ["l_returnflag"], "l_extendedprice", {"q975": 0.975})
    return a.join(b, "l_returnflag").select("l_returnflag", F.round("q85", 6).alias("q85"), F.round("q975", 6).alias("q975"))


@query("SELECT c_mktsegment, c_nationkey, n, rank() OVER (PARTITION BY c_mktsegment ORDER BY n) AS min_rank, rank() OVER (PARTITION BY c_mktsegment ORDER BY n) + (count(*) OVER (PARTITION BY c_mktsegment, n) - 1) / 2 AS mean_rank FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL)")
def tie_ranks(spark, sf):
    n = read(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    w = Window.partitionBy("c_mktsegment").orderBy("n")
    return n.select("c_mktsegment", "c_nationkey", "n", F.rank().over(w).cast("long").alias("min_rank"), stats.average_rank(["c_mktsegment"], F.col("n")).alias("mean_rank"))


# ------------------------------------------------------------------ resampling


@query(f"WITH {TAGS}, n AS (SELECT context, count(*) AS n FROM tags GROUP BY context), g AS (SELECT it AS iter, c.conv_id, c.turn, context, n, row_number() OVER (PARTITION BY it, context ORDER BY md5('s|' || it || '|' || context || '|' || c.conv_id || '|' || c.turn), c.conv_id, c.turn) AS r FROM (SELECT DISTINCT conv_id, turn FROM conversations) c CROSS JOIN (SELECT unnest(range(5)) AS it) CROSS JOIN n) SELECT iter, conv_id, turn, context, 1 AS value FROM g WHERE r <= n")
def permutation_null(spark, sf):
    return resample.permute(marked_tags(spark, sf), read(spark, sf, "conversations"), TURN, 5)


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('s|' || event_id), event_id) <= 3")
def stratified_sample_n(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type")
    return resample.sample_per_group(e, ["user_id", "event_type"], ["event_id"], 3)


@query("WITH s AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS p FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) SELECT user_id, event_type, CASE WHEN CAST(('0x' || substr(md5('s|' || event_type || '|' || user_id), 1, 13)) AS BIGINT) / 4503599627370496.0 < p THEN 1 ELSE 0 END AS value FROM s")
def sample_probabilities(spark, sf):
    return resample.bernoulli(event_shares(spark, sf), ["user_id"], name="event_type").select("user_id", "event_type", "value")


@query("WITH u AS (SELECT DISTINCT user_id FROM events), n AS (SELECT count(*) AS n FROM u), z AS (SELECT i, CAST(floor(10 + i * ((n - 20) / 4) + 0.5) AS BIGINT) AS size FROM n, (SELECT unnest(range(5)) AS i)) SELECT user_id, size FROM u, z QUALIFY row_number() OVER (PARTITION BY i ORDER BY md5('s|' || i || '|' || user_id), user_id) <= size")
def contexts_by_size(spark, sf):
    return resample.contexts_by_size(read(spark, sf, "events"), ["user_id"], 5, 10)


@query("WITH one AS (SELECT user_id, upper(event_type) AS coder, event_id, CAST(event_id AS VARCHAR) AS code FROM events QUALIFY row_number() OVER (PARTITION BY user_id, upper(event_type) ORDER BY md5('s|' || user_id || '|' || upper(event_type) || '|' || event_id), user_id, upper(event_type), CAST(event_id AS VARCHAR)) = 1) SELECT user_id, coder, code FROM one QUALIFY count(*) OVER (PARTITION BY user_id) >= 2 AND row_number() OVER (PARTITION BY user_id ORDER BY md5('s|' || user_id || '|' || coder), coder) <= 3")
def process_codes(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.col("event_type").alias("coder"), F.col("event_id").cast("string").alias("code"))
    return resample.process_codes(e, ["user_id"], "coder", "code", 2, 3).select("user_id", "coder", "code")


@query("SELECT o_orderkey, unnest(range(1, CAST(o_totalprice / 100000 AS BIGINT) + 1)) AS copy FROM (SELECT o_orderkey, floor(o_totalprice / 100000) * 100000 AS o_totalprice FROM orders)")
def weighted_repetition(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 100000).alias("k"))
    return resample.weighted_repetition(o, "k").select("o_orderkey", F.col("copy").cast("long").alias("copy"))


# ------------------------------------------------------------------ text


@query(f"""WITH {TOK}, d AS (SELECT w, upper(substr(w, 1, 2)) || '-' || upper(substr(w, 3)) AS phon FROM (SELECT DISTINCT unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM benchmark)),
j AS (SELECT conv_id, turn, i, tok.w, phon FROM tok LEFT JOIN d ON tok.w = d.w) SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS orth, string_agg(coalesce(phon, w), ' ' ORDER BY i) AS phon, count(*) AS n_tokens, count(*) - count(phon) AS n_unknown FROM j GROUP BY ALL HAVING count(*) - count(phon) <= 0.6 * count(*)""")
def dictionary_translate(spark, sf):
    d = dictionary_words(spark, sf).select(F.col("w").alias("word"), F.concat(F.upper(F.substring("w", 1, 2)), F.lit("-"), F.upper(F.substring("w", 3, F.length("w")))).alias("phon"))
    c = read(spark, sf, "conversations").select(*TURN, text.letters(F.col("text")).alias("t"))
    return translate.translate(c, TURN, "t", d, 0.6)


@query("SELECT w, array_to_string(list_filter(list_transform(string_split(w, ''), lambda c: CASE c WHEN 't' THEN 'tt' WHEN 'h' THEN 'hh' WHEN 'e' THEN 'eh' WHEN 'a' THEN 'aa' WHEN 'n' THEN 'nn' END), lambda x: x IS NOT NULL), ' ') AS phones FROM (SELECT DISTINCT unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM benchmark)")
def transliterate(spark, sf):
    return dictionary_words(spark, sf).select("w", text.transliterate(F.col("w"), {"t": "tt", "h": "hh", "e": "eh", "a": "aa", "n": "nn"}).alias("phones"))


def cleaning_sql(column: str) -> str:
    for pattern, to, regex in text.TRANSCRIPT_CLEANING:
        p, t = pattern.replace("'", "''"), to.replace("'", "''")
        column = f"regexp_replace({column}, '{p}', '{t}', 'g')" if regex else f"replace({column}, '{p}', '{t}')"
    return f"trim(regexp_replace(lower({column}), '[ \\t]+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, {cleaning_sql('text')} AS clean FROM conversations")
def clean_utterances(spark, sf):
    return read(spark, sf, "conversations").select(*TURN, text.clean_utterance(F.col("text")).alias("clean"))


@query("SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' WHEN 4 THEN 'four' WHEN 5 THEN 'five' WHEN 6 THEN 'six' WHEN 7 THEN 'seven' WHEN 8 THEN 'eight' WHEN 9 THEN 'nine' END AS word, round(CASE WHEN value < 1 THEN value * 100 ELSE value END, 6) AS repaired, sha1(event_type) AS digest FROM events")
def scalar_functions(spark, sf):
    return read(spark, sf, "events").select("event_id", text.number_word(F.col("event_id") % 12).alias("word"), F.round(text.percent_repair(F.col("value")), 6).alias("repaired"), F.sha1(F.col("event_type").cast("binary")).alias("digest"))


# ------------------------------------------------------------------ models


@query("WITH p AS (SELECT lang, source, n / sum(n) OVER (PARTITION BY lang) AS prob FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)), c AS (SELECT quantile_cont(prob, 0.9) AS cut FROM p), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY -prob) + (count(*) OVER (PARTITION BY lang, prob) - 1) / 2 AS rank FROM p) SELECT lang, source, round(prob, 6) AS prob, rank FROM r, c WHERE rank = 1 OR prob >= cut - 1e-12")
def lca_class_assign(spark, sf):
    n = read(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    p = n.select("lang", "source", (F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("prob")).withColumn("method", F.lit("m"))
    return models.class_contexts(p, cls="lang").select("lang", "source", F.round("prob", 6).alias("prob"), "rank")


def label_items(spark, sf):
    lab, docs = read(spark, sf, "labels"), read(spark, sf, "documents")
    d = docs.select("doc_id", (F.col("lang") == "en").cast("int").alias("english"), (F.col("n_chars") > 1500).cast("int").alias("long"), F.col("text").contains("the").cast("int").alias("the"))
    return lab.join(d, "doc_id").select("doc_id", "quality", "toxic", "english", "long", "the")


@query()
def glm_logit(spark, sf):
    out = models.logistic_regressions(label_items(spark, sf), ["quality", "toxic"], ["long", "the"])
    return out.select("outcome", "term", *(F.round(c, 4).alias(c) for c in ("estimate", "std_error", "p_value")), "stars")


@query()
def lda_loadings(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return models.document_loadings(docs, ["doc_id"], "text", 4)


@query()
def lca_em(spark, sf):
    fits, _, _ = models.latent_classes(label_items(spark, sf), ["quality", "toxic", "english", "long"], [2, 3], 4, 300)
    return fits


from lexloom.plans import source_queries, study_queries  # noqa: E402, F401  (they register their queries here)
