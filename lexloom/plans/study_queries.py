"""Queries of whole studies: resampling, null distributions, artificial corpora, segmentation results, coding, plot data."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import stats, text
from lexloom.operators import agreement, contexts, descriptives, gibbs_topics, models, ngrams, resample, segment, structural_topics, topic_map, topic_search, translate, windows
from lexloom.plans import analysis
from lexloom.plans.queries import EV, PAIR, TAGS, TOK, TURN, UNSURE, bigram_sql, dictionary_words, event_hits, event_shares, label_items, marked_tags, query, read, segment_sql, segmented, tags, turn_tokens, units_sql
from lexloom.scratch import Scratch

BENCHMARK_WORDS = "bw AS (SELECT DISTINCT unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM benchmark)"
STARS = "CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' WHEN {p} < 0.1 THEN '+' ELSE '' END"


def uniform_sql(x: str) -> str:
    return f"(CAST(('0x' || substr(md5({x}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


# ------------------------------------------------------------------ resampling


DRAWS = "u AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS place, m FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id)), n AS (SELECT count(*) AS n FROM u), d AS (SELECT copy, draw, m FROM (SELECT copy, draw, CAST(floor({u} * n) AS BIGINT) AS place FROM (SELECT unnest(range({copies})) AS copy), (SELECT unnest(range({size})) AS draw), n) JOIN u USING (place))"


@query("WITH " + DRAWS.format(u=uniform_sql("'s|' || copy || '|' || draw"), copies=20, size=100) + " SELECT copy, round(avg(m), 9) AS mean, count(*) AS n FROM d GROUP BY copy")
def bootstrap_draws(spark, sf):
    users = read(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    numbered = stats.global_rank(users, [F.col("user_id")], "at").withColumn("at", F.col("at") - 1)
    return resample.bootstrap(numbered, "at", 20, 100).groupBy("copy").agg(F.round(F.avg("m"), 9).alias("mean"), F.count("*").alias("n"))


@query("WITH " + DRAWS.format(u=uniform_sql("'s|' || copy || '|' || draw"), copies=5, size=60) + """, w AS (SELECT avg(m) AS m, quantile_cont(m, 0.975) AS hi, quantile_cont(m, 0.025) AS lo FROM u),
r AS (SELECT copy, draw, row_number() OVER o AS iteration, avg(d.m) OVER o AS running_mean, CASE WHEN row_number() OVER o >= 39 THEN quantile_cont(d.m, 0.975) OVER o END AS hi, CASE WHEN row_number() OVER o >= 39 THEN quantile_cont(d.m, 0.025) OVER o END AS lo FROM d WINDOW o AS (PARTITION BY copy ORDER BY draw ROWS UNBOUNDED PRECEDING))
SELECT copy, draw, iteration, round(running_mean, 6) AS running_mean, round(r.hi, 6) AS hi, round(r.lo, 6) AS lo, abs(running_mean - w.m) <= 2 AS running_mean_stable, abs(r.hi - w.hi) <= 2 AS hi_stable, abs(r.lo - w.lo) <= 2 AS lo_stable FROM r, w""")
def resampling_convergence(spark, sf):
    users = read(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    d = analysis.convergence(users, "m", 5, 60, "user_id", tol=2.0)
    return d.select("copy", "draw", F.col("iteration").cast("long").alias("iteration"), *(F.round(c, 6).alias(c) for c in ("running_mean", "hi", "lo")), "running_mean_stable", "hi_stable", "lo_stable")


@query("""WITH s AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS value FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS r FROM s),
g AS (SELECT iter, user_id, event_type, row_number() OVER (PARTITION BY iter, event_type ORDER BY md5('s|' || iter || '|' || event_type || '|' || user_id), user_id) AS r FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(3)) AS iter), (SELECT DISTINCT event_type FROM k))
SELECT iter, g.user_id, event_type, round(value, 9) AS value FROM g JOIN k USING (event_type, r)""")
def permutation_of_shares(spark, sf):
    return resample.permute(event_shares(spark, sf), read(spark, sf, "events"), ["user_id"], 3, name="event_type").select("iter", "user_id", "event_type", F.round("value", 9).alias("value"))


@query("SELECT event_id, row_number() OVER (ORDER BY md5('s|' || event_id), event_id) AS place FROM events")
def shuffled_order(spark, sf):
    return resample.shuffled(read(spark, sf, "events").select("event_id"), ["event_id"])


@query(f"WITH {TOK} SELECT conv_id, count(*) AS n, count(CASE WHEN {uniform_sql("'s|' || conv_id")} < 0.1 AND {uniform_sql("'st|' || conv_id || '|' || turn || '|' || i")} < 0.5 THEN 1 END) AS held_out FROM tok GROUP BY conv_id")
def held_out_tokens(spark, sf):
    marked = resample.hold_out(turn_tokens(spark, sf), ["conv_id"], ["turn", "i"])
    return marked.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if("held_out").alias("held_out"))


def measures_sql(source: str, by: str, name: str) -> str:
    """The descriptives of a token table, a row per measure."""
    return f"""l_{name} AS (SELECT {by}, count(*) AS n_utts, avg(k) AS mean_per_utt, avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END) AS prop_one FROM (SELECT {by}, conv_id, turn, count(*) AS k FROM {source} GROUP BY ALL) GROUP BY ALL),
    f_{name} AS (SELECT {by}, CAST(sum(f) AS BIGINT) AS n_tokens, count(*) AS n_types, max(f) AS highest_freq FROM (SELECT {by}, w, count(*) AS f FROM {source} GROUP BY ALL) GROUP BY ALL),
    {name} AS (SELECT {by}, unnest(['n_utts', 'n_tokens', 'n_types', 'highest_freq', 'ttr', 'prop_highest', 'mean_per_utt', 'prop_one']) AS measure, unnest([CAST(n_utts AS DOUBLE), n_tokens, n_types, highest_freq, n_types / n_tokens, highest_freq / n_tokens, mean_per_utt, prop_one]) AS value FROM l_{name} JOIN f_{name} USING ({by}))"""


def nulls_sql(iters: int) -> str:
    return f"""{TAGS}, sizes AS (SELECT context, count(*) AS n FROM tags GROUP BY context),
dealt AS (SELECT iter, conv_id, turn, context FROM (SELECT iter, conv_id, turn, context, n, row_number() OVER (PARTITION BY iter, context ORDER BY md5('s|' || iter || '|' || context || '|' || conv_id || '|' || turn), conv_id, turn) AS r FROM (SELECT DISTINCT conv_id, turn FROM tok), (SELECT unnest(range({iters})) AS iter), sizes) WHERE r <= n),
seen_tok AS (SELECT context, conv_id, turn, w FROM tags JOIN tok USING (conv_id, turn)), null_tok AS (SELECT iter, context, conv_id, turn, w FROM dealt JOIN tok USING (conv_id, turn)),
{measures_sql("seen_tok", "context", "seen")}, {measures_sql("null_tok", "iter, context", "drawn")},
vals AS (SELECT iter, context, measure, d.value, s.value AS est FROM drawn d JOIN seen s USING (context, measure)),
tests AS (SELECT *, n_above / iters AS p_hi, n_below / iters AS p_lo FROM (SELECT context, measure, count(*) AS iters, count(CASE WHEN value >= est THEN 1 END) AS n_above, count(*) - count(CASE WHEN value >= est THEN 1 END) AS n_below FROM vals GROUP BY ALL))"""


def nulls_of(spark, sf, iters):
    scratch = Scratch(spark, "nulls")
    words = text.tokens(text.letters(F.col("text")))
    # turns are dealt to all cores before texts are taken apart, however few row groups the table has
    dealt = read(spark, sf, "conversations").select(*TURN, "text").repartition(3 * max(1, spark.sparkContext.defaultParallelism), *TURN)
    said = scratch.put(dealt.withColumn("words", words), "said")
    marks = scratch.put(marked_tags(spark, sf, said), "marks")
    seen = analysis.observed_descriptives(said, marks, TURN, "words")
    return analysis.compare_with_null(seen, analysis.null_descriptives(said, marks, TURN, "words", iters))


@query(f"WITH {nulls_sql(5000)} SELECT context, measure, iters, n_above, n_below, round(p_hi, 6) AS p_hi, round(p_lo, 6) AS p_lo, round(least(p_hi, p_lo), 6) AS p_val, round({UNSURE}, 6) AS p_boot_unsure, {STARS.format(p='greatest(least(p_hi, p_lo), 1 / iters)')} AS stars FROM tests")
def null_descriptives(spark, sf):
    tests = nulls_of(spark, sf, 5000)[1]
    return tests.select("context", "measure", "iters", "n_above", "n_below", *(F.round(c, 6).alias(c) for c in ("p_hi", "p_lo", "p_val", "p_boot_unsure")), "stars")


@query(f"""WITH {nulls_sql(20)}, z AS (SELECT iter, context, (value - avg(value) OVER g) / nullif(stddev_samp(value) OVER g, 0) AS null_z, (est - avg(value) OVER g) / nullif(stddev_samp(value) OVER g, 0) AS z FROM vals WHERE measure = 'ttr' WINDOW g AS (PARTITION BY context))
SELECT z.context, iter, round(null_z, 6) AS null_z, round(z, 6) AS z, round(least(p_hi, p_lo), 6) AS p_val, {STARS.format(p='greatest(least(p_hi, p_lo), 1 / iters)')} AS stars FROM z JOIN tests t ON t.context = z.context AND t.measure = 'ttr'""")
def against_nontext(spark, sf):
    d = analysis.against_nontext(*nulls_of(spark, sf, 20), "ttr")
    return d.select("context", "iter", *(F.round(c, 6).alias(c) for c in ("null_z", "z", "p_val")), "stars")


@query(f"WITH {nulls_sql(20)}, z AS (SELECT context, measure, (any_value(est) - avg(value)) / nullif(stddev_samp(value), 0) AS z FROM vals GROUP BY ALL) SELECT context, round(max(CASE WHEN measure = 'n_types' THEN z END), 6) AS n_types, round(max(CASE WHEN measure = 'ttr' THEN z END), 6) AS ttr FROM z GROUP BY context")
def mean_z_by_measure(spark, sf):
    d = descriptives.measure_means(nulls_of(spark, sf, 20)[0], ["context"], ["n_types", "ttr"])
    return d.select("context", F.round("n_types", 6).alias("n_types"), F.round("ttr", 6).alias("ttr"))


# ------------------------------------------------------------------ artificial corpora


def quoted_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def corpus_sql(n: int, utts: int, skewed: bool, sizes: tuple[int, int, int]) -> str:
    """dictionary (word, phon, n_syl, freq) and said (utt, orth, phon)."""
    per, c, v = sum(sizes), quoted_list(resample.CONSONANTS), quoted_list(resample.VOWELS)
    freq = f"round_even({utts * 4} / (SELECT sum(1 / (i + 1)) FROM range({n}) r(i)) / rank, 0)" if skewed else f"round_even({utts * 4} / {n}, 0)"
    return f"""syl AS (SELECT syl, row_number() OVER (ORDER BY md5('s|' || syl), syl) - 1 AS place FROM (SELECT o || v || c AS syl FROM (SELECT unnest({c}) AS o), (SELECT unnest({v}) AS v), (SELECT unnest({c}) AS c))),
    made AS (SELECT made, [{sizes[0]}, {sizes[1]}, {sizes[2]}][made % 3 + 1] AS n_syl, made // 3 * {per} + [0, {sizes[0]}, {sizes[0] + sizes[1]}][made % 3 + 1] AS first FROM range({n}) r(made)),
    formed AS (SELECT made, n_syl, string_agg(syl, '-' ORDER BY place) AS phon FROM made JOIN syl ON place >= first AND place < first + n_syl GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (ORDER BY md5('sr|' || phon), phon) AS rank FROM formed),
    dictionary AS (SELECT replace(phon, '-', '') AS word, phon, CAST(n_syl AS INTEGER) AS n_syl, CAST({freq} AS BIGINT) AS freq FROM ranked),
    spoken AS (SELECT word, phon, row_number() OVER (ORDER BY md5('su|' || word || '|' || copy), word, copy) - 1 AS place FROM (SELECT word, phon, unnest(range(1, freq + 1)) AS copy FROM dictionary)),
    total AS (SELECT count(*) AS n, CAST(ceil(count(*) / 4) AS BIGINT) AS utts FROM spoken),
    placed AS (SELECT phon, place, CASE WHEN place < (n % utts) * (n // utts + 1) THEN place // (n // utts + 1) ELSE n % utts + (place - (n % utts) * (n // utts + 1)) // (n // utts) END + 1 AS no FROM spoken, total),
    said AS (SELECT 'utt' || no AS utt, string_agg(replace(phon, '-', ''), ' ' ORDER BY place) AS orth, string_agg(phon, ' ' ORDER BY place) AS phon FROM placed GROUP BY no)"""


@query(f"WITH {corpus_sql(1200, 1000, True, (2, 3, 4))} SELECT word, phon, n_syl, freq FROM dictionary")
def artificial_words(spark, sf):
    return resample.make_corpus(spark)[0]


@query(f"WITH {corpus_sql(900, 1000, False, (1, 2, 3))} SELECT utt, orth, phon FROM said")
def artificial_utterances(spark, sf):
    return resample.make_corpus(spark, 900, 1000, skewed=False, monosyllabic=True)[1]


SCORED = """t AS (SELECT role, phon, any_value(n_syl) AS n_syl, count(*) AS unit_freq FROM units GROUP BY role, phon),
j AS (SELECT coalesce(d.role, t.role) AS role, d.word, coalesce(d.phon, t.phon) AS phon, coalesce(d.n_syl, t.n_syl) AS n_syl, CASE WHEN d.word IS NULL THEN 'false.alarm' WHEN t.phon IS NULL THEN 'miss' ELSE 'hit' END AS result FROM d FULL JOIN t ON d.role = t.role AND d.phon = t.phon AND d.n_syl = t.n_syl),
s AS (SELECT role, count(CASE WHEN result = 'hit' THEN 1 END) AS hits, count(CASE WHEN result = 'miss' THEN 1 END) AS misses, count(CASE WHEN result = 'false.alarm' THEN 1 END) AS false_alarms, count(DISTINCT CASE WHEN result = 'hit' THEN phon END) AS units_hit FROM j GROUP BY role)"""


@query(f"""WITH {corpus_sql(1200, 1000, True, (2, 3, 4))}, tok AS (SELECT 'a' AS role, utt AS conv_id, 0 AS turn, unnest(range(len(x))) AS i, unnest(x) AS w FROM (SELECT utt, string_split(replace(phon, '-', ' '), ' ') AS x FROM said)), {PAIR}, {bigram_sql("role")}, {units_sql("tp")}, d AS (SELECT 'a' AS role, word, phon, n_syl FROM dictionary WHERE freq > 0), {SCORED}
SELECT hits, misses, false_alarms, round(hits / (hits + misses), 6) AS recall, round(units_hit / (units_hit + false_alarms), 6) AS precision FROM s""")
def artificial_corpus(spark, sf):
    scratch = Scratch(spark, "artificial")
    dictionary, utts = resample.make_corpus(spark)
    dictionary = scratch.put(dictionary.where("freq > 0"), "dictionary")
    tok = scratch.put(utts.select("utt", F.posexplode(text.syllables(F.col("phon"))).alias("i", "w")), "tokens")
    table = ngrams.bigram_table(windows.bigrams(tok, ["utt"], "i", "w"))
    found = segment.unit_table(segment.units(segment.boundaries(tok, table, [], ["utt"], "i", "w"), [], ["utt"], "i", "w"), [])
    s = segment.scores(segment.assess(found, dictionary.withColumn("n_syl", F.col("n_syl").cast("long")), []), [])
    return s.select("hits", "misses", "false_alarms", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


# ------------------------------------------------------------------ segmentation results


@query(f"WITH {segment_sql('tp', True)} SELECT role, conv_id, turn, unit_no, phon, n_syl FROM units")
def segment_frequency_rule(spark, sf):
    return segmented(spark, sf, "tp", frequency_rule=True).select("role", *TURN, F.col("unit_no").cast("long").alias("unit_no"), "phon", "n_syl")


@query(f"WITH {segment_sql('tp')}, t AS (SELECT role, phon, any_value(n_syl) AS n_syl, count(*) AS unit_freq FROM units GROUP BY role, phon), f AS (SELECT role, w, count(*) AS f FROM tok GROUP BY ALL) SELECT t.role, phon, n_syl, unit_freq FROM t LEFT JOIN f ON f.role = t.role AND w = phon WHERE (n_syl <> 1 OR f >= 40) AND (n_syl < 3 OR unit_freq >= 2) AND n_syl < 4")
def segment_filters(spark, sf):
    """The frequency filters of short and long units, and the limit of three syllables."""
    syl = turn_tokens(spark, sf).groupBy("role", F.col("w").alias("phon")).agg(F.count("*").alias("freq"))
    rare = segment.unit_table(segmented(spark, sf, "tp"), ["role"])
    rare = rare.join(syl, ["role", "phon"], "left").where("n_syl <> 1 or freq >= 40").drop("freq")  # a cutoff of its own for syllables
    return segment.unit_table(rare.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("unit_freq").cast("int")))), ["role"], None, 2, True).select("role", "phon", "n_syl", "unit_freq")


@query(f"WITH {segment_sql('mi')}, t AS (SELECT role, phon, any_value(n_syl) AS n_syl, count(*) AS unit_freq FROM units GROUP BY role, phon), f AS (SELECT role, w, count(*) AS f FROM tok GROUP BY ALL) SELECT t.role, phon, n_syl, unit_freq FROM t LEFT JOIN f ON f.role = t.role AND w = phon WHERE (n_syl <> 1 OR f >= 20) AND (n_syl < 3 OR unit_freq >= 20)")
def segment_frequency_filter(spark, sf):
    syl = turn_tokens(spark, sf).groupBy("role", F.col("w").alias("phon")).agg(F.count("*").alias("freq"))
    return segment.unit_table(segmented(spark, sf, "mi"), ["role"], syl, 20).select("role", "phon", "n_syl", "unit_freq")


ROLES = TAGS.replace("tok AS", "tok0 AS").replace("FROM tok", "FROM tok0")
RUN = f"""{ROLES}, wtok AS (SELECT context AS role, conv_id, turn, i, w FROM tok0 JOIN tags USING (conv_id, turn)),
tok AS (SELECT role, conv_id, turn, 2 * i + unnest(range(len(s))) AS i, unnest(s) AS w FROM (SELECT role, conv_id, turn, i, CASE WHEN length(w) > 3 THEN [substr(w, 1, 2), substr(w, 3)] ELSE [w] END AS s FROM wtok)), {PAIR}, {bigram_sql("role")}, {BENCHMARK_WORDS},
d AS (SELECT role, w AS word, CASE WHEN length(w) > 3 THEN substr(w, 1, 2) || '-' || substr(w, 3) ELSE w END AS phon, CASE WHEN length(w) > 3 THEN 2 ELSE 1 END AS n_syl FROM wtok WHERE w IN (SELECT w FROM bw) GROUP BY role, w), {units_sql("tp", name="_tp")}, {units_sql("mi", name="_mi")},
t AS (SELECT stat, role, phon, any_value(n_syl) AS n_syl FROM (SELECT 'tp' AS stat, role, phon, n_syl FROM units_tp UNION ALL SELECT 'mi', role, phon, n_syl FROM units_mi) GROUP BY stat, role, phon),
d2 AS (SELECT stat, d.* FROM d, (SELECT unnest(['tp', 'mi']) AS stat)),
j AS (SELECT coalesce(d2.stat, t.stat) AS stat, coalesce(d2.role, t.role) AS role, t.phon AS unit, CASE WHEN d2.word IS NULL THEN 'false.alarm' WHEN t.phon IS NULL THEN 'miss' ELSE 'hit' END AS result FROM d2 FULL JOIN t ON d2.stat = t.stat AND d2.role = t.role AND d2.phon = t.phon AND d2.n_syl = t.n_syl),
s AS (SELECT stat, role, count(CASE WHEN result = 'hit' THEN 1 END) AS hits, count(CASE WHEN result = 'miss' THEN 1 END) AS misses, count(CASE WHEN result = 'false.alarm' THEN 1 END) AS false_alarms, count(DISTINCT unit) AS n_segd_units, count(DISTINCT CASE WHEN result = 'hit' THEN unit END) AS units_hit FROM j GROUP BY ALL),
lw AS (SELECT role, count(*) AS n_utts, avg(k) AS words_per_utt, avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END) AS prop_one_word FROM (SELECT role, conv_id, turn, count(*) AS k FROM wtok GROUP BY ALL) GROUP BY role),
ls AS (SELECT role, avg(k) AS syls_per_utt, avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END) AS prop_one_syl FROM (SELECT role, conv_id, turn, count(*) AS k FROM tok GROUP BY ALL) GROUP BY role),
cw AS (SELECT role, CAST(sum(f) AS BIGINT) AS n_tokens, count(*) AS n_types FROM (SELECT role, w, count(*) AS f FROM wtok GROUP BY ALL) GROUP BY role),
cs AS (SELECT role, CAST(sum(f) AS BIGINT) AS n_syl_tokens, count(*) AS n_syl_types FROM (SELECT role, w, count(*) AS f FROM tok GROUP BY ALL) GROUP BY role),
b AS (SELECT role, CAST(greatest(max(a1), max(b2)) AS BIGINT) AS highest, avg(tp) AS tp, avg(mi) AS mi FROM big GROUP BY role),
res AS (SELECT role AS context, stat, hits / (hits + misses) AS recall, units_hit / (units_hit + false_alarms) AS precision, hits, misses, false_alarms, n_segd_units, n_utts, n_syl_tokens, n_syl_types, n_tokens, n_types, n_types / n_tokens AS ttr, highest, highest / n_syl_tokens AS prop_highest, b.tp AS mean_tp, b.mi AS mean_mi, words_per_utt, syls_per_utt, prop_one_word, prop_one_syl FROM s JOIN lw USING (role) JOIN ls USING (role) JOIN cw USING (role) JOIN cs USING (role) JOIN b USING (role))"""


def form_of(word):
    """A form of two syllables for words of more than three letters."""
    return F.when(F.length(word) > 3, F.concat(F.substring(word, 1, 2), F.lit("-"), F.substr(word, F.lit(3)))).otherwise(word)


def analysed(spark, sf, **options):
    c = read(spark, sf, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("utt"), F.col("conv_id").alias("file"), F.col("turn").alias("pos"), text.letters(F.col("text")).alias("orth"))
    t = tags(spark, sf).select(F.concat_ws("_", "conv_id", "turn").alias("utt"), "context", (F.col("value") > 0).cast("int").alias("value"))  # windows spread marks of 1
    d = dictionary_words(spark, sf).select(F.col("w").alias("word"), form_of(F.col("w")).alias("phon"))
    return analysis.run_analysis(c.withColumn("phon", F.array_join(F.transform(text.tokens(F.col("orth")), form_of), " ")), t, d, **options)


RUN_COLUMNS = "SELECT context, stat, round(recall, 6) AS recall, round(precision, 6) AS precision, hits, misses, false_alarms, n_segd_units, n_utts, n_syl_tokens, n_syl_types, n_tokens, n_types, round(ttr, 6) AS ttr, highest AS highest_freq_syl, round(prop_highest, 6) AS prop_most_freq, round(mean_tp, 6) AS mean_tp, round(mean_mi, 6) AS mean_mi, round(words_per_utt, 6) AS mean_words_per_utt, round(syls_per_utt, 6) AS mean_syls_per_utt, round(prop_one_word, 6) AS prop_one_word_utt, round(prop_one_syl, 6) AS prop_one_syl_utt FROM res"


def rounded(d):
    return d.select(*(F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in d.schema))


@query(f"WITH {RUN} {RUN_COLUMNS}")
def run_analysis(spark, sf):
    return rounded(analysed(spark, sf))


def run_over(chosen: str) -> str:
    """RUN with other marks: ``chosen`` defines them, from tags."""
    return RUN.replace("wtok AS", f"{chosen}, wtok AS", 1).replace("tok0 JOIN tags", "tok0 JOIN chosen", 1)


DEALT = """sizes AS (SELECT context, count(*) AS n FROM tags GROUP BY context), chosen AS (SELECT conv_id, turn, context FROM (SELECT conv_id, turn, context, n, row_number() OVER (PARTITION BY context ORDER BY md5('s1|0|' || context || '|' || conv_id || '_' || turn), conv_id || '_' || turn) AS r FROM (SELECT DISTINCT conv_id, turn FROM conversations), sizes) WHERE r <= n)"""
SPREAD = """chosen AS (SELECT DISTINCT o.conv_id, o.turn, context FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) o JOIN (SELECT conv_id, place, context FROM tags JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) USING (conv_id, turn)) m ON m.conv_id = o.conv_id AND m.place BETWEEN o.place - 1 AND o.place + 1)"""


@query(f"WITH {run_over(DEALT)} {RUN_COLUMNS}")
def run_analysis_permuted(spark, sf):
    """All contexts dealt to random utterances."""
    return rounded(analysed(spark, sf, permute=1))


@query(f"WITH {run_over(SPREAD)} {RUN_COLUMNS}")
def run_analysis_expanded(spark, sf):
    """Contexts spread to the utterances before and after."""
    return rounded(analysed(spark, sf, expand=1))


@query(f"WITH {RUN} SELECT context, upper(stat) AS criterion, n_utts, n_tokens, n_types, n_segd_units, hits, misses, false_alarms, CASE WHEN n_tokens > n_segd_units THEN 'under' WHEN n_tokens < n_segd_units THEN 'over' END AS trend, round(abs(n_tokens - n_segd_units) / n_tokens, 6) AS prop_diff FROM res")
def results_descriptives(spark, sf):
    return analysis.results_descriptives(analysed(spark, sf)).withColumn("prop_diff", F.round("prop_diff", 6))


@query(f"WITH {RUN}, x AS (SELECT CASE WHEN stat = 'tp' THEN 'SizeSkew' ELSE 'a.b' END AS exp, * FROM res) SELECT exp, CASE WHEN exp = 'SizeSkew' THEN 'skew' END AS dist, context, stat || '85' AS criterion, stat, unnest(['recall', 'precision']) AS measure, round(unnest([recall, precision]), 6) AS value FROM x")
def clean_results(spark, sf):
    named = analysed(spark, sf).withColumn("exp", F.when(F.col("stat") == "tp", "SizeSkew").otherwise("a.b"))
    return analysis.clean_results(named).withColumn("value", F.round("value", 6))


# ------------------------------------------------------------------ streams and windows


@query(f"WITH {TOK}, p AS (SELECT w AS a, lead(w) OVER (ORDER BY conv_id, turn, i) AS b FROM tok) SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b")
def stream_bigrams(spark, sf):
    """Bigrams of one stream, across utterances."""
    return windows.stream_bigrams(turn_tokens(spark, sf), [*TURN, "i"], "w").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SELECT (pos - 1) // 30 AS window, count(*) AS n, string_agg(event_type, ' ' ORDER BY pos) AS text FROM (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events) GROUP BY ALL")
def global_tumbling_30(spark, sf):
    e = windows.global_tumbling(read(spark, sf, "events").select("ts", "event_id", "event_type").withColumn("order", F.struct("ts", "event_id")), ["ts", "event_id"])
    return windows.window_text(e, ["window"], "order", "event_type")


@query(f"""WITH {EV}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id), s AS (SELECT user_id, n, least(CAST(floor({uniform_sql("'s|' || user_id")} * 10) AS INTEGER) * 3 + 1, n) AS start FROM n),
w AS (SELECT user_id, start, CAST(f AS INTEGER) AS first, least(f + 29, n) AS last FROM (SELECT user_id, n, start, unnest(range(start, n + 1, 30)) AS f FROM s)),
o AS (SELECT w.user_id, first, last, last - first + 1 - (SELECT count(*) FROM ev WHERE ev.user_id = w.user_id AND hit = 0 AND pos BETWEEN first AND last) AS open FROM w) SELECT user_id, first, last, open FROM o WHERE open > 0""")
def coding_windows(spark, sf):
    """Events that aren't errors count as coded; windows with an error are open."""
    e = event_hits(spark, sf)
    return windows.coding_windows(e.groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"], "n", e.where("hit = 0").select("user_id", "pos"), "pos").select("user_id", "first", "last", "open")


@query(f"WITH {EV} SELECT event_id, event_id % 6 < 1 OR max(CASE WHEN event_id % 6 < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) = 1 AS open FROM ev")
def needs_coding(spark, sf):
    """Events with fewer codes than one, and the 30 on either side of them."""
    e = event_hits(spark, sf).withColumn("n", F.col("event_id") % 6)
    return windows.needs_coding(e, ["user_id"], ["pos"], "n", 1, 30).select("event_id", "open")


@query("SELECT user_id, count(DISTINCT CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END) AS n_coders FROM events WHERE event_id % 4 <> 0 GROUP BY user_id")
def coder_counts(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).otherwise("").alias("coder"))
    return contexts.coder_counts(e, ["user_id"])


@query(f"WITH {EV} SELECT user_id, (pos - 1) // 30 AS window, min(pos) AS first, min(event_id % 3) AS least, round(avg(event_id % 3), 6) AS mean, count(CASE WHEN event_id % 3 = 0 THEN 1 END) AS open FROM ev GROUP BY ALL")
def coding_progress(spark, sf):
    d = analysis.coding_progress(event_hits(spark, sf).withColumn("n", F.col("event_id") % 3), ["user_id"], "pos", "n")
    return d.withColumn("mean", F.round("mean", 6))


# ------------------------------------------------------------------ plot data


@query(f"WITH {TOK} SELECT w, count(*) AS freq FROM tok GROUP BY w HAVING count(*) >= 5")
def word_cloud(spark, sf):
    return analysis.word_cloud(turn_tokens(spark, sf), "w", 5)


@query(f"WITH {TAGS} SELECT conv_id, turn, context, 1 AS value, 'kw' AS method FROM tags WHERE context IN (SELECT context FROM tags GROUP BY context HAVING count(*) > 100)")
def sequence_marks(spark, sf):
    return analysis.sequence_marks(marked_tags(spark, sf).withColumn("method", F.lit("kw")), "kw", 100).select(*TURN, "context", F.col("value").cast("int").alias("value"), "method")


@query(f"WITH {segment_sql('tp')}, {BENCHMARK_WORDS}, t AS (SELECT role, phon, any_value(n_syl) AS n_syl, count(*) AS unit_freq FROM units GROUP BY role, phon), d AS (SELECT role, w AS phon, 1 AS n_syl, count(*) AS freq FROM tok WHERE w IN (SELECT w FROM bw) GROUP BY role, w), j AS (SELECT coalesce(d.role, t.role) AS role, coalesce(d.phon, t.phon) AS phon, coalesce(d.n_syl, t.n_syl) AS n_syl, CASE WHEN d.phon IS NULL THEN 'false.alarm' WHEN t.phon IS NULL THEN 'miss' ELSE 'hit' END AS result, CASE WHEN t.phon IS NULL THEN d.freq ELSE unit_freq END AS freq FROM d FULL JOIN t ON d.role = t.role AND d.phon = t.phon AND d.n_syl = t.n_syl) SELECT role, phon, CAST(n_syl AS BIGINT) AS n_syl, result, freq, row_number() OVER (PARTITION BY role, result ORDER BY freq DESC, phon) AS rank FROM j")
def segmentation_points(spark, sf):
    table = segment.unit_table(segmented(spark, sf, "tp"), ["role"])
    words = turn_tokens(spark, sf).join(dictionary_words(spark, sf), "w", "left_semi").groupBy("role", "w").agg(F.count("*").alias("freq"))
    d = words.select("role", F.col("w").alias("word"), F.col("w").alias("phon"), F.lit(1).cast("long").alias("n_syl"), "freq")
    return analysis.segmentation_points(segment.assess(table, d, ["role"]), ["role"]).withColumn("rank", F.col("rank").cast("long"))


# ------------------------------------------------------------------ agreement and models


ITEMS = "i AS (SELECT quality, toxic, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS english, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS long FROM labels JOIN documents USING (doc_id))"


def pair_sql(x: str, y: str) -> str:
    return f"coalesce(count(*) * pow(count(*) * sum({x} * {y}) - sum({x}) * sum({y}), 2) / nullif(sum({x}) * sum({y}) * (count(*) - sum({x})) * (count(*) - sum({y})), 0), 0)"


@query(f"WITH {ITEMS} SELECT round({' + '.join(pair_sql(x, y) for x in ('quality', 'toxic') for y in ('english', 'long'))}, 6) AS statistic, count(*) AS n FROM i")
def mrcv_statistic(spark, sf):
    d = agreement.multiple_response_statistic(label_items(spark, sf), ["quality", "toxic"], ["english", "long"])
    return d.select(F.round("statistic", 6).alias("statistic"), "n")


DRAWN = ", ".join(
    f"r{s} AS (SELECT {x}, {y}, sum(count(*)) OVER (ORDER BY {x}, {y}) AS high, sum(count(*)) OVER (ORDER BY {x}, {y}) - count(*) AS low FROM i GROUP BY {x}, {y})"
    for s, x, y in (("l", "quality", "toxic"), ("r", "english", "long"))
)


@query(f"""WITH {ITEMS}, {DRAWN}, n AS (SELECT count(*) AS n FROM i), d AS (SELECT iter, unnest(range((SELECT n FROM n))) AS draw FROM (SELECT unnest(range(200)) AS iter)),
p AS (SELECT iter, floor({uniform_sql("'s|l|' || iter || '|' || draw")} * n) AS pl, floor({uniform_sql("'s|r|' || iter || '|' || draw")} * n) AS pr FROM d, n),
x AS (SELECT iter, quality, toxic, english, long FROM p JOIN rl ON pl >= rl.low AND pl < rl.high JOIN rr ON pr >= rr.low AND pr < rr.high),
z AS (SELECT iter, {' + '.join(pair_sql(x, y) for x in ('quality', 'toxic') for y in ('english', 'long'))} AS statistic FROM x GROUP BY iter),
seen AS (SELECT {' + '.join(pair_sql(x, y) for x in ('quality', 'toxic') for y in ('english', 'long'))} AS statistic, count(*) AS n FROM i)
SELECT round(any_value(seen.statistic), 6) AS statistic, any_value(seen.n) AS n, count(*) AS iters, round((count(CASE WHEN z.statistic >= seen.statistic * (1 - 1e-9) THEN 1 END) + 1) / (count(*) + 1), 6) AS p_value FROM z, seen""")
def mrcv(spark, sf):
    d = agreement.multiple_response_test(label_items(spark, sf), ["quality", "toxic"], ["english", "long"])
    return d.select(F.round("statistic", 6).alias("statistic"), "n", "iters", F.round("p_value", 6).alias("p_value"))


def chi_tail_sql(chi2: str, dof: str) -> str:
    """The upper tail of chi-square by the series of the lower one."""
    a, x = f"({dof} / 2)", f"({chi2} / 2)"
    return f"CASE WHEN {dof} < 1 OR {chi2} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - exp(-{x} + {a} * ln({x}) - lgamma({a} + 1)) * list_sum(list_transform(range(0, 400), lambda k: exp(k * ln({x}) + lgamma({a} + 1) - lgamma({a} + 1 + k))))) END"


def beta_sql(x: str, a: str, b: str) -> str:
    """The regularised incomplete beta function by its hypergeometric series."""
    series = lambda x, a, b: f"exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) - ln({a})) * list_sum(list_transform(range(0, 4000), lambda k: exp(lgamma({a} + {b} + k) - lgamma({a} + {b}) - lgamma({a} + 1 + k) + lgamma({a} + 1) + k * ln({x}))))"
    return f"CASE WHEN {x} > ({a} + 1) / ({a} + {b} + 2) THEN 1 - {series(f'(1 - {x})', b, a)} ELSE {series(x, a, b)} END"


CHI = """g AS (SELECT *, sum(o) OVER (PARTITION BY grp, p) AS ra, sum(o) OVER (PARTITION BY grp, q) AS cb FROM c),
x AS (SELECT grp, CAST(sum(o) AS BIGINT) AS total, greatest(0.0, sum(o) * (sum(o * o / (ra * cb)) - 1)) AS chi2, (count(DISTINCT p) - 1) * (count(DISTINCT q) - 1) AS dof, least(count(DISTINCT p), count(DISTINCT q)) - 1 AS least FROM g GROUP BY grp),
y AS (SELECT *, """ + chi_tail_sql("chi2", "dof") + """ AS p_value, sqrt(chi2 / nullif(total * least, 0)) AS v FROM x)"""
REPORT = "'chi2(' || dof || ', N = ' || total || ') = ' || printf('%.2f', chi2) || ', ' || CASE WHEN p_value < 0.001 THEN 'p < .001' ELSE printf('p = %.3f', p_value) END || coalesce(', V = ' || printf('%.2f', v), '')"


@query(f"WITH c AS (SELECT 1 AS grp, quality AS p, toxic AS q, count(*) AS o FROM labels GROUP BY ALL), {CHI} SELECT {REPORT} AS report FROM y")
def chi_square_report(spark, sf):
    return agreement.chi_square(agreement.crosstab(read(spark, sf, "labels"), "quality", "toxic"), "quality", "toxic").select("report")


@query(f"WITH c AS (SELECT source AS grp, lang AS p, quality AS q, count(*) AS o FROM labels JOIN documents USING (doc_id) GROUP BY ALL), {CHI} SELECT grp AS source, round(chi2, 6) AS chi2, dof, total, round(v, 6) AS cramers_v, round(p_value, 6) AS p_value, {REPORT} AS report FROM y")
def chi_square_by_source(spark, sf):
    """Language against quality, a table for each source, all at once."""
    cells = read(spark, sf, "labels").join(read(spark, sf, "documents"), "doc_id").groupBy("source", "lang", "quality").agg(F.count("*").alias("n"))
    d = agreement.chi_square(cells, "lang", "quality", by=["source"])
    return d.select("source", F.round("chi2", 6).alias("chi2"), "dof", "total", F.round("cramers_v", 6).alias("cramers_v"), F.round("p_value", 6).alias("p_value"), "report")


@query(f"""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events WHERE value IS NOT NULL), r AS (SELECT user_id, count(*) AS n, corr(pos, value) AS r FROM e GROUP BY user_id HAVING count(*) > 2),
t AS (SELECT *, r * sqrt(n - 2) / sqrt(1 - r * r) AS t FROM r), b AS (SELECT *, (n - 2) / (n - 2 + t * t) AS x, (n - 2) / 2 AS a FROM t) SELECT user_id, n, round(r, 6) AS r, round(t, 6) AS t, round({beta_sql('x', 'a', '0.5')}, 6) AS p_value FROM b""")
def value_trend_p(spark, sf):
    """Correlations of event values with their place, with two-sided p-values."""
    e = read(spark, sf, "events").where("value is not null").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    t = stats.trend(e, ["user_id"], "pos", "value").where("n > 2")
    t = t.withColumn("p_value", stats.student_t_two_sided(F.col("t"), F.col("n") - 2.0))
    return t.select("user_id", "n", *(F.round(c, 6).alias(c) for c in ("r", "t", "p_value")))


# ------------------------------------------------------------------ dictionaries


@query(f"""WITH RECURSIVE {TOK}, l AS (SELECT conv_id, turn * 1000000 + i AS left_order, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS r FROM tok WHERE turn % 2 = 0),
rr AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS txt FROM conversations WHERE turn % 2 = 1),
run(conv_id, r, gone, hit) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM l UNION ALL
SELECT l.conv_id, l.r, any_value(run.gone) + CASE WHEN min(rr.idx) IS NULL THEN 0 ELSE 1 END, min(rr.idx) FROM run JOIN l ON l.conv_id = run.conv_id AND l.r = run.r + 1 LEFT JOIN rr ON rr.conv_id = l.conv_id AND rr.idx >= run.gone AND contains(rr.txt, l.w) GROUP BY l.conv_id, l.r)
SELECT run.conv_id, l.left_order, rr.turn AS right_order FROM run JOIN l ON l.conv_id = run.conv_id AND l.r = run.r LEFT JOIN rr ON rr.conv_id = run.conv_id AND rr.idx = run.hit""")
def greedy_match(spark, sf):
    """All words of the even turns of a conversation, matched in order with the texts of its odd turns."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", text.letters(F.col("text")).alias("t"))
    left = turn_tokens(spark, sf).where("turn % 2 = 0").select("conv_id", (F.col("turn") * 1_000_000 + F.col("i")).cast("long").alias("order"), F.col("w").alias("word"))
    right = c.where("turn % 2 = 1").select("conv_id", F.col("turn").cast("long").alias("order"), "t")
    return translate.greedy_match(left, right, ["conv_id"], "order", "word", "t")


CHAINS = f"""{TOK}, dw AS (SELECT w FROM tok WHERE length(w) > 1 GROUP BY w HAVING count(*) >= 3),
df AS (SELECT a.w AS word, CASE WHEN r.w IS NOT NULL AND r.w <> a.w THEN r.w WHEN s.w IS NOT NULL THEN s.w ELSE substr(a.w, 1, 2) || '-' || substr(a.w, 3) END AS phon FROM dw a LEFT JOIN dw r ON r.w = reverse(a.w) LEFT JOIN dw s ON s.w = substr(a.w, 1, length(a.w) - 1)),
ch(word, cur, path) AS (SELECT word, phon, [word] FROM df UNION ALL SELECT ch.word, df.phon, list_append(path, cur) FROM ch JOIN df ON df.word = ch.cur WHERE NOT list_contains(path, cur)),
closed AS (SELECT word, CASE WHEN list_contains(path, cur) THEN list_min(path[list_position(path, cur):]) ELSE cur END AS phon, CASE WHEN NOT list_contains(path, cur) THEN CAST(len(path) AS BIGINT) END AS steps FROM ch WHERE list_contains(path, cur) OR cur NOT IN (SELECT word FROM df))"""


def chained_dictionary(spark, sf):
    """A dictionary of frequent words whose forms are often words: the word backwards, the word without its last letter, or
    two syllables."""
    words = Scratch(spark, "words").put(turn_tokens(spark, sf).where(F.length("w") > 1).groupBy("w").agg(F.count("*").alias("n")).where("n >= 3").select("w"), "words")
    back, cut = words.select(F.col("w").alias("_r"), F.reverse("w").alias("w")), words.select(F.col("w").alias("_s"))
    d = words.join(back, "w", "left").join(cut, F.col("_s") == F.expr("substr(w, 1, length(w) - 1)"), "left")
    phon = F.when(F.col("_r").isNotNull() & (F.col("_r") != F.col("w")), F.col("_r")).when(F.col("_s").isNotNull(), F.col("_s")).otherwise(F.concat(F.substring("w", 1, 2), F.lit("-"), F.expr("substr(w, 3)")))
    return d.select(F.col("w").alias("word"), phon.alias("phon"))


@query(f"WITH RECURSIVE {CHAINS} SELECT word, phon, steps FROM closed")
def dictionary_closure(spark, sf):
    return translate.close_dictionary(chained_dictionary(spark, sf))


@query(f"""WITH RECURSIVE {CHAINS}, s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(lower(text), '([^a-z ]+)', ' \\1 ', 'g'), ' '), lambda x: x <> '') AS ws FROM conversations),
u AS (SELECT conv_id, turn, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM s), j AS (SELECT conv_id, turn, i, w, coalesce(closed.phon, w) AS form, closed.phon IS NULL AND w NOT IN (SELECT phon FROM closed) AND regexp_matches(w, '\\p{{L}}') AS unknown FROM u LEFT JOIN closed ON w = word)
SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS orth, string_agg(form, ' ' ORDER BY i) AS phon, count(*) AS n_tokens, count(CASE WHEN unknown THEN 1 END) AS n_unknown FROM j GROUP BY conv_id, turn HAVING count(CASE WHEN unknown THEN 1 END) <= 0.02 * count(*)""")
def translated_utterances(spark, sf):
    """Turns by the closed dictionary; those with more than 2 % of lettered tokens that are no form go, punctuation stays."""
    c = read(spark, sf, "conversations").select(*TURN, F.regexp_replace(F.lower("text"), "([^a-z ]+)", " $1 ").alias("t"))
    closed = Scratch(spark, "closed").put(translate.close_dictionary(chained_dictionary(spark, sf)), "closed")
    return translate.translate(c, TURN, "t", closed, 0.02)


@query(f"WITH {TOK}, {BENCHMARK_WORDS}, f AS (SELECT role, w, count(*) AS f FROM tok GROUP BY ALL), x AS (SELECT role, f, CASE WHEN w IN (SELECT w FROM bw) THEN 1 + length(w) // 3 END AS n_syl FROM f) SELECT role, n_syl, count(*) AS n_types, CAST(sum(f) AS BIGINT) AS total, round(avg(f), 6) AS mean, round(stddev_samp(f), 6) AS sd, round(stddev_samp(f) / sqrt(count(f)), 6) AS se FROM x GROUP BY role, n_syl")
def syllable_profile(spark, sf):
    words = dictionary_words(spark, sf).select(F.col("w").alias("word"), (1 + F.floor(F.length("w") / 3)).cast("long").alias("n_syl"))
    d = descriptives.syllable_profile(turn_tokens(spark, sf), words, ["role"], "w")
    return d.select("role", "n_syl", "n_types", "total", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "se")))


def window_vectors(spark, sf, scratch, stemmed=False):
    """(windows of 30 turns of all conversations, their turns, their vocabulary)."""
    turns = windows.tumbling(read(spark, sf, "conversations"), ["conv_id"], ["turn"], 30)
    docs = windows.window_text(turns, ["conv_id", "window"], "turn", "text")
    vectors, vocabulary = models.vectorise(docs, "text", stemmed=stemmed)
    return scratch.put(vectors.select("conv_id", "window", "counts"), "vectors"), turns, vocabulary


@query()
def utterance_loadings(spark, sf):
    """Topic loadings of windows, for each turn of the window: topics of stems, by 500 sweeps of Gibbs sampling."""
    vectors, turns, _ = window_vectors(spark, sf, Scratch(spark, "window-topics"), stemmed=True)
    loaded = gibbs_topics.fit_gibbs_topics(vectors, ["conv_id", "window"], 3, per_round=50).loadings(["conv_id", "window"])
    return models.utterance_loadings(loaded, turns.select(F.concat_ws("_", "conv_id", "turn").alias("utt"), "conv_id", "window"), ["conv_id", "window"])


@query()
def gibbs_topic_words(spark, sf):
    """The words that score highest in topics of windows."""
    vectors, _, vocabulary = window_vectors(spark, sf, Scratch(spark, "window-topics"))
    model = gibbs_topics.fit_gibbs_topics(vectors, ["conv_id", "window"], 4, 200, per_round=50)
    names = spark.createDataFrame(list(enumerate(vocabulary)), "w int, word string")  # the vocabulary is on the driver
    return topic_map.top_words(topic_map.topic_scores(model.counts.join(names, "w").select("word", "n"), 4), "score", 10)


LANGS = ["de", "en", "es", "fr"]
PHI = f"""dtok AS (SELECT lang, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '')) AS word FROM documents),
cells AS (SELECT word, topic, count(CASE WHEN lang = {quoted_list(LANGS)}[topic + 1] THEN 1 END) AS n FROM dtok, (SELECT unnest(range({len(LANGS)})) AS topic) GROUP BY word, topic),
tot AS (SELECT topic, sum(n) AS total, count(*) AS words, sum(n) / (SELECT sum(n) FROM cells) AS share FROM cells GROUP BY topic),
phi AS (SELECT word, topic, n, (n + 0.1) / (total + 0.1 * words) AS p, share, sum((n + 0.1) / (total + 0.1 * words) * share) OVER (PARTITION BY word) AS pw FROM cells JOIN tot USING (topic)),
scores AS (SELECT word, topic, x * (ln(x + 1e-5) - avg(ln(x + 1e-5)) OVER (PARTITION BY word)) AS value FROM (SELECT word, topic, n / (total + 1e-5) AS x FROM cells JOIN tot USING (topic))),
sal AS (SELECT word, any_value(pw) AS p_word, sum(p * share / pw * ln(p / pw)) AS distinctiveness FROM phi GROUP BY word),
rel AS (SELECT weight, topic, word, weight * ln(p) + (1 - weight) * ln(p / pw) AS value FROM phi, (SELECT unnest([0.0, 0.5, 1.0]) AS weight)),
relevant AS (SELECT weight, topic, row_number() OVER (PARTITION BY weight, topic ORDER BY round(value, 12) DESC, word) AS rank, word, value FROM rel QUALIFY rank <= 15)"""


def language_words(spark, sf):
    """(counts of words in the documents of each language, the languages' shares of them, number of tokens)."""
    d = read(spark, sf, "documents").select("lang", F.explode(text.tokens(text.letters(F.col("text")))).alias("word"))
    counts = Scratch(spark, "language-words").put(topic_map.topic_counts(d, "lang", "word", LANGS), "counts")
    totals, _ = topic_map.topic_totals(counts, len(LANGS))
    return counts, [t / sum(totals) for t in totals], sum(totals)


def ranked(d, *keys):
    return d.select(*keys, "topic", F.col("rank").cast("long").alias("rank"), "word", F.round("value", 9).alias("value"))


@query(f"WITH {PHI} SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY round(value, 12) DESC, word) AS rank, word, round(value, 9) AS value FROM scores QUALIFY rank <= 10")
def topic_top_words(spark, sf):
    """Words by score, with languages as topics, as in the queries that follow."""
    counts, _, _ = language_words(spark, sf)
    return ranked(topic_map.top_words(topic_map.topic_scores(counts, len(LANGS)), "score", 10))


@query(f"WITH {PHI} SELECT word, round(p_word, 9) AS p_word, round(distinctiveness, 9) AS distinctiveness, round(p_word * distinctiveness, 9) AS saliency FROM sal")
def topic_saliency(spark, sf):
    counts, parts, _ = language_words(spark, sf)
    d = topic_map.saliency(topic_map.word_shares(counts, len(LANGS)), parts)
    return d.select("word", *(F.round(c, 9).alias(c) for c in ("p_word", "distinctiveness", "saliency")))


@query(f"WITH {PHI} SELECT weight, topic, rank, word, round(value, 9) AS value FROM relevant")
def topic_relevance(spark, sf):
    counts, parts, _ = language_words(spark, sf)
    return ranked(topic_map.relevance(topic_map.word_shares(counts, len(LANGS)), parts, [0.0, 0.5, 1.0], 15), "weight")


@query(f"WITH {PHI} SELECT x.topic AS a, y.topic AS b, round(sum(x.p * ln(2 * x.p / (x.p + y.p)) / 2 + y.p * ln(2 * y.p / (x.p + y.p)) / 2), 9) AS distance FROM phi x JOIN phi y ON x.word = y.word AND x.topic < y.topic GROUP BY ALL")
def topic_distances(spark, sf):
    counts, _, _ = language_words(spark, sf)
    return topic_map.topic_distances(topic_map.word_shares(counts, len(LANGS)), len(LANGS)).withColumn("distance", F.round("distance", 9))


@query(f"""WITH {PHI}, r AS (SELECT word, topic, p, p / sum(p) OVER (PARTITION BY word) AS e FROM phi), lab AS (
SELECT 'probability' AS measure, topic, word, p AS value FROM phi UNION ALL SELECT 'score', topic, word, value FROM scores
UNION ALL SELECT 'lift', topic, word, p / (sum(n) OVER (PARTITION BY word) / (SELECT sum(n) FROM cells)) FROM phi
UNION ALL SELECT 'frex', topic, word, 1 / (0.5 / ((rank() OVER (PARTITION BY topic ORDER BY round(e, 12)) + (count(*) OVER (PARTITION BY topic, round(e, 12)) - 1) / 2) / count(*) OVER (PARTITION BY topic)) + 0.5 / ((rank() OVER (PARTITION BY topic ORDER BY round(p, 12)) + (count(*) OVER (PARTITION BY topic, round(p, 12)) - 1) / 2) / count(*) OVER (PARTITION BY topic))) FROM r)
SELECT measure, topic, row_number() OVER (PARTITION BY measure, topic ORDER BY round(value, 12) DESC, word) AS rank, word, round(value, 9) AS value FROM lab WHERE value IS NOT NULL QUALIFY rank <= 7""")
def topic_labels(spark, sf):
    counts, _, _ = language_words(spark, sf)
    return ranked(topic_map.topic_labels(counts, len(LANGS)), "measure")


@query(f"""WITH {PHI}, tk AS (SELECT sum(n) AS tokens FROM cells), top AS (SELECT word, 16 - row_number() OVER (ORDER BY round(p_word * distinctiveness, 12) DESC, word) AS place FROM sal QUALIFY place > 0)
SELECT 'Default' AS category, word, round(p_word * tokens, 6) AS freq, round(p_word * tokens, 6) AS total, round(CAST(place AS DOUBLE), 6) AS logprob, round(CAST(place AS DOUBLE), 6) AS loglift FROM top JOIN sal USING (word), tk
UNION ALL SELECT 'Topic' || (topic + 1), word, round(p * share * tokens, 6), round(pw * tokens, 6), round(ln(p), 6), round(ln(p / pw), 6) FROM phi JOIN (SELECT DISTINCT topic, word FROM relevant) USING (topic, word), tk""")
def topic_map_terms(spark, sf):
    counts, parts, tokens = language_words(spark, sf)
    d = topic_map.map_terms(topic_map.word_shares(counts, len(LANGS)), parts, tokens, [0.0, 0.5, 1.0], 15)
    return d.select("category", "word", *(F.round(c, 6).alias(c) for c in ("freq", "total", "logprob", "loglift")))


@query()
def search_k(spark, sf):
    """Models of windows with two to four topics."""
    vectors, _, _ = window_vectors(spark, sf, Scratch(spark, "window-topics"))
    return topic_search.search_k(vectors, ["conv_id", "window"], [2, 3, 4])


@query()
def structural_topics_by_role(spark, sf):
    """Loadings of three topics of stems whose prevalence depends on the role and the place of the window, and their words on
    the role; documents are the turns of a role in a window."""
    keys = ["conv_id", "window", "role"]
    turns = windows.tumbling(read(spark, sf, "conversations"), ["conv_id"], ["turn"], 30)
    docs = windows.window_text(turns, keys, "turn", "text")
    vectors = Scratch(spark, "role-topics").put(models.vectorise(docs, "text", stemmed=True)[0].select(*keys, "counts"), "vectors")
    terms = structural_topics.dummies(vectors, "role") | {"window": F.col("window").cast("double")}
    return structural_topics.fit_structural_topics(vectors, 3, terms, "role").loadings(vectors, keys)


# ------------------------------------------------------------------ columns and text


METHODS = "WITH a AS (SELECT doc_id, quality FROM labels WHERE quality = 1), b AS (SELECT doc_id, toxic FROM labels WHERE toxic = 1) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, toxic AS t_toxic FROM a FULL JOIN b ON a.doc_id = b.doc_id"


@query(METHODS)
def columns_by_prefix(spark, sf):
    lab = read(spark, sf, "labels")
    wide = contexts.full_join({"q": lab.where("quality = 1").select("doc_id", "quality"), "t": lab.where("toxic = 1").select("doc_id", "toxic")}, ["doc_id"])
    return contexts.with_prefix(wide, ["doc_id"], "t_")


@query("SELECT toxic, doc_id FROM labels")
def columns_by_list(spark, sf):
    lab = read(spark, sf, "labels").withColumn("nothing", F.lit(None).cast("int"))
    return contexts.drop_empty_columns(contexts.known_columns(lab, ["toxic", "unknown", "nothing", "doc_id"]))


@query("SELECT conv_id, turn FROM conversations WHERE contains(text, 'the') AND NOT regexp_matches(text, 'hi.*')")
def regex_filter(spark, sf):
    c = read(spark, sf, "conversations")
    return c.where(F.col("text").contains("the") & ~F.col("text").rlike("hi.*")).select(*TURN)


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END || 'ab' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || '.cha_' || event_id AS utt, event_id % 1000 / 1000 AS p FROM events)
SELECT event_id, nullif(regexp_extract(utt, '^([a-z]{2})([0-9]{2})\\.cha_([0-9]+)$', 1), '') AS child, TRY_CAST(nullif(regexp_extract(utt, '^([a-z]{2})([0-9]{2})\\.cha_([0-9]+)$', 2), '') AS INTEGER) AS age_weeks, TRY_CAST(nullif(regexp_extract(utt, '^([a-z]{2})([0-9]{2})\\.cha_([0-9]+)$', 3), '') AS INTEGER) AS utt_num,
CASE WHEN p < 0.001 THEN 'p < .001' ELSE printf('p = %.3f', p) END AS shown, round(p / (p + 0.5), 6) AS f, round((p + 0.1) / 3.5, 6) AS share, TRY_CAST(utt AS DOUBLE) AS number, len(string_split(utt, '.')) AS parts FROM e""")
def scalar_functions_of_ids(spark, sf):
    prefix = F.when(F.col("event_id") % 5 == 0, "x").otherwise("")
    e = read(spark, sf, "events").select("event_id", F.concat(prefix, F.lit("ab"), F.lpad((F.col("user_id") % 100).cast("string"), 2, "0"), F.lit(".cha_"), F.col("event_id").cast("string")).alias("utt"), (F.col("event_id") % 1000 / 1000).alias("p"))
    parts = text.file_parts(F.col("utt"))
    return e.select("event_id", *(c.alias(k) for k, c in parts.items()), text.p_text(F.col("p")).alias("shown"), F.round(text.harmonic(F.col("p"), F.lit(0.5)), 6).alias("f"), F.round(text.smoothed_share(F.col("p"), F.lit(1.0), 0.1, 25), 6).alias("share"), F.col("utt").try_cast("double").alias("number"), F.size(F.split("utt", "[.]")).cast("long").alias("parts"))


@query("""WITH o AS (SELECT role, unnest(string_split(text, ' ')) AS word FROM conversations), k AS (SELECT role, word FROM o WHERE NOT regexp_full_match(word, '[[:punct:]]*') AND NOT regexp_full_match(word, '[ \\t\\n\\v\\f\\r]*'))
SELECT role, count(*) AS n_tokens, count(DISTINCT word) AS n_types FROM k GROUP BY role""")
def stream_counts(spark, sf):
    """Words of the running text without those of punctuation or white space only."""
    words = read(spark, sf, "conversations").select("role", F.explode(text.drop_punctuation_tokens(text.tokens(F.col("text")))).alias("word"))
    return words.groupBy("role").agg(F.count("*").alias("n_tokens"), F.countDistinct("word").alias("n_types"))
