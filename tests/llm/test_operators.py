"""The training-data operators against brute force, exact round trips and held-out labels."""

import collections
import hashlib
import itertools
import os
import re
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import kit, language, queries, site_quality, substring_dedup
from lexloom.llm.decontaminate import align, contamination, drop_contaminated, normal_form
from lexloom.llm.language import identify
from lexloom.llm.line_dedup import LineRuns, dedup_lines, sorted_scans
from lexloom.llm.lm_score import cross_entropy_difference
from lexloom.llm.near_dup import connected_components, drop_near_duplicates, near_duplicates
from lexloom.llm.packing import Encoder, Plan, _Bins, default_tokenizer, knapsack, pack, sequences
from lexloom.llm.reputation import UrlRule, judge_urls, url_host, url_path
from lexloom.llm.rules import RULES, keep_quality, quality_rules
from lexloom.llm.site_quality import classify
from lexloom.llm.substring_dedup import drop_passages, repeated_passages

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (None, "a null id has this text, which is long enough"), (5, "x" * 300_000), (6, "été " * 40_000), (7, "\ud7ff\U0001f600 \x00 \x1c a\x85b")]


def odd(spark, extra=True):
    rows = [(a, b, "x", 1.5, True, [1]) for a, b in ODD]
    names = "doc_id long, text string, n_words string, score double, kept boolean, bands array<int>"
    df = spark.createDataFrame(rows, names)
    return df if extra else df.select("doc_id", "text")


def empty(spark):
    return odd(spark).where("1 = 0")


# ------------------------------------------------------------------ near duplicates


def test_unlike_words_that_polynomials_take_for_equal(spark):
    """Thue-Morse words of two letters and their complements."""
    for n in (10, 12):
        bits = [bin(i).count("1") % 2 for i in range(1 << n)]
        one, other = ("".join(x[b] for b in bits) for x in ("ab", "ba"))
        got = near_duplicates(spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}


def words(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def brute_components(docs, k=5):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = collections.defaultdict(list)
    for i in ids:
        for s in sets[i]:
            index[s].append(i)
    seen = set()
    for members in index.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * len(sets[a] | sets[b]):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_near_duplicates_of_a_chain_and_a_hub(spark):
    """A hub whose copies aren't similar to each other, and a chain in which only neighbours are linked."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 400)]
    rows = [(500, " ".join(base))]
    for i in range(30):  # each copy differs from the hub at its own places: 0.78 to the hub, about 0.6 to each other
        text = list(base)
        for at in rng.choice(np.arange(0, 400, 8), 10, replace=False):
            text[at] = f"n{i}_{at}"
        rows.append((i + 1, " ".join(text)))
    other = [f"v{i}" for i in rng.integers(0, 10_000, 400)]
    for i in range(12):
        rows.append((1000 - i, " ".join(other[i * 20 : i * 20 + 160])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == want and want[500][1] == 1


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(n))


@pytest.mark.parametrize("low", [2, 9])
def test_an_id_with_several_texts_links_them_and_loses_none(spark, low):
    rng = np.random.default_rng(8)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(low, a), (4, a), (4, b), (7, b.upper()), (20, c), (20, c), (21, c + " end"), (None, a), (5, ""), (5, a[:0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    first = min(low, 4)
    want = [(low, first, low == first), (4, first, first == 4), (4, first, first == 4), (7, first, False), (20, 20, True), (20, 20, True), (21, 20, False), (None, None, True), (5, 5, True), (5, 5, True)]
    assert got == collections.Counter(want)
    left = drop_near_duplicates(docs.withColumn("a.b", F.lit(1)))
    assert left.columns == ["doc_id", "text", "a.b"]
    assert collections.Counter(r.text for r in left.where("doc_id is not null").collect()) == {a: 1, b: 1, c: 1, "": 2}
    assert left.where("doc_id is null").count() == 1 and drop_near_duplicates(empty(spark)).count() == 0


def test_rows_kept_are_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {i for i, (_, c) in brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()]).items() if i == c}
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).select("doc_id").collect()) == sorted(want)


def test_large_bucket_of_unlike_texts(spark):
    """Texts of very different sizes that share a long passage are in the same buckets without being alike."""
    rng = np.random.default_rng(12)
    shared = prose(rng, 120)
    rows = [(i, shared + " " + prose(rng, int(n))) for i, n in enumerate(rng.integers(10, 200, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    want = brute_components(rows)
    assert got == want and 1 < len({c for _, c in want.values()}) < 60


def test_near_duplicates_of_odd_rows(spark):
    rows = near_duplicates(odd(spark)).collect()
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert got[(4, 1, 4, True)] == 2 and got[(1, 0, 1, True)] == got[(2, 0, 2, True)] == got[(3, 0, 3, True)] == 1
    assert [r.kept for r in rows if r.doc_id is None] == [True] and len(rows) == len(ODD)
    assert near_duplicates(empty(spark)).count() == 0


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(400, 440)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), kit.Scratch(spark, "t")).collect()}
    assert all(got.get(i, i) == find(i) for i in root)


# ------------------------------------------------------------------ lines


def brute_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    held = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(x.strip(" \t\n\x0b\x0c\r")) >= 20:
                held[key(x)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_lines_match_brute_force(spark, batches):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute_lines([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs, batches=batches, fanout=2).collect()}
    assert got == want


def test_lines_of_odd_rows(spark):
    got = dedup_lines(odd(spark)).collect()
    assert len(got) == len(ODD) and all(r.n_dropped == 0 and r.text is not None for r in got)
    assert got[0].score == 1.5 and dedup_lines(empty(spark)).count() == 0
    line = "  This Line is long enough for a key\t"
    rows = [(None, line), (1, line + "\nx\n" + line.lower()), (2, "y\n" + line), (3, line.strip()), (3, line.strip()), (4, "this line is short")]
    out = sorted(((r.doc_id, r.n_dropped, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=2).collect()), key=str)
    assert (1, 2, "x") in out and (2, 1, "y") in out and out.count((3, 0, line.strip())) == 2 and (None, 1, "") in out


def test_lines_of_clashing_columns_and_repeated_ids(spark):
    line = "this line is long enough for a key"
    rows = [(i, f"{line}\nown line number {i} is long enough\n{line}") for i in (1, 2, 3)] + [(1, line), (1, line), (None, line), (None, "x\n" + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_LINES", F.lit(7)).withColumn("a.b", F.lit("z")).withColumn("N_Dropped", F.lit(8))
    out = dedup_lines(docs, batches=2)
    assert out.columns == ["doc_id", "text", "a.b", "n_lines", "n_dropped"]
    got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect())
    assert got == collections.Counter([(1, 3, 2, "own line number 1 is long enough"), (2, 3, 2, "own line number 2 is long enough"), (3, 3, 0, rows[2][1]), (1, 1, 1, ""), (1, 1, 1, ""), (None, 1, 1, ""), (None, 2, 1, "x")])
    bare = dedup_lines(docs, counts=False, drop_emptied=True)
    assert bare.columns == docs.columns and bare.count() == 4 and bare.agg(F.sum("N_LINES")).first()[0] == 28


def test_line_runs_are_opened_again(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(d), int(k), int(k) * 7) for d in range(60) for k in set(rng.integers(0, 200, 25).tolist())]
    for part in range(6):  # ids in no order, a new store object each time
        store = LineRuns(spark, str(tmp_path / "runs"), min_docs=4, fanout=2, buckets=4)
        store.add(spark.createDataFrame([r for r in rows if r[0] % 6 == part], "doc_id long, k1 long, k2 long"))
        assert sum(map(len, store.levels)) <= 3
        store.close()
    store = LineRuns(spark, str(tmp_path / "runs"))
    assert (store.min_docs, store.fanout, store.buckets) == (4, 2, 4)
    held = collections.defaultdict(list)
    for d, k, _ in rows:
        held[k].append(d)
    assert {r.k1: r.last for r in store.settled().collect()} == {k: max(v) for k, v in held.items() if len(v) >= 4}
    with sorted_scans(spark, store.buckets):
        plan = store.fresh(spark.createDataFrame(rows[:9], "doc_id long, k1 long, k2 long"))._jdf.queryExecution().executedPlan().toString()
    # the batch is shuffled and sorted once, the runs are neither
    assert plan.count("Exchange") == 1 and plan.count("- Sort [") == 1 and plan.count("SortMergeJoin") == len(store.runs())
    store.close()


# ------------------------------------------------------------------ packing


def test_encoder_equals_the_tokenizer():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    own, whole = Encoder(default_tokenizer(), keep=50), Tokenizer.from_file(default_tokenizer())
    assert own.fast

    def same(text):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)

    @settings(max_examples=400, deadline=None)
    @given(st.text(st.sampled_from(list("ab'sTre'll 12 \t\n\r\x0b\x1c\x1f\x85\xa0éß²¼×÷ʼ中.,!?<|\xad"))))
    def small(text):
        same(text)

    @settings(max_examples=200, deadline=None)
    @given(st.text(st.characters(codec="utf-8")))
    def any_text(text):
        same(text)

    small()
    any_text()
    for text in ("<|endoftext|> a <|endoftext|>", " a", "a ", "a  b", "a \n b", "a\n b\n\n", "we'll've", "x" * 5000):
        same(text)


def check_places(docs, rows, capacity, encode):
    """Cuts, ids, offsets without gaps; gives the number of sequences and of tokens."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    total = 0
    for i, text in docs:
        ids = np.frombuffer(encode(text or ""), "<u4").tolist() + [0]
        parts = sorted(by_doc.pop(i), key=lambda r: r.piece)
        total += len(ids)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        assert all(r.length == capacity for r in parts[1:]) and len(parts) == -(-len(ids) // capacity)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert not by_doc
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), total


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces, places = pack(docs, digests={"ids_crc32": F.crc32("ids")})
    rows = places.collect()
    n, total = check_places([tuple(r) for r in docs.select("doc_id", "text").collect()], rows, 2048, Encoder(default_tokenizer()).encode)
    assert n <= -(-total // 2048) * 1.01 + 1
    packed = sequences(pieces, places).collect()
    assert sum(len(r.ids) for r in packed) == 4 * total and all(len(r.ids) <= 4 * 2048 for r in packed)


def test_plan_of_large_histograms():
    rng = np.random.default_rng(5)
    counts = collections.Counter((rng.lognormal(6, 0.9, 60_000)).astype(int).clip(1, 2048).tolist())
    plan = Plan(counts, 2048)
    assert plan.sequences <= sum(a * b for a, b in counts.items()) / 2048 * 1.01 + 1
    used = collections.Counter()
    for length, n in counts.items():
        sequence, offset = plan.place(np.full(n, length), np.arange(n))
        for s in sequence.tolist():
            used[s] += length
    assert max(used.values()) <= 2048 and len(used) == plan.sequences


def best_fit(counts, capacity):
    return _Bins([]).fit(dict(counts), capacity, 0, lambda *_: None)


def test_one_plan_on_every_cpu():
    """The plan doesn't change with the instructions that NumPy may use."""
    code = """
import hashlib
import numpy as np
from lexloom.llm.packing import Plan
rng = np.random.default_rng(4)
sizes = np.concatenate([rng.integers(20, 2049, 3000), rng.integers(300, 900, 3000)])
counts = {int(a): 7 * int(b) for a, b in zip(*np.unique(sizes, return_counts=True))}
plan = Plan(counts, 2048)
print(hashlib.sha256(b"".join(x.tobytes() for x in (plan.length, plan.rank, plan.first, plan.offset))).hexdigest())
"""
    out = set()
    for off in ("", "AVX2 FMA3 AVX512F AVX512CD AVX512_SKX AVX512_CLX AVX512_CNL AVX512_ICL AVX512_SPR"):
        done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, capture_output=True, timeout=600, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), env={**os.environ, "NPY_DISABLE_CPU_FEATURES": off})
        out.add(done.stdout)
    assert len(out) == 1


def test_prices_fall_like_the_exponential():
    from fractions import Fraction

    from lexloom.llm.packing import _ONE, _SHARES, decay

    for eta in ("0.35", "6", "12"):
        want = np.exp(-float(Fraction(eta)) * np.arange(_SHARES + 1) / _SHARES) * _ONE
        assert np.abs(decay(Fraction(eta)) - want).max() < 2


def test_the_program_decides(spark):
    """Configurations place most pieces; they need no more sequences than best fit on the data, and fewer on lengths that
    best fit packs badly."""
    rows = pack(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), keep_ids=False)[1].groupBy("length").count().collect()
    counts = {r[0]: r[1] for r in rows}
    rng = np.random.default_rng(0)
    hard = {"few lengths": {700: 900, 600: 500, 450: 400, 1100: 300}, "middle": collections.Counter(rng.integers(500, 900, 3000).tolist())}
    over = {683 + i: 60 for i in range(30)} | {342 + i: 60 for i in range(20)} | {1025 + i: 25 for i in range(60)}
    for name, c in {"data": counts, "33 times": {a: 33 * b for a, b in counts.items()}, "over halves and thirds": over, "around them": {1000: 300, 1030: 250, 690: 600, 660: 500, 340: 300}, **hard}.items():
        plan = Plan(c, 2048)
        assert plan.by_program > 0.6 * plan.pieces, name
        assert plan.sequences <= best_fit(c, 2048) - (name in hard), name


def test_knapsack_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        capacity = int(rng.integers(5, 25))
        lengths = np.unique(rng.integers(1, capacity + 1, 5))
        values = np.zeros(capacity + 1, np.int64)
        values[lengths] = rng.integers(1, 1 << 40, len(lengths))
        want = [0] * (capacity + 1)
        for room in range(1, capacity + 1):
            want[room] = max([want[room - 1], *(int(values[x]) + want[room - x] for x in lengths if x <= room)])
        assert knapsack(values, lengths, capacity)[0].tolist() == want


def test_packing_of_odd_rows(spark):
    pieces, places = pack(odd(spark), capacity=64)
    assert sequences(pieces, places).agg(F.sum(F.octet_length("ids"))).first()[0] == 4 * places.agg(F.sum("length")).first()[0]
    assert places.select("doc_id").distinct().count() == 8 and places.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 64
    assert pack(empty(spark))[1].count() == 0


# ------------------------------------------------------------------ rules


def brute_measures(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_rules_match_brute_force(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd(spark)):
        rows = quality_rules(docs).collect()
        text = collections.defaultdict(list)
        for r in docs.collect():
            text[r.doc_id].append(r.text)
        for r in rows:
            assert tuple(r)[1:6] in [brute_measures(t) for t in text[r.doc_id]]
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    assert quality_rules(empty(spark)).count() == 0 and keep_quality(empty(spark)).count() == 0 and keep_quality(odd(spark).withColumn("a.b", F.lit(1))).columns[-1] == "a.b"


def test_rules_look_only_at_what_is_left():
    import pyarrow as pa

    from lexloom.llm.rules import Texts, cascade

    t = Texts(pa.array(["short", "a b c d e f g h i j k l", "word " * 50, None]))
    assert cascade(t, RULES, [0, 2, 1]).tolist() == []
    assert t._kept["word_chars"].tolist() == [-1, 12, 200, -1] and t._kept["n_repeat_words"].tolist() == [-1, -1, 50, -1]


def test_order_of_rules_changes_no_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in quality_rules(docs, rules=RULES[::-1], sample=10).where("kept").collect()} == want
    assert {r.doc_id for r in keep_quality(docs).collect()} == want
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i in want for i, q in labels.items() if q]
    assert sum(good) / len(good) > 0.97


# ------------------------------------------------------------------ urls


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.B.Com:80?x/y", "x://H/p/q?z#f", "a://b://c/d", "http://u@h#f", "http://ÀB.com/É"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r[0], r[1]) for r in df.select(url_host(F.col("url")), url_path(F.col("url"))).collect()]
    assert got == [("", ""), ("", ""), ("", ""), ("", ""), ("a.b.com:80", ""), ("h", "/p/q"), ("b:", "//c/d"), ("u@h", ""), ("Àb.com", "/É")]


def test_reputation_shrinks_and_rules_win(spark):
    pages = spark.createDataFrame([(1, "http://bad.example.com/x"), (2, "http://good.example.com/x"), (3, "http://new.example.com/x"), (4, "http://a.bad.example.com/en/1"), (5, None), (5, None), (None, "http://good.example.com/en/x"), (7, "http://example.community/en/")], "page_id long, url string")
    outcomes = spark.createDataFrame([("bad.example.com", False)] * 60 + [("good.example.com", True)] * 60 + [("bad.example.com", None)], "host string, good boolean")
    rules = [UrlRule("allow", "com/en/"), UrlRule("block", "bad.example.com/en/1")]
    got = {(r.page_id, r.rule): r.verdict for r in judge_urls(pages, outcomes, rules).collect()}
    assert got == {(1, None): "block", (2, None): "allow", (3, None): "allow", (4, "bad.example.com/en/1"): "block", (5, None): "allow", (None, "com/en/"): "allow", (7, None): "allow"}
    assert judge_urls(pages, outcomes.where("1 = 0"), rules).where("verdict = 'block'").count() == 1
    assert judge_urls(pages.where("1 = 0"), outcomes, rules).count() == 0


# ------------------------------------------------------------------ language, quality, models


def test_language_on_held_out_documents(spark):
    found = queries.op2_language_id(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 150 and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def brute_grams(text):
    text = f" {''.join(c if c.isalpha() else ' ' for c in text.lower())} "
    text = re.sub(" +", " ", text)
    return {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}


def test_language_matches_brute_force(spark):
    """The kernel, its Nyström map and the ridge weights, from sets of strings."""
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("lang is not null and length(text) between 80 and 900").orderBy("doc_id").limit(60).collect()]
    model = language.fit([language.gram_set(t) for t, _ in rows], [x for _, x in rows], per_language=5)
    order = np.random.default_rng(11).permutation(len(rows))
    shuffled, names = [rows[i] for i in order], sorted({x for _, x in rows})
    marks = sorted((i for n in names for i in [j for j, (_, x) in enumerate(shuffled) if x == n][:5]))
    sets = [brute_grams(t) for t, _ in shuffled]
    known = set().union(*(sets[i] for i in marks))
    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a & known)) * max(1, len(b & known)))
    k = np.array([[kernel(a, sets[m]) for m in marks] for a in sets])
    values, vectors = np.linalg.eigh(k[marks])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = k @ root
    y = np.array([[1.0 if n == lang else -1.0 for n in names] for _, lang in shuffled])
    w = np.array([1 / sum(z == lang for _, z in shuffled) for _, lang in shuffled])[:, None]
    weights = root @ np.linalg.solve(x.T @ (x * w) + 1e-3 * np.eye(x.shape[1]), x.T @ (y * w))
    new = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("text is not null").orderBy(F.desc("doc_id")).limit(40).collect()]
    margins = np.array([[kernel(brute_grams(t), sets[m]) for m in marks] for t in new]) @ weights
    got, scores = model.predict(new)
    assert [names[i] for i in margins.argmax(axis=1)] == got
    assert scores == pytest.approx(np.clip((margins.max(axis=1) + 1) / 2, 0, 1), abs=2e-3)


def test_predictions_do_not_depend_on_neighbours():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    rng = np.random.default_rng(2)
    model = language.fit([language.gram_set(prose(rng, 30)) for _ in range(12)], ["a", "b", "c"] * 4, 3)
    line = st.text(st.sampled_from(list("abcdefg éÀ中 .,1\n")), max_size=30)

    @settings(max_examples=150, deadline=None)
    @given(line, st.lists(line, max_size=50))
    def same(text, others):
        alone = model.predict([text])
        among = model.predict([*others, text, *others])
        assert among[0][len(others)] == alone[0][0] and among[1][len(others)] == pytest.approx(alone[1][0], abs=2e-5)
        assert set(language.gram_set(text).tolist()) == {sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) for g in brute_grams(text)}

    same()


def test_language_of_odd_rows(spark):
    learn = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "x", None), (None, "le chat", "fr")], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in identify(odd(spark), learn).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and len(got) == 8
    assert identify(empty(spark), learn).count() == 0 and identify(odd(spark), learn.where("1 = 0")).where("lang_pred <> 'und'").count() == 0


def test_urls_of_tables_with_any_names(spark):
    rows = [(1, "http://a.com/en/x"), (2, None), (None, "x"), (1, "https://sub.a.com/de/1"), (3, ""), (4, "http://" + "a" * 50_000 + ".org/")]
    pages = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "`host` long, `my.url` string, `path` string, `n` int, `rule` boolean")
    outcomes = spark.createDataFrame([("a.com", False)] * 40 + [("a.com", None)], "host string, good boolean")
    for rules in ([], [UrlRule("allow", "a.com/de/")]):
        got = {(r.page_id, r.host[:9]): (r.rule, r.verdict) for r in judge_urls(pages, outcomes, rules, "host", "my.url").collect()}
        assert set(got) == {(1, "a.com"), (2, ""), (None, ""), (1, "sub.a.com"), (3, ""), (4, "aaaaaaaaa")}
        assert got[1, "a.com"] == (None, "block")
        assert got[1, "sub.a.com"][0] == (rules[0].rule if rules else None) and (not rules or got[1, "sub.a.com"][1] == "allow")
    assert judge_urls(pages.where("1 = 0"), outcomes, [], "host", "my.url").collect() == []


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), queries.good_labels(spark, SF)
    shown = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    hidden = labels.join(shown.select("doc_id"), "doc_id", "left_anti")
    rows = classify(docs, shown, host=F.col("source"), path=F.col("lang")).join(hidden, "doc_id").collect()
    junk = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    good, bad = [r.kept for r in rows if r.good], [not r.kept for r in rows if r.doc_id in junk]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) > 0.9


def brute_posteriors(rows, truth, known):
    """Posteriors of rows (doc_id, host, path, evidence) from their definition; truth: id -> good."""
    logit = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    share = [float(truth[d]) if d in truth else 1 / (1 + np.exp(-e - logit(known))) for d, _, _, e in rows]
    by_path, by_host = collections.defaultdict(list), collections.defaultdict(list)
    for (_, h, p, _), x in zip(rows, share):
        by_path[h, p].append(x)
        by_host[h].append(x)

    def strength(groups, prior):
        within = sum(sum((x - np.mean(v)) ** 2 for x in v) for v in groups.values()) / sum(len(v) - 1 for v in groups.values())
        between = (sum((sum(v) - len(v) * prior[k]) ** 2 for k, v in groups.items()) - within * len(rows)) / sum(len(v) ** 2 for v in groups.values())
        return min(500, max(2, max(1e-9, within) / max(1e-9, between)))

    rate = (sum(share) + 1) / (len(share) + 2)
    k = strength(by_host, dict.fromkeys(by_host, rate))
    hosts = {h: (sum(v) + k * rate) / (len(v) + k) for h, v in by_host.items()}
    k_path = strength(by_path, {(h, p): hosts[h] for h, p in by_path})
    site = []
    for i, ((_, h, p, _), x) in enumerate(zip(rows, share)):
        # from the other documents alone, at each level
        on_path = [y for j, ((_, g, q, _), y) in enumerate(zip(rows, share)) if j != i and (g, q) == (h, p)]
        on_host = sum(by_host[h]) - x
        everywhere = (sum(share) - x + 1) / (len(share) + 1)
        of_host = (on_host + k * everywhere) / (len(by_host[h]) - 1 + k)
        site.append((sum(on_path) + k_path * of_host) / (len(on_path) + k_path))
    return [(s, 1 / (1 + np.exp(-e - logit(s)))) for s, (_, _, _, e) in zip(site, rows)]


def test_quality_matches_brute_force(spark):
    """Site and document posteriors, with sites given for some documents."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), queries.good_labels(spark, SF)
    sites = docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("h"), (F.col("doc_id") % 7).cast("string")).alias("host"), F.when(F.col("doc_id") % 2 == 0, "p").alias("path"))
    got = classify(docs, labels, sites, host=F.col("source"), path=F.col("lang")).collect()
    given = {r.doc_id: (r.host, r.path) for r in sites.collect()}
    own = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    assert all((r.host, r.path) == tuple(x or "" for x in given.get(r.doc_id, own[r.doc_id])) for r in got)
    truth = {r.doc_id: r.good for r in labels.collect()}
    rows = [(r.doc_id, r.host, r.path, r.evidence) for r in got]
    want = brute_posteriors(rows, truth, (sum(truth.values()) + 1) / (len(truth) + 2))
    assert [(r.site_posterior, r.posterior) for r in got] == [pytest.approx(w, abs=1e-9) for w in want]
    assert all(r.kept == (r.posterior >= 0.5) for r in got)


def test_a_documents_own_label_is_not_its_prior(spark):
    """Two equal texts, each alone on its host: whatever the label of one, its own site posterior is the same."""
    rows = [(1, "same text here", "a"), (2, "same text here", "b"), *((i, f"other text {i}", f"h{i}") for i in range(3, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string")
    found = {}
    for mine in (True, False):
        labels = spark.createDataFrame([(1, mine), (2, True), *((i, i % 2 == 0) for i in range(3, 9))], "doc_id long, good boolean")
        found[mine] = {r.doc_id: r.site_posterior for r in classify(docs, labels, host=F.col("host")).collect()}
    assert found[True][1] == found[False][1] and found[True][2] > found[False][2]


def test_words_lose_all_marks_at_their_end():
    import pyarrow as pa

    _, words = site_quality.measures(pa.array(["end", "end......", "(end,;:!?.", "end*?.", "....", "."]))
    assert words[0].tolist() == words[1].tolist() == words[3].tolist() != words[2].tolist() and words[4].tolist() == words[5].tolist()


def test_quality_of_odd_rows_with_both_classes(spark):
    """The fitted model meets null, empty, repeated and very long texts."""
    learn = [(100 + i, "good words in a row of prose here" if i % 2 else "$$ ## @@ 77 %% ** &&") for i in range(40)]
    docs = spark.createDataFrame([*ODD, *learn], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, i % 2 == 1) for i, _ in learn), (5, False), (6, True), (4, None), (None, False)], "doc_id long, good boolean")
    sites = spark.createDataFrame([(5, "h", None), (None, "h", "p"), (101, "h", "p"), (101, "g", "q")], "doc_id long, host string, path string")
    rows = classify(docs, labels, sites).collect()
    assert len(rows) == len(ODD) + len(learn) and all(np.isfinite(r.posterior) for r in rows)
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[101] and not kept[100] and {r.host for r in rows if r.doc_id == 101} == {"g"}


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, True), (None, True), (5, None)], "doc_id long, good boolean")
    rows = classify(odd(spark), labels, host=F.col("n_words")).collect()
    assert len(rows) == len(ODD) and all(r.kept for r in rows)
    assert classify(empty(spark), labels).count() == 0


def brute_losses(texts, target, folds, order=3, strength=8.0):
    """Per text the losses in the target and the background model of the other fold."""
    out = []
    models = []
    for fold in (0, 1):
        counts = [collections.Counter(), collections.Counter()]
        ctx = [collections.Counter(), collections.Counter()]
        for t, on, f in zip(texts, target, folds):
            raw = b"\0" * order + t.encode()
            for i in range(order, len(raw) if f == fold else 0):
                for n in range(1, order + 1):
                    counts[on][raw[i - n + 1 : i + 1]] += 1
                    ctx[on][n, raw[i - n + 1 : i]] += 1
        total = ctx[1][1, b""]
        models.append((counts, ctx, total / max(1, ctx[0][1, b""]) if total else 1.0))

    def p(model, on, gram):
        if not gram:
            return 1 / 256
        counts, ctx, scale = model
        s = 1 if on else scale
        return (counts[on][gram] * s + strength * p(model, on, gram[1:])) / (ctx[on][len(gram), gram[:-1]] * s + strength)

    for t, f in zip(texts, folds):
        raw = b"\0" * order + t.encode()
        out.append([np.mean([-np.log2(p(models[1 - f], on, raw[i - order + 1 : i + 1])) for i in range(order, len(raw))]) if t else 0.0 for on in (1, 0)])
    return out


@pytest.mark.parametrize("block_bytes", [16 << 20, 20])
def test_losses_match_brute_force(spark, block_bytes):
    """The second size makes many blocks, of which that of the repeated id is split by text and into parts."""
    rows = list(enumerate(["the cat sat on the mat", "a dog! a dog! été", "", "the mat sat", "zzzz zz z", "the dog sat", "a cat", "mat the"])) + [(9, "the same row again")] * 12 + [(9, f"other text {i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    chosen = [0, 3, 5, 6]
    folds = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("f")).distinct().collect()}
    assert {folds[i] for i in chosen} == {0, 1}
    got = cross_entropy_difference(docs, docs.where(F.col("doc_id").isin(chosen)), order=3, block_bytes=block_bytes).collect()
    want = brute_losses([t for _, t in rows], [i in chosen for i, _ in rows], [folds[i] for i, _ in rows])
    want = sorted((i, len(t.encode()), round(a, 3), round(b, 3)) for (i, t), (a, b) in zip(rows, want))
    found = sorted((r.doc_id, r.n_tokens, round(r.target_loss, 3), round(r.background_loss, 3)) for r in got)
    assert len(found) == len(want) and np.array(found) == pytest.approx(np.array(want), abs=2e-3)
    assert all(r.score == pytest.approx(r.target_loss - r.background_loss) for r in got)


def test_losses_of_odd_rows(spark):
    rows = cross_entropy_difference(odd(spark), odd(spark).where("doc_id = 4")).collect()
    assert len(rows) == len(ODD) and all(np.isfinite(r.score) for r in rows)
    assert cross_entropy_difference(empty(spark), odd(spark)).count() == 0
    assert cross_entropy_difference(odd(spark), empty(spark)).count() == len(ODD)


# ------------------------------------------------------------------ decontamination


def brute_edits(item, text):
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        for j in range(1, len(text) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (text[j - 1] != c))
        row = new
    return int(row.min())


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        item, text = rng.integers(97, 100, rng.integers(3, 14)), rng.integers(97, 100, rng.integers(3, 20))
        assert align(item, text, -len(item), len(text))[0] == brute_edits(item, text)


def test_contamination_finds_exact_and_edited_items(spark):
    rng = np.random.default_rng(2)
    say = lambda n: " ".join("".join(rng.choice(list("aeionrst"), rng.integers(2, 8))) for _ in range(n))
    items = [(i, say(40)) for i in range(6)]
    edited = items[1][1].upper().replace(" ", ",  ", 7)
    cut = items[2][1][:50] + "q" + items[2][1][51:90] + items[2][1][92:]
    rows = [(10, "É " + say(60) + " " + items[0][1] + " " + say(60)), (11, say(30) + ". " + edited), (12, cut + " " + say(30)), (13, say(300)), (14, items[3][1][: len(items[3][1]) // 2]), (15, None), (16, items[4][1] + "\n" + items[5][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (98, None), (99, "short"), (None, "x" * 40)], "item_id long, text string")
    for block in (8 << 20, 400):
        got = {(r.doc_id, r.item_id): r for r in contamination(docs, bench, block_chars=block).collect()}
        assert set(got) == {(10, 0), (11, 1), (12, 2), (16, 4), (16, 5)}
        r = got[10, 0]
        assert rows[0][1][r.start : r.stop] == items[0][1] and r.edits == 0 and 0 < got[12, 2].edits <= 3
    assert {r.doc_id for r in drop_contaminated(docs, bench).collect()} == {13, 14, 15}


def brute_regions(items, text, q, rate):
    """Per item the end of the best alignment of each maximal run of ends within the budget."""
    out = set()
    for item in items:
        n = len(item)
        budget = max(0, min(int(rate * n), (n - q) // q))
        row, ends = np.zeros(len(text) + 1, int), None
        for i, c in enumerate(item, 1):
            new = np.empty_like(row)
            new[0] = i
            for j in range(1, len(text) + 1):
                new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (text[j - 1] != c))
            row = new
        if row.min() <= budget:
            out.add((item, int(row.min())))
    return out


def test_contamination_matches_brute_force_over_edits(spark):
    rng = np.random.default_rng(9)
    letters = np.array(list("abcdefgh "))
    items = [normal_form("".join(rng.choice(letters, n)).encode())[0].strip(b" ").decode() for n in (12, 18, 26, 40, 70, 110)]
    rows, want = [], set()
    for i in range(60):
        item = list(items[i % 6])
        for _ in range(int(rng.integers(0, 9))):  # substitutions, insertions and deletions
            at, kind = int(rng.integers(0, len(item))), int(rng.integers(0, 3))
            item[at : at + (kind != 1)] = [] if kind == 2 and len(item) > 9 else [str(rng.choice(letters[:8]))]
        text = normal_form(("".join(rng.choice(letters, 30)) + "".join(item) + "".join(rng.choice(letters, 30))).encode())[0].decode().strip()
        rows.append((i, text))
        want |= {(i, items.index(x), e) for x, e in brute_regions(items, text, 10, 0.1)}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = collections.defaultdict(list)
    for r in contamination(docs, bench, rate=0.1).collect():
        got[r.doc_id, r.item_id].append(r.edits)
    assert {(d, i, min(e)) for (d, i), e in got.items()} == want and 10 < len(want) < 60


def test_contamination_of_many_regions_and_short_items(spark):
    item = "alpha beta gamma delta epsilon zeta"
    rows = [(1, " - ".join([item.upper()] * 130)), (2, "a No. 7! b"), (3, "ano 7b"), (4, "no 7"), (5, "x" * 50)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, "no 7"), (3, "!?"), (4, "b")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, rows[r.doc_id - 1][1][r.start : r.stop]) for r in contamination(docs, bench).collect())
    assert got == [(1, 1, item.upper())] * 130 + [(2, 2, "No. 7"), (2, 4, "b"), (4, 2, "no 7")]
    clean = drop_contaminated(docs.withColumn("a.b", F.lit(1)), bench)
    assert clean.columns == ["doc_id", "text", "a.b"] and {r.doc_id for r in clean.collect()} == {3, 5}
    assert {r.doc_id for r in drop_contaminated(docs.withColumn("a.b", F.lit(1)), bench, block_chars=20).collect()} == {3, 5}


def test_memory_of_repetitive_texts_is_bounded():
    """300 KB of one pair of letters against a repetitive item, in a process that may have 1 GB."""
    code = """
import resource
resource.setrlimit(resource.RLIMIT_AS, (1 << 30, 1 << 30))
from lexloom.llm.decontaminate import Index
index = Index.build([(1, "ab" * 400), (2, "ab" * 300 + "c")], 10, 0.06)
found = index.matches([b"ab" * 150_000])
assert sum(m[1] == 0 for m in found) >= 100 and all(m[4] <= 48 for m in found)
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=600, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), env={**os.environ, "OPENBLAS_NUM_THREADS": "1"})


def test_contamination_on_planted_items(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in contamination(docs, bench).collect()}
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    want = {(d, i) for d, t in docs.select("doc_id", "text").collect() for i, x in items if x in t}
    assert want and want <= got and len(got) <= len(want) * 1.2
    assert contamination(odd(spark), bench).count() == contamination(empty(spark), bench).count() == contamination(docs, bench.where("1 = 0")).count() == 0


# ------------------------------------------------------------------ substrings


def test_passages(spark):
    rng = np.random.default_rng(7)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(n))
    shared = [say(55) for _ in range(40)]
    rows = [(2 * i + j, f"{say(int(rng.integers(5, 90)))} {shared[i]} {say(30)}") for i in range(40) for j in (0, 1)] + [(1000 + i, say(400)) for i in range(20)] + [(2000, None), (None, shared[0]), (3000, say(80)), (3000, "x"), (3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeated_passages(docs).collect()
    hit = {r.doc_id for r in found}
    assert len(hit) >= 78 and hit <= set(range(80))
    text = dict(r for r in rows if r[0] is not None)
    for r in found:
        assert text[r.doc_id].encode()[r.start : r.stop].decode().strip() in shared[r.doc_id // 2] and r.repeated == (r.doc_id % 2 == 1)
    left = {r.doc_id: r.text for r in drop_passages(docs, repeated_passages(docs)).where("doc_id < 80").collect()}
    assert all(left[i] == text[i] for i in range(0, 80, 2)) and sum(len(left[i]) < len(text[i]) - 150 for i in range(1, 80, 2)) >= 39
    assert repeated_passages(empty(spark)).count() == 0 and repeated_passages(odd(spark)).count() == 0


def brute_chunks(text, mean=24, least=6, most=512):
    raw = text.encode()
    gear = [int(x) for x in substring_dedup._GEAR]
    small = [p + 1 for p in range(15, len(raw)) if sum(gear[raw[p - j]] << j for j in range(16)) % 2**32 < 2**32 // mean]
    small = [p for p in small if 16 <= p < len(raw)]
    cuts = [0, *(p for i, p in enumerate(small) if not i or p - small[i - 1] >= least), len(raw)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        out += [(x, min(x + most, b)) for x in range(a, b, most)]
    return out


def brute_passages(rows, min_words=15):
    pieces = {(d, t): [(a, b, t.encode()[a:b]) for a, b in brute_chunks(t)] for d, t in rows if d is not None and t}
    held = collections.defaultdict(set)
    for (d, _), parts in pieces.items():
        for _, _, x in parts:
            held[x].add(d)
    out = set()
    for (d, t), parts in pieces.items():
        raw = b" " + t.encode()
        begins = [i for i in range(1, len(raw)) if raw[i : i + 1].strip() and not raw[i - 1 : i].strip()]
        run = []
        for a, b, x in [*parts, (None, None, b"")]:
            if a is not None and len(held[x]) > 1:
                run.append((a, b, x))
                continue
            if run:
                count = lambda part: sum(part[0][0] < i <= part[-1][1] for i in begins)
                if count(run) >= min_words:
                    for again, part in itertools.groupby(run, lambda x: min(held[x[2]]) != d):
                        part = list(part)
                        out.add((d, t, part[0][0], part[-1][1], count(part), min(held[part[0][2]]), again))
                run = []
    return out


def test_passages_match_brute_force(spark):
    rng = np.random.default_rng(21)
    shared = [prose(rng, int(n)) for n in (5, 20, 52, 90, 200)]
    rows = [(int(rng.integers(0, 25)), " ".join([prose(rng, 20), *(shared[i] for i in rng.integers(0, 5, 2)), "é中" * int(rng.integers(0, 4)), prose(rng, 15)])) for _ in range(40)]
    rows += rows[:3] + [(None, shared[4]), (7, None), (7, ""), (8, "x" * 3000), (9, "x" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = {r.h: r.text for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    got = [(r.doc_id, texts[r.text_hash], r.start, r.stop, r.n_words, r.first_doc, r.repeated) for r in repeated_passages(docs).collect()]
    want = brute_passages(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_no_chunk_leaves_the_corpus(spark):
    """Passages that are chained in other ways in other documents: each distinct chunk is left somewhere, and a passage
    that another document has first goes."""
    rng = np.random.default_rng(33)
    a, b = prose(rng, 120), prose(rng, 120)
    rows = [(1, f"{prose(rng, 30)} {a} {prose(rng, 30)}"), (2, f"{prose(rng, 30)} {a} {b}"), (3, f"{a} {b} {prose(rng, 30)}")]
    pieces = [prose(rng, int(n)) for n in rng.integers(20, 90, 6)]
    rows += [(10 + i, " ".join(pieces[j] for j in rng.permutation(6)[: rng.integers(1, 5)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeated_passages(docs)
    left = {r.doc_id: r.text for r in drop_passages(docs, found).collect()}
    assert b[60:-60] in left[2] and a[60:-60] not in left[2] and b[60:-60] not in left[3] and left[1] == rows[0][1]
    cuts = collections.defaultdict(list)
    for r in found.where("repeated").collect():
        cuts[r.doc_id].append((r.start, r.stop))
    every, stays = set(), set()
    for d, t in rows:
        for x, y in brute_chunks(t):
            every.add(t.encode()[x:y])
            if not any(p <= x and y <= q for p, q in cuts[d]):
                stays.add(t.encode()[x:y])
    assert every == stays and len(cuts) > 20


def test_chunks_do_not_depend_on_neighbours():
    import pyarrow as pa
    from hypothesis import given, settings
    from hypothesis import strategies as st

    line = st.text(st.sampled_from(list("abcdefgh é\n")), max_size=400)

    @settings(max_examples=200, deadline=None)
    @given(line, st.lists(line, max_size=50))
    def same(text, others):
        block = kit.Block(pa.array([*others, text, *others]))
        a, b = substring_dedup.chunk_ends(block, 24, 6, 64)
        mine = block.owner(a) == len(others)
        base = block.start[len(others)]
        assert list(zip((a[mine] - base).tolist(), (b[mine] - base).tolist())) == brute_chunks(text, most=64)

    same()


def test_unlike_texts_of_one_id_lose_nothing_to_each_other(spark):
    rng = np.random.default_rng(22)
    p, x, y, z = prose(rng, 150), prose(rng, 60), prose(rng, 60), prose(rng, 200)
    docs = spark.createDataFrame([(1, f"{p} {x}"), (2, f"{p} {y}"), (2, z), (2, z), (3, None)], "doc_id long, text string").withColumn("a.b", F.lit(1))
    left = drop_passages(docs, repeated_passages(docs))
    texts = collections.Counter(r.text for r in left.collect())
    assert left.columns == docs.columns and texts[f"{p} {x}"] == 1 and texts[z] == 2 and texts[None] == 1
    rest = next(t for t in texts if t and t not in (f"{p} {x}", z))
    assert rest.endswith(y) and len(rest) < len(y) + 150


def test_digest_columns(spark):
    rows = queries.op8_line_dedup(spark, SMALL).collect()
    want = brute_lines([tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()])
    assert {r.doc_id: r.kept_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, (_, _, t) in want.items()}


# ------------------------------------------------------------------ SQL


def plain_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = queries.queries()[name](spark, SMALL)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain_rows(got.columns, got.collect()) == plain_rows(names, want.fetchall())


def test_urls_of_two_label_suffixes_match_the_sql(spark, tmp_path):
    rng = np.random.default_rng(31)
    hosts = ["a.co.uk", "b.co.uk", "www.b.co.uk", "co.uk", "uk", "x.org.uk", "y.com.au", "z.y.com.au", "q.example.com", "example.com", "bad.net", "a.bad.net"]
    pages = [(i, f"http://{hosts[int(rng.integers(0, len(hosts)))]}/p/{i}") for i in range(400)]
    labels = [(i, int(rng.random() < (0.1 if "bad" in u or "co.uk" in u else 0.9)), 0) for i, u in pages if i % 2]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.op5_url_filter(spark, str(tmp_path))
    want = con.execute(queries.ORACLE_SQL["op5_url_filter"])
    names = [c[0] for c in want.description]
    rows = got.collect()
    assert plain_rows(got.columns, rows) == plain_rows(names, want.fetchall()) and {r.verdict for r in rows} == {"allow", "block"}
