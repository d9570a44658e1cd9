"""Secret scans, whitening and clustering of vectors against brute force, on planted and odd rows."""

import hashlib
import math
import random
import re
import string

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import centroids, queries, secret_scan
from lexloom.llm.centroids import cluster_vectors, largest_entry, nearest, screen
from lexloom.llm.secret_scan import Background, Looks, base_spans, encoding_of, learn_thresholds, least_bin, looks_of, scan_secrets
from lexloom.llm.whitening import common_length, whiten

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumn("x", F.lit("clash")).withColumn("cluster", F.lit(1)).withColumn("my.n", F.lit(2)).withColumn("whitened", F.lit(3)) if extra else df


# ------------------------------------------------------------------ whitening


def brute_whitening(rows, components, scale=64, offset=1_000_000):
    kept = [(i, [math.floor(scale * float(np.float32(c))) + offset for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    far = np.array([[n * x[i] - sums[i] for i in range(d)] for x in fit], dtype=object)
    cov = np.array([[float(sum(far[:, i] * far[:, j])) / n**3 for j in range(d)] for i in range(d)])
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    return n, sums, kept, cov, values[order], vecs[:, order]


@pytest.mark.parametrize("dims,count", [(3, 40), (20, 300)])
def test_whitening_agrees_with_brute_force(spark, dims, count):
    rng = np.random.default_rng(dims)
    data = (rng.normal(size=(count, dims)) @ rng.normal(size=(dims, dims)) + 5).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    rows += rows[:7] + [(None, rows[3][1]), (900, None), (901, [None] + rows[0][1][1:]), (902, [NAN] + rows[0][1][1:]), (903, [-INF] + rows[0][1][1:])]
    white, out = whiten(vectors(spark, rows, extra=True))
    n, sums, kept, cov, values, vecs = brute_whitening(rows, 16)
    assert (white.n, white.sums) == (n, sums) and np.allclose(white.values, values, rtol=1e-12)
    assert np.allclose(np.abs((white.vectors * vecs).sum(axis=0)), 1, atol=1e-9) and white.trace == pytest.approx(np.trace(cov), rel=1e-13)
    sign = np.sign((white.vectors * vecs).sum(axis=0))
    got = sorted((r.vec_id is not None, r.vec_id or 0, r.deviation, tuple(r.whitened)) for r in out.collect())
    want = []
    for i, x in kept:
        w = (np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ (vecs * sign)) / np.sqrt(values)
        want.append((i is not None, i or 0, sum((n * a - s) ** 2 for a, s in zip(x, sums)), tuple(w)))
    want.sort()
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-7, atol=1e-7)
    assert white.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    white, out = whiten(vectors(spark, []))
    assert white is None and out.collect() == [] and out.columns == ["vec_id", "deviation", "whitened"]
    white, out = whiten(vectors(spark, [(1, None), (2, []), (3, [NAN])]))
    assert white is None and out.count() == 0
    one = vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0]), (None, [1.0, 2.0])])  # one distinct vector has no variance
    white, out = whiten(one)
    assert white.n == 1 and [(r.deviation, r.whitened) for r in out.collect()] == [(0, [None, None])] * 3 and white.identity_error is None
    flat = vectors(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(9)])  # dependent dimensions
    white, out = whiten(flat)
    assert white.usable.tolist() == [True, False, False] and all(r.whitened[1:] == [None, None] for r in out.collect())
    assert np.isclose(sum(r.whitened[0] ** 2 for r in out.collect()) / 9, 1)
    huge = vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [2.0, 1.0])])  # entries that a long can't hold
    assert whiten(huge)[1].count() == 3
    assert common_length(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]), "embedding") == 2


def test_wide_sums_are_exact(spark):
    """Distances whose products need decimals, and deviations beyond a long."""
    rows = [(i, [float((-1) ** i * 2**24 + 1000 * i), float(i)]) for i in range(50)]
    white, out = whiten(vectors(spark, rows), scale=64.0)
    n, sums, kept, cov, values, _ = brute_whitening([(i, [max(min(c, 2.0**25), -(2.0**25)) for c in v]) for i, v in rows], 2)
    assert white.sums == sums and np.allclose(white.values, values, rtol=1e-9)
    want = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in kept}
    assert {r.vec_id: r.deviation for r in out.collect()} == {i: w if w < 2**63 else None for i, w in want.items()}


def test_op12_over_its_table(spark):
    rows = queries.op12_embedding_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, sums, kept, cov, values, vecs = brute_whitening([(r.vec_id, r.embedding) for r in table], 16)
    assert len(rows) == 16 * len(kept) and {r.n for r in rows} == {n} and {r.component for r in rows} == set(range(1, 17))
    of = {(r.vec_id, r.component): r for r in rows}
    x = dict(kept)
    for i in list(x)[:50]:
        assert of[i, 1].deviation == sum((n * a - s) ** 2 for a, s in zip(x[i], sums))
    for k in range(16):
        w = {i: (np.array(v) - np.array(sums) / n) @ vecs[:, k] / math.sqrt(values[k]) for i, v in x.items()}
        got = np.array([of[i, k + 1].whitened for i in w])
        assert np.allclose(np.abs(got @ np.array(list(w.values()))) / n, 1, atol=1e-6)
        assert of[next(iter(x)), k + 1].explained == pytest.approx(values[k] / np.trace(cov), rel=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-4
    assert queries.op12_embedding_whitening(spark, SF).schema.simpleString() == "struct<vec_id:bigint,component:int,n:bigint,deviation:bigint,whitened:double,explained:double,identity_error:double>"


# ------------------------------------------------------------------ clustering


def brute_clusters(rows, k, rounds, dims, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())[:k]
    c = [x for _, x in first]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min(range(len(c)), key=lambda j: (far(x, c[j]), j))
    for _ in range(rounds):
        of = [near(x) for _, x in kept]
        moved = []
        for j in range(len(c)):
            members = [x for (_, x), o in zip(kept, of) if o == j]
            moved.append([sum(col) // len(members) for col in zip(*members)] if members else c[j])
        c = moved
    return sorted((i, near(x), far(x, c[near(x)])) for i, x in kept), c


def test_clusters_agree_with_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(c) for c in rng.normal(size=5).astype(np.float32)]) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)] + [(2000, None), (2001, [1.0] * 4), (2002, [NAN] * 5), (2003, [None] * 5), (2004, [INF] * 5)]
    got, placed = cluster_vectors(vectors(spark, rows, extra=True), dims=5)
    want, c = brute_clusters(rows, 8, 10, 5)
    assert sorted(map(tuple, placed.collect())) == want and got.centroids.tolist() == c
    assert got.inertia == [sum(d for _, j, d in want if j == i) for i in range(8)]


def test_ties_go_to_the_smallest_number(spark):
    """Equal vectors start several centroids; points half way between two; empty clusters stay."""
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)] + [(100 + i, [0.5, 0.0]) for i in range(5)]
    got, placed = cluster_vectors(vectors(spark, rows), k=6, dims=2, scale=2.0, rounds=3)
    want, c = brute_clusters(rows, 6, 3, 2, 2)
    assert sorted(map(tuple, placed.collect())) == want and got.centroids.tolist() == c


def test_intervals_hold_the_nearest():
    """Large numbers whose distances differ by one unit are beyond single precision; none of the nearest is screened out,
    and the screen leaves one centroid where it can."""
    rng = np.random.default_rng(1)
    top = largest_entry(64) - 1
    assert (2 * top) ** 2 * 64 < 2**63
    x = rng.integers(-top, top, (200, 64))
    c = np.concatenate([x[:4], x[:4] + rng.integers(-1, 2, (4, 64)), -x[:4]])
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, m)) for m in c] for r in x]
    best = [min(range(len(c)), key=lambda j: (e[j], j)) for e in exact]
    may = screen(x, c)
    assert all(may[i, j] for i, e in enumerate(exact) for j in range(len(c)) if e[j] == min(e))
    assert nearest(x, c).tolist() == best
    assert screen(rng.integers(-600, 600, (500, 64)), rng.integers(-600, 600, (8, 64))).sum(axis=1).mean() < 1.05


def test_clusters_of_odd_tables(spark):
    got, placed = cluster_vectors(vectors(spark, []), dims=2)
    assert placed.collect() == [] and got.inertia == [] and len(got.centroids) == 0
    got, placed = cluster_vectors(vectors(spark, [(None, [1.0, 2.0]), (7, [3.0, 4.0]), (7, [3.0, 4.0]), (7, [9.0, 9.0])]), dims=2, scale=1.0)
    assert sorted((r.vec_id or 0, r.cluster, r.distance) for r in placed.collect()) == [(0, 3, 0), (7, 0, 0), (7, 0, 0), (7, 2, 0)]
    got, placed = cluster_vectors(vectors(spark, [(1, [3e38] * 2), (2, [-3e38] * 2)]), k=1, dims=2)
    assert placed.count() == 2 and all(r.distance > 0 for r in placed.collect())


def test_op13_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    found = con.execute(queries.cluster_sql())
    names = [d[0] for d in found.description]
    got = queries.op13_centroid_clustering(spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall()) and len(got) == 500


# ------------------------------------------------------------------ secrets


def test_base_spans_by_hand():
    of = lambda t: [(secret_scan.KINDS[k], t[a:b]) for a, k, b in base_spans(t)]
    assert of('é PassWord = "hunter2!"') == [("assign", 'PassWord = "hunter2')]
    assert of("apikey:abc12 api_key:abc123") == [("assign", "api_key:abc123")]
    assert of("token=token: abcdefgh") == []  # the first match is too short and takes the second name with it
    assert of("toKen=abcdefgh pasſword=abcdefgh") == []  # other characters that fold to letters of the names
    assert of("AKIA" + "Z" * 15) == [] and of("xAKIA" + "Z9" * 8 + "a") == [("access", "AKIA" + "Z9" * 8)]
    assert of("g" + "a" * 23 + "G") == [] and of("ab12" * 6 + "-" + "0" * 24) == [("hex", "ab12" * 6), ("hex", "0" * 24)]
    assert of("secret='" + "0f" * 12 + "'") == [("assign", "secret='" + "0f" * 12), ("hex", "0f" * 12)]


def test_statistics_by_brute_force():
    rng = random.Random(3)
    for alphabet in (string.digits, "0123456789abcdef", string.ascii_lowercase, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"):
        for n in (16, 23, 40, 200):
            s = "".join(rng.choice(alphabet) for _ in range(n))
            x = looks_of(s.encode())
            assert x.length == n and x.collisions == sum(s[i] == s[j] for i in range(n) for j in range(i)) and set(s) <= set(secret_scan.ENCODINGS[secret_scan._NAMES[x.encoding]])
            kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in s]
            assert x.changes == sum(a != b for a, b in zip(kind, kind[1:]))
    assert encoding_of(b"a+b-c") is None and looks_of(b"ab+cd-ef/ab_cd-e+") is None
    # a random string's combined p-value is close to uniform: few are lost at 1 %
    lost = sum(looks_of("".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)).encode()).p_random < 0.01 for _ in range(2000))
    assert lost < 50
    # what isn't random fails
    for s in ("abcdefghijklmnopqrstuvwxyz0123456789", "aaaaaaaaaaaaaaaaaaaaaaaa", "abababababababababababab", "0000111122223333444455556666777788889999", "AbstractSingletonProxyFactoryBean"):
        assert looks_of(s.encode()).p_random < 0.01, s


def test_collisions_of_ordinary_text():
    """Mean and variance of the collisions under the background, by simulation."""
    rng = np.random.default_rng(2)
    counts = np.zeros(128)
    counts[[ord(c) for c in string.ascii_lowercase]] = rng.integers(10, 1000, 26)
    back = Background.of(counts, 1000, 10)
    e = list(secret_scan.ENCODINGS).index("lower")
    p = counts[97:123] + 1
    draws = rng.choice(26, (20_000, 20), p=p / p.sum())
    found = np.array([(np.bincount(d, minlength=26) * (np.bincount(d, minlength=26) - 1) // 2).sum() for d in draws])
    for k in (0, 3, 6, 10):  # the normal tail is no smaller than the true one where it matters
        few = math.exp(0) and secret_scan._tail(-(k + 0.5 - found.mean()) / found.std())
        # one tail alone, combined with a second of 1 by Fisher
        assert back.p_ordinary(Looks(e, 20, k, 0, 1.0)) == pytest.approx(secret_scan._fisher(few, 1.0), rel=0.15)
        assert few > 0.8 * (found <= k).mean()


def test_benjamini_hochberg_on_bins():
    rng = random.Random(1)
    for _ in range(50):
        bins = [rng.choice([rng.randrange(5), rng.randrange(60), rng.randrange(300)]) for _ in range(200)]
        p = sorted(math.exp(-b / 10) for b in bins)
        k = max((i + 1 for i in range(200) if p[i] <= 0.05 * (i + 1) / 200), default=0)
        least = least_bin({b: bins.count(b) for b in bins}, 200, 0.05)
        assert sum(b >= least for b in bins) == k


def planted(n, seed=4):
    rng = random.Random(seed)
    words = ["the", "house", "of", "commons", "internationalization", "was", "characteristically", "Quiet", "and", "getElementsByTagName", "12", "2024", "https://example.com/en/articles/understanding-things", "====================", "1234567890123456"]
    docs, truth = [], {}
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(120))
        if i % 4 == 0:
            alphabet = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789ABCDEF", string.ascii_lowercase + string.digits)[i // 4 % 4]
            s = "".join(rng.choice(alphabet) for _ in range(rng.choice((32, 40, 64))))
            text = f"été {text}\n{s} end"
            truth[i] = s
        docs.append((i, text))
    return docs, truth


def test_random_strings_are_found_and_words_are_not(spark):
    docs, truth = planted(600)
    rows = scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    text = dict(docs)
    found = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "random"] for r in rows}
    hit = sum(truth[i] in found[i] for i in truth)
    assert hit >= 0.95 * len(truth), hit
    wrong = [s for i, x in found.items() for s in x if s != truth.get(i)]
    assert len(set(wrong)) <= 0.05 * len(truth), wrong


def test_scan_by_brute_force(spark):
    """The same spans from thresholds learned in one pass over plain Python."""
    docs, _ = planted(120, 9)
    docs += [(500, 'token = "' + "9f" * 12 + '" and AKIA' + "Q7" * 9), (501, None), (502, ""), (None, "password: correcthorse"), (500, "plain"), (503, "x" * 300_000), (504, "été " * 40_000)]
    counts, pairs, changes, distinct = np.zeros(128), 0, 0, {}
    cls = lambda c: next((i for i, a in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits, "+/_-")) if c in a), None)
    for _, t in docs:
        for c in t or "":
            if ord(c) < 128:
                counts[ord(c)] += 1
        for a, b in zip(t or "", (t or "")[1:]):
            if cls(a) is not None and cls(b) is not None:
                pairs, changes = pairs + 1, changes + (cls(a) != cls(b))
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", t or ""):
            if x := looks_of(m[0].encode()):
                distinct[m[0]] = x
    back = Background.of(counts, pairs, changes)
    classes = {}
    for x in distinct.values():
        classes.setdefault(secret_scan.length_class(x.length), []).append(x)
    least = {}
    for c, xs in classes.items():
        bins = [back.bin(x) for x in xs if x.p_random >= 0.01]
        least[c] = least_bin({b: bins.count(b) for b in bins}, len(xs), 0.05)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("spans", F.lit(1)).withColumn("counts", F.lit("a"))
    known = learn_thresholds(df)
    assert known.background == back and all(known.least[c] == v for c, v in least.items())
    got = sorted((r.doc_id is not None, r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.spans], [(s.kind, s.start, s.end) for s in r.base]) for r in scan_secrets(df).collect())
    want = []
    for i, t in docs:
        base = base_spans(t or "")
        more = [(m.start(), 3, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", t or "") if not any(a <= m.start() and m.end() <= b for a, _, b in base) and m[0] in distinct and distinct[m[0]].p_random >= 0.01 and back.bin(distinct[m[0]]) >= least[secret_scan.length_class(len(m[0]))]]
        name = lambda spans: [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(spans)]
        want.append((i is not None, i or 0, name(base + more), name(base)))
    assert got == sorted(want)
    assert scan_secrets(df.where("1 = 0")).collect() == []


def test_op11_base_columns_agree_with_sql(spark):
    """The patterns in DuckDB's dialect, the offsets from the lengths of what is left of each match."""
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in queries.op11_secret_scan(spark, SF).collect()}
    con = duckdb.connect()
    assign = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    rows = con.execute(f"SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{assign}', 2), lambda g: length(g) >= 6)), len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda g: length(g) >= 20)), len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda g: length(g) >= 24)) FROM '{SF}/documents.parquet'").fetchall()
    assert {r[0]: tuple(r[1:]) for r in rows} == {i: v[:3] for i, v in got.items()} and any(v[0] for v in got.values())
    for a, c, h, digest, spans in got.values():
        base = [s for s in spans.split(",") if s and not s.startswith("random:")]
        assert len(base) == a + c + h and digest == hashlib.sha256(",".join(base).encode()).hexdigest()
