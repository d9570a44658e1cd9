"""The pipeline against a brute-force version of its stages."""

import collections
import re
import zlib

import numpy as np
import pytest
from test_operators import SMALL, brute_components, brute_lines, brute_measures, check_places, prose

import corpus_pipeline
from lexloom.llm.packing import Encoder, default_tokenizer


def brute_keep(text):
    n, chars, symbols, dup, repeat = brute_measures(text)
    if n < 10 or 100 * repeat > 20 * n:
        return False
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    bare = sum(not re.search(r"[A-Za-z]|[^\x00-\x7F]", w) for w in words)
    return not (chars < 2 * n or chars > 15 * n or 10 * symbols > 3 * n or 10 * dup > 3 * len(text.split("\n")) or 2 * upper > letters or 3 * bare > n)


def fold(text):
    return re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", text.translate({c: c + 32 for c in range(65, 91)})).strip()


def brute_pipeline(docs, items):
    docs = [(i, t) for i, t in docs if brute_keep(t)]
    lines = brute_lines(docs)
    docs = [(i, lines[i][2]) for i, _ in docs if not lines[i][1] or re.search(r"[^\x20\x09-\x0D]", lines[i][2])]
    root = brute_components(docs)
    docs = [(i, t) for i, t in docs if root[i][1] == i]
    items = [fold(x) for x in items]
    return [(i, t) for i, t in docs if not any(x in fold(t) for x in items)]


def test_run_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = brute_pipeline(docs, items)
    assert 0 < len(want) < len(docs)
    n, total = check_places(want, corpus_pipeline.run(spark, SMALL).collect(), 2048, Encoder(default_tokenizer()).encode)
    assert n <= -(-total // 2048) * 1.02 + 1


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = collections.OrderedDict(documents=docs.count())
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SMALL)
        assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts[name] = docs.count()
        assert docs.where("n_chars <> length(text)").count() == 0
    values = list(counts.values())
    assert values == sorted(values, reverse=True)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "x " * 40, "en", "s", 80)]])
def test_odd_documents(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_an_id_keep_their_texts(spark, tmp_path):
    """(2, A), (4, A), (4, B), (7, B) and the same with 9 in place of 2: one A and one B are packed."""
    rng = np.random.default_rng(6)
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, `a.b` double"
    for low in (2, 9):
        a, b, line = prose(rng, 90), prose(rng, 80), "A line that three documents have in common."
        rows = [(low, f"{line}\n{a}"), (4, a), (4, f"{b}\n{line}"), (7, b), (11, f"{prose(rng, 50)}\n{line}"), (None, prose(rng, 40)), (12, None), (13, "short")]
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "user's", 0.5) for i, t in rows], schema)
        path = tmp_path / str(low)
        docs.write.parquet(str(path / "documents.parquet"))
        spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(path / "benchmark.parquet"))
        now = spark.read.parquet(str(path / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(path))
            assert now.columns == docs.columns
        kept = now.collect()
        assert sorted(t for t in (r.text for r in kept) if t in (a, b)) == sorted([a, b])
        assert all(r.n_lines == "user's" and r.n_chars == len(r.text) for r in kept) and len(kept) == 4
        packed = corpus_pipeline.run(spark, str(path)).collect()
        encode = Encoder(default_tokenizer()).encode
        want = sorted((r.doc_id or -1, zlib.crc32(encode(r.text) + b"\0\0\0\0")) for r in kept)
        assert sorted((r.doc_id or -1, r.ids_crc32) for r in packed) == want
