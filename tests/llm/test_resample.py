"""Importance resampling against loops over whole texts, for any size of chunks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cytoframe.llm import _crc, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(FOLD))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def brute(docs, target):
    rows, s, t = [features(x) for _, x in docs], Counter(), Counter()
    for _, f in rows:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in s}
    out = []
    for (i, _), (words, f) in zip(docs, rows):
        weight = sum(gain[b] * k for b, k in f.items())
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted((tuple(r) + (ranks.get(id(r)),) for r in out), key=repr)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["", "É", "x1", "Un", "ü"]) + "".join(rnd.choice("abcdeßZ") for _ in range(rnd.randint(1, 4)))
    prose = lambda k: rnd.choice([" ", ", ", "\n"]).join(word() for _ in range(k))
    docs = [(i, prose(rnd.randint(1, 70))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " ,.- \n"), (203, "a" * 5000 + " b " + "c" * 70 + " d"), (204, prose(4000)), (None, prose(40)), (205, docs[0][1]), (206, docs[0][1]), (207, "one"), (208, "- " * 3000)]
    docs += [(300, "a " * 25), (300, "a " * 25)]  # repeated rows
    return docs, [prose(30) for _ in range(20)] + [None, "", docs[3][1]]


@pytest.mark.parametrize("chunk", [1 << 18, 1000, 40])
def test_scores_and_draw(spark, rows, chunk):
    docs, target = rows
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, rank int, bucket string").repartition(3)
    other = spark.createDataFrame([(t, 0) for t in target], "text string, doc_id int")
    got = resample.importance_scores(df, other, chunk_bytes=chunk)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr) == brute(docs, target)


def test_a_tie_goes_to_the_smaller_id(spark, rows, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(resample, "draw_noise", lambda *_: F.lit(0).cast("long"))
    df = spark.createDataFrame([(i, "word " * 20) for i in range(45, 0, -1)], "doc_id long, text string").repartition(4)
    got = resample.importance_scores(df, df.limit(0), percent=10).where("rank IS NOT NULL").collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.importance_scores(none, none).count() == 0
    assert resample.importance_scores(spark.createDataFrame([(1, None)], "doc_id long, text string"), none).first()["weight"] == 0


def test_drawn_rows_keep_their_columns(spark, rows):
    docs, target = rows
    df = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(docs)], "doc_id long, text string, source string")
    other = spark.createDataFrame([(t,) for t in target], "text string")
    drawn = resample.resample(df, other)
    assert drawn.columns == df.columns
    assert {r.doc_id for r in drawn.collect()} == {i for i, *_, rank in brute(docs, target) if rank}


def test_chunks_of_a_long_text_own_each_word_once():
    text = ("Wörter, und " * 3000 + "x" * 900 + " end").encode()
    words = re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)
    at = 0
    for owned, part in resample.split_text(text, 3, 500):
        assert re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", part) == words[at : at + owned + 2]
        at += owned
    assert at == len(words)


def test_crc_of_joined_runs():
    data = bytes(random.Random(1).randrange(256) for _ in range(9000))
    start, size = np.array([0, 5, 80, 300, 4000, 8999, 20]), np.array([5, 0, 64, 65, 4900, 1, 63])
    crc = _crc.crc32(np.frombuffer(data, np.uint8), start, size)
    parts = [data[a : a + n] for a, n in zip(start, size)]
    assert crc.tolist() == [zlib.crc32(p) for p in parts]
    assert _crc.joined(_crc.then_space(crc[:-1]), crc[1:], size[1:]).tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(parts, parts[1:])]
