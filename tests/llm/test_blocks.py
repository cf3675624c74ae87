"""The exchange of keys: two levels against one, and the number of packets that a block sends."""

from collections import Counter

import numpy as np
import pytest

from cytoframe.llm import _blocks as B
from cytoframe.llm import embed_neardup, ngram_join, suffix_dedup, window_dedup


def plan(blocks, coarse, ranges):
    out = object.__new__(B.Plan)
    out.blocks, out.coarse, out.ranges, out.bits = blocks, coarse, ranges, 40
    return out


@pytest.mark.parametrize("ops", ["+", "+<", "=<"])
@pytest.mark.parametrize("coarse, ranges, group", [(4, 4, 1024), (4, 12, 3), (2, 20, 1), (1, 5, 100)])
def test_blocks_are_told_what_others_know(spark, monkeypatch, ops, coarse, ranges, group):
    monkeypatch.setattr(B, "GROUP", group)
    random, rows, want = np.random.default_rng(3), [], {}
    held = {}
    for block in range(11):
        keys = np.unique(random.integers(0, 60, 25).astype(np.uint64)) << np.uint64(34)
        columns = [(keys.astype(np.int64) >> 34) % 3 if op == "=" else random.integers(1, 9, len(keys)) for op in ops]
        if ops[0] == "=":
            columns[0] = columns[0] + random.integers(0, 2, len(keys))
        held[block] = [tuple(map(int, r)) for r in zip(keys, *columns)]
        rows += B.packets(block, keys, columns, 40, coarse).to_pylist()
    same = 2 if ops[0] == "=" else 1
    for block, own in held.items():
        for row in own:
            every = [r for other in held.values() for r in other if r[:same] == row[:same]]
            merged = (*row[:same], *[sum(r[k] for r in every) if ops[k - 1] == "+" else min(r[k] for r in every) for k in range(same, len(row))])
            if merged != row:
                want.setdefault(block, []).append(merged)
    got = B.exchange(spark.createDataFrame([(r["range"], r["block"], bytearray(r["packet"])) for r in rows], B.PACKET), ops, plan(11, coarse, ranges), 40).toArrow()
    have = {}
    for block, packet in zip(got.column("block").to_pylist(), got.column("packet").to_pylist()):
        have.setdefault(block, []).extend(tuple(map(int, r)) for r in zip(*B.unpack(packet, len(ops))))
    assert {b: sorted(r) for b, r in have.items()} == {b: sorted(r) for b, r in want.items()}


def test_operators_give_the_same_rows_by_two_levels(spark, monkeypatch):
    random = np.random.default_rng(8)
    words = ["".join(random.choice(list("abcdefg"), 5)) for _ in range(40)]
    common = " ".join(random.choice(words, 40))
    texts = [" ".join(random.choice(words, int(random.integers(5, 60)))) + (f" {common} {k % 4}" if k % 3 else "") for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    vectors = spark.createDataFrame([(k, 0, (random.normal(size=8) * 0.1 + np.eye(8)[k % 5]).tolist()) for k in range(90)], "vec_id long, label int, embedding array<double>")
    runs = [lambda: ngram_join.similar_documents(docs, 4, 60), lambda: suffix_dedup.remove_repeated_bytes(docs), lambda: window_dedup.remove_repeated_windows(docs), lambda: embed_neardup.near_duplicates(vectors)]

    def rows():
        return [Counter(map(repr, run().collect())) for run in runs]

    monkeypatch.setattr(B, "BLOCK_BYTES", 700)
    one = rows()
    made = []
    begin = B.Plan.__init__

    def small(self, *args):
        begin(self, *args)
        self.coarse = 3
        self.ranges = 3 * -(-self.ranges // 3)
        made.append(self)

    monkeypatch.setattr(B, "GROUP", 4)
    monkeypatch.setattr(B.Plan, "__init__", small)
    assert rows() == one and len(made) == 4 and all(p.ranges > p.coarse and p.blocks > 4 for p in made)


def test_packets_of_a_full_block_stay_few(spark):
    for total in (1 << 30, 1 << 40, 100 << 40):
        for per_byte, range_bytes in ((ngram_join.KEYS_PER_BYTE, ngram_join.RANGE_BYTES), (suffix_dedup.KEYS_PER_BYTE, suffix_dedup.RANGE_BYTES), (window_dedup.KEYS_PER_BYTE, 32 << 20)):
            p = B.Plan(spark, total, per_byte, range_bytes)
            assert p.coarse <= max(8, B.BLOCK_BYTES * per_byte / B.LEAST_KEYS) and p.ranges % p.coarse == 0 and p.ranges >= total / range_bytes
