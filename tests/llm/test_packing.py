import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from heightline.llm import packing
from tests.llm.brute import sequences


def encoded(text):
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [packing.END], "<u4")


def check(pieces, rows, length=packing.LENGTH):
    """Every id in exactly one piece, offsets gapless, no sequence above length."""
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(encoded(t))
    assert set(by_doc) == set(want)
    for i, own in by_doc.items():
        expected = sorted((s, min(length, len(ids) - s), zlib.crc32(ids[s : s + length].tobytes()), len(ids)) for ids in want[i] for s in range(0, len(ids), length))
        assert sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in own) == expected
    for own in sequences(pieces).values():
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at <= length


def test_whole_texts_are_packed(spark, table, edge_rows):
    pieces = packing.op1_packing(spark, table(edge_rows)).collect()
    check(pieces, edge_rows)


def test_padding_is_little(spark, sf_dir):
    pieces = packing.op1_packing(spark, sf_dir).collect()
    found = sequences(pieces)
    filled = sum(p["length"] for p in pieces)
    assert filled / (len(found) * packing.LENGTH) > 0.97


def test_empty_table(spark, table):
    assert packing.op1_packing(spark, table([])).collect() == []


def test_sequences_hold_the_ids(spark, table, edge_rows):
    rows = [(i, t) for i, t in edge_rows if i is not None and i < 80]
    docs = spark.read.parquet(table(rows) + "/documents.parquet")
    packed = packing.pack(docs, public_tokenizers.path(packing.VOCABULARY), length=128, keep_ids=True)
    pieces = packed.drop("ids").collect()
    check(pieces, rows, 128)
    ids = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for k, own in sequences(pieces).items():
        assert len(ids[k]) == 4 * sum(p["length"] for p in own)


def test_linear_program_beats_nothing_by_hand():
    # 60 + 40 fill a sequence; twice 50 does too.
    plan = packing.plan({60: 10, 40: 10, 50: 6}, 100)
    assert sum(times for _, times in plan) == 13
    used = defaultdict(int)
    for pattern, times in plan:
        assert sum(c * n for c, n in pattern.items()) <= 100
        for c, n in pattern.items():
            used[c] += n * times
    assert dict(used) == {60: 10, 40: 10, 50: 6}


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_no_worse_than_first_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(c): int(n) for c, n in zip(rng.choice(np.arange(1, 120), 40, replace=False), rng.integers(1, 60, 40))}
    plan = packing.plan(histogram, 128)
    used = defaultdict(int)
    for pattern, times in plan:
        assert sum(c * n for c, n in pattern.items()) <= 128
        for c, n in pattern.items():
            used[c] += n * times
    assert dict(used) == histogram
    widths = np.array(sorted(histogram))
    greedy = packing.first_fit_decreasing(widths, np.array([histogram[int(w)] for w in widths]), 128)
    assert sum(t for _, t in plan) <= len(greedy)


def test_price_equals_search():
    rng = np.random.default_rng(1)
    widths, duals = np.array([3, 5, 7]), rng.random(3)
    value, pattern = packing.price(duals, widths, 23)
    best = max((a * duals[0] + b * duals[1] + c * duals[2]) for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 23)
    assert abs(value - best) < 1e-9 and (pattern * widths).sum() <= 23 and abs(pattern @ duals - value) < 1e-9


def test_word_coder_over_small_tables():
    texts = ["Hello  World", "", "a\x01b \x01", "naïve 日本 x" * 5, "Hello again"]
    coder = packing.WordCoder(public_tokenizers.path(packing.VOCABULARY), most=2)
    for _ in range(3):
        ids, sizes = coder.encode([t.encode() for t in texts])
        ends = np.cumsum(sizes)
        for t, a, b in zip(texts, ends - sizes, ends):
            assert ids[a:b].tolist() == encoded(t)[:-1].tolist()


def test_special_tokens_of_the_library_keep_their_ids(spark, table):
    rows = [(1, "<|endoftext|> a"), (2, "a<|endoftext|>b <|startoftext|>"), (3, "Words, and marks! 'tis É é ﬁ <|ENDOFTEXT|>")]
    check(packing.op1_packing(spark, table(rows)).collect(), rows)
    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    assert plain.encode("<|endoftext|> a", add_special_tokens=False).ids == [49407, 320]


def test_words_encoded_apart_give_the_ids_of_whole_texts():
    c = packing.WordCoder(public_tokenizers.path(packing.VOCABULARY), most=8)
    assert c.folds
    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = ["Hello, WORLD. it's don't. we'll! a1b2 x́ naïve, IJSSEL? İstanbul ... end.", "stop. Stop; 'S s 's, n't's", ""]
    for _ in range(3):
        ids, sizes = c.encode([t.encode() for t in texts])
        assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        c.forget()
