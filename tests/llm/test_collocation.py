import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from heightline.llm import collocation
from tests.llm.brute import DOCS
from tests.oracle import same


def plain(rows, longest=3, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang), counting every phrase."""
    seen, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        for piece in re.split(rb"[.,;:!?\n\x0b\x0c\r]", raw):
            w = re.findall(rb"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    seen[lang, tuple(w[i : i + k])] += 1
    often = {k: f for k, f in seen.items() if len(k[1]) > 1 and f >= least}
    lost = set()
    for (lang, p), f in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                sub = (lang, p[i : i + k])
                if 100 * f >= 50 * seen[sub]:
                    lost.add(sub)
    out = []
    for lang in n:
        found = []
        for (x, p), a in often.items():
            if x == lang and (x, p) not in lost:
                score, k = min((1_000_000 * a * a // (seen[x, p[:k]] * seen[x, p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, b" ".join(p), seen[x, p[:k]], seen[x, p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(edge_rows):
    rng = random.Random(5)
    words = ["the", "The", "of", "new", "york", "city", "san", "é", "É", "日本", "x\xa0y", "a.b", "end.", "q;", "wait", "\tt"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(120))), rng.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(150)]
    rows += [("new york city " * 30 + "one two three.\n" * 12, "en"), ("a a a a " * 20, "de"), (None, "en"), (None, None), ("", "fr"), ("... ,,", "fr")]
    return rows + [(t, rng.choice(["en", None])) for _, t in edge_rows if t is None or len(t) < 50_000]


def written(table, rows):
    return table([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], DOCS + " ")


def test_edges(spark, table, corpus):
    got = rows_of(collocation.op13_collocations(spark, written(table, corpus)))
    assert got == sorted(plain(corpus), key=repr) and len(got) > 100


@pytest.mark.parametrize("longest,least,top", [(2, 1, 7), (4, 3, 50), (5, 2, 2000)])
def test_other_lengths(spark, corpus, longest, least, top):
    some = corpus[:60]
    docs = spark.createDataFrame(some, "text string, lang string").repartition(4)
    got = rows_of(collocation.collocations(docs, longest=longest, least=least, top=top))
    assert got == sorted(plain(some, longest, least, top), key=repr)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("word " * 9, "en")], [("word " * 10, "en")]])
def test_few_rows(spark, table, rows):
    assert rows_of(collocation.op13_collocations(spark, written(table, rows))) == sorted(plain(rows), key=repr)


def test_few_buckets_change_nothing(spark, corpus, monkeypatch):
    """With so few that most bits are set, exact counts alone decide."""
    monkeypatch.setattr(collocation, "LEAST_BITS", 6)
    monkeypatch.setattr(collocation, "MOST_BITS", 6)
    docs = spark.createDataFrame(corpus, "text string, lang string")
    assert rows_of(collocation.collocations(docs)) == sorted(plain(corpus), key=repr)


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(collocation, "SLICE", 100)
    texts = ["one two three. " * 50, "x" * 500, "", "ab, " * 3 + "y" * 300 + "; tail words here", ".." * 120]
    cut = collocation._pieces(pa.array(texts, pa.large_string())).to_pylist()
    assert "".join(cut) == "".join(texts) and len(cut) > 8
    assert sum(len(t) > 100 for t in cut) <= 2
    pieces = lambda ts: Counter(p for t in ts for p in re.split("[.,;]", t) if p)
    assert pieces(cut) == pieces(texts)


def test_clashing_columns(spark):
    rows = [("new york " * 20, "en", "x", "y", "z")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, phrase string, f string, n string")
    assert [r["phrase"] for r in collocation.collocations(docs).orderBy("rank").collect()] == [p for _, _, p, *_ in plain([r[:2] for r in rows])]


def test_query_equals_its_twin(spark, sf_dir):
    same(collocation.op13_collocations(spark, sf_dir), collocation.ORACLE, sf_dir)
