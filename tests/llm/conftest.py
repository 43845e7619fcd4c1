import random
import uuid

import pytest

from tests.llm.brute import DOCS

SYLLABLES = "ka lo mi te ra nu se vo di pa zu be ho ti ga".split()


def prose(rng, n, vocabulary=400):
    made = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    return [rng.choice(made) for _ in range(n)]


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty, short and very long texts, exact and near copies, shared passages, repeated rows."""
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one"), (6, "ONE two three four"), (7, "one two three  four")]
    base = prose(rng, 120)
    passage = prose(rng, 70)
    rows += [(20 + i, " ".join(base)) for i in range(4)]
    for i in range(6):
        w = list(base)
        w[rng.randrange(len(w))] = "changed"
        rows.append((40 + i, " ".join(w)))
    for i in range(5):
        rows.append((60 + i, " ".join(prose(rng, 40 + i) + passage + prose(rng, 30))))
    rows.append((70, " ".join(passage[:49])))
    rows.append((71, " ".join(passage + passage)))
    rows.append((72, "a " * 300))
    rows.append((73, "\n".join(prose(rng, 30_000, 4000)) + " " + " ".join(passage)))
    rows.append((74, "x" * 200_000))
    rows.append((75, "É è ñ 日本語 \U0001f600 nbsp\xa0here \x1c control \x01 mark <|endoftext|>"))
    for n in range(4, 14):
        w = prose(rng, n)
        rows += [(100 + n, " ".join(w)), (200 + n, " ".join(w + ["more"])), (300 + n, " ".join(w[1:]))]
    rows += [(20, " ".join(base)), (60, " ".join(prose(rng, 80))), (60, rows[20][1]), (None, " ".join(base)), (None, None)]
    return rows


@pytest.fixture
def table(spark, tmp_path):
    """Writes rows of (doc_id, text) as a documents table and returns its folder."""

    def make(rows, schema=DOCS, name="documents"):
        folder = tmp_path / uuid.uuid4().hex
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows] if schema == DOCS else rows
        spark.createDataFrame(full, schema).repartition(3).write.parquet(str(folder / f"{name}.parquet"))
        return str(folder)

    return make


@pytest.fixture(scope="session")
def clashing(spark):
    """Documents whose further columns have the names that operators use or make."""
    names = "_text score Predicted shard SLOT _id _cuts media n_bytes ids decoded start length key n component row _target host".split()
    rows = [(i, f"some words of document {i} " * 20, *(f"{c}{i}" for c in names)) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
