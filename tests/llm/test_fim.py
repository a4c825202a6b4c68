"""Fill-in-middle against a plain version, and the rank index by itself."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.llm import fim
from plotline.llm.queries import ORACLES, op12_fill_in_middle
from tests.llm.test_operators import FOLDER, corpus, empty, odd, rows  # noqa: F401


def by_hand(doc_id, text, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, sha = len(units), lambda t: hashlib.sha256(t.encode()).hexdigest()
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 50
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


def test_digests(spark, odd, corpus):  # noqa: F811
    rng = random.Random(4)
    made = [(k, "".join(rng.choice(["\n", "a", "é", "日本", "<", "P>", "<P", "S>", "M>", "<M", "\r\n", "word "]) for _ in range(rng.randint(0, 30))))
            for k in range(300)]
    made += [(5, made[5][1]), (5, "other\ntext"), (7, "\n" * 5000 + "x" * 200_000 + "\n" * 3), (-3, "minus\n"), (None, "a\nb"), (None, None)]
    made = spark.createDataFrame(made, "doc_id long, text string").withColumns({"form": F.lit("f"), "output": F.lit(1), "n": F.lit(2)})
    for frame in (made, odd, corpus, empty(odd)):
        want = [by_hand(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        got = [tuple(r) for r in fim.digests(frame).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_no_text_is_rearranged_at_zero_percent(corpus):  # noqa: F811
    assert fim.transformed(corpus, percent=0).where("form <> 'plain'").count() == 0


@pytest.mark.parametrize("error", [1, 8, 512])
def test_rank_index_is_exact(error):
    rng = np.random.default_rng(error)
    for offsets in ([], [0], [0, 1], np.arange(5000), np.cumsum(rng.integers(1, 200, 5000)), np.cumsum(rng.integers(1, 3, 900) ** 12),
                    np.r_[np.arange(1000), 10 ** 9 + np.arange(1000) * 1000]):
        index = fim.RankIndex(np.array(offsets, np.int64), error)
        assert (index.at(np.arange(len(offsets))) == np.asarray(offsets)).all()
        assert not len(offsets) or np.abs(index.residuals).max() <= error + 1
    assert len(fim.RankIndex(np.arange(0, 500_000, 7)).starts) == 1


def test_agrees_with_sql(spark):
    import duckdb
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = op12_fill_in_middle(spark, FOLDER)
    want = db.execute(ORACLES["op12_fill_in_middle"]).fetchall()
    assert rows(got) == sorted(want)
