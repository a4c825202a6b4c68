"""Labels and scores of the licence scan against matching and chaining by hand."""

import random
import time

from plotline.llm import licences


def by_hand(words, templates, phrases, least_match=3, least_cover=0.8, gap=8):
    """Longest runs at each word by trying all, tied to all their places, best chain by trying all."""
    everything = templates + phrases

    def stands(run, text):
        return [k + len(run) - 1 for k in range(len(text) - len(run) + 1) if text[k:k + len(run)] == run]
    longest = [next((n for n in range(i + 1, 0, -1) if any(stands(words[i + 1 - n:i + 1], t) for t in everything)), 0)
               for i in range(len(words))] + [0]
    shares = []
    for t in templates:
        found = [(i, end, n) for i, n in enumerate(longest[:-1]) if n >= least_match and longest[i + 1] != n + 1
                 for end in stands(words[i + 1 - n:i + 1], t)]
        best = {}
        for at, end, n in sorted(found):
            best[at, end] = max([n] + [had + min(n, end - was, at - before) for (before, was), had in best.items()
                                       if before < at and was < end and at - n - before <= gap])
        shares.append(min(len(t), max(best.values(), default=0)) / len(t))
    based = any(stands(p, words) for p in phrases)
    return max([1.0 if based else 0.0, *shares]), {k for k, s in enumerate(shares) if s >= least_cover}


def test_random_templates(spark):
    rng = random.Random(11)
    for letters, runs in (("abc", 12), ("abcdefgh", 12)):
        templates = [[rng.choice(letters) for _ in range(rng.randint(4, 14))] for _ in range(4)]
        texts = []
        for _ in range(60):
            words = []
            for _ in range(rng.randint(0, runs)):
                t = rng.choice(templates)
                a = rng.randrange(len(t))
                words += t[a:a + rng.randint(2, 9)] + [rng.choice(letters + "z") for _ in range(rng.randint(0, 3))]
            texts.append(words)
        frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
        named = [(f"t{k}", " ".join(t)) for k, t in enumerate(templates)]
        for r in licences.scan(frame, named, {"z a z": "zed"}).collect():
            score, labels = by_hand(texts[r.doc_id], templates, [["z", "a", "z"]])
            assert abs(r.score - score) < 1e-12, (texts[r.doc_id], templates)
            assert {x for x in r.labels.split(",") if x.startswith("t")} == {f"t{k}" for k in labels}


def test_a_run_that_a_template_holds_twice(spark):
    frame = spark.createDataFrame([(1, "a b c d q q a b c d")], "doc_id long, text string")
    row = licences.scan(frame, [("twice", "a b c d x y a b c d")], {}).first()
    assert (row.score, row.labels) == (0.8, "twice")


def test_a_long_text_of_notices(spark):
    notice = dict(licences.TEMPLATES)["bsd"].replace("with or without", "with, well, or without") + ". "
    text = notice * (1_000_000 // len(notice))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    licences.scan(frame.limit(0)).collect()
    began = time.time()
    row = licences.scan(frame).first()
    assert row.labels == "bsd" and row.score > 0.9
    assert time.time() - began < 30

    def seconds(n):
        matches = [(k * 7, k % 40, 3 + k % 5) for k in range(n)]
        started = time.time()
        licences.covered(matches, 40)
        return time.time() - started
    assert seconds(40_000) < 5
