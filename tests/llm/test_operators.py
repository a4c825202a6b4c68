"""The corpus operators against brute force on small fixtures: nulls, empties, ties, repeats, odd texts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotline.llm import (components, idfiles, kdtrees, licences, packing, pieces, rangecoder, shingles, suffixes,
                          tiles, toxicity, unigram, vocabulary)
from plotline.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
ODD = ["", "  ", " A  b\tC d\x85e\nF", "<|endoftext|>Foo<|ENDOFTEXT|> x <s> </s>", "ÀÉ ÑñÇ ß İ J̌ K ΣΑΣ ﬁ", "x",
       "don't \n\n we'll it'S 12345 a1b2 \x00\x01 ½²ªº\n", "it's 'sx ''s a'll b'rev 9'd 'l ¿Qué? «a» ×÷", "日本語 テスト, 👍🏽",
       " x y\x1cz", "a" * 3000, "▁a ▁▁b c▁d", "\nfoo\n bar \n  baz ", " ", "\n", "▁", None, "MIT License mit LICENSE x General Public License"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a row without an id, and columns named like the operators' own."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, "x"), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.withColumns({"block": F.lit("x"), "part": F.lit(1), "guard": F.lit(None).cast("long"), "length": F.lit(2)})


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts(frame):
    return [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect() if r.doc_id is not None]


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def empty(frame):
    return frame.where("1 = 0")


def test_token_counts(odd, corpus):
    import sentencepiece
    path = vocabulary.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for frame in (odd, corpus, empty(odd)):
        want = [(i, len(t.encode()), len(n := model.encode(t)), len(n) > 4096) for i, t in texts(frame)]
        assert rows(pieces.token_counts(frame, path)) == sorted(want)


def test_ids_packing_and_files(odd, corpus):
    from tokenizers import Tokenizer
    path = vocabulary.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for frame in (odd, corpus, empty(odd)):
        ids = sorted((i, t, library.encode(t, add_special_tokens=False).ids) for i, t in texts(frame))
        want, at = [], 0
        for i, _, x in ids:
            whole = np.array([*x, 1], np.uint32)
            want.append((i, at, len(whole), zlib.crc32(whole.tobytes())))
            at += len(whole)
        assert rows(idfiles.through_files(frame, path, 1, 49408)) == want
        got = packing.sequences(frame, path, 2).collect()
        whole = sorted((i, len(x) + 1) for i, _, x in ids)
        assert sorted((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == whole
        held, by_doc = defaultdict(list), defaultdict(int)
        for r in got:
            held[r.sequence_id].append((r.offset, r.length))
            by_doc[r.doc_id] += r.length
        for parts in held.values():
            upto = 0
            for offset, length in sorted(parts):
                assert offset == upto
                upto += length
            assert upto <= 4096
        assert sum(by_doc.values()) == sum(n for _, n in whole)
        first = {i: np.array([*x, 2], np.uint32) for i, _, x in ids}
        for r in got:
            if [i for i, _ in whole].count(r.doc_id) == 1:
                assert zlib.crc32(first[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32


def test_bins_keep_all_limits():
    demand = np.random.default_rng(0).integers(1, [400, 3, 300], (500, 3))
    limits = np.array([1000, 6, 800])
    bins = packing.place(demand, limits)
    assert (bins >= 0).all()
    assert all((demand[bins == b].sum(axis=0) <= limits).all() for b in set(bins.tolist()))
    with pytest.raises(ValueError):
        packing.place(np.array([[2000, 1, 1]]), limits)


@pytest.mark.parametrize("n", [0, 1, 255, 600, 5000])
@pytest.mark.parametrize("size", [1, 2, 300, 49408])
def test_blocks_round_trip(n, size):
    ids = np.random.default_rng(n).integers(0, size, n)
    ids[n // 2:] = ids[:n - n // 2]
    block = rangecoder.encode_block(ids, np.array([n // 2, n - n // 2]), size)
    back, sizes = rangecoder.decode_block(block)
    assert (back == ids).all() and len(back) == n and sizes.tolist() == [n // 2, n - n // 2]
    with pytest.raises(ValueError):
        rangecoder.decode_block(block[:-1] + bytes([block[-1] ^ 1]))


def viterbi(text, normal, vocab):
    if not text:
        return []
    s = "▁" + text.replace(" ", "▁")
    best, back = [0.0] + [-np.inf] * len(s), [None] * (len(s) + 1)
    for a in range(len(s)):
        for b in range(a + 1, min(len(s), a + 16) + 1):
            if s[a:b] in normal and best[a] + normal[s[a:b]][1] > best[b]:
                best[b], back[b] = best[a] + normal[s[a:b]][1], (a, [normal[s[a:b]][0]])
        if s[a] not in normal and best[a] + vocab.worst > best[a + 1]:
            best[a + 1], back[a + 1] = best[a] + vocab.worst, (a, [int(vocab.byte_ids[x]) for x in s[a].encode()])
    out, b = [], len(s)
    while b:
        a, ids = back[b]
        out, b = ids + out, a
    return out


def test_unigram(odd, corpus):
    path = vocabulary.tokenizer_path("piece_bpe_32k.model")
    vocab, model, normal = unigram.vocabulary(path), pieces.opened(path), {}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            normal[model.id_to_piece(i)] = i, -float(round(1e6 * np.log(len(normal) + 3)))
    for frame in (odd, corpus.limit(40), empty(odd)):
        source = texts(frame)
        want = sorted((i, len(x := viterbi(t, normal, vocab)), zlib.crc32(np.array(x, np.uint32).tobytes()), "▁" not in t)
                      for i, t in source)
        got = unigram.coded(frame, path)
        assert rows(got.select("doc_id", "n_tokens", "ids_crc32", "exact")) == want


def test_toxicity(spark, odd, corpus):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert toxicity.scored(odd, empty(labels)).where("rejected").count() == 0
    got = toxicity.scored(corpus, labels)
    assert got.count() == corpus.count()
    assert toxicity.scored(empty(corpus), labels).count() == 0
    bad = ["idiot", "moron", "scum"]
    rng = random.Random(1)
    made = []
    for i in range(600):
        words = [rng.choice("alpha beta gamma delta house tree river cloud stone light".split()) for _ in range(40)]
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(bad) + rng.choice(["", "ic", "isch"])
        made.append((i, " ".join(words), i % 3 % 2, int(i % 4 == 0)))
    made = spark.createDataFrame(made, "doc_id long, text string, quality int, toxic int")
    marks = made.where("doc_id < 300").select("doc_id", "quality", "toxic")
    held_out = toxicity.scored(made, marks).join(made.select("doc_id", F.col("toxic").alias("truth")), "doc_id").where("doc_id >= 300")
    assert held_out.where("rejected <> (truth = 1)").count() <= 3
    kept = toxicity.kept(odd, marks)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_licences(odd, corpus):
    for frame in (odd, corpus, empty(odd)):
        want = []
        for i, t in texts(frame):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
            found = [(k, label) for phrase, label in licences.BASE.items() for k in range(len(words))
                     if words[k:k + len(phrase.split())] == phrase.split()]
            at = [k for k, _ in found]
            want.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
        key = lambda r: (r[0], r[1:3])
        got = licences.scan(frame)
        assert sorted(map(tuple, got.drop("labels", "score").collect()), key=key) == sorted(want, key=key)
        for r in got.collect():
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licence_templates(spark):
    text = "intro " + dict(licences.TEMPLATES)["bsd"].replace("source and", "source, well, and") + " outro"
    got = licences.scan(spark.createDataFrame([(1, text), (2, "in the and of")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in got} == {1: "bsd", 2: ""}


def linked_by_hand(source):
    sets = []
    for i, t in source:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append((i, {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    root = {i: i for i, _ in source}

    def find(x):
        return x if root[x] == x else find(root[x])
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = find(sets[a][0]), find(sets[b][0])
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("chunk", [1000, 20])
def test_ngram_join(spark, chunk):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.choice([3, 8, 30, 60]))] for _ in range(10)]

    def near(words):
        words = list(words)
        for _ in range(rng.randint(0, max(1, len(words) // 12))):
            words[rng.randrange(len(words))] = rng.choice("klmnop")
        return " ".join(words)
    made = spark.createDataFrame([(k, near(rng.choice(base))) for k in range(250)], "doc_id long, text string")
    assert rows(shingles.linked(made, chunk_sets=chunk)) == linked_by_hand(texts(made))


def test_ngram_join_odd(odd, corpus):
    for frame in (odd, corpus, empty(odd)):
        assert rows(shingles.linked(frame)) == linked_by_hand(texts(frame))


def test_ngram_join_of_an_id_with_two_texts(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyz")
    for made in ([(4, x), (5, x), (5, y), (9, y[:-4])], [(4, x), (4, y), (7, y), (8, x[:-4])],
                 [(1, z), (2, z[:-4]), (2, x), (3, x), (3, y), (6, y)], [(4, x), (4, y), (5, z), (5, z), (6, None)]):
        frame = spark.createDataFrame(made, "doc_id long, text string")
        assert rows(shingles.linked(frame)) == linked_by_hand(texts(frame))


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(rows(components.components(chain)))
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def removed_by_hand(source):
    first = {}
    for i, t in source:
        b = t.encode()
        for p in range(len(b) - 49):
            first[b[p:p + 50]] = min(first.get(b[p:p + 50], i), i)
    out = []
    for i, t in source:
        b, gone = t.encode(), bytearray(len(t.encode()))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_repeats(spark, odd, corpus):
    rng = random.Random(3)
    shared = ["".join(rng.choice("ab é") for _ in range(rng.choice([49, 50, 51, 80, 200]))) for _ in range(12)]
    made = [(rng.randint(0, 90), "".join(rng.choice([rng.choice(shared), "".join(rng.choice("abc d") for _ in range(rng.randint(0, 60)))])
                                         for _ in range(rng.randint(0, 7)))) for _ in range(150)]
    made = spark.createDataFrame([*made, (7, "a" * 300), (3, "a" * 70)], "doc_id long, text string")
    for frame in (made, odd, corpus, empty(odd)):
        assert rows(suffixes.repeats(frame)) == removed_by_hand(texts(frame))
    left = {r.doc_id: r.text for r in suffixes.without_repeats(corpus).collect()}
    want = {i: n - gone for i, n, gone, _, _ in removed_by_hand(texts(corpus))}
    assert all(want[i] <= len(t.encode()) < want[i] + 60 for i, t in left.items())


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    held = [(i, [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(250)]
    held += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (400, [0.0] * 8), (500, [1.0] * 4), (600, [2.0] * 4), (700, [])]
    frame = spark.createDataFrame([(*r, "x") for r in held], "vec_id long, embedding array<float>, cell string")
    fine = [(i, v) for i, v in held if v and all(x is not None and np.isfinite(x) for x in v)]
    for every, k, run, zero in ((20, 20, tiles.nearest, False), (100, 10, kdtrees.search, True)):
        want = []
        for q, x in fine:
            if q % every == 0 and (zero or any(x)):
                scale = (lambda v: [np.floor(1024 * c) for c in v]) if zero else (lambda v: v)
                found = sorted((-float(np.dot(scale(x), scale(y))), i) for i, y in fine
                               if i != q and len(x) == len(y) and (zero or any(y)))[:k]
                want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
        assert rows(run(frame, every, k, rows=100)) == sorted(want)
        assert run(empty(frame), every, k).count() == 0


@pytest.mark.parametrize("name", ["op6_nearest", "op7_exact_search"])
def test_agrees_with_sql(spark, name):
    import duckdb
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    got = QUERIES[name](spark, FOLDER)
    want = db.execute(ORACLES[name]).df()[got.columns]
    assert rows(got) == sorted(map(tuple, want.itertuples(index=False, name=None)))


def test_pipeline(spark, odd):
    import corpus_pipeline
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, FOLDER)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert after.join(at.select("doc_id"), "doc_id", "left_anti").count() == 0
        at = spark.createDataFrame(after.collect(), after.schema)
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in at.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, FOLDER).columns == odd.columns


def test_pipeline_loses_no_text_without_a_decision(spark):
    import corpus_pipeline
    x, y, z, w = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyzw")
    given = [(4, x), (5, x), (5, y), (9, y[:-4]), (7, z), (7, z), (None, w), (None, x), (None, "only words"), (8, None)]
    at = spark.createDataFrame(given, "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, FOLDER)
        if name == "toxicity":
            assert at.count() == len(given)
        at = spark.createDataFrame(at.collect(), at.schema)
    left = [(4, x), (5, y), (7, z), (None, w), (None, "only words"), (8, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in at.collect()))) == sorted(map(str, left))
    packed = corpus_pipeline.STAGES[-1][1](spark, at, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in packed) == sorted(str(i) for i, _ in left)
    both = spark.createDataFrame([(5, x), (5, y), (3, y)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.without_repeats(spark, both, FOLDER).collect())) == [(3, y), (5, ""), (5, x)]


def test_pipeline_cuts_repeats_without_a_second_shuffle_of_texts(spark):
    import corpus_pipeline
    x, y = (" ".join(f"{c}{k}" for k in range(40)) for c in "xy")
    given = spark.createDataFrame([(1, x, "a", [1, None], 5), (2, x + y, "b", None, None), (2, x + y, None, [], 7), (None, x, "c", [2], 1)],
                                  "doc_id int, text string, text2 string, list array<int>, n_chars int").withColumnRenamed("text2", "c1")
    out = corpus_pipeline.without_repeats(spark, given, FOLDER)
    assert out.dtypes == given.dtypes
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame(
        [(1, x, "a", [1, None], len(x)), (2, y, "b", None, len(y)), (2, y, None, [], len(y)), (None, x, "c", [2], 1)], out.schema).collect()))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pre_tokens_travel_with_a_space_behind_each():
    for keys in ([], [""], ["", "a", "", "\nb", "\u2581\u2581c", "\u00e9\u4e2d", ""]):
        column = pa.array(keys, pa.large_string())
        assert pieces.cut(np.frombuffer(pieces.ended(column), np.uint8)).to_pylist() == keys
        if len(keys) > 2:
            assert pieces.cut(np.frombuffer(pieces.ended(column.slice(2, 3)), np.uint8)).to_pylist() == keys[2:5]


def test_pipeline_returns_clashing_columns_as_given(spark):
    import corpus_pipeline
    x, y = (" ".join(f"{c}{k}" for k in range(40)) for c in "xy")
    at = spark.createDataFrame([(4, x), (5, x), (6, y), (None, y)], "doc_id long, text string")
    mine = ["_row", "_was", "_left", "_first", "_group", "row", "was", "left", "first", "group", "id", "c0", "c1", "block", "hash"]
    at = at.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce("doc_id", F.lit(-1))) for c in mine}).withColumn("n_chars", F.lit(7))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, FOLDER)
        assert after.dtypes == at.dtypes
        for r in after.collect():
            assert [r[c] for c in mine] == [f"{c}:{-1 if r.doc_id is None else r.doc_id}" for c in mine]
        at = spark.createDataFrame(after.collect(), after.schema)
    assert sorted(str(r.doc_id) for r in at.collect()) == ["4", "6"]
