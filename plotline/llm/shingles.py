"""Operator 4: documents linked by the Jaccard similarity of their word n-grams.

1. Every n-gram is counted in the whole corpus (blocks ask hash partitions, ``exchange``).
   A document of which too few n-grams occur elsewhere cannot link and drops out, exactly.
2. Equal sets become one with a key of its own; the rest is counted again among the sets left.
3. Sets are put in one global order, rarest n-gram first. Two similar sets share one of the
   first ``size - ceil(t * size) + 1`` members (prefix filter). Sets that hold such a member
   form a group around the set with the smallest key holding it, once for each pair of the two.
4. A group is joined over a prefix tree (``trie``). Large groups are dealt in chunks, each
   with the group's leader; what links to the leader is settled, and only sets that do not
   meet the other chunks as visitors. Links are kept as a spanning set of each chunk's classes.
5. Components of the links and of the sets that share an id.

N-grams are compared by fingerprints of 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm import buffers, exchange
from plotline.llm.components import components
from plotline.llm.trie import Trie
from plotline.session import durable

U = np.uint64
WORDS = 5
PERCENT = 75
CHUNK_SETS = 1000
CHUNK_GRAMS = 400_000
SET = "doc_id long, n_shingles long, first long, second long, grams binary"


def least_shared(size, percent: int):
    """The fewest n-grams a set shares with any set that it links to."""
    return -(-size * percent // 100)


def grams(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of every text as (fingerprint, row), sorted by row and fingerprint.

    A-Z is lowered; a word is what stands between white space (0x20, 0x09 to 0x0D). A text of
    fewer words is one n-gram; a text without words has none.
    """
    keep = buffers.byte_table(lambda b: b != 32 and not 9 <= b <= 13)
    low = buffers.lower_table()[data]
    starts, ends, row = buffers.spans(low, offsets, keep)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    word = buffers.span_hash(buffers.prefix_hash(low), starts, ends)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    weights = buffers.mix(np.arange(1, words + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    place = np.arange(len(word)) - first[row]
    begins = np.flatnonzero((place <= count[row] - words) | ((place == 0) & (count[row] < words)))
    h = np.zeros(len(begins), U)
    for k in range(words):
        at = begins + k
        there = place[begins] + k < count[row[begins]]
        h += np.where(there, word[np.minimum(at, len(word) - 1)] * weights[k], U(0))
    h = buffers.mix(h + np.minimum(count[row[begins]], words).astype(U))
    row = row[begins]
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def stored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets kept as bytes (size first, then the n-grams): fingerprints, rows, sizes."""
    all_ = data.view(U)
    edges = offsets // 8
    size = np.zeros(len(edges) - 1, np.int64)
    some = np.diff(edges) > 0
    size[some] = all_[edges[:-1][some]].astype(np.int64)
    mask = np.ones(len(all_), bool)
    mask[edges[:-1][some]] = False
    row = np.repeat(np.arange(len(size)), np.diff(edges))[mask]
    order = np.lexsort((all_[mask], row))
    return all_[mask][order], row[order], size


def counted(frame: DataFrame, read, percent: int) -> DataFrame:
    """Sets whose n-grams occur in other sets often enough to link.

    ``read`` gives (fingerprints, rows, sizes) of a block. Every set comes back with its
    size; ``grams`` is null unless it may link, else the n-grams that others hold too, in
    the global order (by a step of the logarithm of their count, then by value). Counts go by
    the partition and 32 more bits of the fingerprint: partitions stay of bounded size, so few
    n-grams share a count by chance, and those only keep a set for the next step.
    """
    parts, tasks = exchange.dealing(frame)

    def ask(ids, data, offsets):
        keys, n = np.unique(read(data, offsets)[0], return_counts=True)
        yield from exchange.by_part(keys, [(keys & U(0xFFFFFFFF)).astype(np.uint32), n.astype(np.uint32)], parts)

    def answer(keys, n):
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        total = np.bincount(np.cumsum(new) - 1, n[order])
        step = np.where(total < 2, 0, np.minimum(255, 4 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
        out = np.empty(len(keys), np.uint8)
        out[order] = step[np.cumsum(new) - 1]
        return out

    def use(block, guard, ids, data, offsets, replies):
        h, row, size = read(data, offsets)
        keys, back = np.unique(h, return_inverse=True)
        step = exchange.reply_for(keys, parts, replies[0], np.uint8)[back]
        shared = np.bincount(row, step > 0, len(ids)).astype(np.int64)
        may = (size > 0) & (shared >= least_shared(size, percent))
        edge = np.searchsorted(row, np.arange(len(ids) + 1))
        mixed = np.r_[U(0), np.cumsum(buffers.mix(h ^ U(0xA5A5A5A5A5A5A5A5)), dtype=U)]
        sums = np.r_[U(0), np.cumsum(h, dtype=U)]
        out = [None] * len(ids)
        for i in np.flatnonzero(may).tolist():
            g, s = h[edge[i]:edge[i + 1]], step[edge[i]:edge[i + 1]]
            g, s = g[s > 0], s[s > 0]
            out[i] = g[np.argsort(s, kind="stable")].tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(size), pa.array((sums[edge[1:]] - sums[edge[:-1]]).view(np.int64)),
             pa.array((mixed[edge[1:]] - mixed[edge[:-1]]).view(np.int64)), pa.array(out, pa.binary())],
            names=["doc_id", "n_shingles", "first", "second", "grams"])

    answers = exchange.answered(exchange.asked(frame, ask), exchange.over_columns([np.uint32, np.uint32], answer), tasks)
    return exchange.blocks_with(frame, [(answers, np.uint8)], use, SET, tasks)


def _classes(n: int, pairs) -> list[tuple[int, int]]:
    """A spanning set of the links: each member with its class's first."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(find(i), i) for i in range(n) if find(i) != i]


def joined(ids, sizes, sets, roles, percent: int):
    """Links of one chunk and the members that are not linked to the leader.

    Roles: 0 the leader, 1 a member, 2 a visitor (a member of another chunk). Members linked
    to the leader are one class already and are not compared with each other.
    """
    trie = Trie(sets, sizes)
    settled, pairs = np.zeros(len(ids), bool), []
    for i in sorted(range(len(ids)), key=lambda i: (roles[i], ids[i])):
        if not settled[i]:
            found = trie.similar(np.sort(sets[i]), int(sizes[i]), percent)
            pairs += [(i, j) for j in found]
            if roles[i] == 0:
                settled[found] = True
    return _classes(len(ids), pairs), np.flatnonzero(~settled & (np.array(roles) == 1))


def links(near: DataFrame, percent: int, chunk_sets: int = CHUNK_SETS, chunk_grams: int = CHUNK_GRAMS) -> DataFrame:
    """(a, b) between similar sets of ``near`` (doc_id, the key of a set, distinct, n_shingles, grams in global order)."""
    def heads(batches):
        for batch in batches:
            ids, sizes = batch.column("doc_id").to_numpy(), batch.column("n_shingles").to_numpy()
            data, offsets = buffers.flat(batch.column("grams"))
            n = np.diff(offsets) // 8
            take = np.maximum(0, n - least_shared(sizes, percent) + 1)
            row = np.repeat(np.arange(len(n)), take)
            place = np.repeat(offsets[:-1] // 8, take) + np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
            yield pa.RecordBatch.from_arrays([pa.array(data.view(np.int64)[place]), pa.array(ids[row]), pa.array(n[row])],
                                             names=["gram", "doc_id", "n"])
    heads_of = durable(near.select("doc_id", "n_shingles", "grams").mapInArrow(heads, "gram long, doc_id long, n long"))
    leaders = heads_of.groupBy("gram").agg(F.min("doc_id").alias("leader"), F.count("*").alias("held")).where("held > 1").drop("held")
    groups = durable(heads_of.join(leaders, "gram").groupBy("leader", "doc_id").agg(F.max("n").alias("n")))
    sized = (groups.groupBy("leader").agg(F.count("*").alias("sets"), F.sum("n").alias("total")).where("sets > 1")
             .select("leader", F.greatest(F.ceil(F.col("sets") / chunk_sets), F.ceil(F.col("total") / chunk_grams)).alias("chunks")))
    groups = groups.join(sized, "leader")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    member = groups.where("leader <> doc_id").select(
        "leader", "doc_id", F.lit(1).alias("role"), F.pmod(F.xxhash64("doc_id"), F.col("chunks")).alias("chunk"), "chunks")
    leader = groups.where("leader = doc_id").select("leader", "doc_id", F.lit(0).alias("role"), every.alias("chunk"), "chunks")
    dealt = member.unionByName(leader)
    sets = near.select("doc_id", "n_shingles", "grams")

    def join(table: pa.Table) -> pa.Table:
        ids, sizes = table.column("doc_id").to_numpy(), table.column("n_shingles").to_numpy()
        kept = [np.frombuffer(g, U) for g in table.column("grams").to_pylist()]
        spanning, apart = joined(ids, sizes, kept, table.column("role").to_pylist(), percent)
        leader, many = table.column("leader")[0].as_py(), table.column("chunks")[0].as_py() > 1
        apart = ids[apart] if many else ids[:0]
        return pa.table({"a": pa.array(np.r_[ids[[a for a, _ in spanning]] if spanning else ids[:0], np.full(len(apart), leader)], pa.int64()),
                         "b": pa.array(np.r_[ids[[b for _, b in spanning]] if spanning else ids[:0], apart], pa.int64()),
                         "link": pa.array([True] * len(spanning) + [False] * len(apart), pa.bool_())})

    shape = "a long, b long, link boolean"
    found = durable(dealt.join(sets, "doc_id").groupBy("leader", "chunk").applyInArrow(join, shape))
    apart = found.where("not link").select(F.col("a").alias("leader"), F.col("b").alias("doc_id"))
    if not apart.isEmpty():
        hot = sized.where("chunks > 1")
        guests = apart.join(hot, "leader")
        slots = guests.groupBy("leader").agg(F.ceil(F.count("*") / chunk_sets).alias("slots"))
        guests = (guests.join(slots, "leader").withColumn("slot", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("slots")))
                  .select("leader", "doc_id", F.lit(2).alias("role"), every.alias("chunk"), "chunks", "slot")
                  .where(F.pmod(F.xxhash64("doc_id"), F.col("chunks")) != F.col("chunk")))
        hosts = member.join(slots, "leader").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).drop("slots")

        def visit(table: pa.Table) -> pa.Table:
            ids, sizes = table.column("doc_id").to_numpy(), table.column("n_shingles").to_numpy()
            kept = [np.frombuffer(g, U) for g in table.column("grams").to_pylist()]
            roles = np.array(table.column("role").to_pylist())
            host, guest = np.flatnonzero(roles == 1), np.flatnonzero(roles == 2)
            trie = Trie([kept[i] for i in guest], sizes[guest])
            pairs = [(i, int(guest[j])) for i in host.tolist() for j in trie.similar(np.sort(kept[i]), int(sizes[i]), percent)]
            spanning = _classes(len(ids), pairs)
            return pa.table({"a": pa.array([int(ids[a]) for a, _ in spanning], pa.int64()),
                             "b": pa.array([int(ids[b]) for _, b in spanning], pa.int64()),
                             "link": pa.array([True] * len(spanning), pa.bool_())})
        more = hosts.unionByName(guests).join(sets, "doc_id").groupBy("leader", "chunk", "slot").applyInArrow(visit, shape)
        found = found.unionByName(durable(more))
    return found.where("link").select("a", "b")


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document.

    Two documents link when 100 * intersection >= percent * union of their n-gram sets. A
    null, empty or blank text has no n-grams and links with nothing; equal sets link. Rows of
    one id are one document, linked through any of its texts; rows without an id are left out.
    """
    def read(data, offsets):
        h, row = grams(data, offsets, words)
        return h, row, np.bincount(row, minlength=len(offsets) - 1)

    held = durable(counted(exchange.documents(docs), read, percent))
    may = held.where("grams is not null")
    sets = durable(_stored(may.groupBy("first", "second", "n_shingles").agg(
        F.min("doc_id").alias("least"), F.min_by("grams", "doc_id").alias("grams"), F.count("*").alias("copies"))
        .withColumn("doc_id", F.monotonically_increasing_id())))
    same = sets.select("first", "second", "n_shingles", F.col("doc_id").alias("set_id"), "least", "copies")
    near = durable(counted(sets.select("doc_id", "text"), stored, percent).where("grams is not null"))
    labels = durable(components(links(near, percent, chunk_sets).unionByName(_of_one_id(may, same))))
    put = same.join(labels, same["set_id"] == labels["v"], "left").drop("v")
    least = put.where("label is not null").groupBy("label").agg(F.min("least").alias("component_id"))
    of = put.join(least, "label", "left").select(
        "first", "second", "n_shingles", F.coalesce("component_id", "least").alias("component_id"), "least", "copies").where(
        "copies > 1 or component_id <> least")
    member = may.select("doc_id", "first", "second", "n_shingles").join(
        of, ["first", "second", "n_shingles"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return held.select("doc_id", "n_shingles").join(member, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _of_one_id(may: DataFrame, same: DataFrame) -> DataFrame:
    """(a, b): of an id that has several sets, the first with each other."""
    again = may.groupBy("doc_id").count().where("count > 1").select("doc_id")
    keys = durable(may.select("doc_id", "first", "second", "n_shingles").join(again, "doc_id", "left_semi").join(
        same.select("first", "second", "n_shingles", "set_id"), ["first", "second", "n_shingles"]).select("doc_id", "set_id").distinct())
    firsts = keys.groupBy("doc_id").agg(F.min("set_id").alias("a"))
    return keys.join(firsts, "doc_id").where("a <> set_id").select("a", F.col("set_id").alias("b"))


def _stored(sets: DataFrame) -> DataFrame:
    """Sets with their n-grams as the bytes that ``stored`` reads, in a column ``text``."""
    def run(batches):
        for batch in batches:
            texts = [np.array([n], U).tobytes() + g for n, g in
                     zip(batch.column("n_shingles").to_pylist(), batch.column("grams").to_pylist())]
            kept = ["first", "second", "n_shingles", "doc_id", "least", "copies"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.binary())], names=[*kept, "text"])
    return sets.mapInArrow(run, "first long, second long, n_shingles long, doc_id long, least long, copies long, text binary")
