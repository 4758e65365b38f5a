"""MinHash near-duplicates by an inverted join over signature coordinates.

A text's set is its distinct word shingles; its signature has ``COORDINATES``
least hash values, each with its coordinate in its low bits, so a value is a
(coordinate, value) pair. Texts with one set are one class. Classes are posted
under their pairs; two classes of the least likeness that links share fewer
than ``needed_matches`` of 64 pairs (40 at 0.85, 35 at 0.80) with a chance of at
most ``MISSED``, so only those that so many collisions connect are compared, on
full sets.

Prefix: with pairs ordered by how many classes post them, two classes with
``matches`` collisions share one of their COORDINATES - matches + 1 rarest pairs;
only these are posted. A passage that many texts share makes common pairs, which
come last and aren't posted, unless they are most of a text.

Skip: a posting list isn't expanded into its pairs. In a few rounds its members
are matched with one leader, of the cluster that most of them are in already,
and members of the leader's cluster are skipped. Lists that still differ in
cluster are merged in blocks of signatures, each of which gives a spanning
forest of its matches. So all classes that can be linked are in one cluster.

Clusters are then compared on full sets, in one task if they have at most
``BLOCK`` members. Larger ones are first compared with a leader in some rounds;
the rest of them is dealt as pairs of blocks. A task counts the common shingles
of its members by a product of matrices and gives a spanning forest of the
links, so no link is lost between components and no pairs are listed.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, releasing, small_batches

WORDS = 5
COORDINATES = 64
#: The chance that a pair of the least likeness that links isn't compared is at most this.
MISSED = 2.5e-6
LEADER_ROUNDS = 2
BLOCK = 256

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
_SCALE = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_LOW = np.uint64(COORDINATES - 1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORD_HASHES = _WordHashes()


def _forget_words() -> None:
    _WORD_HASHES.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; ASCII letters in lower case, words between ASCII white space."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORD_HASHES.__getitem__, found), dtype=np.uint64, count=len(found))
    n = min(words, len(h))
    rolled = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        rolled *= _PRIME
        rolled += h[i : len(h) - n + 1 + i]
    return np.unique(_mixed(rolled + np.uint64(n)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate its least hash value, its low bits replaced by the coordinate, as signed integers."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), 2048):
        part = shingles[a : a + 2048, None] * _SCALE[None, :]
        part += _SHIFT[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return ((least & ~_LOW) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, signatures = [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py(), words)
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            signatures.append(signature(s) if len(s) else None)
        full = [x for x in signatures if x is not None]
        flat = pa.array(np.concatenate(full) if full else np.empty(0, np.int64))
        ends = np.r_[0, np.cumsum([0 if x is None else COORDINATES for x in signatures])].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)],
            names=["doc_id", "n_shingles", "digest", "sig"],
        )


# --- candidates --------------------------------------------------------------


def needed_matches(percent: int) -> int:
    """The most collisions that a pair of this likeness has, but for a chance of MISSED."""
    p, below = percent / 100, 0.0
    for n in range(COORDINATES):
        below += math.comb(COORDINATES, n) * p**n * (1 - p) ** (COORDINATES - n)
        if below > MISSED:
            return n
    return COORDINATES


def prefix_postings(reps: DataFrame, work: Workspace, matches: int) -> DataFrame:
    """(token, rep): each class under its rarest pairs, where the prefix of another class has the pair too."""
    tokens = reps.select("rep", F.explode("sig").alias("token"))
    shared = work.stage(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    ranked = tokens.join(shared, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("own"))
    # pairs of one class only come first in the order and take their places in the prefix
    places = F.greatest(F.lit(0), F.size("own") - (matches - 1))
    posted = work.stage(ranked.select("rep", F.explode(F.slice("own", 1, places)).alias("x")).select("rep", "x.token"), "posted")
    kept = work.stage(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "kept-tokens")
    return work.stage(posted.join(kept, "token").select("token", "rep"), "postings")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def leader_pairs(labelled: DataFrame, group: str, work: Workspace, name: str) -> DataFrame:
    """(a, b): each member of a group with the group's leader, a member of its largest label, if their labels differ."""
    order = F.xxhash64(F.lit(name), F.col("rep"))
    parts = labelled.groupBy(group, "label").agg(F.count("*").alias("n"), F.min(F.struct(order.alias("h"), F.col("rep"))).alias("m"))
    lists = parts.groupBy(group).agg(F.max(F.struct("n", F.col("m.h").alias("h"), F.col("m.rep").alias("leader"), "label")).alias("top"), F.count("*").alias("labels"))
    leaders = work.stage(lists.where("labels > 1").select(group, "top.leader", F.col("top.label").alias("leader_label")), name)
    return _ordered(labelled.join(leaders, group).where("label <> leader_label"), "rep", "leader")


def _forest(near: np.ndarray, ids: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix, as pairs of ids."""
    free, out = np.ones(len(ids), dtype=bool), []
    for root in range(len(ids)):
        if not free[root]:
            continue
        free[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(near[i] & free).tolist():
                free[j] = False
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                todo.append(j)
    return out


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows by key, one group at a time; rows of a group come together."""
    key, held = None, []
    for batch in batches:
        own = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
        rows = zip(*(batch.column(c) for c in columns), strict=True)
        for k, row in zip(own, rows, strict=True):
            if k != key:
                if held:
                    yield key, held
                key, held = k, []
            held.append(row)
    if held:
        yield key, held


def _matching(batches: Iterator[pa.RecordBatch], matches: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Per group of signatures a spanning forest of the pairs with enough collisions whose sizes allow the likeness."""
    for _, rows in _grouped(batches, ("token", "bi", "bj"), ("rep", "n_shingles", "sig")):
        if len(rows) < 2:
            continue
        ids, sizes = [r.as_py() for r, _, _ in rows], np.array([n.as_py() for _, n, _ in rows])
        sigs = np.stack([s.values.to_numpy(zero_copy_only=False) for *_, s in rows])
        near = np.zeros((len(ids), len(ids)), dtype=bool)
        for i in range(len(ids) - 1):
            near[i, i + 1 :] = (sigs[i + 1 :] == sigs[i]).sum(axis=1) >= matches
        near &= 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
        if pairs := _forest(near | near.T, ids):
            yield _pairs_batch(pairs)


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with ``blocks`` dealt so that every two rows of a group meet under some (group, bi, bj)."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("block", "other", "blocks")


def _blocks_of_mixed(labelled: DataFrame, group: str) -> DataFrame:
    """(group, blocks) of the groups whose members differ in label."""
    lists = labelled.groupBy(group).agg(F.count("*").alias("members"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    return lists.select(group, F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))


def block_matches(labelled: DataFrame, reps: DataFrame, work: Workspace, matches: int, percent: int) -> DataFrame:
    """(a, b): for the posting lists that still differ in cluster, spanning forests of their matches."""
    mixed = work.stage(_blocks_of_mixed(labelled, "token"), "mixed-lists")
    rows = _in_blocks(labelled.join(mixed, "token")).join(reps.select("rep", "n_shingles", "sig"), "rep")
    dealt = rows.repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj")
    return dealt.mapInArrow(lambda it: _matching(it, matches, percent), "a bigint, b bigint").distinct()


def match_clusters(reps: DataFrame, postings: DataFrame, work: Workspace, matches: int, percent: int) -> DataFrame | None:
    """(rep, label) of the classes in clusters that ``matches`` collisions connect; None if there are none."""
    labels = tested = None
    for turn in range(LEADER_ROUNDS + 1):
        label: Column = F.col("rep") if labels is None else F.coalesce("label", F.col("rep"))
        labelled = (postings if labels is None else postings.join(labels, "rep", "left")).select("token", "rep", label.alias("label"))
        labelled = work.stage(labelled, f"labelled{turn}")
        if turn < LEADER_ROUNDS:
            asked = leader_pairs(labelled, "token", work, f"leaders{turn}")
            asked = work.stage(asked if tested is None else asked.join(tested, ["a", "b"], "left_anti"), f"asked{turn}")
            if asked.isEmpty():
                continue
            tested = asked if tested is None else tested.unionByName(asked)
            found = work.stage(colliding(asked, reps, matches, percent), f"matches{turn}")
        else:
            found = work.stage(block_matches(labelled, reps, work, matches, percent), f"matches{turn}")
        work.drop(f"labelled{turn}")
        if not found.isEmpty():
            labels = merged(labels, found, work, f"clusters{turn}")
    return labels


# --- comparing ---------------------------------------------------------------


def colliding(pairs: DataFrame, reps: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs whose signatures have ``matches`` collisions and whose sizes allow the likeness."""
    side = lambda k: reps.select(F.col("rep").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return joined.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).where(equal >= matches).select("a", "b").distinct()


def _linked(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    known: OrderedDict[str, np.ndarray] = OrderedDict()

    def of(text: str | None) -> np.ndarray:
        found = known.pop(text, None)
        known[text] = shingle_set(text, words) if found is None else found
        if len(known) > 64:
            known.popitem(last=False)
        return known[text]

    for batch in batches:
        keep = []
        for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
            b, a = of(y.as_py()), of(x.as_py())
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * common >= percent * (len(a) + len(b) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def linked(spark: SparkSession, pairs: DataFrame, texts: DataFrame, work: Workspace, name: str, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough. Both joins are of plain exchanges, so a leader of many is split."""
    side = lambda k: texts.select(F.col("rep").alias(k), F.col("text").alias(f"text_{k}"))
    with small_batches(spark):
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return work.stage(both.mapInArrow(releasing(lambda it: _linked(it, words, percent), _forget_words), "a bigint, b bigint").distinct(), name)


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(rep, label): the least member of each node's component.

    Each node hooks to its least neighbour, hooks are followed to their roots by
    doubling, and edges are carried over to the roots; edges inside a root go,
    so each turn works on what is left, at most half of the nodes.
    """
    edges = work.stage(edges.select("a", "b").distinct(), f"{name}-edges")
    labels = work.stage(edges.select(F.col("a").alias("rep")).unionByName(edges.select(F.col("b").alias("rep"))).distinct().withColumn("label", F.col("rep")), f"{name}-labels")
    edges = edges.where("a <> b")
    for turn in range(1000):
        if edges.isEmpty():
            return labels
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        roots = work.stage(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), f"{name}-roots{turn}")
        for jump in range(64):
            further = roots.select(F.col("u").alias("p"), F.col("p").alias("far"))
            jumped = work.stage(roots.join(further, "p").select("u", F.col("far").alias("p"), (F.col("far") != F.col("p")).alias("moved")), f"{name}-roots{turn}-{jump}")
            roots = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        of = lambda c: roots.select(F.col("u").alias(c), F.col("p").alias(f"p{c}"))
        carried = edges.join(of("a"), "a").join(of("b"), "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        edges = work.stage(carried, f"{name}-edges{turn}")
        labels = work.stage(labels.join(of("label"), "label", "left").select("rep", F.coalesce("plabel", "label").alias("label")), f"{name}-labels{turn}")
    raise RuntimeError("components didn't settle")


def merged(labels: DataFrame | None, edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Labels after more edges: only edges between different labels are looked at again."""
    if labels is None:
        return components(edges, work, name)
    of = lambda c: labels.select(F.col("rep").alias(c), F.col("label").alias(f"l{c}"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    roots = components(between, work, name).select(F.col("rep").alias("label"), F.col("label").alias("root"))
    nodes = edges.select(F.col("a").alias("rep")).unionByName(edges.select(F.col("b").alias("rep"))).distinct().join(labels, "rep", "left_anti")
    every = labels.unionByName(nodes.withColumn("label", F.col("rep")))
    return work.stage(every.join(roots, "label", "left").select("rep", F.coalesce("root", "label").alias("label")), f"{name}-merged")


def _alike(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The symmetric matrix of which sets are linked. Common shingles are counted by products of 0/1 matrices, some columns at a time."""
    n, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    values = values[counts > 1]
    places = [np.searchsorted(values, s) for s in sets]
    places = [p[(p < len(values)) & (values[np.minimum(p, len(values) - 1)] == s)] if len(values) else p[:0] for p, s in zip(places, sets, strict=True)]
    common = np.zeros((n, n))
    for a in range(0, len(values), 4096):
        width = min(4096, len(values) - a)
        m = np.zeros((n, width), dtype=np.float32)
        for i, p in enumerate(places):
            m[i, p[np.searchsorted(p, a) : np.searchsorted(p, a + width)] - a] = 1
        common += m @ m.T
    near = 100 * common >= percent * (np.add.outer(sizes, sizes) - common)
    np.fill_diagonal(near, False)
    return near


def _linked_in_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for _, rows in _grouped(batches, keys, ("rep", "text")):
        if len(rows) > 1:
            ids, sets = [r.as_py() for r, _ in rows], [shingle_set(t.as_py(), words) for _, t in rows]
            if pairs := _forest(_alike(sets, percent), ids):
                yield _pairs_batch(pairs)


def cluster_links(spark: SparkSession, clusters: DataFrame, texts: DataFrame, work: Workspace, words: int, percent: int) -> DataFrame:
    """(a, b): links that connect, within each cluster, what links connect."""
    schema = "a bigint, b bigint"
    clusters = clusters.withColumnRenamed("label", "cluster")
    sizes = work.stage(clusters.groupBy("cluster").agg(F.count("*").alias("members")), "cluster-sizes")
    members = work.stage(clusters.join(sizes, "cluster"), "members")
    small = members.where(F.col("members") <= BLOCK).select("cluster", "rep").join(texts, "rep").repartition("cluster").sortWithinPartitions("cluster")
    with small_batches(spark):
        edges = work.stage(small.mapInArrow(releasing(lambda it: _linked_in_groups(it, ("cluster",), words, percent), _forget_words), schema), "small-links")
    large = members.where(F.col("members") > BLOCK).select("cluster", "rep")
    if large.isEmpty():
        return edges
    labels = tested = own = None
    for turn in range(LEADER_ROUNDS):
        label: Column = F.col("rep") if labels is None else F.coalesce("label", F.col("rep"))
        labelled = work.stage((large if labels is None else large.join(labels, "rep", "left")).select("cluster", "rep", label.alias("label")), f"large{turn}")
        asked = leader_pairs(labelled, "cluster", work, f"large-leaders{turn}")
        asked = work.stage(asked if tested is None else asked.join(tested, ["a", "b"], "left_anti"), f"large-asked{turn}")
        if asked.isEmpty():
            break
        tested = asked if tested is None else tested.unionByName(asked)
        found = linked(spark, asked, texts, work, f"large-links{turn}", words, percent)
        own = found if own is None else own.unionByName(found)
        labels = merged(labels, found, work, f"large-components{turn}")
    labelled = work.stage(large.join(labels, "rep", "left").select("cluster", "rep", F.coalesce("label", "rep").alias("label")), "large-rest")
    mixed = work.stage(_blocks_of_mixed(labelled, "cluster"), "large-mixed")
    rows = _in_blocks(labelled.join(mixed, "cluster")).join(texts, "rep")
    dealt = rows.repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj")
    with small_batches(spark):
        rest = work.stage(dealt.mapInArrow(releasing(lambda it: _linked_in_groups(it, ("cluster", "bi", "bj"), words, percent), _forget_words), schema), "large-rest-links")
    return edges.unionByName(own).unionByName(rest)


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id that links lead to), kept (doc_id is that).

    Two texts are linked when 100 * common >= percent * all shingles, percent 20
    to 100. Null and empty texts and texts of white space have no shingles and
    no links. Rows with one key are one document, linked if any of its texts is.
    A null key takes no part: its component_id is null and it is kept. An empty
    table gives no rows; other columns are left out.
    """
    if not 20 <= percent <= 100:
        raise ValueError(f"percent {percent} is not from 20 to 100")
    matches = needed_matches(percent)
    work = Workspace(spark, "neardup")
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with small_batches(spark):
        signed = work.stage(narrow.mapInArrow(releasing(lambda it: _signed(it, words), _forget_words), "doc_id bigint, n_shingles bigint, digest binary, sig array<bigint>"), "signed")
    firsts = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("m"))
    reps = work.stage(firsts.select("digest", F.col("m.doc_id").alias("rep"), "m.n_shingles", "m.sig"), "reps")
    postings = prefix_postings(reps, work, matches)
    work.drop("shared", "posted", "kept-tokens")
    clusters = match_clusters(reps, postings, work, matches, percent)
    labels = None
    if clusters is not None:
        texts = work.stage(narrow.join(clusters.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text").distinct(), "texts")
        labels = components(cluster_links(spark, clusters, texts, work, words, percent), work, "components")
    work.drop("texts")
    classes = reps.select("digest", "rep")
    if labels is not None:
        classes = classes.join(labels, "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    else:
        classes = classes.select("digest", F.col("rep").alias("component"))
    classes = work.stage(classes, "classes")
    joined = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
