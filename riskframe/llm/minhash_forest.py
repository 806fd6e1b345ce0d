"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

A document is the set of its runs of ``SHINGLE`` words (a shorter one: its whole word sequence).
Documents with the same words (128-bit digest) are one *class* and are joined through it, never pairwise.

1. Signatures: ``TREES`` x ``DEPTH`` minima of the hashed shingles.
2. Forest: a class has one label of ``DEPTH`` minima per tree.  Labels are sorted by (tree, label) over all
   partitions, which is the prefix trie of each tree; a label's longest common prefix with its neighbours
   (across partitions, too) tells down to which level it has company.
3. Adaptive prefixes: from full labels on, the accepted prefix is shortened level by level until it reaches
   ``recall``, both measured and by calculation: the share found of all truly similar pairs of ``SAMPLE``
   documents with any class (an exact search, made in the signature pass), and the probability
   1 - (1 - t^d)^TREES for a pair exactly at the threshold.  Only labels with company at that level go on.
4. A node is the classes of one tree that share the accepted prefix.  Nodes of the same classes in several trees
   are kept in the first one, and a pair is examined in the first tree where it meets, nowhere else.  A node
   with more than ``BLOCK`` classes is split into blocks, and pairs of blocks are separate groups, so
   no group holds more than two blocks; a pair never becomes a row.
5. Pairs whose signatures agree enough (``MARGIN`` standard deviations below the threshold) are
   verified exactly on their shingle sets, which are made again from the text for these classes
   only.  Every verified link counts for both classes; a group's connected classes go on to the
   connected components as links to their smallest one.

Counting all links inside a node of g different texts takes g^2 / 2 comparisons of signatures,
done in blocks; only linear output leaves a group.

Defined results: a null text is empty; texts without a word have no shingles and are linked to
nothing but equal texts; rows with equal ids are joined by what they say; a null id is
returned as null, and a group's id is its smallest non-null id; empty tables give no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.tables import fingerprint, once, sized, without, written
from riskframe.llm.textnp import Words, byte_buffer, chunks, give_back, mix, shingles, word_texts

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 6
RECALL = 0.9995
BLOCK = 512
MARGIN = 4.5
#: Documents (chosen by hash) whose similar classes are searched exactly to measure the forest's recall.
SAMPLE = 200
_SALTS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = (_SALTS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_XOR = _SALTS.astype(np.uint32)


def met_probability(depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """Probability that a pair of similarity ``threshold`` shares a prefix of ``depth`` minima in some tree."""
    return 1 - (1 - threshold ** depth) ** trees


def accepted_prefix(reached: dict[int, int], threshold: float, recall: float) -> tuple[int, float]:
    """(prefix, measured recall): shortened from DEPTH until measured and calculated recall are ``recall`` or more.

    ``reached``: how many true pairs of the sample have a longest common prefix of so many minima in some tree."""
    if met_probability(1, threshold) < recall:
        raise ValueError("not even prefixes of length 1 reach the recall: more trees are needed")
    pairs, found = sum(reached.values()), 0
    for depth in range(DEPTH, 0, -1):
        found += reached.get(depth, 0)
        measured = found / pairs if pairs else 1.0
        if measured >= recall and met_probability(depth, threshold) >= recall:
            return depth, measured
    return 1, measured


def signatures(texts: int, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, TREES * DEPTH) minima of shingles ``h`` of texts ``at``; a text without a shingle has the largest numbers."""
    out = np.full((texts, len(_ODD)), np.iinfo(np.uint32).max, np.uint32)
    if len(h):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        low = (h >> np.uint64(32)).astype(np.uint32)
        rows = np.empty((len(_ODD), len(first)), np.uint32)
        for j in range(len(_ODD)):
            rows[j] = np.minimum.reduceat((low ^ _XOR[j]) * _ODD[j], first)
        out[at[first]] = rows.T
    return out


def class_keys(words: Words, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per text (a cryptographic digest): of its words, or of its bytes if it has no word."""
    digests = b"".join(
        hashlib.blake2b(t, digest_size=16, person=b"words").digest() if n
        else hashlib.blake2b(raw[a:z].tobytes(), digest_size=16, person=b"bytes").digest()
        for t, n, a, z in zip(word_texts(words), words.counts.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()))
    both = np.frombuffer(digests or bytes(16), "<i8").reshape(-1, 2)[:words.texts]
    return both[:, 0].copy(), both[:, 1].copy()


class Known:
    """The shingle sets of the sampled documents, to be met by all texts."""

    def __init__(self, sets: list[np.ndarray], threshold: float):
        self.sizes, self.threshold = np.array([len(x) for x in sets], np.int64), threshold
        h, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner = h[order].astype(np.uint64), owner[order]
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def similar(self, h: np.ndarray, at: np.ndarray, texts: int) -> list[list[int]]:
        """Per text the sampled documents of similarity ``threshold`` or more, exactly."""
        out: list[list[int]] = [[] for _ in range(texts)]
        maybe = np.unique(at[self.some[(h >> np.uint64(44)).astype(np.int64)]]) if len(self.hash) else ()
        for d in maybe:
            a, z = np.searchsorted(at, [d, d + 1])
            own = np.unique(h[a:z])
            low, high = np.searchsorted(self.hash, own, "left"), np.searchsorted(self.hash, own, "right")
            n = high - low
            hit = self.owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            common = np.bincount(hit, minlength=len(self.sizes))
            near = (common > 0) & (common >= self.threshold * (len(own) + self.sizes - common) - 1e-9)
            out[d] = np.flatnonzero(near).tolist()
        return out


def _sign(known: Known):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = byte_buffer(batch.column("text"))
            for a, z in chunks(offsets):
                part, ends = raw[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a]
                words = Words(part, ends)
                k1, k2 = class_keys(words, part, ends)
                h, at = shingles(words, SHINGLE)
                sig = signatures(words.texts, h, at).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * sig.shape[1]), pa.array(sig.ravel()))
                yield pa.record_batch([batch.column("doc_id").slice(a, z - a), batch.column("fp").slice(a, z - a), pa.array(k1), pa.array(k2),
                                       pa.array(words.counts.astype(np.int32)), lists,
                                       pa.array(known.similar(h, at, words.texts), pa.list_(pa.int32()))],
                                      names=["doc_id", "fp", "k1", "k2", "n_words", "sig", "near"])
        give_back()
    return sign


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of texts, with the class they belong to."""
    for batch in batches:
        raw, offsets = byte_buffer(batch.column("text"))
        for a, z in chunks(offsets):
            part, ends = raw[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a]
            words = Words(part, ends)
            k1, k2 = class_keys(words, part, ends)
            h, at = shingles(words, SHINGLE)
            order = np.lexsort((h, at))
            h, at = h[order], at[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])] if len(h) else np.zeros(0, bool)
            h, at = h[new], at[new]
            first = np.searchsorted(at, np.arange(z - a + 1)).astype(np.int32)
            yield pa.record_batch([pa.array(k1), pa.array(k2),
                                   pa.ListArray.from_arrays(pa.array(first), pa.array(h.view(np.int64)))],
                                  names=["k1", "k2", "shingles"])
    give_back()


KEY = ("tree", "node", "b1", "b2")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by KEY, as tables that end where a group ends: many small groups are handled at once."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
        if not table.num_rows:
            continue
        last = int(np.flatnonzero(np.r_[True, np.diff(group_numbers(table)) > 0])[-1])
        held = table.slice(last)
        if last:
            yield table.slice(0, last).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0]:offsets[-1]], offsets - offsets[0]


def group_numbers(table: pa.Table) -> np.ndarray:
    keys = np.stack([_column(table, k) for k in KEY])
    return np.cumsum(np.r_[0, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])


def meeting_pairs(table: pa.Table, prefix: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a group that first meet in its tree and whose signatures agree on ``least`` slots or more.

    A group of two blocks pairs the rows of one with those of the other; a group of one block, all its rows."""
    group, tree = group_numbers(table), _column(table, "tree")
    side = _column(table, "b") != _column(table, "b1")
    alone = _column(table, "b1") == _column(table, "b2")
    sig = _lists(table, "sig")[0].reshape(len(group), TREES * DEPTH)
    left, right, i = [np.zeros(0, int)], [np.zeros(0, int)], np.arange(len(group))
    for step in range(1, len(group)):  # rows at this distance inside a group; groups are at most two blocks long
        i = i[i + step < len(group)]
        i = i[group[i] == group[i + step]]
        if not len(i):
            break
        a = i[alone[i] | (side[i] != side[i + step])]
        same = sig[a] == sig[a + step]
        near = same.sum(axis=1) >= least
        a, same = a[near], same[near].reshape(-1, TREES, DEPTH)[:, :, :prefix].all(axis=2)
        first = a[~(same & (np.arange(TREES) < tree[a][:, None])).any(axis=1)]
        left.append(first)
        right.append(first + step)
    return np.concatenate(left), np.concatenate(right)


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sorted sets have a Jaccard similarity of ``threshold`` or more, exactly."""
    used, code = np.unique(np.r_[left, right], return_inverse=True)
    sets, (left, right) = [sets[k] for k in used], np.split(code, 2)
    size = np.array([len(s) for s in sets])
    a, b = size[left], size[right]
    able = (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9) & (np.minimum(a, b) > 0)
    out = np.zeros(len(left), bool)
    if able.sum() <= 4 * len(sets):
        for p in np.flatnonzero(able):
            x, y = sets[left[p]], sets[right[p]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            out[p] = common >= threshold * (len(x) + len(y) - common) - 1e-9
        return out
    # many pairs of few sets: count common elements by products of membership columns
    element, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    for a0 in range(0, len(element), width):
        part = slice(*np.searchsorted(code, [a0, a0 + width]))
        member = np.zeros((len(sets), width), np.float32)
        member[owner[part], code[part] - a0] = 1
        common += member @ member.T
    c = common[left, right].astype(np.int64)
    return able & (c >= threshold * (size[left] + size[right] - c) - 1e-9)


def stars(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) links that connect what ``left``-``right`` connects: every other member of a component with its smallest."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(left.tolist(), right.tolist()):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [(find(i), i) for i in range(n) if find(i) != i]


def sampled_sets(base: DataFrame, most: int = SAMPLE) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """(shingle sets, class keys) of at most ``most`` documents, those of the smallest hash of id and text."""
    order = F.xxhash64(F.lit("forest"), "doc_id", "fp")
    chosen = base.select("doc_id", "fp", order.alias("o")).orderBy("o", "doc_id", "fp").limit(most).select(
        F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"))
    reps = F.broadcast(written(chosen.distinct(), "forest-sample"))  # at most ``most`` rows
    rows = base.join(reps, base["doc_id"].eqNullSafe(reps["_id"]) & (base["fp"] == reps["_fp"]), "left_semi").select("text") \
        .mapInArrow(_sets, "k1 long, k2 long, shingles array<long>").dropDuplicates(["k1", "k2"]).limit(most).collect()
    sets = [np.array(r["shingles"], np.int64).view(np.uint64) for r in rows]
    return sets, [(r["k1"], r["k2"]) for r in rows]


def _labels_of(trees: Column) -> Column:
    """One (tree, label) per tree from a signature."""
    return F.transform(trees, lambda t: F.struct(t.alias("tree"), F.slice("sig", t * DEPTH + 1, F.lit(DEPTH)).alias("label")))


def _company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted labels with the length of the prefix that a neighbour in the same partition shares; the partition's first and
    last label are marked by its number, as their other neighbours are elsewhere."""
    part = TaskContext.get().partitionId()

    def finish(table: dict, shared: np.ndarray, last: bool, first: bool) -> pa.RecordBatch:
        n = len(table["c"])
        edge = np.full(n, -1)
        if first:
            edge[0] = 2 * part
        if last:
            edge[-1] = 2 * part + 1 if edge[-1] < 0 else edge[-1]
        # a partition of one label is its first and its last one at once
        return pa.record_batch([pa.array(table["c"]), pa.array(table["tree"], pa.int32()),
                                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * DEPTH), pa.array(table["label"].ravel())),
                                pa.array(shared.astype(np.int32)), pa.array(edge.astype(np.int64))],
                               names=["c", "tree", "label", "shared", "edge"])

    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {"c": batch.column("c").to_numpy(), "tree": batch.column("tree").to_numpy(),
               "label": batch.column("label").flatten().to_numpy().reshape(-1, DEPTH)}
        if held is not None:  # the last label of the batch before waits for its successor
            now = {k: np.concatenate([held[0][k], now[k]]) for k in now}
        same = (now["label"][1:] == now["label"][:-1]) & (now["tree"][1:] == now["tree"][:-1])[:, None]
        reach = np.cumprod(same, axis=1).sum(axis=1)
        shared = np.maximum(np.r_[0, reach], np.r_[reach, 0])
        if held is not None:
            shared[0] = max(shared[0], held[1])
        if len(shared) > 1:
            yield finish({k: v[:-1] for k, v in now.items()}, shared[:-1], False, first)
            first = False
        held = ({k: v[-1:] for k, v in now.items()}, int(shared[-1]))
    if held is not None:
        yield finish(held[0], np.array([held[1]]), True, first)


def sorted_forest(classes: DataFrame) -> DataFrame:
    """(c, tree, label, shared): all labels in sorted order, with the longest prefix shared with a neighbour."""
    labels = classes.filter("n_words > 0").select("c", F.explode(_labels_of(F.sequence(F.lit(0), F.lit(TREES - 1)))).alias("x")) \
        .select("c", "x.tree", "x.label")
    ordered = labels.repartitionByRange("tree", "label").sortWithinPartitions("tree", "label", "c")
    found = written(ordered.mapInArrow(_company, "c long, tree int, label array<int>, shared int, edge long"), "forest-labels")
    # neighbours across partitions: two labels of each partition, in the partitions' order
    edges = found.filter("edge >= 0").select("c", "tree", "label", "edge")
    order = Window.orderBy("edge")  # two rows per partition at most
    near = edges
    for name, step in (("before", F.lag), ("after", F.lead)):
        near = near.withColumn(name, step(F.struct("tree", "label")).over(order))

    def reach(other: str) -> Column:
        same = F.transform(F.sequence(F.lit(1), F.lit(DEPTH)), lambda k: F.slice("label", F.lit(1), k) == F.slice(F.col(other)["label"], F.lit(1), k))
        return F.when(F.col("tree") == F.col(other)["tree"], F.size(F.filter(same, lambda x: x))).otherwise(F.lit(0))

    across = F.broadcast(written(near.select(F.col("c").alias("_c"), F.col("tree").alias("_t"), F.greatest(
        F.coalesce(reach("before"), F.lit(0)), F.coalesce(reach("after"), F.lit(0))).alias("_reach")), "forest-edges"))
    return found.join(across, (found["c"] == across["_c"]) & (found["tree"] == across["_t"]), "left").select(
        "c", "tree", "label", F.greatest("shared", F.coalesce("_reach", F.lit(0))).alias("shared"))


def measured_reach(rows: DataFrame, classes: DataFrame, keys: list[tuple[int, int]]) -> dict[int, int]:
    """How many similar pairs (sampled document, another class) share a prefix of so many minima in their best tree."""
    spark = rows.sparkSession
    sample = spark.createDataFrame([(k, *key) for k, key in enumerate(keys)], "s int, s1 long, s2 long")  # SAMPLE rows at most
    pairs = rows.filter(F.size("near") > 0).select("k1", "k2", F.explode("near").alias("s")).distinct()
    own = F.broadcast(sample.join(classes, (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2"))).select("s", "s1", "s2", F.col("sig").alias("mine")))
    met = pairs.join(own, "s").filter((F.col("k1") != F.col("s1")) | (F.col("k2") != F.col("s2"))).join(
        classes.select("k1", "k2", "sig"), ["k1", "k2"])

    def prefix(t: Column) -> Column:
        same = F.transform(F.sequence(F.lit(1), F.lit(DEPTH)), lambda k: F.slice("sig", t * DEPTH + 1, k) == F.slice("mine", t * DEPTH + 1, k))
        return F.size(F.filter(same, lambda x: x))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), prefix))
    return {r["reach"]: r["count"] for r in met.select(best.alias("reach")).groupBy("reach").count().collect()}  # DEPTH + 1 rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row: doc_id, class_id, n_links, rep_id, text_fp, class_fp.

    ``class_id``: the smallest id among the documents connected by links; ``rep_id``: the smallest id
    among those with the same words; ``n_links``: to how many other classes of equal words the
    document is linked (similarity >= ``threshold``)."""
    slots = TREES * DEPTH
    least = slots * threshold - MARGIN * (slots * threshold * (1 - threshold)) ** 0.5
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col)).alias("fp"), text)
    sets_of_sample, keys = sampled_sets(base)
    rows = written(base.mapInArrow(_sign(Known(sets_of_sample, threshold)), "doc_id long, fp long, k1 long, k2 long, n_words int, "
                                   "sig array<int>, near array<int>"), "forest-rows")
    # one row per class; equal classes have equal signatures
    classes = written(rows.groupBy("k1", "k2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "fp")).alias("rep"), F.first("n_words").alias("n_words"),
        F.first("sig").alias("sig")).select(F.monotonically_increasing_id().alias("c"), "k1", "k2",
                                            F.col("rep.doc_id").alias("rep_id"), F.col("rep.fp").alias("rep_fp"), "n_words", "sig"),
        "forest-classes")
    prefix, _ = accepted_prefix(measured_reach(rows, classes, keys), threshold, recall)
    labels = written(sorted_forest(classes).filter(F.col("shared") >= prefix).select(
        "c", "tree", F.xxhash64("tree", F.slice("label", F.lit(1), F.lit(prefix))).alias("node")), "forest-met")
    nodes = written(labels.groupBy("tree", "node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("s1"),
                                                       F.bit_xor(F.xxhash64(F.lit(2), "c")).alias("s2")).filter("n > 1"), "forest-nodes")
    # the same classes in several trees: their pairs meet in the first one
    shared = sized(nodes.groupBy("n", "s1", "s2").agg(F.min(F.struct("tree", "node")).alias("x")).select("x.tree", "x.node", "n"), "forest-kept")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(7), "c"), F.col("blocks")).cast("int")
    met = labels.join(shared, ["tree", "node"]).withColumn("blocks", blocks).withColumn("b", mine)
    member = written(met.select("c", "tree", "node", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
                     .select("c", "tree", "node", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b")
                     .join(classes.select("c", "sig"), "c"), "forest-members")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members with a pair to verify in their group."""
        for table in whole_groups(batches):
            yield from table.take(np.unique(np.concatenate(meeting_pairs(table, prefix, least)))).to_batches()

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition(*KEY).sortWithinPartitions(*KEY, "c")

    fields = "c long, tree int, node long, b1 int, b2 int, b int, sig array<int>"
    wanted = written(grouped(member.select("c", *KEY, "b", "sig")).mapInArrow(needed, fields), "forest-wanted")
    # the sets of these classes, made from the texts of their representatives
    some = written(wanted.select("c").distinct().join(classes.select("c", "k1", "k2", "rep_id", "rep_fp"), "c"), "forest-some")
    reps = sized(some.select("rep_id", "rep_fp").distinct(), "forest-reps")
    texts = base.join(reps, base["doc_id"].eqNullSafe(reps["rep_id"]) & (base["fp"] == reps["rep_fp"]), "left_semi").select("text")
    sets = written(texts.mapInArrow(_sets, "k1 long, k2 long, shingles array<long>").join(some.select("c", "k1", "k2"), ["k1", "k2"])
                   .dropDuplicates(["c"]).select("c", "shingles"), "forest-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links per class and group, and each group's connected classes as links to their smallest one: the same classes
        meeting in many groups give the same few links."""
        for table in whole_groups(batches):
            group, c = group_numbers(table), _column(table, "c")
            values, ends = _lists(table, "shingles")
            sets_ = np.split(values, ends[1:-1])
            left, right = meeting_pairs(table, prefix, least)
            ok = np.zeros(len(left), bool)
            of = group[left]
            order = np.argsort(of, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
                ok[some] = similar(sets_, left[some], right[some], threshold)
            left, right = left[ok], right[ok]
            n = np.bincount(np.r_[left, right], minlength=len(c))
            links = stars(len(c), left, right)
            counted = np.flatnonzero(n)
            yield pa.record_batch([
                pa.array(np.r_[c[counted], c[[a for a, _ in links]]] if links else c[counted], pa.int64()),
                pa.array(np.r_[n[counted], np.zeros(len(links), np.int64)], pa.int64()),
                pa.array([None] * len(counted) + [int(c[b]) for _, b in links], pa.int64())], names=["c", "n", "to"])
        give_back()

    found = written(grouped(wanted.join(sets, "c").select("c", *KEY, "b", "sig", "shingles"))
                    .mapInArrow(verify, "c long, n long, to long"), "forest-links")
    counts = found.filter("to is null").groupBy("c").agg(F.sum("n").alias("n_links"))
    parts = components(found.filter("to is not null").select(F.col("c").alias("a"), F.col("to").alias("b")))
    with_part = written(classes.select("c", "k1", "k2", "rep_id", "rep_fp").join(counts, "c", "left").join(parts, "c", "left")
                        .withColumn("part", F.coalesce("part", "c")), "forest-parts")
    heads = with_part.groupBy("part").agg(F.min(F.struct(F.col("rep_id").isNull().alias("z"), "rep_id", "rep_fp")).alias("h"))
    final = with_part.join(heads, "part").select("k1", "k2", "n_links", "rep_id", F.col("h.rep_id").alias("class_id"),
                                                 F.col("h.rep_fp").alias("class_fp"))
    return rows.select("doc_id", "fp", "k1", "k2").join(final, ["k1", "k2"]).select(
        "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "rep_id",
        F.col("fp").alias("text_fp"), "class_fp")


def components(links: DataFrame) -> DataFrame:
    """(c, part): the smallest node of each connected component, for every node with a link.

    Rounds of two steps on written tables until nothing changes: each node takes the smallest
    part among its neighbours', then the part of that part (pointer doubling)."""
    edges = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    parts = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("part")), "cc-parts")
    while True:
        near = (edges.join(parts.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.min("part").alias("m"))
                .withColumnRenamed("a", "c"))
        low = written(parts.join(near, "c").select("c", F.col("part").alias("old"), F.least("part", "m").alias("part")), "cc-low")
        jump = low.select(F.col("c").alias("part"), F.col("part").alias("up"))
        new = written(low.join(jump, "part", "left").select("c", "old", F.least("part", F.coalesce("up", "part")).alias("part")), "cc-new")
        parts = new.select("c", "part")
        if new.filter("part < old").isEmpty():
            return parts


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each connected group: that of the smallest id."""
    found = written(near_duplicates(docs).select("doc_id", "class_id", "text_fp", "class_fp"), "forest-decisions")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_fp") == F.col("class_fp"))
    gone = found.filter(~stays).select(F.col("doc_id").alias("_id"), F.col("text_fp").alias("_fp"))
    left = without(docs, gone, "forest-dropped")
    repeats = found.filter(stays).groupBy("doc_id", "text_fp").count().filter("count > 1")
    return left if repeats.isEmpty() else once(
        left, repeats.select(F.col("doc_id").alias("_id"), F.col("text_fp").alias("_fp")), "forest-repeats")
