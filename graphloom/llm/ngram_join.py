"""N-gram Jaccard join with a count-vector R-tree: sets of word shingles are hashed into groups, group counts are points in
an R-tree, summed coordinate minima bound the overlap, and surviving pairs are verified on the sets.

Before any tree is built, texts are brought together losslessly. Sets of a similar size that link differ in at most d shingles,
so of d + 1 + e parts that a hash cuts them into, e + 1 are equal. Parts of fewer than two shingles say little: a set that has
no more than e of them leaves them out, and still shares another part with each set that it links with. Equal parts are found by
aggregating them in each task and then in one exchange. Texts that are connected by equal parts form a cluster, outside of which none of them has a link.

Trees are built within clusters, in blocks of bounded size. Within a block, sets already connected are not compared again, and
what is returned is each set's component, not its pairs. A cluster of several blocks goes on through representatives: the sets
with most links of each block's largest component meet in blocks of their own, until one block is left. Then only the sets
outside the cluster's largest component are sent to its blocks (those of neighbouring size classes), and looked up in their
trees, so no link is lost, and a group of near copies costs what its copies and its strays cost, not its square.

Equal sets are one set from the start, by a 128-bit digest, however many documents have them. Null and empty texts, and texts
without a word, have an empty set and link with nothing; a text of fewer words than a shingle is one shingle. Every row counts
as a document: rows of a null ``doc_id`` link like others, but give no component its id (a component of such rows alone has a
null one), and rows that repeat a ``doc_id`` each have their own set. Very long texts are one set like others. Empty tables
give empty results. Other columns, whatever their names, are ignored by ``classes`` and kept by ``keep_first``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import by_slice, cut, slim
from ._text import Words, mix, shingles, slices
from .components import components

SHINGLE, PERCENT = 3, 90
#: Groups that shingles are hashed into, entries of a tree's leaf.
GROUPS, LEAF = 64, 16
#: Bytes of a block's sets, about, what a set costs besides its shingles, and representatives of a block.
BLOCK, SET_BYTES, HEADS = 12 << 20, 4096, 16
#: Part hashes that a task aggregates at a time.
BATCH = 400_000


def size_classes(percent: int, top: int = 1 << 40) -> list[int]:
    """Lower bounds of size classes such that sets that link are in the same class or in neighbouring ones."""
    out = [1]
    while out[-1] < top:
        out.append(out[-1] * 100 // percent + 1)
    return out


def parts_of(percent: int, bound: int) -> tuple[int, int]:
    """Parts into which sets of fewer than ``bound`` shingles are cut, and how many of them may be left out. 0: such sets link only if equal."""
    most = 2 * (bound - 1)
    # not monotone in the sum of both sizes, but 100 + percent more of it never allow less, so the largest is among the last so many
    d = max(s - 2 * -(-percent * s // (100 + percent)) for s in range(max(0, most - 99 - percent), most + 1))
    spare = 1 + (d + 1) // 32
    return (d + 1 + spare, spare) if d else (0, 0)


def text_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text; the texts' bounds in them; and each set's 128-bit digest in two halves."""
    w = Words(column, lower=True)
    h, doc = shingles(w, w.hashes(), k)
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    at = np.searchsorted(doc, np.arange(w.n + 1))
    own = []
    for salt in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:])
        own.append(mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).astype(np.int64))
    return h, at, *own


def part_hashes(x: np.ndarray, size: np.ndarray, schemes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets that follow each other in x, and their owners, in the sets' order."""
    bounds, parts, spare = schemes
    rows = np.repeat(np.arange(len(size)), size)
    kind = np.searchsorted(bounds, size, "right") - 1
    sigs, owners = [], []
    for step in (1, 0):  # the scheme shared with the class below, and the one shared with the class above
        scheme = kind - step
        ok = scheme >= 0
        n = parts[np.maximum(scheme, 0)]
        first = np.concatenate([[0], np.cumsum(np.where(ok, n, 0))])
        ok &= n > 0
        mine = ok[rows]
        slot = first[rows[mine]] + ((x[mine] >> np.uint64(20)) % n[rows[mine]].astype(np.uint64)).astype(np.int64)
        # a sum of mixed hashes: the part's hash in any order
        o = np.argsort(slot, kind="stable")
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(x[mine][o] + np.uint64(77)))])
        edge = np.searchsorted(slot[o], np.arange(first[-1] + 1))
        value = total[edge[1:]] - total[edge[:-1]]
        owner = np.repeat(np.arange(len(size)), np.where(ok, n, 0))
        full = np.diff(edge) >= 2
        out = full | (np.bincount(owner[~full], minlength=len(size)) > spare[np.maximum(scheme, 0)])[owner]
        within = np.arange(first[-1]) - first[owner]
        sig = mix(value + mix(scheme[owner].astype(np.uint64) * np.uint64(1 << 32) + within.astype(np.uint64) + np.uint64(1)))
        sigs.append(sig[out])
        owners.append(owner[out])
    sig, owner = np.concatenate(sigs), np.concatenate(owners)
    o = np.argsort(owner, kind="stable")
    return sig[o].astype(np.int64), owner[o]


def schemes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size classes, and by class the parts of a set and how many of them may be left out."""
    bounds = np.array(size_classes(percent))
    parts, spare = np.array([parts_of(percent, int(bounds[min(i + 2, len(bounds) - 1)])) for i in range(len(bounds))]).T
    return bounds, parts, spare


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key) of every row; equal rows have equal keys."""
    return slim(docs).withColumn("key", F.xxhash64("doc_id", "text"))


def signatures(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, hashes=None) -> DataFrame:
    """(row, doc_id, key, n_shingles, h1, h2) of every row, and with some rows the hashes of sets' parts.

    Those stand together for ``BATCH`` hashes at a time: each once (sigs), with the first row of the batch that has it (row less
    ``back``), and the edges (a, b) from that row to the others that have it. So a hash that very many sets share is aggregated
    before it is shuffled. Sets that the task has seen before have no hashes. ``hashes`` gives other signatures than the parts':
    from sets that follow each other and their sizes, the signatures and their owners, in the sets' order.
    """
    known = schemes(percent)
    hashes = hashes or (lambda x, size: part_hashes(x, size, known))

    def run(batches):
        from pyspark import TaskContext

        seen: set[tuple[int, int]] = set()
        row = TaskContext.get().partitionId() << 33
        held, size = [], 0
        none = pa.array([], pa.int64())

        def rows(part, sizes, h1, h2, ids, at_end):
            """The rows of a part; the last one has the batch's hashes, where it ends one."""
            m = len(part)
            out = [pa.array(ids), part.column("doc_id"), part.column("key"), pa.array(sizes), pa.array(h1), pa.array(h2)]
            for values in at_end or [none] * 4:
                ends = np.zeros(m + 1, np.int32)
                ends[-1] = len(values)
                out.append(pa.ListArray.from_arrays(pa.array(ends), values))
            return pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "key", "n_shingles", "h1", "h2", "sigs", "back", "a", "b"])

        def batch(last: int):
            """Each hash with its first row, and the edges from it."""
            sig, own = (np.concatenate(x) for x in zip(*held))
            o = np.lexsort((own, sig))
            sig, own = sig[o], own[o]
            new = np.append(True, sig[1:] != sig[:-1]) if len(sig) else np.zeros(0, bool)
            least = own[np.flatnonzero(new)][np.cumsum(new) - 1] if len(sig) else own
            more = least != own
            pairs = np.unique(np.stack([least[more], own[more]], axis=1), axis=0) if more.any() else np.zeros((0, 2), np.int64)
            return [pa.array(sig[new]), pa.array(last - own[new]), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]

        waiting = None
        for part in slices(batches):
            if waiting is not None:
                yield rows(*waiting, None)
            h, at, h1, h2 = text_sets(part.column("text"), k)
            fresh = np.zeros(len(part), bool)
            for i, s in enumerate(zip(h1.tolist(), h2.tolist())):
                if at[i + 1] > at[i] and s not in seen:
                    seen.add(s)
                    fresh[i] = True
            sizes = np.diff(at).astype(np.int64)
            sig, owner = hashes(h[np.repeat(fresh, sizes)], sizes[fresh])
            ids = row + np.arange(len(part))
            row += len(part)
            held.append((sig, ids[np.flatnonzero(fresh)[owner]]))
            size += len(sig)
            waiting = (part, sizes, h1, h2, ids)
            if size >= BATCH:
                yield rows(*waiting, batch(row - 1))
                waiting, held, size = None, [], 0
        if waiting is not None:
            yield rows(*waiting, batch(row - 1))

    return texts(docs).mapInArrow(run, "row long, doc_id long, key long, n_shingles long, h1 long, h2 long, sigs array<long>, back array<long>, a array<long>, b array<long>")


class CountTree:
    """A two-level R-tree over group-count vectors: leaves of ``LEAF`` neighbouring sets with their largest coordinates."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        self.order = np.lexsort((counts.argmax(axis=1), sizes))
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        starts = np.arange(0, len(sizes), LEAF)
        self.top = np.maximum.reduceat(self.counts, starts, axis=0) if len(sizes) else self.counts
        self.least = self.sizes[starts] if len(sizes) else self.sizes
        self.most = np.maximum.reduceat(self.sizes, starts) if len(sizes) else self.sizes

    def search(self, count: np.ndarray, size: int) -> np.ndarray:
        """Sets whose summed coordinate minima with the given one allow a link."""
        need = lambda other: self.percent * (size + other)  # noqa: E731  (100 + percent) * overlap must reach it
        fits = (100 * self.most >= self.percent * size) & (self.percent * self.least <= 100 * size)
        leaves = np.flatnonzero(fits)
        leaves = leaves[np.minimum(self.top[leaves], count).sum(axis=1, dtype=np.int64) * (100 + self.percent) >= need(self.least[leaves])]
        if not len(leaves):
            return leaves
        rows = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = rows[rows < len(self.sizes)]
        ok = np.minimum(self.counts[rows], count).sum(axis=1, dtype=np.int64) * (100 + self.percent) >= need(self.sizes[rows])
        return self.order[rows[ok]]


def group_counts(sets: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.bincount((s >> np.uint64(8)) % np.uint64(GROUPS), minlength=GROUPS) for s in sets]).astype(np.int32) if sets else np.zeros((0, GROUPS), np.int32)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def connect(sets: list[np.ndarray], labels: np.ndarray, asked: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Each set's component, and how many links of it were verified. ``labels``: components known so far, as numbers.

    The sets that are ``asked`` are looked up in the tree of the others; where all are, in the tree of all.
    """
    sizes = np.array([len(s) for s in sets])
    counts = group_counts(sets)
    labels, links = labels.copy(), np.zeros(len(sets), np.int64)
    pool = np.arange(len(sets)) if asked.all() else np.flatnonzero(~asked)
    tree = CountTree(counts[pool], sizes[pool], percent)
    for i in np.flatnonzero(asked).tolist():
        near = pool[tree.search(counts[i], len(sets[i]))]
        if asked.all():
            near = near[near > i]
        near = near[labels[near] != labels[i]]
        while len(near):
            j, near = int(near[0]), near[1:]
            if linked(sets[i], sets[j], percent):
                links[[i, j]] += 1
                labels[labels == labels[j]] = labels[i]
                near = near[labels[near] != labels[i]]
    return labels, links


def _unpack(column) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column]


def _block_links(percent: int):
    """Within a block: (a, b) of each set b and the first set a of its component; with ``many``, also (row, row) of representatives."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        row = pdf["row"].to_numpy()
        own, links = connect(_unpack(pdf["own"]), np.arange(len(row)), np.ones(len(row), bool), percent)
        least = pd.Series(row).groupby(own).transform("min").to_numpy()
        a, b = least[least != row], row[least != row]
        if pdf["many"].iloc[0]:
            groups, n = np.unique(least, return_counts=True)
            inside = np.flatnonzero(least == groups[n.argmax()])
            heads = row[inside[np.argsort(-links[inside], kind="stable")[: max(1, min(HEADS, len(row) // 4))]]]
            a, b = np.concatenate([a, heads]), np.concatenate([b, heads])
        return pd.DataFrame({"a": a, "b": b})

    return kernel


def _stray_links(percent: int):
    """Between a block and strays: (a, b) of labels that turn out to be one component."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["asked", "row"], ignore_index=True)
        names, was = np.unique(pdf["label"].to_numpy(), return_inverse=True)
        now, _ = connect(_unpack(pdf["own"]), was, pdf["asked"].to_numpy(), percent)
        pairs = pd.DataFrame({"a": names[was], "now": now}).drop_duplicates()
        pairs["b"] = pairs.groupby("now")["a"].transform("min")
        return pairs.loc[pairs["a"] != pairs["b"], ["b", "a"]].set_axis(["a", "b"], axis=1)

    return kernel


def _cost():
    return F.sum(8 * F.col("n_shingles") + SET_BYTES)


def _placed(members: DataFrame, block: int) -> DataFrame:
    """(row, cluster, kind, block, many, _blocks): a cluster that fits is one block; others have blocks of their own for each size class."""
    whole = members.groupBy("cluster").agg((_cost() > block).alias("many"))
    by_kind = members.groupBy("cluster", "kind").agg(F.ceil(_cost() / block).cast("long").alias("_blocks"))
    sized = by_kind.join(whole, "cluster")
    own = F.when(F.col("many"), F.col("kind") * F.lit(1 << 32) + F.pmod(F.xxhash64("row"), F.col("_blocks"))).otherwise(F.lit(0).cast("long"))
    return members.join(sized, ["cluster", "kind"]).select("row", "cluster", "kind", own.alias("block"), "many", "_blocks")


def _gathered(heads: DataFrame, block: int) -> DataFrame:
    """(row, cluster, block, many) of representatives; some block has several of them if there are several, so they grow fewer."""
    blocks = heads.groupBy("cluster").agg(F.least(F.ceil(_cost() / block), F.ceil(F.count("*") / 4)).cast("long").alias("_blocks"))
    return heads.join(blocks, "cluster").select("row", "cluster", F.pmod(F.xxhash64("row"), F.col("_blocks")).alias("block"), (F.col("_blocks") > 1).alias("many"))


def verified(sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) among rows whose components are those of all links; sets: (row, cluster, kind, n_shingles, own)."""
    members = sets.select("row", "cluster", "kind", "n_shingles")
    first = cut(_placed(members, block))
    placed, found = first, []
    while True:
        dealt = sets.select("row", "own").join(placed.select("row", "cluster", "block", "many"), "row")
        out = cut(dealt.groupBy("cluster", "block").applyInPandas(_block_links(percent), "a long, b long"))
        found.append(out.filter("a <> b"))
        heads = members.join(out.filter("a = b").select(F.col("a").alias("row")), "row")
        if heads.isEmpty():
            break
        placed = cut(_gathered(heads, block))
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    large = first.filter("many")
    if large.isEmpty():
        return edges
    joined = large.join(components(edges), F.col("row") == F.col("node"), "left").select("row", "cluster", "kind", "block", "_blocks", F.coalesce("label", "row").alias("label"))
    joined = cut(joined.join(members.select("row", "n_shingles"), "row"))
    most = joined.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max(F.struct("count", "label")).alias("_top")).select("cluster", F.col("_top.label").alias("_most"))
    told = cut(joined.join(most, "cluster").withColumn("stray", F.col("label") != F.col("_most")))
    chunks = told.filter("stray").groupBy("cluster").agg(F.ceil(_cost() / block).cast("long").alias("_chunks"))
    blocks = told.select("cluster", "kind", "_blocks").distinct().groupBy("cluster").agg(F.collect_list(F.struct("kind", "_blocks")).alias("_all"))  # one entry a size class
    answer = told.join(chunks, "cluster").select("row", "cluster", "label", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("chunk"), F.lit(False).alias("asked"))
    close = F.filter("_all", lambda x: F.abs(x["kind"] - F.col("kind")) <= 1)
    every = F.flatten(F.transform(close, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["_blocks"] - 1), lambda i: x["kind"] * F.lit(1 << 32) + i)))
    ask = told.filter("stray").join(chunks, "cluster").join(blocks, "cluster").select("row", "cluster", "label", F.explode(every).alias("block"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("_chunks")).alias("chunk"), F.lit(True).alias("asked"))
    # a block also gets strays that are its own: it answers those with all its other sets
    dealt = sets.select("row", "own").join(answer.select(*ask.columns).union(ask), "row")
    return edges.union(cut(dealt.groupBy("cluster", "block", "chunk").applyInPandas(_stray_links(percent), "a long, b long")))


def _labelled(docs: DataFrame, k: int, percent: int, hashes=None) -> tuple[DataFrame, DataFrame]:
    """Every row with its digest, and for each digest its component's smallest id and the key of the row that stands for it."""
    held = cut(signatures(docs, k, percent, hashes))
    parts = held.filter("size(sigs) > 0").select("row", F.explode(F.arrays_zip("sigs", "back")).alias("_s")).select(F.col("_s.sigs").alias("sig"), (F.col("row") - F.col("_s.back")).alias("b"))
    among = parts.withColumn("a", F.min("b").over(Window.partitionBy("sig"))).filter("a <> b").select("a", "b")
    within = held.filter("size(a) > 0").select(F.explode(F.arrays_zip("a", "b")).alias("_s")).select("_s.a", "_s.b")
    clusters = components(among.union(within))
    rows = held.select("row", "doc_id", "key", "n_shingles", "h1", "h2")
    kinds = F.array(*map(F.lit, size_classes(percent)))
    alike = cut(rows.join(clusters, F.col("row") == F.col("node")).groupBy("h1", "h2").agg(F.min_by("key", "row").alias("key"), F.min("row").alias("row"), F.min("label").alias("cluster"), F.min("n_shingles").alias("n_shingles")))
    several = alike.groupBy("cluster").agg(F.count("*").alias("_n")).filter("_n > 1").select("cluster")
    members = alike.join(several, "cluster")
    wanted = members.withColumn("kind", F.size(F.filter(kinds, lambda x: x <= F.col("n_shingles"))).cast("long"))

    def kernel(part):
        h, at, h1, h2 = text_sets(part.column("text"), k)
        same = (h1 == part.column("h1").to_numpy()) & (h2 == part.column("h2").to_numpy())
        at = at.tolist()
        out = part.filter(pa.array(same))
        own = pa.array([h[at[i] : at[i + 1]].tobytes() for i in np.flatnonzero(same)], pa.binary())
        return {c: out.column(c) for c in ("row", "cluster", "kind", "n_shingles")} | {"own": own}

    sets = by_slice(texts(docs).select("key", "text").join(wanted, "key"), kernel, "row long, cluster long, kind long, n_shingles long, own binary")
    joined = components(verified(cut(sets.dropDuplicates(["row"])), percent))
    digests = rows.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("row").alias("row"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    digests = digests.join(joined, F.col("row") == F.col("node"), "left").select("h1", "h2", "first", F.coalesce("label", "row").alias("label"))
    digests = cut(digests)
    least = digests.groupBy("label").agg(F.min("first").alias("first"), F.count("*").alias("_sets")).select("label", "first")
    named = digests.select("h1", "h2", "label").join(least, "label").select("h1", "h2", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key"))
    return rows, named


def classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, hashes=None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id: the smallest id reachable by links."""
    held, named = _labelled(docs, k, percent, hashes)
    out = held.join(named, ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents but those that link, directly or through others, with another one that stays: that of the smallest id.

    Of a component of null ids alone one stays. Rows that repeat id and text are one document, and stay or go together.
    """
    held, named = _labelled(docs, k, percent)
    spare = (n for i in range(len(docs.columns) + 3) if (n := f"_k{i}") not in docs.columns)
    own, key, doc = next(spare), next(spare), next(spare)
    gone = held.filter("n_shingles > 0").join(named, ["h1", "h2"]).filter("key <> first_key").select(F.col("key").alias(key), F.col("doc_id").alias(doc)).distinct()
    hashed = docs.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return hashed.join(gone, (F.col(own) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left_anti").drop(own)
