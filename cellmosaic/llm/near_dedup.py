"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its k-word shingles (A-Z lower-cased), as 64-bit hashes. Its sketch has ``ROWS * BANDS`` coordinates, filled in
rounds: in round i every shingle throws a hash value into a bin that it draws anew, earlier rounds win, and after as many rounds
as there are bins the bins are filled one by one, so that every coordinate is sure to fill. Coordinates of two sketches agree with the
sets' Jaccard similarity, concentrated around it. ``ROWS`` coordinates make a band; documents that share a band are candidates:
at similarity 0.8, all 24 bands miss with probability 3e-6.

Documents with equal sets (equal in size and in 128 bits of hash) become one node first. In each bucket of a band, every node is paired with the bucket's first document
only. Pairs whose sketches come near the threshold (five standard deviations below it or better) are verified on the full sets, first one pair a node, then
those that would join different components. What is left are buckets whose nodes still lie in different components. Small ones (``GROUP`` nodes, ``GRAMS`` shingles) are compared inside:
nodes whose sketches come near across components are found, and their full sets are compared by an inverted list; only links that join components leave a block.

The nodes of larger ones are dealt by their rarest shingles instead, which loses no link: of two sets that are similar enough, the first shingles of both, in one order of all
shingles, have one in common, as many of them as the smaller set can lack (a ninth at 0.8) and as many as the larger one can (a fifth). The order is by frequency, counted in ``SLOTS`` slots, so shingles that
half of all pages share come last and bring nobody together. So pages that are alike in a common part but not similar enough are no candidates; what remains is cut into
cells of bounded size.

Defined results: a text without words, empty or null, has 0 shingles, is linked with nothing and kept. Rows are told apart by
their place, so repeated rows are copies of each other; a row with a null id gets the smallest id of its component, null if there is
none. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm.components import components
from cellmosaic.llm.shared import written
from cellmosaic.llm.textblocks import blocks, mix, shingles

ROWS, BANDS = 4, 24
BINS = ROWS * BANDS
GROUP, GRAMS, SLOTS = 2000, 2_000_000, 1 << 18
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' shingle sets in a row, each sorted, and where each starts. With fewer than k words the whole sequence is the one shingle."""
    start, end, first = block.words()
    words = block.hashes(start, end, lower=True)
    grams = shingles(words, k)
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            sets.append(shingles(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            sets.append(words[:0])
    return (np.concatenate(sets) if sets else words[:0]), np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)


def sketch(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of ``BINS`` coordinates for each set; rows of empty sets stay unfilled."""
    n = len(starts) - 1
    out = np.full((n, BINS), _FREE, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(starts))
    for i in range(2 * BINS):
        if not len(values):
            break
        h = mix(values + np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = (h % np.uint64(BINS)).astype(np.int64) if i < BINS else np.full(len(values), i - BINS)
        np.minimum.at(flat, owner * BINS + bins, (np.uint64(i) << np.uint64(56)) | (h >> np.uint64(8)))
        open_ = (out == _FREE).any(axis=1)[owner]
        values, owner = values[open_], owner[open_]
    return out


def _nodes(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """128 bits of hash of each set and its size."""
    size, out = np.diff(starts).astype(np.uint64), []
    for salt in (0, 0x5851F42D4C957F2D):
        sums = np.append(np.uint64(0), np.cumsum(mix(values ^ np.uint64(salt))))
        out.append(mix(sums[starts[1:]] - sums[starts[:-1]] + size))
    flat = np.stack(out, 1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(size), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                values, starts = shingle_sets(block, k)
                rows = sketch(values, starts)
                bands = np.zeros((block.n, BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands + rows[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
                cols = [batch.column(c).slice(block.first, block.n) for c in ("id", "mark")] + [pa.array(np.diff(starts)), _nodes(values, starts)]
                tags = np.ascontiguousarray(mix(rows).astype(np.uint8))
                cols.append(pa.array([x.tobytes() for x in tags], pa.binary()))
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["id", "mark", "n", "node", "tags", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                values, starts = shingle_sets(block, k)
                yield pa.RecordBatch.from_arrays([_nodes(values, starts), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))], ["node", "grams"])

    return run


def _tags(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _near(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = (_tags(batch.column("ta")) == _tags(batch.column("tb"))).sum(axis=1) >= least
                yield batch.filter(pa.array(keep)).select(["a", "b", "ida"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often shingles fall into each slot, in this task."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        total += np.bincount(batch.column("grams").flatten().to_numpy().view(np.uint64) % np.uint64(SLOTS), minlength=SLOTS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["slot", "n"])


def _prefixes(often: np.ndarray, percent: int):
    """The first shingles of each set, rarest first; ``index``: also among those that a set no larger than its partner must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("grams")
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            grams = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((grams, often[(grams.view(np.uint64) % np.uint64(SLOTS)).astype(np.int64)], owner))
            rank = np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
            probe = size + (-size * percent) // 100 + 1
            index = size + (-2 * size * percent) // (100 + percent) + 1
            at = np.flatnonzero(rank < probe[owner])
            row = owner[at]
            cols = [pa.array(grams[order[at]]), *(batch.column(c).take(pa.array(row)) for c in ("node", "comp")), pa.array(size[row]), pa.array(rank[at] < index[row])]
            yield pa.RecordBatch.from_arrays(cols, ["key", "node", "comp", "n", "index"])

    return run


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal numbers."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def _plausible(least: int, percent: int):
    """Of one block: the nodes that have a partner in another component whose size and sketch allow a link. In cells of ``index`` shingles the partner isn't smaller."""

    def run(table: pa.Table) -> pa.Table:
        odd, part, size = (table.column(c).to_numpy() for c in ("odd", "part", "n"))
        comp, tags = _codes(table.column("comp")), _tags(table.column("tags"))
        keep = np.zeros(len(comp), bool)
        wide, thin = np.flatnonzero(part != 2), np.flatnonzero((part != 1) & odd)
        for x in thin:
            smaller = size[wide] if part[x] == 0 else np.where(size[wide] < size[x], 0, size[wide])
            fits = wide[(comp[wide] != comp[x]) & (np.minimum(smaller, size[x]) * 100 >= np.maximum(size[wide], size[x]) * percent)]
            fits = fits[(tags[fits] == tags[x]).sum(axis=1) >= least]
            keep[fits] = True
            keep[x] |= len(fits) > 0
        return table.drop_columns(["tags", "n"]).filter(pa.array(keep))

    return run


def _exact(percent: int):
    """Of one block: links on the full sets, one for each two components that they join."""

    def run(table: pa.Table) -> pa.Table:
        odd, part = (table.column(c).to_numpy() for c in ("odd", "part"))
        comp, grams = _codes(table.column("comp")), table.column("grams").combine_chunks()
        at = grams.offsets.to_numpy() - grams.offsets[0].as_py()
        size = np.diff(at)
        ids = np.unique(grams.flatten().to_numpy(), return_inverse=True)[1]
        wide, thin = part != 2, np.flatnonzero((part != 1) & odd)
        owner = np.repeat(np.arange(len(comp)), size)
        order = np.argsort(ids, kind="stable")
        order = order[wide[owner[order]]]
        post = owner[order]
        begin = np.append(0, np.cumsum(np.bincount(ids[order], minlength=int(ids.max(initial=0)) + 1)))
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = c = parent.get(parent[c], parent[c])
            return c

        out: list[tuple[int, int]] = []
        for x in thin:
            own = ids[at[x] : at[x + 1]]
            n = begin[own + 1] - begin[own]
            spots = np.repeat(begin[own] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
            both = np.bincount(post[spots], minlength=len(comp))
            for y in np.flatnonzero((both * 100 >= (size + size[x] - both) * percent) & wide & (comp != comp[x])):
                a, b = root(int(comp[x])), root(int(comp[y]))
                if a != b:
                    parent[a] = b
                    out.append((int(x), int(y)))
        node = table.column("node")
        return pa.table([node.take(pa.array([r[k] for r in out], pa.int64())) for k in (0, 1)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_mark: bool = False) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of every row; linked are sets with 100 * intersection >= percent * union.

    ``with_mark``: also ``mark``, ``xxhash64`` of id and text, to find the row by.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("mark", F.xxhash64("id", "text"))
    all_rows = written(own.mapInArrow(_sketches(k), "id long, mark long, n long, node binary, tags binary, bands array<long>"), "sketches")
    far = (1 << 63) - 1
    nodes = all_rows.filter("n > 0").withColumn("id", F.coalesce("id", F.lit(far)))
    first = nodes.groupBy("node").agg(F.min("id").alias("id"))
    reps = written(nodes.select("node", "mark", "n", "tags", "bands").dropDuplicates(["node"]).join(first, "node"), "nodes")
    share = percent / 100
    least = math.floor(BINS * (share - 5 * math.sqrt(share * (1 - share) / BINS)))

    rows = reps.select("node", "id", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min(F.struct("id", "node")).alias("head"), F.count("*").alias("size")).filter("size > 1")
    buckets = written(rows.join(shared, "key").select("key", "node", "n", "size", F.col("head.node").alias("b"), F.col("head.id").alias("idb")), "buckets")
    tag = reps.select(F.col("node").alias("a"), F.col("tags").alias("ta"), F.col("n").alias("na"))
    other = reps.select(F.col("node").alias("b"), F.col("tags").alias("tb"), F.col("n").alias("nb"))

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs ``a, b, ida`` whose sizes and sketches allow a link."""
        both = pairs.join(tag, "a").join(other, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        return both.select("a", "b", "ida", "ta", "tb").mapInArrow(_near(least), "a binary, b binary, ida long")

    candidates = written(near(buckets.filter("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.first("idb").alias("ida"))), "candidates")
    sets: DataFrame | None = None

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs ``a, b``, those whose full sets are similar enough."""
        ga = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
        gb = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
        inter = F.size(F.array_intersect("ga", "gb")).cast("long")
        return pairs.join(ga, "a").join(gb, "b").select("a", "b", inter.alias("i"), (F.size("ga") + F.size("gb") - inter).alias("u")).filter(F.col("i") * 100 >= F.col("u") * percent).select("a", "b")

    # the sets of all nodes that any pair can need: those in a bucket with others and near its first, or in one of three or more
    need = candidates.select(F.col("a").alias("node")).unionByName(candidates.select(F.col("b").alias("node"))).unionByName(buckets.filter("size > 2").select("node")).distinct()
    marks = need.join(reps.select("node", "mark"), "node").select("mark")
    sets = written(own.join(marks, "mark", "left_semi").select("text").mapInArrow(_sets(k), "node binary, grams array<long>").dropDuplicates(["node"]), "sets")

    one = candidates.groupBy("a").agg(F.min(F.struct("ida", "b")).alias("to")).select("a", F.col("to.b").alias("b"))
    one = written(one, "first-pairs")
    links = written(verified(one), "links")
    if links.isEmpty():
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    else:
        labels = components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs between components."""
        la, lb = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        return pairs.join(la, "a", "left").join(lb, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    rest = written(apart(candidates.select("a", "b").join(one, ["a", "b"], "left_anti")), "second-pairs")
    if not rest.isEmpty():
        more = written(verified(rest), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)

    # buckets of three or more whose nodes still lie in different components: ``top`` is a bucket's largest component, ``odd`` all else
    named = buckets.filter("size > 2").select("key", "node", "n").join(labels, "node", "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp"))
    per = named.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    mixed = per.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("size"), F.sum("n").alias("grams"), F.count("*").alias("comps")).filter("comps > 1")
    mixed = written(mixed.select("key", F.col("top.comp").alias("top"), ((F.col("size") <= GROUP) & (F.col("grams") <= GRAMS)).alias("small")), "mixed-buckets")
    tags, base, none = reps.select("node", "tags"), ["key", "node", "comp", "odd", "tags", "n"], F.lit(0).cast("long")
    rows = named.join(mixed.filter("small"), "key").join(tags, "node").withColumn("odd", F.col("comp") != F.col("top"))
    blocks_ = rows.select(*base, F.lit(0).alias("part"), (none - 1).alias("i"), (none - 1).alias("j"))  # part 0: compared both ways; 1: as one of the cell; 2: as one that the cell is compared with
    crowded = mixed.filter("not small").select("key")
    if not crowded.isEmpty():
        often = np.zeros(SLOTS, np.int64)
        counted = sets.mapInArrow(_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # ``SLOTS`` rows at most
        often[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
        own_sets = sets.join(named.join(crowded, "key", "left_semi").select("node", "comp").distinct(), "node")
        first = written(own_sets.mapInArrow(_prefixes(often, percent), "key long, node binary, comp binary, n long, index boolean"), "prefixes")
        parts = lambda n, grams: F.ceil(F.greatest(n / GROUP, grams / GRAMS, F.lit(1)))
        of_index = F.when(F.col("index"), F.col("n"))
        cells = first.groupBy("key").agg(
            parts(F.count("*"), F.sum("n")).alias("g"), parts(F.count(of_index), F.coalesce(F.sum(of_index), none)).alias("h"), F.count(of_index).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
        )
        rows = first.join(cells.filter("m > 0 and lo < hi").select("key", "g", "h"), "key").join(tags, "node").withColumn("odd", F.lit(True))
        i, j = F.pmod(F.xxhash64("node"), "g"), F.pmod(F.xxhash64(F.lit(1), "node"), "h")
        wide = rows.select(*base, F.lit(1).alias("part"), i.alias("i"), F.explode(F.sequence(none, F.col("h") - 1)).alias("j"))
        thin = rows.filter("index").select(*base, F.lit(2).alias("part"), F.explode(F.sequence(none, F.col("g") - 1)).alias("i"), j.alias("j"))
        blocks_ = blocks_.unionByName(wide).unionByName(thin)
    found = blocks_.groupBy("key", "i", "j").applyInArrow(_plausible(least, percent), "key long, node binary, comp binary, odd boolean, part int, i long, j long")
    left = written(found, "plausible")
    if not left.isEmpty():
        more = written(left.join(sets, "node").groupBy("key", "i", "j").applyInArrow(_exact(percent), "a binary, b binary"), "links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    named = reps.select("node", "id").join(labels, "node", "left").select("node", "id", F.coalesce("comp", "node").alias("comp"))
    least_id = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    of_node = named.join(least_id, "comp").select("node", F.when(F.col("component_id") != far, F.col("component_id")).alias("component_id"))
    full = all_rows.filter("n > 0").select("id", "mark", "n", "node").join(of_node, "node").select("id", "mark", "n", "component_id")
    out = full.unionByName(all_rows.filter("n = 0").select("id", "mark", "n", F.col("id").alias("component_id")))
    own = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")]
    return out.select(*own, *["mark"] * with_mark)
