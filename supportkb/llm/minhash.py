"""Near-duplicate documents by an LSH forest over MinHash signatures.

Sets of word shingles give TREES signatures of DEPTH minimum hashes. Each tree is one sorted order of all signatures,
range-partitioned by Spark; neighbours with a common prefix are candidates. A stretch that shares LEAST values and is no
longer than RUN meets as a whole; a longer one is taken apart at the next depth, down to DEPTH, where a
document meets its next NEXT neighbours. Stretches cut by a partition's end are mended in a second, much smaller pass
over the rows at the ends. Every candidate is confirmed on the full sets of both texts.

Taking long stretches apart may separate linked documents that are crowded (in a long stretch in more than CROWDED
tree or more; for all others the remaining trees find a link of likeness 0.75 but for a chance of 4e-6). For crowded
documents an exact rest follows: in every long stretch the documents outside its largest component are compared with
all others of the stretch, in pairs of bounded blocks: signatures first, full sets of what these leave, giving links only.

Equal sets are one class before anything is compared. Components settle by star contraction.

Defined cases: null or wordless texts have an empty set and are linked with nothing; fewer words than a shingle are one
shingle; rows that share an id are one document, each going by its own text, of which links are confirmed with the least;
rows without an id take the class of equal sets that have one and are always kept; an empty table gives no row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportkb.llm import common
from supportkb.llm.components import components
from supportkb.sizing import broadcast_if_small

TREES, DEPTH, LEAST = 16, 8, 2
RUN, NEXT, CROWDED = 12, 3, 1
REST_BLOCK, REST_SHINGLES, REST_COLUMNS = 256, 1 << 17, 4096
TREE_ROWS = 150_000
PIECE = 1 << 20

_DRAW = np.random.default_rng(1234)
_A = _DRAW.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_B = _DRAW.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_WORD = _DRAW.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, flat, with the offset of each text."""
    data = common.lower_ascii(data)
    start, end, first = common.words(data, offsets)
    hashed = common.span_hash(common.prefix_hash(data), start, end)
    n_words = np.diff(first)
    count = np.where(n_words == 0, 0, np.maximum(n_words - width + 1, 1))
    row = np.repeat(np.arange(len(count)), count)
    at = np.repeat(first[:-1], count) + common.sequences(count)
    span = np.minimum(n_words, width)[row]
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        use = k < span
        total[use] += hashed[at[use] + k] * _WORD[k]
    total = common.mix(total + span.astype(np.uint64) * _WORD[width])
    order = np.lexsort((total, row))
    row, total = row[order], total[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (total[1:] != total[:-1])
    return total[keep], np.searchsorted(row[keep], np.arange(len(count) + 1))


def set_keys(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit keys per set, equal for equal sets."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    for k in range(2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(flat * _WORD[40 + k] + _WORD[50 + k]))])
        out[:, k] = total[offsets[1:]] - total[offsets[:-1]]
    return out


def signatures(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minimum hashes per set; empty sets get zeros."""
    short = (flat >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, TREES * DEPTH), np.uint32)
    if len(full):
        starts = offsets[full]
        for k in range(TREES * DEPTH):
            mixed = short * _A[k] + _B[k]
            mixed ^= mixed >> np.uint32(15)
            mixed *= _A[-1 - k]
            out[full, k] = np.minimum.reduceat(mixed, starts)
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    """A matrix as a binary column, one row per value."""
    width = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set keys k1 and k2, signature of every row."""
    def run(batches):
        for batch in batches:
            data, offsets = common.column_bytes(batch.column(1))
            for a, b in common.pieces(data, offsets, PIECE):
                flat, at = shingles(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], width)
                keys = set_keys(flat, at).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(at), pa.int64()), pa.array(keys[:, 0]),
                     pa.array(keys[:, 1]), _fixed(signatures(flat, at).astype(">u4"))],
                    ["doc_id", "n_shingles", "k1", "k2", "signature"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, signature binary"))


def _pairs_of(lcp: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of candidates in a sorted order, and which rows stand in a long stretch. ``lcp`` is the common
    prefix with the row before."""
    n = len(lcp)
    left, right = [], []
    open_rows, crowded = np.ones(n, bool), np.zeros(n, bool)
    for depth in range(LEAST, DEPTH + 1):
        first = np.flatnonzero(lcp < depth)
        size = np.diff(np.r_[first, n])
        long = np.repeat(size > RUN, size)
        if depth == LEAST:
            crowded = long
        take = open_rows & ~long if depth < DEPTH else open_rows
        stretch = np.repeat(np.arange(len(first)), size)
        for k in range(1, RUN):
            i = np.flatnonzero(take[:n - k] & (stretch[:n - k] == stretch[k:])) if n > k else np.zeros(0, np.int64)
            if depth == DEPTH and k > NEXT:
                i = i[~long[i]]
            if not len(i):
                break
            left.append(i)
            right.append(i + k)
        open_rows = open_rows & long
        if not open_rows.any():
            break
    cat = (lambda x: np.concatenate(x) if x else np.zeros(0, np.int64))
    return cat(left), cat(right), crowded


def _forest_pass(rows: DataFrame, parts: int, edges: bool) -> DataFrame:
    """Candidates of one sorted pass: (kind, tree, key, doc, other, n). kind 0: pair doc/other; 1: doc is in a long stretch
    of this tree; 2: a row at the end of a partition, to be passed again."""
    ordered = rows.repartitionByRange(parts, "tree", "key", "tie")

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        tree, tie, doc, size = (t.column(c).to_numpy() for c in ("tree", "tie", "doc", "n"))
        raw = common.column_bytes(t.column("key"))[0].reshape(-1, DEPTH * 4)
        keys = raw.view(">u4").astype(np.uint32)
        order = np.lexsort((tie, *[keys[:, k] for k in range(DEPTH - 1, -1, -1)], tree))
        tree, tie, doc, size, keys, raw = tree[order], tie[order], doc[order], size[order], keys[order], raw[order]
        same = np.zeros((len(doc), DEPTH), bool)
        same[1:] = (keys[1:] == keys[:-1]) & (tree[1:] == tree[:-1])[:, None]
        lcp = np.cumprod(same, axis=1).sum(1)
        i, j, crowded = _pairs_of(lcp, len(doc))
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = (100 * small >= 75 * large) & (doc[i] != doc[j])
        a, b = np.minimum(doc[i], doc[j])[ok], np.maximum(doc[i], doc[j])[ok]
        pairs = np.unique(np.stack([a, b], 1), axis=0)
        marked = np.flatnonzero(crowded)
        end = np.unique(np.r_[np.arange(min(RUN, len(doc))), np.arange(max(0, len(doc) - RUN), len(doc))]) if edges else np.zeros(0, np.int64)
        kinds = np.repeat(np.array([0, 1, 2], np.int32), [len(pairs), len(marked), len(end)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds), pa.array(np.r_[np.zeros(len(pairs), np.int32), tree[marked], tree[end]].astype(np.int32)),
             _fixed(np.concatenate([np.zeros((len(pairs) + len(marked), DEPTH * 4), np.uint8), raw[end]])),
             pa.array(np.r_[np.zeros(len(pairs) + len(marked), np.int64), tie[end]].astype(np.int64)),
             pa.array(np.r_[pairs[:, 0], doc[marked], doc[end]].astype(np.int64)),
             pa.array(np.r_[pairs[:, 1], doc[marked], doc[end]].astype(np.int64)),
             pa.array(np.r_[np.zeros(len(pairs) + len(marked), np.int64), size[end]].astype(np.int64))],
            ["kind", "tree", "key", "tie", "doc", "other", "n"])
    return ordered.mapInArrow(run, "kind int, tree int, key binary, tie long, doc long, other long, n long")


def forest(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs a < b, crowded documents with the trees of their long stretches) of class representatives (doc_id, n_shingles, signature)."""
    cut = [F.struct(F.lit(t).alias("tree"), F.substring("signature", 1 + t * DEPTH * 4, DEPTH * 4).alias("key"),
                    F.xxhash64("doc_id", F.lit(t)).alias("tie")) for t in range(TREES)]
    rows = reps.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.inline(F.array(*cut)))
    parts = max(1, -(-reps.count() * TREES // TREE_ROWS))
    found = None
    while True:
        this = common.written(_forest_pass(rows.select("tree", "key", "tie", "doc", "n"), parts, parts > 1), "forest")
        found = this if found is None else found.unionByName(this)
        if parts == 1:
            break
        rows = this.filter("kind = 2")
        parts = max(1, parts // 64)
    pairs = found.filter("kind = 0").select(F.col("doc").alias("a"), F.col("other").alias("b")).distinct()
    crowded = (found.filter("kind = 1").groupBy("doc").agg(F.collect_set("tree").alias("trees"))
               .filter(F.size("trees") > CROWDED).select("doc", F.explode("trees").alias("tree")))
    return pairs, crowded


def _linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * shared >= percent * (len(one) + len(other) - shared)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the likeness; ``texts`` (doc_id, text) holds the documents of the pairs."""
    def run(batches):
        for batch in batches:
            sets = []
            for c in (2, 3):
                data, offsets = common.column_bytes(batch.column(c))
                got = []
                for a, b in common.pieces(data, offsets, PIECE):
                    flat, at = shingles(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], width)
                    got += np.split(flat, at[1:-1])
                sets.append(got)
            keep = pa.array([_linked(x, y, percent) for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)
    left = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    both = left.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _by_size(docs: np.ndarray, size: np.ndarray, most: int):
    """Runs of documents of at most ``most`` shingles together, one document at least."""
    total, at = np.cumsum(size[docs]), 0
    while at < len(docs):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield docs[at:end]
        at = end


def meetings(crowded: DataFrame, reps: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(asking, asked): arrays of (doc_id, component) whose documents may be linked across components. In every long stretch (tree,
    first LEAST values), blocks of its documents outside the largest component meet blocks of all its documents, by their
    signatures alone; a pair of blocks is a row of its own, so a stretch of any length is many tasks. A pair of documents is looked at
    in the first stretch it shares, and left out where their signatures agree in less than ``percent`` by six standard
    deviations."""
    n = TREES * DEPTH
    least = n * percent / 100 - 6 * (n * percent / 100 * (1 - percent / 100)) ** 0.5
    spot = F.substring("signature", 1 + F.col("tree") * (DEPTH * 4), F.lit(LEAST * 4))
    here = (crowded.join(reps.select(F.col("doc_id").alias("doc"), "n_shingles", "signature"), "doc").withColumn("spot", spot)
            .join(found.select(F.col("node").alias("doc"), "component"), "doc", "left")
            .select("tree", "spot", F.col("doc").alias("doc_id"), F.coalesce("component", "doc").alias("component"), "n_shingles", "signature"))
    here = common.written(here, "crowded")
    spots = ["tree", "spot"]
    sizes = here.groupBy(*spots, "component").agg(F.count(F.lit(1)).alias("n"))
    blocks = lambda count: F.ceil(count / REST_BLOCK).cast("int")
    regions = (sizes.groupBy(*spots).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("largest"), F.max("n").alias("n"),
                                         F.sum("n").alias("members"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
               .select(*spots, "largest", blocks(F.col("members") - F.col("n")).alias("askers"), blocks(F.col("members")).alias("askeds")))
    regions = common.written(regions, "regions")
    marked = here.join(broadcast_if_small(regions), spots)
    item = F.struct("doc_id", "component", "n_shingles", "signature")

    def packed(rows, name):
        block = F.pmod(F.xxhash64("doc_id"), F.col(f"{name}s")).cast("int")
        return rows.groupBy(*spots, block.alias(f"{name}_block")).agg(F.collect_list(item).alias(name))
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    pairs = (regions.select(*spots, numbers("askers").alias("asker_block"), "askeds")
             .select(*spots, "asker_block", numbers("askeds").alias("asked_block")))
    meets = (pairs.join(packed(marked.filter("component <> largest"), "asker"), [*spots, "asker_block"])
             .join(packed(marked, "asked"), [*spots, "asked_block"]))

    def side(column, at):
        item = column.slice(at, 1).flatten()
        sig = common.column_bytes(item.field(3))[0].reshape(-1, n * 4).view(">u4").astype(np.uint32)
        return item.field(0).to_numpy(), item.field(1).to_numpy(), item.field(2).to_numpy(), sig

    def run(batches):
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("component", pa.int64())]))
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for at in range(batch.num_rows):
                tree = batch.column(0)[at].as_py()
                (iq, cq, nq, sq), (im, cm, nm, sm) = side(batch.column(1), at), side(batch.column(2), at)
                agree = np.zeros((len(sq), len(sm)), np.uint8)
                for k in range(n):
                    agree += sq[:, k, None] == sm[None, :, k]
                maybe = (agree >= least) & (cq[:, None] != cm[None, :])
                for t in range(tree):
                    shared = np.ones(maybe.shape, bool)
                    for k in range(t * DEPTH, t * DEPTH + LEAST):
                        shared &= sq[:, k, None] == sm[None, :, k]
                    maybe &= ~shared
                for q in _by_size(np.flatnonzero(maybe.any(1)), nq, REST_SHINGLES):
                    for m in _by_size(np.flatnonzero(maybe[q].any(0)), nm, REST_SHINGLES):
                        q_in = q[maybe[np.ix_(q, m)].any(1)]
                        if len(q_in):
                            for held, ids, comps in ((out[0], iq[q_in], cq[q_in]), (out[1], im[m], cm[m])):
                                held.append([{"doc_id": d, "component": c} for d, c in zip(ids.tolist(), comps.tolist())])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in out], ["asking", "asked"])
    side_type = "array<struct<doc_id: long, component: long>>"
    return meets.select("tree", "asker", "asked").mapInArrow(run, f"asking {side_type}, asked {side_type}")


def rest(crowded: DataFrame, reps: DataFrame, texts: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components of crowded documents, counted on the full sets of what ``meetings`` leaves: one bounded group of
    texts (REST_SHINGLES on either side, or one longer text) at a time."""
    met = meetings(crowded, reps, found, percent).withColumn("meeting", F.monotonically_increasing_id())
    met = common.written(met, "meetings")
    rows = None
    for asks, name in ((True, "asking"), (False, "asked")):
        part = met.select("meeting", F.lit(asks).alias("asks"), F.explode(name).alias("one")).select("meeting", "asks", "one.*")
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.join(texts, "doc_id").select("meeting", "asks", "component", "text")

    def sets(column):
        data, offsets = common.column_bytes(column)
        return shingles(data, offsets, width)

    def grid(flat, cut, some):
        """Which of some (sorted) shingles each set holds."""
        place = np.minimum(np.searchsorted(some, flat), len(some) - 1)
        hit = some[place] == flat
        out = np.zeros((len(cut) - 1, len(some)), np.float32)
        out[np.repeat(np.arange(len(cut) - 1), np.diff(cut))[hit], place[hit]] = 1
        return out

    def links(table):
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy()
        component = table.column("component").to_numpy()
        cq, cm = component[asks], component[~asks]
        (qf, qa), (mf, ma) = (sets(table.column("text").filter(pa.array(x))) for x in (asks, ~asks))
        both = np.intersect1d(qf, mf)
        shared = np.zeros((len(cq), len(cm)), np.float32)
        for lo in range(0, len(both), REST_COLUMNS):
            some = both[lo:lo + REST_COLUMNS]
            shared += grid(qf, qa, some) @ grid(mf, ma, some).T
        shared = shared.astype(np.int64)
        union = np.diff(qa)[:, None] + np.diff(ma)[None, :] - shared
        i, j = np.nonzero((100 * shared >= percent * union) & (cq[:, None] != cm[None, :]))
        ends = np.unique(np.stack([cq[i], cm[j]], 1), axis=0)              # components are nodes themselves
        return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})
    return rows.groupBy("meeting").applyInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = common.written(features(docs, width), "signatures")
    classes = ["n_shingles", "k1", "k2"]
    reps = common.written(signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*classes)
                          .agg(F.min(F.struct("doc_id", "signature")).alias("one")).select(*classes, "one.*"), "classes")
    every = common.written(signed.select("doc_id", *classes), "set-keys")
    common.forget(signed)
    pairs, crowded = forest(reps)
    pairs, crowded = common.written(pairs, "candidates"), common.written(crowded, "crowded-docs")
    asked = common.written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
                           .unionByName(crowded.select(F.col("doc").alias("doc_id"))).distinct(), "asked")
    # of rows that share an id, the least text stands for the document in comparisons
    texts = docs.join(broadcast_if_small(asked), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = common.written(texts, "candidate-texts")
    found = common.written(components(confirm(pairs, texts, width, percent)), "components")
    if not crowded.isEmpty():
        # links between components are few: they settle among themselves
        merged = components(rest(crowded, reps, texts, found, width, percent)).select(F.col("node").alias("component"), F.col("component").alias("into"))
        merged = common.written(merged, "merged")
        alone = merged.join(found.select("component"), "component", "left_anti").select(F.col("component").alias("node"), "into")
        found = (found.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
                 .unionByName(alone.select("node", F.col("into").alias("component"))))
    of_class = (reps.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
                .select(*classes, F.coalesce("component", "doc_id").alias("component_id")))
    rows = every.select("doc_id", *classes).join(of_class, classes, "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
