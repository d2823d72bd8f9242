"""Removal of repeated byte strings by a sparse, range-partitioned suffix order.

A byte goes if a string of LENGTH bytes covers it that also starts earlier in the corpus. Suffixes are sampled by
content: each LENGTH-byte window has one anchor, the place in it whose GRAM-byte string hashes least, so equal windows have
equal anchors wherever they stand, and about one place in 26 is an anchor of some windows.

1. Anchors are counted by the hash of their gram; only grams that occur again go on.
2. The documents that have such anchors give the anchored suffixes with the bytes of their windows. What a batch already
   repeats is decided there, so of many copies one suffix per batch goes on.
3. Sampled splitters range-partition the suffixes by their leading bytes. A bucket sorts its suffixes by multikey
   quicksort on 8-byte words, compares neighbours, and decides each window of the suffixes that agree with a neighbour:
   all but the first (by document, then place) are repeats. Splitters are whole leading grams, so no pair of equal
   windows is cut apart by a boundary.
   Grams in more than ``hot`` places go by single windows instead: an aggregate finds the first place of each
   window, a join Spark may split tells the others.
4. Marked spans meet their documents once more and are cut out.

Defined cases: null texts are empty; texts shorter than LENGTH are never cut; order within equal ids is by the hash of
the text; rows that are equal in id and text are one document and each get its result."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportkb.llm import common

LENGTH, GRAM = 100, 50
HOT = 20_000
BUCKET_ROWS = 50_000
PIECE = 1 << 21
STEP = 1 << 18      # windows whose anchors are found at a time: their columns of 8 bytes, not the texts, fill a worker
_AT_BITS = np.uint64(24)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by running minima within blocks from both sides."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, step: int = STEP):
    """Runs of neighbouring windows with one anchor: row, anchor, first and last window start (places in ``data``),
    hash of the anchor's gram. Inputs are walked in steps; a window lies in one step as a whole, and a run that crosses steps is
    two runs of one anchor."""
    out = []
    prefix = common.prefix_hash(data)
    for lo in range(0, max(len(data) - length + 1, 0), step):
        n = min(step, len(data) - length + 1 - lo)
        places = np.arange(lo, lo + n + length - gram)
        hashed = common.span_hash(prefix, places, places + gram)
        low_bits = (np.uint64(1) << _AT_BITS) - np.uint64(1)
        ranked = (hashed & ~low_bits) | (places - lo).astype(np.uint64)
        anchor = (_sliding_least(ranked, length - gram + 1) & low_bits).astype(np.int64)
        start = places[:n]
        row = np.searchsorted(offsets, start, "right") - 1
        valid = start + length <= offsets[row + 1]
        change = np.ones(n, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (row[1:] != row[:-1])
        first = np.flatnonzero(change & valid)
        ends = np.ones(n, bool)
        ends[:-1] = change[1:] | ~valid[1:]
        last = np.flatnonzero(ends & valid)
        out.append((row[first], anchor[first] + lo, start[first], start[last], hashed[anchor[first]]))
    if not out:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    return [np.concatenate(x) for x in zip(*out)]


def _ids(documents: DataFrame) -> DataFrame:
    text = common.as_text(F.col("text"))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = common.column_bytes(batch.column(2))
            for a, b in common.pieces(data, offsets, PIECE):
                cut = offsets[a:b + 1] - offsets[a]
                row, anchor, _, _, gram = anchored_runs(data[offsets[a]:offsets[b]], cut)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), batch.column(0).slice(a, b - a).take(take), batch.column(1).slice(a, b - a).take(take),
                     pa.array((anchor - cut[row]).astype(np.int32))], ["gram", "doc_id", "th", "at"])
    return docs.mapInArrow(run, "gram long, doc_id long, th long, at int")


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    flat = data[np.repeat(start, size) + common.sequences(size)]
    return pa.Array.from_buffers(pa.binary(), len(start), [
        None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(flat)])


#: kind 0: an anchored suffix with its windows' bytes; 1: a span that is decided; 2: one window of a hot gram
_SUFFIX = "kind int, lead long, doc_id long, th long, at int, begin int, end int, bytes binary"


def _suffix_rows(docs: DataFrame) -> DataFrame:
    """docs: doc_id, th, text, at (places of repeated anchors), hot (those of hot grams)."""
    def run(batches):
        for batch in batches:
            data, offsets = common.column_bytes(batch.column(2))
            ids, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in common.pieces(data, offsets, PIECE):
                part, cut = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                row, anchor, first, last, gram = anchored_runs(part, cut)
                wide = np.int64(1) << np.int64(34)

                def marked(column):
                    lists = batch.column(column).slice(a, b - a)
                    owner = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
                    return np.isin(row * wide + anchor - cut[row], owner * wide + lists.flatten().to_numpy())
                use = marked(3)
                hot = marked(4)[use]
                row, anchor, first, last, gram = row[use], anchor[use], first[use], last[use], gram[use]
                prefix = common.prefix_hash(part)
                doc, th = ids[a:b][row], ths[a:b][row]
                base = cut[row]
                # one suffix of each content; what follows it in this piece is decided
                whole = common.span_hash(prefix, first, last + LENGTH) ^ common.mix((anchor - first).astype(np.uint64))
                later, again = _later(whole, doc, th, first - base)
                kept = ~hot & ~later & ~again
                done = ~hot & later & ~again
                n_win = (last - first + 1)[hot]
                which = np.repeat(np.flatnonzero(hot), n_win)
                start = first[which] + common.sequences(n_win)
                window = common.span_hash(prefix, start, start + LENGTH)
                w_later, w_again = _later(window, doc[which], th[which], start - base[which])
                w_keep, w_done = ~w_later & ~w_again, w_later & ~w_again

                def rows(kind, lead, i, begin, end, raw):
                    n = len(i)
                    return pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, kind, np.int32)), pa.array(lead.view(np.int64)), pa.array(doc[i]), pa.array(th[i]),
                         pa.array((anchor[i] - base[i]).astype(np.int32)), pa.array((begin - base[i]).astype(np.int32)),
                         pa.array((end - base[i]).astype(np.int32)), raw],
                        ["kind", "lead", "doc_id", "th", "at", "begin", "end", "bytes"])
                k, d = np.flatnonzero(kept), np.flatnonzero(done)
                wk = which[w_keep]
                # neighbouring windows that are decided go on as one span
                da, dz = _runs(w_done, which)
                none = (lambda n: pa.array([b""] * n, pa.binary()))
                yield rows(0, gram[k], k, first[k], last[k] + LENGTH, _cut(part, first[k], last[k] + LENGTH))
                yield rows(1, gram[d], d, first[d], last[d] + LENGTH, none(len(d)))
                yield rows(2, window[w_keep], wk, start[w_keep], start[w_keep] + LENGTH, none(len(wk)))
                yield rows(1, window[da], which[da], start[da], start[dz] + LENGTH, none(len(da)))
    return docs.select("doc_id", "th", "text", "at", "hot").mapInArrow(run, _SUFFIX)


def _runs(marked: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of marked windows of one owner; the windows of an owner stand in order."""
    edge = np.ones(len(marked) + 1, bool)
    edge[1:-1] = owner[1:] != owner[:-1]
    before, after = np.r_[False, marked[:-1]], np.r_[marked[1:], False]
    return np.flatnonzero(marked & (edge[:-1] | ~before)), np.flatnonzero(marked & (edge[1:] | ~after))


def _later(content, doc, th, place):
    """Per row: does an equal content stand earlier; is it the very same place again (a repeated row)."""
    order = np.lexsort((place, th, doc, content))
    c, d, t, p = content[order], doc[order], th[order], place[order]
    equal = np.zeros(len(c), bool)
    equal[1:] = c[1:] == c[:-1]
    same = np.zeros(len(c), bool)
    same[1:] = equal[1:] & (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (p[1:] == p[:-1])
    later, again = np.zeros(len(c), bool), np.zeros(len(c), bool)
    later[order], again[order] = equal, same
    return later, again


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of words, and per place in it whether the row agrees with the one before in all words.
    Each level sorts only the rows that are still tied, within their ties."""
    n = len(words)
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.zeros(n, bool)
    tied[1:] = words[order[1:], 0] == words[order[:-1], 0]
    for level in range(1, words.shape[1]):
        group = np.cumsum(~tied)
        open_places = np.flatnonzero(tied | np.r_[tied[1:], False])
        if not len(open_places):
            break
        rows = order[open_places]
        key = words[rows, level]
        inner = np.lexsort((key, group[open_places]))
        order[open_places] = rows[inner]
        key = key[inner]
        equal = np.zeros(len(key), bool)
        equal[1:] = key[1:] == key[:-1]
        tied[open_places] &= equal
    return order, tied


def _decided(suffixes: DataFrame) -> DataFrame:
    """Spans (doc_id, th, begin, end) that repeat, of suffixes partitioned by their leading bytes."""
    words = -(-GRAM // 8)

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        doc, th, at, begin = (t.column(c).to_numpy() for c in ("doc_id", "th", "at", "begin"))
        data, offsets = common.column_bytes(t.column("bytes"))
        lead = offsets[:-1] + (at - begin)
        padded = np.zeros((len(doc), words * 8), np.uint8)
        padded[:, :GRAM] = data[lead[:, None] + np.arange(GRAM)]
        order, tied = multikey_order(padded.view(">u8").astype(np.uint64))
        alive = order[tied | np.r_[tied[1:], False]]
        alive = alive[np.lexsort((begin[alive], th[alive], doc[alive]))]
        n_win = (np.diff(offsets) - LENGTH + 1)[alive]
        which = np.repeat(alive, n_win)
        start = offsets[which] + common.sequences(n_win)
        window = common.span_hash(common.prefix_hash(data), start, start + LENGTH)
        by = np.argsort(window, kind="stable")       # windows stand by document and place already
        equal = np.zeros(len(by), bool)
        equal[1:] = window[by[1:]] == window[by[:-1]]
        first = by[np.maximum.accumulate(np.where(equal, 0, np.arange(len(by))))] if len(by) else by
        place = begin[which] + (start - offsets[which])
        same = (doc[which[by]] == doc[which[first]]) & (th[which[by]] == th[which[first]]) & (place[by] == place[first])
        repeat = np.zeros(len(by), bool)
        repeat[by] = equal & ~same
        a, z = _runs(repeat, which)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[which[a]]), pa.array(th[which[a]]), pa.array(place[a].astype(np.int32)),
             pa.array((place[z] + LENGTH).astype(np.int32))], ["doc_id", "th", "begin", "end"])
    return suffixes.mapInArrow(run, "doc_id long, th long, begin int, end int")


def repeated_spans(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, th, spans) of the documents that have repeated bytes; spans are (begin, end), not yet merged."""
    docs = _ids(documents)
    anchors = common.written(_anchor_rows(docs), "anchors")
    # written first, so that the join has plain exchanges on both sides and Spark may split a hot gram
    often = common.written(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-grams")
    hits = (anchors.join(often, "gram").groupBy("doc_id", "th")
            .agg(F.collect_set("at").alias("at"), F.collect_set(F.when(F.col("n") > hot, F.col("at"))).alias("hot")))
    hits = common.written(hits, "repeated-anchors")
    common.forget(anchors)
    common.forget(often)
    keys = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    asked = keys.join(hits.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "th", "at", "hot"), ["key", "th"])
    suffixes = common.written(_suffix_rows(asked.withColumn("doc_id", F.col("key"))), "suffixes")
    plain = suffixes.filter("kind = 0")
    buckets = max(1, -(-plain.count() // BUCKET_ROWS))
    # splitters are whole grams: equal leading bytes stay in one bucket
    parted = plain.repartitionByRange(buckets, F.expr(f"substring(bytes, at - begin + 1, {GRAM})"))
    spans = _decided(parted).unionByName(suffixes.filter("kind = 1").select("doc_id", "th", "begin", "end"))
    windows = suffixes.filter("kind = 2").select("lead", "doc_id", "th", "begin", "end")
    firsts = common.written(windows.groupBy("lead").agg(F.min(F.struct("doc_id", "th", "begin")).alias("one")), "first-windows")
    spans = spans.unionByName(windows.join(firsts, "lead").filter(F.struct("doc_id", "th", "begin") != F.col("one"))
                              .select("doc_id", "th", "begin", "end"))
    spans = spans.groupBy(F.col("doc_id").alias("key"), "th").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    spans = common.written(spans, "spans")
    common.forget(suffixes)
    return spans


def _merge(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of sorted spans."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.r_[first[1:] - 1, len(spans) - 1]]], 1)


def _cut_rows(documents: DataFrame, hot: int, row, finish, schema: T.StructType) -> DataFrame:
    """Meet each document with its spans; ``finish(carried, raw, cuts)`` makes one output batch of lists. ``row`` is what is
    carried along."""
    docs = documents.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), common.as_text(F.col("text")).alias("text"))
    docs = docs.withColumns({"th": F.xxhash64("text"), "key": F.coalesce("doc_id", F.lit(-(1 << 63)))})
    spans = repeated_spans(documents, hot)
    joined = docs.join(spans, ["key", "th"], "left").select("row", "text", "spans")

    def run(batches):
        for batch in batches:
            raws, cuts = [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                pairs = spans.as_py() or []
                raws.append(text.as_buffer().to_pybytes())
                cuts.append(_merge(np.array([(p["begin"], p["end"]) for p in pairs], np.int64)) if pairs else np.zeros((0, 2), np.int64))
            yield finish(batch.column(0), raws, cuts)
    return joined.mapInArrow(run, schema)


def _left(raw: bytes, cuts: np.ndarray) -> bytes:
    edges = [0, *cuts.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def removed(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                           T.StructField("kept_sha256", T.StringType())])

    def finish(ids, raws, cuts):
        left = [_left(r, c) for r, c in zip(raws, cuts)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(map(len, raws), pa.int64()), pa.array([len(r) - len(x) for r, x in zip(raws, left)], pa.int64()),
             pa.array(map(len, cuts), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())],
            schema.fieldNames())
    return _cut_rows(documents, hot, F.col("doc_id").cast("long"), finish, schema)


def without_repeats(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """The documents with what is left of their texts; all columns stay. A character that was cut in part goes as a whole."""
    others = [c for c in documents.columns if c != "text"]
    carried = F.struct(*[F.col(f"`{c}`") for c in others])
    schema = T.StructType([T.StructField("row", T.StructType([documents.schema[c] for c in others])),
                           T.StructField("left_text", T.StringType())])

    def finish(rows, raws, cuts):
        left = [_left(r, c).decode("utf-8", "ignore") for r, c in zip(raws, cuts)]
        return pa.RecordBatch.from_arrays([rows, pa.array(left, pa.string())], ["row", "left_text"])
    out = _cut_rows(documents, hot, carried, finish, schema)
    return out.select(*[F.col("left_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns])
