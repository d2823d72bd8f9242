"""SentencePiece (BPE model) encoding and decoding by vectorised merge rounds.

All distinct words of a batch stand as one flat array of symbols. A round takes the least pair rank per word
(one segmented minimum), merges its leftmost non-overlapping pairs in all words at once, and looks up only the
pairs that changed; words without a pair leave the array. Merging several pairs of one word in a round is exact
unless a merge makes a pair of the same or a better rank, whose turn would come first; such words merge their
leftmost pair only in that round.

Texts split into words where no piece of the vocabulary can reach across: before a run of blanks and at line
feeds. The vocabulary is read once on the driver and travels to the tasks with the function; a bounded memo of
words is kept per Python worker.

Defined cases: null and empty texts encode to the end id only (or nothing) and decode to the empty text; all
rows are kept as they are, repeated ones too."""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_OTHER = 1 << 18          # symbols from here on are characters without a piece of their own
_WIDE = 1 << 22
_NONE = np.int32(2 ** 31 - 1)
MEMO_WORDS = 300_000
MEMO_CHARS = 200          # longer words are encoded but not remembered


def _fields(raw: bytes):
    """(field number, value) of a protocol buffer message; nested messages stay bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value
    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at:at + size]
            at += size


class Vocabulary:
    """Pieces, ranks and settings of a ``.model`` file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or USER in self.kinds or trainer.get(24, 0):
            raise ValueError("only BPE models with the identity normalizer, kept blanks and no user symbols are handled")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown, self.begin, self.end = (self.kinds.index(UNKNOWN), trainer.get(41, 1), trainer.get(42, 2))


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        known = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] in (NORMAL, UNUSED)}
        text = "".join(known)
        reaches = any(BLANK in p.lstrip(BLANK) for p in known)
        if reaches:
            self._split = re.compile(r"(?s).+")
        elif "\n" in text:
            self._split = re.compile(r" *[^ ]+| +")
        else:
            self._split = re.compile(r" *[^ \n]+|\n| +")
        self._char = np.arange(_OTHER, _OTHER + 0x110000, dtype=np.int64)
        for p, i in known.items():
            if len(p) == 1:
                self._char[ord(p)] = i
        symbol = {c: int(self._char[ord(c)]) for c in set(text)} | known
        ranks = {s: r for r, s in enumerate(sorted({v.scores[i] for i in known.values()}, reverse=True))}
        pairs = {}
        for p, i in known.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * _WIDE + b] = (ranks[v.scores[i]], i)
        self._keys = np.array(sorted(pairs), np.int64)
        self._rank = np.array([pairs[k][0] for k in self._keys.tolist()] + [_NONE], np.int32)
        self._made = np.array([pairs[k][1] for k in self._keys.tolist()] + [0], np.int64)
        self._bytes = np.array([known_byte for known_byte, k in enumerate(v.kinds) if k == BYTE], np.int64)
        self._memo: dict[str, int] = {}
        self._flat, self._at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray):
        """Place of each pair in the tables; the last place is "no such pair"."""
        key = left * _WIDE + right
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == key, at, len(self._keys)) if len(self._keys) else np.full(len(key), 0)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the offset of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self._char[np.where(points == 32, ord(BLANK), points)]
        word = np.repeat(np.arange(len(words)), lengths)
        pair = self._pairs(sym, word, np.arange(len(sym)))
        done = []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(self._rank[pair], first)
            size = np.diff(np.r_[first, len(sym)])
            over = np.repeat(least == _NONE, size)
            if over.any():
                done.append((word[over], sym[over]))
                sym, word, pair = sym[~over], word[~over], pair[~over]
                keep = least != _NONE
                least, size = least[keep], size[keep]
                if not len(sym):
                    break
            rank = self._rank[pair]
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # every second one of a run of neighbours, from the left
            run = np.r_[True, (hit[1:] != hit[:-1] + 1)]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            hit = self._safe(sym, word, pair, hit)
            sym[hit] = self._made[pair[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[hit] = True
            before = hit - 1
            before = before[before >= 0]
            before = np.where(keep[before], before, before - 1)   # the left neighbour may just have merged
            changed[before] = True
            sym, word, pair, changed = sym[keep], word[keep], pair[keep], np.flatnonzero(changed[keep])
            pair[changed] = self._pairs(sym, word, changed)
        return self._ids(len(words), done)

    def _pairs(self, sym, word, at):
        """Table places of the pairs that begin at ``at``."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        out = self._look(sym[at], sym[nxt])
        out[(nxt == at) | (word[at] != word[nxt])] = len(self._keys)
        return out

    def _safe(self, sym, word, pair, hit):
        """Of words with several merges, keep all only if no merge makes a pair that would come before the others."""
        where = word[hit]
        several = np.r_[where[1:] == where[:-1], False]
        several[1:] |= several[:-1].copy()
        if not several.any():
            return hit
        at = hit[several]
        made, rank, own = self._made[pair[at]], self._rank[pair[at]], word[at]
        risky = np.zeros(len(at), bool)
        last = len(sym) - 1

        def sooner(left, right, valid):
            return valid & (self._rank[self._look(left, right)] <= rank)
        right, left = np.minimum(at + 2, last), np.maximum(at - 1, 0)
        has_right, has_left = (at + 2 <= last) & (word[right] == own), (at > 0) & (word[left] == own)
        risky |= sooner(made, sym[right], has_right) | sooner(sym[left], made, has_left)
        merged = np.zeros(len(sym) + 1, np.int64) - 1
        merged[hit] = self._made[pair[hit]]
        near = merged[np.maximum(at - 2, 0)]
        beside = has_left & (at >= 2) & (near >= 0) & (word[np.maximum(at - 2, 0)] == own)
        risky |= sooner(np.where(beside, near, 0), made, beside)
        if not risky.any():
            return hit
        bad = np.unique(own[risky])
        first = np.r_[True, where[1:] != where[:-1]]
        return hit[first | ~np.isin(where, bad)]

    def _ids(self, n_words: int, done) -> tuple[np.ndarray, np.ndarray]:
        if not done:
            return np.zeros(0, np.int32), np.zeros(n_words + 1, np.int64)
        word = np.concatenate([d[0] for d in done])
        sym = np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        word, sym = word[order], sym[order]
        other = np.flatnonzero(sym >= _OTHER)
        if len(other):
            if self.vocabulary.byte_fallback:
                raw = [chr(c).encode("utf-8", "surrogatepass") for c in (sym[other] - _OTHER).tolist()]
                width = np.ones(len(sym), np.int64)
                width[other] = [len(r) for r in raw]
                start = np.cumsum(width) - width
                word, sym = np.repeat(word, width), np.repeat(sym, width)
                spot = np.repeat(start[other], width[other])
                spot = spot + (np.arange(len(spot)) - np.repeat(np.cumsum(width[other]) - width[other], width[other]))
                sym[spot] = self._bytes[np.frombuffer(b"".join(raw), np.uint8)]
            else:
                sym[other] = self.vocabulary.unknown
        return sym.astype(np.int32), np.searchsorted(word, np.arange(n_words + 1))

    def encode(self, texts: list[str], add_end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the offset of each text."""
        words, counts = [], []
        prefix = " " if self.vocabulary.dummy_prefix else ""
        for t in texts:
            found = self._split.findall(prefix + t.replace(BLANK, " ")) if t else []
            counts.append(len(found))
            words += found
        if len(self._memo) > MEMO_WORDS:
            self._memo.clear()
            self._flat, self._at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        memo = self._memo
        new = [w for w in dict.fromkeys(words) if w not in memo]
        long = [w for w in new if len(w) > MEMO_CHARS]
        if new:
            base = len(self._at) - 1
            memo.update(zip(new, range(base, base + len(new))))
            flat, at = self.merge(new)
            self._at = np.concatenate([self._at, at[1:] + len(self._flat)])
            self._flat = np.concatenate([self._flat, flat])
        which = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        for w in long:
            del memo[w]
        size = self._at[which + 1] - self._at[which]
        total = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(total[-1]) + np.repeat(self._at[which] - total[:-1], size)
        ids = self._flat[take]
        offsets = total[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        if add_end:
            ids = np.insert(ids, offsets[1:], self.vocabulary.end)
            offsets = offsets + np.arange(len(offsets))
        return ids, offsets


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self._dummy = v.dummy_prefix
        self._raw = []
        for p, k in zip(v.pieces, v.kinds):
            if k == CONTROL:
                self._raw.append(b"")
            elif k == UNKNOWN:
                self._raw.append(" ⁇ ".encode())
            elif k == BYTE:
                self._raw.append(bytes([int(p[3:5], 16)]))
            else:
                self._raw.append(p.replace(BLANK, " ").encode())

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self._raw.__getitem__, ids))
        if self._dummy and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_HELD: dict = {}


def _tools(vocabulary: Vocabulary) -> tuple[Encoder, Decoder]:
    """One encoder and decoder per Python worker and vocabulary."""
    key = (len(vocabulary.pieces), hash(tuple(vocabulary.pieces[-1000:])))
    if key not in _HELD:
        _HELD[key] = (Encoder(vocabulary), Decoder(vocabulary))
    return _HELD[key]


def _parts(column: pa.Array, most: int = 1_000_000):
    """Lists of texts of about ``most`` characters, null as empty."""
    part, size = [], 0
    for value in column:
        text = value.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", add_end: bool = True) -> DataFrame:
    """(key, ids) of every text."""
    vocabulary = Vocabulary(model_path)

    def run(batches):
        encoder, _ = _tools(vocabulary)
        for batch in batches:
            done = 0
            for part in _parts(batch.column(1)):
                ids, offsets = encoder.encode(part, add_end)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(part)),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))], [key, "ids"])
                done += len(part)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, docs[text].cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) back from (key, ids)."""
    vocabulary = Vocabulary(model_path)

    def run(batches):
        _, decoder = _tools(vocabulary)
        for batch in batches:
            texts = [decoder.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])
    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip_digests(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, number of ids with the end id, digest of the ids, digest of the text decoded from them, and on
    request the ids."""
    vocabulary = Vocabulary(model_path)
    decimal = [str(i) for i in range(len(vocabulary.pieces))]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches):
        encoder, decoder = _tools(vocabulary)
        for batch in batches:
            done = 0
            for part in _parts(batch.column(1)):
                flat, offsets = encoder.encode(part)
                said, back = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    ids = flat[a:b].tolist()
                    said.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(decoder.decode(ids).encode("utf-8")).hexdigest())
                columns = [batch.column(0).slice(done, len(part)), pa.array(np.diff(offsets), pa.int64()),
                           pa.array(said, pa.string()), pa.array(back, pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)
                done += len(part)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
