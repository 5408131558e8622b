"""Substring dedup by sliding sentence spans.

Texts are read as sentences (those of less than SENTENCE words go with the one
before), and long ones are cut to pieces of PIECE words at most: of any PIECE
consecutive words, one begins a piece, the first word of a short sentence if there is
one, else that of the least hash (the last of equals).  So a passage keeps its inner
division wherever it is cut out or put in.  Every run of several consecutive
pieces is hashed: from each piece onward, and back from each, the shortest run of at
least RUN_WORDS words.  Runs that more than one document holds are joined globally,
and stretches of pieces that such runs cover go from all but the first: those of
PASSAGE words or more, and shorter ones, of LEAST_WORDS at least, of which a passage of
PASSAGE words around them stands in an earlier document too.  Every passage of so many
words that two documents share holds a stretch, and goes up to PIECE words (14 at its end).

Short stretches are confirmed on their own: the documents that hold one of their runs,
and only these, hash the windows of PASSAGE words about it, each once, and windows are
joined globally as runs are.

Run counts and first holders are pre-aggregated; occurrences of a hot run are
salted, and so are the texts of a hot row.  Told to all tasks are the hottest keys and
up to TOLD keys of short stretches' runs and of documents that hold them; more are joined.

Defined cases: null and blank texts have no pieces and stay; texts shorter than a
run have none, and those shorter than PASSAGE no short stretch that is confirmed; rows of one id are one document (of a null id, those of one text); a
run that recurs in one document only is no repeat (repeated lines and words are the
quality rules' matter), and its first holder keeps all its occurrences; first is the
least id, null before all (integer ids below -2^62 are taken for null), then the least
hash of the text; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.storage import drop

from .common import join_hot, materialize, pick

#: Least words of a run, most words of a piece, least words of a sentence, and least words in a row that are removed.
RUN_WORDS, PIECE, SENTENCE, LEAST_WORDS = 14, 12, 3, 25
#: Words of a passage that always holds LEAST_WORDS covered by runs.
PASSAGE = RUN_WORDS + 3 * PIECE + 1
#: Most keys of short stretches that are told to all tasks (8 or 16 bytes each).
TOLD = 1_000_000
#: Words read at a time, about; bits of a word's place among them, and of a run's words.
BATCH_WORDS, PLACE_BITS, LENGTH_BITS = 1 << 17, 24, 8
#: A word ends with white space or after the full-width full stop.
_STOP = b"\xe3\x80\x82"
_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+?(?:\xe3\x80\x82|(?=[ \t\n\x0b\x0c\r]|\Z))")
_ENDS = (b".", b"!", b"?", _STOP)
_MIX, _BASES = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0x2545F4914F6CDD1B), np.uint64(0xD1342543DE82EF93))


class _Hashes(dict):
    """Hash of a word; the lowest bit tells that it ends a sentence."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) & ~1 | word.endswith(_ENDS)
        return value


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_INTEGERS = ("tinyint", "smallint", "int", "bigint")
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)


class Words:
    """The words of some texts: their hashes, each text's first word among all of them, and the end, and the last words of lines."""

    def __init__(self, texts: list[bytes | None], hashes: _Hashes):
        words: list[bytes] = []
        line_ends, starts = self.line_ends, self.starts = [], [0]
        for text in texts:
            data = (text or b"").lower()
            if _STOP in data:
                data = data.replace(_STOP, _STOP + b" ")
            for line in data.split(b"\n"):
                words += line.split()
                line_ends.append(len(words))
            starts.append(len(words))
        n = self.n = len(words)
        self.hash = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)

    def digests_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """16 bytes for the words from each a to before b: two polynomials of the words' hashes, and their number."""
        out = np.empty((len(a), 2), np.uint64)
        h = self.hash
        for lane in (0, 1):
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(h * _powers(_BASES[lane], max(1, self.n))[: self.n], out=total[1:])
            x = (total[b] - total[a]) * _powers(_INVERSES[lane], self.n + 1)[a]
            x ^= (b - a).astype(np.uint64) * _MIX
            out[:, lane] = (x ^ (x >> np.uint64(32))) * _MIX
            h = (h ^ (h >> np.uint64(29))) * _MIX
            h ^= h >> np.uint64(32)
        return out


class Pieces(Words):
    """The pieces of some texts: `bounds` are the places of their first words among all words, and the end; `first` has each text's first piece, and the end."""

    def __init__(self, texts: list[bytes | None], hashes: _Hashes):
        super().__init__(texts, hashes)
        n, starts = self.n, self.starts
        sentence = np.zeros(n + 1, bool)
        sentence[1:] = self.hash & np.uint64(1)
        sentence[self.line_ends] = True
        sentence[starts] = True
        begins = sentence.copy()
        at = np.flatnonzero(sentence)
        begins[at[:-1][np.diff(at) < SENTENCE]] = False
        begins[starts] = True
        if n >= PIECE:
            part = np.cumsum(begins[:n])
            begins[self._least(sentence[:n])[part[: n - PIECE + 1] == part[PIECE - 1 :]]] = True
        self.bounds = np.flatnonzero(begins)
        self.first = np.searchsorted(self.bounds, starts)

    def _least(self, sentence: np.ndarray) -> np.ndarray:
        """Of each PIECE consecutive words, the place of that which begins a piece."""
        low = np.uint64((1 << PLACE_BITS) - 1)
        # the later of equals is less
        key = (self.hash >> np.uint64(1) & ~low) | (~sentence).astype(np.uint64) << np.uint64(63) | (low - np.arange(self.n, dtype=np.uint64))
        width = 1
        while width < PIECE:
            step = min(width, PIECE - width)
            key, width = np.minimum(key[:-step], key[step:]), width + step
        return (low - (key & low)).astype(np.int64)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(pieces a run starts with, pieces it ends before), distinct."""
        bounds, m = self.bounds, len(self.bounds) - 1
        if not m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        many = np.diff(self.first)
        own_first, own_end = np.repeat(self.first[:-1], many), np.repeat(self.first[1:], many)
        to = np.searchsorted(bounds, bounds[:-1] + RUN_WORDS)
        since = np.searchsorted(bounds, bounds[1:] - RUN_WORDS, "right") - 1
        onward, back = to <= own_end, since >= own_first
        at = np.arange(m)
        both = np.concatenate([at[onward] * (m + 1) + to[onward], since[back] * (m + 1) + at[back] + 1])
        both = np.unique(both)
        return both // (m + 1), both % (m + 1)

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """16 bytes for the words of each run of pieces."""
        return self.digests_of(self.bounds[start], self.bounds[end])


def _parts(texts: list) -> Iterator[slice]:
    """Slices of the texts with some BATCH_WORDS words each (one text at least)."""
    start = held = 0
    for i, t in enumerate(texts):
        size = len(t or b"") // 6 + 1
        if held and held + size > BATCH_WORDS:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(texts):
        yield slice(start, len(texts))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, own, h, at): each run's digest, its document and row, and its place: first word and number of words."""
    hashes = _Hashes()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for part in _parts(texts):
            pieces = Pieces(texts[part], hashes)
            start, end = pieces.runs()
            owner = np.searchsorted(pieces.first, start, "right") - 1
            digests = pieces.digests(start, end).view(np.int64)
            own, h = (batch.column(i).slice(part.start, part.stop - part.start).take(pa.array(owner)) for i in (0, 1))
            a, b = pieces.bounds[start], pieces.bounds[end]
            at = (a - pieces.bounds[pieces.first[owner]] << LENGTH_BITS) | (b - a)
            yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), own, h, pa.array(at)], names=["k1", "k2", "own", "h", "at"])


def _split(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words, ends) of places."""
    first = at >> LENGTH_BITS
    return first, first + (at & ((1 << LENGTH_BITS) - 1))


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words, ends) of the stretches that one or more places cover, in order."""
    first, end = _split(np.sort(at))
    end = np.maximum.accumulate(end)
    cut = np.flatnonzero(first[1:] > end[:-1])
    return first[np.concatenate([[0], cut + 1])], end[np.concatenate([cut, [-1]])]


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own, h, first, stop, keys) of rows with stretches that must be confirmed: their first words and ends, and the runs in them."""
    for batch in batches:
        spans = batch.column(2)
        edges, at, k1 = spans.offsets.to_numpy(), spans.values.field("at").to_numpy(), spans.values.field("k1").to_numpy()
        rows, firsts, stops, keys = [], [], [], []
        for i, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            first, stop = _stretches(at[x:y])
            short = (stop - first >= LEAST_WORDS) & (stop - first < PASSAGE)
            if short.any():
                first, stop, begin = first[short], stop[short], at[x:y] >> LENGTH_BITS
                k = np.searchsorted(first, begin, "right") - 1
                rows.append(i)
                firsts.append(first)
                stops.append(stop)
                keys.append(np.unique(k1[x:y][(k >= 0) & (begin < stop[k])]))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (firsts, stops, keys)]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)] + lists, names=["own", "h", "first", "stop", "keys"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, own, h, stretch): digests of the windows of PASSAGE words that hold one of the places, each once, and the short stretch each is about (its first word, or -1)."""
    hashes = _Hashes()
    for batch in batches:
        texts, ats, firsts, stops = (batch.column(c).to_pylist() for c in (2, 3, 4, 5))
        for part in _parts(texts):
            words = Words(texts[part], hashes)
            row, begin, about = [], [], []
            for i, low, high in zip(range(part.start, part.stop), words.starts, words.starts[1:], strict=False):
                last = high - low - PASSAGE
                if last < 0:
                    continue
                first, end = _split(np.array(ats[i], np.int64))
                change = np.zeros(last + 2, np.int64)
                np.add.at(change, np.maximum(end - PASSAGE, 0), 1)
                np.add.at(change, np.minimum(first, last) + 1, -1)
                at = np.flatnonzero(np.cumsum(change[: last + 1]))
                stretch = np.full(len(at), -1, np.int64)
                for a, b in zip(firsts[i] or [], stops[i] or [], strict=True):
                    stretch[np.searchsorted(at, a - PIECE) : np.searchsorted(at, b + PIECE + SENTENCE - PASSAGE, "right")] = a
                row.append(np.full(len(at), i))
                begin.append(at + low)
                about.append(stretch)
            if row:
                row, begin, about = (np.concatenate(x) for x in (row, begin, about))
                w1, w2 = words.digests_of(begin, begin + PASSAGE).view(np.int64).T
                order = np.lexsort((about, w2, w1, row))
                same = np.concatenate([[False], np.all([x[order[1:]] == x[order[:-1]] for x in (row, w1, w2, about)], axis=0)])
                keep = order[~same]
                own, h = (batch.column(c).take(pa.array(row[keep])) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(w1[keep]), pa.array(w2[keep]), own, h, pa.array(about[keep])], names=["w1", "w2", "own", "h", "stretch"])


def _taken(spans: list[dict], sure: list[int] | None, bounds: np.ndarray) -> tuple[np.ndarray, set]:
    """The pieces to remove, of those that begin at words `bounds` (with the end), and the first holders of what they repeat."""
    places = np.array([s["at"] for s in spans], np.int64)
    first, stop = _stretches(places)
    goes = (stop - first >= PASSAGE) | np.isin(first, np.array(sure or [], np.int64))
    gone = np.zeros(len(bounds) - 1, bool)
    for a, b in zip(np.searchsorted(bounds, first[goes]).tolist(), np.searchsorted(bounds, stop[goes]).tolist(), strict=True):
        gone[a:b] = True
    at = np.searchsorted(bounds, places >> LENGTH_BITS)
    return gone, {s["first_own"] for s, g in zip(spans, gone[at].tolist(), strict=True) if g}


def _without(text: bytes, bounds: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the pieces `gone`, each with the white space after it."""
    at = [m.start() for m in _WORD.finditer(text)]
    at.append(len(text))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    kept, last = [], 0
    for a, b in edges.reshape(-1, 2).tolist():
        kept.append(text[last : at[bounds[a]]])
        last = at[bounds[b]]
    return b"".join([*kept, text[last:]])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        kept, covered, sure = (batch.column(c).to_pylist() for c in (1, 2, 3))
        pieces_gone, words_gone, holders = [0] * len(kept), [0] * len(kept), [[] for _ in kept]
        hit = [i for i, spans in enumerate(covered) if spans]
        texts = [kept[i] for i in hit]
        for part in _parts(texts):
            pieces = Pieces(texts[part], hashes)
            for i, a, b in zip(hit[part], pieces.first[:-1].tolist(), pieces.first[1:].tolist(), strict=True):
                bounds = pieces.bounds[a : b + 1] - pieces.bounds[a]
                sizes = np.diff(bounds)
                gone, own = _taken(covered[i], sure[i], bounds)
                if gone.any():
                    pieces_gone[i], words_gone[i], holders[i] = int(gone.sum()), int(sizes[gone].sum()), list(own)
                    kept[i] = _without(kept[i], bounds, gone)
        kind = batch.schema.field("spans").type.value_type.field("first_own").type
        arrays = [batch.column(0), pa.array(pieces_gone, pa.int64()), pa.array(words_gone, pa.int64()), pa.array(holders, pa.list_(kind)), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_removed", "n_words_removed", "holders", "text"])


def _own(kind: str, text: Column) -> Column:
    """What tells documents apart, in the id's order: integers themselves, other ids by their text; null ids below all, by a hash of the text."""
    h = F.xxhash64(text)
    if kind in _INTEGERS:
        return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(h, 2) + F.lit(-(1 << 63)))
    return F.coalesce(F.concat(F.lit(b"\1"), F.col("doc_id").cast("string").cast("binary")), F.concat(F.lit(b"\0"), F.unhex(F.lpad(F.hex(h), 16, "0"))))


def _id_of(own: Column, kind: str) -> Column:
    if kind in _INTEGERS:
        return F.when(own >= -(1 << 62), own.cast(kind))
    return F.when(F.substring(own, 1, 1) == F.lit(b"\1"), F.substring(own, F.lit(2), F.length(own) - 1).cast("string").cast(kind))


def _confirmed(table: DataFrame, found: DataFrame, firsts: DataFrame, spans: DataFrame, total: int) -> DataFrame:
    """(own, h, sure) of rows with short stretches of which a passage about them is an earlier document's too: their first words."""
    kind = dict(found.dtypes)["own"]
    short = materialize(spans.select("own", "h", "spans").mapInArrow(_short, f"own {kind}, h bigint, first array<bigint>, stop array<bigint>, keys array<bigint>"))
    keys = materialize(short.select(F.explode("keys").alias("k1")).distinct())
    told = keys.count() <= TOLD
    if told:
        holds = found.join(F.broadcast(keys), "k1", "left_semi")
    else:
        # several runs may have one k1
        counts = firsts.groupBy("k1").agg(F.sum("n").alias("n")).join(keys, "k1")
        holds = join_hot(found.select("k1", "own", "h", "at"), counts, "k1", "n", "h", total)
    wanted = holds.groupBy("own", "h").agg(F.collect_set("at").alias("ats"))
    wanted = materialize(wanted.join(short.select("own", "h", "first", "stop"), ["own", "h"], "left"))
    texts = table.select("own", "h", "text")
    if wanted.count() <= TOLD:
        texts = texts.join(F.broadcast(wanted.select("own", "h")), ["own", "h"], "left_semi")
    # rows alike in id and text fold before the shuffle
    texts = texts.groupBy("own", "h").agg(F.first("text").alias("text")).join(wanted, ["own", "h"]).select("own", "h", "text", "ats", "first", "stop")
    windows = materialize(texts.mapInArrow(_windows, f"w1 bigint, w2 bigint, own {kind}, h bigint, stretch bigint"))
    seen = windows.groupBy("w1", "w2").agg(F.min("own").alias("first_own"), F.max("own").alias("last_own"), F.count("*").alias("n")).filter(F.col("first_own") != F.col("last_own"))
    seen = materialize(seen.select("w1", "w2", "first_own", "n"))
    later = join_hot(windows.filter("stretch >= 0"), seen, ("w1", "w2"), "n", "h", windows.count()).filter(F.col("own") != F.col("first_own"))
    return materialize(later.groupBy("own", "h").agg(F.collect_set("stretch").alias("sure")))


def span_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_removed (pieces), n_words_removed, repeats_of (ids of the first holders of the runs removed here, sorted), and the kept text."""
    plain = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    kind = dict(plain.dtypes)["doc_id"]
    id_text = F.col("doc_id").cast("string")
    table = plain.select("doc_id", _own(kind, F.col("text")).alias("own"), F.xxhash64("text", id_text).alias("h"), "text")
    own_kind = dict(table.dtypes)["own"]
    found = materialize(table.select("own", "h", "text").mapInArrow(_found, f"k1 bigint, k2 bigint, own {own_kind}, h bigint, at bigint"))
    # partial counts keep a hot run's rows where they are
    firsts = found.groupBy("k1", "k2").agg(F.min("own").alias("first_own"), F.max("own").alias("last_own"), F.count("*").alias("n")).filter(F.col("first_own") != F.col("last_own"))
    firsts = materialize(firsts.select("k1", "k2", "first_own", "n"))
    total = found.count()
    later = join_hot(found, firsts, ("k1", "k2"), "n", "h", total).filter(F.col("own") != F.col("first_own"))
    spans = later.groupBy("own", "h").agg(F.collect_set(F.struct("at", "first_own", "k1")).alias("spans"), F.count("*").alias("n"))
    # each of the rows alike has every span once
    spans = materialize(spans.withColumn("n", F.expr("n div size(spans)")))
    sure = _confirmed(table, found, firsts, spans, total)
    # what follows reads spans and texts only
    drop(found)
    spans = spans.withColumn("spans", F.transform("spans", lambda s: F.struct(s["at"].alias("at"), s["first_own"].alias("first_own")))).join(sure, ["own", "h"], "left")
    joined = join_hot(table.withColumn("place", F.monotonically_increasing_id()), spans, ("own", "h"), "n", "place", table.count(), "left")
    schema = f"doc_id {kind}, n_removed bigint, n_words_removed bigint, holders array<{own_kind}>, text binary"
    kept = joined.select("doc_id", "text", "spans", "sure").mapInArrow(_removed, schema)
    holders = F.array_sort(F.array_distinct(F.transform("holders", lambda own: _id_of(own, kind))))
    return kept.select("doc_id", "n_removed", "n_words_removed", holders.alias("repeats_of"), F.col("text").cast("string").alias("text"))


def op9_span_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_removed, n_words_removed, repeats_of, kept_sha256 for all documents."""
    kept = span_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_removed", "n_words_removed", "repeats_of", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
