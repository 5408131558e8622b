"""Benchmark decontamination by an FM-index per training shard.

A task cuts its documents into shards of bounded size, indexes each shard's words
(suffix order, Burrows-Wheeler transform in a wavelet matrix, sampled suffix
positions), searches all test phrases backwards at once through the matrix's
ranks, locates the occurrences from the samples, and merges them into removal
spans per document.  The test phrases go to the tasks, as arrays of word numbers in
blocks of bounded size, one at a time: nothing is shuffled with one block, and each
further block is another pass over the documents, whose spans are united per text.

Defined cases: null or wordless texts have no words and no hits; a document longer
than a shard is indexed in pieces that overlap by a phrase; rows with equal text
are indexed once per shard; null item ids are named "null", rows of one item id
pool their phrases; items without words never occur; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, materialize, pick

#: Words of a test phrase, words of a shard's index, distance of sampled suffixes, and bytes of test texts per block.
WINDOW, SHARD_WORDS, SAMPLE, BLOCK_BYTES = 10, 500_000, 16, 16 << 20
#: Parts of a hot text's rows where blocks' hits meet them.
SALTS = 16
#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of other characters, and blanks the rest.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; the last symbol must be unique, and so should each text's last."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length())
    per = max(1, 62 // bits)
    key = s.astype(np.int64)
    for i in range(1, min(per, n)):
        key <<= bits
        key[: n - i] |= s[i:]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[order] = group
    h = per
    alone = new & np.append(new[1:], True)
    open_at = np.flatnonzero(~alone)
    while len(open_at):
        suffix = order[open_at]
        base = rank[suffix]
        key = base * n + rank[np.minimum(suffix + h, n - 1)]
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[open_at] = suffix
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        rank[suffix] = open_at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        open_at = open_at[~(new & np.append(new[1:], True))]
        h *= 2
    return order


class WaveletMatrix:
    """Rank over a sequence of symbols, one prefix sum of bits per level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.sums, self.zeros = [], []
        rest = symbols.astype(np.uint32)
        for level in reversed(range(bits)):
            ones = (rest >> np.uint32(level)) & np.uint32(1)
            total = np.zeros(self.n + 1, np.int32)
            np.cumsum(ones, out=total[1:])
            self.sums.append(total)
            self.zeros.append(self.n - int(total[-1]))
            mask = ones.astype(bool)
            rest = np.concatenate([rest[~mask], rest[mask]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start, end = np.zeros_like(upto), upto
        for i, (total, zeros) in enumerate(zip(self.sums, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            s, e = total[start], total[end]
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start


class FMIndex:
    """Index of a shard: texts as arrays of symbols 1..sigma; each text ends in a terminator, which no phrase holds."""

    def __init__(self, texts: list[np.ndarray], sigma: int, sample: int = SAMPLE):
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        n = int(lengths.sum())
        flat = np.empty(n, np.int64)
        ends = self.starts + lengths - 1
        word = np.ones(n, bool)
        word[ends] = False
        if texts:
            flat[word] = np.concatenate(texts)
        flat[ends] = np.arange(len(texts))  # terminators differ, so that equal texts stop comparing at their ends
        flat[word] += len(texts) - 1
        order = suffix_order(flat)
        symbols = np.where(word, flat - (len(texts) - 1), 0)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))])
        self.bwt = symbols[order - 1].astype(np.int64)
        self.matrix = WaveletMatrix(self.bwt, max(1, int(sigma).bit_length()))
        marked = np.zeros(n, bool)
        marked[::sample] = True
        marked[self.starts] = True  # so that no step crosses a terminator
        sampled = marked[order]
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high) of the phrases (one per row) that occur, by backward search."""
        alive = np.arange(len(phrases))
        low, high = self.before[phrases[:, -1]], self.before[phrases[:, -1] + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
            c = phrases[alive, j]
            low, high = self.before[c] + self.matrix.rank(c, low), self.before[c] + self.matrix.rank(c, high)
        keep = low < high
        return alive[keep], low[keep], high[keep]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows of the suffix order: step back to a sampled one, and add the steps."""
        out = np.empty(len(rows), np.int64)
        todo, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.sampled[rows + 1] > self.sampled[rows]
            out[todo[hit]] = self.positions[self.sampled[rows[hit]]] + steps
            todo, rows, steps = todo[~hit], rows[~hit], steps + 1
            c = self.bwt[rows]
            rows = self.before[c] + self.matrix.rank(c, rows)
        return out


class Phrases:
    """Test phrases of items: the distinct windows as rows of word numbers, by length, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        names: dict[str, int] = defaultdict(count().__next__)
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, text in items:
            own = tokens(text)
            if own:
                codes = np.fromiter(map(vocabulary.__getitem__, own), np.int32, len(own))
                found.setdefault(min(window, len(own)), []).append((codes, names[name]))
        self.window, self.words, self.names = window, list(vocabulary), list(names)
        #: length: (windows, first item of each window among the items, items)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, texts in found.items():
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(codes, n) for codes, _ in texts])
            owner = np.repeat(np.array([i for _, i in texts], np.int64), [len(codes) - n + 1 for codes, _ in texts])
            phrases, which = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(which.reshape(-1) * len(names) + owner)
            at = np.searchsorted(pairs, np.arange(len(phrases) + 1) * len(names))
            self.by_length[n] = phrases, at, (pairs % len(names)).astype(np.int32)

    def coded(self, vocabulary: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, phrase numbers, symbols) of the phrases all of whose words the shard has."""
        table = np.fromiter((vocabulary.get(w, 0) for w in self.words), np.int64, len(self.words))
        for n, (phrases, *_) in self.by_length.items():
            at = np.arange(len(phrases))
            for j in range(n):
                at = at[table[phrases[at, j]] > 0]
            if len(at):
                yield n, at, table[phrases[at]]

    def items(self, n: int, phrase: int) -> list[str]:
        _, at, owners = self.by_length[n]
        return [self.names[i] for i in owners[at[phrase] : at[phrase + 1]].tolist()]


def _hits(texts: list[list[bytes]], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """Per text of a shard, the merged (start, end) word spans of its hits and the items they belong to."""
    vocabulary: dict[bytes, int] = defaultdict(count(1).__next__)
    codes = [np.fromiter(map(vocabulary.__getitem__, own), np.int64, len(own)) for own in texts]
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    wanted = list(phrases.coded(vocabulary))
    if not wanted:
        return out
    index = FMIndex(codes, len(vocabulary))
    change = np.zeros(index.n + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for n, numbers, symbols in wanted:
        which, low, high = index.search(symbols)
        many = high - low
        if not len(which):
            continue
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        at = index.locate(rows)
        np.add.at(change, at, 1)
        np.add.at(change, at + n, -1)
        pairs = np.unique(np.stack([np.searchsorted(index.starts, at, "right") - 1, np.repeat(numbers[which], many)], axis=1), axis=0)
        for text, phrase in pairs.tolist():
            items[text].update(phrases.items(n, phrase))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8)])))
    for a, b in edges.reshape(-1, 2).tolist():
        text = int(np.searchsorted(index.starts, a, "right") - 1)
        base = int(index.starts[text])
        out[text][0].append((a - base, b - base))
    return [(spans, sorted(names)) for (spans, _), names in zip(out, items, strict=True)]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(texts: list[bytes], phrases: Phrases, shard_words: int = SHARD_WORDS) -> Iterator[tuple[int, int, list, list]]:
    """(number, words, spans, items) of each text, in order, shard by shard."""
    pieces: list[tuple[int, int, list[bytes]]] = []
    held = 0
    done: dict[int, list] = {}
    lengths: dict[int, int] = {}
    step = max(shard_words, 2 * phrases.window)

    def flush() -> None:
        nonlocal held
        for (text, at, _), (spans, names) in zip(pieces, _hits([p[2] for p in pieces], phrases), strict=True):
            had = done.setdefault(text, [[], set()])
            had[0] += [(a + at, b + at) for a, b in spans]
            had[1].update(names)
        pieces.clear()
        held = 0

    for number, text in enumerate(texts):
        own = tokens(text)
        lengths[number] = len(own)
        for at in range(0, max(1, len(own)), step):
            piece = own[at : at + step + phrases.window - 1]
            if piece:
                if held and held + len(piece) > shard_words:
                    flush()
                pieces.append((number, at, piece))
                held += len(piece)
    flush()
    for number, n in lengths.items():
        spans, names = done.get(number, ([], ()))
        yield number, n, _union(spans), sorted(names)


def _scanned(phrases, shard_words: int, remove: bool = False):
    """Rows of the same text within a shard's worth of input are searched once; with `remove`, hits go from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            unique: dict[bytes, int] = {}
            numbers = [unique.setdefault(t, len(unique)) for b in held for t in b.column(1).to_pylist()]
            found = list(scan(list(unique), phrases.value, shard_words))
            i = 0
            for b in held:
                own = [found[k] for k in numbers[i : i + b.num_rows]]
                i += b.num_rows
                spans = pa.array([[{"start": x, "end": y} for x, y in f[2]] for f in own], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                texts = b.column(1)
                if remove:
                    texts = pa.array([_without(t, s) if (s := f[2]) else t for t, f in zip(texts.to_pylist(), own, strict=True)], pa.binary())
                arrays = [b.column(0), texts, pa.array([f[1] for f in own], pa.int64()), spans, pa.array([f[3] for f in own], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["carried", "text", "n_words", "spans", "items"])
            held.clear()

        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size > 8 * shard_words:
                yield from out()
                size = 0
        if held:
            yield from out()

    return run


def _block(items: DataFrame, i: int, n: int) -> list[tuple[str, bytes]]:
    """Block i of n of the items."""
    own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else items
    return [(r["item"], bytes(r["text"])) for r in own.collect()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
    carry: Sequence[str] = (),
    remove: bool = False,
) -> DataFrame:
    """Per row of docs: doc_id, text, n_words, spans (merged word ranges [start, end) to remove), items (names, sorted), `carry` as c_0, c_1 and so on.

    With `remove`, the text comes without its hits.
    """
    plain = pick(docs, doc_id=id_col, text=text_col, **carried(carry))
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = plain.select(F.struct("doc_id", *carried(carry)).alias("carried"), text.alias("text"))
    items = pick(benchmark, item_col, item_text_col).select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).cast("binary").alias("text")
    )
    sc = docs.sparkSession.sparkContext
    inner = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in rows.schema["carried"].dataType.fields)
    schema = f"carried struct<{inner}>, text binary, n_words bigint, spans array<struct<start: int, end: int>>, items array<string>"
    n_blocks = -(-(items.agg(F.sum(F.length("text") + 64)).first()[0] or 0) // block_bytes)
    if n_blocks <= 1:
        found = rows.mapInArrow(_scanned(sc.broadcast(Phrases(_block(items, 0, 1), window)), shard_words, remove), schema)
    else:
        # each block is a pass, one after the other; its hits alone are kept, and meet the rows by a digest of their content
        key = F.unhex(F.md5(F.col("text")))
        hits: DataFrame | None = None
        for i in range(n_blocks):
            block = sc.broadcast(Phrases(_block(items, i, n_blocks), window))
            part = rows.select("carried", "text").mapInArrow(_scanned(block, shard_words), schema).filter(F.size("spans") > 0)
            part = materialize(part.select(key.alias("key"), "spans", "items").distinct())
            block.destroy()
            hits = part if hits is None else hits.unionByName(part)
        hits = hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merged = F.expr(
            "aggregate(array_sort(spans), cast(array() as array<struct<start: int, end: int>>), (a, x) -> if(size(a) > 0 and x.start <= element_at(a, -1).end,"
            " concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))), concat(a, array(x))))"
        )
        # any text may be on many rows, so all rows are dealt over salts
        hits = materialize(hits.select("key", merged.alias("spans"), "items")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        counted = rows.mapInArrow(_scanned(sc.broadcast(Phrases([], window)), shard_words), schema)
        dealt = counted.select("carried", "text", "n_words", key.alias("key"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
        found = dealt.join(hits, ["key", "salt"], "left").select(
            "carried", "text", "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<start: int, end: int>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
        )
    found = found.select("carried.*", F.col("text").cast("string").alias("text"), "n_words", "spans", "items")
    return cleaned(found) if remove and n_blocks > 1 else found


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(data)]
    kept, last = [], 0
    for start, end in spans:
        kept.append(data[last : at[start][0]])
        last = at[end - 1][1]
    return b"".join([*kept, data[last:]])


def cleaned(found: DataFrame) -> DataFrame:
    """find_contamination's rows, hits removed from their texts."""

    def run(batches):
        for batch in batches:
            i, j = batch.schema.get_field_index("text"), batch.schema.get_field_index("spans")
            texts = [_without(t.encode(), [(x["start"], x["end"]) for x in s]).decode() if s else t for t, s in zip(batch.column(i).to_pylist(), batch.column(j).to_pylist(), strict=True)]
            yield batch.set_column(i, "text", pa.array(texts, pa.string()))

    return found.mapInArrow(run, found.schema)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for all documents against all items."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.expr("cast(aggregate(spans, 0L, (a, s) -> a + s.end - s.start) as bigint)")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.n, g.i, p.item FROM grams g JOIN p ON g.n = p.n AND g.s = p.s),
places AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(l.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.s, '')) AS items_sha256, coalesce(l.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places l USING (doc_id) LEFT JOIN names n USING (doc_id)
"""
