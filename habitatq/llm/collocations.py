"""Phrase collocations by weighted acyclic automata.

Per language: phrases of 2 to 5 words that occur ``min_count`` times or more inside pieces of text, scored by the
lowest of 1000 * f(phrase) * n / (f(first part) * f(rest)) over its cuts, without those that a longer candidate
holds whenever they occur. A word of a language is a 64-bit label.

1. ``pair_shares``: one pass counts pairs of words in 2**14 slots, which tells how many prefix ranges there should
   be and which pairs are hot.
2. ``shards``: each word with up to four more that follow in its piece is a path of labels. The sorted, counted paths
   of a shard are cut by prefix range and front-coded, and so are its words with their names: no rare word or pair is
   left out, so the work is in proportion to the text at any size.
3. ``ngrams``: the transducers of all shards are united range by range, weights summed, so the arc of a prefix carries
   its count; arcs with ``min_count`` are kept, and so are words.
4. ``parts``: prefix ranges of the kept paths become transducers once more, and the first parts and rests of all
   candidates, brought to the same ranges, are composed with these.

A prefix is two words, so a frequent word is spread over many ranges. Pairs whose slot has eight times its
share go by four words, and the counts of their first two and three words are summed over ranges.

Defined cases: a null text is empty, a null lang is ``und``; a language without a candidate has no row; repeated
rows count each time; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from habitatq.llm import words as W
from habitatq.llm.transducer import Transducer, levels, summed
from habitatq.sources.tables import stored

MIN_COUNT, LONGEST, TOP, SHARE = 100, 5, 2000, 100
PAIR_SLOTS, HOT = 1 << 14, 8
#: Words of a shard; paths of a range, on average; rows of a block in which parts are looked up.
SHARD_WORDS, RANGE_PATHS, _BLOCK = 1 << 21, 500_000, 1 << 18
_U = np.uint64
#: A piece ends at any of . , ; : ! ? and \n \v \f \r; words are divided by blanks and tabs too.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
_PATH = [f"w{i}" for i in range(1, LONGEST + 1)]
_PATHS = ", ".join(f"{w} long" for w in _PATH)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


class _Slice:
    """Labels of the words of a slice, the language of each, and whether it goes on with the word before."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = w = W.words_of(batch.column("text"), _WORD, lower=True)
        coded = batch.column("lang").dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        langs = np.array([xxh64_intdigest(n.encode()) for n in self.names], _U)
        self.code = coded.indices.to_numpy()[w.owner()]
        label = W.mix(w.hashes() ^ langs[self.code])
        self.label = np.minimum(np.maximum(label, _U(1)), _U(2**64 - 2))  # 0 and -1 are no labels
        self.goes_on = np.zeros(len(label), bool)
        if len(label) > 1:
            ends = np.concatenate([[0], np.cumsum(_ENDS[w.data], dtype=np.int32)])
            self.goes_on[1:] = ends[w.start[1:]] == ends[w.end[:-1]]
            first = w.ptr[:-1]
            self.goes_on[first[first < len(label)]] = False


def _pair_slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of each pair; its last bits are the slot, its first bits the range."""
    return W.mix(first * _U(0x9E3779B97F4A7C15) + second)


def pair_shares(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Slots of hot pairs, and the number of all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(PAIR_SLOTS, np.int64)
        for b in W.slices(batches):
            s = _Slice(b)
            at = np.flatnonzero(s.goes_on)
            slot = (_pair_slots(s.label[at - 1], s.label[at]) & _U(PAIR_SLOTS - 1)).astype(np.int64)
            pairs += np.bincount(slot, minlength=PAIR_SLOTS)
        slot = np.flatnonzero(pairs)
        yield pa.record_batch([pa.array(slot), pa.array(pairs[slot])], names=["slot", "n"])

    slots = _rows(docs).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # 16,384 rows at most
    pairs = sum(r.n for r in slots)
    return np.array([r.slot for r in slots if r.n * PAIR_SLOTS > HOT * pairs], np.int64), pairs


def _coded(paths: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted paths, each as what it does not share with the one before."""
    length = (paths != 0).sum(axis=1)
    shared = np.zeros(len(paths), np.int64)
    shared[1:] = np.minimum(np.logical_and.accumulate(paths[1:] == paths[:-1], axis=1).sum(axis=1), length[1:])
    column = np.arange(LONGEST)
    new = (column >= shared[:, None]) & (column < length[:, None])
    wide = np.uint8 if counts.max() < 256 else np.uint32
    head = np.array([len(paths), np.dtype(wide).itemsize], np.int64)
    return b"".join(x.tobytes() for x in (head, (shared * 8 + length).astype(np.uint8), counts.astype(wide), paths[new]))


def _decoded(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide = np.frombuffer(blob, np.int64, 2).tolist()
    form = np.frombuffer(blob, np.uint8, n, 16)
    counts = np.frombuffer(blob, np.uint8 if wide == 1 else np.uint32, n, 16 + n).astype(np.int64)
    column, length = np.arange(LONGEST), form[:, None] & 7
    new = (column >= form[:, None] >> 3) & (column < length)
    paths = np.zeros((n, LONGEST), _U)
    paths[new] = np.frombuffer(blob[16 + n + wide * n :], _U)
    source = np.maximum.accumulate(np.where(new, np.arange(n)[:, None], 0), axis=0)
    return np.where(column < length, paths[source, column], _U(0)), counts


def _ranged(key: np.ndarray, ranges: int) -> np.ndarray:
    return ((key >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


def _shard_paths(label: np.ndarray, goes_on: np.ndarray, hot: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """(range, coded paths of two words or more) of a run of words."""
    known, number = np.unique(label, return_inverse=True)
    labels, number = np.concatenate([np.zeros(1, _U), known]), (number + 1).astype(np.int32)
    joined = np.append(goes_on[1:], False)  # whether a word and the next are of one piece
    at = np.flatnonzero(joined)
    paths = np.zeros((len(at), LONGEST), np.int32)
    paths[:, 0], live = number[at], np.arange(len(at))
    for d in range(1, LONGEST):
        live = live[joined[at[live] + d - 1]]
        paths[live, d] = number[at[live] + d]
    del number, joined, at, live
    bits = len(labels).bit_length()
    wide = lambda *columns: sum(paths[:, c].astype(np.int64) << bits * (len(columns) - 1 - k) for k, c in enumerate(columns))
    keys = [wide(0, 1, 2), wide(3, 4)] if 3 * bits < 64 else [wide(0, 1), wide(2, 3), wide(4)]
    order = np.lexsort(keys[::-1])
    first = np.flatnonzero(_changes(keys, order))
    counts = np.diff(np.append(first, len(order)))
    paths = paths[order[first]]
    del keys, order
    key = _pair_slots(labels[paths[:, 0]], labels[paths[:, 1]])
    split = np.isin((key & _U(PAIR_SLOTS - 1)).astype(np.int64), hot)
    key[split] = W.mix(key[split] + labels[paths[split, 2]] * _U(0xD6E8FEB86659FD93) + labels[paths[split, 3]] * _U(0xA0761D6478BD642F))
    place = _ranged(key, ranges)
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[r] : cuts[r + 1]]
        yield int(r), _coded(labels[paths[own]], counts[own])


def _changes(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Whether each row, in order, differs from the one before."""
    fresh = np.ones(len(order), bool)
    fresh[1:] = False
    for key in keys:
        key = key[order]
        fresh[1:] |= key[1:] != key[:-1]
    return fresh


_WORDS = pa.schema([("label", pa.int64()), ("n", pa.int64()), ("lang", pa.dictionary(pa.int32(), pa.string())), ("name", pa.string())])


def _shard_words(slices: list[pa.RecordBatch], ranges: int) -> Iterator[tuple[int, bytes]]:
    """(range, words with their counts) of a shard, as an Arrow stream."""
    table = pa.Table.from_batches(slices, _WORDS).unify_dictionaries().combine_chunks()
    label = table.column("label").to_numpy().view(_U)
    known, first, which = np.unique(label, return_index=True, return_inverse=True)
    n = np.bincount(which, weights=table.column("n").to_numpy(), minlength=len(known)).astype(np.int64)
    table = table.take(pa.array(first)).set_column(1, "n", pa.array(n))
    place = _ranged(known, ranges)  # known is in order, so ranges are runs
    cuts = np.searchsorted(place, np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(cuts)):
        yield int(r), _arrow_bytes(table.slice(int(cuts[r]), int(cuts[r + 1] - cuts[r])))


def _arrow_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _slice_words(s: _Slice) -> pa.RecordBatch:
    found, first, n = np.unique(s.label, return_index=True, return_counts=True)
    spelt = [s.words.data[a:e].tobytes().decode() for a, e in zip(s.words.start[first], s.words.end[first])]
    langs = pa.DictionaryArray.from_arrays(s.code[first].astype(np.int32), pa.array(s.names, pa.string()))
    return pa.record_batch([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64)), langs, pa.array(spelt, pa.string())], schema=_WORDS)


def shards(docs: DataFrame, hot: np.ndarray, ranges: int) -> DataFrame:
    """``range, paths, words``: the counted paths, or the words, of each shard and prefix range, coded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Slice] = []

        def flush() -> Iterator[pa.RecordBatch]:
            label, goes_on = (np.concatenate([getattr(s, k) for s in held]) for k in ("label", "goes_on"))
            for r, blob in _shard_paths(label, goes_on, hot, ranges):
                yield pa.record_batch([pa.array([r], pa.int64()), pa.array([blob], pa.binary()), pa.nulls(1, pa.binary())], names=["range", "paths", "words"])
            for r, blob in _shard_words([s.spelt for s in held], ranges):
                yield pa.record_batch([pa.array([r], pa.int64()), pa.nulls(1, pa.binary()), pa.array([blob], pa.binary())], names=["range", "paths", "words"])

        for b in W.slices(batches):
            s = _Slice(b)
            s.spelt = _slice_words(s)
            s.words = s.code = None  # labels are enough from here on
            held.append(s)
            if sum(len(x.label) for x in held) >= SHARD_WORDS:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    return _rows(docs).mapInArrow(run, "range long, paths binary, words binary")


def _found(paths: np.ndarray, f: np.ndarray, lang: list | None = None, name: list | None = None) -> pa.RecordBatch:
    nothing = pa.nulls(len(f), pa.string())
    columns = [pa.array(np.ascontiguousarray(paths[:, k]).view(np.int64)) for k in range(LONGEST)]
    return pa.record_batch([*columns, pa.array(f), nothing if lang is None else pa.array(lang, pa.string()), nothing if name is None else pa.array(name, pa.string())],
                           names=[*_PATH, "f", "lang", "name"])


def ngrams(coded: DataFrame, hot: np.ndarray, min_count: int) -> DataFrame:
    """``w1..w5, f, lang, name``: n-grams of 2 to 5 words that occur ``min_count`` times or more (parts of those of hot
    pairs), frequent words with their names, and words of each language in each range (all labels 0)."""

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r, p, w) for b in batches for r, p, w in zip(*(b.column(c).to_pylist() for c in ("range", "paths", "words"))))
        for _, group in groupby(rows, lambda x: x[0]):
            parts, tables = [], []
            for _, p, w in group:
                if p is not None:
                    parts.append(_decoded(p))
                else:
                    tables.append(pa.ipc.open_stream(w).read_all())
            if parts:
                yield from prefixes(*summed(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])))
            if tables:
                plain = pa.schema([*list(_WORDS)[:2], ("lang", pa.string()), ("name", pa.string())])
                yield from words(pa.concat_tables([t.cast(plain) for t in tables]))

    def prefixes(paths: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        split = np.isin((_pair_slots(paths[:, 0], paths[:, 1]) & _U(PAIR_SLOTS - 1)).astype(np.int64), hot)
        for d, (row, _, _, weight) in enumerate(levels(paths, counts)):
            kept = np.flatnonzero((weight >= min_count) | split[row]) if d < 3 else np.flatnonzero(weight >= min_count)
            if d and len(kept):
                path = paths[row[kept]]
                path[:, d + 1 :] = 0
                yield _found(path, weight[kept])

    def words(table: pa.Table) -> Iterator[pa.RecordBatch]:
        label, first, which = np.unique(table.column("label").to_numpy(), return_index=True, return_inverse=True)
        n = np.bincount(which, weights=table.column("n").to_numpy(), minlength=len(label)).astype(np.int64)
        often = np.flatnonzero(n >= min_count)
        path = np.zeros((len(often), LONGEST), np.int64)
        path[:, 0] = label[often]
        spelt = table.take(pa.array(first[often]))
        yield _found(path, n[often], spelt.column("lang").to_pylist(), spelt.column("name").to_pylist())
        by_lang = table.group_by("lang").aggregate([("n", "sum")])
        yield _found(np.zeros((by_lang.num_rows, LONGEST), np.int64), by_lang.column("n_sum").to_numpy(), by_lang.column("lang").to_pylist())

    ranged = coded.repartition("range").sortWithinPartitions("range")
    return stored(ranged.mapInArrow(united, f"{_PATHS}, f long, lang string, name string"), "found")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(w).to_numpy() for w in _PATH], axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _words() -> Column:
    """The words of a path as an array."""
    return F.filter(F.array(*_PATH), lambda w: w != 0)


def _slots(words: Column) -> list[Column]:
    return [F.coalesce(F.get(words, F.lit(i)), F.lit(0)).cast("long").alias(f"w{i + 1}") for i in range(LONGEST)]


def parts(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """``words, f``: counts of the distinct sequences ``wanted`` (``words``), composed with transducers of ``counted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for b in _blocks(batches, _BLOCK):
            held = b if held is None else pa.concat_batches([held, b])
            begin = _matrix(held)[:, :2]
            change = np.flatnonzero((begin[1:] != begin[:-1]).any(axis=1)) + 1
            if len(change):  # whole prefix ranges; the last one may go on
                yield from answer(held.slice(0, int(change[-1])))
                held = held.slice(int(change[-1]))
        if held is not None:
            yield from answer(held)

    def answer(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        paths, f = _matrix(block), block.column("f").to_numpy()
        asked = f == 0
        if not asked.any():
            return
        asked_paths = paths[asked]
        found = _lookup(paths[~asked], f[~asked], asked_paths)
        yield pa.record_batch([*(pa.array(np.ascontiguousarray(asked_paths[:, k])) for k in range(LONGEST)), pa.array(found)], names=[*_PATH, "f"])

    zero = F.lit(0).cast("long")
    asked = wanted.select(*_slots(F.col("words")), zero.alias("f")).distinct()
    both = counted.select(*_PATH, "f").unionByName(asked).repartition("w1", "w2").sortWithinPartitions(*_PATH)
    found = both.mapInArrow(run, f"{_PATHS}, f long")
    return found.select(_words().alias("words"), "f")


def _lookup(paths: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Counts of ``asked`` by a transducer in which each known path ends with an arc of its own that carries its count."""
    end = np.int64(-1)
    closed = np.concatenate([paths, np.zeros((len(paths), 1), np.int64)], axis=1)
    closed[np.arange(len(paths)), (paths != 0).sum(axis=1)] = end
    wanted = np.concatenate([asked, np.zeros((len(asked), 1), np.int64)], axis=1)
    wanted[np.arange(len(asked)), (asked != 0).sum(axis=1)] = end
    order = np.lexsort(closed.T[::-1])
    return Transducer.of(closed[order], counts[order]).weights_of(wanted)


def _splits(words: Column) -> Column:
    """(cut, first part, rest) of every cut of a phrase."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.struct(
        k.cast("int").alias("cut"), F.slice(words, F.lit(1), k).alias("head"), F.slice(words, k + 1, F.size(words) - k).alias("tail")))


def _inside(words: Column) -> Column:
    """All shorter phrases of two words or more that lie contiguously inside a phrase."""
    starts = F.sequence(F.lit(1), F.size(words) - 1)
    return F.flatten(F.transform(starts, lambda s: F.transform(
        F.filter(F.sequence(F.lit(2), F.greatest(F.size(words) - 1, F.lit(2))), lambda n: (n < F.size(words)) & (s + n - 1 <= F.size(words))),
        lambda n: F.slice(words, s, n))))


def scored(counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang, words, a, l, r, n, score`` of the candidates that no longer one holds.

    ``counted`` has all frequent n-grams, single words included; ``sizes`` the language of each frequent word and
    the number of words of that language (``w1, lang, n``).
    """
    phrases = counted.filter("w2 <> 0").select("w1", _words().alias("words"), F.col("f").alias("a"))
    cuts = stored(phrases.select("w1", "words", "a", F.inline(_splits(F.col("words")))), "cuts")
    known = stored(parts(counted, cuts.select(F.explode(F.array("head", "tail")).alias("words"))), "parts")
    head = known.select(F.col("words").alias("head"), F.col("f").alias("l"))
    tail = known.select(F.col("words").alias("tail"), F.col("f").alias("r"))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    cut = cuts.join(head, "head").join(tail, "tail").join(sizes, "w1")
    cut = cut.withColumns({"up": whole("a") * whole("n") * F.lit(1000).cast("decimal(38,0)"), "down": whole("l") * whole("r")})
    best = cut.groupBy("words").agg(
        F.min("lang").alias("lang"), F.min("a").alias("a"), F.min("n").alias("n"),
        F.min(F.struct(F.expr("up div down").alias("score"), "cut", "l", "r")).alias("best"))
    held = phrases.filter(F.size("words") > 2).select(F.col("a").alias("longer"), F.explode(_inside(F.col("words"))).alias("words"))
    held = held.groupBy("words").agg(F.max("longer").alias("longer"))
    out = best.join(held, "words", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < SHARE * F.col("a")))
    return out.select("lang", "words", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` collocations of each language.

    The highest score comes first, then the most frequent, then the phrase in byte order.
    """
    hot, pairs = pair_shares(docs)
    found = ngrams(shards(docs, hot, max(32, pairs // RANGE_PATHS)), hot, min_count)
    sizes = found.filter("w1 = 0").groupBy("lang").agg(F.sum("f").alias("size"))
    frequent = stored(found.filter("name IS NOT NULL").select(F.col("w1").alias("label"), "lang", "name", F.col("f").alias("n")).join(sizes, "lang"), "frequent")
    several = found.filter("w2 <> 0").groupBy(*_PATH).agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)
    single = found.filter("name IS NOT NULL").select(*_PATH, "f")
    counted = stored(several.unionByName(single), "ngrams")
    rated = scored(counted, frequent.select(F.col("label").alias("w1"), "lang", F.col("size").alias("n")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    kept = stored(rated.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place"), "best")  # with all ties of the last
    spelt = kept.select("words", F.posexplode("words").alias("at", "label")).join(frequent.select("label", "name"), "label")
    spelt = spelt.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), " ").alias("phrase"))
    in_order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.join(spelt, "words").withColumn("rank", F.row_number().over(in_order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
