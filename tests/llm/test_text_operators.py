"""Operators on text corpora against brute force, on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from habitatq.llm import (
    catalog, graphs, language_id, license_rules, packing, pairwise_quality, phrase_automata, positional_index, quality_rules, simhash,
    suffix_array, url_filter,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, text_key string, spans int, cut_text string, key int, kept_id long, bad_id long, cut_id long, doc string"
OTHER = (None,) * 10


def sentence(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    en, de = [f"th{i}er" for i in range(60)] + ["the", "of"] * 20, [f"ü{i}ung" for i in range(60)] + ["der", "ß"] * 20
    shared, late = sentence(rng, 70, en), sentence(rng, 55, en)
    out = []
    for i in range(40):
        words, lang = (en, "en") if i % 3 else (de, "de")
        out.append((i, sentence(rng, 60 + i, words), lang))
    out += [(100 + i, f"{sentence(rng, 20, en)} {shared}\n{sentence(rng, 15 + i, en)}", "en") for i in range(6)]
    out += [(110 + i, f"{late}  {sentence(rng, 3 * i, en)}", "en") for i in range(3)]
    out += [(120, out[4][1], "en"), (121, out[4][1], "en"), (121, out[4][1], "en"), (7, shared, "en")]
    out += [(122, out[5][1] + " th1er", "en"), (123, " ".join(["a b"] * 90), "en"), (None, shared, "en"), (None, None, None)]
    out += [(130, None, "en"), (131, "", None), (132, " \t\n", "en"), (133, "1 2 3 !!", "en"), (134, "X" * 300_000, None)]
    out += [(135, " ".join(f"w{i}" for i in range(30_000)), "en"), (136, "A <|endoftext|> don't É\u00a0ß 12 ...x", "en"), (137, "\U0001f600 é", "de")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), *OTHER) for i, t, g in rows], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(records):
    out: dict = {}
    for r in records:
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


# Repeated passages -----------------------------------------------------------------


def windows_removed(rows):
    """Per distinct (id, text): words, indices to remove and the smallest document of each repeated window."""
    least: dict = {}
    for i, t, _ in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - 49) if i is not None else ():
            k = tuple(w[p : p + 50])
            least[k] = min(least.get(k, i), i)
    out = {}
    for i, t, _ in rows:
        w = (t or "").encode().split()
        hit = {} if i is None else {p: least[tuple(w[p : p + 50])] for p in range(len(w) - 49) if least[tuple(w[p : p + 50])] < i}
        out[(i, t)] = (w, {q for p in hit for q in range(p, p + 50)}, hit)
    return out


@pytest.mark.parametrize("limits", [(20_000, 60_000), (20, 8)])
def test_phrase_automata(docs, rows, limits, monkeypatch):
    monkeypatch.setattr(phrase_automata.repeated_spans, "__defaults__", limits)
    removed = windows_removed(rows)
    want = []
    for i, t, _ in rows:
        w, gone, _ = removed[(i, t)]
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    assert counted(phrase_automata.without_repeats(docs).collect()) == counted(want)


def test_suffix_array(docs, rows):
    want = set()
    for (i, _), (_, _, hit) in windows_removed(rows).items():
        run = None
        for p in sorted(hit):
            if run and p <= run[1]:
                run[1] = p + 50
                continue
            if run:
                want.add((i, run[0], run[1] - run[0], run[2]))
            run = [p, p + 50, hit[p]]
        if run:
            want.add((i, run[0], run[1] - run[0], run[2]))
    assert {tuple(r) for r in suffix_array.repeated_passages(docs).collect()} == want


def test_suffix_array_cuts_text(docs, rows):
    out = suffix_array.without_repeats(docs)
    assert out.schema == docs.schema
    removed, want = windows_removed(rows), []
    for i, t, _ in rows:
        w, gone, _ = removed[(i, t)]
        if not gone or len(gone) < len(w):
            want.append((i, " ".join(x.decode() for k, x in enumerate(w) if k not in gone)))
    got = out.collect()
    assert counted((r.doc_id, " ".join(x.decode() for x in (r.text or "").encode().split())) for r in got) == counted(want)
    assert all(r.n_chars == len(r.text or "") for r in got)


# Near copies -----------------------------------------------------------------------


def slow_fingerprint(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps):
    u = np.array(sorted(fps), np.uint64)
    root = {int(x): int(x) for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 4) + i + 1:
            root[find(int(u[i]))] = find(int(u[j]))
    return {x: find(x) for x in root}


def test_simhash_classes(docs, rows):
    fps = {t: slow_fingerprint(t) for _, t, _ in rows if len(t or "") < 100_000}
    got = simhash.near_duplicates(docs).collect()
    names = {}
    for i, t, _ in rows:
        fps.setdefault(t, simhash.fingerprint_of(t) % (1 << 64))
    root = linked(set(fps.values()))
    for i, t, _ in rows:
        if i is not None:
            names[root[fps[t]]] = min(i, names.get(root[fps[t]], i))
    assert counted(got) == counted((i, f"{fps[t]:016x}", names.get(root[fps[t]])) for i, t, _ in rows)


@pytest.mark.parametrize("two_parts_from,task", [(1 << 24, 100_000), (1 << 24, 300), (1, 100_000)])
def test_simhash_links_dense_groups(spark, monkeypatch, two_parts_from, task):
    monkeypatch.setattr(simhash, "TWO_PARTS_FROM", two_parts_from)
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 60, dtype=np.int64)
    fps = [base]
    for flips in (1, 2, 3, 4, 5):
        x = base.copy()
        for _ in range(flips):
            x ^= np.int64(1) << rng.integers(0, 63, 60)
        fps.append(x)
    crowd = np.repeat(base[:1], 400)
    for _ in range(3):
        crowd = crowd ^ (np.int64(1) << rng.integers(0, 63, 400))
    fps = np.unique(np.concatenate([*fps, crowd, ~base[:5]]))
    frame = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    got: dict = {}
    for r in graphs.components(simhash.links(frame, 4, task)).collect():
        got.setdefault(r.root, set()).add(r.node)
    want: dict = {}
    for x, r in linked([int(x) % (1 << 64) for x in fps]).items():
        want.setdefault(r, set()).add(int(np.uint64(x).view(np.int64)))
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (100, 100)], "a long, b long")
    got = {r.node: r.root for r in graphs.components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_golay_is_perfect():
    code = simhash.Golay()
    x = np.arange(1 << 23)[:: 997]
    assert np.bitwise_count(x ^ code.nearest(x)).max() <= 3
    assert not simhash.Golay.syndrome(code.nearest(x)).any()


def test_pipeline_keeps_one_of_each_group(spark, docs, empty):
    import corpus_pipeline

    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(3000)]
    near = [" ".join([*base[:at], f"new{at}", *base[at + 1 :]]) for at in range(0, 3000, 300)]  # a word of 3,000 moves few bits or none
    texts = [(i, t) for i, t in enumerate([" ".join(base), *near, *near, " ".join(rng.choice(words) for _ in range(3000)), None, "", " \n"])]
    fp = [simhash.fingerprint_of(t) & (2**64 - 1) for _, t in texts]
    want = {i: i for i, _ in texts}
    for i, a in enumerate(fp):
        for j in range(i):
            if (a ^ fp[j]).bit_count() <= 4 and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = {n: low if r == high else r for n, r in want.items()}
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(texts, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values())) and len(set(want.values())) < 6
    for stage in (corpus_pipeline.keep_known_language, corpus_pipeline.drop_near_copies, corpus_pipeline.cut_repeated_passages):
        out = stage(spark, empty, "")
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.drop_near_copies(spark, docs, "").filter("doc_id IS NULL").count() == docs.filter("doc_id IS NULL").count()


def test_simhash_keeps_one_of_each(docs):
    out = simhash.first_of_each(docs)
    assert out.schema == docs.schema
    first = {r.component_id for r in simhash.near_duplicates(docs.filter("doc_id IS NOT NULL")).collect()}
    assert {r.doc_id for r in out.collect()} == first | {None}


# Benchmark -------------------------------------------------------------------------


def tokens(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    w = rows[1][1].split()
    items = [(1, " ".join(w[3:25])), (2, " ".join(w[5:16]).upper()), (2, "th1er"), (3, None), (4, ""), (5, "É\u00a0ß 12"), (10, "the of th3er nowhere th3er")]
    return spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, doc_id string")


def test_equal_segments_in_several_blocks(spark, benchmark, rows, monkeypatch):
    monkeypatch.setattr(positional_index, "SEGMENT_BYTES", 1)  # a segment a document
    item = " ".join(rows[1][1].split()[3:25])
    docs = spark.createDataFrame([(9, "x " * 400 + item), (9, "x " * 400 + item), (10, "short")], "doc_id long, text string").repartition(1)
    for block in (200_000, 5):
        got = positional_index.search(positional_index.build(docs), benchmark, block_windows=block).collect()
        assert sorted((r.doc_id, r.n_hit > 20) for r in got) == [(9, True), (9, True), (10, False)]


@pytest.mark.parametrize("block", [200_000, 5])
def test_decontamination(docs, rows, benchmark, block):
    windows: dict = {}
    for item in benchmark.collect():
        w = tokens(item.text)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(item.item_id))
    want = []
    for i, t, _ in rows:
        w, hit, items = tokens(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit.update(range(p, p + n))
                    items |= windows[k]
        want.append((i, len(w), len(hit), tuple(sorted(items))))
    got = positional_index.search(positional_index.build(docs), benchmark, block_windows=block).collect()
    assert counted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == counted(want)
    kept = positional_index.without_contaminated(docs, benchmark)
    assert kept.schema == docs.schema
    assert counted((r.doc_id,) for r in kept.collect()) == counted((i,) for i, _, hit, _ in want if not hit)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x y b c"), (2, "c b x x a"), (3, "a b"), (4, "a q q q q b c"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in positional_index.search(positional_index.build(docs), items, slop=4).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


# Packing ---------------------------------------------------------------------------


def test_packing_tokens_and_places(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(catalog.tokenizer())
    want = []
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 4096):
            part = np.array(ids[s : s + 4096], "<u4")
            want.append((i, s // 4096, s, len(part), zlib.crc32(part.tobytes())))
    got = packing.pack(docs, catalog.tokenizer).collect()
    assert counted(tuple(r)[:5] for r in got) == counted(want)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(x[3] for x in want)
    assert len(by) <= 1.05 * total / 4096 + 2


@pytest.mark.parametrize("lengths", [[1365] * 999, [1], [4096] * 7, [2049, 4096, 2047] * 50, list(range(1, 4097)), []])
def test_packing_plan(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    seen, filled = {}, {}
    for length, first, count, sequence, offset in packing.plan(histogram):
        seen.setdefault(length, []).append((first, count))
        for k in range(count):
            filled.setdefault(sequence + k, []).append((offset, length))
    for length, parts in seen.items():
        at = 0
        for first, count in sorted(parts):
            assert first == at
            at += count
        assert at == histogram[length]
    assert set(seen) == set(histogram)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) <= 1.03 * sum(lengths) / 4096 + 1 or lengths[:1] == [2049]


# Rules, classifiers ----------------------------------------------------------------


def test_quality_counts(docs, rows):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.rules(docs).collect()}
    want = set()
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        where: dict = {}
        for p in range(len(w) - 2):
            where.setdefault(tuple(w[p : p + 3]), []).append(p)
        again = {q for ps in where.values() if len(ps) > 1 for p in ps for q in (p, p + 1, p + 2)}
        want.add((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)))
    assert got == want


def test_quality_references_count_exactly(spark, docs, rows):
    ref = quality_rules.references(docs, share=0.02, min_words=100)
    assert ref.languages == ["de", "en"]
    for k, lang in enumerate(ref.languages):
        words = [x for _, t, g in rows if g == lang for x in (t or "").encode().lower().split()]
        common = sorted(words.count(x) / len(words) for x in set(words) if words.count(x) >= 0.02 * len(words))
        assert np.allclose(sorted(ref.word_share[k][ref.member[k]]), common)


def test_copies_of_a_noisy_text_do_not_move_references(spark):
    rng = random.Random(3)
    words = ["the", "of", "and", "to", "in", *[f"th{i}er" for i in range(15)]]
    clean = [(i, sentence(rng, 200, words), "en") for i in range(60)]
    noisy = " ".join(rng.choice(["BUY", "NOW!!", "$$$", "###", "100%", "the", "CLICK"]) + str(i % 90) for i in range(400))
    table = spark.createDataFrame(clean + [(1000 + i, noisy, "en") for i in range(30)], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality_rules.rules(table).collect()}
    assert len(kept) == 90 and all(kept[i] for i, _, _ in clean)
    assert quality_rules.copies_once(table).count() == 61


def test_documents_of_a_language_without_reference_are_kept(spark):
    rng = random.Random(3)
    en, own = [f"th{i}er" for i in range(60)] + ["the", "of"] * 20, [f"ж{i}ия" for i in range(60)] + ["и", "в"] * 20
    rows = [(i, sentence(rng, 900, en), "en") for i in range(60)] + [(100 + i, sentence(rng, 120, own), "ru") for i in range(8)]
    rows += [(200, sentence(rng, 120, own), None), (201, "и в " * 10, "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality_rules.rules(docs).collect()}
    assert all(kept[i] for i in (*range(60), *range(100, 108))) and not kept[200] and not kept[201]
    many = [(i, sentence(rng, 130, [f"{chr(0x100 + i // 10)}{k}ž" for k in range(9)]), f"l{i // 10}") for i in range(700)]
    judged = quality_rules.rules(spark.createDataFrame(many, "doc_id long, text string, lang string"))
    assert judged.filter("kept").count() + judged.filter("base_failed").count() == 700


def test_distance():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    assert np.allclose(quality_rules.distance(p, np.array([[0.0, 1.0]])), [1.0, 0.5579230452841438])


def test_language_id(docs, rows):
    got = language_id.identify(docs).collect()
    assert counted((r.doc_id, r.held_out) for r in got) == counted((i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    sure = {r.doc_id: r.lang_pred for r in got}
    assert all(sure[i] == g for i, _, g in rows[:40])
    assert {sure[i] for i in (130, 131, 132, 133)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    kept = language_id.keep_known(docs, 0.1)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert {130, 131, 132, 133}.isdisjoint({r.doc_id for r in kept.collect()})


def test_every_language_is_learned(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñåøæ"
    rows = []
    for k in range(70):
        alphabet = rng.sample(letters, 6)
        rows += [(100 * k + i, " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(60)), f"l{k}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.languages) == 70 and model.languages == sorted(model.languages)
    right = language_id.predict(docs, model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


def test_pairwise_quality(spark):
    rng = random.Random(1)
    words = [f"th{i}er" for i in range(50)]
    texts = [sentence(rng, 80, words) if i % 4 else " ".join(x + "###" for x in sentence(rng, 80, words).split()) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (500, "", "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), None) for i in range(200)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, score int")
    got = pairwise_quality.classify(docs, labels).collect()
    assert len(got) == 202 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 200]
    assert held and all(r.predicted == int(r.doc_id % 4 > 0) for r in held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_quality_cut_does_not_move_with_the_number_of_labels(spark):
    rng = random.Random(2)
    words = [f"th{i}er" for i in range(50)]

    def noisy(share):
        return " ".join(x + "###" if rng.random() < share else x for x in sentence(rng, 80, words).split())

    texts = [noisy(rng.uniform(0, 0.6) if i % 10 else rng.uniform(0.4, 1)) for i in range(400)]  # a tenth is bad; kinds overlap
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string").cache()
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(1200)], "doc_id long, quality int").cache()

    def below(model):
        return sum(r.predicted == 0 for r in pairwise_quality.score(docs.filter("doc_id < 400"), model).collect()) / 400

    once, thrice = labels.filter("doc_id < 400"), labels
    assert abs(below(pairwise_quality.fit(docs, once)) - 0.1) < 0.03
    capped = [below(pairwise_quality.fit(docs, x, fit_labels=40)) for x in (once, thrice)]
    assert all(abs(x - 0.1) < 0.05 for x in capped), capped


def test_quality_learns_from_all_labels_and_all_pairs(spark):
    rng = random.Random(3)
    words = [f"th{i}er" for i in range(50)]

    def noisy(share):
        return " ".join(x + "###" if rng.random() < share else x.upper() if rng.random() < 0.1 else x for x in sentence(rng, 12, words).split())

    labels = [(i, int(i % 12 > 0)) for i in range(5400)] + [(0, 0), (1, 1), (2, None), (None, 1), (9999, 1)]  # 4,952 good, 451 bad; one has no document
    texts = {i: noisy(rng.uniform(0, 0.6) if i % 12 else rng.uniform(0.2, 1)) for i in range(5400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    model = pairwise_quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int").repartition(3))
    used = [(i, q) for i, q in labels if i in texts and q is not None]
    x = pairwise_quality.features(pairwise_quality.shares(pa.array([texts[i] for i, _ in used])))
    good = np.array([q == 1 for _, q in used])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6))
    # at the least loss over all pairs no weight has a slope
    z, s = (x - model.mean) / model.scale, model.raw(x)
    wrong = 1 / (1 + np.exp(s[good][:, None] - s[~good]))
    slope = (wrong.sum(axis=0) @ z[~good] - wrong.sum(axis=1) @ z[good]) / wrong.size + pairwise_quality.PENALTY * model.weights
    assert np.abs(slope).max() < 1e-8
    # the cut is the score at the share of bad ones, documents of a kind weighing as much as its labels
    order = np.argsort(s, kind="stable")
    weight = np.where(good, 4952 / good.sum(), 451 / (~good).sum())[order]
    assert abs(model.cut - np.interp(451, np.cumsum(weight) - weight / 2, s[order])) < 1e-9


def test_url_filter(spark):
    urls = [
        "http://a.Example.ORG/en/2?x#y", "https://example.org/en/12", "https://example.org/es/", "http://b.com/fr/1", "http://b.com/de/1", "http://b.net/en/1",
        "http://xorg/a", "http://org", "http://org/", None, "no scheme", "x://h?q=/fr/", "ftp://h#f", "http://b.com:80/de/1", "a://b://c/d", "",
    ]
    pages = spark.createDataFrame([(i, u, "z", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.filter_pages(pages).collect()}
    assert [got[i] for i in range(16)] == [
        ("a.example.org", "/en/2", "org/"), ("example.org", "/en/12", "example.org/en/1"), ("example.org", "/es/", "example.org/es/"),
        ("b.com", "/fr/1", "com/fr/"), ("b.com", "/de/1", "com/de/"), ("b.net", "/en/1", None), ("xorg", "/a", None), ("org", "", None),
        ("org", "/", "org/"), ("", "", None), ("", "", None), ("h", "", None), ("h", "", None), ("b.com:80", "/de/1", None), ("b:", "//c/d", None), ("", "", None),
    ]
    known = spark.createDataFrame(
        [(f"http://{h}{i}.example/{p}/{i}", b) for i in range(150) for h, p, b in (("good", "news", 0), ("spam", "casino", 1))], "url string, blocked int")
    train, test = known.filter(~F.col("url").contains("7")), known.filter(F.col("url").contains("7"))
    model = url_filter.fit(train)
    pages = test.withColumn("page_id", F.col("blocked").cast("long"))
    assert all((r.verdict == "block") == (r.page_id == 1) for r in url_filter.judge(pages, model, ()).collect())


def test_url_filter_learns_bad_hosts_not_languages(spark):
    clean = [f"https://{f}{h}.example.net/{p}/{n}" for f in ("", "www.", "m.") for h in ("ththly", "theron", "bakery", "observatory") for p in ("de", "es", "en", "fr") for n in (7, 1570)]
    spam = [f"http://{f}{h}.example.net/{p}/{n}" for f in ("", "www.", "m.") for h in ("casino-win", "free-bets", "spam-farm") for p in ("de", "es", "en", "fr") for n in (7, 1570)]
    # in rows that rules decide, languages are all that differs
    ruled = [f"https://theron.example.{d}/{p}/{n}" for d, p in (("com", "fr"), ("com", "de"), ("org", "es"), ("org", "en")) for n in range(100, 140)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(clean + spam + ruled)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_pages(pages).collect()}
    assert {got[i] for i in range(len(clean))} == {(None, "allow")}
    assert {got[len(clean) + i] for i in range(len(spam))} == {(None, "block")}


def test_license_scan(spark):
    mit = license_rules.SENTENCES
    broken = "Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer."
    texts = {
        1: "x.\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.",
        2: f"{mit['mit_grant']}. Unknown words! {mit['mit_as_is'].upper()}.", 3: broken, 4: "license", 5: None, 6: "", 7: "All rights reserved. All rights reserved.",
    }
    docs = spark.createDataFrame([(i, t, "z") for i, t in texts.items()], "doc_id long, text string, license string")
    got = sorted((r.doc_id, r.license, r.rule_no, r.n_matches) for r in license_rules.scan(docs).collect())
    assert [g[:2] + g[3:] for g in got] == [(1, "GPL-3.0", 1), (1, "MIT", 1), (2, "MIT", 1), (7, "all-rights-reserved", 2)]
    assert {g[2] for g in got if g[0] == 2} == {1}
    assert all(any(h in s for h in license_rules.HINTS) for s in license_rules.SENTENCES.values())


# Empty tables ----------------------------------------------------------------------


def test_empty_tables(spark, empty, benchmark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string")
    found = [
        url_filter.filter_pages(pages), packing.pack(empty, catalog.tokenizer), quality_rules.rules(empty), simhash.near_duplicates(empty),
        license_rules.scan(empty), phrase_automata.without_repeats(empty), positional_index.decontaminate(empty, benchmark),
        pairwise_quality.classify(empty, labels), suffix_array.repeated_passages(empty), language_id.identify(empty),
        suffix_array.without_repeats(empty), simhash.first_of_each(empty), positional_index.without_contaminated(empty, benchmark.limit(0)),
    ]
    assert [df.count() for df in found] == [0] * len(found)


def test_without_benchmark_labels_or_languages(docs, rows, spark, benchmark):
    assert positional_index.without_contaminated(docs, benchmark.limit(0)).count() == len(rows)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert all(abs(r.score - 0.3) < 1e-9 for r in pairwise_quality.classify(docs, labels).collect())
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(none).collect()} == {"und"}
    assert all(r.kept != r.base_failed for r in quality_rules.rules(none).collect())
