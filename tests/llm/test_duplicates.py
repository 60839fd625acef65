import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from moorline.llm import blocks, embedding_dedup, fingerprints, ngram_join, queries, shingles, suffix_dedup
from tests.llm.helpers import SCHEMA, jaccard_components, odd_documents, removed_spans


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 17)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20_000)


@pytest.mark.parametrize(("words", "num", "cell"), [(3, 90, 1024), (5, 80, 1024), (3, 90, 4), (2, 60, 4)])
def test_ngram_join_equals_brute_force(spark, small_blocks, monkeypatch, words, num, cell):
    monkeypatch.setattr(ngram_join, "CELL", cell)
    docs = odd_documents(n=200)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(frame, words, num, 100).collect()}
    assert got == jaccard_components([d[:2] for d in docs], words, num, 100)


def test_small_sets_equal_brute_force(spark, small_blocks):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=3) + list("pqrstuvwx")[: rng.randrange(5, 10)])) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for num in (70, 80, 90):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(frame, 1, num, 100).collect()}
        assert got == jaccard_components(docs, 1, num, 100)


def test_ngram_join_edges(spark):
    rows = [(None, "a b c"), (5, "a b c"), (5, "x y z"), (7, "X Y Z"), (9, None), (10, "")]
    frame = spark.createDataFrame([(*r, "u") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_components(frame, 3, 90, 100).collect()), key=str)
    assert got == sorted([(None, 1, None), (5, 1, 5), (5, 1, 5), (7, 1, 5), (9, 0, 9), (10, 0, 10)], key=str)
    assert ngram_join.link_components(frame.filter("false"), 3, 90, 100).collect() == []


@pytest.mark.parametrize(("hot", "spread"), [(32, 64), (1, 64), (1, 0)])
def test_suffix_dedup_equals_brute_force(spark, small_blocks, monkeypatch, tmp_path, hot, spread):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SPREAD", spread)
    docs = [d for d in odd_documents(n=200)]
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_suffix_dedup(spark, str(tmp_path)).collect()}
    for d, (kept, spans) in removed_spans([d[:2] for d in docs]).items():
        text = next(t for i, t, *_ in docs if i == d) or ""
        want = (len(text.encode()), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == want


@pytest.mark.parametrize("spread", [0, 4, 8, 1000])
def test_spread_hashes_meet_over_all_parts(spark, monkeypatch, spread):
    """A common line with many surroundings in one block and few in the others: its windows are dealt out in some parts
    of the blocks only, or in none or all, and the result is that of brute force."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 17)
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "SPREAD", spread)
    rng = random.Random(5)
    line = "".join(rng.choices("abcdefghijkl", k=64))
    text = lambda k: "".join(rng.choices("mnopqrstuvwxyz", k=k))
    many = [text(80) + line + text(80) for _ in range(17)]
    docs = [(100 + i, t) for i, t in enumerate(many)]
    for k in range(12):  # a block each: one document that shares the line and some bytes beside it with one of `many`
        before, after = (40 + k % 5, 0) if k % 2 else (0, 40 + k % 5)
        few = text(50) + many[k][80 - before : 144 + after] + text(50)
        docs += [(1000 * (k % 3) + 20 * k + j, few if not j else text(120)) for j in range(17)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(docs, 13), "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in suffix_dedup.remove_repeats(frame).collect()}
    assert sum(len(spans) for _, spans in removed_spans(docs).values()) >= 12
    assert got == removed_spans(docs)


@pytest.mark.parametrize("rows", [1, 5])
def test_large_groups_go_distance_by_distance(spark, monkeypatch, rows):
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", rows)
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefgh ", k=260))
    docs = [(i, ("".join(rng.choices("pqrs", k=rng.randrange(0, 40))) + passage[rng.randrange(0, 30) : 260 - rng.randrange(0, 60)] + "".join(rng.choices("wxyz", k=rng.randrange(0, 40)))).encode()) for i in range(40)]
    data = np.frombuffer(b"".join(t for _, t in docs), np.uint8)
    limits = np.cumsum([0, *(len(t) for _, t in docs)])
    (h, place, lo, hi), gone = suffix_dedup.anchors(data, limits)
    around = suffix_dedup.contexts(data, place, lo, hi)
    owner = np.searchsorted(limits, place, side="right") - 1
    rank = suffix_dedup.ranked(owner, owner, place)
    again = suffix_dedup.same_stretches(h, place - lo, place - hi, around, rank)
    rest = np.flatnonzero(~again)
    row, distance = suffix_dedup.repeated_windows(h[rest], (place - lo)[rest], (place - hi)[rest], around[rest], rank[rest])
    starts = {*(place[rest[row]] - distance).tolist(), *(s for k in np.flatnonzero(again) for s in range(lo[k], hi[k] + 1)), *(s for x, y in zip(*gone) for s in range(x, y + 1))}
    seen, want = set(), set()
    for i, (_, text) in enumerate(docs):
        for s in range(len(text) - 99):
            if text[s : s + 100] in seen:
                want.add(int(limits[i]) + s)
            seen.add(text[s : s + 100])
    assert starts == want


def test_suffix_dedup_edges(spark):
    text = "".join(random.Random(1).choices("abcdefghijklmnop", k=130))
    rows = [(None, text), (4, text), (4, text), (2, "é" * 60), (1, None), (3, "")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_removed long")
    out = suffix_dedup.remove_repeats(frame).collect()
    assert all(r.n_removed == 1 for r in out)  # the caller's column
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed_) for r in out), key=str)
    # Among "é" * 60, a 100-byte string starts every second byte anew.
    assert got == sorted([(None, 130, 0), (4, 130, 130), (4, 130, 130), (2, 120, 118), (1, 0, 0), (3, 0, 0)], key=str)
    assert suffix_dedup.remove_repeats(frame.filter("false")).collect() == []


def test_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    monkeypatch.setattr(blocks, "SLICE", 500)
    docs = [(1, "".join(chr(97 + (i * i + i // 7) % 25) for i in range(3000))), (2, "".join(chr(97 + (i * i + i // 7) % 25) for i in range(400, 2500)) + "zz" * 90)]
    got = {r.doc_id: (bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == removed_spans(docs)


def test_texts_that_repeat_themselves_are_settled_at_once(spark):
    """Runs, short periods and ruled lines: few anchors go on, and the result is that of brute force."""
    import numpy as np

    for text in (b"a" * 3_000_000, b"abcdefg" * 400_000, b"xyz" * 1000 + b"a" * 100_000):
        (h, *_), gone = suffix_dedup.anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert len(h) < 3000 and len(gone[0]) < 100
    docs = [(1, "a" * 900 + "b" * 900), (2, "zz" + "a" * 400), (3, "abc" * 300 + "q" + "abc" * 90), (0, "b" * 130 + "-" * 101), (4, "=-" * 200 + "\n" + "=-" * 200), (5, "a" * 99), (6, ("~" * 67 + "\n") * 9), (7, ("~" * 80 + "\n") * 9)]
    got = {r.doc_id: (bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == removed_spans(docs)


def test_cell_rows_are_exact():
    rng = random.Random(8)
    import numpy as np

    base = [rng.randrange(1 << 60) for _ in range(200)]
    sets = []
    for i in range(60):
        s = set(base[: 150 + i % 40]) if i % 3 else {rng.randrange(1 << 60) for _ in range(rng.randrange(1, 80))} | set(base[:20])
        sets.append(np.array(sorted(s ^ {rng.choice(base) for _ in range(i % 9)}), np.uint64))
    cell = ngram_join.Cell(list(range(60)), sets, 80, 100)
    cell.links()
    for x, row in cell.rows.items():
        for y in range(60):
            assert row[y] == len(np.intersect1d(sets[cell.order[x]], sets[cell.order[y]]))


def test_pipeline_stages(spark, tmp_path):
    docs = odd_documents(n=150)
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_join", "suffix_dedup", "best_fit_packing"]

    known = stages["language_id"](spark, now, str(tmp_path))
    assert known.columns == columns
    texts = {r.doc_id: r.text for r in known.collect()}
    assert all(t and any(c.isalpha() for c in t) for t in texts.values())
    known.write.parquet(f"{tmp_path}/1")
    one = stages["ngram_join"](spark, spark.read.parquet(f"{tmp_path}/1"), str(tmp_path))
    groups = jaccard_components(list(texts.items()), 5, 80, 100)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {d for d, (_, c) in groups.items() if d == c}
    one.write.parquet(f"{tmp_path}/2")
    cut = stages["suffix_dedup"](spark, spark.read.parquet(f"{tmp_path}/2"), str(tmp_path))
    kept = removed_spans([(d, texts[d]) for d, (_, c) in groups.items() if d == c])
    assert cut.columns == columns
    assert {r.doc_id: r.text for r in cut.collect()} == {d: k.decode(errors="ignore") for d, (k, _) in kept.items()}
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    cut.write.parquet(f"{tmp_path}/3")
    packed = stages["best_fit_packing"](spark, spark.read.parquet(f"{tmp_path}/3"), str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def regular_words(n):
    """The Thue-Morse word of n letters and its complement."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 64, 1024, 4096])
def test_words_that_share_nothing_do_not_link(spark, n):
    docs = spark.createDataFrame(list(enumerate(regular_words(n))), "doc_id long, text string")
    rows = ngram_join.link_components(docs, 3, 90, 100).collect()
    assert sorted(r.component_id for r in rows) == [0, 1]


def test_word_hashes_of_all_lengths():
    rng = random.Random(3)
    words = {"".join(rng.choices("ab", k=rng.randrange(1, 40))) for _ in range(3000)} | {w for n in (512, 1024, 2048) for w in regular_words(n)} | {"a" * k for k in range(1, 60)}
    words = sorted(words)
    hashes = []
    for lead in ("", "xyz q "):  # equal words have equal hashes wherever they lie
        data = (lead + " ".join(words)).encode()
        got, _ = shingles.word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        hashes.append(got[len(lead.split()) :].tolist())
    assert hashes[0] == hashes[1] and len(set(hashes[0])) == len(words)


def test_op7_ids_beside_nulls_keep_all_digits(spark):
    text = "".join(random.Random(4).choices("abcdef ", k=150))
    rows = [(9007199254740993, text), (9007199254740992, text), (None, "x")]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {9007199254740992: 0, 9007199254740993: 150, None: 0}


@pytest.mark.parametrize("period", [3, 68, 80, 250])
def test_op7_settles_any_period_at_once(period):
    line = bytes(random.Random(period).choices(range(97, 123), k=period))
    data = np.frombuffer(line * (2_000_000 // period), np.uint8)
    (h, *_), gone = suffix_dedup.anchors(data, np.array([0, len(data)]))
    assert len(h) < 100 and len(gone[0])


def test_op7_on_texts_of_long_periods(spark):
    rng = random.Random(8)
    line = "".join(rng.choices("abcdefgh", k=90))
    docs = [(1, line * 30), (2, "x" * 50 + line * 8 + "tail"), (3, "".join(rng.choices("ab", k=300)) + line[:70]), (0, line * 2 + "end" + line * 3)]
    want = removed_spans(docs)
    got = {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.spans]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>")
    for refused in (lambda: ngram_join.link_components(docs, 3, 9, 10), lambda: suffix_dedup.remove_repeats(docs), lambda: fingerprints.fingerprint_pairs(docs), lambda: embedding_dedup.near_duplicates(vectors)):
        with pytest.raises(TypeError):
            refused()
