"""Importance resampling, line dedup and vector codes against brute force."""

import collections
import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tillroll.llm import gnat, importance, line_dedup, ngram_table, queries, vector_codes
from tillroll.llm.common import text_hash

# --- importance resampling -----------------------------------------------------------------


def slow_words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def slow_runs(text):
    words = slow_words(text)
    return [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def slow_resample(docs, target, percent=5, least=20, seed=42):
    """{index of the document: (n_features, weight, score, rank)} for (id, text) pairs, ids unique."""
    def buckets(texts):
        return collections.Counter(crc32(r.encode()) % 10000 for t in texts for r in slow_runs(t))

    s, t = buckets(d[1] for d in docs), buckets(target)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10000.0) / ((s[b] + 1) * (sum(t.values()) + 10000.0))))
            for b in s}
    out = {}
    for i, text in docs:
        weight = sum(gain[crc32(r.encode()) % 10000] for r in slow_runs(text))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(slow_runs(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = [i for i, text in docs if len(slow_words(text)) >= least]
    able.sort(key=lambda i: (-out[i][2], i is None, i))
    for k, i in enumerate(able[:percent * len(able) // 100]):
        out[i][3] = k + 1
    return {i: tuple(v) for i, v in out.items()}


def test_op11(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in queries.op11_importance(spark, sf_dir).collect()}
    target = [r.text for r in queries.read_table(spark, sf_dir, "benchmark").select("text").collect()]
    assert got == slow_resample(list(texts.items()), target)
    assert sum(v[3] is not None for v in got.values()) >= 5


@pytest.mark.parametrize("percent", [0, 40, 100])
def test_resampling_of_odd_rows(spark, odd, empty, percent):
    rows = odd.collect()
    once = {r.doc_id: r.text for r in rows if r.doc_id not in (6, 8, None)}
    docs = spark.createDataFrame([(i, t, "w") for i, t in once.items()], "doc_id long, text string, weight string")
    target = spark.createDataFrame([("you are one two three",), (None,), ("",)], "text string")
    got = {r.row.doc_id: (r.n_features, r.weight, r.score, r["rank"])
           for r in importance.resample(docs.repartition(5), target, percent=percent).collect()}
    assert got == slow_resample(list(once.items()), ["you are one two three"], percent)
    # repeated rows and ids, without and with ids: every row once, ranks without gaps
    found = importance.resample(odd, target, percent=percent).collect()
    assert collections.Counter(r.row.doc_id for r in found) == collections.Counter(r.doc_id for r in rows)
    ranks = sorted(r["rank"] for r in found if r["rank"])
    able = sum(len(slow_words(r.text)) >= 20 for r in rows)
    assert ranks == list(range(1, percent * able // 100 + 1))
    by_rank = sorted((r["rank"], -r.score) for r in found if r["rank"])
    assert [s for _, s in by_rank] == sorted(s for _, s in by_rank)
    assert importance.resample(empty, target).count() == 0
    assert importance.resample(odd, target.limit(0)).count() == len(rows)


def test_ties_of_scores_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(importance, "noise", lambda id_, seed: F.lit(0).cast("long"))
    docs = spark.createDataFrame([(k, "w " * 30) for k in range(200)], "doc_id long, text string").repartition(7)
    found = importance.resample(docs, docs.limit(3), percent=50).collect()
    assert sorted((r["rank"], r.row.doc_id) for r in found if r["rank"]) == [(k + 1, k) for k in range(100)]


SAMPLES = [b"", b"a", b" ,;", b"A-b c " * 500, b"x" * 3000, "Straße 漢字 ümlaut été".encode() * 9, b"one two three",
           b"One  TWO\nthree four", bytes(range(1, 128)), b"z" * 255 + b" " + b"z" * 257, b"q" * 31 + b" " + b"q" * 33]


@pytest.mark.parametrize("words", [1, 2, 5, 1 << 16])
def test_runs_are_counted_once_in_any_window(monkeypatch, words):
    monkeypatch.setattr(ngram_table, "WINDOW_WORDS", words)
    monkeypatch.setattr(ngram_table, "FLAT_BYTES", 4000)
    texts = SAMPLES if words < 100 else SAMPLES * 3
    got, seen = collections.Counter(), 0
    for begin, some in ngram_table.portions(texts):
        assert begin == seen
        seen += len(some)
        for table in ngram_table.tables(some, 3, 10000):
            for b, n in zip(table.bucket[table.used].tolist(), table.count[table.used].tolist()):
                got[b] += n
    assert seen == len(texts)
    assert +got == collections.Counter(crc32(r.encode()) % 10000 for t in texts for r in slow_runs(t.decode()))


def test_hashes_are_those_of_the_libraries():
    laid = ngram_table.Layout.of([b" ".join(b"k" * n for n in range(1, 300))])
    length = laid.ends - laid.starts
    slices = [laid.flat[a:b].tobytes() for a, b in zip(laid.starts, laid.ends)]
    assert ngram_table.slice_hashes(laid.flat, laid.lanes, laid.starts, length).tolist() == [xxhash.xxh64_intdigest(s) for s in slices]
    assert ngram_table.slice_crcs(laid.flat, laid.lanes, laid.starts, length).tolist() == [crc32(s) for s in slices]


def test_runs_with_equal_keys_are_told_apart_by_their_bytes():
    laid = ngram_table.Layout.of([b" ".join(str(k).encode() + b"abcdefghijklmnop" * (k % 3) for k in range(300)) * 2])
    length = laid.ends - laid.starts
    zero = lambda flat, lanes, start, length: np.zeros(len(start), np.uint64)
    table = ngram_table.intern(laid.flat, laid.lanes, laid.starts, length, laid.text, 10000, keys=zero)
    runs = collections.Counter(laid.flat[a:b].tobytes() for a, b in zip(laid.starts, laid.ends))
    assert len(table.used) == len(runs) and sorted(table.count[table.used]) == sorted(runs.values())
    assert sorted(table.bucket[table.used]) == sorted(crc32(r) % 10000 for r in runs)


# --- lines ---------------------------------------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"


def slow_lines(rows, least_chars=20, least_docs=3):
    """(n_lines, bits) of every (id, text)."""
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    keeper = {k: max(h, key=lambda i: (i is not None, i)) for k, h in holders.items() if len(h) >= least_docs}
    return [[keeper.get(key(line), i) == i for line in (text or "").split("\n")] for i, text in rows]


def bits_of(runs):
    return [k % 2 == 0 for k, n in enumerate(runs) for _ in range(n)]


LINE = "This very line is found in many documents"


def line_rows():
    rows = [(k, f"start {k}\n{LINE}\n  {LINE.upper()}\t\nend {k}") for k in range(40)]
    rows += [(k, LINE + "\n") for k in range(40, 44)] + [(50, None), (51, ""), (52, "\n\n"), (53, "short\n" * 5)]
    rows += [(54, "exactly twenty chars\nnineteen characters"), (55, "EXACTLY twenty chars\nnineteen characters"),
             (56, "\x0b exactly twenty chars \r\nnineteen characters"), (57, "ÉXACTLY twenty chars ÀÀÀ"), (58, "éxactly twenty chars ààà")]
    rows += [(60, "only in two documents, so it stays"), (61, "only in two documents, so it stays")]
    rows += [(70, "the same id holds this line thrice"), (70, "the same id holds this line thrice"), (70, "the same id holds this line thrice\nx")]
    rows += [(None, LINE), (None, LINE), (None, "no id, but a line of this text"), (62, "no id, but a line of this text"), (63, "no id, but a line of this text")]
    rows += [(80, "\n".join([LINE, "a"] * 2000 + [LINE] * 3000)), (81, "漢字の行は文字で数えるので二十文字あれば十分です")]
    rows += [(k, "漢字の行は文字で数えるので二十文字あれば十分です\r") for k in (82, 83)]
    return rows


def test_line_bitmaps_and_texts(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "row", 1, 2) for i, t in rows],
                                 "doc_id long, text string, row string, keep int, n_lines int").repartition(6)
    got = collections.Counter(
        (r.row.doc_id, r.n_lines, r.n_dropped, tuple(bits_of(r.keep)), r.kept) for r in line_dedup.dedup_lines(docs).collect())
    want = collections.Counter(
        (i, len(b), len(b) - sum(b), tuple(b), "\n".join(l for l, k in zip((t or "").split("\n"), b) if k))
        for (i, t), b in zip(rows, slow_lines(rows)))
    assert got == want
    runs = next(r.keep for r in line_dedup.dedup_lines(docs.where("doc_id = 80 OR doc_id < 9")).collect() if r.row.doc_id == 3)
    assert runs == [1, 2, 1]
    kept = line_dedup.drop_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_lines_of_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = collections.Counter((r.row.doc_id, tuple(bits_of(r.keep))) for r in line_dedup.dedup_lines(odd).collect())
    assert got == collections.Counter((i, tuple(b)) for (i, _), b in zip(rows, slow_lines(rows)))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_shuffle_no_text_for_bitmaps(spark, sf_dir):
    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    found = line_dedup.dedup_lines(queries.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    whole, narrow = plan(found), plan(found.drop("kept"))
    assert not any(w in whole for w in ("Python", "Arrow", "Pandas", "Broadcast"))
    text_goes_on = r"Project \[(?:[^\]]*, )?text#\d+[,\]]"
    assert re.search(text_goes_on, whole) and not re.search(text_goes_on, narrow)
    # ranges of (name, document) already hold what counts need: one exchange by range, one of counts
    lines = spark.createDataFrame([], "h1 long, h2 long, id long, th int, pos int")
    from pyspark.sql import Window
    dealt = lines.repartitionByRange("h1", "h2", "id").select(
        F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy("th", "pos")).alias("k"))
    assert plan(dealt).count("Exchange") == 1


# --- vector codes --------------------------------------------------------------------------

def slow_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """({index: (code, error)}, codebooks) of (id, vector) rows."""
    kept = [(k, i, [math.floor(scale * x) for x in v]) for k, (i, v) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    first = sorted(kept, key=lambda r: (r[1] is None, r[1], rows[r[0]][1]))[:entries]
    books = [[v[p * width:(p + 1) * width] for _, _, v in first] for p in range(parts)]

    def near(p, v):
        gaps = [sum((a - b) ** 2 for a, b in zip(v[p * width:(p + 1) * width], e)) for e in books[p]]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = collections.defaultdict(list)
            for _, _, v in kept:
                groups[near(p, v)[0]].append(v[p * width:(p + 1) * width])
            new.append([[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else b for e, b in enumerate(books[p])])
        books = new
    out = {}
    for k, _, v in kept:
        found = [near(p, v) for p in range(parts)]
        out[k] = bytes(f[0] for f in found), sum(f[1] for f in found)
    return out, books


def vector_rows(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=dims).astype(np.float32)]) for i in rng.permutation(n)]
    rows += [(n + k, rows[0][1]) for k in range(n // 3)]               # a third are copies
    rows += [(None, [0.0] * dims), (5, rows[1][1]), (5, [0.25] * dims)]  # no id, repeated ids
    return rows


@pytest.mark.parametrize("entries", [1, 3, 16, 40])
def test_codes_against_brute_force(spark, entries):
    rows = vector_rows(entries, 200)
    bad = [(1000, None), (-1, [math.nan] + [0.0] * 15), (-2, [math.inf] * 16), (-3, [None] + [1.0] * 15)]
    table = spark.createDataFrame([(i, v, k % 3 or None, k, "row") for k, (i, v) in enumerate(rows + bad)],
                                  "vec_id long, embedding array<float>, label int, error long, row string").repartition(5)
    want, want_books = slow_codes(rows, entries=entries)
    books = vector_codes.fit(table, entries=entries)
    assert books.tolist() == want_books
    got = vector_codes.label_errors(vector_codes.compress(table, books)).collect()
    assert {r.row.error: (bytes(r.code), r.error) for r in got} == want
    sums = collections.Counter()
    for k, (_, error) in want.items():
        sums[k % 3 or None] += error
    assert all(r.label_error == sums[r.row.label] for r in got) and len(got) == len(rows)


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    none = spark.createDataFrame([], schema)
    short = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [], None), (3, None, 2)], schema)
    for table in (none, short, short.where("vec_id = 2")):
        books = vector_codes.fit(table)
        assert vector_codes.compress(table, books).count() == 0 and books.shape[1] == 0
    assert vector_codes.codebooks_digest(vector_codes.fit(none)) == hashlib.sha256(b"").hexdigest()
    huge = spark.createDataFrame([(1, [1e308] * 8, 1), (2, [-1e308] * 8, 1), (3, [0.0] * 8, 1), (4, [0.0] * 9, 1)], schema)
    books = vector_codes.fit(huge, entries=2)
    rows = sorted((r.row.vec_id, bytes(r.code)) for r in vector_codes.compress(huge, books).collect())
    assert [i for i, _ in rows] == [1, 2, 3] and rows[0][1] == b"\0" * 8 and rows[1][1] == b"\1" * 8
    with pytest.raises(ValueError):
        vector_codes.fit(huge, entries=257)


@pytest.mark.parametrize("spread", [2, 50, 4096, 1 << 26])
def test_tree_finds_the_nearest_and_skips_subtrees(spread):
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread, (60, 4))
    points[7] = points[31]                                  # a tie of points
    queries_ = np.concatenate([rng.integers(-spread, spread, (500, 4)), points, (points[:30] + points[30:]) // 2])
    index, square, taken = gnat.nearest(gnat.build(points), points, queries_)
    gaps = ((queries_[:, None] - points[None]) ** 2).sum(axis=2)
    assert (index == gaps.argmin(axis=1)).all() and (square == gaps.min(axis=1)).all()
    assert taken <= gaps.size and (spread < 50 or taken < 0.8 * gaps.size)


def test_hash_column_tells_null_from_nothing_else(spark):
    """Null and empty texts share a hash: both have one empty line and no words."""
    rows = spark.createDataFrame([(None,), ("",)], "t string").select(text_hash(F.col("t")).alias("h")).collect()
    assert rows[0].h == rows[1].h
