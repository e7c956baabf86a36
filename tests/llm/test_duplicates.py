"""SimHash components and repeated substrings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tillroll.llm import components, queries, simhash, substrings


def slow_print(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance=3):
    """Smallest id reachable, for (id, print) pairs."""
    values = sorted(set(p for _, p in prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(values):
        for b in values[k + 1:]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    return {p: least.get(find(p)) for p in values}


def test_op1(spark, sf_dir, texts):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op1_simhash(spark, sf_dir).collect()}
    prints = {i: slow_print(t) for i, t in texts.items()}
    least = slow_components(list(prints.items()))
    assert got == {i: (p, least[p]) for i, p in prints.items()}


def test_components_of_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    want = [(r.doc_id, slow_print(r.text)) for r in odd.collect()]
    least = slow_components(want)
    assert Counter((r.id, r.fingerprint % 2**64, r.component_id) for r in got) == Counter(
        (i, p, least[p]) for i, p in want)
    assert simhash.near_duplicates(empty).count() == 0


def test_one_row_of_each_component_stays(odd, empty):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    least = slow_components([(r.doc_id, slow_print(r.text)) for r in odd.collect()])
    assert Counter(r.doc_id for r in rows)[8] == 0 and Counter(r.doc_id for r in rows)[5] == 1
    assert set(r.doc_id for r in rows) == set(least.values())
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_keys_of_split_buckets_are_joined_by_shuffle(spark):
    rows = spark.range(300).selectExpr("shiftrightunsigned(xxhash64(id), 24) AS fingerprint")  # one crowded bucket
    plan = simhash.link_table(rows, 3, 64)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_links_do_not_depend_on_bucket_size(spark):
    """A dense group of prints, random ones, and buckets that must be split."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(300)} | {base}
    for _ in range(400):
        value = base
        for b in rng.sample(range(64), rng.randint(1, 6)):
            value ^= 1 << b
        prints.add(value)
    rows = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fingerprint long")
    want = {p: i for p, i in slow_components([(p, p) for p in prints]).items()}

    def groups(bucket_rows):
        links = simhash.link_table(rows, 3, bucket_rows)
        assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in links.collect())
        return {r.node % 2**64: r.root % 2**64 for r in components.connected(links).collect()}

    for bucket_rows in (64, 4096):
        got = groups(bucket_rows)
        for p in prints:
            same = {q for q in prints if want[q] == want[p]}
            assert {q for q in prints if got.get(q, q) == got.get(p, p)} == same


def test_other_distances(spark):
    rng = random.Random(6)
    for distance in (1, 2, 5):
        prints = {rng.getrandbits(64) for _ in range(60)}
        for p in list(prints)[:30]:
            value = p
            for b in rng.sample(range(64), distance):
                value ^= 1 << b
            prints.add(value)
        rows = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fingerprint long")
        got = {r.node % 2**64 for r in components.connected(simhash.link_table(rows, distance)).collect()}
        want = slow_components([(p, p) for p in prints], distance)
        sizes = Counter(want.values())
        assert got == {p for p in prints if sizes[want[p]] > 1}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100), (7, 3)], "a long, b long")
    assert {(r.node, r.root) for r in components.connected(links).collect()} == {(k, 0) for k in range(61)}
    assert components.connected(links.where("a < 0")).count() == 0


# --- substrings ----------------------------------------------------------------------------

def slow_repeats(rows, window):
    """(n_words, n_removed, kept words) of (order, text) rows; equal rows are one document."""
    seen, out = set(), {}
    for key in sorted(set(rows), key=lambda r: r[0]):
        words = (key[1] or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            now = tuple(words[k:k + window])
            if now in seen:
                gone[k:k + window] = [True] * window
            seen.add(now)
        out[key] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g))
    return out


def ordered(odd):
    """Rows with the order the operator states: null ids last, then id, then a hash of the text."""
    keyed = odd.select(
        F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("i"),
        substrings.text_hash(F.col("text")).alias("h"), "doc_id", "text").collect()
    return [((r.n, r.i, r.h), r.text) for r in keyed]


def test_repeats_of_odd_rows(odd, empty):
    for window in (4, 7, 20):
        got = substrings.remove_repeats(odd, window=window, digest=True).collect()
        want = slow_repeats(ordered(odd), window)
        by_text = Counter((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in got)
        assert by_text == Counter(
            (None if k[0][0] else k[0][1], *want[k][:2], hashlib.sha256(want[k][2]).hexdigest()) for k in ordered(odd))
    assert substrings.remove_repeats(empty).count() == 0


def test_texts_are_untouched_unless_something_goes(odd):
    after = substrings.drop_repeats(odd)
    assert after.columns == odd.columns
    found = Counter((r.doc_id, r.text) for r in after.collect())
    assert found[(2, None)] == 1 and found[(4, " \t\n ")] == 1 and found[(6, "a")] == 2
    assert found[(8, "")] == 2  # a whole copy of document 5


def test_merging_in_small_steps_changes_nothing(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = slow_repeats([(k, t) for k, t in enumerate(texts)], 6)
    for step in (1, 500_000):
        monkeypatch.setattr(substrings, "MERGE_PIECES", step)
        got = {r.row.doc_id: (r.n_words, r.n_removed, bytes(r.kept or b"")) for r in
               substrings.remove_repeats(rows, window=6).collect()}
        assert {k: v[:2] for k, v in got.items()} == {k: want[(k, t)][:2] for k, t in enumerate(texts)}
        assert all(got[k][2].split() == want[(k, t)][2].split() for k, t in enumerate(texts))


def test_lengthened_prefixes_and_small_trees_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    shared = [f"s{k}" for k in range(40)]
    texts = []
    for _ in range(80):
        at = rng.randint(0, 25)
        texts.append(" ".join([*(rng.choice("abc") for _ in range(rng.randint(0, 9))), *shared[at:at + rng.randint(3, 15)],
                               *(rng.choice("abc") for _ in range(rng.randint(0, 9)))]))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = slow_repeats([(k, t) for k, t in enumerate(texts)], 6)
    for places, suffixes, pieces in ((1, 1, 1), (5, 3, 100_000), (30_000, 7, 3)):
        monkeypatch.setattr(substrings, "GROUP_PIECES", places)
        monkeypatch.setattr(substrings, "TREE_SUFFIXES", suffixes)
        monkeypatch.setattr(substrings, "MERGE_PIECES", pieces)
        got = {r.row.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(rows, window=6).collect()}
        assert got == {k: want[(k, t)][:2] for k, t in enumerate(texts)}


def test_longest_repeats(odd, empty):
    for window in (4, 20):
        want, seen = Counter(), set()
        for (no_id, id_, _), text in sorted(set(ordered(odd)), key=lambda r: r[0]):
            words, starts, last = (text or "").encode().split(), [], None
            for k in range(len(words) - window + 1):
                if tuple(words[k:k + window]) in seen:
                    starts.append(k)
                seen.add(tuple(words[k:k + window]))
            for k in starts:
                if last is None or k != last[1]:
                    last = [k, k + 1]
                last[1] = k + 1
                want[None if no_id else id_, last[0]] = last[1] - last[0] + window - 1
        got = {(r.row.doc_id, r.first_word): r.n_words for r in substrings.longest_repeats(odd, window=window).collect()}
        assert got == dict(want)
    assert substrings.longest_repeats(empty).count() == 0


def test_depth_is_counted_in_whole_words():
    pieces = substrings._Pieces(4)
    words = [bytes([0, 0, 0, 0, 0, 0, 0, k]) for k in range(9)]
    pieces.add(b"".join(words[:6]), 0, (False, 1, 0, 0))
    pieces.add(b"".join([words[8], *words[1:6]]), 0, (False, 2, 0, 7))
    pieces.add(b"".join([words[8], *words[2:5], words[7]]), 0, (False, 3, 0, 0))
    pieces.add_nodes()
    assert list(pieces.runs()) == [(False, 2, 0, 8, 2)]


def test_anchors_are_shared_by_equal_windows():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 2**63, 40, dtype=np.uint64)
    a = np.concatenate((rng.integers(0, 2**63, 17, dtype=np.uint64), shared))
    b = np.concatenate((shared, rng.integers(0, 2**63, 5, dtype=np.uint64)))
    for window in (4, 5, 8, 20, 23):
        one, two = substrings._anchors(a, window)[0], substrings._anchors(b, window)[0]
        n = 40 - window + 1
        for hashes, values in ((a, one), (b, two)):
            found, place = substrings._anchor_places(hashes, window)
            assert (found == values).all() and (place >= np.arange(len(place))).all()
            assert (substrings._grams(hashes, min(5, window))[place] == values).all()
        assert (one[17:17 + n] == two[:n]).all() and len(one) == len(a) - window + 1


def test_windows_with_one_other_word_are_unlike(spark):
    """Pairs of words whose windows agree in all 32-bit hashes of five words each."""
    for at, one, two in ((2, "n247707", "n297327"), (12, "n122868", "n137233"), (17, "n12685", "n149778")):
        texts = [" ".join(w if k == at else f"word{k}" for k in range(20)) for w in (one, two)]
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert [r.n_removed for r in substrings.remove_repeats(rows, window=20).collect()] == [0, 0]
