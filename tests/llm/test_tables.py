"""URL rules, quality rules, mixing, fingerprints, the pipeline and the queries' SQL."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from compare import difference, duck
from test_duplicates import slow_components, slow_print, slow_repeats
from tillroll.llm import mixing, parsing, pipeline, quality_rules, queries, substrings, toxicity, url_rules
from tillroll.llm.common import read_table

SQL = queries.oracle_sql()


def test_all_operators_and_the_pipeline_are_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert set(names) <= set(entry.queries()) and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert difference(queries.queries()[name](spark, sf_dir), duck(sf_dir), SQL[name]) is None


# --- URL rules -----------------------------------------------------------------------------

def slow_match(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    best = max(((len(h + p), len(h), h + p, v) for h, p, v in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[2], best[3] if best else default


def test_urls_against_every_rule(spark):
    hosts = ["net", "a.net", "b.a.net", "example.com", "www.Example.com", "x.org", "a..net", ".net", "", "net.evil", "ÄNET.net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/x/y?q=/de/", "/de/#top", "?only", "#h", "/é/", "//"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "a://b://c/d", "://net/", "http://"]
    urls += urls[:40] * 3
    rules = [("net", "/", "block"), ("a.net", "/en/", "allow"), ("a.net", "/en/x", "block"), ("a.net", "", "allow"),
             ("b.a.net", "/", "block"), ("example.com", "/de/", "block"), ("org", "/en/x/y", "block"), (".net", "/", "allow")]
    pages = spark.createDataFrame([(k, u, "row", 1) for k, u in enumerate(urls)], "page_id int, url string, row string, key int")
    table = spark.createDataFrame(rules + [(None, "/", "block"), ("", "/", "block"), ("net", "/", "allow")],
                                  "host string, path string, verdict string")
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.match(pages.repartition(4), table).collect()}
    assert got == {k: slow_match(u, rules) for k, u in enumerate(urls)}
    assert url_rules.match(pages.limit(0), table).count() == 0
    assert {r.verdict for r in url_rules.match(pages, table.limit(0), default="block").collect()} == {"block"}


# --- quality rules -------------------------------------------------------------------------

def test_rules_of_odd_rows(odd, empty):
    rows = quality_rules.judge(odd).collect()
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r.row.doc_id].append(r)
    assert len(rows) == odd.count() and quality_rules.judge(empty).count() == 0
    assert by_id[2][0].counts.w.n_words == by_id[3][0].counts.w.n_words == by_id[4][0].counts.w.n_words == 0
    assert by_id[9][0].counts.w.n_repeat_words == 400 and not by_id[9][0].kept
    assert by_id[5][0].counts.w.n_words == 30_000
    assert "n_words" in by_id[2][0].failed


def test_thresholds_compile_to_bounds(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "a double")
    rule = quality_rules.compile_rules((quality_rules.Threshold("a", 1, 1.5),), {"a": F.col("a")})
    assert [r[0] for r in rows.select(rule).collect()] == [["a"], [], ["a"]]


def test_rules_run_no_python(spark, sf_dir):
    for name in ("op10_rules", "op5_urls", "op12_lines"):
        plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- mixing --------------------------------------------------------------------------------

def slow_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.remove(s)
    return target


def check_mix(docs, rows):
    sizes = collections.Counter()
    for r in docs:
        sizes[r.source] += len((r.text or "").encode().split())
    want = slow_targets(sizes)
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.row.source] and r.target == pytest.approx(want[r.row.source])
        assert 0 <= r.copies <= 3
        taken[r.row.source] += r.copies * r.size
    return taken, want


def test_mix_comes_near_its_targets(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = [(k, " ".join(["w"] * int(rng.integers(0, 30))), f"s{k % 5}" if k % 11 else None) for k in range(3000)]
    docs += [(5000 + k, " ".join(["w"] * 900), "s0") for k in range(2)] + [(6000, "one two", "tiny")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    runs = []
    for rows in (2_000, 40):
        monkeypatch.setattr(mixing, "GROUP_ROWS", rows)
        found = mixing.mix(frame.repartition(6)).collect()
        taken, want = check_mix(frame.collect(), found)
        assert all(abs(taken[s] - want[s]) <= 40 for s in want)
        runs.append(sorted((r.row.doc_id, r.copies) for r in mixing.mix(frame.repartition(2)).collect()))
        assert runs[-1] == sorted((r.row.doc_id, r.copies) for r in found)


def test_rounding_is_unbiased(spark):
    """Over many seeds a document is taken as often as its fraction says."""
    total = 0
    for seed in range(300):
        a, b, out = 4.0, 7.0, 0
        one, two = mixing._transfer(a, 10, b, 10, mixing._draw(seed, 1))
        total += one
        assert one + two == pytest.approx(11) and (one in (0, 10) or two in (0, 10))
    assert total / 300 == pytest.approx(4.0, abs=0.9)


def test_mix_is_the_same_however_rows_are_batched(spark, odd):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, found = spark.conf.get(name), []
    try:
        for most in (1, 3, 1000):
            spark.conf.set(name, most)
            found.append(collections.Counter(
                (r.row.doc_id, r.row.text, r.row.source, r.size, r.source_size, r.target, r.copies)
                for r in mixing.mix(odd).collect()))
    finally:
        spark.conf.set(name, was)
    assert found[0] == found[1] == found[2] and sum(found[0].values()) == odd.count()


def test_mix_of_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    check_mix(odd.collect(), rows)
    assert len(rows) == odd.count() and mixing.mix(empty).count() == 0
    out = mixing.take(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in rows)


# --- fingerprints --------------------------------------------------------------------------

def test_op8(spark, sf_dir, texts):
    found = {r.doc_id: r for r in queries.op8_parsing(spark, sf_dir).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        cut = len(text) // 3
        changed = text[:len(text) - cut] + following[:cut]
        assert found[i].n_chars == len(text) and found[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        prints = parsing.fingerprints([text.encode(), changed.encode(), following.encode()])
        assert found[i].fingerprint == parsing.shown(prints)[0]
        assert found[i].near_edited == parsing.likeness(prints[:1], prints[1:2])[0]
        assert found[i].near_next == parsing.likeness(prints[:1], prints[2:])[0]
    long = [r for r in found.values() if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > 0.4 > 0.1 > np.mean([r.near_next for r in long])


def test_equal_substrings_share_their_inner_names():
    rng = np.random.default_rng(8)
    core = rng.integers(97, 123, 4000, dtype=np.uint8).tobytes()
    names = []
    for lead in (b"", b"x", b"another beginning ", b"zz" * 50):
        level, owner = np.frombuffer(lead + core, np.uint8), np.zeros(len(lead) + 4000, np.int32)
        for _ in range(parsing.LEVELS):
            level, owner = parsing.parse(level, owner)
        names.append(level)
    inner = names[0][20:-20].tobytes()
    assert all(inner in other.tobytes() for other in names)


def test_prints_do_not_depend_on_neighbours():
    texts = [b"", b"a", b"aa", b"a" * 1000, "é漢".encode() * 40, b"word " * 300, bytes(range(1, 256)) * 4]
    together = parsing.fingerprints(texts)
    assert all((parsing.fingerprints([t])[0] == p).all() for t, p in zip(texts, together))
    assert (together[0] == parsing.EMPTY).all() and parsing.likeness(together[:1], together[:1])[0] == 1
    assert parsing.likeness(together[:1], together[1:2])[0] == 0


@pytest.fixture
def partitions(spark):
    """Sets the number of shuffle partitions, which decides how many ranges there are."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}

    def use(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def slow_comparisons(rows):
    """Of (id, text, hash) rows: id, characters and edited text of each."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -r[2]))
    want = collections.Counter()
    for k, (i, text, _) in enumerate(rows):
        want[i, len(text or ""), parsing.edited(text or "", rows[(k + 1) % len(rows)][1] or "")] += 1
    return want


def with_hashes(frame):
    return [(r.doc_id, r.text, r.h) for r in frame.select(
        "doc_id", "text", substrings.text_hash(F.col("text")).alias("h")).collect()]


@pytest.mark.parametrize("ranges", [1, 5, 60])
def test_fingerprints_of_odd_rows(odd, empty, partitions, ranges):
    partitions(ranges)
    got = collections.Counter((r.id, r.n_chars, r.edited) for r in parsing.compare_edited(odd).collect())
    assert got == slow_comparisons(with_hashes(odd))
    assert parsing.compare_edited(empty).count() == 0
    lone = odd.where("doc_id = 1")
    assert lone.count() == 1 and parsing.compare_edited(lone).first().near_next == 1


@pytest.mark.parametrize("ranges", [1, 40])
def test_fingerprints_with_ids_that_cannot_be_null_or_repeat(spark, partitions, ranges):
    partitions(ranges)
    text = F.concat(F.lit("text number "), F.col("id").cast("string"))
    strict = spark.range(0, 700, 1, 3).select(F.col("id").alias("doc_id"), text.alias("text"))
    assert not strict.schema["doc_id"].nullable
    hot = spark.range(0, 300, 1, 5).select(F.lit(350).cast("long").alias("doc_id"), F.lit("one text for a third of all rows").alias("text"))
    for docs in (strict, strict.unionByName(hot), strict.withColumn("doc_id", F.col("doc_id").cast("int"))):
        found = parsing.compare_edited(docs).collect()
        assert collections.Counter((r.id, r.n_chars, r.edited) for r in found) == slow_comparisons(with_hashes(docs))
        prints = {r.id: r for r in found}
        assert prints[600].near_next == parsing.likeness(*(
            parsing.fingerprints([f"text number {k}".encode()]) for k in (600, 599)))[0]


def test_fingerprints_keep_no_row_a_range_on_the_driver(spark, odd):
    text = parsing.compare_edited(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in text and "ResolvedHint" not in text


# --- pipeline ------------------------------------------------------------------------------

def test_stages_decide_as_brute_force_does(spark, sf_dir):
    """Every stage on what the one before left, against plain Python."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    stages = dict(corpus_pipeline.STAGES)

    def rows_of(frame):
        return {r.doc_id: r for r in frame.collect()}

    before, clean = rows_of(docs), stages["toxicity"](spark, docs, sf_dir).cache()
    grammar = toxicity.fit(docs, toxicity.training_rows(labels))
    found = {i: grammar.scores(np.array([grammar.features(r.text)]))[0] for i, r in before.items()}
    assert rows_of(clean) == {i: r for i, r in before.items() if found[i] < 0.5}

    before, single = rows_of(clean), stages["near duplicates"](spark, clean, sf_dir).cache()
    least = slow_components([(i, slow_print(r.text)) for i, r in before.items()])
    assert rows_of(single) == {i: r for i, r in before.items() if least[slow_print(r.text)] == i}

    before, fresh = rows_of(single), stages["substrings"](spark, single, sf_dir).cache()
    want = slow_repeats([(i, r.text) for i, r in before.items()], 20)
    after = rows_of(fresh)
    assert after.keys() == before.keys()
    for (i, text), (_, gone, kept) in want.items():
        assert after[i].text == (kept.decode() if gone else text) and after[i].n_chars == len(after[i].text)
        assert after[i].asDict() | {"text": 0, "n_chars": 0} == before[i].asDict() | {"text": 0, "n_chars": 0}

    mixed = stages["mixing"](spark, fresh, sf_dir).cache()
    copies = collections.Counter(mixed.collect())
    assert set(copies) <= set(after.values()) and max(copies.values()) <= 3
    sizes, taken = collections.Counter(), collections.Counter()
    for r in after.values():
        sizes[r.source] += len(r.text.encode().split())
        taken[r.source] += copies[r] * len(r.text.encode().split())
    target = slow_targets(sizes)
    longest = max(len(r.text.encode().split()) for r in after.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)

    library = Tokenizer.from_file(pipeline.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    want = collections.Counter()
    for r, n in copies.items():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, r.source, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += n
    got = stages["encoding"](spark, mixed, sf_dir).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")
    assert collections.Counter(map(tuple, got.collect())) == want


def test_every_stage_works_on_all_that_is_left(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    left = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        left.append(docs.count())
        if name != "encoding":
            assert docs.columns == before.columns
        if name in ("toxicity", "near duplicates"):
            assert 0.8 * left[-2] <= left[-1] < left[-2]
            assert docs.exceptAll(before).count() == 0
        if name == "substrings":
            assert left[-1] == left[-2]
    assert left[-1] == left[-2] and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)
    again = corpus_pipeline.run(spark, sf_dir)
    assert again.exceptAll(docs).count() == 0 and docs.exceptAll(again).count() == 0
