"""Quality and toxicity by held-out labels, language model and tokens against brute force."""

import collections
import hashlib
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillroll.llm import bpe, language_model, pipeline, quality_model, queries, toxicity
from tillroll.llm.common import labelled_sample, read_table

TABLES = "/root/testdata/sf0.01"


def judged(spark, query, label):
    found = {r.doc_id: r for r in query(spark, TABLES).collect()}
    assert len(found) == 1000
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    labels = read_table(spark, TABLES, "labels").select("doc_id", label).collect()
    return [(found[r.doc_id].score, found[r.doc_id].predicted, r[1]) for r in labels if found[r.doc_id].held_out]


def test_quality_on_held_out_labels(spark):
    rows = judged(spark, queries.op2_quality, "quality")
    good, bad = ([s for s, _, y in rows if y == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)
    assert all(p == (s >= 0.3) for s, p, _ in rows)


def test_toxicity_on_held_out_labels(spark):
    rows = judged(spark, queries.op3_toxicity, "toxic")
    assert all(p == (s >= 0.5) for s, p, _ in rows)
    clean = [p for _, p, y in rows if y == 0]
    assert sum(clean) <= 0.02 * len(clean)


def test_toxicity_learns_stems_and_spares_clean_texts(spark):
    """Insults that only labels tell: a word, and a stem with ever new endings."""
    docs, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        insult = f" blorp{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" if k % 8 == 0 else " zonk"
        docs.append((k, f"plain words number{k} here{insult if toxic else ''} and there."))
        labels.append((k, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    grammar = toxicity.fit(frame, toxicity.training_rows(truth))
    found = {r.row.doc_id: r.score for r in toxicity.score(frame, grammar).collect()}
    assert all((found[k] >= 0.5) == bool(t) for k, t in labels)
    assert grammar.scores(grammar.features("a blorpwhatever appears")[None])[0] >= 0.5


def test_grammar_follows_negation_report_and_address():
    grammar = toxicity.Grammar({"fool$": 1.0}, toxicity.PRIOR)
    kinds = {text: grammar.features(text).tolist() for text in (
        "a fool", "you fool", "fool that you are", "he is not a fool", "she said he is a fool",
        "not here. a fool", "I will kill you", "we will kill time, you all")}
    assert kinds["a fool"] == [1, 0, 0, 0, 0] and kinds["you fool"] == [0, 1, 0, 0, 0]
    assert kinds["fool that you are"] == [0, 1, 0, 0, 0] and kinds["he is not a fool"] == [0, 0, 1, 0, 0]
    assert kinds["she said he is a fool"][3] == 1 and kinds["not here. a fool"] == [1, 0, 0, 0, 0]
    assert grammar.features("foolish") .tolist() == [0] * 5


def test_threats_count_with_a_target_on_either_side():
    grammar = toxicity.Grammar({"fool$": 1.0}, toxicity.PRIOR)
    for text in ("I will kill you", "we are going to murder you all", "kill them", "you they kill"):
        assert grammar.features(text).tolist() == [0, 0, 0, 0, 1], text
    for text in ("we will kill time", "kill time with some games that you like", "kill time. you read"):
        assert grammar.features(text).tolist() == [0] * 5, text
    assert grammar.features("I will not kill you").tolist() == [0, 0, 1, 0, 0]
    assert grammar.features("he said kill you").tolist() == [0, 0, 0, 1, 0]


def test_labelled_threats_are_found(spark):
    """Threats whose words also stand in clean texts, apart from each other."""
    threats = ("we kill you number{}", "now shoot them number{}")
    clean = ("we kill time number{}. you read", "now shoot pictures number{}. them too")
    docs = [(k, (clean if k % 4 else threats)[k // 4 % 2].format(k)) for k in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    truth = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    grammar = toxicity.fit(frame, toxicity.training_rows(truth))
    found = {r.row.doc_id: r.score >= 0.5 for r in toxicity.score(frame, grammar).collect()}
    held = [k for k in found if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(found[k] for k in held if k % 4 == 0) >= 0.95 * sum(k % 4 == 0 for k in held)
    assert not any(found[k] for k in held if k % 4)


def test_toxicity_finds_most_held_out_toxic_texts(spark):
    """On ten times the documents of the other tables, which hold out six toxic texts only."""
    tables = TABLES.replace("sf0.01", "sf0.1")
    toxic = {r.doc_id for r in read_table(spark, tables, "labels").where("toxic = 1").collect()}
    found = [r.predicted for r in queries.op3_toxicity(spark, tables).where("held_out").collect() if r.doc_id in toxic]
    assert len(found) > 50 and sum(found) >= 0.8 * len(found), f"{sum(found)} of {len(found)}"


# --- the grammar as a whole, by brute force -------------------------------------------------

def slow_features(text, insults):
    """What each clause with an attack adds, from the rules in words: no tables, no automaton, no marks."""
    total = dict.fromkeys(toxicity.KINDS, 0.0)
    for clause in re.split(r"[.;:!?\n]", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)

        def strength(word):
            return max([insults.get(word + "$", 0.0)] + [v for p, v in insults.items() if not p.endswith("$") and word.startswith(p)])

        def role(word):
            return "insult" if strength(word) else next(
                (name for name, some in (("threat", toxicity.THREATS), ("target", toxicity.TARGETS),
                                         ("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTS)) if word in some), None)

        roles = [role(w) for w in words]
        for k, (word, mine) in enumerate(zip(words, roles)):
            if mine not in ("insult", "threat"):
                continue
            before, after = roles[max(0, k - toxicity.REACH):k], roles[k + 1:k + 1 + toxicity.REACH]
            if "negation" in before:
                kind = "denied"
            elif "report" in roles[:k]:
                kind = "reported"
            elif "target" in before or "target" in after:
                kind = "aimed" if mine == "insult" else "threat"
            elif mine == "insult":
                kind = "plain"
            else:
                continue
            total[kind] += strength(word) or 1.0
    return [total[k] for k in toxicity.KINDS]


def test_clauses_against_brute_force(texts):
    insults = {"fool$": 1.0, "dolt": 0.7, "idi": 0.5, "idiot$": 1.2}
    grammar = toxicity.Grammar(insults, toxicity.PRIOR)
    draw = random.Random(3)
    words = ("fool dolt dolts idiotic idiot you your they not never said called kill hurt murder a the of time "
             "isn't FOOL Dolt's . ; : ! ? \n , é fools xfool").split(" ")
    samples = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    samples += [None, "", "...", "fool", ".fool.", "kill", "kill you", "x" * 50_000, *list(texts.values())[:100]]
    for text in samples:
        assert grammar.features(text).tolist() == pytest.approx(slow_features(text, insults)), text


def test_a_long_text_full_of_attacks_is_read_in_one_go():
    grammar = toxicity.Grammar({"fool$": 1.0}, toxicity.PRIOR)
    took = []
    for n in (20_000, 160_000):
        start = time.perf_counter()
        assert grammar.features("a fool. " * n).tolist() == [n, 0, 0, 0, 0]
        took.append(time.perf_counter() - start)
    assert took[1] < 30 * took[0] + 0.5


def test_the_fitted_grammar_decides_as_it_is_meant_to(spark):
    grammar = queries.fitted_grammar(spark, TABLES.replace("sf0.01", "sf0.1"))

    def rejected(text):
        return grammar.scores(grammar.features(text)[None])[0] >= 0.5

    for text in ("You are an idiot", "you moron", "I will kill you", "They are stupid, all of them.", "we are going to murder you all",
                 "du bist ein vollidiot", "A report. And you are a bastard. The end"):
        assert rejected(text), text
    for text in ("He is not an idiot", "she said he is an idiot", "we will kill time", "do not kill them", "", None,
                 "He wrote that they would kill him", "nobody is stupid here", "A shooting star, and you"):
        assert not rejected(text), text


def test_the_sample_is_bounded_by_texts_not_by_ids(spark):
    """One id in 40,000 rows, copies under many ids, and an id with two labels."""
    same = spark.range(40_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"))
    copies = spark.range(10, 500).select(F.col("id").alias("doc_id"), F.lit("you fool, copied").alias("text"))
    docs = same.unionByName(copies).unionByName(spark.createDataFrame(
        [(600, None), (601, ""), (None, "x")], "doc_id long, text string"))
    known = spark.createDataFrame([(1, 0), *[(k, 1) for k in range(10, 500)], (600, 0), (601, 0)], "id long, label int")
    rows = labelled_sample(docs, known, {1: 7, 0: 20}, "doc_id", "text").collect()
    found = collections.Counter(r.label for r in rows)
    assert found == {0: 20, 1: 1} and len({(r.label, r.h) for r in rows}) == 21
    labels = known.withColumnsRenamed({"id": "doc_id", "label": "toxic"})
    assert toxicity.fit(docs, labels.unionByName(labels.limit(3)), sample=10).weights.shape == (6,)


def test_weights_do_not_depend_on_how_labels_were_drawn():
    rng = np.random.default_rng(5)
    y = (rng.random(4000) < 0.1).astype(float)
    x = np.column_stack([rng.poisson(0.2 + 1.5 * y) for _ in range(5)]).astype(float)
    whole = toxicity._fit_weights(x, y)
    keep = (y > 0) | (rng.random(4000) < 0.25)
    part = toxicity._fit_weights(x[keep], y[keep], (int((y == 0).sum()), int((y > 0).sum())))
    other = toxicity._fit_weights(x[keep], y[keep])
    assert abs(part[0] - whole[0]) < 0.4 < abs(other[0] - whole[0])
    x2 = rng.normal(size=(12_000, 2 * quality_model.DIMS + 1))
    y2 = (x2[:, 0] + 0.7 * rng.normal(size=len(x2)) > 1.2).astype(float)
    keep = (y2 > 0) | (rng.random(len(x2)) < 0.2)
    each = np.where(y2 > 0, 1.0, (y2 == 0).sum() / (y2[keep] == 0).sum())[keep]
    fitted = [quality_model.fit_network(x2[keep], y2[keep], share, epochs=6).probabilities(x2).mean() for share in (each, None)]
    assert abs(fitted[0] - y2.mean()) < 0.05 < abs(fitted[1] - y2.mean()), (fitted, y2.mean())


def test_network_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2 * quality_model.DIMS + 1))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # no single layer can
    net = quality_model.fit_network(np.tile(x, (3, 1)), np.tile(y, 3), epochs=80)
    assert ((net.probabilities(x) > 0.5) == y).mean() > 0.9
    assert quality_model.fit_network(x[:0], y[:0]).probabilities(x[:2]).tolist() == [0.5, 0.5]


def test_terms_tell_words_forms_and_repeats():
    word, form, owner = quality_model.terms([b"Ab ab ab", b"", b"CD!! 12", "É é".encode()])
    assert owner.tolist() == [0, 0, 0, 2, 2, 3, 3]
    assert word[1] == word[2] and form[1] != form[2]
    assert form[5] not in (form[6],)


# --- language model ------------------------------------------------------------------------

def slow_base(rows):
    train = [(i, t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    split = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = collections.Counter(w for _, t in train for w in split(t))
    n, v = sum(counts.values()), len(counts)
    return {(i, t): (len(split(t)), sum(counts[w] > 0 for w in split(t)), n,
                     sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t))) for i, t in rows}


def test_op6(spark, sf_dir, texts):
    want = slow_base(list(texts.items()))
    found = queries.op6_language_model(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        n_tokens, n_known, n, base = want[(r.doc_id, texts[r.doc_id])]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) >= sum(r.base_score for r in held)


def test_filter_reads_back_what_it_holds():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 64, 40_000, dtype=np.uint64))
    levels = rng.integers(0, 6, len(keys)).astype(np.uint8)
    held = language_model.Filter.of(
        {b: language_model.segment(keys[s], levels[s]).tobytes() for b, s in language_model._pieces(keys, 64)}, 64)
    got = held.levels(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.9
    other = rng.integers(0, 1 << 64, 40_000, dtype=np.uint64)
    assert abs((held.levels(other) >= 0).mean() - 0.5 ** language_model.PROBES) < 0.02
    assert (language_model._unpacked(language_model._packed(keys)) == keys).all()
    nothing = language_model.Filter.of({}, 64)
    assert (nothing.levels(keys) == -1).all() and len(language_model._unpacked(b"")) == 0


def slow_pairs(rows, shares):
    """The pair model from plain dictionaries: each count rounded down to a power of two."""
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    split = lambda t: (t or "").encode().lower().split() + [b"\n"]
    words = collections.Counter(w for t in train for w in split(t))
    pairs = collections.Counter(p for t in train for p in zip([b"\n", *split(t)], split(t)))
    n, v = sum(words.values()), len(words)
    out = {}
    for i, t in rows:
        total = 0.0
        for before, word in zip([b"\n", *split(t)], split(t)):
            c = words[before]
            share = shares[min(int(math.log2(c + 1)), language_model.CLASSES - 1)]
            seen = pairs[before, word]
            held = min(2 ** (seen.bit_length() - 1), c) / max(c, 1) if seen else 0.0
            total += math.log10((1 - share) * held + share * (words[word] + 1) / (n + v + 1))
        out[i, t] = total
    return out


def test_every_counted_pair_is_held_at_any_size(spark, sf_dir, texts, odd, monkeypatch):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 200_000)   # many chunks
    fitted, fit = [], language_model._fitted_shares
    monkeypatch.setattr(language_model, "_fitted_shares", lambda *a: fitted.append(fit(*a)) or fitted[-1])

    def scores(docs, probes=language_model.PROBES):
        rows = language_model.score(docs, held_out, probes=probes).collect()
        return collections.Counter((r.id, r.n_tokens, round(r.score, 6)) for r in rows)

    docs = read_table(spark, sf_dir, "documents")
    whole = scores(docs)
    slow = slow_pairs(list(texts.items()), fitted[-1])
    by_id = {i: s for (i, _), s in slow.items()}
    assert all(s >= by_id[i] - 1e-5 for i, _, s in whole)         # a filter errs upwards only
    monkeypatch.setattr(language_model, "FILTER_BYTES", 0)        # segments are dealt, not broadcast
    assert scores(docs) == whole and (fitted[0] == fitted[1]).all()
    for table, rows in ((docs, list(texts.items())), (odd, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])):
        found = scores(table, probes=24)  # hardly an error
        slow = slow_pairs(rows, fitted[-1])
        want = collections.Counter(i for i, _ in rows)
        assert collections.Counter(i for i, _, _ in found.elements()) == want
        assert sorted(s for _, _, s in found.elements()) == pytest.approx(sorted(slow[r] for r in rows), abs=1e-4)


def test_shares_are_fitted_on_every_training_document(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{w}" for w in rng.zipf(1.4, 40) % 300)) for i in range(900)]
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    seen, fit = [], language_model._fitted_shares
    monkeypatch.setattr(language_model, "_fitted_shares", lambda terms: seen.append(terms) or fit(terms))
    language_model.score(spark.createDataFrame(rows, "doc_id long, text string"), held_out, probes=24).collect()

    split = lambda t: t.encode().split() + [b"\n"]
    words = collections.Counter(w for t in train for w in split(t))
    pairs = collections.Counter(p for t in train for p in zip([b"\n", *split(t)], split(t)))
    n, v, want = sum(words.values()), len(words), collections.Counter()
    for t in train:  # the counts of all other texts, of pairs as the filter tells them
        own, both = collections.Counter(split(t)), collections.Counter(zip([b"\n", *split(t)], split(t)))
        for p in zip([b"\n", *split(t)], split(t)):
            before, left = words[p[0]] - own[p[0]], int(1.4 * 2 ** (pairs[p].bit_length() - 1)) - both[p]
            pair = min(2.0 ** (left.bit_length() - 1), before) / max(before, 1) if left > 0 else 0.0
            ratio = pair / ((words[p[1]] - own[p[1]] + 1) / (n + v + 1))
            low, high = language_model.OCTAVES
            step = 1 + int((min(max(math.log2(ratio), low), high) - low) * language_model.STEPS) if ratio else 0
            want[min(int(math.log2(before + 1)), language_model.CLASSES - 1), step] += 1
    found = collections.Counter()
    for cells, numbers in seen[0].where("cells IS NOT NULL").select("cells", "numbers").collect():
        for cell, number in zip(cells, numbers):
            found[divmod(cell, language_model._columns())] += number
    assert sum(found.values()) == n  # every training token
    assert sum(((found - want) + (want - found)).values()) < n / 100  # a ratio on an edge may round either way


# --- tokens --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(pipeline.vocabulary_path())
    found.no_truncation()
    found.no_padding()
    return found


ODD = ["", " ", "a", "aaaaaaaaaa", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "I'll they'RE 've", "\n\n \t a  b",
       "漢字　テスト", "é́ \u200b\ufeff", "\x00\x1c\x85", "😀😀 🏳️‍🌈", "1234567890" * 30, " " * 200 + "end", "ab" * 3000,
       "".join(chr(c) for c in range(32, 700))]


def test_pieces_merge_as_in_the_library(library):
    encoder = bpe.Encoder(bpe.Vocabulary(pipeline.vocabulary_path()))
    for text, ids, want in zip(ODD, encoder.encode(ODD), library.encode_batch(ODD, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)
        assert encoder.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == text
    assert encoder.encode(ODD) == encoder.encode(ODD) and encoder.encode([]) == []


def test_long_unbroken_pieces(library, monkeypatch):
    vocabulary = bpe.Vocabulary(pipeline.vocabulary_path())
    rng = np.random.default_rng(3)
    drawn = lambda letters, n: "".join(rng.choice(list(letters), n))
    prose = "".join(drawn("etaoinshrdlucmfwyp", 5) for _ in range(400))
    pieces = [drawn("ab", 3000), "a" * 2001, "ab" * 1500, prose * 3, drawn("漢字テスト", 900), "=" * 1023, drawn("aab", 700) + "a" * 600]
    want = [e.ids for e in library.encode_batch(pieces, add_special_tokens=False)]
    got = [np.frombuffer(i, "<u4").tolist() for i in bpe.merge_long([p.encode() for p in pieces], vocabulary)]
    assert got == want
    assert bpe.merge_long([b"", *(p.encode() for p in pieces), b"x"], vocabulary)[1:-1] \
        == bpe.merge_pieces([p.encode() for p in pieces], vocabulary)
    monkeypatch.setattr(bpe, "LONG_PIECE", 1)                     # every piece with links
    for text, ids, e in zip(ODD, bpe.Encoder(vocabulary).encode(ODD), library.encode_batch(ODD, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, repr(text)
    monkeypatch.undo()
    text = drawn("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 1_000_000)
    begun = time.process_time()
    ids = bpe.Encoder(vocabulary).encode([text])[0]
    assert time.process_time() - begun < 60 and np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_kinds_of_vocabulary_are_refused(library):
    said = json.loads(library.to_str())
    bpe.Vocabulary(json.dumps(said).encode())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": said["model"] | {"unk_token": "?"}},
                   {"added_tokens": [said["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(said | change).encode())


def test_op9(spark, sf_dir, texts, library):
    found = queries.op9_bpe(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- odd tables ----------------------------------------------------------------------------

def test_scores_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (12, 1, 1), (None, 1, 1), (3, None, None), (99, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    n = odd.count()
    for docs, rows in ((odd, n), (empty, 0)):
        for known in (labels, labels.limit(0)):
            model = quality_model.fit(docs, known)
            found = quality_model.score(docs, model).collect()
            assert len(found) == rows and all(0 <= r.score <= 1 for r in found)
            grammar = toxicity.fit(docs, known)
            found = toxicity.score(docs, grammar).collect()
            assert len(found) == rows and all(0 <= r.score <= 1 for r in found)
            kept = toxicity.drop_toxic(docs, grammar)
            assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in found)


def test_language_model_of_odd_rows(odd, empty):
    from pyspark.sql import functions as F
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = slow_base(rows)
    got = collections.Counter((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                              for r in language_model.score(odd, held_out).collect())
    assert got == collections.Counter((i, *want[i, t][:3], round(want[i, t][3], 6)) for i, t in rows)
    assert language_model.score(empty, held_out).count() == 0


def test_tokens_of_odd_rows(odd, empty, library):
    rows = bpe.encode_decode(odd, pipeline.vocabulary_path()).collect()
    want = collections.Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids), r.text or "")
                               for r in odd.collect())
    assert collections.Counter(
        (r.row.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), r.decoded) for r in rows) == want
    assert bpe.encode_decode(empty, pipeline.vocabulary_path()).count() == 0
