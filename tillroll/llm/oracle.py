"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tillroll.llm import quality_rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _windows(n: int) -> str:
    """Every window of n words of the words in ``flat``, as one text."""
    following = ", ".join(f"lead(word, {k}) OVER w" for k in range(1, n))
    return f"""
    SELECT * FROM (
        SELECT doc_id, pos, concat_ws(' ', word, {following}) AS words, lead(word, {n - 1}) OVER w AS last
        FROM flat WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
    ) WHERE last IS NOT NULL"""


# A window of 20 words is a repeat if its words also start earlier.
OP4 = rf"""
WITH docs AS (
    SELECT doc_id, {_WORDS} AS words FROM documents
), flat AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM docs
), windows AS ({_windows(20)}
), ranked AS (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY words ORDER BY doc_id, pos) AS nth FROM windows
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM ranked WHERE nth > 1
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
    FROM flat ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP5 = r"""
WITH urls AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM urls
), rules AS (
    SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                          ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(rule_host, rule_path, verdict)
), fits AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM parts JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
"""


def _verdict() -> str:
    """The threshold table as one condition."""
    sides = []
    for t in quality_rules.THRESHOLDS:
        sides += [f"{t.measure} >= {t.least}"] if t.least is not None else []
        sides += [f"{t.measure} <= {t.most}"] if t.most is not None else []
    return " AND ".join(sides)


def _op10() -> str:
    def count_of(chars: str) -> str:
        chars = chars.replace("'", "''")
        return f"(length(text) - length(translate(text, '{chars}', '')))"

    def share(part: str, whole: str) -> str:
        return f"CASE WHEN {whole} > 0 THEN ({part})::DOUBLE / {whole} ELSE 0.0 END"

    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    return rf"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), docs AS (
    SELECT doc_id, text, {_WORDS} AS words,
           list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM texts
), flat AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM docs
), windows AS ({_windows(5)}
), counted AS (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, words) AS n FROM windows
), repeats AS (
    SELECT doc_id, len(list_distinct(flatten(list(range(pos, pos + 5))))) AS n_repeat
    FROM counted WHERE n > 1 GROUP BY doc_id
), counts AS (
    SELECT d.doc_id, len(words) AS n_words, len(lines) AS n_lines,
           CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
           {count_of(quality_rules.SYMBOLS)} AS n_symbols, {count_of("!?")} AS n_marks,
           {count_of(quality_rules.CAPITALS)} AS n_capitals,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
           len(list_filter(words, lambda w: list_contains([{stops}], lower(w)))) AS n_stops,
           coalesce(n_repeat, 0) AS n_repeat_words
    FROM docs d LEFT JOIN repeats r ON d.doc_id = r.doc_id
), measures AS (
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           {share("word_chars", "n_words")} AS mean_word_chars,
           {share("n_symbols", "n_words")} AS symbols_per_word,
           {share("n_marks", "n_words")} AS marks_per_word,
           {share("n_capitals", "word_chars")} AS capital_share,
           {share("n_stops + 1", "n_words")} AS stop_word_share,
           {share("n_dup_lines", "n_lines")} AS dup_line_share,
           {share("n_ellipsis", "n_lines")} AS ellipsis_line_share,
           {share("n_repeat_words", "n_words")} AS repeat_word_share
    FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_verdict()} AS kept
FROM measures
"""



# Word runs of one to three words; CRC-32 byte by byte over the hex digits of a run's UTF-8.
OP11 = rf"""
WITH steps AS (
    SELECT list(c ORDER BY b) AS t FROM (
        SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
        FROM range(256) AS r(b))
), texts AS (
    SELECT 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
    SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM texts
), runs AS (
    SELECT kind, doc_id, len(words) AS n_words, unnest(flatten(list_transform(range(1, 4), lambda n:
        list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))))) AS run
    FROM words
), counted AS (
    SELECT kind, doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), distinct_runs AS (
    SELECT run, hex(encode(run)) AS digits FROM (SELECT DISTINCT run FROM counted)
), buckets AS (
    SELECT run, xor(list_reduce(list_transform(range(1, length(digits), 2), lambda i:
        (strpos('0123456789ABCDEF', digits[i]) - 1) * 16 + strpos('0123456789ABCDEF', digits[i + 1]) - 1),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
    FROM distinct_runs, steps
), per_text AS (
    SELECT kind, doc_id, bucket, sum(n)::BIGINT AS n FROM counted JOIN buckets USING (run) GROUP BY ALL
), shares AS (
    SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t
    FROM per_text GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain
    FROM shares
), weights AS (
    SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
    FROM per_text JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY doc_id
), scored AS (
    SELECT w.doc_id, len(w.words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                     / 4294967296::DOUBLE)))::BIGINT AS score
    FROM words w LEFT JOIN weights x ON w.doc_id = x.doc_id WHERE w.kind = 'd'
), ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
    FROM scored WHERE n_words >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= (5 * n) // 100 THEN rank END AS rank
FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
"""

OP12 = r"""
WITH docs AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), flat AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs
), keyed AS (
    SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM flat
), repeated AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), kept AS (
    SELECT k.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text
    FROM keyed k LEFT JOIN repeated r ON k.key = r.key
    WHERE keeper IS NULL OR keeper = k.doc_id GROUP BY k.doc_id
)
SELECT d.doc_id, len(lines) AS n_lines, len(lines) - coalesce(n, 0) AS n_dropped,
       sha256(coalesce(text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def _op13(rounds: int = 6) -> str:
    """Every round as a pair of steps: parts with their entries, then the entries' means."""
    def assigned(k: int) -> str:
        return f"""gaps{k} AS (
    SELECT p.vec_id, p.label, p.part, p.v, e.entry,
           list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - e.v[i]) * (p.v[i] - e.v[i])))::BIGINT AS gap
    FROM parts p JOIN books{k} e ON p.part = e.part
), near{k} AS MATERIALIZED (
    SELECT * FROM gaps{k} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY gap, entry) = 1
)"""

    def means(k: int) -> str:
        return f"""sums{k} AS (
    SELECT part, entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x
    FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM near{k - 1}) GROUP BY ALL
), books{k} AS MATERIALIZED (
    SELECT b.part, b.entry, coalesce(s.v, b.v) AS v
    FROM books{k - 1} b LEFT JOIN (SELECT part, entry, list(x ORDER BY pos) AS v FROM sums{k} GROUP BY part, entry) s
      ON b.part = s.part AND b.entry = s.entry
)"""

    steps = [assigned(0)]
    for k in range(1, rounds + 1):
        steps += [means(k), assigned(k)]
    return f"""
WITH vectors AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, label, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] AS v
    FROM vectors, range(8) AS r(part)
), books0 AS MATERIALIZED (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts
    QUALIFY entry < 16
), {", ".join(steps)}, digest AS (
    SELECT sha256(string_agg(x, ',' ORDER BY part, entry, pos)) AS codebooks_sha256
    FROM (SELECT part, entry, unnest(v)::VARCHAR AS x, unnest(range(len(v))) AS pos FROM books{rounds})
), codes AS (
    SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code,
           sum(gap)::BIGINT AS error
    FROM near{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes, digest
"""


def statements() -> dict[str, str]:
    return {"op4_substrings": OP4, "op5_urls": OP5, "op10_rules": _op10(), "op11_importance": OP11, "op12_lines": OP12,
            "op13_codes": _op13()}
