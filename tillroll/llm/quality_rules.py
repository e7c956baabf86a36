"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm.common import packed

SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÑÓÔÖÚÛÜ"
WINDOW = 5
# Frequent words of the four languages.
STOP_WORDS = (
    "a and are as at be by for from had has have in is it not of on or that the this to was were what when with "
    "aber als auf aus bei das dem den der des die ein eine einen für im ist mit nicht sich sind und von zu zur "
    "con de del el en es esta la las lo los más no para pero por que se su un una y "
    "au avec ce dans des du elle est et il je le les mais ne ou par pas plus pour qui sur une").split()


@dataclass(frozen=True)
class Threshold:
    """A measure has to lie within [least, most]; None leaves a side open."""

    measure: str
    least: float | None = None
    most: float | None = None


THRESHOLDS = (
    Threshold("n_words", 10, 1_000_000),
    Threshold("mean_word_chars", 2, 16),
    Threshold("symbols_per_word", None, 0.25),
    Threshold("marks_per_word", None, 0.4),
    Threshold("capital_share", None, 0.4),
    Threshold("stop_word_share", 0.02, None),
    Threshold("dup_line_share", None, 0.5),
    Threshold("ellipsis_line_share", None, 0.3),
    Threshold("repeat_word_share", None, 0.2),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _count_of(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words within windows that are found twice or more, the first included."""
    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        return F.aggregate(
            starts, zero,
            lambda s, i: F.struct((s["total"] + i + WINDOW - F.greatest(i, s["end"])).alias("total"),
                                  (i + WINDOW).alias("end")),
            lambda s: s["total"])

    def starts(pairs: Column) -> Column:
        # sorted by hash: a window that equals a neighbour is found twice
        return F.array_sort(F.filter(
            F.transform(pairs, lambda p, k: F.when(
                (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]), p["i"])),
            lambda i: i.isNotNull()))

    def of_windows(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
            _let(_let(pairs, starts), covered))

    def of_hashes(hashes: Column) -> Column:
        return _let(F.transform(F.slice(hashes, 1, F.size(hashes) - (WINDOW - 1)),
                                lambda h, i: F.xxhash64(F.slice(hashes, i + 1, WINDOW))), of_windows)

    return F.when(F.size(words) < WINDOW, 0).otherwise(
        _let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def _counts(text: Column) -> Column:
    """Whole-text counts as one struct."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> list[Column]:
        return [
            F.size(w).alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop_words"),
            _repeat_words(w).alias("n_repeat_words"),
        ]

    def of_lines(l: Column) -> list[Column]:
        return [
            F.size(l).alias("n_lines"),
            (F.size(l) - F.size(F.array_distinct(l))).alias("n_dup_lines"),
            F.size(F.filter(l, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).alias("n_ellipsis_lines"),
        ]

    return F.struct(
        _let(words, lambda w: F.struct(*of_words(w))).alias("w"),
        _let(lines, lambda l: F.struct(*of_lines(l))).alias("l"),
        F.char_length(F.translate(text, SPACE_CHARS, "")).alias("word_chars"),
        _count_of(text, SYMBOLS).alias("n_symbols"),
        _count_of(text, "!?").alias("n_marks"),
        _count_of(text, CAPITALS).alias("n_capitals"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _measures(c: Column) -> dict[str, Column]:
    words, lines = c["w"]["n_words"], c["l"]["n_lines"]
    return {
        "n_words": words,
        "mean_word_chars": _share(c["word_chars"], words),
        "symbols_per_word": _share(c["n_symbols"], words),
        "marks_per_word": _share(c["n_marks"], words),
        "capital_share": _share(c["n_capitals"], c["word_chars"]),
        "stop_word_share": _share(c["w"]["n_stop_words"] + 1, words),  # one for short texts
        "dup_line_share": _share(c["l"]["n_dup_lines"], lines),
        "ellipsis_line_share": _share(c["l"]["n_ellipsis_lines"], lines),
        "repeat_word_share": _share(c["w"]["n_repeat_words"], words),
    }


def compile_rules(thresholds: tuple[Threshold, ...], measures: dict[str, Column]) -> Column:
    """The names of the measures out of bounds, in the table's order."""
    failed = []
    for t in thresholds:
        value = measures[t.measure]
        out = [value < t.least] if t.least is not None else []
        out += [value > t.most] if t.most is not None else []
        if out:
            failed.append(F.when(out[0] if len(out) == 1 else out[0] | out[1], t.measure))
    return F.filter(F.array(*failed), lambda name: name.isNotNull()) if failed else F.array().cast("array<string>")


def judge(docs: DataFrame, text_col: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """(row, counts, measures, failed, kept) of every row; row holds the other columns.

    A null text counts as empty. A text fails if a measure of the table is out of bounds; a share of
    nothing is 0. Repeated rows stay repeated, texts are read whole, and no Python runs.
    """
    rows = packed(docs).select(
        F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != text_col]).alias("row"),
        _counts(F.coalesce(F.col("row")[text_col], F.lit(""))).alias("counts"))
    shown = _measures(F.col("counts"))
    return rows.select(
        "row", "counts", F.struct(*[m.alias(n) for n, m in shown.items()]).alias("measures")
    ).select("*", compile_rules(thresholds, {n: F.col("measures")[n] for n in shown}).alias("failed")
             ).withColumn("kept", F.size("failed") == 0)
