"""Line dedup: lines found in several documents stay in one of them; built-in functions only.

1. A line's key is named by two 64-bit hashes. The named lines are dealt out by range of (name,
   document) and sorted by name, document and position, so that equal lines stand side by side. A
   line found in a third of all documents spreads over as many tasks as its rows need.
2. The first line of each (name, document) goes on. Names are counted over these; tasks count
   before they send, so a name arrives once a task. Names found too rarely are dropped.
3. Lines whose name is left and whose document is not the one that keeps it make the bitmaps.

A bitmap has a bit a line and is compressed to its run lengths: lines kept, dropped, kept, and so
on. Texts take no part but in the last step, and only if the caller asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.llm.common import lower_ascii, packed, stored, text_hash

BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keys(text: Column) -> Column:
    """The key of every line. Text that is all ASCII takes the faster way to lower case."""
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.transform(_lines(lower), lambda line: F.trim(line, F.lit(BLANKS)))


def _with_runs(rows: DataFrame) -> DataFrame:
    """``keep`` from ``dropped``, the sorted positions of dropped lines, and ``n_lines``."""
    dropped = F.col("dropped")
    begins = F.filter(dropped, lambda at, k: F.coalesce(F.get(dropped, k - 1) + 1 != at, F.lit(True)))
    ends = F.filter(dropped, lambda at, k: F.coalesce(F.get(dropped, k + 1) - 1 != at, F.lit(True)))
    rows = rows.select("*", begins.alias("begins"), ends.alias("ends"))
    rest = F.col("n_lines") - F.element_at("ends", -1) - 1
    pairs = F.zip_with(F.col("begins"), F.transform(F.col("ends"), lambda at, k: F.struct(
        at.alias("at"), F.coalesce(F.get(F.col("ends"), k - 1) + 1, F.lit(0)).alias("from"))),
        lambda begin, end: F.array(begin - end["from"], end["at"] - begin + 1))
    return rows.withColumn("keep", F.concat(F.flatten(pairs), F.when(rest > 0, F.array(rest)).otherwise(
        F.array().cast("array<int>")))).drop("begins", "ends")


def _left(text: Column, keep: Column) -> Column:
    """The lines that the bitmap keeps, joined by line feeds."""
    bits = F.flatten(F.transform(keep, lambda n, k: F.array_repeat(k % 2 == 0, n)))
    return F.array_join(F.filter(
        F.zip_with(_lines(text), bits, lambda line, bit: F.when(bit, line)), lambda line: line.isNotNull()), "\n")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20,
                 least_docs: int = 3) -> DataFrame:
    """(id, th, n_dropped, keep) of the documents that lose lines; th is a hash of the text.

    A text is split at line feeds; null and empty texts have one empty line. A line's key is the line
    without ASCII white space at both ends, A-Z in lower case. A key of at least ``least_chars``
    characters found in at least ``least_docs`` documents loses all its lines but those in the document
    with the largest id. Rows that share an id count as one document and all rows without an id as
    another, which comes before all others. Keys are equal if two 64-bit hashes of them are.
    """
    row, key = F.col("row"), F.col("key")
    lines = packed(docs).select(
        row[id_col].alias("id"), text_hash(row[text_col]).alias("th"),
        F.size(_lines(row[text_col])).alias("n_lines"), F.posexplode(_keys(row[text_col])).alias("pos", "key")
    ).where(F.char_length("key") >= least_chars)
    # stored, for the ranges are found from a sample of the rows and the rows are read once more below
    lines = stored(lines.select(
        "id", "th", "n_lines", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))

    dealt = lines.repartitionByRange("h1", "h2", "id")
    place = F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy("th", "pos"))
    repeated = stored(
        dealt.select("h1", "h2", "id", place.alias("place")).where("place = 1")
        .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= least_docs)
        .select("h1", "h2", "keeper"))
    # both sides are read from storage, so that the join can split a hot name
    dropped = lines.join(repeated, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    bitmaps = dropped.groupBy("id", "th").agg(
        F.array_sort(F.collect_set("pos")).alias("dropped"), F.max("n_lines").alias("n_lines"))
    return _with_runs(bitmaps).select("id", "th", F.size("dropped").alias("n_dropped"), "keep")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20,
                least_docs: int = 3) -> DataFrame:
    """(row, n_lines, n_dropped, keep, kept) of every row of ``docs``; row holds its other columns.

    ``keep`` is the bitmap of the row's lines as run lengths: so many kept, then dropped, then kept
    lines. ``kept`` is the text of the lines kept, joined by line feeds; null and empty texts give an
    empty one, and a text that loses nothing is returned as it is. Leave ``kept`` out of the selection and
    no text is shuffled. Which lines go: see ``keep_bitmaps``. Repeated rows stay repeated.
    """
    # stored, so that the join shuffles both sides for itself and can split rows that repeat
    bitmaps = stored(keep_bitmaps(docs, id_col, text_col, least_chars, least_docs))
    bitmaps = bitmaps.select(F.col("id").alias("of"), F.col("th").alias("hash"), "n_dropped", "keep")
    row, text = F.col("row"), F.col("text")
    texts = packed(docs).select(
        row[id_col].alias("id"), text_hash(row[text_col]).alias("th"), row[text_col].alias("text"),
        F.size(_lines(row[text_col])).alias("n_lines"),
        F.struct(*[row[c].alias(c) for c in docs.columns if c != text_col]).alias("row"))
    # a merge join at every size, for the bitmaps grow with the input
    found = texts.hint("merge").join(
        bitmaps, (F.col("th") == F.col("hash")) & F.col("id").eqNullSafe(F.col("of")), "left")
    return found.select(
        "row", "n_lines", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
        F.coalesce("keep", F.array("n_lines")).alias("keep"),
        F.when(F.col("keep").isNull(), F.coalesce(text, F.lit(""))).otherwise(_left(text, F.col("keep"))).alias("kept"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20,
               least_docs: int = 3) -> DataFrame:
    """``docs`` without the lines that stay elsewhere; a null text becomes empty."""
    found = dedup_lines(docs, id_col, text_col, least_chars, least_docs)
    return found.select(*[
        F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
