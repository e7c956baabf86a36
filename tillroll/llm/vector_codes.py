"""Vector compression: each part of a vector becomes the number of its nearest codebook entry.

Codebooks are refined by rounds of assignment and averaging in whole numbers, so every order of the
sums gives the same entries. The nearest entry is found in a GNAT over the part's entries. A round
is one pass over the vectors: tasks return a sum and a count for each entry they used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillroll.llm import gnat
from tillroll.llm.common import Batches, batch_of, packed, small_batches, stored

Codebooks = np.ndarray  # part, entry, component


def _integers(batch: pa.RecordBatch, dims: int, scale: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, the kept vectors in whole numbers)."""
    lists = batch.column("vector")
    lengths = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
    keep = np.asarray(lists.is_valid()) & (lengths == dims)
    kept = lists.filter(pa.array(keep))
    flat = kept.flatten()
    values = np.asarray(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)
    keep[np.flatnonzero(keep)[~finite]] = False
    values = np.clip(values[finite], -bound / scale, bound / scale)  # scale is a power of two: exact
    return keep, np.floor(values * scale).astype(np.int64)


def _parts(vectors: np.ndarray, parts: int) -> np.ndarray:
    """part, vector, component."""
    return vectors.reshape(len(vectors), parts, vectors.shape[1] // parts).transpose(1, 0, 2)


def _sums(codebooks: Codebooks, dims: int, scale: int, bound: int):
    """Per task: part, entry, sum of the assigned parts, their number."""
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        trees = [gnat.build(book) for book in codebooks]
        n_parts, n_entries, width = codebooks.shape
        total = np.zeros((n_parts, n_entries, width), np.int64)
        count = np.zeros((n_parts, n_entries), np.int64)
        for batch in batches:
            _, vectors = _integers(batch, dims, scale, bound)
            for p, mine in enumerate(_parts(vectors, n_parts)):
                mine = np.ascontiguousarray(mine)
                found, _, _ = gnat.nearest(trees[p], codebooks[p], mine)
                used = np.bincount(found, minlength=n_entries)
                if len(mine):
                    begins = np.cumsum(used) - used
                    total[p, used > 0] += np.add.reduceat(
                        mine[np.argsort(found, kind="stable")], begins[used > 0], axis=0)
                count[p] += used
        part, entry = np.nonzero(count)
        schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()),
                            *((f"c{k}", pa.int64()) for k in range(width))])
        yield batch_of(schema, part.astype(np.int32), entry.astype(np.int32), count[part, entry],
                       *total[part, entry].T)

    return run


def _codes(codebooks: Codebooks, dims: int, scale: int, bound: int):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        trees = [gnat.build(book) for book in codebooks]
        for batch in batches:
            keep, vectors = _integers(batch, dims, scale, bound)
            code, error = np.zeros((len(vectors), len(codebooks)), np.int64), np.zeros(len(vectors), np.int64)
            for p, mine in enumerate(_parts(vectors, len(codebooks))):
                code[:, p], square, _ = gnat.nearest(trees[p], codebooks[p], np.ascontiguousarray(mine))
                error += square
            row = batch.column("row").filter(pa.array(keep))
            schema = pa.schema([("row", row.type), ("code", pa.binary()), ("error", pa.int64())])
            yield batch_of(schema, row, [c.tobytes() for c in code.astype(np.uint8)], error)

    return run


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8, entries: int = 16,
        rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks of all usable vectors; see ``compress``. Without any, a codebook has no entries."""
    if not 1 <= entries <= 256 or parts < 1 or scale < 1 or scale & (scale - 1):
        raise ValueError("entries lie between 1 and 256, and scale is a power of two")
    spark = vectors.sparkSession
    small_batches(spark)
    rows = _rows(vectors, id_col, vector_col)
    usable = rows.where(_usable(F.col("vector")))
    # at most `entries` rows, whatever the input; their length is the length of all
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    shortest = usable.orderBy(*order).limit(1).select(F.size("vector").alias("n")).collect()
    dims = shortest[0].n if shortest else 0
    if dims == 0 or dims % parts:
        return np.zeros((parts, 0, dims // parts), np.int64)
    first = usable.where(F.size("vector") == dims).orderBy(*order).limit(entries).select("vector").collect()
    bound = _bound(dims)
    start = np.clip(np.array([r.vector for r in first], np.float64), -bound / scale, bound / scale)
    books = np.ascontiguousarray(_parts(np.floor(start * scale).astype(np.int64), parts))
    width = dims // parts
    schema = "part int, entry int, n long, " + ", ".join(f"c{k} long" for k in range(width))
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(_sums(books, dims, scale, bound), schema).groupBy("part", "entry").agg(
            *[F.sum(c).alias(c) for c in ("n", *(f"c{k}" for k in range(width)))])
        books = books.copy()
        for r in sums.collect():  # one row an entry
            books[r.part, r.entry] = [r[f"c{k}"] // r.n for k in range(width)]
    return books


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    row = F.col("row")
    return packed(vectors).select(
        row[id_col].alias("id"), row[vector_col].cast("array<double>").alias("vector"),
        F.struct(*[row[c].alias(c) for c in vectors.columns if c != vector_col]).alias("row"))


def _bound(dims: int) -> int:
    """Components are held within this, so that squared distances over all components fit 63 bits."""
    return 1 << ((61 - max(1, dims).bit_length()) // 2)


def compress(vectors: DataFrame, codebooks: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding",
             scale: int = 4096) -> DataFrame:
    """(row, code, error) of every usable vector; row holds its other columns.

    A vector is usable if it is not null and all components are finite numbers. Component x counts as
    floor(scale x). ``code`` has a byte for each part, the index of the nearest entry (squared Euclidean
    distance, ties to the lower index), ``error`` the sum of these distances. Codebooks start as the
    parts of the vectors with the smallest ids (null last; equal ids by their vectors) and are averaged
    ``rounds`` times, rounded down; entries without parts stay, and so do entries listed twice, of
    which the first gets all parts. Fewer vectors than entries give fewer entries.

    All vectors have the length of the one with the smallest id; others are not usable, and if that
    length cannot be cut into equal parts none is. Components beyond 2^27 / scale for 64 dimensions
    (less for more) are held there, so that sums fit 64 bits. Repeated rows stay repeated.
    """
    small_batches(vectors.sparkSession)
    rows = _rows(vectors, id_col, vector_col)
    parts, n_entries, width = codebooks.shape
    schema = T.StructType([rows.schema["row"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    if n_entries == 0:
        return rows.sparkSession.createDataFrame([], schema)
    dims = parts * width
    return rows.select("row", "vector").mapInArrow(_codes(codebooks, dims, scale, _bound(dims)), schema)


def label_errors(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """``codes`` with ``label_error``, the error summed over the rows of the same label, null being one.

    A label may hold a large share of all rows: sums are taken in the tasks first, and stored with
    the rows, so that the join shuffles both sides for itself and can split a hot label.
    """
    codes = stored(codes)
    label = F.col("row")[label_col]
    sums = stored(codes.groupBy(label.alias("label")).agg(F.sum("error").alias("label_error")))
    return codes.join(sums, label.eqNullSafe(sums["label"])).drop("label")


def codebooks_digest(codebooks: Codebooks) -> str:
    """SHA-256, in hex, of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
