"""Product codes of vectors: Lloyd rounds over integers, with Drake-Hamerly bounds kept between the rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlens.llm.common import batches_of, discard, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Share of parts that may need all entries anew before fewer kept bounds are thought too few.
SPILL = 0.05
#: Labels that more than one row in so many has are joined by broadcast: there are fewer of them than this.
COMMON = 1000
_INT = {2: np.int16, 4: np.int32, 8: np.int64}
_STATE = "vec_id {id}, label {label}, x binary, code binary, near binary, low binary, error long, tally array<long>"


class Codebook:
    """Entries of all parts, (parts, entries, width) integers; what they moved since the codebook before, rounded up."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        moved = np.zeros(entries.shape[:2]) if before is None else np.sqrt(((entries - before).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-9)
        self.moved, self.most = moved, moved.max(axis=1, initial=0.0)

    def updated(self, sums: np.ndarray) -> "Codebook":
        """Componentwise floor of sum / count; an entry without parts stays.  ``sums`` is (parts, entries, width + 1), the count last."""
        n = sums[:, :, -1:]
        return Codebook(np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), self.entries), self.entries)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows (n, width) to entries (k, width) or to own entries (n, c, width)."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 1 << 52:  # every product and sum is a whole number that a double holds
        x, entries = x.astype(np.float64), entries.astype(np.float64)
        if entries.ndim == 2:
            return ((x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)).astype(np.int64)
    if entries.ndim == 2:
        return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)
    return ((x[:, None, :] - entries) ** 2).sum(axis=2).astype(np.int64)


def _root_below(squares: np.ndarray) -> np.ndarray:
    """Square roots as 32-bit floats that never exceed the true ones."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


def _anew(x: np.ndarray, entries: np.ndarray, b: int):
    """Nearest entry, the b next ones in order, their bounds and the bound of all others, last; and the squared distance."""
    d = _squares(x, entries)
    order = np.argsort(d, axis=1, kind="stable")  # equal distances: lower index first
    sorted_d = np.take_along_axis(d, order, axis=1)
    low = np.full((len(x), b + 1), np.inf, np.float32)
    have = min(b + 1, d.shape[1] - 1)
    low[:, :have] = _root_below(sorted_d[:, 1:have + 1])
    near = np.zeros((len(x), b), np.uint8)
    near[:, :min(b, have)] = order[:, 1:min(b, have) + 1]
    return order[:, 0].astype(np.uint8), near, low, sorted_d[:, 0]


def _reassign(x: np.ndarray, book: Codebook, part: int, code: np.ndarray, near: np.ndarray, low: np.ndarray, b: int):
    """One part of all rows against a codebook that moved; also how many kept entries each row had to look at (len + 1: all).

    Bounds shrink by what their entries moved; from the outer bound inwards a bound never exceeds the next, so the z-th one
    holds for every entry from place z on.  The distance to the own entry is exact.  Where it lies below the first bound
    nothing changed; else the entries before the first bound that it lies below are compared in whole numbers, ties going to
    the lower index; where no bound is above it, all entries are.  A case too near to call counts as not below.
    """
    entries, had = book.entries[part], near.shape[1]
    own = _squares(x, entries[code][:, None, :])[:, 0]
    low = low.astype(np.float64)
    low[:, :had] -= book.moved[part][near]
    low[:, had] -= book.most[part]
    low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1] * (1 - 1e-9) - 1e-9
    low = np.maximum(np.nextafter(low.astype(np.float32), np.float32(-np.inf)), np.float32(0))
    below = np.sqrt(own.astype(np.float64))[:, None] * (1 + 1e-9) < low
    need = np.where(below.any(axis=1), below.argmax(axis=1), had + 1)
    new_code, new_near, new_low, best = code.copy(), near.copy(), low, own.copy()
    for z in np.unique(need):
        if z == 0:
            continue
        at = np.flatnonzero(need == z)
        if z == had + 1:
            new_code[at], kept, bounds, best[at] = _anew(x[at], entries, had)
            new_near[at], new_low[at] = kept, bounds
            continue
        ids = np.concatenate([code[at, None], near[at, :z]], axis=1)
        ids.sort(axis=1)  # a stable order by distance then prefers the lower index
        d = _squares(x[at], entries[ids])
        order = np.argsort(d, axis=1, kind="stable")
        ids, d = np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)
        new_code[at], best[at] = ids[:, 0], d[:, 0]
        new_near[at, :z] = ids[:, 1:]
        new_low[at, :z] = _root_below(d[:, 1:])
    if b < had:  # fewer bounds from now on: the outer one takes in those that go
        new_low = np.concatenate([new_low[:, :b], new_low[:, b:].min(axis=1, keepdims=True)], axis=1)
        new_near = new_near[:, :b]
    return new_code, np.ascontiguousarray(new_near), new_low, best, need


def _ints(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of arrays of equal length, filled up with zeros to ``width`` values each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(scale * flat).astype(np.int64).reshape(len(column), -1)
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of whole numbers in the smallest type that holds all of them."""
    most = int(np.abs(x).max(initial=0))
    return _rows(x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64))


def _rows(x: np.ndarray) -> pa.Array:
    n, size = len(x), x.dtype.itemsize * (x.size // max(len(x), 1))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _unpacked(column: pa.Array, kind, width: int) -> np.ndarray:
    """Rows of binary values of equal length, as ``kind`` or as the type their length tells."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    if kind is None:
        sizes = np.diff(offsets) // max(width, 1)
        out = np.empty((len(column), width), np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            where = (offsets[at] - offsets[0])[:, None] + np.arange(size * width)
            out[at] = data[where].view(_INT[int(size)])
        return out
    return data.view(kind).reshape(len(column), width)


def _round(book: Codebook, first: bool, b: int, kept: int, scale: int, fields: list[str], types: list):
    """A function over Arrow batches: one assignment of all parts; the task's last row tells what moved.

    The tally is, per part and entry, the sums of the components and the count that the entry won or lost, and per part how
    many rows looked at 0, 1, ... kept entries.
    """
    parts, k, width = book.entries.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, looked = np.zeros((parts, k, width + 1), np.int64), np.zeros((parts, kept + 2), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _ints(batch.column("embedding"), parts * width, scale) if first else _unpacked(batch.column("x"), None, parts * width)
            ones = np.concatenate([x.reshape(n, parts, width), np.ones((n, parts, 1), np.int64)], axis=2)
            code, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            near, low = np.empty((n, parts, b), np.uint8), np.empty((n, parts, b + 1), np.float32)
            if not first:
                old = _unpacked(batch.column("code"), np.uint8, parts)
                old_near = _unpacked(batch.column("near"), np.uint8, parts * kept).reshape(n, parts, kept)
                old_low = _unpacked(batch.column("low"), np.float32, parts * (kept + 1)).reshape(n, parts, kept + 1)
            for p in range(parts):
                own = np.ascontiguousarray(ones[:, p, :-1])
                if first:
                    code[:, p], near[:, p], low[:, p], best = _anew(own, book.entries[p], b)
                    moved = np.arange(n)
                else:
                    code[:, p], near[:, p], low[:, p], best, need = _reassign(own, book, p, old[:, p], old_near[:, p], old_low[:, p], b)
                    looked[p] += np.bincount(need, minlength=kept + 2)
                    moved = np.flatnonzero(code[:, p] != old[:, p])
                    np.subtract.at(sums[p], old[moved, p], ones[moved, p])
                np.add.at(sums[p], code[moved, p], ones[moved, p])
                error += best
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), _packed(x), _rows(code), _rows(near.reshape(n, -1)), _rows(low.reshape(n, -1)),
                 pa.array(error), pa.nulls(n, pa.list_(pa.int64()))], fields)
        tally = pa.array([np.concatenate([sums.ravel(), looked.ravel()])], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in types] + [pa.nulls(1, pa.binary())] * 4 + [pa.nulls(1, pa.int64()), tally], fields)
    return assign


def _tallies(state: DataFrame, shape: tuple, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the tasks, added up by place: as many values as the codebook has, whatever the rows."""
    rows = (state.where("tally is not null").select(F.posexplode("tally").alias("at", "v")).where("v <> 0")
            .groupBy("at").agg(F.sum("v").alias("v")).collect())
    parts, k, width = shape
    out = np.zeros(parts * k * (width + 1) + parts * (kept + 2), np.int64)
    for r in rows:
        out[r["at"]] = r["v"]
    cut = parts * k * (width + 1)
    return out[:cut].reshape(parts, k, width + 1), out[cut:].reshape(parts, kept + 2)


def _fewer(looked: np.ndarray, b: int, least: int) -> int:
    """How many bounds to keep next: as few as answer all but a small share of the parts, between ``least`` and ``b``."""
    seen = looked.sum(axis=0)
    beyond = seen.sum() - np.cumsum(seen)  # rows that looked at more than z entries
    enough = np.flatnonzero(beyond <= SPILL * seen.sum())
    return int(min(max(enough[0] if len(enough) else b, least), b))


def _kept(vectors: DataFrame, d: int | None = None, scale: int = SCALE) -> DataFrame:
    most = None if d is None else float(int((2.0 ** 62 / d) ** 0.5 / 2 / scale))
    v = F.col("embedding")
    def fine(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < (F.lit(float("inf")) if most is None else F.lit(most)))
    out = vectors.where(v.isNotNull() & (F.size(v) > 0)).where(F.forall(v, fine))
    return out if d is None else out.where(F.size(v) == d)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             bounds: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors of (vec_id, embedding, label) and the codebooks, (parts, entries, width) integers.

    Returns (vec_id, label, code, error): code is binary, one entry index per part; error the final squared distance.
    Components are floor(scale * x).  An entry starts as its part of one of the smallest vec_ids; each round assigns all parts
    (ties to the lower index) and moves each entry to the floor of its mean; parts are assigned once more at the end.

    Between rounds a row keeps, per part, its entry, the ``bounds`` next ones with lower bounds, and one bound of all others
    (a quarter of the entries at first, later as few as the last round made use of, an eighth at least).  The state is a written table, two at a time; the
    driver holds codebooks and per-entry sums, whose size the parameters fix.  When no part moved, the remaining rounds
    would change nothing and are left out.

    Dropped: vectors that are null or empty, hold null or non-finite components, differ in length from the one with the smallest id,
    or are so large that a squared distance might pass 64 bits.  A length that ``parts`` does not divide is filled up with zeros.  Of
    rows that repeat an id the smallest vector makes the entry, all are coded; a null id comes last; fewer ids than
    entries give as many entries; no vector gives no rows and an empty codebook.
    """
    spark = vectors.sparkSession
    given = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    any_length = _kept(given)
    lead = any_length.select("vec_id", F.size("embedding").alias("d")).orderBy(F.col("vec_id").asc_nulls_last(), "d").first()
    kinds = {"id": given.schema["vec_id"].dataType.simpleString(), "label": given.schema["label"].dataType.simpleString()}
    if lead is None:
        return spark.createDataFrame([], f"vec_id {kinds['id']}, label {kinds['label']}, code binary, error long"), np.zeros((parts, 0, 0), np.int64)
    kept = _kept(given, lead["d"], scale)
    width = -(-lead["d"] // parts)
    ids = kept.select(F.col("vec_id").alias("_id")).distinct().orderBy(F.col("_id").asc_nulls_last()).limit(entries)
    start = (kept.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("_id"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
             .orderBy(F.col("vec_id").asc_nulls_last()).collect())
    if not start:
        return spark.createDataFrame([], f"vec_id {kinds['id']}, label {kinds['label']}, code binary, error long"), np.zeros((parts, 0, 0), np.int64)
    first = _ints(pa.array([r["embedding"] for r in start], pa.list_(pa.float64())), parts * width, scale)
    book = Codebook(first.reshape(len(start), parts, width).transpose(1, 0, 2).copy())
    k = len(start)
    least = max(min(k // 8, k - 1), 1)
    b = max(min(bounds or k // 4, k - 1), 1)
    schema = _STATE.format(**kinds)
    fields = [f.split()[0] for f in schema.split(", ")]
    types = [_arrow(given.schema[c].dataType) for c in ("vec_id", "label")]
    with batches_of(spark, 4096, "16m"):
        state = written(kept.mapInArrow(_round(book, True, b, b, scale, fields, types), schema), "codes-state")
        sums, _ = _tallies(state, book.entries.shape, b)
        held = b
        for done in range(1, rounds + 1):
            book = book.updated(sums)
            last, old = done == rounds, state
            step = _round(book, False, b, held, scale, fields, types)
            state = written(old.where("tally is null").mapInArrow(step, schema), "codes-state")
            discard(old)
            moved, looked = _tallies(state, book.entries.shape, held)
            held, b = b, _fewer(looked, b, least)
            sums = sums + moved
            if not last and not moved.any() and not (book.updated(sums).entries != book.entries).any():
                break
    out = written(state.where("tally is null").select("vec_id", "label", "code", "error"), "codes")
    discard(state)
    return out, book.entries


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def code_text(code: Column) -> Column:
    """Two lower-case hex digits for each part."""
    return F.lower(F.hex(code))


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels, nulls together.  Common labels are joined by broadcast: they are few."""
    per = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    total = codes.count()
    per = written(per.withColumnRenamed("label", "_label"), "codes-labels")
    common = per.where(F.col("_n") * COMMON > total).drop("_n")
    rare = per.where(F.col("_n") * COMMON <= total).select("_label", F.col("label_error").alias("_rare"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    out = codes.join(F.broadcast(common), same, "left").drop("_label")
    out = out.where("label_error is not null").unionByName(
        out.where("label_error is null").drop("label_error").join(rare, same, "left").drop("_label").withColumnRenamed("_rare", "label_error"))
    return out


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select("vec_id", code_text(F.col("code")).alias("code"), "error", "label_error",
                                          F.lit(hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    steps = ["""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT rid, (i - 1) // (d // 8) AS part, (i - 1) % (d // 8) AS pos, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
    FROM (SELECT rid, embedding, len(embedding) AS d, unnest(generate_series(1, len(embedding))) AS i FROM kept)),
e0 AS MATERIALIZED (SELECT part, k AS entry, pos, x AS c
    FROM v JOIN (SELECT min(rid) AS rid, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept GROUP BY vec_id) USING (rid) WHERE k < 16)"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, part, min({{'d': d, 'e': entry}}) AS best FROM (
    SELECT rid, part, entry, sum((x - c) * (x - c)) AS d FROM v JOIN e{r} USING (part, pos) GROUP BY rid, part, entry) GROUP BY rid, part)""")
        if r < ROUNDS:
            steps.append(f"""e{r + 1} AS MATERIALIZED (SELECT e.part, e.entry, e.pos, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c
    FROM e{r} e LEFT JOIN (SELECT part, best.e AS entry, pos, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (rid, part) GROUP BY ALL) m
    ON m.part = e.part AND m.entry = e.entry AND m.pos = e.pos)""")
    steps.append(f"""done AS (SELECT vec_id, label, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
    FROM a{ROUNDS} JOIN kept USING (rid) GROUP BY rid, vec_id, label)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM e{ROUNDS}) AS codebooks_sha256 FROM done"""


OP13_SQL = _sql()
