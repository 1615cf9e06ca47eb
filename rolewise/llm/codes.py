"""Vector codes learned and given through tries over distinct parts.

Vectors become integers and are cut into `PARTS` equal parts; each part position
has a codebook of up to `ENTRIES` entries, learned in `ROUNDS` rounds.

The distinct parts of a position, sorted, are the leaves of a lexicographic trie:
a node at depth d is a prefix of d components. Going down depth first, a node
hands its children one vector, the distances of its prefix to all entries; a
child adds the distances of its own components, so parts with a common prefix
share the work for it. Chains without a branch are one edge. At a leaf the
vector is complete: its smallest place is the code, and the part counts for its
entry with its weight, the number of vectors that have it.

Distinct parts are counted before they are laid out, in ranges of (position,
part), so copies of a vector cost one row and a task holds neighbours in the
trie. A round sends the codebooks out (ENTRIES times the dimension numbers, the
only thing that passes the driver) and brings back sums per task and entry. The
last assignment runs over the vectors, with one trie per batch and position.

Distances are whole numbers in doubles and exact: components are held to
`LIMIT` in absolute value, far outside vectors of a usual scale.

Cases: a vector that is null or holds null, NaN or infinite components is left
out, as the contract of op13 says; the dimension is that of the smallest vec_id
whose vector can be cut, and a vector of another length keeps its row with null
code and error; several vectors of one vec_id count each, and the smallest of
them starts an entry; a null vec_id is coded and starts none; fewer than ENTRIES
ids give fewer entries; equal vectors get equal codes; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.session import cut_lineage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Bound of a component after scaling: squared distances stay exact in doubles.
LIMIT = 1 << 20
#: Rows of a batch that makes one trie.
BATCH = 4096

Books = list[np.ndarray]


def whole(vector: str = "embedding") -> Column:
    """The components as integers, null for a vector that is left out."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    scaled = F.transform(
        vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * SCALE))).cast("int"))
    return F.when(F.col(vector).isNotNull() & ~bad, scaled)


def trie_codes(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, squared distance) of distinct rows in lexicographic order.

    `book` holds the entries as rows. Depth first over the trie of `rows`; `open_`
    holds nodes as (first row, end, depth, distances of the prefix).
    """
    n, depth = rows.shape
    codes, errors = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    entries = book.astype(np.float64)
    values = rows.astype(np.float64)
    #: Squared lengths of what follows each depth, of entries and of rows.
    rest = np.concatenate([np.cumsum((entries ** 2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(entries), 1))], axis=1)

    def leaves(at: np.ndarray, d: int, above: np.ndarray) -> None:
        tails = values[at, d:]
        found = above + rest[:, d] + (tails ** 2).sum(axis=1)[:, None] - 2.0 * (tails @ entries[:, d:].T)
        codes[at] = found.argmin(axis=1)
        errors[at] = found[np.arange(len(at)), codes[at]]

    open_ = [(0, n, 0, np.zeros(len(entries)))] if n else []
    while open_:
        first, end, d, above = open_.pop()
        if end - first == 1 or d == depth:
            leaves(np.arange(first, end), d, above)
            continue
        # Rows are sorted, so first and last agree as far as all of them do.
        differ = np.flatnonzero(rows[first, d:] != rows[end - 1, d:])
        branch = d + int(differ[0]) if len(differ) else depth
        if branch > d:
            above = above + ((values[first, d:branch] - entries[:, d:branch]) ** 2).sum(axis=1)
        if branch == depth:
            leaves(np.arange(first, end), depth, above)
            continue
        column = rows[first:end, branch]
        edges = first + np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
        ends = np.append(edges[1:], end)
        single = ends - edges == 1
        if single.any():
            leaves(edges[single], branch, above)
        for start, stop in zip(edges[~single].tolist(), ends[~single].tolist()):
            open_.append((start, stop, branch + 1, above + (values[start, branch] - entries[:, branch]) ** 2))
    return codes, errors


def in_order(rows: np.ndarray) -> np.ndarray:
    """The lexicographic order of rows."""
    return np.lexsort(rows.T[::-1])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(parts: DataFrame, books: Books) -> list[tuple[int, int, int, list[int]]]:
    """(position, code, weight, sum of parts) after one assignment of all parts."""
    width = books[0].shape[1]
    sent = parts.sparkSession.sparkContext.broadcast(books)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        total = [np.zeros(b.shape, dtype=np.int64) for b in held]
        count = [np.zeros(len(b), dtype=np.int64) for b in held]
        for batch in source:
            for start in range(0, batch.num_rows, BATCH):
                cut = batch.slice(start, BATCH)
                places = cut.column("position").to_numpy()
                rows, weights = _matrix(cut.column("part")), cut.column("weight").to_numpy()
                for p in np.unique(places).tolist():
                    mine, weight = rows[places == p], weights[places == p]
                    order = in_order(mine)
                    codes, _ = trie_codes(mine[order], held[p])
                    np.add.at(total[p], codes, (mine * weight[:, None])[order])
                    np.add.at(count[p], codes, weight[order])
        for p, (t, c) in enumerate(zip(total, count)):
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(c[used]),
                 pa.array(list(t[used]), pa.list_(pa.int64()))], names=["position", "code", "weight", "total"])

    each = parts.mapInArrow(batches, "position int, code int, weight bigint, total array<bigint>")
    sums = each.groupBy("position", "code").agg(
        F.sum("weight").alias("weight"), F.array(*[F.sum(F.col("total")[k]) for k in range(width)]).alias("total"))
    found = [(r["position"], r["code"], r["weight"], r["total"]) for r in sums.collect()]
    sent.unpersist()
    return found


def dimension(kept: DataFrame, parts: int = PARTS) -> int:
    """Components of the first vector, by vec_id, that can be cut into `parts`; 0 if there is none."""
    fit = kept.where((F.size("q") > 0) & (F.size("q") % parts == 0))
    first = fit.select("vec_id", F.size("q").alias("n")).orderBy(F.asc_nulls_last("vec_id"), "n").first()
    return first["n"] if first else 0


def learn(kept: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """One codebook per part position from rows (vec_id, q) of `size` components."""
    width = size // parts
    fit = kept.where(F.size("q") == size)
    ids = [r[0] for r in fit.where("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    seeds = fit.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("q").alias("q")).collect()
    start = np.array([r["q"] for r in sorted(seeds, key=lambda r: r["vec_id"])], dtype=np.int64).reshape(-1, size)
    books = [start[:, p * width:(p + 1) * width].copy() for p in range(parts)]
    if not len(start):
        return books
    cuts = F.array(*[
        F.struct(F.lit(p).alias("position"), F.slice("q", p * width + 1, width).alias("part")) for p in range(parts)])
    counted = fit.select(F.inline(cuts)).groupBy("position", "part").agg(F.count("*").alias("weight"))
    distinct = cut_lineage(
        counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "parts")
    for _ in range(rounds):
        for p, code, weight, total in _sums(distinct, books):
            books[p][code] = np.array(total, dtype=np.int64) // weight
    return books


def coded(kept: DataFrame, books: Books) -> DataFrame:
    """The rows of `kept` with `codes` (one per part) and `error`; null for another length."""
    parts, width = len(books), books[0].shape[1]
    sent = kept.sparkSession.sparkContext.broadcast(books)
    columns = [c for c in kept.columns if c != "q"]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for whole_batch in source:
            for start in range(0, whole_batch.num_rows, BATCH):
                batch = whole_batch.slice(start, BATCH)
                q = batch.column("q")
                fits = np.array([len(v) == parts * width for v in q]) if len(q) else np.zeros(0, dtype=bool)
                rows = _matrix(q.filter(pa.array(fits))) if fits.any() else np.zeros((0, parts * width), dtype=np.int64)
                found, errors = [], np.zeros(len(rows), dtype=np.int64)
                for p in range(parts if len(rows) else 0):
                    distinct, back = np.unique(rows[:, p * width:(p + 1) * width], axis=0, return_inverse=True)
                    codes, off = trie_codes(distinct, held[p])
                    found.append(codes[back.ravel()])
                    errors += off[back.ravel()]
                told = iter(zip(np.array(found).T.tolist(), errors.tolist())) if len(rows) else iter(())
                out = [next(told) if fit else (None, None) for fit in fits]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in columns), pa.array([c for c, _ in out], pa.list_(pa.int32())),
                     pa.array([e for _, e in out], pa.int64())], names=[*columns, "codes", "error"])

    kinds = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in columns]
    return kept.select(*columns, "q").mapInArrow(batches, ", ".join([*kinds, "codes array<int>", "error bigint"]))


def digest(books: Books) -> str:
    """sha256 of all entries' components by position, entry and place, comma-joined."""
    text = ",".join(str(x) for book in books for x in book.ravel().tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """((vec_id, label, codes, error), codebooks) of a table (vec_id, embedding, label)."""
    kept = vectors.select("vec_id", "label", whole().alias("q")).where("q IS NOT NULL")
    size = dimension(kept, parts)
    if not size:
        return kept.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"),
                           F.lit(None).cast("bigint").alias("error")), [np.zeros((0, 0), dtype=np.int64)] * parts
    books = learn(kept, size, parts, entries, rounds)
    if not len(books[0]):
        return kept.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"),
                           F.lit(None).cast("bigint").alias("error")), books
    return coded(kept, books), books


def op13_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = cut_lineage(rows, "codes")
    errors = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return rows.join(errors, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """All rounds written out; a part is compared with every entry."""
    off = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = (f"SELECT p.position, p.rid, any_value(p.x) AS x, arg_min(b.i, ({off}, b.i)) AS code,"
               f" min({off}) AS off FROM p JOIN {{book}} b USING (position) GROUP BY p.position, p.rid")
    steps = []
    for k in range(ROUNDS):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(book=f'b{k}')})")
        steps.append(
            f"s{k} AS (SELECT position, code, d, sum(v) AS total, count(*) AS n FROM"
            f" (SELECT position, code, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM a{k}) GROUP BY ALL)")
        # Whole numbers all through: a floor of a quotient of doubles is not exact.
        steps.append(
            f"m{k} AS (SELECT position, code, list((total - ((total % n + n) % n)) // n ORDER BY d)::BIGINT[] AS x"
            f" FROM s{k} GROUP BY ALL)")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.position, b.i, coalesce(m.x, b.x) AS x"
                     f" FROM b{k} b LEFT JOIN m{k} m ON m.position = b.position AND m.code = b.i)")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT position, rid, list_slice(q, position * (len(q) // {PARTS}) + 1, (position + 1) * (len(q) // {PARTS})) AS x
  FROM k, range({PARTS}) AS t(position)
), f AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, arg_min(rid, rid) AS rid FROM k GROUP BY vec_id
), b0 AS MATERIALIZED (SELECT p.position, f.i, p.x FROM f JOIN p USING (rid) WHERE f.i < {ENTRIES}),
{", ".join(steps)}, z AS ({nearest.format(book=f"b{ROUNDS}")}),
g AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY position, i)) AS h FROM b{ROUNDS}),
e AS (SELECT rid, string_agg(printf('%02x', code), '' ORDER BY position) AS code, sum(off)::BIGINT AS error
      FROM z GROUP BY rid)
SELECT k.vec_id, e.code, e.error, (sum(e.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
       g.h AS codebooks_sha256
FROM k JOIN e USING (rid), g
"""


OP13_SQL = _sql()
