"""Near-duplicates by BagMinHash signatures of five-word shingle multisets.

Every shingle owns independent Poisson processes over the weight intervals [0,1), [1,2), [2,4), [4,8), ... A
point has a time, a register and a weight position; a text with the shingle ``c`` times sees the points below
``c``, and a register keeps its earliest point. Two registers agree with the probability of the weighted
Jaccard similarity. Only points up to the time by which all registers are likely filled are made; if one stays
empty the time is doubled, so the signature does not depend on that choice.

Texts with the same multiset become one class first. Classes whose signatures share a band are candidates,
which are compared exactly: first all of a bucket with its most typical member, which connects most of it, and
then only what is left outside with the rest, in blocks. Pairs of a bucket are never emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captrellis.llm.common import LOWER_WORDS, bounded_batches, hash_words, mix, slices, windows, words
from captrellis.llm.components import connect
from captrellis.session import stage

SHINGLE = 5
SIMILARITY = 0.8
#: 24 bands of 4 registers miss a pair of similarity 0.8 with probability 3e-6.
BANDS, ROWS = 24, 4
#: Members and queries in one cell of the comparison within a group.
BLOCK = 400
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _nth(n: int) -> np.uint64:
    """The n-th constant of a sequence that is spread over all 64-bit values."""
    return np.uint64(n * int(GOLDEN) & (1 << 64) - 1)


def multisets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, shingle hashes and counts of all texts, sorted by row and hash.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    codes, starts, dictionary = words(texts, LOWER_WORDS)
    hashed = hash_words(dictionary)[codes]
    at, grams = windows(hashed, starts, size)
    rows = np.searchsorted(starts, at, side="right") - 1
    for length in range(1, size):
        short = np.flatnonzero(np.diff(starts) == length)
        if len(short):
            flat = hashed[(starts[short][:, None] + np.arange(length)).ravel()]
            rows = np.concatenate([rows, short])
            grams = np.concatenate([grams, windows(flat, np.arange(0, len(flat) + 1, length), length)[1]])
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    if not len(rows):
        return rows, grams, np.empty(0, np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])]))
    return rows[fresh], grams[fresh], np.diff(np.concatenate([fresh, [len(rows)]]))


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(rows: np.ndarray, grams: np.ndarray, counts: np.ndarray, n: int, registers: int) -> np.ndarray:
    """One row of ``registers`` 32-bit values for each of ``n`` multisets; rows without shingles stay zero."""
    weight = np.bincount(rows, weights=counts, minlength=n)
    best = np.full(n * registers, np.inf)
    unfilled = np.flatnonzero(weight > 0)
    factor = np.log(registers) + 4
    while len(unfilled):
        limit = np.zeros(n)
        limit[unfilled] = factor / weight[unfilled]
        chosen = limit[rows] > 0
        row, gram, count = rows[chosen], grams[chosen], counts[chosen]
        low, level = 0, 0
        while len(row):
            width = max(low, 1)  # intervals [0,1), [1,2), [2,4), [4,8), ...
            _arrivals(row, mix(gram + _nth(level + 1)), count, low, width, limit[row], best, registers)
            low, level = low + width, level + 1
            more = count > low
            row, gram, count = row[more], gram[more], count[more]
        empty = ~np.isfinite(best.reshape(n, registers)).all(axis=1)
        unfilled, factor = np.flatnonzero(empty & (weight > 0)), factor * 2
    values = best.reshape(n, registers).astype(np.float32)
    values[weight == 0] = 0
    return (mix(np.ascontiguousarray(values).view(np.uint32).astype(np.uint64) + GOLDEN) >> np.uint64(32)).astype(np.uint32)


def _arrivals(row, seed, count, low, width, limit, best, registers) -> None:
    """Points of one interval's processes, in time order, until each process is past its row's limit.

    A register sees a process of rate ``width``; all registers together one of ``registers`` times that.
    """
    time, step = np.zeros(len(row)), 0
    while len(row):
        bits = mix(seed + _nth(2 * step + 1))
        time = time - np.log(_uniform(bits)) / (width * registers)
        going = time <= limit
        row, seed, count, limit, time = row[going], seed[going], count[going], limit[going], time[going]
        place = mix(seed + _nth(2 * step + 2))
        register = (place % np.uint64(registers)).astype(np.int64)
        if width > 1:
            seen = low + ((place >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64) < count
            np.minimum.at(best, row[seen] * registers + register[seen], time[seen])
        else:
            np.minimum.at(best, row * registers + register, time)
        step += 1


def _digests(rows: np.ndarray, grams: np.ndarray, counts: np.ndarray, n: int) -> list[str]:
    """128-bit digest of each multiset."""
    borders = np.searchsorted(rows, np.arange(n + 1))
    both = np.stack([grams, counts.astype(np.uint64)], axis=1)
    return [xxhash.xxh3_128_hexdigest(both[a:b].tobytes()) for a, b in zip(borders[:-1], borders[1:])]


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, band_rows: int = ROWS, also: str | None = None) -> DataFrame:
    """``id, digest, n_shingles, keys``: the multiset's 128-bit digest, its size and one 64-bit key per band.

    ``also`` names a column of longs that comes along.
    """
    bounded_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                n = part.num_rows
                rows, grams, counts = multisets(part.column(text))
                signed = signatures(rows, grams, counts, n, bands * band_rows).astype(np.uint64)
                keys = np.zeros((n, bands), np.uint64)
                for r in range(band_rows):
                    keys = mix(keys * GOLDEN + signed[:, r::band_rows] + np.uint64(r + 1))
                keys = keys.astype(np.int64)
                digests = _digests(rows, grams, counts, n)
                sizes = np.bincount(rows, weights=counts, minlength=n).astype(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands, pa.array(keys.ravel()))
                further = [part.column(c) for c in carried]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(digests, pa.string()), pa.array(sizes), lists, *further], ["id", "digest", "n_shingles", "keys", *carried]
                )

    carried = [also] if also else []
    fields = "id long, digest string, n_shingles long, keys array<long>" + "".join(f", `{c}` long" for c in carried)
    return docs.select(key, text, *carried).mapInArrow(apply, fields)


def _elements(docs: DataFrame, text: str) -> DataFrame:
    """``id, elements``: each multiset as sorted packed 64-bit values, a further one for each repetition.

    Rows whose text does not have the ``digest`` they name are left out.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rows, grams, counts = multisets(part.column(text))
                digests = _digests(rows, grams, counts, part.num_rows)
                nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                rows = np.repeat(rows, counts)
                values = np.where(nth == 0, np.repeat(grams, counts), mix(np.repeat(grams, counts) + nth.astype(np.uint64) * GOLDEN))
                order = np.lexsort((values, rows))
                rows, values = rows[order], values[order]
                borders = np.searchsorted(rows, np.arange(part.num_rows + 1))
                packed = [values[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:])]
                out = pa.RecordBatch.from_arrays([part.column("id"), pa.array(packed, pa.binary())], ["id", "elements"])
                own = [a == b for a, b in zip(digests, part.column("digest").to_pylist())]
                yield out.filter(pa.array(own, pa.bool_()))

    return docs.select("id", "digest", text).mapInArrow(apply, "id long, elements binary")


def _similar(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose multisets have a weighted Jaccard similarity of at least ``threshold``."""
    sides = pairs.join(elements.selectExpr("id AS b", "elements AS eb"), "b").join(
        elements.selectExpr("id AS a", "elements AS ea"), "a"
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ea"), batch.column("eb")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(shared >= threshold * (len(x) + len(y) - shared) - 1e-9)
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield kept

    return sides.select("a", "b", "ea", "eb").mapInArrow(apply, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY
) -> DataFrame:
    """``key, class_id, copy_of, n_shingles``: every document with its near-duplicate class.

    Classes are connected components of documents whose five-word shingle multisets overlap by at least
    ``threshold``; ``class_id`` is the smallest key of the class, ``copy_of`` the smallest key with the same multiset.
    Words are runs of ASCII letters, digits and non-ASCII characters, in lower case. Texts without words (null,
    empty) resemble nothing, not even each other, and are classes of their own. ``key`` must be an integer; rows
    with a null key are each a class of their own with null ids. A repeated key is one document per row: classes are
    made of texts, keys only name them, so that rows of one key can be in several classes.
    """
    return near_duplicate_rows(docs, key, text, threshold).select(F.col("id").alias(key), "class_id", "copy_of", "n_shingles")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the one with the smallest key.

    Of rows of that class with that key, the one with the smallest hash of its text stays, and of equal texts the
    smallest row. Rows without a key all stay; of texts without words only rows with equal key and text are repeated.
    Columns may have any name but ``_text_hash`` and any type that has an order.
    """
    rows = near_duplicate_rows(docs.where(F.col(key).isNotNull()), key, text, threshold).where("first")
    firsts = stage(rows.groupBy(F.col("id").alias(key), F.col("text_hash").alias("_text_hash")).agg(F.count("*").alias("_rows")), "bag-firsts")
    hashed = docs.withColumn("_text_hash", F.xxhash64(text))
    once = hashed.join(firsts.where("_rows = 1"), [key, "_text_hash"], "left_semi").select(*docs.columns)
    # Rows that are repeated as a whole shrink before they move.
    many = hashed.join(firsts.where("_rows > 1"), [key, "_text_hash"], "left_semi")
    many = many.groupBy(key, "_text_hash").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return once.unionByName(many).unionByName(docs.where(F.col(key).isNull()))


def near_duplicate_rows(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """``id, text_hash, class_id, copy_of, n_shingles, first``: see :func:`near_duplicates`.

    ``first`` marks the smallest ``(id, text_hash)`` of a class, and all texts without words or key.
    """
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("_text")).withColumn("text_hash", F.xxhash64("_text"))
    found = stage(sketch(source, "id", "_text", also="text_hash"), "bag-sketches")
    worded = found.where("n_shingles > 0 AND id IS NOT NULL")
    copies = worded.groupBy("digest").agg(F.min(F.struct("id", "text_hash")).alias("head"), F.first("keys").alias("keys"))
    # Every distinct multiset is a node of its own, whatever keys its texts have. The numbers hold once they are written.
    copies = stage(copies.select(F.monotonically_increasing_id().alias("id"), "digest", "head", "keys"), "bag-copies")
    banded = copies.selectExpr("id", "posexplode(keys) AS (band, bucket)")
    shared = banded.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(banded.join(shared, ["band", "bucket"]), "bag-buckets")
    # A member of large buckets in many bands resembles most of its group: it makes the best pivot.
    degrees = members.groupBy("id").agg(F.sum("size").alias("degree"))
    members = stage(members.drop("size").join(degrees, "id"), "bag-members")
    labels = members.select("id").distinct().withColumn("label", F.col("id"))
    labels = stage(labels, "bag-labels")
    # Only classes that share a bucket are compared, so only one text of each is read again.
    wanted = copies.join(labels, "id").selectExpr("id", "digest", "head.id AS _key", "head.text_hash AS _hash")
    texts = source.where("_text IS NOT NULL").withColumnsRenamed({"id": "_key", "text_hash": "_hash"}).join(wanted, ["_key", "_hash"])
    elements = stage(_elements(texts, "_text").dropDuplicates(["id"]), "bag-elements")
    # First every member meets the one member of its bucket that resembles most others.
    central = F.max(F.struct("degree", F.negative("id").alias("minus"))).alias("best")
    centers = members.groupBy("band", "bucket").agg(central).selectExpr("band", "bucket", "-best.minus AS center")
    groups = stage(members.join(centers, ["band", "bucket"]).select("center", "id").distinct(), "bag-groups")
    stars = groups.where("center <> id").selectExpr("least(id, center) AS a", "greatest(id, center) AS b").distinct()
    links = stage(_similar(stars, elements, threshold), "bag-stars")
    labels = connect(labels, links)
    # Then those that it does not connect meet all members of the group.
    rest = stage(_outside(groups, labels, elements, threshold), "bag-links")
    labels = connect(labels, rest)
    headed = copies.select("id", "digest", "head").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    tops = headed.groupBy("label").agg(F.min("head").alias("top"))
    of = headed.join(tops, "label").select(F.col("digest").alias("_digest"), "head", "top")
    held = found.withColumn("_digest", F.expr("IF(n_shingles > 0 AND id IS NOT NULL, digest, NULL)"))
    return held.join(of, "_digest", "left").select(
        "id",
        "text_hash",
        F.coalesce("top.id", "id").alias("class_id"),
        F.coalesce("head.id", "id").alias("copy_of"),
        "n_shingles",
        F.expr("top IS NULL OR top = struct(id, text_hash)").alias("first"),
    )


def _outside(groups: DataFrame, labels: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` that join components within a group (``center, id``).

    Of two components in a group at least one lies outside its center's. So the members outside are compared with
    all members, block by block: rows are copied to the cells of a grid of blocks, never paired, and a cell counts
    shared elements by one look-up per query and gives at most one link per query and component. A group inside
    one component has no queries and is left out.
    """
    own = labels.selectExpr("id AS center", "label AS central")
    named = groups.join(labels, "id").join(own, "center").withColumn("outside", F.expr("label <> central"))
    sizes = named.groupBy("center").agg(F.count("*").alias("members"), F.count_if("outside").alias("queries")).where("queries > 0")
    sizes = sizes.selectExpr("center", f"ceil(members / {BLOCK}) AS rows", f"ceil(queries / {BLOCK}) AS columns")
    open_ = named.join(sizes, "center").join(elements, "id")
    place = "pmod(xxhash64(id), {0})"
    members = open_.selectExpr("center", place.format("rows") + " AS row", "explode(sequence(0, columns - 1)) AS column", "id", "label", "false AS query", "elements")
    queries = open_.where("outside").selectExpr("center", "explode(sequence(0, rows - 1)) AS row", place.format("columns") + " AS column", "id", "label", "true AS query", "elements")

    def cell(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        ids, of = (table.column(c).to_numpy() for c in ("id", "label"))
        held = [np.frombuffer(e, np.uint64) for e in table.column("elements").to_pylist()]
        there = np.flatnonzero(~query)
        sizes = np.array([len(held[i]) for i in there], np.int64)
        values = np.concatenate([held[i] for i in there]) if len(there) else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(there)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        a, b = [], []
        for q in np.flatnonzero(query):
            low = np.searchsorted(values, held[q], "left")
            count = np.searchsorted(values, held[q], "right") - low
            at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            shared = np.bincount(owner[at], minlength=len(there))
            fits = (of[there] != of[q]) & (shared >= threshold * (sizes + len(held[q]) - shared) - 1e-9)
            for i in np.unique(of[there][fits], return_index=True)[1]:
                other = ids[there][fits][i]
                a.append(min(ids[q], other))
                b.append(max(ids[q], other))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.unionByName(queries).groupBy("center", "row", "column").applyInArrow(cell, "a long, b long").distinct()
