"""CIDEr-D over blocks of whole items; what crosses an exchange are hashes of grams, one gram length at a time.

Sentences become 64-bit word hashes once and are written in blocks of about :data:`BLOCK_BYTES` of text, all rows of an item in
one. For each gram length, blocks ask for their distinct grams, with the number of their items that
have each in a reference; tasks that own a range of hashes add these up and answer with the grams that at least two
items have. A gram is asked for only if both grams of one word less in it had an answer, since an item that has
the gram has these too. The files of a length's exchanges are dropped before the next one begins.

Grams are told apart by 64 bits: of a billion different ones of a length, two are expected to be one with a probability of 3 %.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captrellis.functions.text import tokens
from captrellis.session import drop_folder, shuffles_dropped, stage, stage_path

#: Text of the items that stand in one block.
BLOCK_BYTES = 8 * 1024 * 1024

#: ``block`` of counts that come from elsewhere.
OTHERS = -1

_ASKED = "bucket int, block int, hashes array<long>, counts array<int>"
_ANSWERED = "block int, bucket int, hashes array<long>, counts array<int>"


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, made from the words' hashes."""
    count = max(len(words) - n + 1, 0)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k : k + count]
        out ^= out >> np.uint64(32)
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The range of hashes that each belongs to; rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def word_hashes(text: Column | str, tokenizer: str) -> Column:
    return F.transform(tokens(text, tokenizer), lambda t: F.xxhash64(t))


def _pack(rows: pa.Table) -> pa.Table:
    """One row for the rows of a block: in the order of item and sentence, words as numbers of distinct ones."""
    names = pc.dictionary_encode(rows["item_id"].combine_chunks(), null_encoding="encode")
    item, ref_no = names.indices.to_numpy(), rows["ref_no"].to_numpy()
    lists = rows["words"].combine_chunks()
    offsets = lists.offsets.to_numpy()
    order = np.lexsort((ref_no, item))
    begins, size = (offsets[:-1] - offsets[0])[order], np.diff(offsets)[order]
    distinct, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    codes = codes.astype(np.int32)[np.arange(len(codes)) + np.repeat(begins - (np.cumsum(size) - size), size)]
    columns = {"item": item[order], "ref_no": ref_no[order], "size": size, "codes": codes}
    return pa.table(
        {"block": rows["block"].slice(0, 1), "items": pa.ListArray.from_arrays([0, len(names.dictionary)], names.dictionary)}
        | {c: pa.array([x.astype(np.int32).tobytes()], pa.binary()) for c, x in columns.items()}
        | {"distinct": pa.array([distinct.tobytes()], pa.binary())}
    )


class Block:
    """A packed block and its grams of ``n`` words. References of items without a candidate take no part."""

    def __init__(self, packed: dict, n: int):
        self.items = packed["items"].values
        self.item, self.ref_no, self.size, codes = (np.frombuffer(packed[c].as_buffer(), np.int32) for c in ("item", "ref_no", "size", "codes"))
        words = np.frombuffer(packed["distinct"].as_buffer(), np.uint64)[codes]
        self.n_words = len(words)
        self.row = np.repeat(np.arange(len(self.item), dtype=np.int32), self.size)
        self.is_ref = self.ref_no >= 0
        first = _changes(self.item) | _changes(self.ref_no)
        self.sentence, self.sentences = (np.cumsum(first) - 1).astype(np.int32), np.flatnonzero(first)
        self.asked = np.zeros(len(self.items), bool)
        self.asked[self.item[~self.is_ref]] = True
        self.hashes = gram_hashes(words, n)
        starts = self.row[: len(self.hashes)]
        self.inside = (starts == self.row[n - 1 :]) & self.asked[self.item][starts]

    def sorted(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Grams at the marked words: their places by hash and row, which of them are new, their numbers, and the distinct hashes."""
        at = np.flatnonzero(inside)
        order, found = _sorted(self.hashes[at])
        new = _changes(found)
        return at[order], new, (np.cumsum(new) - 1).astype(np.int32), found[new]


def _changes(values: np.ndarray) -> np.ndarray:
    """Marks values that differ from the one before, and the first."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def _sorted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of the hashes, and the hashes in it."""
    # Places in the low bits make plain sorting stable. Hashes that differ there only are seen below, and are rare.
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    keys.sort()
    order = (keys & low).astype(np.int64)
    found = hashes[order]
    if (found[1:] < found[:-1]).any():
        order = np.argsort(hashes, kind="stable")
        found = hashes[order]
    return order, found


def _both(b: Block, known: np.ndarray) -> np.ndarray:
    """Words at which a gram begins of which both grams of one word less are marked."""
    many = len(b.inside)
    return b.inside & known[:many] & known[1 : many + 1]


def _flags(b: Block, flags: bytes) -> np.ndarray:
    """Two marks per word, as written by :func:`_score`: its gram has an answer, and comes twice in the block."""
    return np.unpackbits(np.frombuffer(flags, np.uint8).reshape(2, -1), axis=1, count=b.n_words).astype(bool)


def _ask(n: int, buckets: int):
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_lists({"bucket": np.zeros(0, np.int32), "block": np.zeros(0, np.int32)}, np.zeros(0, np.uint64), np.zeros(0, np.int32), [0])]
        for packed in _rows(left):
            b, block = Block(packed, n), packed["block"].as_py()
            at, _, number, hashes = b.sorted(b.inside if n == 1 else _both(b, _flags(b, right["flags"][0].as_py())[0]))
            # Items of a gram stand together, so a change of gram or item is another item.
            row = b.row[at]
            mine = np.flatnonzero(b.is_ref[row])
            gram, item = number[mine], b.item[row[mine]]
            counts = np.bincount(gram[_changes(gram) | _changes(item)], minlength=len(hashes)).astype(np.int32)
            bucket = bucket_of(hashes, buckets)
            edges = np.flatnonzero(_changes(bucket))
            out.append(_lists({"bucket": bucket[edges], "block": np.full(len(edges), block, np.int32)}, hashes, counts, np.r_[edges, len(hashes)]))
        return pa.concat_tables(out)

    return ask


def _answer(asked: pa.Table) -> pa.Table:
    """Sums of the counts in the order of the questions, 0 for less than 2; hashes go back only to counts from elsewhere."""
    lists = asked["hashes"].combine_chunks()
    hashes, block = lists.flatten().to_numpy().view(np.uint64), asked["block"].to_numpy()
    order, found = _sorted(hashes)
    new = _changes(found)
    total = np.add.reduceat(asked["counts"].combine_chunks().flatten().to_numpy()[order].astype(np.int64), np.flatnonzero(new))
    mine = np.empty(len(found), np.int32)
    mine[order] = np.where(total < 2, 0, total)[np.cumsum(new) - 1]
    size = np.diff(lists.offsets.to_numpy())
    named = block == OTHERS
    return _lists(
        {"block": block, "bucket": asked["bucket"].to_numpy()}, hashes[np.repeat(named, size)], mine,
        np.r_[0, np.cumsum(np.where(named, size, 0))], np.r_[0, np.cumsum(size)],
    )


def _score(n: int, longest: int, sigma: float, n_items: int, norms: bool, kind: pa.DataType):
    most = np.log(float(max(n_items, 1)))
    result = pa.list_(pa.struct([("item_id", kind), ("ref_no", pa.int32()), ("n_refs", pa.int64()), ("value", pa.float64())]))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks, marks, found = [], [], [pa.array([], result)]
        for packed in _rows(left):
            b = Block(packed, n)
            asked = some = b.inside
            if n > 1:
                known = _flags(b, right["flags"].drop_null()[0].as_py())
                asked = _both(b, known[0])
                # A gram that comes twice in the block, or in two items, has parts that do. All others stand once, with the greatest weight.
                some = asked | _both(b, known[1])
            at, new, number, hashes = b.sorted(some)
            df = np.ones(len(hashes), np.int32)
            answers = right.filter(pc.is_valid(right["counts"])).sort_by("bucket")["counts"].combine_chunks().flatten().to_numpy()
            df[asked[at[new]]] = np.maximum(answers, 1)
            flags = np.zeros((2, b.n_words), bool)
            flags[0, at] = df[number] >= 2
            flags[1, at] = np.bincount(number, minlength=len(hashes))[number] > 1
            squared = np.full(len(df), most * most)
            held = np.flatnonzero(df > 1)
            squared[held] = (most - np.log(df[held].astype(float))) ** 2
            once = np.bincount(b.row[np.flatnonzero(b.inside & ~some)], minlength=len(b.item))
            values = _sentences(b, at, new, number, squared, once, most * most, n, longest, sigma, norms)
            found.append(pa.ListArray.from_arrays([0, len(values[0])], pa.StructArray.from_arrays(values, ["item_id", "ref_no", "n_refs", "value"])).cast(result))
            blocks.append(packed["block"].as_py())
            marks.append(np.packbits(flags, axis=1).tobytes())
        return pa.table({"block": pa.array(blocks, pa.int32()), "flags": pa.array(marks, pa.binary()), "found": pa.concat_arrays(found)})

    return score


def _sentences(
    b: Block, at: np.ndarray, new: np.ndarray, number: np.ndarray, squared: np.ndarray, once: np.ndarray, most: float,
    n: int, longest: int, sigma: float, norms: bool,
) -> tuple[pa.Array, ...]:
    """``item_id, ref_no, n_refs, value``: sums of similarities per item, or norms per sentence.

    ``once`` counts, per row, the grams that stand in no other place of the block; their square of the idf is ``most``.
    """
    sentence = b.sentence[b.row[at]]
    # Runs of one gram in one sentence.
    begins = np.flatnonzero(new | _changes(sentence))
    tf = np.diff(np.r_[begins, len(sentence)]).astype(np.int32)
    gram, sentence = number[begins], sentence[begins]
    many, first = len(b.sentences), b.sentences
    weight = squared[gram]
    alone = np.bincount(b.sentence, once, many)
    norm = np.sqrt(np.bincount(sentence, np.square(tf, dtype=float) * weight, many) + alone * most)
    if norms:
        keep = (np.bincount(sentence, minlength=many) > 0) | (alone > 0)
        first = first[keep]
        return b.items.take(pa.array(b.item[first])), pa.array(b.ref_no[first], pa.int32()), pa.array(np.zeros(len(first), np.int64)), pa.array(norm[keep])

    # The candidate's count of the same gram, once for each row of the reference.
    of, ref = b.item[first], b.is_ref[first]
    mine = ref[sentence]
    key = gram * np.int64(len(b.items)) + of[sentence]
    theirs, count = key[~mine], tf[~mine]
    key, gram, sentence, tf, weight = key[mine], gram[mine], sentence[mine], tf[mine], weight[mine]
    place = np.minimum(np.searchsorted(theirs, key), max(len(theirs) - 1, 0))
    met = np.flatnonzero(theirs[place] == key) if len(theirs) else place[:0]
    tf_cand = count[place[met]] * np.bincount(b.sentence)[sentence[met]]
    shared = np.minimum(tf_cand, tf[met]).astype(float) * tf[met]
    dot = np.bincount(sentence[met], shared * weight[met], many)

    n_names = len(b.items)
    bigrams = np.maximum(b.size - 1, 0)
    cand = np.zeros(n_names, np.int64)
    cand[b.item[~b.is_ref]] = bigrams[~b.is_ref]
    # Of several rows of a reference, one without a gram of this length takes part only where the candidate's grams do.
    meets = np.zeros(many, bool)
    meets[sentence[met]] = True
    gap = np.where((b.size >= n) | meets[b.sentence], cand[b.item] - bigrams, np.iinfo(np.int32).min).astype(float)
    gap = np.maximum.reduceat(gap, first) if many else gap
    penalty = np.exp(-(gap**2) / (2.0 * sigma * sigma)) if longest > 1 else np.ones(many)
    sim = np.divide(dot * penalty, norm, out=np.zeros(many), where=ref & (norm > 0))
    length = np.zeros(n_names)
    length[of[~ref]] = norm[~ref]
    total = np.divide(np.bincount(of, sim, n_names), length, out=np.zeros(n_names), where=length > 0)[b.asked]
    n_refs = np.bincount(of[ref], minlength=n_names)[b.asked]
    return b.items.filter(pa.array(b.asked)), pa.array(np.zeros(len(total), np.int32)), pa.array(n_refs.astype(np.int64)), pa.array(total)


def _rows(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches():
        for k in range(len(batch)):
            yield {c: batch[c][k] for c in batch.schema.names}


def _lists(columns: dict[str, np.ndarray], hashes: np.ndarray, counts: np.ndarray, *ends: np.ndarray) -> pa.Table:
    def cut(values: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))

    return pa.table(columns | {"hashes": cut(hashes.view(np.int64), ends[0]), "counts": cut(counts, ends[-1])})


def hashed_grams(grams: DataFrame, buckets: int) -> DataFrame:
    """``gram, df, uses`` with ``n, hash, bucket`` as blocks make them."""
    words = F.split("gram", " ")
    split = grams.select("*", F.size(words).alias("n"), F.transform(words, lambda t: F.xxhash64(t)).alias("words"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch["n"].to_numpy(), batch["words"]
            words, begins = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            out = np.zeros(len(batch), np.uint64)
            for k in np.unique(n):
                out[n == k] = gram_hashes(words, int(k))[begins[n == k]]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("gram", "df", "uses", "n")), pa.array(out.view(np.int64)), pa.array(bucket_of(out, buckets))],
                ["gram", "df", "uses", "n", "hash", "bucket"],
            )

    return split.mapInArrow(hashed, "gram string, df long, uses long, n int, hash long, bucket int")


def block_values(
    rows: DataFrame, total_bytes: int, n_items: int, n: int, sigma: float, tokenizer: str, norms: bool = False, others: DataFrame | None = None,
    block_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """``item_id, ref_no, n_refs, value, n`` of ``rows(item_id, ref_no, text)``, an item's candidate being -1, and the grams of ``others`` with their sums.

    ``value`` is the sum of an item's similarities, without ``norms``, or the norm of a sentence. ``others`` (``gram, df,
    uses``) are counts of more items, which take part in all document frequencies. ``n_items`` counts all items.
    """
    spark = rows.sparkSession
    blocks = max(-(-total_bytes // (block_bytes or BLOCK_BYTES)), spark.sparkContext.defaultParallelism)
    name, path = f"captrellis_blocks_{uuid.uuid4().hex}", stage_path(spark, "blocks")
    # The texts cross the exchange; tokens are made behind it.
    cut = rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).repartition(blocks, "block").select(
        "block", "item_id", F.col("ref_no").cast("int").alias("ref_no"),
        word_hashes(F.coalesce("text", F.lit("")), tokenizer).alias("words"),
    )
    kind = rows.schema["item_id"].dataType
    packed = f"block int, items array<{kind.simpleString()}>, " + ", ".join(f"{c} binary" for c in ("item", "ref_no", "size", "codes", "distinct"))
    scored = f"block int, flags binary, found array<struct<item_id:{kind.simpleString()},ref_no:int,n_refs:bigint,value:double>>"
    flags = spark.createDataFrame([], "block int, flags binary")
    found, known = [], []
    try:
        with shuffles_dropped(spark):
            cut.groupBy("block").applyInArrow(_pack, packed).write.bucketBy(blocks, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
            if others is not None:
                others = stage(hashed_grams(others, blocks), "other-grams")
            arrow = spark.createDataFrame([], rows.select("item_id").schema).toArrow().schema.field("item_id").type
            for k in range(1, n + 1):
                texts = spark.table(name)
                asked = texts.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_ask(k, blocks), _ASKED)
                if others is not None:
                    more = others.where(F.col("n") == k).select(
                        "bucket", F.lit(OTHERS).alias("block"), F.array("hash").alias("hashes"), F.array(F.col("df").cast("int")).alias("counts")
                    )
                    asked = asked.unionByName(more)
                answered = asked.groupBy("bucket").applyInArrow(_answer, _ANSWERED)
                if others is not None:
                    answered = stage(answered, f"answers-{k}")
                    known.append(
                        answered.where(F.col("block") == OTHERS)
                        .select(F.inline(F.arrays_zip("hashes", "counts")).alias("hash", "known"))
                        .withColumn("n", F.lit(k))
                    )
                    answered = answered.where(F.col("block") != OTHERS)
                nothing = (F.lit(None).cast(kind).alias(c) for c, kind in (("bucket", "int"), ("counts", "array<int>")))
                answered = answered.select("block", "bucket", "counts", F.lit(None).cast("binary").alias("flags")).unionByName(
                    flags.select("block", *nothing, "flags")
                )
                values = texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_score(k, n, sigma, n_items, norms, arrow), scored)
                values = stage(values, f"grams-{k}")
                flags = values.select("block", "flags")
                found.append(values.select(F.inline("found")).withColumn("n", F.lit(k)))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_folder(path)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    if others is None:
        return out, None
    sums = known[0]
    for more in known[1:]:
        sums = sums.unionByName(more)
    return out, others.join(sums, ["n", "hash"], "left").select("gram", F.coalesce(F.col("known").cast("bigint"), "df").alias("df"), "uses")
