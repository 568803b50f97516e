"""Vector-table operators around a soft-vocabulary connector.

Patches, codes, tokens and masks are tables of keyed rows; keys say where a
vector belongs, so nothing depends on row order or on a dense tensor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captrellis.functions.vectors import as_matrix, as_rows, is_zero, layer_norm_matrix, per_batch
from captrellis.operators.skew import HOT_ROWS, salted_join
from captrellis.session import stage
from captrellis.sources.tables import require_columns

#: Bytes of the codebook that are broadcast at a time.
BLOCK_BYTES = 64 * 1024 * 1024
#: Vectors and codes of one matrix product: 16 MB of logits.
ROWS, CODES = 1024, 2048
#: A window of a running count spans 2 ** CHUNK_BITS neighbouring positions or ids.
CHUNK_BITS = 16


def _tiles(
    patches: DataFrame, scale: int, side: Column | int | None, threshold: int, whole: bool
) -> DataFrame:
    """``image_id, patch_idx, _parts``: the ``(place, vec)`` of every tile's patches in order of their places."""
    if scale < 1:
        raise ValueError("scale must be at least 1")
    require_columns(patches, ["image_id", "patch_idx", "vec"])
    p = patches.select("image_id", "patch_idx", "vec")
    if side is None:
        rows = p.groupBy("image_id").agg(F.count("*").alias("rows"))
        sides = rows.select("image_id", F.rint(F.sqrt("rows")).cast("bigint").alias("_side"), "rows")
        if whole:
            square = (F.col("_side") * F.col("_side") == F.col("rows")) & (F.col("_side") % scale == 0)
            problem = F.concat(F.lit("not a square grid of whole tiles: image "), F.col("image_id").cast("string"))
            sides = sides.withColumn("_side", F.when(square, F.col("_side")).otherwise(F.raise_error(problem).cast("bigint")))
        p = salted_join(p, sides.drop("rows"), ["image_id"], spread_by=["patch_idx"], threshold=threshold, counts=rows)
    else:
        p = p.withColumn("_side", (side if isinstance(side, Column) else F.lit(side)).cast("bigint"))
    h = F.floor(F.col("patch_idx") / F.col("_side"))
    w = F.pmod(F.col("patch_idx"), F.col("_side"))
    per_row = F.floor(F.col("_side") / scale)
    tile = F.floor(h / scale) * per_row + F.floor(w / scale)
    place = F.pmod(h, F.lit(scale)) * scale + F.pmod(w, F.lit(scale))
    return (
        p.select("image_id", tile.alias("patch_idx"), place.alias("place"), "vec")
        .groupBy("image_id", "patch_idx")
        .agg(F.sort_array(F.collect_list(F.struct("place", "vec"))).alias("_parts"))
    )


def patch_merge(
    patches: DataFrame, scale: int, side: Column | int | None = None, threshold: int = HOT_ROWS
) -> DataFrame:
    """Merge ``scale x scale`` neighbouring patches of a square grid into one longer vector.

    ``patches(image_id, patch_idx, vec)`` numbers patches row by row from 0. The
    grid side is given or follows from the image's patch count. Returns
    ``image_id, patch_idx, vec``; an image that is no square grid of full tiles
    is an error (see :func:`patch_tiles`). A group is one tile, at most ``scale ** 2`` rows.
    """
    return _tiles(patches, scale, side, threshold, whole=True).select(
        "image_id",
        F.when(F.size("_parts") == scale * scale, F.col("patch_idx"))
        .otherwise(F.raise_error(F.lit("incomplete tile")).cast("bigint"))
        .alias("patch_idx"),
        F.flatten(F.transform("_parts", lambda e: e["vec"])).alias("vec"),
    )


def patch_tiles(
    patches: DataFrame, scale: int, side: Column | int | None = None, threshold: int = HOT_ROWS
) -> DataFrame:
    """As :func:`patch_merge` for images of any number of patches, such as the rest at the end of a table.

    Returns ``image_id, patch_idx, parts``: an array of ``(place, vec)``, without the patches that a tile lacks. ``place``
    from 0 says where in the merged vector a patch belongs. The side of an image that is no square is the rounded root
    of its patch count; tiles that get one number by that are one row.
    """
    return _tiles(patches, scale, side, threshold, whole=False).withColumnRenamed("_parts", "parts")


def _logit_column(codes: DataFrame) -> str:
    """Rows of the output projection; by default the codes themselves."""
    return "logit_vec" if "logit_vec" in codes.columns else "vec"


def code_blocks(codes: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(logit rows, code rows)`` in order of ``code_id``, at most ``block_bytes`` (or one code) at a time."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    ordered = codes.orderBy("code_id").select(F.col(_logit_column(codes)).alias("logit"), F.col("vec").alias("code"))
    for row in ordered.toLocalIterator():
        pair = np.asarray(row["logit"], dtype=np.float64), np.asarray(row["code"], dtype=np.float64)
        size = pair[0].nbytes + pair[1].nbytes
        if rows and held + size > block_bytes:
            yield np.stack([r[0] for r in rows]), np.stack([r[1] for r in rows])
            rows, held = [], 0
        rows.append(pair)
        held += size
    if rows:
        yield np.stack([r[0] for r in rows]), np.stack([r[1] for r in rows])


def soft_assign(
    vectors: DataFrame, codes: DataFrame, key: str, vec: str = "vec", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``key, soft``: softmax over all codes, then the weighted sum of code vectors.

    ``codes(code_id, vec[, logit_vec])``: a vector's logit for a code is its
    inner product with ``logit_vec``, or with ``vec`` if there is none.

    The codebook passes over the vectors in broadcast blocks of ``block_bytes``, so
    neither the driver nor a task ever holds more of it. Each vector carries its
    largest logit so far, the sum of exponentials and the weighted code sum; a
    later block rescales them. Vectors are not shuffled. Between two blocks they
    are staged, so a lost executor repeats one block at most.
    """
    state = None
    for logit, code in code_blocks(codes, block_bytes):
        if state is None:
            zero = F.array_repeat(F.lit(0.0), code.shape[1])
            state = vectors.select(
                F.col(key).alias("_key"),
                F.col(vec).cast("array<double>").alias("_vec"),
                F.lit(float("-inf")).alias("_m"),
                F.lit(0.0).alias("_s"),
                zero.alias("_v"),
            )
        else:
            state = stage(state, "soft-assign")
        state = _pass_block(state, vectors.sparkSession.sparkContext.broadcast((logit, code)))
    if state is None:
        raise ValueError("codebook is empty")
    return state.select(F.col("_key").alias(key), F.transform("_v", lambda x: x / F.col("_s")).alias("soft"))


def _pass_block(state: DataFrame, block) -> DataFrame:
    """The running softmax of every vector, carried on over one block of codes."""
    names = state.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit, code = block.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, v = as_matrix(part.column("_vec"), logit.shape[1]), as_matrix(part.column("_v"), code.shape[1])
                m, s = (part.column(c).to_numpy(zero_copy_only=False).copy() for c in ("_m", "_s"))
                for first in range(0, len(logit), CODES):
                    logits = x @ logit[first : first + CODES].T
                    top = np.maximum(m, logits.max(axis=1))
                    shrink = np.exp(m - top)
                    p = np.exp(logits - top[:, None])
                    m, s = top, s * shrink + p.sum(axis=1)
                    v = v * shrink[:, None] + p @ code[first : first + CODES]
                columns = [part.column("_key"), part.column("_vec"), pa.array(m), pa.array(s), as_rows(v)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return state.mapInArrow(apply, state.schema)


def align(
    patches: DataFrame,
    codes: DataFrame,
    scale: int,
    w1: np.ndarray,
    b1: np.ndarray | None = None,
    side: Column | int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The whole connector: patch merge, projection, layer norm, logits, softmax, weighted code sum.

    ``codes(code_id, vec, logit_vec)`` holds the vocabulary embeddings and the
    rows of the bias-free output projection. Returns ``image_id, patch_idx, soft``.
    """
    w1 = np.asarray(w1, dtype=np.float64)
    b = 0.0 if b1 is None else np.asarray(b1, dtype=np.float64)
    hidden = per_batch(lambda x: layer_norm_matrix(x @ w1.T + b), w1.shape[1])
    merged = patch_merge(patches, scale, side).select(
        F.struct("image_id", "patch_idx").alias("at"), hidden(F.col("vec")).alias("vec")
    )
    return soft_assign(merged, codes, "at", block_bytes=block_bytes).select("at.image_id", "at.patch_idx", "soft")


def check_image_tokens(tokens: DataFrame, image_token_id: int, patch_size: int) -> DataFrame:
    """``batch_id, sample_id, blocks``; a sample whose image tokens do not fill whole blocks is an error."""
    if patch_size < 1:
        raise ValueError("patch_size must be at least 1")
    n = F.count_if(F.col("token_id") == image_token_id)
    counted = tokens.groupBy("batch_id", "sample_id").agg(n.alias("_n"))
    blocks = F.when(F.col("_n") % patch_size == 0, F.floor(F.col("_n") / patch_size)).otherwise(
        F.raise_error(
            F.concat(
                F.lit(f"image tokens not divisible by {patch_size}: sample "), F.col("sample_id").cast("string")
            )
        ).cast("bigint")
    )
    return counted.select("batch_id", "sample_id", blocks.alias("blocks"))


def block_offsets(blocks: DataFrame) -> DataFrame:
    """Add ``block_offset``: blocks of the earlier samples in the batch.

    One row per sample. Samples are summed in chunks of 65,536 neighbouring ids
    first, so no window holds more than one chunk's samples or the chunk sums of
    one batch.
    """
    b = blocks.withColumn("_chunk", F.shiftright("sample_id", CHUNK_BITS))
    sums = b.groupBy("batch_id", "_chunk").agg(F.sum("blocks").alias("_sum"))
    over_chunks = Window.partitionBy("batch_id").orderBy("_chunk")
    starts = sums.select("batch_id", "_chunk", (F.sum("_sum").over(over_chunks) - F.col("_sum")).alias("_start"))
    inside = Window.partitionBy("batch_id", "_chunk").orderBy("sample_id")
    return (
        b.withColumn("_local", F.sum("blocks").over(inside) - F.col("blocks"))
        .join(starts, ["batch_id", "_chunk"])
        .withColumn("block_offset", F.col("_start") + F.col("_local"))
        .drop("_chunk", "_start", "_local")
    )


def image_positions(tokens: DataFrame, image_token_id: int, patch_size: int) -> DataFrame:
    """``batch_id, sample_id, pos, block_idx, local_idx`` for every image token.

    The running count over positions is summed chunk by chunk, so a very long
    sample is spread over many windows. Only image tokens enter the shuffle.
    """
    images = tokens.where(F.col("token_id") == image_token_id).select(
        "batch_id", "sample_id", "pos", F.shiftright("pos", CHUNK_BITS).alias("_chunk")
    )
    sums = images.groupBy("batch_id", "sample_id", "_chunk").agg(F.count("*").alias("_n"))
    over_chunks = Window.partitionBy("batch_id", "sample_id").orderBy("_chunk")
    starts = sums.select(
        "batch_id", "sample_id", "_chunk", (F.sum("_n").over(over_chunks) - F.col("_n")).alias("_start")
    )
    offsets = block_offsets(check_image_tokens(tokens, image_token_id, patch_size)).drop("blocks")
    inside = Window.partitionBy("batch_id", "sample_id", "_chunk").orderBy("pos")
    before = F.col("_start") + F.row_number().over(inside) - 1
    # One row per (sample, chunk): joined first, then the chunk's tokens look it up.
    bases = starts.join(offsets, ["batch_id", "sample_id"])
    return images.join(bases, ["batch_id", "sample_id", "_chunk"]).select(
        "batch_id",
        "sample_id",
        "pos",
        (F.col("block_offset") + F.floor(before / patch_size)).alias("block_idx"),
        F.pmod(before, F.lit(patch_size)).cast("int").alias("local_idx"),
    )


def scatter_merge(tokens: DataFrame, features: DataFrame, image_token_id: int, patch_size: int) -> DataFrame:
    """Replace the vectors of image tokens by feature rows, in order; other tokens keep theirs.

    ``tokens(batch_id, sample_id, pos, token_id, vec)`` and ``features(batch_id,
    block_idx, local_idx, vec)``. A missing feature row is an error; surplus rows
    are not used (:func:`surplus_blocks` counts them). Every join key is unique.
    """
    require_columns(tokens, ["batch_id", "sample_id", "pos", "token_id", "vec"])
    require_columns(features, ["batch_id", "block_idx", "local_idx", "vec"])
    where = image_positions(tokens, image_token_id, patch_size)
    feats = features.select(
        "batch_id", F.col("block_idx").cast("bigint").alias("block_idx"),
        F.col("local_idx").cast("int").alias("local_idx"), F.col("vec").alias("_feat"),
    )
    placed = where.join(feats, ["batch_id", "block_idx", "local_idx"], "left").select(
        "batch_id",
        "sample_id",
        "pos",
        "block_idx",
        "local_idx",
        F.coalesce("_feat", F.raise_error(F.lit("missing feature row for an image token")).cast(features.schema["vec"].dataType.simpleString())).alias("_feat"),
    )
    is_image = F.col("token_id") == image_token_id
    text = tokens.where(~is_image | F.col("token_id").isNull()).select(
        "batch_id", "sample_id", "pos", "token_id",
        F.lit(None).cast("bigint").alias("block_idx"), F.lit(None).cast("int").alias("local_idx"), "vec",
    )
    image = placed.select(
        "batch_id", "sample_id", "pos", F.lit(image_token_id).cast(tokens.schema["token_id"].dataType).alias("token_id"),
        "block_idx", "local_idx", F.col("_feat").alias("vec"),
    )
    return text.unionByName(image)


def surplus_blocks(tokens: DataFrame, features: DataFrame, image_token_id: int, patch_size: int) -> DataFrame:
    """``batch_id, surplus``: feature blocks that no image token asks for."""
    asked = check_image_tokens(tokens, image_token_id, patch_size).groupBy("batch_id").agg(F.sum("blocks").alias("_asked"))
    given = features.groupBy("batch_id").agg((F.max("block_idx") + 1).alias("_given"))
    lack = F.col("_given") - F.coalesce("_asked", F.lit(0))
    return given.join(asked, "batch_id", "left").select(
        "batch_id", F.greatest(lack, F.lit(0)).cast("bigint").alias("surplus")
    )


def drop_zero_images(images: DataFrame, batch: str = "batch_id", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """Real images only; a batch without any keeps its first row.

    Real rows pass a filter without a shuffle. Only flags travel to find the
    batches that need their first row.
    """
    zero = F.coalesce(is_zero(vec), F.lit(True))
    empty = (
        images.select(batch, pos, (~zero).alias("_real"))
        .groupBy(batch)
        .agg(F.max(F.col("_real").cast("int")).alias("_any"), F.min(pos).alias(pos))
        .where(F.col("_any") == 0)
        .select(batch, pos)
    )
    kept = images.where(zero).join(empty, [batch, pos], "left_semi")
    return images.where(~zero).unionByName(kept.select(images.columns))


def full_mask(cells: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """``image_id, y, x, on`` over all cells; a cell without a mask row is on."""
    grid = cells.select("image_id", "y", "x")
    if mask is None:
        return grid.withColumn("on", F.lit(True))
    return grid.join(mask.select("image_id", "y", "x", "on"), ["image_id", "y", "x"], "left").withColumn(
        "on", F.coalesce("on", F.lit(True))
    )


def tile_mask(mask: DataFrame, tile: int, height: Column | int, width: Column | int) -> DataFrame:
    """``image_id, ty, tx, on``: a tile is on if any of its cells is; incomplete edge tiles are left out."""
    if tile < 1:
        raise ValueError("tile must be at least 1")

    def full(c: Column | int) -> Column:
        return F.floor((c if isinstance(c, Column) else F.lit(c)) / tile) * tile

    # Cutting the edge cells first leaves whole tiles and less to shuffle.
    return (
        mask.where((F.col("y") < full(height)) & (F.col("x") < full(width)))
        .groupBy(
            "image_id", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")
        )
        .agg(F.bool_or("on").alias("on"))
    )


def check_inputs(input_ids=None, inputs_embeds=None, pixel_values=None, image_hidden_states=None) -> None:
    """Reject contradicting or missing inputs, whatever kind of object they are."""
    if input_ids is None and inputs_embeds is None:
        raise ValueError("give input_ids or inputs_embeds")
    if inputs_embeds is not None and input_ids is None:
        raise ValueError("inputs_embeds need input_ids beside them")
    if pixel_values is not None and image_hidden_states is not None:
        raise ValueError("give pixel_values or image_hidden_states, not both")
