"""Corpus preparation queries: sources, fetch, gate, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captrellis.functions.hashing import pick
from captrellis.functions.images import (
    ACCEPTED_MODES,
    EXTENSIONS,
    extension_for,
    needs_rgb,
    probe_png,
    reject_reason,
)
from captrellis.operators import gate, ordering
from captrellis.plans.jobs import first_images
from captrellis.queries.twins import draw, order_key, quoted
from captrellis.session import stage_path
from captrellis.sources.fetch import fetch_in_rounds, mirror_fetcher
from captrellis.sources.store import scan_store, store, with_bodies
from captrellis.sources.tables import column_audit, extended, read_table, write_table


def load_split(spark: SparkSession, d: str) -> DataFrame:
    """The validation part of ``documents``; helper columns are dropped after use."""
    docs = read_table(spark, f"{d}/documents.parquet", columns=["doc_id", "lang", "source", "n_chars"])
    marked = docs.withColumn("split", F.when(pick(10, "split", "doc_id") == 0, "val").otherwise("train"))
    return marked.where(F.col("split") == "val").drop("split", "source")


def write_read_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Save ``labels`` by split and read them back with the declared schema."""
    labels = read_table(spark, f"{d}/labels.parquet")
    path = stage_path(spark, "labels")
    write_table(
        labels.withColumn("split", F.when(pick(10, "split", "doc_id") == 0, "val").otherwise("train")),
        path,
        partition_by="split",
    )
    back = spark.read.schema(extended(labels.schema, "split")).parquet(path)
    return back.select("doc_id", F.col("quality").cast("bigint"), F.col("toxic").cast("bigint"), "split")


_REQUIRED = {
    "documents": ["doc_id", "text", "image_url"],
    "pages": ["page_id", "url", "html"],
    "conversations": ["conv_id", "turn", "role", "text", "answer"],
    "labels": ["doc_id", "quality", "toxic"],
    "embeddings": ["vec_id", "embedding", "label"],
}
_LACKING = {("documents", "image_url"), ("conversations", "answer")}


def required_columns(spark: SparkSession, d: str) -> DataFrame:
    """Presence, row count and NULL count of required columns, one pass per table."""
    audits = [
        column_audit(read_table(spark, f"{d}/{name}.parquet"), name, columns) for name, columns in _REQUIRED.items()
    ]
    out = audits[0]
    for audit in audits[1:]:
        out = out.unionByName(audit)
    return out


# Name endings of mirrored files; the transport knows the type of the first three.
_ENDINGS = [".html", ".png", ".jpg", "", ".unheard-of"]


def _fetched(spark: SparkSession, d: str) -> DataFrame:
    """Pages fetched from a mirror of files; some URLs are missing, lead nowhere or lead out of the mirror."""
    pages = read_table(spark, f"{d}/pages.parquet", columns=["page_id", "html"])
    ending = F.get(F.array(*[F.lit(e) for e in _ENDINGS]), pick(len(_ENDINGS), "ending", "page_id").cast("int"))
    name = F.concat(F.sha2(F.col("page_id").cast("string"), 256), ending)
    folder = stage_path(spark, "mirror")
    files, _ = store(pages.select("page_id", name.alias("name"), F.encode("html", "utf-8").alias("content")), folder)
    fate = pick(20, "fate", "page_id")
    url = (
        F.when(fate == 0, F.lit(None))
        .when(fate == 1, F.lit(""))
        .when(fate == 2, F.concat("image_path", F.lit(".gone")))
        .when(fate == 3, F.lit("/etc/hostname"))
        .otherwise(F.col("image_path"))
    )
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    urls = files.select("page_id", url.alias("image_url"))
    done = fetch_in_rounds(urls, mirror_fetcher(folder), "page_id", stage_path(spark, "fetched"), tasks=tasks, delay=0.0)
    # Folders are drawn anew in each run: names tell the files apart.
    named = done.withColumn("image_path", F.regexp_replace("image_path", "^.*/", "images/"))
    return named.withColumn("image_url", F.regexp_replace("image_url", "^.*/", ""))


def fetch_status(spark: SparkSession, d: str) -> DataFrame:
    return _fetched(spark, d).select(
        "page_id", "download_status", "image_path", "n_bytes"
    )


def fetch_report(spark: SparkSession, d: str) -> DataFrame:
    return gate.status_report(_fetched(spark, d))


def status_filter(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows only, without the status column."""
    kept = gate.keep_succeeded(_fetched(spark, d), status="download_status")
    return kept.drop("download_status", "header", "n_bytes")


# What servers may send; NULL is a missing header.
_SENT = ["image/jpeg", "image/png", "IMAGE/GIF", "image/webp", "image/jpeg; charset=binary", "text/html", "x/y", "", None]


def mime_extension(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, f"{d}/pages.parquet", columns=["page_id"])
    sent = F.get(F.array(*[F.lit(s).cast("string") for s in _SENT]), pick(len(_SENT), "mime", "page_id").cast("int"))
    return pages.withColumn("content_type", sent).withColumn("extension", extension_for("content_type"))


_PNG_HEAD = "89504E470D0A1A0A0000000D49484452"


def first_image_status(spark: SparkSession, d: str) -> DataFrame:
    """Image lists of several kinds built around the page bytes; the first image decides."""
    pages = read_table(spark, f"{d}/pages.parquet", columns=["page_id", "html"])
    page = F.encode("html", "utf-8")
    png = F.unhex(F.lit(_PNG_HEAD + "00000040" + "00000040" + "0802000000"))
    gif = F.unhex(F.lit("474946383961" + "40004000"))
    kind = pick(5, "images", "page_id")
    images = (
        F.when(kind == 0, F.array().cast("array<binary>"))
        .when(kind == 1, F.array(F.lit(None).cast("binary"), page))
        .when(kind == 2, F.array(png, page))
        .when(kind == 3, F.array(gif))
        .otherwise(F.array(page))
    )
    done = first_images(pages.select("page_id", images.alias("images")), "page_id", stage_path(spark, "images"))
    return done.select("page_id", F.regexp_replace("image_path", "^.*/", "images/").alias("image_path"), "status")


def _stored_pages(spark: SparkSession, d: str) -> tuple[DataFrame, str, str]:
    """Every page's bytes stored as a file; a ninth has no bytes and a tenth no name."""
    pages = read_table(spark, f"{d}/pages.parquet", columns=["page_id", "html"])
    named = pages.select(
        "page_id",
        F.when(pick(10, "unnamed", "page_id") != 0, F.concat(F.sha2(F.col("page_id").cast("string"), 256), F.lit(".html"))).alias("name"),
        F.when(pick(9, "lost", "page_id") != 0, F.encode("html", "utf-8")).alias("content"),
    )
    folder = stage_path(spark, "store")
    rows, job = store(named, folder)
    return rows, folder, job


def stored_bodies(spark: SparkSession, d: str) -> DataFrame:
    """What the store says of every page, and the bytes that its files hold, attached where the rows are."""
    rows, _, _ = _stored_pages(spark, d)
    return with_bodies(rows).select("page_id", "status", "n_bytes", F.sha2("content", 256).alias("sha256"))


def store_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files of the store by a scan that is planned by bytes."""
    _, folder, job = _stored_pages(spark, d)
    files = scan_store(spark, folder, job, partition_bytes=1024 * 1024)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file_name"), "length", F.sha2("content", 256).alias("sha256"))


# (bit depth, colour type, mode) of the synthesised PNG headers.
_KINDS = [(8, 2, "RGB"), (8, 6, "RGBA"), (8, 0, "L"), (1, 0, "1"), (16, 0, "I;16"), (8, 3, "P"), (8, 4, "LA"), (2, 3, "P")]


def _headers(spark: SparkSession, d: str) -> DataFrame:
    """One PNG header per part, some with a broken signature and some cut short."""
    parts = read_table(spark, f"{d}/part.parquet", columns=["p_partkey", "p_size"])
    kind = pick(len(_KINDS), "kind", "p_partkey").cast("int")

    def number(c, digits: int):
        return F.lpad(F.hex(c.cast("bigint")), digits, "0")

    sized = parts.select(
        "p_partkey",
        number(F.col("p_size") * 2, 8).alias("w"),
        number(F.col("p_partkey") % 100 + 1, 8).alias("h"),
        number(F.get(F.array(*[F.lit(k[0]) for k in _KINDS]), kind), 2).alias("depth"),
        number(F.get(F.array(*[F.lit(k[1]) for k in _KINDS]), kind), 2).alias("colour"),
        pick(10, "harm", "p_partkey").alias("harm"),
    )
    whole = F.concat(F.lit(_PNG_HEAD), "w", "h", "depth", "colour", F.lit("000000"))
    broken = F.when(F.col("harm") == 0, F.concat(F.lit("00"), F.substring(whole, 3, 1000))).when(
        F.col("harm") == 1, F.substring(whole, 1, 40)
    )
    return sized.select("p_partkey", F.unhex(F.coalesce(broken, whole)).alias("content"))


def image_gate(spark: SparkSession, d: str) -> DataFrame:
    judged = gate.gated(_headers(spark, d))
    return judged.select(
        "p_partkey",
        F.col("header.width").cast("bigint").alias("width"),
        F.col("header.height").cast("bigint").alias("height"),
        F.col("header.mode").alias("mode"),
        needs_rgb(F.col("header")).alias("needs_rgb"),
        "reject_reason",
        reject_reason(F.col("header"), max_pixels=6000).alias("reason_with_limit"),
        (probe_png("content") == F.col("header")).alias("same_in_jvm"),
    )


def reject_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """``documents`` without short and without toxic ones; the rejects come from two tables."""
    docs = read_table(spark, f"{d}/documents.parquet", columns=["doc_id", "source", "n_chars"])
    labels = read_table(spark, f"{d}/labels.parquet", columns=["doc_id", "toxic"])
    rejects = [docs.where(F.col("n_chars") < 200), labels.where(F.col("toxic") == 1)]
    return gate.without_rejects(docs, rejects, "doc_id")


def drop_report(spark: SparkSession, d: str) -> DataFrame:
    """Drop counts over the synthesised headers, a seventh of which failed to arrive."""
    lost = pick(7, "lost", "p_partkey") == 0
    assets = gate.gated(_headers(spark, d)).select(
        F.when(~lost, F.col("p_partkey").cast("string")).alias("image_path"),
        F.when(lost, "timeout").otherwise("success").alias("status"),
        "reject_reason",
    )
    return gate.drop_report(assets)


def shuffle_order(spark: SparkSession, d: str) -> DataFrame:
    """Position of every document in the seeded order, and the row at position 100 marked."""
    docs = read_table(spark, f"{d}/documents.parquet", columns=["doc_id"])
    ranked = ordering.number_shuffled(docs, ["doc_id"], 42)
    return ranked.withColumn("at_100", F.col("rn") == 101)


def row_by_position(spark: SparkSession, d: str) -> DataFrame:
    """The document at position 100 of the seeded order."""
    return ordering.row_at(read_table(spark, f"{d}/documents.parquet"), ["doc_id"], 100, 42)


def exact_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, f"{d}/documents.parquet", columns=["doc_id", "lang"])
    return ordering.exact_sample(docs, ["doc_id"], 0.35, 7)


def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, f"{d}/documents.parquet", columns=["doc_id", "lang"])
    return ordering.train_test_split(docs, ["doc_id"], 0.1, 42)


QUERIES = {
    "load_split": load_split,
    "write_read_roundtrip": write_read_roundtrip,
    "required_columns": required_columns,
    "fetch_status": fetch_status,
    "fetch_report": fetch_report,
    "status_filter": status_filter,
    "mime_extension": mime_extension,
    "first_image_status": first_image_status,
    "stored_bodies": stored_bodies,
    "store_scan": store_scan,
    "image_gate": image_gate,
    "reject_anti_join": reject_anti_join,
    "drop_report": drop_report,
    "shuffle_order": shuffle_order,
    "row_by_position": row_by_position,
    "exact_sample": exact_sample,
    "train_test_split": train_test_split,
}


_FETCHED = f"""
    urls AS (SELECT *, {draw(20, 'fate', 'page_id')} AS fate, {draw(len(_ENDINGS), 'ending', 'page_id')} AS e, sha256(page_id::VARCHAR) AS id FROM pages),
    fetched AS (
      SELECT page_id,
             CASE fate WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 3 THEN 'hostname'
               ELSE id || [{', '.join(quoted(x) for x in _ENDINGS)}][e + 1] || CASE fate WHEN 2 THEN '.gone' ELSE '' END END AS image_url,
             CASE WHEN fate < 2 THEN 'missing_url' WHEN fate = 2 THEN 'request_error: not found'
               WHEN fate = 3 THEN 'request_error: outside the mirror' ELSE 'success' END AS download_status,
             CASE WHEN fate > 3 THEN 'images/' || id || ['.html', '.png', '.jpg', '.jpg', '.jpg'][e + 1] END AS image_path,
             CASE WHEN fate > 3 THEN octet_length(encode(html)) END::BIGINT AS n_bytes
      FROM urls
    )"""

_SENT_SQL = "[" + ", ".join("NULL" if s is None else quoted(s) for s in _SENT) + "]"
_EXT_SQL = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in EXTENSIONS.items())
_MODES_SQL = ", ".join(quoted(m) for m in ACCEPTED_MODES)

_HEADERS = f"""
    src AS (
      SELECT p_partkey, (p_size * 2)::BIGINT AS w, p_partkey % 100 + 1 AS h,
             [{', '.join(quoted(k[2]) for k in _KINDS)}][{draw(len(_KINDS), 'kind', 'p_partkey')} + 1] AS m,
             {draw(10, 'harm', 'p_partkey')} >= 2 AS ok
      FROM part
    ),
    judged AS (
      SELECT p_partkey, CASE WHEN ok THEN w END AS width, CASE WHEN ok THEN h END AS height, CASE WHEN ok THEN m END AS mode,
             CASE WHEN NOT ok THEN 'corrupted' WHEN w < 50 OR h < 50 OR m NOT IN ({_MODES_SQL}) THEN 'small_or_mode' END AS reject_reason
      FROM src
    )"""

ORACLES = {
    "load_split": f"SELECT doc_id, lang, n_chars FROM documents WHERE {draw(10, 'split', 'doc_id')} = 0",
    "write_read_roundtrip": f"""SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic,
        CASE WHEN {draw(10, 'split', 'doc_id')} = 0 THEN 'val' ELSE 'train' END AS split FROM labels""",
    "required_columns": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {'false' if (t, c) in _LACKING else 'true'} AS present, "
        f"count(*) AS n_rows, {'NULL::BIGINT' if (t, c) in _LACKING else f'count(*) - count({c})'} AS n_null FROM {t}"
        for t, cs in _REQUIRED.items()
        for c in cs
    ),
    "fetch_status": f"WITH {_FETCHED} SELECT page_id, download_status, image_path, n_bytes FROM fetched",
    "fetch_report": f"""WITH {_FETCHED}
        SELECT regexp_extract(download_status, '^[a-z_]+') AS status, count(*) AS rows FROM fetched GROUP BY 1""",
    "status_filter": f"WITH {_FETCHED} SELECT page_id, image_url, image_path FROM fetched WHERE download_status = 'success'",
    "mime_extension": f"""WITH sent AS (
          SELECT page_id, {_SENT_SQL}[{draw(len(_SENT), 'mime', 'page_id')} + 1] AS content_type FROM pages
        )
        SELECT page_id, content_type,
          CASE WHEN coalesce(content_type, '') = '' THEN '.jpg'
          ELSE CASE lower(trim(split_part(content_type, ';', 1))) {_EXT_SQL} ELSE '.bin' END END AS extension
        FROM sent""",
    "first_image_status": f"""WITH k AS (SELECT page_id, {draw(5, 'images', 'page_id')} AS kind FROM pages)
        SELECT page_id,
          CASE WHEN kind >= 2 THEN 'images/' || sha256(page_id::VARCHAR) ||
            CASE kind WHEN 2 THEN '.PNG' WHEN 3 THEN '.GIF' ELSE '.jpg' END END AS image_path,
          CASE WHEN kind >= 2 THEN 'success' ELSE 'failed' END AS status
        FROM k""",
    "stored_bodies": f"""SELECT page_id, CASE WHEN kept THEN 'success' ELSE 'failed' END AS status,
          CASE WHEN kept THEN octet_length(encode(html)) END::BIGINT AS n_bytes, CASE WHEN kept THEN sha256(html) END AS sha256
        FROM (SELECT *, {draw(10, 'unnamed', 'page_id')} <> 0 AND {draw(9, 'lost', 'page_id')} <> 0 AS kept FROM pages)""",
    "store_scan": f"""SELECT sha256(page_id::VARCHAR) || '.html' AS file_name, octet_length(encode(html))::BIGINT AS length, sha256(html) AS sha256
        FROM pages WHERE {draw(10, 'unnamed', 'page_id')} <> 0 AND {draw(9, 'lost', 'page_id')} <> 0""",
    "image_gate": f"""WITH {_HEADERS}
        SELECT p_partkey, width, height, mode, mode <> 'RGB' AS needs_rgb, reject_reason,
               CASE WHEN reject_reason IS NOT NULL THEN reject_reason WHEN width * height > 6000 THEN 'high_res' END AS reason_with_limit,
               true AS same_in_jvm
        FROM judged""",
    "reject_anti_join": """SELECT doc_id, source, n_chars FROM documents
        WHERE n_chars >= 200 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)""",
    "drop_report": f"""WITH {_HEADERS}, a AS (SELECT *, {draw(7, 'lost', 'p_partkey')} = 0 AS lost FROM judged)
        SELECT count(*) FILTER (NOT lost AND reject_reason = 'corrupted') AS corrupted,
               count(*) FILTER (NOT lost AND reject_reason = 'small_or_mode') AS small_or_mode,
               0::BIGINT AS high_res,
               count(*) - count(*) FILTER (NOT lost AND reject_reason IS NULL) AS total_removed,
               count(*) FILTER (NOT lost AND reject_reason IS NULL) AS final_size
        FROM a""",
    "shuffle_order": f"""SELECT doc_id, rn, rn = 101 AS at_100
        FROM (SELECT doc_id, row_number() OVER (ORDER BY {order_key(42, 'doc_id')}) AS rn FROM documents)""",
    "row_by_position": f"""SELECT doc_id, text, lang, source, n_chars
        FROM (SELECT *, row_number() OVER (ORDER BY {order_key(42, 'doc_id')}) AS rn FROM documents) WHERE rn = 101""",
    "exact_sample": f"""SELECT doc_id, lang
        FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY {order_key(7, 'doc_id')}) AS rn, count(*) OVER () AS n FROM documents)
        WHERE rn <= floor(0.35::DOUBLE * n)""",
    "train_test_split": f"""SELECT doc_id, lang, CASE WHEN rn <= ceil(0.1::DOUBLE * n) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY {order_key(42, 'doc_id')}) AS rn, count(*) OVER () AS n FROM documents)""",
}
