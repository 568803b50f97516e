"""License scan by diagonal voting, in DataFrame operations only.

Each pair of neighbouring words of a text is hashed and joined to the places where the templates have that pair.
A hit at text word ``p`` and template word ``q`` is a vote for the diagonal ``p - q``. A phrase stands wherever its
diagonal has all votes; longer notices are found with words changed, put in or left out, by adding up the
votes of neighbouring diagonals. Hits are compared word by word before they vote.

The templates are the only broadcast side; they are fixed. Votes are summed where the text is read, so the
exchange carries a few rows per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Phrases that count at every place where they stand word for word.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Openings of public license notices, found by votes.
NOTICES = [
    ("licensed under the apache license version 2 0", "notice-apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "notice-gpl-3.0"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        "notice-gpl",
    ),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        "notice-mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "notice-bsd",
    ),
    ("this work is licensed under a creative commons attribution 4 0 international license", "notice-cc-by-4.0"),
]
#: Share of a notice's pairs that must vote, and how far apart neighbouring diagonals may be.
NOTICE_SHARE = 0.7
DRIFT = 2

WORDS = r"""array_remove(split(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', -1), '')"""
PAIRS = "IF(size({words}) < 2, array(), zip_with(slice({words}, 1, size({words}) - 1), slice({words}, 2, size({words}) - 1), (a, b) -> xxhash64(a, b)))"


def templates(spark) -> DataFrame:
    """``label, exact, length, q, first, second, hash``: every word pair of every template; fixed and small."""
    rows = [(label, True, phrase) for phrase, label in PHRASES] + [(label, False, phrase) for phrase, label in NOTICES]
    df = spark.createDataFrame(rows, "label string, exact boolean, phrase string").withColumn("w", F.split("phrase", " "))
    df = df.selectExpr("label", "exact", "size(w) - 1 AS length", "w", f"posexplode({PAIRS.format(words='w')}) AS (q, hash)")
    return df.selectExpr("label", "exact", "length", "q", "w[q] AS first", "w[q + 1] AS second", "hash")


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``: one row per row of ``docs``.

    Base: places where a phrase stands word for word; ``first_word`` and ``last_word`` are the smallest and the
    largest start, null without one. ``labels`` adds the notices of which at least :data:`NOTICE_SHARE` of the
    pairs vote; ``score`` is the largest share of any template; ``spans`` has label, start word and votes of all
    that counts. Words are runs of ASCII letters and digits and non-ASCII characters, in lower case. Null and
    empty texts have none. Repeated rows are judged one by one.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.expr(WORDS.format(text=f"coalesce(`{text}`, '')")).alias("w"))
    # A null hash closes each text: it joins the row of the templates' side that carries the text's own count.
    pairs = read.selectExpr("_key", "_row", "w", f"posexplode(concat({PAIRS.format(words='w')}, array(-1L))) AS (p, hash)")
    own = spark.range(1).selectExpr("CAST(NULL AS STRING) AS label", "CAST(NULL AS BOOLEAN) AS exact", "0 AS length", "0 AS q",
                                    "CAST(NULL AS STRING) AS first", "CAST(NULL AS STRING) AS second", "-1L AS hash")
    votes = pairs.join(F.broadcast(templates(spark).unionByName(own)), "hash").where(
        # The closing row is the last one; a pair that happens to hash to -1 is no closing row.
        "IF(label IS NULL, p = greatest(size(w) - 1, 0), w[p] = first AND w[p + 1] = second)"
    )
    # The words end here: sorts and exchanges see numbers and labels only.
    votes = votes.selectExpr("_row", "_key", "label", "exact", "length", "q", "p", "IF(label IS NULL, size(w), 0) AS n_words",
                             "IF(label IS NULL, 0, p - q) AS diagonal")
    diagonals = votes.groupBy("_row", "_key", "label", "exact", "length", "diagonal").agg(
        F.count("*").alias("n"), F.collect_set("q").alias("pairs"), F.min("p").alias("start"), F.max("n_words").alias("n_words")
    )
    along = Window.partitionBy("_row", "_key", "label").orderBy("diagonal")
    fresh = F.expr("exact OR diagonal - before > " + str(DRIFT))
    runs = diagonals.withColumn("before", F.lag("diagonal").over(along)).withColumn(
        "run", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    found = runs.groupBy("_row", "_key", "label", "exact", "length", "run").agg(
        F.min("start").alias("start"),
        F.size(F.array_distinct(F.flatten(F.collect_list("pairs")))).alias("pairs"),
        F.max("n_words").alias("n_words"),
    )
    found = found.withColumn("share", F.expr("IF(label IS NULL, 0D, pairs / length)"))
    counts = f"IF(exact, pairs = length, share >= {NOTICE_SHARE})"
    base = F.expr("exact AND pairs = length")
    out = found.groupBy("_row", "_key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.expr(f"IF({counts}, label, NULL)"))), ",").alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.expr(f"IF({counts}, struct(start, label, pairs), NULL)"))).alias("spans"),
    )
    return out.withColumnRenamed("_key", key).drop("_row")
