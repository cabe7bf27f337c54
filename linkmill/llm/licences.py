"""License scans by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 3
#: Words on [0-9a-z] and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {"mit": ["under the mit license"], "apache-2": ["apache license version 2"], "cc-by-nc": ["cc by nc"]}
#: Wording of public notices, with the label that each stands for.
NOTICES = {
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "apache-2": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "gpl": ["licensed under the gnu general public license", "under the terms of the gnu general public license as published by the free software foundation"],
    "gpl-3": ["gnu general public license version 3"],
    "lgpl": ["gnu lesser general public license"],
    "agpl": ["gnu affero general public license"],
    "mpl-2": ["mozilla public license version 2 0", "this source code form is subject to the terms of the mozilla public license"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc-by": ["creative commons attribution 4 0 international license"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike"],
    "cc-by-nc": ["creative commons attribution noncommercial"],
    "cc0": ["cc0 1 0 universal", "creative commons zero"],
    "all-rights-reserved": ["all rights reserved"],
}
#: Share of a notice's k-grams that a span must hold; diagonals this close are one span.
COVER, NEAR = 0.6, 3


def templates(spark) -> DataFrame:
    """h, words, tid, label, base, grams, tpos: one row for each k-gram of each phrase (fixed size; a mask holds 63 k-grams)."""
    rows = [(i, label, base, t.split()) for i, (label, base, t) in enumerate((label, base, t) for base, group in ((True, BASE), (False, NOTICES)) for label, ts in group.items() for t in ts)]
    rows = [(i, label, base, len(w) - K + 1, p, *w[p : p + K]) for i, label, base, w in rows for p in range(len(w) - K + 1)]
    assert all(r[3] < 64 for r in rows)
    df = spark.createDataFrame(rows, "tid int, label string, base boolean, grams int, tpos int, w0 string, w1 string, w2 string")
    return df.select(F.xxhash64("w0", "w1", "w2").alias("h"), F.concat_ws(" ", "w0", "w1", "w2").alias("words"), "tid", "label", "base", "grams", "tpos")


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each document.

    All rolling word k-gram hashes meet the templates' positions in a broadcast join (a table of
    fixed size); a hit's words are verified and it votes for a diagonal, word position less template position. A diagonal's
    votes are a bit mask of template positions: a base phrase stands where its mask is full.
    Neighbouring diagonals of a notice merge into one span (words put in or left out), which
    counts if it holds COVER of the notice's k-grams. score is the best span's share.

    Null text is empty: no words, labels empty strings, score 0, first and last null. Very long texts are
    scanned whole. A text of
    fewer than K words has no hit. Repeated rows with one doc_id and text give one row.
    Empty table: empty result. Other columns are not read.
    """
    t = templates(docs.sparkSession)
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))
    w = docs.select("doc_id", F.xxhash64("text").alias("xx"), words.alias("w"))
    # The first entry carries the number of words, so that texts are read once.
    grams = w.select("doc_id", "xx", F.posexplode(F.expr(f"concat(array(struct(cast(size(w) as long) as h, '' as words)), if(size(w) < {K}, array(), transform(sequence(0, size(w) - {K}), i -> struct(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) as h, concat_ws(' ', get(w, i), get(w, i + 1), get(w, i + 2)) as words))))")).alias("at", "g")).select("doc_id", "xx", "at", "g.h", "g.words")
    # A vote is verified by the words themselves, so that a span is.
    hits = grams.join(F.broadcast(t), (grams.h == t.h) & (grams["at"] > 0) & (grams.words == t.words), "left").filter("at = 0 or tid is not null").select(
        "doc_id", "xx", F.coalesce("tid", F.lit(-1)).alias("tid"), F.coalesce(F.col("at") - 1 - F.col("tpos"), F.lit(0)).alias("diagonal"),
        F.when(F.col("at") == 0, grams.h).otherwise(F.expr("shiftleft(1L, tpos)")).alias("mask"), "label", "base", "grams")
    votes = hits.groupBy("doc_id", "xx", "tid", "diagonal").agg(F.bit_or("mask").alias("mask"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("grams").alias("grams"))
    one = Window.partitionBy("doc_id", "xx", "tid").orderBy("diagonal")
    runs = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(one) > NEAR).cast("int")).withColumn("run", F.when(F.col("base"), F.col("diagonal")).otherwise(F.sum("new").over(one.rowsBetween(Window.unboundedPreceding, 0))))
    spans = runs.groupBy("doc_id", "xx", "tid", "run").agg(F.bit_or("mask").alias("mask"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("grams").alias("grams"), F.min("diagonal").alias("start"))
    share = F.bit_count("mask") / F.col("grams")
    spans = spans.withColumn("base_hit", F.col("base") & (share == 1)).withColumn("hit", F.col("tid").cast("int") >= F.lit(0)).withColumn("hit", F.col("hit") & (share >= F.when(F.col("base"), 1.0).otherwise(COVER)))
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("doc_id", "xx").agg(
        F.max(F.when(F.col("tid") == -1, F.col("mask"))).alias("n_words"), F.count(F.when(F.col("base_hit"), 1)).alias("n_base"),
        F.min(F.when(F.col("base_hit"), F.col("start").cast("long"))).alias("first_word"), F.max(F.when(F.col("base_hit"), F.col("start").cast("long"))).alias("last_word"),
        text(F.when(F.col("base_hit"), F.col("label"))).alias("base_labels"), text(F.when(F.col("hit"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("tid") >= 0, share)), F.lit(0.0)).alias("score")).drop("xx")
