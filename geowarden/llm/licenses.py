"""Licence scans by diagonal voting, in DataFrame functions only.

All rolling word 4-grams of all texts are joined to the positions they have in the notices below (a
table fixed in this file, below two thousand rows, broadcast): the hash join finds a gram by its
hash and compares its words, so every match is verified.  Every match votes for the
diagonal ``position in text - position in notice``; diagonals that lie close together are merged,
so that a few words put in or left out do not break a match; a merged span counts if it holds
enough of the notice's distinct grams, in a stretch not much longer than the notice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 4
#: Diagonals this close are one; a span needs this share of its notice's grams; and it may be this
#: many times as long as the notice.
NEAR, COVER, STRETCH = 3, 0.6, 1.5
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Label and words of well-known notices, whole and as telling stretches of them.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0"),
    ("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa", "this work is licensed under the creative commons attribution noncommercial sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc sa 4 0"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
)


def words(text: str) -> Column:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; none for null.

    ``lower`` also changes letters beyond A-Z, which neither joins nor splits words; of the letters
    in BASE none is the lower case of any other character.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(name: str) -> Column:
    """The GRAM words from each word on (fewer at the end, which are no gram of a notice)."""
    return F.expr(f"transform({name}, (w, i) -> concat_ws(' ', w, {', '.join(f'get({name}, i + {k})' for k in range(1, GRAM))}))")


def _places(name: str) -> Column:
    """``start, label`` of every place of a base phrase."""
    tests = []
    for phrase, label in BASE:
        first, *rest = phrase.split()
        tests.append(" AND ".join([f"w = '{first}'", *[f"get({name}, i + {k}) = '{x}'" for k, x in enumerate(rest, 1)]]) + f" THEN named_struct('start', CAST(i AS BIGINT), 'label', '{label}')")
    return F.expr(f"filter(transform({name}, (w, i) -> CASE WHEN {' WHEN '.join(tests)} END), x -> x IS NOT NULL)")


def _templates(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({t}, '{label}', {len(ws := text.split())}, {i}, '{' '.join(ws[i : i + GRAM])}')" for t, (label, text) in enumerate(NOTICES) for i in range(len(text.split()) - GRAM + 1))
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, label, size, at, gram)")
    return table.withColumnRenamed("gram", "g")


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, h`` (of doc_id and text), ``label, first, last`` (words of the text) and ``cover`` of every notice found."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("h"), words(text).alias("words"))
    rolling = split.select("doc_id", "h", F.posexplode(_grams("words")).alias("pos", "g"))
    known = _templates(docs.sparkSession)
    votes = rolling.join(F.broadcast(known), "g").select("doc_id", "h", "template", "label", "size", "pos", "at").distinct()
    votes = votes.withColumn("diagonal", F.col("pos") - F.col("at"))
    by = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal", "pos")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by) > NEAR).cast("int")
    merged = votes.withColumn("run", F.sum(F.coalesce(apart, F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    found = merged.groupBy("doc_id", "h", "template", "label", "size", "run").agg(F.min("pos").alias("first"), (F.max("pos") + GRAM - 1).alias("last"), F.countDistinct("at").alias("grams"))
    found = found.withColumn("cover", F.col("grams") / (F.col("size") - GRAM + 1))
    return found.filter((F.col("cover") >= COVER) & (F.col("last") - F.col("first") + 1 <= STRETCH * F.col("size"))).select("doc_id", "h", "label", "first", "last", "cover")


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row of ``docs``.

    Base places are consecutive words of a phrase; the score is 1 where there is one, else the
    largest share of a notice's grams in a span that counts, else 0.  Null and empty texts have no
    words, null places, empty labels; rows that repeat and null doc_ids give rows alike; an empty
    table gives none; other columns are not looked at.
    """
    low = F.lower(F.col(text))
    may = low.contains("license") | low.contains("cc")
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("h"), F.coalesce(may, F.lit(False)).alias("may"), words(text).alias("words"))
    base = split.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), F.when(F.col("may"), _places("words")).otherwise(none).alias("places"))
    own = spans(docs, text).groupBy("doc_id", "h").agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover")).select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "found", "cover")
    joined = base.join(own, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")), "left")
    starts, labels = F.col("places.start"), F.array_distinct(F.col("places.label"))
    empty = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("found", empty))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
