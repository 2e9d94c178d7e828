"""License scans [native]: an exact set-similarity join of text blocks against notice templates.

Templates have any length. One of up to `step` words (a power of two) is sought in blocks of 2*step words, one starting at every step-th word, so that any
stretch of its length lies whole in the block of its first word. A template matches a block that holds at least
ceil(threshold * size) of its distinct words. Words are ordered by their frequency in the corpus,
rarest first; a match must share one of the template's first size - need + 1 words (prefix filter), the
block must have `need` template words at all (length filter), and the words from the first shared one
on must suffice (positional filter). Only what passes is verified by intersection.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose words must stand consecutively, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices that match by containment, with their labels.
NOTICES = (
    ("this work is licensed under the gnu general public license version", "gpl-notice"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version", "apache"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
        "mit-text",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "bsd-text",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache-text",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gpl-text",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
        "isc-text",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
        "mpl-text",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense-text",
    ),
)
#: Words of the shortest blocks' step.
STEP = 16


def scan_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters, with at most one empty string at either end.

    lower() also maps letters beyond A-Z, always to word characters, so that word bounds stay as they are; the
    Kelvin sign, whose lower case is an ASCII letter, is kept out of it.
    """
    return F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00ff"))), NOT_WORD)


def templates(phrases=PHRASES, notices=NOTICES, threshold: float = 0.9) -> list[dict]:
    both = [(p, name, True) for p, name in phrases] + [(p, name, False) for p, name in notices]
    rows = []
    for at, (text, label, exact) in enumerate(both):
        body = [w for w in re.split(NOT_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        kinds = sorted(set(body))
        need = len(kinds) if exact else math.ceil(threshold * len(kinds) - 1e-9)
        rows.append({"template": at, "label": label, "exact": exact, "body": body, "kinds": kinds, "need": need, "step": max(STEP, 2 ** math.ceil(math.log2(len(body))))})
    return rows


def word_counts(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Corpus frequency of each template word, over all rows. What reaches the driver is as long as the fixed vocabulary."""
    found = texts.select(F.explode(F.filter(scan_words(F.col("text")), lambda w: w.isin(vocabulary))).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in found.collect()}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES, threshold: float = 0.9) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Templates may have any number of words. Null texts count as empty: no words, no labels, score 0. Repeated ids each keep a row of their own. Labels are
    distinct, sorted and comma-joined; score is the largest containment of a template that matched, else 0.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = templates(phrases, notices, threshold)
    vocabulary = sorted({w for r in rows for w in r["kinds"]})
    counts = word_counts(texts, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    prefixes = []
    for r in rows:
        r["kinds"] = sorted(r["kinds"], key=rank.get)
        prefixes += [(r["step"], r["template"], w, at, len(r["kinds"]), r["need"], r["kinds"], r["exact"], r["label"], r["body"]) for at, w in enumerate(r["kinds"][: len(r["kinds"]) - r["need"] + 1])]
    # a fixed list of a few dozen short rows: its size does not depend on the corpus
    table = F.broadcast(spark.createDataFrame(prefixes, "step int, template int, w string, at int, size int, need int, kinds array<string>, exact boolean, label string, body array<string>"))
    leads = {step: sorted({p[2] for p in prefixes if p[0] == step}) for step in sorted({p[0] for p in prefixes})}

    w = F.col("w")
    split = texts.select("id", scan_words(F.col("text")).alias("w"))
    head, tail = (F.get(w, F.lit(0)) == "").cast("int"), ((F.element_at(w, -1) == "") & (F.size(w) > 1)).cast("int")
    bare = split.select("id", F.when(head + tail > 0, F.slice(w, head + 1, F.greatest(F.size(w) - head - tail, F.lit(0)))).otherwise(w).alias("w"))

    def cut(step: int, lead: list[str]) -> Column:
        """Blocks in which a leading word of a template of this step stands."""
        at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(lead), (i / step).cast("int"))), lambda i: i.isNotNull())
        names = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, F.greatest(i - 1, F.lit(0))))))
        return F.transform(names, lambda b: F.struct(F.lit(step).alias("step"), b.alias("block"), F.slice(w, b * step + 1, F.lit(2 * step)).alias("words")))

    # most texts hold no leading word of any template and end here
    every = F.array(*map(F.lit, sorted({x for lead in leads.values() for x in lead})))
    blocks = F.when(F.arrays_overlap(w, every), F.concat(*(cut(*x) for x in leads.items())))
    # the row's own key joins its matches to it again, so that repeated ids stay apart
    found = stage(bare.select("id", F.monotonically_increasing_id().alias("row"), F.size(w).cast("bigint").alias("n_words"), blocks.alias("blocks")), "license-blocks")

    ordered = F.array(*(F.lit(x) for x in sorted(vocabulary, key=rank.get)))
    block = found.select("row", F.explode("blocks").alias("x")).select("row", "x.step", "x.block", "x.words").withColumn("known", F.array_intersect(ordered, "words"))
    pairs = block.select("row", "step", "block", "words", "known", F.posexplode("known").alias("j", "w")).join(table, ["step", "w"])
    most = F.least("at", "j") + 1 + F.least(F.col("size") - F.col("at") - 1, F.size("known") - F.col("j") - 1)
    near = pairs.where(F.size("known") >= F.col("need")).where(most >= F.col("need"))
    shared = F.size(F.array_intersect("known", "kinds"))
    checked = near.dropDuplicates(["row", "block", "template"]).withColumn("shared", shared).where("shared >= need")
    places = F.filter(F.sequence(F.lit(0), F.col("step") - 1), lambda i: F.slice(F.col("words"), i + 1, F.size("body")) == F.col("body"))
    checked = checked.withColumn("places", F.when(F.col("exact"), F.transform(places, lambda i: (i + F.col("block") * F.col("step")).cast("bigint")))).where(~F.col("exact") | (F.size("places") > 0))
    of = checked.groupBy("row").agg(
        F.coalesce(F.sum(F.when(F.col("exact"), F.size("places"))), F.lit(0)).cast("bigint").alias("n_base"),
        F.min(F.when(F.col("exact"), F.array_min("places"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.array_max("places"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max(F.col("shared") / F.col("size")).alias("score"),
    )
    none = F.lit("")
    return found.select("id", "row", "n_words").join(of, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
