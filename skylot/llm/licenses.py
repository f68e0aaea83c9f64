"""License scans by diagonal voting, in DataFrame functions only.

A document's rolling word k-grams are hashed and joined with the positions of the templates' k-grams.
A hit at word p of the document and word t of a template votes for the diagonal p - t: the words of a
quoted notice vote for one diagonal, and a word put in or left out moves the votes to a neighbouring
one. Diagonals at most SLACK apart are merged; a merged span counts if it holds enough of the
template's k-grams, and if enough of its own words are the template's.

The templates are the lists below, sentences and whole licence texts, so what is broadcast has a size known beforehand. Only hits are
shuffled, not k-grams.

Cases: null text is empty; a text with fewer words than a k-gram has no hits; repeated rows (and null
ids) have equal results, hits being told apart by id and text; texts are scanned whole; an empty table
gives an empty one; columns beside doc_id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.llm.common import lower_ascii

#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that decide by themselves, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Sentences of public licence notices, by label (fixed values).
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "shared under the terms of CC BY-NC 4.0"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
]
#: A disclaimer that two of the texts below end with.
AS_IS = """The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of
merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim,
damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use
or other dealings in the software."""
#: Whole public licence texts, without titles and copyright lines, by label (fixed values).
WHOLE = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. """ + AS_IS),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. The software is provided "as is" and the author disclaims all warranties
with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special,
direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract,
negligence or other tortious action, arising out of or in connection with the use or performance of this software."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without specific prior written permission. This software is provided by the
copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of
merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct,
indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss
of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort
(including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as
being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We
intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. """ + AS_IS),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
]
K, SLACK, COVERAGE, DENSITY = 3, 3, 0.6, 0.5


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _grams(found: Column, k: int) -> Column:
    """Two hashes of every rolling k-gram: the join's key, and one that verifies it."""
    last = F.size(found) - k
    gram = lambda i: F.struct(
        F.xxhash64(*(F.get(found, i + j) for j in range(k))).alias("key"),
        F.hash(*(F.get(found, i + j) for j in range(k))).alias("proof"))
    return F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), gram)


def template_index(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """(template, label, grams, at, key, proof): one row a k-gram of a template."""
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(templates)], "template int, label string, text string")
    grams = rows.select("template", "label", _grams(words(F.col("text")), k).alias("all"))
    return (grams.select("template", "label", F.size("all").alias("grams"), F.posexplode("all").alias("at", "gram"))
            .select("template", "label", "grams", "at", "gram.key", "gram.proof"))


SPAN = ["doc_id", "text_key", "template", "label", "first_word", "last_word", "coverage", "density"]


def spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, slack: int = SLACK,
          coverage: float = COVERAGE, density: float = DENSITY) -> DataFrame:
    """(doc_id, text) -> SPAN, one row a notice found; text_key tells texts of one id apart."""
    index = template_index(docs.sparkSession, templates, k)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    rolled = keyed.select("doc_id", "text_key", F.posexplode(_grams(F.col("words"), k)).alias("pos", "gram"))
    hits = (rolled.select("doc_id", "text_key", "pos", F.col("gram.key").alias("key"), F.col("gram.proof").alias("proof"))
            .join(F.broadcast(index), ["key", "proof"])  # the lists above: about a thousand rows
            .withColumn("diagonal", F.col("pos") - F.col("at")))
    one = ["doc_id", "text_key", "template", "label", "grams"]
    votes = hits.groupBy(*one, "diagonal", "pos", "at").agg(F.lit(1).alias("vote"))  # repeated rows vote once
    lines = votes.groupBy(*one, "diagonal").agg(
        F.sum("vote").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    order = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int"), F.lit(1))
    merged = lines.withColumn("apart", apart).withColumn("line", F.sum("apart").over(order))
    found = merged.groupBy(*one, "line").agg(
        F.sum("votes").alias("votes"), F.min("low").alias("first_word"), (F.max("high") + k - 1).alias("last_word"))
    return (found.withColumn("coverage", F.least(F.lit(1.0), F.col("votes") / F.col("grams")))
            .withColumn("density", F.least(F.lit(1.0), F.col("votes") / (F.col("last_word") - F.col("first_word") - k + 2)))
            .filter((F.col("coverage") >= coverage) & (F.col("density") >= density)).select(*SPAN))


def _places(found: Column, phrase: str, spaced: Column) -> Column:
    """The words at which the phrase starts."""
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.size(found) - len(parts))

    def stands(i: Column) -> Column:
        test = F.lit(True)
        for j, part in enumerate(parts):
            test = test & (F.get(found, i + j) == part)
        return test

    return F.when(spaced.contains(f" {phrase} "), F.filter(starts, stands)).otherwise(F.array().cast("array<int>"))


def labelled(docs: DataFrame) -> DataFrame:
    """One row a document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    rows = rows.withColumn("spaced", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    names = {label: f"_at{i}" for i, label in enumerate(PHRASES.values())}
    rows = rows.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), *(
        _places(F.col("words"), phrase, F.col("spaced")).alias(names[label]) for phrase, label in PHRASES.items()))
    every = F.concat(*names.values())
    base = F.array_compact(F.array(*(F.when(F.size(at) > 0, label) for label, at in names.items())))
    rows = rows.select("doc_id", "text_key", "n_words", F.size(every).cast("long").alias("n_base"),
                       F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
                       F.array_sort(F.array_distinct(base)).alias("base"))
    voted = spans(docs, TEMPLATES + WHOLE).groupBy("doc_id", "text_key").agg(  # labels: as many as there are templates at most
        F.collect_set("label").alias("voted"), F.max(F.col("coverage") * F.col("density")).alias("best"))
    voted = voted.withColumnsRenamed({"doc_id": "_d", "text_key": "_t"})
    both = rows.join(voted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left")
    every_label = F.array_sort(F.array_union("base", F.coalesce("voted", F.array().cast("array<string>"))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(every_label, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
