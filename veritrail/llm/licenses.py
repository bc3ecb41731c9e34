"""Licence scan by a positional rare-token index, in DataFrame functions only.

Templates are word sequences - short phrases and whole notices - with a mandatory key
phrase.  The words of all templates form a fixed vocabulary.  One pass cuts every
text into words and keeps, of each file, its number of words, the vocabulary words that
it holds, and the text where some key phrase has all its words in it.  From what is
kept come the document frequencies, and with them the index: each template under the
highest-IDF word of its key phrase.  A file is looked up by those of its words: a place
of such a word fixes where the template would start, the template's postings are
intersected with the file at those relative positions, and a place counts if its whole
key phrase is there and the matched share of the template's IDF reaches ``COVERAGE``.
Since a key phrase cannot occur without its rarest word, no place is missed.  Base
templates consist of their key phrase alone.

Defined cases
    null text is empty: no words, no labels (empty strings), score 0.0, first and
    last word null;
    a template that starts before or ends after the text may still reach the
    coverage if its key phrase lies inside;
    rows are handled one by one: repeated rows give repeated rows, null ids stay;
    very long texts are one array of words each; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Fixed values: (label, template, key phrase, base).
TEMPLATES = (
    ("mit", "under the mit license", "under the mit license", True),
    ("apache-2", "apache license version 2", "apache license version 2", True),
    ("cc-by-nc", "cc by nc", "cc by nc", True),
    ("apache-2", "you may not use this file except in compliance with the license", "may not use this file except in compliance", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", False),
    ("cc-by-nc-4", "licensed under cc by nc 4 0", "cc by nc 4 0", False),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license", False),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3", False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "copy modify and or distribute this software for any purpose", False),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license", False),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge to any person", False),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0", False),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain", False),
    (
        "mit-notice",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. The software is provided "as is", without warranty of any
        kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose
        and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability,
        whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or
        other dealings in the software.""",
        "permission is hereby granted free of charge to any person", False,
    ),
    (
        "apache-2-notice",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
        "may not use this file except in compliance", False,
    ),
    (
        "bsd-notice",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        "redistribution and use in source and binary forms", False,
    ),
    (
        "gpl-3-notice",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
        is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        "gnu general public license as published by the free software foundation either version 3", False,
    ),
    (
        "isc-notice",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. The software is provided "as is" and
        the author disclaims all warranties with regard to this software including all implied warranties of merchantability and
        fitness.""",
        "copy modify and or distribute this software for any purpose", False,
    ),
    (
        "mpl-2-notice",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        "mozilla public license v 2 0", False,
    ),
    (
        "unlicense-notice",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
        "free and unencumbered software released into the public domain", False,
    ),
)
#: Matched share of a template's IDF.
COVERAGE = 0.6
_UPPER = "".join(chr(c) for c in range(65, 91))
_GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def parsed() -> list[tuple[str, list[str], int, int, bool]]:
    """(label, words, where the key phrase starts, its number of words, base) of every template."""
    out = []
    for label, text, phrase, base in TEMPLATES:
        words, key = re.findall("[a-z0-9]+", text.lower()), phrase.split()
        out.append((label, words, next(i for i in range(len(words)) if words[i : i + len(key)] == key), len(key), base))
    return out


VOCABULARY = sorted({w for _, words, _, _, _ in parsed() for w in words})


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z: one translation makes every ASCII sign that is no letter or digit a blank."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _GAPS, _UPPER.lower() + " " * len(_GAPS))
    return F.array_remove(F.split(plain, " ", -1), "")


def _texts(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def _tokenised(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words, held (the vocabulary words of the file, as a line) and text (null where no key phrase can be)."""
    cut = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    cut = cut.select("doc_id", "text", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", _texts(VOCABULARY)).alias("held"))
    phrases = sorted({tuple(sorted(set(words[at : at + n]))) for _, words, at, n, _ in parsed()})
    maybe = F.lit(False)
    for phrase in phrases:
        whole = F.array_contains("held", phrase[0])
        for word in phrase[1:]:
            whole = whole & F.array_contains("held", word)
        maybe = maybe | whole
    return durable(cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.array_join("held", " ").alias("held"), F.when(maybe, F.col("text")).alias("text")))


def _idf(files: DataFrame) -> dict[str, float]:
    """IDF of the fixed vocabulary over all documents (at most one row for each of its words)."""
    words = F.concat(F.array(F.lit("")), F.split("held", " "))  # the empty word counts the documents
    found = {r["w"]: r["n"] for r in files.select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = found.get("", 0)
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 1 for w in VOCABULARY}


def _index(files: DataFrame) -> DataFrame:
    """One row for each template, under the highest-IDF word of its key phrase."""
    idf = _idf(files)
    rows = []
    for label, words, at, n, base in parsed():
        anchor = max(range(at, at + n), key=lambda i: (idf[words[i]], words[i], -i))
        total = sum(idf[w] for w in words)
        rows.append((words[anchor], label, base, anchor, at, n, words, [idf[w] / total for w in words]))
    return files.sparkSession.createDataFrame(rows, "anchor string, label string, base boolean, offset int, key_at int, n_key int, template array<string>, shares array<double>")


_PLACES = """filter(
    transform(
        transform(filter(transform(words, (w, i) -> named_struct('w', w, 'i', i)), h -> h.w = anchor), h -> h.i - offset),
        s -> named_struct('at', s, 'same', filter(sequence(0, size(template) - 1), o -> coalesce(get(words, s + o) = template[o], false)))),
    p -> size(filter(p.same, o -> o >= key_at and o < key_at + n_key)) = n_key)"""


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    files = _tokenised(docs)
    index = _index(files)
    anchors = sorted({r["anchor"] for r in index.select("anchor").collect()})  # of the fixed templates
    some = files.where(F.col("text").isNotNull()).select("row", "doc_id", "n_words", words_of(F.col("text")).alias("words"), F.explode(F.array_intersect(F.split("held", " "), _texts(anchors))).alias("anchor"))
    # the index has a row for each fixed template
    met = some.join(F.broadcast(index), "anchor").select("row", "doc_id", "n_words", "label", "base", "shares", F.expr(_PLACES).alias("places"))
    shared = F.transform("places", lambda p: F.struct(p["at"].cast("long").alias("at"), F.aggregate(p["same"], F.lit(0.0), lambda acc, o: acc + F.get("shares", o)).alias("share")))
    met = met.select("row", "doc_id", "n_words", "label", "base", F.filter(shared, lambda p: p["share"] >= COVERAGE).alias("places"))
    base, starts = F.col("base") & (F.size("places") > 0), F.transform("places", lambda p: p["at"])

    def joined(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    found = met.groupBy("row", "doc_id", "n_words").agg(
        F.sum(F.when(base, F.size("places")).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.array_min(starts))).alias("first_word"), F.max(F.when(base, F.array_max(starts))).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.size("places") > 0).alias("labels"),
        F.coalesce(F.round(F.max(F.array_max(F.transform("places", lambda p: p["share"]))), 6), F.lit(0.0)).alias("score"),
    )
    none = files.where(F.col("text").isNull()).select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"),
        F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"),
    )
    return none.unionByName(found.drop("row"))


def oracle() -> str:
    """The relational form of the same scan: postings joined on words, grouped by start."""
    postings = []
    for t, (label, words, at, n, base) in enumerate(parsed()):
        postings += [f"({t},'{label}',{str(base).lower()},{i},'{w}',{str(at <= i < at + n).lower()})" for i, w in enumerate(words)]
    low = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH postings(t, label, base, o, w, in_key) AS (VALUES {",".join(postings)}),
docs AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
flat AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS pos FROM docs),
hits AS (SELECT * FROM flat WHERE w IN (SELECT w FROM postings)),
df AS (SELECT w, count(DISTINCT doc_id) AS n FROM hits GROUP BY w),
idf AS (SELECT v.w, ln(((SELECT count(*) FROM docs) + 1) / (coalesce(df.n, 0) + 1)::DOUBLE) + 1 AS s FROM (SELECT DISTINCT w FROM postings) v LEFT JOIN df USING (w)),
weighed AS (SELECT p.*, i.s / sum(i.s) OVER (PARTITION BY t) AS s, count(*) FILTER (WHERE in_key) OVER (PARTITION BY t) AS n_key FROM postings p JOIN idf i USING (w)),
places AS (
  SELECT h.doc_id, p.label, p.base, h.pos - p.o AS start_at, sum(p.s) AS share
  FROM hits h JOIN weighed p USING (w)
  GROUP BY h.doc_id, p.t, p.label, p.base, h.pos - p.o
  HAVING count(*) FILTER (WHERE p.in_key) = max(p.n_key) AND sum(p.s) >= {COVERAGE}),
summed AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start_at) FILTER (WHERE base) AS first_word, max(start_at) FILTER (WHERE base) AS last_word,
    array_to_string(list_sort(coalesce(list(DISTINCT label) FILTER (WHERE base), [])), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, round(max(share), 6) AS score
  FROM places GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(s.n_base, 0)::BIGINT AS n_base, s.first_word::BIGINT AS first_word, s.last_word::BIGINT AS last_word,
  coalesce(s.base_labels, '') AS base_labels, coalesce(s.labels, '') AS labels, coalesce(s.score, 0.0) AS score
FROM docs d LEFT JOIN summed s USING (doc_id)"""
