"""Licence scan: canonical texts are looked up by digest.

Case, punctuation, copyright lines and equivalent spellings are normalised away; the digests of
a whole text and of each of its lines are then joined with the digests of known licence texts.
All of it is DataFrame functions.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylamp.llm.common import whole_text
from quarrylamp.operators.sizing import lookup_join

#: Equivalent spellings, applied in this order to lower-case text without punctuation.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("https ", "http "),
    ("copyright holder", "copyright owner"),
    ("merchantibility", "merchantability"),
    ("creative commons attribution noncommercial", "cc by nc"),
    ("creative commons attribution", "cc by"),
    ("gnu gpl", "gnu general public license"),
]

#: How a canonical copyright line begins: the sign, or the word with (c), a year, `by` or `year`.
COPYRIGHT = "^(©|(c )?copyright( (c|©)( |$)| [0-9]|.* (19|20)[0-9][0-9]( |$)| by | year))"

#: Words that follow `copyright` where a line goes on with a sentence.
SENTENCE = ["owner", "notice", "law", "license", "and", "interest", "statement", "or", "permission", "treaty"]

#: What licences are called in notices.
NAMES = {
    "0BSD": ["the BSD Zero Clause License", "the 0BSD License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache-2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2", "the GPL v2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3", "the GPL v3"],
    "ISC": ["the ISC License"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU LGPL v3"],
    "MIT": ["the MIT License", "MIT"],
    "MPL-2.0": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0", "MPL 2.0"],
    "Unlicense": ["the Unlicense"],
    "Zlib": ["the zlib License"],
}

#: How a notice names a licence.
FORMS = [
    "Licensed under {}.", "Released under {}.", "Distributed under {}.", "Available under {}.",
    "This work is licensed under {}.", "This program is licensed under {}.", "This software is licensed under {}.",
    "This project is licensed under {}.", "This file is licensed under {}.", "This code is licensed under {}.",
    "This Source Code Form is subject to the terms of {}.",
]

#: Whole licence texts, a JSON object (licence, text) a line.
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licences.jsonl")

#: The line after which a licence only says how it is applied.
END = "END OF TERMS AND CONDITIONS"


def notices() -> list[tuple[str, str]]:
    """(licence, notice) in every form, and the tags of licences."""
    found = [(licence, form.format(name)) for licence, names in NAMES.items() for name in names for form in FORMS]
    tags = [(licence, f"SPDX-License-Identifier: {licence}") for licence in NAMES]
    return found + tags + [("all-rights-reserved", "All rights reserved.")]


def whole_texts(path: str = TEXTS) -> list[tuple[str, str]]:
    """(licence, text) of the stored texts: whole, without their title, and without what follows the terms."""
    found = []
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            one = json.loads(line)
            text = one["text"].strip()
            title, _, body = text.partition("\n\n")
            for part in (text, body) if body.strip() else (text,):
                terms, end, _ = part.partition(END)
                found += [(one["licence"], part)] + ([(one["licence"], terms), (one["licence"], terms + end)] if end else [])
    return found


def known_licences(spark: SparkSession, path: str = TEXTS) -> DataFrame:
    """(licence, text): notices and whole texts; some hundred rows and under a megabyte."""
    return spark.createDataFrame(notices() + whole_texts(path), "licence string, text string")


def spelled(plain: Column) -> Column:
    """Canonical text with equivalent spellings made one."""
    for spelling, common in SPELLINGS:
        plain = F.replace(plain, F.lit(spelling), F.lit(common))
    return plain


def canonical(line: Column) -> Column:
    """One line in canonical form; empty where it is blank or a copyright line."""
    plain = spelled(F.btrim(F.regexp_replace(F.lower(line), "[^\\p{L}\\p{N}©]+", " ")))
    mark = plain.rlike(COPYRIGHT)
    sentence = plain.rlike(f"^copyright ({'|'.join(SENTENCE)})s?( |$)")
    return F.when(mark & ~sentence, "").otherwise(plain)


def _digested(texts: DataFrame) -> DataFrame:
    """Add `whole` (digest of all lines) and `parts` (digests of single lines) for a column `text`."""
    lines = F.filter(F.transform(F.split("text", "\n"), canonical), lambda x: x != "")
    # A spelling may be cut by the end of a line, so the whole is spelled anew.
    return texts.withColumn("lines", lines).withColumns(
        {
            "whole": F.when(F.size("lines") > 0, F.md5(spelled(F.array_join("lines", " ")))),
            "parts": F.array_distinct(F.transform("lines", lambda x: F.md5(x))),
        }
    ).drop("lines", "text")


def scan(documents: DataFrame, licences: DataFrame) -> DataFrame:
    """Known licences in every row of `documents` (doc_id, text; other columns are ignored).

    `licences` has licence and text.  Returns (doc_id, whole_licence, licences, n_licences): the
    licence whose text is the whole document (the first by name, null if none), and the sorted
    names of all licences that are the whole document or one of its lines, joined by commas
    (empty if none).  Null and empty texts hold no licence.  Rows that share a doc_id are one
    document.  An empty table gives an empty one.
    """
    known = _digested(licences.select("licence", "text")).filter("whole is not null")
    known = known.groupBy(F.col("whole").alias("digest")).agg(F.min("licence").alias("licence"))
    read = _digested(documents.select("doc_id", whole_text("text").alias("text")))
    units = read.select(
        "doc_id",
        F.explode_outer(
            F.concat(
                F.array(F.struct(F.lit(True).alias("is_whole"), F.col("whole").alias("digest"))),
                F.transform("parts", lambda p: F.struct(F.lit(False).alias("is_whole"), p.alias("digest"))),
            )
        ).alias("unit"),
    ).select("doc_id", "unit.is_whole", "unit.digest")
    # The known digests pass a check of their size and are broadcast, so only hits ever move.
    found = lookup_join(units, known, ["digest"]).groupBy("doc_id").agg(
        F.min(F.when(F.col("is_whole"), F.col("licence"))).alias("whole_licence"),
        F.array_sort(F.collect_set("licence")).alias("names"),
    ).withColumnRenamed("doc_id", "_doc")
    every = documents.select("doc_id").distinct()
    return every.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select(
        "doc_id", "whole_licence",
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licences"),
        F.coalesce(F.size("names"), F.lit(0)).alias("n_licences"),
    )
