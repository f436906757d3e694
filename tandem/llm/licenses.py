"""Licence recognition by known sentences and the order in which they come.

A text is cut at line ends and after sentence marks, and its pieces are
normalised (lower case, runs of all but letters and digits become one space).
The known sentences are sought in the joined pieces, so a sentence may run over
any number of lines; it begins and ends with a piece, but for those of WITHIN,
which are parts of longer sentences. That gives a sequence of sentence
identifiers. A rule is a sequence of identifiers; it holds where a text's
sequence has its identifiers in that order, with others between them allowed.
The search runs in Arrow batches, all else is a column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Sentences of public licence texts and notices, as they are known.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-you": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-file": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,",
    "mit-notice": "Released under the MIT License.",
    "mit-name": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"),",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice,",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "gpl-version3": "either version 3 of the License, or (at your option) any later version.",
    "gpl-version2": "either version 2 of the License, or (at your option) any later version.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0.",
    "cc0-notice": "Released under CC0 1.0.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights": "All rights reserved.",
}
RULES = (
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-notice-you", "apache-file", "apache-copy")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-name", "mit-grant")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0", ("gpl-free", "gpl-version3")),
    ("GPL-2.0", ("gpl-free", "gpl-version2")),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("proprietary", ("all-rights",)),
)
#: Lines of a sentence in the SQL form, which has the sentences and rules above alone.
LINES = 3

# Sentences and rules of whole licence texts, which the SQL form does not have.
WHOLE = {
    "gpl3-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl2-preamble": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software",
}
WHOLE_RULES = (("GPL-3.0", ("gpl3-preamble",)), ("GPL-2.0", ("gpl2-preamble",)))
#: Parts of a sentence: they may begin and end inside a piece.
WITHIN = {
    "apache-copy", "apache-basis", "mit-grant", "mit-condition", "mit-warranty", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names",
    "gpl-free", "gpl-version3", "gpl-version2", "gpl2-preamble",
}


def normal(sentence: str) -> str:
    """Python's form of the normalisation, for the known sentences."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip(" ")


#: Normalised sentence to identifier, and the place of an identifier.
KNOWN = {normal(text): name for name, text in SENTENCES.items()}
NUMBER = {name: k for k, name in enumerate(SENTENCES)}
SOUGHT = KNOWN | {normal(text): name for name, text in WHOLE.items()}


def pieces(text: Column) -> Column:
    """Normalised pieces of a text: cut at line ends and after a sentence mark with a space; empty ones are left out."""
    cut = F.split(F.regexp_replace(text, r"([.!?;:])[ \t]+", "$1\n"), "[\r\n]+")
    low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    clean = lambda x: F.trim(F.regexp_replace(F.translate(x, low, low.lower()), "[^a-z0-9]+", " "))
    return F.filter(F.transform(cut, clean), lambda x: x != "")


def _pattern(sentence: str, name: str) -> re.Pattern[str]:
    """A known sentence in pieces joined by '|': words of letters and digits, with a space or '|' between them."""
    before, after = (r"(?<![^| ])", r"(?![^| ])") if name in WITHIN else (r"(?<![^|])", r"(?![^|])")
    return re.compile(before + "[ |]".join(sentence.split(" ")) + after)


def identifiers(joined: str, patterns: dict[str, re.Pattern[str]]) -> list[str]:
    """Identifiers of the known sentences in pieces joined by '|', by their place, the shorter first."""
    flat, found = joined.replace("|", " "), []
    for sentence, name in SOUGHT.items():
        if sentence in flat:
            found += [(m.start(), m.end(), name) for m in patterns[name].finditer(joined)]
    return [name for _, _, name in sorted(found)]


def _sought(docs: DataFrame, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {name: _pattern(sentence, name) for sentence, name in SOUGHT.items()}
        for batch in batches:
            found = pa.array([identifiers(x, patterns) for x in batch.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=[id_col, "n_sentences", "sentences"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(run, f"`{id_col}` {kind}, n_sentences bigint, sentences array<string>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, sentences, licenses) of every row.

    n_sentences: the pieces of the text; sentences: identifiers in the order of
    the text; licenses: names of the rules that hold, each once, in the order of
    RULES. Three BSD clauses are not two, unless a second grant without the
    third is there. Null and empty texts have none of either.
    """
    parts = docs.select(F.col(id_col), pieces(F.coalesce(F.col(text_col), F.lit(""))).alias("_parts"))
    found = _sought(parts.select(id_col, F.size("_parts").cast("bigint").alias("n_sentences"), F.array_join("_parts", "|").alias("_joined")), id_col)
    line = F.concat(F.lit(","), F.array_join("sentences", ",,"), F.lit(","))
    held = []
    for name, rule in (*RULES, *WHOLE_RULES):
        pattern = ",.*,".join(re.escape(x) for x in rule).join([",", ","])
        if name == "BSD-2-Clause":
            pattern += r"(?!(?:(?!,bsd-grant,).)*,bsd-names,)"
        held.append(F.when(line.rlike(pattern), F.lit(name)))
    return found.withColumn("licenses", F.array_distinct(F.filter(F.array(*held), lambda x: x.isNotNull())))
