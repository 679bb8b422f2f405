"""Licence scans by sentence rules, natively: sentences become known identifiers, sequences of them meet ordered rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import only

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": 1,
    "licensed under the mit license": 1,
    "licensed under the apache license version 2 0": 2,
    "you may not use this file except in compliance with the license": 3,
    "this work is licensed under the gnu general public license version 3": 4,
    "licensed under cc by nc 4 0": 5,
    "licensed under cc by 4 0": 6,
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": 7,
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": 8,
    "permission is hereby granted free of charge to any person obtaining a copy of this software": 9,
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": 10,
    "licensed under the apache license version 2 0 the license": 2,
    "apache license version 2 0 january 2004": 11,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": 12,
    "gnu general public license version 3 29 june 2007": 13,
    "this work is licensed under a creative commons attribution 4 0 international license": 14,
    "this work is licensed under the creative commons attribution 4 0 international license": 14,
    "creative commons attribution 4 0 international public license": 14,
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": 15,
    "this work is licensed under the creative commons attribution noncommercial 4 0 international license": 15,
    "creative commons attribution noncommercial 4 0 international public license": 15,
}
#: Licences and the identifiers that must follow each other, first rule first.
RULES = (
    ("Apache-2.0", (2, 3)),
    ("BSD-3-Clause", (7, 8)),
    ("Apache-2.0", (2,)),
    ("Apache-2.0", (11,)),
    ("GPL-3.0", (4,)),
    ("GPL-3.0", (12,)),
    ("GPL-3.0", (13,)),
    ("CC-BY-NC-4.0", (5,)),
    ("CC-BY-NC-4.0", (15,)),
    ("CC-BY-4.0", (6,)),
    ("CC-BY-4.0", (14,)),
    ("BSD-2-Clause", (7,)),
    ("MIT", (1,)),
    ("MIT", (9,)),
    ("MIT", (10,)),
)
#: Steps of ``marked`` after lowering: what is replaced, and by what. U+0001 ends a sentence, U+0002 may end one.
MARKS = (
    (r"[\x01\x02]", " "),
    (r"\n[^a-z0-9]*\n", "\x01"),
    (r"[.!?][ \t\r\n]+", "\x01"),
    (r"[:;][ \t\r\n]+|\n", "\x02"),
    (r"[^a-z0-9\x01\x02]+", " "),
    (r"[ \x02]*\x01[ \x01\x02]*", "\n.\n"),
    (r" *\x02[ \x02]*", "\n\n"),
    (r"^ | $", ""),
)
def pattern(sentences: Mapping[str, int]) -> str:
    """A known sentence between two ends, longest first; its words may be parted by what may end a sentence."""
    return "\n(" + "|".join(k.replace(" ", r"(?: |\n\n)") for k in sorted(sentences, key=lambda k: (-len(k), k))) + ")\n"


PATTERN = pattern(SENTENCES)


def marked(text: Column) -> Column:
    """The normalised words of a text between its marks: a line feed on each side of an end, a full stop between those of a sure end."""
    text = F.lower(F.coalesce(text, F.lit("")))
    for what, by in MARKS:
        text = F.regexp_replace(text, what, by)
    return F.concat(F.lit("\n"), text, F.lit("\n"))


def scan(docs: DataFrame, sentences: Mapping[str, int] = SENTENCES, rules: Sequence[tuple[str, tuple[int, ...]]] = RULES) -> DataFrame:
    """(doc_id, sentence_ids, licenses, license) of every row of ``docs`` (doc_id, text).

    ``sentences``: normalised sentences (words of a-z and 0-9, one blank between) and their identifiers; ``rules``: a
    licence and the identifiers that must follow each other. Sentences end at . ! ? before white space or at a blank line,
    one without letters or digits. A line end and : ; may also end one or start one, so wrapped sentences, notices of one
    line and headings are all found. ``sentence_ids`` joins the identifiers found, in order. Rules are tried in their
    order, and what a rule has met no later rule meets again, so a longer rule stands before a shorter one. ``licenses``
    are the distinct licences met, in rule order; ``license`` is the first of them, or null. Null and empty texts have
    none; repeated rows are kept.
    """
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in sentences.items()))
    found = F.regexp_extract_all(marked(F.col("text")), F.lit(pattern(sentences)), F.lit(1))
    ids = F.transform(found, lambda s: F.element_at(known, F.regexp_replace(s, "\n\n", " ")))
    rows = only(docs, "doc_id", "text").select("doc_id", F.array_join(ids.cast("array<string>"), ",").alias("sentence_ids"))
    line = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    tried = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",".join(map(str, seq)) + ",").alias("seq")) for name, seq in rules])
    start = F.struct(line.alias("line"), F.array().cast("array<string>").alias("met"))

    def meet(state: Column, rule: Column) -> Column:
        hit = F.contains(state["line"], rule["seq"])
        return F.struct(F.replace(state["line"], rule["seq"], F.lit(",,")).alias("line"), F.when(hit, F.array_append(state["met"], rule["name"])).otherwise(state["met"]).alias("met"))

    met = F.when(F.col("sentence_ids") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.aggregate(tried, start, meet)["met"]))
    return rows.select("doc_id", "sentence_ids", met.alias("met")).select("doc_id", "sentence_ids", F.array_join("met", ",").alias("licenses"), F.get("met", F.lit(0)).alias("license"))
