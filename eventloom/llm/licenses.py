"""Licence scans by sentence rules.

The text is normalised to words with marks where a sentence may end, and the known
licence sentences are looked for between marks. A sentence always ends at . ! ? and
at a blank line; at a single line break (with the comment prefix of the next line)
and at ; or : it may end or go on, so wrapped notices, 'free software: you can' and
'SPDX-License-Identifier: MIT' are found as well as notices on lines of their own.
The identifiers found, in text order, form a sequence; a rule names the identifiers
that must follow each other in that order (unknown sentences and other known ones
may lie between). A document gets every licence of which a rule matches, and the
class of the strictest of them.

The sentence table and the rules are constants of a fixed size and become literals
of the plan: the scan needs no join, shuffle or Python. Only texts that hold one of
the cue words are normalised.

Defined cases: null and empty texts have no sentences and no licence; a sentence
that occurs again is in the sequence again; ties do not arise (all matching licences
are given, in the order of the rules); an empty table gives an empty result;
a line that is a known sentence and begins a longer one gives both; repeated rows are scanned each; extra columns pass through ``scan``, and columns
named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, table

#: Normalised sentences of public licence texts and notices, with their identifiers.
SENTENCES = {
    "mit-reference": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "spdx license identifier mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache-reference": ["licensed under the apache license version 2 0", "this work is licensed under the apache license version 2 0", "spdx license identifier apache 2 0"],
    "apache-header": ["licensed under the apache license version 2 0 the license"],
    "apache-condition": ["you may not use this file except in compliance with the license"],
    "gpl3-reference": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later"],
    "gpl-grant": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-endorsement": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-warranty": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "cc-by-nc-reference": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-reference": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-reference": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0-reference": ["this work is dedicated to the public domain under cc0 1 0", "spdx license identifier cc0 1 0"],
}
#: (licence, class, identifiers in order). A licence may have several rules.
RULES = (
    ("MIT", "permissive", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", "permissive", ("mit-reference",)),
    ("Apache-2.0", "permissive", ("apache-header", "apache-condition")),
    ("Apache-2.0", "permissive", ("apache-reference",)),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-endorsement", "bsd-warranty")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-warranty")),
    ("CC0-1.0", "permissive", ("cc0-reference",)),
    ("CC-BY-4.0", "attribution", ("cc-by-reference",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-reference",)),
    ("GPL-3.0", "copyleft", ("gpl-grant", "gpl-warranty")),
    ("GPL-3.0", "copyleft", ("gpl3-reference",)),
    ("CC-BY-NC-4.0", "restricted", ("cc-by-nc-reference",)),
)
CLASSES = ("permissive", "attribution", "copyleft", "restricted")
CUES = ("licen", "permission", "permitted", "copyright", "redistribut", "warrant", "public domain")
#: Marks, in upper case because the text is in lower case by then: a sentence ends at END and may end at MAYBE.
END, MAYBE = "E", "M"
#: What becomes a mark, in this order: blank lines (also of comment signs only), single line breaks with the signs that begin the next line, . ! ? ; :
MARKS = ((r"\n[^a-z0-9]*\n[^a-z0-9\n]*", END), (r"\n[^a-z0-9\n]*", MAYBE), (r"[.!?]+(?=[ \t]|$)", END), (r"[;:]+(?=[ \t]|$)", MAYBE))
OTHER = "[^a-z0-9]+"
LICENCES = tuple(dict.fromkeys(name for name, _, _ in RULES))


def _lookup(sentence: Column) -> Column:
    pairs = [F.lit(x) for key, texts in SENTENCES.items() for text in texts for x in (text, key)]
    return F.element_at(F.create_map(*pairs), sentence)


def marked(text: Column) -> Column:
    """Lower-case words and marks, one space between, an END first and last."""
    text = F.translate(F.replace(ascii_lower(text), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    for pattern, mark in MARKS:
        text = F.regexp_replace(text, pattern, f" {mark} ")
    return F.concat(F.lit(f"{END} "), F.trim(F.regexp_replace(text, f"[^a-z0-9{END}{MAYBE}]+", " ")), F.lit(f" {END}"))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences, in order."""
    # The longest first, so that a sentence is not taken for one that it begins with.
    known = sorted((x for texts in SENTENCES.values() for x in texts), key=len, reverse=True)
    either = "|".join(x.replace(" ", f" (?:{MAYBE} )*") for x in known)
    found = F.regexp_extract_all(marked(text), F.lit(f"(?<=[{END}{MAYBE}] )({either})(?= [{END}{MAYBE}])"), F.lit(1))

    def looked_up(sentence: Column) -> Column:
        parts = F.split(sentence, f" (?:{MAYBE} )+")
        return F.array_distinct(F.concat(F.transform(parts, _lookup), F.array(_lookup(F.array_join(parts, " ")))))

    return F.filter(F.flatten(F.transform(found, looked_up)), lambda x: x.isNotNull())


def matches(sequence: Column, rule: tuple[str, ...]) -> Column:
    """Whether ';a;b;...;' holds the rule's identifiers in order."""
    return sequence.like("%;" + ";%;".join(rule) + ";%") if len(rule) == 1 else sequence.rlike(";" + ";(?:.*;)?".join(rule) + ";")


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_known (known sentences), sequence, licenses (both joined by ';') and license_class."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cue = text.rlike("(?i)" + "|".join(c.replace(" ", OTHER) for c in CUES))
    found = F.when(cue, identifiers(text)).otherwise(F.array().cast("array<string>"))
    seq = F.concat(F.lit(";"), F.array_join("__el_ids", ";"), F.lit(";"))
    hit = {}
    for name in LICENCES:
        rules = [matches(F.col("__el_seq"), ids) for licence, _, ids in RULES if licence == name]
        test = rules[0]
        for r in rules[1:]:
            test = test | r
        hit[name] = test
    named = F.array_join(F.filter(F.array(*[F.when(hit[n], F.lit(n)) for n in LICENCES]), lambda x: x.isNotNull()), ";")
    strict = F.lit(None).cast("string")
    for kind in CLASSES:
        for name in dict.fromkeys(n for n, k, _ in RULES if k == kind):
            strict = F.when(hit[name], F.lit(kind)).otherwise(strict)
    return (
        df.withColumn("__el_ids", found)
        .withColumn("__el_seq", seq)
        .withColumns(
            {
                "n_known": F.size("__el_ids").cast("long"),
                "sequence": F.array_join("__el_ids", ";"),
                "licenses": named,
                "license_class": F.coalesce(strict, F.lit("none")),
            }
        )
        .drop("__el_ids", "__el_seq")
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_known", "sequence", "licenses", "license_class")


def _oracle() -> str:
    known = ", ".join(f"('{text}', '{key}')" for key, texts in SENTENCES.items() for text in texts)
    tests = {}
    for name in LICENCES:
        parts = []
        for licence, _, ids in RULES:
            if licence == name:
                parts.append("regexp_matches(seq, ';" + ";(?:.*;)?".join(ids) + ";')")
        tests[name] = "(" + " OR ".join(parts) + ")"
    named = ", ".join(f"CASE WHEN {tests[n]} THEN '{n}' END" for n in LICENCES)
    kinds = {n: k for n, k, _ in RULES}
    strict = " ".join(
        f"WHEN {' OR '.join(tests[n] for n in LICENCES if kinds[n] == kind)} THEN '{kind}'" for kind in reversed(CLASSES)
    )
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
s AS (
  SELECT doc_id, unnest(list_zip(parts, range(1, len(parts) + 1))) AS p FROM (
    SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[\\n\\r]+|[.!?;:]+(?:[ \\t]+|$)') AS parts FROM documents)
), n AS (
  SELECT doc_id, p[2] AS at, trim(regexp_replace(translate(p[1], '{UPPER}', '{LOWER}'), '{OTHER}', ' ', 'g')) AS sentence FROM s
), f AS (
  SELECT n.doc_id, string_agg(known.id, ';' ORDER BY n.at) AS sequence, count(*) AS n_known FROM n JOIN known USING (sentence) GROUP BY n.doc_id
), d AS (
  SELECT doc_id, coalesce(n_known, 0)::BIGINT AS n_known, coalesce(sequence, '') AS sequence, ';' || coalesce(sequence, '') || ';' AS seq
  FROM documents LEFT JOIN f USING (doc_id)
)
SELECT doc_id, n_known, sequence,
  array_to_string(list_filter([{named}], lambda x: x IS NOT NULL), ';') AS licenses,
  CASE {strict} ELSE 'none' END AS license_class
FROM d
"""


ORACLE_SQL = _oracle()
