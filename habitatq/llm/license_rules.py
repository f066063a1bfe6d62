"""Licence scan by sentence recognition.

A text is cut into sentences (at marks before white space, and at line breaks), each
sentence is normalised (A-Z lower-cased, everything but letters and digits one space) and
looked up among known licence sentences. The identifiers found, in text order and without
the unknown sentences between them, form a sequence, in which ordered licence rules are looked
for: a rule is a sequence of identifiers, and what it matches is used up for later rules. The
text is also read with line breaks as spaces, for licences broken into lines, and a rule
counts as often as the better of both readings has it.

Everything is a DataFrame expression; there is no shuffle and no Python on the executors.

Defined cases: a null or empty text has no licence and no row; repeated rows are answered one
by one; of two rules that start alike the one earlier in the list wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitatq.llm import words as W

#: Wording of public licences, normalised, by identifier.
SENTENCES = {
    "mit_ref": "released under the mit license",
    "mit_ref2": "licensed under the mit license",
    "apache_ref": "licensed under the apache license version 2 0",
    "apache_ref2": "licensed under the apache license version 2 0 the license",
    "apache_use": "you may not use this file except in compliance with the license",
    "gpl3_ref": "this work is licensed under the gnu general public license version 3",
    "gpl3_grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "by_nc_ref": "licensed under cc by nc 4 0",
    "by_ref": "licensed under cc by 4 0",
    "reserved": "all rights reserved",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights to use "
    "copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software "
    "is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution",
}
#: Licence and the identifiers that make it, most specific first.
RULES = (
    ("MIT", ("mit_grant", "mit_as_is")), ("MIT", ("mit_grant",)), ("MIT", ("mit_ref",)), ("MIT", ("mit_ref2",)),
    ("Apache-2.0", ("apache_ref2", "apache_use")), ("Apache-2.0", ("apache_ref2",)), ("Apache-2.0", ("apache_ref",)),
    ("GPL-3.0", ("gpl3_grant", "gpl_hope")), ("GPL-3.0", ("gpl3_grant",)), ("GPL-3.0", ("gpl3_ref",)),
    ("CC-BY-NC-4.0", ("by_nc_ref",)), ("CC-BY-4.0", ("by_ref",)), ("ISC", ("isc_grant",)),
    ("BSD", ("bsd_source", "bsd_binary")), ("all-rights-reserved", ("reserved",)),
)
#: Every known sentence has one of these, so texts without them are not cut up.
HINTS = ("licens", "warrant", "rights", "permission", "redistribut")
BREAK = "[.!?;]+([ \\t-\\r]+|$)|\\n"


def _counts(text: Column, sentences: dict[str, str], rules: tuple) -> list[Column]:
    """How often each rule matches one reading of the text."""
    codes = {name: f"<{i}>" for i, name in enumerate(sentences)}
    known = F.create_map(*[F.lit(x) for name, s in sentences.items() for x in (s, codes[name])])

    def code(sentence: Column) -> Column:
        return F.coalesce(F.try_element_at(known, F.trim(F.regexp_replace(W.ascii_lower(sentence), "[^a-z0-9]+", " "))), F.lit(""))

    left, out = F.array_join(F.transform(F.split(text, BREAK), code), ""), []
    for _, names in rules:
        pattern = "".join(codes[n] for n in names)
        out.append(((F.length(left) - F.length(F.replace(left, F.lit(pattern), F.lit("")))) / len(pattern)).cast("long"))
        left = F.replace(left, F.lit(pattern), F.lit("_"))
    return out


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES, hints: tuple[str, ...] = HINTS) -> DataFrame:
    """``doc_id, rule_no, license, n_matches``: one row for each rule that a document matches."""
    hinted = W.id_text(docs).filter(F.lower("text").rlike("|".join(hints)))
    read = hinted.select(
        "doc_id", F.array(*_counts(F.col("text"), sentences, rules)).alias("a"),
        F.array(*_counts(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), sentences, rules)).alias("b"),
    )
    each = read.select("doc_id", F.posexplode(F.zip_with("a", "b", lambda x, y: F.greatest(x, y))).alias("at", "n_matches"))
    names = F.array(*[F.lit(name) for name, _ in rules])
    return each.filter("n_matches > 0").select("doc_id", (F.col("at") + 1).alias("rule_no"), names[F.col("at")].alias("license"), "n_matches")


def sql(sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> str:
    """The scan in SQL, without the hints."""
    codes = {name: f"<{i}>" for i, name in enumerate(sentences)}
    known = ", ".join(f"'{s}'" for s in sentences.values())
    marks = ", ".join(f"'{c}'" for c in codes.values())
    lower = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sentence = f"trim(regexp_replace({lower}, '[^a-z0-9]+', ' ', 'g'))"
    cut = "'[.!?;]+([ \\t-\\r]+|$)|\\n'"
    steps = [f"""seq0 as (select doc_id, reading, array_to_string(list_transform(string_split_regex(body, {cut}),
        lambda x: coalesce(list_extract([{marks}], list_position([{known}], {sentence})), '')), '') as s
        from (select doc_id, 1 as reading, text as body from documents where text is not null
              union all select doc_id, 2, replace(text, chr(10), ' ') from documents where text is not null))"""]
    rows = []
    for i, (name, parts) in enumerate(rules):
        p = "".join(codes[n] for n in parts)
        steps.append(f"seq{i + 1} as (select doc_id, reading, replace(s, '{p}', '_') as s from seq{i})")
        rows.append(f"select doc_id, reading, {i + 1} as rule_no, '{name}' as license, "
                    f"(length(s) - length(replace(s, '{p}', ''))) // {len(p)} as n from seq{i}")
    return (f"with {', '.join(steps)} select doc_id, cast(rule_no as integer) as rule_no, license, cast(max(n) as bigint) as n_matches "
            f"from ({' union all '.join(rows)}) where n > 0 group by doc_id, rule_no, license")
