"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised, known licence sentences become identifiers (also where they are wrapped
over lines), and the sequence of identifiers is matched against ordered rules: a licence is found where its rule's
identifiers follow each other with no other known sentence between them. Longer rules go first and use up what they
match, so that a licence whose text is contained in another's is not found there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences by identifier, as written in the licences; [text, ...] are variants of one sentence (fixed values).
SENTENCES: dict[str, list[str]] = {
    "apache_ref": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")", "This project is licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0."],
    "apache_comply": ["you may not use this file except in compliance with the License."],
    "apache_copy": ["You may obtain a copy of the License at"],
    "apache_asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache_see": ["See the License for the specific language governing permissions and limitations under the License."],
    "mit_ref": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "Distributed under the MIT License."],
    "mit_title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit_grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit_warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "bsd_redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd_ref": ["Licensed under the BSD License.", "Licensed under the BSD 3-Clause License.", "Released under the BSD License."],
    "gpl3_ref": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GPLv3."],
    "gpl2_ref": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Licensed under the GPLv2."],
    "gpl_free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify"],
    "gpl_hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "lgpl_ref": ["Licensed under the GNU Lesser General Public License, version 3.", "Licensed under the LGPLv3."],
    "agpl_ref": ["Licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPLv3."],
    "mpl_ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "cc_by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc_by_sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc_by_nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "reserved": ["All rights reserved."],
}
# Rules: a licence, and the sentence identifiers that follow each other where it is stated (fixed values). The order in
# which they are tried is by length, longest first, and as listed among equally long ones.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache_ref"]),
    ("Apache-2.0", ["apache_comply", "apache_copy"]),
    ("Apache-2.0", ["apache_asis", "apache_see"]),
    ("MIT", ["mit_ref"]),
    ("MIT", ["mit_title", "mit_grant"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("MIT", ["mit_notice", "mit_warranty"]),
    ("BSD-3-Clause", ["reserved", "bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-3-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["reserved", "bsd_redistribution", "bsd_source", "bsd_binary"]),
    ("BSD-2-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary"]),
    ("BSD-3-Clause", ["bsd_ref"]),
    ("GPL-3.0", ["gpl3_ref"]),
    ("GPL-2.0", ["gpl2_ref"]),
    ("GPL-3.0", ["gpl_free", "gpl_hope"]),
    ("LGPL-3.0", ["lgpl_ref"]),
    ("AGPL-3.0", ["agpl_ref"]),
    ("MPL-2.0", ["mpl_ref"]),
    ("CC-BY-4.0", ["cc_by"]),
    ("CC-BY-SA-4.0", ["cc_by_sa"]),
    ("CC-BY-NC-4.0", ["cc_by_nc"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("ISC", ["isc_grant"]),
    ("All-Rights-Reserved", ["reserved"]),
]
# A sentence ends at a line break, or at . ! ? : ; before white space (fixed value; the same in Java's and RE2's syntax).
SENTENCE_END = "[.!?:;]*[ \\t\\r]*\\n|[.!?:;]+[ \\t\\r]+"
# A line break with no end of a sentence before it, where a sentence may go on; it is marked by the character SOFT.
SOFT, SOFT_BREAK = "\x01", "(?<![.!?:; \\t\\r])([ \\t\\r]*\\n)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise_text(sentence: str) -> str:
    """How a sentence is compared: A-Z in lower case, every run of other characters than a-z and 0-9 one space, trimmed."""
    import re

    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def sentence_ids() -> dict[str, str]:
    """Normalised sentences to identifiers. Sentences are cut as texts are, so that inner ends do not hide them."""
    import re

    known = {}
    for name, variants in SENTENCES.items():
        for v in variants:
            parts = [normalise_text(p) for p in re.split(SENTENCE_END, v)]
            known[max(parts, key=len)] = name
    return known


USED = "|-|"  # stands for identifiers that a rule has used up


def spelt(rule: list[str]) -> str:
    return "".join(f"|{x}|" for x in rule)


def ordered_rules() -> list[tuple[str, list[str]]]:
    return sorted(RULES, key=lambda r: -len(r[1]))


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_sentences (known ones), sentence_seq, licenses (sorted, comma-joined), n_licenses, first_sentence.

    sentence_seq has the identifiers in text order, each between bars; first_sentence is the position of the first known
    sentence among all sentences of the text, -1 without one. A line break ends a sentence, unless the lines that follow
    up to the next end or blank line complete a known one: that counts once, the longest from the left. Comment leaders
    of other characters than letters and digits do not matter. first_sentence counts the lines of wrapped ones. Null and empty texts have none. The whole text is cut; a
    repeated row gets its own row; other columns of docs are ignored.
    """
    known = sentence_ids()
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    longest = max(map(len, known))
    first = "^(" + "|".join(sorted({k.split(" ")[0] for k in known})) + ")( |$)"
    text = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), SOFT, "\x02"), SOFT_BREAK, SOFT + "$1")
    docs = docs.select("doc_id", F.split(text, SENTENCE_END).alias("parts"))
    # s is a normalised part, soft whether the sentence may go on in the next one.
    docs = docs.select("doc_id", F.transform("parts", lambda p: F.struct(normalised(p).alias("s"), F.endswith(p, F.lit(SOFT)).alias("soft"))).alias("parts"))
    # Only parts short enough to be a known sentence after normalising can be one if they aren't mostly punctuation; those are cut too.
    look = lambda s: F.when(F.length(s) <= longest, F.element_at(table, s))

    def further(x: Column, part: Column) -> Column:
        """x: the joined parts so far, whether they go on, how many they are, and the longest known sentence among them."""
        joined = F.concat_ws(" ", x["s"], part["s"])
        on = x["on"] & (part["s"] != "") & (F.length(joined) <= longest)
        hit = F.when(on, F.element_at(table, joined))
        return F.struct(
            F.when(on, joined).otherwise(x["s"]).alias("s"), (on & part["soft"]).alias("on"), (x["n"] + 1).alias("n"),
            F.coalesce(hit, x["id"]).alias("id"), F.when(hit.isNotNull(), x["n"] + 1).otherwise(x["len"]).alias("len"),
        )

    def sentence(p: Column, i: Column) -> Column:
        """The longest known sentence that begins with part i; a known one has two characters a part at least, so that no more parts are looked at."""
        start = F.struct(p["s"].alias("s"), p["soft"].alias("on"), F.lit(1).alias("n"), look(p["s"]).alias("id"), F.lit(1).alias("len"))
        run = F.aggregate(F.slice("parts", i + 2, longest // 2 + 1), start, further)
        wrapped = F.when(p["soft"] & p["s"].rlike(first), F.transform(F.array(run), lambda x: F.struct(x["id"].alias("id"), i.alias("at"), x["len"].alias("len")))[0])
        return F.coalesce(wrapped, F.struct(look(p["s"]).alias("id"), i.alias("at"), F.lit(1).alias("len")))

    docs = docs.select("doc_id", F.filter(F.transform("parts", sentence), lambda x: x["id"].isNotNull()).alias("hits"))
    # What lies inside a longer sentence that began before is no sentence of its own.
    empty = F.array().cast("array<struct<id:string,at:int,len:int>>")
    over = F.aggregate("hits", empty, lambda kept, x: F.when((F.size(kept) > 0) & (F.get(kept, F.size(kept) - 1)["at"] + F.get(kept, F.size(kept) - 1)["len"] > x["at"]), kept).otherwise(F.concat(kept, F.array(x))))
    docs = docs.select("doc_id", F.when(F.exists("hits", lambda x: x["len"] > 1), over).otherwise(F.col("hits")).alias("hits"))
    seq = F.concat(F.lit("|"), F.array_join(F.transform("hits", lambda x: x["id"]), "|"), F.lit("|"))
    docs = docs.select("doc_id", F.size("hits").cast("long").alias("n_sentences"), seq.alias("sentence_seq"), F.size("hits").alias("k"), F.coalesce(F.get("hits", F.lit(0))["at"], F.lit(-1)).cast("long").alias("first_sentence"))
    # Each identifier gets its own bars, so that a rule's text never shares a bar with its neighbour's.
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(spelt(rule)).alias("ids")) for name, rule in ordered_rules()])
    start = F.struct(F.replace("sentence_seq", F.lit("|"), F.lit("||")).alias("left"), F.array().cast("array<string>").alias("found"))

    def use(s: Column, rule: Column) -> Column:
        hit = F.contains(s["left"], rule["ids"])
        return F.struct(
            F.when(hit, F.replace(s["left"], rule["ids"], F.lit(USED))).otherwise(s["left"]).alias("left"),
            F.when(hit, F.array_append(s["found"], rule["name"])).otherwise(s["found"]).alias("found"),
        )

    found = F.when(F.col("k") > 0, F.array_sort(F.array_distinct(F.aggregate(rules, start, use)["found"]))).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumn("found", found)
    return docs.select("doc_id", "n_sentences", "sentence_seq", F.array_join("found", ",").alias("licenses"), F.size("found").cast("long").alias("n_licenses"), "first_sentence")


def scan_sql() -> str:
    """scan() over documents in DuckDB SQL: candidates for wrapped sentences by a join on their number of parts, then the
    first and longest ones step by step, then the rules one after the other."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = sentence_ids()
    table = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known.items())
    firsts = ", ".join(quote(x) for x in sorted({k.split(" ")[0] for k in known}))
    rules = ", ".join(f"({i}, {quote(name)}, {quote(spelt(rule))})" for i, (name, rule) in enumerate(ordered_rules()))
    most = max(map(len, known)) // 2 + 2
    return rf"""
    WITH RECURSIVE known(s, id) AS (VALUES {table}), rules(r, name, ids) AS (VALUES {rules}),
    marked AS (SELECT doc_id, row_number() OVER () AS d, regexp_split_to_array(regexp_replace(replace(coalesce(text, ''), chr(1), chr(2)),
                 '([^.!?:; \t\r])([ \t\r]*\n)', '\1' || chr(1) || '\2', 'g'), '{SENTENCE_END}') AS parts FROM documents),
    part AS (SELECT d, i, trim(regexp_replace(translate(parts[i], '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' ') AS s, suffix(parts[i], chr(1)) AS soft
             FROM (SELECT d, parts, unnest(range(1, len(parts) + 1)) AS i FROM marked)),
    -- A wrapped sentence: from a part that may begin one, over parts that go on and are not blank.
    grown(d, i, n, s, soft) AS (
      SELECT d, i, 1, s, soft FROM part WHERE split_part(s, ' ', 1) IN ({firsts}) AND soft
      UNION ALL
      SELECT g.d, g.i, g.n + 1, g.s || ' ' || p.s, p.soft FROM grown g JOIN part p ON p.d = g.d AND p.i = g.i + g.n
      WHERE g.soft AND p.s <> '' AND g.n < {most} AND length(g.s) + 1 + length(p.s) <= (SELECT max(length(s)) FROM known)),
    sentence AS (SELECT d, i, n, id FROM grown JOIN known USING (s) UNION SELECT d, i, 1, id FROM part JOIN known USING (s)),
    longest AS (SELECT d, i, max(n) AS n, max_by(id, n) AS id FROM sentence GROUP BY d, i),
    -- From the left: the next sentence begins where the one before has ended.
    taken(d, i, n, id) AS (
      SELECT d, min(i), arg_min(n, i), arg_min(id, i) FROM longest GROUP BY d
      UNION ALL
      SELECT d, i, n, id FROM (SELECT l.*, row_number() OVER (PARTITION BY l.d ORDER BY l.i) AS k FROM taken t JOIN longest l ON l.d = t.d AND l.i >= t.i + t.n) WHERE k = 1),
    seq AS (SELECT d, count(*) AS k, '|' || string_agg(id, '|' ORDER BY i) || '|' AS sentence_seq, min(i) - 1 AS place FROM taken GROUP BY d),
    used(d, r, rest, found) AS (
      SELECT d, 0, replace(sentence_seq, '|', '||'), CAST([] AS VARCHAR[]) FROM seq
      UNION ALL
      SELECT d, u.r + 1, replace(rest, ids, '{USED}'), CASE WHEN contains(rest, ids) THEN list_append(found, name) ELSE found END FROM used u JOIN rules USING (r)),
    final AS (SELECT d, list_sort(list_distinct(found)) AS found FROM used WHERE r = (SELECT count(*) FROM rules))
    SELECT doc_id, coalesce(k, 0)::BIGINT AS n_sentences, coalesce(sentence_seq, '||') AS sentence_seq, coalesce(array_to_string(found, ','), '') AS licenses,
           coalesce(len(found), 0)::BIGINT AS n_licenses, coalesce(place, -1)::BIGINT AS first_sentence
    FROM marked LEFT JOIN seq USING (d) LEFT JOIN final USING (d)"""
