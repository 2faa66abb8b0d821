"""Licence scans by sentence rules, in Spark's own expressions only.

A text is normalised (lower case, letters and digits, single blanks) with marks where a sentence or a line ends. Known
licence sentences are looked up from mark to mark, whatever marks stand inside them, so a notice is found whether it is
wrapped or not and though its wording holds ``; : .`` itself. The identifiers of a text, in order, are matched against
ordered licence rules: a rule is a sequence of identifiers, and it is met where those stand in that order with at most
``GAP`` other sentences between two; wrapped lines of a paragraph are one sentence there. Everything happens inside a
row, so there is no shuffle and no hot group.

Null and empty texts have no sentence and no licence. Extra columns are passed by; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences that may stand between two of a rule.
GAP = 2

#: Normalised licence sentences and their identifiers (fixed values: wordings of the public licence notices).
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache-2.0/short",
    "licensed under the apache license version 2 0 the license": "apache-2.0/notice",
    "you may not use this file except in compliance with the license": "apache-2.0/compliance",
    "you may obtain a copy of the license at": "apache-2.0/copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0/basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2.0/limits",
    "released under the mit license": "mit/short",
    "licensed under the mit license": "mit/short",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit/grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit/notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit/warranty",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0/short",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0/short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3.0/terms",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2.0/terms",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl/hope",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0/short",
    "licensed under cc by 4 0": "cc-by-4.0/short",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0/short",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0/short",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0/short",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0/short",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd/grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd/source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd/binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd/name",
    "licensed under the bsd 3 clause license": "bsd-3-clause/short",
    "licensed under the bsd 2 clause license": "bsd-2-clause/short",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0/notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2.0/copy",
    "this is free and unencumbered software released into the public domain": "unlicense/domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense/anyone",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl-2.1/terms",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3.0/terms",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl/hope",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3.0/terms",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc/grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd/grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc/warranty",
    "this software is provided as is without any express or implied warranty": "zlib/warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib/grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-1.0/grant",
    "distributed under the boost software license version 1 0": "bsl-1.0/short",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "epl-2.0/notice",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl/copy",
    "this font software is licensed under the sil open font license version 1 1": "ofl-1.1/notice",
    "this database is made available under the open database license": "odbl-1.0/notice",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "cc0-1.0/deed",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0/short",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4.0/short",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-4.0/short",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-4.0/short",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa-4.0/short",
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "cc-by-nc-nd-4.0/short",
    "this project is licensed under the mit license": "mit/short",
    "this software is released under the mit license": "mit/short",
    "this project is licensed under the apache license version 2 0": "apache-2.0/short",
    "licensed under the isc license": "isc/short",
    "use of this source code is governed by a bsd style license that can be found in the license file": "bsd-style/notice",
}

#: Ordered rules: licence and the sequence that shows it; of two that a sequence meets, the earlier one's licence counts first.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache-2.0/notice", "apache-2.0/compliance"]),
    ("Apache-2.0", ["apache-2.0/basis", "apache-2.0/limits"]),
    ("Apache-2.0", ["apache-2.0/short"]),
    ("MIT", ["mit/grant", "mit/warranty"]),
    ("MIT", ["mit/grant", "mit/notice"]),
    ("MIT", ["mit/short"]),
    ("GPL-3.0", ["gpl-3.0/terms", "gpl/hope"]),
    ("GPL-3.0", ["gpl-3.0/short"]),
    ("GPL-2.0", ["gpl-2.0/terms", "gpl/hope"]),
    ("GPL-2.0", ["gpl-2.0/short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0/short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0/short"]),
    ("CC-BY-4.0", ["cc-by-4.0/short"]),
    ("BSD-3-Clause", ["bsd/grant", "bsd/source", "bsd/binary", "bsd/name"]),
    ("BSD-3-Clause", ["bsd-3-clause/short"]),
    ("BSD-2-Clause", ["bsd/grant", "bsd/source", "bsd/binary"]),
    ("BSD-2-Clause", ["bsd-2-clause/short"]),
    ("MPL-2.0", ["mpl-2.0/notice"]),
    ("Unlicense", ["unlicense/domain"]),
    ("Unlicense", ["unlicense/anyone"]),
    ("LGPL-2.1", ["lgpl-2.1/terms", "lgpl/hope"]),
    ("LGPL-3.0", ["lgpl-3.0/terms", "lgpl/hope"]),
    ("AGPL-3.0", ["agpl-3.0/terms", "gpl/hope"]),
    ("ISC", ["isc/grant", "isc/warranty"]),
    ("ISC", ["isc/short"]),
    ("0BSD", ["0bsd/grant", "isc/warranty"]),
    ("Zlib", ["zlib/warranty", "zlib/grant"]),
    ("BSL-1.0", ["bsl-1.0/grant"]),
    ("BSL-1.0", ["bsl-1.0/short"]),
    ("EPL-2.0", ["epl-2.0/notice"]),
    ("WTFPL", ["wtfpl/copy"]),
    ("OFL-1.1", ["ofl-1.1/notice"]),
    ("ODbL-1.0", ["odbl-1.0/notice"]),
    ("CC0-1.0", ["cc0-1.0/deed"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4.0/short"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4.0/short"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4.0/short"]),
    ("BSD-style", ["bsd-style/notice"]),
]

#: Marks of a normalised text: the end of a sentence, of a line, around a known sentence; and what stands for a word
#: of other letters or an address.
END, LINE, KNOWN, OTHER = "\x01", "\x02", "\x03", "\x04"
#: A sentence ends at a line without letters and digits, or at . ! ? ; : with white space behind it.
SENTENCE_END = rf"(?<![.!?;:])[.!?;:]++[ \t\n\x0B\x0C]+|\n[^a-z0-9{LINE}{OTHER}]*\n"
#: Words of which any known sentence has one; most texts hold none, and are done at once.
WORDS = r"(?i)licen[sc]e|permission|redistribut|warrant|unencumbered|anyone is free|associated a work|\bmpl\b"
#: How the SQL cuts and looks: from stop or line end to the next one, so it agrees where no known sentence holds one.
SPLIT = r"[.!?;:]+[ \t\r\n\x0B\x0C]+|[\r\n]+"
HINT = r"(?i)licen[sc]e|permission|redistribut|warrant|free software|public domain|above copyright|anyone is free|copy of the mpl"


def normalised(text: Column) -> Column:
    """Words, marks and ``OTHER`` with single blanks between, a mark at both ends."""
    text = F.translate(F.replace(F.lower(text), F.lit("\r\n"), F.lit("\n")), f"\r{END}{LINE}{KNOWN}{OTHER}", "\n    ")
    text = F.regexp_replace(text, r"https?://\S+", f" {LINE} {OTHER} {LINE} ")
    text = F.regexp_replace(text, r"[\p{L}\p{N}&&[^\x00-\x7F]]+", f" {OTHER} ")
    text = F.regexp_replace(F.regexp_replace(text, SENTENCE_END, f" {END} "), "\n", f" {LINE} ")
    return F.concat(F.lit(f"{END} "), F.btrim(F.regexp_replace(text, f"[^a-z0-9{END}{LINE}{OTHER}]+", " ")), F.lit(f" {END}"))


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """array<struct<at, id>> of the known sentences of a text: their numbers among its sentences and identifiers."""
    between = f" (?:[{END}{LINE}{OTHER}] )*+"
    wordings = "|".join(between.join(s.split()) for s in sorted(sentences, key=len, reverse=True))  # of two, the longer
    others = f"(?: {OTHER})*+"
    marked = F.regexp_replace(normalised(text), f"([{END}{LINE}]{others} )({wordings})(?={others} [{END}{LINE}])", f"$1{KNOWN}$2{KNOWN}")
    parts = F.split(marked, KNOWN)
    before = F.transform(F.filter(parts, lambda _, i: i % 2 == 0), lambda x: F.regexp_count(x, F.lit(f"[a-z0-9{OTHER}][^{END}]*")))
    known = F.create_map(*[F.lit(x) for kv in sentences.items() for x in kv])
    number = lambda j: F.aggregate(F.slice(before, F.lit(1), j + 1), j, lambda n, x: n + x)
    found = F.filter(parts, lambda _, i: i % 2 == 1)
    return F.transform(found, lambda s, j: F.struct(number(j).alias("at"), F.element_at(known, F.regexp_replace(s, f"[ {END}{LINE}{OTHER}]+", " ")).alias("id")))


def rule_met(ids: Column, sequence: list[str]) -> Column:
    """Whether the sequence stands in ``ids`` in its order, with few enough other sentences between."""
    ends = F.filter(ids, lambda x: x["id"] == sequence[0])
    follows = lambda name, before: lambda x: (x["id"] == name) & F.exists(before, lambda y: (y["at"] < x["at"]) & (x["at"] <= y["at"] + 1 + GAP))
    for name in sequence[1:]:
        ends = F.filter(ids, follows(name, ends))
    return F.size(ends) > 0


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """``(doc_id, n_license_sentences, sentence_ids, licenses)`` for every row: identifiers in order, and the licences
    whose rules they meet, in the rules' order; both as strings joined by blanks, empty if there are none."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    text = F.col("text")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    nothing = F.array().cast("array<struct<at:int,id:string>>")
    rows = rows.select("doc_id", F.when(text.rlike(WORDS), sentence_ids(text, sentences)).otherwise(nothing).alias("ids"))
    met = F.array_compact(F.array(*[F.when(rule_met(F.col("ids"), seq), F.lit(name)) for name, seq in rules]))
    found = F.when(F.size("ids") > 0, F.array_distinct(met)).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_license_sentences"), F.array_join(F.transform("ids", lambda x: x["id"]), " ").alias("sentence_ids"), F.array_join(found, " ").alias("licenses"))
