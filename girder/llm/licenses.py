"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into parts at line ends and at marks followed by white space, and each part is normalised (lower case, runs
of other characters than letters and digits to one space). A part, or several that are one wrapped sentence (no mark and no
blank line between them), is mapped to a known licence-sentence identifier where it equals one; the longest sentence counts. A document's identifiers in order are then held against ordered licence rules; a rule is a
sequence of identifiers that must follow each other among the recognised sentences, the first rule that matches at a
place wins and its sentences are used up.

Plan: a text without any of the cue words (each known sentence has one) is not cut at all; the tables of sentences
and rules are literals of the plan, so nothing is shuffled or joined.

Defined cases: a null text has no sentence; rows without an id and repeated rows are scanned each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind": "as-is",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "licensed under the apache license version 2 0 the license": "apache-2.0-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this work is licensed under the gnu general public license version 2": "gpl-2-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3": "gpl-3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2": "gpl-2-notice",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-or-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-or-later",
    "either version 3 of the license or at your option any later version": "gpl-3-or-later",
    "either version 2 of the license or at your option any later version": "gpl-2-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "licensed under cc by 4 0": "cc-by-4.0-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0-notice",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-4.0-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorsement",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "spdx license identifier mit": "mit-notice",
    "spdx license identifier apache 2 0": "apache-2.0-notice",
    "spdx license identifier gpl 3 0 only": "gpl-3-notice",
    "spdx license identifier gpl 3 0 or later": "gpl-3-or-later",
    "spdx license identifier bsd 3 clause": "bsd-grant",
    "all rights reserved": "reserved",
}
#: Ordered rules: longer sequences stand before those they start with.
RULES = (
    ("MIT", ("mit-notice", "mit-grant", "as-is")),
    ("MIT", ("mit-grant", "as-is")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("Apache-2.0", ("apache-2.0-notice", "apache-compliance", "apache-copy")),
    ("Apache-2.0", ("apache-2.0-notice", "apache-compliance")),
    ("Apache-2.0", ("apache-2.0-notice",)),
    ("GPL-3.0-or-later", ("gpl-grant", "gpl-3-or-later", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-grant", "gpl-3-or-later")),
    ("GPL-3.0-or-later", ("gpl-3-or-later", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-3-or-later",)),
    ("GPL-2.0-or-later", ("gpl-grant", "gpl-2-or-later", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl-grant", "gpl-2-or-later")),
    ("GPL-2.0-or-later", ("gpl-2-or-later", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl-2-or-later",)),
    ("GPL-3.0", ("gpl-3-notice",)),
    ("GPL-2.0", ("gpl-2-notice",)),
    ("CC-BY-4.0", ("cc-by-4.0-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4.0-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorsement", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorsement")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "as-is")),
    ("BSD-3-Clause", ("bsd-grant",)),
    ("Proprietary", ("reserved",)),
)
#: Each known sentence holds one of these.
CUES = r"(?i)licen[cs]e|warrant(?:y|ies)|permission[\W_]+is[\W_]+hereby|redistribut|rights[\W_]+reserved|prior[\W_]+written[\W_]+permission"
#: Sentence ends. A mark inside a number (2.0) is followed by no white space and ends nothing.
ENDS = r"[\r\n]+|(?<=[.!?;])[\x20\t]+"


#: After a part: a line end inside a sentence, or the end of a sentence. BLANK marks lines that stand before a blank one.
SOFT, HARD, BLANK = "\x01", "\x02", "\ue000"


def parts(text: Column) -> Column:
    """The normalised parts of a text, in order, without empty ones, each followed by SOFT or HARD, as one string."""
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[^\p{L}\p{N}\n]+(?=\n)", "\n")
    cut = F.split(F.regexp_replace(text, r"\n{2,}", f"{BLANK}\n"), ENDS, -1)
    clean = F.transform(cut, lambda p: F.struct(F.btrim(F.regexp_replace(F.lower(p), r"[^\p{L}\p{N}]+", " ")).alias("s"), p.rlike(rf"[.!?;{BLANK}][^\p{{L}}\p{{N}}]*$").alias("hard")))
    kept = F.filter(clean, lambda p: p["s"] != "")
    return F.array_join(F.transform(kept, lambda p: F.concat(p["s"], F.when(p["hard"], HARD).otherwise(SOFT))), "")


def identifiers(found: Column) -> Column:
    """(pos, id) of each known sentence; pos is the number of parts before the first of them."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    any_of = "|".join(s.replace(" ", f"[ {SOFT}]") for s in sorted(SENTENCES, key=len, reverse=True))
    pattern = f"(?<![^{SOFT}{HARD}])(?:{any_of})[{SOFT}{HARD}]"
    ids = F.transform(F.regexp_extract_all(found, F.lit(pattern), F.lit(0)), lambda t: F.element_at(known, F.btrim(F.translate(t, SOFT + HARD, "  "))))
    before = F.get(F.split(found, pattern, 2), F.lit(0))
    first = F.length(before) - F.length(F.translate(before, SOFT + HARD, ""))
    return F.transform(ids, lambda i: F.struct(first.alias("pos"), i.alias("id")))


def match_rules(ids: Column) -> Column:
    """The licences of the rules that match the identifier sequence, from left to right."""
    line = F.concat(F.lit(" "), F.array_join(F.transform(ids, lambda t: t["id"]), "  "), F.lit(" "))
    tokens = F.regexp_extract_all(line, F.lit("|".join(" " + "  ".join(seq).replace(".", r"\.") + " " for _, seq in RULES)), F.lit(0))
    names = F.create_map(*[F.lit(x) for name, seq in reversed(RULES) for x in (" " + "  ".join(seq) + " ", name)])
    return F.transform(tokens, lambda t: F.element_at(names, t))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences matched, identifiers in order, licences in order, first sentence's position or -1) of each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<pos:int,id:string>>")
    rows = docs.select(F.col(id_col), F.when(text.rlike(CUES), identifiers(parts(text))).otherwise(none).alias("ids"))
    first = F.coalesce(F.get("ids", F.lit(0))["pos"], F.lit(-1))
    return rows.select(id_col, F.size("ids").cast("long").alias("n_sentences"), F.transform("ids", lambda t: t["id"]).alias("identifiers"), match_rules(F.col("ids")).alias("licenses"), first.cast("long").alias("first_sentence"))
