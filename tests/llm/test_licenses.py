import re

from pyspark.sql import functions as F

from girder.llm import licenses
from tests.llm.helpers import awkward, table

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."
CASES = {
    "Some text.\nReleased under the MIT License.\nMore.": (["mit-notice"], ["MIT"]),
    f"Released under the MIT License.\n{MIT} The software is provided \"as is\", without warranty of any kind.": (["mit-notice", "mit-grant", "as-is"], ["MIT"]),
    "Licensed under CC BY-NC 4.0. All rights reserved.": (["cc-by-nc-4.0-notice", "reserved"], ["CC-BY-NC-4.0", "Proprietary"]),
    "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0": (["apache-2.0-notice"], ["Apache-2.0"]),
    "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.": (["gpl-3-notice", "apache-2.0-notice"], ["GPL-3.0", "Apache-2.0"]),
    "the software is provided as is without warranty of any kind": (["as-is"], []),
    "My driving license is here": ([], []),
    "Released under the MIT Licensed": ([], []),
}


def test_known_sentences_hold_a_cue():
    assert all(re.search(licenses.CUES, s) for s in licenses.SENTENCES)
    known = set(licenses.SENTENCES.values())
    assert all(set(seq) <= known for _, seq in licenses.RULES)


def test_cases(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(CASES)]
    got = {r["doc_id"]: (r["identifiers"], r["licenses"], r["n_sentences"]) for r in licenses.scan_licenses(table(spark, rows)).collect()}
    for k, want in enumerate(CASES.values()):
        assert got[k] == (*want, len(want[0])), k


def test_awkward_rows(spark):
    rows = awkward() + [(90, "x. " * 5000 + "Released under the MIT License.", "en", "s")]
    got = licenses.scan_licenses(table(spark, rows))
    assert got.count() == len(rows)
    assert [r["doc_id"] for r in got.where(F.size("licenses") > 0).collect()] == [90]
    assert licenses.scan_licenses(table(spark, [])).collect() == []


MIT_TEXT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
"""
BSD_HEAD = """Copyright (c) 2020, Some One
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE.
"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance
   with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """This program is free software{a} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{b} either version {v} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


def test_whole_wrapped_texts(spark):
    gpl3 = GPL.format(a=":", b=",", v=3)
    cases = [
        (MIT_TEXT, ["mit-grant", "as-is"], ["MIT"], 2),
        (BSD_HEAD + BSD_THIRD + BSD_TAIL, ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorsement", "bsd-as-is"], ["BSD-3-Clause"], 1),
        (BSD_HEAD + BSD_TAIL, ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"], ["BSD-2-Clause"], 1),
        (APACHE, ["apache-2.0-notice", "apache-compliance", "apache-copy"], ["Apache-2.0"], 0),
        (gpl3, ["gpl-3-or-later", "gpl-warranty"], ["GPL-3.0-or-later"], 0),
        ("/*\n" + "".join(f" * {line}\r\n" for line in gpl3.split("\n")) + " */\n", ["gpl-3-or-later", "gpl-warranty"], ["GPL-3.0-or-later"], 0),
        (GPL.format(a=";", b=";", v=2), ["gpl-grant", "gpl-2-or-later", "gpl-warranty"], ["GPL-2.0-or-later"], 1),
        (GPL.format(a=":", b=";", v=2), ["gpl-grant", "gpl-2-or-later", "gpl-warranty"], ["GPL-2.0-or-later"], 0),
        ("All rights\nreserved", ["reserved"], ["Proprietary"], 0),
        ("All rights\n\nreserved, warranty", [], [], -1),
        ("Over all rights\nreserved. warranty", [], [], -1),
    ]
    rows = [(k, c[0], "en", "s") for k, c in enumerate(cases)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(table(spark, rows)).collect()}
    for k, (_, ids, names, first) in enumerate(cases):
        assert (got[k]["identifiers"], got[k]["licenses"], got[k]["first_sentence"]) == (ids, names, first), (k, got[k])


def test_the_sql_finds_the_same_rows(spark, small):
    import duckdb

    from girder.llm import queries

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    want = sorted(c.execute(queries.SQL["op9_license_scan"]).fetchall())
    assert sorted(tuple(r) for r in queries.op9_license_scan(spark, small).collect()) == want
