"""Licence texts in many wrappings, and odd input."""

import hashlib
import os
import re
import textwrap

import pytest

from gatelight.llm import licenses

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""

BSD2 = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
FOLDER = "/usr/share/common-licenses"


def test_license_forms(spark):
    mit = licenses.KNOWN["MIT"]
    texts = [mit, "Copyright (c) 2020 Some One\n" + mit.upper().replace("LICENSE", "LICENCE") + "  ", "# " + mit, "see: " + mit, None, ""]
    rows = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), 'doc_id long, text string'), licenses.known_licenses(spark)).collect()}
    assert [rows[i].license for i in range(6)] == ["MIT", "MIT", "MIT", None, None, None]
    assert rows[4].digest is None and rows[5].digest == hashlib.sha256(b"").hexdigest()


def known_texts():
    out = {"MIT": MIT_TEXT, "BSD-2-Clause": BSD2, "ISC": "Copyright 2020 Some One\n\n" + licenses.KNOWN["ISC"]}
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-1.0", "GPL-1"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD-3-Clause", "BSD")):
        if os.path.exists(f"{FOLDER}/{file}"):
            out[name] = open(f"{FOLDER}/{file}", encoding="utf8").read()
    return out


def wrap(text, width):
    """Paragraphs filled anew; lines that state a copyright stay as they are."""
    out, rest = [], []

    def flush():
        out.extend(textwrap.wrap(" ".join(rest), width, break_long_words=False, break_on_hyphens=False))
        rest.clear()

    for line in text.split("\n"):
        if not line.strip() or re.match(r"(?i)\W*(copyright.*(\(c\)|[12][09]\d\d|\[|<)|all rights reserved)", line):
            flush()
            out.append(line)
        else:
            rest.append(line.strip())
    flush()
    return "\n".join(out)


@pytest.mark.parametrize("width", [40, 61, 72, 79, 100, 10_000])
def test_wrapping_does_not_matter(spark, width):
    texts = known_texts()
    rows = [(n, wrap(t, width)) for n, t in texts.items()]
    # forms of our own: each text's digest, as it is, must be its digest in any wrapping
    docs = spark.createDataFrame(rows + [(n, t) for n, t in texts.items()], "name string, text string")
    found = {}
    for r in licenses.scan_licenses(docs, licenses.known_licenses(spark), digests=licenses.standard_digests(spark)).collect():
        found.setdefault(r.name, []).append(r.license)
    assert found == {n: [n, n] for n in texts}


def test_odd_input(spark):
    known = spark.createDataFrame([("B", "some text"), ("A", "Some Text!"), (None, "x"), ("E", ""), ("E", "  ..."), ("N", None)], "license string, text string")
    more = spark.createDataFrame([(None, "aa"), ("Z", None), ("Q", hashlib.sha256(b"other").hexdigest())], "license string, digest string")
    long = "word " * 200_000
    texts = ["some\ntext", "SOME   text", None, "", "...", "Copyright (c) 2020 X", "other", long, "some text", "copyright notice", "© 2020 me\nsome text\r\n", "<!-- some text -->"]
    docs = spark.createDataFrame([(i, t, "d", "L") for i, t in enumerate(texts)], "doc_id long, text string, DIGEST string, License string").repartition(3)
    out = licenses.scan_licenses(docs, known, digests=more)
    got = {r.doc_id: r for r in out.collect()}
    assert sorted(out.columns) == ["digest", "doc_id", "license", "text"] and len(got) == len(texts)
    assert [got[i].license for i in range(len(texts))] == ["A", "A", None, None, None, None, "Q", None, "A", None, "A", "A"]
    empty = hashlib.sha256(b"").hexdigest()
    assert [got[i].digest for i in (2, 3, 4, 5)] == [None, empty, empty, empty]
    assert got[9].digest == hashlib.sha256(b"copyright notice").hexdigest()
    assert licenses.scan_licenses(docs.limit(0), known).count() == 0 and licenses.scan_licenses(docs, known.limit(0)).where("license is not null").count() == 0


def test_sql_finds_the_same_licences(spark, tmp_path):
    import duckdb

    texts = [*known_texts().values(), MIT_TEXT.replace("\n", "\r\n"), "Released under the MIT License.", "x", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(licenses.OP1_SQL).fetchall()}
    got = {r.doc_id: (r.digest, r.license) for r in licenses.op1_license_scan(spark, str(tmp_path)).collect()}
    assert got == want and sum(v[1] is not None for v in got.values()) >= 5
