"""Licence scans by canonical digest lookup; DataFrame functions only.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent spellings,
white space) and its SHA-256 is joined to the digests of known licences brought to the same form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.llm import common as C

# Equivalent spellings, replaced wherever they stand in the lower-case text.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authoris": "authoriz",
    "centre": "center",
    "colour": "color",
    "customis": "customiz",
    "defence": "defense",
    "favour": "favor",
    "fulfill": "fulfil",
    "honour": "honor",
    "initialis": "initializ",
    "judgement": "judgment",
    "labour": "labor",
    "licence": "license",
    "modelled": "modeled",
    "non infringement": "noninfringement",
    "organis": "organiz",
    "recognis": "recogniz",
    "sub license": "sublicense",
    "whilst": "while",
    "willful": "wilful",
}

# Known notices and short licence texts.
KNOWN = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}

# Digests of the canonical forms of standard full texts, as distributed (several where titles,
# appendices or wordings differ).
STANDARD = {
    "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38": "Apache-2.0",
    "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6": "Apache-2.0",
    "7dc0ccfedfe9cf9e59c97a3e43eea7b035a0e7a7be84d714acef36eb5c9fb4bc": "Apache-2.0",
    "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0",
    "5151319f99abfc15f9a1aab05c799faf3b0e5715fac5a5812b9d3566ae984374": "BSD-2-Clause",
    "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2": "BSD-2-Clause",
    "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30": "BSD-2-Clause",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
    "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2": "BSD-3-Clause",
    "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15": "BSD-3-Clause",
    "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af": "BSD-3-Clause",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f": "GFDL-1.2",
    "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "553d221beaa29d442904386b2d1f1abbe1d8c53de83ad69d4b730cc6d38360b0": "GPL-3.0",
    "13db54df0465781e4f38f2a1d5bc17ae68060b438e0595b7f1c6a358ddea332f": "ISC",
    "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a": "ISC",
    "2b614fb2c18253fb7c1d5d24276593e12d81b854b5e79442a26885adc7ddc0c0": "ISC",
    "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db": "ISC",
    "63baaf2854baf0bb2e682f11a1853fb567b1e4cc0321733264b9b1cea90dc48d": "ISC",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c": "MIT",
    "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164": "MIT",
    "6a41eaf1f457898eeb77540647b08805101fefe3d7a3ab5e271645ae50bbc54c": "MIT",
    "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f": "MIT",
    "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127": "MIT",
    "c9e0b21ff70f6dd1855f8a502dd7a9f1911ad6fcf2dfadda0b0770fd5a43808c": "MIT",
    "306c97d6d414b6d81e284c065ce46bb98866841c27e12248e4f16e85936a1474": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
    "53113a39b79251016cf92b8348f303cee44e4faee1f232536754abc669dd32c8": "Unicode-3.0",
    "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd": "Unlicense",
    "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7": "Zlib",
}

#: A line that states a copyright: by a sign, a year, a placeholder or a reservation of rights, so that a
#: sentence wrapped before the word "copyright" keeps its line.
COPYRIGHT_LINE = (
    r"^[ \t#*/;%!-]*(?:copyright[ \t,:]*(?:\(c\)|©|&copy;|[12][0-9]{3}|[{\[<])|copyright[^\n]*(?:all rights reserved|<|contributors to)"
    r"|\(c\)[ \t]*(?:copyright|[12][0-9]{3})|©|all rights reserved[.]?[ \t\r]*$)[^\n]*$"
)
#: ASCII punctuation and white space.
GAPS = r"[\x09-\x0D -/:-@\[-`{-~]+"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines and ASCII punctuation, single spaces, one spelling."""
    out = F.regexp_replace(F.lower(text), "(?md)" + COPYRIGHT_LINE, " ")
    out = F.regexp_replace(out, GAPS, " ")
    for a, b in SPELLINGS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def scan_licenses(docs: DataFrame, known: DataFrame, text_col: str = "text", digests: DataFrame | None = None) -> DataFrame:
    """`docs` with digest (SHA-256 of the canonical text, null for a null text) and license (of the
    known text of the same digest, the least id if several; else null).

    `known` has license and text; rows with a null are left out, as are texts of an empty canonical form.
    `digests` has license and digest of further texts; rows with a null are left out. Several licences of
    one digest give the least. An empty text, or one of copyright lines and punctuation alone, has the
    digest of the empty text and no licence. Line breaks don't matter but for where a copyright line ends. Rows stay
    one to one, repeated ones too; columns named digest or license, in whatever case, are replaced, others
    kept. An empty table gives an empty one.
    """
    digest = lambda c: F.sha2(canonical(F.col(c)).cast("binary"), 256)
    table = known.where(F.col("license").isNotNull() & (canonical(F.col("text")) != ""))
    table = table.select("license", digest("text").alias("__gl_digest"))
    if digests is not None:
        more = digests.where(F.col("license").isNotNull() & F.col("digest").isNotNull())
        table = table.unionByName(more.select("license", F.col("digest").alias("__gl_digest")))
    table = table.groupBy("__gl_digest").agg(F.min("license").alias("license"))
    base = C.replace_columns(docs, ["digest", "license"]).withColumn("digest", digest(text_col))
    out = base.join(table, F.col("digest") == F.col("__gl_digest"), "left").drop("__gl_digest")
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN.items()), "license string, text string")


def standard_digests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STANDARD.items()), "digest string, license string")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`scan_licenses` of `documents` with the known texts and the standard digests."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs, known_licenses(spark), digests=standard_digests(spark)).select("doc_id", "digest", "license")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), '(?m){COPYRIGHT_LINE}', ' ', 'g')"
    out = f"regexp_replace({out}, '{GAPS}', ' ', 'g')"
    for a, b in SPELLINGS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({out})"


OP1_SQL = f"""
WITH known(license, text) AS (VALUES {", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in KNOWN.items())}),
standard(digest, license) AS (VALUES {", ".join(f"('{d}', '{n}')" for d, n in STANDARD.items())}),
digests AS (SELECT digest, min(license) AS license FROM
  (SELECT sha256({_canonical_sql("text")}) AS digest, license FROM known UNION ALL SELECT digest, license FROM standard) GROUP BY digest),
scanned AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
SELECT doc_id, digest, license FROM scanned LEFT JOIN digests USING (digest)
"""
