"""License scan by digests of canonical texts.

A text is brought to a canonical form (copyright lines dropped, lower case,
punctuation to blanks, equivalent spellings to one, runs of blanks to one) and
its SHA-256 is looked up by a hash join among the digests of known licences.
The same lookup is done for each line, as corpora often quote a notice rather
than the whole licence.

Nulls and special cases: null text is empty; an empty canonical form matches
nothing, known or not; a null id stays null; repeated rows get equal results;
of known licences with one canonical form the smallest name is given; empty
tables give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerweave.llm._store import Stored

#: Spellings that licence guidelines hold equivalent, in canonical form on the right.
SPELLINGS = (
    ("licenc", "licens"),
    ("isation", "ization"),
    ("ganise", "ganize"),
    ("thorise", "thorize"),
    ("cognise", "cognize"),
    ("haviour", "havior"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("labour", "labor"),
    ("dgement", "dgment"),
    ("alogue", "alog"),
    ("fulfil ", "fulfill "),
    ("wilful", "willful"),
    ("whilst", "while"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("sub licens", "sublicens"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that begins with a notice: "copyright" counts where a mark, a year, "by" or a capitalised name follows, "(c)" where a year does.
COPYRIGHT_LINE = (
    r"(^|\n)[^A-Za-z0-9\n]*((?i:copyright)[^A-Za-z0-9\n]*(©|(?i:c\))|[0-9]{4}|(?i:by |yyyy|year)|[A-Z][a-z]+ [A-Z])|[Cc]\)[^A-Za-z0-9\n]*[0-9]{4}|©|(?i:all rights reserved))[^\n]*"
)
NOT_WORD = r"[^\p{L}\p{N}\n]+"
BLANKS = r"[ \n]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Licence texts and short notices; a production run passes its own table.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", _BSD2 + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD2 + _BSD_END),
    ("BSD-3-Clause", _BSD2 + _BSD_NAMES + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD2 + _BSD_NAMES + _BSD_END),
)
#: SHA-256 of the canonical forms of longer licences, whole, and up to the end of their terms.
DIGESTS = (
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
)


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line breaks kept."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, "$1")
    x = F.translate(x, UPPER, LOWER)
    x = F.regexp_replace(x, NOT_WORD, " ")
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def filled_lines(text: Column) -> Column:
    """Lines of the canonical form that aren't empty, given canonical_lines; joined by blanks they are the whole."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def digest(form: Column) -> Column:
    return F.when(form != "", F.unhex(F.sha2(form, 256)))


def known_table(spark: SparkSession) -> DataFrame:
    """The built-in licences: license_id with a text or, where that is null, canonical_sha256."""
    return spark.createDataFrame([(n, t, None) for n, t in KNOWN] + [(n, None, d) for n, d in DIGESTS], "license_id string, text string, canonical_sha256 string")


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, canonical_sha256, license_id (of the whole text) and line_licenses (sorted names of those whose text a line is)."""

    def digests(df: DataFrame, text: str, *keep: Column) -> DataFrame:
        # step by step, so that no form is computed twice
        form = df.select(*keep, canonical_lines(F.col(text)).alias("_form"))
        form = form.select("*", filled_lines(F.col("_form")).alias("_lines")).drop("_form")
        form = form.select("*", F.array_join("_lines", " ").alias("_whole"))
        return form.select("*", digest(F.col("_whole")).alias("_all"), F.transform("_lines", lambda x: F.unhex(F.sha2(x, 256))).alias("_each")).drop("_whole", "_lines")

    names = digests(known, "text", F.col("license_id")).select("license_id", "_all")
    if "canonical_sha256" in known.columns:
        names = names.unionAll(known.select("license_id", F.unhex("canonical_sha256")))
    names = names.where("_all is not null").groupBy(F.col("_all").alias("d")).agg(F.min("license_id").alias("name"))
    form = Stored(digests(docs, text_col, F.col(id_col).alias("_id")), "canonical").df  # 32 bytes a line
    quoted = form.select("_id", "_all", F.explode("_each").alias("d")).join(names, "d").groupBy("_id", "_all").agg(F.sort_array(F.collect_set("name")).alias("line_licenses"))
    out = form.select("_id", "_all").join(names.withColumnRenamed("d", "_all"), "_all", "left")
    quoted = quoted.select(F.col("_id").alias("_q"), F.col("_all").alias("_qa"), "line_licenses")
    out = out.join(quoted, out["_id"].eqNullSafe(quoted["_q"]) & (out["_all"] == quoted["_qa"]), "left")
    return out.select(F.col("_id").alias(id_col), F.lower(F.hex("_all")).alias("canonical_sha256"), F.col("name").alias("license_id"), F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))


def _sql_form(column: str) -> str:
    x = rf"regexp_replace(coalesce({column}, ''), '{COPYRIGHT_LINE}', '\1', 'g')"
    x = f"translate({x}, '{UPPER}', '{LOWER}')"
    x = f"regexp_replace({x}, '{NOT_WORD}', ' ', 'g')"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


SQL = rf"""
with known(license_id, t) as (values {", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in KNOWN)}),
digest_of(license_id, d) as (values {", ".join(f"('{n}', '{d}')" for n, d in DIGESTS)}),
names as (
  select d, min(license_id) as name from (
    select sha256(trim(regexp_replace({_sql_form("t")}, '{BLANKS}', ' ', 'g'))) as d, license_id from known union all select d, license_id from digest_of
  ) group by 1
), form as (
  select doc_id, {_sql_form("text")} as f from documents
), digests as (
  select doc_id, f, trim(regexp_replace(f, '{BLANKS}', ' ', 'g')) as w, case when w <> '' then sha256(w) end as d from form
), lines as (
  select doc_id, d, trim(unnest(str_split(f, chr(10)))) as l from digests
), quoted as (
  select distinct lines.doc_id, lines.d, name from lines join names on names.d = sha256(l) where l <> ''
), lists as (
  select doc_id, d, list(name order by name) as ls from quoted group by 1, 2
)
select digests.doc_id, digests.d as canonical_sha256, names.name as license_id, coalesce(ls, []) as line_licenses
from digests left join names on names.d = digests.d
left join lists on lists.doc_id is not distinct from digests.doc_id and lists.d = digests.d
"""
