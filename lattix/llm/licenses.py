"""License scans: canonical forms of whole texts, looked up among the digests of known licence texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.llm.license_texts import TEXTS
from lattix.llm.shared import stash

# Short notices and texts of public licences, by identifier.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = [
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("0BSD", ZERO_BSD),
    ("Apache-2.0", APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    *TEXTS,
]
# Spellings that licences use for one another, as (whole word, word it stands for).
EQUIVALENT = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("per cent", "percent"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("acknowledgement", "acknowledgment"), ("authorised", "authorized"), ("copyright owner", "copyright holder"), ("https", "http")]
#: A line that only states a copyright: dropped.
COPYRIGHT_LINE = r"^[\x20\x09-\x0D*#/;-]*(copyright|\(c\)|©|copr\.)[\x20\x09-\x0D]+(\(c\)|©|[0-9]{4}|by[\x20\x09-\x0D]).*$|^[\x20\x09-\x0D]*all rights reserved\.?[\x20\x09-\x0D]*$"


def lowered(text: Column) -> Column:
    """A-Z in lower case; letters outside of ASCII are kept as they are, so that every engine agrees."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical(low: Column) -> Column:
    """Lower-case text without punctuation, spellings unified, words parted by one blank.

    Words have blanks of their own on both sides while spellings are replaced, so that one that follows itself, or
    shares a blank with the next, is replaced each time.
    """
    text = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(low, PUNCTUATION, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in EQUIVALENT:
        text = F.replace(text, F.lit(spaced(old)), F.lit(spaced(new)))
    return F.replace(F.trim(text), F.lit("  "), F.lit(" "))


def spaced(words: str) -> str:
    return f" {'  '.join(words.replace('-', ' ').split())} "


#: What parts words: white space and ASCII punctuation, typographic quotes and dashes.
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F ‐-―‘-‟•…]+"


def with_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``digest`` (SHA-256 of the whole canonical text; null where it is empty) and ``line_digests`` of its lines.

    Lines that only state a copyright are dropped first. The whole is made of the others joined, so it is the same
    wherever its lines are broken, within a hyphenated word or a spelling of two words as well; the lines are made
    canonical one by one besides.
    """
    # A second expression on a computed value would compute it again: one row is made for each text first.
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lowered), lambda x: ~x.rlike(COPYRIGHT_LINE))
    split = docs.withColumn("__lines", F.explode(F.array(lines)))
    whole = split.withColumn("__whole", F.explode(F.array(canonical(F.array_join("__lines", "\n")))))
    single = F.filter(F.transform("__lines", canonical), lambda x: x != "")
    return whole.withColumns({"digest": F.when(F.col("__whole") != "", F.sha2("__whole", 256)), "line_digests": F.transform(single, lambda x: F.sha2(x, 256))}).drop("__lines", "__whole")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``(k_digest, license)`` of known texts, canonicalised like any other; the first identifier wins among equals."""
    table = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(known)], "n int, license string, text string")
    return with_digests(table).where("digest is not null").groupBy(F.col("digest").alias("k_digest")).agg(F.min_by("license", "n").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(doc_id, digest, license, notices)`` for every row of ``docs``.

    ``license``: of the known text whose canonical form equals the document's whole; null if none. ``notices``: the
    licences whose known text is a whole line, sorted, comma-joined, each once; null if none. Null, empty and
    punctuation-only texts have no digest and match nothing. Repeated rows return repeated rows. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = stash(known if known is not None else known_digests(spark), "known")
    found = stash(with_digests(docs.select("doc_id", "text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest", "line_digests"), "digests")
    lines = found.select("row", F.explode("line_digests").alias("line")).join(known, F.col("line") == F.col("k_digest"))
    notices = lines.groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    whole = found.drop("line_digests").join(known, F.col("digest") == F.col("k_digest"), "left")
    return whole.join(notices, "row", "left").select("doc_id", "digest", "license", "notices")
