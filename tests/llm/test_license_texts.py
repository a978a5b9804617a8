"""Whole texts and notices of common licences are found."""

from pathlib import Path

from lattix.llm import license_texts, licenses


def test_common_licences(spark):
    folder = Path(license_texts.__file__).parent / "texts"
    rows = [(k, "Copyright (c) 2021 A. B.\n" + t) for k, t in [("GPL-3.0", (folder / "GPL-3.txt").read_text()), ("Apache-2.0", (folder / "Apache-2.0.txt").read_text()), ("MPL-2.0", (folder / "MPL-2.0.txt").read_text()), ("LGPL-2.1", (folder / "LGPL-2.1.txt").read_text()), ("BSD-3-Clause", "BSD 3-Clause License\n" + license_texts.BSD_START + license_texts.BSD_NAMES + license_texts.BSD_END), ("BSD-2-Clause", license_texts.BSD_START + license_texts.BSD_END), ("Unlicense", license_texts.UNLICENSE)]]
    docs = spark.createDataFrame([*rows, ("n", "x\nLicensed under CC BY-NC 4.0.\ny")], "doc_id string, text string")
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(docs).collect()}
    assert all(got[k][0] == k for k, _ in rows) and got["n"] == (None, "CC-BY-NC-4.0")


def test_each_text_has_one_identifier(spark):
    first = {}
    found = licenses.with_digests(spark.createDataFrame(licenses.KNOWN, "license string, text string")).select("license", "digest").collect()
    for r in found:
        assert r.digest and first.setdefault(r.digest, r.license) == r.license
