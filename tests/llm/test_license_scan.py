from pyspark.sql import functions as F

from tidemark.llm.license_scan import _WORD, TEMPLATES, Model, _sampled, grams_of, scan

SF = "/root/testdata/sf0.001"


def test_families_of_whole_and_wrapped_templates(spark):
    rows = [(k, f"Some words first.\n{text}\nand more") for k, text in enumerate(t for texts in TEMPLATES.values() for t in texts)]
    want = [family for family, texts in TEMPLATES.items() for _ in texts]
    rows += [(900, "Licensed under the Quodlibet Public License 7."), (901, "x\n\nThis program is free software: you can redistribute it and/or\nmodify it under the terms of the GNU General Public\nLicense as published by the Free Software Foundation,\neither version 3 of the License, or (at your option)\nany later version.\n")]
    base = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    out = {r.doc_id: r for r in scan(base.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert (out[900].family, out[901].family) == ("unknown", "GPL-3.0")
    got = [out[k].family for k in range(len(want))]
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.9 * len(want), [x for x in zip(got, want, strict=True) if x[0] != x[1]]
    texts = {r.doc_id: r.text or "" for r in base.collect()}
    marked = {k for k, t in texts.items() if "icensed under" in t or "Released under the MIT" in t or "ll rights reserved" in t}
    assert {k for k in texts if out[k].confirmed} == marked


def test_scores_match_numpy(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (2, "the license of a dog is blue"), (3, "we released it under the terms")], "doc_id long, text string")
    model = Model(_sampled(docs, 600, 2000))
    for r in scan(docs).collect():
        text = {1: "released under the mit license", 2: "the license of a dog is blue", 3: "we released it under the terms"}[r.doc_id]
        words = _WORD.findall(text)
        if set(words) & set(model.gate):
            p = 1 / (1 + 2.718281828459045 ** -(model._matrix([words]) @ model.weights + model.bias))
            assert abs(r.probability - p.max()) < 1e-4
            assert r.n_scored == 1
    assert grams_of(["a", "b", "a"]) == ["a", "b", "a b", "b a"]


def test_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, " \n ", 1), (2, "Licensed under the MIT license.\n" * 3000, 1), (2, "licence " * 30000, 1)], "doc_id long, text string, family long")
    rows = scan(odd).collect()
    assert len(rows) == 5
    assert sorted(r.family for r in rows)[:2] == ["MIT", "none"]
    assert scan(odd.limit(0)).count() == 0


def test_hard_wrapped_notices_in_long_paragraphs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    rows, want = [], []
    for family, texts in TEMPLATES.items():
        for text in texts if family != "unknown" else []:
            words = text.split()
            wrapped = "\n".join(" # " + " ".join(words[k : k + 8]) for k in range(0, len(words), 8))
            filler = "\n".join(["some other plain words stand on this line"] * 30)
            rows += [(len(rows), f"Intro.\n\n{wrapped}\n\nand more"), (len(rows) + 1, f"{filler}\n{wrapped}\n{filler}")]
            want += [family, family]
    out = {r.doc_id: r for r in scan(base.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    wrong = [(k, w, out[k].family, out[k].probability) for k, w in enumerate(want) if w not in out[k].families.split(",")]
    assert len(wrong) <= 0.1 * len(want), wrong
