import re

from bazaar.llm import licenses
from bazaar.llm.licenses import BASE, GRANT, NAME, RULES, TAG, TEXT, scan

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to use, copy, modify, merge, publish, distribute, sublicense it"


def brute_force(text):
    """Every rule at every place, no keywords; then every pair of intervals of a text."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    t = "".join(f" {w} " for w in words)
    found = [(t[: m.start()].count(" ") // 2, t[: m.end()].count(" ") // 2, level, i, label, base) for i, (label, level, _, x, base) in enumerate(RULES) for m in re.finditer(x, t)]
    holds = lambda g, f: g[2] <= f[2] and g[0] <= f[0] and g[1] >= f[1] and ((g[0], g[1]) != (f[0], f[1]) or g[2:4] < f[2:4])
    return len(words), sorted((f[0], f[1], f[3], not any(holds(g, f) for g in found)) for f in found)


def check(docs):
    got = {r["doc_id"]: (r["n_words"], sorted((d["first"], d["end"], d["rule"], d["kept"]) for d in r["found"])) for r in scan(docs).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == brute_force(r["text"]), r["text"]


def labels(spark, text):
    rows = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    return {d["label"] for d in rows[0]["found"] if d["kept"]}


def test_rules_are_gated_by_words_that_every_find_has():
    assert len(RULES) > 200 and all(gate for _, _, gate, _, _ in RULES)
    assert all(f" {k} " in x for _, _, gate, x, _ in RULES for k in gate)
    assert {level for _, level, *_ in RULES} == {TEXT, TAG, GRANT, NAME} and sum(r[4] for r in RULES) == len(BASE)


def test_stronger_and_wider_signatures_win(spark):
    assert labels(spark, "Licensed under the Apache License, Version 2.0.") == {"apache-2.0"}
    assert labels(spark, "This work is licensed under the GNU General Public License, version 3.") == {"gpl-3.0"}
    assert labels(spark, "Licensed under CC BY-NC 4.0.") == {"cc-by-nc-4.0"}
    assert labels(spark, "Released under the MIT License.") == {"mit"}
    assert labels(spark, "// SPDX-License-Identifier: BSD-3-Clause") == {"bsd-3-clause"}
    assert labels(spark, "# SPDX-License-Identifier: MPL-2.0") == {"mpl-2.0"}
    assert labels(spark, MIT) == {"mit"}
    assert labels(spark, "MIT License and, for the docs, CC-BY-SA 4.0; see https://www.gnu.org/licenses/gpl-3.0.html") == {"mit", "cc-by-sa-4.0", "gpl-3.0"}
    assert labels(spark, "das Haus mit Garten, a common open apache") == set() and labels(spark, "permit licenses") == set()


def test_like_brute_force(make, odd):
    both = " ".join(f"{t} mit license {t}" for t in ("Licensed under the Apache License Version 2.0", "gnu general public license v2", "GPL-3.0", MIT)) * 40
    check(make([(1, None), (2, ""), (3, "  "), (4, "MIT LICENSE"), (5, "mit-license/mit_license"), (6, both), (7, "é mit license É"), (8, "x" * 5000 + " Apache License"), (9, "--- mit license ---"), (10, "mit  licence, MIT license\nMIT\nLicense")]))
    rows = scan(odd).collect()
    assert len(rows) == odd.count() and all(r["n_words"] is not None and r["found"] is not None for r in rows)


def test_on_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dropDuplicates(["doc_id"]))


def test_base_places(spark, tmp_path):
    rows = [(1, "MIT license, mit LICENSE and the General Public License"), (2, None), (3, "Apache License 2.0")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in licenses.op12_licenses(spark, str(tmp_path)).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (9, 3, 0, 6, "gpl,mit")
    assert (got[2]["n_words"], got[2]["n_base"], got[2]["first_word"], got[2]["base_labels"], got[2]["labels"], got[2]["score"]) == (0, 0, None, "", "", 0.0)
    assert got[3]["base_labels"] == "apache" and got[3]["labels"] == "apache,apache-2.0"


def test_no_python_in_the_plan(spark):
    plan = licenses.op12_licenses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_empty_table(make):
    assert scan(make([])).collect() == []
