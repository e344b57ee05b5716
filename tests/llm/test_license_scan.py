import math
import re

import duckdb

from basketry.llm import license_scan as ls
from basketry.llm.oracles import ORACLES
from basketry.llm.queries import QUERIES
from tests.llm.fixtures import awkward, awkward_texts, empty, texts_only

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, templates, threshold):
    out = []
    for i, t, _ in rows:
        words = WORD.findall(lower(t))
        places, base = [], set()
        for phrase, label in ls.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k:k + len(p)] == p]
            places += at
            base |= {label} if at else set()
        labels, best = set(base), 0.0
        for line in lower(t).split("\n"):
            have = set(WORD.findall(line))
            for label, text in templates:
                need = set(WORD.findall(lower(text)))
                if len(have & need) >= math.ceil(threshold * len(need) - 1e-9):
                    labels.add(label)
                    best = max(best, len(have & need) / len(need))
        out.append((str(i), len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best))
    return sorted(out, key=str)


def got(df, *args):
    return sorted(((str(r["id"]), *tuple(r)[1:]) for r in ls.scan_licenses(df, "doc_id", "text", *args).collect()), key=str)


NOTICES = [
    (1, "Licensed under CC BY-NC 4.0.", "a"), (2, "x\nReleased under the MIT License.\ncc by cc by", "a"),
    (3, "GNU GENERAL PUBLIC LICENSE gnu general public licence", "a"), (4, "apache\nlicense", "a"), (5, "cc  by, CC-BY", "a"),
    (6, "This work is licensed under the GNU General Public License, version 3.", "a"),
    (7, "permission is hereby granted free of charge to any person obtaining a copy of software and associated files "
        "documentation", "a"), (8, "Redistribution and use in source and binary forms", "a"), (9, "mit licenseé", "a"),
]


def test_notices_equal_brute_force(spark):
    for threshold in (0.5, 0.8, 0.9, 1.0):
        assert got(texts_only(spark, NOTICES), ls.TEMPLATES, threshold) == brute(NOTICES, ls.TEMPLATES, threshold)


def test_awkward_documents_equal_brute_force(spark):
    templates = [("prose", "w1 w2 w3 w4 w5 w6 w7 w8"), ("pair", "one two"), ("none", "...")]
    for threshold in (0.3, 0.7):
        want = brute(awkward_texts(), templates[:2], threshold)
        assert got(awkward(spark), templates, threshold) == want


def test_no_templates_and_empty(spark):
    assert got(texts_only(spark, NOTICES), [], 0.9) == brute(NOTICES, [], 0.9)
    assert ls.scan_licenses(empty(spark)).count() == 0


def brute_runs(rows, templates, threshold):
    """(id, labels, score) by every run of consecutive words of every document, the closest of overlapping matches."""
    out = []
    for i, t, _ in rows:
        words = WORD.findall(lower(t))
        labels = set(filter(None, brute([(i, t, "")], [], threshold)[0][5].split(",")))
        matches = set()
        for label, text in templates:
            every = WORD.findall(lower(text))
            need, size = set(every), math.ceil(len(every) / threshold - 1e-9)
            for k in range(len(words)):
                run = words[k:k + size]
                common = need & set(run)
                if run[0] in need and len(common) >= math.ceil(threshold * len(need) - 1e-9):
                    end = max(run.index(w) for w in common)
                    if run[:end + 1].count(run[0]) == 1:
                        matches.add((len(common) / len(need), len(need), label, k, k + end))
        kept = [m for m in matches
                if not any(o[2] != m[2] and o[3] <= m[4] and o[4] >= m[3] and o[:2] > m[:2] for o in matches)]
        best = 1.0 if labels else max((m[0] for m in kept), default=0.0)
        out.append((str(i), ",".join(sorted(labels | {m[2] for m in kept})), best))
    return sorted(out)


def got_runs(df, templates, threshold):
    out = ls.scan_licenses(df, "doc_id", "text", templates, threshold, None)
    return sorted((str(r["id"]), r["labels"], r["score"]) for r in out.collect())


WRAPPED = [
    (1, "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated "
        "documentation files", "a"),
    (2, " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General "
        "Public License", "a"),
    (3, "Redistribution and use in source and binary forms, with or without\n\nmodification, are permitted provided that the "
        "following conditions are met", "a"),
    (4, "released " + "x " * 40 + "under the " + "y " * 40 + "MIT and a license", "a"),
    (5, "x " * 500 + "Released under the MIT\tLicense " + "y " * 500, "a"),
    (6, "the the license " * 30 + "this is free and\r\nunencumbered software\n\nreleased into the public\ndomain", "a"),
]


def test_wrapped_notices_and_long_lines(spark):
    labels = {i: label for i, label, _ in got_runs(texts_only(spark, WRAPPED), ls.TEMPLATES, 0.9)}
    assert labels == {"1": "mit", "2": "gpl", "3": "bsd", "4": "", "5": "mit", "6": "unlicense"}
    for threshold in (0.5, 0.8, 0.9, 1.0):
        for rows in (WRAPPED, NOTICES, [(k, t, "a") for k, (t, _) in enumerate(OWN_LABELS)]):
            assert got_runs(texts_only(spark, rows), ls.TEMPLATES, threshold) == brute_runs(rows, ls.TEMPLATES, threshold)


GPL, LESSER = "GNU General Public License", "GNU Lesser General Public License"
FREE = "is free software: you can redistribute it and/or modify it under the terms of the"

# notices of related licenses, and the labels that each is to get
OWN_LABELS = [
    (f"This work is licensed under the {GPL}, version 3.", "gpl,gpl-3.0"),
    (f"This work is licensed under the {GPL}, version 2.", "gpl,gpl-2.0"),
    ("Licensed under the GNU Affero General Public License, version 3", "agpl-3.0"),
    (f"This program {FREE}\n{GPL}", "gpl"), (f"This library {FREE}\n{LESSER}", "lgpl"),
    (f"This program {FREE}\nGNU Affero General Public License", "agpl"),
    *[(f"Licensed under CC BY{v} 4.0.", f"cc-by,cc-by{v.lower()}-4.0")
      for v in ("", "-NC", "-SA", "-ND", "-NC-SA", "-NC-ND")],
    ("Licensed under CC BY-NC 4.0. " + "x " * 30 + "Licensed under CC BY 4.0.", "cc-by,cc-by-4.0,cc-by-nc-4.0"),
    (f"This work is licensed under the {GPL}, version 3. This work is licensed under the {GPL}, version 2.",
     "gpl,gpl-2.0,gpl-3.0"),
    ("Licensed under the Apache License, Version 2.0; released under the MIT License", "apache,apache-2.0,mit"),
    (f"Licensed under CC BY 4.0. This program {FREE} {GPL}. Licensed under the Apache License, Version 2.0",
     "apache,apache-2.0,cc-by,cc-by-4.0,gpl"),
]


def test_each_notice_gets_its_own_label(spark, tmp_path):
    rows = [(k, t, "a") for k, (t, _) in enumerate(OWN_LABELS)] + NOTICES + WRAPPED
    rows = [(k, t, "a") for k, (_, t, _) in enumerate(rows)] + [(100, None, "a"), (101, "", None)]
    texts_only(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op8_license_scan"](spark, str(tmp_path)).collect()
    got = {r["doc_id"]: r["labels"] for r in out}
    assert [got[k] for k in range(len(OWN_LABELS))] == [labels for _, labels in OWN_LABELS]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        cur = con.execute(ORACLES["op8_license_scan"])
        names = [d[0] for d in cur.description]
        want = cur.fetchall()
    assert sorted((tuple(r[n] for n in names) for r in out)) == sorted(want)


def test_runs_of_awkward_documents_equal_brute_force(spark):
    templates = [("prose", "w1 w2 w3 w4 w5 w6 w7 w8"), ("pair", "one two"), ("again", "a b a c"), ("none", "...")]
    for threshold in (0.3, 0.7):
        want = brute_runs(awkward_texts(), templates[:3], threshold)
        assert got_runs(awkward(spark), templates, threshold) == want
    assert ls.scan_licenses(empty(spark), block_separator=None).count() == 0
    assert got_runs(texts_only(spark, NOTICES), [], 0.9) == brute_runs(NOTICES, [], 0.9)


def test_query_finds_wrapped_notices(spark, tmp_path):
    texts_only(spark, WRAPPED).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op8_license_scan"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == {1: "mit", 2: "gpl", 3: "bsd", 4: "", 5: "mit", 6: "unlicense"}
