"""License scans against a plain Python version and against SQL."""

import math
import re

import duckdb

from tonemill.llm import licenses as li

TEXTS = [
    None, "", "  ,. ", "Released under the MIT License.", "under the mit license under the mit license", "thunder the mit license", "under the mit licensed", "under the mité license",
    "APACHE license, Version 2.0\nsome text\nLicensed under the Apache License version 2", "cc by nc cc by nc", "cc-by--nc!", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License", "work licensed under GNU General Public License version 3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
    "Permission is granted free of charge to any person obtaining copy of this software and its documentation files", "x " * 60_000 + "\nreleased the mit license",
    "Redistribution and use\nin source and binary forms, with or without modification, are permitted", "x " * 300 + "released under\nthe " + "mit license " * 300, "y " * 250 + "Redistribution and use in source and binary forms, with or without\n * modification, are permitted",
    "été Ünder the MIT license \x85 under the mit\tlicense", "released under mit",
]


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def brute(text, templates=li.TEMPLATES, threshold=li.THRESHOLD):
    w = words(text or "")
    places = [(i, label) for p, label in li.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    base, best, more = {label for _, label in places}, 0.0, set()
    for label, body, telling, barred in (li.Template(*t) for t in templates):
        t, span = set(body.split()), len(body.split()) * 3 // 2
        for i in range(len(w)):
            held = set(w[i:i + span])
            if w[i] in t and held.issuperset(telling.split()) and not held & set(barred.split()) and len(t & held) >= math.ceil(threshold * len(t) - 1e-9):
                more.add(label)
                best = max(best, len(t & held) / len(t))
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if at else best)


def test_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, TEXTS[12], "x"), (4, "other text of one key", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, LABELS string")
    for templates, threshold in ((li.TEMPLATES, 0.8), (li.TEMPLATES, 0.5), (li.TEMPLATES[:3], 1.0)):
        got = [tuple(r) for r in li.scan(df, templates=templates, threshold=threshold).collect()]
        want = [(i, *brute(t, templates, threshold)) for i, t, _ in rows]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert li.scan(df.limit(0)).count() == 0


def test_real_notices(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version {} of the License"
    want = {
        "Released under the BSD License.": "bsd", "Licensed under CC BY 4.0": "", "CC BY-SA 4.0": "", "Licensed under CC BY-SA 4.0": "",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that": "bsd",
        "// Unless required by applicable law or agreed to in writing, software\n// distributed under the License is distributed on an \"AS IS\" BASIS,": "apache-2",
        "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files": "mit",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation": "",
        gpl.format("", 2): "gpl-2", gpl.format("", 3): "gpl-3", gpl.format("Lesser ", 3): "", gpl.format("Affero ", 3): "",
        (" filler" * 200).join(f" {w}" for w in li.TEMPLATES[8].body.split()): "",
    }
    rows = list(enumerate(want))
    got = {r.doc_id: r.labels for r in li.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {text: got[i] for i, text in rows} == want


def test_filters_lose_nothing(spark):
    import random

    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(14)]
    templates = []
    for k in range(6):
        body = rng.sample(vocab, rng.randint(2, 8))
        templates.append((f"t{k}", " ".join(body), rng.choice(body) if k % 2 else "", rng.choice(vocab) if k % 3 == 2 else ""))
    texts = ["\n".join(" ".join(rng.choice([*vocab, "zz"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.5, 0.75, 1.0):
        got = sorted(tuple(r) for r in li.scan(df, templates=templates, threshold=threshold).select("doc_id", "labels").collect())
        assert got == [(i, brute(t, templates, threshold)[5]) for i, t in enumerate(texts)]


def test_no_python_in_the_plan(spark):
    df = li.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


def test_query_matches_sql(spark):
    from tonemill.llm.queries import LLM_ORACLE, LLM_QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(LLM_ORACLE["op6_licenses"])
    names = [c[0] for c in want.description]
    out = LLM_QUERIES["op6_licenses"](spark, sf)
    assert out.columns == names
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(want.fetchall())
    assert {"apache-2", "cc-by-nc", "gpl-3", "mit"} <= {g[6] for g in got}
