import re

from geowarden.llm.licenses import BASE, COVER, GRAM, NEAR, NOTICES, STRETCH, scan_licenses

SF = "/root/testdata/sf0.01"


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    ws = split(text)
    places = [(i, label) for p, label in BASE for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    found, cover, at = set(), 0.0, {}
    for p in range(len(ws) - GRAM + 1):
        at.setdefault(tuple(ws[p : p + GRAM]), []).append(p)
    for label, notice in NOTICES:
        t = notice.split()
        votes = sorted((p - a, p, a) for a in range(len(t) - GRAM + 1) for p in at.get(tuple(t[a : a + GRAM]), ()))
        runs = []
        for v in votes:
            if not runs or v[0] - runs[-1][-1][0] > NEAR:
                runs.append([])
            runs[-1].append(v)
        for r in runs:
            c = len({a for _, _, a in r}) / (len(t) - GRAM + 1)
            reach = max(p for _, p, _ in r) + GRAM - min(p for _, p, _ in r)
            if c >= COVER and reach <= STRETCH * len(t):
                found.add(label)
                cover = max(cover, c)
    starts, base = [i for i, _ in places], {x for _, x in places}
    return len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else cover


def test_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in scan_licenses(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}
    assert any("cc-by-nc" in x[5] for x in got.values())


def test_notices_with_changes_and_defined_cases(spark):
    texts = [
        None, "", "MIT License", "mit-license, Apache\nLicense CC BY cc by", "gnu general public licence", "GNU General Public License GNU general public license",
        "Permission is hereby granted, free of charge, to all and any person obtaining a copy of", "Permission is hereby granted. " * 3,
        "Redistribution and use in source & binary forms, with or without modification,", "été LICENSE Kmit license", "x " * 5000 + "released under the mit license",
        *["intro " * 3 + " ".join(w for j, w in enumerate(t.split()) if j % 17 != 5) + " more" for _, t in NOTICES], *[t.replace("software", "programme").replace("4 0", "3 0") for _, t in NOTICES],
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc-sa/3.0/",
    ]
    schema = "h string, doc_id long, text string, label int"
    rows = [("a", k, t, None) for k, t in enumerate(texts)] + [("b", 2, "MIT License", 1), ("b", None, "apache license", 1)]
    got = sorted((tuple(r) for r in scan_licenses(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted(((r[1], *brute(r[2])) for r in rows), key=repr)
    assert scan_licenses(spark.createDataFrame([], schema)).count() == 0


def test_plan_is_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan) and "BroadcastHashJoin" in plan
