from __future__ import annotations

import itertools
import random
import re

from papyrus.llm import licenses, queries


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_query_by_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = queries.op7_licence_scan(spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in found} == {d: brute(t) for d, t in texts.items()}
    assert sum(r["n_base"] > 0 for r in found) > 20
    for r in found:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["labels"] != "" or r["score"] == 0)


NOTES = {
    "// Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
    "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0.": "mpl",
    "licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
    "Released under the MIT License.": "mit",
    "free software for any person, without charge; the above notice": "",
    "": "",
}


def test_notices(spark):
    filler = " ".join(f"w{k}" for k in range(200))
    rows = [(i, f"{filler} {t} {filler}", "x") for i, t in enumerate(NOTES)]
    found = {r["doc_id"]: r for r in licenses.licences(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()}
    assert [found[i]["labels"] for i in range(len(NOTES))] == list(NOTES.values())
    assert found[0]["score"] > 0.9 and found[5]["score"] == 0


def test_several_notices_in_one_file():
    """Every notice is found beside any others, in a file as long as one likes, also among prose of rare template words."""
    templates = licenses.TEMPLATES
    frequencies = {w: 5 + k % 40 for k, w in enumerate(sorted(licenses.VOCABULARY))} | {b"": 10_000}
    scanner = licenses.Scanner(frequencies)
    filler = " ".join(f"w{k}" for k in range(40))
    groups = [templates, templates * 3, *map(list, itertools.combinations(templates, 2)), *random.Random(1).sample(list(itertools.combinations(templates, 3)), 60)]
    for group in groups:
        found = scanner.scan(f" {filler} ".join(notice for _, notice, _ in group))
        assert {label for label, _, _ in group} <= set(found[5].split(",")) and found[6] == 1
    rare = " ".join(w.decode() for w in sorted(licenses.VOCABULARY, key=lambda w: frequencies[w])[:60])
    for label, notice, _ in templates:
        assert label in scanner.scan(f"{rare} {filler} {notice} {filler} {rare}")[5].split(",")


def test_every_alignment_by_brute_force():
    """Damaged notices: labels and score are those of the best of all alignments with a mandatory phrase near."""
    rng = random.Random(3)
    scanner = licenses.Scanner({w: rng.choice([0, 3, 50, 900]) for w in sorted(licenses.VOCABULARY)} | {b"": 1000})
    some = 0
    for _ in range(150):
        text = []
        for _, notice, _ in rng.sample(licenses.TEMPLATES, 3):
            words = [w.decode() for w in licenses.words_of(notice)]
            drop = rng.choice([0, 0.1, 0.3])
            text += [w for w in words if rng.random() >= drop] + ["filler"] * rng.randrange(4)
        words, labels, score = licenses.words_of(" ".join(text)), set(), 0.0
        for (label, template, phrases), total in zip(licenses._TEMPLATES, scanner.total, strict=True):
            starts = {i for p in phrases for i in range(len(words)) if tuple(words[i : i + len(p)]) == p}
            for shift in range(-len(template) - 4, len(words) + 4):
                if any(shift - licenses.SLACK <= i < shift + len(template) + licenses.SLACK for i in starts):
                    hit = sum(scanner.weight[w] for k, w in enumerate(template) if any(0 <= shift + k + d < len(words) and words[shift + k + d] == w for d in range(-licenses.SLACK, licenses.SLACK + 1)))
                    if hit / total >= licenses.LEAST:
                        labels.add(label)
                        score = max(score, hit / total)
        found = scanner.scan(" ".join(text))
        base = set(filter(None, found[4].split(",")))
        assert set(filter(None, found[5].split(","))) == labels | base
        assert found[6] == round(min(score or (0.5 if base else 0.0), 1.0), 6)
        some += bool(labels)
    assert some > 50


def test_odd_rows(odd_docs, no_docs):
    rows = licenses.licences(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert tuple(next(r for r in rows if r["doc_id"] == 1)) == (1, 0, 0, None, None, "", "", 0.0)
    assert licenses.licences(no_docs).count() == 0


def test_files_are_looked_up_by_the_rarest_words():
    """The index holds rare words only, and without them no template is looked at, whatever phrases stand there."""
    frequencies = {w: 10 + k % 50 for k, w in enumerate(sorted(licenses.VOCABULARY))} | {w.encode(): 9_990 for w in ("the", "of", "and", "to", "in", "or", "a", "is")} | {b"": 10_000}
    scanner = licenses.Scanner(frequencies)
    assert not {b"the", b"of", b"and"} & set(scanner.postings)
    seen = []
    scanner._phrase_starts = lambda t, words, at: seen.append(t) or []
    scanner.scan("the of and to in or a is " * 50)
    assert not seen
    for t, (_, notice, _) in enumerate(licenses.TEMPLATES):
        seen.clear()
        scanner.scan(notice)
        assert t in seen
