import random
import re

from tidemark.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(text, templates):
    """Every block of every length against every template, without order or filters."""
    found = WORD.findall(lower(text or ""))
    hits = {}
    for label, t in templates:
        own, size = set(WORD.findall(lower(t))), 2 * len(WORD.findall(lower(t)))
        share = max((len(own & set(found[i : i + size])) / len(own) for i in range(len(found))), default=0)
        if share >= 0.8 - 1e-9:
            hits[label] = max(hits.get(label, 0), share)
    return ",".join(sorted(hits)), max(hits.values(), default=0.0)


def test_join_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    templates = [(f"t{i}", " ".join(r.choices(vocabulary, k=r.choice([1, 3, 8, 25])))) for i in range(20)]
    texts = []
    for _ in range(300):
        base = WORD.findall(r.choice(templates)[1])
        keep = [w for w in base if r.random() < 0.85] + r.sample(vocabulary, r.randint(0, 30))
        r.shuffle(keep)
        cut = r.randint(0, len(keep))
        texts.append(" ".join(keep[:cut]) + r.choice(["\n", " ", "\n\n"]) + " ".join(keep[cut:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scan(docs, templates=templates, phrases={"no such": "none"}).collect()}
    met = 0
    for i, t in enumerate(texts):
        labels, score = brute(t, templates)
        met += labels != ""
        assert got[i].labels == labels and abs(got[i].score - score) < 1e-9, t
        assert set(filter(None, got[i].best_labels.split(","))) <= set(labels.split(",")) and bool(labels) == bool(got[i].best_labels)
    assert 50 < met < 300


MIT = """MIT License

Copyright (c) 2020 A. Nother

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0

# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.

# See the License for the specific language governing permissions and
# limitations under the License.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_notices_of_several_paragraphs_and_notices_within_long_lines(spark):
    filler = " ".join(f"filler{i}" for i in range(3000))
    notices = {"mit": MIT, "apache": APACHE, "bsd": BSD, "gpl": GPL}
    texts = [filler + "\n\n" + n + "\n" + filler for n in notices.values()] + [f"{filler} Licensed under CC BY 4.0. {filler}", "a page whose footer says that it is licensed under CC BY-SA 4.0 and whose other words go on for a while in the same line, in all some thirty of them"]
    texts += [BSD + "\n" + filler + "\nLicensed under CC BY-NC 4.0.", " ".join(f"{w} " + " ".join(f"z{i}" for i in range(40)) for w in MIT.split())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scan(docs, phrases={"no such": "none"}).collect()}
    for i, label in enumerate(notices):
        assert got[i].labels == got[i].best_labels == label and got[i].score >= 0.8, label
        m = got[i].matches[0]
        assert m.start >= 3000 and m.end <= 3000 + len(WORD.findall(lower(notices[label])))
    assert (got[4].best_labels, got[4].score) == ("cc-by", 1.0) and "cc-by" in got[4].labels
    assert (got[5].best_labels, got[5].score) == ("cc-by-sa", 1.0)
    assert got[6].best_labels == "bsd,cc-by-nc"
    assert got[7].labels == "", "words that stand far apart are no block"
    for i, t in enumerate(texts):
        if len(t) < 2000:
            assert (got[i].labels, got[i].score) == brute(t, licenses.TEMPLATES)


def test_base_columns_and_edges(spark):
    texts = {
        1: None, 2: "", 3: "The MIT License and the mit-LICENSE; GNU General Public\nLicense.", 4: "É mit  license\n" + "x " * 300000, 5: "Licensed under CC BY-NC 4.0.", 6: licenses.TEMPLATES[0][1].replace(", ", "\n"), 7: "plain words only", 8: "mitlicense apache licenses",
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(5, texts[5], "y")], "doc_id long, text string, labels string")
    rows = licenses.scan(docs).orderBy("doc_id").collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 9
    assert tuple(got[1])[1:8] == (0, 0, None, None, "", "", 0.0) and tuple(got[2])[1:8] == (0, 0, None, None, "", "", 0.0)
    assert tuple(got[3])[1:6] == (11, 3, 1, 8, "gpl,mit") and got[3].score == 1.0
    assert tuple(got[4])[1:7] == (300003, 1, 1, 1, "mit", "mit")
    assert got[5].base_labels == "" and got[5].best_labels == "cc-by-nc" and got[5].score == 1.0
    assert got[6].labels == "mit" and got[7].labels == "" and got[8].n_base == 0
    assert licenses.scan(docs.limit(0)).count() == 0
