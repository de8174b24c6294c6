import random
import re

from pyspark.sql import functions as F

from lumenframe.llm import licenses


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


NOTICES = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Released under the MIT License.": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
    "// Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "mit",
}


def test_labels_and_base_against_the_plain_way(spark):
    rnd = random.Random(2)
    filler = ["the", "of", "license", "mit", "public", "general", "Éa", "x9", "open", "source", "free", "software"]
    rows, want = [], {}
    for i in range(300):
        notice, label = rnd.choice([*NOTICES.items(), ("", "")])
        text = " ".join(rnd.choice(filler) for _ in range(rnd.randrange(60))) + ".\n" + notice + "\n" + "| ".join(rnd.choice(filler) for _ in range(30))
        rows.append((i, text))
        want[i] = (plain(text), label)
    rows += [(1000, None), (1001, ""), (1002, "MIT--LICENSE\nmit license " * 3000), (1002, "apache/license"), (None, "General public LICENSE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash")).withColumn("found__", F.lit(0))
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(str((i, *plain(t))) for i, t in rows)
    for r in got:
        own = set(filter(None, r.labels.split(",")))
        assert own >= set(filter(None, r.base_labels.split(","))) and list(sorted(own)) == list(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
        if r.doc_id in want:
            assert own - set(r.base_labels.split(",")) <= {want[r.doc_id][1]}
            assert not want[r.doc_id][1] or want[r.doc_id][1] in own
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def every_place(text, threshold):
    """Each passage laid over every place of the text."""
    words, index, out = licenses.words_of(text.encode()), licenses.build_index(threshold=threshold), {}
    for t, own in enumerate(index.words):
        for o in range(-len(own), len(words) + 1):
            same = sum(0 <= o + j < len(words) and words[o + j] == w for j, w in enumerate(own)) / len(own)
            stand = all(o + at >= 0 and tuple(words[o + at : o + at + len(p)]) == p for at, p in index.phrases[t])
            if stand and same >= threshold:
                label = index.templates[t].label
                out[label] = max(out.get(label, 0), same)
    return out


def test_the_index_misses_no_place():
    rnd = random.Random(9)
    passages = [t.text for t in licenses.TEMPLATES]
    found = 0
    for threshold in (0.6, 0.8):
        index = licenses.build_index(threshold=threshold)
        for _ in range(60):
            words = []
            for _ in range(3):
                own = rnd.choice(passages).split()
                words += [rnd.choice(["zzz", "license", w]) if rnd.random() < 0.2 else w for w in own if rnd.random() > 0.005]
                words += [rnd.choice("license the software mit free".split()) for _ in range(rnd.randrange(12))]
            text = " ".join(words)
            want = every_place(text, threshold)
            got = licenses.scan(text.encode(), index, base={"no such phrase": "none"})
            assert set(filter(None, got[5].split(","))) == want.keys(), text
            assert got[6] == max(want.values(), default=0)
            found += len(want)
    assert found > 50


def test_whole_licences():
    mit = "MIT License\n\nCopyright (c) 2024 Some One\n\n" + "\n\n".join(t.text for t in licenses.TEMPLATES if t.label == "mit")
    index = licenses.build_index()
    assert licenses.scan(mit.encode(), index)[5:] == ("mit", 1.0)
    for t in licenses.TEMPLATES:
        assert t.label in licenses.scan(("// " + t.text.replace(" ", "\n * ")).encode(), index)[5].split(","), t


def test_scattered_words_are_no_licence():
    index = licenses.build_index()
    notice = list(NOTICES)[4]
    words = re.findall(r"\w+", notice)
    assert licenses.scan(notice.encode(), index)[5] == "bsd"
    random.Random(1).shuffle(words)
    assert licenses.scan(" ".join(words).encode(), index)[5] == ""
    without = notice.replace("source and binary forms", "any form")
    assert licenses.scan(without.encode(), index)[5] == ""
    elsewhere = without + " " + " ".join(["x"] * 9) + " redistribution and use in source and binary forms"
    assert licenses.scan(elsewhere.encode(), index)[5] == ""


def test_labels_depend_on_the_file_alone(spark):
    notices = [(i, n) for i, n in enumerate(NOTICES)]
    alone = [tuple(licenses.scan_licenses(spark.createDataFrame([r], "doc_id long, text string")).first()) for r in notices[:2]]
    crowd = spark.createDataFrame(notices[:2] + [(100 + i, list(NOTICES)[0]) for i in range(50)], "doc_id long, text string")
    assert [tuple(r) for r in licenses.scan_licenses(crowd).where("doc_id < 100").orderBy("doc_id").collect()] == alone
