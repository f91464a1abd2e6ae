"""Licence scans: whole texts, wrapped headers, embedded statements, the root directory, plain cosines."""

import math
import re
import textwrap
from collections import Counter

import pytest

from idsignal.llm import licenses

TEXT = {(name, text.split()[0]): text for name, text in licenses.TEXTS}
MIT = "MIT License\n\nCopyright (c) 2019 Some Person\n\n" + textwrap.fill(TEXT["MIT", "Permission"], 78)
CODE = "import os\n\ndef run(path):\n    for name in os.listdir(path):\n        print(name)\n"
WRAPPED = textwrap.indent(textwrap.fill(TEXT["GPL-3.0", "This"], 60), "# ")
EMBEDDED = "# Part of the engine of some firm; see the manual. Licensed under the Apache License, Version 2.0. Ask the team for more of it"


def scanned(spark, files):
    frame = spark.createDataFrame(files, "path string, text string")
    return licenses.scan(frame, ["path", "text"]).drop("doc").collect()


def plain_files():
    return [(f"src/pkg/m{i}.py", CODE + f"value = {i}\n" * (i % 40)) for i in range(60)]


def test_texts_headers_and_statements(spark):
    files = plain_files() + [("a/LICENSE", MIT), ("b/x.py", MIT + "\n" + CODE * 3), ("c/y.py", CODE + WRAPPED + "\n" + CODE * 5),
                             ("d/z.py", CODE + EMBEDDED + "\n" + CODE), ("e/LICENSE.txt", TEXT["BSD-3-Clause", "Redistribution"])]
    got = {r.path: r.own for r in scanned(spark, files)}
    assert got == {p: None for p, _ in plain_files()} | {
        "a/LICENSE": "MIT", "b/x.py": "MIT", "c/y.py": "GPL-3.0", "d/z.py": "Apache-2.0", "e/LICENSE.txt": "BSD-3-Clause"}


def test_licence_in_the_root(spark):
    gpl = licenses.TEMPLATES["GPL-3.0"]
    files = [("LICENSE", MIT), ("top.py", CODE), ("src/a.py", CODE), ("lib/COPYING", gpl), ("lib/b/c.py", CODE), ("/LICENSE", gpl), ("/etc/x", CODE)]
    got = {r.path: (r.own, r.licence, r.declared_in) for r in scanned(spark, files)}
    # a path that begins with "/" has the empty name as its first directory: the same root
    assert got["LICENSE"][0] == "MIT" and got["lib/b/c.py"] == (None, "GPL-3.0", "lib")
    assert got["top.py"] == got["src/a.py"] == got["/etc/x"] and got["top.py"][2] == ""


def test_null_path_and_text_are_files_of_their_own(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = scanned(spark, [(mit, None), (None, mit), (None, None), ("", mit), (None, mit)])
    got = sorted((str(r.path), str(r.own), str(r.licence)) for r in rows)
    assert got == sorted([(mit, "None", "None"), ("None", "MIT", "MIT"), ("None", "None", "None"), ("", "MIT", "MIT"), ("None", "MIT", "MIT")])


def cosine(words, bag, idf, unseen):
    held = Counter(words)
    dot = sum(n * idf[t] * bag[t] * idf[t] for t, n in held.items() if t in bag)
    norm = math.sqrt(sum((n * idf.get(t, unseen)) ** 2 for t, n in held.items())) * math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
    return dot / norm if norm else 0.0


@pytest.mark.parametrize("seed", [0, 1])
def test_cosines_by_brute_force(spark, seed):
    import random
    dice = random.Random(seed)
    pool = [t for text in [*licenses.TEMPLATES.values(), *TEXT.values()] for t in text.split()] + CODE.split() * 3
    files = [(f"d{i % 5}/{'LICENSE' if i % 7 == 0 else i}", "\n".join(
        dice.choice([" ".join(dice.choices(pool, k=dice.randint(0, 9))), dice.choice([*licenses.TEMPLATES.values()]), dice.choice(textwrap.wrap(MIT, 60)), ""])
        for _ in range(dice.randint(0, 30)))) for i in range(25)]
    bags = licenses.template_tokens([*licenses.TEMPLATES.items(), *licenses.TEXTS])
    words = lambda text: re.findall("[a-z0-9]+", text.lower())
    df = Counter(t for _, text in files for t in set(words(text)))
    vocabulary = set().union(*bags.values())
    idf = {t: math.log((len(files) + 1) / (df[t] + 1)) + 1 for t in vocabulary}
    unseen = math.log(len(files) + 1) + 1
    want = Counter()
    for path, text in files:
        lines = re.split(licenses.SENTENCE_END, text)
        blocks = [lines[b * step:b * step + size] for size, step in licenses.BLOCKS for b in range(-(-len(lines) // step))]
        blocks += [[text]] if path.endswith("LICENSE") else []
        best = min(((-round(cosine([w for line in block for w in words(line)], bag, idf, unseen), 6), name)
                    for block in blocks for (name, _), bag in bags.items()
                    if sum(len(words(line)) for line in block) <= licenses.TIMES * sum(bag.values())), default=(0, None))
        want[(path, best[1], -best[0]) if -best[0] >= licenses.SIMILAR else (path, None, None)] += 1
    got = Counter((r.path, r.own, r.cosine) for r in scanned(spark, files))
    assert (got - want, want - got) == (Counter(), Counter()) and len({k[1] for k in want}) > 2


def test_units_are_scored_inside_their_row(spark):
    bags = licenses.template_tokens([*licenses.TEMPLATES.items()])
    idf = {t: 2.0 for bag in bags.values() for t in bag}
    files = spark.createDataFrame([(1, f"a\nb\n{EMBEDDED}\n" * 3, False), (2, MIT, True)], "number long, text string, is_licence boolean")
    found = licenses.own_licences(files, bags, idf, 3.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(dealt) == 1 and "hashpartitioning(number" in dealt[0] and "token" not in dealt[0]
    assert {r.number: r.licence for r in found.collect()}[1] == "Apache-2.0"


def test_blocks_of_other_words_are_no_units(spark):
    bags = licenses.template_tokens([*licenses.TEMPLATES.items()])
    idf = {t: 2.0 for bag in bags.values() for t in bag}
    text = "\n".join([*(["the version of this form is subject to many quite unlike rules and terms we never name"] * 5), EMBEDDED])
    files = spark.createDataFrame([(1, text, False)], "number long, text string, is_licence boolean")
    made = licenses.units(files, lambda t, unit=False: licenses.F.lit(True), idf, 9.0).collect()
    assert {r.line for r in made if r.size == 1} == {"Licensed under the Apache License, Version 2.0."}
