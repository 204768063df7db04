import random
import time

from townhall_spark.llm import licenses
from townhall_spark.llm.common import WordHashes
from townhall_spark.llm.words import words

SCHEMA = "doc_id long, text string, licenses string"


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_a_common_subsequence_and_close_to_the_longest():
    rng = random.Random(1)
    for _ in range(200):
        template = [rng.randrange(40) for _ in range(30)]
        text = [x for x in template if rng.random() > 0.1]
        for _ in range(3):
            text.insert(rng.randrange(len(text)), rng.randrange(40, 80))
        matched = licenses.align(text, template)
        assert all(text[i] == template[j] for i, j in matched)
        assert all(a < c and b < d for (a, b), (c, d) in zip(matched, matched[1:], strict=False))
        assert len(matched) >= 0.7 * longest_common(text, template)


def test_longest_rising():
    assert licenses.longest_rising([]) == []
    values = [3, 1, 2, 9, 4, 5]
    assert [values[i] for i in licenses.longest_rising(values)] == [1, 2, 4, 5]


def test_every_template_is_found_in_a_text(spark):
    rows = [(i, f"Some words before.\n{t.upper()} And after it.", "x")
            for i, (_, t) in enumerate(licenses.TEMPLATES)]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in got:
        name, text = licenses.TEMPLATES[r.doc_id]
        assert r.licenses == [name], text
        assert r.matches[0].coverage == 1.0 and r.matches[0].start_word == 3


def test_edited_repeated_long_and_missing_texts(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 100)
    edited = mit.replace("free of charge", "at no cost").replace("merge, ", "")
    short = "Released under the MIT License. "
    rows = [(1, edited, "x"), (2, short * 3, "x"), (3, "word " * 50000 + short, "x"), (4, None, "x"),
            (5, "", "x"), (6, "the license and the software", "x"), (1, edited, "x")]
    got = sorted(licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect(),
                 key=lambda r: r.doc_id)
    assert [(r.doc_id, r.licenses, len(r.matches)) for r in got] == [
        (1, ["MIT"], 1), (1, ["MIT"], 1), (2, ["MIT"], 3), (3, ["MIT"], 1), (4, [], 0), (5, [], 0),
        (6, [], 0)]
    assert 0.85 <= got[0].matches[0].coverage < 1
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_usual_wordings_and_near_misses(spark):
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and len(t) > 100)
    bsd = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause")
    cases = [("Licensed under the MIT License", "MIT"), (gpl, "GPL-3.0"),
             (gpl.replace("GNU General", "GNU Lesser General"), "LGPL-3.0"),
             (gpl.replace("GNU General", "GNU Affero General"), "AGPL-3.0"),
             (bsd, "BSD-3-Clause"), (bsd.split(" Neither")[0], "BSD-2-Clause"),
             ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
             ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
             ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0")]
    rows = [(i, t, "x") for i, (t, _) in enumerate(cases)]
    got = {r.doc_id: r.licenses for r in
           licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(cases))] == [[name] for _, name in cases]


def scanned(texts, least=licenses.LEAST, templates=licenses.TEMPLATES):
    scanner, seen = licenses.Scanner(templates, least), WordHashes()
    return [[(m.license, m.start_word, m.end_word, m.coverage)
             for m in scanner.matches(seen.of(words(t)))] for t in texts]


def test_words_between_those_of_a_text_do_not_hide_it():
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200).split()
    apart = " ".join(f"{w} f{i}" for i, w in enumerate(mit))
    split = " ".join(mit[:80] + [f"x{i}" for i in range(5000)] + mit[80:])
    twice = " ".join(["pre", *mit, "mid", *mit, "post"])
    got = scanned([apart, split, twice])
    assert [[m[0] for m in found] for found in got] == [["MIT"], ["MIT"], ["MIT", "MIT"]]
    assert got[0][0][3] > 0.95 and got[1][0][3] == got[2][0][3] == got[2][1][3] == 1.0


def test_scan_against_the_alignment_of_the_whole_text():
    """A text covers a template exactly where an alignment of all of it does."""
    rng = random.Random(6)
    seen = WordHashes()
    long = [(n, t) for n, t in licenses.TEMPLATES if len(words(t)) >= licenses.LONG]
    tried = 0
    for _ in range(400):
        name, text = rng.choice(long)
        own = words(text)
        kept = [w for w in own if rng.random() > rng.choice([0, 0.05, 0.12, 0.2])]
        for _ in range(rng.choice([0, 3, 30, 120])):
            kept.insert(rng.randrange(len(kept) + 1), b"x%d" % rng.randrange(10 ** 6))
        line = " ".join(w.decode() for w in [b"before"] * rng.randrange(5) + kept)
        whole = licenses.align(seen.of(words(line)).tolist(), seen.of(own).tolist())
        covered = len(whole) >= 0.85 * len(own) - 1e-9
        found, = scanned([line], templates=[(name, text)])
        assert [m[0] for m in found] == [name] * covered, (name, len(whole) / len(own))
        tried += covered
    assert 100 < tried < 390


def test_identifiers_names_and_denials():
    cases = {"SPDX-License-Identifier: MIT": "MIT", "Licensed under Apache 2.0": "Apache-2.0",
             "Released under the ISC License": "ISC", "BSD 3-Clause License": "BSD-3-Clause",
             "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later",
             "Not licensed under the MIT License": None, "mit der license": None,
             "license, the under, MIT released": None,
             "Released " + "far " * 20 + "under the MIT License": None}
    assert {t: found[0][0] if found else None
            for t, found in zip(cases, scanned(cases), strict=True)} == cases


def test_a_long_text_of_shuffled_words_is_scanned_in_bounded_time():
    rng = random.Random(2)
    own = words(next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200))
    start = time.perf_counter()
    assert scanned([" ".join(w.decode() for w in rng.choices(own, k=100_000))]) == [[]]
    assert time.perf_counter() - start < 30
