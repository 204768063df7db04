"""Name resolution against comparing every pair."""

import random

from townhall_spark.operators.jurisdictions import resolve_jurisdictions


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def expected(name, state, listed):
    key = name.strip().lower()
    if (key, state) in listed:
        return listed[key, state], "exact"
    close = []
    for (other, where), fips in listed.items():
        n = edits(key, other)
        if where == state and 1 - n / max(len(key), len(other)) >= 0.8:
            close.append((n, other, fips))
    return (min(close)[2], "close") if close else (None, None)


def test_against_all_pairs(spark):
    rng = random.Random(3)
    syllables = ["spring", "field", "ville", "burg", "new", "port", "land", "oak", "a", "ridge"]
    listed = {}
    for i in range(120):
        name = "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
        listed[name, rng.choice(["IL", "MO"])] = f"{i:07d}"
    queries = []
    for (name, state) in list(listed):
        text = list(name)
        for _ in range(rng.randrange(0, 1 + max(3, len(name) // 3))):
            at = rng.randrange(len(text) + 1)
            kind = rng.choice("ids")
            if kind == "i":
                text.insert(at, rng.choice("abcxyz"))
            elif text and at < len(text):
                text[at:at + 1] = [] if kind == "d" else [rng.choice("abcxyz")]
        queries.append((" " + "".join(text).title(), rng.choice([state, state, "MO"])))
    crosswalk = spark.createDataFrame(
        [(name.title(), state, fips, "place") for (name, state), fips in listed.items()],
        "jurisdiction_name string, state string, fips string, fips_type string")
    records = spark.createDataFrame(queries, "jurisdiction_name string, state string")
    got = {(r.jurisdiction_name, r.state): (r.fips, r.match)
           for r in resolve_jurisdictions(records, crosswalk).collect()}
    assert got == {(n, s): expected(n, s, listed) for n, s in set(queries)}
    assert {m for _, m in got.values()} == {"exact", "close", None}
