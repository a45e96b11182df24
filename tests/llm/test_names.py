"""Problem 3."""

import random

from pyspark.sql import functions as F

from scriptorium.llm import p3_names as N

GIVEN = frozenset("anna bruno clara thomas katherine mei-lin karl-heinz victor vincent".split())


def brute(a, b):
    """Unrestricted Damerau-Levenshtein distance by definition (dictionary form)."""
    d = {(-1, -1): len(a) + len(b)}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = len(a) + len(b), i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = len(a) + len(b), j
    last = {}
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            i1, j1 = last.get(b[j - 1], 0), col
            if a[i - 1] == b[j - 1]:
                col = j
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1, d[i1 - 1, j1 - 1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def words(n, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcde") for _ in range(r.randint(5, 9))) for _ in range(n)]
    out = set(base)
    for w in base:
        i = r.randrange(len(w) - 1)
        out.add(w[:i] + w[i + 1] + w[i] + w[i + 2 :])
        out.add(w[:i] + w[i + 1 :])
        out.add(w[:i] + "z" + w[i:])
    return sorted(out)


def test_distance_is_the_metric():
    ws = words(25, 1)
    for p in ws[:12]:
        assert N.distances(ws, p).tolist() == [brute(w, p) for w in ws]
    assert all(N.within_one(a, b) == (brute(a, b) <= 1) for a in ws[:40] for b in ws)


def test_radius_join_equals_brute_force(spark):
    ws = [w for w in words(150, 2) if len(w) >= N.MIN_EDIT_LENGTH]
    got = {(r.a, r.b) for r in N.neighbours(spark.createDataFrame([(w,) for w in ws], "point string")).collect()}
    assert got == {(a, b) for a in ws for b in ws if a != b and N.within_one(a, b)} and got


def test_parse():
    key = lambda s: {k: N.parse(s, GIVEN)[k] for k in ("family", "given", "initials")}
    full = key("Anna von der Körbel")
    assert full == {"family": "korbel", "given": "anna", "initials": "a"}
    for s in ("KÖRBEL, ANNA", "von der Körbel Anna", "Anna VonderKörbel", "Anna  von der Koerbel", "Anna von der Körbel (Univ. X)", "Körbel Anna, Jr.", "anna körbel PhD"):
        assert key(s) == full, s
    assert key("K.-H.G. Weber")["initials"] == "khg" and key("KH Weber")["given"] == "" and key("Weber, M.-L.")["initials"] == "ml"
    assert N.parse("Anna \"Annie\" Weber", GIVEN)["nick"] == "annie"
    for s in ("", "Anonymous", "et al.", "N/A", "??", "—"):
        assert N.parse(s, GIVEN) is None
    g = N.parse("Institute for Text Mining, Weber", GIVEN)
    assert (g["kind"], g["family"], g["given"], g["topic"]) == ("g", "weber", "institute", "text mining")


def test_one_hot_given_name_hides_no_other(spark):
    from scriptorium.llm import p10_pii

    word = lambda i: "".join("bcdfghklmn"[int(c)] + "aeiou"[int(c) % 5] for c in f"{i:03d}")
    names = [f"Wolfgang {word(i)}" for i in range(100)] + [f"{g} {word(i)}" for g in ("Torvin", "Corvin") for i in range(200, 204)] + ["Torvin Berglund", "Corvin Berglund", "Berglund Torvin"]
    d = spark.createDataFrame([(i, [n]) for i, n in enumerate(names)], "meta_id long, authors array<string>")
    assert all(w in N.given_names(N.distinct_names(d)) for w in ("torvin", "corvin", "wolfgang")) and all(w in p10_pii.name_lists(d)[0] for w in ("torvin", "corvin"))
    c = {r.name: r.class_id for r in N.classes(d).collect()}
    assert c["Torvin Berglund"] == c["Berglund Torvin"] != c["Corvin Berglund"]


def test_classes(spark):
    same = [["Thomas Berglund", "Tom Berglund", "T. Berglund", "Berglund, Thomas", "Thomas Bergluund", "THOMAS BERGLUND", "Thoms Berglund", "T. Bergund"], ["Clara Öhman", "Clara Oehman", "c. ohman"], ["Weber Text Mining Institute", "The Weber TM Institute", "Institute for Text Mining, Weber"]]
    others = ["Anna Berglund", "Victor Salminen", "Vincent Salminen", "V. Salminen", "Weber Text Mining Consortium", "Bruno Ohman"]
    filler = ["", "Anonymous", None]
    # given names stand before several families
    more = [f"{g} {f}" for g in ("Thomas", "Clara", "Anna", "Victor", "Vincent", "Bruno") for f in ("Aalto", "Brandt", "Castel", "Dvorak")]
    names = [n for s in same for n in s] + others + filler + more
    rows = [(i, [n, names[0]]) for i, n in enumerate(names)] + [(900, None), (901, [])]
    d = spark.createDataFrame(rows, "meta_id long, authors array<string>").withColumn("name", F.lit("clash")).withColumn("class_id", F.lit("clash"))
    cls = N.classes(d)
    c = {r.name: r.class_id for r in cls.collect()}
    for s in same:
        assert len({c[n] for n in s}) == 1, s
    assert len({c[n] for n in [s[0] for s in same] + others}) == len(same) + len(others)
    assert "" not in c and "Anonymous" not in c
    pairs = N.pairs(cls).collect()
    assert len(pairs) == sum(len(s) * (len(s) - 1) // 2 for s in same) and all(p.name_a < p.name_b for p in pairs)
    assert N.pairs(N.classes(d.limit(0))).count() == 0
