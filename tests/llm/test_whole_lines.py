"""Line classes of lines of all lengths, against all pairs of lines."""

import random

import brute
from conftest import collected
from encore.llm import lines
from test_lines import edited


def linked(x, y):
    most = min(2, max(len(x), len(y)) // 20)
    if brute.edit_distance(x, y, most) <= most:
        return True
    x, y = x.split(), y.split()
    most = max(len(x), len(y)) // 20
    return brute.edit_distance(x, y, most) <= most and most > 0


def classes(rows):
    flat = [(d, i, x.strip()) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    first = {}
    for d, i, x in sorted(flat):
        if x:
            first.setdefault(x, (d, i))
    held = sorted(first)
    links = [(first[x], first[y]) for n, x in enumerate(held) for y in held[:n] if linked(x, y)]
    found = brute.components(first.values(), links)
    return sorted((d, i, len(x), *(f := found[first[x]] if x else (d, i)), f == (d, i)) for d, i, x in flat)


def test_short_copies_are_found(spark):
    rows = [(1, "All rights reserved.\nThis one stays.\n\nx"), (2, "  All rights reserved.\nAnd this.\n\n"),
            (3, "x\nAll rights reserved!\nOne\nOnce"), (4, "All rights reserved"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(lines.line_classes(docs)) == classes(rows)
    assert collected(lines.without_repeated_lines(docs)) == [
        (1, rows[0][1]), (2, "And this.\n\n"), (3, "One\nOnce"), (4, ""), (5, None), (6, "")]


def test_lines_of_all_lengths(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 70))).strip() for _ in range(90)]
    rows = [(d, "\n".join(edited(rng.choice(base), rng.randint(0, 3), rng, "abcde") for _ in range(6))) for d in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collected(lines.line_classes(docs))
    assert got == classes(rows) and sum(not r[5] and r[2] < 40 for r in got) > 50


def test_crowds_with_strays(spark):
    """More lines than a small bucket holds share a stretch, and few of them are linked."""
    rng = random.Random(2)
    rows = [(d, "We all know the start" + "".join(rng.choice("abcd") for _ in range(rng.choice([39, 39, 40])))) for d in range(60)]
    rows += [(100 + d, edited(rows[d][1], 2, rng, "abcd")) for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collected(lines.line_classes(docs))
    assert got == classes(rows) and 10 < sum(not r[5] for r in got) < 40


def changed(words, n, rng):
    """The words after n edits."""
    words = list(words)
    for _ in range(n):
        i, kind = rng.randrange(len(words)), rng.choice("idr")
        words[i:i + (kind != "i")] = [] if kind == "d" else [rng.choice(["another", "quite", "different"])]
    return words


def test_long_lines_with_changed_words(spark):
    rng = random.Random(7)
    base = [[f"word{rng.randrange(900)}" for _ in range(rng.randint(15, 140))] for _ in range(25)]
    rows = [(d, "\n".join(" ".join(changed(w, rng.randint(0, 1 + len(w) // 18), rng)) for w in rng.sample(base, 4)))
            for d in range(40)]
    # one line of hundreds of words, and one of thousands
    rows += [(100 + k, " ".join(changed([f"a{i}" for i in range(n)], k * n // 20, rng))) for n in (400, 6000) for k in (0, 1)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collected(lines.line_classes(docs))
    assert got == classes(rows) and sum(not r[5] for r in got) > 60
    assert not got[-1][5] and not got[-3][5]


def test_lines_alike_by_words_share_a_key():
    rng = random.Random(1)
    for _ in range(1500):
        a = [str(rng.randrange(40)) for _ in range(rng.randint(18, 260))]
        b = changed(a, max(1, len(a) // 20), rng)
        n = max(len(a), len(b)) // 20
        if n and brute.edit_distance(a, b, n) <= n:
            to, key = lines.word_keys([" ".join(a), " ".join(b)])
            assert set(key[to == 0].tolist()) & set(key[to == 1].tolist())
