import random
import re

from gristmill.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, label) for k in range(len(words)) for phrase, label in licenses.BASE.items() if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_equals_a_word_scan():
    rng = random.Random(4)
    pieces = ["MIT ", "License", "license ", "apache-", " general", " public", "license", ".", " ", "é", "x", "\n", "lesser ", "GNU "]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(20)))
        assert licenses.scan(text)[:5] == brute(text), text


def test_expressions():
    parse = lambda t: licenses.evaluate(licenses.to_postfix(t))
    assert parse("mit or apache-2.0 and bsd-3-clause") == ({"mit", "apache", "bsd"}, True, "(mit or (apache-2.0 and bsd-3-clause))")
    assert parse("(mit or apache-2.0) and gpl-2.0-only with classpath-exception-2.0") == ({"mit", "apache", "gpl"}, False, "((mit or apache-2.0) and (gpl-2.0-only with classpath-exception-2.0))")
    nothing = (set(), False, "")
    assert parse("or mit") == nothing and parse("mit and")[2] == "mit" and parse("(mit or") == nothing and parse("mit and (bsd")[2] == "mit" and parse("mit with (bsd)")[2] == "mit"
    for text in ("mit */ and more", "mit and more", "mit, and bsd", "mit. and bsd", "mit -->", "mit\nand bsd", "mit with more"):
        assert parse(text) == ({"mit"}, True, "mit"), text
    assert parse("mitre-x") == nothing and parse("gplx or mit") == nothing
    got = licenses.scan("// SPDX-License-Identifier: (MIT OR LGPL-2.1-only)\n")
    assert got[5] == "lgpl,mit" and got[7] == ["(mit or lgpl-2.1-only)"] and got[8] is True and 0 < got[6] < 1
    assert licenses.scan("/* SPDX-License-Identifier: MIT */ and more")[5] == "mit"
    assert licenses.scan('"license": "GPL-3.0-or-later"')[5:9:3] == ("gpl", False) and licenses.scan("License: see the file")[5] == ""


def test_expressions_equal_a_recursive_parser():
    """Labels, openness and text of random well-formed expressions, parsed by recursion over precedence."""
    rng = random.Random(5)
    names = ("mit", "gpl-2.0-only", "apache-2.0", "mpl-2.0", "cc0-1.0")

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(names)
            return f"{name} with llvm-exception" if rng.random() < 0.2 else name
        joined = f" {rng.choice(('and', 'or'))} ".join(made(depth - 1) for _ in range(rng.randrange(2, 4)))
        return f"({joined})" if rng.random() < 0.5 else joined

    def parsed(tokens, level):
        if level == 3:
            token = tokens.pop(0)
            if token == "(":
                inner = parsed(tokens, 1)
                tokens.pop(0)
                return inner
            label = licenses.label_of(token)
            left = ({label}, label in licenses.OPEN, token)
            if tokens[:1] == ["with"]:
                return left[0], left[1], f"({token} with {(tokens.pop(0), tokens.pop(0))[1]})"
            return left
        left = parsed(tokens, level + 1)
        word = ("or", "and")[level - 1]
        while tokens[:1] == [word]:
            tokens.pop(0)
            right = parsed(tokens, level + 1)
            left = left[0] | right[0], left[1] or right[1] if word == "or" else left[1] and right[1], f"({left[2]} {word} {right[2]})"
        return left

    for _ in range(500):
        text = made(3)
        assert licenses.evaluate(licenses.to_postfix(text)) == parsed(re.findall(r"\(|\)|[^ ()]+", text), 1), text


def test_labels_equal_a_word_scan():
    """Notice phrases at any place, overlapping or not, by comparing words."""
    rng = random.Random(7)
    pool = sorted({w for p in [*licenses.NOTICES, *licenses.BASE] for w in p.split()})
    for _ in range(2000):
        text = " ".join(rng.choice([*licenses.NOTICES, *licenses.BASE]) if rng.random() < 0.2 else rng.choice(pool) for _ in range(rng.randrange(12)))
        words = text.split()
        want = {x for p, x in {**licenses.NOTICES, **licenses.BASE}.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()}
        assert licenses.scan(text)[5] == ",".join(sorted(want)), text


def test_long_expressions():
    """In seconds, and without numbers that outgrow a column."""
    for text in (" and ".join(["(mit or bsd)"] * 70), " or ".join(["mit"] * 100_000), " and ".join(["(gpl-2.0-only or bsd)"] * 40_000), "(" * 100_000 + "mit" + ")" * 100_000, "(" * 100_000 + "mit", "mit and " * 100_000):
        got = licenses.scan(f"SPDX-License-Identifier: {text}")
        assert set(got[5].split(",")) <= {"mit", "bsd", "gpl", ""}
    licenses.scan("license: " * 100_000)
    assert licenses.scan("The MIT License. " * 100_000)[1] == 100_000


def test_rows(spark):
    df = spark.createDataFrame([(1, "The MIT License", "x"), (1, "The MIT License", "x"), (2, None, None), (None, "", None)], "doc_id long, text string, labels string")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(df).collect()), key=str)
    assert got == [(1, 3, 1, 1, 1, "mit")] * 2 + [(2, 0, 0, None, None, ""), (None, 0, 0, None, None, "")]
    assert licenses.scan_licenses(df.limit(0)).count() == 0
