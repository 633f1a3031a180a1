"""Documents with every awkward case, used by all tests of these operators."""

from __future__ import annotations

import random

CLASH = ["row", "h1", "h2", "n", "key", "kept", "node", "group", "a", "b", "label", "score", "item_id", "leaks", "line", "component_id", "rank", "n_words", "text_hash", "salt"]


def texts() -> list[tuple]:
    r = random.Random(5)
    words = ["the", "of", "and", "Straße", "thing", "naïve", "日本語", "ones", "was", "in", "it's", "42", "%%%", "re-do"]
    long = " ".join(r.choice(words) + str(r.randrange(900)) for _ in range(60_000))
    prose = [" ".join(r.choice(words) + r.choice("abcdefgh") * r.randrange(4) for _ in range(n)) for n in (1, 2, 3, 4, 5, 40, 90, 300)]
    near = prose[7].split()
    near[100] = "changed"
    out = [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (None, "no id at all"), (4, long), (5, long + "."), (6, "same text"), (7, "same  text"), (8, "sametext"), (9, "same text"), (9, "same text"),
           (10, "a" * 5000), (11, "line one\nline one\nline onf\n\nline one"), (12, prose[7] + "\n"), (13, " ".join(near)), (14, "x <|endoftext|> y"), (-(1 << 63), "same\ttext"), ((1 << 63) - 1, "same  text"), (15, "﻿    K ſ"), (None, None)]
    return out + [(20 + i, t) for i, t in enumerate(prose)]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(i, t, None, "src0" if i else None, None, *("z" for _ in CLASH)) for i, t in rows], ddl)


def brute_components(nodes, linked):
    """{node: smallest node it leads to}."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
