"""Rows that the tests of this folder share."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, words string, kept int, size string, shard int, __row string, __h int, digest string, part int, value double, __kept int, hashes string, __times int"


def row(i, text, lang="en", source="s1"):
    return (i, text, lang, source, None if text is None else len(text), "w", 1, "x", 2, "r", 3, "d", 4, 0.5, 5, "h", 6)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(("ka", "to", "mi", "re", "su", "no", "la", "vé")) for _ in range(r.randint(1, 4))) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and blank texts, very long texts, repeated rows, equal ids, copies and near copies."""
    long = prose(1, 30_000)
    passage = prose(2, 60)
    base = prose(3, 120).split()
    near = base[:]
    near[60] = "changed"
    rows = [
        row(1, "Plain words. " + prose(4, 40)), row(2, None), row(None, prose(5, 30)), row(3, ""), row(4, " \t\n\x0b\f\r "), row(5, long), row(6, long),
        row(7, " ".join(base)), row(8, " ".join(near)), row(9, prose(6, 30) + " " + passage + " " + prose(7, 30)), row(10, prose(8, 20) + "\n" + passage + "\n" + prose(9, 44)),
        row(11, "one"), row(11, "one"), row(12, "no-spaces" * 3000), row(13, "日本語 テキスト <|endoftext|> 😀 naïve"), row(14, "1234 5678"), row(15, prose(10, 50), None, None),
        row(16, prose(11, 50), "fr", None), row(16, prose(12, 50), "fr", "s2"), row(17, "Der " * 200, "de", "s2"), row(18, "### $$$ " * 50, "de", "s3"),
        (None,) * 17,
    ]
    return rows
