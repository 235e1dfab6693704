"""Rows that the tests of this folder share."""

import random

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, rid long, h long, n int, digest string, bin int, size int, id string, y int, _s string, block long, verdicts string"


def words(seed, n, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = words(1, 40_000)
    base = [
        (1, "one two three four five six seven eight", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n\r\x0b\x0c ", "de", None), (5, long, "en", "a"),
        (6, long[:-40] + " a changed tail", "en", "b"), (7, words(2, 120), "fr", "a"), (7, words(2, 120), "fr", "a"), (7, words(3, 90), "fr", "c"), (None, words(2, 120), None, None),
        (None, None, None, None), (8, "Zeile eins\nZeile eins\n\n\nZeile eins", "de", "b"), (9, "x" * 5000, "en", "a"), (10, "ÄÖÜ ß 日本語 \U0001F600 done", "de", "b"), (11, words(2, 120).upper(), "fr", "a"),
        (12, "one two three four five six seven eight", "en", "b"), (0, words(4, 300), "en", "a"), (-5, words(4, 300) + " more", "en", "a"),
    ]
    return [(i, t, lang, src, None if t is None else len(t), 1, 2, 3, "d", 4, 5, "i", 6, "s", 7, "v") for i, t, lang, src in base]
