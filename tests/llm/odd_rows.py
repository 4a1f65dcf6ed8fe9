"""Rows that every operator must bear."""

#: Nulls, empty and very long texts, repeated rows, repeated and missing ids; extra columns with names that operators use inside.
ODD = [
    (1, "Plain words of no great length stand here, one after another.", "en", 1, "x"),
    (1, "Plain words of no great length stand here, one after another.", "en", 1, "x"),
    (2, None, "en", None, None),
    (3, "", None, 0, ""),
    (4, "123 456 !?", "fr", 2, "y"),
    (None, "Plain words of no great length stand here, one after another.", "en", 3, "z"),
    (5, "a b c d e f g " * 30_000, "en", 4, "long"),
    (6, "\n\n  \t\x0b\n", "de", 5, ""),
    (7, "ÀÉ 漢字 Σς İ ﬃ \u0085 😀", "es", 6, ""),
]
ODD_DDL = "doc_id long, text string, lang string, key int, id string"
