"""Rows that no operator may trip over."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

AWKWARD = [
    (1, "the cat sat on the mat. " * 30),
    (2, None),
    (3, ""),
    (None, "no id here, just text"),
    (5, "same row twice"),
    (5, "same row twice"),
    (6, "  \n\t spaces 　 and\x1csigns!? 'll <|endoftext|> naïve 😀 中文字 \x00 "),
    (7, "!!! ???"),
    (8, "x" * 5000),
    (9, " ".join(f"word{i}" for i in range(6000))),
    (10, "\n\n"),
]
