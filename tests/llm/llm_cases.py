"""Rows and helpers of the llm tests."""

import zlib

SF = "/root/testdata/sf0.001"


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


#: NULLs in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s", 35), (1, "alpha beta gamma delta epsilon zeta", "en", "s", 35),
    (2, "ALPHA beta gamma delta epsilon zeta", "en", None, 35), (3, None, "en", "s", None), (4, "", None, "s", 0), (5, " \n\t ", "fr", "s", 4),
    (None, "alpha beta gamma delta epsilon zeta", None, None, None), (6, "word", "en", "s", 4), (7, "word", "de", "s", 4),
    (8, "1234 !!! 5678 ???", "en", "s", 17), (9, "ein langer satz über " * 30_000, "de", "s", 630_000),
    (10, "token = \"0123456789abcdef0123456789abcdef01234567\" password=0123456789abcdef01 naïve 中文 😀", "en", "s", 80),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
