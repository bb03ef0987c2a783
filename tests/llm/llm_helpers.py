import re
import string


def lower(text):
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


#: Rows with every awkward case: nulls, blanks, ties, repeats, and columns whose names clash with the operators' own.
CASES = [
    (1, "The quick brown fox jumps\nover the lazy dog today\nshort"), (2, "the quick brown fox jumps  \nother words here now"), (3, None), (4, ""), (5, " \t\n\x0b "),
    (6, "The quick brown fox jumps\nover the lazy dog today\nshort"), (7, "a b"), (8, "a b"), (9, "Ünï cödé TEXT Ä b c d e f g h"), (None, "over the lazy dog today"), (10, "word " * 3000 + "end."),
]
