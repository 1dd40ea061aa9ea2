"""Small tables for the tests of the corpus operators: clashing columns, nulls, ties, repeats, long texts."""

import random
import re

SYLLABLES = "the ing er on an re ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
STOP = "the of and to in is that for with by".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, node string, score string, hash string, part string"


def sentence(rng, n):
    words = [rng.choice(STOP) if rng.random() < 0.4 else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


def frame(spark, rows):
    """Rows of (doc_id, text[, lang]) with columns whose names clash with the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, "x", "y", "z", "h", "p") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def edges(rng=None):
    rng = rng or random.Random(5)
    long = sentence(rng, 60_000)
    return [(None, "a null id with a few words of text"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (5, "word"),
            (6, long), (7, long), (8, "é 中文 🙂 \x00 ' ''s  two  spaces \n\n x "), (9, "no break and 　 wide")]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)
