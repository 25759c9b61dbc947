"""Small tables with the awkward cases every operator has to take."""

import random

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, w string, ids string, v string, keys string, tk string, score string, item_id string, line_no string, kept string"

SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]


def prose(rng, n, lines=True):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    return "".join(w + ("\n" if lines and rng.random() < 0.05 else " ") for w in words).strip()


def rows(seed=5, n=40):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(15, 120)) for _ in range(n)]
    out = [(i, t, rng.choice(["en", "de", None]), "s", len(t)) for i, t in enumerate(texts)]
    out.append((100, texts[0], "en", "s", 1))                        # exact copy
    out.append((101, texts[1].replace(" ", "  ", 3), "en", None, None))
    out.append((102, None, None, None, None))
    out.append((103, "", "en", "s", 0))
    out.append((104, " \n\t \x0b\x0c\r", "de", "s", 0))
    out.append((105, "12 34 !! ...", "de", "s", 3))
    out.append((106, prose(rng, 30000), "en", "s", 9))               # very long
    out.append((107, "x" * 30000, "en", "s", 9))                     # one very long word
    out.append((108, texts[2], "en", "s", 9))
    out.append((108, texts[2], "en", "s", 9))                        # repeated row
    out.append((109, texts[3] + "\nsame id, other text one two three four five six seven", "en", "s", 9))
    out.append((109, texts[4], "de", "s", 9))                        # repeated id, other text
    out.append((None, texts[5], "en", "s", 9))
    out.append((None, "only here " + prose(rng, 30), None, "s", 9))
    return out


def frame(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(*r, *["clash"] * 10) for r in data], COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def texts_of(data):
    return [(r[0], r[1]) for r in data]
