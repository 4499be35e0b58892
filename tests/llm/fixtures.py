"""Awkward documents, and plain Python forms of the words contract."""

import random
import re

SPACE = " \t\n\x0b\f\r"
#: Columns whose names the operators might use inside.
EXTRA = "d long, t long, x string, g long, node long, n long, c long, k long, shard int, kept boolean, key string, hits int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '.', ',', 'É'])}" for _ in range(n))


def awkward_texts(seed=1):
    """(doc_id, text) with nulls, blanks, repeats, shared passages, near copies, ties and a very long text."""
    rng = random.Random(seed)
    line = "This very line is shared by Many documents of the corpus"
    passage = prose(rng, 60)
    base = prose(rng, 150)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (6, "Two words"), (None, "two WORDS"), (7, "ß\u00a0É\u2003x \x1f y")]
    rows += [(10 + i, f"{prose(rng, 20)}\n  {line.upper() if i % 2 else line}\t\n{prose(rng, 20)}\n{line}") for i in range(7)]
    rows += [(30 + i, f"{prose(rng, 40)} {passage}\n{prose(rng, 30)}") for i in range(4)]
    rows += [(40 + i, base) for i in range(6)] + [(44, base)]
    for i in range(12):
        w = base.split(" ")
        for _ in range(i // 2 + 1):
            w[rng.randrange(len(w))] = f"changed{rng.randrange(10)}"
        rows.append((50 + i, " ".join(w)))
    rows.append((70, prose(rng, 60_000, 50_000)))
    rows.append((71, "again " * 5_000))
    rows.append((72, "nobreak" * 20_000))
    rows += [(80, base), (80, "other text with the same id as another one"), (90, "\n" * 50)]
    return rows


def documents(spark, rows):
    full = [(i, t, "en" if (i or 0) % 2 else None, "web", None, *([None] * 12)) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def components(nodes, links):
    """Smallest reachable index of each of range(nodes)."""
    root = list(range(nodes))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(nodes)]
