"""Small fixtures with the awkward rows that every operator must take."""

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return WORD.findall(low(text))


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "béta", "gamma", "Delta", "épsilon", "zeta", "eta", "theta", "42", "iota", "kappa", "lambda", "mu", "Nu"]) + rng.choice(["", "", "s", "x", "ing"]) for _ in range(n))


def documents(seed=1):
    """(doc_id, text, lang, source, n_chars): copies, near copies, null and empty texts, null ids, a long text, repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 8, 40, 120, 300])) for _ in range(40)]
    texts = base + [base[7]] * 4 + [base[8].upper()] * 2
    for i in range(6):
        w = base[12 + i].split()
        w[len(w) // 2] = f"changed{i}"
        texts.append(" ".join(w))
    texts += [None, None, "", "", "...!?", "one", "One", prose(rng, 20000), "日本語 テキスト", "ÀÉ àé " * 30]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base[7], None, None, None), (None, "lonely row without an id here", None, None, None), rows[3], rows[3]]
    return rows
