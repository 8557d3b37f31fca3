"""Spelling variants against a plain loop over all edits of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from fixturelake.llm import variants
from fixturelake.llm.common import Tables

SCHEMA = "doc_id long, text string, lang string, n long, word string, form string, m int"


def plain(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return resolved({w: k for w, k in n.items() if len(w) >= 5 and k >= 3})


def resolved(n):
    letters = {c for w in n for c in w}
    form, near = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = {e for e in edits if e in n} - {w}
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), k, len(near[w]), n.get(form[w]) or 0) for w, k in n.items())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "w", "f", 2) for i, t in rows], SCHEMA).repartition(3)


def got(spark, rows, **more):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in variants.spelling_variants(frame(spark, rows), **more).collect())


def crowd(rng, n, letters, low, high):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


@pytest.mark.parametrize("block", [2000, 3])
def test_variants_of_a_corpus(spark, monkeypatch, block):
    monkeypatch.setattr(variants, "HELD", 40)
    rng = random.Random(8)
    words = crowd(rng, 150, "abc", 4, 9) + crowd(rng, 40, "éaÿ×B", 5, 7) + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "ababababa"]
    rows = [(k, rng.choice([" ", "-", "\n", "1", "Ā"]).join(rng.choices(words, weights=[1 + i % 17 for i in range(len(words))], k=120))) for k in range(60)]
    rows += [(None, "Abcabc abcabc"), (5, None), (6, ""), (7, " 12 "), (8, "Straße STRASSE Éaéaé éaéaé " * 5), (9, rows[0][1]), (9, rows[0][1]), (10, "zzzzzz" * 60 + " " + "zzzzzz" * 60 + "z ")]
    rows += [rows[-1]] * 3
    want = plain(rows)
    assert got(spark, rows, block=block) == want
    assert sum(bool(r[1]) for r in want) > 20


def test_slices_end_between_runs(monkeypatch):
    text = " ".join(crowd(random.Random(1), 200, "aBÀÿ×-1", 1, 30)) + "x" * 100
    whole = [r for part in variants.runs(text) for r in part]
    for size in (1, 7, 64):
        monkeypatch.setattr(variants, "SLICE", size)
        assert [r for part in variants.runs(text) for r in part] == whole


def test_chain_of_forms(spark):
    chain = ["abcde", "abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    rows = [(k, " ".join([w] * (3 << k))) for k, w in enumerate(chain)]
    assert got(spark, rows) == plain(rows)
    assert all(r[2] == chain[-1] for r in got(spark, rows))


def test_one_crowded_stem_is_cut(spark):
    """A third of all words share their beginning: blocks are cut again and again, and each pair still counts once."""
    rng = random.Random(2)
    words = {("international" + "".join(rng.choice("abcd") for _ in range(rng.randint(3, 6)))): rng.randint(3, 40) for _ in range(600)}
    words |= {w: rng.randint(3, 40) for w in crowd(rng, 900, "xyzw", 5, 7)}
    tables = Tables(spark)
    table = tables.write(spark.createDataFrame(list(words.items()), "word string, n long"), "words")
    near = {r.word: (r.n_near, r.best) for r in variants.near_words(table, tables, block=20).collect()}
    tables.drop()
    want = {}
    for w, *_ in resolved(words):
        close = [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)]
        if close:
            want[w] = (len(close), min(close, key=lambda x: (-words[x], x)))
    assert near == want


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def test_no_words(spark):
    assert got(spark, []) == [] and got(spark, [(1, None), (2, "a b c")]) == []
