"""Spelling groups beside brute force over wildcards, with small cells, crowded cells and odd rows."""

import collections
import re
import zlib

import numpy as np
import pytest

from rippleset.llm import spelling_groups

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    """Words and their counts, by plain loops."""
    count = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                count[word] += 1
    return {w: n for w, n in count.items() if n >= 2}


def grouped(count):
    """Rows by shared wildcards and deletions."""
    near, shapes = collections.defaultdict(set), collections.defaultdict(set)
    for w in count:
        for i in range(len(w)):
            shapes[w[:i] + "*" + w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in count:
                near[w].add(x)
                near[x].add(w)
    for of in shapes.values():
        for w in of:
            near[w] |= of - {w}
    best = {w: min(near[w], key=lambda x: (-count[x], x)) for w in count if near[w]}
    form = {w: b for w, b in best.items() if count[b] >= 10 * count[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), count[form[w]] if w in form else -1) for w, n in count.items())


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def test_registered(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(spelling_groups.op12_spelling_groups(spark, SF)) == grouped(counted(rows))


def test_texts(spark):
    rows = [(1, None), (2, ""), (3, "Ångström ångström ÅNGSTRÖM 12 spelling"), (3, "spelling spelling"), (None, "spelling spellings Spelling"), (4, "spelling " * 5000), (5, "x" * 200_000), (6, "x" * 200_000)]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id long, text string, word string, run string, n int")
    words = spelling_groups.with_typos(df).groupBy("word").count()
    assert {r[0]: r[1] for r in words.collect() if r[1] >= 2} == counted(rows)
    assert spelling_groups.with_typos(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [50_000, 40])
def test_cells(spark, cell):
    rng = np.random.default_rng(1)
    base = ["".join(rng.choice(list("abcé"), int(n))) for n in rng.integers(6, 10, 120)]
    words = set(base) | {"".join(rng.permutation(list("aabbccdd"))) for _ in range(150)}  # a crowd of equal counts
    for w in base:
        i = int(rng.integers(0, len(w)))
        words |= {w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "ÿ" + w[i + 1 :]}
    count = {w: int(10 ** rng.integers(0, 5)) + int(rng.integers(0, 3)) for w in sorted(words)}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    assert found(spelling_groups.spelling_groups(df, cell=cell)) == grouped(count)


def test_empty(spark):
    assert spelling_groups.spelling_groups(spark.createDataFrame([], "word string, n long")).collect() == []


def test_cuts_of_one_letter():
    """A letter cut twice on a way counts once: no cell within reach is missed."""
    tree = [4, 2, [4, 0, [], []], []]
    counts = np.zeros((3, spelling_groups.LETTERS), np.int16)
    counts[:, 4] = [2, 3, 0]
    rows, cells = spelling_groups.touched(tree, counts, 2)
    assert sorted(zip(rows.tolist(), cells.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 0), (2, 1)]
