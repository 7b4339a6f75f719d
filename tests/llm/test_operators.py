"""Operators beside brute force or exact round trips, on small fixtures with nulls, empties, repeated rows and clashing columns."""

import collections
import hashlib
import re
import textwrap
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rippleset.llm import chat_format, decontaminate, license_digests, license_scan, ngram_join, piece_tokens, queries, secret_scan, suffix_dedup, token_counts, toxicity, voronoi_topk
from tests.parity import both, connect

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, token string, id string, n int, spans string"


def docs(spark, texts):
    """Rows (id, text) with columns of names that operators use inside."""
    return spark.createDataFrame([(i, t, None, "x", None, 1, "s") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    (columns, got), (names, expected) = both(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
    assert (columns, got) == (names, expected) and got


def removed(texts, length):
    """Kept bytes and number of runs by counting every string."""
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append((np.frombuffer(b, np.uint8)[~gone].tobytes(), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())))
    return out


@pytest.mark.parametrize("few", [0, 1000])
def test_suffix_dedup(spark, few):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared = word(90)
    texts = [None, "", "short", "a" * 300, word(50) + shared + word(40), shared[20:] + word(60), word(30) + shared + word(9) + shared, word(200)]
    texts += [texts[4], texts[4][:100] + "X" + texts[4][101:]]
    given = list(enumerate(texts)) + [(4, texts[4]), (None, texts[5])]
    got = suffix_dedup.remove_repeats(docs(spark, given), length=40, gram=10, few=few).collect()
    want = removed([t for _, t in given], 40)
    assert sorted((str(r["doc_id"]), bytes(r["kept"]), len(r["spans"])) for r in got) == sorted((str(i), kept, n) for (i, _), (kept, n) in zip(given, want, strict=True))
    assert suffix_dedup.remove_repeats(docs(spark, []), length=40, gram=10).count() == 0


def test_suffix_blocks(monkeypatch):
    text = np.random.default_rng(1).integers(0, 3, 5000).astype(np.uint8).tobytes()
    whole = suffix_dedup._samples(text, 40, 10)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    assert all((a == b).all() for a, b in zip(whole, suffix_dedup._samples(text, 40, 10), strict=True))


def test_pieces(spark, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [None, "", " ", "  a\n\n b", "▁x ▁", "中é😀\u0000", "a" * 400, "    " * 9, "<s></s><0x41>"] + [t for _, t in rows]
    got = piece_tokens.encode_decode(docs(spark, list(enumerate(texts))), PIECES).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == want
        assert r["decoded"] == (library.decode(want) if want else "")


def test_decontaminate(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "a b c d e"), (2, "X, y"), (3, None), (4, "!!"), (5, "b c d"), (None, "é1 z")], "item_id int, text string")
    texts = ["q a B c. d e q", "x-y x y", None, "", "!", "b c", "é1 Z é1 z", "a b c d b c d", "y x y " * 50]
    for limit in (1 << 21, 4):  # one pass, several passes
        monkeypatch.setattr(decontaminate, "MAX_PHRASE_WORDS", limit)
        for r in decontaminate.find_phrases(docs(spark, list(enumerate(texts))), bench, window=3).collect():
            low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]] or "")
            words = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
            hit, items = [False] * len(words), set()
            for item, phrase in (("1", "a b c"), ("1", "b c d"), ("1", "c d e"), ("2", "x y"), ("5", "b c d"), ("", "é1 z")):
                phrase = phrase.split()
                for p in range(len(words) - len(phrase) + 1):
                    if [low[a:b] for a, b in words[p : p + len(phrase)]] == phrase:
                        items.add(item)
                        hit[p : p + len(phrase)] = [True] * len(phrase)
            assert (r["n_words"], r["n_hit"], r["hit_items"]) == (len(words), sum(hit), sorted(items)), texts[r["doc_id"]]
    clean = {r["doc_id"]: r["text"] for r in decontaminate.without_phrases(docs(spark, list(enumerate(texts))), bench, window=3).collect()}
    assert clean[0] == "q  q" and clean[2] is None and clean[5] == "b c"
    assert decontaminate.find_phrases(docs(spark, []), bench).count() == 0
    assert decontaminate.find_phrases(docs(spark, [(1, "a b c")]), bench.limit(0)).first()["n_hit"] == 0


def test_ngram_join(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    passage = [f"p{x}" for x in range(60)]
    texts = [None, "", "one two", "ONE two", "a b c d e", "a b c d e"]
    for k in range(30):
        near = list(base)
        for at in rng.integers(0, 120, k % 4):
            near[at] = f"e{k}"
        texts.append(" ".join(near))
        texts.append(" ".join([f"u{k}_{j}" for j in range(90)] + passage))
    given = list(enumerate(texts)) + [(7, texts[7])]
    sets = {}
    for i, t in given:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        moved = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and label[b] < label[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a], moved = label[b], True
        if not moved:
            break
    for few in (0, 1000):
        got = ngram_join.near_classes(docs(spark, given + [(None, "a b c d e")]), few=few).collect()
        assert len(got) == len(given) + 1
        assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]]) for r in got if r["doc_id"] is not None)
    kept = {r["doc_id"] for r in ngram_join.one_of_each(docs(spark, given)).collect()}
    assert kept == set(label.values())


@pytest.mark.parametrize("block", [256, 3])
def test_ngram_links(spark, monkeypatch, block):
    """Every document's number of links, in groups of near and of equal copies, beside brute force."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rng = np.random.default_rng(8)
    texts = [None, "", "one two", "ONE two", "one  two", "a b c d e", "a b c d e"]
    for group in range(3):
        base = [f"g{group}_{x}" for x in range(100)]
        for k in range(20):
            near = list(base)
            for at in rng.integers(0, 100, k % 5):
                near[at] = f"e{group}_{k}"
            texts.append(" ".join(near))
    given = list(enumerate(texts)) + [(9, texts[9])]
    sets = {}
    for i, t in given:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    want = {a: sum(bool(a != b and sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for b in sets) for a in sets}
    assert len(set(want.values())) > 5
    got = ngram_join.near_classes(docs(spark, given + [(None, "a b c d e")]), count_links=True).collect()
    assert len(got) == len(given) + 1 and all(r["n_links"] == want.get(r["doc_id"], 0) for r in got)


def test_one_row_of_each(spark):
    text = "a b c d e f g h"
    given = [(1, text), (1, text), (1, text), (2, text), (3, "q r s"), (3, "t u v"), (3, "t u v"), (None, text), (None, text), (4, None), (4, None)]
    got = ngram_join.one_of_each(docs(spark, given)).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(i), str(t)) for i, t in ((1, text), (3, "q r s"), (3, "t u v"), (None, text), (None, text), (4, None)))


def test_texts_of_one_id(spark):
    """A text that shares its id with a copy of another document stays."""
    a, b = "a b c d e f g h", "other words of a text like nothing else here"
    got = ngram_join.one_of_each(docs(spark, [(1, a), (3, a), (3, b)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (3, b)]


def test_only_members_link(spark):
    """Classes that meet in members only: a chain of texts, each like the next one alone."""
    words, texts = [f"w{i}" for i in range(400)], []
    for k in range(12):
        texts.append(" ".join(words[8 * k : 8 * k + 100]))  # a step of 8: 88 words shared with the next, 80 with the one after it
    order = np.random.default_rng(4).permutation(len(texts))
    given = [(int(i), texts[k]) for i, k in enumerate(order)] + [(50 + i, texts[k]) for i, k in enumerate(order[:3])]
    got = ngram_join.near_classes(docs(spark, given)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_registered_ngram_join(spark):
    """The registered query beside union-find over all shared shingles of the smallest table."""
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sets, holders, shared = {}, collections.defaultdict(list), collections.Counter()
    for i, t in rows:
        w = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            holders[s].append(i)
    for of in holders.values():
        shared.update((a, b) for a in of for b in of if a < b)
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    got = queries.QUERIES["op9_ngram_join"](spark, SF)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == {i: (len(sets[i]), root(i)) for i in sets}


def test_ngram_join_empty(spark):
    assert ngram_join.near_classes(docs(spark, [])).count() == 0


def test_secrets(spark):
    key = "Zq8XvR2mK9tLw4Yp7NcB3sHd6JfG"
    texts = [None, "", 'é token = "abcdefghijkl" x', "password=short", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "token=password: abcdefghijklmnop", f"say {key} now", "extraordinarilyplainidentifier"] + ["an ordinary sentence of words without much"] * 60 + [f"secret={hashlib.sha256(str(k).encode()).hexdigest()[:20]}{key[k % 20:]}" for k in range(40)]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[2]) >= 12]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{16,}", text or "")]
        assert [(s["start"], s["kind"], s["end"]) for s in got[i] if s["kind"] < 3] == sorted(base)
    assert [(s["start"], s["end"]) for s in got[7]] == [(4, 4 + len(key))] and not got[8]
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs(spark, list(enumerate(texts)))).collect()}
    assert clean[2] == "é [SECRET]\" x" and clean[7] == "say [SECRET] now" and clean[0] is None and clean[3] == texts[3]
    assert secret_scan.scan(docs(spark, [])).count() == 0


def test_chat_format(spark):
    turns = [(1, 0, "user", r"a <| b <\| c <\\|x"), (1, 1, "user", "z<"), (1, 2, "assistant", "|turn|>"), (1, 2, "assistant", None), (1, 700, "assistant", "r<|end|>"), (None, None, None, "q")]
    given = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, runs string")
    out = chat_format.format_conversations(given).withColumn("back", chat_format.read_back(F.col("formatted")))
    back = {r[0]: [(t["role"], t["text"]) for t in r[1]] for r in out.select("conv_id", F.transform("back", lambda t: F.struct(chat_format.unescape(t["role"]).alias("role"), chat_format.unescape(t["text"]).alias("text")))).collect()}
    assert back == {None: [("", "q")], 1: [("user", r"a <| b <\| c <\\|x"), ("user", "z<"), ("assistant", ""), ("assistant", "|turn|>"), ("assistant", "r<|end|>")]}
    assert chat_format.format_conversations(given.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(int(i), rng.integers(-50, 50, 4).tolist()) for i in range(400)] + [(i, [7, 7, 7, 7]) for i in range(400, 600)] + [(600, None), (601, []), (602, [1, 2]), (100, [1, 1, 1, 1])]
    given = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, vector array<long>, score string")
    got = voronoi_topk.top_k(given, F.col("vec_id") % 100 == 0, k=5, pivots=8)
    have = collections.defaultdict(list)
    for r in got.collect():
        have[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for i, v in vectors:
        if i % 100 == 0 and v and i != 100:
            best = sorted((-int(np.dot(v, w)), j) for j, w in vectors if w and len(w) == len(v) and j != i)[:5]
            assert sorted(have[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert voronoi_topk.top_k(given.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_license(spark):
    known = license_scan.known_digests(spark)
    mit = next(t for x, t in license_scan.KNOWN if x == "MIT" and "\n" in t)
    texts = [None, "", "Copyright 2020 Someone\n" + mit.upper().replace(",", " ;"), "x\nreleased under the MIT Licence\ny", "Released under the MIT License", "(c) only"]
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in license_scan.license_scan(docs(spark, list(enumerate(texts))), known).collect()}
    assert got == {0: (None, []), 1: (None, []), 2: ("MIT", []), 3: (None, ["MIT"]), 4: ("MIT", ["MIT"]), 5: (None, [])}


def test_license_texts(spark):
    """Every known text is found wrapped at any width, unwrapped, with and without a title; sentences that begin a line with the word stay."""
    wrap = lambda text, n: "\n\n".join(p if re.search(r"(?m)^\W*Copyright \W*(\([Cc]\)|\[|\d)", p) else textwrap.fill(" ".join(p.split()), n) for p in re.split(r"\n[ \t]*\n", text))
    texts, want = [], []
    for name, text in (*license_scan.KNOWN, *license_scan.MORE):
        if "\n" in text:
            for title in ("", *(f"{t}\n\n" for t in license_scan.TITLES[name])):
                texts += [f"{title}Copyright (c) 2020, Some One <a@b.c>\nAll rights reserved.\n\n{wrap(text, n)}" for n in (*range(40, 100, 3), 10**6)]
            want += [name] * (len(texts) - len(want))
    for file, name, titles in license_digests.FILES:
        path = Path("/usr/share/common-licenses", file)
        if path.exists():
            text = path.read_text()
            texts += [*license_scan.full_forms(text, titles), *(wrap(text, n) for n in (40, 57, 72, 99))]
            want += [name] * (len(texts) - len(want))
    got = {r["doc_id"]: r["license"] for r in license_scan.license_scan(docs(spark, list(enumerate(texts))), license_scan.known_digests(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    changed = [(0, "x\ncopyright notice and y\nz"), (1, "x\nand y\nz"), (2, "x\n(c) You must keep it\nz"), (3, "x\nz"), (4, "x\nCopyright Some One\n(c) 1999 A\n\u00a9 B\nCOPYRIGHT [yyyy] C\nz")]
    digest = {r["doc_id"]: r["digest"] for r in license_scan.license_scan(docs(spark, changed), license_scan.known_digests(spark)).collect()}
    assert digest[4] == digest[3] and len({digest[i] for i in range(4)}) == 4


def test_token_counts(spark, rows, tmp_path):
    tokens = [3, 9, 9, 1, 1, 1, 1, 1, 9, 2]
    for name, ids in (("a", tokens), ("b", []), ("c", [9]), ("d", [5] * 7)):
        (tmp_path / name).write_bytes(np.array(ids, np.uint16).tobytes())
    files = spark.createDataFrame([(str(tmp_path / n), (tmp_path / n).stat().st_size) for n in "abcd"], "path string, n_bytes long")
    got = sorted((r["path"][-1], r["document"], r["n_tokens"], r["closed"]) for r in token_counts.scan_blocks(files, 9, block=2).collect())
    assert got == [("a", 0, 1, True), ("a", 1, 0, True), ("a", 2, 5, True), ("a", 3, 1, False), ("c", 0, 0, True), ("d", 0, 7, False)]
    encoder = token_counts._encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    counted = {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op6_token_counts"](spark, SF).collect()}
    assert counted == {i: len(encoder.encode_ordinary(t or "")) for i, t in rows}


def test_toxicity(spark):
    texts = [(i, f"you are a {'worthless loser' if i % 4 == 0 else 'good friend'} number{i % 7} and more words") for i in range(400)] + [(400, None), (401, "")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i in range(0, 400, 3)] + [(1, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs(spark, texts), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, texts), model).collect()}
    assert min(got[i] for i in range(0, 400, 4)) >= 0.7 > max(got[i] for i in range(400) if i % 4)
    assert got[400] == got[401] < 0.7
    none = toxicity.fit(docs(spark, texts), labels.limit(0))
    assert toxicity.score(docs(spark, texts), none).where("score > 0.01").count() == 0


def test_toxicity_held_out(spark):
    out = queries.QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    toxic = [r["predicted"] for r in out if r["toxic"]]
    clean = [r["predicted"] for r in out if not r["toxic"]]
    assert sum(toxic) >= 0.75 * len(toxic) and sum(clean) <= 0.1 * len(clean)


def test_toxicity_keeps_clean(spark):
    sf_dir = "/root/testdata/sf0.1"
    out = queries.QUERIES["op2_toxicity"](spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    toxic, clean = ([r["predicted"] for r in out if r["toxic"] == kind] for kind in (1, 0))
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_word_hashes(monkeypatch):
    """Words split at ASCII white space only and letters A-Z in either case are alike, whatever the blocks."""
    from rippleset.llm import ngram_join as nj

    text = "Ab ab\x0bAB\x1cb Äb c  ba a b \t\r\n " + "x" * 50
    words = text.encode().lower().split()
    whole = nj.word_hashes(text.encode())
    assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words))
    assert whole[0] == whole[1] and not len(nj.word_hashes(b" \t ")) and not len(nj.word_hashes(b""))
    monkeypatch.setattr(nj, "BLOCK", 5)
    assert (nj.word_hashes(text.encode()) == whole).all()


def test_ngram_crowd(spark, monkeypatch):
    """A group of near copies, a third of them too far from all others: the same classes as brute force, from few pairs."""
    rng = np.random.default_rng(12)
    base = [f"b{x}" for x in range(150)]
    texts = []
    for k in range(200):
        near = list(base)
        for at in rng.integers(0, 150, int(rng.choice([0, 1, 2, 3, 6, 8]))):
            near[at] = f"e{rng.integers(0, 9)}"
        texts.append(" ".join(near[: 150 - k % 3]))
    given = list(enumerate(texts)) + [(200, texts[9]), (201, texts[11] + " end of it"), (201, "other words of one id that stand here")]
    sets = {i: {tuple(w[p : p + 5]) for p in range(len(w) - 4)} for i, t in given[:201] for w in [t.split()]}
    label = {i: i for i in sets}
    while True:
        best = {a: min(label[b] for b in sets if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])) for a in sets}
        if best == label:
            break
        label = best
    assert 20 < len(set(label.values())) < 150
    asked, verified = [], ngram_join.verified

    def counted(docs, sizes, pairs, *rest):
        out = verified(docs, sizes, pairs, *rest)
        asked.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "verified", counted)
    got = ngram_join.near_classes(docs(spark, given)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] != 201} == label
    assert sum(asked) < 3000 and len(asked) == 3  # of 19,900 pairs


def test_ngram_batches(spark, monkeypatch):
    """Python gets no more than a few hundred rows at once, and the session's own setting is back afterwards."""
    key, seen, before = "spark.sql.execution.arrow.maxRecordsPerBatch", [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(ngram_join, "shared_prefixes", lambda *args, of=ngram_join.shared_prefixes: seen.append(spark.conf.get(key)) or of(*args))
    assert ngram_join.near_classes(docs(spark, [(1, "a b c d e")])).count() == 1
    assert seen == ["256"] and spark.conf.get(key) == before
