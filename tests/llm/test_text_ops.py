"""Fill-in-the-middle, token files and collocations against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import io
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from heedstream.llm import collocations, fim, token_files

DOCS = "doc_id long, text string, lang string, n int, form string, start long, phrase string, a long"


def docs(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, g, 1, "clash", 2, "p", 3) for i, t, g in zip(ids, texts, langs, strict=True)], DOCS)


# 11


def fim_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text), out


@pytest.mark.parametrize("chunk", [5, 40, fim.CHUNK])
def test_fim(spark, chunk):
    rng = random.Random(5)
    texts = [None, "", "\n", "a", "a\n", "\n\n\n", "x<P>\ny", "<S\n>", "<\nS>\n<", "é中\nü\n" * 30, "no end" * 900]
    texts += ["".join(rng.choice(["a", "é", "\n", "<", "P", ">", "M", "中"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["line one\nline two\r\n" * 6000]
    ids = [*range(len(texts) - 3), None, 4, 4]
    got = sorted(map(tuple, fim.transform(docs(spark, texts, ids), chunk=chunk).collect()), key=str)
    assert got == sorted((fim_by_hand(i, t) for i, t in zip(ids, texts, strict=True)), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fim_edges(spark):
    assert fim.transform(docs(spark, [])).count() == 0
    same = docs(spark, ["a\nb\nc\n"] * 50, [1] * 50)
    rows = fim.transform(same, keep_text=False).collect()
    assert len(rows) == 50 and len(set(map(tuple, rows))) == 1
    assert {r["form"] for r in fim.transform(docs(spark, ["a\nb\n"] * 30), rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.transform(docs(spark, ["a\nb\n"] * 30), spm=100).collect()} == {"spm"}


def test_fim_restorer():
    """What is restored comes from the output: a damaged one is told, or gives another text."""
    for form, out in (("psm", b"<P>ab<S>ef<M>cd"), ("spm", b"<S>ef<P>ab<M>cd")):
        for size in (1, 2, 3, 100):
            own = fim.Restorer(form)
            parts = [x for k in range(0, len(out), size) for x in own.feed(out[k : k + size])] + list(own.rest())
            assert b"".join(data for _, data in sorted(parts, key=lambda x: x[0])) == b"abcdef"
        own = fim.Restorer(form)
        list(own.feed(out.replace(b"<M>", b"")))
        with pytest.raises(ValueError):
            list(own.rest())
        with pytest.raises(ValueError):
            list(fim.Restorer(form).feed(b"no sentinel " + out))


# 12


def byte_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_texts():
    rng = random.Random(7)
    alpha = [*"ab c\n  .,!'s\t\x1c \x85é中1２\x00<|　", " the", " It's", "\n\n", " \n", "<|endoftext|>", "'ll", " x.", "foo?!"]
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randrange(14))) for _ in range(400)]
    return [None, "", " ", "\n", "a  b", "word " * 30_000, "q" * 900, *texts]


@pytest.mark.parametrize("kept", [40, token_files.KEPT_WORDS])
def test_words_are_those_of_the_library(monkeypatch, kept):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "KEPT_WORDS", kept)
    library = Tokenizer.from_file(byte_path())
    own = token_files.Words(byte_path())
    texts = [t or "" for t in token_texts()]
    for size in (1, 7, 50):
        for at in range(0, len(texts), size):
            raw = [t.encode() for t in texts[at : at + size]]
            offsets = np.cumsum([0, *map(len, raw)])
            ids, each = own.texts(np.frombuffer(b"".join(raw), np.uint8), offsets)
            want = [library.encode(t, add_special_tokens=False).ids for t in texts[at : at + size]]
            assert [x.tolist() for x in np.split(ids, np.cumsum(each)[:-1])] == want
    assert len(own.hashes) <= max(kept, 400)


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 31])
def test_pack(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        data = token_files.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert (token_files.unpack(data, bits, n) == ids).all()
        assert (token_files.unpack(data, bits, n - n // 3, n // 3) == ids[n // 3 :]).all()
    with pytest.raises(ValueError):
        token_files.pack(np.array([1 << bits]), bits)


@pytest.mark.parametrize(("bits", "block"), [(16, 8), (11, 64), (17, 1000)])
def test_token_file(bits, block):
    rng = np.random.default_rng(1)
    own = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (1, 0, 700, 8, 1, 63, 129)]
    ids = [None, -5, 3, 3, 9, 10, 1 << 40]
    data = b"".join(token_files.file_bytes(ids, np.array([len(x) for x in own]), own, bits, block))
    file = token_files.TokenFile(io.BytesIO(data))
    flat = np.concatenate(own)
    assert [None if n else d for d, n in zip(file.doc_ids.tolist(), file.null, strict=True)] == ids
    assert all((file.document(k) == x).all() for k, x in enumerate(own))
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
        assert (file.ids(a, b) == flat[a:b]).all()
    with pytest.raises(ValueError):
        token_files.TokenFile(io.BytesIO(b"x" * 100))


@pytest.mark.parametrize("size", [2000, token_files.FILE_BYTES])
def test_token_files(spark, size):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_path())
    texts = token_texts()
    ids = [i * 7 % 1000 - 50 for i in range(len(texts))]
    ids[3], ids[20:60] = None, [17] * 40
    texts[21:30] = ["the same text"] * 9
    table = docs(spark, texts, ids).repartition(5)
    path = token_files.write(table, byte_path(), size=size, task_bytes=2 * size)
    got = token_files.read(spark, path).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in zip(ids, texts, strict=True)]
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in got) == Counter((i, tuple(x)) for i, x in want)
    order = lambda i: (i is not None, i or 0)
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert (r["start"], r["n_tokens"]) == (start, len(r["token_ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["token_ids"], "<u4").tobytes())
        start += r["n_tokens"]
    listed = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert listed == sorted(ids, key=order)
    names = {r["name"] for r in token_files.manifest(spark, path).collect()}
    if size == 2000:
        assert len(names) > 10
    folder = pathlib.Path(path.removeprefix("file:"))
    (folder / "ids-000000-00000-999999999.tok").write_bytes(b"left by an attempt that was lost")
    assert len(token_files.read(spark, path, keep_ids=False).collect()) == len(texts)


def test_token_files_empty(spark):
    assert token_files.read(spark, token_files.write(docs(spark, []), byte_path())).count() == 0


def test_running_sums_in_groups(spark, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 3)
    path = token_files.write(docs(spark, [f"word {i} " * 20 for i in range(200)]), byte_path(), task_bytes=2000)
    files = sorted(token_files.manifest(spark, path).collect(), key=lambda r: r["base"])
    assert len(files) > 9
    start = 0
    for r in files:
        assert r["base"] == start
        start += r["ids"]


# 13


def mine_by_hand(rows, least, most, share):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    out = []
    cand = {x: a for x, a in count.items() if len(x[1]) > 1 and a >= least}
    for (lang, p), a in cand.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in cand.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, total[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], r, *x[1:]) for r, x in enumerate(own[:most], 1)]
    return sorted(ranked)


def phrase_rows(rng):
    words = [f"w{k}" for k in range(12)] + ["É", "é", "中文", "\x00", "A"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "　"]
    rows = [("".join(x for _ in range(rng.randrange(60)) for x in (rng.choice(words), rng.choice(ends))), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    rows += [("New York City hall is in new york city", "en")] * 40 + [(None, "en"), ("", None), ("solo", "fr"), ("w1 " * 4000, "de")]
    return rows


@pytest.mark.parametrize(("least", "most", "block", "vocabulary"), [(30, 2000, collocations.BLOCK, collocations.VOCABULARY), (6, 25, 40, 5), (6, 2000, 300, 100), (3, 2000, collocations.BLOCK, collocations.VOCABULARY)])
def test_collocations(spark, least, most, block, vocabulary):
    rows = phrase_rows(random.Random(3))
    table = docs(spark, [t for t, _ in rows], langs=[g for _, g in rows]).repartition(3)
    got = sorted(map(tuple, collocations.mine(table, least=least, most=most, block=block, vocabulary=vocabulary).collect()))
    want = mine_by_hand(rows, least, most, 80)
    assert got == want and len(want) >= 8


def test_collocations_empty(spark):
    assert collocations.mine(docs(spark, [])).count() == 0
    assert collocations.mine(docs(spark, [None, "", "a b c"])).count() == 0


def test_scores_past_64_bits(spark):
    big = 6_000_000_000_000
    rows = [("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 7)]
    r = collocations.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, a long")).first()
    assert r["score"] == 2_000_000 * (big - 7) // (2 * big + 1)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_trie(depth):
    rng = random.Random(depth)
    words = [f"x{k}" for k in range(200)]
    langs, phrases = zip(*{(rng.choice("ab"), tuple(rng.choices(words, weights=[1 / (k + 1) for k in range(200)], k=depth))) for _ in range(3000)}, strict=True)
    code = {"a": -7, "b": 5, "c": 6}
    trie = collocations.Trie(np.arange(len(phrases)) * 3 - 100, np.array([code[x] for x in langs]), collocations.hashes_of([w for p in phrases for w in p]).reshape(len(phrases), depth))
    text = rng.choices([*words, "unknown"], k=5000)
    follows = np.array([rng.random() < 0.9 for _ in text[:-1]] + [False])
    for lang in "abc":
        found, after = trie.walk(np.full(len(text), code[lang]), collocations.hashes_of(text), follows)
        number = {x: k for k, x in enumerate(zip(langs, phrases, strict=True))}
        want = [number.get((lang, tuple(text[i : i + depth])), -1) if follows[i : i + depth - 1].all() and i + depth <= len(text) else -1 for i in range(len(text))]
        assert found.tolist() == want
        assert sorted(after.tolist()) == [i for i, x in enumerate(want) if x >= 0 and follows[i + depth - 1]]
