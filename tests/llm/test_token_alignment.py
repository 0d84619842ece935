"""Alignment of two tokenizers against both libraries and a plain count of all links."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest

from echolith.llm import token_alignment as align
from echolith.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, pair string, n_a int, __x string"
DIR = "/root/testdata/sf0.001"
R = random.Random(3)
WORDS = ["".join(R.choice("abcdefgäßéñ") for _ in range(R.randint(1, 9))) for _ in range(60)]
TEXTS = [
    None, "", " ", "   ", "\n", "a", "a ", " a", "  a  b ", "a\n b\t c\r\nd", "it's 12,5% & <|endoftext|> </s> <unk> <0x41>", "日本語 ΑΣ 😀 é é", "▁ low ▁line", "nbsp\xa0 here\x1c there", "x" * 5000,
    "\x00 null", "mixed WORDS  of 12345 numbers!!! ... and\n\n\nlines", " ".join(R.choice(WORDS) for _ in range(4000)), "".join(R.choice("0123456789abcdef") for _ in range(3000)), "same text here", "same text here",
]


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as p

    return align.Tokenizers(p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))


def plain(rows):
    """Every link of every text, by sets and loops."""
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    s = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    letters = align.byte_letters()
    found = []
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = s.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in t.id_to_token(k)) for k in a]
        b_bytes = [bytes([int(s.id_to_piece(k)[3:5], 16)]) if s.is_byte(k) else s.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            a, b, a_bytes, b_bytes = [], [], [], []
        a_ends, b_ends = (np.cumsum([len(x) for x in y]).tolist() for y in (a_bytes, b_bytes))
        cuts = sorted(set(a_ends) & set(b_ends))
        a_at, b_at = ({0: 0} | {e: k for k, e in enumerate(ends, 1)} for ends in (a_ends, b_ends))
        grouped = [(a[a_at[low] : a_at[high]], b[b_at[low] : b_at[high]]) for low, high in zip([0, *cuts], cuts, strict=False)]
        found.append((doc_id, a, b, grouped, [(x, y) for g in grouped for x in g[0] for y in g[1]]))
    n = Counter(pair for f in found for pair in set(f[4]))
    top: dict = {}
    for (x, _), k in n.items():
        top[x] = max(top.get(x, 0), k)
    for doc_id, a, b, grouped, links in found:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in grouped)
        yield doc_id, len(a), len(b), len(grouped), len(links), sum(n[k] == top[k[0]] for k in links), sum(n[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if said else ""


@pytest.mark.parametrize("hot, part", [(1 << 20, 1 << 22), (0, 50), (40, 3)])
def test_every_link(spark, tokenizers, monkeypatch, hot, part):
    """Broadcast pairs, joined pairs and texts in many parts give the same, which is all links counted plainly."""
    monkeypatch.setattr(align.pairs, "__defaults__", (part,))
    rows = [(k, x, None, "p", 1, "x") for k, x in enumerate(TEXTS)] + [(None, "same text here", "en", None, None, None), (4, TEXTS[4], None, None, None, None), (4, TEXTS[4], None, None, None, None)]
    got = align.alignments(spark.createDataFrame(rows, SCHEMA).repartition(3), tokenizers, hot=hot)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain([(r[0], r[1]) for r in rows]), key=str)


def test_no_rows(spark, tokenizers):
    assert align.alignments(spark.createDataFrame([], SCHEMA), tokenizers).collect() == []


def test_parts_are_encoded_like_whole_texts(tokenizers):
    """Random mixtures of blanks, marks and letters: the parts' ids are the whole text's."""
    t = tokenizers.open()
    r = random.Random(1)
    texts = ["".join(r.choice([" ", " ", "  ", "\n", "\t", "\xa0", "\x1c", "a", "The", "é", "!", "1", "'s", "▁", "😀", "　"]) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    for text, (a, b) in zip(texts, t.encode(texts), strict=True):
        whole = t.a.encode_ordinary(" " + text), t.b.encode(text)
        kept = "▁" not in text
        assert (a.tolist(), b.tolist()) == (whole if kept else ([], [])), repr(text)


def test_groups_by_sets():
    """Bisections find the offsets at which both end, for random cuts of the same bytes."""
    r = np.random.default_rng(0)
    for _ in range(300):
        n = int(r.integers(1, 40))
        a, b = (np.unique(np.append(r.choice(np.arange(1, n + 1), int(r.integers(0, n))), n)) for _ in range(2))
        first, last = align.overlaps(a, b)
        begins = np.concatenate([[0], a[:-1]])
        b_begins = np.concatenate([[0], b[:-1]])
        for k in range(len(a)):
            assert [j for j in range(len(b)) if b_begins[j] < a[k] and b[j] > begins[k]] == list(range(first[k], last[k] + 1))
        cuts = align.groups(a, b)
        assert a[cuts[0] - 1].tolist() == b[cuts[1] - 1].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_one_large_group_in_parts():
    """A group of many ids: merged, dealt into parts, and no pair in two of them."""
    a, b = np.array([5, 7, 5, 9, 11, 5]), np.array([1, 2, 1, 1])
    whole = dict(zip(*(x.tolist() for x in next(align.pairs(a, b, np.array([6]), np.array([4])))), strict=True))
    parts = [list(zip(*(x.tolist() for x in p), strict=True)) for p in align.pairs(a, b, np.array([6]), np.array([4]), 2)]
    assert len(parts) > 1 and dict(x for p in parts for x in p) == whole and sum(map(len, parts)) == len(whole)
    assert whole == {x << 32 | y: n for (x, y), n in Counter((x, y) for x in a.tolist() for y in b.tolist()).items()}


def test_vocabulary_is_the_file(tokenizers):
    """Ranks built from the file of merges are all its entries but the special ones."""
    import public_tokenizers as p

    with open(p.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = json.load(f)
    assert sorted(tokenizers.ranks.values()) == sorted(k for w, k in model["model"]["vocab"].items() if w not in {t["content"] for t in model["added_tokens"]})


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("op12_")])
def test_whole_table(spark, name):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES[name](spark, DIR).collect())) == sorted(plain(rows))
