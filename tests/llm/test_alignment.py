"""Token alignment against a plain version on whole texts."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenurekit.llm import alignment

SPEC = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
MODEL = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "a", " a", "a ", "a\n b  c\n\n", "\t x", "<|endoftext|> a <s> b </s>", "▁ a", "日本語 テキスト 😀😀", "\x00 a", "é" * 300, "y" * 5000, "ﬁ ﬂ", "  two  spaces  in   runs ", "x\x1c y",
    "\r\n a\r\n", "٠١٢ ꟲ 𞓰", "don't I'll we've", " ".join(f"w{i % 97}x{i % 31}" for i in range(4000)),
]


def _plain(texts):
    first, second = Tokenizer.from_str(SPEC), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    first.encode_special_tokens = True
    alphabet = alignment.byte_level_bytes()
    groups = []
    for text in texts:
        whole = b" " + (text or "").encode()
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        own = []
        if text and b"".join(bytes_a) == whole and b"".join(bytes_b) == whole:
            ends = [{sum(map(len, x[: i + 1])): i + 1 for i in range(len(x))} for x in (bytes_a, bytes_b)] if len(whole) < 1000 else [_ends(bytes_a), _ends(bytes_b)]
            at = (0, 0)
            for end in sorted(ends[0].keys() & ends[1].keys()):
                to = (ends[0][end], ends[1][end])
                own.append((a[at[0] : to[0]], b[at[1] : to[1]]))
                at = to
        groups.append(own)
    linked = [Counter((x, y) for a, b in own for x in a for y in b) for own in groups]
    counts = Counter(pair for own in linked for pair in own)
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for own, pairs in zip(groups, linked, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out.append((
            sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), sum(pairs.values()), sum(n for p, n in pairs.items() if counts[p] == most[p[0]]),
            sum(n * counts[p] for p, n in pairs.items()), hashlib.sha256(text.encode()).hexdigest() if own else "",
        ))
    return out


def _ends(parts):
    out, at = {}, 0
    for i, part in enumerate(parts):
        at += len(part)
        out[at] = i + 1
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    letters = "abcdefghijklmnop éß漢😀\n\t ."
    texts = [*ODD, *("".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(60))]
    return texts + ["one two three, four."] * 40 + texts[-20:]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 50, 1])
def test_alignment_equals_brute_force(spark, make_docs, corpus, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    rows = alignment.alignment(make_docs(*enumerate(corpus)), SPEC, MODEL).collect()
    assert len(rows) == len(corpus)
    got = {x.doc_id: tuple(x[c] for c in COLUMNS) for x in rows}
    for i, want in enumerate(_plain(corpus)):
        assert got[i] == want, repr(corpus[i])[:80]


def test_pairs_count_documents(spark, make_docs):
    docs = make_docs(*((i, "word word") for i in range(5)), (9, "word"))
    pairs = alignment.pair_counts(alignment.encoded_texts(docs, SPEC, MODEL)).collect()
    assert [p.n for p in pairs] == [6] and pairs[0].is_best


def test_library_form_and_fast_form_agree():
    fast, plain = alignment.Aligner(SPEC, MODEL), alignment.Aligner(SPEC, MODEL)
    assert fast.ranked and fast.cuts
    plain.ranked, plain.cuts = None, False
    r = random.Random(2)
    texts = [t for t in ODD if t] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x3000), r.randrange(0x1E000, 0x1F000)])) for _ in range(80)) for _ in range(60)]
    assert fast.texts(texts) == plain.texts(texts)


def test_groups_with_many_links(monkeypatch):
    texts = [t for t in ODD if t]
    listed = alignment.Aligner(SPEC, MODEL).texts(texts)
    monkeypatch.setattr(alignment, "LISTED", 0)
    assert alignment.Aligner(SPEC, MODEL).texts(texts) == listed


def test_odd_tables(spark, odd_docs):
    got = alignment.alignment(odd_docs, SPEC, MODEL)
    assert got.count() == odd_docs.count() and got.where("doc_id = 4").distinct().count() == 1
    assert got.where("doc_id in (1, 2)").agg(F.sum("n_a"), F.max("groups_sha256")).first() == (0, "")
    assert alignment.alignment(odd_docs.limit(0), SPEC, MODEL).count() == 0
