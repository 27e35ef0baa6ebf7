import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import alignment as m

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in VISIBLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}


@pytest.fixture(scope="module")
def plain():
    """Rows of `align` for texts, by comparing places token by token."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True

    def places(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends], ends, strict=False))

    def run(texts):
        rows, all_links, held = [], [], Counter()
        for text in texts:
            a, b = (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
            bytes_a = [bytes(BYTE[c] for c in one.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
            data = (" " + text).encode() if text else b""
            if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
                a, b, bytes_a, bytes_b = [], [], [], []
            at_a, at_b = places(bytes_a), places(bytes_b)
            cuts, groups, lo = sorted({e for _, e in at_a} & {e for _, e in at_b}), [], 0
            for cut in cuts:
                groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, at, strict=True) if lo <= s and e <= cut) for ids, at in ((a, at_a), (b, at_b))))
                lo = cut
            links = [(x, y) for x, (s, e) in zip(a, at_a, strict=True) for y, (t, f) in zip(b, at_b, strict=True) if s < f and t < e]
            held.update(set(links))
            all_links.append(links)
            rows.append((len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        most = defaultdict(int)
        for (x, _), n in held.items():
            most[x] = max(most[x], n)
        return [(*r, sum(held[k] == most[k[0]] for k in ks), sum(held[k] for k in ks)) for r, ks in zip(rows, all_links, strict=True)]

    return run


def aligned(df, **options):
    rows = m.align(df, A, B, **options).collect()
    return sorted((tuple(r)[1:] for r in rows), key=repr), {r["doc_id"]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("block", [100, m.BLOCK])
def test_equals_plain_alignment(spark, sf, plain, block):
    docs = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect() if len(r["text"]) < 1200]
    texts = docs + [None, "", " ", "a", "two  spaces", "tab\tx", "<|endoftext|> <s> <0x41>", "日本語 \U0001f600 ₿", "x\x00y", "▁ mark", "line\nend\n", "é ﬁ Ⅷ", "dup", "dup"]
    _, got = aligned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block)
    assert [got[i] for i in range(len(texts))] == plain(texts)
    assert sum(v[0] > 0 for v in got.values()) > len(docs)


def test_odd_tables(odd_docs, no_docs, plain):
    got, _ = aligned(odd_docs)
    assert got == sorted(plain([r["text"] for r in odd_docs.collect()]), key=repr)
    assert aligned(no_docs) == ([], {})


def test_one_very_long_text(spark, plain):
    text = " ".join(f"word{i} and" for i in range(110_000))  # 1.5 MB
    _, got = aligned(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), block=1000)
    assert got[1][0] > 300_000 and got[1][2] > 100_000 and got[2][:2] == plain(["short"])[0][:2]
