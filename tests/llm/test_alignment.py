"""Token alignment against a plain two-pointer version with the tokenizers' own libraries."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vocabloom.llm import alignment

R = random.Random(11)
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["".join(R.choice("abcdefghäöß") for _ in range(R.randint(1, 9))) for _ in range(120)]
SCHEMA = "doc_id long, text string, count string, a int, links string, _row long"
TEXTS = [" ".join(R.choice(WORDS) for _ in range(R.randint(1, 60))) for _ in range(40)]
TEXTS += [None, "", " ", "\n\t ", "a▁b", "<|endoftext|> and <s> or <unk>", "=" * 500, "é́ \U0001f600 中文", "x", "nul \x00 byte", TEXTS[0], TEXTS[0]]
TEXTS += [" ".join(R.choice(WORDS) for _ in range(15_000)), "ក្" * 300, "\r\n" * 40 + "  end"]
ROWS = [(None if i == 3 else i, t, "x", 1, "y", 5) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], None, None, None, None)]


def plain():
    """Of each row its groups as lists of ids, or none."""
    tokens = Tokenizer.from_file(A)
    tokens.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printed)}
    out = []
    for _, text, *_ in ROWS:
        groups = []
        if text:
            whole = (" " + text).encode()
            a = [(i, bytes(byte[c] for c in tokens.id_to_token(i))) for i in tokens.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in pieces.encode(text):
                piece = pieces.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                ends = []
                for side in (a, b):
                    at, own = 0, {}
                    for k, (_, x) in enumerate(side):
                        at += len(x)
                        own[at] = k + 1
                    ends.append(own)
                p = q = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    groups.append(([i for i, _ in a[p : ends[0][cut]]], [i for i, _ in b[q : ends[1][cut]]]))
                    p, q = ends[0][cut], ends[1][cut]
        out.append(groups)
    return out


@pytest.mark.parametrize("most", [200_000, 40])
def test_alignment(spark, monkeypatch, most):
    monkeypatch.setattr(alignment, "MOST_PAIRS", most)
    groups = plain()
    count = Counter(p for g in groups for p in {(x, y) for own, other in g for x in own for y in other})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    want = []
    for (doc_id, *_), g in zip(ROWS, groups, strict=True):
        links = [(x, y) for own, other in g for x in own for y in other]
        text = ";".join(f"{','.join(map(str, own))}|{','.join(map(str, other))}" for own, other in g)
        counts = [count[p] for p in links]
        n_best = sum(count[x, y] == best[x] for x, y in links)
        want.append((doc_id, sum(len(own) for own, _ in g), sum(len(other) for _, other in g), len(g), len(links), text, n_best, sum(counts)))
    made = alignment.align(spark.createDataFrame(ROWS, SCHEMA).repartition(3), A, B)
    got = alignment.with_pair_counts(made.withColumn("n_best", F.lit("clash")))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert sum(not g for g in groups) >= 3 and any(len(own) > 1 and len(other) > 1 for g in groups for own, other in g)


def test_empty(spark):
    made = alignment.with_pair_counts(alignment.align(spark.createDataFrame([], SCHEMA), A, B))
    assert made.count() == 0


def test_stretches():
    """Any two lists of ends: cuts are where both end, and stretches are one to one."""
    for seed in range(300):
        r = random.Random(seed)
        total = r.randint(1, 300)
        both = [sorted({*r.sample(range(1, total + 1), r.randint(0, total) if k else int(total * r.random())), total}) for k in range(2)]
        cuts, at = [], (0, 0)
        for i, p, j, q in alignment.stretches(*both):
            assert (i, j) == at and p > i and q > j
            at = p, q
            cuts += both[0][i:p] if both[0][i:p] == both[1][j:q] else [both[0][p - 1]]
            assert both[0][p - 1] == both[1][q - 1]
        assert cuts == sorted(set(both[0]) & set(both[1])) and at == (len(both[0]), len(both[1]))


def test_large_groups():
    """Links of a group of many tokens are counted by id, as those of small ones are."""
    a, b = [R.choice([5, 6, 7]) for _ in range(200)], [R.choice([1, 2]) for _ in range(99)]
    ends = list(range(2, 402, 2)), [*range(1, 197, 2), 400]
    n_groups, n_links, text, pairs = alignment.aligned(a, b, *ends)
    assert (n_groups, n_links) == (1, 200 * 99) and pairs == Counter((x, y) for x in a for y in b)
    assert text == f"{','.join(map(str, a))}|{','.join(map(str, b))}"
