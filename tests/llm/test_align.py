"""Token alignment against a plain version made with the libraries' own calls."""

import collections
import random

import cases
import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from hydroloom.llm import align

SMALL = "/root/testdata/sf0.001"
PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def plain(rows):
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    levels, found = align._byte_levels(), []
    for doc_id, text in rows:
        a = b = []
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            bytes_a = [bytes(levels[c] for c in first.id_to_token(t)) for t in a]
            pieces = [second.id_to_piece(t) for t in b]
            bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(t) else p.replace("▁", " ").encode() for t, p in zip(b, pieces)]
            if not b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
                a, b = [], []
        groups, own_a, own_b, at_a, at_b, j = [], [], [], 0, 0, 0
        for t, data in zip(a, bytes_a if a else []):
            own_a.append(t)
            at_a += len(data)
            while at_b < at_a and j < len(b):
                own_b.append(b[j])
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        found.append((doc_id, a, b, groups))
    held = collections.Counter()
    for _, _, _, groups in found:
        held.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    top = collections.defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for doc_id, a, b, groups in found:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        line = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((
            doc_id, len(a), len(b), len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links),
            cases.sha(line) if line else "",
        ))
    return out


def test_equal_to_a_plain_version(spark, monkeypatch):
    rows = [r[:2] for r in cases.documents()] + [
        (70, "<|endoftext|> <s> </s> <unk> plain"), (71, "a▁b"), (72, "  two  blanks \n\n and 日本語のテキスト 🙂🙃"), (73, "don't"), (74, " "),
        (75, "🙂" * 500), (76, "".join(chr(0x4E00 + k * 37 % 20000) for k in range(800))), (77, "\U0001f9d1‍\U0001f33e" * 100),
    ]
    rows += [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = plain(rows)
    assert any(n > 1 for n in (w[1] for w in want)) and sum(w[3] > 1 for w in want) > 200
    cases.same(align.align_tokens(frame, *PATHS, public_tokenizers.PATTERN).select(*names), want)
    assert align.align_tokens(frame.limit(0), *PATHS, public_tokenizers.PATTERN).count() == 0


def test_slices_and_long_groups_change_nothing(monkeypatch):
    aligner = align._aligner(*PATHS, public_tokenizers.PATTERN)
    texts = ["🙂 héllo wörld 日本 " * 5, "spam " * 50, "x" * 300, ""]
    whole = aligner.run(texts)
    monkeypatch.setattr(align, "WIDE", 1)
    again = aligner.run(texts)
    for name in whole:
        assert [np.asarray(x).tolist() for x in whole[name]] == [np.asarray(x).tolist() for x in again[name]]


def test_runs_equal_common_ends():
    random.seed(8)
    for _ in range(300):
        top = random.randint(1, 200)
        a, b = ({*random.sample(range(1, top + 1), random.randint(0, top)), top} for _ in range(2))
        a, b = sorted(a), sorted(b)
        ends = sorted(set(a) & set(b))
        got = align.group_ends(np.array(a), np.array(b))
        assert [a[i] for i in got[0]] == ends == [b[j] for j in got[1]]
