"""Alignment of two tokenizers against whole texts and byte ranges."""

from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from casemill.llm import alignment, queries

A, B = public_tokenizers.path(queries.BYTE_LEVEL), public_tokenizers.path(queries.PIECES)
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
TEXTS = [
    "the cat sat on the mat",
    "the cat's hat, isn't it?  two  spaces\n\nnew line \t tab ",
    " leading and trailing ",
    "é Ünï 漢字 😀 ascii 漢 字字 x😀y",
    "a \x00 b \x1c c \xa0 d 　 e ​ f \r\n g",
    "has ▁ inside",
    "</s> <s> <|endoftext|> <0x41> [INST] <unk>",
    "é combining ́ mark",
    "0123456789" * 30 + " " + "ab" * 200,
    " ",
    "\n",
    "x",
    None,
    "",
    "the cat sat on the mat",
    "퟿ ퟿  �",
    "ﬁ ½ Ａ İ",
]


def brute(texts):
    """Whole texts, tokens placed by their decoded bytes, every byte asked for its two tokens."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    chars = alignment._byte_of_char()
    names = {i: t for t, i in a.get_vocab().items()}
    docs = []
    for text in texts:
        docs.append(None)
        if not text:
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        data = (" " + text).encode()
        spelled = [bytes(chars[c] for c in names[i]) for i in ids[0]], [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in ids[1]
        ]
        if any(b"".join(s) != data for s in spelled):
            continue
        spans = []
        for tokens in spelled:
            at = 0
            spans.append([(at, at := at + len(t)) for t in tokens])
        owners = [[i for i, (s, e) in enumerate(sp) for _ in range(s, e)] for sp in spans]
        links = [(ids[0][i], ids[1][j]) for i, j in sorted(set(zip(*owners)))]
        ends = [{e for _, e in sp} for sp in spans]
        groups, members = [], ([], [])
        for at in range(1, len(data) + 1):
            for side in (0, 1):
                if at in ends[side]:
                    members[side].append(str(ids[side][owners[side][at - 1]]))
            if at in ends[0] and at in ends[1]:
                groups.append("|".join(",".join(m) for m in members))
                members = ([], [])
        docs[-1] = (len(ids[0]), len(ids[1]), groups, links)
    counts = Counter(p for d in docs if d for p in set(d[3]))
    tops = Counter()
    for (i, _), n in counts.items():
        tops[i] = max(tops[i], n)
    return [
        (d[0], d[1], len(d[2]), len(d[3]), sum(counts[p] == tops[p[0]] for p in d[3]), sum(counts[p] for p in d[3]), ";".join(d[2]))
        if d
        else (0, 0, 0, 0, 0, 0, "")
        for d in docs
    ]


@pytest.mark.parametrize("limit", [None, 0])
def test_alignment(spark, limit):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40)
    texts = [*TEXTS, *(r["text"] for r in documents.collect() if len(r["text"] or "") < 20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    found = alignment.align(docs, A, B, broadcast_pairs=limit).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in sorted(found)] == brute(texts)


def test_what_is_remembered_changes_nothing(monkeypatch):
    known = alignment._tokenizers(A, B)
    wanted = alignment.WordTable(known).encoded(TEXTS)
    monkeypatch.setattr(alignment, "KNOWN_CHARS", 5)
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 10)
    table = alignment.WordTable(known)
    for text, ids in zip(TEXTS, wanted):
        ((a, b),) = table.encoded([text])
        assert (a.tolist(), b.tolist()) == tuple(x.tolist() for x in ids)
    assert len(table.index) < 20


def test_coarse_ends_are_refined():
    coarse, sizes = np.array([0, 0, 3, 5, 9, 9, 10]), np.array([1, 1, 1, 2, 1, 3, 1])
    assert alignment.refined(coarse, sizes).tolist() == [1, 2, 3, 5, 6, 9, 10]


def test_words_without_a_pattern(monkeypatch):
    known = alignment._tokenizers(public_tokenizers.path(queries.BYTE_LEVEL), public_tokenizers.path(queries.PIECES))
    for text in ("", " ", " a b", "a b ", "a  b c", "a\n b", "a b\u2581 c", "é 漢 -", "a \t b"):
        assert known.words(text) == alignment._CUT.split(text)

    class NoPattern:
        def split(self, text):
            raise AssertionError("not needed")

    monkeypatch.setattr(alignment, "_CUT", NoPattern())
    assert known.words("one two, 3") == ["one", "two,", "3"]


def test_words_are_places_where_both_cut():
    known = alignment._tokenizers(A, B)
    assert known.cuttable
    text = "It's a test, (of) 12 words;  é x"
    assert known.words(text) == ["It's", "a", "test,", "(of)", "12", "words;  é", "x"]
    a, a_ends, b, b_ends = known.encode(text)
    for at in np.cumsum([len(f" {w}".encode()) for w in known.words(text)]):
        assert at in a_ends and at in b_ends


@pytest.mark.parametrize("limit", [None, 0])
def test_alignment_of_odd_rows(odd, none, limit):
    odd = odd.selectExpr("*", "1 AS pairs", "2 AS row", "3 AS totals", "4 AS n_a", "5 AS Groups")
    found = alignment.align(odd, A, B, broadcast_pairs=limit)
    assert found.columns == [c for c in odd.columns if c.lower() not in ("text", "n_a", "groups")] + COLUMNS
    rows = found.collect()
    assert len(rows) == odd.count()
    texts = [r["text"] for r in odd.collect()]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == sorted(brute(texts))
    empty = alignment.align(none, A, B, broadcast_pairs=limit)
    assert empty.columns == [c for c in none.columns if c != "text"] + COLUMNS and empty.count() == 0


def test_query(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op13_alignment(spark, str(tmp_path)).orderBy("doc_id").collect()
    wanted = [(i, *r[:-1], sha256(r[-1].encode()).hexdigest() if r[0] else "") for i, r in enumerate(brute(TEXTS))]
    assert [tuple(r) for r in rows] == wanted

