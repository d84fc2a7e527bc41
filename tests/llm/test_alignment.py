"""The pair index against whole texts encoded by both libraries and aligned character by character."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from encore.llm import alignment
from encore.llm.queries import QUERIES

ODD = [
    None, "", " ", "\n", "a", " a", "a ", "  two  spaces  ", "tab\tand\nline \n end", "null\x00byte", "e▁f", "▁", "ﬁ ½ Å",
    "don't we're they'll x's", "<s> </s> <unk> <0x41> <|endoftext|> a<|endoftext|>b", "日本語のテキスト　全角 スペース", "🙂👩‍👩‍👧 emoji",
    "\x1c\x1d sep \x85 nel \xa0 nbsp", "word" * 3000, "9" * 700 + " 12345", "é combining", "​ zero", "x" * 5 + " " * 40 + "y",
]


@pytest.fixture(scope="module")
def tokens():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # the printable stand-ins of a byte-level vocabulary: visible characters stay, the others follow from 256 on
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in seen} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in seen)}

    def of(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        first = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in ids]
        second = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
                  for i in b.encode(text)]
        data = (" " + text).encode()
        return (first, second) if all(b"".join(x for _, x in s) == data for s in (first, second)) else None

    return of


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(docs, tokens):
    facts, held = [], defaultdict(int)
    for doc_id, text in docs:
        both = tokens(text) if text else None
        if both is None:
            facts.append((doc_id, 0, 0, 0, Counter(), ""))
            continue
        a, b = map(spans, both)
        links, j = Counter(), 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links[i, b[k][0]] += 1
                k += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [[[], []] for _ in ends]
        for side, some in enumerate((a, b)):
            g = 0
            for i, _, e in some:
                while ends[g] < e:
                    g += 1
                groups[g][side].append(str(i))
        spelt = ";".join("|".join(",".join(x) for x in g) for g in groups)
        for pair in links:
            held[pair] += 1
        facts.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(spelt.encode()).hexdigest()))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    rows = [(d, n_a, n_b, n_g, sum(links.values()), sum(m for p, m in links.items() if held[p] == top[p[0]]),
             sum(m * held[p] for p, m in links.items()), sha) for d, n_a, n_b, n_g, links, sha in facts]
    links = Counter()
    for f in facts:
        links.update(f[4])
    return rows, {p: (n, links[p], n == top[p[0]]) for p, n in held.items()}


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
key = repr


def collected(table):
    return sorted((tuple(r) for r in table.select(COLUMNS).collect()), key=key)


def test_all_documents(spark, small, tokens):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows, _ = brute(docs, tokens)
    assert collected(QUERIES["op11_pair_bitmaps"](spark, small)) == sorted(rows, key=key)


def test_odd_rows_and_scores(spark, tokens):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "a row without an id"), (3, "repeated"), (3, "repeated")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 chunk", "2 low", "3 a_id", "4 docs")
    rows, scores = brute(docs, tokens)
    assert sum(r[1] == 0 for r in rows) >= 4
    for links in (alignment.CHUNK_LINKS, 50):
        index = alignment.pair_index(table.repartition(3), chunk_links=links)
        found = alignment.pair_scores(index)
        assert {(r.a_id, r.b_id): (r.n_docs, r.n_links, r.best) for r in found.collect()} == scores
        assert collected(alignment.document_scores(index, found)) == sorted(rows, key=key)


def test_empty_table(spark):
    assert alignment.aligned_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bitmaps_of_every_form():
    import numpy as np

    rng = np.random.default_rng(3)
    for docs in (1, 7, 300, 65536):
        owner, low = [], []
        for i, share in enumerate((0.001, 0.02, 0.2, 0.9, 1)):
            mine = np.flatnonzero(rng.random(docs) < share)
            owner.append(np.full(len(mine), i * 3)), low.append(mine)
        owner, low = np.concatenate(owner), np.concatenate(low)
        back, forms = {}, set()
        for form, owners, counts, cells in alignment.bitmaps(owner, low, docs):
            at = alignment.positions(form, counts, cells)
            forms.add(form)
            for o, part in zip(owners, np.split(at, np.cumsum(counts)[:-1])):
                back[int(o)] = part.tolist()
        assert back == {int(o): low[owner == o].tolist() for o in np.unique(owner)}
    assert alignment.BITS in forms
