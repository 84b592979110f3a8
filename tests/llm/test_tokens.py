"""Prefix token counts and cross-tokenizer alignment against the libraries and plain loops."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from korvane.llm import alignment, counts

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string, block string, place int, changes int, pair string, `groups` long"
RND = random.Random(8)
BITS = ["a", "the", " ", "  ", "\n", "\t", "'re", "'", "'ll", "ve", "é", "日本", "🙂", "1", "!", "<|endoftext|>", "<|end", "　", "ing", "-" * 9, "don't", "\r\n", "<s>", "\x1c"]


def mixed(n):
    return "".join(RND.choice(BITS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [mixed(RND.randint(0, 40)) for _ in range(150)] + [None, "", " ", "\n", "▁ own sign", "x▁y", "a" * 5000, "ab cd " * 4000, " lead", "trail  ", "q" * 300_000]
    rows = [(i, t, "n", "b", 1, 2, "p", 3) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_every_prefix():
    tok, c = Tokenizer.from_file(BYTE), counts.PrefixCounter(BYTE)
    for _ in range(250):
        t = mixed(RND.randint(0, 14))
        at, want = 0, [len(tok.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        got = [0] + [at := at + int(x) for x in c.changes(t)]
        assert got == want, t


def test_prefixes_with_small_tables():
    """Bounded tables and caches that overflow inside a word change nothing."""
    tok, c = Tokenizer.from_file(BYTE), counts.PrefixCounter(BYTE)
    c.LIMIT, c.table.LIMIT = 3, 5
    for _ in range(30):
        t = "".join(RND.choice("etaoinshr") for _ in range(60)) + mixed(10)
        assert int(c.changes(t).sum()) == len(tok.encode(t, add_special_tokens=False).ids)


def test_every_prefix_across_a_reset():
    """A piece whose states overflow the table more than once: rows that name each other are made anew, and no prefix is counted wrong."""
    tok, c = Tokenizer.from_file(BYTE), counts.PrefixCounter(BYTE)
    c.table.LIMIT = 5
    resets, reset = [], c.table._reset
    c.table._reset = lambda: (resets.append(1), reset())
    t = "".join(RND.choice("etaoinshr") for _ in range(80))
    got = c.table.counts(t.encode())
    assert got == [len(tok.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
    assert len(resets) > 1 and len(c.table.states) <= 2 * c.table.LIMIT + 1
    assert [row[None] for row in c.table.rows] == list(range(len(c.table.states)))
    assert c.table.counts(t.encode()) == got


def test_counts_and_questions(spark, docs):
    tok = Tokenizer.from_file(BYTE)
    stored = counts.prefix_counts(docs, BYTE)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = stored.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.collect())
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_chars"], r["n_tokens"]) == (len(t.encode()), len(t), len(tok.encode(t, add_special_tokens=False).ids))
    short = stored.where("n_chars < 60").withColumn("row", F.lit("mine")).withColumn("asked", F.col("doc_id") % 7)
    for r in counts.longest_within(short, F.col("asked"), "fits").collect():
        t = texts[r["doc_id"]]
        n = [len(tok.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert r["row"] == "mine" and r["fits"] == (None if r["doc_id"] is None else max(i for i, x in enumerate(n) if x <= r["asked"]))
    for r in counts.count_at(short, F.col("asked") * 3 - 2).collect():
        t = texts[r["doc_id"]]
        assert r["tokens"] == (None if r["doc_id"] is None else len(tok.encode(t[: max(0, r["asked"] * 3 - 2)], add_special_tokens=False).ids))
    assert counts.prefix_counts(docs.limit(0), BYTE).count() == 0
    assert counts.longest_within(stored, F.lit(None)).where("characters is not null").count() == 0


def by_hand(texts):
    """Groups and links of every text by the libraries, token bytes spelled out, all pairs compared."""
    tok, sp = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    tok.encode_special_tokens = True
    out = []
    for t in texts:
        a = tok.encode(" " + t, add_special_tokens=False) if t else None
        b = sp.encode(t) if t else []
        raw_b = [bytes.fromhex(sp.id_to_piece(i)[3:5]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(raw_b) != (" " + t).encode():
            out.append((0, 0, "", []))
            continue
        ids_a, size_a = a.ids, [len(x) for x in a.tokens]  # a letter a byte
        ends = lambda sizes: [sum(sizes[: i + 1]) for i in range(len(sizes))]
        end_a, end_b = ends(size_a), ends([len(x) for x in raw_b])
        both = sorted(set(end_a) & set(end_b))
        said, found = [], []
        for lo, hi in zip([0, *both], both):
            x = [k for k, e in enumerate(end_a) if lo < e <= hi]
            y = [k for k, e in enumerate(end_b) if lo < e <= hi]
            said.append(",".join(str(ids_a[k]) for k in x) + "|" + ",".join(str(b[k]) for k in y))
            found += [(ids_a[i], b[j]) for i in x for j in y if max(end_a[i] - size_a[i], end_b[j] - len(raw_b[j])) < min(end_a[i], end_b[j])]
        out.append((len(ids_a), len(b), ";".join(said), found))
    return out


@pytest.mark.parametrize("block", [alignment.BLOCK, 100])
def test_alignment(spark, docs, block):
    some = docs.where("text is null or length(text) < 3000")
    rows = some.collect()
    want = by_hand([r["text"] or "" for r in rows])
    pairs = Counter(p for w in want for p in w[3])
    most = {}
    for (_, b), n in pairs.items():
        most[b] = max(most.get(b, 0), n)
    made = alignment.Alignment(some, BYTE, PIECE, keep=True, block=block)
    digest = lambda r: tuple(str(x) for x in r)
    expected = sorted(
        digest((r["doc_id"], na, nb, len(said.split(";")) if said else 0, len(found), sum(pairs[p] == most[p[1]] for p in found), sum(pairs[p] for p in found), hashlib.sha256(said.encode()).hexdigest() if said else "", said))
        for r, (na, nb, said, found) in zip(rows, want, strict=True)
    )
    assert sorted(digest((*r[:-1], bytes(r["groups"]).decode())) for r in made.documents().collect()) == expected
    got = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in made.pairs().collect()}
    assert got == {p: (n, n == most[p[1]]) for p, n in pairs.items()}


def test_alignment_whole_and_empty(spark, docs):
    """Long texts in chunks come out like the whole text at once; an empty table gives nothing."""
    whole, own = alignment.Aligner(BYTE, PIECE), alignment.Aligner(BYTE, PIECE)
    whole.chunks, own.LIMIT = lambda t: [t], 4
    for r in docs.collect():
        assert own.align(r["text"] or "") == whole.align(r["text"] or "")
    assert alignment.Alignment(docs.limit(0), BYTE, PIECE).documents().count() == 0
    assert alignment.Alignment(docs.where("text is null"), BYTE, PIECE).documents().where("n_a = 0 and groups_sha256 = ''").count() == 1
