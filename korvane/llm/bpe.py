"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled one after another into a deterministic automaton over tokens. It starts as one state
with an arc for each base symbol. The gadget of a merge (u, v) -> w takes the state q that u leads to, splits
off a copy q' without its arc v, redirects u to q', and adds an arc w wherever an arc u is left; w leads where v
led. A path is accepted exactly if it is the BPE encoding of the string it spells. All arcs of a token
lead to one state, so the automaton is stored as that target of each token, and as a chain of copies a state,
each with the arc it lost and the merge that took it; an arc's presence is read off these chains.

Words run over a second table, made by determinising the automaton over symbols: its state is the set of open
arcs (a place in the trie of labels and the token before it), so each symbol costs one look-up. Rows of this
table are made when first needed and are bounded in number. Decoding emits arc labels.

Defined results: null and empty texts have no ids and decode to the empty text; one row comes back for each row,
repeated rows included; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import gc
import hashlib
import json
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvane.llm.common import batches, prepare, text_bytes, whole_text

ALWAYS = 1 << 60


class MergeAutomaton:
    """The token automaton of ranked merges. Tokens are numbered by the caller; ``base`` are the symbols."""

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]]):
        self.born = {t: -1 for t in base}
        self.left: dict[int, int] = {}
        self.parent, self.owner, self.made = [-1], [-1], [-1]  # by state; state 0 has every arc
        self.lost: dict[tuple[int, int], int] = {}  # (owner of the copy, label) -> merge that took the arc
        self.target = dict.fromkeys(base, 0)
        self.memo: dict[tuple[int, int], bool] = {}
        for k, (u, v, w) in enumerate(merges):
            self._gadget(k, u, v, w)

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        if w in self.born:
            return
        q, after = self.target[u], self.target[v]
        self.parent.append(q)
        self.owner.append(u)
        self.made.append(k)
        self.lost[u, v] = k
        self.target[u] = len(self.parent) - 1
        self.target[w], self.born[w], self.left[w] = after, k, u

    def _runs(self, state: int) -> list[tuple[int, int, int]]:
        """The chain of copies behind a state as (owner, first merge, last merge), newest first."""
        out: list[tuple[int, int, int]] = []
        while state:
            own, last = self.owner[state], self.made[state]
            while state and self.owner[state] == own:
                first, state = self.made[state], self.parent[state]
            out.append((own, first, last))
        return out

    def accepts(self, before: int, label: int) -> bool:
        """Whether the state that ``before`` leads to has an arc ``label``."""
        key = (before, label)
        if (known := self.memo.get(key)) is None:
            if len(self.memo) > 1_000_000:
                self.memo.clear()
            known = self.memo[key] = self._has(self.target[before], label)
        return known

    def _has(self, state: int, label: int) -> bool:
        runs, until = self._chain(state), ALWAYS
        while True:
            for own, first, last in runs:
                k = self.lost.get((own, label))
                if k is not None and first <= k <= last and k <= until:
                    return False
            if label not in self.left:
                return True
            label, until = self.left[label], self.born[label]

    def _chain(self, state: int) -> list[tuple[int, int, int]]:
        chains = self.__dict__.setdefault("chains", {})
        if state not in chains:
            chains[state] = self._runs(state)
        return chains[state]


class WordTable:
    """Symbols in, tokens out: the automaton determinised over symbols, made row by row."""

    LIMIT = 120_000

    def __init__(self, auto: MergeAutomaton, spelled: dict[int, tuple[int, ...]]):
        self.auto = auto
        self.child: dict[tuple[int, int], int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for token, symbols in spelled.items():
            at = 0
            for s in symbols:
                nxt = self.child.get((at, s))
                if nxt is None:
                    nxt = self.child[at, s] = nodes
                    nodes += 1
                at = nxt
            self.token_at[at] = token
        self.size = {t: len(s) for t, s in spelled.items()}
        self._reset()

    def _reset(self) -> None:
        for row in self.__dict__.get("rows", ()):
            row.clear()  # rows name each other; the collector may be off
        self.states: list[tuple] = [((0, None),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        #: by state: symbol -> (the next state's row, token that ends here); a row has its state's number under None
        self.rows: list[dict] = [{None: 0}]

    def _step(self, state: int, symbol: int) -> tuple[dict, int]:
        """The next state's row and the token that ends here in the encoding of all symbols so far."""
        open_, found = [], None
        child, accepts = self.child.get, self.auto.accepts
        for node, before in self.states[state]:
            nxt = child((node, symbol))
            if nxt is None:
                continue
            open_.append((nxt, before))
            if found is None:
                token = self.token_at.get(nxt)
                if token is not None and (before is None or accepts(before, token)):
                    found = token
        if found is None:
            raise ValueError("a symbol outside the vocabulary")
        key = (*open_, (0, found))
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
            self.rows.append({None: n})
        return self.rows[n], found

    def encode(self, symbols: Sequence[int]) -> list[int]:
        if len(self.states) > self.LIMIT:
            self._reset()
        row, ends = self.rows[0], []
        for s in symbols:
            if s in row:
                row, token = row[s]
            else:
                got = row[s] = self._step(row[None], s)
                row, token = got
            ends.append(token)
        out, at, size = [], len(ends), self.size
        while at:
            t = ends[at - 1]
            out.append(t)
            at -= size[t]
        return out[::-1]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable bytes are themselves, the others follow from 256."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class WordBpe:
    """A tokenizers file of the word-end kind, compiled. Bounded caches; one a worker."""

    LIMIT = 200_000
    #: Chunks encoded at once, and the length from which a chunk or word is not kept.
    RUN, LONG = 4096, 48
    #: Separators that Python splits at and the vocabulary's pattern does not.
    ODD_SPACES = "\x1c\x1d\x1e\x1f"

    def __init__(self, json_file: str):
        import regex

        with open(json_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.label = {i: t for t, i in vocab.items()}
        #: symbols: a byte inside a word, 256 + byte at its end
        symbol = {vocab[c]: b for b, c in enumerate(letters) if c in vocab} | {vocab[c + self.end]: 256 + b for b, c in enumerate(letters) if c + self.end in vocab}
        merges, spelled = [], {t: (s,) for t, s in symbol.items()}
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            merges.append((u, v, w))
            spelled.setdefault(w, spelled[u] + spelled[v])
        self.table = WordTable(MergeAutomaton(list(symbol), merges), spelled)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        #: by what lies between white space: ids and labels; and those of it that have no ids
        self.ids: dict[str, bytes] = {}
        self.labels: dict[str, bytes] = {}
        self.blank: set[str] = set()
        self.pieces: dict[str, tuple[bytes, bytes]] = {}

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word."""
        raw = word.encode()
        return self.table.encode([*raw[:-1], 256 + raw[-1]])

    def _learn(self, chunk: str) -> None:
        """Ids and labels of what lies between white space; words never cross it."""
        words = self.words(chunk)
        if len(words) == 1:
            self.ids[chunk], self.labels[chunk] = self._word(words[0])
            return
        got = [self.pieces.get(w) or self._word(w) for w in words]
        self.ids[chunk], self.labels[chunk] = b"".join([a for a, _ in got]), b" ".join([b for _, b in got])
        for w, x in zip(words, got, strict=True):
            if len(w) < self.LONG:
                self.pieces[w] = x
        if not got:
            self.blank.add(chunk)

    def _word(self, word: str) -> tuple[bytes, bytes]:
        ids = self.encode_word(word)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.label[i] for i in ids]).encode()

    def _forget(self) -> None:
        if len(self.ids) >= self.LIMIT:
            self.ids.clear()
            self.labels.clear()
            self.blank.clear()
        if len(self.pieces) >= self.LIMIT:
            self.pieces.clear()

    def _encode_chunks(self, chunks: list[str]) -> tuple[bytes, bytes]:
        """Ids and labels of a run of chunks; what is not known is learnt first, and long ones are forgotten after."""
        new = set(chunks).difference(self.ids)
        for c in new:
            self._learn(c)
        held = chunks if self.blank.isdisjoint(chunks) else [c for c in chunks if c not in self.blank]
        out = b"".join(map(self.ids.__getitem__, held)), b" ".join(map(self.labels.__getitem__, held))
        for c in new:
            if len(c) >= self.LONG:
                del self.ids[c], self.labels[c]
                self.blank.discard(c)
        return out

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, then each letter's lower case by itself (a capital sigma at a word's end is an ordinary one)."""
        if not text.isascii():
            import unicodedata

            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian uint32 and the decoded text in UTF-8."""
        parts = self.split(text) if self.split and any(s in text for s in self.special) else (text,)
        ids: list[bytes] = []
        labels: list[bytes] = []
        for p in parts:
            if p in self.special:
                ids.append(struct.pack("<I", self.special[p]))
                labels.append(p.encode())
                continue
            low = self.normalise(p)
            chunks = [low] if any(c in low for c in self.ODD_SPACES) else low.split()
            for i in range(0, len(chunks), self.RUN):
                self._forget()
                a, b = self._encode_chunks(chunks[i : i + self.RUN])
                if a:
                    ids.append(a)
                    labels.append(b)
        return b"".join(ids), b" ".join(labels)

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs, joined as a tokenizer without a decoder joins them."""
        names = {i: t for t, i in self.special.items()}
        return " ".join(names.get(i) or self.label[i] for i in ids)


_compiled: dict[str, WordBpe] = {}


def compiled(json_file: str) -> WordBpe:
    if json_file not in _compiled:
        _compiled[json_file] = WordBpe(json_file)
    return _compiled[json_file]


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _encode(json_file: str, digest: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(json_file)
        for b in batches(it):
            gc.disable()  # caches of many small objects without cycles: walking them again and again costs a sixth of the time
            got = [bpe.encode(t.decode()) for t in text_bytes(b.column(1))]
            gc.enable()
            if digest:
                cols = [pa.array([len(a) // 4 for a, _ in got], pa.int64()), pa.array([hashlib.sha256(a).hexdigest() for a, _ in got]), pa.array([hashlib.sha256(d).hexdigest() for _, d in got])]
            else:
                cols = [pa.array([a for a, _ in got], pa.binary()), pa.array([d.decode() for _, d in got])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=(DIGEST if digest else ENCODED).names)

    return run


def encode(docs: DataFrame, json_file: str, digest: bool = False) -> DataFrame:
    """doc_id, ids (little-endian uint32) and the text decoded from them; with ``digest`` their count and SHA-256."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(_encode(json_file, digest), DIGEST if digest else ENCODED)
