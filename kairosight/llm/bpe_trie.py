"""Byte-level BPE by prefix-sharing trie traversal.

The last token of the encoding of every prefix of a word fixes the whole encoding: it is the
one token that ends there, and that BPE would leave standing after the last token of what lies
before it.  Distinct words form a trie; walking it depth first (here: in sorted order, keeping
the states of the current path) computes the state of a shared prefix once.  The tokens that end
at a place are read off a trie of the reversed vocabulary, so a place costs no more steps than the
longest match there, however long the text runs without a break.

Two neighbouring tokens stay apart unless some merge joins a piece on the right edge of the
first with a piece on the left edge of the second while both pieces are alive, that is before
their own tokens consume them.  Equal merges happen from left to right, so at the same rank the
first token keeps its edge and the second loses it.

Defined cases: a null or empty text has no tokens; very long texts are encoded whole; special token strings in a text become their
ids, as the library does by default; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, words

VOCABULARY = "byte_bpe_50k.json"
#: Words kept with their encodings in a worker; beyond it the memo starts anew, results stay the same.
MEMO = 500_000
_NEVER = 1 << 60

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼½¾"
_BLANK = r"\t\n\r "
#: The library's split of a text, for texts of printable Latin-1; others are split by the library.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_STRANGE = re.compile("[^\t\n\r -~¡-ÿ]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """A merge table and the walk over words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id = {bytes(alphabet[c] for c in s): i for s, i in vocab.items() if s not in self.special}
        self.bytes = {i: b for b, i in self.id.items()} | {i: s.encode() for s, i in self.special.items()}
        self.step, self.ending = self._backwards(self.id)
        rank, parts = {}, {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            rank[vocab[a], vocab[b]] = r
            parts.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self.rank = rank
        self.right = {t: self._edge(t, parts, 1) for t in self.bytes}
        self.left = {t: self._edge(t, parts, 0) for t in self.bytes}
        self.known_pairs: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _backwards(tokens: dict[bytes, int]) -> tuple[dict[int, int], list[int]]:
        """A trie over the reversed vocabulary: the step from node * 256 + byte, and the token that a node ends, or -1."""
        step, ending = {}, [-1]
        for body, token in tokens.items():
            node = 0
            for b in reversed(body):
                at = node << 8 | b
                node = step.get(at, 0)
                if not node:
                    node = step[at] = len(ending)
                    ending.append(-1)
            ending[node] = token
        return step, ending

    @staticmethod
    def _edge(token: int, parts: dict, side: int) -> list[tuple[int, int]]:
        """Pieces on one edge of a token, each with the rank of the merge that consumes it."""
        edge, consumed = [(token, _NEVER)], token
        while consumed in parts:
            a, b, r = parts[consumed]
            consumed = b if side else a
            edge.append((consumed, r))
        return edge

    def apart(self, first: int, second: int) -> bool:
        """Whether BPE leaves these two tokens side by side."""
        found = self.known_pairs.get((first, second))
        if found is None:
            rank = self.rank
            found = not any(
                (r := rank.get((a, b))) is not None and r < a_until and r <= b_until
                for a, a_until in self.right[first]
                for b, b_until in self.left[second]
            )
            if len(self.known_pairs) > 2_000_000:
                self.known_pairs.clear()
            self.known_pairs[first, second] = found
        return found

    def walk(self, distinct: Iterable[bytes]) -> Iterable[tuple[bytes, list[int]]]:
        """Each word with its ids, in sorted order; the states of shared prefixes are computed once."""
        step, ending, apart, whole = self.step.get, self.ending, self.apart, self.whole
        path, state = b"", [(-1, 0)]  # per prefix length: last token, where it starts
        for word in sorted(distinct):
            n, shared = len(word), 0
            limit = min(n, len(path))
            while shared < limit and word[shared] == path[shared]:
                shared += 1
            del state[shared + 1 :]
            for end in range(shared + 1, n + 1):
                node, start, found = 0, end, []
                while start:
                    node = step(node << 8 | word[start - 1], 0)
                    if not node:
                        break
                    start -= 1
                    if ending[node] >= 0:
                        found.append((ending[node], start))
                for token, start in reversed(found):  # the longest first
                    if apart(state[start][0], token) if start else whole(token):
                        state.append((token, start))
                        break
                else:
                    raise ValueError(f"no encoding ends at byte {end} of {word!r}")
            path, out, at = word, [], n
            while at:
                token, at = state[at]
                out.append(token)
            yield word, out[::-1]

    def whole(self, token: int) -> bool:
        """Whether the string of a token is encoded as that token: its two parts must not have other plans."""
        edge = self.left[token]
        if len(edge) == 1:
            return True
        found = self.known_pairs.get((-1, token))
        if found is None:
            found = self._plain(self.bytes[token]) == [token]
            self.known_pairs[-1, token] = found
        return found

    def _plain(self, text: bytes) -> list[int]:
        """Merges in order of rank, for single vocabulary strings."""
        out = [self.id[text[i : i + 1]] for i in range(len(text))]
        while len(out) > 1:
            r, i = min((self.rank.get(p, _NEVER), i) for i, p in enumerate(zip(out, out[1:], strict=False)))
            if r == _NEVER:
                break
            out[i : i + 2] = [self.id[self.bytes[out[i]] + self.bytes[out[i + 1]]]]
        return out


class Codec:
    """Encodes and decodes whole texts through a memo of words."""

    def __init__(self, path: str):
        self.path = path
        self.encoder = Encoder(path)
        self.alphabet = byte_alphabet()
        self.texts: dict[str, str] = {}
        self.bodies: dict[str, bytes] = {}
        self.marks = re.compile("(" + "|".join(sorted(map(re.escape, self.encoder.special), key=len, reverse=True)) + ")") if self.encoder.special else None
        self._library = None

    def split(self, text: str) -> list[str]:
        """Words of a text; special tokens stand as words of their own."""
        if self.marks is not None and self.marks.search(text):
            out: list[str] = []
            for i, part in enumerate(self.marks.split(text)):
                out.extend([part] if i % 2 else self._words(part))
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if _STRANGE.search(text) is None:
            return _SPLIT.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        alphabet = self.alphabet
        return [bytes(map(alphabet.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in self._library.pre_tokenize_str(text)]

    def learn(self, distinct: set[str]) -> None:
        if len(self.texts) > MEMO:
            self.texts.clear()
            self.bodies.clear()
        new = [w for w in distinct if w not in self.texts]
        special, table = self.encoder.special, self.encoder.bytes
        plain = {}
        for w in new:
            if w in special:
                self.texts[w], self.bodies[w] = f"{special[w]},", table[special[w]]
            else:
                plain[w.encode("utf-8", "surrogateescape")] = w
        for body, ids in self.encoder.walk(plain):
            w = plain[body]
            self.texts[w] = "".join(f"{i}," for i in ids)
            self.bodies[w] = b"".join(map(table.__getitem__, ids))

    def encode(self, texts: list[str]) -> Iterable[tuple[str, str]]:
        """For each text: its ids joined by commas, and what they decode to."""
        split = list(map(self.split, texts))
        self.learn(set().union(*split))
        ids, bodies = self.texts.__getitem__, self.bodies.__getitem__
        for w in split:
            yield "".join(map(ids, w))[:-1], b"".join(map(bodies, w)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}
runtime.remembers(_codecs.clear)


def codec(path: str | None = None) -> Codec:
    """This process's codec for a vocabulary file; by default the public one of this machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _over(docs: DataFrame, carry: tuple[str, ...], schema: str, path: str | None, of: Callable) -> DataFrame:
    kinds = dict(docs.dtypes)
    full = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), schema])

    def run(batch: pa.RecordBatch):
        for part in words.chunks(batch, "text", 1 << 20):
            texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            arrays, names = of(codec(path).encode(texts))
            kept = [part.column(part.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], names=[*carry, *names])

    return runtime.map_batches(docs.select(*carry, *([] if "text" in carry else ["text"])), run, full)


def encode(docs: DataFrame, path: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns, ids (array<int>) and decoded text of each document; one narrow pass."""

    def of(pairs):
        ids, decoded = [], []
        for i, d in pairs:
            ids.append([int(x) for x in i.split(",")] if i else [])
            decoded.append(d)
        return [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["ids", "decoded"]

    return _over(docs, carry, "ids array<int>, decoded string", path, of)


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digest of the contract."""

    def of(pairs):
        n, a, b = [], [], []
        for i, d in pairs:
            n.append(i.count(",") + 1 if i else 0)
            a.append(hashlib.sha256(i.encode()).hexdigest())
            b.append(hashlib.sha256(d.encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"]

    found = _over(docs, ("doc_id",), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", path, of)
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))
