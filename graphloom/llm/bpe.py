"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

For a merge list, ``lookahead`` computes how far to the right of a token's end text can still change that token: a merge
(a, b) can only be prevented from the right by an earlier merge whose left part is on the right edge of b, and so on through
ever earlier merges; the longest such chain bounds the reach. ``Transducer`` feeds on text piece by piece, keeps no more
than a fixed window of a word's symbols, and emits a token as soon as its end is that far from the window's end, so that
memory is constant however long a word is; words pass it one by one, and words of at most 256 characters are remembered in a
bounded cache. Texts are worked off in blocks that end at white space, ids go on to the decoder as they come, and only digests
are kept. ``TextMachine`` turns bytes back into text piece by piece, wherever the pieces end, with replacement characters where
bytes are no UTF-8.

Null texts count as empty and give no ids. Repeated rows give repeated results; empty tables give empty ones.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from ._spark import by_slice, slim
from ._text import worker_cache

#: Words that a worker remembers; characters of a text that are worked off at a time, about; bytes that are decoded at a time.
CACHE_WORDS, BLOCK, WINDOW = 1_000_000, 1 << 16, 1 << 14
# Unicode's White_Space, and the pattern of the word vocabulary's pieces.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_SPACES = re.compile(f"[{SPACE}]+")
#: White space to Python's str.split(), but not to Unicode.
_ODD = re.compile("[\x1c-\x1f]")


#: Stands for the end of a word among bytes; no UTF-8 text has it.
_MARK = b"\xff"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file's tokens and merges, whose symbols are the printable stand-ins of bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: r for r, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in {**self.ids, **self.special}.items():
            self.tokens[i] = t
        self.symbols = byte_symbols()
        self.longest, self.lookahead = lookahead(merges, self.suffix)
        back = {c: bytes([b]) for b, c in enumerate(self.symbols)}
        raw = lambda t: b"".join(back[c] for c in t.removesuffix(self.suffix)) + _MARK if self.suffix and t.endswith(self.suffix) else b"".join(back[c] for c in t)
        # single bytes come first, then a word's last byte with its end, then the merges in their order
        names = [*self.symbols, *((c + self.suffix for c in self.symbols) if self.suffix else ()), *(a + b for a, b in merges)]
        kernel: dict[bytes, int] = {}
        for n, t in enumerate(names):
            kernel.setdefault(raw(t), n)
        self.of_rank = [self.ids[t] for t in names]
        self.sizes = [len(raw(t)) for t in names]
        self.merge = tiktoken.Encoding("bpe", pat_str=".", mergeable_ranks=kernel, special_tokens={})._core_bpe.encode_single_piece


def lookahead(merges: list[tuple[str, str]], suffix: str = "") -> tuple[int, int]:
    """Symbols in the longest token, and the symbols beyond a token's end that can still change it."""
    size = lambda t: len(t.removesuffix(suffix) if suffix else t)
    right: dict[str, str] = {}  # a merged token's right part
    reach: dict[str, int] = {}  # by left part, the farthest reach of the merges so far
    most, longest = 1, 1
    for a, b in merges:
        far, edge = 0, b
        while edge:
            far = max(far, reach.get(edge, 0))
            edge = right.get(edge, "")
        far += size(b)
        reach[a] = max(reach.get(a, 0), far)
        right.setdefault(a + b, b)
        most, longest = max(most, far), max(longest, size(a + b))
    return longest, most


def merge(symbols: list[str], ranks: dict) -> list[str]:
    """The tokens of a run of symbols by definition: the first of the earliest listed merges is made, again and again."""
    while len(symbols) > 1:
        r, at = min((ranks.get(p, len(ranks)), i) for i, p in enumerate(zip(symbols, symbols[1:])))
        if r == len(ranks):
            break
        symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
    return symbols


class Transducer:
    """Ids of one word, from its bytes as they come; at most ``window`` of them are held.

    Runs are merged by a compiled kernel that ranks a pair by the token it makes. That is the merge list's own order if every
    token, alone, is made by its own merge (the tests check this for every merge of the vocabulary in use).
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.window = 2 * (vocabulary.lookahead + vocabulary.longest)
        self.held = b""

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) > self.window:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        at, limit = 0, len(self.held) - self.v.lookahead
        for r in self.v.merge(self.held):
            to = at + self.v.sizes[r]
            if to > limit:
                break
            at = to
            yield self.v.of_rank[r]
        self.held = self.held[at:]

    def end(self) -> list[int]:
        """The rest, once the word has ended."""
        rest, self.held = self.held, b""
        return [self.v.of_rank[r] for r in self.v.merge(rest + _MARK if self.v.suffix else rest)] if rest else []


class WordEncoder:
    """Ids of whole texts under the word vocabulary: NFC, white space runs as one space, lower case, pieces, bytes, merges."""

    PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.special = re.compile("|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True)))) if self.v.special else None
        self.window = Transducer(self.v).window

    def _piece(self, piece: str) -> list[int]:
        run = Transducer(self.v)
        return [*run.feed(piece.encode("utf-8", "surrogatepass")), *run.end()]

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a run without white space."""
        low = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        if low.isalpha():  # letters only: one piece
            ids = tuple(self._piece(low))
        else:
            ids = tuple(i for p in self.PIECE.findall(low) for i in self._piece(p))
        if len(word) <= 256:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def blocks(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, a block of it at a time."""
        at = 0
        if self.special and "<|" in text:
            for m in self.special.finditer(text):
                yield from self._plain(text, at, m.start())
                yield [self.v.special[m[0]]]
                at = m.end()
        yield from self._plain(text, at, len(text))

    def encode(self, text: str) -> list[int]:
        return [i for block in self.blocks(text) for i in block]

    def _plain(self, text: str, at: int, end: int) -> Iterator[list[int]]:
        """Blocks end at white space, so no word is split."""
        held, new = self.cache.get, self.word
        while at < end:
            gap = _SPACES.search(text, min(at + BLOCK, end), end)
            to = gap.end() if gap else end
            part = text[at:to]
            ids: list[int] = []
            for w in part.split() if not _ODD.search(part) else filter(None, _SPACES.split(part)):
                ids += held(w) or new(w)
            yield ids
            at = to


class TextMachine:
    """Bytes to text, incrementally: it holds at most the three bytes of an unfinished character."""

    def __init__(self):
        self._decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._decoder.decode(data)

    def end(self) -> str:
        return self._decoder.decode(b"", True)


def decoded(blocks: Iterable[list[int]], tokens: list[str]) -> Iterator[str]:
    """The tokens with a space between, as a tokenizer without a decoder gives them, in pieces: bytes pass the machine ``WINDOW`` at a time."""
    machine, held, first = TextMachine(), b"", True
    for ids in blocks:
        if not ids:
            continue
        held += (("" if first else " ") + " ".join(map(tokens.__getitem__, ids))).encode()
        first = False
        whole = len(held) - len(held) % WINDOW
        for at in range(0, whole, WINDOW):
            yield machine.feed(held[at : at + WINDOW])
        held = held[whole:]
    yield machine.feed(held)
    yield machine.end()


def decode(ids: list[int], tokens: list[str]) -> str:
    return "".join(decoded([ids], tokens))


def decode_bytes(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    """Text of ids under a byte-level vocabulary: symbols back to bytes, bytes to text, word ends to spaces."""
    back = {s: b for b, s in enumerate(vocabulary.symbols)}
    machine, out = TextMachine(), []
    for i in ids:
        t = vocabulary.tokens[i]
        ended = bool(vocabulary.suffix) and t.endswith(vocabulary.suffix)
        out.append(machine.feed(bytes(back[c] for c in (t.removesuffix(vocabulary.suffix) if ended else t)) + b" " * ended))
    return "".join(out) + machine.end()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""

    def kernel(part):
        enc = worker_cache(("word_bpe", path), lambda: WordEncoder(path))
        shown = worker_cache(("decimal", len(enc.v.tokens)), lambda: [str(i) for i in range(len(enc.v.tokens))])
        n, ids_sha, text_sha = [], [], []
        for t in part.column("text").to_pylist():
            count, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

            def counted(t=t, ids_hash=ids_hash):
                nonlocal count
                for ids in enc.blocks(t):
                    if ids:
                        ids_hash.update(((" " if count else "") + " ".join(map(shown.__getitem__, ids))).encode())
                        count += len(ids)
                        yield ids

            for piece in decoded(counted(), enc.v.tokens):
                text_hash.update(piece.encode())
            n.append(count)
            ids_sha.append(ids_hash.hexdigest())
            text_sha.append(text_hash.hexdigest())
        return {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}

    return by_slice(slim(docs), kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
