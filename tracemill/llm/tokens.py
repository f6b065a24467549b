"""Token ids of whole texts by the ``tokenizers`` library, piece by piece.

Both vocabularies used here split a text by a pattern and encode each match on
its own, so a match's ids never depend on its surroundings.  A worker therefore
keeps the ids of the matches it has seen and asks the library for new ones only,
a batch at a time.  The memo is bounded; once full it keeps what it has, and
further matches are encoded anew in every batch.  The word splitting pattern is
found by arrays of characters; its words of up to ``HASHED_CHARS`` are told apart
by 64-bit hashes (a worker confuses a new word with one it keeps with probability
3e-14).

Splitting here is done for texts whose characters all lie below U+0250, where
the classes are tabulated from ``unicodedata``; any other text is split by the
library itself.  Tests compare both ways over all those characters.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from functools import cache
from itertools import chain, compress, islice, pairwise
from operator import not_

import numpy as np
import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WORD_FILE = "word_bpe_49k.json"
BYTE_FILE = "byte_bpe_multi_50k.tiktoken"
MEMO_WORDS = 250_000
TABLED = 0x250
_OUTSIDE = re.compile(f"[^\\x00-\\u{TABLED - 1:04x}]")
#: White space by the Unicode property, as far as it is tabled.
_SPACE = "".join(chr(c) for c in range(TABLED) if chr(c).isspace() and c not in range(0x1C, 0x20))


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(TABLED) if unicodedata.category(chr(c))[0] == kind)


def tabled(text: str) -> bool:
    return text.isascii() or not _OUTSIDE.search(text)


def localised(pattern: str) -> str:
    """``pattern`` with its letter, number and space classes written out."""
    letters, numbers, space = _class("L"), _class("N"), re.escape(_SPACE)
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
    out = out.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    out = out.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return out.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")


#: The pattern whose matches ``WordIds`` finds by arrays; no match holds white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACES, _LETTER, _NUMBER, _OTHER = range(4)
_KINDS = np.array([_SPACES if chr(c) in _SPACE else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(TABLED)], np.uint8)
_GAP = re.compile(f"[{re.escape(_SPACE)}]")
#: Words whose ids are kept.
WORDS_KEPT = 1 << 19
#: Characters of a word that is told by its hash; a longer one is encoded wherever it comes.
HASHED_CHARS = 64
#: Characters split at a time, about: few enough for their arrays to stay in a core's cache.
BLOCK_CHARS = 1 << 16
_BASE, _STEP, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def _bytes(encoding) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in encoding.ids)


def look_up(memo: dict, groups: list[list[str]], encode) -> list[list]:
    """What ``memo`` has for each string of each group; ``encode`` makes the rest,
    which ``memo`` keeps as far as its bound allows."""
    parts = [list(map(memo.get, group)) for group in groups]
    gaps = [list(compress(range(len(found)), map(not_, found))) for found in parts]
    new = list({group[i] for group, at in zip(groups, gaps, strict=True) for i in at})
    made = {}
    for at in range(0, len(new), 4096):
        some = new[at : at + 4096]
        made.update(zip(some, encode(some), strict=True))
    for group, found, at in zip(groups, parts, gaps, strict=True):
        for i in at:
            found[i] = made[group[i]]
    memo.update(islice(made.items(), max(0, MEMO_WORDS - len(memo))))
    return parts


class Store:
    """Ids of the words met so far, by 64-bit hashes of them; at most ``WORDS_KEPT`` words stay."""

    def __init__(self):
        self.keys, self.place = np.zeros(2 * WORDS_KEPT, np.uint64), np.zeros(2 * WORDS_KEPT, np.int32)
        self.shift = np.uint64(64 - WORDS_KEPT.bit_length())
        self.starts, self.counts, self.ids = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, "<u4")
        self.n = self.end = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place, -1 for those not kept."""
        slot = (hashes >> self.shift).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == hashes, self.place[slot], -1)
        left = np.flatnonzero((held != hashes) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.keys)
            held, own = self.keys[slot[left]], hashes[left]
            same = held == own
            out[left[same]] = self.place[slot[left[same]]]
            left = left[~same & (held != 0)]
        return out

    def add(self, ids: np.ndarray, counts: np.ndarray, hashes: np.ndarray | None = None) -> None:
        """Words with their ids one after another; those without hashes, or beyond the bound, are not found later."""
        n, end = self.n + len(counts), self.end + len(ids)
        if n > len(self.starts):
            self.starts, self.counts = (np.resize(x, 2 * n) for x in (self.starts, self.counts))
        if end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * end)
        self.starts[self.n : n], self.counts[self.n : n] = self.end + np.cumsum(counts) - counts, counts
        self.ids[self.end : end] = ids
        if hashes is not None:
            slot, place = (hashes >> self.shift).astype(np.int64), np.arange(self.n, n)
            left = np.flatnonzero(place < WORDS_KEPT)
            while len(left):
                free = left[self.keys[slot[left]] == 0]
                self.keys[slot[free]] = hashes[free]
                done = self.keys[slot[left]] == hashes[left]  # of several in one slot one has it
                self.place[slot[left[done]]] = place[left[done]]
                left = left[~done]
                slot[left] = (slot[left] + 1) % len(self.keys)
        self.n, self.end = n, end

    def keep(self, n: int) -> None:
        """Forget all words but the first ``n``."""
        if n < self.n:
            self.n, self.end = n, int(self.starts[n])


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash's base, and of its inverse."""
    return tuple(np.cumprod(np.array([1] + [x] * (n - 1), np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


class WordIds:
    """Little-endian uint32 ids of a text under a word-splitting BPE file."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        pattern = steps[0]["pattern"]["Regex"]
        self.by_array, self.pattern = pattern == WORD_PATTERN, re.compile(localised(pattern))
        self.store = Store()
        # The same model for texts that are words already, white space between them.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has: all encoded as one text, which is cut after the ids that end a word."""
        ids = np.array(self.words.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            each = [e.ids for e in self.words.encode_batch_fast(words, add_special_tokens=False)]
            return np.array(list(chain.from_iterable(each)), "<u4"), np.array(list(map(len, each)), np.int64)
        return ids, np.diff(ends, prepend=0)

    def _cuts(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of every match in ``text`` (tabled, lower case, a newline at its end)."""
        x = np.frombuffer(text.encode("utf-16-le"), "<u2")
        if not self.by_array:
            spans = np.array([m.span() for m in self.pattern.finditer(text[:-1])], np.int64).reshape(-1, 2)
            starts, ends = spans[:, 0], spans[:, 1]
        else:
            kind = _KINDS[x]
            cut = kind == _NUMBER
            cut[1:] |= kind[1:] != kind[:-1]
            cut[0] = True
            # An apostrophe that begins a match takes the letters of a contraction.
            at = np.flatnonzero(x[:-1] == ord("'"))
            at = at[cut[at] & (kind[at + 1] == _LETTER)]
            one, two = x[at + 1], x[np.minimum(at + 2, len(x) - 1)]
            double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            single = np.isin(one, [ord(c) for c in "stmd"])
            cut[at[single | double] + 1] = False
            cut[at[single] + 2] = True
            cut[at[double] + 3] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(x))
            match = kind[starts] != _SPACES
            starts, ends = starts[match], ends[match]
        powers, inverse = _powers(2 * BLOCK_CHARS) if len(x) <= 2 * BLOCK_CHARS else _powers.__wrapped__(len(x))
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * powers[: len(x)], out=total[1:])
        hashes = (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_STEP)
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(_MIX)
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(_MIX)
        return starts, ends, np.maximum(hashes ^ (hashes >> np.uint64(32)), np.uint64(1))

    def _block(self, texts: list[str]) -> list[bytes]:
        """The ids of each of ``texts`` (tabled, lower case)."""
        text, store = "\n".join(texts) + "\n", self.store
        starts, ends, hashes = self._cuts(text)
        place, long = store.find(hashes), ends - starts > HASHED_CHARS
        place[long] = -1

        def add(at: np.ndarray, hashes: np.ndarray | None = None) -> None:
            words = [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            store.add(*self._encode(words), hashes)

        short = np.flatnonzero((place < 0) & ~long)
        if len(short):
            new, first, which = np.unique(hashes[short], return_index=True, return_inverse=True)
            place[short] = store.n + which
            add(short[first], new)
        kept = min(store.n, WORDS_KEPT)
        if long.any():
            place[long] = store.n + np.arange(np.count_nonzero(long))
            add(np.flatnonzero(long))
        counts = store.counts[place]
        after = np.cumsum(counts)
        at = np.repeat(store.starts[place] - (after - counts), counts)
        at += np.arange(len(at))
        data = store.ids[at].tobytes()
        store.keep(kept)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        done = 4 * np.concatenate([[0], after])[np.searchsorted(starts, bounds)]
        return [data[a:b] for a, b in pairwise([0, *done.tolist()])]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """``_block`` of some texts at a time; long ones are cut at white space."""
        if not self.by_array:
            return [data for text in texts for data in self._block([text])]
        pieces, owners = [], []
        for k, text in enumerate(texts):
            at = 0
            while len(text) - at > BLOCK_CHARS and (gap := _GAP.search(text, at + BLOCK_CHARS)):
                pieces.append(text[at : gap.start()])
                owners.append(k)
                at = gap.end()
            pieces.append(text[at:] if at else text)
            owners.append(k)
        found, lo, chars = [], 0, 0
        for hi, piece in enumerate(pieces, 1):
            chars += len(piece) + 1
            if chars >= BLOCK_CHARS or hi == len(pieces):
                found += self._block(pieces[lo:hi])
                lo, chars = hi, 0
        if len(pieces) == len(texts):
            return found
        parts: list[list[bytes]] = [[] for _ in texts]
        for k, data in zip(owners, found, strict=True):
            parts[k].append(data)
        return list(map(b"".join, parts))

    def batch(self, texts: list[str]) -> list[bytes]:
        """One byte string of ids a text."""
        lower = list(map(str.lower, texts))
        plain = list(map(tabled, lower))
        found = iter(self._plain(list(compress(lower, plain))))
        return [
            next(found) if is_plain else _bytes(self.tokenizer.encode(text, add_special_tokens=False))
            for text, is_plain in zip(texts, plain, strict=True)
        ]


@cache
def word_ids(path: str | None = None) -> WordIds:
    return WordIds(path or public_tokenizers.path(WORD_FILE))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for U+0100 onwards.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Merge rules that rebuild ``ranks``: each token from the two parts that
    lower ranks leave of its bytes, in the order of the tokens' ranks."""
    rules = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min(
                (ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)
            )
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            rules.append((parts[0], parts[1]))
    return rules


class ByteBPE:
    """A byte-level BPE of the ``tokenizers`` library, built from a rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        from tokenizers import Regex, Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        letters = byte_letters()
        spell = lambda b: "".join(letters[x] for x in b)
        ranks = read_ranks(path)
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        model = BPE(
            vocab={spell(b): i for b, i in ranks.items()},
            merges=[(spell(a), spell(b)) for a, b in merges_of(ranks)],
            ignore_merges=True,
        )
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = Sequence(
            [Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.split = re.compile(localised(pattern)).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        parts = iter(look_up(self.memo, [self.split(t) for t in texts if tabled(t)], self._encode))
        return [
            list(chain.from_iterable(next(parts))) if tabled(t) else self.tokenizer.encode(t, add_special_tokens=False).ids
            for t in texts
        ]

    def _encode(self, matches: list[str]) -> list[tuple[int, ...]]:
        # A match on its own may split again (white space before a letter), so no split here.
        return [tuple(e.ids) for e in self._whole.encode_batch_fast(matches, add_special_tokens=False)]

    @property
    def _whole(self):
        """The same model for strings that are one match each."""
        if not hasattr(self, "_one"):
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import ByteLevel

            self._one = Tokenizer(self.tokenizer.model)
            self._one.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        return self._one

    def spans(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """Character offsets [start, end) of each id in ``text``.

        A token that ends inside a character's bytes counts that character as
        touched; the token that completes it starts at the same character.
        """
        ends, at = [], 0
        for ch in text:
            at += len(ch.encode())
            ends.append(at)
        import bisect

        out, byte = [], 0
        for i in ids:
            first = bisect.bisect_right(ends, byte)
            byte += len(self.table[i])
            out.append((first, bisect.bisect_left(ends, byte) + 1 if self.table[i] else first))
        return out

    def decode(self, ids) -> bytes:
        """The bytes of ``ids``, characters split over several ids included."""
        return b"".join(map(self.table.__getitem__, ids))


@cache
def byte_bpe(path: str | None = None) -> ByteBPE:
    return ByteBPE(path or public_tokenizers.path(BYTE_FILE))
